"""Chat formatting: an event log is folded into final messages and rendered, by DataFrame functions alone.

An event is (conv_id, seq, kind, message, role, text). ``message`` names the message that the event is about:

* ``message``: a whole message begins here; a later ``message`` with the same name is another message;
* ``delta``: text is appended to the message;
* ``edit``: the message's text so far is replaced;
* ``regenerate``: the message's text so far is dropped, and this text begins the new one.

Events are folded by (conv_id, message), so a hot conversation is spread over tasks until its messages are final; a
rendered conversation is one value and so has to be put together in one place.

The template is ``<|im_start|>role\\ntext<|im_end|>\\n`` for each turn. A control string inside a text or role gets a
backslash before its bar (and one more where there are some already), line ends and backslashes in roles are escaped
too, so ``parse`` gives back exactly what went in. The loss mask is stored by turns, as the run of code points that
the model learns: ``loss_from`` (0-based, in the turn's string) and ``loss_chars``; 0 where nothing is learned.

Defined cases: null text or role is empty; events without a known kind are ignored; equal seq go by kind, text and
role; repeated ``message`` events are repeated messages; conversations whose id is null are one conversation; an empty
table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("message", "delta", "edit", "regenerate")
LEARNED = ("assistant",)
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\b")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("\\n"), F.lit("\n")), F.lit("\\b"), F.lit("\\"))


def events_of(turns: DataFrame, order: str = "turn") -> DataFrame:
    """A table of whole turns as an event log: each row is one ``message`` event."""
    return turns.select("conv_id", F.col(order).alias("seq"), F.lit("message").alias("kind"), F.col(order).cast("string").alias("message"), "role", "text")


def fold(events: DataFrame) -> DataFrame:
    """(conv_id, seq, role, text): the final messages, each at the place of its first event."""
    known = events.where(F.col("kind").isin(*KINDS))
    kind = F.when(F.col("kind") == "message", 0).when(F.col("kind") == "delta", 1).when(F.col("kind") == "edit", 2).otherwise(3)
    event = F.struct("seq", kind.alias("kind"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("role", F.lit("")).alias("role"))
    logs = known.groupBy("conv_id", "message").agg(F.sort_array(F.collect_list(event)).alias("log"))
    at = F.filter(F.transform("log", lambda e, i: F.when((e["kind"] == 0) | (i == 0), i)), lambda i: i.isNotNull())
    begins = logs.select("conv_id", "log", F.concat(at, F.array(F.size("log"))).alias("at"))
    spans = F.transform(F.sequence(F.lit(1), F.size("at") - 1), lambda k: F.slice("log", F.element_at("at", k) + 1, F.element_at("at", k + 1) - F.element_at("at", k)))

    def final(log: Column) -> Column:
        reset = F.array_max(F.transform(log, lambda e, i: F.when(e["kind"] >= 2, i).otherwise(0)))
        kept = F.slice(log, reset + 1, F.size(log))
        role = F.element_at(F.concat(F.transform(F.filter(log, lambda e: e["role"] != ""), lambda e: e["role"]), F.array(F.lit(""))), 1)
        return F.struct(F.element_at(log, 1)["seq"].alias("seq"), role.alias("role"), F.array_join(F.transform(kept, lambda e: e["text"]), "").alias("text"))

    return begins.select("conv_id", F.explode(F.transform(spans, final)).alias("m")).select("conv_id", "m.*")


def render(messages: DataFrame, learned: tuple[str, ...] = LEARNED) -> DataFrame:
    """(conv_id, formatted, mask): each conversation's turns in order of seq, role and text, and the loss mask."""
    role, body = escape_role(F.col("role")), escape(F.col("text"))
    head = F.concat(F.lit(OPEN), role, F.lit("\n"))
    loss = F.when(F.col("role").isin(*learned), F.struct(F.length(head).alias("loss_from"), F.length(body).alias("loss_chars"))).otherwise(F.struct(F.lit(0).alias("loss_from"), F.lit(0).alias("loss_chars")))
    turn = F.struct("seq", "role", "text", F.concat(head, body, F.lit(CLOSE + "\n")).alias("out"), loss.alias("loss"))
    whole = messages.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    return whole.select("conv_id", F.array_join("turns.out", "").alias("formatted"), F.col("turns.loss").alias("mask"))


def format_chats(events: DataFrame, learned: tuple[str, ...] = LEARNED) -> DataFrame:
    """(conv_id, formatted, mask) of every conversation of an event log."""
    return render(fold(events), learned)


def parse(formatted: DataFrame) -> DataFrame:
    """(conv_id, formatted, turns): what the strings alone say, as an array of (role, text, learned text)."""
    cut = F.filter(F.split("formatted", r"\Q" + OPEN + r"\E"), lambda p: p != "")
    outs = formatted.select("*", F.transform(cut, lambda p: F.concat(F.lit(OPEN), p)).alias("outs"))

    def turn(out: Column, i: Column) -> Column:
        inner = F.substr(out, F.lit(len(OPEN) + 1), F.length(out) - len(OPEN) - len(CLOSE) - 1)
        end = F.locate("\n", inner)
        run = F.get("mask", i)
        return F.struct(
            unescape_role(F.substr(inner, F.lit(1), end - 1)).alias("role"),
            unescape(F.substr(inner, end + 1, F.length(inner))).alias("text"),
            unescape(F.substr(out, run["loss_from"] + 1, run["loss_chars"])).alias("learned"),
        )

    return outs.select("conv_id", "formatted", F.transform("outs", turn).alias("turns"))


def digests(formatted: DataFrame) -> DataFrame:
    """Per conversation, read back from the output: turns, their hash, the learned text's length and hash."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learned = F.array_join("turns.learned", "")
    return parse(formatted).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length(learned).cast("long").alias("loss_chars"),
        F.sha2(learned.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
