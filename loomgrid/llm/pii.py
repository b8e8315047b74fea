"""PII: format-preserving Feistel pseudonyms.

Values are found by pattern and validated (Luhn digits, IBAN remainders, octets, calendar dates ..), so look-alikes stay
as they are. The canonical value is permuted by a keyed Feistel network within its own format: a card stays a valid
card of the same length and first digit, a date a calendar date, an address an address, with the separators of the
text. The permutation depends on the key, the kind and the format alone, so equal values become equal pseudonyms in
every document and spelling, different ones stay different, and who has the key can restore them.

Defined cases: null text stays null with nothing found; empty text stays empty; overlapping finds: the first one, and of
those at one place the first kind of ``KINDS``; a date of slashes is month/day/year unless its first number is above 12;
dates before 1900 and after 2099 stay; very long texts are searched whole; where the longest card or IBAN isn't valid, the longest valid beginning of it
that ends before a separator; repeated rows are each rewritten; columns of the input are not needed
but doc_id and text.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from datetime import date, timedelta
from functools import lru_cache
from math import isqrt

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgrid.llm.shared import small_batches

ROUNDS = 8
FIRST_DAY, LAST_DAY = date(1900, 1, 1), date(2099, 12, 31)
DAYS = (LAST_DAY - FIRST_DAY).days + 1
DIGITS, LOWER, UPPER, HEX = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdef"


class Feistel:
    """Keyed permutations of 0..size-1: alternating modular rounds on two halves, walked until within the size."""

    def __init__(self, key: bytes) -> None:
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _mix(self, tweak: str, i: int, half: int, modulus: int) -> int:
        data = f"{tweak}|{i}|{half}|{modulus}".encode()
        return int.from_bytes(hashlib.blake2b(data, key=self.key, digest_size=32).digest()) % modulus

    def permute(self, x: int, size: int, tweak: str, back: bool = False) -> int:
        if size < 2:
            return x
        a = isqrt(size - 1) + 1
        b = -(-size // a)
        tweak = f"{tweak}|{size}"
        while True:
            left, right = divmod(x, b)
            for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
                sign = -1 if back else 1
                if i % 2:
                    right = (right + sign * self._mix(tweak, i, left, b)) % b
                else:
                    left = (left + sign * self._mix(tweak, i, right, a)) % a
            x = left * b + right
            if x < size:
                return x

    def text(self, value: str, alphabets: list[str], tweak: str, back: bool = False) -> str:
        """Each character stays in its alphabet."""
        x, size = 0, 1
        for c, alphabet in zip(value, alphabets):
            x, size = x * len(alphabet) + alphabet.index(c), size * len(alphabet)
        x, out = self.permute(x, size, tweak, back), []
        for alphabet in reversed(alphabets):
            x, i = divmod(x, len(alphabet))
            out.append(alphabet[i])
        return "".join(reversed(out))


def luhn(digits: str) -> int:
    """Sum of the digits with every second one from the right doubled; valid numbers give a multiple of ten."""
    return sum(int(c) if i % 2 == 0 else (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(c)] for i, c in enumerate(reversed(digits)))


def iban_number(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4]))


def refill(shape: str, digits: str) -> str:
    """The shape with its digits replaced, everything else kept."""
    it = iter(digits)
    return re.sub(r"[0-9]", lambda _: next(it), shape)


def only_digits(text: str) -> str:
    return re.sub(r"[^0-9]", "", text)


def card(f: Feistel, text: str, back: bool) -> str | None:
    digits = only_digits(text)
    if not 13 <= len(digits) <= 19 or digits[0] not in "23456" or luhn(digits) % 10 or len(set(digits)) == 1:
        return None
    while True:
        inner = digits[0] + f.text(digits[1:-1], [DIGITS] * (len(digits) - 2), f"card {digits[0]}", back)
        digits = inner + str(-luhn(inner + "0") % 10)
        if len(set(digits)) > 1:  # on, until it is one that this rule accepts
            return refill(text, digits)


def iban(f: Feistel, text: str, back: bool) -> str | None:
    plain = text.replace(" ", "")
    check = lambda body: f"{98 - iban_number(plain[:2] + '00' + body) % 97:02d}"
    if not 15 <= len(plain) <= 34 or plain[2:4] != check(plain[4:]):
        return None
    body = f.text(plain[4:], [DIGITS if c in DIGITS else UPPER for c in plain[4:]], f"iban {plain[:2]} " + re.sub(r"[0-9]", "9", re.sub(r"[A-Z]", "A", plain[4:])), back)
    it = iter(plain[:2] + check(body) + body)
    return "".join(c if c == " " else next(it) for c in text)


def national(f: Feistel, text: str, back: bool) -> str | None:
    """A US social security number: areas 001-899 but 666, groups 01-99, serials 0001-9999."""
    area, group, serial = (int(x) for x in text.split("-"))
    if area in (0, 666) or area > 899 or not group or not serial:
        return None
    x = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
    x, serial = divmod(f.permute(x, 898 * 99 * 9999, "ssn", back), 9999)
    area, group = divmod(x, 99)
    return f"{area + 1 + (area >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"


def phone(f: Feistel, text: str, back: bool) -> str | None:
    """Country code kept; the other ten digits are permuted."""
    digits = only_digits(text)
    return refill(text, digits[:-10] + f.text(digits[-10:], [DIGITS] * 10, f"phone {digits[:-10].lstrip('0')}", back))


def address(f: Feistel, text: str, back: bool) -> str | None:
    parts = text.split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    x = f.permute(int.from_bytes(bytes(map(int, parts))), 1 << 32, "ipv4", back)
    return ".".join(map(str, x.to_bytes(4)))


def day_shape(of: date) -> tuple[bool, int]:
    """What a spelling of the date shows: months of one digit or two, days of one digit, of two that could be a month, or more."""
    return of.month > 9, (of.day > 9) + (of.day > 12)


@lru_cache(maxsize=None)
def days_of(shape: tuple[bool, int]) -> list[int]:
    """The days since ``FIRST_DAY`` of that shape, ascending."""
    return [i for i in range(DAYS) if day_shape(FIRST_DAY + timedelta(i)) == shape]


def day(f: Feistel, text: str, back: bool) -> str | None:
    """year-month-day, day.month.year, month/day/year, or day/month/year where the first number can't be a month.

    Dates are permuted among those of the same shape, so one date has one pseudonym in all spellings, and the pseudonym is
    spelled and read in the same way.
    """
    sep = re.search(r"[-./]", text)[0]
    spelled = text.split(sep)
    parts = [int(x) for x in spelled]
    y, m, d = (0, 1, 2) if len(spelled[0]) == 4 else (2, 1, 0) if sep == "." or parts[0] > 12 else (2, 0, 1)
    try:
        known = date(parts[y], parts[m], parts[d])
    except ValueError:
        return None
    if not FIRST_DAY <= known <= LAST_DAY:
        return None
    shape = day_shape(known)
    among = days_of(shape)
    at = f.permute(bisect_left(among, (known - FIRST_DAY).days), len(among), f"date {shape}", back)
    new = FIRST_DAY + timedelta(among[at])
    values = {y: new.year, m: new.month, d: new.day}
    return sep.join(str(values[i]).zfill(len(spelled[i])) for i in range(3))


def email(f: Feistel, text: str, back: bool) -> str | None:
    """The local part's letters and digits, each within its kind; the domain stays."""
    local, domain = text.rsplit("@", 1)
    kinds = [next((a for a in (DIGITS, LOWER, UPPER) if c in a), c) for c in local]
    shape = "".join("9" if a is DIGITS else "a" if a is LOWER else "A" if a is UPPER else a for a in kinds)
    return f.text(local, kinds, f"email {shape}@{domain.lower()}", back) + "@" + domain


def secret(f: Feistel, text: str, back: bool) -> str | None:
    """In capitals or not, as found; both spellings are permuted alike."""
    new = f.text(text.lower(), [HEX] * len(text), "secret", back)
    return new if text == text.lower() else new.upper()


#: Kind, pattern (the value is the group of that name) and the rule that validates and permutes it.
KINDS = (
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", iban),
    ("card", r"(?<![0-9A-Za-z.])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z])", card),
    ("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", national),
    ("phone", r"(?<![0-9+.])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])", phone),
    ("ipv4", r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])", address),
    ("date", r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4})(?![0-9]|[./-][0-9])", day),
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,24}(?![A-Za-z0-9])", email),
    ("secret", r"(?<![0-9a-f])[0-9a-f]{40}(?![0-9a-f])|(?<![0-9A-Fa-f])[0-9A-F]{40}(?![0-9A-Fa-f])", secret),
)
WORTH = re.compile(r"[0-9@]")
ANY = re.compile("|".join(f"(?P<{kind}>{pattern})" for kind, pattern, _ in KINDS))
RULES = {kind: rule for kind, _, rule in KINDS}
EACH = {kind: re.compile(pattern) for kind, pattern, _ in KINDS}


def shorter(kind: str, value: str) -> list[str]:
    """The beginnings of a card or IBAN that end before a separator, longest first: what follows may be another number or word."""
    if kind not in ("card", "iban"):
        return []
    return [value[: m.start()] for m in reversed(list(re.finditer(r"[ -]", value)))]


def rewrite(text: str, feistel: Feistel, back: bool = False) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with pseudonyms, and (kind, start, length) of each value in the given text."""
    if not WORTH.search(text):
        return text, []
    out, found, at, last = [], [], 0, 0
    while m := ANY.search(text, at):
        kind, new, end = m.lastgroup, None, m.end()
        for kind in [m.lastgroup, *[k for k in RULES if k != m.lastgroup]]:
            if own := EACH[kind].match(text, m.start()):
                values = [own[0], *shorter(kind, own[0])]
                for i, value in enumerate(values):
                    if (new := RULES[kind](feistel, value, back)) is not None:
                        # On, until no longer beginning of the new text is valid: the way back then finds the same end.
                        while any(RULES[kind](feistel, new + longer[len(value) :], back) is not None for longer in values[:i]):
                            new = RULES[kind](feistel, new, back)
                        end = m.start() + len(value)
                        break
            if new is not None:
                break
        if new is None:
            at = m.start() + 1
            while at < len(text) and text[at - 1].isalnum() and text[at].isalnum():  # past the look-alike's run
                at += 1
            continue
        out += [text[last : m.start()], new]
        found.append((kind, m.start(), end - m.start()))
        at = last = end
    return "".join([*out, text[last:]]), found


def pseudonym_column(key: bytes, text: str = "text", back: bool = False) -> Column:
    """(text, found): the whole text rewritten, and where values stood."""

    @F.pandas_udf("text string, found array<struct<kind: string, start: int, length: int>>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        feistel = Feistel(key)
        for part in parts:
            done = [(None, []) if t is None else rewrite(t, feistel, back) for t in part.tolist()]
            yield pd.DataFrame({"text": [t for t, _ in done], "found": [[{"kind": k, "start": s, "length": n} for k, s, n in f] for _, f in done]})

    return run(F.col(text))


def pseudonymise(docs: DataFrame, key: bytes) -> DataFrame:
    """(doc_id, text, found, n_found) of every document."""
    out = small_batches(docs).select("doc_id", pseudonym_column(key).alias("_p"))
    return out.select("doc_id", "_p.text", "_p.found", F.size("_p.found").alias("n_found"))
