import random
from collections import Counter
from datetime import date, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomgrid.llm import pii

F1 = pii.Feistel(b"one key")


@pytest.mark.parametrize("size", [1, 2, 3, 10, 97, 1000])
def test_feistel_is_a_permutation(size):
    image = [F1.permute(x, size, "t") for x in range(size)]
    assert sorted(image) == list(range(size))
    assert [F1.permute(y, size, "t", back=True) for y in image] == list(range(size))


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 10**14 - 1), st.sampled_from("3456"))
def test_cards_stay_valid_and_come_back(middle, first):
    body = f"{first}{middle:014d}"
    number = body + str(-pii.luhn(body + "0") % 10)
    if len(set(number)) == 1:
        return
    new = pii.rewrite(number, F1)[0]
    assert len(new) == 16 and new[0] == first and pii.luhn(new) % 10 == 0
    assert pii.rewrite(new, F1, back=True)[0] == number


@pytest.mark.parametrize(
    ("kind", "value"),
    [
        ("card", "4111 1111 1111 1111"), ("card", "4111-1111-1111-1111"), ("ssn", "123-45-6789"), ("phone", "+1 (310) 555-4510"), ("phone", "(212) 555-0100"), ("phone", "212-555-0100"),
        ("ipv4", "233.171.25.2"), ("iban", "DE89 3704 0044 0532 0130 00"), ("date", "2024-02-29"), ("date", "12/31/1999"), ("date", "31.12.1999"),
        ("email", "hein.19@mail5.example.com"), ("secret", "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"),
    ],
)
def test_values_keep_their_form(kind, value):
    text = f"see {value}, and {value}."
    new, found = pii.rewrite(text, F1)
    assert [k for k, _, _ in found] == [kind, kind] and [text[s : s + n] for _, s, n in found] == [value, value]
    first, second = new[4:-1].split(", and ")
    assert first == second != value
    assert pii.rewrite(new, F1, back=True)[0] == text
    assert pii.rewrite(text, pii.Feistel(b"other key"))[0] != new
    if kind != "ipv4":
        shape = lambda s: "".join("9" if c.isdigit() else "a" if c.islower() else c for c in s)
        assert len(first) == len(value) and (kind == "secret" or shape(first) == shape(value))


def test_spellings_stay_linked():
    digits = lambda s: pii.only_digits(pii.rewrite(s, F1)[0])
    assert digits("4111 1111 1111 1111") == digits("4111111111111111") == digits("4111-1111-1111-1111")
    day = lambda s: sorted(pii.rewrite(s, F1)[0].replace("/", "-").replace(".", "-").split("-"))
    assert day("1999-12-31") == day("12/31/1999") == day("31.12.1999")


@pytest.mark.parametrize("text", ["4111111111111112", "9870157079875996", "256.1.1.1", "1.2.3.4.5", "Version 2.0.", "2023-02-30", "000-12-3456", "12345", "a@b", "price 19.99 on 3 items", "DE88 3704 0044 0532 0130 00", "", "no digits at all", "01.02.3.4"])
def test_look_alikes_stay(text):
    assert pii.rewrite(text, F1) == (text, [])


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="0123456789.-/ @abz+()", max_size=60))
def test_any_text_is_rewritten_without_loss_around_values(text):
    new, found = pii.rewrite(text, F1)
    assert all(b >= a + n for (_, a, n), (_, b, _) in zip(found, found[1:]))
    if not found:
        assert new == text


def test_documents(spark, documents, no_documents, clashing):
    out = pii.pseudonymise(documents, b"k").collect()
    assert Counter((r.doc_id, r.text) for r in out) == Counter((r.doc_id, r.text) for r in documents.collect()) and all(r.n_found == 0 for r in out)
    assert pii.pseudonymise(no_documents, b"k").count() == 0 and pii.pseudonymise(clashing, b"k").count() == clashing.count()
    long = "x " * 500_000 + "mail me: a.b@example.org"
    row = pii.pseudonymise(spark.createDataFrame([(1, long)], "doc_id long, text string"), b"k").first()
    assert row.n_found == 1 and len(row.text) == len(long) and row.text != long and row.found[0].kind == "email"


@pytest.mark.parametrize(
    ("kind", "value", "after"),
    [
        ("card", "4111111111111111", " 123"), ("card", "4111 1111 1111 1111", " 12/27"), ("card", "4111111111111111", " 30 days"), ("card", "4111-1111-1111-1111", " 737"),
        ("card", "4111 1111 1111 1111", " 1 2 3"), ("iban", "ES91 2100 0418 4502 0005 1332", " PAID"), ("iban", "DE89370400440532013000", " PAID NOW"), ("iban", "DE89 3704 0044 0532 0130 00", " EUR"),
    ],
)
def test_values_before_numbers_and_capital_words(kind, value, after):
    text = f"see {value}{after}."
    new, found = pii.rewrite(text, F1)
    assert (kind, 4, len(value)) in found and value not in new and new.endswith(f"{after}.")
    assert pii.rewrite(new, F1, back=True)[0] == text
    assert new[4 : 4 + len(value)] == pii.rewrite(value, F1)[0]


def test_cards_before_numbers_come_back():
    for i in range(300):
        body = f"4{i * 7_919_193_131:014d}"
        text = f"{body}{-pii.luhn(body + '0') % 10} {i % 1000:03d}"
        new = pii.rewrite(text, F1)[0]
        assert new[:16] != text[:16] and pii.rewrite(new, F1, back=True)[0] == text


def test_secrets_in_capitals_stay_linked():
    low = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"
    new, found = pii.rewrite(f'TOKEN = "{low.upper()}"', F1)
    assert found == [("secret", 9, 40)] and new[9:49] == pii.rewrite(low, F1)[0].upper()
    assert pii.rewrite(new, F1, back=True)[0] == f'TOKEN = "{low.upper()}"'


def spellings(of):
    """Every way to write a date that the rules read back as that date."""
    for m, d in {(f"{of.month:02d}", f"{of.day:02d}"), (str(of.month), str(of.day)), (f"{of.month:02d}", str(of.day)), (str(of.month), f"{of.day:02d}")}:
        yield "us", f"{m}/{d}/{of.year}"
        yield "dots", f"{d}.{m}.{of.year}"
        if of.day > 12:
            yield "eu", f"{d}/{m}/{of.year}"
    yield "iso", of.isoformat()


def test_dates_are_permuted_in_every_spelling():
    days, image = [date(1900, 1, 1) + timedelta(i) for i in range(73_049)], {}
    assert days[-1] == date(2099, 12, 31)
    for of in days:
        new = date.fromisoformat(pii.day(F1, of.isoformat(), False))
        image[of] = new
        assert pii.day(F1, new.isoformat(), True) == of.isoformat()
    assert set(image.values()) == set(days)
    for of in [*days[::37], date(1900, 1, 1), date(1947, 12, 13), date(2008, 3, 15), date(2000, 12, 12), date(2000, 2, 29)]:
        for kind, text in spellings(of):
            new = pii.day(F1, text, False)
            assert (kind, new) in set(spellings(image[of])) and [len(p) for p in new.replace("/", ".").split(".")] == [len(p) for p in text.replace("/", ".").split(".")]
            assert pii.day(F1, new, True) == text


def test_dates_out_of_range_and_impossible_ones_stay():
    for text in ("1899-12-31", "2100-01-01", "13/13/2000", "31/04/2000", "30.02.2001", "00/10/2000", "0.1.2000"):
        assert pii.rewrite(text, F1) == (text, [])


def valid_card(rng):
    """A number whose check digit is found by trying all ten, with the sum written out in full."""
    head = [rng.choice("3456")] + [rng.choice("0123456789") for _ in range(rng.choice((12, 14, 14, 17)))]
    for last in "0123456789":
        digits = [int(c) for c in [*head, last]]
        doubled = [2 * c for c in digits[-2::-2]]
        if (sum(digits[-1::-2]) + sum(c // 10 + c % 10 for c in doubled)) % 10 == 0:
            return "".join(head) + last


def value_of(rng, kind):
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    if kind == "card":
        number = valid_card(rng)
        return rng.choice((number, "-".join(number[i : i + 4] for i in range(0, len(number), 4)))) if len(number) % 4 == 0 else number
    if kind == "iban":
        body = digits(18)
        return next(t for t in (f"DE{c:02d}{body}" for c in range(2, 99)) if int(t[4:] + "1314" + t[2:4]) % 97 == 1)
    if kind == "ssn":
        return f"{rng.choice((1, 123, 665, 667, 899)):03d}-{rng.randint(1, 99):02d}-{rng.randint(1, 9999):04d}"
    if kind == "phone":
        return rng.choice(("({}) {}-{}", "{}-{}-{}", "+1 ({}) {}-{}", "{} {} {}")).format(digits(3), digits(3), digits(4))
    if kind == "ipv4":
        return ".".join(str(rng.randint(0, 255)) for _ in range(4))
    if kind == "date":
        return rng.choice(list(spellings(date(1900, 1, 1) + timedelta(rng.randrange(73_049)))))[1]
    if kind == "email":
        return f"{rng.choice(('ann', 'J.Doe', 'x9_y'))}{rng.randrange(99)}@{rng.choice(('mail', 'a-b.c'))}.org"
    return "".join(rng.choice("0123456789abcdef") for _ in range(39)) + "a"


def look_alike(rng, kind):
    value = value_of(rng, kind)
    if kind == "card":
        return value[:-1] + str((int(value[-1]) + 1) % 10)
    if kind == "iban":
        return value[:2] + f"{(int(value[2:4]) + 1) % 100:02d}" + value[4:]
    return {"ssn": f"{rng.choice((0, 666, 900)):03d}-12-3456", "phone": "555-01", "ipv4": f"{value}.7", "date": "2023-02-30", "email": "ann@home", "secret": value + "0"}[kind]


def test_planted_values_are_found_and_nothing_else():
    rng = random.Random(8)
    kinds = [k for k, _, _ in pii.KINDS]
    for _ in range(1500):
        text, want = "", []
        for _ in range(rng.randrange(1, 6)):
            text += rng.choice(("see ", "note: ", "é, ", "von ", "\n"))
            kind = rng.choice(kinds)
            if rng.random() < 0.6:
                value = value_of(rng, kind)
                want.append((kind, len(text), len(value)))
            else:
                value = look_alike(rng, kind)
            text += value + rng.choice((" or ", ", ", "; ", ".\n"))
        new, found = pii.rewrite(text, F1)
        assert found == want, text
        assert pii.rewrite(new, F1, back=True)[0] == text
