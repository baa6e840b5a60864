import random
import re

import pytest

from decisionlake.llm import pii
from tests.llm.conftest import EDGES

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def plain(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 12 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits(m)) <= 15]
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def test_plain_spans_are_the_patterns(sample):
    random.seed(2)
    parts = ["a", "@", ".", "1", "25", "300", " ", "-", "+", "(", ")", "b.c", "x@y.z", "0", "\n", "é", "4111111111111111", "٣", "%"]
    texts = [t or "" for _, t in sample] + ["".join(random.choices(parts, k=random.randint(0, 25))) for _ in range(5000)]
    for t in texts:
        base, spans = pii.find(t)
        assert base == plain(t) and set(base) <= set(spans)


@pytest.mark.parametrize("text, kind, found", [
    ("mail john.doe [at] example [dot] com now", "email", "john.doe [at] example [dot] com"),
    ("to mary dot s at mail dot example dot org", "email", "mary dot s at mail dot example dot org"),
    ("jоhn@еxample.com", "email", "jоhn@еxample.com"),
    ("see foo＠bar．com", "email", "foo＠bar．com"),
    ("call plus four nine one five one two three four five six seven eight", "phone", "plus four nine one five one two three four five six seven eight"),
    ("card four one one one 1111 one one one one one one one one ok", "card", "four one one one 1111 one one one one one one one one"),
    ("at one nine two dot one six eight dot one dot one two", "ip", "one nine two dot one six eight dot one dot one two"),
    ("４１１１ １１１１ １１１１ １１１１", "card", "４１１１ １１１１ １１１１ １１１１"),
    ("4111​1111​1111​1111", "card", "4111​1111​1111​1111"),
])
def test_disguises_map_back(text, kind, found):
    base, spans = pii.find(text)
    assert (kind, found) in [(k, text[a:z]) for k, a, z in spans if (k, a, z) not in base]


@pytest.mark.parametrize("text, kind, found, redacted", [
    ("to jоhn@example.com now", "email", "jоhn@example.com", "to <EMAIL> now"),
    ("to j@mail.exаmple.com now", "email", "j@mail.exаmple.com", "to <EMAIL> now"),
    ("to j@ma​il.example.com now", "email", "j@ma​il.example.com", "to <EMAIL> now"),
    ("call +49 151 2345678９ now", "phone", "+49 151 2345678９", "call <PHONE> now"),
    ("at 10.0.0.1２ now", "ip", "10.0.0.1２", "at <IP> now"),
])
def test_disguises_around_a_plain_fragment(text, kind, found, redacted):
    base, spans = pii.find(text)
    assert (kind, found) in [(k, text[a:z]) for k, a, z in spans] and set(base) <= set(spans)
    assert pii.replace(text, spans) == redacted


CARD_WORDS = "four" + " one" * 15
PHONE_WORDS = "plus four nine one five one two three four five six seven eight"


@pytest.mark.parametrize("text, kind, found", [
    (f"card {CARD_WORDS}, 12/27", "card", CARD_WORDS),
    (f"card {CARD_WORDS}. 2 items", "card", CARD_WORDS),
    (f"card {CARD_WORDS}, two items", "card", CARD_WORDS),
    (f"call {PHONE_WORDS}, 24 hours", "phone", PHONE_WORDS),
    (f"call {PHONE_WORDS}, 24/7/365", "phone", PHONE_WORDS),
    ("call +49 151 two three four 5678", "phone", "+49 151 two three four 5678"),
    ("call +49 151 234 five 678.", "phone", "+49 151 234 five 678"),
    ("at 192 dot 168 dot one dot 12", "ip", "192 dot 168 dot one dot 12"),
    ("four one one one, one one one one, one one one one, one one one one", "card", "four one one one, one one one one, one one one one, one one one one"),
    ("plus four nine, one five one, two three four, five six seven eight", "phone", "plus four nine, one five one, two three four, five six seven eight"),
    ("john one two three four [at] gmail.com", "email", "one two three four [at] gmail.com"),
])
def test_spelled_digits_end_at_their_neighbours(text, kind, found):
    assert [(k, text[a:z]) for k, a, z in pii.find(text)[1]] == [(kind, found)]


@pytest.mark.parametrize("text", ["two 10.0.0.1 hosts", "one two@x.com", "one.two@x.com", "one, 4111111111111111", "at ten, one, 2 or three"])
def test_spelled_digits_beside_a_plain_find_change_nothing(text):
    base, spans = pii.find(text)
    assert base == spans


def test_rewritten_characters_beside_a_plain_find_change_nothing():
    text = "see a@b.com, о 10.0.0.1 ＋ x"
    assert pii.find(text)[0] == pii.find(text)[1]


@pytest.mark.parametrize("text", ["he looked at the dot", "I work at example.com", "one two three", "a [at] b", "Привет, как дела", "un deux trois soleil", ""])
def test_clean_texts_stay_clean(text):
    assert pii.find(text) == ([], [])


@pytest.mark.parametrize("text", ["1" * 100000, "a@" * 50000, "+1 " * 40000, "a" * 100000 + "@", "one " * 30000, "[at" * 30000, "1." * 50000])
def test_long_runs_are_linear(text):
    pii.find(text)


def test_tables(spark, edges, no_rows):
    rows = pii.span_digest(edges).collect()
    assert len(rows) == len(EDGES) and all(r.n_email == 0 and r.spans == "" for r in rows)
    docs = spark.createDataFrame([(1, "x a@b.co 4111111111111111", "k"), (2, None, None)], "doc_id long, text string, spans string")
    assert pii.redact(docs).orderBy("doc_id").collect() == [(1, "x <EMAIL> <CARD>", "k"), (2, None, None)]
    assert pii.find_spans(docs).where("doc_id = 1").first().spans[0].asDict() == {"kind": "email", "start": 2, "end": 8}
    assert pii.span_digest(no_rows).collect() == [] and pii.redact(no_rows).columns == no_rows.columns
    assert pii.redacted_counts(pii.redact(docs)).first().asDict() == {"email": 1, "ip": 0, "card": 1, "phone": 0}
