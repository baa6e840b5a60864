"""Personal data in plain and in disguise, with offsets in the source text.

Plain identifiers are found by fixed patterns, leftmost and without overlap per kind. For the disguised ones a chain of
transducers rewrites a text while every character that comes out keeps the span of source characters it came from:

1. look-alike characters become the ASCII character they imitate, invisible ones vanish;
2. ``[at]``, ``(dot)`` and the like become ``@`` and ``.``; a bare ``name at host dot tld`` does so as a whole;
3. spelled digits next to another digit or sign (``plus``, ``dot``, ``dash``, numerals) become digits.

Separators in a run of spelled digits can be read in several ways, so each kind has readings in order (:data:`READINGS`), and a
later one adds only what overlaps no find of an earlier one. *Cut*: separators stay, commas and sentence points end a number.
*Grouped*: they do not where groups of spelled digits follow each other. *Joined*: spelled digits of one part of an address
stand together. *Whole*: a run of ``MIN_SPELLED`` spelled digits or more is one number, whatever separates it.

The same detectors then run over the rewritten text, and what they find is mapped back. A find is added only if it holds
a rewritten character and does not lie inside a plain find of its kind. Plain spans always stay as they are, so a disguised
one may overlap the plain fragment it completes.

Texts without a trigger (a look-alike, a bracketed word, a bare ``dot``, spelled digits) are not rewritten. All scans are
linear in the text, however long. Defined results: a null text is empty; every row gives one row, repeated ones
too; other columns are ignored, and :func:`redact` keeps them.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from decisionlake.llm.common import slices

# --- fixed values: kinds, and what the detectors accept -------------------------------------
KINDS = ["email", "ip", "card", "phone"]
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")

# --- fixed values: disguises ----------------------------------------------------------------
DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
SIGN_WORDS = {"plus": "+", "dot": ".", "point": ".", "punkt": ".", "punto": ".", "dash": "-", "hyphen": "-", "minus": "-"}
LOOKALIKES = {
    "а": "a", "А": "A", "В": "B", "с": "c", "С": "C", "ԁ": "d", "е": "e", "Е": "E", "һ": "h", "Н": "H", "і": "i", "І": "I", "ј": "j",
    "Ј": "J", "К": "K", "к": "k", "М": "M", "м": "m", "о": "o", "О": "O", "р": "p", "Р": "P", "ԛ": "q", "ѕ": "s", "Ѕ": "S", "Т": "T", "т": "t",
    "ѵ": "v", "ԝ": "w", "х": "x", "Х": "X", "у": "y", "У": "Y", "ё": "e", "α": "a", "Α": "A", "Β": "B", "ε": "e", "Ε": "E", "Η": "H",
    "ι": "i", "Ι": "I", "κ": "k", "Κ": "K", "Μ": "M", "ν": "v", "Ν": "N", "ο": "o", "Ο": "O", "ρ": "p", "Ρ": "P", "τ": "t", "Τ": "T",
    "υ": "u", "Υ": "Y", "χ": "x", "Χ": "X", "Ζ": "Z", "ı": "i", "ɑ": "a", "ɡ": "g", "ɩ": "i", "ʏ": "y",
    "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-", "․": ".", "。": ".", "·": ".", "﹒": ".", "﹫": "@",
}
INVISIBLE = "­​‌‍⁠﻿"
MIN_SPELLED = 4                                       # spelled digits that make a run one number in the last reading
READINGS = {"email": ["whole", "cut"], "ip": ["joined", "whole"], "card": ["cut", "grouped", "whole"], "phone": ["grouped", "cut", "whole"]}


@cache
def _lookalike(ch: str) -> str | None:
    """The ASCII character that ``ch`` imitates, the empty string if it is invisible, None if neither."""
    if ch in INVISIBLE:
        return ""
    if ch in LOOKALIKES:
        return LOOKALIKES[ch]
    if ord(ch) < 0x300:
        return None
    if (digit := unicodedata.decimal(ch, None)) is not None:
        return str(digit)
    plain = unicodedata.normalize("NFKC", ch)         # full-width and mathematical letters
    return plain if len(plain) == 1 and plain.isascii() and plain.isprintable() and plain != " " else None


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if i & 1:
            n = n * 2 - 9 * (n > 4)
        total += n
    return total % 10 == 0


def _emails(text: str):
    lo, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > lo and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            lo = found.end()
            yield "email", start, lo
        at = text.find("@", max(at + 1, lo))


def find_plain(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of every plain identifier, by start, then kind."""
    out = list(_emails(text))
    if DIGIT.search(text):
        if "." in text:
            out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 12 and 12 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and _luhn(d):
                out.append(("card", m.start(), m.end()))
        if "+" in text:
            out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(DIGIT.findall(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


# transducers ----------------------------------------------------------------------------------
_OPEN, _CLOSE = r"[\[({<]\s{0,3}", r"\s{0,3}[\])}>]"
_BRACKETED = re.compile(rf"[ \t]{{0,2}}{_OPEN}(?:([aA][tT]|@)|([dD][oO][tT]|[pP][oO][iI][nN][tT]|[pP][uU][nN][kKtT][oO]?|\.)){_CLOSE}[ \t]{{0,2}}")
_TRIGGER = re.compile(rf"{_OPEN}(?:[aA][tT]|@|[dD][oO][tT]|[pP][oO][iI][nN][tT]|[pP][uU][nN][kKtT][oO]?|\.){_CLOSE}")
_BARE = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?: [dD][oO][tT] [A-Za-z0-9._%+-]++)*+(?:( [aA][tT] )|@)[A-Za-z0-9-]++(?:(?: [dD][oO][tT] |\.)[A-Za-z0-9-]++)++")
_BARE_PART = re.compile(r" ([aA][tT]|[dD][oO][tT]) ")
_ITEM = "|".join(sorted([*DIGIT_WORDS, *SIGN_WORDS], key=len, reverse=True))
_RUN = re.compile(rf"(?<!\w)(?:(?:{_ITEM})(?!\w)|[0-9+])(?:[ ,.\-]{{0,3}}(?:(?<!\w)(?:{_ITEM})(?!\w)|[0-9+]))+", re.I)
_LETTER = re.compile(r"[^\W0-9_]")
_RUN_ITEM = re.compile(rf"(?:{_ITEM})|[0-9+]", re.I)
_SPLIT = str.maketrans({c: " " for c in "-,.()[]\n\t"})


class Traced:
    """A text in which every character knows the source characters it stands for."""

    def __init__(self, text: str):
        self.text, self.starts, self.ends, self.changed = text, range(len(text)), range(1, len(text) + 1), None

    def copy(self) -> Traced:
        out = Traced("")
        out.text, out.starts, out.ends, out.changed = self.text, self.starts, self.ends, self.changed
        return out

    def rewrite(self, edits: list[tuple[int, int, list[tuple[str, int, int]]]]) -> None:
        """Replaces [start, end) of the present text by characters that each cover a span of it."""
        if not edits:
            return
        text, starts, ends, changed = [], [], [], []
        old = self.changed or bytes(len(self.text))
        at, gone = 0, False                            # gone: what stood before the next character has vanished
        for a, z, chars in [*edits, (len(self.text), len(self.text), [])]:
            text.append(self.text[at:a])
            starts.extend(self.starts[at:a])
            ends.extend(self.ends[at:a])
            changed.append(b"\1" + old[at + 1:a] if gone and a > at else old[at:a])
            gone = not chars or gone and a == at
            for ch, i, j in chars:
                text.append(ch)
                starts.append(self.starts[i])
                ends.append(self.ends[j - 1])
                changed.append(b"\1")
            at = z
        self.text, self.starts, self.ends, self.changed = "".join(text), starts, ends, b"".join(changed)


def _show_characters(t: Traced) -> None:
    edits = []
    for i, ch in enumerate(t.text):
        if not ch.isascii() and (plain := _lookalike(ch)) is not None:
            edits.append((i, i + 1, [(plain, i, i + 1)] if plain else []))
    t.rewrite(edits)


def _show_brackets(t: Traced) -> None:
    t.rewrite([(m.start(), m.end(), [("@" if m[1] else ".", m.start(), m.end())]) for m in _BRACKETED.finditer(t.text)])


def _show_bare(t: Traced) -> None:
    edits = []
    for m in _BARE.finditer(t.text):
        if " dot " in m[0].lower():                    # ``name at host.tld`` alone is ordinary prose
            edits += [(m.start() + p.start(), m.start() + p.end(), [("@" if p[1].lower() == "at" else ".", m.start() + p.start(), m.start() + p.end())])
                      for p in _BARE_PART.finditer(m[0])]
    t.rewrite(edits)


def _runs(text: str) -> list[tuple[int, int, list[tuple[str, int, int]]]]:
    """(start, end, items) of every run of digits and signs that holds a spelled digit."""
    out = []
    for m in _RUN.finditer(text):
        if _LETTER.search(m[0]):
            items = [(p[0].lower(), m.start() + p.start(), m.start() + p.end()) for p in _RUN_ITEM.finditer(m[0])]
            if any(w in DIGIT_WORDS for w, _, _ in items):
                out.append((m.start(), m.end(), items))
    return out


def _grouped(items: list[tuple[str, int, int]], breaks: list[int]) -> set[int]:
    """The breaks of a run that only set off groups of spelled digits: not those before a numeral or a last lone digit."""
    edges = [0, *[k + 1 for k in breaks], len(items)]
    size = [z - a for a, z in zip(edges[:-1], edges[1:], strict=True)]
    return {k for n, k in enumerate(breaks) if items[k][0] in DIGIT_WORDS and items[k + 1][0] in DIGIT_WORDS and (size[n + 1] > 1 or size[n] == 1)}


def _gap(gap: str, at: int, left: str, right: str, joined: bool) -> list[tuple[str, int, int]]:
    """What stands between two items of a run that no break parts."""
    spelled = (left in DIGIT_WORDS) + (right in DIGIT_WORDS)
    if not gap or left in SIGN_WORDS or right in SIGN_WORDS or left == "+" and spelled:
        return []
    if not spelled or gap == ".":
        return [(ch, at + i, at + i + 1) for i, ch in enumerate(gap)]
    if joined and spelled == 2:
        return []
    return [("-" if "-" in gap else " ", at, at + len(gap))]


def _show_digits(t: Traced, runs: list, reading: str) -> None:
    edits = []
    for start, end, items in runs:
        chars = [(DIGIT_WORDS.get(w) or SIGN_WORDS.get(w) or w, a, z) for w, a, z in items]
        if reading == "whole":
            if sum(w in DIGIT_WORDS for w, _, _ in items) >= MIN_SPELLED:
                edits.append((start, end, chars))
            continue
        gaps = [t.text[z:a] for (_, _, z), (_, a, _) in zip(items[:-1], items[1:], strict=True)]
        breaks = [k for k, gap in enumerate(gaps) if "," in gap or "." in gap and len(gap) > 1]
        open_breaks = _grouped(items, breaks) if reading == "grouped" else ()
        closed = set(breaks).difference(open_breaks)
        shown = chars[:1]
        for k, gap in enumerate(gaps):
            at = items[k][2]
            if k in closed:
                shown.append(("\n", at, at + len(gap)))
            elif k in open_breaks:
                shown.append((" ", at, at + len(gap)))
            else:
                shown += _gap(gap, at, items[k][0], items[k + 1][0], reading == "joined")
            shown.append(chars[k + 1])
        edits.append((start, end, shown))
    t.rewrite(edits)


def _has_lookalike(text: str) -> bool:
    if text.isascii():
        return False
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return True
    return "­" in text or "·" in text


def _mapped(t: Traced) -> list[tuple[str, int, int]]:
    """The source spans of what the detectors find at rewritten characters."""
    if t.changed is None:
        return []
    return [(kind, t.starts[a], t.ends[z - 1]) for kind, a, z in find_plain(t.text) if 1 in t.changed[a:z]]


def find_disguised(text: str, plain: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """What only the rewritten text shows, as source spans."""
    odd = _has_lookalike(text)
    t = Traced(text)
    if odd:
        _show_characters(t)
    low = t.text.lower()
    if _TRIGGER.search(t.text):
        _show_brackets(t)
    if " dot " in low:
        _show_bare(t)
    runs = [] if DIGIT_WORDS.keys().isdisjoint(low.translate(_SPLIT).split(" ")) else _runs(t.text)
    if not runs:
        found = _mapped(t)
    else:
        by_reading = {}
        for name in ("cut", "grouped", "joined", "whole"):
            shown = t.copy()
            _show_digits(shown, runs, name)
            same = next((r for r in by_reading.values() if r[0] == shown.text), None)
            by_reading[name] = same or (shown.text, _mapped(shown))
        found = []
        for kind, names in READINGS.items():
            own = []
            for name in names:
                own += [(k, a, z) for k, a, z in by_reading[name][1] if k == kind and not any(s < z and a < e for _, s, e in own)]
            found += own
    return [(kind, a, z) for kind, a, z in found if not any(k == kind and s <= a and z <= e for k, s, e in plain)]


def find(text: str | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Plain spans, and all spans, each by start, then kind."""
    text = text or ""
    plain = find_plain(text)
    more = find_disguised(text, plain)
    return plain, sorted(plain + more, key=lambda s: (s[1], KINDS.index(s[0]))) if more else plain


def replace(text: str, spans: list[tuple[str, int, int]]) -> str:
    """Puts ``<KIND>`` in the place of each span; spans that overlap are replaced together, by the first one's kind."""
    out, at = [], 0
    for kind, a, z in spans:
        if a >= at:
            out.append(text[at:a])
            out.append(f"<{kind.upper()}>")
        at = max(at, z)
    out.append(text[at:])
    return "".join(out)


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join([f"{k}:{a}:{z}" for k, a, z in spans])


def find_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, plain, spans) of every row of ``docs`` (doc_id, text): lists of (kind, start, end)."""
    def run(batches):
        import pyarrow as pa
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        as_rows = lambda spans: [{"kind": k, "start": a, "end": z} for k, a, z in spans]
        for b in slices(batches):
            found = [find(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([as_rows(p) for p, _ in found], kind), pa.array([as_rows(s) for _, s in found], kind)],
                ["doc_id", "plain", "spans"])

    rows = docs.select("doc_id", "text")
    spans = "array<struct<kind:string,start:int,end:int>>"
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, plain {spans}, spans {spans}")


def span_digest(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, n_disguised, base_sha256, spans): counts are of plain spans."""
    def run(batches):
        import pyarrow as pa
        for b in slices(batches):
            found = [find(t) for t in b.column("text").to_pylist()]
            counts = [pa.array([sum(s[0] == k for s in p) for p, _ in found], pa.int64()) for k in KINDS]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *counts, pa.array([len(s) - len(p) for p, s in found], pa.int64()),
                 pa.array([hashlib.sha256(joined(p).encode()).hexdigest() for p, _ in found], pa.string()),
                 pa.array([joined(s) for _, s in found], pa.string())],
                ["doc_id", *[f"n_{k}" for k in KINDS], "n_disguised", "base_sha256", "spans"])

    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_email bigint, n_ip bigint, "
                                "n_card bigint, n_phone bigint, n_disguised bigint, base_sha256 string, spans string")


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind; all other columns stay, and null texts stay null."""
    at = docs.columns.index("text")

    def run(batches):
        import pyarrow as pa
        for b in slices(batches):
            texts = [t if t is None else replace(t, find(t)[1]) for t in b.column(at).to_pylist()]
            columns = [pa.array(texts, pa.string()) if i == at else b.column(i) for i in range(b.num_columns)]
            yield pa.RecordBatch.from_arrays(columns, names=b.schema.names)

    return docs.mapInArrow(run, docs.schema)


def redacted_counts(redacted: DataFrame) -> DataFrame:
    """How many spans of each kind a redacted table holds, for reports."""
    return redacted.select(*[F.regexp_count("text", F.lit(f"<{k.upper()}>")).alias(k) for k in KINDS]).agg(
        *[F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in KINDS])
