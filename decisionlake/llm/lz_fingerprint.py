"""Document fingerprints from Lempel-Ziv phrases.

A text is parsed into dictionary phrases (LZ78: each phrase is the longest known one and one more character). Texts that
compress each other well share phrases, so the Jaccard likeness of two phrase sets stands for compression-like
similarity. A fingerprint is the ``SIZE`` smallest phrase hashes, ascending, as hexadecimal digits; the likeness of two
fingerprints is the share of common hashes among the ``SIZE`` smallest of their union.

Comparing each document with the one after it needs the table in order of ``doc_id``. Documents go to ranges of
``doc_id`` whose bounds are ids of the table, so the first document of each range is known beforehand and is sent to the
range before it as well. That is one shuffle of the texts; ranges are sorted and streamed, so memory is a block of
rows, whatever the range's size.

Defined results: a null text is empty; an empty text has an empty fingerprint, like another empty one (1.0) and
unlike any other (0.0); rows without ``doc_id`` come first; equal ids follow in order of their texts; a table of one row
is its own next document; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from decisionlake.llm.common import slices

SIZE = 128                                # hashes in a fingerprint
MAX_RANGES = 10_000                       # bounds that the driver holds; a range is streamed, so it may be large


@cache
def _powers(bits: int):
    """Powers of the hash's base and of its inverse, for texts below 2**bits characters."""
    import numpy as np
    base = 0x9E3779B97F4A7C15 | 1
    inverse = pow(base, -1, 1 << 64)
    out = []
    for b in (base, inverse):
        p = np.full(1 << bits, b, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out


def _mix(x):
    import numpy as np
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class Parse:
    """An LZ78 parse that can be continued: known phrases, the open phrase, and where phrases ended."""

    def __init__(self, text: str = ""):
        self.known, self.open, self.ends, self.text = set(), "", [], ""
        self.feed(text)

    def copy(self) -> Parse:
        other = Parse()
        other.known, other.open, other.ends, other.text = self.known.copy(), self.open, self.ends[:], self.text
        return other

    def feed(self, text: str) -> Parse:
        known, phrase, add, ended = self.known, self.open, self.known.add, self.ends.append
        at = len(self.text)
        for at, ch in enumerate(text, at + 1):
            phrase += ch
            if phrase not in known:
                add(phrase)
                ended(at)
                phrase = ""
        self.open, self.text = phrase, self.text + text
        return self

    def fingerprint(self):
        """The smallest hashes of the phrases, ascending (unsigned 32-bit)."""
        import numpy as np
        if not self.ends:
            return np.empty(0, np.uint32)
        power, inverse = _powers(max(16, len(self.text).bit_length()))
        codes = np.frombuffer(self.text.encode("utf-32-le"), np.uint32).astype(np.uint64)
        total = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(_mix(codes + np.uint64(1)) * power[:len(codes)], out=total[1:])
        ends = np.asarray(self.ends)
        starts = np.concatenate([[0], ends[:-1]])
        hashes = (_mix((total[ends] - total[starts]) * inverse[starts]) >> np.uint64(32)).astype(np.uint32)
        return np.unique(hashes)[:SIZE]


def likeness(a, b) -> float:
    """Share of common hashes among the smallest of the union."""
    import numpy as np
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.concatenate([a, b])
    both.sort()
    twice = both[1:] == both[:-1]
    first = np.concatenate([[True], ~twice])           # the union's members, in order
    rank = np.cumsum(first)
    return float(np.count_nonzero(twice & (rank[1:] <= SIZE)) / min(SIZE, int(rank[-1])))


def as_text(fingerprint) -> str:
    return fingerprint.astype(">u4").tobytes().hex()


def as_hashes(text: str):
    import numpy as np
    return np.frombuffer(bytes.fromhex(text), ">u4").astype(np.uint32)


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_phrases, fingerprint) of every row of ``docs`` (doc_id, text)."""
    def run(batches):
        import pyarrow as pa
        for b in slices(batches):
            parses = [Parse(t or "") for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([len(p.ends) for p in parses], pa.int64()),
                 pa.array([as_text(p.fingerprint()) for p in parses], pa.string())], ["doc_id", "n_phrases", "fingerprint"])

    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_phrases bigint, fingerprint string")


def _deal(bounds: list[int], null_first: bool, first: int | None):
    """Rows to (range, ahead, doc_id, text); the first rows of a range also go to the one before it."""
    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        edges = np.asarray(bounds, np.int64)
        for b in batches:
            ids = b.column("doc_id")
            null = np.asarray(pc.is_null(ids))
            values = np.asarray(pc.fill_null(ids, 0))
            home = np.where(null, 0, np.searchsorted(edges, values, side="right")).astype(np.int32)
            begins = ~null & (home > 0) & (edges[np.maximum(home, 1) - 1] == values) if len(edges) else np.zeros(len(null), bool)
            wraps = null if null_first else ~null & (values == first)
            rows = np.concatenate([np.arange(len(null)), np.flatnonzero(begins), np.flatnonzero(wraps)])
            goes = np.concatenate([home, home[begins] - 1, np.full(int(wraps.sum()), len(edges))]).astype(np.int32)
            ahead = np.arange(len(rows)) >= len(null)
            take = b.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([pa.array(goes), pa.array(ahead), take.column("doc_id"), take.column("text")],
                                             ["__range", "__ahead", "doc_id", "text"])
    return run


def _compare(batches):
    import pyarrow as pa
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    prev, out, done = None, [], False                   # prev: doc_id, text, parse of its kept half, fingerprint

    def begun(doc_id, text):
        kept = Parse(text[:len(text) - len(text) // 2])
        return doc_id, text, kept, kept.copy().feed(text[len(kept.text):]).fingerprint()

    def finished(this, after):
        doc_id, text, kept, own = this
        edited = kept.feed(after[1][:len(text) // 2])   # the kept half is not parsed again
        mark = edited.fingerprint()
        return (doc_id, len(text), hashlib.sha256(edited.text.encode()).hexdigest(), as_text(own), as_text(mark),
                likeness(own, mark), likeness(own, after[3]))

    for b in slices(batches):
        if done:
            continue
        for doc_id, text, ahead in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), b.column("__ahead").to_pylist(), strict=True):
            if done:
                break
            row = begun(doc_id, text or "")
            if prev is not None:
                out.append(finished(prev, row))
            prev, done = row, ahead
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
            out = []


def compare_with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of ``docs`` (doc_id, text).

    The edited text has its last half replaced by the beginning of the next document.
    """
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    ranges = min(MAX_RANGES, max(1, rows.rdd.getNumPartitions()))
    shares = [i / ranges for i in range(1, ranges)]
    quantiles = F.percentile_approx("doc_id", shares, max(10_000, 4 * ranges)) if shares else F.lit(None)
    found = rows.agg(quantiles.alias("bounds"), F.min("doc_id").alias("first"), F.count_if(F.col("doc_id").isNull()).alias("nulls")).first()
    bounds = sorted({x for x in found.bounds or [] if x != found.first or found.nulls})
    dealt = rows.mapInArrow(_deal(bounds, found.nulls > 0, found.first), "__range int, __ahead boolean, doc_id bigint, text string")
    dealt = dealt.repartitionById(len(bounds) + 1, F.col("__range")).sortWithinPartitions("__ahead", "doc_id", "text")
    return dealt.mapInArrow(_compare, "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, "
                                      "edited_fingerprint string, near_edited double, near_next double")
