import hashlib

import pytest

from decisionlake.llm import lz_fingerprint as lz
from decisionlake.llm import warc
from decisionlake.session import staging_path


def archived(spark, rows):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, file string").repartition(2)
    folder = staging_path(spark, "w")
    index = warc.archive_pages(pages, folder)
    return index, folder, warc.read_records(index, f"{folder}/members")


def test_warc_round_trip(spark):
    big = "x" * 200
    rows = [(1, "u", big, "a"), (2, "u\r\nX: y", big, None), (3, None, big, "a"), (4, "u", "ab", "a"), (5, "u", "ab", "a"), (6, "u", None, "a"),
            (None, "u", big, "a"), (1, "u", big, "a"), (7, "ü", "é\r\n\r\nWARC/1.1 " * 40, "a")]
    index, folder, read = archived(spark, rows)
    got = read.collect()
    assert len(got) == len(rows)
    kinds = sorted((r.page_id is not None, r.page_id or 0, r.record_type, r.refers_to) for r in got)
    assert kinds == [(False, 0, "revisit", 1), (True, 1, "response", None), (True, 1, "response", None), (True, 2, "revisit", 1), (True, 3, "revisit", 1),
                     (True, 4, "response", None), (True, 5, "response", None), (True, 6, "response", None), (True, 7, "response", None)]
    payload = {r.page_id: r.payload for r in got if r.record_type == "response"}
    assert payload[7].decode() == rows[-1][2] and payload[6] == b""
    assert all(r.payload_digest == hashlib.sha256((dict((x[0], x[2]) for x in rows)[r.page_id] or "").encode()).hexdigest() for r in got)
    some = warc.read_records(index.where("page_id = 7"), f"{folder}/members")
    assert [r.page_id for r in some.collect()] == [7]


def test_no_pages(spark):
    assert archived(spark, [])[2].collect() == []


def test_records_of_any_chunking():
    record = warc._record(5, "http://x", b"abc", "d" * 64, None)
    whole = record * 3
    for size in (1, 7, len(record), 10_000):
        assert [r for _, r in warc.records(whole[i:i + size] for i in range(0, len(whole), size))] == [record] * 3
    with pytest.raises(ValueError):
        list(warc.records([whole[:-5]]))


def phrases(text):
    known, at = set(), 0
    for i in range(1, len(text) + 1):
        if text[at:i] not in known:
            known.add(text[at:i])
            at = i
    return known


def test_parse_and_likeness(sample):
    for _, t in sample[:40]:
        parse = lz.Parse(t)
        assert parse.known == phrases(t)
        half = lz.Parse(t[:len(t) // 2])
        assert (half.copy().feed(t[len(t) // 2:]).fingerprint() == parse.fingerprint()).all()
        assert (lz.as_hashes(lz.as_text(parse.fingerprint())) == parse.fingerprint()).all()
    a, b = lz.Parse("abcabcabd" * 3), lz.Parse("abcabcxyz" * 3)
    exact = len(a.known & b.known) / len(a.known | b.known)
    assert lz.likeness(a.fingerprint(), b.fingerprint()) == pytest.approx(exact)
    assert lz.likeness(a.fingerprint(), a.fingerprint()) == 1.0


def test_compare_with_next(spark, documents, sample):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "60k")
    try:
        rows = sorted(lz.compare_with_next(documents).collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(rows) == len(sample)
    for i, r in enumerate(rows):
        text, after = sample[i][1], sample[(i + 1) % len(sample)][1]
        half = len(text) // 2
        edited = text[:len(text) - half] + after[:half]
        mark = lz.Parse(edited).fingerprint()
        own = lz.Parse(text).fingerprint()
        assert (r.doc_id, r.n_chars, r.edited_sha256) == (sample[i][0], len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert r.fingerprint == lz.as_text(own) and r.edited_fingerprint == lz.as_text(mark)
        assert r.near_edited == lz.likeness(own, mark) and r.near_next == lz.likeness(own, lz.Parse(after).fingerprint())


def test_edges(spark, edges, no_rows):
    rows = lz.compare_with_next(edges).collect()
    assert len(rows) == edges.count() and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    same = {r.fingerprint for r in rows if r.doc_id == 1}
    assert len(same) == 1 and lz.fingerprints(edges).where("doc_id = 1").first().fingerprint in same
    assert lz.compare_with_next(no_rows).collect() == []
    alone = lz.compare_with_next(edges.where("doc_id = 5")).first()
    assert alone.near_next == 1.0
