"""Quality rules and text scores."""
import collections
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from decisionlake.llm import lm_scoring as lm
from decisionlake.llm import quality_rules as q
from tests.llm.conftest import SF, WORD


def repeated(words):
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    n = collections.Counter(windows)
    return len({i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(3)})


def test_figures(spark, edges):
    random.seed(3)
    texts = [" ".join(random.choices("abc", k=random.randint(0, 40))) + random.choice(["", "\nX|*\nX|*\n\t\n", "   x "]) for _ in range(200)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string").unionByName(edges.drop("d"))
    rows = {(r.doc_id, r.n_words, r.word_chars): r for r in q.figures(docs).collect()}
    for r in docs.collect():
        words = WORD.findall(r.text or "")
        lines = [x for x in (r.text or "").split("\n") if WORD.search(x)]
        f = rows[r.doc_id, len(words), sum(map(len, words))]
        assert f.n_repeat_words == repeated(words) and f.n_dup_lines == len(lines) - len(set(lines)) and f.n_lines == len(lines)
        assert f.n_symbols == sum((r.text or "").count(c) for c in "#*$%&|<>")


def test_binomial_tail_is_exact(spark):
    cases = [(0, 10), (3, 100), (5, 400), (40, 3000), (0, 1), (900, 1000)]
    rows = spark.createDataFrame(cases, "k long, n long").withColumn("p", q.binomial_tail(F.col("k"), F.col("n"), 0.02)).collect()
    for r in rows:
        want = sum(math.comb(r.n, i) * 0.02 ** i * 0.98 ** (r.n - i) for i in range(r.k + 1)) if r.k <= 0.02 * r.n else 1.0
        assert r.p == pytest.approx(want, rel=1e-9)


def labelled(spark, clean, bad, stratum="en"):
    good = "word " * 3 + " ".join(f"w{i}" for i in range(60))
    junk = " ".join(f"w{i}***" for i in range(60))
    rows = [(i, f"{good} {i}", stratum) for i in range(clean)] + [(clean + i, f"{junk} {i}", stratum) for i in range(bad)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    return docs, spark.createDataFrame([(i, int(i < clean)) for i in range(clean + bad)] + [(0, None), (99999, 0)], "doc_id long, quality int")


def test_cutoffs_need_evidence(spark):
    docs, labels = labelled(spark, 900, 60)
    kept = q.judge(docs, labels)
    assert kept.where("kept").count() == 900 and kept.where("doc_id >= 900 AND kept").count() == 0
    assert q.keep(docs, labels).count() == 900
    docs, labels = labelled(spark, 60, 60)                      # too few labels to promise anything
    assert q.judge(docs, labels).where("kept").count() == 120


def test_false_rejections_stay_below_the_risk(spark):
    docs, labels = labelled(spark, 900, 60)
    spoiled = labels.withColumn("quality", F.when(F.col("doc_id") >= 900, F.lit(1)).otherwise(F.col("quality")))       # the junk is called clean
    assert q.judge(docs, spoiled).where("NOT kept").count() == 0


def test_quality_edges(spark, edges, no_rows):
    none = spark.createDataFrame([], "doc_id long, quality int")
    judged = q.judge(edges, none)
    assert judged.count() == edges.count() and judged.where("kept = base_failed").count() == 0
    assert q.keep(edges, none).columns == edges.columns
    assert q.judge(no_rows, none).collect() == []


@pytest.mark.parametrize("name", ["op3_quality_rules", "op5_line_dedup"])
def test_queries_match_sql(spark, name):
    import duckdb

    from decisionlake.llm import queries
    from tests.compare import run
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    ok, text, _ = run(name, spark, con, SF, queries.QUERIES, queries.TWINS)
    assert ok, text


def test_scores(documents, sample, monkeypatch):
    rows = {r.doc_id: r for r in lm.score_documents(documents).collect()}
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = {d: [*WORD.findall(t.translate(low)), None] for d, t in sample}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in tokens}
    counts = collections.Counter(w for d, ws in tokens.items() if not held[d] for w in ws)
    n, v = sum(counts.values()), len(counts)
    for d, ws in tokens.items():
        r = rows[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[d], len(ws), sum(counts[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws), rel=1e-9)
        assert r.score < 0
    out = [r for r in rows.values() if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_rare_tokens_come_by_the_join(documents, monkeypatch):
    few = {r.doc_id: r for r in lm.score_documents(documents).collect()}
    monkeypatch.setattr(lm, "COMMON", 100)
    for r in lm.score_documents(documents).collect():
        assert r.n_known == few[r.doc_id].n_known and r.score == pytest.approx(few[r.doc_id].score) and r.base_score == pytest.approx(few[r.doc_id].base_score)


def small_model():
    code = lm.Code([i % 50 for i in range(lm.BUCKETS)])
    rng = np.random.default_rng(1)
    logit = rng.normal(0, 1, (lm.ORDERS, lm.SLOTS)).astype(np.float16)
    return {"code": code, "tables": lm.packed(logit, rng.integers(0, 7, logit.shape).astype(np.uint8))}


def test_a_score_depends_on_its_text_alone(monkeypatch):
    model, rng = small_model(), np.random.default_rng(2)
    texts = [rng.integers(0, 1 << 60, n).astype(np.uint64) for n in (1, 5, 33, 700, 2500)]
    together = lm.mixed_score(model, texts)
    assert together == pytest.approx([lm.mixed_score(model, [t])[0] for t in texts], rel=1e-4)
    monkeypatch.setattr(lm, "PIECE", 32 * 7)
    assert lm.mixed_score(model, texts) == pytest.approx(together, rel=1e-4)


def test_the_code_is_a_distribution():
    model = small_model()
    buckets = np.arange(lm.BUCKETS)
    token, node, bit = model["code"].spell(buckets)
    p = 1 / (1 + np.exp(-model["code"].logit[node].astype(float)))
    total = np.exp(np.bincount(token, np.log(np.where(bit, p, 1 - p)))).sum()
    assert total == pytest.approx(1, abs=1e-4)
    slots = model["code"].slot(lm.contexts([rng_hashes()], [(1, 1)])[1][np.zeros(len(node), int)], node)
    assert slots.min() >= 0 and slots.max() < lm.SLOTS


def rng_hashes():
    return np.random.default_rng(5).integers(0, 1 << 60, 4).astype(np.uint64)


def test_score_edges(edges, no_rows):
    rows = lm.score_documents(edges).collect()
    assert len(rows) == edges.count()
    assert {r.n_tokens for r in rows if r.doc_id in (2, 3, 4)} == {1} and all(r.bits_per_byte is None for r in rows if r.doc_id in (2, 3))
    assert lm.score_documents(no_rows).collect() == []
