"""Line dedup and the n-gram join against brute force."""
import collections
import random

import pytest

from decisionlake.llm import line_dedup, ngram_join, quality_rules
from tests.llm.conftest import WORD


def gone_lines(docs):
    seen, index, gone = [], collections.defaultdict(list), collections.defaultdict(list)
    for doc_id, text in sorted(docs):
        for i, line in enumerate(text.split("\n")):
            words = frozenset(WORD.findall(line))
            if not words:
                continue
            common = collections.Counter(k for w in words for k in index[w])
            if any(5 * n >= 4 * (len(words) + len(seen[k]) - n) for k, n in common.items()):
                gone[doc_id].append(i)
            for w in words:
                index[w].append(len(seen))
            seen.append(words)
    return gone


def edited_lines(seed, n):
    random.seed(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    lines, docs = [[]], []
    for i in range(n):
        own = []
        for _ in range(random.randint(0, 6)):
            base = [random.choice(vocabulary) for _ in range(random.choice([1, 2, 5, 8, 12, 30, 70, 150]))] if random.random() < 0.4 else list(random.choice(lines))
            for _ in range(random.randint(0, 2)):
                if base:
                    base[random.randrange(len(base))] = random.choice(vocabulary)
            lines.append(base)
            own.append(random.choice([" ", "  ", "\t"]).join(base) if random.random() < 0.9 else "")
        docs.append((i, "\n".join(own)))
    return docs


@pytest.mark.parametrize("hot", [3, 16])
def test_line_dedup_is_exact(spark, monkeypatch, hot):
    monkeypatch.setattr(line_dedup, "HOT", hot)
    docs = edited_lines(hot, 150)
    want = gone_lines(docs)
    rows = line_dedup.removed_lines(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()
    assert {r.doc_id: list(r.removed) for r in rows if r.removed} == dict(want) and len(rows) == 150


def test_line_dedup_without_broadcasts(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "SMALL_ROWS", -1)
    docs = edited_lines(9, 60)
    rows = line_dedup.removed_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id: list(r.removed) for r in rows if r.removed} == dict(gone_lines(docs))


def test_line_dedup_deals_prefix_words_once(spark, monkeypatch):
    plans, pairs = [], line_dedup._pairs
    monkeypatch.setattr(line_dedup, "_pairs", lambda joined: plans.append(joined) or pairs(joined))
    monkeypatch.setattr(line_dedup, "SMALL_ROWS", -1)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        line_dedup.later_matches(spark.createDataFrame(edited_lines(5, 40), "doc_id long, text string"))
        plans[-1].write.format("noop").mode("overwrite").save()
        plans[-1].collect()
        plan = plans[-1]._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "ReusedExchange" in plan                     # both sides of the last join read one shuffle


def test_line_dedup_parts_words_at_every_blank(spark):
    docs = [(1, "a b c d e f\x0b g\th"), (2, "x  a b\fc d\re f g h \n\t \nh g f e d c b a"), (3, "\x0b\nab cd")]
    rows = line_dedup.removed_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id: list(r.removed) for r in rows} == {1: [], 2: [0, 2], 3: []} == {d: gone_lines(docs).get(d, []) for d, _ in docs}


def test_line_dedup_edges(spark, edges, no_rows):
    out = line_dedup.dedup_lines(edges)
    assert out.columns == edges.columns and out.count() == edges.count()
    text = {(r.doc_id, r.d): r.text for r in out.where("doc_id in (3, 4, 5)").collect()}
    assert text == {(3, "y"): None, (4, "z"): " \n\t", (5, "x"): "one line\n\nanother"}
    assert [r.text for r in out.where("doc_id = 1").collect()] == ["a b c d e f g"] * 2        # one document, twice
    assert "" in [r.text for r in out.where("doc_id = 7").collect()]
    assert line_dedup.dedup_lines(no_rows).collect() == [] and line_dedup.removed_lines(no_rows).collect() == []


def near(docs):
    sets = {}
    for doc_id, text in docs:
        words = WORD.findall(text or "")
        sets[doc_id] = frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()
    copies, parent, degree, index = collections.defaultdict(list), {d: d for d in sets}, collections.Counter(), collections.defaultdict(list)
    for d in sorted(sets):
        copies[sets[d]].append(d)

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for s, (d, *_) in sorted(copies.items(), key=lambda x: x[1]):
        for k, n in collections.Counter(k for x in s for k in index[x]).items():
            other = sets[k]
            if n >= 0.8 * (len(s) + len(other) - n) - 1e-9:
                degree[d] += 1
                degree[k] += 1
                a, b = top(d), top(k)
                parent[max(a, b)] = min(a, b)
        for x in s:
            index[x].append(d)
    return {d: (top(v[0]), degree[v[0]], len(v)) for v in copies.values() for d in v}


def test_ngram_join_on_documents(documents, sample):
    assert {r.doc_id: (r.class_id, r.n_links, r.n_copies) for r in ngram_join.near_duplicates(documents).collect()} == near(sample)


def test_ngram_join_on_a_hot_group(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    random.seed(4)
    base = [random.choice("abcdefghijklmnopqrstuvwxyz") * random.randint(1, 9) for _ in range(200)]
    docs = []
    for i in range(120):
        words = list(base)
        for _ in range(random.choice([0, 1, 2, 3])):
            words[random.randrange(200)] = f"X{random.randrange(5)}"
        docs.append((i, " ".join(words)))
    docs += [(203, "a b"), (204, "a\tb"), (205, "a"), (206, "x " * 5000)]
    got = ngram_join.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()
    assert {r.doc_id: (r.class_id, r.n_links, r.n_copies) for r in got} == near(docs)


def test_ngram_join_edges(edges, no_rows):
    assert ngram_join.near_duplicates(edges).count() == edges.count()
    assert ngram_join.near_duplicates(no_rows).collect() == [] and ngram_join.keep_one(no_rows).collect() == []
    kept = ngram_join.keep_one(edges)
    assert kept.columns == edges.columns
    assert sorted((r.doc_id is not None, r.doc_id or 0, (r.text or "")[:4]) for r in kept.collect()) == [
        (False, 0, "no i"), (True, 1, "a b "), (True, 2, ""), (True, 5, "one "), (True, 6, "wörd"), (True, 7, "othe")]


def test_texts_that_share_an_id_keep_their_own_classes(spark):
    a, b, c, e = (" ".join(f"{x}{i}" for i in range(60)) for x in "abce")
    rows = [(3, a + " x"), (7, a), (7, b), (8, b), (9, b + " y"), (7, e), (7, e + " z"),     # id 7: near 3, first of 8 and 9, and a pair of its own
            (None, a + " w"), (None, c), (None, c + " u"), (11, c + " v"), (None, b.upper()), (12, b.upper())]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {(r.class_id, r.n_links, r.n_copies): r.n for r in ngram_join.near_duplicates(docs).groupBy("doc_id", "class_id", "n_links", "n_copies").count()
           .withColumnRenamed("count", "n").where("doc_id = 7").collect()}
    assert got == {(None, 2, 1): 1, (7, 1, 2): 1, (7, 1, 1): 2}
    kept = [(r.doc_id, r.text) for r in ngram_join.keep_one(docs).collect()]
    assert [d for d, t in kept if t[:1] == "a"] == [None] and [d for d, t in kept if t[:1] == "b"] == [7]
    assert [d for d, t in kept if t[:1] == "e"] == [7] and [d for d, t in kept if t[:1] == "c"] == [None]
    assert [d for d, t in kept if t[:1] == "B"] == [None] and len(kept) == 5


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(100, 400)] + [(7, 3), (9, 7), (5, 5)], "u long, v long")
    root = {r.node: r.root for r in ngram_join.components(edges).collect()}
    assert root == {**{i: 100 for i in range(100, 401)}, 3: 3, 7: 3, 9: 3}


@pytest.mark.parametrize("threshold", [0.5, 0.65])
def test_ngram_join_loses_no_link_at_lower_thresholds(spark, threshold):
    random.seed(int(threshold * 100))
    docs = []
    for i in range(150):                                    # pairs on both sides of the threshold
        words = [f"{i}w{k}" for k in range(60)]
        other = list(words)
        for k in random.sample(range(60), random.randint(0, 8)):
            other[k] = "x"
        docs += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
    sets = {d: frozenset(tuple(t.split()[k:k + 5]) for k in range(len(t.split()) - 4)) for d, t in docs}
    alike = {d for d in sets if len(sets[d] & sets[d ^ 1]) >= threshold * len(sets[d] | sets[d ^ 1]) and sets[d] != sets[d ^ 1]}
    got = ngram_join.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), threshold).collect()
    assert {r.doc_id for r in got if r.n_links} == alike and 60 < len(alike) < 299
    with pytest.raises(ValueError):
        ngram_join.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), 0.1)


def test_columns_that_clash_with_inner_names(spark):
    line = "one two three four five six seven"
    rows = [(1, f"{line}\nfirst", "en"), (2, f"{line}\nsecond", "en"), (3, " ".join(f"w{i}" for i in range(60)), "en"), (4, " ".join(f"w{i}" for i in range(60)), "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for name in ("__d", "__th", "__doc", "__digest", "__gone", "__removed", "d", "th", "row", "own_id", "own_th", "own_digest", "gone_id", "gone_digest", "removed", "digest", "kept", "node", "carried"):
        docs = docs.withColumn(name, docs.doc_id)
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    kept = quality_rules.keep(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {3, 4}
    lines = line_dedup.dedup_lines(docs)
    assert lines.columns == docs.columns and {r.doc_id: r.text for r in lines.collect()} == {1: rows[0][1], 2: "second", 3: rows[2][1], 4: ""}
    one = ngram_join.keep_one(docs)
    assert one.columns == docs.columns and {r.doc_id for r in one.collect()} == {1, 2, 3}
