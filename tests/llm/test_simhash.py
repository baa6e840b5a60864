"""SimHash tiles against all pairs."""
import random

import pytest
from xxhash import xxh64_intdigest

from decisionlake.llm import simhash
from tests.llm.conftest import WORD

LOWER = {c: c + 32 for c in range(65, 91)}


def plain_fingerprint(text, width=4):
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def plain_components(prints, radius=4):
    root = list(range(len(prints)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    return [top(i) for i in range(len(prints))]


def check(rows, docs, radius=4):
    prints = [plain_fingerprint(t) for _, t in docs]
    roots = plain_components(prints, radius)
    least = {}
    for (d, _), r in zip(docs, roots, strict=True):
        if d is not None:
            least[r] = min(d, least.get(r, d))
    want = sorted(((d, f"{p:016x}", least.get(r)) for (d, _), p, r in zip(docs, prints, roots, strict=True)), key=str)
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in rows), key=str) == want


def test_sample_equals_brute_force(documents, sample):
    check(simhash.digest(documents).collect(), sample)


@pytest.mark.parametrize("tile, small", [(4, 500_000), (1024, -1)])
def test_hot_groups_chains_and_tile_borders(spark, monkeypatch, tile, small):
    monkeypatch.setattr(simhash, "TILE", tile)
    monkeypatch.setattr(simhash, "SMALL_ROWS", small)
    random.seed(tile)
    base = [random.choice("abcdefghij") * 3 + str(random.randint(0, 99)) for _ in range(400)]
    docs = []
    for i in range(150):                                    # one group of near copies, drifting, and a hot exact copy
        if i % 3:
            base[random.randrange(len(base))] = str(i)
        docs.append((i, " ".join(base)))
    docs += [(200 + i, " ".join(random.choice("xyz") + str(random.randint(0, 9)) for _ in range(random.randint(0, 12)))) for i in range(100)]
    monkeypatch.setattr(simhash, "TILES_A_TASK", 1)
    check(simhash.digest(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)).collect(), docs)


@pytest.mark.parametrize("radius", [0, 1, 7])
def test_any_radius(spark, radius):
    random.seed(radius)
    prints = [random.getrandbits(64) for _ in range(40)]
    for _ in range(200):
        prints.append(random.choice(prints) ^ (1 << random.randrange(64)) ^ (1 << random.randrange(64)))
    prints = sorted({p - (1 << 64) if p >> 63 else p for p in prints})
    found = simhash.components(simhash.links(spark.createDataFrame([(p,) for p in prints], "fp long"), radius)).collect()
    unsigned = [p % (1 << 64) for p in prints]
    roots = plain_components(unsigned, radius)
    groups = {}
    for p, r in zip(prints, roots, strict=True):
        groups.setdefault(r, set()).add(p)
    by_root = {}
    for r in found:
        by_root.setdefault(r.root, set()).add(r.node)
    assert sorted(map(sorted, by_root.values())) == sorted(sorted(g) for g in groups.values() if len(g) > 1)


def test_long_texts_are_counted_in_parts(monkeypatch):
    text = " ".join(random.Random(1).choice(["Äpfel", "B", "ccc\tD", "e\ne"]) for _ in range(3000))
    whole = simhash.fingerprint(text.encode())
    monkeypatch.setattr(simhash, "CHUNK", 100)
    assert simhash.fingerprint(text.encode()) == whole == plain_fingerprint(text)


def test_edges(spark, edges, no_rows):
    docs = [(r.doc_id, r.text) for r in edges.collect()]
    check(simhash.digest(edges.withColumn("fp", edges.d).withColumn("known", edges.d)).collect(), docs)
    assert simhash.digest(no_rows).count() == 0
    assert simhash.digest(no_rows).columns == ["doc_id", "fingerprint", "component_id"]
