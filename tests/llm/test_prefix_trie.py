"""The prefix trie against a dictionary of all prefixes."""
import hashlib
import math
import random
import zlib
from collections import defaultdict

import pytest

from decisionlake.llm import prefix_trie
from tests.llm.conftest import SF, WORD

KIND = "conv_id long, turn long, role string, text string, depth string"


def plain(turns):
    own = defaultdict(list)
    for c, _, role, text in (t[:4] for t in turns):
        own[c].append((role or "", text or ""))
    rebuilt = {}
    for c, said in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = own.get(c - int(math.fmod(c, 20)), [])[:h] + said[h:]
    members, children = defaultdict(list), defaultdict(list)
    for c in sorted(rebuilt):
        for d in range(len(rebuilt[c]) + 1):
            members[tuple(rebuilt[c][:d])].append(c)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    out, leaves, saved = {}, {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in children[p]) or 1
        saved[p] = sum(saved[k] for k in children[p]) + (len(members[p]) - 1) * (len(WORD.findall(p[-1][1])) if p else 0)
        ends = ",".join(str(c) for c in members[p] if len(rebuilt[c]) == len(p))
        out[members[p][0], len(p)] = (members[p[:-1]][0] if p else None, len(members[p]), len(children[p]), leaves[p], saved[p],
                                      hashlib.sha256(ends.encode()).hexdigest())
    return out


def result(df):
    rows = df.collect()
    found = {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in rows}
    assert len(found) == len(rows)
    return found


def shards(monkeypatch, turns, key=16, width=8, ends=8192):
    for name, value in {"SHARD": turns, "LEAST_SHARD": turns, "KEY": key, "WIDTH": width, "ENDS": ends}.items():
        monkeypatch.setattr(prefix_trie, name, value)


@pytest.mark.parametrize("turns, key, width, ends, small", [(1 << 18, 16, 8, 8192, 500_000), (40, 16, 3, 2, -1), (40, 2, 1, 1, 500_000), (9, 1, 5, 3, 500_000)])
def test_random_tries_in_any_shards(spark, monkeypatch, turns, key, width, ends, small):
    shards(monkeypatch, turns, key, width, ends)
    monkeypatch.setattr(prefix_trie, "SMALL_ROWS", small)
    random.seed(turns + key)
    rows = []
    for c in range(300):                                    # a third say the same, the others share first turns; some are long
        said = ["same"] * 5 if c % 3 == 0 else [random.choice(["a b", "c", " d  e\tf "]) for _ in range(random.randint(0, 4) + 30 * (c % 97 == 1))]
        rows += [(c - 40, i, "user" if i % 2 == 0 else None, t, "x") for i, t in enumerate(said)]
    want = plain(rows)
    random.shuffle(rows)
    assert result(prefix_trie.shared_prefixes(spark.createDataFrame(rows, KIND).repartition(4))) == want


def test_sample_equals_brute_force(spark):
    conversations = spark.read.parquet(f"{SF}/conversations.parquet")
    rows = [tuple(r) for r in conversations.select("conv_id", "turn", "role", "text").orderBy("conv_id", "turn").collect()]
    assert result(prefix_trie.shared_prefixes(conversations)) == plain(rows)


def test_edges(spark, no_rows):
    rows = [(20, None, None, None, "x"), (20, 0, "user", "", "x"), (20, 1, "user", "w " * 5000, "x"), (21, None, "user", "first", "x"), (21, 5, "a", "b", "y"),
            (22, 0, "", "", None), (None, 0, "user", "lost", "x"), (23, 7, "user", "only one", None), (23, 7, "user", "only one", None)]
    ordered = [r[:4] for r in rows if r[0] is not None]
    found = result(prefix_trie.shared_prefixes(spark.createDataFrame(rows, KIND).repartition(3)))
    assert found == plain(ordered)
    empty = spark.createDataFrame([], KIND)
    assert prefix_trie.shared_prefixes(empty).count() == 0
    own = prefix_trie.nodes(prefix_trie.sequences(spark.createDataFrame(rows, KIND)))      # the trie of conversations as they stand
    assert {(r.conv_id, r.depth): r.n_convs for r in own.collect()}[20, 0] == 4
