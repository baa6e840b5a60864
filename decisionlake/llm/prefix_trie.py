"""Conversation prefix trie: padded turn-id matrices in range shards, boundary nodes recombined.

A node is a distinct sequence of first turns (role, text); the conversations that start with it are its members. Shared
prefixes are what a trainer can compute once: ``saved_tokens`` is what that saves.

1. Each turn becomes a 64-bit id of (role, text) and its count of words, each conversation a list of them; texts are not moved.
2. Conversations are range-partitioned by (their first ``KEY`` ids, conv_id) into shards of about ``SHARD`` turns. A first turn, or a whole
   conversation, that a third of the rows share is spread over shards, as ids below it, or conv_id, go on dividing.
3. A shard is a matrix of ids, ``WIDTH`` columns at a time, ended conversations padded with the least id. ``lexsort`` orders its rows, the
   masks of changed columns, OR-accumulated along a row, mark where nodes start, and ``reduceat`` over these starts
   gives members, smallest member, words and children of each depth; the depths are then added up from the deepest.
4. A node that touches the first or the last row of its shard (or lies below such a prefix of ``KEY`` turns) may go on in the next shard. Only
   such *open* nodes leave a shard in part, under a 128-bit hash of their path; Spark adds the parts, and adds up the open nodes'
   subtrees by pointer doubling, in rounds of the logarithm of their depth. All other nodes are final where they are.
5. The list of conversations that end in a node is hashed in its shard. For an open node the shards' lists, ascending and disjoint by
   construction, go through one SHA-256 in order, a part of ``ENDS`` ids at a time: a hash of one list is sequential, its memory is not.

Bounds: a task holds the ids of one shard, and the longest conversation's (16 bytes a turn); nothing is collected.

Defined results: rows without conv_id go; a null turn is first; rows of equal turn are all kept, in order of their id; null role or text is
empty; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from decisionlake.llm.common import WORD
from decisionlake.llm.lz_fingerprint import _mix
from decisionlake.session import cut

KEY = 16                                  # ids of the range key
WIDTH = 8                                 # columns of a matrix
SHARD = 1 << 18                           # turns of a shard, about
LEAST_SHARD = 1 << 12                     # turns for which another shard is worth a task
ENDS = 1 << 13                            # ids in one row of an open node's list
SMALL_ROWS = 500_000                      # rows of (path, conv_id) that may be broadcast, about 20 MB
PAD = -(1 << 63)
NO_ENDS = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"      # fixed value: SHA-256 of nothing
FAMILY, HEADS = 20, 4                     # conversations that share a first one, and the number of lengths of its part


# conversations --------------------------------------------------------------------------------
def _turns(conversations: DataFrame) -> DataFrame:
    text, role = F.coalesce(F.col("text").cast("string"), F.lit("")), F.coalesce(F.col("role").cast("string"), F.lit(""))
    key = F.xxhash64(role, text)
    return conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn"), F.when(key == PAD, PAD + 1).otherwise(key).alias("id"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))


def _lists(turns: DataFrame, *keys: str) -> DataFrame:
    """(conv_id, ids, words), turns in order, null first."""
    row = F.sort_array(F.collect_list(F.struct("turn", "id", "words")))
    rows = turns.groupBy(*keys, "conv_id").agg(row.alias("t"))
    return rows.select(*keys, "conv_id", F.col("t.id").alias("ids"), F.col("t.words").alias("words"))


def sequences(conversations: DataFrame) -> DataFrame:
    """(conv_id, ids, words) of every conversation as it stands."""
    return _lists(_turns(conversations))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv_id, ids, words) of every conversation c, rebuilt: the first h turns of c - c % 20, then its own after the first h; h is crc32(c) % 4.

    A family of conversations is dealt together, so this takes one shuffle, of ids only. The remainder is that of SQL: it has the sign of c.
    """
    c = F.col("conv_id")
    turns = _turns(conversations).withColumn("base", c - c % FAMILY)
    own = _lists(turns.repartition("base"), "base").withColumn("h", (F.crc32(c.cast("string")) % HEADS).cast("int"))
    head = F.max(F.when(c == F.col("base"), F.struct(*[F.slice(x, 1, HEADS - 1).alias(x) for x in ("ids", "words")]))).over(Window.partitionBy("base"))
    none = F.array().cast("array<bigint>")
    both = lambda x: F.concat(F.coalesce(F.slice(F.col(f"head.{x}"), F.lit(1), F.col("h")), none),
                              F.slice(x, F.col("h") + 1, F.size(x))).alias(x)
    return own.withColumn("head", head).select("conv_id", both("ids"), both("words"))


# one shard ------------------------------------------------------------------------------------
ODDS = (0xD1342543DE82EF95, 0xAF251AF3B0F025B5)
NODE = {"kind": "string", "depth": "int", "k1": "bigint", "k2": "bigint", "p1": "bigint", "p2": "bigint", "conv_id": "bigint", "parent_conv_id": "bigint",
        "n_convs": "bigint", "n_children": "bigint", "n_leaves": "bigint", "saved_tokens": "bigint", "words": "bigint", "ends": "string"}


def _path(key, ids, odd: int):
    """The hash of paths one turn further."""
    import numpy as np
    with np.errstate(over="ignore"):
        return _mix(key * np.uint64(odd) + ids.view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))


def _matrix(ids, offset, size, rows, at: int, width: int):
    """The ids of ``rows`` from place ``at``, padded."""
    import numpy as np
    column = at + np.arange(width)
    inside = column[None, :] < size[rows, None]
    return np.where(inside, ids[np.where(inside, offset[rows, None] + column[None, :], 0)], PAD) if len(ids) else np.full(inside.shape, PAD)


def _edges(ids, offset, size, key: int) -> list:
    """For each depth up to ``key``, the path hashes of the first and the last row in the order of the range key."""
    import numpy as np
    width = min(key, int(size.max()))
    matrix = _matrix(ids, offset, size, np.arange(len(size)), 0, width)
    order = np.lexsort(matrix.T[::-1]) if width else np.zeros(1, np.int64)
    path, out = np.zeros(2, np.uint64), []
    for j in range(width):
        two = matrix[order[[0, -1]], j]
        path = _path(path, two, ODDS[0])
        out.append(path[two != PAD])
    return out


def _levels(conv, ids, words, size, key: int, most: int) -> list[dict]:
    """The nodes of every depth of a shard, in order, from matrices of at most ``most`` columns."""
    import numpy as np
    offset = np.concatenate([[0], np.cumsum(size)[:-1]])
    edges = _edges(ids, offset, size, key)
    node = np.zeros(len(conv), np.int64)                    # of each row, at the depth reached
    rows = np.argsort(conv, kind="stable")
    ended = rows[size[rows] == 0]
    one = lambda x, kind=np.int64: np.array([x], kind)
    last = {"parent": one(0), "n": one(len(conv)), "least": one(conv.min()), "words": one(0), "open": one(True, bool), "k1": one(0, np.uint64),
            "k2": one(0, np.uint64), "ended": one(len(ended)), "ends": conv[ended]}
    levels, at = [last], 0
    while len(rows := rows[size[rows] > at]):
        width = min(most, int(size[rows].max()) - at)
        matrix = _matrix(ids, offset, size, rows, at, width)
        order = np.lexsort((conv[rows], *matrix.T[::-1], node[rows]))
        rows, matrix = rows[order], matrix[order]
        change = np.ones((len(rows), width + 1), bool)      # column 0: another node so far
        change[1:, 0] = node[rows[1:]] != node[rows[:-1]]
        change[1:, 1:] = matrix[1:] != matrix[:-1]
        starts = np.logical_or.accumulate(change, axis=1)[:, 1:]
        for j in range(width):
            live = np.flatnonzero(matrix[:, j] != PAD)
            here, begins, depth = rows[live], starts[live, j], at + j + 1
            start = np.flatnonzero(begins)
            parent, turn = node[here[start]], matrix[live[start], j]
            k1, k2 = (_path(last[k][parent], turn, odd) for k, odd in zip(("k1", "k2"), ODDS, strict=True))
            node[here] = np.cumsum(begins) - 1
            over = here[size[here] == depth]
            last = {"parent": parent, "n": np.diff(np.append(start, len(live))), "least": np.minimum.reduceat(conv[here], start),
                    "words": words[offset[here[start]] + depth - 1], "k1": k1, "k2": k2,
                    "open": np.isin(k1, edges[depth - 1]) if depth <= key else last["open"][parent],
                    "ended": np.bincount(node[over], minlength=len(start)), "ends": conv[over]}
            levels.append(last)
        at += width
    return levels


def _totals(levels: list[dict]) -> None:
    """Adds children, leaves and saved tokens, from the deepest level up; what is below an open child is left to the open nodes' sums."""
    import numpy as np
    below = None
    for level in reversed(levels):
        children, leaves, saved = (np.zeros(len(level["n"]), np.int64) for _ in range(3))
        if below is not None:
            start = np.flatnonzero(np.diff(below["parent"], prepend=-1))
            parent, final = below["parent"][start], ~below["open"]
            for total, part in ((children, final), (leaves, below["leaves"] * final), (saved, below["saved"] * final)):
                total[parent] = np.add.reduceat(part.astype(np.int64), start)
        final = ~level["open"]
        level["children"], level["leaves"] = children, leaves + (final & (children == 0))
        level["saved"] = saved + final * (level["n"] - 1) * level["words"]
        below = level


def _batch(**columns):
    import numpy as np
    import pyarrow as pa
    kinds = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64()}
    n = len(columns["depth"])
    made = [columns.get(c) for c in NODE]
    made = [pa.nulls(n, kinds[k]) if x is None else pa.array(x.view(np.int64) if getattr(x, "dtype", None) == np.uint64 else x, kinds[k])
            for x, k in zip(made, NODE.values(), strict=True)]
    return pa.RecordBatch.from_arrays(made, list(NODE))


def _masked(values, gone):
    import numpy as np
    import pyarrow as pa
    return pa.array(values.view(np.int64) if values.dtype == np.uint64 else values, pa.int64(), mask=gone)


def _shard(key: int, width: int, ends_a_row: int):
    """The rows of one partition to its nodes: ``node`` rows are final, ``open`` rows and their ``end`` rows are parts."""
    def run(batches):
        import hashlib

        import numpy as np
        import pyarrow as pa
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        shard = pa.Table.from_batches(held).combine_chunks()
        lists = shard.column("ids").combine_chunks()
        conv, ids = np.asarray(shard.column("conv_id")), np.asarray(lists.flatten(), np.int64)
        size = np.asarray(lists.value_lengths(), np.int64)
        levels = _levels(conv, ids, np.asarray(shard.column("words").combine_chunks().flatten(), np.int64), size, key, width)
        _totals(levels)
        above = levels[0]
        for depth, level in enumerate(levels):
            n, is_open = len(level["n"]), level["open"]
            up = above["open"][level["parent"]] if depth else np.ones(n, bool)
            edge = np.concatenate([[0], np.cumsum(level["ended"])])
            ends: list = [None] * n
            for i in np.flatnonzero((level["ended"] > 0) & ~is_open).tolist():
                ends[i] = hashlib.sha256(",".join(map(str, level["ends"][edge[i]:edge[i + 1]].tolist())).encode()).hexdigest()
            yield _batch(kind=np.where(is_open, "open", "node"), depth=np.full(n, depth), k1=_masked(level["k1"], ~is_open), k2=_masked(level["k2"], ~is_open),
                         p1=_masked(above["k1"][level["parent"]], ~up | (depth == 0)), p2=_masked(above["k2"][level["parent"]], ~up | (depth == 0)),
                         conv_id=level["least"], parent_conv_id=_masked(above["least"][level["parent"]], up), n_convs=level["n"], n_children=level["children"],
                         n_leaves=level["leaves"], saved_tokens=level["saved"], words=level["words"], ends=ends)
            for i in np.flatnonzero((level["ended"] > 0) & is_open).tolist():
                own = level["ends"][edge[i]:edge[i + 1]].tolist()
                parts = [own[at:at + ends_a_row] for at in range(0, len(own), ends_a_row)]
                yield _batch(kind=["end"] * len(parts), depth=[depth] * len(parts), k1=np.repeat(level["k1"][i], len(parts)), k2=np.repeat(level["k2"][i], len(parts)),
                             conv_id=[p[0] for p in parts], ends=[",".join(map(str, p)) for p in parts])
            above = level
    return run


# open nodes -----------------------------------------------------------------------------------
PATH, PARENT = ["depth", "k1", "k2"], ["above", "p1", "p2"]


def _small(df: DataFrame) -> DataFrame:
    """``df``, marked for broadcast if its rows are few enough; it must be cheap to count."""
    return F.broadcast(df) if df.count() <= SMALL_ROWS else df


def _hashed(batches):
    """One SHA-256 a path over the parts of its list, which come in order."""
    import hashlib

    import pyarrow as pa
    last, state, done = None, None, []
    for b in batches:
        for *path, part in zip(*(b.column(c).to_pylist() for c in [*PATH, "ends"]), strict=True):
            if path == last:
                state.update(b"," + part.encode())
                continue
            if last is not None:
                done.append((*last, state.hexdigest()))
            last, state = path, hashlib.sha256(part.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], [*PATH, "sha"]).cast(_hashed_schema())
            done = []
    if last is not None:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip((*last, state.hexdigest()), strict=True)], [*PATH, "sha"]).cast(_hashed_schema())


def _hashed_schema():
    import pyarrow as pa
    return pa.schema([("depth", pa.int32()), ("k1", pa.int64()), ("k2", pa.int64()), ("sha", pa.string())])


def _open(rows: DataFrame) -> DataFrame:
    """The parts of open nodes to whole nodes, with the sums over their subtrees."""
    whole = rows.where("kind = 'open'").groupBy(*PATH).agg(
        F.first("p1").alias("p1"), F.first("p2").alias("p2"), F.min("conv_id").alias("conv_id"), F.max("words").alias("words"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")])
    whole = cut(whole.withColumn("above", F.col("depth") - 1))
    kids = whole.where("p1 IS NOT NULL").groupBy(*PARENT).agg(F.count(F.lit(1)).alias("kids")).withColumnsRenamed(dict(zip(PARENT, PATH, strict=True)))
    whole = whole.join(_small(cut(kids)), PATH, "left").withColumn("n_children", F.col("n_children") + F.coalesce("kids", F.lit(0)))
    whole = cut(whole.withColumn("n_leaves", F.col("n_leaves") + (F.col("n_children") == 0).cast("long"))
                .withColumn("saved_tokens", F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("words")))
    deepest, reach = whole.agg(F.max("depth")).first()[0] or 0, 1
    sums = whole.select(*PATH, *PARENT, "n_leaves", "saved_tokens")      # above, p1, p2: the ancestor ``reach`` steps up
    while reach <= deepest:
        given = sums.where("p1 IS NOT NULL").groupBy(*PARENT).agg(F.sum("n_leaves").alias("l"), F.sum("saved_tokens").alias("s"))
        jump = sums.select(*[F.col(c).alias(d) for c, d in zip(PATH, PARENT, strict=True)], *[F.col(c).alias(f"{c}_2") for c in PARENT])
        more = sums.join(_small(cut(given.withColumnsRenamed(dict(zip(PARENT, PATH, strict=True))))), PATH, "left").join(_small(jump), PARENT, "left")
        sums = cut(more.select(*PATH, *[F.col(f"{c}_2").alias(c) for c in PARENT], (F.col("n_leaves") + F.coalesce("l", F.lit(0))).alias("n_leaves"),
                               (F.col("saved_tokens") + F.coalesce("s", F.lit(0))).alias("saved_tokens")))
        reach *= 2
    ends = rows.where("kind = 'end'").select(*PATH, "conv_id", "ends").repartition(*PATH).sortWithinPartitions(*PATH, "conv_id").drop("conv_id")
    sha = ends.mapInArrow(_hashed, "depth int, k1 bigint, k2 bigint, sha string")
    return cut(whole.drop("n_leaves", "saved_tokens").join(sums.select(*PATH, "n_leaves", "saved_tokens"), PATH).join(sha, PATH, "left"))


def nodes(conversations: DataFrame) -> DataFrame:
    """One row a node of the trie of ``conversations`` (conv_id, ids, words), the columns of the contract."""
    rows = cut(conversations)
    turns = rows.agg(F.sum(F.size("ids") + 1)).first()[0] or 0
    shards = max(turns // SHARD, min(rows.sparkSession.sparkContext.defaultParallelism, turns // LEAST_SHARD)) + 1
    made = cut(rows.repartitionByRange(shards, F.slice("ids", 1, KEY), "conv_id").mapInArrow(_shard(KEY, WIDTH, ENDS), ", ".join(f"{c} {k}" for c, k in NODE.items())))
    whole = _open(made)
    parents = _small(whole.select(F.col("depth").alias("above"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("known")))
    final = made.where("kind = 'node'").withColumn("sha", F.col("ends")).withColumn("above", F.col("depth") - 1)
    every = final.drop("kind", "k1", "k2", "words", "ends").unionByName(whole.drop("k1", "k2", "words", "kids"), allowMissingColumns=True)
    return every.join(parents, PARENT, "left").select(
        "conv_id", F.col("depth").cast("long").alias("depth"), F.coalesce("parent_conv_id", "known").alias("parent_conv_id"), "n_convs", "n_children",
        "n_leaves", "saved_tokens", F.coalesce("sha", F.lit(NO_ENDS)).alias("ends_sha256"))


def shared_prefixes(conversations: DataFrame) -> DataFrame:
    """The trie of rebuilt conversations, one row a node."""
    return nodes(rebuilt(conversations))
