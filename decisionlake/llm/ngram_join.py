"""Near-duplicate documents: n-gram Jaccard join by a MinHash LSH forest with exact verification.

A document is the set of its ``WIDTH``-word shingles (a shorter text is one shingle). Documents with equal sets form one
class by aggregation; one representative of each goes on.

*Forest.* A signature has ``TREES`` labels of ``DEPTH`` minimum hashes. Representatives that agree on the first x values
of a tree's label sit below one node of its prefix trie. The join begins with whole labels and shortens the matched prefix
until the recall is reached: both the recall that is guaranteed for a pair right at the threshold and the one estimated
from the links found so far (each stands for 1/p links, p being its own chance to be found) must be ``TARGET`` or more. A
pair is looked at once: in the first tree where it agrees, and at the longest prefix.

*Hot nodes.* A node of many members is cut into blocks, and every two blocks are compared in a task of their own, so a task
has about two blocks of members at most. Pairs live only inside such a task: it returns, for each member, how many verified
links it has and the first member it is linked to within the task. No pair leaves a task.

*Verification* is the Jaccard likeness of the whole shingle sets, fetched for members of candidate pairs only. A pair is
dropped before only if its signatures agree in a smaller share of the values than nine standard deviations below the threshold, which
a pair at the threshold does with a chance below 1e-15. Prefixes shorten down to one value, where any threshold of 0.3 or more
reaches the target; below that :func:`links` refuses, since it would lose links.

*Classes* are the connected components of the links between sets, found by alternating star contractions over tables. Sets
are nodes by a hash of their digest, never by an id, which several texts may share; ids are looked up afterwards.

Defined results: texts without a word, null ones too, are copies of each other and link to nothing; rows with equal
id are each judged by their own text; the class id is the smallest document id in it (null ids are smallest and give a
null class id), so two classes may share an id; links count other sets, so exact copies are not links; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from decisionlake.llm.common import slices
from decisionlake.llm.lz_fingerprint import _mix, _powers
from decisionlake.session import cut

WIDTH = 5
THRESHOLD = 0.8
TREES, DEPTH = 24, 6
DEPTHS = range(1, DEPTH + 1)
TARGET = 0.9995
BLOCK = 512                               # members of a node that one side of a task has, about
SMALL_ROWS = 500_000                      # rows of (id, digest) that may be broadcast, about 20 MB
NO_ID = -(1 << 63)


# signatures -----------------------------------------------------------------------------------
def shingles(text: str, width: int = WIDTH):
    """The sorted distinct hashes of a text's shingles."""
    import numpy as np
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    blank = (codes == 0x20) | ((codes >= 0x09) & (codes <= 0x0D))
    edges = np.diff(np.concatenate([[True], blank, [True]]).astype(np.int8))
    starts, ends = np.flatnonzero(edges == -1), np.flatnonzero(edges == 1)
    if not len(starts):
        return np.empty(0, np.uint64)
    power, inverse = _powers(max(16, len(codes).bit_length()))
    total = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(_mix(codes.astype(np.uint64) + np.uint64(1)) * power[:len(codes)], out=total[1:])
    words = _mix((total[ends] - total[starts]) * inverse[starts])
    span = min(width, len(words))
    out = np.zeros(len(words) - span + 1, np.uint64)
    for i in range(span):
        out = _mix(out + words[i:len(words) - span + 1 + i] + np.uint64(0x9E3779B97F4A7C15))
    return np.unique(out)


@cache
def _seeds():
    import numpy as np
    odd = _mix(np.arange(1, TREES * DEPTH + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)
    return odd, _mix(odd)


def signature(hashes):
    """``TREES`` x ``DEPTH`` minimum hashes, each cut to 16 bits."""
    import numpy as np
    odd, flip = _seeds()
    best = np.full(len(odd), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 2048):
        part = hashes[at:at + 2048]
        best = np.minimum(best, ((part[None, :] ^ flip[:, None]) * odd[:, None]).min(axis=1))
    return (_mix(best) >> np.uint64(48)).astype(np.uint16)


def _node_keys(signatures, depth: int):
    """The key of the node at ``depth`` of every tree: a matrix of members x trees."""
    import numpy as np
    values = signatures.reshape(-1, TREES, DEPTH).astype(np.uint64)
    key = np.zeros(values.shape[:2], np.uint64)
    for i in range(depth):
        key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + values[:, :, i] + np.uint64(1))
    return key


def _shingled(with_set: bool):
    def run(batches):
        import hashlib

        import pyarrow as pa
        for b in slices(batches, 256):
            sets = [shingles(t or "") for t in b.column("text").to_pylist()]
            columns = [b.column("d"), b.column("th"), pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                       pa.array([len(s) for s in sets], pa.int32()),
                       pa.array([signature(s).tobytes() if len(s) else b"" for s in sets], pa.binary())]
            names = ["d", "th", "digest", "n", "sig"]
            if with_set:
                columns.append(pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary()))
                names.append("hashes")
            yield pa.RecordBatch.from_arrays(columns, names)
    return run


def _signatures(docs: DataFrame, with_set: bool = False) -> DataFrame:
    return docs.mapInArrow(_shingled(with_set), "d bigint, th bigint, digest binary, n int, sig binary" + ", hashes binary" * with_set)


def _small(df: DataFrame) -> DataFrame:
    """``df``, marked for broadcast if its rows are few enough; it must be cheap to count."""
    return F.broadcast(df) if df.count() <= SMALL_ROWS else df


def least_agreement(threshold: float) -> float:
    """The share of equal signature values below which no pair at the threshold falls."""
    return max(0.0, threshold - 9 * (threshold * (1 - threshold) / (TREES * DEPTH)) ** 0.5)


# nodes and tasks ------------------------------------------------------------------------------
def _nodes(depth: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa
        for b in slices(batches, 2048):
            sigs = np.frombuffer(b"".join(b.column("sig").to_pylist()), np.uint16)
            keys = _node_keys(sigs, depth).view(np.int64)
            rows = pa.array(np.repeat(np.arange(b.num_rows), TREES))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.tile(np.arange(TREES, dtype=np.int32), b.num_rows)), pa.array(keys.reshape(-1)),
                 b.column("rid").take(rows), b.column("digest").take(rows)], ["tree", "key", "rid", "digest"])
    return run


def _tasks(reps: DataFrame, depth: int) -> DataFrame:
    """(tree, key, lo, hi, blk, rid, digest): the members of every two blocks of every node that has two members or more."""
    members = reps.select("rid", "digest", "sig").mapInArrow(_nodes(depth), "tree int, key bigint, rid bigint, digest binary")
    shared = cut(members.groupBy("tree", "key").count().where("count > 1"))
    members = members.join(_small(shared), ["tree", "key"])
    blocks = F.ceil(F.col("count") / BLOCK).cast("int")
    placed = members.withColumn("blocks", blocks).withColumn("blk", F.pmod(F.hash("digest"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    return placed.select("tree", "key", "rid", "digest", "blk", other.alias("o")).select(
        "tree", "key", F.least("blk", "o").alias("lo"), F.greatest("blk", "o").alias("hi"), "blk", "rid", "digest")


TASK = ["tree", "key", "lo", "hi"]


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition(*TASK).sortWithinPartitions(*TASK, "rid", "digest")


def _groups(batches):
    """Tables of one task each, from rows in order of task."""
    import numpy as np
    import pyarrow as pa
    held, last = [], None
    for b in slices(batches, 4096):
        ids = np.stack([np.asarray(b.column(c)).astype(np.int64) for c in TASK])
        cuts = np.flatnonzero((ids[:, 1:] != ids[:, :-1]).any(axis=0)) + 1
        for a, z in zip([0, *cuts], [*cuts, b.num_rows], strict=True):
            task = tuple(ids[:, a])
            if held and task != last:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            held.append(b.slice(a, z - a))
            last = task
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _candidates(group, depth: int, before: int | None, least: float):
    """The pairs (i < j) of a task that are looked at here: the first tree where they agree, not at an earlier depth, likely."""
    import numpy as np
    sigs = np.frombuffer(b"".join(group.column("sig").to_pylist()), np.uint16).reshape(group.num_rows, -1)
    blk = np.asarray(group.column("blk"))
    i, j = np.triu_indices(len(sigs), 1)
    if group.column("lo")[0].as_py() != group.column("hi")[0].as_py():
        cross = blk[i] != blk[j]
        i, j = i[cross], j[cross]
    keep = []
    keys, old = _node_keys(sigs, depth), _node_keys(sigs, before) if before else None
    tree = group.column("tree")[0].as_py()
    for at in range(0, len(i), 4096):
        a, b = i[at:at + 4096], j[at:at + 4096]
        ok = keys[a, tree] == keys[b, tree]
        ok &= ~(keys[a, :tree] == keys[b, :tree]).any(axis=1)
        if before:
            ok &= ~(old[a] == old[b]).any(axis=1)
        ok &= (sigs[a] == sigs[b]).mean(axis=1) >= least
        keep.append(np.flatnonzero(ok) + at)
    keep = np.concatenate(keep) if keep else np.empty(0, np.int64)
    return i[keep], j[keep]


def _surviving(depth: int, before: int | None, least: float):
    def run(batches):
        import numpy as np
        import pyarrow as pa
        for group in _groups(batches):
            i, j = _candidates(group, depth, before, least)
            rows = np.unique(np.concatenate([i, j]))
            if len(rows):
                yield from group.drop_columns(["sig"]).take(pa.array(rows)).combine_chunks().to_batches()
    return run


def _common(sets, i, j):
    """How many hashes each pair of sets has in common."""
    import numpy as np
    if len(i) <= 4:
        return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i, j, strict=True)])
    values, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    total = np.zeros((len(sets), len(sets)), np.float32)
    for at in range(0, len(values), 4096):                  # the incidence matrix, a strip of columns at a time
        a, z = np.searchsorted(column, [at, at + 4096])
        strip = np.zeros((len(sets), min(4096, len(values) - at)), np.float32)
        strip[row[a:z], column[a:z] - at] = 1
        total += strip @ strip.T
    return total[i, j].astype(np.int64)


def chance(likeness, depth: int):
    """The chance that a pair of this likeness agrees on a prefix of ``depth`` in some tree."""
    return 1 - (1 - likeness ** depth) ** TREES


def _linked(threshold: float, depth: int, before: int | None):
    def run(batches):
        import numpy as np
        import pyarrow as pa
        for group in _groups(batches):
            i, j = _candidates(group, depth, before, least_agreement(threshold))
            sets = [np.frombuffer(x, "<u8") for x in group.column("hashes").to_pylist()]
            size = np.array([len(s) for s in sets])
            common = _common(sets, i, j)
            both = size[i] + size[j] - common
            near = common >= threshold * both - 1e-9
            i, j, likeness = i[near], j[near], (common / both)[near]
            if not len(i):
                continue
            ids = np.asarray(group.column("rid"))
            links = np.bincount(i, minlength=len(ids)) + np.bincount(j, minlength=len(ids))
            unseen = [np.bincount(i, 1 / chance(likeness, d) - 1, len(ids)) for d in DEPTHS]
            root = np.arange(len(ids))
            while True:                                     # the first row each member is linked to within the task
                was = root.copy()
                np.minimum.at(root, i, was[j])
                np.minimum.at(root, j, was[i])
                if (root == was).all():
                    break
            rows = np.flatnonzero(links)
            digests = group.column("digest").combine_chunks()
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[rows]), digests.take(pa.array(rows)), pa.array(links[rows].astype(np.int64)),
                 digests.take(pa.array(root[rows])), *[pa.array(u[rows]) for u in unseen]], ["rid", "digest", "links", "root", *[f"unseen{d}" for d in DEPTHS]])
    return run


# components -----------------------------------------------------------------------------------
def components(edges: DataFrame) -> DataFrame:
    """(node, root) of undirected ``edges`` (u, v): the smallest node of each component; nodes without edges are left out.

    Alternating large and small stars (Kiveris et al., 2014); a round is a few equi-joins and ends in a written table.
    """
    def hubs(pairs: DataFrame) -> DataFrame:
        return pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))

    e = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(hubs(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = hubs(down)
        small = (down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(least.select("u", F.col("m").alias("v")))).where("u <> v").distinct()
        e = cut(small)
        now = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        mark = now


# the join -------------------------------------------------------------------------------------
def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("d"), F.xxhash64("text").alias("th"), "text")


def links(docs: DataFrame, reps: DataFrame, threshold: float = THRESHOLD, target: float = TARGET) -> DataFrame:
    """(rid, digest, links, root) of every task's linked members, over all depths that were needed; ``root`` is a digest."""
    if chance(threshold, 1) < target:
        raise ValueError(f"{TREES} trees do not reach a recall of {target} at a threshold of {threshold}")
    found, before, depth, rows = None, None, DEPTH, _rows(docs)
    while True:
        tasks = _tasks(reps, depth).join(reps.select("rid", "digest", "sig"), ["rid", "digest"])
        kinds = "rid bigint, digest binary, tree int, key bigint, lo int, hi int, blk int"
        tasks = cut(_dealt(tasks.select("rid", "digest", *TASK, "blk", "sig")).mapInArrow(_surviving(depth, before, least_agreement(threshold)), kinds))
        wanted = cut(tasks.select(F.col("rid").alias("d"), "digest").distinct())
        ids = _small(wanted.select("d").distinct())
        sets = _signatures(rows.join(ids, "d", "left_semi"), True).join(_small(wanted), ["d", "digest"], "left_semi").dropDuplicates(["d", "digest"])
        full = tasks.join(sets.select(F.col("d").alias("rid"), "digest", "sig", "hashes"), ["rid", "digest"])
        got = cut(_dealt(full.select("rid", "digest", *TASK, "blk", "sig", "hashes")).mapInArrow(
            _linked(threshold, depth, before), "rid bigint, digest binary, links bigint, root binary, " + ", ".join(f"unseen{d} double" for d in DEPTHS)))
        found = got if found is None else found.unionByName(got)
        total, unseen = found.agg(F.coalesce(F.sum("links"), F.lit(0)) / 2, F.coalesce(F.sum(f"unseen{depth}"), F.lit(0.0))).first()
        estimate = total / (total + unseen) if total else 1.0
        if depth == 1 or chance(threshold, depth) >= target and estimate >= target:
            return found.select("rid", "digest", "links", "root")
        before, depth = depth, depth - 1


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, target: float = TARGET) -> DataFrame:
    """(doc_id, class_id, n_links, n_copies) of every row of ``docs`` (doc_id, text).

    ``n_links`` counts the other distinct shingle sets that are near, ``n_copies`` the rows with the same set.
    """
    marked = _marked(docs, threshold, target)
    back = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return marked.select(back("d").alias("doc_id"), back("class").alias("class_id"), "n_links", "n_copies")


def _marked(docs: DataFrame, threshold: float, target: float) -> DataFrame:
    """(d, th, node, class, n_links, n_copies) of every row; ``node`` tells classes apart and is null for a row that is alone."""
    members = cut(_signatures(_rows(docs)))
    reps = cut(members.groupBy("digest").agg(F.min("d").alias("rid"), F.count(F.lit(1)).alias("n_copies"), F.first("n").alias("n"), F.first("sig").alias("sig")))
    found = links(docs, reps.where("n > 0"), threshold, target)
    degree = found.groupBy("rid", "digest").agg(F.sum("links").alias("n_links"))
    roots = components(found.select(F.xxhash64("digest").alias("u"), F.xxhash64("root").alias("v")))
    # most documents are alone: only the others meet their class
    classes = cut(reps.select("digest", "rid", "n_copies", F.xxhash64("digest").alias("node")).join(degree, ["rid", "digest"], "left")
                  .where("n_links > 0 OR n_copies > 1").join(roots, "node", "left")
                  .select("digest", "rid", F.coalesce("root", "node").alias("node"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "n_copies"))
    least = cut(classes.groupBy("node").agg(F.min("rid").alias("class")))
    classes = cut(classes.drop("rid").join(_small(least), "node"))
    return members.join(_small(classes), "digest", "left").select(
        "d", "th", "node", F.coalesce("class", "d").alias("class"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"))


def keep_one(docs: DataFrame, threshold: float = THRESHOLD, target: float = TARGET) -> DataFrame:
    """``docs`` with one row of each class: the one with the smallest id, and of texts under one id that of the smallest hash.

    All columns stay. Rows that repeat both id and text are one.
    """
    marked = cut(_marked(docs, threshold, target).where("node IS NOT NULL").select("d", "th", "node"))
    first = cut(marked.groupBy("node").agg(F.min("d").alias("d"), F.min_by("th", F.struct("d", "th")).alias("th")))
    rows = marked.groupBy("d", "th").count().join(_small(first.select("d", "th", F.lit(True).alias("kept"))), ["d", "th"], "left")
    rows = cut(rows.where("kept IS NULL OR count > 1"))
    gone, twice = rows.where("kept IS NULL").select("d", "th"), rows.where("kept").select("d", "th")
    own = docs.select(F.struct("*").alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("d"), F.xxhash64("text").alias("th"))
    kept = own.join(_small(gone), ["d", "th"], "left_anti")          # no column of docs can clash
    if twice.isEmpty():
        return kept.select("row.*")
    small = _small(twice)
    once = kept.join(small, ["d", "th"], "left_semi").dropDuplicates(["d", "th"])
    return kept.join(small, ["d", "th"], "left_anti").unionByName(once).select("row.*")
