"""SimHash near-duplicates: tiled exact comparison of fingerprints by exclusive-or and bit counts.

*Fingerprint.* The words of a text (``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased) are cut into ``WIDTH``-word shingles, repeats
included; a bit of the fingerprint is set if more than half of the shingles' XXH64 (UTF-8, seed ``SEED``) have it set. A
shorter text is one shingle; a text without a word has the fingerprint zero and is linked like any other.

*Tiles.* Only distinct fingerprints are compared. A tile is a run of at most ``TILE`` fingerprints ordered by population
count, held as one binary row. Two tiles are compared in full, by numpy exclusive-or and bit counts; a pair of tiles is
skipped if the ranges of their population counts are further apart than the radius, which no linked pair can be. A grid of
all tiles would grow with the square of the corpus, so tiles are cut along bands: the 64 bits are dealt into radius + 1
bands, and two fingerprints within the radius have one band in common, whichever bits differ. Every tile lies in one value of one
band and meets the tiles of that value only. Nothing is lost, and the work falls by 2^(64 / (radius + 1)) over bands.

*Hot values.* The cut into tiles is by range, so a value that many fingerprints share is spread over tasks. Tile pairs are found
on the tiles' numbers alone and dealt by pair; fingerprints travel only inside their tile. A comparison returns each
linked fingerprint with the smallest one it is connected to inside the two tiles, never its pairs.

*Components* come from alternating star contractions over tables; ids are looked up afterwards.

Bounds: a task holds two tiles of ``TILE`` fingerprints and a strip of ``STRIP`` x ``TILE`` comparisons; a text is read
whole, its shingles ``CHUNK`` at a time. Nothing is collected; the table of linked or repeated fingerprints is broadcast only below
``SMALL_ROWS``, after a count.

Defined results: a null text is empty; rows with equal id are each judged by their own text; the component id is the smallest
id reachable that is not null, and null if all are; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from decisionlake.llm.common import slices
from decisionlake.llm.ngram_join import components
from decisionlake.session import cut

WIDTH, SEED = 4, 42
RADIUS = 4
TILE = 1024                               # fingerprints of one tile
STRIP = 256                               # rows of a tile that are compared at once
CHUNK = 1 << 15                           # shingles of one text that are counted at once
TILES_A_TASK = 256                        # tiles of one cutting task, about
SMALL_ROWS = 500_000                      # rows of (fingerprint, class) that may be broadcast, about 12 MB


# fingerprints ---------------------------------------------------------------------------------
def fingerprint(text: bytes, width: int = WIDTH, seed: int = SEED) -> int:
    """The fingerprint of one UTF-8 text, unsigned."""
    import numpy as np
    from xxhash import xxh64_intdigest
    words = text.lower().split()                            # bytes: A-Z only, and exactly the six blanks
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    span = min(width, len(words))
    n = len(words) - span + 1
    starts, stops = np.concatenate([[0], ends[:n - 1] + 1]).tolist(), ends[span - 1:].tolist()
    set_bits = np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        many = [joined[a:z] for a, z in zip(starts[at:at + CHUNK], stops[at:at + CHUNK], strict=True)]
        hashes = np.array([xxh64_intdigest(x, seed) for x in many], "<u8")
        set_bits += np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * set_bits > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, width: int = WIDTH, seed: int = SEED) -> DataFrame:
    """(doc_id, fp) of every row of ``docs`` (doc_id, text); ``fp`` has the 64 bits as a signed long."""
    def run(batches):
        import numpy as np
        import pyarrow as pa
        for b in slices(batches):
            texts = b.column("text").cast(pa.binary()).to_pylist()
            fps = np.array([fingerprint(t or b"", width, seed) for t in texts], "<u8").view("<i8")
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps)], ["doc_id", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, fp bigint")


# tiles ----------------------------------------------------------------------------------------
def bands(radius: int) -> list[tuple[int, int]]:
    """(first bit, bits) of the radius + 1 bands."""
    edges = [64 * i // (radius + 1) for i in range(radius + 2)]
    return [(a, z - a) for a, z in zip(edges, edges[1:])]


def _cut_tiles(size: int):
    """Rows in order of (band, value, ones) to tiles of at most ``size`` fingerprints."""
    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext
        number, task = 0, TaskContext.get().partitionId()
        held, last = [], None

        def tiles():
            nonlocal held, number
            fps, ones = (np.concatenate(x) for x in zip(*held, strict=True))
            held = []
            for at in range(0, len(fps), size):
                part = fps[at:at + size]
                yield (*last, (task << 33) + number, int(ones[at]), int(ones[at:at + size][-1]), len(part), part.astype("<u8").tobytes())
                number += 1

        names = ["band", "value", "tile", "least", "most", "n", "fps"]
        kinds = pa.schema(list(zip(names, [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()], strict=True)))
        out = []
        for b in slices(batches, 4096):
            keys = np.stack([np.asarray(b.column(c)).astype(np.int64) for c in ("band", "value")])
            fps, ones = np.asarray(b.column("fp")).view(np.uint64), np.asarray(b.column("ones"))
            cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            for a, z in zip([0, *cuts], [*cuts, b.num_rows], strict=True):
                key = tuple(keys[:, a].tolist())
                if held and (key != last or sum(len(x) for x, _ in held) >= size * 8):
                    out.extend(tiles())
                held.append((fps[a:z], ones[a:z]))
                last = key
            if len(out) >= 1024:
                yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], schema=kinds)
                out = []
        if held:
            out.extend(tiles())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], schema=kinds)
    return run


def tiles(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(band, value, tile, least, most, n, fps) of distinct fingerprints ``fp``, written once."""
    f = F.col("fp")
    value = lambda at, bits: f if bits == 64 else F.shiftrightunsigned(f, at).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))
    each = F.array(*[F.struct(F.lit(i).alias("band"), value(*band).alias("value")) for i, band in enumerate(bands(radius))])
    rows = fps.select("fp", F.bit_count(f).cast("int").alias("ones"), F.explode(each).alias("at")).select("at.band", "at.value", "ones", "fp")
    n = max(fps.sparkSession.sparkContext.defaultParallelism, fps.count() * len(bands(radius)) // (TILES_A_TASK * TILE) + 1)
    return cut(rows.repartitionByRange(n, "band", "value", "ones", "fp").sortWithinPartitions("band", "value", "ones", "fp")
               .mapInArrow(_cut_tiles(TILE), "band int, value bigint, tile bigint, least int, most int, n int, fps binary"))


def near(a, b, radius: int):
    """The places (i in a, j in b) of fingerprints that differ in at most ``radius`` bits."""
    import numpy as np
    left, right = [], []
    for at in range(0, len(a), STRIP):
        i, j = np.nonzero(np.bitwise_count(a[at:at + STRIP, None] ^ b[None, :]) <= radius)
        left.append(i + at)
        right.append(j)
    return np.concatenate(left), np.concatenate(right)


def _roots(n: int, i, j):
    """The smallest place each of ``n`` places is connected to by the pairs (i, j)."""
    import numpy as np
    root = np.arange(n)
    while True:
        was = root.copy()
        np.minimum.at(root, i, was[j])
        np.minimum.at(root, j, was[i])
        root = root[root]
        if (root == was).all():
            return root


def _compared(radius: int, two: bool):
    """Linked fingerprints of one tile or of two, each with the first one it is connected to there."""
    def run(batches):
        import numpy as np
        import pyarrow as pa
        for b in slices(batches, 256):
            us, vs = [], []
            for one, other in zip(b.column("fps").to_pylist(), b.column("fps2").to_pylist() if two else [None] * b.num_rows, strict=True):
                x = np.frombuffer(one, "<u8")
                y = np.frombuffer(other, "<u8") if two else x
                i, j = near(x, y, radius)
                if two:
                    both, j = np.concatenate([x, y]), j + len(x)
                else:
                    both, i, j = x, i[i < j], j[i < j]
                if len(i):
                    root = _roots(len(both), i, j)
                    linked = np.flatnonzero(root != np.arange(len(both)))
                    us.append(both[linked])
                    vs.append(both[root[linked]])
            if us:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (us, vs)], ["u", "v"])
    return run


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(u, v) of distinct fingerprints ``fp``: enough links to connect all that are within ``radius`` bits of each other."""
    cells = tiles(fps, radius)
    own = cells.where("n > 1").select("fps").mapInArrow(_compared(radius, False), "u bigint, v bigint")
    marks = cells.select("band", "value", "tile", "least", "most")
    a, b = marks.alias("a"), marks.alias("b")
    pairs = a.join(b, (F.col("a.band") == F.col("b.band")) & (F.col("a.value") == F.col("b.value")) & (F.col("a.tile") < F.col("b.tile"))
                   & (F.col("b.least") <= F.col("a.most") + radius) & (F.col("a.least") <= F.col("b.most") + radius))
    pairs = cut(pairs.select(F.col("a.tile").alias("tile"), F.col("b.tile").alias("tile2")))
    both = pairs.join(cells.select("tile", "fps"), "tile").join(cells.select(F.col("tile").alias("tile2"), F.col("fps").alias("fps2")), "tile2")
    across = both.select("fps", "fps2").mapInArrow(_compared(radius, True), "u bigint, v bigint")
    return own.unionByName(across).distinct()


# documents ------------------------------------------------------------------------------------
def _small(df: DataFrame) -> DataFrame:
    """``df``, marked for broadcast if its rows are few enough; it must be cheap to count."""
    return F.broadcast(df) if df.count() <= SMALL_ROWS else df


def near_duplicates(docs: DataFrame, radius: int = RADIUS, width: int = WIDTH, seed: int = SEED) -> DataFrame:
    """(doc_id, fp, component_id) of every row of ``docs`` (doc_id, text)."""
    rows = cut(fingerprints(docs, width, seed))
    fps = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")))
    roots = components(links(fps.select("fp"), radius))
    # most fingerprints are alone and met once: only the others are looked up
    classes = fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").where("root IS NOT NULL OR n > 1")
    classes = cut(classes.select("fp", F.coalesce("root", "fp").alias("root"), "first"))
    least = cut(classes.groupBy("root").agg(F.min("first").alias("component_id")))
    known = cut(classes.join(_small(least), "root").select("fp", "component_id", F.lit(True).alias("known")))
    return rows.join(_small(known), "fp", "left").select(
        "doc_id", "fp", F.when(F.col("known"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def digest(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row, the fingerprint as 16 hexadecimal digits."""
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
