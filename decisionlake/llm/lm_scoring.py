"""Text scores by online logistic mixing of hashed-context bit predictors, trained on the corpus.

*Binary decisions.* A token falls into one of ``BUCKETS`` by its hash and a bucket is spelled in bits by a Huffman code of the
training counts; which token of the bucket it is follows from the training counts too. So a text is a row of bits, each at
a node of the code tree, and its probability is a product of bit probabilities and in-bucket shares.

*Predictors.* For every bit there are three: the node alone, the node after the last token, and the node after the last two. The
last two live in hashed tables of ``SLOTS`` places; a node owns places in proportion to its training count, so contexts only
collide at one node and a collision falls back to that node's mean.

*Mixing.* The logits of the predictors are added with weights from a set chosen (gated) by how often both contexts were
seen. Weights start where plain backing off would put them and follow the gradient of the coding cost through the text; a
table of refined probabilities (an adaptive probability map) does the same for the mixed result. Both begin anew with each
text and change after every ``SEGMENT`` tokens, so a score depends on the text and the corpus alone, not on how Spark
deals rows. Texts of a batch are mixed side by side.

*On Spark.* Token counts are summed by hash over all training texts; the context tables are summed block by block, each task
sending what it saw; tables, code and the ``COMMON`` most frequent tokens have a fixed size and are broadcast. Counts of
all other tokens come by an equi-join on their hash.

Tokens are told apart by a 64-bit hash. Defined results: a null text is empty (only the end token); an empty training
set gives every token the share 1 / (N + V + 1) = 1; repeated rows are scored each; null ids are never held out; other
columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from decisionlake.llm.common import slices
from decisionlake.session import cut

# --- fixed values: the task -------------------------------------------------------------------
FOLDS, HELD_OUT = 7, 2                    # crc32(doc_id) mod FOLDS = HELD_OUT is held out

BUCKETS = 1 << 10
SLOTS = 1 << 21                           # places in each table of contexts
BLOCK = 1 << 14                           # places that are summed together
ORDERS = 2
COMMON = 1 << 19                          # tokens whose counts are broadcast, at most: 8 MB
SEGMENT = 32                              # tokens between updates
PIECE = 1 << 15                           # tokens of a text that are laid out at once
BATCH = 128
BACKING = (24.0, 48.0)                    # a context counts half once it was seen so often
RATE = 0.004                              # of the weights
MAP_BINS, MAP_RATE, MAP_SHARE = 33, 0.02, 0.25
SEEN = (0, 1, 2, 4, 8, 16, 32)            # how often a context was seen, in classes
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
END = b" "                                # no word holds a blank
KEPT_WORDS = 1 << 19


def is_held_out(doc_id) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % FOLDS == HELD_OUT


class Hasher:
    """Token hashes of texts; known words are kept, within a bound."""

    def __init__(self):
        import numpy as np
        import xxhash
        self._hash, self._known, self._hashes = xxhash.xxh64_intdigest, {}, np.empty(KEPT_WORDS, np.uint64)

    def __call__(self, texts: list[str | None]):
        """One array of hashes a text, the end token included."""
        import numpy as np
        known, out = self._known, []
        for t in texts:
            words = (t or "").encode().translate(LOWER).split()
            words.append(END)
            at = list(map(known.get, words))
            if None in at:
                new = [w for w, i in zip(words, at, strict=True) if i is None]
                if len(known) + len(new) > KEPT_WORDS:
                    known.clear()
                    new = words
                if len(new) > KEPT_WORDS:
                    out.append(np.fromiter(map(self._hash, words), np.uint64, len(words)))
                    continue
                for w in new:
                    if w not in known:
                        self._hashes[len(known)] = self._hash(w)
                        known[w] = len(known)
                at = list(map(known.get, words))
            out.append(self._hashes[at])
        return out


_HASHER: list[Hasher] = []


def _hasher() -> Hasher:
    if not _HASHER:
        _HASHER.append(Hasher())
    return _HASHER[0]


def _mix(x):
    import numpy as np
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


# token counts -----------------------------------------------------------------------------------
def token_counts(docs: DataFrame) -> DataFrame:
    """(h, c): how often each token is in the training texts."""
    def run(batches):
        import numpy as np
        import pyarrow as pa
        hashed, held, size = _hasher(), [], 0

        def counted():
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(counts)], ["h", "c"])

        for b in slices(batches):
            texts = [t for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True) if not is_held_out(d)]
            found = hashed(texts) if texts else []
            held += found
            size += sum(map(len, found))
            if size > 1 << 22:
                yield counted()
                held, size = [], 0
        if held:
            yield counted()

    return docs.select("doc_id", "text").mapInArrow(run, "h bigint, c bigint").groupBy("h").agg(F.sum("c").alias("c"))


class Code:
    """A Huffman code of buckets, and the places its nodes own in a context table."""

    def __init__(self, counts: list[int]):
        import numpy as np
        n = len(counts)
        heap = [(c + 1, i) for i, c in enumerate(counts)]
        heapq.heapify(heap)
        weight, parent, side = [c + 1 for c in counts], [0] * (2 * n - 1), [0] * (2 * n - 1)
        ones = [0] * (n - 1)
        for k in range(n, 2 * n - 1):
            (a, i), (b, j) = heapq.heappop(heap), heapq.heappop(heap)
            parent[i] = parent[j] = k
            side[j] = 1
            weight.append(a + b)
            ones[k - n] = b
            heapq.heappush(heap, (a + b, k))
        nodes, bits, starts = [], [], [0]
        for i in range(n):
            path, at = [], i
            while at != 2 * n - 2:
                path.append((parent[at] - n, side[at]))
                at = parent[at]
            for node, bit in reversed(path):
                nodes.append(node)
                bits.append(bit)
            starts.append(len(nodes))
        self.nodes, self.bits, self.starts = np.array(nodes, np.int32), np.array(bits, np.uint8), np.array(starts)
        total = np.array(weight[n:], np.float64)
        p = np.array(ones) / total
        self.logit = np.log(p / (1 - p)).astype(np.float32)
        share = np.maximum(1, np.floor(total / total.sum() * (SLOTS - n))).astype(np.int64)
        self.places = share.astype(np.uint64)
        self.spread = np.arange(n - 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        self.base = np.concatenate([[0], np.cumsum(share)[:-1]]).astype(np.int64)

    def spell(self, buckets):
        """(token, node, bit) of every bit of a row of tokens."""
        import numpy as np
        first, size = self.starts[buckets], self.starts[buckets + 1] - self.starts[buckets]
        token = np.repeat(np.arange(len(buckets)), size)
        at = np.arange(len(token)) + np.repeat(first - np.cumsum(size) + size, size)
        return token, self.nodes.take(at), self.bits.take(at)

    def slot(self, context, node):
        """The place of (context, node); ``context`` is mixed already."""
        import numpy as np
        spread = _mix(context + self.spread.take(node)) >> np.uint64(32)
        return self.base.take(node) + ((spread * self.places.take(node)) >> np.uint64(32)).astype(np.int64)


def contexts(hashes, before):
    """The contexts of order 1 and 2 of texts in a row: their tokens, and the two tokens before each text's first."""
    import numpy as np
    sizes = [len(h) for h in hashes]
    begins = np.cumsum([0, *sizes[:-1]])
    first = np.array(before, np.uint64).reshape(-1, 2)
    flat = np.concatenate(hashes)
    last = np.empty_like(flat)
    last[1:], last[begins] = flat[:-1], first[:, 1]
    second = np.empty_like(flat)
    second[1:] = last[:-1]
    second[begins] = first[:, 0]
    one = _mix(last + np.uint64(0x51ED270B7F4A7C15))
    return one, _mix(one + second * np.uint64(0xA0761D6478BD642F))


def pieces(texts: list, at: int):
    """Of the texts that are longer than ``at`` tokens: their numbers, their tokens from there, and those tokens' contexts."""
    rows = [i for i, h in enumerate(texts) if len(h) > at]
    parts = [texts[i][at:at + PIECE] for i in rows]
    return rows, parts, contexts(parts, [(texts[i][at - 2], texts[i][at - 1]) if at else (1, 1) for i in rows])


# context tables -----------------------------------------------------------------------------------
def context_tables(docs: DataFrame, code) -> DataFrame:
    """(order, block, logit, seen): the trained tables; ``code`` is a broadcast :class:`Code`."""
    def collect(batches):
        import numpy as np
        import pyarrow as pa
        hashed, spelled = _hasher(), code.value
        counts = np.zeros((ORDERS, SLOTS, 2), np.int32)
        seen_any = False
        for b in slices(batches, BATCH):
            texts = [t for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True) if not is_held_out(d)]
            tokens = hashed(texts) if texts else []
            for piece in range(0, max(map(len, tokens), default=0), PIECE):
                parts, both = pieces(tokens, piece)[1:]
                token, node, bit = spelled.spell((np.concatenate(parts) & np.uint64(BUCKETS - 1)).astype(np.int64))
                for order in range(ORDERS):
                    np.add.at(counts[order].reshape(-1), spelled.slot(both[order].take(token), node) * 2 + bit, np.int32(1))
                seen_any = True
        if seen_any:
            for order in range(ORDERS):
                for block in range(SLOTS // BLOCK):
                    part = counts[order, block * BLOCK:(block + 1) * BLOCK]
                    if part.any():
                        raw = np.ascontiguousarray(part.reshape(-1)).view(np.uint8).reshape(-1, 4).T.tobytes()    # bytes of one weight together
                        yield pa.RecordBatch.from_pydict({"order": pa.array([order], pa.int32()), "block": pa.array([block], pa.int32()),
                                                          "data": pa.array([pa.compress(raw, codec="zstd", asbytes=True)], pa.binary())})

    def added(batches):
        import numpy as np
        import pyarrow as pa
        last, total = None, None

        def done():
            n0, n1 = total.reshape(-1, 2).T.astype(np.float64)
            seen = np.searchsorted(SEEN, n0 + n1, side="right") - 1
            return pa.RecordBatch.from_pydict({
                "order": pa.array([last[0]], pa.int32()), "block": pa.array([last[1]], pa.int32()),
                "logit": pa.array([np.log((n1 + 0.4) / (n0 + 0.4)).astype(np.float16).tobytes()], pa.binary()),
                "seen": pa.array([seen.astype(np.uint8).tobytes()], pa.binary())})

        for b in batches:
            for row in b.to_pylist():
                key = (row["order"], row["block"])
                if key != last:
                    if last is not None:
                        yield done()
                    last, total = key, np.zeros(BLOCK * 2, np.int64)
                raw = pa.decompress(row["data"], decompressed_size=BLOCK * 8, codec="zstd", asbytes=True)
                total += np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view(np.int32).reshape(-1)
        if last is not None:
            yield done()

    parts = docs.select("doc_id", "text").mapInArrow(collect, "order int, block int, data binary")
    return parts.repartition("order", "block").sortWithinPartitions("order", "block").mapInArrow(
        added, "order int, block int, logit binary, seen binary")


# mixing ---------------------------------------------------------------------------------------
def _first_weights():
    """Per gate (seen class of either context), the weights of backing off: node, order 1, order 2."""
    import numpy as np
    n = np.array([0, 1, 2.5, 5.5, 11.5, 23.5, 96.0])
    two = n[None, :] / (n[None, :] + BACKING[1])
    one = (1 - two) * (n[:, None] / (n[:, None] + BACKING[0]))
    return np.stack([1 - one - two, one, two + np.zeros_like(one)], axis=-1).reshape(-1, 3).astype(np.float32)


def packed(logit, seen):
    """A table's logits and classes as one number a place, so that a place is one read."""
    import numpy as np
    return (seen.astype(np.uint32) << np.uint32(16)) | logit.view(np.uint16)


def unpacked(places):
    import numpy as np
    return places.astype(np.uint16).view(np.float16), (places >> np.uint32(16)).astype(np.int64)


def _numbered(keys, size: int):
    """Which of ``size`` rows are used, the number of each key among them, and how many: all rows where keys are many."""
    import numpy as np
    if len(keys) * 8 >= size:
        return slice(None), keys, size
    used, at = np.unique(keys, return_inverse=True)
    return used, at, len(used)


def mixed_score(model: dict, texts: list):
    """The natural logarithm of each text's bits under the model; ``texts`` are token hashes."""
    import numpy as np
    code, tables = model["code"], model["tables"]
    start = _first_weights()
    gates = len(start)
    weights = np.tile(start, (len(texts), 1))                          # (text, gate) x predictor
    centres = np.linspace(-8, 8, MAP_BINS)
    refined = np.tile((1 / (1 + np.exp(-centres))).astype(np.float32), len(texts))      # (text, bin)
    score = np.zeros(len(texts))
    longest = max(map(len, texts), default=0)
    for piece in range(0, longest, PIECE):
        rows, parts, (one, two) = pieces(texts, piece)
        owner = np.repeat(rows, [len(p) for p in parts])
        segment = np.concatenate([np.arange(len(p)) // SEGMENT for p in parts])
        order = np.argsort(segment, kind="stable")                     # tokens by segment, texts side by side
        one, two, owner, segment = one[order], two[order], owner[order], segment[order]
        token, node, bit = code.spell((np.concatenate(parts)[order] & np.uint64(BUCKETS - 1)).astype(np.int64))
        s1, s2 = code.slot(one.take(token), node), code.slot(two.take(token), node)
        x = np.empty((len(node), 3), np.float32)
        x[:, 0] = code.logit.take(node)
        x[:, 1], seen_one = unpacked(tables[0].take(s1))
        x[:, 2], seen_two = unpacked(tables[1].take(s2))
        owner, bit = owner.take(token), bit.astype(np.float32)
        gate = owner * gates + (seen_one * len(SEEN) + seen_two)
        edges = np.searchsorted(segment[token], np.arange(int(segment[-1]) + 2))
        for a, z in zip(edges[:-1], edges[1:], strict=True):
            g, xs, y, who = gate[a:z], x[a:z], bit[a:z], owner[a:z]
            mixed = np.clip(np.einsum("ij,ij->i", weights.take(g, axis=0), xs), -8, 8)
            p = 1 / (1 + np.exp(-mixed))
            cell = who * MAP_BINS + np.rint((mixed + 8) * ((MAP_BINS - 1) / 16)).astype(np.int64)
            known = refined.take(cell)
            final = (1 - MAP_SHARE) * p + MAP_SHARE * known
            score += np.bincount(who, np.log(np.abs(1 - y - final)), len(texts))      # of the bit that came
            error = y - p
            used, at, n = _numbered(g, len(weights))
            for k in range(3):
                weights[used, k] += RATE * np.bincount(at, error * xs[:, k], n)
            used, at, n = _numbered(cell, len(refined))
            seen_here = np.maximum(np.bincount(at, minlength=n), 1)
            drift = np.bincount(at, y - known, n) / seen_here
            refined[used] += (1 - (1 - MAP_RATE) ** seen_here) * drift
    return score


def score_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) of ``docs`` (doc_id, text).

    Scores are base-10 logarithms of the text's probability.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    counts = cut(token_counts(docs))
    by_bucket = {r.b: r for r in counts.groupBy(F.col("h").bitwiseAND(F.lit(BUCKETS - 1)).alias("b")).agg(
        F.sum("c").alias("tokens"), F.count(F.lit(1)).alias("kinds")).collect()}
    train, kinds = sum(r.tokens for r in by_bucket.values()), sum(r.kinds for r in by_bucket.values())
    # the most frequent tokens, whole powers of two of the count, as many as the bound allows
    levels = counts.groupBy(F.floor(F.log2("c")).alias("k")).count().orderBy(F.desc("k")).collect()
    least, room = None, COMMON
    for r in levels:
        room -= r["count"]
        if room < 0:
            break
        least = 1 << r.k
    common = counts.where(F.col("c") >= least).toPandas() if least is not None else None

    import numpy as np
    code = Code([by_bucket[b].tokens if b in by_bucket else 0 for b in range(BUCKETS)])
    shared_code = spark.sparkContext.broadcast(code)
    logit, seen = np.zeros((ORDERS, SLOTS), np.float16), np.zeros((ORDERS, SLOTS), np.uint8)
    for r in context_tables(docs, shared_code).toLocalIterator():
        at = slice(r.block * BLOCK, (r.block + 1) * BLOCK)
        logit[r.order, at], seen[r.order, at] = np.frombuffer(r.logit, np.float16), np.frombuffer(r.seen, np.uint8)
    h = np.array([], np.uint64) if common is None else common.h.to_numpy().view(np.uint64)
    order = np.argsort(h)
    inside = np.array([by_bucket[b].tokens + by_bucket[b].kinds + 1 if b in by_bucket else 1 for b in range(BUCKETS)])
    model = spark.sparkContext.broadcast({
        "code": code, "tables": packed(logit, seen), "h": h[order], "c": np.array([] if common is None else common.c)[order],
        "inside": np.log10(inside)})

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        m, hashed, row = model.value, _hasher(), TaskContext.get().partitionId() << 40
        for b in slices(batches):
            texts = b.column("text").to_pylist()
            tokens = hashed(texts)
            bits = np.empty(len(tokens))
            by_length = sorted(range(len(tokens)), key=lambda i: len(tokens[i]))
            for at in range(0, len(tokens), BATCH):                     # texts of like length side by side
                group = by_length[at:at + BATCH]
                bits[group] = mixed_score(m, [tokens[i] for i in group]) / np.log(10)
            known, logs, share, rare_h, rare_n = [], [], [], [], []
            for t in tokens:
                share.append(float(m["inside"][(t & np.uint64(BUCKETS - 1)).astype(np.int64)].sum()))
                at = np.minimum(np.searchsorted(m["h"], t), max(len(m["h"]) - 1, 0))
                hit = m["h"][at] == t if len(m["h"]) else np.zeros(len(t), bool)
                known.append(int(hit.sum()))
                logs.append(float(np.log10(m["c"][at[hit]] + 1).sum()) if len(m["h"]) else 0.0)
                values, n = np.unique(t[~hit], return_counts=True)
                rare_h.append(values.view(np.int64))
                rare_n.append(n)
            ids = b.column("doc_id")
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(row, row + len(texts))), ids, pa.array([is_held_out(d) for d in ids.to_pylist()]),
                 pa.array([len(t) for t in tokens], pa.int64()), pa.array([len((t or "").encode()) for t in texts], pa.int64()),
                 pa.array(known, pa.int64()), pa.array(logs), pa.array(bits - np.array(share)),
                 pa.array(rare_h, pa.list_(pa.int64())), pa.array(rare_n, pa.list_(pa.int64()))],
                ["row", "doc_id", "held_out", "n_tokens", "n_bytes", "known", "logs", "bits", "rare", "times"])
            row += len(texts)

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = cut(docs.mapInArrow(run, f"row bigint, doc_id {kind}, held_out boolean, n_tokens bigint, n_bytes bigint, known bigint, "
                                      "logs double, bits double, rare array<bigint>, times array<bigint>"))
    rare = scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("h"), F.col("x.times").alias("times"))
    rest = counts.where(F.col("c") < least) if least is not None else counts
    found = rare.join(rest, "h").groupBy("row").agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("more_logs"))
    logs = F.col("logs") + F.coalesce("more_logs", F.lit(0.0))
    score = F.col("bits") + logs
    return scored.drop("rare", "times").join(found, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(train).cast("long").alias("train_tokens"),
        (logs - F.col("n_tokens") * F.log10(F.lit(float(train + kinds + 1)))).alias("base_score"), score.alias("score"),
        F.when(F.col("n_bytes") > 0, -score * F.lit(float(np.log2(10))) / F.col("n_bytes")).alias("bits_per_byte"))
