"""Best-fit packing of token sequences with a bounded number of open bins.

Documents are encoded and ended, cut into pieces of at most ``capacity`` only where they are longer, and the pieces
(not the ids) are dealt evenly over packers. A packer keeps at most ``open_bins`` bins open, in a bitset keyed by free
space: the lowest set bit at or above a piece's length is the best fit. When a new bin is needed and all are open, the
fullest closes first. Pieces arrive in blocks; a block is placed longest first, so that small pieces fill what large
ones leave. Memory is one block and the open bins, whatever the input's size. A packer makes about 2,000 bins and closes about
one in four early, nearly all of them full but for a few tokens; blocks much longer than ``open_bins`` would close bins that
short pieces of the same block could still fill.

The number of packers follows the total of tokens and pieces, so that the few half-empty bins each leaves at its end
stay below a thousandth of all bins, and one input gives the same bins at any cluster size.

Defined results: a null text is empty (one piece with the end id alone); repeated rows are packed each on its own; an
empty table packs to nothing; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from decisionlake.llm.common import WordEncoder, slices, vocabulary, worker_encoder
from decisionlake.session import cut

CAPACITY = 2048
END_ID = 0
OPEN_BINS = 512
PACKER_TOKENS = 1 << 22                   # tokens a packer gets, about; about 2,000 bins
PACKER_PIECES = 1 << 18
BLOCK = 1024                              # pieces a packer sorts at a time
PIECES = "doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint"


def _pieces(tokenizer: str, capacity: int, end_id: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa
        encoder = worker_encoder(WordEncoder, tokenizer)
        end = np.asarray([end_id], "<u4").tobytes()
        width = capacity * 4
        for b in slices(batches):
            row, piece, start, length, crc = [], [], [], [], []
            all_ids, begins = encoder.encode_column(b.column("text"))
            for i, (a, z) in enumerate(zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True)):
                ids = all_ids[a:z].tobytes() + end
                for k, at in enumerate(range(0, len(ids), width)):
                    part = ids[at:at + width]
                    row.append(i)
                    piece.append(k)
                    start.append(at >> 2)
                    length.append(len(part) >> 2)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                 pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32"])
    return run


def cut_pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """The pieces of ``docs`` (doc_id, text): (doc_id, piece, start, length, ids_crc32)."""
    rows = docs.select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_pieces(tokenizer or vocabulary("word_bpe_49k.json"), capacity, end_id), PIECES.format(kind=kind))


class OpenBins:
    """At most ``limit`` open bins, found by free space through one bitset."""

    def __init__(self, capacity: int, limit: int):
        self.capacity, self.limit = capacity, limit
        self.free = 0                                  # bit f is set: some open bin has f free
        self.bins: dict[int, list[int]] = defaultdict(list)
        self.open = self.made = self.closed = 0        # closed: given up with room left, as the fullest of all

    def _take(self, space: int) -> int:
        bins = self.bins[space]
        found = bins.pop()
        if not bins:
            self.free &= ~(1 << space)
        self.open -= 1
        return found

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset) of the next piece."""
        fit = self.free >> length
        if fit:
            space = length + ((fit & -fit).bit_length() - 1)
            number = self._take(space)
        else:
            if self.open >= self.limit:
                self._take((self.free & -self.free).bit_length() - 1)       # the fullest closes
                self.closed += 1
            number, space, self.made = self.made, self.capacity, self.made + 1
        left = space - length
        if left:
            self.bins[left].append(number)
            self.free |= 1 << left
            self.open += 1
        return number, self.capacity - space


def _pack(capacity: int, open_bins: int, schema_names: list[str]):
    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext
        first = TaskContext.get().partitionId() << 40
        bins = OpenBins(capacity, open_bins)

        def placed(held):
            block = pa.Table.from_batches(held).combine_chunks()
            length = np.asarray(block.column("length"))
            at = np.zeros((2, len(length)), np.int64)
            for i in np.argsort(-length, kind="stable").tolist():
                at[:, i] = bins.place(int(length[i]))
            for name, values in (("sequence_id", at[0] + first), ("offset", at[1])):
                block = block.append_column(name, pa.array(values))
            return block.select(schema_names).to_batches()

        held, rows = [], 0
        for b in slices(batches, BLOCK):
            held.append(b)
            rows += b.num_rows
            if rows >= BLOCK:
                yield from placed(held)
                held, rows = [], 0
        if held:
            yield from placed(held)
    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces that have a ``length`` of 1 to ``capacity``.

    ``pieces`` is read twice (totals, then packing): cut it first if it is costly.
    """
    tokens, count = pieces.agg(F.coalesce(F.sum("length"), F.lit(0)), F.count(F.lit(1))).first()
    packers = max(1, -(-tokens // PACKER_TOKENS), -(-count // PACKER_PIECES))
    names = pieces.columns + ["sequence_id", "offset"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id bigint, offset bigint"
    return pieces.repartition(packers).mapInArrow(_pack(capacity, open_bins, names), schema)


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID,
                   open_bins: int = OPEN_BINS) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every document."""
    return pack(cut(cut_pieces(docs, tokenizer, capacity, end_id)), capacity, open_bins)
