"""Byte-level BPE encoding and decoding with the tokenizers library, from a file of merge ranks.

The library's BPE model works on characters, so every byte stands for one printable character; ranks become its
vocabulary and every way to build a token from two others becomes a merge, in rank order. Texts are split by the
vocabulary's pattern, each match is encoded on its own, and each distinct match once per worker (cache).

A rank file merges the leftmost of equal pairs, while the library ranks the ways to build one token among each other.
The two can differ only where a token ``xy = yz`` overlaps itself (runs such as ``aaaa``). The overlaps ``xyz`` are
derived from the ranks; a match that holds one is encoded by a plain loop over its own bytes instead.

Decoding reverses the byte table. A character that is split over tokens comes back whole, because bytes are joined
before they are read as UTF-8; a token's offsets are those of the characters its bytes belong to.

Defined results: a null text is empty and has no ids; every row gives one row; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib

from pyspark.sql import DataFrame

from decisionlake.llm.common import ChunkCache, slices, vocabulary, worker_encoder


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: itself if printable in Latin-1, else one from 256 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, extra = [], 0x100
    for b in range(256):
        out.append(chr(b) if b in printable else chr(extra))
        extra += b not in printable
    return out


def merge_by_rank(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one match: the lowest-ranked pair merges first, the leftmost of equals (a linked list and a heap)."""
    import heapq
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    end, left = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i:i + 2])) is not None]
    heapq.heapify(heap)
    alive = bytearray(b"\1") * n
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = end[i] if alive[i] else n
        if j >= n or end[j] != stop:
            continue                                        # one of the two has changed meanwhile
        end[i], alive[j] = stop, 0
        if stop < n:
            left[stop] = i
            if (r := ranks.get(piece[i:end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if (k := left[i]) >= 0 and (r := ranks.get(piece[k:stop])) is not None:
            heapq.heappush(heap, (r, k, stop))
    return [ranks[piece[i:end[i]]] for i in range(n) if alive[i]]


class ByteBpe:
    """Encoder and decoder of one rank file."""

    def __init__(self, path: str, pattern: str | None = None):
        import ahocorasick
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer, models, pre_tokenizers
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.split = regex.compile(pattern or public_tokenizers.PATTERN).findall
        self.table = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.table[rank] = token
        chars = byte_characters()
        self._to_chars = str.maketrans({chr(b): c for b, c in enumerate(chars)})
        text = {t: "".join(chars[b] for b in t) for t in self.ranks}
        merges, overlaps = [], set()
        for token, _ in sorted(self.ranks.items(), key=lambda x: x[1]):
            cuts = [i for i in range(1, len(token)) if token[:i] in self.ranks and token[i:] in self.ranks]
            merges += [(text[token[:i]], text[token[i:]]) for i in cuts]
            for i in cuts:
                if (back := len(token) - i) != i and back in cuts and token[i:] == token[:back]:
                    overlaps.add(token + token[back:])
        self._model = Tokenizer(models.BPE(vocab={text[t]: r for t, r in self.ranks.items()}, merges=merges, ignore_merges=True))
        self._model.pre_tokenizer = pre_tokenizers.Split("\n", "removed")      # stands for no byte, so it can part matches
        self._decimals = [str(i).encode() for i in range(len(self.table))]
        self._overlaps = ahocorasick.Automaton()
        for o in overlaps:
            self._overlaps.add_word(o.decode("latin-1"), True)
        self._overlaps.make_automaton()
        self._any_overlap = bool(overlaps)
        self._cache = ChunkCache(self._encode)

    def _encode(self, matches: list[str]) -> list[tuple[bytes, bytes]]:
        import numpy as np
        raw = [m.encode() for m in matches]
        # one call for all matches: the library parts them again and tells which match an id belongs to
        latin = [r.decode("latin-1") for r in raw]
        found = self._model.encode("\n".join([x.translate(self._to_chars) for x in latin]), add_special_tokens=False)
        ids = found.ids
        ends = np.searchsorted(np.asarray(found.word_ids), np.arange(len(raw)), side="right").tolist()
        packed, out, at = np.asarray(ids, "<u4").tobytes(), [], 0
        for r, text, end in zip(raw, latin, ends, strict=True):
            if end - at > 1 and self._any_overlap and next(self._overlaps.iter(text), None):
                own = merge_by_rank(r, self.ranks)
                out.append((np.asarray(own, "<u4").tobytes(), b",".join([self._decimals[i] for i in own])))
            else:
                out.append((packed[at * 4:end * 4], b",".join([self._decimals[i] for i in ids[at:end]])))
            at = end
        return out

    def encode(self, texts: list[str | None]) -> list[tuple[bytes, bytes]]:
        """Per text: its ids as little-endian unsigned 32-bit bytes, and in decimals joined by commas."""
        matches = [self.split(t or "") for t in texts]
        get = self._cache.lookup(matches)
        out = []
        for m in matches:
            both = list(map(get, m))
            out.append((b"".join([x[0] for x in both]), b",".join([x[1] for x in both])))
        return out

    def decode(self, ids) -> bytes:
        return b"".join(map(self.table.__getitem__, ids))

    def offsets(self, ids) -> list[tuple[int, int]]:
        """(start, end) of every id in the text: the characters that its bytes are part of."""
        spans, byte, starts = [], 0, []
        raw = self.decode(ids)
        count = -1
        for b in raw:                                        # the character each byte belongs to
            count += (b & 0xC0) != 0x80
            starts.append(count)
        for i in ids:
            n = len(self.table[i])
            spans.append((starts[byte], starts[byte + n - 1] + 1))
            byte += n
        return spans


def encode_documents(docs: DataFrame, ranks: str | None = None, offsets: bool = False) -> DataFrame:
    """(doc_id, ids) of every row of ``docs`` (doc_id, text), with ``starts`` and ``ends`` (characters) if asked for."""
    path = ranks or vocabulary("byte_bpe_multi_50k.tiktoken")

    def run(batches):
        import numpy as np
        import pyarrow as pa
        bpe = worker_encoder(ByteBpe, path)
        for b in slices(batches):
            ids = [np.frombuffer(x, "<u4").astype(np.int32) for x, _ in bpe.encode(b.column("text").to_pylist())]
            out = {"doc_id": b.column("doc_id"), "ids": pa.array(ids, pa.list_(pa.int32()))}
            if offsets:
                spans = [bpe.offsets(x.tolist()) for x in ids]
                for k, name in enumerate(("starts", "ends")):
                    out[name] = pa.array([[s[k] for s in x] for x in spans], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict(out)

    rows = docs.select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, ids array<int>" + ", starts array<int>, ends array<int>" * offsets)


def decode_documents(encoded: DataFrame, ranks: str | None = None) -> DataFrame:
    """(doc_id, decoded) of rows (doc_id, ids): the text's bytes; a null list decodes to no bytes."""
    path = ranks or vocabulary("byte_bpe_multi_50k.tiktoken")

    def run(batches):
        import pyarrow as pa
        bpe = worker_encoder(ByteBpe, path)
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([bpe.decode(x or []) for x in b.column("ids").to_pylist()], pa.binary())],
                ["doc_id", "decoded"])

    rows = encoded.select("doc_id", "ids")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, decoded binary")


def round_trip_digest(docs: DataFrame, ranks: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encodes, decodes the ids, and digests both, in one pass."""
    path = ranks or vocabulary("byte_bpe_multi_50k.tiktoken")

    def run(batches):
        import numpy as np
        import pyarrow as pa
        bpe = worker_encoder(ByteBpe, path)
        for b in slices(batches):
            count, ids_sha, text_sha = [], [], []
            for raw, decimals in bpe.encode(b.column("text").to_pylist()):
                ids = np.frombuffer(raw, "<u4").tolist()
                count.append(len(ids))
                ids_sha.append(hashlib.sha256(decimals).hexdigest())
                text_sha.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(count, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
