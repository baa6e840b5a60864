"""Shared pieces of the training-data operators: tables, words, and encoders that work chunk by chunk."""

from __future__ import annotations

import os

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")       # Spark's tasks are the parallelism

from collections.abc import Iterable  # noqa: E402
from itertools import chain  # noqa: E402

from pyspark.sql import DataFrame, SparkSession  # noqa: E402

SPACE = r"[\x20\x09-\x0D]"               # what separates words, in every operator
WORD = r"[^\x20\x09-\x0D]+"
CACHED_CHUNKS = 1 << 19                  # entries of an encoder's cache in one worker (memory only, never results)
CACHED_LENGTH = 64                       # longer chunks are encoded anew each time
WORD_END = r"([a-zA-Zà-öø-ÿ])([.,]+)( |$)"      # a letter, points or commas, and no more
JOINED_CHUNKS = 200                      # new words in one call of a tokenizer
BATCH_ROWS = 512                         # rows an operator holds at once in a Python worker


def known_to_workers(spark: SparkSession) -> None:
    """Lets Python workers import this package when it was started from a source folder instead of an installation."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH", "")]))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    known_to_workers(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def vocabulary(name: str) -> str:
    """Path of a public tokenizer's vocabulary file, the default of every ``tokenizer`` parameter."""
    import public_tokenizers
    return public_tokenizers.path(name)


def slices(batches: Iterable, rows: int = BATCH_ROWS):
    """Arrow batches cut into pieces of at most ``rows`` rows (views, nothing is copied)."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


class ChunkCache:
    """chunk -> encoded value, for texts that repeat their words; values are made for many chunks at once.

    It is emptied when it is full, so its memory is bounded; results never depend on it.
    """

    def __init__(self, encode_many):
        self._encode_many, self._known = encode_many, {}

    def lookup(self, texts: list[list[str]]):
        """A function chunk -> value that knows every chunk of ``texts``."""
        known = self._known
        if len(known) > CACHED_CHUNKS:
            known.clear()
        new = list(set(chain.from_iterable(texts)).difference(known))
        if not new:
            return known.__getitem__
        made = dict(zip(new, self._encode_many(new), strict=True))
        if all(len(c) <= CACHED_LENGTH for c in new):
            known.update(made)
            return known.__getitem__
        known.update((c, v) for c, v in made.items() if len(c) <= CACHED_LENGTH)
        return lambda c: known[c] if c in known else made[c]


class Generations:
    """chunk -> encoded value in two generations of at most half of ``CACHED_CHUNKS`` each.

    A full young generation becomes the old one, and what is asked for again moves over: frequent chunks are never made
    anew, and memory stays bounded. Results never depend on it.
    """

    def __init__(self, encode_many):
        self._encode_many, self._young, self._old = encode_many, {}, {}

    def values(self, chunks: list[str]) -> list:
        """The value of every chunk of a list without repeats; what is new is made in one call."""
        found = list(map(self._young.get, chunks))
        places = [i for i, v in enumerate(found) if v is None]
        if not places:
            return found
        new = [chunks[i] for i in places]
        made = list(map(self._old.get, new))
        unknown = [i for i, v in enumerate(made) if v is None]
        for i, v in zip(unknown, self._encode_many([new[i] for i in unknown]) if unknown else [], strict=True):
            made[i] = v
        if len(self._young) + len(made) > CACHED_CHUNKS // 2:
            self._young, self._old = {}, self._young
        kept = zip(new, made, strict=True)
        if max(map(len, new)) > CACHED_LENGTH:
            kept = [(c, v) for c, v in kept if len(c) <= CACHED_LENGTH]
        if len(made) <= CACHED_CHUNKS // 2:
            self._young.update(kept)
        for i, v in zip(places, made, strict=True):
            found[i] = v
        return found


class WordEncoder:
    """Ids of whole texts by a tokenizer file that drops white space, folds case and never joins letters to punctuation.

    Texts are cut at blanks and line feeds, and points and commas at the end of a word are set off, so each distinct word is
    encoded once. Many new words go to the library in one call and are told apart again by their offsets. Texts that may
    name a special token keep their case, since such names are told by case. Ids are unsigned 32-bit numbers.

    The traits this rests on are tried once when a file is loaded; a tokenizer that lacks one is refused.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self._tokenizer = Tokenizer.from_file(path)
        self._require_traits(path)
        self._words = Generations(self._encode_words)

    def _require_traits(self, path: str) -> None:
        ids = lambda text: self._tokenizer.encode(text, add_special_tokens=False).ids
        for part, whole in ((["One", "two"], "One two"), (["One", "two"], "One\n two"), (["one"], "ONE"), (["one", ".,"], "one.,"),
                            (["\u00e9t\u00e9", "."], "\u00e9t\u00e9."), (["one"], " one ")):
            if sum(map(ids, part), []) != ids(whole):
                raise ValueError(f"{path}: {whole!r} is not encoded as the row {part!r}, so texts cannot be cut into words")

    def _encode_words(self, words: list[str]) -> list[bytes]:
        import numpy as np
        out = []
        blocks = [words[at:at + JOINED_CHUNKS] for at in range(0, len(words), JOINED_CHUNKS)]
        for block, found in zip(blocks, self._tokenizer.encode_batch([" ".join(b) for b in blocks], add_special_tokens=False), strict=True):
            ids = np.asarray(found.ids, "<u4").tobytes()
            starts = [a for a, _ in found.offsets]
            ends = np.searchsorted(starts, np.cumsum([len(w) + 1 for w in block])).tolist() if starts else [0] * len(block)
            at = 0
            for end in ends:
                out.append(ids[at * 4:end * 4])
                at = end
        return out

    def encode_column(self, texts):
        """(ids, begins) of an Arrow column: the ids of all texts in one row, and where each text's begin; the last entry is their number."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        texts = pc.fill_null(texts, "")
        texts = pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts))
        texts = pc.replace_substring_regex(pc.replace_substring(texts, "\n", " "), WORD_END, r"\1 \2\3")
        words = pc.split_pattern(texts, " ")
        coded = pc.dictionary_encode(words.flatten())
        values = self._words.values(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        values = pa.array(values, pa.large_binary()).take(coded.indices)
        _, ends, data = values.buffers()
        ends = np.frombuffer(ends, np.int64, len(values) + 1) >> 2
        firsts = np.asarray(words.offsets)
        return np.frombuffer(data or b"", "<u4", int(ends[-1])), ends[firsts - firsts[0]]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """One text's ids as little-endian bytes each."""
        import pyarrow as pa
        ids, begins = self.encode_column(pa.array(texts, pa.large_string()))
        return [ids[a:z].tobytes() for a, z in zip(begins[:-1], begins[1:], strict=True)]


_ENCODERS: dict[tuple, object] = {}


def worker_encoder(kind, path: str):
    """One encoder per worker process and file."""
    key = (kind, path)
    if key not in _ENCODERS:
        _ENCODERS[key] = kind(path)
    return _ENCODERS[key]
