"""Token files, packing and byte-level BPE against the libraries themselves."""
import glob
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from decisionlake.llm import byte_bpe, packing, token_files
from decisionlake.llm.common import WordEncoder, vocabulary
from decisionlake.session import staging_path

PARTS = [*"aAbB.,' \n\t\r-=*1２é́ßİΣ中😀　\x1c\x85", "'s", "'LL", "<|endoftext|>", "aaaa", "    ", "word", "====", "ﬁ"]
TEXTS = st.lists(st.sampled_from(PARTS), max_size=20).map("".join)


@pytest.fixture(scope="module")
def words():
    return WordEncoder(vocabulary("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def bytes_bpe():
    return byte_bpe.ByteBpe(vocabulary("byte_bpe_multi_50k.tiktoken"))


@pytest.fixture(scope="module")
def oracle(bytes_bpe):
    import public_tokenizers
    import tiktoken
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bytes_bpe.ranks, special_tokens={})


def ids_of(raw):
    return np.frombuffer(raw, "<u4").tolist()


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_word_encoder_is_the_library(words, text):
    assert ids_of(words.encode([text])[0]) == words._tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("dots", [64, 65, 100, 5000])
def test_dot_leaders_after_a_letter(words, dots):
    for text in ("Introduction" + "." * dots + " 5", "é" + ".," * dots, "a" * 100 + "." * dots):
        for _ in range(2):                                  # new, then as far as the caches know it
            assert ids_of(words.encode([text])[0]) == words._tokenizer.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_byte_bpe_is_the_rank_merge(bytes_bpe, oracle, text):
    ids = ids_of(bytes_bpe.encode([text])[0][0])
    assert ids == oracle.encode_ordinary(text)
    assert bytes_bpe.decode(ids) == text.encode()
    assert all(text[a:z].encode().find(bytes_bpe.table[i]) >= 0 for i, (a, z) in zip(ids, bytes_bpe.offsets(ids)))


@pytest.mark.parametrize("text", ["a" * 5000, "ab" * 3000, " " * 4001, "=" * 3333, "aaaa", "hhhhh"])
def test_runs_that_overlap_themselves(bytes_bpe, oracle, text):
    assert ids_of(bytes_bpe.encode([text])[0][0]) == oracle.encode_ordinary(text)


def test_split_characters_keep_their_offsets(bytes_bpe):
    text = "x😀y"
    ids = ids_of(bytes_bpe.encode([text])[0][0])
    spans = bytes_bpe.offsets(ids)
    assert spans[0][0] == 0 and spans[-1][1] == 3 and all(a < z for a, z in spans)


def test_documents_round_trip(spark, edges, bytes_bpe):
    encoded = byte_bpe.encode_documents(edges, offsets=True)
    assert encoded.columns == ["doc_id", "ids", "starts", "ends"]
    texts = sorted((r.decoded or b"").decode() for r in byte_bpe.decode_documents(encoded).collect())
    assert texts == sorted((r.text or "") for r in edges.collect())
    assert byte_bpe.round_trip_digest(edges).count() == edges.count()


def test_token_files(spark, edges, no_rows, words):
    import pyarrow.parquet as pq
    path = staging_path(spark, "t")
    token_files.write_token_files(edges, path, metadata=["lang", "d"], page_rows=2)
    got = token_files.token_digest(spark, path).collect()
    rows = sorted(((r.doc_id is not None, r.doc_id or 0, r.text is not None, r.text or "") for r in edges.collect()))
    want, start = [], 0
    for known, doc_id, _, text in rows:
        ids = words._tokenizer.encode(text, add_special_tokens=False).ids + [1]
        want.append((doc_id if known else None, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    read = token_files.read_token_files(spark, path, ["doc_id", "n_tokens"], "doc_id > 4")
    assert read.columns == ["doc_id", "n_tokens", "start"] and {r.doc_id for r in read.collect()} == {5, 6, 7}
    scan = read._jdf.queryExecution().executedPlan().toString()
    assert "ids" not in scan.split("ReadSchema:")[1].split("\n")[0] and "GreaterThan(doc_id,4)" in scan
    file = max((f.removeprefix("file:") for f in glob.glob(path.removeprefix("file:") + "/tokens/*.parquet")), key=lambda f: pq.read_metadata(f).num_rows)
    group = pq.read_metadata(file).row_group(0)
    columns = {group.column(i).path_in_schema: group.column(i) for i in range(group.num_columns)}
    assert "DELTA_BINARY_PACKED" in columns["doc_id"].encodings and columns["doc_id"].has_column_index and columns["doc_id"].has_offset_index
    assert any("DICTIONARY" in e for e in next(c for n, c in columns.items() if n.startswith("ids")).encodings)
    empty = staging_path(spark, "t")
    token_files.write_token_files(no_rows, empty)
    assert token_files.token_digest(spark, empty).collect() == []


@pytest.mark.parametrize("ranges", [1, 2, 37])
def test_token_files_are_dealt_in_order_of_their_ids(spark, ranges):
    from pyspark.sql import functions as F
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(ranges))
    try:
        ids = spark.range(0, 20_000, 1, 1).select((F.col("id") * 7919 % 20_011).alias("doc_id")).union(spark.sql("SELECT CAST(NULL AS LONG)"))
        dealt = token_files._in_ranges(ids.withColumn("text", F.lit(""))).groupBy(F.spark_partition_id().alias("p")).agg(
            F.min("doc_id").alias("a"), F.max("doc_id").alias("z"), F.count("*").alias("n"), F.count_if(F.isnull("doc_id")).alias("nulls")).orderBy("p").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sum(r.n for r in dealt) == 20_001 and [r.nulls for r in dealt] == [1] + [0] * (len(dealt) - 1)
    assert all(x.z < y.a for x, y in zip(dealt, dealt[1:])) and len(dealt) >= ranges


def test_special_names_keep_their_case_and_other_tokenizers_are_refused(words):
    for text in ("A <|ENDOFTEXT|> b.", "A<|endoftext|>B., c", "<|StartOfText|>"):
        assert ids_of(words.encode([text])[0]) == words._tokenizer.encode(text, add_special_tokens=False).ids
    words._require_traits("own")
    class Plain(WordEncoder):
        def __init__(self):
            from tokenizers import Tokenizer, models
            self._tokenizer = Tokenizer(models.BPE(vocab={c: i for i, c in enumerate("OneTwotwN., ELéé")}, merges=[]))
    with pytest.raises(ValueError):
        Plain()._require_traits("plain")


def check_bins(rows, capacity):
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_packing_covers_every_document(spark, edges, no_rows, words):
    rows = packing.pack_documents(edges, capacity=64).collect()
    assert check_bins(rows, 64) >= sum(r.length for r in rows) / 64
    long = sorted((r.piece, r.start, r.length) for r in rows if r.doc_id == 6)
    n = len(words._tokenizer.encode("wörd " * 3000, add_special_tokens=False).ids) + 1
    assert [s for _, s, _ in long] == list(range(0, n, 64)) and sum(x for *_, x in long) == n
    assert len([r for r in rows if r.doc_id == 1]) == 2 and len([r for r in rows if r.doc_id == 3]) == 1
    assert packing.pack_documents(no_rows).collect() == []


def test_packing_is_near_best_fit_decreasing(spark):
    random.seed(1)
    lengths = [random.choice([3, 40, 300, 700, 1100, 1600, 2048, random.randint(1, 2048)]) for _ in range(5000)]
    rows = packing.pack(spark.createDataFrame(list(enumerate(lengths)), "id long, length long")).collect()
    offline = packing.OpenBins(2048, 10 ** 9)
    for x in sorted(lengths, reverse=True):
        offline.place(x)
    assert len(rows) == 5000 and check_bins(rows, 2048) <= 1.01 * offline.made + 1
    bounded = packing.OpenBins(2048, packing.OPEN_BINS)
    for at in range(0, 5000, packing.BLOCK):
        for x in sorted(lengths[at:at + packing.BLOCK], reverse=True):
            bounded.place(x)
    assert bounded.closed > 100 and bounded.made <= 1.01 * offline.made        # the bound acts and costs little


def test_best_fit_and_closing():
    bins = packing.OpenBins(10, 2)
    assert [bins.place(x) for x in (6, 5, 4, 5)] == [(0, 0), (1, 0), (0, 6), (1, 5)]
    bins = packing.OpenBins(10, 2)
    assert [bins.place(x) for x in (7, 8, 9, 3, 1)] == [(0, 0), (1, 0), (2, 0), (0, 7), (2, 9)]       # the third closes bin 1, the fullest
