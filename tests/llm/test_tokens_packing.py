import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tableslice.llm import packing, tokens
from tableslice.llm.queries import END_ID, tokenizer_file

ODD = ["", None, "  \n", "A", "Ça va? Été, ÉTÉ. naïve œuvre ﬁn", "<|endoftext|> x<|STARTOFTEXT|>y", "don't can't '.s, 's.",
       "İstanbul ΟΔΟΣ Straße K", "a b c\x1cd\x85e", "é É. ́x", "日本語、 テスト。", "x" * 5000,
       "Word, word. WORD; wOrD?", "🙂🙂 ok.", "I\u0307I. A\u030aA, É, É. x<|endoftext|>, A.", "a., b,. c.. D,", ".", ",", "K\u212a ok", "12,345.67 a1b2"]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(tokenizer_file())


def ids(tokenizer, text):
    return np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [END_ID], "<u4")


def test_words_give_the_ids_of_whole_texts(spark, tokenizer):
    texts = ODD + [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    encode = tokens.Encoder(tokenizer_file(), True)
    assert encode.direct
    for _ in range(2):
        for t in texts:
            assert encode((t or "").encode()) == ids(tokenizer, t)[:-1].tobytes(), t[:60]


def test_a_full_memo_changes_nothing(spark, tokenizer, monkeypatch):
    monkeypatch.setattr(tokens, "MEMO", 50)
    encode = tokens.Encoder(tokenizer_file(), True)
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(20).collect():
        assert encode(r.text.encode()) == ids(tokenizer, r.text)[:-1].tobytes()


def odd_docs(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(3, "A"), (None, "null id"), (-5, "first")]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("file", F.lit("clash")), rows


@pytest.mark.parametrize("by_words", [True, False])
def test_records_round_trip(spark, tokenizer, by_words):
    docs, rows = odd_docs(spark)
    got = sorted(tuple(r) for r in tokens.record_digests(docs, tokenizer_file(), END_ID, by_words)
                 .withColumn("doc_id", F.coalesce("doc_id", F.lit(-(1 << 62)))).collect())
    start, want = 0, []
    for doc_id, text in sorted(rows, key=lambda r: -(1 << 62) if r[0] is None else r[0]):
        x = ids(tokenizer, text)
        want.append((-(1 << 62) if doc_id is None else doc_id, start, len(x), zlib.crc32(x.tobytes())))
        start += len(x)
    assert got == want
    assert tokens.record_digests(docs.limit(0), tokenizer_file(), END_ID, by_words).collect() == []


def test_damaged_records_are_refused(tmp_path):
    frame = tokens.frame(b"abcdefgh")
    path = tmp_path / "r"
    for k in range(len(frame)):
        path.write_bytes(frame[:k] + bytes([frame[k] ^ 1]) + frame[k + 1:])
        with open(path, "rb") as f, pytest.raises(ValueError):
            tokens.read_frame(f)
    path.write_bytes(frame)
    with open(path, "rb") as f:
        assert tokens.read_frame(f) == b"abcdefgh"


def test_shuffled_reads(spark, tokenizer):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    folder = f"{tokens.ensure_checkpoint_dir(spark)}/shuffled-read"
    index = tokens.write_records(docs, folder, tokenizer_file(), END_ID, True)
    got = {r.doc_id: r.ids for r in tokens.read_records(index, folder).filter("doc_id % 7 = 3").collect()}
    want = {r.doc_id: ids(tokenizer, r.text).tobytes() for r in docs.filter("doc_id % 7 = 3").collect()}
    assert {k: bytes(v) for k, v in got.items()} == want


def test_differencing_partitions_everything():
    rng = np.random.default_rng(0)
    for n, k in ((1, 1), (5, 1), (5, 8), (40, 7), (300, 40)):
        sizes = rng.integers(1, 1000, n).tolist()
        parts = packing.differenced(sizes, k)
        assert len(parts) <= k and sorted(i for p in parts for i in p) == list(range(n))
    sums = [sum(sizes[i] for i in p) for p in parts]
    assert max(sums) - min(sums) < 60
    assert packing.differenced([], 3) == []


def test_windows_never_overflow():
    rng = np.random.default_rng(1)
    for total in (1, 99, 100, 101, 1000):
        sizes = rng.multinomial(total, np.ones(30) / 30)
        sizes = [int(s) for s in sizes if s]
        assert all(sum(sizes[i] for i in w) <= 100 for w in packing.windows_of(sizes, 100))
    assert len(packing.windows_of([60] * 10, 100)) == 10


def test_pack_whole_documents(spark, tokenizer):
    docs, rows = odd_docs(spark)
    extra = spark.createDataFrame([(100 + i, "word " * n) for i, n in enumerate((4095, 4096, 9000, 300))],
                                  "doc_id long, text string").withColumn("file", F.lit("c"))
    docs = docs.filter("doc_id IS NOT NULL AND NOT (doc_id = 3 AND text = 'A')").unionByName(extra)
    texts = {r.doc_id: r.text for r in docs.collect()}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in packing.pack(docs, tokenizer_file(), END_ID, by_words=True).collect():
        assert r.length * 4 == len(r.ids)
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(pieces) == set(texts)
    for doc_id, rs in pieces.items():
        rs.sort(key=lambda r: r.start)
        whole = ids(tokenizer, texts[doc_id])
        assert b"".join(bytes(r.ids) for r in rs) == whole.tobytes()
        assert all(r.doc_tokens == len(whole) for r in rs)
        assert [r.start for r in rs] == np.cumsum([0] + [r.length for r in rs])[:-1].tolist()
    for rs in sequences.values():
        rs.sort(key=lambda r: r.offset)
        ends = np.cumsum([0] + [r.length for r in rs]).tolist()
        assert [r.offset for r in rs] == ends[:-1] and ends[-1] <= 4096
    assert packing.pack(docs.limit(0), tokenizer_file(), END_ID).collect() == []


def test_little_padding_on_the_sample(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sums = packing.pack(docs, tokenizer_file(), END_ID, by_words=True).groupBy("sequence_id").agg(
        F.sum("length").alias("n")).collect()
    padding = sum(4096 - r.n for r in sums if r.n & (r.n - 1))
    assert padding < 0.02 * sum(r.n for r in sums)


def test_repeated_rows_are_documents_of_their_own(spark):
    docs = spark.createDataFrame([(1, "a b c")] * 3, "doc_id long, text string")
    got = packing.pack_digests(docs, tokenizer_file(), END_ID).collect()
    assert sum(r.length for r in got) == 12 and {r.doc_tokens for r in got} == {4}
