"""Token ids of whole texts, and files of length-delimited binary records."""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, scratch
from .shared import give_back

#: Words a tokenizer remembers in a worker before it starts anew; longer ones are encoded each time.
MEMO, MEMO_WORD = 400_000, 64
#: A record file is closed once it is this large.
FILE_BYTES = 64 << 20

_TOKENIZERS: dict[tuple[str, bool], Encoder] = {}


class Encoder:
    """Ids of texts as packed little-endian unsigned 32-bit integers.

    ``by_words`` is for tokenizers that drop white space and never look across
    it: ids of a text are then those of its words, split at ASCII blanks, and
    each word is encoded once per worker.  Otherwise texts are encoded whole.
    """

    def __init__(self, path: str, by_words: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.by_words = by_words
        # Every letter it is used for must come out as it does the long way.
        letters = "".join(c for c in map(chr, range(256)) if _LATIN.fullmatch(c.encode()))
        probes = [*letters, letters, letters[::-1], "the", "thoughtlessness", "geb\u00e4udestra\u00dfe"]
        self.direct = by_words and [self._plain(w.encode()) for w in probes] == self._encode(probes)
        self.memo: dict[bytes, bytes] = {}

    def _encode(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4").tobytes() for e in found]

    def _encode_words(self, words: list[bytes]) -> list[bytes]:
        """Ids of words, encoded as one text and parted by where each token starts."""
        texts = [w.decode("utf-8", "replace") for w in words]
        lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        found = self.tokenizer.encode(" ".join(texts), add_special_tokens=False)
        ids = np.array(found.ids, dtype="<u4")
        begins = np.array(found.offsets, np.int64).reshape(-1, 2)[:, 0]
        ends = np.searchsorted(begins, np.cumsum(lengths)).tolist()
        return [ids[a:b].tobytes() for a, b in zip([0, *ends], ends)]

    def _plain(self, word: bytes) -> bytes:
        """Ids of small Latin-1 letters, straight from the model: a byte is one of its characters."""
        letters = word.decode("latin-1")
        if not word.isascii():
            letters = letters.translate(_BYTE_LETTERS)
        return array("I", [t.id for t in self.tokenizer.model.tokenize(letters)]).tobytes()

    def __call__(self, text: bytes) -> bytes:
        if not self.by_words:
            return self._encode([text.decode("utf-8", "replace")])[0]
        if b"<|" not in text:  # could be a special token, whose case counts
            text = text.lower()  # ASCII letters, as the tokenizer does later
        words, memo = text.split(), self.memo
        out = list(map(memo.get, words))
        if None in out:
            places = [i for i, ids in enumerate(out) if ids is None]
            new = {words[i] for i in places}
            self._learn(new)
            for i in places:
                out[i] = memo[words[i]]
            if len(max(new, key=len)) > MEMO_WORD:
                for w in new:
                    if len(w) > MEMO_WORD:
                        memo.pop(w, None)
            if len(memo) > MEMO:
                memo.clear()
        return b"".join(out)

    def _learn(self, words: set[bytes]) -> None:
        """Encode new words; a word and the same with a final . or , share the work."""
        memo, later, ends, model = self.memo, [], [], self.tokenizer.model
        direct, latin = self.direct, _LATIN.fullmatch
        for w in words:
            low = w
            if w[-1] in b".," and w[-2:-1].islower():
                low = w[:-1]
                ends.append(w)
                if low in memo:
                    continue
            if direct and low.isalpha() and low.islower():  # ASCII
                memo[low] = array("I", [t.id for t in model.tokenize(low.decode())]).tobytes()
            elif direct and latin(low):
                memo[low] = self._plain(low)
            else:
                memo[low] = b""
                later.append(low)
        if later:
            memo.update(zip(later, self._encode_words(later)))
        for w in ends:
            end = w[-1:]
            if end not in memo:
                memo[end] = self._encode([end.decode()])[0]
            memo[w] = memo[w[:-1]] + memo[end]


#: Small letters of Latin-1 in UTF-8.
_LATIN = re.compile(b"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")
#: How byte-level vocabularies write bytes: printable Latin-1 as itself, the others from U+0100 on.
_SHOWN = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTE_LETTERS = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _SHOWN)}


def encoder(path: str, by_words: bool) -> Encoder:
    key = (path, by_words)
    if key not in _TOKENIZERS:
        _TOKENIZERS[key] = Encoder(path, by_words)
    return _TOKENIZERS[key]


# --- the file format -----------------------------------------------------------

#: A file starts with this and one byte: how many bytes an id takes.
MAGIC = b"IDREC01"


def masked(data: bytes) -> int:
    """CRC-32, rotated by 15 bits and shifted by a constant, so that a CRC of data with CRCs stays sound."""
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    """One record: length (8 bytes), its masked checksum (4), the payload, its masked checksum (4)."""
    length = struct.pack("<Q", len(payload))
    return length + struct.pack("<I", masked(length)) + payload + struct.pack("<I", masked(payload))


def read_frame(stream) -> bytes:
    head = stream.read(12)
    if len(head) != 12 or struct.unpack("<I", head[8:])[0] != masked(head[:8]):
        raise ValueError("a record's length does not match its checksum")
    n = struct.unpack("<Q", head[:8])[0]
    payload, check = stream.read(n), stream.read(4)
    if len(payload) != n or len(check) != 4 or struct.unpack("<I", check)[0] != masked(payload):
        raise ValueError("a record does not match its checksum")
    return payload


def file_system(folder: str):
    """File system and path of a folder all executors share, by its scheme."""
    from pyarrow import fs

    if re.match(r"^(file:)?/", folder):
        return fs.LocalFileSystem(), re.sub(r"^file:/+", "/", folder)
    return fs.FileSystem.from_uri(folder)


def write_records(docs: DataFrame, folder: str, tokenizer: str, end_id: int, by_words: bool) -> DataFrame:
    """Write the ids of every text, and ``end_id``, as records in ascending doc_id; the index of them.

    A file is ``MAGIC``, the bytes per id (2 where the vocabulary allows, else
    4), then one record per text (see ``frame``), ids little-endian.

    Rows are dealt by doc_id range and sorted; each task writes files of about
    ``FILE_BYTES`` named after itself and this attempt.  The index, a Parquet
    table in ``folder/index``, has one row per record: ``doc_id, file, offset,
    n_tokens, part, place, before`` (place in the part, ids before it there).
    Only attempts Spark has committed are in it; other files are leftovers of
    lost tasks that no reader opens.
    """
    data = f"{folder}/data"

    def run(batches):
        fs, root = file_system(data)
        fs.create_dir(root, recursive=True)
        encode = encoder(tokenizer, by_words)
        kind = "<u2" if max(encode.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"
        width = np.dtype(kind).itemsize
        end = np.array([end_id], kind).tobytes()
        part, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex
        stream, name, at, number, place, before = None, "", 0, 0, 0, 0
        try:
            for batch in batches:
                rows = []
                texts = batch.column(1).cast(pa.binary())
                for doc_id, text in zip(batch.column(0).to_pylist(), texts):
                    if stream is None:
                        name = f"part-{part:05d}-{number:04d}-{attempt}.rec"
                        stream = fs.open_output_stream(f"{root}/{name}")
                        stream.write(MAGIC + bytes([width]))
                        at = len(MAGIC) + 1
                    payload = np.frombuffer(encode(text.as_py() or b""), "<u4").astype(kind).tobytes() + end
                    record = frame(payload)
                    stream.write(record)
                    n = len(payload) // width
                    rows.append((doc_id, name, at, n, part, place, before))
                    at, place, before = at + len(record), place + 1, before + n
                    if at >= FILE_BYTES:
                        stream.close()
                        stream, number = None, number + 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), _INDEX_TYPES)] if rows
                    else [pa.array([], t) for t in _INDEX_TYPES], names=_INDEX_NAMES)
        finally:
            if stream is not None:
                stream.close()
            give_back()

    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        .repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    )
    index = ordered.mapInArrow(
        run, "doc_id long, file string, offset long, n_tokens long, part int, place long, before long")
    index.write.parquet(f"{folder}/index")
    return docs.sparkSession.read.schema(index.schema).parquet(f"{folder}/index")


_INDEX_NAMES = ["doc_id", "file", "offset", "n_tokens", "part", "place", "before"]
_INDEX_TYPES = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """``doc_id, start, ids`` of every record the index names; ``start`` counts all ids before it.

    ``ids`` are little-endian unsigned 32-bit integers whatever the files hold.

    Any subset or order of index rows can be read: a record is found by file and
    offset, and its checksums are verified.
    """
    sizes = index.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per part of the writing job.
    starts = sizes.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    placed = index.join(F.broadcast(starts), "part").select(
        "doc_id", "file", "offset", (F.col("base") + F.col("before")).alias("start")
    )

    def run(batches):
        fs, root = file_system(f"{folder}/data")
        stream, name, width = None, None, 0
        try:
            for batch in batches:
                out = []
                for file, offset in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                    if file != name:
                        if stream is not None:
                            stream.close()
                        stream, name = fs.open_input_file(f"{root}/{file}"), file
                        head = stream.read(len(MAGIC) + 1)
                        if head[:-1] != MAGIC or head[-1] not in (2, 4):
                            raise ValueError(f"{file} is no file of records")
                        width = head[-1]
                    if stream.tell() != offset:
                        stream.seek(offset)
                    out.append(np.frombuffer(read_frame(stream), f"<u{width}").astype("<u4").tobytes())
                    if len(out) == 512:
                        yield _part(batch, len(out), out)
                        batch, out = batch.slice(len(out)), []
                yield _part(batch, len(out), out)
        finally:
            if stream is not None:
                stream.close()

    def _part(batch, n, out):
        return pa.RecordBatch.from_arrays(
            [batch.column(0).slice(0, n), batch.column(3).slice(0, n), pa.array(out, pa.binary())],
            names=["doc_id", "start", "ids"])

    return placed.repartition("file").sortWithinPartitions("file", "offset").mapInArrow(
        run, "doc_id long, start long, ids binary")


def record_digests(docs: DataFrame, tokenizer: str, end_id: int, by_words: bool = False) -> DataFrame:
    """Write records to a new shared folder, read them back: ``doc_id, start, n_tokens, ids_crc32``.

    A null text counts as empty and has the end id alone.  Null doc_ids come
    first; rows with one doc_id are neighbours in either order.  Repeated rows
    give records of their own, other columns are ignored, no rows give no rows.
    """
    spark = docs.sparkSession
    folder = scratch(spark, f"{ensure_checkpoint_dir(spark)}/records-{uuid.uuid4().hex}")
    back = read_records(write_records(docs, folder, tokenizer, end_id, by_words), folder)
    return back.select(
        "doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32")
    )
