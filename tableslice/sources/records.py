"""Records of CSV files whose quoted fields may hold line ends, read by many tasks.

Whether a line starts inside a quoted field depends on how many quotes stand
before it.  So every range of a file is first only counted: an even number of
quotes keeps the state it is entered with, an odd number turns it.  Composed in
file order these give each range's true start; then ranges are cut into records
apart from each other, and the few records that cross a border are put together
from their pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import SpecError
from ..session import cut

# What a text is: a whole record; the end, a middle, the beginning of one that crosses borders.
WHOLE, LAST, MIDDLE, FIRST = range(4)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines in file order within each range; a line belongs to the range it starts in."""
    return spark.read.option("lineSep", "\n").text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("range"))


def range_starts(lines: DataFrame) -> DataFrame:
    """``file, range, inside, open``: does a range start inside a quoted field, and does it end there.

    One row per range of a file, so the window sees a file's bytes divided by
    the size of a range.
    """
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    turns = lines.groupBy("file", "range").agg((F.sum(quotes) % 2).alias("odd"))
    so_far = F.sum("odd").over(Window.partitionBy("file").orderBy("range").rowsBetween(Window.unboundedPreceding, 0))
    return turns.select("file", "range", ((so_far - F.col("odd")) % 2 == 1).alias("inside"), (so_far % 2 == 1).alias("open"))


_SCHEMA = "file string, range long, kind int, top boolean, text string"
_FIELDS = pa.schema([("file", pa.string()), ("range", pa.int64()), ("kind", pa.int32()), ("top", pa.bool_()), ("text", pa.string())])


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at, top, inside, begun = None, False, False, False
    held: list[pa.Array] = []  # lines of a record that is still open

    def rows(texts: pa.Array, kinds: np.ndarray, first: bool) -> pa.RecordBatch:
        tops = np.zeros(len(texts), bool)
        tops[:1] = first
        return pa.record_batch([
            pa.repeat(at[0], len(texts)), pa.repeat(at[1], len(texts)), pa.array(kinds, pa.int32()), pa.array(tops),
            texts.cast(pa.string())], schema=_FIELDS)

    def joined(parts: list[pa.Array]) -> pa.Array:
        lines = pa.concat_arrays(parts)
        return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(lines)], pa.int32()), lines), "\n")

    def leave():
        if held:  # begun here and open at the end, or open all the way through
            yield rows(joined(held), np.array([FIRST if begun else MIDDLE]), False)
            held.clear()

    for batch in batches:
        file, start = batch["file"], batch["range"].to_numpy()
        coded = file.dictionary_encode().indices.to_numpy()
        cuts = np.append(np.flatnonzero(np.diff(start, prepend=-1) | np.diff(coded, prepend=-1)), len(start))
        for a, b in zip(cuts.tolist(), cuts[1:].tolist()):
            here = (file[a].as_py(), int(start[a]))
            if here != at:
                yield from leave()
                at, inside = here, batch["inside"][a].as_py()
                top, begun = here[1] == 0, not inside
            lines = batch["value"].slice(a, b - a)
            quotes = pc.count_substring(lines, '"').to_numpy().astype(np.int64)
            after = (inside + np.cumsum(quotes)) % 2
            # A line begins a record if it is entered outside quotes.
            opens = np.flatnonzero(np.concatenate(([inside], after[:-1])) == 0)
            closed = after[-1] == 0
            if held or (len(opens) == 0 or opens[0] > 0):  # goes on with a record
                until = int(opens[0]) if len(opens) else len(lines)
                held.append(lines.slice(0, until))
                if len(opens) or closed:
                    yield rows(joined(held), np.array([WHOLE if begun else LAST]), top and begun)
                    top = top and not begun
                    held.clear()
            if len(opens):
                begun = True
                whole = opens if closed else opens[:-1]
                if len(whole):
                    stop = len(lines) if closed else int(opens[-1])
                    offsets = np.append(whole, stop) - int(whole[0])
                    body = lines.slice(int(whole[0]), stop - int(whole[0]))
                    if len(whole) < len(body):
                        body = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), body), "\n")
                    yield rows(body, np.full(len(whole), WHOLE), top)
                    top = False
                if not closed:
                    held.append(lines.slice(int(opens[-1])))
            inside = not closed
    yield from leave()


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """``file, top, text`` of every record of the CSV files in ``path``; ``top`` marks each file's first.

    Lines end in ``\\n`` or ``\\r\\n``; a quote inside a field is doubled and the
    field quoted.  A file that ends inside a quoted field is an error.  A file of
    any size is read by as many tasks as it has ranges
    (``spark.sql.files.maxPartitionBytes``) unless it is compressed as a whole.
    """
    lines = _lines(spark, path)
    starts = cut(range_starts(lines))
    last = Window.partitionBy("file").orderBy(F.desc("range"))
    unclosed = starts.withColumn("n", F.row_number().over(last)).filter("n = 1 AND open").select("file").limit(1).collect()
    if unclosed:
        raise SpecError(f"{unclosed[0]['file']} ends inside a quoted field")
    crossing = not starts.filter("inside").isEmpty()
    # One row per range, some ten millionth of the bytes; a broadcast keeps the lines in their order.
    entered = lines.join(F.broadcast(starts.select("file", "range", "inside")), ["file", "range"], "left").select(
        "file", "range", "value", F.coalesce("inside", F.lit(False)).alias("inside"))
    parts = entered.mapInArrow(_records, _SCHEMA)
    found = parts.filter(F.col("kind") == WHOLE).select("file", "top", "text")
    if crossing:
        order = Window.partitionBy("file").orderBy("range", "kind").rowsBetween(Window.unboundedPreceding, 0)
        pieces = parts.filter(F.col("kind") != WHOLE).withColumn("record", F.sum((F.col("kind") == FIRST).cast("int")).over(order))
        texts = F.transform(F.array_sort(F.collect_list(F.struct("range", "kind", "text"))), lambda x: x["text"])
        # What a file begins with may cross a border as well.
        whole = pieces.groupBy("file", "record").agg(
            F.min("range").alias("range"), F.array_join(texts, "\n").alias("text"))
        heads = parts.filter("top").select(F.col("file").alias("f")).distinct()
        whole = whole.join(heads, whole["file"] == heads["f"], "left").select(
            "file", (F.col("f").isNull() & (F.col("range") == 0) & (F.col("record") == 1)).alias("top"), "text")
        found = found.unionByName(whole)
    return found.select("file", "top", F.regexp_replace("text", "\r\\z", "").alias("text"))
