"""CSV files with line breaks inside fields, read by as many tasks as the file has splits.

Where quotes only stand around fields and are doubled inside them, a line begins a record if the number of quotes before
it in the file is even. Every split counts its quotes, running sums over the splits tell whether each begins inside a field,
and then a split puts its lines together into records by itself. What lies across splits, at most two pieces a split,
is put together at the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ship

ship(__name__)

# A whole record; the end of one that began earlier; the beginning of one that goes on; a split inside one record.
WHOLE, ENDS, BEGINS, INSIDE = range(4)
PIECES = "file string, block long, place int, text binary"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, value): the lines of each split in their order; value is as it is written, whatever the encoding."""
    place = (F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    return spark.read.option("lineSep", "\n").text(path).select(*place, F.col("value").cast("binary").alias("value"))


def _put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of lines (file, block, value) that come split by split; inside tells whether a split begins within a field."""
    at, held, open_, crossed, first = None, [], False, False, False

    def rest() -> list[tuple]:
        if at is None or not held:
            return []
        place = (INSIDE if open_ else ENDS) if crossed else (BEGINS if open_ else WHOLE)
        return [(*at, place, b"\n".join(held))]

    for batch in batches:
        out: list[tuple] = []
        for file, block, inside, value in zip(*(batch.column(c).to_pylist() for c in ("file", "block", "inside", "value")), strict=True):
            if (file, block) != at:
                out += rest()
                at, held, open_, crossed = (file, block), [], inside, inside
                first = block == 0
            held.append(value)
            open_ ^= value.count(b'"') & 1
            if not open_:
                if first:  # the header
                    first = False
                else:
                    out.append((*at, ENDS if crossed else WHOLE, b"\n".join(held)))
                held, crossed = [], False
        yield _table(out)
    yield _table(rest())


def _table(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int32(), pa.binary())
    columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["file", "block", "place", "text"])


def records(spark: SparkSession, path: str) -> DataFrame | None:
    """(text) of every record but the files' headers, as bytes; None if a file's quotes are not paired.

    Blank lines between records are no records. The table of splits is one row a split, so its broadcast is bounded.
    """
    lines = _lines(spark, path)
    quotes = F.octet_length("value") - F.octet_length(F.replace(F.col("value").cast("string"), F.lit('"'), F.lit("")))
    blocks = lines.groupBy("file", "block").agg((F.sum(quotes) % 2 == 1).alias("odd"))
    ahead = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("before", F.coalesce(F.sum(F.col("odd").cast("int")).over(ahead), F.lit(0)))
    table = blocks.collect()  # one row a split
    odd = {}
    for r in table:
        odd[r.file] = odd.get(r.file, 0) + r.odd
    if any(n % 2 for n in odd.values()):
        return None
    starts = spark.createDataFrame([(r.file, r.block, r.before % 2 == 1) for r in table], "file string, block long, inside boolean")
    # A broadcast join keeps the lines of a split in their order.
    pieces = lines.join(F.broadcast(starts), ["file", "block"]).mapInArrow(_put_together, PIECES)
    # Each record that lies across splits is named by the split that it begins in; few pieces are.
    across = pieces.where(F.col("place") != WHOLE)
    order = Window.partitionBy("file").orderBy("block", "place").rowsBetween(Window.unboundedPreceding, 0)
    named = across.withColumn("begin", F.max(F.when(F.col("place") == BEGINS, F.col("block"))).over(order))
    joined = named.groupBy("file", "begin").agg(F.sort_array(F.collect_list(F.struct("block", "place", "text"))).alias("parts"))
    # The place in a split: what ends a record comes before what begins one.
    whole = joined.select(F.array_join(F.transform("parts", lambda p: F.hex(p["text"])), "0A").alias("hex")).select(F.unhex("hex").alias("text"))
    return pieces.where(F.col("place") == WHOLE).select("text").unionByName(whole)
