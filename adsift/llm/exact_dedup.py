"""Exact deduplication by content sort.

Sampled splitters deal the rows out by the leading bytes of the normalised text, its digest and the identifier, so a
text of a third of all rows spreads over many ranges. Each range is sorted by Spark (externally where it must be), equal
texts stand next to each other, and whole neighbouring texts are compared. Runs that cross a range border are joined in a
table of two rows a range.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

from adsift.session import materialise, ship

ship(__name__)

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Bytes of text in a splitter; the digest behind them separates texts with a common head.
HEAD_BYTES = 32
OUT_ROWS = 5_000


def normalised(text: Column) -> Column:
    """The text with A-Z in lower case; null is empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def _sorted(docs: DataFrame, id_col: str, text_col: str, rest: Column | None) -> DataFrame:
    norm = docs.select(
        F.col(id_col).alias("id"), normalised(F.col(text_col)).cast("binary").alias("norm"), *([rest.alias("row")] if rest is not None else [])
    )
    keyed = norm.select(F.substring("norm", 1, HEAD_BYTES).alias("head"), F.unhex(F.sha2("norm", 256)).alias("digest"), "*")
    whole = ["norm"]
    if rest is not None:  # the text moves in its row only; it is normalised again where neighbours are compared
        keyed, whole = keyed.drop("norm"), []
    dealt = keyed.repartitionByRange("head", "digest", F.col("id").desc_nulls_last())
    return dealt.sortWithinPartitions("head", "digest", *whole, F.col("id").desc_nulls_last())


def _runs(batches: Iterator[pa.RecordBatch], schema: pa.Schema, text_col: str | None) -> Iterator[pa.RecordBatch]:
    """Rows of a sorted range with the run of equal texts each belongs to.

    side tells the first (1), the last (2) and the only (3) run of a range from those between (0); the first row of such
    a run carries its text. With text_col, the name of the text in the rows, only the first row of each run goes on,
    otherwise the identifiers do. A run's identifiers are all that is held: a range is bounded by the shuffle, and so are
    its identifiers.
    """
    rows = text_col is not None
    part = TaskContext.get().partitionId()
    out: list[tuple] = []
    run: tuple | None = None  # (digest, text, identifiers, row of the first)
    first = True

    def closed(last: bool) -> None:
        digest, text, ids, row = run
        side = int(first) + 2 * int(last)
        for k, one in enumerate(ids[:1] if rows else ids):
            edge = text if side and k == 0 else None
            out.append((one, ids[0], len(ids), k == 0, digest.hex(), part, side, edge, *([row] if rows else [])))

    def batch() -> pa.RecordBatch:
        columns = zip(*out, strict=True)
        made = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
        out.clear()
        return made

    for b in batches:
        columns = [b.column(c).to_pylist() for c in ("id", "digest")]
        carried = b.column("row") if rows else None
        if rows:  # bytes.lower changes A-Z only
            columns.append([(t or "").encode("utf-8", "replace").lower() for t in carried.field(text_col).to_pylist()])
        else:
            columns.append(b.column("norm").to_pylist())
        for k, (one, digest, text) in enumerate(zip(*columns, strict=True)):
            if run is not None and run[0] == digest and run[1] == text:
                run[2].append(one)
                continue
            if run is not None:
                closed(last=False)
                first = False
                if len(out) >= OUT_ROWS:
                    yield batch()
            run = (digest, text, [one], carried[k].as_py() if rows else None)
    if run is not None:
        closed(last=True)
        yield batch()


def _stored(docs: DataFrame, id_col: str, text_col: str, rows: bool) -> DataFrame:
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns]) if rows else None
    ordered = _sorted(docs, id_col, text_col, rest)
    kind = docs.schema[id_col].dataType
    schema = StructType(
        [StructField("id", kind), StructField("keep_id", kind), StructField("group_size", LongType()), StructField("is_first", BooleanType())]
        + [StructField("text_sha256", StringType()), StructField("part", IntegerType()), StructField("side", IntegerType())]
        + [StructField("edge_text", BinaryType()), *([ordered.schema["row"]] if rows else [])]
    )
    arrow = to_arrow_schema(schema)
    return materialise(ordered.mapInArrow(lambda it: _runs(it, arrow, text_col if rows else None), schema), "equal_texts")


def _stitched(stored: DataFrame) -> DataFrame:
    """For each run that continues over a border: its range and side, the identifier that stays and the whole size.

    Two rows a range at most, so the window without a partition and the broadcast of the result are bounded by the number
    of ranges.
    """
    edges = stored.where(F.col("edge_text").isNotNull())
    ends = edges.where("side in (2, 3)").select("part", "edge_text")
    starts = edges.where("side in (1, 3)").select(F.col("part").alias("next"), F.col("edge_text").alias("next_text"))
    follows = edges.select("part").distinct().withColumn("next", F.lead("part").over(Window.orderBy("part")))
    linked = ends.join(follows, "part").join(starts, "next").where(F.col("edge_text") == F.col("next_text"))
    linked = linked.select(F.col("next").alias("part"), F.lit(True).alias("linked"))
    runs = edges.select("part", "side", "keep_id", "group_size").join(linked, "part", "left")
    begins = F.when((F.col("side") != 2) & F.col("linked"), 0).otherwise(1)
    runs = runs.withColumn("begins", begins).withColumn("island", F.sum("begins").over(Window.orderBy("part", "side")))
    whole = Window.partitionBy("island")
    every = whole.orderBy("part", "side").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    runs = runs.withColumn("n", F.count("*").over(whole)).withColumn("all_size", F.sum("group_size").over(whole))
    runs = runs.withColumn("all_keep", F.first("keep_id").over(every))
    return runs.where("n > 1").select("part", "side", "all_keep", "all_size", F.col("begins").cast("boolean").alias("heads"))


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; of equal texts the row with the largest identifier stays (null
    identifiers come last; of rows with equal identifiers exactly one stays). Null texts count as empty and empty texts
    are equal to each other. An empty table gives an empty result; other columns are not read.
    """
    stored = _stored(docs, id_col, text_col, rows=False)
    joined = stored.join(F.broadcast(_stitched(stored)), ["part", "side"], "left")
    return joined.select(
        F.col("id").alias("doc_id"),
        F.when(F.col("all_size").isNull(), F.col("keep_id")).otherwise(F.col("all_keep")).alias("keep_id"),
        F.coalesce("all_size", "group_size").alias("group_size"),
        (F.col("is_first") & F.coalesce("heads", F.lit(True))).alias("kept"),
        "text_sha256",
    )


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns; which ones, see groups()."""
    stored = _stored(docs, id_col, text_col, rows=True)
    joined = stored.join(F.broadcast(_stitched(stored)), ["part", "side"], "left")
    return joined.where(F.coalesce("heads", F.lit(True))).select("row.*")
