"""Mixing sources to target weights along a training curriculum.

Every source has a demand schedule over training time: piecewise linear, scaled so that its integral is the source's
target. A document stands at the middle of its words in the source's running sum (repeats continue the sum); inverting the
integral gives its training position, and range-sorting by position gives the training order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adsift.llm import running
from adsift.session import materialise

SEED = 9_173
WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
WORD = r"[^\x20\x09-\x0D]+"
# (time, relative demand) for each weight in turn: heavy sources fade, light ones grow towards the end.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 0.8), (1.0, 2.0)))

Knots = Sequence[tuple[float, float]]


def position(share: Column, knots: Knots) -> Column:
    """The time at which the integral of a piecewise linear demand has reached this share (0 to 1) of its whole; null for null."""
    if knots[0][0] != 0 or knots[-1][0] != 1 or any(a[0] >= b[0] for a, b in zip(knots, knots[1:], strict=False)):
        raise ValueError("times must rise from 0 to 1")
    areas = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:], strict=False)]
    if min(k[1] for k in knots) < 0 or sum(areas) <= 0:
        raise ValueError("demand must not be below 0, nor 0 throughout")
    wanted = share * float(sum(areas))
    pieces, done = [], 0.0
    for (t, m), (u, n), area in zip(knots, knots[1:], areas, strict=False):
        rest, slope = F.greatest(wanted - done, F.lit(0.0)), (n - m) / (u - t)
        root = F.sqrt(F.greatest(F.lit(m * m) + rest * (2 * slope), F.lit(0.0)))
        if area > 0:
            pieces.append((done + area, F.least(F.lit(t) + rest * 2 / (F.lit(m) + root), F.lit(u))))
        done += area
    found = pieces[-1][1]
    for upto, at in reversed(pieces[:-1]):
        found = F.when(wanted <= upto, at).otherwise(found)
    return F.when(share.isNotNull(), found)


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """For each source (src, never null; "" is the null source, last) its size, target and the number of its weight.

    All words are shared by weight; a target stops at `most` times its source's size and the excess is shared again. In
    the order of most * size / weight the capped sources come first, so one running sum finds the level of the others.
    The windows here are over sources, of which a table has few.
    """
    names = sizes.groupBy("src").agg(F.sum("size").alias("source_size"))
    turn = (F.row_number().over(Window.orderBy(F.col("src") == "", "src")) - 1) % len(weights)
    named = names.withColumn("turn", turn).withColumn("weight", F.array(*map(F.lit, weights))[F.col("turn")])
    named = named.withColumn("cap", F.col("source_size") * most)
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), "src")
    ahead, rest = by_level.rowsBetween(Window.unboundedPreceding, -1), by_level.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(0))
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(ahead), F.lit(0))
    named = named.withColumn("level", left / F.sum("weight").over(rest))
    open_level = F.when(F.col("cap") >= F.col("level") * F.col("weight"), F.col("level"))
    # The level of the first source that its cap does not stop; the figures of later ones are not above it.
    named = named.withColumn("level", F.max(open_level).over(everything))
    target = F.least(F.col("cap").cast("double"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap").cast("double")))
    return named.select("src", "source_size", "turn", target.alias("target"))


def _placed(docs: DataFrame, source_col: str, text_col: str, id_col: str, carry: bool) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("")).alias("src"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        F.xxhash64(F.lit(SEED), F.col(id_col), text).alias("_order"),
        *([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []),
    )
    narrow = materialise(rows.drop("row"), "sizes")
    offsets = running.cell_offsets(running.with_cells(narrow, "_order"), "src", "size").join(targets(narrow), "src")
    cells = running.with_cells(rows if carry else narrow, "_order")
    placed = running.running(cells, offsets, "src", ["_order", "doc_id", "size"], "size", "_ahead")
    middle = F.col("_ahead") + F.col("size") / 2
    share = lambda k: (middle + F.col("source_size") * k) / F.col("target")
    when = [F.when((F.col("size") > 0) & (F.col("target") > 0) & (share(k) < 1), share(k)) for k in range(MOST_REPEATS)]
    timed = [F.when(F.col("turn") % len(SCHEDULES) == 0, position(s, SCHEDULES[0])) for s in when]
    for n in range(1, len(SCHEDULES)):
        timed = [t.when(F.col("turn") % len(SCHEDULES) == n, position(s, SCHEDULES[n])) for t, s in zip(timed, when, strict=True)]
    return placed.withColumn("positions", F.array_compact(F.array(*timed)))


def mix(docs: DataFrame, source_col: str = "source", text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per row of docs, in training order of its first use: doc_id, size, source_size, target, taken, positions.

    size is the number of words (null: 0). A document whose middle lies beyond the target is not taken again, so the words
    taken of a source miss its target by half a document at most, and no document is used more than 3 times. Documents
    without words take part in nothing. Order inside a source is that of a hash of id and text: reruns agree, and
    identical rows are interchangeable. Empty tables give empty results; other columns are not read.
    """
    placed = _placed(docs, source_col, text_col, id_col, carry=False)
    taken = F.col("size") * F.size("positions")
    out = placed.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), "positions")
    return out.orderBy(F.element_at(F.array_append("positions", F.lit(2.0)), 1), "doc_id")


def training_order(docs: DataFrame, source_col: str = "source", text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of docs as often as the mix takes them, range-sorted by training position."""
    placed = _placed(docs, source_col, text_col, id_col, carry=True)
    uses = placed.select("row", "doc_id", F.explode("positions").alias("position"))
    return uses.orderBy("position", "doc_id").select("row.*")
