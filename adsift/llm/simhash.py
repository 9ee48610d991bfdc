"""SimHash near-duplicates found by vantage-point trees.

A vantage point is compared with one block of the fingerprint's bits, and fingerprints are parted by their distance to it.
By the triangle inequality the distances of two fingerprints to one vantage point differ by no more than the bits in which
they differ in that block; the blocks share no bits, so the differences of all blocks together stay within the limit. Each
child keeps what is left of the limit and drops the queries that have used it up.

The first levels of the tree are shards: every distinct fingerprint is at home in one, and visits the neighbouring shards
that the bound cannot exclude. Shards of many rows are cut into home blocks times query blocks. Below, each task goes on
with the tree and compares what is left exactly, keeping only links that join two classes.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adsift.llm import links
from adsift.session import materialise, ship

ship(__name__)

SEED = 42
SHINGLE, MOST_BITS = 3, 3
# (lowest bit, bits) of the shard levels by the number of fingerprints up to which they serve: more fingerprints, more
# shards. The result is the same with any of them.
SHARD_LEVELS = ((20_000_000, ((0, 32), (32, 32))), (1_000_000_000, ((0, 22), (22, 21), (43, 21))),
                (None, ((0, 16), (16, 16), (32, 16), (48, 16))))
# The levels in a task.
FINE_BLOCKS = tuple((at, 8) for at in range(0, 64, 8))
# Pairs compared at once, and homes whose links are folded in before the next are compared.
EXACT_PAIRS, HOME_CHUNK = 1_000_000, 512
LEAST_UNIT_ROWS, HOME_ROWS = 2_000, 500_000
MOST_HOME_BLOCKS, MOST_QUERY_BLOCKS = 3, 16
HASHES_AT_ONCE = 65_536


def _vantage(block: int) -> int:
    """A fixed 64-bit pattern for a block."""
    x = (block + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & (1 << 64) - 1
    return x ^ x >> 31


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The majority bits of the XXH64 hashes of all word shingles (repeats count); without words 0."""
    import xxhash

    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes.lower changes A-Z only, split cuts at ASCII space
    if not words:
        return 0
    whole, size = b" ".join(words), min(shingle, len(words))
    ends = list(itertools.accumulate(len(w) + 1 for w in words))
    starts, hashed = [0, *ends[:-1]], xxhash.xxh64_intdigest
    total, ones = len(words) - size + 1, np.zeros(64, dtype=np.int64)
    for at in range(0, total, HASHES_AT_ONCE):
        upto = min(total, at + HASHES_AT_ONCE)
        values = [hashed(whole[a : b - 1], SEED) for a, b in zip(starts[at:upto], ends[at + size - 1 : upto + size - 1], strict=True)]
        bits = np.unpackbits(np.array(values, dtype="<u8").view(np.uint8), bitorder="little").reshape(-1, 64)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, keep: list[Column], text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """The columns of keep and fp, the fingerprint as a signed long."""
    texts = docs.select(F.struct(*keep).alias("kept"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            fp = np.array([fingerprint(t.as_py(), shingle) for t in texts], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("kept"), pa.array(fp)], names=["kept", "fp"])

    kind = texts.schema["kept"].dataType.simpleString()
    return texts.mapInArrow(run, f"kept {kind}, fp long").select("kept.*", "fp")


def _distance(fp: Column, block: int, at: int, bits: int) -> Column:
    signed = lambda x: F.lit(x - (1 << 64) if x >= 1 << 63 else x)
    return F.bit_count(fp.bitwiseXOR(signed(_vantage(block))).bitwiseAND(signed(((1 << bits) - 1) << at)))


def _shards(fps: DataFrame, most: int, blocks: tuple[tuple[int, int], ...]) -> tuple[DataFrame, DataFrame]:
    """(homes, visits): (shard, fp) of every fingerprint's own shard, and of the shards it visits.

    Of two fingerprints the one with the smaller distances (in the order of the levels) visits the other's shard, so only
    shards from its own on are visited.
    """
    homes = fps.select("fp", *[_distance(F.col("fp"), n, at, bits).cast("int").alias(f"d{n}") for n, (at, bits) in enumerate(blocks)])
    steps = [s for s in itertools.product(range(-most, most + 1), repeat=len(blocks)) if sum(map(abs, s)) <= most and s >= (0,) * len(s)]
    size = max(bits for _, bits in blocks) + 1
    code = lambda ds: sum((d * size**k for k, d in enumerate(ds)), F.lit(0))
    here = [F.col(f"d{n}") for n in range(len(blocks))]
    aims = []
    for s in steps:
        there = [d + move for d, move in zip(here, s, strict=True)]
        exists = [d.between(0, bits) for d, (_, bits) in zip(there, blocks, strict=True)]
        aims.append(F.when(reduce(Column.__and__, exists), code(there)))
    own = homes.select(code(here).alias("shard"), "fp")
    visits = homes.select(F.explode(F.array_compact(F.array(*aims))).alias("shard"), "fp")
    return own, visits


def _units(homes: DataFrame, visits: DataFrame, unit_rows: int) -> DataFrame:
    """Rows (unit, visitor, fp): every home meets every visitor of its shard in exactly one unit.

    A shard is cut into home blocks times query blocks of about unit_rows, but not so finely that the copies outweigh the
    visits; a home block is cut further where it would not fit a task. The table of shards, which says how, is bounded by
    the number of distances and not by the data.
    """
    cuts = lambda n, most: F.greatest(F.lit(1), F.least(F.ceil(F.col(n) / unit_rows), F.lit(most)))
    sizes = homes.groupBy("shard").agg(F.count("*").alias("h")).join(visits.groupBy("shard").agg(F.count("*").alias("v")), "shard")
    home_blocks = F.greatest(cuts("h", MOST_HOME_BLOCKS), F.ceil(F.col("h") / HOME_ROWS)).cast("int")
    cut = F.broadcast(sizes.select("shard", home_blocks.alias("hs"), cuts("v", MOST_QUERY_BLOCKS).cast("int").alias("vs")))
    named = lambda h, v: F.concat_ws("/", "shard", h, v)
    at = F.xxhash64("fp", F.lit(7))
    mine = homes.join(cut, "shard").withColumn("h", F.pmod(at, "hs"))
    mine = mine.withColumn("v", F.explode(F.sequence(F.lit(0), F.col("vs") - 1)))
    theirs = visits.join(cut, "shard").withColumn("v", F.pmod(at, "vs"))
    theirs = theirs.withColumn("h", F.explode(F.sequence(F.lit(0), F.col("hs") - 1)))
    rows = mine.select(named("h", "v").alias("unit"), F.lit(False).alias("visitor"), "fp")
    return rows.unionByName(theirs.select(named("h", "v").alias("unit"), F.lit(True).alias("visitor"), "fp"))


class _Classes:
    """Disjoint classes of numbers 0..n-1; the smallest is a class's name."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def names(self) -> np.ndarray:
        while True:
            over = self.up[self.up]
            if np.array_equal(over, self.up):
                return over
            self.up = over

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Unite a[k] with b[k] for all k."""
        while True:
            names = self.names()
            x, y = names[a], names[b]
            if np.array_equal(x, y):
                return
            low, high = np.minimum(x, y), np.maximum(x, y)
            np.minimum.at(self.up, high, low)


def _compare(points: np.ndarray, homes: np.ndarray, visitors: np.ndarray, classes: _Classes, most: int) -> None:
    """Link homes and visitors (numbers of points) within `most` bits; pairs already in one class are passed over."""
    for at in range(0, len(homes), HOME_CHUNK):
        chunk = homes[at : at + HOME_CHUNK]
        names = classes.names()
        # A class that holds both whole chunk and some visitors has nothing to gain from comparing them.
        if len(np.unique(names[chunk])) == 1:
            visitors = visitors[names[visitors] != names[chunk[0]]]
            if not len(visitors):
                continue
        step = max(1, EXACT_PAIRS // len(chunk))
        for b in range(0, len(visitors), step):
            some = visitors[b : b + step]
            near = np.bitwise_count(points[chunk][:, None] ^ points[some][None, :]) <= most
            i, j = np.nonzero(near)
            classes.join(chunk[i], some[j])


def _search(points: np.ndarray, homes: np.ndarray, visitors: np.ndarray, left: np.ndarray, level: int, classes: _Classes, most: int) -> None:
    """One node of the tree: part by the distance to the level's vantage point; left is each visitor's remaining limit."""
    if level == len(FINE_BLOCKS) or len(homes) * len(visitors) <= EXACT_PAIRS:
        _compare(points, homes, visitors, classes, most)
        return
    at, bits = FINE_BLOCKS[level]
    mask, point = np.uint64(((1 << bits) - 1) << at), np.uint64(_vantage(100 + level))
    away = lambda of: np.bitwise_count((points[of] ^ point) & mask).astype(np.int64)
    of_homes, of_visitors = away(homes), away(visitors)
    for ring in np.unique(of_homes):
        rest = left - np.abs(of_visitors - ring)
        inside = rest >= 0
        if inside.any():
            _search(points, homes[of_homes == ring], visitors[inside], rest[inside], level + 1, classes, most)


def _linked(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """For each unit, sorted by unit, the links (fp, name) of every fingerprint that got into a class of two or more."""

    def solved(homes: np.ndarray, visitors: np.ndarray) -> pa.RecordBatch:
        points, where = np.unique(np.concatenate([homes, visitors]), return_inverse=True)
        h, v = where[: len(homes)], where[len(homes) :]
        classes = _Classes(len(points))
        if len(h) and len(v):
            _search(points, h, v, np.full(len(v), most), 0, classes, most)
        names = classes.names()
        linked = np.flatnonzero(names != np.arange(len(names)))
        return pa.RecordBatch.from_arrays(
            [pa.array(points[linked].view(np.int64)), pa.array(points[names[linked]].view(np.int64))], names=["a", "b"]
        )

    unit, parts = None, []
    for batch in batches:
        units = np.asarray(batch.column("unit").to_pylist(), dtype=object)
        fps, visits = (np.asarray(batch.column(c).to_numpy(zero_copy_only=False)) for c in ("fp", "visitor"))
        edges = [0, *(np.flatnonzero(units[1:] != units[:-1]) + 1), len(units)]
        for a, b in itertools.pairwise(edges):
            if units[a] != unit:
                if parts:
                    f, v = (np.concatenate(x) for x in zip(*parts, strict=True))
                    yield solved(f[~v].view(np.uint64), f[v].view(np.uint64))
                unit, parts = units[a], []
            parts.append((fps[a:b].astype(np.int64), visits[a:b].astype(bool)))
    if parts:
        f, v = (np.concatenate(x) for x in zip(*parts, strict=True))
        yield solved(f[~v].view(np.uint64), f[v].view(np.uint64))


def classes(fps: DataFrame, most: int = MOST_BITS, unit_rows: int | None = None, blocks: tuple[tuple[int, int], ...] | None = None) -> DataFrame:
    """(fp, class): of the distinct fingerprints fps (stored) those that chains of links of `most` bits join, and their class."""
    total, spark = fps.count(), fps.sparkSession
    blocks = blocks or next(b for upto, b in SHARD_LEVELS if upto is None or total <= upto)
    homes, visits = _shards(fps, most, blocks)
    if unit_rows is None:
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        unit_rows = max(LEAST_UNIT_ROWS, 14 * total // (4 * parts))
    units = _units(homes, visits, unit_rows)
    dealt = units.repartition("unit").sortWithinPartitions("unit")
    found = materialise(dealt.mapInArrow(lambda it: _linked(it, most), "a long, b long"), "simhash_links")
    return links.components(found).select(F.col("node").alias("fp"), F.col("component").alias("class"))


def _with_classes(rows: DataFrame, most: int, unit_rows: int | None) -> DataFrame:
    """rows (stored, with fp and key) with best, the smallest key of each row's component.

    Fingerprints and classes of many rows are the wide sides of left joins, which Spark splits where they are skewed.
    """
    fps = materialise(rows.groupBy("fp").agg(F.min("key").alias("key")), "fingerprints")
    named = fps.join(classes(fps, most, unit_rows), "fp", "left").withColumn("class", F.coalesce("class", "fp"))
    named = materialise(named, "fingerprint_classes")
    best = materialise(named.groupBy("class").agg(F.min("key").alias("best")), "classes")
    of_fp = materialise(named.join(best, "class", "left").select("fp", "best"), "bests")
    return rows.join(of_fp, "fp", "left")


def near_duplicates(docs: DataFrame, most: int = MOST_BITS, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text", unit_rows: int | None = None) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable by links).

    Texts are lower-cased in A-Z and cut into words at ASCII space; texts of fewer words than a shingle are one shingle,
    texts without words (null, empty) have fingerprint zero and link like any other. Null identifiers are reachable but
    are named only where a component has no other. Empty tables give empty results; other columns are not read.
    """
    key = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id")).alias("key")
    rows = materialise(fingerprints(docs, [key], text_col, shingle), "simhash")
    out = _with_classes(rows, most, unit_rows)
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return out.select(F.col("key.id").alias("doc_id"), digits.alias("fingerprint"), F.col("best.id").alias("component_id"))


def representatives(docs: DataFrame, most: int = MOST_BITS, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, one of each component: that with the smallest identifier (null last), then text hash.

    Rows of equal identifier and text stand or fall together.
    """
    key = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("hash")).alias("key")
    rows = materialise(fingerprints(docs, [key], text_col, shingle), "simhash")
    best = _with_classes(rows, most, None).where(F.col("key") == F.col("best")).select(F.col("key").alias("_key")).distinct()
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), key.alias("_key"))
    return own.join(best, "_key", "left_semi").select("row.*")
