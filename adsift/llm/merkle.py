"""A Merkle manifest of a dataset: a tree of digests for each source, and one over the sources' roots.

Rows get gapless ranks inside their source. The rank's base-16 digits are grouped away one after the other inside blocks of
4,096 rows, each grouping nesting the structs of the one below, so that a block ends as one row that holds its tree. Block
digests are ranked rows again, a table 4,096 times smaller, and so on up to the source's root; the roots of all sources
then go the same way. Proofs come back down by transform and explode: a block's way to the root is one more row in the
grouping of its block, so that no join is needed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adsift.session import materialise

FAN = 16
DIGITS = 3
PATH = "array<struct<left:string,right:string>>"
LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def leaf(*values: Column) -> Column:
    """Digest of a row: every value as its UTF-8 byte count, a colon and the value, or as "-" if null."""

    def part(value: Column) -> Column:
        text = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*map(part, values)), 256)


def _numbered(nodes: DataFrame, order: Sequence[str]) -> DataFrame:
    """nodes with rank (from 0, without gaps, inside grp) and n (rows of grp).

    Ranges of (grp, order) split groups of any size; rows equal in all of that are told apart by their place in the input,
    so that a hot row is split as well. Counts of ranges give the ranks their start.
    """
    ranged = nodes.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange("grp", *order, "_tie").drop("_tie")
    ranged = materialise(ranged.withColumn("part", F.spark_partition_id()), "ranged")
    counts = ranged.groupBy("grp", "part").agg(F.count("*").alias("count"))
    ahead = Window.partitionBy("grp").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("before")
    counts = counts.select("grp", "part", before, F.sum("count").over(Window.partitionBy("grp")).alias("n"))
    inside = F.row_number().over(Window.partitionBy("grp", "part").orderBy(*order))
    return ranged.join(counts, ["grp", "part"]).withColumn("rank", F.col("before") + inside - 1).drop("part", "before")


def _alive(n: Column, level: int) -> Column:
    """Whether more than one node remains below this level (1: the leaves' own)."""
    return n > FAN ** (level - 1)


def _rolled(nodes: DataFrame, digits: int) -> DataFrame:
    """grp, rank and n of blocks, hash, below (how many nodes there were), kids (nested structs), of nodes: grp, rank, n, hash, item."""
    keys = ["grp", "below", "block", *[f"d{k}" for k in range(digits, 0, -1)]]
    block = F.expr(f"rank div {FAN**digits}")
    held = nodes.select("grp", F.col("n").alias("below"), block.alias("block"), "hash", "item",
                        *[F.expr(f"cast(rank div {FAN ** (k - 1)} % {FAN} as int)").alias(f"d{k}") for k in range(1, digits + 1)])
    # One exchange by block serves all the groupings.
    held, inner = held.repartition("grp", "block"), "item"
    for level in range(1, digits + 1):
        keys.remove(f"d{level}")
        node = F.struct(F.col(f"d{level}").alias("digit"), "hash", inner)
        held = held.groupBy(*keys).agg(F.sort_array(F.collect_list(node)).alias("kids"))
        hashes = F.col("kids")["hash"]
        joined = F.when(_alive(F.col("below"), level), F.sha2(F.array_join(hashes, ""), 256)).otherwise(hashes[0])
        held, inner = held.withColumn("hash", joined), "kids"
    return held.select("grp", F.col("block").alias("rank"), F.expr(f"(below - 1) div {FAN**digits} + 1").alias("n"), "hash", "below", "kids")


def _tree(nodes: DataFrame, digits: int) -> list[DataFrame]:
    """The tables of blocks, each over the one before, until every group is one block. The number of rounds is the
    logarithm of the largest group."""
    rounds = [materialise(_rolled(nodes, digits), "blocks")]
    while (rounds[-1].agg(F.max("n")).first()[0] or 0) > 1:
        upper = rounds[-1].select("grp", "rank", "n", "hash", F.struct("rank").alias("item"))
        rounds.append(materialise(_rolled(upper, digits), "blocks"))
    return rounds


def _placed(kids: Column, level: int) -> Column:
    """The nodes of a run: array of (hash, inner, beside), beside holding the siblings left and right, if the level counts."""
    hashes = kids["hash"]

    def one(kid: Column, at: Column) -> Column:
        left, right = F.slice(hashes, F.lit(1), at), F.slice(hashes, at + 2, F.lit(FAN))
        beside = F.struct(F.array_join(left, "").alias("left"), F.array_join(right, "").alias("right"))
        inner = kid["kids" if level > 1 else "item"].alias("inner")
        return F.struct(kid["hash"].alias("hash"), inner, F.when(_alive(F.col("below"), level), beside).alias("beside"))

    return F.transform(kids, one)


def _down(rounds: list[DataFrame], above: DataFrame, digits: int) -> DataFrame:
    """grp, hash, item, path and carry of the leaves; above: grp, rank (0), path and carry of the groups' tops."""
    for number, blocks in enumerate(reversed(rounds)):
        both = blocks.drop("n", "hash").unionByName(above, allowMissingColumns=True)
        first = lambda c: F.first(c, ignorenulls=True).alias(c)
        rows = both.groupBy("grp", "rank").agg(*map(first, ("below", "kids", "path", "carry")))
        for level in range(digits, 0, -1):
            opened = rows.select("grp", "rank", "below", "path", "carry", F.explode(_placed(F.col("kids"), level)).alias("k"))
            path = F.concat(F.array_compact(F.array("k.beside")).cast(PATH), "path")
            rows = opened.select("grp", "rank", "below", path.alias("path"), "carry", "k.hash", F.col("k.inner").alias("kids"))
        rows = rows.select("grp", "hash", F.col("kids").alias("item"), "path", "carry")
        if number + 1 < len(rounds):
            above = rows.select("grp", F.col("item.rank").alias("rank"), "path", "carry")
    return rows


def proofs(docs: DataFrame, columns: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), id_col: str = "doc_id",
           source_col: str = "source", claim: Column | None = None, digits: int = DIGITS) -> DataFrame:
    """One row per row of docs: doc_id, leaf, claim, path, subroot, root.

    path holds the siblings left and right of the way to the root, from the leaf up, concatenated; claim is carried along
    (a further Column over docs). Rows stand by identifier inside their source, null first, equal ones by leaf; repeated rows
    are leaves of their own. A null source is one of its own, before all others. An empty table gives no row; columns not
    named are not read.
    """
    grp = F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit(""))
    item = F.struct(F.col(id_col).alias("doc_id"), (F.lit(None).cast("string") if claim is None else claim).alias("claim"))
    rows = docs.select(grp.alias("grp"), leaf(*[F.col(c) for c in columns]).alias("hash"), item.alias("item"))
    rows = materialise(rows.withColumn("doc_id", F.col("item.doc_id")), "leaves")
    trees = _tree(_numbered(rows, ["doc_id", "hash"]).drop("doc_id"), digits)
    # The names' order is bytewise, and the null source's empty name comes first.
    subroots = trees[-1].select(F.lit("").alias("grp"), F.col("grp").alias("name"), "hash", F.struct(F.col("grp").alias("name")).alias("item"))
    top = _tree(_numbered(subroots, ["name"]).drop("name"), digits)
    none, zero = F.array().cast(PATH).alias("path"), F.lit(0).cast("long").alias("rank")
    tops = top[-1].select("grp", zero, none, F.struct(F.col("hash").alias("root")).alias("carry"))
    subs = _down(top, tops, digits)
    subs = subs.select(F.col("item.name").alias("grp"), zero, "path", F.struct(F.col("hash").alias("subroot"), "carry.root").alias("carry"))
    return _down(trees, subs, digits).select("item.doc_id", F.col("hash").alias("leaf"), "item.claim", "path", "carry.subroot", "carry.root")


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and the siblings on its way lead to."""
    return F.aggregate(path, start, lambda at, x: F.sha2(F.concat(x["left"], at, x["right"]), 256))


def audit(docs: DataFrame, every: int = 5) -> DataFrame:
    """One row per row of docs: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    Where `every` divides crc32 of the decimal doc_id, the text is checked as if lower-cased (A-Z); null identifiers and null texts
    stay as they are.
    """
    text = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % every == 0, F.translate("text", *LOWER)).otherwise(F.col("text"))
    claim = leaf(*[F.col(c) for c in ("doc_id", "source", "lang", "n_chars")], text)
    found = proofs(docs, claim=claim).withColumn("folded_root", folded(F.col("claim"), F.col("path")))
    beside = F.array_join(F.transform("path", lambda x: F.concat(x["left"], x["right"])), "")
    return found.select("doc_id", "leaf", "subroot", "root", F.sha2(beside, 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
