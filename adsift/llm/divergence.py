"""How far the sources of a language differ in their use of terms, by a frequent-pattern tree of term rows.

A term's row lists the sources that use it, in order, with their counts. For two sources the divergence over all terms is
that of terms neither uses, plus a correction for terms that one uses, plus one for terms that both use. The last needs
pairs inside rows: the rows, sorted, are the paths of a prefix tree in which equal beginnings are one node with a
multiplicity, and the correction of a node and one of its ancestors is worked out once for all terms below.
All arithmetic is in whole numbers.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adsift.session import materialise, ship

ship(__name__)

SCALE = 1_000_000_000
LEAST_DOCS = 3
TOP_TERMS = 200
# In lower-cased UTF-8 a term is a run of letters a-z and of bytes beyond ASCII.
TERM, OTHER = re.compile(rb"[a-z\x80-\xff]+"), re.compile(rb"[^a-z\x80-\xff]")
# Counts a task holds before it passes them on; bytes of a text read at once; pairs of nodes worked on at once.
HELD, STRETCH, PAIRS = 300_000, 1 << 20, 1 << 20
PATH = "array<struct<src:int,p:long,zero:long>>"


def _stretches(text: bytes) -> Iterator[bytes]:
    """The lower-cased text in pieces that no term crosses."""
    at = 0
    while len(text) - at > STRETCH:
        cut = OTHER.search(text, at + STRETCH)
        end = cut.start() if cut else len(text)
        yield text[at:end]
        at = end
    yield text[at:]


def _term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences) and docs (documents that hold it) of docs: lang, source, text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used: dict[tuple, tuple[Counter, Counter]] = {}

        def passed_on() -> pa.RecordBatch:
            names, ns, ds, langs, sources = [], [], [], [], []
            for (lang, source), (n, d) in used.items():
                names += n
                ns += n.values()
                ds += map(d.__getitem__, n)
                langs += [lang] * len(n)
                sources += [source] * len(n)
            used.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(langs, pa.string()), pa.array(sources, pa.string()), pa.array(names, pa.binary()), pa.array(ns, pa.int64()), pa.array(ds, pa.int64())],
                names=["lang", "source", "term", "n", "docs"],
            )

        for batch in batches:
            for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text")), strict=True):
                n, d = used.setdefault((lang, source), (Counter(), Counter()))
                seen: set[bytes] = set()
                for stretch in _stretches(text.lower()):
                    terms = TERM.findall(stretch)
                    n.update(terms)
                    seen.update(terms)
                d.update(seen)
            if sum(len(n) for n, _ in used.values()) > HELD:
                yield passed_on()
        yield passed_on()

    texts = docs.select("lang", "source", F.col("text").cast("binary").alias("text"))
    counted = texts.mapInArrow(count, "lang string, source string, term binary, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(n: Column, total: Column, terms: Column) -> Column:
    """The smoothed share of a term in whole units of 1 / SCALE, at least 1. Counts beyond 64 bits of product go by decimals."""
    wide = F.expr(f"cast({SCALE} as decimal(10,0))") * (n + 1).cast("decimal(20,0)")
    return F.call_function("div", wide, (total + terms).cast("decimal(20,0)")) + 1


def _gap(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _pair_corrections(paths: DataFrame) -> DataFrame:
    """lang, a, b and value: what terms that both sources use add to the divergence of a from b, beyond what each does alone.

    paths: lang, path, m (how many terms have it). Ranges of sorted paths are trees of their own: what a node that a range
    border cuts adds up to does not depend on the cut.
    """

    def nodes_of(path: pa.ListArray, m: np.ndarray):
        """Every node of the tree of these sorted paths: where its own item and its path's first item stand, and its multiplicity."""
        starts = np.asarray(path.offsets)[:-1].astype(np.int64)
        sizes = np.diff(np.asarray(path.offsets)).astype(np.int64)
        values = path.values
        items = np.stack([np.asarray(values.field(k)).astype(np.int64) for k in range(3)], axis=1)
        shared = np.zeros(len(sizes), dtype=np.int64)  # how many items a path shares with the one before
        going = np.arange(1, len(sizes))
        depth = 0
        while len(going):
            going = going[(sizes[going] > depth) & (sizes[going - 1] > depth)]
            same = (items[starts[going] + depth] == items[starts[going - 1] + depth]).all(axis=1)
            going = going[same]
            shared[going] += 1
            depth += 1
        own, first, times = [], [], []
        here = np.arange(len(sizes))
        for depth in range(1, int(sizes.max(initial=0)) + 1):
            here = here[sizes[here] >= depth]
            new = np.flatnonzero(shared[here] < depth)
            if depth > 1:
                own.append(starts[here[new]] + depth - 1)
                first.append(starts[here[new]])
                times.append(np.add.reduceat(m[here], new))
        none = [np.zeros(0, dtype=np.int64)]
        return items, *(np.concatenate(none + x) for x in (own, first, times))

    def gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        return (p - q) ** 2 // q

    def corrections(items, own, first, times) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        above = own - first
        upto = np.cumsum(above)
        at = 0
        while at < len(own):
            end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS, "right")))
            of = np.repeat(np.arange(at, end), above[at:end])
            up = first[of] + np.arange(len(of)) - np.repeat(upto[at:end] - above[at:end] - (upto[at - 1] if at else 0), above[at:end])
            (a, pa_, za), (b, pb, zb), m = items[up].T, items[own[of]].T, times[of]
            keys = np.concatenate([a << 32 | b, b << 32 | a])
            both = lambda p, zp, q, zq: m * (gap(p, q) - gap(p, zq) - gap(zp, q) + gap(zp, zq))
            values = np.concatenate([both(pa_, za, pb, zb), both(pb, zb, pa_, za)])
            names, where = np.unique(keys, return_inverse=True)
            sums = np.zeros(len(names), dtype=np.int64)
            np.add.at(sums, where, values)
            yield names, sums
            at = end

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.asarray(batch.column("lang").to_pylist(), dtype=object)
            cuts = [0, *(np.flatnonzero(langs[1:] != langs[:-1]) + 1), len(langs)] if len(langs) else [0]
            for low, high in zip(cuts, cuts[1:], strict=False):
                part = batch.slice(low, high - low)
                path = pa.concat_arrays([part.column("path")])
                found = list(corrections(*nodes_of(path, np.asarray(part.column("m")))))
                for names, sums in found:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([langs[low]] * len(names), pa.string()), pa.array(names >> 32, pa.int32()), pa.array(names & 0xFFFFFFFF, pa.int32()), pa.array(sums, pa.int64())],
                        names=["lang", "a", "b", "value"],
                    )

    ordered = paths.repartitionByRange("lang", "path").sortWithinPartitions("lang", "path")
    summed = ordered.mapInArrow(walk, "lang string, a int, b int, value long")
    return summed.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least: int = LEAST_DOCS,
          top: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank for every (lang, source) of docs.

    Part "pair": how far the source is from each other source of its language, over all kept terms. Part "term": the terms that
    the source uses more than its language does, the `top` first. Kept are terms that `least` documents of the language hold.
    Equal values stand by item. Null and empty texts, languages and sources count as ''. Repeated rows are documents of their
    own. Sources without terms take part with counts of 0; a language without kept terms has values of 0. An empty table
    gives no row; other columns are not read.
    """
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias
    rows = docs.select(named(lang_col)("lang"), named(source_col)("source"), named(text_col)("text"))
    # src numbers the sources of a language, in order; there are as many results as pairs of them.
    names = rows.select("lang", "source").distinct()
    names = names.withColumn("src", F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("int"))
    names = materialise(names, "sources")
    uses = _term_counts(rows).join(names.select("lang", "source", "src"), ["lang", "source"])
    use = F.struct("src", "n").alias("use")
    kept = uses.select("lang", "term", "docs", "n", use).groupBy("lang", "term").agg(
        F.sum("docs").alias("docs"), F.sum("n").alias("all_n"), F.sort_array(F.collect_list("use")).alias("uses"))
    kept = materialise(kept.where(F.col("docs") >= least).select("lang", F.col("term").cast("string").alias("term"), "all_n", "uses"), "kept_terms")

    flat = kept.select("lang", "term", "all_n", F.explode("uses").alias("use")).select("lang", "term", "all_n", "use.src", "use.n")
    sizes = flat.groupBy("lang", "src").agg(F.sum("n").alias("size"))
    vocab = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("all_n").alias("lang_size"))
    groups = names.join(vocab, "lang", "left").join(sizes, ["lang", "src"], "left").fillna(0, ["v", "lang_size", "size"])
    zero = F.when(F.col("v") > 0, _share(F.lit(0).cast("long"), F.col("size"), F.col("v")))
    groups = materialise(groups.withColumn("zero", zero), "groups")

    shares = flat.join(groups, ["lang", "src"]).withColumn("p", _share(F.col("n"), F.col("size"), F.col("v")))
    shares = materialise(shares.withColumn("q", _share(F.col("all_n"), F.col("lang_size"), F.col("v"))).select("lang", "term", "source", "src", "p", "q", "zero"), "shares")

    above = shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _gap(F.col("p"), F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    telling = above.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)

    item = F.struct("src", "p", "zero")
    paths = shares.groupBy("lang", "term").agg(F.sort_array(F.collect_list(item)).alias("path"))
    paths = paths.groupBy("lang", "path").agg(F.count("*").alias("m"))
    both = _pair_corrections(materialise(paths.where(F.size("path") > 1), "paths"))

    # What a term does that one of the two sources uses, by the share it has there.
    alone = shares.groupBy("lang", "src", "p", "zero").agg(F.count("*").alias("m"))
    other = groups.where("v > 0").select("lang", F.col("src").alias("o"), F.col("zero").alias("o_zero"))
    single = alone.join(other, "lang").where("src <> o")
    none = lambda p, q: _gap(F.col(p), F.col(q))
    forth = single.select("lang", F.col("src").alias("a"), F.col("o").alias("b"), (F.col("m") * (none("p", "o_zero") - none("zero", "o_zero"))).alias("value"))
    back = single.select("lang", F.col("o").alias("a"), F.col("src").alias("b"), (F.col("m") * (none("o_zero", "p") - none("o_zero", "zero"))).alias("value"))
    added = forth.unionByName(back).groupBy("lang", "a", "b").agg(F.sum("value").alias("value")).unionByName(both)
    added = added.groupBy("lang", "a", "b").agg(F.sum("value").alias("added"))

    a = groups.select("lang", "source", F.col("src").alias("a"), "v", "zero")
    b = groups.select("lang", F.col("source").alias("item"), F.col("src").alias("b"), F.col("zero").alias("o_zero"))
    pairs = a.join(b, "lang").where("a <> b").join(added, ["lang", "a", "b"], "left")
    value = F.when(F.col("v") > 0, F.col("v") * none("zero", "o_zero") + F.coalesce("added", F.lit(0))).otherwise(F.lit(0))
    apart = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", value.cast("long").alias("value"))
    apart = apart.withColumn("rank", F.row_number().over(order))
    return apart.unionByName(telling)
