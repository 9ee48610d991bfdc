"""Exact top-k search by distributed histogram selection.

For each query all scores are counted into a histogram of a few hundred bins; the bin that holds the k-th best score
becomes the range of the next, finer histogram, until a bin is one integer wide. A last pass keeps the scores that reach
the k-th value and breaks ties by identifier. Queries are taken in blocks of bounded size, each broadcast once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from adsift.session import materialise, ship

ship(__name__)

BINS = 512
# Queries in a block, and components in a block: what a broadcast holds at most.
BLOCK_QUERIES, BLOCK_NUMBERS = 16_384, 4_000_000
# Scores computed at once in a task.
TILE = 2_000_000
BEYOND = 2**61


def integers(vectors: DataFrame, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v): each component x as floor(scale * x), x as double; rows with null or non-finite parts are left out."""
    v = F.col(vector_col).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    scaled = F.transform(v, lambda x: F.floor(x * scale).cast("long"))
    return vectors.where(F.col(vector_col).isNotNull()).where(finite).select(F.col(id_col).alias("vec_id"), scaled.alias("v"))


def _tiles(batches: Iterator[pa.RecordBatch], block: dict) -> Iterator[tuple]:
    """(numbers of the queries, identifiers, scores queries x candidates) for candidates of the queries' own length.

    Vectors of different lengths have no inner product. Scores are exact: in doubles where no partial sum can reach 2^53,
    else in 64-bit integers, or in integers of any size where those could wrap around. Scores of BEYOND and more raise.
    """
    for batch in batches:
        ids, lists = batch.column("vec_id"), batch.column("v")
        lengths = np.asarray(lists.value_lengths())
        flat = np.asarray(lists.flatten())
        starts = np.concatenate([[0], np.cumsum(lengths)])
        known = np.array([x if x is not None else -(2**63) for x in ids.to_pylist()], dtype=np.int64)
        for size, (numbers, queries) in block["by_size"].items():
            rows = np.flatnonzero(lengths == size)
            step = max(1, TILE // max(1, len(numbers)))
            for at in range(0, len(rows), step):
                some = rows[at : at + step]
                matrix = flat[(starts[some][:, None] + np.arange(size)[None, :]).ravel()].reshape(len(some), size)
                reach = float(np.abs(queries).max(initial=0)) * float(np.abs(matrix).max(initial=0)) * size
                if reach < 2**53:
                    scores = (queries.astype(np.float64) @ matrix.T.astype(np.float64)).astype(np.int64)
                elif reach < BEYOND:
                    scores = queries @ matrix.T
                else:
                    exact = queries.astype(object) @ matrix.T.astype(object)
                    if np.abs(exact).max(initial=0) >= BEYOND:
                        raise OverflowError("a score of 2**61 or more")
                    scores = exact.astype(np.int64)
                own = block["ids"][numbers][:, None] == known[some][None, :]
                nulls = np.array([not ids[int(k)].is_valid for k in some], dtype=bool)
                own[:, nulls] = False
                yield numbers, known[some], nulls, scores, own


def _histograms(batches: Iterator[pa.RecordBatch], block: dict, low: np.ndarray, width: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    """The scores of each query by bin from low on, all beyond the last bin in one more.

    The k-th best of all scores is not below the k-th best of one task's, so bins below that one are left out.
    """
    counts = np.zeros((len(low), BINS + 1), dtype=np.int64)
    for numbers, _, _, scores, own in _tiles(batches, block):
        bins = np.minimum((scores - low[numbers][:, None]) // width[numbers][:, None], BINS)
        at = bins + (np.arange(len(numbers)) * (BINS + 1))[:, None]
        use = (bins >= 0) & ~own
        counts[numbers] += np.bincount(at[use], minlength=len(numbers) * (BINS + 1)).reshape(len(numbers), BINS + 1)
    better = counts[:, ::-1].cumsum(axis=1)[:, ::-1] - counts
    q, b = np.nonzero((counts > 0) & (better < k))
    yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(counts[q, b])], names=["q", "bin", "n"])


def _winners(batches: Iterator[pa.RecordBatch], block: dict, least: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    """The scores that reach a query's least; of one task's, the k best by score, then identifier, suffice."""
    held: dict[int, list[tuple[int, bool, int]]] = {}
    for numbers, ids, nulls, scores, own in _tiles(batches, block):
        q, c = np.nonzero((scores >= least[numbers][:, None]) & ~own)
        order = np.lexsort((ids[c], nulls[c], -scores[q, c], q))
        q, c = q[order], c[order]
        near = np.arange(len(q)) - np.searchsorted(q, q) < k
        for a, b in zip(q[near], c[near], strict=True):
            best = held.setdefault(int(numbers[a]), [])
            best.append((-int(scores[a, b]), bool(nulls[b]), int(ids[b])))
            if len(best) > 4 * k:
                best.sort()
                del best[k:]
    rows = [(int(block["ids"][n]), None if null else i, -s) for n, best in held.items() for s, null, i in sorted(best)[:k]]
    yield pa.RecordBatch.from_arrays(
        [pa.array([r[c] for r in rows], pa.int64()) for c in range(3)], names=["query_id", "vec_id", "score"]
    )


def _block_search(rows: DataFrame, queries: list, reach: dict[int, float], k: int) -> DataFrame:
    ids = np.array([r.vec_id for r in queries], dtype=np.int64)
    by_size = {}
    for size in sorted({len(r.v) for r in queries}):
        numbers = np.array([i for i, r in enumerate(queries) if len(r.v) == size])
        by_size[size] = (numbers, np.array([queries[i].v for i in numbers], dtype=np.int64).reshape(len(numbers), size))
    sent = rows.sparkSession.sparkContext.broadcast({"ids": ids, "by_size": by_size})
    # By Cauchy-Schwarz no score lies beyond the query's length times the longest candidate's.
    long = [np.sqrt(sum(float(x) ** 2 for x in r.v)) * reach.get(len(r.v), 0.0) for r in queries]
    bound = np.minimum(np.array(long) * (1 + 1e-9) + 2, float(BEYOND)).astype(np.int64)
    low, high = -bound, bound
    least, open_ = np.full(len(ids), np.iinfo(np.int64).min), np.ones(len(ids), dtype=bool)
    while open_.any():
        width = np.maximum(1, -((low - high) // BINS))
        counted = rows.mapInArrow(lambda it, a=low.copy(), w=width: _histograms(it, sent.value, a, w, k), "q int, bin int, n long")
        totals = counted.groupBy("q", "bin").agg(F.sum("n").alias("n"))
        reached = totals.withColumn("above", F.sum("n").over(Window.partitionBy("q").orderBy(F.desc("bin")))).where(F.col("above") >= k)
        # One row a query of the block.
        found = {r.q: r.bin for r in reached.groupBy("q").agg(F.max("bin").alias("bin")).collect()}
        for q in np.flatnonzero(open_):
            if q not in found:  # fewer than k candidates: every score wins
                open_[q] = False
                continue
            low[q] += found[q] * width[q]
            high[q] = low[q] + width[q]
            if width[q] == 1:
                least[q], open_[q] = low[q], False
    return rows.mapInArrow(lambda it: _winners(it, sent.value, least, k), "query_id long, vec_id long, score long")


def search(vectors: DataFrame, every: int = 50, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best inner products of each row whose identifier is divisible by `every`.

    Candidates are all rows but those with the query's own identifier; ties go to the smaller identifier, null last. All
    candidates come back where there are fewer than k. Vectors that are null or hold null or non-finite parts take no
    part, and vectors of another length than the query's are no candidates. Of several query rows with one identifier
    the least vector asks. Scores are exact; one of 2**61 or more, either way, is an error. Empty tables give empty results; other columns are not read.
    """
    rows = materialise(integers(vectors, scale, id_col, vector_col), "vectors")
    squares = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    # One row for each length of vectors.
    reach = {r.size: float(np.sqrt(r.most)) for r in rows.groupBy(F.size("v").alias("size")).agg(F.max(squares).alias("most")).collect()}
    queries = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    total = queries.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("v")), F.lit(0)).alias("numbers")).first()
    blocks = max(1, -(-2 * total.n // BLOCK_QUERIES), -(-2 * total.numbers // BLOCK_NUMBERS))
    found = None
    for number in range(blocks):
        some = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == number).collect()
        part = _block_search(rows, some, reach, k)
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
