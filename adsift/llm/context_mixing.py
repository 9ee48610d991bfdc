"""Language-model scores by logistic context mixing, beside a smoothed count of tokens.

A text is its words (A-Z lowered) and an end. A word is coded by binary decisions: whether it is the one that followed the
last two words before (if they stood there), and else whether it has stood in the text at all. Then it is either chosen among the
words so far, by how often they stood there, or new, with its chance by the byte model of `byte_mixing`, scaled to what the words so far
leave. Decisions are predicted by bit histories in hashed contexts of the text (none, the last decisions, the last word), which
adapt with every word; a gate (how long the text is so far) chooses the weights that add up their stretched chances, and
the weights follow the online gradient of the coding cost block by block.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import count, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adsift.llm.byte_mixing import token_chances
from adsift.session import materialise, ship

ship(__name__)

FOLDS, HELD_OUT = 5, 1
FREQUENT, FREQUENT_BYTES = 50_000, 64  # tokens looked up in the task
FLUSH = 200_000  # tokens counted in a task before they are sent on
HISTORIES, RATE, START = 3, 0.02, 0.4
BLOCK, LARGEST = 32, 512  # decisions before the first step of the weights; each block is twice as long, up to the largest
LONGEST = 16  # gates: powers of two of the words so far
WORDS_TOGETHER = 1 << 15  # of whole texts coded together, at least
LEAST_LEFT = 1e-3  # what the words so far leave to new ones, at least


def held_out(id_col: Column) -> Column:
    """Whether a row is kept from learning: crc32 of the identifier as text, modulo 5, is 1. Null counts as empty."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_OUT


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").lower().split()  # bytes.lower changes A-Z only, split cuts at ASCII space


def _token_counts(texts: DataFrame) -> DataFrame:
    """(token, c) of (text, train): every token, and how often it stands in training texts. The end is the empty token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        other: set[bytes] = set()

        def sent() -> pa.RecordBatch:
            extra = other.difference(list(found))
            out = [pa.array([*found, *extra], pa.binary()), pa.array([*found.values(), *([0] * len(extra))], pa.int64())]
            found.clear(), other.clear()
            return pa.RecordBatch.from_arrays(out, names=["token", "c"])

        for batch in batches:
            for text, train in zip(batch.column("text"), batch.column("train").to_pylist(), strict=True):
                words = words_of(text.as_py())
                words.append(b"")
                (found if train else other).update(words)
                if len(found) + len(other) > FLUSH:
                    yield sent()
        yield sent()

    return materialise(texts.mapInArrow(run, "token binary, c long").groupBy("token").agg(F.sum("c").alias("c")), "tokens")


def _order(numbers: np.ndarray) -> np.ndarray:
    """A stable order of numbers from 0 on; small ones are dealt out instead of compared."""
    small = len(numbers) and int(numbers.max()) < 1 << 16
    return np.argsort(numbers.astype(np.uint16) if small else numbers, kind="stable")


def _before(groups: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place the number of earlier places of its group, and the sum of their values. Groups are numbers from 0 on."""
    order = _order(groups)
    sorted_, at = groups[order], np.arange(len(groups))
    first = np.maximum.accumulate(np.where(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]), at, 0))
    sums = np.concatenate([[0], np.cumsum(values[order])])
    number, total = np.empty(len(groups), np.int64), np.empty(len(groups), np.int64)
    number[order], total[order] = at - first, sums[at] - sums[first]
    return number, total


def _blocks(at: np.ndarray) -> np.ndarray:
    """The block in which the decisions at these places of their texts lie."""
    ends = [BLOCK]
    while BLOCK << len(ends) < LARGEST:
        ends.append(ends[-1] + (BLOCK << len(ends)))
    return np.where(at < ends[-1], np.searchsorted(ends, at, "right"), len(ends) + (at - ends[-1]) // LARGEST)


def decisions(bits: np.ndarray, last: np.ndarray, word: np.ndarray, at: np.ndarray, text: np.ndarray) -> np.ndarray:
    """ln of the chance of each decision of some texts, one text behind the other: last are numbers below 8 that sum up the decisions
    before, word the number of the last word (no two texts share one), at the number of words so far. Texts take no notice
    of each other; what they do alike is done together."""
    n = len(bits)
    bit, out = bits.astype(np.int64), np.empty(n)
    st = np.empty((n, HISTORIES))
    for k, context in enumerate((text, text * 8 + last, word)):
        seen, ones = _before(context, bit)
        st[:, k] = np.log((ones + 0.4) / (seen - ones + 0.4))
    gate, sign = np.minimum(np.log2(at + 1).astype(np.int64), LONGEST - 1), 2 * bit - 1
    weights = np.full((int(text[-1]) + 1 if n else 0, LONGEST, HISTORIES), START)
    block = _blocks(_before(text, bit)[0])
    order = _order(block)
    for part in np.split(order, np.cumsum(np.bincount(block))[:-1]):
        if not len(part):
            continue
        of, some = text[part], st[part]
        x = np.clip((weights[of, gate[part]] * some).sum(axis=1), -12, 12)
        out[part] = -np.logaddexp(0, -sign[part] * x)
        error = RATE * (bit[part] - 1 / (1 + np.exp(-x)))
        first, upto = int(of[0]), int(of[-1]) + 1
        here = (of - first) * LONGEST + gate[part]
        for k in range(HISTORIES):
            weights[first:upto, :, k] += np.bincount(here, error * some[:, k], (upto - first) * LONGEST).reshape(-1, LONGEST)
    return out


def _followed(word: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each place the word that stood behind the last earlier place of the two words before it; -1 if none. No two texts
    share a word's number; at is the number of words before in its text."""
    out = np.full(len(word), -1, dtype=np.int64)
    third = np.flatnonzero(at > 1)
    if len(third):
        pair = word[third - 2] * (int(word.max()) + 1) + word[third - 1]
        order = np.argsort(pair, kind="stable")
        same = pair[order[1:]] == pair[order[:-1]]
        out[third[order[1:][same]]] = word[third[order[:-1][same]]]
    return out


def _run(hits: np.ndarray, starts: np.ndarray, most: int) -> np.ndarray:
    """For each place how many hits of its text stand in a row right before it, at most `most`."""
    at = np.arange(len(hits) + 1)
    missed = np.concatenate([[0], np.where(hits, 0, at[1:])])
    missed[starts] = starts
    return np.minimum(at - np.maximum.accumulate(missed), most)[:-1]


def _numbered(texts: list[list[bytes]]) -> tuple[np.ndarray, list[int], list[bytes], list[int]]:
    """(word, sizes, names, ends): a number for each word, which no two texts share, and each text's words; the different words of
    all texts by these numbers, and where those of each text end, behind a zero."""
    numbers: list[int] = []
    names: list[bytes] = []
    ends = [0]
    for words in texts:
        number: defaultdict[bytes, int] = defaultdict(count(ends[-1]).__next__)
        numbers.extend(map(number.__getitem__, words))
        names.extend(number)
        ends.append(len(names))
    return np.array(numbers, dtype=np.int64), list(map(len, texts)), names, ends


def _coded(word: np.ndarray, sizes: list[int], ends: list[int], logs: np.ndarray) -> list[float]:
    """log10 of each text's chance, from its words' numbers and log10 of the different words' own chances; what is minus infinity
    there is left out."""
    texts = len(sizes)
    text, starts = np.repeat(np.arange(texts), sizes), np.cumsum(sizes) - sizes
    at = np.arange(len(word)) - starts[text]
    before = np.concatenate([[-1], word[:-1]])
    before[starts] = ends[-1] + np.arange(texts)
    # Numbers of new words rise from text to text.
    again = np.concatenate([[False], word[1:] <= np.maximum.accumulate(word)[:-1]])
    guess = _followed(word, at)
    hit = guess == word
    asked = np.flatnonzero(guess >= 0)
    # The first word of a text has nothing to repeat.
    rest = np.flatnonzero(~hit & (at > 0))
    so_far, _ = _before(word, np.zeros(len(word), np.int64))
    place = rest[again[rest]]
    # What new words may take is what the frequent words so far leave.
    shares = 10.0**logs
    taken = np.concatenate([np.cumsum(shares[a:b]) - shares[a:b] for a, b in zip(ends, ends[1:])])
    costs = [
        (text[asked], decisions(hit[asked], _run(hit, starts, 7)[asked], before[asked], at[asked], text[asked])),
        (text[rest], decisions(again[rest], _run(again, starts, 3)[rest], before[rest], at[rest], text[rest])),
        (text[place], np.log(so_far[place] / at[place])),
        (np.repeat(np.arange(texts), np.diff(ends)), -np.log(np.maximum(1 - taken, LEAST_LEFT))),
    ]
    known = np.flatnonzero(np.isfinite(logs))
    total = np.zeros(texts)
    for of, cost in costs:
        total += _sums(cost, np.searchsorted(of, np.arange(texts + 1)))
    return (total / float(np.log(10)) + _sums(logs[known], np.searchsorted(known, ends))).tolist()


def _sums(values: np.ndarray, bounds: np.ndarray) -> list[float]:
    edges = bounds.tolist()
    return [values[a:b].sum() for a, b in zip(edges, edges[1:])]


def coded_together(texts: list[list[bytes]], chance: dict[bytes, float]) -> list[tuple[float, list[bytes], list[int], list[float | None]]]:
    """Of each text (its words and the end) log10 of its chance without the own chances of those of its words that are not in
    chance; its different words, how often each stands there, and their chances."""
    word, sizes, names, ends = _numbered(texts)
    own, times = list(map(chance.get, names)), np.bincount(word, minlength=len(names)).tolist()
    scores = _coded(word, sizes, ends, np.array([-np.inf if x is None else x for x in own]))
    return [(x, names[a:b], times[a:b], own[a:b]) for x, a, b in zip(scores, ends, ends[1:])]


def coded(words: list[bytes], chance: dict[bytes, float]) -> tuple[float, list[bytes], list[int], list[float | None]]:
    """What coded_together gives for one text."""
    return coded_together([words], chance)[0]


def _together(texts: Iterator[list[bytes]]) -> Iterator[list[list[bytes]]]:
    """Whole texts, some words at a time."""
    held, n = [], 0
    for words in texts:
        held.append(words)
        n += len(words)
        if n >= WORDS_TOGETHER:
            yield held
            held, n = [], 0
    if held:
        yield held


def scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    Scores are log10 of the text's probability: base_score by smoothed token counts, score by the mixing model, whose bits
    per byte (words, a space between two, an end) follow. Null and empty texts are one end. Training rows are scored with counts that
    hold themselves, as the base score's do. Without training rows all counts are 0 and the byte model is the even one.
    Repeated rows get equal scores. Empty tables give empty results; other columns are not read.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), (~held_out(F.col(id_col))).alias("train"))
    counts = _token_counts(texts.select("text", "train"))
    vocabulary = materialise(token_chances(counts, whole=True), "token_chances")
    totals = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count_if(F.col("c") > 0).alias("v")).first()
    top = vocabulary.where(F.octet_length("token") <= FREQUENT_BYTES).orderBy(F.desc("c"), "token").limit(FREQUENT)
    frequent = {bytes(r.token): (r.c, r.lp) for r in top.collect()}
    below = totals.n + 0.5 * (totals.v + 1)
    sent = docs.sparkSession.sparkContext.broadcast(frequent)
    kind = texts.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {t: k for k, t in enumerate(sent.value)}
        often = np.array([c for c, _ in sent.value.values()], dtype=np.int64)
        cost = np.array([np.log10((c + 0.5) / below) for c, _ in sent.value.values()])
        chance = np.array([*(lp for _, lp in sent.value.values()), -np.inf])  # the last for all others
        for batch in batches:
            columns: list[list] = [[] for _ in SCORED]
            for some in _together([*words_of(text.as_py()), b""] for text in batch.column("text")):
                word, sizes, names, ends = _numbered(some)
                at = np.fromiter(map(place.get, names, repeat(-1)), np.int64, len(names))
                times, lengths = np.bincount(word, minlength=len(names)), np.fromiter(map(len, names), np.int64, len(names))
                known, new = np.flatnonzero(at >= 0), np.flatnonzero(at < 0)
                edges, new_edges = np.searchsorted(known, ends), np.searchsorted(new, ends).tolist()
                prices = times[known] * cost[at[known]]
                total = lambda x, upto: np.diff(np.concatenate([[0], np.cumsum(x)])[upto])
                columns[0] += sizes
                columns[1] += total(times[known] * (often[at[known]] > 0), edges).tolist()
                columns[2] += [float(np.cumsum(prices[a:b])[-1]) if b > a else 0.0 for a, b in zip(edges, edges[1:])]
                columns[3] += _coded(word, sizes, ends, chance[at])
                columns[4] += (total(times * lengths, ends) + np.maximum(1, np.array(sizes) - 1)).tolist()
                seldom, counts = [names[k] for k in new.tolist()], times[new].tolist()
                columns[5] += [seldom[a:b] for a, b in zip(new_edges, new_edges[1:])]
                columns[6] += [counts[a:b] for a, b in zip(new_edges, new_edges[1:])]
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int64())]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *arrays], names=["id", *SCORED])

    scored = texts.select("id", "text").mapInArrow(run, f"id {kind}, n_tokens long, hits long, base double, score double, size long, seldom array<binary>, times array<long>")
    scored = materialise(scored.withColumn("uid", F.monotonically_increasing_id()), "language_model")
    # Frequent tokens were looked up in the task, so no token is left that many rows share.
    rest = scored.select("uid", F.explode(F.arrays_zip("seldom", "times")).alias("x")).select("uid", F.col("x.seldom").alias("token"), F.col("x.times").alias("times"))
    rest = rest.join(vocabulary, "token")
    found = rest.groupBy("uid").agg(
        F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("more_hits"),
        F.sum(F.col("times") * F.log10((F.col("c") + 0.5) / F.lit(below))).alias("more_base"),
        F.sum("lp").alias("more_score"),
    )
    joined = scored.drop("seldom", "times").join(found, "uid", "left")
    score = F.col("score") + F.coalesce("more_score", F.lit(0.0))
    return joined.select(
        F.col("id").alias("doc_id"),
        held_out(F.col("id")).alias("held_out"),
        "n_tokens",
        (F.col("hits") + F.coalesce("more_hits", F.lit(0))).alias("n_known"),
        F.lit(totals.n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"),
        score.alias("score"),
        (-score * float(np.log2(10)) / F.col("size")).alias("bits_per_byte"),
    )


SCORED = ["n_tokens", "hits", "base", "score", "size", "seldom", "times"]
