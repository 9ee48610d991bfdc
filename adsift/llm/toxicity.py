"""Toxicity by the nearest labelled examples.

Texts become TF-IDF vectors over those words and parts of words that go with the label in the labelled texts; frequency
counts in levels, each a term of its own (once, twice, four times or more). Labelled examples lie in an inverted index whose
postings are cut into blocks; the largest weight of each block bounds what its examples can score, so blocks that cannot
reach the k-th best similarity are not opened and the neighbours are still the exact ones. Neighbours vote with the square
of their cosine, each class weighed by the share of its texts that the examples hold.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adsift.session import materialise, ship

ship(__name__)

WORD = re.compile(r"[^\W\d_]+")
GRAM = 4  # letters in a part of a word; a word's beginning counts as one
# The model's bounds: labelled texts of each class that terms are chosen by, labelled examples of each class, and neighbours
# that vote.
CHOOSING, EXAMPLES, NEIGHBOURS = 20_000, 2_048, 25
LEVELS = (1, 2, 4)
LEAST_DOCS = 3  # labelled texts that must hold a term
FLUSH = 300_000  # terms counted in a task before they are sent on
BLOCK, TOGETHER = 64, 16  # examples in a block, blocks opened at once
WIDE, ROUNDING = 2_048, 1e-5  # lists kept densely, and what sums of them may be off by
PRIOR_VOTES = 0.5
REMEMBERED, ANSWERS = 100_000, 10_000  # words, and answers for equal texts, that a task remembers
FOLDS, HELD_OUT = 5, 0


@dataclass
class Model:
    """Terms and their idf, the examples, the share of each label's different vectors that they are, and that of label 1 in all."""

    terms: dict[str, int] = field(default_factory=dict)
    idf: np.ndarray = field(default_factory=lambda: np.zeros(0))
    examples: list[tuple] = field(default_factory=list)  # (identifier, label, term numbers)
    rates: tuple[float, float] = (1.0, 1.0)
    prior: float = 0.0  # broadcast as the plain dict of these, as executors need not have the class


def held_out(id_col: Column) -> Column:
    """Whether a row is kept from learning: crc32 of the identifier as text, modulo 5, is 0. Null counts as empty."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_OUT


def _learnable(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """(id, label) of labelled rows outside the held-out fold; of contradicting labels the larger counts."""
    rows = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).where(~held_out(F.col(id_col)))
    return rows.groupBy(F.col(id_col).alias("id")).agg(F.max(F.when(F.col(label_col) > 0, 1).otherwise(0)).alias("label"))


def _word_counts(docs: DataFrame) -> DataFrame:
    """(label, words, counts) of (id, text, label)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                counted = [Counter(WORD.findall((t or "").lower())) for t in part.column("text").to_pylist()]
                words, counts = [list(c) for c in counted], [list(c.values()) for c in counted]
                lists = [pa.array(words, pa.list_(pa.string())), pa.array(counts, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays([part.column("label"), *lists], names=["label", "words", "counts"])

    return docs.mapInArrow(run, "label int, words array<string>, counts array<int>")


def _terms(word: str) -> list[str]:
    """A word's terms: itself, and its parts with their marked beginning (a part of the same letters is another term)."""
    marked = "^" + word
    return [word, *("-" + marked[at : at + GRAM] for at in range(len(marked) - GRAM + 1))]


def _first(labels: DataFrame, most: int) -> DataFrame:
    """At most `most` rows of each label, those that come first by a hash of the identifier."""
    order = F.xxhash64(F.col("id").cast("string"))
    some = [labels.where(F.col("label") == label).orderBy(order, "id").limit(most) for label in (0, 1)]
    return some[0].unionByName(some[1])


def _telling_terms(docs: DataFrame, labels: DataFrame) -> list[str]:
    """All terms that go clearly with label 1, by chi-square within classes of size over CHOOSING labelled texts a class,
    which bounds their number.

    A term must pass the level that one of as many terms would reach by chance. The labelled texts are few enough for a
    broadcast of their identifiers, so no text moves.
    """
    chosen = materialise(_first(labels, CHOOSING), "label_choice")
    labelled = _word_counts(docs.join(F.broadcast(chosen), "id")).select("label", "words", "counts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, ones = Counter(), Counter()

        def counted() -> pa.RecordBatch:
            keys = list(both)
            out = [pa.array([t for t, _ in keys], pa.string()), pa.array([s for _, s in keys], pa.int32())]
            out += [pa.array([of[k] for k in keys], pa.int64()) for of in (both, ones)]
            both.clear(), ones.clear()
            return pa.RecordBatch.from_arrays(out, names=["term", "size", "n", "a"])

        for batch in batches:
            for label, words, counts in zip(*(batch.column(c).to_pylist() for c in ("label", "words", "counts")), strict=True):
                times: Counter = Counter()
                for word, count in zip(words, counts, strict=True):
                    for term in _terms(word):
                        times[term] += count
                size = sum(counts).bit_length()
                held = [(f"{term}#{level}", size) for term, n in times.items() for level in LEVELS if n >= level]
                held.append(("", size))  # the text itself
                both.update(held)
                if label:
                    ones.update(held)
                if len(both) > FLUSH:
                    yield counted()
        yield counted()

    counts = labelled.mapInArrow(run, "term string, size int, n long, a long").groupBy("term", "size").agg(F.sum("n").alias("n"), F.sum("a").alias("a"))
    counts = materialise(counts, "label_terms")
    texts = counts.where("term = ''").select("size", F.col("n").cast("double").alias("all"), F.col("a").cast("double").alias("ones"))
    # A row a size; a term is held against texts of the same size, as longer ones hold more of everything.
    each = counts.where("term <> ''").join(F.broadcast(texts), "size")
    hit, has, n, a = F.col("a").cast("double"), F.col("n").cast("double"), F.col("all"), F.col("ones")
    spread = F.when(n > 1, has * (n - has) * a * (n - a) / (n * n * (n - 1))).otherwise(0.0)
    terms = each.groupBy("term").agg(F.sum("n").alias("held"), F.sum(hit - has * a / n).alias("over"), F.sum(spread).alias("spread"))
    terms = materialise(terms.where(F.col("held") >= LEAST_DOCS), "label_scores")
    least = 2 * math.log(max(2, terms.count())) + 3
    # More often in texts of label 1 than in all: a text without any such term has nothing toxic to show.
    square = F.col("over") * F.col("over") / F.col("spread")
    found = terms.where("over > 0 and spread > 0").withColumn("x", square).where(F.col("x") >= least)
    return [r.term for r in found.orderBy(F.desc("x"), "term").collect()]


class _Reader:
    """Numbers of the model's terms in a text; what a word holds of them is looked up once."""

    def __init__(self, terms: dict[str, int]):
        parts = [(*term.rpartition("#")[::2], number) for term, number in terms.items()]
        self.base = {base: n for n, base in enumerate(dict.fromkeys(base for base, _, _ in parts))}
        # By level the term's number for each base, or -1.
        self.levels = {level: np.full(len(self.base) + 1, -1) for level in LEVELS}
        for base, level, number in parts:
            self.levels[int(level)][self.base[base]] = number
        self.memory: dict[str, np.ndarray] = {}

    def _held(self, word: str) -> np.ndarray:
        held = self.memory.get(word)
        if held is None:
            if len(self.memory) >= REMEMBERED:
                self.memory.clear()
            held = self.memory[word] = np.array([self.base[t] for t in _terms(word) if t in self.base], dtype=np.int64)
        return held

    def __call__(self, text: str | None) -> np.ndarray:
        words = WORD.findall((text or "").lower())
        if not words:
            return np.zeros(0, dtype=np.int32)
        memory = self.memory
        times = np.bincount(np.concatenate([memory[w] if w in memory else self._held(w) for w in words]))
        found = []
        for level, number in self.levels.items():
            of = number[np.flatnonzero(times >= level)]
            found.append(of[of >= 0])
        return np.sort(np.concatenate(found)).astype(np.int32)


def _vectors(docs: DataFrame, terms: list[str]) -> DataFrame:
    """The columns of docs, without text, with the numbers of the model's terms in it."""
    number = {t: n for n, t in enumerate(terms)}
    names = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = _Reader(number)
        for batch in batches:
            found = pa.array([read(t.as_py()) for t in batch.column("text")], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), found], names=[*names, "terms"])

    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in names)
    return docs.mapInArrow(run, f"{kinds}, terms array<int>")


def _held_by(vectors: DataFrame, size: int) -> DataFrame:
    """(term, n): the number of vectors that hold each of so many terms, added up in the tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(size, dtype=np.int64)
        for batch in batches:
            n += np.bincount(np.asarray(batch.column("terms").flatten()), minlength=size)
        held = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(n[held])], names=["term", "n"])

    return vectors.select("terms").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[Model, DataFrame]:
    """The model, and the stored vectors (id, terms) of all rows of docs.

    Terms come from CHOOSING labelled rows of each class outside the held-out fold, class shares from all of them, term
    weights from all of docs. The examples are those EXAMPLES different vectors of each class that come first by
    a hash of their least identifier.
    """
    known = _learnable(labels, id_col, label_col)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    terms = _telling_terms(texts, known)
    vectors = materialise(_vectors(texts, terms), "label_vectors")
    if not terms:
        return Model(), vectors
    total = vectors.count()
    df = dict(_held_by(vectors, len(terms)).collect())  # one row a term
    idf = np.array([math.log((1 + total) / (1 + df.get(n, 0))) + 1 for n in range(len(terms))])
    learned = materialise(vectors.where(~held_out(F.col("id"))).join(known, "id"), "labelled")
    telling = learned.where(F.size("terms") > 0)
    # Copies, and other rows with the same terms, are one example and vote once.
    telling = materialise(telling.groupBy("label", "terms").agg(F.min("id").alias("id")), "examples")
    sums = dict(learned.groupBy("label").agg(F.count("*")).collect())
    different = dict(telling.groupBy("label").agg(F.count("*")).collect())
    examples: list[tuple] = []
    rates = []
    for label in (0, 1):
        first = telling.where(F.col("label") == label).orderBy(F.xxhash64(F.col("id").cast("string")), "id", "terms").limit(EXAMPLES)
        held = [(r.id, label, r.terms) for r in first.collect()]
        examples += held
        rates.append(len(held) / max(1, different.get(label, 0)) or 1.0)
    prior = sums.get(1, 0) / max(1, sum(sums.values()))
    return Model({t: n for n, t in enumerate(terms)}, idf, examples, (rates[0], rates[1]), prior), vectors


class _Index:
    """The inverted index of a model's examples, in blocks."""

    def __init__(self, model: Model):
        self.model = model
        # Examples with the same leading word stand together, so that blocks differ in what they can score.
        self.examples = sorted(model.examples, key=lambda e: (e[1], max(e[2], key=lambda t: model.idf[t]), str(e[0])))
        self.blocks = -(-len(self.examples) // BLOCK)
        rows = [(t, at, w) for at, (_, _, terms) in enumerate(self.examples) for t, w in self._weights(terms)]
        terms, at, weights = (np.array(x, dtype=k) for x, k in zip(zip(*rows, strict=True) if rows else ((), (), ()), (np.int64, np.int64, np.float64), strict=True))
        order = np.lexsort((at, terms))
        terms, self.at, self.weights = terms[order], at[order], weights[order]
        # Postings lie by term and block; first tells where those of a term and block begin, largest their largest weight.
        place = terms * self.blocks + self.at // max(1, BLOCK)
        every = len(model.terms) * self.blocks
        self.first = np.searchsorted(place, np.arange(every + 1))
        self.largest = np.zeros(every)
        np.maximum.at(self.largest, place, self.weights)
        self.largest = self.largest.reshape(len(model.terms), self.blocks)
        # The longest lists lie densely, a row of BLOCK weights by block and term, rounded to 32 bits: at most WIDE of them.
        length = self.first[self.blocks :: self.blocks] - self.first[: -1 : self.blocks] if every else np.zeros(0, dtype=np.int64)
        wide = np.argsort(-length, kind="stable")[:WIDE]
        self.row = np.full(len(model.terms), -1)
        self.row[wide] = np.arange(len(wide))
        self.dense = np.zeros((self.blocks, len(wide), BLOCK), dtype=np.float32)
        held = self.row[terms] >= 0
        self.dense[self.at[held] // BLOCK, self.row[terms[held]], self.at[held] % BLOCK] = self.weights[held]
        self.vectors = [tuple(np.array(x) for x in zip(*self._weights(terms), strict=True)) for _, _, terms in self.examples]
        self.labels = np.array([e[1] for e in self.examples])
        self.memory: dict[bytes, tuple[float, list]] = {}

    def _weights(self, terms: list[int]) -> list[tuple[int, float]]:
        raw = [(t, self.model.idf[t]) for t in terms]
        length = math.sqrt(sum(w * w for _, w in raw)) or 1.0
        return [(t, w / length) for t, w in raw]

    def nearest(self, terms: list[int]) -> list[tuple[float, int]]:
        """(cosine, example) of the NEIGHBOURS nearest; of equal ones those that stand first."""
        if not self.blocks or not len(terms):
            return []
        asked = np.array(terms, dtype=np.int64)
        idf = self.model.idf[asked]
        query = idf / math.sqrt(float((idf * idf).sum()))
        bounds = query @ self.largest[asked]
        order = np.argsort(-bounds, kind="stable")
        rows = self.row[asked]
        wide, narrow = rows >= 0, rows < 0
        rows, heavy, asked_, light = rows[wide], query[wide].astype(np.float32), asked[narrow], query[narrow]
        scores = np.zeros((self.blocks, BLOCK))
        least = 0.0
        for at in range(0, len(order), TOGETHER):
            if bounds[order[at]] <= 0 or bounds[order[at]] < least - ROUNDING:
                break
            opened = np.sort(order[at : at + TOGETHER])
            scores[opened] = heavy @ self.dense[opened[:, None], rows[None, :]]
            place = (asked_[:, None] * self.blocks + opened[None, :]).ravel()
            begin, size = self.first[place], self.first[place + 1] - self.first[place]
            upto = np.cumsum(size)
            if len(upto) and upto[-1]:
                held = np.repeat(begin - upto + size, size) + np.arange(upto[-1])
                more = self.weights[held] * np.repeat(np.repeat(light, len(opened)), size)
                scores += np.bincount(self.at[held], more, scores.size).reshape(scores.shape)
            least = np.partition(scores, -NEIGHBOURS, axis=None)[-NEIGHBOURS] if scores.size > NEIGHBOURS else 0.0
        # What rounding cannot keep from the nearest is worked out exactly.
        own = np.zeros(len(self.model.terms))
        own[asked] = query
        close = np.flatnonzero((scores.ravel() > 0) & (scores.ravel() >= least - ROUNDING))
        exact = [(-round(float(own[self.vectors[e][0]] @ self.vectors[e][1]), 12), int(e)) for e in close]
        return [(-s, e) for s, e in sorted(exact)[:NEIGHBOURS]]

    def score(self, terms: list[int]) -> tuple[float, list]:
        """The share of toxic votes, and the identifiers of the three nearest examples."""
        key = np.array(terms, dtype=np.int32).tobytes()
        if key not in self.memory:
            if len(self.memory) >= ANSWERS:
                self.memory.clear()
            near = self.nearest(terms)
            votes = [PRIOR_VOTES * (1 - self.model.prior), PRIOR_VOTES * self.model.prior]
            for cosine, example in near:
                label = int(self.labels[example])
                votes[label] += cosine * cosine / self.model.rates[label]
            self.memory[key] = (votes[1] / sum(votes), [self.examples[e][0] for _, e in near[:3]])
        return self.memory[key]


def _scored(vectors: DataFrame, model: Model) -> DataFrame:
    """vectors with score and evidence."""
    sent = vectors.sparkSession.sparkContext.broadcast(vars(model))
    kept = [c for c in vectors.columns if c != "terms"]
    kind = vectors.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _Index(Model(**sent.value))
        for batch in batches:
            found = [index.score(t) for t in batch.column("terms").to_pylist()]
            scores = pa.array([f[0] for f in found], pa.float64())
            evidence = pa.array([f[1] for f in found], pa.list_(batch.column("id").type))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), scores, evidence], names=[*kept, "score", "evidence"])

    kinds = ", ".join(f"{c} {vectors.schema[c].dataType.simpleString()}" for c in kept)
    return vectors.mapInArrow(run, f"{kinds}, score double, evidence array<{kind}>")


def scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """One row per row of docs: doc_id, held_out, score (0 to 1), predicted (score >= 0.5), evidence (nearest examples).

    Only the text decides. Texts without a telling term (null and empty ones too) get the share of toxic texts among the
    labelled ones; so does every text where nothing could be learned (0 without labels). Repeated rows get equal scores.
    """
    model, vectors = fit(docs, labels, id_col, text_col, label_col)
    out = _scored(vectors, model)
    predicted = (F.col("score") >= 0.5).cast("int").alias("predicted")
    return out.select(F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "score", predicted, "evidence")


def accepted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """The rows of docs that are not predicted to be toxic, with all their columns."""
    model, _ = fit(docs, labels, id_col, text_col, label_col)
    sent = docs.sparkSession.sparkContext.broadcast(vars(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(**sent.value)
        index, read = _Index(model), _Reader(model.terms)
        for batch in batches:
            clean = [index.score(read(t.as_py()))[0] < 0.5 for t in batch.column(text_col)]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
