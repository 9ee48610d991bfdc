"""The chance of a token by logistic mixing of bit predictors, from tables of byte contexts that grow with the vocabulary.

A token is its bytes and a space (the end of a text is one byte of its own), and a byte is eight binary decisions. Contexts are
the last bytes and the whole beginning of the token, each a 56-bit hash of its bytes; a key is that hash with the byte that
followed. What a context has seen depends on the token alone, so each distinct token is worked on once, however often it
stands in the corpus: the beginnings count every training occurrence, the other contexts every training token once.
Tokens are dealt into slices of bounded size. A slice sends its keys with their counts to buckets of the keys; a bucket adds
up the counts of all slices and answers every slice with the predictors of its keys. A gate (how sure the token's beginning
is, and whether the longest other context was seen) chooses the weights by which the stretched predictors are added up.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adsift.session import materialise, ship

ship(__name__)

END, SPACE, DEPTH = 10, 32, 8
RECENT = (1, 2, 3, 4)  # bytes in the contexts before the last, which is the token's beginning
ORDERS, PAD = len(RECENT) + 1, max(RECENT)
SCALE, SMOOTH = 16, 0.05  # stretched predictors are int8 in sixteenths; 0 is a node that was never seen
OFTEN = (1, 2, 3, 4, 6, 8)  # where the classes of a node's count start, as powers of two less one
GATES = 2 * (len(OFTEN) + 1)
# What the beginning's predictor weighs at first in each class; the other contexts share the rest.
LEAD = (0.0, 0.35, 0.5, 0.6, 0.75, 0.9, 1.0)
ROUNDS, DAMPING = 12, 0.3
SLICE = 250_000  # bytes of tokens in a slice, about
FIT_SLICES = 4  # slices that a step of the fitting takes, at least about
TOGETHER = 1 << 13  # bytes mixed at once
PIECE = DEPTH * TOGETHER  # cases in a row
FEW = (1 << 16) - 1  # occurrences of a token that are counted in two bytes
BASE, INVERSE = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
BYTE = np.uint64(255)
REQUESTS = "bucket long, slice long, keys binary, counts binary, own binary"
ANSWERS = "slice long, bucket long, predictors binary, without binary"


def _mixed(x: np.ndarray) -> np.ndarray:
    """A hash that no two numbers share (splitmix64)."""
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def _powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.full(n + 1, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _keys(raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> Iterator[np.ndarray]:
    """For each context: its hash in 56 bits with the byte that follows, at every place of tokens that each follow PAD ends."""
    n, byte = len(raw), raw.astype(np.uint64)
    for order, length in enumerate(RECENT):
        x = np.full(n, order + 1, dtype=np.uint64)  # the bytes side by side behind the order's number
        for back in range(length, 0, -1):
            x <<= np.uint64(8)
            x[back:] |= byte[: n - back]
        yield _mixed(x) & ~BYTE | byte
    sums = np.concatenate([[np.uint64(0)], np.cumsum((byte + np.uint64(1)) * _powers(n, BASE)[:n], dtype=np.uint64)])
    word = np.zeros(n, dtype=np.int64)
    word[starts] = starts
    word = np.maximum.accumulate(word)
    prefix = (sums[:n] - sums[word]) * _powers(n, INVERSE)[word]
    yield _mixed(prefix ^ np.uint64(ORDERS << 56)) & ~BYTE | byte


class Slice:
    """The tokens of a slice one behind the other, and the number of each place's key among the slice's sorted keys."""

    def __init__(self, tokens: list[bytes]):
        parts = [t + bytes([SPACE]) if t else bytes([END]) for t in tokens]
        self.sizes = np.array([len(p) for p in parts], dtype=np.int64)
        self.starts = np.cumsum(self.sizes + PAD) - self.sizes
        raw = np.frombuffer(b"".join(bytes([END]) * PAD + p for p in parts), dtype=np.uint8)
        token = np.repeat(np.arange(len(parts)), self.sizes)
        self.token = token  # of each place of a token
        self.at = np.arange(len(token)) + PAD * (token + 1)
        keys = [k[self.at] for k in _keys(raw, self.starts, self.sizes)]
        self.keys, number = np.unique(np.concatenate(keys) if keys else np.zeros(0, np.uint64), return_inverse=True)
        self.places = number.reshape(ORDERS, -1).astype(np.int32)

    def counts(self, times: np.ndarray) -> np.ndarray:
        """What each key counts, of tokens that stand this often in training: beginnings every time, other contexts once."""
        often, once = times[self.token], (times > 0)[self.token].astype(np.int64)
        out = np.zeros(len(self.keys), dtype=np.int64)
        for order, place in enumerate(self.places):
            np.add.at(out, place, often if order == ORDERS - 1 else once)
        return out

    def without_one(self, times: np.ndarray) -> np.ndarray:
        """What goes from the counts if each token stood there once less."""
        return self.counts(times) - self.counts(np.maximum(times - 1, 0))


def _buckets(keys: np.ndarray, buckets: int) -> np.ndarray:
    """The first key of each bucket among sorted keys; a context lies in one bucket."""
    return np.searchsorted((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32), np.arange(buckets + 1, dtype=np.uint64))


def _planes(x: np.ndarray) -> bytes:
    """Numbers with their equal bytes side by side, which packs better."""
    return x.view(np.uint8).reshape(len(x), -1).T.tobytes()


def _numbers(data: bytes, kind: type) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).reshape(-1).view(kind)


def predictors(keys: np.ndarray, counts: np.ndarray, less: int = 0) -> np.ndarray:
    """By sorted key and decision, the stretched chance of the key's byte going its way, from the counts of its context; behind
    these the size of the node's count, as a power of two less one. With `less` the key itself counts that much less."""
    out = np.zeros((len(keys), 2 * DEPTH), dtype=np.int8)

    def within(depth: int) -> np.ndarray:
        """Counts of the context's bytes that share the first `depth` decisions with the key's."""
        node = keys >> np.uint64(DEPTH - depth)
        first = np.concatenate([[True], node[1:] != node[:-1]])
        sums = np.add.reduceat(counts, np.flatnonzero(first))[np.cumsum(first) - 1]
        return np.maximum(sums - less, 0) if less else sums

    if len(keys):
        before = within(0)
        for depth in range(DEPTH):
            after = within(depth + 1)
            odds = np.clip(np.rint(SCALE * np.log((after + SMOOTH) / (before - after + SMOOTH))), -127, 127)
            sign = (keys >> np.uint64(DEPTH - 1 - depth) & np.uint64(1)).astype(np.int8) * 2 - 1
            # An even chance at a node that was seen leans to the one, on both ways alike.
            out[:, depth] = np.where(before == 0, 0, np.where(odds == 0, sign, odds))
            out[:, DEPTH + depth] = np.log2(before + 1)
            before = after
    return out


def _answered(bucket: int, slices: list[int], keys: list[np.ndarray], counts: list[np.ndarray], own: list[np.ndarray]) -> Iterator[tuple]:
    """(slice, bucket, predictors, those for fitting) for every slice; for fitting, a key that owes a count to the token that it
    predicts counts one less."""
    known, number = np.unique(np.concatenate(keys), return_inverse=True)
    sums = np.zeros(len(known), dtype=np.int64)
    parts = np.split(number, np.cumsum([len(k) for k in keys])[:-1])
    for part, count in zip(parts, counts, strict=True):
        sums[part] += count  # a slice's keys are distinct
    found, without = predictors(known, sums), predictors(known, sums, 1)
    for number, part, mine in zip(slices, parts, own, strict=True):
        full = found[part]
        yield number, bucket, full.tobytes(), np.where(mine[:, None] > 0, without[part], full).tobytes()


def gates(bits: np.ndarray) -> np.ndarray:
    """The gate of each decision (places, contexts, depths): how often the beginning was there, and whether the longest other was."""
    classes = np.searchsorted(np.array(OFTEN), np.arange(128), "right")
    return 2 * classes[bits[:, -1, DEPTH:]] + (bits[:, -2, :DEPTH] != 0)


def starting() -> np.ndarray:
    """Weights (gate, context, depth) before any fitting."""
    lead = np.repeat(np.array(LEAD), 2)[:, None]
    each = np.concatenate([np.repeat((1 - lead) / (ORDERS - 1), ORDERS - 1, axis=1), lead], axis=1)
    return np.repeat(each[:, :, None], DEPTH, axis=2)


class Mixer:
    """Codes all tokens of a slice with given weights (gate, context, depth)."""

    def __init__(self, tokens: Slice, found: np.ndarray):
        self.tokens, self.found = tokens, found

    def _stretches(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(tokens, predictors, gates) of some places at a time."""
        for at in range(0, len(self.tokens.token), TOGETHER):
            places = self.tokens.places[:, at : at + TOGETHER]
            bits = np.stack([self.found[p] for p in places], axis=1)
            yield self.tokens.token[at : at + TOGETHER], bits[:, :, :DEPTH].astype(np.float64) / SCALE, gates(bits)

    @staticmethod
    def _added(weights: np.ndarray, st: np.ndarray, where: np.ndarray) -> np.ndarray:
        """The predictors added up by the weights of their gates and depths."""
        x = weights[:, 0].ravel()[where] * st[:, 0]
        for k in range(1, ORDERS):
            x += weights[:, k].ravel()[where] * st[:, k]
        return x

    def code(self, weights: np.ndarray) -> np.ndarray:
        """log10 of each token's chance."""
        cost = np.zeros(len(self.tokens.sizes))
        depth = np.arange(DEPTH)
        for token, st, gate in self._stretches():
            x = self._added(weights, st, gate * DEPTH + depth)
            first = int(token[0])
            sums = np.bincount(token - first, -np.logaddexp(0, -np.clip(x, -12, 12)).sum(axis=1))
            cost[first : first + len(sums)] += sums
        return cost / np.log(10)

    def fitted(self, weights: np.ndarray, times: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
        """Weights after some damped steps along the gradient of the coding cost of tokens that stand this often, and
        how much each weight had to go by."""
        depth = np.arange(DEPTH)
        share = times / max(1, times.sum())
        for _ in range(rounds):
            slope, bend = np.zeros_like(weights), np.zeros_like(weights)
            for token, st, gate in self._stretches():
                cells = gate * DEPTH + depth
                p = 1 / (1 + np.exp(-np.clip(self._added(weights, st, cells), -12, 12)))
                error, where = share[token][:, None] * (1 - p), cells.ravel()
                for k in range(ORDERS):
                    add = lambda x: np.bincount(where, x.ravel(), GATES * DEPTH).reshape(GATES, DEPTH)  # noqa: B023, E731
                    slope[:, k] += add(error * st[:, k])
                    bend[:, k] += add(error * p * st[:, k] ** 2)
            weights = np.clip(weights + DAMPING * slope / (bend + 1e-6), -1, 2)
        return weights, bend

    def cases(self, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The different decisions of the tokens that stand somewhere, and how often each is met if a token stands this often: a
        decision is its gate and depth in the lowest byte and its predictors in those above."""
        codes, often = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        depth = np.arange(DEPTH)
        for at in range(0, len(self.tokens.token), 4 * TOGETHER):
            bits = np.stack([self.found[p] for p in self.tokens.places[:, at : at + 4 * TOGETHER]], axis=1)
            n = times[self.tokens.token[at : at + 4 * TOGETHER]]
            code = np.zeros((len(bits), DEPTH, 8), dtype=np.uint8)
            code[:, :, 2] = gates(bits) * DEPTH + depth
            code[:, :, 3:] = bits[:, :, :DEPTH].transpose(0, 2, 1).view(np.uint8)
            code = code.view("<u8")[:, :, 0]
            few, many = (n > 0) & (n <= FEW), n > FEW
            # How often is sorted along behind the decision, which is faster than an order of places.
            both = np.sort((code[few] | n[few, None].astype(np.uint64)).ravel())
            found = _summed(both >> np.uint64(16), (both & np.uint64(FEW)).astype(np.int64))
            codes += [found[0], code[many].ravel() >> np.uint64(16)]
            often += [found[1], np.repeat(n[many], DEPTH)]
        code = np.concatenate(codes)
        order = np.argsort(code)
        return _summed(code[order], np.concatenate(often)[order])


def _summed(codes: np.ndarray, often: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted codes once each, with their numbers added up."""
    if not len(codes):
        return codes, often
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    return codes[first], np.add.reduceat(often, first)


def slopes(weights: np.ndarray, codes: np.ndarray, often: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slope of the coding cost of these cases by each weight (gate, context, depth), and how it bends."""
    slope, bend = np.zeros((GATES, ORDERS, DEPTH)), np.zeros((GATES, ORDERS, DEPTH))
    for at in range(0, len(codes), PIECE):
        raw = codes[at : at + PIECE].astype("<u8").view(np.uint8).reshape(-1, 8)
        cell = raw[:, 0].astype(np.int64)
        st = [raw[:, k + 1].copy().view(np.int8) / SCALE for k in range(ORDERS)]
        x = sum(weights[:, k].ravel()[cell] * st[k] for k in range(ORDERS))
        p = 1 / (1 + np.exp(-np.clip(x, -12, 12)))
        error = often[at : at + PIECE] * (1 - p)
        for k in range(ORDERS):
            add = lambda x: np.bincount(cell, x, GATES * DEPTH).reshape(GATES, DEPTH)  # noqa: B023, E731
            pull = error * st[k]
            slope[:, k] += add(pull)
            bend[:, k] += add(pull * p * st[k])
    return slope, bend


def _slices(size: int) -> int:
    return max(1, -(-size // SLICE))


def token_chances(tokens: DataFrame, whole: bool = False) -> DataFrame:
    """(token, c, lp) of a stored table (token, c): log10 of each token's chance by the model. c is the number of training
    occurrences; tokens with c = 0 were seen elsewhere only. A token longer than SLICE makes its task as large as itself.

    Weights are fitted on all training tokens, each without one of its own occurrences. With `whole`, every one of the ROUNDS steps
    follows the slope over all slices. Otherwise at most ROUNDS steps share the slices among them: every slice takes part in one
    step, and with fewer steps it goes on by itself for as many rounds as whole steps go into ROUNDS.
    """
    slices = _slices(tokens.agg(F.coalesce(F.sum(F.octet_length("token") + 1), F.lit(0)).alias("n")).first().n)
    dealt = tokens.withColumn("slice", F.pmod(F.xxhash64(F.lit(7), "token"), F.lit(slices)))

    def asked(table: pa.Table) -> pa.Table:
        number, times = table.column("slice")[0].as_py(), table.column("c").to_numpy().astype(np.int64)
        found = Slice(table.column("token").to_pylist())
        count, own = found.counts(times), (found.without_one(times) > 0).astype(np.uint8)
        bounds = _buckets(found.keys, slices)
        rows = [
            (bucket, number, _planes(found.keys[a:b]), _planes(count[a:b]), own[a:b].tobytes())
            for bucket, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)) if b > a
        ]
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["bucket", "slice", "keys", "counts", "own"])

    def answered(table: pa.Table) -> pa.Table:
        bucket, numbers = (table.column(c).to_pylist() for c in ("bucket", "slice"))
        keys, counts, own = ([_numbers(x, kind) for x in table.column(c).to_pylist()] for c, kind in (("keys", np.uint64), ("counts", np.int64), ("own", np.uint8)))
        rows = list(_answered(bucket[0], numbers, keys, counts, own))
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary()]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["slice", "bucket", "predictors", "without"])

    def asking(dealt: DataFrame) -> DataFrame:
        requests = dealt.groupBy("slice").applyInArrow(asked, REQUESTS)
        return requests.groupBy("bucket").applyInArrow(answered, ANSWERS)

    if whole:
        answers = materialise(asking(dealt), "context_answers")
        weights = _fitted_whole(dealt, answers.select("slice", "bucket", F.col("without").alias("predictors")))
    else:
        steps = min(ROUNDS, -(-slices // FIT_SLICES))
        of = (F.col("slice") % steps).cast("int")
        by_step = materialise(dealt.withColumn("step", of), "dealt_tokens", by="step")
        dealt = by_step.drop("step")
        answers = materialise(asking(dealt).withColumn("step", of), "context_answers", by="step")
        weights = _fitted_in_turn(by_step, answers.select("slice", "bucket", F.col("without").alias("predictors"), "step"), steps)

    def coded(tokens: pa.Table, found: pa.Table) -> pa.Table:
        return pa.table([tokens.column("token"), tokens.column("c"), pa.array(mixer_of(tokens, found).code(weights))], names=["token", "c", "lp"])

    return _by_slice(dealt, answers.select("slice", "bucket", "predictors"), coded, "token binary, c long, lp double")


def _fitted_whole(dealt: DataFrame, lone: DataFrame) -> np.ndarray:
    """Weights after ROUNDS damped steps, each along the gradient of the coding cost of all training tokens (token, c, slice). Alike
    decisions of a slice are put together once; a step reads only these."""

    def met(tokens: pa.Table, found: pa.Table) -> pa.Table:
        both = mixer_of(tokens, found).cases(tokens.column("c").to_numpy().astype(np.int64))
        pieces = [[_planes(x[at : at + PIECE]) for at in range(0, len(x), PIECE)] for x in both]
        return pa.table([pa.array(x, pa.binary()) for x in pieces], names=["codes", "often"])

    cases = materialise(_by_slice(dealt, lone, met, "codes binary, often binary"), "cases")
    total = max(1, dealt.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n")).first().n)
    weights = starting()

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = np.zeros((2, *weights.shape))
        for batch in batches:
            for codes, often in zip(batch.column("codes"), batch.column("often"), strict=True):
                both += slopes(weights, _numbers(codes.as_py(), np.uint64), _numbers(often.as_py(), np.int64))
        yield pa.RecordBatch.from_arrays([pa.array([x.ravel().tolist()], pa.list_(pa.float64())) for x in both], names=["slope", "bend"])

    for _ in range(ROUNDS):
        parts = cases.mapInArrow(sums, "slope array<double>, bend array<double>").collect()  # one row a task, two numbers a weight
        slope, bend = (np.sum([np.zeros(weights.size), *(r[k] for r in parts)], axis=0).reshape(weights.shape) / total for k in (0, 1))
        weights = np.clip(weights + DAMPING * slope / (bend + 1e-6), -1, 2)
    return weights


def _fitted_in_turn(by_step: DataFrame, lone: DataFrame, steps: int) -> np.ndarray:
    """Weights after steps that share the slices among them."""
    weights = starting()

    def step(number: int) -> np.ndarray:
        def fitted(tokens: pa.Table, found: pa.Table) -> pa.Table:
            times = tokens.column("c").to_numpy().astype(np.float64)
            near, bend = mixer_of(tokens, found).fitted(weights, times, ROUNDS // steps)
            bend = bend * times.sum()
            return pa.table([pa.array([x.ravel().tolist()], pa.list_(pa.float64())) for x in (near * bend, bend)], names=["w", "n"])

        here = F.col("step") == number
        each = _by_slice(by_step.where(here).drop("step"), lone.where(here).drop("step"), fitted, "w array<double>, n array<double>")
        pairs = each.select(F.posexplode(F.arrays_zip("w", "n")).alias("k", "x"))
        flat = weights.ravel().copy()
        for row in pairs.groupBy("k").agg(F.try_divide(F.sum("x.w"), F.sum("x.n")).alias("w")).where("w is not null").collect():  # one row a weight
            flat[row.k] = row.w
        return flat.reshape(GATES, ORDERS, DEPTH)

    for number in range(steps):
        weights = step(number)
    return weights


def mixer_of(tokens: pa.Table, found: pa.Table) -> Mixer:
    """The mixer of a slice, from its tokens and the predictors of its keys."""
    rows = sorted(zip(found.column("bucket").to_pylist(), found.column("predictors").to_pylist(), strict=True))
    return Mixer(Slice(tokens.column("token").to_pylist()), np.frombuffer(b"".join(p for _, p in rows), np.int8).reshape(-1, 2 * DEPTH))


def _by_slice(tokens: DataFrame, answers: DataFrame, run: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    return tokens.groupBy("slice").cogroup(answers.groupBy("slice")).applyInArrow(run, schema)
