"""The training-data operators against brute force, on odd and on empty tables and in the pipeline."""

import math
import random
import sys
from collections import Counter
from pathlib import Path

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute

import corpus_pipeline
from adsift.llm import bpe, byte_mixing, context_mixing, exact_dedup, links, mixing, pii, sharding, simhash, suffix_dedup, suffixes, topk, toxicity

RANKS = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def rows(df, *names):
    key = lambda r: tuple((x is None, str(x)) for x in r)
    return sorted((tuple(r) for r in df.select(*names).collect()), key=key)


def same(found, wanted):
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert found == sorted(wanted, key=key)


# 1 -- suffix arrays


def test_suffix_array():
    draw = random.Random(5)
    for _ in range(1500):
        s = [draw.randint(1, draw.randint(1, 4)) for _ in range(draw.randint(0, 22))]
        assert suffixes.suffix_array(s) == sorted(range(len(s)), key=lambda k: s[k:])


@pytest.mark.parametrize("most", [None, 2])
def test_suffix_dedup(spark, most):
    draw, data = random.Random(2), brute.odd_rows()
    data = [r for r in data if r[0] != 12]
    pool = [" ".join(draw.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(60)) for _ in range(4)]
    for i in range(30, 60):
        a, b = draw.choice(pool), draw.choice(pool)
        cut = draw.randint(0, 200)
        data.append((i, a[cut:] + draw.choice(["", " x ", "yy"]) + b[: draw.randint(60, 300)], *data[0][2:]))
    found = suffix_dedup.spans(brute.frame(spark, data), length=100, most=most)
    same(rows(found, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"), brute.removed(data, 100))


@pytest.mark.parametrize("most", [None, 2])
def test_suffix_dedup_of_long_texts(spark, most):
    """At the contract's 400 bytes, with texts longer than a segment and repeats that lie across its border."""
    draw = random.Random(12)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(draw.randint(2, 7)))
    filler = lambda n: " ".join(word() for _ in range(n // 5))[:n].ljust(n, "x")
    cut, shared = suffix_dedup.SEGMENT, [filler(n) for n in (399, 400, 401, 900, 5_000)]
    data = []
    for i in range(6):
        text = filler(cut - 700 + 130 * i)
        for part in shared[i % 5 :] + shared[: i % 2]:
            text += part + filler(draw.randint(0, 60))
        data.append((i, text + filler(3_000), *brute.odd_rows()[0][2:]))
    data += [(10, "ab" * 80_000, *brute.odd_rows()[0][2:]), (11, filler(399), *brute.odd_rows()[0][2:]), (12, "é" * 300, *brute.odd_rows()[0][2:])]
    data += [(20 + k, shared[2][k:] + filler(50) + shared[3][: 400 + k], *brute.odd_rows()[0][2:]) for k in range(12)]
    found = suffix_dedup.spans(brute.frame(spark, data), most=most)
    wanted = brute.removed(data, 400)
    assert max(r[1] for r in wanted) > cut and sum(r[2] > 0 for r in wanted) > 10
    same(rows(found, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"), wanted)


def test_suffix_dedup_splits_frequent_grams(spark, monkeypatch):
    """A gram with more surroundings than its share of all is sorted range by range of shifts, not window by window."""

    def digested(*_):
        raise AssertionError("windows were counted by digest")

    draw, phrase = random.Random(21), " the same forty bytes stand in all texts "
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(draw.randint(2, 7)))
    filler = lambda n: " ".join(word() for _ in range(n))
    ends = [filler(40) for _ in range(6)]
    data = [(i, filler(20) + draw.choice(ends) + phrase + draw.choice(ends) + filler(20), *brute.odd_rows()[0][2:]) for i in range(60)]
    wanted = brute.removed(data, 100)
    monkeypatch.setattr(suffix_dedup, "MOST_SHARE", 10**9)
    monkeypatch.setattr(suffix_dedup, "_compared_by_digest", digested)
    found = suffix_dedup.spans(brute.frame(spark, data), length=100)
    assert sum(r[2] > 0 for r in wanted) > 10
    same(rows(found, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"), wanted)


def test_suffix_dedup_text(spark):
    data = brute.odd_rows()[:10]
    found = {(r.doc_id, r.kept_sha256): bytes(r.kept) for r in suffix_dedup.removed(brute.frame(spark, data), length=100).collect()}
    assert all(brute.sha(kept) == digest for (_, digest), kept in found.items()) and len(found) > 3


# 2 -- toxicity


def labelled(spark, n=400):
    draw = random.Random(4)
    plain = [f"{draw.choice('bdfgk')}{draw.choice('aeiou')}{draw.choice('lmnr')}{k}word" for k in range(60)]
    data, labels = [], []
    for i in range(n):
        toxic = i % 5 == 0
        words = [draw.choice(plain) for _ in range(30)] + ["Nasty!", "vile,"] * toxic
        draw.shuffle(words)
        data.append((i, " ".join(words), *brute.odd_rows()[0][2:]))
        labels.append((i, int(toxic)))
    return data, spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity(spark):
    data, labels = labelled(spark)
    extra = [(1000, None), (1001, ""), (None, "nasty vile"), (1002, "nasty " * 50_000)]
    docs = brute.frame(spark, data + [(i, t, *data[0][2:]) for i, t in extra] + data[:1])
    found = toxicity.scores(docs, labels).collect()
    assert len(found) == len(data) + 5 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found)
    by = {r.doc_id: r for r in found}
    assert all(by[i].predicted == (i % 5 == 0) for i in range(400))
    assert all(by[i].held_out == (brute.fold(i) == 0) for i in by)
    assert by[1000].score == by[1001].score < 0.5 and by[None].predicted == by[1002].predicted == 1
    kept = toxicity.accepted(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i in by if not by[i].predicted}


def test_toxicity_neighbours_are_exact(spark):
    data, labels = labelled(spark)
    model, vectors = toxicity.fit(brute.frame(spark, data), labels)
    index = toxicity._Index(model)
    for r in vectors.collect()[:60]:
        query = dict(index._weights(r.terms))
        cosines = [sum(w * query.get(t, 0) for t, w in index._weights(e[2])) for e in index.examples]
        best = sorted((-round(c, 12), k) for k, c in enumerate(cosines) if c > 0)[: toxicity.NEIGHBOURS]
        assert [(round(c, 9), e) for c, e in index.nearest(r.terms)] == [(round(-c, 9), k) for c, k in best]


def test_toxicity_scores_are_the_votes_of_the_nearest(spark):
    """The score of every row from plain text: terms, weights, all cosines, votes, against a loop over all examples."""
    data, labels = labelled(spark)
    data = [(i, t + " rare" * (i % 3) + (" oddly" if i % 17 == 0 else ""), *rest) for i, t, *rest in data]
    docs = brute.frame(spark, data + [(900 + k, data[0][1], *data[0][2:]) for k in range(40)])
    model, _ = toxicity.fit(docs, labels)
    examples = toxicity._Index(model).examples
    # Rows with the same terms are one example, the one of the least identifier.
    assert len({(e[1], tuple(e[2])) for e in examples}) == len(examples)

    def numbers(text):
        times = Counter(t for w in toxicity.WORD.findall((text or "").lower()) for t in toxicity._terms(w))
        return sorted(model.terms[f"{t}#{n}"] for t in times for n in toxicity.LEVELS if times[t] >= n and f"{t}#{n}" in model.terms)

    def unit(terms):
        size = math.sqrt(sum(model.idf[t] ** 2 for t in terms)) or 1.0
        return {t: model.idf[t] / size for t in terms}

    total, df = len(data) + 40, Counter(t for r in docs.collect() for t in numbers(r.text))
    assert all(model.idf[t] == pytest.approx(math.log((1 + total) / (1 + df[t])) + 1) for t in range(len(model.terms)))
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in toxicity.scores(docs, labels).collect():
        query, votes = unit(numbers(texts[r.doc_id])), [toxicity.PRIOR_VOTES * (1 - model.prior), toxicity.PRIOR_VOTES * model.prior]
        near = sorted((-round(sum(w * query.get(t, 0) for t, w in unit(e[2]).items()), 12), k) for k, e in enumerate(examples))
        for cosine, k in [x for x in near if x[0] < 0][: toxicity.NEIGHBOURS]:
            votes[examples[k][1]] += cosine * cosine / model.rates[examples[k][1]]
        assert r.score == pytest.approx(votes[1] / sum(votes), abs=1e-9)


def test_toxicity_keeps_every_telling_term(spark):
    """No number of terms is cut off: texts whose only telling word is one of hundreds are all found."""
    draw = random.Random(2)
    words = ["".join(draw.choice("bcdfghjklmnpqrstvwxz") for _ in range(7)) for _ in range(200)]
    data, labels = [], []
    for i in range(12_000):
        toxic, word = int(i % 3 == 0), words[i // 3 % 100 + 100 * (i % 3 > 0)]
        data.append((i, f"plain words {word} here", *brute.odd_rows()[0][2:]))
        labels.append((i, toxic))
    model, _ = toxicity.fit(brute.frame(spark, data), spark.createDataFrame(labels, "doc_id long, toxic int"))
    found = toxicity.scores(brute.frame(spark, data), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert len(model.terms) > 512 and all(r.predicted == (r.doc_id % 3 == 0) for r in found)


def test_toxicity_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    found = toxicity.scores(brute.frame(spark), none).collect()
    assert {r.score for r in found} == {0.0} and toxicity.scores(brute.frame(spark, []), none).count() == 0


# 3 -- mixing


def test_mixing(spark):
    draw = random.Random(8)
    data = brute.odd_rows() + [(i, "word " * draw.randint(0, 40), None, draw.choice(["s0", "s1", "s2", "big", "big", None]), *brute.odd_rows()[0][4:]) for i in range(100, 700)]
    found = mixing.mix(brute.frame(spark, data)).collect()
    sizes: Counter = Counter()
    for _, text, _, source, *_ in data:
        sizes[source] += len(brute.WORD.findall(text or ""))
    wanted = brute.mix_targets(sizes)
    assert sorted((r.doc_id or -1, r.size) for r in found) == sorted((i or -1, len(brute.WORD.findall(t or ""))) for i, t, *_ in data)
    taken: dict = {}
    for r in found:
        taken.setdefault((r.source_size, round(r.target, 3)), []).append(r)
    assert set(taken) == {(sizes[s], round(wanted[s], 3)) for s in sizes}
    for (_, target), of in taken.items():
        assert abs(sum(r.taken for r in of) - target) <= max(r.size for r in of) / 2 + 1e-6
        assert all(r.taken <= 3 * r.size and r.positions == sorted(r.positions) for r in of)
    firsts = [r.positions[0] for r in found if r.positions]
    assert firsts == sorted(firsts) and all(0 <= x <= 1 for x in firsts)
    again = mixing.training_order(brute.frame(spark, data))
    assert again.columns == brute.frame(spark, data).columns
    assert Counter(r.doc_id for r in again.collect()) == Counter({k: sum(len(r.positions) for r in found if r.doc_id == k) for k in {r.doc_id for r in found if r.positions}})
    assert mixing.mix(brute.frame(spark, [])).count() == 0


def test_position_inverts_the_integral(spark):
    from pyspark.sql import functions as F

    for knots in mixing.SCHEDULES:
        shares = spark.range(101).select((F.col("id") / 100).alias("u")).select("u", mixing.position(F.col("u"), knots).alias("t")).collect()
        whole = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:], strict=False))
        for r in shares:
            area = 0.0
            for (t, m), (u, n) in zip(knots, knots[1:], strict=False):
                x = min(max(r.t - t, 0), u - t)
                area += m * x + (n - m) / (u - t) * x * x / 2
            assert math.isclose(area / whole, r.u, abs_tol=1e-9)


# 4 -- sharding


def test_sharding(spark):
    data = brute.odd_rows() + [(i, f"text {i}", *brute.odd_rows()[0][2:]) for i in range(100, 900)]
    docs = brute.frame(spark, data)
    found = sharding.assign(docs, 8).collect()
    assert len(found) == len(data) and all(r.grown_shard in (r.shard, 8) for r in found)
    by: dict = {}
    for r in found:
        by.setdefault(r.doc_id, set()).add((r.shard, r.grown_shard))
    assert all(len(x) == 1 for x in by.values())
    for shard in range(8):
        slots = sorted(r.slot for r in found if r.shard == shard)
        assert slots == list(range(len(slots)))
    grown = {r.doc_id: r.shard for r in sharding.assign(docs, 9).collect()}
    assert all(grown[r.doc_id] == r.grown_shard for r in found)
    import zlib

    assert sorted((r.doc_id or -1, r.size, r.text_crc32) for r in found) == sorted((i or -1, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, *_ in data)
    heavy = Counter(r.shard for r in sharding.assign(docs, weights=[1, 3, 0]).collect())
    assert heavy[2] == 0 and 2 < heavy[1] / heavy[0] < 4.5
    assert sharding.assign(brute.frame(spark, [])).count() == 0


# 5 -- language model


def test_language_model(spark):
    data = brute.odd_rows()
    found = context_mixing.scores(brute.frame(spark, data))
    got = rows(found, "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score")
    wanted = sorted(brute.base_scores(data), key=lambda r: tuple((x is None, str(x)) for x in r[:5]))
    for a, b in zip(sorted(got, key=lambda r: tuple((x is None, str(x)) for x in r[:5])), wanted, strict=True):
        assert a[:5] == b[:5] and math.isclose(a[5], b[5], rel_tol=1e-9)
    assert all(r.score < 0 for r in found.collect())
    assert context_mixing.scores(brute.frame(spark, [])).count() == 0


def trained(tokens, held=()):
    """(slice of tokens and held, its predictors) with counts of the tokens (a dict of bytes and times)."""
    import numpy as np

    names = [*tokens, *(t for t in held if t not in tokens)]
    slice_ = byte_mixing.Slice(names)
    times = np.array([tokens.get(t, 0) for t in names])
    return names, slice_, byte_mixing.predictors(slice_.keys, slice_.counts(times))


def context_counts(tokens):
    """Counts of the byte behind each context, by plain dictionaries."""
    counts: dict = {}
    for token, times in tokens.items():
        for held, byte in byte_places(token):
            for c in held:
                counts.setdefault(c, Counter())[byte] += times if c[0] == "begin" else 1
    return counts


def byte_places(token):
    raw = bytes([10]) * byte_mixing.PAD + (token + b" " if token else bytes([10]))
    for at in range(byte_mixing.PAD, len(raw)):
        yield [(k, raw[at - k : at]) for k in byte_mixing.RECENT] + [("begin", raw[byte_mixing.PAD : at])], raw[at]


def some_tokens(draw, n=300):
    words = ["".join(draw.choice("abcdeé日") for _ in range(draw.randint(1, 6))).encode() for _ in range(n)]
    return {**{w: draw.choice([1, 1, 1, 2, 3, 9, 40, 300]) for w in words}, b"": 50}


def test_language_model_counts_every_context():
    """Chances of tokens are those of exact counts and of mixing one decision after the other by gate."""
    import numpy as np

    draw = random.Random(12)
    tokens = some_tokens(draw)
    held = [b"abc", b"zzz", "é日é".encode(), b"a" * 40]
    names, slice_, found = trained(tokens, held)
    counts, weights = context_counts(tokens), np.random.default_rng(3).uniform(0.0, 0.5, (byte_mixing.GATES, byte_mixing.ORDERS, 8))
    scores, used = byte_mixing.Mixer(slice_, found).code(weights), set()
    for row in [*draw.sample(range(len(names)), 40), *range(len(tokens), len(names))]:
        total = 0.0
        for contexts, byte in byte_places(names[row]):
            for depth in range(8):
                st, seen = [], []
                for context in contexts:
                    same = lambda b, d: b >> 8 - d == byte >> 8 - d
                    after = counts.get(context, {})
                    here, way = (sum(c for b, c in after.items() if same(b, d)) for d in (depth, depth + 1))
                    odds = round(max(-127, min(127, 16 * math.log((way + 0.05) / (here - way + 0.05)))))
                    st.append(((odds or (1 if byte >> 7 - depth & 1 else -1)) if here else 0) / 16)
                    seen.append(here)
                gate = 2 * sum(int(math.log2(seen[-1] + 1)) >= o for o in byte_mixing.OFTEN) + (seen[-2] > 0)
                used.add(gate)
                x = max(-12, min(12, sum(w * s for w, s in zip(weights[gate, :, depth], st, strict=True))))
                total -= math.log10(1 + math.exp(-x))
        assert math.isclose(scores[row], total, rel_tol=1e-9)
    assert len(used) > 6


def test_language_model_is_a_distribution():
    """The chances of all 256 next bytes, of all next words, and of a word's two ways add up to one (words: at most)."""
    import numpy as np

    tokens = some_tokens(random.Random(5))
    for begin in (b"", b"a", "é".encode()[:1], b"zz"):
        names, slice_, found = trained(tokens, [begin + bytes([c]) for c in range(256)])
        weights, chance = byte_mixing.starting(), []
        for token, st, gate in byte_mixing.Mixer(slice_, found)._stretches():
            x = (weights[gate, :, np.arange(8)] * st.transpose(0, 2, 1)).sum(axis=2)
            for c in range(256):
                place = np.flatnonzero(token == names.index(begin + bytes([c])))[len(begin)]
                chance.append(float(np.prod(1 / (1 + np.exp(-np.clip(x[place], -12, 12))))))
        assert len(chance) == 256 and math.isclose(sum(chance), 1, rel_tol=1e-9)
    names, slice_, found = trained(tokens)
    chance = dict(zip(names, byte_mixing.Mixer(slice_, found).code(byte_mixing.starting()).tolist(), strict=True))
    assert 0.3 < sum(10**x for x in chance.values()) <= 1
    draw = random.Random(6)
    some = draw.sample(sorted(chance), 6)
    for n in (0, 1, 3, 20, 90):
        words = [draw.choice(some) for _ in range(n)]
        start = context_mixing.coded(words, chance)[0] if words else 0.0
        nexts = [10 ** (context_mixing.coded([*words, w], chance)[0] - start) for w in chance]
        assert 0.2 < sum(nexts) <= 1 + 1e-9


def test_language_model_adapts_within_a_text():
    """Texts are coded word after word, as a plain loop does: guesses, words so far, bit histories, weights by gate and block."""
    draw = random.Random(7)
    chance = {f"w{k}".encode(): -1.5 - k / 50 for k in range(40)} | {b"": -2.0}

    class Decisions:
        def __init__(self):
            self.weights = [[context_mixing.START] * 3 for _ in range(context_mixing.LONGEST)]
            self.counts, self.todo, self.total, self.n, self.size = {}, [], 0.0, 0, context_mixing.BLOCK

        def add(self, bit, last, word, at):
            contexts, gate = [(0, 0), (1, last), (2, word)], min(int(math.log2(at + 1)), context_mixing.LONGEST - 1)
            seen = [self.counts.setdefault(c, [0.4, 0.4]) for c in contexts]
            st = [math.log(one / none) for none, one in seen]
            x = max(-12, min(12, sum(w * s for w, s in zip(self.weights[gate], st, strict=True))))
            p = 1 / (1 + math.exp(-x))
            self.total += math.log(p if bit else 1 - p)
            self.todo.append((gate, [context_mixing.RATE * (bit - p) * s for s in st]))
            for c in seen:
                c[bit] += 1
            self.n += 1
            if self.n == self.size:
                self.n, self.size = 0, min(2 * self.size, context_mixing.LARGEST)
                for gate, step in self.todo:
                    self.weights[gate] = [w + s for w, s in zip(self.weights[gate], step, strict=True)]
                self.todo = []

    def plain(words):
        copies, repeats, seen, follows, mass = Decisions(), Decisions(), Counter(), {}, 0.0
        total, new, run, again = 0.0, [], 0, 0
        for i, w in enumerate(words):
            last = words[i - 1] if i else None
            guess = follows.get((words[i - 2], last)) if i > 1 else None
            hit = guess == w
            if guess is not None:
                copies.add(int(hit), min(run, 7), last, i)
            if not hit:
                if i:
                    repeats.add(int(w in seen), min(again, 3), last, i)
                if w in seen:
                    total += math.log(seen[w] / i)
                else:
                    total -= math.log(max(1 - mass, context_mixing.LEAST_LEFT))
                    if w in chance:
                        total += chance[w] * math.log(10)
                        mass += 10 ** chance[w]
                    else:
                        new.append(w)
            run, again = (run + 1 if hit else 0), (again + 1 if w in seen else 0)
            if i > 1:
                follows[words[i - 2], last] = w
            seen[w] += 1
        return (total + copies.total + repeats.total) / math.log(10), new

    for n in (0, 1, 2, 3, 10, 300, 1500):
        words = [f"w{draw.randint(0, 60)}".encode() for _ in range(n)]
        words = [*words, *words[: n // 2], b"odd", *words[: n // 3], b""]
        (score, names, times, own), want = context_mixing.coded(words, chance), plain(words)
        assert dict(zip(names, times, strict=True)) == Counter(words) and own == [chance.get(w) for w in names]
        assert [w for w in names if w not in chance] == want[1] and math.isclose(score, want[0], rel_tol=1e-9)


def test_texts_coded_together_take_no_notice_of_each_other():
    """Each text of a batch costs what it costs alone, to the last bit, and the batch's texts share the steps."""
    draw = random.Random(31)
    chance = {f"w{k}".encode(): -1.0 - k / 50 for k in range(40)} | {b"": -2.0}
    texts = [[*(f"w{draw.randint(0, 5 + 10 * (n % 7))}".encode() for _ in range(n)), b""] for n in [0, 0, 1, 2, 3, 33, 97, 500, 1700, *range(20, 60)]]
    draw.shuffle(texts)
    together = context_mixing.coded_together(texts, chance)
    assert together == [context_mixing.coded(words, chance) for words in texts]
    assert list(map(len, context_mixing._together(iter(texts)))) == [len(texts)]


def test_stored_rows_with_one_value_are_read_alone(spark, monkeypatch):
    """A step of the fitting reads the answers to its own slices, not those to all."""
    from adsift import session

    table = session.materialise(spark.range(100).selectExpr("id", "cast(id % 4 as int) as step"), "dealt", by="step")
    assert table.columns == ["id", "step"] and table.count() == 100
    assert sorted(r.id for r in table.where("step = 3").collect()) == list(range(3, 100, 4))
    read = table.where("step = 3").select(F.input_file_name().alias("f")).distinct().collect()
    assert read and all("step=3" in r.f for r in read)

    written, store = [], byte_mixing.materialise
    monkeypatch.setattr(byte_mixing, "SLICE", 400)
    monkeypatch.setattr(byte_mixing, "FIT_SLICES", 2)
    monkeypatch.setattr(byte_mixing, "materialise", lambda df, name, by=None: written.append((name, by)) or store(df, name, by))
    tokens = spark.createDataFrame([(f"word{k}".encode(), k % 5) for k in range(300)], "token binary, c long")
    assert byte_mixing.token_chances(tokens).count() == 300 and written == [("dealt_tokens", "step"), ("context_answers", "step")]


def test_language_model_learns(spark, monkeypatch):
    """Held-out texts cost clearly less than by counted tokens where lines repeat, and slices of any size answer each other."""
    monkeypatch.setattr(byte_mixing, "SLICE", 2_000)
    draw = random.Random(8)
    words = ["".join(draw.choice(["ba", "ko", "lim", "tar", "e", "un"]) for _ in range(draw.randint(1, 4))) for _ in range(900)]
    line = lambda: " ".join(words[min(899, int(draw.expovariate(0.01)))] for _ in range(8))
    data = []
    for i in range(300):
        lines = [line() for _ in range(12)]
        data.append((i, "\n".join(lines + [draw.choice(lines) for _ in range(6)]), *brute.odd_rows()[0][2:]))
    found = [r for r in context_mixing.scores(brute.frame(spark, data)).collect() if r.held_out]
    assert len(found) > 30 and sum(r.score > 0.9 * r.base_score for r in found) == len(found)


def test_language_model_is_fitted_on_all_training_words(spark, monkeypatch):
    """The weights follow every slice's training tokens, each without one of its own occurrences, as one process works them out."""
    import numpy as np
    from pyspark.sql import functions as F

    monkeypatch.setattr(byte_mixing, "SLICE", 400)
    monkeypatch.setattr(byte_mixing, "FIT_SLICES", 2)
    tokens = some_tokens(random.Random(21)) | {f"held{k}".encode(): 0 for k in range(20)}
    table = spark.createDataFrame([(bytearray(t), n) for t, n in tokens.items()], "token binary, c long")
    slices = byte_mixing._slices(sum(len(t) + 1 for t in tokens))
    steps = min(byte_mixing.ROUNDS, -(-slices // 2))
    assert steps > 1
    parts = {}
    for r in table.withColumn("s", F.pmod(F.xxhash64(F.lit(7), "token"), F.lit(slices))).collect():
        parts.setdefault(r.s, []).append(bytes(r.token))
    everything = byte_mixing.Slice(list(tokens))
    sums = everything.counts(np.array(list(tokens.values())))
    weights = byte_mixing.starting()
    for step in range(steps):
        over, under = np.zeros_like(weights), np.zeros_like(weights)
        for names in (parts[s] for s in sorted(parts) if s % steps == step):
            slice_, times = byte_mixing.Slice(names), np.array([tokens[t] for t in names])
            at, own = np.searchsorted(everything.keys, slice_.keys), slice_.without_one(times) > 0
            found = np.where(own[:, None], byte_mixing.predictors(everything.keys, sums, 1)[at], byte_mixing.predictors(everything.keys, sums)[at])
            near, bend = byte_mixing.Mixer(slice_, found).fitted(weights, times.astype(float), byte_mixing.ROUNDS // steps)
            over, under = over + near * bend * times.sum(), under + bend * times.sum()
        weights = np.where(under > 0, over / np.where(under > 0, under, 1), weights)
    names = list(tokens)
    want = dict(zip(names, byte_mixing.Mixer(everything, byte_mixing.predictors(everything.keys, sums)).code(weights).tolist(), strict=True))
    got = {bytes(r.token): r.lp for r in byte_mixing.token_chances(table).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[t], want[t], rel_tol=1e-9) for t in names)


def test_every_round_of_the_fitting_follows_all_training_words(spark, monkeypatch):
    """However many slices there are, the query's weights are those of all ROUNDS rounds over all slices together."""
    import numpy as np
    from pyspark.sql import functions as F

    draw = random.Random(24)
    tokens = some_tokens(draw) | {f"held{k}".encode(): 0 for k in range(20)} | {b"often": 3 * byte_mixing.FEW}
    names, times = list(tokens), np.array(list(tokens.values()))
    table = spark.createDataFrame([(bytearray(t), n) for t, n in tokens.items()], "token binary, c long")
    everything = byte_mixing.Slice(names)
    sums = everything.counts(times)
    less, full = (byte_mixing.predictors(everything.keys, sums, n) for n in (1, 0))
    for size in (250_000, 400):
        monkeypatch.setattr(byte_mixing, "SLICE", size)
        slices = byte_mixing._slices(sum(len(t) + 1 for t in tokens))
        parts = {}
        for r in table.withColumn("s", F.pmod(F.xxhash64(F.lit(7), "token"), F.lit(slices))).collect():
            parts.setdefault(r.s, []).append(bytes(r.token))
        assert len(parts) == slices and (slices > 3) == (size == 400)
        mixers = []
        for part in parts.values():
            slice_, n = byte_mixing.Slice(part), np.array([tokens[t] for t in part])
            at, own = np.searchsorted(everything.keys, slice_.keys), slice_.without_one(n) > 0
            mixers.append((byte_mixing.Mixer(slice_, np.where(own[:, None], less[at], full[at])), n / times.sum()))
        weights, depth = byte_mixing.starting(), np.arange(byte_mixing.DEPTH)
        for _ in range(byte_mixing.ROUNDS):
            slope, bend = np.zeros_like(weights), np.zeros_like(weights)
            for mixer, share in mixers:
                for token, st, gate in mixer._stretches():
                    x = sum(weights[gate, k, depth] * st[:, k] for k in range(byte_mixing.ORDERS))
                    p = 1 / (1 + np.exp(-np.clip(x, -12, 12)))
                    error = share[token][:, None] * (1 - p)
                    for k in range(byte_mixing.ORDERS):
                        np.add.at(slope[:, k], (gate, depth), error * st[:, k])
                        np.add.at(bend[:, k], (gate, depth), error * p * st[:, k] ** 2)
            weights = np.clip(weights + byte_mixing.DAMPING * slope / (bend + 1e-6), -1, 2)
        want = dict(zip(names, byte_mixing.Mixer(everything, full).code(weights).tolist(), strict=True))
        got = {bytes(r.token): r.lp for r in byte_mixing.token_chances(table, whole=True).collect()}
        assert got.keys() == want.keys() and all(math.isclose(got[t], want[t], rel_tol=1e-9) for t in names)
    assert byte_mixing.token_chances(table.limit(0), whole=True).count() == 0

    asked, chances = [], context_mixing.token_chances
    monkeypatch.setattr(context_mixing, "token_chances", lambda tokens, **options: asked.append(options) or chances(tokens, **options))
    context_mixing.scores(brute.frame(spark, brute.odd_rows()))
    assert asked == [{"whole": True}]


def test_a_token_predicts_itself_without_its_own_count():
    """One count less along a key's own path is what the predictors of the counts without that occurrence are."""
    import numpy as np

    tokens = some_tokens(random.Random(22))
    slice_ = byte_mixing.Slice(list(tokens))
    sums = slice_.counts(np.array(list(tokens.values())))
    less = byte_mixing.predictors(slice_.keys, sums, 1)
    for k in random.Random(23).sample(range(len(sums)), 40):
        if sums[k]:
            without = sums.copy()
            without[k] -= 1
            assert (less[k] == byte_mixing.predictors(slice_.keys, without)[k]).all()


def test_language_model_knows_every_script(spark):
    """Among texts of many ASCII letters, a Cyrillic text of known words is cheaper than the same letters mixed."""
    draw = random.Random(13)
    ascii_ = ["".join(chr(draw.choice(range(33, 127))) for _ in range(6)) for _ in range(80)]
    words = ["молоко", "дерево", "человек", "хорошо", "работа", "сегодня", "дорога", "вопрос"]
    texts = [" ".join(draw.choice(ascii_) for _ in range(120)) for _ in range(600)]
    texts += [" ".join(draw.choice(words) for _ in range(40)) for _ in range(60)]
    known = " ".join(draw.choice(words) for _ in range(40))
    mixed = " ".join("".join(draw.sample(w, len(w))) for w in known.split())
    ids = [i for i in range(10_000) if brute.fold(i) != 1][: len(texts)] + [i for i in range(10_000) if brute.fold(i) == 1][:2]
    docs = brute.frame(spark, [(i, t, *brute.odd_rows()[0][2:]) for i, t in zip(ids, [*texts, known, mixed], strict=True)])
    found = {r.doc_id: r.bits_per_byte for r in context_mixing.scores(docs).collect()}
    assert found[ids[-2]] * 2 < found[ids[-1]]


# 6 -- top k


def test_topk(spark):
    draw = random.Random(3)
    vectors = [(i, [draw.gauss(0, 1) for _ in range(6)]) for i in range(300)]
    vectors += [(i, [0.5] * 6) for i in range(300, 360)] + [(400, None), (450, [1.0, None] * 3), (451, [float("nan")] * 6), (500, [1e3] * 4), (None, [0.5] * 6), (100, vectors[100][1])]
    docs = spark.createDataFrame([(i, v, 1, "x", 0.5) for i, v in vectors], "vec_id long, embedding array<float>, label int, q string, v double")
    import numpy as np

    ok = []
    for i, v in vectors:
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            ok.append((i, [math.floor(256 * float(np.float32(x))) for x in v]))
    wanted = []
    for q in sorted({i for i, _ in ok if i is not None and i % 50 == 0}):
        mine = min(v for i, v in ok if i == q)
        scored = sorted(((-sum(a * b for a, b in zip(mine, v, strict=True)), i is None, i) for i, v in ok if i != q and len(v) == len(mine)), key=lambda x: (x[0], x[1], x[2] or 0))
        wanted += [(q, n, i, -s) for n, (s, _, i) in enumerate(scored[:5], 1)]
    same(rows(topk.search(docs), "query_id", "rank", "vec_id", "score"), wanted)
    assert topk.search(docs.limit(0)).count() == 0


def test_topk_does_not_wrap_around(spark):
    """Products near the end of 64 bits are exact; a score beyond is an error, not another number."""
    kind = "vec_id long, embedding array<double>"
    large = spark.createDataFrame([(50, [4e6, -4e6, 3.0]), (1, [4e6, 4e6, 2.0]), (2, [-4e6, 4e6, 1.0])], kind)
    a = 256 * 4_000_000
    want = {1: 768 * 512, 2: -2 * a * a + 768 * 256}
    assert {r.vec_id: r.score for r in topk.search(large).collect()} == want and abs(want[2]) > 2**53
    with pytest.raises(Exception, match="2\\*\\*61"):
        topk.search(spark.createDataFrame([(50, [1e16, 1.0]), (1, [1e16, 1.0])], kind)).collect()


# 7 -- personal data


def test_personal_data(spark):
    draw = random.Random(6)
    pieces = ["bob@a.b", "@", ".", "10.0.0.1", "300.1.1.1", "4111111111111111", "4111-1111 1111-1111", "+1 (988) 555-2485", "+", "-", " ", "é", "😀", "a%b", "_x@y-z.q.w", "1", "00255.1.2.3"]
    data = brute.odd_rows() + [(i, "".join(draw.choice(pieces) for _ in range(draw.randint(1, 12))), *brute.odd_rows()[0][2:]) for i in range(100, 500)]
    found = pii.report(brute.frame(spark, data))
    wanted = []
    for i, t, *_ in data:
        spans = brute.personal(t)
        wanted.append((i, *(sum(k == n for _, k, _ in spans) for n in range(4)), brute.sha(brute.listed(spans))))
    same(rows(found, "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256"), wanted)
    assert pii.report(brute.frame(spark, [])).count() == 0


def test_disclosing_terms(spark):
    """A word that stands only near one entity is added; common words and texts without entities are left alone."""
    draw = random.Random(7)
    filler = lambda: " ".join(draw.choice(["the", "of", "and", "note", "plan"]) for _ in range(8))
    texts = [f"{filler()} Zanzibarov {filler()[:12]} zan@corp.example {filler()}" for _ in range(6)]
    texts += [filler() for _ in range(60)]
    docs = brute.frame(spark, [(i, t, *brute.odd_rows()[0][2:]) for i, t in enumerate(texts)])
    found = {r.doc_id: r for r in pii.report(docs).collect()}
    for i, t in enumerate(texts):
        at = t.find("Zanzibarov")
        assert (f"term:{at}:{at + 10}" in found[i].spans) == (i < 6) and found[i].n_term == (i < 6)
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert "[EMAIL]" in clean[0] and "[NAME]" in clean[0] and "Zanz" not in clean[0] and clean[10] == texts[10]


def disclosed(spark, texts, word):
    """The places of a word in the texts, and those that the report lists as terms."""
    import re

    docs = brute.frame(spark, [(i, t, *brute.odd_rows()[0][2:]) for i, t in enumerate(texts)])
    found = {r.doc_id: {x for x in r.spans.split(",") if x.startswith("term")} for r in pii.report(docs).collect()}
    stand = {i: {f"term:{m.start()}:{m.end()}" for m in re.finditer(word, t)} for i, t in enumerate(texts)}
    return stand, found


def test_disclosing_terms_behind_numbers(spark):
    """Numbers between a word and an entity, or in front of an address of digits, hide nothing."""
    draw = random.Random(17)
    filler = lambda: " ".join(draw.choice(["the", "of", "and", "note", "plan"]) for _ in range(30))
    texts = [f"{filler()} Zanzibarov, room 12, zan@corp.example {filler()}" for _ in range(6)]
    texts += [f"{filler()} Quellhost port 22 10.0.0.1 {filler()}" for _ in range(6)]
    texts += [f"{filler()} room 12, port 22 {filler()}" for _ in range(80)]
    stand, found = disclosed(spark, texts, "Zanzibarov|Quellhost")
    assert all(found[i] == stand[i] for i in range(len(texts))) and stand[0] and stand[6]


def test_disclosing_terms_far_from_the_entity(spark):
    """A name far from the address is found over whole texts, and every place of it is marked; copies are one piece of evidence."""
    draw = random.Random(18)
    filler = lambda n: " ".join(draw.choice(["the", "of", "and", "note", "plan"]) for _ in range(n))
    texts = [f"Dear Zanzibarov, {filler(60)} write to zan@corp.example soon. {filler(60)} zanzibarov {filler(4)} Zanzibarov" for _ in range(6)]
    texts += [filler(80) for _ in range(60)]
    copy = f"{filler(50)} Kopperfield {filler(50)} kop@corp.example {filler(30)}"
    texts += [f"{copy} {filler(20)}" for _ in range(5)]
    stand, found = disclosed(spark, texts, "[Zz]anzibarov")
    assert all(stand[i] <= found[i] for i in range(6)) and len(stand[0]) == 3
    assert not any(found[i] for i in range(6, len(texts)))


def test_running_sums(spark):
    from pyspark.sql import functions as F

    data = [(n, [k % 7 for k in range(n)]) for n in (0, 1, 2, 3, 4, 5, 8, 9, 17, 100)]
    df = spark.createDataFrame(data, "n int, x array<int>")
    for r in df.select("n", "x", pii._running(F.col("x"), 3).alias("s")).collect():
        assert r.s == [sum(r.x[: k + 1]) for k in range(r.n)]


def test_texts_with_very_many_matches(spark):
    """Places in a text with tens of thousands of matches come out right, and in a time that does not grow with their square."""
    import time

    text = " ".join(f"x{k} 10.0.{k % 300}.7 a{k}@b.example" for k in range(8_000))
    start = time.time()
    found = pii.report(brute.frame(spark, [(1, text, *brute.odd_rows()[0][2:])])).first()
    assert found.base_sha256 == brute.sha(brute.listed(brute.personal(text))) and found.n_email == 8_000
    assert time.time() - start < 120


def test_hot_text_and_hot_entity(spark):
    """A text with thousands of copies, and an entity in all of them, count as one piece of evidence each time."""
    name = "Quillandra"
    data = [(i, f"note {i} for {name}: her mail q@p.example, thanks", *brute.odd_rows()[0][2:]) for i in range(5)]
    data += [(100 + i, "hot text with r@s.example and 10.0.0.1 inside", *brute.odd_rows()[0][2:]) for i in range(2_000)]
    data += [(5000 + i, f"plain words {i} in many texts", *brute.odd_rows()[0][2:]) for i in range(300)]
    found = {r.doc_id: r for r in pii.report(brute.frame(spark, data)).collect()}
    assert len(found) == len(data) and not any(found[100 + i].n_term for i in range(2_000))
    for i in range(5):
        at = data[i][1].index(name)
        assert f"term:{at}:{at + len(name)}" in found[i].spans.split(",")


# 8 -- byte-level BPE


def test_bpe(spark):
    draw = random.Random(9)
    bits = [" ", "  ", "\n", "\t", "\x1c", "a", "'s", "é", "日本", "😀", "12", "!?", "word", "The", "ß", "<unk>", "Ġ", "▁"]
    data = brute.odd_rows() + [(i, "".join(draw.choice(bits) for _ in range(draw.randint(0, 15))), *brute.odd_rows()[0][2:]) for i in range(100, 600)]
    theirs = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
    found = bpe.digests(brute.frame(spark, data), RANKS, public_tokenizers.PATTERN)
    wanted = []
    for i, t, *_ in data:
        ids = theirs.encode_ordinary(t or "")
        wanted.append((i, len(ids), brute.sha(",".join(map(str, ids))), brute.sha(t or "")))
    same(rows(found, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256"), wanted)
    assert bpe.digests(brute.frame(spark, []), RANKS, public_tokenizers.PATTERN).count() == 0
    whole = bpe.encoded(brute.frame(spark, data), RANKS, public_tokenizers.PATTERN)
    assert whole.where("not round_trip").count() == 0 and whole.count() == len(data)


# 9 -- exact dedup


def test_encoded_keeps_other_columns(spark):
    """Columns named like what it adds are replaced, all others stay, those of its own steps included."""
    from pyspark.sql import functions as F

    docs = brute.frame(spark, brute.odd_rows()[:6])
    docs = docs.withColumns({"decoded": F.lit("mine"), "n_tokens": F.lit("old"), "round_trip": F.lit(3), "decoded_sha256": F.lit(None).cast("int")})
    out = bpe.encoded(docs, RANKS, public_tokenizers.PATTERN)
    assert set(out.columns) == {*docs.columns, "ids"} and out.schema["n_tokens"].dataType.simpleString() == "bigint"
    assert {(r.decoded, r.decoded_sha256, r.round_trip) for r in out.collect()} == {("mine", None, True)}


def test_memory_of_pre_tokens_is_bounded():
    """A memory that always starts afresh gives the same ids."""
    order = sorted(RANKS.items(), key=lambda x: x[1])
    make = lambda: bpe._text_encoder(bpe.piece_model(RANKS), tuple(t for t, _ in order), tuple(r for _, r in order), public_tokenizers.PATTERN)
    texts = [" ".join(f"word{k} naïve" for k in range(n, n + 40)) for n in range(0, 400, 20)]
    want = make()(texts)
    least, bpe.REMEMBERED = bpe.REMEMBERED, 3_000
    try:
        small = make()
        assert [small([t])[0] for t in texts] == want
    finally:
        bpe.REMEMBERED = least


def test_exact_dedup(spark):
    data = brute.odd_rows() + [(i, "hot", *brute.odd_rows()[0][2:]) for i in range(200, 500)]
    docs = brute.frame(spark, data).repartition(5)
    same(rows(exact_dedup.groups(docs), "doc_id", "keep_id", "group_size", "kept", "text_sha256"), brute.equal_groups(data))
    kept = exact_dedup.dedup(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or -1) for r in kept.collect()) == sorted((g[0] or -1) for g in brute.equal_groups(data) if g[3])
    assert exact_dedup.groups(brute.frame(spark, [])).count() == 0 and exact_dedup.dedup(brute.frame(spark, [])).count() == 0


# 10 -- SimHash


def test_simhash(spark):
    data = [r for r in brute.odd_rows() if r[0] != 12]
    docs = brute.frame(spark, data)
    same(rows(simhash.near_duplicates(docs), "doc_id", "fingerprint", "component_id"), brute.near_groups(data))
    kept = simhash.representatives(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {c for _, _, c in brute.near_groups(data)}
    assert simhash.near_duplicates(brute.frame(spark, [])).count() == 0


@pytest.mark.parametrize("blocks", [b for _, b in simhash.SHARD_LEVELS])
def test_simhash_classes(spark, blocks):
    """Dense balls and chains of fingerprints, with units small enough to cut every shard."""
    draw = random.Random(11)
    prints = set()
    for _ in range(12):
        centre = draw.getrandbits(64)
        for _ in range(40):
            prints.add(centre ^ sum(1 << draw.randrange(64) for _ in range(draw.randint(0, 3))) & (1 << 64) - 1)
            centre ^= 1 << draw.randrange(64) if draw.random() < 0.3 else 0
    prints = sorted(prints)
    signed = lambda x: x - (1 << 64) if x >= 1 << 63 else x
    fps = spark.createDataFrame([(signed(x),) for x in prints], "fp long")
    found = {r.fp: r["class"] for r in simhash.classes(fps, unit_rows=20, blocks=blocks).collect()}
    up = {x: x for x in prints}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in prints:
        for b in prints:
            if (a ^ b).bit_count() <= 3:
                up[root(a)] = root(b)
    ours: dict = {}
    for x in prints:
        ours.setdefault(found.get(signed(x), signed(x)), set()).add(x)
    theirs: dict = {}
    for x in prints:
        theirs.setdefault(root(x), set()).add(x)
    assert sorted(map(sorted, ours.values())) == sorted(map(sorted, theirs.values()))


def test_components(spark):
    path = [(k, k + 1) for k in range(60)] + [(100, 101), (103, 101), (200, 200)]
    found = links.components(spark.createDataFrame(path, "a long, b long")).collect()
    by: dict = {}
    for r in found:
        by.setdefault(r.component, set()).add(r.node)
    assert sorted(map(sorted, by.values())) == [list(range(61)), [100, 101, 103]]


# the pipeline


def test_pipeline(spark, sf_dir):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "simhash near-dedup", "mixing", "byte-level bpe"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scored = {r.doc_id: r.predicted for r in toxicity.scores(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).collect()}
    left = [tuple(r) for r in docs.collect() if not scored[r.doc_id]]
    kept = {g[0] for g in brute.equal_groups(left) if g[3]}
    left = [r for r in left if r[0] in kept]
    least = {c for _, _, c in brute.near_groups(left)}
    out = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r.doc_id for r in out} <= least and len({r.doc_id for r in out}) > len(least) / 3
    assert all(r.round_trip and len(r.ids) == r.n_tokens for r in out)


def test_pipeline_on_odd_rows(spark, sf_dir, tmp_path):
    docs = brute.frame(spark)
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        empty = stage(spark, docs.limit(0), sf_dir)
        assert empty.count() == 0
        out = stage(spark, docs, sf_dir)
        assert n == 4 or out.columns == brute.frame(spark).columns
        out.write.parquet(str(tmp_path / str(n)))
        docs = spark.read.parquet(str(tmp_path / str(n)))
        assert docs.count() > 0
