"""Source divergence, Merkle manifest and chat formatting against brute force, on odd and on empty tables."""

import random
import re
import sys
import zlib
from collections import Counter, defaultdict
from itertools import groupby
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
import brute

from adsift.llm import chat, divergence, merkle


def rows(df, *names):
    key = lambda r: tuple((x is None, str(x)) for x in r)
    return sorted((tuple(r) for r in df.select(*names).collect()), key=key)


def same(found, wanted):
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert found == sorted(wanted, key=key)


# 11 -- divergence

AUDIT = ("lang", "source", "part", "item", "value", "rank")


def apart(data, least=3, top=200):
    docs = [((r[2] or ""), (r[3] or ""), re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", brute.lowered(r[1]))) for r in data]
    out = []
    for lang in {d[0] for d in docs}:
        here = [d for d in docs if d[0] == lang]
        df = Counter(t for d in here for t in set(d[2]))
        kept = sorted(t for t in df if df[t] >= least)
        sources = sorted({d[1] for d in here})
        counts = {s: Counter(t for d in here if d[1] == s for t in d[2]) for s in sources}
        counts[None] = Counter(t for d in here for t in d[2])
        share = {}
        for s, c in counts.items():
            n = sum(c[t] for t in kept)
            share[s] = [1 + 10**9 * (c[t] + 1) // (n + len(kept)) for t in kept]
        gap = lambda p, q: (p - q) * (p - q) // q
        for s in sources:
            pair = [(-sum(map(gap, share[s], share[o])), o.encode(), o) for o in sources if o != s]
            term = [(-gap(p, q), t.encode(), t) for t, p, q in zip(kept, share[s], share[None], strict=True) if counts[s][t] and p > q]
            for part, found, most in (("pair", pair, None), ("term", term, top)):
                out += [(lang, s, part, item, -v, k + 1) for k, (v, _, item) in enumerate(sorted(found)[:most])]
    return out


def skewed(n=300, seed=3):
    draw = random.Random(seed)
    words = [f"{draw.choice('bdfgk')}{draw.choice('aeiouéü')}{draw.choice('lmnr')}{draw.choice('aeio')}" for _ in range(80)]
    out = []
    for i in range(n):
        k = draw.choice([0, 0, 0, 1, 2, 3, 4, 5, 6])
        text = " ".join(words[min(79, int(draw.expovariate(0.08)) + 3 * k)].upper() + draw.choice(["", "7", "x!"]) for _ in range(draw.randint(0, 40)))
        out.append((i, text, draw.choice(["en", "de", None]), f"s{k}", 7, None, "r", "k", 1, "x", None, "y"))
    return out


def test_divergence(spark):
    for data, least, top in ((brute.odd_rows(), 3, 200), (skewed(), 3, 200), (skewed(seed=8), 1, 5)):
        same(rows(divergence.audit(brute.frame(spark, data), least=least, top=top), *AUDIT), apart(data, least, top))


def test_divergence_of_no_kept_terms(spark):
    data = [(1, "one", "en", "a"), (2, None, "en", "b"), (3, "", "en", None), (4, "x", "de", "a")]
    data = [(*d, 7, None, "r", "k", 1, "x", None, "y") for d in data]
    same(rows(divergence.audit(brute.frame(spark, data)), *AUDIT), apart(data))
    assert divergence.audit(brute.frame(spark, [])).count() == 0


def test_divergence_cuts_do_not_matter(spark, monkeypatch):
    """Stretches of a text, counts passed on early, and any number of trees and of pairs at once give the same."""
    text = "äb Cd" * 50 + "z" * 100
    for size in (1, 7, 64):
        monkeypatch.setattr(divergence, "STRETCH", size)
        parts = list(divergence._stretches(text.encode().lower()))
        assert b"".join(parts) == text.encode().lower()
        assert [t for p in parts for t in divergence.TERM.findall(p)] == divergence.TERM.findall(text.encode().lower())
    monkeypatch.setattr(divergence, "HELD", 5)
    monkeypatch.setattr(divergence, "PAIRS", 3)
    data = skewed(n=120, seed=1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        same(rows(divergence.audit(brute.frame(spark, data)), *AUDIT), apart(data))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


# 12 -- Merkle trees

MANIFEST = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def manifest(data):
    def leaf(i, text, lang, source, n):
        return brute.sha("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (i, source, lang, n, text)))

    def tree(nodes):
        """The root, and for each node the siblings left and right on its way."""
        ways, spots = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for k, at in enumerate(spots):
                low = at // 16 * 16
                ways[k].append(("".join(nodes[low:at]), "".join(nodes[at + 1 : low + 16])))
            nodes = [brute.sha("".join(nodes[k : k + 16])) for k in range(0, len(nodes), 16)]
            spots = [at // 16 for at in spots]
        return nodes[0], ways

    full = [(i, t, lang, src, n, leaf(i, t, lang, src, n)) for i, t, lang, src, n, *_ in data]
    groups = defaultdict(list)
    for r in full:
        groups[r[3]].append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for g in groups.values():
        g.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[5]))
    trees = {s: tree([r[5] for r in groups[s]]) for s in names}
    root, tops = tree([trees[s][0] for s in names])
    out = []
    for s, top in zip(names, tops, strict=True):
        for (i, t, lang, src, n, h), way in zip(groups[s], trees[s][1], strict=True):
            struck = i is not None and zlib.crc32(str(i).encode()) % 5 == 0
            at = leaf(i, brute.lowered(t) if struck and t is not None else t, lang, src, n)
            for left, right in way + top:
                at = brute.sha(left + at + right)
            out.append((i, h, trees[s][0], root, brute.sha("".join(a + b for a, b in way + top)), at, at == root))
    return out


def documents(sizes, draw):
    out = []
    for k, (source, n) in enumerate(sizes.items()):
        for i in range(n):
            out.append((1000 * k + draw.randint(0, 3 * n), f"Text {i}", "en", source, i, None, "r", "k", 1, "x", None, "y"))
    draw.shuffle(out)
    return out


@pytest.mark.parametrize("digits", [1, 3])
def test_merkle(spark, digits, monkeypatch):
    draw = random.Random(4)
    sizes = {"a": 1, "b": 16, "ä": 17, None: 33, "Z": 256, "": 300, "z": 2} | {f"t{k}": 1 for k in range(14)}
    monkeypatch.setattr(merkle.proofs, "__defaults__", (*merkle.proofs.__defaults__[:-1], digits))
    data = documents(sizes, draw)
    same(rows(merkle.audit(brute.frame(spark, data)), *MANIFEST), manifest(data))


def test_merkle_of_odd_rows(spark):
    data = brute.odd_rows()
    found = rows(merkle.audit(brute.frame(spark, data)), *MANIFEST)
    same(found, manifest(data))
    assert {r[-1] for r in found} == {True, False}
    assert merkle.audit(brute.frame(spark, [])).count() == 0
    one = [data[0]]
    same(rows(merkle.audit(brute.frame(spark, one)), *MANIFEST), manifest(one))


def test_merkle_notices_any_change(spark):
    """A proof of the given rows leads to another root if any field of its row changes."""
    from pyspark.sql import functions as F

    docs = brute.frame(spark, documents({"a": 40, "b": 3}, random.Random(2)))
    columns = ("doc_id", "source", "lang", "n_chars", "text")
    for name, other in (("doc_id", F.col("doc_id") + 1), ("source", F.lit(None).cast("string")), ("text", F.concat("text", F.lit(" ")))):
        claim = merkle.leaf(*[other if c == name else F.col(c) for c in columns])
        ways = merkle.proofs(docs, claim=claim)
        assert ways.where(merkle.folded(F.col("leaf"), F.col("path")) != F.col("root")).isEmpty()
        assert ways.where(merkle.folded(F.col("claim"), F.col("path")) == F.col("root")).isEmpty()


# 13 -- chat formatting

CHAT = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "valid", "bad_turn")
TURNS = "conv_id long, turn long, role string, text string, formatted string, segments int"
PIECES = ["\\", "<", "</turn>\n", "</turn>", "<\\/turn>\n", "### Assistant: ", "### User: ", "#", "### Role [", "]: ", "]", ": ", "\n", "é😀", " ", "\\\\", "ok", "$1"]


def talks(data):
    out, order = [], {"start": "su", "system": "u", "user": "a", "assistant": "u"}
    key = lambda r: (r[0] is not None, r[0] or 0)
    for _, group in groupby(sorted(data, key=key), key=key):
        turns = sorted(group, key=lambda r: (r[1] is not None, r[1] or 0, (r[2] or "").encode(), (r[3] or "").encode()))
        said = [(r[2] or "", r[3] or "") for r in turns]
        before, bad = "start", 0
        for k, (role, _) in enumerate(said):
            if not bad and (role not in ("system", "user", "assistant") or role[0] not in order.get(before, "")):
                bad = k + 1
            before = role
        bad = bad or (0 if before == "assistant" else len(said) + 1)
        loss = "".join(t for r, t in said if r == "assistant")
        out.append((turns[0][0], len(said), brute.sha("".join(f"{r}\n{t}\n" for r, t in said)), len(loss), brute.sha(loss), bad == 0, bad))
    return out


def turns_of(draw, n=120):
    data = []
    for c in range(n):
        roles = ["system"] * draw.randint(0, 1) + ["user", "assistant"] * draw.randint(0, 4)
        if draw.random() < 0.3:
            roles.insert(draw.randint(0, len(roles)), draw.choice(["tool", None, "", "a]: b", "### User: ", "assistant", "user", "\\"]))
        for k, role in enumerate(roles):
            text = None if draw.random() < 0.05 else "".join(draw.choice(PIECES) for _ in range(draw.randint(0, 8)))
            data.append((c, k if draw.random() < 0.9 else draw.choice([None, 0]), role, text, "f", 1))
    return data


def test_chat(spark):
    data = turns_of(random.Random(6))
    data += [(None, 0, "user", "hi", None, None), (None, 1, "assistant", "yes", None, None), (900, 0, "user", None, "", 2)]
    data += [(901, k, ("user", "assistant")[k % 2], "same </turn>\n", None, 1) for k in (0, 1, 1, 1)]
    data += [(902, 0, "user", "\\### Assistant: </turn>\n ok " * 20_000, None, 1), (902, 1, "assistant", "<" * 100_000 + "\\" * 50_000, None, 1)]
    found = chat.digests(spark.createDataFrame(data, TURNS))
    same(rows(found, *CHAT), talks(data))
    assert chat.digests(spark.createDataFrame([], TURNS)).count() == 0


def test_chat_text_and_mask(spark):
    data = [(1, 0, "system", "be kind", None, 1), (1, 1, "user", "what is </turn>\n?", None, 1), (1, 2, "assistant", "a \\ mark", None, 1)]
    out = chat.formatted(spark.createDataFrame(data, TURNS)).first()
    assert out.formatted == "### System: be kind</turn>\n### User: what is <\\/turn>\n?</turn>\n### Assistant: a \\\\ mark</turn>\n"
    assert [s.text for s in out.segments if s.loss] == ["a \\\\ mark"]
    assert (out.valid, out.bad_turn) == (True, 0)


def test_chat_templates(spark):
    own = chat.Template({"q": "<q>", "a": "<a>"}, ("<r ", "]-"), "<end>", frozenset("qa"), {"start": {"q": "q"}, "q": {"q": "q", "a": "done"}}, frozenset({"done"}))
    data = [(1, 0, "q", "<end><a>", None, 1), (1, 1, "q", "<q>\\", None, 1), (1, 2, "a", "", None, 1), (2, 0, "x]-y", "<r ", None, 1)]
    got = chat.formatted(spark.createDataFrame(data, TURNS), own).withColumn("back", chat.read_back(chat.F.col("formatted"), own))
    got = {r.conv_id: r for r in got.withColumn("loss", chat.trained_text(chat.F.col("segments"))).collect()}
    assert [tuple(t) for t in got[1].back] == [("q", "<end><a>"), ("q", "<q>\\"), ("a", "")]
    assert (got[1].loss, got[1].valid, got[2].bad_turn) == ("<end><a><q>\\", True, 1)
    assert [tuple(t) for t in got[2].back] == [("x]-y", "<r ")]
    for headers, end in (({"u": "<u>"}, "<u>"), ({"u": "<u></e>"}, "</e>"), ({"u": "u<"}, "</e>"), ({"u": "\\u"}, "</e>")):
        with pytest.raises(ValueError):
            chat.Template(headers, ("[[", "]]"), end, frozenset(), {"start": {}}, frozenset())
