"""Plain versions of the operators, one row after the other, and tables that are odd in every way."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

UP, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LOWER = str.maketrans(UP, LOW)
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, row string, key string, part int, ids string, score string, shard string"

PASSAGE = " ".join(f"passage{k} word" for k in range(60))


def odd_rows() -> list[tuple]:
    """Nulls in every column, empty and very long texts, copies, near copies, repeated rows and ties."""
    base = " ".join(f"w{k % 97} Word{k}" for k in range(120))
    texts = [
        (1, "Hello there\tWorld"), (2, "hello there\tworld"), (3, None), (4, ""), (5, " \n "), (None, "hello there\tworld"), (None, None),
        (6, base), (7, base + " tail"), (8, base.upper()), (9, PASSAGE + " nine" * 3), (10, "ten ten " + PASSAGE), (11, "a" * 3000),
        (12, "long words " * 30_000), (13, "naïve café 日本語 😀 straße"), (14, "two words"), (15, "x"), (16, "mail Bob at bob@a.example.org, 10.0.0.255"),
        (17, base), (17, base), (18, "über\x1cÜBER zİ ﬁ"), (19, "call +1 (988) 555-2485 or 4111 1111 1111 1111; 999.1.1.1"),
    ]
    rows = [(i, t, "en" if (i or 0) % 2 else None, None if (i or 0) % 5 == 0 else f"s{(i or 0) % 3}", None, 7, "r", None, 1, "x", None, "y") for i, t in texts]
    return rows + [rows[0]]


def frame(spark, rows: list[tuple] | None = None):
    return spark.createDataFrame(odd_rows() if rows is None else rows, DOCS)


def sha(data: str | bytes) -> str:
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def lowered(text: str | None) -> str:
    return (text or "").translate(LOWER)


def fold(doc_id) -> int:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 5


def equal_groups(rows: list[tuple]) -> list[tuple]:
    groups: dict[str, list] = {}
    for i, t, *_ in rows:
        groups.setdefault(lowered(t), []).append(i)
    out = []
    for text, ids in groups.items():
        keep = max((x for x in ids if x is not None), default=None)
        first = True
        for i in ids:
            kept = i == keep and first
            first = first and not kept
            out.append((i, keep, len(ids), kept, sha(text)))
    return out


def removed(rows: list[tuple], length: int) -> list[tuple]:
    texts = [(t or "").encode() for _, t, *_ in rows]
    seen = Counter(t[k : k + length] for t in texts for k in range(len(t) - length + 1))
    out = []
    for (i, *_), t in zip(rows, texts, strict=True):
        gone = bytearray(len(t))
        for k in range(len(t) - length + 1):
            if seen[t[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        spans = sum(1 for k in range(len(t)) if gone[k] and (not k or not gone[k - 1]))
        out.append((i, len(t), sum(gone), spans, sha(bytes(c for c, g in zip(t, gone, strict=True) if not g))))
    return out


def simhash(text: str | None, size: int = 3) -> int:
    import xxhash

    words = WORD.findall(lowered(text))
    shingles = [" ".join(words[k : k + size]) for k in range(len(words) - size + 1)] if len(words) >= size else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_groups(rows: list[tuple], most: int = 3) -> list[tuple]:
    prints = [simhash(t) for _, t, *_ in rows]
    up = list(range(len(rows)))

    def root(k: int) -> int:
        while up[k] != k:
            k = up[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= most and root(a) != root(b):
                up[root(a)] = root(b)
    least: dict[int, int] = {}
    for k, (i, *_) in enumerate(rows):
        if i is not None:
            least[root(k)] = min(i, least.get(root(k), i))
    return [(i, f"{prints[k]:016x}", least.get(root(k))) for k, (i, *_) in enumerate(rows)]


KINDS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def personal(text: str | None) -> list[tuple]:
    def valid(kind: str, value: str) -> bool:
        digits = re.sub("[^0-9]", "", value)
        if kind == "ip":
            return all(int(p) <= 255 for p in value.split("."))
        if kind == "card":
            doubled = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(digits))]
            return 14 <= len(digits) <= 19 and sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0
        return kind == "email" or 10 <= len(digits) <= 15

    found = [(m.start(), n, m.end()) for n, (k, p) in enumerate(KINDS) for m in re.finditer(p, text or "") if valid(k, m.group())]
    return sorted(found)


def listed(spans: list[tuple]) -> str:
    return ",".join(f"{KINDS[k][0]}:{a}:{b}" for a, k, b in spans)


def mix_targets(sizes: dict, weights=(5, 2, 1), most: int = 3) -> dict:
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: weights[k % 3] for k, s in enumerate(names)}
    out, left, free = {}, float(sum(sizes.values())), set(names)
    while free:
        share = {s: weight[s] * left / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > most * sizes[s]]
        if not over:
            return out | share
        for s in over:
            out[s] = float(most * sizes[s])
            left -= out[s]
            free.discard(s)
    return out


def base_scores(rows: list[tuple]) -> list[tuple]:
    tokens = [[w.encode() for w in WORD.findall(lowered(t))] + [b""] for _, t, *_ in rows]
    counts = Counter(w for (i, *_), t in zip(rows, tokens, strict=True) if fold(i) != 1 for w in t)
    n, v = sum(counts.values()), len(counts)
    return [
        (i, fold(i) == 1, len(t), sum(counts[w] > 0 for w in t), n, sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t))
        for (i, *_), t in zip(rows, tokens, strict=True)
    ]
