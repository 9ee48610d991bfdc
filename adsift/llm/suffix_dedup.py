"""Removal of bytes covered by long strings that occur more than once, with suffix arrays.

A string of LENGTH bytes holds a gram of GRAM bytes whose hash is its smallest: an anchor that any equal string has at the
same place. So only anchors whose gram occurs twice can lie in a repeated string, and only the bytes around them matter.
Occurrences with equal surroundings repeat throughout. For the others, the bytes before and from the anchor are cut into
phrases (a phrase ends with a gram that its own bytes mark, so none begins another), and a suffix array of the phrases
(see suffixes.py), once forward and once backward, puts those next to each other that agree longest. The lengths of
agreement then tell for every shift of the window which occurrences share it, byte by byte.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adsift.llm.suffixes import suffix_array
from adsift.session import materialise, ship

ship(__name__)
ship("adsift.llm.suffixes")

LENGTH, GRAM = 400, 32
SEGMENT = 1 << 17  # bytes of a text looked at together
BASE, INVERSE = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
PHRASE_GRAM, PHRASE_MARK = 8, 32  # a phrase ends with 8 bytes whose hash is divisible by 32
TOGETHER = 3_000  # surroundings compared in one suffix array, at least; whole groups of a gram
PARTS = 4  # ranges of shifts; windows of one range share all but a PARTS-th of the places they may start at
# A gram with more surroundings than this, or than this share of all, is split by what the windows of a range share; what
# then still has more than MOST_TOGETHER surroundings is compared by window digests instead.
MOST_TOGETHER, MOST_SHARE = 20_000, 400


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class _Hashes:
    """Hashes of all stretches of `size` bytes."""

    def __init__(self, size: int, longest: int):
        self.size, self.up, self.down = size, _powers(BASE, longest), _powers(INVERSE, longest)

    def __call__(self, raw: np.ndarray) -> np.ndarray:
        n = len(raw)
        sums = np.concatenate([[np.uint64(0)], np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * self.up[:n], dtype=np.uint64)])
        x = (sums[self.size :] - sums[: n - self.size + 1]) * self.down[: n - self.size + 1]
        x = (x ^ x >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ x >> np.uint64(29)


def _anchors(raw: np.ndarray, hashes: _Hashes, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, grams): the smallest gram of every stretch of `length` bytes; of equal ones in a stretch the last."""
    window = length - GRAM + 1
    places, grams = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
    low = np.uint64(0xFFFFFF)
    for at in range(0, max(0, len(raw) - length + 1), SEGMENT):
        hashed = hashes(raw[at : at + SEGMENT + length - 1])
        m = len(hashed)
        key = hashed & ~low | low - np.arange(m, dtype=np.uint64)
        rows = np.concatenate([key, np.full(-m % window, ~np.uint64(0))]).reshape(-1, window)
        ahead = np.minimum.accumulate(rows, axis=1).ravel()
        behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        starts = m - window + 1
        least = np.minimum(behind[:starts], ahead[window - 1 : window - 1 + starts])
        found = np.unique((low - (least & low)).astype(np.int64))
        places.append(found + at)
        grams.append(hashed[found])
    both, first = np.unique(np.concatenate(places), return_index=True)
    return both, np.concatenate(grams)[first]


def _parts(length: int) -> list[tuple[int, int]]:
    """Ranges (lowest, highest) of the shifts of a window that holds the anchor."""
    shifts = length - GRAM + 1
    wide = -(-shifts // PARTS)
    return [(low, min(low + wide, shifts) - 1) for low in range(0, shifts, wide)]


def _digest(stretch: bytes, ahead: int = 0) -> bytes:
    """What stands for a stretch of bytes, with `ahead` of them before the anchor: nobody can make two with one digest."""
    return hashlib.blake2b(stretch, digest_size=16, salt=ahead.to_bytes(2, "little")).digest()


def _key(text: Column) -> Column:
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b"))


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id")).alias("doc"), _key(text).alias("key"), text.alias("text"))


def _occurrences(texts: DataFrame, length: int) -> DataFrame:
    """doc, key, n_bytes, sha256, and the anchors of each text: places, grams and hashes of their surroundings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, reach = _Hashes(GRAM, SEGMENT + length), length - GRAM
        for batch in batches:
            sizes, digests, found = [], [], []
            for value in batch.column("text"):
                raw = value.as_py().encode("utf-8", "replace")
                places, grams = _anchors(np.frombuffer(raw, dtype=np.uint8), hashes, length)
                around = [_digest(raw[max(0, p - reach) : p + length], min(p, reach)) for p in places.tolist()]
                sizes.append(len(raw))
                digests.append(hashlib.sha256(raw).hexdigest())
                found.append((places, grams, around))
            offsets = pa.array(np.cumsum([0, *(len(f[0]) for f in found)]), pa.int32())
            flat = [np.concatenate([f[k] for f in found]).view(np.int64) if found else np.empty(0, np.int64) for k in range(2)]
            arounds = pa.array([a for f in found for a in f[2]], pa.binary())
            lists = [pa.ListArray.from_arrays(offsets, x) for x in (*map(pa.array, flat), arounds)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), batch.column("key"), pa.array(sizes, pa.int64()), pa.array(digests, pa.string()), *lists],
                names=["doc", "key", "n_bytes", "sha256", "places", "grams", "arounds"],
            )

    doc = texts.schema["doc"].dataType.simpleString()
    kinds = f"doc {doc}, key struct<a:bigint,b:bigint>, n_bytes long, sha256 string, places array<long>, grams array<long>, arounds array<binary>"
    return texts.mapInArrow(run, kinds)


def _surroundings(texts: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """(gram, around, before, after): the bytes before an anchor (turned round) and from it on, for the wanted ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, anchors in zip(batch.column("text"), batch.column("anchors"), strict=True):
                raw = text.as_py().encode("utf-8", "replace")
                rows = anchors.as_py()
                before = [raw[max(0, x["place"] - length + GRAM) : x["place"]][::-1] for x in rows]
                after = [raw[x["place"] : x["place"] + length] for x in rows]
                columns = [pa.array([x[c] for x in rows], kind) for c, kind in (("gram", pa.int64()), ("around", pa.binary()), ("surroundings", pa.int64()))]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(before, pa.binary()), pa.array(after, pa.binary())],
                    names=["gram", "around", "surroundings", "before", "after"],
                )

    joined = texts.join(wanted, ["key", "doc"]).select("text", "anchors")
    return joined.mapInArrow(run, "gram long, around binary, surroundings long, before binary, after binary")


def _ranked(strings: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, agree): the strings in an order in which those that agree longest are neighbours, and for each the number
    of bytes in which it agrees with the one before it."""
    number = {x: k for k, x in enumerate(dict.fromkeys(strings))}
    if len(number) < len(strings):  # equal strings stand side by side and agree throughout
        order, agree = _ranked(list(number), width)
        place, lengths = np.empty(len(order), np.int64), np.array([len(x) for x in number])
        place[order] = np.arange(len(order))
        places = place[[number[x] for x in strings]]
        by = np.argsort(places, kind="stable")
        at = places[by]
        return by, np.where(np.diff(at, prepend=-1) > 0, agree[at], lengths[order[at]])
    whole = b"".join(strings)
    ends = np.cumsum([len(s) for s in strings])
    starts = ends - [len(s) for s in strings]
    raw = np.frombuffer(whole + bytes(PHRASE_GRAM), dtype=np.uint8)
    eights = np.lib.stride_tricks.sliding_window_view(raw, PHRASE_GRAM)[: len(whole)]
    values = np.ascontiguousarray(eights).view("<u8").ravel()
    marks = np.flatnonzero(((values * BASE) >> np.uint64(40)) % np.uint64(PHRASE_MARK) == 0)
    first, upto = np.searchsorted(marks, starts + 1), np.searchsorted(marks, ends - PHRASE_GRAM, side="right")
    # A phrase begins at a mark (or the string) and ends with the bytes of the next mark (or the string).
    phrases: list[bytes] = []
    heads: list[int] = []
    for a, b, i, j in zip(starts.tolist(), ends.tolist(), first.tolist(), upto.tolist(), strict=True):
        heads.append(len(phrases))
        at = a
        for m in marks[i:j].tolist():
            phrases.append(whole[at : m + PHRASE_GRAM])
            at = m
        phrases.append(whole[at:b])
        phrases.append(b"")  # below every other phrase
    number = {p: n for n, p in enumerate(sorted(set(phrases)), 1)}
    places = np.full(len(phrases), -1)
    places[heads] = np.arange(len(strings))
    order = places[suffix_array([number[p] for p in phrases])]
    order = order[order >= 0]
    padded = np.zeros((len(strings), width + 1), dtype=np.uint8)
    lengths = ends - starts
    inside = np.arange(width + 1)[None, :] < lengths[:, None]
    padded[inside] = np.frombuffer(whole, dtype=np.uint8)
    above, below = padded[order[:-1]], padded[order[1:]]
    differ = above != below
    differ[:, -1] = True
    agree = np.minimum(differ.argmax(axis=1), np.minimum(lengths[order[:-1]], lengths[order[1:]]))
    return order, np.concatenate([[0], agree])


def _partnered(before: list[bytes], after: list[bytes], length: int) -> np.ndarray:
    """The anchors that have with another what all windows of some range of shifts hold; no other anchor shares a window."""
    found: set[int] = set()
    for low, high in _parts(length):
        first: dict[tuple[bytes, bytes], int] = {}
        for k, (b, a) in enumerate(zip(before, after, strict=True)):
            if len(b) >= low and len(a) >= length - high:
                other = first.setdefault((b[:low], a[: length - high]), k)
                if other != k:
                    found.update((other, k))
    return np.array(sorted(found), dtype=np.int64)


def _shared_shifts(before: list[bytes], after: list[bytes], length: int) -> np.ndarray:
    """For each anchor and shift (bytes of the window before the anchor) whether another anchor shares that window."""
    shifts, whole = length - GRAM + 1, len(before)
    some = _partnered(before, after, length)
    if not len(some):
        return np.zeros((whole, shifts), dtype=bool)
    before, after = [before[k] for k in some.tolist()], [after[k] for k in some.tolist()]
    left, left_agree = _ranked(before, shifts - 1)
    right, right_agree = _ranked(after, length)
    n = len(before)
    back, fore = np.empty(n, np.int64), np.empty(n, np.int64)
    back[left], fore[right] = np.arange(n), np.arange(n)
    left_size, right_size = np.array([len(b) for b in before]), np.array([len(a) for a in after])
    out = np.zeros((whole, shifts), dtype=bool)
    for shift in range(shifts):
        fits = np.flatnonzero((left_size >= shift) & (right_size >= length - shift))
        if len(fits) < 2:
            continue
        classes = np.cumsum(left_agree < shift)[back[fits]] * (n + 1) + np.cumsum(right_agree < length - shift)[fore[fits]]
        by = np.argsort(classes)
        same = np.diff(classes[by]) == 0
        out[some[fits[by[1:][same]]], shift] = True
        out[some[fits[by[:-1][same]]], shift] = True
    return out


def _stretches(shared: np.ndarray, length: int) -> list[list[tuple[int, int]]]:
    """For each anchor the stretches that its shared windows cover, relative to it."""
    edge = np.diff(np.pad(shared.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    rows, begins = np.nonzero(edge == 1)
    _, ends = np.nonzero(edge == -1)
    out: list[list[tuple[int, int]]] = [[] for _ in shared]
    for row, a, b in zip(rows.tolist(), begins.tolist(), ends.tolist(), strict=True):
        out[row].append((1 - b, length - a))
    return out


def _compared(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """(gram, around, stretches) from surroundings sorted by core; some whole groups at a time."""
    held: list[tuple] = []

    def solved() -> pa.RecordBatch:
        rows = {x[:3]: x[3:] for x in held}  # identical rows of docs bring the same surroundings twice
        shared = _shared_shifts([x for x, _ in rows.values()], [y for _, y in rows.values()], length)
        found = [[{"a": a, "b": b} for a, b in s] for s in _stretches(shared, length)]
        held.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array([g for _, g, _ in rows], pa.int64()), pa.array([a for _, _, a in rows], pa.binary()), pa.array(found, STRETCHES)],
            names=["gram", "around", "stretches"],
        )

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("core", "gram", "around", "before", "after")), strict=True):
            if len(held) >= TOGETHER and held[-1][0] != row[0]:
                yield solved()
            held.append(row)
    if held:
        yield solved()


STRETCHES = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
COMPARED = "gram long, around binary, stretches array<struct<a:int,b:int>>"


def _split(rows: DataFrame, length: int) -> DataFrame:
    """(core, gram, around, before, after): for each range of shifts the bytes that its windows can hold; core is a hash of
    those that all of them hold, so rows that share a window of the range have the same."""
    each = []
    for low, high in _parts(length):
        core = F.xxhash64(F.lit(low), "gram", F.substring("before", 1, low), F.substring("after", 1, length - high))
        part = F.struct(core.alias("core"), F.substring("before", 1, high).alias("before"), F.substring("after", 1, length - low).alias("after"))
        each.append(F.when((F.octet_length("before") >= low) & (F.octet_length("after") >= length - high), part))
    split = rows.select("gram", "around", F.explode(F.array_compact(F.array(*each))).alias("x"))
    return split.select("x.core", "gram", "around", "x.before", "x.after")


def _compared_in_parts(rows: DataFrame, length: int, most: int) -> DataFrame:
    """What _compared finds, for grams with too many surroundings for one task."""
    split = materialise(_split(rows, length), "parts")
    sizes = materialise(split.groupBy("core").agg(F.count("*").alias("size")).where("size > 1"), "part_sizes")
    largest = sizes.agg(F.max("size")).first()[0] or 0
    sized = split.join(sizes, "core")
    few = sized.where(F.col("size") <= most).drop("size").repartition("core").sortWithinPartitions("core")
    found = few.mapInArrow(lambda it: _compared(it, length), COMPARED)
    if largest > most:
        found = found.unionByName(_compared_by_digest(sized.where(F.col("size") > most).drop("size"), length))
    return found


def _digested_windows(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """(core, gram, around, windows): the digest of every window that holds the anchor, by shift; null where it does not fit."""
    shifts = length - GRAM + 1
    for batch in batches:
        out = []
        for before, after in zip(batch.column("before"), batch.column("after"), strict=True):
            left = before.as_py()
            raw, at = left[::-1] + after.as_py(), len(left)
            out.append([_digest(raw[at - s : at - s + length]) if 0 <= at - s <= len(raw) - length else None for s in range(shifts)])
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("core", "gram", "around")), pa.array(out, pa.list_(pa.binary()))], names=["core", "gram", "around", "windows"]
        )


def _compared_by_digest(rows: DataFrame, length: int) -> DataFrame:
    """What _compared finds, for cores with too many surroundings for one task: windows are counted wherever they lie."""
    each = rows.mapInArrow(lambda it: _digested_windows(it, length), "core long, gram long, around binary, windows array<binary>")
    each = each.dropDuplicates(["core", "gram", "around"]).select("gram", "around", F.posexplode("windows").alias("shift", "window")).where("window is not null")
    each = materialise(each, "windows")
    often = each.groupBy("gram", "shift", "window").agg(F.count("*").alias("n")).where("n > 1")
    shared = each.join(often, ["gram", "shift", "window"]).groupBy("gram", "around").agg(F.collect_list("shift").alias("shifts"))
    one = lambda s: F.struct((-s).cast("int").alias("a"), (F.lit(length) - s).cast("int").alias("b"))
    return shared.select("gram", "around", F.transform("shifts", one).alias("stretches"))


def _marked(texts: DataFrame, anchors: DataFrame, length: int, most: int | None) -> DataFrame:
    """(key, doc, stretches): the repeated stretches of each row, as places in its text; anchors are its stored occurrences."""
    each = anchors.select("key", "doc", F.explode(F.arrays_zip("places", "grams", "arounds")).alias("x"))
    each = each.select("key", "doc", F.col("x.places").alias("place"), F.col("x.grams").alias("gram"), F.col("x.arounds").alias("around"))
    groups = each.groupBy("gram", "around").agg(F.count("*").alias("n"), F.min(F.struct("key", "doc", "place")).alias("one"))
    grams = groups.groupBy("gram").agg(F.count("*").alias("surroundings"), F.sum("n").alias("all")).where(F.col("all") > 1)
    groups = materialise(groups.join(grams.drop("all"), "gram"), "repeated_grams")

    several = groups.where(F.col("surroundings") > 1)
    wanted = several.select("one.key", "one.doc", F.struct(F.col("one.place").alias("place"), "gram", "around", "surroundings").alias("x"))
    wanted = wanted.groupBy("key", "doc").agg(F.collect_list("x").alias("anchors"))
    around = _surroundings(texts, wanted, length)
    most_of_core = MOST_TOGETHER if most is None else most
    if most is None:
        most = max(2, min(MOST_TOGETHER, several.count() // MOST_SHARE))
    largest = several.agg(F.max("surroundings")).first()[0] or 0
    if largest > most:
        around = materialise(around, "surroundings")
    few = around.where(F.col("surroundings") <= most).drop("surroundings")
    few = few.withColumn("core", F.col("gram")).repartition("core").sortWithinPartitions("core")
    compared = few.mapInArrow(lambda it: _compared(it, length), COMPARED)
    if largest > most:
        compared = compared.unionByName(_compared_in_parts(around.where(F.col("surroundings") > most).drop("surroundings"), length, most_of_core))
    compared = materialise(compared.where(F.size("stretches") > 0), "compared")

    # Surroundings that occur more than once repeat throughout.
    throughout = F.array(F.struct(F.lit(GRAM - length).alias("a"), F.lit(length).alias("b")))
    marks = groups.select("gram", "around", "n").join(compared, ["gram", "around"], "left")
    marks = marks.select("gram", "around", F.when(F.col("n") > 1, throughout).otherwise(F.col("stretches")).alias("stretches"))
    marks = materialise(marks.where("stretches is not null"), "marks")
    here = lambda x: F.struct((F.col("place") + x["a"]).alias("a"), (F.col("place") + x["b"]).alias("b"))
    placed = each.join(marks, ["gram", "around"]).select("key", "doc", F.transform("stretches", here).alias("stretches"))
    return materialise(placed.groupBy("key", "doc").agg(F.flatten(F.collect_list("stretches")).alias("stretches")), "stretches")


def _united(stretches: list[dict], size: int) -> list[tuple[int, int]]:
    """Stretches clipped to the text, sorted and united where they touch or overlap."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((max(0, s["a"]), min(size, s["b"])) for s in stretches):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _cut(batches: Iterator[pa.RecordBatch], keep_text: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text, stretches in zip(batch.column("text"), batch.column("stretches"), strict=True):
            raw = text.as_py().encode("utf-8", "replace")
            spans = _united(stretches.as_py(), len(raw))
            edges = [0, *(x for s in spans for x in s), len(raw)]
            rest = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
            rows.append((len(raw), len(raw) - len(rest), len(spans), hashlib.sha256(rest).hexdigest(), rest if keep_text else None))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        arrays = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds]
        yield pa.RecordBatch.from_arrays([batch.column("doc"), *arrays], names=["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def _results(docs: DataFrame, length: int, id_col: str, text_col: str, most: int | None, keep_text: bool) -> DataFrame:
    if length < 2 * GRAM:
        raise ValueError(f"length must be {2 * GRAM} at least")
    texts = _texts(docs, id_col, text_col)
    anchors = materialise(_occurrences(texts, length), "anchors")
    marked = _marked(texts, anchors, length, most)
    doc = texts.schema["doc"].dataType.simpleString()
    kinds = f"doc {doc}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    cut = texts.join(marked, ["key", "doc"]).select("doc", "text", "stretches").mapInArrow(lambda it: _cut(it, keep_text), kinds)
    if keep_text:
        whole = texts.join(marked, ["key", "doc"], "left_anti")
        none = F.lit(0).cast("long")
        whole = whole.select("doc", F.octet_length("text").cast("long").alias("n_bytes"), none.alias("n_removed"), none.alias("n_spans"),
                             F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"), F.col("text").cast("binary").alias("kept"))
        return cut.unionByName(whole)
    none = F.lit(0).cast("long")
    whole = anchors.join(marked, ["key", "doc"], "left_anti").select(
        "doc", "n_bytes", none.alias("n_removed"), none.alias("n_spans"), F.col("sha256").alias("kept_sha256"))
    return cut.drop("kept").unionByName(whole)


def spans(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", most: int | None = None) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Removed are the bytes covered by a string of `length` bytes that starts anywhere else too, in the same text or another;
    kept_sha256 is the digest of the rest. Texts shorter than that lose nothing; null texts are empty. Repeated rows lose
    all that is long enough, and get equal results. Empty tables give empty results; other columns are not read. `most` is
    the number of different surroundings of a gram above which they are split by ranges of shifts, and of those of a range above
    which windows are counted by digest instead of sorted in a task.
    """
    return _results(docs, length, id_col, text_col, most, keep_text=False).select(F.col("doc.id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def removed(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", most: int | None = None) -> DataFrame:
    """What spans() returns, and kept, the bytes that stay (a cut may fall inside a character)."""
    out = _results(docs, length, id_col, text_col, most, keep_text=True)
    return out.select(F.col("doc.id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")
