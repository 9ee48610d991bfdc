"""Byte-level BPE encoding and decoding through a sentencepiece model made from a rank file.

The model is serialised field by field: every token is written with one printable character a byte and scored by its
negative rank, so the piece processor merges in rank order; normalisation is the identity. Texts are cut into pre-tokens
by the public pattern and each distinct stretch between spaces is encoded once a task. Decoding maps ids back to bytes.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from itertools import accumulate, chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, IntegerType, StringType, StructField, StructType

from adsift.session import ship

ship(__name__)

# Fixed values of the piece model's format.
NORMAL, UNKNOWN, BPE_MODEL = 1, 2, 2
# Bytes that a task may use to remember distinct pre-tokens, and as many for stretches between spaces; beyond that the
# memory starts afresh. An entry costs OVERHEAD bytes besides its text and ids.
REMEMBERED, OVERHEAD = 72_000_000, 200
# Bytes of a column worked on at once.
SLICE = 1_000_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and ranks of a rank file: a base64 token and its rank a line."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where Latin-1 prints it, else the next from code point 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _number(field: int, value: int) -> bytes:
    return _varint(field << 3) + _varint(value)


def _block(field: int, value: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(value)) + value


def piece_model(ranks: dict[bytes, int]) -> bytes:
    """The serialised model. Piece 0 is the unknown one; token k in rank order is piece k + 1."""
    chars = byte_characters()
    if missing := [b for b in range(256) if bytes([b]) not in ranks]:
        raise ValueError(f"bytes without a token: {missing[:5]}")
    model = bytearray(_block(1, _block(1, b"<unk>") + b"\x15" + struct.pack("<f", 0.0) + _number(3, UNKNOWN)))
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        piece = "".join(chars[b] for b in token).encode()
        model += _block(1, _block(1, piece) + b"\x15" + struct.pack("<f", -float(rank)) + _number(3, NORMAL))
    absent = b"".join(_number(field, (1 << 64) - 1) for field in (41, 42, 43))  # no sentence marks, no padding
    model += _block(2, _number(3, BPE_MODEL) + _number(4, len(ranks) + 1) + _number(40, 0) + absent)
    model += _block(3, _block(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0))
    return bytes(model)


def _encoder(model: bytes, tokens: tuple[bytes, ...], ids: tuple[int, ...]):
    """A function from a list of pre-tokens to their ids, as the bytes of an int32 array each."""
    import sentencepiece

    processor = sentencepiece.SentencePieceProcessor(model_proto=model)
    known = {t: np.int32(i).tobytes() for t, i in zip(tokens, ids, strict=True)}
    characters = str.maketrans({chr(b): c for b, c in enumerate(byte_characters())})
    by_piece = np.array([-1, *sorted(ids)], dtype=np.int32)

    def encode(pieces: list[str]) -> list[bytes]:
        raw = [p.encode("utf-8", "replace") for p in pieces]
        found = processor.encode([r.decode("latin-1").translate(characters) for r in raw], out_type=int, num_threads=1)
        flat = by_piece[np.fromiter(chain.from_iterable(found), dtype=np.int64)].tobytes()
        ends = list(accumulate((4 * len(x) for x in found), initial=0))
        # A pre-token that is itself a token is that token, whatever the merges say.
        return [known[r] if r in known else flat[a:b] for r, a, b in zip(raw, ends, ends[1:], strict=False)]

    return encode


class _Memory:
    """What was worked out for each string; it starts afresh where it would grow beyond a number of bytes."""

    def __init__(self, most: int):
        self.most, self.size = most, 0
        self.known: dict[str, bytes] = {}

    def filled(self, wanted: set[str], work) -> dict[str, bytes]:
        """The memory with all of these strings in it; work takes a list of strings."""
        new = list(wanted.difference(self.known))
        found = work(new) if new else []
        size = sum(map(len, new)) + sum(map(len, found)) + OVERHEAD * len(new)
        if self.size + size > self.most and self.known:
            self.known, self.size = {}, 0
            return self.filled(wanted, work)
        self.size += size
        self.known.update(zip(new, found, strict=True))
        return self.known


def _text_encoder(model: bytes, tokens: tuple[bytes, ...], ids: tuple[int, ...], pattern: str):
    """A function from a list of texts to the bytes of their ids.

    In the pattern a space before anything but white space always begins a pre-token, so a text without other spaces may be
    cut at them first; what lies between two, and every pre-token, is cut and encoded once and remembered.
    """
    import regex

    encoder, cut, other = _encoder(model, tokens, ids), regex.compile(pattern), regex.compile(r" (?:\s|\Z)")
    pieces, stretches = _Memory(REMEMBERED), _Memory(REMEMBERED)  # stretches by the text behind a space

    def whole(texts: list[str]) -> list[bytes]:
        cuts = [cut.findall(x) for x in texts]
        known = pieces.filled({p for c in cuts for p in c}, encoder)
        return [b"".join([known[p] for p in c]) for c in cuts]

    def encode_texts(texts: list[str]) -> list[bytes]:
        odd = [other.search(t) is not None for t in texts]
        parts = [[] if o else t.split(" ") for t, o in zip(texts, odd, strict=True)]
        known = stretches.filled(set(chain.from_iterable(islice(p, 1, None) for p in parts)), lambda new: whole([" " + x for x in new]))
        firsts = whole([t if o else p[0] for t, o, p in zip(texts, odd, parts, strict=True)])
        return [f + b"".join(map(known.__getitem__, islice(p, 1, None))) for f, p in zip(firsts, parts, strict=True)]

    return encode_texts


def _decoder(tokens: list[bytes]):
    """A function from many texts' ids, one after the other, to their bytes and to where each id's bytes end."""
    lengths = np.array([len(t) for t in tokens])
    starts, every = np.cumsum(lengths) - lengths, np.frombuffer(b"".join(tokens), dtype=np.uint8)

    def decode_ids(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(ids) and (ids.min() < 0 or ids.max() >= len(lengths) or not lengths[ids].all()):
            raise ValueError("an id without a token")
        size = lengths[ids]
        ends = np.cumsum(size)
        return every[np.repeat(starts[ids] - ends + size, size) + np.arange(size.sum())], np.concatenate([[0], ends])

    return decode_ids


def _by_rank(ranks: dict[bytes, int]) -> list[bytes]:
    tokens = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    return tokens


def _coded(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text_col: str, ids_col: str, names: list[str], check: StructField | None) -> DataFrame:
    """The named columns of docs, the ids of each text and, with check, a column worked out from the decoded bytes: whether they
    are the text's (boolean) or their digest (string). Ids and bytes never leave the task apart from what is asked for."""
    order = sorted(ranks.items(), key=lambda x: x[1])
    shared = docs.sparkSession.sparkContext.broadcast(
        (piece_model(ranks), tuple(t for t, _ in order), tuple(r for _, r in order), pattern)
    )
    schema = StructType([*(docs.schema[c] for c in names), StructField(ids_col, ArrayType(IntegerType())), *([check] if check else [])])
    digest = check is not None and check.dataType == StringType()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_texts = _text_encoder(*shared.value)
        decode_ids = _decoder(_by_rank(dict(zip(shared.value[1], shared.value[2], strict=True))))
        for batch in batches:
            for part in _pieces(batch, text_col):
                texts = [text or "" for text in part.column(text_col).to_pylist()]
                found = encode_texts(texts)
                offsets = np.cumsum([0, *(len(f) // 4 for f in found)], dtype=np.int32)
                flat = np.frombuffer(b"".join(found), dtype=np.int32)
                arrays = [*(part.column(c) for c in names), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))]
                if check:
                    raw, ends = decode_ids(flat.astype(np.int64))
                    raw, ends = raw.tobytes(), ends[offsets].tolist()
                    back = [raw[a:b] for a, b in zip(ends, ends[1:], strict=False)]
                    if digest:
                        arrays.append(pa.array([hashlib.sha256(x).hexdigest() for x in back], pa.string()))
                    else:
                        arrays.append(pa.array([x == t.encode("utf-8", "replace") for x, t in zip(back, texts, strict=True)], pa.bool_()))
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return docs.mapInArrow(run, schema)


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text_col: str = "text", ids_col: str = "ids", keep_text: bool = True) -> DataFrame:
    """docs with the token ids of each whole text (array of int; null and empty texts have none).

    The pattern cuts the text into pre-tokens, none of which is dropped; special tokens are ordinary text. The vocabulary
    is a public file of bounded size and travels with the tasks. Other columns stay, save one named like ids_col
    and, without keep_text, the text.
    """
    names = [c for c in docs.columns if c != ids_col and (keep_text or c != text_col)]
    return _coded(docs, ranks, pattern, text_col, ids_col, names, None)


def decode(docs: DataFrame, ranks: dict[bytes, int], ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """docs with the bytes that the ids stand for (null ids: no bytes); an unknown id is an error. A column named like
    bytes_col is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(_by_rank(ranks))
    kept = docs.drop(bytes_col)
    schema = StructType([*kept.schema.fields, StructField(bytes_col, BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode_ids = _decoder(shared.value)
        for batch in batches:
            for part in _pieces(batch, ids_col):
                lists = part.column(ids_col)
                raw, ends = decode_ids(np.asarray(lists.flatten()).astype(np.int64))
                per_row = np.cumsum([0, *(x or 0 for x in lists.value_lengths().to_pylist())])
                offsets = ends[per_row].astype(np.int32)
                made = pa.Array.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw.tobytes())])
                yield pa.RecordBatch.from_arrays([*part.columns, made], names=[*part.schema.names, bytes_col])

    return kept.mapInArrow(run, schema)


def _pieces(batch: pa.RecordBatch, column: str, most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with a bounded number of bytes in a column (or one row)."""
    rows = max(1, int(batch.num_rows * most / max(1, batch.column(column).nbytes)))
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def digests(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, ids_sha256 (of decimal ids joined by commas), decoded_sha256."""
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    both = _coded(texts, ranks, pattern, "text", "ids", ["doc_id"], StructField("decoded_sha256", StringType()))
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("ids_sha256"),
        "decoded_sha256",
    )


def encoded(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text_col: str = "text") -> DataFrame:
    """docs with ids, n_tokens and round_trip: whether decoding the ids gives back the text's bytes (null: empty).

    Columns of docs with these three names are replaced; all others stay as they are.
    """
    added = ("ids", "n_tokens", "round_trip")
    names = [c for c in docs.columns if c not in added or c == text_col]
    both = _coded(docs.select(*[F.col(f"`{c}`") for c in names]), ranks, pattern, text_col, "ids", names, StructField("round_trip", BooleanType()))
    return both.select(*[F.col(f"`{c}`") for c in names], "ids", F.size("ids").cast("long").alias("n_tokens"), "round_trip")
