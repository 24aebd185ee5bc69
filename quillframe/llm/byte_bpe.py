"""Byte-level BPE by a sentencepiece model that is serialised straight from a rank file.

A rank file (tiktoken's format: base64 bytes and rank on each line) becomes a sentencepiece BPE model without any
training: each byte is mapped to one printable character, a token becomes the piece of its characters with minus its
rank as score, and the normaliser is the identity. Sentencepiece then merges, as the rank file wants, the adjacent
pair whose joint piece has the lowest rank, the leftmost of equals. Texts are split into pre-tokens first, each is
encoded separately, and decoding maps the ids' pieces back to bytes.

Texts stay in their partitions: no shuffle. Each task holds one model and a bounded cache of pre-tokens.

Defined results: null and empty texts have no tokens and decode to empty; invalid ids raise; repeated rows each get
their own row; an empty table gives no rows; other columns are ignored by ``encode`` and kept by ``with_tokens``,
which replaces columns named n_tokens, ids and round_trip.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import sys
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillframe.llm._common import rows_of

CACHED = 500_000


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where it is printable and no space, else one from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


def rank_file(path: str) -> bytes:
    """The rank file's bytes, read on the driver: they travel with the tasks, so executors need no copy of the file."""
    with open(path, "rb") as file:
        return file.read()


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, data.splitlines()))}


def _varint(n: int) -> bytes:
    out = b""
    while n > 0x7F:
        out, n = out + bytes([n & 0x7F | 0x80]), n >> 7
    return out + bytes([n])


def _field(number: int, value: bytes | int | np.float32) -> bytes:
    """A protobuf field: length-delimited, varint or 32-bit float."""
    if isinstance(value, np.float32):
        return _varint(number << 3 | 5) + value.tobytes()
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def model_bytes(ranks: dict[bytes, int]) -> bytes:
    """The serialised model; a token's id is its rank, and the id after the last is unknown.

    Fields by the public sentencepiece_model.proto: ModelProto 1 pieces (1 text, 2 score, 3 type: 2 unknown,
    5 unused), 2 trainer_spec (3 model_type: 2 BPE, 40-43 ids), 3 normalizer_spec (1 name, 3 add_dummy_prefix,
    4 remove_extra_whitespaces, 5 escape_whitespaces).
    """
    characters = byte_characters()
    by_rank = {rank: "".join(characters[b] for b in token) for token, rank in ranks.items()}
    size = max(by_rank, default=-1) + 1
    pieces = []
    for rank in range(size):
        text = by_rank.get(rank)
        kind = b"" if text is not None else _field(3, 5)
        pieces.append(_field(1, _field(1, (text if text is not None else f"<gap{rank}>").encode()) + _field(2, np.float32(-rank)) + kind))
    pieces.append(_field(1, _field(1, b"<unk>") + _field(2, np.float32(0)) + _field(3, 2)))
    none = (1 << 64) - 1  # -1
    trainer = _field(3, 2) + _field(40, size) + _field(41, none) + _field(42, none) + _field(43, none)
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, normalizer)


class Codec:
    """Encodes and decodes texts by a serialised model."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(ranks))
        self.characters = byte_characters()
        # white space as Unicode defines it, as in the library whose results count
        self.split = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
        self.inverse = [b""] * (max(ranks.values(), default=-1) + 1)
        back = {c: b for b, c in enumerate(self.characters)}
        for i in range(len(self.inverse)):
            piece = self.model.id_to_piece(i)
            self.inverse[i] = bytes(back[c] for c in piece) if all(c in back for c in piece) else b""
        self.cache: dict[str, bytes] = {}

    def _learn(self, tokens: Iterable[str]) -> None:
        if len(self.cache) > CACHED:
            self.cache.clear()
        new = [t for t in set(tokens) if t not in self.cache]
        raw = [t.encode() for t in new]
        merged = self.model.encode([r.decode("latin-1").translate(self._map) for r in raw], num_threads=1) if raw else []
        for t, r, ids in zip(new, raw, merged, strict=True):
            own = self.ranks.get(r)  # a pre-token in the vocabulary is one token, even if no merges lead to it
            self.cache[t] = np.array(ids if own is None else [own], "<u4").tobytes()

    @functools.cached_property
    def _map(self) -> dict[int, str]:
        return dict(enumerate(self.characters))

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        tokens = self.split(text)
        try:
            return b"".join(map(self.cache.__getitem__, tokens))
        except KeyError:
            self._learn(tokens)
            return b"".join(map(self.cache.__getitem__, tokens))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.inverse.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def codec(data: bytes, pattern: str) -> Codec:
    """One codec in a process for all its tasks, from a rank file's bytes."""
    own = vars(sys).setdefault("_quillframe_codecs", {})
    if (data, pattern) not in own:
        own.clear()
        own[data, pattern] = Codec(read_ranks(data), pattern)
    return own[data, pattern]


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids (binary: little-endian unsigned 32-bit), and ids_sha256 and decoded_sha256 of the ids decoded again.

    ``path`` is the rank file's path on the driver, ``pattern`` splits texts into pre-tokens.
    """
    data = rank_file(path)
    arrow = pa.schema([("id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(data, pattern)
        out, held = [], 0
        for doc, text in rows_of(batches, "id", "text"):
            ids = own.encode(text or "")
            out.append((doc, len(ids) // 4, ids, hashlib.sha256(ids).hexdigest(), hashlib.sha256(own.decode(ids)).hexdigest()))
            held += len(ids)
            if held > 8 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)
                out, held = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, n_tokens long, ids binary, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)


def _packed(df: DataFrame, without: Iterable[str]) -> DataFrame:
    """One column ``row`` of all others, whatever their names."""
    return df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns if c not in without)).alias("row"), *(F.col(c) for c in without if c in df.columns))


def decode(encoded: DataFrame, path: str, pattern: str, ids_col: str = "ids", into: str = "text") -> DataFrame:
    """encoded with a string column ``into``: the text of its ids."""
    data = rank_file(path)
    packed = _packed(encoded, [into]).select("row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(data, pattern)
        for batch in batches:
            row = batch.column("row")
            texts = [own.decode(ids or b"").decode("utf-8", "replace") for ids in pc.struct_field(row, ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([row, pa.array(texts, pa.string())], names=["row", into])

    return packed.mapInArrow(run, T.StructType([packed.schema["row"], T.StructField(into, T.StringType())])).select("row.*", into)


def with_tokens(docs: DataFrame, path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """docs with all their columns, and n_tokens, ids and round_trip (whether the ids decode to the text)."""
    data = rank_file(path)
    added = [("n_tokens", T.LongType()), ("ids", T.BinaryType()), ("round_trip", T.BooleanType())]
    packed = _packed(docs, dict(added)).select("row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(data, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                row = batch.column("row").slice(at, 512)
                texts = pc.struct_field(row, text_col).cast(pa.string()).to_pylist()
                ids = [own.encode(t or "") for t in texts]
                same = [own.decode(i) == (t or "").encode() for i, t in zip(ids, texts, strict=True)]
                new = [pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(same, pa.bool_())]
                yield pa.RecordBatch.from_arrays([row, *new], names=["row", *dict(added)])

    schema = T.StructType([packed.schema["row"], *(T.StructField(n, t) for n, t in added)])
    return packed.mapInArrow(run, schema).select("row.*", *dict(added))
