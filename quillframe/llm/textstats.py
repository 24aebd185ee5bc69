"""Counts of whole texts, made once for quality rules and quality classifiers.

Words are the stretches between ASCII white space; everything is counted on UTF-8 bytes, whole texts at a time.
Null and empty texts have zero everywhere.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACES = b" \t\n\r\x0b\x0c"
SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
LETTERS = bytes([*range(65, 91), *range(97, 123), *range(128, 256)])
DIGITS = bytes(range(48, 58))
SENTENCE_ENDS = b".!?"
# Full stops, question and exclamation marks of scripts other than Latin (CJK, Devanagari, Arabic, Armenian, Ethiopic, Khmer, Myanmar, Tibetan).
WIDE_ENDS = tuple(c.encode() for c in "。．！？｡।॥؟۔։።៕။།…")
CONTINUATION = bytes(range(0x80, 0xC0))

#: how some of WIDE_ENDS begins: texts without these bytes are not searched for them
WIDE_LEAD = re.compile(b"[" + bytes(sorted({c[0] for c in WIDE_ENDS})) + b"]")

COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_chars", "n_lines", "n_short_lines", "n_bare_lines", "n_upper",
    "n_letters", "n_digits", "n_sentence_ends", "n_pipes", "n_exclaims", "n_distinct_words", "n_runs", "n_marked_words", "n_long_words", "n_quotes", "n_upper_words",
)


def among(text: bytes, chars: bytes) -> int:
    return len(text) - len(text.translate(None, chars))


def repeated_words(ids: np.ndarray) -> int:
    """Words inside 3-word windows that occur twice or more, first occurrence included."""
    n = len(ids) - 2
    if n < 2:
        return 0
    width = np.int64(ids.max()) + 1
    if width > 2_000_000:  # three ids no longer fit one key
        ids = np.unique(ids, return_inverse=True)[1]
        width = np.int64(ids.max()) + 1
    if width > 2_000_000:
        pair = np.unique(ids[:-1].astype(np.int64) * width + ids[1:], return_inverse=True)[1]
        keys = pair[:n].astype(np.int64) * width + ids[2:]
    else:
        keys = (ids[:n].astype(np.int64) * width + ids[1 : n + 1]) * width + ids[2:]
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    inside = np.zeros(n + 2, bool)
    for k in range(3):
        inside[k : k + n] |= twice
    return int(inside.sum())


def counts_of(text: bytes, number: dict[bytes, int]) -> tuple[int, ...]:
    """COUNTS of a text; number gives each word an id."""
    words = text.split()
    n = len(words)
    ids = np.fromiter(map(number.__getitem__, words), np.int64, n)
    lines = [x for x in text.split(b"\n") if x.strip()]
    points = len(text) - among(text, CONTINUATION)
    short = sum(1 for x in lines if len(x) < 30)
    ends = among(text, SENTENCE_ENDS)
    if text.isascii():
        bare = sum(1 for x in lines if x.rstrip()[-1] not in SENTENCE_ENDS)
    else:
        bare = sum(1 for x in map(bytes.rstrip, lines) if x[-1] not in SENTENCE_ENDS and not x.endswith(WIDE_ENDS))
        ends += sum(map(text.count, WIDE_ENDS)) if WIDE_LEAD.search(text) else 0
    marked = sum(1 for w in words if w[-1] in b"#*$%&|!<>")
    return (
        n, points - among(text, SPACES), among(text, SYMBOLS), len(lines) - len(set(lines)), repeated_words(ids), points, len(lines), short, bare, among(text, UPPER),
        among(text, LETTERS) - among(text, CONTINUATION), among(text, DIGITS), ends, text.count(b"|"), text.count(b"!"), len(set(words)),
        int((ids[1:] == ids[:-1]).sum()), marked, sum(1 for w in words if len(w) > 20), text.count(b'"'), sum(map(bytes.isupper, words)),
    )


def counted_rows(rows: DataFrame) -> DataFrame:
    """COUNTS, as long, beside the column ``row`` of rows, a struct with a field ``text``. No shuffle; one pass over the texts."""
    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = defaultdict(count().__next__)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                row = batch.column("row").slice(at, 512)
                out = []
                for text in pc.struct_field(row, "text").cast(pa.binary()).to_pylist():
                    if len(number) > 1_000_000:  # a word's id counts within one text only
                        number = defaultdict(count().__next__)
                    out.append(counts_of(text or b"", number))
                columns = [pa.array(c, pa.int64()) for c in zip(*out, strict=True)]
                yield pa.RecordBatch.from_arrays([row, *columns], names=["row", *COUNTS])

    return rows.mapInArrow(counts, T.StructType([rows.schema["row"], *(T.StructField(c, T.LongType()) for c in COUNTS)]))


def text_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: its id and COUNTS."""
    row = F.struct(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return counted_rows(docs.select(row.alias("row"))).select(F.col("row.id").alias(id_col), *COUNTS)
