"""Benchmark decontamination with a distributed positional inverted index.

``build_index`` splits the training texts into segments, as search engines do, and stores in each segment the
positions of every term of its texts. ``phrase_matches`` intersects offset-adjusted position lists of a segment,
starting at the rarest term of each benchmark window, and ``proximity_matches`` finds windows whose terms lie
close together in any order. Segments are independent: nothing is shuffled, a very common passage or source
spreads over the segments like any other text, and a lost task is redone from its own input.

The benchmark is sent to the tasks in blocks of bounded size (``block_bytes`` of text, some five times that in a
worker), however large it is.

Defined results: null or wordless texts have no words and no hits; an item without words matches nothing;
repeated rows each get their own result row; an empty corpus or benchmark gives no rows or no hits; columns
other than the id and the text are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillframe.llm._common import durable, rows_of, settled, text_bytes

#: Lower-cases A-Z and turns every byte outside words (digits, letters, bytes beyond ASCII) into a space.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

INDEX_SCHEMA = T.StructType(
    [
        T.StructField("segment", T.StringType()),
        T.StructField("doc_ids", T.ArrayType(T.LongType())),
        T.StructField("doc_ends", T.ArrayType(T.IntegerType())),
        T.StructField("terms", T.BinaryType()),
        T.StructField("counts", T.BinaryType()),
        T.StructField("postings", T.BinaryType()),
    ]
)
INDEX_ARROW = pa.schema(
    [("segment", pa.string()), ("doc_ids", pa.list_(pa.int64())), ("doc_ends", pa.list_(pa.int32())), ("terms", pa.binary()), ("counts", pa.binary()), ("postings", pa.binary())]
)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def pack(values: np.ndarray) -> bytes:
    """int32 values as deltas, byte plane by byte plane, compressed."""
    deltas = np.diff(values.astype(np.int32), prepend=np.int32(0)).astype("<i4")
    return zstandard.ZstdCompressor(level=1).compress(deltas.view(np.uint8).reshape(-1, 4).T.tobytes())


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    deltas = np.ascontiguousarray(planes.reshape(4, -1).T).view("<i4").ravel()
    return np.cumsum(deltas, dtype=np.int32)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", segment_bytes: int = 4 << 20) -> DataFrame:
    """The index of docs, one row a segment: its documents, their ends (in words), its terms and their postings.

    A segment closes once it holds ``segment_bytes`` of text; a longer text is a segment of its own, whole.
    """

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, number = TaskContext.get().partitionId(), count()

        def segment(ids: list, ends: list[int], words: list[bytes]) -> pa.RecordBatch:
            seen = defaultdict(count().__next__)
            terms = np.fromiter(map(seen.__getitem__, words), np.int32, len(words))
            narrow = terms.astype(np.uint16) if len(seen) < 1 << 16 else terms  # sorted by radix
            columns = [[f"{task}-{next(number)}"], [ids], [ends], [b" ".join(seen)], [pack(np.bincount(terms, minlength=len(seen)))], [pack(np.argsort(narrow, kind="stable"))]]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, INDEX_ARROW, strict=True)], schema=INDEX_ARROW)

        ids, ends, words, held = [], [], [], 0
        for doc, text in rows_of(batches, "id", "text"):
            words += words_of(text)
            ids.append(doc)
            ends.append(len(words))
            held += len(text)
            if held >= segment_bytes or len(ids) >= 50_000:
                yield segment(ids, ends, words)
                ids, ends, words, held = [], [], [], 0
        if ids:
            yield segment(ids, ends, words)

    return docs.select(F.col(id_col).cast("long").alias("id"), text_bytes(text_col).alias("text")).mapInArrow(index, INDEX_SCHEMA)


class Windows:
    """Distinct benchmark windows: places in one array of term numbers, so a word costs a few integers, not a row of them."""

    def __init__(self, items: list[tuple[str, bytes]], size: int):
        number: dict[bytes, int] = {}
        self.size, self.items = size, sorted({name for name, _ in items})
        at = {name: i for i, name in enumerate(self.items)}
        terms, starts, lengths, owners = [np.full(0, -1, np.int32)], [], [], []
        held = 0
        for name, text in items:
            own = np.array([number.setdefault(w, len(number)) for w in words_of(text)], np.int32)
            n = max(1, len(own) - size + 1) if len(own) else 0
            terms.append(own)
            starts.append(held + np.arange(n, dtype=np.int32))
            lengths.append(np.full(n, min(size, len(own)), np.int32))
            owners.append(np.full(n, at[name], np.int32))
            held += len(own)
        self.vocabulary = number
        # as many pads as a window may reach beyond the last word
        self.terms = np.concatenate([*terms, np.full(size, -1, np.int32)])
        self.starts, self.lengths, owner = (np.concatenate([np.zeros(0, np.int32), *x]) for x in (starts, lengths, owners))
        rows = np.ascontiguousarray(self.rows(np.arange(len(self.starts))))
        _, first, same = np.unique(rows.view(f"V{4 * size}").ravel(), return_index=True, return_inverse=True) if len(rows) else (None, np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.starts, self.lengths = self.starts[first], self.lengths[first]
        pairs = np.unique(same.astype(np.int64) * max(1, len(self.items)) + owner)
        window, self.owner = np.divmod(pairs, max(1, len(self.items)))
        self.owner = self.owner.astype(np.int32)
        self.owner_ends = np.cumsum(np.bincount(window, minlength=len(first))).astype(np.int32)

    def __len__(self) -> int:
        return len(self.starts)

    def rows(self, windows: np.ndarray) -> np.ndarray:
        """The term numbers of windows, padded with -1."""
        column = np.arange(self.size)
        return np.where(column < self.lengths[windows, None], self.terms[self.starts[windows, None] + column], np.int32(-1))

    def owners(self, window: int) -> list[int]:
        return self.owner[self.owner_ends[window - 1] if window else 0 : self.owner_ends[window]].tolist()


class Segment:
    """Postings of one index row for the terms of a benchmark block."""

    def __init__(self, row: dict, vocabulary: dict[bytes, int]):
        self.ends = np.array(row["doc_ends"], np.int64)
        postings, counts = unpack(row["postings"]), unpack(row["counts"])
        self.size = len(postings)
        self.first, self.freq = np.zeros(len(vocabulary), np.int64), np.zeros(len(vocabulary), np.int64)
        starts = np.concatenate(([0], np.cumsum(counts)))
        lists, filled = [], 0
        known = sorted((number, k) for k, term in enumerate(row["terms"].split()) if (number := vocabulary.get(term)) is not None)
        for number, k in known:
            self.first[number], self.freq[number] = filled, counts[k]
            lists.append(postings[starts[k] : starts[k + 1]])
            filled += counts[k]
        self.positions = np.concatenate(lists).astype(np.int64) if lists else np.zeros(0, np.int64)
        #: term number and position in one ascending key, in which any posting is found by bisection
        self.keys = self.positions + np.repeat([n for n, _ in known], [counts[k] for _, k in known]).astype(np.int64) * self.size if lists else self.positions

    def has(self, terms: np.ndarray, positions: np.ndarray) -> np.ndarray:
        key = terms * self.size + positions
        found = np.searchsorted(self.keys, key)
        inside = (positions >= 0) & (positions < self.size) & (found < len(self.keys))
        inside[inside] = self.keys[found[inside]] == key[inside]
        return inside

    def anchors(self, windows: Windows) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """In bounded blocks: windows, their terms and columns from rare to common, and candidates (row among these, position of its rarest term)."""
        most = np.iinfo(np.int64).max
        for low in range(0, len(windows), 1 << 16):
            ids = np.arange(low, min(low + (1 << 16), len(windows)))
            terms = windows.rows(ids)
            freq = np.where(terms >= 0, self.freq[terms], most)
            there = freq.min(axis=1) > 0
            ids, terms, freq = ids[there], terms[there], freq[there]
            order = np.argsort(freq, axis=1, kind="stable")
            ranked = np.take_along_axis(terms, order, 1).astype(np.int64)
            sizes = self.freq[ranked[:, 0]]
            cuts = np.searchsorted(np.cumsum(sizes), np.arange(1 << 20, sizes.sum(), 1 << 20))
            for part, n in zip(np.split(np.arange(len(ids)), cuts), np.split(sizes, cuts), strict=True):
                if n.sum():
                    row = np.repeat(part, n)
                    inner = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                    yield ids, ranked, order, row, self.positions[self.first[ranked[row, 0]] + inner]

    def phrases(self, windows: Windows) -> tuple[np.ndarray, np.ndarray]:
        """(window, start) of every exact occurrence inside one document."""
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for ids, ranked, order, row, position in self.anchors(windows):
            start = position - order[row, 0]
            for rank in range(1, windows.size):
                term = ranked[row, rank]
                keep = term < 0
                keep[~keep] = self.has(term[~keep], (start + order[row, rank])[~keep])
                row, start = row[keep], start[keep]
            keep = (start >= 0) & (self.doc(start) == self.doc(start + windows.lengths[ids[row]] - 1))
            found.append((ids[row[keep]], start[keep]))
        return np.concatenate([w for w, _ in found]), np.concatenate([s for _, s in found])

    def doc(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, position, side="right")

    def near(self, windows: Windows, slop: int) -> tuple[np.ndarray, np.ndarray]:
        """(window, start) of every stretch of at most length + slop words that begins with one of the window's terms and has all of them, in any order."""
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        begins = np.concatenate(([0], self.ends[:-1]))
        for ids, ranked, _, every, position in self.anchors(windows):
            times = (ranked[:, :, None] == ranked[:, None, :]).sum(axis=2)
            for back in range(windows.size + slop):
                row, start = every, position - back
                doc = self.doc(position)
                end = np.minimum(start + windows.lengths[ids[row]] + slop, self.ends[doc])
                keep = (start >= begins[doc]) & (position < end)
                row, start, end = row[keep], start[keep], end[keep]
                first = np.zeros(len(row), bool)  # whether the stretch begins with a term of the window
                for rank in range(windows.size):
                    term = ranked[row, rank]
                    low = term * self.size
                    at = np.searchsorted(self.keys, low + start)
                    last = np.minimum(at + times[row, rank] - 1, len(self.keys) - 1)
                    keep = (term < 0) | (at + times[row, rank] <= len(self.keys)) & (self.keys[last] < low + end) & (self.keys[last] >= low + start)
                    first |= (term >= 0) & (self.keys[np.minimum(at, len(self.keys) - 1)] == low + start)
                    row, start, end, first = row[keep], start[keep], end[keep], first[keep]
                found.append((ids[row[first]], start[first]))
        pairs = np.unique(np.stack([np.concatenate([x[k] for x in found]) for k in (0, 1)], axis=1), axis=0)
        return pairs[:, 0], pairs[:, 1]


def item_blocks(items: DataFrame, id_col: str, text_col: str, block_bytes: int) -> list[DataFrame]:
    """The benchmark in blocks of about block_bytes, by a hash of its rows."""
    items = items.select(F.col(id_col).cast("string").alias("id"), text_bytes(text_col).alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = total // block_bytes + 1
    return [items.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k) for k in range(n)] if n > 1 else [items]


def _search(index: DataFrame, windows: Windows, slop: int | None) -> DataFrame:
    schema = "segment string, ordinal int, doc_id long, n_words int, spans array<struct<start:int,end:int>>, items array<string>"
    span = pa.struct([("start", pa.int32()), ("end", pa.int32())])
    arrow = pa.schema([("segment", pa.string()), ("ordinal", pa.int32()), ("doc_id", pa.int64()), ("n_words", pa.int32()), ("spans", pa.list_(span)), ("items", pa.list_(pa.string()))])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                segment = Segment(row, windows.vocabulary)
                window, start = segment.phrases(windows) if slop is None else segment.near(windows, slop)
                length = windows.lengths[window] + (slop or 0)
                docs = segment.doc(start)
                begins = np.concatenate(([0], segment.ends[:-1]))
                spans, items = defaultdict(list), defaultdict(set)
                by_start = np.argsort(start, kind="stable")
                for d, s, n, w in zip(docs[by_start].tolist(), start[by_start].tolist(), length[by_start].tolist(), window[by_start].tolist(), strict=True):
                    items[d].update(windows.owners(w))
                    s, e = s - int(begins[d]), min(s - int(begins[d]) + n, int(segment.ends[d] - begins[d]))
                    if spans[d] and spans[d][-1]["end"] >= s:
                        spans[d][-1]["end"] = max(e, spans[d][-1]["end"])
                    else:
                        spans[d].append({"start": s, "end": e})
                n = len(row["doc_ids"])
                columns = [
                    [row["segment"]] * n, range(n), row["doc_ids"], segment.ends - begins,
                    [spans.get(d, []) for d in range(n)], [sorted(windows.items[i] for i in items.get(d, ())) for d in range(n)],
                ]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return index.mapInArrow(search, schema)


def _matches(index: DataFrame, items: DataFrame, window: int, slop: int | None, id_col: str, text_col: str, block_bytes: int) -> DataFrame:
    blocks = item_blocks(items, id_col, text_col, block_bytes)
    index = durable(index) if len(blocks) > 1 else index  # its segments keep their names from block to block
    found = [_search(index, Windows([(r.id, bytes(r.text)) for r in block.collect()], window), slop) for block in blocks]
    if len(found) > 1:  # the blocks' spans of a document are merged
        every = found[0]
        for more in found[1:]:
            every = every.unionByName(more)
        every = every.groupBy("segment", "ordinal").agg(
            F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"),
            F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        )
        merged = F.expr(
            "aggregate(spans, cast(array() as array<struct<start:int,end:int>>), (a, s) -> CASE WHEN size(a) > 0 AND element_at(a, -1).end >= s.start"
            " THEN concat(slice(a, 1, size(a) - 1), array(named_struct('start', element_at(a, -1).start, 'end', greatest(element_at(a, -1).end, s.end)))) ELSE concat(a, array(s)) END)"
        )
        found = [every.withColumn("spans", merged)]
    hit = F.expr("aggregate(spans, 0L, (a, s) -> a + s.end - s.start)")
    return found[0].select("doc_id", F.col("n_words").cast("long").alias("n_words"), hit.alias("n_hit"), "spans", "items")


def phrase_matches(index: DataFrame, items: DataFrame, window: int = 13, id_col: str = "item_id", text_col: str = "text", block_bytes: int = 4 << 20) -> DataFrame:
    """A row for each indexed document: n_words, n_hit, the merged spans (in words, end exclusive) and the item ids whose windows occur exactly."""
    return _matches(index, items, window, None, id_col, text_col, block_bytes)


def proximity_matches(index: DataFrame, items: DataFrame, window: int = 13, slop: int = 3, id_col: str = "item_id", text_col: str = "text", block_bytes: int = 4 << 20) -> DataFrame:
    """As phrase_matches, for windows whose terms all lie, in any order, within window + slop words of a document."""
    return _matches(index, items, window, slop, id_col, text_col, block_bytes)


def contamination(docs: DataFrame, items: DataFrame, share: int = 20) -> DataFrame:
    """phrase_matches over a stored index of docs, and contaminated: a hit, and at least one word in ``share`` hit."""
    found = phrase_matches(durable(build_index(docs)), items)
    return found.withColumn("contaminated", (F.col("n_hit") > 0) & (F.lit(share) * F.col("n_hit") >= F.col("n_words")))


def keep_clean(docs: DataFrame, items: DataFrame, share: int | None = None) -> DataFrame:
    """The rows of docs without a hit, with all their columns, whatever their names; with ``share``, those that contamination does not mark.

    A passage of the benchmark is as harmful in a long document as in a short one, so by default any hit counts.
    """
    key = F.xxhash64("doc_id", "text")
    hit = "n_hit > 0" if share is None else f"n_hit > 0 and {share} * n_hit >= n_words"
    found = lambda: phrase_matches(durable(build_index(docs.select(key.alias("doc_id"), "text"))), items)
    marked = settled(lambda: found().where(hit).select(F.col("doc_id").alias("key")).distinct())
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), key.alias("key"))
    return rows.join(marked, "key", "left_anti").select("row.*")
