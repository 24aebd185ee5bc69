"""Line deduplication by a deletion-neighbourhood join.

Lines are compared as words (split at ASCII white space, A-Z lower-cased). Every line with a word is dropped if an
earlier line has the same words, or is within the edit bound of it: one word inserted, deleted or replaced for each
``an_edit`` (10) words of the shorter line, at most ``edits`` (1). Earlier: by document id, then row key, then line
number. What is kept is the earliest.

1. Each line becomes a 128-bit key, its number and the hashes of its halves; equal lines are one from here on.
2. One edit leaves a half of a line as it was. Lines that share no half with a different line drop out: a lossless
   filter, counted by partial aggregation, so a very frequent half or line costs one row a task. (For a bound of
   several edits there is no such filter.)
3. The others emit themselves and every variant with up to so many words deleted as the bound allows (for one edit,
   outside a shared half), as hashed keys; equal keys are joined, against the earliest line of each key and of each
   set of gaps that is near enough: as many rows as variants, never all pairs of a group.
4. Each pair's edit distance is verified on the words themselves.

Defined results: null and empty texts have no lines to drop; rows that repeat a document id and a text share their
verdicts, so neither loses what the other keeps; ties cannot occur; an empty table gives an empty one; other columns,
whatever their names, are kept by ``dedup_lines``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillframe.llm._common import durable, row_key, rows_of, settled, text_bytes
from quillframe.llm.near_dedup import edit_distance

MOST_EDITS = 64  # numbers for words of one gap


def line_words(line: bytes) -> list[bytes]:
    return line.lower().split()


def halves(m: int) -> list[int]:
    """Heads (n: the first n words) and tails (-n) of a line of m words, of which one survives any single edit, whichever of two lines is longer."""
    return [*sorted({m // 2, (m - 1) // 2}), *(-n for n in sorted({m - m // 2, m - 1 - (m - 1) // 2}))]


def half_keys(words: list[bytes]) -> list[int]:
    return [signed(xxhash.xxh3_64_intdigest(b"h" + b" ".join(words[:n]) if n > 0 else b"t" + b" ".join(words[n:]))) for n in halves(len(words))]


def signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def variants(words: list[bytes], shared: list[int], bound: int) -> Iterator[tuple[int, list[int]]]:
    """(key, gaps): the line itself, without gaps, and the line without each choice of up to ``bound`` words outside a half that it shares (numbers in ``halves``).

    Gaps say before which kept words the others stood; several words of one gap are numbered.
    """
    m = len(words)
    parts = [halves(m)[k] for k in shared]
    places = [k for k in range(m) if not parts or any(k >= n if n > 0 else k < m + n for n in parts)]
    for n in range(bound + 1):
        for out in combinations(places, n):
            left, gaps, last = [], [], 0
            for k, place in enumerate(out):
                left += words[last:place]
                last = place + 1
                gap = (place - k) * MOST_EDITS
                while gap in gaps:
                    gap += 1
                gaps.append(gap)
            yield signed(xxhash.xxh3_64_intdigest(b" ".join(left + words[last:]))), gaps


def within(a: list[bytes], b: list[bytes], bound: int) -> bool:
    """Whether the word edit distance is at most bound."""
    return edit_distance(a, b, bound) <= bound


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 20_000) -> Iterator[pa.RecordBatch]:
    out = []
    for row in rows:
        out.append(row)
        if len(out) >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)


def _lines(docs: DataFrame, id_col: str, text_col: str, an_edit: int) -> DataFrame:
    arrow = pa.schema([("doc_id", pa.int64()), ("doc_key", pa.binary()), ("line", pa.int32()), ("key", pa.binary()), ("halves", pa.list_(pa.int64()))])

    def lines(rows: Iterator[tuple]) -> Iterator[tuple]:
        for doc, own, text in rows:
            for k, line in enumerate(text.split(b"\n")):
                words = line_words(line)
                if words:
                    yield doc, own, k, xxhash.xxh3_128_digest(b" ".join(words)), half_keys(words) if len(words) >= an_edit else []

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), row_key(id_col, text_col).alias("doc_key"), text_bytes(text_col).alias("text"))
    return rows.mapInArrow(lambda b: _batches(lines(rows_of(b, "doc_id", "doc_key", "text")), arrow), "doc_id long, doc_key binary, line int, key binary, halves array<long>")


def _near_lines(docs: DataFrame, distinct: DataFrame, id_col: str, text_col: str, edits: int, an_edit: int) -> DataFrame:
    """(doc_key, line): distinct lines with an earlier one within the edit bound."""
    if edits > 1:
        lines = distinct.where(F.size("halves") > 0).select("place", F.array().cast("array<int>").alias("shared"))
    else:
        keys = distinct.select("place", F.posexplode("halves").alias("which", "half"))
        common = keys.groupBy("half").count().where("count > 1").select("half")
        lines = keys.join(common, "half", "left_semi").groupBy("place").agg(F.collect_set("which").alias("shared"))
    wanted = lines.groupBy("place.doc_key").agg(F.collect_list(F.struct("place", "shared")).alias("lines"))

    schema = "ref binary, doc_id long, doc_key binary, line int, shared array<int>, words binary"
    arrow = pa.schema([("ref", pa.binary()), ("doc_id", pa.int64()), ("doc_key", pa.binary()), ("line", pa.int32()), ("shared", pa.list_(pa.int32())), ("words", pa.binary())])

    def texts(rows: Iterator[tuple]) -> Iterator[tuple]:
        for text, lines in rows:
            own = text.split(b"\n")
            for x in lines:
                p = x["place"]
                ref = xxhash.xxh3_128_digest(p["doc_key"] + b"%d" % p["line"])
                yield ref, p["doc_id"], p["doc_key"], p["line"], x["shared"], b" ".join(line_words(own[p["line"]]))

    # Joined by sorting at any size: a broadcast side would grow with the corpus.
    rows = docs.select(row_key(id_col, text_col).alias("doc_key"), text_bytes(text_col).alias("text")).join(durable(wanted).hint("merge"), "doc_key").select("text", "lines")
    kept = durable(rows.mapInArrow(lambda b: _batches(texts(rows_of(b, "text", "lines")), arrow), schema))

    keyed = pa.schema([("variant", pa.int64()), ("gaps", pa.list_(pa.int32())), ("bound", pa.int32()), ("ref", pa.binary())])

    def emit(rows: Iterator[tuple]) -> Iterator[tuple]:
        for ref, shared, words in rows:
            own = words.split()
            bound = min(edits, len(own) // an_edit)
            for variant, gaps in variants(own, shared, bound):
                yield variant, gaps, bound, ref

    emitted = durable(kept.mapInArrow(lambda b: _batches(emit(rows_of(b, "ref", "shared", "words")), keyed), "variant long, gaps array<int>, bound int, ref binary"))
    met = emitted.groupBy("variant").count().where("count > 1").select("variant")
    place = F.struct("doc_id", "doc_key", "line").alias("place")
    rows = emitted.join(met.hint("merge"), "variant").join(kept.select("ref", place), "ref")
    rows = durable(rows.drop("ref"))
    # Lines with the same variant and gaps are as long; two kinds of gaps are as far apart as words in either and not both.
    kinds = rows.groupBy("variant", "gaps").agg(F.min("place").alias("earliest"), F.first("bound").alias("bound"), F.count("*").alias("n"))
    if edits > 1:
        kinds = durable(kinds)
        other = kinds.select("variant", F.col("gaps").alias("their"), F.col("earliest").alias("earlier"), F.col("bound").alias("most"))
        apart = F.size("gaps") + F.size("their") - F.size(F.array_intersect("gaps", "their"))
        best = kinds.join(other, "variant").where(apart <= F.least("bound", "most")).groupBy("variant", "gaps").agg(F.min("earlier").alias("earlier"))
        pairs = rows.join(best, ["variant", "gaps"]).select("place", "earlier")
    else:  # the same gap, or the line itself and any gap
        itself = F.min(F.when(F.size("gaps") == 0, F.col("earliest")))
        longer = F.min(F.when(F.size("gaps") > 0, F.col("earliest")))
        by_variant = kinds.groupBy("variant").agg(itself.alias("itself"), longer.alias("longer")).where("itself is not null and longer is not null")
        same = rows.join(kinds.where((F.col("n") > 1) & (F.size("gaps") > 0)).select("variant", "gaps", F.col("earliest").alias("earlier")), ["variant", "gaps"])
        across = rows.join(by_variant, "variant").withColumn("earlier", F.when(F.size("gaps") == 0, F.col("longer")).otherwise(F.col("itself")))
        pairs = same.select("place", "earlier").unionByName(across.select("place", "earlier"))
    pairs = pairs.where("earlier < place").distinct()
    pairs = pairs.select(F.col("place.doc_key").alias("a_key"), F.col("place.line").alias("a_line"), F.col("earlier.doc_key").alias("b_key"), F.col("earlier.line").alias("b_line"))
    side = lambda s: kept.select(F.col("doc_key").alias(f"{s}_key"), F.col("line").alias(f"{s}_line"), F.col("words").alias(f"{s}_words"))
    pairs = pairs.join(side("a"), ["a_key", "a_line"]).join(side("b"), ["b_key", "b_line"])
    out = pa.schema([("doc_key", pa.binary()), ("line", pa.int32())])

    def check(rows: Iterator[tuple]) -> Iterator[tuple]:
        for key, line, a, b in rows:
            a, b = a.split(), b.split()
            if within(a, b, min(edits, min(len(a), len(b)) // an_edit)):
                yield key, line

    return pairs.mapInArrow(lambda b: _batches(check(rows_of(b, "a_key", "a_line", "a_words", "b_words")), out), "doc_key binary, line int").distinct()


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = 1, an_edit: int = 10) -> DataFrame:
    """A row for each document key that loses lines: doc_key, and the sorted numbers of its lines that are ``exact`` and ``near`` copies of earlier ones."""
    lines = durable(_lines(docs, id_col, text_col, an_edit))
    distinct = durable(
        lines.groupBy("key").agg(F.min(F.struct("doc_id", "doc_key", "line")).alias("place"), F.max("halves").alias("halves"), F.count("*").alias("n"))
    )
    near = settled(lambda: _near_lines(docs, distinct, id_col, text_col, edits, an_edit))
    first = distinct.where("n > 1").select("key", "place")
    repeats = lines.select("key", "doc_key", "line").join(first, "key").where("doc_key != place.doc_key or line != place.line")
    verdicts = repeats.select("doc_key", "line", F.lit(False).alias("near")).unionByName(near.withColumn("near", F.lit(True)))
    numbers = lambda c: F.array_sort(F.collect_set(F.when(c, F.col("line"))))
    return verdicts.groupBy("doc_key").agg(numbers(~F.col("near")).alias("exact"), numbers(F.col("near")).alias("near"))


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = 1, an_edit: int = 10) -> DataFrame:
    """A row for each document: n_lines, and its lines that are exact and near copies of earlier lines."""
    lost = settled(lambda: dropped_lines(docs, id_col, text_col, edits, an_edit))
    own = docs.select(F.col(id_col), row_key(id_col, text_col).alias("doc_key"), F.regexp_count(F.coalesce(text_col, F.lit("")), F.lit("\n")).alias("n_lines") + 1)
    none = F.array().cast("array<int>")
    return own.toDF(id_col, "doc_key", "n_lines").join(lost.hint("merge"), "doc_key", "left").select(
        id_col, F.col("n_lines").cast("long").alias("n_lines"), F.coalesce("exact", none).alias("exact"), F.coalesce("near", none).alias("near")
    )


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = 1, an_edit: int = 10) -> DataFrame:
    """docs with all their columns and without the dropped lines; a document goes if that leaves no words of those it had."""
    lost = settled(lambda: dropped_lines(docs, id_col, text_col, edits, an_edit))
    lost = lost.select("doc_key", F.array_union("exact", "near").alias("gone"))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), row_key(id_col, text_col).alias("doc_key")).join(lost.hint("merge"), "doc_key", "left")
    text = F.col(f"row.{text_col}")
    kept = F.array_join(F.filter(F.split(text, "\n"), lambda line, k: ~F.array_contains("gone", k)), "\n")
    rows = rows.withColumn("kept", F.when(F.col("gone").isNull(), text).otherwise(kept))
    rows = rows.where(F.col("gone").isNull() | F.col("kept").rlike(r"[^\x20\x09-\x0D]"))
    return rows.select(*(F.col("kept").alias(c) if c == text_col else F.col(f"row.`{c}`") for c in docs.columns))
