"""Near-duplicate documents by order min-hash.

A text is its words (as in ``decontaminate``); its k-mers are five consecutive words, each labelled with its occurrence
number in the text. A sketch takes the ``TAKEN`` k-mers that are smallest under one of ``SKETCHES`` permutations and
retains their order in the text, so that equal sketches speak for edit similarity and not for shared words alone.
Documents that share a sketch are candidates. A pair is a link if a banded alignment of the words has an edit
similarity of ``SIMILAR`` or more and at least ``FLOOR`` of the labelled k-mers of either are common to both (Jaccard), which is
what some twelve edits a hundred words leave; classes are the connected components of links. A sketch is equal with a
chance of about the third power of the Jaccard index: a link is met in one of them with a chance of 0.65 at the floor,
0.96 at an index of 0.5 and 0.997 from 0.6 on, and its documents may also share a class by others. Pairs whose bags of
words alone are further apart than the bound, as those are that share a passage, are not aligned.

Equal word sequences are one document from the start. A bucket of up to ``BUCKET`` documents is searched inside one
task, which emits the links of a spanning forest. A larger bucket is split into chunks of that size, each joined by
the bucket's centre, and its members are bucketed again by this and the next sketch, and so on for
``DEPTH`` sketches; thus many members that do not resemble the centre still meet those that they resemble. What is left
then is settled exactly: each member that is not in the largest class of its centre's group is held against all of the
group, so that no two documents that share a sketch go without a comparison or a class in common.
Sets of documents that meet in several buckets are searched once, and what earlier links connect is not compared again.

Defined results: a text without words is in a class with rows of equal text only; null and empty texts are alone
(class: own id); a text of fewer than five words has its equals only; rows without id belong to the class of rows with
an id and the same words, if there is one, else their class is null. ``keep_one`` keeps one row of each class, with the
smallest id, and one of several rows that repeat an id and a text; rows without id and words stay. An empty table gives
no rows; other columns, whatever their names, are ignored by ``classes`` and kept by ``keep_one``.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillframe.llm._common import durable, row_key, rows_of, settled, text_bytes
from quillframe.llm.decontaminate import words_of
from quillframe.plans.components import connected_components

SHINGLE, SIMILAR, FLOOR = 5, 0.8, 0.35
SKETCHES, TAKEN = 24, 3
BUCKET, DEPTH = 48, 4
BLOCK = 4 << 20  # bytes of texts on either side of one exact search
CELLS = 1 << 20
FREQUENT, SHORT = 256, 2_048  # occurrences from which a word, and words up to which every word, has an integer of its places


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


SEEDS = mixed(np.arange(1, SKETCHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


class Words(defaultdict):
    """Word -> 64-bit hash, computed once."""

    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def word_hashes(words: list[bytes], known: Words) -> np.ndarray:
    if len(known) > 1_000_000:
        known.clear()
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def kmers(hashes: np.ndarray) -> np.ndarray:
    """Hashes of the occurrence-labelled k-mers, in text order."""
    n = len(hashes) - SHINGLE + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + n]
    return labelled_hashes(mixed(out))


def labelled_hashes(out: np.ndarray) -> np.ndarray:
    """Hashes of which no two are equal: the second and further occurrences of one are told apart by their number."""
    n = len(out)
    order = np.argsort(out, kind="stable")
    ranked = out[order]
    new = np.concatenate(([True], ranked[1:] != ranked[:-1]))
    if new.all():
        return out
    at = np.arange(n)
    label = np.zeros(n, np.uint64)
    label[order] = (at - np.maximum.accumulate(np.where(new, at, 0))).astype(np.uint64)
    return np.where(label > 0, mixed(out + label * np.uint64(0xD6E8FEB86659FD93)), out)


def sketches(marks: np.ndarray) -> np.ndarray:
    """One 64-bit sketch for each seed: the smallest k-mers under its permutation, in text order."""
    n = len(marks)
    if not n:
        return np.zeros(0, np.int64)
    taken = min(TAKEN, n)
    chosen = []
    step = max(1, CELLS // n)
    for at in range(0, SKETCHES, step):
        x = (marks[None, :] ^ SEEDS[at : at + step, None]) * np.uint64(0xFF51AFD7ED558CCD)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xC4CEB9FE1A85EC53)
        chosen.append(np.argpartition(x, taken - 1, axis=1)[:, :taken] if taken < n else np.tile(np.arange(n), (len(x), 1)))
    picked = marks[np.sort(np.concatenate(chosen), axis=1)]
    out = SEEDS.copy()
    for k in range(taken):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + picked[:, k])
    return out.view(np.int64)


def sum_of_bits(places: list[int]) -> int:
    """The integer that has these bits."""
    if len(places) < 3:
        return sum(1 << k for k in places)
    out = bytearray((max(places) >> 3) + 1)
    for k in places:
        out[k >> 3] |= 1 << (k & 7)
    return int.from_bytes(out, "little")


def banded_distance(a: list[int], b: list[int], most: int) -> int:
    """The edit distance of two sequences if it is at most ``most``, else most + 1.

    Bit-parallel alignment inside a band of diagonals: row j of the matrix keeps the vertical differences of its
    2 * most + 1 cells around the diagonal in two integers (Hyyrö, 2003).
    """
    if len(a) < len(b):
        a, b = b, a
    n, m = len(a), len(b)
    if n - m > most:
        return most + 1
    width = 2 * most + 1
    mask = (1 << width) - 1
    places: dict[int, list[int]] = defaultdict(list)
    for i, x in enumerate(a):
        places[x].append(i)
    # A frequent word has one integer of all its places; a rare one's are put into the band when it comes up, as an
    # integer of n bits for each of n words would take quadratic memory.
    often = {x: sum_of_bits(at) << most for x, at in places.items() if len(at) > FREQUENT or n <= SHORT}

    def band(x: int, j: int) -> int:
        """The places of a word in row j's band: bit k is place j - most + k."""
        if x in often:
            return often[x] >> j & mask
        at = places.get(x, ())
        return sum_of_bits([i - j + most for i in at[bisect_left(at, j - most) : bisect_right(at, j + most)]])

    # Bit k of row j's band is a's cell j - most + k; plus: it is one above its upper neighbour, minus: one below.
    plus, minus, distance = mask >> most << most, 0, 0
    for j in range(m):
        eq = band(b[j], j)
        d0 = (((eq & plus) + plus) ^ plus | eq | minus) & mask
        hp = (minus | ~(d0 | plus)) & mask
        hn = d0 & plus
        distance += not d0 >> most & 1
        plus = (hn | ~(d0 >> 1 | hp)) & mask
        minus = d0 >> 1 & hp
    for k in range(n - m):  # the diagonal has reached row m; the last column goes on to a's end
        distance += (plus >> most + k & 1) - (minus >> most + k & 1)
    return min(distance, most + 1)


def edit_distance(a: list[int], b: list[int], most: int) -> int:
    """banded_distance between the ends that differ, in bands that double until one holds the alignment."""
    head = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    a, b = a[head:], b[head:]
    tail = next((k for k, (x, y) in enumerate(zip(reversed(a), reversed(b))) if x != y), min(len(a), len(b)))
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    band = max(64, abs(len(a) - len(b)) * 2)  # a wider band costs little up to a few machine words
    while band < most:
        if (found := banded_distance(a, b, band)) <= band:
            return found
        band *= 2
    return banded_distance(a, b, most)


class Text:
    """A text's words and sorted k-mers, for comparisons."""

    def __init__(self, text: bytes, known: Words):
        self.words = word_hashes(words_of(text), known)
        self.marks = np.sort(kmers(self.words))
        self._bag: np.ndarray | None = None

    @property
    def bag(self) -> np.ndarray:
        """The sorted words, occurrences told apart."""
        if self._bag is None:
            self._bag = np.sort(labelled_hashes(self.words))
        return self._bag

    def like(self, other: Text) -> bool:
        n, m = len(self.marks), len(other.marks)
        longest = max(len(self.words), len(other.words))
        most = int((1 - SIMILAR) * longest + 1e-9)
        if longest - min(len(self.words), len(other.words)) > most:
            return False
        common = in_common(self.marks, other.marks)
        if common < FLOOR * (n + m - common) or longest - in_common(self.bag, other.bag) > most:
            return False
        return edit_distance(self.words.tolist(), other.words.tolist(), most) <= most


def in_common(a: np.ndarray, b: np.ndarray) -> int:
    """How many numbers two sorted arrays without repeats share."""
    both = np.concatenate((a, b))
    both.sort(kind="stable")
    return int((both[1:] == both[:-1]).sum())


class Owners:
    """An inverted index of sorted arrays: how many numbers of an array each of them shares."""

    def __init__(self, arrays: list[np.ndarray]):
        self.n = len(arrays)
        values = np.concatenate(arrays)
        order = np.argsort(values, kind="stable")
        self.values, self.owner = values[order], np.repeat(np.arange(self.n), [len(a) for a in arrays])[order]

    def common(self, asked: np.ndarray) -> np.ndarray:
        low, high = np.searchsorted(self.values, asked, "left"), np.searchsorted(self.values, asked, "right")
        met = [self.owner[x:y] for x, y in zip(low.tolist(), high.tolist(), strict=True) if x < y]
        return np.bincount(np.concatenate(met), minlength=self.n) if met else np.zeros(self.n, np.int64)


def forest(texts: list[Text], classes: list[int]) -> list[tuple[int, int]]:
    """Links that, with those which made ``classes``, span the documents' components.

    Pairs already connected need no link of their own; every other pair is compared.
    """
    first: dict[int, int] = {}
    root = [first.setdefault(c, k) for k, c in enumerate(classes)]

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = k = root[root[k]]
        return k

    links = []
    for k in range(1, len(texts)):
        for other in range(k):
            if find(other) != find(k) and texts[other].like(texts[k]):
                links.append((other, k))
                root[find(k)] = find(other)
    return links


def crossing(asks: list[Text], members: list[Text], classes: list[int], ask_classes: list[int]) -> list[tuple[int, int]]:
    """Links (ask, member) between documents of different classes that, with those which made the classes, connect what such pairs connect.

    Common k-mers, and where these are enough for many members common words, are counted by inverted indexes, so only
    pairs with enough of both are aligned.
    """
    sizes, lengths = (np.array([len(x) for x in xs]) for xs in ([t.marks for t in members], [t.words for t in members]))
    marks, bags = Owners([t.marks for t in members]), None
    root: dict[int, int] = {}

    def find(c: int) -> int:
        while (up := root.get(c, c)) != c:
            c = up
        return c

    links = []
    for k, ask in enumerate(asks):
        common = marks.common(ask.marks)
        longest = np.maximum(lengths, len(ask.words))
        others = np.flatnonzero((common > 0) & (common >= FLOOR * (sizes + len(ask.marks) - common)) & (np.minimum(lengths, len(ask.words)) >= SIMILAR * longest - 1e-6))
        if len(others) > 32:
            bags = bags or Owners([t.bag for t in members])
            others = others[longest[others] - bags.common(ask.bag)[others] <= (1 - SIMILAR) * longest[others] + 1e-6]
        for other in others.tolist():
            a, b = find(ask_classes[k]), find(classes[other])
            if a != b and members[other].like(ask):
                links.append((k, other))
                root[max(a, b)] = min(a, b)
    return links


def sketched(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: doc_id, key (of id and text), exact (a 128-bit key of its words, null for an empty text) and its sketches."""
    arrow = pa.schema([("doc_id", pa.int64()), ("key", pa.binary()), ("exact", pa.binary()), ("sketch", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, out = Words(), []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

        for doc, key, text in rows_of(batches, "id", "key", "text"):
            words = words_of(text)
            exact = xxhash.xxh3_128_digest(b" ".join(words) if words else b"\0" + text) if text else None
            out.append((doc, key, exact, sketches(kmers(word_hashes(words, known)))))
            if len(out) == 5_000:
                yield batch()
                out.clear()
        if out:
            yield batch()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), row_key(id_col, text_col).alias("key"), text_bytes(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, key binary, exact binary, sketch array<long>")


def buckets(unique: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What shares sketches among the documents of ``unique`` (doc_id, sketch).

    (depth, docs): the members of each small bucket; (depth, centre, doc_id): each other member of a large one and its
    centre. That is the document in most large buckets, as what a group was copied from is in more of them than any
    copy; of several the smallest.
    """
    own = lambda k: F.get("sketch", F.lit(k) if isinstance(k, int) else k)
    members = unique.where(F.size("sketch") > 0).select("doc_id", "sketch", F.explode(F.sequence(F.lit(0), F.lit(SKETCHES - 1))).alias("at"))
    members = members.withColumn("level1", F.xxhash64("at", own(F.col("at"))))
    for depth in range(1, DEPTH):  # a bucket of a level is told by its path of sketches
        members = members.withColumn(f"level{depth + 1}", F.xxhash64(f"level{depth}", own((F.col("at") + depth) % SKETCHES)))
    members = members.drop("sketch", "at")
    small, large = [], []
    for depth in range(1, DEPTH + 1):
        members = members.withColumnRenamed(f"level{depth}", "bucket")
        sizes = members.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
        found = durable(members.join(sizes, "bucket"))
        docs = found.where(F.col("n") <= BUCKET).groupBy("bucket").agg(F.array_sort(F.collect_set("doc_id")).alias("docs"))
        small.append(docs.groupBy("docs").agg(F.lit(depth).alias("depth")))
        hot = found.where(F.col("n") > BUCKET)
        often = hot.select("bucket", "doc_id", F.count("*").over(Window.partitionBy("doc_id")).alias("times"))
        centres = often.groupBy("bucket").agg((-F.max(F.struct("times", (-F.col("doc_id")).alias("id")))["id"]).alias("centre"))
        large.append(hot.select("bucket", "doc_id").join(centres, "bucket").where("doc_id != centre").select(F.lit(depth).alias("depth"), "centre", "doc_id"))
        if depth == DEPTH or hot.isEmpty():
            break
        members = hot.drop("bucket", "n")
    sets, pairs = small[0], large[0]
    for more_sets, more_pairs in zip(small[1:], large[1:], strict=True):
        sets, pairs = sets.unionByName(more_sets), pairs.unionByName(more_pairs)
    sets = sets.groupBy("docs").agg(F.min("depth").alias("depth"))
    pairs = pairs.groupBy("centre", "doc_id").agg(F.min("depth").alias("depth"), F.count("*").alias("times"))
    return durable(sets), durable(pairs)


def chunked(pairs: DataFrame) -> DataFrame:
    """(set, doc_id): the partners of each ``centre`` in sets of about BUCKET, each with that document."""
    chunks = pairs.groupBy("centre").agg(F.ceil(F.count("*") / BUCKET).alias("chunks"))
    chunk = F.pmod(F.xxhash64("doc_id"), F.col("chunks"))
    dealt = pairs.join(chunks, "centre").select(F.xxhash64("centre", chunk).alias("set"), "doc_id")
    centres = chunks.select("centre", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"))
    return dealt.unionAll(centres.select(F.xxhash64("centre", "chunk").alias("set"), F.col("centre").alias("doc_id")))


def exploded(sets: DataFrame) -> DataFrame:
    return sets.select(F.xxhash64("docs").alias("set"), F.explode("docs").alias("doc_id"))


def links(sets: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b): verified links inside the sets (set, doc_id), a spanning forest of each; texts: doc_id, text, class."""
    arrow = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def search(group: pa.Table) -> pa.Table:
        group = group.sort_by("doc_id")
        known, ids = Words(), group.column("doc_id").to_pylist()
        found = forest([Text(t, known) for t in group.column("text").to_pylist()], group.column("class").to_pylist())
        return pa.Table.from_arrays([pa.array([ids[x] for x, _ in found], pa.int64()), pa.array([ids[y] for _, y in found], pa.int64())], schema=arrow)

    return durable(texts.join(sets.distinct(), "doc_id").select("set", "doc_id", "text", "class").groupBy("set").applyInArrow(search, "a long, b long"))


def labelled(rows: DataFrame, classed: DataFrame) -> DataFrame:
    """rows with the class of each doc_id: its component, or itself."""
    return rows.join(classed.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("class", F.coalesce("component", "doc_id")).drop("component")


def remainder(pairs: DataFrame, texts: DataFrame, classed: DataFrame) -> DataFrame:
    """(a, b): links between the classes of each centre's group, by comparing what is not in its largest class with all of it.

    The group of a centre is the union of its large buckets. Both sides of the comparison are cut into blocks of about
    BLOCK bytes, so no task grows with a group; where all of a group is in one class, as copies mostly are, there is none.
    """
    arrow = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    group = pairs.where("depth = 1").select("centre", "doc_id")
    group = labelled(group.unionAll(group.select("centre", F.col("centre").alias("doc_id")).distinct()), classed)
    largest = group.groupBy("centre", "class").agg(F.count("*").alias("n")).groupBy("centre")
    largest = largest.agg(F.max_by("class", F.struct("n", "class")).alias("largest"), F.count("*").alias("classes")).where("classes > 1")
    group = durable(group.join(largest.select("centre", "largest"), "centre").withColumn("asks", F.col("class") != F.col("largest")))
    if group.isEmpty():
        return texts.sparkSession.createDataFrame([], "a long, b long")
    group = group.join(texts.select("doc_id", F.length("text").alias("bytes")), "doc_id")
    blocks = group.groupBy("centre").agg(*(F.ceil((F.sum(v) + 1) / BLOCK).alias(n) for n, v in (("rows", F.col("bytes")), ("columns", F.when(F.col("asks"), F.col("bytes")).otherwise(0)))))
    group = group.join(blocks, "centre")
    own = lambda n: F.pmod(F.xxhash64("doc_id"), F.col(n))
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    sides = group.select("centre", own("rows").alias("row"), upto("columns").alias("column"), "doc_id", "class", F.lit(False).alias("ask"))
    sides = sides.unionAll(group.where("asks").select("centre", upto("rows").alias("row"), own("columns").alias("column"), "doc_id", "class", F.lit(True).alias("ask")))

    def search(block: pa.Table) -> pa.Table:
        found, known = [], Words()
        rows = block.sort_by("doc_id").select(["ask", "doc_id", "class", "text"]).to_pylist()
        asks, members = ([r for r in rows if r["ask"] == side] for side in (True, False))
        if asks and members:
            made = [[Text(r.pop("text"), known) for r in side] for side in (asks, members)]
            found = crossing(*made, [r["class"] for r in members], [r["class"] for r in asks])
        ends = [asks[k]["doc_id"] for k, _ in found], [members[k]["doc_id"] for _, k in found]
        return pa.Table.from_arrays([pa.array(e, pa.int64()) for e in ends], schema=arrow)

    return durable(sides.join(texts.select("doc_id", "text"), "doc_id").groupBy("centre", "row", "column").applyInArrow(search, "a long, b long"))


def near_links(docs: DataFrame, unique: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(a, b): links that connect every class of the documents of ``unique`` (doc_id, sketch).

    First the small buckets of one sketch are searched, and each member of large ones meets the document it meets most
    often; then everything that these links have not put in one class yet; at last the exact remainder of large ones.
    """
    sets, pairs = buckets(unique)
    wanted = sets.select(F.explode("docs").alias("doc_id")).unionAll(pairs.select("doc_id")).unionAll(pairs.select("centre")).distinct()
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("text"))
    texts = durable(texts.join(wanted.hint("merge"), "doc_id"))  # the same plan at any size: a broadcast would grow with the corpus
    most = pairs.groupBy("doc_id").agg(F.max(F.struct("times", (-F.col("centre")).alias("other"))).alias("most"))
    first = exploded(sets.where("depth = 1")).unionAll(chunked(most.select((-F.col("most.other")).alias("centre"), "doc_id")))
    found = links(first, texts.withColumn("class", F.col("doc_id")))
    classed = connected_components(found)
    label = lambda c: classed.select(F.col("node").alias(c), F.col("component").alias(f"{c}_class"))
    rest = pairs.join(label("centre"), "centre", "left").join(label("doc_id"), "doc_id", "left")
    rest = rest.where(F.coalesce("centre_class", "centre") != F.coalesce("doc_id_class", "doc_id")).select("centre", "doc_id")
    members = exploded(sets.where("depth > 1")).join(label("doc_id"), "doc_id", "left").select("set", "doc_id", F.coalesce("doc_id_class", "doc_id").alias("class"))
    mixed_sets = members.groupBy("set").agg(F.min("class").alias("a"), F.max("class").alias("b")).where("a != b").select("set")
    second = durable(chunked(durable(rest)).unionAll(members.join(mixed_sets, "set", "left_semi").select("set", "doc_id")))
    stars = lambda: classed.where("node != component").select(F.col("node").alias("a"), F.col("component").alias("b"))
    if not second.isEmpty():  # what is one class already takes part as a star, which needs no further rounds
        classed = connected_components(stars().unionAll(links(second, labelled(texts, classed))))
    return stars().unionAll(remainder(pairs, texts, classed))


def classed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: doc_id, key, exact and class_id, the smallest id of its class."""
    every = durable(sketched(docs, id_col, text_col))
    whole = every.where(F.col("doc_id").isNotNull() & F.col("exact").isNotNull())
    equal = durable(whole.groupBy("exact").agg(F.min_by("sketch", "doc_id").alias("sketch"), F.min("doc_id").alias("doc_id")))
    near = settled(lambda: connected_components(near_links(docs, equal.select("doc_id", "sketch"), id_col, text_col)))
    merged = equal.select("exact", F.col("doc_id").alias("node")).join(near, "node", "left").select("exact", F.coalesce("component", "node").alias("class_id"))
    return every.drop("sketch").join(merged, "exact", "left").withColumn("class_id", F.coalesce("class_id", "doc_id"))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: its id and class_id, the smallest id of its class."""
    return classed_rows(docs, id_col, text_col).select(F.col("doc_id").alias(id_col), "class_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class, with the smallest id and all its columns."""
    rows = settled(lambda: classed_rows(docs, id_col, text_col).where("doc_id is not null or exact is not null"))
    # a class is told by its id, or by the words of rows that have none
    group = F.struct("class_id", F.when(F.col("class_id").isNull(), F.col("exact")).when(F.col("exact").isNull(), F.lit(b"")).alias("exact"))
    keyed = rows.groupBy(group.alias("group"), "key").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key")
    first = keyed.groupBy("group").agg(F.min(place).alias("first"))
    judged = keyed.join(first, "group")
    gone = durable(judged.where((F.col("key") != F.col("first.key")) | (F.col("n") > 1)).select("key", (F.col("key") == F.col("first.key")).alias("again")))
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), row_key(id_col, text_col).alias("key"))
    out = packed.join(gone, "key", "left_anti").select("row.*")
    again = gone.where("again").select("key")
    if again.isEmpty():
        return out
    once = packed.join(again, "key").groupBy("key").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return out.unionByName(once.select("row.*"))
