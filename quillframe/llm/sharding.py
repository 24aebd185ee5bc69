"""Sharding by histogram sort: shards of nearly equal bytes that never separate equal texts.

Rows get a 64-bit key: a hash of the text above, a hash of the id below, so that equal texts are neighbours and yet
spread. Rounds of probing count, exactly and over all partitions, the bytes below candidate boundaries and refine the
probes until each splitter is within ``tolerance`` of its target; then the rows are exchanged once. A group of equal
texts larger than the tolerance would upset a splitter, so such groups (at most 1 / tolerance of them) are placed
first, largest on the emptiest shard, and the splitters share out the rest. Inside a shard, ranges of keys that are
small enough for a task, cut through large groups too, are numbered from the exact counts of the rows before them.

Probing reads a scratch table of keys and sizes; the texts are read once. The driver holds probes and counts only.

Defined results: null texts have no bytes, size 1 and the checksum of nothing, and are grouped with empty ones;
repeated rows keep separate slots; an empty table gives no rows; fewer groups than shards leave shards empty; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillframe.llm._common import durable

LOW_BITS = 24
#: rows of a range at least, and ranges at most, by which tasks share the numbering
RANGE_ROWS, MOST_RANGES = 250, 1 << 14
PROBES = 64


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    group = F.shiftright(F.xxhash64(text), LOW_BITS)
    key = F.shiftleft(group, LOW_BITS).bitwiseOR(F.xxhash64(F.col(id_col)).bitwiseAND(F.lit((1 << LOW_BITS) - 1).cast("long")))
    rows = docs.select(F.col(id_col), text.alias("text"))
    return rows.select(id_col, (F.octet_length("text") + 1).cast("long").alias("size"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"), group.alias("group"), key.alias("key"))


def histogram(rows: DataFrame, probes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and rows in each interval that the sorted probes cut: [.., p0), [p0, p1) and so on; exact, over all partitions."""
    bins = len(probes) + 1
    arrow = pa.schema([("bin", pa.int32()), ("bytes", pa.int64()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, n = np.zeros(bins, np.int64), np.zeros(bins, np.int64)
        for batch in batches:
            at = np.searchsorted(probes, batch.column("key").to_numpy(), side="right")
            np.add.at(size, at, batch.column("size").to_numpy())
            n += np.bincount(at, minlength=bins)
        full = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(size[full]), pa.array(n[full])], schema=arrow)

    parts = rows.select("key", "size").mapInArrow(count, "bin int, bytes long, n long")
    size, n = np.zeros(bins, np.int64), np.zeros(bins, np.int64)
    for r in parts.groupBy("bin").agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n")).collect():
        size[r.bin], n[r.bin] = r.bytes, r.n
    return size, n


def splitters(rows: DataFrame, targets: list[int], tolerance: int) -> np.ndarray:
    """For each target, the first key of a group such that the bytes of all smaller keys are within tolerance of it, or as near as groups allow."""
    step = 1 << LOW_BITS
    low, high = np.full(len(targets), -(1 << 63) >> LOW_BITS, np.int64), np.full(len(targets), (1 << 63) - 1 >> LOW_BITS, np.int64)
    best = low * step
    miss = np.array(targets, np.float64)  # below the smallest key lies nothing
    while (open_ := (high - low > 1) & (miss > tolerance)).any():
        probes = np.unique(np.concatenate([np.linspace(float(a), float(b), PROBES + 2)[1:-1].astype(np.int64).clip(a + 1, b - 1) for a, b in zip(low[open_], high[open_], strict=True)]))
        size, _ = histogram(rows, probes * step)
        below = np.cumsum(size)[:-1]
        for k in np.flatnonzero(open_):
            at = int(np.argmin(np.abs(below - targets[k])))
            if abs(below[at] - targets[k]) < miss[k]:
                best[k], miss[k] = probes[at] * step, abs(below[at] - targets[k])
            under = np.flatnonzero(below <= targets[k])
            over = np.flatnonzero(below > targets[k])
            if len(under):
                low[k] = max(low[k], probes[under[-1]])
            if len(over):
                high[k] = min(high[k], probes[over[0]])
    return best


def place_large(groups: list[tuple[int, int]], shards: int, total: int) -> tuple[dict[int, int], list[int]]:
    """Group -> shard for large groups, and the bytes left for each shard to fill."""
    load, at = [0] * shards, {}
    for size, group in sorted(((s, g) for g, s in groups), reverse=True):
        k = min(range(shards), key=lambda i: (load[i], i))
        at[group], load[k] = k, load[k] + size
    rest, open_ = total - sum(load), sorted(range(shards), key=lambda i: load[i])
    while open_ and (rest + sum(load[i] for i in open_)) / len(open_) < load[open_[-1]]:  # fuller than its share already
        open_.pop()
    level = (rest + sum(load[i] for i in open_)) / max(1, len(open_))
    return at, [int(level - load[i]) if i in open_ else 0 for i in range(shards)]


def shards_by_bytes(docs: DataFrame, shards: int = 8, tolerance: float = 0.002, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, size, text_crc32, shard and slot; sizes within about ``tolerance`` of a shard's even share where groups allow."""
    rows = durable(keyed(docs, id_col, text_col))
    total, n_rows = (x or 0 for x in rows.agg(F.sum("size"), F.count("*")).first())
    most = max(1, int(total / shards * tolerance))
    large = rows.groupBy("group").agg(F.sum("size").alias("size"), F.count("*").alias("n")).where(F.col("size") > most).collect()
    placed, room = place_large([(r.group, r.size) for r in large], shards, total)
    light = rows.where(~F.col("group").isin(sorted(placed))) if placed else rows  # a hash set, at most shards / tolerance groups
    cuts = np.sort(splitters(light, np.cumsum(room)[:-1].tolist(), most))
    # candidate ranges of keys: even cuts through the whole, and through each large group
    step = 1 << LOW_BITS
    wanted = max(RANGE_ROWS, n_rows // MOST_RANGES)
    edges = np.linspace(-(2.0**63), 2.0**63, max(4096, min(4 * n_rows // wanted, 1 << 16)), endpoint=False)[1:].astype(np.int64)
    inner = [np.linspace(0, step, int(4 * r.n // wanted + 16), endpoint=False).astype(np.int64) + r.group * step for r in large]
    after = [np.array([(r.group + 1) * step], np.int64) for r in large if r.group + 1 < (1 << 63) >> LOW_BITS]
    edges = np.unique(np.concatenate([edges, cuts, *inner, *after]))
    firsts = np.concatenate(([-(1 << 63)], edges)).astype(np.int64)
    owner = np.searchsorted(cuts, firsts, side="right")
    for k, group in enumerate(firsts >> LOW_BITS):
        if int(group) in placed:
            owner[k] = placed[int(group)]
    _, n = histogram(rows, edges)
    # neighbours of one shard become a range until it has the wanted rows, so that tasks get even shares
    heads = [0]
    held = n[0]
    for k in range(1, len(firsts)):
        if owner[k] != owner[heads[-1]] or held + n[k] > wanted:
            heads.append(k)
            held = 0
        held += n[k]
    n, owner, edges = np.add.reduceat(n, heads), owner[heads], firsts[heads][1:]
    base, so_far = np.zeros(len(heads), np.int64), np.zeros(shards, np.int64)
    for k in range(len(heads)):
        base[k], so_far[owner[k]] = so_far[owner[k]], so_far[owner[k]] + n[k]

    arrow = pa.schema([("range", pa.int32()), ("base", pa.int64()), ("shard", pa.int32())])
    kept = [f for f in rows.schema if f.name != "group"]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.searchsorted(edges, batch.column("key").to_numpy(), side="right")
            new = [pa.array(at, pa.int32()), pa.array(base[at]), pa.array(owner[at], pa.int32())]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), *new], names=[*(f.name for f in kept), *arrow.names])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "range int, base long, shard int"])
    dealt = rows.drop("group").mapInArrow(deal, schema)
    place = F.row_number().over(Window.partitionBy("range").orderBy("key", id_col, "size"))
    return dealt.select(id_col, "size", "text_crc32", "shard", (F.col("base") + place - 1).alias("slot"))
