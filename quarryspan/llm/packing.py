"""Filling containers of a fixed capacity with items of varying length.

Only the number of items of each length matters for the plan, and there are at most `capacity`
lengths, so the plan is made from that histogram: exact complements first (one, two or three
lengths that fill the gap of a longer one exactly, from an index of sums, as often as the counts allow), then best fit for the rest.
The plan has patterns (which lengths share a container, and how many such containers); items then find
their container by their rank among the items of their length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarryspan.session import cut

#: Items of one length that one task numbers at most, in about.
BUCKET_ROWS = 200_000


@dataclass
class Plan:
    """Sorted intervals of ranks by length: container = base + (rank - first) // times."""

    sizes: np.ndarray
    first: np.ndarray
    base: np.ndarray
    times: np.ndarray
    containers: int

    def place(self, sizes: np.ndarray, ranks: np.ndarray) -> np.ndarray:
        """The container of each item, by its length and its rank (from 0) among items of that length."""
        span = int(max(self.first.max(initial=0), ranks.max(initial=0))) + 1
        at = np.searchsorted(self.sizes.astype(np.float64) * span + self.first, sizes.astype(np.float64) * span + ranks, side="right") - 1
        return self.base[at] + (ranks - self.first[at]) // self.times[at]


class Sums:
    """An index of the lengths whose sum fills a gap: single lengths, pairs by their sum, and triples by a length and the pairs' sums.

    left counts the items of each length that are not placed yet and only falls, so an entry that can't be served any more
    never comes back: it is dropped when it is met.
    """

    def __init__(self, left: np.ndarray) -> None:
        self.left = left
        self.lengths = (np.flatnonzero(left)[::-1]).tolist()  # the longest first
        self.by_sum: dict[int, list[int]] = {}  # the shorter length of each pair, the longest ones first

    def _pairs(self, total: int) -> list[int]:
        """The pairs with this sum as stack, the one with the shortest length on top."""
        found = self.by_sum.get(total)
        if found is None:
            low = np.flatnonzero(self.left[: total // 2 + 1])
            low = low[self.left[total - low] > 0]
            found = self.by_sum[total] = low[::-1].tolist()
        while found and (self.left[found[-1]] < 1 + (2 * found[-1] == total) or self.left[total - found[-1]] < 1):
            found.pop()
        return found

    def complement(self, gap: int) -> tuple[int, ...] | None:
        """One, two or three lengths that are there and fill the gap exactly; the longest first."""
        left = self.left
        if left[gap] > 0:
            return (gap,)
        pairs = self._pairs(gap)
        if pairs:
            return (gap - pairs[-1], pairs[-1])
        for a in self.lengths:
            rest = gap - a
            if rest < 2 or left[a] == 0:
                continue
            if rest > 2 * a:  # a is no more the longest of the three
                break
            for b in reversed(self._pairs(rest)):
                c = rest - b
                if c <= a and all(left[x] >= (a, b, c).count(x) for x in (a, b, c)):
                    return (a, c, b)
        return None


def plan(counts: dict[int, int], capacity: int) -> Plan:
    """The plan for so many items of each length from 1 to capacity."""
    left = np.zeros(capacity + 1, dtype=np.int64)
    for size, n in counts.items():
        if not 1 <= size <= capacity:
            raise ValueError(f"length {size} is not from 1 to {capacity}")
        left[size] = n
    patterns: list[tuple[tuple[int, ...], int]] = []
    sums = Sums(left)
    for size in range(capacity, 0, -1):
        while left[size] > 0:
            gap = capacity - size
            fill = () if gap == 0 else sums.complement(gap)
            if fill and left[size] < 1 + fill.count(size):
                fill = None  # the item itself isn't its own complement
            if fill is None:
                break
            pattern = (size, *fill)
            often = min(int(left[s]) // pattern.count(s) for s in set(pattern))
            for s in pattern:
                left[s] -= often
            patterns.append((pattern, often))
    # best fit: the smallest gap that takes the item; groups of containers with one pattern are one entry
    open_by_gap: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    gaps = np.zeros(capacity + 1, dtype=bool)

    def put(pattern: tuple[int, ...], n: int) -> None:
        gap = capacity - sum(pattern)
        open_by_gap.setdefault(gap, []).append((pattern, n))
        gaps[gap] = True

    for size in range(capacity, 0, -1):
        n = int(left[size])
        while n:
            fitting = np.flatnonzero(gaps[size:])
            if len(fitting):
                gap = size + int(fitting[0])
                pattern, m = open_by_gap[gap].pop()
                if not open_by_gap[gap]:
                    gaps[gap] = False
                used = min(m, n)
                if m > used:
                    put(pattern, m - used)
                put((*pattern, size), used)
                n -= used
            else:
                each = capacity // size
                if n >= each:
                    put((size,) * each, n // each)
                if n % each:
                    put((size,) * (n % each), 1)
                n = 0
    for entries in open_by_gap.values():
        patterns.extend(entries)
    rows, used_of, base = [], np.zeros(capacity + 1, dtype=np.int64), 0
    for pattern, n in patterns:
        for s in sorted(set(pattern)):
            times = pattern.count(s)
            rows.append((s, int(used_of[s]), base, times))
            used_of[s] += n * times
        base += n
    rows.sort()
    columns = [np.array([r[i] for r in rows], dtype=np.int64) for i in range(4)]
    return Plan(*columns, containers=base)


def pack(items: DataFrame, capacity: int, key: str = "doc_id", size: str = "tokens", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Rows (doc_id, part_no, start, tokens, container_id): where each item, or part of one, lies.

    An item longer than the capacity is split: full containers and a rest, which is packed like an
    item. Items of length 0 or null length are in no container (a null id). Every row is placed, repeated
    ones too; keys may tie only if the rows are alike.
    """
    rows = items.select(F.col(key).alias("doc_id"), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("n"))
    parts = F.greatest(F.lit(0), F.ceil(F.col("n") / capacity).cast("int") - 1)
    rows = cut(rows.withColumn("part_no", F.explode(F.sequence(F.lit(0), parts))).select(
        "doc_id", "part_no", (F.col("part_no").cast("long") * capacity).alias("start"), F.least(F.col("n") - F.col("part_no").cast("long") * capacity, F.lit(capacity)).cast("int").alias("tokens")))
    full = rows.where("tokens > 0")
    counts = {r["tokens"]: r["count"] for r in full.groupBy("tokens").count().collect()}  # at most `capacity` rows
    planned = plan(counts, capacity)
    buckets = max(1, max(counts.values(), default=0) // bucket_rows + 1)
    full = full.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "part_no"), F.lit(buckets)).cast("int"))
    before = Window.partitionBy("tokens").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = full.groupBy("tokens", "bucket").agg(F.count("*").alias("c")).withColumn("offset", F.coalesce(F.sum("c").over(before), F.lit(0))).drop("c")
    number = F.row_number().over(Window.partitionBy("tokens", "bucket").orderBy("doc_id", "part_no"))
    ranked = full.withColumn("r", number).join(offsets, ["tokens", "bucket"]).select("doc_id", "part_no", "start", "tokens", (F.col("offset") + F.col("r") - 1).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = planned.place(b.column(3).to_numpy(), b.column(4).to_numpy())
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(at, pa.int64())], ["doc_id", "part_no", "start", "tokens", "container_id"])

    kind = dict(rows.dtypes)["doc_id"]
    placed = ranked.mapInArrow(place, f"doc_id {kind}, part_no int, start long, tokens int, container_id long")
    return placed.unionByName(rows.where("tokens <= 0").select("doc_id", "part_no", "start", "tokens", F.lit(None).cast("long").alias("container_id")))


def fill_report(packed: DataFrame, capacity: int) -> DataFrame:
    """One row: containers, tokens, unused capacity and its share, and the least number of containers possible."""
    used = packed.where("container_id IS NOT NULL").agg(F.countDistinct("container_id").alias("containers"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))
    return used.select("containers", "tokens", (F.col("containers") * capacity - F.col("tokens")).alias("unused"), F.expr(f"coalesce(try_divide(containers * {capacity} - tokens, containers * {capacity}), 0)").alias("unused_share"), F.ceil(F.col("tokens") / capacity).alias("least_containers"))
