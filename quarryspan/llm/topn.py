"""The N best rows of every group, with ties resolved by a key.

Histograms of the scores by group give the highest bin above which at least N different rows lie; rows
below that threshold cannot be among the best and are dropped. First each batch of a scan does so by itself, with the
histogram of the rows it sees, before anything is shuffled; of groups that are still large, one histogram over all that is left
gives the threshold. Only then rows are shuffled and ranked exactly, large groups in salted parts first.

A bin counts different tie keys by a bitmap of their hashes, so a repeated row never stands for two, and bitmaps
of parts add up; as two keys may share a bit, a threshold is lower than it could be at times, and never too high.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarryspan.session import cut

#: Bins for each e-fold of the score; groups are large with 1 / HOT of all rows left (so at most HOT groups are); parts of a large group.
BINS, HOT, SALTS = 64, 1000, 64


def _bin(s: Column) -> Column:
    """A number that never falls as the score rises, whatever its scale: no lowest or highest score has to be known."""
    bounded = F.least(F.log1p(F.abs(s)), F.lit(1000.0))  # of an infinite score, too
    return F.floor(F.signum(s) * bounded * BINS).cast("int")


def _thresholds(codes: np.ndarray, bins: np.ndarray, slots: np.ndarray, width: int, groups: int, n: int) -> np.ndarray:
    """For each group the highest bin such that it and those above have n different slots; the lowest number if they have fewer."""
    key = codes * width + slots
    order = np.lexsort((-bins, key))
    first = order[np.concatenate([[True], key[order][1:] != key[order][:-1]])]  # the highest bin of each slot of a group
    first = first[np.lexsort((-bins[first], codes[first]))]
    own = codes[first]
    begins = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    place = np.arange(len(own)) - np.repeat(begins, np.diff(np.append(begins, len(own))))
    edge = np.full(groups, np.iinfo(np.int32).min, dtype=np.int64)
    edge[own[place == n - 1]] = bins[first[place == n - 1]]
    return edge


def _pruned(width: int, n: int, groups: int):
    """Batches (group.., tie, s, bin, slot) without the rows below the thresholds of their own histograms."""

    def over(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            if not part.num_rows:
                continue
            codes = np.zeros(part.num_rows, dtype=np.int64)
            for c in part.columns[:groups]:
                coded = c.dictionary_encode(null_encoding="encode")
                codes = codes * len(coded.dictionary) + coded.indices.to_numpy()
                codes = np.unique(codes, return_inverse=True)[1]
            bins, slots = part.column(groups + 2).to_numpy().astype(np.int64), part.column(groups + 3).to_numpy().astype(np.int64)
            edge = _thresholds(codes, bins, slots, width, int(codes.max()) + 1, n)
            yield part.filter(pa.array(bins >= edge[codes]))

    return over


def top_n(df: DataFrame, group: list[str], score: str, tie: str, n: int, hot: int = HOT) -> DataFrame:
    """Columns group.., rank_no (from 1), tie: the n rows of each group with the highest score.

    Equal scores rank by the smaller tie key; rows with one group and tie key count once, with their
    highest score. Null and NaN scores take no part; infinite ones do. Groups with fewer rows
    give all of them; an empty table gives none. A null group key is a group like any other.
    """
    s = F.col(score).cast("double")
    width = 64 * max(1, -(-n // 16))  # several slots for each row that is wanted
    keys, words = [f"_g{i}" for i in range(len(group))], range(width // 64)
    rows = df.select(*[F.col(c).alias(k) for c, k in zip(group, keys)], F.col(tie).alias("_tie"), s.alias("_s")).where(F.col("_s").isNotNull() & ~F.isnan("_s"))
    rows = rows.select("*", _bin(F.col("_s")).alias("_bin"), F.pmod(F.xxhash64("_tie"), F.lit(width)).cast("int").alias("_slot"))
    rows = cut(rows.mapInArrow(_pruned(width, n, len(group)), rows.schema))

    # at most `hot` groups have more than total / hot rows
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("_size"))
    large = cut(sizes.where(F.col("_size") > max(n, rows.count() // hot)))

    def same(other: list[str]) -> Column:
        on = F.lit(True)
        for k, o in zip(keys, other):
            on = on & F.col(k).eqNullSafe(F.col(o))
        return on

    names = [f"_h{i}" for i in range(len(keys))]
    large = large.select(*[F.col(k).alias(o) for k, o in zip(keys, names)])
    bits = [F.bit_or(F.when(F.floor(F.col("_slot") / 64) == w, F.expr("shiftleft(1L, _slot % 64)")).otherwise(F.lit(0).cast("long"))).alias(f"_b{w}") for w in words]
    counts = rows.join(F.broadcast(large), same(names), "left_semi").groupBy(*keys, "_bin").agg(*bits)
    above = Window.partitionBy(*keys).orderBy(F.desc("_bin")).rowsBetween(Window.unboundedPreceding, 0)
    seen = F.lit(0)
    for w in words:
        seen = seen + F.bit_count(F.bit_or(f"_b{w}").over(above))
    edges = counts.withColumn("_seen", seen).groupBy(*keys).agg(F.coalesce(F.max(F.when(F.col("_seen") >= n, F.col("_bin"))), F.lit(-(1 << 31))).alias("_edge"))
    edges = F.broadcast(edges.select(*[F.col(k).alias(o) for k, o in zip(keys, names)], "_edge"))

    rows = rows.join(edges, same(names), "left").where(F.col("_edge").isNull() | (F.col("_bin") >= F.col("_edge")))
    best = [F.desc("_s"), F.asc("_tie")]

    def ranked(part: DataFrame, by: list) -> DataFrame:
        """The first n different tie keys by some columns, each with its highest score."""
        once = F.row_number().over(Window.partitionBy(*by, "_tie").orderBy(F.desc("_s")))
        return part.withColumn("_o", once).where("_o = 1").withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*best))).where(F.col("_r") <= n)

    # a hash partitioning by group serves both windows, so rows are shuffled once
    parts = ranked(rows.where("_edge IS NOT NULL").withColumn("_salt", F.pmod(F.xxhash64("_tie"), F.lit(SALTS))).repartition(*keys, "_salt"), [*keys, "_salt"])
    rest = rows.where("_edge IS NULL").select(*keys, "_tie", "_s").unionByName(parts.select(*keys, "_tie", "_s")).repartition(*keys)
    return ranked(rest, keys).select(*[F.col(k).alias(c) for k, c in zip(keys, group)], F.col("_r").alias("rank_no"), F.col("_tie").alias(tie))
