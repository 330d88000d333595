"""Best rows of groups, stable orders, greedy removal of duplicates."""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarryspan import dims
from quarryspan.session import cut


def best_rows(df: DataFrame, group: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each group in an order that ends in a unique column, with rank_no."""
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn("rank_no", rank).where(F.col("rank_no") <= n)


def numbered(df: DataFrame, group: list[str], order: list[Column], sums: dict[str, Column] | None = None) -> DataFrame:
    """Every row with rank_no, its place in its group, in an order that ends in a unique column; and running sums of whole numbers by name.

    No group has to fit into one task: rows are partitioned by ranges of group and order, numbered within
    each range, and each range of a group begins where those before it end. A null group key is a group like any other.
    """
    sums = sums or {}
    rows = df.select("*", *[c.cast("long").alias(f"_v_{n}") for n, c in sums.items()])
    rows = cut(rows.repartitionByRange(*group, *order)).withColumn("_part", F.spark_partition_id())
    counts = rows.groupBy(*group, "_part").agg(F.count("*").alias("_n_"), *[F.sum(f"_v_{n}").alias(f"_n_{n}") for n in sums])
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    keys = {c: f"_k{i}" for i, c in enumerate([*group, "_part"])}
    names = ["", *sums]
    counts = counts.select(*[F.col(c).alias(k) for c, k in keys.items()], *[F.coalesce(F.sum(f"_n_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in names])
    on = F.lit(True)
    for c, k in keys.items():
        on = on & F.col(c).eqNullSafe(F.col(k))
    within = Window.partitionBy(*group, "_part").orderBy(*order)
    so_far = within.rowsBetween(Window.unboundedPreceding, 0)
    out = rows.select("*", F.row_number().over(within).alias("_p_"), *[F.sum(f"_v_{n}").over(so_far).alias(f"_p_{n}") for n in sums]).join(counts, on)
    return out.select(*df.columns, *[(F.col(f"_p_{n}") + F.col(f"_b_{n}")).alias(n or "rank_no") for n in names])


def hit_order(df: DataFrame, group: list[str], label: Column, score: Column, arrival: str) -> DataFrame:
    """All hits of each group by the rank of their relevance label, then by score, ties in the order of arrival.

    An unknown or missing label ranks lowest; a missing score is 0, and so is NaN, which has no order.
    """
    clean = F.when(~F.isnan(score), score)
    rows = df.select(*group, arrival, case_rank(label, dims.RELEVANCE_RANK, 0).alias("_rank"), F.coalesce(clean, F.lit(0.0)).alias("_score"))
    return numbered(rows, group, [F.desc("_rank"), F.desc("_score"), F.asc(arrival)]).select(*group, "rank_no", arrival)


def case_rank(column: Column, ranks: dict[str, int], unknown: int = -1) -> Column:
    """A rank by value; unknown values have the rank given for them."""
    out = None
    clean = F.lower(F.trim(F.coalesce(column, F.lit(""))))
    for value, rank in ranks.items():
        out = F.when(clean == value, rank) if out is None else out.when(clean == value, rank)
    return out.otherwise(unknown)


def greedy_first(df: DataFrame, group: list[str], order: str, keys: list[str], cap: int | None = None) -> DataFrame:
    """Rows kept when, in order, a row is dropped that shares any key with a row kept before it.

    Only kept rows register their keys; an empty or null key never matches, and equal values of different keys don't match. The order is
    unique within a group. Sequential by its meaning, it is resolved in rounds without collecting any group: a row that comes
    first for all of its keys among the undecided ones is kept, what shares a key with a kept row is dropped, and the
    rest is asked again. A round decides at least the first row of every group; most rows are decided in the first two.
    A cap keeps the first so many of each group's kept rows.
    """
    columns = [*group, order, *keys]
    keyed = F.filter(F.array(*[F.when(F.col(k) != "", F.concat(F.lit(f"{i}:"), F.col(k))) for i, k in enumerate(keys)]), lambda k: k.isNotNull())
    rows = cut(df.select(*columns).distinct().withColumn("_keys", keyed))
    # a row has few keys: it is a link to each of them
    links = rows.where(F.size("_keys") > 0).select(*group, F.col(order).alias("_at"), F.explode("_keys").alias("_key"))
    links = cut(links.select(F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(g).cast("string"), F.lit("\x1e")) for g in group], "_key"), 256).alias("_key"), F.struct(*group, "_at").alias("_row")))
    kept = None
    while not links.isEmpty():
        first = links.groupBy("_key").agg(F.min("_row").alias("_first"))
        judged = links.join(first, "_key").groupBy("_row").agg(F.min(F.col("_row") == F.col("_first")).alias("_wins"))
        winners = cut(judged.where("_wins").select("_row"))
        kept = winners if kept is None else kept.unionByName(winners)
        taken = links.join(winners, "_row", "left_semi").select("_key").distinct()
        losers = links.join(taken, "_key", "left_semi").select("_row").distinct()
        links = cut(links.join(losers, "_row", "left_anti"))
    free = rows.where(F.size("_keys") == 0).select(*columns)
    if kept is not None:
        free = rows.where(F.size("_keys") > 0).withColumn("_row", F.struct(*group, F.col(order).alias("_at"))).join(kept, "_row", "left_semi").select(*columns).unionByName(free)
    return free if cap is None else best_rows(free, group, [F.asc(order)], cap).select(*columns)


def average_precision(df: DataFrame, group: list[str], score: Column, relevant: Column, accepted: Column, tie: str) -> DataFrame:
    """For each group: n, relevant, accepted, precision, recall, f1, p_at_k (k: the number of relevant ones), ap and rr.

    Places and running hits come by ranges of the order, so a group of any size is spread over tasks.
    """
    rows = df.select(*group, tie, score.alias("_score"), relevant.cast("int").alias("_rel"), accepted.cast("int").alias("_acc"))
    rows = numbered(rows, group, [F.desc_nulls_last("_score"), F.asc(tie)], {"_hits": F.col("_rel")})
    # the first k places hold as many relevant rows as the running sum says there, so no second pass over the rows is needed for k
    sums = rows.groupBy(*group).agg(F.count("*").alias("n"), F.sum("_rel").alias("relevant"), F.sum("_acc").alias("accepted"), F.sum(F.col("_rel") * F.col("_acc")).alias("hit"), F.sum(F.when(F.col("_rel") == 1, F.col("_hits") / F.col("rank_no"))).alias("prec_sum"), F.min(F.when(F.col("_rel") == 1, F.col("rank_no"))).alias("first"))
    at = {g: f"_q{i}" for i, g in enumerate(group)}
    on = F.col("rank_no") == F.col("_k")
    for g, q in at.items():
        on = on & F.col(g).eqNullSafe(F.col(q))
    wanted = sums.where("relevant > 0").select(*[F.col(g).alias(q) for g, q in at.items()], F.col("relevant").alias("_k"))
    top = rows.join(wanted, on).select(*at.values(), F.col("_hits").alias("top"))
    same = F.lit(True)
    for g, q in at.items():
        same = same & F.col(g).eqNullSafe(F.col(q))
    out = sums.join(top, same, "left").withColumn("top", F.coalesce("top", F.lit(0)))
    div = lambda a, b: F.coalesce(F.expr(f"try_divide({a}, {b})"), F.lit(0.0))
    out = out.select(*group, "n", "relevant", "accepted", div("hit", "accepted").alias("precision"), div("hit", "relevant").alias("recall"), div("top", "relevant").alias("p_at_k"), div("prec_sum", "relevant").alias("ap"), div("1.0", "first").alias("rr"))
    return out.withColumn("f1", F.coalesce(F.expr("try_divide(2 * precision * recall, precision + recall)"), F.lit(0.0)))


def cache_hits(df: DataFrame, cache: list[str], key: str, at: str, tie: str, seconds: float, entries: int | None = None) -> DataFrame:
    """df's cache.., key, tie, and cached: which requests, in the order of time and tie, a cache with expiry answers.

    An entry is stored when its request isn't answered, keeps that time however often it is used, and is valid
    for so many seconds after it. A cache holds so many entries, and the one goes that was stored or used longest
    ago; then its requests are sequential by their meaning and stream through one task in order, which holds only the entries. Without
    a capacity each key is for itself, and its requests stream through a task that holds one time. A null key is a key.
    """
    kind = dict(df.dtypes)
    names = [*cache, key, tie]
    own = len(cache)
    schema = ", ".join(f"`{c}` {kind[c]}" for c in names) + ", cached boolean"

    def replay(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held = None, OrderedDict()
        for part in parts:
            answers = []
            for row in part.itertuples(index=False, name=None):
                one, k, t = row[:own] if entries else row[:own + 1], row[own], row[-1]
                if one != now:
                    now, held = one, OrderedDict()
                fresh = k in held and t - held[k] <= seconds * 1e6
                if not fresh:
                    held[k] = t
                held.move_to_end(k)
                while entries and len(held) > entries:
                    held.popitem(last=False)
                answers.append(fresh)
            yield part.iloc[:, :-1].assign(cached=answers)

    rows = df.select(*names, F.unix_micros(F.col(at)).alias("_t"))
    order = [*cache, "_t", tie] if entries else [*cache, key, "_t", tie]
    return rows.repartition(*(cache if entries else [*cache, key])).sortWithinPartitions(*order).mapInPandas(replay, schema)


def keyed_hash(key: bytes, message: Column) -> Column:
    """HMAC-SHA-256 of a text or binary under a key, in hexadecimal digits: two digests over the padded key."""
    block = hashlib.sha256(key).digest() if len(key) > 64 else key
    block = block.ljust(64, b"\0")
    inner, outer = (F.unhex(F.lit(bytes(b ^ x for b in block).hex())) for x in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))), 256)
