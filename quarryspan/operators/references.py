"""References to records that do not exist, are deleted, or arrive later.

Keys are range-partitioned by a 64-bit hash that is even over its whole range, so that every
range holds about as many parents as any other. In a range the parents are one sorted array;
the references come in batches and are probed by vectorised binary search. A range with many
references (a hot key) is split by the reference's id: its few parents are copied to each part.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: References that one task probes at a time, and parents kept in one sorted array.
PART_ROWS, RANGE_PARENTS = 400_000, 200_000


@dataclass(frozen=True)
class Reference:
    """A column of a table that refers to the key of a parent table."""

    table: str
    rows: DataFrame
    key: str
    parent: str
    id: str = "id"
    created: str = "created_at"


def micros(column: Column) -> Column:
    """Microseconds of a timestamp, or of ISO 8601 text in any of its notations; null if unreadable."""
    return F.unix_micros(F.try_to_timestamp(column.cast("string")))


def _micros(df: DataFrame, name: str) -> Column:
    return F.unix_micros(F.col(name)) if dict(df.dtypes)[name] == "timestamp" else micros(F.col(name))


def _probe(parents: pa.Table, refs: pa.Table) -> pa.Table:
    hashes = refs["h"].to_numpy()
    table, ids = refs["table_name"], refs["id"].to_numpy()
    created = refs["created"].to_numpy(zero_copy_only=False)
    known = parents.sort_by([("h", "ascending")]) if parents.num_rows else parents
    ph = known["h"].to_numpy()
    at = np.searchsorted(ph, hashes)
    found = np.full(len(hashes), -1, dtype=np.int64)
    left = np.arange(len(hashes))
    while len(left) and len(ph):
        pos = at[left]
        inside = pos < len(ph)
        left, pos = left[inside], pos[inside]
        same = ph[pos] == hashes[left]
        left, pos = left[same], pos[same]
        if not len(left):
            break
        equal = pc.and_(pc.equal(refs["key"].take(pa.array(left)), known["key"].take(pa.array(pos))),
                        pc.equal(refs["parent"].take(pa.array(left)), known["parent"].take(pa.array(pos))))
        equal = equal.to_numpy(zero_copy_only=False).astype(bool)
        found[left[equal]] = pos[equal]
        left = left[~equal]  # two keys with one hash: look at the next of that hash
        at[left] += 1
    has = np.zeros(len(hashes), dtype=bool)
    gone = np.zeros(len(hashes), dtype=bool)
    first = np.full(len(hashes), np.nan)
    hit = found >= 0
    if hit.any():
        rows = pa.array(found[hit])
        has[hit] = known["has_row"].take(rows).to_numpy(zero_copy_only=False).astype(bool)
        gone[hit] = known["deleted"].take(rows).to_numpy(zero_copy_only=False).astype(bool)
        first[hit] = known["first"].take(rows).cast(pa.float64(), safe=False).to_numpy(zero_copy_only=False)
    with np.errstate(invalid="ignore"):
        late = has & (first > created.astype(float))
    kind = np.where(has, np.where(late, "late", ""), np.where(gone, "deleted", "missing"))
    keep = np.flatnonzero(kind != "")
    out = pa.table({"table_name": table.take(pa.array(keep)), "id": pa.array(ids[keep]), "kind": pa.array(kind[keep].astype(object), pa.string()), "created": refs["created"].take(pa.array(keep))})
    return out.group_by(["table_name", "id", "kind"]).aggregate([("created", "min")]).select(["table_name", "id", "kind", "created_min"]).rename_columns(["table_name", "id", "kind", "created"])


def orphan_references(references: list[Reference], parents: dict[str, tuple[DataFrame, str, str]], deleted: DataFrame | None = None, part_rows: int = PART_ROWS, range_parents: int = RANGE_PARENTS) -> DataFrame:
    """Rows (table_name, id, kind, created_at) of references without a parent row, or with a later one.

    parents: by name, its rows, key and creation columns. deleted: key_table, key_value.
    Null and empty keys refer to nothing. Rows delivered twice count once; so do repeated parents,
    of which the earliest counts. An unreadable time is never late. Empty tables give no rows; other
    columns of the tables are not read, whatever their names.
    """
    known = None
    for name, (rows, key, created) in parents.items():
        one = rows.select(F.lit(name).alias("parent"), F.col(key).alias("key"), _micros(rows, created).alias("first"), F.lit(True).alias("has_row"), F.lit(False).alias("deleted"))
        known = one if known is None else known.unionByName(one)
    if deleted is not None:
        known = known.unionByName(deleted.select(F.col("key_table").alias("parent"), F.col("key_value").alias("key"), F.lit(None).cast("long").alias("first"), F.lit(False).alias("has_row"), F.lit(True).alias("deleted")))
    known = known.where("key <> ''").groupBy("parent", "key").agg(F.min("first").alias("first"), F.max("has_row").alias("has_row"), F.max("deleted").alias("deleted"))
    refs = None
    for r in references:
        one = r.rows.select(F.lit(r.table).alias("table_name"), F.col(r.id).cast("long").alias("id"), F.lit(r.parent).alias("parent"), F.col(r.key).alias("key"), _micros(r.rows, r.created).alias("created"))
        refs = one if refs is None else refs.unionByName(one)
    refs = refs.where("key <> ''")
    hashed = F.xxhash64("parent", "key")
    # a range for so many parents; the count is one number, and the references' counts are one a range
    bits = max(3, int(np.ceil(np.log2(max(1, known.count()) / range_parents + 1))) + 3)
    in_range = F.shiftrightunsigned(F.col("h"), 64 - bits).cast("int")
    refs, known = (df.withColumn("h", hashed).withColumn("r", in_range) for df in (refs, known))
    counts = {x["r"]: x["count"] for x in refs.groupBy("r").count().collect()}
    parts = [-(-counts.get(r, 0) // part_rows) or 1 for r in range(1 << bits)]
    # one constant, however many ranges there are
    split = F.element_at(F.split(F.lit(",".join(map(str, parts))), ","), F.col("r") + 1).cast("int")
    refs = refs.withColumn("part", F.pmod(F.xxhash64("id"), split).cast("int"))
    known = known.withColumn("part", F.explode(F.sequence(F.lit(0), split - 1)))
    out = refs.groupBy("r", "part").cogroup(known.groupBy("r", "part")).applyInArrow(
        lambda left, right: _probe(right, left), schema="table_name string, id long, kind string, created long")
    return out.select("table_name", "id", "kind", F.timestamp_micros("created").alias("created_at"))


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphans counted by table, month of the referring row (yyyy-MM, null if unreadable) and kind."""
    return orphans.groupBy("table_name", F.date_format("created_at", "yyyy-MM").alias("month"), "kind").agg(F.count("*").alias("orphans"))
