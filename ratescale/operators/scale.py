"""Plan shapes shared by the operators: hot keys, global order, top rows per group.

Nothing here sorts or holds a whole group in one task. Groups are cut by hash or by value range,
totals per cut are small, and running values are put together from cut totals.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratescale.session import cut_lineage

HOT_ROWS = 100_000  # a key below this size is never hot
HOT_SPREAD = 256  # slices a hot key is spread over
SMALL_ROWS = 200_000  # a table up to this many narrow rows is broadcast


def partitions() -> int:
    """Shuffle partitions of the session: what plans are cut for."""
    return int(SparkSession.active().conf.get("spark.sql.shuffle.partitions"))


def hash_order(seed: int | str, *keys: str | Column) -> Column:
    """A random but repeatable order: the same in every engine that has md5."""
    cols = [F.col(k) if isinstance(k, str) else k for k in keys]
    parts = [F.lit(str(seed))] + [F.coalesce(c.cast("string"), F.lit("")) for c in cols]
    return F.md5(F.concat_ws("|", *parts))


def null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", small: bool = False) -> DataFrame:
    """Equi join in which null keys match each other; the key columns come from the left.

    `small` broadcasts the right side; only callers that know its size say so.
    """
    names = {k: f"_r_{k}" for k in keys}
    renamed = right.withColumnsRenamed(names)
    cond = [left[k].eqNullSafe(renamed[n]) for k, n in names.items()]
    return left.join(F.broadcast(renamed) if small else renamed, cond, how).drop(*names.values())


def attach_group_stats(
    rows: DataFrame,
    keys: Sequence[str],
    stats: dict[str, Column],
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Give every row the aggregates of its group without a window over the group.

    The aggregates combine on the map side. Their join back would send all rows of a hot key to one
    task, so the largest groups of `hot_rows` rows or more, one for each shuffle partition at most, get their aggregates by
    broadcast and their rows are spread over `HOT_SPREAD` slices of the join key. All other groups are smaller than an average partition.
    The slice number follows the input partition, so it does not change when a task is run again.
    Rows whose key is null get null aggregates.
    """
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    table = rows.filter(known).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *[c.alias(n) for n, c in stats.items()])
    return attach_table(rows, keys, table, list(stats), "_n", hot_rows)


def largest_groups(table: DataFrame, size: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The rows of groups that would fill a task of a join on their key."""
    # a group with as many rows as an average partition is among the first ones, one for each partition
    return table.filter(F.col(size) >= hot_rows).orderBy(F.desc(size)).limit(partitions())


def attach_table(
    rows: DataFrame,
    keys: Sequence[str],
    table: DataFrame,
    columns: Sequence[str],
    size: str,
    hot_rows: int = HOT_ROWS,
    hot: DataFrame | None = None,
) -> DataFrame:
    """Left join of `rows` with a table of one row per key that knows how many rows each key has (`size`).

    `hot` are its largest groups, where the caller has them already.
    """
    keys = list(keys)
    hot = (largest_groups(table, size, hot_rows) if hot is None else hot).select(*keys, F.struct(*columns).alias("_hot"))
    spread = F.when(F.col("_hot").isNotNull(), F.lit(1) + F.pmod(F.spark_partition_id(), F.lit(HOT_SPREAD))).otherwise(0).cast("int")
    marked = rows.join(F.broadcast(hot), keys, "left").withColumn("_slice", spread)
    # the filter keeps `size` in the plan, so both uses of the table share one shuffle; the slice is 0, but not
    # a literal, which would be moved out of the join key and leave hot rows in one place
    none = F.least(F.col(size), F.lit(0)).cast("int").alias("_slice")
    cold = table.filter(F.col(size) > 0).select(*keys, none, *[F.col(n).alias(f"_cold_{n}") for n in columns])
    joined = marked.join(cold, keys + ["_slice"], "left")
    return joined.select(*rows.columns, *[F.coalesce(F.col(f"_hot.{n}"), F.col(f"_cold_{n}")).alias(n) for n in columns])


def _bucket(h: Column) -> Column:
    """The first hex digits: 4096 buckets, or more where there are more than some hundred partitions."""
    return F.substring(h, 1, max(3, math.ceil(math.log(4 * partitions(), 16))))


def join_small(rows: DataFrame, table: DataFrame, keys: Sequence[str], how: str = "inner", most: int = SMALL_ROWS) -> DataFrame:
    """Null-safe join with a table that should be small, such as one row per stratum.

    The table is written to the checkpoint folder and counted. Up to `most` rows it is broadcast, so the rows are
    not shuffled on what may be a handful of keys; beyond that it is a plain join.
    """
    table = cut_lineage(table)
    small = table.limit(most + 1).count() <= most
    return null_safe(rows, table, keys, how, small)


def _earlier_totals(cut: DataFrame, bucket: str, weight: Column, within: Sequence[str]) -> DataFrame:
    """Per bucket: the weight of all earlier buckets of its group (`_offset`) and of the group (`_all`)."""
    totals = cut.groupBy(*within, bucket).agg(F.sum(weight).alias("_total"))
    per = W.partitionBy(*within)  # the buckets of one group: a few thousand rows at most
    before = F.sum("_total").over(per.orderBy(bucket).rowsBetween(W.unboundedPreceding, -1))
    return totals.select(*within, bucket, F.coalesce(before, F.lit(0)).alias("_offset"), F.sum("_total").over(per).alias("_all"))


def hash_prefix(groups: DataFrame, size: str, order: str, tie: Sequence[str] = (), within: Sequence[str] = ()) -> DataFrame:
    """`_before`: sum of `size` over all rows earlier in the hash order `order`, per `within`.

    Bucket totals carry the sum from bucket to bucket; the running window covers one bucket only. Without
    `within` there is a total for each bucket, which are broadcast. `within` must not be null.
    """
    within = list(within)
    cut = groups.withColumn("_bucket", _bucket(F.col(order)))
    offsets = _earlier_totals(cut, "_bucket", F.col(size), within).drop("_all")
    inside = W.partitionBy(*within, "_bucket").orderBy(order, *tie).rowsBetween(W.unboundedPreceding, -1)
    joined = cut.join(F.broadcast(offsets) if not within else offsets, within + ["_bucket"])
    return joined.withColumn("_before", F.col("_offset") + F.coalesce(F.sum(size).over(inside), F.lit(0))).drop("_bucket", "_offset")


def take_by_hash(rows: DataFrame, order: str, tie: Sequence[str], quotas: DataFrame | int, within: Sequence[str] = ()) -> DataFrame:
    """The first rows of every `within` group in hash order, whatever the group's size.

    `quotas` is one number for all groups or a table of `within` and `_quota`. Rows are counted per group and
    bucket; buckets wholly beyond the quota are dropped before anything is shuffled, and a sort covers one
    bucket of one group.
    """
    within = list(within)
    cut = rows.withColumn("_bucket", _bucket(F.col(order)))
    offsets = _earlier_totals(cut, "_bucket", F.lit(1), within).drop("_all")
    if isinstance(quotas, int):
        wanted = offsets.withColumn("_quota", F.lit(quotas))
    else:
        wanted = null_safe(offsets, quotas.select(*within, "_quota"), within)
    near = join_small(cut, wanted.filter("_offset < _quota"), within + ["_bucket"])
    inside = W.partitionBy(*within, "_bucket").orderBy(order, *tie)
    ranked = near.withColumn("_rank", F.col("_offset") + F.row_number().over(inside))
    return ranked.filter("_rank <= _quota").drop("_bucket", "_offset", "_quota", "_rank")


def value_prefix(values: DataFrame, value: str, weight: str, within: Sequence[str] = (), cuts: int | None = None) -> DataFrame:
    """`_before` and `_all`: weight before each value in value order and in total, per `within`.

    `values` holds one row per (`within`, value), without nulls. A range exchange cuts the value axis evenly, whatever the
    distribution, and every running window covers one cut. There are `cuts` cuts, by default one for each shuffle partition. The cut is
    written with the row: as an expression over the value it would be put below the aggregates that give the values, on all their input rows.
    """
    within = list(within)
    cut = cut_lineage(values.repartitionByRange(cuts or partitions(), value).withColumn("_cut", F.spark_partition_id()))
    offsets = _earlier_totals(cut, "_cut", F.col(weight), within)
    inside = W.partitionBy(*within, "_cut").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    joined = cut.join(F.broadcast(offsets) if not within else offsets, within + ["_cut"])
    return joined.withColumn("_before", F.col("_offset") + F.coalesce(F.sum(weight).over(inside), F.lit(0))).drop("_cut", "_offset")


def first_per_key(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the first in `order`: an aggregate with map-side combine, not a window."""
    keys = list(keys)
    rest = [c for c in rows.columns if c not in keys]
    picked = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return picked.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in rows.columns])


def top_per_group(rows: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows per group. Spark cuts each map task's rows to k per group before the shuffle."""
    w = W.partitionBy(*group).orderBy(*order)
    return rows.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int, rows: int = 20_000) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of about so many rows, or of one larger group, from rows sorted by their first columns, with the starts of the groups."""
    waiting: list[pa.RecordBatch] = []

    def starts(table: pa.Table) -> np.ndarray:
        ones = list(zip(*(table.column(c).to_pylist() for c in range(keys))))
        return np.array([i for i in range(len(ones)) if i == 0 or ones[i] != ones[i - 1]], np.int64)

    for batch in batches:
        waiting.append(batch)
        if sum(b.num_rows for b in waiting) >= rows:
            table = pa.Table.from_batches(waiting)
            found = starts(table)
            if len(found) > 1:
                yield table.slice(0, int(found[-1])), found[:-1]
            waiting = table.slice(int(found[-1])).to_batches()
    if any(b.num_rows for b in waiting):
        table = pa.Table.from_batches(waiting)
        yield table, starts(table)


def range_ranks(rows: DataFrame, value: str, weight: str, within: Sequence[str], tie: Sequence[str], rank: str) -> DataFrame:
    """`rank`: the average rank of each row's value among the weights of its group, put on the rows where a range sort leaves them.

    A part holds the rows between two cuts; a group or a value may lie in several parts. In a part, only the first and the last group
    and value can go on elsewhere, so what the parts tell each other is a few rows for each part, which are broadcast. No row is
    joined on its value. `within` and `value` must not be null.
    """
    within = list(within)
    keys = [*within, value]
    placed = rows.select(*keys, *[c for c in rows.columns if c not in keys]).repartitionByRange(partitions(), *keys, *tie).sortWithinPartitions(*keys)
    placed = placed.withColumn("_part", F.spark_partition_id())

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, carried = None, 0
        for table, starts in whole_groups(batches, len(keys)):
            sums = np.add.reduceat(table.column(weight).to_numpy(), starts)
            sizes = np.diff(np.append(starts, table.num_rows))
            groups = list(zip(*(table.column(c).take(pa.array(starts)).to_pylist() for c in within))) or [()] * len(starts)
            before = np.zeros(len(starts), np.int64)
            for i, group in enumerate(groups):
                if group != now:
                    now, carried = group, 0
                before[i] = carried
                carried += int(sums[i])
            more = [pa.array(np.repeat(before, sizes)), pa.array(np.repeat(sums, sizes))]
            for name, column in zip(("_before", "_same"), more):
                table = table.append_column(name, column)
            yield from table.to_batches()

    schema = T.StructType([*placed.schema.fields, T.StructField("_before", T.LongType()), T.StructField("_same", T.LongType())])
    found = cut_lineage(placed.mapInArrow(local, schema))
    in_part = found.groupBy("_part", *within).agg(F.sum(weight).alias("_all"), F.min(value).alias("_least"), F.max(value).alias("_most"))
    per = W.partitionBy(*within)
    earlier = F.sum("_all").over(per.orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    spread = in_part.withColumn("_parts", F.count(F.lit(1)).over(per)).withColumn("_offset", F.coalesce(earlier, F.lit(0))).filter("_parts > 1")
    spread = cut_lineage(spread.select("_part", *within, "_offset", "_least", "_most"))
    at = ["_part", *within]
    edges = found.join(F.broadcast(spread), at).filter((F.col(value) == F.col("_least")) | (F.col(value) == F.col("_most")))
    edges = edges.groupBy(*at, value).agg(F.max("_same").alias("_w"))
    same = W.partitionBy(*keys)
    here = F.coalesce(F.sum("_w").over(same.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    edges = edges.select(*at, value, here.alias("_here_before"), F.sum("_w").over(same).alias("_everywhere"))
    out = found.join(F.broadcast(spread.select(*at, "_offset")), at, "left").join(F.broadcast(edges), [*at, value], "left")
    before = F.col("_before") + F.coalesce("_offset", F.lit(0)) - F.coalesce("_here_before", F.lit(0))
    return out.select(*rows.columns, (before + (F.coalesce("_everywhere", "_same") + 1) / 2).alias(rank))
