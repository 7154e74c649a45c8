"""Grouped splits and folds without a global sort.

The order is md5 of seed and group. Sizes are prefix-summed by hash bucket, so the cut is found from 4096
totals and one bucket's window.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratescale.operators.scale import attach_table, hash_order, hash_prefix, join_small
from ratescale.schemas import HELD_OUT_SOURCES
from ratescale.session import cut_lineage


def group_sizes(rows: DataFrame, group: str, seed: int) -> DataFrame:
    sizes = rows.filter(F.col(group).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("size"))
    return sizes.withColumn("h", hash_order(seed, group))


def split_groups(rows: DataFrame, test_size: float, val_size: float = 0.0, seed: int = 42, group: str = "attribute") -> DataFrame:
    """Split of every group: validation takes the first groups until it has its rows, then test, then train.

    The group that crosses a target still belongs to the split; a target is at least one row.
    """
    if not (0 <= test_size <= 1 and 0 <= val_size < 1 and test_size + val_size <= 1):
        raise ValueError("sizes must be shares that add up to at most 1")
    sizes = cut_lineage(group_sizes(rows, group, seed))  # read by the totals, the targets and the places
    placed = hash_prefix(sizes, "size", "h", [group])
    total = sizes.agg(F.sum("size")).scalar()

    def target(share: float):
        return F.greatest(F.lit(1), F.ceil(total * F.lit(float(share))))

    if val_size > 0:
        in_val = F.col("_before") < target(val_size)
        marked = placed.withColumn("_val", in_val)
        val_rows = marked.agg(F.sum(F.when(F.col("_val"), F.col("size")).otherwise(0))).scalar()
        in_test = (F.col("_before") - val_rows) < target(test_size)
        split = F.when(F.col("_val"), "val").when(in_test, "test").otherwise("train")
    else:
        marked = placed
        split = F.when(F.col("_before") < target(test_size), "test").otherwise("train")
    return marked.select(group, "size", "h", split.alias("split"))


def assign_splits(rows: DataFrame, test_size: float, val_size: float = 0.0, seed: int = 42, group: str = "attribute") -> DataFrame:
    """Rows with their group's split."""
    groups = split_groups(rows, test_size, val_size, seed, group)
    return attach_table(rows.drop("split"), [group], groups, ["split"], "size")


def force_split(rows: DataFrame, label: str) -> DataFrame:
    return rows.withColumn("split", F.lit(label))


def rebuild_test_rows(
    rows: DataFrame,
    test_size: float,
    val_size: float = 0.0,
    seed: int = 42,
    group: str = "attribute",
    held_out: Sequence[str] = HELD_OUT_SOURCES,
) -> DataFrame:
    """Test rows: all rows of held-out sources, and the test split of the others."""
    if "source" not in rows.columns:
        return assign_splits(rows, test_size, val_size, seed, group).filter("split = 'test'").drop("split")
    whole = F.coalesce(F.col("source").isin(*held_out), F.lit(False))
    cut = assign_splits(rows.filter(~whole), test_size, val_size, seed, group).filter("split = 'test'").drop("split")
    return cut.unionByName(rows.filter(whole))


def evaluation_rows(rows: DataFrame, test_size: float, val_size: float = 0.0, seed: int = 42, group: str = "attribute", label: str = "test") -> DataFrame:
    """Rows whose stored split is `label`; if the table has none, the split is rebuilt."""
    if "split" not in rows.columns:
        return assign_splits(rows, test_size, val_size, seed, group).filter(F.col("split") == label)
    stored = rows.filter(F.col("split") == label)
    if not stored.isEmpty():
        return stored
    return assign_splits(rows.drop("split"), test_size, val_size, seed, group).filter(F.col("split") == label)


def _fill(loads: list[int], size: int, count: int) -> list[int]:
    """How many of `count` groups of one size each fold gets when every group goes to the smallest fold."""
    got = [0] * len(loads)
    if size == 0:
        got[min(range(len(loads)), key=loads.__getitem__)] = count
        return got

    def at_or_below(level: int) -> int:
        return sum((level - load) // size + 1 for load in loads if load <= level)

    low, high = min(loads), max(loads) + size * count
    while low < high:  # the lowest level at which all groups are placed
        mid = (low + high) // 2
        low, high = (low, mid) if at_or_below(mid) >= count else (mid + 1, high)
    got = [max(0, (low - 1 - load) // size + 1) if load < low else 0 for load in loads]
    left = count - sum(got)
    for i, load in enumerate(loads):  # folds reaching exactly this level: lowest number first
        if left and load <= low and (low - load) % size == 0:
            got[i] += 1
            left -= 1
    return got


def fold_groups(rows: DataFrame, k: int, seed: int = 42, group: str = "attribute") -> DataFrame:
    """Fold of every group: largest groups first, each to the smallest fold.

    Groups of equal size are alike for the balance, so the placement is worked out per distinct size
    (a table of sizes and counts, at most the square root of twice the rows) and the groups of a size
    are dealt out in hash order.
    """
    if k < 2:
        raise ValueError("k must be at least 2")
    sizes = group_sizes(rows, group, seed)
    classes = sizes.groupBy("size").agg(F.count(F.lit(1)).alias("n"))

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        loads = [0] * k
        for batch in batches:
            plan = []
            for size, count in zip(batch["size"].tolist(), batch["n"].tolist()):
                start = 0
                for fold, n in enumerate(_fill(loads, size, count)):
                    if n:
                        plan.append((size, fold + 1, start, start + n))
                        start += n
                        loads[fold] += n * size
            yield pd.DataFrame(plan, columns=["size", "fold", "lo", "hi"])

    # every placement depends on those before it, so one task streams through the sizes; it keeps the k loads only
    table = classes.repartition(1).sortWithinPartitions(F.desc("size")).mapInPandas(deal, "size long, fold int, lo long, hi long")
    ranked = hash_prefix(sizes.withColumn("_one", F.lit(1)), "_one", "h", [group], within=["size"])
    dealt = join_small(ranked, table, ["size"]).filter((F.col("_before") >= F.col("lo")) & (F.col("_before") < F.col("hi")))
    return dealt.select(group, "size", "fold")


def kfold_rows(rows: DataFrame, k: int, seed: int = 42, group: str = "attribute") -> DataFrame:
    """One long table of folds: pooled train and val rows once per fold, test rows fixed in every fold."""
    pool = rows.filter(F.col("split").isin("train", "val"))
    placed = attach_table(pool.drop("split"), [group], fold_groups(pool, k, seed, group).withColumnRenamed("fold", "_own"), ["_own"], "size")
    test = rows.filter("split = 'test'").drop("split").withColumn("_own", F.lit(None).cast("int"))
    both = placed.unionByName(test).withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(k))))
    split = F.when(F.col("_own").isNull(), "test").when(F.col("_own") == F.col("fold"), "val").otherwise("train")
    return both.withColumn("split", split).drop("_own")
