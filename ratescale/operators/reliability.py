"""How well raters agree: leave-one-out correlation and intraclass correlation."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from contextlib import nullcontext
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratescale.functions.digests import md5_words
from ratescale.operators.joins import restrict_to_items
from ratescale.operators.metrics import pearson
from ratescale.operators.scale import HOT_ROWS, attach_group_stats, attach_table, join_small, largest_groups, partitions, whole_groups
from ratescale.schemas import RATING_MAX, RATING_MIN
from ratescale.session import cut_lineage, dealt_to_folders, shuffles_dropped

ITEM = ["attribute", "person_term"]
CENTRE = (RATING_MIN + RATING_MAX) / 2
GRID = 200
LOW_EXP, HIGH_EXP = -4.0, 4.0
LIMIT = 13  # decades; at the last ones an ICC is 0 or 1 to ten places
GROUP_ROWS = 2_000  # cells searched together, about
BIT_ROWS = 1_024  # ratings whose bits are unfolded together
PRODUCT_ROWS = 64  # of them, multiplied together
HASH_ROWS = 512  # raters whose flags are hashed together
PASS_BYTES = 4 << 30  # of ratings with their bits that are shuffled in one pass, about
TASK_BYTES = 64 << 20  # of them in a task, about
ROW_BYTES = 32  # of a rating or a rater besides the bits, about
CELL = ["n", "k", "s", "ss", "ssw"]
DRAWN = ("scope", "rep", "n", "k", "s", "ss", "ssw", "_item")
DRAWN_SQL = "scope string, rep int, n long, k double, s double, ss double, ssw double, _item binary"


def leave_one_out(ratings: DataFrame, item: Sequence[str] = ITEM) -> DataFrame:
    """Each rating with the mean of the item's other ratings; null where there are none."""
    stats = {"_sum": F.sum("rating"), "_cnt": F.count("rating")}
    out = attach_group_stats(ratings, item, stats)
    return out.withColumn("leaveout_mean", F.when(F.col("_cnt") > 1, (F.col("_sum") - F.col("rating")) / (F.col("_cnt") - 1))).drop("_sum", "_cnt")


def rater_correlations(ratings: DataFrame, item: Sequence[str] = ITEM, rater: str = "submission_id", by: Sequence[str] = ()) -> DataFrame:
    """Correlation of each rater's ratings of a term with the leave-one-out means."""
    return leave_one_out(ratings, [*item, *by]).groupBy(rater, *by, "person_term").agg(
        pearson(F.col("rating"), F.col("leaveout_mean")).alias("leaveout_corr")
    )


def loo_summary(correlations: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean, sample deviation and number of rater correlations per term and over all terms (`ALL`)."""
    sets = [[F.col(b) for b in by] + ([F.col("person_term")] if t else []) for t in (True, False)]
    out = correlations.groupingSets(sets, *by, "person_term").agg(
        F.avg("leaveout_corr").alias("mean"), F.stddev_samp("leaveout_corr").alias("std"), F.count("leaveout_corr").alias("count"),
        F.grouping("person_term").alias("_g"),
    )
    return out.select(*by, F.when(F.col("_g") == 1, "ALL").otherwise(F.col("person_term")).alias("person_term"), "mean", "std", "count")


def loo_across(summaries: DataFrame, dataset: str = "source") -> DataFrame:
    """The `ALL` rows of several datasets and an `all` row: mean of means, root mean square of deviations, sum of counts."""
    own = summaries.filter("person_term = 'ALL'").select(F.col(dataset).alias("dataset"), "mean", "std", "count")
    whole = own.agg(F.lit("all").alias("dataset"), F.avg("mean").alias("mean"), F.sqrt(F.avg(F.col("std") * F.col("std"))).alias("std"), F.sum("count").alias("count"))
    return own.unionByName(whole)


def item_moments(ratings: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Number of ratings, centred mean and within-item sum of squares per item."""
    d = F.col("rating") - CENTRE
    return ratings.filter(F.col("rating").isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(d).alias("m"), (F.var_pop(d) * F.count(F.lit(1))).alias("ssw")
    )


def _best_ratios(cells: np.ndarray, starts: np.ndarray, levels: int) -> np.ndarray:
    """The variance ratio with the least REML criterion for each group of cells (n, k, s, ss, ssw); NaN where there is none.

    The ratio is searched on a log grid (with 0), each level 100 times finer around the best point. Where the best point of the first
    grid is at an end of it, the grid goes on for as many decades again, down to 10^-LIMIT and up to 10^LIMIT.
    """
    n, k, s, ss, ssw = cells.T[:, :, None]
    owner = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(cells))))
    total = lambda x: np.add.reduceat(x, starts, axis=0)
    rows, within = total(k * n), total(ssw)

    def least(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place, point and criterion of the best of each group's ascending points."""
        at = points[owner]
        w = n / (1 + at * n)
        weight, a, b = total(k * w), total(w * s), total(w * ss)
        q = within + b - a * a / weight
        with np.errstate(divide="ignore", invalid="ignore"):
            value = (rows - 1) * np.log(q / (rows - 1)) + total(k * np.log1p(at * n)) + np.log(weight)
        value = np.where((q > 0) & ~np.isnan(value), value, np.inf)
        place = value.argmin(axis=1)
        own = np.arange(len(starts))
        return place, points[own, place], value[own, place]

    span, step = HIGH_EXP - LOW_EXP, (HIGH_EXP - LOW_EXP) / (GRID - 1)
    every = np.ones((len(starts), 1))
    grid = LOW_EXP + step * np.arange(GRID)
    place, best, value = least(every * np.concatenate(([0.0], 10.0**grid)))
    known = np.isfinite(value)
    for low, end in ((True, place <= 1), (False, place == GRID)):
        more = grid
        while (end & known).any() and abs(more[0] + (-span if low else span)) <= LIMIT:
            more = more - span if low else more + span
            place, point, other = least(every * 10.0**more)
            better = end & (other < value)
            best, value = np.where(better, point, best), np.where(better, other, value)
            end = end & (place == (0 if low else GRID - 1)) & (better | low)
    for level in range(1, levels):
        fine = step / 100 ** (level - 1)
        _, best, _ = least(best[:, None] * 10.0 ** (np.arange(-(GRID // 2), GRID // 2 + 1) * fine / (GRID // 2)))
    return np.where(known, best, np.nan)


def icc_from_cells(cells: DataFrame, group: Sequence[str], levels: int = 3) -> DataFrame:
    """ICC(1,1) and ICC(1,k) per group by restricted maximum likelihood.

    `cells` has a row for each group and number of ratings n: the number of items k, and over the items the sum of means s, of their
    squares ss and of the squares within them ssw. A group has as many rows as there are different n.
    """
    names = list(group)

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(batches, len(names), GROUP_ROWS):
            values = np.stack([table.column(c).to_numpy() for c in CELL], axis=1)
            best = _best_ratios(values, starts, levels)
            items, rows = np.add.reduceat(values[:, 1], starts), np.add.reduceat(values[:, 0] * values[:, 1], starts)
            own = table.select(names).take(pa.array(starts)).combine_chunks().to_batches()
            columns = own[0].columns if own else []
            yield pa.RecordBatch.from_arrays([*columns, pa.array(best, mask=np.isnan(best)), pa.array(items), pa.array(rows)], names=[*names, "best", "items", "N"])

    plain = cells.select(*names, *[F.col(c).cast("double").alias(c) for c in CELL])
    out = T.StructType([*plain.schema.fields[:len(names)], *[T.StructField(c, T.DoubleType()) for c in ("best", "items", "N")]])
    best = plain.repartition(*names).sortWithinPartitions(*names).mapInArrow(searched, out)
    lam, k_bar = F.col("best"), F.col("N") / F.col("items")
    icc11, icc1k = lam / (lam + 1), lam / (lam + 1 / k_bar)
    clip = lambda c: F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), c)))
    return best.select(*names, icc11.alias("icc_1_1"), icc1k.alias("icc_1_k"), k_bar.alias("avg_k"), clip(icc11).alias("icc_1_1_sqrt"), clip(icc1k).alias("icc_1_k_sqrt"))


def icc_from_items(items: DataFrame, group: Sequence[str], levels: int = 3) -> DataFrame:
    """ICCs of items (n, m, ssw), which collapse to one row per group and number of ratings."""
    cells = items.groupBy(*group, "n").agg(
        F.count(F.lit(1)).alias("k"), F.sum("m").alias("s"), F.sum(F.col("m") * F.col("m")).alias("ss"), F.sum("ssw").alias("ssw")
    )
    return icc_from_cells(cells, group, levels)


def with_all_terms(rows: DataFrame) -> DataFrame:
    """Rows under their term and under `ALL`."""
    return rows.withColumn("scope", F.explode(F.array("person_term", F.lit("ALL"))))


def icc(ratings: DataFrame, item: Sequence[str] = ITEM, levels: int = 3) -> DataFrame:
    """Intraclass correlation per term and over all terms."""
    items = with_all_terms(item_moments(ratings, item))
    return icc_from_items(items, ["scope"], levels).withColumnRenamed("scope", "person_term")


def _rater_bits(batches: Iterator[pa.RecordBatch], n_boot: int, seed: int) -> Iterator[pa.RecordBatch]:
    """A bit for each replicate that keeps the rater."""
    for whole in batches:
        for start in range(0, whole.num_rows, HASH_ROWS):
            batch = whole.slice(start, HASH_ROWS)
            scopes, raters, p = (batch.column(c).to_pylist() for c in ("scope", "_rater", "_p"))
            tails = [b"" if rater is None else f"|{rater}".encode() for rater in raters]
            bits: list[bytes] = [b""] * len(tails)
            for scope in dict.fromkeys(scopes):
                own = [i for i, one in enumerate(scopes) if one == scope]
                hashed = md5_words([f"{seed}|{scope}|{rep}".encode() for rep in range(n_boot)], [tails[i] for i in own])[..., 0]
                packed = np.packbits(hashed / 2**32 < np.array([p[i] for i in own]), axis=0).T
                for i, row in zip(own, packed):
                    bits[i] = row.tobytes()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bits, pa.binary())], names=[*batch.schema.names, "_bits"])


class _Cells:
    """Sums over items for each scope, replicate and number of ratings."""

    def __init__(self, n_boot: int):
        self.n_boot = n_boot
        self.sums: dict[str, np.ndarray] = {}  # scope: (k, s, ss, ssw) by replicates by n

    def add(self, scope: str, moments: np.ndarray) -> None:
        """`moments`: items by (n, sum, sum of squares) by replicates."""
        n = moments[:, 0].astype(np.int64)
        wide = int(n.max(initial=0)) + 1
        have = self.sums.get(scope)
        if have is None or have.shape[2] < wide:
            grown = np.zeros((4, self.n_boot, max(wide, 2 * have.shape[2] if have is not None else 0)))
            if have is not None:
                grown[:, :, :have.shape[2]] = have
            self.sums[scope] = have = grown
        cell = (np.arange(self.n_boot) * have.shape[2] + n).ravel()
        total = moments[:, 1]
        mean = total / np.maximum(moments[:, 0], 1)
        for to, value in zip(have, (None, mean, mean * mean, moments[:, 2] - total * mean)):
            to += np.bincount(cell, None if value is None else value.ravel(), to.size).reshape(to.shape)
        have[:, :, 0] = 0  # items without a rating in the replicate

    def rows(self) -> Iterator[pa.RecordBatch]:
        for scope, sums in self.sums.items():
            rep, n = np.nonzero(sums[0])
            columns = [pa.array([scope] * len(rep), pa.string()), pa.array(rep.astype(np.int32)), pa.array(n), *[pa.array(x[rep, n]) for x in sums]]
            yield pa.RecordBatch.from_arrays([*columns, pa.nulls(len(rep), pa.binary())], names=[*DRAWN])


def _group_moments(packed: np.ndarray, d: np.ndarray, first: np.ndarray, n_boot: int) -> np.ndarray:
    """Items by (n, sum, sum of squares) by replicates, of rows whose items begin at `first`: a product for some rows at a time."""
    item = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(d))))
    moments = np.zeros((len(first), 3, n_boot))
    for start in range(0, len(d), PRODUCT_ROWS):
        own, x = item[start:start + PRODUCT_ROWS], d[start:start + PRODUCT_ROWS]
        least, rows = int(own[0]), np.arange(len(own))
        powers = np.zeros((int(own[-1]) - least + 1, 3, len(own)))
        for k, value in enumerate((1.0, x, x * x)):
            powers[own - least, k, rows] = value
        bits = np.unpackbits(packed[start:start + PRODUCT_ROWS], axis=1, count=n_boot).astype(np.float64)
        moments[least:least + len(powers)] += (powers.reshape(-1, len(own)) @ bits).reshape(-1, 3, n_boot)
    return moments


def _runs(columns: Sequence[pa.Array]) -> tuple[np.ndarray, list[tuple]]:
    """Where runs of equal rows begin, and the row of each run; only these become Python objects."""
    begins = np.ones(len(columns[0]), bool)
    begins[1:] = np.logical_or.reduce([pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False) for c in columns])
    first = np.nonzero(begins)[0]
    return first, list(zip(*(c.take(pa.array(first)).to_pylist() for c in columns)))


def _fixed_width(column: pa.Array) -> np.ndarray:
    """Byte strings of one length, rows by bytes, where they lie."""
    _, ends, data = (column := column.cast(pa.binary())).buffers()
    ends = np.frombuffer(ends, np.int32)[column.offset:column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[ends[0]:ends[-1]].reshape(len(column), -1)


def _item_moments(batches: Iterator[pa.RecordBatch], n_boot: int) -> Iterator[pa.RecordBatch]:
    """Cells of the items of a task; of items that are dealt over several tasks, n, sum and sum of squares for each replicate.

    Rows are sorted by item; an item's sums are carried from block to block, so its rows are never held together.
    """
    cells = _Cells(n_boot)
    carried: tuple[tuple, np.ndarray] | None = None

    def closed(one: tuple, moments: np.ndarray) -> Iterator[pa.RecordBatch]:
        item, scope, part = one
        if part < 0:
            cells.add(scope, moments[None])
        else:
            rep = np.nonzero(moments[0])[0]
            n, total, squares = moments[:, rep]
            columns = [pa.array([scope] * len(rep), pa.string()), pa.array(rep.astype(np.int32)), pa.array(n.astype(np.int64)), *[pa.array(x) for x in (np.ones(len(rep)), total, squares, np.zeros(len(rep)))]]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([item] * len(rep), pa.binary())], names=[*DRAWN])

    for whole in batches:
        for start in range(0, whole.num_rows, BIT_ROWS):
            batch = whole.slice(start, BIT_ROWS)
            first, ones = _runs([batch.column(c) for c in ("_item", "scope", "_part")])
            moments = _group_moments(_fixed_width(batch.column("_bits")), batch.column("_d").to_numpy(), first, n_boot)
            if carried is not None:
                if carried[0] == ones[0]:
                    moments[0] += carried[1]
                else:
                    yield from closed(*carried)
            *done, last = ones
            carried = (last, moments[-1])
            for scope in dict.fromkeys(one[1] for one in done if one[2] < 0):
                cells.add(scope, moments[[i for i, one in enumerate(done) if one[1] == scope and one[2] < 0]])
            for i, one in enumerate(done):
                if one[2] >= 0:
                    yield from closed(one, moments[i])
    if carried is not None:
        yield from closed(*carried)
    yield from cells.rows()


def _added(found: DataFrame) -> DataFrame:
    """Cells of one number of ratings added up, and the parts of each item that is dealt over several tasks."""
    own = F.when(F.col("_item").isNull(), F.col("n"))
    sums = found.groupBy("scope", "rep", "_item", own.alias("_own")).agg(*[F.sum(c).alias(c) for c in CELL])
    return sums.select("scope", "rep", F.coalesce("_own", "n").alias("n"), *CELL[1:], "_item")


def _whole_items(found: DataFrame) -> DataFrame:
    """Cells of all items, from cells and from the sums of items whose parts are added up."""
    dealt, mean = F.col("_item").isNotNull(), F.col("s") / F.col("n")
    item = {"k": F.lit(1.0), "s": mean, "ss": mean * mean, "ssw": F.col("ss") - F.col("s") * mean}
    rows = found.select("scope", "rep", "n", *[F.when(dealt, item[c]).otherwise(F.col(c)).alias(c) for c in CELL[1:]])
    return rows.groupBy("scope", "rep", "n").agg(*[F.sum(c).alias(c) for c in CELL[1:]])


def icc_bootstrap(
    ratings: DataFrame, n_boot: int = 1000, seed: int = 42, item: Sequence[str] = ITEM, rater: str = "submission_id", levels: int = 3, part_rows: int = HOT_ROWS, pass_bytes: int = PASS_BYTES
) -> DataFrame:
    """Mean and 95 % interval of the ICC over rater resamples, per term and over all terms.

    A replicate keeps a rater whole or not at all; each is in with the chance of occurring at least once in n draws out of n. The flag
    is read from md5 of seed, scope, replicate and rater, so no draw is shared. A rater's flags are one string of bits, which comes
    to the rater's ratings; the ratings of an item give the counts, sums and squares of all replicates at once. Items of
    more than `part_rows` ratings are dealt over several tasks.

    The bits are many times as long as a rating. So the ratings are written without bits, dealt by item over passes: a pass shuffles about
    `pass_bytes` of ratings with bits, hands on its cells and drops its shuffle files. Every rating is in one pass. The raters' bits are
    hashed once for all passes where they take no more than `pass_bytes`, else for the raters of each pass. `ratings` are read a few
    times, and must be the same rows each time.
    """
    width = -(-n_boot // 8) + ROW_BYTES
    one = ratings.filter(F.col("rating").isNotNull() & F.col(rater).isNotNull()).select(rater, *item, "rating").withColumn("_key", F.xxhash64(*item))
    under_scopes = lambda rows: with_all_terms(rows).filter(F.col("scope").isNotNull())
    count_raters = lambda scoped: scoped.groupBy("scope", rater).agg(F.count(F.lit(1)).alias("_rows"))

    def flagged(own: DataFrame) -> DataFrame:
        named = join_small(own, chances, ["scope"]).select("scope", rater, "_rows", F.col(rater).cast("string").alias("_rater"), "_p").repartition(partitions(), "scope", rater)
        flags = T.StructType([*named.schema.fields, T.StructField("_bits", T.BinaryType())])
        return named.mapInArrow(lambda batches: _rater_bits(batches, n_boot, seed), flags).select("scope", rater, "_rows", "_bits")

    with shuffles_dropped(ratings.sparkSession):
        own = count_raters(under_scopes(one))
        scopes = cut_lineage(own.groupBy("scope").agg(F.count(rater).alias("_n"), F.sum("_rows").alias("_all")))
        chances = scopes.select("scope", (1 - F.pow(1 - 1 / F.col("_n"), F.col("_n"))).alias("_p"))
        n_rows, n_raters = scopes.agg(F.coalesce(F.sum("_all"), F.lit(0)), F.coalesce(F.sum("_n"), F.lit(0))).first()
        passes = max(1, math.ceil(n_rows * width / pass_bytes))
        shared = cut_lineage(flagged(own)) if n_raters * width <= pass_bytes else None
        hot = largest_groups(shared, "_rows") if shared is not None else cut_lineage(flagged(largest_groups(own, "_rows")))
        tasks = max(partitions(), math.ceil(n_rows * width / passes / TASK_BYTES))

        large = one.groupBy("_key").agg(F.ceil(F.count(F.lit(1)) / part_rows).alias("_parts")).filter("_parts > 1")
        dealt = F.when(F.col("_parts").isNotNull(), F.pmod(F.xxhash64(rater), F.col("_parts"))).otherwise(-1).cast("int")
        parted = join_small(one, large, ["_key"], "left").withColumn("_part", dealt)
        named = parted.select(
            rater, "person_term", F.unhex(F.md5(F.to_json(F.struct(*item)))).alias("_item"), "_part", (F.col("rating") - CENTRE).cast("double").alias("_d"),
            F.pmod(F.xxhash64("_key", "_part"), F.lit(passes)).cast("int").alias("_pass"),
        )
        found = []
        with dealt_to_folders(named, "_pass", "ratings") if passes > 1 else nullcontext(named) as by_pass:
            for number in range(passes):
                scoped = under_scopes(by_pass.filter(F.col("_pass") == number)).drop("person_term", "_pass")
                table = shared if shared is not None else flagged(count_raters(scoped))
                drawn = attach_table(scoped, ["scope", rater], table, ["_bits"], "_rows", hot=hot).filter(F.col("_bits").isNotNull()).drop(rater)
                by_item = drawn.repartition(tasks, "_item", "scope", "_part").sortWithinPartitions("_item", "scope", "_part")
                sums = by_item.mapInArrow(lambda batches: _item_moments(batches, n_boot), DRAWN_SQL)
                found.append(cut_lineage(_added(sums)))
    each = icc_from_cells(_whole_items(_added(reduce(DataFrame.unionByName, found))), ["scope", "rep"], levels)
    cols = [("icc_1_1", "icc_1_1"), ("icc_1_k", "icc_1_k")]
    aggs = []
    for c, name in cols:  # one value per replicate
        aggs += [F.avg(c).alias(f"{name}_mean"), F.percentile(c, F.lit(0.025)).alias(f"{name}_lo"), F.percentile(c, F.lit(0.975)).alias(f"{name}_hi")]
    return each.groupBy(F.col("scope").alias("person_term")).agg(*aggs)


def test_ceiling(ratings: DataFrame, test_items: DataFrame, levels: int = 3) -> DataFrame:
    """Leave-one-out mean and root ICC(1,k) on the ratings of the test items."""
    kept = restrict_to_items(ratings, test_items)
    loo = loo_summary(rater_correlations(kept)).select("person_term", F.col("mean").alias("loo"))
    return loo.join(icc(kept, levels=levels).select("person_term", F.col("icc_1_k_sqrt").alias("sqrt_icc")), "person_term", "left")


def ceiling_table(ratings: DataFrame, by: str = "source", levels: int = 3) -> DataFrame:
    """Leave-one-out mean, deviation and count with root ICCs per dataset and term."""
    loo = loo_summary(rater_correlations(ratings, by=[by]), [by])
    items = with_all_terms(item_moments(ratings, [*ITEM, by]))
    icc_rows = icc_from_items(items, [by, "scope"], levels).select(by, F.col("scope").alias("person_term"), "icc_1_1_sqrt", "icc_1_k_sqrt")
    return loo.join(icc_rows, [by, "person_term"], "left").withColumnRenamed(by, "dataset")
