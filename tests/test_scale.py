"""Plan shapes that stand in for windows, on skewed data and against brute force."""

import hashlib
import random
import time
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ratescale.functions.digests import md5_words
from ratescale.operators import metrics, novels, reliability, resample, sampling, splits
from ratescale.operators.deid import id_mappings
from ratescale.operators.scale import attach_group_stats, first_per_key, hash_order, hash_prefix, range_ranks, take_by_hash, value_prefix
from ratescale.session import SHUFFLE_CONF, ensure_checkpoint_dir

RNG = random.Random(5)


@pytest.fixture(scope="module")
def skewed():
    """A third of the rows under one key."""
    keys = ["hot"] * 400 + [f"k{RNG.randrange(150)}" for _ in range(800)]
    return pd.DataFrame({"key": keys, "x": [RNG.randrange(50) for _ in keys], "i": range(len(keys))})


def test_group_stats_with_hot_keys(spark, skewed):
    rows = spark.createDataFrame(skewed).repartition(6).unionByName(spark.createDataFrame([(None, 1, -1)], "key string, x long, i long"))
    got = attach_group_stats(rows, ["key"], {"total": F.sum("x"), "n": F.count("x")}, hot_rows=50).toPandas()
    assert len(got) == len(skewed) + 1
    want = skewed.groupby("key")["x"].agg(["sum", "count"])
    known = got[got.key.notna()]
    assert (known.total == known.key.map(want["sum"])).all() and (known.n == known.key.map(want["count"])).all()
    assert got[got.key.isna()].total.isna().all()


def test_hot_key_is_spread(spark, skewed):
    """In the shuffle of the join no task gets most of the hot rows."""
    rows = spark.createDataFrame(skewed).repartition(32, "i")
    plain = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    for k, v in plain.items():
        spark.conf.set(k, v)
    try:
        out = attach_group_stats(rows, ["key"], {"n": F.count("x")}, hot_rows=50)
        assert "_slice" in out._jdf.queryExecution().executedPlan().toString().split("hashpartitioning(key")[1].split(")")[0]
        sizes = [r[1] for r in out.filter("key = 'hot'").groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for k in plain:
            spark.conf.unset(k)
    assert sum(sizes) == 400 and len(sizes) >= 4 and max(sizes) < 200


def test_hash_prefix(spark, skewed):
    sizes = skewed.groupby("key").size().rename("size").reset_index()
    df = spark.createDataFrame(sizes).withColumn("h", hash_order(7, "key"))
    got = hash_prefix(df, "size", "h", ["key"]).toPandas().sort_values("h")
    assert (got["_before"].to_numpy() == (got["size"].cumsum() - got["size"]).to_numpy()).all()


def test_value_prefix(spark, skewed):
    counts = skewed.groupby(["key", "x"]).size().rename("w").reset_index()
    got = value_prefix(spark.createDataFrame(counts), "x", "w", ["key"], cuts=7).toPandas().sort_values(["key", "x"])
    assert (got["_before"].to_numpy() == (got.groupby("key").w.cumsum() - got.w).to_numpy()).all()
    assert (got["_all"].to_numpy() == got.groupby("key").w.transform("sum").to_numpy()).all()


def test_value_prefix_of_texts(spark, skewed):
    words = skewed[["key"]].drop_duplicates().assign(w=1)
    got = value_prefix(spark.createDataFrame(words), "key", "w", cuts=11).toPandas().sort_values("key")
    assert got["_before"].tolist() == list(range(len(words)))


def test_value_prefix_looks_up_no_cut_below_the_aggregate(spark, skewed):
    values = spark.createDataFrame(skewed).select(F.md5(F.col("key").cast("string")).alias("v")).distinct().withColumn("w", F.lit(1))
    got = value_prefix(values, "v", "w")
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "lambdafunction" not in plan and "md5" not in plan
    rows = got.orderBy("v").collect()
    assert [r["_before"] for r in rows] == list(range(values.count())) and {r["_all"] for r in rows} == {len(rows)}


def test_id_mappings_read_distinct_ids(spark):
    a = spark.createDataFrame([(str(i % 7), f"S{i % 3}") for i in range(50)] + [(None, None)], "prolific_id string, submission_id string")
    got = id_mappings([a, a.select("prolific_id")])
    assert "Distinct" not in (plan := got._jdf.queryExecution().optimizedPlan().toString()) and "LocalRelation" not in plan
    assert sorted(map(tuple, got.collect())) == [("prolific_id", str(i), f"P00{i + 1}") for i in range(7)]


def test_take_by_hash(spark, skewed):
    df = spark.createDataFrame(skewed).withColumn("h", hash_order(1, "i"))
    got = take_by_hash(df, "h", ["i"], 5, ["key"]).toPandas()
    all_rows = df.toPandas().sort_values("h").groupby("key").head(5)
    assert set(got.i) == set(all_rows.i)


def test_first_per_key(spark, skewed):
    got = first_per_key(spark.createDataFrame(skewed), ["key"], ["x", "i"]).toPandas()
    want = skewed.sort_values(["x", "i"]).groupby("key").head(1)
    assert set(got.i) == set(want.i)


def test_spearman_matches_pandas(spark, skewed):
    pdf = skewed.assign(y=lambda d: (d.x * 3 + d.i % 11) % 17, g=lambda d: d.i % 3)
    for small in (False, True):
        got = metrics.spearman(spark.createDataFrame(pdf), "x", "y", ["g"], many_small=small).toPandas().set_index("g").spearman_r
        for g, part in pdf.groupby("g"):
            want = part.x.rank().corr(part.y.rank())
            assert abs(got[g] - want) < 1e-9


def test_quantile_edges(spark, skewed):
    got = metrics.weighted_quantiles(spark.createDataFrame(skewed), "x", ["key"], 6).toPandas().set_index("key").edges
    for key, part in skewed.groupby("key"):
        want = sorted(set(part.x.quantile([i / 6 for i in range(7)]).round(9)))
        assert [round(v, 9) for v in got[key]] == pytest.approx(want)


def greedy(sizes, k):
    loads = [0] * k
    for s in sorted(sizes, reverse=True):
        loads[min(range(k), key=loads.__getitem__)] += s
    return loads


@pytest.mark.parametrize("seed", range(30))
def test_fold_filling_is_greedy(seed):
    rng = random.Random(seed)
    sizes = [rng.choice([1, 1, 2, 3, 5, 40]) for _ in range(rng.randrange(5, 120))]
    k, loads = rng.randrange(2, 7), None
    loads = [0] * k
    for s in sorted(set(sizes), reverse=True):
        got = splits._fill(loads, s, sizes.count(s))
        assert sum(got) == sizes.count(s)
        loads = [a + b * s for a, b in zip(loads, got)]
    assert loads == greedy(sizes, k)


def test_split_with_a_hot_group(spark, skewed):
    rows = spark.createDataFrame(skewed).withColumnRenamed("key", "attribute")
    out = splits.split_groups(rows, 0.25, 0.15, seed=3).toPandas().sort_values("h")
    n, before, val_rows = len(skewed), 0, 0
    for _, r in out.iterrows():
        want = "val" if before < max(1, -(-n * 0.15 // 1)) else None
        if want == "val":
            val_rows = before + r["size"]
        elif before - val_rows < -(-n * 0.25 // 1):
            want = "test"
        assert r["split"] == (want or "train")
        before += r["size"]
    placed = splits.assign_splits(rows, 0.25, 0.15, seed=3).groupBy("attribute").agg(F.count_distinct("split").alias("n")).filter("n <> 1").count()
    assert placed == 0


def test_tiny_test_share_takes_one_group(spark, skewed):
    rows = spark.createDataFrame(skewed).withColumnRenamed("key", "attribute")
    assert splits.split_groups(rows, 1e-9).filter("split = 'test'").count() == 1


def test_balanced_compensation(spark):
    rows = [(f"a{i}", i < 2) for i in range(52)]
    df = spark.createDataFrame(rows, "a string, f boolean")
    got = sampling.balanced_sample(df, "f", 10, ["a"]).groupBy("f").count().collect()
    assert {r[0]: r[1] for r in got} == {True: 2, False: 8}


def sequential(books, n, seed):
    import hashlib

    taken, out = set(), set()
    for b in sorted(books):
        order = sorted(books[b], key=lambda a: hashlib.md5(f"{seed}|{b}|{a}".encode()).hexdigest())
        own = [a for a in order if a not in taken][:n]
        taken.update(own)
        out.update((b, a) for a in own)
    return out


def test_sample_per_book_is_sequential_choice(spark):
    rng = random.Random(2)
    books = {f"b{i:02d}": rng.sample(range(40), 25) for i in range(8)}
    df = spark.createDataFrame([(b, str(a)) for b, v in books.items() for a in v], "source_novel string, attribute_normalized string")
    got = {tuple(r) for r in sampling.sample_per_book(df, 4, seed=9).select("source_novel", "attribute_normalized").collect()}
    assert got == sequential({b: [str(a) for a in v] for b, v in books.items()}, 4, 9)


def test_balanced_sample_per_book(spark):
    import hashlib

    rng = random.Random(4)
    flags = {str(a): rng.random() < 0.3 for a in range(40)}
    books = {f"b{i}": [str(a) for a in rng.sample(range(40), 22)] for i in range(6)}
    df = spark.createDataFrame([(b, a, flags[a]) for b, v in books.items() for a in v], "source_novel string, attribute_normalized string, f boolean")
    got = {tuple(r) for r in sampling.sample_per_book(df, 6, balanced="f", seed=1).select("source_novel", "attribute_normalized").collect()}
    taken, want = set(), set()
    for b in sorted(books):
        free = sorted((a for a in books[b] if a not in taken), key=lambda a: hashlib.md5(f"1|{b}|{a}".encode()).hexdigest())
        ins, outs = [a for a in free if flags[a]], [a for a in free if not flags[a]]
        if len(free) <= 6:
            own = free
        elif len(ins) < 3:
            own = ins + outs[: 6 - len(ins)]
        elif len(outs) < 3:
            own = outs + ins[: 6 - len(outs)]
        else:
            own = ins[:3] + outs[:3]
        taken.update(own)
        want.update((b, a) for a in own)
    assert got == want


def test_icc_balanced_design_equals_anova(spark):
    rng = random.Random(8)
    rows = [(f"i{i}", "woman", float(min(7, max(1, round(4 + b + rng.gauss(0, 1)))))) for i, b in ((i, rng.gauss(0, 1)) for i in range(60)) for _ in range(6)]
    pdf = pd.DataFrame(rows, columns=["attribute", "person_term", "rating"])
    got = reliability.icc(spark.createDataFrame(pdf)).filter("person_term = 'woman'").first()
    means = pdf.groupby("attribute").rating.mean()
    msb = 6 * ((means - pdf.rating.mean()) ** 2).sum() / 59
    msw = ((pdf.rating - pdf.attribute.map(means)) ** 2).sum() / (60 * 5)
    assert abs(got["icc_1_k"] - (msb - msw) / msb) < 1e-4
    assert abs(got["icc_1_1"] - (msb - msw) / (msb + 5 * msw)) < 1e-4


def test_leave_one_out_with_a_single_rating(spark):
    df = spark.createDataFrame([(1, "a", "woman", 3.0), (1, "b", "woman", 2.0), (2, "b", "woman", 5.0)], "submission_id int, attribute string, person_term string, rating double")
    got = {(r.submission_id, r.attribute): r.leaveout_mean for r in reliability.leave_one_out(df).collect()}
    assert got == {(1, "a"): None, (1, "b"): 5.0, (2, "b"): 2.0}


def test_bootstrap_weights_are_poisson():
    from ratescale.operators.resample import poisson_weights

    w = np.bincount(poisson_weights([str(i) for i in range(400)], 100, 3).ravel()) / 40000
    assert abs(w[1] - 0.3679) < 0.01 and abs(w[2] - 0.1839) < 0.01 and abs((np.arange(len(w)) * w).sum() - 1.0) < 0.02


def test_replicate_sums_against_copies_of_rows(spark):
    """Rows copied by their weights give the statistics of the sums; null slices are slices, and slices come back after a hand-over."""
    from ratescale.operators import resample

    rng = np.random.default_rng(4)
    rows = [(None if i % 5 == 0 else f"s{i % 5}", i, float(rng.integers(1, 8)), float(rng.integers(1, 8))) for i in range(300)]
    df = spark.createDataFrame(rows, "slice string, i int, x double, y double").repartition(3)
    got = {(r.slice, r.rep): (r.r, r.rmse) for r in resample.replicate_statistics(df, "x", "y", ["slice"], ["i"], 10, 7).collect()}
    weights = resample.poisson_weights([str(i) for i in range(300)], 10, 7)
    assert len(got) == 50
    for name in {r[0] for r in rows}:
        for rep in range(10):
            copies = [(x, y) for s, i, x, y in rows if s == name for _ in range(weights[i, rep])]
            x, y = np.array(copies).T
            assert got[name, rep] == pytest.approx((np.corrcoef(x, y)[0, 1], np.sqrt(((x - y) ** 2).mean())))


@pytest.mark.parametrize("cells", [12, 3000])
def test_ranks_over_many_parts(spark, cells):
    """A slice and a value that hold most rows lie in several parts of the range sort."""
    rng = random.Random(cells)
    rows = [("big" if i % 3 else f"s{i % 7}", float(rng.choice([1, 1, 1, 1, 2, 5])), float(i), rng.randint(1, 4)) for i in range(cells)]
    df = spark.createDataFrame(rows, "slice string, x double, y double, w long")
    for value, tie in (("x", "y"), ("y", "x")):
        got = {(r.slice, r.x, r.y): r["rank"] for r in range_ranks(df, value, "w", ["slice"], [tie], "rank").collect()}
        frame = pd.DataFrame(rows, columns=["slice", "x", "y", "w"])
        for name, some in frame.groupby("slice"):
            for r in some.itertuples():
                v = getattr(r, value)
                less, same = some.w[some[value] < v].sum(), some.w[some[value] == v].sum()
                assert got[name, r.x, r.y] == less + (same + 1) / 2


def test_p_values(spark):
    df = spark.createDataFrame([(0.5, 30), (0.0, 10), (-0.8, 8), (1.0, 5), (0.1, 1000), (0.3, 3), (0.003, 1_000_000), (None, 9), (float("nan"), 9), (0.5, 2)], "r double, n long")
    got = [x[0] for x in df.select(metrics.correlation_p("r", "n")).collect()]
    # two-sided t tail probabilities
    assert got == pytest.approx([0.004891, 1.0, 0.017121, 0.0, 0.001546, 0.806037, 0.0027, None, None, None], abs=2e-5)


@pytest.mark.parametrize("ratio", [1e-6, 1e6])
def test_icc_beyond_the_first_grid(spark, ratio):
    """Variance ratios far outside the grid's first decades, from moments that have them exactly: items of k ratings, balanced."""
    k, items, within = 4, 2_000, 1.0
    # REML estimate of a balanced table: (MSB - MSW) / (k MSW)
    msb = within * (1 + k * ratio)
    m = np.random.default_rng(3).standard_normal(items)
    m = (m - m.mean()) / m.std(ddof=1) * np.sqrt(msb / k)
    cells = spark.createDataFrame([("a", k, items, float(m.sum()), float((m * m).sum()), within * items * (k - 1))], "scope string, n long, k long, s double, ss double, ssw double")
    got = reliability.icc_from_cells(cells, ["scope"]).first()
    assert got["icc_1_1"] == pytest.approx(ratio / (1 + ratio), rel=2e-3 if ratio < 1 else 1e-6)
    assert got["icc_1_1"] < 1 or ratio > 1


def test_perfect_and_no_agreement(spark):
    cells = spark.createDataFrame([("same", 3, 50, 10.0, 40.0, 0.0), ("none", 3, 50, 0.0, 0.0, 100.0)], "scope string, n long, k long, s double, ss double, ssw double")
    got = {r["scope"]: r["icc_1_1"] for r in reliability.icc_from_cells(cells, ["scope"]).collect()}
    assert got["same"] == pytest.approx(1.0, abs=1e-9) and got["none"] == 0.0


def test_bit_strings_against_plain_replicates(spark):
    """Moments per replicate from raters' bits, with items dealt over several tasks, against one sum after the other."""
    rng = random.Random(8)
    rows = [(r, f"a{i}", "man", float(rng.randint(1, 7))) for r in range(25) for i in range(12) if rng.random() < 0.7]
    df = spark.createDataFrame(rows, "submission_id long, attribute string, person_term string, rating double").repartition(3)
    one = reliability.icc_bootstrap(df, n_boot=16, levels=2).orderBy("person_term").collect()
    dealt = reliability.icc_bootstrap(df, n_boot=16, levels=2, part_rows=3).orderBy("person_term").collect()
    assert [r["person_term"] for r in one] == ["ALL", "man"]
    for a, b in zip(one, dealt):
        assert [a[c] for c in a.asDict() if c != "person_term"] == pytest.approx([b[c] for c in b.asDict() if c != "person_term"])


def test_quotas_of_many_strata(spark):
    """100,000 strata of few sizes: the missing units go to the largest remainders, ties to the smallest key."""
    sizes = spark.range(100_000).select(F.col("id").alias("stratum"), F.explode(F.sequence(F.lit(1), 1 + F.col("id") % 3)).alias("row"))
    got = sampling.stratum_quotas(sizes, 70_000, ["stratum"])
    assert not any(line.strip().startswith("+- Window") and "]" == line[-1] and "[]" in line for line in got._jdf.queryExecution().executedPlan().toString().splitlines())
    frame = got.toPandas().sort_values("stratum")
    exact = frame["size"] * 70_000 / frame["size"].sum()
    floor = np.floor(exact)
    order = np.lexsort((frame["stratum"], -np.round(exact - floor, 9)))
    want = floor.to_numpy(copy=True)
    want[order[:int(70_000 - floor.sum())]] += 1
    assert (frame["quota"].to_numpy() == np.minimum(frame["size"], want)).all() and frame["quota"].sum() == 70_000


def test_md5_of_heads_and_tails():
    heads = [f"42|{i}|".encode() for i in range(120)] + [b"", b"h" * 70]
    tails = [("é" * i).encode() for i in range(0, 70, 3)] + [b"x" * i for i in range(45, 65)]
    got = md5_words(heads, tails)
    for i, head in enumerate(heads):
        for j, tail in enumerate(tails):
            assert "".join(f"{w:08x}" for w in got[i, j].tolist()) == hashlib.md5(head + tail).hexdigest()


def test_weights_and_flags_hash_no_text_alone(monkeypatch):
    """The same numbers as from a call of hashlib for each text, without such calls."""
    one = lambda text: hashlib.md5(text.encode()).hexdigest()
    keys, limits = ["a|woman", "naïve|man", "", "k" * 80], resample.poisson_limits()
    want = [[sum(one(f"7|{rep // 4}|{key}")[8 * (rep % 4):8 * (rep % 4) + 8] >= x for x in limits) for rep in range(30)] for key in keys]
    raters = [("ALL", "3"), ("man", "3"), ("ALL", None)]
    flags = [[int(one(f"7|{s}|{rep}" + ("" if r is None else f"|{r}"))[:8], 16) / 2**32 < 0.6 for rep in range(30)] for s, r in raters]
    monkeypatch.setattr(hashlib, "md5", None)
    assert resample.poisson_weights(keys, 30, 7).tolist() == want
    rows = pa.RecordBatch.from_pydict({"scope": [s for s, _ in raters], "_rater": [r for _, r in raters], "_p": [0.6] * 3})
    got = [np.unpackbits(np.frombuffer(b, np.uint8), count=30).astype(bool).tolist() for out in reliability._rater_bits([rows], 30, 7) for b in out.column("_bits").to_pylist()]
    assert got == flags


def test_item_moments_by_products():
    rng = np.random.default_rng(1)
    bits, d = rng.integers(0, 2, (300, 20)), rng.normal(size=300)
    first = np.array([0, 1, 70, 71, 72, 200, 299])
    got = reliability._group_moments(np.packbits(bits.astype(np.uint8), axis=1), d, first, 20)
    want = np.stack([np.add.reduceat(bits * x[:, None], first, axis=0) for x in (np.ones(300), d, d * d)], axis=1)
    assert np.allclose(got, want)


def test_distinct_counts_carry_no_other_aggregates(spark):
    """No copies of the rows and no wide aggregates for each attribute or sentence and grouping set."""
    rows = [("m", "d", f"a{i % 5}", "woman" if i % 2 else "man", "4" if i % 3 else None, None, 4.0) for i in range(30)] + [("m", "d", None, None, "2", "3", 1.0), (None, "d", "a", "man", "1", None, 1.0)]
    responses = spark.createDataFrame(rows, "model string, dataset string, attribute string, person_term string, method1_rating string, method2_rating string, avg_rating double")
    got = metrics.response_summary(responses)
    assert "Expand" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.model, r.n, r.n_attributes, r.n_terms, r.m1_success, r.m2_mean) for r in got.collect()} == {("m", 31, 5, 2, 21 / 31, 3.0), (None, 1, 1, 1, 1.0, None)}
    phrases = [("n1", 1, " red eye", True), ("n1", 1, None, True), ("n1", 2, None, False), ("n1", None, "red eye", None), ("n2", 1, "old hat", False), (None, None, None, None)]
    table = spark.createDataFrame(phrases, "source_novel string, text_id long, attribute string, indomain_strct boolean").selectExpr("*", "'male' AS llm_gender", "if(text_id = 1, 'male', 'female') AS intext_gender")
    summary = novels.corpus_summary(table)
    assert "Expand" not in summary._jdf.queryExecution().optimizedPlan().toString()
    r = summary.first()
    assert (r.total_novels, r.total_sentences, r.sentences_with, r.total_attributes, r.indomain, r.outdomain, r.unique_attributes, r.total_matches, r.total_comparisons) == (3, 3, 2, 3, 1, 1, 2, 2, 3)
    assert (r.avg_sentences, r.avg_attributes) == (1.0, 1.0)


def test_ranks_of_many_small_slices_are_dealt_by_their_number(spark, monkeypatch):
    rows = [(f"s{i % 20}", float(i % 3), float(i % 7)) for i in range(200)]
    pairs = spark.createDataFrame(rows, "s string, x double, y double")
    want = sorted(map(tuple, metrics.spearman(pairs, "x", "y", ["s"], many_small=True).collect()))
    monkeypatch.setattr(metrics, "TASK_CELLS", 5)
    got = metrics.spearman(pairs, "x", "y", ["s"], many_small=True)
    assert "RepartitionByExpression [s" in (plan := got._jdf.queryExecution().optimizedPlan().toString()) and ", 40" in plan
    assert sorted(map(tuple, got.collect())) == want


def odd_ratings(spark):
    """Many raters of some items, one item that a third of the ratings are of, and nulls."""
    rng = random.Random(11)
    rows = [(r, f"a{i}", "man" if i % 2 else "woman", float(rng.randint(1, 7))) for r in range(60) for i in range(20) if rng.random() < 0.4]
    rows += [(r, "hot", "man", float(rng.randint(1, 7))) for r in range(60) for _ in range(4)]
    rows += [(None, "a1", "man", 3.0), (None, "a1", "other", 3.0), (5, "a1", None, 6.0), (6, None, "man", 2.0), (7, "a1", "man", None), (8, "a2", "ALL", 5.0), (9, "a2", "ALL", 1.0), (9, "a3", "ALL", 2.0)]
    return spark.createDataFrame(rows, "submission_id long, attribute string, person_term string, rating double").repartition(3)


def test_bootstrap_in_passes(spark, monkeypatch):
    """Passes hold no more ratings with bits than they should, a hot item's included; every rating is in one, and the result is the same."""
    df, inputs = odd_ratings(spark), []
    want = reliability.icc_bootstrap(df, n_boot=40, levels=2).orderBy("person_term").collect()
    assert [r["person_term"] for r in want] == ["ALL", "man", "woman"]
    in_arrow = type(df).mapInArrow
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, f, schema: (inputs.append((self.count(), self._jdf.queryExecution().optimizedPlan().toString())) if schema == reliability.DRAWN_SQL else None, in_arrow(self, f, schema))[1])
    scoped = df.filter("rating IS NOT NULL AND submission_id IS NOT NULL").count() * 2 - 1
    for pass_bytes in (37 * 400, 37 * 170):  # raters' bits are shared by the passes, or hashed for each
        inputs.clear()
        got = reliability.icc_bootstrap(df, n_boot=40, levels=2, part_rows=10, pass_bytes=pass_bytes).orderBy("person_term").collect()
        sizes = [size for size, _ in inputs]
        assert sum(sizes) == scoped and len(sizes) == -(-scoped * 37 // pass_bytes) and max(sizes) < 2.5 * pass_bytes / 37
        assert all("Relation [" in plan and "LocalRelation" not in plan and "ExternalRDD" not in plan for _, plan in inputs)  # the ratings themselves are not read for each pass
        assert not list(Path(ensure_checkpoint_dir(spark).removeprefix("file:")).glob("ratings-*"))
        assert [r["person_term"] for r in got] == [r["person_term"] for r in want]
        for a, b in zip(want, got):
            assert [a[c] for c in a.asDict() if c != "person_term"] == pytest.approx([b[c] for c in b.asDict() if c != "person_term"], nan_ok=True)


def test_runs_and_bits_of_a_slice():
    rows = [(b"a", "x", -1), (b"a", "x", -1), (b"a", "y", -1), (b"a", "y", 0), (b"b", "y", 0), (b"b", "y", 0)]
    batch = pa.RecordBatch.from_pydict({"_item": [b"z"] + [r[0] for r in rows], "scope": ["x"] + [r[1] for r in rows], "_part": [-1] + [r[2] for r in rows], "_bits": [bytes([i, 7]) for i in range(7)]})
    for start, size in ((1, 6), (2, 3), (6, 1)):
        own = batch.slice(start, size)
        first, ones = reliability._runs([own.column(c) for c in ("_item", "scope", "_part")])
        here = rows[start - 1:start - 1 + size]
        assert first.tolist() == [i for i in range(size) if i == 0 or here[i] != here[i - 1]] and ones == [here[i] for i in first]
        assert reliability._fixed_width(own.column("_bits")).tolist() == [[i, 7] for i in range(start, start + size)]


def test_bootstrap_drops_its_shuffle_files(spark):
    """The bits of a pass stay on no disk when the pass is over, and the session's setting is as before."""
    before = spark.conf.get(SHUFFLE_CONF, None)
    files = lambda: sum(f.stat().st_size for f in Path(local).rglob("shuffle_*.data"))
    local = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()[0].getPath()
    rows = spark.range(40_000).selectExpr("id % 1000 AS submission_id", "'a' || id % 4000 AS attribute", "'man' AS person_term", "CAST(1 + id * id % 7 AS DOUBLE) AS rating")
    start = files()
    reliability.icc_bootstrap(rows, n_boot=800, levels=1, pass_bytes=3_000_000)
    until = time.time() + 20
    while files() - start > 2_000_000 and time.time() < until:
        time.sleep(0.2)
    assert files() - start < 2_000_000  # of 8 MB of bits
    assert spark.conf.get(SHUFFLE_CONF, None) == before
