"""Agreement statistics against direct formulas on small tables."""

import itertools
import random
from collections import Counter

import pytest

from ratescale.operators import agreement as ag


def long(spark, matrix):
    rows = [(i, f"r{j}", v) for i, row in enumerate(matrix) for j, v in enumerate(row)]
    return spark.createDataFrame(rows, "item int, annotator string, label string")


def brute_alpha(matrix):
    pairs = [(a, b) for row in matrix for a, b in itertools.permutations([v for v in row if v is not None], 2)]
    seen = sum(a == b for a, b in pairs) / len(pairs)
    chance = sum((c / len(pairs)) ** 2 for c in Counter(a for a, _ in pairs).values())
    return 1.0 if chance == 1 else 1 - (1 - seen) / (1 - chance)


@pytest.mark.parametrize("seed", range(4))
def test_alpha_and_pairs(spark, seed):
    rng = random.Random(seed)
    matrix = [[rng.choice(["a", "b", "c", None]) for _ in range(4)] for _ in range(40)]
    df = long(spark, matrix)
    assert ag.krippendorff_alpha(df, ["item"]).first()["alpha"] == pytest.approx(brute_alpha(matrix))
    shares = []
    for row in matrix:
        vals = [v for v in row if v is not None]
        if len(vals) > 1:
            ps = list(itertools.combinations(vals, 2))
            shares.append(sum(a == b for a, b in ps) / len(ps))
    assert ag.pairwise_agreement(df, ["item"]).first()["pairwise_agreement"] == pytest.approx(sum(shares) / len(shares))


def test_kappa_when_chance_is_certain(spark):
    df = spark.createDataFrame([(i, f"r{j}", 1) for i in range(5) for j in range(2)], "item int, annotator string, label int")
    assert ag.cohen_kappa(df, ["item"], ("r0", "r1")).first()["kappa"] == 1.0
    assert ag.krippendorff_alpha(df, ["item"]).first()["alpha"] == 1.0


def test_precision_without_positives(spark):
    df = spark.createDataFrame([(1, "r", 0, 1), (2, "r", 0, 0)], "item int, annotator string, label int, truth int")
    r = ag.confusion_metrics(df, "truth").first()
    assert r["precision"] is None and r["recall"] == 0.0 and r["f1"] is None and r["accuracy"] == 0.5


def test_majority_skips_ties(spark):
    rows = [(1, "a", "x", "x"), (1, "b", "x", "x"), (1, "c", "y", "x"), (2, "a", "x", "x"), (2, "b", "y", "x"), (3, "a", None, "x")]
    r = ag.majority_vote(spark.createDataFrame(rows, "item int, annotator string, label string, ref string"), ["item"], "ref").first()
    assert (r["n_clear"], r["accuracy"], r["n_tied"]) == (1, 1.0, 1) and r["tie_rate"] == pytest.approx(1 / 3)
