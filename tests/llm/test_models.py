"""The fitted models: gradients against differences, best segmentations against all of them, and what they decide on rows they have not seen."""

import functools
import itertools
import os
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ratescale.llm import personal_data as pii
from ratescale.llm import quality

PASSAGES = ["call 555 123 now", "mail a@b.org or +1 555 12", "10.0.0.5 and 7", "no. 4539 1488 0343 6467", "x 9"]


def segmentations(lattice, n):
    """All ways through the lattice from 0 to n, as lists of (segment, label)."""
    of = {}
    for segment in lattice:
        of.setdefault(segment[0], []).append(segment)

    def ways(i):
        if i == n:
            yield []
            return
        for segment in of.get(i, []):
            for label in range(len(pii.LABELS)):
                for rest in ways(segment[1]):
                    yield [(segment, label), *rest]

    return ways(0)


def random_field(seed):
    return pii.Field(np.random.default_rng(seed).normal(0, 1.5, (len(pii.LABELS), 1 << pii.FEATURE_BITS)))


@pytest.mark.parametrize("seed, text", list(enumerate(PASSAGES)))
def test_best_segmentation_of_all(seed, text):
    field, tokens = random_field(seed), pii.tokens_of(text)
    lattice = field.lattice(text, tokens)

    def value(way):
        return sum(field.score(*segment)[label] - (pii.MARGIN if label else 0.0) for segment, label in way)

    best = max(segmentations(lattice, len(tokens)), key=value)
    assert field.best(lattice, len(tokens)) == [(s[0], s[1], label) for s, label in best if label]


@pytest.mark.parametrize("seed, text", list(enumerate(PASSAGES)))
def test_gradient_against_differences(seed, text):
    """The gradient of log p(gold) against differences of the sum over all segmentations."""
    field, tokens = random_field(seed), pii.tokens_of(text)
    gold = pii.gold_segments(tokens, pii.base_spans(text))
    lattice = field.lattice(text, tokens)

    def likelihood():
        scores = [sum(field.score(*segment)[label] for segment, label in way) for way in segmentations(lattice, len(tokens))]
        right = sum(field.score(*segment)[gold[segment[0], segment[1]]] for segment in lattice if (segment[0], segment[1]) in gold)
        return right - np.logaddexp.reduce([s for s in scores if s > -np.inf])

    wanted = np.zeros_like(field.weights)
    for f, g in field.gradient(lattice, gold, len(tokens)):
        for x in f:  # a feature that comes twice counts twice
            wanted[:, x] += np.where(np.isfinite(g), g, 0.0)
    used = sorted({int(x) for _, _, f in lattice if len(f) > 1 for x in f})
    rng = random.Random(seed)
    for label, x in [(rng.randrange(len(pii.LABELS)), rng.choice(used)) for _ in range(25)]:
        keep = field.weights[label, x]
        field.weights[label, x] = keep + 1e-4
        up = likelihood()
        field.weights[label, x] = keep - 1e-4
        down = likelihood()
        field.weights[label, x] = keep
        assert (up - down) / 2e-4 == pytest.approx(wanted[label, x], abs=1e-4)


def test_a_document_may_give_any_number_of_passages(spark):
    """One document with many entities is fitted on as a whole, and a lone odd address is found in another one."""
    many = " . ".join(f"{'word ' * 40}reach us at +1 555 {i:03d} {i * 7 % 10000:04d} today" for i in range(60))
    df = spark.createDataFrame([(1, many)], "doc_id long, text string")
    passages = [r["passage"] for r in df.mapInArrow(pii._sampled, "passage string, kinds array<string>, starts array<long>, ends array<long>").collect()]
    assert len(passages) == 60


def test_the_likelihood_of_grades_has_its_gradient():
    """Steps of the fit go up the likelihood: a fit beats its start and any small change of its thresholds does not beat it by much."""
    rng = np.random.default_rng(2)
    grades = rng.integers(0, 3, 400)
    features = [np.unique(np.concatenate((rng.integers(0, 40, 6), np.full(2, 50 + g)))) for g in grades]
    weights, thresholds = quality.fit(features, grades, 3, bits=8, epochs=30)

    def likelihood(thresholds):
        total = 0.0
        for f, g in zip(features, grades):
            score = float(weights[f].sum(dtype=np.float64))
            up = 1.0 if g == 2 else 1 / (1 + np.exp(-(thresholds[g] - score)))
            low = 0.0 if g == 0 else 1 / (1 + np.exp(-(thresholds[g - 1] - score)))
            total += np.log(max(up - low, 1e-12))
        return total

    at = likelihood(thresholds)
    assert at > 400 * np.log(1 / 3) * 0.2 and thresholds[0] < thresholds[1]
    for k, d in itertools.product((0, 1), (-0.3, 0.3)):
        moved = thresholds.copy()
        moved[k] += d
        assert likelihood(moved) < at + 2.0


def test_held_out_grades(spark, data):
    """Fitted on the rated documents of three quarters of the ids, the others' grades are met. The smallest tables have too few ratings for a fit."""
    data = f"{os.path.dirname(data)}/sf0.1"
    if not os.path.exists(data):
        pytest.skip("no larger tables")
    docs, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 1
    graded = quality.graded(labels).filter(held)
    got = quality.score(docs, labels.filter(~held)).join(graded, "doc_id").groupBy("grade").agg(F.avg(F.col("keep").cast("double")).alias("kept"), F.count(F.lit(1)).alias("n"))
    rate = {r["grade"]: r["kept"] for r in got.collect()}
    assert rate.get(2, 1.0) >= 0.9 and rate.get(0, 0.0) <= 0.1, rate


def test_quality_fit_holds_little_besides_the_sample():
    rng = np.random.default_rng(3)
    features = [np.unique(rng.integers(0, 1 << 14, 1000)).astype("<i4") for _ in range(4000)]
    grades, size = rng.integers(0, 3, 4000), sum(f.nbytes for f in features)
    want = quality.fit([f.astype(np.int64) for f in features], grades, epochs=1)

    def batches():
        for i in range(0, 4000, 500):
            flat = pa.array([f.tobytes() for f in features[i:i + 500]], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(range(i, i + 500)), pa.array(grades[i:i + 500], pa.int32()), flat], names=["doc_id", "grade", "features"])

    quality.fit, whole = functools.partial(quality.fit, epochs=1), quality.fit
    tracemalloc.start()
    try:
        rows = list(quality._fitted(batches()))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        quality.fit = whole
        tracemalloc.stop()
    assert rows[0].column("weights")[0].as_py() == want[0].tobytes() and rows[0].column("thresholds")[0].as_py() == want[1].tolist()
    # lists of 8-byte numbers, copied once, were four times the sample by themselves
    assert peak < 3 * size + (60 << quality.FEATURE_BITS)
    assert not list(quality._fitted(iter(())))
