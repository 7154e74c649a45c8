"""One document of each group of near copies, against a comparison of all pairs."""

import random
from collections import Counter

import corpus_pipeline
import pytest

from ratescale.llm import near_copies, simhash
from ratescale.llm.common import written

COLUMNS = "doc_id long, text string, lang string"


def plain_shingles(text):
    words = (text or "").encode().lower().split()
    return frozenset(b" ".join(words[i:i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def plain_kept(have):
    """Smallest ids of the groups at a similarity of 0.8."""
    sets = sorted({plain_shingles(t) for _, t in have}, key=sorted)
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                root[find(i)] = find(j)
    number = {s: find(i) for i, s in enumerate(sets)}
    first = {}
    for k, t in have:
        g = number[plain_shingles(t)]
        first[g] = min(k if k is not None else float("inf"), first.get(g, float("inf")))
    return Counter(None if k == float("inf") else k for k in first.values())


def edited(words, n, rng):
    words = list(words)
    for i in rng.sample(range(len(words)), n):
        words[i] = f"new{rng.random()}"
    return words


@pytest.fixture(scope="module")
def planted(spark):
    rng = random.Random(3)
    rows = [(1, None, "x"), (2, " \n", "x"), (None, "alone here", "x"), (None, "alone  here", "x"), (3, "four words and no", "x"), (4, "FOUR words and no", "x")]
    line = " ".join(f"common{i}" for i in range(12))
    for _ in range(60):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(40, 200))]
        rows.append((len(rows), " ".join(base) + " " + line, "x"))
        for _ in range(3):  # copies of a similarity on both sides of 0.8
            rows.append((len(rows), " ".join(edited(base, rng.randint(1, max(1, len(base) // 30)), rng)) + " " + line, "x"))
    return spark.createDataFrame(rows, COLUMNS)


@pytest.mark.parametrize("which", ["planted", "docs"])
def test_one_of_each_group(request, spark, data, which):
    df = request.getfixturevalue("planted") if which == "planted" else spark.read.parquet(f"{data}/documents.parquet")
    have = [(r["doc_id"], r["text"]) for r in df.collect()]
    kept = corpus_pipeline.distinct_documents(spark, df, data)
    assert kept.columns == df.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == plain_kept(have)


def test_few_rounds_and_common_shingles(planted, monkeypatch):
    monkeypatch.setattr(near_copies, "STARS", 0)
    monkeypatch.setattr(near_copies, "COMMON", 10**9)
    monkeypatch.setattr(near_copies, "TILE", 8)
    have = [(r["doc_id"], r["text"]) for r in planted.collect()]
    assert Counter(r["doc_id"] for r in near_copies.keep_one(planted).collect()) == plain_kept(have)


def test_texts_in_copies(planted, monkeypatch):
    monkeypatch.setattr(near_copies, "HUB_PAIRS", 2)
    have = [(r["doc_id"], r["text"]) for r in planted.collect()]
    assert Counter(r["doc_id"] for r in near_copies.keep_one(planted).collect()) == plain_kept(have)


def test_small_plans(planted, monkeypatch):
    """The driver holds a plan again for each of its stages: no plan may hold another one's joins."""
    joins = []

    def counted(df, name):
        joins.append((df._jdf.queryExecution().optimizedPlan().toString().count("Join "), name))
        return written(df, name)

    for module in (near_copies, simhash):
        monkeypatch.setattr(module, "written", counted)
    near_copies.keep_one(planted).collect()
    assert max(joins)[0] <= 6


@pytest.mark.parametrize("edges,rounds", [([(2, 1), (3, 1), (1, 4), (9, 8), (7, 7)], 0), ([(1, 2), (2, 3), (3, 4), (4, 5), (9, 8)], None), ([], 0)])
def test_components(spark, monkeypatch, edges, rounds):
    """Links that are stars already take no round."""
    made = []
    monkeypatch.setattr(simhash, "written", lambda df, name: made.append(name) or written(df, name))
    found = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {x: x for e in edges if e[0] != e[1] for x in e}
    for _ in root:
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    assert found == root
    assert rounds is None or len(made) == 1 + rounds


def test_no_rows(planted):
    assert near_copies.keep_one(planted.limit(0)).collect() == []


def test_many_documents_with_one_shingle(spark):
    """20,000 documents that share nothing but a line: no pair of them is a row; two of them are near copies."""
    line = "one line that stands in all of them"
    rows = [(i, f"{line} a{i} b{i} c{i}", "x") for i in range(20_000)]
    rows += [(20_000, "x1 x2 x3 x4 x5 x6 x7 x8 x9 x10 x11 x12 x13 x14 x15 " + line, "x"), (20_001, "x1 x2 x3 x4 x5 x6 x7 x8 x9 x10 x11 x12 x13 x14 x15 " + line + " y", "x")]
    kept = near_copies.keep_one(spark.createDataFrame(rows, COLUMNS))
    assert sorted(r["doc_id"] for r in kept.select("doc_id").collect()) == list(range(20_001))


def test_long_texts_and_clashing_names(spark):
    columns = "doc_id long, text string, _node string, _n string, _prefix string, _row string, _bits string"
    long = " ".join(f"w{i}" for i in range(200_000))
    rows = [(3, long, "a", "b", "c", "d", "e"), (2, long + " end", "a", "b", "c", "d", "f"), (2, long + " end", "a", "b", "c", "d", "g"), (5, None, *"abcde"), (None, " ", *"abcde")]
    kept = near_copies.keep_one(spark.createDataFrame(rows, columns))
    assert kept.columns == ["doc_id", "text", "_node", "_n", "_prefix", "_row", "_bits"]
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 5]


def test_parity_bounds_the_difference():
    rng = random.Random(1)
    for _ in range(200):
        a = near_copies.shingles(" ".join(str(rng.randrange(10**6)) for _ in range(rng.randint(5, 300))))
        b = near_copies.shingles(" ".join(str(rng.randrange(10**6)) for _ in range(rng.randint(5, 300))))
        flipped = int(near_copies.np.bitwise_count(near_copies.parity(a) ^ near_copies.parity(b)).sum())
        assert flipped <= len(near_copies.np.setxor1d(a, b))
