"""Spelling variants against a plain comparison of all words."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from ratescale.llm import queries, spelling

COLUMNS = "doc_id long, text string, word string, n long, `key` string, low string"


def plain_words(docs, least_count=3, drops=97):
    counts = Counter()
    for doc_id, text in docs:
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for run in re.findall("[A-Za-zÀ-ÿ]+", lower):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % drops == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= least_count}


def plain_near(words):
    """Words one edit apart: equal after the loss of one letter in the same place, or of one letter in one of them."""
    near, cut = {w: set() for w in words}, {}
    for w in words:
        for i in range(len(w)):
            cut.setdefault((w[:i], w[i + 1:]), []).append(w)
            for v in {w[:i] + w[i + 1:]} & near.keys():
                near[w].add(v)
                near[v].add(w)
    for some in cut.values():
        for w in some:
            near[w].update(v for v in some if v != w)
    return near


def plain_rows(docs, least_count=3, drops=97):
    words = plain_words(docs, least_count, drops)
    near, form = plain_near(words), {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None
    out = []
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out)


def result(df):
    return sorted((r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect())


def test_query(spark, data):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    assert result(queries.op13_spelling(spark, data)) == plain_rows(docs)


@pytest.mark.parametrize("tile", [7, 2048])
def test_tiles_and_chains(spark, tile):
    """Few letters, so that blocks are large and cut into tiles; chains of forms of several steps."""
    rng = random.Random(5)
    words = ["".join(rng.choices("abé", k=rng.randint(5, 8))) for _ in range(600)] + ["colour", "color", "colours", "colourss", "colourssé"]
    often = {"color": 1, "colour": 40, "colours": 18, "colourss": 8, "colourssé": 4}
    docs = [(i, " ".join(w for w in words for _ in range(often.get(w, rng.choice([1, 1, 2, 5])))) + " MiXed, mixed") for i in range(4)]
    df = spark.createDataFrame([(*d, "w", 1, "k", "l") for d in docs], COLUMNS)
    got = result(spelling.variants(df, drops=11, tile=tile))
    assert got == plain_rows(docs, drops=11)
    assert any(r[1] and r[2] != r[1] for r in got)


def test_awkward_rows(spark):
    long = "a" * 5000
    docs = [(1, None), (2, ""), (None, "naïve naïves " * 3), (3, f"{long} {long}b " * 3), (3, f"{long} {long}b " * 3), (4, "日本語 ÀÉÎÕÜ×÷ àéîõü x" * 4), (5, "1234 !!")]
    df = spark.createDataFrame([(*d, "w", 1, "k", "l") for d in docs], COLUMNS)
    assert result(spelling.variants(df)) == plain_rows(docs)
    assert result(spelling.variants(df.limit(0))) == []


def test_one_edit():
    words = [b"abcde", b"abcdf", b"abcd", b"abxcde", b"abdce", b"bcdea", b"abcdee", b"zabcde"]
    pairs = [(i, j) for i in range(len(words)) for j in range(len(words)) if i != j]
    near = plain_near({w.decode(): 1 for w in words})
    got = spelling.Words(words).one_edit(*map(np.array, zip(*pairs)))
    assert [words[j].decode() in near[words[i].decode()] for i, j in pairs] == got.tolist()
