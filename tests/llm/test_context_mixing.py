"""Context mixing against a bit-by-bit re-computation, and its counts against plain ones."""

import re
import zlib
from collections import Counter
from math import exp, log, log2, log10

import numpy as np
import pytest

from ratescale.llm import context_mixing as mixing
from ratescale.llm import queries

COLUMNS = "doc_id long, text string, `key` string, n long, `row` long, held_out string"
TEXTS = [
    (1, "The cat sat on the mat. The cat sat."), (1, "The cat sat on the mat. The cat sat."), (2, None), (3, ""), (None, " \n\t "),
    (4, "naïve 日本語のテキスト ÀÉ \x85 x"), (5, "long" * 100 + " end"), (6, "the cat " * 300), (8, "unseen words only here"), (None, "the mat"), (22, "cat the sat"),
]


def plain_words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x20\x09-\x0d]+", lower) + [None]


def held_out(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 7 == 2


def plain_base(docs):
    counts = Counter(w for i, t in docs if not held_out(i) for w in plain_words(t))
    total = sum(counts.values())
    out = []
    for i, t in docs:
        words = plain_words(t)
        out.append((i, held_out(i), len(words), sum(w in counts for w in words), total, sum(log10((counts[w] + 1) / (total + len(counts) + 1)) for w in words)))
    return out


def same(got, wanted):
    key = lambda r: tuple(str(x) for x in r[:5]) + (round(r[5], 6),)
    got, wanted = sorted(got, key=key), sorted(wanted, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in wanted]
    assert np.allclose([r[5] for r in got], [r[5] for r in wanted], rtol=1e-9)


def rows_of(df):
    return [tuple(r[c] for c in ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score")) for r in df.collect()]


def frame(spark, docs):
    return spark.createDataFrame([(*d, "k", 1, 2, "h") for d in docs], COLUMNS)


def plain_scores(docs):
    """One decision after the other, with dictionaries of counts."""
    encoded = [[mixing.END if w is None else w.encode() for w in plain_words(t)] for _, t in docs]
    train = [words for (i, _), words in zip(docs, encoded) if not held_out(i)]
    follows = np.zeros((257, 256), np.int64)
    for words in train:
        for piece in (p for w in words for p in mixing.pieces(w)):
            for a, b in zip([0] + [x + 1 for x in piece], piece):
                follows[a, b] += 1
    code = mixing.Code(follows)
    seen = [Counter() for _ in range(5)]

    def steps(words):
        """(slots of the predictors, bit) of each decision."""
        before = mixing.END
        for word in words:
            for n, piece in enumerate(mixing.pieces(word)):
                _, first, nodes, bits, slots = code.decisions([piece])
                for i, (node, bit) in enumerate(zip(nodes.tolist(), bits.tolist())):
                    last = (mixing.word_class(before) << 8 | node) if n == 0 and i < first[0] else None
                    yield [int(s[i]) for s in slots] + [last], bit
            before = word

    for words in train:
        for slots, bit in steps(words):
            for k, slot in enumerate(slots):
                if slot is not None:
                    seen[k][slot, bit] += 1

    def odds(k, slot):
        if slot is None:
            return 0.0
        x = round(mixing.SCALE * log((seen[k][slot, 1] + 0.4) / (seen[k][slot, 0] + 0.4)))
        return max(-127, min(127, x)) / mixing.SCALE

    out = []
    for words in encoded:
        total, half = 0.0, mixing.REFINED // 2
        every = list(steps(words))
        for lane in range(0, len(every), mixing.LANE):
            weights = mixing.first_weights().astype(float)
            refined = [1 / (1 + exp(-(i - half) / mixing.STEP)) for i in range(mixing.REFINED)]
            for block in range(lane, min(lane + mixing.LANE, len(every)), mixing.BLOCK):
                change, hits, ones = np.zeros_like(weights), Counter(), Counter()
                for slots, bit in every[block:min(block + mixing.BLOCK, lane + mixing.LANE)]:
                    x = np.array([odds(k, s) for k, s in enumerate(slots)])
                    n = seen[3][slots[3], 0] + seen[3][slots[3], 1]
                    gate = sum(n >= least for least in (1, 3, 16, 256))
                    s = max(-15.0, min(15.0, float(weights[gate] @ x)))
                    p = 1 / (1 + exp(-s))
                    cell = max(0, min(mixing.REFINED - 1, round(s * mixing.STEP) + half))
                    final = (p + refined[cell]) / 2
                    total += log(max(final if bit else 1 - final, 1e-6))
                    change[gate] += mixing.RATE * (bit - p) * x
                    hits[cell] += 1
                    ones[cell] += bit
                weights += change
                for cell in hits:
                    refined[cell] = (refined[cell] * mixing.DRAG + ones[cell]) / (mixing.DRAG + hits[cell])
        out.append(total / log(10))
    return out


def test_score_bit_by_bit(spark, monkeypatch):
    got = mixing.score_texts(frame(spark, TEXTS)).collect()
    wanted = sorted(zip((str(i) for i, _ in TEXTS), plain_scores(TEXTS)))
    got = sorted((str(r["doc_id"]), r["score"]) for r in got)
    assert [g[0] for g in got] == [w[0] for w in wanted]
    assert np.allclose([g[1] for g in got], [w[1] for w in wanted], rtol=2e-3, atol=1e-3)


def test_base(spark):
    same(rows_of(mixing.score_texts(frame(spark, TEXTS))), plain_base(TEXTS))
    assert rows_of(mixing.score_texts(frame(spark, TEXTS).limit(0))) == []


def test_only_held_out_rows(spark):
    ids = [i for i in range(60) if held_out(i)]
    got = mixing.score_texts(frame(spark, [(i, "some words here") for i in ids])).collect()
    assert {(r["train_tokens"], r["n_known"], r["base_score"]) for r in got} == {(0, 0, 0.0)}
    assert all(r["score"] < 0 for r in got)


def test_query(spark, data, monkeypatch):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    got = queries.op12_context_mixing(spark, data)
    same(rows_of(got), plain_base(docs))
    size = {i: len((t or "").encode()) for i, t in docs}
    rows = got.collect()
    for part in (True, False):
        some = [r for r in rows if r["held_out"] == part]
        bits = -sum(r["score"] for r in some) * log2(10) / sum(size[r["doc_id"]] for r in some)
        assert bits < 3.4, part  # letters alone take more than four


def test_words_that_are_not_hot_are_joined(spark, data, monkeypatch):
    monkeypatch.setattr(mixing, "HOT_WORDS", 3)
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data}/documents.parquet").limit(60).collect()]
    same(rows_of(mixing.score_texts(frame(spark, docs))), plain_base(docs))


@pytest.mark.parametrize("seed", [1, 2])
def test_probabilities_add_up(seed):
    """The bytes that may follow have probabilities that add up to 1: the trees are whole."""
    counts = np.random.default_rng(seed).integers(0, 50, 256) * (np.arange(256) % 3 == 0)
    lens, _, _ = mixing.huffman(counts)
    assert sum(2.0 ** -n for n in lens) == pytest.approx(1.0)


def test_long_texts_are_cut_between_words():
    text = "Ab cdÀ\n" * 50 + "x" * 90 + " end"
    blocks = list(mixing.byte_blocks(text, 40))
    assert b"".join(blocks) == text.encode().lower() and len(blocks) > 5
    assert [w for b in blocks for w in b.split()] == text.encode().lower().split()


def test_hot_words_are_learnt_once():
    tables = [np.random.default_rng(k).integers(-99, 99, 1 << bits).astype(np.int8) for k, bits in enumerate(mixing.TABLE_BITS)]
    texts = [[b"the", f"rare{i}".encode(), b"cat", f"odd{i}".encode(), mixing.END] for i in range(300)]

    def model(most):
        out = mixing.Model(np.ones((257, 256), np.int64), tables, tables[3] % 5, {b"the": 9, b"cat": 7, mixing.END: 30})
        out.words.most = most
        return out

    small, learnt = model(20_000), []
    learn = small._learn
    small._learn = lambda n, new: (learnt.extend(new), learn(n, new))
    got = [small.score([t])[0][0] for t in texts]
    whole = model(1 << 30)
    assert got == [whole.score([t])[0][0] for t in texts]
    assert len(small.words.index) < 300  # rare words went
    assert learnt.count(b"the") == learnt.count(b"cat") == learnt.count(mixing.END) == 1
    # caches that the hot words alone fill are emptied
    tiny = model(100)
    assert [tiny.score([t])[0][0] for t in texts] == got
