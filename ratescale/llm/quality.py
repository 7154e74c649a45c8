"""Quality classifier: ordinal regression with cumulative links on graded ratings and hashed text."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratescale.llm.common import Ragged, held, release, small_batches, text_rows

FEATURE_BITS = 20
GRADES = 3  # 0: poor, 1: good but toxic, 2: good
SAMPLE_ROWS = 20_000  # rated documents that the fit looks at, at most about so many
EPOCHS, BATCH, RATE, DECAY = 8, 64, 0.1, 3e-4
LEAST_PROBABILITY = 0.7
LEAST_SHARE = 0.001  # a feature of a smaller share of the sample (or of under LEAST_ROWS rows) has no weight
LEAST_ROWS = 3
KNOWN_WORDS = 300_000  # beginnings of words
KNOWN_BYTES = 60_000_000  # of chunks of text and their features
BEGINNINGS = (3, 4, 5, 6)  # letters
GRAMS = (2, 3)  # letters, anywhere in a run of letters that is no single word
LONG_RUN = 24  # letters; what is longer counts as such a run
WORD = re.compile(r"[^\W_]+")
# letters of scripts that put no space between words: Thai, Lao, Tibetan, Burmese, Khmer, kana and Chinese characters
UNSPACED = re.compile("[\u0e00-\u109f\u1780-\u17ff\u1950-\u19df\u1a20-\u1aad\u3040-\u30ff\u31f0-\u31ff\u3400-\u9fff\uf900-\ufaff\uff66-\uff9d\U00020000-\U0003ffff]")


class Featurizer:
    """Numbers of the hashed features of texts, each once: whole words and their beginnings, pieces of long runs of letters and of runs
    in scripts without spaces, the signs around words, and steps of the shape."""

    def __init__(self, bits: int = FEATURE_BITS):
        self.mask = (1 << bits) - 1
        self.known = Ragged(KNOWN_BYTES, np.int32)  # chunk of text -> its features
        self.heads: dict[str, tuple[int, ...]] = {}

    def _hash(self, kind: str, value: str) -> int:
        return zlib.crc32(f"{kind}:{value}".encode()) & self.mask

    def _head(self, head: str) -> tuple[int, ...]:
        """Features of the first letters of a word."""
        if len(self.heads) >= KNOWN_WORDS:
            self.heads.clear()
        self.heads[head] = out = tuple(self._hash("begins", head[:n]) for n in BEGINNINGS if n <= len(head))
        return out

    def _word(self, word: str) -> tuple[int, ...]:
        """Features of a run of letters or of signs: its beginnings, the whole, and all its pieces if it may hold several words."""
        head = word[:BEGINNINGS[-1]]
        out = (self.heads.get(head) or self._head(head)) + (self._hash("whole", word),)
        if len(word) > LONG_RUN or UNSPACED.search(word):
            out += tuple({self._hash("piece", word[i:i + n]) for n in GRAMS for i in range(len(word) - n + 1)})
        return out

    def _chunk(self, chunk: str) -> tuple[int, ...]:
        low = chunk.lower()
        if low.isalpha():
            return self._word(low)
        out = self._word(" " + WORD.sub("a", low))
        for w in WORD.findall(low):
            out += self._word(w)
        return out

    def _step(self, kind: str, value: float) -> int:
        return self._hash(kind, str(int(value)))

    def _learn(self, chunks: set[str]) -> None:
        new = [c for c in chunks if c not in self.known.index]  # set.difference would walk the whole index
        if self.known.full():
            self.known.clear()
            new = list(chunks)
        found = list(map(self._chunk, new))
        lens = np.fromiter(map(len, found), np.int64, len(found))
        self.known.add(new, np.fromiter(chain.from_iterable(found), np.int32, int(lens.sum())), lens)

    def features(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """Ascending feature numbers of each text."""
        for text in texts:
            chunks = (text or "").split()
            distinct, n = set(chunks), len(chunks)
            self._learn(distinct)
            ids, lens = self.known.get(list(distinct))
            shape = [self._step("length", np.log2(n + 1))]
            if n:
                shape += [
                    self._step("distinct", 20 * len(distinct) / n / (1 if n < 50 else 1 + np.log10(n / 50) / 4)),
                    self._step("chunk length", min(40, 2 * sum(map(len, distinct)) / len(distinct))),
                    self._step("features", 4 * len(ids) / len(distinct)),
                ]
            ids = np.sort(np.append(ids, np.array(shape, np.int32)))
            yield ids[np.append(True, ids[1:] != ids[:-1])]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(features: list[np.ndarray], grades: np.ndarray, grades_n: int = GRADES, bits: int = FEATURE_BITS, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds that maximise the likelihood of P(grade <= k) = sigmoid(threshold k - w.x), by adaptive gradient steps.

    Thresholds stay in order: all but the first are sums of exponentials. Same rows in the same order give the same model.
    """
    best = grades == grades_n - 1
    rows = np.zeros((2, 1 << bits), np.int64)  # of the best grade, of the others
    for f, b in zip(features, best):
        np.add.at(rows[0 if b else 1], f, 1)
    common = rows[0] + rows[1] >= max(LEAST_ROWS, LEAST_SHARE * len(features))
    features = [f[common[f]] for f in features]
    # a feature counts by the log of its ratio in the best grade and in the others, so what says nothing stays small
    ratio = np.log((rows[0] + 1) / (best.sum() + 2)) - np.log((rows[1] + 1) / ((~best).sum() + 2))
    w, g2 = np.zeros(1 << bits), np.ones(1 << bits)
    first, gaps, t2 = -1.0, np.zeros(grades_n - 2), np.ones(grades_n - 1)
    rng = np.random.default_rng(0)
    for _ in range(epochs):
        order = rng.permutation(len(features))
        for at in range(0, len(order), BATCH):
            some = order[at:at + BATCH]
            sizes = np.array([len(features[i]) for i in some])
            flat = np.concatenate([features[i] for i in some])
            owner = np.repeat(np.arange(len(some)), sizes)
            score = np.bincount(owner, weights=w[flat] * ratio[flat], minlength=len(some))
            theta = first + np.concatenate(([0.0], np.cumsum(np.exp(gaps))))
            y = grades[some]
            upper = np.where(y < grades_n - 1, _sigmoid(theta[np.minimum(y, grades_n - 2)] - score), 1.0)
            lower = np.where(y > 0, _sigmoid(theta[np.maximum(y - 1, 0)] - score), 0.0)
            share = np.maximum(upper - lower, 1e-9)
            up, low = upper * (1 - upper) / share, lower * (1 - lower) / share
            slope = up - low  # of the loss by the score
            used, back = np.unique(flat, return_inverse=True)
            g = np.bincount(back, weights=slope[owner] * ratio[flat]) + DECAY * w[used]
            g2[used] += g * g
            w[used] -= RATE * g / np.sqrt(g2[used])
            by_theta = np.zeros(grades_n - 1)
            np.add.at(by_theta, np.minimum(y, grades_n - 2), np.where(y < grades_n - 1, -up, 0))
            np.add.at(by_theta, np.maximum(y - 1, 0), np.where(y > 0, low, 0))
            g = np.concatenate(([by_theta.sum()], [by_theta[k + 1:].sum() * np.exp(gaps[k]) for k in range(len(gaps))]))
            t2 += g * g
            step = RATE * g / np.sqrt(t2)
            first -= step[0]
            gaps -= step[1:]
    return (w * ratio).astype(np.float32), first + np.concatenate(([0.0], np.cumsum(np.exp(gaps))))


def predict(features: np.ndarray, weights: np.ndarray, thresholds: np.ndarray) -> tuple[float, float]:
    """Expected grade and probability of the best grade."""
    above = _sigmoid(float(weights[features].sum(dtype=np.float64)) - thresholds)
    return float(above.sum()), float(above[-1])


def graded(labels: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """(doc_id, grade): 0 poor, 1 good but toxic, 2 good. Ratings with a null in them are left out; of several the worst counts."""
    grade = F.when(F.col("quality") < 1, 0).when(F.col("toxic") > 0, 1).otherwise(2)
    whole = labels.dropna(subset=[id_column, "quality", "toxic"])
    return whole.groupBy(F.col(id_column).cast("long").alias("doc_id")).agg(F.min(grade).alias("grade"))


def _fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row with the model of all (doc_id, grade, features), none without rows. The sample lies in memory once, as it came: four bytes for each feature."""
    release()
    rows: list[tuple[int, bytes, int]] = []
    for batch in small_batches(batches):
        rows += zip(*(batch.column(c).to_pylist() for c in ("doc_id", "features", "grade")))
    if rows:
        rows.sort()
        weights, thresholds = fit([np.frombuffer(f, "<i4") for _, f, _ in rows], np.array([g for _, _, g in rows], np.int64))
        yield pa.RecordBatch.from_arrays([pa.array([weights.tobytes()], pa.binary()), pa.array([thresholds.tolist()], pa.list_(pa.float64()))], names=["weights", "thresholds"])


def train(docs: DataFrame, grades: DataFrame, sample_rows: int = SAMPLE_ROWS, id_column: str = "doc_id", text_column: str = "text") -> tuple[np.ndarray, np.ndarray] | None:
    """Model from at most about `sample_rows` rated documents, drawn by a hash of their id; None if no rated document has a text row.

    The ids of the sample are broadcast (their number is bounded); features are made where the documents lie, and one task fits.
    """
    n = grades.count()
    kept = int(min(1.0, sample_rows / max(n, 1)) * (1 << 20))
    sample = grades.filter(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 20)) < kept)
    chosen = text_rows(docs, id_column, text_column).join(F.broadcast(sample), "doc_id")

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = held(("featurizer",), Featurizer)
        for batch in small_batches(batches):
            flat = [f.astype("<i4").tobytes() for f in maker.features(batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("grade"), pa.array(flat, pa.binary())], names=["doc_id", "grade", "features"])

    rows = chosen.mapInArrow(featured, "doc_id long, grade int, features binary")
    model = rows.repartition(1).mapInArrow(_fitted, "weights binary, thresholds array<double>").collect()
    return (np.frombuffer(model[0]["weights"], np.float32), np.array(model[0]["thresholds"])) if model else None


def _scored(texts: list[str | None], model: tuple[np.ndarray, np.ndarray]) -> list[tuple[float, float]]:
    return [predict(f, *model) for f in held(("featurizer",), Featurizer).features(texts)]


def score(docs: DataFrame, labels: DataFrame, least: float = LEAST_PROBABILITY, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, expected_grade, tail_probability (of the best grade) and keep (at least `least`) of every document.

    Null texts are empty. Null or repeated ids and repeated rows are rows of their own, other columns are left out, an empty table gives
    no rows. Without any rated document all are kept, with null scores.
    """
    model = train(docs, graded(labels), id_column=id_column, text_column=text_column)
    rows = text_rows(docs, id_column, text_column)
    if model is None:
        return rows.select("doc_id", F.lit(None).cast("double").alias("expected_grade"), F.lit(None).cast("double").alias("tail_probability"), F.lit(True).alias("keep"))
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 2 ** FEATURE_BITS weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            found = _scored(batch.column("text").to_pylist(), sent.value)
            columns = [pa.array([f[i] for f in found], pa.float64()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", "expected_grade", "tail_probability"])

    scores = rows.mapInArrow(run, "doc_id long, expected_grade double, tail_probability double")
    return scores.withColumn("keep", F.col("tail_probability") >= least)


def keep_good(docs: DataFrame, labels: DataFrame, least: float = LEAST_PROBABILITY, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of `docs`, with all their columns, whose probability of the best grade is at least `least`. No row moves."""
    names = [f"_c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    key, text = names[docs.columns.index(id_column)], names[docs.columns.index(text_column)]
    model = train(plain, graded(labels), id_column=key, text_column=text)
    if model is None:
        return docs
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            yield batch.filter(pa.array([p >= least for _, p in _scored(batch.column(text).to_pylist(), sent.value)], pa.bool_()))

    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
