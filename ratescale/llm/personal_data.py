"""Personal data: fixed patterns, and a semi-Markov conditional random field that adds spans the patterns miss.

The field labels segments of tokens. A segment is up to `LONGEST` tokens and has one kind or none; features of the whole segment and
of the words before it score it. Forward and backward sums over segmentations give the gradient of the likelihood, and the best
segmentation is found by the same dynamic program with maxima. It is fitted on passages whose entities the patterns find.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratescale.llm.common import text_rows

KINDS = ("email", "ip", "card", "phone")
# The base patterns. Look-behinds and possessive repeats only keep them linear; what matches is the same.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    """Fixed rule: from the right, every second digit doubles, less 9 above 9; the sum ends in 0."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, found from the @ signs: the local part reaches back to the last sign that it can't hold."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and LOCAL.match(text, start - 1):
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
        # the signs before this @ can't be part of another address
        end = max(at + 1, out[-1][1] if out else 0)
        at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> list[Span]:
    """The patterns' spans by kind and start."""
    out: list[Span] = []
    if "@" in text:
        out += [("email", a, b) for a, b in emails(text)]
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append(("ip", *m.span()))
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 8 <= len(DIGIT.findall(m[0])) <= 15:
                    out.append(("phone", *m.span()))
    return out


def spelled_spans(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1])))


# The field

LONGEST = 6  # tokens of an entity
CONTEXT = 3  # tokens kept on either side of a passage's candidates
PASSAGE = 64  # tokens of a passage of the fit; a longer stretch is cut
EDGE = 80  # characters on either side of a candidate
FEATURE_BITS = 14
LABELS = ("none", *KINDS)
SAMPLE_PASSAGES = 3000
EPOCHS, BATCH, RATE, DECAY = 6, 32, 0.2, 1e-3
MARGIN = 3.0  # log odds that an added span needs against none
COSTS = np.array([0.0] + [MARGIN] * len(KINDS))
TOKEN = re.compile(r"\S+")
CANDIDATE = re.compile(r"[0-9@]")
SPACE = re.compile(r"\s")
TRIM = ".,;:!?\"'<>[]{}|"


def tokens_of(text: str) -> list[tuple[int, int]]:
    """Token spans, without signs that end a sentence or enclose a word."""
    out = []
    for m in TOKEN.finditer(text):
        word = m[0]
        a = len(word) - len(word.lstrip(TRIM + "("))
        b = len(word.rstrip(TRIM))
        if a < b:
            out.append((m.start() + a, m.start() + b))
    return out


def passages(text: str) -> Iterator[list[tuple[int, int]]]:
    """Passages for the fit: stretches of tokens around those with a digit or an @, cut to bounded lengths."""
    if not CANDIDATE.search(text):
        return
    at, last = -1, len(text)
    first = None
    for m in CANDIDATE.finditer(text):
        if m.start() <= at:
            continue
        # widen to the lines' words around the sign
        begin = max(0, m.start() - 80)
        if first is None:
            first, at = begin, min(last, m.end() + 80)
        elif begin <= at and at - first < 80 * PASSAGE // 8:
            at = min(last, m.end() + 80)
        else:
            yield from _cut_passage(text, first, at)
            first, at = max(begin, at), min(last, m.end() + 80)
    if first is not None:
        yield from _cut_passage(text, first, at)


def _cut_passage(text: str, first: int, last: int) -> Iterator[list[tuple[int, int]]]:
    while first > 0 and not text[first].isspace() and not text[first - 1].isspace() and first > last - 4096:
        first -= 1
    while last < len(text) and not text[last].isspace() and last - first < 4096:
        last += 1
    found = [(a + first, b + first) for a, b in tokens_of(text[first:last])]
    marked = [i for i, (a, b) in enumerate(found) if CANDIDATE.search(text, a, b)]
    if not marked:
        return
    found = found[max(0, marked[0] - CONTEXT):marked[-1] + CONTEXT + 1]
    for i in range(0, len(found), PASSAGE):
        yield found[i:i + PASSAGE]


def stretches(text: str) -> Iterator[list[tuple[int, int]]]:
    """All tokens around those with a digit or an @, of whatever number: a stretch ends only where there is none for 160 characters."""

    def around(first: int, floor: int, last: int) -> list[tuple[int, int]]:
        while first > floor and not text[first].isspace() and not text[first - 1].isspace():
            first -= 1
        found = [(a + first, b + first) for a, b in tokens_of(text[first:last])]
        marked = [i for i, (a, b) in enumerate(found) if CANDIDATE.search(text, a, b)]
        return found[max(0, marked[0] - CONTEXT):marked[-1] + CONTEXT + 1] if marked else []

    first, floor, last = -1, 0, 0
    for m in CANDIDATE.finditer(text):
        begin = max(0, m.start() - EDGE)
        if first < 0:
            first = begin
        elif begin > last:
            space = SPACE.search(text, last)
            last = space.start() if space else len(text)  # the end of its word
            if begin > last:
                if found := around(first, floor, last):
                    yield found
                first, floor = begin, last
        last = max(last, min(len(text), m.end() + EDGE))
    if first >= 0:
        space = SPACE.search(text, last)
        if found := around(first, floor, space.start() if space else len(text)):
            yield found


class Taken:
    """Whether a span overlaps one of the given ones."""

    def __init__(self, spans: list[Span]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for a, b in sorted((a, b) for _, a, b in spans):
            if self.ends and a <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def meet(self, a: int, b: int) -> bool:
        k = bisect_right(self.ends, a)
        return k < len(self.ends) and self.starts[k] < b


def _shape(word: str) -> str:
    """Runs of digits with their length, letters as a, other signs as they are."""
    return re.sub(r"[0-9]+", lambda m: f"9{min(len(m[0]), 6)}", re.sub(r"[^\W\d_]+", "a", word))[:24]


def segment_features(text: str, tokens: list[tuple[int, int]], i: int, j: int) -> list[str]:
    """Features of the whole segment i..j-1 (j excluded) and of the two words before it."""
    word = text[tokens[i][0]:tokens[j - 1][1]]
    digits = "".join(DIGIT.findall(word))
    groups = re.findall(r"[0-9]+", word)
    before = [text[a:b].lower() for a, b in tokens[max(0, i - 2):i]]
    out = [
        f"tokens {j - i}", f"digits {min(len(digits), 20)}", f"groups {min(len(groups), 8)}", f"group sizes {' '.join(str(min(len(g), 6)) for g in groups[:8])}",
        f"at {word.count('@')}", f"dots {min(word.count('.'), 5)}", f"first {word[0] if not word[0].isalnum() else 'a' if word[0].isalpha() else '9'}",
        f"last {word[-1] if not word[-1].isalnum() else 'a' if word[-1].isalpha() else '9'}", f"letters {any(c.isalpha() for c in word)}",
        f"signs {''.join(sorted(set(re.sub(r'[\w]', '', word))))[:8]}", f"shape {_shape(word) if j - i <= 3 else ''}",
    ]
    if 12 <= len(digits) <= 19:
        out.append(f"check {luhn(digits)}")
    if len(groups) == 4 and word.count(".") == 3:
        out.append(f"bytes {all(len(g) <= 3 and int(g) <= 255 for g in groups)}")
    if "@" in word:
        out.append(f"address {bool(re.fullmatch(r'[^@\s]+@[^@\s]+[.][A-Za-z]{2,}', word))}")
    return out + [f"before {w}" for w in before[-1:]] + [f"second {w}" for w in before[:-1]]


class Field:
    """Weights by label and feature, and the dynamic programs over segmentations of a passage."""

    def __init__(self, weights: np.ndarray | None = None):
        self.weights = weights if weights is not None else np.zeros((len(LABELS), 1 << FEATURE_BITS))
        self.mask = (1 << FEATURE_BITS) - 1

    def lattice(self, text: str, tokens: list[tuple[int, int]]) -> list[tuple[int, int, np.ndarray]]:
        return list(self.segments(text, tokens))

    def segments(self, text: str, tokens: list[tuple[int, int]]) -> Iterator[tuple[int, int, np.ndarray]]:
        """Segments (i, j, features). Segments of several tokens, and labels other than none, begin and end at a token that can belong to an entity."""
        marked = [bool(CANDIDATE.search(text, a, b)) or text[a] in "+(" for a, b in tokens]
        for i in range(len(tokens)):
            for j in range(i + 1, min(len(tokens), i + LONGEST) + 1):
                if j > i + 1 and not (marked[i] and marked[j - 1]):
                    continue
                names = segment_features(text, tokens, i, j) if marked[i] and marked[j - 1] else ["plain"]
                yield i, j, np.array([zlib.crc32(f.encode()) & self.mask for f in names])

    def score(self, i: int, j: int, f: np.ndarray) -> np.ndarray:
        """Score of each label; a segment of several tokens is never none, a plain token nothing else."""
        if j == i + 1 and len(f) == 1:
            return np.array([0.0] + [-np.inf] * len(KINDS))
        s = self.weights[:, f].sum(axis=1)
        if j > i + 1:
            s[0] = -np.inf
        return s

    def gradient(self, lattice: list, gold: dict[tuple[int, int], int], n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(features, gradient of the log likelihood by label) of each segment that matters."""
        scores = [self.score(*segment) for segment in lattice]
        ahead, back = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
        ahead[0] = back[n] = 0.0
        sums = [np.logaddexp.reduce(s) for s in scores]
        for (i, j, _), s in zip(lattice, sums):  # by start, so all segments that end at i come before
            ahead[j] = np.logaddexp(ahead[j], ahead[i] + s)
        for (i, j, _), s in zip(reversed(lattice), reversed(sums)):
            back[i] = np.logaddexp(back[i], back[j] + s)
        for (i, j, f), s in zip(lattice, scores):
            if len(f) > 1:
                g = -np.exp(ahead[i] + s + back[j] - ahead[n])
                if (i, j) in gold:
                    g[gold[i, j]] += 1
                yield f, g

    def best(self, lattice: Iterable[tuple[int, int, np.ndarray]], n: int) -> list[tuple[int, int, int]]:
        """Segments with a kind, of the best segmentation, whose score beats none by the margin."""
        top, how = np.full(n + 1, -np.inf), [(0, 0)] * (n + 1)
        top[0] = 0.0
        for i, j, f in lattice:
            # an entity has to beat its tokens as plain ones by the margin, or it is not worth a change
            s = self.score(i, j, f) - COSTS
            label = int(np.argmax(s))
            value = top[i] + s[label]
            if value > top[j]:
                top[j], how[j] = value, (i, label)
        out, at = [], n
        while at:
            i, label = how[at]
            if label:
                out.append((i, at, label))
            at = i
        return out[::-1]


def gold_segments(tokens: list[tuple[int, int]], spans: list[Span]) -> dict[tuple[int, int], int] | None:
    """The segmentation that the base spans give, none elsewhere; None if a span does not fall on tokens."""
    starts, ends = {a: i for i, (a, _) in enumerate(tokens)}, {b: i for i, (_, b) in enumerate(tokens)}
    first, last = tokens[0][0], tokens[-1][1]
    gold: dict[tuple[int, int], int] = {}
    covered: set[int] = set()
    for kind, a, b in spans:
        if b <= first or a >= last:
            continue
        if a not in starts or b not in ends or ends[b] - starts[a] >= LONGEST or covered & set(range(starts[a], ends[b] + 1)):
            return None
        gold[starts[a], ends[b] + 1] = LABELS.index(kind)
        covered |= set(range(starts[a], ends[b] + 1))
    gold |= {(i, i + 1): 0 for i in range(len(tokens)) if i not in covered}
    return gold


def fit(samples: list[tuple[str, list[tuple[int, int]], dict[tuple[int, int], int]]]) -> np.ndarray:
    """Weights of greatest regularised likelihood by adaptive gradient steps; the same samples in the same order give the same weights."""
    field = Field()
    g2 = np.ones_like(field.weights)
    lattices = [(field.lattice(text, tokens), gold, len(tokens)) for text, tokens, gold in samples]
    rng = np.random.default_rng(0)
    for _ in range(EPOCHS):
        order = rng.permutation(len(lattices))
        for at in range(0, len(order), BATCH):
            g = -DECAY * field.weights
            for k in order[at:at + BATCH]:
                for f, slope in field.gradient(*lattices[k]):
                    g[:, f] += np.where(np.isfinite(slope), slope, 0.0)[:, None]
            g2 += g * g
            field.weights += RATE * g / np.sqrt(g2)
    return field.weights.astype(np.float32)


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Passages for the fit with their base spans."""
    for batch in batches:
        out = []
        for text in batch.column("text").to_pylist():
            spans = base_spans(text or "")
            for tokens in passages(text or ""):
                if gold_segments(tokens, spans) is not None:
                    first, last = tokens[0][0], tokens[-1][1]
                    near = [(s, a - first, b - first) for s, a, b in spans if a < last and b > first]
                    out.append((text[first:last], [s for s, _, _ in near], [a for _, a, _ in near], [b for _, _, b in near]))
        columns = list(zip(*out)) or [[], [], [], []]
        kinds = [pa.string(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["passage", "kinds", "starts", "ends"])


def train(docs: DataFrame, sample_passages: int = SAMPLE_PASSAGES, text_column: str = "text") -> np.ndarray:
    """Weights from at most `sample_passages` distinct passages of documents with a digit or an @.

    About as many documents are read, drawn by a hash of the text, and of all their passages the first ones by a hash; the fit is one task.
    """
    rows = docs.select(F.col(text_column).cast("string").alias("text")).filter(F.col("text").rlike("[0-9@]"))
    n = rows.count()
    kept = int(min(1.0, sample_passages / max(n, 1)) * (1 << 20))
    chosen = rows.filter(F.pmod(F.xxhash64("text", F.lit("sample")), F.lit(1 << 20)) < kept)
    found = chosen.mapInArrow(_sampled, "passage string, kinds array<string>, starts array<long>, ends array<long>").withColumn("order", F.md5("passage"))
    found = found.dropDuplicates(["order"]).orderBy("order").limit(sample_passages).withColumn("all", F.lit(0))

    def fitted(rows: pd.DataFrame) -> pd.DataFrame:
        samples = []
        for r in rows.sort_values("order").itertuples():
            tokens = tokens_of(r.passage)
            gold = gold_segments(tokens, list(zip(r.kinds, r.starts, r.ends))) if tokens else None
            if gold is not None:
                samples.append((r.passage, tokens, gold))
        return pd.DataFrame({"weights": [fit(samples).tobytes()]})

    model = found.groupBy("all").applyInPandas(fitted, "weights binary").collect()
    shape = (len(LABELS), 1 << FEATURE_BITS)
    return np.frombuffer(model[0]["weights"], np.float32).reshape(shape) if model else np.zeros(shape, np.float32)


def added_spans(text: str, base: list[Span], field: Field) -> list[Span]:
    """Spans of the field's best segmentations that touch no base span."""
    out: list[Span] = []
    taken = Taken(base)
    for tokens in stretches(text):
        # an entity has four digits or more (ip) or an @; stretches without so many outside the base spans hold none
        rest = "".join(text[a:b] for a, b in tokens if CANDIDATE.search(text, a, b) and not taken.meet(a, b))
        if "@" not in rest and len(DIGIT.findall(rest)) < 4:
            continue
        for i, j, label in field.best(field.segments(text, tokens), len(tokens)):
            a, b = tokens[i][0], tokens[j - 1][1]
            if not taken.meet(a, b):
                out.append((LABELS[label], a, b))
    return out


SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def find_personal_data(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, base and spans: the patterns' spans and all spans (kind, start, end in code points), by kind and start.

    Null and empty texts have none. Null or repeated ids and repeated rows are rows of their own, other columns are left out, an empty
    table gives no rows. The field is fitted on a sample of `docs` first; without a candidate in any text it adds nothing.
    """
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, text_column=text_column))  # 5 x 2 ** FEATURE_BITS weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = Field(sent.value)
        for batch in batches:
            base, spans = [], []
            for text in batch.column("text").to_pylist():
                own = base_spans(text or "")
                both = sorted(own + added_spans(text or "", own, field), key=lambda s: (KINDS.index(s[0]), s[1]))
                base.append([dict(zip(("kind", "start", "end"), s)) for s in own])
                spans.append([dict(zip(("kind", "start", "end"), s)) for s in both])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(base, SPAN), pa.array(spans, SPAN)], names=["doc_id", "base", "spans"])

    span = "array<struct<kind:string,start:long,end:long>>"
    return text_rows(docs, id_column, text_column).mapInArrow(run, f"doc_id long, base {span}, spans {span}")


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each stretch of personal data replaced by its first kind in brackets; spans that overlap are one stretch."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += text[at:a], f"[{kind.upper()}]"
        at = max(at, b)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """The rows of `docs`, with all their columns, with personal data in the text replaced; null texts stay null. No row moves."""
    names = [f"_c{i}" for i in range(len(docs.columns))]
    at = docs.columns.index(text_column)
    plain = docs.toDF(*names)
    sent = docs.sparkSession.sparkContext.broadcast(train(plain, text_column=names[at]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = Field(sent.value)
        for batch in batches:
            texts = []
            for text in batch.column(names[at]).to_pylist():
                own = base_spans(text or "")
                texts.append(text and redacted(text, own + added_spans(text, own, field)))
            yield batch.set_column(at, names[at], pa.array(texts, batch.schema.field(at).type))

    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
