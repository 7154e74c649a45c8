"""Spelling variants: words one inserted, deleted or replaced letter apart, found by products of letter counts.

One edit changes the counts of at most two letters, so the squared distance of two words' letter counts is 1 (a letter more) or 2 (another
letter). It leaves the first or the last half of the shorter word as it is, so words one edit apart share a block: a length, with the next one, and
the letters of a half. Blocks are Gram matrices in NumPy: words of a length against those of the same and the next length. Pairs
within a distance of two are then verified letter by letter. A block of more than `TILE` words is dealt into tiles, and pairs of tiles go to
tasks, so no task holds a block. No pair is lost.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratescale.llm.common import batch_texts, text_rows, written
from ratescale.operators.scale import attach_group_stats, partitions

LEAST_LETTERS, LEAST_COUNT, DROPS = 5, 3, 97
TILE = 2_048  # words of a tile, about
SMALL = 64  # blocks up to this size are multiplied many at a time
BUFFER_ROWS, TASK_ROWS = 40_000, 250_000
HELD_WORDS = 400_000  # a task hands its counts on beyond this many words
PAIR_CELLS = 4_000_000  # letters compared together
# Latin-1: A-Z become a-z, a-z and U+00C0 to U+00FF stay, all else is a space
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 192 else 32 for c in range(256))
COLUMNS = 26 + 64
COLUMN = np.array([c - 97 if c < 192 else c - 192 + 26 for c in range(256)])


def runs(text: str) -> list[bytes]:
    """The runs of letters in Latin-1; later characters are no letters."""
    return text.encode("latin-1", "replace").translate(LETTERS).split()


def shortened(doc_id: int | None, words: set[bytes], drops: int) -> dict[bytes, bytes]:
    """The runs of a document that lose a letter, with what is left; one in `drops`."""
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    spelled = [w if w.isascii() else w.decode("latin-1").encode() for w in words]
    hashes = np.fromiter((zlib.crc32(w, start) for w in spelled), np.int64, len(spelled))
    found = {}
    for i in np.nonzero(hashes % drops == 0)[0].tolist():
        run = spelled[i].decode().encode("latin-1")
        at = int(hashes[i]) % len(run)
        found[run] = run[:at] + run[at + 1:]
    return found


def count_words(docs: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, drops: int = DROPS) -> DataFrame:
    """(word, n) of all documents (doc_id, text), for words long and frequent enough."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def emptied() -> pa.RecordBatch:
            kept = [(w.decode("latin-1"), n) for w, n in held.items() if n and len(w) >= least_letters]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], names=["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch_texts(batch)):
                words = runs(text)
                held.update(words)
                if lost := shortened(doc_id, {w for w in set(words) if len(w) >= least_letters}, drops):
                    for word, n in Counter(w for w in words if w in lost).items():
                        held[word] -= n
                        held[lost[word]] += n
                if len(held) > HELD_WORDS:
                    yield emptied()
        yield emptied()

    return docs.mapInArrow(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


class Words:
    """Latin-1 words with their letter counts."""

    def __init__(self, words: list[bytes]):
        self.words = words
        self.lens = np.fromiter(map(len, words), np.int64, len(words))
        self.pool = np.frombuffer(b"".join(words), np.uint8)
        self.starts = np.cumsum(self.lens) - self.lens

    def counts(self) -> np.ndarray:
        """Letter counts of the letters that occur; exact also for long words."""
        owner = np.repeat(np.arange(len(self.words)), self.lens)
        full = np.bincount(owner * COLUMNS + COLUMN[self.pool], minlength=len(self.words) * COLUMNS).reshape(-1, COLUMNS)
        return full[:, full.any(axis=0)].astype(np.float32 if self.lens.max() < 2_000 else np.float64)

    def letters(self, at: np.ndarray, length: int) -> np.ndarray:
        return self.pool[self.starts[at][:, None] + np.arange(length)]

    def one_edit(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the words of each pair differ by exactly one letter replaced, inserted or deleted."""
        swap = self.lens[a] > self.lens[b]
        a, b = np.where(swap, b, a), np.where(swap, a, b)
        out = np.zeros(len(a), bool)
        more = self.lens[b] - self.lens[a]
        order = np.argsort(self.lens[a], kind="stable")
        cuts = np.concatenate(([0], np.nonzero(np.diff(self.lens[a][order]))[0] + 1, [len(a)]))
        for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if low == high:
                continue
            length = int(self.lens[a[order[low]]])
            step = max(1, PAIR_CELLS // (length + 1))
            for i in range(low, high, step):
                some = order[i:min(i + step, high)]
                same = some[more[some] == 0]
                out[same] = (self.letters(a[same], length) != self.letters(b[same], length)).sum(axis=1) == 1
                longer = some[more[some] == 1]
                short, long = self.letters(a[longer], length), self.letters(b[longer], length + 1)
                lead, tail = short == long[:, :-1], (short == long[:, 1:])[:, ::-1]
                first = lambda eq: np.where(eq.all(axis=1), length, eq.argmin(axis=1))
                out[longer] = first(lead) + first(tail) >= length
        return out


def halves(word: bytes) -> list[int]:
    """The blocks of a word: by its first half and its last half, as the shorter word and as one of a letter more; the low bit is 1 for last halves."""
    keys = []
    for short in (len(word), len(word) - 1):
        for last, half in enumerate((word[:short // 2], word[len(word) - short // 2:])):
            keys.append(xxhash.xxh64_intdigest(half, seed=2 * short + last) >> 2 << 1 | last)
    return keys


def _small_pairs(counts: np.ndarray, squares: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs within a distance of two of blocks of about one size, padded to the next power of two."""
    width = 2
    while width < 2 * SMALL:
        these = np.nonzero((sizes <= width) & (sizes > width // 2) & (sizes > 1))[0]
        step = max(1, PAIR_CELLS // (width * max(width, counts.shape[1])))
        for i in range(0, len(these), step):
            some = these[i:i + step]
            at = starts[some][:, None] + np.arange(width)
            there = np.arange(width) < sizes[some][:, None]
            at = np.where(there, at, 0)
            x = counts[at] * there[:, :, None]
            s = np.where(there, squares[at], 1e9).astype(counts.dtype)
            d = s[:, :, None] + s[:, None, :] - 2 * (x @ x.transpose(0, 2, 1))
            g, p, q = np.nonzero((d > 0.5) & (d < 2.5) & np.triu(np.ones((width, width), bool), 1))
            yield at[g, p], at[g, q]
        width *= 2


def _large_pairs(counts: np.ndarray, squares: np.ndarray, long: np.ndarray, side: np.ndarray, two: bool, start: int, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs within a distance of two of one tile, or between two tiles of a block: shorter words with each other and with longer ones."""
    at = np.arange(start, start + size)
    short, more = at[~long[at]], at[long[at]]
    if two:
        sides = [(short[side[short] == s], np.concatenate((short[side[short] > s], more[side[more] != s]))) for s in (0, 1)]
    else:
        sides = [(short, np.concatenate((short, more)))]
    for a, b in sides:
        d = squares[a][:, None] + squares[b][None, :] - 2 * (counts[a] @ counts[b].T)
        p, q = np.nonzero((d > 0.5) & (d < 2.5))
        a, b = a[p], b[q]
        kept = long[b] | (a < b) | two
        yield a[kept], b[kept]


def near_pairs(words: Words, keys: np.ndarray, bands: np.ndarray, blocks: np.ndarray, side: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs one edit apart within each block (`blocks`: ascending numbers; `bands`: the shorter length), or across its sides where it has `two`.

    A pair whose first and last halves are the same comes with the first halves' block, so each comes once.
    """
    counts, lens = words.counts(), words.lens
    squares = (counts * counts).sum(axis=1)
    long, last = lens > bands, (keys & 1).astype(bool)
    starts = np.concatenate(([0], np.nonzero(np.diff(blocks))[0] + 1))
    sizes = np.diff(np.concatenate((starts, [len(blocks)])))
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]

    def verified(a: np.ndarray, b: np.ndarray) -> None:
        kept = ~(long[a] & long[b]) & (~two[a] | (side[a] != side[b]))
        a, b = a[kept], b[kept]
        good = words.one_edit(a, b)
        a, b = a[good], b[good]
        new = ~last[a]
        for i in np.nonzero(last[a])[0].tolist():
            half = int(bands[a[i]]) // 2
            new[i] = words.words[a[i]][:half] != words.words[b[i]][:half]
        found.append((a[new], b[new]))

    for a, b in _small_pairs(counts, squares, starts, np.where(sizes <= SMALL, sizes, 0)):
        verified(a, b)
    for i in np.nonzero(sizes > SMALL)[0].tolist():
        for a, b in _large_pairs(counts, squares, long, side, bool(two[starts[i]]), int(starts[i]), int(sizes[i])):
            verified(a, b)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = [w.encode("latin-1") for w in batch.column("word").to_pylist()]
        keys = np.fromiter(chain.from_iterable(map(halves, words)), np.int64, 4 * len(words))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(keys) + 1, 4), pa.int32()), pa.array(keys))
        yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, "keys"])


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of rows sorted by block (key, low, high); the last block of a buffer waits for the rest of it."""

    def links(table: pa.Table, blocks: np.ndarray) -> pa.RecordBatch:
        spelled, n = table.column("word").to_pylist(), table.column("n").to_numpy()
        low, high, tile = (table.column(c).to_numpy() for c in ("low", "high", "tile"))
        side = ((tile != low) & (low != high)).astype(np.int8)
        bands = table.column("band").to_numpy()
        a, b = near_pairs(Words([w.encode("latin-1") for w in spelled]), table.column("key").to_numpy(), bands, blocks, side, low != high)
        column = pa.array(spelled, pa.string())
        return pa.RecordBatch.from_arrays([column.take(pa.array(a)), pa.array(n[a]), column.take(pa.array(b)), pa.array(n[b])], names=["word", "n", "other", "other_n"])

    waiting: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        waiting.append(batch)
        rows += batch.num_rows
        if rows < BUFFER_ROWS:
            continue
        table = pa.Table.from_batches(waiting)
        blocks = _numbered(table)
        whole = int(np.searchsorted(blocks, blocks[-1]))
        if whole:
            yield links(table.slice(0, whole), blocks[:whole])
        waiting = table.slice(whole).to_batches()
        rows -= whole
    if rows:
        table = pa.Table.from_batches(waiting)
        yield links(table, _numbered(table))


def _numbered(table: pa.Table) -> np.ndarray:
    new = np.zeros(table.num_rows, bool)
    for c in ("key", "low", "high"):
        x = table.column(c).to_numpy()
        new[1:] |= x[1:] != x[:-1]
    return np.cumsum(new)


def near_words(words: DataFrame, tile: int = TILE) -> DataFrame:
    """Links (word, n, other, other_n) between words (word, n) one edit apart, each link once."""
    keyed = words.select("word", "n").mapInArrow(_keyed, "word string, n long, keys array<long>").select("word", "n", F.posexplode("keys").alias("place", "key"))
    band = (F.char_length("word") - F.when(F.col("place") >= 2, 1).otherwise(0)).cast("long").alias("band")
    rows = attach_group_stats(keyed.select("word", "n", "key", band), ["key"], {"rows": F.count(F.lit(1))}).filter("rows > 1")
    tiles = F.ceil(F.col("rows") / tile).cast("int")
    dealt = rows.withColumn("tiles", tiles).withColumn("tile", F.pmod(F.xxhash64("word"), "tiles").cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    paired = dealt.withColumn("other", other).select("key", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"), "tile", "band", "word", "n")
    slots = max(partitions(), -(-4 * words.count() // TASK_ROWS))
    block = ["key", "low", "high"]
    return paired.repartition(slots, *block).sortWithinPartitions(*block).mapInArrow(_linked, "word string, n long, other string, other_n long")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): the end of each word's chain of forms (word, form); chains have no circles. Each round doubles the steps."""
    reached = written(forms.filter("form IS NOT NULL").select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        step = reached.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = written(reached.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        reached = moved.drop("moved")
        if moved.filter("moved").isEmpty():
            return reached


def variants(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", least_letters: int = LEAST_LETTERS,
    least_count: int = LEAST_COUNT, drops: int = DROPS, tile: int = TILE,
) -> DataFrame:
    """(word, form, root, n, n_near, form_n): each frequent word of the texts with its usual form.

    Words are runs of Latin letters, A-Z lower-cased; one of `drops` runs, chosen by document and run, loses a letter. A word's form is
    the near word of largest n (ties: smallest), if it has twice the word's n or more; the root is the end of the chain of forms.
    Null and empty texts and empty tables have no words, a null id counts as an empty one, repeated rows count again, other columns stay out.
    """
    words = written(count_words(text_rows(docs, id_column, text_column), least_letters, least_count, drops), "spelling-words")
    links = written(near_words(words, tile), "spelling-links")
    back = links.select(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n"))
    best = F.min_by(F.struct("other", "other_n"), F.struct(-F.col("other_n"), "other"))
    near = links.unionByName(back).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    usual = F.col("best.other_n") >= 2 * F.col("n")
    table = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(usual, F.col("best.other")).alias("form"), F.when(usual, F.col("best.other_n")).alias("form_n")
    )
    table = written(table, "spelling-forms")
    return table.join(roots(table), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
