"""Log probabilities of texts by logistic context mixing: bit predictors with hashed contexts, gated weights, online refinement.

A text is the sequence of its lower-cased words. A word is spelled in bytes and a space, the end in a byte of its own; words longer than
`PIECE` bytes are spelled in pieces. Each byte is a few decisions on a Huffman tree over the bytes that followed the byte before in the training texts, so a
text has fewer than half as many decisions as bits. Five predictors know a decision's context: the last one, two and three bytes, the word so far, and, for
a word's first byte, the word before. Their counts come from all training texts: Spark counts the words and first bytes, tasks add the
counts into hashed tables, and the tables' sums are turned into log odds. As in every hashed model the tables have a fixed size, so that they can
be broadcast; contexts that meet in a slot share its counts, and no count is left out.

Within a text the log odds are mixed by weights that a gate chooses (how often the word so far was seen); weights learn online from the
coding errors of each block of decisions, and an adaptive table refines the mixed probability. Weights and table begin anew after
`LANE` decisions, so that long texts are scored in parallel.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain
from math import log, log10

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ratescale.llm.common import Ragged, Slots, batch_texts, gather, held, small_batches, text_rows, written
from ratescale.operators.scale import attach_table

FOLDS, HELD_OUT = 7, 2
END, SPACE = b"\n", b" "
PIECE = 64  # bytes
# last byte, last two bytes, last three bytes, word so far, word before with the first byte: log2 of the slots
TABLE_BITS = (16, 20, 21, 22, 20)
PREDICTORS = len(TABLE_BITS)
BEFORE_BITS = 12
SCALE = 16.0  # log odds are kept in sixteenths
GATES = 5
BLOCK, LANE = 256, 1 << 15  # decisions
LANES = 192  # lanes mixed together
RATE = 0.002
REFINED, STEP, DRAG = 25, 2.0, 32.0  # buckets, buckets for each unit of log odds, observations that the start counts for
SLICE_BYTES = 1 << 19
TEXT_BYTES = 1 << 22
HOT_WORDS, HOT_BYTES = 100_000, 32  # most frequent words whose counts are broadcast; the counts of all others are joined
HELD_WORDS = 300_000  # a task hands its counts on beyond this many words
NEW_WORDS = 10_000  # words learnt together
KEPT = 64_000_000  # bytes of words and their inputs that a worker keeps
DOCS = 500  # documents whose results are handed on together
LEARN_WORDS = 1_000_000  # words of one task that fills tables, about
PART_BITS = 14  # slots of a row of tables
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
WORD, FIRST = 0, 1  # kinds of counts


def byte_blocks(text: str, most: int = TEXT_BYTES) -> Iterator[bytes]:
    """The text in UTF-8 with A-Z lower-cased, cut between words where it is long."""
    data = text.encode().lower()
    at = 0
    while len(data) - at > most:
        end = max(data.rfind(c, at, at + most) for c in (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r"))
        if end <= at:  # one word: up to its end
            ends = [i for c in (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r") if (i := data.find(c, at + most)) >= 0]
            end = min(ends, default=len(data))
        yield data[at:end]
        at = end
    yield data[at:]


def pieces(word: bytes) -> list[bytes]:
    """What is spelled of a word: itself and a space, long words in pieces."""
    if word == END:
        return [END]
    spelled = word + SPACE
    return [spelled[i:i + PIECE] for i in range(0, len(spelled), PIECE)]


def huffman(counts: np.ndarray) -> tuple[list[int], list[int], list[int]]:
    """Length of each byte's path, and the nodes and bits of all paths, byte after byte. Bytes that never occurred have a path too."""
    heap = [(int(c) * 256 + 1, i) for i, c in enumerate(counts)]
    heapify(heap)
    parent, side = {}, {}
    for node in range(256, 511):
        (a, left), (b, right) = heappop(heap), heappop(heap)
        for child, bit in ((left, 0), (right, 1)):
            parent[child], side[child] = node, bit
        heappush(heap, (a + b, node))
    lens, nodes, bits = [], [], []
    for byte in range(256):
        path = []
        while byte in parent:
            path.append((510 - parent[byte], side[byte]))
            byte = parent[byte]
        lens.append(len(path))
        nodes += [n for n, _ in path[::-1]]
        bits += [b for _, b in path[::-1]]
    return lens, nodes, bits


class Code:
    """Decisions of spelled pieces with their slots in the tables. There is a tree for each byte that may come before."""

    def __init__(self, counts: np.ndarray):
        """`counts`: 257 x 256, how often each byte follows the start of a piece or each byte."""
        lens, nodes, bits = [], [], []
        for row in counts:
            for have, new in zip((lens, nodes, bits), huffman(row)):
                have += new
        self.depth = np.array(lens, np.int64)
        self.first = np.cumsum(self.depth) - self.depth
        self.nodes, self.bits = np.array(nodes, np.uint64), np.array(bits, np.int8)
        powers = [1]
        for _ in range(PIECE):
            powers.append(powers[-1] * int(MIX[0]) & ((1 << 64) - 1))
        self.powers = np.array(powers, np.uint64)

    def path(self, before: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number of decisions of each byte after another, and all nodes and bits."""
        at = before.astype(np.int64) << 8 | data
        lens = self.depth[at]
        return lens, gather(self.nodes, self.first[at], lens), gather(self.bits, self.first[at], lens)

    def decisions(self, spelled: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
        """Decisions of each piece and of its first byte; all nodes, bits, and slots of the first four predictors."""
        data, starts, place, last = neighbours(spelled)
        sizes = np.diff(np.append(starts, len(data)))
        sums = np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.powers[place])
        before = np.concatenate((np.zeros(1, np.uint64), sums[:-1]))
        so_far = before - np.repeat(before[starts], sizes)
        two = last[0] | last[1] << np.uint64(9)
        contexts = [last[0], two, two | last[2] << np.uint64(18), so_far]
        lens, nodes, bits = self.path(last[0], data)
        marks = (nodes + np.uint64(1)) * MIX[0]
        slots = []
        for context, width in zip(contexts, TABLE_BITS):
            context = np.repeat(context * MIX[1], lens)
            context += marks
            context ^= context >> np.uint64(29)
            context *= MIX[2]
            context >>= np.uint64(64 - width)
            slots.append(context.view(np.int64))
        ends = np.concatenate(([0], np.cumsum(lens)))
        return ends[starts + sizes] - ends[starts], lens[starts], nodes, bits, slots


def neighbours(spelled: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """All bytes, the pieces' starts, each byte's place in its piece, and the bytes one, two and three before it plus 1 (0: before the start)."""
    sizes = np.fromiter(map(len, spelled), np.int64, len(spelled))
    data = np.frombuffer(b"".join(spelled), np.uint8)
    starts = np.cumsum(sizes) - sizes
    place = np.arange(len(data)) - np.repeat(starts, sizes)
    now = data.astype(np.uint64) + np.uint64(1)
    last = []
    for back in (1, 2, 3):
        earlier = np.zeros(len(data), np.uint64)
        earlier[back:] = now[:-back]
        last.append(np.where(place >= back, earlier, np.uint64(0)))
    return data, starts, place, last


def word_class(word: bytes) -> int:
    """The hashed word that the predictor of first bytes knows."""
    return zlib.crc32(word) & ((1 << BEFORE_BITS) - 1)


def add_words(code: Code, tables: list[np.ndarray], words: list[bytes], counts: np.ndarray) -> None:
    """Add words with their numbers to the tables, which are slots by bits."""
    spelled = [pieces(w) for w in words]
    lens, _, _, bits, slots = code.decisions(list(chain.from_iterable(spelled)))
    weights = np.repeat(np.repeat(counts, [len(some) for some in spelled]), lens)
    for table, slot in zip(tables, slots):
        np.add.at(table, 2 * slot + bits, weights)


def add_firsts(code: Code, tables: list[np.ndarray], firsts: np.ndarray, counts: np.ndarray) -> None:
    """Add first bytes (class of the word before << 8 | byte) with their numbers to the last table."""
    lens, nodes, bits = code.path(np.zeros(len(firsts), np.int64), firsts & 255)
    slot = np.repeat(firsts >> 8, lens) << 8 | nodes.astype(np.int64)
    np.add.at(tables[-1], 2 * slot + bits, np.repeat(counts, lens))


def log_odds(table: np.ndarray) -> np.ndarray:
    """Log odds of a 1 in sixteenths, from slots by bits; 0 where nothing was seen."""
    zeros, ones = table[0::2].astype(np.float64), table[1::2].astype(np.float64)
    return np.clip(np.rint(SCALE * np.log((ones + 0.4) / (zeros + 0.4))), -127, 127).astype(np.int8)


def gates(table: np.ndarray) -> np.ndarray:
    """How often each slot was seen, in classes: 0, 1 or 2, up to 15, up to 255, more."""
    return np.searchsorted(np.array([1, 3, 16, 256]), table[0::2] + table[1::2], side="right").astype(np.int8)


class Model:
    """Scores texts with given tables; keeps the inputs of the words that it has seen."""

    def __init__(self, byte_counts: np.ndarray, tables: list[np.ndarray], seen: np.ndarray, hot: dict[bytes, int]):
        """`hot`: training counts of frequent words."""
        self.code, self.tables, self.seen, self.hot = Code(byte_counts), tables, seen, hot
        self.words = Ragged(KEPT, np.int64)
        self.facts = np.zeros((1024, 3), np.int64)  # class, decisions of the first byte, training count (-1: not among the hot words)

    def _learn(self, n: int, new: list[bytes]) -> None:
        if max(map(len, new)) < PIECE:  # all are spelled in one piece
            flat, parts = [w + SPACE if w != END else w for w in new], np.ones(len(new), np.int64)
        else:
            spelled = [pieces(w) for w in new]
            flat, parts = list(chain.from_iterable(spelled)), np.fromiter(map(len, spelled), np.int64, len(spelled))
        lens, firsts, nodes, bits, slots = self.code.decisions(flat)
        packed = np.zeros((len(nodes), 8), np.int8)
        for k, slot in enumerate(slots):
            packed[:, k] = self.tables[k][slot]
        # a first byte's place for the fifth log odds holds the node until the word before is known
        packed[:, 4], packed[:, 5], packed[:, 6] = nodes.astype(np.uint8).view(np.int8), self.seen[slots[3]], bits
        opening = np.cumsum(parts) - parts
        firsts = firsts[opening]
        ends = np.concatenate(([0], np.cumsum(lens)))
        starts, sizes = ends[opening], ends[opening + parts] - ends[opening]
        later = np.arange(len(nodes)) - np.repeat(starts, sizes) >= np.repeat(firsts, sizes)
        packed[later, 4] = 0
        self.words.put(n, packed.view(np.int64).ravel(), sizes)
        while n + len(new) > len(self.facts):
            self.facts = np.concatenate((self.facts, np.zeros_like(self.facts)))
        facts = self.facts[n:n + len(new)]
        facts[:, 0], facts[:, 1], facts[:, 2] = [word_class(w) for w in new], firsts, [self.hot.get(w, -1) for w in new]

    def _forget(self) -> None:
        """Drop the words that are not hot, and all words if the hot ones take more than three quarters."""
        words = list(self.words.index)
        hot = np.flatnonzero(self.facts[:len(words), 2] >= 0)
        facts, (packed, lens) = self.facts[hot], self.words.at(hot)
        self.words.clear()
        self.words.add([words[i] for i in hot.tolist()], packed, lens)
        self.facts[:len(hot)] = facts
        if 4 * (self.words.index.bytes + 8 * self.words.used) > 3 * self.words.most:
            self.words.clear()

    def inputs(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number of decisions of each word; eight bytes for each decision: five log odds, the gate, the bit and an unused one; the words' hot counts."""
        if self.words.full():
            self._forget()
        slots = self.words.slots(words)
        if new := self.words.index.new:
            known = len(self.words.index) - len(new)
            for i in range(0, len(new), NEW_WORDS):
                self._learn(known + i, new[i:i + NEW_WORDS])
            self.words.index.new = []
        packed, lens = self.words.at(slots)
        rows = packed.view(np.int8).reshape(-1, 8)
        facts = self.facts[slots]
        before = np.concatenate(([word_class(END)], facts[:-1, 0]))  # a text begins as after an end
        firsts = facts[:, 1]
        at = np.repeat(np.cumsum(lens) - lens - (np.cumsum(firsts) - firsts), firsts) + np.arange(int(firsts.sum()))
        rows[at, 4] = self.tables[4][np.repeat(before, firsts) << 8 | rows[at, 4].view(np.uint8)]
        return lens, packed, facts[:, 2]

    def score(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """Log10 probability of each text, given as words with the end, and the hot counts of all words."""
        lens, packed, hot = self.inputs(list(chain.from_iterable(texts)))
        ends = np.concatenate(([0], np.cumsum(lens)))[np.cumsum([0] + [len(words) for words in texts])]
        lanes = -(-np.diff(ends) // LANE)
        owner = np.repeat(np.arange(len(texts)), lanes)
        start = ends[:-1][owner] + LANE * (np.arange(len(owner)) - np.repeat(np.cumsum(lanes) - lanes, lanes))
        stop = np.minimum(start + LANE, ends[1:][owner])
        order = np.argsort(start - stop, kind="stable")  # lanes of about one length together
        logs = np.zeros(len(owner))
        for i in range(0, len(order), LANES):
            some = order[i:i + LANES]
            logs[some] = mix(packed, start[some], stop[some])
        return np.bincount(owner, logs, len(texts)) / log(10), hot


def first_weights() -> np.ndarray:
    """Gates by predictors: the more often the word so far was seen, the more it counts."""
    out = np.tile(np.array([0.15, 0.25, 0.4, 0.0, 0.3], np.float32), (GATES, 1))
    for gate, (others, own) in enumerate(((1.0, 0.0), (0.8, 0.3), (0.4, 0.7), (0.2, 0.9), (0.0, 1.0))):
        out[gate, :3] *= others
        out[gate, 3] = own
    return out


def mix(packed: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Natural log probability of the bits of each lane [start, stop), longest first, block by block; each lane learns for itself."""
    lanes = len(start)
    total = np.zeros(lanes)
    # as wide as a row of eight bytes: the gate and the bit meet weights that stay 0
    weights = np.zeros((lanes, GATES, 8), np.float32)
    weights[:, :, :PREDICTORS] = first_weights() / SCALE
    rate = np.where(np.arange(8) < PREDICTORS, RATE / SCALE**2, 0).astype(np.float32)
    half = REFINED // 2
    centres = 1 / (1 + np.exp(-(np.arange(REFINED) - half) / STEP))
    refined = np.repeat(centres[None].astype(np.float32), lanes, axis=0)
    kinds = np.arange(GATES, dtype=np.int8)[None, :, None]
    own = np.arange(lanes, dtype=np.int32)[:, None]
    for step in range(0, int((stop - start).max(initial=0)), BLOCK):
        n = int(np.searchsorted(start - stop, -step, side="left"))  # lanes longer than the step
        whole = int(np.searchsorted(start - stop, -step - BLOCK, side="right"))  # lanes that fill the block; the others come after them
        at = start[:n, None] + (step + np.arange(BLOCK))
        np.minimum(at[whole:], stop[whole:n, None] - 1, out=at[whole:])
        beyond = np.arange(step, step + BLOCK) >= (stop - start)[whole:n, None]
        rows = packed[at].view(np.int8).reshape(n, BLOCK, 8)
        x = rows.astype(np.float32)
        gate, bit = np.ascontiguousarray(rows[:, :, 5]), np.ascontiguousarray(rows[:, :, 6])
        each = x @ weights[:n].transpose(0, 2, 1)
        mixed = each.ravel()[np.arange(0, n * BLOCK * GATES, GATES) + gate.ravel()].reshape(n, BLOCK)
        np.clip(mixed, -15, 15, out=mixed)
        p = np.exp(-mixed)
        p += 1
        np.reciprocal(p, out=p)
        mixed *= np.float32(STEP)
        cell = np.clip(np.rint(mixed, out=mixed), -half, half, out=mixed).astype(np.int32)
        cell += half + REFINED * own[:n]
        coded = refined[:n].ravel()[cell]
        coded += p
        coded *= np.float32(0.5)
        np.subtract(1, coded, out=coded, where=bit == 0)
        np.maximum(coded, np.float32(1e-6), out=coded)
        coded[whole:][beyond] = 1
        four = coded[:, 0::4] * coded[:, 1::4] * coded[:, 2::4] * coded[:, 3::4]
        total[:n] += np.log(four).sum(axis=1, dtype=np.float64)
        error = bit - p
        error[whole:][beyond] = 0
        spread = error[:, None, :] * (gate[:, None, :] == kinds)
        weights[:n] += rate * (spread @ x)
        cell += cell
        cell += bit
        cell[whole:][beyond] = 2 * n * REFINED
        seen = np.bincount(cell.ravel(), minlength=2 * n * REFINED + 1)[:-1].reshape(-1, 2)
        refined[:n] = ((refined[:n].ravel() * DRAG + seen[:, 1]) / (DRAG + seen.sum(axis=1))).reshape(n, REFINED)
    return total


def _training(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers of words, and of first bytes after classes of words (three bytes)."""
    index = Slots()
    counts = np.zeros(1024, np.int64)
    firsts = np.zeros(1 << (BEFORE_BITS + 8), np.int64)
    facts = np.zeros((1024, 2), np.int64)  # class and first byte

    def rows(kind: int, keys: list[bytes], numbers: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys, pa.binary()), pa.array(numbers)], names=["kind", "key", "n"])

    def words() -> pa.RecordBatch:
        out = rows(WORD, list(index), counts[:len(index)].copy())
        index.clear()
        counts[:] = 0
        return out

    for batch in batches:
        for text in batch_texts(batch):
            parts = [block.split() for block in byte_blocks(text)]
            parts[-1].append(END)
            for some in parts:
                slots = np.fromiter(map(index.__getitem__, some), np.int64, len(some))
                if new := index.new:
                    while len(index) > len(counts):
                        counts, facts = np.concatenate((counts, np.zeros_like(counts))), np.concatenate((facts, np.zeros_like(facts)))
                    facts[len(index) - len(new):len(index)] = [(word_class(w), w[0]) for w in new]
                    index.new = []
                if len(some) > len(index) // 8:
                    counts[:len(index)] += np.bincount(slots, minlength=len(index))
                else:
                    np.add.at(counts, slots, 1)
                seen = facts[slots]
                np.add.at(firsts, np.concatenate(([word_class(END)], seen[:-1, 0])) << 8 | seen[:, 1], 1)
            if len(index) > HELD_WORDS:
                yield words()
    yield words()
    cells = np.nonzero(firsts)[0]
    yield rows(FIRST, [int(c).to_bytes(3, "big") for c in cells.tolist()], firsts[cells])


def gathered(docs: DataFrame) -> DataFrame:
    """(kind, key, n) of the training texts: words with the end (kind 0) and first bytes by the class of the word before (kind 1)."""
    return docs.select("text").mapInArrow(_training, "kind int, key binary, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


def _byte_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums = np.zeros(257 * 256, np.int64)
    for batch in batches:
        spelled = [pieces(w) for w in batch.column("key").to_pylist()]
        if spelled:
            flat = list(chain.from_iterable(spelled))
            data, starts, _, last = neighbours(flat)
            weights = np.repeat(batch.column("n").to_numpy(), [sum(map(len, some)) for some in spelled])
            np.add.at(sums, last[0].astype(np.int64) << 8 | data, weights)
    cells = np.nonzero(sums)[0]
    yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(sums[cells])], names=["cell", "n"])


def byte_counts(counts: DataFrame) -> np.ndarray:
    """How often each byte follows the start of a piece or each byte; at most 257 x 256 numbers come to the driver."""
    found = counts.filter(F.col("kind") == WORD).select("key", "n").mapInArrow(_byte_pairs, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(257 * 256, np.int64)
    for row in found:
        out[row["cell"]] = row["n"]
    return out.reshape(257, 256)


def fitted_tables(counts: DataFrame, words: int, code: Code) -> tuple[list[np.ndarray], np.ndarray]:
    """Log odds of each predictor's slots, and how often the slots of the word so far were seen; of fixed size, through the driver."""
    sent = counts.sparkSession.sparkContext.broadcast(code)

    def filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [np.zeros(2 << b, np.int64) for b in TABLE_BITS]
        for batch in batches:
            kinds, n = batch.column("kind").to_numpy(), batch.column("n").to_numpy()
            keys = batch.column("key").to_pylist()
            if (kinds == WORD).any():
                add_words(sent.value, tables, [k for k, kind in zip(keys, kinds) if kind == WORD], n[kinds == WORD])
            if (kinds == FIRST).any():
                add_firsts(sent.value, tables, np.array([int.from_bytes(k, "big") for k, kind in zip(keys, kinds) if kind == FIRST], np.int64), n[kinds == FIRST])
        for k, table in enumerate(tables):
            for part, sums in enumerate(table.reshape(-1, 2 << PART_BITS)):
                at = np.flatnonzero(sums).astype(np.uint16)
                if len(at):
                    sums = sums.astype(np.uint32) if sums.max() < 1 << 32 else sums
                    # few counts come with their places
                    at, sums = (at, sums[at]) if len(at) < len(sums) // 2 else (at[:0], sums)
                    columns = [pa.array([x], t) for x, t in ((k, pa.int32()), (part, pa.int32()), (at.tobytes(), pa.binary()), (sums.itemsize, pa.int32()), (sums.tobytes(), pa.binary()))]
                    yield pa.RecordBatch.from_arrays(columns, names=["k", "part", "at", "width", "sums"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None

        def done() -> pa.RecordBatch:
            columns = [pa.array([now[0]], pa.int32()), pa.array([now[1]], pa.int32()), pa.array([log_odds(total).tobytes()], pa.binary())]
            columns.append(pa.array([gates(total).tobytes() if now[0] == 3 else b""], pa.binary()))
            return pa.RecordBatch.from_arrays(columns, names=["k", "part", "odds", "seen"])

        for batch in batches:
            for k, part, at, width, sums in zip(*(batch.column(c) for c in ("k", "part", "at", "width", "sums"))):
                if (k.as_py(), part.as_py()) != now:
                    if now is not None:
                        yield done()
                    now, total = (k.as_py(), part.as_py()), np.zeros(2 << PART_BITS, np.int64)
                at, sums = np.frombuffer(at.as_py(), np.uint16), np.frombuffer(sums.as_py(), np.uint32 if width.as_py() == 4 else np.int64)
                if len(at):
                    total[at] += sums
                else:
                    total += sums
        if now is not None:
            yield done()

    parts = counts.repartition(-(-max(words, 1) // LEARN_WORDS), "kind", "key").mapInArrow(filled, "k int, part int, at binary, width int, sums binary")
    rows = parts.repartition("k", "part").sortWithinPartitions("k", "part").mapInArrow(merged, "k int, part int, odds binary, seen binary").collect()
    tables, seen = [np.zeros(1 << b, np.int8) for b in TABLE_BITS], np.zeros(1 << TABLE_BITS[3], np.int8)
    for row in rows:
        at = slice(row["part"] << PART_BITS, (row["part"] + 1) << PART_BITS)
        tables[row["k"]][at] = np.frombuffer(row["odds"], np.int8)
        if row["k"] == 3:
            seen[at] = np.frombuffer(row["seen"], np.int8)
    return tables, seen


SCORED = pa.schema([
    ("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("known", pa.int64()),
    ("logs", pa.float64()), ("score", pa.float64()), ("rare", pa.list_(pa.binary())),
])
SCORED_SQL = "row long, doc_id long, held_out boolean, n_bytes long, n_tokens long, known long, logs double, score double, rare array<binary>"


def scored_batches(model: Model, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Scores of the texts, with logs and numbers of their hot words; the other words are handed on."""
    for batch in small_batches(batches, DOCS):
        texts = batch_texts(batch)
        ids = list(zip(*(batch.column(c).to_pylist() for c in ("row", "doc_id", "held_out"))))
        sums = np.zeros((len(texts), 5))  # bytes, tokens, known words, logs, score
        rare: list[list[bytes]] = [[] for _ in texts]
        parts: list[list[bytes]] = []
        owners: list[int] = []
        size = 0

        def flush() -> None:
            nonlocal size
            scores, hot = model.score(parts)
            lens = np.fromiter(map(len, parts), np.int64, len(parts))
            owner = np.repeat(owners, lens)
            there = hot >= 0
            np.add.at(sums[:, 1], owners, lens)
            np.add.at(sums[:, 2], owner[there], 1)
            np.add.at(sums[:, 3], owner[there], np.log10(hot[there] + 1))
            np.add.at(sums[:, 4], owners, scores)
            words = list(chain.from_iterable(parts))
            others = np.flatnonzero(~there)
            for i, k in zip(others.tolist(), owner[others].tolist()):
                rare[k].append(words[i])
            parts.clear()
            owners.clear()
            size = 0

        for i, text in enumerate(texts):
            blocks = byte_blocks(text)
            for block in blocks:
                sums[i, 0] += len(block)
                parts.append(block.split())
                owners.append(i)
                size += len(block)
                if size > SLICE_BYTES:
                    flush()
            if not parts:
                parts.append([])
                owners.append(i)
            parts[-1].append(END)
        if parts:
            flush()
        columns = [*zip(*ids)] if ids else [[], [], []]
        numbers = [sums[:, 0].astype(np.int64), sums[:, 1].astype(np.int64), sums[:, 2].astype(np.int64), sums[:, 3], sums[:, 4]]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip([*columns, *numbers, rare], SCORED)], schema=SCORED)


def is_held_out(ident: Column, folds: int = FOLDS, fold: int = HELD_OUT) -> Column:
    """Whether a document is left out of the training, by crc32 of its id as text (null: empty)."""
    return F.crc32(F.coalesce(ident.cast("string"), F.lit(""))) % folds == fold


def score_texts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", held_out: Column | None = None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte), a row for each row of `docs`.

    `score` is the model's log10 probability of the text's words and end, `base_score` that of smoothed word counts. A null text is empty and
    has the end alone, rows of an id are scored one by one, a null id is trained on, other columns stay out. Without training texts all counts are 0.
    """
    spark = docs.sparkSession
    rows = text_rows(docs, id_column, text_column)
    rows = rows.withColumn("held_out", is_held_out(F.col("doc_id")) if held_out is None else held_out)
    counts = written(gathered(rows.filter("NOT held_out")), "mixing-counts")
    words = counts.filter(F.col("kind") == WORD).select("key", "n")
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    bytes_seen = byte_counts(counts)
    tables, seen = fitted_tables(counts, distinct, Code(bytes_seen))
    short = words.filter(F.octet_length("key") <= HOT_BYTES)
    # the least number at which no more than HOT_WORDS words are as frequent; one row for each distinct number
    sizes = short.groupBy("n").agg(F.count(F.lit(1)).alias("words")).withColumn("upto", F.sum("words").over(W.orderBy(F.desc("n"))))
    least = sizes.filter(F.col("upto") <= HOT_WORDS).agg(F.min("n")).first()[0]
    top = short.filter(F.col("n") >= least).collect() if least is not None else []
    sent = spark.sparkContext.broadcast((bytes_seen, tables, seen, {bytes(r["key"]): r["n"] for r in top}))
    name = uuid.uuid4().hex

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from scored_batches(held(("mixing", name), lambda: Model(*sent.value)), batches)

    numbered = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text", "held_out")
    found = written(numbered.mapInArrow(scored, SCORED_SQL), "mixing-scores")
    others = attach_table(found.select("row", F.explode("rare").alias("key")), ["key"], words, ["n"], "n")
    others = others.groupBy("row").agg(F.count("n").alias("more"), F.sum(F.log10(F.coalesce("n", F.lit(0)) + 1)).alias("more_logs"))
    known = F.col("known") + F.coalesce("more", F.lit(0))
    base = F.col("logs") + F.coalesce("more_logs", F.lit(0.0)) - F.col("n_tokens") * log10(total + distinct + 1)
    bits = -F.col("score") * (log(10) / log(2)) / F.greatest("n_bytes", F.lit(1))
    return found.drop("rare").join(others, "row", "left").select(
        "doc_id", "held_out", "n_tokens", known.alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), "score", bits.alias("bits_per_byte")
    )
