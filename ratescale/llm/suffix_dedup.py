"""Removal of long repeated byte strings by prefix doubling on sampled positions.

Doubling over every position would sort 16 bytes for each byte of text in each round. A string of `length` bytes has
`length - CORE + 1` places for a core of CORE bytes, and the place of the core with the smallest hash depends on the string alone.
So the window starts of a document fall into runs with one such core each, and equal windows lie in runs with equal cores. The
rounds rank runs and windows at growing lengths, and what is unique leaves:

1. the cores, at one position for each run;
2. whole runs, the text from the first window's start to the last one's end: if it occurs twice, all its windows do;
3. of the runs that are left, parts of `PART` windows, which lie at fixed distances from the core: first the text that all
   windows of the part share, then the text of the whole part;
4. the single windows of the parts that are left, as pairs of the ranks of their first half and of the half at the offset length / 2.

From round 2 on, one run of each kind goes on, and only where its core also has a run that is unique.
Ranks are 64-bit hashes, of which only equality counts.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratescale.llm.common import text_rows, written

LENGTH, CORE = 200, 48
PART = 8  # window starts of a part
BUFFER = 1 << 20  # bytes hashed together
INDEX_BITS = 22
PART_BITS = 36  # a document's key: partition, and bytes before it in the partition


def _hash_constants(seed: int = 0x9E3779B97F4A7C15) -> tuple[np.ndarray, np.uint64, np.uint64]:
    """A 64-bit number for each byte value, an odd base and its inverse modulo 2 ** 64."""
    letters = np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    base = 0xD1342543DE82EF95
    return letters, np.uint64(base), np.uint64(pow(base, -1, 1 << 64))


LETTERS, BASE, INVERSE = _hash_constants()
_POWERS: list[np.ndarray] = []


def powers() -> list[np.ndarray]:
    """Powers of the base and of its inverse, for one buffer."""
    if not _POWERS:
        for x in (BASE, INVERSE):
            p = np.full(BUFFER + 1, x, np.uint64)
            p[0] = 1
            _POWERS.append(np.multiply.accumulate(p))
    return _POWERS


class Hashes:
    """Hash of any substring of a buffer, equal for equal strings at any place."""

    def __init__(self, data: np.ndarray):
        up, _ = powers()
        self.before = np.concatenate((np.zeros(1, np.uint64), np.cumsum(LETTERS[data] * up[:len(data)], dtype=np.uint64)))

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self.before[end] - self.before[start]) * powers()[1][start]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(29))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each `width` consecutive values, from running minima of blocks forwards and backwards."""
    n = len(values)
    padded = np.pad(values, (0, -n % width), constant_values=np.iinfo(values.dtype).max).reshape(-1, width)
    forward = np.minimum.accumulate(padded, axis=1).ravel()
    backward = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[:n - width + 1], forward[width - 1:n])


def packed_run(first: np.ndarray, final: np.ndarray, core: np.ndarray) -> np.ndarray:
    """A run as one number: first window start, further starts (8 bits), distance of the core from the first start (8 bits)."""
    return first << 16 | (final - first) << 8 | core - first


def runs_of(data: np.ndarray, doc_starts: np.ndarray, doc_ends: np.ndarray, length: int, core: int) -> tuple[np.ndarray, ...]:
    """Runs of window starts with one core each: first and last start, place of the core, its hash, hash of the whole run."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none, none
    hashes = Hashes(data)
    at = np.arange(len(data) - core + 1)
    width = length - core + 1
    ranked = hashes.of(at, at + core)
    mask = np.uint64((1 << INDEX_BITS) - 1)
    least = (sliding_min((ranked & ~mask) | at.astype(np.uint64), width) & mask).astype(np.int64)
    inside = np.zeros(len(data) + 1, np.int64)  # window starts whose window lies in one document
    last = np.maximum(doc_ends - length + 1, doc_starts)
    np.add.at(inside, doc_starts, 1)
    np.add.at(inside, last, -1)
    inside = np.cumsum(inside)[:len(least)] > 0
    change = np.append(True, (least[1:] != least[:-1]) | (inside[1:] != inside[:-1]))
    change[doc_starts[doc_starts < len(change)]] = True
    first = np.flatnonzero(change)
    final = np.append(first[1:], len(least)) - 1
    first, final = first[inside[first]], final[inside[first]]
    return first, final, least[first], ranked[least[first]], hashes.of(first, final + length)


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key = TaskContext.get().partitionId() << PART_BITS
    for batch in batches:
        keys, raws, sizes = [], [], []
        for text in batch.column("text").to_pylist():
            raw = (text or "").encode()
            keys.append(key)
            sizes.append(len(raw))
            raws.append(zlib.compress(raw, 1))
            key += len(raw) + 1
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(raws, pa.binary())], names=["doc", "doc_id", "n_bytes", "raw"])


def _buffers(batch: pa.RecordBatch, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Documents of at least `length` bytes in buffers: bytes, starts and ends, document keys and offsets in the document.

    A document longer than a buffer is cut so that each window start is in one piece.
    """
    pieces: list[tuple[int, int, bytes]] = []
    held = 0

    def joined():
        sizes = np.array([len(p[2]) for p in pieces], np.int64)
        ends = np.cumsum(sizes)
        return np.frombuffer(b"".join(p[2] for p in pieces), np.uint8), ends - sizes, ends, np.array([p[0] for p in pieces], np.int64), np.array([p[1] for p in pieces], np.int64)

    for doc, size, packed in zip(batch.column("doc").to_pylist(), batch.column("n_bytes").to_pylist(), batch.column("raw").to_pylist()):
        if size < length:
            continue
        raw = zlib.decompress(packed)
        step = BUFFER - length + 1
        for at in range(0, size - length + 1, step):
            piece = raw[at:at + BUFFER]
            if held + len(piece) > BUFFER:
                yield joined()
                pieces, held = [], 0
            pieces.append((doc, at, piece))
            held += len(piece)
    if pieces:
        yield joined()


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.astype(np.uint64).view(np.int64))


def _runs(length: int, core: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, starts, ends, docs, offsets in _buffers(batch, length):
                first, final, place, cores, hulls = runs_of(data, starts, ends, length, core)
                mine = np.searchsorted(starts, first, side="right") - 1
                shift = offsets[mine] - starts[mine]
                columns = [pa.array(docs[mine]), pa.array(packed_run(first + shift, final + shift, place + shift)), _signed(cores), _signed(hulls)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc", "run", "core", "hull"])

    return run


def parts_of(codes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs cut into parts of `width` window starts at fixed distances from the core: first and last start, core, number of the part."""
    first, more, core = codes >> 16, (codes >> 8) & 255, codes & 255
    # the part of a start is its distance from the core, divided by the width
    low, high = (core - more) // width, core // width
    n = high - low + 1
    ends = np.cumsum(n)
    number = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(low - (ends - n), n)
    first, last, place = np.repeat(first, n), np.repeat(first + more, n), np.repeat(first + core, n)
    return np.maximum(first, place - number * width - width + 1), np.minimum(last, place - number * width), place, number


def _parts(length: int, width: int):
    """Parts of the runs that are asked for, with the rank of what their windows share and of all their text; for single windows the halves' ranks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        half = length // 2
        for batch in batches:
            for doc, packed, wanted in zip(*[batch.column(c).to_pylist() for c in ("doc", "raw", "wanted")]):
                data = np.frombuffer(zlib.decompress(packed), np.uint8)
                codes = np.sort(np.array(wanted, np.int64))
                piece = (codes >> 16) // (BUFFER // 2)  # a run and its text lie in one stretch of a buffer's length
                for p in np.unique(piece).tolist():
                    low = p * (BUFFER // 2)
                    first, last, place, number = (x - low if k < 3 else x for k, x in enumerate(parts_of(codes[piece == p], width)))
                    hashes = Hashes(data[low:low + BUFFER])
                    if width == 1:
                        core, hull = hashes.of(first, first + half), hashes.of(first + length - half, first + length)
                    else:
                        shared = place - number * width
                        core, hull = hashes.of(shared, shared + length - width + 1), hashes.of(first, last + length)
                    columns = [pa.array(np.full(len(first), doc, np.int64)), pa.array(packed_run(first + low, last + low, place + low)), _signed(core), _signed(hull)]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc", "run", "core", "hull"])

    return run


def removed_runs(codes: list[int] | None, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal removed stretches from runs of repeated windows (as `packed_run` makes them)."""
    if not codes:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = np.sort(np.array(codes, np.int64))
    starts = code >> 16
    ends = np.maximum.accumulate(starts + ((code >> 8) & 255) + length)
    new = np.append(True, starts[1:] > ends[:-1])
    return starts[new], ends[np.append(np.flatnonzero(new)[1:], len(ends)) - 1]


def _cut(length: int, keep: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for packed, codes in zip(batch.column("raw").to_pylist(), batch.column("codes").to_pylist()):
                raw = zlib.decompress(packed)
                starts, ends = removed_runs(codes, length)
                bounds = [0, *np.stack((starts, ends), axis=1).ravel().tolist(), len(raw)]
                kept = b"".join(raw[a:b] for a, b in zip(bounds[::2], bounds[1::2]))
                spans = [{"start": a, "end": b} for a, b in zip(starts.tolist(), ends.tolist())]
                out.append((len(raw), int((ends - starts).sum()), spans, hashlib.sha256(kept).hexdigest(), kept if keep else None))
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            columns = [pa.array(c, t) for c, t in zip(zip(*out), [pa.int64(), pa.int64(), span, pa.string(), pa.binary()])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", "n_bytes", "n_removed", "spans", "kept_sha256", "kept"])

    return run


RUNS = "doc long, run long, core long, hull long"


def repeated_runs(stored: DataFrame, length: int = LENGTH, core: int = CORE, width: int = PART) -> DataFrame:
    """(doc, run): runs of window starts whose windows occur elsewhere too."""
    runs = written(stored.select("doc", "n_bytes", "raw").mapInArrow(_runs(length, core), RUNS), "runs")
    whole, asked = _ranked(runs)
    parts = written(_asked_parts(stored, asked, length, width), "parts")
    some, asked = _ranked(parts)
    windows = written(_asked_parts(stored, asked, length, 1), "windows")
    again = windows.groupBy("core", "hull").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("core", "hull")
    single = windows.join(again, ["core", "hull"], "left_semi").select("doc", "run")
    return whole.unionByName(some).unionByName(single)


def _asked_parts(stored: DataFrame, asked: DataFrame, length: int, width: int) -> DataFrame:
    wanted = asked.groupBy("doc").agg(F.collect_list("run").alias("wanted"))
    return stored.select("doc", "raw").join(wanted, "doc").mapInArrow(_parts(length, width), RUNS)


def _ranked(runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Runs that occur twice as a whole; and one run of each kind, of the cores that also have a run of which there is one alone."""
    twice = runs.groupBy("core").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("core")
    left = written(runs.join(twice, "core", "left_semi"), "runs-left")
    kinds = left.groupBy("core", "hull").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc", "run")).alias("one"))
    kinds = written(kinds.select("core", "hull", "n", "one.doc", "one.run"), "run-kinds")
    whole = left.join(kinds.filter("n > 1").select("core", "hull"), ["core", "hull"], "left_semi").select("doc", "run")
    mixed = kinds.groupBy("core").agg(F.min("n").alias("least"), F.count(F.lit(1)).alias("kinds")).filter("least = 1 AND kinds > 1")
    return whole, kinds.join(mixed.select("core"), "core", "left_semi").select("doc", "run")


def remove_repeats(docs: DataFrame, length: int = LENGTH, with_text: bool = False, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (bytes), kept_sha256 and, if asked, kept: each whole text without its repeated strings.

    A byte goes if a string of `length` bytes over it also starts anywhere else, in any document, as judged on the input. Null
    texts are empty. Texts shorter than `length` stay. Null or repeated ids and repeated rows are documents of their own (a repeated row
    of at least `length` bytes is a repeat), other columns are left out, an empty table gives no rows.
    """
    if not CORE < length <= CORE + 255:
        raise ValueError(f"length must lie between {CORE + 1} and {CORE + 255}")
    stored = written(text_rows(docs, id_column, text_column).mapInArrow(_stored, "doc long, doc_id long, n_bytes long, raw binary"), "stored")
    codes = repeated_runs(stored, length).groupBy("doc").agg(F.collect_list("run").alias("codes"))
    out = "doc_id long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept_sha256 string, kept binary"
    cut = stored.join(codes, "doc", "left").select("doc_id", "raw", "codes").mapInArrow(_cut(length, with_text), out)
    return cut if with_text else cut.drop("kept")
