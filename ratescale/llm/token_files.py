"""Token ids as coded files: range asymmetric numeral system (rANS) with one shared table and independent blocks.

File format: a Parquet table with a row for each block. `part`, `block`: place in the order of the documents. `before`: ids of
the part before the block. `doc_ids`, `lens`: its documents. `lanes`: id i belongs to lane i mod lanes; the lanes' coders are
independent and their 32-bit words interleave in `words`. `checkpoints`: from each of them decoding can begin: (step, words read,
lane states). `crc32`: of the ids as little-endian 32-bit integers. The table of frequencies lies in a second Parquet table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratescale.llm.common import batch_texts, encoder, text_rows, written
from ratescale.session import shared_folder

BITS = 18  # the frequencies add up to 2 ** BITS
LOW = np.uint64(1 << 31)  # lane states stay in [LOW, LOW << 32)
LANES = 1024
BLOCK_IDS = 1 << 20  # a block is closed after the document that fills it
CHECKPOINT_STEPS = 256

RAW = "part int, block int, before long, doc_ids array<long>, lens array<long>, symbols binary, counts binary"
FILE = "part int, block int, before long, doc_ids array<long>, lens array<long>, lanes int, n long, words binary, checkpoints array<struct<step:long,word:long,states:binary>>, crc32 long"


def shared_table(symbols: np.ndarray, counts: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Frequencies in proportion to the counts, at least 1 for a symbol that occurs, adding up to 2 ** bits."""
    total, size = int(counts.sum()), 1 << bits
    freq = np.maximum(1, counts * (size - len(symbols)) // max(total, 1))
    order = np.argsort(-counts, kind="stable")
    over = int(freq.sum()) - size
    if over < 0 and len(order):
        freq[order[0]] -= over
    for i in order:
        if over <= 0:
            break
        cut = min(over, int(freq[i]) - 1)
        freq[i] -= cut
        over -= cut
    out = np.zeros(int(symbols.max()) + 1 if len(symbols) else 1, np.uint32)
    out[symbols] = freq
    return out


class Coder:
    """Encodes and decodes blocks of ids with one table."""

    def __init__(self, freq: np.ndarray, bits: int = BITS):
        self.bits, self.freq = np.uint64(bits), freq.astype(np.uint64)
        self.base = np.concatenate(([0], np.cumsum(freq, dtype=np.uint64)[:-1])).astype(np.uint64)
        self.slots = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)

    def encode(self, ids: np.ndarray, lanes: int = LANES) -> tuple[bytes, list[tuple[int, int, bytes]]]:
        steps = -(-len(ids) // lanes)
        states = np.full(lanes, LOW, np.uint64)
        groups: list[np.ndarray] = []
        saved, emitted = [], 0
        room = np.uint64(63) - self.bits
        for step in range(steps - 1, -1, -1):
            s = ids[step * lanes:(step + 1) * lanes]
            x = states[:len(s)]
            f = self.freq[s]
            full = x >= (f << room)
            if full.any():
                groups.append(x[full].astype(np.uint32))  # the low 32 bits
                emitted += len(groups[-1])
                x = np.where(full, x >> np.uint64(32), x)
            states[:len(s)] = ((x // f) << self.bits) + x % f + self.base[s]
            if step % CHECKPOINT_STEPS == 0:
                saved.append((step, emitted, states.tobytes()))
        words = np.concatenate(groups[::-1]) if groups else np.zeros(0, np.uint32)
        return words.astype("<u4").tobytes(), [(step, len(words) - n, x) for step, n, x in saved[::-1]]

    def decode(self, words: bytes, checkpoints: list, n: int, lanes: int = LANES, first: int = 0, last: int | None = None) -> np.ndarray:
        """The ids from checkpoint `first` up to checkpoint `last` (None: the end)."""
        if not n:
            return np.zeros(0, np.uint32)
        step, at, state = checkpoints[first]
        stop = -(-n // lanes) if last is None or last >= len(checkpoints) else checkpoints[last][0]
        words, states = np.frombuffer(words, "<u4"), np.frombuffer(state, np.uint64).copy()
        out = np.empty(min(n, stop * lanes) - step * lanes, np.uint32)
        mask, place = np.uint64((1 << int(self.bits)) - 1), 0
        for k in range(step, stop):
            m = min(lanes, n - k * lanes)
            x = states[:m]
            slot = x & mask
            s = self.slots[slot]
            x = self.freq[s] * (x >> self.bits) + slot - self.base[s]
            low = np.flatnonzero(x < LOW)
            if len(low):
                x[low] = (x[low] << np.uint64(32)) | words[at:at + len(low)]
                at += len(low)
            states[:m] = x
            out[place:place + m] = s
            place += m
        return out


def _raw_blocks(file: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(file), TaskContext.get().partitionId()
        counts, block, before, held = np.zeros(end_id + 1, np.int64), 0, 0, 0
        ids: list[np.ndarray] = []
        docs: list[int | None] = []
        lens: list[int] = []
        closing = np.array([end_id], np.uint32)

        def row(symbols: bytes, freq: bytes | None = None) -> pa.RecordBatch:
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
            names = ["part", "block", "before", "doc_ids", "lens", "symbols", "counts"]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip([part, block, before, docs, lens, symbols, freq], kinds)], names=names)

        def closed() -> pa.RecordBatch:
            nonlocal counts
            joined = np.concatenate(ids)
            found = np.bincount(joined, minlength=len(counts))
            counts = found + np.pad(counts, (0, len(found) - len(counts)))
            return row(joined.astype("<u4" if int(joined.max()) > 65535 else "<u2").tobytes())

        for batch in batches:
            keys = batch.column("doc_id").to_pylist()
            for first, flat, sizes in enc.encode(batch_texts(batch)):
                for k, (end, size) in enumerate(zip(np.cumsum(sizes).tolist(), sizes.tolist())):
                    ids += flat[end - size:end], closing
                    docs.append(keys[first + k])
                    lens.append(size + 1)
                    held += size + 1
                    if held >= BLOCK_IDS:
                        yield closed()
                        block, before, held, ids, docs, lens = block + 1, before + held, 0, [], [], []
        if docs:
            yield closed()
            block, before, docs, lens = block + 1, before + held, [], []
        if block:
            block = -1
            yield row(b"", counts.astype("<i8").tobytes())

    return run


def _encode_blocks(freq: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(np.frombuffer(freq, np.uint32))
        point = pa.struct([("step", pa.int64()), ("word", pa.int64()), ("states", pa.binary())])
        for batch in batches:
            for r in range(batch.num_rows):
                one = batch.slice(r, 1)
                n = sum(one.column("lens")[0].as_py())
                raw = one.column("symbols")[0].as_py()
                ids = np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4")
                words, points = coder.encode(ids)
                values = [[LANES], [n], [words], [[dict(zip(("step", "word", "states"), p)) for p in points]], [zlib.crc32(ids.astype("<u4").tobytes())]]
                added = [pa.array(v, t) for v, t in zip(values, [pa.int32(), pa.int64(), pa.binary(), pa.list_(point), pa.int64()])]
                names = ["part", "block", "before", "doc_ids", "lens"]
                yield pa.RecordBatch.from_arrays([*[one.column(c) for c in names], *added], names=[*names, "lanes", "n", "words", "checkpoints", "crc32"])

    return run


def write_token_files(docs: DataFrame, file: str, path: str, end_id: int = 1, id_column: str = "doc_id", text_column: str = "text") -> None:
    """Encode whole texts and write them to `path`/blocks, `path`/table and `path`/parts, in ascending id order.

    Null texts are empty and hold the end id alone; null ids come first; rows with one id are ordered by text. Other columns are
    left out. An empty table gives files without rows. Two passes: ids and counts, then the coding with the shared table.
    """
    spark = docs.sparkSession
    rows = text_rows(docs, id_column, text_column)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    raw = written(ordered.mapInArrow(_raw_blocks(file, end_id), RAW), "token-blocks")
    totals = raw.filter("block < 0").select("part", F.col("before").alias("ids"), "counts")

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(0, np.int64)
        for batch in batches:
            for c in batch.column("counts").to_pylist():
                own = np.frombuffer(c, "<i8")
                size = max(len(own), len(counts))
                counts = np.pad(counts, (0, size - len(counts))) + np.pad(own, (0, size - len(own)))
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(counts[used], pa.int64())], names=["symbol", "n"])

    # at most a row for each id of the vocabulary
    counts = totals.select("counts").mapInArrow(summed, "symbol long, n long").groupBy("symbol").agg(F.sum("n").alias("n")).orderBy("symbol").toPandas()
    freq = shared_table(counts["symbol"].to_numpy(np.int64), counts["n"].to_numpy(np.int64))
    raw.filter("block >= 0").drop("counts").mapInArrow(_encode_blocks(freq.tobytes()), FILE).write.parquet(f"{path}/blocks")
    spark.createDataFrame([(BITS, freq.tobytes())], "bits int, frequencies binary").write.parquet(f"{path}/table")
    # the offsets of the parts: one number for each partition of the sort
    part_rows, at = [], 0
    for part, ids in totals.select("part", "ids").orderBy("part").collect():
        part_rows.append((part, at))
        at += ids
    spark.createDataFrame(part_rows, "part int, start long").write.parquet(f"{path}/parts")


def _decode_blocks(freq: bytes, bits: int, starts: dict[int, int], keep: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(np.frombuffer(freq, np.uint32), bits)
        for batch in batches:
            for row in batch.to_pylist():
                points = [(p["step"], p["word"], p["states"]) for p in row["checkpoints"]]
                ids = coder.decode(row["words"], points, row["n"], row["lanes"]).astype("<u4")
                raw = ids.tobytes()
                if zlib.crc32(raw) != row["crc32"]:
                    raise ValueError(f"block {row['block']} of part {row['part']} is damaged")
                lens = np.array(row["lens"], np.int64)
                ends = np.cumsum(lens)
                first = starts[row["part"]] + row["before"]
                view = memoryview(raw)
                pieces = [view[4 * (e - s):4 * e] for e, s in zip(ends.tolist(), lens.tolist())]
                columns = [pa.array(row["doc_ids"], pa.int64()), pa.array(first + ends - lens), pa.array(lens), pa.array([zlib.crc32(p) for p in pieces], pa.int64())]
                columns.append(pa.array([bytes(p) for p in pieces] if keep else [None] * len(lens), pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"])

    return run


def read_token_files(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids_crc32 and, if asked, the ids as little-endian 32-bit integers."""
    bits, freq = spark.read.parquet(f"{path}/table").first()
    starts = {r["part"]: r["start"] for r in spark.read.parquet(f"{path}/parts").collect()}
    out = "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary"
    return spark.read.parquet(f"{path}/blocks").mapInArrow(_decode_blocks(bytes(freq), bits, starts, with_ids), out)


def round_trip(docs: DataFrame, file: str, end_id: int = 1) -> DataFrame:
    """Write the files to the shared folder and read them back: a row for each document."""
    path = shared_folder(docs.sparkSession, "token-files")
    write_token_files(docs, file, path, end_id)
    return read_token_files(docs.sparkSession, path, with_ids=False).drop("ids")
