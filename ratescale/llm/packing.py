"""Best-fit packing of tokenized documents into sequences, with certified bin counts and repacking across partitions."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratescale.llm.common import batch_texts, encoder, text_rows, written

CAPACITY = 2048
GROUP_ITEMS = 100_000  # items that one task packs; more make more tasks
OTHER_BINS = 4  # bins that go to the exchange with each of the emptiest ones

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """A number of bins that no packing can go below, from a histogram of lengths 0..capacity, by dual-feasible functions.

    f(x) = x gives the bound by volume; the threshold functions round lengths above capacity - t up to a whole bin and drop
    those below t; u_k rounds to multiples of 1/k (x stays if (k + 1) x is a whole number).
    """
    x = np.arange(capacity + 1, dtype=np.int64)
    n = counts.astype(np.int64)
    best = -(-int((n * x).sum()) // capacity)
    numbers, volume = np.cumsum(n), np.cumsum(n * x)
    for t in range(1, capacity // 2 + 1):
        big = int(numbers[-1] - numbers[capacity - t])
        middle = int(volume[capacity - t] - volume[t - 1])
        best = max(best, big + -(-middle // capacity))
    for k in range(1, 101):
        whole = (x * (k + 1)) % capacity == 0
        value = np.where(whole, x * k, (x * (k + 1) // capacity) * capacity)  # times k * capacity
        best = max(best, -(-int((n * value).sum()) // (k * capacity)))
    return best


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: bin and offset of each item, and the fill of each bin. Open gaps are the bits of one integer."""
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    gaps, open_bins = 0, [[] for _ in range(capacity + 1)]
    fill: list[int] = []
    for i, length in zip((order := np.argsort(-lengths, kind="stable")).tolist(), lengths[order].tolist()):
        fitting = gaps >> length
        if fitting:
            gap = length + (fitting & -fitting).bit_length() - 1
            b = open_bins[gap].pop()
            if not open_bins[gap]:
                gaps ^= 1 << gap
        else:
            b, gap = len(fill), capacity
            fill.append(0)
        bins[i], offsets[i] = b, fill[b]
        fill[b] += length
        if left := gap - length:
            if not open_bins[left]:
                gaps |= 1 << left
            open_bins[left].append(b)
    return bins, offsets, np.array(fill, np.int64)


def _pieces(file: str, end_id: int, capacity: int, keep: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(file)
        for batch in batches:
            keys = batch.column("doc_id").to_pylist()
            for first, flat, sizes in enc.encode(batch_texts(batch)):
                out: list[tuple] = []
                for k, (end, size) in enumerate(zip(np.cumsum(sizes).tolist(), sizes.tolist())):
                    ids = np.append(flat[end - size:end], np.uint32(end_id)).astype("<u4")
                    at, cut = 0, len(ids) % capacity or capacity
                    piece = 0
                    while at < len(ids):
                        raw = ids[at:cut].tobytes()
                        out.append((keys[first + k], piece, at, cut - at, zlib.crc32(raw), raw if keep else None))
                        at, cut, piece = cut, cut + capacity, piece + 1
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

    return run


def _pack_group(capacity: int, round_no: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        lengths = rows["length"].to_numpy(np.int64)
        bins, offsets, fill = best_fit(lengths, capacity)
        bound = lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
        number = ((round_no << 20) + int(key[0]) << 32) + bins
        # to the exchange go the emptiest bins, one more than the gap, and for each of them some of the most and so smallest items
        gap = len(fill) - bound
        give = np.zeros(len(fill), bool)
        emptiest = np.argsort(fill, kind="stable")[:gap + 1]
        emptiest = emptiest[fill[emptiest] < capacity]
        give[emptiest] = True
        others = np.flatnonzero(~give)
        give[others[np.argsort(-np.bincount(bins)[others], kind="stable")][:OTHER_BINS * len(emptiest)]] = True
        return pd.DataFrame({"item": rows["item"], "length": lengths, "sequence_id": number, "offset": offsets, "give": give[bins], "gap": gap})

    return run


PACKED = "item long, length long, sequence_id long, offset long, give boolean, gap long"


def place(items: DataFrame, capacity: int = CAPACITY, group_items: int = GROUP_ITEMS) -> DataFrame:
    """Sequence and offset of every item (`item` unique, `length` 1..capacity) in as few sequences as can be found.

    Items are dealt at random to groups of about `group_items`. Each is packed by best-fit decreasing and certified: `gap` is its bin
    count less its lower bound. A group at its bound can still be above its share of the bound of the whole histogram, as it rounds up.
    So while the total is above that bound, all groups give up their emptiest bins and some of many items (more where `gap` is above 0),
    and these items are dealt anew over the fewest groups that hold them. A round that gains nothing is dropped and ends the search.
    """
    histogram = np.zeros(capacity + 1, np.int64)
    for length, n in items.groupBy("length").count().collect():  # at most `capacity` rows
        histogram[length] = n
    bound, left = lower_bound(histogram, capacity), int(histogram.sum())
    settled = items.select("item", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset")).limit(0)
    closed, round_no, rest, given_up = 0, 0, items.select("item", "length"), None
    while left:
        groups = -(-left // group_items)
        dealt = rest.withColumn("group", F.pmod(F.xxhash64("item", F.lit(round_no)), F.lit(groups)).cast("int"))
        packed = written(dealt.groupBy("group").applyInPandas(_pack_group(capacity, round_no), PACKED), f"packed-{round_no}")
        bins = packed.filter("offset = 0").count()
        if given_up is not None and bins >= given_up[1]:
            packed, bins = given_up
            break
        if closed + bins <= bound or (given_up is not None and groups == 1):
            break
        kept = packed.filter("NOT give")
        settled = settled.unionByName(kept.select("item", "sequence_id", "offset"))
        closed += kept.filter("offset = 0").count()
        moved = packed.filter("give")
        given_up = (moved, moved.filter("offset = 0").count())
        rest, left, round_no = moved.select("item", "length"), moved.count(), round_no + 1
    if not int(histogram.sum()):
        return settled
    return settled.unionByName(packed.select("item", "sequence_id", "offset"))


def pack(
    docs: DataFrame, file: str, capacity: int = CAPACITY, end_id: int = 0, with_ids: bool = False, id_column: str = "doc_id",
    text_column: str = "text", group_items: int = GROUP_ITEMS,
) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset and, if asked, ids (little-endian 32 bit).

    A document is the ids of its whole text (null: empty) and the end id, so none is empty. Only longer ones than `capacity` are
    cut, into whole sequences; their first piece is what is left over. Null or repeated ids are documents of their own, other
    columns are left out, an empty table gives no rows.
    """
    pieces = text_rows(docs, id_column, text_column).mapInArrow(_pieces(file, end_id, capacity, with_ids), PIECES)
    pieces = written(pieces.withColumn("item", F.monotonically_increasing_id()), "pieces")
    whole = pieces.filter(F.col("length") == capacity)
    placed = place(pieces.filter(F.col("length") < capacity).select("item", "length"), capacity, group_items)
    columns = [F.col(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *(["ids"] if with_ids else []))]
    # whole pieces are sequences of their own; packed sequences are numbered from 2 ** 60
    alone = whole.select("*", F.col("item").alias("sequence_id"), F.lit(0).cast("long").alias("offset")).select(*columns)
    short = pieces.filter(F.col("length") < capacity).join(placed, "item")
    return alone.unionByName(short.withColumn("sequence_id", F.col("sequence_id") + F.lit(1 << 60)).select(*columns))
