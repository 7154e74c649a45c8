"""Benchmark decontamination: test phrases are searched in an FM-index of each training shard."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratescale.llm.common import held, slices, text_rows

WINDOW = 10
SHARD_CHARS = 16 << 20  # text of one index
PHRASE_BYTES = 8 << 20  # benchmark text of one broadcast block
SAMPLE = 16  # every 16th suffix position is kept
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words_of(text: str | None) -> list[bytes]:
    return WORD.findall((text or "").encode().lower())  # bytes: only A-Z change


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Suffix order by prefix doubling; only suffixes that still share their rank are sorted again."""
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    sorted_symbols = symbols[order]
    starts = np.flatnonzero(np.append(True, sorted_symbols[1:] != sorted_symbols[:-1]))
    sizes = np.diff(np.append(starts, n))
    rank = np.empty(n + 1, np.int64)
    rank[order] = np.repeat(starts, sizes)
    rank[n] = -1
    open_places = order[np.repeat(sizes > 1, sizes)]
    h = 1
    while len(open_places):
        old, follow = rank[open_places], rank[np.minimum(open_places + h, n)]
        by = np.lexsort((follow, old))
        open_places, old, follow = open_places[by], old[by], follow[by]
        new_group = np.append(True, old[1:] != old[:-1])
        new_key = new_group | np.append(True, follow[1:] != follow[:-1])
        at = np.arange(len(old))
        group_first = np.maximum.accumulate(np.where(new_group, at, 0))
        key_first = np.maximum.accumulate(np.where(new_key, at, 0))
        rank[open_places] = old + key_first - group_first
        sizes = np.diff(np.append(np.flatnonzero(new_key), len(old)))
        open_places = open_places[np.repeat(sizes > 1, sizes)]
        h *= 2
    out = np.empty(n, np.int64)
    out[rank[:n]] = np.arange(n)
    return out


class WaveletMatrix:
    """Rank queries on a sequence of small integers: a bit vector with word counts for each binary digit."""

    def __init__(self, values: np.ndarray, sigma: int):
        self.levels = []
        for bit in range(max(1, int(sigma - 1).bit_length()) - 1, -1, -1):
            ones = ((values >> bit) & 1).astype(bool)
            packed = np.packbits(np.pad(ones, (0, 64 - len(ones) % 64)), bitorder="little").view(np.uint64)
            before = np.concatenate(([0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)))
            zeros = len(ones) - int(before[-1])
            self.levels.append((bit, packed, before, zeros))
            values = np.concatenate((values[~ones], values[ones]))

    @staticmethod
    def _ones(packed: np.ndarray, before: np.ndarray, at: np.ndarray) -> np.ndarray:
        word, low = at >> 6, (at & 63).astype(np.uint64)
        return before[word] + np.bitwise_count(packed[word] & ((np.uint64(1) << low) - np.uint64(1)))

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before its place `at`."""
        start, end = np.zeros_like(at), at
        for bit, packed, before, zeros in self.levels:
            one = (symbols >> bit) & 1 == 1
            s, e = self._ones(packed, before, start), self._ones(packed, before, end)
            start, end = np.where(one, zeros + s, start - s), np.where(one, zeros + e, end - e)
        return end - start

    def access_rank(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place, and how often it occurs before."""
        start, end, symbol = np.zeros_like(at), at, np.zeros_like(at)
        for bit, packed, before, zeros in self.levels:
            one = (packed[end >> 6] >> (end & 63).astype(np.uint64)) & np.uint64(1) == 1
            s, e = self._ones(packed, before, start), self._ones(packed, before, end)
            start, end = np.where(one, zeros + s, start - s), np.where(one, zeros + e, end - e)
            symbol |= one.astype(np.int64) << bit
        return symbol, end - start


class FMIndex:
    """Backward search and location in a sequence of symbols >= 1; 0 separates and is never part of a pattern."""

    def __init__(self, symbols: np.ndarray, sigma: int, sample: int = SAMPLE):
        text = np.append(symbols + 1, 0).astype(np.int64)  # the end is smaller than all others, and there is one
        sigma += 1
        order = suffix_array(text)
        last = text[order - 1]
        self.n = len(text)
        self.wavelet = WaveletMatrix(last, sigma)
        self.smaller = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=sigma))))
        kept = order % sample == 0
        self.kept_before = np.concatenate(([0], np.cumsum(kept)))
        self.kept, self.positions = kept, order[kept]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last + 1 row of the suffixes that begin with each pattern (one in each line)."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        for column in range(patterns.shape[1] - 1, -1, -1):
            live = np.flatnonzero(low < high)
            if not len(live):
                break
            symbol = patterns[live, column] + 1
            both = self.wavelet.rank(np.concatenate((symbol, symbol)), np.concatenate((low[live], high[live])))
            low[live], high[live] = self.smaller[symbol] + both[:len(live)], self.smaller[symbol] + both[len(live):]
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text position of each row: steps back to the nearest kept position."""
        out, row, steps, open_rows = np.empty(len(rows), np.int64), rows.copy(), 0, np.arange(len(rows))
        while len(open_rows):
            there = self.kept[row]
            out[open_rows[there]] = self.positions[self.kept_before[row[there]]] + steps
            open_rows, row = open_rows[~there], row[~there]
            symbol, before = self.wavelet.access_rank(row)
            row = self.smaller[symbol] + before
            steps += 1
        return out


class Phrases:
    """The distinct windows of benchmark items and the items of each."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str]] = {}
        for key, text in items:
            found = words_of(text)
            codes = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in found]
            for i in range(max(1, len(codes) - window + 1) if codes else 0):
                owners.setdefault(tuple(codes[i:i + window]), set()).add(key)
        self.names = sorted({k for some in owners.values() for k in some})
        number = {k: i for i, k in enumerate(self.names)}
        self.groups = []
        for length in sorted({len(p) for p in owners}):
            some = [p for p in owners if len(p) == length]
            sizes = np.array([len(owners[p]) for p in some], np.int64)
            flat = np.array([number[k] for p in some for k in sorted(owners[p])], np.int64)
            self.groups.append((np.array(some, np.int64), sizes, flat))
        self.shortest = min((len(p) for p in owners), default=1)


def search_shard(texts: list[str | None], phrases: Phrases) -> tuple[list[int], dict[int, tuple[np.ndarray, np.ndarray, list[str]]]]:
    """Word counts of the documents of one shard; for those with hits the hit words' runs (first, last + 1) and the items found.

    A word outside the phrases' vocabulary is in no window, so it is left out of the index and separates; so are runs of known words
    shorter than the shortest window.
    """
    counts, codes = [], []
    known = phrases.vocabulary
    for text in texts:
        found = words_of(text)
        counts.append(len(found))
        codes.append(np.fromiter(map(known.get, found, repeat(0)), np.int64, len(found)))
        codes.append(np.zeros(1, np.int64))  # matches never cross documents
    if not known or not codes:
        return counts, {}
    flat = np.concatenate(codes)
    edge = np.diff(np.concatenate(([0], (flat > 0).astype(np.int8), [0])))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long_enough = ends - starts >= phrases.shortest
    starts, ends = starts[long_enough], ends[long_enough]
    if not len(starts):
        return counts, {}
    lens = ends - starts + 1  # with the separator after it, which is 0
    stops = np.cumsum(lens)
    place = np.arange(int(stops[-1])) + np.repeat(starts - (stops - lens), lens)
    index = FMIndex(flat[place], len(known) + 1)
    hit_edges = np.zeros(len(flat) + 1, np.int64)
    doc_start = np.cumsum(np.array(counts) + 1) - np.array(counts) - 1
    doc_of = lambda at: np.searchsorted(doc_start, at, side="right") - 1
    found_doc, found_item = [], []
    for patterns, sizes, owners in phrases.groups:
        low, high = index.search(patterns)
        n = high - low
        which = np.repeat(np.arange(len(patterns)), n)
        if not len(which):
            continue
        stops = np.cumsum(n)
        at = place[index.locate(np.arange(len(which)) + np.repeat(low - (stops - n), n))]
        np.add.at(hit_edges, at, 1)
        np.add.at(hit_edges, at + patterns.shape[1], -1)
        # a phrase counts once in a document, before its items come to it
        once = np.unique(doc_of(at) * len(patterns) + which)
        doc, which = once // len(patterns), once % len(patterns)
        m = sizes[which]
        first = np.cumsum(sizes) - sizes
        stops = np.cumsum(m)
        found_doc.append(np.repeat(doc, m))
        found_item.append(owners[np.arange(int(stops[-1])) + np.repeat(first[which] - (stops - m), m)])
    if not found_doc:
        return counts, {}
    hit = np.diff(np.concatenate(([0], (np.cumsum(hit_edges[:-1]) > 0).astype(np.int8), [0])))
    starts, ends = np.flatnonzero(hit == 1), np.flatnonzero(hit == -1)
    pairs = np.unique(np.stack((np.concatenate(found_doc), np.concatenate(found_item)), axis=1), axis=0)
    run_doc, out = doc_of(starts), {}
    for doc in np.unique(run_doc).tolist():
        mine = run_doc == doc
        items = [phrases.names[i] for i in pairs[pairs[:, 0] == doc, 1].tolist()]
        out[doc] = (starts[mine] - doc_start[doc], ends[mine] - doc_start[doc], items)
    return counts, out


def char_spans(text: str, starts: np.ndarray, ends: np.ndarray) -> list[dict]:
    """Code point spans of runs of words."""
    raw = text.encode()
    bounds = [m.span() for m in WORD.finditer(raw.lower())]
    return [{"start": len(raw[:bounds[a][0]].decode()), "end": len(raw[:bounds[b - 1][1]].decode())} for a, b in zip(starts.tolist(), ends.tolist())]


SPANS = "array<struct<start:long,end:long>>"
FOUND = f"doc_id long, n_words long, n_hit long, items array<string>, spans {SPANS}"
NOTHING = (np.zeros(0, np.int64), np.zeros(0, np.int64), [])


Block = tuple[str, Broadcast]  # a name of its own and the items


def _phrases(block: Block, window: int) -> Phrases:
    """The phrases of one block; a worker has one block in mind."""
    return held(("phrases", block[0], window), lambda: Phrases(block[1].value, window))


def _united(parts: list[tuple[np.ndarray, np.ndarray, list[str]]]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Hits of one document from several blocks of phrases: runs that overlap or touch become one."""
    if len(parts) == 1:
        return parts[0]
    last = max(int(p[1].max()) for p in parts)
    edges = np.zeros(last + 1, np.int64)
    for starts, ends, _ in parts:
        np.add.at(edges, starts, 1)
        np.add.at(edges, ends, -1)
    hit = np.diff(np.concatenate(([0], (np.cumsum(edges) > 0).astype(np.int8), [0])))
    return np.flatnonzero(hit == 1), np.flatnonzero(hit == -1), sorted({k for p in parts for k in p[2]})


def _searched(blocks: list[Block], window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for first, last in slices([t or "" for t in texts], SHARD_CHARS):
                counts, found = [], {}
                for block in blocks:
                    counts, some = search_shard(texts[first:last], _phrases(block, window))
                    for doc, hit in some.items():
                        found.setdefault(doc, []).append(hit)
                hits, items, spans = [], [], []
                for i in range(last - first):
                    starts, ends, names = _united(found[i]) if i in found else NOTHING
                    hits.append(int((ends - starts).sum()))
                    items.append(names)
                    spans.append(char_spans(texts[first + i], starts, ends) if names else [])
                columns = [pa.array(counts, pa.int64()), pa.array(hits, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(spans, span)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, last - first), *columns], names=["doc_id", "n_words", "n_hit", "items", "spans"])

    return run


def phrase_blocks(benchmark: DataFrame, most: int = PHRASE_BYTES, id_column: str = "item_id", text_column: str = "text") -> Iterator[list[tuple[str, str]]]:
    """The benchmark in blocks of about `most` bytes, one at a time on the driver. A null item id is named by the empty string."""
    rows = benchmark.select(F.coalesce(F.col(id_column).cast("string"), F.lit("")).alias("item"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))
    rows = rows.distinct()  # repeats would fill one block
    size = rows.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    blocks = -(-size // most)
    for b in range(blocks):
        mine = rows if blocks == 1 else rows.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b)
        yield [(r["item"], r["text"]) for r in mine.collect()]


def sent_blocks(benchmark: DataFrame, most: int) -> list[Block]:
    """Broadcast blocks; there is one at least, so that words are counted without a benchmark too."""
    send = benchmark.sparkSession.sparkContext.broadcast
    return [(uuid.uuid4().hex, send(b)) for b in phrase_blocks(benchmark, most)] or [("", send([]))]


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_column: str = "doc_id", text_column: str = "text", phrase_bytes: int = PHRASE_BYTES,
) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items (sorted), spans (code points to remove), contaminated (n_hit > 0).

    Null texts, of documents or items, have no words. Null or repeated ids and repeated rows are rows of their own; items with one id
    count once. Other columns are left out. An empty table gives no rows, an empty benchmark no hits. With a benchmark of more than
    one block, each shard is searched for one block after the other and the hits are united.
    """
    found = text_rows(docs, id_column, text_column).mapInArrow(_searched(sent_blocks(benchmark, phrase_bytes), window), FOUND)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", "spans", (F.col("n_hit") > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_column: str = "text", phrase_bytes: int = PHRASE_BYTES) -> DataFrame:
    """The rows of `docs`, with all their columns, in whose text no window occurs. No row moves."""
    blocks = sent_blocks(benchmark, phrase_bytes)
    names = [f"_c{i}" for i in range(len(docs.columns))]
    text = names[docs.columns.index(text_column)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text).to_pylist()
            for first, last in slices([t or "" for t in texts], SHARD_CHARS):
                clean = np.ones(last - first, bool)
                for block in blocks:
                    clean[list(search_shard(texts[first:last], _phrases(block, window))[1])] = False
                yield batch.slice(first, last - first).filter(pa.array(clean))

    plain = docs.toDF(*names)
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
