"""Exact token counts of byte-level BPE by merging ragged arrays, all pre-tokens of a batch at once."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratescale.llm.common import KEPT_BYTES, Ragged, batch_texts, held, slices, space_chunks, spelled, text_rows

# Fixed value: the pre-token pattern of byte-level BPE
PRE_TOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
NONE = np.iinfo(np.int32).max


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes for themselves, the others from 256 up."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


class Merger:
    """Merge ranks of a tokenizer file, and the number of tokens of pre-tokens."""

    def __init__(self, file: str, most: int = KEPT_BYTES):
        with open(file, encoding="utf-8") as f:
            data = json.load(f)
        vocab, merges = data["model"]["vocab"], data["model"]["merges"]
        self.special = [t["content"] for t in data["added_tokens"]]
        self.cut = regex.compile("|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.of_byte = np.array([vocab[c] for c in byte_letters()], np.int64)
        self.size = max(vocab.values()) + 1
        keys, made = np.empty(len(merges), np.int64), np.empty(len(merges), np.int64)
        for r, pair in enumerate(merges):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            keys[r], made[r] = vocab[a] * self.size + vocab[b], vocab[a + b]
        order = np.argsort(keys)
        self.keys, self.ranks, self.made_by_rank = keys[order], order.astype(np.int32), made
        self.known = Ragged(most, np.uint8)  # chunk of text -> its count, as `lens`

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def count(self, words: list[bytes]) -> np.ndarray:
        """Tokens of each pre-token: in each round every sequence merges all places of its lowest-rank pair."""
        counts = np.fromiter(map(len, words), np.int64, len(words))
        live = np.flatnonzero(counts > 1)
        symbols = self.of_byte[np.frombuffer(b"".join(words[i] for i in live.tolist()), np.uint8)]
        lens = counts[live]
        owner = np.repeat(np.arange(len(live)), lens)
        rank = np.full(len(symbols), NONE, np.int32)  # of the pair that begins here
        inside = np.flatnonzero(owner[:-1] == owner[1:])
        rank[inside] = self._ranks(symbols[inside], symbols[inside + 1])
        while len(live):
            starts = np.cumsum(lens) - lens
            lowest = np.minimum.reduceat(rank, starts)
            done = lowest == NONE
            if done.any():  # what no pair merges any more is left with its symbols
                counts[live[done]] = lens[done]
                stays = np.repeat(~done, lens)
                symbols, rank = symbols[stays], rank[stays]
                live, lens, lowest = live[~done], lens[~done], lowest[~done]
                continue
            low = np.repeat(lowest, lens)
            hit = np.flatnonzero(rank == low)
            if len(hit) > 1:  # of overlapping equal pairs, those at even places of their run merge
                new = np.ones(len(hit), bool)
                new[1:] = np.diff(hit) != 1
                run = np.flatnonzero(new)
                place = np.arange(len(hit)) - np.repeat(run, np.diff(np.append(run, len(hit))))
                hit = hit[place % 2 == 0]
            symbols[hit] = self.made_by_rank[low[hit]]
            stays = np.ones(len(symbols), bool)
            stays[hit + 1] = False
            owner = np.repeat(np.arange(len(live)), lens)
            lens = lens - np.bincount(owner[hit], minlength=len(live))
            place = np.cumsum(stays) - 1
            symbols, rank, owner = symbols[stays], rank[stays], owner[stays]
            # only pairs that hold a new symbol have a new rank
            changed = np.unique(np.concatenate((place[hit], np.maximum(place[hit] - 1, 0))))
            last = np.append(owner[:-1] != owner[1:], True)
            rank[changed] = NONE
            pairs = changed[~last[changed]]
            rank[pairs] = self._ranks(symbols[pairs], symbols[pairs + 1])
        return counts

    def _learn(self, keys: list[str]) -> None:
        wanted = set(keys)
        new = [c for c in wanted if c not in self.known.index]  # set.difference would walk the whole index
        if self.known.full():
            self.known.clear()
            new = list(wanted)
        words: list[str] = []
        sizes, extra = np.empty(len(new), np.int64), np.zeros(len(new), np.int64)
        for i, chunk in enumerate(map(spelled, new)):
            before = len(words)
            if self.cut and any(t in chunk for t in self.special):
                extra[i] = len(self.cut.findall(chunk))
                for text in self.cut.split(chunk):
                    words += PRE_TOKEN.findall(text)
            elif chunk.isascii() and chunk[1:].isalpha() and (chunk[0] == " " or chunk[0].isalpha()):  # a sign or digit before a word is cut off
                words.append(chunk)
            else:
                words += PRE_TOKEN.findall(chunk)
            sizes[i] = len(words) - before
        distinct = dict.fromkeys(words)
        distinct.update(zip(distinct, range(len(distinct))))
        counts = self.count([w.encode() for w in distinct])
        each = np.concatenate(([0], np.cumsum(counts[np.fromiter(map(distinct.__getitem__, words), np.int64, len(words))])))
        ends = np.cumsum(sizes)
        n = len(self.known.index)
        while n + len(new) > len(self.known.lens):
            self.known.lens = np.resize(self.known.lens, 2 * len(self.known.lens))
        self.known.lens[n:n + len(new)] = each[ends] - each[ends - sizes] + extra
        self.known.index.update(zip(new, range(n, n + len(new))))

    def text_counts(self, texts: list[str]) -> np.ndarray:
        out = np.zeros(len(texts), np.int64)
        for start, end in slices(texts):
            keys = [space_chunks(t) for t in texts[start:end]]
            flat = [c for some in keys for c in some]
            found = []
            for i in range(0, len(flat), 400_000):  # a long text comes in several rounds
                some = flat[i:i + 400_000]
                self._learn(some)
                found.append(self.known.lens[self.known.slots(some)])
            sums = np.concatenate(([0], np.cumsum(np.concatenate(found))))
            out[start:end] = np.diff(sums[np.concatenate(([0], np.cumsum([len(some) for some in keys])))])
        return out


def _counted(file: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger = held(("merger", file), lambda: Merger(file))
        for batch in batches:
            n = merger.text_counts(batch_texts(batch))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(n)], names=["doc_id", "n_bytes", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, file: str, limit: int = 512, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of each whole text, by the merges of a byte-level BPE file.

    Null and empty texts have no token. Null or repeated ids and repeated rows are rows of their own, other columns are left out,
    an empty table gives no rows. Distinct chunks of text are counted once as long as a worker has them in mind.
    """
    rows = text_rows(docs, id_column, text_column).withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    return rows.mapInArrow(_counted(file), "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
