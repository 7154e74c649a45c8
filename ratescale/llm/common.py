"""What several corpus operators share: written intermediates, text batches, cached tokenization."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterable, Iterator
from itertools import chain
from typing import TypeVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratescale.session import shared_folder

T = TypeVar("T")
SLICE_CHARS = 1 << 21
STRING_BYTES = 150  # of a string in a dictionary, with its array's place
KEPT_BYTES = 150_000_000  # of strings and arrays that a worker keeps
# every character that Python or the tokenizers' patterns take for white space, but the plain space
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
INNER_SPACE = re.compile(r"(?<=\S) (?=\S)")
# texts without later characters than U+00FF are in NFC
LATIN = re.compile("[\x00-\xff]+")
# lines that are a word of Latin letters and the signs after it, of which the patterns of both file kinds make one token's text each; all other lines have no word
PLAIN_LINES = re.compile(r"^( ?)([A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff]+)([!-&(-/:;=>?@\[-`{-~]*)$|^.*$", re.MULTILINE)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write the rows as Parquet to the shared folder, to be read several times; the folder goes when the driver ends."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.parquet(path)
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return spark.read.schema(df.schema).parquet(path)


def text_rows(docs: DataFrame, id_column: str, text_column: str, *others: str) -> DataFrame:
    """The columns an operator needs, as `doc_id` and `text`; all others stay out, so their names can't clash."""
    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"), *others)


def slices(texts: list[str], most: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts with about `most` characters; a longer text comes alone."""
    start, chars = 0, 0
    for i, t in enumerate(texts):
        if chars and chars + len(t) > most:
            yield start, i
            start, chars = i, 0
        chars += len(t)
    if start < len(texts):
        yield start, len(texts)


def small_batches(batches: Iterable[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The same rows, few at a time: what is made of a batch in Python takes many times its bytes."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def batch_texts(batch: pa.RecordBatch) -> list[str]:
    """The texts of a batch; null is empty."""
    return [t or "" for t in batch.column("text").to_pylist()]


def gather(pool: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The pieces [start, start + len) of the pool, one after the other."""
    total = int(lens.sum())
    ends = np.cumsum(lens)
    return pool[np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lens), lens)]


class Slots(dict):
    """Numbers of strings in the order of their first look-up; `new` holds those that came since it was last emptied, `bytes` is about what all take."""

    def __init__(self) -> None:
        self.new: list[str] = []
        self.bytes = 0

    def __missing__(self, key: str) -> int:
        self.new.append(key)
        self.bytes += STRING_BYTES + len(key)
        self[key] = n = len(self)
        return n


class Ragged:
    """Strings with an array each, kept up to a number of bytes."""

    def __init__(self, most: int, kind=np.uint32):
        self.most, self.kind = most, np.dtype(kind)
        self.clear()

    def full(self) -> bool:
        return self.index.bytes + self.used * self.kind.itemsize > self.most

    def clear(self) -> None:
        self.index = Slots()
        self.starts, self.lens = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.pool, self.used = np.zeros(4096, self.kind), 0

    def add(self, keys: list[str], flat: np.ndarray, lens: np.ndarray) -> None:
        n = len(self.index)
        self.index.update(zip(keys, range(n, n + len(keys))))
        self.index.bytes += STRING_BYTES * len(keys) + sum(map(len, keys))
        self.put(n, flat, lens)

    def put(self, n: int, flat: np.ndarray, lens: np.ndarray) -> None:
        """The arrays of the strings from number n on."""
        m = len(lens)
        while n + m > len(self.starts):
            self.starts, self.lens = np.resize(self.starts, 2 * len(self.starts)), np.resize(self.lens, 2 * len(self.lens))
        while self.used + len(flat) > len(self.pool):
            self.pool = np.resize(self.pool, 2 * len(self.pool))
        self.pool[self.used:self.used + len(flat)] = flat
        self.starts[n:n + m] = self.used + np.cumsum(lens) - lens
        self.lens[n:n + m] = lens
        self.used += len(flat)

    def slots(self, keys: list[str]) -> np.ndarray:
        return np.fromiter(map(self.index.__getitem__, keys), np.int64, len(keys))

    def get(self, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return self.at(self.slots(keys))

    def at(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lens = self.lens[slots]
        return gather(self.pool, self.starts[slots], lens), lens


def space_chunks(text: str) -> list[str]:
    """A text cut at single spaces between words. A chunk stands for a space and itself; the first one, marked by a space, for the rest of itself.

    The byte-level and the word pattern both begin a new token at such a space, so chunks can be encoded one by one.
    """
    odd = "  " in text or any(c in text and (f" {c}" in text or f"{c} " in text) for c in SPACES)
    chunks = INNER_SPACE.split(text) if odd else text.split(" ")
    chunks[0] = " " + chunks[0]
    return chunks


def spelled(chunk: str) -> str:
    """The characters a chunk of `space_chunks` stands for."""
    return chunk[1:] if chunk[:1] == " " else " " + chunk


def _byte_characters() -> dict[int, str]:
    """The character that byte-level files write for each byte: itself where it is printable, else the next one from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = sorted(set(range(256)).difference(shown))
    return {b: chr(b) for b in shown} | {b: chr(0x100 + i) for i, b in enumerate(hidden)}


class TextEncoder:
    """Ids of whole texts by the tokenizers library, asked once for each chunk of text that a worker has in mind.

    Where a new chunk is a word and signs its cut into tokens' texts is known: each goes to the library's model once. Otherwise the library's
    normalizer and pre-tokenizer cut it, and chunks that may hold special strings go through the whole library.
    The caches only save time: when one is full it is emptied. File kinds: byte-level BPE, and BPE with word ends.
    """

    def __init__(self, file: str, most: int = KEPT_BYTES):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        self.model, self.normalizer, self.pre_tokenizer = self.tokenizer.model, self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        with open(file, encoding="utf-8") as f:
            content = json.load(f)
        self.word_ends = bool(content["model"].get("end_of_word_suffix"))
        steps = (content["normalizer"] or {}).get("normalizers", [])
        self.one_space = any(s.get("pattern") == {"Regex": r"\s+"} and s.get("content") == " " for s in steps)
        self.shown = _byte_characters()
        self.chunks, self.texts = Ragged(most * 5 // 6), Ragged(most // 6)

    def plain(self, text: str) -> str:
        """A text that has the same ids and fewer distinct words: the files with word ends have lower-case letters and one kind of white space anyway."""
        if not self.word_ends or "<|" in text:
            return text
        if self.one_space:
            text = text.replace("\n", " ")
        return text.lower() if LATIN.fullmatch(text) else text

    def _ids(self, text: str) -> list[int]:
        if "<|" in text:
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        if self.normalizer is not None:
            text = self.normalizer.normalize_str(text)
        return [token.id for t, _ in self.pre_tokenizer.pre_tokenize_str(text) for token in self.model.tokenize(t)]

    def _tokens_texts(self, chunks: list[str]) -> list[str]:
        """Two keys for each chunk: what the library's model gets to see of its word, and the signs; or a line break with the chunk, and nothing."""
        space = "" if self.word_ends else self.shown[32]
        keys = []
        for chunk, (first, word, signs) in zip(chunks, PLAIN_LINES.findall("\n".join(["" if "\n" in c else c for c in chunks]))):
            if word:
                if self.word_ends:
                    word = word.lower()
                if not word.isascii():
                    word = word.encode().decode("latin-1").translate(self.shown)
                keys += word if first else space + word, signs
            else:
                keys += "\n" + chunk, ""
        return keys

    def _learn(self, new: list[str]) -> None:
        if self.texts.full():
            self.texts.clear()
        slots, tokenize = self.texts.slots(self._tokens_texts(new)), self.model.tokenize
        if some := self.texts.index.new:
            ids = [self._ids(spelled(t[1:])) if t[:1] == "\n" else [token.id for token in tokenize(t)] for t in some]
            lens = np.fromiter(map(len, ids), np.int64, len(ids))
            self.texts.put(len(self.texts.index) - len(some), np.fromiter(chain.from_iterable(ids), np.uint32, int(lens.sum())), lens)
            self.texts.index.new = []
        ids, lens = self.texts.at(slots)
        self.chunks.put(len(self.chunks.index) - len(new), ids, lens[0::2] + lens[1::2])

    def encode(self, texts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For slices of the texts: index of the first text, all ids, and the number of ids of each text."""
        for start, end in slices(texts):
            keys = [space_chunks(self.plain(t)) for t in texts[start:end]]
            flat = list(chain.from_iterable(keys))
            found, sizes = [], []
            for i in range(0, len(flat), 200_000):  # a long text comes in several rounds
                if self.chunks.full():
                    self.chunks.clear()
                slots = self.chunks.slots(flat[i:i + 200_000])
                if new := self.chunks.index.new:
                    self._learn(new)
                    self.chunks.index.new = []
                ids, lens = self.chunks.at(slots)
                found.append(ids)
                sizes.append(lens)
            ids, lens = np.concatenate(found), np.concatenate(sizes)
            ends = np.concatenate(([0], np.cumsum(lens)))[np.concatenate(([0], np.cumsum([len(some) for some in keys])))]
            yield start, ids, np.diff(ends)


_HELD: dict[tuple, object] = {}


def held(key: tuple, make: Callable[[], T]) -> T:
    """What a worker process keeps between tasks: one object, as workers serve one operator after the other."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


def release() -> None:
    """Forget what a worker keeps: called by tasks of operators that keep nothing, as they may follow another operator's."""
    _HELD.clear()


def encoder(file: str) -> TextEncoder:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return held(("encoder", file), lambda: TextEncoder(file))


def record_batch(schema: pa.Schema, columns: Iterable) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
