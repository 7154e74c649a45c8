"""CSV files whose quoted cells may hold line breaks, read in splits by several tasks.

Spark's text reader hands out lines, and each split of a file begins at a line. Whether that line lies inside a quoted cell is the parity of
all quotes before it, a running sum over the splits' counts. A record ends at a line break outside quotes; the few records that
cross a split's border are put together from their pieces. A quote inside a cell has to be doubled, and its cell quoted.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ratescale.session import cut_lineage

WHOLE, TAIL, MIDDLE, HEAD = 0, 1, 2, 3  # a record, its beginning, a split inside of it, its end


def metadata_path() -> Column:
    """Path of a row's file as it is, not as a URL."""
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))


def _lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    text = spark.read.option("lineSep", "\n").text(list(paths) if not isinstance(paths, str) else paths)
    return text.select("value", metadata_path().alias("path"), F.col("_metadata.file_block_start").alias("start"))


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, tuple[str, int]]]:
    """Lines of one split that follow each other, with the split's path and start; a split's lines may come in several parts."""
    for batch in batches:
        if not batch.num_rows:
            continue
        value, path, start = (batch.column(c) for c in ("value", "path", "start"))
        file, begin = path.dictionary_encode().indices.to_numpy(), start.to_numpy()
        edges = np.nonzero((np.diff(file) != 0) | (np.diff(begin) != 0))[0] + 1
        for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows]):
            yield value.slice(lo, hi - lo), (path[lo].as_py(), int(begin[lo]))


def splits(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(path, start, line, inside): the first line of every split and whether it lies inside a quoted cell. A row for each split; written once."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A task reads a split's lines one after the other, so no line but the first is kept or sorted."""
        now: tuple | None = None
        total, line = 0, ""

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in (*now, total, line)], names=["path", "start", "_quotes", "line"])

        for lines, at in _stretches(batches):
            if at != now:
                if now is not None:
                    yield row()
                now, total, line = at, 0, lines[0].as_py()
            total += pc.sum(pc.count_substring(lines, '"')).as_py()
        if now is not None:
            yield row()

    found = _lines(spark, paths).mapInArrow(counted, "path string, start long, _quotes long, line string")
    before = W.partitionBy("path").orderBy("start").rowsBetween(W.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("_quotes").over(before) % 2, F.lit(0)) == 1
    return cut_lineage(found.withColumn("inside", inside).drop("_quotes"))


def records(spark: SparkSession, paths: str | Sequence[str], known: DataFrame | None = None) -> DataFrame:
    """(value, path, first): the records of all files, empty lines left out; `first` is each file's header. `known`: their `splits`."""
    known = known if known is not None else splits(spark, paths)
    # only splits that begin inside a quoted cell are named; there are few, and no more than splits
    inside = {(r["path"], r["start"]) for r in known.filter("inside").select("path", "start").collect()}
    sent = spark.sparkContext.broadcast(inside)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple | None = None
        waiting: list[str] = []
        opened = False  # the waiting lines began in this split
        first = quoted = False

        def left() -> tuple:
            return "\n".join(waiting), *now, TAIL if opened else MIDDLE, first

        for lines, at in _stretches(batches):
            if at != now:
                if waiting:
                    yield _batch([left()])
                now, waiting = at, []
                quoted, first = now in sent.value, at[1] == 0
                opened = not quoted
            odd = (np.cumsum(pc.count_substring(lines, '"').to_numpy()) + quoted) % 2
            quoted = bool(odd[-1])
            ends = np.nonzero(odd == 0)[0] + 1
            done = 0
            if len(ends) and (waiting or first or not opened):
                done = int(ends[0])
                whole = "\n".join([*waiting, *lines.slice(0, done).to_pylist()])
                yield _batch([(whole, *now, WHOLE if opened else HEAD, first)])
                waiting, opened, first, ends = [], True, False, ends[1:]
            if len(ends):
                borders = pa.array(np.concatenate([[done], ends]), pa.int32())
                done = int(ends[-1])
                yield _records(pc.binary_join(pa.ListArray.from_arrays(borders, lines), "\n"), now)
            waiting += lines.slice(done).to_pylist()
        if waiting:
            yield _batch([left()])

    pieces = _lines(spark, paths).mapInArrow(cut, "value string, path string, start long, kind int, first boolean")
    whole = pieces.filter(F.col("kind") == WHOLE).select("value", "path", "first")
    if inside:
        crossing = pieces.filter(F.col("kind") != WHOLE)
        in_order = W.partitionBy("path").orderBy("start", F.col("kind") != HEAD)
        number = F.sum((F.col("kind") == TAIL).cast("int")).over(in_order)
        parts = F.array_sort(F.collect_list(F.struct("start", "value")))
        joined = crossing.withColumn("_number", number).groupBy("path", "_number").agg(parts.alias("_parts"), F.bool_or("first").alias("first"))
        together = F.array_join(F.transform("_parts", lambda p: p["value"]), "\n")
        whole = whole.unionByName(joined.select(together.alias("value"), "path", "first"))
    return whole.withColumn("value", F.regexp_replace("value", r"\r\z", "")).filter("value <> ''")


def _records(values: pa.Array, at: tuple[str, int]) -> pa.RecordBatch:
    """Whole records of one split, none of them a header."""
    columns = [values, *(pa.repeat(x, len(values)) for x in (at[0], pa.scalar(at[1], pa.int64()), pa.scalar(WHOLE, pa.int32()), False))]
    return pa.RecordBatch.from_arrays(columns, names=["value", "path", "start", "kind", "first"])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.int64(), pa.int32(), pa.bool_())
    columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
    return pa.RecordBatch.from_arrays(columns, names=["value", "path", "start", "kind", "first"])
