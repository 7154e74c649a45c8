"""Near duplicates by SimHash fingerprints, searched in BK-trees.

Fingerprints within r bits agree in one of r + 1 bit blocks, so each (block, value) is a shard with a tree of its own and no link is
lost. Shard trees go to the tasks by key, many to a task, as all of them together grow with the data; a shard of more than
`TREE_ROWS` fingerprints is dealt over pairs of slots, so no tree grows beyond two slots.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratescale.llm.common import text_rows, written

SHINGLE, SEED, RADIUS = 4, 42, 4
TREE_ROWS = 32_768
TASK_ROWS = 100_000
FRONTIER = 4_000_000  # (query, node) pairs looked at together, at most


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The 64-bit SimHash of the word shingles, repeats counted, as a signed number; 0 without words."""
    words = (text or "").encode().lower().split()  # bytes: A-Z and ASCII space alone
    if not words:
        return 0
    if len(words) <= shingle:
        hashes = np.array([xxhash.xxh64_intdigest(b" ".join(words), seed)], np.uint64)
    else:
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        digest = xxhash.xxh64_intdigest
        hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts[:len(words) - shingle + 1].tolist(), ends[shingle - 1:].tolist())], np.uint64)
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes, as a signed number; 0 without hashes."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[i:i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


class Forest:
    """BK-trees over distinct fingerprints, one for each shard: a child hangs at its Hamming distance from the parent."""

    def __init__(self, shards: np.ndarray, values: np.ndarray):
        """`shards` sorted; the first fingerprint of a shard is its root."""
        self.values = values
        _, roots, sizes = np.unique(shards, return_index=True, return_counts=True)
        self.root, self.size = np.repeat(roots, sizes), np.repeat(sizes, sizes)
        node = self.root.copy()
        pending = np.setdiff1d(np.arange(len(values)), roots, assume_unique=True)
        codes, children = [], []
        while len(pending):
            code = node[pending] * 65 + np.bitwise_count(values[pending] ^ values[node[pending]])
            edge, first, back = np.unique(code, return_index=True, return_inverse=True)
            codes.append(edge)
            children.append(pending[first])
            node[pending] = pending[first][back]
            stays = np.ones(len(pending), bool)
            stays[first] = False
            pending = pending[stays]
        codes, children = np.concatenate(codes or [np.zeros(0, np.int64)]), np.concatenate(children or [np.zeros(0, np.int64)])
        order = np.argsort(codes)
        self.codes, self.children = codes[order], children[order]

    def near(self, queries: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query, node) of one shard within the radius; only edges within the radius of the query's distance are followed."""
        asked, node = queries, self.root[queries]
        while len(asked):
            d = np.bitwise_count(self.values[asked] ^ self.values[node]).astype(np.int64)
            found = (d <= radius) & (asked != node)
            if found.any():
                yield asked[found], node[found]
            low = np.searchsorted(self.codes, node * 65 + np.maximum(d - radius, 0))
            high = np.searchsorted(self.codes, node * 65 + np.minimum(d + radius, 64), side="right")
            n = high - low
            ends = np.cumsum(n)
            at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(low - (ends - n), n)
            asked, node = np.repeat(asked, n), self.children[at]

    def groups(self, radius: int) -> np.ndarray:
        """For each fingerprint, the smallest index that it is linked to inside its shard, over any number of links."""
        label = np.arange(len(self.values))
        work = np.cumsum(self.size)
        start = 0
        while start < len(label):
            end = max(start + 1, int(np.searchsorted(work, (work[start - 1] if start else 0) + FRONTIER, side="right")))
            for a, b in self.near(np.arange(start, end), radius):
                while True:
                    la, lb = label[a], label[b]
                    apart = la != lb
                    if not apart.any():
                        break
                    a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
                    np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
                    while not np.array_equal(jump := label[label], label):
                        label = jump
            start = end
        return label


def _linked(radius: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates(["shard", "fp"]).sort_values("shard", kind="stable")
        values = rows["fp"].to_numpy(np.int64)
        forest = Forest(rows["shard"].to_numpy(np.int64), values.view(np.uint64))
        label = forest.groups(radius)
        moved = label != np.arange(len(label))
        return pd.DataFrame({"a": values[moved], "b": values[label[moved]]}).drop_duplicates()

    return run


def links(classes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints (column fp) whose components are those of all pairs within the radius."""
    blocks = radius + 1
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    values = [F.shiftrightunsigned(F.shiftleft("fp", 64 - high), 64 - high + low) for low, high in zip(cuts, cuts[1:])]
    shards = classes.select("fp", F.posexplode(F.array(*values)).alias("block", "value"))
    # the number of a block and its value (at most 63 bits together for a radius of 1 or more)
    keyed = shards.select("fp", (F.col("value") * blocks + F.col("block")).alias("shard"))
    large = keyed.groupBy("shard").count().filter(F.col("count") > TREE_ROWS)
    large = large.select("shard", F.ceil(F.col("count") / TREE_ROWS).cast("int").alias("slots"))
    dealt = keyed.join(large, "shard", "left").withColumn("slots", F.coalesce("slots", F.lit(1)))
    own = F.pmod(F.xxhash64("fp"), F.col("slots")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("slots") - 1))
    dealt = dealt.withColumn("own", own).withColumn("other", other).filter("slots = 1 OR own <> other")
    spread = F.when(F.col("slots") == 1, F.col("shard")).otherwise(F.xxhash64("shard", F.least("own", "other"), F.greatest("own", "other")))
    dealt = dealt.select("fp", spread.alias("shard"))
    n = classes.count() * blocks
    tasks = max(int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // TASK_ROWS))
    grouped = dealt.withColumn("task", F.pmod(F.xxhash64("shard", F.lit(1)), F.lit(tasks)))
    return grouped.groupBy("task").applyInPandas(_linked(radius), "a long, b long")


def _are_stars(edges: DataFrame) -> bool:
    """Whether each upper node u of the edges (u, v) has one edge and is no lower node: then v is the root of all its component."""
    ends = F.explode(F.array(*[F.struct(F.col(c).alias("node"), F.lit(upper).alias("upper")) for c, upper in (("u", 1), ("v", 0))])).alias("end")
    nodes = edges.select(ends).groupBy("end.node").agg(F.sum("end.upper").alias("edges"), F.min("end.upper").alias("least"))
    return not nodes.agg(F.bool_or(F.expr("edges > 1 OR (edges = 1 AND least = 0)"))).first()[0]


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b), by alternating large and small stars; the root is the smallest node."""
    edges = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "links")
    while not _are_stars(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        edges = written(small.unionByName(least.withColumnRenamed("m", "v")).distinct(), "links")
    roots = edges.select("v").distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.select(F.col("v").alias("node"), F.col("v").alias("root")))


def _with_fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = pa.array([fingerprint(t) for t in batch.column("text").to_pylist()], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), fps], names=["doc_id", "fp"])


def component_table(rows: DataFrame, radius: int = RADIUS) -> DataFrame:
    """fp, root and component_id of the distinct fingerprints of `rows` (doc_id, fp)."""
    classes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "fingerprints")
    found = components(links(classes, radius))
    placed = classes.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    return placed.join(smallest, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id: the smallest id that is reachable over links within the radius.

    Null texts and texts without words have fingerprint zero and are linked like any other. Null ids count as no smallest id: a
    component of null ids alone has a null component_id. Repeated ids and rows are rows of their own, other columns are left out,
    an empty table gives no rows. Copies are one node of the links, whatever their number.
    """
    rows = written(text_rows(docs, id_column, text_column).mapInArrow(_with_fingerprint, "doc_id long, fp long"), "simhash")
    table = component_table(rows, radius)
    return rows.join(table, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
