"""Near copies: documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, all such pairs and no others.

First the SimHash operator's BK-trees link fingerprints of the same shingles, and each link is checked exactly. What they miss is found by
a prefix filter: two similar sets share an element among the first fifth of each, in any one order of all shingles. The order puts
common shingles last; it decides the work alone. Star rounds compare each document with one of its shingle's documents and join most of a
group by few pairs; the last round takes all pairs that are still apart. Large shingles are dealt into tiles, and pairs of tiles go
to tasks, which drop pairs that cannot be similar before they are rows: by size, by the places of the shingle, and by parity bits (each
element that one set alone has flips one bit). Documents with equal sets are one node throughout.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratescale.llm import simhash
from ratescale.llm.common import release, small_batches, written
from ratescale.operators.scale import attach_group_stats, partitions

SHINGLE, SEED = 5, 42
PART, WHOLE = 4, 5  # similarity of at least 4 / 5
FLUSH = 1_000_000  # shingles counted together
COMMON = 3  # documents among those
MOST_COMMON = 1 << 16  # shingles that are put last, so that they can be sent to all tasks
STARS = 1  # rounds
PARITY = 512  # bits
WORDS = [f"w{i}" for i in range(PARITY // 64)]
TILE = 1_024  # nodes of a shingle in a tile, about
PAIR_ROWS = 2_000_000  # pairs looked at together
HUB_PAIRS = 512  # pairs that meet one copy of a text
SET_ITEMS = 2_000_000  # shingles of texts that a task keeps in mind


def shingles(text: str | None) -> np.ndarray:
    """Ascending distinct hashes of the word shingles; a shorter text is one shingle, a text without words has none."""
    words = (text or "").encode().lower().split()  # bytes: A-Z and ASCII space alone
    if not words:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= SHINGLE:
        return np.array([digest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:len(words) - SHINGLE + 1]
    return np.unique(np.array([digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends[SHINGLE - 1:].tolist())], np.uint64))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two ascending sets have a Jaccard similarity of PART / WHOLE or more."""
    if min(len(a), len(b)) * WHOLE < max(len(a), len(b)) * PART:
        return False
    both = len(a) + len(b)
    shared = both - len(np.unique(np.concatenate((a, b))))
    return shared * WHOLE >= (both - shared) * PART


def parity(hashes: np.ndarray) -> np.ndarray:
    """Eight numbers of 64 bits: the parity of the elements that fall on each bit."""
    counts = np.bincount((hashes >> np.uint64(55)).astype(np.int64), minlength=PARITY)
    return np.packbits((counts & 1).astype(np.uint8)).view(np.uint64)


def prefix(hashes: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The first shingles in the order of (place among the common ones, hash): a similar set has one of them among its own first.

    `common`: ascending hashes in the upper row, places in the lower one.
    """
    n = len(hashes)
    if not n:
        return hashes
    weight = np.zeros(n, np.uint64)
    if common.shape[1]:
        at = np.minimum(np.searchsorted(common[0], hashes), common.shape[1] - 1)
        weight = np.where(common[0][at] == hashes, common[1][at], np.uint64(0))
    return hashes[np.lexsort((hashes, weight))][:n + 1 + (-n * PART) // WHOLE]


def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    release()
    waiting: list[np.ndarray] = []
    size = 0

    def counted() -> pa.RecordBatch:
        hashes, counts = np.unique(np.concatenate(waiting or [np.zeros(0, np.uint64)]), return_counts=True)
        often = counts >= COMMON
        return pa.RecordBatch.from_arrays([pa.array(hashes[often].view(np.int64)), pa.array(counts[often].astype(np.int64))], names=["h", "n"])

    for batch in small_batches(batches):
        for text in batch.column("text").to_pylist():
            waiting.append(shingles(text))
            size += len(waiting[-1])
            if size > FLUSH:
                yield counted()
                waiting, size = [], 0
    yield counted()


def common_shingles(docs: DataFrame, text: str) -> np.ndarray:
    """The shingles that stand in most documents, ascending, with their places (1: the least common); at most `MOST_COMMON`."""
    found = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(_frequent, "h long, n long")
    rows = found.groupBy("h").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "h").limit(MOST_COMMON).collect()
    hashes = np.array([r["h"] for r in rows], np.int64).view(np.uint64)
    order = np.argsort(hashes)
    return np.stack([hashes[order], (len(rows) - order).astype(np.uint64)])


def _near_in_size(n: Column, m: Column) -> Column:
    return F.least(n, m) * WHOLE >= F.greatest(n, m) * PART


def _pairs(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def fingerprint_pairs(nodes: DataFrame) -> DataFrame:
    """Pairs of nodes (node, fp) that SimHash links: nodes of a fingerprint with its first one, and the first ones of linked fingerprints."""
    classes = written(nodes.groupBy("fp").agg(F.min("node").alias("first")), "near-fingerprints")
    own = nodes.join(classes, "fp").filter("node <> first").select(*_pairs(F.col("node"), F.col("first")))
    found = simhash.links(classes.select("fp"))
    for side in ("a", "b"):
        found = found.join(classes.select(F.col("fp").alias(side), F.col("first").alias(f"{side}_node")), side)
    return own.unionByName(found.select(*_pairs(F.col("a_node"), F.col("b_node")))).distinct()


def star_pairs(keys: DataFrame, turn: int) -> DataFrame:
    """Each node of a shingle with one node of the shingle, another one at each turn; of nodes that are apart."""
    first = F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("by"), "node", "n", "root"))
    rows = attach_group_stats(keys.select("h", "node", "n", "root"), ["h"], {"_first": first})
    apart = rows.filter((F.col("root") != F.col("_first.root")) & _near_in_size(F.col("n"), F.col("_first.n")))
    return apart.select(*_pairs(F.col("node"), F.col("_first.node"))).distinct()


def _within(blocks: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of places of a block (ascending numbers), some millions at a time."""
    n = len(blocks)
    ends = np.searchsorted(blocks, blocks, side="right")
    partners = ends - np.arange(n) - 1
    total = np.cumsum(partners)
    start = 0
    while start < n:
        end = max(start + 1, int(np.searchsorted(total, (total[start - 1] if start else 0) + PAIR_ROWS, side="right")))
        some = partners[start:end]
        a = np.repeat(np.arange(start, end), some)
        yield a, a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(some) - some, some)
        start = end


def _open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs that may be similar, of rows sorted by block (h, band, low, high)."""
    release()

    def found(table: pa.Table, blocks: np.ndarray) -> Iterator[pa.RecordBatch]:
        node, n, pos, root, upper, low, high, tile = (table.column(c).to_numpy() for c in ("node", "n", "pos", "root", "upper", "low", "high", "tile"))
        bits = np.stack([c.to_numpy() for c in table.column("bits").flatten()], axis=1).view(np.uint64)
        for a, b in _within(blocks):
            size, other = n[a], n[b]
            kept = (root[a] != root[b]) & (np.minimum(size, other) * WHOLE >= np.maximum(size, other) * PART) & ~(upper[a] & upper[b])
            kept &= (low[a] == high[a]) | (tile[a] != tile[b])
            # the shingle itself and what comes after it
            kept &= np.minimum(size - pos[a], other - pos[b]) * (PART + WHOLE) >= (size + other) * PART
            a, b, both = a[kept], b[kept], (size + other)[kept]
            kept = np.bitwise_count(bits[a] ^ bits[b]).sum(axis=1, dtype=np.int64) * (PART + WHOLE) <= both * (WHOLE - PART)
            a, b = node[a[kept]], node[b[kept]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        waiting.append(batch)
        if sum(b.num_rows for b in waiting) < 20_000:
            continue
        table = pa.Table.from_batches(waiting)
        blocks = _numbered(table)
        whole = int(np.searchsorted(blocks, blocks[-1]))
        if whole:
            yield from found(table.slice(0, whole), blocks[:whole])
        waiting = table.slice(whole).to_batches()
    if waiting and any(b.num_rows for b in waiting):
        table = pa.Table.from_batches(waiting)
        yield from found(table, _numbered(table))


def _numbered(table: pa.Table) -> np.ndarray:
    new = np.zeros(table.num_rows, bool)
    for c in ("h", "band", "low", "high"):
        x = table.column(c).to_numpy()
        new[1:] |= x[1:] != x[:-1]
    return np.cumsum(new)


def open_pairs(keys: DataFrame, bits: DataFrame, tile: int = TILE) -> DataFrame:
    """Pairs of nodes of a shingle that are apart and may be similar; `bits` has the nodes' parities.

    Similar sets are of one band of sizes or of neighbouring ones, so a node stands in its own band and in the one below, there as `upper`.
    """
    mixed = written(attach_group_stats(keys, ["h"], {"_low": F.min("root"), "_high": F.max("root")}).filter("_low <> _high"), "near-mixed")
    own = F.floor(F.ln("n") / log(WHOLE / PART)).cast("int")
    bands = mixed.withColumn("upper", F.explode(F.array(F.lit(False), F.lit(True)))).withColumn("band", own - F.col("upper").cast("int"))
    sized = attach_group_stats(bands.select("h", "node", "n", "pos", "root", "upper", "band"), ["h", "band"], {"rows": F.count(F.lit(1)), "least": F.min(F.col("upper").cast("int"))})
    dealt = sized.filter("rows > 1 AND least = 0").withColumn("tiles", F.ceil(F.col("rows") / tile).cast("int"))
    dealt = dealt.withColumn("tile", F.pmod(F.xxhash64("node"), "tiles").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    paired = dealt.withColumn("low", F.least("tile", "other")).withColumn("high", F.greatest("tile", "other")).join(bits, "node")
    block = ["h", "band", "low", "high"]
    rows = paired.select(*block, "tile", "node", "n", "pos", "root", "upper", "bits").repartition(partitions(), *block).sortWithinPartitions(*block)
    return rows.mapInArrow(_open, "a long, b long").distinct()


def _similar_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    release()
    known: dict[int, np.ndarray] = {}
    size = 0

    def of(node: int, text: pa.Scalar) -> np.ndarray:
        nonlocal size
        if node not in known:
            if size > SET_ITEMS:
                known.clear()
                size = 0
            known[node] = shingles(text.as_py())
            size += len(known[node]) + 100
        return known[node]

    for batch in batches:
        nodes = zip(batch.column("a").to_pylist(), batch.column("b").to_pylist())
        texts = zip(batch.column("a_text"), batch.column("b_text"))  # one text at a time is made
        near = [similar(of(a, s), of(b, t)) for (a, b), (s, t) in zip(nodes, texts)]
        yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))


def _with_text(pairs: DataFrame, texts: DataFrame, hubs: DataFrame, side: str, other: str) -> DataFrame:
    """The pairs with the text of the row `side`_row. A row of `hubs` (side, row, copies) comes in copies, so that its pairs are spread."""
    at = f"{side}_row"
    dealt = hubs.filter(F.col("side") == side).select(F.col("row").alias(at), F.col("copies").alias("_copies"))
    copies = F.coalesce("_copies", F.lit(1).cast("long"))
    wanted = pairs.join(dealt, at, "left").withColumn("_copy", F.pmod(F.xxhash64(other), copies)).drop("_copies")
    named = texts.select(F.col("row").alias(at), F.col("text").alias(f"{side}_text"))
    spread = named.join(dealt, at, "left").withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), copies - 1))).drop("_copies")
    return wanted.join(spread, [at, "_copy"]).drop("_copy")


def similar_pairs(pairs: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts (row, text) are similar. Sizes and parities (nodes: node, row, n, bits) drop most others before texts are sent.

    The copies of texts are counted and written before any text is joined: a side's count would hold the plan of the other side's join again.
    """
    rows = pairs
    for side in "ab":
        rows = rows.join(nodes.select(F.col("node").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in ("row", "n", "bits")]), side)
    apart = _flipped("a_bits", "b_bits")
    rows = rows.filter(_near_in_size(F.col("a_n"), F.col("b_n")) & (apart * (PART + WHOLE) <= (F.col("a_n") + F.col("b_n")) * (WHOLE - PART)))
    rows = written(rows.select("a", "b", "a_row", "b_row"), "near-candidates")
    ends = rows.select(F.explode(F.array(*[F.struct(F.lit(side).alias("side"), F.col(f"{side}_row").alias("row")) for side in "ab"])).alias("end"))
    copies = ends.groupBy("end.side", "end.row").agg(F.ceil(F.count(F.lit(1)) / HUB_PAIRS).alias("copies"))
    hubs = written(copies.filter("copies > 1"), "near-hubs")
    for side, other in (("a", "b"), ("b", "a")):
        rows = _with_text(rows, texts, hubs, side, other)
    return rows.select("a", "b", "a_text", "b_text").mapInArrow(_similar_pairs, "a long, b long")


def _flipped(a: str, b: str) -> Column:
    """Number of bits in which two parities (columns of eight numbers) differ."""
    out = F.lit(0)
    for w in WORDS:
        out = out + F.bit_count(F.col(f"{a}.{w}").bitwiseXOR(F.col(f"{b}.{w}")))
    return out


def groups(keys: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, root) of the nodes that are linked to others, from the prefixes' shingles (h, node, n, pos), the nodes (node, row, n, fp, bits) and the rows' texts."""
    tried = found = None
    facts = nodes.select("node", "row", "n", "bits")
    for turn in range(-1, STARS + 1):
        if turn < 0:
            pairs = fingerprint_pairs(nodes.select("node", "fp"))
        else:
            now = written(keys.join(found, "node", "left").withColumn("root", F.coalesce("root", "node")), "near-rooted")
            pairs = star_pairs(now, turn) if turn < STARS else open_pairs(now, nodes.select("node", "bits"))
        pairs = written(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), "near-pairs")
        good = written(similar_pairs(pairs, facts, texts), "near-links")
        tried = pairs if tried is None else tried.unionByName(pairs)
        # a node and its root stand for all links found before
        found = simhash.components(good if found is None else good.unionByName(found.filter("node <> root").toDF("a", "b")))
    return found


def keep_one(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of `docs`, with all their columns, that stay when one document of each group of near copies is kept: the one with the smallest id.

    Groups are linked by any number of similar pairs. Null ids come last, of rows that share the smallest id one is kept, null texts and texts
    without words are copies of each other, and columns may have any names. An empty table stays empty.
    """
    names = [f"_c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    key, text = names[docs.columns.index(id_column)], names[docs.columns.index(text_column)]
    sent = docs.sparkSession.sparkContext.broadcast(common_shingles(plain, text))

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in small_batches(batches):
            found = [shingles(t) for t in batch.column(text).to_pylist()]
            nodes = pa.array([xxhash.xxh64_intdigest(h.tobytes(), SEED) - (1 << 63) for h in found], pa.int64())
            heads = pa.array([prefix(h, sent.value).view(np.int64) for h in found], pa.list_(pa.int64()))
            sizes = pa.array([len(h) for h in found], pa.int64())
            prints = pa.array([simhash.majority(h) for h in found], pa.int64())
            bits = pa.StructArray.from_arrays([pa.array(w) for w in np.stack([parity(h) for h in found], axis=1).view(np.int64)], names=WORDS)
            yield pa.RecordBatch.from_arrays([*batch.columns, nodes, sizes, heads, prints, bits], names=[*batch.schema.names, "_node", "_n", "_prefix", "_fp", "_bits"])

    more = [T.StructField(c, t) for c, t in (("_node", T.LongType()), ("_n", T.LongType()), ("_prefix", T.ArrayType(T.LongType())), ("_fp", T.LongType()), ("_bits", T.StructType([T.StructField(w, T.LongType()) for w in WORDS])))]
    marked = plain.mapInArrow(added, T.StructType([*plain.schema, *more]))
    marked = written(marked.withColumn("_row", F.monotonically_increasing_id()), "near-documents")
    ident = F.col(key).cast("long")
    best = F.min(F.struct(ident.isNull().alias("none"), ident.alias("id"), F.col("_row").alias("row"))).alias("best")
    firsts = written(marked.groupBy(F.col("_node").alias("node")).agg(best), "near-nodes")
    # a node is the row that stands for it; texts stay where they are until a pair needs them
    own = marked.join(firsts.select(F.col("best.row").alias("_row")), "_row", "left_semi")
    nodes = own.select(F.col("_node").alias("node"), F.col("_row").alias("row"), F.col("_n").alias("n"), F.col("_fp").alias("fp"), F.col("_bits").alias("bits"))
    nodes = written(nodes, "near-facts")
    # one shuffle by shingle serves the count and the join
    heads = own.select(F.col("_node").alias("node"), F.col("_n").alias("n"), F.posexplode("_prefix").alias("pos", "h")).repartition("h")
    shared = heads.groupBy("h").agg(F.count(F.lit(1)).alias("_rows")).filter("_rows > 1")
    keys = written(heads.join(shared.select("h"), "h", "left_semi").select("h", "node", "n", "pos"), "near-shingles")
    found = groups(keys, nodes, marked.select(F.col("_row").alias("row"), F.col(text).cast("string").alias("text")))
    placed = firsts.join(found, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("best").alias("best"))
    return marked.join(placed.select(F.col("best.row").alias("_row")), "_row", "left_semi").select(*names).toDF(*docs.columns)
