"""N-gram Jaccard join: exact links between documents by their sets of word shingles.

1. Each text becomes the sorted set of its shingle hashes; equal sets become one node.
2. A linked pair shares a shingle among the first n - ceil(t n) + 1 of either set, in any order common to all sets (prefix
   filter). The order is by a fixed-size sketch of shingle frequencies, rare ones first, so common passages rarely lead anywhere.
3. The nodes of a shingle belong to the tile of the least node among them, so each candidate pair lies in some tile. Inside
   a tile, nodes are ordered by size; a node meets only those within its size band. Bit counts of hashed bitmaps bound each
   overlap from above. Bitmaps go to every tile first; sets, which are much larger, only to tiles where they have a pair that passes,
   and are intersected there exactly.
4. A tile of many nodes is cut. Each cut is joined to its tile's least node; what is then still apart is compared cut by cut, between
   neighbouring size bands, unless both cuts are known to be in the same component.

Components need only links that join something new, so a tile gives at most one link less than it has nodes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.steps import whole_jobs
from .common import batched, join_groups, saved, shuffle_parts
from .components import components
from .textcore import NON_SPACE, Words, by_key, column_bytes, kgrams, mix, pieces

CELLS = 1 << 18  # of the frequency sketch
MARKS = 1 << 23  # bits of the prefilter for texts that are read again
TILE_NODES, TILE_SHINGLES = 512, 1 << 20
MAX_BITS = 1 << 14
CUT_TILES = 100_000  # cut tiles whose list is broadcast (2 MB)


def shingle_sets(raw: list[bytes], k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text of fewer than k words, but not none, has one: all its words."""
    for a, b in pieces(raw):
        w = Words(raw[a:b], NON_SPACE)
        grams = kgrams(w.hash, k)
        for s, e in zip(w.doc_at[:-1].tolist(), w.doc_at[1:].tolist(), strict=True):
            yield np.unique(grams[s : e - k + 1]) if e - s >= k else kgrams(w.hash[s:e], e - s) if e > s else grams[:0]


def set_key(s: np.ndarray) -> tuple[int, int]:
    """128 bits of the set."""
    out = (mix(mix(s).sum(keepdims=True, dtype=np.uint64)), mix(mix(s ^ np.uint64(0xA5A5A5A55A5A5A5A)).sum(keepdims=True, dtype=np.uint64)))
    return int(out[0].view(np.int64)[0]), int(out[1].view(np.int64)[0])


def bitmap(s: np.ndarray) -> bytes:
    """One bit for each hash, in the power of two of bits that is at least the set's size (64 to MAX_BITS)."""
    m = min(MAX_BITS, max(64, 1 << int(len(s) - 1).bit_length()))
    bits = np.zeros(m, bool)
    bits[((s >> np.uint64(40)) & np.uint64(m - 1)).astype(np.int64)] = True
    return np.packbits(bits).tobytes()


class Tile:
    """Nodes of a tile in order of size, with their bitmaps folded to each size that occurs."""

    def __init__(self, n: np.ndarray, bitmaps: list[bytes], threshold: int):
        self.n, self.t = n.astype(np.int64), threshold
        self.m = np.array([len(b) for b in bitmaps]) * 8
        self.at, self.bits, self.count = {}, {}, {}
        for m in np.unique(self.m).tolist():
            own = np.flatnonzero(self.m >= m)  # a suffix: sizes ascend
            folded = np.empty((len(own), m // 8), np.uint8)
            for r, j in enumerate(own.tolist()):
                folded[r] = np.bitwise_or.reduce(np.frombuffer(bitmaps[j], np.uint8).reshape(-1, m // 8), axis=0)
            self.at[m], self.bits[m] = int(own[0]), folded.view(np.uint64)
            self.count[m] = np.bitwise_count(self.bits[m]).sum(axis=1).astype(np.int64)

    def partners(self, i: int) -> np.ndarray:
        """Later nodes in the size band of i whose overlap with i may reach the threshold."""
        n, t = self.n, self.t
        end = int(np.searchsorted(n, n[i] * 100 // t, "right"))
        if end <= i + 1:
            return np.empty(0, np.int64)
        m = int(self.m[i])
        a = self.at[m]
        bits, count = self.bits[m], self.count[m]
        w = slice(i + 1 - a, end - a)
        both = np.bitwise_count(bits[i - a] & bits[w]).sum(axis=1).astype(np.int64)
        most = np.minimum(n[i] - count[i - a] + both, n[i + 1 : end] - count[w] + both)
        return np.flatnonzero((100 + t) * most >= t * (n[i] + n[i + 1 : end])) + i + 1


def _near(group: pd.DataFrame, threshold: int) -> np.ndarray:
    """Of a tile with bitmaps: True for each node with a partner that isn't joined to it already, in the tile's order."""
    tile, labels = Tile(group["n"].to_numpy(), group["bits"].tolist(), threshold), group["label"].to_numpy()
    near = np.zeros(len(group), bool)
    for i in range(len(group)):
        p = tile.partners(i)
        p = p[labels[p] != labels[i]]
        if len(p):
            near[i] = near[p] = True
    return near


def _join(nodes: list[int], sets: list[np.ndarray], labels: list[int], threshold: int) -> list[tuple[int, int]]:
    """Links that join what is apart; nodes in order of set size, labels name what is joined already."""
    tile = Tile(np.array([len(s) for s in sets]), [bitmap(s) for s in sets], threshold)
    parent: dict[int, int] = {x: x for x in labels}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    links = []
    for i, s in enumerate(sets):
        for j in tile.partners(i).tolist():
            a, b = root(labels[i]), root(labels[j])
            if a != b:
                other = sets[j]
                both = int((other[np.minimum(np.searchsorted(other, s), len(other) - 1)] == s).sum())
                if (100 + threshold) * both >= threshold * (len(s) + len(other)):
                    parent[b] = a
                    links.append((nodes[i], nodes[j]))
    return links


def _sketch(digests: DataFrame) -> np.ndarray:
    """The sum of the partitions' sketches, which come packed. Its size is fixed; few tasks add up before the driver does."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.int64)
        for batch in batches:
            for x in batch.column(0).to_pylist():
                total += np.frombuffer(zlib.decompress(x), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(total.tobytes(), 1)])], ["sketch"])

    parts = digests.where("sketch is not null").select("sketch")
    parts = parts.coalesce(max(6, int(parts.rdd.getNumPartitions() ** 0.5))).mapInArrow(add, "sketch binary")
    total = np.zeros(CELLS, np.int64)
    for row in parts.toLocalIterator():
        total += np.frombuffer(zlib.decompress(row.sketch), np.int64)
    return total


def _digests(rows: DataFrame, k: int) -> DataFrame:
    """(id, h, n, hi, lo) of each row; each partition adds a row with only its shingle counts by cell."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(CELLS, np.int64)
        kind = None
        for batch in batches:
            kind, ids = batch.schema.field("id").type, batch.column("id")
            n, keys, held, waiting = [], [], [], 0
            for s in shingle_sets(column_bytes(batch, "text"), k):
                n.append(len(s))
                keys.append(set_key(s))
                held.append(s)
                waiting += len(s)
                if waiting >= CELLS:
                    cells += np.bincount((np.concatenate(held) & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS)
                    held, waiting = [], 0
            if held:
                cells += np.bincount((np.concatenate(held) & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS)
            yield pa.RecordBatch.from_arrays([ids, batch.column("h"), pa.array(n, pa.int64()), pa.array([x[0] for x in keys], pa.int64()), pa.array([x[1] for x in keys], pa.int64()), pa.nulls(len(n), pa.binary())], ["id", "h", "n", "hi", "lo", "sketch"])
        if kind is not None:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, kind), *(pa.nulls(1, pa.int64()),) * 4, pa.array([zlib.compress(cells.tobytes(), 1)])], ["id", "h", "n", "hi", "lo", "sketch"])

    kind = rows.schema["id"].dataType.simpleString()
    return batched(rows).mapInArrow(digest, f"id {kind}, h long, n long, hi long, lo long, sketch binary")


def _prefixes(rows: DataFrame, k: int, threshold: int, order: np.ndarray) -> DataFrame:
    """(id, n, hi, lo, bits, tokens): the bitmap and the prefix of each set that isn't empty."""
    sent = rows.sparkSession.sparkContext.broadcast(np.minimum(order, np.iinfo(np.uint32).max).astype(np.uint32))

    def prefix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = sent.value
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            at = []
            for i, s in enumerate(shingle_sets(column_bytes(batch, "text"), k)):
                n = len(s)
                if n:
                    at.append(i)
                    first = np.lexsort((s, cells[(s & np.uint64(CELLS - 1)).astype(np.int64)]))[: n + (-threshold * n) // 100 + 1]
                    for column, x in zip(out, (n, *set_key(s), bitmap(s), s[first].view(np.int64)), strict=True):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(at, pa.int64())), *(pa.array(x, pa.int64()) for x in out[:3]), pa.array(out[3], pa.binary()), pa.array(out[4], pa.list_(pa.int64()))], ["id", "n", "hi", "lo", "bits", "tokens"])

    kind = rows.schema["id"].dataType.simpleString()
    return batched(rows).mapInArrow(prefix, f"id {kind}, n long, hi long, lo long, bits binary, tokens array<long>")


def _sets(rows: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """(node, words) for nodes (node, id, hi, lo): the bytes of the sorted hashes. Texts are read again; a fixed-size bit table of the
    ids keeps most others from being sent to the join."""
    cell = F.pmod(F.xxhash64("id"), F.lit(MARKS)) + 1  # Spark's bitmaps count from 1
    found = nodes.select(cell.alias("c")).groupBy(F.bitmap_bucket_number("c").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("c")).alias("bits"))
    table = np.zeros(MARKS // 8, np.uint8)
    for row in found.collect():  # MARKS bits at most
        table[(row.k - 1) * 4096 : row.k * 4096] = np.frombuffer(row.bits, np.uint8)
    sent = rows.sparkSession.sparkContext.broadcast(table)

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = batch.column("c").to_numpy() - 1
            yield batch.filter(pa.array((sent.value[c >> 3] >> (c & 7).astype(np.uint8)) & 1 == 1))

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hi, lo = batch.column("hi").to_pylist(), batch.column("lo").to_pylist()
            at, words = [], []
            for i, s in enumerate(shingle_sets(column_bytes(batch, "text"), k)):
                if set_key(s) == (hi[i], lo[i]):
                    at.append(i)
                    words.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("node").take(pa.array(at, pa.int64())), pa.array(words, pa.binary())], ["node", "words"])

    with_cell = rows.withColumn("c", cell)
    texts = batched(with_cell).mapInArrow(marked, with_cell.schema).select(F.col("id").alias("_id"), "text")
    matched = texts.join(nodes, texts["_id"].eqNullSafe(nodes["id"])).select("node", "hi", "lo", "text")
    return batched(matched).mapInArrow(compute, "node long, words binary").dropDuplicates(["node"])


def _members(prefixes: DataFrame) -> DataFrame:
    """(center, node, n): the nodes of each shingle in the tile of the least among them. Shingles are most of what is shuffled, so they are sent
    once; a shingle's nodes spill to disk where they are many."""
    same = Window.partitionBy("token")
    tokens = prefixes.select("node", "n", F.explode("tokens").alias("token"))
    met = tokens.withColumns({"center": F.min("node").over(same), "last": F.max("node").over(same)}).where("center != last")
    return met.groupBy("center", "node").agg(F.first("n").alias("n"))


def _tiled(tiles: DataFrame) -> DataFrame:
    """tiles, dealt by their key and in order of key and size."""
    return tiles.repartition(shuffle_parts(tiles.sparkSession), "center", "x", "y").sortWithinPartitions("center", "x", "y", "n", "node")


def _passing(tiles: DataFrame, bitmaps: DataFrame, threshold: int) -> DataFrame:
    """The rows of tiles (center, x, y, node, n, label) that have a partner in their tile by the bitmaps."""

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in by_key(batches, ["center", "x", "y"]):
            group = group.drop_duplicates("node")
            yield group.loc[_near(group, threshold), ["center", "x", "y", "node", "n", "label"]]

    return _tiled(tiles.join(bitmaps, "node")).mapInPandas(near, "center long, x long, y long, node long, n long, label long")


def _links(tiles: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Links inside tiles (center, x, y, node, n, label)."""

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in by_key(batches, ["center", "x", "y"]):
            group = group.drop_duplicates("node")
            if len(group) > 1:
                links = _join(group["node"].tolist(), [np.frombuffer(x, np.uint64) for x in group["words"]], group["label"].tolist(), threshold)
                yield pd.DataFrame(links, columns=["a", "b"], dtype=np.int64)

    return _tiled(tiles.join(sets, "node")).mapInPandas(join, "a long, b long")


def _cuts(large: DataFrame, labels: DataFrame, threshold: int) -> DataFrame:
    """Pairs of cuts, as tiles, of the large tiles that hold several components: cuts of a component of their own unless it is small,
    by size band; never two of one component, never of bands that are too far apart."""
    named = large.drop("cuts").join(labels.withColumnRenamed("root", "label"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    apart = named.groupBy("center").agg(F.min("label").alias("l"), F.max("label").alias("m")).where("l != m").select("center")
    own = named.groupBy("center", "label").agg(F.count("*").alias("c")).where(F.col("c") > TILE_NODES).select("center", "label", F.col("label").alias("own"))
    band = F.floor(F.log("n") / -np.log(threshold / 100)).cast("long")
    rows = named.join(apart, "center").join(own, ["center", "label"], "left").withColumn("own", F.coalesce("own", F.lit(-1))).withColumn("band", band)
    sizes = rows.groupBy("center", "own", "band").agg(F.ceil(F.greatest(F.count("*") / TILE_NODES, F.sum("n") / TILE_SHINGLES)).alias("cuts"))
    rows = rows.join(sizes, ["center", "own", "band"]).withColumn("cut", F.pmod(F.xxhash64("node"), F.col("cuts")))
    rows = saved(rows.withColumn("tile", F.xxhash64("own", "band", "cut")).select("center", "own", "band", "tile", "node", "n", "label"))
    tiles = rows.select("center", "own", "band", "tile").distinct()
    a, b = tiles.select("center", F.col("own").alias("o1"), F.col("band").alias("b1"), F.col("tile").alias("x")), tiles.select("center", F.col("own").alias("o2"), F.col("band").alias("b2"), F.col("tile").alias("y"))
    pairs = a.join(b, "center").where("x <= y and abs(b1 - b2) <= 1 and (o1 = -1 or o1 != o2)").select("center", "x", "y")
    one = pairs.join(rows.withColumnRenamed("tile", "x"), ["center", "x"])
    two = pairs.where("x != y").join(rows.withColumnRenamed("tile", "y"), ["center", "y"])
    columns = ["center", "x", "y", "node", "n", "label"]
    return one.select(columns).union(two.select(columns))


def _nodes(rows: DataFrame, words: int, threshold: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(keys, nodes, labels): (id, h, n, hi, lo) of each row (id, text); (hi, lo, n, id, copies, node) of each distinct set; and the component of each node
    that is linked, as components gives it."""
    digests = saved(_digests(rows.select("id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), "text"), words))
    keys = digests.where("sketch is null").drop("sketch")
    nodes = saved(keys.where("n > 0").groupBy("hi", "lo", "n").agg(F.min("id").alias("id"), F.count("*").alias("copies")).withColumn("node", F.monotonically_increasing_id()))
    prefixes = _prefixes(rows, words, threshold, _sketch(digests))
    p, q = prefixes.alias("p"), nodes.alias("q")
    same = (F.col("p.hi") == F.col("q.hi")) & (F.col("p.lo") == F.col("q.lo")) & (F.col("p.n") == F.col("q.n")) & F.col("p.id").eqNullSafe(F.col("q.id"))
    prefixes = saved(p.join(q, same).select("node", F.col("p.n").alias("n"), "bits", "tokens"))

    members = saved(_members(prefixes))
    size = members.groupBy("center").agg(F.ceil(F.greatest(F.count("*") / TILE_NODES, F.sum("n") / TILE_SHINGLES)).alias("cuts"))
    cut = saved(size.where("cuts > 1"))
    # only the tiles that are cut are looked up; their list is broadcast where it is short
    few = F.broadcast if cut.count() <= CUT_TILES else lambda x: x
    zero = F.lit(0).cast("long")

    small = members.join(few(cut.select("center")), "center", "left_anti").select("center", zero.alias("x"), zero.alias("y"), "node", "n")
    bitmaps = prefixes.select("node", "bits").dropDuplicates(["node"])
    large = saved(members.join(few(cut), "center"))
    spread = large.where("node != center").select("center", F.pmod(F.xxhash64("node"), F.col("cuts")).alias("x"), zero.alias("y"), "node", "n")
    centers = large.where("node = center").select("center", F.explode(F.sequence(zero, F.col("cuts") - 1)).alias("x"), zero.alias("y"), "node", "n")
    tiles = saved(_passing(small.union(spread).union(centers).withColumn("label", F.col("node")), bitmaps, threshold))

    wanted = tiles.select("node").union(large.select("node")).distinct().join(nodes, "node").select("node", "id", "hi", "lo")
    sets = saved(_sets(rows, wanted, words))
    links = saved(_links(tiles, sets, threshold))
    labels = components(links)
    if large.take(1):
        more = saved(_links(_passing(_cuts(large, labels, threshold), bitmaps, threshold), sets, threshold))
        if more.take(1):
            labels = components(links.union(more))
    return keys, nodes, labels


def _components(rows: DataFrame, words: int, threshold: int) -> DataFrame:
    """(hi, lo, n, id, h, copies, component, component_id) of each row (id, text): the key of its set, the hash of its text, a number for its component (null without
    words), and the component's smallest id; see ngram_components."""
    with whole_jobs(rows.sparkSession):  # a hundred shuffles follow: each as a job with threads of its own is what fills the driver
        keys, nodes, labels = _nodes(rows, words, threshold)
    least = labels.join(nodes.select("node", "id"), "node").groupBy("root").agg(F.min("id").alias("least"))
    of_node = nodes.join(labels, "node", "left").join(least, "root", "left").select("hi", "lo", "n", "copies", F.coalesce("root", "node").alias("component"), F.coalesce("least", "id").alias("component_id"))
    found = join_groups(keys.where("n > 0"), of_node, ["hi", "lo", "n"], "copies", keys.count())
    alone = keys.where("n = 0").withColumns({"copies": F.lit(1).cast("long"), "component": F.lit(None).cast("long"), "component_id": F.col("id")})
    return found.unionByName(alone.select(*found.columns))


def ngram_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, threshold: int = 75) -> DataFrame:
    """id, n_shingles and component_id (the smallest id that links reach, its own included) of each row of docs.

    Words are runs of bytes other than white space after lower-casing A-Z. Two rows link when 100 * intersection >= threshold *
    union of their sets of shingles. A text of fewer than words words has one shingle, a null text or one without words none, and
    then links with nothing. Rows of equal sets link with each other. Null ids count as larger than all others: a component of
    null ids only has a null component_id. Repeated rows are each returned. Very long texts are shingled whole, in pieces of bounded size. Other
    columns are ignored, whatever their names. An empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return _components(rows, words, threshold).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, threshold: int = 75) -> DataFrame:
    """One row of docs of each component, with all its columns, whatever their names: the one of the smallest id (a null id is larger than all others);
    of several rows with that id the one whose text hashes least, and of rows of the same id and text any one. Rows without words belong to no
    component and all stay. Rules as in ngram_components."""
    found = _components(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), words, threshold)
    known = lambda c: (c.isNull().alias("none"), F.coalesce(c.cast("string"), F.lit("")).alias("i"))
    first = found.where("n > 0").groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "h")).alias("best"))
    first = first.select(*known(F.col("best.id")), F.col("best.h").alias("h"))
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    worded = F.coalesce(F.col(text_col).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    rows = docs.where(worded).select(*known(F.col(id_col)), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("h"), whole.alias("row"))
    kept = rows.join(first, ["none", "i", "h"], "left_semi").dropDuplicates(["none", "i", "h"])
    return kept.select("row.*").union(docs.where(~worded))
