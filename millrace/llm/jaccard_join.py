"""N-gram Jaccard join by chosen paths.

A text is the set of its shingles of WIDTH words; a text of fewer words is one shingle. Texts with equal sets are one
node. A node's set is embedded as COORDINATES minhash values (tokens sampled from it), which agree between two nodes with a
probability equal to their similarity. A run is a tree of chosen paths: every bucket is split by the values of 1 / SIMILARITY
sampled coordinates on average, one and often a second, so that a pair at the threshold shares one child bucket on average
and lives on down the tree with the odds of a critical branching process (`run_finds`). Buckets of up to LEAF nodes are
compared by brute force on all coordinates; larger ones are split again, up to DEPTH times, and one that is still larger is
compared in pairs of blocks, so none is given up. Runs are repeated as often as the target recall asks for at the greatest depth.

Large groups of near copies can't be split, as all agree. Nodes of large buckets that are near their bucket's least node
are joined with it first, and a bucket whose nodes are all joined to each other this way has no pair left to find.

Pairs near enough in their coordinates only join nodes into clusters. Within a cluster every pair of sets is compared
exactly, in pairs of blocks if it is large, and what reaches the threshold is a link. No pair is ever a row: a block
pair gives each node its number of links and one node of its part. So links, and classes as their components, are exact
for all nodes that the runs brought together.

Null and empty texts have no shingle, no link, and are classes of their own. A repeated row is linked to its like.
Null ids are allowed and never are class ids of others unless all ids of a class are null. Other columns don't enter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from . import textscan as T
from .components import components

WIDTH, SIMILARITY = 5, 0.8
COORDINATES, LEAF, DEPTH, BLOCK = 64, 2000, 6, 400
RECALL = 0.9999
#: Share of equal coordinates from which two nodes are clustered; four standard deviations below the threshold.
NEAR = 0.6
BITS = 1 << 22
#: Ids, some 20 bytes each, that are broadcast.
BROADCAST_ROWS = 500_000

_U = np.uint64
_FACTORS = T.seeds(COORDINATES, 5)


def run_finds(similarity: float = SIMILARITY, levels: int = 1 + DEPTH) -> float:
    """The probability that a run brings a pair at this similarity into one bucket, after so many splits."""
    second = 1 / similarity - 1  # how often a split has a second coordinate
    lives = 1.0
    for _ in range(levels):
        apart = 1 - similarity * lives
        lives = 1 - apart * (1 - second + second * apart)
    return lives


def runs_for(recall: float, finds: float) -> int:
    """Runs after which a pair has been found with probability recall, if each finds it with probability `finds`."""
    return math.ceil(math.log(1 - recall) / math.log(1 - finds))


def _sets(text: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    """Distinct shingles of each row, in order of row and hash; their rows; the number of rows."""
    scan = T.scan(text)
    hashes, rows = T.words(scan).shingles(WIDTH)
    order = np.lexsort((hashes, rows))
    hashes, rows = hashes[order], rows[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])
    return hashes[new], rows[new], scan.rows


def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, text_hash, node (null without shingles) and the coordinates of every row."""
    for part in T.slices(batches, "text"):
        hashes, rows, n = _sets(part["text"])
        node, values = np.zeros(n, np.int64), np.zeros((n, COORDINATES), np.uint32)
        if len(hashes):
            first = np.flatnonzero(np.diff(rows, prepend=-1))
            held = rows[first]
            node[held] = T.mix(np.add.reduceat(T.mix(hashes ^ _U(99)), first) + np.diff(first, append=len(hashes)).astype(_U)).view(np.int64)
            for k in range(COORDINATES):
                values[held, k] = np.minimum.reduceat(hashes * _FACTORS[k], first) >> _U(32)
        none = np.bincount(rows, minlength=n) == 0
        yield pa.RecordBatch.from_arrays([part["doc_id"], part["text_hash"], pa.array(node, mask=none), pa.array([v.tobytes() for v in values], pa.binary())], ["doc_id", "text_hash", "node", "sketch"])


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each run of equal keys, which must stand together; runs of one row are passed over."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [np.asarray(batch[k]) for k in keys]
        edge = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        bounds = [0, *edge.tolist(), batch.num_rows]
        for lo, hi in zip(bounds, bounds[1:]):
            key = tuple(c[lo] for c in columns)
            if key != last:
                if sum(b.num_rows for b in held) > 1:
                    yield pa.Table.from_batches(held)
                held, last = [], key
            held.append(batch.slice(lo, hi - lo))
    if sum(b.num_rows for b in held) > 1:
        yield pa.Table.from_batches(held)


def leaders(near: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """For each node, the least node of its component in a symmetric matrix of links."""
    label = nodes.copy()
    big = np.iinfo(np.int64).max
    while True:
        new = np.minimum(label, np.where(near, label[None, :], big).min(1))
        if (new == label).all():
            return label
        label = new


def compare_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) that join the nodes of a bucket whose coordinates are near, one for each node but the least."""
    need = math.ceil(NEAR * COORDINATES)
    out: list[np.ndarray] = []
    for table in groups(batches, ["path"]):
        nodes = table["node"].to_numpy()
        values = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint32).reshape(len(nodes), COORDINATES)
        equal = np.zeros((len(nodes), len(nodes)), np.uint8)
        for k in range(COORDINATES):
            equal += values[:, k, None] == values[None, :, k]
        label = leaders(equal >= need, nodes)
        moved = label != nodes
        if moved.any():
            out.append(np.stack([nodes[moved], label[moved]]))
    if out:
        a, b = np.concatenate(out, axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def shared_counts(hashes: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sizes of the intersections of n sets, given as (hash, row) without repeats."""
    _, token, df = np.unique(hashes, return_inverse=True, return_counts=True)
    several = df[token] > 1
    token, rows = token[several], rows[several]
    _, token = np.unique(token, return_inverse=True)
    out = np.zeros((n, n), np.float32)
    order = np.argsort(token, kind="stable")
    token, rows = token[order], rows[order]
    tokens = int(token[-1]) + 1 if len(token) else 0
    width = min(max(256, (1 << 22) // max(n, 1)), max(tokens, 1))
    for lo in range(0, tokens, width):
        a, b = np.searchsorted(token, [lo, lo + width])
        part = np.zeros((n, width), np.float32)
        part[rows[a:b], token[a:b] - lo] = 1
        out += part @ part.T
    return out.astype(np.int64)


def compare_sets(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """node, links (to rows of docs, in this pair of blocks) and leader (the least node linked to it in this pair)."""
    percent = round(similarity * 1000)
    for table in groups(batches, ["cluster", "lo", "hi"]):
        nodes, block, copies = table["node"].to_numpy(), table["block"].to_numpy(), table["copies"].to_numpy()
        hashes, rows, n = _sets(pa.concat_arrays(table["text"].chunks))
        size = np.bincount(rows, minlength=n)
        both = shared_counts(hashes, rows, n)
        near = 1000 * both >= percent * (size[:, None] + size[None, :] - both)
        np.fill_diagonal(near, False)
        if table["lo"][0] != table["hi"][0]:
            near &= block[:, None] != block[None, :]
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array((near * copies[None, :]).sum(1)), pa.array(leaders(near, nodes))], ["node", "links", "leader"])


def near_first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) of each node that is near the first node of its bucket."""
    for batch in batches:
        mine, first = (np.frombuffer(b"".join(batch[k].to_pylist()), np.uint32).reshape(-1, COORDINATES) for k in ("sketch", "first_sketch"))
        near = pa.array((mine == first).sum(1) >= math.ceil(NEAR * COORDINATES))
        yield pa.RecordBatch.from_arrays([batch["node"].filter(near), batch["first"].filter(near)], ["a", "b"])


def _split(rows: DataFrame, similarity: float, depth: int) -> DataFrame:
    """(path, node) of the children of all buckets: one for each node and sampled coordinate. rows are (path, node, sketch)."""
    draw = lambda k: F.xxhash64("path", F.lit(depth), F.lit(k))
    also = F.pmod(draw(2), F.lit(1 << 20)) < int((1 / similarity - 1) * (1 << 20))
    coordinates = F.array_compact(F.array(F.pmod(draw(0), F.lit(COORDINATES)), F.when(also, F.pmod(draw(1), F.lit(COORDINATES)))))
    rows = rows.select("path", "node", "sketch", F.explode(F.array_distinct(coordinates)).alias("at")).withColumn("at", F.col("at").cast("int"))
    return rows.select(F.xxhash64("path", "at", F.substring("sketch", F.col("at") * 4 + 1, F.lit(4))).alias("path"), "node")


def _buckets(nodes: DataFrame, runs: int, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame | None]:
    """(path, node) of all buckets to compare, and links (a, b) of near nodes found on the way."""
    sketches = nodes.select("node", "sketch")
    rows = shared.written(_split(sketches.select(F.explode(F.expr(f"sequence(0L, {runs - 1}L)")).alias("path"), "node", "sketch"), similarity, 0), "paths")
    leaves, links, label = [], None, None
    for depth in range(1, DEPTH + 2):
        sizes = rows.groupBy("path").agg(F.count("*").alias("size"), F.min("node").alias("first")).where("size > 1")
        leaves.append(rows.join(sizes.where(F.col("size") <= LEAF).select("path"), "path"))
        large = shared.written(rows.join(sizes.where(F.col("size") > LEAF), "path"), "large")
        if large.isEmpty():
            break
        if links is None:
            firsts = large.select("path", "first").distinct().join(sketches.withColumnsRenamed({"node": "first", "sketch": "first_sketch"}), "first")
            links = shared.written(large.select("path", "node").join(sketches, "node").join(firsts, "path").mapInArrow(near_first, "a long, b long").where("a <> b").distinct(), "near-first")
            label = components(links)
        # A bucket within one component has no pair left to find.
        large = large.join(label, "node", "left")
        mixed = large.groupBy("path").agg(F.min("label").alias("least"), F.max("label").alias("most"), F.count("label").alias("known"), F.count("*").alias("n")).where("least is null or least <> most or known < n").select("path")
        large = shared.written(large.drop("label").join(mixed, "path"), "mixed")
        if large.isEmpty():
            break
        if depth <= DEPTH:
            rows = shared.written(_split(large.select("path", "node").join(sketches, "node"), similarity, depth), "paths")
        else:
            leaves.append(_block_pairs(large.withColumn("blocks", F.ceil(F.col("size") * 2 / LEAF).cast("long")), "path").select(F.xxhash64("path", "lo", "hi").alias("path"), "node"))
    out = leaves[0]
    for x in leaves[1:]:
        out = out.unionByName(x)
    return out, links


def _block_pairs(rows: DataFrame, *keys: str) -> DataFrame:
    """Each row once for every pair (lo, hi) of blocks that its own is one of; with a single block, once. lo = hi stands for pairs within a block."""
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).alias("block")
    rows = rows.select("*", block)
    rows = rows.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    return rows.select("*", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))


def only_hashed(docs: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """The rows of docs whose key (a 64-bit hash) may be among wanted: a bitmap of BITS bits, whatever wanted's size, is broadcast."""
    at = lambda c: F.pmod(c, F.lit(BITS))
    bits = wanted.select(at(F.col(key)).alias("bit")).groupBy(F.expr("bit div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, int(bit % 64))")).alias("bits"))
    hit = docs.withColumn("word", F.expr(f"pmod({key}, {BITS}L) div 64")).join(F.broadcast(bits), "word")
    return hit.where(f"(shiftright(bits, int(pmod({key}, {BITS}L) % 64)) & 1L) = 1").drop("word", "bits")


def of_ids(docs: DataFrame, known: DataFrame) -> DataFrame:
    """text of the rows of docs whose doc_id is in known (one row an id), with known's columns.

    Up to BROADCAST_ROWS ids are broadcast. For more, only rows that a bitmap of the ids lets through are shuffled.
    """
    rows = docs.select("doc_id", "text")
    if known.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(known), "doc_id")
    key = F.xxhash64(F.col("doc_id").cast("long")).alias("id_hash")
    rows = only_hashed(rows.select("*", key), "id_hash", known.select(key)).drop("id_hash")
    return rows.join(known.hint("shuffle_hash"), "doc_id")  # a hash join needs no sort of the texts


def _classified(docs: DataFrame, similarity: float, recall: float = RECALL) -> tuple[DataFrame, DataFrame]:
    """doc_id, text_hash, node and sketch of every row of docs, and class_id, class_size, n_links and first_row (the least row of the class: no id last, doc_id, text_hash) of every node."""
    hashed = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    members = shared.written(hashed.mapInArrow(sketch, "doc_id long, text_hash long, node long, sketch binary"), "sketches")
    nodes = shared.written(members.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least_id"), F.min("text_hash").alias("text_hash"), F.min(F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "text_hash")).alias("first_row"), F.count("*").alias("copies"), F.first("sketch").alias("sketch")), "nodes")

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets, known_links = _buckets(nodes, runs_for(recall, run_finds(similarity)), similarity)
    buckets = buckets.join(nodes.select("node", "sketch"), "node")
    links = buckets.repartition(n, "path").sortWithinPartitions("path").select("path", "node", "sketch").mapInArrow(compare_buckets, "a long, b long")
    clusters = components(links if known_links is None else links.unionByName(known_links))

    sizes = clusters.groupBy("label").agg(F.count("*").alias("size"))
    wanted = clusters.join(sizes, "label").join(nodes.drop("sketch"), "node").select("node", "text_hash", F.col("label").alias("cluster"), "copies", F.ceil(F.col("size") / BLOCK).cast("long").alias("blocks"))
    wanted = shared.written(wanted, "wanted")
    texts = only_hashed(docs.select(F.xxhash64("text").alias("text_hash"), "text"), "text_hash", wanted).groupBy("text_hash").agg(F.first("text").alias("text"))
    pairs = _block_pairs(wanted.join(texts, "text_hash").drop("text_hash"))
    pairs = pairs.select("cluster", "lo", "hi", "block", "node", "copies", "text").repartition(n, "cluster", "lo", "hi").sortWithinPartitions("cluster", "lo", "hi")
    found = shared.written(pairs.mapInArrow(lambda b: compare_sets(b, similarity), "node long, links long, leader long"), "found")

    label = components(found.select(F.col("node").alias("a"), F.col("leader").alias("b")))
    count = found.groupBy("node").agg(F.sum("links").alias("links"))
    known = nodes.drop("sketch", "text_hash").join(label, "node", "left").join(count, "node", "left").withColumn("label", F.coalesce("label", "node"))
    classes = known.groupBy("label").agg(F.min("least_id").alias("class_id"), F.sum("copies").alias("class_size"), F.min("first_row").alias("first_row"))
    known = known.drop("first_row").join(classes, "label").select("node", "class_id", "class_size", "first_row", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return members, shared.written(known, "classes")


def near_classes(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """doc_id, class_id (the least doc_id of the class), class_size and n_links (other rows at least so similar) for every row of docs (doc_id, text)."""
    members, known = _classified(docs, similarity, recall)
    with_set = members.where("node is not null").select("doc_id", "node").join(known.drop("first_row"), "node")
    alone = members.where("node is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(0).cast("long").alias("n_links"))
    return with_set.select("doc_id", "class_id", "class_size", "n_links").unionByName(alone)


def one_of_each(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of docs, of each class only the least by doc_id (nulls last), text hash and its other columns."""
    members, known = _classified(docs, similarity)
    held = members.where("node is not null").select("doc_id", "text_hash", "node").join(known.where("class_size > 1").select("node", "first_row"), "node")
    held = held.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n"), F.first("first_row").alias("first_row"))
    first = F.col("doc_id").eqNullSafe(F.col("first_row.doc_id")) & (F.col("text_hash") == F.col("first_row.text_hash"))
    # Of several rows with the first id and text, which a key can't tell apart, one is put back.
    gone = shared.written(held.where(~first | (F.col("n") > 1)).select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash"), first.alias("first")), "gone")
    rows = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"), F.struct("*").alias("row"))
    same = lambda: F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("hash") == F.col("gone_hash"))
    back = gone.where("first")
    again = only_hashed(rows, "hash", back.select(F.col("gone_hash").alias("hash"))).join(back, same()).groupBy("id", "hash").agg(F.min("row").alias("row"))
    return rows.join(gone, same(), "left_anti").select("row.*").unionByName(again.select("row.*"))


ORACLE = r"""
    WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    s AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS s FROM w WHERE len(w) > 0),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    l AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
          GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 10 * count(*) >= 8 * (x.n + y.n - count(*))),
    r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
    c AS (SELECT doc_id, least(doc_id, coalesce((SELECT min(b) FROM r WHERE r.a = documents.doc_id), doc_id)) AS class_id, (SELECT count(*) FROM l WHERE l.a = documents.doc_id) AS n_links FROM documents)
    SELECT doc_id, class_id, count(*) OVER (PARTITION BY class_id) AS class_size, n_links FROM c
"""
