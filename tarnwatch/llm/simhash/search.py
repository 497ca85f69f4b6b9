"""SimHash near-duplicates: fingerprints, and exact links of at most ``radius`` differing bits.

A text is lower-cased (A-Z); its words are ``[^\\x20\\x09-\\x0D]+`` and its shingles ``width``
words joined by one space, repeats included.  Fewer words are one shingle, none give
fingerprint zero.  A fingerprint bit is set if it is set in over half the XXH64 hashes
(seed 42) of the shingles.

Links are found over the *distinct* fingerprints by vantage-point search, in two levels:

* Shards are rings around vantage points.  Two fingerprints within ``radius`` differ in no bit of at
  least one of ``radius + 1`` bands, so in that band their distance is 0 and by the triangle bound
  they have the same distances to any vantage point there.  For every band the pivots are
  fingerprints of the table (those of the smallest hashes), as many as bring shards to about
  ``SHARD_TARGET`` rows; a shard holds those of equal distances to all of them.  A fingerprint is in
  one shard for each band, and no boundary between shards is missed.  (Rings over all 64 bits would
  have to overlap by ``radius`` on both sides: distances of unrelated prints lie within 32 +- 4, so
  each such split would copy most rows.)
* Within a shard a vantage-point tree is built over whole 64-bit distances and walked with blocks of
  fingerprints: of the two sides of a node only the rims within ``radius`` of its border are
  compared, the rest is pruned by the triangle bound; ``LEAF`` rows are compared outright.
* A shard of over ``shard_rows`` fingerprints is split again into rings by distance from one
  vantage point.  Each ring is paired with itself and with the next one only, since farther
  rings are out of reach.  Still larger rings are salted, every pair of salts being one piece.

Each piece of work returns a spanning forest of its links (its rows less one at most), never
all pairs; components follow from these edges, up to ``MAX_LOCAL_EDGES`` of them on the driver, of
more by alternating large and small stars.

Defined cases: null and empty texts have fingerprint zero and are linked like any other;
repeated rows share a component; null doc_ids keep their row and never name a component
unless it has no other id; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import settled, small_batches
from ..textbytes import LOWER, SOLID, blocks, column_bytes, runs, tidy

WIDTH, SEED, RADIUS, SHARD_ROWS = 3, 42, 3, 50_000
SHARD_TARGET, LEAF, MAX_PIVOTS = 512, 32, 8
MAX_LOCAL_EDGES = 100_000
_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))  # fixed values of XXH64


def _rotl(x: np.ndarray, k: int) -> np.ndarray:
    return (x << np.uint64(k)) | (x >> np.uint64(64 - k))


def xxh64_runs(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of many byte runs; those of 32 bytes and more one by one."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    h = (np.uint64(seed) + _P5) + sizes.astype(np.uint64)
    short = sizes < 32
    at = starts.copy()
    for lane in range(3):
        sel = np.flatnonzero(short & (sizes >= 8 * lane + 8))
        if len(sel):
            k = _rotl(eight[at[sel]] * _P2, 31) * _P1
            h[sel] = _rotl(h[sel] ^ k, 27) * _P1 + _P4
            at[sel] += 8
    sel = np.flatnonzero(short & (sizes & 4 > 0))
    k = (eight[at[sel]] & np.uint64(0xFFFFFFFF)) * _P1
    h[sel] = _rotl(h[sel] ^ k, 23) * _P2 + _P3
    at[sel] += 4
    for left in range(3):
        sel = np.flatnonzero(short & (sizes & 3 > left))
        h[sel] = _rotl(h[sel] ^ (padded[at[sel]].astype(np.uint64) * _P5), 11) * _P1
        at[sel] += 1
    h ^= h >> np.uint64(33)
    h *= _P2
    h ^= h >> np.uint64(29)
    h *= _P3
    h ^= h >> np.uint64(32)
    raw = data.tobytes() if not short.all() else b""
    for i in np.flatnonzero(~short).tolist():
        a = int(starts[i])
        h[i] = xxhash.xxh64_intdigest(raw[a : a + int(sizes[i])], seed)
    return h


#: byte -> its eight bits, each in a byte of its own
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view("<u8").ravel()


def majority(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Per segment ``first[i]:first[i+1]`` of hashes the bits set in over half of them."""
    n = len(first) - 1
    sizes = np.diff(first)
    out = np.zeros(n, np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    # byte-wide counters hold 255 rows: sums over pieces of that length first, then wide sums
    pieces = -(-sizes[full] // 255)
    begin = np.repeat(first[:-1][full], pieces) + 255 * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    owner = np.cumsum(pieces) - pieces
    big_endian = h.astype(">u8").view(np.uint8).reshape(-1, 8)
    bits = np.empty((len(full), 64), np.int64)
    for byte in range(8):
        counts = np.add.reduceat(_SPREAD[big_endian[:, byte]], begin).view(np.uint8).reshape(-1, 8)
        bits[:, 8 * byte : 8 * byte + 8] = np.add.reduceat(counts.astype(np.int64), owner, axis=0)
    out[full] = np.packbits(2 * bits > sizes[full][:, None], axis=1).view(">u8").ravel()
    return out


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, width: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of all shingles of a block of documents, and where each document's begin and end."""
    data = LOWER[data]
    starts, ends = runs(SOLID[data], offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    first = np.searchsorted(starts, offsets)
    # words with exactly one space after each
    size = ends - starts
    close = np.cumsum(size + 1)
    begin = close - size - 1
    keep = np.zeros(len(data) + 1, np.int8)
    keep[starts] += 1
    keep[ends] -= 1
    tight = np.full(int(close[-1]), 32, np.uint8)
    inside = np.ones(len(tight), bool)
    inside[close - 1] = False
    tight[inside] = data[np.cumsum(keep[:-1]).astype(bool)]
    words = np.diff(first)
    shingles = np.where(words >= width, words - width + 1, np.minimum(words, 1))
    edge = np.concatenate([[0], np.cumsum(shingles)])
    word = np.arange(edge[-1]) - np.repeat(edge[:-1], shingles) + np.repeat(first[:-1], shingles)
    last = word + np.repeat(np.minimum(words, width), shingles) - 1
    return xxh64_runs(tight, begin[word], close[last] - 1 - begin[word], seed), edge


def fingerprint_block(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH, seed: int = SEED) -> np.ndarray:
    """Fingerprints of a block of documents."""
    return majority(*shingle_hashes(data, offsets, width, seed))


@tidy
def _fingerprints(batches, width: int, seed: int):
    for batch in batches:
        data, offsets = column_bytes(batch.column(batch.schema.get_field_index("text")))
        found = [fingerprint_block(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], width, seed) for a, b in blocks(offsets)]
        keys = batch.column(batch.schema.get_field_index("doc_id"))
        yield pa.RecordBatch.from_arrays([keys, pa.array(np.concatenate(found).view(np.int64) if found else np.zeros(0, np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame, width: int = WIDTH, seed: int = SEED) -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long) of every row."""
    return small_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lambda it: _fingerprints(it, width, seed), "doc_id long, fp long")


class _Forest:
    """Union of rows by smallest root; joins that changed something are the edges."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def root(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return int(i)

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        if i != j:
            self.parent[max(i, j)] = min(i, j)

    def roots(self) -> np.ndarray:
        out = self.parent
        while (out[out] != out).any():
            out = out[out]
        return out


def _far(fp: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Differing bits of all pairs of rows between two blocks; a print is one word or a row of words."""
    if fp.ndim == 1:
        return np.bitwise_count(fp[left][:, None] ^ fp[right][None, :])
    far = np.zeros((len(left), len(right)), np.uint16)
    for k in range(fp.shape[1]):
        far += np.bitwise_count(fp[left, k][:, None] ^ fp[right, k][None, :])
    return far


def _reach(radius: int | np.ndarray, left: np.ndarray, right: np.ndarray) -> int | np.ndarray:
    """The bound of each pair: the larger of both rows' where rows have their own."""
    return np.maximum(radius[left][:, None], radius[right][None, :]) if isinstance(radius, np.ndarray) else radius


def _link(forest: _Forest, fp: np.ndarray, left: np.ndarray, right: np.ndarray, radius: int | np.ndarray) -> None:
    """Joins all linked pairs of rows between two blocks."""
    step = max(1, (1 << 20 if fp.ndim == 1 else 1 << 18) // max(1, len(right)))
    for k in range(0, len(left), step):
        part = left[k : k + step]
        a, b = np.nonzero(_far(fp, part, right) <= _reach(radius, part, right))
        pairs = np.stack([part[a], right[b]])
        # drop what is joined already
        while pairs.shape[1]:
            roots = forest.roots()
            pairs = pairs[:, roots[pairs[0]] != roots[pairs[1]]]
            if not pairs.shape[1]:
                break
            low, high = np.minimum(roots[pairs[0]], roots[pairs[1]]), np.maximum(roots[pairs[0]], roots[pairs[1]])
            best = np.full(len(fp), len(fp))
            np.minimum.at(best, high, low)
            moved = np.flatnonzero(best < len(fp))
            forest.parent = roots
            forest.parent[moved] = best[moved]


def vantage_forest(fp: np.ndarray, radius: int | np.ndarray = RADIUS, leaf: int = LEAF, seen: dict | None = None) -> np.ndarray:
    """Root row of each row's component under links within ``radius``, by a vantage-point tree.

    Prints are words, or rows of several; ``radius`` is one number, or one a row (of a pair the larger holds).

    A node's rows are ordered by distance from its vantage point.  The halves on either side of
    the median become its children; only the rows within ``radius`` of the border (by the
    triangle bound nothing else can link across) are compared between them.  A node whose rows
    are all connected already has nothing to add.  ``seen`` counts nodes and compared pairs.
    """
    forest = _Forest(len(fp))
    stack = [np.arange(len(fp))]
    seen = {} if seen is None else seen

    def link(left: np.ndarray, right: np.ndarray) -> None:
        seen["pairs"] = seen.get("pairs", 0) + len(left) * len(right)
        _link(forest, fp, left, right, radius)

    while stack:
        rows = stack.pop()
        if len(rows) <= leaf:
            link(rows, rows)
            continue
        seen["nodes"] = seen.get("nodes", 0) + 1
        far = _far(fp, rows[:1], rows)[0].astype(np.int64)
        near = rows[far <= np.ravel(_reach(radius, rows[:1], rows))]
        most = int(np.max(radius[rows])) if isinstance(radius, np.ndarray) else radius
        if len(near) > 1:
            forest.parent = forest.roots()
            tops = np.unique(forest.parent[near])
            forest.parent[tops] = tops[0]
            forest.parent = forest.roots()
            if (forest.parent[rows] == forest.parent[rows[0]]).all():
                continue
        cut = int(np.median(far))
        inner, outer = rows[far <= cut], rows[far > cut]
        if not len(outer):
            cut -= 1
            inner, outer = rows[far <= cut], rows[far > cut]
        if not len(inner) or not len(outer):
            link(rows, rows)
            continue
        rim, beyond = far[far <= cut], far[far > cut]
        stride = max(1, most // 8)
        for d in range(max(0, cut - most + 1), cut + 1, stride):
            a, b = inner[(rim >= d) & (rim < d + stride)], outer[beyond <= min(d + stride - 1, cut) + most]
            if len(a) and len(b):
                link(a, b)
        stack += [inner, outer]
    return forest.roots()


@tidy
def _shard_edges(batches, radius: int):
    """Edges within each shard of a partition sorted by shard; a shard may span batches."""

    def found(shard: np.ndarray, fp: np.ndarray):
        border = np.concatenate([[0], np.flatnonzero(shard[1:] != shard[:-1]) + 1, [len(shard)]])
        lefts, rights = [], []
        for a, b in zip(border[:-1].tolist(), border[1:].tolist(), strict=True):
            if b - a > 1:
                roots = vantage_forest(fp[a:b], radius)
                moved = np.flatnonzero(roots != np.arange(b - a))
                lefts.append(fp[a:b][moved])
                rights.append(fp[a:b][roots[moved]])
        if lefts:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(lefts).view(np.int64)), pa.array(np.concatenate(rights).view(np.int64))], ["a", "b"])

    shard, fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    for batch in batches:
        shard = np.concatenate([shard, batch.column(0).to_numpy(zero_copy_only=False)])
        fp = np.concatenate([fp, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)])
        if len(shard):
            cut = int(np.searchsorted(shard == shard[-1], True)) if shard[0] != shard[-1] else 0
            if cut:
                yield from found(shard[:cut], fp[:cut])
                shard, fp = shard[cut:], fp[cut:]
    if len(shard):
        yield from found(shard, fp)


def pivots(distinct: DataFrame, shard_target: int = SHARD_TARGET) -> list[int]:
    """Vantage points: the fingerprints of the smallest hashes, enough for shards of about ``shard_target`` rows.

    Two unrelated prints have the same distance to a pivot in a band of 16 bits once in 7 times; a
    band's 16 bits are told apart by ``MAX_PIVOTS`` well enough.
    """
    n = distinct.count()
    many = min(MAX_PIVOTS, max(1, math.ceil(math.log(max(1, n) / shard_target, 7)))) if n > shard_target else 1
    return [r.fp for r in distinct.orderBy(F.xxhash64("fp"), "fp").limit(many).collect()]


def _rings(points: list[int], radius: int) -> Column:
    """Array of (band, shard): the band, and the distances to every vantage point within it, as one number."""
    bands, out = radius + 1, []
    for k in range(bands):
        low, high = 64 * k // bands, 64 * (k + 1) // bands
        mask = (1 << (high - low)) - 1 << low
        mask -= (mask >> 63) << 64  # as a signed long
        far = [F.bit_count(F.col("fp").bitwiseXOR(F.lit(p)).bitwiseAND(F.lit(mask))) for p in points]
        out.append(F.struct(F.lit(k).alias("band"), F.xxhash64(F.lit(k), *far).alias("shard")))
    return F.array(*out)


def edges(distinct: DataFrame, radius: int = RADIUS, shard_rows: int = SHARD_ROWS, shard_target: int = SHARD_TARGET) -> DataFrame:
    """Links (a, b) that connect all of the distinct fingerprints that are linked at all."""
    points = pivots(distinct, shard_target)
    placed = distinct.select("fp", F.explode(_rings(points, radius)).alias("p")).select("fp", "p.shard")
    hot = settled(placed.groupBy("shard").agg(F.count("*").alias("n"), F.min("fp").alias("vantage")).where(F.col("n") > shard_rows))
    if hot.limit(1).count():
        split = placed.join(hot, "shard")
        ring = F.floor(F.bit_count(F.col("fp").bitwiseXOR(F.col("vantage"))) / (radius + 1))
        split = split.withColumn("ring", F.explode(F.array(ring, ring + 1)))
        rings = settled(split.groupBy("shard", "ring").agg(F.count("*").alias("m")).withColumn("salts", F.ceil(F.col("m") / shard_rows).cast("int")))
        split = split.join(rings, ["shard", "ring"])
        salt = F.pmod(F.xxhash64("fp"), F.col("salts")).cast("int")
        split = split.withColumn("salt", salt).withColumn("other", F.explode(F.expr("sequence(0, salts - 1)")))
        piece = F.xxhash64("shard", "ring", F.least("salt", "other"), F.greatest("salt", "other"))
        cold = placed.join(hot.select("shard"), "shard", "left_anti")
        placed = cold.select("fp", "shard").unionByName(split.select("fp", piece.alias("shard")))
    n = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return placed.select("shard", "fp").repartition(n, "shard").sortWithinPartitions("shard", "fp").mapInArrow(lambda it: _shard_edges(it, radius), "a long, b long")


def least_connected(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All nodes of the edges but the smallest of each component, and beside each the smallest one."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = at[: len(a)], at[len(a) :]
    parent = np.arange(len(nodes))
    while len(left):
        # of each root's smaller neighbours the smallest; two connected roots at least become one, so few rounds do
        low, high = np.minimum(parent[left], parent[right]), np.maximum(parent[left], parent[right])
        np.minimum.at(parent, high, low)
        while (parent[parent] != parent).any():
            parent = parent[parent]
        apart = parent[left] != parent[right]
        left, right = left[apart], right[apart]
    moved = np.flatnonzero(parent != np.arange(len(nodes)))
    return nodes[moved], nodes[parent[moved]]


def components(links: DataFrame, max_rounds: int = 60, max_local_edges: int = MAX_LOCAL_EDGES) -> DataFrame:
    """node -> root (smallest connected node) for all nodes of the edges (a, b) that are not roots.

    Up to ``max_local_edges`` edges of 16 bytes are read by the driver: a round costs some 18 tasks a shuffle
    partition and their files, whatever few edges there are.  More are never gathered:

    Rounds of large star and small star: every node hands its larger neighbours, then its
    smaller ones, to the smallest node it knows.  Only minima per node are aggregated, before
    the shuffle too, so a hub costs no more than any other node.
    """
    spark = links.sparkSession
    now = settled(links.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).where("u <> v").distinct())
    if now.count() <= max_local_edges:
        edge = now.toArrow()
        node, root = least_connected(edge["v"].to_numpy(), edge["u"].to_numpy())
        return spark.createDataFrame(pa.table({"node": node, "root": root}), "node long, root long")
    before = None
    for _ in range(max_rounds):
        both = now.select(F.col("v").alias("x"), F.col("u").alias("y")).unionByName(now.select(F.col("u").alias("x"), F.col("v").alias("y")))
        least = settled(both.groupBy("x").agg(F.min("y").alias("y")).select("x", F.least("x", "y").alias("m")))
        large = settled(both.where("y > x").join(least, "x").select(F.col("y").alias("v"), F.col("m").alias("u")).where("u <> v").distinct())
        least = settled(large.groupBy("v").agg(F.min("u").alias("m")))
        handed = large.join(least, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).where("u <> v")
        now = settled(handed.unionByName(least.select("v", F.col("m").alias("u"))).distinct())
        state = now.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("v").alias("node"), F.col("u").alias("root"))


def near_duplicates(docs: DataFrame, width: int = WIDTH, seed: int = SEED, radius: int = RADIUS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable)."""
    prints = settled(fingerprints(docs, width, seed))
    distinct = settled(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(edges(distinct.select("fp"), radius, shard_rows))
    named = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = settled(named)
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = settled(named.join(ids, "root").select("fp", "component_id"))
    return prints.join(ids, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
