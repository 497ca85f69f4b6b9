"""Near copies by similarity of word shingles, found through long SimHash fingerprints.

Two texts are near copies if the Jaccard similarity of their sets of ``width``-word shingles is
at least ``similarity``.  A link of a few bits of a 64-bit fingerprint finds only copies that are
all but equal: at similarity 0.8 the fingerprints differ in 10 bits of 64, where a bound that
catches them all would prune nothing.  Here a fingerprint has 256 bits, over distinct shingles:

* Shards: of a text's ``n`` distinct shingles the first ``n - ceil(similarity * n) + 1`` in one
  fixed order each name a shard.  Two texts of that similarity always share one of them, however
  many rows there are.  The order is that of the hashes, with shingles that are frequent in a
  sample of the texts last: which these are changes the size of shards, never what is found.
* In a shard the vantage-point tree of :mod:`.search` is walked over the long fingerprints; it gives a
  spanning forest of the pairs within ``RADIUS`` bits, or ``SHORT_RADIUS`` if either has ``SHORT``
  shingles or fewer, never all pairs; a shard of up to ``FEW`` rows is a leaf.  At so wide a bound the
  triangle bound parts few unrelated rows, but rows near a vantage point are connected by one
  comparison each.  The bits of a pair at 0.8 differ with probability of at most 0.1552, or 0.1875 in
  short texts (exact sums over halves of small sets), so a binomial distance lies beyond these bounds
  once in 10^7 pairs or less.  A shard of over ``shard_rows`` rows is split into rings by distance from
  one vantage point, each ring meeting the next one too, and still larger rings are salted, every pair
  of salts being one piece.  Components of these edges are clusters: whatever pair lies within the
  radius in some shard lies in one cluster.
* Within a cluster all pairs are confirmed on the full shingle sets, but for those that confirmed
  links connect already; no other pair is left out.  A cluster of over ``PIECE_SHINGLES``
  shingles is salted like a shard, so its work is quadratic.  Components of the confirmed links
  follow by large and small stars.

Defined cases: null and empty texts have no shingles and are copies of each other only; a text
of fewer words is one shingle; rows without a doc_id always stay; rows repeated with the same
doc_id stay or go together; extra columns pass through; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..exactdedup import MAX_BROADCAST_ROWS, without
from ..shared import likely, settled, small_batches
from ..textbytes import blocks, column_bytes, tidy
from .search import SEED, components, majority, shingle_hashes, vantage_forest

WIDTH, SIMILARITY, WORDS = 5, 0.8, 4
RADIUS, SHARD_ROWS, PIECE_SHINGLES = 72, 20_000, 1 << 20
SHORT, SHORT_RADIUS, FEW, SAMPLE_ROWS, FREQUENT, MAX_FREQUENT = 32, 90, 8, 20_000, 8, 1 << 16
PRINT = [f"w{k}" for k in range(WORDS)]


def _mixed(h: np.ndarray, lane: int) -> np.ndarray:
    x = (h + np.uint64(lane * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


def distinct_shingles(data: np.ndarray, offsets: np.ndarray, width: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each document of a block, and where each begins and ends."""
    h, edge = shingle_hashes(data, offsets, width, seed)
    owner = np.repeat(np.arange(len(edge) - 1), np.diff(edge))
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return h[new], np.searchsorted(owner[new], np.arange(len(edge)))


@tidy
def _prints(batches, width: int, seed: int, similarity: float, frequent: np.ndarray):
    for batch in batches:
        data, offsets = column_bytes(batch.column(1))
        for a, b in blocks(offsets):
            h, edge = distinct_shingles(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], width, seed)
            words = [pa.array(majority(_mixed(h, lane + 1), edge).view(np.int64)) for lane in range(WORDS)]
            sizes = np.diff(edge)
            owner = np.repeat(np.arange(b - a), sizes)
            h = h[np.lexsort((h, np.isin(h, frequent), owner))]
            first = np.where(sizes > 0, sizes - np.ceil(similarity * sizes - 1e-9).astype(np.int64) + 1, 0)
            h = h[np.arange(len(h)) - edge[owner] < first[owner]]
            prefix = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(first)]).astype(np.int32)), pa.array(h.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *words, pa.array(sizes <= SHORT), prefix], ["doc_id", *PRINT, "short", "prefix"])


@tidy
def _sets(batches, width: int, seed: int):
    for batch in batches:
        data, offsets = column_bytes(batch.column(1))
        for a, b in blocks(offsets):
            h, edge = distinct_shingles(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], width, seed)
            lists = pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), pa.array(h.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists], ["id", "shingles"])


def frequent_shingles(light: DataFrame, width: int, seed: int, sample_rows: int = SAMPLE_ROWS) -> np.ndarray:
    """Hashes of the shingles that are most frequent in a sample of the rows; ``MAX_FREQUENT`` at most."""
    every = max(1, light.count() // sample_rows)
    sample = light.where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0)
    counts = sample.mapInArrow(lambda it: _sets(it, width, seed), "id long, shingles array<long>").select(F.explode("shingles").alias("h")).groupBy("h").count()
    top = counts.where(F.col("count") >= FREQUENT).orderBy(F.desc("count"), "h").limit(MAX_FREQUENT).toPandas()
    return np.sort(top["h"].to_numpy(np.int64).view(np.uint64))


@tidy
def _candidates(batches):
    """Candidates within each shard of a partition sorted by shard and id; a shard may span batches."""

    def found(shard, ids, radius, words):
        border = np.concatenate([[0], np.flatnonzero(shard[1:] != shard[:-1]) + 1, [len(shard)]])
        sizes = np.diff(border)
        few = np.repeat(sizes <= FEW, sizes)
        lefts, rights = [], []
        for gap in range(1, FEW):
            i = np.flatnonzero(few[gap:] & (shard[gap:] == shard[:-gap]))
            if not len(i):
                break
            far = np.bitwise_count(words[i] ^ words[i + gap]).sum(axis=1, dtype=np.int64)
            i = i[far <= np.maximum(radius[i], radius[i + gap])]
            lefts.append(ids[i])
            rights.append(ids[i + gap])
        for k in np.flatnonzero(sizes > FEW).tolist():
            a, b = border[k], border[k + 1]
            roots = vantage_forest(words[a:b], radius[a:b])
            moved = np.flatnonzero(roots != np.arange(b - a))
            lefts.append(ids[a:b][roots[moved]])
            rights.append(ids[a:b][moved])
        if lefts:
            left, right = np.concatenate(lefts), np.concatenate(rights)
            pairs = np.unique(np.stack([np.minimum(left, right), np.maximum(left, right)], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, WORDS), np.uint64)]
    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        new = [*columns[:3], np.stack(columns[3:], axis=1).view(np.uint64)]
        held = [np.concatenate(x) for x in zip(held, new, strict=True)]
        shard = held[0]
        if len(shard) and shard[0] != shard[-1]:
            cut = int(np.searchsorted(shard, shard[-1]))
            yield from found(*[x[:cut] for x in held])
            held = [x[cut:] for x in held]
    if len(held[0]):
        yield from found(*held)


def candidates(prints: DataFrame, radius: int = RADIUS, short_radius: int = SHORT_RADIUS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Pairs (a, b) of ids that connect all whose fingerprints are near; ``prints`` has id, the words, short and prefix."""
    spark = prints.sparkSession
    placed = prints.select(F.explode("prefix").alias("shard"), "id", F.when(F.col("short"), short_radius).otherwise(radius).cast("long").alias("radius"), *PRINT)
    hot = settled(placed.groupBy("shard").count().where(F.col("count") > shard_rows).select("shard"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if hot.count():
        cold = placed.join(hot, "shard", "left_anti")
        split = placed.join(hot, "shard")
        vantage = settled(split.groupBy("shard").agg(F.min(F.struct("id", *PRINT)).alias("vantage")))
        far = sum((F.bit_count(F.col(w).bitwiseXOR(F.col(f"vantage.{w}"))) for w in PRINT), F.lit(0))
        split = split.join(vantage, "shard").withColumn("ring", F.floor(far / (max(radius, short_radius) + 1)))
        # a row belongs to its ring and comes to the next one if that has rows of its own
        own = settled(split.groupBy("shard", "ring").agg(F.count("*").alias("m")))
        before = own.select("shard", (F.col("ring") + 1).alias("ring"), F.col("m").alias("more"))
        rings = own.join(before, ["shard", "ring"], "left").select("shard", "ring", F.ceil((F.col("m") + F.coalesce("more", F.lit(0))) / shard_rows).cast("int").alias("salts"))
        split = split.withColumn("ring", F.explode(F.array("ring", F.col("ring") + 1))).join(settled(rings), ["shard", "ring"])
        split = split.withColumn("salt", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int")).withColumn("other", F.explode(F.expr("sequence(0, salts - 1)")))
        piece = F.xxhash64("shard", "ring", F.least("salt", "other"), F.greatest("salt", "other"))
        placed = cold.select("shard", "id", "radius", *PRINT).unionByName(split.select(piece.alias("shard"), "id", "radius", *PRINT))
    sorted_shards = placed.repartition(n, "shard").sortWithinPartitions("shard", "id")
    return sorted_shards.mapInArrow(_candidates, "a long, b long").distinct()


def _linked(sizes: np.ndarray, shingles: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Edges (row, row) that connect all pairs of sets of a piece that are similar enough.

    Each row is compared to all rows not yet reached; only reached pairs are never compared."""
    n, edge = len(sizes), np.concatenate([[0], np.cumsum(sizes)])
    token = np.unique(shingles, return_inverse=True)[1]
    owners = np.repeat(np.arange(n), sizes)[np.argsort(token, kind="stable")]
    first = np.concatenate([[0], np.cumsum(np.bincount(token))]).astype(np.int64)
    lefts, rights, unseen = [], [], np.ones(n, bool)
    for seed in range(n):
        if not unseen[seed]:
            continue
        unseen[seed], reached = False, [seed]
        while reached and unseen.any():
            r = reached.pop()
            t = token[edge[r] : edge[r + 1]]
            count = first[t + 1] - first[t]
            at = np.repeat(first[t] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum()) if len(t) else t
            same = np.bincount(owners[at], minlength=n)
            found = np.flatnonzero(unseen & (same > 0) & (same >= similarity * (sizes[r] + sizes - same)))
            unseen[found] = False
            lefts.append(np.full(len(found), r))
            rights.append(found)
            reached += found.tolist()
    none = [np.zeros(0, np.int64)]
    return np.concatenate(lefts or none), np.concatenate(rights or none)


@tidy
def _confirmed(batches, similarity: float):
    """Confirmed links within each piece of a partition sorted by piece; a piece may span batches."""

    def found(ids, sizes, shingles):
        left, right = (ids[x] for x in _linked(sizes, shingles, similarity))
        apart = left != right
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(left, right)[apart]), pa.array(np.maximum(left, right)[apart])], ["a", "b"])

    now, held = None, []
    for batch in batches:
        if not len(batch):
            continue
        piece, ids, lists = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False), batch.column(2)
        sizes, flat = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), lists.flatten().to_numpy(zero_copy_only=False)
        edge = np.concatenate([[0], np.cumsum(sizes)])
        border = np.concatenate([[0], np.flatnonzero(piece[1:] != piece[:-1]) + 1, [len(piece)]])
        for a, b in zip(border[:-1].tolist(), border[1:].tolist(), strict=True):
            if piece[a] != now and held:
                yield found(*map(np.concatenate, zip(*held, strict=True)))
                held = []
            now = piece[a]
            held.append((ids[a:b], sizes[a:b], flat[edge[a] : edge[b]]))
    if held:
        yield found(*map(np.concatenate, zip(*held, strict=True)))


def links(docs: DataFrame, clusters: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY, seed: int = SEED, piece_shingles: int = PIECE_SHINGLES) -> DataFrame:
    """Pairs (a, b) that connect all documents of a cluster (id, cluster) whose shingle sets are similar enough."""
    few = clusters.limit(MAX_BROADCAST_ROWS + 1).count() <= MAX_BROADCAST_ROWS
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string"))
    texts = texts.join(F.broadcast(clusters.select("id")), "id", "left_semi") if few else likely(texts, clusters.select("id"), "id").join(clusters.select("id"), "id", "left_semi")
    sets = settled(texts.mapInArrow(lambda it: _sets(it, width, seed), "id long, shingles array<long>").join(F.broadcast(clusters) if few else clusters, "id"))
    salts = F.ceil(F.sum(F.size("shingles")) / piece_shingles).cast("int")
    hot = settled(sets.groupBy("cluster").agg(salts.alias("salts")).where("salts > 1"))
    placed = sets
    if hot.count():
        split = sets.join(F.broadcast(hot), "cluster").withColumn("salt", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int"))
        split = split.withColumn("other", F.explode(F.expr("sequence(0, salts - 1)")))
        piece = F.xxhash64("cluster", F.least("salt", "other"), F.greatest("salt", "other"))
        placed = sets.join(F.broadcast(hot), "cluster", "left_anti").select("cluster", "id", "shingles").unionByName(split.select(piece.alias("cluster"), "id", "shingles"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = placed.select("cluster", "id", "shingles").repartition(n, "cluster").sortWithinPartitions("cluster")
    return pieces.mapInArrow(lambda it: _confirmed(it, similarity), "a long, b long")


def groups(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY, seed: int = SEED, shard_rows: int = SHARD_ROWS, piece_shingles: int = PIECE_SHINGLES) -> DataFrame:
    """doc_id and group_id (smallest doc_id reachable) of all documents that have a near copy of smaller id."""
    words = ", ".join(f"{w} long" for w in PRINT)
    light = small_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("doc_id is not null")
    frequent = frequent_shingles(light, width, seed)
    made = settled(light.mapInArrow(lambda it: _prints(it, width, seed, similarity, frequent), f"doc_id long, {words}, short boolean, prefix array<long>"))
    prints = made.select("doc_id", *PRINT)
    heads = settled(prints.groupBy(*PRINT).agg(F.min("doc_id").alias("id")))
    placed = made.withColumnRenamed("doc_id", "id").join(heads, ["id", *PRINT])
    pairs = settled(candidates(placed, shard_rows=shard_rows))
    roots = None
    if pairs.limit(1).count():
        clusters = components(pairs).select(F.col("node").alias("id"), F.col("root").alias("cluster"))
        clusters = settled(clusters.unionByName(clusters.select(F.col("cluster").alias("id"), "cluster")).distinct())
        roots = components(links(docs, clusters, width, similarity, seed, piece_shingles))
    named = prints.join(heads, PRINT).select("doc_id", "id")
    if roots is None:
        return named.where("doc_id <> id").select("doc_id", F.col("id").alias("group_id"))
    named = named.join(roots, named.id == roots.node, "left").select("doc_id", F.coalesce("root", "id").alias("group_id"))
    return named.where("doc_id <> group_id")


def keep_first(docs: DataFrame, **how) -> DataFrame:
    """One document of each group of near copies: that of the smallest doc_id."""
    return without(docs, groups(docs, **how))
