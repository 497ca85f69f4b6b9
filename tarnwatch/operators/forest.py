"""Random cut forest as tables: a bottom-k sample per tree, trees built in parallel, broadcast scoring.

* Sample: each (tree, point) has a deterministic uniform from its hash; a tree keeps the k
  smallest ``ln(-ln u) - arrival * decay``.  Every partition cuts its own rows to k per tree
  before the shuffle (trees x k rows a task at most), so the data itself never moves.
* Trees: one task per tree cuts its sample's bounding box recursively, dimensions weighted by range.
* Scoring: the forest, bounded by its parameters, is broadcast as arrays; rows stream past it in
  Arrow batches and descend all trees level by level.
"""

from __future__ import annotations

import json
import math
import tempfile
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

VERSION = 1
ROWS = 16_384
WAVES = 4
MAX_MODEL_BYTES = 1 << 30
TINY = 1e-300
SAMPLE_SCHEMA = "tree_id int, point_id long, sort_key double, ts long, features array<double>"
NODE_SCHEMA = "tree_id int, node_id int, left int, right int, cut_dim int, cut_value double, mn array<double>, mx array<double>, mass long, point_id long"


@dataclass(frozen=True)
class ForestParams:
    """Bounds as usual for such forests; ``time_decay`` defaults to 0.1 / sample_size."""

    dimension: int
    num_trees: int = 100
    sample_size: int = 256
    time_decay: float | None = None
    seed: int = 0
    initial_accept_fraction: float = 1.0
    feature_scales: tuple[float, ...] | None = None

    def __post_init__(self):
        if not 1 <= self.dimension <= 10_000:
            raise ValueError("dimension 1 to 10,000")
        if not 50 <= self.num_trees <= 1000:
            raise ValueError("50 to 1000 trees")
        if not 1 <= self.sample_size <= 2048:
            raise ValueError("sample size 1 to 2048")
        if self.time_decay is not None and not 0 <= self.time_decay <= 1:
            raise ValueError("time decay 0 to 1")
        if not 0 < self.initial_accept_fraction <= 1:
            raise ValueError("accept fraction above 0, up to 1")
        if self.feature_scales is not None and (len(self.feature_scales) != self.dimension or any(not 0 < s < math.inf for s in self.feature_scales)):
            raise ValueError("one finite positive scale per dimension")

    @property
    def decay(self) -> float:
        return 0.1 / self.sample_size if self.time_decay is None else self.time_decay


def hashed(ids: np.ndarray, salt: int) -> np.ndarray:
    """splitmix64 of id and salt, the high 53 bits as uniforms in (0, 1)."""
    h = ids.astype(np.int64).view(np.uint64) + np.uint64((salt + 1) * 0x9E3779B97F4A7C15 % 2**64)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53


def _cut(batches, p: ForestParams):
    """Each tree's bottom-k of a partition.  Once a tree has k rows, a hash alone tells that a row is beyond the k-th key."""
    held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros((0, p.dimension))]
    bound = np.full(p.num_trees, np.inf)
    for batch in batches:
        ids, seq, ts = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
        if not len(ids):
            continue
        x = batch.column(3).flatten().to_numpy(zero_copy_only=False).reshape(-1, p.dimension)
        # a key is ln(-ln u) - seq * decay, so no row of a smaller u can be below the bound; a hair of slack for rounding
        least = np.exp(-np.exp(bound + seq.max() * p.decay)) * (1 - 1e-9)
        trees, rows, keys = [], [], []
        for t in range(p.num_trees):
            u = hashed(ids, p.seed * 1009 + t)
            some = np.flatnonzero(u >= least[t])
            if p.initial_accept_fraction < 1 and len(some):
                gate = np.minimum(1.0, (seq[some] + 1) / max(1.0, p.initial_accept_fraction * p.sample_size))
                some = some[hashed(ids[some], p.seed * 1009 + t + 500_009) < gate]
            key = np.log(-np.log(u[some])) - seq[some] * p.decay
            if len(key) > p.sample_size:
                best = np.argpartition(key, p.sample_size - 1)[: p.sample_size]
                best = np.flatnonzero(key <= key[best].max())  # with ties
                some, key = some[best], key[best]
            trees.append(np.full(len(some), t))
            rows.append(some)
            keys.append(key)
        rows = np.concatenate(rows)
        if not len(rows):
            continue
        held = [np.concatenate(c) for c in zip(held, (np.concatenate(trees), ids[rows], np.concatenate(keys), ts[rows], x[rows]), strict=True)]
        order = np.lexsort((held[1], held[2], held[0]))
        tree = held[0][order]
        rank = np.arange(len(tree)) - np.searchsorted(tree, tree)
        held = [c[order[rank < p.sample_size]] for c in held]
        full = np.flatnonzero(np.bincount(held[0], minlength=p.num_trees) == p.sample_size)
        bound[full] = held[2][np.searchsorted(held[0], full, side="right") - 1]
    if len(held[0]):
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(held[0]) + 1, dtype=np.int32) * p.dimension), pa.array(held[4].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(held[0].astype(np.int32)), pa.array(held[1]), pa.array(held[2]), pa.array(held[3]), lists], ["tree_id", "point_id", "sort_key", "ts", "features"])


def spread(df: DataFrame) -> DataFrame:
    """Work over all trees costs far more than moving the points: some tasks a core, alike in rows, even if the input is one small file or a few uneven ones."""
    tasks = WAVES * df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(tasks) if not df.isStreaming and df.rdd.getNumPartitions() < tasks else df


def valid_rows(points: DataFrame, p: ForestParams) -> DataFrame:
    from ..functions import scaled, valid_point

    out = points.where(valid_point(F.col("features"), p.dimension))
    return out.withColumn("features", scaled(F.col("features"), list(p.feature_scales))) if p.feature_scales else out


def sample(points: DataFrame, p: ForestParams, before: DataFrame | None = None, counted: Observation | None = None) -> DataFrame:
    """Bottom-k rows per tree of the points (point_id, seq, features, optional ts), and of an earlier sample; ``counted`` gets the rows taken."""
    ts = F.col("ts").cast("long") if "ts" in points.columns else F.lit(None).cast("long")
    rows = valid_rows(points, p).select(F.col("point_id").cast("long"), F.col("seq").cast("double"), F.coalesce(ts, F.lit(-1)).alias("ts"), F.col("features").cast("array<double>"))
    if counted is not None:
        rows = rows.observe(counted, F.count(F.lit(1)).alias("rows"))
    kept = spread(rows).mapInArrow(lambda it: _cut(it, p), SAMPLE_SCHEMA)
    if before is not None:
        kept = kept.unionByName(before)
    w = Window.partitionBy("tree_id").orderBy("sort_key", "point_id")
    return kept.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= p.sample_size).drop("_k")


def build_tree(x: np.ndarray, ids: np.ndarray, rng: np.random.Generator) -> list[tuple]:
    """Nodes (node_id, left, right, cut_dim, cut_value, mn, mx, mass, point_id); duplicates share a leaf."""
    out: list = []
    stack = [(np.arange(len(x)), -1, 0)]
    while stack:
        rows, parent, side = stack.pop()
        number = len(out)
        if parent >= 0:
            out[parent][1 + side] = number
        low, high = x[rows].min(axis=0), x[rows].max(axis=0)
        span = high - low
        if span.sum() <= 0:
            out.append([number, -1, -1, -1, 0.0, low, high, len(rows), int(ids[rows[0]])])
            continue
        while True:
            at = rng.random() * span.sum()
            dim = int(np.searchsorted(np.cumsum(span), at, side="right"))
            dim = min(dim, len(span) - 1)
            value = low[dim] + rng.random() * span[dim]
            left = x[rows, dim] <= value
            if left.any() and not left.all():
                break
        out.append([number, -1, -1, dim, float(value), low, high, len(rows), -1])
        stack += [(rows[~left], number, 1), (rows[left], number, 0)]
    return [tuple(n) for n in out]


def build(samples: DataFrame, p: ForestParams) -> DataFrame:
    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["sort_key", "point_id"])
        tree = int(pdf["tree_id"].iloc[0])
        nodes = build_tree(np.stack(pdf["features"].to_list()).astype(float), pdf["point_id"].to_numpy(), np.random.default_rng([p.seed, tree]))
        return pd.DataFrame([(tree, *n[:5], n[5].tolist(), n[6].tolist(), *n[7:]) for n in nodes], columns=["tree_id", "node_id", "left", "right", "cut_dim", "cut_value", "mn", "mx", "mass", "point_id"])

    return samples.groupBy("tree_id").applyInPandas(one, NODE_SCHEMA)


class Arrays:
    """The forest as arrays over all nodes, children as absolute places, for whole-batch traversal.

    What depends on a node alone is worked out once: with p the probability of cutting a probe
    off the node's box, a node adds ``fixed + p * extra`` to its tree's score.  The fixed parts are
    summed along each path beforehand, as is the largest sibling ratio, so a walk only adds ``p * extra``.
    """

    def __init__(self, rows: list):
        rows = sorted(rows, key=lambda r: (r["tree_id"], r["node_id"]))
        tree = np.array([r["tree_id"] for r in rows])
        base = np.searchsorted(tree, tree)
        child = lambda c: np.array([r[c] for r in rows])
        left, right = (np.where(child(c) >= 0, child(c) + base, -1) for c in ("left", "right"))
        low, high = np.array([r["mn"] for r in rows], float), np.array([r["mx"] for r in rows], float)
        self._fill(base, left, right, np.maximum(child("cut_dim"), 0), np.array([r["cut_value"] for r in rows]), low, high, np.array([r["mass"] for r in rows], float))

    @classmethod
    def of(cls, *columns: np.ndarray) -> Arrays:
        """From columns, as :meth:`_fill` takes them."""
        out = cls.__new__(cls)
        out._fill(*columns)
        return out

    def _fill(self, base, left, right, dim, cut, low, high, mass) -> None:
        """``base``: the place of each node's root; children as places, -1 at leaves."""
        rows = base
        self.roots = np.unique(base)
        self.inner, self.cut, self.dim = left >= 0, cut, dim
        here = np.arange(len(rows))
        # twice a node's place, plus one to go left: what is looked up on the way down
        self.kids = 2 * np.stack([np.where(self.inner, right, here), np.where(self.inner, left, here)], axis=1).ravel()
        self.cuts, self.dims = np.repeat(cut, 2), np.repeat(dim, 2)
        self.up = np.full(len(rows) + 1, len(rows))  # above a root: a node that holds all
        self.up[left[self.inner]] = self.up[right[self.inner]] = here[self.inner]
        self.box, self.room = np.concatenate([high, -low], axis=1), np.maximum((high - low).sum(axis=1), TINY)
        whole = mass[base]
        self.scale = np.where(whole > 1, np.log2(np.maximum(whole, 2)), 1.0)
        depth, ratio, total, joined = np.zeros(len(rows)), np.zeros(len(rows)), np.zeros(len(rows)), np.zeros(len(rows))
        unseen = np.log2(mass)
        damp = np.where(whole > 1, 1 / (1 + np.log(mass) / np.log(np.maximum(whole, 2))), 1.0)
        self.fixed, self.extra = np.zeros(len(rows)), np.zeros(len(rows))
        level = self.roots
        while len(level):  # parents come before children
            d = depth[level] + unseen[level]
            seen = np.where(d > 0, 1 / np.where(d > 0, d, 1), 0.0)
            self.fixed[level] = seen * damp[level]
            self.extra[level] = np.where(self.inner[level], (d - seen) * damp[level], 0.0)
            total[level] += self.fixed[level]
            up = level[self.inner[level]]
            for mine, other in ((left[up], right[up]), (right[up], left[up])):
                depth[mine], total[mine] = depth[up] + 1, total[up]
                ratio[mine] = np.maximum(ratio[up], mass[other] / mass[mine])
                joined[mine] = np.maximum(joined[up], mass[other] / (mass[mine] + 1))
            level = np.concatenate([left[up], right[up]])
        self.fixed[~self.inner] = 0  # a leaf's part is in its path, and no direction has it
        self.path_fixed, self.path_ratio, self.path_joined, self.depth, self.mass = total, ratio, joined, depth, mass
        self.box, self.room = np.vstack([self.box, np.full((1, self.box.shape[1]), np.inf)]), np.append(self.room, 1.0)
        self.fixed, self.extra = np.append(self.fixed, 0.0), np.append(self.extra, 0.0)

    def leaves(self, x: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """The leaf below the node given beside each row, by the cuts alone."""
        flat, first, rows, out = np.ascontiguousarray(x).ravel(), np.arange(len(x)) * x.shape[1], None, None
        nodes, steps = 2 * nodes, 6
        while True:
            for _ in range(steps):  # a leaf leads to itself
                at = self.dims.take(nodes)
                at += first
                nodes += flat.take(at) <= self.cuts.take(nodes)
                nodes = self.kids.take(nodes)
            if out is None:
                out = nodes
            else:
                out[rows] = nodes
            going = np.flatnonzero(self.inner.take(nodes >> 1))
            if not len(going):
                return out >> 1
            rows, steps = going if rows is None else rows[going], 3
            nodes, first = nodes[going], first[going]

    def outside(self, both: np.ndarray, nodes: np.ndarray, directed: bool = False):
        """From the node beside each row (x, -x) upwards: rows, nodes, directions and extents of those that stand outside the node's box.

        Boxes lie within each other, so a row inside one is inside all above, and is left out from there on."""
        rows, mine, space, ones = np.arange(len(both)), both, np.empty(both.shape), np.ones(both.shape[1])
        while True:
            out = space[: len(rows)]
            np.take(self.box, nodes, axis=0, out=out, mode="clip")
            np.subtract(mine, out, out=out)
            np.maximum(out, 0, out=out)
            ext = out @ ones
            keep = np.flatnonzero(ext)
            if not len(keep):
                return
            if len(keep) < len(rows):
                rows, nodes, ext, out = rows[keep], nodes[keep], ext[keep], out.take(keep, axis=0) if directed else None
                mine = both.take(rows, axis=0)
            yield rows, nodes, out, ext
            nodes = self.up.take(nodes)

    def codisp(self, x: np.ndarray, seed: int = 0) -> np.ndarray:
        """Mean over trees of the largest sibling / subtree mass on the way to the inserted probe."""
        n, d = x.shape
        both, out = np.concatenate([x, -x], axis=1), np.zeros(n)
        bits = np.bitwise_xor.reduce(np.ascontiguousarray(x).view(np.int64) * (2 * np.arange(d) + 1), axis=1)
        for t, root in enumerate(self.roots.tolist()):
            leaf = self.leaves(x, np.full(n, root))
            best = self.path_joined.take(leaf)  # joins a leaf of its own value, unless a cut parts it before; of such cuts the highest is the last met
            for rows, nodes, _, ext in self.outside(both, leaf):
                room = self.room.take(nodes) + ext
                apart = np.flatnonzero(hashed(bits[rows] ^ (nodes - root), seed * 1009 + t) * room < ext)
                nodes = nodes[apart]
                best[rows[apart]] = np.maximum(self.path_joined.take(nodes), self.mass.take(nodes))
            out += best
        return out / len(self.roots)

    def walk(self, x: np.ndarray, each=None) -> tuple[np.ndarray, np.ndarray]:
        """Per-tree isolation scores and displacements (rows, trees).

        ``each(tree, contributions)`` gets every tree's directional contributions (rows, 2 D), high then low.
        """
        n = len(x)
        both = np.concatenate([x, -x], axis=1)
        score, disp = np.empty((len(self.roots), n)), np.empty((len(self.roots), n))
        for t, root in enumerate(self.roots.tolist()):
            score[t], disp[t], parts = self.descend(x, both, np.full(n, root), each is not None)
            if each:
                each(t, parts)
        score = np.ascontiguousarray(score.T)
        return clean(score), np.ascontiguousarray(disp.T)

    def descend(self, x: np.ndarray, both: np.ndarray, nodes: np.ndarray, directed: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        """Score and displacement of each row x (and x, -x) from the root given beside it, and its directional contributions.

        Most rows are inside most boxes on their way, where a node adds its fixed part only, so the leaf comes first and then the boxes that a row is outside of."""
        leaf, scale = self.leaves(x, nodes), self.scale.take(nodes)
        score, whole = self.path_fixed.take(leaf), np.zeros(both.shape) if directed else None
        for rows, at, out, ext in self.outside(both, self.up.take(leaf), directed):
            more = self.room.take(at)
            more += ext
            np.divide(ext, more, out=more)
            more *= self.extra.take(at)
            score[rows] += more
            if directed:
                more += self.fixed.take(at)
                more /= ext
                whole[rows] += out * more[:, None]
        return score / scale, self.path_ratio.take(leaf), whole / scale[:, None] if directed else None


def clean(score: np.ndarray) -> np.ndarray:
    return np.maximum(np.nan_to_num(score, nan=0.0, posinf=0.0, neginf=0.0), 0)


def early_stop(per_tree: np.ndarray, min_trees: int = 16, threshold: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    """Mean of the first trees up to where stderr / mean falls below the threshold, and how many they are."""
    n = np.arange(1, per_tree.shape[1] + 1)
    mean = np.cumsum(per_tree, axis=1) / n
    var = np.maximum(np.cumsum(per_tree**2, axis=1) - n * mean**2, 0) / np.maximum(n - 1, 1)
    done = (np.sqrt(var / n) < threshold * np.abs(mean)) & (n >= max(2, min_trees))
    stop = np.where(done.any(axis=1), done.argmax(axis=1), per_tree.shape[1] - 1)
    return mean[np.arange(len(mean)), stop], stop + 1


SCORES = "score double, stddev double, stderr double, trimmed double, early_score double, early_trees int, codisp double"


@dataclass
class ForestModel:
    """samples and nodes (DataFrames) and the parameters."""

    params: ForestParams
    samples: DataFrame
    nodes: DataFrame
    updates_seen: int = 0

    def arrays(self) -> Arrays:
        """At most num_trees x (2 x sample_size - 1) nodes with two boxes each; refused beyond ``MAX_MODEL_BYTES``."""
        size = self.params.num_trees * (2 * self.params.sample_size - 1) * (2 * self.params.dimension + 12) * 8
        if size > MAX_MODEL_BYTES and (size := self.nodes.count() * (2 * self.params.dimension + 12) * 8) > MAX_MODEL_BYTES:
            raise ValueError(f"a model of {size >> 20} MB is not broadcast; use fewer trees, samples or dimensions, or a forest per tenant")
        rows = self.nodes.collect()
        if not rows:
            raise ValueError("empty forest")
        return Arrays(rows)

    def _map(self, df: DataFrame, make, schema: str) -> DataFrame:
        from pyspark.sql import types as T

        held = df.sparkSession.sparkContext.broadcast(self.arrays())
        p = self.params
        fields = [*df.schema.fields, *T._parse_datatype_string(schema).fields]

        def run(batches):
            for batch in batches:
                if not batch.num_rows:
                    continue
                column = batch.column(batch.schema.get_field_index("features"))
                x = column.flatten().to_numpy(zero_copy_only=False)
                if column.null_count or len(x) != p.dimension * batch.num_rows or not np.isfinite(x).all():
                    raise ValueError("points of the forest's width and finite values only; filter with valid_point")
                x = x.reshape(batch.num_rows, -1).astype(float)
                if p.feature_scales:
                    x = x * np.array(p.feature_scales)
                parts = [make(held.value, x[k : k + ROWS]) for k in range(0, len(x), ROWS)]
                cols = []
                for c in zip(*parts, strict=True):
                    c = np.concatenate(c)
                    cols.append(pa.array(c) if c.ndim == 1 else pa.ListArray.from_arrays(pa.array(np.arange(len(c) + 1, dtype=np.int32) * c.shape[1]), pa.array(c.ravel())))
                yield pa.RecordBatch.from_arrays([*batch.columns, *cols], [f.name for f in fields])

        return spread(df).mapInArrow(run, T.StructType(fields))

    def score(self, df: DataFrame, trim: float = 0.1, min_trees: int = 16, threshold: float = 0.05) -> DataFrame:
        """Adds mean score, its spread over trees, trimmed mean, early-stopped mean, and codisp."""
        if not 0 <= trim < 0.5 or not 0 < threshold <= 1:
            raise ValueError("trim in [0, 0.5), threshold in (0, 1]")

        def make(a: Arrays, x: np.ndarray):
            s, disp = a.walk(x)
            n = s.shape[1]
            std = s.std(axis=1, ddof=1) if n > 1 else np.zeros(len(s))
            cut = int(n * trim)
            early, used = early_stop(s, min_trees, threshold)
            return s.mean(axis=1), std, std / math.sqrt(n), np.sort(s, axis=1)[:, cut : n - cut].mean(axis=1), early, used.astype(np.int32), disp.mean(axis=1)

        return self._map(df, make, SCORES)

    def mean(self, df: DataFrame) -> DataFrame:
        """Adds the mean score alone, as :meth:`score` has it."""
        return self._map(df, lambda a, x: (a.walk(x)[0].mean(axis=1),), "score double")

    def attribute(self, df: DataFrame) -> DataFrame:
        """Adds score, high and low per dimension, and their stability over trees (population deviation, confidence)."""

        def make(a: Arrays, x: np.ndarray):
            d, n = x.shape[1], len(a.roots)
            both, sums, squares = np.zeros((len(x), 2 * d)), np.zeros((len(x), d)), np.zeros((len(x), d))

            def each(_, parts: np.ndarray) -> None:
                whole = parts[:, :d] + parts[:, d:]
                np.add(both, parts, out=both)
                np.add(sums, whole, out=sums)
                np.add(squares, whole * whole, out=squares)

            s, _ = a.walk(x, each)
            mean = sums / n
            std = np.sqrt(np.maximum(squares / n - mean * mean, 0))
            cv = np.where(mean > 0, std / np.where(mean > 0, mean, 1), np.where(std > 0, np.inf, 0))
            return s.mean(axis=1), both[:, :d] / n, both[:, d:] / n, std, 1 / (1 + cv)

        return self._map(df, make, "score double, high array<double>, low array<double>, stddev_dim array<double>, confidence array<double>")

    def visit(self, df: DataFrame, visitor: Callable, schema: str) -> DataFrame:
        """Own traversals: ``visitor(arrays, x)`` returns one array per field of the schema."""
        return self._map(df, visitor, schema)

    def update(self, points: DataFrame) -> ForestModel:
        """New arrivals join the surviving sample, exactly as one bottom-k over both."""
        return fit(points, self.params, self.samples, self.updates_seen)

    def codisp(self, df: DataFrame) -> DataFrame:
        """Adds ``codisp``: displacement with the probe inserted, each row on its own; the model stays as it is.

        In every tree the probe goes in as an insertion would put it: at each node the box grows to hold
        it, and with the share of the growth a cut parts it from the rest there, else it follows the
        stored cut; the random choice is a hash of tree, node and point.  All masses above it count one more.
        """
        seed = self.params.seed
        return self._map(df, lambda a, x: (a.codisp(x, seed),), "codisp double")

    def settled(self) -> ForestModel:
        """The same version, read from the reliable checkpoint folder from now on."""
        checkpoint_folder(self.samples.sparkSession)
        samples = self.samples.checkpoint()
        self.release()
        return _settle(self.params, samples, self.updates_seen)

    def release(self) -> None:
        """Drops what is kept of this version."""
        self.samples.unpersist()
        self.nodes.unpersist()

    def delete(self, ids: DataFrame) -> ForestModel:
        """Without given point_ids; reservoirs shrink until later arrivals refill them."""
        return _settle(self.params, self.samples.join(ids.select("point_id"), "point_id", "left_anti").select(*self.samples.columns), self.updates_seen)

    def delete_by_value(self, values: list[float]) -> ForestModel:
        scales = self.params.feature_scales or [1.0] * self.params.dimension
        gone = F.array(*[F.lit(float(v) * s) for v, s in zip(values, scales, strict=True)])
        return _settle(self.params, self.samples.where(F.col("features") != gone), self.updates_seen)

    def delete_before(self, cutoff: int) -> ForestModel:
        """Drops points with a timestamp before the cutoff; those without one (-1) stay."""
        return _settle(self.params, self.samples.where((F.col("ts") < 0) | (F.col("ts") >= cutoff)), self.updates_seen)

    def depths(self) -> DataFrame:
        """Nodes, leaves and greatest depth of every tree."""
        a = self.arrays()
        tree = np.searchsorted(a.roots, np.arange(len(a.depth)), side="right") - 1
        rows = [(t, int((tree == t).sum()), int((~a.inner[tree == t]).sum()), int(a.depth[tree == t].max())) for t in range(len(a.roots))]
        return self.nodes.sparkSession.createDataFrame(rows, "tree int, nodes int, leaves int, depth int")

    def summary(self) -> DataFrame:
        """Trees, live distinct points, oldest and newest timestamps, and how many rows have one."""
        stamp = F.when(F.col("ts") >= 0, F.col("ts"))
        return self.samples.agg(F.countDistinct("tree_id").alias("trees"), F.countDistinct("point_id").alias("live_points"), F.min(stamp).alias("oldest"), F.max(stamp).alias("newest"), F.count(stamp).alias("tracked"))

    def save(self, path: str) -> None:
        """Writes a new version folder under a name of its own, then its pointer: a reader sees the old or the new model whole.

        Writers that run at once write different folders; the one whose pointer is of the larger (number, name) is current."""
        spark = self.samples.sparkSession
        number = (_current(spark, path) or (0, ""))[0] + 1
        name = f"{number}-{uuid.uuid4().hex[:12]}"
        self.samples.write.parquet(f"{path}/v={name}/samples")
        self.nodes.write.parquet(f"{path}/v={name}/nodes")
        meta = [(VERSION, json.dumps(asdict(self.params)), self.updates_seen)]
        spark.createDataFrame(meta, "version int, params string, updates_seen long").coalesce(1).write.parquet(f"{path}/v={name}/meta")
        spark.createDataFrame([(number, name)], "number int, name string").coalesce(1).write.mode("append").parquet(f"{path}/_pointer/p")

    def to_json(self) -> str:
        rows = [r.asDict() for r in self.samples.collect()]
        return json.dumps({"version": VERSION, "forest": {"params": asdict(self.params), "samples": rows, "updates_seen": self.updates_seen}})


def _current(spark: SparkSession, path: str) -> tuple[int, str] | None:
    from pyspark.errors import AnalysisException

    try:
        return tuple(spark.read.parquet(f"{path}/_pointer/p").agg(F.max(F.struct("number", "name"))).first()[0] or ()) or None
    except AnalysisException:
        return None


def load(spark: SparkSession, path: str) -> ForestModel:
    """The current version; its parameters are checked as new ones are, its samples and nodes against them."""
    current = _current(spark, path)
    if not current:
        raise FileNotFoundError(path)
    where = f"{path}/v={current[1]}"
    meta = spark.read.parquet(f"{where}/meta").first()
    if meta.version != VERSION:
        raise ValueError(f"model version {meta.version}, expected {VERSION}")
    p = _params(json.loads(meta.params))
    samples, nodes = spark.read.parquet(f"{where}/samples"), spark.read.parquet(f"{where}/nodes")
    _checked(samples, p)
    return ForestModel(p, samples, nodes, meta.updates_seen)


def _checked(samples: DataFrame, p: ForestParams) -> None:
    """Refuses samples that no forest of these parameters has."""
    bad = samples.where((F.size("features") != p.dimension) | ~F.col("tree_id").between(0, p.num_trees - 1) | F.exists("features", lambda v: F.isnan(v) | (F.abs(v) == float("inf"))))
    over = samples.groupBy("tree_id").count().where(F.col("count") > p.sample_size)
    if bad.limit(1).count() or over.limit(1).count():
        raise ValueError("samples do not fit the parameters")


def _params(raw: dict) -> ForestParams:
    return ForestParams(**{**raw, "feature_scales": tuple(raw["feature_scales"]) if raw["feature_scales"] else None})


def from_json(spark: SparkSession, text: str, max_bytes: int = 1 << 30) -> ForestModel:
    if len(text) > max_bytes:
        raise ValueError("over the size limit")
    raw = json.loads(text)
    if raw.get("version") != VERSION:
        raise ValueError("incompatible version")
    body = raw["forest"]
    rows = [(r["tree_id"], r["point_id"], r["sort_key"], r["ts"], r["features"]) for r in body["samples"]]
    p, samples = _params(body["params"]), spark.createDataFrame(rows, SAMPLE_SCHEMA)
    _checked(samples, p)
    return _settle(p, samples, body["updates_seen"])


def checkpoint_folder(spark: SparkSession) -> None:
    """Makes sure of a folder that all executors share; one of our own only where all runs in one process (tests)."""
    context = spark.sparkContext
    if spark.conf.get("spark.checkpoint.dir", None) or context._jsc.sc().getCheckpointDir().isDefined():
        return
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir is unset: executors need a folder that they share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="tarnwatch-"))


def _settle(p: ForestParams, samples: DataFrame, seen: int) -> ForestModel:
    samples = samples.persist()
    return ForestModel(p, samples, build(samples, p).persist(), seen)


def fit(points: DataFrame, p: ForestParams, before: DataFrame | None = None, seen: int = 0) -> ForestModel:
    """Fits points (point_id, seq, features[, ts]); rows that are not finite or of wrong width are skipped.

    ``updates_seen`` counts the rows taken, beside ``seen`` before."""
    taken = Observation()
    model = _settle(p, sample(points, p, before, taken), seen)
    model.samples.count()
    model.updates_seen += taken.get["rows"] or 0
    return model


def bootstrap_report(points: DataFrame, p: ForestParams) -> DataFrame:
    """Rows taken and skipped by a bulk load."""
    from ..functions import valid_point

    ok = valid_point(F.col("features"), p.dimension)
    return points.agg(F.count_if(ok).alias("ingested"), F.count_if(~ok).alias("skipped"))
