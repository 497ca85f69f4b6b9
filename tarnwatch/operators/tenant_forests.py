"""One random cut forest per tenant, without gathering a tenant's rows anywhere.

* Sample: rows are dealt by (tenant, salt), with a salt for every ``rows_per_task`` rows of a
  tenant; each group streams its rows past a bottom-k per tree and yields those in some sample.
* Model: a tenant's forest is its sample.  Trees are cut where they are used, all trees of many tenants at
  once, and forgotten: as arrays they would be some ten thousand times a point.
* Score: samples and points are dealt alike by (tenant, salt) and sorted, the sample first; a task
  holds one batch of rows, their trees and the last tenant's sample.

Defined cases: points that are not finite, of wrong width or without a tenant are skipped in a
fit and have no score; a tenant without a model has null scores; an empty table gives no models.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.fold import fold, states
from .detectors import standing
from .forest import Arrays, ForestParams, build_tree, clean, hashed, valid_rows
from .steps import Threshold
from .tenants import evict_idle, evict_lru


ROWS_PER_TASK = 1_000_000
SAMPLE_COLUMNS = "tenant string, point_id long, seq double, features array<double>"


def _salted(rows: DataFrame, rows_per_task: int) -> tuple[DataFrame, DataFrame]:
    """Rows with a salt, and (tenant, salts) of the tenants that have more than one; those are at most rows / rows_per_task."""
    hot = rows.groupBy("tenant").count().where(F.col("count") > rows_per_task).select("tenant", F.ceil(F.col("count") / rows_per_task).cast("int").alias("salts")).persist()
    salt = F.pmod(F.xxhash64("point_id"), F.coalesce("salts", F.lit(1))).cast("int")
    return rows.join(hot, "tenant", "left").withColumn("salt", salt).drop("salts"), hot


def _groups(pdf: pd.DataFrame) -> list[tuple[int, int, tuple]]:
    """Begin, end and (tenant, salt) of each run of rows."""
    tenant, salt = pdf["tenant"].to_list(), pdf["salt"].to_numpy()
    code = pd.factorize(pdf["tenant"])[0]
    cuts = [0, *(np.flatnonzero((code[1:] != code[:-1]) | (salt[1:] != salt[:-1])) + 1).tolist(), len(pdf)]
    return [(a, b, (tenant[a], int(salt[a]))) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _keys(ids: np.ndarray, seq: np.ndarray, p: ForestParams) -> np.ndarray:
    return np.stack([np.log(-np.log(hashed(ids, p.seed * 1009 + t))) - seq * p.decay for t in range(p.num_trees)])


def _chosen(ids: np.ndarray, key: np.ndarray, p: ForestParams) -> np.ndarray:
    """Each tree's bottom-k (trees, k) of one tenant's points, smallest key first, ties by id."""
    by_id = np.argsort(ids, kind="stable")
    return by_id[np.argsort(key[:, by_id], axis=1, kind="stable")[:, : p.sample_size]]


def _cut(pdfs: Iterator[pd.DataFrame], p: ForestParams) -> Iterator[pd.DataFrame]:
    """Each point that is in some tree's sample, once."""
    held, owner = None, None
    for pdf in pdfs:
        if not len(pdf):
            continue
        if held is not None:
            pdf = pd.concat([held, pdf], ignore_index=True)
        groups, keep = _groups(pdf), np.ones(len(pdf), bool)
        ids, seq = pdf["point_id"].to_numpy(np.int64), pdf["seq"].to_numpy(float)
        for a, b, owner in groups:
            if b - a > p.sample_size:
                keep[a:b] = False
                keep[a + np.unique(_chosen(ids[a:b], _keys(ids[a:b], seq[a:b], p), p))] = True
        last = groups[-1][0]  # may go on
        held = pdf.iloc[last:][keep[last:]]
        yield pdf.iloc[:last].loc[keep[:last], ["tenant", "point_id", "seq", "features"]]
    if held is not None:
        yield held[["tenant", "point_id", "seq", "features"]]


SLOTS = 1 << 18
PAIRS = 1 << 16


def _grown(samples: list[tuple], p: ForestParams) -> tuple[Arrays, np.ndarray, np.ndarray]:
    """All trees of some tenants' samples (ids, seq, x) at once, level by level; each tenant's roots; and the tenants that need :func:`_alone`.

    A tree's random numbers go to its nodes in preorder, two a cut, as :func:`.forest.build_tree` takes them: a node's
    right child comes after all cuts of its left one, which are as many as its points differ, less one.
    Where rounding lets a cut part nothing, more numbers are taken, and the count does not hold."""
    trees, d = p.num_trees, p.dimension
    sizes = np.array([len(s[0]) for s in samples])
    ids, seq, x = (np.concatenate([s[k] for s in samples]) for k in range(3))
    owner, begin = np.repeat(np.arange(len(samples)), sizes), np.cumsum(sizes) - sizes
    # equal points of a tenant are one, with a weight
    order = np.lexsort((*x.T[::-1], owner))
    new = np.ones(len(x), bool)
    new[1:] = (owner[order[1:]] != owner[order[:-1]]) | (x[order[1:]] != x[order[:-1]]).any(axis=1)
    kind = np.empty(len(x), np.int64)
    kind[order] = np.cumsum(new) - 1
    x = x[order[new]]
    key = _keys(ids, seq, p)
    chosen = [a + (_chosen(ids[a : a + n], key[:, a : a + n], p) if n > p.sample_size else np.broadcast_to(np.arange(n), (trees, n))) for a, n in zip(begin.tolist(), sizes.tolist(), strict=True)]
    tree = np.concatenate([np.repeat(np.arange(k * trees, (k + 1) * trees), c.shape[1]) for k, c in enumerate(chosen)])
    slot, mass = np.unique(tree * len(x) + kind[np.concatenate([c.ravel() for c in chosen])], return_counts=True)
    tree, x = slot // len(x), x[slot % len(x)]
    most = 2 * min(p.sample_size, int(sizes.max()))
    random = np.stack([np.random.default_rng([p.seed, t]).random(most) for t in range(trees)])
    start = np.flatnonzero(np.r_[True, tree[1:] != tree[:-1]])
    size, at = np.diff(np.r_[start, len(x)]), np.zeros(len(start), np.int64)
    root = np.arange(len(start))  # every tenant has points, so a tree's number is its root's place
    levels, bad, count = [], np.zeros(len(samples), bool), 0
    while len(start):
        n = len(start)
        low, high, weight = np.minimum.reduceat(x, start), np.maximum.reduceat(x, start), np.add.reduceat(mass, start)
        span, inner = high - low, size > 1
        t = root % trees
        u, v = random[t, np.minimum(at, most - 1)], random[t, np.minimum(at + 1, most - 1)]
        dim = np.minimum((np.cumsum(span, axis=1) <= (u * span.sum(axis=1))[:, None]).sum(axis=1), d - 1)
        every = np.arange(n)
        value = low[every, dim] + v * span[every, dim]
        of = np.repeat(every, size)
        left = x[np.arange(len(x)), dim[of]] <= value[of]
        lefts = np.add.reduceat(left.astype(np.int64), start)
        odd = inner & ((lefts == 0) | (lefts == size))
        bad[root[odd] // trees] = True
        inner &= ~odd
        kids = count + n + 2 * (np.cumsum(inner) - 1)
        levels.append((root, np.where(inner, kids, -1), np.where(inner, kids + 1, -1), np.where(inner, dim, 0), np.where(inner, value, 0.0), low, high, weight.astype(float)))
        count += n
        going = inner[of]
        x, mass = x[going], mass[going]
        order = np.argsort(2 * of[going] + ~left[going], kind="stable")
        x, mass = x[order], mass[order]
        both = np.stack([lefts[inner], (size - lefts)[inner]], axis=1)
        at = np.stack([at[inner] + 2, at[inner] + 2 * lefts[inner]], axis=1).ravel()
        root, size = np.repeat(root[inner], 2), both.ravel()
        start = np.cumsum(size) - size
    return Arrays.of(*(np.concatenate(c) for c in zip(*levels, strict=True))), np.arange(len(samples) * trees).reshape(-1, trees), bad


def _alone(sample: tuple, p: ForestParams) -> Arrays:
    """The trees of one tenant, one after the other."""
    ids, seq, x = sample
    nodes, names = [], ("node_id", "left", "right", "cut_dim", "cut_value", "mn", "mx", "mass", "point_id")
    for tree, best in enumerate(_chosen(ids, _keys(ids, seq, p), p)):
        nodes += [{"tree_id": tree, **dict(zip(names, n, strict=True))} for n in build_tree(x[best], ids[best], np.random.default_rng([p.seed, tree]))]
    return Arrays(nodes)


def _scored(groups: list[tuple[tuple, np.ndarray]], x: np.ndarray, p: ForestParams, attribute: bool) -> Iterator[tuple]:
    """Rows, scores, displacements and directional parts of the points of each group (sample, rows of x)."""
    model, roots, bad = _grown([g[0] for g in groups], p)
    jobs = [(model, np.concatenate([rows for (_, rows), b in zip(groups, bad, strict=True) if not b] or [np.zeros(0, np.int64)]), np.repeat(roots[~bad], [len(rows) for (_, rows), b in zip(groups, bad, strict=True) if not b], axis=0))]
    for (sample, rows), b in zip(groups, bad, strict=True):
        if b:
            one = _alone(sample, p)
            jobs.append((one, rows, np.broadcast_to(one.roots, (len(rows), p.num_trees))))
    step = max(1, PAIRS // p.num_trees)
    for model, rows, roots in jobs:
        for k in range(0, len(rows), step):
            some, at = rows[k : k + step], roots[k : k + step]
            each = np.repeat(x[some], p.num_trees, axis=0)
            score, disp, parts = model.descend(each, np.concatenate([each, -each], axis=1), np.ascontiguousarray(at).ravel(), attribute)
            yield some, clean(score.reshape(at.shape)).mean(axis=1), disp.reshape(at.shape).mean(axis=1), parts.reshape(*at.shape, -1).sum(axis=1) / p.num_trees if attribute else None


def _walk(pdfs: Iterator[pd.DataFrame], p: ForestParams, attribute: bool) -> Iterator[pd.DataFrame]:
    d, held = p.dimension, (None, ())
    for pdf in pdfs:
        n = len(pdf)
        if not n:
            continue
        head, good, features = pdf["head"].to_numpy(bool), pdf["good"].to_numpy(bool), pdf["features"].to_list()
        ids, seq, x = pdf["point_id"].to_numpy(np.int64), pdf["seq"].to_numpy(float), np.zeros((n, d))
        if (some := np.flatnonzero(head | good)).size:
            x[some] = np.stack([features[i] for i in some])
        score, disp, parts = np.full(n, np.nan), np.full(n, np.nan), np.zeros((n, 2 * d)) if attribute else None

        def put(groups: list, x=x, score=score, disp=disp, parts=parts) -> None:
            for rows, s, far, each in _scored(groups, x, p, attribute) if groups else ():
                score[rows], disp[rows] = s, far
                if attribute:
                    parts[rows] = each

        waiting, slots = [], 0
        for a, b, place in _groups(pdf):
            m = a + int(head[a:b].sum())  # a sample comes before its points
            sample = (ids[a:m], seq[a:m], x[a:m])
            if place == held[0]:
                sample = tuple(map(np.concatenate, zip(held[1], sample, strict=True)))
            held = (place, sample)
            rows = m + np.flatnonzero(good[m:b])
            if len(rows) and len(sample[0]):
                waiting.append((sample, rows))
                slots += p.num_trees * min(p.sample_size, len(sample[0])) * d
                if slots > SLOTS:
                    put(waiting)
                    waiting, slots = [], 0
        put(waiting)
        known = ~np.isnan(score)
        out = pdf.loc[~head, ["tenant", "point_id", "seq"]].assign(score=pd.Series(score).astype(object).where(pd.Series(known), None)[~head].to_numpy())
        if attribute:
            out["high"] = [parts[i, :d] if known[i] else None for i in np.flatnonzero(~head)]
            out["low"] = [parts[i, d:] if known[i] else None for i in np.flatnonzero(~head)]
        else:
            out["codisp"] = pd.Series(disp).astype(object).where(pd.Series(known), None)[~head].to_numpy()
        yield out


@dataclass
class TenantForests:
    """models: tenant, sampled (distinct points in its sample) and last_seq; samples: the points that make the models.

    ``states`` has what the tenants' thresholds have seen (:meth:`process`).
    """

    params: ForestParams
    models: DataFrame
    samples: DataFrame
    rows_per_task: int = ROWS_PER_TASK
    states: DataFrame | None = None

    def _run(self, points: DataFrame, attribute: bool) -> DataFrame:
        from ..functions import scaled, valid_point

        p = self.params
        features = scaled(F.col("features"), list(p.feature_scales)) if p.feature_scales else F.col("features")
        seq = (F.col("seq") if "seq" in points.columns else F.lit(None)).cast("double").alias("seq")
        rows, hot = _salted(points.select(F.col("tenant").cast("string"), F.col("point_id").cast("long"), seq, features.cast("array<double>").alias("features"), F.coalesce(valid_point(F.col("features"), p.dimension), F.lit(False)).alias("good")), self.rows_per_task)
        rows = rows.withColumn("head", F.lit(False))
        salts = F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).alias("salt")
        heads = self.samples.join(hot, "tenant", "left").select("tenant", "point_id", "seq", "features", F.lit(False).alias("good"), salts, F.lit(True).alias("head"))
        dealt = rows.unionByName(heads).repartition("tenant", "salt").sortWithinPartitions("tenant", "salt", F.desc("head"))
        more = "high array<double>, low array<double>" if attribute else "codisp double"
        return dealt.mapInPandas(lambda it: _walk(it, p, attribute), f"tenant string, point_id long, seq double, score double, {more}")

    def score(self, points: DataFrame) -> DataFrame:
        """tenant, point_id, score and codisp of the points (tenant, point_id, features)."""
        return self._run(points, False).drop("seq")

    def attribution(self, points: DataFrame) -> DataFrame:
        """tenant, point_id, score, and high and low per dimension."""
        return self._run(points, True).drop("seq")

    def process(self, points: DataFrame, make: Callable[[], Threshold] = Threshold) -> tuple[DataFrame, TenantForests]:
        """Scores under each tenant's present forest, graded against the tenant's earlier scores; and the pool that has learned the points.

        Tenants without a forest get one, and their rows have null scores this once."""
        scored = self._run(points, False).persist()  # read by the grades, the rows without one, and the states
        known = scored.where("score is not null")
        grades = fold(known, ["tenant"], ["seq", "point_id"], ["point_id", "score"], make, self.states, value="score")
        after = states(known, ["tenant"], ["seq", "point_id"], make, self.states, value="score")
        if self.states is not None:
            after = after.unionByName(self.states.join(after.select("tenant"), "tenant", "left_anti"))
        fresh = scored.where("score is null").select("tenant", "point_id", "score")
        return grades.unionByName(fresh, allowMissingColumns=True), replace(self.update(points), states=after)

    def stats(self, make: Callable[[], Threshold] = Threshold) -> DataFrame:
        """Every tenant's observations, mean, variance and threshold, as :mod:`.tenants` takes them."""
        return standing(self.states, ["tenant"], make)

    def update(self, points: DataFrame) -> TenantForests:
        """New points join their tenants' samples; only those tenants' models are built again."""
        new = fit(points, self.params, self.rows_per_task, self.samples)
        rest = self.models.join(new.models.select("tenant"), "tenant", "left_anti")
        others = self.samples.join(new.models.select("tenant"), "tenant", "left_anti")
        return replace(self, models=rest.unionByName(new.models), samples=new.samples.unionByName(others))

    def _only(self, tenants: DataFrame, how: str) -> TenantForests:
        names = tenants.select(F.col("tenant").cast("string"))
        cut = lambda df: None if df is None else df.join(names, "tenant", how)
        return replace(self, models=cut(self.models), samples=cut(self.samples), states=cut(self.states))

    def get(self, tenant: str) -> DataFrame:
        return self.models.where(F.col("tenant") == tenant)

    def remove(self, tenants: DataFrame) -> TenantForests:
        return self._only(tenants, "left_anti")

    def evict_lru(self, capacity: int) -> TenantForests:
        """The pool of the ``capacity`` tenants that learned last; models, samples and thresholds of the others go."""
        return self._only(evict_lru(self.models.select("tenant", "last_seq"), "tenant", "last_seq", capacity), "left_semi")

    def evict_idle(self, now: float, ttl: float) -> TenantForests:
        return self._only(evict_idle(self.models.select("tenant", "last_seq"), "last_seq", now, ttl), "left_semi")

    def most_anomalous(self, points: DataFrame, n: int) -> DataFrame:
        """Top n points over all tenants."""
        return self.score(points).orderBy(F.desc("score"), "tenant", "point_id").limit(n)


def fit(points: DataFrame, p: ForestParams, rows_per_task: int = ROWS_PER_TASK, before: DataFrame | None = None) -> TenantForests:
    """A forest for each tenant of the points (tenant, point_id, seq, features), with the samples that the tenants had ``before``."""
    rows = valid_rows(points.where("tenant is not null"), p).select(F.col("tenant").cast("string"), F.col("point_id").cast("long"), F.col("seq").cast("double"), F.col("features").cast("array<double>"))

    dealt = _salted(rows, rows_per_task)[0].repartition("tenant", "salt").sortWithinPartitions("tenant", "salt")
    kept = dealt.mapInPandas(lambda it: _cut(it, p), SAMPLE_COLUMNS)
    if before is not None:
        kept = kept.unionByName(before.join(rows.select("tenant").distinct(), "tenant", "left_semi"))
    kept = kept.persist()
    return TenantForests(p, kept.groupBy("tenant").agg(F.countDistinct("point_id").alias("sampled"), F.max("seq").alias("last_seq")), kept, rows_per_task)
