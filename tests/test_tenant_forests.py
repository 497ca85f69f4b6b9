"""One forest per tenant."""

import numpy as np

from tarnwatch.operators import forest, tenant_forests
from tarnwatch.operators.steps import Threshold

SCHEMA = "tenant string, point_id long, seq long, features array<double>"


def _rows(rng, tenant, centre, n, start):
    return [(tenant, start + k, k, [float(v) for v in rng.normal(centre, 0.1, 2)]) for k in range(n)]


def test_each_tenant_has_its_own_forest(spark):
    rng = np.random.default_rng(1)
    rows = _rows(rng, "a", 0.0, 900, 0) + _rows(rng, "b", 8.0, 200, 1000) + _rows(rng, "c", 4.0, 1, 2000)
    p = forest.ForestParams(2, num_trees=50, sample_size=64, seed=3)
    odd = [("a", 5000, 5000, [float("nan"), 1.0]), (None, 5001, 5001, [0.0, 0.0]), ("a", 5002, 5002, [1.0])]
    pool = tenant_forests.fit(spark.createDataFrame(rows + odd, SCHEMA), p, rows_per_task=250)
    sizes = {r.tenant: r.sampled for r in pool.models.collect()}
    assert set(sizes) == {"a", "b", "c"} and sizes["c"] == 1 and 64 <= sizes["b"] <= 200
    probes = [("a", 1, 0, [0.0, 0.0]), ("a", 2, 0, [8.0, 8.0]), ("b", 3, 0, [8.0, 8.0]), ("b", 4, 0, [0.0, 0.0]), ("new", 5, 0, [0.0, 0.0]), *odd]
    got = {r.point_id: r for r in pool.score(spark.createDataFrame(probes, SCHEMA)).collect()}
    assert len(got) == len(probes)
    assert got[2].score > 2 * got[1].score and got[4].score > 2 * got[3].score and got[2].codisp > got[1].codisp
    assert all(got[k].score is None for k in (5, 5000, 5001, 5002))
    assert [r.point_id for r in pool.most_anomalous(spark.createDataFrame(probes, SCHEMA).where("tenant = 'a'"), 1).collect()] == [2]


def test_a_tenant_equals_a_forest_of_its_own(spark):
    rows = _rows(np.random.default_rng(2), "t", 1.0, 500, 0)
    p = forest.ForestParams(2, num_trees=50, sample_size=32, seed=5, time_decay=0.0)
    points = spark.createDataFrame(rows, SCHEMA)
    mine = {r.point_id: r.score for r in tenant_forests.fit(points, p, rows_per_task=130).score(points).collect()}
    alone = {r.point_id: r.score for r in forest.fit(points.drop("tenant"), p).score(points).collect()}
    assert mine.keys() == alone.keys() and np.allclose([mine[k] for k in alone], list(alone.values()))


def test_empty(spark):
    points = spark.createDataFrame([], SCHEMA)
    pool = tenant_forests.fit(points, forest.ForestParams(2))
    assert pool.models.count() == 0 and pool.score(points).count() == 0


def test_pool_learns_grades_and_evicts(spark):
    rng = np.random.default_rng(4)
    p = forest.ForestParams(2, num_trees=50, sample_size=32, seed=5, time_decay=0.0)
    first = spark.createDataFrame(_rows(rng, "a", 0.0, 200, 0) + _rows(rng, "b", 5.0, 200, 1000), SCHEMA)
    later = spark.createDataFrame([(t, i, s + 500, f) for t, i, s, f in _rows(rng, "b", 5.0, 100, 3000) + _rows(rng, "c", 1.0, 40, 4000)] + [("b", 9000, 900, [0.0, 0.0])], SCHEMA)
    pool = tenant_forests.fit(first, p)
    graded, learned = pool.process(first, lambda: Threshold(min_threshold=0.1))
    assert graded.count() == 400 and graded.where("ready").count() > 300
    more, learned = learned.process(later, lambda: Threshold(min_threshold=0.1))
    got = {r.point_id: r for r in more.collect()}
    assert len(got) == 141 and got[9000].is_anomaly and got[4000].score is None and got[3050].ready
    assert {r.tenant: r.n for r in learned.stats(lambda: Threshold(min_threshold=0.1)).collect()} == {"a": 199, "b": 300}
    # a pool that learns in parts equals one that learns at once
    whole = tenant_forests.fit(first.unionByName(later), p)
    probe = spark.createDataFrame([("a", 1, 0, [5.0, 5.0]), ("b", 2, 0, [0.0, 0.0]), ("c", 3, 0, [9.0, 9.0])], SCHEMA)
    scores = lambda x: {r.point_id: round(r.score, 9) for r in x.score(probe).collect() if r.score is not None}
    assert scores(pool.update(later)) == scores(whole) and len(scores(whole)) == 3
    # ``learned`` has taken the first points twice, as it was told to
    assert scores(learned) == scores(tenant_forests.fit(first.unionByName(first).unionByName(later), p))
    far = {r.point_id: r for r in learned.attribution(probe).collect()}
    assert sum(far[1].high) > 5 * sum(far[1].low) and sum(far[2].low) > 5 * sum(far[2].high)
    assert {r.tenant for r in learned.evict_lru(1).models.collect()} == {"b"}
    idle = learned.evict_idle(now=900, ttl=400)
    assert {r.tenant for r in idle.models.collect()} == {"b", "c"} and 1 not in scores(idle) and idle.stats().count() == 1
    assert learned.remove(probe.where("tenant = 'b'")).models.count() == 2 and learned.get("a").count() == 1


def test_trees_grown_at_once_equal_those_grown_alone():
    """Points that repeat, and points so near that rounding lets a cut part nothing."""
    rng = np.random.default_rng(6)
    p = forest.ForestParams(2, num_trees=50, sample_size=32, seed=7)
    near = np.array([[1.0, 1.0], [np.nextafter(1.0, 2), 1.0], [1.0, np.nextafter(1.0, 2)]])
    samples, rows, x = [], [], []
    for k, points in enumerate((rng.normal(0, 1, (20, 2)), np.round(rng.normal(0, 1, (90, 2))), near, np.ones((5, 2)), rng.normal(3, 1, (200, 2)))):
        ids = np.arange(len(points)) + 1000 * k
        samples.append((ids, ids.astype(float), points))
        x += [points + 0.1, points]
        rows.append(np.arange(2 * len(points)) + sum(map(len, x[:-2])))
    x = np.concatenate(x)
    _, _, bad = tenant_forests._grown(samples, p)
    assert bad.tolist() == [False, False, True, False, False]
    for part in tenant_forests._scored(list(zip(samples, rows, strict=True)), x, p, True):
        for i, score, far, parts in zip(*part, strict=True):
            one = tenant_forests._alone(samples[next(k for k, r in enumerate(rows) if i in r)], p)
            both = np.zeros((1, 4))
            s, d = one.walk(x[i : i + 1], lambda _, c, both=both: np.add(both, c, out=both))
            assert (s.mean(), d.mean()) == (score, far) and np.allclose(both[0] / p.num_trees, parts, rtol=1e-12)


def test_models_are_samples(spark):
    """As arrays, a tenant's 50 trees took about a megabyte of memory and shuffle; the points behind them take some kilobytes."""
    rng = np.random.default_rng(8)
    p = forest.ForestParams(2, num_trees=50, sample_size=64, seed=3)
    points = spark.createDataFrame([r for k in range(20) for r in _rows(rng, f"t{k}", k, 70, 100 * k)], SCHEMA)
    pool = tenant_forests.fit(points, p)
    size = lambda df: sum(len(str(r)) for r in df.collect())
    assert size(pool.models) + size(pool.samples) < 20 * 20_000
    assert pool.score(points).where("score is not null").count() == 1400
