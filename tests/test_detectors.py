"""Detectors against plain loops, invariants, and batch against stream."""

import json
import math

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tarnwatch import functions as fn
from tarnwatch import sources, streaming
from tarnwatch.operators import aggregates as ag
from tarnwatch.operators import forest, grouped, steps, tenants, triage
from tarnwatch.operators import sequences as sq
from tarnwatch.plans import queries as registered
from tarnwatch.plans.fold import fold

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def series(spark):
    rng = np.random.default_rng(1)
    rows = [(k, i, float(v)) for k in range(3) for i, v in enumerate(np.concatenate([rng.normal(0, 1, 120), rng.normal(6, 1, 60)]))]
    return spark.createDataFrame(rows, "key long, i long, value double").repartition(4)


def by_key(df, *cols):
    out = {}
    for r in df.orderBy("key", "i").collect():
        out.setdefault(r.key, []).append(tuple(r[c] for c in cols) if len(cols) > 1 else r[cols[0]])
    return out


def test_cusum_equals_loop(series):
    values = by_key(series, "value")
    got = by_key(sq.cusum(series, ["key"], ["i"], "value"), "s_pos", "s_neg", "alert", "duration")
    for k, vs in values.items():
        up = down = run = 0.0
        for v, (a, b, alert, duration) in zip(vs, got[k], strict=True):
            first = v is vs[0]
            up, down = (0.0, 0.0) if first else (max(0, up + v - vs[0] - 0.5), max(0, down - (v - vs[0] + 0.5)))
            run = run + 1 if up > 5 or down > 5 else 0
            assert abs(a - up) < 1e-9 and abs(b - down) < 1e-9 and alert == (run > 0) and duration == run
    assert sq.active_drifts(sq.cusum(series, ["key"], ["i"], "value"), ["key"], ["i"]).where("active").count() == 3


@pytest.mark.parametrize("make", [steps.Ema, lambda: steps.Ewma(warmup=10), steps.MetaDrift, steps.Threshold, lambda: steps.Threshold(mode="quantile"), steps.Adwin, lambda: steps.Spot(calibrate=30), lambda: steps.Percentile()])
def test_fold_equals_loop(series, make):
    values = by_key(series, "value")
    names = [n for n, _ in make().fields]
    got = by_key(fold(series, ["key"], ["i"], ["i"], make), *names)
    for k, vs in values.items():
        step = make()
        want = [step.update(v) for v in vs]
        want = want if len(names) > 1 else [w[0] for w in want]
        clean = lambda x: None if x is None or isinstance(x, float) and math.isnan(x) else x
        flat = lambda rows: [tuple(map(clean, r)) if isinstance(r, tuple) else clean(r) for r in rows]
        assert flat(got[k]) == flat(want)


def test_drift_detectors_fire(series):
    assert fold(series, ["key"], ["i"], ["i"], steps.Adwin).groupBy("key").agg(F.max("fires").alias("f")).where("f > 0").count() == 3
    assert fold(series, ["key"], ["i"], ["i"], steps.MetaDrift).where("drift = 'Upward'").select("key").distinct().count() == 3
    assert fold(series.where("i < 120"), ["key"], ["i"], ["i"], steps.Adwin).where("drift").count() == 0


def test_stream_equals_batch(spark, series, tmp_path):
    src = f"{tmp_path}/in"
    for part in range(3):
        series.where(f"i div 60 = {part}").coalesce(1).write.mode("append").parquet(src)
    want = by_key(fold(series, ["key"], ["i"], ["i"], steps.Threshold), "threshold", "grade", "is_anomaly")
    files = sorted(__import__("pathlib").Path(src).glob("*.parquet"), key=lambda p: pd.read_parquet(p)["i"].min())
    for n, p in enumerate(files):
        __import__("os").utime(p, (10**9 + n, 10**9 + n))
    stream = spark.readStream.schema(series.schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = streaming.stream_fold(stream, ["key"], ["i"], ["i"], steps.Threshold).writeStream.format("memory").queryName("graded").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert by_key(spark.table("graded"), "threshold", "grade", "is_anomaly") == want


def test_matrix_profile(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([np.sin(np.arange(80) / 4), [5, -5, 5, -5], np.sin(np.arange(80) / 4)]) + rng.normal(0, 0.01, 164)
    d, j = grouped.profile(x, 8)
    subs = np.array([x[i : i + 8] for i in range(len(x) - 7)])
    z = (subs - subs.mean(axis=1, keepdims=True)) / subs.std(axis=1, keepdims=True)
    full = np.sqrt(((z[:, None] - z[None]) ** 2).sum(axis=2))
    i = np.arange(len(z))
    full[np.abs(i[:, None] - i[None]) < 2] = np.inf
    assert np.allclose(d, full.min(axis=1), atol=1e-5) and (np.abs(i - j) >= 2).all()
    flat, none = grouped.profile(np.ones(30), 5)
    assert np.isinf(flat).all() and (none == -1).all() and len(grouped.profile(np.ones(3), 5)[0]) == 0
    with pytest.raises(ValueError):
        grouped.profile(x, 3)


def test_matrix_profile_join_of_long_keys(spark):
    rng = np.random.default_rng(8)
    want = {(k, n): grouped.profile(x, 8)[0] for k, n in ((0, 60), (1, 150)) for x in [rng.normal(0, 1, n)]}
    rng = np.random.default_rng(8)
    rows = [(k, i, float(v)) for k, n in ((0, 60), (1, 150)) for i, v in enumerate(rng.normal(0, 1, n))]
    got = by_key(sq.matrix_profile_join(spark.createDataFrame(rows, "key long, i long, value double").withColumnRenamed("i", "at"), ["key"], ["at"], "value", 8, max_length=100), "distance")
    for (k, _), d in want.items():
        assert len(got[k]) == len(d) and np.allclose(got[k], d, atol=1e-5)


def test_functions(spark):
    row = spark.range(1).select(
        fn.fisher(F.array(F.lit(0.01), F.lit(0.02), F.lit(float("nan")))).alias("f"), fn.fisher(F.expr("array(cast(null as double))")).alias("none"), fn.platt(F.lit(float("inf")), 1.0, 0.0).alias("p"), fn.cosine(F.expr("array(0d, 0d)"), F.expr("array(1d, 0d)")).alias("c"),
        fn.valid_point(F.expr("array(1d, double('nan'))"), 2).alias("v"), fn.first_argmax(F.expr("array(1d, 3d, 3d)")).alias("a"), fn.SeverityBands().label(F.lit(float("nan"))).alias("s"), fn.drift_level(F.lit(0.3)).alias("d"),
    ).first()
    x = -2 * (math.log(0.01) + math.log(0.02))
    assert abs(row.f - math.exp(-x / 2) * (1 + x / 2)) < 1e-12
    assert (row.none, row.p, row.c, row.v, row.a, row.s, row.d) == (1.0, 0.5, 0.0, False, 1, "Normal", "Alert")
    for bad in (lambda: fn.SeverityBands(3, 2, 4, 5), lambda: fn.scaled(F.col("x"), [0.0]), lambda: ag.bloom_shape(0), lambda: forest.ForestParams(4, num_trees=10), lambda: steps.Ema(0), lambda: steps.AuditChain(b"short"), lambda: steps.Digest(1)):
        with pytest.raises(ValueError):
            bad()


def test_digest_and_space_saving():
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, 20_000)
    a, b = steps.Digest(), steps.Digest()
    for v in x[:10_000]:
        a.record(v)
    for v in [*x[10_000:], float("nan"), None]:
        b.record(v)
    a.merge(b)
    assert abs(a.weight - 20_000) < 1e-6 and all(abs(a.quantile(q) - np.quantile(x, q)) < 0.03 for q in (0.01, 0.5, 0.99))
    s = steps.SpaceSaving(10)
    for k in [0] * 50 + list(range(1, 30)) + [0] * 20:
        s.update(k)
    assert s.top(1)[0][0] == 0 and s.top(1)[0][1] - s.top(1)[0][2] <= 70 <= s.top(1)[0][1] and s.error_bound == s.total / 10


def test_rate_cap_and_clusters():
    cap = steps.RateCap(2, 10)
    assert [cap.update(t)[0] for t in (5, 6, 7, 15, 16, 24, 25)] == [True, True, False, True, True, False, True]
    assert steps.RateCap(0).update(1) == (True, None)
    c = steps.AlertClusters(0.9, 100, 2)
    got = [c.update(t, v, 1.0, k)[:3] for t, v, k in ((0, [1, 0], "a"), (1, [1, 0.01], "b"), (2, [0, 1], "a"), (3, [-1, 0], "a"), (300, [1, 0], "a"))]
    assert got == [("New", 0, 1), ("Joined", 0, 2), ("New", 1, 1), ("New", 2, 1), ("New", 3, 1)] and len(c.live) == 1


def auc(s, y):
    order = np.argsort(s)
    r = np.empty(len(s))
    r[order] = np.arange(1, len(s) + 1)
    p = y.sum()
    return (r[y].sum() - p * (p + 1) / 2) / (p * (len(y) - p))


@pytest.fixture(scope="module")
def clusters(spark):
    rng = np.random.default_rng(4)
    train = spark.createDataFrame([(i, i, [float(a), float(b)]) for i, (a, b) in enumerate(rng.random((500, 2)) * 0.2)], "point_id long, seq long, features array<double>")
    test = np.concatenate([rng.random((200, 2)) * 0.2, 8 + rng.random((25, 2))])
    frame = spark.createDataFrame([(i, [float(a), float(b)], i >= 200) for i, (a, b) in enumerate(test)], "point_id long, features array<double>, label boolean")
    return train, frame


def test_forest_quality(clusters):
    train, test = clusters
    model = forest.fit(train, forest.ForestParams(2, 100, 64, seed=1))
    out = model.score(test).toPandas()
    y = out["label"].to_numpy()
    for column in ("score", "trimmed", "early_score", "codisp"):
        assert auc(out[column].to_numpy(), y) > 0.95, column
    assert out[y]["score"].mean() / out[~y]["score"].mean() > 1.5 and (out["score"] >= 0).all() and out["early_trees"].between(16, 100).all()
    far = model.attribute(test.where("label")).first()
    assert min(far.high) > 0 and sum(far.low) < sum(far.high) and all(0 <= c <= 1 for c in far.confidence)
    assert model.samples.groupBy("tree_id").count().agg(F.max("count")).first()[0] == 64
    assert model.nodes.where("cut_dim < 0").groupBy("tree_id").agg(F.sum("mass").alias("m")).where("m <> 64").count() == 0


def test_forest_updates_and_persistence(spark, clusters, tmp_path):
    train, test = clusters
    p = forest.ForestParams(2, 50, 32, seed=2)
    whole = forest.fit(train, p)
    parts = forest.fit(train.where("point_id < 250"), p).update(train.where("point_id >= 250"))
    key = lambda m: {(r.tree_id, r.point_id) for r in m.samples.collect()}
    assert key(whole) == key(parts)
    gone = whole.samples.select("point_id").distinct().limit(5)
    ids = {r.point_id for r in gone.collect()}
    assert not ids & {i for _, i in key(whole.delete(gone.sparkSession.createDataFrame([(i,) for i in ids], "point_id long")))}
    whole.save(f"{tmp_path}/m")
    whole.save(f"{tmp_path}/m")
    scores = lambda m: {r.point_id: r.score for r in m.score(test).collect()}
    assert scores(forest.load(spark, f"{tmp_path}/m")) == scores(whole) == scores(forest.from_json(spark, whole.to_json()))
    with pytest.raises(ValueError):
        forest.from_json(spark, json.dumps({"version": 9}))
    bad = spark.createDataFrame([(1, 1, [1.0]), (2, 2, [float("nan"), 1.0]), (3, 3, None)], "point_id long, seq long, features array<double>")
    assert tuple(forest.bootstrap_report(bad, p).first()) == (0, 3) and forest.sample(bad, p).count() == 0


def test_scores_by_recursion(clusters):
    train, test = clusters
    model = forest.fit(train, forest.ForestParams(2, 50, 32, seed=3))
    rows = model.nodes.collect()
    arrays = forest.Arrays(rows)
    trees = {}
    for r in rows:
        trees.setdefault(r.tree_id, {})[r.node_id] = r
    x = np.array([r.features for r in test.limit(15).collect()] + [[0.1, 9.0]])

    def one(tree, p):
        node, depth, total, whole = tree[0], 0, 0.0, tree[0].mass
        while True:
            m = node.mass
            d = depth + math.log2(m)
            seen, damp = (1 / d if d > 0 else 0.0), 1 / (1 + math.log(m) / math.log(whole))
            ext = sum(max(0, a - h) + max(0, lo - a) for a, lo, h in zip(p, node.mn, node.mx, strict=True))
            room = sum(h - lo for lo, h in zip(node.mn, node.mx, strict=True)) + ext
            if node.left < 0:
                return (total + seen * damp) / math.log2(whole)
            q = ext / room if room else 0
            total += ((1 - q) * seen + q * d) * damp
            node, depth = tree[node.left if p[node.cut_dim] <= node.cut_value else node.right], depth + 1

    got, _ = arrays.walk(x)
    want = np.array([[one(trees[t], p) for t in sorted(trees)] for p in x])
    assert np.allclose(got, want)


def test_triage(spark):
    rng = np.random.default_rng(5)
    rows = [(float(s), bool(rng.random() < 1 / (1 + math.exp(-(2 * s - 1))))) for s in rng.normal(0, 2, 2000)]
    fitted = triage.fit_platt(spark.createDataFrame(rows, "score double, label boolean"), "score", "label")
    assert fitted.converged and abs(fitted.a + 2) < 0.4 and abs(fitted.b - 1) < 0.4
    assert not math.isnan(triage.fit_platt(spark.createDataFrame([(1.0, True)] * 5, "score double, label boolean"), "score", "label").a)
    records = spark.createDataFrame([("c", i, json.dumps({"b": i, "a": 1.5})) for i in range(20)], "chain string, i long, record string")
    key = bytes(range(32))
    chain = fold(records, ["chain"], ["i"], ["record"], lambda: steps.AuditChain(key)).persist()
    assert triage.verify_chain(chain, key, ["chain"]).count() == 0
    broken = chain.withColumn("record", F.when(F.col("seq") == 7, '{"a":2}').otherwise(F.col("record")))
    assert [tuple(r) for r in triage.verify_chain(broken, key, ["chain"]).collect()] == [("c", 7, "tag")]
    assert [tuple(r) for r in triage.verify_chain(chain.where("seq <> 4"), key, ["chain"]).collect()] == [("c", 5, "gap")]
    assert [tuple(r) for r in triage.verify_chain(chain.where("seq < 15"), key, ["chain"], expected_last=19).collect()] == [("c", 14, "truncated")]
    good = '{"version":1,"timestamp_ms":5,"point":[1.0],"score":2.0,"attribution":{"high":[1.0],"low":[0.0]}}'
    lines = spark.createDataFrame([(good,), (good.replace('"score"', '"rogue_field":1,"score"'),), (good.replace(':1,"time', ':2,"time'),), ("nonsense",)], "value string")
    assert [r.rejected for r in triage.parse_alerts(lines).collect()] == [None, "unknown field", "version", "not an object"]


def test_sketches(spark):
    df = spark.range(5000).select((F.col("id") % 700).alias("k"), F.lit("g").alias("g"))
    estimate = ag.hyperloglog_estimate(ag.hyperloglog(df, ["g"], "k"), ["g"]).first().estimate
    assert abs(estimate - 700) < 40
    bits, hashes = ag.bloom_shape(700)
    f = ag.bloom(df, "k", bits, hashes)
    probes = ag.bloom_contains(f, spark.range(3000).withColumnRenamed("id", "k"), "k", bits, hashes)
    assert probes.where("k < 700 and not contained").count() == 0 and probes.where("k >= 700 and contained").count() < 100
    cms = ag.count_min(df, "k", 512, 4)
    assert ag.count_min_estimate(cms, df.select("k").distinct(), "k", 512, 4).where("estimate < 7").count() == 0
    assert tenants.evict_idle(df, "k", 700, 10).where("k < 690").count() == 0


def test_sources(spark, tmp_path):
    (tmp_path / "s.csv").write_text("a,Label,b,label\n1,2,3,true\n\n4,5,6.5,0\n")
    rows = sources.labelled_csv(spark, f"{tmp_path}/s.csv")
    assert rows.columns == ["a", "Label", "b", "label"] and sorted(map(tuple, rows.collect())) == [(1.0, 2.0, 3.0, True), (4.0, 5.0, 6.5, False)]
    (tmp_path / "bad.csv").write_text("a,label\n1,maybe\n")
    with pytest.raises(Exception, match="not a label"):
        sources.labelled_csv(spark, f"{tmp_path}/bad.csv").collect()
    (tmp_path / "w.json").write_text('{"f.csv": [["2024-01-01 00:00:00.000", "2024-01-02 00:00:00.000"]]}')
    windows = sources.windows_json(spark, f"{tmp_path}/w.json")
    at = spark.createDataFrame([("f.csv", "2024-01-01 12:00:00"), ("f.csv", "2024-01-03 00:00:00"), ("g.csv", "2024-01-01 12:00:00")], "series string, ts string")
    assert sources.label_by_windows(at, windows, "series", "ts").where("label").count() == 1
    name = spark.createDataFrame([("007_SMD_id_3_x_tr_100_1st_250.csv",)], "n string").select(*sources.name_parts(F.col("n"))).first()
    assert tuple(name) == (7, "SMD", 100, 250)


def same(a: pd.DataFrame, b: pd.DataFrame) -> bool:
    cols = sorted(a.columns)
    clean = lambda v: None if v is None or v is pd.NaT or isinstance(v, float) and v != v else float(v) if isinstance(v, (int, float, np.number)) and not isinstance(v, (bool, np.bool_)) else str(v)
    rows = lambda d: sorted((tuple(map(clean, t)) for t in d[cols].itertuples(index=False)), key=repr)
    return cols == sorted(b.columns) and rows(a) == rows(b)


@pytest.mark.parametrize("name", sorted(registered.oracle_sql()))
def test_queries_equal_sql(spark, name):
    con = duckdb.connect()
    for t in ("customer", "orders", "lineitem", "events", "documents", "embeddings", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    assert same(registered.queries()[name](spark, SF).toPandas(), con.sql(registered.oracle_sql()[name]).df())


def test_profiles_of_all_users(spark):
    events = pd.read_parquet(f"{SF}/events.parquet").sort_values(["user_id", "ts", "event_id"])
    want = {}
    for user, part in events.groupby("user_id"):
        x = part["value"].to_numpy(float)
        if len(x) < 8:
            continue
        z = np.lib.stride_tricks.sliding_window_view(x, 8)
        z = (z - z.mean(axis=1, keepdims=True)) / z.std(axis=1, keepdims=True)
        full = np.sqrt(((z[:, None] - z[None]) ** 2).sum(axis=2))
        i = np.arange(len(z))
        full[np.abs(i[:, None] - i[None]) < 2] = np.inf
        want |= {(user, k): d for k, d in enumerate(full.min(axis=1)) if np.isfinite(d)}
    for name in ("matrix_profile", "matrix_profile_join"):
        got = {(r.user_id, r.i): r.distance for r in registered.queries()[name](spark, SF).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-3 for k in want), name
    got = {r.user_id: (r.discord, r.motif) for r in registered.queries()["discord_motif"](spark, SF).collect()}
    for user in {u for u, _ in want}:
        own = [d for (u, _), d in want.items() if u == user]
        assert abs(got[user][0] - max(own)) < 1e-3 and abs(got[user][1] - min(own)) < 1e-3
    assert got.keys() == {u for u, _ in want} and {u % 10 for u in got} != {1}


def test_whole_table_queries(spark):
    q = lambda name: registered.queries()[name](spark, SF).toPandas()
    events, items = pd.read_parquet(f"{SF}/events.parquet"), pd.read_parquet(f"{SF}/lineitem.parquet")
    got = q("fisher").set_index("user_id")["p_value"]
    assert set(got.index) == set(events["user_id"])
    for user, ids in events.groupby("user_id")["event_id"]:
        x = -sum(math.log((i % 97 + 1) / 98) for i in ids)
        want = sum(math.exp(-x + i * math.log(x) - math.lgamma(i + 1)) for i in range(len(ids)))
        assert abs(got[user] - min(1, want)) < 1e-5
    got = q("forensic").set_index("dim")
    for dim in registered.DIMS:
        v = items[dim].astype(float)
        assert got.loc[dim, "live_points"] == len(items) and abs(got.loc[dim, "expected"] - v.mean()) < 1e-4 and abs(got.loc[dim, "stddev"] - v.std()) < 1e-4
    got = q("shapley_linear")
    assert len(got) == 4 * len(items) and not got.duplicated(["point_id", "copy", "dim"]).any()
    for dim, (name, factor, base) in enumerate(zip(registered.DIMS, (1, 2, 3, 4), (25.0, 40000.0, 0.05, 0.04), strict=True)):
        want = factor * (items[name].astype(float) - base)
        assert np.allclose(np.sort(got[got["dim"] == dim]["contribution"].astype(float)), np.sort(want), atol=1e-4)
    got = q("reservoir_sample")
    assert (got.groupby("tree_id").size() == 256).all() and got["tree_id"].nunique() == 100


def test_sketched_quantiles_of_queries(spark):
    """Ranks of what the sketches give are within a hundredth of the asked ones."""
    events = pd.read_parquet(f"{SF}/events.parquet")
    for name in ("kll_quantiles", "tdigest"):
        got = registered.queries()[name](spark, SF).toPandas().set_index("event_type")
        for kind, values in events.groupby("event_type")["value"]:
            v = np.sort(values.to_numpy(float))
            for q in (0.01, 0.5, 0.99):
                at = got.loc[kind, f"q{round(q * 1000)}"]
                assert np.searchsorted(v, at, "left") / len(v) - 0.02 <= q <= np.searchsorted(v, at, "right") / len(v) + 0.02, (name, kind, q)
            assert got.loc[kind, "min"] == v[0] and got.loc[kind, "max"] == v[-1] and got.loc[kind, "weight"] == len(v)


def test_wrapped_queries(spark):
    """One row per input row, thresholds by the plain loop, one swap."""
    items, events = pd.read_parquet(f"{SF}/lineitem.parquet"), pd.read_parquet(f"{SF}/events.parquet")
    q = lambda name: registered.queries()[name](spark, SF).toPandas()
    graded = q("thresholded_forest").sort_values(["key", "point_id"])
    assert len(graded) == len(items)
    assert set(q("threshold_states")["key"]) == set(graded["key"])
    row = q("drift_recovery").iloc[0]
    assert row["began"] and row["swaps"] == 1 and not row["recovering"]
    assert len(q("tenant_pool")) == events["value"].notna().sum() and (q("forest_codisp")["codisp"] > 0).all()
    assert len(q("shingled_forest")) == sum(max(0, n - 8) for n in events.groupby("user_id").size())
