"""Detectors that wrap a forest, states between runs, SQL functions, evaluation protocols."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnwatch import streaming
from tarnwatch.functions import sql
from tarnwatch.operators import detectors, evaluation, forest, steps
from tarnwatch.plans import state
from tarnwatch.plans.fold import fold, states

PARAMS = forest.ForestParams(2, num_trees=50, sample_size=64, seed=4)


def rows_of(rng, n, centre, start=0, key="k"):
    return [(key, start + i, start + i, [float(a), float(b)]) for i, (a, b) in enumerate(rng.normal(centre, 0.1, (n, 2)))]


def frame(spark, rows):
    return spark.createDataFrame(rows, "key string, point_id long, seq long, features array<double>").repartition(3)


def test_thresholded_forest(spark, tmp_path):
    rng = np.random.default_rng(1)
    calm = frame(spark, [*rows_of(rng, 300, 0.0), *rows_of(rng, 60, 0.0, 2000, "other")])
    model = forest.fit(calm, PARAMS)
    detector = detectors.ThresholdedForest(model, lambda: steps.Threshold(min_threshold=0.1))
    graded, after = detector.process(calm, ["key"], ["seq"], ["point_id"])
    got = sorted(graded.where("key = 'k'").collect(), key=lambda r: r.seq)
    # the first point is neither graded nor recorded; each grade uses the scores before
    step = steps.Threshold(min_threshold=0.1)
    assert [(r.threshold, r.grade, r.is_anomaly, r.ready) for r in got] == [step.update(r.score) for r in got]
    assert not got[0].ready and got[100].ready and after.model.updates_seen == 720
    stats = {r.key: r for r in after.stats(["key"]).collect()}
    assert stats["k"].n == 299 and stats["other"].n == 59 and abs(stats["k"].mean - step.ema.mean) < 1e-12
    odd = frame(spark, [("k", 9000, 9000, [9.0, 9.0]), ("k", 9001, 9001, [0.0, 0.0]), ("new", 9002, 9002, [9.0, 9.0])])
    only = {r.point_id: r for r in after.score_only(odd, ["key"]).collect()}
    assert only[9000].is_anomaly and only[9000].grade > 0 and not only[9001].is_anomaly and not only[9002].ready
    want = step.grade(only[9000].score)
    assert np.allclose(only[9000].threshold, want[0]) and np.allclose(only[9000].grade, want[1])
    # nothing was recorded
    assert {r.key: r.n for r in after.stats(["key"]).collect()} == {"k": 299, "other": 59}
    # a run in two parts equals one run, also when saved between
    first, second = calm.where("seq % 1000 < 40"), calm.where("seq % 1000 >= 40")
    part, halfway = detector.process(first, ["key"], ["seq"], learn=False)
    halfway.save(f"{tmp_path}/d")
    again = detectors.ThresholdedForest.load(spark, f"{tmp_path}/d", detector.make)
    rest, done = again.process(second, ["key"], ["seq"], learn=False)
    grades = lambda *dfs: {(r.key, r.seq): round(r.grade, 9) for df in dfs for r in df.collect()}
    assert grades(part, rest) == grades(graded)
    assert {r.key: r.n for r in done.stats(["key"]).collect()} == {"k": 299, "other": 59}
    assert detector.reset_stats().states is None and after.forensic_baseline({"x": 5.0, "y": 0.0}).where("zscore > 5").count() == 1
    with pytest.raises(ValueError):
        detector.stats(["key"])


def test_thresholded_stream_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(2)
    calm = frame(spark, rows_of(rng, 200, 0.0))
    model = forest.fit(calm, PARAMS)
    for part in range(2):
        calm.where(f"seq div 100 = {part}").coalesce(1).write.parquet(f"{tmp_path}/in/p{part}")
    stream = spark.readStream.schema(calm.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    graded = streaming.stream_fold(model.score(stream), ["key"], ["seq"], ["seq"], steps.Threshold, value="score")
    q = graded.writeStream.format("memory").queryName("thresholded").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    batch, _ = detectors.ThresholdedForest(model).process(calm, ["key"], ["seq"], learn=False)
    key = lambda df: sorted((r.seq, round(r.threshold, 9), r.grade) for r in df.collect())
    assert key(spark.table("thresholded")) == key(batch)


def test_drift_recovery(spark):
    rng = np.random.default_rng(3)
    young = detectors.DriftAwareForest(PARAMS).update(frame(spark, rows_of(rng, 300, 0.0)))
    assert young.primary_age == 300 and young.on_drift() == (young, False)
    old = young.update(frame(spark, rows_of(rng, 300, 0.0, 300)))
    assert old.primary_age == 600 and old.swaps == 0
    probe = frame(spark, [("k", 1, 1, [5.0, 5.0])])
    before = old.score(probe).first().score
    drifting, began = old.on_drift()
    assert began and drifting.recovering and drifting.on_drift()[1] is False
    aborted = drifting.update(frame(spark, rows_of(rng, 100, 5.0, 600))).abort_shadow()
    assert not aborted.recovering and aborted.primary_age == 700 and aborted.shadow_progress == 0
    halfway = drifting.update(frame(spark, rows_of(rng, 600, 5.0, 600)))
    assert halfway.recovering and halfway.shadow_progress == 600 and halfway.swaps == 0
    swapped = halfway.update(frame(spark, rows_of(rng, 500, 5.0, 1200)))
    assert not swapped.recovering and swapped.swaps == 1 and swapped.primary_age == 1100
    assert swapped.score(probe).first().score < before / 1.5  # what was strange is normal now
    values = spark.createDataFrame([("k", i, float(v)) for i, v in enumerate([*rng.normal(1, 0.1, 200), *rng.normal(4, 0.1, 200)])], "key string, seq long, score double")
    assert old.watch(values, ["key"], ["seq"])[1] and not old.watch(values.where("seq < 200"), ["key"], ["seq"])[1]


def test_learner_keeps_lineage_short(spark, tmp_path):
    rng = np.random.default_rng(5)
    box, seen = [forest.fit(frame(spark, rows_of(rng, 100, 0.0)), PARAMS)], []
    run = streaming.learner(box, lambda scored, n: seen.append(scored.count()))
    for n in range(3):
        run(frame(spark, rows_of(rng, 50, 0.0, 1000 * (n + 1))), n)
    assert seen == [50, 50, 50] and box[0].updates_seen == 250
    assert box[0].samples._jdf.queryExecution().optimizedPlan().toString().count("Union") == 0


def test_shingled_forest(spark):
    values = [math.sin(i * 0.5) for i in range(512)]
    series = spark.createDataFrame([("k", i, v) for i, v in enumerate(values)], "key string, i long, value double")
    p = forest.ForestParams(16, num_trees=100, sample_size=128, seed=6)
    detector = detectors.ShingledForest.fit(series, ["key"], ["i"], "value", p)
    assert detector.model.updates_seen == 512 - 16  # every full window but the newest
    scored = detector.score(series, ["key"], ["i"], "value").collect()
    assert len(scored) == 512 - 16 and min(r.i for r in scored) == 16
    base = np.mean([r.score for r in scored])
    flat = spark.createDataFrame([(1, [0.95] * 16)], "point_id long, features array<double>")
    assert detector.model.score(flat).first().score > 1.5 * base
    spiked = spark.createDataFrame([("k", i, v if i != 511 else 8.0) for i, v in enumerate(values)], series.schema)
    last = max(detector.score(spiked, ["key"], ["i"], "value").collect(), key=lambda r: r.i)
    assert last.score > 1.5 * base
    lags = max(detector.attribution(spiked, ["key"], ["i"], "value").collect(), key=lambda r: r.i)
    assert int(np.argmax(np.array(lags.high) + np.array(lags.low))) == 15
    now = detector.current_shingle(series, ["key"], ["i"], "value").first()
    assert now.full and np.allclose(now.shingle, values[-16:])


def test_codisp_with_the_probe_inserted(spark):
    rng = np.random.default_rng(7)
    train = frame(spark, rows_of(rng, 300, 0.0))
    model = forest.fit(train, PARAMS)
    probes = frame(spark, [("k", 1, 1, [6.0, 6.0]), ("k", 2, 2, [0.0, 0.0])])
    got = {r.point_id: r.codisp for r in model.codisp(probes).collect()}
    assert got[1] > 30 > 10 > got[2] > 0  # far: parted near the root from nearly all
    assert got == {r.point_id: r.codisp for r in model.codisp(probes).collect()}
    alone = forest.fit(frame(spark, [("k", 1, 1, [1.0, 1.0])]), PARAMS)
    assert {r.point_id: r.codisp for r in alone.codisp(frame(spark, [("k", 5, 5, [1.0, 1.0]), ("k", 6, 6, [2.0, 1.0])])).collect()} == {5: 0.0, 6: 1.0}
    assert model.depths().where("depth < 5 or nodes <> 2 * leaves - 1").count() == 0


def test_states_are_checked():
    step = steps.Threshold(mode="quantile")
    for v in np.random.default_rng(1).normal(0, 1, 500).tolist():
        step.update(v)
    raw = state.dump(step)
    again = state.load(raw, steps.Threshold(mode="quantile"))
    assert [again.update(v) for v in (0.5, 9.0)] == [step.update(v) for v in (0.5, 9.0)]
    for bad in (raw.replace(b'"version": 1', b'"version": 2'), raw.replace(b'"kind": "Threshold"', b'"kind": "Ema"'), raw.replace(b'"z": 3.0', b'"z": -3.0'), raw.replace(b'"z": 3.0', b'"rogue": 3.0'), b'{"version": 1, "step": {"kind": "os", "state": {}}}'):
        with pytest.raises((ValueError, TypeError)):
            state.load(bad, steps.Threshold())
    for made in (steps.Adwin(cap=64), steps.Spot(calibrate=None), steps.SpaceSaving(4), steps.AlertClusters(), steps.AuditChain(bytes(32)), steps.EwmaPoint(warmup=1), steps.MetaDrift(), steps.RateCap()):
        feed = {"SpaceSaving": lambda i: (i % 7,), "AlertClusters": lambda i: (i, [1.0, i % 3], 1.0, "t"), "AuditChain": lambda i: (f'{{"a":{i}}}',), "EwmaPoint": lambda i: ([float(i), 1.0],), "RateCap": lambda i: (i,)}.get(type(made).__name__, lambda i: (float(i % 11),))
        for i in range(40):
            made.update(*feed(i))
        copy = state.load(state.dump(made), made)
        assert [copy.update(*feed(i)) for i in range(40, 80)] == [made.update(*feed(i)) for i in range(40, 80)], type(made).__name__


def test_fold_from_states(spark):
    rows = spark.createDataFrame([(k, i, float((i * 7 + k) % 13)) for k in range(3) for i in range(60)], "k int, i int, value double")
    whole = {(r.k, r.i): r.mean for r in fold(rows, ["k"], ["i"], ["i"], steps.Ema).collect()}
    kept = states(rows.where("i < 25"), ["k"], ["i"], steps.Ema)
    assert kept.count() == 3
    rest = {(r.k, r.i): r.mean for r in fold(rows.where("i >= 25"), ["k"], ["i"], ["i"], steps.Ema, kept).collect()}
    assert rest == {x: m for x, m in whole.items() if x[1] >= 25}


def test_steps_against_plain_forms():
    rng = np.random.default_rng(9)
    items = [int(x) for x in rng.zipf(1.4, 3000) % 60]
    fast, slow = steps.SpaceSaving(12), {}
    for k in items:
        got = fast.update(k)
        if k in slow:
            slow[k][0] += 1
        elif len(slow) < 12:
            slow[k] = [1, 0]
        else:
            victim = min(slow, key=lambda x: (slow[x][0], str(x)))
            least = slow.pop(victim)[0]
            slow[k] = [least + 1, least]
        assert got == tuple(slow[k])
    one, two = steps.SpaceSaving(12), steps.SpaceSaving(12)
    for k in items[:1500]:
        one.update(k)
    for k in items[1500:]:
        two.update(k)
    both = one.merge(two)
    exact = {k: items.count(k) for k in set(items)}
    assert both.total == 3000 and all(c - e <= exact[k] <= c for k, (c, e) in both.counts.items())
    adwin, window = steps.Adwin(cap=100), []
    for v in np.concatenate([rng.normal(0, 1, 250), rng.normal(5, 1, 150), rng.normal(0, 1, 150)]).tolist():
        fired, mean, n, _ = adwin.update(v)
        window = [*window, v][-100:]
        want = False
        for a in range(16, len(window) - 15):
            x, y = window[:a], window[a:]
            bound = (max(window) - min(window)) * math.sqrt(math.log(4 * len(window) / 0.002) / 2 * (1 / len(x) + 1 / len(y)))
            if abs(np.mean(x) - np.mean(y)) > bound:
                window, want = y, True
                break
        assert fired == want and n == len(window) and abs(mean - np.mean(window)) < 1e-9
    spot = steps.Spot(calibrate=None, q=0.9)
    with pytest.raises(ValueError):
        spot.freeze_baseline()
    for v in rng.normal(0, 1, 600).tolist():
        spot.update(v)
    spot.freeze_baseline()
    u = spot.u
    assert spot.peaks == 0 and spot.update(50.0)[0] <= 0.1 and spot.u == u and spot.peaks == 1
    point = steps.EwmaPoint(warmup=30)
    out = [point.update([a, b]) for a, b in rng.normal(0, 1, (60, 2))]
    assert out[29] == (None, None) and out[30][0] == max(out[30][1]) and point.update([50.0, 0.0])[0] > 5


def test_sql_functions(spark):
    names = sql.register(spark)
    rows = spark.createDataFrame([(k, i, float((i * 7 + k) % 13)) for k in range(3) for i in range(60)], "k int, i int, value double")
    rows.createOrReplaceTempView("sql_rows")
    for name, make in (("rcf_ema", steps.Ema), ("rcf_threshold", steps.Threshold)):
        got = spark.sql(f"SELECT * FROM {name}(TABLE(sql_rows) PARTITION BY k ORDER BY i)")
        last = make().fields[0][0]
        assert {(r.k, r.i): r[last] for r in got.collect()} == {(r.k, r.i): r[last] for r in fold(rows, ["k"], ["i"], ["i"], make).collect()} and name in names
    model = forest.fit(frame(spark, rows_of(np.random.default_rng(8), 200, 0.0)), PARAMS)
    sql.register_model(spark, model)
    probes = spark.createDataFrame([(1, [0.0, 0.0]), (2, [5.0, 5.0]), (3, None), (4, [1.0])], "id int, features array<double>")
    probes.createOrReplaceTempView("sql_probes")
    got = {r.id: r for r in spark.sql("SELECT id, rcf_score(features) AS s, rcf_attribution(features) AS a FROM sql_probes").collect()}
    want = {r.id: r for r in model.attribute(probes.where("id < 3")).collect()}
    assert all(abs(got[k].s - want[k].score) < 1e-9 and np.allclose(got[k].a.high, want[k].high) for k in (1, 2)) and got[3].s is None and got[4].a.high is None


def test_evaluation_protocols(spark):
    """Floors on look-alikes of the usual corpora: labelled series with bursts, and a scalar series with a strange stretch."""
    rng = np.random.default_rng(10)
    rows = []
    for k in range(2):
        x = rng.normal(0, 1, (600, 3)) + np.array([5.0, 50.0, -5.0]) * (k + 1)
        y = np.zeros(600, int)
        for a in (380, 500):  # long enough for a mean of about 50 rows to follow
            x[a : a + 70] += 9
            y[a : a + 70] = 1
        rows += [(f"s{k}", i, [float(v) for v in p], int(label)) for i, (p, label) in enumerate(zip(x, y, strict=True))]
    series = spark.createDataFrame(rows, "series string, i long, features array<double>, label int")
    p = forest.ForestParams(3, num_trees=100, sample_size=128, seed=3)
    for k in range(2):  # a file is evaluated by itself
        scored = evaluation.frozen(series.where(f"series = 's{k}'"), "series", "i", p, train=300)
        assert scored.count() == 300 and evaluation.report(scored, ["series"]).first().auc > 0.95
        got, ema = sorted(scored.collect(), key=lambda r: r.i), steps.Ema(0.02)
        assert np.allclose([r.smoothed for r in got], [ema.update(r.score)[0] for r in got])
        assert evaluation.report(scored, ["series"], "smoothed").first().auc > 0.7  # it lags by some 50 rows
    x = np.sin(np.arange(900) / 5) + rng.normal(0, 0.05, 900)
    x[600:630] = 2.5
    scalar = spark.createDataFrame([("n", i, float(v), int(600 <= i < 632)) for i, v in enumerate(x)], "series string, i long, value double, label int")
    scored = evaluation.warm_share(scalar, "series", "i", "value", 8, p, share=0.3)
    assert evaluation.report(scored, ["series"]).first().auc > 0.9


def test_alert_records(spark):
    from tarnwatch.operators import triage

    model = forest.fit(frame(spark, rows_of(np.random.default_rng(12), 200, 0.0)), PARAMS)
    points = frame(spark, [("k", 1, 5000, [4.0, 0.0]), ("k", 2, 6000, [0.0, 0.0])])
    lit = lambda df: df.withColumns({"threshold": F.lit(1.0), "grade": F.lit(0.5), "is_anomaly": F.lit(True), "ready": F.lit(True)})
    made = triage.alert_records(lit(model.attribute(points)), "key", "seq", model=model)
    lines = made.select(F.to_json("alert").alias("value"), "point_id")
    back = {r.point_id: r for r in triage.parse_alerts(lines).collect()}
    assert all(r.rejected is None for r in back.values()) and back[1].alert.tenant == "k" and back[1].alert.timestamp_ms == 5000
    assert back[1].alert.grade.threshold == 1.0 and back[1].alert.baseline.zscore[0] > 10 and back[1].alert.baseline.observed == [4.0, 0.0]
    assert back[1].alert.baseline.live_points == model.samples.select("point_id").distinct().count()
    bare = triage.alert_records(model.attribute(points), None, "seq").select("alert.*").first()
    assert bare.tenant is None and bare.grade is None and bare.baseline is None


def test_sage_sums_to_the_score(spark):
    from tarnwatch.operators import triage

    model = forest.fit(frame(spark, rows_of(np.random.default_rng(13), 200, 0.0)), PARAMS)
    points = frame(spark, [("k", 1, 1, [4.0, 0.0]), ("k", 2, 2, [3.0, 3.0])])
    got = triage.sage(model, points, [0.0, 0.0], 8)
    scores = {r.point_id: r.score for r in model.score(points).collect()}
    base = model.score(frame(spark, [("k", 0, 0, [0.0, 0.0])])).first().score
    sums = {r.point_id: r["sum(contribution)"] for r in got.groupBy("point_id").sum("contribution").collect()}
    assert all(abs(sums[k] - (scores[k] - base)) < 1e-9 for k in (1, 2))
    by = {(r.point_id, r.dim): r.contribution for r in got.collect()}
    assert by[1, 0] > abs(by[1, 1])
    with pytest.raises(ValueError):
        triage.shapley(points, model.score, 2000, [0.0] * 2000, 65_536)


def test_models_have_a_size(spark):
    with pytest.raises(ValueError, match="MB"):
        wide = forest.ForestParams(10_000, num_trees=1000, sample_size=2048)
        forest.ForestModel(wide, None, spark.range(0, 4_000_000)).arrays()


def test_unions_of_sketches(spark):
    from tarnwatch.operators import aggregates as ag

    a, b = spark.range(0, 600).withColumn("g", F.lit("g")), spark.range(400, 1000).withColumn("g", F.lit("g"))
    both = a.unionByName(b)
    rows = lambda df: sorted(map(tuple, df.select(*sorted(df.columns)).collect()))
    for kind, make in {"bloom": lambda d: ag.bloom(d, "id", 4096, 3), "hyperloglog": lambda d: ag.hyperloglog(d, ["g"], "id"), "count_min": lambda d: ag.count_min(d, "id", 64, 2), "histogram": lambda d: ag.histogram(d, ["g"], "id", 0, 1000, 8)}.items():
        assert rows(ag.union_of(make(a), make(b), kind)) == rows(make(both)), kind
    rate = ag.bloom_fill_rate(ag.bloom(both, "id", 8192, 5), 8192, 5).first().effective_fpr
    assert 0 < rate < 0.05
    with pytest.raises(ValueError):
        ag.union_of(a, ag.count_min(b, "id"), "count_min")


def test_windows_against_loops(spark):
    from tarnwatch.operators import sequences as sq

    rng = np.random.default_rng(14)
    rows = [(k, i, float(v), bool(y)) for k in range(2) for i, (v, y) in enumerate(zip(np.round(rng.normal(0, 1, 60), 1), rng.random(60) < 0.15, strict=True))]
    df = spark.createDataFrame(rows, "k int, i int, score double, label boolean")
    got = {(r.k, r.buffer): r.auc_pr for r in sq.range_auc_pr(df, ["k"], ["i"], "score", "label", [0, 1, 4, 9]).collect()}

    def loop(scores, labels, buffer):
        n = len(scores)
        order = sorted(range(n), key=lambda i: (-scores[i], i))
        near = [any(labels[max(0, i - buffer) : i + buffer + 1]) for i in range(n)]
        area, before_p, before_r, covered, hit = 0.0, 1.0, 0.0, 0, set()
        for rank, i in enumerate(order, 1):
            covered += near[i]
            hit |= {j for j in range(max(0, i - buffer), min(n, i + buffer + 1)) if labels[j]}
            p, r = covered / rank, len(hit) / sum(labels)
            if r > before_r:
                area, before_p, before_r = area + (before_p + p) / 2 * (r - before_r), p, r
        return area

    for k in range(2):
        s, y = [r[2] for r in rows if r[0] == k], [r[3] for r in rows if r[0] == k]
        assert all(abs(got[k, b] - loop(s, y, b)) < 1e-9 for b in (0, 1, 4, 9))
        vus = {r.k: r.vus_pr for r in sq.vus_pr(df, ["k"], ["i"], "score", "label", 6).collect()}[k]
        curve = [loop(s, y, b) for b in range(7)]
        assert abs(vus - sum((a + b) / 2 for a, b in zip(curve, curve[1:], strict=False)) / 6) < 1e-9
    cusum = sorted((r.i, r.s_pos, r.s_neg, r.alert, r.magnitude) for r in sq.cusum(df.where("k = 0"), ["k"], ["i"], "score", threshold=2.0).collect())
    for before, now in zip([None, *cusum], cusum, strict=False):
        assert now[4] == (max(now[1:3]) if now[3] else max(before[1:3]) if before else 0.0)
    for cap in (1, 7, 59, 60, 100):
        kept = [r.i for r in sq.stride_to(df.where("k = 0"), ["k"], ["i"], cap).orderBy("i").collect()]
        assert len(kept) <= cap and kept == list(range(0, 60, -(-60 // cap)))
    alerts = spark.createDataFrame([(g, i, [float(v)], [0.0]) for g, i, v in zip(["a", "b", None] * 50, range(150), rng.integers(-2, 3, 150) * 3, strict=False)], "g string, i long, high array<double>, low array<double>")
    for salts in (1, 8):
        opened, want = {}, {}
        for r in sorted(sq.lsh_clusters(alerts, ["g"], ["i"], "high", "low", salts=salts).collect(), key=lambda r: r.i):
            opened[r.g, r.bucket] = opened.get((r.g, r.bucket), 0) + 1
            want[r.i] = opened[r.g, r.bucket]
            assert r.cluster_size == want[r.i] and r.decision == ("New" if want[r.i] == 1 else "Joined")
        assert len(want) == 150


def test_nearest_tenants(spark):
    from tarnwatch.operators import tenants

    rng = np.random.default_rng(15)
    rows = [(f"t{k:04d}", 50, float(m), float(v)) for k, (m, v) in enumerate(zip(np.round(rng.normal(0, 3, 700), 1), np.round(rng.random(700), 2), strict=True))] + [("few", 3, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "tenant string, n long, mean double, variance double")
    key = lambda d: {(r.tenant_a, r["rank"]): (r.tenant_b, round(r.similarity, 9)) for r in d.collect()}
    fast, joined = key(tenants.most_similar(df, "tenant", 5)), key(tenants.most_similar(df, "tenant", 5, max_broadcast=10))
    assert len(fast) == 3500 and {k: v[1] for k, v in fast.items()} == {k: v[1] for k, v in joined.items()}
    assert sum(fast[k][0] != joined[k][0] for k in fast) < 10  # ties by rounding only
    assert tenants.most_similar(df.limit(3), "tenant", 5).count() == 6 and tenants.most_similar(df.limit(0), "tenant", 5).count() == 0


def test_line_scorer(spark):
    model = forest.fit(frame(spark, rows_of(np.random.default_rng(11), 200, 0.0)), PARAMS)
    lines = spark.createDataFrame([("0.0, 0.05",), ("7,7",), ("x,1",), ("1",), ("nan,1",), ("",)], "value string")
    got = [r.value for r in streaming.score_lines(lines, model, 1.0).collect()]
    assert len(got) == 2 and got[0].endswith("false") and got[1].endswith("true")


def test_range_auc_of_long_series(spark):
    """A frame from each row to the last took time in the square of a key's rows: 60,000 of them, over a minute."""
    import time

    from tarnwatch.operators import sequences as sq

    n = 60_000
    df = spark.range(n).select(F.lit(1).alias("k"), F.col("id").alias("i"), F.pmod(F.xxhash64("id"), F.lit(1_000_003)).cast("double").alias("score"), (F.col("id") % 29_989 == 7).alias("label"))
    began = time.time()
    got = {r.buffer: r.auc_pr for r in sq.range_auc_pr(df, ["k"], ["i"], "score", "label", [0, 2]).collect()}
    assert set(got) == {0, 2} and 0 < got[0] < got[2] < 1
    assert time.time() - began < 30


def test_shapley_meets_as_one_row(spark):
    """Rows went through the shuffle once for each step of each permutation: 5 x 4 = 20 here, 5 distinct at most 8; now none, if they are dealt by an id."""
    from tarnwatch.operators import triage

    rows = [(k, 0, [float(k), 2.0 * k, None if k == 3 else 1.0]) for k in range(40)]
    points = spark.createDataFrame(rows, "point_id long, copy int, features array<double>").repartition(3, "point_id")
    score = lambda df: df.withColumn("score", F.col("features")[0] + 10 * F.col("features")[1] * F.col("features")[2])
    out = triage.shapley(points, score, 3, [0.0, 0.0, 0.0], 5, ids=("point_id", "copy"))
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    few = {(r.point_id, r.dim): r.contribution for r in out.collect()}
    assert len(few) == 120 and all(few[k, 0] == k and abs(few[k, 1] + few[k, 2] - 20 * k) < 1e-9 for k in range(40) if k != 3)
    assert few[3, 2] is None and few[3, 0] == 3.0
    triage.MAX_COLUMNS, kept = 0, triage.MAX_COLUMNS
    try:
        many = {(r.point_id, r.dim): r.contribution for r in triage.shapley(points, score, 3, [0.0, 0.0, 0.0], 5, ids=("point_id", "copy")).collect()}
    finally:
        triage.MAX_COLUMNS = kept
    assert many == few


def test_forensic_of_a_table_keeps_no_rows(spark):
    """Rows were numbered and grouped by id first: a sort of the whole table in memory, where its moments are asked for."""
    from tarnwatch.plans import queries

    plan = queries.queries()["forensic"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "Window" not in plan and "Sort" not in plan


def test_boxes_are_met_from_the_leaf_up(spark):
    """Every box on a row's way was worked out, though most rows are inside most of them."""
    rng = np.random.default_rng(21)
    points = rng.normal(0, 1, (256, 4))
    nodes = [dict(zip(("node_id", "left", "right", "cut_dim", "cut_value", "mn", "mx", "mass", "point_id"), n, strict=True)) | {"tree_id": 0} for n in forest.build_tree(points, np.arange(256), rng)]
    a, x = forest.Arrays(nodes), np.concatenate([rng.normal(0, 1, (300, 4)), points[:50]])
    leaf = a.leaves(x, np.zeros(len(x), np.int64))
    both, want = np.concatenate([x, -x], axis=1), set()
    for i, k in enumerate(leaf.tolist()):
        while k < len(nodes):
            if (np.maximum(both[i] - a.box[k], 0) > 0).any():
                want.add((i, k))
            k = int(a.up[k])
    got = [(i, k) for rows, at, _, _ in a.outside(both, leaf) for i, k in zip(rows.tolist(), at.tolist(), strict=True)]
    assert len(got) == len(set(got)) and set(got) == want and len(got) < 0.6 * (a.depth[leaf] + 1).sum()


def test_rows_are_graded_under_their_own_supplier(spark):
    """The supplier came from some row of the same id."""
    from tarnwatch.plans import queries

    d = "/root/testdata/sf0.001"
    own = spark.read.parquet(f"{d}/lineitem.parquet").selectExpr("l_suppkey as key", "l_orderkey * 16 + l_linenumber as point_id")
    got = queries.queries()["thresholded_forest"](spark, d).select("key", "point_id")
    assert got.exceptAll(own).count() == 0 and got.count() == own.count()


def test_profiles_of_short_keys(spark):
    """Pairs were sorted as rows for their minimum, and a key's profile took hundreds of calls for each of its diagonals."""
    from tarnwatch.operators import grouped
    from tarnwatch.operators import sequences as sq

    rng = np.random.default_rng(30)
    series = {k: np.round(rng.exponential(40, n), 2) for k, n in enumerate((60, 80, 11, 8, 5, 700))}
    series[6] = np.full(40, 3.0)
    df = spark.createDataFrame([(k, i, float(v)) for k, x in series.items() for i, v in enumerate(x)], "k long, i long, v double").repartition(3)
    plan = sq.matrix_profile_join(df, ["k"], ["i"], "v", 8)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan
    for got in (sq.matrix_profile_join(df, ["k"], ["i"], "v", 8), grouped.matrix_profile(df, ["k"], ["i"], "v", 8)):
        found = {(r.k, r.i): r for r in got.collect()}
        assert len(found) == sum(max(0, len(x) - 7) for x in series.values())
        for k, x in series.items():
            kept, grouped.MAX_DENSE = grouped.MAX_DENSE, 0
            d, _ = grouped.profile(x, 8)
            grouped.MAX_DENSE = kept
            assert np.allclose([found[k, i].distance for i in range(len(d))], d, atol=1e-6)
            assert all((found[k, i].neighbour is None) == np.isinf(d[i]) for i in range(len(d)))
    one = {r.k: r for r in grouped.discords(grouped.matrix_profile(df, ["k"], ["i"], "v", 8), ["k"], 1, 2).collect()}
    many = {r.k: r for r in grouped.discords(grouped.matrix_profile(df, ["k"], ["i"], "v", 8), ["k"], 2, 2).where("rank = 0").collect()}
    assert one == many and 6 not in one


def test_pairs_of_tenants_are_not_shuffled(spark):
    """A cartesian product of shuffled parts, each read again for every other and kept on disk meanwhile."""
    from tarnwatch.operators import tenants

    states = spark.range(60).select("id", F.lit(40).alias("n"), (F.col("id") % 7 / 10).alias("mean"), (F.col("id") % 5 / 10).alias("variance"))
    got = {}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for most in (1000, 10):
            out = tenants.similarity(states, "id", max_broadcast=most)
            plan = out._jdf.queryExecution().executedPlan().toString()
            assert ("CartesianProduct" in plan) == (most == 10) and ("BroadcastNestedLoopJoin" in plan) == (most == 1000)
            got[most] = {(r.tenant_a, r.tenant_b): r.similarity for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got[1000] == got[10] and len(got[10]) == 60 * 59 // 2
