import functools

from pyspark.sql import functions as F

from innsight.functions.frames import stage
from innsight.operators import (
    benchmark, changepoint, decisions, intervention, market, spatial, units,
)
from tests.helpers import flat, series, step


def tables(mentions):
    cells = stage(units.unit_cells(units.review_units(mentions)), "cells")
    return cells, stage(units.monthly_sums(cells), "monthly")


def test_null_flags_nothing(spark):
    cells, monthly = tables(series(spark, {f"P{i}": flat(.6) for i in range(12)}, per_month=3))
    bench = benchmark.benchmark_vs_cluster(cells)
    assert {r["flag"] for r in bench.collect()} == {"on_par"}
    assert changepoint.detect_changepoints(monthly).count() == 0


def test_flags_and_intervals(spark):
    rates = {f"P{i}": flat(.6) for i in range(6)} | {"Low": flat(.2), "High": flat(.95)}
    cells, _ = tables(series(spark, rates, per_month=8))
    rows = {r["property_id"]: r for r in benchmark.benchmark_vs_cluster(cells).collect()}
    assert rows["Low"]["flag"] == "lag" and rows["High"]["flag"] == "lead"
    for r in rows.values():
        assert r["ci_low"] <= r["mean"] <= r["ci_high"]
    alone = benchmark.benchmark_vs_cluster(cells, "Low").first()
    assert alone == rows["Low"]  # the answer does not depend on who asks


def test_robust_error_matches_direct_sum(spark):
    data = [(i % 9, "A", "x", 1 if i % 3 else -1) for i in range(40)]
    df = spark.createDataFrame(data, "review_id int, property_id string, aspect string, "
                               "sentiment int").withColumn("date", F.lit("2024-01-02"))
    got = benchmark.profiles(units.unit_cells(units.review_units(df))).first()
    mean = sum(d[3] for d in data) / len(data)
    dev = sum((sum(d[3] - mean for d in data if d[0] == k)) ** 2 for k in range(9))
    assert abs(got["se"] - (9 / 8 * dev) ** .5 / len(data)) < 1e-12


def test_property_entering_is_no_decline(spark):
    old = series(spark, {p: flat(.5) for p in "ABCD"}, per_month=15)
    new = series(spark, {"E": flat(.9)}, per_month=45, months=12, first="2025-01-01")
    _, monthly = tables(old.unionByName(new))
    assert changepoint.detect_changepoints(monthly).count() == 0


def test_market_step_is_not_a_property_problem(spark):
    rates = {f"P{i}": step(.75, .35, 18) for i in range(6)}
    cells, monthly = tables(series(spark, rates, per_month=20, months=24))
    findings, people = market.market_findings(monthly)
    found = findings.collect()
    assert [(f["kind"], f["change_month"]) for f in found] == [("step", "2025-07")]
    assert changepoint.detect_changepoints(monthly).count() == 0
    scope = decisions.market_scope(monthly, changepoint.detect_changepoints(monthly), findings,
                                   people).first()
    assert scope["scope"] == "market-wide" and scope["n_properties"] == 6


def test_seasonal_dip(spark):
    def december(i):
        return .2 if i % 12 == 11 else .8
    _, monthly = tables(series(spark, {f"P{i}": december for i in range(6)}, months=24))
    findings, people = market.market_findings(monthly)
    assert [(f["kind"], f["calendar_month"]) for f in findings.collect()] == [("seasonal", 12)]
    assert market.seasonal_dips(people, 12).count() == 6
    assert market.seasonal_dips(people, 7).count() == 0


def test_lone_property(spark):
    lone = series(spark, {"A": step(.9, .1, 12)}, aspect="Spa")
    rest = series(spark, {p: flat(.6) for p in "ABCD"}, aspect="Food")
    _, monthly = tables(lone.unionByName(rest))
    found = changepoint.detect_changepoints(monthly).collect()
    assert [(r["aspect"], r["change_month"], r["market_delta"]) for r in found] == [
        ("Spa", "2025-01", None)]
    scopes = decisions.market_scope(monthly, changepoint.detect_changepoints(monthly),
                                    *market.market_findings(monthly)).collect()
    assert [(s["aspect"], s["scope"]) for s in scopes] == [("Spa", "undetermined")]


def monthly_rows(spark, n, s, ss, market=None):
    rows = [("x", f"2024-{i + 1:02d}-01", n[i], s[i], s[i], ss[i], 0.0) for i in range(len(n))]
    return spark.createDataFrame(
        rows, "name string, month string, n int, s double, rs double, rss double, mvar double"
    ).withColumn("month", F.col("month").cast("date"))


def test_zero_variance_step(spark):
    rows = monthly_rows(spark, [6] * 12, [6.0] * 6 + [-6.0] * 6, [6.0] * 12)
    best = changepoint.with_split_p(changepoint.best_split(rows, ["name"])).first()
    assert (str(best["month"]), best["delta"], best["p_value"]) == ("2024-07-01", -2.0, 0.0)
    short = monthly_rows(spark, [6] * 7, [6.0] * 7, [6.0] * 7)
    assert changepoint.best_split(short, ["name"]).count() == 0
    thin = monthly_rows(spark, [1] * 12, [1.0] * 12, [1.0] * 12)
    assert changepoint.best_split(thin, ["name"]).count() == 0


def check(spark, rates, start, per_month=15, months=24, **kw):
    _, monthly = tables(series(spark, rates, per_month=per_month, months=months))
    return intervention.intervention_check(monthly, "P0", "Food", start, **kw).first()


def test_real_fix(spark):
    rates = {"P0": step(.3, .8, 17)} | {f"P{i}": flat(.6) for i in range(1, 6)}
    got = check(spark, rates, "2025-06")
    assert got["verdict"] == "improved" and got["ci_low"] < 1.0 < got["ci_high"]
    assert (got["placebo_rank"], got["n_placebo"]) == (1, 5)


def test_market_wide_recovery_is_no_fix(spark):
    got = check(spark, {f"P{i}": step(.4, .7, 17) for i in range(6)}, "2025-06")
    assert got["verdict"] == "no detectable change"
    assert got["naive_delta"] > .4 and got["market_delta"] > .4


def test_fix_after_decline_and_early_change(spark):
    others = {f"P{i}": flat(.6) for i in range(1, 6)}
    def dip(i):
        return .2 if 12 <= i < 17 else .7
    got = check(spark, {"P0": dip} | others, "2025-06")
    assert got["verdict"] == "improved" and got["baseline_start"] == "2025-01"
    early = check(spark, {"P0": step(.8, .2, 17)} | others, "2025-08", baseline_start="2024-01")
    assert early["verdict"] == "worsened" and early["detected_start"] == "2025-06"
    assert "Caution" in early["summary"]


def test_little_data(spark):
    others = {f"P{i}": flat(.6) for i in range(1, 6)}
    late = check(spark, {"P0": flat(.6)} | others, "2025-12", per_month=5)
    assert late["verdict"] == "too early to tell" and late["effect"] is None
    two = check(spark, {"P0": step(.3, .8, 17), "P1": flat(.6)}, "2025-06")
    assert two["basis"] == "own history"
    assert two["market_delta"] is None and two["placebo_rank"] is None
    absent = check(spark, {"P1": flat(.6), "P2": flat(.5)}, "2025-06")
    assert absent["verdict"] == "no data" and absent["n_before"] == 0


POSITIONS = {p: (30.45 + (i % 4) * .02, 78.03 + (i // 4) * .03) for i, p in enumerate("ADFGIJKL")}
POSITIONS |= {p: (30.4557 + i * .0007, 78.0793) for i, p in enumerate("BCEH")}


def located(spark):
    return spark.createDataFrame([(p, *xy, None) for p, xy in POSITIONS.items()],
                                 "property_id string, lat double, lon double, zone string")


@functools.cache
def _declining(names):
    return {p: step(.8, .15, 14) if p in names else flat(.8) for p in POSITIONS}


def hood(spark, names):
    _, monthly = tables(series(spark, _declining(names), per_month=3, aspect="Location"))
    return spatial.neighbourhood_findings(monthly, located(spark), permutations=39)


def test_neighbourhood_found(spark):
    findings, members = hood(spark, "BCEH")
    row = findings.first()
    assert row["change_month"] in ("2025-02", "2025-03", "2025-04")
    assert sorted(r["property_id"] for r in members.collect()) == list("BCEH")


def test_scattered_decline_is_no_neighbourhood(spark):
    findings, _ = hood(spark, "ADGK")
    assert findings.count() == 0


def test_range_join_equals_all_pairs(spark):
    points = spark.range(60).select(
        F.concat(F.lit("P"), "id").alias("property_id"),
        (F.pmod(F.xxhash64("id"), F.lit(1000)) / 5000.0 + 60).alias("lat"),
        (179.9 + F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1000)) / 5000.0).alias("lon")
    ).withColumn("lon", F.when(F.col("lon") > 180, F.col("lon") - 360).otherwise(F.col("lon")))
    from innsight.functions.geo import haversine_km
    got = spatial.neighbours(points, 2.0).select("property_id", "other_id")
    a, b = points.alias("a"), points.alias("b")
    brute = a.join(b, haversine_km(F.col("a.lat"), F.col("a.lon"), F.col("b.lat"),
                                   F.col("b.lon")) <= 2.0).select("a.property_id", "b.property_id")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, brute.collect()))
    nearest = spatial.nearest_others(points, 2).count()
    assert nearest == 120


def test_nearest_with_remote_properties(spark):
    from innsight.functions.geo import haversine_km
    crowd = [(f"P{i:02d}", 60 + i % 7 * .001, 10 + i // 7 * .001) for i in range(40)]
    points = spark.createDataFrame([*crowd, ("Q1", -70.0, -170.0), ("Q2", 5.0, 100.0)],
                                   "property_id string, lat double, lon double")
    got = {}
    for r in spatial.nearest_others(points, 3).orderBy("property_id", "rank").collect():
        got.setdefault(r["property_id"], []).append(r["other_id"])
    a, b = points.alias("a"), points.alias("b")
    km = haversine_km(F.col("a.lat"), F.col("a.lon"), F.col("b.lat"), F.col("b.lon"))
    plain = {}
    for r in a.join(b, F.col("a.property_id") != F.col("b.property_id")).select(
            F.col("a.property_id").alias("p"), F.col("b.property_id").alias("o"),
            km.alias("km")).orderBy("p", "km", "o").collect():
        plain.setdefault(r["p"], []).append(r["o"])
    assert got == {p: others[:3] for p, others in plain.items()}
    pair = points.where("property_id like 'Q%'")
    assert spatial.nearest_others(pair, 3).count() == 2
    assert spatial.nearest_others(pair.limit(1), 3).count() == 0
    assert spatial.nearest_others(points.limit(0), 3).count() == 0


def test_windows_from_running_sums(spark):
    """Every window read from the running sums equals the sums over its own months."""
    import datetime
    from innsight.operators.changepoint import side_sums
    months = [datetime.date(2019 + i // 12, i % 12 + 1, 1) for i in range(0, 24)]
    rows = [(p, a, m, 1 + (i * k) % 5, .25 * ((i + k) % 7 - 3), .5 * (i % 3), .125 * (i % 4), .01 * k)
            for k, (p, a) in enumerate([("P1", "Food"), ("P2", "Food"), ("P3", "Room")], 1)
            for i, m in enumerate(months) if 3 * k <= i < 22 - k and (i + k) % 4]
    adjusted = spark.createDataFrame(rows, "property_id string, aspect string, month date, n bigint, "
                                     "rs double, s double, rss double, mvar double")
    edges = [datetime.date(2018, 12, 1), *months[::3], datetime.date(2022, 5, 1)]
    windows = spark.createDataFrame([("X", a, s, b) for a in ("Food", "Room", "Gone") for s in edges
                                     for b in edges], "property_id string, aspect string, start date, baseline date")
    keys = ["property_id", "aspect", "start", "baseline"]
    plain = side_sums(adjusted.join(windows.drop("property_id"), "aspect").where("month >= baseline"),
                      keys, F.col("month") >= F.col("start"))
    got = {tuple(r[k] for k in keys): r for r in intervention.shifts_for(adjusted, windows).collect()}
    want = {tuple(r[k] for k in keys): r for r in plain.collect()}
    assert got.keys() == want.keys() and len(got) > 100
    for key, row in want.items():
        for name in plain.columns[4:]:
            assert got[key][name] == row[name] or abs(got[key][name] - row[name]) < 1e-12, (key, name)


def test_phrases(spark):
    from innsight import config
    from innsight.functions.frames import phrase
    row = spark.range(1).select(phrase("{a} of {b}: {a}", a=F.lit(3), b=F.lit("x")).alias("t"),
                                phrase("plain").alias("p"),
                                phrase("{a}.", a=F.lit(None).cast("int")).alias("n")).first()
    assert (row["t"], row["p"], row["n"]) == ("3 of x: 3", "plain", None)
    assert all(len(v) > 10 for v in config.CHECK_SENTENCES.values())


def test_priorities_and_owner(spark):
    rates = {f"P{i}": flat(.7) for i in range(6)} | {"P0": step(.8, .2, 15)}
    mentions = series(spark, rates)
    cells, monthly = tables(mentions)
    got = decisions.priority_actions(units.mention_months(mentions), cells, monthly).collect()
    assert [(r["property_id"], r["started"], r["whose_problem"]) for r in got] == [
        ("P0", "2025-04", "yours alone")]
    assert got[0]["volume"] == 1.0 and got[0]["gap"] > .5


def test_shared_dip_is_everyones(spark):
    def december(i):
        return .05 if i % 12 == 11 else .7
    rates = {f"P{i}": december for i in range(5)}
    mentions = series(spark, rates, per_month=10)
    heavy = series(spark, {"P9": december}, per_month=10).unionByName(
        series(spark, {"P9": lambda i: .02}, per_month=1, seed=3).where(
            F.month("date") == 12).withColumn("review_id", F.concat("review_id", F.lit("b"))))
    cells, monthly = tables(mentions.unionByName(heavy))
    shared = decisions.shared_patterns(*market.market_findings(monthly))
    tested = stage(benchmark.tested_profiles(cells), "tested")
    again = decisions.retest_without_patterns(cells, shared, tested).collect()
    assert {r["variant"] for r in again} == {"12"}
    assert all(r["new_flag"] == "on_par" for r in again)


def test_many_clusters_equal_single_runs(spark):
    one = series(spark, {f"P{i}": step(.8, .2, 12) if i == 0 else flat(.7) for i in range(5)})
    two = series(spark, {f"P{i}": flat(.6) for i in range(4)}, seed=5)
    both = one.withColumn("cluster_id", F.lit("a")).unionByName(
        two.withColumn("cluster_id", F.lit("b")))
    many = changepoint.detect_changepoints(tables(both)[1])
    single = changepoint.detect_changepoints(tables(one)[1])
    kept = many.where("cluster_id = 'a'").drop("cluster_id")
    assert sorted(map(str, kept.collect())) == sorted(map(str, single.collect()))
    assert many.where("cluster_id = 'b'").count() == 0
