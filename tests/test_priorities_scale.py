"""F15 of round 3: one pass over the mentions, and no score for a draw that can't count."""

import datetime as dt

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from innsight.functions.frames import stage
from innsight.operators import spatial, units
from innsight.plans import registry
from tests.test_analytics import POSITIONS, _declining, located, series, tables

SCHEMA = "review_id long, property_id string, date date, aspect string, sentiment int"


def _rows(mixed):
    day = dt.date
    rows = [(r, f"P{r % 3}", day(2024, 1 + r % 5, 1 + k), "Food", (r + k) % 3 - 1)
            for r in range(40) for k in range(1 + r % 3)]
    rows += [(None, "P0", day(2024, 1 + k, 3), "Food", -1) for k in range(4)]
    rows += [(None, "P0", None, "Food", 1), (90, "P1", None, "Food", -1), (91, "P1", day(2024, 2, 1), "Food", None),
             (92, None, day(2024, 2, 1), "Food", 1), (93, "P1", day(2024, 2, 1), None, 1), (94, "P2", day(2024, 2, 9), "Food", -1)]
    rows += rows[:5]
    if mixed:
        rows += [(95, "P2", day(2024, 3, 9), "Food", -1), (95, "P2", day(2024, 4, 9), "Food", 1), (94, "P2", None, "Food", 1)]
    return rows


def _same(got, want):
    got = got.select(*want.columns)
    assert got.dtypes == want.dtypes
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_tallies_give_cells_and_mention_months(spark):
    for mixed in (False, True):
        mentions = spark.createDataFrame(_rows(mixed), SCHEMA)
        tallies = stage(units.unit_tallies(mentions), "tallies")
        assert tallies.where("mixed").isEmpty() != mixed
        _same(units.tallied_cells(tallies), units.unit_cells(units.review_units(mentions)))
        _same(units.tallied_months(tallies, mentions), units.mention_months(mentions))


def test_decision_inputs_read_the_mentions_once(spark, monkeypatch):
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    mentions = spark.createDataFrame(_rows(False), SCHEMA)
    counted = mentions.mapInArrow(count, StructType(mentions.schema.fields))
    monkeypatch.setattr(registry, "planted", lambda *_: counted)
    cells, _, months, _ = registry._decision_inputs(spark, "", with_hoods=False)
    assert cells.count() and months.count()
    assert read.value == len(_rows(False))


def test_units_are_counted_after_the_shuffle(spark):
    mentions = spark.createDataFrame(_rows(False), SCHEMA)
    plan = units.review_units(mentions)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.rindex("HashAggregate") < plan.index("Exchange")


def _scan_inputs(spark):
    _, monthly = tables(series(spark, _declining("BCEH"), per_month=3, aspect="Location"))
    here = spatial.located(monthly, located(spark))
    groups = stage(spatial.candidate_groups(here), "groups")
    # beside the real places, every window of four properties: many decline, few robustly
    names = sorted(POSITIONS)
    sets = [(f"W{i}", p) for i in range(len(names)) for p in (names * 2)[i:i + 4]]
    members = groups.select(F.col("group_id").alias("set_id"), "property_id").unionByName(
        spark.createDataFrame(sets, "set_id string, property_id string"))
    return stage(members, "members"), stage(spatial.centred_sums(monthly), "centred")


def test_a_floor_loses_no_score_that_reaches_it(spark):
    members, centred = _scan_inputs(spark)
    every = {(r["set_id"], r["aspect"]): r["score"] for r in spatial.robust_scores(members, centred).collect()}
    for level in (min(every.values()), max(every.values())):
        floor = spark.createDataFrame([(level,)], "floor double")
        got = {(r["set_id"], r["aspect"]): r["score"] for r in spatial.robust_scores(members, centred, floor).collect()}
        assert {k for k, v in got.items() if v >= level * (1 - 1e-9)} == {k for k, v in every.items() if v >= level * (1 - 1e-9)}
        assert all(abs(got[k] - every[k]) < 1e-9 for k in got)


def test_sets_below_the_floor_are_tried_once(spark, monkeypatch):
    members, centred = _scan_inputs(spark)
    tried, scores = [], spatial.left_out_scores

    def counted(left_out, *rest):
        tried.append(left_out.count())
        return scores(left_out, *rest)

    monkeypatch.setattr(spatial, "left_out_scores", counted)
    spatial.robust_scores(members, centred).count()
    spatial.robust_scores(members, centred, spark.createDataFrame([(1e9,)], "floor double")).count()
    assert tried[1] < tried[0] and tried[2] == 0
