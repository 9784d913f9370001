"""Parsing, filling and binning rules, and match keys."""

import datetime

import pytest
from pyspark.sql import functions as F

from obsexp.functions import columns as C
from obsexp.functions.names import normalise_key
from obsexp.operators import cleaning as cl
from obsexp.operators.models import FeaturePipeline


def one(spark, rows, schema, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*cols).collect()]


def test_fill_rule_boundary(spark):
    filled, off = C.fill_from("shot", "game", 24.0)
    rows = one(spark, [(10.0, 300.0), (None, 12.0), (None, 24.0), (None, 90.0), (None, None)], "shot double, game double",
               filled, off)
    assert rows == [(10.0, False), (12.0, True), (24.0, True), (None, False), (None, False)]


def event_row(**over):
    row = {"MATCHUP": "MAR 04, 2015 - CHA @ BKN", "LOCATION": "A", "GAME_CLOCK": "0:14", "SHOT_CLOCK": None, "TOUCH_TIME": -5.0,
           "SHOT_DIST": 10.0, "SHOT_RESULT": "made", "player_name": "x"}
    return {**row, **over}


EVENT_SCHEMA = ("MATCHUP string, LOCATION string, GAME_CLOCK string, SHOT_CLOCK double, TOUCH_TIME double, SHOT_DIST double, "
                "SHOT_RESULT string, player_name string")


def events(spark, rows):
    names = [f.split()[0] for f in EVENT_SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], EVENT_SCHEMA)


def test_feature_frame_applies_corrections(spark):
    row = cl.derive_features(events(spark, [event_row()])).first()
    assert row.SHOT_CLOCK == 14.0 and row.SHOT_CLOCK_OFF == "clock_off" and row.LATE_CLOCK == "normal_clock"
    assert row.TOUCH_TIME is None and row.TOUCH_TIME_BUCKET is None
    assert row.event_date == datetime.date(2015, 3, 4)
    assert (row.actor_team, row.opponent_team, row.made, row.SHOT_DIST_ZONE) == ("CHA", "BKN", 1, "short_midrange")


def test_feature_frame_is_one_stage(spark):
    plan = cl.derive_features(events(spark, [event_row()]))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_modelling_frame_drops_rows_without_outcome_or_entity(spark):
    rows = [event_row(), event_row(SHOT_RESULT=None), event_row(player_name=None)]
    assert cl.modelling_frame(events(spark, rows)).count() == 1


@pytest.mark.parametrize("text, expected", [
    ("MAR 04, 2015 - CHA @ BKN", ("CHA", "BKN")), ("MAR 02, 2015 - CHA vs. LAL", ("CHA", "LAL")),
    ("garbage", (None, None)), (None, (None, None))])
def test_matchup_names_the_actor_first(spark, text, expected):
    cols = C.extract_groups("m", cl.MATCHUP_PATTERN, ["a", "b"])
    assert one(spark, [(text,)], "m string", *cols) == [expected]


def test_bins_close_where_they_should(spark):
    zone = C.bin_column("v", cl.ZONE_EDGES, cl.ZONE_LABELS)
    touch = C.bin_column("v", cl.TOUCH_EDGES, cl.TOUCH_LABELS)
    rows = one(spark, [(4.0,), (14.0,), (23.75,), (23.76,), (None,)], "v double", zone)
    assert [r[0] for r in rows] == ["at_rim", "short_midrange", "long_midrange", "three_plus", None]
    assert [r[0] for r in one(spark, [(2.0,), (6.0,), (6.1,)], "v double", touch)] == ["quick", "balanced", "hold"]
    lowest = C.bin_column("v", (0, 2, 4), ("a", "b"), include_lowest=True)
    left = C.bin_column("v", (0, 2, 4), ("a", "b"), closed="left")
    rows = one(spark, [(0.0,), (2.0,), (4.0,), (4.1,)], "v double", lowest, left)
    assert rows == [("a", "a"), ("a", "b"), ("b", None), (None, None)]
    with pytest.raises(ValueError):
        C.bin_column("v", (0, 1), ("a", "b"))


def test_clocks(spark):
    rows = one(spark, [("11:22", "PT11M22.00S"), (None, None), ("bad", "11:22"), ("0:04", "PT00M04.50S")], "a string, b string",
               C.clock_seconds("a"), C.clock_seconds("b", "iso"))
    assert rows == [(682.0, 682.0), (None, None), (None, None), (4.0, 4.5)]


def test_match_keys(spark):
    cases = {"Dirk Nowtizski": "dirk nowitzki", "Tim Hardaway Jr.": "tim hardaway", "Ömer Aşık": "omer asik",
             "C.J. McCollum": "cj mccollum", "Dwyane Wade": "dwyane wade", "dwayne wade": "dwyane wade",
             "D`Angelo O'Neal-Straße III": "dangelo oneal strasse"}
    for any_script in (False, True):
        out = one(spark, [(k,) for k in cases], "n string", normalise_key("n", any_script=any_script))
        assert [o[0] for o in out] == list(cases.values())
    assert one(spark, [(None,)], "n string", normalise_key("n")) == [(None,)]


def test_nearest_anchor_and_points(spark):
    near = C.nearest_anchor("x", "y", ((5.25, 25.0), (88.75, 25.0)))
    rows = one(spark, [(20.0, 25.0), (88.75, 20.0)], "x double, y double", near["distance"], near["depth"], near["lateral"])
    assert rows == [(14.75, 14.75, 0.0), (5.0, 0.0, 5.0)]
    assert one(spark, [(1, 1), (1, 0), (0, 1)], "m int, t int", C.points_for("m", "t")) == [(3,), (2,), (0,)]


def test_nan_is_missing_and_bounds_drop_missing(spark):
    df = cl.nan_to_null(spark.createDataFrame([(1.0, 1), (float("nan"), 2), (50.0, 3), (None, 4)], "d double, i int"))
    kept = cl.harmonise(df, {"distance": ("d", "double"), "i": ("i", "int")}, {"distance": 47.0})
    assert [r.i for r in kept.collect()] == [1]
    assert df.agg(F.avg("d")).first()[0] == 25.5


def test_outcomes_are_never_features():
    assert not set(cl.OUTCOME_COLUMNS) & {*cl.NUMERIC_FEATURES, *cl.CATEGORICAL_FEATURES}
    with pytest.raises(ValueError, match="FINAL_MARGIN"):
        FeaturePipeline(["SHOT_DIST", "FINAL_MARGIN"], [])
