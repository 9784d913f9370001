"""Steps that a larger table, or one stored otherwise, brought to fail."""

import glob
import os
import threading
import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from obsexp.llm import common, near_dedup, shingles
from obsexp.operators import crossfit, frames, models, multinomial, profiles, resampling
from obsexp.plans import extraction, registry
from obsexp.plans.q_frames import write_documents
from obsexp.plans.registry import QUERIES
from obsexp.session import scratch_path
from obsexp.sources.readers import read_frames
from obsexp.streaming import jobs


def test_documents_leave_no_file_of_no_length(spark, small):
    """The only row group of the table lies in a later split, so the first task of a plain scan has no rows."""
    names = {"spark.sql.files.maxPartitionBytes": "2000", "spark.sql.files.openCostInBytes": "0"}
    before = {name: spark.conf.get(name) for name in names}
    try:
        for name, value in names.items():
            spark.conf.set(name, value)
        path = write_documents(spark, small)
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    sizes = [os.path.getsize(f) for f in glob.glob(f"{path}/*.txt")]
    assert sizes and min(sizes) > 0
    assert spark.read.text(path).count() == spark.read.parquet(f"{small}/events.parquet").count()


def test_claims_of_many_games_take_no_state_key_each(spark):
    """Two events of each game compete for its best frame: the later one gets the other, in one batch or over two."""
    root = scratch_path(spark, "t-many-claims")
    games, place = 3000, F.explode(F.array(*[F.struct(F.lit(e).alias("e"), F.lit(p).alias("p")) for e in (0, 1) for p in (10, 200)]))
    rows = spark.range(games).select(F.col("id").alias("game"), place.alias("x")).select(
        F.col("game").cast("string").alias("game_id"), F.lit(1).alias("period"), F.lit(7).cast("long").alias("actor_id"),
        (F.col("game") * 2 + F.col("x.e")).alias("event_id"), (100.0 - F.col("x.e")).alias("event_clock"),
        F.col("x.p").cast("long").alias("pos"), (100.0 - F.col("x.p") / 100).alias("clock"),
        (9.0 - F.col("x.p") / 100).alias("ball_z"), F.lit(1.0).alias("ball_distance"))
    rows.where("event_clock = 100").coalesce(1).write.mode("append").parquet(f"{root}/in")
    schema = spark.read.parquet(f"{root}/in").schema

    def run(times):
        for _ in range(times):
            claimed = jobs.claim_stream(jobs.read_stream(spark, f"{root}/in", schema), buckets=64)
            jobs.run_to_end(claimed, f"{root}/out", f"{root}/check")
        return {r.event_id: r.pos for r in spark.read.parquet(f"{root}/out").collect()}

    assert run(1) == {2 * g: 10 for g in range(games)}
    rows.coalesce(1).write.mode("append").parquet(f"{root}/in")  # the first event once more, and the second
    assert run(2) == {2 * g + e: (10, 200)[e] for g in range(games) for e in (0, 1)}
    assert spark.read.format("statestore").load(f"{root}/check").count() <= 64


def test_a_component_is_not_compared_with_itself(monkeypatch):
    """Of 300 members in one part and two outside, only the two are looked up, and their link is found from both sides."""
    calls = []
    whole = near_dedup._meet
    monkeypatch.setattr(near_dedup, "_meet", lambda left, right, *rest: (calls.append(len(left) * len(right)), whole(left, right, *rest)))
    hashes = shingles.WordHashes()
    words = [f"w{i}".encode() for i in range(40)]
    sets = [shingles.shingle_counts([*words, b"x%d" % i], hashes) for i in range(301)]
    sets.append(shingles.shingle_counts([b"apart"] * 9, hashes))
    rid, part = np.arange(302), np.array([0] * 300 + [300, 301])
    sides = np.zeros(302, bool), np.arange(302) >= 150
    for side in sides:
        calls.clear()
        edges = near_dedup.compare(rid, part, side, sets, 0.8)
        assert len(edges) == 1 and 300 in edges[0]
        assert sum(calls) <= 2 * 302


def test_components_of_stars_take_no_round(spark, monkeypatch):
    edges = spark.createDataFrame([(i, i % 3) for i in range(3, 30)], "u long, v long")
    labels = []
    kept = common.materialise
    monkeypatch.setattr(common, "materialise", lambda df, label: (labels.append(label), kept(df, label))[1])
    found = {r.node: r.component for r in common.components(edges).collect()}
    assert found == {i: i % 3 for i in range(30)}
    assert labels == ["edges"]


def test_neighbours_read_parsed_frames(spark, small):
    """Distances are taken from stored entities: none of their uses reads the document again."""
    plan = QUERIES["nearest_at_frame"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert "variant" not in plan.lower()


def test_tree_fits_deal_their_rows_by_number(spark, monkeypatch):
    """One file split of 5,000 rows goes to tasks of some 1,000 rows each, and none is lost."""
    held = []

    class Recorded(models.Pipeline):
        def fit(self, dataset, params=None):
            held.extend(dataset.groupBy(F.spark_partition_id()).count().toPandas()["count"])
            return super().fit(dataset, params)

    monkeypatch.setattr(models, "Pipeline", Recorded)
    monkeypatch.setattr(models, "ROWS_PER_TASK", 1000)
    table = spark.range(0, 5000, 1, 1).select(
        (F.col("id") % 97).cast("double").alias("x"), (F.col("id") % 3).cast("string").alias("c"),
        F.expr("int(id % 97 > 50)").alias("made"), F.col("id"))
    model = models.fit_boosted(table, "made", ["x"], ["c"], max_iter=2, step_size=0.3)
    assert sum(held) == 5000 and max(held) <= 1000
    assert model.score(table).where((F.col("expected") > 0.5) == (F.col("made") == 1)).count() == 5000


def test_fits_of_all_folds_deal_their_rows_by_number(spark, monkeypatch):
    """The stored folds lie in one file each; no fit on the others holds more than some 1,000 rows in a task.

    What is dealt are finished features, so that no pass of the trees computes them again.
    """
    held, columns = [], []

    class Recorded(models.Pipeline):
        def fit(self, dataset, params=None):
            columns.append(dataset.columns)
            held.append(dataset.groupBy(F.spark_partition_id()).count().toPandas()["count"])
            return super().fit(dataset, params)

    monkeypatch.setattr(models, "Pipeline", Recorded)
    monkeypatch.setattr(models, "ROWS_PER_TASK", 1000)
    table = spark.range(0, 12000, 1, 1).select("id", (F.col("id") % 97).cast("double").alias("x"), (F.col("id") % 3).cast(
        "string").alias("c"), F.expr("int(id % 97 > 50)").alias("made"), F.expr("int(id % 2)").alias("fold"))
    scored = models.cross_fit(table, lambda t: models.fit_boosted(t, "made", ["x"], ["c"], max_iter=2, step_size=0.3), k=2)
    assert [sum(h) for h in held] == [6000, 6000] and max(max(h) for h in held) <= 1000
    assert columns == [["label", "features"]] * 2
    assert scored.where((F.col("expected") > 0.5) == (F.col("made") == 1)).count() == 12000


def peak(run) -> int:
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_poisson_draws_go_in_small_pieces():
    """Draws are looked at a million at a time, and counts by comparison equal those of the limits."""
    row, table = np.arange(1, 4001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), resampling._weight_table()
    x = np.sin(np.arange(4000))
    assert peak(lambda: resampling._poisson_sums(x, row, 2000, table)) < 16e6
    sums, counts = np.zeros(40), np.zeros(40)
    for value, word in zip(x, row):
        for q in range(10):
            h = resampling._mix(np.array([word]) ^ resampling._mix(np.array([q + 1], np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
            for j, prefix in enumerate(h.view(np.uint16)):
                more = resampling._mix(h ^ resampling._mix(np.array([j + 1], np.uint64)))[0] >> np.uint64(32)
                w = np.searchsorted(resampling._LIMITS, (np.uint64(prefix) << np.uint64(32)) | more, side="right")
                sums[4 * q + j] += value * w
                counts[4 * q + j] += w
    got = resampling._poisson_sums(x, row, 40, table)
    np.testing.assert_allclose(got[0], sums, atol=1e-9)
    assert got[1].tolist() == counts.tolist()


def test_exact_draws_go_in_small_pieces():
    draws = np.full(2000, 1000, np.int64)
    assert peak(lambda: multinomial.leaf_sums(np.arange(1000.0), draws, 3, 0)) < 16e6


def test_starts_of_clusters_run_side_by_side(spark, monkeypatch):
    """Every start waits for the others, and the passes go over profiles dealt by their number."""
    parts, meet = [], threading.Barrier(4, timeout=60)

    class Waiting(profiles.KMeans):
        def fit(self, dataset, params=None):
            parts.append(dataset.rdd.getNumPartitions())
            meet.wait()
            return super().fit(dataset, params)

    monkeypatch.setattr(profiles, "KMeans", Waiting)
    monkeypatch.setattr(profiles, "ROWS_PER_TASK", 40, raising=False)
    df = spark.range(0, 200, 1, 1).select("id", (F.col("id") % 2 * 50 + F.col("id") % 5).cast("double").alias("x"))
    found = profiles.cluster_profiles(df, ["x"], k=2, starts=4).collect()
    assert parts == [5] * 4
    assert len(found) == 200 and len({(r.id % 2, r.cluster) for r in found}) == 2


def test_logistic_folds_share_a_handful_of_passes(spark, monkeypatch):
    """Few coefficients need no optimiser that holds unpacked rows, and the table is gone over a few times for all folds."""
    passes, whole = [], crossfit._sums
    monkeypatch.setattr(crossfit, "_sums", lambda *args: (passes.append(1), whole(*args))[1])
    monkeypatch.setattr(crossfit, "LogisticRegression", None)
    table = spark.range(4000).select(
        "id", (F.col("id") % 5).cast("int").alias("fold"), (F.col("id") % 83).cast("double").alias("x"),
        (F.col("id") % 3).cast("string").alias("c"), F.expr("int(id % 83 + 7 * (id % 3) > 20 + id % 47)").alias("made"))
    scored = crossfit.cross_fit_logistic(table, "made", ["x"], ["c"]).toPandas()
    assert len(scored) == 4000 and 0 < len(passes) <= 10
    for _, part in scored.groupby(scored["fold"]):  # each fold is scored by the fit on the others
        assert abs((part["made"] - part["expected"]).mean()) < 0.05
    # At the optimum the residuals of the training rows sum to zero.
    model = models.fit_logistic(table, "made", ["x"], ["c"])
    assert abs(model.score(table).agg(F.sum(F.col("made") - F.col("expected"))).first()[0]) < 1e-5


def test_entities_are_read_out_of_a_document_once(spark, small):
    plan = read_frames(spark, write_documents(spark, small), False)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("$[5]") == 1


def test_extraction_stores_what_events_ask_for(spark, small, monkeypatch):
    """Documents are read and repeats dropped for one stored table; contacts are those of asking actors in their games."""
    stored, whole = {}, extraction.materialise
    monkeypatch.setattr(extraction, "materialise", lambda df, label: stored.setdefault(label, whole(df, label)))
    found = QUERIES["extract_events"](spark, small).count()
    events = spark.read.parquet(f"{small}/events.parquet").select(
        "event_type", F.concat_ws("-", "user_id", F.to_date("ts").cast("string")).alias("game_id"))
    asking = events.where("event_type = 'purchase'").select("game_id").distinct()
    asked = events.join(asking, "game_id", "left_semi").count()
    assert stored["parsed"].count() == events.count() > asked
    assert stored["frames"].count() == stored["contacts"].count() == asked
    assert 0 < found <= events.where("event_type = 'purchase'").count()


def test_frames_of_small_and_of_large_periods_get_the_same_numbers(spark):
    """Periods above the limit go chunk by chunk, the others by one window each."""
    table = spark.range(3000).select(
        F.when(F.col("id") % 3 > 0, F.lit("a")).otherwise("b").alias("game_id"), F.expr("if(id % 7 < 6, int(id % 2), null)").alias("period"),
        F.expr("if(id % 11 > 0, double(id % 100), null)").alias("clock"), F.col("id").alias("event_idx"), F.lit(0).alias("moment_idx"))
    plans = [frames.number_frames(table, window_rows=n) for n in (3000, 10)]
    small, large = ({r.event_idx: (r.game_id, r.period, r.clock, r.pos) for r in p.collect()} for p in plans)
    assert small == large and len(small) == 3000
    assert plans[0].schema["pos"].dataType == plans[1].schema["pos"].dataType
    assert [p._jdf.queryExecution().optimizedPlan().toString().count("Join") for p in plans] == [0, 1]


def test_a_model_of_early_years_takes_a_handful_of_passes(spark, small, monkeypatch):
    """Its fit goes over the rows a few times, without an optimiser that holds them, and its early gap is none."""
    passes, whole = [], crossfit._sums
    monkeypatch.setattr(crossfit, "_sums", lambda *args: (passes.append(1), whole(*args))[1])
    monkeypatch.setattr(crossfit, "LogisticRegression", None)
    found = {r.period: r for r in QUERIES["score_with"](spark, small).collect()}
    assert abs(found["early"].gap) < 1e-6 and 0 < len(passes) <= 10


def test_board_and_halves_of_the_test_table_share_their_scores(spark, small, monkeypatch):
    scored, whole = [], registry.score_by_cells
    monkeypatch.setattr(registry, "score_by_cells", lambda *args, **named: (scored.append(1), whole(*args, **named))[1])
    assert QUERIES["test_table"](spark, small).count() == 2
    assert len(scored) == 1
