"""Frame documents to derived event rows."""

import json

import pytest
from pyspark.sql import functions as F

from obsexp.operators import frames as fr
from obsexp.plans.extraction import extract_events
from obsexp.session import scratch_path
from obsexp.sources.readers import read_frames
from obsexp.sources import ledger as lg

SHOOTER, PARTNER, GUARD, HELPER, BALL = 31, 32, 62, 63, -1
# Where everybody stands: the shooter is 15 feet from the near hoop, the two opponents 3 and 5 feet from the shooter.
PLACES = ((5, SHOOTER, 17.25, 34.0), (5, PARTNER, 40.0, 10.0), (8, GUARD, 17.25, 37.0), (8, HELPER, 22.25, 34.0))
# Clock, ball height, ball distance from the shooter. One bounce, then the ball rises and leaves after the seventh row.
EARLY = ((64.40, 3.0, 2.2), (64.35, 2.0, 1.9), (64.30, 3.5, 1.5), (64.25, 5.0, 1.0), (64.20, 6.5, 0.4), (64.15, 7.75, 0.6),
         (64.10, 8.25, 1.1), (64.05, 9.5, 4.0), (64.00, 10.0, 8.0))
LATE = ((60.95, 4.5, 0.3), (60.90, 6.0, 0.5), (60.85, 7.5, 0.9), (60.80, 9.25, 5.0))


def document_frames(table, first_ts):
    return [[1, first_ts + 50 * i, clock, 11.0, None,
             [[-1, BALL, PLACES[0][2] + away, PLACES[0][3], height], *[[team, who, x, y, 0.0] for team, who, x, y in PLACES]]]
            for i, (clock, height, away) in enumerate(table)]


def stored(spark, document, tmp):
    path = tmp / "game.json"
    path.write_text(json.dumps(document))
    return read_frames(spark, str(path))


PBP = ("event_num int, game_id string, period int, player_id long, player_name string, made int, is_3pt int, "
       "reported_distance double, clock_s double")


def pbp(spark, *rows):
    return spark.createDataFrame([(n, "g", 1, SHOOTER, "Test", n % 2, 0, float(d), c) for n, d, c in rows], PBP)


def game(*events):
    return {"gameid": "g", "gamedate": "d", "events": [{"eventId": str(i), "moments": m} for i, m in enumerate(events)]}


def test_highest_ball_in_reach_is_the_release(spark, tmp_path):
    frames = stored(spark, game(document_frames(EARLY, 500)), tmp_path)
    assert frames.count() == len(EARLY)
    row = extract_events(frames, pbp(spark, (4, 16, 64.2))).first()
    assert (row.ball_height_ft, row.release_confidence, row.game_clock) == (8.25, "high", 64.10)
    assert (row.shot_dist_ft, row.closest_def_dist_ft, row.second_def_dist_ft, row.n_defenders_within_6ft) == (15.0, 3.0, 5.0, 2)
    assert (row.touch_time_s, row.dribbles) == (0.3, 1)


def test_a_claimed_stretch_is_not_used_again(spark, tmp_path):
    frames = stored(spark, game(document_frames(EARLY, 500)), tmp_path)
    assert [r.event_num for r in extract_events(frames, pbp(spark, (4, 16, 64.2), (9, 16, 64.2))).collect()] == [4]


def test_later_event_takes_the_later_stretch_and_a_far_report_lowers_it(spark, tmp_path):
    early, late = document_frames(EARLY, 500), document_frames(LATE, 4000)
    frames = stored(spark, game(early + late, early, []), tmp_path)  # the second event repeats timestamps of the first
    assert fr.dedup_frames(frames).count() == len(EARLY) + len(LATE)
    asked = pbp(spark, (8, 26, 60.9), (3, 16, 64.3))
    out = {r.event_num: r for r in extract_events(frames, asked, store=True).collect()}
    assert [(out[n].game_clock, out[n].ball_height_ft) for n in (3, 8)] == [(64.10, 8.25), (60.85, 7.5)]
    assert [(out[n].release_confidence, out[n].dist_error_ft) for n in (3, 8)] == [("high", 1.0), ("low", 11.0)]


def test_frames_without_actor_or_clock_are_no_candidates(spark, tmp_path):
    frames = document_frames(EARLY, 500)
    frames[3][5] = frames[3][5][:1]        # nobody on the floor: breaks the contact run
    frames[6][2] = None                    # the highest ball in reach has no clock
    out = extract_events(stored(spark, game(frames), tmp_path), pbp(spark, (4, 16, 64.2))).first()
    assert (out.ball_height_ft, out.touch_time_s, out.dribbles) == (7.75, 0.05, 0)


def test_contact_run_counts_bounces_inside_the_run(spark):
    heights = [5.0, 3.0, 1.0, 1.0, 3.5, 2.0, 5.0, 9.0, 1.0]
    held = [True, True, True, True, True, True, True, False, True]
    rows = spark.createDataFrame([(1, i, i * 100, h, b) for i, (h, b) in enumerate(zip(heights, held))],
                                 "k int, i int, ts long, h double, b boolean").withColumn("chunk", F.floor(F.col("i") / 2))
    runs = fr.contact_runs(rows, ["k"], "chunk", ["i"], F.col("b"), "h", "ts").orderBy("i").collect()
    assert [r.run_rows for r in runs] == [1, 2, 3, 4, 5, 6, 7, 0, 1]
    assert [r.run_span for r in runs] == [0, 100, 200, 300, 400, 500, 600, 0, 0]
    assert [r.run_minima for r in runs] == [0, 0, 0, 1, 1, 1, 2, 0, 0]


def loop_runs(rows, gaps):
    """Runs of one key as a loop over (order, position, held, height, ts)."""
    follows = lambda b, a: b[2] and a[2] and (not gaps or b[1] - a[1] == 1)
    out, start = {}, None
    for i, r in enumerate(rows):
        if not r[2]:
            out[r[0]] = (0, 0, 0)
            continue
        if not i or not follows(r, rows[i - 1]):
            start = i
        lows = sum(1 for j in range(start + 1, i) if None not in (rows[j - 1][3], rows[j][3], rows[j + 1][3])
                   and rows[j][3] < rows[j - 1][3] and rows[j][3] <= rows[j + 1][3] and rows[j][3] < 4.0)
        out[r[0]] = (i - start + 1, abs(r[4] - rows[start][4]) if i > start else 0, lows if i > start else 0)
    return out


def test_contact_runs_over_chunks_of_any_size_equal_the_loop(spark):
    import random
    rng = random.Random(8)
    table, want = [], {}
    for key in [None, *range(30)]:
        length, size, place, chunk, rows = rng.randint(1, 60), rng.choice([1, 2, 3, 7, 100]), 0, 0, []
        for i in range(length):
            place += rng.choice([1, 1, 1, 1, 2])
            chunk += rng.random() < 1 / size
            rows.append((1000 * (key if key is not None else 99) + i, place, rng.random() < 0.85,
                         rng.choice([None, 1.0, 2.0, 2.0, 3.0, 3.5, 5.0]) if rng.random() < 0.9 else 6.0, 40 * place))
            table.append((key, chunk, *rows[-1]))
        for gaps in (False, True):
            want.update({(gaps, i): v for i, v in loop_runs(rows, gaps).items()})
    df = spark.createDataFrame(table, "k int, chunk int, i long, pos long, held boolean, h double, ts long")
    for gaps in (False, True):
        got = fr.contact_runs(df, ["k"], "chunk", ["i"], F.col("held"), "h", "ts", position="pos" if gaps else None).collect()
        assert len(got) == len(table)
        for r in got:
            assert (r.run_rows, r.run_span, r.run_minima) == want[(gaps, r.i)], (gaps, r)


def test_contact_runs_move_rows_once(spark, small, registered):
    plan = registered.queries()["touch_run"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") <= 2
    assert sum("Exchange hashpartitioning" in line and "Reused" not in line for line in plan.splitlines()) <= 4


def sequential_claims(events, frames):
    """The exclusive rule written as a loop."""
    out, taken = {}, {}
    for ev in sorted(events, key=lambda e: (-e[1], e[0])):
        best = None
        for pos, clock, gap, z in frames:
            if abs(clock - ev[1]) > 5 or any(abs(pos - p) <= 50 and abs(clock - c) <= 0.5 for p, c in taken.values()):
                continue
            rank = (0, -z, pos) if gap <= 2.5 else (1, gap, pos)
            best = min(best, (rank, pos, clock)) if best else (rank, pos, clock)
        if best:
            taken[ev[0]] = (best[1], best[2])
            out[ev[0]] = (best[1], "high" if best[0][0] == 0 else "low")
    return out


def test_claims_equal_the_sequential_rule(spark):
    import random
    rng = random.Random(4)
    frames = [(i, 300 - i * 0.1, rng.random() * 5, rng.random() * 10) for i in range(1, 900)]
    events = [(n, round(rng.uniform(215, 300), 1)) for n in range(60)]
    contacts = spark.createDataFrame([("g", 1, 7, p, c, z, d) for p, c, d, z in frames],
                                     "game_id string, period int, actor_id long, pos long, clock double, ball_z double, ball_distance double")
    asked = spark.createDataFrame([(n, "g", 1, 7, c) for n, c in events],
                                  "event_id long, game_id string, period int, actor_id long, event_clock double")
    got = {r.event_id: (r.pos, r.release_confidence) for r in fr.claim_frames(asked, contacts).collect()}
    assert got == sequential_claims(events, frames)


def test_roles(spark, tmp_path):
    frames = stored(spark, {"gameid": "g", "gamedate": "d", "events": [{"eventId": "1", "moments": [
        document_frames(EARLY, 1)[0], [1, 2, 9.0, None, None, [[-1, 5, 1.0, 2.0, 3.0], [3, 8, 1.0, 1.0, 0.0]]],
        [1, 3, 8.0, 1.0, None, []], [1, 4, 7.0]]}]}, tmp_path)
    rows = fr.split_roles(frames).orderBy("ts_ms").collect()
    assert [(r.ball_z, [p.entity_id for p in r.players]) for r in rows] == [(3.0, [SHOOTER, PARTNER, GUARD, HELPER]), (3.0, [8])]


def test_ingest_resumes_and_routes(spark, tmp_path):
    source = tmp_path / "games"
    source.mkdir()
    for name, moments in (("a", document_frames(EARLY, 1)), ("b", []), ("c", document_frames(LATE, 1))):
        (source / f"{name}.json").write_text(json.dumps({"gameid": name, "events": [{"eventId": "1", "moments": moments}]}))
    (source / "d.json").write_text('{"gameid": "d", "events": [')
    from obsexp.sources.readers import read_documents
    seen = []

    def extract(todo):
        files = sorted(r.path for r in todo.collect())
        seen.append([f.rsplit("/", 1)[1] for f in files])
        docs = read_documents(spark, files).select("file", "gameid", F.size(F.col("events")[0]["moments"]).alias("n"),
                                                   F.col("corrupt").isNotNull().alias("corrupt"))
        return (docs.where("n > 0").select("file", "gameid"),
                docs.select("file", "corrupt", F.col("n").alias("n_frames"),
                            F.when(F.col("gameid") == "c", 0).otherwise(1).alias("n_events"), F.col("n").alias("n_rows")))

    out, book = scratch_path(spark, "t-out"), scratch_path(spark, "t-ledger")
    first = lg.ingest_new(spark, str(source), out, book, extract, "*.json", limit=1).first()
    assert (first.total, first.extracted, first.remaining) == (4, 1, 3)
    second = lg.ingest_new(spark, str(source), out, book, extract, "*.json").first()
    assert (second.extracted, second["empty"], second.open_failures, second.remaining, second.rows) == (1, 1, 2, 2, 9)
    lg.ingest_new(spark, str(source), out, book, extract, "*.json")
    assert seen == [["a.json"], ["b.json", "c.json", "d.json"], ["c.json", "d.json"]]
    assert [r.file for r in spark.read.parquet(out).collect()] == ["a.json"]  # rows of failed files are not written
    book_rows = lg.read_ledger(spark, book).collect()
    assert sorted((r.file, r.status, r.reason) for r in book_rows) == [  # and a repeated failure is noted once
        ("a.json", "ok", None), ("b.json", "empty", "no frames in any event"), ("c.json", "failed", "no event table"),
        ("d.json", "failed", "document does not parse")]
    assert not lg.all_settled(lg.list_files(spark, str(source), "*.json"), lg.read_ledger(spark, book))


@pytest.mark.parametrize("measured, reported, before, after", [
    (14.75, 15.0, "high", "high"), (14.75, 23.0, "high", "low"), (14.75, None, "high", "high"), (14.75, 15.0, "low", "low")])
def test_demotion(spark, measured, reported, before, after):
    df = spark.createDataFrame([(measured, reported, before)], "m double, r double, release_confidence string")
    assert fr.demote(df, "m", "r").first().release_confidence == after


def test_odd_moments_are_parsed_once(spark, tmp_path):
    ball = [-1, -1, 1.5, 2.5, 1e-3]
    frames = stored(spark, {"gameid": "g", "gamedate": "d", "events": [
        {"eventId": "1", "moments": [["2", "7", 9.25, None, None, [ball]], [1, 8, "x", 3, None, [["?", 4, 1, 1, 0], ball]],
                                     [1, 9, 8.0, 1.0, None, None], [1, 10, 8.0, 1.0, None, "text"], "no array", None, 5]},
        {"eventId": "2", "moments": None}, {"eventId": "3", "moments": [[1, 7, 5, 4.0, None, [ball], "more"]]}]}, tmp_path)
    rows = {(r.event_id, r.ts_ms): r for r in frames.collect()}
    assert sorted(rows) == [("1", 7), ("1", 8), ("3", 7)]
    first, second = rows[("1", 7)], rows[("1", 8)]
    assert (first.period, first.clock, first.shot_clock, first.entities) == (2, 9.25, None, [[-1.0, -1.0, 1.5, 2.5, 0.001]])
    assert (second.clock, second.shot_clock, second.entities[0]) == (None, 3.0, [None, 4.0, 1.0, 1.0, 0.0])
    plan = frames._jdf.queryExecution().optimizedPlan().toString()
    assert "from_json" not in plan
