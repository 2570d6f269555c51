"""Rules of collection, intake, time splits and streams, by hand-made rows and plain loops."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from asofkit.operators import bars, evaluation, indicators, intake, labels, regime, snapshots, windows
from asofkit.sources import payloads
from asofkit.streaming import streams

T0 = datetime(2024, 1, 1)


def test_first_by_any_key_equals_the_loop(spark):
    import random

    r = random.Random(3)
    rows = [(i, r.choice(["u1", "u2", "u3", None, " "]) if i % 3 else f"x{i}", f"id{r.randint(0, 30)}", f"f{r.randint(0, 40)}") for i in range(120)]
    known, want = set(), {}
    for i, *values in rows:
        keys = {f"{n}={v.strip()}" for n, v in zip("abc", values) if v and v.strip()}
        want[i] = not keys & known
        if want[i]:
            known |= keys
    d = spark.createDataFrame([*rows, (500, None, None, None)], "i long, a string, b string, c string")
    got = {x.i: x.kept for x in intake.first_by_any_key(d, "i", ["a", "b", "c"]).collect()}
    assert got == want | {500: True} and 0 < sum(want.values()) < 120


def test_first_by_any_key_along_a_chain_and_a_hot_key(spark):
    """Row i shares a key with row i + 1 only, so every second row stays; thousands share one key."""
    n = 10_000
    rows = [(i, f"k{i // 2}", f"k{(i + 1) // 2}") for i in range(n)] + [(n + i, "hot", None) for i in range(3000)]
    status = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("chain", "chain")
    got = {x.i: x.kept for x in intake.first_by_any_key(spark.createDataFrame(rows, "i long, a string, b string"), "i", ["a", "b"]).collect()}
    assert [got[i] for i in range(n, n + 3000)] == [True] + [False] * 2999
    held, want = set(), []
    for _, *ks in rows[:n]:
        ks = {f"{c}={k}" for c, k in zip("ab", ks)}
        want.append(not ks & held)
        held |= ks if want[-1] else set()
    assert [got[i] for i in range(n)] == want == [i % 2 == 0 for i in range(n)]
    assert len(status.getJobIdsForGroup("chain")) < 400


def test_collection_registers_identity_before_validation(spark):
    late, early = T0 + timedelta(days=2), T0
    rows = [(1, "s", "a", "T", "Text", late, early, None), (2, "s", "a", " t ", "text", early, early, early + timedelta(hours=1)), (3, "s", " ", "T", "x", early, early, None),
            (4, "s", "b", " ", None, early, early, None), (5, "s", "c", "T", "known", early, early, None), (6, "s", "d", "T", "y" * 30, None, early, None)]
    d = spark.createDataFrame(rows, "i long, source string, source_record_id string, title string, text string, published_at timestamp, collected_at timestamp, effective_floor timestamp")
    known = intake.collection_records(d.where("i = 5"), spark.createDataFrame([], "identity string"), [F.col("i")], F.lit(T0)).select("identity")
    got = {r.i: r for r in intake.collection_records(d, known, [F.col("i")], F.lit(T0), max_text=20).collect()}
    assert [got[i].outcome for i in range(1, 7)] == ["REJECTED", "DUPLICATE", "REJECTED", "REJECTED", "DUPLICATE", "ACCEPTED"]
    assert got[1].reasons == ["published_at: in_future"] and got[3].reasons == ["missing_source_record_id"] and got[4].reasons == ["empty_content"]
    assert got[2].warnings == ["effective_floor"] and got[2].effective_at == early + timedelta(hours=1) and len(got[6].text) == 20 and got[6].warnings == ["text_cut"]


def test_market_closed_in_holiday_hours(spark):
    cases = {"2024-03-28 20:00": False, "2024-03-28 21:30": True, "2024-03-29 15:00": True, "2024-12-24 18:00": False, "2024-12-24 19:00": True, "2024-12-25 22:30": True, "2024-12-25 23:00": False,
             "2024-12-31 21:00": False, "2024-12-31 22:00": True, "2024-05-27 18:59": False, "2024-05-27 19:00": True, "2024-05-27 22:00": False, "2024-07-04 18:00": False, "2024-07-04 19:00": True,
             "2025-07-04 17:00": True, "2025-07-04 16:00": False, "2024-11-28 20:00": True, "2024-11-29 20:00": True, "2024-11-29 19:00": False}
    d = spark.createDataFrame([(k,) for k in cases], "k string")
    got = {r.k: r.closed for r in d.select("k", bars.market_closed(F.to_timestamp("k", "yyyy-MM-dd HH:mm")).alias("closed")).collect()}
    assert got == cases
    assert bars.good_fridays(2019, 2026) == ["2019-04-19", "2020-04-10", "2021-04-02", "2022-04-15", "2023-04-07", "2024-03-29", "2025-04-18", "2026-04-03"]


def hourly(n, skip=()):
    out, t = [], T0
    for i in range(n):
        t += timedelta(hours=24 if i in skip else 1)
        out.append(("A", t, t + timedelta(hours=1), 100.0 + i, 101.0 + i, 99.0 + i, 100.5 + i))
    return out


BARS = "instrument string, open_time timestamp, close_time timestamp, open double, high double, low double, close double"


def test_splits_and_windows(spark):
    d = spark.createDataFrame(hourly(600), BARS)
    n = {r.part: r["count"] for r in windows.time_split(d, ["instrument"], [F.col("open_time")], 24).groupBy("part").count().collect()}
    assert n == {"train": 360, "embargo": 48, "validation": 96, "test": 96}
    with pytest.raises(Exception, match="a series has"):
        windows.time_split(d.limit(100), ["instrument"], [F.col("open_time")], 24).collect()
    w = windows.walk_forward(d, ["instrument"], [F.col("open_time")], 0.5, 140, 24, 300, 30).groupBy("window", "train_end", "used").count().orderBy("window").collect()
    assert [tuple(x) for x in w] == [(0, 276, False, 140), (1, 416, True, 140), (2, 556, False, 20)]


def test_horizon_label_ignores_the_step_before_the_entry(spark):
    out = {r.open_time: r.label for r in labels.horizon_label(spark.createDataFrame(hourly(40, skip={10}), BARS), ["instrument"], 3, 6 * 3600).collect()}
    rows = hourly(40, skip={10})
    # Signal at bar 9: its entry comes after the long step, at bar 10 (open strictly after bar 9's close).
    assert out[rows[9][1]] is not None and out[rows[5][1]] is not None
    assert out[rows[6][1]] is None and out[rows[39][1]] is None  # bar 8 to 10 steps over the gap


def test_gate_counts_what_was_known_late(spark):
    rows = [("A", 0, T0 + timedelta(hours=i), T0 + timedelta(hours=i + 1), T0 + timedelta(hours=i + 1 + (i == 7)), r, r, r) for i, r in enumerate(
        ["UNKNOWN"] + ["RANGE"] * 4 + ["TREND_UP"] * 4 + ["UNKNOWN"] + ["RANGE"] * 2)]
    run = spark.createDataFrame(rows, "instrument string, segment long, open_time timestamp, close_time timestamp, available_at timestamp, raw_regime string, stat_regime string, regime string")
    m = regime.regime_metrics(run).first()
    assert (m.violations, m.max_switches, m.n_RANGE, m.n_UNKNOWN, m.passed) == (1, 1, 6, 2, False) and m.mean_run == pytest.approx(10 / 3)


@pytest.mark.parametrize("alpha", [1.0, 0.999, 0.5, 0.01])
def test_ewm_mean_for_every_alpha(spark, alpha):
    import pandas as pd

    rows = hourly(300)
    got = [r.y for r in indicators.ewm_mean(spark.createDataFrame(rows, BARS), ["instrument"], "open_time", "close", alpha, "y").orderBy("open_time").collect()]
    want = pd.Series([r[6] for r in rows]).ewm(alpha=alpha, adjust=False).mean().tolist()
    assert got == pytest.approx(want)


def test_replay_finds_every_kind_of_change(spark):
    rows = [(f"b{i}", *r, r[2]) for i, r in enumerate(hourly(8))]
    b = spark.createDataFrame(rows, "bar_id string, " + BARS + ", effective_at timestamp")
    frozen = snapshots.freeze(snapshots.latest_features(b, ["instrument"], F.lit(T0 + timedelta(hours=9)), 3600), b, ["instrument"])
    problem = lambda bars_: snapshots.replay(frozen, bars_, ["instrument"], 3600).first().problem
    assert frozen.first().input_ids == [f"b{i}" for i in range(3, 8)] and problem(b) is None
    assert problem(b.where("bar_id <> 'b5'")) == "inputs_missing"
    assert problem(b.withColumn("low", F.col("low") - 1)) == "inputs_changed"
    assert problem(b.withColumn("effective_at", F.col("effective_at") + F.expr("interval 9 hours"))) == "not_visible"


def test_daily_rows_tell_errors_from_bad_bars(spark):
    s = "instrument string, date string, open string, high string, low string, close string, volume string"
    good, bad = payloads.daily_rows(spark.createDataFrame([("a", "2024-01-02", "1", "2", "1", "2", None), ("a", "2024-01-03", "1", "0.5", "1", "2", "3")], s))
    assert good.count() == 1 and bad.count() == 1
    with pytest.raises(Exception, match="unreadable daily row"):
        payloads.daily_rows(spark.createDataFrame([("a", "2024-01-02", "", "2", "1", "2", None)], s))[0].collect()


def test_corpus_csv_in_two_encodings(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,Body\n1,白银\n", encoding="utf-8")
    (tmp_path / "b.csv").write_bytes("id,Body\n2,原油\n".encode("gb18030"))
    got = payloads.corpus_csv(spark, str(tmp_path), {"id": [], "content": ["body"]}).collect()
    assert sorted((r.id, r.content) for r in got) == [("1", "白银"), ("2", "原油")]


def test_news_csv_needs_its_columns(spark, tmp_path):
    (tmp_path / "n.csv").write_text("record_id,title\n1,x\n")
    with pytest.raises(ValueError, match="published_at"):
        payloads.news_csv(spark, str(tmp_path))


def test_streaming_bars_of_sixty_minutes(spark, tmp_path):
    """Every whole hour comes out, an hour with a repeated minute does not."""
    rows = [("A", T0 + timedelta(minutes=i if i != 61 else 60), 1.0, 1.0, 1.0, 1.0, 1) for i in range(60 * 40)]
    d = spark.createDataFrame(rows, "instrument string, open_time timestamp, open double, high double, low double, close double, volume long")
    d.coalesce(1).write.parquet(str(tmp_path / "in"))
    s = streams.complete_bars_stream(spark.readStream.schema(d.schema).parquet(str(tmp_path / "in")), "1 hour", 60, "1 minute")
    q = s.writeStream.format("memory").queryName("hours").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    hours = {r.open_time for r in spark.table("hours").collect()}
    assert hours == {T0 + timedelta(hours=h) for h in range(39)} - {T0 + timedelta(hours=1)}


def test_evaluation_skips_short_windows(spark):
    d = spark.createDataFrame(hourly(200), BARS).withColumn("ret", F.sin("open")).withColumn("copy", F.col("ret"))
    ics = evaluation.walk_forward_ic(d, ["instrument"], [F.col("open_time")], ["copy"], "ret", 0.5, 30, 4, 60, 20)
    assert [(r.window, r.n, round(r.ic, 9)) for r in ics.orderBy("window").collect()] == [(0, 30, 1.0), (1, 30, 1.0), (2, 30, 1.0)]
    assert evaluation.summary(ics, ["instrument"]).first().windows == 3


def test_date_chunks_and_accounts(spark):
    r = spark.createDataFrame([("2024-01-01", "2024-01-05")], "a string, b string").select(F.to_date("a").alias("a"), F.to_date("b").alias("b"))
    assert [(str(x.chunk_start), str(x.chunk_end)) for x in intake.date_chunks(r, "a", "b", 2).collect()] == [("2024-01-01", "2024-01-02"), ("2024-01-03", "2024-01-04"), ("2024-01-05", "2024-01-05")]
    with pytest.raises(Exception, match="ends before"):
        intake.date_chunks(r, "b", "a", 2).collect()
    with pytest.raises(Exception, match="bad post"):
        p = spark.createDataFrame([("s", "1", "x", T0, T0 - timedelta(hours=1), None)], "source string, record_id string, content string, published_at timestamp, effective_at timestamp, collected_at timestamp")
        intake.import_posts(p, p.limit(0), [F.col("record_id")]).collect()


def test_macro_frame_uses_nothing_before_its_release(spark):
    from asofkit.plans import intake as queries

    frame, _ = queries._macro_frame(spark, "/root/testdata/sf0.001")
    found = snapshots.time_violations(frame, ["1-URGENT_released_at", "2-HIGH_released_at", "other_at"], "signal_at").collect()
    assert frame.where("other_at is not null").count() > 0 and {r.violations for r in found} == {0}
