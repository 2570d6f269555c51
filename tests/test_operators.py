"""Boundaries, future mutation, repeated runs and recurrences of the library's own operators."""

import hashlib
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from asofkit.functions import hysteresis
from asofkit.functions import text as tx
from asofkit.operators import asof, bars, evidence, indicators, labels, propagation, regime, skill, store
from asofkit.streaming import streams

T0 = datetime(2024, 1, 2)


def hourly(n, price=lambda i: 100 + i * 0.5, name="X", skip=()):
    return [(name, T0 + timedelta(hours=i), T0 + timedelta(hours=i + 1), price(i), price(i) + 1, price(i) - 1, price(i) + 0.2, 10) for i in range(n) if i not in skip]


BARS = "instrument string, open_time timestamp, close_time timestamp, open double, high double, low double, close double, volume long"


def test_asof_boundaries(spark):
    left = spark.createDataFrame([("a", T0, 1), ("a", T0 - timedelta(seconds=1), 2), ("b", T0, 3), (None, T0, 4)], "k string, t timestamp, id int")
    right = spark.createDataFrame([("a", T0, 10), ("a", T0 + timedelta(days=40), 11), (None, T0, 12)], "k string, r timestamp, v int")
    back = {r.id: r.v for r in asof.asof_backward(left, right, ["k"], "t", "r", ["v"]).collect()}
    ahead = {r.id: r.v for r in asof.asof_forward_strict(left, right, ["k"], "t", "r", ["v"]).collect()}
    assert back == {1: 10, 2: None, 3: None, 4: None}
    assert ahead == {1: 11, 2: 10, 3: None, 4: None}


def test_vintage_boundary(spark):
    m = spark.createDataFrame([("c", T0, 318.1, None), ("c", T0 + timedelta(days=9), 318.4, None)], "code string, released_at timestamp, v double, vintage_end_at timestamp")
    at = lambda s: [r.v for r in asof.vintage_asof(m, ["code"], F.lit(s)).collect()]
    assert at(T0 - timedelta(seconds=1)) == [] and at(T0) == [318.1]
    assert at(T0 + timedelta(days=9, seconds=-1)) == [318.1] and at(T0 + timedelta(days=9)) == [318.4]


def test_complete_bars_need_every_base_bar(spark):
    b = spark.createDataFrame(hourly(12, skip=(5,)), BARS)
    full, skipped = bars.complete_bars(b, 3600, 14400)
    assert sorted(r.open_time.hour for r in full.collect()) == [0, 8] and [r.n for r in skipped.collect()] == [3]
    with pytest.raises(ValueError):
        bars.complete_bars(b, 3600, 7 * 3600)


def test_label_entry_is_strictly_later_and_gaps_are_null(spark):
    b = spark.createDataFrame(hourly(40, skip=range(20, 27)), BARS)
    got = {r.open_time: r for r in labels.horizon_label(b, ["instrument"], 4, 6 * 3600).collect()}
    first = got[T0]
    assert first.entry_at == T0 + timedelta(hours=2)  # the bar that opens at the close is not later
    assert first.label == pytest.approx(np.log((100 + 5 * 0.5 + 0.2) / (100 + 2 * 0.5)))
    assert got[T0 + timedelta(hours=17)].label is None


def test_future_changes_nothing_earlier(spark):
    rows = hourly(180)
    later = rows[:150] + [(*r[:3], 1.0, 1.0, 1.0, 1.0, 1) for r in rows[150:]]
    out = []
    for data in (rows, later):
        seg = bars.segments(spark.createDataFrame(data, BARS))
        out.append({r.open_time: tuple(r[c] for c in indicators.INDICATORS) for r in indicators.indicators(seg).collect() if r.open_time < rows[150][1]})
    assert out[0] == out[1]


def test_ewm_by_chunks_equals_pandas(spark):
    rows = hourly(700, lambda i: float(100 + 10 * np.sin(i / 9) + i * 0.01))
    got = indicators.ewm_mean(spark.createDataFrame(rows, BARS), ["instrument"], "open_time", "close", 2 / 21, "e", 20).toPandas().sort_values("open_time")
    want = pd.Series([r[6] for r in rows]).ewm(span=20, adjust=False, min_periods=20).mean()
    assert np.allclose(got["e"].to_numpy(dtype=float), want, equal_nan=True, rtol=1e-9)


def test_trend_becomes_trend_up(spark):
    run = regime.regime_run(spark.createDataFrame(hourly(180), BARS), spark.createDataFrame([], "mark_at timestamp, known_at timestamp, kind string"))
    rows = sorted(run.collect(), key=lambda r: r.open_time)
    assert rows[0].regime == "UNKNOWN" and {r.segment for r in rows} != set()
    assert "TREND_UP" in {r.raw_regime for r in rows if r.raw_regime != "UNKNOWN"} or all(r.raw_regime in ("UNKNOWN", "HIGH_VOLATILITY", "LOW_VOLATILITY", "RANGE") for r in rows)


def test_hysteresis():
    a, b = "RANGE", "TREND_UP"
    assert hysteresis.smooth([a] * 3 + [b] * 20)[:14] == [a] * 14
    assert hysteresis.smooth([a] * 12 + [b, b, a, b, b, b])[-4:] == [a, a, a, b]
    assert hysteresis.smooth([a] * 12 + ["UNKNOWN", b]) == [a] * 12 + ["UNKNOWN", b]


def test_rsi_edges(spark):
    got = spark.createDataFrame([(1.0, 0.0), (0.0, 0.0), (0.0, 1.0), (1.0, 3.0), (None, 1.0)], "g double, l double").select(indicators.rsi_column(F.col("g"), F.col("l"))).collect()
    assert [r[0] for r in got] == [100, 50, 0, 25, None]


def plain_indicators(rows):
    """Indicators of one segment by recursion."""
    def mean(xs, alpha, warm):
        y, n, out = None, 0, []
        for x in xs:
            if x is not None:
                y, n = x if y is None else alpha * x + (1 - alpha) * y, n + 1
            out.append(y if n >= warm else None)
        return out

    def each(f, *columns):
        return [None if None in v else f(*v) for v in zip(*columns)]
    h, lo, c = ([r[k] for r in rows] for k in (4, 5, 6))
    back = lambda xs, k: [None] * k + xs[:-k]
    tr = [max(a - b, abs(a - p), abs(b - p)) if p is not None else a - b for a, b, p in zip(h, lo, back(c, 1))]
    up, down, step = each(lambda x, y: x - y, h, back(h, 1)), each(lambda x, y: y - x, lo, back(lo, 1)), each(lambda x, y: x - y, c, back(c, 1))
    plus = [u if u is not None and u > d and u > 0 else 0.0 for u, d in zip(up, down)]
    minus = [d if d is not None and d > u and d > 0 else 0.0 for u, d in zip(up, down)]
    atr, p, m = (mean(x, 1 / 14, 14) for x in (tr, plus, minus))
    gain, loss = mean(each(lambda s: max(s, 0.0), step), 1 / 14, 14), mean(each(lambda s: max(-s, 0.0), step), 1 / 14, 14)
    pct = each(lambda a, x: a / x, atr, c)
    e20, e60, macd = mean(c, 2 / 21, 20), mean(c, 2 / 61, 60), each(lambda a, b: a - b, mean(c, 2 / 13, 12), mean(c, 2 / 27, 26))
    dx = [None if None in (x, y) or x + y == 0 else 100 * abs(x - y) / (x + y) for x, y in zip(p, m)]
    rank = [None if i < 59 or None in pct[i - 59 : i + 1] else sum(x <= pct[i] for x in pct[i - 59 : i + 1]) / 60 for i in range(len(c))]
    rsi = each(lambda g, s: 50.0 if g == s == 0 else 100.0 if s == 0 else 100 - 100 / (1 + g / s), gain, loss)
    slope = lambda e: each(lambda x, y: x / y - 1, e, back(e, 4))
    hist = each(lambda x, y, z: (x - y) / z, macd, mean(macd, 2 / 10, 9), c)
    return list(zip(e20, e60, slope(e20), slope(e60), pct, mean(dx, 1 / 14, 14), rank, rsi, hist))


@pytest.mark.parametrize("chunk_hours", [100, 1000])
def test_indicators_over_chunks(spark, chunk_hours):
    """Several chunks a segment, a segment shorter than a chunk, a flat start and a null nowhere else than while warming up."""
    r = np.random.default_rng(2)
    price = 100 + np.cumsum(r.normal(0, 1, 460)) * 0.3
    price[:30] = 100.0
    rows = hourly(460, lambda i: float(round(price[i], 4)))
    flat = [(*x[:4], x[6], x[6], x[6], *x[7:]) if i < 30 else x for i, x in enumerate(rows)]
    d = spark.createDataFrame([(*x, s) for s, part in ((0, flat[:400]), (1, flat[400:])) for x in part], BARS + ", segment long")
    got = {x.open_time: [x[c] for c in indicators.INDICATORS] for x in indicators.indicators(d, chunk_hours * 3600).collect()}
    want = [v for part in (flat[:400], flat[400:]) for v in plain_indicators(part)]
    for x, w in zip(flat, want):
        assert [v is None for v in got[x[1]]] == [v is None for v in w], x
        assert [v for v in got[x[1]] if v is not None] == pytest.approx([v for v in w if v is not None], rel=1e-9, abs=1e-9)


def test_smoothing_over_chunks(spark):
    """Equal to the loop on random labels, a segment spread over many tasks."""
    r = np.random.default_rng(3)
    names = ["RANGE", "TREND_UP", "TREND_DOWN", "UNKNOWN"]
    series = {0: [names[i] for i in np.repeat(r.choice(4, 200, p=[0.45, 0.3, 0.2, 0.05]), r.integers(1, 9, 200))], 1: ["RANGE"] * 5}
    rows = [("X", s, T0 + timedelta(hours=i + 5000 * s), x) for s, xs in series.items() for i, x in enumerate(xs)]
    out = regime.smoothed(spark.createDataFrame(rows, "instrument string, segment long, open_time timestamp, raw_regime string"), chunk_seconds=50 * 3600).orderBy("segment", "open_time").collect()
    for s, xs in series.items():
        assert [x.regime for x in out if x.segment == s] == hysteresis.smooth(xs)
    chain = regime.hash_chain(spark.createDataFrame(rows, "instrument string, segment long, open_time timestamp, raw_regime string").repartition(3)).orderBy("segment", "open_time").collect()
    for s, xs in series.items():
        link = b""
        for x, row in zip(xs, [c for c in chain if c.segment == s]):
            link = hashlib.sha256(link + f"{row.open_time.isoformat()}|{x}".encode()).digest()
            assert row.prefix_hash == link.hex()


def test_binomial_tail_is_exact(spark):
    import math
    from fractions import Fraction

    def exact(h, n):
        term, total = math.comb(n, h) if 0 <= h <= n else 0, 0
        for i in range(max(h, 0), n + 1):
            total += term
            term = term * (n - i) // (i + 1)
        return float(Fraction(total, 2**n))
    cases = [(h, n) for n in (1, 2, 3, 15, 16, 17, 100, 1001) for h in sorted({0, 1, n // 3, n // 2, n // 2 + 1, n - 1, n, n + 1})] + [(500_700, 1_000_000), (499_300, 1_000_000)]
    d = spark.createDataFrame([*cases, (0, 0)], "h long, n long").select("h", "n", skill.binomial_p("h", "n").alias("p"))
    for r in d.collect():
        if r.n == 1_000_000:  # the exact sum by symmetry and a normal approximation of the middle is too coarse: by logarithms in high precision
            from decimal import Decimal, getcontext

            getcontext().prec = 60
            k, n = max(r.h, r.n - r.h + 1), r.n
            term = total = Decimal(math.comb(n, k)) / Decimal(2) ** n
            for i in range(k, k + 12_000):
                term *= Decimal(n - i) / Decimal(i + 1)
                total += term
            assert abs(r.p - float(total if r.h == k else 1 - total)) < 1e-12
        elif r.n:
            assert r.p == pytest.approx(exact(r.h, r.n), rel=1e-11, abs=1e-15)
        else:
            assert r.p is None


def test_wilson_and_binomial(spark):
    r = spark.createDataFrame([(8, 10)], "h long, n long").select(*[c for c in skill.wilson(F.col("h"), F.col("n"))], skill.binomial_p("h", "n")).first()
    assert r[0] == pytest.approx(0.4901, abs=1e-3) and r[1] == pytest.approx(0.9433, abs=1e-3) and r[2] == pytest.approx(56 / 1024)


def test_reposts_of_one_text(spark):
    base = "silver breaks above the old high and the trend stays up as long as support holds at the line"
    rows = [(i, f"s{i % 7}", "b", base, T0 + timedelta(minutes=i)) for i in range(100)]
    rows += [(200, "s", "b", base.replace("line", "level"), T0 + timedelta(days=1)), (201, "s", "b", "nothing alike in here whatsoever", T0)]
    d = spark.createDataFrame(rows, "id long, source string, bucket string, normal string, at timestamp")
    e = propagation.edges(d, "bucket", "id", "source", "normal", "at")
    c = propagation.clusters(d, e, "id", "at")
    root = {r.id: r.root for r in c.collect()}
    assert e.where("relation = 'REPOST'").count() == 99  # a star, not all pairs
    assert root[99] == 0 and root[200] == 0 and root[201] == 201
    s = propagation.cluster_stats(c, "id").first()
    assert (s["items"], s.independent) == (102, 2)


def test_append_twice_adds_nothing(spark, tmp_path):
    d = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "k int, v string")
    path = str(tmp_path / "t")
    for _ in range(2):
        store.write_new(d, path, ["k"], [F.col("v")])
        assert sorted(map(tuple, spark.read.parquet(path).collect())) == [(1, "a"), (2, "b")]
    with pytest.raises(Exception, match="changed values"):
        store.append_versioned(spark.createDataFrame([(1, "z")], "k int, v string"), d, ["k"], ["v"]).collect()
    assert store.append_versioned(d.limit(1), d.limit(1), ["k"], ["v"]).count() == 0


def test_table_digest_ignores_order(spark):
    d = spark.range(500).select("id", (F.col("id") % 7).cast("string").alias("v"))
    a, b = store.table_digest(d).first(), store.table_digest(d.orderBy(F.desc("id")).repartition(5)).first()
    assert a == b and a != store.table_digest(d.where("id > 0")).first()


def test_text_functions(spark):
    d = spark.createDataFrame([("Ｃopper​  Price",), (None,)], "t string")
    assert [r[0] for r in d.select(tx.normalize_for_hash("t")).collect()] == ["copper price", ""]
    assert [r[0] for r in d.select(tx.normalize_text("t")).collect()] == ["Copper Price", None]
    one = spark.createDataFrame([("白银价格 up 12 x",)], "t string")
    assert one.select(tx.tokens(F.col("t"))).first()[0] == ["白银", "银价", "价格", "up", "12", "x"]
    h = lambda *p: spark.range(1).select(tx.content_hash(*[F.lit(x) for x in p])).first()[0]
    assert h("ab", "c") != h("a", "bc") and h("A ", "c") == h("a", "C")
    r = spark.range(1).select(tx.redact(F.lit("Authorization: Bearer abc.def token=xyz sk-12345")), tx.safe_url(F.lit("https://u:p@h.org/a?q=1#f"))).first()
    assert "abc" not in r[0] and "xyz" not in r[0] and "12345" not in r[0] and r[1] == "https://h.org/a"
    at, ambiguous = tx.feed_time(F.col("t"))
    times = spark.createDataFrame([("Tue, 02 Jan 2024 10:00:00 GMT",), ("2024-01-02T10:00:00+02:00",), ("2024-01-02 10:00:00",)], "t string").select(at, ambiguous).collect()
    assert [(str(a), b) for a, b in times] == [("2024-01-02 10:00:00", False), ("2024-01-02 08:00:00", False), ("None", True)]


def test_evidence_reference_and_readiness(spark):
    p = spark.createDataFrame([("s", "a", i, T0.date()) for i in range(3)], "scope string, source string, item long, available_at date")
    rows = {(r.scope, r.metric): r.status for r in evidence.readiness(p, ["s", "empty"], 2, 0, 0.4).collect()}
    assert rows[("s", "rows")] == "PASS" and rows[("s", "max_source_share")] == "FAIL" and rows[("empty", "max_source_share")] == "FAIL"


def test_smoothing_stream_equals_batch(spark, tmp_path):
    labels_ = ["RANGE"] * 14 + ["TREND_UP"] * 6 + ["UNKNOWN"] + ["RANGE"] * 4
    rows = [("X", T0 + timedelta(hours=i), 0, x) for i, x in enumerate(labels_)]
    schema = "instrument string, open_time timestamp, segment long, raw_regime string"
    for part in (rows[:16], rows[16:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    was = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        s = streams.smoothed_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
        q = s.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", was)
    got = [r.regime for r in spark.read.parquet(str(tmp_path / "out")).orderBy("open_time").collect()]
    assert got == hysteresis.smooth(labels_)


def test_first_seen_and_foreach_batch(spark, tmp_path):
    schema = "k int, v string, at timestamp"
    spark.createDataFrame([(1, "a", T0), (1, "b", T0), (2, "c", T0)], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    s = streams.first_seen_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), ["k"], "at", "1 hour")
    q = s.writeStream.foreachBatch(streams.append_new(str(tmp_path / "out"), ["k"], ["v"])).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
