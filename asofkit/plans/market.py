"""Queries over bars, macro releases and opinions, each with its DuckDB statement."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import asof, bars, windows
from . import adapters as a

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f
    return add


T = "strftime({0}, '%Y-%m-%d %H:%M:%S')"


def t(c):
    return T.format(c)


r6 = lambda c: F.round(c, 6)


@query(f"""WITH {a.BARS}, g AS (SELECT instrument, time_bucket(INTERVAL 4 HOUR, open_time) AS b, arg_min(open, open_time) AS open, max(high) AS high, min(low) AS low,
  arg_max(close, open_time) AS close, sum(volume) AS volume, count(*) AS n FROM bars GROUP BY ALL)
SELECT instrument, {t('b')} AS open_time, open, high, low, close, CAST(volume AS BIGINT) AS volume FROM g WHERE n = 4""")
def bars_4h(spark, d):
    made, _ = bars.complete_bars(a.bars_1h(spark, d), 3600, 14400)
    return made.select("instrument", a.stamp("open_time").alias("open_time"), "open", "high", "low", "close", F.col("volume").cast("long").alias("volume"))


@query(f"""WITH {a.BARS}, g AS (SELECT instrument, time_bucket(INTERVAL 4 HOUR, open_time) AS b, count(*) AS n FROM bars GROUP BY ALL)
SELECT instrument, {t('b')} AS open_time, n FROM g WHERE n <> 4""")
def bars_4h_skipped(spark, d):
    _, skipped = bars.complete_bars(a.bars_1h(spark, d), 3600, 14400)
    return skipped.select("instrument", a.stamp("open_time").alias("open_time"), "n")


@query(f"""WITH {a.BARS}, b AS (SELECT *, CASE WHEN hour(open_time) % 7 = 0 THEN low * 2 ELSE high END AS h2, CASE WHEN hour(open_time) % 11 = 0 THEN -low ELSE low END AS l2 FROM bars)
SELECT code, count(*) AS n FROM (
  SELECT unnest(list_filter([CASE WHEN h2 < greatest(open, close, l2) THEN 'high_bound' END, CASE WHEN l2 > least(open, close, h2) THEN 'low_bound' END,
    CASE WHEN least(open, h2, l2, close) <= 0 THEN 'price_not_positive' END], lambda x: x IS NOT NULL)) AS code FROM b) GROUP BY code""")
def bar_problem_counts(spark, d):
    b = a.bars_1h(spark, d)
    b = b.withColumn("high", F.when(F.hour("open_time") % 7 == 0, F.col("low") * 2).otherwise(F.col("high"))).withColumn(
        "low", F.when(F.hour("open_time") % 11 == 0, -F.col("low")).otherwise(F.col("low")))
    return b.select(F.explode(bars.bar_problems()).alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


_LOCAL = "(slots.open_time AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York')"
_PROFILE = a.SLOTS + f""", s AS (SELECT *, {_LOCAL} AS l FROM slots), p AS (SELECT instrument, isodow(l) - 1 AS weekday, hour(l) AS hour,
  avg(CASE WHEN open IS NOT NULL THEN 1.0 ELSE 0.0 END) AS presence, count(*) AS n FROM s GROUP BY ALL)"""
_USUAL = """, daily AS (SELECT instrument, CAST(l AS DATE) AS day, count(*) AS n FROM s GROUP BY ALL),
  f AS (SELECT instrument, isodow(day) - 1 AS weekday, n, count(*) AS days, min(day) AS since FROM daily GROUP BY ALL),
  u AS (SELECT instrument, weekday, n AS usual FROM f QUALIFY row_number() OVER (PARTITION BY instrument, weekday ORDER BY days DESC, since) = 1)"""


@query(f"WITH {_PROFILE} SELECT instrument, weekday, hour, round(presence, 6) AS presence, n, presence < 0.75 AS closed FROM p")
def session_profile(spark, d):
    p = bars.session_profile(a.slots(spark, d), "America/New_York", 0.75)
    return p.withColumn("weekday", F.col("weekday").cast("long")).withColumn("hour", F.col("hour").cast("long")).withColumn("presence", r6("presence"))


@query(f"""WITH {_PROFILE}{_USUAL}, m AS (SELECT s.*, p.presence < 0.75 AS closed, CAST(l AS DATE) AS day FROM s JOIN p ON s.instrument = p.instrument
    AND isodow(l) - 1 = p.weekday AND hour(l) = p.hour),
  ds AS (SELECT instrument, day, coalesce(avg(CASE WHEN NOT closed THEN CASE WHEN open IS NULL THEN 1.0 ELSE 0.0 END END), 0) AS ns FROM m GROUP BY ALL)
SELECT instrument, CASE WHEN open IS NOT NULL THEN 'ok' WHEN closed THEN 'session_break' WHEN ns >= 0.8 THEN 'holiday_suspect' ELSE 'data_gap' END AS category,
  count(*) AS n FROM m JOIN ds USING (instrument, day) GROUP BY ALL
UNION ALL SELECT instrument, 'missing', CAST(sum(greatest(usual - n, 0)) AS BIGINT) FROM daily JOIN u ON daily.instrument = u.instrument AND isodow(day) - 1 = u.weekday GROUP BY ALL""".replace(
    "UNION ALL SELECT instrument, 'missing'", "UNION ALL SELECT daily.instrument, 'missing'"))
def gap_audit(spark, d):
    return bars.gap_audit(a.slots(spark, d), "America/New_York", 0.75)


@query(f"""WITH {_PROFILE}{_USUAL}, x AS (SELECT daily.instrument, day, n, usual, usual - n AS deficit FROM daily JOIN u ON daily.instrument = u.instrument AND isodow(day) - 1 = u.weekday)
SELECT instrument, CAST(day AS VARCHAR) AS day, n, usual, deficit FROM x WHERE deficit > 0 QUALIFY row_number() OVER (PARTITION BY instrument ORDER BY deficit DESC, x.day) <= 10""")
def low_coverage_days(spark, d):
    return bars.low_coverage_days(a.slots(spark, d), "America/New_York").withColumn("day", F.col("day").cast("string"))


@query(f"""WITH {a.BARS}, g AS (SELECT instrument, open_time, lead(open_time) OVER (PARTITION BY instrument ORDER BY open_time) AS nxt FROM bars)
SELECT instrument, {t('open_time + to_hours(CAST(i AS INTEGER))')} AS missing_time FROM g, range(1, 101) r(i) WHERE open_time + to_hours(CAST(i AS INTEGER)) < nxt""")
def missing_bar_times(spark, d):
    return bars.missing_times(a.bars_1h(spark, d), 3600).select("instrument", a.stamp("missing_time").alias("missing_time"))


# The holiday windows of 2023 to 2025 as a list of (first closed hour, first open hour again), New York time.
_HOLIDAYS = [
    *((f"{d} 15:00", f"{d} 18:00") for d in (
        "2023-01-16", "2024-01-15", "2025-01-20", "2023-02-20", "2024-02-19", "2025-02-17", "2023-05-29", "2024-05-27", "2025-05-26", "2023-09-04", "2024-09-02",
        "2025-09-01", "2023-06-19", "2024-06-19", "2025-06-19", "2023-07-04", "2024-07-04", "2023-11-23", "2024-11-28", "2025-11-27")),
    ("2023-04-06 17:00", "2023-04-08 00:00"), ("2024-03-28 17:00", "2024-03-30 00:00"), ("2025-04-17 17:00", "2025-04-19 00:00"),
    ("2025-07-04 13:00", "2025-07-05 00:00"), ("2023-11-24 15:00", "2023-11-25 00:00"), ("2024-11-29 15:00", "2024-11-30 00:00"), ("2025-11-28 15:00", "2025-11-29 00:00"),
    *((f"{y}-12-24 14:00", f"{y}-12-25 18:00") for y in (2023, 2024, 2025)), *((f"{y}-12-31 17:00", f"{y + 1}-01-01 18:00") for y in (2022, 2023, 2024, 2025))]
_HOL = " OR ".join(f"({{l}} >= TIMESTAMP '{a}' AND {{l}} < TIMESTAMP '{b}')" for a, b in _HOLIDAYS)
_CLOSED = "(isodow({l}) = 6 OR (isodow({l}) = 5 AND hour({l}) >= 17) OR (isodow({l}) = 7 AND hour({l}) < 18) OR hour({l}) = 17 OR " + _HOL + ")"


@query(f"""WITH {a.BARS}, s AS (SELECT instrument, open_time AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York' AS l FROM bars)
SELECT instrument, {_CLOSED.format(l='l')} AS closed, count(*) AS n FROM s GROUP BY ALL""")
def market_closed_hours(spark, d):
    return a.bars_1h(spark, d).groupBy("instrument", bars.market_closed(F.col("open_time"), 2023, 2025).alias("closed")).agg(F.count(F.lit(1)).alias("n"))


_SEGMENTS = f"""{a.BARS}, prev AS (SELECT *, lag(close_time) OVER (PARTITION BY instrument ORDER BY open_time) AS pc FROM bars),
  hours AS (SELECT instrument, open_time, unnest(range(pc, open_time, INTERVAL 1 HOUR)) AS h FROM prev WHERE pc < open_time),
  bad AS (SELECT DISTINCT instrument, open_time FROM (SELECT *, h AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York' AS l FROM hours) WHERE NOT {_CLOSED.format(l='l')}),
  seg AS (SELECT b.*, sum(CASE WHEN bad.open_time IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY b.instrument ORDER BY b.open_time) AS segment
    FROM bars b LEFT JOIN bad ON b.instrument = bad.instrument AND b.open_time = bad.open_time)"""


@query(f"WITH {_SEGMENTS} SELECT instrument, CAST(segment AS BIGINT) AS segment, count(*) AS n, {t('min(open_time)')} AS start_at FROM seg GROUP BY instrument, segment")
def bar_segments(spark, d):
    s = bars.segments(a.bars_1h(spark, d))
    return s.groupBy("instrument", "segment").agg(F.count(F.lit(1)).alias("n"), a.stamp(F.min("open_time")).alias("start_at"))


_W = "PARTITION BY instrument ORDER BY open_time"
_RET = f"{a.BARS}, r AS (SELECT *, ln(close) - ln(lag(close) OVER ({_W})) AS lr FROM bars)"


def _fw(value, of, n, frame):
    return f"CASE WHEN count({of}) OVER ({_W} ROWS BETWEEN {frame}) = {n} THEN {value} END"


_20, _4, _P = "19 PRECEDING AND CURRENT ROW", "3 PRECEDING AND CURRENT ROW", "20 PRECEDING AND 1 PRECEDING"
_OV = lambda frame: f"OVER ({_W} ROWS BETWEEN {frame})"
_FEATURES = f"""SELECT instrument, {t('open_time')} AS open_time, round(lr, 6) AS log_return,
  round({_fw(f'sum(lr) {_OV(_20)}', 'lr', 20, _20)}, 6) AS momentum, round({_fw(f'close / avg(close) {_OV(_20)} - 1', 'close', 20, _20)}, 6) AS mean_gap,
  round({_fw(f'close / avg(close) {_OV(_4)} - 1', 'close', 4, _4)}, 6) AS mean_gap_4, round({_fw(f'stddev_samp(lr) {_OV(_20)}', 'lr', 20, _20)}, 6) AS volatility,
  round({_fw(f'stddev_pop(lr) {_OV(_4)}', 'lr', 4, _4)}, 6) AS volatility_4, round({_fw(f'close / max(high) {_OV(_P)} - 1', 'high', 20, _P)}, 6) AS breakout FROM r"""


@query(f"WITH {_RET} {_FEATURES}")
def return_features(spark, d):
    f = windows.return_features(a.bars_1h(spark, d), ["instrument"])
    return f.select("instrument", a.stamp("open_time").alias("open_time"), *[r6(c).alias(c) for c in
                    ("log_return", "momentum", "mean_gap", "mean_gap_4", "volatility", "volatility_4", "breakout")])


_STATE = f"{a.BARS}, st AS (SELECT instrument, open_time, CASE WHEN volume % 5 = 0 THEN 'UNKNOWN' WHEN close > open THEN 'UP' ELSE 'DOWN' END AS state FROM bars)"
_ISL = """, c AS (SELECT *, CASE WHEN state IS DISTINCT FROM lag(state) OVER w THEN 1 ELSE 0 END AS ch FROM st WINDOW w AS (PARTITION BY instrument ORDER BY open_time)),
  g AS (SELECT *, sum(ch) OVER (PARTITION BY instrument ORDER BY open_time) AS run FROM c),
  runs AS (SELECT instrument, state, min(open_time) AS start_at, max(open_time) AS end_at, count(*) AS n FROM g GROUP BY instrument, run, state)"""


def _states(spark, d):
    return a.bars_1h(spark, d).select("instrument", "open_time", F.when(F.col("volume") % 5 == 0, "UNKNOWN").when(F.col("close") > F.col("open"), "UP").otherwise("DOWN").alias("state"))


@query(f"WITH {_STATE}{_ISL} SELECT instrument, state, {t('start_at')} AS start_at, {t('end_at')} AS end_at, n FROM runs")
def state_runs(spark, d):
    r = windows.state_runs(_states(spark, d), ["instrument"], "open_time", "state")
    return r.withColumn("start_at", a.stamp("start_at")).withColumn("end_at", a.stamp("end_at"))


@query(f"WITH {_STATE}{_ISL} SELECT instrument, state, max(n) AS longest FROM runs GROUP BY ALL")
def longest_state_run(spark, d):
    return windows.longest_run(_states(spark, d), ["instrument"], "open_time", "state")


@query(f"""WITH {_STATE}{_ISL}, p AS (SELECT *, lag(state) OVER (PARTITION BY instrument ORDER BY start_at) AS ps FROM runs)
SELECT instrument, CAST(CAST(start_at AS DATE) AS VARCHAR) AS day, count(*) AS switches FROM p WHERE ps IS NOT NULL AND ps <> 'UNKNOWN' AND state <> 'UNKNOWN' GROUP BY ALL""")
def daily_state_switches(spark, d):
    r = windows.state_runs(_states(spark, d), ["instrument"], "open_time", "state")
    return windows.daily_switches(r, ["instrument"], "state").withColumn("day", F.col("day").cast("string"))


@query(f"""WITH {a.BARS}, w AS (SELECT *, CASE WHEN lag(close_time) OVER ({_W}) = open_time THEN 1 ELSE 0 END AS link FROM bars)
SELECT instrument, {t('open_time')} AS open_time, coalesce(sum(link) OVER ({_W} ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) = 4
  AND count(*) OVER ({_W} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) = 5, false) AS window_ok FROM w""")
def contiguous_windows(spark, d):
    w = windows.contiguous_window(a.bars_1h(spark, d), ["instrument"], 5, 3600)
    return w.select("instrument", a.stamp("open_time").alias("open_time"), "window_ok")


@query(f"""WITH {a.BARS}, x AS (SELECT *, lead(open, 1) OVER ({_W}) AS entry, lead(close, 4) OVER ({_W}) AS exit FROM bars)
SELECT instrument, {t('open_time')} AS open_time, round(ln(exit / entry), 6) AS label FROM x WHERE exit IS NOT NULL""")
def simple_label(spark, d):
    from ..operators import labels

    out = labels.simple_label(a.bars_1h(spark, d), ["instrument"], 4)
    return out.where("label is not null").select("instrument", a.stamp("open_time").alias("open_time"), r6("label").alias("label"))


@query(f"""WITH {a.BARS}, n AS (SELECT *, row_number() OVER ({_W}) AS rn, lag(open_time) OVER ({_W}) AS po FROM bars),
  s AS (SELECT *, sum(CASE WHEN open_time - po > INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER ({_W}) AS gaps FROM n)
SELECT e.instrument, {t('b.open_time')} AS open_time, round(CASE WHEN x.gaps = e.gaps THEN ln(x.close / e.open) END, 6) AS label
FROM s b JOIN s e ON b.instrument = e.instrument AND e.rn = (SELECT min(q.rn) FROM s q WHERE q.instrument = b.instrument AND q.open_time > b.close_time)
LEFT JOIN s x ON x.instrument = e.instrument AND x.rn = e.rn + 23""")
def horizon_label(spark, d):
    from ..operators import labels

    out = labels.horizon_label(a.bars_1h(spark, d), ["instrument"], 24, 6 * 3600)
    return out.where("entry_at is not null").select("instrument", a.stamp("open_time").alias("open_time"), r6("label").alias("label"))


@query()
def macro_asof(spark, d):
    m = a.macro(spark, d)
    w = Window.partitionBy("event_code").orderBy("released_at", "release_id")
    m = m.withColumn("change", F.col("actual_value") - F.lag("actual_value").over(w))
    days = a.table(spark, d, "lineitem").select(F.date_trunc("day", "l_shipdate").alias("bar_at")).distinct()
    grid = days.crossJoin(F.broadcast(m.select("event_code").distinct()))  # a handful of codes
    got = asof.asof_backward(grid, m.withColumn("released_at", F.col("released_at").cast("timestamp")), ["event_code"], "bar_at", "released_at", ["release_id", "actual_value", "change"], ["release_id"], "year")
    return got.select("event_code", a.stamp("bar_at").alias("bar_at"), "release_id", r6("actual_value").alias("actual_value"), r6("change").alias("change"))


ORACLE["macro_asof"] = f"""WITH {a.MACRO}, days AS (SELECT DISTINCT date_trunc('day', l_shipdate) AS bar_at FROM lineitem),
  codes AS (SELECT DISTINCT event_code FROM macro), diff AS (SELECT event_code, released_at, release_id, actual_value,
    actual_value - lag(actual_value) OVER (PARTITION BY event_code ORDER BY released_at, release_id) AS change,
    row_number() OVER (PARTITION BY event_code, released_at ORDER BY release_id DESC) AS rn FROM macro),
  one AS (SELECT * FROM diff WHERE rn = 1), grid AS (SELECT bar_at, event_code FROM days CROSS JOIN codes)
SELECT g.event_code, {t('g.bar_at')} AS bar_at, o.release_id, round(o.actual_value, 6) AS actual_value, round(o.change, 6) AS change
FROM grid g ASOF LEFT JOIN one o ON g.event_code = o.event_code AND g.bar_at >= o.released_at"""


@query(f"""WITH {a.BARS}, {a.OPINIONS}
SELECT o.opinion_id, {t('b.open_time')} AS entry_at, b.open AS entry FROM opinions o ASOF LEFT JOIN bars b ON o.instrument = b.instrument AND o.effective_at < b.open_time""")
def strict_entry(spark, d):
    b = a.bars_1h(spark, d).withColumnRenamed("open", "entry")
    o = a.opinions(spark, d).withColumn("effective_at", F.col("effective_at").cast("timestamp"))
    got = asof.asof_forward_strict(o, b, ["instrument"], "effective_at", "open_time", ["open_time", "entry"], ["open_time"], "week")
    return got.select("opinion_id", a.stamp("open_time").alias("entry_at"), "entry")


@query(f"""WITH {a.BARS}, {a.OPINIONS}
SELECT b.instrument, {t('b.close_time')} AS close_time, count(*) FILTER (WHERE o.stance = 'LONG') AS n_LONG, count(*) FILTER (WHERE o.stance = 'SHORT') AS n_SHORT,
  {t('max(o.effective_at)')} AS newest_mark, {t('max(o.effective_at + to_minutes(opinion_id % 90))')} AS newest_known
  FROM bars b LEFT JOIN opinions o ON o.instrument = b.instrument AND o.effective_at <= b.close_time
  AND o.effective_at > b.close_time - INTERVAL 4 HOUR AND o.effective_at + to_minutes(opinion_id % 90) <= b.close_time GROUP BY b.instrument, b.close_time""")
def marks_before_close(spark, d):
    b = a.bars_1h(spark, d).select("instrument", "close_time")
    o = a.opinions(spark, d).select("instrument", "stance", F.col("effective_at").cast("timestamp").alias("effective_at"),
                                    F.expr("timestampadd(MINUTE, cast(opinion_id % 90 as int), effective_at)").cast("timestamp").alias("known_at"))
    got = asof.interval_counts(b, o, "close_time", "effective_at", 4 * 3600, "stance", ["LONG", "SHORT"], known_col="known_at", key=["instrument"])
    return got.select("instrument", a.stamp("close_time").alias("close_time"), "n_LONG", "n_SHORT", a.stamp("newest_mark").alias("newest_mark"),
                      a.stamp("newest_known").alias("newest_known"))


@query()
def macro_vintages(spark, d):
    m = a.macro(spark, d).groupBy("event_code", "country", "event_at", "released_at").agg(
        F.max(F.struct("release_id", "vintage_end_at", "actual_value")).alias("r")).select("event_code", "country", "event_at", "released_at", "r.*")
    got = asof.vintage_asof(m, ["event_code", "country", "event_at"], F.expr("timestamp_ntz'1996-06-15 00:00:00'"))
    return got.select("event_code", "country", a.stamp("event_at").alias("event_at"), "release_id", "actual_value")


ORACLE["macro_vintages"] = f"""WITH {a.MACRO}, one AS (SELECT * FROM macro QUALIFY row_number() OVER (PARTITION BY event_code, country, event_at, released_at ORDER BY release_id DESC) = 1),
  newest AS (SELECT * FROM one WHERE released_at <= TIMESTAMP '1996-06-15' QUALIFY row_number() OVER (PARTITION BY event_code, country, event_at ORDER BY released_at DESC) = 1)
SELECT event_code, country, {t('event_at')} AS event_at, release_id, actual_value FROM newest WHERE vintage_end_at IS NULL OR vintage_end_at > TIMESTAMP '1996-06-15'"""


@query("""SELECT c.c_custkey, count(*) AS n FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
WHERE o.o_orderdate >= TIMESTAMP '1994-01-01' + to_days(CAST(c_nationkey * 20 AS INTEGER)) AND (c_custkey % 3 = 0 OR o.o_orderdate < TIMESTAMP '1997-01-01') GROUP BY ALL""")
def rows_in_authorised_window(spark, d):
    c = a.table(spark, d, "customer").select("c_custkey", F.expr("timestampadd(DAY, c_nationkey * 20, timestamp_ntz'1994-01-01 00:00:00')").alias("valid_from"),
                                             F.when(F.col("c_custkey") % 3 != 0, F.expr("timestamp_ntz'1997-01-01 00:00:00'")).alias("expires_at"))
    o = a.table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return asof.range_join(o, c, "c_custkey", "o_orderdate", "valid_from", "expires_at").groupBy("c_custkey").agg(F.count(F.lit(1)).alias("n"))


_NUMBERED = f"""{_SEGMENTS}, num AS (SELECT instrument, segment, open_time, open, high, low, close, volume, row_number() OVER w AS i, lag(high) OVER w AS ph, lag(low) OVER w AS pl, lag(close) OVER w AS pc
    FROM seg WINDOW w AS (PARTITION BY instrument, segment ORDER BY open_time))"""
_MEAN = "CASE WHEN y.{0} IS NULL THEN x.{1} ELSE {2} * x.{1} + (1 - {2}) * y.{0} END"
_STEP = {"e20": ("close", "2.0::DOUBLE / 21"), "e60": ("close", "2.0::DOUBLE / 61"), "fast": ("close", "2.0::DOUBLE / 13"), "slow": ("close", "2.0::DOUBLE / 27"),
         **{m: (x, "1.0::DOUBLE / 14") for m, x in (("atr", "tr"), ("mp", "plus"), ("mm", "minus"), ("mg", "gain"), ("ml", "loss"))}}
#: A second recursion, over what the first one gives: the mean of the directional index and the signal line.
_LATER = {"adx": ("dx", "1.0::DOUBLE / 14"), "sig": ("macd", "2.0::DOUBLE / 10")}


#: Every indicator by recursion over the bars of a segment.
INDICATORS = f"""{_NUMBERED},
  x AS (SELECT *, CASE WHEN pc IS NULL THEN high - low ELSE greatest(high - low, abs(high - pc), abs(low - pc)) END AS tr,
    CASE WHEN high - ph > pl - low AND high - ph > 0 THEN high - ph ELSE 0 END AS plus, CASE WHEN pl - low > high - ph AND pl - low > 0 THEN pl - low ELSE 0 END AS minus,
    CASE WHEN pc IS NOT NULL THEN greatest(close - pc, 0) END AS gain, CASE WHEN pc IS NOT NULL THEN greatest(pc - close, 0) END AS loss FROM num),
  y AS (SELECT instrument, segment, i, {', '.join(f'CAST({x} AS DOUBLE) AS {m}' for m, (x, _) in _STEP.items())} FROM x WHERE i = 1
    UNION ALL SELECT x.instrument, x.segment, x.i, {', '.join(_MEAN.format(m, x, f'({a_})') for m, (x, a_) in _STEP.items())}
    FROM y JOIN x ON x.instrument = y.instrument AND x.segment = y.segment AND x.i = y.i + 1),
  z AS (SELECT x.*, y.* EXCLUDE (instrument, segment, i), atr / close AS pct, CASE WHEN x.i >= 26 THEN fast - slow END AS macd,
    CASE WHEN x.i >= 14 AND mp + mm <> 0 AND atr <> 0 THEN 100 * abs(mp - mm) / (mp + mm) END AS dx FROM x JOIN y USING (instrument, segment, i)),
  r AS (SELECT instrument, segment, i, dx AS adx, macd AS sig, (dx IS NOT NULL)::INT AS n FROM z WHERE i = 1
    UNION ALL SELECT x.instrument, x.segment, x.i, {', '.join(f'CASE WHEN x.{x} IS NULL THEN y.{m} ELSE {_MEAN.format(m, x, f"({a_})")} END' for m, (x, a_) in _LATER.items())}, y.n + (x.dx IS NOT NULL)::INT
    FROM r y JOIN z x ON x.instrument = y.instrument AND x.segment = y.segment AND x.i = y.i + 1),
  k AS (SELECT b.instrument, b.segment, b.i, count(*) FILTER (WHERE c.pct <= b.pct) / 60 AS rank FROM z b JOIN z c ON c.instrument = b.instrument AND c.segment = b.segment AND c.i BETWEEN b.i - 59 AND b.i
    WHERE b.i >= 73 GROUP BY ALL)"""


INDICATORS = INDICATORS.replace(a.BARS, a.BARS_ALL)


@query(f"""WITH RECURSIVE {INDICATORS}
SELECT instrument, {t('open_time')} AS open_time, round(CASE WHEN i >= 20 THEN e20 END, 4) AS ema_20, round(CASE WHEN i >= 60 THEN e60 END, 4) AS ema_60,
  round(CASE WHEN i >= 24 THEN e20 / lag(e20, 4) OVER w - 1 END, 6) AS ema_20_slope_4, round(CASE WHEN i >= 64 THEN e60 / lag(e60, 4) OVER w - 1 END, 6) AS ema_60_slope_4,
  round(CASE WHEN i >= 14 THEN pct END, 6) AS atr_14_pct, round(CASE WHEN n >= 14 THEN adx END, 4) AS adx_14, round(rank, 6) AS atr_pct_rank_60,
  round(CASE WHEN i >= 15 THEN CASE WHEN ml = 0 AND mg = 0 THEN 50 WHEN ml = 0 THEN 100 ELSE 100 - 100 / (1 + mg / ml) END END, 4) AS rsi_14,
  round(CASE WHEN i >= 34 THEN (macd - sig) / close END, 6) AS macd_hist
FROM z JOIN r USING (instrument, segment, i) LEFT JOIN k USING (instrument, segment, i) WINDOW w AS (PARTITION BY instrument, segment ORDER BY i)""")
def technical_indicators(spark, d):
    """Every indicator of every bar; each segment begins anew."""
    from ..operators import indicators

    out = indicators.indicators(bars.segments(a.bars_all(spark, d)))
    short = {"ema_20", "ema_60", "adx_14", "rsi_14"}
    return out.select("instrument", a.stamp("open_time").alias("open_time"), *[F.round(c, 4 if c in short else 6).alias(c) for c in indicators.INDICATORS])


_LABEL = "CASE WHEN close > open AND volume % 4 > 0 THEN 'TREND_UP' WHEN volume % 3 = 0 THEN 'TREND_DOWN' WHEN volume % 41 = 5 THEN 'UNKNOWN' ELSE 'RANGE' END"


@query(f"""WITH RECURSIVE {_NUMBERED}, x AS (SELECT *, {_LABEL} AS r FROM num),
  y AS (SELECT instrument, segment, i, r AS active, CASE WHEN r = 'UNKNOWN' THEN 0 ELSE 1 END AS held, 'UNKNOWN' AS pending, 0 AS n FROM x WHERE i = 1
    UNION ALL SELECT instrument, segment, i, CASE WHEN fresh THEN r ELSE active END, CASE WHEN r = 'UNKNOWN' THEN 0 WHEN fresh THEN 1 ELSE held + 1 END,
      CASE WHEN fresh OR keeps THEN 'UNKNOWN' ELSE r END, CASE WHEN fresh OR keeps THEN 0 ELSE count_ END FROM (
      SELECT *, r = 'UNKNOWN' OR active = 'UNKNOWN' OR (NOT keeps AND count_ >= 2) AS fresh FROM (
        SELECT x.instrument, x.segment, x.i, x.r, y.active, y.held, x.r = y.active OR y.held < 5 AS keeps, CASE WHEN x.r = y.pending THEN y.n + 1 ELSE 1 END AS count_
        FROM y JOIN x ON x.instrument = y.instrument AND x.segment = y.segment AND x.i = y.i + 1)))
SELECT instrument, {t('open_time')} AS open_time, r AS raw_regime, active AS regime FROM y JOIN x USING (instrument, segment, i)""")
def smoothed_labels(spark, d):
    """Labels of the bars' own columns, smoothed by the automaton (held for 5 bars, 2 to confirm) over chunks of a day."""
    from ..operators import regime

    seg = bars.segments(a.bars_1h(spark, d)).withColumn("raw_regime", F.expr(_LABEL))
    out = regime.smoothed(seg.select("instrument", "segment", "open_time", "raw_regime"), hold=5, confirm=2, chunk_seconds=86_400)
    return out.select("instrument", a.stamp("open_time").alias("open_time"), "raw_regime", "regime")
