"""Queries over posts, opinions, annotations, runs and evidence, each with its DuckDB statement."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import annotation, bars, evidence, health, indicators, labels, propagation, regime, skill, store, windows
from . import adapters as a
from . import market

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f
    return add


r6 = lambda c: F.round(c, 6).alias(c)
T = lambda c: f"strftime({c}, '%Y-%m-%d %H:%M:%S')"

_SIGN = "CASE stance WHEN 'LONG' THEN 1 WHEN 'SHORT' THEN -1 WHEN 'FLAT' THEN 0 END"
_LABELS = f"""{a.BARS}, {a.OPINIONS}, b4 AS (SELECT instrument, time_bucket(INTERVAL 4 HOUR, open_time) AS open_time, arg_min(open, open_time) AS open,
    arg_max(close, open_time) AS close, count(*) AS n FROM bars GROUP BY ALL HAVING count(*) = 4),
  tf AS (SELECT instrument, '1h' AS timeframe, 3600 AS len, open_time, open_time + INTERVAL 1 HOUR AS exit_at, open, close FROM bars
    UNION ALL SELECT instrument, '4h', 14400, open_time, open_time + INTERVAL 4 HOUR, open, close FROM b4),
  o AS (SELECT *, unnest(CASE WHEN horizon IS NULL THEN ['1h', '4h', '1d'] ELSE [horizon] END) AS timeframe,
    CASE WHEN horizon IS NULL THEN 'grid' ELSE 'stated' END AS horizon_source FROM opinions),
  j AS (SELECT o.*, b.open_time AS entry_at, b.exit_at, b.open AS entry, b.close AS exit,
    CASE o.timeframe WHEN '15m' THEN 900 WHEN '30m' THEN 1800 WHEN '1h' THEN 3600 WHEN '4h' THEN 14400 WHEN '1d' THEN 86400 END AS len
    FROM o ASOF LEFT JOIN tf b ON o.instrument = b.instrument AND o.timeframe = b.timeframe AND o.effective_at < b.open_time),
  lab AS (SELECT *, CASE WHEN NOT trusted THEN 'UNTRUSTED_COLLECTION_TIME' WHEN instrument IS NULL THEN 'MISSING_INSTRUMENT' WHEN {_SIGN} IS NULL THEN 'UNKNOWN_STANCE'
    WHEN entry_at IS NULL THEN 'NO_ENTRY_BAR' WHEN epoch(entry_at) - floor(epoch(effective_at)) > 2 * len THEN 'ENTRY_LAG_EXCEEDED'
    WHEN epoch(exit_at) - epoch(entry_at) <> len THEN 'GAP_IN_HORIZON' ELSE 'LABELED' END AS status FROM j),
  labels AS (SELECT *, CASE WHEN status = 'LABELED' THEN ln(exit / entry) END AS log_return, CASE WHEN status = 'LABELED' THEN {_SIGN} END AS dir,
    CASE WHEN status = 'LABELED' THEN sign(ln(exit / entry)) = {_SIGN} END AS hit FROM lab)"""


def _labels(spark, d):
    b1 = a.bars_1h(spark, d)
    b4, _ = bars.complete_bars(b1, 3600, 14400)
    tf = b1.select("instrument", F.lit("1h").alias("timeframe"), "open_time", "close_time", "open", "close").unionByName(
        b4.select("instrument", F.lit("4h").alias("timeframe"), "open_time", (F.col("open_time") + F.expr("interval 4 hours")).alias("close_time"), "open", "close"))
    return labels.opinion_labels(a.opinions(spark, d), tf)


@query(f"WITH {_LABELS} SELECT opinion_id, timeframe AS horizon, horizon_source, status, CASE WHEN status = 'LABELED' THEN {T('entry_at')} END AS entry_at, round(log_return, 6) AS log_return, dir AS stance_direction, hit AS direction_hit FROM labels")
def opinion_labels(spark, d):
    return _labels(spark, d).select("opinion_id", "horizon", "horizon_source", "status", a.stamp("entry_at").alias("entry_at"), r6("log_return"), "stance_direction", "direction_hit")


_AS_OF = "TIMESTAMP '2024-01-25'"
_SKILL = f"""{_LABELS}, s AS (SELECT opinion_id * 10 + CASE timeframe WHEN '1h' THEN 1 ELSE 2 END AS opinion_id, author_id % 25 AS author_id, effective_at, dir, hit, log_return, confidence
    FROM labels WHERE status = 'LABELED' AND dir IS NOT NULL AND effective_at <= {_AS_OF}),
  n AS (SELECT *, row_number() OVER (PARTITION BY author_id ORDER BY confidence, effective_at, opinion_id) - 1 AS i, count(*) OVER (PARTITION BY author_id) AS m FROM s),
  b AS (SELECT *, (i >= round_even(m * 1 / 5.0, 0))::INT + (i >= round_even(m * 2 / 5.0, 0))::INT + (i >= round_even(m * 3 / 5.0, 0))::INT + (i >= round_even(m * 4 / 5.0, 0))::INT AS bin FROM n),
  e AS (SELECT author_id, bin, count(*) AS k, avg(confidence) AS c, avg(hit::INT) AS h FROM b GROUP BY ALL),
  cal AS (SELECT author_id, CASE WHEN sum(k) >= 10 THEN 1 - sum(k * abs(c - h)) / sum(k) END AS calibration FROM e GROUP BY ALL)"""


@query(f"""WITH {_SKILL}, g AS (SELECT author_id, count(*) FILTER (WHERE hit) AS hits, count(*) AS trials, avg(CASE WHEN hit THEN log_return * dir END) AS mg,
    avg(CASE WHEN hit THEN (log_return * dir > 0.001)::INT END) AS sa FROM s GROUP BY ALL)
SELECT author_id, hits, trials, round(hits / trials, 6) AS raw, round((hits + 1) / (trials + 2), 6) AS posterior, round(CASE WHEN hits >= 30 THEN mg END, 6) AS mean_gain,
  round(CASE WHEN hits >= 30 THEN sa END, 6) AS share_above, round(calibration, 6) AS calibration, trials >= 30 AS ready FROM g LEFT JOIN cal USING (author_id)""")
def author_skill(spark, d):
    s = skill.label_samples(_labels(spark, d).withColumn("opinion_id", F.col("opinion_id") * 10 + F.when(F.col("horizon") == "1h", 1).otherwise(2)))
    s = s.withColumn("author_id", F.col("author_id") % 25)
    out = skill.author_skill(s, F.expr("timestamp'2024-01-25 00:00:00'"))
    return out.select("author_id", "hits", "trials", *[r6(c) for c in ("raw", "posterior", "mean_gain", "share_above", "calibration")], "ready")


def _rank(c, by):
    return f"rank() OVER (PARTITION BY {by} ORDER BY {c}) + (count(*) OVER (PARTITION BY {by}, {c}) - 1) / 2.0"


_SIG = f"""{a.BARS}, x AS (SELECT instrument, open_time, volume AS sig, ln(lead(close, 4) OVER w / lead(open, 1) OVER w) AS ret, row_number() OVER w - 1 AS i
    FROM bars WINDOW w AS (PARTITION BY instrument ORDER BY open_time)), k AS (SELECT *, i // 48 AS win FROM x WHERE ret IS NOT NULL)"""


def _signals(spark, d):
    b = labels.simple_label(a.bars_1h(spark, d), ["instrument"], 4)
    from pyspark.sql import Window

    i = F.row_number().over(Window.partitionBy("instrument").orderBy("open_time")) - 1
    return b.select("instrument", "open_time", F.col("volume").alias("sig"), F.col("label").alias("ret"), i.alias("i")).where("ret is not null").withColumn("win", F.floor(F.col("i") / 48))


@query(f"""WITH {_SIG}, r AS (SELECT *, {_rank('sig', 'instrument')} AS rx, {_rank('ret', 'instrument')} AS ry FROM k)
SELECT instrument, count(*) AS n, round(corr(rx, ry), 6) AS ic FROM r GROUP BY instrument""")
def spearman_ic(spark, d):
    return skill.spearman(_signals(spark, d), ["instrument"], "sig", "ret").select("instrument", "n", r6("ic"))


@query(f"""WITH {_SIG}, r AS (SELECT *, {_rank('sig', 'instrument, win')} AS rx, {_rank('ret', 'instrument, win')} AS ry FROM k),
  w AS (SELECT instrument, win, CASE WHEN count(*) >= 10 AND var_pop(rx) > 0 AND var_pop(ry) > 0 THEN corr(rx, ry) END AS ic FROM r GROUP BY ALL)
SELECT instrument, count(ic) AS windows, round(avg(ic), 6) AS ic_mean, round(stddev_samp(ic), 6) AS ic_std, round(avg(ic) / stddev_samp(ic), 6) AS icir,
  round(avg((ic > 0)::INT), 6) AS positive_ratio, 'EVALUATED' AS scoring FROM w GROUP BY instrument""")
def window_ic(spark, d):
    w = skill.window_ic(_signals(spark, d), ["instrument"], "win", "sig", "ret")
    return w.select("instrument", "windows", *[r6(c) for c in ("ic_mean", "ic_std", "icir", "positive_ratio")], "scoring")


_Z = 1.959963984540054


@query(f"""WITH {_SIG}, g AS (SELECT instrument, count(*) FILTER (WHERE ret > 0) AS h, count(*) AS n, avg((sig % 10 / 10.0 - (ret > 0)::INT) ** 2) AS b FROM k GROUP BY ALL)
SELECT instrument, h AS hits, n, round(b, 6) AS brier, round(h / n, 6) AS hit_rate,
  round(((h / n + {_Z**2} / (2 * n)) / (1 + {_Z**2} / n)) - {_Z} / (1 + {_Z**2} / n) * sqrt((h / n) * (1 - h / n) / n + {_Z**2} / (4 * n * n)), 6) AS wilson_low,
  round(((h / n + {_Z**2} / (2 * n)) / (1 + {_Z**2} / n)) + {_Z} / (1 + {_Z**2} / n) * sqrt((h / n) * (1 - h / n) / n + {_Z**2} / (4 * n * n)), 6) AS wilson_high FROM g""")
def signal_metrics(spark, d):
    s = _signals(spark, d).withColumn("hit", F.col("ret") > 0).withColumn("p", F.col("sig") % 10 / F.lit(10.0))
    m = skill.signal_metrics(s, ["instrument"], "p", "hit", "sig", "ret")
    return m.select("instrument", "hits", "n", *[r6(c) for c in ("brier", "hit_rate", "wilson_low", "wilson_high")])


@query(f"""WITH {_SIG}, g AS (SELECT instrument, count(*) AS n, count(*) FILTER (WHERE ret > 0) AS h FROM k GROUP BY ALL UNION ALL SELECT instrument || '/' || win, count(*), count(*) FILTER (WHERE ret > 0) FROM k GROUP BY instrument, win),
  u AS (SELECT instrument, n, h, unnest(range(h, n + 1)) AS i FROM g)
SELECT instrument AS series, h AS hits, n, round(sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2))), 8) AS p FROM u GROUP BY ALL""")
def binomial_tails(spark, d):
    """Exact one-sided p-value of the hits of each instrument and of each of its windows."""
    s = _signals(spark, d)
    counts = [s.groupBy(k.alias("series")).agg(F.count_if(F.col("ret") > 0).alias("hits"), F.count(F.lit(1)).alias("n"))
              for k in (F.col("instrument"), F.concat_ws("/", "instrument", F.col("win").cast("string")))]
    return counts[0].unionByName(counts[1]).withColumn("p", F.round(skill.binomial_p("hits", "n"), 8))


@query(f"""WITH {_SIG}, g AS (SELECT instrument, count(*) FILTER (WHERE ret > 0) AS h, count(*) AS n FROM k GROUP BY ALL), u AS (SELECT instrument, n, h, unnest(range(h, n + 1)) AS i FROM g),
  pv AS (SELECT instrument, h / n AS hit_rate, sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2))) AS p_value FROM u GROUP BY instrument, h, n),
  r AS (SELECT *, {_rank('sig', 'instrument')} AS rx, {_rank('ret', 'instrument')} AS ry FROM k), i1 AS (SELECT instrument, corr(rx, ry) AS ic FROM r GROUP BY instrument),
  r2 AS (SELECT *, {_rank('sig', 'instrument, win')} AS rx, {_rank('ret', 'instrument, win')} AS ry FROM k),
  w AS (SELECT instrument, win, CASE WHEN count(*) >= 10 AND var_pop(rx) > 0 AND var_pop(ry) > 0 THEN corr(rx, ry) END AS ic FROM r2 GROUP BY ALL),
  i2 AS (SELECT instrument, avg(ic) / stddev_samp(ic) AS icir FROM w GROUP BY instrument)
SELECT instrument, round(ic, 6) AS ic, round(icir, 6) AS icir, round(hit_rate, 6) AS hit_rate, round(p_value, 8) AS p_value,
  CASE WHEN (ic >= 0.03 AND icir >= 0.3) OR (hit_rate > 0.5 AND p_value < 0.05) THEN 'PASS' ELSE 'FAIL' END AS gate FROM pv JOIN i1 USING (instrument) JOIN i2 USING (instrument)""")
def signal_gate(spark, d):
    s = _signals(spark, d).withColumn("hit", F.col("ret") > 0).withColumn("p", F.col("sig") % 10 / F.lit(10.0))
    m = skill.signal_metrics(s, ["instrument"], "p", "hit", "sig", "ret").join(skill.window_ic(s, ["instrument"], "win", "sig", "ret").select("instrument", "icir", "t"), "instrument")
    return skill.signal_gate(m).select("instrument", r6("ic"), r6("icir"), r6("hit_rate"), F.round("p_value", 8).alias("p_value"), "gate")


@query(f"WITH {_SIG} SELECT instrument, least(floor(sig % 10 / 10.0 * 10), 9)::BIGINT AS bin, count(*) AS n, round(avg(sig % 10 / 10.0), 6) AS mean_p, round(avg((ret > 0)::INT), 6) AS hit_rate FROM k GROUP BY ALL")
def reliability_table(spark, d):
    s = _signals(spark, d).withColumn("hit", F.col("ret") > 0).withColumn("p", F.col("sig") % 10 / F.lit(10.0))
    return skill.reliability(s, ["instrument"], "p", "hit").select("instrument", F.col("bin").cast("long").alias("bin"), "n", r6("mean_p"), r6("hit_rate"))


@query(f"""WITH {_SIG}, t0 AS (SELECT instrument, win, count(*) FILTER (WHERE ret > 0) AS h FROM k GROUP BY instrument, win), t AS (SELECT instrument, win, CASE WHEN win % 7 <> 3 THEN (h * 7 % 100) / 100.0 END AS p FROM t0),
  r AS (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY p, win) AS r, count(*) OVER (PARTITION BY instrument) AS m FROM t WHERE p IS NOT NULL)
SELECT instrument, win, p, round(least(min(p * m / r) OVER (PARTITION BY instrument ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1.0), 6) AS q FROM r
UNION ALL SELECT instrument, win, NULL, NULL FROM t WHERE p IS NULL""")
def q_values(spark, d):
    t = _signals(spark, d).groupBy("instrument", "win").agg(F.count_if(F.col("ret") > 0).alias("h"))
    t = t.select("instrument", "win", F.when(F.col("win") % 7 != 3, F.col("h") * 7 % 100 / F.lit(100.0)).alias("p"))
    return windows.q_values(t, ["instrument"], "p", ["win"]).select("instrument", "win", "p", r6("q"))


@query(f"""WITH {a.BARS}, n AS (SELECT instrument, open_time, count(*) OVER (PARTITION BY instrument) AS n, row_number() OVER (PARTITION BY instrument ORDER BY open_time) - 1 AS i FROM bars)
SELECT instrument, CASE WHEN n < 500 THEN NULL WHEN i BETWEEN floor(n * 0.6) AND floor(n * 0.6) + 23 OR i BETWEEN floor(n * 0.8) AND floor(n * 0.8) + 23 THEN 'embargo'
  WHEN i >= floor(n * 0.8) THEN 'test' WHEN i >= floor(n * 0.6) THEN 'validation' ELSE 'train' END AS part, count(*) AS n FROM n GROUP BY ALL""")
def time_split(spark, d):
    return windows.time_split(a.bars_1h(spark, d), ["instrument"], [F.col("open_time")], 24, strict=False).groupBy("instrument", "part").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {a.BARS}, c AS (SELECT instrument, count(*) AS n, CAST(floor(count(*) * 0.5) AS BIGINT) AS s FROM bars GROUP BY ALL),
  w AS (SELECT instrument, n, s + k * 100 AS b, least(s + k * 100 + 100, n) AS e, k FROM c, range(0, 100000) r(k) WHERE s + k * 100 < n)
SELECT instrument, k AS "window", greatest(b - 24, 0) AS train_end, e - b AS n, greatest(b - 24, 0) >= 200 AND e - b >= 30 AS used FROM w""")
def walk_forward_windows(spark, d):
    w = windows.walk_forward(a.bars_1h(spark, d), ["instrument"], [F.col("open_time")], 0.5, 100, 24, 200, 30)
    return w.groupBy("instrument", "window", "train_end", "used").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {a.BARS}, n AS (SELECT instrument, open_time, row_number() OVER (PARTITION BY instrument ORDER BY open_time) - 1 AS i FROM bars) SELECT instrument, {T('open_time')} AS open_time FROM n WHERE i % 24 = 0")
def non_overlapping_rows(spark, d):
    return windows.every_nth(a.bars_1h(spark, d), ["instrument"], [F.col("open_time")], 24).select("instrument", a.stamp("open_time").alias("open_time"))


@query(f"""WITH RECURSIVE {a.BARS}, n AS (SELECT instrument, close, open_time, row_number() OVER (PARTITION BY instrument ORDER BY open_time) AS i FROM bars),
  y AS (SELECT instrument, i, close AS y FROM n WHERE i = 1 UNION ALL SELECT n.instrument, n.i, (2.0 / 21) * n.close + (1 - 2.0 / 21) * y.y FROM y JOIN n ON n.instrument = y.instrument AND n.i = y.i + 1)
SELECT n.instrument, {T('n.open_time')} AS open_time, round(CASE WHEN n.i >= 20 THEN y.y END, 6) AS ema_20 FROM n JOIN y USING (instrument, i)""")
def ema_20(spark, d):
    e = indicators.ewm_mean(a.bars_1h(spark, d), ["instrument"], "open_time", "close", 2 / 21, "ema_20", 20)
    return e.select("instrument", a.stamp("open_time").alias("open_time"), r6("ema_20"))


def _regimes(spark, d):
    """Regimes of the bars, with great sign-ups as news and the greatest purchases as macro releases."""
    e = a.table(spark, d, "events")
    kind = F.when((F.col("event_type") == "signup") & (F.col("value") > 100), "news").when((F.col("event_type") == "purchase") & (F.col("value") > 200), "macro")
    at = F.col("ts").cast("timestamp")
    return regime.regime_run(a.bars_all(spark, d), e.select(at.alias("mark_at"), at.alias("known_at"), kind.alias("kind")).where("kind is not null"))


#: Indicators by recursion, marks of the four hours before a close, the first rule that fits, and its smoothing by recursion.
_REGIME = f"""{market.INDICATORS}, mk AS (SELECT ts AS at_, event_type = 'signup' AS news FROM events WHERE event_type = 'signup' AND value > 100 OR event_type = 'purchase' AND value > 200),
  ind AS (SELECT z.instrument, z.segment, z.i, z.open_time, z.open_time + INTERVAL 1 HOUR AS close_time, close, CASE WHEN i >= 20 THEN e20 END AS e20, CASE WHEN i >= 60 THEN e60 END AS e60,
    CASE WHEN i >= 24 THEN e20 / lag(e20, 4) OVER w - 1 END AS s20, CASE WHEN i >= 64 THEN e60 / lag(e60, 4) OVER w - 1 END AS s60, CASE WHEN i >= 14 THEN pct END AS pct, CASE WHEN n >= 14 THEN adx END AS adx, rank
    FROM z JOIN r USING (instrument, segment, i) LEFT JOIN k USING (instrument, segment, i) WINDOW w AS (PARTITION BY instrument, segment ORDER BY i)),
  seen AS (SELECT ind.instrument, ind.open_time, count(*) FILTER (WHERE news) AS nn, count(*) FILTER (WHERE NOT news) AS nm, max(at_) AS newest FROM ind JOIN mk ON at_ <= close_time AND at_ > close_time - INTERVAL 4 HOUR GROUP BY ALL),
  f AS (SELECT ind.*, coalesce(nn, 0) AS nn, coalesce(nm, 0) AS nm, newest, e20 IS NULL OR e60 IS NULL OR s20 IS NULL OR s60 IS NULL OR pct IS NULL OR adx IS NULL OR rank IS NULL AS lacks FROM ind LEFT JOIN seen USING (instrument, open_time)),
  raw AS (SELECT *, CASE WHEN lacks THEN 'UNKNOWN' WHEN nn >= 3 OR nm >= 1 THEN 'NEWS_DRIVEN' WHEN rank >= 0.8 THEN 'HIGH_VOLATILITY' WHEN adx >= 25 AND e20 > e60 AND s20 > 0 AND s60 > 0 THEN 'TREND_UP'
      WHEN adx >= 25 AND e20 < e60 AND s20 < 0 AND s60 < 0 THEN 'TREND_DOWN' WHEN adx < 20 THEN 'RANGE' WHEN rank <= 0.2 THEN 'LOW_VOLATILITY' ELSE 'RANGE' END AS raw_regime,
    CASE WHEN lacks THEN 0 WHEN nn >= 3 OR nm >= 1 THEN least(1, 0.7 + 0.1 * nn + 0.2 * nm) WHEN rank >= 0.8 THEN rank WHEN adx >= 25 AND (e20 > e60 AND s20 > 0 AND s60 > 0 OR e20 < e60 AND s20 < 0 AND s60 < 0) THEN least(1, adx / 50)
      WHEN adx < 20 THEN greatest(0.5, 1 - adx / 40) WHEN rank <= 0.2 THEN 1 - rank ELSE 0.55 END AS confidence,
    CASE WHEN rank IS NULL THEN 'UNKNOWN' WHEN nn >= 3 OR nm >= 1 THEN 'NEWS_DRIVEN' WHEN rank >= 0.8 THEN 'HIGH_VOLATILITY' WHEN adx >= 22 AND (e20 - e60) / (close * pct) >= 0.5 AND s20 > 0 THEN 'TREND_UP'
      WHEN adx >= 22 AND (e20 - e60) / (close * pct) <= -0.5 AND s20 < 0 THEN 'TREND_DOWN' WHEN adx < 20 THEN 'RANGE' WHEN rank <= 0.2 THEN 'LOW_VOLATILITY' ELSE 'RANGE' END AS stat FROM f),
  sm AS (SELECT instrument, segment, i, raw_regime AS active, CASE WHEN raw_regime = 'UNKNOWN' THEN 0 ELSE 1 END AS held, 'UNKNOWN' AS pending, 0 AS n FROM raw WHERE i = 1
    UNION ALL SELECT instrument, segment, i, CASE WHEN fresh THEN g ELSE active END, CASE WHEN g = 'UNKNOWN' THEN 0 WHEN fresh THEN 1 ELSE held + 1 END, CASE WHEN fresh OR keeps THEN 'UNKNOWN' ELSE g END, CASE WHEN fresh OR keeps THEN 0 ELSE count_ END FROM (
      SELECT *, g = 'UNKNOWN' OR active = 'UNKNOWN' OR (NOT keeps AND count_ >= 3) AS fresh FROM (
        SELECT raw.instrument, raw.segment, raw.i, raw_regime AS g, sm.active, sm.held, raw_regime = sm.active OR sm.held < 12 AS keeps, CASE WHEN raw_regime = sm.pending THEN sm.n + 1 ELSE 1 END AS count_
        FROM sm JOIN raw ON raw.instrument = sm.instrument AND raw.segment = sm.segment AND raw.i = sm.i + 1))),
  st AS (SELECT raw.*, active AS regime, max(greatest(close_time, coalesce(newest, close_time))) OVER (PARTITION BY raw.instrument, raw.segment ORDER BY raw.i) AS available FROM raw JOIN sm USING (instrument, segment, i))"""


@query(f"WITH RECURSIVE {_REGIME} SELECT instrument, {T('open_time')} AS open_time, raw_regime, regime, stat AS stat_regime, round(confidence, 6) AS confidence, {T('available')} AS available_at FROM st")
def regime_states(spark, d):
    """What the rules, the smoothing and the statistics say of every bar."""
    return _regimes(spark, d).select("instrument", a.stamp("open_time").alias("open_time"), "raw_regime", "regime", "stat_regime", r6("confidence"), a.stamp("available_at").alias("available_at"))


@query()
def regime_labels(spark, d):
    return _regimes(spark, d).select("instrument", a.stamp("open_time").alias("open_time"), "segment", "raw_regime", "regime", r6("confidence"), "prefix_hash")


_NAMES = ["TREND_UP", "TREND_DOWN", "RANGE", "HIGH_VOLATILITY", "LOW_VOLATILITY", "NEWS_DRIVEN", "UNKNOWN"]


@query(f"""WITH RECURSIVE {_REGIME}, base AS (SELECT instrument, count(*) AS n, avg((regime = 'UNKNOWN')::INT) AS unknown_ratio, avg(CASE WHEN raw_regime <> 'UNKNOWN' THEN (raw_regime = stat)::INT END) AS agreement,
    count(*) FILTER (WHERE available > close_time) AS violations, {', '.join(f"count(*) FILTER (WHERE regime = '{x}') AS n_{x}" for x in _NAMES)} FROM st GROUP BY instrument),
  ch AS (SELECT *, (lag(regime) OVER v IS DISTINCT FROM regime OR lag(segment) OVER v IS DISTINCT FROM segment)::INT AS starts FROM st WINDOW v AS (PARTITION BY instrument ORDER BY open_time)),
  nr AS (SELECT *, sum(starts) OVER (PARTITION BY instrument ORDER BY open_time) AS run FROM ch), ru AS (SELECT instrument, run, min(regime) AS regime, count(*) AS n FROM nr GROUP BY instrument, run),
  le AS (SELECT instrument, avg(n) AS mean_run FROM ru WHERE regime <> 'UNKNOWN' GROUP BY instrument)
SELECT instrument, n, round(unknown_ratio, 6) AS unknown_ratio, round(agreement, 6) AS agreement, violations, {', '.join(f'n_{x}' for x in _NAMES)}, round(mean_run, 6) AS mean_run FROM base LEFT JOIN le USING (instrument)""")
def regime_shares(spark, d):
    """Shares, agreement, late inputs and mean length of runs, from the states of every bar."""
    m = regime.regime_metrics(_regimes(spark, d))
    return m.select("instrument", "n", r6("unknown_ratio"), r6("agreement"), "violations", *[f"n_{x}" for x in _NAMES], r6("mean_run"))


@query()
def regime_gate(spark, d):
    return regime.regime_metrics(_regimes(spark, d))


_PAT = """CASE WHEN a IS NULL AND b IS NULL AND c IS NULL THEN 'blank' WHEN a IS NOT DISTINCT FROM b AND b IS NOT DISTINCT FROM c THEN 'unanimous'
  WHEN a IS NOT DISTINCT FROM b OR a IS NOT DISTINCT FROM c OR b IS NOT DISTINCT FROM c THEN 'two_vs_one' ELSE 'three_way' END"""


@query(f"""WITH {a.CELLS}, p AS (SELECT *, {_PAT} AS pat FROM cells)
SELECT field, count(*) FILTER (WHERE pat = 'unanimous') AS unanimous, count(*) FILTER (WHERE pat = 'blank') AS blank, count(*) FILTER (WHERE pat = 'two_vs_one') AS two_vs_one,
  count(*) FILTER (WHERE pat = 'three_way') AS three_way, round(avg((a IS NOT DISTINCT FROM b)::INT), 6) AS agree_a_b, round(avg((a IS NOT DISTINCT FROM c)::INT), 6) AS agree_a_c,
  round(avg((b IS NOT DISTINCT FROM c)::INT), 6) AS agree_b_c, round(avg((a IS NULL)::INT), 6) AS blank_a, round(avg((b IS NULL)::INT), 6) AS blank_b, round(avg((c IS NULL)::INT), 6) AS blank_c
FROM p GROUP BY field""")
def annotator_agreement(spark, d):
    g = annotation.agreement(a.cells(spark, d), ["a", "b", "c"])
    return g.select(*[r6(c) if c.startswith(("agree", "blank_")) else F.col(c) for c in g.columns])


@query(f"""WITH {a.CELLS}, p AS (SELECT post_id, bool_and({_PAT} IN ('unanimous', 'blank')) AS f, bool_and({_PAT} = 'unanimous') AS s FROM cells GROUP BY ALL)
SELECT count(*) AS rows, count(*) FILTER (WHERE f) AS "full", count(*) FILTER (WHERE s) AS strict FROM p""")
def row_agreement(spark, d):
    return annotation.row_agreement(a.cells(spark, d), ["a", "b", "c"])


_TRUTH = f"""{a.CELLS}, dec AS (SELECT post_id, field, gold AS value FROM cells WHERE post_id % 3 = 0),
  m AS (SELECT cells.*, {_PAT} AS pat, CASE WHEN a IS NOT DISTINCT FROM b OR a IS NOT DISTINCT FROM c THEN a WHEN b IS NOT DISTINCT FROM c THEN b END AS maj, dec.value AS dv, dec.post_id IS NOT NULL AS d
    FROM cells LEFT JOIN dec ON cells.post_id = dec.post_id AND cells.field = dec.field),
  truth AS (SELECT post_id, field, CASE WHEN pat IN ('unanimous', 'blank') THEN maj WHEN d THEN dv WHEN pat = 'two_vs_one' THEN maj END AS value,
    CASE WHEN pat IN ('unanimous', 'blank') THEN pat WHEN d THEN 'human' WHEN pat = 'two_vs_one' THEN 'majority' ELSE 'open' END AS gold_source,
    pat = 'two_vs_one' AND d AND dv IS DISTINCT FROM maj AS overturned FROM m)"""


def _truth(spark, d):
    c = a.cells(spark, d)
    return annotation.ground_truth(c, ["a", "b", "c"], c.where("post_id % 3 = 0").select("post_id", "field", F.col("gold").alias("value")))


@query(f"WITH {_TRUTH} SELECT * FROM truth")
def ground_truth(spark, d):
    return _truth(spark, d)


@query(f"WITH {_TRUTH} SELECT field, count(*) AS cells, count(*) FILTER (WHERE gold_source <> 'open') AS settled, count(*) FILTER (WHERE overturned) AS overturned, count(*) FILTER (WHERE gold_source = 'human') AS human FROM truth GROUP BY ALL")
def truth_coverage(spark, d):
    return annotation.coverage(_truth(spark, d))


@query(f"WITH {_TRUTH} SELECT d.doc_id AS post_id, f.field FROM documents d CROSS JOIN (VALUES ('quality'), ('lang')) f(field) WHERE NOT EXISTS (SELECT 1 FROM truth t WHERE t.post_id = d.doc_id AND t.field = f.field)")
def missing_truth_cells(spark, d):
    return annotation.missing_cells(_truth(spark, d), a.posts(spark, d), ["quality", "lang"])


_OUT = """CASE WHEN gold IS NULL AND {0} IS NULL THEN 'absent' WHEN gold IS NULL THEN 'spurious' WHEN {0} IS NULL THEN 'missed' WHEN gold = {0} THEN 'correct' ELSE 'wrong' END"""
_CNT = ", ".join(f"count(*) FILTER (WHERE o = '{o}') AS {o}" for o in annotation.OUTCOMES)


def _eval(spark, d, who):
    c = a.cells(spark, d).withColumn("pred", F.col(who))
    o = F.when((F.col("post_id") % 17 == 0) & (F.col("field") == "lang"), "NOT_EVALUATED").otherwise(annotation.outcome(F.col("gold"), F.col("pred")))
    return c.withColumn("outcome", o)


_EV = lambda w: f"CASE WHEN post_id % 17 = 0 AND field = 'lang' THEN 'NOT_EVALUATED' ELSE {_OUT.format(w)} END"


@query(f"""WITH {a.CELLS}, e AS (SELECT field, {_EV('b')} AS o FROM cells), g AS (SELECT coalesce(field, '(all)') AS field, {_CNT}, count(*) FILTER (WHERE o = 'NOT_EVALUATED') AS not_evaluated,
  count(*) FILTER (WHERE o <> 'NOT_EVALUATED') AS seen FROM e GROUP BY ROLLUP (field))
SELECT field, absent, spurious, missed, correct, wrong, not_evaluated, round(coalesce(correct / nullif(missed + correct + wrong, 0), 0), 6) AS recall,
  round(coalesce(correct / nullif(correct + wrong + spurious, 0), 0), 6) AS precision, round(coalesce((correct + absent) / nullif(seen, 0), 0), 6) AS exact FROM g""")
def extractor_evaluation(spark, d):
    g = annotation.evaluation(_eval(spark, d, "b"))
    return g.select(*[r6(c) if c in ("recall", "precision", "exact") else F.col(c) for c in g.columns])


@query(f"""WITH {a.CELLS}, c2 AS (SELECT coalesce(gold, '∅') AS gold, coalesce(c, '∅') AS pred FROM cells WHERE field = 'lang')
SELECT gold, count(*) FILTER (WHERE pred = 'en') AS pred_en, count(*) FILTER (WHERE pred = 'de') AS pred_de, count(*) FILTER (WHERE pred = 'fr') AS pred_fr, count(*) FILTER (WHERE pred = 'es') AS pred_es,
  count(*) FILTER (WHERE pred = '∅') AS pred_absent FROM c2 GROUP BY gold""")
def confusion_matrix(spark, d):
    c = a.cells(spark, d).where("field = 'lang'").withColumn("pred", F.col("c"))
    return annotation.confusion(c, ["en", "de", "fr", "es"])


_CMP = f"""{a.CELLS}, ra AS (SELECT post_id, field, gold, {_EV('b')} AS o FROM cells WHERE post_id % 5 <> 0), rb AS (SELECT post_id, field, CASE WHEN post_id % 9 = 0 THEN NULL ELSE gold END AS gold, {_EV('c')} AS o FROM cells WHERE post_id % 7 <> 0),
  al AS (SELECT coalesce(ra.post_id, rb.post_id) AS post_id, coalesce(ra.field, rb.field) AS field, ra.o AS oa, rb.o AS ob, CASE WHEN rb.o IS NULL THEN 'only_in_a' WHEN ra.o IS NULL THEN 'only_in_b'
    WHEN ra.gold IS DISTINCT FROM rb.gold THEN 'gold_differs' END AS problem FROM ra FULL JOIN rb ON ra.post_id = rb.post_id AND ra.field = rb.field)"""


def _compared(spark, d):
    x, y = _eval(spark, d, "b").where("post_id % 5 <> 0"), _eval(spark, d, "c").where("post_id % 7 <> 0")
    return annotation.compare_runs(x, y.withColumn("gold", F.when(F.col("post_id") % 9 != 0, F.col("gold"))))


@query(f"WITH {_CMP} SELECT coalesce(problem, 'none') AS problem, count(*) AS n FROM al GROUP BY ALL")
def run_alignment(spark, d):
    return _compared(spark, d).groupBy(F.coalesce("problem", F.lit("none")).alias("problem")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_CMP}, r AS (SELECT *, oa IN ('correct', 'absent') AS ga, ob IN ('correct', 'absent') AS gb FROM al WHERE problem IS NULL)
SELECT post_id, field, CASE WHEN gb THEN 'fixed' ELSE 'regressed' END AS change FROM r WHERE ga <> gb""")
def changed_cells(spark, d):
    return annotation.changed_cells(_compared(spark, d))


@query(f"WITH {_TRUTH}, x AS (SELECT t.post_id, t.field, t.value AS old, c.gold AS new, c.b AS pred FROM truth t JOIN cells c ON t.post_id = c.post_id AND t.field = c.field) SELECT post_id, field, old, new, pred, pred IS NOT DISTINCT FROM old AS agreed_before, pred IS NOT DISTINCT FROM new AS agrees_now FROM x WHERE old IS DISTINCT FROM new")
def gold_changes(spark, d):
    c = a.cells(spark, d)
    return annotation.gold_changes(_truth(spark, d), c.withColumn("value", F.col("gold")), c.withColumn("pred", F.col("b")))


@query(f"""WITH {a.POSTS}, x AS (SELECT post_id, lang AS bucket, row_number() OVER (PARTITION BY lang ORDER BY n_chars, post_id) AS turn FROM posts)
SELECT post_id, bucket, turn FROM x ORDER BY turn, bucket LIMIT 60""")
def round_robin_sample(spark, d):
    p = a.posts(spark, d)
    return annotation.round_robin(p, F.col("lang"), [F.col("n_chars"), F.col("post_id")], 60).select("post_id", "bucket", "turn")


@query(f"""WITH {a.POSTS}, x AS (SELECT post_id, lang, row_number() OVER (PARTITION BY lang ORDER BY post_id) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM posts)
SELECT DISTINCT post_id, lang FROM x, range(0, 8) r(k) WHERE i = round_even(k * (n - 1) / 7.0, 0)""")
def evenly_spaced_sample(spark, d):
    return annotation.evenly_spaced(a.posts(spark, d), ["lang"], [F.col("post_id")], 8).select("post_id", "lang")


@query("""WITH RECURSIVE d AS (SELECT doc_id, coalesce(source, '') AS source, text, TIMESTAMP '2024-01-01' + to_hours(CAST(doc_id % 170 AS INTEGER)) AS seen, doc_id % 9 = 0 AS media,
    lower(trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))) AS k FROM documents WHERE trim(coalesce(text, '')) <> ''),
  p AS (SELECT *, CASE WHEN length(text) <= 50 THEN 'short' WHEN length(text) <= 200 THEN 'medium' ELSE 'long' END AS bucket, CAST(seen AS DATE) AS day, md5('42:' || doc_id) AS h
    FROM d QUALIFY row_number() OVER (PARTITION BY k ORDER BY seen, doc_id) = 1),
  t AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY h) AS turn FROM p), s AS (SELECT *, row_number() OVER (ORDER BY turn, day, h) AS i FROM t),
  c AS (SELECT count(*) AS n, least(67, count(*) FILTER (WHERE bucket = 'short')) AS n1, least(67, count(*) FILTER (WHERE bucket = 'medium')) AS n2, least(66, count(*) FILTER (WHERE bucket = 'long')) AS n3 FROM s),
  r AS (SELECT 0 AS k, MAP([''], [0]) AS src, MAP(['short', 'medium', 'long'], [0, 0, 0]) AS b, 0 AS m, CAST([] AS BIGINT[]) AS taken, CAST([] AS INTEGER[]) AS steps
    UNION ALL SELECT k + 1, CASE WHEN ok THEN map_concat(src, MAP([source], [coalesce(src[source], 0) + 1])) ELSE src END,
      CASE WHEN ok THEN map_concat(b, MAP([bucket], [b[bucket] + 1])) ELSE b END, m + (ok AND media)::INT, CASE WHEN ok THEN list_append(taken, doc_id) ELSE taken END, CASE WHEN ok THEN list_append(steps, step) ELSE steps END
    FROM (SELECT *, len(taken) < 200 AND NOT list_contains(taken, doc_id) AND (step <> 1 OR (media AND m < 30)) AND (step = 4 OR coalesce(src[source], 0) < 50)
        AND (step <> 2 OR b[bucket] < CASE bucket WHEN 'short' THEN n1 WHEN 'medium' THEN n2 ELSE n3 END) AS ok
      FROM (SELECT r.*, s.*  EXCLUDE (k), c.*, CAST(r.k // c.n + 1 AS INTEGER) AS step FROM r, c, s WHERE r.k < 4 * c.n AND s.i = r.k % c.n + 1)))
SELECT unnest(taken) AS post_id, unnest(steps) AS step, unnest(range(1, len(taken) + 1))::INTEGER AS place FROM r, c WHERE k = 4 * c.n""")
def stratified_sample(spark, d):
    i = F.col("doc_id")
    p = a.table(spark, d, "documents").select(i.alias("post_id"), "source", "text", F.expr("timestampadd(HOUR, cast(doc_id % 170 as int), timestamp_ntz'2024-01-01 00:00:00')").alias("effective_at"), (i % 9 == 0).alias("has_media"))
    return annotation.stratified_sample(p, 200, 42, 0.25, 30).select("post_id", "step", "place")


_HEALTH = f"""{a.RUNS}, src AS (SELECT i AS source, i <> 3 AS enabled FROM range(0, 25) t(i)), k AS (SELECT * FROM runs WHERE started_at <= TIMESTAMP '2024-01-28' AND source <> 7),
  ever AS (SELECT source, max(started_at) FILTER (WHERE status = 'SUCCESS') AS ls FROM k GROUP BY ALL), seen AS (SELECT * FROM k WHERE started_at >= TIMESTAMP '2024-01-27 12:00:00'),
  c AS (SELECT source, count(*) AS runs, count(*) FILTER (WHERE status = 'SUCCESS') AS succeeded, count(*) FILTER (WHERE status = 'PARTIAL_FAILED') AS partial, count(*) FILTER (WHERE status = 'FAILED') AS failed FROM seen GROUP BY ALL),
  st AS (SELECT source, CAST(sum(f) AS BIGINT) AS streak FROM (SELECT source, min((status = 'FAILED')::INT) OVER (PARTITION BY source ORDER BY started_at DESC, run_id DESC ROWS UNBOUNDED PRECEDING) AS f FROM seen) GROUP BY ALL),
  j AS (SELECT src.source, enabled, coalesce(runs, 0) AS runs, coalesce(succeeded, 0) AS succeeded, coalesce(partial, 0) AS partial, coalesce(failed, 0) AS failed, coalesce(streak, 0) AS streak, ls
    FROM src LEFT JOIN c USING (source) LEFT JOIN st USING (source) LEFT JOIN ever USING (source)),
  h AS (SELECT *, CASE WHEN NOT enabled THEN 'DISABLED' WHEN runs = 0 AND ls IS NULL THEN 'NEVER_RUN' WHEN streak >= 3 THEN 'FAILED' WHEN failed > 0 AND succeeded = 0 THEN 'FAILED' WHEN ls IS NULL THEN 'NEVER_SUCCEEDED'
    WHEN failed > 0 OR partial > 0 THEN 'DEGRADED' WHEN epoch(TIMESTAMP '2024-01-28') - floor(epoch(ls)) > 21600 THEN 'STALE' WHEN runs = 0 THEN 'UNKNOWN' WHEN succeeded > 0 THEN 'HEALTHY' ELSE 'UNKNOWN' END AS state FROM j)"""


def _health(spark, d):
    src = spark.range(25).select(F.col("id").alias("source"), (F.col("id") != 3).alias("enabled"))
    at = lambda s: F.expr(f"timestamp_ntz'{s}'")
    return health.source_health(src, a.runs(spark, d).where("source <> 7"), at("2024-01-27 12:00:00"), at("2024-01-28 00:00:00"), 6 * 3600)


@query(f"WITH {_HEALTH} SELECT source, runs, succeeded, partial, failed, streak, state FROM h")
def source_health(spark, d):
    return _health(spark, d).select("source", "runs", "succeeded", "partial", "failed", "streak", "state")


@query(f"WITH {_HEALTH} SELECT count(*) FILTER (WHERE state <> 'DISABLED') AS enabled, count(*) FILTER (WHERE state IN ('FAILED', 'NEVER_SUCCEEDED')) AS failed, count(*) FILTER (WHERE state IN ('DEGRADED', 'STALE', 'NEVER_RUN', 'UNKNOWN')) AS degraded, count(*) FILTER (WHERE state = 'HEALTHY') AS healthy, CASE WHEN count(*) FILTER (WHERE state IN ('FAILED', 'NEVER_SUCCEEDED')) > 0 THEN 'FAILED' WHEN count(*) FILTER (WHERE state IN ('DEGRADED', 'STALE', 'NEVER_RUN', 'UNKNOWN')) > 0 THEN 'DEGRADED' ELSE 'HEALTHY' END AS state FROM h")
def overall_health(spark, d):
    return health.overall_state(_health(spark, d))


@query(f"WITH {a.RUNS}, g AS (SELECT source, CAST(sum(inserted) AS BIGINT) AS inserted, CAST(sum(failed) AS BIGINT) AS failed FROM runs GROUP BY source, CAST(started_at AS DATE)) SELECT source, inserted, failed, CASE WHEN failed > 0 AND inserted = 0 THEN 'FAILED' WHEN failed > 0 THEN 'PARTIAL_FAILED' ELSE 'SUCCESS' END AS status FROM g")
def batch_status(spark, d):
    g = a.runs(spark, d).groupBy("source", F.to_date("started_at").alias("day")).agg(F.sum("inserted").alias("inserted"), F.sum("failed").alias("failed"))
    return g.select("source", "inserted", "failed", health.batch_status(F.col("inserted"), F.col("failed")).alias("status"))


@query(f"WITH {a.RUNS} SELECT source, {T('started_at')} AS started_at, run_id, status FROM runs QUALIFY row_number() OVER (PARTITION BY source ORDER BY started_at DESC, run_id DESC) = 1")
def latest_run(spark, d):
    r = windows.latest(a.runs(spark, d), ["source"], [F.col("started_at").desc(), F.col("run_id").desc()])
    return r.select("source", a.stamp("started_at").alias("started_at"), "run_id", "status")


@query("""SELECT 'order_total_positive' AS "check", count(*) FILTER (WHERE o_totalprice <= 0) AS violations FROM orders UNION ALL
SELECT 'ship_after_1992', count(*) FILTER (WHERE l_shipdate < TIMESTAMP '1992-06-01') FROM lineitem UNION ALL SELECT 'order_key_unique', count(*) FILTER (WHERE n > 1) FROM (SELECT count(*) AS n FROM orders GROUP BY o_orderkey)
UNION ALL SELECT 'customer_part_key_unique', count(*) FILTER (WHERE n > 1) FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey)""")
def table_invariants(spark, d):
    o, li = a.table(spark, d, "orders"), a.table(spark, d, "lineitem")
    return health.invariants({"order_total_positive": (o, F.col("o_totalprice") <= 0), "ship_after_1992": (li, F.col("l_shipdate") < F.expr("timestamp_ntz'1992-06-01 00:00:00'"))},
                             {"order_key_unique": (o, ["o_orderkey"]), "customer_part_key_unique": (o, ["o_custkey"])})


@query(" UNION ALL ".join(f"SELECT '{t}' AS \"table\", count(*) AS rows FROM {t}" for t in ("nation", "customer", "orders", "documents")))
def table_row_counts(spark, d):
    return health.row_counts({t: a.table(spark, d, t) for t in ("nation", "customer", "orders", "documents")})


@query(f"WITH {a.POSTS} SELECT source, count(*) AS n, min(n_chars) AS shortest, quantile_cont(n_chars, 0.5) AS median, max(n_chars) AS longest, count(*) FILTER (WHERE post_id % 4 = 0) AS without_url, count(*) FILTER (WHERE n_chars > 5000) AS too_long FROM posts GROUP BY source")
def corpus_profile(spark, d):
    p = a.posts(spark, d).withColumn("url", F.when(F.col("post_id") % 4 != 0, F.lit("u")))
    return health.corpus_profile(p, "source", "n_chars", "url", 5000)


_SNAP = f"""{a.RUNS}, s AS (SELECT source AS scope, CAST(started_at AS DATE) AS day, sum(failed) // 40 AS gap, count(*) FILTER (WHERE status = 'FAILED') // 10 AS reasons, count(*) > 14 AS ready FROM runs GROUP BY ALL),
  p AS (SELECT *, lag(gap) OVER w AS pg, lag(reasons) OVER w AS pr, lag(ready) OVER w AS py, lag(day) OVER w IS NULL AS f FROM s WINDOW w AS (PARTITION BY scope ORDER BY day))"""


@query(f"""WITH {_SNAP} SELECT scope, CAST(day AS VARCHAR) AS day, event FROM (SELECT scope, day, unnest([CASE WHEN f THEN 'first' END, CASE WHEN NOT f AND gap <> pg THEN 'gap_changed' END,
  CASE WHEN NOT f AND reasons <> pr THEN 'reasons_changed' END, CASE WHEN NOT f AND ready AND NOT py THEN 'ready_up' END, CASE WHEN NOT f AND NOT ready AND py THEN 'ready_down' END]) AS event FROM p) WHERE event IS NOT NULL""")
def readiness_events(spark, d):
    s = a.runs(spark, d).groupBy(F.col("source").alias("scope"), F.to_date("started_at").alias("day")).agg(
        F.floor(F.sum("failed") / 40).alias("gap"), F.floor(F.count_if(F.col("status") == "FAILED") / 10).alias("reasons"), (F.count(F.lit(1)) > 14).alias("ready"))
    return health.state_changes(s, "scope", "day").select("scope", F.col("day").cast("string").alias("day"), "event")


_FOLD = "sha256(lower(trim(regexp_replace(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))))"


@query(f"WITH {a.POSTS}, k AS (SELECT post_id, {_FOLD} AS key FROM posts) SELECT post_id, CASE WHEN row_number() OVER (PARTITION BY key ORDER BY post_id) = 1 THEN 'ACCEPTED' ELSE 'DUPLICATE' END AS status FROM k")
def first_occurrence(spark, d):
    p = a.posts(spark, d).withColumn("key", tx.ascii_key(F.col("text")))
    return windows.first_occurrence(p, ["key"], [F.col("post_id")]).select("post_id", "status")


@query("SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) AS stripped FROM pages")
def strip_tags(spark, d):
    return a.table(spark, d, "pages").select("page_id", tx.strip_tags(F.col("html")).alias("stripped"))


@query()
def content_hashes(spark, d):
    return a.posts(spark, d).select("post_id", tx.content_hash(F.col("source"), F.col("text"), namespace="post").alias("content_hash"), tx.normalize_text("text").alias("normal"))


_REDACTED = "coalesce(text, '')"
for _p, _r in tx.SECRETS:
    _REDACTED = "regexp_replace({0}, '{1}', '{2}', 'g')".format(_REDACTED, _p.replace("'", "''"), _r.replace("$1", "\\1"))


@query(f"SELECT doc_id, sha256({_REDACTED}) AS safe_sha256, {_REDACTED} <> coalesce(text, '') AS held_secret FROM documents")
def redacted_text(spark, d):
    text = F.coalesce("text", F.lit(""))
    p = a.table(spark, d, "documents")
    return p.select("doc_id", F.sha2(tx.redact(text), 256).alias("safe_sha256"), (tx.redact(text) != text).alias("held_secret"))


@query("SELECT page_id, lower(regexp_replace(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[A-Za-z]+://', ''), '/+$', '')) AS key, regexp_replace(url, '[?#].*$', '') AS safe FROM pages")
def url_keys(spark, d):
    return a.table(spark, d, "pages").select("page_id", tx.url_key(F.col("url")).alias("key"), tx.safe_url(F.col("url")).alias("safe"))


@query("SELECT doc_id, len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS n_tokens FROM documents WHERE text IS NOT NULL")
def token_counts(spark, d):
    return a.table(spark, d, "documents").where("text is not null").select("doc_id", F.size(tx.tokens(F.lower("text"))).cast("long").alias("n_tokens"))


def _docs(spark, d):
    return a.posts(spark, d).select("post_id", F.col("source"), F.concat(F.lit("b"), (F.col("post_id") % 1).cast("string")).alias("bucket"),
                    F.lower(F.trim(F.regexp_replace("text", r"\s+", " "))).alias("normal"), "published_at")


_REPOST = f"""{a.POSTS}, d AS (SELECT post_id, source, lower(trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))) AS normal, published_at FROM posts),
  h AS (SELECT *, first_value(post_id) OVER (PARTITION BY normal ORDER BY published_at, post_id) AS head FROM d WHERE normal <> ''), hd AS (SELECT * FROM h WHERE post_id = head),
  tk AS (SELECT post_id, unnest(regexp_extract_all(normal, '[a-z0-9]+')) AS tok FROM hd), tf AS (SELECT post_id, tok, count(*) AS c FROM tk GROUP BY ALL),
  nn AS (SELECT count(*) AS n FROM hd), df AS (SELECT tok, count(*) AS df FROM tf GROUP BY ALL), ln_ AS (SELECT post_id, sum(c) AS len FROM tf GROUP BY ALL),
  w AS (SELECT post_id, tok, c / len * (ln((1 + n) / (1 + df)) + 1) AS w FROM tf JOIN df USING (tok) JOIN ln_ USING (post_id), nn), nm AS (SELECT post_id, sqrt(sum(w * w)) AS norm FROM w GROUP BY ALL),
  v AS (SELECT post_id, tok, w / norm AS w FROM w JOIN nm USING (post_id)),
  p AS (SELECT x.post_id AS a, y.post_id AS b, round(sum(x.w * y.w), 6) AS similarity FROM v x JOIN v y ON x.tok = y.tok AND x.post_id < y.post_id GROUP BY ALL HAVING round(sum(x.w * y.w), 6) >= 0.8),
  e AS (SELECT head AS from_item, post_id AS to_item, 'REPOST' AS relation, 1.0 AS similarity FROM h WHERE post_id <> head UNION ALL
    SELECT a, b, CASE WHEN sa.source = sb.source THEN 'SAME_SOURCE' WHEN similarity >= 0.999 THEN 'REPOST' ELSE 'SEMANTIC_SIMILAR' END, similarity FROM p JOIN hd sa ON sa.post_id = a JOIN hd sb ON sb.post_id = b)"""


@query(f"WITH {_REPOST} SELECT from_item, to_item, relation, round(similarity, 5) AS similarity FROM e")
def repost_edges(spark, d):
    e = propagation.edges(_docs(spark, d), "bucket", "post_id", "source", "normal", "published_at")
    return e.select("from_item", "to_item", "relation", F.round("similarity", 5).alias("similarity"))


@query(f"""WITH RECURSIVE {_REPOST}, both_ AS (SELECT from_item AS x, to_item AS y FROM e UNION SELECT to_item, from_item FROM e),
  reach AS (SELECT post_id AS x, post_id AS y FROM d UNION SELECT r.x, b.y FROM reach r JOIN both_ b ON r.y = b.x) SELECT x AS post_id, min(y) AS root FROM reach GROUP BY x""")
def repost_clusters(spark, d):
    docs = _docs(spark, d)
    e = propagation.edges(docs, "bucket", "post_id", "source", "normal", "published_at")
    return propagation.clusters(docs.select("post_id", "published_at"), e, "post_id", "published_at")


_EVID = f"""{a.POSTS}, ev AS (SELECT post_id, CASE WHEN post_id % 10 = 0 THEN '' ELSE source END AS source, CASE WHEN post_id % 13 = 0 THEN '' ELSE 'x' END AS content, post_id % 6 = 0 AS mock, post_id % 4 <> 0 AS approved,
  post_id % 3 <> 0 AS research, post_id % 9 = 0 AS late FROM posts)"""


def _evidence(spark, d):
    p = a.posts(spark, d)
    i = F.col("post_id")
    s = lambda c: F.lit(c)
    rows = p.select("post_id", F.when(i % 10 == 0, "").otherwise(F.col("source")).alias("source"), i.cast("string").alias("source_record_id"), F.when(i % 13 == 0, "").otherwise("x").alias("content"),
                    s("2024-01-01T00:00:00Z").alias("published_at"), F.when(i % 9 == 0, "2024-01-01 10:00:00").otherwise("2024-01-02T00:00:00+00:00").alias("collected_at"), s("2024-01-01T12:00:00Z").alias("available_at"),
                    s("https://example.org/x").alias("url"), F.when(i % 6 == 0, "yes").otherwise("no").alias("is_mock"), s("live").alias("record_kind"), F.when(i % 4 != 0, "approved").otherwise("pending").alias("authorization_status"),
                    s("2023-01-01T00:00:00Z").alias("valid_from"), s("2025-01-01T00:00:00Z").alias("expires_at"), F.when(i % 3 != 0, "true").otherwise("false").alias("permits_research_use"), s("1").alias("permits_local_storage"))
    return evidence.assess(rows, F.expr("timestamp'2024-06-01 00:00:00'"))


@query(f"""WITH {_EVID}, r AS (SELECT unnest([CASE WHEN source = '' THEN 'MISSING_IDENTITY' END, CASE WHEN content = '' THEN 'MISSING_CONTENT' END, CASE WHEN late THEN 'BAD_COLLECTED_AT' END, CASE WHEN mock THEN 'MOCK' END,
  CASE WHEN NOT approved THEN 'UNAUTHORISED' END, CASE WHEN NOT research THEN 'NO_RESEARCH_USE' END]) AS reason FROM ev) SELECT reason, count(*) AS n FROM r WHERE reason IS NOT NULL GROUP BY ALL""")
def evidence_reasons(spark, d):
    return evidence.reason_counts(_evidence(spark, d))


@query(f"WITH {_EVID} SELECT post_id, source = '' OR content = '' OR late OR mock OR NOT approved AS quarantined, source <> '' AND content <> '' AND NOT late AND NOT mock AND approved AND research AS oos_eligible FROM ev")
def evidence_assessment(spark, d):
    return _evidence(spark, d).select("post_id", "quarantined", "oos_eligible")


@query(f"""WITH {a.POSTS}, st AS (SELECT source, n_chars % 50 AS rec, min(lang) AS lang FROM posts WHERE post_id % 2 = 0 GROUP BY ALL), b AS (SELECT post_id, source, n_chars % 50 AS rec, lang FROM posts WHERE post_id % 2 = 1)
SELECT b.post_id, CASE WHEN st.lang IS NOT NULL AND st.lang <> b.lang THEN 'IDENTITY_CONFLICT' WHEN st.lang IS NOT NULL OR row_number() OVER (PARTITION BY b.source, b.rec ORDER BY b.post_id) > 1 THEN 'DUPLICATE' ELSE 'ACCEPTED' END AS status
FROM b LEFT JOIN st ON st.source = b.source AND st.rec = b.rec""")
def identity_status(spark, d):
    p = a.posts(spark, d).select("post_id", "source", (F.col("n_chars") % 50).alias("rec"), "lang")
    old = p.where("post_id % 2 = 0").groupBy("source", "rec").agg(F.min("lang").alias("lang"))
    return evidence.identity_status(p.where("post_id % 2 = 1"), old, ["source", "rec"], "lang", [F.col("post_id")]).select("post_id", "status")


@query(f"""WITH {a.POSTS}, st AS (SELECT DISTINCT source, n_chars % 50 AS rec FROM posts WHERE post_id % 2 = 0)
SELECT post_id FROM (SELECT post_id, source, n_chars % 50 AS rec FROM posts WHERE post_id % 2 = 1) b WHERE NOT EXISTS (SELECT 1 FROM st WHERE st.source = b.source AND st.rec = b.rec) QUALIFY row_number() OVER (PARTITION BY source, rec ORDER BY post_id) = 1""")
def idempotent_append(spark, d):
    p = a.posts(spark, d).select("post_id", "source", (F.col("n_chars") % 50).alias("rec"))
    return store.new_rows(p.where("post_id % 2 = 1"), p.where("post_id % 2 = 0"), [["source", "rec"]], [F.col("post_id")]).select("post_id")


@query("""WITH cur AS (SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_custkey % 5 <> 0), inc AS (SELECT c_custkey, c_name, CASE WHEN c_custkey % 7 = 0 THEN 'NEW' ELSE c_mktsegment END AS c_mktsegment FROM customer WHERE c_custkey % 3 <> 0)
SELECT coalesce(cur.c_custkey, inc.c_custkey) AS c_custkey, CASE WHEN cur.c_custkey IS NULL THEN 'insert' WHEN inc.c_custkey IS NULL THEN 'absent' WHEN cur.c_mktsegment = inc.c_mktsegment THEN 'keep' ELSE 'update' END AS action FROM cur FULL JOIN inc ON cur.c_custkey = inc.c_custkey""")
def dimension_changes(spark, d):
    c = a.table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    new = c.where("c_custkey % 3 <> 0").withColumn("c_mktsegment", F.when(F.col("c_custkey") % 7 == 0, "NEW").otherwise(F.col("c_mktsegment")))
    return store.upsert_changes(c.where("c_custkey % 5 <> 0"), new, ["c_custkey"], ["c_name", "c_mktsegment"]).select("c_custkey", "action")


@query(f"WITH {a.POSTS} SELECT post_id FROM posts WHERE NOT (post_id % 8 = 0 AND EXISTS (SELECT 1 FROM posts n WHERE n.post_id = posts.post_id + 20 AND n.source = posts.source))")
def active_rows(spark, d):
    p = a.posts(spark, d).select("post_id", "source")
    fix = p.where("post_id % 8 = 0").select(F.col("post_id").alias("old"), (F.col("post_id") + 20).alias("new"))
    return store.active_rows(p, fix, "post_id", "source")[0].select("post_id")


_DIGEST = "sha256(concat_ws(chr(31), {0}))"
_TABLES = {"nation": ["n_name", "n_nationkey", "n_regionkey"], "documents": ["doc_id", "lang", "n_chars", "source", "text"], "orders": ["o_custkey", "o_orderkey", "o_orderpriority", "o_orderstatus"]}
_PIECES = ", ".join(f"CAST(sum(CAST('0x' || substring(d, {8 * i + 1}, 8) AS BIGINT)) AS VARCHAR) AS s{i}" for i in range(8))


@query(" UNION ALL ".join(f"""SELECT '{t}' AS "table", n AS "rows", sha256(concat_ws('|', n, {', '.join(f's{i}' for i in range(8))})) AS digest FROM (SELECT count(*) AS n, {_PIECES}
  FROM (SELECT {_DIGEST.format(', '.join(f"coalesce(CAST({c} AS VARCHAR), chr(0))" for c in columns))} AS d FROM {t}))""" for t, columns in _TABLES.items()))
def table_digests(spark, d):
    out = None
    for t in _TABLES:
        one = store.table_digest(a.table(spark, d, t).select(*_TABLES[t])).select(F.lit(t).alias("table"), "rows", "digest")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"""WITH {a.POSTS}, c AS (SELECT 'scope' || (post_id % 2) AS scope, source, post_id AS item, CAST(published_at AS DATE) AS d FROM posts), s AS (SELECT scope, source, count(DISTINCT item) AS n, min(d) AS lo, max(d) AS hi FROM c GROUP BY ALL),
  g AS (SELECT scope, sum(n) AS n, max(n) AS top, date_diff('day', min(lo), max(hi)) AS days FROM s GROUP BY ALL), al AS (SELECT v.scope, coalesce(n, 0) AS n, top, coalesce(days, 0) AS days FROM (VALUES ('scope0'), ('scope1'), ('scope2')) v(scope) LEFT JOIN g USING (scope))
SELECT scope, 'rows' AS metric, CAST(n AS DOUBLE) AS current, 200.0 AS required, CASE WHEN n >= 200 THEN 'PASS' ELSE 'FAIL' END AS status, CAST(greatest(200 - n, 0) AS DOUBLE) AS remaining FROM al UNION ALL
SELECT scope, 'days', CAST(days AS DOUBLE), 90.0, CASE WHEN days >= 90 THEN 'PASS' ELSE 'FAIL' END, CAST(greatest(90 - days, 0) AS DOUBLE) FROM al UNION ALL
SELECT scope, 'max_source_share', round(top / nullif(n, 0), 6), 0.4, CASE WHEN top / nullif(n, 0) <= 0.4 THEN 'PASS' ELSE 'FAIL' END, NULL FROM al""")
def readiness_checks(spark, d):
    p = a.posts(spark, d).select(F.concat(F.lit("scope"), (F.col("post_id") % 2).cast("string")).alias("scope"), "source", F.col("post_id").alias("item"), F.to_date("published_at").alias("available_at"))
    return evidence.readiness(p, ["scope0", "scope1", "scope2"], 200, 90, 0.4).withColumn("current", F.round("current", 6))


_RAW = """x AS (SELECT doc_id AS i, source, n_chars, CASE WHEN doc_id % 3 = 0 THEN 'author' ELSE ' News' END AS scope, doc_id % 5 IN (1, 2, 3) AS eligible, TIMESTAMP '2024-01-01' + to_hours(CAST(doc_id AS INTEGER)) AS seen
    FROM documents WHERE doc_id % 11 <> 0 AND doc_id % 7 <> 0),
  ev AS (SELECT i, lower(trim(scope)) AS scope, eligible, CASE WHEN eligible THEN nullif(coalesce(source, ''), '') END AS source, CASE WHEN eligible THEN seen END AS seen FROM x)"""


def _ledger(spark, d):
    """Raw JSON of all documents: some without evidence, of another contract, or with a text for the flag."""
    i = F.col("doc_id")
    at = F.date_format(F.expr("timestampadd(HOUR, cast(doc_id as int), timestamp_ntz'2024-01-01 00:00:00')"), "yyyy-MM-dd'T'HH:mm:ss'Z'")

    def claim(flag):
        return F.to_json(F.struct(F.struct(F.when(i % 7 == 0, "v0").otherwise(" v1 ").alias("contract_version"), F.when(i % 3 == 0, "author").otherwise(" News").alias("scope"), "source",
                                           at.alias("available_at"), flag.alias("oos_eligible")).alias("evidence")))
    raw = a.table(spark, d, "documents").select(F.when(i % 11 == 0, '{"other": 1}').when(i % 5 == 4, claim(F.lit("true"))).otherwise(claim(i % 5 > 0)).alias("raw_json"))
    return evidence.ledger(raw, "v1")


@query(f"""WITH {_RAW}, c AS (SELECT scope, count(*) AS n FROM ev WHERE source IS NOT NULL GROUP BY scope, source)
SELECT scope, count(*) AS certified, count(*) FILTER (WHERE eligible) AS eligible, count(*) FILTER (WHERE NOT eligible) AS not_eligible, {T('min(seen)')} AS evidence_start, {T('max(seen)')} AS evidence_end,
  round((SELECT max(n) / sum(n) FROM c WHERE c.scope = ev.scope), 6) AS max_source_share FROM ev GROUP BY scope""")
def evidence_ledger(spark, d):
    out = _ledger(spark, d)
    return out.select("scope", "certified", "eligible", "not_eligible", a.stamp("evidence_start").alias("evidence_start"), a.stamp("evidence_end").alias("evidence_end"), r6("max_source_share"))


_GAPS = f"""{a.OPINIONS}, acc AS (SELECT CASE WHEN opinion_id % 997 = 0 THEN 2 ELSE author_id % 9 END AS author, author_id % 45 AS account, count(*) AS opinions, count(DISTINCT opinion_id) FILTER (WHERE trusted) AS n FROM opinions GROUP BY ALL),
  sh AS (SELECT account FROM acc GROUP BY account HAVING count(DISTINCT author) > 1),
  gaps AS (SELECT author, CAST(sum(opinions) AS BIGINT) AS opinions, CAST(sum(n) AS BIGINT) AS trusted_posts, min(n) AS min_account_samples, bool_and(account NOT IN (SELECT account FROM sh)) AS identity_consistent FROM acc GROUP BY author),
  ag AS (SELECT *, CASE WHEN identity_consistent AND min_account_samples >= 30 THEN 'PASS' ELSE 'BLOCKED' END AS status FROM gaps)"""


def _gaps(spark, d):
    o = a.opinions(spark, d)
    return evidence.author_gaps(o.select(F.when(F.col("opinion_id") % 997 == 0, 2).otherwise(F.col("author_id") % 9).alias("author"), (F.col("author_id") % 45).alias("account"), F.col("opinion_id").alias("post_id"), "trusted"))


@query(f"WITH {_GAPS} SELECT author, opinions, trusted_posts, min_account_samples, identity_consistent, status FROM ag")
def author_gaps(spark, d):
    return _gaps(spark, d)


@query(f"""WITH {_GAPS}, {_RAW}, a1 AS (SELECT count(*) AS authors, coalesce(min(min_account_samples), 0) AS least, count(*) FILTER (WHERE identity_consistent) AS consistent, count(*) FILTER (WHERE status = 'PASS') AS ready FROM ag),
  per AS (SELECT source, count(*) AS n, min(published_at) AS lo, max(published_at) AS hi FROM (SELECT source, TIMESTAMP '2024-01-01' + to_hours(CAST(doc_id AS INTEGER)) AS published_at FROM documents) GROUP BY source),
  n1 AS (SELECT sum(n) AS events, max(n) AS top, CAST(floor((epoch(max(hi)) - epoch(min(lo))) / 86400) AS BIGINT) AS days FROM per),
  e1 AS (SELECT count(*) FILTER (WHERE scope = 'author' AND eligible) AS ae, count(*) FILTER (WHERE scope = 'news' AND eligible) AS ne FROM ev),
  g AS (SELECT unnest([{{'key': 'author.trusted_posts_per_account', 'current': CAST(least AS VARCHAR), 'required': '30', 'comparator': '>=', 'ok': authors > 0 AND ready = authors}},
    {{'key': 'author.identity_consistency', 'current': consistent || '/' || authors, 'required': 'all', 'comparator': '==', 'ok': authors > 0 AND consistent = authors}},
    {{'key': 'author.source_authorization', 'current': 'unverified', 'required': 'approved by a person', 'comparator': 'human_gate', 'ok': false}},
    {{'key': 'news.events', 'current': CAST(events AS VARCHAR), 'required': '200', 'comparator': '>=', 'ok': events >= 200}},
    {{'key': 'news.history_days', 'current': CAST(days AS VARCHAR), 'required': '90', 'comparator': '>=', 'ok': days >= 90}},
    {{'key': 'news.max_source_share', 'current': CAST(round(top / events, 6) AS VARCHAR), 'required': '0.4', 'comparator': '<=', 'ok': top / events <= 0.4}},
    {{'key': 'news.available_history_evidence', 'current': 'unverified', 'required': 'approved by a person', 'comparator': 'human_gate', 'ok': false}},
    {{'key': 'author.evidence_intake_oos_eligible', 'current': CAST(ae AS VARCHAR), 'required': '30', 'comparator': '>=', 'ok': ae >= 30}},
    {{'key': 'news.evidence_intake_oos_eligible', 'current': CAST(ne AS VARCHAR), 'required': '200', 'comparator': '>=', 'ok': ne >= 200}}]) AS g FROM a1, n1, e1)
SELECT g.key, split_part(g.key, '.', 1) AS scope, g.current, g.required, g.comparator, CASE WHEN g.ok THEN 'PASS' ELSE 'BLOCKED' END AS status FROM g""")
def qualification_gaps(spark, d):
    news = a.table(spark, d, "documents").select("source", F.expr("timestampadd(HOUR, cast(doc_id as int), timestamp_ntz'2024-01-01 00:00:00')").alias("available_at"))
    return evidence.qualification(_gaps(spark, d), news, _ledger(spark, d))


_PROC = """src AS (SELECT i AS source, i <> 3 AS enabled FROM range(0, 25) t(i)),
  ra AS (SELECT user_id % 20 AS source, count(*) AS raw_items FROM events GROUP BY ALL),
  pr AS (SELECT user_id % 20 AS source, (['ACCEPTED', 'DUPLICATE', 'REJECTED', 'FAILED', 'RUNNING'])[event_id % 5 + 1] AS outcome FROM events WHERE user_id % 20 NOT IN (4, 9)),
  pc AS (SELECT source, count(*) FILTER (WHERE outcome = 'ACCEPTED') AS s, count(*) FILTER (WHERE outcome IN ('REJECTED', 'DUPLICATE')) AS r, count(*) FILTER (WHERE outcome = 'FAILED') AS f, count(*) FILTER (WHERE outcome = 'RUNNING') AS g FROM pr GROUP BY source),
  ph AS (SELECT source, enabled, coalesce(raw_items, 0) AS raw_items, coalesce(s, 0) AS processed_success, coalesce(r, 0) AS processed_rejected, coalesce(f, 0) AS processed_failed, coalesce(g, 0) AS processed_in_flight,
    CASE WHEN pc.source IS NOT NULL THEN 'OBSERVED' WHEN raw_items > 0 THEN 'NOT_OBSERVED' ELSE 'NO_INPUT' END AS processor_state FROM src LEFT JOIN ra USING (source) LEFT JOIN pc USING (source))"""


def _processing(spark, d):
    src = spark.range(25).select(F.col("id").alias("source"), (F.col("id") != 3).alias("enabled"))
    e = a.table(spark, d, "events").select((F.col("user_id") % 20).alias("source"), F.get(F.array(*map(F.lit, ["ACCEPTED", "DUPLICATE", "REJECTED", "FAILED", "RUNNING"])), (F.col("event_id") % 5).cast("int")).alias("outcome"))
    return health.processor_health(src, e, e.where("source not in (4, 9)"))


@query(f"WITH {_PROC} SELECT source, raw_items, processed_success, processed_rejected, processed_failed, processed_in_flight, processor_state FROM ph")
def processor_health(spark, d):
    return _processing(spark, d).drop("enabled")


@query("""WITH j AS (SELECT (['SUCCESS', 'PARTIAL_FAILED', 'FAILED', 'RUNNING', 'CANCELLED', 'RETRYING'])[o_orderkey % 6 + 1] AS status, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey % 3 END AS retry_count, o_orderdate AS seen,
  CASE WHEN o_orderkey % 5 IN (1, 2) THEN o_orderkey % 5 END AS entries FROM orders)
SELECT count(*) AS slots, count(*) FILTER (WHERE status = 'SUCCESS') AS success, count(*) FILTER (WHERE status = 'PARTIAL_FAILED') AS partial_failed, count(*) FILTER (WHERE status = 'FAILED') AS failed,
  count(*) FILTER (WHERE status IN ('RUNNING', 'RETRYING')) AS in_flight, count(*) FILTER (WHERE status = 'CANCELLED') AS other, CAST(sum(coalesce(retry_count, 0)) AS BIGINT) AS retries,
  CAST(sum(coalesce(entries, 0)) AS BIGINT) AS per_source_entries, count(*) FILTER (WHERE entries IS NULL) AS slots_without_output, strftime(max(seen), '%Y-%m-%d') AS last_slot_at FROM j""")
def scheduler_summary(spark, d):
    i = F.col("o_orderkey")
    jobs = a.table(spark, d, "orders").select(
        F.get(F.array(*map(F.lit, ["SUCCESS", "PARTIAL_FAILED", "FAILED", "RUNNING", "CANCELLED", "RETRYING"])), (i % 6).cast("int")).alias("status"), F.when(i % 4 != 0, i % 3).alias("retry_count"), F.col("o_orderdate").alias("scheduled_at"),
        F.when(i % 5 == 1, '{"sources": [1]}').when(i % 5 == 2, '{"sources": ["a", {"b": 1}]}').when(i % 5 == 3, '{"sources": "none"}').when(i % 5 == 4, "broken").alias("output_json"))
    return health.scheduler_summary(jobs).withColumn("last_slot_at", F.date_format("last_slot_at", "yyyy-MM-dd"))


@query(f"""WITH {_HEALTH}, {_PROC.split("),", 1)[1]}, o AS (SELECT count(*) FILTER (WHERE enabled AND state = 'FAILED') AS failed, count(*) FILTER (WHERE enabled AND state <> 'HEALTHY') AS weak, count(*) FILTER (WHERE enabled) AS active FROM h),
  q AS (SELECT count(*) FILTER (WHERE enabled AND processor_state = 'NOT_OBSERVED') AS blind, sum(processed_failed) AS broken FROM ph)
SELECT CASE WHEN active = 0 THEN 'DISABLED' WHEN failed > 0 THEN 'FAILED' ELSE 'DEGRADED' END AS state,
  CASE WHEN failed > 0 THEN '' ELSE concat_ws(',', CASE WHEN weak > 0 THEN 'sources_not_healthy' END, CASE WHEN blind > 0 THEN 'sources_without_results' END, CASE WHEN broken > 0 THEN 'processing_failures' END) END AS reasons FROM o, q""")
def overall_health(spark, d):
    out = health.overall_health(_health(spark, d), _processing(spark, d))
    return out.select("state", F.array_join("reasons", ",").alias("reasons"))


_AUDIT = """r AS (SELECT doc_id AS i, 's' || (doc_id % 2) AS source, CASE WHEN doc_id % 53 = 0 THEN ' ' ELSE CAST(doc_id % 400 AS VARCHAR) END AS id, 'a' || (doc_id % 6) AS acc, CASE WHEN doc_id % 45 = 7 THEN 'Other' ELSE 'N' || (doc_id % 6) END AS author,
    coalesce(text, '') AS content, 'p' || (doc_id % 700) AS page, doc_id % 3 AS form, TIMESTAMP '2024-01-01' + to_minutes(CAST(doc_id AS INTEGER)) AS pub, doc_id % 9 AS late FROM documents),
  x AS (SELECT *, trim(id) = '' OR trim(content) = '' AS missing, source || '/' || acc AS account, lower(trim(regexp_replace(content, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))) AS body, CASE WHEN form < 2 THEN page END AS url_key,
    CASE WHEN late = 0 THEN pub ELSE pub + to_minutes(5) END AS col, CASE WHEN late = 1 THEN pub ELSE greatest(pub, CASE WHEN late = 0 THEN pub ELSE pub + to_minutes(5) END) END AS eff FROM r),
  y AS (SELECT *, first_value(author) OVER (PARTITION BY missing, account ORDER BY i) AS own, row_number() OVER (PARTITION BY missing, source, trim(id) ORDER BY i) > 1 AS d1, row_number() OVER (PARTITION BY missing, body ORDER BY i) > 1 AS d2,
    url_key IS NOT NULL AND row_number() OVER (PARTITION BY missing, url_key ORDER BY i) > 1 AS d3 FROM x),
  audit AS (SELECT i, account, missing, CASE WHEN missing THEN 'MISSING_FIELD' ELSE concat_ws(',', CASE WHEN author <> own THEN 'MANY_NAMES' END, CASE WHEN d1 THEN 'DUPLICATE_ID' END, CASE WHEN d2 THEN 'DUPLICATE_BODY' END,
    CASE WHEN length(trim(content)) < 90 THEN 'TOO_SHORT' END, CASE WHEN url_key IS NULL THEN 'BAD_URL' END, CASE WHEN d3 THEN 'DUPLICATE_URL' END, CASE WHEN late = 2 THEN 'BAD_TIME' END, CASE WHEN late <> 2 AND col <= pub THEN 'TIME_ORDER' END,
    CASE WHEN late <> 2 AND eff <> greatest(pub, col) THEN 'EFFECTIVE' END, CASE WHEN late <> 2 AND (pub > TIMESTAMP '2024-01-01 15:00:00' OR col > TIMESTAMP '2024-01-01 15:00:00') THEN 'FUTURE_TIME' END,
    CASE WHEN late <> 2 AND acc = 'a1' AND col >= TIMESTAMP '2024-01-01 04:00:00' THEN 'OUTSIDE_WINDOW' END, CASE WHEN i % 29 = 0 THEN 'PROVENANCE' END, CASE WHEN i % 31 = 0 THEN 'SOURCE_TYPE' END, CASE WHEN i % 37 = 0 THEN 'HAS_MEDIA' END,
    CASE WHEN acc = 'a5' THEN 'NOT_AUTHORISED' END) END AS problems FROM y)"""


def _audit(spark, d):
    i = F.col("doc_id")
    s = lambda c: c.cast("string")
    at = lambda m: F.date_format(F.expr("timestamp_ntz'2024-01-01 00:00:00'") + F.make_dt_interval(mins=(i + m).cast("int")), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    page = F.concat(F.lit("p"), s(i % 700))
    url = F.when(i % 3 == 0, F.concat(F.lit("https://u:p@Host.org:8080/"), page, F.lit("?q=1#x"))).when(i % 3 == 1, F.concat(F.lit("HTTPS://host.org:8080/"), page, F.lit("?q=1"))).otherwise(F.concat(F.lit("ftp://host/"), page))
    rows = a.table(spark, d, "documents").select(
        i.alias("row"), F.concat(F.lit("s"), s(i % 2)).alias("source"), F.when(i % 53 == 0, " ").otherwise(s(i % 400)).alias("id"), F.concat(F.lit("a"), s(i % 6)).alias("external_account_id"),
        F.when(i % 45 == 7, "Other").otherwise(F.concat(F.lit("N"), s(i % 6))).alias("author_name"), F.col("text").alias("content"), url.alias("url"), at(0).alias("published_at"),
        F.when(i % 9 == 2, "yesterday").otherwise(at(F.when(i % 9 == 0, 0).otherwise(5))).alias("collected_at"), at(F.when(i % 9 < 2, 0).otherwise(5)).alias("effective_at"),
        F.when(i % 29 == 0, "guess").otherwise("independent_observation").alias("collection_time_provenance"), F.when(i % 31 == 0, "post").otherwise("news").alias("source_type"), F.when(i % 37 == 0, "maybe").otherwise("True").alias("has_media"))
    windows_ = spark.createDataFrame([(f"s{k % 2}", f"a{k}") for k in range(5)], "source string, account string").withColumns({
        "valid_from": F.expr("timestamp'2023-01-01 00:00:00'"), "expires_at": F.when(F.col("account") == "a1", F.expr("timestamp'2024-01-01 04:00:00'"))})
    return evidence.author_audit(rows, windows_, F.expr("timestamp'2024-01-01 15:00:00'"))


@query(f"WITH {_AUDIT} SELECT i AS \"row\", problems FROM audit")
def author_audit(spark, d):
    return _audit(spark, d).select("row", F.array_join("problems", ",").alias("problems"))


@query(f"""WITH {_AUDIT}, p AS (SELECT account, count(*) AS n FROM audit WHERE NOT missing GROUP BY account)
SELECT count(*) AS "rows", CAST(sum(CASE WHEN problems = '' THEN 0 ELSE len(string_split(problems, ',')) END) AS BIGINT) AS errors, (SELECT count(*) FROM p) AS accounts, (SELECT min(n) FROM p) AS fewest, false AS ready FROM audit""")
def author_audit_summary(spark, d):
    return evidence.author_audit_summary(_audit(spark, d)).select("rows", F.col("errors").cast("long").alias("errors"), "accounts", "fewest", "ready")


@query("""SELECT o_orderkey, '{"note":"' || o_orderpriority || '","n":' || o_orderkey || ',"list":[' || o_orderkey % 5 || ',"x",true],"feed_url":' || CASE WHEN o_orderkey % 2 = 0 THEN '"https://h.org/a"' ELSE '12' END || ',"none":null}' AS safe FROM orders""")
def sanitised_json(spark, d):
    """Credentials, objects in values and in lists, and what an address holds beyond its path are gone; kinds stay."""
    i = F.col("o_orderkey").cast("string")
    even = F.col("o_orderkey") % 2 == 0
    j = F.concat(F.lit('{"note": "'), "o_orderpriority", F.lit('", "api_key": "x", "n": '), i, F.lit(', "list": ['), (F.col("o_orderkey") % 5).cast("string"),
                 F.lit(', "x", {"a": 1}, null, true], "headers": {"Authorization": "b"}, "feed_url": '), F.when(even, '"https://u:p@h.org/a?token=1#f"').otherwise("12"), F.lit(', "none": null, " ": 1}'))
    return a.table(spark, d, "orders").select("o_orderkey", tx.sanitize_json(j).alias("safe"))
