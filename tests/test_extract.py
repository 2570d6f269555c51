"""What the extraction rules read from single posts."""

import pytest

from asofkit.operators import extract

PRICES = ("entry_low", "entry_high", "stop_loss", "take_profit")


@pytest.fixture(scope="module")
def read(spark):
    def run(*texts, **more):
        posts = spark.createDataFrame(list(enumerate(texts)), "post_id long, text string")
        out = [[] for _ in texts]
        for r in extract.extract_opinions(posts, **more)[1].orderBy("post_id", "unit_no", "instrument_no").collect():
            out[r.post_id].append(r)
        return out
    return run


def prices(o):
    return tuple(o[c] for c in PRICES)


def test_prices(read):
    cases = {
        "2380 附近做多，止损 2365，目标 2450，日内短线": (2380, 2380, 2365, 2450),
        "2380做多，2360止损，2450目标": (2380, 2380, 2360, 2450),  # the entry leaves the stop its number
        "buy 2380-2395, sl 2360, tp 2450": (2380, 2395, 2360, 2450),
        "做空2380至2395，止损 2300": (2380, 2395, None, None),  # a stop on the wrong side
        "long at 12.34567": (12, 12, None, None),  # five decimals: the whole part
        "long at 12.3456": (12.3456, 12.3456, None, None),
        "long at 12345678": (None,) * 4, "long 3 at 1.2": (None,) * 4,
        "long at 2380点": (None,) * 4, "long at 40 %": (None,) * 4, "buy in 2026 年": (None,) * 4,
        "long target2450": (None,) * 4,  # no word of its own
        "long, target: 2450": (None, None, None, 2450), "long, target is 2450": (None,) * 4,
        "long 2450 - 2380": (2450, 2450, None, None),  # no range: the ends are the wrong way round
        "flat 2380-2450, stop 2300": (2380, 2450, None, None),
        "short stop loss 2400 from 2380 take profit 2300": (2380, 2380, 2400, 2300),
    }
    for text, got in zip(cases, read(*cases)):
        assert [prices(o) for o in got] == [cases[text]], text


def test_stance_and_flags(read):
    cases = {"看多": "LONG", "做空，然后买入": "SHORT LONG", "区间震荡": "FLAT", "range, then buy": "FLAT LONG", "buy or sell": "LONG", "belong and shorts": "", "做long": "",
             "不看多": "UNKNOWN", "不排除看多": "LONG", "如果突破就做多": "UNKNOWN", "unless it dips I buy": "UNKNOWN", "他表示看涨": "UNKNOWN", "我表示看涨": "LONG",
             "据我看，看涨": "UNKNOWN", "昨天看空": "UNKNOWN", "Buy now! Sell later": "LONG SHORT", "BUY 1.5 then SELL": "LONG", "": "", "\n ": ""}
    for text, got in zip(cases, read(*cases)):
        assert " ".join(o.stance for o in got) == cases[text], text


def test_confidence_and_diagnostics(read):
    got = read("可能看多", "大概看多", "看多", "买入 2380", "如果看多", "likely range", "maybe buy 2380, stop 2390")
    assert [o[0].confidence for o in got] == [0.4, 0.5, 0.7, 0.9, None, 0.5, 0.4]
    assert [o[0].diagnostics for o in got] == [["weak_language"], ["weak_language"], [], [], ["conditional"], ["weak_language"], ["price_dropped", "weak_language"]]
    assert got[4][0].rationale == "conditional：如果看多"
    assert len(read("看多" + "长" * 500)[0][0].rationale) == 120


def test_horizon_and_information_type(read):
    cases = {"看多，超短": "15m", "buy, half an hour": "30m", "看多日内": "1h", "short-term buy": "1h", "看多，美盘": "4h", "buy for some hours": "4h", "本周看多": "1d", "swing buy": "1d",
             "buy, intraday, daily": "1h", "buy": None}
    for text, got in zip(cases, read(*cases)):
        assert got[0].horizon == cases[text], text
    assert read("buy gold, cpi. 日内")[0][0].horizon is None  # another sentence
    kinds = [o[0].information_type for o in read("cpi 高，突发消息，看多", "etf 增仓，看多", "恐慌，卖出", "支撑位买入", "买入 2380", "买入", "如果买入", "federal buy")]
    assert kinds == ["MACRO", "POSITIONING", "SENTIMENT", "TECHNICAL", "TECHNICAL", "OTHER", None, "OTHER"]


def test_instruments(read):
    cases = {"黄金和白银看多": ["XAUUSD", "XAGUSD"], "白银弱，买入": ["XAGUSD"], "白银弱于黄金，买入": [None], "buy XPTUSD": ["XPTUSD"], "long, BUDGET is fine": [None], "buy, COVID19 fades": [None],
             "US10Y_REAL buy": ["US10Y", "US10Y_REAL"], "buy SGE_AU9999": ["SGE_AU9999"], "buy EURUSD and gold": ["EURUSD", "XAUUSD"], "buy": [None], "buy xauusd XAUUSD": ["XAUUSD"]}
    for text, got in zip(cases, read(*cases)):
        assert [o.instrument for o in got] == cases[text], text
    assert [o.warnings for o in read("buy XPTUSD", "buy gold")[0]] == [["unknown_instrument"]]
    assert [o.instrument for o in read("buy wheat", names={"ZW": ["wheat"]})[0]] == ["ZW"]


def test_processed_rows(spark):
    posts = spark.createDataFrame([(0, None), (1, " \n"), (2, "看图"), (3, "no view"), (4, "买入，止损 5。卖出"), (5, "\x01buy\x02 2380")], "post_id long, text string")
    done, drafts = extract.extract_opinions(posts)
    assert [(r.status, r.reason, r.n_units) for r in done.orderBy("post_id").collect()] == [
        ("SKIPPED", "empty_text", 0), ("SKIPPED", "empty_text", 0), ("SUCCESS", "image_only", 0), ("SUCCESS", "no_stance_keyword", 0), ("SUCCESS", None, 2), ("SUCCESS", None, 1)]
    assert drafts.count() == 3 and "Exchange" not in drafts._jdf.queryExecution().executedPlan().toString()


def test_any_extractor(spark):
    def extractor(text):
        if "bad" in text:
            raise ValueError("no")
        return [{"stance": "LONG", "confidence": 0.5}] * len(text.split())
    done, drafts = extract.extract_with(spark.createDataFrame([(0, None), (1, "bad"), (2, "a b")], "post_id long, text string"), extractor, "v")
    assert [(r.status, r.error) for r in done.orderBy("post_id").collect()] == [("SKIPPED", None), ("FAILED", "ValueError: no"), ("SUCCESS", None)]
    assert [(r.post_id, r.unit_no, r.stance) for r in drafts.orderBy("unit_no").collect()] == [(2, 0, "LONG"), (2, 1, "LONG")]


def test_very_long_post(read):
    text = "nothing here, " * 20_000 + "buy at 2380, stop 2370. " + "word " * 20_000
    one = "buy at 2380, " + "and so on, " * 50_000 + "stop 2370"
    assert [[prices(o) for o in got] for got in read(text, one)] == [[(2380, 2380, 2370, None)]] * 2
