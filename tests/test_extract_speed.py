"""That posts are cut once and looked at by patterns that find the same places in less time."""

import random

import pytest
from pyspark.sql import functions as F

from asofkit.functions import opinion_rules as rules
from asofkit.operators import extract

PIECES = ["buy", "BUY", "ſell", "ſHORT", "waıt", "WAİT", "bulliſh", "long", "along", "range", "range-bound", "看多", "看", "多", "空仓", "不参与", "已平仓", "risk-on", "risk off", "stop loss", "stoploss", "sl", "according to", "据", "大概率",
          "mé", "́", "‍", "é", "ß", " ", "  ", " ", " ", ".", ". ", "! ", "?", "。", "；", "，", "、", ",", "\n", "\r", "\n\n", "\t", "\x85", " ", "\x1c", "_", "7", "2380.5", "黄金", "word", "𝒃"]


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(7)
    rows = [(i, "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 30)))) for i in range(3000)]
    return spark.createDataFrame(rows, "post_id long, text string").repartition(4).cache()


def test_shared_beginnings_find_the_same_texts(odd):
    for terms in (rules.LONG + rules.SHORT + rules.FLAT, rules.STOP, rules.WEAK, rules.QUOTE, rules.IMAGE, *rules.INFO_TYPES.values(), ["größe", "Ärger", "a+b", "a"], ["long"], ["空"]):
        both = odd.select("text", F.col("text").rlike("(?iuU)" + extract._any(terms)).alias("a"), extract._has(F.col("text"), terms).alias("b"))
        assert [r.text for r in both.where("a <> b").collect()] == []
        assert both.where("a").count() > 0 or terms is not rules.STOP


def test_units_are_those_of_the_whole_text(odd):
    """Against the cut of every sentence and clause."""
    directed = "(?iuU)" + extract._any(rules.LONG + rules.SHORT + rules.FLAT)

    def of_sentence(sentence):
        clauses = F.transform(extract._parts(sentence, rules.CLAUSE_END), lambda c: F.when(c.rlike(directed), F.concat(F.lit("\x01"), c)).otherwise(c))
        units = F.split(F.array_join(clauses, "，"), "，?\x01")
        return F.transform(F.slice(units, 2, F.size(units)), lambda u: F.struct(sentence.alias("sentence"), u.alias("unit")))

    whole = F.flatten(F.transform(extract._parts(F.col("text"), rules.SENTENCE_END), of_sentence))
    both = odd.select("text", whole.alias("a"), extract.units_column(F.col("text")).alias("b"))
    assert both.where("a <> b or a is null or b is null").collect() == [] and both.where("size(a) > 2").count() > 100


def test_nothing_is_read_twice(odd):
    """A filter on the size of a list would repeat the whole expression behind it."""
    plan = extract.extract_opinions(odd)[1]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate") == 2 and "Filter (size(" not in plan and plan.count("Filter") <= 1
