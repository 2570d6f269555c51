"""Opinion extraction: posts -> processed rows and one row per opinion, in built-in expressions.

A post is cut into sentences and clauses. A clause that names a direction begins a unit, which the clauses after it
join: such clauses are marked, the sentence is put together again and cut at the marks. Units then become rows, and
all that is read from one (stance, prices, instruments, horizon) is a column over its text, one alternation per class
of terms. Nothing is shuffled; a post is never looked at outside its task.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import opinion_rules as rules

OPINION = ("stance string, text string, horizon string, instrument string, information_type string, confidence double, entry_low double, "
           "entry_high double, stop_loss double, take_profit double, rationale string, diagnostics array<string>, warnings array<string>")
#: Marks that frame a match while its place is worked out; they are blanked in posts.
_OPEN, _CLOSE = "\x01", "\x02"


def _any(terms: list[str]) -> str:
    """One alternation without regard to case; terms of ASCII count as whole words."""
    return "(?:" + "|".join(rf"\b\Q{t}\E\b" if t.isascii() else rf"\Q{t}\E" for t in terms) + ")"


def _tree(terms: list[str]) -> str:
    """The terms as one pattern that shares their beginnings."""
    rest: dict[str, list[str]] = {}
    for t in terms:
        if t:
            rest.setdefault(t[0], []).append(t[1:])
    parts = [re.escape(c) + _tree(ends) for c, ends in sorted(rest.items())]
    return "" if not parts else ("(?:" + "|".join(parts) + ")" + ("?" if "" in terms else "")) if len(parts) > 1 or "" in terms else parts[0]


def _some(terms: list[str]) -> str:
    """Matches where ``_any`` does, but not always as far: a look at one character comes before the terms, which share their beginnings."""
    parts = []
    for ts, edge in (({t.lower() for t in terms if t.isascii()}, r"\b"), ({t for t in terms if not t.isascii()}, "")):
        first = sorted({t[0] for t in ts})
        if first and not edge and all(c.lower() == c.upper() for c in first):
            look = f"(?-iu:(?=[{re.escape(first[0])}-{re.escape(first[-1])}]))"  # a range is one comparison, a class of such characters many
        else:
            look = f"(?=[{''.join(map(re.escape, first))}])"
        parts += [f"{look}{edge}{_tree(sorted(ts))}{edge}"] if ts else []
    return "(?:" + "|".join(parts) + ")"


def _has(text: Column, terms: list[str]) -> Column:
    return text.rlike("(?iuU)" + _some(terms))


def _first(text: Column, pattern: str) -> Column:
    """Place of the first match, from 1; null without one."""
    return F.nullif(F.regexp_instr(text, F.lit(f"({pattern})")), F.lit(0))


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def _parts(text: Column, ends: str) -> Column:
    return F.filter(F.transform(F.split(text, "(?U)" + ends), _stripped), lambda s: s != "")


def stance_column(text: Column) -> Column:
    """The direction that is named first; a flat term only where none is; null without any."""
    lo, sh = (_first(text, "(?iuU)" + _any(t)) for t in (rules.LONG, rules.SHORT))
    return (F.when(lo.isNotNull() & (sh.isNull() | (lo <= sh)), "LONG").when(sh.isNotNull(), "SHORT").when(_has(text, rules.FLAT), "FLAT"))


def horizon_column(*texts: Column) -> Column:
    """The first horizon in order of precedence of the first text that has one."""
    return F.coalesce(*[F.when(t.rlike("(?iuU)" + p), name) for t in texts for name, p in rules.HORIZONS])


def information_type_column(text: Column) -> Column:
    return F.coalesce(*[F.when(_has(text, terms), name) for name, terms in rules.INFO_TYPES.items()])


def instruments_column(text: Column, names: dict[str, list[str]] | None = None) -> Column:
    """Codes that a text names, by an alias or as a code, in the order of their first place."""
    names, low = rules.INSTRUMENTS if names is None else names, F.lower(text)
    spoken = F.filter(F.array(*[F.struct(_first(low, "|".join(rf"\Q{x}\E" for x in aliases)).alias("at"), F.lit(code).alias("code")) for code, aliases in names.items()]),
                      lambda x: x.at.isNotNull())
    codes = F.array_except(F.regexp_extract_all(text, F.lit(f"(?U)({rules.CODE})"), F.lit(1)), F.transform(spoken, lambda x: x.code))
    written = F.transform(codes, lambda c: F.struct(F.regexp_instr(text, F.concat(F.lit(r"(?U)\b"), c, F.lit(r"\b"))).alias("at"), c.alias("code")))
    return F.transform(F.array_sort(F.concat(spoken, written)), lambda x: x.code)


def units_column(text: Column) -> Column:
    """(sentence, unit) of every opinion of a text, in order.

    Lines, which no sentence crosses, and sentences that name no direction are left out before they are cut further.
    """
    directed = lambda c: _has(c, rules.LONG + rules.SHORT + rules.FLAT)

    def of_sentence(sentence: Column) -> Column:
        clauses = F.transform(_parts(sentence, rules.CLAUSE_END), lambda c: F.when(directed(c), F.concat(F.lit(_OPEN), c)).otherwise(c))
        units = F.split(F.array_join(clauses, "，"), f"，?{_OPEN}")  # what stands before the first direction belongs to none
        return F.transform(F.slice(units, 2, F.size(units)), lambda u: F.struct(sentence.alias("sentence"), u.alias("unit")))

    lines = F.filter(F.split(text, "\n"), directed)
    return F.flatten(F.transform(F.filter(_parts(F.array_join(lines, "\n"), rules.SENTENCE_END), directed), of_sentence))


def spans(text: Column, pattern: str) -> Column:
    """(start, end, match) of the matches of a pattern, places from 0."""
    pieces = F.split(F.regexp_replace(text, f"(?U)({pattern})", f"{_OPEN}$1{_CLOSE}"), _OPEN)

    def add(acc: Column, piece: Column) -> Column:
        match = F.substring_index(piece, _CLOSE, 1)
        span = F.struct(acc.at.alias("start"), (acc.at + F.length(match)).alias("end"), match.alias("match"))
        return F.struct((acc.at + F.length(piece) - 1).alias("at"), F.concat(acc.found, F.array(span)).alias("found"))

    start = F.struct(F.length(F.element_at(pieces, 1)).alias("at"), F.array().cast("array<struct<start: int, end: int, match: string>>").alias("found"))
    return F.aggregate(F.slice(pieces, 2, F.size(pieces)), start, add, lambda acc: acc.found)


def _rank(text: Column, x: Column, marks: list[str]) -> Column:
    """How near a mark stands to a number: characters between, before it rather than behind; null beyond NEAR."""
    any_mark = _any(marks)
    before = F.substring(text, F.greatest(x.start - 14, F.lit(1)), F.least(x.start, F.lit(15)) + 1)
    after = F.substring(text, x.end, F.lit(16))
    tests = []
    for gap in range(rules.NEAR + 1):
        tests += [F.when(before.rlike(rf"(?iuUs){any_mark}.{{{gap}}}\d$"), 2 * gap), F.when(after.rlike(rf"(?iuUs)^\d.{{{gap}}}{any_mark}"), 2 * gap + 1)]
    return F.coalesce(*tests)


def _numbers(text: Column) -> Column:
    """Plausible prices with their rank for each kind of mark."""
    price = F.transform(spans(text, rules.NUMBER), lambda x: F.struct(
        x.start.alias("start"), x.end.alias("end"), F.try_to_number(x.match, F.lit("9999999.9999")).cast("double").alias("value"),
        F.substring(text, x.end + 1, F.lit(2)).rlike("(?U)" + rules.NO_PRICE).alias("counted"), _rank(text, x, rules.ENTRY).alias("entry"),
        _rank(text, x, rules.STOP).alias("stop"), _rank(text, x, rules.TARGET).alias("target")))
    return F.filter(price, lambda x: ~x.counted & x.value.between(rules.LEAST_PRICE, rules.GREATEST_PRICE))


def _ranges(text: Column) -> Column:
    ends = F.transform(spans(text, rules.RANGE), lambda x: F.struct(x.start.alias("start"), x.end.alias("end"), *[
        F.try_to_number(F.regexp_extract(x.match, "(?U)" + rules.RANGE, i), F.lit("9999999.9999")).cast("double").alias(name) for i, name in ((1, "low"), (2, "high"))]))
    return F.filter(ends, lambda x: (x.low > 0) & (x.low <= x.high) & (x.high <= rules.GREATEST_PRICE))


def _outside(numbers: Column, *taken: Column) -> Column:
    """Numbers that do not begin inside any of the (nullable) spans."""
    return F.filter(numbers, lambda x: ~F.coalesce(*[F.when((x.start >= t.start) & (x.start < t.end), True) for t in taken], F.lit(False)))


def _ordered(numbers: Column, kind: str) -> Column:
    """Candidates of a kind, nearest first."""
    near = F.filter(numbers, lambda x: x[kind].isNotNull())
    return F.array_sort(F.transform(near, lambda x: F.struct(x[kind].alias("rank"), x.value.alias("value"), x.start.alias("start"), x.end.alias("end"))))


def _consistent(candidates: Column, reference: Column, above: Column) -> Column:
    """The first candidate on the right side of the reference; any without one."""
    return F.filter(candidates, lambda c: reference.isNull() | F.when(above, c.value > reference).otherwise(c.value < reference))


def opinion_columns(units: DataFrame, names: dict[str, list[str]] | None = None) -> DataFrame:
    """Adds what is read from (sentence, unit): the columns of OPINION but ``instrument`` and ``text``."""
    sentence, unit, stance0 = F.col("sentence"), F.col("unit"), F.col("stance0")
    term = F.lower(F.regexp_extract(unit, "(?iuU)(" + _any(rules.LONG + rules.SHORT) + ")", 1))
    place = F.instr(F.lower(unit), term)
    prefix = F.substring(F.lower(unit), F.greatest(place - 3, F.lit(1)), F.least(place - 1, F.lit(3)))
    negated = (stance0 != "FLAT") & (place > 1) & ~prefix.rlike("|".join(rules.NOT_NEGATED)) & prefix.rlike("(?:" + "|".join(rules.NEGATION) + ")$")
    quote = _first(sentence, "(?iuU)" + _any(rules.QUOTE))
    speaker = F.substring(sentence, F.greatest(quote - 3, F.lit(1)), F.least(quote - 1, F.lit(3)))
    scope = F.concat_ws(" ", sentence, unit)
    u = units.withColumn("stance0", stance_column(unit)).withColumns({
        "negated": negated, "conditional": _has(sentence, rules.CONDITIONAL), "post_hoc": _has(sentence, rules.POST_HOC),
        "quoted": quote.isNotNull() & ~F.coalesce(speaker.rlike("|".join(rules.FIRST_PERSON)), F.lit(False)),
        "weak": _has(scope, rules.WEAK), "very_weak": _has(scope, rules.VERY_WEAK)})
    u = u.withColumns({"stance": F.when(F.expr("negated or conditional or quoted or post_hoc"), "UNKNOWN").otherwise(stance0),
                       "text": F.when(F.expr("conditional or quoted or post_hoc"), sentence).otherwise(unit)})
    text, directed = F.col("text"), F.col("stance").isin("LONG", "SHORT")
    u = u.withColumn("numbers", F.when(directed, _numbers(text))).withColumn("range", F.when(F.col("stance") != "UNKNOWN", F.get(_ranges(text), F.lit(0))))
    u = u.withColumn("numbers", _outside(F.col("numbers"), F.col("range")))
    entries = F.when(F.col("range").isNull(), _ordered(F.col("numbers"), "entry"))
    free = F.when(F.col("range").isNull(), _ordered(F.filter("numbers", lambda x: x.stop.isNull() & x.target.isNull()), "entry"))
    u = u.withColumn("entry", F.coalesce(F.get(free, F.lit(0)), F.get(entries, F.lit(0))))
    u = u.withColumn("low", F.coalesce(F.col("range.low"), F.col("entry.value"))).withColumn("stops", _ordered(F.col("numbers"), "stop"))
    u = u.withColumn("stop", F.get(_consistent(F.col("stops"), F.col("low"), F.col("stance") == "SHORT"), F.lit(0)))
    u = u.withColumn("targets", _ordered(_outside(F.col("numbers"), F.col("entry"), F.col("stop")), "target"))
    u = u.withColumn("target", F.get(_consistent(F.col("targets"), F.col("low"), F.col("stance") == "LONG"), F.lit(0)))
    plan = F.expr("low is not null or stop is not null or target is not null")
    c = rules.CONFIDENCE
    sure = F.when(F.col("stance") == "FLAT", c["flat"]).when(plan, c["plan"]).otherwise(c["direction"])
    weak = F.when(F.col("very_weak"), F.least(sure, F.lit(c["very_weak"]))).when(F.col("weak"), F.least(sure, F.lit(c["weak"]))).otherwise(sure)
    known = F.col("stance") != "UNKNOWN"
    marks = F.array_compact(F.array(*[F.when(F.col(x), name) for x, name in (("conditional", "conditional"), ("quoted", "quote-only"), ("post_hoc", "post-hoc"), ("negated", "negated"))]))
    snippet = F.substring(_stripped(F.regexp_replace(text, r"(?U)\s+", " ")), 1, rules.RATIONALE)
    dropped = F.when(directed & (F.size("stops") > 0) & F.col("stop").isNull(), "price_dropped"), F.when(directed & (F.size("targets") > 0) & F.col("target").isNull(), "price_dropped")
    found = F.array_compact(F.array(F.when(F.col("conditional"), "conditional"), F.when(F.col("quoted"), "quote-only"), F.when(F.col("post_hoc"), "post-hoc"),
                                    F.when(F.col("negated"), "negated_direction"), *dropped, F.when(F.col("weak") & known, "weak_language")))
    u = u.withColumns({
        "horizon": horizon_column(text, sentence), "information_type": F.coalesce(information_type_column(sentence), F.when(plan, "TECHNICAL").when(known, "OTHER")),
        "confidence": F.when(known, weak), "entry_low": F.col("low"), "entry_high": F.coalesce(F.col("range.high"), F.col("entry.value")), "stop_loss": F.col("stop.value"),
        "take_profit": F.col("target.value"), "diagnostics": found, "rationale": F.concat(F.when(F.size(marks) > 0, F.concat(F.array_join(marks, "/"), F.lit("："))).otherwise(""), snippet),
        "own": instruments_column(text, names), "near": instruments_column(sentence, names)})
    return u.withColumn("instruments", F.when(F.size("own") > 0, F.col("own")).when(F.size("near") == 1, F.col("near")).otherwise(F.array(F.lit(None).cast("string"))))


def extract_opinions(posts: DataFrame, names: dict[str, list[str]] | None = None, version: str = "rules-2") -> tuple[DataFrame, DataFrame]:
    """(processed, opinions) of posts (post_id, text).

    ``names`` maps codes of instruments to their lower-case aliases. Blank posts are SKIPPED. A post without a
    direction is SUCCESS with no drafts and says why (``reason``: image_only or no_stance_keyword); a unit whose
    direction is negated, conditional, quoted or told afterwards is a draft of stance UNKNOWN. A unit that names
    several instruments gives a draft for each; a code outside ``names`` is kept with a warning.
    """
    known = rules.INSTRUMENTS if names is None else names
    text = F.coalesce("text", F.lit(""))
    text = F.when(F.contains(text, F.lit(_OPEN)) | F.contains(text, F.lit(_CLOSE)), F.translate(text, _OPEN + _CLOSE, "  ")).otherwise(text)
    cut = posts.select("post_id", text.alias("whole")).withColumn("units", units_column(F.col("whole")))
    # Outer, as else a filter on the size of the list repeats all that it is made of.
    units = cut.select("post_id", F.posexplode_outer("units").alias("unit_no", "x")).where("unit_no is not null").select("post_id", "unit_no", "x.*")
    judged = opinion_columns(units, names).withColumn("parser_version", F.lit(version))
    opinions = (judged.select("*", F.posexplode_outer("instruments").alias("instrument_no", "instrument"))
                .withColumn("warnings", F.array_compact(F.array(F.when(~F.col("instrument").isin(*known), "unknown_instrument"))))
                .select("post_id", "parser_version", "unit_no", "instrument_no", *[x.split(" ")[0] for x in OPINION.split(", ")]))
    blank = _stripped(F.col("whole")) == ""
    processed = cut.select("post_id", F.when(blank, "SKIPPED").otherwise("SUCCESS").alias("status"), F.lit(None).cast("string").alias("error"),
                           F.when(blank, "empty_text").when(F.size("units") == 0, F.when(_has(F.col("whole"), rules.IMAGE), "image_only").otherwise("no_stance_keyword")).alias("reason"),
                           F.lit(version).alias("parser_version"), F.size("units").alias("n_units"))
    return processed, opinions


def extract_with(posts: DataFrame, extractor: Callable, version: str) -> tuple[DataFrame, DataFrame]:
    """(processed, drafts) of any ``extractor``: text -> list of dicts with the fields of OPINION, run in Arrow batches.

    A failure of the extractor is the row's own.
    """
    fields = [x.split(" ")[0] for x in OPINION.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for post, text in zip(pdf["post_id"], pdf["text"]):
                if text is None or not text.strip():
                    rows.append((post, "SKIPPED", None, []))
                    continue
                try:
                    rows.append((post, "SUCCESS", None, [{f: o.get(f) for f in fields} for o in extractor(text)]))
                except Exception as e:  # isolated: one post must not stop the job
                    rows.append((post, "FAILED", f"{type(e).__name__}: {e}"[:300], []))
            yield pd.DataFrame(rows, columns=["post_id", "status", "error", "drafts"])

    kinds = ", ".join(f"{name}: {kind}" for name, kind in (x.split(" ", 1) for x in OPINION.split(", ")))
    done = posts.select("post_id", "text").mapInPandas(run, f"post_id bigint, status string, error string, drafts array<struct<{kinds}>>").withColumn("parser_version", F.lit(version))
    drafts = done.select("post_id", "parser_version", F.posexplode("drafts").alias("unit_no", "o")).select("post_id", "parser_version", "unit_no", "o.*")
    return done.withColumn("n_units", F.size("drafts")).drop("drafts"), drafts


def pending_posts(posts: DataFrame, processed: DataFrame, version: str) -> DataFrame:
    """Posts that this version has not processed."""
    return posts.join(processed.where(F.col("parser_version") == version).select("post_id"), "post_id", "left_anti")


def pipeline_report(processed: DataFrame, opinions: DataFrame) -> DataFrame:
    n = processed.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    d = opinions.select(F.explode("diagnostics").alias("status")).groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    return n.unionByName(d.withColumn("status", F.concat(F.lit("diagnostic:"), "status")))
