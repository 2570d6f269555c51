"""URL filter: explicit rules first, then naive Bayes over the words of hosts and paths.

The letter runs of every host and path are split into words by a unigram Viterbi search (``freebets`` becomes
``free bets``), with word counts from a corpus. Blocked words of the caller mark URLs that hold one; a multinomial
naive Bayes model learns from all distinct URLs what else marked ones are made of, so ``cheap`` or ``win`` count by
the company they keep, and it judges each URL that no rule fits.

Everything is counted over all rows. Each distinct run is split once and each distinct URL is scored once; runs,
words and URLs that hold many rows are joined by broadcast (at most 500 of them) and stay where they are, the
others are shuffled. Candidate words meet their counts in a join, so no task holds the vocabulary.

A null URL, or one without ``://``, has an empty host and path: no rule fits and no word speaks, so the prior
decides (allow, as long as fewer than half of the URLs are marked). Repeated rows and identifiers are judged row by
row; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .skew import join_counted

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Letters of the longest word that is looked up; longer runs are made of several.
LONGEST = 24
#: Whatever is no letter: ASCII apart from a-z.
NO_LETTER = r"[\x00-\x60\x7b-\x7f]+"

#: Words that mark a URL.
BLOCKED_WORDS = [
    "ad", "ads", "adserver", "adult", "banner", "bet", "bets", "betting", "casino", "casinos", "clickbait", "crack", "cracks",
    "escort", "escorts", "gamble", "gambling", "hentai", "jackpot", "keygen", "lottery", "malware", "milf", "naked", "nude",
    "nudes", "payday", "pharma", "pharmacy", "phishing", "pill", "pills", "poker", "popunder", "porn", "porno", "roulette",
    "scam", "sex", "sexy", "slots", "spam", "spyware", "tracker", "viagra", "warez", "webcam", "xxx"]
#: Occurrences that a blocked word has among marked URLs beforehand, and any word in either class.
SEED_COUNT, SMOOTHING = 0.1, 0.1
#: Weights are whole numbers of such parts of a nat, so that sums do not depend on their order.
PARTS = 1_000_000


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) up to ``/``, ``?``, ``#`` or the end, and path up to ``?``, ``#`` or the end."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """(rule, verdict) of the longest of ``rules`` (verdict, host, path) that fits, else null.

    Of rules of one length the one with the longer host wins, then block. The list is part of the plan, so
    it is meant for some hundreds of rules.
    """
    fits = [F.when(((host == h) | host.endswith("." + h)) & path.startswith(p),
                   F.struct(F.lit(len(h + p)).alias("size"), F.lit(len(h)).alias("host_size"), F.lit(v).alias("verdict"), F.lit(h + p).alias("rule")))
            for v, h, p in rules]
    return F.array_max(F.array_compact(F.array(*fits))) if fits else F.lit(None).cast("struct<verdict: string, rule: string>")


def letter_runs(text: Column) -> Column:
    return F.filter(F.split(F.translate(text, UPPER, LOWER), NO_LETTER), lambda r: r != "")


def count_words(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n): how often each run of letters stands in the texts, A-Z lower-cased; long ones are left out."""
    words = texts.select(F.explode(letter_runs(F.coalesce(F.col(text_col), F.lit("")))).alias("word"))
    return words.where(F.length("word") <= LONGEST).groupBy("word").agg(F.count("*").alias("n"))


def viterbi(run: str, known: dict[tuple[int, int], int], total: int) -> list[str]:
    """The likeliest words of ``run``; ``known``: count by (start, length). Fewer words first where equally likely.

    A string that is no known word is one with 10 / (total * 10 ** length) of the mass.
    """
    base = math.log(total + 1)
    best: list[tuple[float, int, int]] = [(0.0, 0, 0)]
    for end in range(1, len(run) + 1):
        options = []
        for size in range(1, min(LONGEST, end) + 1):
            n = known.get((end - size, size))
            cost = base - math.log(n) if n else base + (size - 1) * math.log(10)
            before = best[end - size]
            options.append((before[0] + cost, before[1] + 1, end - size))
        best.append(min(options))
    out, end = [], len(run)
    while end:
        start = best[end][2]
        out.append(run[start:end])
        end = start
    return out[::-1]


def segment(runs: DataFrame, words: DataFrame, run_col: str = "run") -> DataFrame:
    """``runs`` (distinct) with ``words``: the likeliest words of each by the counts (word, n) of ``words``."""
    total = words.agg(F.sum("n")).first()[0] or 0
    parts = (runs.select(run_col, F.explode(F.sequence(F.lit(1), F.length(run_col))).alias("i"))
             .select(run_col, "i", F.explode(F.sequence(F.lit(1), F.least(F.lit(LONGEST), F.length(run_col) - F.col("i") + 1))).alias("m"))
             .select(run_col, "i", "m", F.substring(run_col, F.col("i"), F.col("m")).alias("word")))
    met = parts.join(words, "word").groupBy(run_col).agg(F.collect_list(F.struct("i", "m", "n")).alias("known"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [viterbi(run, {(k["i"] - 1, k["m"]): k["n"] for k in known or []}, total)
                     for run, known in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.record_batch([batch.column(0), pa.array(found, pa.list_(pa.string()))], names=["run", "words"])

    # Left join: a run without any known word is split as well.
    whole = runs.select(run_col).join(met, run_col, "left").select(run_col, "known")
    return whole.mapInArrow(split, "run string, words array<string>").withColumnRenamed("run", run_col)


def filter_urls(pages: DataFrame, words: DataFrame, rules: list[tuple[str, str, str]], blocked: list[str] | None = None,
                id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """id_col, host, path, rule, verdict, score: one row per row of ``pages``.

    ``words``: (word, n) of a corpus, see ``count_words``. ``blocked``: the marking words. ``score`` is the
    log-odds of the model, in nats; a URL without a rule is blocked where it is above 0.
    """
    spark, blocked = pages.sparkSession, sorted(set(BLOCKED_WORDS if blocked is None else blocked))
    scratch = Scratch(spark, "urls")
    host, path = host_and_path(F.col(url_col))
    judged = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    judged = judged.withColumn("fit", fitting_rule(F.col("host"), F.col("path"), rules))

    urls = scratch.save(judged.groupBy("host", "path").agg(F.count("*").alias("n_rows"))
                        .withColumn("runs", F.concat(letter_runs(F.col("host")), letter_runs(F.col("path")))), "urls")
    uses = urls.select("host", "path", F.explode("runs").alias("run"))
    # A blocked word may be absent from the corpus, so each is counted as one in ten thousand words more.
    counted = scratch.save(words, "corpus")
    seed = math.ceil((counted.agg(F.sum("n")).first()[0] or 0) / 10_000) + 1
    marks = spark.createDataFrame([(w, seed) for w in blocked], "word string, n long")
    known = scratch.save(counted.unionByName(marks).groupBy("word").agg(F.sum("n").alias("n")), "words")
    runs = uses.groupBy("run").agg(F.count("*").alias("n_uses"))
    runs = scratch.save(runs.join(segment(runs, known), "run").withColumn("marked", F.arrays_overlap("words", F.array(*map(F.lit, blocked))) if blocked else F.lit(False)), "runs")
    n_uses = runs.agg(F.sum("n_uses")).first()[0] or 0
    told = scratch.save(join_counted(uses, runs, ["run"], "n_uses", n_uses).groupBy("host", "path").agg(
        F.flatten(F.collect_list("words")).alias("words"), F.max("marked").alias("marked")), "tokens")

    # Naive Bayes: what each word weighs, from its counts in marked and other URLs.
    tokens = told.select("host", "path", "marked", F.explode("words").alias("word"))
    counts = tokens.groupBy("word").agg(F.count_if("marked").alias("bad"), F.count_if(~F.col("marked")).alias("good"))
    counts = scratch.save(counts.join(marks.withColumn("one", F.lit(1)), "word", "full").select(
        "word", F.coalesce("bad", F.lit(0)).alias("bad"), F.coalesce("good", F.lit(0)).alias("good"),
        F.coalesce(F.col("one"), F.lit(0)).alias("seed")), "counts")
    bad, good, n_words = (x or 0 for x in counts.agg(F.sum("bad"), F.sum("good"), F.count("*")).first())
    bad_urls, all_urls = told.where("marked").count(), urls.count()
    prior = round(PARTS * math.log((bad_urls + SMOOTHING) / (all_urls - bad_urls + SMOOTHING))) if all_urls else 0
    mass = SMOOTHING * n_words
    weight = F.log((F.col("bad") + SEED_COUNT * F.col("seed") + SMOOTHING) / (bad + SEED_COUNT * len(blocked) + mass)) - F.log((F.col("good") + SMOOTHING) / (good + mass))
    weights = counts.select("word", F.round(weight * PARTS).cast("long").alias("weight"), (F.col("bad") + F.col("good")).alias("n_tokens"))
    summed = join_counted(tokens.select("host", "path", "word"), weights, ["word"], "n_tokens", bad + good).groupBy("host", "path").agg(F.sum("weight").alias("weight"))
    scores = scratch.save(urls.select("host", "path", "n_rows").join(summed, ["host", "path"], "left").select(
        "host", "path", "n_rows", (F.coalesce("weight", F.lit(0)) + prior).alias("weight")), "scores")

    n_rows = scores.agg(F.sum("n_rows")).first()[0] or 0
    return join_counted(judged, scores, ["host", "path"], "n_rows", n_rows).select(
        id_col, "host", "path", F.col("fit.rule").alias("rule"),
        F.coalesce(F.col("fit.verdict"), F.when(F.col("weight") > 0, "block").otherwise("allow")).alias("verdict"),
        (F.col("weight") / PARTS).alias("score"))
