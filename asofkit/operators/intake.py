"""From raw rows to records: collection, corpus files, news events and post imports."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..shared import save, small_batches
from .propagation import clusters

MAX_TITLE = 500


def blank(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit(""))) == ""


def _texts(max_text: int):
    """(title, text, title_cut, text_cut, key) of source, record id, title and text: canonical, cut texts, and the key of the record.

    All in one function, since a function of a function's result takes a worker and a copy of the texts of its own.
    It counts as not deterministic so that no filter repeats it.
    """
    def cut(column: pa.Array, n: int) -> tuple[list, list]:
        whole = [None if x is None else tx._canonical(x) or None for x in column.to_pylist()]
        return [x and x[:n] for x in whole], [x is not None and len(x) > n for x in whole]

    @F.arrow_udf("title string, text string, title_cut boolean, text_cut boolean, key string")
    def run(source: pa.Array, record_id: pa.Array, title: pa.Array, text: pa.Array) -> pa.Array:
        (titles, long_titles), (texts, long_texts) = cut(title, MAX_TITLE), cut(text, max_text)
        prints = [tx.content_digest(*x, namespace="collection.processor.content") for x in zip(titles, texts)]
        keys = [tx.content_digest(*x, namespace="collection.processor.identity") for x in zip(source.to_pylist(), record_id.to_pylist(), prints)]
        columns = [pa.array(titles, pa.string()), pa.array(texts, pa.string()), pa.array(long_titles, pa.bool_()), pa.array(long_texts, pa.bool_()), pa.array(keys, pa.string())]
        return pa.StructArray.from_arrays(columns, ["title", "text", "title_cut", "text_cut", "key"])

    return run.asNondeterministic()


def record_issues(record_id: Column, title: Column, text: Column, collected: Column, published: Column, now: Column, tolerance_seconds: int) -> Column:
    """What makes a normalised record unusable; an empty list is fine."""
    checks = [(blank(record_id), "source_record_id: missing"), (collected.isNull(), "collected_at: missing"),
              (blank(title) & blank(text), "content: empty"), (F.coalesce(tx.in_future(published, now, tolerance_seconds), F.lit(False)), "published_at: in_future")]
    return F.filter(F.array(*[F.when(bad, F.lit(code)) for bad, code in checks]), lambda x: x.isNotNull())


def collection_records(rows: DataFrame, known: DataFrame, order: list[Column], now: Column, max_text: int = 20_000, tolerance_seconds: int = 300) -> DataFrame:
    """Rows (source, source_record_id, title, text, published_at, collected_at, effective_floor) as records.

    Adds the normalised title and text, warnings, effective_at, identity, outcome and reasons. A
    record without content or id is REJECTED before it has an identity. The first record of an
    identity registers it, also if its validation then rejects it; later ones and those in
    ``known`` (identity) are DUPLICATE; the others are ACCEPTED. ``now`` is the time of the run, which
    may be a column of the rows.
    """
    small_batches(rows.sparkSession)
    r = rows.withColumn("__x", _texts(max_text)(*[F.col(c).cast("string") for c in ("source", "source_record_id", "title", "text")]))
    usual = F.greatest("published_at", "collected_at")
    warn = [F.when(F.col(f"__x.{c}"), F.lit(c)) for c in ("title_cut", "text_cut")] + [F.when(F.col("effective_floor") > usual, F.lit("effective_floor"))]
    r = r.withColumns({"warnings": F.filter(F.array(*warn), lambda x: x.isNotNull()), "effective_at": F.greatest("published_at", "collected_at", "effective_floor"),
                       "title": F.col("__x.title"), "text": F.col("__x.text")})
    early = F.when(blank(F.col("title")) & blank(F.col("text")), "empty_content").when(blank(F.col("source_record_id")), "missing_source_record_id")
    issues = record_issues(F.col("source_record_id"), F.col("title"), F.col("text"), F.col("collected_at"), F.col("published_at"), now, tolerance_seconds)
    r = r.withColumns({"identity": F.when(early.isNull(), F.col("__x.key")), "reasons": F.when(early.isNotNull(), F.array(early)).otherwise(issues)}).drop("__x")
    # Rows without an identity are spread by their place in the order: they would all be one key.
    r = r.withColumn("__key", F.coalesce("identity", F.concat(F.lit("none "), F.xxhash64(*order).cast("string"))))
    nth = F.row_number().over(Window.partitionBy("__key").orderBy(*order))
    seen = known.select(F.col("identity").alias("__key"), F.lit(True).alias("__known")).where("__key is not null").distinct()
    again = (F.col("__nth") > 1) | F.coalesce("__known", F.lit(False))
    r = r.withColumn("__nth", nth).join(seen, "__key", "left").withColumn("outcome", F.when(F.size("reasons") > 0, "REJECTED").when(again, "DUPLICATE").otherwise("ACCEPTED"))
    return r.select(*rows.columns, "warnings", "effective_at", "identity", "outcome", "reasons")


def corpus_problems(content: Column, published: Column, effective: Column, now: Column, tolerance_seconds: int = 3600) -> Column:
    """Codes of what is wrong with a corpus row whose times are texts with an offset."""
    p, e = tx.strict_time(published), tx.strict_time(effective)
    checks = [(blank(content), "empty_content"), (p.isNull(), "bad_published_at"), (e.isNull(), "bad_effective_at"), (e < p, "effective_before_published"),
              (tx.in_future(p, now, tolerance_seconds), "published_in_future")]
    return F.filter(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(code)) for bad, code in checks]), lambda x: x.isNotNull())


def corpus_route(kind: Column, content: Column, source: Column, prefix: str, least: int) -> Column:
    """Layer of a corpus row: declared events and short texts, opinions from the prefix's sources, background."""
    own = F.startswith(F.lower(F.trim(F.coalesce(source, F.lit("")))), F.lit(prefix.lower())) if prefix else F.lit(False)
    return (F.when(F.upper(F.trim(F.coalesce(kind, F.lit("")))) == "EVENT", "event_layer").when(F.length(F.trim(F.coalesce(content, F.lit("")))) < least, "event_layer")
            .when(own, "opinion_corpus").otherwise("macro_background"))


def first_by_any_key(rows: DataFrame, row: str, keys: list[str]) -> DataFrame:
    """Rows with ``kept``: no earlier kept row, in order of ``row``, has one of its keys. Null or blank keys are none.

    Keys of dropped rows do not count, so the result depends on the order. First, rows that come first for each of
    their keys stay and those that share a key with them go, twice over; that settles keys of very many rows where
    they are. What is then open falls into components of rows that share keys, found in a number of rounds that
    grows with the logarithm of the longest chain. Each component streams through a task in its order; only the keys
    of its kept rows are held.
    """
    pairs = [F.when(~blank(F.col(k)), F.concat(F.lit(f"{k}="), F.trim(F.col(k)))) for k in keys]
    held = save(rows.select(F.col(row).alias("r"), F.explode(F.array(*pairs)).alias("k")).where("k is not null").distinct(), "keys")
    kept, open_ = [held.groupBy("r").count().select("r").limit(0)], held
    for _ in range(2):
        ranked = open_.join(open_.groupBy("k").agg(F.min("r").alias("first")), "k")
        stays = save(ranked.groupBy("r").agg(F.bool_and(F.col("r") == F.col("first")).alias("s")).where("s").select("r"), "stays")
        taken = open_.join(stays, "r", "left_semi").select("k").distinct()
        gone = open_.join(taken, "k", "left_semi").select("r").distinct()  # the kept ones too: they are settled
        kept.append(stays)
        open_ = save(open_.join(gone, "r", "left_anti"), "open")
    links = open_.join(open_.groupBy("k").agg(F.min("r").alias("from_item")), "k").where("r <> from_item").select("from_item", F.col("r").alias("to_item"))
    parts = clusters(open_.select("r", F.col("r").alias("at")).distinct(), links, "r", "at")
    told = open_.groupBy("r").agg(F.collect_list("k").alias("ks")).join(parts, "r")
    kind = rows.schema[row].dataType.simpleString()

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root, taken = None, set()
        for b in batches:
            stays = []
            for one, ks in zip(b.column("root").to_pylist(), b.column("ks").to_pylist()):
                if one != root:
                    root, taken = one, set()
                stays.append(taken.isdisjoint(ks))
                if stays[-1]:
                    taken.update(ks)
            yield pa.record_batch([b.column("r").filter(pa.array(stays, pa.bool_()))], names=["r"])

    last = told.repartition("root").sortWithinPartitions("root", "r").mapInArrow(settle, f"r {kind}")
    kept += [last, rows.select(F.col(row).alias("r")).join(held.select("r").distinct(), "r", "left_anti")]
    all_kept = reduce(DataFrame.unionByName, kept).select(F.col("r").alias(row), F.lit(True).alias("kept"))
    return rows.join(all_kept, row, "left").withColumn("kept", F.coalesce("kept", F.lit(False)))


def in_window(published: Column, start: Column, end: Column) -> Column:
    """Inside a collection window; a row whose time is unknown stays."""
    return published.isNull() | published.between(start, end)


def news_events(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events, counts of those that give none). An ambiguous or missing time is never replaced by the time of collection."""
    why = F.when(F.col("ambiguous"), "ambiguous_zone").when(F.col("published_at").isNull(), "no_time")
    d = items.withColumn("__why", why)
    events = d.where("__why is null").select("source", "source_record_id", F.col("title").alias("headline"), F.col("text").alias("summary"), F.get("categories", F.lit(0)).alias("event_type"),
                                             F.lit(None).cast("double").alias("importance"), F.lit(None).cast("double").alias("sentiment"), "published_at", F.greatest("published_at", "collected_at").alias("effective_at"))
    return events, d.where("__why is not null").groupBy(F.col("__why").alias("why")).agg(F.count(F.lit(1)).alias("n"))


def corpus_row(entries: DataFrame, kind: str = "NEWS") -> DataFrame:
    """Feed entries as corpus rows: no time is guessed, and what is missing is noted."""
    notes = F.concat_ws("; ", F.when(F.col("published_at").isNull(), F.lit("no published time")), F.when(F.col("has_media"), F.lit("has media")),
                        F.lit(None if kind == "NEWS" else f"use={kind}").cast("string"))
    return entries.select(F.col("source_record_id").alias("id"), F.coalesce(F.nullif("text", F.lit("")), "title", F.lit("")).alias("content"), F.coalesce("title", F.lit("")).alias("title"), "published_at",
                          F.coalesce("published_at", "collected_at").alias("effective_at"), "source", "has_media", "collected_at", notes.alias("notes"))


def import_posts(rows: DataFrame, existing: DataFrame, order: list[Column], strict: bool = True) -> DataFrame:
    """Posts to append of rows (source, record_id, content, published_at, effective_at, collected_at).

    Without a time of collection the effective time stands in and is marked as that. A row that
    takes effect before it was published or collected is an error, or without ``strict`` left out.
    Records that are there, or came earlier in the batch, are skipped.
    """
    r = rows.withColumn("collected_at_provenance", F.when(F.col("collected_at").isNull(), "input_effective_at_fallback").otherwise("input"))
    r = r.withColumn("collected_at", F.coalesce("collected_at", "effective_at"))
    bad = F.coalesce(F.col("effective_at") < F.greatest("published_at", "collected_at"), F.lit(True)) | blank(F.col("content"))
    if strict:
        r = r.withColumn("content", F.when(bad, F.raise_error(F.concat(F.lit("bad post "), F.col("record_id")))).otherwise(F.col("content")))
    else:
        r = r.where(~bad)
    nth = F.row_number().over(Window.partitionBy("source", "record_id").orderBy(*order))
    return r.join(existing.select("source", "record_id"), ["source", "record_id"], "left_anti").withColumn("__n", nth).where("__n = 1").drop("__n")


def parse_accounts(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(authors and accounts with typed fields, problems) of text rows: row, author_name, source, external_account_id, verified, followers, meta."""
    flag = F.lower(F.trim("verified"))
    yes, no = flag.isin("true", "1", "yes"), flag.isin("false", "0", "no", "") | flag.isNull()
    n = F.try_to_number(F.trim("followers"), F.lit("999999999999")).cast("long")
    checks = [(blank(F.col("author_name")), "author_name"), (blank(F.col("source")), "source"), (blank(F.col("external_account_id")), "external_account_id"), (~(yes | no), "verified"),
              (~blank(F.col("followers")) & n.isNull(), "followers"), (~blank(F.col("meta")) & F.try_parse_json("meta").isNull(), "meta")]
    r = rows.withColumn("problems", F.filter(F.array(*[F.when(F.coalesce(b, F.lit(False)), F.lit(c)) for b, c in checks]), lambda x: x.isNotNull()))
    fine = r.where(F.size("problems") == 0).select("row", F.trim("author_name").alias("author_name"), F.trim("source").alias("source"), F.trim("external_account_id").alias("external_account_id"), yes.alias("verified"), n.alias("followers"), "meta")
    return fine, r.select("row", F.explode("problems").alias("problem"))


def resolve_symbols(drafts: DataFrame, symbols: DataFrame, symbol: str = "instrument") -> tuple[DataFrame, DataFrame]:
    """(drafts with instrument_id, unknown symbols and how often). Case does not matter; drafts without a symbol stay."""
    s = symbols.select(F.upper("symbol").alias("__s"), "instrument_id")
    d = drafts.join(F.broadcast(s), F.upper(symbol) == F.col("__s"), "left") if symbols.count() < 100_000 else drafts.join(s, F.upper(symbol) == F.col("__s"), "left")
    unknown = F.col(symbol).isNotNull() & F.col("__s").isNull()
    return d.where(~unknown).drop("__s"), d.where(unknown).groupBy(F.upper(symbol).alias("symbol")).agg(F.count(F.lit(1)).alias("n"))


def too_early(opinions: DataFrame, posts: DataFrame) -> DataFrame:
    """Opinions that take effect before their post."""
    p = posts.select("post_id", F.col("effective_at").alias("post_effective_at"))
    return opinions.join(p, "post_id").where("effective_at < post_effective_at")


def date_chunks(ranges: DataFrame, start: str, end: str, days: int) -> DataFrame:
    """Each range of days [start, end] cut into chunks of ``days``, both ends included; a range that ends first is an error."""
    if not 1 <= days <= 365:
        raise ValueError("chunks have 1 to 365 days")
    ordered = F.when(F.col(end) < F.col(start), F.raise_error(F.lit("a range ends before it starts"))).otherwise(F.col(start))
    r = ranges.withColumn("chunk_start", F.explode(F.expr(f"sequence({start}, greatest({start}, {end}), interval {days} days)"))).where(ordered.isNotNull())
    return r.withColumn("chunk_end", F.least(F.col(end), F.date_add("chunk_start", days - 1)))


def authorisation_audit(rows: DataFrame, now: Column, bases: list[str]) -> DataFrame:
    """Rows with ``errors`` and ``approved``: complete, approved, allowed in all three uses and valid now.

    Of rows that repeat source and account all but the first are errors.
    """
    need = ["source", "external_account_id", "authorization_status", "authorization_basis", "authorization_reference", "reviewed_at", "valid_from"]
    uses = ["permits_automated_collection", "permits_local_storage", "permits_research_use"]
    at = {c: tx.strict_time(F.col(c)) for c in ("reviewed_at", "valid_from", "expires_at")}
    missing = F.filter(F.array(*[F.when(blank(F.col(c)), F.lit(c)) for c in need]), lambda x: x.isNotNull())
    whole = F.size(missing) == 0
    status = F.upper(F.trim("authorization_status")) == "APPROVED"
    nth = F.row_number().over(Window.partitionBy(whole, F.trim("source"), F.trim("external_account_id")).orderBy("row"))
    yes = lambda c: F.lower(F.trim(F.coalesce(F.col(c), F.lit("")))).isin("1", "true", "yes")
    untimed = at["reviewed_at"].isNull() | at["valid_from"].isNull() | (~blank(F.col("expires_at")) & at["expires_at"].isNull())
    late = [(~F.lower(F.trim("authorization_basis")).isin(bases), "basis"), (~tx.valid_reference(F.trim("authorization_reference")), "reference"), (~(yes(uses[0]) & yes(uses[1]) & yes(uses[2])), "uses"),
            (untimed, "times"), (~untimed & (at["reviewed_at"] > now), "reviewed_in_future"), (~untimed & (at["valid_from"] > now), "not_yet_valid"),
            (~untimed & (at["expires_at"] <= now), "expired"), (~untimed & (at["expires_at"] <= at["valid_from"]), "empty_range")]
    checks = [(~whole, "missing_values"), (whole & (nth > 1), "repeated_account"), (whole & ~status, "not_approved"), *[(whole & status & bad, code) for bad, code in late]]
    r = rows.withColumn("errors", F.filter(F.array(*[F.when(F.coalesce(b, F.lit(False)), F.lit(c)) for b, c in checks]), lambda x: x.isNotNull()))
    return r.withColumn("approved", F.size("errors") == 0)


def gateway_author(raw: Column, contract: str = "evidence-intake-v1") -> Column:
    """Whether a raw JSON item may enter the author chain."""
    at = lambda p: F.get_json_object(raw, f"$.evidence.{p}")
    named = [~blank(at(c)) for c in ("source", "source_record_id", "author_name", "external_account_id")]
    fine = (F.trim(at("contract_version")) == contract) & (F.lower(F.trim(at("scope"))) == "author") & (at("oos_eligible") == "true")
    for n in named:
        fine &= n
    return F.coalesce(fine, F.lit(False))


def listing(dim: DataFrame, order: list[Column], status: str | None = None, deleted: bool = False) -> DataFrame:
    """A dimension's rows in order, without deleted ones unless asked for; count() of it is the total."""
    d = dim if deleted else dim.where("deleted_at is null")
    return (d if status is None else d.where(F.col("status") == status)).orderBy(*order)
