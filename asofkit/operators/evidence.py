"""Evidence rows: assessment by rules, identity against the store, readiness of what is certified."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import redact, strict_time, valid_reference
from .bars import reasons

YES = ["1", "true", "yes", "y"]
QUARANTINE = ["MISSING_IDENTITY", "MISSING_CONTENT", "BAD_PUBLISHED_AT", "BAD_COLLECTED_AT", "BAD_AVAILABLE_AT", "TIME_ORDER", "FUTURE_TIME", "CREDENTIAL",
              "BAD_REFERENCE", "MOCK", "UNAUTHORISED", "WINDOW_ORDER"]


def truthy(c: Column) -> Column:
    return F.coalesce(F.lower(F.trim(c)).isin(YES), F.lit(False))


def is_mock(flag: Column, kind: Column) -> Column:
    return truthy(flag) | F.coalesce(F.lower(F.trim(kind)).isin("mock", "synthetic", "demo", "test", "sample"), F.lit(False))


def canonical_columns(df: DataFrame, aliases: dict[str, list[str]]) -> tuple[DataFrame, list[str]]:
    """(canonical columns filled from their aliases in order, names that no alias covers)."""
    names = {c.lower(): c for c in df.columns}
    picked, used = [], set()
    for target, others in aliases.items():
        have = [names[a.lower()] for a in [target, *others] if a.lower() in names]
        used |= set(have)
        picked.append((F.coalesce(*[F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")) for c in have]) if have else F.lit(None).cast("string")).alias(target))
    return df.select(*picked), [c for c in df.columns if c not in used]


def assess(rows: DataFrame, now: Column) -> DataFrame:
    """Reason codes of each row; quarantine codes keep it out, others only bar it from evaluation."""
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    pub, col, av, lo, hi = (strict_time(F.col(c)) for c in ("published_at", "collected_at", "available_at", "valid_from", "expires_at"))
    given = lambda c: ~blank(c)
    rules = reasons(
        MISSING_IDENTITY=blank("source") | blank("source_record_id"), MISSING_CONTENT=blank("content"),
        BAD_PUBLISHED_AT=given("published_at") & pub.isNull(), BAD_COLLECTED_AT=col.isNull(), BAD_AVAILABLE_AT=given("available_at") & av.isNull(),
        TIME_ORDER=pub > col, FUTURE_TIME=(col > now) | (pub > now), CREDENTIAL=redact(F.col("content")) != F.col("content"),
        BAD_REFERENCE=given("url") & ~valid_reference(F.col("url")), MOCK=is_mock(F.col("is_mock"), F.col("record_kind")),
        UNAUTHORISED=F.coalesce(F.col("authorization_status"), F.lit("")) != "approved", WINDOW_ORDER=lo >= hi,
        OUTSIDE_WINDOW=(col < lo) | (col >= hi), NO_RESEARCH_USE=~truthy(F.col("permits_research_use")), NO_STORAGE=~truthy(F.col("permits_local_storage")),
        NO_AVAILABILITY_PROOF=av.isNull(), AVAILABILITY_OUTSIDE=(av < pub) | (av > col))
    out = rows.withColumn("reasons", rules)
    return (out.withColumn("quarantined", F.arrays_overlap("reasons", F.array(*[F.lit(q) for q in QUARANTINE])))
            .withColumn("oos_eligible", F.size("reasons") == 0))


def reason_counts(assessed: DataFrame) -> DataFrame:
    return assessed.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def identity_status(batch: DataFrame, store: DataFrame, key: list[str], content: str, order: list[Column]) -> DataFrame:
    """ACCEPTED, DUPLICATE (same key and content, or a repeat in the batch) or IDENTITY_CONFLICT."""
    known = store.select(*key, F.col(content).alias("__stored"))
    n = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    j = batch.withColumn("__n", n).join(known, key, "left")
    return j.withColumn("status", F.when(F.col("__stored").isNotNull() & (F.col("__stored") != F.col(content)), "IDENTITY_CONFLICT")
                        .when(F.col("__stored").isNotNull() | (F.col("__n") > 1), "DUPLICATE").otherwise("ACCEPTED")).drop("__n", "__stored")


def attribute(rows: DataFrame, accounts: DataFrame, sources: DataFrame) -> DataFrame:
    """How a row relates to known accounts: attributed, unknown source, identity conflict or new."""
    a = accounts.select("source", "account", F.col("author").alias("__author"))
    s = sources.select("source", F.lit(True).alias("__known"))
    j = rows.join(a, ["source", "account"], "left").join(s, "source", "left")
    return j.withColumn("attribution", F.when(F.col("__known").isNull(), "UNKNOWN_SOURCE").when(F.col("__author").isNull(), "NEW")
                        .when(F.col("__author") != F.col("author"), "IDENTITY_CONFLICT").otherwise("ATTRIBUTED")).drop("__author", "__known")


def author_input(posts: DataFrame, windows: DataFrame, now: Column, min_chars: int = 90, min_posts: int = 30) -> DataFrame:
    """Rows of an author's input with their problems, and whether every account has enough clean rows."""
    first = lambda *k: F.row_number().over(Window.partitionBy(*k).orderBy("row")) > 1
    ok = windows.select(F.col("account").alias("__a"), "valid_from", "expires_at")
    d = posts.withColumn("__name", F.min("author").over(Window.partitionBy("account")) != F.max("author").over(Window.partitionBy("account")))
    d = d.withColumn("__dup_id", first("account", "post_id")).withColumn("__dup_body", first("body_key"))
    j = d.join(ok, (F.col("account") == F.col("__a")) & (F.col("published_at") >= F.col("valid_from")) & (F.col("expires_at").isNull() | (F.col("published_at") < F.col("expires_at"))), "left")
    rules = reasons(MISSING_FIELD=F.col("account").isNull() | F.col("post_id").isNull() | F.col("published_at").isNull(), MANY_NAMES=F.col("__name"),
                    DUPLICATE_ID=F.col("__dup_id"), DUPLICATE_BODY=F.col("__dup_body"), TOO_SHORT=F.col("n_chars") < min_chars,
                    TIME_ORDER=F.col("collected_at") <= F.col("published_at"), FUTURE_TIME=F.col("collected_at") > now, OUTSIDE_WINDOW=F.col("__a").isNull())
    out = j.withColumn("problems", rules)
    clean = F.count_if(F.size("problems") == 0).over(Window.partitionBy("account"))
    return out.withColumn("account_ready", clean >= min_posts).select(*posts.columns, "problems", "account_ready")


def readiness(certified: DataFrame, scopes: list[str], min_rows: int, min_days: int, max_share: float) -> DataFrame:
    """Per scope: rows, span in days, share of the largest source, and the three checks.

    Scopes without rows are there too; a share that cannot be computed does not pass.
    """
    per_source = certified.groupBy("scope", "source").agg(F.count_distinct("item").alias("n"), F.min("available_at").alias("lo"), F.max("available_at").alias("hi"))
    g = per_source.groupBy("scope").agg(F.sum("n").alias("n"), F.max("n").alias("top"), F.count(F.lit(1)).alias("sources"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    all_ = certified.sparkSession.createDataFrame([(s,) for s in scopes], "scope string").join(g, "scope", "left").fillna(0, ["n", "sources"])
    share = F.try_divide(F.col("top"), F.col("n"))
    days = F.coalesce(F.datediff("hi", "lo"), F.lit(0))
    check = lambda name, current, need, ok: F.struct(F.lit(name).alias("metric"), current.cast("double").alias("current"), F.lit(float(need)).alias("required"),
                                                     F.when(F.coalesce(ok, F.lit(False)), "PASS").otherwise("FAIL").alias("status"),
                                                     F.greatest(F.lit(need) - current, F.lit(0)).cast("double").alias("remaining"))
    checks = F.array(check("rows", F.col("n"), min_rows, F.col("n") >= min_rows), check("days", days, min_days, days >= min_days),
                     F.struct(F.lit("max_source_share").alias("metric"), share.alias("current"), F.lit(max_share).alias("required"),
                              F.when(F.coalesce(share <= max_share, F.lit(False)), "PASS").otherwise("FAIL").alias("status"), F.lit(None).cast("double").alias("remaining")))
    return all_.select("scope", F.explode(checks).alias("c")).select("scope", "c.*")


AUTHOR_FIELDS = ["source", "id", "external_account_id", "author_name", "content", "url", "published_at", "collected_at", "effective_at", "collection_time_provenance", "source_type", "has_media"]


def web_key(url: Column) -> Column:
    """scheme, host, port, path and query of a http address, scheme and host in lower case; null for anything else."""
    p = r"(?i)^(https?)://(?:[^/?#@]*@)?([^/?#:@\s]+)(?::([0-9]{1,5}))?([/?#].*)?$"
    rest = lambda q: F.regexp_extract(F.regexp_extract(url, p, 4), q, 1)
    part = lambda i: F.regexp_extract(url, p, i)
    port = F.when(part(3) != "", F.concat(F.lit(":"), part(3).cast("int").cast("string"))).otherwise("")
    return F.when(url.rlike(p), F.concat(F.lower(part(1)), F.lit("://"), F.lower(part(2)), port, rest("^([^?#]*)"), F.lit("?"), rest(r"^[^?#]*\?([^#]*)")))


def author_audit(rows: DataFrame, windows: DataFrame, now: Column, min_chars: int = 90) -> DataFrame:
    """Text rows of AUTHOR_FIELDS, numbered by ``row``, with their problems.

    A row that lacks a field has that problem alone and is no earlier row to any other. Names of an account, record
    identifiers, bodies (without regard to case and white space) and addresses are held against those of earlier rows;
    the first row of each is found map-side, so a body that very many rows repeat is no task's work alone. ``windows``:
    (source, account, valid_from, expires_at), one for each authorised account; an account without one is a problem of its rows.
    """
    missing = reduce(lambda x, c: x | (F.trim(F.coalesce(F.col(c), F.lit(""))) == ""), AUTHOR_FIELDS, F.lit(False))
    d = rows.select("row", *[F.trim(c).alias(c) for c in AUTHOR_FIELDS], missing.alias("missing"))
    d = d.withColumns({"account": F.concat_ws("\x1f", "source", "external_account_id"), "identity": F.concat_ws("\x1f", "source", "id"), "url_key": web_key(F.col("url")),
                       "body": F.sha2(F.lower(F.trim(F.regexp_replace("content", r"\s+", " "))), 256)})
    whole = d.where(~F.col("missing"))
    for key in ("identity", "body", "url_key"):
        first = whole.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("row").alias(f"first_{key}"))
        d = d.join(first, key, "left")
    d = d.join(whole.groupBy("account").agg(F.min_by("author_name", "row").alias("first_name")), "account", "left")
    allowed = windows.select(F.concat_ws("\x1f", "source", "account").alias("account"), "valid_from", "expires_at", F.lit(True).alias("authorised"))
    d = d.join(allowed, "account", "left")
    published, collected, effective = (strict_time(F.col(c)) for c in ("published_at", "collected_at", "effective_at"))
    bad_time = published.isNull() | collected.isNull() | effective.isNull()
    seen = lambda key: F.col("row") > F.col(f"first_{key}")
    rules = reasons(
        MANY_NAMES=F.col("author_name") != F.col("first_name"), DUPLICATE_ID=seen("identity"), DUPLICATE_BODY=seen("body"), TOO_SHORT=F.length("content") < min_chars,
        BAD_URL=F.col("url_key").isNull(), DUPLICATE_URL=seen("url_key"), BAD_TIME=bad_time, TIME_ORDER=~bad_time & (collected <= published),
        EFFECTIVE=~bad_time & (effective != F.greatest(published, collected)), FUTURE_TIME=~bad_time & ((published > now) | (collected > now)),
        OUTSIDE_WINDOW=~bad_time & ((collected < F.col("valid_from")) | (collected >= F.col("expires_at"))), PROVENANCE=F.col("collection_time_provenance") != "independent_observation",
        SOURCE_TYPE=F.upper("source_type") != "NEWS", HAS_MEDIA=~F.lower("has_media").isin("true", "false"), NOT_AUTHORISED=F.col("authorised").isNull())
    return d.select("row", "source", "external_account_id", "author_name", F.when(F.col("missing"), F.array(F.lit("MISSING_FIELD"))).otherwise(rules).alias("problems"))


def author_audit_summary(audit: DataFrame) -> DataFrame:
    """(rows, errors, accounts, fewest, ready): ready means rows, no problem, and enough rows of every account."""
    whole = audit.where(~F.array_contains("problems", "MISSING_FIELD"))
    per = whole.groupBy("source", "external_account_id").agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("accounts"), F.coalesce(F.min("n"), F.lit(0)).alias("fewest"))
    all_ = audit.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.size("problems")), F.lit(0)).alias("errors"))
    return all_.join(per).withColumn("ready", (F.col("rows") > 0) & (F.col("errors") == 0) & (F.col("accounts") > 0) & (F.col("fewest") >= AUTHOR_SAMPLES))  # one row each


#: Smallest numbers of trusted posts of an account and of news, days that news must span, and the share of one source.
AUTHOR_SAMPLES, NEWS_EVENTS, NEWS_DAYS, NEWS_SHARE = 30, 200, 90, 0.40
_CLAIM = "evidence struct<contract_version: string, scope: string, source: string, available_at: string, oos_eligible: boolean>"


def ledger(raw: DataFrame, contract: str, scopes: tuple[str, ...] = ("author", "news"), column: str = "raw_json") -> DataFrame:
    """Per scope: certified, eligible and not_eligible records, evidence_start, evidence_end, max_source_share, source_counts.

    Certified is a record whose JSON carries evidence of this contract and a known scope; eligible one whose evidence
    says so with a JSON true. The window and the sources are those of eligible records; a blank source is none. Every
    scope has a row, with zeros where there is nothing.
    """
    e = raw.select(F.from_json(column, _CLAIM)["evidence"].alias("e")).select("e.*")
    e = e.where(F.trim("contract_version") == contract).withColumn("scope", F.lower(F.trim("scope"))).where(F.col("scope").isin(*scopes))
    ok = F.coalesce("oos_eligible", F.lit(False))
    name = F.nullif(F.substring(redact(F.trim(F.coalesce("source", F.lit("")))), 1, 100), F.lit(""))
    at = F.when(ok, strict_time(F.col("available_at")))
    per = e.withColumn("source", F.when(ok, name)).groupBy("scope", "source").agg(
        F.count(F.lit(1)).alias("certified"), F.count_if(ok).alias("eligible"), F.min(at).alias("lo"), F.max(at).alias("hi"))
    named = F.struct("source", F.col("eligible").alias("n"))
    g = per.groupBy("scope").agg(F.sum("certified").alias("certified"), F.sum("eligible").alias("eligible"), F.min("lo").alias("evidence_start"), F.max("hi").alias("evidence_end"),
                                 F.max(F.when(F.col("source").isNotNull(), F.col("eligible"))).alias("top"), F.sum(F.when(F.col("source").isNotNull(), F.col("eligible"))).alias("known"),
                                 F.array_sort(F.collect_list(F.when(F.col("source").isNotNull(), named))).alias("source_counts"))
    out = raw.sparkSession.createDataFrame([(x,) for x in scopes], "scope string").join(g, "scope", "left").fillna(0, ["certified", "eligible"])
    return out.select("scope", "certified", "eligible", (F.col("certified") - F.col("eligible")).alias("not_eligible"), "evidence_start", "evidence_end",
                      F.coalesce(F.try_divide("top", "known"), F.lit(0.0)).alias("max_source_share"), F.coalesce("source_counts", F.array()).alias("source_counts"))


def author_gaps(posts: DataFrame) -> DataFrame:
    """Per author: opinions, trusted_posts, min_account_samples, identity_consistent and PASS or BLOCKED.

    Rows are opinions: author, account, post_id, trusted. An author passes if each of their accounts has enough trusted
    posts and no account is another author's too.
    """
    account = posts.groupBy("account", "author").agg(F.count(F.lit(1)).alias("opinions"), F.count_distinct(F.when(F.col("trusted"), F.col("post_id"))).alias("n"))
    shared = account.groupBy("account").agg(F.count_distinct("author").alias("owners")).where("owners > 1").select("account", F.lit(True).alias("shared"))
    g = account.join(shared, "account", "left").groupBy("author").agg(F.sum("opinions").alias("opinions"), F.sum("n").alias("trusted_posts"), F.min("n").alias("min_account_samples"),
                                                                      (F.count("shared") == 0).alias("identity_consistent"))
    return g.withColumn("status", F.when(F.col("identity_consistent") & (F.col("min_account_samples") >= AUTHOR_SAMPLES), "PASS").otherwise("BLOCKED"))


def qualification(authors: DataFrame, news: DataFrame, books: DataFrame) -> DataFrame:
    """The gaps of both chains as rows (key, scope, current, required, comparator, status).

    ``authors``: of ``author_gaps``; ``news``: (source, available_at) of usable events; ``books``: of ``ledger``. What only
    a person can approve is always BLOCKED, and nothing passes for want of data.
    """
    a = authors.agg(F.count(F.lit(1)).alias("authors"), F.coalesce(F.min("min_account_samples"), F.lit(0)).alias("least"), F.count_if("identity_consistent").alias("consistent"),
                    F.count_if(F.col("status") == "PASS").alias("ready"))
    per = news.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.min("available_at").alias("lo"), F.max("available_at").alias("hi"))
    n = per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("events"), F.coalesce(F.max("n"), F.lit(0)).alias("top"),
                F.coalesce(F.expr("(unix_seconds(cast(max(hi) as timestamp)) - unix_seconds(cast(min(lo) as timestamp))) div 86400"), F.lit(0)).alias("days"))
    eligible = [F.coalesce(F.max(F.when(F.col("scope") == s, F.col("eligible"))), F.lit(0)).alias(f"{s}_eligible") for s in ("author", "news")]
    facts = a.join(n).join(books.agg(*eligible))  # one row each
    share = F.try_divide("top", "events")

    def gap(key: str, current: Column, need: str, comparator: str, ok: Column) -> Column:
        return F.struct(F.lit(key).alias("key"), F.lit(key.split(".")[0]).alias("scope"), current.cast("string").alias("current"), F.lit(need).alias("required"),
                        F.lit(comparator).alias("comparator"), F.when(F.coalesce(ok, F.lit(False)), "PASS").otherwise("BLOCKED").alias("status"))

    some, never = F.col("authors") > 0, F.lit(False)
    gaps = F.array(
        gap("author.trusted_posts_per_account", F.col("least"), str(AUTHOR_SAMPLES), ">=", some & (F.col("ready") == F.col("authors"))),
        gap("author.identity_consistency", F.concat_ws("/", F.col("consistent").cast("string"), F.col("authors").cast("string")), "all", "==", some & (F.col("consistent") == F.col("authors"))),
        gap("author.source_authorization", F.lit("unverified"), "approved by a person", "human_gate", never),
        gap("news.events", F.col("events"), str(NEWS_EVENTS), ">=", F.col("events") >= NEWS_EVENTS), gap("news.history_days", F.col("days"), str(NEWS_DAYS), ">=", F.col("days") >= NEWS_DAYS),
        gap("news.max_source_share", F.round(F.coalesce(share, F.lit(0.0)), 6), str(NEWS_SHARE), "<=", share <= NEWS_SHARE),
        gap("news.available_history_evidence", F.lit("unverified"), "approved by a person", "human_gate", never),
        *[gap(f"{s}.evidence_intake_oos_eligible", F.col(f"{s}_eligible"), str(need), ">=", F.col(f"{s}_eligible") >= need) for s, need in (("author", AUTHOR_SAMPLES), ("news", NEWS_EVENTS))])
    return facts.select(F.explode(gaps).alias("g")).select("g.*")


def account_readiness(posts: DataFrame, min_posts: int = 30) -> DataFrame:
    """Trusted posts per account; every account must reach the number and have one author."""
    g = posts.where("trusted").groupBy("account").agg(F.count_distinct("post_id").alias("n"), F.count_distinct("author").alias("authors"))
    return g.agg(F.count(F.lit(1)).alias("accounts"), F.min("n").alias("fewest"), F.bool_and(F.col("n") >= min_posts).alias("enough"),
                 F.bool_and(F.col("authors") == 1).alias("one_author_each"))


def revalidate(decisions: DataFrame, packages: DataFrame) -> DataFrame:
    """Latest decision per fingerprint against the packages of today."""
    w = Window.partitionBy("fingerprint").orderBy(F.col("decided_at").desc(), F.col("decision_id").desc())
    last = decisions.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
    p = packages.select("package", F.col("fingerprint").alias("now"), "passing")
    j = last.join(p, "package", "left")
    why = F.when(F.col("now").isNull(), "MISSING").when(F.col("now") != F.col("fingerprint"), "CHANGED").when(~F.col("passing"), "NOT_PASSING")
    return j.withColumn("invalid_reason", why).withColumn("valid", (F.col("decision") == "APPROVED") & why.isNull()).drop("now", "passing")


def draft_problems(drafts: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    """Opinion drafts in JSON with the codes of what is wrong with them."""
    d = drafts.withColumn("d", F.from_json(column, "instrument string, stance string, confidence double, entry_low double, entry_high double, stop_loss double, take_profit double"))
    extra = F.array_except(F.json_object_keys(column), F.array(*[F.lit(a) for a in allowed]))
    prices = F.array("d.entry_low", "d.entry_high", "d.stop_loss", "d.take_profit")
    return d.withColumn("problems", reasons(
        NOT_AN_OBJECT=F.json_object_keys(column).isNull(), BAD_INSTRUMENT=~F.coalesce(F.col("d.instrument"), F.lit("X")).rlike("^[A-Z0-9_]{1,32}$"),
        BAD_CONFIDENCE=~F.col("d.confidence").between(0, 1), BAD_PRICE=F.exists(prices, lambda p: p <= 0), ENTRY_ORDER=F.col("d.entry_low") > F.col("d.entry_high"),
        UNKNOWN_KEY=F.size(extra) > 0)).drop("d")
