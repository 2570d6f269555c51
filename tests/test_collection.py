"""Collection records of large tables."""

import duckdb
from pyspark.sql import functions as F

from asofkit import plans
from asofkit.functions import text as tx
from asofkit.operators import intake


def test_posts_after_the_first_run(spark, tmp_path):
    """Posts that appear after the first run, and after the date of those dated ahead, have the outcomes of the SQL."""
    ids = [0, 10, 19, 218_870, 218_885, 218_886, 218_899, 218_900, 218_937, 482_390, 482_410, 482_600, 500_004, 500_005, 3_000_000, 3_000_005, 3_000_006, 3_000_010]
    rows = [(i, f"text {i}", None if i % 3 == 0 else "en", f"s{i % 3}", 9) for i in ids]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    got = plans.queries()["collection_outcomes"](spark, str(tmp_path))
    duck = duckdb.connect()
    duck.execute("SET timezone = 'UTC'")
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = duck.execute(f"SELECT {', '.join(got.columns)} FROM ({plans.oracle_sql()['collection_outcomes']})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want) and {x[2] for x in want} == {"ACCEPTED", "DUPLICATE", "REJECTED"}


def test_texts_pass_through_one_worker(spark, tmp_path):
    """Normal forms and digests are made in one step with bounded batches, and texts that nobody asks for are not exchanged."""
    spark.createDataFrame([(0, "a", "en", "s", 1)], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    plan = plans.queries()["collection_outcomes"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 8 << 20
    window = plan[plan.index("Window"):]
    assert "text#" not in window[: window.index("Exchange")]


def test_identity_is_the_digest_of_canonical_parts(spark):
    rows = [(0, "S", " A ", "Ｔitle", "x​ y\tStraße"), (1, None, "b", None, "é" + "z" * 40), (2, "", "c", "t" * 600, " "), (3, "s", " ", "t", "x"), (4, "s", "d", " ", None)]
    d = spark.createDataFrame(rows, "i long, source string, source_record_id string, title string, text string").withColumns(
        {c: F.lit("2024-01-01").cast("timestamp") for c in ("published_at", "collected_at", "effective_floor")})
    r = intake.collection_records(d, spark.createDataFrame([], "identity string"), [F.col("i")], F.lit("2024-02-01").cast("timestamp"), max_text=20)
    body = tx.content_hash(F.substring(tx.normalize_text("title"), 1, 500), F.substring(tx.normalize_text("text"), 1, 20), namespace="collection.processor.content")
    want = d.select("i", tx.content_hash(F.col("source"), F.trim("source_record_id"), body, namespace="collection.processor.identity").alias("k"),
                    F.substring(tx.normalize_text("text"), 1, 20).alias("text")).collect()
    got = {x.i: (x.identity, x.text) for x in r.collect()}
    assert got == {x.i: (x.k if x.i < 3 else None, x.text) for x in want}
