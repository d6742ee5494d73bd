from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from deskstream.operators import ingest
from deskstream.sources import files

ROWS = "id BIGINT, arrival BIGINT, external_id STRING, subject STRING, body STRING, product STRING, customer_tier STRING, customer_ref STRING"


def rows(spark, *values):
    return spark.createDataFrame([(k + 1, k + 1, *v) for k, v in enumerate(values)], ROWS)


def test_csv_upload(spark, tmp_path):
    upload = tmp_path / "upload.csv"
    upload.write_text(
        "Subject,BODY,product,customer_tier,ticket_uid,created_at\n"
        'Login fails,"multi\nline body",web-app,PRO,u1,2024-01-01 10:00:00\n'
        "Invoice wrong,see attachment,api,FREE,u2,2024-01-01T11:00:00Z\n"
        "Bad product,text,nope,FREE,u3,\n"
        "Login fails,again,web-app,PRO,u1,\n"
    )
    good, rejects = files.ingest_csv(spark, str(upload))
    judged = ingest.idempotent_insert(good.withColumn("id", F.col("record")).withColumn("arrival", F.col("record")))
    outcomes = {r["outcome"]: r["n"] for r in judged.groupBy("outcome").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert outcomes == {"CREATED": 2, "DUPLICATE": 1}
    report = ingest.reject_report(rejects).collect()
    assert [r["row"] for r in report] == [4] and "product" in report[0]["error"]
    times = {r["external_id"]: str(r["created_at"]) for r in good.where("record <= 2").collect()}
    assert times == {"u1": "2024-01-01 10:00:00", "u2": "2024-01-01 11:00:00"}


def test_csv_without_required_column(spark, tmp_path):
    upload = tmp_path / "upload.csv"
    upload.write_text("subject,body,product\na,b,api\n")
    with pytest.raises(ValueError, match="customer_tier"):
        files.ingest_csv(spark, str(upload))


def test_validation_reasons(spark):
    checked = ingest.validate_rows(
        rows(
            spark,
            ("a", "s", "b", "nope", "PRO", None),
            ("b", "s", "b", "api", "GOLD", None),
            ("c", "x" * 301, "b", "api", "PRO", None),
            ("d", "s", " \t\n", "api", "PRO", None),
            ("e", "s", "b", "api", "PRO", None),
            ("f", "\u2003\u2028", "b", "api", "PRO", None),
        )
    )
    got = [r["error"] for r in checked.orderBy("id").collect()]
    assert "product" in got[0] and "customerTier" in got[1] and "300" in got[2] and "body" in got[3] and got[4] is None and "subject" in got[5]


def test_csv_headers_of_their_own(spark, tmp_path):
    from deskstream.sources import files

    (tmp_path / "a.csv").write_text("Subject,body,product,customer_tier,ticket_uid\nhelp,text one,api,PRO,u1\n")
    (tmp_path / "b.csv").write_text('body,SUBJECT,customer_tier,product,external_id,ticket_uid\n"two\nlines",other,FREE,web-app,,u2\nx,,FREE,web-app,e3,u3\n')
    good, bad = files.ingest_csv(spark, str(tmp_path), None)
    got = sorted((r["subject"], r["body"], r["product"], r["external_id"]) for r in good.collect())
    assert got == [("help", "text one", "api", "u1"), ("other", "two\nlines", "web-app", "u2")]
    assert [(r["file"].rsplit("/", 1)[1], r["record"], r["error"]) for r in bad.collect()] == [("b.csv", 2, "subject is required")]


def test_customers_of_valid_rows(spark):
    frame = rows(spark, ("a", "s", "b", "api", "PRO", "c1"), ("b", "s", "b", "api", "GOLD", "c1"), ("c", "s", "b", "api", "FREE", " "), ("d", "s", "b", "nope", "FREE", "c2"))
    assert [tuple(r) for r in ingest.customer_upsert(frame).collect()] == [("c1", "PRO")]


def test_same_key_twice_is_one_ticket(spark):
    judged = ingest.ingest_rows(rows(spark, ("k", "s", "b", "api", "PRO", None), ("k", "s", "b", "api", "PRO", None), (None, "s", "b", "api", "PRO", None)))
    got = {r["id"]: (r["outcome"], r["ticket_id"]) for r in judged.collect()}
    assert got == {1: ("CREATED", 1), 2: ("DUPLICATE", 1), 3: ("CREATED", 3)}


def test_known_key_is_a_duplicate_of_the_stored_ticket(spark):
    stored = spark.createDataFrame([(77, "k")], "id BIGINT, external_id STRING")
    judged = ingest.ingest_rows(rows(spark, ("k", "s", "b", "api", "PRO", None)), stored)
    assert [(r["outcome"], r["ticket_id"]) for r in judged.collect()] == [("DUPLICATE", 77)]


def test_last_tier_wins(spark):
    out = ingest.customer_upsert(rows(spark, ("a", "s", "b", "api", "PRO", "C1"), ("b", "s", "b", "api", "FREE", "C1")))
    assert [(r["external_id"], r["tier"]) for r in out.collect()] == [("C1", "FREE")]


def test_csv_is_split_inside_quotes(spark, tmp_path):
    """Ranges of a few bytes cut quoted fields and records: the records and their numbers stay those of one pass."""
    import csv
    import random

    rng = random.Random(3)
    fields = ["plain", "with, comma", 'a "quoted" word', "two\nlines", 'mixed "x"\n\n", y\nend', "", "é\U0001f600 \n"]
    for name in ("a", "b"):
        with open(tmp_path / f"{name}.csv", "w", newline="") as out:
            writer = csv.writer(out, lineterminator="\n" if name == "a" else "\r\n")
            writer.writerow(["subject", "body", "product", "customer_tier", "external_id"])
            for k in range(300):
                writer.writerow([rng.choice(fields) or "s", rng.choice(fields) + f" b{k}", "api", "PRO", f"{name}{k}"])
                if k % 50 == 0:
                    out.write("\n" if name == "a" else "\r\n")
    want = {}
    for name in ("a", "b"):
        with open(tmp_path / f"{name}.csv", newline="") as rows:
            want[name] = [r for r in csv.reader(rows) if r][1:]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("97b", "1k", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            good, bad = files.ingest_csv(spark, str(tmp_path), None)
            got = sorted((r["file"].rsplit("/", 1)[1][0], r["record"], r["external_id"], r["subject"], r["body"]) for r in good.collect())
            assert bad.count() == 0
            tidy = lambda x: x.replace("\r\n", "\n").strip()
            assert [g[:3] for g in got] == [(n, k + 1, r[4]) for n in ("a", "b") for k, r in enumerate(want[n])]
            assert [tuple(map(tidy, g[3:])) for g in got] == [(tidy(r[0]), tidy(r[1])) for n in ("a", "b") for r in want[n]]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
