from __future__ import annotations

from pyspark.sql import functions as F

from deskstream.functions import scoring, text
from deskstream.operators import projection


def one(spark, column, **values):
    names = list(values)
    frame = spark.createDataFrame([tuple(values.values())], names) if names else spark.range(1)
    return frame.select(column.alias("x")).first()["x"]


def test_redaction_of_mail_phone_and_card(spark):
    out = one(spark, text.pii_redact(F.col("t")), t="mail jo.doe@example.com or +49 151 2345 6789, card 4111 1111 1111 1111")
    assert "@" not in out["text"] and "4111" not in out["text"] and out["n"] >= 3


def test_signals(spark):
    out = one(
        spark,
        text.signal_list(F.col("t")),
        t="Everyone is locked out since your update, error 403, must work before the 5pm demo!",
    )
    assert any(s.startswith("deadline:") for s in out) and "outage" in out and "error_code" in out


def test_signals_respect_unicode_words(spark):
    # an accented letter before the word means there is no word boundary
    out = one(spark, text.urgency_signals(F.col("t")), t="éstuck")
    assert out["blocked"] is False


def test_grounding_levels(spark):
    rows = [([], "NONE"), ([0.8], "STRONG"), ([0.6], "WEAK"), ([0.3], "NONE")]
    frame = spark.createDataFrame([(k, [(float(s),) for s in scores]) for k, (scores, _) in enumerate(rows)], "k INT, s ARRAY<STRUCT<score: DOUBLE>>")
    got = {r["k"]: r["g"] for r in frame.select("k", scoring.grounding_level(F.col("s")).alias("g")).collect()}
    assert got == {k: want for k, (_, want) in enumerate(rows)}


def validate(spark, reply, cited, valid, confidence=0.9, grounding="STRONG"):
    frame = spark.createDataFrame(
        [(reply, [(c, "why") for c in cited], valid, confidence, grounding)],
        "reply STRING, c ARRAY<STRUCT<ticketId: BIGINT, why: STRING>>, v ARRAY<BIGINT>, conf DOUBLE, g STRING",
    )
    out = text.citations_validate(F.col("reply"), F.col("c"), F.col("v"), F.col("conf"), F.col("g"))
    return frame.select(out.alias("o")).first()["o"]


def test_invented_citations_are_removed(spark):
    out = validate(spark, "Please reset the token as described. [T-881] [T-999]", [881, 999], [881])
    assert "[T-999]" not in out["reply"] and "[T-881]" in out["reply"]
    assert out["stripped"] == 2 and out["confidence"] <= 0.5 and out["grounding"] == "WEAK"


def test_grouped_citation_is_split(spark):
    out = validate(spark, "Please reset the token as described [T-881, T-999].", [881], [881])
    assert "[T-881]" in out["reply"] and "T-999" not in out["reply"] and out["grounding"] == "WEAK"


def test_missing_tag_is_appended(spark):
    out = validate(spark, "Please reset the token as described.", [881], [881])
    assert out["reply"].endswith(" [T-881]") and out["grounding"] == "STRONG" and out["stripped"] == 0


def test_short_reply_is_rejected(spark):
    assert validate(spark, "ok", [], [])["rejected"] is True


def test_edit_distance(spark):
    rows = [("kitten", "sitting"), ("", "abc"), ("abc", "xyz"), (None, None)]
    frame = spark.createDataFrame(rows, "a STRING, b STRING")
    got = frame.select(
        text.edit_distance(F.col("a"), F.col("b")).alias("d"), text.edit_ratio(F.col("a"), F.col("b")).alias("r")
    ).collect()
    assert [r["d"] for r in got] == [3, 3, 3, 0]
    assert got[2]["r"] == 1.0 and got[3]["r"] == 0.0


def test_citation_split(spark):
    out = one(spark, text.citations_split(F.col("t")), t="Try this [T-12] and [T-3].\nBye")
    assert [(p["kind"], p["value"]) for p in out] == [
        ("text", "Try this "), ("cite", "12"), ("text", " and "), ("cite", "3"), ("text", ".\nBye"),
    ]


def test_word_diff(spark):
    out = one(spark, projection.word_diff(F.col("a"), F.col("b")), a="please reset the token", b="please renew your token ")
    assert (out["added"], out["removed"], out["changed"]) == (2, 2, True)


def test_template_without_sources_asks(spark):
    frame = spark.createDataFrame([([],)], "s ARRAY<STRUCT<id: BIGINT, subject: STRING, problem: STRING, resolution: STRING>>")
    out = frame.select(text.template_draft(F.col("s")).alias("d")).first()["d"]
    assert out["confidence"] == 0.2 and len(out["needs_info"]) == 2 and out["citations"] == []


def test_sla_state(spark):
    frame = spark.sql(
        """SELECT * FROM VALUES
        (1, timestamp'2024-01-01 02:10:00', 'NEW', false), (2, timestamp'2023-12-31 23:25:00', 'NEW', false),
        (3, timestamp'2024-01-01 00:10:00', 'NEW', false), (4, timestamp'2024-01-03 05:00:00', 'NEW', false),
        (5, timestamp'2024-01-03 05:00:00', 'RESOLVED', true), (6, cast(null AS timestamp), 'NEW', false) AS t(id, due, status, breached)"""
    )
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    got = {r["id"]: (r["s"]["label"], r["s"]["tone"]) for r in frame.select("id", scoring.sla_state(F.col("due"), F.col("status"), F.col("breached"), now).alias("s")).collect()}
    assert got == {
        1: ("in 2h 10m", "good"), 2: ("overdue 35m", "bad"), 3: ("in 10m", "warn"),
        4: ("in 2d 5h", "good"), 5: ("done", "muted"), 6: ("—", "muted"),
    }


def test_vector_text_round_trip(spark):
    frame = spark.createDataFrame([([0.5, -0.25, 1.0],)], "v ARRAY<FLOAT>")
    assert frame.select(scoring.vector_parse(scoring.vector_format(F.col("v"))).alias("b")).first()["b"] == [0.5, -0.25, 1.0]


def test_top_factors_merge_embedding_parts(spark):
    rows = [([("emb_pc0", 0.4), ("tier", -0.5), ("emb_pc1", 0.3), ("hour", 0.1)],)]
    frame = spark.createDataFrame(rows, "c ARRAY<STRUCT<feature: STRING, value: DOUBLE>>")
    out = frame.select(scoring.top_factors(F.col("c"), 2).alias("t")).first()["t"]
    assert [f["feature"] for f in out] == ["text_embedding", "tier"] and abs(out[0]["contribution"] - 0.7) < 1e-12


def test_top_factors_round_only_the_merged_value(spark):
    rows = [([("emb_pc0", 0.1000000004), ("tier", 0.2000000006), ("emb_pc1", 0.1000000004)],), ([("tier", 0.3), ("hour", -0.1 * 3)],)]
    frame = spark.createDataFrame(rows, "c ARRAY<STRUCT<feature: STRING, value: DOUBLE>>")
    first, second = [r["t"] for r in frame.select(scoring.top_factors(F.col("c"), 2, digits=9).alias("t")).collect()]
    assert [f["feature"] for f in first] == ["text_embedding", "tier"]  # equal to nine places, so by name
    assert abs(first[0]["contribution"] - 0.2000000008) < 1e-13
    assert [f["feature"] for f in second] == ["hour", "tier"]
