"""Readers for ticket data at rest and in motion: Parquet, CSV, JSON."""

from __future__ import annotations

import csv
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from deskstream.functions import text
from deskstream.operators.ingest import created_at_error, parse_created_at, validation_error
from deskstream.schemas import TABLE_SCHEMAS, UPLOAD_CSV_SCHEMA_FIELDS
from deskstream.session import ship_package, written

REQUIRED_COLUMNS = ["subject", "body", "product", "customer_tier"]
BATCH_SCHEMA = "externalId STRING, subject STRING, body STRING, product STRING, customerTier STRING, customerId STRING, createdAt STRING"


def read_table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """A driver table with its declared schema."""
    return spark.read.schema(TABLE_SCHEMAS[name]).parquet(f"{directory}/{name}.parquet")


def spread(frame: DataFrame, key: str) -> DataFrame:
    """Hash the rows over the cores when the files give fewer splits than there are cores.

    Text work dominates such scans; a large table already has more splits and is left alone.
    """
    cores = frame.sparkSession.sparkContext.defaultParallelism
    return frame.repartition(cores, key) if frame.rdd.getNumPartitions() < cores else frame


def stream_table(spark: SparkSession, directory: str, name: str, files_per_trigger: int = 1) -> DataFrame:
    """The same table as a file stream."""
    return (
        spark.readStream.schema(TABLE_SCHEMAS[name])
        .option("pathGlobFilter", f"{name}.parquet")
        .option("maxFilesPerTrigger", files_per_trigger)
        .parquet(directory)
    )


def read_tickets(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A ticket dataset (any table of :mod:`deskstream.schemas`) from Parquet."""
    return spark.read.schema(schema).parquet(path)


LINE_SCHEMA = "file STRING, start BIGINT, line BIGINT, inside BOOLEAN, quotes BIGINT, even BIGINT, odd BIGINT, value STRING"


def _counted_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of a task in order, counted from the start of their byte range.

    ``inside`` says whether an odd number of quotes stands before the line in its range; ``even`` and ``odd`` are the
    lines so far, blank ones left out, that begin outside and inside of them.
    """
    now, line, quotes, even, odd = None, 0, 0, 0, 0
    for batch in batches:
        rows = []
        for value, file, start in zip(*(x.to_pylist() for x in batch.columns)):
            if now != (file, start):
                now, line, quotes, even, odd = (file, start), 0, 0, 0, 0
            own, inside, full = value.count('"'), quotes % 2 == 1, value.rstrip("\r") != ""
            even, odd = even + (full and not inside), odd + (full and inside)
            rows.append((file, start, line, inside, own, even, odd, value))
            line, quotes = line + 1, quotes + own
        if rows:
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            names = [f.split()[0] for f in LINE_SCHEMA.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names=names)


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, record, value): the records of quoted CSV files, counted from 1 in each file; blank lines are none.

    Files are read in byte ranges. A line begins a record if an even number of quotes stands before it, and that
    number is the sum over the ranges before: one row a range is summed by file. Then every line knows its record
    by itself; only records of several lines meet in a shuffle.
    """
    ship_package(spark)
    text_lines = spark.read.option("lineSep", "\n").text(path)
    source = text_lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    lines = source.mapInArrow(_counted_lines, LINE_SCHEMA)
    ranges = lines.groupBy("file", "start").agg(
        F.count(F.lit(1)).alias("lines"), F.sum("quotes").alias("quotes"), F.max("even").alias("even"), F.max("odd").alias("odd")
    )
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    summed = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    opened = ranges.select("*", (summed("quotes") % 2).alias("flip"), summed("lines").alias("_line"))
    offsets = opened.withColumn("begun", F.when(F.col("flip") == 0, F.col("even")).otherwise(F.col("odd")))
    offsets = written(offsets.select("file", "start", "flip", "_line", summed("begun").alias("_record")), "ranges")
    placed = lines.join(offsets, ["file", "start"])
    begins = F.col("inside") == (F.col("flip") == 1)
    record = F.col("_record") + F.when(F.col("flip") == 0, F.col("even")).otherwise(F.col("odd"))
    placed = placed.select("file", record.alias("record"), (F.col("_line") + F.col("line")).alias("line"), begins.alias("begins"), (F.col("quotes") % 2 == 1).alias("open"), "value")
    single = placed.where("begins AND NOT open AND rtrim('\r', value) <> ''").select("file", "record", "value")
    parts = placed.where("open OR NOT begins").groupBy("file", "record").agg(F.sort_array(F.collect_list(F.struct("line", "value"))).alias("l"))
    whole = parts.select("file", "record", F.array_join(F.col("l.value"), "\n").alias("value"))
    return single.unionByName(whole).withColumn("value", F.rtrim(F.col("value"), F.lit("\r")))


def _upload_fields(record: Column, header: list[str]) -> dict[str, Column]:
    """The upload fields of a record under its file's header."""
    names = {name.strip().lower(): k for k, name in enumerate(header)}
    missing = [name for name in REQUIRED_COLUMNS if name not in names]
    if missing:
        raise ValueError(f"missing required columns: {', '.join(missing)}")
    options = {"quote": '"', "escape": '"', "mode": "PERMISSIVE"}
    parsed = F.from_csv(record, ", ".join(f"c{k} STRING" for k in range(len(header))), options)

    def value(name: str) -> Column:
        if name not in names:
            return F.lit(None).cast("string")
        trimmed = text.strip_controls(parsed[f"c{names[name]}"])
        return F.when(F.length(trimmed) > 0, trimmed)

    fields = {name: value(name) for name in UPLOAD_CSV_SCHEMA_FIELDS}
    fields["external_id"] = F.coalesce(fields["external_id"], value("ticket_uid"))
    return fields


def ingest_csv(spark: SparkSession, path: str, ingest_at=None) -> tuple[DataFrame, DataFrame]:
    """(good, rejects) of CSV uploads: one file or a folder of them.

    Every file has a header of its own: names are case-insensitive and may come in any order.
    Values are trimmed and blank ones become NULL; a row without external_id takes its
    ticket_uid. A missing required column fails the upload; a bad row is rejected with a
    reason, never an error. ``record`` is the position of the row in its upload, without the header.
    A large upload is read by many tasks (``csv_records``); only the distinct headers come to the driver.
    """
    records = csv_records(spark, path)
    heads = written(records.where("record = 1").select("file", F.col("value").alias("head")), "headers")
    headers = [r["head"] for r in heads.select("head").distinct().orderBy("head").collect()]
    parsed = [_upload_fields(F.col("value"), next(csv.reader([h.removeprefix("\ufeff")]))) for h in headers]
    mine = lambda name: [F.when(F.col("head") == h, fields[name]) for h, fields in zip(headers, parsed)]
    columns = [F.coalesce(*mine(name), F.lit(None).cast("string")).alias(name) for name in UPLOAD_CSV_SCHEMA_FIELDS]
    rows = records.where("record > 1").join(heads, "file").select("file", (F.col("record") - 1).alias("record"), *columns)
    error = F.coalesce(
        validation_error(
            F.col("subject"), F.col("body"), F.col("product"), F.col("customer_tier"), F.col("customer_id")
        ),
        created_at_error(F.col("created_at")),
    )
    now = ingest_at if ingest_at is not None else F.current_timestamp()
    judged = rows.withColumn("error", error)
    good = judged.where(F.col("error").isNull()).drop("error").withColumn(
        "created_at", parse_created_at(F.col("created_at"), now)
    )
    return good, judged.where(F.col("error").isNotNull()).select("file", "record", "error")


def batch_ingest(spark: SparkSession, path: str) -> DataFrame:
    """JSON rows of a batch upload in the shape the validators expect."""
    raw = spark.read.schema(BATCH_SCHEMA).json(path)
    return raw.select(
        F.col("externalId").alias("external_id"),
        "subject",
        "body",
        "product",
        F.col("customerTier").alias("customer_tier"),
        F.col("customerId").alias("customer_ref"),
        F.col("createdAt").alias("created_raw"),
    )
