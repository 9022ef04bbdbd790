"""Versioned Parquet tables, snapshots, export and import.

A table set is a folder of versions; a version is a folder of tables that is
complete once its ``_VERSION`` row is written. Nothing is overwritten: a new
state is a new version, and a restore publishes an old version again.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, functions as F

from threadlens.operators.usage import describe_counts
from threadlens.schemas import ATTACHMENTS, PARTICIPANTS, THREAD_MESSAGES, THREADS

# Fixed values -----------------------------------------------------------
EXPORT_FORMAT = 1
# ------------------------------------------------------------------------

MARK = "version string, taken timestamp, threads bigint, tagged bigint, users bigint, retired boolean, note string"
TABLES = {
    "threads": THREADS, "thread_messages": THREAD_MESSAGES, "participants": PARTICIPANTS,
    "attachments": ATTACHMENTS,
}


class SnapshotMismatch(RuntimeError):
    """The copy does not hold what the live tables hold."""


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _marks_path(root: str) -> str:
    return f"{root}/_marks"


def versions(spark: SparkSession, root: str) -> DataFrame:
    """Live versions, newest first: version, taken, counts."""
    fs, p = _fs(spark, _marks_path(root))
    if not fs.exists(p):
        return spark.createDataFrame([], MARK).drop("retired", "note")
    marks = spark.read.schema(MARK).parquet(_marks_path(root))
    last = marks.groupBy("version").agg(
        F.min("taken").alias("taken"), F.max("threads").alias("threads"),
        F.max("tagged").alias("tagged"), F.max("users").alias("users"),
        F.bool_or("retired").alias("retired"),
    )
    return last.filter(~F.col("retired")).drop("retired").orderBy(
        F.col("taken").desc(), F.col("version").desc()
    )


def _mark(spark: SparkSession, root: str, rows: DataFrame) -> None:
    rows.coalesce(1).write.mode("append").parquet(_marks_path(root))


def read(spark: SparkSession, root: str, version: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{version}/{table}")


def snapshot(
    spark: SparkSession, tables: dict[str, DataFrame], root: str, keep: int = 7,
    now: datetime | None = None, note: str = "",
) -> str:
    """Copy the tables to a new version, verify the copy, retire older ones.

    ``tables`` needs ``threads`` and ``users``. The copy is read back; if it
    does not hold as many threads as the live table, no version is published.
    """
    now = now or datetime.now(timezone.utc)
    version = now.strftime("v%Y%m%dT%H%M%S%fZ")
    live = describe_counts(tables["threads"], tables["users"]).first()
    for name, df in tables.items():
        df.write.parquet(f"{root}/{version}/{name}")
    copied = verify(spark, root, version)
    if copied["threads"] != live["threads"]:
        raise SnapshotMismatch(f"copy has {copied['threads']} threads, live {live['threads']}")
    row = (version, now.replace(tzinfo=None), copied["threads"], copied["tagged"], copied["users"],
           False, note)
    _mark(spark, root, spark.createDataFrame([row], MARK))
    _retire(spark, root, keep)
    return version


def _retire(spark: SparkSession, root: str, keep: int) -> None:
    """Mark versions beyond the newest ``keep`` as retired (files stay)."""
    if keep <= 0:
        return
    live = versions(spark, root)
    old = live.offset(keep).select(
        "version", "taken", "threads", "tagged", "users", F.lit(True).alias("retired"),
        F.lit("").alias("note"),
    )
    rows = old.collect()  # one row per surplus version, normally one
    if rows:
        _mark(spark, root, spark.createDataFrame(rows, MARK))


def verify(spark: SparkSession, root: str, version: str) -> dict[str, int]:
    """Open a version and count threads, tagged threads and users."""
    return describe_counts(
        read(spark, root, version, "threads"), read(spark, root, version, "users")
    ).first().asDict()


def listing(spark: SparkSession, root: str) -> DataFrame:
    """Versions newest first with the bytes they take."""
    live = versions(spark, root)
    paths = [f"{root}/{r['version']}" for r in live.select("version").collect()]
    if not paths:
        return live.withColumn("bytes", F.lit(0).cast("bigint"))
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
        .select(F.regexp_extract("path", r"/(v\d{8}T\d+Z)/", 1).alias("version"), "length")
    )
    sizes = files.groupBy("version").agg(F.sum("length").alias("bytes"))
    return live.join(sizes, "version", "left").orderBy(F.col("taken").desc())


def restore(
    spark: SparkSession, root: str, version: str, live: dict[str, DataFrame], keep: int = 7
) -> tuple[str, str]:
    """(aside, restored): keep the live state as a version, publish the old one anew."""
    verify(spark, root, version)
    aside = snapshot(spark, live, root, keep=0, note="replaced")
    old = {name: read(spark, root, version, name) for name in live}
    return aside, snapshot(spark, old, root, keep=keep, note=f"restored {version}")


# Export and import ---------------------------------------------------------------

def export_threads(tables: dict[str, DataFrame], path: str) -> None:
    """Gzipped JSON lines per table, with the format number on every row.

    Tenant ids stay out of the file: an import decides whose rows they become.
    """
    for name, df in tables.items():
        df.drop("user_id", "attachments_scanned").withColumn("format", F.lit(EXPORT_FORMAT)).write.json(
            f"{path}/{name}", compression="gzip"
        )


def read_export(
    spark: SparkSession, path: str, user_id: str, table: str = "threads"
) -> DataFrame:
    """Rows of an export for one tenant; malformed rows are skipped.

    Threads without any row of a known format are refused (:func:`check_export`). A row counts when it is an object of a known format with a thread id.
    Missing values get their defaults. ``row_no`` orders repeated rows by file
    and line.
    """
    ddl = ", ".join(
        c.strip() for c in TABLES[table].split(",\n") if c.strip()
    ).replace("\n", " ")
    if table == "threads":
        check_export(spark, path)
    raw = spark.read.schema(f"{ddl}, format int, _corrupt_record string").json(
        f"{path}/{table}", mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt_record"
    )
    good = raw.filter(
        F.col("_corrupt_record").isNull() & (F.col("format") == EXPORT_FORMAT)
        & (F.coalesce("thread_id", F.lit("")) != "")
    ).withColumn("row_no", F.struct(F.col("_metadata.file_path"), F.monotonically_increasing_id()))
    fills = {
        f.name: F.coalesce(f.name, _default(f.dataType.simpleString(), f.name))
        for f in good.schema.fields
        if f.name not in ("user_id", "thread_id", "format", "_corrupt_record", "row_no")
    }
    return good.withColumns(fills).withColumn("user_id", F.lit(user_id)).drop(
        "format", "_corrupt_record"
    )


def _default(kind: str, name: str):
    if name == "body_scan_status":
        return F.lit("ok")
    if kind == "string":
        return F.lit("")
    if kind == "boolean":
        return F.lit(False)
    if kind.startswith("array"):
        return F.array().cast(kind)
    return F.lit(0).cast(kind)


def check_export(spark: SparkSession, path: str) -> None:
    """Refuse an export without any row of a known format."""
    known = spark.read.schema("format int").json(f"{path}/threads").filter(
        F.col("format") == EXPORT_FORMAT
    )
    if known.isEmpty():
        raise ValueError("unrecognised export format")
