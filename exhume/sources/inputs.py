"""Inputs: ground truth, batch CSV, JSON payloads, registry CSV, file trees and images."""

from __future__ import annotations

import mimetypes

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from exhume.functions.text import parse_bool
from exhume.operators.validate import REQUIRED
from exhume.session import stage
from exhume.sources.chunks import file_hashes

# Case prefixes that name the task of ground truth loaded without one.
CASE_PREFIXES = {
    "ft-ss-": "string_search",
    "dfr-": "deleted_file_recovery",
    "carv-": "file_carving",
    "wr-": "windows_registry",
    "sft-": "sqlite",
}

FILE_FIELDS = (
    "file_name string, file_size string, deleted_timestamp string, modified_timestamp string, "
    "changed_timestamp string, accessed_timestamp string, created_timestamp string, inode string, blocks string"
)

# JSON cell of a batch row by task: (column, type it is read as)
JSON_CELLS = {
    "string_search": ("file_contents_found", "array<string>"),
    "deleted_file_recovery": ("files_json", f"array<struct<{FILE_FIELDS.replace(' string', ':string')}>>"),
    "file_carving": ("files_json", "array<string>"),
    "sqlite_recovery": ("extracted_data_json", "map<string,string>"),
}
BATCH_COLUMNS = {
    "string_search": ("base_test_case", "tool_used", "os", "write_db"),
    "deleted_file_recovery": ("base_test_case", "tool_used", "file_system", "test_set", "sector_size", "check_meta", "write_db"),
    "file_carving": ("base_test_case", "tool_used", "write_db"),
    "windows_registry": ("base_test_case", "tool_used", "submitted_csv_path", "job_id", "write_db"),
    "sqlite_recovery": ("base_test_case", "tool_used", "task_id", "file_name", "sqlite_table_name"),
}
SKIPPED_FILES = ("audit.txt", "report.xml", "report.html")


def with_task(gt: DataFrame) -> DataFrame:
    """Fill a missing task from the case prefix."""
    named = F.lit(None).cast("string")
    for prefix, task in CASE_PREFIXES.items():
        named = F.when(F.lower("base_test_case").startswith(prefix), F.lit(task)).otherwise(named)
    return gt.withColumn("cftt_task", F.coalesce("cftt_task", named))


def write_ground_truth(gt: DataFrame, path: str) -> None:
    """One folder per task, so that a task's jobs read only their own."""
    with_task(gt).write.mode("overwrite").partitionBy("cftt_task").parquet(path)


def read_ground_truth(spark: SparkSession, path: str, task: str, columns: list[str] | None = None) -> DataFrame:
    """A1: ground truth of one task; the filter prunes folders, the selection prunes columns."""
    gt = spark.read.parquet(path).filter(F.col("cftt_task") == task)
    return gt.select(*columns) if columns else gt


def read_submission_batch(spark: SparkSession, path: str | list[str], task: str) -> DataFrame:
    """A2: one row per run of a batch CSV, with ``run_pos``, the parsed JSON cell as ``payload`` and ``reason``.

    A broken row gets a reason (missing field, invalid JSON) instead of stopping the batch.
    """
    cell = JSON_CELLS.get(task)
    named = list(BATCH_COLUMNS[task]) + ([cell[0]] if cell else [])
    raw = by_own_header(spark, path, named)
    rows = raw.select(F.col("pos").alias("run_pos"), *[F.trim(F.col(c)).alias(c) for c in named])
    missing = [F.when(F.coalesce(F.col(c), F.lit("")) == "", F.lit(f"missing {c}")) for c in REQUIRED[task]]
    if cell is None:
        return rows.withColumn("reason", F.coalesce(*missing))
    column, kind = cell
    absent = F.coalesce(F.col(column), F.lit("")) == ""
    if task in ("string_search", "deleted_file_recovery"):
        rows = rows.withColumn(column, F.when(absent, "[]").otherwise(F.col(column)))
        empty: Column = F.lit(None).cast("string")
    else:
        empty = F.when(absent, F.lit(f"missing {column}"))
    rows = rows.withColumn("payload", F.from_json(column, kind))
    broken = F.when(F.col("payload").isNull(), F.lit(f"invalid JSON in {column}"))
    if task == "file_carving":  # a run must name at least one carved file
        empty = F.coalesce(empty, F.when(F.size("payload") == 0, F.lit(f"empty {column}")))
    if "check_meta" in BATCH_COLUMNS[task]:
        rows = rows.withColumn("check_meta", parse_bool(F.col("check_meta")).cast("string"))
    return rows.withColumn("reason", F.coalesce(*missing, empty, broken))


def payload_schema() -> str:
    files = f"array<struct<{FILE_FIELDS.replace(' string', ':string')}>>"
    return (
        "base_test_case string, tool_used string, os string, test_set string, test_set_used string, file_system string, "
        f"check_meta string, file_contents_found array<string>, files {files}"
    )


def read_submission_json(spark: SparkSession, path: str, repair_test_set: bool = False) -> DataFrame:
    """A3: one payload per file; keys may vary. ``repair_test_set`` reads ``test_set_used`` where ``test_set`` is absent."""
    payloads = spark.read.schema(payload_schema()).json(path, multiLine=True).withColumn("path", F.col("_metadata.file_path"))
    if repair_test_set:
        payloads = payloads.withColumn("test_set", F.coalesce("test_set", "test_set_used"))
    return payloads


def by_own_header(spark: SparkSession, path: str | list[str], wanted: list[str]) -> DataFrame:
    """(file, pos, record, missing, wanted columns) of all CSV files below ``path``, each read by its own first record.

    Column order may differ from file to file; names are trimmed. A file lacking a wanted column has it null and
    in ``missing``. Headers are one record per file, so they meet their rows by a join of files.
    """
    # files may have different numbers of columns: the widest first line of all files counts
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("pos")]
    starts = spark.read.text(path).select("value", *place).filter("at = 0")
    heads = starts.groupBy("file").agg(F.min_by("value", "pos").alias("head"))
    most = heads.agg(F.max(F.size(F.split("head", ",")))).first()[0] or 1
    names = [f"_c{i}" for i in range(most)]
    schema = ", ".join(f"{n} string" for n in names)
    raw = spark.read.schema(schema).csv(path, header=False, multiLine=True, escape='"', nullValue="\u0001", emptyValue="", mode="PERMISSIVE")
    # read twice below, and places must be the same both times
    rows = stage(raw.select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("pos"), F.array(*names).alias("record")))
    heads = rows.groupBy("file").agg(F.min_by("record", "pos").alias("_h"), F.min("pos").alias("_first"))
    heads = heads.select("file", F.transform("_h", lambda c: F.trim(c)).alias("_h"), "_first")
    body = rows.join(heads, "file").filter(F.col("pos") > F.col("_first"))
    place = lambda c: F.array_position("_h", F.lit(c))
    missing = F.filter(F.array(*[F.when(place(c) == 0, F.lit(c)) for c in wanted]), lambda x: x.isNotNull())
    return body.select(
        "file", "pos", "record", missing.alias("missing"), *[F.when(place(c) > 0, F.get("record", (place(c) - 1).cast("int"))).alias(c) for c in wanted]
    )


def read_registry_csv(spark: SparkSession, path: str) -> DataFrame:
    """A4: (file, path, value, reason) of registry listings; every column is text and empty cells stay empty.

    Rows of a file without one of the two columns have a ``reason`` and no value for it.
    """
    rows = by_own_header(spark, path, ["PATH", "VALUE"])
    reason = F.when(F.size("missing") > 0, F.concat(F.lit("missing column "), F.array_join("missing", ", ")))
    return rows.select("file", F.coalesce("PATH", F.lit("")).alias("path"), F.coalesce("VALUE", F.lit("")).alias("value"), reason.alias("reason"))


def file_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """A5: name, path, size, mime and sha256 of the non-empty files below a folder, tool reports left out.

    Spark lists the files without reading them; hashes are taken a piece at a time, so files may have any size.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length")
    name = F.element_at(F.split("path", "/"), -1)
    types = F.create_map(*[F.lit(x) for kv in sorted(mimetypes.types_map.items()) for x in kv])
    suffix = F.lower(F.regexp_extract("name", r"(\.[^.]+)$", 1))
    kept = files.filter(F.col("length") > 0).withColumn("name", name).filter(
        ~F.lower("name").isin(*SKIPPED_FILES) & ~F.lower("name").endswith(".json")
    )
    # paths as URIs with an authority, empty for local files
    place = F.regexp_replace("path", "^file:/+", "file:///")
    listed = kept.select("name", "path", F.col("length").alias("size_bytes"), place.alias("_place"), F.coalesce(F.try_element_at(types, suffix), F.lit("application/octet-stream")).alias("mime"))
    return file_hashes(listed, "_place").select("name", "path", "size_bytes", "mime", "sha256")


def read_images(spark: SparkSession, folder: str) -> DataFrame:
    """Image rows, ``decodes`` and ``error``; a file the image library cannot read has height -1 and the reason as text."""
    images = spark.read.format("image").option("recursiveFileLookup", "true").load(folder)
    decodes = F.col("image.height") >= 0
    said = F.concat(F.lit("cannot identify image file '"), F.col("image.origin"), F.lit("'"))
    return images.withColumns({"decodes": decodes, "error": F.when(~decodes, said)})
