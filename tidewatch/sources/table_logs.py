"""Inventory of tables from their commit logs, read as plain JSON and parquet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: how deep tables are looked for below a folder, and how many are too many, if nothing else is said
MAX_DEPTH = 3
MAX_TABLES = 2000
LOG = "_delta_log"
COMMIT = r"/([0-9]+)\.json$"
#: A checkpoint in one file, or one of several: version, part and parts.
CHECKPOINT = r"/([0-9]+)\.checkpoint(?:\.([0-9]+)\.([0-9]+))?\.parquet$"

_ACTION = """
    add struct<path string, size bigint, stats string,
               deletionVector struct<storageType string, pathOrInlineDv string, offset int>>,
    remove struct<path string,
               deletionVector struct<storageType string, pathOrInlineDv string, offset int>>,
    metaData struct<schemaString string>
"""
_SCHEMA = "fields array<struct<name string, type string>>"


def _located(path: Column, root: str) -> dict[str, Column]:
    """Table (relative to root) and version that a log file's path names."""
    base = root.rstrip("/").split("://")[-1]
    folder = F.regexp_extract(path, rf"^(.*)/{LOG}/[^/]*$", 1)
    # the stored path has a scheme in front of the same folder
    start = F.instr(folder, base) + len(base)
    table = F.trim(F.substring(folder, start, F.length(folder)), F.lit("/"))
    return {"table_name": table, "version": F.regexp_extract(path, rf"/{LOG}/([0-9]+)[^/]*$", 1).cast("long")}


def _any(spark: SparkSession, pattern: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return found is not None and len(found) > 0


def _folders(spark: SparkSession, root: str, depth: int | None) -> list[str]:
    """One pattern for each level below root that has log files; with no depth, for all levels there are."""
    found, level, below = [], 0, root.rstrip("/")
    while depth is None or level <= depth:
        if not _any(spark, below):
            break
        if _any(spark, f"{below}/{LOG}/*"):
            found.append(f"{below}/{LOG}/*")
        level, below = level + 1, f"{below}/*"
    return found


def live_files(spark: SparkSession, root: str, depth: int | None = MAX_DEPTH) -> DataFrame:
    """(path, table_name, version, committed_at, saved): the log files that tell the tables' present state.

    Those are each table's newest whole checkpoint (``saved``), and its commits from that version on; all
    commits where there is no checkpoint. Only names and times are listed. A folder inside a table is not a
    table of its own.
    """
    patterns = _folders(spark, root, depth)
    if not patterns:
        return spark.createDataFrame(
            [], "path string, table_name string, version long, committed_at timestamp, saved boolean"
        )
    listed = spark.read.format("binaryFile").load(patterns).select("path", F.col("modificationTime").alias("committed_at"))
    path = F.col("path")
    saved = path.rlike(CHECKPOINT)
    files = listed.where(saved | path.rlike(COMMIT)).withColumns(
        {**_located(path, root), "saved": saved, "_parts": F.coalesce(F.regexp_extract(path, CHECKPOINT, 3).try_cast("int"), F.lit(1))}
    )
    files = outermost(files)
    whole = (
        files.where("saved")
        .groupBy("table_name", "version", "_parts")
        .agg(F.count(F.lit(1)).alias("_n"))
        .where("_n = _parts")
        .groupBy("table_name")
        .agg(F.max_by(F.struct("version", "_parts"), F.struct(F.col("version"), -F.col("_parts"))).alias("_from"))
    )
    start = F.coalesce(F.col("_from.version"), F.lit(-1))
    of_it = (F.col("version") == F.col("_from.version")) & (F.col("_parts") == F.col("_from._parts"))
    return (
        files.join(whole, "table_name", "left")
        .where(F.when(F.col("saved"), F.coalesce(of_it, F.lit(False))).otherwise(F.col("version") >= start))
        .select("path", "table_name", "version", "committed_at", "saved")
    )


def read_logs(spark: SparkSession, root: str, depth: int | None = MAX_DEPTH) -> DataFrame:
    """(table_name, version, committed_at, value): the lines of the :func:`live_files` below a folder.

    All tables are read by one job. What is read does not grow with a table's age; the driver holds the
    paths of these files, as the scan's own list of files does.
    """
    files = live_files(spark, root, depth).select("path", "saved").collect()
    lines = spark.createDataFrame([], "table_name string, version long, committed_at timestamp, value string")
    # file paths in metadata are encoded
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    at = F.col("_metadata.file_modification_time").alias("committed_at")
    place = [c.alias(name) for name, c in _located(path, root).items()]
    commits = [f.path for f in files if not f.saved]
    if commits:
        lines = lines.unionByName(spark.read.text(commits).select(*place, at, "value"))
    checkpoints = [f.path for f in files if f.saved]
    if checkpoints:
        saved = spark.read.schema(_ACTION).parquet(*checkpoints)
        value = F.to_json(F.struct("add", "remove", "metaData")).alias("value")
        lines = lines.unionByName(saved.select(*place, at, value))
    return lines


def outermost(lines: DataFrame) -> DataFrame:
    """Leaves out tables that lie inside another table's folder."""
    names = lines.select("table_name").distinct()
    parts = F.split("table_name", "/")
    parents = names.select(
        "table_name",
        F.explode(
            F.transform(
                F.sequence(F.lit(0), F.size(parts) - 1),
                lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"),
            )
        ).alias("_parent"),
    ).where(F.col("_parent") != F.col("table_name"))
    inner = parents.join(
        names.select(F.col("table_name").alias("_parent")), "_parent", "left_semi"
    ).select("table_name").distinct()
    return lines.join(inner, "table_name", "left_anti")


def _file_key(side: str) -> Column:
    vector = F.concat_ws(
        ":",
        f"_a.{side}.deletionVector.storageType",
        f"_a.{side}.deletionVector.pathOrInlineDv",
        F.col(f"_a.{side}.deletionVector.offset").cast("string"),
    )
    return F.concat_ws("#", f"_a.{side}.path", vector)


def inventory(lines: DataFrame) -> DataFrame:
    """(table_name, version, committed_at, rows, files, bytes, fields) from commit lines.

    The last action on a file decides whether it is active, so the big side is grouped by
    table and file, never by table alone before it has been reduced.
    """
    actions = lines.withColumn("_a", F.from_json("value", _ACTION))
    latest = actions.groupBy("table_name").agg(
        F.max("version").alias("version"),
        # a version's commit is written before its checkpoint
        F.max_by("committed_at", F.struct(F.col("version"), -F.unix_micros(F.col("committed_at").cast("timestamp")))).alias(
            "committed_at"
        ),
        F.max_by(
            "_a.metaData.schemaString",
            F.when(F.col("_a.metaData.schemaString").isNotNull(), F.col("version")),
        ).alias("_schema"),
    )
    added = F.col("_a.add").isNotNull()
    touched = actions.where(added | F.col("_a.remove").isNotNull()).select(
        "table_name",
        "version",
        F.when(added, _file_key("add")).otherwise(_file_key("remove")).alias("_file"),
        added.alias("_added"),
        F.col("_a.add.size").alias("_size"),
        F.get_json_object("_a.add.stats", "$.numRecords").try_cast("long").alias("_rows"),
    )
    active = (
        touched.groupBy("table_name", "_file")
        .agg(
            F.max_by(
                F.struct("_added", "_size", "_rows"), F.struct("version", "_added")
            ).alias("_last")
        )
        .where("_last._added")
    )
    totals = active.groupBy("table_name").agg(
        F.count(F.lit(1)).alias("files"),
        F.sum(F.greatest(F.coalesce("_last._size", F.lit(0)), F.lit(0))).alias("bytes"),
        F.when(
            F.count("_last._rows") == F.count(F.lit(1)), F.sum("_last._rows")
        ).alias("rows"),
    )
    fields = F.transform(
        F.from_json("_schema", _SCHEMA)["fields"],
        lambda f: F.concat(f["name"], F.lit(":"), f["type"]),
    )
    zero = F.lit(0).cast("long")
    return latest.join(totals, "table_name", "left").select(
        "table_name",
        "version",
        "committed_at",
        # an empty table has no rows, not an unknown number
        F.when(F.col("files").isNull(), zero).otherwise(F.col("rows")).alias("rows"),
        F.coalesce("files", zero).alias("files"),
        F.coalesce("bytes", zero).alias("bytes"),
        fields.alias("fields"),
    )


def problems(tables: DataFrame, root: str, most: int | None = MAX_TABLES) -> DataFrame:
    """(problem): no table at all, more than ``most`` (if any number is said), or the first one that cannot be read."""
    unreadable = F.min(F.when(F.col("fields").isNull(), F.col("table_name")))
    named = F.when(F.col("_bad") == "", "the table").otherwise(F.col("_bad"))
    text = (
        F.when(F.col("_n") == 0, F.lit(f"no delta tables under {root}"))
        .when(
            F.col("_n") > F.lit(most),
            F.lit(f"more than {most} delta tables under {root}"),
        )
        .when(
            F.col("_bad").isNotNull(),
            F.concat(F.lit("cannot read table "), named, F.lit(": no schema in its log")),
        )
    )
    return (
        tables.agg(F.count(F.lit(1)).alias("_n"), unreadable.alias("_bad"))
        .select(text.alias("problem"))
        .where(F.col("problem").isNotNull())
    )


def read_inventory(spark: SparkSession, root: str, depth: int | None = MAX_DEPTH) -> DataFrame:
    return inventory(read_logs(spark, root, depth))
