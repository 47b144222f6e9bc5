"""Files as tables: walks over folders, logs, notes, skills and indexes; and logs that are appended to."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Folders that a walk passes over (dot folders are passed over too).
SKIPPED = (
    "node_modules", "dist", "build", "__pycache__", "vendor", ".git", ".next", ".nuxt", ".output", "coverage", ".turbo", ".cache", "target", "venv",
    ".venv", "env",
)
DEEPEST = 100
ROTATE_BYTES = 10 * 1024 * 1024


def scratch(spark: SparkSession) -> str:
    """A new folder below the one that spark.checkpoint.dir names.  Where that is unset and everything runs in one
    process (tests), a local one; on a cluster that is an error, for executors share no local folder."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        top = tempfile.mkdtemp(prefix="weftgraph-files-")
    return f"{top}/weftgraph-files/{uuid.uuid4().hex}"


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text file wherever Spark's file systems reach."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    out.write(bytearray(text, "utf-8"))
    out.close()


def walk(spark: SparkSession, top: str, extensions: tuple[str, ...] = (), ignore: tuple[str, ...] = (), since_ms: int | None = None) -> DataFrame:
    """(path, mtime ms, size, text) of the files below a folder: none in dot folders, SKIPPED ones, those named in
    `ignore`, or deeper than DEEPEST; only the extensions, and what changed after since_ms, where these are given."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreMissingFiles", "true")
    base = top.rstrip("/").removeprefix("file://").removeprefix("file:")
    rel = F.regexp_replace(F.regexp_replace("path", "^[a-z0-9]+:/*", "/"), f"^/*\\Q{base.lstrip('/')}\\E/", "")
    found = read.load(top).select(rel.alias("path"), F.unix_millis("modificationTime").alias("mtime"), F.col("length").alias("size"), F.decode("content", "UTF-8").alias("text"))
    parts = F.slice(F.split("path", "/"), F.lit(1), F.size(F.split("path", "/")) - 1)
    ok = ~F.exists(parts, lambda x: x.startswith(".") | x.isin(*SKIPPED, *ignore)) & (F.size(parts) <= DEEPEST)
    if extensions:
        ok &= F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).isin(*extensions)
    if since_ms is not None:
        ok &= F.col("mtime") > since_ms
    return found.filter(ok)


def log_lines(spark: SparkSession, schema: str, *paths: str) -> DataFrame:
    """The JSON lines of log files with `project`, their folder's name; lines that are none are left out, and so are
    paths that do not exist."""
    found = [p for p in paths if _exists(spark, p)]
    if not found:
        return spark.createDataFrame([], f"{schema}, project string")
    got = spark.read.schema(schema + ", _torn string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_torn").json(list(found))
    return got.withColumn("project", F.element_at(F.split("_metadata.file_path", "/"), -2)).filter("_torn IS NULL").drop("_torn")


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at))


def whole(spark: SparkSession, *paths: str) -> DataFrame:
    """(file, text) of the text files among the paths that exist."""
    found = [p for p in paths if _exists(spark, p)]
    if not found:
        return spark.createDataFrame([], "file string, text string")
    read = spark.read.text(list(found), wholetext=True)
    return read.select(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("file"), F.col("value").alias("text"))


def skill_files(spark: SparkSession, top: str) -> DataFrame:
    """(path, text) of `<folder>/SKILL.md` below top."""
    at = f"{top.rstrip('/')}/*/SKILL.md"
    if not _exists(spark, at):
        return spark.createDataFrame([], "path string, text string")
    return spark.read.text(at, wholetext=True).select(F.regexp_replace("_metadata.file_path", "^[a-z]+:/*", "/").alias("path"), F.col("value").alias("text"))


def index_entries(files: DataFrame) -> DataFrame:
    """(id, file, label, kind) of the bullets of Markdown files(file, text); the last `##` heading before one says its
    kind.  Ids follow from file, line and label."""
    lines = files.select("file", F.posexplode(F.split(F.regexp_replace("text", "\r\n", "\n"), "\n")).alias("at", "line"))
    heading = F.lower(F.regexp_extract("line", r"^##\s+(.+)", 1))
    kind = (
        F.when(heading.contains("decision"), "decision").when(heading.rlike("issue|problem"), "mistake")
        .when(heading.rlike("architecture|design|convention|pattern"), "pattern").otherwise("concept")
    )
    w = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    own = lines.withColumn("kind", F.coalesce(F.last(F.when(heading != "", kind), ignorenulls=True).over(w), F.lit("concept")))
    label = F.trim(F.regexp_extract("line", r"^\s*[-*] (.*)", 1))
    return own.filter(F.col("line").rlike(r"^\s*[-*] ") & (label != "")).select(F.md5(F.concat_ws("|", "file", F.col("at").cast("string"), label)).alias("id"), "file", label.alias("label"), "kind")


def memory_entries(files: DataFrame) -> DataFrame:
    """(title, file, description, nth) of index lines `- [title](file) — description`; other lines are left out."""
    shape = r"^- \[(.*?)\]\((.*?)\) — (.*)$"
    lines = files.select(F.posexplode(F.split("text", "\n")).alias("nth", "line")).filter(F.col("line").rlike(shape))
    return lines.select(*(F.regexp_extract("line", shape, i).alias(n) for i, n in enumerate(("title", "file", "description"), 1)), "nth")


def append_log(rows: DataFrame, path: str, most_bytes: int = ROTATE_BYTES) -> None:
    """Append rows as JSON lines; a log that has reached most_bytes is moved to `<path>.1` first, whose old one goes."""
    spark = rows.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path
    fs = at(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(at(path)) and fs.getContentSummary(at(path)).getLength() >= most_bytes:
        fs.delete(at(path + ".1"), True)
        fs.rename(at(path), at(path + ".1"))
    rows.write.mode("append").json(path)
