"""Files related by their paths alone: same folder, and a test beside what it tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import basename, dirname

# What marks a test, a source file and its extension.
TEST_SUFFIX = r"(?i)\.(test|spec)\.[cm]?[jt]sx?$"
TEST_FOLDER = r"(?i)(^|/)(tests?|__tests__|spec)(/|$)"
BENCH_FOLDER = r"(?i)(^|/)bench(/|$)"
OTHER_FOLDER = r"(?i)(^|/)(docs|examples|scripts)/"
EXTENSION = r"\.[cm]?[jt]sx?$"


def is_test(path: Column) -> Column:
    return path.rlike(TEST_SUFFIX) | path.rlike(TEST_FOLDER)


def is_source(path: Column) -> Column:
    """Code that is neither a test, a benchmark, an example, a script nor documentation."""
    return path.rlike(EXTENSION) & ~is_test(path) & ~path.rlike(BENCH_FOLDER) & ~path.rlike(OTHER_FOLDER)


def base_key(path: Column) -> Column:
    """The file's name without its test marker and its extension."""
    return F.regexp_replace(F.regexp_replace(basename(path), r"(?i)\.(test|spec)\.", "."), "(?i)" + EXTENSION, "")


def _keyed(files: DataFrame, name: str) -> DataFrame:
    p = F.col("path")
    return files.select(p.alias(name), dirname(p).alias(f"{name}_dir"), base_key(p).alias("key"), p.rlike(TEST_SUFFIX).alias(f"{name}_test"))


def siblings(files: DataFrame, focal: DataFrame | None = None) -> DataFrame:
    """focal, file: other files of the folder of each of focal(path); of all files if none is given, whose rows are then
    the pairs of a folder."""
    a = (files if focal is None else focal).select(F.col("path").alias("focal"), dirname(F.col("path")).alias("dir"))
    b = files.select(F.col("path").alias("file"), dirname(F.col("path")).alias("dir"))
    return b.join(a if focal is None else F.broadcast(a), "dir").filter("focal <> file").select("focal", "file")  # focal: a caller's few files


def counterparts(files: DataFrame, focal: DataFrame | None = None) -> DataFrame:
    """focal, file: the tests of a file, or the files of a test; in one folder, or the test in a folder of tests."""
    pairs = _keyed(files if focal is None else focal, "focal").join(_keyed(files, "file"), "key").filter("focal_test <> file_test")
    test = F.when(F.col("focal_test"), F.col("focal")).otherwise(F.col("file"))
    return pairs.filter((F.col("focal_dir") == F.col("file_dir")) | test.rlike(TEST_FOLDER)).select("focal", "file")


def reach(files: DataFrame, focal: DataFrame | None = None) -> DataFrame:
    return siblings(files, focal).union(counterparts(files, focal)).distinct()
