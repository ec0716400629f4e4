"""Reading record files strictly."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veristrata.functions.records import is_strict_object


def contained(root: str, relative: str) -> str:
    """The path below ``root``; absolute paths, ``..`` and links that lead out are refused."""
    if os.path.isabs(relative) or ".." in relative.replace("\\", "/").split("/"):
        raise ValueError("the path must stay below its root")
    base = os.path.realpath(root)
    path = os.path.realpath(os.path.join(base, relative))
    if os.path.commonpath([base, path]) != base:
        raise ValueError("the path must stay below its root")
    return path


def jsonl_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, raw): the lines of JSONL files, numbered from 1 within their file; the end of the last line is none.

    Files are read in splits. Lines are numbered within their split, and the numbers of lines in the
    splits before it, one row each, are added; so a file of any size is read by many tasks.
    """
    rows = spark.read.text(path, lineSep="\n").select(F.col("_metadata.file_path").alias("__path"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("__at"), F.monotonically_increasing_id().alias("__row"), F.regexp_replace("value", r"\r\z", "").alias("raw"))
    within = Window.partitionBy("__path", "__at").orderBy("__row")
    before = Window.partitionBy("__path").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    splits = rows.groupBy("__path", "__at").agg(F.count("*").alias("__n")).select("__path", "__at", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__ahead"))
    numbered = rows.withColumn("__line", F.row_number().over(within)).join(splits, ["__path", "__at"])
    return numbered.select("file", (F.col("__ahead") + F.col("__line")).alias("line"), "raw")


def checked_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid records (file, line, raw) and problems (code, file, line): blank lines, invalid UTF-8, invalid JSON and values that are no object."""
    code = (
        F.when(~F.coalesce(F.is_valid_utf8("raw"), F.lit(False)), "INVALID_UTF8")
        .when(F.length(F.trim("raw")) == 0, "INVALID_JSONL")
        .when(~is_strict_object(F.col("raw")), "INVALID_JSON")
    )
    tagged = lines.withColumn("code", code)
    return tagged.where("code IS NULL").drop("code"), tagged.where("code IS NOT NULL").select("code", "file", "line")


def read_records(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Records of the schema (with file and line) and the problems of the lines that are none."""
    good, bad = checked_lines(jsonl_lines(spark, path))
    return good.select("file", "line", F.from_json("raw", schema).alias("r")).select("file", "line", "r.*"), bad


def read_object(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Files that hold one JSON object; an invalid one gives a null record."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.col("_metadata.file_name").alias("file"), F.when(is_strict_object(F.col("value")), F.from_json("value", schema)).alias("record"))


def read_blobs(spark: SparkSession, path: str) -> DataFrame:
    """(path, content, sha256) of files as they are."""
    return spark.read.format("binaryFile").load(path).select("path", "content", F.sha2("content", 256).alias("sha256"))


def append_records(df: DataFrame, path: str) -> None:
    """Append records as JSONL; the files of a failed job are not seen, as its commit does not happen."""
    df.write.mode("append").json(path)
