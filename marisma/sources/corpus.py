"""Article files in and out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marisma.functions import times
from marisma.schemas import RAW_ARTICLE
from marisma.session import cut_lineage

CORRUPT = "_corrupt_record"


def scan_json_tree(spark: SparkSession, root: str, schema: str = RAW_ARTICLE, multi_line: bool = True) -> DataFrame:
    """Every *.json and *.json.gz below a folder, with its path and file time.

    multi_line reads one object per file; otherwise one object per line.
    A file that cannot be read fills the corrupt-record column.
    """
    rows = (
        spark.read.schema(f"{schema}, {CORRUPT} STRING")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.{json,json.gz}")
        .option("multiLine", multi_line)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .json(root)
    )
    return with_file_meta(rows)


def with_file_meta(df: DataFrame) -> DataFrame:
    return df.withColumns({"path": F.col("_metadata.file_path"), "mtime": F.col("_metadata.file_modification_time")})


def publication_time(date: Column, mtime: Column) -> Column:
    """Date of the article, else the time of its file."""
    return F.coalesce(times.to_utc_search(date), mtime)


def quarantine_corrupt(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(readable rows, unreadable files).  Nothing is deleted.

    The parsed rows are written out once, so both sides agree and the files are read once.
    """
    parsed = cut_lineage(df, "parsed")
    good = parsed.filter(F.col(CORRUPT).isNull()).drop(CORRUPT)
    bad = parsed.filter(F.col(CORRUPT).isNotNull()).select("path", "mtime", CORRUPT)
    return good, bad


def output_path(path: Column) -> Column:
    """Every output is gzip JSON: the suffix becomes .json.gz."""
    stem = F.regexp_replace(path, r"(\.json\.gz|\.[^./]*)$", "")
    return F.concat(stem, F.lit(".json.gz"))


def write_json_gz(df: DataFrame, out: str) -> None:
    df.write.option("compression", "gzip").json(out)
