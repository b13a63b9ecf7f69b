"""Where results go."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillspark.scratch import remove, tables


def ensure_suffix(name: str, suffix: str) -> str:
    return name if name.lower().endswith(suffix) else name + suffix


def save_to(df: DataFrame, folder: str, name: str, *, overwrite: bool = True) -> str:
    """Write ``df`` as Parquet under a name, in place of what had it; the path."""
    path = f"{folder.rstrip('/')}/{ensure_suffix(name, '.parquet')}"
    df.write.mode("overwrite" if overwrite else "errorifexists").parquet(path)
    return path


def cleanup_temp(spark: SparkSession) -> int:
    """Remove all intermediate tables of this driver, and cached ones; how many there were. Lazy results over them end with them."""
    paths = tables()
    for path in paths:
        remove(path)
    spark.catalog.clearCache()
    return len(paths)


def checked(files: DataFrame, least: int = 1) -> DataFrame:
    """``files`` (path, content, ...) with error_code and error_message where there is nothing to read; no row fails the job."""
    from pyspark.sql import functions as F

    size = F.coalesce(F.octet_length("content"), F.lit(0))
    bad = size < least
    return files.withColumn("error_code", F.when(bad, "INVALID_INPUT")).withColumn("error_message", F.when(bad, F.concat(F.lit("expected at least "), F.lit(least).cast("string"), F.lit(" bytes, got "), size.cast("string"))))
