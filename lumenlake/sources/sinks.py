"""Where results go: Parquet between stages, CSV and JSON for people."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(frame: DataFrame, path: str, one_file: bool = False, separator: str = ",") -> None:
    """CSV with a header; ``one_file`` only for results known to be small."""
    (frame.coalesce(1) if one_file else frame).write.mode("overwrite").option("header", True).option("sep", separator).csv(path)


def write_summary(frame: DataFrame, path: str) -> None:
    """Rows as JSON objects, one a line."""
    frame.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def write_vectors(frame: DataFrame, path: str) -> None:
    """Keyed vectors, compressed."""
    frame.write.mode("overwrite").option("compression", "zstd").parquet(path)


def append_run(frame: DataFrame, path: str, by: Sequence[str]) -> None:
    """Rows of finished runs, partitioned by run; writing a run again replaces it alone."""
    frame.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def write_failures(frame: DataFrame, path: str) -> None:
    """The failure log: rows that could not be processed, with their reason."""
    write_csv(frame.where("failure IS NOT NULL").select(*[c for c, t in frame.dtypes if not t.startswith(("array", "map", "struct"))]), path)


def exit_code(frame: DataFrame, passed: str, failed: int = 2) -> int:
    """0 if the column holds in every row, else ``failed``."""
    return 0 if frame.where(~F.coalesce(F.col(passed), F.lit(False))).isEmpty() else failed


def write_matrix(frame: DataFrame, path: str, row: str, column: str, value: str, names: Sequence[str]) -> None:
    """A square table with its row names in the first column."""
    write_csv(frame.groupBy(row).pivot(column, list(names)).agg(F.first(value, ignorenulls=True)).select(row, *[f"`{n}`" for n in names]).orderBy(row), path, one_file=True)
