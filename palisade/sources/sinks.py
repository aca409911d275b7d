"""Writing findings."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_findings(findings: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Parquet, one folder per scanner.

    The rows come straight from narrow scans or joins, so no shuffle is added here; each
    task writes one file per scanner it saw (at most 14).
    """
    findings.write.mode(mode).partitionBy("scanner").parquet(path)


def read_findings(spark, path: str) -> DataFrame:
    return spark.read.parquet(path)
