"""Sinks: appends with deterministic ids, snapshots, and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_ids(atoms: DataFrame, keys: tuple[str, ...] = ("source", "resolution", "ts", "content")) -> DataFrame:
    """Atoms with an id that follows from what they are, so that a repeated insert makes the same id."""
    return atoms.withColumn("atom_id", F.md5(F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys])))


def append(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("append")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def snapshot(df: DataFrame, path: str) -> DataFrame:
    """Write a new snapshot and read it; the old one must be another path."""
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def append_once(path: str):
    """For ``foreachBatch``: each micro-batch goes to a folder of its own, so a batch that runs again replaces itself."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return write
