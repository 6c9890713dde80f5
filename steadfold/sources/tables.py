"""Reading the tables that queries run on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .staging import staged


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def csv_table(spark: SparkSession, paths: str | list[str], schema: str | None = None, header: bool = True) -> DataFrame:
    """A CSV scan. Without a schema every column is text: nothing is read twice to guess types."""
    reader = spark.read.option("header", header)
    if schema:
        return reader.schema(schema).csv(paths)
    return reader.csv(paths)


def header_columns(spark: SparkSession, path: str) -> list[str]:
    return spark.read.option("header", True).csv(path).columns


def projected(df: DataFrame, wanted: list[str]) -> DataFrame:
    """The wanted columns, found whatever the case of their names; those that are missing are left out."""
    by_name = {c.lower(): c for c in df.columns}
    return df.select(*[by_name[w.lower()] for w in wanted if w.lower() in by_name])


def files_in_order(spark: SparkSession, paths: list[str], schema: str | None = None) -> DataFrame:
    """Rows of several CSV files (or folders of files, in the order of their names) with their path's ordinal (part) and
    their place in it (row, from 0), neither of which a scan keeps.

    A task reads a block of a file from its start on, so a row's place among the rows of its block is known there; how
    many rows the blocks before it have comes from a table with a row for a block."""
    parts = [csv_table(spark, p, schema).select("*", F.lit(i).alias("part"), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block")) for i, p in enumerate(paths)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    names = [c for c in out.columns if c not in ("_file", "_block")]
    rows = staged(out.withColumn("_at", F.monotonically_increasing_id()), "files")
    blocks = rows.groupBy("part", "_file", "_block").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("part").orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return rows.join(F.broadcast(blocks), ["part", "_file", "_block"]).select(*names, (F.col("_before") + F.col("_at") - F.col("_first")).alias("row"))


def checked_split(df: DataFrame, target: str, inputs: list[str]) -> DataFrame:
    """The target and the inputs, in order; fails if one is missing or a target is neither 0 nor 1."""
    missing = [c for c in [target, *inputs] if c not in df.columns]
    if missing:
        raise ValueError(f"columns are missing: {missing}")
    if not df.where(F.col(target).isNull() | ~F.col(target).isin(0, 1)).isEmpty():
        raise ValueError(f"{target} has values other than 0 and 1")
    return df.select(target, *inputs)


def write_csv(df: DataFrame, path: str, digits: int | None = None) -> None:
    """A CSV folder with a header; doubles to so many digits if asked for."""
    if digits is not None:
        df = df.withColumns({c: F.format_string(f"%.{digits}f", c) for c, kind in df.dtypes if kind in ("double", "float")})
    df.write.option("header", True).csv(path)


def write_statistics(spark: SparkSession, rows: list[dict], path: str) -> bool:
    """A CSV folder of statistics: the header is the first row's keys, in order, and what other rows lack is empty. Nothing
    is written for an empty list."""
    if not rows:
        return False
    names = list(rows[0])
    text = [tuple(None if r.get(c) is None else str(r[c]) for c in names) for r in rows]
    spark.createDataFrame(text, ", ".join(f"`{c}` string" for c in names)).coalesce(1).write.option("header", True).csv(path)
    return True
