"""Shared storage, table access and byte-exact text helpers for the training-data operators."""

from __future__ import annotations

import gc
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.staging import staged as stash
from ..sources.staging import work_folder

__all__ = ["BLANKS", "Sealed", "ascii_lower", "barrier", "fresh_path", "lookup", "release", "remove_path", "stash", "table"]

#: Fixed value: the white space of the contracts, [\x20\x09-\x0D], without the newline that splits lines.
BLANKS = " \t\n\x0b\x0c\r"


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{work_folder(spark)}/{name}-{uuid.uuid4().hex}"


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a table of this library in the shared folder, by Hadoop's file system so that any store works."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


#: When the last collection that release() asked for ended.
_RELEASED = [float("-inf")]


def release(spark: SparkSession, spacing: float = 20.0) -> None:
    """Let go of the shuffle files of steps that are written: Spark deletes them once the driver's garbage, which else is
    collected when its heap happens to fill, no longer holds their plans. The first round frees what holds them.

    Within `spacing` seconds of the last time it is left to a later call. The driver's JVM enlarges its heap as long as
    collections take more than a small part of the time, and those asked for count: after the short steps of a small
    input they would make it grow."""
    if time.monotonic() - _RELEASED[0] < spacing:
        return
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.3)
    _RELEASED[0] = time.monotonic()


@dataclass(frozen=True)
class Sealed:
    """A frame whose columns go by their place (c0, c1, ...), so that no name of theirs can clash with what an operator
    adds on its way. An added column takes the place of one of the same name, in either case of letters."""

    frame: DataFrame
    names: list[str]

    @staticmethod
    def of(docs: DataFrame) -> Sealed:
        return Sealed(docs.toDF(*[f"c{i}" for i in range(len(docs.columns))]), docs.columns)

    def __getitem__(self, name: str) -> Column:
        return F.col(f"c{self.names.index(name)}")

    def __contains__(self, name: str) -> bool:
        return name in self.names

    def back(self, added: dict[str, Column], changed: dict[str, Column] | None = None) -> list[Column]:
        """The old columns by their names, those in `changed` anew, and the added ones."""
        gone = {c.lower() for c in added}
        old = [(changed or {}).get(c, F.col(f"c{i}")).alias(c) for i, c in enumerate(self.names) if c.lower() not in gone]
        return [*old, *[c.alias(name) for name, c in added.items()]]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z alone. lower() does that, fast, for pure ASCII; other text goes letter by letter."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def barrier(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that later projections read rather than recompute: a one-row generator is not collapsed."""
    made = F.struct(*[c.alias(k) for k, c in columns.items()])
    return df.withColumn("_made", F.explode(F.array(made))).select("*", *[F.col("_made")[k].alias(k) for k in columns]).drop("_made")


def lookup(left: DataFrame, right: DataFrame, keys: list[str], weight: str, spread: list[str], total: int, hot_keys: int = 20_000) -> DataFrame:
    """left outer join to right, which has one row for each value of keys (longs) and in weight the rows that left has
    for it. Keys with over a hot_keys-th of all total rows, of which there can be no more than hot_keys, are
    looked up by broadcast; their rows then go through the shuffle for the other keys spread by other columns, where
    nothing matches them. So no task gets more than a hot_keys-th of the rows for a key."""
    payload = [c for c in right.columns if c not in (*keys, weight)]
    hot = F.broadcast(right.where(F.col(weight) > total // hot_keys).select(*keys, F.lit(True).alias("_hot"), *[F.col(c).alias(f"_hot_{c}") for c in payload]))
    cold = right.where(F.col(weight) <= total // hot_keys).select(F.col(keys[0]).alias("_key"), *keys[1:], *[F.col(c).alias(f"_cold_{c}") for c in payload])
    both = left.join(hot, keys, "left").withColumn("_key", F.when(F.col("_hot"), F.xxhash64(F.lit("spread"), *spread)).otherwise(F.col(keys[0])))
    both = both.join(cold.hint("merge"), ["_key", *keys[1:]], "left")
    return both.select(*left.columns, *[F.coalesce(f"_hot_{c}", f"_cold_{c}").alias(c) for c in payload])
