"""Queries of scans and sinks: tables go out as files in the shared folder and come back by the scan in question."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import store, tables
from ..sources.staging import work_folder
from .registry import query


def _folder(spark: SparkSession, name: str) -> str:
    return f"{work_folder(spark)}/{name}-{uuid.uuid4().hex}"


NATION = "n_nationkey int, n_name string, n_regionkey int"


def _nation(spark: SparkSession, d: str) -> DataFrame:
    return tables.table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def source_csv_header(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark, "csv")
    tables.write_csv(_nation(spark, d), path)
    return tables.csv_table(spark, path, NATION)


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def source_csv_given_names(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark, "csv")
    _nation(spark, d).write.csv(path)
    return tables.csv_table(spark, path, NATION, header=False)


@query("SELECT column_name AS name, (ordinal_position - 1)::INTEGER AS place FROM information_schema.columns WHERE table_name = 'nation'")
def source_header_only(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark, "csv")
    tables.write_csv(tables.table(spark, d, "nation"), path)
    return spark.createDataFrame([(c, i) for i, c in enumerate(tables.header_columns(spark, path))], "name string, place int")


@query("SELECT (n_regionkey >= 2)::INTEGER AS part, row_number() OVER (PARTITION BY n_regionkey >= 2 ORDER BY n_name DESC) - 1 AS row, n_nationkey AS key FROM nation")
def source_files_in_order(spark: SparkSession, d: str) -> DataFrame:
    """Two files, each in falling order of names, read with their rows' places."""
    paths = [_folder(spark, "csv") for _ in range(2)]
    for path, some in zip(paths, ("n_regionkey < 2", "n_regionkey >= 2")):
        tables.write_csv(_nation(spark, d).where(some).orderBy(F.desc("n_name")), path)
    return tables.files_in_order(spark, paths, NATION).select("part", "row", F.col("n_nationkey").alias("key"))


@query("SELECT count(*) AS n, sum((o_orderstatus = 'F')::INTEGER)::BIGINT AS positives, round(avg(o_totalprice), 4) AS mean, 1::BIGINT AS refused FROM orders")
def source_checked_split(spark: SparkSession, d: str) -> DataFrame:
    """A split with the target first and the inputs in order; one whose target has other values is refused."""
    df = tables.table(spark, d, "orders").withColumn("y", (F.col("o_orderstatus") == "F").cast("int"))
    good, refused = tables.checked_split(df, "y", ["o_totalprice"]), 0
    try:
        tables.checked_split(df.withColumn("y", F.col("y") * 2), "y", ["o_totalprice"])
    except ValueError:
        refused = 1
    return good.agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("positives"), F.round(F.avg("o_totalprice"), 4).alias("mean")).withColumn("refused", F.lit(refused).cast("long"))


@query("SELECT o_orderkey, round(o_totalprice, 2) AS o_totalprice FROM orders")
def source_csv_digits(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark, "csv")
    tables.write_csv(tables.table(spark, d, "orders").select("o_orderkey", "o_totalprice"), path, digits=2)
    return tables.csv_table(spark, path, "o_orderkey long, o_totalprice double")


@query("SELECT r_name AS method, r_regionkey::VARCHAR AS score FROM region")
def source_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Statistics as a driver has them, written as CSV; an empty list writes nothing."""
    rows = [{"method": r["r_name"], "score": r["r_regionkey"], "rest": 1} if i else {"method": r["r_name"], "score": r["r_regionkey"]} for i, r in enumerate(tables.table(spark, d, "region").orderBy("r_regionkey").collect())]
    path, nothing = _folder(spark, "csv"), _folder(spark, "csv")
    assert tables.write_statistics(spark, rows, path) and not tables.write_statistics(spark, [], nothing)
    return tables.csv_table(spark, path)


@query("SELECT 'customers ' || (c_custkey % 9) AS file, count(*) AS n FROM customer WHERE c_custkey % 9 < 6 GROUP BY 1")
def lineage_find_files(spark: SparkSession, d: str) -> DataFrame:
    """Which six of eleven files, two of them look-alikes of others, make up a table, and how many of its rows each has."""
    whole = tables.table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    parts = {f"customers {k}": whole.where(F.col("c_custkey") % 9 == k) for k in range(9)}
    parts["customers 1 again"] = parts["customers 1"].withColumn("c_mktsegment", F.lit("OTHER"))
    parts["customers 7 and 8"] = parts["customers 7"].unionByName(parts["customers 8"])
    names = store.find_files(whole.where("c_custkey % 9 < 6"), parts)
    found = [parts[n].select(F.lit(n).alias("file")) for n in names]
    return reduce(DataFrame.unionAll, found).groupBy("file").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT part, count(*) AS n, sum(c_custkey)::BIGINT AS keys, (SELECT count(*) FROM customer WHERE c_custkey % 3 = 0) AS n_without FROM (SELECT CASE WHEN c_custkey % 3 = 0 THEN 'test' ELSE 'train' END AS part, c_custkey FROM customer) GROUP BY 1")
def lineage_rebuild(spark: SparkSession, d: str) -> DataFrame:
    """A run's data read again from the files of its manifest and verified; with a file missing they are refused."""
    whole = tables.table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    files = {k: _folder(spark, "csv") for k in range(3)}
    for k, path in files.items():
        tables.write_csv(whole.where(F.col("c_custkey") % 3 == k), path)
    run, read = store.RunStore(spark, _folder(spark, "run")), lambda paths: tables.csv_table(spark, paths, "c_custkey long, c_mktsegment string")
    run.write_manifest({"train": [files[1], files[2]], "test": [files[0]]}, store.fingerprint(whole))
    made = run.rebuild(read)
    run.write_manifest({"train": [files[1], files[2]]}, store.fingerprint(whole))
    try:
        run.rebuild(read)
        without = F.lit(None).cast("long")
    except ValueError:
        without = F.lit(made["test"].count())
    sides = [df.select(F.lit(name).alias("part"), "c_custkey") for name, df in made.items()]
    return sides[0].unionAll(sides[1]).groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("c_custkey").alias("keys"), without.alias("n_without"))


@query("SELECT 'c_custkey' AS column, NULL::VARCHAR AS refused UNION ALL SELECT 'c_mktsegment', CASE WHEN count(*) <> count(*) FILTER (WHERE c_custkey % 2 = 0) THEN 'the run was made with other values of: [''hash'', ''rows'']' END FROM customer")
def lineage_resume(spark: SparkSession, d: str) -> DataFrame:
    """A manifest goes on with its own data, and refuses others."""
    whole = tables.table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    run, settings = store.RunStore(spark, _folder(spark, "run")), ["rows", "columns", "hash"]
    run.write_manifest({"train": ["a.csv"], "test": ["b.csv"]}, store.fingerprint(whole))
    parts = run.resume_manifest(store.fingerprint(whole.orderBy(F.desc("c_custkey"))), settings)
    try:
        run.resume_manifest(store.fingerprint(whole.where("c_custkey % 2 = 0")), settings)
        refused = None
    except ValueError as e:
        refused = str(e)
    return spark.createDataFrame([(c, None if i == 0 else refused) for i, c in enumerate(whole.columns) if parts["train"] == ["a.csv"]], "column string, refused string")
