"""Runs on shared storage: tables by seed, a completion row last, fingerprints that refuse other data."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def fingerprint(df: DataFrame, columns: list[str] | None = None) -> dict[str, str]:
    """Rows, column names in order, and a sum of row hashes: the same for any order and partitioning of the rows."""
    columns = columns or df.columns
    n, code = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*[F.col(f"`{c}`") for c in columns]).cast("decimal(38,0)"))).first()
    return {"rows": str(n), "columns": "\n".join(columns), "hash": str(code or 0)}


def compare_fingerprints(old: dict, new: dict, settings: list[str]) -> list[str]:
    """Names that differ. Different data or settings raise; anything else (an environment) is for the caller to report."""
    differ = sorted(k for k in {*old, *new} if old.get(k) != new.get(k))
    refused = [k for k in differ if k in settings]
    if refused:
        raise ValueError(f"the run was made with other values of: {refused}")
    return differ


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables hold the same rows, duplicates counted."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


class RunStore:
    """A folder with front/seed=S and best/seed=S as Parquet, done/seed=S after both, and JSON beside them.

    A seed counts only with its completion row, which is written last; what a failed attempt left is written over. So a
    run goes on after a crash with the seeds that are missing. All paths go through Spark's file systems."""

    FRONT = "ordinal int, mask string, auc double, sign double, n_features int"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _exists(self, path: str) -> bool:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(target)

    def write_json(self, name: str, value: dict) -> None:
        """Written beside its place and renamed over it: a reader sees the old text or the new one."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        place, part = (jvm.org.apache.hadoop.fs.Path(f"{self.path}/{x}") for x in (name, f".{name}.part"))
        stream = place.getFileSystem(conf).create(part, True)
        stream.write(bytearray(json.dumps(value, sort_keys=True).encode()))
        stream.hsync()
        stream.close()
        over = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(place.toUri(), conf).rename(part, place, over)

    def read_json(self, name: str) -> dict:
        return json.loads(self.spark.read.text(f"{self.path}/{name}", wholetext=True).first()[0])

    def open(self, marks: dict, settings: list[str]) -> list[str]:
        """Start a run, or go on with it if its data and settings are these; differences that are allowed come back."""
        if not self._exists(f"{self.path}/fingerprint.json"):
            self.write_json("fingerprint.json", marks)
            return []
        return compare_fingerprints(self.read_json("fingerprint.json"), marks, settings)

    def save(self, seed: int, front: list[tuple[int, str, float, float, int]]) -> None:
        self.spark.createDataFrame(front, self.FRONT).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/front/seed={seed}")
        self.spark.createDataFrame([(len(front),)], "n int").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/done/seed={seed}")

    def seeds(self) -> list[int]:
        if not self._exists(f"{self.path}/done"):
            return []
        return [r["seed"] for r in self.spark.read.parquet(f"{self.path}/done").select("seed").distinct().orderBy("seed").collect()]

    def missing(self, wanted: list[int]) -> list[int]:
        have = set(self.seeds())
        return [s for s in wanted if s not in have]

    def fronts(self) -> DataFrame:
        """All complete seeds' rows, with seed."""
        return self.spark.read.option("basePath", f"{self.path}/front").parquet(*[f"{self.path}/front/seed={s}" for s in self.seeds()])

    def finish(self, wanted: list[int], train_seed) -> DataFrame:
        """Train the seeds that are missing, save each, and read all back from storage."""
        for seed in self.missing(wanted):
            self.save(seed, train_seed(seed))
        return self.fronts()

    def import_results(self, results: dict[int, list[tuple[int, str, float, float, int]]]) -> list[int]:
        """Save fronts that are in memory, but for seeds that are complete already; the seeds that were saved."""
        new = self.missing(sorted(results))
        for seed in new:
            self.save(seed, results[seed])
        return new

    def claim(self, marks: dict, settings: list[str], name: str = "evaluation.json") -> None:
        """Note what an evaluation is of, before its results are written here; another one's place is refused."""
        if self._exists(f"{self.path}/{name}"):
            compare_fingerprints(self.read_json(name), marks, settings)
        self.write_json(name, marks)

    def write_manifest(self, parts: dict[str, list[str]], marks: dict) -> None:
        """The files that each part of the data is read from, and the fingerprint of the whole."""
        self.write_json("manifest.json", {"parts": parts, "marks": marks})

    def rebuild(self, read: Callable[[list[str]], DataFrame]) -> dict[str, DataFrame]:
        """The data of a run, by part, from the files that its manifest lists; refused if they are other data by now. read:
        makes a table of files."""
        held = self.read_json("manifest.json")
        parts = {name: read(files) for name, files in held["parts"].items()}
        whole = reduce(DataFrame.unionByName, parts.values())
        compare_fingerprints(held["marks"], fingerprint(whole, held["marks"]["columns"].split("\n")), list(held["marks"]))
        return parts

    def resume_manifest(self, marks: dict, settings: list[str]) -> dict[str, list[str]]:
        """The manifest's parts, if it is of these data; else it is refused."""
        held = self.read_json("manifest.json")
        compare_fingerprints(held["marks"], marks, settings)
        return held["parts"]


#: Row hashes are summed in this field: a Mersenne prime.
FIELD = 2**61 - 1


def _bucket_sums(tables: dict[str, DataFrame], columns: list[str], buckets: int) -> dict[str, list[int]]:
    """For each table, in each bucket of row hashes, the sum of a second hash, in the field. One pass over all tables."""
    names = [F.col(f"`{c}`") for c in columns]
    marked = [df.select(F.lit(name).alias("name"), F.pmod(F.xxhash64(*names), F.lit(buckets)).alias("bucket"), F.pmod(F.xxhash64(F.lit("sum"), *names), F.lit(FIELD)).cast("decimal(38,0)").alias("h")) for name, df in tables.items()]
    sums = reduce(DataFrame.unionAll, marked).groupBy("name", "bucket").agg(F.sum("h").alias("h"))
    out = {name: [0] * buckets for name in tables}
    for r in sums.collect():  # as many rows as there are tables and buckets
        out[r["name"]][r["bucket"]] = int(r["h"]) % FIELD
    return out


def _counts_of(whole: list[int], kinds: list[list[int]], most: list[int]) -> Iterator[list[int]]:
    """All n with 0 <= n <= most and sum of n * kinds = whole, in the field. Elimination leaves free only those kinds that
    are sums of others; their numbers are tried, and the rest follow."""
    rows = [[k[b] for k in kinds] + [whole[b]] for b in range(len(whole))]
    pivots: list[int] = []
    for column in range(len(kinds)):
        at = next((i for i in range(len(pivots), len(rows)) if rows[i][column]), None)
        if at is None:
            continue
        top = len(pivots)
        rows[top], rows[at] = rows[at], rows[top]
        scale = pow(rows[top][column], -1, FIELD)
        rows[top] = [x * scale % FIELD for x in rows[top]]
        for i, row in enumerate(rows):
            if i != top and row[column]:
                rows[i] = [(x - row[column] * y) % FIELD for x, y in zip(row, rows[top])]
        pivots.append(column)
    if any(row[-1] for row in rows[len(pivots) :]):
        return
    free = [c for c in range(len(kinds)) if c not in pivots]
    for chosen in product(*[range(most[c] + 1) for c in free]):
        n = [0] * len(kinds)
        for c, x in zip(free, chosen):
            n[c] = x
        for row, c in zip(rows, pivots):
            n[c] = (row[-1] - sum(row[f] * x for f, x in zip(free, chosen))) % FIELD
        if all(x <= m for x, m in zip(n, most)):
            yield n


def find_files(whole: DataFrame, candidates: dict[str, DataFrame]) -> list[str] | None:
    """The names of the fewest candidates whose rows together are the whole table's, duplicates counted; None if there are
    none. An empty table is made of no files.

    Sums of row hashes add up as files do, so with more buckets of sums than files, which files these are is a system of
    linear equations: any number of files is found in one pass over them. What it gives is compared row by row."""
    known = {name: df.select(*whole.columns) for name, df in candidates.items() if set(whole.columns) <= set(df.columns)}
    if whole.isEmpty():
        return []
    if not known:
        return None
    sums = _bucket_sums({"whole": whole, **{f"file {n}": df for n, df in known.items()}}, whole.columns, len(known) + 8)
    alike: dict[tuple[int, ...], list[str]] = {}
    for name in sorted(known):
        alike.setdefault(tuple(sums[f"file {name}"]), []).append(name)
    alike.pop((0,) * (len(known) + 8), None)  # files without rows
    kinds = list(alike)
    found = sorted((sum(n), sorted(x for kind, k in zip(kinds, n) for x in alike[kind][:k])) for n in _counts_of(sums["whole"], [list(k) for k in kinds], [len(alike[k]) for k in kinds]))
    for _, names in found:
        if names and same_rows(whole, reduce(DataFrame.unionByName, [known[n] for n in names])):
            return names
    return None


def newest_run(spark: SparkSession, paths: list[str], marks: dict, settings: list[str]) -> str | None:
    """The last of paths whose fingerprint has these settings."""
    for path in sorted(paths, reverse=True):
        store = RunStore(spark, path)
        if store._exists(f"{path}/fingerprint.json"):
            old = store.read_json("fingerprint.json")
            if all(old.get(k) == marks.get(k) for k in settings):
                return path
    return None
