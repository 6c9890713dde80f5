"""Line deduplication over levelled sorted runs of line hashes (DataFrame operations only).

An index is a list of immutable runs. A run is a Parquet table, hash-bucketed and sorted by a 128-bit line key,
with one row per key: how many documents of the run's batches hold the line, and the document that keeps it.
Two runs of one level are merged into one run of the next level by a co-bucketed merge join, which needs no
exchange; so a key is rewritten O(log batches) times, and each batch shuffles only its own lines.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import BLANKS, Sealed, ascii_lower, barrier, fresh_path, lookup, release, remove_path, stash

KEY = ["h1", "h2"]


def line_postings(docs: DataFrame, min_chars: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, h1, h2, body, pos) for each line whose key has min_chars code points or more: body is a hash of the text and pos
    the line's place in it. Rows without an id hold no key."""
    whole = docs.where(F.col(id_col).isNotNull() & (F.char_length(text_col) >= min_chars))
    whole = whole.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text_col).alias("body"), F.col(text_col).alias("text"))  # the hash once a text, not once a line
    lines = whole.select("doc", "body", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    lines = lines.where(F.char_length("line") >= min_chars).select("doc", "body", "pos", F.explode(F.array(ascii_lower(F.btrim("line", F.lit(BLANKS))))).alias("key"))
    # Two independently seeded 64-bit hashes: no chance collision even among 10^13 lines.
    return lines.where(F.char_length("key") >= min_chars).select("doc", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "body", "pos")


@dataclass
class LineRuns:
    """The levelled runs. buckets: of every run; fanout: runs of a level that are merged into one of the next."""

    spark: SparkSession
    buckets: int
    fanout: int = 2
    levels: list[list[str]] = field(default_factory=list)

    def _write(self, df: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        path = fresh_path(self.spark, name)
        df.repartition(self.buckets, "h1").write.bucketBy(self.buckets, "h1").sortBy(*KEY).option("path", path).format("parquet").saveAsTable(name)
        return name

    def _drop(self, name: str) -> None:
        path = self.spark.sql(f"DESCRIBE FORMATTED {name}").where("col_name = 'Location'").first()["data_type"]
        self.spark.sql(f"DROP TABLE {name}")
        remove_path(self.spark, path)

    def runs(self) -> list[DataFrame]:
        """Newest level first."""
        return [self.spark.table(name) for level in self.levels for name in reversed(level)]

    def unseen(self, keys: DataFrame) -> DataFrame:
        """The rows of keys that no run holds: one merge anti-join for each of the few runs."""
        return reduce(lambda left, run: left.join(run.select(*KEY).hint("merge"), KEY, "left_anti"), self.runs(), keys)

    def add(self, postings: DataFrame) -> None:
        """Add a batch of (doc, h1, h2). Batches are disjoint in their documents and come in descending order of
        document, so a key that the runs already hold keeps its document there: only its count goes on."""
        counts = postings.groupBy(*KEY, "doc").agg(F.lit(1).alias("_")).groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc").alias("keeper"))
        if self.runs():
            fresh = self.unseen(counts.select(*KEY)).withColumn("fresh", F.lit(True))
            counts = counts.join(fresh.hint("merge"), KEY, "left").select(*KEY, "n_docs", F.when(F.col("fresh"), F.col("keeper")).alias("keeper"))
        self._push(0, self._write(counts))

    def _push(self, level: int, name: str) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) >= self.fanout:
            old, self.levels[level] = self.levels[level], []
            merged = self._write(self._merged([self.spark.table(x) for x in old]))
            for x in old:
                self._drop(x)
            self._push(level + 1, merged)

    @staticmethod
    def _merged(runs: list[DataFrame]) -> DataFrame:
        """One row per key. The runs are bucketed and sorted alike, so the joins are merges without an exchange."""

        def two(a: DataFrame, b: DataFrame) -> DataFrame:
            b = b.select(*KEY, F.col("n_docs").alias("n_b"), F.col("keeper").alias("keeper_b"))
            return a.join(b.hint("merge"), KEY, "full_outer").select(*KEY, (F.coalesce("n_docs", F.lit(0)) + F.coalesce("n_b", F.lit(0))).alias("n_docs"), F.greatest("keeper", "keeper_b").alias("keeper"))

        return reduce(two, runs)

    def merged(self) -> DataFrame:
        return self._merged(self.runs())

    def drop(self) -> None:
        """Drop all runs."""
        for level in self.levels:
            for name in level:
                self._drop(name)
        self.levels = []


def _batches(docs: DataFrame, n_batches: int, id_col: str) -> list[DataFrame]:
    """All rows that have an id, in descending ranges of it; the filters prune row groups where files are in order."""
    if n_batches == 1:
        return [docs]
    cuts = docs.agg(F.percentile_approx(F.col(id_col).cast("long"), [i / n_batches for i in range(1, n_batches)], 1000)).first()[0] or []
    cuts, key = sorted(set(cuts)), F.col(id_col).cast("long")
    if not cuts:
        return [docs]
    parts = [docs.where(key <= cuts[0]), *[docs.where((key > a) & (key <= b)) for a, b in zip(cuts, cuts[1:])], docs.where(key > cuts[-1])]
    return parts[::-1]


def line_index(docs: DataFrame, min_chars: int = 40, n_batches: int = 4, buckets: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> LineRuns:
    """An index of all lines of docs, built batch by batch."""
    spark = docs.sparkSession
    index = LineRuns(spark, buckets or int(spark.conf.get("spark.sql.shuffle.partitions")))
    for batch in _batches(docs.select(id_col, text_col), n_batches, id_col):
        index.add(line_postings(batch, min_chars, id_col, text_col))
    return index


def dedup_lines(docs: DataFrame, min_docs: int = 5, min_chars: int = 40, n_batches: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with its text rid of lines that min_docs documents or more hold, but for the largest document id.

    Adds n_lines and n_dropped; all other columns stay, but for one that is named like those. A null or empty text is one
    empty line and stays as it is (a null text becomes empty). Rows with a null id hold no key and lose no line. Rows
    with one id count as one document.
    """
    spark, sealed = docs.sparkSession, Sealed.of(docs)
    rows = sealed.frame.select(sealed[id_col].alias("id"), sealed[text_col].alias("text"))
    index = line_index(rows, min_chars, n_batches, None, "id", "text")
    keys = index.merged()
    total = keys.agg(F.sum("n_docs")).first()[0] or 0
    common = stash(keys.where(F.col("n_docs") >= min_docs), "common")
    index.drop()
    release(spark)
    # Any other document that holds a common key loses the line. A hot key may be in a third of all documents:
    # lookup() spreads those rows, and the postings are made once for both kinds of key.
    postings = line_postings(rows, min_chars, "id", "text")
    hits = lookup(postings, common, KEY, "n_docs", ["doc", "pos"], total).where("doc != keeper")
    losses = hits.groupBy(F.col("doc").alias("id"), "body").agg(F.sort_array(F.collect_set("pos")).alias("gone"))
    text = F.coalesce(sealed[text_col], F.lit(""))
    kept = sealed.frame.withColumns({"id": sealed[id_col].cast("long"), "body": F.xxhash64(text)}).join(losses, ["id", "body"], "left")
    kept = kept.withColumn("lines", F.split(text, "\n", -1))
    # What stays are the stretches between lost lines: one pass, however many there are.
    ends = F.concat(F.array(F.lit(-1)), "gone", F.array(F.size("lines")))
    stretch = lambda i: F.slice("lines", F.get(F.col("ends"), i) + 2, F.get(F.col("ends"), i + 1) - F.get(F.col("ends"), i) - 1)
    kept = barrier(kept.withColumn("ends", F.when(F.col("gone").isNotNull(), ends)), stays=F.when(F.col("ends").isNotNull(), F.flatten(F.transform(F.sequence(F.lit(0), F.size("ends") - 2), stretch))))
    new = F.when(F.col("ends").isNull(), text).otherwise(F.array_join("stays", "\n"))
    n_lost = F.when(F.col("gone").isNull(), F.lit(0)).otherwise(F.size("gone"))
    return kept.select(*sealed.back({"n_lines": F.size("lines").cast("long"), "n_dropped": n_lost.cast("long")}, {text_col: new}))
