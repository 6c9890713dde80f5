"""Fill-in-the-middle: documents cut at two unit borders and put in prefix-suffix-middle or suffix-prefix-middle order."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import fresh_path, release

#: Units of a text, white space in front of what follows it (the classes exclude each other, so nothing is
#: tried twice), and the marks of the parts.
UNIT = r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++|[\x20\x09-\x0D]++"
MARKS = ("<P>", "<S>", "<M>")

KEY = ["k1", "k2"]


def draws(doc_id: Column, seed: int = 42) -> list[Column]:
    """The first four 8-digit groups of the hex sha256 of seed:doc_id, as unsigned integers. A null id is no digits."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, at, 8), 16, 10).cast("long") for at in (1, 9, 17, 25)]


def restore(output: Column, form: Column) -> Column:
    """The text that an output was made of: a text that holds a mark is never cut, so the marks stand where they were put."""
    parts = F.split(output, "<[PSM]>", -1)
    psm, spm = F.concat(parts[1], parts[3], parts[2]), F.concat(parts[2], parts[3], parts[1])
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def _forms(docs: DataFrame, id_col: str, text_col: str, seed: int, plain_percent: int, spm_percent: int) -> DataFrame:
    """(doc_id, text, n, form, first, second): the units, the form and the two cuts, as numbers of units."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select("*", F.explode(F.array(F.struct(*[h.alias(f"h{i}") for i, h in enumerate(draws(F.col("doc_id"), seed), 1)]))).alias("h"))
    marked = reduce(lambda a, b: a | b, [F.contains("text", F.lit(m)) for m in MARKS])
    plain = (F.col("text") == "") | marked | (F.col("h.h3") % 100 >= 100 - plain_percent)
    form = F.when(plain, "plain").when(F.col("h.h4") % 100 < spm_percent, "spm").otherwise("psm")
    rows = rows.select("doc_id", "text", "h", F.explode(F.array(F.regexp_count("text", F.lit(UNIT)).cast("long"))).alias("n"), form.alias("form"))
    a, b = F.col("h.h1") % (F.col("n") + 1), F.col("h.h2") % (F.col("n") + 1)
    return rows.select("doc_id", "text", "n", "form", F.least(a, b).alias("first"), F.greatest(a, b).alias("second"))


def _bucketed(rows: DataFrame) -> DataFrame:
    """rows of documents to be cut, written once and bucketed by KEY, so that none of the joins after it is an exchange.
    Rows alike in one partition are one row with its copies, and each partition has its own: however often a document
    comes, no bucket gets it more than once a partition. The key follows from what is in the row and the partition,
    not from the order there, so a task that runs again writes the same."""
    spark, n = rows.sparkSession, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = rows.select("*", *[F.xxhash64(F.lit(i), "doc_id", "text", F.spark_partition_id()).alias(k) for i, k in enumerate(KEY)])
    whole = [c for c in rows.columns]
    merged = keyed.groupBy(*KEY).agg(F.count(F.lit(1)).alias("copies"), *[F.first(c).alias(c) for c in whole])
    name = f"fill_middle_{uuid.uuid4().hex}"
    merged.write.bucketBy(n, *KEY).sortBy(*KEY).option("path", fresh_path(spark, name)).format("parquet").saveAsTable(name)
    del keyed, merged
    release(spark, 0)
    return spark.table(name)


def fill_in_middle(docs: DataFrame, seed: int = 42, plain_percent: int = 50, spm_percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and output, one row for each row of docs, in any order.

    The units of a text to be cut are rows; a window sums their lengths; each document's two requests meet the units of
    their ordinals, whose sums are its offsets, by which the text is cut. A null text is an empty one; a text that is
    empty, holds a mark, or is drawn so stays plain, with null lengths. Rows with a null id draw as if the id had no
    digits; repeated rows each give a row. Other columns take no part, whatever their names.
    """
    rows = _forms(docs, id_col, text_col, seed, plain_percent, spm_percent)
    kept = rows.where("form = 'plain'").select("doc_id", "n", "form", F.lit(None).cast("long").alias("prefix_chars"), F.lit(None).cast("long").alias("middle_chars"), F.col("text").alias("output"))
    cut = _bucketed(rows.where("form != 'plain'"))
    units = cut.select(*KEY, F.posexplode(F.slice(F.regexp_extract_all("text", F.lit(UNIT), F.lit(0)), F.lit(1), F.col("second").cast("int"))).alias("pos", "unit"))
    units = units.select(*KEY, (F.col("pos") + 1).cast("long").alias("ordinal"), F.char_length("unit").cast("long").alias("length"))
    ends = units.withColumn("reach", F.sum("length").over(Window.partitionBy(*KEY).orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)))
    requests = cut.select(*[F.col(k).alias(f"of_{k}") for k in KEY], "first", "second")
    on = (F.col("k1") == F.col("of_k1")) & (F.col("k2") == F.col("of_k2")) & ((F.col("ordinal") == F.col("first")) | (F.col("ordinal") == F.col("second")))
    met = ends.join(requests.hint("merge"), on)
    at = lambda which: F.max(F.when(F.col("ordinal") == F.col(which), F.col("reach")))
    offsets = met.groupBy(*KEY).agg(at("first").alias("a"), at("second").alias("b"))
    # A cut before the first unit meets none: its offset is 0.
    whole = cut.join(offsets.hint("merge"), KEY, "left").select("*", F.coalesce("a", F.lit(0)).cast("int").alias("_a"), F.coalesce("b", F.lit(0)).cast("int").alias("_b"))
    prefix, middle = F.substring("text", F.lit(1), F.col("_a")), F.substring("text", F.col("_a") + 1, F.col("_b") - F.col("_a"))
    suffix = F.substring("text", F.col("_b") + 1, F.char_length("text"))
    p, s, m = (F.lit(x) for x in MARKS)
    output = F.when(F.col("form") == "psm", F.concat(p, prefix, s, suffix, m, middle)).otherwise(F.concat(s, suffix, p, prefix, m, middle))
    made = whole.select("doc_id", "n", "form", F.col("_a").cast("long").alias("prefix_chars"), (F.col("_b") - F.col("_a")).cast("long").alias("middle_chars"), output.alias("output"), "copies")
    made = made.select("*", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_copy")).drop("copies", "_copy")
    return kept.unionByName(made)
