"""Feature frames: tables with a row id, a 0/1 label and numeric features, made from the standard tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import hash_uniform
from ..operators.metrics import long_form
from ..operators.prep import medians
from ..sources.staging import staged
from ..sources.tables import table


@dataclass(frozen=True)
class FeatureFrame:
    df: DataFrame
    row_id: str
    label: str
    features: list[str]
    train: str | None = None

    def long(self, keep: list[str] = ()) -> DataFrame:
        return long_form(self.df, self.features, [self.row_id, self.label, *keep])

    def part(self, train: bool) -> FeatureFrame:
        return FeatureFrame(self.df.where(F.col(self.train) == F.lit(train)), self.row_id, self.label, self.features, self.train)


DOC_NUMBERS = ["n_chars", "n_sp", "n_nl", "n_dig", "avg_w"]


def documents_frame(spark: SparkSession, sf_dir: str) -> FeatureFrame:
    """Labelled documents: counts of characters, spaces, line ends and digits, and the length of a word."""
    text = F.col("text")
    count = lambda c: (F.char_length(text) - F.char_length(F.replace(text, F.lit(c)))).cast("double")
    digits = (F.char_length(text) - F.char_length(F.regexp_replace(text, "[0-9]", ""))).cast("double")
    df = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    df = df.select("doc_id", F.col("quality").cast("int").alias("label"), F.col("n_chars").cast("double").alias("n_chars"), count(" ").alias("n_sp"), count("\n").alias("n_nl"), digits.alias("n_dig"), "lang", "source")
    df = df.withColumn("avg_w", F.col("n_chars") / (F.col("n_sp") + 1)).withColumn("train", hash_uniform(42, "split", F.col("doc_id")) < 0.7)
    return FeatureFrame(df, "doc_id", "label", DOC_NUMBERS, "train")


MIXED = ["n_chars", "n_sp", "n_nl", "avg_w", "lang_de", "lang_en", "lang_es", "lang_fr", "long_lines", "dig:missing", "dig"]


def mixed_frame(spark: SparkSession, sf_dir: str) -> FeatureFrame:
    """Labelled documents with numbers, a one-hot group, a flag, and a value that an availability flag goes with: digits,
    which a text without any has the middle number of. Numbers of texts are staged: the median takes two passes."""
    numbers = staged(documents_frame(spark, sf_dir).df, "numbers")
    fill = medians(numbers.where("train AND n_dig > 0"), ["n_dig"])["n_dig"] or 0.0
    none = F.col("n_dig") == 0
    df = numbers.withColumns({f"lang_{x}": (F.col("lang") == x).cast("int") for x in ("de", "en", "es", "fr")})
    df = df.withColumns({"long_lines": (F.col("n_chars") > 300 * (F.col("n_nl") + 1)).cast("int"), "dig:missing": none.cast("int"), "dig": F.when(none, F.lit(fill)).otherwise(F.col("n_dig"))})
    return FeatureFrame(df, "doc_id", "label", MIXED, "train")


LINE_NUMBERS = ["qty", "price", "disc", "tax"]


def line_frame(spark: SparkSession, sf_dir: str) -> FeatureFrame:
    """Line items, whose label is whether the discounted price is above the median. score is a noisy view of it with
    many ties, and w a weight; both are draws by row id."""
    c = F.col
    df = table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.round(c("l_extendedprice") * 100).cast("bigint")).alias("rid"),
        c("l_quantity").alias("qty"), c("l_extendedprice").alias("price"), c("l_discount").alias("disc"), c("l_tax").alias("tax"), "l_returnflag", "l_linestatus",
    )
    net = c("price") * (1 - c("disc"))
    middle = medians(df.select(net.alias("net")), ["net"])["net"]
    df = df.withColumn("label", (net > F.lit(middle)).cast("int"))
    df = df.withColumn("score", F.floor((c("price") / 100000 * 0.6 + hash_uniform(42, "score", c("rid")) * 0.4) * 100).cast("double") / 100)
    df = df.withColumn("w", 0.5 + hash_uniform(42, "weight", c("rid"))).withColumn("train", hash_uniform(42, "split", c("rid")) < 0.7)
    return FeatureFrame(df, "rid", "label", LINE_NUMBERS, "train")


CUST_NUMBERS = ["bal", "n_orders", "spend", "ev_value", "ev_n"]


def customer_frame(spark: SparkSession, sf_dir: str) -> FeatureFrame:
    """Customers with aggregates of their orders and events; most have no events, so theirs are missing. Both sides
    are summed by customer before they are joined."""
    orders = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).cast("double").alias("n_orders"), F.sum("o_totalprice").alias("spend"))
    events = table(spark, sf_dir, "events").groupBy("user_id").agg(F.avg("value").alias("ev_value"), F.count(F.lit(1)).cast("double").alias("ev_n"))
    df = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").alias("bal"), "c_mktsegment", "c_nationkey")
    df = df.join(orders, F.col("c_custkey") == F.col("o_custkey"), "left").join(events, F.col("c_custkey") == F.col("user_id"), "left").drop("o_custkey", "user_id")
    df = df.withColumn("label", (F.col("c_mktsegment") == "BUILDING").cast("int")).withColumn("train", hash_uniform(42, "split", F.col("c_custkey")) < 0.7)
    return FeatureFrame(df, "c_custkey", "label", CUST_NUMBERS, "train")


#: The same frames as SQL, for checks by another engine; {u} stands for the text of a draw there.
SQL = {
    "doc": """doc AS (
  SELECT *, n_chars / (n_sp + 1) AS avg_w FROM (
    SELECT d.doc_id, l.quality::INTEGER AS label, d.n_chars::DOUBLE AS n_chars,
           (length(text) - length(replace(text, ' ', '')))::DOUBLE AS n_sp,
           (length(text) - length(replace(text, chr(10), '')))::DOUBLE AS n_nl,
           (length(text) - length(regexp_replace(text, '[0-9]', '', 'g')))::DOUBLE AS n_dig, lang, source,
           {u:concat_ws('|', 42, 'split', d.doc_id)} < 0.7 AS train
    FROM documents d JOIN labels l USING (doc_id)))""",
    "line": """line0 AS (
  SELECT concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber, round(l_extendedprice * 100)::BIGINT) AS rid,
         l_quantity AS qty, l_extendedprice AS price, l_discount AS disc, l_tax AS tax, l_returnflag, l_linestatus
  FROM lineitem),
line AS (
  SELECT *, (price * (1 - disc) > (SELECT quantile_cont(price * (1 - disc), 0.5) FROM line0))::INTEGER AS label,
         floor((price / 100000 * 0.6 + {u:concat_ws('|', 42, 'score', rid)} * 0.4) * 100) / 100 AS score,
         0.5 + {u:concat_ws('|', 42, 'weight', rid)} AS w,
         {u:concat_ws('|', 42, 'split', rid)} < 0.7 AS train
  FROM line0)""",
    "cust": """cust AS (
  SELECT c_custkey, c_acctbal AS bal, c_mktsegment, c_nationkey, o.n_orders, o.spend, e.ev_value, e.ev_n,
         (c_mktsegment = 'BUILDING')::INTEGER AS label, {u:concat_ws('|', 42, 'split', c_custkey)} < 0.7 AS train
  FROM customer
  LEFT JOIN (SELECT o_custkey, count(*)::DOUBLE AS n_orders, sum(o_totalprice) AS spend FROM orders GROUP BY 1) o ON c_custkey = o_custkey
  LEFT JOIN (SELECT user_id, avg(value) AS ev_value, count(*)::DOUBLE AS ev_n FROM events GROUP BY 1) e ON c_custkey = user_id)""",
}
