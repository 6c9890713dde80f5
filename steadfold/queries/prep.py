"""Queries of the preparation operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import r6
from ..operators import prep
from ..plans.frames import customer_frame, documents_frame, line_frame
from ..sources.tables import projected, table
from .registry import query


@query("SELECT l_returnflag, count(*) AS n, count(nullif(l_linestatus, 'O')) AS n_status FROM (SELECT nullif(l_returnflag, 'N') AS l_returnflag, l_linestatus FROM lineitem) GROUP BY 1")
def prep_sentinel_to_null(spark: SparkSession, d: str) -> DataFrame:
    df = prep.null_sentinels(table(spark, d, "lineitem").select("l_returnflag", "l_linestatus"), {"l_returnflag": ["N"], "l_linestatus": ["O"]})
    return df.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.count("l_linestatus").alias("n_status"))


@query("SELECT (l_discount > 0.05)::INTEGER AS l_discount, (l_tax <> 0)::INTEGER AS has_tax, count(*) AS n FROM lineitem GROUP BY 1, 2")
def prep_label_threshold(spark: SparkSession, d: str) -> DataFrame:
    df = prep.binarise(table(spark, d, "lineitem").select("l_discount", "l_tax"), {"l_discount": 0.05})
    return df.groupBy("l_discount", (F.col("l_tax") != 0).cast("int").alias("has_tax")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT p_size, CASE WHEN c IS NULL OR c = '?' THEN 'Missing'
  WHEN v BETWEEN 390 AND 459 OR v = 785 THEN 'Circulatory' WHEN v BETWEEN 460 AND 519 OR v = 786 THEN 'Respiratory'
  WHEN v BETWEEN 520 AND 579 OR v = 787 THEN 'Digestive' WHEN v = 250 THEN 'Diabetes' WHEN v BETWEEN 800 AND 999 THEN 'Injury'
  WHEN v BETWEEN 710 AND 739 THEN 'Musculoskeletal' WHEN v BETWEEN 580 AND 629 OR v = 788 THEN 'Genitourinary'
  WHEN v BETWEEN 140 AND 239 THEN 'Neoplasms' ELSE 'Other' END AS category, count(*) AS n
FROM (SELECT p_size, c, floor(TRY_CAST(c AS DOUBLE)) AS v FROM (
  SELECT p_size, CASE WHEN p_size = 1 THEN NULL WHEN p_size = 2 THEN '?' WHEN p_size = 3 THEN 'V' || p_size
    ELSE (130 + 18 * p_size)::VARCHAR || '.5' END AS c FROM part)) GROUP BY 1, 2""")
def prep_icd_style_bucket(spark: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size")
    code = F.when(size == 2, "?").when(size == 3, F.concat(F.lit("V"), size)).when(size != 1, F.concat((130 + 18 * size).cast("string"), F.lit(".5")))
    df = table(spark, d, "part").select("p_size", prep.diagnosis_group(code).alias("category"))
    return df.groupBy("p_size", "category").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CASE l_linestatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'filled' END AS status, CASE l_returnflag WHEN 'A' THEN 'accepted' END AS flag, count(*) AS n FROM lineitem GROUP BY 1, 2")
def prep_map_codes(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "lineitem").select(prep.map_codes(F.col("l_linestatus"), {"O": "open", "F": "filled"}).alias("status"), prep.map_codes(F.col("l_returnflag"), {"A": "accepted"}).alias("flag"))
    return df.groupBy("status", "flag").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT lang_en, lang_es, lang_fr, count(*) AS n FROM (SELECT (lang = 'en')::INTEGER AS lang_en, (lang = 'es')::INTEGER AS lang_es, (lang = 'fr')::INTEGER AS lang_fr FROM documents) GROUP BY ALL")
def prep_onehot_lang(spark: SparkSession, d: str) -> DataFrame:
    df = prep.one_hot(table(spark, d, "documents").select("doc_id", "lang"), ["lang"])
    flags = df.columns[1:]
    return df.groupBy(*flags).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH {frame:cust}, m AS (SELECT quantile_cont(ev_value, 0.5) AS v, quantile_cont(ev_n, 0.5) AS n, quantile_cont(spend, 0.5) AS s FROM cust WHERE train)
SELECT c_custkey, round(coalesce(ev_value, v), 6) AS ev_value, coalesce(ev_n, n) AS ev_n, round(coalesce(spend, s), 6) AS spend,
       (ev_value IS NULL)::INTEGER AS ev_missing, (spend IS NULL)::INTEGER AS spend_missing FROM cust, m""")
def prep_missing_flag_impute(spark: SparkSession, d: str) -> DataFrame:
    df = customer_frame(spark, d).df
    columns = ["ev_value", "ev_n", "spend"]
    df = prep.impute_median(prep.missing_flags(df, columns), columns, F.col("train"))
    flag = lambda c: F.col(f"`{c}:missing`") if f"{c}:missing" in df.columns else F.lit(0)
    return df.select("c_custkey", r6("ev_value").alias("ev_value"), "ev_n", r6("spend").alias("spend"), flag("ev_value").alias("ev_missing"), flag("spend").alias("spend_missing"))


@query("""WITH {frame:line}, u AS (SELECT *, (l_returnflag <> 'N' AND qty BETWEEN 10 AND 40) AS usable FROM line),
m AS (SELECT quantile_cont(qty, 0.5) AS v FROM u WHERE train AND usable)
SELECT l_returnflag, CASE WHEN usable THEN qty ELSE v END AS qty, count(*) AS n FROM u, m GROUP BY 1, 2""")
def prep_plausible_range_impute(spark: SparkSession, d: str) -> DataFrame:
    df = prep.impute_implausible(line_frame(spark, d).df, "qty", 10, 40, F.col("l_returnflag") != "N", F.col("train"))
    return df.groupBy("l_returnflag", "qty").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_custkey, o_orderkey, round(o_totalprice, 6) AS o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k FROM orders) WHERE k = 1")
def prep_first_per_customer(spark: SparkSession, d: str) -> DataFrame:
    df = prep.first_rows(table(spark, d, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")])
    return df.select("o_custkey", "o_orderkey", r6("o_totalprice").alias("o_totalprice"))


@query("""SELECT o_custkey, arg_min(o_orderpriority, o_orderkey) AS o_orderpriority,
  arg_min(CASE WHEN o_orderstatus = 'F' THEN o_orderstatus END, CASE WHEN o_orderstatus = 'F' THEN o_orderkey END) AS o_orderstatus FROM orders GROUP BY 1""")
def prep_group_first(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "orders").withColumn("o_orderstatus", F.when(F.col("o_orderstatus") == "F", F.col("o_orderstatus")))
    return prep.first_values(df, ["o_custkey"], ["o_orderpriority", "o_orderstatus"], F.col("o_orderkey"))


@query("SELECT c.c_custkey, n.n_name, coalesce(o.n, 0) AS n_orders FROM customer c LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) o ON c_custkey = o_custkey LEFT JOIN nation n ON c_nationkey = n_nationkey")
def prep_validated_left_join(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    df = prep.validated_left_join(table(spark, d, "customer").select("c_custkey", "c_nationkey"), orders, "c_custkey")
    nation = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return df.join(nation, "c_nationkey", "left").select("c_custkey", "n_name", F.coalesce("n", F.lit(0).cast("long")).alias("n_orders"))


@query("""SELECT source AS feature, round(share, 6) AS prevalence FROM (
  SELECT source, count(*) / (SELECT count(*) FROM documents) AS share FROM documents GROUP BY 1) WHERE share >= 0.045 OR source = 'src0'""")
def prep_prevalence_filter(spark: SparkSession, d: str) -> DataFrame:
    df = prep.one_hot(table(spark, d, "documents").select("source"), ["source"], drop_first=False)
    gone = prep.rare_flags(df, df.columns, 0.045, keep=["source_src0"])
    kept = [c for c in df.columns if c not in gone]
    shares = df.agg(*[F.avg(c).alias(c) for c in kept])
    return shares.select(F.explode(F.array(*[F.struct(F.lit(c.removeprefix("source_")).alias("feature"), r6(c).alias("prevalence")) for c in kept])).alias("x")).select("x.*")


@query("""WITH {frame:doc}, f AS (SELECT doc_id, train, n_chars, n_nl, (length(lang) - 2)::DOUBLE AS lang_len, 1.0::DOUBLE AS one FROM doc)
SELECT name AS feature FROM (SELECT min(n_chars) = max(n_chars) AS n_chars, min(n_nl) = max(n_nl) AS n_nl, min(lang_len) = max(lang_len) AS lang_len, min(one) = max(one) AS one FROM f WHERE train)
UNPIVOT (c FOR name IN (n_chars, n_nl, lang_len, one)) WHERE c""")
def prep_constant_columns(spark: SparkSession, d: str) -> DataFrame:
    df = documents_frame(spark, d).df.where("train").withColumns({"lang_len": F.char_length("lang") - 2, "one": F.lit(1.0)})
    return spark.createDataFrame([(c,) for c in prep.constant_columns(df, ["n_chars", "n_nl", "lang_len", "one"])], "feature string")


@query("""WITH {frame:line}, f AS (SELECT qty, price, disc, tax, qty * 1.0 AS qty_again, (disc * 100 > 5)::DOUBLE AS high, (disc > 0.05)::DOUBLE AS high_too FROM line WHERE train)
SELECT * FROM (SELECT 'qty_again' AS feature, 'qty' AS same_as WHERE (SELECT bool_and(qty = qty_again) FROM f)
UNION ALL SELECT 'price', 'qty' WHERE (SELECT bool_and(qty = price) FROM f) UNION ALL SELECT 'tax', 'disc' WHERE (SELECT bool_and(tax = disc) FROM f))""")
def prep_duplicate_columns(spark: SparkSession, d: str) -> DataFrame:
    df = line_frame(spark, d).df.where("train").withColumn("qty_again", F.col("qty") * 1.0)
    pairs = prep.duplicate_columns(df, ["qty", "price", "disc", "tax", "qty_again"], ["rid"])
    return spark.createDataFrame(pairs, "feature string, same_as string")


@query("""WITH {frame:doc} SELECT doc_id, label, ((row_number() OVER (PARTITION BY label ORDER BY {u:concat_ws('|', 42, 'fold', doc_id)}, doc_id) - 1) % 3)::INTEGER AS fold FROM doc""")
def prep_stratified_folds(spark: SparkSession, d: str) -> DataFrame:
    return prep.stratified_folds(documents_frame(spark, d).df, "label", "doc_id").select("doc_id", "label", "fold")


@query("""SELECT train, count(*) AS n, max(o_orderkey) AS last, min(o_orderkey) AS first FROM (
  SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) <= floor(0.7 * (SELECT count(*) FROM orders)) AS train FROM orders) GROUP BY 1""")
def prep_sequential_split(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "orders").select("o_orderkey", F.unix_date(F.col("o_orderdate").cast("date")).cast("long").alias("day"))
    df = prep.sequential_split(df, ["day", "o_orderkey"])
    return df.groupBy("train").agg(F.count(F.lit(1)).alias("n"), F.max("o_orderkey").alias("last"), F.min("o_orderkey").alias("first"))


@query("WITH {frame:cust} SELECT name AS feature, count(*) FILTER (WHERE v IS NULL) AS n_null, count(DISTINCT v) AS n_distinct, round(count(*) FILTER (WHERE v IS NULL) / count(*), 6) AS null_share FROM (SELECT bal, n_orders, ev_n FROM cust) UNPIVOT INCLUDE NULLS (v FOR name IN (bal, n_orders, ev_n)) GROUP BY 1")
def prep_null_profile(spark: SparkSession, d: str) -> DataFrame:
    out = prep.null_profile(customer_frame(spark, d).df, ["bal", "n_orders", "ev_n"])
    return out.withColumn("null_share", r6("null_share"))


@query("WITH {frame:cust} SELECT 'ev_value' AS feature FROM cust HAVING avg((ev_value IS NULL)::INTEGER) > 0.85 UNION ALL SELECT 'ev_n' FROM cust HAVING avg((ev_n IS NULL)::INTEGER) > 0.85 UNION ALL SELECT 'spend' FROM cust HAVING avg((spend IS NULL)::INTEGER) > 0.85 UNION ALL SELECT 'bal' FROM cust HAVING avg((bal IS NULL)::INTEGER) > 0.85")
def prep_sparse_columns(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(c,) for c in prep.sparse_columns(customer_frame(spark, d).df, ["bal", "spend", "ev_value", "ev_n"])], "feature string")


@query("SELECT part, count(*) AS n, sum(key)::BIGINT AS keys FROM (SELECT 0 AS part, c_custkey AS key FROM customer UNION ALL SELECT 1, s_suppkey FROM supplier UNION ALL SELECT 2, p_partkey FROM part) GROUP BY 1")
def prep_ordered_concat(spark: SparkSession, d: str) -> DataFrame:
    parts = [table(spark, d, t).select(F.col(k).alias("key")) for t, k in (("customer", "c_custkey"), ("supplier", "s_suppkey"), ("part", "p_partkey"))]
    return prep.concat_ordered(parts).groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("key").alias("keys"))


@query("""SELECT 0 AS ordinal, 'all rows' AS step, count(*) AS rows FROM orders UNION ALL SELECT 1, 'finished', count(*) FROM orders WHERE o_orderstatus = 'F'
UNION ALL SELECT 2, 'priority known', count(*) FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority IS NOT NULL
UNION ALL SELECT 3, 'not low', count(*) FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority IS NOT NULL AND o_orderpriority NOT IN ('5-LOW', '4-NOT SPECIFIED')""")
def prep_filter_steps(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("o_orderpriority")
    return prep.filter_steps(table(spark, d, "orders"), {"finished": F.col("o_orderstatus") == "F", "priority known": c.isNotNull(), "not low": ~c.isin("5-LOW", "4-NOT SPECIFIED")})[1]


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(count(*) / (SELECT count(*) FROM orders), 6) AS share FROM orders GROUP BY 1, 2")
def prep_value_shares(spark: SparkSession, d: str) -> DataFrame:
    return prep.value_shares(table(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"]).withColumn("share", r6("share"))


@query("WITH {frame:line}, m AS (SELECT avg(qty) a, stddev_pop(qty) s, avg(tax) b, stddev_pop(tax) t FROM line WHERE train) SELECT l_returnflag, round(avg((qty - a) / s), 6) + 0.0 AS qty, round(stddev_pop((tax - b) / t), 6) AS tax_sd FROM line, m GROUP BY 1")
def prep_standardise(spark: SparkSession, d: str) -> DataFrame:
    df = prep.standardise(line_frame(spark, d).df, ["qty", "tax"], F.col("train"))
    return df.groupBy("l_returnflag").agg(r6(F.avg("qty")).alias("qty"), r6(F.stddev_pop("tax")).alias("tax_sd"))


@query("SELECT side, count(*) AS n, sum(key)::BIGINT AS keys FROM (SELECT 'left' AS side, key FROM (SELECT o_custkey % 7 AS key FROM orders EXCEPT ALL SELECT c_custkey % 7 FROM customer) UNION ALL SELECT 'right', key FROM (SELECT c_custkey % 7 AS key FROM customer EXCEPT ALL SELECT o_custkey % 7 FROM orders)) GROUP BY 1")
def prep_symmetric_difference(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "orders").select((F.col("o_custkey") % 7).alias("key"))
    b = table(spark, d, "customer").select((F.col("c_custkey") % 7).alias("key"))
    return prep.symmetric_difference(a, b).groupBy("side").agg(F.count(F.lit(1)).alias("n"), F.sum("key").alias("keys"))


@query("WITH {frame:doc}, f AS (SELECT label, (n_dig > 0)::DOUBLE AS has_digits, (n_nl > 5)::DOUBLE AS many_lines, (lang = 'en')::DOUBLE AS english FROM doc) SELECT name AS feature, round(avg(v), 6) AS prevalence, round(avg(CASE WHEN label = 1 THEN v END), 6) AS mean_positive, round(avg(CASE WHEN label = 0 THEN v END), 6) AS mean_negative FROM f UNPIVOT (v FOR name IN (has_digits, many_lines, english)) GROUP BY 1")
def prep_class_means(spark: SparkSession, d: str) -> DataFrame:
    df = documents_frame(spark, d).df
    df = df.select("label", (F.col("n_dig") > 0).cast("int").alias("has_digits"), (F.col("n_nl") > 5).cast("int").alias("many_lines"), (F.col("lang") == "en").cast("int").alias("english"))
    out = prep.class_means(df, ["has_digits", "many_lines", "english"], "label")
    return out.select("feature", *[r6(c).alias(c) for c in out.columns[1:]])


@query("SELECT count(*) AS n, count(DISTINCT (l_orderkey, l_linenumber)) AS n_keys, count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS n_repeated FROM lineitem")
def prep_duplicate_count(spark: SparkSession, d: str) -> DataFrame:
    df = projected(table(spark, d, "lineitem"), ["L_ORDERKEY", "L_LINENUMBER"])
    keys = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("k"))
    return keys.agg(F.sum("k").alias("n"), F.count(F.lit(1)).alias("n_keys"), (F.sum("k") - F.count(F.lit(1))).alias("n_repeated"))


@query("WITH {frame:doc} SELECT bool_and((n_dig > 0) = (has = 1)) AS redundant, bool_and((n_nl > 0) = (has = 1)) AS other FROM (SELECT *, (n_dig > 0)::INTEGER AS has FROM doc) s")
def prep_redundant_flag(spark: SparkSession, d: str) -> DataFrame:
    df = documents_frame(spark, d).df.withColumn("has", (F.col("n_dig") > 0).cast("int"))
    return spark.createDataFrame([(prep.redundant_flag(df, "has", "n_dig"), prep.redundant_flag(df, "has", "n_nl"))], "redundant boolean, other boolean")


@query("SELECT o_orderstatus, coalesce(o_clerk, 'Missing') AS clerk, sum(priority) AS priority FROM (SELECT o_orderstatus, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderpriority END AS o_clerk, substr(o_orderpriority, 1, 1)::DOUBLE AS priority FROM orders) GROUP BY 1, 2")
def prep_null_category(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("o_orderpriority")
    df = table(spark, d, "orders").select("o_orderstatus", F.when(F.col("o_orderkey") % 3 != 0, c).alias("clerk"), F.substring(c, 1, 1).alias("priority"))
    df = prep.to_numeric(prep.null_category(df, ["clerk"]), ["priority"])
    return df.groupBy("o_orderstatus", "clerk").agg(F.sum("priority").alias("priority"))


@query("SELECT (l_tax <> 0)::INTEGER AS l_tax, (l_linenumber <> 0)::INTEGER AS l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2")
def prep_nonzero_flags(spark: SparkSession, d: str) -> DataFrame:
    df = prep.nonzero_flags(table(spark, d, "lineitem").select("l_tax", "l_linenumber"), ["l_tax", "l_linenumber"])
    return df.groupBy("l_tax", "l_linenumber").agg(F.count(F.lit(1)).alias("n"))


@query("WITH {frame:doc} SELECT doc_id, n_sp + n_nl + n_dig AS n_marks FROM doc")
def prep_row_sum(spark: SparkSession, d: str) -> DataFrame:
    return prep.row_sum(documents_frame(spark, d).df, "n_marks", ["n_sp", "n_nl", "n_dig"]).select("doc_id", "n_marks")


@query("SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '5-LOW') GROUP BY 1")
def prep_exclude_codes(spark: SparkSession, d: str) -> DataFrame:
    df = prep.exclude_codes(table(spark, d, "orders"), "o_orderpriority", ["1-URGENT", "5-LOW"])
    return df.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT (n_name IN ('FRANCE', 'GERMANY', 'NATION_1', 'NATION_2'))::INTEGER AS inside, (n_regionkey IN (1, 3))::INTEGER AS region, count(*) AS n FROM nation GROUP BY 1, 2")
def prep_member_flag(spark: SparkSession, d: str) -> DataFrame:
    df = prep.member_flag(table(spark, d, "nation"), "inside", "n_name", ["FRANCE", "GERMANY", "NATION_1", "NATION_2"])
    return prep.member_flag(df, "region", "n_regionkey", [1, 3]).groupBy("inside", "region").agg(F.count(F.lit(1)).alias("n"))


@query("WITH {frame:cust} SELECT count(*) AS n, round(sum(spend), 4) AS spend FROM cust WHERE ev_value IS NOT NULL AND spend IS NOT NULL")
def prep_complete_rows(spark: SparkSession, d: str) -> DataFrame:
    df = prep.complete_rows(customer_frame(spark, d).df, ["ev_value", "spend"])
    return df.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("spend"), 4).alias("spend"))


@query("SELECT CASE o_orderkey % 5 WHEN 0 THEN 'test' WHEN 1 THEN 'validation' ELSE 'train' END AS part, count(*) AS n, sum(o_orderkey)::BIGINT AS keys FROM orders GROUP BY 1")
def prep_official_split(spark: SparkSession, d: str) -> DataFrame:
    at = F.col("o_orderkey") % 5
    df = table(spark, d, "orders").select("o_orderkey", F.when(at == 0, "test").when(at == 1, "validation").otherwise("train").alias("split"))
    parts = prep.official_split(df, "split", ["train", "validation", "test"])
    sums = [p.agg(F.lit(n).alias("part"), F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys")) for n, p in parts.items()]
    return sums[0].unionByName(sums[1]).unionByName(sums[2])
