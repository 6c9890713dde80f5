"""Queries of schema inference."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import r6
from ..operators import availability, prep, schema
from ..plans.frames import customer_frame, documents_frame, line_frame, mixed_frame
from ..sources.tables import table
from .registry import query

LINE_FLAGS = ["rf_A", "rf_N", "rf_R", "ls_F", "ls_O"]
LINE_FLAGS_SQL = "fl AS (SELECT *, (l_returnflag = 'A')::INTEGER AS rf_A, (l_returnflag = 'N')::INTEGER AS rf_N, (l_returnflag = 'R')::INTEGER AS rf_R, (l_linestatus = 'F')::INTEGER AS ls_F, (l_linestatus = 'O')::INTEGER AS ls_O FROM line)"


def flagged_lines(spark: SparkSession, d: str) -> DataFrame:
    flag = lambda c, v: (F.col(c) == v).cast("int")
    return line_frame(spark, d).df.withColumns({"rf_A": flag("l_returnflag", "A"), "rf_N": flag("l_returnflag", "N"), "rf_R": flag("l_returnflag", "R"), "ls_F": flag("l_linestatus", "F"), "ls_O": flag("l_linestatus", "O")})


def imputed_customers(spark: SparkSession, d: str) -> DataFrame:
    df = customer_frame(spark, d).df
    columns = ["ev_value", "ev_n", "spend"]
    return prep.impute_median(df.withColumn("ev_value:missing", F.col("ev_value").isNull().cast("int")), columns, F.col("train"))


CUST_SQL = """{frame:cust}, m AS (SELECT quantile_cont(ev_value, 0.5) AS v, quantile_cont(ev_n, 0.5) AS n, quantile_cont(spend, 0.5) AS s FROM cust WHERE train),
imp AS (SELECT train, c_custkey, label, bal, coalesce(ev_value, v) AS ev_value, coalesce(ev_n, n) AS ev_n, coalesce(spend, s) AS spend, (ev_value IS NULL)::INTEGER AS miss FROM cust, m)"""


@query("WITH {frame:line}, " + LINE_FLAGS_SQL + """, l AS (SELECT name AS feature, v FROM (SELECT qty, disc, rf_A::DOUBLE AS rf_A, (rf_N + 2)::DOUBLE AS two, 1.0::DOUBLE AS one FROM fl WHERE train) UNPIVOT (v FOR name IN (qty, disc, rf_A, two, one)))
SELECT feature, CASE WHEN count(DISTINCT v) = 1 THEN 'constant' WHEN count(DISTINCT v) > 2 THEN 'continuous' WHEN min(v) = 0 AND max(v) = 1 THEN 'binary' ELSE 'other' END AS kind, min(v) AS low, max(v) AS high,
  CASE WHEN count(DISTINCT v) = 2 AND min(v) = 0 AND max(v) = 1 THEN round(avg(v), 6) END AS share FROM l GROUP BY 1""")
def schema_types(spark: SparkSession, d: str) -> DataFrame:
    df = flagged_lines(spark, d).where("train").withColumns({"two": F.col("rf_N") + 2, "one": F.lit(1.0)})
    return schema.column_types(df, ["qty", "disc", "rf_A", "two", "one"]).withColumn("share", r6("share"))


@query("WITH {frame:line}, " + LINE_FLAGS_SQL + """ SELECT * FROM (
SELECT split_part(name, '_', 1) AS prefix, name AS feature, round(avg(v), 6) AS share, 0.0::DOUBLE AS none_share FROM (SELECT rf_A, rf_N, rf_R, ls_F, ls_O FROM fl WHERE train) UNPIVOT (v FOR name IN (rf_A, rf_N, rf_R, ls_F, ls_O)) GROUP BY 1, 2)""")
def schema_onehot_groups(spark: SparkSession, d: str) -> DataFrame:
    df = flagged_lines(spark, d).where("train").withColumns({"is_cheap": (F.col("price") < 50000).cast("int"), "is_many": (F.col("qty") > 10).cast("int")})
    out = schema.onehot_groups(df, [*LINE_FLAGS, "is_cheap", "is_many"])
    return out.select("prefix", "feature", r6("share").alias("share"), r6("none_share").alias("none_share"))


@query("WITH " + CUST_SQL + " SELECT 'ev_value:missing' AS flag, 'ev_value' AS feature, 1 AS level, round(min(ev_value), 6) AS fill FROM imp WHERE train AND miss = 1")
def schema_availability_named(spark: SparkSession, d: str) -> DataFrame:
    df = imputed_customers(spark, d).where("train")
    names = ["bal", "spend", "ev_value", "ev_n", "ev_value:missing"]
    return availability.availability_named(df, names, ["ev_value:missing"]).withColumn("fill", r6("fill"))


@query("WITH " + CUST_SQL + """, l AS (SELECT miss AS level, name AS feature, v FROM (SELECT miss, bal, spend, ev_value, ev_n FROM imp WHERE train) UNPIVOT (v FOR name IN (bal, spend, ev_value, ev_n))),
s AS (SELECT level, feature, count(*) AS rows, min(v) AS fill FROM l GROUP BY 1, 2 HAVING min(v) = max(v)),
o AS (SELECT s.*, count(*) AS off_rows, avg((l.v = s.fill)::INTEGER) AS off_share FROM s JOIN l ON l.feature = s.feature AND l.level <> s.level GROUP BY ALL)
SELECT 'ev_value:missing' AS flag, feature, level, round(fill, 6) AS fill, rows AS off_level_rows, 'share' AS rule FROM o WHERE rows >= 10 AND off_rows >= 10 AND off_share <= 0.05""")
def schema_availability_statistical(spark: SparkSession, d: str) -> DataFrame:
    df = imputed_customers(spark, d).where("train")
    return availability.availability_statistical(df, ["ev_value:missing"], ["bal", "spend", "ev_value", "ev_n"]).withColumn("fill", r6("fill"))


@query("WITH {frame:line}, " + LINE_FLAGS_SQL + """, p AS (SELECT * FROM (VALUES ('ls_F','ls_O'),('rf_A','rf_N'),('rf_A','rf_R'),('rf_N','rf_R'),('ls_F','rf_A'),('ls_F','rf_N'),('ls_F','rf_R'),('ls_O','rf_A'),('ls_O','rf_N'),('ls_O','rf_R')) t(a, b)),
l AS (SELECT rid, name, v FROM (SELECT rid, rf_A, rf_N, rf_R, ls_F, ls_O FROM fl WHERE train) UNPIVOT (v FOR name IN (rf_A, rf_N, rf_R, ls_F, ls_O))),
n AS (SELECT p.a, p.b, x.v AS value_a, y.v AS value_b, count(*) AS k FROM p JOIN l x ON x.name = a JOIN l y ON y.name = b AND y.rid = x.rid GROUP BY ALL),
c AS (SELECT a, b, x.v AS value_a, y.v AS value_b, x.k::DOUBLE * y.k / (SELECT count(*) FROM fl WHERE train) AS expected FROM p JOIN (SELECT name, v, count(*) AS k FROM l GROUP BY ALL) x ON x.name = a JOIN (SELECT name, v, count(*) AS k FROM l GROUP BY ALL) y ON y.name = b)
SELECT c.a, c.b, c.value_a, c.value_b, round(expected, 4) AS expected FROM c LEFT JOIN n USING (a, b, value_a, value_b) WHERE coalesce(k, 0) = 0 AND expected >= 5""")
def schema_unseen_pairs(spark: SparkSession, d: str) -> DataFrame:
    out = availability.unseen_combinations(flagged_lines(spark, d).where("train"), LINE_FLAGS)
    return out.withColumn("expected", F.round("expected", 4))


@query("WITH {frame:line}, " + LINE_FLAGS_SQL + """ SELECT (SELECT count(*) FROM fl WHERE train) AS n_rows, 4::BIGINT AS n_continuous, 5::BIGINT AS n_binary, 0::BIGINT AS n_constant, 2::BIGINT AS n_groups,
(SELECT count(*) FROM (SELECT avg(v) AS s FROM (SELECT rf_A, rf_N, rf_R, ls_F, ls_O FROM fl WHERE train) UNPIVOT (v FOR name IN (rf_A, rf_N, rf_R, ls_F, ls_O)) GROUP BY name) WHERE s < 0.5) AS n_under_recording""")
def schema_summary(spark: SparkSession, d: str) -> DataFrame:
    df = flagged_lines(spark, d).where("train")
    names = ["qty", "price", "disc", "tax", *LINE_FLAGS]
    kinds = schema.column_types(df, names)
    groups = schema.onehot_groups(df, LINE_FLAGS).select(F.count_distinct("prefix").alias("n_groups"))
    of = lambda k: F.count_if(F.col("kind") == k)
    counts = kinds.agg(of("continuous").alias("n_continuous"), of("binary").alias("n_binary"), of("constant").alias("n_constant"), F.count_if(F.col("share") < 0.5).alias("n_under_recording"))
    return df.agg(F.count(F.lit(1)).alias("n_rows")).crossJoin(counts).crossJoin(groups)


@query("WITH e AS (SELECT vec_id, i, embedding[i]::DOUBLE AS v FROM embeddings, range(1, 65) r(i)) SELECT 'e' || (a.i - 1) AS a, 'e' || (b.i - 1) AS b, round(covar_pop(a.v, b.v) / (stddev_pop(a.v) * stddev_pop(b.v)), 6) + 0.0 AS corr FROM e a JOIN e b ON a.vec_id = b.vec_id AND a.i < b.i GROUP BY a.i, b.i", also="gram_corr_matrix_whole")
def gram_corr_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Correlations of all components of the embeddings."""
    rows = table(spark, d, "embeddings")
    names = [f"e{i}" for i in range(rows.agg(F.max(F.size("embedding"))).first()[0] or 0)]
    df = rows.select(*[F.get("embedding", i).cast("double").alias(n) for i, n in enumerate(names)])
    return schema.correlations(df, names).withColumn("corr", r6("corr"))


@query("WITH {frame:line}, " + LINE_FLAGS_SQL + """, l AS (SELECT rid, name, v FROM (SELECT rid, rf_A, rf_N, rf_R, ls_F, ls_O FROM fl) UNPIVOT (v FOR name IN (rf_A, rf_N, rf_R, ls_F, ls_O)))
SELECT a.name AS a, b.name AS b, count(*) AS n, sum(a.v)::BIGINT AS n_a, sum(b.v)::BIGINT AS n_b, sum(a.v * b.v)::BIGINT AS n_ab FROM l a JOIN l b ON a.rid = b.rid AND a.name < b.name GROUP BY 1, 2""")
def schema_pair_counts(spark: SparkSession, d: str) -> DataFrame:
    return availability.pair_counts(flagged_lines(spark, d), LINE_FLAGS)


@query("""WITH {frame:doc}, l AS (SELECT doc_id, train, name, v FROM (SELECT doc_id, train, n_chars, n_sp, n_nl, n_dig, avg_w, (lang = 'en')::DOUBLE AS english, (n_dig > 0)::DOUBLE AS digits FROM doc) UNPIVOT (v FOR name IN (n_chars, n_sp, n_nl, n_dig, avg_w, english, digits))),
f AS (SELECT train, name, least(sum(v), count(*) - sum(v)) AS fewest FROM l WHERE name IN ('english', 'digits') GROUP BY 1, 2),
c AS (SELECT a.name AS a, b.name AS b, covar_pop(a.v, b.v) / nullif(stddev_pop(a.v) * stddev_pop(b.v), 0) AS corr FROM l a JOIN l b ON a.doc_id = b.doc_id AND a.name < b.name WHERE a.train GROUP BY 1, 2)
SELECT a, b, round(corr, 6) AS corr, CASE WHEN a IN ('english', 'digits') OR b IN ('english', 'digits') THEN 'mixed' ELSE 'continuous' END AS kind FROM c
WHERE abs(corr) >= 0.3 AND abs(corr) < 0.95 AND NOT (a = 'digits' AND b = 'english')
AND NOT EXISTS (SELECT 1 FROM f WHERE f.name IN (a, b) AND fewest < CASE WHEN f.train THEN 20 ELSE 5 END)""")
def pair_selection(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.reweight import pair_selection as select_pairs

    frame = documents_frame(spark, d)
    df = frame.df.withColumns({"english": (F.col("lang") == "en").cast("int"), "digits": (F.col("n_dig") > 0).cast("int")})
    pairs, _ = select_pairs(df.where("train"), df.where("NOT train"), frame.features, ["english", "digits"])
    return pairs.select("a", "b", r6("corr").alias("corr"), "kind")


@query("SELECT unnest(['ev_n', 'ev_value']) AS feature WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events))")
def schema_null_columns(spark: SparkSession, d: str) -> DataFrame:
    """Columns that inference would refuse: customers without events have no numbers of them."""
    found = schema.null_columns(customer_frame(spark, d).df, ["bal", "ev_value", "ev_n"])
    return spark.createDataFrame([(c,) for c in found], "feature string")


@query("WITH {frame:line}, " + LINE_FLAGS_SQL + """, l AS (SELECT name AS feature, v FROM (SELECT qty, disc, rf_A::DOUBLE AS rf_A, (rf_N + 2)::DOUBLE AS two, 1.0::DOUBLE AS one, 0.0::DOUBLE AS zero FROM fl WHERE train) UNPIVOT (v FOR name IN (qty, disc, rf_A, two, one, zero)))
SELECT feature, CASE WHEN count(DISTINCT v) > 2 THEN 'continuous' WHEN bool_and(v IN (0, 1)) THEN 'dummy' ELSE 'neither' END AS kind FROM l GROUP BY 1""")
def schema_legacy_types(spark: SparkSession, d: str) -> DataFrame:
    df = flagged_lines(spark, d).where("train").withColumns({"two": F.col("rf_N") + 2, "one": F.lit(1.0), "zero": F.lit(0.0)})
    return schema.legacy_types(df, ["qty", "disc", "rf_A", "two", "one", "zero"])


#: Everything that a profile of the documents' mixed frame says, by SQL: facts(name, item).
FACTS_SQL = r"""{frame:doc}, fillv AS (SELECT coalesce(quantile_cont(n_dig, 0.5), 0) AS fill FROM doc WHERE train AND n_dig > 0),
mxa AS MATERIALIZED (SELECT doc_id, train, n_chars, n_sp, n_nl, avg_w, (lang = 'de')::DOUBLE AS lang_de, (lang = 'en')::DOUBLE AS lang_en, (lang = 'es')::DOUBLE AS lang_es, (lang = 'fr')::DOUBLE AS lang_fr,
  (n_chars > 300 * (n_nl + 1))::DOUBLE AS long_lines, (n_dig = 0)::DOUBLE AS "dig:missing", CASE WHEN n_dig = 0 THEN fill ELSE n_dig END AS dig FROM doc, fillv),
mx AS (SELECT * FROM mxa WHERE train),
l AS MATERIALIZED (SELECT doc_id, name, v FROM mx UNPIVOT (v FOR name IN (n_chars, n_sp, n_nl, avg_w, lang_de, lang_en, lang_es, lang_fr, long_lines, "dig:missing", dig))),
k AS MATERIALIZED (SELECT name, CASE WHEN min(v) = max(v) THEN 'constant' WHEN count(DISTINCT v) > 2 THEN 'continuous' WHEN min(v) = 0 AND max(v) = 1 THEN 'binary' ELSE 'other' END AS kind, min(v) AS low, max(v) AS high, avg(v) AS share,
  regexp_extract(name, '^(.+)[:_.][^:_.]*$', 1) AS stem, regexp_extract(name, '^(.+)([:_.])[^:_.]*$', 2) AS sep FROM l GROUP BY name),
fl AS MATERIALIZED (SELECT doc_id, name, v FROM l JOIN k USING (name) WHERE kind = 'binary'),
vals AS MATERIALIZED (SELECT doc_id, name, v FROM l JOIN k USING (name) WHERE kind = 'continuous'),
ends AS MATERIALIZED (SELECT f.name AS flag, f.v::INTEGER AS level, x.name AS value, count(*) AS n, min(x.v) AS fill FROM fl f JOIN vals x USING (doc_id) GROUP BY 1, 2, 3 HAVING min(x.v) = max(x.v)),
off AS MATERIALIZED (SELECT e.flag, e.level, e.value, e.n, e.fill, e.fill > k.low AND e.fill < k.high AS inside, count(*) AS off_n, avg((x.v = e.fill)::INTEGER) AS off_share
  FROM ends e JOIN fl f ON f.name = e.flag AND f.v <> e.level JOIN vals x ON x.doc_id = f.doc_id AND x.name = e.value JOIN k ON k.name = e.value GROUP BY ALL),
lone AS (SELECT min(name) AS flag, stem, sep FROM k WHERE kind = 'binary' AND stem <> '' GROUP BY stem, sep HAVING count(*) = 1),
asked AS (SELECT k.name AS value, flag, count(*) OVER (PARTITION BY k.name) AS rivals FROM k JOIN lone ON k.name = lone.stem OR (k.stem = lone.stem AND k.sep = lone.sep) WHERE kind = 'continuous'),
named AS MATERIALIZED (SELECT value, flag, rivals, level FROM asked LEFT JOIN (SELECT flag, value, min(level) AS level FROM ends GROUP BY 1, 2) USING (flag, value)),
settled AS MATERIALIZED (SELECT value, flag, level AS off FROM named WHERE rivals = 1 AND level IS NOT NULL AND level = (SELECT min(m.level) FROM named m WHERE m.flag = named.flag AND m.rivals = 1)),
sug AS MATERIALIZED (SELECT o.*, CASE WHEN off_share <= 0.05 THEN 'share' WHEN s.off IS NULL OR NOT inside THEN NULL WHEN n * ln(greatest(off_share, 1e-300)) <= ln(1e-6) THEN 'chance' ELSE 'near' END AS rule
  FROM off o LEFT JOIN (SELECT DISTINCT flag, off FROM settled) s USING (flag) WHERE n >= 10 AND off_n >= 10 AND (s.off IS NULL OR s.off = level) AND value NOT IN (SELECT value FROM settled)),
speak AS (SELECT *, dense_rank() OVER (PARTITION BY flag ORDER BY votes DESC, level) AS place FROM (SELECT *, count(*) OVER (PARTITION BY flag, level) AS votes FROM sug WHERE rule IN ('share', 'chance'))),
won AS MATERIALIZED (SELECT flag, level AS off, value, fill FROM (SELECT *, rank() OVER (PARTITION BY value ORDER BY n DESC) AS r FROM speak WHERE place = 1) WHERE r = 1),
pairs AS MATERIALIZED (SELECT flag, off, value, true AS by_name FROM settled UNION ALL SELECT flag, off, value, false FROM won),
doubts AS (SELECT flag, value FROM named WHERE (flag, value) NOT IN (SELECT (flag, value) FROM settled) UNION ALL SELECT min(flag), value FROM sug WHERE rule = 'near' AND value NOT IN (SELECT value FROM pairs) GROUP BY value),
pre AS (SELECT name, regexp_extract(name, '^(.+)_[^_]*$', 1) AS prefix FROM k WHERE kind = 'binary' AND name NOT IN (SELECT flag FROM pairs)),
grp AS MATERIALIZED (SELECT prefix FROM (SELECT prefix, doc_id, sum(v) AS s, count(*) AS m FROM pre JOIN l USING (name) WHERE prefix <> '' GROUP BY 1, 2) GROUP BY 1 HAVING max(s) <= 1 AND max(m) > 1),
free AS MATERIALIZED (SELECT name, share FROM k WHERE kind = 'binary' AND name NOT IN (SELECT flag FROM pairs) AND name NOT IN (SELECT name FROM pre JOIN grp USING (prefix))),
b2 AS (SELECT a.name AS a, b.name AS b, x::INTEGER AS x, y::INTEGER AS y, count(*) AS n, count(*) FILTER (WHERE a.v = x AND b.v = y) AS seen, count(*) FILTER (WHERE a.v = x)::DOUBLE * count(*) FILTER (WHERE b.v = y) / count(*) AS expected
  FROM fl a JOIN fl b ON a.doc_id = b.doc_id AND a.name < b.name, range(2) r(x), range(2) q(y) GROUP BY 1, 2, 3, 4),
facts(name, item) AS MATERIALIZED (SELECT 'inputs', name FROM k UNION ALL SELECT kind, name FROM k UNION ALL SELECT 'one_hot_groups', prefix FROM grp UNION ALL SELECT 'one_hot_levels', name FROM pre JOIN grp USING (prefix)
  UNION ALL SELECT DISTINCT 'availability_flags', flag FROM pairs UNION ALL SELECT DISTINCT 'values_with_flag', value FROM pairs
  UNION ALL SELECT CASE WHEN by_name THEN 'values_paired_by_name' ELSE 'values_paired_statistically' END, value || ' by ' || flag FROM pairs UNION ALL SELECT 'unresolved_availability', value || ' by ' || flag FROM doubts
  UNION ALL SELECT 'unseen_combinations', a || '=' || x || ', ' || b || '=' || y FROM b2 WHERE seen = 0 AND expected >= 5
  UNION ALL SELECT 'stand_alone_binary', name FROM free UNION ALL SELECT 'under_recording_inputs', name FROM free WHERE share < 0.5)"""


def _profile(spark: SparkSession, d: str) -> schema.TableProfile:
    frame = mixed_frame(spark, d)
    return schema.infer(frame.part(True).df, frame.features)


@query("WITH " + FACTS_SQL + " SELECT name, item FROM facts")
def schema_facts(spark: SparkSession, d: str) -> DataFrame:
    """Every list of the documents' inferred schema: types, groups, availability, combinations not seen, stand-alone flags."""
    return spark.createDataFrame(_profile(spark, d).facts(), "name string, item string")


@query("WITH " + FACTS_SQL + f" SELECT n.name, count(item) AS n FROM unnest({list(schema.COUNTS)}) n(name) LEFT JOIN facts USING (name) GROUP BY 1")
def schema_report(spark: SparkSession, d: str) -> DataFrame:
    """All counts of the inferred schema of documents."""
    return spark.createDataFrame(list(_profile(spark, d).counts().items()), "name string, n long")


@query("WITH " + FACTS_SQL + """, f(family, name) AS (VALUES ('noise', 'continuous'), ('redraw', 'stand_alone_binary'), ('redraw', 'one_hot_groups'), ('under_recording', 'under_recording_inputs'), ('masking', 'availability_flags'), ('median_masking', 'continuous'))
SELECT family, count(item) AS units FROM f LEFT JOIN facts USING (name) GROUP BY 1""")
def corrupt_units(spark: SparkSession, d: str) -> DataFrame:
    """What each family of corruptions could strike in the documents' schema."""
    return spark.createDataFrame(list(_profile(spark, d).units().items()), "family string, units long")
