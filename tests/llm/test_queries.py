"""Registered queries of the training-data operators, against SQL where there is any, and the pipeline."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from steadfold.llm.queries import ORACLE_SQL, QUERIES

from ..conftest import SF
from . import test_operators as ops


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    result = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(tuple(r[c] for c in names) for r in df.collect()) == sorted(result.fetchall())


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def by_id(spark, name):
    return {r.doc_id: r for r in QUERIES[name](spark, SF).collect()}


def sha(raw):
    return hashlib.sha256(raw).hexdigest()


def test_op2_against_the_textbook(spark, texts):
    got, enc = by_id(spark, "op2_quality_classifier"), ops.reference()
    labels = spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1 AND coalesce(toxic, 0) = 0")
    counted = [r.doc_id for r in labels.where(F.pmod(F.xxhash64("doc_id", F.lit("held out")), F.lit(5)) != 0).collect()]
    ids = {i: enc.encode_ordinary(t or "") for i, t in texts.items()}
    surprise = ops.brute_kneser_ney([ids[i] for i in counted if texts[i] is not None], 2, enc.n_vocab)
    for i, t in texts.items():
        want = surprise(ids[i]) if t else None
        assert got[i].entropy == (pytest.approx(sum(want) / len(want), abs=2e-6) if t else None) and (t or not got[i].kept)


def test_op4_against_the_library(spark, texts):
    got, enc = by_id(spark, "op4_byte_bpe"), ops.reference()
    for i, t in texts.items():
        ids = np.array(enc.encode_ordinary(t or ""), "<u4")
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), sha(ids.tobytes()), sha((t or "").encode()))


def test_op5_changes_what_is_personal_alone(spark, texts):
    got = by_id(spark, "op5_pii")
    shape = lambda t: re.sub(r"[0-9]", "9", re.sub(r"[a-z]", "a", re.sub(r"[A-Z]", "A", t or "")))
    assert len(got) == len(texts) and any(r.n_pii for r in got.values())
    for i, t in texts.items():
        assert (got[i].text == t) if not got[i].n_pii else got[i].n_ip or shape(got[i].text) == shape(t)
        assert got[i].n_pii == sum(got[i][f"n_{k}"] for k in ops.pii.MAKERS)


def test_op6_against_brute_force(spark, texts):
    got = by_id(spark, "op6_quality_rules")
    for i, t in texts.items():
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == ops.brute_counts(t) and not (r.kept and r.base_failed)


def test_op8_against_plain_patterns(spark, texts):
    got = by_id(spark, "op8_secret_scan")
    for i, t in texts.items():
        want = ops.plain_spans(t or "")
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert got[i].base_sha256 == sha(joined.encode()) and [got[i][f"n_{k}"] for k in ("assign", "access", "hex")] == [sum(x[0] == k for x in want) for k in ("assign", "access", "hex")]
        assert set(joined.split(",")) - {""} <= set(got[i].spans.split(","))


def test_op9_against_brute_force(spark, texts):
    got = QUERIES["op9_token_shards"](spark, SF).collect()
    _, want = ops.brute_shards(spark, list(texts.items()), 2048, 1)
    assert sorted(tuple(r[c] for c in ("sequence", "slot", "doc_id", "n_docs", "n_tokens", "ids_crc32")) for r in got) == want


def test_op10_against_the_library_and_best_fit(spark, texts):
    model = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    model.encode_special_tokens = True
    pieces, sequences = {}, {}
    for r in QUERIES["op10_packing"](spark, SF).collect():
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, t in texts.items():
        ids = np.array([*model.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        mine = sorted(pieces[i], key=lambda r: r.start)
        assert [r.start for r in mine] == [sum(x.length for x in mine[:k]) for k in range(len(mine))] and sum(r.length for r in mine) == len(ids) == mine[0].doc_tokens
        assert all(zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in mine)
    for s in sequences.values():
        s.sort()
        assert [a for a, _ in s] == [sum(n for _, n in s[:k]) for k in range(len(s))]
    assert sorted(4096 - sum(n for _, n in s) for s in sequences.values()) == ops.brute_bfd([r.length for x in pieces.values() for r in x], 4096)


@pytest.mark.parametrize("number", range(5))
def test_stages_on_odd_rows(spark, number):
    """Nulls, empty and long texts, repeated rows, extra columns with clashing names, and an empty table."""
    import corpus_pipeline as c

    rows = [(i, t, "en", f"src{i % 2}", len(t or "")) for i, t in enumerate([None, "", " ", ops.prose(random.Random(1), 80), "x " * 20_000, "token = abcdef123456"])]
    rows += [rows[3], (None, "no id", None, None, None), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df = df.select("*", *[F.lit("mine").alias(x) for x in ("kept", "entropy", "n_lines", "component_id", "redacted", "length", "c0", "id")])
    _, stage = c.STAGES[number]
    for some in (df, df.where("false")):
        out = stage(spark, some, SF)
        got = out.collect()
        assert len(got) == 0 if some is not df else len(got) > 0
        if number < 4:
            assert out.columns == df.columns and all(r["c0"] == "mine" for r in got)


def test_pipeline_stages(spark):
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    assert [n for n, _ in c.STAGES] == ["quality_classifier", "line_dedup", "near_dedup", "secret_scan", "packing"]
    for _, stage in c.STAGES[:-1]:
        docs = c.stash(stage(spark, docs, SF), "test")
        assert docs.columns == columns
    assert 0 < docs.count() < before
    assert docs.where("text rlike 'AKIA[A-Z0-9]{16}'").isEmpty()
    pieces = c.STAGES[-1][1](spark, docs, SF)
    assert pieces.select("doc_id").distinct().count() == docs.count()
