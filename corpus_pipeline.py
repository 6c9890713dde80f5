"""From raw documents to packed training sequences: five stages, each an operator of steadfold.llm."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from steadfold.llm import kneser_ney
from steadfold.llm.line_dedup import dedup_lines
from steadfold.llm.near_dedup import near_duplicates
from steadfold.llm.packing import pack_documents
from steadfold.llm.secrets import scan_secrets
from steadfold.llm.shared import Sealed, stash, table


def _by_place(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs under names that no operator adds, and the new name of each column: extra columns may be called anything."""
    sealed = Sealed.of(docs)
    return sealed.frame, dict(zip(docs.columns, sealed.frame.columns))


def _columns(docs: DataFrame, at: dict[str, str], **changed: Column) -> list[Column]:
    return [changed.get(c, F.col(at[c])).alias(c) for c in docs.columns]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are as predictable as trusted text (labelled good and not toxic) of their language."""
    trusted = table(spark, sf_dir, "labels").where("quality = 1 AND coalesce(toxic, 0) = 0").select("doc_id")
    frame, at = _by_place(docs)
    model = kneser_ney.train(frame, trusted, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, id_col=at["doc_id"], text_col=at["text"], lang_col=at["lang"])
    return kneser_ney.score(frame, model, text_col=at["text"], lang_col=at["lang"]).where("kept").select(*_columns(docs, at))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that five or more of them share, but for one copy; n_chars follows the text."""
    frame, at = _by_place(docs)
    out = dedup_lines(frame, min_docs=5, min_chars=40, id_col=at["doc_id"], text_col=at["text"])
    return out.select(*_columns(docs, at, n_chars=F.char_length(at["text"]).cast("long")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, as operator 7 has them (words by four): the one of least id."""
    frame, at = _by_place(docs)
    return near_duplicates(frame, size=4, percent=80, id_col=at["doc_id"], text_col=at["text"]).where("kept").select(*_columns(docs, at))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with a mark in place of each secret; n_chars follows the text."""
    frame, at = _by_place(docs)
    out = scan_secrets(frame, with_text=True, carry=True, id_col=at["doc_id"], text_col=at["text"], source_col=at["source"])
    held = {c: f"in_{name}" for c, name in at.items()}
    return out.select(*_columns(docs, held, text=F.col("redacted"), n_chars=F.char_length("redacted").cast("long")))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where every piece of every document lies in the training sequences."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), window=4096, end_id=2, with_ids=False)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("secret_scan", secret_scan),
    ("packing", packing),
]

#: The classifier, the near duplicates, the learned secrets and the tokens are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
