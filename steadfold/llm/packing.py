"""Best-fit decreasing packing of token sequences into fixed windows.

Lengths are whole numbers up to the window, so what best-fit decreasing does depends on the number of pieces of each
length alone. A histogram of at most `window` rows goes to the driver; a segment tree indexed by remaining capacity
finds the tightest open window, and equal steps are taken together. The resulting plan is a table of ranges, as
short for 10^11 pieces as for 10^5; every piece then finds its window by its ordinal among pieces of its length.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tokenizers
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .byte_bpe import byte_letters
from .recent import MARKS, Recent, groups
from .shared import stash


class OpenWindows:
    """A segment tree over capacities 0..window; a leaf counts the ranges of open windows with that much left."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.ranges: dict[int, list[tuple[int, int]]] = {}

    def _change(self, capacity: int, by: int) -> None:
        at = self.leaves + capacity
        while at:
            self.count[at] += by
            at >>= 1

    def push(self, capacity: int, first: int, n: int) -> None:
        if capacity and n:
            self.ranges.setdefault(capacity, []).append((first, n))
            self._change(capacity, 1)

    def pop(self, capacity: int) -> tuple[int, int]:
        self._change(capacity, -1)
        return self.ranges[capacity].pop()

    def tightest(self, least: int) -> int | None:
        """The smallest capacity of an open window that is least or more."""
        at = self.leaves + least
        if self.count[at]:
            return least
        while at > 1 and (at & 1 or not self.count[at + 1]):  # up, until a right neighbour holds some
            at >>= 1
        if at <= 1:
            return None
        at += 1
        while at < self.leaves:
            at = 2 * at if self.count[2 * at] else 2 * at + 1
        return at - self.leaves


def plan(lengths: dict[int, int], window: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first ordinal, pieces, first sequence, pieces in each sequence, offset of the first in each)."""
    tree, rows, sequences = OpenWindows(window), [], 0
    for length in sorted(lengths, reverse=True):
        done, left = 0, lengths[length]
        while left:
            capacity = tree.tightest(length)
            if capacity is None:
                capacity = window
                each = window // length
                first, n = sequences, -(-left // each)
                sequences += n
            else:
                first, n = tree.pop(capacity)
                each = capacity // length
            whole = min(n, left // each)  # windows that take as many pieces as fit, one after the other
            if whole:
                rows.append((length, done, whole * each, first, each, window - capacity))
                tree.push(capacity - each * length, first, whole)
            done, left = done + whole * each, left - whole * each
            if whole < n and 0 < left < each:  # the last window takes the rest
                rows.append((length, done, left, first + whole, left, window - capacity))
                tree.push(capacity - left * length, first + whole, 1)
                done, left, whole = done + left, 0, whole + 1
            tree.push(capacity, first + whole, n - whole)
    return rows


class WordTokenizer:
    """A word-level-split tokenizer file. Words between blanks are tokenized once and remembered: the file's rules
    drop white space and never join or change text across it."""

    #: Stems (words without a mark at the end, in one case) that are remembered at most.
    STEMS = 300_000
    #: Words of a generation of those remembered.
    WORDS = 300_000

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are what runs side by side
        self.model = tokenizers.Tokenizer.from_file(path)
        self.model.encode_special_tokens = True
        self.marks = {m: self._ids(m) for m in MARKS}
        self.letters = dict(enumerate(byte_letters()))
        # Latin letters that the normalizer turns into one letter each: words of these alone are normalized by a table. None
        # of them joins with a neighbour, as only combining marks and parts of syllables do.
        each = {c: self.model.normalizer.normalize_str(chr(c)) for c in range(0x250) if chr(c).isalpha()}
        self.latin = {c: x for c, x in each.items() if len(x) == 1 and x.isalpha()}
        self.other_latin = frozenset(chr(c) for c in each if c not in self.latin)
        self.merge = self.model.model.tokenize
        # A word of letters is one match of the split pattern, and a mark after it another: such words can skip the
        # general path if the two agree on samples of them.
        self.stems: dict[str, bytes] = {}
        self.direct = all(self._word(w) == self._ids(w) and (self._word(w) or b"") + self.marks[m] == self._ids(w + m) for w in ("ab", "Édition", "größe", "日本", "ĳsselmeer") for m in MARKS)
        self.recent = Recent(self._words_to_ids, entries=self.WORDS)

    def _ids(self, text: str) -> bytes:
        return np.array(self.model.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _word(self, word: str) -> bytes | None:
        """The ids of letters alone, by the file's normalizer and merges, without the search for splits. None if the normalizer
        makes more than letters of them (a dotted capital I gives a letter and a combining dot): a mark after these may
        fall into one match with what is not a letter, so such a word must be split whole."""
        if word.isascii():
            word = word.lower()
        got = self.stems.get(word)
        if got is None:
            stem = word
            if not word.isascii():
                if max(word) < "\u0250" and self.other_latin.isdisjoint(word):
                    stem = word.translate(self.latin)
                elif not (stem := self.model.normalizer.normalize_str(word)).isalpha():
                    return None
                stem = stem.encode().decode("latin-1").translate(self.letters)
            got = struct.pack(f"<{len(t := self.merge(stem))}I", *[x.id for x in t])
            if len(self.stems) >= self.STEMS:
                self.stems.clear()
            if len(word) <= 64:
                self.stems[word] = got
        return got

    def _words_to_ids(self, words: list[str]) -> list[bytes]:
        if not self.direct:
            return [self._ids(w) for w in words]
        out: list[bytes | None] = []
        marks, one, whole = self.marks, self._word, []
        for word in words:
            mark = marks.get(word[-1:])
            stem = word[:-1] if mark else word
            ids = one(stem) if stem.isalpha() else None
            if ids is None:
                whole.append(len(out))
            out.append(ids + mark if mark and ids is not None else ids)
        for at, made in zip(whole, self.model.encode_batch_fast([words[i] for i in whole], add_special_tokens=False)):
            out[at] = struct.pack(f"<{len(made.ids)}I", *made.ids)
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of whole texts, as little-endian unsigned 32-bit integers."""
        return self.recent.joined([t.replace("\n", " ").split(" ") for t in texts])


@lru_cache(2)
def tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def token_pieces(docs: DataFrame, path: str, window: int, end_id: int, with_ids: bool, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Every document's ids and its end id, cut into full windows and a rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, end = tokenizer(path), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows = []
            encoded = (ids for texts in groups(x.as_py() for x in batch.column(1)) for ids in model.encode(texts))
            for doc, ids in zip(batch.column(0).to_pylist(), encoded):
                ids += end
                for at in range(0, len(ids), 4 * window):
                    part = ids[at : at + 4 * window]
                    rows.append((doc, at // 4, len(part) // 4, zlib.crc32(part), len(ids) // 4, *([part] if with_ids else [])))
            kinds = [pa.int64()] * 5 + [pa.binary()] * with_ids
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds], names)

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *(["ids"] if with_ids else [])]
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def place(pieces: DataFrame, window: int) -> DataFrame:
    """pieces with sequence_id and offset. Its lengths are 1..window; its rows must not change between two readings."""
    spark = pieces.sparkSession
    n_salts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [c for c, kind in pieces.dtypes if kind in ("bigint", "int") and c != "length"]
    # A length may be very common: its pieces are numbered by salts, and the salts' counts put in a row.
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64(*order), F.lit(n_salts)))
    counts = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    lengths = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    numbered = salted.withColumn("ordinal", F.row_number().over(Window.partitionBy("length", "salt").orderBy(*order)).cast("long") - 1)
    numbered = numbered.join(starts.hint("merge"), ["length", "salt"]).withColumn("ordinal", F.col("ordinal") + F.col("before")).drop("salt", "before")
    rows = np.array(sorted(plan(lengths, window)), np.int64).reshape(-1, 6)
    table = spark.sparkContext.broadcast(rows)
    names = numbered.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = table.value
        keys = rows[:, 0] << 48 | rows[:, 1]
        for batch in batches:
            length, ordinal = (batch.column(names.index(c)).to_numpy() for c in ("length", "ordinal"))
            _, first, _, sequence, each, offset = rows[np.searchsorted(keys, length << 48 | ordinal, "right") - 1].T
            at = ordinal - first
            made = [pa.array(sequence + at // each), pa.array(offset + at % each * length)]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i, c in enumerate(names) if c != "ordinal"], *made], [*[c for c in names if c != "ordinal"], "sequence_id", "offset"])

    kept = ", ".join(f"`{c}` {kind}" for c, kind in numbered.dtypes if c != "ordinal")
    return numbered.mapInArrow(run, f"{kept}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, window: int = 4096, end_id: int = 2, with_ids: bool = True, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if asked for, ids
    (little-endian unsigned 32-bit integers).

    A document is cut into full windows, which fill a sequence each, and a rest; rests are packed best-fit decreasing.
    A sequence is padded to the window by its reader, unless what it holds is a power of two. A null or empty text is
    one token, the end id. Repeated rows are packed as often as they come; pieces alike in every column are
    interchangeable. No documents make no sequences.
    """
    pieces = stash(token_pieces(docs, path, window, end_id, with_ids, text_col, id_col), "pieces")
    return place(pieces, window).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if with_ids else []))
