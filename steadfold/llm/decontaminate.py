"""Benchmark decontamination by Wu-Manber search: windows of benchmark words are looked for in whole documents, many at once."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import stash

#: What a byte of UTF-8 becomes: A-Z their small letters, digits, small letters and all beyond ASCII themselves,
#: anything else a space.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
END = 0  # between documents

#: Windows are searched in groups by their length in bytes, so that short ones do not take the long steps from the others.
GROUPS = ((1, 8), (8, 24), (24, 1 << 62))
LANE = 2048
SLICE_BYTES = 4 << 20
MIX = np.uint64(0x9E3779B97F4A7C15)

FOUND = "doc_id long, text string, n_words long, hits array<struct<first:long,last:long>>, items array<string>"


def flat_words(texts: list[bytes]) -> np.ndarray:
    """The texts' words, lower-cased, a space on either side of each, with END between texts."""
    raw = np.frombuffer(b" " + b" \x00 ".join(t.translate(LETTERS) for t in texts) + b" ", np.uint8)
    keep = raw != 32
    keep[1:] |= raw[:-1] != 32
    keep[0] = True
    return raw[keep]


@dataclass
class ShiftTables:
    """Wu-Manber tables for windows of m bytes or more, by blocks of `block` bytes.

    shift[h]: how far the search may go on from a place that a block of hash h ends at; blocks of one hash share the least.
    0 means that some window's first m bytes end with it: (h, the window's first bytes) then select those windows, and
    the text's own bytes are compared with them.
    """

    windows: list[bytes]
    numbers: list[int]
    m: int = field(init=False)
    block: int = field(init=False)

    def __post_init__(self) -> None:
        self.m = min(map(len, self.windows))
        self.block = min(8, max(2, self.m // 2))
        heads = np.frombuffer(b"".join(w[: self.m] for w in self.windows), np.uint8).reshape(len(self.windows), self.m)
        ends = np.arange(self.block, self.m + 1)
        blocks = np.zeros((len(self.windows), len(ends)), np.uint64)
        for b in range(self.block):
            blocks |= heads[:, ends - self.block + b].astype(np.uint64) << np.uint64(8 * b)
        self.mask = np.uint64((1 << 8 * self.block) - 1)
        self.bits = np.uint64(64 - min(24, max(12, int(blocks.size * 16).bit_length())))
        hashes = self.hash(blocks)
        self.shift = np.full(1 << int(64 - self.bits), min(self.m - self.block + 1, 65535), np.uint16)
        for i, end in enumerate(ends):  # later ends have lesser shifts
            self.shift[hashes[:, i]] = np.minimum(self.shift[hashes[:, i]], min(self.m - end, 65535))
        self.start_bytes = min(8, self.m)
        self.start_mask = np.uint64((1 << 8 * self.start_bytes) - 1)
        chosen: dict[int, dict[int, dict[bytes, int]]] = {}
        for w, number, h in zip(self.windows, self.numbers, hashes[:, -1].tolist()):
            key = self.key(np.uint64(h), np.frombuffer(w[: self.start_bytes].ljust(8, b"\0"), "<u8")[0])
            chosen.setdefault(int(key), {}).setdefault(len(w), {})[w] = number
        self.keys = np.array(sorted(chosen), np.uint64)
        self.chosen = [chosen[int(k)] for k in self.keys]

    def hash(self, blocks: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((blocks * MIX) >> self.bits).astype(np.int64)

    @staticmethod
    def key(h: np.ndarray, start: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (start ^ (h * MIX)) * MIX

    def find(self, text: np.ndarray) -> tuple[list[int], list[int]]:
        """(start, number) of all occurrences. The search stands at many places at a time, one in each lane of the text."""
        padded = np.concatenate([text, np.zeros(8, np.uint8)])
        eight = np.ndarray((len(text) + 1,), "<u8", padded, 0, (1,))
        place = np.arange(self.m - 1, len(text), LANE)
        end = np.minimum(place + LANE, len(text))
        at, of = [], []
        while len(place):
            h = self.hash(eight[place - self.block + 1] & self.mask)
            go = self.shift[h]
            stop = np.nonzero(go == 0)[0]
            if len(stop):
                at.append(place[stop] - self.m + 1)
                of.append(h[stop])
            place = place + np.maximum(go, 1)
            live = place < end
            if not live.all():
                place, end = place[live], end[live]
        if not at:
            return [], []
        start, h = np.concatenate(at), np.concatenate(of)
        key = self.key(h.astype(np.uint64), eight[start] & self.start_mask)
        which = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        real = self.keys[which] == key
        raw, starts, numbers = text.tobytes(), [], []
        for s, w in zip(start[real].tolist(), which[real].tolist()):
            for length, same in self.chosen[w].items():
                number = same.get(raw[s : s + length])
                if number is not None:
                    starts.append(s)
                    numbers.append(number)
        return starts, numbers


class WindowSearch:
    """All windows of one block of the benchmark, and the items that hold each."""

    def __init__(self, pieces: list[tuple[str, str]], size: int) -> None:
        holders: dict[bytes, set[str]] = {}
        for item, words in pieces:
            w = words.encode().split()
            for i in range(max(1, len(w) - size + 1)):
                holders.setdefault(b" " + b" ".join(w[i : i + size]) + b" ", set()).add(item)
        windows = list(holders)
        self.items = [sorted(holders[w]) for w in windows]
        self.n_words = np.array([w.count(b" ") - 1 for w in windows], np.int64)
        self.tables = []
        for low, high in GROUPS:
            mine = [i for i, w in enumerate(windows) if low <= len(w) < high]
            if mine:
                self.tables.append(ShiftTables([windows[i] for i in mine], mine))

    def search(self, texts: list[bytes]) -> Iterator[tuple[int, list[tuple[int, int]], list[str]]]:
        """For each text: its words, the stretches of words (first, last) that occurrences cover, and the items found."""
        flat = flat_words(texts)
        space = flat == 32
        begins = np.nonzero(space[:-1] & ~space[1:] & (flat[1:] != END))[0] + 1
        borders = np.concatenate([np.nonzero(flat == END)[0], [len(flat)]])
        words_to = np.searchsorted(begins, borders)
        starts, numbers = [], []
        for t in self.tables:
            s, n = t.find(flat)
            starts += s
            numbers += n
        start, number = np.array(starts, np.int64), np.array(numbers, np.int64)
        text = np.searchsorted(borders, start)
        order = np.lexsort((start, text))
        start, number, text = start[order], number[order], text[order]
        first = np.searchsorted(begins, start + 1) if len(start) else start
        last = first + self.n_words[number] - 1
        cuts = np.searchsorted(text, np.arange(len(texts) + 1))
        for i in range(len(texts)):
            base, mine = int(words_to[i - 1]) if i else 0, slice(cuts[i], cuts[i + 1])
            found = sorted({x for n in set(number[mine].tolist()) for x in self.items[n]})
            yield int(words_to[i]) - base, union(list(zip((first[mine] - base).tolist(), (last[mine] - base).tolist()))), found


def union(stretches: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping or touching stretches as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(stretches):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


_BUILT: dict[str, WindowSearch] = {}


def _search_for(name: str, block: Broadcast, size: int) -> WindowSearch:
    """The block's tables, built once by each worker: another block's take the place of the last one's."""
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = WindowSearch(block.value, size)
    return _BUILT[name]


def _pieces(benchmark: DataFrame, size: int, id_col: str, text_col: str, step: int = 4096) -> DataFrame:
    """(item, words): each item's words, in pieces that overlap so that every window is whole in one of them."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items, pieces = [], []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = text.encode().translate(LETTERS).split()
                for at in range(0, max(1, len(words) - size + 1), step):
                    if words:
                        items.append(item)
                        pieces.append(b" ".join(words[at : at + step + size - 1]).decode())
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(pieces, pa.string())], ["item", "words"])

    rows = benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("text")).where("item IS NOT NULL AND text IS NOT NULL")
    return rows.mapInArrow(cut, "item string, words string")


def _slices(texts: list[bytes]) -> Iterator[list[bytes]]:
    """The texts in runs of about SLICE_BYTES, so that no array is as long as a batch."""
    run, held = [], 0
    for t in texts:
        if run and held + len(t) > SLICE_BYTES:
            yield run
            run, held = [], 0
        run.append(t)
        held += len(t)
    if run:
        yield run


def _searched(rows: DataFrame, name: str, block: Broadcast, size: int, with_text: bool) -> DataFrame:
    hit = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = _search_for(name, block, size)
        for batch in batches:
            texts = [(t.as_py() or "").encode() for t in batch.column(1)]
            n_words, hits, items = [], [], []
            before = zip(batch.column(3), batch.column(4))
            for part in _slices(texts):
                for (n, spans, found), (old_spans, old_items) in zip(search.search(part), before):
                    if old_items.is_valid:
                        spans, found = union([*spans, *((h["first"], h["last"]) for h in old_spans.as_py())]), sorted({*found, *old_items.as_py()})
                    n_words.append(n)
                    hits.append([{"first": a, "last": b} for a, b in spans])
                    items.append(found)
            text = batch.column(1) if with_text else pa.nulls(len(texts), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), text, pa.array(n_words, pa.int64()), pa.array(hits, hit), pa.array(items, pa.list_(pa.string()))], ["doc_id", "text", "n_words", "hits", "items"])

    return rows.mapInArrow(run, FOUND)


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = 10, block_bytes: int = 2 << 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, n_words, hits (stretches of words, first and last, that benchmark windows cover), items (ids as strings, in
    order) and n_hit, one row for each row of docs, in any order.

    A window is `size` words in a row of an item, or all words of an item that has fewer. The windows of about block_bytes
    of the benchmark are out with the workers at a time: a larger benchmark means more passes over the documents, each
    written to the shared folder, and never more memory. A null text has no words; an item whose id or text is null, or
    that has no words, is in no document. Rows with one item id are one item. Repeated documents each give a row.
    Other columns take no part, whatever their names.
    """
    spark = docs.sparkSession
    pieces = stash(_pieces(benchmark, size, item_col, item_text_col), "benchmark_pieces")
    n_blocks = max(1, -(-(pieces.agg(F.sum(F.octet_length("words"))).first()[0] or 0) // block_bytes))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.lit(None).cast("long").alias("n_words"), F.lit(None).cast("array<struct<first:long,last:long>>").alias("hits"), F.lit(None).cast("array<string>").alias("items"))
    for b in range(n_blocks):
        held = [(r.item, r.words) for r in pieces.where(F.pmod(F.xxhash64("item", "words"), F.lit(n_blocks)) == b).toLocalIterator()]
        block = spark.sparkContext.broadcast(held)
        rows = _searched(rows, uuid.uuid4().hex, block, size, with_text=b < n_blocks - 1)
        if b < n_blocks - 1:
            rows = stash(rows, "searched")
            block.destroy()
    return rows.select("doc_id", "n_words", "hits", "items", n_hit(F.col("hits")).alias("n_hit"))


def n_hit(hits: Column) -> Column:
    return F.aggregate(hits, F.lit(0).cast("long"), lambda n, h: n + h["last"] - h["first"] + 1)
