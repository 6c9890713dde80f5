"""Training-order materialisation of token sequences as fixed-stride binary shards.

Texts become sequences of a fixed number of tokens. A keyed Feistel network over the smallest square domain that holds
all sequences, walked on until it lands below their number, gives each a global slot: a permutation that needs neither a
sort nor a table of the order. Slots are cut into shards by range; a shard is one file of records of one length, so the
sequence at any slot is found by arithmetic, and a reader that stopped at a slot goes on from there.
"""

from __future__ import annotations

import json
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .rank_tokens import rank_tokens
from .shared import fresh_path, release

U = np.uint64
ROUNDS = 6
#: Documents are cut into blocks by a hash of their id: about this many to a block, and MOST_BLOCKS blocks at most.
BLOCK_DOCS, MOST_BLOCKS = 256, 65_536
#: Shards are written in waves, so that one wave's exchange is on disk at a time: WAVES of them, or as many more as keep a
#: job to MOST_SHARDS tasks.
WAVES, MOST_SHARDS = 4, 8192


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def feistel(values: np.ndarray, half_bits: int, key: int) -> np.ndarray:
    """A permutation of [0, 4 ** half_bits)."""
    mask = U((1 << half_bits) - 1)
    left, right = values >> U(half_bits), values & mask
    for r in range(ROUNDS):
        draw = _mix(_mix(right + U((key * 0x9E3779B97F4A7C15 + r) % 2**64)) ^ U(key % 2**64))
        left, right = right, left ^ (draw & mask)
    return left << U(half_bits) | right


def slots(indices: np.ndarray, n: int, key: int) -> np.ndarray:
    """The slot of every index in [0, n): Feistel steps until the value is below n. Distinct indices stay distinct."""
    half_bits = max(1, -(-max(n - 1, 1).bit_length() // 2))
    out = feistel(indices.astype(U), half_bits, key)
    while (far := out >= U(n)).any():
        out[far] = feistel(out[far], half_bits, key)
    return out.astype(np.int64)


def token_sequences(docs: DataFrame, path: str, pattern: str, window: int, end_id: int, n_blocks: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(block, place, doc_id, n_docs, n_tokens, ids_crc32, ids): the texts of each block of documents in the order of their
    ids, each with the end id after it, cut every `window` tokens; ids are little-endian unsigned 16-bit integers, and
    the last sequence of a block is filled up with end ids. doc_id is of the first token. A block is a hash of the id
    (of the text, where it is null), so neither its sequences nor their number depend on how docs is partitioned."""
    names = ["block", "place", "doc_id", "n_docs", "n_tokens", "ids_crc32", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = rank_tokens(path, pattern)
        if max(encode.size - 1, end_id) >= 2**16:
            raise ValueError("ids must fit in 16 bits")
        held, owners, rows, block, place = bytearray(), [], [], None, 0  # of the sequence that is being filled

        def put(raw: bytes, n: int, n_docs: int) -> None:
            nonlocal place
            rows.append((block, place, owners[0], n_docs, n, zlib.crc32(raw), raw))
            place += 1

        def finish() -> None:
            nonlocal held, owners, place
            if held:
                n = len(held) // 2
                put(bytes(held) + array("H", [end_id]).tobytes() * (window - n), n, len(owners))
            held, owners, place = bytearray(), [], 0

        def out() -> pa.RecordBatch:
            kinds = [pa.int64()] * 6 + [pa.binary()]
            made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
            rows.clear()
            return made

        for batch in batches:
            for now, doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if now != block:
                    finish()
                    block = now
                ids = array("H", encode(text.as_py() or ""))
                ids.append(end_id)
                raw, at = ids.tobytes(), 0
                while at < len(raw):
                    piece = raw[at : at + 2 * window - len(held)]
                    held += piece
                    owners.append(doc)
                    at += len(piece)
                    if len(held) == 2 * window:
                        put(bytes(held), window, len(owners))
                        held, owners = bytearray(), []
                        if len(rows) >= 1000:
                            yield out()
        finish()
        if rows:
            yield out()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    block = F.pmod(F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id")), F.lit(n_blocks))
    rows = rows.select(block.alias("block"), "doc_id", "text").repartition("block").sortWithinPartitions("block", "doc_id", "text")
    return rows.mapInArrow(run, "block long, place long, doc_id long, n_docs long, n_tokens long, ids_crc32 long, ids binary")


def _whole_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each shard, all records in a row, from (shard, slot, ids as a compressed frame) in order."""
    unpack = zstandard.ZstdDecompressor().decompress
    shard, held = None, bytearray()
    row = lambda: pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([bytes(held)], pa.binary())], ["shard", "ids"])
    for batch in batches:
        for now, frame in zip(batch.column(0).to_pylist(), batch.column(2)):
            if now != shard:
                if held:
                    yield row()
                shard, held = now, bytearray()
            held += unpack(frame.as_buffer())
    if held:
        yield row()


def materialise(docs: DataFrame, path: str, pattern: str, out: str | None = None, window: int = 2048, per_shard: int = 8192, key: int = 1, end_id: int = 50256, id_col: str = "doc_id", text_col: str = "text") -> tuple[str, DataFrame]:
    """Write the shards to out (a fresh folder in the shared one unless given); return it with one row for each sequence:
    sequence, slot, shard, record (its place in the shard), doc_id (whose first token it has), n_docs, n_tokens, ids_crc32.

    out/shard=S holds the one file of slots [S * per_shard, (S + 1) * per_shard): records of 2 * window bytes, in order
    of their slots (and a line end after the last: Spark's own writer commits the files, on any store); out/about.json
    has what a reader needs. A null or empty text is one end id. Without documents there is no shard. Sequences and
    slots follow from the documents and the key alone; repeated rows come as often as they are there.
    """
    spark = docs.sparkSession
    out = out or fresh_path(spark, "shards")
    staged = fresh_path(spark, "sequences")
    n_blocks = min(-(-docs.count() // BLOCK_DOCS), MOST_BLOCKS) or 1
    squeezed = {"compression": "zstd", "parquet.compression.codec.zstd.level": "5", "parquet.page.size": str(4 << 20)}
    token_sequences(docs, path, pattern, window, end_id, n_blocks, id_col, text_col).write.options(**squeezed).parquet(staged)
    release(spark, 0)  # no name holds the plan above, so the texts' exchange goes before the next one is written
    made = spark.read.parquet(staged)
    blocks = made.groupBy("block").agg(F.count(F.lit(1)).alias("n")).orderBy("block").toArrow()  # MOST_BLOCKS rows at most
    ids, sizes = (blocks.column(i).to_numpy() for i in (0, 1))
    first, total = np.concatenate([[0], np.cumsum(sizes)]), int(sizes.sum())
    sent = spark.sparkContext.broadcast((ids, first))

    def numbered(df: DataFrame, low: int = 0, high: int = 2**62) -> DataFrame:
        """df with its sequences' places, where the shard is in [low, high). ids come as a compressed frame, which the exchange
        moves for less."""
        names = df.columns

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, first = sent.value
            pack = zstandard.ZstdCompressor(level=3).compress
            for batch in batches:
                block, place = (batch.column(names.index(c)).to_numpy() for c in ("block", "place"))
                sequence = first[np.searchsorted(ids, block)] + place
                slot = slots(sequence, total, key)
                mine = (slot >= low * per_shard) & (slot < high * per_shard)
                if not mine.all():
                    sequence, slot, batch = sequence[mine], slot[mine], batch.filter(pa.array(mine))
                columns = [pa.array(x, pa.int64()) for x in (sequence, slot, slot // per_shard, slot % per_shard)]
                old = [pa.array([pack(x.as_buffer()) for x in c], pa.binary()) if n == "ids" else c for n, c in zip(names, batch.columns)]
                yield pa.RecordBatch.from_arrays([*columns, *old], [*made_names, *names])

        made_names = ["sequence", "slot", "shard", "record"]
        schema = ", ".join([f"{c} long" for c in made_names] + [f"{c} {kind}" for c, kind in df.dtypes])
        return df.mapInArrow(run, schema)

    n_shards = -(-total // per_shard)
    per_wave = min(-(-n_shards // WAVES), MOST_SHARDS) or 1
    for low in range(0, n_shards, per_wave):
        high = min(low + per_wave, n_shards)
        records = numbered(made.select("block", "place", "ids"), low, high).select("shard", "slot", "ids")
        # ranges of slots by arithmetic: the shard is the partition, without a pass that samples
        records = records.repartitionById(high - low, F.col("shard").cast("int") - low).sortWithinPartitions("shard", "slot")
        records = records.mapInArrow(_whole_shards, "shard long, ids binary").select("shard", F.col("ids").cast("string").alias("ids"))
        records.write.mode("append").partitionBy("shard").option("lineSep", "\n").option("compression", "none").text(out)
        del records
        release(spark, 0)
    about = {"sequences": total, "window": window, "stride": 2 * window, "per_shard": per_shard, "shards": n_shards, "key": key, "end_id": end_id}
    _write_text(spark, f"{out}/about.json", json.dumps(about))
    return out, numbered(made.drop("ids")).select("sequence", "slot", "shard", "record", "doc_id", "n_docs", "n_tokens", "ids_crc32")


def _file_system(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    target, system = _file_system(spark, path)
    stream = system.create(target, True)
    stream.write(bytearray(text.encode()))
    stream.close()


def read_sequences(spark: SparkSession, path: str, first: int, n: int) -> list[np.ndarray]:
    """The sequences at slots [first, first + n), read by seeking: what a job that stopped before `first` goes on with."""
    about = json.loads(spark.read.text(f"{path}/about.json", wholetext=True).first()[0])
    out, width = [], about["stride"]
    for shard in range(first // about["per_shard"], -(-min(first + n, about["sequences"]) // about["per_shard"])):
        target, system = _file_system(spark, f"{path}/shard={shard}")
        (file,) = [f.getPath() for f in system.listStatus(target) if f.getPath().getName().startswith("part-")]
        low = max(first - shard * about["per_shard"], 0)
        high = min(first + n - shard * about["per_shard"], about["per_shard"], about["sequences"] - shard * about["per_shard"])
        stream = system.open(file)
        stream.seek(low * width)
        raw = bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, (high - low) * width))
        stream.close()
        out += [np.frombuffer(raw[i * width : (i + 1) * width], "<u2") for i in range(high - low)]
    return out
