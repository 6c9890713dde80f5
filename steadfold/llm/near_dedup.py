"""Near-duplicate documents by min-max hashing, with every link confirmed on the full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .shared import Sealed, lookup, release, stash

U = np.uint64


class Words(dict):
    """64-bit hashes of words, remembered up to a bound."""

    MOST = 400_000

    def __missing__(self, word: bytes) -> int:
        got = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            if len(self) >= self.MOST:
                self.clear()
            self[word] = got
        return got


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def shingle_set(text: str | None, size: int, words: Words) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct size-word shingles of a text; of the whole sequence if it is shorter; none
    without words. bytes.lower() and bytes.split() treat A-Z and [\\x20\\x09-\\x0D] alone."""
    split = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not split:
        return np.empty(0, U)
    w = np.fromiter(map(words.__getitem__, split), U, len(split))
    n = min(size, len(w))
    out = np.full(len(w) - n + 1, n, U)
    for i in range(n):
        out = _mix(out * U(0x9E3779B97F4A7C15) + w[i : len(w) - n + 1 + i])
    return np.unique(out)


class MinMax:
    """Signatures: under each of n permutations the minimum and the maximum, so two values for one evaluation."""

    def __init__(self, bands: int, rows: int, seed: int = 1):
        self.bands, self.rows = bands, rows
        rng = np.random.default_rng(seed)
        n = -(-bands * rows // 2)
        self.flips = rng.integers(0, 2**64, n, dtype=U)[:, None]
        self.odds = (rng.integers(0, 2**64, n, dtype=U) | U(1))[:, None]
        self.weights = rng.integers(0, 2**64, (1, rows), dtype=U) | U(1)
        self.order = rng.permutation(2 * n)[: bands * rows]

    def values(self, shingles: np.ndarray) -> np.ndarray:
        low, high = None, None
        for at in range(0, len(shingles), 2048):
            x = (shingles[None, at : at + 2048] ^ self.flips) * self.odds
            a, b = x.min(axis=1), x.max(axis=1)
            low, high = (a, b) if low is None else (np.minimum(low, a), np.maximum(high, b))
        return np.concatenate([low, high])[self.order]

    def keys(self, values: np.ndarray) -> np.ndarray:
        """One 64-bit key for each band, distinct between bands."""
        v = _mix(values.reshape(self.bands, self.rows))
        return _mix((v * self.weights).sum(axis=1, dtype=U) + np.arange(1, self.bands + 1, dtype=U) * U(0xD1B54A32D192ED03)).view(np.int64)


#: Bits of an odd sketch.
BITS = 1024


def odd_sketch(shingles: np.ndarray) -> np.ndarray:
    """BITS bits, 64 in a long: bit i is the parity of the shingles that fall on i. Two sets differ in at least as many
    shingles as their sketches differ in bits, so a pair can be ruled out by them without any error."""
    bits = np.bincount((shingles >> U(7)).astype(np.int64) % BITS, minlength=BITS) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def signatures(docs: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    """(doc, d1, d2, n, bands, sketch): d1 and d2 identify the shingle set, n is its size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, hasher = Words(), MinMax(bands, rows)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part, out = batch.slice(at, 1000), []
                for text in part.column(1):
                    s = shingle_set(text.as_py(), size, words)
                    if len(s):
                        digest = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64).tolist()
                        out.append((*digest, len(s), hasher.keys(hasher.values(s)), odd_sketch(s)))
                    else:
                        out.append((None, None, 0, None, None))
                columns = [pa.array(c, k) for c, k in zip(zip(*out), kinds)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], ["doc", "d1", "d2", "n", "bands", "sketch"])

    return docs.mapInArrow(run, "doc long, d1 long, d2 long, n long, bands array<long>, sketch array<long>")


def shingle_sets(docs: DataFrame, size: int) -> DataFrame:
    """(doc, d1, shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sets = [shingle_set(t.as_py(), size, words) for t in part.column(1)]
                digests = [np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64)[0] for s in sets]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(digests, pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["doc", "d1", "shingles"])

    return docs.mapInArrow(run, "doc long, d1 long, shingles array<long>")


def _most_apart(a: str, b: str, percent: int):
    """How many shingles two sets of sizes a and b can differ in if their similarity is percent or more."""
    return F.floor((F.col(a) + F.col(b)) * F.lit(100 - percent) / F.lit(100 + percent))


def confirmed(pairs: DataFrame, reps: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough; sets go only to pairs that sketches leave."""
    side = lambda c: reps.select(F.col("doc").alias(c), F.col("sketch").alias(f"sketch_{c}"), F.col("n").alias(f"n_{c}"))
    apart = F.expr("aggregate(zip_with(sketch_a, sketch_b, (x, y) -> bit_count(x ^ y)), 0, (s, x) -> s + x)")
    near = pairs.join(side("a").hint("merge"), "a").join(side("b").hint("merge"), "b").where(apart <= _most_apart("n_a", "n_b", percent))
    near = stash(near.select("a", "b"), "pairs")
    ids = near.select(F.col("a").alias("doc")).union(near.select(F.col("b").alias("doc"))).distinct()
    asked = reps.select("doc", "d1").join(ids, "doc", "left_semi")
    sets = shingle_sets(texts.join(asked.select("doc"), "doc", "left_semi"), size)
    sets = stash(sets.join(asked, ["doc", "d1"], "left_semi").dropDuplicates(["doc"]), "sets")
    side = lambda c: sets.select(F.col("doc").alias(c), F.col("shingles").alias(f"set_{c}"))
    both = near.join(side("b").hint("merge"), "b").join(side("a").hint("merge"), "a")
    both = both.select("a", "b", F.size("set_a").alias("n_a"), F.size("set_b").alias("n_b"), F.size(F.array_intersect("set_a", "set_b")).alias("common"))
    return both.where(F.lit(100) * F.col("common") >= F.lit(percent) * (F.col("n_a") + F.col("n_b") - F.col("common"))).select("a", "b")


#: Rows of either side in a block of a bucket.
BLOCK = 512


def _block_pairs(rest: DataFrame, percent: int) -> DataFrame:
    """Pairs of a bucket's odd rows with its other rows that are of different components and not ruled out by sizes
    and sketches. rest: key, doc, n, sketch, component, odd, n_odd, n_rows. A large bucket is cut into blocks, and
    each block of odd rows meets each block of rows in a task of its own, which passes on only what is left."""
    i_all, j_all = F.ceil(F.col("n_odd") / BLOCK), F.ceil(F.col("n_rows") / BLOCK)
    place = lambda n: F.pmod(F.xxhash64("doc"), n)
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    columns = ["key", "i", "j", "left", "doc", "n", "component", "sketch"]
    left = rest.where("odd").withColumn("i", place(i_all)).withColumn("j", upto(j_all)).withColumn("left", F.lit(True)).select(*columns)
    right = rest.withColumn("j", place(j_all)).withColumn("i", upto(i_all)).withColumn("left", F.lit(False)).select(*columns)
    blocks = left.unionByName(right).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def pairs(rows: pa.Table) -> pa.RecordBatch | None:
        left = rows["left"].to_numpy()
        doc, n, component = (rows[c].to_numpy() for c in ("doc", "n", "component"))
        sketch = rows["sketch"].combine_chunks().flatten().to_numpy().view(U).reshape(len(doc), -1)
        a, b = np.flatnonzero(left), np.flatnonzero(~left)
        apart = np.zeros((len(a), len(b)), np.int64)
        for k in range(sketch.shape[1]):
            apart += np.bitwise_count(sketch[a, k][:, None] ^ sketch[b, k][None, :])
        na, nb = n[a][:, None], n[b][None, :]
        near = (apart * (100 + percent) <= (na + nb) * (100 - percent)) & (component[a][:, None] != component[b][None, :])
        x, y = np.nonzero(near & (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)))
        if len(x):
            p, q = doc[a][x], doc[b][y]
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(p, q)), pa.array(np.maximum(p, q))], ["a", "b"])
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            now = pa.Table.from_batches([batch])
            held = now if held is None else pa.concat_tables([held, now]).combine_chunks()
            ids = np.stack([held[c].to_numpy() for c in ("key", "i", "j")])
            starts = [0, *(np.flatnonzero((ids[:, 1:] != ids[:, :-1]).any(axis=0)) + 1).tolist()]
            for low, high in zip(starts, starts[1:]):  # the last block may go on in the next batch
                if (got := pairs(held.slice(low, high - low))) is not None:
                    yield got
            held = held.slice(starts[-1])
        if held is not None and held.num_rows and (got := pairs(held)) is not None:
            yield got

    return blocks.mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, bands: int = 40, rows: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with n_shingles, component_id (the least id reachable over links) and kept (it is the document's own).

    Two documents are linked if the Jaccard similarity of their sets of size-word shingles is percent or more.
    40 bands of 5 miss a pair at 80 % with probability 1e-7. Documents with equal sets form a class, represented
    by its least id, before anything is compared. In a bucket, representatives are first compared with a hub, the
    member with most bucket mates. Those that this leaves in another component than the hub's are then compared with
    the whole bucket, block by block, so no link is lost to the hub and no large group is compared with itself.

    A text that is null or has no words has no shingles and no link. Rows of one id are one document; if their texts
    differ, one of them stands for it. A row with a null id is its own component, null, and is kept. A column of docs
    named like one of the three that are added is replaced.
    """
    spark, sealed = docs.sparkSession, Sealed.of(docs)
    own_id = sealed[id_col].cast("long")
    texts = sealed.frame.select(own_id.alias("doc"), sealed[text_col].alias("text"))
    signed = stash(signatures(texts, size, bands, rows), "signatures")
    known = signed.where("doc IS NOT NULL AND n > 0")
    total, ids = known.agg(F.count("doc"), F.count_distinct("doc")).first()
    if ids < total:
        known = stash(known.withColumn("_at", F.row_number().over(Window.partitionBy("doc").orderBy("d1", "d2"))).where("_at = 1").drop("_at"), "known")
    classes = stash(known.groupBy("d1", "d2").agg(F.min("doc").alias("rep"), F.count(F.lit(1)).alias("weight")), "classes")
    reps = stash(known.join(classes.select("d1", "d2", F.col("rep").alias("doc")).hint("merge"), ["d1", "d2", "doc"], "left_semi"), "reps")

    posts = reps.select("doc", F.explode("bands").alias("key"))
    sizes = stash(posts.groupBy("key").agg(F.count(F.lit(1)).alias("mates")).where("mates > 1").withColumn("weight", F.col("mates")), "buckets")
    members = stash(lookup(posts, sizes, ["key"], "weight", ["doc"], total * bands).where("mates IS NOT NULL"), "members")
    degrees = stash(members.groupBy("doc").agg(F.sum("mates").alias("degree")), "degrees")
    first = F.max_by("doc", F.struct("degree", F.negative("doc")))
    hubs = stash(members.join(degrees.hint("merge"), "doc").groupBy("key").agg(first.alias("hub"), F.count(F.lit(1)).alias("weight")), "hubs")
    of_hub = stash(lookup(members.select("doc", "key"), hubs, ["key"], "weight", ["doc"], total * bands), "of_hub")
    release(spark)  # here and below: dozens of steps would else fill the driver's heap with plans and counts of tasks
    pairs = of_hub.where("hub != doc").select(F.least("hub", "doc").alias("a"), F.greatest("hub", "doc").alias("b")).distinct()
    links = stash(confirmed(pairs, reps, texts, size, percent), "links")
    release(spark)

    labels = stash(components(links), "labels")
    release(spark)
    label = lambda df, c, out: df.join(labels.select(F.col("node").alias(c), F.col("component").alias("_label")).hint("merge"), c, "left").withColumn(out, F.coalesce("_label", c)).drop("_label")
    own = label(members.select("doc").distinct(), "doc", "component").join(reps.select("doc", "n", "sketch").hint("merge"), "doc")
    hub_label = stash(label(hubs.select("key", "hub", "weight"), "hub", "hub_component").select("key", "hub_component", "weight"), "hub_labels")
    rest = lookup(of_hub, hub_label, ["key"], "weight", ["doc"], total * bands).where("hub != doc").join(label(members.select("doc").distinct(), "doc", "component").hint("merge"), "doc")
    rest = stash(rest.select("key", "doc", "component", (F.col("component") != F.col("hub_component")).alias("odd")), "rest")
    unsettled = rest.groupBy("key").agg(F.count_if("odd").alias("n_odd"), F.count(F.lit(1)).alias("n_rows")).where("n_odd > 0 AND n_rows > 1")
    unsettled = stash(unsettled.withColumn("weight", F.col("n_rows")), "unsettled")
    release(spark)
    rest = lookup(rest, unsettled, ["key"], "weight", ["doc"], total * bands).where("n_odd IS NOT NULL").drop("component")
    late = stash(_block_pairs(rest.join(own.hint("merge"), "doc"), percent), "late")
    links = links.unionByName(stash(confirmed(late, reps, texts, size, percent), "links"))
    release(spark)
    labels = components(links).select(F.col("node").alias("rep"), "component")

    classes = stash(classes.join(labels.hint("merge"), "rep", "left").select("d1", "d2", "weight", F.coalesce("component", "rep").alias("component")), "labelled")
    if ids < total:  # rows beside the one that stands for their id
        by_id = lookup(known.select("doc", "d1", "d2"), classes, ["d1", "d2"], "weight", ["doc"], total)
        found = signed.select("doc", "n").join(by_id.select("doc", "component").hint("merge"), "doc", "left")
    else:
        found = lookup(signed.select("doc", "n", "d1", "d2"), classes, ["d1", "d2"], "weight", ["doc"], total)
    found = found.select("doc", "n", F.when(F.col("n") > 0, F.col("component")).alias("component"))
    found = found.groupBy("doc").agg(F.max("n").alias("n_shingles"), F.min("component").alias("component")) if ids < total else found.withColumnRenamed("n", "n_shingles")
    # Rows without an id are spread by their text: they would meet in one task, though nothing matches them.
    keyed = sealed.frame.select("*", F.coalesce(own_id, F.xxhash64(sealed[text_col])).alias("doc"), own_id.isNotNull().alias("real"))
    out = keyed.join(found.where("doc IS NOT NULL").withColumn("real", F.lit(True)).hint("merge"), ["doc", "real"], "left")
    component = F.coalesce("component", F.when(F.col("real"), F.col("doc")))
    return out.select(*sealed.back({"n_shingles": F.coalesce("n_shingles", F.lit(0).cast("long")), "component_id": component, "kept": F.coalesce(component == F.col("doc"), F.lit(True))}))
