"""A quality classifier: the perplexity of an interpolated modified Kneser-Ney model of trusted text.

Grams are of the tokens of a public byte-level vocabulary, so every text has a probability: single tokens are smoothed
over the vocabulary, whose size bounds all tables of single tokens. Longer grams are as many as the trusted text has;
they are counted, discounted and looked up in sharded joins. A log probability is a sum: what the last token gives alone,
for each context that is known what it leaves to the lower order, and for each gram that is known its gain over that
order. So documents join the sums by gram, and what they gain is summed by document.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rank_tokens import rank_tokens
from .recent import groups
from .shared import Sealed, lookup, release, stash

#: A token is a digit of so many bits, its id and one; what stands before and after a text is the digit after the last.
#: No gram begins with the digit 0, so grams of different orders never have the same number.
BITS = 16
#: The most frequent grams, HOT at most, are looked up by broadcast. Of the others, those are sent to the join whose bit
#: among 2 ** KNOWN_BITS (16 MB) some known gram has.
HOT, KNOWN_BITS = 500_000, 27
#: Log probabilities are summed as whole billionths of a nat, so that no order of summing shows.
UNIT = 1e9


@dataclass
class Coder:
    """Texts as rows of digits, `order` - 1 edges before each and one after it."""

    path: str
    pattern: str
    order: int

    def __post_init__(self):
        self.tokens = rank_tokens(self.path, self.pattern)
        self.edge = self.tokens.size + 1
        if self.edge >= 1 << BITS or not 2 <= self.order <= 4:
            raise ValueError("digits must fit in 16 bits, and grams in 64")

    def ids(self, text: str) -> bytes:
        return array("H", self.tokens(text)).tobytes()

    def codes(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(digits, place of each text's first edge and the end, whether a digit is scored), from ids()."""
        before, after = array("H", [self.edge - 1] * (self.order - 1)).tobytes(), array("H", [self.edge - 1]).tobytes()
        codes = np.frombuffer(b"".join(x for t in texts for x in (before, t, after)), "<u2").astype(np.int64) + 1
        starts = np.concatenate([[0], np.cumsum([len(t) // 2 + self.order for t in texts])])
        scored = np.ones(len(codes), bool)
        for k in range(self.order - 1):
            scored[starts[:-1] + k] = False
        return codes, starts, scored


def grams(codes: np.ndarray, k: int) -> np.ndarray:
    """The number of the k digits that end at each place (of fewer at the first places)."""
    out = codes.copy()
    for j in range(1, k):
        out[j:] += codes[:-j] << (BITS * j)
    return out


def _cuts(n: list[int]) -> list[float]:
    """Discounts of Chen and Goodman for counts of 1, 2, and 3 or more, from how many grams have counts 1 to 4."""
    n = [max(x or 0, 1) for x in n]
    y = n[0] / (n[0] + 2 * n[1])
    return [min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.1), k) for k in (1, 2, 3)]


def _counts(trusted: DataFrame, coder: tuple) -> DataFrame:
    """(g, n): how often each gram of the highest order comes up, from ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Coder(*coder)
        for batch in batches:
            codes, _, scored = code.codes(batch.column(0).to_pylist())
            g, n = np.unique(grams(codes, code.order)[scored], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(n.astype(np.int64))], ["g", "n"])

    return trusted.select("ids").mapInArrow(run, "g long, n long").groupBy("g").agg(F.sum("n").alias("n"))


def _single(counts: DataFrame, edge: int) -> np.ndarray:
    """The probability of every digit alone, from (g, n) of pairs: in how many contexts it was met, discounted; what
    that leaves is shared by all. Has a row for a token at most."""
    rows = counts.groupBy(F.col("g").bitwiseAND(F.lit((1 << BITS) - 1)).alias("g")).agg(F.count(F.lit(1)).alias("n")).toArrow()
    n = np.zeros(edge + 1, np.int64)
    n[rows.column(0).to_numpy()] = rows.column(1).to_numpy()
    cut = np.array([0.0, *_cuts([int((n == k).sum()) for k in (1, 2, 3, 4)])])[np.minimum(n, 3)]
    total = max(int(n.sum()), 1)
    return (n - cut) / total + (float(cut.sum()) / total if n.any() else 1.0) / edge


def _level(counts: DataFrame, lower: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(g, n, p, gain) of grams of k digits, and (g, rest) of their contexts. lower: (suffix, below), the probabilities of
    one digit less. For pairs, it and the contexts have a row for a token at most, and so can go to all tasks."""
    cut = _cuts(list(counts.agg(*[F.count_if(F.col("n") == i) for i in (1, 2, 3, 4)]).first()))
    some = [F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2), F.count_if(F.col("n") > 2)]
    held = some[0] * F.lit(cut[0]) + some[1] * F.lit(cut[1]) + some[2] * F.lit(cut[2])
    rows = counts.select("g", "n", F.shiftright("g", BITS).alias("context"), F.col("g").bitwiseAND(F.lit((1 << BITS * (k - 1)) - 1)).alias("suffix"))
    contexts = stash(rows.groupBy("context").agg(F.sum("n").alias("total"), (held / F.sum("n")).alias("rest")), "contexts")
    sent = F.broadcast if k == 2 else lambda df: df.hint("merge")
    both = rows.join(sent(contexts), "context").join(sent(lower), "suffix")
    discount = F.when(F.col("n") == 1, cut[0]).when(F.col("n") == 2, cut[1]).otherwise(cut[2])
    p = (F.col("n") - discount) / F.col("total") + F.col("rest") * F.col("below")
    level = stash(both.select("g", "n", p.alias("p"), (F.log(p) - F.log(F.col("rest") * F.col("below"))).alias("gain")), "level")
    return level, contexts.select(F.col("context").alias("g"), "rest")


def _dense(df: DataFrame, size: int, fill: float) -> np.ndarray:
    """A table of (place, value) rows, of which there are size at most."""
    rows, out = df.toArrow(), np.full(size, fill)
    out[rows.column(0).to_numpy()] = rows.column(1).to_numpy()
    return out


def _hash(values: np.ndarray) -> np.ndarray:
    """What Spark's xxhash64 makes of longs. The primes and shifts of XXH64, and Spark's seed."""
    u = np.uint64
    a, b, c, d, e = map(u, (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turn = lambda x, k: (x << u(k)) | (x >> u(64 - k))
    h = (u(42) + e + u(8)) ^ (turn(values.astype(np.int64).view(u) * b, 31) * a)
    h = turn(h, 27) * a + d
    h = (h ^ (h >> u(33))) * b
    h = (h ^ (h >> u(29))) * c
    return (h ^ (h >> u(32))).view(np.int64)


def _bits(numbers: DataFrame) -> np.ndarray:
    """A bit for the hash of each number, among 2 ** KNOWN_BITS; numbers has one column of longs, g."""
    hashed, mask = numbers.select(F.xxhash64("g").alias("g")), (1 << KNOWN_BITS) - 1
    words = hashed.groupBy(F.expr(f"(g & {mask}) div 64").alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(g & 63 AS int)))").alias("bits"))
    return _dense(words, 1 << KNOWN_BITS - 6, np.int64(0)).view(np.uint64)


def _has_bit(bits: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    at = (_hash(numbers) & ((1 << KNOWN_BITS) - 1)).view(np.uint64)
    return ((bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)).astype(bool)


def _trusted(rows: DataFrame, ids: DataFrame, coder: tuple) -> DataFrame:
    """(doc, lang, ids) of the rows whose doc is among ids: exactly, by a merge join at every size, since ids may be few
    enough to be sent to all tasks, or may not. Their bits spare most other texts the way there."""
    bits = rows.sparkSession.sparkContext.broadcast(_bits(ids.select(F.col("doc").alias("g"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Coder(*coder)
        for batch in batches:
            some = batch.filter(pa.array(_has_bit(bits.value, batch.column(0).to_numpy())))
            for at in range(0, some.num_rows, 1000):
                part = some.slice(at, 1000)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([code.ids(x.as_py()) for x in part.column(2)], pa.binary())], ["doc", "lang", "ids"])

    some = rows.where("doc IS NOT NULL AND text IS NOT NULL").select("doc", "lang", "text").mapInArrow(run, "doc long, lang string, ids binary")
    return some.join(ids.hint("merge"), "doc", "left_semi")


@dataclass
class QualityModel:
    """single, rest: what each digit gives alone and what it leaves as a context, both logs in units. gains: (g, gain) of
    longer grams; hot: the most frequent ones, in order, with their gains; known: bits of all. limits: (lang, limit), the
    largest cross entropy (nats a token) that is kept, of an endless text; limit: for other languages, None without
    trusted text. The mean over few tokens strays further: a text of n may lie slack / sqrt(n) above, which is three
    standard errors where a token's surprise deviates by 3 nats."""

    coder: tuple
    single: np.ndarray
    rest: np.ndarray
    gains: DataFrame
    hot: tuple[np.ndarray, np.ndarray]
    known: np.ndarray
    limits: DataFrame | None = None
    limit: float | None = None
    slack: float = 9.0


def _hottest(gains: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The grams with the highest counts, as many as HOT allows: whole steps of a sixteenth of a power of two."""
    step = F.floor(16 * F.log2(F.col("n") + 1)).alias("step")
    held, least = 0, 0
    for r in gains.groupBy(step).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("step")).collect():  # 1,024 steps at most
        held += r["n"]
        if held > HOT:
            least = r["step"] + 1
            break
    rows = gains.where(step >= least).select("g", "gain").toArrow()
    g, gain = rows.column(0).to_numpy(), rows.column(1).to_numpy()
    order = np.argsort(g)
    return g[order], gain[order]


def fit_grams(trusted: DataFrame, coder: tuple) -> QualityModel:
    """A model without limits, from (ids)."""
    edge, order = Coder(*coder).edge, coder[2]
    unit = lambda x: F.round(x * UNIT).cast("long")
    levels = {order: stash(_counts(trusted, coder), "grams")}
    for k in range(order - 1, 1, -1):  # lower orders count in how many contexts a gram was met
        levels[k] = stash(levels[k + 1].groupBy(F.col("g").bitwiseAND(F.lit((1 << BITS * k) - 1)).alias("g")).agg(F.count(F.lit(1)).alias("n")), "grams")
    single = _single(levels[2], edge)
    spark = trusted.sparkSession
    lower = spark.createDataFrame([(d, float(p)) for d, p in enumerate(single.tolist()) if d], "suffix long, below double")
    parts, rest = [], np.zeros(edge + 1, np.int64)
    for k in range(2, order + 1):
        level, contexts = _level(levels[k], lower, k)
        parts.append(level.select("g", unit(F.col("gain")).alias("gain"), "n"))
        contexts = contexts.select("g", unit(F.log("rest")).alias("gain"), F.lit(0).cast("long").alias("n"))
        if k == 2:
            rest = _dense(contexts.select("g", "gain"), edge + 1, np.int64(0))
        else:
            parts.append(contexts)
        lower = level.select(F.col("g").alias("suffix"), F.col("p").alias("below"))
    gains = parts[0]
    for part in parts[1:]:
        gains = gains.unionByName(part)
    if order > 2:
        gains = gains.groupBy("g").agg(F.sum("gain").alias("gain"), F.max("n").alias("n"))
    gains = stash(gains, "gains")
    release(spark)
    logs = np.round(np.log(np.maximum(single, 1e-300)) * UNIT).astype(np.int64)
    return QualityModel(coder, logs, rest, gains, _hottest(gains), _bits(gains.select("g")))


def train(docs: DataFrame, trusted: DataFrame, path: str, pattern: str, order: int = 2, quantile: float = 0.99, least: int = 20, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> QualityModel:
    """A model of the texts of docs whose id is in trusted (one column). path, pattern: a rank file of at most 65,534
    tokens. A fifth of the trusted documents, by hash, is not counted: how new trusted text scores shows on them alone. A
    language's limit is the `quantile` of their entropies, each less what its own length allows, or the third quartile of
    the entropies as they are, if that is more: long texts, which are allowed nothing, come to lie about the middle.
    Languages with under `least` of them take the limit of all. Without trusted text every document with a text is kept.
    Null ids and texts train nothing; the language column may be missing or null."""
    coder = (path, pattern, order)
    lang = F.col(lang_col).cast("string") if lang_col in docs.columns else F.lit(None).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"), lang.alias("lang"))
    ids = trusted.select(F.col(trusted.columns[0]).cast("long").alias("doc")).where("doc IS NOT NULL").distinct()
    theirs = stash(_trusted(rows, ids, coder), "trusted")
    release(docs.sparkSession)
    held = F.pmod(F.xxhash64("doc", F.lit("held out")), F.lit(5)) == 0
    model = fit_grams(theirs.where(~held), coder)
    scored = _entropies(theirs.where(held).select(F.col("ids").alias("content"), "lang"), model)
    scored = stash(scored.select("lang", "entropy", (F.col("entropy") - model.slack / F.sqrt("n_tokens")).alias("over"), "copies"), "entropy")
    scored = scored.withColumn("each", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    limit = F.greatest(F.percentile_approx("over", quantile, 10_000), F.percentile_approx("entropy", 0.75, 10_000))
    model.limit = scored.agg(limit.alias("limit")).first()["limit"]
    of_lang = scored.where("lang IS NOT NULL").groupBy("lang").agg(limit.alias("limit"), F.count(F.lit(1)).alias("n"))
    model.limits = stash(of_lang.where(F.col("n") >= least).select("lang", "limit"), "limits")
    release(docs.sparkSession)  # what was collected is in arrays now
    return model


#: What equal texts of one language have in common: 128 bits.
KEY = ["k1", "k2"]


def _key(content: Column, lang: Column) -> list[Column]:
    return [F.xxhash64(content, lang).alias("k1"), F.xxhash64(F.lit(1), content, lang).alias("k2")]


def _asked(rows: DataFrame, model: QualityModel) -> DataFrame:
    """(g, k1, k2, n, own, size, copies, lang) from (k1, k2, content, lang): the grams of each text that the join may know,
    and a row with what is known without it. content: texts, or their ids(). Equal texts of a batch are taken together."""
    sent = rows.sparkSession.sparkContext.broadcast((model.coder, model.single, model.rest, model.hot, model.known))
    names = ["g", *KEY, "n", "own", "size", "copies", "lang"]

    def of_texts(code: Coder, texts: list[bytes], copies: np.ndarray, keys: list[np.ndarray], langs: pa.Array, memory: tuple) -> Iterator[pa.RecordBatch]:
        single, rest, (hot, hot_gain), known = memory
        codes, starts, scored = code.codes(texts)
        doc = np.repeat(np.arange(len(texts)), np.diff(starts))
        value = single[codes]
        value[1:] += rest[codes[:-1]]
        value[~scored] = 0
        own = np.add.reduceat(value, starts[:-1])
        ask_g, ask_doc = [], []
        for k in range(2, code.order + 1):
            # the digit before the first that is scored ends a context, and no gram, but for the highest order
            some = scored if k == code.order else scored | np.append(scored[1:], False)
            g, of = grams(codes, k)[some], doc[some]
            at = np.minimum(np.searchsorted(hot, g), max(len(hot) - 1, 0))
            is_hot = hot[at] == g if len(hot) else np.zeros(len(g), bool)
            np.add.at(own, of[is_hot], hot_gain[at[is_hot]])
            ask = np.flatnonzero(~is_hot)
            ask = ask[_has_bit(known, g[ask])]
            ask_g.append(g[ask])
            ask_doc.append(of[ask])
        g, of = np.concatenate(ask_g), np.concatenate(ask_doc)
        sort = np.lexsort((of, g))
        g, of = g[sort], of[sort]
        new = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (of[1:] != of[:-1])])) if len(g) else np.zeros(0, np.int64)
        n, size = np.diff(np.append(new, len(g))) * copies[of[new]], (np.diff(starts) - code.order + 1) * copies
        column = lambda x: pa.array(np.asarray(x, np.int64))
        # a text's own row is spread by its key: nothing is known of the number that it asks for
        yield pa.RecordBatch.from_arrays([column(keys[0]), column(keys[0]), column(keys[1]), column(np.zeros(len(texts))), column(own * copies), column(size), column(copies), langs], names)
        for i in range(0, len(new), 100_000):
            k = new[i : i + 100_000]
            zero = column(np.zeros(len(k)))
            yield pa.RecordBatch.from_arrays([column(g[k]), column(keys[0][of[k]]), column(keys[1][of[k]]), column(n[i : i + 100_000]), zero, zero, zero, pa.nulls(len(k), pa.string())], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, *memory = sent.value
        code = Coder(*coder)
        for batch in batches:
            low = 0
            for texts in groups(((x.as_py() for x in batch.column(2))), 1_000_000):
                part, low = batch.slice(low, len(texts)), low + len(texts)
                keys = [part.column(i).to_numpy() for i in (0, 1)]
                _, first, copies = np.unique(np.stack(keys), axis=1, return_index=True, return_counts=True)
                some = [texts[i] for i in first]
                some = [t if isinstance(t, bytes) else code.ids(t) for t in some]
                yield from of_texts(code, some, copies, [k[first] for k in keys], part.column(3).take(pa.array(first)), memory)

    return rows.mapInArrow(run, ", ".join(f"{c} long" for c in names[:-1]) + ", lang string")


def _entropies(rows: DataFrame, model: QualityModel) -> DataFrame:
    """(k1, k2, lang, entropy, n_tokens, copies) for each distinct (content, lang); entropy is in nats a token. Equal ones
    are summed together, which changes no mean."""
    keyed = rows.select(*_key(F.col("content"), F.col("lang")), "content", "lang")
    joined = _asked(keyed, model).join(model.gains.select("g", "gain").hint("merge"), "g", "left")
    gain = F.sum(F.col("own") + F.col("n") * F.coalesce("gain", F.lit(0).cast("long")))
    sums = joined.groupBy(*KEY).agg(gain.alias("gain"), F.sum("size").alias("size"), F.sum("copies").alias("copies"), F.max("lang").alias("lang"))
    return sums.select(*KEY, "lang", (-F.col("gain") / F.col("size") / UNIT).alias("entropy"), (F.col("size") / F.col("copies")).alias("n_tokens"), "copies")


def _with_limits(scored: DataFrame, model: QualityModel) -> DataFrame:
    """scored with the limit of each row's language. A language may have a third of all rows: lookup() spreads it."""
    scored = stash(scored, "scored")
    rows = scored.withColumn("lang_key", F.when(F.col("lang").isNull(), F.col("k1")).otherwise(F.xxhash64("lang")))
    weights = rows.where("lang IS NOT NULL").groupBy("lang_key", "lang").agg(F.count(F.lit(1)).alias("weight"))
    weights = stash(weights.join(model.limits.hint("merge"), "lang", "left"), "weights")
    return lookup(rows, weights, ["lang_key", "lang"], "weight", KEY, scored.count()).withColumn("limit", F.coalesce("limit", F.lit(float(model.limit))))


def score(docs: DataFrame, model: QualityModel, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """docs with entropy (nats a token), perplexity (of a token) and kept.

    A null or empty text has neither and is not kept. A null or unknown language takes the limit of all. Every row of
    docs comes once, repeated ones as often as they are there. A column named like one of the three is replaced.
    """
    sealed = Sealed.of(docs)
    text, lang = sealed[text_col], sealed[lang_col].cast("string") if lang_col in sealed else F.lit(None).cast("string")
    rows = sealed.frame.where(F.char_length(text) > 0).select(text.alias("content"), lang.alias("lang"))
    found = _entropies(rows, model)
    if model.limit is None:
        found = found.withColumn("limit", F.lit(float("inf")))
    else:
        found = _with_limits(found, model)
    found = found.select(*KEY, "entropy", (F.col("entropy") <= F.col("limit") + model.slack / F.sqrt("n_tokens")).alias("kept"))
    # Rows without a text are looked up by what else they have, so that they do not meet in one task.
    other = [F.col(c) for c, kind in sealed.frame.dtypes if not kind.startswith(("map", "variant"))]
    keys = [F.when(F.char_length(text) > 0, k).otherwise(F.xxhash64(F.lit(i), *other)).alias(f"k{i + 1}") for i, k in enumerate(_key(text, lang))]
    empty = F.coalesce(F.char_length(text) == 0, F.lit(True))
    out = sealed.frame.select("*", *keys, empty.alias("empty")).join(found.hint("merge"), KEY, "left")
    entropy = F.when(~F.col("empty"), F.col("entropy"))
    return out.select(*sealed.back({"entropy": entropy, "perplexity": F.exp(entropy), "kept": F.coalesce(F.col("kept") & ~F.col("empty"), F.lit(False))}))
