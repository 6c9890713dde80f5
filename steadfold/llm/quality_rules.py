"""Quality rules as weak supervision: rules vote or abstain, expectation-maximisation estimates how far each can be
trusted, and a document's posterior decides. DataFrame operations only."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import BLANKS, Sealed, barrier, stash

#: Low bits of a packed window that hold its place; longer texts are sorted as pairs instead.
PLACE = 21
MASK = (1 << PLACE) - 1


def _without(text: Column, pattern: str) -> Column:
    return F.regexp_replace(text, pattern, "")


def _repeated(windows: str) -> Column:
    """Places of the hashes in `windows` that occur twice or more, in order.

    A hash's high bits and its place are packed into a long, so that an array of longs is all that is sorted; equal
    hashes are then neighbours. Where two different hashes agree in the high bits, and in very long texts, pairs of
    hash and place are sorted."""
    h = F.col(windows)
    packed = F.sort_array(F.transform(h, lambda x, i: x.bitwiseAND(F.lit(~MASK)).bitwiseOR(i.cast("long"))))

    def by_packed(s: Column) -> Column:
        at = lambda x: F.get(h, x.bitwiseAND(F.lit(MASK)).cast("int"))
        same = lambda x, j: (at(x) == at(F.get(s, j + 1))) | ((j > 0) & (at(x) == at(F.get(s, F.greatest(j - 1, F.lit(0))))))
        mixed = F.exists(F.transform(s, lambda x, j: (x.bitwiseAND(F.lit(~MASK)) == F.get(s, j + 1).bitwiseAND(F.lit(~MASK))) & (at(x) != at(F.get(s, j + 1)))), lambda x: x)
        return F.struct(mixed.alias("mixed"), F.filter(s, lambda x, j: F.coalesce(same(x, j), F.lit(False))).alias("found"))

    def by_pairs(s: Column) -> Column:
        near = lambda x, j: F.coalesce(x["h"] == F.get(s, j + 1)["h"], F.lit(False)) | ((j > 0) & (x["h"] == F.get(s, F.greatest(j - 1, F.lit(0)))["h"]))
        return F.sort_array(F.transform(F.filter(s, near), lambda x: x["i"]))

    once = lambda value, f: F.get(F.transform(F.array(value), f), 0)  # noqa: E731  value is computed once, not in f's loops
    pairs = once(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.cast("long").alias("i")))), by_pairs)
    quick = once(packed, by_packed)
    places = once(quick, lambda q: F.when(F.coalesce(q["mixed"], F.lit(False)), pairs).otherwise(F.sort_array(F.transform(q["found"], lambda x: x.bitwiseAND(F.lit(MASK))))))
    return F.when(F.size(h) == F.size(F.array_distinct(h)), F.array().cast("array<long>")).when(F.size(h) > MASK, pairs).otherwise(places)


def features(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs without its text, and with counts of it. A null text has no words."""
    text, words = F.col("_text"), F.col("_words")
    df = docs.withColumn("_text", F.coalesce(F.col(text_col), F.lit(""))).drop(text_col)
    df = barrier(df, _words=F.filter(F.split(text, r"[\x20\x09-\x0D]+", -1), lambda w: w != ""))
    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    lines = F.filter(F.split(text, "\n", -1), lambda line: F.btrim(line, F.lit(BLANKS)) != "")
    letters = _without(text, r"[^\p{L}]+")
    df = barrier(
        df,
        n_words=F.size(words).cast("long"),
        word_chars=F.char_length(F.array_join(words, "")).cast("long"),
        n_symbols=(F.char_length(text) - F.char_length(_without(text, r"[#*$%&|<>]+"))).cast("long"),
        n_shouts=(F.char_length(text) - F.char_length(_without(text, r"[!?]+"))).cast("long"),
        n_letters=F.char_length(letters).cast("long"),
        n_upper=(F.char_length(letters) - F.char_length(_without(letters, r"\p{Lu}+"))).cast("long"),
        _lines=lines,
        _windows=F.when(F.size(words) >= 3, hashes).otherwise(F.array().cast("array<long>")),
    ).drop("_words", "_text")
    df = barrier(df, n_lines=F.size("_lines").cast("long"), n_dup_lines=(F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"), _places=_repeated("_windows")).drop("_lines", "_windows")
    covered = F.aggregate(
        "_places",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).cast("long").alias("last")),
        lambda s, p: F.struct((s["n"] + F.least(F.lit(3).cast("long"), p - s["last"])).alias("n"), p.alias("last")),
        lambda s: s["n"],
    )
    return df.withColumn("n_repeat_words", covered).drop("_places")


@dataclass(frozen=True)
class Rule:
    """Votes good where good holds, bad where bad holds, and abstains elsewhere and where either is null."""

    name: str
    good: Column
    bad: Column

    @property
    def vote(self) -> Column:
        return F.when(self.bad, -1).when(self.good, 1).otherwise(0)


def default_rules() -> list[Rule]:
    """Limits in use for web text; between a rule's two limits it abstains."""
    c = F.col
    per_word = lambda x: c(x) / F.nullif(c("n_words"), F.lit(0))
    length = per_word("word_chars")
    shout, upper = per_word("n_shouts"), c("n_upper") / F.nullif(c("n_letters"), F.lit(0))
    letters, dup = c("n_letters") / F.nullif(c("word_chars"), F.lit(0)), c("n_dup_lines") / F.nullif(c("n_lines"), F.lit(0))
    return [
        Rule("length", c("n_words") >= 80, F.lit(False)),
        Rule("word_length", length.between(3, 10), (length < 2) | (length > 20)),
        Rule("symbols", per_word("n_symbols") <= 0.02, per_word("n_symbols") >= 0.1),
        Rule("shouting", shout <= 0.05, shout >= 0.3),
        Rule("upper_case", upper <= 0.2, upper >= 0.7),
        Rule("letters", letters >= 0.8, letters <= 0.3),
        Rule("same_lines", dup <= 0.2, dup >= 0.5),
        Rule("repetition", per_word("n_repeat_words") <= 0.2, per_word("n_repeat_words") >= 0.5),
    ]


#: What is assumed of a rule beforehand: the share of good documents that it calls bad, and with what weight.
ERROR, TRUST = 0.02, 0.1


@dataclass(frozen=True)
class LabelModel:
    """For each kind of junk: its log odds against good, and what a good and a bad vote of each rule add to them."""

    kinds: list[tuple[float, list[tuple[float, float]]]]

    def probability(self, votes: list[str]) -> Column:
        """Of good, given the columns that hold the votes."""
        against = F.lit(0.0)
        for prior, odds in self.kinds:
            z = F.lit(prior)
            for name, (good, bad) in zip(votes, odds):
                z = z + F.when(F.col(name) == 1, F.lit(good)).when(F.col(name) == -1, F.lit(bad)).otherwise(F.lit(0.0))
            against = against + F.exp(F.least(z, F.lit(50.0)))
        return F.lit(1.0) / (F.lit(1.0) + against)


def fit(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 200) -> LabelModel:
    """Expectation-maximisation over the distinct patterns of votes and how often each occurs (3 ** rules patterns at
    most). Kinds of junk exclude each other - shouting is rarely a table - so beside the good documents there is a kind
    for every rule, beginning with what that rule calls bad. Each class has its share, and for each rule the rate of
    bad votes, given that the rule votes: its accuracy there. Counts are smoothed towards rules that are right; among the
    good documents with the weight of TRUST of all documents, at ERROR: else every lone bad vote would make a kind of
    its own, and the posterior be a filter that all rules must pass."""
    k, total = (len(patterns[0][0]) if patterns else 0), sum(n for _, n in patterns)
    member = [[0.98 if -1 not in v else 0.02, *[0.98 / v.count(-1) if x == -1 else 0.02 / k for x in v]] for v, _ in patterns]
    share, rates = [0.9, *[0.1 / max(k, 1)] * k], [[0.01] * k, *[[0.9 if i == j else 0.1 for i in range(k)] for j in range(k)]]
    for _ in range(rounds if total else 0):
        mass = [9.0 if c == 0 else 1.0 / k for c in range(k + 1)]
        votes = [[[0.05 + ERROR * TRUST * total, 50.0 + (1 - ERROR) * TRUST * total] if c == 0 else [9.0, 1.0] if c == j + 1 else [0.5, 4.5] for j in range(k)] for c in range(k + 1)]
        for p, (v, n) in zip(member, patterns):
            for c in range(k + 1):
                mass[c] += p[c] * n
                for j in range(k):
                    if v[j]:
                        votes[c][j][v[j] > 0] += p[c] * n
        share = [x / sum(mass) for x in mass]
        old, rates = rates, [[min(max(b / (b + g), 1e-5), 1 - 1e-5) for b, g in row] for row in votes]
        for i, (v, _) in enumerate(patterns):
            z = [math.log(share[c]) + sum(math.log(rates[c][j] if x < 0 else 1 - rates[c][j]) for j, x in enumerate(v) if x) for c in range(k + 1)]
            e = [math.exp(x - max(z)) for x in z]
            member[i] = [x / sum(e) for x in e]
        if max((abs(a - b) for x, y in zip(old, rates) for a, b in zip(x, y)), default=0) < 1e-9:
            break
    add = lambda c, j: (math.log((1 - rates[c][j]) / (1 - rates[0][j])), math.log(rates[c][j] / rates[0][j]))
    return LabelModel([(math.log(share[c] / share[0]), [add(c, j) for j in range(k)]) for c in range(1, k + 1)])


def judge(docs: DataFrame, rules: list[Rule] | None = None, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """docs without its text, with the counts of features(), each rule's vote, probability (of good), base_failed and
    kept. base_failed: under 50 words, or over half of the words in repeated 3-word windows; such rows are not kept, and
    others are if the probability is `least` or more. A null text has no words. No document, no vote: the
    prior decides. A column of docs named like one that is added is replaced."""
    rules = rules or default_rules()
    names = [f"vote_{r.name}" for r in rules]
    sealed = Sealed.of(docs)
    counts = features(sealed.frame, f"c{sealed.names.index(text_col)}")
    added = [c for c in counts.columns if c not in sealed.frame.columns]
    voted = stash(counts.withColumns({n: r.vote for n, r in zip(names, rules)}), "votes")
    patterns = [(tuple(r[n] for n in names), r["n"]) for r in voted.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).collect()]
    model = fit(sorted(patterns))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    judged = voted.withColumn("probability", model.probability(names)).withColumn("base_failed", failed)
    new = [*added, *names, "probability", "base_failed"]
    old = [F.col(f"c{i}").alias(c) for i, c in enumerate(sealed.names) if c != text_col and c.lower() not in {*map(str.lower, new), "kept"}]
    return judged.select(*old, *new, (~F.col("base_failed") & (F.col("probability") >= least)).alias("kept"))
