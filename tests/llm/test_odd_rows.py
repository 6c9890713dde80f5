"""Every operator on rows that are null, empty, repeated, very long, or named like what it adds."""

import random
import time

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from steadfold.llm import kneser_ney, pii, quality_rules, secrets, token_shards, topk
from steadfold.llm.byte_bpe import encode_documents
from steadfold.llm.line_dedup import dedup_lines
from steadfold.llm.near_dedup import near_duplicates
from steadfold.llm.packing import pack_documents

from .test_operators import RANKS, prose

TEXTS = [None, "", " ", "one line of text that is long enough to be a key of its own\nb", "token = abcdef123456", "card 4041894974608795", "x " * 40_000, "word " * 60]
CLASHES = "n_lines N_Dropped h1 h2 doc body pos gone id entropy perplexity kept g k1 k2 own lang n_pii n_email found mark cut new n_words words _words base_failed probability vote_length component component_id n_shingles shingles d1 d2 n real bands sketch source n_assign base all_spans redacted n_tokens ids length offset sequence_id salt ordinal slot shard record block place c0 c1".split()


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3]), (None, TEXTS[7]), (None, None), (4, "another text")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.select("*", *[F.lit("mine").alias(c) for c in CLASHES])


OPERATORS = {
    "line_dedup": (dedup_lines, ["n_lines", "n_dropped"]),
    "kneser_ney": (lambda df: kneser_ney.score(df, kneser_ney.train(df, df.select("doc_id"), *RANKS)), ["entropy", "perplexity", "kept"]),
    "pii": (lambda df: pii.pseudonymise(df, "k"), ["n_pii", *(f"n_{k}" for k in pii.MAKERS)]),
    "quality_rules": (quality_rules.judge, None),
    "near_dedup": (near_duplicates, ["n_shingles", "component_id", "kept"]),
    "byte_bpe": (lambda df: encode_documents(df, *RANKS), None),
    "secrets": (lambda df: secrets.scan_secrets(df, with_text=True, carry=True), None),
    "token_shards": (lambda df: token_shards.materialise(df, *RANKS, window=64)[1], None),
    "packing": (lambda df: pack_documents(df, P.path("word_bpe_49k.json"), window=64), None),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_clashing_names_odd_rows_and_empty_tables(odd, name):
    operate, added = OPERATORS[name]
    out = operate(odd)
    rows = out.collect()
    assert len(set(map(str.lower, out.columns))) == len(out.columns)
    if added is not None:
        assert out.columns[-len(added) :] == added and len(rows) == odd.count()
        taken = {c.lower() for c in added}
        assert [c for c in odd.columns if c.lower() not in taken] == out.columns[: -len(added)]
        assert all(r["c1"] == "mine" for r in rows)
    elif name in ("quality_rules", "secrets", "byte_bpe"):
        assert len(rows) == odd.count()
    if name == "secrets":
        assert all(r["in_redacted"] == "mine" for r in rows)
    if name == "quality_rules":
        assert all(isinstance(r["n_words"], int) and r["c0"] == "mine" for r in rows)
    assert operate(odd.where("false")).collect() == []


def test_topk_with_repeated_ids_and_scores_at_the_ends(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.standard_normal(3)]) for i in (0, 0, 1, 2, 3, 4, 50, 50, 50, 7, 7)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1)).coalesce(1)
    got = topk.search(df, F.col("vec_id") % 50 == 0, k=4).collect()
    value = lambda a, b: sum(int(np.floor(256 * x)) * int(np.floor(256 * y)) for x, y in zip(a, b))
    want = []
    for q in (0, 50):
        mine = min(v for i, v in rows if i == q)
        ranked = sorted((-value(mine, v), i) for i, v in rows if i != q)[:4]
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(ranked)]
    assert sorted(map(tuple, got)) == want
    ends = spark.createDataFrame([(0, [1e30]), (2**63 - 1, [1e30]), (2**63 - 2, [-1e30]), (5, [-1e30])], "vec_id long, embedding array<double>").coalesce(1)
    found = sorted(tuple(r) for r in topk.search(ends, F.col("vec_id") == 0, k=3).collect())
    assert found == [(0, 1, 2**63 - 1, 2**63 - 1), (0, 2, 5, -(2**63)), (0, 3, 2**63 - 2, -(2**63))]
    assert sorted(map(tuple, topk.search(spark.createDataFrame(rows[2:6], "vec_id long, embedding array<double>"), F.lit(True), block_rows=1).collect()))[:3] == [x for x in _all_pairs(rows[2:6]) if x[0] == 1]


def _all_pairs(rows):
    value = lambda a, b: sum(int(np.floor(256 * x)) * int(np.floor(256 * y)) for x, y in zip(a, b))
    return sorted((q, r + 1, i, -s) for q, v in rows for r, (s, i) in enumerate(sorted((-value(v, w), i) for i, w in rows if i != q)[:5]))


def test_long_lines_and_many_lost_lines_take_time_in_proportion(spark):
    lines = [f"a line that five documents share, and that is long enough: number {i}" for i in range(4000)]
    rows = [(i, "\n".join(lines)) for i in range(5)] + [(9, "\n".join(["own"] + lines * 5))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    began = time.time()
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in dedup_lines(df, n_batches=1).collect()}
    assert got[0] == (4000, 4000, "") and got[9] == (20001, 0, rows[5][1])
    assert time.time() - began < 60


#: The worst text of every pattern.
WORST = [
    "a@b" + ".a" * 20_000, "a" * 500_000 + "@" + "b" * 500_000 + ".c", ".a" * 300_000 + "@b.c", "1" * 1_000_000, "1 " * 50_000, "1.2." * 100_000, "AB12" * 100_000, "AB12 " * 20_000,
    "+1" * 200_000, "1-" * 100_000, "(123" * 50_000, "1/" * 200_000, "@" * 500_000,
]


def test_worst_texts_for_every_pattern(spark):
    df = spark.createDataFrame([*enumerate(WORST), (99, "mail me@example.org")], "doc_id long, text string").repartition(8)
    began = time.time()
    got = {r.doc_id: r for r in pii.pseudonymise(df, "k").collect()}
    assert got[99].n_email == 1 and all(len(got[i].text) == len(t) for i, t in enumerate(WORST)) and time.time() - began < 300


def test_dates_are_permuted_one_to_one(spark):
    day = F.date_add(F.lit("0001-01-01").cast("date"), F.col("id").cast("int"))
    ranges = ((0, 900), (693_595 - 300, 693_595 + 900), (3_652_059 - 900, 3_652_059))
    days = [spark.range(low, high).select(F.lit(form).alias("form"), F.date_format(day, form).alias("text")) for form in ("yyyy-MM-dd", "dd/MM/yyyy", "MM/dd/yyyy") for low, high in ranges]
    every = days[0]
    for more in days[1:]:
        every = every.union(more)
    rows = pii.pseudonymise(every.select("text").distinct().withColumn("was", F.col("text")).withColumn("doc_id", F.lit(1)), "k").collect()
    # slash dates are read as dd/MM where they can be, and others have pseudonyms of their own: no two values share one
    assert len({r.text for r in rows}) == len(rows) and all(r.n_date == 1 and ("-" in r.text) == ("-" in r.was) for r in rows)
    assert pii.pseudonymise(spark.createDataFrame([(1, "0000-01-01 and 31/31/2000 and 1541-03-04")], "doc_id long, text string"), "k").first().n_date == 1


def brute_permuted(s, key, kind):
    """The Feistel network on strings, by Python."""
    import hashlib

    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    a, b = s[: len(s) // 2], s[len(s) // 2 :]

    def shifted(mine, other, r):
        digest, out = sha("|".join([key, kind, str(r), other, key])), ""
        for i, c in enumerate(mine):
            by = int(sha(f"{digest}|{i}")[:15], 16)
            first, n = (48, 10) if "0" <= c <= "9" else (97, 26) if "a" <= c <= "z" else (65, 26) if "A" <= c <= "Z" else (0, 0)
            out += chr(first + (ord(c) - first + by) % n) if n else c
        return out

    for r in range(8):
        if r % 2 == 0:
            a = shifted(a, b, r)
        else:
            b = shifted(b, a, r)
    return a + b


def test_pseudonyms_against_brute_force(spark):
    luhn = lambda s: sum(int(c) if i % 2 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(s)))
    rng = random.Random(8)
    mails = [f"{''.join(rng.choice('abcXYZ019._-') for _ in range(rng.randint(1, 12)))}a@mail.example.com" for _ in range(40)]
    mails = [m for m in mails if m[0] not in ".-"]
    bodies = ["4" + "".join(rng.choice("0123456789") for _ in range(14)) for _ in range(40)]
    cards = [b + str(-luhn(b) % 10) for b in bodies]
    ssns = [f"{rng.randint(1, 665):03}-{rng.randint(1, 99):02}-{rng.randint(1, 9999):04}" for _ in range(40)]
    got = {r.was: r.text for r in pii.pseudonymise(spark.createDataFrame([(i, t, t) for i, t in enumerate(mails + cards + ssns)], "doc_id long, text string, was string"), "key").collect()}
    for m in mails:
        name, _, host = m.partition("@")
        assert got[m] == brute_permuted(name, "key", "email") + "@" + host
    for c in cards:
        body = brute_permuted(c[:-1], "key", "card")
        assert got[c] == body + str(-luhn(body) % 10)
    for s in ssns:
        x = brute_permuted(s, "key", "ssn")
        while x[:3] in ("000", "666") or x[0] == "9" or x[4:6] == "00" or x[7:] == "0000":
            x = brute_permuted(x, "key", "ssn")
        assert got[s] == x


def test_long_words_are_scanned_whole(spark):
    rng = random.Random(1)
    blob = "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/") for _ in range(200_000))
    began = time.time()
    assert [r[:2] for r in secrets._ranges("before " + blob + " after")] == [[0, len(blob) + 13]]
    assert sum(len(w.spans) for w in secrets.windows(f"{prose(rng, 50)} {blob} password: abc123def", None, secrets.Codes(16))) > 1000 and time.time() - began < 60
