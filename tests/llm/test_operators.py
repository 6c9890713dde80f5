"""The training-data operators on nulls, empty and long texts, ties, repeated rows, empty tables and extra columns, against
brute force, exact round trips or held-out accuracy."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from steadfold.llm import kneser_ney, pii, quality_rules, secrets, token_shards, topk
from steadfold.llm.byte_bpe import ByteBPE, encode_documents, serialise_model
from steadfold.llm.components import components
from steadfold.llm.line_dedup import LineRuns, dedup_lines, line_postings
from steadfold.llm.near_dedup import near_duplicates
from steadfold.llm.packing import OpenWindows, pack_documents, plan

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, n_lines string, lang string"
LONG = "word " * 30_000


def docs(spark, texts, ids=None):
    """Rows with an extra column whose name an operator might use itself."""
    ids = ids or range(len(texts))
    return spark.createDataFrame([(i, t, "mine", "en" if k % 3 else None) for k, (i, t) in enumerate(zip(ids, texts))], SCHEMA)


# --- line dedup


def brute_lines(rows, least=5, chars=40):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    held = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= chars and i is not None:
                held.setdefault(key(line), set()).add(i)
    gone = {k: max(v) for k, v in held.items() if len(v) >= least}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if gone.get(key(x), i) == i or i is None]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def test_line_dedup_against_brute_force(spark):
    a, b, c = "a common line of text that is long enough to be a key", "É" * 45, "b" * 39
    texts = [f"{a}\nown {k} " + "x" * 50 for k in range(5)] + [None, "", f"  {a.upper()}\t\n\n{b}", b.lower() + "\n" + c] + [b] * 4 + [c] * 5 + [f"{a}\n{a}", LONG]
    rows = list(enumerate(texts))
    rows += [(3, texts[3]), (None, a), (8, b)]
    df = docs(spark, [t for _, t in rows], [i for i, _ in rows]).drop("n_lines").withColumn("n_docs", F.lit(1))
    for batches in (1, 3):
        out = dedup_lines(df, n_batches=batches)
        assert out.columns == ["doc_id", "text", "lang", "n_docs", "n_lines", "n_dropped"]
        got = sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in out.collect()), key=str)
        assert got == sorted(brute_lines(rows), key=str)


def test_line_dedup_of_nothing(spark):
    assert dedup_lines(docs(spark, []).drop("n_lines")).collect() == []


def test_runs_admit_new_keys_and_merge(spark):
    index = LineRuns(spark, 2)
    for lines in (["a" * 40, "b" * 40], ["b" * 40, "c" * 40], ["d" * 40]):
        index.add(line_postings(docs(spark, ["\n".join(lines)], [9 - index.spark.range(1).count()])))
    assert [len(x) for x in index.levels] == [1, 1]
    fresh = index.unseen(line_postings(docs(spark, ["\n".join(["a" * 40, "d" * 40, "e" * 40])])))
    assert fresh.count() == 1
    assert sorted(r.n_docs for r in index.merged().collect()) == [1, 1, 1, 2]


# --- quality classifier


def prose(rng, n):
    parts = ["tion", "er", "the", "an", "in", "re", "on", "at", "en", "nd"]
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(n)) + "."


RANKS = (P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)


def test_clean_text_is_kept_and_odd_rows_have_a_result(spark):
    rng = random.Random(1)
    good = [prose(rng, 80) for _ in range(60)]
    bad = ["!!! $$$ ### " * 30, "QWXZ KJQ " * 40]
    rows = [(i, t, "en") for i, t in enumerate(good + bad)] + [(90, None, "en"), (91, "", None), (92, prose(rng, 60), "xx"), (92, prose(rng, 60), None), (93, prose(rng, 9000), "en"), (None, good[0], "en"), (0, good[0], "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("Entropy", F.lit("mine")).withColumn("g", F.lit(1)).withColumn("k1", F.create_map(F.lit(1), F.lit(2)))
    trusted = spark.createDataFrame([(i,) for i in range(50)] + [(3,), (None,)], "doc_id long")
    model = kneser_ney.train(df, trusted, *RANKS)
    out = kneser_ney.score(df, model)
    assert out.columns == ["doc_id", "text", "lang", "g", "k1", "entropy", "perplexity", "kept"] and out.count() == len(rows)
    got = {r.doc_id: r for r in out.collect()}
    assert all(got[i].kept for i in [*range(60), 92, 93, None])
    assert not any(got[i].kept for i in (60, 61, 90, 91)) and got[90].entropy is None
    assert got[60].perplexity == pytest.approx(np.exp(got[60].entropy)) and got[None].entropy == got[0].entropy
    assert kneser_ney.score(df.drop("lang"), model).where("kept").count() == out.where("kept").count()


def test_classifier_without_trusted_text(spark):
    df = spark.createDataFrame([(0, "some text", None)], "doc_id long, text string, lang string")
    model = kneser_ney.train(df, df.select("doc_id").where("false"), *RANKS)
    assert kneser_ney.score(df, model).first().kept
    assert kneser_ney.score(df.where("false"), model).collect() == []


def brute_kneser_ney(streams, order, edge):
    """P(last | the others) by the textbook's recursion; streams: lists of tokens without edges."""
    pad = lambda s: [edge] * (order - 1) + s + [edge]
    counts = {order: Counter(tuple(p[i - order + 1 : i + 1]) for p in map(pad, streams) for i in range(order - 1, len(p)))}
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])

    def cuts(c):
        n = [max(sum(x == k for x in c.values()), 1) for k in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1])
        return [min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.1), k) for k in (1, 2, 3)]

    cut = {k: cuts(c) for k, c in counts.items()}
    total, held = {}, {}
    for k, c in counts.items():
        for g, n in c.items():
            total[g[:-1]] = total.get(g[:-1], 0) + n
            held[g[:-1]] = held.get(g[:-1], 0) + cut[k][min(n, 3) - 1]

    def p(g):
        below = p(g[1:]) if len(g) > 1 else 1 / (edge + 1)
        if g[:-1] not in total:
            return below
        n = counts[len(g)][g]
        return ((n - cut[len(g)][min(n, 3) - 1]) if n else 0) / total[g[:-1]] + held[g[:-1]] / total[g[:-1]] * below

    return lambda stream: [-np.log(p(tuple(x[i - order + 1 : i + 1]))) for x in [pad(stream)] for i in range(order - 1, len(x))]


@pytest.mark.parametrize("order", [2, 3])
def test_joined_gains_are_those_of_the_textbook(spark, monkeypatch, order):
    rng = random.Random(3)
    vocabulary = [prose(rng, 1)[:-1] for _ in range(60)]
    follow = {w: rng.sample(vocabulary, 2) for w in vocabulary}

    def chain(n):
        out = [rng.choice(vocabulary)]
        while len(out) < n:
            out.append(rng.choice(follow[out[-1]]))
        return out

    good = [chain(rng.randint(1, 60)) for _ in range(60)]
    texts = [" ".join(x) for x in good] + [" ".join(rng.sample(x, len(x))) for x in good[:9]] + ["zq " * 9, "é日", "x", good[0][0]]
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    trusted = df.select("doc_id").where("doc_id < 50")
    enc = reference()
    counted = [r.doc_id for r in df.where((F.pmod(F.xxhash64("doc_id", F.lit("held out")), F.lit(5)) != 0) & (F.col("doc_id") < 50)).collect()]
    surprise = brute_kneser_ney([enc.encode_ordinary(texts[i]) for i in counted], order, enc.n_vocab)
    want = [float(np.mean(surprise(enc.encode_ordinary(t)))) for t in texts]
    entropies = lambda model: [r.entropy for r in kneser_ney.score(df, model).orderBy("doc_id").collect()]
    broadcast = entropies(kneser_ney.train(df, trusted, *RANKS, order=order))
    assert broadcast == pytest.approx(want, rel=1e-7)
    monkeypatch.setattr(kneser_ney, "HOT", 0)  # all grams by the join
    model = kneser_ney.train(df, trusted, *RANKS, order=order)
    assert len(model.hot[0]) == 0 and entropies(model) == broadcast


def test_hash_is_that_of_spark(spark):
    values = [0, 1, -1, 2**63 - 1, -(2**63), 12345678901]
    df = spark.createDataFrame([(v,) for v in values], "g long")
    assert kneser_ney._hash(np.array(values)).tolist() == [r[0] for r in df.select(F.xxhash64("g")).collect()]


def test_labelled_junk_goes_and_clean_text_stays(spark):
    """On all of sf0.1: labels with quality 0, their texts that repeat words, toxic ones, and the ordinary rest."""
    rows, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = rows.select("doc_id", "text", "lang")
    model = kneser_ney.train(rows, labels.where("quality = 1 AND coalesce(toxic, 0) = 0").select("doc_id"), *RANKS)
    got = kneser_ney.score(rows, model).join(labels, "doc_id", "left").select("text", "kept", "quality", "toxic").collect()

    def repeats(text):
        words = (text or "").split()
        return sum(a == b for a, b in zip(words, words[1:])) > len(words) / 2

    gone = lambda of: (lambda x: sum(not r.kept for r in x) / len(x))([r for r in got if of(r)])
    figures = {
        "quality 0": gone(lambda r: r.quality == 0),
        "quality 0, repeated": gone(lambda r: r.quality == 0 and repeats(r.text)),
        "toxic": gone(lambda r: r.toxic == 1),
        "trusted": gone(lambda r: r.quality == 1 and r.toxic == 0),
        "unlabelled": gone(lambda r: r.quality is None and r.text and not repeats(r.text)),
    }
    print(figures)
    assert figures["quality 0"] > 0.9 and figures["quality 0, repeated"] > 0.7 and figures["toxic"] > 0.15
    assert figures["trusted"] < 0.005 and figures["unlabelled"] < 0.15


# --- exact top-k


def brute_topk(rows, k=5):
    v = {i: [int(np.floor(256 * float(x))) for x in e] for i, e in rows}
    out = []
    for q in v:
        if q % 50 == 0:
            found = sorted(((-sum(a * b for a, b in zip(v[q], v[c])), c) for c in v if c != q and len(v[c]) == len(v[q])))[:k]
            out += [(q, r + 1, c, -s) for r, (s, c) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("tile", [7, 1024])
def test_topk_against_brute_force_with_ties(spark, tile):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in np.round(rng.standard_normal(4), 1)]) for i in range(160)] + [(i, [0.5, 0.5, 0.5, 0.5]) for i in range(160, 230)] + [(400, [1.0, 2.0]), (401, [1.0, -2.0])]
    bad = [(500, None), (501, [None, 1.0, 1.0, 1.0]), (502, [float("nan")] * 4), (503, [float("inf")] * 4), (None, [1.0] * 4)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>").withColumn("score", F.lit("mine")).repartition(5)
    got = topk.search(df, F.col("vec_id") % 50 == 0, block_rows=3, tile_rows=tile)
    want = brute_topk([(i, np.array(e, np.float32)) for i, e in rows])
    assert sorted(map(tuple, got.collect())) == want
    assert topk.search(df.where("false"), F.col("vec_id") % 50 == 0).collect() == []


def test_topk_beyond_doubles_and_fewer_than_k(spark):
    rows = [(0, [1e7, 1.0]), (1, [1e7, 1.0]), (2, [1e7, 2.0])]
    got = topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0).collect()
    assert [tuple(r) for r in got] == brute_topk(rows)
    assert topk.scores(np.array([[1e30]]), np.array([[1e30]]))[0, 0] == np.iinfo(np.int64).max


# --- byte-level BPE

PATH = P.path("byte_bpe_multi_50k.tiktoken")


def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def strange_texts(n=800):
    rng = random.Random(2)
    letters = list("abcdefg hijk  \n\t'srtvemld 0123!?.,|é ß日本語́\x85\xa0\x1c 🙂\x00") + ["<|endoftext|>"]
    return ["".join(rng.choice(letters) if rng.random() < 0.9 else chr(rng.randrange(0xE000, 0x11000)) for _ in range(rng.randrange(60))) for _ in range(n)]


def test_byte_bpe_equals_the_library_and_round_trips(spark):
    enc = reference()
    texts = [None, "", " ", LONG, "a" * 3000, *strange_texts()]
    out = encode_documents(docs(spark, texts), PATH, P.PATTERN).orderBy("doc_id").collect()
    assert len(out) == len(texts)
    for t, r in zip(texts, out):
        want = np.array(enc.encode_ordinary(t or ""), "<u4").tobytes()
        assert (bytes(r.ids), r.n_tokens, r.ids_sha256) == (want, len(want) // 4, hashlib.sha256(want).hexdigest())
        assert bytes(r.decoded) == (t or "").encode()
    assert encode_documents(docs(spark, []), PATH, P.PATTERN).collect() == []


def test_model_is_serialised_in_order():
    bpe = ByteBPE(PATH, P.PATTERN)
    assert bpe.pieces == bpe.tokens and bpe.model.vocab_size() == len(bpe.tokens) + 1
    assert serialise_model([b"a", b"b"]) == serialise_model([b"a", b"b"])


# --- PII


def test_pseudonyms_keep_format_and_link_equal_values(spark):
    texts = ["mail Jo.42@mail8.example.com from 42.144.35.254", "again jo.42@mail8.example.com, Jo.42@mail8.example.com", "card 4041894974608795 and 4041-8949-7460-8795 not 4041894974608796",
             "born 1984-02-29 or 29/02/1984, not 1985-02-29", "GB82 WEST 1234 5698 7654 32", "ssn 123-45-6789 not 000-45-6789", "+1 (988) 555-2485", "999.1.1.1 and 4.0.", None, "", LONG + "5@x.org"]
    out = pii.pseudonymise(docs(spark, texts), "k").orderBy("doc_id").collect()
    text = [r.text for r in out]
    shape = lambda t: re.sub(r"[0-9]", "9", re.sub(r"[a-z]", "a", re.sub(r"[A-Z]", "A", t)))
    assert [r.n_pii for r in out] == [2, 2, 2, 2, 1, 1, 1, 0, 0, 0, 1] and out[0].n_lines == "mine"
    assert all(shape(a) == shape(b) for k, (a, b) in enumerate(zip(texts, text)) if a and k != 0)
    assert text[0].split()[1] == text[1].split()[2] != "Jo.42@mail8.example.com"
    cards = re.findall(r"[\d-]{16,}", text[2])
    assert cards[0] == cards[1].replace("-", "") != "4041894974608795" and cards[2] == "4041894974608796"
    luhn = lambda s: sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(s))) % 10
    assert luhn(cards[0]) == 0
    day = re.findall(r"\d{4}-\d\d-\d\d", text[3])
    assert day[0] != "1984-02-29" and day[1] == "1985-02-29" and "/".join(reversed(day[0].split("-"))) in text[3]
    iban = text[4].replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    assert "000-45-6789" in text[5] and text[7:10] == texts[7:10]
    assert [r.text for r in pii.pseudonymise(docs(spark, texts), "other").orderBy("doc_id").collect()][6] != text[6]
    assert pii.pseudonymise(docs(spark, []), "k").collect() == []


def test_cards_and_ibans_next_to_other_numbers(spark):
    card, iban = "4041894974608795", "ES9121000418450200051332"
    texts = [f"{card} 123", "4041 8949 7460 8795 12/27", f"{iban} 2021", "ES91 2100 0418 4502 0005 1332 2021 20", f"{card} 12 {card} 12", f"77 {card}", f"{card} 12/05/1984", f"{iban} 2021-02-03", "4041894974608796 123", f"{card} 123 \ufdd0"]
    out = pii.pseudonymise(docs(spark, texts), "k").orderBy("doc_id").collect()
    new = pii.pseudonymise(docs(spark, [card, iban]), "k").orderBy("doc_id").collect()
    new_card, new_iban = (r.text for r in new)
    assert out[0].text == f"{new_card} 123" and out[2].text == f"{new_iban} 2021" and out[5].text == f"77 {new_card}"
    assert out[1].text.replace(" ", "") == f"{new_card}12/27" and out[3].text.replace(" ", "") == f"{new_iban}202120"
    assert out[4].text == f"{new_card} 12 {new_card} 12" and out[9].text == f"{new_card} 123 \ufdd0"
    assert out[6].text.startswith(f"{new_card} ") and out[7].text.startswith(f"{new_iban} ") and out[8].text == texts[8]
    assert [r.n_pii for r in out] == [1, 1, 1, 1, 2, 1, 2, 2, 0, 1] and [r.n_date for r in out][6:8] == [1, 1]


def test_permutations_are_one_to_one(spark):
    n = spark.range(1000).select(pii.permuted(F.lpad(F.col("id").cast("string"), 3, "0"), "k", "x").alias("p"))
    assert {r.p for r in n.collect()} == {f"{i:03}" for i in range(1000)}
    m = spark.range(4096).select(pii.permuted_number(F.col("id"), 64, "k", "x").alias("p"))
    assert {r.p for r in m.collect()} == set(range(4096))


# --- quality rules


def brute_counts(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    c = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    covered = {k + j for k in range(len(w) - 2) if c[tuple(w[k : k + 3])] > 1 for j in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)


def test_rules_count_like_brute_force_and_find_junk(spark):
    rng = random.Random(3)
    good = [prose(rng, 120) for _ in range(80)]
    junk = [" ".join(x + "%%%" for x in prose(rng, 100).split()) for _ in range(8)] + [prose(rng, 90).upper().replace(" ", "!! ") for _ in range(8)]
    odd = [None, "", " \n\t", "a b c a b c", "x\nx\nx", "a b\xa0c\x1cd " * 30, LONG, prose(rng, 40)]
    texts = good + junk + odd + good[:2]
    got = quality_rules.judge(docs(spark, texts).drop("n_lines").withColumn("source", F.lit("s"))).orderBy("doc_id").collect()
    for t, r in zip(texts, got):
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_counts(t)
    assert all(r.kept for r in got[:80]) and not any(r.kept for r in got[80:96])
    assert quality_rules.judge(docs(spark, []).drop("n_lines")).collect() == []


def test_expectation_maximisation_finds_the_accuracies_that_votes_were_drawn_with(spark):
    """Votes of four rules, drawn from a good class and two kinds of junk: shares, bad-vote rates and posteriors come back,
    and the posterior errs less than rejecting whatever one rule calls bad."""
    rng = random.Random(11)
    share, rates = [0.85, 0.1, 0.05], [[0.02, 0.03, 0.01, 0.02], [0.95, 0.02, 0.6, 0.02], [0.02, 0.9, 0.02, 0.7]]
    rows = []
    for _ in range(20_000):
        c = rng.choices(range(3), share)[0]
        rows.append((c, tuple(0 if rng.random() < 0.2 else -1 if rng.random() < rates[c][j] else 1 for j in range(4))))
    counts = Counter(v for _, v in rows)
    model = quality_rules.fit(sorted(counts.items()))
    df = spark.createDataFrame([(*v, i) for i, v in enumerate(counts)], "a int, b int, c int, d int, i int")
    got = [r.p for r in df.select("i", model.probability(["a", "b", "c", "d"]).alias("p")).orderBy("i").collect()]
    posterior = dict(zip(counts, got))

    def true(v):
        z = [share[c] * np.prod([1 if x == 0 else rates[c][j] if x < 0 else 1 - rates[c][j] for j, x in enumerate(v)]) for c in range(3)]
        return z[0] / sum(z)

    apart = sum(n * abs(posterior[v] - true(v)) for v, n in counts.items()) / len(rows)
    wrong = lambda keep: sum(n for (c, v), n in Counter(rows).items() if keep(v) != (c == 0))
    assert apart < 0.02 and wrong(lambda v: posterior[v] >= 0.5) < 0.85 * wrong(lambda v: -1 not in v)
    assert wrong(lambda v: posterior[v] >= 0.5) <= 1.2 * wrong(lambda v: true(v) >= 0.5)


def test_repeated_windows_of_either_path(spark):
    rows = [(0, [5, 7, 5, 9, 7]), (1, [1 << 40, (1 << 40) + 1, 1 << 40]), (2, []), (3, [4, 4, 4])]
    df = spark.createDataFrame(rows, "id int, w array<long>").select("id", quality_rules._repeated("w").alias("p"))
    assert {r.id: list(r.p) for r in df.collect()} == {0: [0, 1, 2, 4], 1: [0, 2], 2: [], 3: [0, 1, 2]}


# --- near duplicates


def brute_components(rows, size, percent=80):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        n = min(size, len(w))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set()
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in sets:
        for j in sets:
            if j < i and sets[i] and sets[j]:
                n = len(sets[i] & sets[j])
                if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                    a, b = sorted((find(i), find(j)))
                    top[b] = a
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


def edited(rng, text, share):
    return " ".join(w if rng.random() > share else w + "x" for w in text.split())


@pytest.mark.parametrize("size", [4, 5])
def test_near_duplicates_against_brute_force(spark, size):
    rng = random.Random(size)
    base = [prose(rng, 120) for _ in range(8)]
    texts = [None, "", " \t", "one", "One ", "one two", LONG, LONG.upper(), *base]
    texts += [edited(rng, b, s) for b in base[:4] for s in (0.01, 0.02, 0.03, 0.05, 0.08)] + [edited(rng, base[5], 0.02) for _ in range(40)]
    chain = base[6]
    for _ in range(12):
        chain = edited(rng, chain, 0.02)
        texts.append(chain)
    shared = prose(rng, 100)
    texts += [shared + " " + prose(rng, 90) for _ in range(30)] + [base[7]] * 5
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    df = docs(spark, [t for _, t in rows] + [texts[3], "no id"], [i for i, _ in rows] + [3, None])
    out = near_duplicates(df, size=size).collect()
    assert len(out) == len(rows) + 2 and out[0].n_lines == "mine"
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in out}
    assert got.pop(None) == (0, None, True)
    assert got == brute_components(rows, size)


def test_near_duplicates_of_nothing(spark):
    assert near_duplicates(docs(spark, [])).collect() == []
    assert [tuple(r)[-3:] for r in near_duplicates(docs(spark, [None])).collect()] == [(0, 0, True)]


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 130), 100), 200: 200, 201: 200}


# --- secrets


def plain_spans(t):
    pattern = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    want = [("assign", *m.span()) for m in pattern.finditer(t) if len(m[2]) >= 6]
    want += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    want += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(want, key=lambda s: (s[1], ["assign", "access", "hex"].index(s[0])))


def test_base_spans_and_held_out_secrets(spark):
    rng = random.Random(4)
    key = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    texts = [f"{prose(rng, 20)} PassWord: {key(18)} {prose(rng, 20)} mail8 in 2020" for _ in range(60)] + [f"{prose(rng, 9)} token = \"{key(40)}\" {prose(rng, 9)}" for _ in range(60)]
    odd = [None, "", "password=short token:", "AKIA" + "A" * 15, "AKIA" + "B" * 16, "é api-key: apikey='abcdef' api_key: abc.def-", "a" * 23 + " " + "b" * 24, "paſsword=abcdefgh", LONG + "secret=abcdef1", texts[0]]
    df = docs(spark, texts + odd).withColumn("source", F.lit("s1"))
    out = secrets.scan_secrets(df, with_text=True, carry=True).orderBy("doc_id").collect()
    for t, r in zip(texts + odd, out):
        t = t or ""
        assert [tuple(s) for s in r.base] == plain_spans(t)
        assert {tuple(s) for s in r.base} <= {tuple(s) for s in r.all_spans}
        assert all(t[s.start : s.end] not in r.redacted for s in r.base if s.kind != "assign") and r.in_n_lines == "mine"
    model = secrets.train(df)
    held = [f"{prose(rng, 9)} password={key(18)} {prose(rng, 9)}" for _ in range(50)]
    hits = sum(any(tags) for t in held for w in secrets.windows(t, "s1", model.codes) for tags in [model.viterbi(w)])
    clean = [f"{prose(rng, 9)} room 12 in 2021 {prose(rng, 9)}" for _ in range(50)]
    false = sum(any(model.viterbi(w)) for t in clean for w in secrets.windows(t, "s1", model.codes))
    assert hits >= 45 and false <= 2
    assert secrets.scan_secrets(docs(spark, [])).collect() == []


def test_secrets_with_tokens_of_letters_alone_are_found_whole(spark):
    rng = random.Random(9)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    made = lambda n, of: "".join(rng.choice(of) for _ in range(n))
    key = lambda: rng.choice([made(24, letters), "/".join(made(rng.randint(7, 18), letters + "0123456789" * (k == 1)) for k in range(3))])
    fill = [f"{prose(rng, 9)} token = \"{key()}\" {prose(rng, 9)}" for _ in range(150)] + [f"{prose(rng, 9)} \"{prose(rng, 3)}\" in 2020" for _ in range(150)]
    model = secrets.train(docs(spark, fill).withColumn("source", F.lit("s1")))
    held = ["wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY"] + [key() for _ in range(40)] + [made(24, letters) for _ in range(10)]
    texts = [f"{prose(rng, 9)} token -> \"{k}\" {prose(rng, 9)}" for k in held]
    whole = [[t[a:b] for a, b in secrets.learned_spans(model, t, "s1", [])] == [k] for t, k in zip(texts, held)]
    assert whole[0] and sum(whole[1:41]) >= 36 and sum(whole[41:]) >= 8
    clean = [f"{prose(rng, 9)} said \"{prose(rng, 4)}\" and {made(1, letters)}cDonald in 2021" for _ in range(50)]
    assert sum(bool(secrets.learned_spans(model, t, "s1", [])) for t in clean) <= 2


def test_all_windows_of_sampled_documents_train(spark, monkeypatch):
    rng = random.Random(2)
    long = " ".join(f"{prose(rng, 30)} in 2020" for _ in range(60)) + " token = abcdef123456"
    seen, stash = {}, secrets.stash
    monkeypatch.setattr(secrets, "stash", lambda df, name: seen.setdefault(name, stash(df, name)))
    monkeypatch.setattr(secrets, "minimised", lambda value, x, rounds: x)
    secrets.train(docs(spark, [long, f"{long} password: qwerty987654"]), sample=2)
    kinds = {r.kind: r.n for r in seen["stretches"].groupBy("kind").agg(F.count("*").alias("n")).collect()}
    assert sum(kinds.values()) > 100 and kinds[1] >= 2 and kinds[2] and kinds[3] and kinds[0]


@pytest.fixture(scope="module")
def taught(spark):
    """A field trained on the documents of sf0.1, and clean texts of those to write into."""
    df = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    clean = [r.text for r in df.where("length(text) BETWEEN 200 AND 3000 AND NOT text RLIKE '[0-9]'").orderBy("doc_id").limit(200).collect()]
    return secrets.train(df), clean


def written(text, item):
    at = text.find(" ", len(text) // 2)
    return f"{text[:at]} {item}{text[at:]}"


def found(model, text):
    return secrets.learned_spans(model, text, "src1", [(a, b) for _, a, b, _ in secrets.base_spans(text)])


LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
FORMS = {
    "known names": (["the password is {}", "client_secret {}", "AWS_SECRET_ACCESS_KEY {}", "pwd: {}", "sk_live_{}", "my passphrase -> {}", "credentials={}", "auth {} here", "Bearer {}", "private key '{}'"], (16, 40), 0.95),
    "other names": (["db_pwd {}", "master passcode {}", "webhook secret is {}", "PGPASSWORD={}", "license key: {}", "oauth {}", "session token was {}", "root login {}", "the pin phrase {}"], (16, 40), 0.9),
    "no name": (["{}", "and {} then"], (20, 40), 0.8),
    "short": (["the password is {}", "password {}", "pwd: {}", "my passphrase is {}"], (8, 8), 0.9),
}


@pytest.mark.parametrize("kind", FORMS)
def test_secrets_that_no_base_pattern_finds_are_found_whole(taught, kind):
    model, clean = taught
    rng, (forms, (low, high), least) = random.Random(5), FORMS[kind]
    hits = 0
    for i in range(100):
        key = "".join(rng.choice(LETTERS) for _ in range(rng.randint(low, high)))
        text = written(clean[i], forms[i % len(forms)].format(key))
        if secrets.base_spans(text):  # so many digits by chance
            hits += 1
            continue
        a = text.index(key)
        hits += any(p <= a and q == a + len(key) for p, q in found(model, text))
    assert hits >= 100 * least


def test_lower_case_passphrases_after_a_name_are_found(taught):
    model, clean = taught
    words = "hunterdragon bluemonkey correcthorse summerrain letmeinplease opensesame silverfox purpleelephant coldcoffee quietriver".split()
    forms = ["the password is {}", "passphrase {}", "pwd: {}", "my passphrase was {}", "login {}"]
    texts = [(written(clean[i], forms[i % 5].format(w)), w) for i, w in enumerate(words * 5)]
    hits = sum((t.index(w), t.index(w) + len(w)) in found(model, t) for t, w in texts)
    print(hits)
    assert hits >= 45


ORDINARY = {
    "path": "/usr/local/lib/python3.11/site-packages/numpy/core.py /home/user/src/main/App.tsx ./build/output/report2.csv /var/log/nginx/access.log /opt/data/v2/models/weights.bin",
    "link": "https://example.com/watch?v=dQw4w9WgXcQ https://github.com/apache/spark/pull/48211 http://www.site.org/a/b/c123.html https://docs.foo.io/en/v2.1/api.html#get_item https://shop.example.net/item/8f3Kd92LxQ",
    "doi": "10.1038/s41586-020-2649-2 10.1145/3292500.3330701 10.1000/xyz123 10.1103/PhysRevLett.116.061102 10.48550/arXiv.1706.03762",
    "uuid": "123e4567-e89b-12d3-a456-426614174000 550e8400-e29b-41d4-a716-446655440000 f47ac10b-58cc-4372-a567-0e02b2c3d479 C9A646D3-9C61-4CB7-BFCD-EE2522C8F633 7d444840-9dc0-11d1-b245-5ffdce74fad2",
    "version": "v1.24.3-rc2 2.0.0+build.1848 numpy==1.26.4 3.11.0b5 openssl-3.0.2",
    "mail": "anna.smith@example.com info@uni-bonn.de j_doe42@mail.co.uk support@github.com a.b.c@d.org",
    "code": "getElementById XMLHttpRequest MAX_RETRY_COUNT parse_json_file() isinstance(obj)",
    "number": "2021-03-14T09:26:53Z 978-3-16-148410-0 INV-2021-00042 00:1B:44:11:3A:B7 arXiv:1706.03762v5",
    "word": "Donaudampfschifffahrtsgesellschaft internationalization Rechtsschutzversicherungsgesellschaften antidisestablishmentarianism McDonald",
}


def test_ordinary_items_are_no_secrets(taught):
    model, clean = taught
    leads, wrong, n = ["see", "as in", "from", "the id is", "at"], [], 0
    for kind, items in ORDINARY.items():
        for i in range(30):
            text = written(clean[i], f"{leads[i % 5]} {items.split()[i % 5 if i < 25 else i % 3]}")
            n += 1
            wrong += [(kind, text[a:b]) for a, b in found(model, text)[:1]]
    for i, sentence in enumerate(["the password was changed yesterday", "a token of thanks", "the key to success is patience", "please reset your password before Monday", "secret agents met at noon"] * 6):
        n += 1
        wrong += [("sentence", sentence)] if found(model, written(clean[i], sentence)) else []
    wrong += [("clean", t[:40]) for t in clean if found(model, t)]
    assert len(wrong) <= 0.02 * (n + len(clean)), wrong


def test_redaction_leaves_ordinary_items(spark, taught):
    model, clean = taught
    text = written(clean[0], "see https://example.com/watch?v=dQw4w9WgXcQ and doi 10.1000/xyz123 with id 123e4567-e89b-12d3-a456-426614174000 but token = abcdef123456")
    (row,) = secrets.scan_secrets(spark.createDataFrame([(1, text, "src1")], "doc_id long, text string, source string"), model, with_text=True).collect()
    assert row.redacted == text.replace("abcdef123456", "<secret>")


def test_viterbi_and_gradient_against_enumeration():
    from itertools import product

    rng = np.random.default_rng(6)
    model = secrets.Field(4, rng.standard_normal((16, 3)), rng.standard_normal((3, 3)))
    cases = [([[1, 2], [3], [4, 5], [6]], [True, True, False, True], [0, 1, 0, 1]), ([[7]], [True], [1]), ([[1], [2, 8], [3]], [True, True, True], [1, 2, 0])]
    loss, by_weights, by_steps = 0.0, np.zeros((16, 3)), np.zeros((3, 3))
    for features, may, tags in cases:
        n = len(tags)
        w = secrets.Window([(0, 1)] * n, features, np.array(may))
        s, t = model.scores(w), np.where(model.BARRED, -1e9, model.steps)
        total = lambda y: s[range(n), y].sum() + sum(t[a, b] for a, b in zip(y, y[1:]))  # noqa: E731, B023
        ways = [list(y) for y in product(range(3), repeat=n)]
        assert model.viterbi(w) == max(ways, key=total)
        p = np.exp([total(y) for y in ways])
        loss += np.log(p.sum()) - total(tags)
        for y, q in [*zip(ways, p / p.sum()), (tags, -1.0)]:
            for i, tag in enumerate(y):
                by_weights[features[i], tag] += q
            for a, b in zip(y, y[1:]):
                by_steps[a, b] += q
    flat = [x for features, _, _ in cases for f in features for x in f]
    counts = [len(f) for features, _, _ in cases for f in features]
    got = secrets.batch_gradient(model.weights, model.steps, np.array(flat), np.array(counts), np.array([4, 1, 3]), np.array([m for _, may, _ in cases for m in may]), np.array([y for _, _, tags in cases for y in tags]))
    assert got[0] == pytest.approx(loss) and got[1] == pytest.approx(by_weights, abs=1e-9) and got[2] == pytest.approx(by_steps, abs=1e-9)
    equal = secrets.Window([(0, 1)] * 2, [[1], [1]], np.array([True, True]))
    assert secrets.Field(4).viterbi(equal) == [0, 0]  # of equal ways the one with the least tags


def test_minimiser_finds_the_least_value():
    rng = np.random.default_rng(0)
    a = rng.standard_normal((30, 12))
    value = lambda x: (float(np.logaddexp(0, a @ x).sum() + x @ x), a.T @ (1 / (1 + np.exp(-(a @ x)))) + 2 * x)
    x = secrets.minimised(value, np.zeros(12), 100)
    assert np.abs(value(x)[1]).max() < 0.1 and value(x)[0] < value(np.zeros(12))[0]


# --- binary output


def test_slots_are_a_permutation():
    for n in (1, 2, 3, 64, 65, 4097):
        assert sorted(token_shards.slots(np.arange(n), n, 9).tolist()) == list(range(n))
    assert token_shards.slots(np.arange(999), 999, 1).tolist() != token_shards.slots(np.arange(999), 999, 2).tolist()


def brute_slot(index, n, key):
    """The keyed permutation by Python's integers, one value at a time."""
    big = 2**64

    def mix(x):
        for shift, odd in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> shift)) * odd % big
        return x ^ (x >> 31)

    half = 1
    while 4**half < n:
        half += 1
    while True:
        left, right = divmod(index, 2**half)
        for r in range(6):
            draw = mix(mix((right + key * 0x9E3779B97F4A7C15 + r) % big) ^ key % big)
            left, right = right, left ^ draw % 2**half
        index = left * 2**half + right
        if index < n:
            return index


def test_slots_against_brute_force():
    for n, key in ((1, 1), (2, 7), (5, 3), (64, 2**70 + 1), (1000, 9), (4097, 1)):
        assert token_shards.slots(np.arange(n), n, key).tolist() == [brute_slot(i, n, key) for i in range(n)]


def brute_shards(spark, rows, window, key):
    """All records in order of their slots, and what each row of the result should say, from (doc_id, text)."""
    enc = reference()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    n_blocks = max(-(-len(rows) // token_shards.BLOCK_DOCS), 1)
    hashed = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id"))
    blocks = {}
    for r in df.select("doc_id", "text", F.pmod(hashed, F.lit(n_blocks)).alias("b")).collect():
        blocks.setdefault(r.b, []).append(((r.doc_id is not None, r.doc_id or 0, r.text is not None, (r.text or "").encode()), r.doc_id, r.text))
    records = []
    for b in sorted(blocks):
        stream = [(x, doc, k) for k, (_, doc, text) in enumerate(sorted(blocks[b], key=lambda x: x[0])) for x in [*enc.encode_ordinary(text or ""), 50256]]
        for at in range(0, len(stream), window):
            part = stream[at : at + window]
            ids = np.array([x for x, _, _ in part] + [50256] * (window - len(part)), "<u2").tobytes()
            records.append((ids, part[0][1], len({k for _, _, k in part}), len(part)))
    slots = [brute_slot(i, len(records), key) for i in range(len(records))]
    data = b"".join(r[0] for _, r in sorted(zip(slots, records), key=lambda x: x[0]))
    return data, sorted((i, s, r[1], r[2], r[3], zlib.crc32(r[0])) for i, (s, r) in enumerate(zip(slots, records)))


def test_shards_against_brute_force_however_partitioned(spark):
    texts = [None, "", *strange_texts(600), LONG[:5000], " " * 5000 + "x", "\n" * 3000]
    rows = [*enumerate(texts), (3, texts[3]), (None, "no id"), (None, None), (4, "another text of one id")]
    want, of_rows = brute_shards(spark, rows, 64, 5)
    for parts in (1, 5):
        df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("slot", F.lit("mine")).repartition(parts)
        path, out = token_shards.materialise(df, PATH, P.PATTERN, window=64, per_shard=10, key=5)
        got = out.collect()
        assert sorted(tuple(r[c] for c in ("sequence", "slot", "doc_id", "n_docs", "n_tokens", "ids_crc32")) for r in got) == of_rows
        assert all((r.shard, r.record) == divmod(r.slot, 10) for r in got)
        seqs = token_shards.read_sequences(spark, path, 0, len(got))
        assert b"".join(s.tobytes() for s in seqs) == want
        assert all((a == b).all() for a, b in zip(token_shards.read_sequences(spark, path, 7, 9), seqs[7:16]))
        files = [r for r in spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).collect() if "shard=" in r.path]
        assert len(files) == -(-len(got) // 10) and sum(r.length for r in files) == len(want) + len(files)
    assert token_shards.materialise(docs(spark, []), PATH, P.PATTERN)[1].collect() == []


# --- packing


def brute_bfd(lengths, window):
    left = []
    for n in sorted(lengths, reverse=True):
        fits = [(r, i) for i, r in enumerate(left) if r >= n]
        if fits:
            left[min(fits)[1]] -= n
        else:
            left.append(window - n)
    return sorted(left)


def test_plan_is_best_fit_decreasing():
    rng = random.Random(5)
    for _ in range(200):
        window = rng.choice([1, 8, 16, 40])
        lengths = [rng.randint(1, window) for _ in range(rng.randrange(60))]
        spans = {}
        for n, _, k, first, each, offset in plan(Counter(lengths), window):
            for i in range(k):
                spans.setdefault(first + i // each, []).append((offset + i % each * n, n))
        for s in spans.values():
            s.sort()
            assert [a for a, _ in s] == [sum(n for _, n in s[:i]) for i in range(len(s))]
        assert sorted(window - sum(n for _, n in s) for s in spans.values()) == brute_bfd(lengths, window)


def test_open_windows():
    tree = OpenWindows(10)
    for c in (3, 7, 7):
        tree.push(c, 0, 1)
    assert [tree.tightest(n) for n in (1, 3, 4, 7, 8)] == [3, 3, 7, 7, None]


def test_packing_covers_every_token(spark):
    path = P.path("word_bpe_49k.json")
    model = Tokenizer.from_file(path)
    model.encode_special_tokens = True
    texts = [None, "", LONG[:4000], *strange_texts(80), "same text here"] + ["same text here"] * 9
    df = docs(spark, texts).withColumn("offset", F.lit("mine"))
    out = pack_documents(df, path, window=32).collect()
    pieces, sequences = {}, {}
    for r in out:
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, t in enumerate(texts):
        ids = [*model.encode(t or "", add_special_tokens=False).ids, 2]
        mine = sorted(pieces[i], key=lambda r: r.start)
        assert np.frombuffer(b"".join(bytes(r.ids) for r in mine), "<u4").tolist() == ids and mine[0].doc_tokens == len(ids)
        assert [r.start for r in mine] == [sum(x.length for x in mine[:k]) for k in range(len(mine))]
    for s in sequences.values():
        s.sort()
        assert [a for a, _ in s] == [sum(n for _, n in s[:k]) for k in range(len(s))] and sum(n for _, n in s) <= 32
    assert sorted(32 - sum(n for _, n in s) for s in sequences.values()) == brute_bfd([r.length for r in out], 32)
    assert sorted(sequences) == list(range(len(sequences)))
    assert pack_documents(docs(spark, []), path).collect() == []
