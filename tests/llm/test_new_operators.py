"""Fill-in-the-middle, exponion clustering and benchmark decontamination against brute force, on odd rows too; and tokens of
every letter before every mark."""

import hashlib
import random
import re

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from steadfold.llm import decontaminate as wm
from steadfold.llm import exponion
from steadfold.llm.fill_middle import fill_in_middle, restore
from steadfold.llm.packing import tokenizer
from steadfold.llm.queries import QUERIES

from ..conftest import SF

CLASHES = "n form output h text_ k1 k2 copies first second a b pos unit ids kind vectors tile cluster distance n_words hits items n_hit item words".split()


def odd(df):
    return df.select("*", *[F.lit("mine").alias(c) for c in CLASHES])


# --- fill-in-the-middle


def brute_middle(doc_id, text, plain_percent=50):
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    n, digest = len(units), hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 100 - plain_percent:
        return doc_id, n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h[3] % 100 < 80 else "psm"
    return doc_id, n, form, len(p), len(m), f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"


def test_middles_against_brute_force(spark):
    rng = random.Random(5)
    texts = [None, "", " ", " \n\t ", "one", "  two words ", "a <P> b", "<S", "x<M>", "é ü ñ 日本 😀 end", "word " * 30_000, " " * 5_000 + "x"]
    texts += ["".join(rng.choice("ab \n\té😀<P>S") for _ in range(rng.randrange(60))) for _ in range(150)]
    rows = list(enumerate(texts)) + [(None, "a b c d"), (None, None), (9, texts[9]), (9, texts[9]), (5, "same id, other text")]
    df = odd(spark.createDataFrame(rows, "doc_id long, text string"))
    for percent in (50, 0):
        out = fill_in_middle(df, plain_percent=percent).withColumn("back", restore(F.col("output"), F.col("form"))).collect()
        got = sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in out), key=str)
        assert got == sorted((brute_middle(i, t, percent) for i, t in rows), key=str)
        assert sorted((str(r.doc_id), r.back) for r in out) == sorted((str(i), t or "") for i, t in rows)
    assert {"plain", "psm", "spm"} == {r.form for r in out}
    assert fill_in_middle(df.where("false")).collect() == []


def test_many_copies_of_one_row_are_cut_once_a_partition(spark):
    rows = [(3, "some words of a text that comes very often")] * 500 + [(i, f"text {i} of few") for i in range(100, 120)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    out = fill_in_middle(df, plain_percent=0)
    assert out.where("doc_id = 3").count() == 500 and out.select("output").where("doc_id = 3").distinct().count() == 1 and out.count() == 520


def test_no_middle_join_is_an_exchange(spark):
    df = spark.createDataFrame([(i, "a b c d e") for i in range(50)], "doc_id long, text string")
    plan = fill_in_middle(df, plain_percent=0)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "SortMergeJoin" in plan


# --- exponion


def brute_means(rows, k, rounds, scale, seed):
    kept = [(i, [int(np.floor(scale * float(x))) for x in v]) for i, v in rows]
    order = sorted((i is None, hashlib.sha256(f"{seed}:{i}".encode()).hexdigest() if i is not None else "", v) for i, v in kept)
    points = [v for _, _, v in order[:k]]
    assign = lambda v: min((sum((x - y) ** 2 for x, y in zip(v, c)), a) for a, c in enumerate(points))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(assign(v)[1], []).append(v)
        points = [[sum(x) // len(groups[a]) for x in zip(*groups[a])] if a in groups else c for a, c in enumerate(points)]
    return sorted(((i, assign(v)[1], assign(v)[0]) for i, v in kept), key=str), points


def test_clusters_against_brute_force(spark):
    rng = np.random.default_rng(3)
    for values in (rng.integers(-3, 4, (300, 3)) / 4, np.repeat(rng.integers(0, 2, (10, 3)), 20, axis=0) / 1.0, rng.normal(size=(200, 3)) * [1, 1e6, 1e-3]):
        rows = [(i, [float(x) for x in v]) for i, v in enumerate(values)]
        rows += [(7, rows[7][1]), (None, [0.25, 0.5, 0.75])]
        dirty = [(500, None), (501, [1.0, None, 2.0]), (502, [1.0, float("nan"), 0.0]), (503, [float("inf"), 0.0, 0.0]), (504, [1.0, 2.0]), (505, [])]
        df = odd(spark.createDataFrame(rows + dirty, "vec_id long, embedding array<double>")).repartition(3)
        out, points = exponion.cluster_vectors(df, k=5, rounds=6, scale=8.0, dims=3, tile_rows=64)
        want, centroids = brute_means(rows, 5, 6, 8.0, 3)
        assert sorted(((r.vec_id, r.cluster, r.distance) for r in out.collect()), key=str) == want and points == centroids


def test_clusters_of_few_and_of_far_vectors(spark):
    schema = "vec_id long, embedding array<double>"
    assert exponion.cluster_vectors(spark.createDataFrame([], schema), dims=2)[0].collect() == []
    rows = [(1, [1e30, 0.0]), (2, [1e30, 1.0]), (3, [-1e30, 5e-324])]
    out, points = exponion.cluster_vectors(spark.createDataFrame(rows, schema), k=8, rounds=2, dims=2)
    got = {r.vec_id: (r.cluster, r.distance) for r in out.collect()}
    assert len(points) == 3 and len({c for c, _ in got.values()}) == 3 and {d for _, d in got.values()} == {0}


def test_bounds_spare_most_of_the_search(spark, monkeypatch):
    rng = np.random.default_rng(0)
    vectors = np.concatenate([rng.normal(size=(200, 4)) + 40 * c for c in np.eye(4)]) * 16 // 1
    points, measured = [[int(x) for x in vectors[200 * i]] for i in range(4)], []
    plain = exponion.squared
    monkeypatch.setattr(exponion, "squared", lambda v, c: measured.append(len(v)) or plain(v, c))
    state, before = (np.zeros(800, np.int64), np.full(800, np.inf), np.zeros(800)), None
    costs = []
    for _ in range(5):
        measured.clear()
        state = exponion.step(vectors, *state, exponion.Centroids.of(points, before))
        costs.append(sum(measured))
        before, points = points, [[int(x) for x in vectors[state[0] == a].mean(axis=0) // 1] for a in range(4)]
    assert costs[0] > 1600 and costs[-1] < 100


# --- decontamination


def brute_hits(docs, items, size):
    lower = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    windows = {}
    for i, t in items:
        w = lower(t)
        for at in range(max(1, len(w) - size + 1)) if w and i is not None else ():
            windows.setdefault(tuple(w[at : at + size]), set()).add(str(i))
    out = []
    for i, t in docs:
        w, hit, found = lower(t), set(), set()
        for at in range(len(w)):
            for n in range(1, size + 1):
                if at + n <= len(w) and (names := windows.get(tuple(w[at : at + n]))):
                    hit |= set(range(at, at + n))
                    found |= names
        out.append((i, len(w), len(hit), sorted(found)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block_bytes", [1 << 20, 300])
def test_windows_against_brute_force(spark, block_bytes):
    rng = random.Random(2)
    word = lambda: rng.choice(["a", "B", "ab", "ba", "é", "É", "日本", "x1", "long" * 5, "the", "of"])
    text = lambda n: "".join(word() + rng.choice([" ", "  ", "\n", "-", ", ", "_", "\x7f", "."]) for _ in range(n))
    items = [(i, text(rng.choice([1, 2, 3, 5, 8, 30]))) for i in range(25)] + [(3, "another text of the same item"), (None, "a B"), (40, None), (41, ""), (42, " ,. "), (43, "日本")]
    docs = [(i, text(rng.randrange(120))) for i in range(40)] + [(50, None), (51, ""), (52, "..."), (None, text(30)), (5, "dup"), (5, "dup")]
    docs += [(60 + k, f"{text(5)} {items[k][1].upper() if k % 2 else items[k][1]} {text(5)}") for k in range(12)] + [(80, text(20_000)), (81, items[5][1])]
    df = odd(spark.createDataFrame(docs, "doc_id long, text string")).repartition(3)
    bench = odd(spark.createDataFrame(items, "item_id long, text string"))
    out = wm.decontaminate(df, bench, size=5, block_bytes=block_bytes).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in out), key=str) == brute_hits(docs, items, 5)
    assert all(r.n_hit == sum(h.last - h.first + 1 for h in r.hits) for r in out)


def test_no_benchmark_and_no_documents(spark):
    docs = spark.createDataFrame([(1, "some words")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    (row,) = wm.decontaminate(docs, none).collect()
    assert (row.n_words, row.n_hit, row["items"]) == (2, 0, [])
    assert wm.decontaminate(docs.where("false"), docs.withColumnRenamed("doc_id", "item_id")).collect() == []


def test_long_items_are_whole_in_overlapping_pieces(spark):
    words = [f"w{i}" for i in range(10_000)]
    items = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    docs = spark.createDataFrame([(i, " ".join(words[at : at + 10])) for i, at in enumerate((0, 4087, 4090, 4095, 4096, 8190, 9990))] + [(99, " ".join(words[9991:]))], "doc_id long, text string")
    assert {r.doc_id: r.n_hit for r in wm.decontaminate(docs, items).collect()} == {**{i: 10 for i in range(7)}, 99: 0}


def test_search_skips_most_places():
    text = wm.flat_words([("word " * 3 + "quite other things stand here ").encode() * 400])
    table = wm.ShiftTables([b" ten words that are never in the text at all "], [0])
    looks = []
    plain = table.hash
    table.hash = lambda b: looks.append(b.size) or plain(b)
    assert table.find(text) == ([], []) and sum(looks) < len(text) / 15


def test_op11_to_op13_match_the_operators_on_given_tables(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = {r.doc_id: r for r in QUERIES["op11_fill_in_middle"](spark, SF).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for i, t in docs.items():
        _, n, form, p, m, output = brute_middle(i, t)
        assert tuple(got[i][c] for c in ("n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")) == (n, form, p, m, sha(output), sha(t or ""))
    got = QUERIES["op13_benchmark_decontamination"](spark, SF).collect()
    want = [(i, n, hit, len(x), sha(",".join(x)), hit > 0) for i, n, hit, x in brute_hits(list(docs.items()), items, 10)]
    assert sorted((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got) == sorted(want)


# --- packing's tokens


def test_every_letter_before_every_mark_is_the_librarys():
    path = P.path("word_bpe_49k.json")
    ours, library = tokenizer(path), Tokenizer.from_file(path)
    library.encode_special_tokens = True
    letters = [chr(c) for c in range(0x110000) if chr(c).isalpha()]
    odd_ones = [c for c in letters if not library.normalizer.normalize_str(c).isalpha()]
    assert "İ" in odd_ones
    texts = [f"ver{c}{m}" for m in ".,;:!?" for c in [*odd_ones, *letters[::40]]] + [f"{c}{m}x {c}" for m in ".?" for c in odd_ones] + [f"ab{c}." for c in letters]
    for at in range(0, len(texts), 20_000):
        some = texts[at : at + 20_000]
        for text, ids, want in zip(some, ours.encode(some), library.encode_batch(some, add_special_tokens=False)):
            assert np.frombuffer(ids, "<u4").tolist() == want.ids, text
