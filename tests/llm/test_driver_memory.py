"""What the driver keeps while an operator runs."""

from types import SimpleNamespace

from steadfold.llm import kneser_ney, near_dedup, secrets, shared

from .test_operators import RANKS


def test_steps_that_are_written_are_let_go_of(spark, monkeypatch):
    """The driver's heap is cleaned between the steps of the pipeline's longest operators, and not only after them."""
    calls = []
    for module in (near_dedup, kneser_ney, secrets):
        monkeypatch.setattr(module, "release", lambda s, name=module.__name__.split(".")[-1]: calls.append(name))
    df = spark.createDataFrame([(i, f"a b c d e f g {i // 2} token = {'0123456789abcdef' * 2}{i:02d}", "en", "web") for i in range(8)], "doc_id long, text string, lang string, source string")
    assert near_dedup.near_duplicates(df, size=4).count() == 8
    kneser_ney.train(df, df.select("doc_id"), *RANKS)
    assert secrets.train(df, sample=8, rounds=2).weights.any()
    assert [calls.count(n) for n in ("near_dedup", "kneser_ney", "secrets")] == [5, 3, 2]


def test_short_steps_do_not_ask_for_one_collection_after_the_other(spark, monkeypatch):
    """Collections asked for count as the JVM's own, which enlarges its heap while they take much of the time."""
    now, rounds = [1000.0], []
    monkeypatch.setattr(shared, "time", SimpleNamespace(monotonic=lambda: now[0], sleep=lambda s: None))
    monkeypatch.setattr(shared, "gc", SimpleNamespace(collect=lambda: rounds.append(now[0])))
    monkeypatch.setattr(shared, "_RELEASED", [float("-inf")], raising=False)
    for _ in range(11):  # as many as the pipeline's operators ask for
        shared.release(spark)
        now[0] += 1
    assert rounds == [1000.0] * 2
    now[0] += 20
    shared.release(spark)
    assert rounds == [1000.0] * 2 + [1031.0] * 2
    shared.release(spark, 0)  # where it is for the disk's sake alone
    assert len(rounds) == 6
