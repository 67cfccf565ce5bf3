import math
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tradespan.llm.mixing import counted_documents, mix, reached_shares
from tradespan.llm.tokens import DEFAULT_VOCABULARY, TokenCounter

pytestmark = pytest.mark.skipif(not Path(DEFAULT_VOCABULARY).exists(), reason="no vocabulary")
TARGET = "source string, target_share double, max_repeats int"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="ab1 9\n\r\t'’é½\xa0\x85.,:s Ã¼", max_size=30), max_size=6))
def test_counts_equal_the_encoder(texts):
    c = TokenCounter()
    assert c.counts(texts).tolist() == [len(c.encode(t)) for t in texts]


def test_long_and_repeated_texts():
    c = TokenCounter()
    texts = ["word " * 5000, "x" * 3000, "12:34:56,789 --> 12:34:57,000\n" * 40, "", "x" * 3000]
    for _ in range(2):
        assert c.counts(texts).tolist() == [len(c.encode(t)) for t in texts]


def counted(spark):
    rows = [(i, ("a" if i % 3 else "b") if i < 3000 else "c", 1.0, 5 + i % 40) for i in range(3100)]
    return spark.createDataFrame(rows + [(9000, None, 1.0, 50), (9001, "z", 1.0, 50), (9002, "a", 1.0, 0)], "doc_id bigint, source string, weight double, tokens bigint")


def test_shares_and_repeats(spark):
    docs = counted(spark)
    targets = spark.createDataFrame([(" A", 0.3, 1), ("b", 0.5, 3), ("c", 0.15, 2), ("none", 0.05, 9), (None, 0.1, 1)], TARGET)
    total = docs.agg(F.sum("tokens")).first()[0]
    rows = {r.source: r for r in reached_shares(docs, targets).collect()}
    assert set(rows) == {"a", "b", "c", "none"}
    for s, share in (("a", 0.3), ("b", 0.5)):
        assert abs(rows[s].tokens - share * total) <= 45
    # a source that cannot fill its share falls short, used up to its repeats
    assert rows["c"].tokens == 2 * rows["c"].available_tokens and rows["none"].tokens == 0
    assert math.isclose(sum(r.share for r in rows.values()), 1.0)
    picked = mix(docs, targets).collect()
    most = {"a": 1, "b": 3, "c": 2}
    assert all(1 <= r.copies <= most[r.source] for r in picked) and len({r.doc_id for r in picked}) == len(picked)
    # copies of a source differ by one at most
    assert all(max(c) - min(c) <= 1 for c in ([r.copies for r in picked if r.source == s] for s in "abc"))
    assert sorted(map(tuple, picked)) == sorted(map(tuple, mix(docs.repartition(7), targets).collect()))
    assert sorted(map(tuple, picked)) != sorted(map(tuple, mix(docs, targets, seed=8).collect()))


def test_threshold_equals_a_full_sort(spark):
    """The two-level cut takes the same documents as ranking all of them."""
    docs = counted(spark).where("source = 'a'")
    targets = spark.createDataFrame([("a", 0.4, 1)], TARGET)
    got = {r.doc_id for r in mix(docs, targets).collect()}
    u = (F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    rows = sorted(docs.where("tokens > 0").withColumn("u", u).collect(), key=lambda r: r.u)
    need, upto, want = 0.4 * sum(r.tokens for r in rows), 0, set()
    for r in rows:
        if upto + r.tokens / 2 > need:
            break
        upto += r.tokens
        want.add(r.doc_id)
    assert got == want


def test_weights_give_unequal_odds(spark):
    rows = [(i, "a", 4.0 if i % 2 else 1.0, 10) for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, weight double, tokens bigint")
    picked = mix(docs, spark.createDataFrame([("a", 0.25, 1)], TARGET)).collect()
    heavy = sum(r.doc_id % 2 for r in picked) / len(picked)
    assert abs(sum(r.tokens for r in picked) - 10_000) <= 10 and 0.76 < heavy < 0.84


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, "a b", " X ", 9), (None, None, None, 9), (2, "", "x", 9)], "doc_id bigint, text string, source string, tokens int")
    c = counted_documents(docs)
    assert sorted((r.doc_id or 0, r.source, r.tokens) for r in c.collect()) == [(0, None, 0), (1, "x", 2), (2, "x", 0)]
    targets = spark.createDataFrame([("x", 1.0, 1)], TARGET)
    assert [tuple(r) for r in mix(c, targets).collect()] == [(1, "x", 2, 1)]
    assert mix(c.limit(0), targets).count() == 0 and mix(c, targets.limit(0)).count() == 0
    assert reached_shares(c.limit(0), targets).first().tokens == 0


def test_capped_documents_hand_their_surplus_on(spark):
    rows = [(i, "a", 100.0 if i < 10 else 1.0, 10) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, weight double, tokens bigint")
    picked = mix(docs, spark.createDataFrame([("a", 0.5, 1)], TARGET)).collect()
    assert sum(r.tokens for r in picked) == 500 and {r.doc_id for r in picked} >= set(range(10))
    twice = mix(docs, spark.createDataFrame([("a", 1.5, 2)], TARGET)).collect()
    assert sum(r.tokens * r.copies for r in twice) == 1500 and all(r.copies == 2 for r in twice if r.doc_id < 10)
    free = mix(docs, spark.createDataFrame([("a", 0.5, None)], TARGET)).collect()
    assert sum(r.tokens * r.copies for r in free) == 500 and all(r.copies >= 4 for r in free if r.doc_id < 10)


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.sampled_from([0.1, 1.0, 3.0, 50.0, 1e4]), st.integers(1, 60)), min_size=5, max_size=60), st.floats(0.05, 3.0), st.integers(1, 3))
def test_reachable_shares_are_reached(spark, rows, share, repeats):
    docs = spark.createDataFrame([(i, "a", w, t) for i, (w, t) in enumerate(rows)], "doc_id bigint, source string, weight double, tokens bigint")
    got = mix(docs, spark.createDataFrame([("a", share, repeats)], TARGET)).collect()
    whole = sum(t for _, t in rows)
    assert abs(sum(r.tokens * r.copies for r in got) - min(share, repeats) * whole) <= 61
    assert all(r.copies <= repeats for r in got)


def test_inclusion_frequencies_follow_the_odds(spark):
    """Many sources of equal documents stand for many seeds."""
    weights = [1.0, 2.0, 4.0]
    docs = spark.range(1000 * 42).selectExpr("id AS doc_id", "concat('s', id % 1000) AS source", "element_at(array(1d, 2d, 4d), cast((id div 1000) % 3 + 1 AS int)) AS weight", "10L AS tokens")
    targets = spark.range(1000).selectExpr("concat('s', id) AS source", "0.00036 AS target_share", "1 AS max_repeats")
    got = {r.weight: r.n / 14_000 for r in mix(docs, targets).join(docs.select("doc_id", "weight"), "doc_id").groupBy("weight").agg(F.count("*").alias("n")).collect()}
    expected = 0.36 * 42
    for w in weights:
        assert abs(got[w] - expected * w / (14 * sum(weights))) < 0.02, got


def test_two_pieces_of_one_key_are_told_apart(monkeypatch):
    from tradespan.llm import tokens

    monkeypatch.setattr(tokens, "VALUE", np.ones(256, np.uint64))
    monkeypatch.setattr(tokens, "POWER", np.ones(tokens.LONGEST + 1, np.uint64))
    c = TokenCounter()
    texts = ["the cat sat on a mat", "tac eht tas no a tam", "xq zv qj 77 :: --", "supercalifragilistic expialidocious", "suilarepacfragilistic"]
    for _ in range(3):
        assert c.counts(texts).tolist() == [len(c.encode(t)) for t in texts]
