"""Mixing sources to target shares of a token budget.

Every document has an expected number of copies, in proportion to its weight
and capped by its source's repeats; what capped documents cannot take goes to
the others, so that a source reaches its share if it can. The whole part of
the expected copies is certain; the rest is an inclusion probability, and
Pareto order sampling picks who gets one copy more: documents are ranked by
the odds of a random number over the odds of their inclusion, and the first
ones are taken until the source's tokens are complete.

Ranks are cut at a threshold found on histograms of the ranking key (two
levels), so no source is ever sorted, however large.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradespan.llm.tokens import DEFAULT_VOCABULARY, TokenCounter
from tradespan.session import checkpointed

BUCKETS = 4096
#: Classes of weights per unit of their logarithm: weights of one class differ by a thousandth at most.
WEIGHT_CLASSES = 1024
MAX_SOURCES = 100_000


def counted_documents(documents: DataFrame, vocabulary: str = DEFAULT_VOCABULARY, weight: Column | None = None) -> DataFrame:
    """(doc_id, source, tokens, weight; 1 if none is named), written once to the shared folder. Sources are compared in lower case without outer blanks."""
    rows = documents.select(
        "doc_id", F.lower(F.trim("source")).alias("source"), (F.lit(1.0) if weight is None else weight).cast("double").alias("weight"), F.coalesce("text", F.lit("")).alias("text")
    )

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = TokenCounter(vocabulary)
        for part in parts:
            yield part.drop(columns="text").assign(tokens=counter.counts(part["text"].tolist()))

    return checkpointed(rows.mapInPandas(count, "doc_id bigint, source string, weight double, tokens bigint"))


def _targets(targets: DataFrame) -> DataFrame:
    t = targets.select(F.lower(F.trim("source")).alias("source"), "target_share", "max_repeats")
    return t.where(F.col("source").isNotNull() & (F.col("target_share") > 0)).groupBy("source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))


def mix(counted: DataFrame, targets: DataFrame, seed: int = 7, budget: int | None = None) -> DataFrame:
    """(doc_id, source, tokens, copies): documents of the mixture and how often each is used.

    ``budget`` defaults to the tokens of all documents. Documents without
    source, of a source without target, without tokens or without weight are
    not used; ``max_repeats`` null is no cap. A source that cannot fill its share with ``max_repeats`` copies of each
    document falls short; nothing takes its place. Equal random numbers are
    told apart by doc_id; repeated doc_ids count as documents of their own.
    The same input and seed give the same mixture.
    """
    # tables of one row per target source are broadcast if there are few of them
    aims = _targets(targets)
    few = aims.limit(MAX_SOURCES + 1).count() <= MAX_SOURCES
    small = F.broadcast if few else (lambda df: df)
    aims = small(aims)
    total = F.lit(budget) if budget is not None else None
    sums = counted.agg(F.sum("tokens").alias("all_tokens"))
    docs = counted.where((F.col("tokens") > 0) & (F.col("weight") > 0)).join(aims, "source")
    # one row per source: its budget and how weight turns into expected copies
    cap = F.coalesce(F.col("max_repeats").cast("double"), F.lit(float(1 << 31)))
    classes = docs.groupBy("source", F.floor(F.log("weight") * WEIGHT_CLASSES).alias("class")).agg(
        F.sum("tokens").alias("t"), F.sum(F.col("weight") * F.col("tokens")).alias("w"), F.max("weight").alias("top"), F.first("target_share").alias("share"), F.first(cap).alias("cap")
    )
    of_source = Window.partitionBy("source")
    upto = of_source.orderBy("class").rowsBetween(Window.unboundedPreceding, 0)
    classes = classes.crossJoin(F.broadcast(sums)).withColumn("aim", F.col("share") * (total if total is not None else F.col("all_tokens"))).withColumn("whole", F.sum("t").over(of_source))
    # copies per weight if all classes above are capped and none up to this one is
    rate = (F.col("aim") - F.col("cap") * (F.col("whole") - F.sum("t").over(upto))) / F.sum("w").over(upto)
    fits = (F.col("rate") > 0) & (F.col("rate") * F.col("top") <= F.col("cap") * (1 + 1e-9))
    # rounded, so that the order of summing does not matter
    rate_of = F.exp(F.round(F.log(F.max_by("rate", F.when(fits, F.col("class")))), 10))
    scale = classes.withColumn("rate", rate).groupBy("source").agg(rate_of.alias("rate"), F.least(F.first("aim"), F.first("cap") * F.first("whole")).alias("aim"), F.first("cap").alias("cap"))
    scale = small(scale)
    u = (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    # without a rate every document is used to the cap
    expected = F.when(F.col("rate").isNull(), F.col("cap")).otherwise(F.least(F.col("rate") * F.col("weight"), F.col("cap")))
    docs = docs.join(scale, "source").withColumn("expected", expected).withColumn("certain", F.floor(F.col("expected") + 1e-12))
    docs = docs.withColumn("p", F.greatest(F.lit(0.0), F.col("expected") - F.col("certain"))).withColumn("u", u)
    q = (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p")))
    docs = docs.withColumn("key", F.when(F.col("p") > 1e-12, q / (1 + q)))
    docs = docs.withColumn("b1", F.least(F.floor(F.col("key") * BUCKETS), F.lit(BUCKETS - 1)))
    docs = docs.withColumn("b2", F.least(F.floor((F.col("key") * BUCKETS - F.col("b1")) * BUCKETS), F.lit(BUCKETS - 1)))
    docs = checkpointed(docs.select("doc_id", "source", "tokens", "certain", "aim", "key", "b1", "b2"))

    # what the certain copies leave of the budget, as far as there are documents for it
    left = F.first("aim") - F.sum(F.col("certain") * F.col("tokens"))
    lack = docs.groupBy("source").agg(F.least(left, F.coalesce(F.sum(F.when(F.col("key").isNotNull(), F.col("tokens"))), F.lit(0))).alias("lack"))
    lack = small(lack)

    def threshold(rows: DataFrame, bucket: str, need: DataFrame) -> DataFrame:
        """(source, bucket, left): the bucket in which the source's need is met, and what is left of it there."""
        sums = rows.where(F.col(bucket).isNotNull()).groupBy("source", bucket).agg(F.sum("tokens").alias("tokens"))
        before = Window.partitionBy("source").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
        cut = sums.join(need, "source").withColumn("before", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
        hit = cut.where((F.col("before") < F.col("lack")) & (F.col("before") + F.col("tokens") >= F.col("lack")))
        return small(hit.select("source", F.col(bucket).alias(f"cut_{bucket}"), (F.col("lack") - F.col("before")).alias("lack")))

    first = threshold(docs, "b1", lack)
    edge = docs.join(first.drop("lack"), "source").where(F.col("b1") == F.col("cut_b1"))
    second = threshold(edge, "b2", first.select("source", "lack"))
    # the last bucket of the second level is small: ordered by key
    last = edge.join(second, "source").where(F.col("b2") == F.col("cut_b2"))
    order = Window.partitionBy("source").orderBy("key", "doc_id")
    upto = F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, 0))
    last = last.withColumn("upto", upto).withColumn("nth", F.row_number().over(order))
    # taken while it brings the sum nearer to the need
    taken = last.where(F.col("upto") - F.col("tokens") / 2 <= F.col("lack")).groupBy("source").agg(F.max(F.struct("key", "doc_id")).alias("last_taken"))
    bound = first.drop("lack").join(second.drop("lack"), "source", "left").join(taken, "source", "left")
    bound = small(bound)
    below = (F.col("b1") < F.col("cut_b1")) | ((F.col("b1") == F.col("cut_b1")) & (F.col("b2") < F.col("cut_b2")))
    at_edge = (F.col("b1") == F.col("cut_b1")) & (F.col("b2") == F.col("cut_b2")) & (F.struct("key", "doc_id") <= F.col("last_taken"))
    extra = F.when(F.col("key").isNotNull() & (below | at_edge), 1).otherwise(0)
    return docs.join(bound, "source", "left").select("doc_id", "source", "tokens", (F.col("certain") + extra).cast("int").alias("copies")).where(F.col("copies") > 0)


def reached_shares(counted: DataFrame, targets: DataFrame, seed: int = 7, budget: int | None = None) -> DataFrame:
    """One row per target source: what was asked for, what there is, what was reached.

    ``share`` is of the mixture, ``share_of_budget`` of the tokens asked for.
    """
    mixed = mix(counted, targets, seed, budget).groupBy("source").agg(
        F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.count(F.lit(1)).alias("documents"), F.max("copies").alias("most_copies")
    )
    there = counted.groupBy("source").agg(F.sum("tokens").alias("available_tokens"), F.count(F.lit(1)).alias("available_documents"))
    sums = counted.agg((F.sum("tokens") if budget is None else F.lit(budget)).alias("budget"))
    reached = mixed.agg(F.sum("tokens").alias("mixture"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return (
        _targets(targets)
        .join(mixed, "source", "left")
        .join(there, "source", "left")
        .crossJoin(F.broadcast(sums))
        .crossJoin(F.broadcast(reached))
        .select(
            "source",
            "target_share",
            "max_repeats",
            *(zero(c) for c in ("available_documents", "available_tokens", "documents", "most_copies", "tokens")),
            (F.coalesce("tokens", F.lit(0)) / F.col("mixture")).alias("share"),
            (F.coalesce("tokens", F.lit(0)) / F.col("budget")).alias("share_of_budget"),
        )
    )
