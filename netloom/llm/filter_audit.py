"""What each of five filters removes, in every order, and its fair share.

A document fails a set of filters, one bit each; what a coalition S of filters
removes is v(S), the documents that fail any of S. The 32 values of v for a
part of the documents tell all else: a step of an order removes v(after) less
v(before), and the potential P(S) = (v(S) + sum of P(S without i)) / |S|, made
from the smaller coalitions up, gives a filter's share as P(all) less P(all
without it). With shares over 120 orders the potential is kept 120-fold, which
is whole for every coalition.

Filters: A under 50 words; B under 65 % distinct words; C over 5 % letters A-Z;
D any of ``#$%&*|``; E the text of a document of a smaller id.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.llm.lineage import cut

FILTERS = "ABCDE"
ORDERS = 120
#: Rows without an id or label are spread over so many keys of the join.
SPREAD = 64


def _own_failures() -> Column:
    """Bits 0 to 3, of the filters that look at one text (``text``, ``words``)."""
    n, capitals = F.size("words"), F.length("text") - F.length(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    failed = [n < 50, 100 * F.size(F.array_distinct("words")) < 65 * n, 100 * capitals > 5 * F.length("text"), F.col("text").rlike("[#$%&*|]")]
    return sum((F.when(x, 1 << k).otherwise(0) for k, x in enumerate(failed)), F.lit(0))


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, good, toxic, n): how many documents of a part fail just those filters.

    Texts are compared by SHA-256. Copies are counted by text, part and labels
    before they meet, so a group of any size comes down to few rows."""
    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("words", F.array_remove(F.split("text", "[\\x20\\x09-\\x0D]+"), "")).select("doc_id", "part", _own_failures().alias("own"), F.unhex(F.sha2("text", 256)).alias("digest"))
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"), F.lit(0).alias("_spread"))
    spread = F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("digest", "part"), F.lit(SPREAD))).otherwise(0).cast("int")
    rows = rows.withColumn("_spread", spread).join(known, ["doc_id", "_spread"], "left").na.fill(False, ["good", "toxic"])
    # of the rows of a text and kind: all, and those of the lowest id among them
    kinds = ["digest", "part", "own", "good", "toxic"]
    groups = rows.groupBy(*kinds, "doc_id").agg(F.count("*").alias("n")).groupBy(*kinds).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("nameless"), F.min("doc_id").alias("least"), F.min_by("n", "doc_id").alias("n_least"))
    kind = F.struct("part", "own", "good", "toxic", "n", "nameless", "least", "n_least")
    texts = groups.groupBy("digest").agg(F.min("least").alias("first"), F.collect_list(kind).alias("g")).select("first", F.explode("g").alias("g")).select("first", "g.*")
    firsts = F.col("nameless") + F.when(F.col("least") == F.col("first"), F.col("n_least")).otherwise(0)
    both = F.explode(F.array(F.struct(F.col("own").alias("mask"), firsts.alias("n")), F.struct((F.col("own") + 16).alias("mask"), (F.col("n") - firsts).alias("n"))))
    return texts.select("part", "good", "toxic", both.alias("m")).select("part", "m.mask", "good", "toxic", "m.n").groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))


def potentials(v: Column) -> Column:
    """The 120-fold potentials of the 32 coalitions, from an array of their values."""

    def grown(p: Column, s: Column) -> Column:
        # a coalition's number is above those of all coalitions within it
        smaller = sum((F.when(s.bitwiseAND(F.lit(1 << k)) != 0, F.get(p, s - (1 << k))).otherwise(F.lit(0).cast("long")) for k in range(5)), F.lit(0).cast("long"))
        return F.concat(p, F.array(F.call_function("div", ORDERS * F.get(v, s) + smaller, F.bit_count(s))))

    return F.aggregate(F.sequence(F.lit(1), F.lit(31)), F.array(F.lit(0).cast("long")), grown)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails,
    good_lost, toxic_lost, shapley) of ``docs(doc_id, text, source)`` and
    ``labels(doc_id, quality, toxic)``: a row for each source, order of the five
    filters and step.

    A null text is empty, a null source is the empty string. A row without an id
    is no copy, nor is another a copy of it; rows that repeat an id with the
    same text are no copies of each other. A document is good or toxic if any
    of its labels says so; labels without an id or value don't count. Texts may
    have any length; an empty table gives no rows; other columns are ignored.
    """
    counts = failures(docs, labels)
    within = lambda s, when: F.sum(F.when(F.col("mask").bitwiseAND(F.lit(s)) != 0, F.when(when, F.col("n")).otherwise(0)).otherwise(0))
    values = lambda when: F.array(*(within(s, when) for s in range(32)))
    games = cut(counts.groupBy("part").agg(F.sum("n").alias("all"), values(F.lit(True)).alias("v"), values(F.col("good")).alias("v_good"), values(F.col("toxic")).alias("v_toxic")).withColumn("p", potentials(F.col("v"))))
    orders = F.array(*(F.lit("".join(o)) for o in permutations(FILTERS)))
    steps = games.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(5))))
    bit = lambda i: sum((F.when(F.substring("filter_order", i, 1) == x, 1 << k).otherwise(0) for k, x in enumerate(FILTERS)), F.lit(0))
    upto = lambda last: sum((F.when(F.lit(i) <= last, bit(i)).otherwise(0) for i in range(1, 6)), F.lit(0))
    steps = steps.withColumns({"after": upto(F.col("step")), "before": upto(F.col("step") - 1)}).withColumn("own", F.col("after") - F.col("before"))
    difference = lambda v: F.get(v, F.col("after")) - F.get(v, F.col("before"))
    return steps.select(
        "part", "filter_order", "step", (F.col("all") - F.get("v", F.col("after"))).alias("kept"), difference("v").alias("removed"),
        (F.get("v", F.col("own")) - difference("v")).alias("redundant"), (F.get("v", F.lit(31)) - F.get("v", F.lit(31) - F.col("own"))).alias("unique_fails"),
        difference("v_good").alias("good_lost"), difference("v_toxic").alias("toxic_lost"), (F.get("p", F.lit(31)) - F.get("p", F.lit(31) - F.col("own"))).alias("shapley"),
    )
