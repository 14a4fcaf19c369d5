"""Copies of documents so that each source gives its target of words.

Sources share 150 % of all words by fixed weights, none more than twice its own
words. Within a source, entropy balancing finds the rates that stay closest to
one copy each: of all rates r in [0, 2] with sum(r * size) = target, those of
least sum(r log r - r) are min(2, exp(x * size)), one x for each source. x
solves a convex dual in one variable; Newton's iterations do, safeguarded by a
bracket. Documents of a source and size have one rate, so each iteration adds
up numbers of documents by (source, size), in decimals: sums don't depend on
the order of rows, and reruns agree.

Rates become copies in the order of falling sizes: the words that rounding the
copies of a size leaves over, or takes too many, go on to the next size. The
documents of a size that get a copy more are those whose ids hash lowest.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.llm.lineage import cut

WEIGHTS = (5, 2, 1)
#: Words of the mix for each hundred of the documents.
PERCENT = 150
MOST_COPIES = 2
#: Relative distance of a source's words from its target at which iterations end.
CLOSE = 1e-9
MOST_ITERATIONS = 80
#: Documents of a source and size are ranked in so many parts.
PARTS = 1024
_BLANKS = "[\\x20\\x09-\\x0D]+"


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, key, size, part, h) of ``docs(doc_id, text, source)``; keys sort
    as sources do by code point, the null source last."""
    size = F.size(F.array_remove(F.split(F.coalesce("text", F.lit("")), _BLANKS), "")).cast("long")
    key = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("z"))
    h = F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), F.col("text")))
    return docs.select("doc_id", key.alias("key"), size.alias("size"), h.alias("h")).withColumn("part", F.pmod("h", F.lit(PARTS)))


def targets(cells: DataFrame) -> DataFrame:
    """(key, source_size, least, target) of ``cells(key, size, n)``.

    The excess of sources above their bounds is shared out again until none is
    above: with sources ordered by the share at which they meet their bounds,
    the first k are at theirs for the least k whose share leaves the next below."""
    own = cells.groupBy("key").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.min(F.when(F.col("size") > 0, F.col("size"))).alias("least"))
    place = F.row_number().over(Window.orderBy("key")) - 1
    weighed = own.withColumns({"weight": F.get(F.array(*map(F.lit, WEIGHTS)), place % len(WEIGHTS)), "most": MOST_COPIES * F.col("source_size")})
    by_bound = Window.orderBy(F.col("most") / F.col("weight"), "key")
    every, before = Window.partitionBy(), by_bound.rowsBetween(Window.unboundedPreceding, -1)
    rest = lambda c, whole: whole - F.coalesce(F.sum(c).over(before), F.lit(0))
    share = rest("most", F.lit(PERCENT) / 100 * F.sum("source_size").over(every)) / rest("weight", F.sum("weight").over(every))
    shares = weighed.withColumns({"share": share, "place": F.row_number().over(by_bound)})
    final = F.min(F.when(F.col("share") * F.col("weight") <= F.col("most"), F.struct("place", "share"))).over(every)
    bound = F.coalesce(F.col("place") < F.col("final.place"), F.lit(True))
    return shares.withColumn("final", final).select("key", "source_size", "least", F.when(bound, F.col("most").cast("double")).otherwise(F.col("final.share") * F.col("weight")).alias("target"))


def _rate(x: Column) -> Column:
    return F.least(F.lit(float(MOST_COPIES)), F.exp(x * F.col("size")))


def _exact(value: Column) -> Column:
    return F.sum(value.cast("decimal(38,9)")).cast("double")


def tilts(cells: DataFrame, goals: DataFrame) -> DataFrame:
    """``goals`` with x, the tilt of each source: null where its target is 0 or
    the bound, so that its documents all have the same number of copies."""
    free = (F.col("target") < MOST_COPIES * F.col("source_size")) & (F.col("target") > 0)
    part = F.col("target") / F.nullif(F.col("source_size"), F.lit(0))
    # with x at lo every rate is below target / source_size, with x at hi at its bound
    lo, hi = F.log(F.least(F.lit(1.0), part)) / F.col("least"), F.lit(math.log(MOST_COPIES)) / F.col("least")
    state = goals.withColumns({"lo": F.when(free, lo), "hi": F.when(free, hi), "x": F.when(free, F.lit(0.0)), "done": ~free})
    words = F.col("n") * F.col("size") * _rate(F.col("x"))
    growth = F.when(_rate(F.col("x")) < MOST_COPIES, words * F.col("size")).otherwise(0.0)
    for _ in range(MOST_ITERATIONS):
        sums = cells.join(state.where("not done").select("key", "x"), "key").groupBy("key").agg(_exact(words).alias("words"), _exact(growth).alias("slope"))
        state = state.join(sums, "key", "left")
        close = F.abs(F.col("words") - F.col("target")) <= CLOSE * F.col("target")
        above = F.col("words") > F.col("target")
        low, high = F.when(above, F.col("lo")).otherwise(F.col("x")), F.when(above, F.col("x")).otherwise(F.col("hi"))
        # Newton's step for the logarithm of the words, which bends less than the words do
        newton = F.col("x") + (F.log("target") - F.log("words")) * F.col("words") / F.nullif(F.col("slope"), F.lit(0.0))
        settled = F.col("done") | close | (high - low <= 1e-15 * F.greatest(F.abs(low), F.abs(high)))
        better = F.when((newton > low) & (newton < high), newton).otherwise((low + high) / 2)
        state = cut(state.select("key", "source_size", "least", "target", low.alias("lo"), high.alias("hi"), F.when(settled, F.col("x")).otherwise(better).alias("x"), settled.alias("done")))
        if state.where("not done").isEmpty():
            break
    return state.select("key", "source_size", "target", "x")


def rounded(size: np.ndarray, n: np.ndarray, rate: np.ndarray) -> np.ndarray:
    """Copies of all documents of each size, sizes falling: what rounding leaves over goes on."""
    out, left = np.zeros(len(size), np.int64), 0.0
    for i, (s, k, r) in enumerate(zip(size.tolist(), n.tolist(), rate.tolist(), strict=True)):
        left += s * k * r
        out[i] = min(MOST_COPIES * k, max(0, math.floor(left / s + 0.5)))
        left -= float(s * int(out[i]))
    return out


def _copies(rows: pa.Table) -> pa.Table:
    order = np.argsort(-np.asarray(rows.column("size")))
    rows = rows.take(pa.array(order))
    got = rounded(*(np.asarray(rows.column(c)) for c in ("size", "n", "rate")))
    return rows.select(["key", "size", "n"]).append_column("copies", pa.array(got, pa.int64()))


def mixed(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, copies, taken) of ``docs(doc_id,
    text, source)``, a row for each of theirs: taken is copies times size.

    A null text has size 0 and, like every text without words, takes nothing
    (one copy). The null source is a source of its own, beside the empty one.
    Rows that repeat an id are documents of their own; equal rows share their
    copies in any order. A source's words differ from its target by half its
    shortest document, unless the copies of its shorter documents are all 0 or
    2. Only numbers of documents by source and size, and sources, pass one task;
    texts may have any length. An empty table gives no rows; other columns are
    ignored.
    """
    rows = cut(sized(docs))
    parts = rows.groupBy("key", "size", "part").agg(F.count("*").alias("n"))
    cells = cut(parts.groupBy("key", "size").agg(F.sum("n").alias("n")))
    goals = tilts(cells, cut(targets(cells)))
    same = F.when(F.col("target") > 0, float(MOST_COPIES)).otherwise(0.0)
    rated = cells.join(goals, "key").withColumn("rate", F.coalesce(F.when(F.col("x").isNotNull(), _rate(F.col("x"))), same))
    copied = rated.where("size > 0").select("key", "size", "n", "rate").groupBy("key").applyInArrow(_copies, "key string, size long, n long, copies long")
    wordless = cells.where("size = 0").withColumn("copies", F.col("n"))
    # of the n documents of a source and size the first `more` in the order of (part, h) get one copy above `each`
    earlier = F.coalesce(F.sum("n").over(Window.partitionBy("key", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    every = copied.unionByName(wordless).select("key", "size", F.floor(F.col("copies") / F.col("n")).alias("each"), F.pmod("copies", "n").alias("more"))
    placed = parts.select("key", "size", "part", earlier.alias("earlier")).join(every, ["key", "size"]).join(goals.drop("x"), "key").withColumn("more", F.col("more") - F.col("earlier"))
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("key", "size", "part").orderBy("h", "doc_id")))
    copies = F.col("each") + F.when(F.col("rank") <= F.col("more"), 1).otherwise(0)
    return ranked.join(placed, ["key", "size", "part"]).select("doc_id", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))
