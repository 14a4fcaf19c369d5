"""Secret scanning with linking of multipart credentials.

Three kinds of strings are reported wherever they stand (assignments, access
keys, long hexadecimal runs). Three weaker kinds, identifiers, opaque strings
and endpoints, are no secrets by themselves: they are reported only where an
identifier and a secret stand within ``SCOPE`` code points of each other. The
parts of a text are joined as intervals: each identifier is posted under the
blocks of ``SCOPE`` code points that its scope covers, each secret and endpoint
under those that it covers itself, so one equality join on (row, block) finds
the pairs, and a block holds a bounded number of parts.

Everything is Spark SQL functions. A pattern's matches get their places by
wrapping them in a separator, splitting, and adding up the pieces' lengths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.llm.lineage import cut

SCOPE = 200
_SEPARATOR = "\ue000"

# fixed values: the kinds in the order of reporting, and their patterns
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
PATTERNS = {
    "assign": ASSIGN,
    "access": r"AKIA[A-Z0-9]{16,}",
    "hex": r"[0-9a-f]{24,}",
    "ident": r"""(?i)(?:access_?key_?id|access_?key|client_?id|account_?id|user_?name|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@-]{4,}""",
    "opaque": r"[A-Za-z0-9+/]{32,}={0,2}",
    "endpoint": r"https?://[A-Za-z0-9.-]+(?::[0-9]+)?[^\x20\x09-\x0D\"'<>]*",
}
BASE = ("assign", "access", "hex")


def _pieces(text: Column, kind: int, pattern: str) -> Column:
    """The text cut at a pattern's matches: for each piece its kind, number,
    length, and itself if it is a match. None for a text without a match."""
    pieces = F.split(F.regexp_replace(text, pattern, f"{_SEPARATOR}$0{_SEPARATOR}"), _SEPARATOR, -1)
    rows = F.transform(pieces, lambda p, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), F.length(p).alias("size"), F.when(i % 2 == 1, p).alias("value")))
    return F.when(F.size(rows) > 1, rows).otherwise(F.slice(rows, 1, 0))


def parts(docs: DataFrame) -> DataFrame:
    """(row, doc_id, pieces): a row for each of ``docs``, numbered, with the pieces of all kinds."""
    text = F.translate(F.coalesce("text", F.lit("")), _SEPARATOR, "\ufffd")
    pieces = F.concat(*(_pieces(F.col("text"), k, p) for k, p in enumerate(PATTERNS.values())))
    return docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", text.alias("text")).select("row", "doc_id", pieces.alias("pieces"))


def found(pieces: DataFrame) -> DataFrame:
    """(row, kind, start, end) of the matches that hold; places count code points, the end is exclusive."""
    rows = pieces.select("row", F.explode("pieces").alias("p")).select("row", "p.*")
    before = Window.partitionBy("row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("start", F.coalesce(F.sum("size").over(before), F.lit(0))).where("value is not null")
    names = list(PATTERNS)
    long = (F.col("kind") != names.index("assign")) | (F.length(F.regexp_extract("value", ASSIGN, 2)) >= 6)
    mixed = (F.col("kind") != names.index("opaque")) | (F.col("value").rlike("[0-9]") & F.col("value").rlike("[A-Za-z]"))
    return rows.where(long & mixed).select("row", "kind", "start", (F.col("start") + F.col("size")).alias("end"))


def _blocks(start: Column, end: Column) -> Column:
    return F.explode(F.sequence(F.floor(start / SCOPE), F.floor(end / SCOPE)))


def linked(spans: DataFrame) -> DataFrame:
    """The weak spans of ``found`` that complementary parts stand beside."""
    kind = {k: i for i, k in enumerate(PATTERNS)}
    is_kind = lambda *names: F.col("kind").isin([kind[x] for x in names])
    strong = spans.where(is_kind(*BASE)).select("row", F.col("start").alias("s"), F.col("end").alias("e"), _blocks(F.col("start"), F.col("end") - 1).alias("block"))
    weak = spans.where(is_kind("ident", "opaque", "endpoint"))
    opaque = weak.where(is_kind("opaque")).withColumn("block", _blocks(F.col("start"), F.col("end") - 1))
    opaque = opaque.join(strong, ["row", "block"], "left").groupBy("row", "kind", "start", "end").agg(F.coalesce(F.max((F.col("s") < F.col("end")) & (F.col("start") < F.col("e"))), F.lit(False)).alias("known")).where("not known").drop("known")
    own = _blocks(F.col("start"), F.col("end") - 1).alias("block")
    secrets = spans.where(is_kind("assign", "hex")).union(opaque).select("row", "kind", "start", "end", own)
    names = spans.where(is_kind("access", "ident")).select("row", F.col("kind").alias("n_kind"), F.col("start").alias("n_start"), F.col("end").alias("n_end"), _blocks(F.greatest(F.lit(0), F.col("start") - SCOPE), F.col("end") + SCOPE).alias("block"))
    near = (F.col("start") <= F.col("n_end") + SCOPE) & (F.col("end") >= F.col("n_start") - SCOPE)
    pairs = names.join(secrets, ["row", "block"]).where(near)
    kinds = [F.struct("kind", "start", "end"), F.struct(F.col("n_kind").alias("kind"), F.col("n_start").alias("start"), F.col("n_end").alias("end"))]
    both = cut(pairs.select("row", F.explode(F.array(*kinds)).alias("p")).select("row", "p.*").distinct())
    places = both.select("row", F.col("start").alias("s"), F.col("end").alias("e"), _blocks(F.greatest(F.lit(0), F.col("start") - SCOPE), F.col("end") + SCOPE).alias("block"))
    ends = weak.where(is_kind("endpoint")).select("row", "kind", "start", "end", own).join(places, ["row", "block"]).where("start <= e + {0} and end >= s - {0}".format(SCOPE)).select("row", "kind", "start", "end").distinct()
    return both.where(is_kind("ident", "opaque")).union(ends)


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, spans) of ``docs(doc_id, text)``: all spans (kind, start, end) in
    order of start and kind.

    A null text is empty; a text without secrets has an empty list. A repeated
    row gives a row each; an empty table gives none; other columns are ignored.
    """
    pieces = cut(parts(docs))
    spans = cut(found(pieces))
    base = spans.where(F.col("kind") < len(BASE))
    listed = base.union(linked(spans)).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("list"))
    name = F.array(*map(F.lit, PATTERNS))
    spans = F.transform(F.coalesce("list", F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")), lambda x: F.struct(F.element_at(name, x["kind"] + 1).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    return pieces.select("row", "doc_id").join(listed, "row", "left").select("doc_id", spans.alias("spans"))


def text_of(spans: Column) -> Column:
    """Spans as ``kind:start:end``, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def digest(docs: DataFrame) -> DataFrame:
    """Counts of the base kinds, a hash of their spans, and all spans as text."""
    of = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda x: x["kind"].isin(*BASE))
    return scan(docs).select("doc_id", *map(of, BASE), F.sha2(text_of(base), 256).alias("base_sha256"), text_of(F.col("spans")).alias("spans"))


def redacted(docs: DataFrame, broadcast_rows: int = 200_000) -> DataFrame:
    """``docs`` with every span of its texts replaced by ``[SECRET]``.

    Overlapping spans are replaced as one. Columns stay as they are, but
    n_chars, if there is one, follows the text. Spans are joined back by id and
    a hash of the text, so repeated ids are safe; up to ``broadcast_rows``
    texts with spans are sent to every executor, more are joined by a shuffle.
    Texts without spans stay as they are, nulls too.
    """
    keyed = docs.select(F.struct("doc_id", F.xxhash64("text").alias("h")).alias("doc_id"), "text")
    spans = scan(keyed).where(F.size("spans") > 0).select(F.col("doc_id.doc_id").alias("_id"), F.col("doc_id.h").alias("_hash"), F.col("spans").alias("_spans"))
    spans = cut(spans.groupBy("_id", "_hash").agg(F.first("_spans").alias("_spans")))
    # the row as one column, so that its names meet none of the spans'
    rows = docs.select(F.struct(*docs.columns).alias("_row"))
    own = F.col("_row.text")
    same = F.col("_row.doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64(own) == F.col("_hash"))
    joined = rows.join(F.broadcast(spans) if spans.count() <= broadcast_rows else spans, same, "left")

    def step(done: Column, x: Column) -> Column:
        between = F.substr(own, (done["at"] + 1).cast("int"), (x["start"] - done["at"]).cast("int"))
        out = F.when(x["start"] >= done["at"], F.concat(done["out"], between, F.lit("[SECRET]"))).otherwise(done["out"])
        return F.struct(out.alias("out"), F.greatest(done["at"], x["end"]).alias("at"))

    rest = lambda done: F.concat(done["out"], F.substr(own, (done["at"] + 1).cast("int"), F.lit(2147483647)))
    text = F.when(F.col("_spans").isNull(), own).otherwise(F.aggregate("_spans", F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("at")), step, rest))
    out = joined.select("_row", "_spans", text.alias("_text"))
    changed = {"text": F.col("_text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("_spans").isNull(), F.col("_row.n_chars")).otherwise(F.length("_text").cast(docs.schema["n_chars"].dataType))
    return out.select(*(changed.get(c, F.col("_row")[c]).alias(c) for c in docs.columns))
