"""Secret scans with multipart credential linking, in DataFrame functions only.

Base spans, leftmost and non-overlapping per kind: ``assign`` (a key word, a sign and a
value of 6 or more characters), ``access`` (an access identifier of 20 or more),
``hex`` (a run of 24 or more). Weak candidates - a short access identifier, a
bare secret-like string, an endpoint - are parts of a credential. They are
reported only when a complementary part starts within ``SCOPE``
characters in the same document: kinds ``weak_access``, ``weak_secret``,
``endpoint``.

Each part is put into the cell of ``SCOPE`` characters where it starts. A
part has a partner within the scope exactly if its own cell has one, or the
last one of the cell before or the first of the cell after is near enough. So the
interval join is an equi-join on (document, cell) with one row a cell and
side, whatever the number of parts.

Defined results: a null text counts as empty; offsets are code points from 0,
ends exclusive; repeated rows give repeated rows; null ids pass through; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cavitas.llm.common import documents

#: Parts that start within so many characters of each other belong together.
SCOPE = 200

ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Base kinds in the order of ties: (kind, pattern). The last character class of
#: access and hex is greedy, so that the least length in the pattern drops failing
#: matches only; for assign the length is judged after matching.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Parts that mean little alone.
WEAK = {
    "weak_access": r"(?<![A-Za-z0-9_])(?:AKIA[A-Z0-9]{4,15}(?![A-Z0-9])|ASIA[A-Z0-9]{8,}|(?:client|account|access)_id=[A-Za-z0-9-]{4,})",
    "weak_secret": r"(?<![A-Za-z0-9_])(?:(?:sk|pk|ghp|xoxb)[-_][A-Za-z0-9]{8,}|[A-Za-z0-9+/]{39,}={1,2})",
    "endpoint": r"(?<![A-Za-z0-9_])(?:https?|postgres|mysql|redis|amqp)://[A-Za-z0-9._~:@/?&=%+-]+",
}
ORDER = ["assign", "access", "hex", *WEAK]
#: What each kind takes part in: an identifier, a secret or an endpoint.
ROLE = {"assign": "secret", "hex": "secret", "weak_secret": "secret", "access": "identifier", "weak_access": "identifier", "endpoint": "endpoint"}


def spans(text: Column, kind: str, pattern: str) -> Column:
    """Places of the matches: array of (start, end, kind, order), from the pieces between them."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    sizes = F.zip_with(F.transform(between, F.length), F.transform(found, F.length), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    nothing = F.array().cast("array<struct<start:int,end:int>>")
    first = F.struct(F.lit(0).alias("at"), nothing.alias("out"))

    def add(held: Column, size: Column) -> Column:
        start = held["at"] + size["a"]
        end = start + size["b"]
        place = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct(F.coalesce(end, start).alias("at"), F.when(size["b"].isNull(), held["out"]).otherwise(F.concat(held["out"], place)).alias("out"))

    places = F.aggregate(sizes, first, add, lambda held: held["out"])
    number = ORDER.index(kind)
    tagged = F.transform(places, lambda p: F.struct(p["start"].alias("start"), F.lit(number).alias("order"), p["end"].alias("end"), F.lit(kind).alias("kind")))
    if kind == "assign":
        values = F.regexp_extract_all(text, F.lit(pattern), F.lit(2))
        tagged = F.transform(F.filter(F.arrays_zip(tagged.alias("s"), values.alias("v")), lambda x: F.length(x["v"]) >= 6), lambda x: x["s"])
    return F.when(text.rlike(pattern), tagged).otherwise(F.array().cast("array<struct<start:int,order:int,end:int,kind:string>>"))


def listed(found: Column) -> Column:
    """kind:start:end by start, then kind, comma-joined."""
    return F.array_join(F.transform(F.array_sort(found), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base, spans``: base and all spans as arrays of structs."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), text.alias("text")).select("doc_id", F.xxhash64("text").alias("row_key"), "text")
    base = [spans(F.col("text"), kind, pattern) for kind, pattern in (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX))]
    weak = [spans(F.col("text"), kind, pattern) for kind, pattern in WEAK.items()]
    rows = rows.select("doc_id", "row_key", F.concat(*base).alias("base"), F.concat(*weak).alias("weak"))
    # both branches read the text: this one looks for weak candidates in all rows and for base spans only where it finds some. Written once as
    # one projection, the patterns make a method longer than the JVM compiles, which took half as long again.
    linked = link(rows.where(F.size("weak") > 0), scope)
    out = rows.join(linked, (rows["row_key"] == linked["link_key"]) & rows["doc_id"].eqNullSafe(linked["link_id"]), "left")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return out.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in ("assign", "access", "hex")], "base",
        F.when(F.col("linked").isNull(), F.col("base")).otherwise(F.concat("base", "linked")).alias("spans"),
    )


def link(rows: DataFrame, scope: int) -> DataFrame:
    """``link_id, link_key, linked``: the weak candidates with a complementary part in scope."""
    roles = F.create_map(*[F.lit(x) for pair in ROLE.items() for x in pair])
    part = F.explode(F.concat("base", "weak")).alias("p")
    parts = rows.dropDuplicates(["doc_id", "row_key"]).select("doc_id", "row_key", part).select(
        F.col("doc_id").alias("link_id"), F.col("row_key").alias("link_key"), "p", roles[F.col("p.kind")].alias("role"), F.floor(F.col("p.start") / scope).alias("cell")
    )
    ends = parts.groupBy("link_id", "link_key", "cell", "role").agg(F.min("p.start").alias("first"), F.max("p.start").alias("last"))
    near = ends.select(
        F.col("link_id").alias("near_id"), F.col("link_key").alias("near_key"), F.explode(F.array(F.col("cell") - 1, F.col("cell"), F.col("cell") + 1)).alias("near_cell"),
        F.col("role").alias("other"), "first", "last",
    )
    weak = parts.where(F.col("p.kind").isin(*WEAK))
    partner = (
        F.col("link_id").eqNullSafe(F.col("near_id"))
        & (F.col("link_key") == F.col("near_key"))
        & (F.col("cell") == F.col("near_cell"))
        & (F.col("role") != F.col("other"))
        & (F.least(F.abs(F.col("p.start") - F.col("first")), F.abs(F.col("p.start") - F.col("last"))) <= scope)
    )
    kept = weak.join(near, partner, "left_semi")
    return kept.groupBy("link_id", "link_key").agg(F.collect_list("p").alias("linked"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir)).select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans")
    )
