"""Secret scanning with parts that belong together, in Spark SQL functions only.

Strong findings (``base``) stand alone. Weak candidates -- a bare 40-character key, an endpoint -- are noise
on their own; they are reported where an access identifier and the other part lie in the same scope: the
same block of text (no blank line between) and within ``max_gap`` code points of the identifier. Positions
are code points, ends exclusive.

Texts are read once: each gives, per pattern, the lengths of its matches and of what lies between them, which
alternate through the text; both come from the same pattern. Running sums of these lengths over the matches of
a text, as rows, are the positions, and a running count of its blank lines is the number of the scope, so work
is in proportion to the matches. Texts without a match take no part in it. No pattern crosses a line end.

Linking is an interval join: identifiers are laid into buckets as wide as ``max_gap`` (their own and both
neighbours), candidates into one bucket, and a left semi join on (document, scope, bucket) checks the
distance, so pairs are never emitted. Only documents with an identifier and a candidate enter it.

Defined results: a null text is empty; every row, repeats too, is a document of its own; an empty table gives
an empty table; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landshift.sources.shared import written

ASSIGN = (
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
BARE_KEY = r"[A-Za-z0-9+/]{40,}"
ENDPOINT = r"https?://[A-Za-z0-9.-]+|[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.amazonaws\.com|[0-9]{1,3}(?:\.[0-9]{1,3}){3}"
KINDS = ("assign", "access", "hex", "key", "endpoint")
MAX_GAP = 400
BLANK_LINE, SCOPE = r"\n[\x20\t\r]*\n", 5
_PARTS = "array<struct<kind:int,parts:array<struct<gap:int,len:int,keep:boolean>>>>"


def _parts(text: Column, pattern: str, kind: int, keep=lambda m: F.lit(True)) -> Column:
    """The matches of a pattern, with the length of the text before each and whether it counts; an empty array without."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    parts = F.zip_with(hits, gaps, lambda m, g: F.struct(F.length(g).alias("gap"), F.length(m).alias("len"), keep(m).alias("keep")))
    parts = F.filter(parts, lambda p: p["len"].isNotNull())  # the text after the last match
    one = F.array(F.struct(F.lit(kind).alias("kind"), parts.alias("parts")))
    return F.when(F.size(hits) > 0, one).otherwise(F.array()).cast(_PARTS)


def matches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: row (a number), doc_id and found, the matches by kind. Weak kinds and blank
    lines are sought only beside an access identifier."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    long_value = lambda m: F.length(F.regexp_extract(m, "^" + ASSIGN, 2)) >= 6
    mixed = lambda m: m.rlike("[a-z]") & m.rlike("[A-Z]") & m.rlike("[0-9]")
    t = F.col("text")
    base = F.concat(_parts(t, ASSIGN, 0, long_value), _parts(t, HEX, 2))
    rows = rows.select("doc_id", "text", base.alias("base"), _parts(t, ACCESS, 1, lambda m: F.length(m) >= 20).alias("access"))
    weak = F.concat(_parts(t, BARE_KEY, 3, mixed), _parts(t, ENDPOINT, 4), _parts(t, BLANK_LINE, SCOPE))
    known = F.exists(F.flatten(F.col("access")["parts"]), lambda p: p["keep"])
    found = F.concat("base", "access", F.when(known, weak).otherwise(F.array().cast(_PARTS)))
    return rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", found.alias("found"))


def placed(found: DataFrame) -> DataFrame:
    """(row, doc_id, kind, start, end, keep, scope) of every match in ``matches``."""
    one = found.select("row", "doc_id", F.explode("found").alias("m")).select("row", "doc_id", "m.kind", F.posexplode("m.parts").alias("i", "p"))
    upto = F.sum(F.col("p.gap") + F.col("p.len")).over(Window.partitionBy("row", "kind").orderBy("i")).cast("int")
    spans = one.select("row", "doc_id", "kind", (upto - F.col("p.len")).alias("start"), upto.alias("end"), "p.keep")
    before = Window.partitionBy("row").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, 0)
    return spans.select("*", F.count_if(F.col("kind") == SCOPE).over(before).alias("scope"))


def linked(spans: DataFrame, max_gap: int = MAX_GAP) -> DataFrame:
    """(row, start, end, kind) of weak candidates whose complementary parts co-occur with an access identifier."""
    spans = spans.where(F.col("keep") & (F.col("kind") != SCOPE))
    bucket = F.floor(F.col("start") / max_gap)
    ids = spans.where("kind = 1").select("row", "scope", F.col("start").alias("id_start"), F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("bucket"))
    parts = spans.where("kind != 1").withColumn("bucket", bucket)
    near = (F.abs(F.col("start") - F.col("id_start")) <= max_gap)
    beside = parts.join(ids, (parts.row == ids.row) & (parts.scope == ids.scope) & (parts.bucket == ids.bucket) & near, "left_semi")
    scopes = beside.groupBy("row", "scope").agg(F.max((F.col("kind") != 4).cast("int")).alias("has_secret"))
    # A bare key needs its identifier alone; an endpoint also needs a secret of any kind beside the identifier.
    return beside.where("kind >= 3").join(scopes, ["row", "scope"]).where("kind = 3 OR has_secret = 1").select("row", "start", "end", "kind")


def _line(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _in_order(spans: Column) -> Column:
    """By start, then kind."""
    return F.transform(F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_gap: int = MAX_GAP) -> DataFrame:
    """One row per row of ``docs``: doc_id, base spans, all spans (base and linked), and counts per strong kind."""
    found = written(matches(docs, id_col, text_col), "secret-matches")
    spans = written(placed(found.where(F.size("found") > 0)), "secret-spans")
    strong = spans.where(F.col("kind") <= 2).select("row", "doc_id", "start", "end", "kind", "keep")
    extra = linked(spans, max_gap).select("row", F.lit(None).cast(dict(found.dtypes)["doc_id"]).alias("doc_id"), "start", "end", "kind", F.lit(True).alias("keep"))
    span = F.struct("start", "end", "kind")
    of = lambda test: F.collect_list(F.when(F.col("keep") & test, span))
    n = lambda kind: F.count_if(F.col("keep") & (F.col("kind") == kind))
    # Linked spans are of texts with strong ones, whose rows carry the id.
    some = strong.unionByName(extra).groupBy("row").agg(F.first("doc_id", ignorenulls=True).alias("doc_id"), n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), of(F.col("kind") <= 2).alias("base"), of(F.lit(True)).alias("all"))
    some = some.select("doc_id", "n_assign", "n_access", "n_hex", _in_order(F.col("base")).alias("base"), _in_order(F.col("all")).alias("all"))
    zero, nothing = F.lit(0).cast("long"), F.array().cast("array<struct<start:int,end:int,kind:int>>")
    none = found.where(F.size("found") == 0).select("doc_id", zero.alias("n_assign"), zero.alias("n_access"), zero.alias("n_hex"), nothing.alias("base"), nothing.alias("all"))
    return none.unionByName(some)


def secret_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_gap: int = MAX_GAP) -> DataFrame:
    """``secret_spans`` with spans written as ``kind:start:end`` joined by commas, and a digest of the base ones."""
    rows = secret_spans(docs, id_col, text_col, max_gap)
    return rows.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(_line(F.col("base")), 256).alias("base_sha256"), _line(F.col("all")).alias("spans"))
