"""Exact deduplication that no group of copies can slow down.

Three stages, each grouping by digest AND by the full normalised text, so a digest that two texts share
never merges them:

1. locally, in each scan task, as the map side of the first aggregation;
2. among salts (a scan task belongs to one of ``salts``), so a group meets in ``salts`` places at most;
3. globally, from one row for each salt and text.

Defined results: a null text counts as empty; empty texts are copies of each other; texts are equal when
identical after lower-casing A-Z; of equal texts the row with the largest id stays (a null id is smaller
than any other); a row repeated with its id is marked like the row it repeats, but ``without_copies`` keeps one row
of each text; further columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landshift.sources.shared import written

SALTS = 64


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def sha256_of(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def winners(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=sha256_of, salts: int = SALTS) -> DataFrame:
    """One row per distinct normalised text: digest, content, keep_id, group_size."""
    base = docs.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("content"))
    base = base.select("id", "content", digest(F.col("content")).alias("digest"), F.pmod(F.spark_partition_id(), F.lit(salts)).alias("salt"))
    salted = base.groupBy("digest", "salt", "content").agg(F.max("id").alias("id"), F.count("*").alias("n"))
    return salted.groupBy("digest", "content").agg(F.max("id").alias("keep_id"), F.sum("n").alias("group_size"))


def marked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=sha256_of, salts: int = SALTS) -> DataFrame:
    """``docs`` with digest, keep_id, group_size and kept for every row.

    The way back to the rows joins on the digest alone, whose side of rows AQE may split; only where two
    texts share a digest does it also compare full texts.
    """
    found = written(
        winners(docs, id_col, text_col, digest, salts)
        .groupBy("digest")
        .agg(F.count("*").alias("texts"), F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size")),
        "exact-winners",
    )
    rows = docs.withColumn("digest", digest(normalised(F.col(text_col))))
    one = found.where("texts = 1").select("digest", "keep_id", "group_size")
    out = rows.join(one, "digest")
    shared = found.where("texts > 1").select("digest")
    if not shared.isEmpty():
        clash = rows.join(shared, "digest", "left_semi").withColumn("content", normalised(F.col(text_col)))
        out = out.unionByName(clash.join(winners(docs, id_col, text_col, digest, salts), ["digest", "content"]).drop("content"))
    return out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("keep_id")))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=sha256_of, salts: int = SALTS) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256 (of the normalised text)."""
    slim = marked(docs.select(id_col, text_col), id_col, text_col, digest, salts)
    sha = F.lower(F.hex("digest")) if digest is sha256_of else F.sha2(normalised(F.col(text_col)), 256)
    return slim.select(id_col, "keep_id", "group_size", "kept", sha.alias("text_sha256"))


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, one for each text, with the columns of ``docs``.

    Where several rows have a text and its largest id -- rows repeated in full, or without an id -- the least of them
    in the order of all columns stays. Which those are is told by digest and id alone; texts are grouped only there,
    and first on the map side."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    stay = marked(rows, f"row.`{id_col}`", f"row.`{text_col}`").where("kept").select("row", "digest", "keep_id")
    again = written(stay.groupBy("digest", "keep_id").agg(F.count("*").alias("n")).where("n > 1").select("digest", "keep_id"), "exact-again")
    same = (stay.digest == again.digest) & stay.keep_id.eqNullSafe(again.keep_id)
    once = stay.join(again, same, "left_anti").select("row")
    # Texts that share a digest are told apart here as everywhere.
    content = normalised(F.col(f"row.`{text_col}`")).alias("content")
    least = stay.join(again, same, "left_semi").groupBy("digest", "keep_id", content).agg(F.min("row").alias("row")).select("row")
    return once.unionByName(least).select(*[F.col("row")[c].alias(c) for c in docs.columns])
