"""Exact deduplication by content hash with comparison of bytes (operator 13).

Rows are grouped by the 128-bit hash of their normalised text and the row of
the smallest id stays.  Texts of groups with several rows are then compared:
a group whose smallest and largest text differ in bytes holds a collision and
is grouped again by the text itself.  Both aggregates combine on the map side,
so a text that a third of all rows share leaves each task once, and the join
that hands a group's result to its rows splits large groups over tasks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import BROADCAST_ROWS, salted_join, written

SPACES = "[\\x20\\x09-\\x0D]+"


def normalised(text: Column) -> Column:
    """The text with each run of ASCII white space as one space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def _grouped(rows: DataFrame, key: str) -> DataFrame:
    """key, rows of the group and the row that stays: smallest doc_id (nulls last), then smallest row number."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "row")).alias("first")
    return rows.groupBy(key).agg(F.count("*").alias("n"), first)


def _flagged(rows: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    found = salted_join(rows, groups.withColumn("group_size", F.col("n")), [key], "n", "row")
    return found.select("doc_id", F.col("first.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("first.row")).alias("kept"), "text_sha256")


def exact_duplicates(docs: DataFrame, digest: Callable[[Column], Column] = F.md5) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of each row of ``docs``.

    Texts are equal when their normalised forms are the same bytes; ``digest``
    only speeds this up, so a weak one changes nothing but the cost.  Of equal
    texts the row with the smallest doc_id stays; null ids come after all
    others, and of rows alike in id as well exactly one stays.  A null text is
    an empty one, equal to it but not to a blank one, which is one space.  One
    row per input row, an empty table gives an empty result; other columns are
    ignored, so that their names cannot clash.
    """
    text = normalised(F.col("text"))
    # row numbers hold because the table is written once and read from then on
    rows = docs.select("doc_id", text.alias("text"), F.monotonically_increasing_id().alias("row"))
    rows = written(rows.withColumns({"digest": F.unhex(digest(F.col("text"))), "text_sha256": F.sha2(F.col("text").cast("binary"), 256)}))
    slim = rows.drop("text")
    groups = written(_grouped(slim, "digest"))
    several = groups.where("n > 1").select("digest", "n")
    whole = rows.select("digest", "text", "row")
    if several.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        members = whole.join(F.broadcast(several.select("digest")), "digest")
    else:
        members = salted_join(whole, several, ["digest"], "n", "row")
    ends = members.groupBy("digest").agg(F.min("text").alias("low"), F.max("text").alias("high"))
    mixed = written(ends.where("low <> high").select("digest"))
    if not mixed.limit(1).count():
        return _flagged(slim, groups, "digest")
    # rows of a digest that stands for different texts are grouped by the text
    alone = groups.join(mixed, "digest", "left_anti")
    collided = written(rows.join(mixed, "digest", "left_semi"))
    again = written(_grouped(collided, "text"))
    return _flagged(slim.join(mixed, "digest", "left_anti"), written(alone), "digest").unionByName(_flagged(collided, again, "text"))


def without_copies(docs: DataFrame, digest: Callable[[Column], Column] = F.md5) -> DataFrame:
    """``docs`` with one row of each group of equal texts, all its columns kept.

    The row that stays is that of the smallest doc_id, whose text is looked up
    by id and hash; nulls, ties and empty tables as in ``exact_duplicates``.
    """
    kept = written(exact_duplicates(docs.select("doc_id", "text"), digest).where("kept").select("doc_id", "text_sha256"))
    own = docs.select(F.col("doc_id").alias("_id"), F.sha2(normalised(F.col("text")).cast("binary"), 256).alias("_sha"), F.struct(*docs.columns).alias("whole"))
    found = own.join(kept, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_sha") == F.col("text_sha256")), "left_semi")
    # rows alike in id and text became one among the flags
    return found.dropDuplicates(["_id", "_sha"]).select("whole.*")


def query(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256."""
    return exact_duplicates(docs)


ORACLE = """with t as (select doc_id, coalesce(text, '') as raw, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') as norm from documents),
g as (select *, first_value(doc_id) over w as keep_id, row_number() over w as place, count(*) over (partition by norm) as group_size from t window w as (partition by norm order by doc_id nulls last, raw))
select doc_id, keep_id, group_size, place = 1 as kept, sha256(norm) as text_sha256 from g"""
