"""Document fingerprints: every shingle hash under a fixed fraction.

A fingerprint is the sorted set of the shingle hashes that lie under a threshold.
The threshold is the same for all texts, so the fingerprint of a union is the
union of fingerprints, and the share of one text that another holds can be told
from the two alone, also when one is a thousand times as long. A text without a
hash under the threshold keeps its least one, so that only a text without a word
has an empty fingerprint; as the least of a union is the least of the parts,
fingerprints still merge.

DataFrame functions only: fingerprints are made where the text lies, and one
shuffle brings neighbouring documents together.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patchlight.llm.registry import ORACLES, query, table

#: Words of a shingle, the share of hashes kept (a multiple of 1/16), and hexadecimal digits of a hash (a long holds them).
SHINGLE, SHARE, DIGITS = 5, 0.25, 15
#: Documents that a sorted range holds on average, and the most ranges: beyond them each holds more.
BUCKET, MOST_BUCKETS = 1000, 100_000


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", -1), lambda w: w != "")


def _sixteenths(share: float) -> int:
    if not 1 <= share * 16 <= 16 or share * 16 % 1:
        raise ValueError("the share of hashes is a multiple of 1/16")
    return int(share * 16)


def _low(hashes: Column, share: float) -> Column:
    return F.filter(hashes, lambda h: h < _sixteenths(share) << 4 * (DIGITS - 1))


def sketch(text: Column, shingle: int = SHINGLE, share: float = SHARE) -> Column:
    """Sorted array of hashes (the first 60 bits of MD5) of the word shingles, joined by a space, that lie under ``share``.

    A text of fewer words than a shingle is one shingle, a null or wordless one has
    an empty array. If no hash lies under the threshold the least stays.
    """

    def hashes(words: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(words) - (shingle - 1), F.lit(1)))
        return F.transform(starts, lambda i: F.md5(F.array_join(F.slice(words, i, F.lit(shingle)), " ")))

    first = f"{_sixteenths(share):x}" if share < 1 else "g"

    def kept(found: Column) -> Column:
        low = F.filter(found, lambda h: h < first)
        return F.when(F.size(low) > 0, low).otherwise(F.array(F.array_min(found)))

    # A transform over a single value names it, so that it is worked out once.
    once = lambda value, then: F.element_at(F.transform(F.array(value), then), 1)
    number = lambda h: F.conv(F.substring(h, 1, DIGITS), 16, 10).cast("bigint")
    nothing = F.array().cast("array<bigint>")
    made = lambda words: once(hashes(words), lambda found: F.array_sort(F.array_distinct(F.transform(kept(found), number))))
    return once(words_of(text), lambda words: F.when(F.size(words) > 0, made(words)).otherwise(nothing))


def merged(a: Column, b: Column, share: float = SHARE) -> Column:
    """The sketch of two texts taken together (shingles across their border are not in it)."""
    both = F.array_sort(F.array_union(a, b))
    return F.when(F.size(_low(both, share)) > 0, _low(both, share)).otherwise(F.slice(both, 1, 1))


def likeness(a: Column, b: Column) -> Column:
    """Shared hashes over all hashes of two sketches (Jaccard); 1 for two empty ones."""
    shared = F.size(F.array_intersect(a, b))
    every = F.size(a) + F.size(b) - shared
    return F.when(every == 0, F.lit(1.0)).otherwise(shared / every)


def containment(a: Column, b: Column) -> Column:
    """Share of the first text that the second holds: shared hashes over hashes of the first; 1 for an empty first one."""
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def fingerprint(hashes: Column) -> Column:
    """The hashes as a string of lowercase hexadecimal digits, DIGITS for each."""
    return F.array_join(F.transform(hashes, lambda h: F.lpad(F.lower(F.hex(h)), DIGITS, "0")), "")


def with_next(rows: DataFrame, key: str, tie: str, also: list[str], bucket: int = BUCKET) -> DataFrame:
    """Adds ``next``, a struct of the columns ``also`` of the row that follows in descending order of ``key``; the first follows the last.

    ``key`` and ``tie`` are longs; ties go in descending order of ``tie``, null keys come
    last, and rows that share both follow each other in any order. Rows go to at most
    MOST_BUCKETS ranges of the key with about ``bucket`` rows each or more (a key of many rows gets several
    ranges, dealt by ``tie``), are sorted there, and the last row of a range goes to the
    next one too. So one shuffle does, and ranges hold their share of the rows.
    """
    n, nulls = rows.agg(F.count("*"), F.sum(F.col(key).isNull().cast("long"))).first()
    if not n:
        return rows.withColumn("next", F.struct(*also))
    buckets = math.ceil(n / max(bucket, n / MOST_BUCKETS))
    marks = [k / buckets for k in range(1, buckets)]
    # One long for each range reaches the driver and, folded to a literal, the tasks.
    bounds = rows.agg(F.percentile_approx(key, F.array(*map(F.lit, marks)), 20 * buckets)).first()[0] if marks else None
    bounds = sorted(bounds or [])
    edges = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<long>") if bounds else F.array().cast("array<long>")
    steps = F.sequence(F.lit(1), F.lit(len(bounds).bit_length() + 1))

    def place(after: bool) -> Column:
        """Number of bounds that are less than the key, or with ``after`` not greater, by bisection."""

        def halve(at: Column, _: Column) -> Column:
            open_, middle = at["low"] < at["high"], F.shiftright(at["low"] + at["high"], 1)
            bound = F.get(edges, middle)
            right = bound <= F.col(key) if after else bound < F.col(key)
            low = F.when(open_ & right, middle + 1).otherwise(at["low"])
            return F.struct(low.alias("low"), F.when(open_ & ~right, middle).otherwise(at["high"]).alias("high"))

        return F.aggregate(steps, F.struct(F.lit(0).alias("low"), F.lit(len(bounds)).alias("high")), halve, lambda at: at["low"])

    empty = math.ceil((nulls or 0) * buckets / n)
    part = lambda n_parts: F.least(F.floor((F.col(tie) / F.lit(2.0**64) + 0.5) * n_parts).cast("int"), n_parts - 1)
    ranged = rows.withColumns({"_first": place(False), "_last": place(True)})
    at = F.col("_first") + part(F.col("_last") - F.col("_first") + 1)
    dealt = ranged.withColumn("_at", F.when(F.col(key).isNull(), part(F.lit(empty)) - empty).otherwise(at)).drop("_first", "_last")

    ends = dealt.groupBy("_at").agg(F.max(F.struct(key, tie)).alias("_end"))
    ordered = Window.orderBy("_at")
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    following = F.coalesce(F.lead("_at").over(ordered), F.first("_at").over(whole)).alias("_to")
    ends = F.broadcast(ends.select("_at", "_end", following))  # one row for each range
    is_end = F.col(key).eqNullSafe(F.col("_end")[key]) & (F.col(tie) == F.col("_end")[tie])
    own = F.struct(F.col("_at").alias("at"), F.lit(False).alias("guest"))
    guest = F.struct(F.col("_to").alias("at"), F.lit(True).alias("guest"))
    seats = dealt.join(ends, "_at").withColumn("_seat", F.explode(F.when(is_end, F.array(own, guest)).otherwise(F.array(own)))).drop("_at", "_end", "_to")
    order = Window.partitionBy("_seat.at").orderBy(F.desc("_seat.guest"), F.asc_nulls_first(key), F.asc(tie))
    return seats.withColumn("next", F.lag(F.struct(*also)).over(order)).where(~F.col("_seat.guest")).drop("_seat")


def sketched(docs: DataFrame, shingle: int = SHINGLE, share: float = SHARE) -> DataFrame:
    """(doc_id, text, n_chars, hashes) of every row of docs(doc_id, text).

    A null text is empty. Empty and blank texts have no hashes; repeated rows and null
    ids stay rows; other columns are ignored; an empty table gives an empty one.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.select("doc_id", "text", F.length("text").cast("long").alias("n_chars"), sketch(F.col("text"), shingle, share).alias("hashes"))


def with_edited(docs: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Adds ``edited`` and ``next_hashes`` to the rows of ``sketched``: the last third of a text gives way to the start of the next document's.

    Documents follow in descending order of doc_id, the first follows the last, null
    ids come last, and rows of one id follow in descending order of a hash of their text.
    """
    rows = sketched(docs).withColumn("tie", F.xxhash64("text"))
    third = F.floor(F.col("n_chars") / 3).cast("int")
    kept = F.substring(F.col("text"), F.lit(1), F.length("text") - third)
    edited = F.concat(kept, F.substring(F.col("next.text"), F.lit(1), third))
    found = with_next(rows, "doc_id", "tie", ["text", "hashes"], bucket)
    return found.select("doc_id", "text", "n_chars", "hashes", edited.alias("edited"), F.col("next.hashes").alias("next_hashes"))


@query
def op12_document_fingerprints(spark, sf_dir):
    """Fingerprints of every document and of its edited text, and how alike they are."""
    rows = with_edited(table(spark, sf_dir, "documents"))
    rows = rows.withColumn("edited_hashes", sketch(F.col("edited")))
    own = F.col("hashes")
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), fingerprint(own).alias("fingerprint"),
        fingerprint(F.col("edited_hashes")).alias("edited_fingerprint"), likeness(own, F.col("edited_hashes")).alias("near_edited"),
        likeness(own, F.col("next_hashes")).alias("near_next"), containment(own, F.col("edited_hashes")).alias("held_by_edited"),
    )


def _sketch_sql(text: str) -> str:
    words = rf"list_filter(string_split_regex({text}, '[\x20\x09-\x0D]+'), lambda w: w <> '')"
    return f"""(SELECT CASE WHEN len(w) = 0 THEN [] WHEN len(low) = 0 THEN [substr(list_min(h), 1, {DIGITS})]
      ELSE list_sort(list_distinct(list_transform(low, lambda x: substr(x, 1, {DIGITS})))) END
    FROM (SELECT w, h, list_filter(h, lambda x: x < '{_sixteenths(SHARE):x}') AS low
      FROM (SELECT w, list_transform(range(1, greatest(len(w) - {SHINGLE - 1}, 1) + 1), lambda i: md5(array_to_string(w[i : i + {SHINGLE - 1}], ' '))) AS h
        FROM (SELECT {words} AS w))))"""


def _likeness_sql(a: str, b: str) -> str:
    shared = f"len(list_intersect({a}, {b}))"
    return f"CASE WHEN len({a}) + len({b}) = 0 THEN 1.0 ELSE {shared}::DOUBLE / (len({a}) + len({b}) - {shared}) END"


ORACLES["op12_document_fingerprints"] = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n_chars FROM documents),
n AS (
  SELECT *, coalesce(lead(text) OVER (ORDER BY doc_id DESC NULLS LAST),
    first_value(text) OVER (ORDER BY doc_id DESC NULLS LAST)) AS next FROM d),
e AS (SELECT *, substr(text, 1, n_chars - n_chars // 3) || substr(next, 1, n_chars // 3) AS edited FROM n),
s AS (SELECT *, {_sketch_sql("text")} AS own, {_sketch_sql("edited")} AS other, {_sketch_sql("next")} AS near FROM e)
SELECT doc_id, n_chars, sha256(edited) AS edited_sha256, array_to_string(own, '') AS fingerprint, array_to_string(other, '') AS edited_fingerprint,
  {_likeness_sql("own", "other")} AS near_edited, {_likeness_sql("own", "near")} AS near_next,
  CASE WHEN len(own) = 0 THEN 1.0 ELSE len(list_intersect(own, other))::DOUBLE / len(own) END AS held_by_edited
FROM s"""
