"""Queries of the training-data operators over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import byte_bpe, frequent, leakage, mojibake, personal_info, set_sketch
from millrace.session import ensure_checkpoint, table


def _garbled(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.garbled_fields(table(spark, d, "hits"), "WatchID", ["Title", "URL"], ["URL"])


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _garbled(spark, d).select("WatchID", "field")


def p2_repaired(spark: SparkSession, d: str) -> DataFrame:
    return _garbled(spark, d)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    stats = table(spark, d, "search_phrase_stats").filter((F.col("key") != "") & F.col("stat_date").isNotNull())
    cells = set_sketch.repeated_cells(stats, ["stat_date", "key"], "distinct_users")
    return cells.select(F.date_format("stat_date", "yyyy-MM-dd").alias("stat_date"), "key")


_GROUPINGS = (["stat_date"], ["key"], ["stat_date", "key"])


def p3_distinct(spark: SparkSession, d: str) -> DataFrame:
    """Per day, per key and per combination, from one sketch of the finest groups."""
    ensure_checkpoint(spark)
    partial = set_sketch.merge(set_sketch.sketch(table(spark, d, "search_phrase_stats"), ["stat_date", "key"], "distinct_users"), ["stat_date", "key"]).checkpoint()
    out = None
    for groups in _GROUPINGS:
        one = set_sketch.distinct_counts(partial, groups)
        one = one.select(
            F.lit("+".join(groups)).alias("grouping"),
            (F.date_format("stat_date", "yyyy-MM-dd") if "stat_date" in groups else F.lit(None).cast("string")).alias("stat_date"),
            (F.col("key") if "key" in groups else F.lit(None).cast("string")).alias("key"),
            "listed", "distinct_ids", "error",
        )
        out = one if out is None else out.unionByName(one)
    return out


def p3_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Of each key, users of a week and of the next one."""
    stats = table(spark, d, "search_phrase_stats").withColumn("week", F.date_trunc("week", "stat_date").cast("date"))
    partial = set_sketch.sketch(stats, ["week", "key"], "distinct_users")
    before = partial.withColumn("week", F.date_add("week", 7))
    return set_sketch.overlaps(before, partial, ["week", "key"])


#: Deviations of the stated error that a check allows; thousands of cells stay below six.
_DEVIATIONS = 6


def _close(estimate: str, exact: str, error: Column) -> Column:
    return F.abs(F.col(estimate) - F.col(exact)) <= _DEVIATIONS * error + 0.5


def p3_distinct_checked(spark: SparkSession, d: str) -> DataFrame:
    """The estimates beside exact counts: whether each lies within its stated error."""
    stats = table(spark, d, "search_phrase_stats").select(F.date_format("stat_date", "yyyy-MM-dd").alias("stat_date"), "key", F.explode_outer("distinct_users").alias("id"))
    exact = None
    for groups in _GROUPINGS:
        one = stats.groupBy(*groups).agg(F.count_distinct("id").alias("exact"))
        one = one.select(F.lit("+".join(groups)).alias("grouping"), *[F.col(c) if c in groups else F.lit(None).cast("string").alias(c) for c in ("stat_date", "key")], "exact")
        exact = one if exact is None else exact.unionByName(one)
    a, c = p3_distinct(spark, d), exact.toDF("g", "s", "k", "exact")
    both = a.join(c, (F.col("grouping") == F.col("g")) & F.col("stat_date").eqNullSafe(F.col("s")) & F.col("key").eqNullSafe(F.col("k")), "full")
    return both.select("grouping", "stat_date", "key", "listed", "exact", _close("distinct_ids", "exact", F.col("error") * F.col("exact")).alias("within"))


def p3_overlap_checked(spark: SparkSession, d: str) -> DataFrame:
    """The joint estimates beside exact counts: whether union, intersection and Jaccard lie within their stated errors."""
    stats = table(spark, d, "search_phrase_stats").select(F.date_trunc("week", "stat_date").cast("date").alias("week"), "key", F.explode("distinct_users").alias("id")).filter("id IS NOT NULL").distinct()
    sides = stats.select(F.date_add("week", 7).alias("w"), F.col("key").alias("k"), "id", F.lit(1).alias("side")).unionByName(stats.select(F.col("week").alias("w"), F.col("key").alias("k"), "id", F.lit(2).alias("side")))
    users = sides.groupBy("w", "k", "id").agg(F.sum("side").alias("in"))
    exact = users.groupBy("w", "k").agg(F.count(F.lit(1)).alias("exact_union"), F.count_if(F.col("in") == 3).alias("exact_both"), F.bit_or("in").alias("sides")).filter("sides = 3")
    both = p3_overlap(spark, d).join(exact, F.col("week").eqNullSafe(F.col("w")) & F.col("key").eqNullSafe(F.col("k")), "inner")
    return both.select(
        "week", "key", "exact_union", "exact_both",
        _close("union_ids", "exact_union", F.col("union_error") * F.col("exact_union")).alias("union_within"),
        _close("both_ids", "exact_both", F.col("union_error") * F.col("exact_union")).alias("both_within"),
        (F.abs(F.col("jaccard") - F.col("exact_both") / F.col("exact_union")) <= _DEVIATIONS * F.col("jaccard_error")).alias("jaccard_within"),
    )


_ITEMS = (("hits.URL", "hits", "URL", None, 0.005), ("search_phrase_group.key", "search_phrase_group", "key", "count", 0.01))


def p4_frequent(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for field, name, item, weight, share in _ITEMS:
        one = frequent.frequent(table(spark, d, name), item, weight, share).select(F.lit(field).alias("field"), "item", "estimate", "slack", "weight")
        out = one if out is None else out.unionByName(one)
    return out


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_frequent(spark, d).select("field", "item")


def p4_weights(spark: SparkSession, d: str) -> DataFrame:
    """Exact weights of the frequent items, and whether the summary's bounds hold them."""
    found = p4_frequent(spark, d)
    return found.select("field", "item", "weight", ((F.col("estimate") <= F.col("weight")) & (F.col("weight") <= F.col("estimate") + F.col("slack"))).alias("bounded"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return byte_bpe.encode_texts(table(spark, d, "documents"), "doc_id", "text")


def p6_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Decodes the ids of every text again: whether the text came back."""
    docs = table(spark, d, "documents")
    ids = byte_bpe.encode_texts(docs, "doc_id", "text")
    back = byte_bpe.decode_ids(ids, "doc_id", "ids").select("doc_id", F.xxhash64("text").alias("h"))
    want = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("w"))
    return back.join(want, "doc_id").select("doc_id", (F.col("h") == F.col("w")).alias("same"))


def p7_passages(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_passages(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "benchmark"), "item_id", "text")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_passages(spark, d).select("doc_id", "item_id")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return personal_info.find_personal_info(table(spark, d, "documents"), "doc_id", "text")


def p8_redacted(spark: SparkSession, d: str) -> DataFrame:
    return personal_info.redact(table(spark, d, "documents"), "doc_id", "text")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (p2_found, p2_repaired, p3_found, p3_distinct, p3_distinct_checked, p3_overlap, p3_overlap_checked, p4_found, p4_frequent, p4_weights, p6_ids, p6_roundtrip, p7_found, p7_passages, p8_found, p8_redacted)
    }


_FREQUENT_SQL = """
            SELECT 'hits.URL' AS field, URL AS item, CAST(count(*) AS BIGINT) AS weight FROM hits WHERE URL <> '' GROUP BY URL
            HAVING count(*) * 200 >= (SELECT count(*) FROM hits WHERE URL <> '')
            UNION ALL
            SELECT 'search_phrase_group.key', key, CAST(sum(count) AS BIGINT) FROM search_phrase_group WHERE key <> '' GROUP BY key
            HAVING sum(count) * 100 >= (SELECT sum(count) FROM search_phrase_group WHERE key <> '')"""


def oracle_sql() -> dict[str, str]:
    cell = "SELECT '{0}' AS grouping, {1} AS stat_date, {2} AS key, CAST(count(id) AS BIGINT) AS listed, count(DISTINCT id) AS exact, true AS within FROM u GROUP BY {3}"
    return {
        "p3_found": """
            WITH u AS (SELECT stat_date, key, unnest(distinct_users) AS id FROM search_phrase_stats WHERE key <> '' AND stat_date IS NOT NULL)
            SELECT strftime(stat_date, '%Y-%m-%d') AS stat_date, key FROM u GROUP BY stat_date, key HAVING count(DISTINCT id) * 2 <= count(id)""",
        "p3_distinct_checked": "WITH u AS (SELECT strftime(stat_date, '%Y-%m-%d') AS day, key AS k, unnest(CASE WHEN len(distinct_users) > 0 THEN distinct_users ELSE [NULL] END) AS id FROM search_phrase_stats) "
        + " UNION ALL ".join(cell.format(*x) for x in (("stat_date", "day", "CAST(NULL AS VARCHAR)", "day"), ("key", "CAST(NULL AS VARCHAR)", "k", "k"), ("stat_date+key", "day", "k", "day, k"))),
        "p3_overlap_checked": """
            WITH u AS (SELECT DISTINCT CAST(date_trunc('week', stat_date) AS DATE) AS week, key, unnest(distinct_users) AS id FROM search_phrase_stats),
            named AS (SELECT * FROM u WHERE id IS NOT NULL),
            sides AS (SELECT CAST(week + INTERVAL 7 DAY AS DATE) AS week, key, id, 1 AS side FROM named UNION ALL SELECT week, key, id, 2 FROM named),
            users AS (SELECT week, key, id, sum(side) AS both_sides FROM sides GROUP BY week, key, id)
            SELECT week, key, count(*) AS exact_union, count(*) FILTER (WHERE both_sides = 3) AS exact_both, true AS union_within, true AS both_within, true AS jaccard_within
            FROM users GROUP BY week, key HAVING bit_or(CAST(both_sides AS INTEGER)) = 3""",
        "p4_found": f"SELECT field, item FROM ({_FREQUENT_SQL})",
        "p4_weights": f"SELECT field, item, weight, true AS bounded FROM ({_FREQUENT_SQL})",
        "p6_roundtrip": "SELECT doc_id, true AS same FROM documents",
    }
