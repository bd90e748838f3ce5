"""The dialect's queries over the driver's tables, each with its SQL oracle.

A query is dialect text; its oracle is the same question in the oracle's SQL,
with the dialect's rules written out: integer averages, sums as 64-bit
integers, zero over no rows, and a total order under every limit.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.engine import Engine
from millrace.session import table, table_path
from millrace.types import named


@dataclass(frozen=True)
class Case:
    """``names`` rename the output; ``order`` are output names, ``-`` before a descending one.

    ``footers`` lets file footers answer; ``text`` gives sums as text, which shows all their digits;
    ``columns`` lists the names that the dialect gives the output; ``prepare`` derives the table asked.
    """

    table: str
    dialect: str
    oracle: str
    names: tuple[str, ...]
    order: tuple[str, ...] = ()
    tail: str = ""
    footers: bool = False
    text: bool = False
    columns: bool = False
    prepare: Callable[[DataFrame], DataFrame] | None = None

    def run(self, spark: SparkSession, d: str) -> DataFrame:
        engine = Engine(spark, metadata_aggregates=self.footers)
        source = table_path(d, self.table) if self.prepare is None else self.prepare(table(spark, d, self.table))
        engine.register_table(self.table, source)
        out = engine.sql(self.dialect)
        if self.columns:
            return spark.createDataFrame(list(enumerate(out.columns, 1)), "i int, name string")
        out = out.toDF(*self.names)
        # the oracle has no 38-digit sums: both sides give 64-bit integers, or text
        kinds = {f.name: "string" if self.text else "bigint" for f in out.schema.fields if isinstance(f.dataType, T.DecimalType)}
        return out.selectExpr(*[f"cast({n} as {kinds[n]}) {n}" if n in kinds else n for n in out.columns]) if kinds else out

    def sql(self) -> str:
        if not self.tail:
            return self.oracle
        keys = [f"{k[1:]} DESC NULLS LAST" if k[0] == "-" else f"{k} ASC NULLS FIRST" for k in self.order]
        rest = [f"{n} ASC NULLS FIRST" for n in self.names]
        return f"SELECT {', '.join(self.names)} FROM ({self.oracle}) ORDER BY {', '.join(keys + rest)} {self.tail}"


def _sum(x: str) -> str:
    return f"CAST(coalesce(sum({x}), 0) AS BIGINT)"


def _avg(x: str) -> str:
    return f"CAST(coalesce(sum(CAST({x} AS HUGEINT)) // nullif(count({x}), 0), 0) AS BIGINT)"


def _hits(dialect: str, oracle: str, names: str, order: str = "", tail: str = "") -> Case:
    return Case("hits", dialect, oracle, tuple(names.split()), tuple(order.split()), tail)


_DOMAIN = r"^https?://(?:www\.)?([^/]+)/.*$"
#: The skewed counter of the click table is looked up through a range, so the queries find rows at any scale.
_MONTH = "EventDate >= '2023-01-03' AND EventDate <= '2023-01-12'"

#: The texts of q00 to q42 ask the 43 questions of a public benchmark on one table.
CASES: dict[str, Case] = {
    "q00_count": Case("hits", "SELECT COUNT(*) FROM hits", "SELECT count(*) AS c FROM hits", ("c",), footers=True),
    "q01_count_ne": _hits("SELECT COUNT(*) FROM hits WHERE AdvEngineID <> 0", "SELECT count(*) AS c FROM hits WHERE AdvEngineID <> 0", "c"),
    "q02_sum_count_avg": _hits(
        "SELECT SUM(AdvEngineID), COUNT(*), AVG(ResolutionWidth) FROM hits",
        f"SELECT {_sum('AdvEngineID')} AS s, count(*) AS c, {_avg('ResolutionWidth')} AS a FROM hits", "s c a"),
    "q03_avg_bigint": _hits("SELECT AVG(UserID) FROM hits", f"SELECT {_avg('UserID')} AS a FROM hits", "a"),
    "q04_distinct_int": _hits("SELECT COUNT(DISTINCT UserID) FROM hits", "SELECT count(DISTINCT UserID) AS u FROM hits", "u"),
    "q05_distinct_str": _hits("SELECT COUNT(DISTINCT SearchPhrase) FROM hits", "SELECT count(DISTINCT SearchPhrase) AS u FROM hits", "u"),
    "q06_min_max_date": Case("hits", "SELECT MIN(EventDate), MAX(EventDate) FROM hits", "SELECT min(EventDate) AS lo, max(EventDate) AS hi FROM hits", ("lo", "hi"), footers=True),
    "q07_group_filter_order": _hits(
        "SELECT AdvEngineID, COUNT(*) FROM hits WHERE AdvEngineID <> 0 GROUP BY AdvEngineID ORDER BY COUNT(*) DESC",
        "SELECT AdvEngineID AS k, count(*) AS c FROM hits WHERE AdvEngineID <> 0 GROUP BY k", "k c"),
    "q08_group_distinct_topk": _hits(
        "SELECT RegionID, COUNT(DISTINCT UserID) AS u FROM hits GROUP BY RegionID ORDER BY u DESC LIMIT 10",
        "SELECT RegionID AS k, count(DISTINCT UserID) AS u FROM hits GROUP BY k", "k u", "-u", "LIMIT 10"),
    "q09_group_multi_agg_topk": _hits(
        "SELECT RegionID, SUM(AdvEngineID), COUNT(*) AS c, AVG(ResolutionWidth), COUNT(DISTINCT UserID) FROM hits GROUP BY RegionID ORDER BY c DESC LIMIT 10",
        f"SELECT RegionID AS k, {_sum('AdvEngineID')} AS s, count(*) AS c, {_avg('ResolutionWidth')} AS a, count(DISTINCT UserID) AS u FROM hits GROUP BY k", "k s c a u", "-c", "LIMIT 10"),
    "q10_str_ne_empty": _hits(
        "SELECT MobilePhoneModel, COUNT(DISTINCT UserID) AS u FROM hits WHERE MobilePhoneModel <> '' GROUP BY MobilePhoneModel ORDER BY u DESC LIMIT 10",
        "SELECT MobilePhoneModel AS k, count(DISTINCT UserID) AS u FROM hits WHERE MobilePhoneModel <> '' GROUP BY k", "k u", "-u", "LIMIT 10"),
    "q11_two_keys_distinct": _hits(
        "SELECT MobilePhone, MobilePhoneModel, COUNT(DISTINCT UserID) AS u FROM hits WHERE MobilePhoneModel <> '' GROUP BY MobilePhone, MobilePhoneModel ORDER BY u DESC LIMIT 10",
        "SELECT MobilePhone AS p, MobilePhoneModel AS k, count(DISTINCT UserID) AS u FROM hits WHERE MobilePhoneModel <> '' GROUP BY p, k", "p k u", "-u", "LIMIT 10"),
    "q12_phrase_count": _hits(
        "SELECT SearchPhrase, COUNT(*) AS c FROM hits WHERE SearchPhrase <> '' GROUP BY SearchPhrase ORDER BY c DESC LIMIT 10",
        "SELECT SearchPhrase AS k, count(*) AS c FROM hits WHERE SearchPhrase <> '' GROUP BY k", "k c", "-c", "LIMIT 10"),
    "q13_phrase_distinct": _hits(
        "SELECT SearchPhrase, COUNT(DISTINCT UserID) AS u FROM hits WHERE SearchPhrase <> '' GROUP BY SearchPhrase ORDER BY u DESC LIMIT 10",
        "SELECT SearchPhrase AS k, count(DISTINCT UserID) AS u FROM hits WHERE SearchPhrase <> '' GROUP BY k", "k u", "-u", "LIMIT 10"),
    "q14_engine_phrase": _hits(
        "SELECT SearchEngineID, SearchPhrase, COUNT(*) AS c FROM hits WHERE SearchPhrase <> '' GROUP BY SearchEngineID, SearchPhrase ORDER BY c DESC LIMIT 10",
        "SELECT SearchEngineID AS e, SearchPhrase AS k, count(*) AS c FROM hits WHERE SearchPhrase <> '' GROUP BY e, k", "e k c", "-c", "LIMIT 10"),
    "q15_user_topk": _hits(
        "SELECT UserID, COUNT(*) FROM hits GROUP BY UserID ORDER BY COUNT(*) DESC LIMIT 10",
        "SELECT UserID AS k, count(*) AS c FROM hits GROUP BY k", "k c", "-c", "LIMIT 10"),
    "q16_user_phrase_topk": _hits(
        "SELECT UserID, SearchPhrase, COUNT(*) FROM hits GROUP BY UserID, SearchPhrase ORDER BY COUNT(*) DESC LIMIT 10",
        "SELECT UserID AS k, SearchPhrase AS p, count(*) AS c FROM hits GROUP BY k, p", "k p c", "-c", "LIMIT 10"),
    "q17_group_no_order_limit": _hits(
        "SELECT UserID, SearchPhrase, COUNT(*) FROM hits GROUP BY UserID, SearchPhrase LIMIT 10",
        "SELECT UserID AS k, SearchPhrase AS p, count(*) AS c FROM hits GROUP BY k, p", "k p c", "k p", "LIMIT 10"),
    "q18_extract_minute": _hits(
        "SELECT UserID, extract(minute FROM EventTime) AS m, SearchPhrase, COUNT(*) FROM hits GROUP BY UserID, m, SearchPhrase ORDER BY COUNT(*) DESC LIMIT 10",
        "SELECT UserID AS k, extract(minute FROM EventTime) AS m, SearchPhrase AS p, count(*) AS c FROM hits GROUP BY k, m, p", "k m p c", "-c", "LIMIT 10"),
    "q19_point_lookup": _hits("SELECT UserID FROM hits WHERE UserID = 2601938273365755431", "SELECT UserID AS k FROM hits WHERE UserID = 2601938273365755431", "k"),
    "q20_like_contains": _hits("SELECT COUNT(*) FROM hits WHERE URL LIKE '%garden%'", "SELECT count(*) AS c FROM hits WHERE URL LIKE '%garden%'", "c"),
    "q21_like_min_str": _hits(
        "SELECT SearchPhrase, MIN(URL), COUNT(*) AS c FROM hits WHERE URL LIKE '%garden%' AND SearchPhrase <> '' GROUP BY SearchPhrase ORDER BY c DESC LIMIT 10",
        "SELECT SearchPhrase AS k, min(URL) AS u, count(*) AS c FROM hits WHERE URL LIKE '%garden%' AND SearchPhrase <> '' GROUP BY k", "k u c", "-c", "LIMIT 10"),
    "q22_like_not_like": _hits(
        "SELECT SearchPhrase, MIN(URL), MIN(Title), COUNT(*) AS c, COUNT(DISTINCT UserID) FROM hits WHERE Title LIKE '%arden%' AND URL NOT LIKE '%.example/%' AND SearchPhrase <> '' GROUP BY SearchPhrase ORDER BY c DESC LIMIT 10",
        "SELECT SearchPhrase AS k, min(URL) AS u, min(Title) AS t, count(*) AS c, count(DISTINCT UserID) AS n FROM hits WHERE Title LIKE '%arden%' AND URL NOT LIKE '%.example/%' AND SearchPhrase <> '' GROUP BY k", "k u t c n", "-c", "LIMIT 10"),
    "q23_star_order_limit": _hits(
        "SELECT * FROM hits WHERE URL LIKE '%garden%' ORDER BY EventTime LIMIT 10", "SELECT * FROM hits WHERE URL LIKE '%garden%'",
        "WatchID Title EventTime EventDate ClientEventTime CounterID ClientIP RegionID UserID URL Referer IsRefresh ResolutionWidth MobilePhone MobilePhoneModel TraficSourceID SearchEngineID SearchPhrase AdvEngineID IsLink IsDownload DontCountHits WindowClientWidth",
        "EventTime", "LIMIT 10"),
    "star_events": Case(
        "events", "SELECT * FROM events WHERE event_type LIKE '%i%' ORDER BY ts LIMIT 10", "SELECT * FROM events WHERE event_type LIKE '%i%'",
        ("event_id", "ts", "user_id", "event_type", "value", "props"), ("ts",), "LIMIT 10"),
    "count_expr": _hits("SELECT COUNT(URL), COUNT(RegionID), COUNT(ClientIP - 1) FROM hits", "SELECT count(URL) AS u, count(RegionID) AS r, count(ClientIP - 1) AS i FROM hits", "u r i"),
    "count_expr_footers": Case("hits", "SELECT COUNT(URL), COUNT(*), MAX(CounterID) FROM hits", "SELECT count(URL) AS u, count(*) AS c, max(CounterID) AS m FROM hits", ("u", "c", "m"), footers=True),
    "having_without_group": _hits("SELECT COUNT(*), SUM(AdvEngineID) FROM hits HAVING COUNT(*) > 10", f"SELECT count(*) AS c, {_sum('AdvEngineID')} AS s FROM hits HAVING count(*) > 10", "c s"),
    "having_rejects_all": _hits("SELECT COUNT(*) FROM hits HAVING COUNT(*) < 0", "SELECT count(*) AS c FROM hits HAVING count(*) < 0", "c"),
    "empty_result": _hits("SELECT URL, EventDate, CounterID FROM hits WHERE CounterID < 0 AND CounterID > 0", "SELECT URL AS u, EventDate AS d, CounterID AS c FROM hits WHERE false", "u d c"),
    "default_names": Case(
        "hits", "SELECT h.RegionID, 7, RegionID - 1, COUNT(*), sum(RegionID), AVG(ResolutionWidth) AS width, MIN(h.EventDate), COUNT(DISTINCT UserID), max(strlen(URL)) FROM hits AS h GROUP BY RegionID, 2, RegionID - 1",
        "SELECT * FROM (VALUES (1, 'RegionID'), (2, '7'), (3, 'RegionID - 1'), (4, 'COUNT(*)'), (5, 'SUM(RegionID)'), (6, 'width'), (7, 'MIN(h.EventDate)'), (8, 'COUNT(DISTINCT UserID)'), (9, 'MAX(STRLEN(URL))')) AS t(i, name)",
        ("i", "name"), columns=True),
    "sum_beyond_64_bits": Case("hits", "SELECT SUM(UserID), SUM(WatchID + 5) FROM hits", "SELECT CAST(sum(CAST(UserID AS HUGEINT)) AS VARCHAR) AS u, CAST(sum(CAST(WatchID AS HUGEINT) + 5) AS VARCHAR) AS w FROM hits", ("u", "w"), text=True),
    "bool_sum": Case(
        "hits", "SELECT CounterID, SUM(Refreshed), AVG(Refreshed), COUNT(*) AS c FROM hits GROUP BY CounterID ORDER BY c DESC LIMIT 10",
        f"SELECT CounterID AS k, {_sum('CAST(IsRefresh = 1 AS INTEGER)')} AS s, {_avg('CAST(IsRefresh = 1 AS INTEGER)')} AS a, count(*) AS c FROM hits GROUP BY k",
        ("k", "s", "a", "c"), ("-c",), "LIMIT 10", prepare=lambda df: df.select("CounterID", (F.col("IsRefresh") == 1).alias("Refreshed"))),
    "char_sum": Case(
        "lineitem", "SELECT SUM(l_returnflag), AVG(l_returnflag), MAX(l_returnflag) FROM lineitem",
        f"SELECT {_sum('ascii(l_returnflag)')} AS s, {_avg('ascii(l_returnflag)')} AS a, max(l_returnflag) AS m FROM lineitem",
        ("s", "a", "m"), prepare=lambda df: df.select(named(F.col("l_returnflag"), "l_returnflag", "char"))),
    "q24_order_hidden": _hits(
        "SELECT SearchPhrase FROM hits WHERE SearchPhrase <> '' ORDER BY EventTime LIMIT 10",
        "SELECT SearchPhrase AS k FROM (SELECT SearchPhrase, EventTime FROM hits WHERE SearchPhrase <> '' ORDER BY EventTime ASC NULLS FIRST, SearchPhrase LIMIT 10)", "k"),
    "q25_order_str": _hits("SELECT SearchPhrase FROM hits WHERE SearchPhrase <> '' ORDER BY SearchPhrase LIMIT 10", "SELECT SearchPhrase AS k FROM hits WHERE SearchPhrase <> ''", "k", "k", "LIMIT 10"),
    "q26_order_two_keys": _hits(
        "SELECT SearchPhrase FROM hits WHERE SearchPhrase <> '' ORDER BY EventTime DESC, SearchPhrase LIMIT 10",
        "SELECT SearchPhrase AS k FROM (SELECT SearchPhrase, EventTime FROM hits WHERE SearchPhrase <> '' ORDER BY EventTime DESC NULLS LAST, SearchPhrase LIMIT 10)", "k"),
    "q27_having_avg_strlen": _hits(
        "SELECT CounterID, AVG(STRLEN(URL)) AS l, COUNT(*) AS c FROM hits WHERE URL <> '' GROUP BY CounterID HAVING COUNT(*) > 8 ORDER BY l DESC LIMIT 25",
        f"SELECT CounterID AS k, {_avg('strlen(URL)')} AS l, count(*) AS c FROM hits WHERE URL <> '' GROUP BY k HAVING count(*) > 8", "k l c", "-l", "LIMIT 25"),
    "q28_regexp_domain": _hits(
        f"SELECT REGEXP_REPLACE(Referer, '{_DOMAIN}', '\\1') AS k, AVG(STRLEN(Referer)) AS l, COUNT(*) AS c, MIN(Referer) FROM hits WHERE Referer <> '' GROUP BY k HAVING COUNT(*) > 8 ORDER BY l DESC LIMIT 25",
        f"SELECT regexp_replace(Referer, '{_DOMAIN}', '\\1', 'g') AS k, {_avg('strlen(Referer)')} AS l, count(*) AS c, min(Referer) AS r FROM hits WHERE Referer <> '' GROUP BY k HAVING count(*) > 8", "k l c r", "-l", "LIMIT 25"),
    "q29_sum_linear_wide": _hits(
        "SELECT " + ", ".join(["SUM(ResolutionWidth)", *[f"SUM(ResolutionWidth + {k})" for k in range(1, 90)]]) + " FROM hits",
        "SELECT " + ", ".join(f"CAST(sum(ResolutionWidth + {k}) AS BIGINT) AS s{k}" for k in range(90)) + " FROM hits", " ".join(f"s{k}" for k in range(90))),
    "q30_two_int_keys": _hits(
        "SELECT SearchEngineID, ClientIP, COUNT(*) AS c, SUM(IsRefresh), AVG(ResolutionWidth) FROM hits WHERE SearchPhrase <> '' GROUP BY SearchEngineID, ClientIP ORDER BY c DESC LIMIT 10",
        f"SELECT SearchEngineID AS e, ClientIP AS i, count(*) AS c, {_sum('IsRefresh')} AS s, {_avg('ResolutionWidth')} AS a FROM hits WHERE SearchPhrase <> '' GROUP BY e, i", "e i c s a", "-c", "LIMIT 10"),
    "q31_watch_filtered": _hits(
        "SELECT WatchID, ClientIP, COUNT(*) AS c, SUM(IsRefresh), AVG(ResolutionWidth) FROM hits WHERE SearchPhrase <> '' GROUP BY WatchID, ClientIP ORDER BY c DESC LIMIT 10",
        f"SELECT WatchID AS w, ClientIP AS i, count(*) AS c, {_sum('IsRefresh')} AS s, {_avg('ResolutionWidth')} AS a FROM hits WHERE SearchPhrase <> '' GROUP BY w, i", "w i c s a", "-c", "LIMIT 10"),
    "q32_watch_all": _hits(
        "SELECT WatchID, ClientIP, COUNT(*) AS c, SUM(IsRefresh), AVG(ResolutionWidth) FROM hits GROUP BY WatchID, ClientIP ORDER BY c DESC LIMIT 10",
        f"SELECT WatchID AS w, ClientIP AS i, count(*) AS c, {_sum('IsRefresh')} AS s, {_avg('ResolutionWidth')} AS a FROM hits GROUP BY w, i", "w i c s a", "-c", "LIMIT 10"),
    "q33_long_str": _hits("SELECT URL, COUNT(*) AS c FROM hits GROUP BY URL ORDER BY c DESC LIMIT 10", "SELECT URL AS u, count(*) AS c FROM hits GROUP BY u", "u c", "-c", "LIMIT 10"),
    "q34_literal_ordinal": _hits(
        "SELECT 1, URL, COUNT(*) AS c FROM hits GROUP BY 1, URL ORDER BY c DESC LIMIT 10",
        "SELECT CAST(1 AS BIGINT) AS one, URL AS u, count(*) AS c FROM hits GROUP BY u", "one u c", "-c", "LIMIT 10"),
    "q35_derived_keys": _hits(
        "SELECT ClientIP, ClientIP - 1, ClientIP - 2, ClientIP - 3, COUNT(*) AS c FROM hits GROUP BY ClientIP, ClientIP - 1, ClientIP - 2, ClientIP - 3 ORDER BY c DESC LIMIT 10",
        "SELECT ClientIP AS i, CAST(ClientIP AS BIGINT) - 1 AS i1, CAST(ClientIP AS BIGINT) - 2 AS i2, CAST(ClientIP AS BIGINT) - 3 AS i3, count(*) AS c FROM hits GROUP BY i, i1, i2, i3", "i i1 i2 i3 c", "-c", "LIMIT 10"),
    "q36_range_url": _hits(
        f"SELECT URL, COUNT(*) AS PageViews FROM hits WHERE CounterID > 62 AND {_MONTH} AND DontCountHits = 0 AND IsRefresh = 0 AND URL <> '' GROUP BY URL ORDER BY PageViews DESC LIMIT 10",
        f"SELECT URL AS u, count(*) AS v FROM hits WHERE CounterID > 62 AND {_MONTH} AND DontCountHits = 0 AND IsRefresh = 0 AND URL <> '' GROUP BY u", "u v", "-v", "LIMIT 10"),
    "q37_range_title": _hits(
        f"SELECT Title, COUNT(*) AS PageViews FROM hits WHERE CounterID > 62 AND {_MONTH} AND DontCountHits = 0 AND IsRefresh = 0 AND Title <> '' GROUP BY Title ORDER BY PageViews DESC LIMIT 10",
        f"SELECT Title AS t, count(*) AS v FROM hits WHERE CounterID > 62 AND {_MONTH} AND DontCountHits = 0 AND IsRefresh = 0 AND Title <> '' GROUP BY t", "t v", "-v", "LIMIT 10"),
    "q38_limit_offset": _hits(
        f"SELECT URL, COUNT(*) AS PageViews FROM hits WHERE CounterID > 62 AND {_MONTH} AND IsRefresh = 0 AND IsLink <> 0 AND IsDownload = 0 GROUP BY URL ORDER BY PageViews DESC LIMIT 10 OFFSET 20",
        f"SELECT URL AS u, count(*) AS v FROM hits WHERE CounterID > 62 AND {_MONTH} AND IsRefresh = 0 AND IsLink <> 0 AND IsDownload = 0 GROUP BY u", "u v", "-v", "LIMIT 10 OFFSET 20"),
    "q39_case_key": _hits(
        f"SELECT TraficSourceID, SearchEngineID, AdvEngineID, CASE WHEN (SearchEngineID = 0 AND AdvEngineID = 0) THEN Referer ELSE '' END AS Src, URL AS Dst, COUNT(*) AS PageViews FROM hits WHERE CounterID > 62 AND {_MONTH} AND IsRefresh = 0 GROUP BY TraficSourceID, SearchEngineID, AdvEngineID, Src, Dst ORDER BY PageViews DESC LIMIT 10 OFFSET 100",
        f"SELECT TraficSourceID AS t, SearchEngineID AS e, AdvEngineID AS a, CASE WHEN SearchEngineID = 0 AND AdvEngineID = 0 THEN Referer ELSE '' END AS src, URL AS dst, count(*) AS v FROM hits WHERE CounterID > 62 AND {_MONTH} AND IsRefresh = 0 GROUP BY t, e, a, src, dst", "t e a src dst v", "-v", "LIMIT 10 OFFSET 100"),
    "q40_in_negative": _hits(
        f"SELECT RegionID, EventDate, COUNT(*) AS PageViews FROM hits WHERE {_MONTH} AND IsRefresh = 0 AND TraficSourceID IN (-1, 6) GROUP BY RegionID, EventDate ORDER BY PageViews DESC LIMIT 10 OFFSET 10",
        f"SELECT RegionID AS r, EventDate AS d, count(*) AS v FROM hits WHERE {_MONTH} AND IsRefresh = 0 AND TraficSourceID IN (-1, 6) GROUP BY r, d", "r d v", "-v", "LIMIT 10 OFFSET 10"),
    "q41_two_short_keys": _hits(
        f"SELECT WindowClientWidth, ResolutionWidth, COUNT(*) AS PageViews FROM hits WHERE {_MONTH} AND IsRefresh = 0 AND DontCountHits = 0 GROUP BY WindowClientWidth, ResolutionWidth ORDER BY PageViews DESC LIMIT 10 OFFSET 10",
        f"SELECT WindowClientWidth AS w, ResolutionWidth AS h, count(*) AS v FROM hits WHERE {_MONTH} AND IsRefresh = 0 AND DontCountHits = 0 GROUP BY w, h", "w h v", "-v", "LIMIT 10 OFFSET 10"),
    "q42_date_trunc": _hits(
        f"SELECT DATE_TRUNC('minute', EventTime) AS M, COUNT(*) AS PageViews FROM hits WHERE {_MONTH} AND IsRefresh = 0 AND DontCountHits = 0 GROUP BY DATE_TRUNC('minute', EventTime) ORDER BY DATE_TRUNC('minute', EventTime) LIMIT 10 OFFSET 10",
        f"SELECT date_trunc('minute', EventTime) AS m, count(*) AS v FROM hits WHERE {_MONTH} AND IsRefresh = 0 AND DontCountHits = 0 GROUP BY m", "m v", "m", "LIMIT 10 OFFSET 10"),
    "min_max_str": _hits("SELECT MIN(URL), MAX(URL) FROM hits", "SELECT min(URL) AS lo, max(URL) AS hi FROM hits", "lo hi"),
    "group_extract_hour": _hits(
        "SELECT EXTRACT(HOUR FROM EventTime) AS h, COUNT(*) FROM hits GROUP BY h", "SELECT extract(hour FROM EventTime) AS h, count(*) AS c FROM hits GROUP BY h", "h c"),
    "like_underscore": Case("part", "SELECT p_brand, COUNT(*) FROM part WHERE p_brand LIKE 'Brand#_%' GROUP BY p_brand", "SELECT p_brand AS k, count(*) AS c FROM part WHERE p_brand LIKE 'Brand#_%' GROUP BY k", ("k", "c")),
    "column_vs_column": Case("lineitem", "SELECT COUNT(*) FROM lineitem AS l WHERE l.l_partkey > l.l_suppkey", "SELECT count(*) AS c FROM lineitem WHERE l_partkey > l_suppkey", ("c",)),
    "group_as_distinct": Case("events", "SELECT event_type FROM events GROUP BY event_type", "SELECT DISTINCT event_type AS k FROM events", ("k",)),
    "alias_shadows_column": Case(
        "events", "SELECT user_id - 1 AS event_id, COUNT(*) AS c FROM events GROUP BY event_id ORDER BY c DESC LIMIT 10",
        "SELECT user_id - 1 AS k, count(*) AS c FROM events GROUP BY k", ("k", "c"), ("-c",), "LIMIT 10"),
    "empty_agg_zero": Case("events", "SELECT SUM(user_id), AVG(user_id), COUNT(*), MIN(event_type) FROM events WHERE user_id < 0", f"SELECT {_sum('user_id')} AS s, {_avg('user_id')} AS a, count(*) AS c, coalesce(min(event_type), '') AS m FROM events WHERE user_id < 0", ("s", "a", "c", "m")),
    "unary_minus": Case("nation", "SELECT -n_nationkey, n_name FROM nation WHERE 5 < n_nationkey", "SELECT CAST(-n_nationkey AS BIGINT) AS k, n_name AS n FROM nation WHERE n_nationkey > 5", ("k", "n")),
    "two_int_keys_metrics": Case(
        "lineitem", "SELECT l_suppkey, l_linenumber, COUNT(*) AS c, SUM(l_partkey), AVG(l_partkey) FROM lineitem GROUP BY l_suppkey, l_linenumber ORDER BY c DESC LIMIT 10",
        f"SELECT l_suppkey AS k, l_linenumber AS n, count(*) AS c, {_sum('l_partkey')} AS s, {_avg('l_partkey')} AS a FROM lineitem GROUP BY k, n", ("k", "n", "c", "s", "a"), ("-c",), "LIMIT 10"),
    "key_sorted_two": Case(
        "orders", "SELECT o_custkey, o_orderpriority, COUNT(*) FROM orders GROUP BY o_custkey, o_orderpriority LIMIT 10",
        "SELECT o_custkey AS k, o_orderpriority AS p, count(*) AS c FROM orders GROUP BY k, p", ("k", "p", "c"), ("k", "p"), "LIMIT 10"),
    "projection_filter": Case("customer", "SELECT c_name AS name, c_mktsegment FROM customer WHERE c_nationkey IN (1, 2, 3) AND c_mktsegment <> 'BUILDING'", "SELECT c_name AS name, c_mktsegment AS seg FROM customer WHERE c_nationkey IN (1, 2, 3) AND c_mktsegment <> 'BUILDING'", ("name", "seg")),
    "having_hidden_aggregate": Case(
        "orders", "SELECT o_custkey FROM orders GROUP BY o_custkey HAVING MAX(o_orderpriority) > '4' AND COUNT(*) > 10",
        "SELECT o_custkey AS k FROM orders GROUP BY k HAVING max(o_orderpriority) > '4' AND count(*) > 10", ("k",)),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: case.run for name, case in CASES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: case.sql() for name, case in CASES.items()}
