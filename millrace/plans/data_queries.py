"""Queries of the core's data operators: skewed keys and faulty records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.operators import dense_totals, record_fsm
from millrace.session import table


def p1_totals(spark: SparkSession, d: str) -> DataFrame:
    """Total count and least URL of every key."""
    out = dense_totals.dense_totals(table(spark, d, "search_phrase_group"), "key", "count", "min_url")
    return out.select("key", out["rows"].alias("n_rows"), out["total"].alias("total_count"), out["least"].alias("least_url"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return dense_totals.heavy_keys(table(spark, d, "search_phrase_group"), "key", "count", "min_url", 2).select("key")


def _scheme(spark: SparkSession, d: str) -> list[tuple[str, str]]:
    return [(r["name"], r["type"]) for r in table(spark, d, "scheme").orderBy("col_no").collect()]


def _loaded(spark: SparkSession, d: str) -> tuple[DataFrame, list[tuple[str, str]]]:
    scheme = _scheme(spark, d)
    return record_fsm.load_records(table(spark, d, "hits_raw"), "raw_id", "line", scheme), scheme


def p5_faults(spark: SparkSession, d: str) -> DataFrame:
    return record_fsm.faults(_loaded(spark, d)[0])


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_faults(spark, d).select("raw_id", "reason")


def p5_loaded(spark: SparkSession, d: str) -> DataFrame:
    loaded, scheme = _loaded(spark, d)
    return record_fsm.rows(loaded, "raw_id", scheme)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_totals, p5_found, p5_faults, p5_loaded)}


#: Names and types of the driver's fixed schema table, spelt out for the oracle.
_COLUMNS = (
    ("WatchID", "BIGINT"), ("Title", ""), ("EventTime", "TIMESTAMP"), ("EventDate", "DATE"), ("CounterID", "INTEGER"), ("ClientIP", "INTEGER"), ("RegionID", "INTEGER"), ("UserID", "BIGINT"),
    ("URL", ""), ("IsRefresh", "SMALLINT"), ("ResolutionWidth", "SMALLINT"), ("ResolutionHeight", "SMALLINT"), ("MobilePhoneModel", ""), ("SearchPhrase", ""), ("LocalEventTime", "TIMESTAMP"), ("HitColor", ""),
)


def _record_sql(select: str, where: str) -> str:
    cell = """("(?:[^"]|"")*"|[^",][^,]*|)"""
    shape = {
        "DATE": "[0-9]{4}-[0-9]{2}-[0-9]{2}",
        "TIMESTAMP": "[0-9]{4}-[0-9]{2}-[0-9]{2}[ T]([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9](\\.[0-9]{1,6})?",
    }
    fine = []
    for i, (_, kind) in enumerate(_COLUMNS, 1):
        value = f"v[{i}][1:10]" if kind == "TIMESTAMP" else f"v[{i}]"
        fine.append(f"(regexp_full_match(v[{i}], '{shape.get(kind, '-?[0-9]+')}') AND try_cast({value} AS {'DATE' if kind == 'TIMESTAMP' else kind}) IS NOT NULL)" if kind else "true")
    width = len(_COLUMNS)
    return f"""
        WITH cut AS (
          SELECT raw_id, coalesce(line, '') AS line, regexp_full_match(coalesce(line, ''), '{cell}(?:,{cell})*') AS quoted_well,
            regexp_extract_all(coalesce(line, '') || ',', '{cell},', 1) AS cells, regexp_extract(coalesce(line, ''), '^(?:{cell},)*') AS head FROM hits_raw),
        vals AS (SELECT *, list_transform(cells, lambda c: CASE WHEN c[1] = '"' THEN replace(c[2:-2], '""', '"') ELSE c END) AS v,
            list_transform(cells, lambda c: strlen(c) + 1) AS sizes, regexp_extract(line[length(head) + 1:], '^("(?:[^"]|"")*")[^"]', 1) AS closed FROM cut),
        judged AS (SELECT *, CASE WHEN NOT quoted_well THEN 'quoting' WHEN len(cells) <> {width} THEN 'column_count'
          WHEN NOT ({" AND ".join(fine)}) THEN 'invalid_value' END AS reason,
          list_position([{", ".join(fine)}], false) AS bad FROM vals),
        placed AS (SELECT raw_id, v, reason,
          CAST(CASE reason WHEN 'quoting' THEN strlen(head) + strlen(closed) WHEN 'column_count' THEN least(strlen(line), coalesce(list_sum(sizes[1:{width}]), 0))
            ELSE coalesce(list_sum(sizes[1:bad - 1]), 0) END AS BIGINT) AS error_offset,
          CAST(CASE reason WHEN 'column_count' THEN least(len(cells), {width}) + 1 WHEN 'invalid_value' THEN bad END AS BIGINT) AS error_column FROM judged)
        SELECT {select} FROM placed WHERE reason IS {where}"""


def oracle_sql() -> dict[str, str]:
    typed = ", ".join(f"CAST(v[{i}] AS {kind}) AS {name}" if kind else f"v[{i}] AS {name}" for i, (name, kind) in enumerate(_COLUMNS, 1))
    return {
        "p1_totals": "SELECT key, count(*) AS n_rows, CAST(sum(count) AS BIGINT) AS total_count, min(min_url) AS least_url FROM search_phrase_group GROUP BY key",
        "p1_found": "SELECT key FROM search_phrase_group WHERE key <> '' GROUP BY key HAVING count(*) * 50 >= (SELECT count(*) FROM search_phrase_group)",
        "p5_found": _record_sql("raw_id, reason", "NOT NULL"),
        "p5_faults": _record_sql("raw_id, reason, error_offset, error_column", "NOT NULL"),
        "p5_loaded": _record_sql(f"raw_id, {typed}", "NULL"),
    }
