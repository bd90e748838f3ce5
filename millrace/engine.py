"""Entry point for SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from millrace.ast import Agg, Query, Ref, Star
from millrace.compiler import compile_query
from millrace.errors import NotFound
from millrace.parser import parse
from millrace.profile import Profile

#: Types whose least and greatest values Spark takes from file footers.
_IN_FOOTERS = (T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DateType)


class Engine:
    """Named tables and queries over them.

    With ``metadata_aggregates``, a query that asks a table registered by its path
    for nothing but COUNT(*), COUNT, MIN and MAX of whole columns is answered
    from Parquet footers: it is planned in a session of its own, which reads
    through the second data source version with aggregate push-down, so no setting
    of the caller's session changes.  A row group that holds only nulls in a column
    asked for its MIN or MAX has none in its footer, and the query fails.
    """

    def __init__(self, spark: SparkSession, profile: Profile = Profile(), metadata_aggregates: bool = False) -> None:
        self.spark, self.profile, self.metadata_aggregates = spark, profile, metadata_aggregates
        self._tables: dict[str, DataFrame] = {}
        self._paths: dict[str, str] = {}
        self._footers: SparkSession | None = None

    def register_table(self, name: str, source: str | DataFrame) -> None:
        """A Parquet path or a DataFrame under a name, whatever its case."""
        self._paths.pop(name.lower(), None)
        if isinstance(source, DataFrame):
            self._tables[name.lower()] = source
        else:
            self._tables[name.lower()] = self.spark.read.parquet(source)
            self._paths[name.lower()] = source

    def table(self, name: str) -> DataFrame:
        try:
            return self._tables[name.lower()]
        except KeyError:
            raise NotFound(f"unknown table: {name}") from None

    def _footer_session(self) -> SparkSession:
        if self._footers is None:
            own = self._footers = self.spark.newSession()
            for key, value in self.spark.conf.getAll.items():
                if key.startswith("spark.sql.") and own.conf.isModifiable(key):
                    own.conf.set(key, value)
            own.conf.set("spark.sql.sources.useV1SourceList", "")
            own.conf.set("spark.sql.parquet.aggregatePushdown", "true")
        return self._footers

    def _from_footers(self, query: Query, df: DataFrame) -> bool:
        if not self.metadata_aggregates or query.table.lower() not in self._paths or query.where or query.group or query.having or query.order:
            return False
        kinds = {f.name.lower(): f.dataType for f in df.schema.fields}

        def kept(agg: object) -> bool:
            if not isinstance(agg, Agg) or agg.distinct:
                return False
            if isinstance(agg.arg, Star):
                return agg.name == "COUNT"
            kind = kinds.get(agg.arg.name.lower()) if isinstance(agg.arg, Ref) else None
            return kind is not None and (agg.name == "COUNT" or agg.name in ("MIN", "MAX") and isinstance(kind, _IN_FOOTERS))

        return all(kept(i.expr) for i in query.items)

    def plan(self, query: Query) -> DataFrame:
        """Lazy result of a parsed query."""
        df = self.table(query.table)
        if self._from_footers(query, df):
            df = self._footer_session().read.parquet(self._paths[query.table.lower()])
        return compile_query(query, df, self.profile)

    def sql(self, text: str) -> DataFrame:
        """Lazy result of SQL text; faults are raised here, not at the action."""
        return self.plan(parse(text))
