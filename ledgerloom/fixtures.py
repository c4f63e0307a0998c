"""Small built-in tables for rules that the data tables never trigger, or seldom in all their cases.

A fixture gives the same rows to Spark (``df``) and, as a ``VALUES`` list, to any SQL engine
(``sql``).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

_SQL = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "date": "DATE"}


def _literal(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper()
    if isinstance(value, (int, float)):
        return repr(value)
    if isinstance(value, (list, tuple)):
        return "[" + ", ".join(_literal(v) for v in value) + "]"
    return "'" + str(value).replace("'", "''") + "'"


def _sql_type(name: str) -> str:
    return _sql_type(name[6:-1]) + "[]" if name.startswith("array<") else _SQL[name]


@dataclass(frozen=True)
class Fixture:
    """``columns`` such as ``"k bigint, text string"`` and rows."""

    columns: str
    rows: Sequence[tuple]

    @property
    def fields(self) -> list[tuple[str, str]]:
        return [tuple(c.split(" ", 1)) for c in self.columns.split(", ")]  # type: ignore[misc]

    def df(self, spark: SparkSession) -> DataFrame:
        plain = ", ".join(f"{n} {'string' if t in ('timestamp_ntz', 'date') else t}" for n, t in self.fields)
        df = spark.createDataFrame([tuple(r) for r in self.rows], plain)
        return df.withColumns({n: df[n].cast(t) for n, t in self.fields})

    @property
    def sql(self) -> str:
        cast = ", ".join(f"CAST({n} AS {_sql_type(t)}) AS {n}" for n, t in self.fields)
        body = ", ".join("(" + ", ".join(_literal(v) for v in r) + ")" for r in self.rows)
        return f"(SELECT {cast} FROM (VALUES {body}) AS v({', '.join(n for n, _ in self.fields)}))"
