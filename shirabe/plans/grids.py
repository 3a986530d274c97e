"""Derived tables for queries: the same rows by Spark and by DuckDB, from the keys of a table.

A grid crosses choices (labels, separators, forms) and numbers that depend on the key in ways of their own, so that
rows vary in all of them at once. Its columns can be used in what a query expects of its text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_PRIMES = (7919, 104729, 15485863, 3331, 6151, 99991, 27644437, 49157, 12289, 786433)


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def listed(values) -> str:
    """A SQL list of values, for IN."""
    return "(" + ", ".join(map(quoted, sorted(values))) + ")"


class Grid:
    def __init__(self, table: str = "customer", key: str = "c_custkey"):
        self.table, self.key, self.steps = table, key, []
        self.sql = f"SELECT CAST({key} AS BIGINT) AS k FROM {table}"

    def _step(self, name: str, value, sql: str) -> Grid:
        self.steps.append((name, value))
        self.sql = f"SELECT *, {sql} AS {name} FROM ({self.sql})"
        return self

    def add(self, name: str, sql: str) -> Grid:
        """A column of columns before it, by an expression that both engines read."""
        return self._step(name, sql, sql)

    def _prime(self) -> int:
        return _PRIMES[len(self.steps) % len(_PRIMES)] + len(self.steps)

    def pick(self, name: str, values) -> Grid:
        values, p = list(values), self._prime()
        return self._step(name, (values, p), f"[{', '.join(map(quoted, values))}][CAST((k * {p} % 10007) * (k + {p}) % 10009 % {len(values)} AS INTEGER) + 1]")

    def digits(self, name: str, width: int, same_every: int = 11) -> Grid:
        """Digits, all the same in one of ``same_every`` rows."""
        return self.add(name, f"CASE WHEN k % {same_every} = 0 THEN repeat(CAST(k % 10 AS STRING), {width}) ELSE lpad(CAST(k * {self._prime() * 998244353 % 10**12} % {10**width} AS STRING), {width}, '0') END")

    def form(self, name: str, digits: str, templates) -> Grid:
        """``name`` and its template ``name_form``: in a template, d stands for the next digit."""
        templates = list(templates)
        self.pick(f"{name}_form", templates)
        cases = []
        for t in templates:
            parts, at, i = [], 1, 0
            while i < len(t):
                j = i
                while j < len(t) and (t[j] == "d") == (t[i] == "d"):
                    j += 1
                parts.append(f"substr({digits}, {at}, {j - i})" if t[i] == "d" else quoted(t[i:j]))
                at += (j - i) * (t[i] == "d")
                i = j
            cases.append(f"WHEN {name}_form = {quoted(t)} THEN {' || '.join(parts)}")
        return self.add(name, f"CASE {' '.join(cases)} END")

    def text(self, *parts: str) -> Grid:
        """The columns one after another, as ``text``."""
        return self.add("text", " || ".join(parts))

    def rows(self, spark, sf_dir: str) -> DataFrame:
        df = spark.read.parquet(f"{sf_dir}/{self.table}.parquet").select(F.col(self.key).cast("long").alias("k"))
        for name, value in self.steps:
            if isinstance(value, str):
                column = F.expr(value)
            else:
                values, p = value
                column = F.element_at(F.array(*map(F.lit, values)), ((F.col("k") * p % 10007) * (F.col("k") + p) % 10009 % len(values)).cast("int") + 1)
            df = df.withColumn(name, column)
        return df
