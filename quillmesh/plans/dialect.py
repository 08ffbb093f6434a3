"""Operators as SQL templates over named inputs, for Spark and for an oracle in ANSI SQL.

A template names its inputs as {input}: another template, or a base table. Spark runs it with DataFrames bound to the names, so
an operator applies to any DataFrames (`apply`), and Catalyst sees one plan. The oracle text binds the names to common table
expressions. Where dialects differ there are macros:

$H(seed, a, ...)    deterministic 32-bit hash of the parts' text, as bigint: the only source of randomness
$Q(x, p)            exact linear quantile
$JOIN(x, key)       texts of a group joined by commas in the order of key
$DBL(x)             cast to double
$RX(x, re, by)      replace all matches
$TWICE(t)           after a table: each of its rows twice, with t.k = 0 and 1
$SERIES(n)          a table of the numbers b from 0 to n - 1
$R(x, n)            x to n decimals, cut a little off the half, where sums of few decimals don't tie
$P(t, df)           two-sided p of Student's t with a whole number of degrees of freedom
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession

from quillmesh.storage import table, written

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: An input that is used twice or more is written if its plan has at least so many scans.
SHARED_SCANS = 3


class Library:
    """Templates by name, in order of definition."""

    def __init__(self) -> None:
        self.sql: dict[str, str] = {}
        self.apart: dict[str, str] = {}
        self.covers: dict[str, str] = {}
        self.public: list[str] = []

    def add(self, name: str, sql: str, covers: str = "", public: bool = True, oracle: str | None = None) -> None:
        """A template; with `oracle` its oracle is that text, written apart from the query's, over the same inputs."""
        if name in self.sql or name in BASE:
            raise ValueError(f"{name} is defined twice")
        self.sql[name] = " ".join(sql.split())
        if oracle is not None:
            self.apart[name] = " ".join(oracle.split())
        self.covers[name] = covers
        if public:
            self.public.append(name)

    def inputs(self, name: str) -> list[str]:
        return list(dict.fromkeys(re.findall(r"\{(\w+)\}", self.sql[name])))

    def needed(self, name: str, given: Mapping[str, DataFrame] | None = None) -> list[str]:
        """The templates that `name` is made of, inputs before what uses them; inputs in `given` are not looked into."""
        order: list[str] = []

        def visit(n: str) -> None:
            if n not in BASE and n not in order and not (given and n in given):
                for i in self.inputs(n):
                    visit(i)
                order.append(n)

        visit(name)
        return order

    def shared(self, name: str, given: Mapping[str, DataFrame] | None = None) -> set[str]:
        """The templates whose results are written once: used in more than one place, and not a matter of a scan or two."""
        order, uses, scans, out = self.needed(name, given), Counter(), {}, set()
        for n in order:
            uses.update(re.findall(r"\{(\w+)\}", self.sql[n]))
        for n in order:
            scans[n] = sum(1 if i in out else scans.get(i, 1) for i in re.findall(r"\{(\w+)\}", self.sql[n]))
            if uses[n] > 1 and scans[n] >= SHARED_SCANS:
                out.add(n)
        return out

    def apply(self, spark: SparkSession, name: str, source: Callable[[str], DataFrame], given: Mapping[str, DataFrame] | None = None, built: dict | None = None) -> DataFrame:
        """The operator `name`; inputs not in `given` are built from their own templates, base tables come from `source`. Inputs that
        are used in several places are evaluated once, into the shared folder, so a plan does not repeat them. `built` keeps what
        was built between calls."""
        built = {} if built is None else built
        keep, order = self.shared(name, given), self.needed(name, given)

        def frame(n: str) -> DataFrame:
            return given[n] if given and n in given else built[n] if n in built else source(n)

        wanted: set[str] = set()
        for n in reversed(order):  # what a written input is made of is not needed again
            if n == name or n in wanted:
                wanted |= set() if n in built else set(self.inputs(n))
        for n in order:
            if n not in built and (n == name or n in wanted):
                made = spark.sql(expand(self.sql[n], "spark"), **{i: frame(i) for i in self.inputs(n)})
                built[n] = written(made, n) if n in keep else made
        return frame(name)

    def query(self, name: str) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: self.apply(spark, name, lambda t: table(spark, sf_dir, t))

    def oracle(self, name: str) -> str:
        order: list[str] = []

        def visit(n: str) -> None:
            if n not in BASE and n not in order:
                for i in re.findall(r"\{(\w+)\}", self.apart.get(n, self.sql[n])):
                    visit(i)
                order.append(n)

        visit(name)
        text = ", ".join(f"{n} AS ({expand(self.apart.get(n, self.sql[n]), 'duckdb')})" for n in order)
        return re.sub(r"\{(\w+)\}", r"\1", f"WITH {text} SELECT * FROM {name}")


def _arguments(text: str, at: int) -> tuple[list[str], int]:
    """The comma-separated arguments of the parenthesis that opens at `at`, and the place after it."""
    depth, start, out = 0, at + 1, []
    for i in range(at, len(text)):
        c = text[i]
        depth += (c == "(") - (c == ")")
        if c == "," and depth == 1 or depth == 0:
            out.append(text[start:i].strip())
            start = i + 1
        if depth == 0:
            return out, i + 1
    raise ValueError(text[at:])


def _student(t: str, df: str, spark: bool) -> str:
    """1 - A(t | df), with A a finite series in the angle atan(t / sqrt(df)): for odd df 2/pi * (angle + sin * cos * series of
    (2j) / (2j + 1)), for even df sin * series of (2j - 1) / (2j), in powers of cos^2. Spark adds the products up; the oracle takes
    the products as gamma functions."""
    c2, size = f"({df} / ({df} + ({t}) * ({t})))", f"abs({t})"
    sine, last = f"({size} / sqrt({df} + ({t}) * ({t})))", f"(({df} - 2 - {df} % 2) div 2)" if spark else f"(({df} - 2 - {df} % 2) // 2)"
    if spark:
        factor = f"CASE WHEN {df} % 2 = 0 THEN (2e0 * j - 1e0) / (2e0 * j) ELSE (2e0 * j) / (2e0 * j + 1e0) END"
        series = f"aggregate(filter(sequence(0, greatest(CAST({last} AS INT), 0)), j -> j > 0), named_struct('f', 1e0, 's', 1e0), (a, j) -> named_struct('f', a.f * {c2} * {factor}, 's', a.s + a.f * {c2} * {factor}), a -> a.s)"
    else:
        term = f"CASE WHEN {df} % 2 = 0 THEN exp(lgamma(j + 0.5e0) - lgamma(j + 1e0)) / sqrt(pi()) ELSE exp(lgamma(j + 1e0) - lgamma(j + 1.5e0)) * sqrt(pi()) / 2 END * pow({c2}, j)"
        series = f"list_sum(list_transform(range(0, greatest({last}, 0) + 1), lambda j: {term}))"
    odd = f"2e0 / pi() * (atan({size} / sqrt({df} + 0e0)) + CASE WHEN {df} > 1 THEN {sine} * sqrt({c2}) * {series} ELSE 0e0 END)"
    return f"greatest(0e0, 1e0 - CASE WHEN {df} % 2 = 1 THEN {odd} ELSE {sine} * {series} END)"


def expand(sql: str, dialect: str) -> str:
    spark = dialect == "spark"

    def macro(name: str, args: list[str]) -> str:
        if name == "H":
            parts = " || '|' || ".join(f"CAST({a} AS {'STRING' if spark else 'VARCHAR'})" for a in args)
            return f"CAST(conv(substr(md5({parts}), 1, 8), 16, 10) AS BIGINT)" if spark else f"CAST('0x' || substr(md5({parts}), 1, 8) AS BIGINT)"
        if name == "Q":
            return f"percentile({args[0]}, {args[1]})" if spark else f"quantile_cont({args[0]}, {args[1]})"
        if name == "JOIN":
            return f"listagg({args[0]}, ',') WITHIN GROUP (ORDER BY {args[1]})" if spark else f"string_agg({args[0]}, ',' ORDER BY {args[1]})"
        if name == "DBL":
            return f"CAST({args[0]} AS DOUBLE)"
        if name == "TWICE":
            return f"LATERAL VIEW explode(array(0, 1)) {args[0]} AS k" if spark else f"CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1) {args[0]}"
        if name == "RX":
            return f"regexp_replace({args[0]}, {args[1]}, {args[2]})" if spark else f"regexp_replace({args[0]}, {args[1]}, {args[2]}, 'g')"
        if name == "SERIES":
            return f"(SELECT id AS b FROM range({args[0]}))" if spark else f"(SELECT range AS b FROM range({args[0]}))"
        if name == "R":
            return f"(floor(({args[0]}) * 1e{args[1]} + 0.5314159e0) / 1e{args[1]})"
        if name == "P":
            return _student(*args, spark)
        raise ValueError(f"no macro ${name}")

    while every := list(re.finditer(r"\$([A-Z]+)(?=\()", sql)):
        # innermost first: expand the last one
        found = every[-1]
        args, end = _arguments(sql, found.end())
        sql = sql[: found.start()] + macro(found[1], args) + sql[end:]
    return sql


LIBRARY = Library()
