"""Basic graph patterns compiled to DataFrame joins.

A pattern is (subject, predicate, object); ``?x`` is a variable, ``a`` is rdf:type, ``Lit`` a
literal constant, all else an IRI. Solutions are DataFrames with a column a variable, and for
variables that stood for terms a hidden column of their kind, which ``Solutions.select`` drops.
Constants reach the scan as filters; only the columns that a pattern binds are read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..schema import TERM, TYPE

KIND = "__kind"


@dataclass(frozen=True)
class Lit:
    """A literal constant of a pattern; without datatype and language it matches any literal of that value."""

    value: str
    dtype: str | None = None
    lang: str | None = None


def default_graph(quads: DataFrame) -> DataFrame:
    """The union of all named graphs as a set of triples."""
    return quads.select(*TERM).distinct()


def is_var(x) -> bool:
    return isinstance(x, str) and x.startswith("?")


def scan(quads: DataFrame, s, p, o, g: str | None = None) -> DataFrame:
    """Bindings of one pattern."""
    df, columns, seen = quads, {}, {}
    for name, x in (("g", g), ("s", s), ("p", TYPE if p == "a" else p), ("o", o)):
        if x is None:
            continue
        if is_var(x):
            v = x[1:]
            if v in seen:
                df = df.filter(F.col(seen[v]) == F.col(name))
                continue
            seen[v] = name
            columns[v] = F.col(name)
            if name in "so":
                columns[v + KIND] = F.col(f"{name}_kind")
        elif isinstance(x, Lit):
            df = df.filter((F.col(name) == x.value) & (F.col("o_kind") == "literal"))
            if x.dtype:
                df = df.filter(F.col("o_dtype") == x.dtype)
            if x.lang:
                df = df.filter(F.lower("o_lang") == x.lang.lower())
        else:
            df = df.filter(F.col(name) == str(x))
            if name == "o":
                df = df.filter(F.col("o_kind") == "iri")
    return df.select(*(c.alias(k) for k, c in columns.items())) if columns else df.select(F.lit(1).alias("__any")).limit(1)


def _bound(p: tuple) -> int:
    return sum(not is_var(x) for x in p)


class Solutions:
    """Solutions of patterns over a triple or quad table."""

    def __init__(self, source: DataFrame, df: DataFrame | None = None):
        self.source, self.df = source, df

    def _with(self, df: DataFrame) -> "Solutions":
        return Solutions(self.source, df)

    def _match(self, patterns: tuple, graph: str | None) -> DataFrame:
        """Patterns joined, most constants first, connected ones before others."""
        left, out = sorted(patterns, key=_bound, reverse=True), None
        while left:
            at = next((i for i, p in enumerate(left) if out is None or any(is_var(x) and x[1:] in out.columns for x in p)), 0)
            part = scan(self.source, *left.pop(at), graph)
            out = part if out is None else join(out, part)
        return out

    def where(self, *patterns: tuple, graph: str | None = None) -> "Solutions":
        part = self._match(patterns, graph)
        return self._with(part if self.df is None else join(self.df, part))

    def optional(self, *patterns: tuple, graph: str | None = None, iri: tuple[str, ...] = (), where: Column | None = None) -> "Solutions":
        """Left join; conditions hold inside, before the join, so rows without a match stay."""
        part = self._match(patterns, graph)
        for v in iri:
            part = part.filter(F.col(v + KIND) == "iri")
        if where is not None:
            part = part.filter(where)
        return self._with(join(self.df, part, "left"))

    def iri(self, *variables: str) -> "Solutions":
        df = self.df
        for v in variables:
            df = df.filter(F.col(v + KIND) == "iri")
        return self._with(df)

    def scope(self, variable: str, prefix: str | None) -> "Solutions":
        return self if not prefix else self._with(self.df.filter(F.col(variable).startswith(prefix)))

    def filter(self, condition) -> "Solutions":
        return self._with(self.df.filter(condition))

    def values(self, variable: str, options: list[str]) -> "Solutions":
        return self._with(self.df.filter(F.col(variable).isin(options)))

    def bind(self, name: str, value: Column) -> "Solutions":
        return self._with(self.df.withColumn(name, value))

    def select(self, *names: str, distinct: bool = False) -> DataFrame:
        out = self.df.select(*names)
        return out.distinct() if distinct else out

    def ask(self) -> bool:
        return not self.df.isEmpty()


def join(a: DataFrame, b: DataFrame, how: str = "inner") -> DataFrame:
    """Join on the variables that both sides bind."""
    on = [c for c in a.columns if c in b.columns and not c.endswith(KIND)]
    b = b.drop(*(c for c in b.columns if c.endswith(KIND) and c in a.columns))
    if not on:
        raise ValueError("patterns without a common variable: bind them by a shared one")
    return a.join(b, on, how)
