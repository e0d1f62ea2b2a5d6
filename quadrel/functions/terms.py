"""Scalar functions on IRIs, CURIEs, identifiers and rendered terms, as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def _tail(iri: Column, sep: str) -> Column:
    return F.when(F.instr(iri, sep) > 0, F.substring_index(iri, sep, -1))


def local_name(iri: Column) -> Column:
    """After the last ``#``, else after the last ``/``; an empty tail falls through, finally to the IRI."""
    keep = [F.when(t != "", t) for t in (_tail(iri, "#"), _tail(iri, "/"))]
    return F.coalesce(*keep, iri)


def short_name(iri: Column) -> Column:
    """``module:local``; without a module just the local name."""
    local = local_name(iri)
    stem = F.regexp_replace(F.substring(iri, F.lit(1), F.length(iri) - F.length(local)), "[/#]+$", "")
    module = F.substring_index(stem, "/", -1)
    return F.when(module != "", F.concat(module, F.lit(":"), local)).otherwise(local)


def rel_type(iri: Column) -> Column:
    """Relationship type of a property: any letter or digit kept, the rest ``_``, upper case."""
    t = F.upper(F.regexp_replace(local_name(iri), r"[^\p{L}\p{N}]", "_"))
    t = F.regexp_replace(t, "^_+|_+$", "")
    t = F.when(t == "", "REL").otherwise(t)
    return F.when(t.rlike(r"^\p{Nd}"), F.concat(F.lit("P_"), t)).otherwise(t)


def checked_rel_type(t: Column) -> Column:
    """t itself; a type that is not ASCII upper-case identifier fails the query."""
    return F.when(t.rlike("^[A-Z][A-Z0-9_]*$"), t).otherwise(F.raise_error(F.concat(F.lit("unsafe relationship type: "), t)).cast("string"))


def safe_key(name: Column) -> Column:
    """Property key: ASCII letters, digits and ``_``; a leading digit or nothing gets ``_`` before it."""
    k = F.regexp_replace(name, "[^0-9A-Za-z_]", "_")
    return F.when((k == "") | k.rlike("^[0-9]"), F.concat(F.lit("_"), k)).otherwise(k)


def checked_ident(t: Column) -> Column:
    return F.when(t.rlike("^[A-Za-z_][A-Za-z0-9_]*$"), t).otherwise(F.raise_error(F.concat(F.lit("unsafe identifier: "), t)).cast("string"))


def last_name(iri: Column) -> Column:
    """After the last ``/``, then after the last ``#`` of that; may be empty."""
    return F.substring_index(F.substring_index(iri, "/", -1), "#", -1)


def in_namespaces(iri: Column, namespaces: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (iri.startswith(n) for n in namespaces))


def slug(text: Column) -> Column:
    """``Current account-x`` to ``CurrentAccountX``."""
    return F.replace(F.initcap(F.replace(text, F.lit("-"), F.lit(" "))), F.lit(" "), F.lit(""))


def _words(text: Column) -> Column:
    return F.filter(F.split(F.replace(text, F.lit("-"), F.lit(" ")), r"\s+"), lambda w: w != "")


def _capital(w: Column) -> Column:
    return F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))


def class_ident(text: Column) -> Column:
    """CamelCase keeping inner case; ``Thing`` if nothing is left."""
    out = F.array_join(F.transform(_words(text), _capital), "")
    return F.when(out == "", "Thing").otherwise(out)


def property_ident(text: Column) -> Column:
    """camelCase, the first word all lower; ``relatedTo`` if nothing is left."""
    w = _words(text)
    tail = F.array_join(F.transform(F.slice(w, F.lit(2), F.greatest(F.size(w) - 1, F.lit(0))), _capital), "")
    return F.when(F.size(w) == 0, "relatedTo").otherwise(F.concat(F.lower(w[0]), tail))


def ontology_label(iri: Column) -> Column:
    """After ``/ontology/``, cut to 37 characters and dots if longer than 40."""
    s = F.substring_index(F.regexp_replace(iri, "/+$", ""), "/ontology/", -1)
    return F.when(F.length(s) <= 40, s).otherwise(F.concat(F.substring(s, 1, 37), F.lit("...")))


def graph_uri(path: Column) -> Column:
    """``urn:graph:`` and the percent-encoded path, slashes kept."""
    return F.concat(F.lit("urn:graph:"), F.replace(F.replace(F.url_encode(path), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/")))


def first_line(text: Column) -> Column:
    return F.substring(F.split(text, "\n")[0], 1, 200)


def term(value: Column, kind: Column, dtype: Column, lang: Column) -> Column:
    """N-Triples rendering of a term."""
    body = F.regexp_replace(F.regexp_replace(value, r'([\\"])', r"\\$1"), "\n", r"\\n")
    body = F.regexp_replace(F.regexp_replace(body, "\r", r"\\r"), "\t", r"\\t")
    literal = F.concat(F.lit('"'), body, F.lit('"'), F.when(lang.isNotNull(), F.concat(F.lit("@"), lang)).when(dtype.isNotNull(), F.concat(F.lit("^^<"), dtype, F.lit(">"))).otherwise(""))
    return F.when(kind == "iri", F.concat(F.lit("<"), value, F.lit(">"))).when(kind == "bnode", F.concat(F.lit("_:"), value)).otherwise(literal)


def mermaid_id(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9A-Za-z_]", "_")


def xml_escape(text: Column) -> Column:
    return reduce(lambda a, b: F.replace(a, F.lit(b[0]), F.lit(b[1])), (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")), text)


def abbreviate(df: DataFrame, column: str, prefixes: DataFrame, out: str) -> DataFrame:
    """df with ``out``: the CURIE under the longest namespace that fits, else the IRI.

    Prefix tables are vocabulary; beyond a thousand rows none is broadcast by hint.
    """
    known = [(r["prefix"], r["namespace"]) for r in prefixes.orderBy(F.desc(F.length("namespace")), "prefix").limit(1001).collect()]
    if len(known) > 1000:
        p = prefixes.select(F.col("namespace").alias("__ns"), "prefix").groupBy("__ns").agg(F.min("prefix").alias("__prefix"))
        sizes = p.select(F.length("__ns").alias("__n")).filter("__n is not null").distinct()
        # every beginning of an IRI that is as long as some namespace; the longest that is one wins
        begun = df.select(F.col(column).alias("__iri")).distinct().join(F.broadcast(sizes), F.col("__n") <= F.length("__iri")).withColumn("__ns", F.expr("substring(__iri, 1, __n)"))
        best = begun.join(p, "__ns").groupBy("__iri").agg(F.max_by("__prefix", "__n").alias("__prefix"), F.max("__n").alias("__n"))
        j = df.join(best, df[column] == best["__iri"], "left")
        curie = F.concat("__prefix", F.lit(":"), F.substring(column, F.col("__n") + 1, F.length(column)))
        return j.withColumn(out, F.coalesce(curie, F.col(column))).drop("__iri", "__n", "__prefix")
    c, result = F.col(column), F.col(column)
    for prefix, namespace in reversed(known):
        result = F.when(c.startswith(namespace), F.concat(F.lit(f"{prefix}:"), F.substring(c, F.lit(len(namespace) + 1), F.length(c)))).otherwise(result)
    return df.withColumn(out, result)


def expand(curie: Column, prefixes: dict[str, str]) -> Column:
    """IRI of a CURIE; an unknown prefix leaves it as it is."""
    out = curie
    for prefix, namespace in prefixes.items():
        out = F.when(curie.startswith(f"{prefix}:"), F.concat(F.lit(str(namespace)), F.substring(curie, F.lit(len(prefix) + 2), F.length(curie)))).otherwise(out)
    return out
