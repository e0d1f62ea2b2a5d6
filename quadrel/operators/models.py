"""Requirement, application and technology models as tables: integrity, traceability, export."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.terms import mermaid_id
from ..schema import OWL, RDFS, SKOS, TYPE


def _problem(df: DataFrame, check: str, text: Column) -> DataFrame:
    return df.select(F.lit(check).alias("check"), text.alias("problem"))


def dangling(table: DataFrame, column: str, target: DataFrame, check: str, key: str = "id", many: bool = True) -> DataFrame:
    """check, problem: references of a table's column that the target lacks."""
    refs = table.select(F.col(key).alias("owner"), (F.explode(column) if many else F.col(column)).alias("ref")).filter("ref is not null")
    return _problem(refs.join(target.select(F.col("id").alias("ref")).distinct(), "ref", "left_anti"), check, F.format_string("%s: unknown %s", F.col("owner").cast("string"), F.col("ref").cast("string")))


def duplicates(table: DataFrame, check: str) -> DataFrame:
    return _problem(table.groupBy("id").count().filter("count > 1"), check, F.format_string("%s: %d times", F.col("id").cast("string"), F.col("count")))


def outside(table: DataFrame, column: str, allowed: list, check: str) -> DataFrame:
    return _problem(table.filter(~F.col(column).isin(allowed) | F.col(column).isNull()), check, F.format_string("%s: %s is %s", F.col("id").cast("string"), F.lit(column), F.coalesce(F.col(column).cast("string"), F.lit("null"))))


def uncovered(target: DataFrame, table: DataFrame, column: str, check: str) -> DataFrame:
    used = table.select(F.explode(column).alias("id")).distinct()
    return _problem(target.join(used, "id", "left_anti"), check, F.format_string("%s: nothing refers to it", F.col("id").cast("string")))


def _all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def check_capabilities(categories: DataFrame, capabilities: DataFrame, levels: tuple[int, int] = (1, 5)) -> DataFrame:
    """check, problem: repeated ids, unknown categories and references, levels out of range, self-dependence."""
    own = capabilities.filter(F.array_contains("depends_on", F.col("id")))
    return _all([
        duplicates(capabilities, "capability id"), dangling(capabilities, "category", categories, "category", many=False),
        *(dangling(capabilities, c, capabilities, c) for c in ("depends_on", "supports", "governed_by")),
        outside(capabilities, "maturity_level", list(range(levels[0], levels[1] + 1)), "maturity level"), _problem(own, "self", F.format_string("%s depends on itself", "id")),
    ])


def check_applications(services: DataFrame, components: DataFrame, data_objects: DataFrame, capabilities: DataFrame) -> DataFrame:
    return _all([
        dangling(services, "serves_capabilities", capabilities, "served capability"), dangling(components, "realizes", services, "realised service"),
        dangling(components, "reads", data_objects, "read object"), dangling(components, "writes", data_objects, "written object"), dangling(components, "uses", services, "used service"),
        uncovered(services, components, "realizes", "realised"), uncovered(capabilities, services, "serves_capabilities", "covered capability"),
    ])


def check_technology(requirements: DataFrame, mappings: DataFrame, nodes: DataFrame, platforms: list[str], priorities: list[str]) -> DataFrame:
    mapped = mappings.select(F.col("req_id").alias("id")).distinct()
    return _all([
        duplicates(requirements, "requirement id"), outside(requirements, "platform", platforms, "platform"), outside(requirements, "priority", priorities, "priority"),
        _problem(requirements.join(mapped, "id", "left_anti"), "mapping", F.format_string("%s: no mapping", "id")), dangling(mappings, "req_id", requirements, "mapped requirement", key="req_id", many=False),
        dangling(nodes, "hosted_on", nodes, "host"),
    ])


def members(table: DataFrame, column: str, value: str) -> DataFrame:
    """Rows whose array or scalar column has the value."""
    is_array = dict(table.dtypes)[column].startswith("array")
    return table.filter(F.array_contains(column, value) if is_array else F.col(column) == value)


def traceability(left: DataFrame, column: str, right: DataFrame, name: str = "name") -> DataFrame:
    """id, links: names of what each row refers to, sorted, joined by commas."""
    refs = left.select("id", F.explode_outer(column).alias("ref"))
    j = refs.join(right.select(F.col("id").alias("ref"), F.col(name).alias("n")), "ref", "left")
    return j.groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("n")), ", ").alias("links"))


def data_owners(components: DataFrame) -> DataFrame:
    """object, component, role: the first writer, else the first reader, by id."""
    w = components.select(F.explode("writes").alias("object"), F.lit(0).alias("rank"), "id")
    r = components.select(F.explode("reads").alias("object"), F.lit(1).alias("rank"), "id")
    one = w.unionByName(r).groupBy("object").agg(F.min(F.struct("rank", "id")).alias("b"))
    return one.select("object", F.col("b.id").alias("component"), F.when(F.col("b.rank") == 0, "writer").otherwise("reader").alias("role"))


def roadmap(capabilities: DataFrame) -> DataFrame:
    """maturity_level, n, capabilities (names sorted, joined)."""
    return capabilities.groupBy("maturity_level").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("name")), ", ").alias("capabilities"))


def capability_query(quads: DataFrame, predicate: str, least: int) -> DataFrame:
    """capability, level: numeric filter on literals, descending."""
    t = quads.filter((F.col("p") == predicate) & (F.col("o_kind") == "literal")).select(F.col("s").alias("capability"), F.col("o").try_cast("bigint").alias("level")).distinct()
    return t.filter(F.col("level") >= least).orderBy(F.desc("level"), "capability")


def edges(capabilities: DataFrame) -> DataFrame:
    """src, dst, type: dependence, its inverse, support and governance."""
    kinds = (("depends_on", "dependsOn"), ("supports", "supports"), ("governed_by", "governedBy"))
    parts = [capabilities.select(F.col("id").alias("src"), F.explode(c).alias("dst"), F.lit(k).alias("type")) for c, k in kinds]
    out = _all(parts)
    return out.unionByName(out.filter("type = 'dependsOn'").select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit("enables").alias("type")))


def taxonomy(categories: DataFrame, capabilities: DataFrame) -> DataFrame:
    """src, dst: capability to category to domain."""
    return capabilities.select(F.col("id").alias("src"), F.col("category").alias("dst")).unionByName(categories.select(F.col("id").alias("src"), F.col("domain").alias("dst"))).distinct()


def markdown(requirements: DataFrame) -> DataFrame:
    """pos, line: requirement catalogue, a section a platform."""
    head = requirements.select("platform").distinct().select("platform", F.lit("").alias("id"), F.concat(F.lit("## "), "platform").alias("line"))
    row = requirements.select("platform", "id", F.format_string("- **%s** %s (%s): %s", "id", "title", "priority", "statement").alias("line"))
    return head.unionByName(row).select(F.struct("platform", "id").alias("pos"), "line")


def mermaid(edges_: DataFrame, title: str = "flowchart LR") -> DataFrame:
    """pos, line: a diagram's text, an edge a line."""
    first = edges_.sparkSession.range(1).select(F.lit("0").alias("pos"), F.lit(title).alias("line"))
    line = F.format_string("  %s -->|%s| %s", mermaid_id(F.col("src")), "type", mermaid_id(F.col("dst")))
    return first.unionByName(edges_.select(F.concat(F.lit("1 "), line).alias("pos"), line.alias("line")))


def to_quads(categories: DataFrame, capabilities: DataFrame, base: str, g: str = "urn:graph:capabilities") -> DataFrame:
    """The capability model as SKOS concepts with relations, levels and inverse dependence."""
    iri = lambda c: F.concat(F.lit(base), c)
    none = F.lit(None).cast("string")

    def rows(df, s, p, o, kind="iri", dtype=None, lang=None):
        return df.select(F.lit(g).alias("g"), s.alias("s"), F.lit("iri").alias("s_kind"), F.lit(str(p)).alias("p"), o.cast("string").alias("o"), F.lit(kind).alias("o_kind"), (F.lit(str(dtype)) if dtype else none).alias("o_dtype"), (F.lit(lang) if lang else none).alias("o_lang"))

    out = [rows(t, iri(F.col("id")), TYPE, F.lit(str(SKOS.Concept))) for t in (categories, capabilities)]
    out += [rows(t, iri(F.col("id")), SKOS.prefLabel, F.col("name"), "literal", lang="en") for t in (categories, capabilities)]
    out.append(rows(capabilities, iri(F.col("id")), SKOS.broader, iri(F.col("category"))))
    out.append(rows(capabilities, iri(F.col("id")), base + "maturityLevel", F.col("maturity_level"), "literal", dtype="http://www.w3.org/2001/XMLSchema#integer"))
    e = edges(capabilities)
    out += [rows(e.filter(F.col("type") == k), iri(F.col("src")), base + k, iri(F.col("dst"))) for k in ("dependsOn", "enables", "supports", "governedBy")]
    one = capabilities.sparkSession.range(1)
    out.append(rows(one, F.lit(base + "dependsOn"), TYPE, F.lit(str(OWL.TransitiveProperty))))
    out.append(rows(one, F.lit(base + "enables"), OWL.inverseOf, F.lit(base + "dependsOn")))
    out.append(rows(one, F.lit(base + "dependsOn"), RDFS.label, F.lit("depends on"), "literal", lang="en"))
    return _all(out)


def build(checks: DataFrame, outputs: dict[str, DataFrame], folder: str) -> list[str]:
    """Write all outputs if the checks found nothing; else raise with the first problems."""
    found = [f"{r['check']}: {r['problem']}" for r in checks.limit(20).collect()]
    if found:
        raise ValueError("; ".join(found))
    for name, df in outputs.items():
        if [c for c, _ in df.dtypes] == ["pos", "line"]:
            df.orderBy("pos").select("line").coalesce(1).write.mode("overwrite").text(f"{folder}/{name}")
        else:
            df.write.mode("overwrite").parquet(f"{folder}/{name}")
    return list(outputs)
