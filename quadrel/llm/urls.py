"""URL filtering by rules and a path-template tree (operator 8); DataFrame functions only.

Rules (host and path prefix) decide first, the longest that fits. For the rest, the distinct paths
of each host form a tree, level by level: below one node a segment stays literal if it is common
there, or if there are few different ones; all others, and numbers, are variable and become ``*``.
A node under which few distinct paths lie has few segments at every level below: it is a leaf of the
tree, whose templates are finished at once, and rounds go on only below larger nodes, however deep
paths are.

Literal siblings are merged if they are statistically alike: what comes next below one of them is
distributed as below all its siblings (chi-square), and its labelled rate, if it has any labelled
pages, is not significantly another. Purity is the smoothed share of bad labelled pages, backed off
from the template over merged branches and parents to the host: from the prior of all labelled
pages downwards, each node's labelled pages count against ``PRIOR_WEIGHT`` pages of the purity above
it (an only child has its parent's pages and does not count again). So a branch without labels has the purity of the branches it is like, or of its parent. A
template is rejected if its purity reaches ``REJECT`` and its host has labelled pages.

Labels are the rules' own verdicts: a page that a rule blocks is bad, one it allows is good.

Defined cases: null url or none with ``://``: empty host and path, verdict of the empty
template; empty segments don't count; repeated rows and ties are pages each, and weigh as such;
very long paths are read whole; other columns are ignored; hosts without labelled pages are allowed;
an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .common import discard, materialise

FEW, COMMON, LEAST = 8, 0.02, 5
#: Segments that are variable wherever they stand: numbers, and hexadecimal names with a digit.
VARIABLE = r"(?i)^(\d+|(?=.*\d)[0-9a-f-]{8,})(\.\w+)?$"
#: Pseudo-count and threshold of the smoothed purity; z of significantly different rates.
PRIOR_WEIGHT, REJECT, DIFFERENT = 4.0, 0.8, 1.96
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
#: What stands for the end of a path among the next steps, and for a merged step.
STOP, MERGED = "", "/{}"


def host_of(url: Column) -> Column:
    raw = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> Column:
    """struct(size, rule, verdict) of the longest rule that fits, or null. Rules are configuration, so they stand in the plan."""
    fits = []
    for verdict, rule in rules:
        h, slash, p = rule.partition("/")
        where = (host == h) | host.endswith(f".{h}")
        fits.append(F.when(where & path.startswith(slash + p), F.struct(F.lit(len(rule)).alias("size"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return reduce(lambda a, b: F.greatest(a, b), fits) if len(fits) > 1 else fits[0]


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, host, path of every page."""
    return pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))


def distinct_paths(parts: DataFrame, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """host, path, n pages, rule, by_rule, bad and labelled pages."""
    d = parts.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n")).withColumn("hit", rule_for(F.col("host"), F.col("path"), rules))
    d = d.select("host", "path", "n", F.col("hit.rule").alias("rule"), F.col("hit.verdict").alias("by_rule"))
    return d.withColumn("bad", F.when(F.col("by_rule") == "block", F.col("n")).otherwise(0)).withColumn("labelled", F.when(F.col("by_rule").isNotNull(), F.col("n")).otherwise(0))


def _step(segment: Column) -> Column:
    return F.when(segment.rlike(VARIABLE), "/*").otherwise(F.concat(F.lit("/"), segment))


def templates(paths: DataFrame) -> DataFrame:
    """host, path, steps (of the template), depth (of its leaf of the tree) of distinct paths (host, path, n)."""
    none = F.array().cast("array<string>")
    segments = F.filter(F.split("path", "/"), lambda s: s != "")
    active = materialise(paths.select("host", "path", "n", segments.alias("segments"), none.alias("steps")), "paths")
    written, done, level = [active], [], 0
    # a round is one plan that writes each path once, finished or not: plans of all rounds at once outgrow the driver
    while True:
        size = active.groupBy("host", "steps").agg(F.count(F.lit(1)).alias("paths"))
        at = active.withColumn("segment", F.get("segments", F.lit(level)))
        children = at.filter("segment is not null").groupBy("host", "steps", "segment").agg(F.sum("n").alias("n"))
        above = children.groupBy("host", "steps").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"))
        literal = children.join(above, ["host", "steps"]).filter((F.col("kinds") <= FEW) | ((F.col("n") >= LEAST) & (F.col("n") >= COMMON * F.col("total"))))
        literal = literal.filter(~F.col("segment").rlike(VARIABLE)).select("host", "steps", "segment", F.lit(True).alias("literal"))
        rest = F.transform(F.slice("segments", level + 1, F.greatest(F.size("segments") - level, F.lit(0))), _step)
        step = F.when(F.col("literal"), F.concat(F.lit("/"), "segment")).otherwise("/*")
        few, ended = F.col("paths") <= FEW, F.col("segment").isNull()
        steps = F.when(few, F.concat("steps", rest)).when(ended, F.col("steps")).otherwise(F.array_append("steps", step))
        placed = at.join(size, ["host", "steps"]).join(literal, ["host", "steps", "segment"], "left").select("host", "path", "n", "segments", steps.alias("steps"), (~few & ~ended).alias("open"))
        placed, level = materialise(placed, "paths"), level + 1
        written.append(placed)
        done.append(placed.filter("not open").select("host", "path", "steps", F.lit(level - 1).alias("depth")))
        active = placed.filter("open").drop("open")
        if active.isEmpty():
            break
    out = materialise(reduce(DataFrame.unionByName, done), "templates")
    for table in written:
        discard(table)
    return out


def purities(t: DataFrame) -> DataFrame:
    """host, steps, purity, host_labelled of every template in t (host, steps, depth, n, bad, labelled)."""
    own = materialise(t.groupBy("host", "steps", "depth").agg(*(F.sum(x).alias(x) for x in ("n", "bad", "labelled"))), "own")
    whole = own.agg(F.sum("bad").alias("b"), F.sum("labelled").alias("l")).first()
    prior = (whole["b"] or 0) / whole["l"] if whole["l"] else 0.0
    # every node above or at a template, with what comes next there
    level = F.explode(F.sequence(F.lit(0), F.col("depth"))).alias("level")
    seen = own.select("host", "steps", "n", "bad", "labelled", level)
    seen = seen.select("host", "n", "bad", "labelled", "level", F.slice("steps", 1, F.col("level")).alias("node"), F.when(F.col("level") < F.size("steps"), F.col("steps")[F.col("level")]).otherwise(STOP).alias("next"))
    by_next = materialise(seen.groupBy("host", "node", "level", "next").agg(*(F.sum(x).alias(x) for x in ("n", "bad", "labelled"))), "next")
    node = materialise(by_next.groupBy("host", "node", "level").agg(*(F.sum(x).alias(x) for x in ("n", "bad", "labelled"))), "nodes")
    # literal siblings: nodes under one parent whose last step is literal
    parent = F.slice("node", 1, F.col("level") - 1)
    literal = (F.col("level") > 0) & (F.try_element_at("node", F.lit(-1)) != "/*")
    kids = by_next.filter(literal).withColumn("parent", parent)
    pooled = kids.groupBy("host", "parent", "next").agg(F.sum("n").alias("all_next"))
    family = node.filter(literal).withColumn("parent", parent).groupBy("host", "parent").agg(F.sum("n").alias("all_n"), F.sum("bad").alias("all_bad"), F.sum("labelled").alias("all_labelled"))
    kinds = pooled.groupBy("host", "parent").agg(F.count(F.lit(1)).alias("kinds"))
    # chi-square over all next steps of the family: sum of seen ** 2 / expected, less n
    x = kids.join(pooled, ["host", "parent", "next"]).join(family.select("host", "parent", "all_n"), ["host", "parent"])
    x = x.join(node.select("host", "node", F.col("n").alias("node_n")), ["host", "node"])
    x = x.groupBy("host", "parent", "node").agg((F.sum(F.col("n") * F.col("n") * F.col("all_n") / (F.col("node_n") * F.col("all_next"))) - F.first("node_n")).alias("chi"))
    df = F.col("kinds") - 1
    rest_l, rest_b = F.col("all_labelled") - F.col("labelled"), F.col("all_bad") - F.col("bad")
    rate = F.col("all_bad") / F.when(F.col("all_labelled") > 0, F.col("all_labelled"))
    spread = F.sqrt(rate * (1 - rate) * (1 / F.when(F.col("labelled") > 0, F.col("labelled")) + 1 / F.when(rest_l > 0, rest_l)))
    z = F.abs(F.col("bad") / F.when(F.col("labelled") > 0, F.col("labelled")) - rest_b / F.when(rest_l > 0, rest_l)) / F.when(spread > 0, spread)
    judged = x.join(kinds, ["host", "parent"]).join(family, ["host", "parent"]).join(node.select("host", "node", "n", "bad", "labelled"), ["host", "node"])
    alike = (F.col("chi") <= df + 2 * F.sqrt(2 * df) + 1e-9) & (F.coalesce(z, F.lit(0.0)) < DIFFERENT)
    merged = materialise(judged.filter(alike).select("host", "node", F.lit(True).alias("merged")), "merged")
    # evidence of each node and of its merged branch
    every = node.join(merged, ["host", "node"], "left").withColumn("merged", F.coalesce("merged", F.lit(False))).withColumn("parent", F.when(F.col("level") > 0, parent))
    group = every.filter("merged").groupBy("host", "parent").agg(F.sum("bad").alias("m_bad"), F.sum("labelled").alias("m_labelled"))
    every = every.join(group, ["host", "parent"], "left")
    zero = F.lit(0).cast("bigint")
    every = every.select("host", "node", "level", "n", "bad", "labelled", F.when(F.col("merged"), F.col("m_bad")).otherwise(zero).alias("m_bad"), F.when(F.col("merged"), F.col("m_labelled")).otherwise(zero).alias("m_labelled"))
    above = own.select("host", "steps", level).select("host", "steps", F.slice("steps", 1, F.col("level")).alias("node"))
    kept = ("level", "n", "m_bad", "m_labelled", "bad", "labelled")
    itself = own.select("host", "steps", (F.col("depth") + 1).alias("level"), "n", zero.alias("m_bad"), zero.alias("m_labelled"), "bad", "labelled")
    chain = above.join(every, ["host", "node"]).select("host", "steps", *kept).unionByName(itself)
    chain = chain.groupBy("host", "steps").agg(F.sort_array(F.collect_list(F.struct(*kept))).alias("chain"))  # as many as the tree has levels

    def under(purity: Column, bad: Column, labelled: Column) -> Column:
        return (bad + PRIOR_WEIGHT * purity) / (labelled + PRIOR_WEIGHT)

    def down(at: Column, c: Column) -> Column:
        new = under(under(at["purity"], c["m_bad"], c["m_labelled"]), c["bad"], c["labelled"])
        return F.struct(F.when(c["n"] == at["n"], at["purity"]).otherwise(new).alias("purity"), c["n"].alias("n"))

    purity = F.aggregate("chain", F.struct(F.lit(float(prior)).alias("purity"), F.lit(-1).cast("bigint").alias("n")), down)["purity"]
    return chain.select("host", "steps", purity.alias("purity"), F.col("chain")[0]["labelled"].alias("host_labelled"))


def filter_urls(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity of every page."""
    parts = parsed(pages)
    paths = materialise(distinct_paths(parts, rules), "distinct")
    t = templates(paths)
    j = materialise(paths.join(t, ["host", "path"]), "placed")
    j = j.join(purities(j), ["host", "steps"])
    own = F.when((F.col("purity") >= REJECT) & (F.col("host_labelled") > 0), "block").otherwise("allow")
    # one row a distinct path, so this join is the only one over all pages
    verdicts = materialise(j.select("host", "path", "rule", F.coalesce("by_rule", own).alias("verdict"), F.array_join("steps", "").alias("template"), "purity"), "verdicts")
    return parts.join(verdicts, ["host", "path"]).select("page_id", "host", "path", "rule", "verdict", "template", "purity")
