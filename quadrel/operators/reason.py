"""OWL 2 RL materialisation by semi-naive rounds.

A rule is a list of body patterns and head triples over variables. In every round each body
pattern in turn is matched against the triples that the last round added and the others against
all triples, so no derivation is repeated. Rules are grouped in tiers; heads are distinct and
anti-joined with what is known. Class and property axioms are small beside instances, and AQE
broadcasts the side whose run-time size allows it.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..plans.bgp import is_var
from ..plans.fixpoint import cut
from ..schema import OWL, RDFS, SUB, TERM, TYPE

EQ, SUBP, DOM, RNG = OWL.equivalentClass, RDFS.subPropertyOf, RDFS.domain, RDFS.range


@dataclass(frozen=True)
class Rule:
    name: str
    body: tuple
    head: tuple


def rules(tiers: tuple[int, ...] = (1, 2, 3)) -> list[Rule]:
    """Rules of the public OWL 2 RL profile, by tier: 1 class hierarchy, 2 properties, 3 restrictions, 4 equality."""
    r = {
        1: [
            Rule("scm-sco", (("?a", SUB, "?b"), ("?b", SUB, "?c")), (("?a", SUB, "?c"),)),
            Rule("cax-sco", (("?a", SUB, "?b"), ("?x", TYPE, "?a")), (("?x", TYPE, "?b"),)),
            Rule("scm-eqc1", (("?a", EQ, "?b"),), (("?a", SUB, "?b"), ("?b", SUB, "?a"))),
            Rule("scm-eqc2", (("?a", SUB, "?b"), ("?b", SUB, "?a")), (("?a", EQ, "?b"),)),
        ],
        2: [
            Rule("prp-trp", (("?p", TYPE, OWL.TransitiveProperty), ("?x", "?p", "?y"), ("?y", "?p", "?z")), (("?x", "?p", "?z"),)),
            Rule("prp-symp", (("?p", TYPE, OWL.SymmetricProperty), ("?x", "?p", "?y")), (("?y", "?p", "?x"),)),
            Rule("prp-spo1", (("?p", SUBP, "?q"), ("?x", "?p", "?y")), (("?x", "?q", "?y"),)),
            Rule("prp-inv1", (("?p", OWL.inverseOf, "?q"), ("?x", "?p", "?y")), (("?y", "?q", "?x"),)),
            Rule("prp-inv2", (("?p", OWL.inverseOf, "?q"), ("?x", "?q", "?y")), (("?y", "?p", "?x"),)),
            Rule("prp-dom", (("?p", DOM, "?c"), ("?x", "?p", "?y")), (("?x", TYPE, "?c"),)),
            Rule("prp-rng", (("?p", RNG, "?c"), ("?x", "?p", "?y")), (("?y", TYPE, "?c"),)),
            Rule("scm-spo", (("?p", SUBP, "?q"), ("?q", SUBP, "?r")), (("?p", SUBP, "?r"),)),
            Rule("scm-eqp1", (("?p", OWL.equivalentProperty, "?q"),), (("?p", SUBP, "?q"), ("?q", SUBP, "?p"))),
            Rule("scm-dom1", (("?p", DOM, "?a"), ("?a", SUB, "?b")), (("?p", DOM, "?b"),)),
            Rule("scm-dom2", (("?q", DOM, "?c"), ("?p", SUBP, "?q")), (("?p", DOM, "?c"),)),
            Rule("scm-rng1", (("?p", RNG, "?a"), ("?a", SUB, "?b")), (("?p", RNG, "?b"),)),
            Rule("scm-rng2", (("?q", RNG, "?c"), ("?p", SUBP, "?q")), (("?p", RNG, "?c"),)),
        ],
        3: [
            Rule("cls-svf1", (("?r", OWL.someValuesFrom, "?c"), ("?r", OWL.onProperty, "?p"), ("?x", "?p", "?y"), ("?y", TYPE, "?c")), (("?x", TYPE, "?r"),)),
            Rule("cls-avf", (("?r", OWL.allValuesFrom, "?c"), ("?r", OWL.onProperty, "?p"), ("?x", TYPE, "?r"), ("?x", "?p", "?y")), (("?y", TYPE, "?c"),)),
            Rule("cls-hv1", (("?r", OWL.hasValue, "?v"), ("?r", OWL.onProperty, "?p"), ("?x", TYPE, "?r")), (("?x", "?p", "?v"),)),
            Rule("cls-hv2", (("?r", OWL.hasValue, "?v"), ("?r", OWL.onProperty, "?p"), ("?x", "?p", "?v")), (("?x", TYPE, "?r"),)),
            Rule("scm-svf1", (("?a", OWL.someValuesFrom, "?c"), ("?a", OWL.onProperty, "?p"), ("?b", OWL.someValuesFrom, "?d"), ("?b", OWL.onProperty, "?p"), ("?c", SUB, "?d")), (("?a", SUB, "?b"),)),
            Rule("scm-avf1", (("?a", OWL.allValuesFrom, "?c"), ("?a", OWL.onProperty, "?p"), ("?b", OWL.allValuesFrom, "?d"), ("?b", OWL.onProperty, "?p"), ("?c", SUB, "?d")), (("?a", SUB, "?b"),)),
        ],
        4: [
            Rule("eq-sym", (("?x", OWL.sameAs, "?y"),), (("?y", OWL.sameAs, "?x"),)),
            Rule("eq-trans", (("?x", OWL.sameAs, "?y"), ("?y", OWL.sameAs, "?z")), (("?x", OWL.sameAs, "?z"),)),
            Rule("eq-rep-s", (("?x", OWL.sameAs, "?y"), ("?x", "?p", "?o")), (("?y", "?p", "?o"),)),
            Rule("eq-rep-o", (("?x", OWL.sameAs, "?y"), ("?s", "?p", "?x")), (("?s", "?p", "?y"),)),
            Rule("prp-fp", (("?p", TYPE, OWL.FunctionalProperty), ("?x", "?p", "?y"), ("?x", "?p", "?z")), (("?y", OWL.sameAs, "?z"),)),
            Rule("prp-ifp", (("?p", TYPE, OWL.InverseFunctionalProperty), ("?x", "?p", "?z"), ("?y", "?p", "?z")), (("?x", OWL.sameAs, "?y"),)),
        ],
    }
    return [x for t in tiers for x in r.get(t, [])]


def _bind(triples: DataFrame, pattern: tuple) -> DataFrame:
    """Bindings of a pattern with the object's kind, datatype and language packed beside it."""
    s, p, o = pattern
    df = triples
    out = []
    for name, x in (("s", s), ("p", p)):
        if is_var(x):
            out.append(F.struct(F.col(name).alias("v"), (F.col("s_kind") if name == "s" else F.lit("iri")).alias("k"), F.lit(None).cast("string").alias("d"), F.lit(None).cast("string").alias("l")).alias(x[1:]))
        else:
            df = df.filter(F.col(name) == str(x))
    if is_var(o):
        out.append(F.struct(F.col("o").alias("v"), F.col("o_kind").alias("k"), F.col("o_dtype").alias("d"), F.col("o_lang").alias("l")).alias(o[1:]))
    else:
        df = df.filter((F.col("o") == str(o)) & (F.col("o_kind") == "iri"))
    return df.select(*out)


def _heads(bound: DataFrame, rule: Rule) -> list[DataFrame]:
    out = []
    for s, p, o in rule.head:
        term = lambda x: F.col(x[1:]) if is_var(x) else F.struct(F.lit(str(x)).alias("v"), F.lit("iri").alias("k"), F.lit(None).cast("string").alias("d"), F.lit(None).cast("string").alias("l"))
        a, b, c = term(s), term(p), term(o)
        out.append(bound.select(a["v"].alias("s"), a["k"].alias("s_kind"), b["v"].alias("p"), c["v"].alias("o"), c["k"].alias("o_kind"), c["d"].alias("o_dtype"), c["l"].alias("o_lang")).filter("s_kind <> 'literal'"))
    return out


def _fire(rule: Rule, known: DataFrame, delta: DataFrame) -> list[DataFrame]:
    out = []
    for new in range(len(rule.body)):
        order = [new, *(i for i in range(len(rule.body)) if i != new)]
        bound, left = None, order
        while left:
            at = next((i for i, k in enumerate(left) if bound is None or any(is_var(x) and x[1:] in bound.columns for x in rule.body[k])), 0)
            k = left.pop(at)
            part = _bind(delta if k == new else known, rule.body[k])
            if bound is None:
                bound = part
            else:
                on = [c for c in part.columns if c in bound.columns]
                bound = bound.join(part, on)
        out += _heads(bound, rule)
    return out


def _usable(rule: Rule, predicates: set[str], types: set[str]) -> bool:
    """Whether constants of the body can occur at all."""
    return all((is_var(p) or str(p) in predicates) and (is_var(o) or p != TYPE or str(o) in types) for _, p, o in rule.body)


class _Lists:
    """Axioms over RDF lists: intersections, unions and property chains, their lists unrolled once."""

    def __init__(self, known: DataFrame, tiers: tuple[int, ...]):
        from .ontology import _lists

        self.sets = self.chains = None
        named = known.filter(F.col("p").isin(str(OWL.intersectionOf), str(OWL.unionOf), str(OWL.propertyChainAxiom)))
        if named.isEmpty():
            return
        items = _lists(known)
        held = cut(named.select(F.col("s").alias("owner"), F.col("s_kind").alias("owner_kind"), "p", F.col("o").alias("list")).join(items, "list").distinct())
        if 3 in tiers:
            self.sets = held.filter(F.col("p") != OWL.propertyChainAxiom)
        if 2 in tiers:
            self.chains = held.filter(F.col("p") == OWL.propertyChainAxiom).select("owner", "list", "pos", F.col("item").alias("link"))
            self.longest = (self.chains.agg(F.max("pos")).first()[0] or 0) if not self.chains.isEmpty() else 0

    def schema(self) -> list[DataFrame]:
        """Subclass triples of intersections (below each member) and unions (above each)."""
        if self.sets is None:
            return []
        none = F.lit(None).cast("string")
        row = lambda df, s, sk, o, ok: df.select(F.col(s).alias("s"), F.col(sk).alias("s_kind"), F.lit(str(SUB)).alias("p"), F.col(o).alias("o"), F.col(ok).alias("o_kind"), none.alias("o_dtype"), none.alias("o_lang")).select(*TERM)
        return [row(self.sets.filter(F.col("p") == OWL.intersectionOf), "owner", "owner_kind", "item", "item_kind"), row(self.sets.filter(F.col("p") == OWL.unionOf), "item", "item_kind", "owner", "owner_kind")]

    def fire(self, known: DataFrame) -> list[DataFrame]:
        """Members of all parts of an intersection are its members; a chain of properties implies its property."""
        out = []
        if self.sets is not None:
            both = self.sets.filter(F.col("p") == OWL.intersectionOf).select("owner", "owner_kind", "item")
            size = both.groupBy("owner").agg(F.countDistinct("item").alias("size"))
            inst = known.filter(F.col("p") == TYPE).select("s", "s_kind", F.col("o").alias("item")).join(both, "item")
            full = inst.groupBy("s", "s_kind", "owner", "owner_kind").agg(F.countDistinct("item").alias("n")).join(size, "owner").filter("n = size")
            out.append(_triple(full, "s", "s_kind", F.lit(str(TYPE)), "owner", "owner_kind"))
        if self.chains is not None and self.longest:
            link = known.filter("o_kind <> 'literal'").select(F.col("s").alias("x"), F.col("s_kind").alias("x_kind"), F.col("p").alias("link"), F.col("o").alias("y"), F.col("o_kind").alias("y_kind"))
            size = self.chains.groupBy("list").agg(F.max("pos").alias("last"))
            at = link.join(self.chains.filter("pos = 0"), "link").select("owner", "list", "x", "x_kind", "y", "y_kind")
            for k in range(1, self.longest + 1):  # as many as the longest chain has properties
                step = link.join(self.chains.filter(F.col("pos") == k).select("list", "link"), "link").select("list", F.col("x").alias("y"), F.col("y").alias("z"), F.col("y_kind").alias("z_kind"))
                at = at.join(step, ["list", "y"]).select("owner", "list", "x", "x_kind", F.col("z").alias("y"), F.col("z_kind").alias("y_kind")).distinct()
                out.append(_triple(at.join(size.filter(F.col("last") == k), "list"), "x", "x_kind", F.col("owner"), "y", "y_kind"))
        return out


def _triple(df: DataFrame, s: str, sk: str, p, o: str, ok: str) -> DataFrame:
    none = F.lit(None).cast("string")
    return df.select(F.col(s).alias("s"), F.col(sk).alias("s_kind"), p.alias("p"), F.col(o).alias("o"), F.col(ok).alias("o_kind"), none.alias("o_dtype"), none.alias("o_lang")).select(*TERM).distinct()


def closure_rl(triples: DataFrame, tiers: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """All triples, asserted and derived, as a set."""
    known = triples.select(*TERM).distinct()
    lists = _Lists(cut(known), tiers)
    for part in lists.schema():
        known = known.unionByName(part)
    known = delta = cut(known.distinct())
    every = rules(tiers)
    heads = {str(h[1]) for r in every for h in r.head if not is_var(h[1])}
    # vocabulary only: predicates, and the classes that rules name
    named = {str(x) for r in every for b in r.body for x in b if not is_var(x)}
    predicates = heads | {r[0] for r in delta.filter(F.col("p").isin(list(named))).select("p").distinct().collect()}
    types = {r[0] for r in delta.filter((F.col("p") == TYPE) & F.col("o").isin(list(named))).select("o").distinct().collect()}
    usable = [r for r in every if _usable(r, predicates | {TYPE}, types)]
    while True:  # terms are finite, so rounds end
        parts = [d for r in usable for d in _fire(r, known, delta)] + lists.fire(known)
        found = reduce(DataFrame.unionByName, parts)
        fresh = found.distinct().alias("f").join(known.alias("k"), [F.col(f"f.{c}").eqNullSafe(F.col(f"k.{c}")) for c in TERM], "left_anti")
        delta = cut(fresh)
        if delta.isEmpty():
            return known
        known = cut(known.unionByName(delta))


def new_triples(inferred: DataFrame, asserted: DataFrame) -> DataFrame:
    return inferred.select(*TERM).subtract(asserted.select(*TERM))


def clashes(inferred: DataFrame) -> DataFrame:
    """offending, disjoint_a < disjoint_b: named members of two disjoint classes."""
    pairs = inferred.filter((F.col("p") == OWL.disjointWith) & (F.col("s") != F.col("o"))).select(F.least("s", "o").alias("disjoint_a"), F.greatest("s", "o").alias("disjoint_b")).distinct()
    member = inferred.filter(F.col("p").isin(str(TYPE), str(SUB)) & (F.col("s_kind") == "iri")).select(F.col("s").alias("offending"), F.col("o").alias("cls")).distinct()
    a = member.withColumnRenamed("cls", "disjoint_a")
    b = member.withColumnRenamed("cls", "disjoint_b")
    both = pairs.join(a, "disjoint_a").join(b, ["disjoint_b", "offending"])
    return both.filter((F.col("offending") != F.col("disjoint_a")) & (F.col("offending") != F.col("disjoint_b")) & (F.col("offending") != OWL.Nothing)).select("offending", "disjoint_a", "disjoint_b").distinct()


def is_disjoint(inferred: DataFrame, a: str, b: str) -> bool:
    """Whether two classes are disjoint, by axiom on them or on classes above them."""
    up = lambda c, n: inferred.filter((F.col("p") == SUB) & (F.col("s") == c)).select(F.col("o").alias(n)).unionByName(inferred.sparkSession.range(1).select(F.lit(c).alias(n)))
    axioms = inferred.filter(F.col("p") == OWL.disjointWith).select(F.col("s").alias("x"), F.col("o").alias("y"))
    both = axioms.unionByName(axioms.select(F.col("y").alias("x"), F.col("x").alias("y")))
    return not both.join(up(a, "x"), "x", "left_semi").join(up(b, "y"), "y", "left_semi").isEmpty()
