"""Bottom-up ontology development as a configurable sequence of steps over DataFrames.

The order of steps lives on the driver; artifacts are lazy DataFrames on a shared state, and only
tokens, which every later step reads, are materialised.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, functions as F

from . import text as T
from ..plans.fixpoint import cut

SOURCE, SINK = "Corpus", "Ontology"


@dataclass
class State:
    """Inputs and artifacts. documents and background: (doc_id, text); decisions: (kind, label, keep)."""

    documents: DataFrame
    background: DataFrame | None = None
    gold_classes: DataFrame | None = None
    gold_relations: DataFrame | None = None
    decisions: DataFrame | None = None
    artifacts: dict[str, DataFrame] = field(default_factory=dict)
    log: list[str] = field(default_factory=list)

    def get(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """An artifact, made when first asked for."""
        if name not in self.artifacts:
            self.artifacts[name] = make()
        return self.artifacts[name]

    @property
    def tokens(self) -> DataFrame:
        return self.get("tokens", lambda: cut(T.tokens(self.documents)))

    @property
    def relevance(self) -> DataFrame:
        return self.get("relevance", lambda: T.relevance(self.tokens, None if self.background is None else T.tokens(self.background)))

    @property
    def classes(self) -> DataFrame:
        return self.get("classes", lambda: self.artifacts["terms"].select(F.col("term").alias("label")).distinct())


def text_cleaning(state: State) -> None:
    state.tokens


def preprocessing(state: State) -> None:
    state.relevance
    state.get("cooccurrence", lambda: T.cooccurrence(state.tokens))


def term_extraction(state: State, min_frequency: int = 1, top_k: int | None = None) -> None:
    terms = T.candidate_terms(state.tokens, state.relevance, min_frequency)
    state.artifacts["terms"] = cut(T.top_terms(terms, top_k) if top_k is not None else terms)
    state.artifacts["subclass_of"] = T.composition(state.artifacts["terms"]).distinct().withColumn("origin", F.lit("composition"))
    state.classes


def relation_extraction(state: State) -> None:
    state.artifacts["relations"] = T.relations(state.tokens, T.known_terms(state.artifacts["terms"]))


def axiom_finding(state: State) -> None:
    """Adds pairs that are new; their ends become classes."""
    found = T.hearst(state.documents).select("sub", "sup")
    fresh = cut(found.join(state.artifacts["subclass_of"].select("sub", "sup"), ["sub", "sup"], "left_anti").withColumn("origin", F.lit("pattern")))
    state.artifacts["subclass_of"] = state.artifacts["subclass_of"].unionByName(fresh)
    state.artifacts["axioms"] = fresh
    state.artifacts["classes"] = state.classes.unionByName(fresh.select(F.explode(F.array("sub", "sup")).alias("label"))).distinct()


def human_in_the_loop(state: State) -> None:
    if state.decisions is None:
        state.log.append("human_in_the_loop: no decisions, all accepted")
        return
    a = state.artifacts
    kept, edges, relations = T.apply_decisions(state.classes, a["subclass_of"], a["relations"], state.decisions)
    a["classes"], a["subclass_of"], a["relations"] = kept, edges, relations
    a["terms"] = a["terms"].join(kept.select(F.col("label").alias("term"), F.lit(True).alias("accepted")), "term", "left").na.fill(False, ["accepted"])


def evaluation(state: State) -> None:
    a = state.artifacts
    lower = state.classes.select(F.lower("label").alias("label"))
    if state.gold_classes is not None:
        a["class_prf"] = T.prf(lower, state.gold_classes.select(F.lower("label").alias("label")))
    if state.gold_relations is not None:
        a["relation_prf"] = T.prf(a["relations"], state.gold_relations, ["subject", "predicate", "object"])
    heads = lower.select(F.substring_index("label", " ", -1).alias("lemma"))
    a["coverage"] = T.coverage(T.term_frequencies(state.tokens), heads).select(F.round("coverage", 3).alias("vocab_coverage"))


@dataclass(frozen=True)
class Step:
    id: str
    label: str
    run: Callable[..., None]
    mandatory: bool
    description: str
    parameters: dict[str, dict[str, Any]] = field(default_factory=dict)


STEPS = {
    s.id: s
    for s in (
        Step("text_cleaning", "Text cleaning", text_cleaning, True, "Sentences, tokens, lemmas and tags of the corpus."),
        Step("preprocessing", "Pre-processing", preprocessing, True, "Contrastive relevance and co-occurrence."),
        Step("term_extraction", "Term extraction", term_extraction, True, "Candidate classes and composition subclasses.", {"min_frequency": {"type": "integer", "default": 1}, "top_k": {"type": "integer", "default": None}}),
        Step("relation_extraction", "Relation extraction", relation_extraction, True, "Object property candidates by seed verbs."),
        Step("axiom_finding", "Axiom finding", axiom_finding, False, "Subsumptions by lexical patterns."),
        Step("human_in_the_loop", "Human in the loop", human_in_the_loop, False, "Prune by recorded decisions."),
        Step("evaluation", "Evaluation", evaluation, True, "Gold standard comparison and vocabulary coverage."),
    )
}


@dataclass
class Workflow:
    """Steps in pipeline order, with parameters."""

    steps: list[str]
    params: dict[str, dict[str, Any]] = field(default_factory=dict)

    @classmethod
    def configure(cls, axiom_finding: bool = True, human_in_the_loop: bool = True, params: dict[str, dict[str, Any]] | None = None) -> "Workflow":
        on = {"axiom_finding": axiom_finding, "human_in_the_loop": human_in_the_loop}
        return cls([s for s in STEPS if on.get(s, True)], params or {})

    def add(self, step: str) -> "Workflow":
        if step not in STEPS:
            raise KeyError(f"unknown step {step!r}; known: {sorted(STEPS)}")
        return Workflow([s for s in STEPS if s in {*self.steps, step}], self.params)

    def remove(self, step: str) -> "Workflow":
        if STEPS[step].mandatory:
            raise ValueError(f"{step} is mandatory")
        return Workflow([s for s in self.steps if s != step], self.params)

    def edges(self) -> list[tuple[str, str, str]]:
        """(from, to, relation): the chain from corpus to ontology; human checks verify the evaluation."""
        if not self.steps:
            return []
        out = [(SOURCE, self.steps[0], "provides"), *((a, b, "verifies" if (a, b) == ("human_in_the_loop", "evaluation") else "then") for a, b in zip(self.steps, self.steps[1:])), (self.steps[-1], SINK, "produces")]
        return out

    def plan(self) -> list[str]:
        return list(self.steps)

    def run(self, state: State) -> State:
        for s in self.steps:
            STEPS[s].run(state, **self.params.get(s, {}))
            state.log.append(f"{s}: done")
        return state


def tool_specs(steps: list[str] | None = None) -> list[dict[str, Any]]:
    """JSON tool descriptions of the steps."""
    out = []
    for s in (STEPS[i] for i in steps or STEPS):
        required = [k for k, v in s.parameters.items() if "default" not in v]
        out.append({"type": "function", "function": {"name": f"step_{s.id}", "description": f"{s.description} [{'mandatory' if s.mandatory else 'optional'} step]", "parameters": {"type": "object", "properties": s.parameters, "required": required}, "x-step-id": s.id, "x-mandatory": s.mandatory}})
    return out


def invoke(state: State, name: str, limit: int = 100, **arguments: Any) -> dict[str, list[str]]:
    """Run a step by tool name; a few rows of each artifact as JSON."""
    STEPS[name.removeprefix("step_")].run(state, **arguments)
    return {k: df.limit(limit).toJSON().collect() for k, df in state.artifacts.items() if k != "tokens"}


def to_turtle(classes: DataFrame, subclass_of: DataFrame, relations: DataFrame, iri: str) -> DataFrame:
    """pos, line: the extracted ontology as Turtle; a predicate's first domain and range only."""
    from ..functions.terms import class_ident, property_ident
    from ..schema import OWL, RDF, RDFS

    heads = [f"@prefix : <{iri}> .", f"@prefix owl: <{OWL}> .", f"@prefix rdf: <{RDF}> .", f"@prefix rdfs: <{RDFS}> .", ""]
    out = classes.sparkSession.range(1).select(F.posexplode(F.array(*map(F.lit, heads))).alias("i", "line")).select(F.struct(F.lit(0).alias("part"), F.format_string("%09d", "i").alias("key")).alias("pos"), "line")
    rows = lambda df, part, key, line: df.select(F.struct(F.lit(part).alias("part"), key.alias("key")).alias("pos"), line.alias("line"))
    c = classes.select("label").distinct()
    out = out.unionByName(rows(c, 1, F.col("label"), F.concat(F.lit(":"), class_ident(F.col("label")), F.lit(' a owl:Class ; rdfs:label "'), "label", F.lit('" .'))))
    e = subclass_of.select("sub", "sup").distinct()
    out = out.unionByName(rows(e, 2, F.concat_ws("\u0001", "sub", "sup"), F.concat(F.lit(":"), class_ident(F.col("sub")), F.lit(" rdfs:subClassOf :"), class_ident(F.col("sup")), F.lit(" ."))))
    p = relations.withColumn("id", property_ident(F.col("predicate"))).groupBy("id").agg(F.min(F.struct("subject", "object")).alias("b"))
    line = F.concat(F.lit(":"), "id", F.lit(" a owl:ObjectProperty ; rdfs:domain :"), class_ident(F.col("b.subject")), F.lit(" ; rdfs:range :"), class_ident(F.col("b.object")), F.lit(" ."))
    return out.unionByName(rows(p, 3, F.col("id"), line))
