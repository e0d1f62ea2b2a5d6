"""One call from quads to a stored property graph: extract, transform, embed, load."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import partial

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..plans.fixpoint import cut
from . import lpg
from .embed import embed, hash_vector
from .store import Versions, merge

#: Keys by which a load replaces what is stored.
KEYS = {"nodes": ["iri"], "edges": ["src", "dst", "type"], "embeddings": ["iri"]}


def embedder(kind: str = "hash", dim: int = 384) -> Callable[[str | None], list[float]]:
    """A function of a text by name; ``sentence-transformers`` needs that package and a model on every worker."""
    if kind == "hash":
        return partial(hash_vector, dim=dim)
    if kind == "sentence-transformers":
        try:
            from sentence_transformers import SentenceTransformer
        except ImportError as e:
            raise ValueError("sentence-transformers is not installed") from e
        model = SentenceTransformer("all-MiniLM-L6-v2")
        return lambda text: model.encode(text or "", normalize_embeddings=True).tolist()
    raise ValueError(f"unknown embedder {kind!r}")


@dataclass
class Projection:
    """Nodes and edges between extraction and loading."""

    nodes: DataFrame
    edges: DataFrame

    def stats(self) -> dict[str, int]:
        return lpg.stats(self.nodes, self.edges).first().asDict()

    def embeddings(self, kind: str = "hash", dim: int = 384) -> DataFrame:
        """iri, embedding of each node's profile text."""
        return embed(lpg.profiles(self.nodes, self.edges), "profile", encode=embedder(kind, dim)).select("iri", "embedding")


def extract_transform(quads: DataFrame) -> Projection:
    """The class graph of the quads; each table is computed once."""
    nodes = cut(lpg.nodes(lpg.extract_classes(quads)))
    return Projection(nodes, cut(lpg.edges(lpg.extract_taxonomy(quads), lpg.extract_properties(quads), nodes)))


class GraphStore:
    """Nodes, edges and embeddings in versions on any file system Spark reaches.

    A load is an upsert by ``KEYS``: loading the same twice changes nothing. Without embeddings those stored
    stay. An empty store reads as no version.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.versions = spark, root.rstrip("/"), Versions(spark, root)

    def table(self, name: str) -> DataFrame | None:
        version = self.versions.current()
        if version is None:
            return None
        path = f"{self.root}/{version}/{name}"
        fs, p = self.versions._fs(path)
        return self.spark.read.parquet(path) if fs.exists(p) else None

    def load(self, nodes: DataFrame, edges: DataFrame, embeddings: DataFrame | None = None, clear: bool = False) -> dict[str, int]:
        """Merge the tables into a new version (clear: in place of what is stored); rows merged and held."""
        incoming = {"nodes": nodes, "edges": lpg.merged_edges(edges), "embeddings": embeddings}
        version, out = self.versions.fresh(), {}
        for name, df in incoming.items():
            held = None if clear else self.table(name)
            if df is None and held is None:
                continue
            path = f"{self.root}/{version}/{name}"
            (held if df is None else df if held is None else merge(held, df, KEYS[name])).write.parquet(path)
            out[name] = self.spark.read.parquet(path).count()
            out[name + "_merged"] = 0 if df is None else df.count()
        self.versions.commit(version)
        return out


def run(quads: DataFrame, store: GraphStore, clear: bool = True, embed_with: str | None = None, dim: int = 384) -> dict[str, dict[str, int]]:
    """All steps; ``ir``: counts of the projection, ``loaded``: of the store."""
    made = extract_transform(quads)
    vectors = made.embeddings(embed_with, dim) if embed_with else None
    return {"ir": made.stats(), "loaded": store.load(made.nodes, made.edges, vectors, clear)}
