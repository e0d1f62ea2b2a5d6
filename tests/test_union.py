"""The union graph of the tables, without comparing all quads."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quadrel.plans.bgp import default_graph
from quadrel.sources import rdfize

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """The tables with rows twice, null keys and null brands."""
    to = tmp_path_factory.mktemp("odd")
    for t in rdfize.TABLES:
        d = spark.read.parquet(f"{SF}/{t}.parquet")
        first = d.limit(2)
        if t in ("customer", "supplier", "part"):
            first = first.unionByName(d.limit(2).withColumn(d.columns[0], F.lit(None).cast(d.schema[0].dataType)))
        if t == "part":
            first = first.unionByName(d.limit(3).withColumn("p_partkey", F.col("p_partkey") + 1_000_000).withColumn("p_brand", F.lit(None).cast("string")))
        d.unionByName(first).write.parquet(f"{to}/{t}.parquet")
    return str(to)


def test_union_is_the_set(spark, odd):
    """The same triples as by comparing all, each once."""
    for folder in (SF, odd):
        want, got = default_graph(rdfize.quads(spark, folder)), rdfize.triples(spark, folder)
        assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
        q, s = rdfize.quads(spark, folder), rdfize.subjects(spark, folder)
        keys = ["g", "s", "s_kind", "p"]
        assert q.select(keys).distinct().exceptAll(s.distinct()).isEmpty() and s.distinct().exceptAll(q.select(keys).distinct()).isEmpty()


@pytest.mark.parametrize("name", ["skos_summary_T6", "ntriples_F14", "profile_counts_R29", "count_quads_S16"])
def test_mappings_are_not_compared(spark, name):
    """No set of whole triples is built, as customers times suppliers of them would be shuffled."""
    lines, within, mapped = entry.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString().splitlines(), None, 0
    for x in lines:
        depth = len(x) - len(x.lstrip(" :+-"))
        if within is not None and depth <= within:
            within = None
        if within is None and "Aggregate [" in x and "o_lang" in x.split("], [")[0]:
            within = depth
        if "Join Inner" in x and "c_nationkey" in x:
            mapped += 1
            assert within is None
    assert mapped >= 3


@pytest.mark.parametrize("name", ["short_name_F2", "curie_F7", "expand_F8", "last_name_F9", "namespaces_F10"])
def test_mapped_subjects_come_once(spark, name):
    """Only whether a customer has suppliers matters to the terms; the pairs are not made."""
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    joins = [x for x in plan.splitlines() if "Join" in x and "c_nationkey" in x]
    assert joins and all("LeftSemi" in x for x in joins)
