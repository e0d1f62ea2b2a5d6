"""The registered queries against their SQL at the smallest scale (a sample; the driver runs all)."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = ["classes_T2", "cross_edges_T10", "sparql_cross_edges_S15", "roots_leaves_T9", "closure_X1", "lpg_nodes_E1", "meta_nodes_E9", "plan_metrics_U3", "subsumption_R7", "reparent_R22", "notation_R30", "candidates_N9", "integrity_M1", "stream_sync_Y1", "turtle_S11", "rdf_xml_S11", "condensed_edges_X16", "guarded_depth_X13", "technology_M4", "list_rules_R34", "glossary_model_R27", "instances_R8", "sparql_update_S15", "lpg_load_E7"]


def test_names_match():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", NAMES)
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    flat = lambda v: round(v, 6) if isinstance(v, float) else v
    got = sorted(([flat(r[c]) for c in columns] for r in df.collect()), key=str)
    rel = con.sql(entry.oracle_sql()[name])
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    assert got == sorted(([flat(r[i]) for i in at] for r in rel.fetchall()), key=str)
