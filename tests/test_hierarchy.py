"""Ancestry of concepts without the types of individuals."""

from pyspark.sql import functions as F

from quadrel import queries
from quadrel.schema import OWL, SUB

SF = "/root/testdata/sf0.001"


def test_hierarchy_is_that_of_the_closure(spark):
    """The same subclass and equivalence triples; ancestry makes no closure of all triples."""
    e = queries._alignment(spark, SF)
    own = e.hierarchy
    assert "inferred" not in e.__dict__ and "asserted" not in e.__dict__
    want = e.inferred.filter(F.col("p").isin(SUB, OWL.equivalentClass))
    assert own.exceptAll(want).isEmpty() and want.exceptAll(own).isEmpty()
    p = queries._patterns(spark, SF)
    p.p1()
    assert "inferred" not in p.e.__dict__
