"""Lexical patterns in sentences of any length."""

import time

from quadrel.operators import text


def test_hearst_reads_a_long_sentence_once(spark):
    """A run of words without a pattern; one that is within many spaces; one pattern after another."""
    body = "word and " * 30_000
    docs = [(0, body), (1, f"{body}things such as wolves"), (2, "cats" + " " * 20_000 + "are" + " " * 20_000), (3, "Big cats,  small dogs including pugs, great danes and corgis; a fox is an animal, a cow is a beast."), (4, " \u00a0such as   x. y such as  . é such as ü")]
    began = time.time()
    got = {(x.sub, x.sup) for x in text.hearst(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert time.time() - began < 30
    assert got == {("wolve", "word thing"), ("pug", "small dog"), ("great dane", "small dog"), ("corgi", "small dog"), ("fox", "animal"), ("cow", "beast")}
