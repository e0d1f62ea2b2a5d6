"""Text to ontology: sentences, tokens, lemmas, tags, term scores, co-occurrence, relations, patterns, evaluation.

All rules are Column expressions. Windows are partitioned by (document, sentence), so a long
document is many small partitions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

# Word lists that the tagging rules refer to, in their order.
STOPWORDS = (
    "a an the and or but if of to in on for with as is are was were be been being by at this that these those it its they them their "
    "we you he she from into than then so such can may will would should could have has had not no do does did which who whom whose also"
).split()
DETERMINERS = "a an the this that these those some any each many much several few all most every no".split()
PREPOSITIONS = "of in on for with as by at from into to".split()
SEED_VERBS = (
    "has have contains contain includes include plays play uses use produces produce requires require is are eats eat owns own "
    "consists consist trains train lives live belongs belong makes make gives give relates relate occurs occur assigns assign located "
    "supervises supervise teaches teach works work writes write manages manage"
).split()
ADJECTIVE_ENDINGS = "ous ive al ic able ible".split()
WORD = r"([A-Za-z][A-Za-z'-]*)"
SENTENCE = ["doc_id", "sent_id"]


def sentence_array(text: Column) -> Column:
    """Sentences: cut at white space after ``.``, ``!`` or ``?``, trimmed, none empty."""
    marked = F.regexp_replace(text, r"([.!?])\s+", "$1\u0001")
    return F.filter(F.transform(F.split(marked, "\u0001"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")


def sentences(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.posexplode(sentence_array(F.col("text"))).alias("sent_id", "sentence"))


def lemma(word: Column) -> Column:
    w, n = F.lower(word), F.length(word)
    cut = lambda k: F.substring(w, F.lit(1), n - k)
    out = F.when((n > 4) & w.endswith("ies"), F.concat(cut(3), F.lit("y"))).when((n > 4) & w.endswith("ses"), cut(2))
    out = out.when((n > 3) & w.rlike("[sxz]es$"), cut(2)).when((n > 3) & w.endswith("s") & ~w.endswith("ss"), cut(1))
    return out.otherwise(w)


def tag(word: Column, first: Column) -> Column:
    w = F.lower(word)
    adjective = reduce(lambda a, b: a | b, (w.endswith(e) for e in ADJECTIVE_ENDINGS))
    out = F.when(w.isin(DETERMINERS), "DET").when(w.isin(PREPOSITIONS), "ADP").when(w.isin(SEED_VERBS) | w.endswith("ing"), "VERB")
    out = out.when(w.endswith("ed") & (F.length(w) > 4), "VERB").when(adjective, "ADJ")
    return out.when(word.rlike("^[A-Z]") & ~first, "PROPN").when(w.isin(STOPWORDS), "OTHER").otherwise("NOUN")


def tokens(docs: DataFrame) -> DataFrame:
    """doc_id, sent_id, pos, surface, lemma, tag."""
    words = sentences(docs).select("doc_id", "sent_id", F.posexplode(F.regexp_extract_all("sentence", F.lit(WORD), F.lit(1))).alias("pos", "surface"))
    return words.select("doc_id", "sent_id", "pos", "surface", lemma(F.col("surface")).alias("lemma"), tag(F.col("surface"), F.col("pos") == 0).alias("tag"))


def content(tokens_: DataFrame) -> DataFrame:
    return tokens_.filter(F.col("tag").isin("NOUN", "PROPN") & ~F.col("lemma").isin(STOPWORDS))


def term_frequencies(tokens_: DataFrame) -> DataFrame:
    return content(tokens_).groupBy("lemma").agg(F.count("*").alias("frequency"))


def relevance(foreground: DataFrame, background: DataFrame | None = None) -> DataFrame:
    """lemma, relevance: by contrast with a background corpus, or plain relative frequency without one."""
    fg = term_frequencies(foreground)
    total = fg.agg(F.sum("frequency").alias("fg_total"))
    if background is None:
        return fg.crossJoin(F.broadcast(total)).select("lemma", (F.col("frequency") / F.col("fg_total")).alias("relevance"))
    bg = term_frequencies(background).withColumnRenamed("frequency", "bg")
    if bg.isEmpty():
        return relevance(foreground)
    totals = total.crossJoin(bg.agg(F.sum("bg").alias("bg_total")))  # one row
    p_fg, p_bg = F.col("frequency") / F.col("fg_total"), F.coalesce("bg", F.lit(0)) / F.col("bg_total")
    scored = fg.join(bg, "lemma", "left").crossJoin(F.broadcast(totals))
    return scored.select("lemma", (p_fg * F.log((p_fg + 1e-9) / (p_bg + 1e-9) + 1.0)).alias("relevance"))


def cooccurrence(tokens_: DataFrame) -> DataFrame:
    """term_a < term_b, n: unordered pairs of different content lemmas in a sentence."""
    lemmas = content(tokens_).groupBy(*SENTENCE).agg(F.array_sort(F.collect_set("lemma")).alias("l"))
    # pairs come from each sentence's own sorted list, a left term at a time, so that no row holds them all
    left = lemmas.select("l", F.posexplode("l").alias("i", "term_a"))
    pairs = left.select("term_a", F.explode(F.slice("l", F.col("i") + 2, F.size("l"))).alias("term_b"))
    return pairs.groupBy("term_a", "term_b").agg(F.count("*").alias("n"))


def phrases(tokens_: DataFrame) -> DataFrame:
    """term, frequency, first: runs of adjacent adjectives and nouns with a noun among them."""
    nouny = tokens_.filter(F.col("tag").isin("ADJ", "NOUN", "PROPN"))
    island = nouny.withColumn("island", F.col("pos") - F.row_number().over(Window.partitionBy(*SENTENCE).orderBy("pos")))
    runs = island.groupBy(*SENTENCE, "island").agg(F.sort_array(F.collect_list(F.struct("pos", "lemma"))).alias("w"), F.bool_or(F.col("tag") != "ADJ").alias("noun"), F.min("pos").alias("at"))
    text = F.array_join(F.transform("w", lambda x: x["lemma"]), " ")
    return runs.filter("noun").select(text.alias("term"), F.struct("doc_id", "sent_id", "at").alias("at")).groupBy("term").agg(F.count("*").alias("frequency"), F.min("at").alias("first"))


def candidate_terms(tokens_: DataFrame, relevance_: DataFrame, min_frequency: int = 1) -> DataFrame:
    """term, frequency, score, first: score blends frequency, length and relevance of the head word."""
    p = phrases(tokens_).filter(F.col("frequency") >= min_frequency).withColumn("head", F.substring_index("term", " ", -1))
    r = relevance_.select(F.col("lemma").alias("head"), F.col("relevance").alias("by_head"))
    whole = relevance_.select(F.col("lemma").alias("term"), F.col("relevance").alias("by_term"))
    rel = F.coalesce("by_head", "by_term", F.lit(0.0))
    length = F.size(F.split("term", " "))
    score = F.col("frequency") * (1.0 + F.log(length + F.lit(1.0))) * (1.0 + rel)
    return p.join(r, "head", "left").join(whole, "term", "left").select("term", "frequency", F.round(score, 4).alias("score"), "first")


def top_terms(candidates: DataFrame, k: int) -> DataFrame:
    """The k best by score, ties by first occurrence."""
    return candidates.orderBy(F.desc("score"), "first").limit(k)


def composition(terms: DataFrame) -> DataFrame:
    """sub, sup: a term of several words is below its last word, if that is a term."""
    heads = terms.select(F.col("term").alias("sup")).distinct()
    several = terms.filter(F.instr("term", " ") > 0).select(F.col("term").alias("sub"), F.substring_index("term", " ", -1).alias("sup"))
    return several.join(heads, "sup", "left_semi").select("sub", "sup")


def known_terms(terms: DataFrame) -> DataFrame:
    """lemma: terms and their last words."""
    return terms.select(F.explode(F.array("term", F.substring_index("term", " ", -1))).alias("lemma")).distinct()


def relations(tokens_: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """subject, predicate, object, support: seed verb with the nearest known noun on each side."""
    noun = F.col("tag").isin("NOUN", "PROPN")
    t = tokens_
    if known is not None and not known.isEmpty():
        t = t.join(known.select("lemma").distinct().withColumn("known", F.lit(True)), "lemma", "left")
        noun = noun & F.col("known")
    w = Window.partitionBy(*SENTENCE).orderBy("pos")
    near = F.when(noun, F.col("lemma"))
    t = t.withColumn("subject", F.last(near, True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    t = t.withColumn("object", F.first(near, True).over(w.rowsBetween(1, Window.unboundedFollowing)))
    verbs = t.filter((F.col("tag") == "VERB") & F.col("lemma").isin(SEED_VERBS) & (F.col("subject") != F.col("object")))
    return verbs.groupBy("subject", F.col("lemma").alias("predicate"), "object").agg(F.count("*").alias("support"))


def normal_span(span: Column) -> Column:
    """The last two words that are no stop words, the last one lemmatised; empty if none."""
    words = F.filter(F.regexp_extract_all(F.lower(span), F.lit(WORD), F.lit(1)), lambda w: ~w.isin(STOPWORDS))
    n = F.size(words)
    head = lemma(F.get(words, n - 1))
    return F.when(n == 0, "").when(n == 1, head).otherwise(F.concat_ws(" ", F.get(words, n - 2), head))


# The four patterns of super- and subordinate phrases (pattern, group of the one above, group of those below).
# Each can only begin where a run of words and white space does, and its first phrase ends at a word, so that a
# run without the pattern is read once, not once from each of its characters.
_PHRASE = r"(?iU)(?<![\w\s])([\w\s](?:[\w\s]*?\w)??)\s++"
HEARST = (
    (_PHRASE + r"such as\s+([\w\s,]+)", 1, 2),
    (_PHRASE + r"including\s+([\w\s,]+)", 1, 2),
    (_PHRASE + r"especially\s+([\w\s,]+)", 1, 2),
    (_PHRASE + r"(?:is|are)\s+(?:a|an)\s+([\w\s]+)", 2, 1),
)
#: What every sentence with a pattern holds; no such sentence lacks it.
HEARST_CUE = r"(?iU)\s(?:such as|including|especially|(?:is|are)\s+(?:a|an))\s"


def _place(k: int):
    return lambda m, at: F.struct(F.lit(k).alias("pattern"), at.alias("at"), m["sup"].alias("sup"), m["sub"].alias("sub"))


def hearst(docs: DataFrame) -> DataFrame:
    """sub, sup, first: subsumptions that lexical patterns state, each once, with its first place."""
    s = sentences(docs).filter(F.col("sentence").rlike(HEARST_CUE))
    kinds = []
    for k, (pattern, above, below) in enumerate(HEARST):
        found = F.arrays_zip(F.regexp_extract_all("sentence", F.lit(pattern), F.lit(above)).alias("sup"), F.regexp_extract_all("sentence", F.lit(pattern), F.lit(below)).alias("sub"))
        kinds.append(F.transform(found, _place(k)))
    parts = s.select("doc_id", "sent_id", F.explode(F.concat(*kinds)).alias("m")).select("doc_id", "sent_id", "m.*")
    parts = parts.select("doc_id", "sent_id", "pattern", "at", "sup", F.posexplode(F.split("sub", r",|\band\b")).alias("nth", "sub"))
    n = parts.withColumn("sup", normal_span(F.col("sup"))).withColumn("sub", normal_span(F.col("sub")))
    n = n.filter("sub <> '' and sup <> '' and sub <> sup")
    return n.groupBy("sub", "sup").agg(F.min(F.struct("doc_id", "sent_id", "pattern", "at", "nth")).alias("first"))


def prf(found: DataFrame, gold: DataFrame, key: str | list[str] = "label") -> DataFrame:
    """One row: precision, recall, f1, tp, support."""
    keys = [key] if isinstance(key, str) else key
    f, g = found.select(*keys).distinct(), gold.select(*keys).distinct()
    n = f.agg(F.count("*").alias("n")).crossJoin(g.agg(F.count("*").alias("support"))).crossJoin(f.join(g, keys, "left_semi").agg(F.count("*").alias("tp")))
    p, r = F.when((F.col("n") > 0) & (F.col("support") > 0), F.col("tp") / F.col("n")).otherwise(0.0), F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    f1 = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    return n.select(F.round(p, 3).alias("precision"), F.round(r, 3).alias("recall"), F.round(f1, 3).alias("f1"), "tp", "support")


def coverage(vocabulary: DataFrame, heads: DataFrame, key: str = "lemma") -> DataFrame:
    """One row: share of the corpus vocabulary that the heads cover."""
    v = vocabulary.select(key).distinct()
    both = v.join(heads.select(key).distinct().withColumn("in", F.lit(1)), key, "left")
    return both.agg(F.when(F.count("*") > 0, F.count("in") / F.count("*")).otherwise(0.0).alias("coverage"))


def apply_decisions(classes: DataFrame, subclass_of: DataFrame, properties: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Classes, edges and properties that a human gate keeps; without a decision all stays; edges fall with their ends."""
    no = decisions.filter("not keep")
    kept = classes.join(no.filter("kind = 'class'").select("label"), "label", "left_anti")
    ends = kept.select("label")
    e = subclass_of.join(ends.select(F.col("label").alias("sub")), "sub", "left_semi").join(ends.select(F.col("label").alias("sup")), "sup", "left_semi")
    e = e.withColumn("label", F.concat_ws(" -> ", "sub", "sup")).join(no.filter("kind = 'subclass'").select("label"), "label", "left_anti").drop("label")
    p = properties.join(ends.select(F.col("label").alias("subject")), "subject", "left_semi").join(ends.select(F.col("label").alias("object")), "object", "left_semi")
    p = p.withColumn("label", F.concat_ws(" ", "subject", "predicate", "object")).join(no.filter("kind = 'property'").select("label"), "label", "left_anti").drop("label")
    return kept, e, p


def summary(classes: DataFrame, subclass_of: DataFrame, properties: DataFrame, axioms: DataFrame) -> DataFrame:
    counts = [d.agg(F.count("*").alias(n)) for d, n in ((classes, "classes"), (subclass_of, "subclass_axioms"), (properties, "object_properties"), (axioms, "other_axioms"))]
    return reduce(lambda a, b: a.crossJoin(b), counts)
