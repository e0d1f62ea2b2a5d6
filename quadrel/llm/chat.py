"""Chat formatting over reply trees (operator 2).

Messages form trees by parent_id. Pointer doubling (iterative self-joins, a logarithmic number
of them) gives each message its root, depth and summed score; leaves are ranked within their
conversation by mean score; chosen leaves are expanded back to whole root-to-leaf paths by the
same jump tables, and each path is formatted as one conversation.

Template, a turn: ``<|im_start|>role<|im_sep|>text<|im_end|>``. Inside roles and texts a
backslash becomes two and ``<|`` becomes ``<\\|``; no marker can occur there, and reading
back is exact. The loss mask is the spans of assistant texts, in code points.

Defined cases: null role or text: empty; null or unknown parent: a root; equal turns: ordered
by role, then text; repeated rows: repeated turns; messages on or below a cycle have no root
and are in no path; null conv_id: a conversation of its own; empty table: no conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import materialise

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
SPAN = "array<struct<start:bigint,length:bigint>>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def chain(turns: DataFrame) -> DataFrame:
    """Messages of linear conversations (conv_id, turn, role, text): each replies to the one before it."""
    t = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    t = t.withColumn("node_id", F.row_number().over(order).cast("bigint"))
    return t.select("conv_id", "node_id", F.when(F.col("node_id") > 1, F.col("node_id") - 1).alias("parent_id"), "role", "text", F.lit(0.0).alias("score"))


def _jumps(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """(level k: nodes with an ancestor 2**k above, and it; hops to the root and score gathered of every node).

    Nodes that have reached their root leave the rounds, so the rows of round k are the nodes
    deeper than 2**k.
    """
    known = nodes.select(F.col("conv_id").alias("c"), F.col("node_id").alias("n")).distinct()
    up = nodes.join(known, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("parent_id") == F.col("n")), "left")
    state = materialise(up.select("conv_id", "node_id", F.col("n").alias("up"), F.when(F.col("n").isNotNull(), 1).otherwise(0).cast("bigint").alias("hops"), F.coalesce("score", F.lit(0.0)).alias("gathered")), "jump")
    rooted, level, levels, total = state.filter("up is null"), state.filter("up is not null"), [], state.count()
    while 2 ** len(levels) <= 2 * max(total, 1) and not level.isEmpty():
        levels.append(level.select("conv_id", "node_id", "up"))
        every = rooted.unionByName(level)
        above = every.select(F.col("conv_id").alias("c"), F.col("node_id").alias("n"), F.col("up").alias("up2"), F.col("hops").alias("hops2"), F.col("gathered").alias("gathered2"))
        joined = level.join(above, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("up") == F.col("n")))
        state = materialise(joined.select("conv_id", "node_id", F.col("up2").alias("up"), (F.col("hops") + F.col("hops2")).alias("hops"), (F.col("gathered") + F.col("gathered2")).alias("gathered")), "jump")
        rooted, level = rooted.unionByName(state.filter("up is null")), state.filter("up is not null")
    return levels, rooted


def paths(messages: DataFrame, branches: int | None = 1) -> DataFrame:
    """conv_id, leaf_id, rank, pos, role, text: turns of the ``branches`` best paths (None: all) of each conversation."""
    nodes = materialise(messages.select("conv_id", "node_id", "parent_id", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), "score"), "nodes")
    levels, rooted = _jumps(nodes)
    parents = nodes.select(F.col("conv_id").alias("c"), F.col("parent_id").alias("p")).filter("p is not null").distinct()
    leaves = rooted.join(parents, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("node_id") == F.col("p")), "left_anti")
    best = Window.partitionBy("conv_id").orderBy(F.desc(F.col("gathered") / (F.col("hops") + 1)), F.desc("hops"), "node_id")
    leaves = leaves.withColumn("rank", F.row_number().over(best))
    if branches is not None:
        leaves = leaves.filter(F.col("rank") <= branches)
    on = leaves.select("conv_id", F.col("node_id").alias("leaf_id"), "rank", F.col("node_id").alias("at"), F.col("hops").alias("pos"))
    for k, level in enumerate(levels):
        jump = level.select(F.col("conv_id").alias("c"), F.col("node_id").alias("n"), "up")
        more = on.join(jump, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("at") == F.col("n")))
        on = on.unionByName(more.select("conv_id", "leaf_id", "rank", F.col("up").alias("at"), (F.col("pos") - 2**k).alias("pos")))
        on = materialise(on, "path")
    text = nodes.select(F.col("conv_id").alias("c"), F.col("node_id").alias("n"), "role", "text")
    return on.join(text, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("at") == F.col("n"))).select("conv_id", "leaf_id", "rank", "pos", "role", "text")


def format_paths(turns: DataFrame) -> DataFrame:
    """conv_id, leaf_id, formatted, loss (spans of assistant texts): one row a path."""
    head = F.concat(F.lit(START), escape(F.col("role")), F.lit(SEP))
    t = turns.withColumn("head", F.length(head)).withColumn("body", escape(F.col("text"))).withColumn("piece", F.concat(head, F.col("body"), F.lit(END)))
    before = Window.partitionBy("conv_id", "leaf_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("begin", F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)))
    t = t.withColumn("span", F.when(F.col("role") == "assistant", F.struct((F.col("begin") + F.col("head")).cast("bigint").alias("start"), F.length("body").cast("bigint").alias("length"))))
    g = t.groupBy("conv_id", "leaf_id").agg(F.sort_array(F.collect_list(F.struct("pos", "piece", "span"))).alias("all"))
    return g.select("conv_id", "leaf_id", F.array_join(F.transform("all", lambda x: x["piece"]), "").alias("formatted"), F.transform(F.filter("all", lambda x: x["span"].isNotNull()), lambda x: x["span"]).cast(SPAN).alias("loss"))


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of role, text."""
    parts = F.filter(F.split(formatted, r"<\|im_end\|>"), lambda x: x != "")
    inner = F.transform(parts, lambda x: F.split(F.substr(x, F.lit(len(START) + 1)), r"<\|im_sep\|>", 2))
    return F.transform(inner, lambda x: F.struct(unescape(x[0]).alias("role"), unescape(x[1]).alias("text")))


def loss_text(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped, in order, nothing between."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


def format_conversations(turns: DataFrame) -> DataFrame:
    """Linear conversations, formatted: conv_id, leaf_id, formatted, loss."""
    return format_paths(paths(chain(turns), branches=None))
