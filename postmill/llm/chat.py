"""Chat formatting: reply trees to root-to-leaf conversations in one template, with a loss mask."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postmill.session import cut

# The template: <s> then, per turn, <|role|>text</s>. Inside roles and texts the first character of every
# control string is written as a reference, so no text can open or close a turn; `&` makes it reversible.
START, TURN, CLOSE, END = "<s>", "<|", "|>", "</s>"
REFERENCES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&lsqb;"), ("|", "&vert;"))


def escape(text: Column) -> Column:
    for plain, reference in REFERENCES:
        text = F.replace(text, F.lit(plain), F.lit(reference))
    return text


def unescape(text: Column) -> Column:
    for plain, reference in reversed(REFERENCES):
        text = F.replace(text, F.lit(reference), F.lit(plain))
    return text


def linear_messages(turns: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Rows by turn as a tree table (tree, node, parent, role, text, score): each row answers the one before.

    Order is turn (null first), role, text; repeated rows stand as turns of their own. Null roles and texts
    are empty. A null conversation id is one conversation. Other columns are ignored.
    """
    by = Window.partitionBy("tree").orderBy("turn", "role", "text")
    return (
        turns.select(
            F.col(conv).alias("tree"),
            F.col(turn).alias("turn"),
            F.coalesce(F.col("role"), F.lit("")).alias("role"),
            F.coalesce(F.col("text"), F.lit("")).alias("text"),
        )
        .withColumn("node", F.row_number().over(by).cast("long"))
        .select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text")
        .withColumn("score", F.lit(1.0))
    )


def best_paths(messages: DataFrame, branches: int | None = 1) -> DataFrame:
    """(tree, branch, leaf, place, node) of the `branches` best root-to-leaf paths of each tree (None: all).

    A branch's score is the sum over its path (null: 0); ties go to the longer path, then the smaller leaf.
    Self-joins double the hop in every round: after round r a node knows its ancestor 2^r above and the
    score and length up to there, so depth d takes log2(d) rounds. Only ids travel; texts stay behind.
    Nodes whose parent is null or missing are roots; a cycle has no leaf and so gives no path.
    """
    nodes = cut(messages.select("tree", "node", "parent", F.coalesce(F.col("score"), F.lit(0.0)).alias("score")))
    known = nodes.select("tree", F.col("node").alias("parent")).distinct()
    n, k = nodes.alias("n"), known.alias("k")
    matched = F.expr("n.tree <=> k.tree AND n.parent = k.parent")
    hop = cut(
        n.join(k, matched, "left").select("n.tree", "n.node", F.col("k.parent").alias("up"), "n.score", F.lit(1).alias("length"))
    )
    hops = [hop]
    limit = None
    while not hop.filter("up IS NOT NULL").isEmpty():
        if limit is None:
            limit = nodes.groupBy("tree").count().agg(F.max("count")).first()[0]
        if 2 ** (len(hops) - 1) > limit:  # only cycles have ancestors beyond the number of nodes
            break
        a, b = hop.alias("a"), hop.alias("b")
        hop = cut(
            a.join(b, F.expr("a.tree <=> b.tree AND a.up = b.node"), "left").select(
                "a.tree", "a.node", F.col("b.up").alias("up"),
                (F.col("a.score") + F.coalesce("b.score", F.lit(0.0))).alias("score"),
                (F.col("a.length") + F.coalesce("b.length", F.lit(0))).alias("length"),
            )
        )
        hops.append(hop)
    done = hop.filter("up IS NULL").alias("d")
    inner = nodes.select("tree", "parent").distinct().alias("p")
    leaves = done.join(inner, F.expr("d.tree <=> p.tree AND d.node = p.parent"), "left_anti")
    rank = Window.partitionBy("tree").orderBy(F.desc("score"), F.desc("length"), "node")
    chosen = leaves.withColumn("branch", F.row_number().over(rank))
    if branches is not None:
        chosen = chosen.filter(F.col("branch") <= branches)
    path = cut(chosen.select("tree", "branch", F.col("node").alias("leaf"), "length", "node", F.lit(0).alias("above")))
    for r, step in enumerate(hops):
        p, s = path.alias("p"), step.filter("up IS NOT NULL").alias("s")
        own = F.struct("p.node", "p.above")
        up = F.struct(F.col("s.up").alias("node"), (F.col("p.above") + 2**r).alias("above"))
        path = cut(p.join(s, F.expr("p.tree <=> s.tree AND p.node = s.node"), "left").select(
            "p.tree", "p.branch", "p.leaf", "p.length", F.inline(F.when(F.col("s.up").isNull(), F.array(own)).otherwise(F.array(own, up)))
        ))
    return path.select("tree", "branch", "leaf", (F.col("length") - F.col("above")).alias("place"), "node")


def format_paths(messages: DataFrame, paths: DataFrame) -> DataFrame:
    """One row per path: tree, branch, n_turns, formatted, loss_spans (start, length in code points).

    The spans cover the escaped texts of assistant turns and nothing else.
    """
    m, p = messages.alias("m"), paths.alias("p")
    turns = p.join(m, F.expr("p.tree <=> m.tree AND p.node = m.node")).select(
        "p.tree", "p.branch",
        F.struct("p.place", escape(F.col("m.role")).alias("role"), escape(F.col("m.text")).alias("text"), F.col("m.role").alias("own")).alias("t"),
    )
    grouped = turns.groupBy("tree", "branch").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    head = len(TURN) + len(CLOSE)
    folded = F.aggregate(
        "turns",
        F.struct(F.lit(len(START)).alias("at"), F.expr("CAST(array() AS array<struct<start:int,length:int>>)").alias("spans")),
        lambda acc, t: F.struct(
            (acc["at"] + head + F.length(t["role"]) + F.length(t["text"]) + len(END)).alias("at"),
            F.when(
                (t["own"] == "assistant") & (t["text"] != ""),
                F.concat(acc["spans"], F.array(F.struct((acc["at"] + head + F.length(t["role"])).alias("start"), F.length(t["text"]).alias("length")))),
            ).otherwise(acc["spans"]).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    pieces = F.transform("turns", lambda t: F.concat(F.lit(TURN), t["role"], F.lit(CLOSE), t["text"], F.lit(END)))
    return grouped.select(
        "tree", "branch", F.size("turns").cast("long").alias("n_turns"),
        F.concat(F.lit(START), F.array_join(pieces, "")).alias("formatted"), folded.alias("loss_spans"),
    )


def format_chats(messages: DataFrame, branches: int | None = 1) -> DataFrame:
    """Reply trees (tree, node, parent, role, text, score) to formatted conversations; see `best_paths`.

    An empty table gives no rows. (tree, node) must be unique; `linear_messages` makes it so.
    """
    return format_paths(messages, best_paths(messages, branches))


def parse_turns(formatted: Column) -> Column:
    """Array of (role, text) read back from the template."""
    body = F.substr(formatted, F.lit(len(START) + 1))
    pieces = F.filter(F.split(body, END), lambda x: x != "")
    return F.transform(
        pieces,
        lambda x: F.struct(
            unescape(F.substring_index(F.substr(x, F.lit(len(TURN) + 1)), CLOSE, 1)).alias("role"),
            unescape(F.substr(x, F.position(F.lit(CLOSE), x) + len(CLOSE))).alias("text"),
        ),
    )


def masked_text(formatted: Column, spans: Column) -> Column:
    """Unescaped text under the mask, in order."""
    parts = F.transform(spans, lambda s: F.substr(formatted, s["start"] + 1, s["length"]))
    return unescape(F.array_join(parts, ""))
