"""Chat formatting of reply trees; DataFrame functions only.

Messages form trees through their parents.  Self-joins that double the distance
each time give every message its root and depth in logarithmically many rounds,
leaves are ranked by the mean score of their path, and the paths of the chosen
leaves are laid out by the same doubled links.  Each path becomes one string:

    <|im_start|>role\\ntext<|im_end|>\\n<|im_start|>...

Control strings inside texts can't be mistaken for the template's: a backslash is
doubled and "<|" becomes "<\\|"; in roles a line feed is escaped as well.  Reading
back drops the backslashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plinth.llm.common import cut

START, END = "<|im_start|>", "<|im_end|>\n"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def replies(turns: DataFrame) -> DataFrame:
    """Trees (node_id, parent_id, score) from rows (conv_id, turn, role, text) in order of turn: each replies to the one before.

    Ties of turn go by role and text; a null turn comes first, null conv_ids are one conversation.
    """
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    node = F.row_number().over(order).cast("long")
    return turns.select(F.col("conv_id").alias("tree_id"), node.alias("node_id"), F.when(node > 1, node - 1).alias("parent_id"), F.lit(0.0).alias("score"), "role", "text")


def paths(tree: DataFrame, best: int = 1) -> DataFrame:
    """(tree_id, rank, pos, node_id): the messages from root to leaf of each tree's `best` branches.

    tree: tree_id, node_id, parent_id, score.  A branch ranks by the mean score on
    its path (null: 0), then by the smaller leaf.  A message whose parent is not in
    its tree is a root.  Repeated (tree_id, node_id) rows count once.  Messages on
    a cycle have no root and are on no path.
    """
    one = tree.groupBy("tree_id", "node_id").agg(F.min("parent_id").alias("parent_id"), F.max(F.coalesce("score", F.lit(0.0))).alias("score")).filter("node_id is not null")
    # A null tree_id is a tree of its own: joins go by a key that is never null.
    one = cut(one.withColumn("key", F.coalesce(F.concat(F.lit("="), F.col("tree_id").cast("string")), F.lit("-"))))
    parents = one.select(F.col("key").alias("k"), F.col("node_id").alias("up"))
    links = one.join(parents, (F.col("key") == F.col("k")) & (F.col("parent_id") == F.col("up")), "left").select("key", "tree_id", "node_id", "up", "score")
    # jump[i] leads 2**i messages up; total and steps sum the path so far, up to the root.
    jump = cut(links.select("key", "node_id", "up", F.col("score").alias("total"), F.lit(1).cast("long").alias("steps")))
    jumps = []
    rows = jump.count()
    while (open_now := jump.filter("up is not null").count()) and 2 ** len(jumps) < rows:
        going = jump.filter("up is not null")
        jumps.append(going.select("key", "node_id", "up"))
        far = jump.select(F.col("key").alias("k"), F.col("node_id").alias("n"), F.col("up").alias("u"), F.col("total").alias("t"), F.col("steps").alias("s"))
        further = going.join(far, (F.col("key") == F.col("k")) & (F.col("up") == F.col("n"))).select("key", "node_id", F.col("u").alias("up"), (F.col("total") + F.col("t")).alias("total"), (F.col("steps") + F.col("s")).alias("steps"))
        # Messages that have reached their root are not joined again.
        jump = cut(jump.filter("up is null").unionByName(further))
    rooted = jump.filter("up is null") if open_now else jump
    inner = links.filter("up is not null").select("key", F.col("up").alias("node_id")).distinct()
    leaves = rooted.join(inner, ["key", "node_id"], "left_anti")
    order = Window.partitionBy("key").orderBy(F.desc(F.col("total") / F.col("steps")), "node_id")
    chosen = leaves.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= best)
    # Every message `d` above the leaf, for all d, by the binary digits of d.
    path = chosen.select("key", "rank", "steps", "node_id", F.lit(0).cast("long").alias("above"))
    for i in reversed(range(len(jumps))):
        up = jumps[i].select(F.col("key").alias("k"), F.col("node_id").alias("n"), "up")
        further = path.join(up, (F.col("key") == F.col("k")) & (F.col("node_id") == F.col("n"))).select("key", "rank", "steps", F.col("up").alias("node_id"), (F.col("above") + 2**i).alias("above"))
        path = cut(path.unionByName(further))
    trees = one.select("key", "tree_id", "node_id")
    return path.join(trees, ["key", "node_id"]).select("key", "tree_id", "rank", (F.col("steps") - F.col("above")).alias("pos"), "node_id")


def formatted(tree: DataFrame, best: int = 1) -> DataFrame:
    """(tree_id, rank, formatted, loss): one string for each chosen branch, and the spans of it that carry loss.

    tree: tree_id, node_id, parent_id, score, role, text; a null role or text is
    empty.  loss: array of struct(start, length) in code points, zero-based, one
    span for the text of each message whose role is "assistant".  An empty table
    gives no rows; other columns are ignored.
    """
    role = F.replace(escaped(F.coalesce("role", F.lit(""))), F.lit("\n"), F.lit("\\\n"))
    said = tree.select(F.coalesce(F.concat(F.lit("="), F.col("tree_id").cast("string")), F.lit("-")).alias("key"), "node_id", F.concat(F.lit(START), role, F.lit("\n")).alias("head"), escaped(F.coalesce("text", F.lit(""))).alias("body"), F.coalesce(F.col("role") == "assistant", F.lit(False)).alias("learn"))
    said = said.groupBy("key", "node_id").agg(F.min(F.struct("head", "body", "learn")).alias("m"))
    turns = paths(tree, best).join(said, ["key", "node_id"]).select("key", "tree_id", "rank", F.struct("pos", "m.*").alias("m"))
    whole = turns.groupBy("key", "tree_id", "rank").agg(F.sort_array(F.collect_list("m")).alias("ms"))
    text = F.array_join(F.transform("ms", lambda m: F.concat(m["head"], m["body"], F.lit(END))), "")
    spans = F.aggregate(
        "ms", F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans")),
        lambda acc, m: F.struct(
            (acc["at"] + F.length(m["head"]) + F.length(m["body"]) + len(END)).alias("at"),
            F.when(m["learn"], F.concat(acc["spans"], F.array(F.struct((acc["at"] + F.length(m["head"])).alias("start"), F.length(m["body"]).cast("long").alias("length"))))).otherwise(acc["spans"]).alias("spans"),
        ),
    )["spans"]
    return whole.select("tree_id", "rank", text.alias("formatted"), spans.alias("loss"))


def read_back(conversations: DataFrame) -> DataFrame:
    """(tree_id, rank, turns, learned, chars) from formatted strings alone: turns as struct(role, text), the text under the loss mask, code points."""
    # Splitting at the end mark leaves an empty piece after the last.
    parts = F.split("formatted", r"<\|im_end\|>\n")
    pieces = F.slice(parts, 1, F.size(parts) - 1)
    head = r"(?s)\A<\|im_start\|>((?:[^\\\n]++|\\.)*+)\n(.*)\z"
    turns = F.transform(pieces, lambda p: F.struct(unescaped(F.regexp_extract(p, head, 1)).alias("role"), unescaped(F.regexp_extract(p, head, 2)).alias("text")))
    learned = F.array_join(F.transform("loss", lambda s: unescaped(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
    return conversations.select("tree_id", "rank", turns.alias("turns"), learned.alias("learned"), F.length("formatted").cast("long").alias("chars"))
