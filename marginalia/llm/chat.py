r"""Reply trees as conversations, and conversations as training text with a loss mask.

Messages point to the message they answer.  Self-joins that double their reach (log2 of the depth) give every
message its root, its depth and the sum of scores above it; branches, one for each message without replies, are
ranked by mean score; chosen branches are spelled out by halving jumps of the same joins.  Texts take no part
until the branches stand, and are joined once.

A turn is written as ``<|turn|>role\ntext<|end|>``.  In roles and texts a backslash is doubled and one is put
behind the first character of every control string, so no control string of any listed template stays in them;
a backslash before any character reads back as that character (a line break in a role has one too).  The loss mask is a list of spans of code points
that hold the escaped texts of the assistant and nothing else.

A branch of more than ``PART`` turns goes on in further rows (``part``), so no row or task gathers a long one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.llm.store import cut
from marginalia.llm.turns import numbered, streamed_sha256

OPEN, CLOSE = "<|turn|>", "<|end|>"
#: Control strings of public chat templates, kept out of texts beside the template's own.
CONTROL = (
    OPEN,
    CLOSE,
    "<s>",
    "</s>",
    "[INST]",
    "[/INST]",
    "<<SYS>>",
    "<</SYS>>",
    "<|im_start|>",
    "<|im_end|>",
    "<|endoftext|>",
    "<|begin_of_text|>",
    "<|eot_id|>",
    "<|start_header_id|>",
    "<|end_header_id|>",
)
PART = 256  # turns of a branch in one row


def _quoted(s: str) -> str:
    return "".join("\\" + c if c in "[]|/\\" else c for c in s)


#: First characters of control strings, with what must follow them.
_CONTROL = "|".join(f"{_quoted(first)}(?={'|'.join(_quoted(c[1:]) for c in CONTROL if c[0] == first)})" for first in sorted({c[0] for c in CONTROL}))


def escaped(text: Column) -> Column:
    """Text without control strings; ``unescaped`` gives it back."""
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), _CONTROL, r"$0\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def reply_paths(messages: DataFrame, branches: int | None = 1) -> DataFrame:
    """Chosen root-to-leaf branches: tree, path (its leaf), rank, pos (from 1), node.

    ``messages``: tree, node, parent (null: a root), score.  A branch's score is the mean of its messages' (null:
    0); ties go to the longer branch, then to the lesser leaf.  ``branches`` best of each tree stay, all if None.
    A parent that is not in the tree makes its reply a root.  Messages on or behind a circle of parents are on no
    branch.  Of rows with one tree and node the one with the greatest (score, parent) is the message.  Null trees
    are one tree; a null node can have no replies and is one message of its tree.
    """
    m = messages.select(
        F.coalesce(F.concat(F.lit("="), F.col("tree").cast("string")), F.lit("")).alias("tree"),
        F.coalesce(F.concat(F.lit("="), F.col("node").cast("string")), F.lit("")).alias("node"),
        F.concat(F.lit("="), F.col("parent").cast("string")).alias("parent"),
        F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"),
    )
    m = m.groupBy("tree", "node").agg(F.max(F.struct("score", "parent")).alias("m")).select("tree", "node", "m.parent", "m.score")
    m = cut(m)
    there = m.select(F.col("tree").alias("t"), F.col("node").alias("up"))
    jump = m.join(there, (F.col("tree") == F.col("t")) & (F.col("parent") == F.col("up")), "left")
    jump = cut(jump.select("tree", "node", "up", F.lit(1).cast("long").alias("n"), "score"))
    jumps, left = [jump], None
    while True:
        now = jump.where("up is not null").count()
        if now in (0, left):  # none left, or only circles
            break
        left = now
        far = jump.select(F.col("tree").alias("t"), F.col("node").alias("via"), F.col("up").alias("far"), F.col("n").alias("m"), F.col("score").alias("s"))
        on = jump.where("up is not null").join(far, (F.col("tree") == F.col("t")) & (F.col("up") == F.col("via")))
        on = on.select("tree", "node", F.col("far").alias("up"), (F.col("n") + F.col("m")).alias("n"), (F.col("score") + F.col("s")).alias("score"))
        jump = cut(on.unionByName(jump.where("up is null")))
        jumps.append(jump)
    answered = jumps[0].where("up is not null").select("tree", F.col("up").alias("node")).distinct()
    leaves = jump.where("up is null").join(answered, ["tree", "node"], "left_anti")
    ranked = _best(leaves.withColumn("mean", F.col("score") / F.col("n")), branches)

    # a branch is its leaf and a length, and enters at the level of that; halves of it start where a jump ends
    ranked = cut(ranked.select("tree", F.col("node").alias("path"), "rank", F.col("node").alias("at"), F.col("n").alias("pos"), F.col("n").alias("left")))
    paths = ranked.where("false")
    for level in reversed(range(len(jumps))):
        half = 1 << level
        way = jumps[level].where("up is not null").select(F.col("tree").alias("t"), F.col("node").alias("n"), "up")
        split = F.array(
            F.struct("at", "pos", F.lit(half).cast("long").alias("left")),
            F.struct(F.col("up").alias("at"), (F.col("pos") - half).alias("pos"), (F.col("left") - half).alias("left")),
        )
        paths = paths.unionByName(ranked.where((F.col("left") > half) & (F.col("left") <= 2 * half)))
        paths = paths.join(way, (F.col("tree") == F.col("t")) & (F.col("at") == F.col("n")) & (F.col("left") > half), "left")
        paths = paths.select("tree", "path", "rank", F.explode(F.when(F.col("left") > half, split).otherwise(F.array(F.struct("at", "pos", "left")))).alias("i"))
        paths = paths.select("tree", "path", "rank", "i.*")
    paths = paths.unionByName(ranked.where("left = 1"))
    return paths.select("tree", "path", "rank", "pos", F.col("at").alias("node"))


def _best(leaves: DataFrame, branches: int | None) -> DataFrame:
    """The best ``branches`` leaves of each tree, one aggregate a rank, so that no tree is sorted in one task.
    All branches keep rank 0: ranking those is left to the reader."""
    if branches is None:
        return leaves.withColumn("rank", F.lit(0))
    best, rest = [], leaves
    for rank in range(1, branches + 1):
        top = rest.groupBy("tree").agg(F.max(F.struct("mean", "n")).alias("top"))
        tied = rest.join(top, "tree").where((F.col("mean") == F.col("top.mean")) & (F.col("n") == F.col("top.n")))
        found = cut(tied.groupBy("tree", "n").agg(F.min("node").alias("node")).withColumn("rank", F.lit(rank)))
        best.append(found)
        rest = rest.join(found.select("tree", "node"), ["tree", "node"], "left_anti")
    return reduce(DataFrame.unionByName, best).select("tree", "node", "n", "rank")


def formatted(turns: DataFrame, keys: list[str], pos: str = "pos", role: str = "role", text: str = "text", learnt: str = "assistant") -> DataFrame:
    """keys, part (from 0), formatted, loss (start and end of spans in code points of ``formatted``): turns of each
    key by ``pos`` as training text.  Null role or text is empty."""
    r, t = (escaped(F.coalesce(F.col(c), F.lit(""))) for c in (role, text))
    head = F.concat(F.lit(OPEN), F.replace(r, F.lit("\n"), F.lit("\\\n")), F.lit("\n"))
    # escaped once: below, each stands in several places
    turns = turns.select(*keys, F.col(pos).alias("_pos"), (F.col(role) == learnt).alias("_learn"), F.explode(F.array(F.struct(head.alias("head"), t.alias("body")))).alias("_e"))
    head, t, pos = F.col("_e.head"), F.col("_e.body"), "_pos"
    piece = F.struct(F.col(pos).alias("p"), F.concat(head, t, F.lit(CLOSE)).alias("piece"), F.length(head).alias("a"), F.length(t).alias("n"), F.col("_learn").alias("learn"))
    rows = turns.withColumn("part", F.floor((F.col(pos) - 1) / PART).cast("long")).groupBy(*keys, "part").agg(F.array_sort(F.collect_list(piece)).alias("s"))
    # where each piece starts: a fold over at most PART pieces
    starts = F.aggregate("s", F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + F.length(x["piece"]))))
    spans = F.transform(F.arrays_zip("s", "starts"), lambda z: F.struct((z["starts"] + z["s"]["a"]).alias("start"), (z["starts"] + z["s"]["a"] + z["s"]["n"]).alias("end"), F.coalesce(z["s"]["learn"], F.lit(False)).alias("learn")))
    rows = rows.withColumn("starts", F.slice(starts, 1, F.size("s")))
    return rows.select(
        *keys,
        "part",
        F.array_join(F.transform("s", lambda x: x["piece"]), "").alias("formatted"),
        F.transform(F.filter(spans, lambda x: x["learn"]), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))).alias("loss"),
    )


def read_back(rows: DataFrame) -> DataFrame:
    """``formatted`` rows with turns (array of role and text) and loss_text, both read from the written text."""
    bodies = F.filter(F.split("formatted", _quoted(CLOSE)), lambda x: x != "")
    # the first line break that no backslash escapes ends the role
    head = r"(?s)^" + _quoted(OPEN) + r"((?:[^\\\n]++|\\.)*+)\n"
    turns = F.transform(
        bodies,
        lambda x: F.struct(
            unescaped(F.regexp_extract(x, head, 1)).alias("role"),
            unescaped(F.regexp_replace(x, head, "")).alias("text"),
        ),
    )
    masked = F.transform("loss", lambda s: unescaped(F.substring(F.col("formatted"), s["start"] + 1, s["end"] - s["start"])))
    return rows.withColumn("turns", turns).withColumn("loss_text", F.array_join(masked, ""))


def chat(conversations: DataFrame) -> DataFrame:
    """conv_id, part, formatted, loss: every conversation (conv_id, turn, role, text) as a reply tree of one branch,
    in which each turn answers the one before, formatted.

    Turns are ordered by number, null first (ties by role, then text); null role or text is empty; rows alike are
    turns of their own; rows of null conv_id are one conversation.  An empty table gives an empty one.  Other
    columns are not read, whatever their names.
    """
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    rows = numbered(rows, "conv_id", ["turn", "role", "text"])
    above = F.when(F.col("pos") > 1, F.col("pos") - 1)
    paths = reply_paths(rows.select(F.col("conv_id").alias("tree"), F.col("pos").alias("node"), above.alias("parent"), F.lit(0.0).alias("score")))
    keyed = rows.withColumns({"tree": F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")), "node": F.concat(F.lit("="), F.col("pos").cast("string"))}).drop("pos")
    return formatted(paths.join(keyed, ["tree", "node"]), ["tree", "conv_id"]).drop("tree")


def digest(rows: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of what ``read_back`` reads."""
    back = read_back(rows).select(
        "conv_id",
        "part",
        F.size("turns").alias("n"),
        F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("turns_sha256"),
        F.length("loss_text").alias("loss_chars"),
        F.col("loss_text").alias("loss_sha256"),
        F.length("formatted").alias("formatted_chars"),
    )
    back = cut(back)
    key = F.coalesce(F.col("conv_id").cast("string"), F.lit(""))
    hashes = streamed_sha256(back, key, "part", ["turns_sha256", "loss_sha256"])
    sums = back.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.sum("loss_chars").alias("loss_chars"), F.sum("formatted_chars").alias("formatted_chars"))
    return sums.join(hashes, key == F.col("_key")).select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
