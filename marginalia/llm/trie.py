"""Prefix trie of conversations by van Emde Boas recursion.

A problem is a set of turn sequences under one root node.  It is cut at half depth: sequences that reach the
cut are grouped by the turns of their upper half, and the group's name (its least conversation) becomes a node.
Of each group one sequence goes on in the upper problem; every sequence that goes beyond the cut goes on in a
lower problem whose root is that node.  All upper tries and lower forests of one level are cut in one Spark
job, so a trie of depth d takes log2(d) levels, and each place of a sequence is held once at a level.

Totals are grafted upward by the same cuts: a block's total joins the total of the block above it through the
cut node, doubling the height, and then whole totals below every cut node are handed to the nodes half a block
above.  Nothing is sent to each of its ancestors.

A row is a turn, never a conversation, so a conversation of any length is spread over tasks.  Groups are made
by combinable aggregates and joins whose one side is unique.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.llm.store import cut, word_count
from marginalia.llm.turns import ids_sha256, numbered


def turn_rows(conversations: DataFrame) -> DataFrame:
    """conv_id, pos, sym, words: turns by number, null first (ties by role, then a hash of role and text).  A turn
    is known by a hash of its role and text; null role or text is empty.  Rows without a conv_id take no part."""
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).where("conv_id is not null")
    rows = rows.select("conv_id", "turn", "role", F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256).alias("sym"), word_count(F.col("text")).alias("words"))
    return numbered(rows, "conv_id", ["turn", "role", "sym"]).select("conv_id", "pos", "sym", "words")


def with_common_start(turns: DataFrame, group: int = 20, most: int = 3) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt to share starts: conversation c takes the first h = crc32(c) % 4 turns of c - c % 20,
    then its own turns after its first h.  Returns all conv_ids, and the rebuilt turns."""
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(most + 1))
    convs = turns.select("conv_id").distinct().select("conv_id", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % group).alias("base"))
    heads = turns.where((F.col("conv_id") % group == 0) & (F.col("pos") <= most)).select(F.col("conv_id").alias("base"), "pos", "sym", "words")
    taken = convs.join(heads, "base").where("pos <= h").select("conv_id", "pos", "sym", "words")
    shift = convs.join(taken.groupBy("conv_id").agg(F.count("*").alias("p")), "conv_id", "left").select("conv_id", "h", F.coalesce("p", F.lit(0)).alias("p"))
    own = turns.join(shift, "conv_id").where("pos > h").select("conv_id", (F.col("pos") - F.col("h") + F.col("p")).alias("pos"), "sym", "words")
    return convs.select("conv_id"), own.unionByName(taken)


_ADDED = ["n_leaves", "saved_tokens"]


def _sums() -> list[Column]:
    return [F.sum(c).alias(c) for c in _ADDED]


def prefix_trie(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """Nodes of the trie of ``turns`` (conv_id, pos from 1 without gaps, sym, words) of all ``convs``: conv_id (least
    member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Conversations without turns end at the root.  Equal conversations are one sequence that counts several times.
    Without conversations there is no node.
    """
    turns = cut(turns.select("conv_id", "pos", "words", F.xxhash64("sym", "pos").alias("x"), F.xxhash64("pos", F.lit(7), "sym").alias("y")))
    whole = turns.groupBy("conv_id").agg(F.max("pos").alias("len"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"))
    whole = convs.join(whole, "conv_id", "left").select("conv_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("len", "x", "y")])
    whole = cut(whole)
    classes = cut(whole.groupBy("len", "x", "y").agg(F.min("conv_id").alias("rep"), F.count("*").alias("weight")))
    longest, first = classes.agg(F.max("len"), F.min("rep")).first()
    if first is None:
        return convs.sparkSession.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    levels = int(longest).bit_length()  # the first problem is 2**levels deep, deeper than any sequence

    # only one of equal sequences goes on; every depth is the cut of one level
    turns = turns.join(classes.select(F.col("rep").alias("conv_id"), "len"), "conv_id")
    deep = F.length(F.bin("len")) - 1  # no block is deeper than its sequence
    blocks = turns.select("conv_id", "pos", "len", "x", "y", F.explode(F.sequence(F.lit(0), deep)).alias("level")).withColumn("cut", F.expr("shiftleft(shiftright(pos - 1, level) + 1, level)"))
    blocks = blocks.where("cut <= len and shiftright(cut, level) % 2 = 1").groupBy("level", "conv_id", "cut").agg(F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"))
    blocks = cut(blocks)

    strands = classes.where("len > 0").select(F.col("rep").alias("owner"), F.lit(0).cast("long").alias("base"), F.col("len").alias("end"), F.lit(first).cast("long").alias("root"), "weight", F.lit(True).alias("tail"))
    named: dict[int, DataFrame] = {}
    for level in reversed(range(levels)):
        half = 1 << level
        strands = strands.withColumn("cut", F.col("base") + half)
        here = blocks.where(F.col("level") == level).select(F.col("conv_id").alias("owner"), "cut", "x", "y")
        full = strands.where("end >= cut").join(here, ["owner", "cut"])
        group = full.groupBy("root", "cut", "x", "y").agg(F.min("owner").alias("name"), F.sum("weight").alias("all"))
        full = full.join(group, ["root", "cut", "x", "y"]).drop("x", "y")
        short = strands.where("end < cut").withColumns({"name": F.lit(None).cast("long"), "all": F.lit(None).cast("long")})
        named[level] = cut(full.unionByName(short))
        upper = F.struct("owner", "base", F.col("cut").alias("end"), "root", F.col("all").alias("weight"), F.lit(False).alias("tail"))
        lower = F.struct("owner", F.col("cut").alias("base"), "end", F.col("name").alias("root"), "weight", "tail")
        same = F.struct("owner", "base", "end", "root", "weight", "tail")
        parts = F.when(F.col("name").isNull(), F.array(same)).otherwise(
            F.array_compact(F.array(F.when(F.col("owner") == F.col("name"), upper), F.when(F.col("end") > F.col("cut"), lower)))
        )
        strands = named[level].select(F.explode(parts).alias("s")).select("s.*")

    # strands one turn long are the nodes
    nodes = strands.join(turns.select(F.col("conv_id").alias("owner"), F.col("pos").alias("end"), "words"), ["owner", "end"])
    nodes = nodes.select(F.col("owner").alias("conv_id"), F.col("end").alias("depth"), F.col("root").alias("parent_conv_id"), F.col("weight").alias("n_convs"), "words")
    top = classes.agg(F.lit(first).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), F.sum("weight").alias("n_convs"), F.lit(0).cast("long").alias("words"))
    nodes = cut(nodes.unionByName(top))
    children = nodes.where("depth > 0").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, ["conv_id", "depth"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    own = {"n_leaves": (F.col("n_children") == 0).cast("long"), "saved_tokens": (F.col("n_convs") - 1) * F.col("words")}
    nodes = cut(nodes.withColumns(own))

    below = _grafted(nodes, named, levels)
    nodes = nodes.join(below.select("conv_id", "depth", *[F.col(c).alias(f"_{c}") for c in _ADDED]), ["conv_id", "depth"], "left")
    nodes = nodes.withColumns({c: F.col(c) + F.coalesce(f"_{c}", F.lit(0)) for c in _ADDED})

    at_end = [named[k].where("tail and end = cut").select(F.col("owner").alias("rep"), F.col("name").alias("node"), F.col("cut").alias("depth")) for k in named]
    ends = classes.where("len = 0").select("rep", F.lit(first).cast("long").alias("node"), F.col("len").alias("depth"))
    for e in at_end:
        ends = ends.unionByName(e)
    member = whole.join(classes.select("len", "x", "y", "rep"), ["len", "x", "y"]).select("conv_id", "rep")
    key = F.concat(F.col("node").cast("string"), F.lit("/"), F.col("depth").cast("string"))
    hashes = ids_sha256(member.join(ends, "rep"), key, "conv_id")
    nodes = nodes.join(hashes, F.concat(F.col("conv_id").cast("string"), F.lit("/"), F.col("depth").cast("string")) == F.col("_key"), "left")
    counts = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", *_ADDED]
    return nodes.select(*[F.col(c).cast("long").alias(c) for c in counts], F.coalesce("_ids", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


def _grafted(nodes: DataFrame, named: dict[int, DataFrame], levels: int) -> DataFrame:
    """conv_id, depth and sums over all nodes strictly below; nodes with nothing below may be left out."""
    # upward: what stands in the block of 2**level turns below each node at a multiple of that depth
    block = {0: cut(nodes.where("depth > 0").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(*_sums()))}
    for level in range(levels):
        half, low = 1 << level, block[level]
        cuts = named[level].where("owner = name").select(F.col("owner").alias("conv_id"), F.col("cut").alias("depth"), "root")
        lifted = low.where(F.col("depth") % (2 * half) == half).join(cuts, ["conv_id", "depth"])
        lifted = lifted.select(F.col("root").alias("conv_id"), (F.col("depth") - half).alias("depth"), *_ADDED)
        same = low.where(F.col("depth") % (2 * half) == 0).select("conv_id", "depth", *_ADDED)
        block[level + 1] = cut(same.unionByName(lifted).groupBy("conv_id", "depth").agg(*_sums()))
    # downward: whole totals of cut nodes go to the nodes half a block above them
    total = block[levels]
    parts = [total]
    for level in reversed(range(levels)):
        half = 1 << level
        ways = named[level].where("name is not null").select(F.col("owner").alias("conv_id"), (F.col("cut") + half).alias("depth"), F.col("name"))
        handed = total.join(ways, ["conv_id", "depth"]).select(F.col("name").alias("conv_id"), (F.col("depth") - half).alias("depth"), *_ADDED)
        own = block[level].where(F.col("depth") % (2 * half) == half).select("conv_id", "depth", *_ADDED)
        part = cut(own.unionByName(handed).groupBy("conv_id", "depth").agg(*_sums()))
        parts.append(part)
        total = total.unionByName(part)
    for p in parts[1:]:
        parts[0] = parts[0].unionByName(p)
    return parts[0]


def conversation_trie(conversations: DataFrame, group: int = 20, most: int = 3) -> DataFrame:
    """``prefix_trie`` of conversations (conv_id, turn, role, text) rebuilt by ``with_common_start``.

    Turns are ordered by number, null first; null role or text is empty; rows alike are turns of their own; rows
    without a conv_id take no part.  Texts are only hashed and counted, whatever their length.  An empty table
    gives an empty one.  Other columns are not read, whatever their names.
    """
    convs, turns = with_common_start(turn_rows(conversations), group, most)
    return prefix_trie(convs, turns)
