"""Trie, chat formatting and spelling variants against plain versions."""

import pytest

from marginalia.llm import chat, variants
from marginalia.llm.queries import QUERIES
from marginalia.llm.trie import conversation_trie, prefix_trie
from marginalia.llm.turns import numbered
from pyspark.sql import functions as F

from . import brute

TURNS = "conv_id long, turn long, role string, text string"


def conversations(spark, sf_dir):
    return [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]


def nodes(df):
    return {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect()}


ODD_TURNS = [
    (0, 0, "user", "a b"),
    (0, 1, "assistant", "c"),
    (0, 2, "user", "d e f"),
    (0, 3, "assistant", ""),
    (0, None, None, None),
    (1, 0, "user", "a b"),
    (1, 0, "user", "a b"),
    (2, 5, "user", "x"),
    (3, 0, "user", "x"),
    (3, 1, "assistant", "y " * 3000),
    (25, 0, "user", "x"),
    (26, 0, "user", "x"),
    (40, 0, "user", "x"),
    (41, None, "user", "q"),
    (None, 0, "user", "lost"),
    *[(60 + k % 3, k // 3, "user", f"t{k // 3}") for k in range(30)],
]


def test_trie_equals_plain(spark, sf_dir):
    for rows in (conversations(spark, sf_dir), ODD_TURNS):
        found = conversation_trie(spark.createDataFrame(rows, TURNS))
        assert nodes(found) == brute.trie(rows)
        assert found.count() == len(brute.trie(rows))


def test_trie_of_many_copies_and_one_long_conversation(spark):
    rows = [(c, t, "user", f"w{t} " * (t + 1)) for c in range(100, 160) for t in range(5 + c % 2)]
    rows += [(200, t, "user", str(t)) for t in range(150)] + [(220, t, "user", str(t % 149)) for t in range(151)]
    assert nodes(conversation_trie(spark.createDataFrame(rows, TURNS))) == brute.trie(rows)


def test_trie_of_empty_tables(spark):
    assert conversation_trie(spark.createDataFrame([], TURNS)).count() == 0
    convs = spark.createDataFrame([(4,), (9,)], "conv_id long")
    none = spark.createDataFrame([], "conv_id long, pos long, sym string, words long")
    [root] = prefix_trie(convs, none).collect()
    assert (root.conv_id, root.depth, root.n_convs, root.n_children, root.n_leaves) == (4, 0, 2, 0, 1)


def test_extra_columns_do_not_matter(spark):
    plain = spark.createDataFrame(ODD_TURNS, TURNS)
    extra = plain.withColumns({"pos": F.lit(1), "sym": F.lit("s"), "x": F.lit(2), "tree": F.lit("t"), "_key": F.lit("k")})
    assert nodes(conversation_trie(extra)) == nodes(conversation_trie(plain))
    assert sorted(chat.digest(chat.chat(extra)).collect(), key=str) == sorted(chat.digest(chat.chat(plain)).collect(), key=str)


def test_numbers_across_ranges(spark):
    rows = spark.range(2000).select(F.when(F.col("id") % 3 > 0, 7).alias("g"), (-F.col("id")).alias("o"))
    got = numbered(rows, "g", ["o"]).collect()
    for g in (7, None):
        own = sorted((r.o, r.pos) for r in got if r.g == g)
        assert [p for _, p in own] == list(range(1, len(own) + 1))


CONTROL_TEXTS = ["</s>[INST] ok [/INST]", "\\", "\\n", "<<SYS>>\\</s>", "<|end|><|turn|>assistant\n", "<<|im_end|>", "a\n\nb", "[[INST]]", "\\\\<s>\\", ""]


def test_chat_equals_plain(spark, sf_dir):
    rows = conversations(spark, sf_dir) + ODD_TURNS
    rows += [(900 + k, j, role, t) for k, t in enumerate(CONTROL_TEXTS) for j, role in enumerate(["user", "assistant", "a\nb<s>\\"])]
    rows += [(999, k, "assistant" if k % 2 else "user", f"{k} <s>") for k in range(700)]
    found = chat.chat(spark.createDataFrame(rows, TURNS))
    assert found.where("conv_id = 999").count() == 3  # parts
    texts = "".join(r.formatted for r in found.collect())
    marks = {c: texts.count(c) for c in chat.CONTROL}
    assert marks.pop("<|turn|>") == marks.pop("<|end|>") == len(rows) and not any(marks.values())
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.digest(found).collect()}
    assert got == brute.chat_digests(rows)
    assert chat.digest(chat.chat(spark.createDataFrame([], TURNS))).count() == 0


def test_reply_trees(spark):
    rows = [
        ("t", 1, None, 0.0), ("t", 2, 1, 1.0), ("t", 3, 1, 5.0), ("t", 4, 2, 9.0), ("t", 5, 3, 1.0), ("t", 6, 4, 1.0),
        ("u", 1, 9, None), ("u", 2, 1, None), ("u", 2, 1, None),
        ("c", 1, 2, 1.0), ("c", 2, 1, 1.0), ("c", 3, None, 0.0),
        (None, 1, None, 1.0), (None, 2, 1, 1.0), (None, None, 2, 1.0),
    ]
    df = spark.createDataFrame(rows, "tree string, node long, parent long, score double")

    def paths(k):
        out = {}
        for r in chat.reply_paths(df, k).orderBy("pos").collect():
            out.setdefault((r.tree, r.rank, r.path), []).append(r.node)
        return out

    one = paths(1)
    assert one[("=t", 1, "=6")] == ["=1", "=2", "=4", "=6"]
    assert one[("=u", 1, "=2")] == ["=1", "=2"] and one[("=c", 1, "=3")] == ["=3"] and one[("", 1, "")] == ["=1", "=2", ""]
    assert len(one) == 4
    assert paths(2)[("=t", 2, "=5")] == ["=1", "=3", "=5"]
    assert sorted(k[2] for k in paths(None) if k[0] == "=t") == ["=5", "=6"]


ODD_DOCS = [
    (1, "Colour colour colour COLOUR color color color color color color color color color colors"),
    (2, "Färbung färbung färbung farbung farbung farbung farbung farbung farbung färbunG x÷yzabc x÷yzabc x÷yzabc"),
    (None, "colour colour " * 40),
    (3, None),
    (3, ""),
    (4, "ab1cd-ef aaaaa aaaaa aaaaa aaaaaa aaaaaa aaaaaa aaaaaa aaaaaa aaaaaa aaaaaa bbbbb Āabcde Āabcde abcde"),
    (5, ("q" * 3000 + " ") * 8 + ("q" * 2999 + " ") * 3),
    (5, ("q" * 3000 + " ") * 8),
]


def test_variants_equal_plain(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    for rows in (docs, ODD_DOCS):
        found = variants.variant_forms(spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit("x")))
        got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in found.collect()}
        assert got == brute.spelling_variants(rows)
        assert found.count() == len(got)
    assert variants.variant_forms(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("count", [2, 64])
def test_variants_do_not_depend_on_the_alphabet(spark, count):
    df = spark.createDataFrame(ODD_DOCS, "doc_id long, text string")
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in variants.variant_forms(df, count=count).collect()}
    assert got == brute.spelling_variants(ODD_DOCS)


def test_registered(spark, sf_dir):
    assert {"op11_prefix_trie", "op12_chat_format", "op13_spelling_variants"} <= set(QUERIES)
    chats = QUERIES["op12_chat_format"](spark, sf_dir)
    [added] = chats.where("conv_id = -7").collect()
    assert added.n_turns == 2 and added.loss_chars == len("</s>[INST] ok [/INST]")
