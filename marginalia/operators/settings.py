"""Users' settings kept as logs of changes: muted rules, dictionaries, and the configuration they come to."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RULE_ID = r"^[A-Z]{1,4}[0-9]{1,4}$"
MOST_RULES, MOST_WORDS = 200, 5000
DEFAULTS = {"show_preferences": False, "locale": "en-US", "mode": "revise", "document_type": "auto"}


def disabled_rules(log: DataFrame) -> DataFrame:
    """log (user_id, rule_id, muted boolean, at) -> (user_id, disabled_rules, valid).  A rule that is muted
    again keeps its place, one that was unmuted goes to the end; ``at`` orders a user's changes.  Both
    aggregates combine before the shuffle and no list is longer than the rules that exist."""
    last_off = log.where("not muted").groupBy("user_id", "rule_id").agg(F.max("at").alias("off"))
    since = log.where("muted").join(last_off, ["user_id", "rule_id"], "left").where("off is null or at > off")
    held = since.groupBy("user_id", "rule_id").agg(F.min("at").alias("at"))
    listed = held.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "rule_id"))), lambda r: r["rule_id"]).alias("disabled_rules"))
    valid = (F.size("disabled_rules") <= MOST_RULES) & F.forall("disabled_rules", lambda r: r.rlike(RULE_ID))
    return listed.withColumn("valid", valid)


def dictionaries(log: DataFrame, most: int = MOST_WORDS) -> DataFrame:
    """log (user_id, word, at) -> (user_id, word, added): words of 1 to 64 characters without blanks or
    control characters; a word that is there already counts nothing, and a full dictionary takes no more."""
    good = log.where(F.length("word").between(1, 64) & ~F.col("word").rlike(r"[\s\p{Cntrl}]"))
    first = good.groupBy("user_id", "word").agg(F.min("at").alias("added"))
    k = F.row_number().over(Window.partitionBy("user_id").orderBy("added", "word"))
    return first.withColumn("k", k).where(F.col("k") <= most).drop("k")


def configurations(users: DataFrame, rules: DataFrame, choices: DataFrame, words: DataFrame) -> DataFrame:
    """One row a user, defaults where nothing was chosen.  choices: (user_id, and any of DEFAULTS)."""
    own = words.groupBy("user_id").agg(F.array_sort(F.collect_list("word")).alias("dictionary"))
    out = users.select("user_id").join(rules.drop("valid"), "user_id", "left").join(choices, "user_id", "left").join(own, "user_id", "left")
    empty = F.array().cast("array<string>")
    chosen = [F.coalesce(c, F.lit(v)).alias(c) if c in choices.columns else F.lit(v).alias(c) for c, v in DEFAULTS.items()]
    return out.select("user_id", F.coalesce("disabled_rules", empty).alias("disabled_rules"), *chosen, F.coalesce("dictionary", empty).alias("dictionary"))
