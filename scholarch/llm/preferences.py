"""Preference formatting: one prompt for the turns two conversations share, and two masked completions.

A pair is two lists of turns.  Their longest common prefix (same role and text) is rendered once as
the prompt; what follows on either side is a completion, with a mask that trains on assistant turns
only.  Everything is column functions: one shuffle brings the turns of a pair together, and a pair
is one output row, so nothing but its own turns is ever held together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The rendered form of a turn (fixed values of the template).
OPEN, CLOSE, END = "<|", "|>\n", "<|end|>\n"
TRAINED_ROLE = "assistant"


def _header(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), turn["role"], F.lit(CLOSE))


def _body(turn: Column) -> Column:
    # a text cannot forge the marks of a turn
    return F.concat(F.replace(turn["text"], F.lit(OPEN), F.lit("< |")), F.lit("\n" + END))


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_header(t), _body(t))), "")


def _mask(turns: Column) -> Column:
    """Runs of the rendered completion in order: (train, chars); headers are never trained on."""
    return F.flatten(
        F.transform(
            turns,
            lambda t: F.array(
                F.struct(F.lit(False).alias("train"), F.length(_header(t)).alias("chars")),
                F.struct((t["role"] == TRAINED_ROLE).alias("train"), F.length(_body(t)).alias("chars")),
            ),
        )
    )


def format_preferences(turns: DataFrame) -> DataFrame:
    """One row per pair_id of `turns` (pair_id, rejected: boolean, turn, role, text).

    Columns: pair_id, n_prefix (turns of the prompt), prompt, chosen, rejected (completions),
    chosen_mask, rejected_mask (arrays of (train, chars) that add up to the completion), status:
    'pair', 'identical' (both completions empty), 'continued' (one is empty, as one conversation
    goes on where the other ends), or 'single' (one side is missing: its completion and mask are
    null, the prompt is empty).

    Rows without pair_id or side are left out.  Null roles and texts count as empty; turns are
    ordered by turn (nulls first), role and text; repeated turns are kept.  Other columns are
    ignored; an empty table gives no rows.
    """
    own = turns.where("pair_id IS NOT NULL AND rejected IS NOT NULL").select(
        "pair_id", F.struct("rejected", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t")
    )
    both = own.groupBy("pair_id").agg(F.array_sort(F.collect_list("t")).alias("all"))
    sides = both.select(
        "pair_id",
        F.filter("all", lambda t: ~t["rejected"]).alias("c"),
        F.filter("all", lambda t: t["rejected"]).alias("r"),
    )
    shorter = F.least(F.size("c"), F.size("r"))
    same = F.transform(F.sequence(F.lit(1), shorter), lambda i: (F.element_at("c", i)["role"] == F.element_at("r", i)["role"]) & (F.element_at("c", i)["text"] == F.element_at("r", i)["text"]))
    apart = F.when(shorter == 0, F.lit(1)).otherwise(F.array_position(same, F.lit(False)))
    cut = sides.withColumn("n_prefix", F.when(apart == 0, shorter).otherwise(apart - 1).cast("int"))
    tails = cut.select(
        "pair_id",
        "n_prefix",
        F.slice("c", 1, F.col("n_prefix")).alias("head"),
        F.when(F.size("c") > 0, F.slice("c", F.col("n_prefix") + 1, F.size("c"))).alias("c"),
        F.when(F.size("r") > 0, F.slice("r", F.col("n_prefix") + 1, F.size("r"))).alias("r"),
    )
    empty = F.when(F.size("c") == 0, 1).otherwise(0) + F.when(F.size("r") == 0, 1).otherwise(0)
    status = F.when(F.col("c").isNull() | F.col("r").isNull(), "single").when(empty == 2, "identical").when(empty == 1, "continued").otherwise("pair")
    return tails.select(
        "pair_id",
        "n_prefix",
        _render(F.col("head")).alias("prompt"),
        _render(F.col("c")).alias("chosen"),
        _render(F.col("r")).alias("rejected"),
        _mask(F.col("c")).alias("chosen_mask"),
        _mask(F.col("r")).alias("rejected_mask"),
        status.alias("status"),
    )


def neighbouring_pairs(conversations: DataFrame) -> DataFrame:
    """Turns of the pairs (2k, 2k + 1) of conversation ids: the even one chosen, the odd one rejected."""
    conv = F.col("conv_id")
    return conversations.select(F.shiftright(conv.cast("long"), 1).alias("pair_id"), (conv.cast("long").bitwiseAND(F.lit(1)) == 1).alias("rejected"), "turn", "role", "text")


def answered_otherwise(conversations: DataFrame) -> DataFrame:
    """Turns of one pair per conversation: as it is (chosen), and up to its last assistant turn with another answer there (rejected).

    pair_id is conv_id.  The other answer is the first one of conversation conv_id XOR 1; where that
    has none the rejected side ends before the turn (it is missing, if that is the first one), and a
    conversation without an answer is rejected as it is.  Of several rows of the last answer's turn one other answer comes out; rows
    without a turn stand first and are on both sides.  Rows without a conv_id are left out; null
    texts count as empty; other columns are ignored; an empty table gives no rows.

    Per conversation one number and one answer are joined, so a hot conversation is aggregated in
    the map tasks first.
    """
    own = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("pair_id"), "turn", "role", "text")
    answers = own.where((F.col("role") == TRAINED_ROLE) & F.col("turn").isNotNull())
    facts = answers.groupBy("pair_id").agg(F.max("turn").alias("last"), F.min(F.struct("turn", F.coalesce("text", F.lit("")).alias("text")))["text"].alias("first"))
    others = facts.select(F.col("pair_id").bitwiseXOR(F.lit(1)).alias("pair_id"), F.col("first").alias("other"))
    cut = own.join(facts.select("pair_id", "last"), "pair_id", "left").where("last IS NULL OR turn IS NULL OR turn < last").drop("last")
    replaced = facts.join(others, "pair_id").select("pair_id", F.col("last").alias("turn"), F.lit(TRAINED_ROLE).alias("role"), F.col("other").alias("text"))
    return own.withColumn("rejected", F.lit(False)).unionByName(cut.union(replaced).withColumn("rejected", F.lit(True)))


def mask_text(mask: Column) -> Column:
    """A mask as text: '0:12,1:340' for 12 characters not trained on and 340 trained on."""
    return F.array_join(F.transform(mask, lambda m: F.concat(F.when(m["train"], "1").otherwise("0"), F.lit(":"), m["chars"].cast("string"))), ",")
