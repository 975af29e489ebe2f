"""Preference pairs of conversations as a shared prompt and two masked completions, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def escaped(text: Column) -> Column:
    """The text with a backslash more between each `<` and `|` that only backslashes stand between, so that none of the template's
    marks is ever part of a role or text; a reader takes that backslash away again. Null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"<(\\*)\|", r"<\\$1|")


def _role(role: Column) -> Column:
    """A role, in which the mark that ends it is escaped too."""
    return F.regexp_replace(escaped(role), r"\|(\\*)>", r"|\\$1>")


def turn_text(role: Column, text: Column) -> Column:
    """A turn in the template; a null role or text is empty."""
    return F.concat(F.lit("<|"), _role(role), F.lit("|>\n"), escaped(text), F.lit("<|end|>\n"))


def _head(role: Column) -> Column:
    return F.length(_role(role)) + 5


def conversations(turns: DataFrame, key_col: str, name: str) -> DataFrame:
    """One row per key with its turns in order; turns with equal numbers go by role, then text, nulls (also of the number) first."""
    turn = F.struct(F.col("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    return turns.groupBy(F.col(key_col).alias("key")).agg(F.sort_array(F.collect_list(turn)).alias(name))


def _rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: turn_text(t["role"], t["text"])), "")


def _trained(turns: Column, role: str) -> Column:
    """[start, end) in characters of what is trained on: the text and end mark of each turn of the role."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start: int, end: int>>").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        end = acc["at"] + F.length(turn_text(t["role"], t["text"]))
        span = F.struct((acc["at"] + _head(t["role"])).alias("start"), (end - 1).alias("end"))
        spans = F.when(F.coalesce(t["role"] == role, F.lit(False)), F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"])
        return F.struct(end.alias("at"), spans.alias("spans"))

    return F.aggregate(turns, start, step, lambda acc: acc["spans"])


def format_preferences(chosen: DataFrame, rejected: DataFrame, key_col: str = "conv_id", role: str = "assistant") -> DataFrame:
    """The key, prompt_turns, prompt, chosen, rejected, chosen_spans and rejected_spans of each key in both tables.

    chosen and rejected have a row per turn: key, turn, role, text. The longest common prefix of turns (equal roles and
    texts, null equal to null) is rendered once as the prompt; what follows on either side is its completion, of which the
    spans, in characters of the completion, are trained on and all else is masked. Conversations that are equal
    have empty completions; if one continues the other, one is empty. Keys of one table only, and null keys, give no row. Repeated turn
    rows are turns, and turns without a number come first. Marks of the template inside a role or text are escaped (see `escaped`).
    Empty tables give no rows. Other columns are not read.

    A conversation is a row, so its turns meet in one task; the two tables are grouped and joined on one
    partitioning by key.
    """
    pairs = conversations(chosen, key_col, "c").join(conversations(rejected, key_col, "r"), "key")
    same = F.zip_with("c", "r", lambda x, y: x.isNotNull() & y.isNotNull() & x["role"].eqNullSafe(y["role"]) & x["text"].eqNullSafe(y["text"]))
    first_other = F.array_position(same, F.lit(False))
    pairs = pairs.withColumn("n", F.when(first_other == 0, F.size("c")).otherwise(first_other - 1).cast("int"))
    after = lambda c: F.slice(c, F.col("n") + 1, F.greatest(F.size(c) - F.col("n"), F.lit(0)))
    return pairs.select(
        F.col("key").alias(key_col), F.col("n").alias("prompt_turns"), _rendered(F.slice("c", 1, F.col("n"))).alias("prompt"),
        _rendered(after("c")).alias("chosen"), _rendered(after("r")).alias("rejected"), _trained(after("c"), role).alias("chosen_spans"), _trained(after("r"), role).alias("rejected_spans"),
    )


def shortened_answers(turns: DataFrame, key_col: str = "conv_id", role: str = "assistant") -> DataFrame:
    """A rejected conversation (key, turn, role, text) for each conversation with an answer: it ends at one of the answers, of
    which it has the first half of the characters. The key's MD5 chooses the answer, so the key may be of any type.

    Answers are the turns of the role that have a number. A conversation without any, or with a null key, gives no row. Turns without a
    number come first and stay. Of several answers with the chosen number, each is halved; a null text stays null. Repeated turn
    rows count each. An empty table gives no rows. Other columns are dropped.
    """
    answers = turns.where((F.col("role") == role) & F.col("turn").isNotNull()).groupBy(key_col).agg(F.sort_array(F.collect_list("turn")).alias("answers"))
    drawn = F.conv(F.substring(F.md5(F.col(key_col).cast("string")), 1, 8), 16, 10).cast("long")
    cut = answers.select(key_col, F.get("answers", F.pmod(drawn, F.size("answers")).cast("int")).alias("cut"))
    kept = turns.select(key_col, "turn", "role", "text").join(cut, key_col).where("turn is null or turn <= cut")
    half = F.substring("text", F.lit(1), F.floor(F.length("text") / 2).cast("int"))
    chosen = F.coalesce((F.col("turn") == F.col("cut")) & (F.col("role") == role), F.lit(False))
    return kept.select(key_col, "turn", "role", F.when(chosen, half).otherwise(F.col("text")).alias("text"))
