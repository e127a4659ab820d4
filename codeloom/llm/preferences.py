"""Preference formatting: the longest common turn prefix of two conversations as prompt, and both completions, masked.

For each pair of a chosen and a rejected conversation, the turns that agree from
the start (role and text) are rendered once; the rest of each is its completion.
Turns are rendered as ROLE markers around the text. A completion's mask lists the
character spans (start, length, in the completion) that a loss may use: the texts
and end markers of its assistant turns.

Cases: null roles are "user", null texts are empty; a conversation without turns is an
empty one; a pair with equal conversations has two empty completions; a pair with no
common turn has an empty prompt; turns of one number are ordered by role and text, and
repeated rows are turns of their own; turns with a null id are left out;
pairs that name a conversation without rows get an empty one; texts of any length are
rendered whole; an empty table gives an empty table; further columns are not read, whatever their names. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from codeloom.llm._spark import Scratch, cut, salted_join

#: Fixed values of the format.
BEGIN, END = "<|im_start|>", "<|im_end|>\n"
LEARNED_ROLE = "assistant"


def conversations(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(id, turns): the turns (role, text) of each conversation, in order."""
    turn = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("user")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    grouped = turns.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    return grouped.select("id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(BEGIN), t["role"], F.lit("\n"), t["text"], F.lit(END))), "")


def spans(turns: Column) -> Column:
    """(start, length) of the learned characters in rendered(turns)."""
    head = lambda t: F.lit(len(BEGIN) + 1) + F.length(t["role"])
    body = lambda t: F.length(t["text"]) + F.lit(len(END))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def step(s: Column, t: Column) -> Column:
        span = F.array(F.struct((s["at"] + head(t)).alias("start"), body(t).alias("length")))
        return F.struct((s["at"] + head(t) + body(t)).alias("at"), F.when(t["role"] == LEARNED_ROLE, F.concat(s["spans"], span)).otherwise(s["spans"]).alias("spans"))

    return F.aggregate(turns, start, step, lambda s: s["spans"])


def common_prefix(a: Column, b: Column) -> Column:
    """The number of turns that agree from the start."""
    both = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y) & x.isNotNull())
    return F.coalesce(F.nullif(F.array_position(both, False), F.lit(0)) - 1, F.least(F.size(a), F.size(b)).cast("long")).cast("int")


def pair_up(pairs: DataFrame) -> DataFrame:
    """pairs(pair_id, chosen, rejected), the latter two arrays of turns, formatted: pair_id, prefix_turns, prompt, chosen, rejected, their masks, and what else pairs has."""
    none = F.array().cast("array<struct<role:string,text:string>>")
    more = [c for c in pairs.columns if c not in ("pair_id", "chosen", "rejected")]
    rows = pairs.select("pair_id", F.coalesce("chosen", none).alias("c"), F.coalesce("rejected", none).alias("r"), *more).withColumn("prefix_turns", common_prefix(F.col("c"), F.col("r")))
    rest = lambda name: F.slice(name, F.col("prefix_turns") + 1, F.size(name))
    return rows.select(
        "pair_id", "prefix_turns", rendered(F.slice("c", F.lit(1), F.col("prefix_turns"))).alias("prompt"),
        rendered(rest("c")).alias("chosen"), rendered(rest("r")).alias("rejected"), spans(rest("c")).alias("chosen_mask"), spans(rest("r")).alias("rejected_mask"), *more,
    )


def pairs_of(convs: DataFrame, chosen: DataFrame) -> DataFrame:
    """pairs for pair_up() from chosen(pair_id, chosen_id, rejected_id) and conversations()."""
    chosen = cut(chosen, "chosen")
    one = salted_join(chosen, convs.select(F.col("id").alias("chosen_id"), F.col("turns").alias("chosen")), ["chosen_id"], "pair_id", "left")
    both = salted_join(cut(one, "chosen-turns"), convs.select(F.col("id").alias("rejected_id"), F.col("turns").alias("rejected")), ["rejected_id"], "pair_id", "left")
    return both.select("pair_id", "chosen", "rejected")


def against_other_answers(convs: DataFrame, seed: int = 17, every: bool = False) -> DataFrame:
    """pairs: a conversation with an assistant turn against itself, its last assistant turn and what follows replaced by the last assistant turn of another.

    The other one is the next conversation with a different last answer in the ring of ids
    of its part, in which the ids are ordered by a hash; parts are as many as give
    about a thousand conversations each. Conversations without an assistant turn, or in a part
    whose answers all agree, have no pair; with every they give a row too, whose chosen and
    rejected are null and whose status says why ("no assistant turn", "no other answer").
    """
    last = F.array_position(F.reverse(F.transform("turns", lambda t: t["role"])), LEARNED_ROLE)
    with Scratch() as s:
        rows = s.cut(convs.select("id", "turns", F.when(last > 0, F.size("turns") - last.cast("int") + 1).alias("cut")), "answers")
        answers = rows.where("cut is not null").select("id", "turns", "cut", F.element_at("turns", F.col("cut")).alias("answer"))
        parts = max(1, answers.count() // 1000)
        by = Window.partitionBy("part").orderBy("place", "id")
        key = answers.select("id", F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(parts)).alias("part"), F.xxhash64("id", F.lit(seed + 1)).alias("place"), F.sha2(F.to_json("answer"), 256).alias("says"))
        # A run of equal answers ends where the next one starts; the last run's next is the ring's first different one.
        start = F.when(~F.col("says").eqNullSafe(F.lag("says").over(by)), F.struct("id", "says"))
        runs = key.withColumn("start", start)
        ahead, whole = by.rowsBetween(1, Window.unboundedFollowing), by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        runs = runs.withColumns({"next": F.first("start", ignorenulls=True).over(ahead), "first": F.first("start", ignorenulls=True).over(whole)})
        # Of the ring's second run, for members of a last run that agree with the first one.
        second = F.first(F.when(F.col("says") != F.col("first.says"), F.struct("id", "says")), ignorenulls=True).over(whole)
        runs = runs.withColumn("second", second)
        other = F.coalesce(F.col("next.id"), F.when(F.col("first.says") != F.col("says"), F.col("first.id")), F.when(F.col("second.says") != F.col("says"), F.col("second.id")))
        after = runs.select("id", other.alias("other"))
        met = answers.join(after, "id").join(answers.select(F.col("id").alias("other"), F.col("answer").alias("other_answer")), "other", "left")
        rejected = F.concat(F.slice("turns", F.lit(1), F.col("cut") - 1), F.array("other_answer"))
        found = F.col("other").isNotNull()
        pairs = met.select(F.col("id").alias("pair_id"), F.when(found, F.col("turns")).alias("chosen"), F.when(found, rejected).alias("rejected"), F.when(found, "pair").otherwise("no other answer").alias("status"))
        none = F.lit(None).cast(pairs.schema["chosen"].dataType)
        silent = rows.where("cut is null").select(F.col("id").alias("pair_id"), none.alias("chosen"), none.alias("rejected"), F.lit("no assistant turn").alias("status"))
        s.keep(rows)
        return pairs.union(silent) if every else pairs.where("status = 'pair'").drop("status")
