"""Mixing sources to target weights by temperature, realised as budgeted block permutations.

A source's weight is its share of all tokens to the power of an exponent between 0
(equal weights) and 1 (as they are), normalised. The exponent is the largest that
reaches the target entropy (by default the shares' own, and of what is missing to the largest possible
the part GAIN: a target that shares never meet already, unless they are equal), or, where the repetition limit forbids that, the
smallest that repeats no source more than max_repeats times; both by bisection, on
sums over the sources made by Spark, of 32 exponents at once. Weights times budget
(all tokens, or a part of them) give each source's tokens.

A source's documents have a fixed order by a hash of their ids, cut into BLOCKS
blocks of BLOCKS smaller ones each. Whole passes over the source come first; of the
last pass, whole blocks as long as they fit in the budget, then whole smaller ones of
the next block, then documents of the next smaller one, one by one. So a source is short of its
budget by less than its next document, and no task orders more than about a
sixteen-millionth of a source.

The mixture itself is BLOCKS blocks, in each of which every source has its weight. A source's passes, each in
an order of its own, are laid one behind another over all blocks, so a row knows its block from its
source's plan and a hash of its id; within a block rows may be read in any order.

Tokens are runs of visible characters. Cases: a null or empty text has no tokens
and is kept once, outside of every budget; a null source is a source of its own;
rows with equal ids follow each other in the order of their texts; an empty table
gives an empty table; a single source keeps weight 1; texts of any length are counted
whole; further columns are passed through, and columns named like the operator's own are
not disturbed (but for one named copies_col, which gives way to the result).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from codeloom.llm._spark import Scratch, cut

#: The part of what entropy is missing that is made up, and most passes over one source.
GAIN, MAX_REPEATS = 0.75, 4.0
BLOCKS = 4096
_SECTIONS, _PASSES = 32, 6


def tokens(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def _sums(sources: DataFrame, exponents: list[float]) -> list[tuple[float, float]]:
    """(entropy, largest ratio of weight to share) at each exponent."""
    parts = []
    for i, a in enumerate(exponents):
        w = F.pow("share", F.lit(a))
        parts += [F.sum(w).alias(f"z{i}"), F.sum(w * F.log(w)).alias(f"s{i}"), F.max(w / F.col("share")).alias(f"m{i}")]
    row = sources.agg(*parts).head()
    return [(math.log(row[f"z{i}"]) - row[f"s{i}"] / row[f"z{i}"], row[f"m{i}"] / row[f"z{i}"]) for i in range(len(exponents))]


def exponent(sources: DataFrame, entropy: float | None, max_repeats: float, budget_share: float) -> float:
    """The exponent for sources(share). Entropy and the largest repetition both fall as it grows; entropy: a part of the largest possible, or None for GAIN."""
    low, high = 0.0, 1.0
    n = sources.count()
    if n < 2:
        return 1.0
    ((own, _),) = _sums(sources, [1.0])
    # Of equal shares the sums' rounding alone would be left to make up.
    target = own + GAIN * max(0.0, math.log(n) - own - 1e-9) if entropy is None else entropy * math.log(n)
    fits = lambda e, m: m * budget_share <= max_repeats
    reaches = lambda e, m: e >= target

    def bisect(good_low) -> float:
        """Where a condition that holds at the low end first fails."""
        a, b = low, high
        for _ in range(_PASSES):
            grid = [a + (b - a) * i / _SECTIONS for i in range(_SECTIONS + 1)]
            ok = [good_low(*x) for x in _sums(sources, grid)]
            if all(ok):
                return b
            i = ok.index(False)
            if i == 0:
                return a
            a, b = grid[i - 1], grid[i]
        return a

    by_entropy = bisect(reaches)
    ((_, repeats),) = _sums(sources, [by_entropy])
    if fits(0, repeats):
        return by_entropy
    return min(1.0, bisect(lambda e, m: not fits(e, m)) + 1e-9)


def weights(counted: DataFrame, entropy: float | None = None, max_repeats: float = MAX_REPEATS, budget: int | None = None, budget_share: float = 1.0) -> DataFrame:
    """(source, total, share, weight, target): counted has source and n, the tokens of a document."""
    totals = cut(counted.groupBy("source").agg(F.sum("n").alias("total")).where("total > 0"), "sources")
    whole = totals.agg(F.sum("total").alias("t")).head()["t"] or 0
    shares = totals.withColumn("share", F.col("total") / F.lit(float(max(whole, 1))))
    budget = round(whole * budget_share) if budget is None else budget
    a = exponent(shares, entropy, max_repeats, budget / max(whole, 1)) if whole else 1.0
    power = F.pow("share", F.lit(a))
    z = shares.agg(F.sum(power).alias("z")).head()["z"] or 1.0
    weight = power / F.lit(z)
    return shares.withColumn("weight", weight).withColumn("target", F.floor(weight * F.lit(float(budget)) + 0.5).cast("long"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", entropy: float | None = None, max_repeats: float = MAX_REPEATS, budget: int | None = None, copies_col: str | None = None, blocks_col: str | None = None, budget_share: float = 1.0) -> DataFrame:
    """docs mixed to the target weights: each row as often as it was drawn, with the block of the mixture in blocks_col, if that is named.

    With copies_col each row comes once, with the times that it was drawn, 0 too, and all their blocks, as an array.
    budget: tokens of the mixture, by default the part budget_share of those of docs.
    """
    with Scratch() as s:
        return _mixed(s, docs, id_col, text_col, source_col, entropy, max_repeats, budget, copies_col, blocks_col, budget_share)


def _edge(rows: DataFrame, by: str, room: str) -> DataFrame:
    """(source, room's own columns, edge, left): of rows(source, n, by) and their source's room, the part in which the room ends, and what is left of it there."""
    keys = [c for c in rows.columns if c not in ("id", "h", "place", "n", by)]
    sums = rows.groupBy(*keys, by).agg(F.sum("n").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("source").orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ends = sums.withColumn("_before", before).where((F.col("_before") <= F.col(room)) & (F.col("_before") + F.col("_n") > F.col(room)))
    return ends.select(*keys, F.col(by).alias(f"edge_{by}"), (F.col(room) - F.col("_before")).alias("left"))


def _mixed(s: Scratch, docs: DataFrame, id_col: str, text_col: str, source_col: str, entropy: float | None, max_repeats: float, budget: int | None, copies_col: str | None, blocks_col: str | None, budget_share: float) -> DataFrame:
    place = F.pmod(F.xxhash64(F.col(id_col), F.lit(53)), F.lit(1 << 40)).alias("place")
    bits = BLOCKS.bit_length() - 1
    block, part = F.shiftrightunsigned("place", 40 - bits).cast("int"), (F.shiftrightunsigned("place", 40 - 2 * bits) % BLOCKS).cast("int")
    counted = docs.select(F.col(source_col).alias("source"), F.col(id_col).alias("id"), tokens(text_col).alias("n"), place, F.xxhash64(text_col).alias("h"))
    counted = s.cut(counted, "tokens")
    weighed = weights(counted, entropy, max_repeats, budget, budget_share)
    plan = weighed.select("source", F.expr("target div total").alias("passes"), F.expr("target % total").alias("rest"), (F.col("target") / F.col("total")).alias("span"))
    plan = s.cut(plan, "plan")

    # At most BLOCKS rows a source: which blocks of the last pass fit, and in which it ends; then the same inside of that one.
    same = lambda a, b: F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source"))
    told = counted.where("n > 0").withColumn("block", block)
    by_block = told.groupBy("source", "block").agg(F.sum("n").alias("n")).alias("c").join(plan.alias("p"), same("c", "p")).select("c.source", "p.passes", "p.span", "p.rest", "c.block", "c.n")
    edges = s.cut(_edge(by_block, "block", "rest"), "edges")
    inside = told.withColumn("part", part).alias("c").join(edges.alias("e"), same("c", "e") & (F.col("c.block") == F.col("e.edge_block")))
    inside = s.cut(inside.select("c.source", "c.id", "c.h", "c.place", "c.n", "c.part", "e.passes", "e.span", "e.edge_block", F.col("e.left").alias("room")), "inside")
    ends = s.cut(_edge(inside, "part", "room"), "ends")

    # Of the one part in which a source's budget ends, the documents before the end.
    last = inside.alias("c").join(ends.alias("e"), same("c", "e") & (F.col("c.part") == F.col("e.edge_part"))).select("c.source", "c.id", "c.h", "c.place", "c.n", "e.left")
    upto = F.sum("n").over(Window.partitionBy("source").orderBy("place", "id", "h").rowsBetween(Window.unboundedPreceding, 0))
    taken = s.cut(last.withColumn("upto", upto).where("upto <= left").groupBy("id", "h", "source").agg(F.count(F.lit(1)).alias("more")), "taken")

    names = [c for c in docs.columns if c not in (copies_col, blocks_col)]
    marks = [F.col(f"d.`{c}`") for c in names]
    own = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in names]).alias("d"), F.col(source_col).alias("source"), F.col(id_col).alias("id"),
        F.xxhash64(text_col).alias("h"), (F.regexp_instr(F.coalesce(F.col(text_col), F.lit("")), F.lit(r"\S")) > 0).alias("any"), place,
    ).withColumn("block", block).withColumn("part", part)
    planned = own.alias("o").join(_small(ends).alias("e"), same("o", "e"), "left").select("o.*", "e.passes", "e.span", "e.edge_block", "e.edge_part")
    met = (F.col("o.id").eqNullSafe(F.col("t.id"))) & (F.col("o.h") == F.col("t.h")) & same("o", "t")
    drawn = planned.alias("o").join(taken.alias("t"), met, "left")
    in_part = (F.col("part") < F.col("edge_part")) | (F.col("part") == F.col("edge_part")) & F.col("more").isNotNull()
    fits = (F.col("block") < F.col("edge_block")) | (F.col("block") == F.col("edge_block")) & in_part
    copies = F.when(~F.col("any"), F.lit(1)).otherwise(F.col("passes") + fits.cast("int"))
    for read_later in (ends, taken):
        s.keep(read_later)
    copies = F.coalesce(copies, F.lit(0)).cast("int")
    # The last pass may be a part of one, in the order that says which part; each whole one has an order of its own.
    turn = lambda c: F.when(c == F.col("passes"), F.col("o.place")).otherwise(F.pmod(F.xxhash64("o.id", F.lit(54) + c), F.lit(1 << 40))) / float(1 << 40)
    block_of = lambda c: F.least(F.lit(BLOCKS - 1), F.floor((c + turn(c)) / F.when(F.col("any"), F.col("span")).otherwise(F.lit(1.0)) * BLOCKS)).cast("int")
    own_blocks = F.when(copies > 0, F.transform(F.sequence(F.lit(0), F.greatest(copies - 1, F.lit(0))), block_of)).otherwise(F.array().cast("array<int>"))
    if copies_col:
        return drawn.select(*marks, copies.cast("long").alias(copies_col), *([own_blocks.alias(blocks_col)] if blocks_col else []))
    out = drawn.where(copies > 0).select("d", F.explode(own_blocks if blocks_col else F.array_repeat(F.lit(0), copies)).alias("_block"))
    return out.select(*marks, *([F.col("_block").alias(blocks_col)] if blocks_col else []))


def _small(edges: DataFrame, most: int = 100_000) -> DataFrame:
    """A row a source: broadcast where there are few sources, else left to a shuffle."""
    return F.broadcast(edges) if edges.limit(most + 1).count() <= most else edges
