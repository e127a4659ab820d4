"""N-gram Jaccard join by signature trees: documents whose sets of word shingles overlap by a share of their union.

A document's set holds its distinct runs of k words (lower-case A-Z, words between ASCII blanks), or
the run of all its words if it has fewer. Equal sets become one. Which sets can meet at all follows from
prefixes: in an order shared by all, two sets that link have one of their first
floor((1 - least) * size) + 1 shingles in common. The order puts rare shingles first, by how
often a shingle's counter (one of COUNTERS, by a hash, over all documents) was met, so that passages
of many documents come last; any order gives the same links. How many first shingles decide depends on both sizes, so
sets meet by shingle and pair of size classes. Those that do, directly or by others in
between, form a candidate cluster, found as connected components.

A cluster is searched by signature trees. A leaf is a set's token bitmap; a node combines those
below by OR and holds their range of sizes and the most shingles that any of them hides
behind set bits. A dual traversal goes down pairs of nodes, but leaves a pair out where
the sizes, or the common bits and what they may hide, allow no overlap that links. Pairs of sets
that remain, of different components so far, are compared shingle by shingle. A cluster of more
than BLOCK_SETS sets or BLOCK_SHINGLES shingles is cut at the top of its tree: into classes of sizes, of which only the
same and neighbours can link, and these into blocks by a hash. Each block is searched by
itself, then with the first block of its class and the next, then with all others; before
each turn components are merged, and sets that meet only their own component are left out.
So no task holds more than two blocks, and none of the links between components is lost.

Cases: a null text, and one without words, has an empty set, is linked with nothing and
its own component; equal sets are always linked, whatever their size; repeated ids are rows of
their own; a null id is never the smallest, and null is the component where all are null;
an empty table gives an empty table; texts of any length are read whole. Further columns are
not read, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from codeloom.llm import _spark
from codeloom.llm._spark import Scratch, arrow_rows, parts, salted_join
from codeloom.llm._text import SHINGLE_BITS, U, Words, chunks, mix, shingle_counts, spread

WORDS, LEAST = 4, 85
#: Counters of shingles, over all documents (4 bytes each), and how many lie in one row of the shuffle that sums them.
COUNTERS, COUNTER_BLOCK = 1 << 20, 1 << 12
#: Sets and shingles that one block of a cluster holds, about.
BLOCK_SETS, BLOCK_SHINGLES = 4096, 1 << 22
#: Classes of sizes up to the largest ratio of two sets that link.
SIZE_CLASSES = 4
#: Sets of a shingle of which each pair is looked at, at most.
PAIR_SETS = 16
#: Children of a node, and bits of a bitmap, at most.
FAN_OUT, MOST_BITS = 8, 1 << 14
#: Node pairs and shingles that are compared at once.
PAIRS_AT_ONCE, SHINGLES_AT_ONCE = 1 << 15, 1 << 22
TEXT_ROWS = 2048


def _word_bytes() -> np.ndarray:
    is_word = np.ones(256, np.bool_)
    is_word[[32, *range(9, 14)]] = False
    return is_word


#: Bytes of words: all but the blanks of ASCII; and lower case of each byte.
_IS_WORD = _word_bytes()
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingles(column: pa.Array, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end, row, shingle): the sets of a chunk of texts, ascending."""
    for a, b in chunks(column):
        data, offsets = spread(column.slice(a, b - a))
        row, shingle, _ = shingle_counts(Words(_LOWER[data], offsets, _IS_WORD), b - a, k)
        yield a, b, row, shingle


def counters(docs: DataFrame, text_col: str, k: int) -> np.ndarray:
    """How many sets hold a shingle of each counter, over all documents; of a fixed size."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(COUNTERS, np.uint32)
        for batch in batches:
            for _, _, _, shingle in shingles(batch.column(0), k):
                np.add.at(held, (shingle % U(COUNTERS)).astype(np.int64), 1)
        rows = held.reshape(-1, COUNTER_BLOCK)
        at = np.flatnonzero(rows.any(1))
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array([rows[i].tobytes() for i in at], pa.binary())], ["block", "held"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = np.frombuffer(raw.as_buffer(), np.uint32).astype(np.int64)
                sums[block] = sums[block] + own if block in sums else own
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["block", "held"])

    schema = "block long, held binary"
    with arrow_rows(docs.sparkSession, TEXT_ROWS):
        each = docs.select(F.col(text_col).alias("text")).mapInArrow(count, schema)
        rows = each.repartition(parts(docs), "block").mapInArrow(add, schema).collect()
    out = np.zeros((COUNTERS // COUNTER_BLOCK, COUNTER_BLOCK), np.int64)
    for block, raw in rows:
        out[block] = np.frombuffer(raw, np.int64)
    return np.minimum(out.reshape(-1), np.iinfo(np.int32).max).astype(np.int32)


def prefix_length(size: np.ndarray, least: int) -> np.ndarray:
    """How many first shingles of a set decide whether it can link: with more left out, less than ``least`` per cent of it would be common."""
    return size - -(-least * size // 100) + 1


def signed(docs: DataFrame, rank: np.ndarray, id_col: str, text_col: str, k: int, least: int) -> DataFrame:
    """(id, n, h1, h2, prefix): size and two hashes of a set, and its first shingles by (rank, shingle)."""
    sent = docs.sparkSession.sparkContext.broadcast(rank)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = sent.value
        for batch in batches:
            for a, b, row, shingle in shingles(batch.column(1), k):
                size = np.bincount(row, minlength=b - a)
                first = np.append(0, np.cumsum(size))
                whole = []
                for seed in (1, 2):
                    sums = np.append(U(0), np.cumsum(mix(shingle + U(seed << 50))))
                    whole.append(mix(sums[first[1:]] - sums[first[:-1]] + size.astype(U)).astype(np.int64))
                # Ascending shingles of a row stay so among those of one rank.
                by = np.argsort(row.astype(np.int64) << 32 | order[(shingle % U(COUNTERS)).astype(np.int64)], kind="stable")
                take = np.where(size > 0, prefix_length(size, least), 0)
                until = np.append(0, np.cumsum(take))
                at = np.repeat(first[:-1] - until[:-1], take) + np.arange(until[-1])
                lists = pa.ListArray.from_arrays(pa.array(until, pa.int32()), pa.array(shingle[by[at]].astype(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(size), pa.array(whole[0]), pa.array(whole[1]), lists], ["id", "n", "h1", "h2", "prefix"])

    kind = docs.schema[id_col].dataType.simpleString()
    with arrow_rows(docs.sparkSession, TEXT_ROWS):
        return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n long, h1 long, h2 long, prefix array<long>")


class Tree:
    """A signature tree over sets in a given order; level 0 has the sets, the last level one node.

    Each level: bits (OR of the bitmaps below), low and high (range of sizes), hidden (the most
    shingles of a set below that share a bit with another of it).
    """

    def __init__(self, bits: np.ndarray, size: np.ndarray):
        hidden = size - np.bitwise_count(bits).sum(1, dtype=np.int64)
        self.levels = [(bits, size, size, hidden)]
        while len(self.levels[-1][0]) > 1:
            bits, low, high, hidden = self.levels[-1]
            at = np.arange(0, len(bits), FAN_OUT)
            self.levels.append((np.bitwise_or.reduceat(bits, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(hidden, at)))

    def level(self, n: int) -> tuple:
        return self.levels[min(n, len(self.levels) - 1)]


def possible(one: tuple, i: np.ndarray, two: tuple, j: np.ndarray, least: int) -> np.ndarray:
    """Whether sets below node i of one level and node j of another may overlap by ``least`` per cent of their union."""
    low, also_low = one[1][i], two[1][j]
    most = np.minimum(one[2][i], two[2][j])
    # An overlap o of sizes s and t links where (100 + least) * o >= least * (s + t).
    keep = np.flatnonzero((100 + least) * most >= least * (low + also_low))
    out = np.zeros(len(i), np.bool_)
    common = np.bitwise_count(one[0][i[keep]] & two[0][j[keep]]).sum(1, dtype=np.int64) + np.minimum(one[3][i[keep]], two[3][j[keep]])
    out[keep] = (100 + least) * np.minimum(most[keep], common) >= least * (low[keep] + also_low[keep])
    return out


def traverse(one: Tree, two: Tree, same: bool, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) of sets that may link, by a dual traversal from the roots; of one tree with itself (same) those with i < j."""
    top = max(len(one.levels), len(two.levels)) - 1
    waiting = [(top, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    step = np.arange(FAN_OUT)
    while waiting:
        level, i, j = waiting.pop()
        if len(i) > PAIRS_AT_ONCE:
            waiting.extend((level, i[a : a + PAIRS_AT_ONCE], j[a : a + PAIRS_AT_ONCE]) for a in range(0, len(i), PAIRS_AT_ONCE))
            continue
        keep = possible(one.level(level), i, two.level(level), j, least)
        i, j = i[keep], j[keep]
        if not len(i):
            continue
        if level == 0:
            if same:
                i, j = i[i < j], j[i < j]
            if len(i):
                yield i, j
            continue
        # A tree with fewer levels stays at its root until the other has come down to its height.
        below = [x[:, None] * FAN_OUT + step if level < len(t.levels) else x[:, None] for x, t in ((i, one), (j, two))]
        i, j = (x.ravel() for x in np.broadcast_arrays(below[0][:, :, None], below[1][:, None, :]))
        inside = (i < len(one.level(level - 1)[0])) & (j < len(two.level(level - 1)[0]))
        if same:
            inside &= i <= j
        waiting.append((level - 1, i[inside], j[inside]))


def bitmaps(shingle: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A bitmap a set, of about four bits for each shingle of the largest."""
    size = np.diff(first)
    width = min(MOST_BITS, max(64, 1 << int(4 * int(size.max()) - 1).bit_length()))
    at = ((shingle >> U(20)) % U(width)).astype(np.int64)
    flat = np.zeros((len(size), width // 64), U)
    np.bitwise_or.at(flat, (np.repeat(np.arange(len(size)), size), at >> 6), U(1) << (at & 63).astype(U))
    return flat


def merged(shingle: np.ndarray, first: np.ndarray, label: np.ndarray, side: np.ndarray | None, least: int) -> np.ndarray:
    """label after the components that links join have become one, named by their smallest label.

    Set n holds shingle[first[n]:first[n + 1]]. side: None, where all sets meet all; or two sides (0 and 1), where
    only sets of different sides meet, as those of one have met before.
    """
    size = np.diff(first)
    if len(size) < 2:
        return label
    bits = bitmaps(shingle, first)
    # Alike sets have their smallest shingle in common by a likelihood of their similarity, and so stand together.
    order = np.lexsort((size, shingle[first[:-1]]))
    own = [order] if side is None else [order[side[order] == 0], order[side[order] == 1]]
    if any(not len(o) for o in own):
        return label
    trees = [Tree(bits[o], size[o]) for o in own]
    local = np.unique(shingle, return_inverse=True)[1]
    marked = np.zeros(int(local.max()) + 1, np.bool_)
    for i, j in traverse(trees[0], trees[-1], side is None, least):
        i, j = own[0][i], own[-1][j]
        apart = label[i] != label[j]
        i, j = i[apart], j[apart]
        by = np.argsort(i, kind="stable")
        i, j = i[by], j[by]
        starts = np.flatnonzero(np.append(True, i[1:] != i[:-1])) if len(i) else []
        for s, e in zip(starts, [*starts[1:], len(i)]):
            x, ys = i[s], j[s:e]
            own_shingles = local[first[x] : first[x + 1]]
            marked[own_shingles] = True
            while len(ys := ys[label[ys] != label[x]]):
                n = max(1, int(np.searchsorted(np.cumsum(size[ys]), SHINGLES_AT_ONCE)))
                now, ys = ys[:n], ys[n:]
                until = np.append(0, np.cumsum(size[now]))
                at = np.repeat(first[now] - until[:-1], size[now]) + np.arange(until[-1])
                both = np.add.reduceat(marked[local[at]].astype(np.int64), until[:-1])
                linked = now[100 * both >= least * (size[x] + size[now] - both)]
                if len(linked):
                    names = np.unique(np.append(label[linked], label[x]))
                    label[np.isin(label, names)] = names[0]
            marked[own_shingles] = False
    return label


def _searched(rows: DataFrame, k: int, least: int) -> DataFrame:
    """(a, b): links between components, one fewer than a task's search joins, of rows(key, rep, side, comp, text); side is -1 where all of a key meet.

    A key's rows go to one task, which holds one key at a time; keys of few rows are decoded many at once.
    """
    kind = rows.schema["rep"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(held: pa.Table) -> pa.RecordBatch:
            key, comp, side = (held.column(c).combine_chunks() for c in ("key", "comp", "side"))
            starts = np.flatnonzero(np.append(True, np.diff(key.to_numpy(zero_copy_only=False)) != 0))
            names, label = np.unique(comp.to_numpy(zero_copy_only=False), return_inverse=True) if comp.type != pa.string() else np.unique(np.array(comp.to_pylist(), object), return_inverse=True)
            side, text = side.to_numpy(zero_copy_only=False), held.column("text").combine_chunks()
            sets, sizes = [], []
            for a, b, row, shingle in shingles(text, k):
                sets.append(shingle)
                sizes.append(np.bincount(row, minlength=b - a))
            shingle, first = np.concatenate(sets), np.append(0, np.cumsum(np.concatenate(sizes)))
            one, two = [], []
            for s, e in zip(starts, [*starts[1:], len(side)]):
                before = label[s:e]
                after = merged(shingle[first[s] : first[e]], first[s : e + 1] - first[s], before.copy(), None if side[s] < 0 else side[s:e], least)
                moved = np.unique(np.stack([after, before], 1)[after != before], axis=0)
                one.append(moved[:, 0])
                two.append(moved[:, 1])
            ends = [pa.array(names[np.concatenate(x)].tolist(), comp.type) for x in (one, two)]
            return pa.RecordBatch.from_arrays(ends, ["a", "b"])

        held, size = None, 0
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            size += batch.column(batch.schema.get_field_index("text")).nbytes
            if size > 1 << 22:
                key = held.column("key").to_numpy()
                last = int(np.searchsorted(key, key[-1]))
                if last:
                    yield found(held.slice(0, last))
                    held, size = held.slice(last), 0
        if held is not None and len(held):
            yield found(held)

    dealt = rows.select("key", "rep", "side", "comp", "text").repartition(parts(rows), "key").sortWithinPartitions("key", "rep")
    with arrow_rows(rows.sparkSession, 256):
        return dealt.mapInArrow(run, f"a {kind}, b {kind}")


def _least_common(n: Column, least: int) -> Column:
    """What a pair must have in common before the end of the prefix of the set of size n, less what it must have in common at all."""
    return F.floor(-n * least / 100 + 1e-6) + 1


def _pairs(held: DataFrame, least: int) -> DataFrame:
    """(a, b): sets that shingles of PAIR_SETS sets at most of held(rep, n, shingle, met, shared, wide) join, where what they have in common there, and may have in others, is enough.

    Two sets have at most so much in common as the first shingles up to the end of one's prefix leave possible: it is short of that one's
    size by its prefix's shingles that the other lacks. Of the shingles of more sets, all might be common. A shingle makes fewer than
    PAIR_SETS / 2 pairs for each of its sets, of which those of sets that share too little with any others are never made.
    """
    need = F.ceil((F.col("x.n") + F.col("y.n")) * (least / (100 + least)) - 1e-6)
    least_common = F.least(*[need + _least_common(F.col(c), least) for c in ("x.n", "y.n")])
    fits = F.least("x.n", "y.n") * 100 >= F.greatest("x.n", "y.n") * least
    sets = held.where(F.col("met") <= PAIR_SETS).groupBy("shingle").agg(F.sort_array(F.collect_list(F.struct("rep", "n", "shared", "wide"))).alias("sets"))
    pairs = sets.select(F.posexplode("sets").alias("at", "x"), "sets").select("x", F.explode(F.slice("sets", F.col("at") + 2, F.lit(PAIR_SETS))).alias("y"))
    pairs = pairs.where(fits & (F.least("x.shared", "y.shared") >= least_common))
    pairs = pairs.select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"), (least_common - F.least("x.wide", "y.wide")).alias("lacks"))
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("common"), F.first("lacks").alias("lacks")).where("common >= lacks").select("a", "b")


def _clusters(s: Scratch, reps: DataFrame, least: int) -> DataFrame:
    """(node, comp) of the sets that share deciding shingles with another of a fitting size, by itself or others between them.

    Of a shingle of PAIR_SETS sets at most the pairs are looked at: the more sets there are, the more of them meet by chance, and clusters of
    those would grow together. Others meet under keys: sizes fall into classes of equal ratios, SIZE_CLASSES of them up to the largest ratio that can link. How many first shingles
    of a set decide depends on the other's size: the nearer the sizes, the more must be common. So a shingle meets
    another set's under a key for each pair of classes, if it stands among those that decide there, and if its set shares as many shingles
    with any others as it would have to share with one of that class.
    """
    by_shingle, by_rep = Window.partitionBy("shingle"), Window.partitionBy("rep")
    held = reps.select("rep", "n", F.posexplode("prefix").alias("pos", "shingle"))
    held = held.withColumn("met", F.count(F.lit(1)).over(by_shingle)).where("met > 1")
    held = s.cut(held.withColumns({"shared": F.count(F.lit(1)).over(by_rep), "wide": F.count_if(F.col("met") > PAIR_SETS).over(by_rep)}), "shared")
    step = math.log(100 / least) / SIZE_CLASSES * (1 + 1e-9)
    share = least / (100 + least)
    # A little below the smallest size of a class, and above its largest, so that rounding never takes a shingle away.
    low = lambda c: F.exp(c * step) * (1 - 1e-9)
    high = lambda c: F.exp((c + 1) * step) * (1 + 1e-9)
    own = F.floor(F.log("n") / step).cast("int")
    need = lambda other: F.ceil((F.col("n") + low(other)) * share - 1e-6)
    enough = lambda other: F.col("shared") >= F.least(need(other) + _least_common(F.col("n"), least), F.col("n") * share - high(other) * (least / 100 - share) - 1e-6)
    decides = lambda other: (F.col("pos") < F.col("n") - need(other) + 1) & enough(other)
    as_smaller = [F.when(decides(F.col("class") + d), F.struct(F.col("class").alias("class"), F.lit(d).alias("apart"), F.lit(0).alias("role"))) for d in range(SIZE_CLASSES + 1)]
    as_larger = [F.when(decides(F.col("class") - d), F.struct((F.col("class") - d).alias("class"), F.lit(d).alias("apart"), F.lit(1).alias("role"))) for d in range(1, SIZE_CLASSES + 1)]
    keyed = held.where(F.col("met") > PAIR_SETS).withColumn("class", own).withColumn("key", F.explode(F.array_compact(F.array(*as_smaller, *as_larger)))).select("shingle", "key.*", "rep")
    by_key = Window.partitionBy("shingle", "class", "apart")
    met = keyed.withColumns({"leader": F.min("rep").over(by_key), "from": F.min("role").over(by_key), "to": F.max("role").over(by_key)})
    # Of different classes a key needs sets of both; all of them then hang together by the smallest.
    met = met.where("leader <> rep AND (apart = 0 OR from < to)").select(F.col("leader").alias("a"), F.col("rep").alias("b"))
    return _spark.components(met.union(_pairs(held, least)).distinct())


def _joined(s: Scratch, comps: DataFrame, links: DataFrame) -> DataFrame:
    """comps(rep, comp) after the components that links(a, b) join have become one."""
    moved = _spark.components(links)
    to = moved.select("node", F.col("comp").alias("to"))
    out = s.cut(comps.join(to, F.col("comp") == F.col("node"), "left").select("rep", F.coalesce("to", "comp").alias("comp")), "comps")
    _spark.drop_cut(moved)
    return out


def _large(s: Scratch, members: DataFrame, large: DataFrame, comps: DataFrame, k: int, least: int) -> DataFrame:
    """comps after the blocks of the large clusters have met: the same and the next class of sizes, the first block of each before the others."""
    # A little wider than the largest ratio of sizes, so that rounding never parts neighbours.
    step = math.log(100 / least) * (1 + 1e-9)
    sized = members.join(large, "cluster").withColumn("class", F.floor(F.log("n") / F.lit(step)).cast("int"))
    count = sized.groupBy("cluster", "class").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_SETS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    sized = s.cut(sized.join(count, ["cluster", "class"]).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")), "blocks")
    turns = ((F.col("x_class") == F.col("class")) & (F.col("x_block") == F.col("block")), (F.col("x_block") == 0) | (F.col("block") == 0), F.lit(True))
    done = None
    for turn in turns:
        now = sized.join(comps, "rep")
        block = s.cut(now.groupBy("cluster", "class", "block").agg(F.min("comp").alias("low"), F.max("comp").alias("high")), "nodes")
        other = block.select("cluster", *[F.col(c).alias("x_" + c) for c in ("class", "block", "low", "high")])
        # What is one component need not meet itself; a set's size class meets its own and the next.
        pairs = block.join(other, "cluster").where(
            (((F.col("x_class") == F.col("class")) & (F.col("x_block") >= F.col("block"))) | (F.col("x_class") == F.col("class") + 1)) & turn
            & ((F.col("low") != F.col("high")) | (F.col("x_low") != F.col("x_high")) | (F.col("low") != F.col("x_low")))
        ).select("cluster", "class", "block", "x_class", "x_block", "low", "high", "x_low", "x_high")
        pairs = s.cut(pairs if done is None else pairs.join(done, ["cluster", "class", "block", "x_class", "x_block"], "left_anti"), "node-pairs")
        names = pairs.select("cluster", "class", "block", "x_class", "x_block")
        done = names if done is None else done.union(names)
        if not pairs.limit(1).count():
            continue
        key = F.xxhash64("cluster", "class", "block", "x_class", "x_block").alias("key")
        alone = (F.col("class") == F.col("x_class")) & (F.col("block") == F.col("x_block"))
        one = pairs.select("cluster", "class", "block", key, F.when(alone, -1).otherwise(0).alias("side"), F.col("x_low").alias("low"), F.col("x_high").alias("high"))
        two = pairs.where(~alone).select("cluster", F.col("x_class").alias("class"), F.col("x_block").alias("block"), key, F.lit(1).alias("side"), "low", "high")
        rows = now.join(one.union(two), ["cluster", "class", "block"]).where((F.col("low") != F.col("high")) | (F.col("comp") != F.col("low")))
        links = s.cut(_searched(rows, k, least), "links")
        if links.limit(1).count():
            comps = _joined(s, comps, links)
    return comps


def linked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = WORDS, least: int = LEAST) -> DataFrame:
    """One row a document: its id, n_shingles and component_id, the smallest id reachable by links of at least ``least`` per cent."""
    with Scratch() as s:
        return s.keep(_linked(s, docs, id_col, text_col, k, least)).withColumnRenamed("id", id_col)


def _linked(s: Scratch, docs: DataFrame, id_col: str, text_col: str, k: int, least: int) -> DataFrame:
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # Rows are told apart by their ids, or, where these are null or repeated, by numbers of their own.
    plain = not texts.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR id IS NULL").limit(1).count()
    keyed = texts.withColumn("key", F.col("id")) if plain else s.cut(texts.withColumn("key", F.monotonically_increasing_id()), "keyed")
    sets = s.cut(signed(keyed, counters(keyed, "text", k), "key", "text", k, least), "sets")
    reps = sets.where("n > 0").groupBy("h1", "h2").agg(F.min(F.struct("id", "n", "prefix")).alias("m"))
    reps = s.cut(reps.select("h1", "h2", F.col("m.id").alias("rep"), F.col("m.n").alias("n"), F.col("m.prefix").alias("prefix")), "reps")
    clusters = _clusters(s, reps, least)
    members = s.cut(reps.select("rep", "n").join(clusters.select(F.col("node").alias("rep"), F.col("comp").alias("cluster")), "rep"), "members")
    _spark.drop_cut(clusters)
    # Merged at every size: the texts are dealt out once, however many are candidates.
    members = s.cut(members.hint("merge").join(keyed.select(F.col("key").alias("rep"), "text"), "rep"), "texts")
    count = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("sets"), F.sum("n").alias("shingles"))
    large = s.cut(count.where((F.col("sets") > BLOCK_SETS) | (F.col("shingles") > BLOCK_SHINGLES)).select("cluster"), "large")
    small = members.join(large, "cluster", "left_anti").select(F.xxhash64("cluster").alias("key"), "rep", F.lit(-1).alias("side"), F.col("rep").alias("comp"), "text")
    # What a task finds in a small cluster is final: its sets meet no others.
    stars = s.cut(_searched(small, k, least), "links")
    comps = s.cut(members.select("rep").join(stars, F.col("rep") == F.col("b"), "left").select("rep", F.coalesce("a", "rep").alias("comp")), "comps")
    if large.limit(1).count():
        comps = _large(s, members, large, comps, k, least)
    named = reps.select("h1", "h2", "rep").join(comps, "rep", "left").select("h1", "h2", F.coalesce("comp", "rep").alias("comp"))
    found = salted_join(sets.where("n > 0").select(F.col("id").alias("key"), "n", "h1", "h2"), named, ["h1", "h2"], "key").select("key", "n", "comp")
    found = found.unionByName(sets.where("n = 0").select(F.col("id").alias("key"), "n", F.col("id").alias("comp")))
    if plain:
        return s.cut(found.select(F.col("key").alias("id"), F.col("n").alias("n_shingles"), F.col("comp").alias("component_id")), "found")
    rows = s.cut(found.join(keyed.select("key", "id"), "key"), "found")
    least_id = rows.groupBy("comp").agg(F.min("id").alias("component_id"))
    return s.cut(salted_join(rows, least_id, ["comp"], "key").select("id", F.col("n").alias("n_shingles"), "component_id"), "found")
