"""Near-duplicate classes by improved consistent weighted sampling over TF-IDF shingles.

A text's shingles are its runs of five words (letters, marks and digits, lower case), a
shorter text's the run of all its words. A shingle's weight is its count times its
smoothed inverse document frequency, 1 + IDF_SPAN * ln(p) / ln(RARE), where
p = max(df / N, RARE), for sampling and for verification. (Unsmoothed, what
the near copies of a group share would hardly count where the group holds a third
of all rows: its links would fail, or its members share no band.) The document
frequency df is exact for every shingle that more than a share RARE of the documents
hold: lossy counting over all documents finds a bounded set of candidates without
missing one, and a second pass counts these. Rarer ones weigh alike. ROUNDS
independent samplers each deal the shingles to BANDS bins by a hash and take each
bin's improved consistent weighted sample; band j joins the j-th bins. Documents that
share a band are candidates, verified by weighted Jaccard similarity over whole texts.

Documents of equal words form one representative first. Each representative is
compared with one leader, the smallest member of the bucket that it shares most bands
with; then with the other leaders of its buckets that are not in its class by then.
Buckets that hold several classes after that compare further members, STEP times as
many each round, with those of other classes, until no pair of different classes is
left in a bucket but those that cannot be similar: by their distances from a leader
that both were compared with (one minus the similarity is a metric), or by the weight of
the shingles that no other open text holds. So no link that a shared band shows is
lost. Classes are the components of the verified links.

Cases: a null text is empty; texts without words form one class; equal texts, and
texts that differ in case or punctuation only, always share a class; repeated ids
are one document if their texts agree and else each joins its text's class; an
empty table gives an empty table; texts of any length are read whole; null ids
are left out; ties go to the smaller id. Further columns are not read, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from codeloom.llm._spark import Scratch, arrow_rows, components, salted_join
from codeloom.llm._text import LETTERS, SHINGLE_BITS, U, Words, _power, chunks, mix, shingle_counts, spread

WORDS, SIMILARITY = 5, 0.8
ROUNDS, BANDS = 8, 40
RARE = 1 / 256
#: A rare shingle weighs 1 + IDF_SPAN, one that all documents hold 1.
IDF_SPAN = 0.25
#: Rows that one lossy count of shingles covers at least; it leaves out those under an eighth of RARE of its rows.
COUNT_ROWS = 4096
#: Texts, and pairs of texts, that go to Python at once: each may be long.
TEXT_ROWS, PAIR_ROWS = 2048, 256
#: Bucket members that one task compares with a round's leads.
BUCKET_ROWS = 1024
#: How many times as many members each round compares.
STEP = 16
#: What stands between words outside of ASCII.
_BETWEEN = r"[^\x00-\x7F\pL\pM\pN]"


def _lowered(column: pa.Array) -> pa.Array:
    """Lower-case texts; punctuation and blanks outside of ASCII become plain blanks."""
    column = column.cast(pa.large_string())
    column = pc.utf8_lower(column.fill_null("") if column.null_count else column)
    odd = pc.match_substring_regex(column, _BETWEEN)
    if pc.any(odd).as_py():
        column = pc.replace_with_mask(column, odd, pc.replace_substring_regex(column.filter(odd), _BETWEEN, " "))
    return column


def _words(column: pa.Array) -> Iterator[tuple[int, int, Words]]:
    lowered = _lowered(column)
    for a, b in chunks(lowered):
        data, offsets = spread(lowered.slice(a, b - a))
        yield a, b, Words(data, offsets, LETTERS)


class Weights:
    """Weights of shingles; common, df: the shingles that more than RARE of n documents hold, ascending, and their counts."""

    def __init__(self, common: np.ndarray, df: np.ndarray, n: int):
        self.common = common
        share = np.append(np.maximum(df / max(n, 1), RARE), RARE)
        self.idf = 1 + IDF_SPAN * np.log(share) / math.log(RARE)

    def __call__(self, shingles: np.ndarray, counts: np.ndarray) -> np.ndarray:
        if not len(self.common):
            return counts * self.idf[-1]
        at = np.searchsorted(self.common, shingles)
        at[at == len(self.common)] = 0
        return counts * self.idf[np.where(self.common[at] == shingles, at, len(self.common))]


def _common(docs: DataFrame, n: int, k: int) -> np.ndarray:
    """Shingles, ascending, among them all that more than RARE of the n documents hold; at most 8 / (7 * RARE) times as many as a mean document has."""
    tasks = max(1, n // COUNT_ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, size = [], 0, 0

        def out() -> pa.RecordBatch:
            found, df = np.unique(np.concatenate(held), return_counts=True)
            keep = df >= rows * RARE / 8
            return pa.RecordBatch.from_arrays([pa.array(found[keep].astype(np.int64)), pa.array(df[keep].astype(np.int64))], ["shingle", "df"])

        for batch in batches:
            for a, b, words in _words(batch.column(0)):
                held.append(shingle_counts(words, b - a, k)[1])
                rows, size = rows + b - a, size + len(held[-1])
            if rows >= 2 * COUNT_ROWS and size > 1 << 22:
                yield out()
                held, rows, size = [], 0, 0
        if held:
            yield out()

    # What a count leaves out is under RARE / 8 of its rows, so a true df over n * RARE keeps 7 / 8 of that.
    counted = docs.coalesce(tasks).mapInArrow(run, "shingle long, df long").groupBy("shingle").agg(F.sum("df").alias("df"))
    found = counted.where(F.col("df") > max(1, n * RARE * 7 / 8)).select("shingle").orderBy("shingle").toPandas()
    return found["shingle"].to_numpy(np.uint64)


def weigh(docs: DataFrame, text_col: str = "text", k: int = WORDS) -> Weights:
    """The exact document frequencies of the common shingles, over all documents."""
    n, texts = docs.count(), docs.select(F.col(text_col).alias("text"))
    common = _common(texts, n, k)
    if not len(common):
        return Weights(common, np.zeros(0), n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(len(common), np.int64)
        for batch in batches:
            for a, b, words in _words(batch.column(0)):
                shingle = shingle_counts(words, b - a, k)[1]
                at = np.searchsorted(common, shingle)
                at[at == len(common)] = 0
                df += np.bincount(at[common[at] == shingle], minlength=len(common))
        place = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(df[place])], ["place", "df"])

    exact = texts.mapInArrow(run, "place long, df long").groupBy("place").agg(F.sum("df").alias("df")).where(F.col("df") > max(1, n * RARE)).orderBy("place").toPandas()
    return Weights(common[exact["place"].to_numpy(np.int64)], exact["df"].to_numpy(np.float64), n)


_SEEDS = [U(0xA24BAED4963EE407 * (2 * i + 1) % (1 << 64)) for i in range(64)]
_UNIT = 1 / (1 << 32)


def _uniform(bits: np.ndarray) -> np.ndarray:
    return (bits.astype(np.float64) + 0.5) * _UNIT


def sample(rows: int, row: np.ndarray, shingle: np.ndarray, weight: np.ndarray, rounds: int = ROUNDS, bands: int = BANDS) -> np.ndarray:
    """A hash for each row and band, of one consistent weighted sample a round; rows without shingles get garbage."""
    out, log_weight, low = np.zeros((rows, bands), U), np.log(weight), U((1 << 32) - 1)
    for i in range(rounds):
        h = mix(shingle ^ _SEEDS[i])
        one, two = mix(h + _SEEDS[i + 20]), mix(h + _SEEDS[i + 40])
        r = -np.log(_uniform(one >> U(32)) * _uniform(one & low))
        c = -np.log(_uniform(two >> U(32)) * _uniform(two & low))
        beta = _uniform(h & low)
        t = np.floor(log_weight / r + beta)
        rank = np.log(c) - r * (t - beta + 1)
        slot = row * bands + ((h >> U(40)) % U(bands)).astype(np.int64)
        best = np.full(rows * bands, np.inf)
        np.minimum.at(best, slot, rank)
        won = np.flatnonzero(rank == best[slot])
        got = np.zeros(rows * bands, U)
        got[slot[won]] = mix(h[won] + t[won].astype(np.int64).astype(U) * U(0x9E3779B97F4A7C15)) | U(1)
        got = got.reshape(rows, bands)
        # An empty bin takes the sample of the next bin that has one, marked by the distance.
        if not got.all():
            twice = np.where(np.concatenate([got, got], 1) != 0, np.arange(2 * bands), 2 * bands)
            far = np.minimum.accumulate(twice[:, ::-1], 1)[:, ::-1][:, :bands]
            step = (far - np.arange(bands)).astype(U)
            got = np.where(step > 0, mix(np.take_along_axis(got, far % bands, 1) + step) | U(1), got)
        out += mix(got ^ _SEEDS[i + 7])
    return mix(out + np.arange(bands, dtype=U) * U(0xD6E8FEB86659FD93))


def similarity(pairs: int, a: tuple, b: tuple) -> np.ndarray:
    """Weighted Jaccard similarity of row i of a and row i of b, each (row, shingle, weight); 1 where both are empty."""
    key = lambda x: (x[0].astype(U) << U(SHINGLE_BITS)) | x[1]
    ka, kb = key(a), key(b)
    total = np.bincount(a[0], a[2], pairs) + np.bincount(b[0], b[2], pairs)
    common, ia, ib = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
    both = np.bincount((common >> U(SHINGLE_BITS)).astype(np.int64), np.minimum(a[2][ia], b[2][ib]), pairs)
    return np.where(total > 0, both / np.maximum(total - both, 1e-12), 1.0)


def signatures(docs: DataFrame, weights: Weights, id_col: str, text_col: str, k: int = WORDS) -> DataFrame:
    """(id, h1, h2, bands): two hashes of the words, and the bands' hashes, none for a text without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, words in _words(batch.column(1)):
                row, shingle, count = shingle_counts(words, b - a, k)
                bands = sample(b - a, row, shingle, weights(shingle, count)).astype(np.int64)
                place = np.arange(len(words.hash)) - words.first[:-1][words.row]
                power = _power("up", int(place.max()) + 1 if len(place) else 1)
                whole = []
                for seed in (1, 2):
                    own = np.append(U(0), np.cumsum(mix(words.hash + U(seed)) * power[place]))
                    whole.append(mix(own[words.first[1:]] - own[words.first[:-1]] + np.diff(words.first).astype(U)).astype(np.int64))
                size = np.where(np.diff(words.first) > 0, BANDS, 0)
                flat = bands[size > 0].ravel()
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)), pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(whole[0]), pa.array(whole[1]), lists], ["id", "h1", "h2", "bands"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, h1 long, h2 long, bands array<long>")


def _verified(s: Scratch, pairs: DataFrame, texts: DataFrame, weights: Weights, least: float, k: int) -> DataFrame:
    """The pairs (a, b) with their texts' similarity (near), of those with least or more, as a table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ta, tb = (_lowered(batch.column(i)) for i in (2, 3))
            _, oa = spread(ta)
            _, ob = spread(tb)
            both, at = oa + ob, 0
            while at < len(batch):
                end = min(len(batch), max(at + 1, int(np.searchsorted(both, both[at] + (1 << 21), "right")) - 1))
                sides = []
                for t in (ta, tb):
                    row, shingle, count = shingle_counts(Words(*spread(t.slice(at, end - at)), LETTERS), end - at, k)
                    sides.append((row, shingle, weights(shingle, count)))
                near = similarity(end - at, *sides)
                keep = pa.array(near >= least)
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(at, end - at).filter(keep) for i in (0, 1)), pa.array(near).filter(keep)], ["a", "b", "near"])
                at = end

    named = lambda c: texts.select(F.col("rep").alias(c), F.col("text").alias("t" + c))
    # The heavy keys are those of the pairs alone: their texts come after.
    joined = salted_join(pairs, named("a"), ["a"], "b").join(named("b").hint("merge"), "b")
    kind = pairs.schema["a"].dataType.simpleString()
    with arrow_rows(pairs.sparkSession, PAIR_ROWS):
        return s.cut(joined.select("a", "b", "ta", "tb").mapInArrow(run, f"a {kind}, b {kind}, near double"), "scored")


def _sizes(s: Scratch, texts: DataFrame, weights: Weights, k: int) -> DataFrame:
    """(rep, whole, shared): a text's weight, and that of its shingles which another of the texts holds too."""
    kind = texts.schema["rep"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, words in _words(batch.column(1)):
                row, shingle, count = shingle_counts(words, b - a, k)
                weight, ids = weights(shingle, count), batch.column(0).slice(a, b - a)
                whole = np.bincount(row, weight, b - a)
                # A row for each shingle, and one with the sum, which is a text's own.
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.append(shingle.astype(np.int64), np.full(b - a, -1))), ids.take(pa.array(np.append(row, np.arange(b - a)))), pa.array(np.append(weight, whole))], ["shingle", "rep", "weight"]
                )

    with arrow_rows(texts.sparkSession, TEXT_ROWS):
        held = texts.select("rep", "text").mapInArrow(run, f"shingle long, rep {kind}, weight double")
        own = F.when(F.col("shingle") < 0, F.col("rep"))
        once = held.groupBy("shingle", own.alias("own")).agg(F.count(F.lit(1)).alias("n"), F.min("rep").alias("rep"), F.sum("weight").alias("weight")).where("n = 1")
        whole, alone = F.sum(F.when(F.col("shingle") < 0, F.col("weight"))), F.sum(F.when(F.col("shingle") >= 0, F.col("weight")))
        return s.cut(once.groupBy("rep").agg(whole.alias("whole"), (whole - F.coalesce(alone, F.lit(0.0))).alias("shared")), "sizes")


def _merged(s: Scratch, comps: DataFrame, links: DataFrame) -> DataFrame:
    """comps(rep, comp) after the classes that links(a, b) join have become one."""
    of = lambda end: comps.select(F.col("rep").alias(end), F.col("comp").alias("comp_" + end))
    ends = links.select("a", "b").join(of("a"), "a").join(of("b"), "b").select(F.col("comp_a").alias("a"), F.col("comp_b").alias("b"))
    joined = components(ends.where("a <> b")).withColumnRenamed("comp", "_to")
    return s.cut(comps.join(joined, F.col("comp") == F.col("node"), "left").select("rep", F.coalesce("_to", "comp").alias("comp")), "comps")


def _apart(pairs: DataFrame, comps: DataFrame) -> DataFrame:
    """The pairs (a, b) whose ends are in different classes."""
    of = lambda end: comps.select(F.col("rep").alias(end), F.col("comp").alias("comp_" + end))
    return pairs.join(of("a"), "a").join(of("b"), "b").where("comp_a <> comp_b").select("a", "b")


def _by_bucket(texts: DataFrame) -> DataFrame:
    """Rows of texts whose held lists their buckets, as a row for each bucket."""
    return texts.select(*[c for c in texts.columns if c != "held"], F.inline("held"))


def _met(left: DataFrame, low: int, high: int, least: float) -> DataFrame:
    """Pairs (a, b) of a bucket's leads, those with a place from low to below high, with later members of other classes, without those that cannot be similar.

    A pair that shares several open buckets is met in the first of them alone.
    """
    kept = left.withColumn("parts", F.ceil(F.col("n") / BUCKET_ROWS).cast("int"))
    part = F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")
    leads = kept.where(F.col("place").between(low, high - 1)).select("band", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), *[F.col(c).alias("x_" + c) for c in ("rep", "comp", "place", "bands", "pivot", "near", "whole", "shared")])
    met = kept.withColumn("part", part).join(leads, ["band", "part"])
    shared = F.least("shared", "x_shared")
    possible = shared >= (least - 1e-9) * (F.col("whole") + F.col("x_whole") - shared)
    close = (F.col("pivot") == F.col("x_pivot")) & (F.abs(F.col("near") - F.col("x_near")) > 1 - least + 1e-9)
    later = (F.col("place") > F.col("x_place")) | (F.col("place") == F.col("x_place")) & (F.col("rep") > F.col("x_rep"))
    first = F.array_min(F.array_intersect("bands", "x_bands")) == F.col("band")
    met = met.where(later & (F.col("comp") != F.col("x_comp")) & possible & ~F.coalesce(close, F.lit(False)) & first)
    return met.select(F.least("rep", "x_rep").alias("a"), F.greatest("rep", "x_rep").alias("b"))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY, k: int = WORDS) -> DataFrame:
    """One row a document: its id, rep_id (the smallest id with the same words), class_id (the class's smallest id), links and similarity.

    links: how many representatives its own was found similar to; similarity: the largest
    verified similarity of those (null without one).
    """
    with Scratch() as s, arrow_rows(docs.sparkSession, TEXT_ROWS):
        return s.keep(_classes(s, docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), least, k)).withColumnRenamed("id", id_col)


def _classes(s: Scratch, docs: DataFrame, least: float, k: int) -> DataFrame:
    weights = weigh(docs, "text", k)
    signed = s.cut(signatures(docs, weights, "id", "text", k), "signatures")
    reps = s.cut(signed.groupBy("h1", "h2").agg(F.min(F.struct("id", "bands")).alias("m")).select("h1", "h2", F.col("m.id").alias("rep"), F.col("m.bands").alias("bands")), "reps")
    rows = reps.select("rep", F.explode("bands").alias("band"))
    shared = rows.groupBy("band").agg(F.min("rep").alias("leader"), F.count(F.lit(1)).alias("n")).where("n > 1")
    members = s.cut(salted_join(rows, shared, ["band"], "rep"), "members")
    active = members.select("rep").distinct()
    texts = docs.select(F.col("id").alias("rep"), "text")
    texts = texts.dropDuplicates(["rep"]) if _repeats(signed) else texts
    # Merged at every size: the texts are dealt out once, however many documents are candidates.
    texts = s.cut(texts.hint("merge").join(active, "rep", "left_semi"), "texts")

    # One leader each, that of most bands; then those of other classes.
    asked = s.cut(members.where("rep <> leader").groupBy("leader", "rep").agg(F.count(F.lit(1)).alias("bands")), "asked")
    best = asked.groupBy("rep").agg(F.min(F.struct((-F.col("bands")).alias("o"), "leader")).alias("m")).select(F.col("m.leader").alias("a"), F.col("rep").alias("b"))
    scored = _verified(s, s.cut(best, "pairs"), texts, weights, 0.0, k)
    pivots = scored.select(F.col("a").alias("pivot"), F.col("b").alias("rep"), "near")
    found = [scored.where(F.col("near") >= least)]
    comps = s.cut(active.select("rep", F.col("rep").alias("comp")), "comps")
    comps = _merged(s, comps, found[0])
    others = asked.select(F.col("leader").alias("a"), F.col("rep").alias("b")).join(scored.select("a", "b"), ["a", "b"], "left_anti")
    others = s.cut(_apart(others, comps), "pairs")
    tested = scored.select("a", "b").union(others)
    found.append(_verified(s, others, texts, weights, least, k))
    comps = _merged(s, comps, found[1])

    # Members of buckets that still hold several classes, first of all with what rules out that they are similar.
    # What is known of a text is joined to one row of it, which lists its buckets.
    place = F.floor(F.pmod(F.xxhash64("rep", "band"), F.lit(1 << 30)) / (1 << 30) * F.col("n")).alias("place")
    now = _by_bucket(members.where("n > 2").groupBy("rep").agg(F.collect_list(F.struct("band", "n", place)).alias("held")).join(comps, "rep"))
    mixed = now.groupBy("band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("band")
    now = s.cut(now.join(mixed, "band", "left_semi"), "open")
    of_rep = s.cut(now.groupBy("rep", "comp").agg(F.collect_set("band").alias("bands"), F.collect_list(F.struct("band", "n", "place")).alias("held")), "held")
    texts = s.cut(texts.join(of_rep.select("rep"), "rep", "left_semi"), "open-texts")
    left = s.cut(of_rep.join(_sizes(s, texts, weights, k), "rep").join(pivots, "rep", "left"), "known")
    turn = 0
    while True:
        low, high = STEP**turn // STEP, STEP**turn
        if not left.where(F.exists("held", lambda h: h["place"] >= low)).limit(1).count():
            break
        fresh = s.cut(_met(_by_bucket(left), low, high, least).join(tested, ["a", "b"], "left_anti"), "pairs")
        tested = tested.union(fresh)
        links = _verified(s, fresh, texts, weights, least, k)
        if links.limit(1).count():
            found.append(links)
            comps = _merged(s, comps, links)
            left = s.cut(left.drop("comp").join(comps, "rep"), "open")
        turn += 1

    every = found[0]
    for links in found[1:]:
        every = every.union(links)
    ends = every.select(F.explode(F.array("a", "b")).alias("rep"), "near").groupBy("rep").agg(F.count(F.lit(1)).alias("links"), F.max("near").alias("similarity"))
    named = reps.select("h1", "h2", "rep").join(comps, "rep", "left").join(ends, "rep", "left")
    named = named.select("h1", "h2", F.col("rep").alias("rep_id"), F.coalesce("comp", "rep").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"), "similarity")
    return s.cut(salted_join(signed.select("id", "h1", "h2"), named, ["h1", "h2"], "id").select("id", "rep_id", "class_id", "links", "similarity"), "classes")


def _repeats(signed: DataFrame) -> bool:
    return bool(signed.groupBy("id").count().where("count > 1").limit(1).count())


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs without the rows whose id is not the smallest of their class; rows with a null id stay, and repeats of an id that stays are one row."""
    found = classes(docs, id_col, text_col, **how)
    with Scratch() as s:
        s.made.append(found)
        kept = s.keep(s.cut(found.where(F.col(id_col) == F.col("class_id")).select(F.col(id_col).alias("_kept")).distinct(), "kept"))
    once = docs.where(F.col(id_col).isNotNull())
    once = once.join(kept, once[id_col] == kept["_kept"], "left_semi")
    if _repeats(docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"))):
        once = once.dropDuplicates([id_col])
    return once.union(docs.where(F.col(id_col).isNull()))
