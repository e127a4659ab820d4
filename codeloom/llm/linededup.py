"""Line dedup: later copies of passages of MIN_RUN words or more are deleted, wherever in a line they begin.

Shared passages seldom begin and end with a line, so the lines compared are the
runs of LINE words from every word on. Winnowing selects, of each WINDOW
consecutive line hashes, a minimum: two texts that share LINE + WINDOW - 1 words
share a selected line. Selected lines are joined by hash with their first
occurrence in the corpus (smallest document id, then position); matches whose lines touch form a run,
which is extended word by word both ways, against the words before the source of
its first line and after the source of its last one. Runs that touch are merged,
and those of MIN_RUN words or more are deleted, with the white space after them.

With line_words, whole lines of the text (between line breaks) of so many words or more
are hashed and joined in the same way, and later ones are deleted however short the run.

A deleted run occurs, in pieces at least, in documents of smaller ids, or (within)
at smaller positions of its own; a passage's first occurrence is never deleted. With
within, a line that overlaps its first occurrence is no repeat, so the first words of
a text of one short period stay. Without it, repeats within one document stay.

Cases: a null text stays null; texts of fewer than MIN_RUN words stay as they are but for
whole lines; of equal texts only the one with the smallest id keeps its words; rows of
equal ids count as one document, and each loses what its own text repeats; an
empty table gives an empty table; rows with a null id stay as they are; texts of any
length are worked on whole. Further columns are passed through, whatever their names
(those named removed_words or spans give way to the results with details); n_chars, where
there is one, becomes the new length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from codeloom.llm._spark import FEW_ROWS, Scratch, arrow_rows, few_rows, free, heavy_of, salted_join
from codeloom.llm._text import U, VISIBLE, Words, _power, chunks, grams, mix, spread

LINE, WINDOW = 26, 25
MIN_RUN = LINE + WINDOW - 1
_LAST = U((1 << 64) - 1)


def _slide(x: np.ndarray, w: int, best) -> np.ndarray:
    """best of each w consecutive values, by doubling."""
    out, have = x, 1
    while have < w:
        step = min(have, w - have)
        out = best(out[:-step], out[step:])
        have += step
    return out


def winnow(words: Words, line: int = LINE, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(word index, hash) of the selected lines; of equal ones within window words of each other one in window words."""
    h, whole = grams(words, line)
    n = len(h)
    if n < window:
        return np.zeros(0, np.int64), np.zeros(0, U)
    h = np.where(whole, h >> U(1), _LAST)
    low = _slide(h, window, np.minimum)
    inside = np.arange(n - window + 1)
    low[~whole[window - 1 :] | (words.row[: n - window + 1] != words.row[window - 1 :])] = 0
    low[~whole[inside]] = 0
    pad = np.zeros(window - 1, U)
    high = _slide(np.concatenate([pad, low, pad]), window, np.maximum)
    chosen = np.flatnonzero((high == h) & whole)
    # Equal lines that follow each other within a window (a text of short period): one in window words stays.
    order = np.lexsort((chosen, h[chosen], words.row[chosen]))
    at = chosen[order]
    apart = np.append(True, (h[at][1:] != h[at][:-1]) | (words.row[at][1:] != words.row[at][:-1]) | (np.diff(at) >= window))
    start = at[np.maximum.accumulate(np.where(apart, np.arange(len(at)), 0))] if len(at) else at
    place = (at - start) // window
    chosen = np.sort(at[apart | np.append(True, place[1:] != place[:-1])]) if len(at) else at
    return chosen, h[chosen]


def _words(texts: pa.Array) -> Words:
    return Words(*spread(texts.cast(pa.large_string())), VISIBLE)


def whole_lines(words: Words, data: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word index, number of words, hash) of the lines, between line breaks, of least words or more."""
    n = len(words.hash)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U)
    line = np.searchsorted(np.flatnonzero(data == 10), words.start)
    first = np.flatnonzero(np.append(True, (line[1:] != line[:-1]) | (words.row[1:] != words.row[:-1])))
    size = np.diff(np.append(first, n))
    first, size = first[size >= least], size[size >= least]
    prefix = np.append(U(0), np.cumsum(mix(words.hash + U(3)) * _power("up", n)))
    return first, size, mix((prefix[first + size] - prefix[first]) * _power("down", n + 1)[first] + size.astype(U))


def selected(docs: DataFrame, id_col: str, text_col: str, line_words: int | None = None) -> DataFrame:
    """(hash, id, version, pos, words): the selected lines of each document; words is null but for whole lines of the text.

    version tells the texts of repeated ids apart; it is 0 where no id is repeated.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in chunks(batch.column(1).cast(pa.large_string())):
                data, offsets = spread(batch.column(1).slice(a, b - a).cast(pa.large_string()))
                words = Words(data, offsets, VISIBLE)
                at, h = winnow(words)
                size = np.zeros(len(at), np.int64)
                if line_words:
                    first, more, own = whole_lines(words, data, line_words)
                    at, h, size = np.append(at, first), np.append(h, own >> U(1)), np.append(size, more)
                row = words.row[at]
                ids, version = (batch.column(i).slice(a, b - a).take(pa.array(row)) for i in (0, 2))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h.astype(np.int64)), ids, version, pa.array((at - words.first[row]).astype(np.int32)), pa.array(size.astype(np.int32), mask=size == 0)], ["hash", "id", "version", "pos", "words"]
                )

    rows = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), _version(docs, id_col, text_col).alias("version"))
    return rows.mapInArrow(run, f"hash long, id {kind}, version long, pos int, words int")


def _version(docs: DataFrame, id_col: str, text_col: str) -> Column:
    repeated = docs.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count()
    return F.xxhash64(text_col) if repeated else F.lit(0).cast("long")


def runs(s: Scratch, docs: DataFrame, id_col: str, text_col: str, within: bool = False, line_words: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Spans of a document that selected lines with earlier occurrences cover, before they are extended; and repeated whole lines (id, version, start, words, source).

    Spans: (id, version, start, end, sources, left, left_at, right, right_at, floor): words [start, end)
    of the document; the first line stands at word left_at of document left, the last
    one ends before word right_at of document right. Words before floor belong to the
    first line's source and are not part of the span.
    """
    lines = s.cut(selected(docs, id_col, text_col, line_words), "lines")
    first = lines.groupBy("hash").agg(F.min(F.struct("id", "pos")).alias("m"), F.max(F.struct("id", "pos") if within else F.col("id")).alias("last"), F.count(F.lit(1)).alias("n"))
    first = s.cut(first.where(F.col("last") > (F.col("m") if within else F.col("m.id"))).select("hash", "n", F.col("m.id").alias("source"), F.col("m.pos").alias("source_pos")), "first")
    later = F.col("id") > F.col("source")
    if within:
        later |= (F.col("id") == F.col("source")) & (F.col("pos") >= F.col("source_pos") + F.coalesce("words", F.lit(LINE)))
    # A line that very many documents hold is dealt to several tasks.
    every = salted_join(lines, first.drop("n"), ["hash"], "id", hot=heavy_of(first, ["hash"], lines.count()), merge=True)
    every = s.cut(every.where(later).select("id", "version", "source", "pos", "source_pos", "words"), "met")
    s.drop(lines)
    s.drop(first)
    whole = every.where("words is not null").select("id", "version", F.col("pos").alias("start"), "words", "source")
    met = every.where("words is null").select("id", "version", "source", "pos", "source_pos")
    w = Window.partitionBy("id", "version").orderBy("pos")
    marked = met.withColumn("new", F.coalesce((F.col("pos") - F.lag("pos").over(w) > LINE).cast("int"), F.lit(1)))
    numbered = marked.withColumn("span", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    at = F.struct("pos", "source", "source_pos")
    spans = numbered.groupBy("id", "version", "span").agg(F.min(at).alias("a"), F.max(at).alias("b"), F.array_sort(F.collect_set("source")).alias("sources"))
    return s.cut(spans.select(
        "id", "version", F.col("a.pos").alias("start"), (F.col("b.pos") + LINE).alias("end"), "sources", F.col("a.source").alias("left"), F.col("a.source_pos").alias("left_at"),
        F.col("b.source").alias("right"), (F.col("b.source_pos") + LINE).alias("right_at"),
        F.when(F.col("a.source") == F.col("id"), F.col("a.source_pos") + LINE).otherwise(0).alias("floor"),
    ), "runs"), whole


def _around(docs: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(source, at, before, after): hashes of up to WINDOW words on both sides of each place at which a span's source begins or ends."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in chunks(batch.column(1).cast(pa.large_string())):
                words = _words(batch.column(1).slice(a, b - a))
                out: tuple[list, ...] = ([], [], [], [])
                for row, (doc, places) in enumerate(zip(batch.column(0).slice(a, b - a).to_pylist(), batch.column(2).slice(a, b - a).to_pylist())):
                    h = words.hash[words.first[row] : words.first[row + 1]].astype(np.int64)
                    for at in places:
                        for column, value in zip(out, (doc, at, h[max(0, at - WINDOW) : at], h[at : at + WINDOW])):
                            column.append(value)
                kinds = [batch.column(0).type, pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["source", "at", "before", "after"])

    places = found.select(F.col("left").alias("source"), F.col("left_at").alias("at")).union(found.select("right", "right_at")).distinct()
    places = places.groupBy("source").agg(F.collect_list("at").alias("places"))
    # Merged at every size, as in dedup(): the texts are dealt out once for each, however few spans there are.
    rows = docs.select(F.col(id_col).alias("source"), F.col(text_col).alias("text")).hint("merge").join(places, "source").select("source", "text", "places")
    return rows.mapInArrow(run, f"source {kind}, at int, before array<long>, after array<long>").dropDuplicates(["source", "at"])


def _extend(h: np.ndarray, x: dict) -> tuple[int, int]:
    """The span's first word and the word after its last, extended while the words agree with the source's."""
    start, end = x["start"], x["end"]
    for word in reversed(x["before"]):
        if start <= x["floor"] or start > len(h) or h[start - 1] != word:
            break
        start -= 1
    for word in x["after"]:
        if end >= len(h) or h[end] != word:
            break
        end += 1
    return start, end


def _spans(h: np.ndarray, found: list[dict], whole: list[dict], least: int) -> list[tuple[int, int, list]]:
    """What goes: merged spans of least words or more, and repeated whole lines: first word, word after the last, sources."""
    merged: list[list] = []
    for start, end, sources in sorted((*_extend(h, x), x["sources"]) for x in found):
        if merged and start <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
            merged[-1][2] = merged[-1][2] + sources
        else:
            merged.append([start, end, sources])
    out: list[list] = []
    for start, end, sources in sorted([x for x in merged if x[1] - x[0] >= least] + [[x["start"], x["start"] + x["words"], [x["source"]]] for x in whole]):
        if out and start < out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
            out[-1][2] = out[-1][2] + sources
        else:
            out.append([start, end, sources])
    return [(a, b, sorted(set(s))) for a, b, s in out]


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = MIN_RUN, details: bool = False, within: bool = False, line_words: int | None = None) -> DataFrame:
    """docs with later repeated runs deleted from the texts; within: those of the same document too; line_words: and whole lines of so many words; with details also removed_words and spans(start, words, sources)."""
    with Scratch() as s, arrow_rows(docs.sparkSession, FEW_ROWS):
        return _cleaned(docs, s.keep(_repeated(s, docs, id_col, text_col, within, line_words)), id_col, text_col, least, details)


def _repeated(s: Scratch, docs: DataFrame, id_col: str, text_col: str, within: bool, line_words: int | None) -> DataFrame:
    """(id, version, found, whole): what is repeated in each document that repeats anything."""
    found, whole = runs(s, docs, id_col, text_col, within, line_words)
    around = s.cut(_around(docs, found, id_col, text_col), "around")
    before = around.select(F.col("source").alias("left"), F.col("at").alias("left_at"), "before")
    after = around.select(F.col("source").alias("right"), F.col("at").alias("right_at"), "after")
    sided = salted_join(salted_join(found, before, ["left", "left_at"], "id"), after, ["right", "right_at"], "id", counted=found)
    spans = sided.select("id", "version", F.struct("start", "end", "sources", "floor", "before", "after").alias("s"), F.lit(None).cast(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("words", T.IntegerType()), T.StructField("source", docs.schema[id_col].dataType)])).alias("w"))
    lines = whole.select("id", "version", F.lit(None).cast(spans.schema["s"].dataType).alias("s"), F.struct("start", "words", "source").alias("w"))
    return s.cut(spans.union(lines).groupBy("id", "version").agg(F.collect_list("s").alias("found"), F.collect_list("w").alias("whole")), "repeated")


def _cleaned(docs: DataFrame, repeated: DataFrame, id_col: str, text_col: str, least: int, details: bool) -> DataFrame:
    names, at = docs.columns, docs.columns.index(text_col)
    length = names.index("n_chars") if "n_chars" in names else None
    extra = ["removed_words", "spans"] if details else []
    kept = [i for i, c in enumerate(names) if c not in extra]
    spans_type = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("words", T.LongType()), T.StructField("sources", T.ArrayType(docs.schema[id_col].dataType))]))
    schema = T.StructType([docs.schema[i] for i in kept] + ([T.StructField("removed_words", T.LongType()), T.StructField("spans", spans_type)] if details else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_rows(batches):
            texts = batch.column(at).to_pylist()
            removed, spans = [0] * len(texts), [[] for _ in texts]
            lists, wholes = batch.column(len(names)), batch.column(len(names) + 1)
            for row in np.flatnonzero(lists.is_valid().to_numpy(zero_copy_only=False)).tolist():
                if texts[row] is None:
                    continue
                raw = texts[row].encode("utf-8", "surrogatepass")
                words = Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), VISIBLE)
                parts, last = [], 0
                for start, end, sources in _spans(words.hash.astype(np.int64), lists[row].as_py(), wholes[row].as_py(), least):
                    parts.append(raw[last : words.start[start]])
                    last = int(words.start[end]) if end < len(words.start) else len(raw)
                    removed[row] += end - start
                    spans[row].append({"start": start, "words": end - start, "sources": sources})
                if last:
                    texts[row] = b"".join([*parts, raw[last:]]).decode("utf-8", "surrogatepass").rstrip(" ")
            columns = list(batch.columns[: len(names)])
            columns[at] = pa.array(texts, pa.string())
            if length is not None:
                now = [None if t is None else len(t) for t in texts]
                columns[length] = pa.array([x if r else old for x, r, old in zip(now, removed, columns[length].to_pylist())], columns[length].type)
            columns = [columns[i] for i in kept]
            if details:
                kinds = pa.list_(pa.struct([("start", pa.int64()), ("words", pa.int64()), ("sources", pa.list_(batch.column(names.index(id_col)).type))]))
                columns += [pa.array(removed, pa.int64()), pa.array(spans, kinds)]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    own, version, found, whole = (free(docs, c) for c in ("_id", "_version", "_found", "_whole"))
    marked = repeated.toDF(own, version, found, whole)
    same = (docs[id_col] == marked[own]) & (_version(docs, id_col, text_col) == marked[version])
    joined = docs.hint("merge").join(marked, same, "left").select(*[docs[c] for c in names], found, whole)
    return joined.mapInArrow(run, schema)
