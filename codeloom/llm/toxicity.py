"""Toxicity: a weighted lexicon matched by Aho-Corasick on folded text, normalised by length, with exception phrases.

Folding lower-cases a text, replaces homoglyphs by Latin letters, undoes digit
and symbol substitutions, and turns what is left of punctuation into blanks. An
entry of the lexicon matches at the start of a word ("idiot" also in "idiots").
Occurrences inside an exception phrase do not count.

Cases: a null text is the empty text; an empty text, or one without a match, gets
the score of no evidence (below 0.5); ties and repeated rows are scored alike,
row by row; texts of any length are read whole; rows with a null id are scored, but
nothing is learned from them; an empty table gives an empty table; with no toxic or
no clean row to learn from, the lexicon is DEFAULT_LEXICON. Further columns are
neither read nor returned by score(), whatever their names; keep_clean() returns
the columns it gets, in order.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from codeloom.llm._spark import Scratch, few_rows

#: Characters that look like Latin letters, and what they look like.
HOMOGLYPHS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s",
    "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "ԁ": "d", "ӏ": "l",
    "α": "a", "ε": "e", "ο": "o", "ρ": "p", "ι": "i", "κ": "k", "τ": "t", "υ": "u", "ν": "v", "χ": "x",
    "ı": "i", "ⅰ": "i", "ℓ": "l",
}
#: Digits and symbols used in place of letters.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t"}
INNER = {"@": "a", "$": "s", "!": "i", "|": "l"}
#: Words known to be abusive before anything is learned.
DEFAULT_LEXICON = {w: 3.0 for w in ("idiot", "moron", "scum", "stupid", "worthless", "pathetic", "disgusting")}
DEFAULT_EXCEPTIONS = ("stupid question", "not stupid", "trash can", "clown fish")

#: Most labelled rows that the lexicon is learned from: toxic, clean.
SAMPLE = (1500, 3000)
STEM_LENGTHS = range(4, 9)
#: Most entries of a learned lexicon: those that explain most toxic rows of the sample come first.
MOST_ENTRIES = 400
#: Least log odds of an entry, and least toxic rows of the sample that hold it.
LEAST_ODDS, LEAST_ROWS = 2.3, 3
REJECT = 0.5

_full_width = {0xFF01 + i: 0x21 + i for i in range(94)}
_table = {ord(a): b for a, b in HOMOGLYPHS.items()} | {ord(a): b for a, b in SUBSTITUTES.items()}
_table |= {c: " " for c in range(128) if not chr(c).isalnum()}
_table |= {c: _table.get(to, chr(to).lower()) for c, to in _full_width.items()}
_inner = re.compile(r"(?<=[^\W\d_])[@$!|](?=[^\W\d_])")
_inner_maybe = re.compile(r"[@$!|]\w")
_blanks = re.compile(r"\s+")


def fold(text: str | None) -> str:
    """The folded text between two blanks."""
    text = (text or "").lower()
    if _inner_maybe.search(text):
        text = _inner.sub(lambda m: INNER[m[0]], text)
    return f" {_blanks.sub(' ', text.translate(_table)).strip()} "


@dataclass(frozen=True)
class Lexicon:
    """weights: of stems; exceptions: folded phrases; score = logistic(bias + slope * evidence)."""

    weights: dict[str, float]
    exceptions: tuple[str, ...] = DEFAULT_EXCEPTIONS
    bias: float = -3.0
    slope: float = 1.5


class Matcher:
    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon
        self.automaton = ahocorasick.Automaton()
        for stem, weight in lexicon.weights.items():
            self.automaton.add_word(f" {stem}", (len(stem), stem, weight))
        for phrase in lexicon.exceptions:
            folded = fold(phrase)[:-1]
            if folded.strip() and folded[1:] not in lexicon.weights:
                self.automaton.add_word(folded, (len(folded) - 1, None, 0.0))
        self.empty = not len(self.automaton)
        if not self.empty:
            self.automaton.make_automaton()

    def hits(self, folded: str) -> list[tuple[int, int, str, float]]:
        """(start, end, stem, weight) of the matches outside exception phrases; of those from one start, the longest."""
        if self.empty:
            return []
        best: dict[int, tuple[int, int, str, float]] = {}
        spared: list[tuple[int, int]] = []
        for end, (size, stem, weight) in self.automaton.iter(folded):
            start = end - size + 1
            if stem is None:
                spared.append((start, end))
            elif start not in best or end > best[start][1]:
                best[start] = (start, end, stem, weight)
        if spared:
            best = {k: v for k, v in best.items() if not any(a <= v[0] and v[1] <= b for a, b in spared)}
        return list(best.values())

    def evidence(self, folded: str) -> float:
        """Summed weights over the root of the length in hundreds of words."""
        found = self.hits(folded)
        return sum(h[3] for h in found) / math.sqrt(max(1.0, (folded.count(" ") - 1) / 100)) if found else 0.0

    def score(self, text: str | None) -> float:
        z = self.lexicon.bias + self.lexicon.slope * self.evidence(fold(text))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _significant(a: int, b: int, base: float, tried: int) -> bool:
    """Whether a toxic against b clean rows is unlikely by chance among ``tried`` candidates."""
    n = a + b
    log_p = math.lgamma(n + 1) - math.lgamma(a + 1) - math.lgamma(b + 1) + a * math.log(base) + b * math.log(1 - base)
    return log_p + math.log(tried) < math.log(0.05)


def stems(words: set[str]) -> set[str]:
    """What may become an entry: the words, and their beginnings."""
    return {w[:k] for w in words for k in STEM_LENGTHS if len(w) >= k} | {w for w in words if 3 <= len(w) <= 24}


def choose(having: dict[str, set[int]], in_clean: dict[str, int], toxic: int, clean: int, tried: int) -> dict[str, float]:
    """Weights of the stems that, one after another, explain most of the toxic rows not yet explained.

    having: the toxic rows of each stem; in_clean: its number of clean rows; tried: stems that were candidates.
    """
    base = toxic / (toxic + clean)
    odds = {s: math.log((len(having[s]) + 0.5) / (toxic + 1) * (clean + 1) / (in_clean[s] + 0.5)) for s in having}
    fit = {s: v for s, v in odds.items() if v > LEAST_ODDS and _significant(len(having[s]), in_clean[s], base, tried)}
    chosen: dict[str, float] = {}
    every = set().union(*having.values())
    left = set(every)
    while fit and len(chosen) < MOST_ENTRIES:
        best = max(fit, key=lambda s: (len(having[s] & left) * fit[s] + 0.02 * len(having[s]) * fit[s], len(s), s))
        if len(having[best] & left) < 2:
            break
        chosen[best] = fit.pop(best)
        left -= having[best]
        fit = {s: v for s, v in fit.items() if having[s] & left}
    # The other stems that nothing clean holds: more evidence for rows with a single match.
    covered = every - left
    for s in sorted((s for s in having if s not in chosen and in_clean[s] == 0 and len(having[s] & covered) >= 5), key=lambda s: (-len(having[s]), -len(s), s)):
        if len(chosen) >= MOST_ENTRIES:
            break
        if not any(s.startswith(c) or c.startswith(s) for c in chosen) and _significant(len(having[s]), 0, base, tried):
            chosen[s] = odds[s]
    return chosen or dict(DEFAULT_LEXICON)


def _calibrate(evidence: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Bias and slope of a logistic fit, slightly shrunk; the evidence of nothing scores below one half."""
    beta, x = np.array([-3.0, 1.0]), np.stack([np.ones_like(evidence), np.minimum(evidence, 12)], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (label - p) - 0.05 * (beta - [-3.0, 1.0])
        hess = (x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        beta += np.clip(step, -2, 2)
        if abs(step).max() < 1e-8:
            break
    return min(float(beta[0]), -0.05), max(float(beta[1]), 0.05)


def _around(folded: str, start: int, end: int) -> list[str]:
    """The matched word with the word before it, and with the one after it."""
    stop = folded.index(" ", end)
    word, before = folded[start:stop], folded[folded.rfind(" ", 0, max(start - 1, 0)) + 1 : start].strip()
    after = folded[stop + 1 : folded.index(" ", stop + 1)] if stop + 1 < len(folded) else ""
    return [f"{x} {word}" for x in (before,) if x] + [f"{word} {x}" for x in (after,) if x]


def _learn_stems(s: Scratch, rows: DataFrame, toxic: int, clean: int) -> dict[str, float]:
    """choose() over rows(n, y, folded), n numbering the rows of a label; stems are counted by Spark, and only those with odds come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, y, folded in zip(*(c.to_pylist() for c in batch.columns)):
                own = sorted(stems(set(folded.split())))
                yield pa.RecordBatch.from_arrays([pa.array([n] * len(own), pa.int64()), pa.array([y] * len(own), pa.int32()), pa.array(own, pa.string())], ["n", "y", "stem"])

    held = rows.select("n", "y", "folded").mapInArrow(run, "n long, y int, stem string")
    counted = held.groupBy("stem").agg(F.count_if(F.expr("y = 1")).alias("a"), F.count_if(F.expr("y = 0")).alias("b"), F.collect_list(F.when(F.col("y") == 1, F.col("n"))).alias("rows")).where(F.col("a") >= LEAST_ROWS)
    odds = F.log((F.col("a") + 0.5) / (toxic + 1) * (clean + 1) / (F.col("b") + 0.5))
    counted = s.cut(counted.select("stem", "b", "rows", odds.alias("odds")), "stems")
    tried = counted.count() + 1
    found = counted.where(F.col("odds") > LEAST_ODDS).select("stem", "b", "rows").toLocalIterator()
    having, in_clean = {}, {}
    for stem, b, own in found:
        if _significant(len(own), b, toxic / (toxic + clean), tried):
            having[stem], in_clean[stem] = set(own), b
    return choose(having, in_clean, toxic, clean, tried)


def _learn_exceptions(rows: DataFrame, weights: dict[str, float]) -> tuple[str, ...]:
    """Two-word phrases around matches that only clean rows hold, in three of them at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(Lexicon(weights, ()))
        for batch in batches:
            for y, folded in zip(*(c.to_pylist() for c in batch.columns)):
                own = sorted({p for a, b, _, _ in matcher.hits(folded) for p in _around(folded, a, b)})
                yield pa.RecordBatch.from_arrays([pa.array([y] * len(own), pa.int32()), pa.array(own, pa.string())], ["y", "phrase"])

    seen = rows.select("y", "folded").mapInArrow(run, "y int, phrase string").groupBy("phrase").agg(F.count_if(F.expr("y = 0")).alias("clean"), F.count_if(F.expr("y = 1")).alias("toxic"))
    return tuple(sorted(r["phrase"] for r in seen.where("clean >= 3 and toxic = 0").select("phrase").collect()))


def _evidence(rows: DataFrame, lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray]:
    """(evidence, label) of the rows, by their numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(lexicon)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([matcher.evidence(t) for t in batch.column(2).to_pylist()], pa.float64())], ["n", "y", "evidence"])

    got = rows.select("n", "y", "folded").mapInArrow(run, "n long, y int, evidence double").collect()
    got.sort(key=lambda r: (r["y"], r["n"], r["evidence"]))
    return np.array([r["evidence"] for r in got]), np.array([float(r["y"]) for r in got])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: tuple[int, int] = SAMPLE) -> Lexicon:
    """Learns a lexicon from at most ``sample`` (toxic, clean) labelled rows, those with the smallest hashes of their ids.

    Their texts stay on the executors; numbers of the sampled rows, stems with odds, phrases
    and one figure a row come to the driver.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y in (0, 1)").dropDuplicates(["id"])
    picked = []
    for y, n in ((1, sample[0]), (0, sample[1])):
        picked += known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(n).collect()
    picked.sort()
    places = {0: 0, 1: 0}
    numbered = []
    for i, y in picked:
        numbered.append((i, y, places[y]))
        places[y] += 1
    if not numbered:
        return Lexicon(dict(DEFAULT_LEXICON))
    chosen = docs.sparkSession.createDataFrame(numbered, f"id {labels.schema[id_col].dataType.simpleString()}, y int, n long")

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([fold(t) for t in batch.column(2).to_pylist()], pa.string())], ["n", "y", "folded"])

    with Scratch() as s:
        texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")
        rows = s.cut(texts.select("n", "y", "text").mapInArrow(folded, "n long, y int, folded string"), "sampled")
        counts = {r["y"]: r["c"] for r in rows.groupBy("y").agg(F.count_distinct("n").alias("c")).collect()}
        if len(counts) < 2:
            return Lexicon(dict(DEFAULT_LEXICON), (*DEFAULT_EXCEPTIONS, *_learn_exceptions(rows, DEFAULT_LEXICON)))
        weights = _learn_stems(s, rows, counts[1], counts[0])
        lexicon = Lexicon(weights, (*DEFAULT_EXCEPTIONS, *_learn_exceptions(rows, weights)))
        return Lexicon(weights, lexicon.exceptions, *_calibrate(*_evidence(rows, lexicon)))


def score(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: its id, score (0 to 1) and number of matches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(lexicon)
        for batch in batches:
            scores, hits = [], []
            for text in batch.column(1):
                folded = fold(text.as_py())
                found = matcher.evidence(folded)
                z = lexicon.bias + lexicon.slope * found
                scores.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
                hits.append(found)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(hits, pa.float64())], ["id", "score", "evidence"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, score double, evidence double").withColumnRenamed("id", id_col)


def keep_clean(docs: DataFrame, lexicon: Lexicon, text_col: str = "text", reject: float = REJECT) -> DataFrame:
    """docs without the rows that score ``reject`` or more."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(lexicon)
        for batch in few_rows(batches):
            yield batch.filter(pa.array([matcher.score(t.as_py()) < reject for t in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
