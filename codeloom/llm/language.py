"""Language identification with error-correcting output codes over n-grams of characters' bytes.

Each language has a codeword; one linear classifier a bit, on hashed 1- to 4-grams
of the lower-cased text, predicts that bit. Decoding sums, over the bits, the loss
of the predicted margin against the codeword's bit, weighted by how reliable the
bit is on rows left out of its fit; the nearest codeword wins. A second codeword nearly
as near marks the row as ambiguous.

Cases: a null text, or one without a letter, is ``und`` with score 0; equal texts
get equal rows; equally near codewords give the language that sorts first; an
empty table gives an empty table; with no labelled row every text is ``und``;
whole texts are read, of any length; rows with a null id are predicted, and repeated rows
alike. Further columns are neither read nor returned, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from codeloom.llm._text import U, chunks, mix, spread

UNDETERMINED = "und"
#: Hashed features.
DIMENSIONS = 1 << 12
#: Bits of a codeword, and most labelled rows that the classifiers are fitted on, in all and in a language.
BITS = 15
SAMPLE, SAMPLE_EACH = 4096, 512
#: Rows are ambiguous if the second codeword is nearer than this to the first, as a share of the loss of chance.
AMBIGUOUS = 0.15
_CHUNK = 1 << 20


def codewords(n: int, bits: int = BITS, seed: int = 7) -> np.ndarray:
    """n rows of +1 and -1 as far apart as a random search finds, every column split."""
    bits = max(bits, 2 * int(np.ceil(np.log2(max(n, 2)))) + 3)
    rng = np.random.default_rng(seed)
    best, score = None, -1.0
    for _ in range(400 if n <= 64 else 8):
        code = rng.integers(0, 2, (n, bits)) * 2 - 1
        for j in range(bits):
            if n > 1 and abs(code[:, j].sum()) == n:
                code[rng.integers(n), j] *= -1
        apart = bits - (code @ code.T + bits) // 2
        near = float(np.min(apart + np.eye(n, dtype=int) * bits)) + float(apart.mean()) / bits
        if near > score:
            best, score = code, near
    return best.astype(np.float32)


def features(column: pa.Array) -> np.ndarray:
    """A row of hashed n-gram shares (square roots, unit length) a text."""
    out = np.zeros((len(column), DIMENSIONS), np.float32)
    lowered = pc.utf8_lower(column.cast(pa.large_string()).fill_null("") if column.null_count else column.cast(pa.large_string()))
    for a, b in chunks(lowered, _CHUNK):
        data, offsets = spread(lowered.slice(a, b - a))
        row = np.repeat(np.arange(b - a), np.diff(offsets))
        key = data.astype(U)
        total = np.zeros((b - a) * DIMENSIONS, np.float32)
        for k in (1, 2, 3, 4):
            if k > 1:
                key = key[:-1] << U(8) | data[k - 1 :]
            same = row[: len(key)] == row[k - 1 :] if k > 1 else slice(None)
            slot = ((key * U(0x9E3779B97F4A7C15) + U(k << 17)) * U(0xD6E8FEB86659FD93) >> U(52)).astype(np.int64)
            total += np.bincount((row[: len(key)] * DIMENSIONS + slot)[same], minlength=len(total)).astype(np.float32)
        out[a:b] = total.reshape(b - a, DIMENSIONS)
    out = np.sqrt(out)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray


def _ridge(x: np.ndarray, target: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias of ridge regressions of the targets' columns, rows weighted."""
    weight = weight / weight.mean()
    middle, level = (x * weight[:, None]).mean(0), (target * weight[:, None]).mean(0)
    root = np.sqrt(weight)[:, None]
    centred = (x - middle) * root
    gram = centred @ centred.T + (0.05 * len(x) / DIMENSIONS + 1e-3) * np.eye(len(x), dtype=np.float32)
    weights = centred.T @ np.linalg.solve(gram, (target - level) * root)
    return weights, level - middle @ weights


def learn(x: np.ndarray, y: list[str]) -> Model:
    """Ridge classifiers of the codewords' bits; a bit's trust is its accuracy above chance, each half of the rows being predicted by a fit on the other."""
    languages = tuple(sorted(set(y)))
    if not languages:
        return Model((), np.zeros((0, 1), np.float32), np.zeros((DIMENSIONS, 1), np.float32), np.zeros(1, np.float32), np.ones(1, np.float32))
    code = codewords(len(languages))
    index = np.array([languages.index(v) for v in y])
    target = code[index]
    weight = (1 / np.bincount(index, minlength=len(languages)))[index].astype(np.float32)
    half, right = np.arange(len(y)) % 2 == 1, np.zeros(code.shape[1])
    if len(y) > 1:
        for tried in (half, ~half):
            weights, bias = _ridge(x[~tried], target[~tried], weight[~tried])
            right += ((x[tried] @ weights + bias) * target[tried] > 0).sum(0)
    weights, bias = _ridge(x, target, weight)
    return Model(languages, code, weights.astype(np.float32), bias.astype(np.float32), np.maximum(2 * right / len(y) - 1, 0.05).astype(np.float32))


def decode(model: Model, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the nearest codeword, score, ambiguous) of each row."""
    margin = np.clip(x @ model.weights + model.bias, -1.5, 1.5)
    loss = (np.maximum(0, 1 - margin[:, None, :] * model.code[None]) * model.trust).sum(2) / model.trust.sum()
    order = np.sort(loss, axis=1)
    near = loss.argmin(1)
    odds = np.exp(-8 * (loss - order[:, :1]))
    score = 1 / odds.sum(1)
    gap = order[:, 1] - order[:, 0] if loss.shape[1] > 1 else np.ones(len(x))
    return near, score, gap < AMBIGUOUS


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, sample_each: int = SAMPLE_EACH) -> Model:
    """Learns from at most ``sample`` labelled rows of docs, about ``sample_each`` a language, those with the smallest hashes of their ids."""
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(lang_col).alias("_lang"))
    counts = known.groupBy("_lang").agg(F.count(F.lit(1)).alias("_n")).orderBy(F.desc("_n"), "_lang").limit(sample).collect()
    if not counts:
        return learn(np.zeros((0, DIMENSIONS), np.float32), [])
    each = max(1, min(sample_each, sample // len(counts)))
    share = F.create_map(*[F.lit(v) for r in counts for v in (r["_lang"], min(1.0, each / r["_n"]))])
    place = F.pmod(F.xxhash64("_id", F.lit(11)), F.lit(1 << 30)) / (1 << 30)
    picked = known.where(place < F.element_at(share, F.col("_lang"))).orderBy(F.xxhash64("_id"), "_id").limit(sample)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).join(F.broadcast(picked.select("_id").distinct()), "_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(batch.column(0))
            yield pa.RecordBatch.from_arrays([pa.array([r.astype(np.float16).tobytes() for r in x], pa.binary()), batch.column(1), batch.column(2)], ["x", "lang", "id"])

    got = rows.select("text", "lang", F.col("_id").cast("string").alias("id")).mapInArrow(run, "x binary, lang string, id string").orderBy("id").limit(sample).toPandas()
    if got.empty:
        return learn(np.zeros((0, DIMENSIONS), np.float32), [])
    return learn(np.stack([np.frombuffer(v, np.float16) for v in got["x"]]).astype(np.float32), got["lang"].tolist())


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: its id, lang_pred, score (0 to 1) and ambiguous."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*model.languages, UNDETERMINED], object)
        for batch in batches:
            near, score, unsure = [], [], []
            for a in range(0, len(batch), 512):
                part = batch.slice(a, 512)
                lettered = part.column(2).to_numpy(zero_copy_only=False)
                if model.languages:
                    got = decode(model, features(part.column(1)))
                else:
                    got = np.zeros(len(part), int), np.zeros(len(part)), np.ones(len(part), bool)
                    lettered = np.zeros(len(part), bool)
                near.append(np.where(lettered, got[0], len(model.languages)))
                score.append(np.where(lettered, got[1], 0.0))
                unsure.append(got[2] | ~lettered)
            if near:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names[np.concatenate(near)].tolist(), pa.string()), pa.array(np.concatenate(score).astype(np.float64)), pa.array(np.concatenate(unsure))], ["id", "lang_pred", "score", "ambiguous"])

    kind = docs.schema[id_col].dataType.simpleString()
    lettered = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("lettered")
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), lettered).mapInArrow(run, f"id {kind}, lang_pred string, score double, ambiguous boolean").withColumnRenamed("id", id_col)
