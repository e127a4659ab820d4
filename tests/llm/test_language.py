import random

import numpy as np
from pyspark.sql import functions as F

from codeloom.llm import language

SYLLABLES = {"aa": "the and ing er th", "bb": "der ung sch ein keit", "cc": "ción que los ar ñe"}


def text_of(lang, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choices(SYLLABLES[lang].split(), k=2)) for _ in range(40))


def test_held_out_accuracy_and_undetermined_rows(docs_of):
    langs = [["aa", "bb", "cc"][i % 3] for i in range(240)]
    docs = docs_of([text_of(x, i) for i, x in enumerate(langs)], langs=langs)
    model = language.fit(docs.where("doc_id < 120"))
    rows = {r["doc_id"]: r for r in language.predict(docs.where("doc_id >= 120"), model).collect()}
    assert len(rows) == 120 and all(r["lang_pred"] == langs[i] and 0 <= r["score"] <= 1 for i, r in rows.items())
    odd = language.predict(docs_of([None, "", "123 !", "   "]), model).collect()
    assert [(r["lang_pred"], r["score"]) for r in odd] == [("und", 0.0)] * 4


def test_nothing_to_learn_from(docs_of):
    docs = docs_of(["some text", None]).withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in language.predict(docs, language.fit(docs)).collect()} == {"und"}
    assert language.predict(docs.limit(0), language.fit(docs)).count() == 0


def test_codewords_are_apart():
    code = language.codewords(6)
    assert min((code[i] != code[j]).sum() for i in range(6) for j in range(i)) >= 3


def test_decoding_equals_brute_force_and_flags_what_lies_between():
    rng = np.random.default_rng(3)
    code = language.codewords(5)
    trust = rng.uniform(0.1, 1, code.shape[1]).astype(np.float32)
    weights = np.zeros((language.DIMENSIONS, code.shape[1]), np.float32)
    weights[: code.shape[1]] = np.eye(code.shape[1])
    model = language.Model(tuple("abcde"), code, weights, np.zeros(code.shape[1], np.float32), trust)
    margins = np.concatenate([code, (code[:1] + code[1:2]) / 2, rng.normal(size=(200, code.shape[1]))]).astype(np.float32)
    x = np.zeros((len(margins), language.DIMENSIONS), np.float32)
    x[:, : code.shape[1]] = margins
    near, score, unsure = language.decode(model, x)
    for m, n, s, u in zip(margins, near, score, unsure):
        losses = [sum(t * max(0.0, 1 - min(1.5, max(-1.5, v)) * bit) for v, bit, t in zip(m, word, trust)) / trust.sum() for word in code]
        first, second = sorted(losses)[:2]
        assert np.isclose(losses[n], first, atol=1e-5) and 0 < s <= 1
        assert abs(second - first - language.AMBIGUOUS) < 1e-5 or u == (second - first < language.AMBIGUOUS)
    assert near[:5].tolist() == [0, 1, 2, 3, 4] and not unsure[:5].any()
    # Halfway between two codewords, both are as near.
    assert unsure[5] and near[5] in (0, 1)
