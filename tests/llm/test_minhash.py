import collections
import re

import numpy as np
import pyarrow as pa

from codeloom.llm import minhash
from codeloom.llm._text import LETTERS, Words, shingle_counts, spread


def shingles(text):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return collections.Counter(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else collections.Counter()


def brute_classes(texts, least=0.8):
    sets, up = [shingles(t) for t in texts], list(range(len(texts)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            total = sum((sets[i] | sets[j]).values())
            if (sum((sets[i] & sets[j]).values()) / total if total else 1.0) >= least:
                a, b = sorted((find(i), find(j)))
                up[b] = a
    return [find(i) for i in range(len(texts))]


def test_classes_equal_brute_force(docs_of, sentence):
    base = [sentence(i, 80, 4000) for i in range(8)]
    near = [b.rsplit(" ", 1)[0] + " other" for b in base[:4]]
    texts = base + near + [base[0].upper() + " !", None, "", "two words", "Two, words", "one"]
    got = minhash.classes(docs_of(texts)).collect()
    assert [r["class_id"] for r in sorted(got)] == brute_classes(texts)


def test_a_large_group_of_copies_is_one_class(docs_of, sentence):
    text = sentence(5, 120, 5000).split()
    texts = [" ".join(text[:i] + ["x"] + text[i + 1 :]) for i in range(100, 120)] + [" ".join(text)] * 30
    got = minhash.classes(docs_of(texts)).select("class_id").distinct().collect()
    assert len(got) == 1
    kept = minhash.keep_one(docs_of(texts + [sentence(6, 90)]))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 50]


def test_repeated_ids_and_empty_table(docs_of, sentence):
    docs = docs_of([sentence(1), sentence(1), None], ids=[7, 7, None])
    assert [r["class_id"] for r in minhash.classes(docs).collect()] == [7, 7]
    assert minhash.keep_one(docs).count() == 2
    assert minhash.classes(docs.limit(0)).count() == 0


def test_similarity_is_weighted_jaccard():
    texts = pa.array(["a b c d e f g", "a b c d e f h"])
    row, shingle, count = shingle_counts(Words(*spread(texts), LETTERS), 2)
    one = [(row[row == i] * 0, shingle[row == i], count[row == i].astype(float)) for i in (0, 1)]
    assert np.isclose(minhash.similarity(1, *one)[0], 2 / 4)
    assert minhash.similarity(1, *[(x[0][:0], x[1][:0], x[2][:0]) for x in one])[0] == 1


def test_samples_agree_as_often_as_the_texts_are_similar():
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 1 << 48, 4000, dtype=np.uint64))
    b = np.concatenate([a[:3000], np.unique(rng.integers(0, 1 << 48, 1000, dtype=np.uint64))])
    rows = [np.zeros(len(x), np.int64) for x in (a, b)]
    sa, sb = (minhash.sample(1, r, x, np.full(len(x), 2.0), rounds=1, bands=400) for r, x in zip(rows, (a, b)))
    assert abs((sa == sb).mean() - 3000 / (len(a) + len(b) - 3000)) < 0.1


def test_bands_find_what_verification_accepts_in_a_hot_group(docs_of):
    # A third of all rows are copies of one text, each with its own run of words: pairs of them have a verified similarity just above 0.8.
    r = np.random.default_rng(3)
    base = [f"b{i}" for i in range(400)]
    hot = [" ".join(base[: 10 * i] + [f"h{i}x{j}" for j in range(15)] + base[10 * i + 15 :]) for i in range(30)]
    docs = docs_of(hot + [" ".join(f"c{x}" for x in r.integers(0, 99999, 400)) for _ in range(60)])
    weights = minhash.weigh(docs)
    bands = {row["id"]: set(row["bands"]) for row in minhash.signatures(docs, weights, "doc_id", "text").collect()}
    found = total = 0
    for i in range(30):
        for j in range(i):
            row, shingle, count = shingle_counts(Words(*spread(pa.array([hot[i], hot[j]])), LETTERS), 2)
            one = [(row[row == k] * 0, shingle[row == k], weights(shingle[row == k], count[row == k])) for k in (0, 1)]
            if minhash.similarity(1, *one)[0] >= 0.8:
                total, found = total + 1, found + bool(bands[i] & bands[j])
    assert total >= 100 and found >= 0.99 * total
