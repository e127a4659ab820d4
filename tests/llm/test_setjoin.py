import random
import re

import numpy as np
import pytest

from codeloom.llm import setjoin


def sets_of(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + 4]) for i in range(len(words) - 3)} if len(words) > 3 else {tuple(words)} if words else set()


def brute(rows):
    """(id, n_shingles, component_id) by all pairs."""
    sets = [sets_of(t) for _, t in rows]
    comp = list(range(len(rows)))

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((root(i), root(j)))
                comp[b] = a
    least = {}
    for i, (x, _) in enumerate(rows):
        if x is not None:
            least[root(i)] = min(x, least.get(root(i), x))
    return sorted(((x if x is not None else -1), len(sets[i]), least.get(root(i), -1)) for i, (x, _) in enumerate(rows))


def found(df):
    none = lambda x: -1 if x is None else x
    return sorted((none(r["doc_id"]), r["n_shingles"], none(r["component_id"])) for r in setjoin.linked(df).collect())


def near(r, words, share):
    """Runs of words, of which about a share is replaced, in bursts that change few shingles."""
    words = list(words)
    at = r.randrange(len(words))
    for i in range(at, min(len(words), at + max(1, int(share * len(words))))):
        words[i] = f"x{r.randrange(10**6)}"
    return " ".join(words)


def corpus():
    r = random.Random(5)
    texts, passage = [], " ".join(f"p{r.randrange(50)}" for _ in range(60))
    for g in range(12):
        base = [f"w{r.randrange(300)}" for _ in range(r.choice([8, 20, 60, 200]))]
        texts += [near(r, base, share) for share in (0, 0, 0.01, 0.03, 0.06, 0.07, 0.08, 0.1, 0.15, 0.3) for _ in range(2)]
    base = [f"h{r.randrange(400)}" for _ in range(120)]
    texts += [near(r, near(r, base, 0.05).split(), r.choice([0.01, 0.04, 0.08])) for _ in range(120)]
    texts += [f"{passage} {' '.join(f'u{r.randrange(10**6)}' for _ in range(r.randrange(20)))}" for _ in range(60)]
    texts += ["", None, " \n", "One two", "one TWO", "one two three", "a b c d", "A b c D", "a b c d e", "É b c d", "é b c d", "x\x1cy z q w", "x\xa0y z q w"]
    r.shuffle(texts)
    return texts


@pytest.mark.parametrize("small", [False, True])
def test_equal_to_brute_force(spark, docs_of, monkeypatch, small):
    if small:
        monkeypatch.setattr(setjoin, "BLOCK_SETS", 16)
        monkeypatch.setattr(setjoin, "BLOCK_SHINGLES", 900)
        monkeypatch.setattr(setjoin, "PAIRS_AT_ONCE", 50)
        monkeypatch.setattr(setjoin, "SHINGLES_AT_ONCE", 300)
        monkeypatch.setattr(setjoin, "MOST_BITS", 128)
    rows = list(enumerate(corpus()))
    assert found(docs_of([t for _, t in rows])) == brute(rows)


def test_traversal_finds_all_pairs_that_link(monkeypatch):
    r = np.random.default_rng(1)
    sets = []
    for _ in range(40):
        base = r.integers(0, 1 << 48, r.integers(1, 200), dtype=np.uint64)
        for share in (1.0, 0.97, 0.93, 0.9, 0.8):
            kept = base[r.random(len(base)) < share]
            sets.append(np.unique(np.append(kept, r.integers(0, 1 << 48, max(1, int((1 - share) * len(base))), dtype=np.uint64))))
    first = np.append(0, np.cumsum([len(x) for x in sets]))
    links = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if 100 * (b := len(np.intersect1d(sets[i], sets[j]))) >= 85 * (len(sets[i]) + len(sets[j]) - b)}
    tree = setjoin.Tree(setjoin.bitmaps(np.concatenate(sets), first), np.diff(first))
    got = [set(zip(i.tolist(), j.tolist())) for i, j in setjoin.traverse(tree, tree, True, 85)]
    assert len(links) > 40 and links <= set().union(*got) and sum(map(len, got)) < 3 * len(links)
    cut = len(sets) // 3
    one, two = (setjoin.Tree(t.levels[0][0], t.levels[0][1]) for t in (setjoin.Tree(tree.levels[0][0][s], np.diff(first)[s]) for s in (slice(0, cut), slice(cut, None))))
    between = {(int(x), int(y) + cut) for i, j in setjoin.traverse(one, two, False, 85) for x, y in zip(i, j)}
    assert {(i, j) for i, j in links if i < cut <= j} <= between


def test_null_and_repeated_ids_and_clashing_columns(spark, docs_of):
    from pyspark.sql import functions as F

    rows = [(5, "a b c d e f"), (5, "g h i j k l"), (3, "a b c d e f"), (None, "g h i j k l"), (None, "m n o p q"), (7, "a b c d e f"), (7, "a b c d e f"), (8, None), (8, "")]
    df = docs_of([t for _, t in rows], ids=[i for i, _ in rows])
    for c in ("id", "key", "n", "rep", "comp", "cluster", "h1", "block"):
        df = df.withColumn(c, F.lit("x"))
    want = brute(rows)
    assert found(df) == want


def test_empty_table_and_text_ids(spark, docs_of):
    assert setjoin.linked(docs_of([])).collect() == []
    df = spark.createDataFrame([("b", "one two three four five"), ("a", "One two three four five"), ("c", "six")], "doc_id string, text string")
    assert {(r["doc_id"], r["component_id"]) for r in setjoin.linked(df).collect()} == {("a", "a"), ("b", "a"), ("c", "c")}


def test_very_long_text(spark, docs_of):
    r = random.Random(2)
    long = [f"w{r.randrange(10**6)}" for _ in range(200_000)]
    rows = list(enumerate([" ".join(long), " ".join(long[:190_000]), " ".join(long[:150_000])]))
    assert found(docs_of([t for _, t in rows])) == brute(rows)


def test_sets_that_meet_by_chance_form_no_clusters(spark):
    """Rings of 3 and 20 sets of 100 shingles share one or two deciding shingles each with the next: too few to link, so they need no search."""
    from codeloom.llm._spark import Scratch

    rows = []
    for base, members in ((0, 9), (1000, 60)):
        for i in range(members):
            own = [10**6 + (base + i) * 100 + x for x in range(14)]
            rows.append((base + i, 100, [base + i // (members // 3), base + 500 + (i + 1) // (members // 3)] + own))
    reps = spark.createDataFrame(rows, "rep long, n long, prefix array<long>")
    with Scratch() as s:
        assert setjoin._clusters(s, reps, 85).collect() == []


@pytest.mark.parametrize("pairs", [2, 7, 200])
def test_any_bound_of_pairs_gives_the_same_components(spark, docs_of, monkeypatch, pairs):
    monkeypatch.setattr(setjoin, "PAIR_SETS", pairs)
    rows = list(enumerate(corpus()))
    assert found(docs_of([t for _, t in rows])) == brute(rows)
