"""Nulls, empty and very long texts, ties, repeated rows, null ids, empty tables and clashing columns, for each operator."""

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from codeloom.llm import fingerprint, language, linededup, minhash, mixing, packing, preferences, topk, toxicity, warc

#: Names that operators use inside, or return.
CLASHING = ["_id", "_found", "_whole", "_version", "_kept", "id", "rep", "band", "label", "removed_words", "spans", "copies", "d", "e", "place", "block", "passes", "more", "score", "predicted", "class_id", "fingerprint", "bucket", "extra", "start", "length", "sequence_id"]
N_PLAIN = 8


@pytest.fixture(scope="module")
def long_text():
    r = np.random.default_rng(11)
    return " ".join(f"w{x}" for x in r.integers(0, 50_000, 40_000))


@pytest.fixture
def docs(docs_of, sentence, long_text):
    texts = [sentence(1, 80, 9000), None, "", long_text, sentence(2, 60, 9000), sentence(2, 60, 9000), "x", "short text here", "lost"]
    ids = [10, 11, 12, 13, 14, 15, 16, 17, None]
    made = docs_of(texts, langs=["en", None, "en", "fr", "en", "en", "fr", "fr", None], sources=["a", None, "a", "b", "a", "a", None, "b", "b"], ids=ids)
    made = made.union(made.where("doc_id = 14")).union(made.where("doc_id = 11"))  # repeated rows
    return made.withColumns({c: F.lit(f"own {c}") for c in CLASHING})


def values(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def test_fingerprints(docs, long_text):
    got = fingerprint.edited_and_next(docs).collect()
    assert collections.Counter(r["doc_id"] for r in got) == {10: 1, 11: 2, 12: 1, 13: 1, 14: 2, 15: 1, 16: 1, 17: 1}
    by = {r["doc_id"]: r for r in got}
    assert by[11]["fingerprint"] == by[12]["fingerprint"] == "00" * 128 and by[14]["fingerprint"] == by[15]["fingerprint"]
    assert by[13]["n_chars"] == len(long_text) and all(0 <= r["near_edited"] <= 1 for r in got)
    assert fingerprint.near_duplicates(docs.where("doc_id is not null")).where("doc_id in (14, 15)").select("class_id").distinct().count() == 1


def test_language(docs):
    model = language.fit(docs)
    got = values(language.predict(docs, model), "doc_id", "lang_pred")
    assert len(got) == docs.count() and dict(got)[11] == dict(got)[12] == "und" and len({v for k, v in got if k in (14, 15)}) == 1


def test_minhash(docs):
    got = minhash.classes(docs)
    assert collections.Counter(r["doc_id"] for r in got.collect()) == {10: 1, 11: 2, 12: 1, 13: 1, 14: 2, 15: 1, 16: 1, 17: 1}
    by = {r["doc_id"]: r for r in got.collect()}
    assert by[11]["class_id"] == by[12]["class_id"] == 11 and by[15]["class_id"] == 14 and by[13]["class_id"] == 13 and by[13]["links"] == 0
    kept = minhash.keep_one(docs)
    assert kept.columns == docs.columns and [r[0] for r in values(kept, "doc_id")] == [10, 11, 13, 14, 16, 17, None]


def test_linededup(docs, sentence):
    got = linededup.dedup(docs, within=True, line_words=8)
    assert got.columns == docs.columns and got.count() == docs.count()
    by = collections.defaultdict(list)
    for r in got.collect():
        by[r["doc_id"]].append(r["text"])
    assert by[15] == [""] and by[14] == [sentence(2, 60, 9000)] * 2 and by[11] == [None, None] and by[None] == ["lost"]
    detailed = linededup.dedup(docs, details=True)
    assert detailed.columns == [c for c in docs.columns if c not in ("removed_words", "spans")] + ["removed_words", "spans"]


def test_linededup_takes_short_repeated_lines(docs_of, sentence):
    line, other = sentence(3, 12, 900), sentence(4, 5, 900)
    texts = [f"{sentence(i, 40, 9000)}\n{line}\n{other}\n{sentence(50 + i, 20, 9000)}" for i in range(20)] + [f"{line}\n{line} tail"]
    got = {r["doc_id"]: r["text"] for r in linededup.dedup(docs_of(texts), within=True, line_words=8).collect()}
    assert got[0] == texts[0] and all(got[i] == texts[i].replace(line + "\n", "") for i in range(1, 20))
    assert got[20] == f"{line} tail"


def test_linededup_tells_the_texts_of_repeated_ids_apart(docs_of, sentence):
    shared, own = sentence(1, 70, 9000), sentence(2, 70, 9000)
    got = [r["text"] for r in linededup.dedup(docs_of([shared, f"{own} {shared}", own], ids=[1, 2, 2])).orderBy("doc_id").collect()]
    assert sorted(got) == sorted([shared, own, own])


def test_mixing(docs):
    got = mixing.mix(docs, copies_col="copies", max_repeats=3.0)
    assert got.columns == [c for c in docs.columns if c != "copies"] + ["copies"] and got.count() == docs.count()
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.where("text is null").count() == 2


def test_warc_with_repeated_ids(spark):
    a, b = "a" * 1500, "b" * 1500
    pages = spark.createDataFrame([(5, "u", a), (5, "u", b), (9, "u", a), (9, None, a), (7, "u", None), (6, "u", "é" * 400_000)], "page_id long, url string, html string").withColumns({c: F.lit("x") for c in ("id", "payload", "digest", "refers_to", "bundle")})
    got = sorted(((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"], r["payload"] and bytes(r["payload"])[:1]) for r in warc.round_trip(pages).collect()), key=repr)
    assert got == sorted([(5, "revisit", 9, 1500, None), (5, "response", None, 1500, b"b"), (9, "response", None, 1500, b"a"), (9, "response", None, 1500, b"a"), (7, "response", None, 0, b""), (6, "response", None, 800_000, "é".encode()[:1])], key=repr)


def test_packing(docs):
    got = packing.pack(docs, added=True).collect()
    ends = collections.Counter()
    for r in got:
        ends[r["doc_id"]] += r["length"]
    whole = {r["doc_id"]: r["doc_tokens"] for r in got}
    times = {14: 2, 11: 2}
    assert all(n == whole[i] * times.get(i, 1) for i, n in ends.items()) and whole[11] == whole[12] == 1 and None in whole and whole[13] > 40_000


def test_toxicity(docs, spark):
    labels = spark.createDataFrame([(10, 1), (14, 0), (14, 0), (None, 1), (15, None)], "doc_id long, toxic int").withColumn("text", F.lit(1))
    lexicon = toxicity.fit(docs, labels)
    got = values(toxicity.score(docs, lexicon), "doc_id", "score")
    assert len(got) == docs.count() and dict(got)[11] == dict(got)[12] < 0.5
    assert toxicity.keep_clean(docs, lexicon).columns == docs.columns


def test_empty_tables(docs):
    none = docs.limit(0)
    for made in (fingerprint.edited_and_next(none), fingerprint.near_duplicates(none), language.predict(none, language.fit(none)), minhash.keep_one(none), linededup.dedup(none), mixing.mix(none), packing.pack(none), toxicity.keep_clean(none, toxicity.Lexicon({}))):
        assert made.count() == 0


def test_recall_of_links_at_the_threshold(docs_of):
    # Weighted brute force over random pairs between 0.8 and 0.95, a third of the rows in one group.
    r = np.random.default_rng(2)
    texts = []
    for i in range(120):
        base = [f"b{i}w{j}" for j in range(300)] if i >= 40 else [f"hot{j}" for j in range(300)]
        for at in r.choice(300, int(r.integers(2, 7)), replace=False):
            base[at] = f"e{i}x{at}"
        texts.append(base)
        if i >= 40:
            twin = list(base)
            for at in r.choice(300, int(r.integers(1, 7)), replace=False):
                twin[at] = f"t{i}x{at}"
            texts.append(twin)
    docs = docs_of([" ".join(t) for t in texts])
    weights = minhash.weigh(docs)
    import pyarrow as pa

    from codeloom.llm._text import LETTERS, Words, shingle_counts, spread

    def near(a, b):
        row, shingle, count = shingle_counts(Words(*spread(pa.array([a, b])), LETTERS), 2)
        one = [(row[row == k] * 0, shingle[row == k], weights(shingle[row == k], count[row == k])) for k in (0, 1)]
        return minhash.similarity(1, *one)[0]

    plain = [" ".join(t) for t in texts]
    pairs = [(i, j) for i in range(40) for j in range(i)] + [(40 + 2 * i, 41 + 2 * i) for i in range(80)]
    linked = [(i, j) for i, j in pairs if near(plain[i], plain[j]) >= 0.8]
    got = {x["doc_id"]: x["class_id"] for x in minhash.classes(docs).collect()}
    assert len(linked) >= 60 and sum(got[i] == got[j] for i, j in linked) >= 0.98 * len(linked)
