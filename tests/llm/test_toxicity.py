import random

import pyarrow as pa

from codeloom.llm import toxicity


def corpus(n, seed):
    r = random.Random(seed)
    words = [f"{a}{b}" for a in "ba de fi go lu ma".split() for b in "ne ro sti pal".split()]
    rows = []
    for i in range(n):
        t = r.choices(words, k=r.randrange(20, 120))
        toxic = i % 5 == 0
        if toxic:
            for _ in range(r.randrange(2, 5)):
                t.insert(r.randrange(len(t)), r.choice(["grobulon", "grobulas", "snarkfit"]))
        elif i % 7 == 0:
            t.insert(3, "ne snarkfit award")
        rows.append((" ".join(t), int(toxic)))
    return rows


def test_held_out_rows(spark, docs_of):
    rows = corpus(600, 1)
    docs = docs_of([t for t, _ in rows])
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(rows)], "doc_id long, toxic int")
    lexicon = toxicity.fit(docs, labels.where("doc_id < 400"))
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, lexicon).collect()}
    assert all(0 <= s <= 1 for s in got.values())
    right = sum((got[i] >= 0.5) == bool(rows[i][1]) for i in range(400, 600))
    assert right >= 190
    kept = {r["doc_id"] for r in toxicity.keep_clean(docs, lexicon).collect()}
    assert kept == {i for i, s in got.items() if s < 0.5}


def test_folding_and_exceptions():
    m = toxicity.Matcher(toxicity.Lexicon({"idiot": 2.0, "trash": 2.0}, ("trash can",)))
    for text in ("IDIOT", "1d10t", "іdіоt", "idi0ts!", "ｉｄｉｏｔ"):
        assert [h[2] for h in m.hits(toxicity.fold(text))] == ["idiot"], text
    assert not m.hits(toxicity.fold("the trash can here"))
    assert not m.hits(toxicity.fold("anidiot"))
    assert m.score(None) == m.score("") < 0.5 < toxicity.Matcher(toxicity.Lexicon({"idiot": 9.0})).score("idiot")


def test_no_labels_and_empty_table(spark, docs_of):
    docs = docs_of(["a", None, ""])
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    lexicon = toxicity.fit(docs, labels)
    assert lexicon.weights == toxicity.DEFAULT_LEXICON
    assert toxicity.score(docs, lexicon).count() == 3
    assert toxicity.score(docs.limit(0), lexicon).count() == 0


def test_few_rows_are_scored_at_once():
    class Docs:
        columns, schema = ["doc_id", "text"], None

        def mapInArrow(self, run, schema):
            return run

    batch = pa.RecordBatch.from_arrays([pa.array(range(1300)), pa.array(["plain words"] * 1300)], ["doc_id", "text"])
    got = list(toxicity.keep_clean(Docs(), toxicity.Lexicon({"bad": 3.0}, ()))(iter([batch])))
    assert [len(b) for b in got] == [512, 512, 276] and pa.Table.from_batches(got).column(0).to_pylist() == list(range(1300))
