from codeloom.llm import linededup


def test_passage_inside_lines_is_deleted_from_later_documents(docs_of, sentence):
    passage = sentence(9, 70, 9000)
    hosts = [sentence(i, 60, 9000) for i in range(5)]
    texts = [h[: len(h) // 2] + " " + passage + "\n" + h[len(h) // 2 :] if i in (1, 3, 4) else h for i, h in enumerate(hosts)]
    rows = {r["doc_id"]: r for r in linededup.dedup(docs_of(texts), details=True).collect()}
    for i in (0, 1, 2):
        assert rows[i]["text"] == texts[i] and rows[i]["removed_words"] == 0
    for i in (3, 4):
        left = rows[i]["text"].split()
        assert rows[i]["removed_words"] >= 70 and passage not in rows[i]["text"]
        assert left == [w for w in texts[i].replace(passage, "").split()]
        assert rows[i]["n_chars"] == len(rows[i]["text"]) and rows[i]["spans"][0]["sources"] == [1]


def test_short_repeats_and_repeats_inside_a_document_stay(docs_of, sentence):
    line = sentence(3, 40)
    texts = [sentence(1, 80) + "\n" + line, sentence(2, 80) + "\n" + line, (sentence(4, 70) + "\n") * 3]
    assert [r["text"] for r in linededup.dedup(docs_of(texts)).orderBy("doc_id").collect()] == texts


def test_copies_nulls_and_empty_table(docs_of, sentence):
    text = sentence(1, 90)
    got = {r["doc_id"]: r["text"] for r in linededup.dedup(docs_of([text, None, text, "", "short"])).collect()}
    assert got == {0: text, 1: None, 2: "", 3: "", 4: "short"}
    assert linededup.dedup(docs_of([text]).limit(0)).count() == 0
    assert linededup.dedup(docs_of([text])).columns == docs_of([text]).columns


def test_every_shared_run_of_fifty_words_is_found():
    import random

    import numpy as np

    from codeloom.llm._text import VISIBLE, Words

    r = random.Random(4)
    for _ in range(20):
        shared = [f"s{r.randrange(99999)}" for _ in range(50)]
        texts = [" ".join([f"x{r.randrange(99999)}" for _ in range(r.randrange(30))] + shared + [f"y{r.randrange(99999)}" for _ in range(r.randrange(30))]) for _ in range(2)]
        raw = [t.encode() for t in texts]
        words = Words(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), VISIBLE)
        at, h = linededup.winnow(words)
        row = words.row[at]
        assert set(h[row == 0]) & set(h[row == 1])


def test_later_repeats_inside_a_document_are_deleted(docs_of, sentence):
    a, b, c = sentence(1, 70, 9000), sentence(2, 30, 9000), sentence(3, 80, 9000)
    texts = [" ".join([b, a, c, a, "end"]), " ".join([a] * 1000), " ".join([c, sentence(5, 60, 9000)]), " ".join([sentence(6, 60, 9000)] * 1000), "x " * 1000 + "y", sentence(7, 90, 9000)]
    rows = {r["doc_id"]: r for r in linededup.dedup(docs_of(texts), details=True, within=True).collect()}
    assert rows[0]["text"].split() == " ".join([b, a, c, "end"]).split() and rows[0]["spans"][0]["sources"] == [0]
    assert rows[1]["text"] == "" and rows[2]["text"] == sentence(5, 60, 9000)
    assert rows[3]["text"] == sentence(6, 60, 9000) and rows[3]["removed_words"] == 999 * 60
    left = rows[4]["text"].split()
    assert set(left) == {"x", "y"} and 26 <= len(left) <= 76
    assert rows[5]["text"] == texts[5] and rows[5]["removed_words"] == 0


def test_every_job_passes_few_rows_to_python_at_once(spark, docs_of, sentence, monkeypatch):
    seen, cut = {}, linededup.Scratch.cut
    monkeypatch.setattr(linededup.Scratch, "cut", lambda s, df, kind: seen.update({kind: spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")}) or cut(s, df, kind))
    linededup.dedup(docs_of([sentence(1), sentence(1)]))
    assert seen["lines"] == seen["around"] == str(linededup.FEW_ROWS)


def test_a_very_common_line_is_dealt_to_several_tasks(docs_of, sentence, monkeypatch):
    seen, join = [], linededup.salted_join
    monkeypatch.setattr(linededup, "salted_join", lambda many, few, keys, by, hot=None, **how: seen.append((keys, hot.count() if hot else 0)) or join(many, few, keys, by, hot=hot, **how))
    line = sentence(1, 12)
    texts = [f"{line}\nown {i}" for i in range(1200)]
    got = {r["doc_id"]: r["text"] for r in linededup.dedup(docs_of(texts), line_words=8).collect()}
    assert got == {i: t if i == 0 else f"own {i}" for i, t in enumerate(texts)}
    assert seen[0] == (["hash"], 1)
