import hashlib

import numpy as np

from codeloom.llm import fingerprint as fp


def walk_of(text, w):
    classes = fp._classes(np.frombuffer(text.encode("utf-32-le"), np.uint32)) if text else []
    i = j = 0
    out = []
    while i < len(classes):
        out.append(int(classes[i]))
        i += int(fp._MOVES[w][j % fp._PERIOD][classes[i]])
        j += 1
    return out


def symbols_of(text):
    out = []
    for w in range(fp.WALKS):
        emitted = walk_of(text, w)
        for records in fp._RECORDS[w]:
            if not emitted:
                out.append(0)
                continue
            p = max(int(x) for x in records if x < len(emitted))
            mixed = (p * 0x9E3779B97F4A7C15 + emitted[p] * 0xD6E8FEB86659FD93) % (1 << 64) >> 40
            out.append(mixed % 255 + 1)
    return out


def test_matches_a_walk_step_by_step(sentence):
    texts = ["", "a", "añb", sentence(1, 30), sentence(2, 700), "x" * 999] + [sentence(i, 20) for i in range(40)]
    got = fp._many(texts)
    for text, row in zip(texts, got):
        assert row.tolist() == symbols_of(text)


def test_edited_and_next_against_brute_force(docs_of, sentence):
    texts = [sentence(i, 5 + 7 * i) for i in range(30)] + [None, "", "é", sentence(3, 26)]
    ids = [3 * i + 1 for i in range(len(texts))]
    docs = docs_of(texts, ids=ids).repartition(5)
    rows = {r["doc_id"]: r for r in fp.edited_and_next(docs).collect()}
    assert sorted(rows) == ids
    plain = [t or "" for t in texts]
    for i, t in enumerate(plain):
        after = plain[(i + 1) % len(plain)]
        k = len(t) // 4
        edited = t[: len(t) - k] + after[:k]
        r = rows[ids[i]]
        assert r["n_chars"] == len(t)
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["fingerprint"] == bytes(symbols_of(t)).hex()
        assert r["edited_fingerprint"] == bytes(symbols_of(edited)).hex()
        assert r["near_edited"] == np.mean(np.array(symbols_of(t)) == symbols_of(edited))
        assert r["near_next"] == np.mean(np.array(symbols_of(t)) == symbols_of(after))


def test_many_buckets_have_the_right_neighbour(docs_of, monkeypatch):
    monkeypatch.setattr(fp, "ranges", lambda df, key: [5, 11, 12, 40])
    texts = [f"text {i} " * 3 for i in range(50)]
    rows = fp.edited_and_next(docs_of(texts)).select("doc_id", "edited_sha256").collect()
    want = {i: texts[i][: len(t) - len(t) // 4] + texts[(i + 1) % 50][: len(t) // 4] for i, t in enumerate(texts)}
    assert {r[0]: r[1] for r in rows} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in want.items()}


def test_near_duplicates_share_a_class(docs_of, sentence):
    a, b = sentence(1, 200), sentence(2, 200)
    got = {r["doc_id"]: r["class_id"] for r in fp.near_duplicates(docs_of([a, b, a, a[:-6] + "tail", ""])).collect()}
    assert got[0] == got[2] == got[3] == 0 and got[1] == 1 and got[4] == 4


def test_empty_table(docs_of):
    assert fp.edited_and_next(docs_of([])).count() == 0
    assert fp.fingerprint(docs_of([])).count() == 0


def test_a_bucket_whose_smallest_member_is_unlike_the_others(spark, docs_of, monkeypatch):
    r = np.random.default_rng(5)
    first, second = r.integers(1, 128, 128, dtype=np.uint8), r.integers(1, 128, 128, dtype=np.uint8)
    leader = np.append(first[:64], first[64:] + 128)
    prints = {0: leader}
    for i in range(1, 9):  # all share the first eight bands with the leader, and every later one differs in a symbol from text to text
        prints[i] = (first if i % 2 else np.append(first[:64], second[64:])).copy()
        prints[i][64 + i % 8 :: 8] ^= np.uint8(128)
    rows = [(i, p.tobytes().hex()) for i, p in prints.items()]
    monkeypatch.setattr(fp, "fingerprint", lambda docs, *_: spark.createDataFrame(rows, "doc_id long, fingerprint string"))
    assert (fp.likeness(prints[1], prints[3]) >= 0.8) and (fp.likeness(prints[1], prints[2]) < 0.8) and all(fp.likeness(leader, prints[i]) < 0.8 for i in range(1, 9))
    got = {r["doc_id"]: r["class_id"] for r in fp.near_duplicates(docs_of([])).collect()}
    assert got == {0: 0} | {i: 1 if i % 2 else 2 for i in range(1, 9)}
