import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from codeloom.llm import alignment
from codeloom.llm.packing import _byte_of

TEXTS = [
    "The quick brown fox jumps over the lazy dog.", "internationalization antidisestablishmentarianism", "a  b   c\n\n\td  ", " lead and trail ", "naïve café, déjà vu — ﬁne",
    "日本語のテキスト and 中文", "🙂🙃 emoji 👩‍👩‍👧", "▁ is written otherwise", "", None, " ", "\n", "<|endoftext|> and </s> <unk> <0x41>", "x" * 3000, "the the the the", "\x00 nul \x1f", "é",
    "The quick brown fox jumps over the lazy dog.", "1234567890 3.14159", " nbsp　wide",
]


def brute(texts, links="end"):
    a, b, of = Tokenizer.from_file(P.path("byte_bpe_50k.json")), sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model")), _byte_of()
    a.encode_special_tokens = True
    rows, counts = [], Counter()
    for text in texts:
        got = []
        if text:
            whole = (" " + text).encode()
            ta = [(i, bytes(of[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
            tb = [(i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()) for i in b.encode(text) for p in [b.id_to_piece(i)]]
            if b"".join(x for _, x in ta) == whole == b"".join(x for _, x in tb):
                got = []
                for side in (ta, tb):
                    ends, at = [], 0
                    for i, raw in side:
                        ends.append((at, at + len(raw), i))
                        at += len(raw)
                    got.append(ends)
        if not got:
            rows.append((0, 0, 0, [], ""))
            continue
        ea, eb = got
        cuts = sorted({e for _, e, _ in ea} & {e for _, e, _ in eb})
        pairs = [(i, j) for s, e, i in ea for t, f, j in eb if (e == f if links == "end" else s < f and t < e)]
        counts.update(pairs)
        text, low = [], 0
        for cut in cuts:
            text.append("|".join(",".join(str(i) for _, e, i in side if low < e <= cut) for side in (ea, eb)))
            low = cut
        rows.append((len(ea), len(eb), len(cuts), pairs, ";".join(text)))
    most = defaultdict(int)
    for (_, j), n in counts.items():
        most[j] = max(most[j], n)
    return [
        (na, nb, ng, len(p), sum(counts[x] == most[x[1]] for x in p), sum(counts[x] for x in p), hashlib.sha256(t.encode()).hexdigest() if t else "") for na, nb, ng, p, t in rows
    ]


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("links,top,held", [("end", 1 << 20, 1 << 21), ("overlap", 5, 3), ("end", 0, 2)])
def test_equal_to_brute_force(spark, docs_of, monkeypatch, links, top, held):
    monkeypatch.setattr(alignment, "TOP", top)
    monkeypatch.setattr(alignment, "HELD_PAIRS", held)
    monkeypatch.setattr(alignment, "CHUNK_CHARS", 100)
    got = alignment.align(docs_of(TEXTS), links=links).orderBy("doc_id").collect()
    assert [tuple(r[c] for c in COLUMNS) for r in got] == brute(TEXTS, links)


def test_whole_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = [r["text"] for r in docs.orderBy("doc_id").collect()]
    got = alignment.align(docs, written=True).orderBy("doc_id").collect()
    want = brute([t if t and len(t) < 3000 else None for t in texts])
    for r, w, t in zip(got, want, texts):
        assert r["groups_sha256"] == hashlib.sha256(r["groups"].encode()).hexdigest()
        if t and len(t) < 3000:
            assert (r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["groups_sha256"]) == (*w[:4], w[6])


def test_union_find_equals_search(spark):
    rng = np.random.default_rng(0)
    for n, m in ((1, 0), (50, 30), (200, 150), (500, 499)):
        one, two = (rng.integers(0, n, m), rng.integers(0, n, m)) if m != n - 1 else (np.arange(m), np.arange(1, n))
        label = list(range(n))
        for _ in range(n):
            for x, y in zip(one, two):
                label[x] = label[y] = min(label[x], label[y])
        assert alignment.components(n, one, two).tolist() == label


def test_empty_table_null_and_repeated_ids_and_clashing_columns(spark, docs_of):
    from pyspark.sql import functions as F

    assert alignment.align(docs_of([])).collect() == []
    df = docs_of(["a b", "a b", None], ids=[1, 1, None])
    for c in ("id", "row", "links", "pair", "count", "rest"):
        df = df.withColumn(c, F.lit("x"))
    got = alignment.align(df).collect()
    assert sorted((r["doc_id"] or 0, r["n_links"], r["count_sum"]) for r in got) == [(0, 0, 0), (1, 2, 4), (1, 2, 4)]


def test_other_link_kinds_are_an_error(docs_of):
    with pytest.raises(ValueError):
        alignment.align(docs_of(["a"]), links="all")


def test_every_job_passes_few_rows_to_python_at_once(spark, docs_of, monkeypatch):
    seen, cut = [], alignment.Scratch.cut
    monkeypatch.setattr(alignment.Scratch, "cut", lambda s, df, kind: seen.append((kind, spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))) or cut(s, df, kind))
    alignment.align(docs_of(TEXTS))
    assert seen[:2] == [("aligned", str(alignment.TEXT_ROWS)), ("pairs", str(alignment.TEXT_ROWS))]
    assert {n for _, n in seen} == {str(alignment.TEXT_ROWS)} != {spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")}
