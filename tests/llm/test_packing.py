import itertools
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from codeloom.llm import packing

ODD = [
    "", " ", "  a", "a  b", "a\n\n b", "don't 'tis !'s 's", "tab\t x\n", "a1b2 33ç ½²", "<|endoftext|> hi", "é" * 10, "\n", " \n ", "🙂 ok 🙂🙂",
    "x" * 5000, "ａｂ１２", "a b", "\x1c\x1dz", "\u0085q", "we'll we've I'm you're he'd", "ẞ ß ǅ",
]


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def test_ids_equal_the_tokenizers_library(tokenizer):
    r = random.Random(0)
    texts = ODD + ["".join(r.choices("ab 'slt\n\té12.!", k=r.randrange(200))) for _ in range(200)]
    coder = packing.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    for _ in range(2):
        for got, want in zip(coder.encode(texts), tokenizer.encode_batch(texts, add_special_tokens=False)):
            assert got.tolist() == want.ids


def test_pieces(docs_of, sentence, tokenizer):
    texts = ODD + [None] + [sentence(i, 30 * i) for i in range(40)]
    rows = packing.pack(docs_of(texts).coalesce(2)).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    for i, t in enumerate(texts):
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        at = 0
        for r in sorted(pieces[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024 and at & (at - 1) == 0  # full, or a power of two: no padding


def test_pattern_is_the_best_subset():
    r = random.Random(3)
    for _ in range(60):
        lengths = sorted(r.sample(range(1, 60), r.randrange(1, 6)))
        counts = [r.randrange(1, 4) for _ in lengths]
        capacity = r.randrange(20, 120)
        best = max(s for c in itertools.product(*(range(n + 1) for n in counts)) if (s := sum(a * b for a, b in zip(c, lengths))) <= capacity)
        picked = packing.best_pattern(np.array(lengths), np.array(counts), capacity)
        assert sum(k * v for k, v in picked.items()) == best
        assert all(v <= counts[lengths.index(k)] for k, v in picked.items())


def test_empty_table(docs_of):
    assert packing.pack(docs_of(["a"]).limit(0)).count() == 0


def test_added_tokens_are_single_ids_as_the_library_has_them_by_default(docs_of, sentence):
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    token = "<|endoftext|>"
    texts = ODD + [token, f"a {token}", f"{token}{token} b", f"don't {token}'s  x", f"{token[:-1]} {token}>", sentence(1, 2000) + token + sentence(2, 50)]
    pieces = defaultdict(list)
    for r in packing.pack(docs_of(texts), added=True).collect():
        pieces[r["doc_id"]].append(r)
    for i, t in enumerate(texts):
        ids = np.array(plain.encode(t, add_special_tokens=False).ids + [0], "<u4")
        assert (50256 in ids) == (token in t)
        assert sum(r["length"] for r in pieces[i]) == len(ids)
        for r in pieces[i]:
            assert r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())


def test_tables_of_a_worker_stay_small():
    import tracemalloc

    tracemalloc.start()
    try:
        packing._classes.__wrapped__()
        assert tracemalloc.get_traced_memory()[1] < 16 << 20
    finally:
        tracemalloc.stop()


def test_words_forgotten_are_encoded_again(tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "MOST_CACHED", 8)
    coder, texts = packing.Encoder(public_tokenizers.path("byte_bpe_50k.json")), [" ".join(f"w{(i * 7 + j) % 50}" for j in range(6)) for i in range(40)]
    for text in texts:
        assert coder.encode([text])[0].tolist() == tokenizer.encode(text, add_special_tokens=False).ids
