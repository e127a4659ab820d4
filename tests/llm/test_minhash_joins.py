"""What is known of a text is joined once a text, not once for each of its buckets."""

from codeloom.llm import minhash
from codeloom.llm._spark import Scratch


def test_open_texts_have_one_row_each(docs_of, sentence, monkeypatch):
    base = sentence(3, 100, 5000).split()
    texts = [" ".join(f"w{i}" if j in (i, i + 33, i + 66) else w for j, w in enumerate(base)) for i in range(33)]
    seen, real = [], Scratch.cut

    def spy(self, df, name):
        out = real(self, df, name)
        if "pivot" in df.columns and "bands" in df.columns:
            seen.append((out.count(), out.select("rep").distinct().count()))
        return out

    monkeypatch.setattr(Scratch, "cut", spy)
    assert minhash.classes(docs_of(texts)).count() == 33
    assert seen and max(n for n, _ in seen) > 2 and all(n == different for n, different in seen)
