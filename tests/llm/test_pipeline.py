"""The stages of the pipeline, each on its own input, and all together."""

import collections

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from codeloom.llm import mixing, toxicity
from codeloom.llm.queries import MIXED_SHARE, id_class
from test_mixing import PLACE, brute


@pytest.fixture
def made(spark, docs_of, sentence, tmp_path):
    """A folder with documents and labels: toxic rows, a repeated passage and line, near copies, nulls, an extra column."""
    passage, line = sentence(900, 70, 9000), sentence(901, 12, 9000)
    texts = [sentence(i, 90, 9000) for i in range(60)]
    toxic = {i for i in range(60) if i % 4 == 0}
    texts = [f"{t} grobulon snarkfit grobulon {t[:20]}" if i in toxic else t for i, t in enumerate(texts)]
    texts[3], texts[9] = f"{texts[3]}\n{passage}", f"{passage}\n{texts[9]}\n{line}"
    texts[10] = f"{line}\n{texts[10]}"
    texts[21], texts[22] = texts[1].rsplit(" ", 1)[0] + " other", texts[2]
    texts[30], texts[31], texts[33] = None, "", sentence(77, 30_000, 40_000)
    docs = docs_of(texts, sources=[("hot" if i % 3 else f"s{i % 2}") if i != 41 else None for i in range(60)]).withColumn("_found", F.lit("x"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path), texts, toxic


def test_stages_against_brute_force(spark, made):
    docs, folder, texts, toxic = made
    names = [n for n, _ in pipeline.STAGES]
    assert names == ["toxicity", "line dedup", "near dedup", "mixing", "packing"]
    stage = dict(pipeline.STAGES)

    lexicon = toxicity.fit(docs, spark.read.parquet(f"{folder}/labels.parquet").where(id_class("doc_id", 5) != 0))
    matcher = toxicity.Matcher(lexicon)
    clean = stage["toxicity"](spark, docs, folder).cache()
    assert clean.columns == docs.columns
    kept = {r["doc_id"] for r in clean.collect()}
    assert kept == {i for i, t in enumerate(texts) if matcher.score(t) < 0.5} and not kept & toxic and len(kept) == 60 - len(toxic)

    lines = stage["line dedup"](spark, clean, folder).cache()
    assert lines.columns == docs.columns and lines.count() == clean.count()
    got = {r["doc_id"]: r["text"] for r in lines.collect()}
    changed = {i for i in got if got[i] != texts[i]}
    assert changed == {9, 10, 21, 22} and got[10] == texts[10].split("\n")[1] and got[9].split("\n")[0] == texts[9].split("\n")[1]
    assert got[22] == "" and len(got[21].split()) <= 1

    near = stage["near dedup"](spark, clean, folder)
    assert near.columns == docs.columns and {r["doc_id"] for r in near.collect()} == kept - {21, 22, 31}

    mixed = stage["mixing"](spark, lines, folder)
    assert mixed.columns == docs.columns
    rows = [(r["doc_id"], r["text"], r["source"], r["place"]) for r in lines.selectExpr("doc_id", "text", "source", PLACE).collect()]
    exponent, _, copies = brute(rows, mixing.GAIN, MIXED_SHARE, mixing.MAX_REPEATS)
    assert exponent < 1 and collections.Counter(r["doc_id"] for r in mixed.collect()) == {i: v for (i, _), v in copies.items() if v}

    packed = stage["packing"](spark, lines, folder).collect()
    by, rooms = collections.Counter(), collections.defaultdict(list)
    for r in packed:
        by[r["doc_id"]] += r["length"]
        rooms[r["sequence_id"]].append((r["offset"], r["length"]))
    assert by == {r["doc_id"]: r["doc_tokens"] for r in packed} and set(by) == kept
    for own in rooms.values():
        assert [a for a, _ in sorted(own)] == [sum(n for _, n in sorted(own)[:i]) for i in range(len(own))] and sum(n for _, n in own) <= 1024


def test_run_and_an_empty_table(spark, made, tmp_path):
    docs, folder, _, toxic = made
    out = pipeline.run(spark, folder)
    ids = {r["doc_id"] for r in out.select("doc_id").distinct().collect()}
    # Of the texts that line dedup left empty, and the empty ones, that of the smallest id stays; mixing draws some documents not at all.
    assert ids <= set(range(60)) - toxic - {30, 31} and len(ids) >= 35 and 22 in ids
    for name, stage in pipeline.STAGES:
        assert stage(spark, docs.limit(0), folder).count() == 0, name
