import pytest

from codeloom.sources.stored import Stored

SCHEMA = "source_name string, entity_id string, v int"


def rows(df):
    return sorted((r["source_name"], r["entity_id"], r["v"]) for r in df.collect())


def test_only_changed_sources_are_written_and_all_count_at_once(spark, tmp_path, monkeypatch):
    at = Stored(spark, str(tmp_path / "g"))
    first = [("a", "1", 1), ("a", "2", None), ("b", "3", 3)]
    at.write({"entities": spark.createDataFrame(first, SCHEMA), "edges": spark.createDataFrame([], SCHEMA)})
    assert rows(at.read("entities")) == first and at.read("edges").collect() == []
    old = {r["source_name"]: r["build"] for r in at.manifest() if r["table"] == "entities"}

    second = [("a", "1", 1), ("a", "2", None), ("b", "3", 4), ("c", "5", 5)]
    df = spark.createDataFrame(second, SCHEMA)

    # A write that fails after its parts leaves the graph before it.
    real = Stored._add
    def lost(self, part, table, build, counts):
        real(self, part, table, build, counts)
        raise RuntimeError("lost")
    monkeypatch.setattr(Stored, "_add", lost)
    with pytest.raises(RuntimeError):
        at.write({"entities": df, "edges": df})
    monkeypatch.undo()
    assert rows(at.read("entities")) == first and at.read("edges").collect() == []

    at.write({"entities": df, "edges": spark.createDataFrame([], SCHEMA)})
    new = {r["source_name"]: r["build"] for r in at.manifest() if r["table"] == "entities"}
    assert rows(at.read("entities")) == second and new["a"] == old["a"] and new["b"] != old["b"] and set(new) == {"a", "b", "c"}

    # A source that is gone is not read any more; what no one reads is deleted.
    at.write({"entities": df.where("source_name <> 'a'"), "edges": spark.createDataFrame([], SCHEMA)})
    assert {r[0] for r in rows(at.read("entities"))} == {"b", "c"}
    assert at.vacuum() == 2 and rows(at.read("entities")) == second[2:]


def test_of_two_writers_one_is_told(spark, tmp_path, monkeypatch):
    one, two = Stored(spark, str(tmp_path / "g")), Stored(spark, str(tmp_path / "g"))
    df = spark.createDataFrame([("a", "1", 1)], SCHEMA)
    real = Stored._add
    def between(self, *a):
        real(self, *a)
        monkeypatch.setattr(Stored, "_add", real)
        two.write({"entities": df.withColumn("v", df.v + 1)})
    monkeypatch.setattr(Stored, "_add", between)
    try:
        one.write({"entities": df})
        kept = 1
    except RuntimeError:
        kept = 2
    assert rows(one.read("entities")) == [("a", "1", kept)]


def test_a_folder_without_tables(spark, tmp_path):
    at = Stored(spark, str(tmp_path / "none"))
    assert at.manifest() == [] and at.tables() == []
    with pytest.raises(ValueError):
        at.read("entities")
