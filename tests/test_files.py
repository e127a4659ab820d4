from codeloom.sources import files


def write(root, *names):
    for name in names:
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text("x = 1\n")


def test_what_is_left_out_is_never_read(spark, tmp_path):
    write(tmp_path, "a.py", "b.PY", "no.bin", "src/c.ts", "src/deep/d.ts", "app/[id]/e.ts", "app/[id]/{x}*/f.ts", "app/node_modules/g.ts", "app/[id]/.git/h.py", "node_modules/p/q/i.js", "pkg/bin/j.cs", "pkg/k l.cs")
    got = files.scan_tree(spark, str(tmp_path), "s")
    want = ["a.py", "app/[id]/e.ts", "app/[id]/{x}*/f.ts", "b.PY", "pkg/k l.cs", "src/c.ts", "src/deep/d.ts"]
    assert sorted(r["rel_path"] for r in got.collect()) == want
    read = got.inputFiles()
    assert len(read) == len(want) and not any("node_modules" in f or "no.bin" in f or ".git" in f or "/bin/" in f for f in read)


def test_trees_without_exclusions_and_with_nothing_else(spark, tmp_path):
    write(tmp_path / "plain", "a.py", "x/b.py")
    assert sorted(r["rel_path"] for r in files.scan_tree(spark, str(tmp_path / "plain"), "s").collect()) == ["a.py", "x/b.py"]
    write(tmp_path / "none", "node_modules/a.js")
    assert files.scan_tree(spark, str(tmp_path / "none"), "s").collect() == []
    assert files._roots(["", "a/b", "a/bin/x", "c/d"], ["bin"]) == (["a/b", "c"], [""])
