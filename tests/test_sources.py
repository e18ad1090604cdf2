from quern.sources import repository as repo


def test_tree(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "src/a.py").write_text("x = 1\ny = 2")
    (tmp_path / "src/b.bin").write_bytes(b"a\x00b")
    (tmp_path / "src/c.rb").write_text("puts 1\n")
    (tmp_path / "node_modules/d.js").write_text("1")
    (tmp_path / "src/e.py").write_text("#" * 1_000_001)
    got = {r["path"]: (r["language"], r["line_count"]) for r in repo.read_tree(spark, str(tmp_path)).collect()}
    assert got == {"src/a.py": ("python", 2)}
    assert {r["path"] for r in repo.read_tree(spark, str(tmp_path), keep_generic=True).collect()} == {"src/a.py", "src/c.rb"}


def test_history(spark, tmp_path):
    (tmp_path / "log").write_text("\x00c1\x00Ann\n\nsrc/a.py\nsrc/b.py\n\x00c2\x00Bo\n\nsrc/a.py\n")
    got = {tuple(r) for r in repo.read_history(spark, str(tmp_path / "log")).collect()}
    assert got == {("c1", "Ann", "src/a.py"), ("c1", "Ann", "src/b.py"), ("c2", "Bo", "src/a.py")}


def test_status(spark, tmp_path):
    (tmp_path / "st").write_text(" M a.py\nR  old.py -> new.py\n?? u.py\n!! ignored\n")
    assert {tuple(r) for r in repo.read_status(spark, str(tmp_path / "st")).collect()} == {("a.py", "M"), ("new.py", "R"), ("u.py", "??")}


def test_cobertura(spark, tmp_path):
    line = lambda n, h: f'<line number="{n}" hits="{h}"/>'
    body = f'<class filename="a.py"><lines>{line(1, 0)}{line(2, 3)}</lines></class><class filename="a.py"><lines>{line(5, 0)}{line(1, 0)}</lines></class><class filename="../x.py"><lines>{line(1, 0)}</lines></class>'
    (tmp_path / "c.xml").write_text(f"<coverage><classes>{body}</classes></coverage>")
    assert [(r["path"], r["uncovered_lines"]) for r in repo.read_cobertura(spark, str(tmp_path / "c.xml")).collect()] == [("a.py", [1, 5])]


def test_ignore_file(spark, tmp_path):
    (tmp_path / "ig").write_text("# no\n\n*.min.js\nbuild/\n")
    assert repo.ignore_patterns(spark, str(tmp_path / "ig")) == ["*.min.js", "build/"]


def test_one_log_is_read_by_many_tasks(spark, tmp_path):
    """Cut at headers, wherever the byte ranges end; a commit of many files and one of none among them."""
    commits = [(f"{i:040x}", f"Ann {i % 7}", [f"src/f{j}.py" for j in range(i % 9 if i != 50 else 3000)]) for i in range(3000)]
    (tmp_path / "log").write_text("\n".join("\x00" + c + "\x00" + a + "\n\n" + "\n".join(p) for c, a, p in commits) + "\n")
    size, before = (tmp_path / "log").stat().st_size, spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size // 11))
    try:
        rows = repo.read_commits(spark, str(tmp_path / "log"))
        assert rows.rdd.getNumPartitions() >= 11
        assert sorted((r["commit_id"], r["author"], r["paths"]) for r in rows.collect()) == sorted(commits)
        assert repo.read_history(spark, str(tmp_path / "log")).count() == sum(len(p) for _, _, p in commits)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r["commit_id"] for r in repo.latest_commits(spark, str(tmp_path / "log"), 3).collect()] == [c for c, _, _ in commits[:3]]


def test_diffs_by_file_and_hunk(spark, tmp_path):
    text = """diff --git a/a.py b/a.py
index 1..2 100644
--- a/a.py
+++ b/a.py
@@ -3 +3,2 @@ def f():
-x
+y
+@@ -9,9 +9,9 @@
@@ -10,4 +12,0 @@
-rename to zz.py
diff --git a/old name.py b/new name.py
similarity index 100%
rename from old name.py
rename to new name.py
diff --git a/gone.py b/gone.py
deleted file mode 100644
--- a/gone.py
+++ /dev/null
@@ -1,2 +0,0 @@
-a
-b
diff --git a/bin b/bin
new file mode 100644
Binary files /dev/null and b/bin differ
diff --git a/new.py b/new.py
new file mode 100644
--- /dev/null
+++ b/new.py
@@ -0,0 +1 @@
+x
"""
    (tmp_path / "d").write_text(text)
    diff = repo.read_diff(spark, str(tmp_path / "d"))
    got = {r["path"]: (r["old_path"], r["change"], [tuple(h) for h in r["hunks"]]) for r in diff.collect()}
    assert got == {
        "a.py": ("a.py", "changed", [(3, 1, 3, 2), (10, 4, 12, 0)]),
        "new name.py": ("old name.py", "renamed", []),
        "gone.py": ("gone.py", "deleted", [(1, 2, 0, 0)]),
        "bin": ("bin", "added", []),
        "new.py": ("new.py", "added", [(0, 0, 1, 1)]),
    }
    assert {tuple(r) for r in repo.changed_lines(diff).collect()} == {("a.py", 3, 4), ("new.py", 1, 1)}
    status = spark.createDataFrame([("a.py", "M"), ("u.py", "??")], "path string, status string")
    assert {r["path"] for r in repo.changed_since(diff, status).collect()} == {*got, "u.py"}
