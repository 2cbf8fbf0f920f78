"""Commands, object rules and extension points on small tables."""

from __future__ import annotations

import io
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from annals import extensions as ext
from annals.operators import checks, commands
from annals.sources import texts
from tests.test_formats import oid
from tests.test_history import graph, ids

EDGES = {1: [], 2: [1], 3: [2], 4: [2], 5: [3, 4]}


@pytest.fixture
def now(spark):
    return spark.createDataFrame([("refs/heads/a", 3), ("refs/heads/b", 4), ("refs/tags/t", 1)], "name string, oid long")


def updates(spark, *rows):
    return spark.createDataFrame(list(rows), "name string, old long, new long, force boolean")


def test_updates_of_refs(spark, now):
    asked = updates(spark, ("refs/heads/a", 3, 5, False), ("refs/heads/b", 4, 3, False), ("refs/tags/t", 9, None, False), ("refs/heads/n", None, 2, False), ("refs/heads/a/x", None, 2, False), ("HEAD", None, 5, False))
    after, results = commands.update_refs(now, asked, graph(spark, EDGES))
    assert dict(ids(results, "name", "status")) == {"refs/heads/a": "FAST_FORWARD", "refs/heads/b": "REJECTED", "refs/tags/t": "LOCK_FAILURE", "refs/heads/n": "NEW", "refs/heads/a/x": "CONFLICT", "HEAD": "NEW"}
    assert ids(after, "name", "oid") == [("HEAD", 5), ("refs/heads/a", 5), ("refs/heads/b", 4), ("refs/heads/n", 2), ("refs/tags/t", 1)]
    after, results = commands.update_refs(now, asked, graph(spark, EDGES), atomic=True)
    assert ids(after, "name") == ids(now, "name") and dict(ids(results, "name", "status"))["refs/heads/a"] == "ABORTED"
    after, results = commands.update_refs(now, updates(spark, ("refs/heads/b", 4, 3, True), ("refs/heads/a", 3, None, False), ("refs/heads/a/x", None, 2, False)), graph(spark, EDGES))
    assert dict(ids(results, "name", "status")) == {"refs/heads/b": "FORCED", "refs/heads/a": "DELETED", "refs/heads/a/x": "NEW"}


def test_many_updates_walk_with_their_names(spark):
    rows = {k: [k - 1] if k else [] for k in range(70)}
    now = spark.createDataFrame([(f"refs/heads/b{k}", k) for k in range(1, 66)], "name string, oid long")
    asked = updates(spark, *[(f"refs/heads/b{k}", k, k + 1 if k % 2 else k - 1, False) for k in range(1, 66)])
    got = dict(ids(commands.update_refs(now, asked, graph(spark, rows))[1], "name", "status"))
    assert all(got[f"refs/heads/b{k}"] == ("FAST_FORWARD" if k % 2 else "REJECTED") for k in range(1, 66))


def test_logs_renames_and_expiry(spark, now):
    log = spark.createDataFrame([("refs/heads/a", 1, 1, 2, "u", 10, "x"), ("refs/heads/a", 2, 2, 3, "u", 20, "y")], "ref string, update_index long, old long, new long, who string, seconds long, comment string")
    after = now.where("name <> 'refs/tags/t'").unionByName(spark.createDataFrame([("refs/heads/n", 9)], "name string, oid long")).withColumn("oid", F.when(F.col("name") == "refs/heads/a", 5).otherwise(F.col("oid")))
    full = commands.appended_log(log, now, after, "me", "move", 30)
    assert ids(full.where("seconds = 30"), "ref", "update_index", "old", "new") == [("refs/heads/a", 3, 3, 5), ("refs/heads/n", 1, None, 9), ("refs/tags/t", 1, 1, None)]
    names, moved = commands.renamed_ref(now, log, "refs/heads/a", "refs/heads/z")
    assert "refs/heads/z" in ids(names, "name") and set(ids(moved, "ref")) == {"refs/heads/z"}
    with pytest.raises(ValueError):
        commands.renamed_ref(now, log, "refs/heads/a", "refs/heads/b")
    assert ids(commands.expired_log(log, 15), "new") == [3]
    assert ids(commands.expired_log(log, 5, spark.createDataFrame([(2,)], "oid long"), 100), "new") == [2]
    assert commands.deleted_branches(now, ["refs/heads/a", "refs/heads/b"], 3, graph(spark, EDGES))[1] == ["refs/heads/b"]
    assert [r.short for r in commands.listed(now, "refs/heads/").collect()] == ["a", "b"]


def test_fetching_by_refspecs(spark, now):
    remote = spark.createDataFrame([("refs/heads/a", 5), ("refs/heads/new", 2), ("refs/pull/1", 4)], "name string, oid long")
    local = spark.createDataFrame([("refs/remotes/o/a", 3)], "name string, oid long")
    assert ids(commands.fetched(remote, local, ["+refs/heads/*:refs/remotes/o/*"]), "name", "old", "new", "force") == [("refs/remotes/o/a", 3, 5, True), ("refs/remotes/o/new", None, 2, True)]


def test_objects_and_transfer(spark):
    author = "U <u@x> 5 +0100"
    made = commands.commit_bytes("a" * 40, ["b" * 40, "b" * 40], author, author, "Hello\n", "ISO-8859-1")
    assert made == f"tree {'a' * 40}\nparent {'b' * 40}\nauthor {author}\ncommitter {author}\nencoding ISO-8859-1\n\nHello\n".encode() and checks.problems("commit", made) == []
    assert checks.problems("tag", commands.tag_bytes("a" * 40, "commit", "v1", author, "m\n")) == []
    store = spark.createDataFrame([("1", "blob", bytearray(b"x"))], "oid string, type string, data binary")
    more = spark.createDataFrame([("1", "blob", bytearray(b"x")), ("2", "blob", bytearray(b"y")), ("2", "blob", bytearray(b"y"))], "oid string, type string, data binary")
    once = commands.inserted(store, more)
    assert ids(once, "oid") == ["1", "2"] == ids(commands.inserted(once, more), "oid")
    send, told = commands.negotiated(graph(spark, EDGES), [5], [[99, 77], [3, 98]])
    assert ids(send, "oid") == [4, 5] and told == [[], [3]]
    advertised = spark.createDataFrame([(3,)], "oid long")
    assert [commands.refused_wants(advertised, graph(spark, EDGES), [3, 1, 5], p) for p in ("advertised", "reachable", "any")] == [[1, 5], [5], []]


def test_change_ids():
    message = "Fix\n\nBody.\n\nSigned-off-by: U <u@x>\n"
    made = commands.with_change_id(message, "I1")
    assert made == "Fix\n\nBody.\n\nChange-Id: I1\nSigned-off-by: U <u@x>\n" and commands.with_change_id(made, "I2") == made
    assert "Change-Id: I2" in commands.with_change_id(made, "I2", replace=True) and commands.with_change_id("Fix\n", "I1") == "Fix\n\nChange-Id: I1\n"
    assert len(commands.change_id("a" * 40, None, "x", "y", "m")) == 41


def entries(spark, *rows):
    return spark.createDataFrame(list(rows), "path string, mode int, oid string")


def test_staging_cleaning_resetting_and_stashing(spark):
    head = entries(spark, ("a", 1, "1"), ("d/b", 1, "2"))
    index = entries(spark, ("a", 1, "1"), ("d/b", 1, "3"), ("n", 1, "4"))
    work = entries(spark, ("a", 1, "9"), ("n", 1, "4"), ("u.o", 1, "5"), ("u", 1, "6"))
    assert ids(commands.added(index, work, ["a", "u"]), "path", "oid") == [("a", "9"), ("d/b", "3"), ("n", "4"), ("u", "6")]
    assert ids(commands.added(index, work, ["."], update=True), "path", "oid") == [("a", "9"), ("n", "4")]
    assert ids(commands.removed(index, ["d"]), "path") == ["a", "n"]
    assert ids(commands.cleaned(index, work, {"": texts.parse_ignore("*.o\n")}), "path") == ["u"]
    assert ids(commands.reset("mixed", head, index, work)[0], "path", "oid") == [("a", "1"), ("d/b", "2")]
    assert ids(commands.reset("hard", head, index, work)[1], "path", "oid") == [("a", "1"), ("d/b", "2"), ("u", "6"), ("u.o", "5")]
    kept_index, kept_work, _, after = commands.stashed(head, index, work)
    assert ids(kept_work, "path", "oid") == [("a", "9"), ("n", "4")] and kept_index is index and ids(after, "path") == ["a", "d/b", "u", "u.o"]


def test_checkout_decisions(spark):
    head = entries(spark, ("same", 1, "1"), ("upd", 1, "1"), ("dirty", 1, "1"), ("gone", 1, "1"), ("staged", 1, "1"), ("gone dirty", 1, "1"))
    target = entries(spark, ("same", 1, "1"), ("upd", 1, "2"), ("dirty", 1, "2"), ("staged", 1, "2"), ("new", 1, "3"), ("in the way", 1, "3"))
    index = entries(spark, ("same", 1, "1"), ("upd", 1, "1"), ("dirty", 1, "1"), ("gone", 1, "1"), ("staged", 1, "7"), ("gone dirty", 1, "1"))
    work = entries(spark, ("same", 1, "5"), ("upd", 1, "1"), ("dirty", 1, "8"), ("gone", 1, "1"), ("staged", 1, "7"), ("gone dirty", 1, "4"), ("in the way", 1, "9"))
    assert dict(ids(commands.checkout_decisions(head, target, index, work), "path", "action")) == {"same": "keep", "upd": "update", "dirty": "conflict", "gone": "remove", "staged": "conflict", "gone dirty": "conflict", "new": "update", "in the way": "conflict"}


def contents(spark, files):
    return spark.createDataFrame([(p, 0o100644, bytearray(t.encode())) for p, t in files.items()], "path string, mode int, data binary")


def test_checkout_scan_and_archives(spark, tmp_path):
    tree = contents(spark, {"a.txt": "one", "d/b.txt": "two", "d/x.o": "three"})
    assert ids(commands.checked_out(tree, str(tmp_path / "work")), "path", "bytes") == [("a.txt", 3), ("d/b.txt", 3), ("d/x.o", 5)]
    found = commands.work_tree(spark, str(tmp_path / "work"), {"": texts.parse_ignore("*.o\n")})
    assert ids(found, "path", "size") == [("a.txt", 3), ("d/b.txt", 3)]
    with pytest.raises(Exception, match="unsafe path"):
        commands.checked_out(contents(spark, {"../x": "y"}), str(tmp_path / "bad")).count()
    for kind in ("tar", "tgz", "tbz2", "txz", "zip"):
        commands.archived(tree, str(tmp_path / kind), kind, "p/").count()
        (file,) = (tmp_path / kind).glob(f"archive-*.{kind}")
        if kind == "zip":
            z = zipfile.ZipFile(file)
            got = {n: z.read(n) for n in z.namelist()}
        else:
            t = tarfile.open(fileobj=io.BytesIO(file.read_bytes()))
            got = {m.name: t.extractfile(m).read() for m in t}
        assert got == {"p/a.txt": b"one", "p/d/b.txt": b"two", "p/d/x.o": b"three"}


def test_patched_trees(spark):
    patch = "diff --git a/a b/c\nrename from a\nrename to c\n--- a/a\n+++ b/c\n@@ -1 +1 @@\n-1\n+2\ndiff --git a/n b/n\nnew file mode 100644\n--- /dev/null\n+++ b/n\n@@ -0,0 +1 @@\n+new\ndiff --git a/g b/g\ndeleted file mode 100644\n--- a/g\n+++ /dev/null\n@@ -1 +0,0 @@\n-x\ndiff --git a/w b/w\n--- a/w\n+++ b/w\n@@ -1 +1 @@\n-not there\n+y\n"
    got = {r.path: (bytes(r.data), r.problem) for r in commands.patched(contents(spark, {"a": "1\n", "g": "x\n", "w": "w\n", "k": "k"}), patch).collect()}
    assert got["c"] == (b"2\n", None) and got["n"] == (b"new\n", None) and got["k"] == (b"k", None) and set(got) == {"c", "n", "w", "k"} and got["w"][0] == b"w\n" and "doesn't apply" in got["w"][1]


def test_notes_submodules_and_messages(spark):
    assert commands.note_path("abcdef", 0) == "abcdef" and commands.note_path("abcdef", 2) == "ab/cd/ef"
    notes = spark.createDataFrame([("1", "a"), ("2", "b")], "oid string, note string")
    assert ids(commands.noted(notes, spark.createDataFrame([("1", None), ("3", "c")], "oid string, note string")), "oid", "note") == [("2", "b"), ("3", "c")]
    links = entries(spark, *[(p, 0o160000, "1") for p in "abcde"], ("file", 0o100644, "2"))
    config = spark.createDataFrame([("a", "a", "u"), ("b", "b", "u"), ("c", "c", "u"), ("d", "d", None)], "path string, name string, url string")
    heads = spark.createDataFrame([("a", "1"), ("b", "2")], "path string, oid string")
    assert dict(ids(commands.submodule_status(links, config, heads), "path", "status")) == {"a": "CURRENT", "b": "REV_CHECKED_OUT", "c": "INITIALIZED", "d": "UNINITIALIZED", "e": "MISSING"}
    assert commands.merge_message(["refs/heads/a", "refs/heads/b", "refs/tags/v"], "refs/heads/dev") == "Merge branches 'a' and 'b', tag 'v' into dev" and commands.merge_message(["refs/heads/a"], "refs/heads/main") == "Merge branch 'a'"
    assert commands.squash_message([("1", "U", "today", "a\nb")]) == "Squashed commit of the following:\n\ncommit 1\nAuthor: U\nDate:   today\n\n\ta\n\tb\n"


def test_object_rules():
    person = "A <a> 1 +0000"
    assert checks.problems("commit", f"tree {'a' * 40}\nauthor A a 1 +0000\ncommitter {person}\n\nx".encode()) == ["bad author"]
    assert checks.problems("commit", f"parent {'a' * 40}\nauthor {person}\n\nx".encode())[0] == "no tree"
    assert checks.problems("blob", b"anything") == [] and checks.problems("odd", b"") == ["unknown type odd"] and checks.problems("tree", b"100644 a") == ["truncated"]
    row = lambda mode, name: f"{mode} {name}".encode() + b"\0" + b"\1" * 20
    assert checks.problems("tree", row("100644", "a") + row("40000", "b")) == []
    assert checks.problems("tree", row("100644", "b") + row("100644", "a")) == ["not in order"] and checks.problems("tree", row("100644", "a") + row("100644", "a")) == ["duplicate name"]
    assert "names that differ by case only" in checks.problems("tree", row("100644", "A") + row("100644", "a")) and checks.problems("tree", row("100600", "a")) == ["mode 100600"]
    for bad in ("", ".", "..", ".git", ".GIT", "a/b", ".gi‌t", "git~1", "aux.c", "a.", "a:b"):
        assert checks.path_problem(bad), bad
    assert not any(checks.path_problem(x) for x in ("a", ".gitignore", "auxiliary", "a b"))
    assert all(checks.ref_problem(x) for x in ("a", "refs/heads/.a", "refs/a..b", "refs/a.lock", "refs//a", "refs/a b", "refs/a@{b", "refs/a/")) and not checks.ref_problem("refs/heads/a-b.c")


# extension points


def test_predicates_sources_and_mergers(spark):
    ext.register("revision predicate", "even", ext.as_columns(lambda c: c["oid"] % 2 == 0))
    ext.register("revision predicate", "odd", lambda row: row["oid"] % 2 == 1)
    ext.register("tree predicate", "no vendor", lambda path, folder: ext.SKIP if folder and path == "vendor" else ext.INCLUDE)
    ext.register("tree source", "made", lambda spark, n: [(f"f{k}", 1, str(k)) for k in range(n)])
    ext.register("note merger", "longest", lambda b, o, t: max(filter(None, (b, o, t)), key=len))
    ext.register("hook", "pre-receive:no deletions", lambda rows: "no" if not rows.where("new is null").isEmpty() else None)
    try:
        commits = spark.createDataFrame([(k,) for k in range(6)], "oid long")
        assert ids(ext.commits_where(commits, "even"), "oid") == [0, 2, 4] and ids(ext.commits_where(commits, "odd"), "oid") == [1, 3, 5]
        assert ids(ext.entries_where(entries(spark, ("a", 1, "1"), ("vendor/x/y", 1, "2"), ("b/vendor", 1, "3")), "no vendor"), "path") == ["a", "b/vendor"]
        assert ids(ext.tree_from(spark, "made", 2), "path") == ["f0", "f1"]
        note = lambda *rows: spark.createDataFrame(list(rows), "oid string, note string")
        base, ours, theirs = note(("1", "x"), ("2", "x")), note(("1", "ours!"), ("2", "x")), note(("1", "t"), ("2", "y"), ("3", "z"))
        assert ids(ext.merged_notes(base, ours, theirs, "longest"), "oid", "note") == [("1", "ours!"), ("2", "y"), ("3", "z")]
        assert ids(ext.merged_notes(base, ours, theirs), "oid", "note")[0] == ("1", "ours!\nt")
        now = spark.createDataFrame([("refs/heads/a", 3)], "name string, oid long")
        after, results = commands.update_refs(now, updates(spark, ("refs/heads/a", 3, None, False)))
        assert ids(after, "name") == ["refs/heads/a"] and ids(results, "status") == ["ABORTED"]
        with pytest.raises(ValueError):
            ext.register("hook", "pre-receive:no deletions", None)
        with pytest.raises(KeyError):
            ext.find("merge strategy", "none")
    finally:
        for kind, name in (("revision predicate", "even"), ("revision predicate", "odd"), ("tree predicate", "no vendor"), ("tree source", "made"), ("note merger", "longest"), ("hook", "pre-receive:no deletions")):
            ext.unregister(kind, name)


def test_content_filters_and_algorithms(spark):
    from annals.operators import alignment

    rows = contents(spark, {"a": "1\r\n2\n"}).select("path", "data")
    assert bytes(ext.filtered(rows, "eol lf").first().data) == b"1\n2\n" and bytes(ext.filtered(rows, "eol crlf", clean=False).first().data) == b"1\r\n2\r\n"
    pointer = bytes(ext.filtered(rows, "large files").first().data)
    assert texts.parse_pointer(pointer)[1] == 5
    ext.register("diff algorithm", "nothing", lambda a, b: [])
    try:
        assert alignment.edits(["x"], ["x"], "nothing") == [(0, 1, 0, 1)]
    finally:
        ext.unregister("diff algorithm", "nothing")
    assert oid("x") == oid("x")
