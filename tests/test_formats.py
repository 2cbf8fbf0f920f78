"""File formats by round trips, known values and damage."""

from __future__ import annotations

import hashlib
import io
import random
import zlib

import pytest

from annals.sources import commit_graph as cg
from annals.sources import packs as pk
from annals.sources import reftables as rt
from annals.sources import staging as st
from annals.sources import texts as tx


def oid(x) -> str:
    return hashlib.sha1(str(x).encode()).hexdigest()


# packs


@pytest.fixture(scope="module")
def pack():
    """(objects, pack bytes, entries, checksum): whole ones, differences by offset and by id, a large and an empty object."""
    r = random.Random(1)
    contents = [(f"line {i}\n" * 40 + "".join(r.choice("abc") for _ in range(300))).encode() for i in range(20)]
    contents += [contents[0] * 400 + b"tail", b""]
    objects = [(pk.object_id("blob", b), "blob", b) for b in contents]
    out = io.BytesIO()
    writer = pk.PackWriter(out, len(objects))
    for k, (o, kind, b) in enumerate(objects):
        if k in (3, 4, 20):
            base = objects[k - 1 if k < 20 else 0]
            writer.add(o, kind, b, base[0], pk.make_delta(base[2], b), by_id=k == 4)
        else:
            writer.add(o, kind, b)
    return objects, writer.close() and out.getvalue(), writer.entries, out.getvalue()[-20:]


def test_packs_are_parsed_and_searched(pack):
    objects, data, entries, mark = pack
    found, checksum = pk.parsed(io.BytesIO(data))
    assert sorted(x[:3] for x in found) == sorted(entries) and checksum == mark
    index = pk.PackIndex(pk.index_bytes(entries, mark))
    reader = pk.PackReader(io.BytesIO(data), index.find)
    assert all(reader.read(index.find(o))[:2] == (kind, b) for o, kind, b in objects)
    assert [reader.read(index.find(objects[k][0]))[2] for k in (0, 3, 4)] == [0, 1, 2]
    assert [o for o, _, _ in index] == sorted(o for o, _, _ in objects)
    assert index.find("00" * 20) is None and index.starting(objects[5][0][:6]) == [objects[5][0]] and not index.starting("0000000000")
    steps = index.by_offset()
    assert all(b == c for (_, b, _), (c, _, _) in zip(steps, steps[1:])) and steps[-1][1] == -1


@pytest.mark.parametrize("at", [3, 60, 2000, -1])
def test_damaged_packs_are_noticed(pack, at):
    data = bytearray(pack[1])
    data[at] ^= 1
    with pytest.raises((ValueError, zlib.error)):
        pk.parsed(io.BytesIO(bytes(data)))
    with pytest.raises((ValueError, zlib.error)):
        pk.parsed(io.BytesIO(pack[1][:500]))


def test_an_index_with_offsets_beyond_31_bits_and_damage(pack):
    rows = [(oid(k), k << 29, k) for k in range(9)]
    data = pk.index_bytes(rows, b"x" * 20)
    index = pk.PackIndex(data)
    assert all(index.find(o) == at for o, at, _ in rows) and index.checksum == b"x" * 20
    with pytest.raises(ValueError):
        pk.PackIndex(data[:-30] + b"\xff" + data[-29:])
    several = sorted((o, k % 3, at) for k, (o, at, _) in enumerate(rows))
    assert pk.read_multi_index(pk.multi_index_bytes(["a", "b", "c"], several)) == [(o, "abc"[p], at) for o, p, at in several]


def test_differences_of_random_contents():
    r = random.Random(3)
    for _ in range(300):
        a = bytes(r.choice(b"abcd\n") for _ in range(r.randint(0, 400)))
        b = a[: r.randint(0, len(a))] + bytes(r.choice(b"xyz") for _ in range(r.randint(0, 200))) + a[r.randint(0, len(a)) :]
        delta = pk.make_delta(a, b)
        assert pk.apply_delta(a, delta) == b and pk.delta_sizes(delta) == (len(a), len(b))
    with pytest.raises(ValueError):
        pk.apply_delta(b"other", pk.make_delta(b"base", b"target"))
    assert len(pk.make_delta(b"q" * 200_000, b"q" * 200_000 + b"!")) < 100


# reftables


REFS = [rt.Ref(f"refs/heads/b{i:05d}", 5 + i % 7, oid(i % 300)) for i in range(3000)] + [rt.Ref("HEAD", 5, target="refs/heads/b00001"), rt.Ref("refs/tags/v1", 6, oid("t"), oid(3)), rt.Ref("refs/gone", 7)]
LOGS = [rt.Log(f"refs/heads/b{i % 50:05d}", 100 + i, oid(i), oid(i + 1), "A U", "a@b", 1_700_000_000 + i, -90, f"msg {i}\n") for i in range(900)]


@pytest.fixture(scope="module")
def reftable():
    return rt.Reftable(rt.encode(REFS, LOGS))


def test_reftables_by_name_prefix_and_object(reftable):
    assert list(reftable.refs_from()) == sorted(REFS, key=lambda x: x.name)
    reftable.reads = 0
    assert reftable.ref("refs/heads/b01234") == REFS[1234] and reftable.reads <= 3  # of some thirty blocks
    assert reftable.ref("refs/heads/zzz") is None and reftable.ref("zzz") is None and reftable.ref("A") is None
    assert [x.name for x in reftable.with_prefix("refs/heads/b0012")] == [f"refs/heads/b{i:05d}" for i in range(120, 130)]
    for k in (7, 3, 299):
        assert {x.name for x in reftable.by_object(oid(k))} == {x.name for x in REFS if oid(k) in (x.oid, x.peeled)}
    assert not list(reftable.by_object(oid("none")))


def test_columns_are_the_refs(reftable):
    rows = [r for block in reftable.columns() for r in zip(*block)]
    assert [rt.Ref(n.decode(), i, o and o.hex(), p, t) for n, i, _, o, p, t in rows] == list(reftable.refs_from())
    assert [k for _, _, k, _, _, _ in rows] == [r.kind for r in reftable.refs_from()]


def test_reftable_logs_are_newest_first(reftable):
    assert list(reftable.logs()) == sorted(LOGS, key=lambda x: (x.name, -x.index))
    name = "refs/heads/b00007"
    assert list(reftable.logs(name)) == sorted((x for x in LOGS if x.name == name), key=lambda x: -x.index)
    assert not list(reftable.logs("refs/heads/none"))


@pytest.mark.parametrize("refs,logs", [([], []), (REFS[:3], []), ([], LOGS[:3]), (REFS[-1:], LOGS[:1])])
def test_small_reftables(refs, logs):
    made = rt.Reftable(rt.encode(refs, logs))
    assert list(made.refs_from()) == sorted(refs, key=lambda x: x.name) and list(made.logs()) == sorted(logs, key=lambda x: (x.name, -x.index))
    with pytest.raises(ValueError):
        rt.Reftable(rt.encode(refs, logs)[:-1] + b"!")


@pytest.mark.parametrize("sizes,want", [([], None), ([5], None), ([1000, 100, 10, 1], None), ([1000, 10, 9], (1, 3)), ([1000, 16, 17, 18, 2], (1, 4)), ([30, 16, 16], (0, 3))])
def test_stacks_fall_geometrically(sizes, want):
    assert rt.to_compact(sizes) == want


# staging index


def test_staging_round_trips():
    entries = [st.Entry(f"d{i % 5}/f{i}".encode(), 0o100644, oid(i), 0, i, 10**18 + i, i % 7 == 0, i % 11 == 0) for i in range(100)]
    entries += [st.Entry(b"x" * 5000, 0o100644, oid("x")), st.Entry(b"c", 0o100644, oid(1), 1), st.Entry(b"c", 0o100644, oid(2), 2)]
    for version in (2, 4):
        assert st.decode(st.encode(entries, version)) == sorted(entries, key=lambda e: e.key)
    with pytest.raises(ValueError):
        st.decode(st.encode(entries)[:-1] + b"?")
    assert st.unmerged(entries) == [b"c"] and [e.stage for e in st.resolved(entries, b"c", 2) if e.path == b"c"] == [0]
    after = st.edited(entries, [st.Entry(b"d1", 1, oid(5)), st.Entry(b"c/deep", 1, oid(6))], [b"d2/f2"])
    paths = [e.path for e in after]
    assert b"d1" in paths and b"c/deep" in paths and b"c" not in paths and b"d2/f2" not in paths and not [p for p in paths if p.startswith(b"d1/")]


def test_tree_objects():
    assert st.tree_id(b"") == "4b825dc642cb6eb9a060e54bf8d69288fbee4904"
    rows = [(b"a.b", 0o100644, oid(1)), (b"a", st.FOLDER, oid(2)), (b"a0", 0o100755, oid(3))]
    assert st.read_tree(st.tree_bytes(rows)) == [rows[0], rows[1], rows[2]]  # a.b < a/ < a0


def test_trees_of_deep_and_mixed_folders(spark):
    rows = [("a/b/c/d", 33188, oid(1)), ("a/x", 33188, oid(2)), ("top", 33188, oid(3)), ("q/r/s", 33188, oid(4))]
    made = {r.folder: (r.oid, bytes(r.data)) for r in st.trees_of(spark.createDataFrame(rows, "path string, mode int, oid string")).collect()}
    assert set(made) == {"", "a", "a/b", "a/b/c", "q", "q/r"}
    assert st.read_tree(made["a"][1]) == [(b"b", st.FOLDER, made["a/b"][0]), (b"x", 33188, oid(2))]
    assert [n for n, _, _ in st.read_tree(made[""][1])] == [b"a", b"q", b"top"] and all(st.tree_id(d) == o for o, d in made.values())


def test_changes_by_metadata(spark):
    entries = spark.createDataFrame([("a", 1, 5, 10, False, False), ("b", 1, 5, 10, False, False), ("c", 1, 5, 99, False, False), ("d", 1, 5, 10, False, False), ("e", 1, 5, 10, True, False), ("f", 1, 5, 10, False, False)], "path string, mode int, size long, mtime long, assume_valid boolean, skip_worktree boolean")
    files = spark.createDataFrame([("a", 1, 5, 10), ("b", 1, 6, 10), ("c", 1, 5, 99), ("d", 1, 5, 11)], "path string, mode int, size long, mtime long")
    got = dict(map(tuple, st.changed_by_metadata(entries, files, 50).collect()))
    assert got == {"a": "clean", "b": "dirty", "c": "smudged", "d": "touched", "e": "assumed", "f": "missing"}


# commit graph


def test_murmur_and_filters():
    assert [cg.murmur3(b""), cg.murmur3(b"hello"), cg.murmur3(b"hello, world")] == [0, 0x248BFA47, 0x149BBB7F]
    assert cg.path_filter([]) == b"\0" and cg.path_filter([f"p{i}".encode() for i in range(513)]) == b"\xff" and cg.may_have(b"", b"x")
    bloom = cg.path_filter([b"a/b/c"])
    assert all(cg.may_have(bloom, p) for p in (b"a", b"a/b", b"a/b/c")) and len(bloom) == 4


def test_commit_graphs():
    commits = [(oid(i), oid(f"t{i}"), [oid(j) for j in ([i - 1] if i else []) + ([i - 3] if i % 5 == 4 else []) + ([i - 4, i - 2] if i % 9 == 8 else [])], 1_700_000_000 + i * 2**26) for i in range(100)]
    graph = cg.CommitGraph(cg.encode(commits, {c[0]: [f"a/b{k}/c".encode()] for k, c in enumerate(commits)}))
    for k, c in enumerate(commits):
        at = graph.find(c[0])
        assert graph.at(at) == (*c, k + 1) and cg.may_have(graph.bloom(at), f"a/b{k}".encode())
    assert graph.find("f" * 40) is None and graph.statistics()["merges"] == 29
    assert sum(cg.may_have(graph.bloom(k), b"nothing/here") for k in range(100)) < 15


# texts


CONFIG = '[core]\n\tbare = true ; x\n a\n[remote "o"] url = a\\\n b\n fetch=+refs/heads/*:refs/remotes/o/*\n[branch "m"]\nremote = o\nmerge=refs/heads/m\n[pack]\nlimit=2k\n q = " a # b"\nkind = Two-Words\nage = 2 weeks\n[submodule "s"]\npath = lib\nurl = ../lib\n'


def test_configuration():
    made = tx.parse_config(CONFIG)
    c = tx.Config(made)
    assert c.boolean("core", None, "bare") and c.boolean("core", None, "a") and not c.boolean("core", None, "none")
    assert c.string("remote", "o", "url") == "a b" and c.number("pack", None, "limit") == 2048 and c.string("pack", None, "q") == " a # b"
    assert c.branch("m") == {"remote": "o", "merge": "refs/heads/m", "tracking": "refs/remotes/o/m", "rebase": "none"}
    assert c.choice("pack", None, "kind", ["ONE", "TWO_WORDS"], "ONE") == "TWO_WORDS" and c.duration("pack", None, "age") == 14 * 86400
    assert c.submodules()[0]["path"] == "lib" and tx.parse_config(tx.format_config(made)) == made
    assert tx.Config(c.put("core", None, "bare", "no").settings).boolean("core", None, "bare", True) is False
    assert tx.parse_config("[include]\npath = x\n", lambda p: "[a]\nb=1\n")[-1].value == "1"
    with pytest.raises(ValueError):
        tx.parse_config("[include]\npath = x\n", lambda p: "[include]\npath = x\n")
    for bad in ("a = b", "[core\n", '[a]\nb = "open\n', "[a]\nb = \\q\n"):
        with pytest.raises(ValueError):
            tx.parse_config(bad)
    with pytest.raises(ValueError):
        c.number("pack", None, "limit", high=100)


def test_ignore_rules():
    files = {"": tx.parse_ignore("*.o\n!keep.o\nbuild/\n/top\ndoc/*.txt\n**/deep\na/**\n[abc]x\n# no\nname\\ \n"), "sub": tx.parse_ignore("!x.o\n")}
    hit = ["x.o", "d/x.o", "build/x", "top", "doc/a.txt", "q/w/deep", "a/b", "bx", "name "]
    miss = ["keep.o", "build", "d/top", "doc/b/a.txt", "dx", "sub/x.o", "name", "a"]
    assert all(tx.is_ignored(files, p) for p in hit) and not any(tx.is_ignored(files, p) for p in miss)
    assert tx.is_ignored(files, "build", True)


def test_name_patterns():
    for pattern, name, want in [("*.c", "a.c", True), ("*.c", "d/a.c", False), ("a?c", "abc", True), ("[!a]b", "ab", False), ("[[:digit:]]x", "5x", True), ("[]a]", "]", True), ("a\\*", "a*", True), ("**/x", "x", True), ("**/x", "a/b/x", True), ("a/**", "a", False)]:
        assert tx.matches_name(pattern, name) is want, (pattern, name)


def test_attributes():
    files = {"": tx.parse_attributes("*.txt text eol=lf\n*.bin binary\n[attr]m1 x -y\n*.m m1\n"), "d": tx.parse_attributes("*.txt !eol -text\n")}
    assert tx.attributes_of(files, "d/a.txt") == {"text": False} and tx.attributes_of(files, "a.txt") == {"text": True, "eol": "lf"}
    assert tx.attributes_of(files, "q/a.bin") == {"diff": False, "merge": False, "text": False, "binary": True} and tx.attributes_of(files, "z.m") == {"x": True, "y": False, "m1": True}


PATCH = """diff --git a/x b/y
similarity index 90%
rename from x
rename to y
--- a/x
+++ b/y
@@ -1,3 +1,3 @@
 a
-b
+c
 d
diff --git a/n b/n
new file mode 100644
--- /dev/null
+++ b/n
@@ -0,0 +1 @@
+q
\\ No newline at end of file
diff --git a/z b/z
deleted file mode 100755
--- a/z
+++ /dev/null
@@ -1 +0,0 @@
-gone
diff --git a/i b/i
GIT binary patch
"""


def test_patches():
    made = tx.parse_patch(PATCH)
    assert [(p.old_path, p.new_path, p.change, p.score, len(p.hunks), p.binary) for p in made] == [("x", "y", "RENAME", 90, 1, False), (None, "n", "ADD", 0, 1, False), ("z", None, "DELETE", 0, 1, False), ("i", "i", "MODIFY", 0, 0, True)]
    assert tx.apply_hunks(["z\n", "a\n", "b\n", "d\n"], made[0].hunks) == ["z\n", "a\n", "c\n", "d\n"]  # one line further down
    assert tx.apply_hunks([], made[1].hunks) == ["q"] and tx.apply_hunks(["gone\n"], made[2].hunks) == []
    assert tx.apply_hunks(["a\r\n", "b\r\n", "d\r\n"], made[0].hunks) == ["a\r\n", "c\r\n", "d\r\n"]
    with pytest.raises(ValueError):
        tx.apply_hunks(["a\n", "x\n", "d\n"], made[0].hunks)


def test_quoting_and_small_formats():
    for s in ("a", "a b", 'é"\\\n\t\x01', "plain"):
        assert tx.dequote(tx.quote(s)) == s and tx.unbourne(tx.bourne(s + "'!")) == s + "'!"
    assert tx.quote("é") == '"\\303\\251"' and tx.dequote('"\\q"') == "\\q"
    assert tx.parse_ident("A B <a@b> 12 -0130") == ("A B", "a@b", 12, -90) and tx.format_ident(" A <B>", "a@b\n", 12, -90) == "A B <a@b> 12 -0130"
    assert tx.parse_pointer(tx.format_pointer(b"xyz"))[1] == 3 and tx.parse_pointer(b"no") is None and tx.parse_pointer(tx.format_pointer(b"") + b"zz" * 600) is None
    assert tx.unframe(tx.frame(b"ab") + tx.frame(None) + b"0001") == [b"ab", None, b"\1"]
    assert tx.side_bands(tx.frame(b"\1data") + tx.frame(b"\2note") + tx.frame(b"\1more") + tx.frame(None)) == {1: b"datamore", 2: b"note", 3: b""}
    bundle = tx.format_bundle([("a" * 40, "refs/heads/m")], [("b" * 40, "c d")], b"PACK..")
    assert tx.parse_bundle(bundle) == ([("a" * 40, "refs/heads/m")], [("b" * 40, "c d")], b"PACK..")
    steps = [("pick", "abc", "msg x"), ("comment", "", "# c"), ("squash", "def", "y")]
    assert tx.parse_todo(tx.format_todo(steps)) == steps and tx.parse_todo("f abc m\n") == [("fixup", "abc", "m")]
    assert tx.parse_fetch_head(tx.format_fetch_head("a" * 40, True, "refs/heads/m", "u")) == [("a" * 40, True, "branch", "m", "u")]
    line = tx.format_reflog("0" * 40, "1" * 40, "A", "a@b", 5, 60, "commit: x")
    assert tx.parse_reflog("junk\n" + line + line.replace("commit", "reset"))[0][-1] == "reset: x"
    manifest = '<manifest><remote name="r" fetch="https://h/"/><default remote="r" revision="main"/><project path="p" name="n"/><project name="q" revision="v"/><project name="z"/><remove-project name="z"/></manifest>'
    assert tx.parse_manifest(manifest) == [("p", "n", "https://h/n", "main", ""), ("q", "q", "https://h/q", "v", "")]
