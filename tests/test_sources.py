"""Sources against hand-made files."""

from __future__ import annotations

import pytest

from annals.operators.walks import parse_revision
from annals.sources import loose_objects, packed_refs


def test_packed_refs(spark, tmp_path):
    a, b = "a" * 40, "b" * 40
    (tmp_path / "packed").write_text(f"# pack-refs with: peeled\n{a} refs/heads/main\n{b} refs/tags/v1\n^{a}\n{a} refs/tags/v2\nnonsense\n")
    rows = packed_refs.read(spark, f"{tmp_path}/packed")
    assert sorted(map(tuple, rows.select("name", "oid", "peeled").collect()), key=str) == [("refs/heads/main", a, None), ("refs/tags/v1", b, a), ("refs/tags/v2", a, None)]
    text = {r.name: r.text for r in packed_refs.formatted(rows).collect()}
    assert text["refs/tags/v1"] == f"{b} refs/tags/v1\n^{a}"
    (tmp_path / "none").write_text("")
    assert packed_refs.read(spark, f"{tmp_path}/none").count() == 0


def test_loose_objects(spark, tmp_path):
    commit = b"tree " + b"c" * 40 + b"\nparent " + b"d" * 40 + b"\nparent " + b"e" * 40 + b"\nauthor A B <a@example.com> 1700000000 +0100\ncommitter C <c@example.com> 1700000001 +0100\n\nSubject\n\nbody\n"
    ids = {}
    for name, kind, data in (("x", "blob", b"hello\n"), ("y", "tree", b""), ("z", "commit", commit)):
        ids[name], content = loose_objects.encode(kind, data)
        (tmp_path / name).write_bytes(content)
    (tmp_path / "bad").write_bytes(b"not zlib")
    found = loose_objects.read(spark, str(tmp_path)).collect()
    assert ids["x"] == "ce013625030ba8dba906f756967f9e9ca394464a" and ids["y"] == "4b825dc642cb6eb9a060e54bf8d69288fbee4904"
    assert {r.oid for r in found} == {*ids.values(), None} and sum(r.problem is not None for r in found) == 1
    (made,) = loose_objects.commits(loose_objects.read(spark, str(tmp_path))).collect()
    assert (made.oid, made.tree, made.parents, made.author, made.author_time, made.message) == (ids["z"], "c" * 40, ["d" * 40, "e" * 40], "A B", 1700000000, "Subject\n\nbody\n")


def test_revisions():
    assert parse_revision("u7~3^2^") == ("u7", [("~", 3), ("^", 2), ("^", 1)])
    with pytest.raises(ValueError):
        parse_revision("~3")
