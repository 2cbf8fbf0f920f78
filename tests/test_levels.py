"""Walks by level, bitmaps, dates, the command line."""

from __future__ import annotations

from datetime import datetime, timezone

import numpy as np
import pytest

from annals import __main__ as cli
from annals.functions import dates
from annals.operators import bitmaps, levels
from annals.sources import staging
from tests.test_formats import oid
from tests.test_history import graph, ids, random_graph


@pytest.fixture
def forest(spark):
    """(entries, root of one tree, root of another): a folder in place of a file, an equal subtree, a deep change."""
    one = [("same/x", 33188, oid(1)), ("same/y/z", 33188, oid(2)), ("a/b/c", 33188, oid(3)), ("swap", 33188, oid(4)), ("gone", 33188, oid(5))]
    two = [("same/x", 33188, oid(1)), ("same/y/z", 33188, oid(2)), ("a/b/c", 33261, oid(3)), ("swap/in", 33188, oid(6)), ("a/new", 33188, oid(7))]
    made = [staging.trees_of(spark.createDataFrame(t, "path string, mode int, oid string")) for t in (one, two)]
    roots = [m.where("folder = ''").first().oid for m in made]
    return levels.entries_of(made[0].unionByName(made[1])), *roots


def test_diff_by_level(forest):
    assert ids(levels.diff(*forest), "path", "old_id", "new_id") == [("a/b/c", oid(3), oid(3)), ("a/new", None, oid(7)), ("gone", oid(5), None), ("swap", oid(4), None), ("swap/in", None, oid(6))]
    assert levels.diff(forest[0], forest[1], forest[1]).count() == 0
    assert ids(levels.diff(forest[0], None, forest[2]), "path") == ["a/b/c", "a/new", "same/x", "same/y/z", "swap/in"]


def test_walk_lookup_and_order(forest):
    rows, root, _ = forest
    assert ids(levels.walk(rows, root), "path") == ["a/b/c", "gone", "same/x", "same/y/z", "swap"]
    assert ids(levels.walk(rows, root, below="same/y"), "path") == ["same/y/z"]
    assert levels.look_up(rows, root, "same/y/z") == (33188, oid(2)) and levels.look_up(rows, root, "same/y")[0] == levels.FOLDER
    assert levels.look_up(rows, root, "swap/in") is None and levels.look_up(rows, root, "none") is None
    order = [p for _, p in sorted((n, p) for p, n in ids(levels.post_order(levels.walk(rows, root, folders=True)), "path", "pos"))]
    assert order == ["a/b/c", "a/b", "a", "gone", "same/x", "same/y/z", "same/y", "same", "swap"]


def test_closure_of_objects(spark, forest):
    rows, a, b = forest
    roots = lambda *x: spark.createDataFrame([(i,) for i in x], "oid string")
    every = levels.closure(rows, roots(a, b)).where("mode <> 16384")
    assert set(ids(every, "oid")) == {oid(k) for k in range(1, 8)}
    had = levels.closure(rows, roots(a))
    assert set(ids(levels.closure(rows, roots(b), had.select("oid")).where("mode <> 16384"), "oid")) == {oid(6), oid(7)}


@pytest.mark.parametrize("seed", range(5))
def test_compressed_bitmaps(seed):
    rng = np.random.default_rng(seed)
    make = lambda n: (rng.random(n) < rng.choice([0.001, 0.5, 0.999])) | (np.arange(n) // 500 % 3 == 0)
    x, y = make(int(rng.integers(0, 5000))), make(int(rng.integers(1, 5000)))
    a, b = bitmaps.compress(x), bitmaps.compress(y)
    assert np.array_equal(bitmaps.expand(a), x) and bitmaps.cardinality(b) == y.sum()
    n = max(len(x), len(y))
    p, q = np.append(x, np.zeros(n - len(x), bool)), np.append(y, np.zeros(n - len(y), bool))
    for how, want in (("or", p | q), ("and", p & q), ("and_not", p & ~q), ("xor", p ^ q)):
        assert np.array_equal(bitmaps.expand(bitmaps.combined(how, a, b)), want)
    types = rng.integers(1, 5, len(y))
    assert np.array_equal(bitmaps.expand(bitmaps.of_type(b, types, 2)), y & (types == 2))
    order = rng.permutation(len(y))
    moved = bitmaps.expand(bitmaps.remapped(b, order, len(y)))
    assert np.array_equal(moved[order], y) and bitmaps.remapped(b, np.full(len(y), -1), 9) is (None if y.any() else bitmaps.remapped(b, np.full(len(y), -1), 9))
    assert len(bitmaps.compress(np.zeros(100_000, bool))) < 40


def test_walks_that_start_from_stored_sets(spark):
    rows = random_graph(2, 60)
    edges = graph(spark, rows)
    positions = spark.createDataFrame([(k, 59 - k) for k in range(60)], "oid long, position long")
    stored = bitmaps.stored_sets(edges, positions, [20, 35])
    above = {}
    for c in sorted(rows):
        above[c] = {c}.union(*(above[p] for p in rows[c]))
    assert set(ids(bitmaps.reach_with(edges, positions, stored, [59, 40]), "oid")) == above[59] | above[40]


NOW = datetime(2024, 3, 31, 12, 0, 0, tzinfo=timezone.utc)


@pytest.mark.parametrize("text,want", [("2024-03-01", "2024-03-01T00:00:00"), ("now", "2024-03-31T12:00:00"), ("yesterday", "2024-03-30T00:00:00"), ("1 day ago", "2024-03-30T12:00:00"), ("2.weeks.3.days.ago", "2024-03-14T12:00:00"), ("1 month ago", "2024-02-29T12:00:00"), ("1 year ago", "2023-03-31T12:00:00"), ("Fri, 01 Mar 2024 10:00:00 +0200", "2024-03-01T08:00:00"), ("03/01/2024", "2024-03-01T00:00:00"), ("01.03.2024", "2024-03-01T00:00:00"), ("1709251200 +0000", "2024-03-01T00:00:00")])
def test_dates(text, want):
    assert datetime.fromtimestamp(dates.parse_date(text, NOW), timezone.utc).strftime("%Y-%m-%dT%H:%M:%S") == want


def test_odd_dates_and_numbers():
    assert dates.parse_date("never", NOW) == dates.NEVER
    for bad in ("", "soon", "x days ago", "3 fortnights ago", "2024-13-01"):
        with pytest.raises(ValueError):
            dates.parse_date(bad, NOW)
    assert dates.proposed([5, 5, 3, 9]) == [5, 6, 7, 9] and dates.decode85(dates.encode85(b"abc")) == b"abc"


def test_command_line(tmp_path, capsys):
    (tmp_path / "c").write_text('[remote "o.x"]\nurl = here\n')
    assert cli.main(["config", str(tmp_path / "c"), "remote.o.x.url"]) == 0 and capsys.readouterr().out == "here\n"
    (tmp_path / "i").write_bytes(staging.encode([staging.Entry(b"a", 0o100644, oid(1))]))
    cli.main(["ls-index", str(tmp_path / "i")])
    assert capsys.readouterr().out == f"100644 {oid(1)} 0\ta\n"
    cli.main(["list"])
    assert "tree_diff_by_level" in capsys.readouterr().out
    cli.main(["sql", "commit_scan"])
    assert "SELECT" in capsys.readouterr().out
