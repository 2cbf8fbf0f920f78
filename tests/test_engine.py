"""Closures by both ways, alignment by brute force and known answers, streams against their batch twins."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from annals.functions.globs import glob_regex
from annals.operators import alignment
from annals.plans.closure import carry, depths, generations, reach
from annals.streaming import feeds
from annals.session import table


@pytest.fixture(scope="module")
def graph(spark):
    rng = random.Random(3)
    rows = [(c, p) for c in range(1, 60) for p in sorted(rng.sample(range(max(0, c - 9), c), min(c, rng.choice((1, 1, 2)))))]
    return rows, spark.createDataFrame(rows, "child long, parent long").withColumn("nth", F.lit(0))


def test_both_ways_of_a_closure_agree(spark, graph):
    rows, edges = graph
    start = spark.createDataFrame([(59, 1), (40, 2), (7, 4)], "oid long, value long")
    nodes = spark.range(60).withColumnRenamed("id", "oid")
    for f in (lambda small: carry(edges, start, small), lambda small: depths(edges, [59, 33], small), lambda small: generations(edges, nodes, small)):
        assert sorted(map(tuple, f(10**6).collect())) == sorted(map(tuple, f(0).collect()))
    seen, front = {59}, [59]
    while front:
        front = [p for c, p in rows if c in front and p not in seen]
        seen |= set(front)
    assert {r.oid for r in reach(edges, [59]).collect()} == seen


def test_closure_of_nothing(spark, graph):
    _, edges = graph
    assert {r.oid for r in reach(edges.limit(0), [5]).collect()} == {5}


def longest(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_alignment_is_a_longest_common_subsequence():
    rng = random.Random(1)
    for _ in range(2000):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 12))) for _ in range(2))
        found = alignment.matches(list(a), list(b), "shortest")
        assert all(a[i] == b[j] for i, j in found) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(found, found[1:]))
        assert len(found) == longest(a, b), (a, b)


def test_patches_apply():
    rng = random.Random(2)
    for _ in range(1000):
        a, b = ([rng.choice("abcd") + "\n" for _ in range(rng.randint(0, 30))] for _ in range(2))
        if a and rng.random() < 0.3:
            a[-1] = a[-1].rstrip()
        assert alignment.apply(a, alignment.unified(a, b)) == b
    with pytest.raises(ValueError):
        alignment.apply(["x\n"], alignment.unified(["a\n"], ["b\n"]))


@pytest.mark.parametrize(
    "base,ours,theirs,plain,diff3",
    [
        ("abcdefghij", "abZdefghij", "Ybcdefghij", "YbZdefghij", "YbZdefghij"),
        ("abcdefghij", "aZZZefghij", "aZcZefghij", "aZ<Z=c>Zefghij", None),
        ("abcdefghij", "abcdefghij", "aZcZefghij", "aZcZefghij", "aZcZefghij"),
        ("abc", "abc", "abc", "abc", "abc"),
        ("", "a", "a", "a", "a"),
    ],
)
def test_line_merges(base, ours, theirs, plain, diff3):
    found = alignment.merge3(list(base), list(ours), list(theirs))
    assert "".join(alignment.shown(found)) == plain
    if diff3:
        assert "".join(alignment.shown(found, diff3=True)) == diff3


def test_similarity():
    same = b"A\nB\nD\nB\n"
    assert alignment.similarity(same, same) == 100 and alignment.similarity(b"", b"") == 100
    assert alignment.similarity(b"A\nB\nC\nD\n", b"A\nB\nC\nX\n") == 75


def test_globs():
    import re

    for glob, path, want in (("*.c", "a.c", True), ("*.c", "d/a.c", False), ("**/a", "x/y/a", True), ("**/a", "a", True), ("a/**", "a/b/c", True), ("[!a]?", "bc", True), ("[!a]?", "ac", False), ("a.b", "axb", False)):
        assert bool(re.search(glob_regex(glob), path)) == want, (glob, path)


@pytest.mark.parametrize("f", [feeds.tumbling, feeds.sliding, feeds.sessions, feeds.deduplicated])
def test_streams_give_their_batch_results(spark, tiny, tmp_path, f):
    table(spark, tiny, "events").coalesce(1).write.parquet(f"{tmp_path}/in")
    batch = feeds.as_times(table(spark, tiny, "events"))
    stream = feeds.as_times(spark.readStream.schema(table(spark, tiny, "events").schema).parquet(f"{tmp_path}/in"))
    name = f"s_{f.__name__}"
    mode = "append" if f is feeds.deduplicated else "complete" if f is not feeds.sessions else "complete"
    run = f(stream).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert sorted(map(tuple, spark.table(name).collect())) == sorted(map(tuple, f(batch).collect()))


def test_entry_without_the_llm_folder(spark):
    """The entry module imports and its queries exist though the subpackage and the pipeline are gone."""
    import subprocess
    import sys

    code = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name == "corpus_pipeline" or name.startswith("annals.llm"):
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert "difference" in e.queries() and "pipeline" not in e.queries()
assert set(e.oracle_sql()) <= set(e.queries())
"""
    root = __file__.rsplit("/tests/", 1)[0]
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)
