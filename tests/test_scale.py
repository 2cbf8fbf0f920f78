"""Steps whose share a task must not grow with the input: packs, closures by blocks, trees and staging indexes in parts."""

from __future__ import annotations

import random

import pytest

from annals.operators import levels, logs
from annals.plans.closure import carry, depths, generations
from annals.plans.shared import written
from annals.sources import packs, staging
from tests.test_formats import oid
from tests.test_history import graph, ids, random_graph


def test_packs_are_bounded_whatever_the_names(spark, tmp_path, monkeypatch):
    """Objects of one name are dealt to a pack for each PACK_BYTES, and packs are parsed one a task."""
    monkeypatch.setattr(packs, "PACK_BYTES", 20_000)
    r = random.Random(4)
    words = [bytes(r.choice(b"abcdefgh") for _ in range(9)) for _ in range(500)]
    contents = {packs.object_id("blob", b): b for b in (b" ".join(r.choices(words, k=100)) for _ in range(300))}
    rows = spark.createDataFrame([(o, "blob", bytearray(b), "one") for o, b in contents.items()], "oid string, type string, data binary, name string")
    made = packs.write_packs(rows, str(tmp_path)).collect()
    assert len(made) >= 12 and max(m.objects for m in made) <= 60 and sum(m.objects for m in made) == 300
    found = packs.parse_packs(spark, str(tmp_path))
    assert found.rdd.getNumPartitions() == len(made) and {x.oid for x in found.collect()} == set(contents)
    read = packs.objects(packs.indexes(spark, str(tmp_path)), str(tmp_path)).collect()
    assert {x.oid: bytes(x.data) for x in read} == contents and not any(x.problem for x in read)


def test_bases_are_those_of_trying_all():
    """The marked blocks leave out only bases that trying them would leave out."""
    r = random.Random(2)
    parts = [bytes(r.choice(b"abcdefgh") for _ in range(r.randint(5, 60))) for _ in range(40)]
    bases, near, made = packs.Bases(), [], 0
    for k in range(400):
        data, want = b"".join(r.choices(parts, k=r.randint(2, 12))), None
        for other, body, depth in reversed(near):
            if depth < packs.DEEPEST and len(body) < 8 * len(data):
                delta = packs.make_delta(body, data)
                if len(delta) < (len(want[1]) if want else len(data) // 2):
                    want = other, delta, depth + 1
        got = bases.best("blob", data, packs._marks(data))
        assert got == want and (got is None or packs.apply_delta(dict((o, b) for o, b, _ in near)[got[0]], got[1]) == data)
        bases.add(str(k), "blob", data, got[2] if got else 0)
        near = [*near, (str(k), data, got[2] if got else 0)][-packs.WINDOW :]
        made += got is not None
    assert 20 < made < 400


def test_a_tree_in_parts_is_the_tree(spark):
    """A folder of more than a row's bytes is dealt to many tasks, has the id of the whole object, and its entries are read once each."""
    rows = [(f"f{i:04d}", 33188, oid(i)) for i in range(500)] + [(f"d{i:03d}/x{k}", 33261, oid(i % 50)) for i in range(300) for k in range(3)] + [(f"big/{i}", 33188, oid(i)) for i in range(400)]
    made = [staging.trees_of(spark.createDataFrame(r, "path string, mode int, oid string").repartition(3), 1000) for r in (rows, rows[::-1] + [("more", 33188, oid(1))])]
    for got, extra in zip(made, ([], [("more", 33188, oid(1))])):
        found: dict = {}
        for r in sorted(got.collect(), key=lambda r: r.part):
            assert len(r.data) <= 1100
            found.setdefault((r.folder, r.oid), []).append(bytes(r.data))
        trees = {f: (o, b"".join(d)) for (f, o), d in found.items()}
        assert len(trees) == len(found) == 302 and all(staging.tree_id(d) == o for o, d in trees.values())
        assert trees["big"][1] == staging.tree_bytes([(str(i).encode(), 33188, oid(i)) for i in range(400)])
        top = [(p.encode(), m, o) for p, m, o in rows + extra if "/" not in p] + [(f.encode(), staging.FOLDER, o) for f, (o, _) in trees.items() if f]
        assert trees[""][1] == staging.tree_bytes(top)
    entries = levels.entries_of(made[0].unionByName(made[1]))
    roots = [m.where("folder = ''").first().oid for m in made]
    assert entries.count() == entries.dropDuplicates(["tree", "name"]).count()
    assert sorted(r.path for r in levels.walk(entries, roots[0]).collect()) == sorted(p for p, _, _ in rows)
    assert [r.path for r in levels.diff(entries, *roots).collect()] == ["more"]


@pytest.mark.parametrize("flipped", [False, True])
def test_closures_by_blocks_are_those_of_one_task(spark, flipped):
    """Several blocks, with edges to lower ids and to both sides; parts reached only through other blocks, a cycle for generations."""
    r = random.Random(6)
    pairs = [(c, p) for c in range(1, 200) for p in sorted(r.sample(range(max(0, c - 25), c), min(c, r.choice((1, 1, 2)))))]
    name = (lambda k: k * 89 % 200) if flipped else (lambda k: k)  # ids that don't follow the history
    edges = written(spark.createDataFrame([(name(c), name(p), 0) for c, p in pairs], "child long, parent long, nth int"), "edges")
    tips = spark.createDataFrame([(name(199), 1), (name(120), 2), (name(60), 4)], "oid long, value long")
    nodes = spark.range(210).withColumnRenamed("id", "oid")
    cyclic = edges.unionByName(spark.createDataFrame([(name(50), name(150), 0)], edges.schema)).unionByName(spark.createDataFrame([(name(150), name(50), 0)], edges.schema))
    for f in (
        lambda **how: carry(edges, tips, **how),
        lambda **how: depths(edges, [name(199), name(60)], **how),
        lambda **how: depths(edges, [name(199)], most=5, **how),
        lambda **how: generations(edges, nodes, **how),
        lambda **how: generations(cyclic, nodes, **how),
    ):
        assert sorted(map(tuple, f(small=0, block=100).collect())) == sorted(map(tuple, f(small=10**6).collect()))


def test_a_line_of_blocks_takes_a_round_a_block(spark):
    """A history of many levels is walked in few jobs where ids follow it."""
    chain = spark.range(1, 3000).selectExpr("id as child", "id - 1 as parent", "0 as nth")
    before = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    assert generations(chain, spark.range(3000).withColumnRenamed("id", "oid"), small=0, block=1000).agg({"value": "max"}).first()[0] == 3000
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) - before < 60


def test_names_by_blocks_are_those_of_the_heap(spark):
    rows = random_graph(3, 60)
    edges, refs = written(graph(spark, rows), "edges"), spark.createDataFrame([("main", 59), ("old", 30)], "name string, oid long")
    costs = lambda **how: ids(logs.name_rev(edges, refs, **how), "oid", "cost")
    assert costs(small=0, block=30) == costs(small=10**6)
    assert ids(logs.name_rev(edges, refs, small=0, block=30), "oid", "name") == ids(logs.name_rev(edges, refs, small=0), "oid", "name")


def test_staging_indexes_are_bounded(spark, tmp_path):
    rows = [(f"d{i % 7}/f{i:04d}", 33188, oid(i)) for i in range(1000)]
    made = staging.write(spark.createDataFrame(rows, "path string, mode int, oid string"), str(tmp_path), 2, most=100).collect()
    assert len(made) >= 10 and max(r.entries for r in made) <= 200
    assert sorted(map(tuple, staging.read(spark, str(tmp_path)).select("path", "mode", "oid").collect())) == sorted(rows)
