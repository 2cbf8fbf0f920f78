"""Logs, orders, names, renames, blame and merges against plain loops on small graphs."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from annals.operators import alignment, blame, logs, merging, renames
from annals.plans import closure, jump


def graph(spark, rows):
    """edges (child, parent, nth) of {commit: parents}."""
    return spark.createDataFrame([(c, p, k) for c, ps in rows.items() for k, p in enumerate(ps)], "child long, parent long, nth int")


def random_graph(seed, n=60):
    r = random.Random(seed)
    return {i: sorted(r.sample(range(max(0, i - 8), i), min(i, r.choice((1, 1, 1, 2, 3)))), reverse=r.random() < 0.5) if i else [] for i in range(n)}


def ids(df, *names):
    return sorted(tuple(r) if len(r) > 1 else r[0] for r in df.select(*names).collect())


# alignment


def test_both_algorithms_keep_common_lines_in_order():
    r = random.Random(4)
    for _ in range(1500):
        a, b = ([r.choice("abcdef") for _ in range(r.randrange(16))] for _ in range(2))
        best = len(alignment.matches(a, b, "shortest"))
        found = alignment.matches(a, b, "histogram")
        assert all(a[i] == b[j] for i, j in found) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(found, found[1:])) and len(found) <= best


def test_histogram_anchors_on_rare_lines():
    """A moved frame of frequent lines doesn't break up the one rare block."""
    a = ["{", "}", "{", "}", "rare one", "rare two", "{", "}"]
    b = ["{", "}", "rare one", "rare two", "{", "}", "{", "}", "{", "}"]
    assert {(4, 2), (5, 3)} <= set(alignment.histogram(a, b))
    often = ["x"] * 100
    assert len(alignment.histogram(["a", *often, "b"], ["c", *often, "d"])) == 100  # left to the other algorithm


@pytest.mark.parametrize("how,a,b,same", [("exact", "a b", "a  b", False), ("ignore_all", " a b", "ab", True), ("ignore_leading", "  a", "a", True), ("ignore_leading", "a ", "a", False), ("ignore_trailing", "a \t\n", "a", True), ("ignore_change", "a   b ", "a b", True), ("ignore_change", "ab", "a b", False)])
def test_comparisons_of_white_space(how, a, b, same):
    assert bool(alignment.matches([a], [b], comparison=how)) is same


def test_edits_and_heads():
    e = (2, 4, 5, 5)
    assert alignment.kind_of(e) == "DELETE" and alignment.swapped(e) == (5, 5, 2, 4) and alignment.shifted(e, 1) == (3, 5, 6, 6)
    assert alignment.before((0, 9, 0, 9), e) == (0, 2, 0, 5) and alignment.after((0, 9, 0, 9), e) == (4, 9, 5, 9)
    lines = ["class A:\n", "    def f(self):\n", "        x\n", "        y\n"]
    assert alignment.function_name(lines, 3, "python") == "    def f(self):" and alignment.function_name(lines, 1, "python") == "class A:" and alignment.function_name(lines, 0) == ""
    assert alignment.patch_head("a", "b", score=90).startswith("diff --git a/a b/b\nsimilarity index 90%\nrename from a\nrename to b\n--- a/a\n")
    assert alignment.patch_head(None, "n").endswith("new file mode 100644\n--- /dev/null\n+++ b/n\n")
    assert alignment.union([("ok", ["1"], [], []), ("conflict", ["a"], [], ["b"])]) == ["1", "a", "b"]
    assert alignment.similarity(b"a\r\nb\r\n", b"a\nb\n") == 100 and alignment.similarity(b"", b"") == 100 and alignment.similarity(b"x\n", b"y\n") == 0


# logs


def plain_path_log(rows, differs, start):
    """The rule restated: follow the first parent without a change if there is one, else all."""
    seen, todo, kept, up = set(), [start], set(), {}
    while todo:
        c = todo.pop()
        if c in seen:
            continue
        seen.add(c)
        same = [p for p in rows[c] if (c, p) not in differs]
        up[c] = same[:1] or rows[c]
        if not same:
            kept.add(c)
        todo += up[c]
    return kept, up


@pytest.mark.parametrize("seed", range(4))
def test_history_of_a_path(spark, seed):
    rows = random_graph(seed)
    r = random.Random(seed + 100)
    differs = {(c, p) for c, ps in rows.items() for p in ps if r.random() < 0.4}
    edges, changed = graph(spark, rows), spark.createDataFrame(sorted(differs), "child long, parent long")
    kept, up = plain_path_log(rows, differs, 59)
    assert set(ids(logs.path_log(edges, changed, [59]), "oid")) == kept

    def nearest(c):
        while c not in kept:
            c = up[c][0]
        return c

    want = sorted((c, k, nearest(p)) for c in kept for k, p in enumerate(rows[c]) if p in up[c])
    assert ids(logs.rewritten(edges, changed, [59]), "oid", "nth", "parent") == want


def test_history_over_a_rename(spark):
    edges = graph(spark, {5: [4], 4: [3], 3: [2], 2: [1], 1: []})
    changes = spark.createDataFrame([(5, 4, "new", None), (4, 3, "new", "old"), (2, 1, "old", None), (3, 2, "other", None)], "child long, parent long, path string, old_path string")
    assert ids(logs.follow(edges, changes, 5, "new"), "oid", "path") == [(1, "old"), (2, "old"), (4, "new"), (5, "new")]


def test_ends_of_long_chains(spark):
    rows = spark.range(1, 3000).selectExpr("id as node", "id - 1 as to")
    assert ids(jump.ends(rows).select("to").distinct(), "to") == [0] and jump.ends(rows).count() == 2999


def test_merge_bases_of_many_tips(spark):
    for seed in range(3):
        rows = random_graph(seed, 40)
        above = {}
        for c in sorted(rows):
            above[c] = {c}.union(*(above[p] for p in rows[c]))
        common = above[39] & above[37] & above[35]
        best = {c for c in common if not any(c in above[p] for o in common for p in rows[o])}
        assert set(ids(logs.merge_bases(graph(spark, rows), [39, 37, 35]), "oid")) == best


# orders and names


@pytest.mark.parametrize("how", ["date", "branch", "source"])
def test_orders_put_children_first(how):
    for seed in range(20):
        rows = random_graph(seed, 30)
        r = random.Random(seed)
        given = sorted(((c, r.randrange(100), ps) for c, ps in rows.items()), key=lambda x: (-x[1], x[0]))
        out = logs.ordered(given, how)
        place = {c: k for k, c in enumerate(out)}
        assert sorted(out) == sorted(rows) and all(place[c] < place[p] for c, ps in rows.items() for p in ps)


def test_ready_commits_go_newest_first_and_branches_stay_together():
    rows = [(4, 40, [3, 2]), (3, 30, [1]), (2, 35, [0]), (1, 20, []), (0, 10, [])]
    assert logs.ordered(rows, "date") == [4, 2, 3, 1, 0] and logs.ordered(rows, "branch") == [4, 2, 0, 3, 1]
    assert logs.ordered([(1, 9, []), (3, 5, [1]), (2, 4, [1])], "source") == [3, 2, 1]  # 1 waits for its last child


def test_order_beyond_one_task(spark):
    rows = random_graph(7, 50)
    commits = spark.createDataFrame([(c, c) for c in rows], "oid long, t long").select("oid", F.timestamp_seconds("t").alias("commit_time"))
    got = dict(ids(logs.in_order(commits, graph(spark, rows), most=10), "oid", "pos"))
    assert sorted(got.values()) == list(range(1, 51)) and all(got[c] < got[p] for c, ps in rows.items() for p in ps)


def test_names_by_heap_and_by_rounds(spark):
    rows = random_graph(3, 40)
    edges, refs = graph(spark, rows), [(39, "main"), (30, "old")]
    want = logs.name_all([(c, p, k) for c, ps in rows.items() for k, p in enumerate(ps)], refs)
    df = spark.createDataFrame([(n, o) for o, n in refs], "name string, oid long")
    for small in (10**6, 0):
        got = {o: (c, n) for o, c, n in ids(logs.name_rev(edges, df, small), "oid", "cost", "name")}
        assert {o: c for o, (c, _) in got.items()} == {o: c for o, (c, _) in want.items()}
        for o, (_, name) in got.items():  # the name leads there
            head, steps = logs.parse_revision(name)
            at = {"main": 39, "old": 30}[head]
            for s in steps:
                for _ in range(s.value if s.kind == "first" else 1):
                    at = rows[at][0 if s.kind == "first" else s.value - 1]
            assert at == o


@pytest.mark.parametrize("text,want", [("main", ("main", [])), ("v1~3^2", ("v1", [("first", 3), ("parent", 2)])), ("@", ("HEAD", [])), ("m@{2}^{tree}:a/b", ("m", [("log", 2), ("peel", "tree"), ("path", "a/b")])), ("@{-1}", ("HEAD", [("checkout", 1)])), (":/fix", ("", [("search", "fix")])), ("m^{/a b}^", ("m", [("search", "a b"), ("parent", 1)])), ("a@b", ("a@b", [])), ("m@{u}", ("m", [("upstream", None)]))])
def test_revisions_are_parsed(text, want):
    name, steps = logs.parse_revision(text)
    assert (name, [(s.kind, s.value) for s in steps]) == want


def test_revisions_are_evaluated(spark):
    rows = {1: [], 2: [1], 3: [1], 4: [2, 3], 5: [4]}
    commits = spark.createDataFrame([(i, f"commit {i}", i) for i in rows], "oid long, message string, commit_time long")
    refs = spark.createDataFrame([("refs/heads/main", 5), ("HEAD", 5), ("refs/tags/t", 90), ("refs/heads/side", 3)], "name string, oid long")
    log = spark.createDataFrame([("refs/heads/main", 1, 2, "x"), ("refs/heads/main", 2, 4, "x"), ("refs/heads/main", 3, 5, "x"), ("HEAD", 1, 3, "checkout: moving from side to main")], "ref string, update_index long, oid long, comment string")
    peeled, trees = spark.createDataFrame([(90, 4)], "oid long, to long"), spark.createDataFrame([(5, "a/b", "blob")], "oid long, path string, blob string")
    r = logs.Revisions(refs, graph(spark, rows), commits, log, peeled, trees)
    asked = ["main", "main~1^2", "main^0", "t^{}", "main@{1}", "@{-1}", "main:a/b", "main^{/commit [23]}", "main^3", "none", "main~9"]
    assert [r.resolve(x) for x in asked] == [5, 3, 5, 4, 4, 3, "blob", 3, None, None, None]
    assert ids(r.select("side..main"), "oid") == [2, 4, 5] and ids(r.select("main^1^1...side"), "oid") == [2, 3] and ids(r.select("^side"), "oid") == [2, 4, 5]


def test_lanes():
    assert logs.lanes([(4, [3, 2]), (3, [1]), (2, [1]), (1, [])]) == [(4, 0, []), (3, 0, [1]), (2, 1, [0]), (1, 0, [])]


# closures


def test_closures_of_a_long_chain_and_lone_commits(spark):
    n = 5000
    chain = spark.range(1, n).selectExpr("id as child", "id - 1 as parent", "0 as nth")
    lone = spark.range(n, n + 50).selectExpr("id as oid")
    everything = spark.range(0, n + 50).selectExpr("id as oid")
    assert closure.reach(chain, [n - 1]).count() == n
    found = closure.generations(chain, everything)
    assert found.count() == n + 50 and found.join(lone, "oid").agg(F.max("value")).first()[0] == 1 and found.agg(F.max("value")).first()[0] == n
    assert ids(closure.depths(chain, [n - 1], most=3), "value") == [0, 1, 2, 3]


def test_lines_are_contracted(spark):
    """Beyond one task: a line of 2,000 commits in a few rounds, and random graphs with flags, as in one task."""
    chain = spark.range(1, 2000).selectExpr("id as child", "id - 1 as parent", "0 as nth")
    assert closure.reach(chain, [1999], small=20).count() == 2000
    for seed in range(2):
        edges = graph(spark, random_graph(seed, 50) | {100 + k: [99 + k] for k in range(1, 40)} | {100: [49]})
        tips = spark.createDataFrame([(139, 1), (45, 2), (120, 4)], "oid long, value long")
        want = ids(closure.carry(edges, tips), "oid", "value")
        assert ids(closure.carry(edges, tips, small=5), "oid", "value") == want


# renames


def test_one_content_many_names():
    made = renames.best_names(["a/x.txt", "b/y.txt"], ["c/x.txt", "b/z.txt", "q/w.txt"])
    assert [(k, a, b) for k, a, b in made if k == "RENAME"] == [("RENAME", "b/y.txt", "b/z.txt"), ("RENAME", "a/x.txt", "c/x.txt")] and len(made) == 3 and made[2][0] == "COPY"
    assert renames.best_names([], ["a"]) == [] and len(renames.best_names(["a"], ["b", "c", "d"])) == 3


def test_contents_with_many_paths_have_all_their_copies(spark):
    gone = spark.createDataFrame([("x", f"o{i}") for i in range(4)] + [("y", "p")], "oid string, path string")
    made = spark.createDataFrame([("x", f"n{i}") for i in range(9)] + [("y", "q")], "oid string, path string")
    for group in (1000, 5):
        got = renames.exact(gone, made, group).collect()
        assert sorted(r.new_path for r in got) == sorted([f"n{i}" for i in range(9)] + ["q"])
        assert sum(r.kind == "RENAME" for r in got) == 5 and len({r.old_path for r in got if r.kind == "RENAME"}) == 5


@pytest.mark.parametrize("often", [1000, 1])
def test_similar_contents_are_those_of_all_pairs(spark, often):
    r = random.Random(9)
    pool = [f"line {i}\n" for i in range(30)]
    a = {f"a/{k}": "".join(r.choice(pool) for _ in range(12)) + f"own {k % 5}\n" * 6 for k in range(15)}
    b = {f"b/{k}": "".join(r.choice(pool) for _ in range(12)) + f"own {k % 5}\n" * 6 for k in range(15)}
    frame = lambda d: spark.createDataFrame([(p, bytearray(t.encode())) for p, t in d.items()], "path string, data binary")
    want = set()
    for p, x in a.items():
        for q, y in b.items():
            bx, by = alignment.blocks(x.encode()), alignment.blocks(y.encode())
            content = alignment.common_bytes(bx, by) * 10000 // max(len(x), len(y))
            score = (content * 99 + alignment.name_score(p, q) * 100) // 10000
            if content >= 4000 and score >= 40 and min(len(x), len(y)) * 100 >= 40 * max(len(x), len(y)):
                want.add((p, q, score))
    got = {tuple(x) for x in renames.similar(frame(a), frame(b), 40, often).collect()}
    assert got <= want and (often == 1 or got == want) and len(want) > 10
    left, greedy = sorted(want, key=lambda x: (-x[2], x[0], x[1])), []
    for p, q, s in left:
        if all(p != x[0] and q != x[1] for x in greedy):
            greedy.append((p, q, s))
    frame = spark.createDataFrame(sorted(want), "old_path string, new_path string, score int")
    assert ids(renames.matched(frame), "old_path", "new_path", "score") == sorted(greedy)


def test_detection_breaking_and_rejoining(spark):
    text = lambda k: "".join(f"{k} line {i}\n" for i in range(20))
    side = lambda rows: spark.createDataFrame([(p, o, bytearray(t.encode())) for p, o, t in rows], "path string, oid string, data binary")
    found = renames.detect(side([("a", "1", text("x")), ("b", "2", text("y")), ("z", "9", "lone\n")]), side([("c", "1", text("x")), ("d", "3", text("y") + "more\n"), ("e", "1", text("x"))]))
    assert ids(found, "kind", "old_path", "new_path") == [("COPY", "a", "e"), ("RENAME", "a", "c"), ("RENAME", "b", "d")]
    assert ids(renames.restricted(found, ["d"]), "new_path") == ["d"]
    pairs = spark.createDataFrame([("m", bytearray(text("p").encode()), bytearray(text("q").encode())), ("k", bytearray(b"same\n" * 9), bytearray(b"same\n" * 9 + b"x\n"))], "path string, old binary, new binary")
    gone, made = renames.broken(pairs)
    assert ids(gone, "path") == ["m"] == ids(made, "path")
    assert ids(renames.rejoined(found, gone), "path") == ["m"]


# blame


def test_blame_over_merges_and_caches():
    versions = {1: ["a", "b", "c"], 2: ["a", "B", "c"], 3: ["a", "b", "c", "d"], 4: ["a", "B", "c", "d", "e"]}
    parents, when = {1: [], 2: [1], 3: [1], 4: [2, 3]}, {k: k for k in range(5)}
    want = [(0, 1, 0), (1, 2, 1), (2, 1, 2), (3, 3, 3), (4, 4, 4)]
    assert blame.blame(4, versions, parents, when) == want
    known = {2: [(1, 0), (2, 1), (1, 2)]}
    assert blame.blame(4, versions, parents, when, known=known.get) == want
    assert blame.reverse_blame(1, [4], versions, parents, when) == [(0, 4, 0), (1, 3, 1), (2, 4, 2)]
    assert blame.blame(1, {1: []}, {}, {1: 1}) == []
    assert blame.joined([(2, 5, 1), (0, 3, 2), (4, 9, 1)]) == [(0, 3, 3), (4, 9, 1)]


def test_blame_explains_every_line_of_random_histories():
    r = random.Random(5)
    for seed in range(30):
        rows = random_graph(seed, 15)
        versions = {}
        for c in sorted(rows):
            lines = list(versions[rows[c][0]]) if rows[c] else ["start"]
            for _ in range(r.randrange(3)):
                lines.insert(r.randrange(len(lines) + 1), f"{c}.{r.random()}")
            if lines and r.random() < 0.3:
                lines.pop(r.randrange(len(lines)))
            versions[c] = lines
        for at, commit, source in blame.blame(14, versions, rows, {c: c for c in rows}):
            line = versions[14][at]
            assert versions[commit][source] == line and not any(line in versions[p] for p in rows[commit])


# merges


def tree(spark, files):
    rows = spark.createDataFrame([(p, m, bytearray(t.encode())) for p, (m, t) in files.items()], "path string, mode int, data binary")
    return rows.withColumn("oid", F.md5("data")).select("path", "mode", "oid", "data")


def shown(df):
    return {r.path: (r.mode, bytes(r.data).decode(), r.state) for r in df.collect()}


def test_merges_of_trees(spark):
    body = "".join(f"{i}\n" for i in range(10))
    base = tree(spark, {"same": (1, "x"), "both": (1, body), "gone": (1, "x"), "ours gone": (1, "x"), "mode": (1, "x"), "clash": (1, "a\n"), "bin": (1, "a\0")})
    ours = tree(spark, {"same": (1, "x"), "both": (1, body.replace("1\n", "one\n")), "mode": (2, "x"), "clash": (1, "b\n"), "new": (1, "n"), "gone": (1, "x"), "bin": (1, "b\0")})
    theirs = tree(spark, {"same": (1, "y"), "both": (1, body.replace("8\n", "eight\n")), "ours gone": (1, "z"), "mode": (1, "x"), "clash": (1, "c\n"), "bin": (1, "c\0")})
    got = shown(merging.merge(base, ours, theirs))
    assert got["same"] == (1, "y", "taken") and got["new"] == (1, "n", "kept") and "gone" not in got and got["ours gone"] == (1, "z", "modify/delete")
    assert got["both"] == (1, body.replace("1\n", "one\n").replace("8\n", "eight\n"), "merged") and got["mode"] == (2, "x", "kept") and got["bin"][2] == "conflict"
    assert got["clash"] == (1, "<<<<<<< OURS\nb\n=======\nc\n>>>>>>> THEIRS\n", "conflict")
    assert shown(merging.STRATEGIES["favour theirs"](base, ours, theirs))["clash"] == (1, "c\n", "merged")
    assert shown(merging.STRATEGIES["union"](base, ours, theirs))["clash"] == (1, "b\nc\n", "merged")
    assert shown(merging.STRATEGIES["in core"](base, ours, theirs))["both"][2] == "conflict"
    assert set(shown(merging.STRATEGIES["theirs"](base, ours, theirs))) == {"same", "both", "ours gone", "mode", "clash", "bin"}
    assert merging.merged_mode(1, 2, 3) is None and merging.merged_mode(1, 1, 3) == 3


def test_merge_of_a_criss_cross_history(spark):
    """Two merge bases: 2 and 3; with one of them alone as base the other's line would conflict."""
    edges = graph(spark, {1: [], 2: [1], 3: [1], 4: [2, 3], 5: [3, 2]})
    text = lambda *hit: {"f": (1, "".join(f"{'new ' if i in hit else ''}{i}\n" for i in range(12)))}
    trees = {1: text(), 2: text(1), 3: text(10), 4: text(1, 10, 4), 5: text(1, 10, 7)}
    got = shown(merging.recursive(edges, lambda c: tree(spark, trees[c]), 4, 5))
    assert got["f"] == (1, text(1, 4, 7, 10)["f"][1], "merged")
    assert [merging.decide(edges, a, b) for a, b in ((4, 4), (4, 2), (2, 4), (4, 5))] == ["up to date", "up to date", "fast-forward", "merge"]


def test_picking_rebasing_and_stashes(spark):
    text = lambda *hit: {"f": (1, "".join(f"{'new ' if i in hit else ''}{i}\n" for i in range(12)))}
    at = lambda *hit: tree(spark, text(*hit))
    assert shown(merging.cherry_pick(at(1), at(1, 5), at(9)))["f"][1] == text(5, 9)["f"][1]
    assert shown(merging.revert(at(1), at(1, 5), at(1, 5, 9)))["f"][1] == text(1, 9)["f"][1]
    made, done = merging.rebase([("pick", at(), at(2)), ("drop", at(2), at(2, 3)), ("pick", at(2), at(2, 6))], at(10))
    assert done == [0, 2] and bytes(made.first().data).decode() == text(2, 6, 10)["f"][1]
    other = tree(spark, {"f": (1, text()["f"][1].replace("2\n", "else\n", 1))})
    made, done = merging.rebase([("pick", at(), at(2)), ("pick", at(2), at(2, 6))], other)
    assert done == []  # stops at the conflict
    assert shown(merging.stash_apply(at(), at(3), at(8)))["f"][1] == text(3, 8)["f"][1]
