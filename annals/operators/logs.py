"""Histories of a path, orders of commits, names and descriptions of commits, revision expressions, merge bases of many tips, shallow copies."""

from __future__ import annotations

import heapq
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annals.plans.blocks import BLOCK, NEWS, STATE, Blocks
from annals.plans.closure import SMALL, carry, depths, generations, reach
from annals.plans.history import commits, edges, tags, tips
from annals.plans.jump import ends
from annals.plans.shared import written
from annals.registry import query

# histories of a path


def followed(edges: DataFrame, changed: DataFrame) -> DataFrame:
    """The edges (child, parent, nth, same) a history of a path follows: where some parent has the path unchanged only the first such, else all.

    changed: (child, parent) of edges along which the path differs.
    """
    marked = edges.join(changed.select("child", "parent", F.lit(True).alias("differs")).distinct(), ["child", "parent"], "left").withColumn("same", F.col("differs").isNull())
    pick = marked.groupBy("child").agg(F.min(F.when(F.col("same"), F.col("nth"))).alias("pick"))
    return marked.join(pick, "child").where("pick is null or nth = pick").select("child", "parent", "nth", "same")


def path_log(edges: DataFrame, changed: DataFrame, start: list[int], without: DataFrame | None = None) -> DataFrame:
    """(oid) of the commits that changed a path: reached over followed edges and different from all parents; roots count, unless without (oid) says that they lack the path."""
    steps = written(followed(edges, changed), "followed")
    kept = reach(steps, start).join(steps.where("same").select(F.col("child").alias("oid")), "oid", "left_anti")
    if without is not None:
        roots = without.join(edges.select(F.col("child").alias("oid")), "oid", "left_anti")
        kept = kept.join(roots, "oid", "left_anti")
    return kept


def rewritten(edges: DataFrame, changed: DataFrame, start: list[int]) -> DataFrame:
    """(oid, nth, parent) of that history with each parent replaced by the nearest kept commit; parents without one are left out.

    A commit that is left out has one followed edge, so its nearest kept ancestor is the end of a chain.
    """
    steps = written(followed(edges, changed), "followed")
    seen = written(reach(steps, start), "seen")
    dropped = steps.where("same").join(seen.select(F.col("oid").alias("child")), "child")
    end = ends(dropped.select(F.col("child").alias("node"), F.col("parent").alias("to")))
    kept = seen.join(dropped.select(F.col("child").alias("oid")), "oid", "left_anti")
    out = steps.join(kept.select(F.col("oid").alias("child")), "child").join(end.select(F.col("node").alias("parent"), F.col("to").alias("far")), "parent", "left")
    out = out.select(F.col("child").alias("oid"), "nth", F.coalesce("far", "parent").alias("parent"))
    return out.join(kept.select(F.col("oid").alias("parent")), "parent", "left_semi").select("oid", "nth", "parent")


def follow(edges: DataFrame, changes: DataFrame, start: int, path: str) -> DataFrame:
    """(oid, path): the history of a path over renames. changes: (child, parent, path, old_path) of edges along which a path differs; old_path where it was renamed from another.

    One closure for each name the path has had: a segment ends where a rename brought the path in, and goes on from there with the old name.
    """
    out, starts, seen = None, [start], set()
    while starts and path not in seen:
        seen.add(path)
        mine = written(changes.where(F.col("path") == path), "changes")
        origin = mine.where("old_path is not null")
        cut = edges.join(origin.select("child").distinct(), "child", "left_anti")
        part = written(path_log(cut, mine, starts).withColumn("path", F.lit(path)), "segment")
        out = part if out is None else out.unionByName(part)
        hit = origin.join(part.select(F.col("oid").alias("child")), "child").select("child", "parent", "old_path").orderBy(F.desc("child")).limit(1).collect()
        starts = [r.parent for r in hit]
        path = hit[0].old_path if hit else path
    # roots of a segment that lack the path don't count: they have no change of it
    return out


def _changed(spark, sf_dir):
    """Edges along which a commit's message, taken as the content of one path, differs."""
    c = commits(spark, sf_dir)
    both = edges(spark, sf_dir).join(c.select(F.col("oid").alias("child"), F.col("message").alias("x")), "child").join(c.select(F.col("oid").alias("parent"), F.col("message").alias("y")), "parent")
    return both.where("x <> y").select("child", "parent")


_SAME = """e AS (SELECT child, parent, nth, c.message = p.message AS same FROM edges JOIN commits c ON child = c.oid JOIN commits p ON parent = p.oid), f AS (SELECT child, min(nth) FILTER (WHERE same) AS pick FROM e GROUP BY child),
pe AS (SELECT e.child, e.parent, e.nth FROM e JOIN f USING (child) WHERE pick IS NULL OR nth = pick), w(oid) AS (SELECT a FROM tip UNION SELECT parent FROM w JOIN pe ON child = w.oid), kept AS (SELECT oid FROM w WHERE oid NOT IN (SELECT child FROM f WHERE pick IS NOT NULL))"""


@query(_SAME + " SELECT oid FROM kept")
def treesame_log(spark, sf_dir):
    return path_log(edges(spark, sf_dir), _changed(spark, sf_dir), [tips(spark, sf_dir)[0]])


@query(_SAME + """, j(oid, nth, stop) AS (SELECT child, nth, parent FROM pe WHERE child IN (SELECT oid FROM kept) UNION SELECT j.oid, j.nth, parent FROM j JOIN pe ON child = stop WHERE stop NOT IN (SELECT oid FROM kept))
SELECT oid, nth, stop AS parent FROM j WHERE stop IN (SELECT oid FROM kept)""")
def treesame_parents(spark, sf_dir):
    return rewritten(edges(spark, sf_dir), _changed(spark, sf_dir), [tips(spark, sf_dir)[0]])


# many tips, shallow copies


def merge_bases(edges: DataFrame, starts: list[int]) -> DataFrame:
    """(oid) of the best common ancestors of any number of tips (62 at most at once): common to all, and reached by no other such."""
    spark = edges.sparkSession
    full = (1 << len(set(starts))) - 1
    flags = [(int(s), 1 << k) for k, s in enumerate(sorted(set(starts)))]
    common = written(carry(edges, spark.createDataFrame(flags, "oid long, value long")).where(F.col("value") == full).select("oid"), "common")
    below = edges.join(common, F.col("child") == F.col("oid"), "left_semi").select(F.col("parent").alias("oid"))
    return common.join(below, "oid", "left_anti")


@query("""rc(oid) AS (SELECT b - b % 17 FROM tip UNION SELECT parent FROM rc JOIN edges ON child = rc.oid), common AS (SELECT oid FROM ra INTERSECT SELECT oid FROM rb INTERSECT SELECT oid FROM rc)
SELECT oid FROM common WHERE oid NOT IN (SELECT parent FROM edges WHERE child IN (SELECT oid FROM common))""")
def merge_base_of_three(spark, sf_dir):
    a, b = tips(spark, sf_dir)
    return merge_bases(edges(spark, sf_dir), [a, b, b - b % 17])


def assumed_shallow(edges: DataFrame, cut: DataFrame) -> DataFrame:
    """The edges with the commits of cut (oid) taken as roots."""
    return edges.join(cut.select(F.col("oid").alias("child")), "child", "left_anti")


@query("w(oid) AS (SELECT a FROM tip UNION SELECT parent FROM w JOIN edges ON child = w.oid WHERE child % 50 <> 0) SELECT oid FROM w")
def shallow_roots(spark, sf_dir):
    cut = commits(spark, sf_dir).where("oid % 50 = 0").select("oid")
    return reach(assumed_shallow(edges(spark, sf_dir), cut), [tips(spark, sf_dir)[0]])


def shallow(edges: DataFrame, commits: DataFrame, starts: list[int], depth: int | None = None, since=None, without: list[int] = ()) -> DataFrame:
    """(oid, depth, is_shallow) of a copy: so many levels, no commits before a time or in the history of without; is_shallow: some parent is missing.

    Levels beyond the limit aren't walked.
    """
    if since is not None:
        young = commits.where(F.col("commit_time") >= since).select("oid")
        edges_in = edges.join(young.select(F.col("oid").alias("parent")), "parent", "left_semi")
    else:
        edges_in = edges
    if without:
        gone = written(reach(edges, list(without)), "without")
        edges_in = edges_in.join(gone.select(F.col("oid").alias("parent")), "parent", "left_anti")
    found = written(depths(edges_in, starts, most=None if depth is None else depth - 1), "shallow")
    missing = edges.join(found.select(F.col("oid").alias("child")), "child").join(found.select(F.col("oid").alias("parent")), "parent", "left_anti").select(F.col("child").alias("oid"), F.lit(True).alias("cut")).distinct()
    return found.join(missing, "oid", "left").select("oid", F.col("value").alias("depth"), F.coalesce("cut", F.lit(False)).alias("is_shallow"))


@query("""d(oid, depth) AS (SELECT a, 0 FROM tip UNION SELECT parent, depth + 1 FROM d JOIN edges ON child = d.oid WHERE depth < 11 AND parent NOT IN (SELECT oid FROM rb)),
m AS (SELECT oid, CAST(min(depth) AS BIGINT) AS depth FROM d GROUP BY oid) SELECT oid, depth, EXISTS (SELECT 1 FROM edges WHERE child = m.oid AND parent NOT IN (SELECT oid FROM m)) AS is_shallow FROM m""")
def shallow_copy(spark, sf_dir):
    """Twelve levels without another tip's history."""
    a, b = tips(spark, sf_dir)
    return shallow(edges(spark, sf_dir), commits(spark, sf_dir), [a], 12, None, [b])


# orders


def ordered(rows: list[tuple[int, int, list[int]]], how: str = "date") -> list[int]:
    """Commits (oid, seconds, parents in order) so that children come first.

    date: of those ready the newest; branch: the one made ready last, so that lines stay together; source: in the given order, one with missing
    children right behind its last child.
    """
    parents = {o: [p for p in ps] for o, _, ps in rows}
    when = {o: t for o, t, _ in rows}
    waiting = dict.fromkeys(parents, 0)
    for ps in parents.values():
        for p in ps:
            if p in waiting:
                waiting[p] += 1
    out: list[int] = []
    if how == "date":
        heap = [(-when[o], k, o) for k, (o, _, _) in enumerate(rows) if not waiting[o]]
        heapq.heapify(heap)
        n = len(rows)
        while heap:
            _, _, o = heapq.heappop(heap)
            out.append(o)
            for p in parents[o]:
                if p in waiting:
                    waiting[p] -= 1
                    if not waiting[p]:
                        n += 1
                        heapq.heappush(heap, (-when[p], n, p))
        return out
    if how == "branch":
        stack = sorted((o for o in parents if not waiting[o]), key=lambda o: when[o])
        while stack:
            o = stack.pop()
            out.append(o)
            for p in parents[o]:
                if p in waiting:
                    waiting[p] -= 1
                    if not waiting[p]:
                        stack.append(p)
        return out
    late: set[int] = set()
    for o, _, _ in rows:
        todo = [o]
        while todo:
            x = todo.pop()
            if waiting[x]:
                late.add(x)
                continue
            out.append(x)
            for p in parents[x]:
                if p in waiting:
                    waiting[p] -= 1
                    if not waiting[p] and p in late:
                        late.discard(p)
                        todo.append(p)
    return out


def in_order(commits: DataFrame, edges: DataFrame, how: str = "date", reverse: bool = False, most: int = 5_000_000) -> DataFrame:
    """(oid, pos) of commits (oid, commit_time) in an order of ``ordered``.

    The order depends on all that came before, so up to ``most`` commits (counted) go to one task as numbers. Beyond, commits are
    sorted by generation and time, which is an order with children first, too, by a distributed sort.
    """
    inside = edges.join(commits.select(F.col("oid").alias("child")), "child", "left_semi")
    if commits.count() <= most and inside.count() <= most:
        up = inside.groupBy(F.col("child").alias("oid")).agg(F.transform(F.sort_array(F.collect_list(F.struct("nth", "parent"))), lambda x: x["parent"]).alias("parents"))
        rows = commits.select("oid", F.unix_micros(F.col("commit_time").cast("timestamp")).alias("t")).join(up, "oid", "left").repartition(1).sortWithinPartitions(F.desc("t"), F.desc("oid"))

        def run(it):
            got = [r for batch in it for r in zip(*(batch.column(c).to_pylist() for c in ("oid", "t", "parents")))]
            order = ordered([(o, t, ps or []) for o, t, ps in got], how)
            yield pa.RecordBatch.from_arrays([pa.array(order[::-1] if reverse else order, pa.int64()), pa.array(range(1, len(order) + 1), pa.int64())], names=["oid", "pos"])

        return rows.mapInArrow(run, "oid long, pos long")
    level = commits.join(generations(edges, commits), "oid").select("oid", F.struct((-F.col("value")).alias("g"), (-F.unix_micros(F.col("commit_time").cast("timestamp"))).alias("t"), (-F.col("oid")).alias("o")).alias("key"))
    return numbered(level, reverse)


def numbered(rows: DataFrame, reverse: bool = False) -> DataFrame:
    """(oid, pos) by key: sorted by ranges, numbered within each, and counted on from the ranges before."""
    key = F.desc("key") if reverse else F.asc("key")
    parts = written(rows.repartitionByRange(key).sortWithinPartitions(key).select("oid", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")), "sorted")
    sizes = parts.groupBy("part").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    from pyspark.sql import Window

    base = sizes.select("part", "first", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    return parts.join(F.broadcast(base), "part").select("oid", (F.col("base") + F.col("at") - F.col("first") + 1).alias("pos"))


def _topological(how, reverse=False):
    def made(spark, sf_dir):
        e = edges(spark, sf_dir)
        mine = commits(spark, sf_dir).join(reach(e, [tips(spark, sf_dir)[0]]), "oid", "left_semi")
        got = written(in_order(mine, e, how, reverse), "order")
        place = lambda side: got.select(F.col("oid").alias(side), F.col("pos").alias(f"{side}_pos"))
        wrong = F.col("child_pos") < F.col("parent_pos") if reverse else F.col("child_pos") > F.col("parent_pos")
        bad = e.join(place("child"), "child").join(place("parent"), "parent").where(wrong)
        return got.agg(F.count_distinct("oid").alias("commits"), F.max("pos").alias("last")).join(bad.agg(F.count("*").alias("wrong")), F.lit(True))

    return made


_ORDER = "SELECT count(*) AS commits, count(*) AS last, CAST(0 AS BIGINT) AS wrong FROM ra"
topo_by_date = query(_ORDER, "topo_by_date")(_topological("date"))
topo_by_branch = query(_ORDER, "topo_by_branch")(_topological("branch"))
topo_by_source = query(_ORDER, "topo_by_source")(_topological("source"))
topo_reversed = query(_ORDER, "topo_reversed")(_topological("date", True))


# names


def name_all(edges: list[tuple[int, int, int]], refs: list[tuple[int, str]]) -> dict[int, tuple[int, str]]:
    """oid -> (cost, name like ``main~3^2~1``): the cheapest way from a ref, a first parent costs 1, others 65535; ties by ref order."""
    down: dict[int, list[tuple[int, int]]] = {}
    for c, p, nth in edges:
        down.setdefault(c, []).append((nth, p))
    heap = [(0, k, oid, name, 0) for k, (oid, name) in enumerate(refs)]
    heapq.heapify(heap)
    out: dict[int, tuple[int, str]] = {}
    while heap:
        cost, k, oid, base, steps = heapq.heappop(heap)
        if oid in out:
            continue
        name = base if not steps else f"{base}~{steps}"
        out[oid] = cost, name
        for nth, p in sorted(down.get(oid, ())):
            if p not in out:
                heapq.heappush(heap, (cost + 1, k, p, base, steps + 1) if nth == 0 else (cost + 65535, k, p, f"{name}^{nth + 1}", 0))
    return out


def _named(part):
    """A block's cheapest names from what it had and what came in: (cost, rank, base, steps) of each vertex, and the names it gives beyond."""
    best: dict[int, tuple[int, str, str, int]] = {}
    rows = lambda kind: zip(part.of(kind)[0].tolist(), *(part.rows[kind].column(c).to_pylist() for c in ("v", "r", "s", "w")))
    for k, *found in rows(STATE):
        best[k] = tuple(found)
    heap = [(tuple(found), k) for k, *found in rows(NEWS) if k not in best or tuple(found) < best[k]]
    heapq.heapify(heap)
    better = set()
    starts, inner, nths = part.starts.tolist(), part.to.tolist(), part.value.tolist()
    while heap:
        found, k = heapq.heappop(heap)
        if k in best and best[k] <= found:
            continue
        best[k] = found
        better.add(k)
        for e in range(starts[k], starts[k + 1]):
            p, to = inner[e], _named_parent(found, nths[e])
            if p not in best or to < best[p]:
                heapq.heappush(heap, (to, p))
    news: dict[int, tuple[int, str, str, int]] = {}
    source, to, nth = part.out
    mine = np.isin(source, np.fromiter(better, np.int64, len(better)))
    for k, p, n in zip(source[mine].tolist(), to[mine].tolist(), nth[mine].tolist()):
        found = _named_parent(best[k], n)
        if p not in news or found < news[p]:
            news[p] = found
    columns = lambda ids, found: {"a": ids, **{c: [f[i] for f in found] for i, c in enumerate(("v", "r", "s", "w"))}}
    return columns(part.ids[list(best)] if best else [], list(best.values())), columns(list(news), list(news.values()))


def _named_parent(found: tuple[int, str, str, int], nth: int) -> tuple[int, str, str, int]:
    cost, rank, base, steps = found
    if not nth:
        return cost + 1, rank, base, steps + 1
    return cost + 65535, rank, f"{base}~{steps}^{nth + 1}" if steps else f"{base}^{nth + 1}", 0


def name_rev(edges: DataFrame, refs: DataFrame, small: int = SMALL, block: int = BLOCK) -> DataFrame:
    """(oid, cost, name) of all commits that refs (name, oid) reach.

    Up to ``small`` edges and refs (counted) one task finds cheapest ways by a heap. Beyond, blocks of edges do so, a task each, and only
    commits whose name improved pass it on.
    """
    if max(edges.count(), refs.count()) <= small:
        rows = edges.select("child", "parent", F.col("nth").cast("long"), F.lit(None).cast("string").alias("name"))
        rows = rows.unionByName(refs.select(F.col("oid").alias("child"), F.lit(None).cast("long").alias("parent"), F.lit(None).cast("long").alias("nth"), "name"))

        def run(it):
            got = [r for batch in it for r in zip(*(batch.column(c).to_pylist() for c in ("child", "parent", "nth", "name")))]
            named = name_all([r[:3] for r in got if r[3] is None], sorted(((r[0], r[3]) for r in got if r[3] is not None), key=lambda r: r[1]))
            yield pa.RecordBatch.from_arrays([pa.array(list(named), pa.int64()), pa.array([c for c, _ in named.values()], pa.int64()), pa.array([n for _, n in named.values()], pa.string())], names=["oid", "cost", "name"])

        return rows.repartition(1).mapInArrow(run, "oid long, cost long, name string")
    blocks = Blocks(edges.select(F.col("child").cast("long").alias("a"), F.col("parent").cast("long").alias("b"), F.col("nth").cast("long").alias("v")), block)
    found = blocks.run(refs.select(F.col("oid").cast("long").alias("a"), F.lit(0).alias("v"), F.lit(0).alias("w"), F.col("name").alias("s"), F.col("name").alias("r")), _named)
    return found.select(F.col("a").alias("oid"), F.col("v").alias("cost"), F.when(F.col("w") == 0, F.col("s")).otherwise(F.concat("s", F.lit("~"), F.col("w").cast("string"))).alias("name"))


@query("""c AS (SELECT oid, name FROM (SELECT max(oid) - 40 AS low FROM commits), refs WHERE name LIKE 'refs/heads/%' AND refs.oid >= low), n(oid, cost) AS (SELECT oid, 0 FROM c UNION SELECT parent, cost + CASE WHEN nth = 0 THEN 1 ELSE 65535 END FROM n JOIN edges ON child = n.oid WHERE cost < 131070)
SELECT oid, CAST(min(cost) AS BIGINT) AS cost FROM n GROUP BY oid HAVING min(cost) < 131070""")
def name_rev_costs(spark, sf_dir):
    """The costs of the cheapest names that refs of the newest commits give, up to one step to a second parent on the way."""
    e, last = edges(spark, sf_dir), tips(spark, sf_dir)[0]
    from annals.plans.history import refs

    heads = refs(spark, sf_dir).where((F.col("oid") >= last - 40) & F.startswith("name", F.lit("refs/heads/")))
    return name_rev(e, heads).where("cost < 131070").select("oid", "cost")


def describe(edges: DataFrame, commits: DataFrame, tags: DataFrame, start: int, candidates: int = 10) -> DataFrame:
    """(name, depth, text): of the newest tagged ancestors (name, object, tagged) the one with the fewest commits since; text is like ``v3-14-g1a2b3c4``."""
    spark = edges.sparkSession
    seen = written(reach(edges, [start]), "seen")
    few = tags.join(seen, F.col("object") == F.col("oid"), "left_semi").orderBy(F.desc("tagged"), F.desc("object")).limit(candidates).collect()
    if not few:
        return spark.createDataFrame([], "name string, depth long, text string")
    bits = carry(edges, spark.createDataFrame([(r.object, 1 << k) for k, r in enumerate(few)] , "oid long, value long"))
    marked = seen.join(bits, "oid", "left").select(F.coalesce("value", F.lit(0)).alias("value"))
    counts = marked.agg(*[F.count_if(F.col("value").bitwiseAND(F.lit(1 << k)) == 0).alias(f"d{k}") for k in range(len(few))]).first()
    best = min(range(len(few)), key=lambda k: (counts[k], few[k].name))
    text = few[best].name if not counts[best] else f"{few[best].name}-{counts[best]}-g{start:07x}"
    return spark.createDataFrame([(few[best].name, counts[best], text)], "name string, depth long, text string")


@query("""cand AS (SELECT name, object FROM tags JOIN ra ON object = oid ORDER BY tagged DESC, object DESC LIMIT 10), rt(name, oid) AS (SELECT name, object FROM cand UNION SELECT name, parent FROM rt JOIN edges ON child = rt.oid),
d AS (SELECT name, (SELECT count(*) FROM ra) - count(*) AS depth FROM rt GROUP BY name) SELECT name, depth, CASE WHEN depth = 0 THEN name ELSE name || '-' || depth || '-g' || lpad(lower(to_hex((SELECT a FROM tip))), 7, '0') END AS text FROM d ORDER BY depth, name LIMIT 1""")
def describe_commit(spark, sf_dir):
    return describe(edges(spark, sf_dir), commits(spark, sf_dir), tags(spark, sf_dir), tips(spark, sf_dir)[0])


# revision expressions


@dataclass(frozen=True)
class Step:
    kind: str  # parent, first, peel, log, checkout, search, path, describe
    value: int | str | None = None


_DESCRIBED = re.compile(r"(.+)-(\d+)-g([0-9a-f]{4,40})$")


def parse_revision(text: str) -> tuple[str, list[Step]]:
    """(name, steps) of ``name^2~3^{tree}:path``, ``name@{2}``, ``@{-1}``, ``^{/words}``, ``:/words``; ValueError if it is none."""
    if text.startswith(":/"):
        return "", [Step("search", text[2:])]
    if text.startswith(":"):
        return "", [Step("path", text[1:])]
    m = re.match(r"(?:(?!@\{|[\^~:]|\.\.).)*", text)
    name, at, steps = m[0], m.end(), []
    if name == "@":
        name = "HEAD"
    while at < len(text):
        rest = text[at:]
        if m := re.match(r"\^\{(/?)([^}]*)\}", rest):
            steps.append(Step("search", m[2]) if m[1] else Step("peel", m[2] or "any"))
        elif m := re.match(r"\^(\d*)", rest):
            steps.append(Step("parent", int(m[1] or 1)))
        elif m := re.match(r"~(\d*)", rest):
            steps.append(Step("first", int(m[1] or 1)))
        elif m := re.match(r"@\{-(\d+)\}", rest):
            if name or steps:
                raise ValueError(f"not a revision: {text!r}")
            steps.append(Step("checkout", int(m[1])))
        elif m := re.match(r"@\{(\d+)\}", rest):
            steps.append(Step("log", int(m[1])))
        elif m := re.match(r"@\{(u|upstream)\}", rest):
            steps.append(Step("upstream", None))
        elif m := re.match(r":(.*)$", rest, re.S):
            steps.append(Step("path", m[1]))
        else:
            raise ValueError(f"not a revision: {text!r}")
        at += m.end()
    if not name and not steps:
        raise ValueError("empty revision")
    return name or "HEAD", steps


def parse_range(text: str) -> tuple[str, str, str]:
    """(kind, since, until) of ``a..b`` ("range"), ``a...b`` ("symmetric"), ``^a`` ("not") or a single revision ("one")."""
    for dots, kind in (("...", "symmetric"), ("..", "range")):
        if dots in text:
            a, b = text.split(dots, 1)
            return kind, a or "HEAD", b or "HEAD"
    return ("not", "", text[1:]) if text.startswith("^") else ("one", "", text)


def candidates(name: str) -> list[str]:
    """Where a short name is looked for, in order."""
    return [name, f"refs/{name}", f"refs/tags/{name}", f"refs/heads/{name}", f"refs/remotes/{name}", f"refs/remotes/{name}/HEAD"]


class Revisions:
    """Evaluates revisions over refs (name, oid), edges, commits (oid, message, commit_time), logs (ref, update_index newest largest, oid, comment), peeled (oid, to), trees (oid, path, blob)."""

    def __init__(self, refs: DataFrame, edges: DataFrame, commits: DataFrame, logs: DataFrame | None = None, peeled: DataFrame | None = None, trees: DataFrame | None = None):
        self.refs, self.edges, self.commits, self.logs, self.peeled, self.trees = refs, edges, commits, logs, peeled, trees

    def _one(self, rows: DataFrame):
        found = rows.limit(2).collect()
        return found[0][0] if found else None

    def name(self, name: str):
        places = candidates(name)
        hit = self._one(self.refs.where(F.col("name").isin(places)).orderBy(F.array_position(F.array(*map(F.lit, places)), F.col("name"))).select("oid"))
        if hit is None and (m := _DESCRIBED.match(name)):
            name, hit = m[3], None
        if hit is None and re.fullmatch(r"[0-9a-f]{4,40}", name):
            found = self.commits.where(F.startswith(F.col("oid").cast("string"), F.lit(name))).select("oid").limit(2).collect()
            if len(found) > 1:
                raise ValueError(f"{name} is ambiguous")
            hit = found[0][0] if found else None
        return hit

    def resolve(self, text: str):
        """The id of a revision, or None; for ``rev:path`` the content's id."""
        name, steps = parse_revision(text)
        if not steps or steps[0].kind != "checkout":
            at = self.name(name)
        ref = next((r.name for r in self.refs.where(F.col("name").isin(candidates(name))).limit(1).collect()), name)
        for step in steps:
            if step.kind == "checkout":
                moved = self.logs.where((F.col("ref") == "HEAD") & F.startswith("comment", F.lit("checkout: moving from "))).orderBy(F.desc("update_index")).limit(step.value).collect()
                if len(moved) < step.value:
                    return None
                at = self.name(moved[-1].comment.split(" ")[3])
            elif step.kind == "log":
                found = self.logs.where(F.col("ref") == ref).orderBy(F.desc("update_index")).limit(step.value + 1).collect()
                at = found[-1].oid if len(found) == step.value + 1 else None
            elif at is None:
                return None
            elif step.kind == "parent":
                at = at if not step.value else self._one(self.edges.where((F.col("child") == at) & (F.col("nth") == step.value - 1)).select("parent"))
            elif step.kind == "first" and step.value:
                at = self._one(depths(self.edges.where("nth = 0"), [at], most=step.value).where(F.col("value") == step.value).select("oid"))
            elif step.kind == "peel" and self.peeled is not None:
                at = self._one(self.peeled.where(F.col("oid") == at).select("to")) or at
            elif step.kind == "search":
                seen = reach(self.edges, [at])
                at = self._one(self.commits.join(seen, "oid", "left_semi").where(F.rlike("message", F.lit(step.value))).orderBy(F.desc("commit_time"), F.desc("oid")).select("oid"))
            elif step.kind == "path":
                at = self._one(self.trees.where((F.col("oid") == at) & (F.col("path") == step.value)).select("blob"))
        return at

    def select(self, text: str) -> DataFrame:
        """(oid) of the commits that a range or a revision means."""
        kind, a, b = parse_range(text)
        if kind == "one":
            return reach(self.edges, [self.resolve(b)])
        if kind == "not":
            return self.commits.select("oid").join(reach(self.edges, [self.resolve(b)]), "oid", "left_anti")
        flags = self.edges.sparkSession.createDataFrame([(self.resolve(a), 1), (self.resolve(b), 2)], "oid long, value long")
        sides = carry(self.edges, flags.groupBy("oid").agg(F.bit_or("value").alias("value")))
        return sides.where("value = 2" if kind == "range" else "value <> 3").select("oid")


# lanes


def lanes(rows: list[tuple[int, list[int]]]) -> list[tuple[int, int, list[int]]]:
    """(oid, lane, lanes passing) for commits (oid, parents) in an order with children first: a first parent keeps its child's lane, free lanes are used again from the left."""
    held: list[int | None] = []
    out = []
    for oid, parents in rows:
        mine = [k for k, x in enumerate(held) if x == oid]
        if mine:
            lane = mine[0]
        elif None in held:
            lane = held.index(None)
        else:
            lane = len(held)
            held.append(None)
        for k in mine:
            held[k] = None
        passing = [k for k, x in enumerate(held) if x is not None and k != lane]
        out.append((oid, lane, passing))
        for n, p in enumerate(parents):
            if p in held:
                continue
            if n == 0:
                held[lane] = p
            elif None in held:
                held[held.index(None)] = p
            else:
                held.append(p)
        while held and held[-1] is None:
            held.pop()
    return out
