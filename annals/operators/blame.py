"""Which commit each line of a file comes from, over the file's whole history.

A file's history is one group: its versions are read into one task, and files are spread over tasks. Lines are passed from a
commit to its parents as ranges; a merge passes to each parent in turn what that has, and keeps the rest.
"""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annals.operators.alignment import matches, split_lines
from annals.session import table
from annals.registry import query

Region = tuple[int, int, int]  # first line of the result, first line of the source, lines


def joined(regions: list[Region]) -> list[Region]:
    """Regions with neighbours in both result and source made one."""
    out: list[list[int]] = []
    for at, source, n in sorted(regions):
        if out and out[-1][0] + out[-1][2] == at and out[-1][1] + out[-1][2] == source:
            out[-1][2] += n
        else:
            out.append([at, source, n])
    return [tuple(r) for r in out]


def passed(regions: list[Region], pairs: list[tuple[int, int]]) -> tuple[list[Region], list[Region]]:
    """(regions in the parent's lines, regions the parent doesn't have); pairs: (parent's line, child's line) of common lines."""
    where = {child: parent for parent, child in pairs}
    have, rest = [], []
    for at, source, n in regions:
        for k in range(n):
            old = where.get(source + k)
            if old is None:
                rest.append((at + k, source + k, 1))
            else:
                have.append((at + k, old, 1))
    return joined(have), joined(rest)


def blame(start: int, versions: dict[int, list[str]], parents: dict[int, list[int]], when: dict[int, int], algorithm: str = "histogram", comparison: str = "exact", known=None) -> list[tuple[int, int, int]]:
    """(line, commit, line in that commit) of the lines of the version at start, all from 0. A commit without the file is no source.

    known(commit): lines' (commit, line) of an earlier answer, taken as they are; then the walk doesn't go beyond that commit.
    """
    out: list[tuple[int, int, int]] = []
    waiting: dict[int, list[Region]] = {start: [(0, 0, len(versions[start]))] if versions[start] else []}
    heap = [(-when[start], start)]
    while heap:
        _, commit = heapq.heappop(heap)
        regions = joined(waiting.pop(commit, []))
        if not regions:
            continue
        if known is not None and (cached := known(commit)) is not None:
            out += [(at + k, *cached[source + k]) for at, source, n in regions for k in range(n)]
            continue
        above = [p for p in parents.get(commit, ()) if p in versions]
        same = next((p for p in above if versions[p] == versions[commit]), None)
        for p in [same] if same is not None else above:
            have, regions = passed(regions, matches(versions[p], versions[commit], algorithm, comparison))
            if have:
                if p not in waiting:
                    heapq.heappush(heap, (-when[p], p))
                waiting.setdefault(p, []).extend(have)
            if not regions:
                break
        out += [(at + k, commit, source + k) for at, source, n in regions for k in range(n)]
    return sorted(out)


def reverse_blame(start: int, end: list[int], versions: dict[int, list[str]], parents: dict[int, list[int]], when: dict[int, int]) -> list[tuple[int, int, int]]:
    """(line, commit, line in that commit): the last commit, from start towards the ends, in which each line of start's version still is."""
    inside, todo = set(), list(end)
    while todo:
        c = todo.pop()
        if c not in inside:
            inside.add(c)
            todo += parents.get(c, ())
    children: dict[int, list[int]] = {}
    for c in sorted(inside):
        for p in parents.get(c, ()):
            children.setdefault(p, []).append(c)
    return blame(start, versions, children, {c: -t for c, t in when.items()})


def blamed(versions: DataFrame, start: str = "max") -> DataFrame:
    """(file, line, commit, source_line, text), lines from 1, of each file's newest version; versions: (file, commit, seconds, parents array<long>, text)."""

    def run(rows: pa.Table) -> pa.Table:
        commit = rows.column("commit").to_pylist()
        texts = {c: split_lines(t or "") for c, t in zip(commit, rows.column("text").to_pylist())}
        parents = dict(zip(commit, (p or [] for p in rows.column("parents").to_pylist())))
        when = dict(zip(commit, rows.column("seconds").to_pylist()))
        tip = max(commit, key=lambda c: (when[c], c))
        found = blame(tip, texts, parents, when)
        file = rows.column("file")[0].as_py()
        return pa.table({"file": pa.array([file] * len(found), pa.int64()), "line": pa.array([r[0] + 1 for r in found], pa.int64()), "commit": pa.array([r[1] for r in found], pa.int64()), "source_line": pa.array([r[2] + 1 for r in found], pa.int64()), "text": pa.array([texts[tip][r[0]] for r in found], pa.string())})

    return versions.groupBy("file").applyInArrow(run, "file long, line long, commit long, source_line long, text string")


def _versions(spark, sf_dir) -> DataFrame:
    """Four versions of each text, lines numbered: 1 the text, 2 every fifth line edited, 3 (from 1) one added behind every seventh, 4 the merge of both."""
    numbered = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x, i: F.concat((i + 1).cast("string"), F.lit(": "), F.left(x, F.lit(40)), F.lit("\n")))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file"), numbered.alias("l"))
    edit = lambda x, i: F.when((i + 1) % 5 == 3, F.concat(F.lit("edited "), x)).otherwise(x)
    add = lambda x, i: F.when((i + 1) % 7 == 0, F.concat(x, F.lit("added "), (i + 1).cast("string"), F.lit("\n"))).otherwise(x)
    joined = lambda f: F.array_join(F.transform("l", f), "")
    rows = ((1, [], lambda x, i: x), (2, [1], edit), (3, [1], add), (4, [2, 3], lambda x, i: add(edit(x, i), i)))
    parts = [docs.select("file", F.lit(k).cast("long").alias("commit"), F.lit(k).cast("long").alias("seconds"), F.array(*map(F.lit, up)).cast("array<long>").alias("parents"), joined(f).alias("text")) for k, up, f in rows]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("""n AS (SELECT doc_id, unnest(generate_series(1, len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents),
l AS (SELECT doc_id AS file, i, 0 AS k, CASE WHEN i % 5 = 3 THEN 2 ELSE 1 END AS commit FROM n UNION ALL SELECT doc_id, i, 1, 3 FROM n WHERE i % 7 = 0)
SELECT file, row_number() OVER (PARTITION BY file ORDER BY i, k) AS line, CAST(commit AS BIGINT) AS commit, CAST(CASE commit WHEN 3 THEN i + i // 7 ELSE i END AS BIGINT) AS source_line FROM l""")
def blame_history(spark, sf_dir):
    """The origin of each line of a merge: the root, the side that edited, or the side that added."""
    return blamed(_versions(spark, sf_dir)).select("file", "line", "commit", "source_line")


@query("""n AS (SELECT doc_id, unnest(generate_series(1, len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents)
SELECT doc_id AS file, CAST(i AS BIGINT) AS line, CAST(CASE WHEN i % 5 = 3 THEN 3 ELSE 4 END AS BIGINT) AS commit FROM n""")
def blame_reversed(spark, sf_dir):
    """The last version that still has each line of the root."""
    versions = _versions(spark, sf_dir)

    def run(rows: pa.Table) -> pa.Table:
        commit = rows.column("commit").to_pylist()
        texts = {c: split_lines(t or "") for c, t in zip(commit, rows.column("text").to_pylist())}
        parents = dict(zip(commit, rows.column("parents").to_pylist()))
        found = reverse_blame(1, [4], texts, parents, {c: c for c in commit})
        return pa.table({"file": pa.array([rows.column("file")[0].as_py()] * len(found), pa.int64()), "line": pa.array([r[0] + 1 for r in found], pa.int64()), "commit": pa.array([r[1] for r in found], pa.int64())})

    return versions.groupBy("file").applyInArrow(run, "file long, line long, commit long")


@query("""n AS (SELECT doc_id, unnest(generate_series(1, len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents)
SELECT doc_id AS file, count(*) FILTER (WHERE i % 5 <> 3) AS from_root, count(*) FILTER (WHERE i % 5 = 3) AS from_edit, count(*) FILTER (WHERE i % 7 = 0) AS from_added FROM n GROUP BY 1""")
def blame_counts(spark, sf_dir):
    of = lambda k: F.count_if(F.col("commit") == k)
    return blamed(_versions(spark, sf_dir)).groupBy("file").agg(of(1).alias("from_root"), of(2).alias("from_edit"), of(3).alias("from_added"))
