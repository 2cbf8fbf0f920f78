"""Merges of trees with contents: three-way, one-sided, trivial, over several merge bases, and what is built on them: picking, reverting, rebasing commits.

A tree is a DataFrame (path, mode, oid, data). A merge is one full join on the path; contents are merged in an Arrow function only where both
sides changed them.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annals.operators import alignment
from annals.operators.logs import merge_bases
from annals.plans.closure import reach
from annals.session import table
from annals.plans.shared import written
from annals.registry import query

MERGED = "path string, mode int, data binary, state string"


def merged_mode(base, ours, theirs):
    """The mode of a merge; null if both sides changed it differently."""
    return ours if ours == theirs or theirs == base else theirs if ours == base else None


def merge_content(base: bytes | None, ours: bytes, theirs: bytes, favour: str | None = None) -> tuple[bytes, str]:
    """(content, "merged" or "conflict"): lines merged; favour "ours", "theirs" or "union" decides conflicts; binary contents only merge if one side is favoured."""
    if not all(alignment.is_text(x or b"") for x in (base, ours, theirs)):
        return (theirs if favour == "theirs" else ours), "merged" if favour in ("ours", "theirs") else "conflict"
    lines = lambda x: alignment.split_lines((x or b"").decode("utf-8", "surrogateescape"))
    chunks = alignment.merge3(lines(base), lines(ours), lines(theirs))
    if favour == "union":
        out = alignment.union(chunks)
    elif favour:
        out = [x for kind, a, _, b in chunks for x in (a if kind == "ok" or favour == "ours" else b)]
    else:
        out = []
        for kind, a, _, b in chunks:
            whole = lambda part: [x if x.endswith("\n") else x + "\n" for x in part]
            out += a if kind == "ok" else ["<<<<<<< OURS\n", *whole(a), "=======\n", *whole(b), ">>>>>>> THEIRS\n"]
    open_ = not favour and any(c[0] == "conflict" for c in chunks)
    return "".join(out).encode("utf-8", "surrogateescape"), "conflict" if open_ else "merged"


def merge(base: DataFrame, ours: DataFrame, theirs: DataFrame, favour: str | None = None, contents: bool = True) -> DataFrame:
    """(path, mode, data, state) of the merged tree; state: kept, taken, merged, conflict, modify/delete. Without contents (in core) both-sided changes are conflicts.

    A deleted path has no row; of a path deleted on one side and changed on the other the changed one stays, as modify/delete.
    """
    side = lambda t, n: t.select("path", F.struct("mode", "oid").alias(n), F.col("data").alias(f"{n}_data"))
    rows = side(base, "b").join(side(ours, "o"), "path", "full").join(side(theirs, "t"), "path", "full")
    what = F.expr("""case when o <=> t or b <=> t then if(o is null, 'gone', 'kept') when b <=> o then if(t is null, 'gone', 'taken')
      when o is null then 'md theirs' when t is null then 'md ours' when o.oid = t.oid then 'mode' else 'content' end""")
    rows = written(rows.select("*", what.alias("what")).where("what <> 'gone'"), "merge")
    plain = rows.where("what in ('kept', 'taken', 'md theirs', 'md ours')").select(
        "path", F.when(F.col("what").isin("kept", "md ours"), F.col("o.mode")).otherwise(F.col("t.mode")).alias("mode"), F.when(F.col("what").isin("kept", "md ours"), F.col("o_data")).otherwise(F.col("t_data")).alias("data"),
        F.when(F.startswith("what", F.lit("md")), "modify/delete").otherwise(F.col("what")).alias("state"),
    )
    both = rows.where("what in ('mode', 'content')").select("path", F.col("b.mode").alias("bm"), F.col("o.mode").alias("om"), F.col("t.mode").alias("tm"), F.col("what"), "b_data", "o_data", "t_data")

    def run(it):
        for big in it:
            for at in range(0, big.num_rows, 16):
                out = []
                for path, bm, om, tm, kind, b, o, t in zip(*(c.to_pylist() for c in big.slice(at, 16).columns)):
                    mode = merged_mode(bm, om, tm)
                    data, state = (o, "merged") if kind == "mode" else merge_content(b, o, t, favour) if contents else (o, "conflict")
                    out.append((path, om if mode is None else mode, data, state if mode is not None or favour else "conflict"))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.string(), pa.int32(), pa.binary(), pa.string()))], names=["path", "mode", "data", "state"])

    return plain.select("path", F.col("mode").cast("int").alias("mode"), F.col("data").cast("binary").alias("data"), "state").unionByName(both.mapInArrow(run, MERGED))


def as_tree(merged: DataFrame) -> DataFrame:
    """(path, mode, oid, data) of a merge's rows."""
    head = F.concat(F.lit("blob "), F.octet_length("data").cast("string")).cast("binary")
    return merged.select("path", "mode", F.sha1(F.concat(head, F.lit(bytearray(1)), F.col("data"))).alias("oid"), "data")


#: Merge strategies by name: (base, ours, theirs) -> rows as from merge. Further ones may be added.
STRATEGIES = {
    "resolve": merge,
    "in core": lambda b, o, t: merge(b, o, t, contents=False),
    "ours": lambda b, o, t: o.select("path", "mode", "data", F.lit("kept").alias("state")),
    "theirs": lambda b, o, t: t.select("path", "mode", "data", F.lit("taken").alias("state")),
    "favour ours": lambda b, o, t: merge(b, o, t, "ours"),
    "favour theirs": lambda b, o, t: merge(b, o, t, "theirs"),
    "union": lambda b, o, t: merge(b, o, t, "union"),
}


def decide(edges: DataFrame, ours: int, theirs: int) -> str:
    """What merging theirs into ours means: "up to date", "fast-forward" or "merge"."""
    if ours == theirs:
        return "up to date"
    flags = reach(edges, [ours]).where(F.col("oid") == theirs).count(), reach(edges, [theirs]).where(F.col("oid") == ours).count()
    return "up to date" if flags[0] else "fast-forward" if flags[1] else "merge"


MOST_BASES = 200


def virtual_base(edges: DataFrame, tree_of, ours: int, theirs: int, depth: int = 0) -> DataFrame:
    """The tree that merges of several merge bases start from: the bases merged one after the other, their own bases first.

    tree_of(commit) gives (path, mode, oid, data); without a common ancestor the base is empty. Conflicts within the virtual base stay in it as text.
    """
    bases = sorted((r.oid for r in merge_bases(edges, [ours, theirs]).collect()), reverse=True)  # few: maximal common ancestors
    if len(bases) > MOST_BASES:
        raise ValueError(f"{len(bases)} merge bases")
    if not bases:
        return tree_of(ours).limit(0)
    tree, first = tree_of(bases[0]), bases[0]
    for other in bases[1:]:
        tree = as_tree(written(merge(virtual_base(edges, tree_of, first, other, depth + 1), tree, tree_of(other)), "base"))
    return tree


def recursive(edges: DataFrame, tree_of, ours: int, theirs: int, strategy: str = "resolve") -> DataFrame:
    """The merge of two commits over all of their merge bases."""
    return STRATEGIES[strategy](virtual_base(edges, tree_of, ours, theirs), tree_of(ours), tree_of(theirs))


def cherry_pick(parent: DataFrame, commit: DataFrame, head: DataFrame, strategy: str = "resolve") -> DataFrame:
    """A commit's change of its parent made to head."""
    return STRATEGIES[strategy](parent, head, commit)


def revert(parent: DataFrame, commit: DataFrame, head: DataFrame, strategy: str = "resolve") -> DataFrame:
    """A commit's change taken back from head."""
    return STRATEGIES[strategy](commit, head, parent)


def rebase(steps: list[tuple[str, DataFrame, DataFrame]], onto: DataFrame) -> tuple[DataFrame, list[int]]:
    """(tree, numbers of the steps that stand) after picking steps (action, parent tree, commit tree) one by one; it stops at the first conflict, as a rebase does. "drop" leaves a step out."""
    tree, done = onto, []
    for k, (action, parent, commit) in enumerate(steps):
        if action == "drop":
            continue
        made = written(cherry_pick(parent, commit, tree), "pick")
        if not made.where("state in ('conflict', 'modify/delete')").isEmpty():
            return as_tree(made), done
        tree = as_tree(made)
        done.append(k)
    return tree, done


def stash_apply(base: DataFrame, stash: DataFrame, worktree: DataFrame) -> DataFrame:
    """A stash's change of its base made to the work tree."""
    return merge(base, worktree, stash)


def _three(spark, sf_dir):
    """Texts with numbered lines; ours edits lines 2, 12, .., theirs 7, 17, .., both 32, 82, ..; a third of paths is gone on one side."""
    numbered = F.transform(F.sequence(F.lit(1), F.lit(90)), lambda i: F.concat(i.cast("string"), F.lit(" of "), F.col("doc_id").cast("string"), F.lit("\n")))
    docs = table(spark, sf_dir, "documents").where("doc_id % 5 = 0").select("doc_id", F.concat(F.lit("d/"), "doc_id").alias("path"), numbered.alias("l"))

    def tree(mark, hit):
        data = F.array_join(F.transform("l", lambda x, i: F.when(hit(i + 1), F.concat(F.lit(mark), x)).otherwise(x)), "").cast("binary")
        rows = docs.select("doc_id", "path", F.lit(33188).alias("mode"), data.alias("data"))
        return rows.withColumn("oid", F.md5("data"))

    base = tree("", lambda i: F.lit(False))
    ours = tree("ours ", lambda i: (i % 10 == 2)).where("doc_id % 3 <> 0")
    theirs = tree("theirs ", lambda i: (i % 10 == 7) | (i % 50 == 32)).where("doc_id % 7 <> 0")
    return base, ours, theirs


@query("""d AS (SELECT doc_id, 'd/' || doc_id AS path FROM documents WHERE doc_id % 5 = 0)
SELECT path, CASE WHEN doc_id % 3 = 0 OR doc_id % 7 = 0 THEN 'modify/delete' ELSE 'conflict' END AS state, CAST(CASE WHEN doc_id % 3 = 0 OR doc_id % 7 = 0 THEN 90 ELSE 98 END AS BIGINT) AS lines,
CAST(CASE WHEN doc_id % 3 = 0 OR doc_id % 7 = 0 THEN 0 ELSE 2 END AS BIGINT) AS conflicts FROM d WHERE NOT (doc_id % 3 = 0 AND doc_id % 7 = 0)""")
def content_merge(spark, sf_dir):
    """Lines edited apart merge, lines edited by both sides conflict, files deleted on one side and edited on the other are marked."""
    made = merge(*_three(spark, sf_dir))
    text = F.col("data").cast("string")
    return made.select("path", "state", F.regexp_count(text, F.lit("\n")).cast("long").alias("lines"), F.regexp_count(text, F.lit("<<<<<<<")).cast("long").alias("conflicts"))


@query("""SELECT 'd/' || doc_id AS path, CAST(90 AS BIGINT) AS lines, CAST(9 AS BIGINT) AS ours, CAST(9 AS BIGINT) AS theirs FROM documents WHERE doc_id % 5 = 0 AND doc_id % 3 <> 0 AND doc_id % 7 <> 0""")
def merge_favouring(spark, sf_dir):
    """The same with conflicts decided for our side: nine lines of ours, nine of theirs, as two of theirs lose."""
    made = STRATEGIES["favour ours"](*_three(spark, sf_dir)).where("state = 'merged'")
    count = lambda t: F.regexp_count(F.col("data").cast("string"), F.lit(t)).cast("long")
    return made.select("path", count("\n").alias("lines"), count("ours ").alias("ours"), count("theirs ").alias("theirs"))


@query("SELECT 'd/' || doc_id AS path, 'picked' AS how, true AS fine FROM documents WHERE doc_id % 5 = 0 AND doc_id % 7 <> 0 UNION ALL SELECT 'd/' || doc_id, 'reverted', true FROM documents WHERE doc_id % 5 = 0 AND doc_id % 7 <> 0")
def pick_and_revert(spark, sf_dir):
    """Their change picked onto the base gives their tree; reverted from there it gives the base again."""
    base, _, theirs = _three(spark, sf_dir)
    base = base.join(theirs.select("path"), "path", "left_semi")
    picked = as_tree(cherry_pick(base, theirs, base))
    same = lambda made, want, how: made.select("path", F.md5("data").alias("x")).join(want.select("path", F.md5("data").alias("y")), "path").select("path", F.lit(how).alias("how"), (F.col("x") == F.col("y")).alias("fine"))
    back = as_tree(revert(base, theirs, theirs))
    return same(picked, theirs, "picked").unionByName(same(back, base, "reverted"))
