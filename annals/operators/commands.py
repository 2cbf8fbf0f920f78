"""Changes of a repository as transformations of its tables: refs with their log, staged entries, work tree, objects, notes, remotes.

Nothing is changed in place: a command takes tables and gives the tables after it, which the caller writes. Checks (expected old values, name
conflicts, fast-forwards, connectivity) are joins, whatever the number of commands.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from annals import extensions
from annals.operators import checks
from annals.operators.alignment import split_lines
from annals.plans.closure import reach
from annals.plans.history import commits, edges, refs, tips, trees
from annals.plans.shared import written
from annals.registry import query
from annals.sources import texts
from annals.sources.files import each, open_fs, put

# refs


def conflicting_names(names: DataFrame) -> DataFrame:
    """(name) of names that are a folder of another name or lie in one."""
    parents = names.select("name", F.explode(F.expr("transform(filter(sequence(1, size(split(name, '/'))), k -> k < size(split(name, '/'))), k -> array_join(slice(split(name, '/'), 1, k), '/'))")).alias("folder"))
    hit = parents.join(names.select(F.col("name").alias("folder")), "folder", "left_semi")
    return hit.select("name").unionByName(hit.select(F.col("folder").alias("name"))).distinct()


def update_refs(now: DataFrame, commands: DataFrame, edges: DataFrame | None = None, atomic: bool = False, hooks: bool = True) -> tuple[DataFrame, DataFrame]:
    """(refs after, results (name, status)) of commands (name, old, new, force) on refs (name, oid); null old: must not be there, null new: delete.

    status: NEW, FAST_FORWARD or FORCED (with edges to decide), DELETED, NO_CHANGE, LOCK_FAILURE (another old value), REJECTED (no fast-forward), INVALID (name), CONFLICT (with
    another name), ABORTED (another command of an atomic batch failed, or a hook refused).
    """
    rows = commands.join(now.withColumnRenamed("oid", "was"), "name", "left")
    bad_name = F.udf(lambda n: checks.ref_problem(n or "") is not None and n != "HEAD", "boolean")
    if edges is not None:
        moves = rows.where("was is not null and new is not null and was <> new").select("name", "was", "new")
        # old values that the new ones reach: one closure over all new values, with a bit a command where few, else commit by commit
        few = moves.collect() if moves.limit(63).count() < 63 else None
        if few is not None:
            from annals.plans.closure import carry

            flags = carry(edges, edges.sparkSession.createDataFrame([(int(r.new), 1 << k) for k, r in enumerate(few)], "oid long, value long")) if few else None
            ahead = [r.name for k, r in enumerate(few) if flags.where((F.col("oid") == int(r.was)) & (F.col("value").bitwiseAND(F.lit(1 << k)) != 0)).count()] if few else []
            rows = rows.withColumn("ahead", F.col("name").isin(ahead))
        else:
            rows = rows.join(_ahead(edges, moves), "name", "left").withColumn("ahead", F.coalesce("ahead", F.lit(False)))
    else:
        rows = rows.withColumn("ahead", F.lit(True))
    status = (
        F.when(bad_name("name"), "INVALID").when(~F.col("old").eqNullSafe(F.col("was")), "LOCK_FAILURE").when(F.col("new").eqNullSafe(F.col("was")), "NO_CHANGE").when(F.col("new").isNull(), "DELETED")
        .when(F.col("was").isNull(), "NEW").when(F.col("ahead"), "FAST_FORWARD").when(F.col("force"), "FORCED").otherwise("REJECTED")
    )
    rows = written(rows.select("name", "new", status.alias("status")), "updates")
    fine = F.col("status").isin("NEW", "FAST_FORWARD", "FORCED", "DELETED", "NO_CHANGE")
    after = now.join(rows.where(fine).select("name"), "name", "left_anti").unionByName(rows.where(fine & F.col("new").isNotNull()).select("name", F.col("new").alias("oid")))
    clash = conflicting_names(after.select("name")).join(rows.where("status = 'NEW'").select("name"), "name", "left_semi").withColumn("clash", F.lit(True))
    rows = written(rows.join(clash, "name", "left").select("name", "new", F.when(F.col("clash"), "CONFLICT").otherwise(F.col("status")).alias("status")), "updates")
    if (atomic and not rows.where(~fine).isEmpty()) or (hooks and extensions.run_hooks("pre-receive", rows)):
        return now, rows.select("name", F.when(fine, "ABORTED").otherwise(F.col("status")).alias("status"))
    after = now.join(rows.where(fine & (F.col("status") != "NO_CHANGE")).select("name"), "name", "left_anti").unionByName(rows.where(fine & F.col("new").isNotNull() & (F.col("status") != "NO_CHANGE")).select("name", F.col("new").alias("oid")))
    if hooks:
        extensions.run_hooks("post-receive", rows)
    return after, rows.select("name", "status")


def _ahead(edges: DataFrame, moves: DataFrame) -> DataFrame:
    """(name, ahead) of moves (name, was, new): whether new reaches what was, by walks that carry the command's name."""
    known = front = written(moves.select("name", F.col("new").alias("oid")), "walks")
    while not front.isEmpty():
        out = front.join(edges, F.col("oid") == F.col("child")).select("name", F.col("parent").alias("oid")).distinct()
        front = written(out.join(known, ["name", "oid"], "left_anti"), "walks")
        known = written(known.unionByName(front), "walks")
    return moves.join(known, ["name"]).where(F.col("was") == F.col("oid")).select("name", F.lit(True).alias("ahead"))


def appended_log(log: DataFrame, before: DataFrame, after: DataFrame, who: str, comment: str, seconds: int) -> DataFrame:
    """The log (ref, update_index, old, new, who, seconds, comment) with an entry for each ref that differs."""
    last = log.groupBy("ref").agg(F.max("update_index").alias("last"))
    moved = before.select("name", F.col("oid").alias("old")).join(after.select("name", F.col("oid").alias("new")), "name", "full").where("not (old <=> new)")
    new = moved.withColumnRenamed("name", "ref").join(last, "ref", "left").select("ref", (F.coalesce("last", F.lit(0)) + 1).alias("update_index"), "old", "new", F.lit(who).alias("who"), F.lit(seconds).cast("long").alias("seconds"), F.lit(comment).alias("comment"))
    return log.select(new.columns).unionByName(new)


def renamed_ref(now: DataFrame, log: DataFrame, old: str, new: str) -> tuple[DataFrame, DataFrame]:
    """Refs and log after a rename, which takes the log along; ValueError if the new name is taken or invalid."""
    if checks.ref_problem(new) or not now.where(F.col("name") == new).isEmpty():
        raise ValueError(f"{new} can't be a new name")
    move = lambda c: F.when(F.col(c) == old, new).otherwise(F.col(c)).alias(c)
    return now.select(*[move(c) if c == "name" else c for c in now.columns]), log.select(*[move(c) if c == "ref" else c for c in log.columns])


def expired_log(log: DataFrame, before: int, keep_reachable: DataFrame | None = None, unreachable_before: int | None = None) -> DataFrame:
    """The log without entries older than a time; those that are no longer reachable (keep_reachable: oid) go by a time of their own."""
    if keep_reachable is None:
        return log.where(F.col("seconds") >= before)
    rows = log.join(keep_reachable.select(F.col("oid").alias("new"), F.lit(True).alias("there")).distinct(), "new", "left")
    return rows.where(F.when(F.col("there"), F.col("seconds") >= before).otherwise(F.col("seconds") >= (unreachable_before or before))).select(log.columns)


def deleted_branches(now: DataFrame, names: list[str], head: int, edges: DataFrame, force: bool = False) -> tuple[DataFrame, list[str]]:
    """(refs after, names refused): branches go if head reaches them, or by force."""
    wanted = now.where(F.col("name").isin(names))
    kept = [] if force else [r.name for r in wanted.join(reach(edges, [head]), "oid", "left_anti").collect()]  # of the names given
    return now.where(~F.col("name").isin([n for n in names if n not in kept])), kept


def listed(now: DataFrame, prefix: str, log: DataFrame | None = None) -> DataFrame:
    """(short, name, oid) of refs with a prefix, in order of names."""
    return now.where(F.startswith("name", F.lit(prefix))).select(F.expr(f"substr(name, {len(prefix) + 1})").alias("short"), "name", "oid").orderBy("name")


def short_name(name: str) -> str:
    """How a ref is shown."""
    return next((name[len(p) :] for p in ("refs/heads/", "refs/tags/", "refs/remotes/") if name.startswith(p)), name)


def fetched(remote: DataFrame, local: DataFrame, specs: list[str]) -> DataFrame:
    """Commands (name, old, new, force) that bring local refs up to a remote's by refspecs."""
    plus = [s for s in specs if s.startswith("+")]
    mapped = each(remote.select("name", F.col("oid").cast("string")), lambda n, o: [(t, o, any(texts.map_ref(s, n) == t for s in plus)) for _, t in texts.map_refs(specs, [n])], "name string, new string, force boolean", 1024)
    rows = mapped.join(local.select("name", F.col("oid").cast("string").alias("old")), "name", "left")
    return rows.where("not (old <=> new)").select("name", F.col("old").cast("long"), F.col("new").cast("long"), "force")


# objects


def commit_bytes(tree: str, parents: list[str], author: str, committer: str, message: str, encoding: str = "UTF-8") -> bytes:
    head = [f"tree {tree}", *(f"parent {p}" for p in dict.fromkeys(parents)), f"author {author}", f"committer {committer}", *([] if encoding.upper() in ("UTF-8", "UTF8") else [f"encoding {encoding}"])]
    return ("\n".join(head) + "\n\n").encode() + message.encode(encoding)


def tag_bytes(oid: str, kind: str, name: str, tagger: str | None, message: str) -> bytes:
    return "\n".join([f"object {oid}", f"type {kind}", f"tag {name}", *([f"tagger {tagger}"] if tagger else []), "", message]).encode()


def change_id(tree: str, parent: str | None, author: str, committer: str, message: str) -> str:
    """The id of a change from what it was made of."""
    import hashlib

    body = f"tree {tree}\n" + (f"parent {parent}\n" if parent else "") + f"author {author}\ncommitter {committer}\n\n{message}"
    return "I" + hashlib.sha1(f"commit {len(body.encode())}\0{body}".encode()).hexdigest()


def with_change_id(message: str, change: str, replace: bool = False) -> str:
    """The message with a Change-Id trailer: in place of an old one if asked for, else in front of other trailers or in a paragraph of its own."""
    m = re.search(r"(?m)^Change-Id: .*$", message)
    if m:
        return message[: m.start()] + f"Change-Id: {change}" + message[m.end() :] if replace else message
    lines = message.rstrip("\n").split("\n")
    start = next((k + 1 for k in range(len(lines) - 1, -1, -1) if not lines[k].strip()), None)
    trailers = start is not None and all(re.match(r"[A-Za-z0-9-]+: |\s|\[", x) for x in lines[start:])
    if trailers:
        lines.insert(start, f"Change-Id: {change}")
    else:
        lines += ["", f"Change-Id: {change}"]
    return "\n".join(lines) + "\n"


def inserted(store: DataFrame, objects: DataFrame) -> DataFrame:
    """The store (oid, type, data) with objects it lacks, each once; inserting again changes nothing."""
    return store.unionByName(objects.dropDuplicates(["oid"]).join(store.select("oid"), "oid", "left_anti").select(store.columns))


def segments(objects: DataFrame, heads: DataFrame, tags: DataFrame, others: DataFrame, now: int, keep_seconds: int = 14 * 86400) -> DataFrame:
    """(oid, segment) of a repack: what heads reach, what only tags do, what only other refs and logs do (rest), unreferenced but young, and expired ones to be dropped."""
    rows = objects
    for name, found in (("h", heads), ("t", tags), ("r", others)):
        rows = rows.join(found.select("oid", F.lit(True).alias(name)).distinct(), "oid", "left")
    kind = F.when(F.col("h"), "heads").when(F.col("t"), "tags").when(F.col("r"), "rest").when(F.col("mtime") >= now - keep_seconds, "unreferenced").otherwise("expired")
    return rows.select("oid", kind.alias("segment"))


def negotiated(edges: DataFrame, wants: list[int], rounds: list[list[int]]) -> tuple[DataFrame, list[list[int]]]:
    """(commits to send, what each round acknowledged): haves that the server knows; the walk ends once all wants are covered, and what a common commit reaches isn't sent."""
    known = edges.select(F.col("child").alias("oid")).unionByName(edges.select(F.col("parent").alias("oid"))).distinct()
    common: list[int] = []
    told = []
    for haves in rounds:
        there = [r.oid for r in known.where(F.col("oid").isin(haves)).collect()]  # of one round's haves
        told.append(sorted(there))
        common += there
    send = reach(edges, wants)
    return (send.join(reach(edges, common), "oid", "left_anti") if common else send), told


def refused_wants(advertised: DataFrame, edges: DataFrame, wants: list[int], policy: str = "advertised") -> list[int]:
    """Wants that a policy (advertised, reachable, tip, any) doesn't allow."""
    if policy == "any":
        return []
    allowed = reach(edges, advertised.select("oid")) if policy == "reachable" else advertised.select("oid")
    fine = {r.oid for r in allowed.where(F.col("oid").isin(wants)).collect()}  # of the wants
    return sorted(set(wants) - fine)


# staged entries and work tree: (path, mode, oid)


def added(index: DataFrame, worktree: DataFrame, paths: list[str], update: bool = False) -> DataFrame:
    """The index with files at or below paths as they are in the work tree ("." for all); update: only files it already has. Deleted files go if update."""
    here = _below("path", paths)
    new = worktree.where(here)
    if update:
        new = new.join(index.select("path"), "path", "left_semi")
        return index.where(~here).unionByName(new.select(index.columns))
    return index.join(new.select("path"), "path", "left_anti").unionByName(new.select(index.columns))


def removed(index: DataFrame, paths: list[str]) -> DataFrame:
    return index.where(~_below("path", paths))


def _below(column: str, paths: list[str]):
    if "." in paths:
        return F.lit(True)
    test = F.lit(False)
    for p in paths:
        test = test | (F.col(column) == p) | F.startswith(F.col(column), F.lit(p.rstrip("/") + "/"))
    return test


def cleaned(index: DataFrame, worktree: DataFrame, rules: dict | None = None, ignored: bool = False) -> DataFrame:
    """(path) of untracked files, without ignored ones unless asked for."""
    left = worktree.select("path").join(index.select("path"), "path", "left_anti")
    if rules and not ignored:
        left = each(left, lambda p: [] if texts.is_ignored(rules, p) else [(p,)], "path string", 1024)
    return left


def reset(mode: str, head: DataFrame, index: DataFrame, worktree: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(index, work tree) after a reset to head: "soft" leaves both, "mixed" the work tree, "hard" neither (untracked files stay)."""
    if mode == "soft":
        return index, worktree
    if mode == "mixed":
        return head, worktree
    if mode == "hard":
        return head, worktree.join(index.select("path"), "path", "left_anti").join(head.select("path"), "path", "left_anti").unionByName(head)
    raise ValueError(mode)


def stashed(head: DataFrame, index: DataFrame, worktree: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(stashed index, stashed work tree of tracked files, index after, work tree after)."""
    tracked = worktree.join(index.select("path"), "path", "left_semi")
    return index, tracked, *reset("hard", head, index, worktree)


DECISIONS = """case
 when m.oid is null and h.oid is null then if(i.oid is null, 'keep', 'keep')
 when h <=> m then if(i is null and h is not null, 'keep removed', 'keep')
 when i <=> m then 'keep'
 when m is null then case when i is null then 'keep' when i <=> h then if(w is null or w <=> i, 'remove', 'conflict') else 'conflict' end
 when h is null then case when i is null then if(w is null or w <=> m, 'update', 'conflict') else 'conflict' end
 when i is null then if(w is null, 'update', 'conflict')
 when i <=> h then if(w is null or w <=> i or w <=> m, 'update', 'conflict')
 else 'conflict' end"""


def checkout_decisions(head: DataFrame, merge: DataFrame, index: DataFrame, worktree: DataFrame) -> DataFrame:
    """(path, action) of moving from head to merge over an index and a work tree: update, remove, keep, keep removed or conflict."""
    side = lambda t, n: t.select("path", F.struct("mode", "oid").alias(n))
    rows = side(head, "h").join(side(merge, "m"), "path", "full").join(side(index, "i"), "path", "full").join(side(worktree, "w"), "path", "full")
    return rows.select("path", F.expr(DECISIONS).alias("action"))


def checked_out(tree: DataFrame, folder: str) -> DataFrame:
    """Writes the files of a tree (path, data); (path, bytes)."""

    def work(path, data):
        if any(checks.path_problem(p, windows=False) for p in path.split("/")):
            raise ValueError(f"unsafe path {path}")
        fs, root = open_fs(folder)
        put(fs, f"{root}/{path}", data)
        return [(path, len(data))]

    return each(tree.select("path", "data"), work, "path string, bytes long", 8)


def work_tree(spark, folder: str, rules: dict | None = None) -> DataFrame:
    """(path, mode, oid, size, mtime) of the files below a folder, without ignored ones and what begins with .git/."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    root = folder.split("://", 1)[-1].removeprefix("file:").rstrip("/")
    rows = files.select(F.expr(f"substr(path, instr(path, '{root}/') + {len(root) + 1})").alias("path"), F.unix_seconds("modificationTime").alias("mtime"), "content")
    rows = rows.where(~F.startswith("path", F.lit(".git/")))
    if rules:
        rows = rows.join(each(rows.select("path"), lambda p: [] if texts.is_ignored(rules, p) else [(p,)], "path string", 1024), "path", "left_semi")
    head = F.concat(F.lit("blob "), F.octet_length("content").cast("string")).cast("binary")
    return rows.select("path", F.lit(0o100644).alias("mode"), F.sha1(F.concat(head, F.lit(bytearray(1)), F.col("content"))).alias("oid"), F.octet_length("content").cast("long").alias("size"), "mtime")


def archived(tree: DataFrame, folder: str, kind: str = "tgz", prefix: str = "", parts: int = 1) -> DataFrame:
    """Archives of a tree (path, mode, data), cut by ranges of paths; (file, entries). kind: a registered archive format."""
    import pyarrow as pa

    make = extensions.find("archive format", kind)

    def run(it):
        from pyspark import TaskContext

        rows = [(prefix + p, m, d) for batch in it for p, m, d in zip(*(c.to_pylist() for c in batch.columns))]
        if rows:
            name = f"archive-{TaskContext.get().partitionId():06d}.{kind}"
            fs, root = open_fs(folder)
            put(fs, f"{root}/{name}", make(rows))
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(rows)], pa.int64())], names=["file", "entries"])

    return tree.select("path", "mode", "data").repartitionByRange(parts, "path").sortWithinPartitions("path").mapInArrow(run, "file string, entries long")


def patched(tree: DataFrame, patch: str) -> DataFrame:
    """(path, data, problem) of a tree (path, data) after a patch: unchanged files as they are, deleted ones without row; where hunks don't apply the old content and the problem."""
    made = texts.parse_patch(patch)
    by_old = {f.old_path: f for f in made if f.old_path is not None and f.change != "COPY"}
    copies = [f for f in made if f.change == "COPY"]
    rows = [(f.new_path, b"", None) for f in made if f.old_path is None]

    def changed(f, data):
        try:
            lines = split_lines(data.decode("utf-8", "surrogateescape"))
            return "".join(texts.apply_hunks(lines, f.hunks)).encode("utf-8", "surrogateescape"), None
        except ValueError as wrong:
            return data, str(wrong)

    def work(path, data):
        out = [(f.new_path, *changed(f, data)) for f in copies if f.old_path == path]
        f = by_old.get(path)
        if f is None:
            return [(path, data, None), *out]
        return out if f.change == "DELETE" else [(f.new_path, *changed(f, data)), *out]

    old = each(tree.select("path", "data"), work, "path string, data binary, problem string", 16)
    fresh = tree.sparkSession.createDataFrame([(p, bytearray(changed(next(f for f in made if f.old_path is None and f.new_path == p), b"")[0]), None) for p, _, _ in rows], "path string, data binary, problem string")
    return old.unionByName(fresh)


# notes, submodules


def note_path(oid: str, fanout: int) -> str:
    """Where a note stands at a fan-out of so many levels of two digits."""
    return "/".join([*(oid[2 * k : 2 * k + 2] for k in range(fanout)), oid[2 * fanout :]])


def noted(notes: DataFrame, changes: DataFrame) -> DataFrame:
    """Notes (oid, note) after changes (oid, note): a null note removes."""
    return notes.join(changes.select("oid"), "oid", "left_anti").unionByName(changes.where("note is not null").select(notes.columns))


def submodule_status(index: DataFrame, config: DataFrame, heads: DataFrame) -> DataFrame:
    """(path, status, oid, head) of gitlinks among entries, with config (path, name, url) and heads of their repositories (path, oid)."""
    links = index.where(F.col("mode") == 0o160000).select("path", "oid")
    rows = links.join(config.select("path", "url", F.lit(True).alias("known")), "path", "left").join(heads.select("path", F.col("oid").alias("head")), "path", "left")
    status = F.when(F.col("known").isNull(), "MISSING").when(F.col("url").isNull(), "UNINITIALIZED").when(F.col("head").isNull(), "INITIALIZED").when(F.col("head") == F.col("oid"), "CURRENT").otherwise("REV_CHECKED_OUT")
    return rows.select("path", status.alias("status"), "oid", "head")


def squash_message(rows: list[tuple[str, str, str, str]]) -> str:
    """The message of a squashed history of (oid, author, date, message)."""
    out = ["Squashed commit of the following:\n"]
    for oid, author, date, message in rows:
        out.append(f"\ncommit {oid}\nAuthor: {author}\nDate:   {date}\n\n" + "".join(f"\t{line}\n" for line in message.splitlines()))
    return "".join(out)


def merge_message(names: list[str], into: str) -> str:
    """The message of a merge of refs into a branch."""
    kinds: dict[str, list[str]] = {}
    for n in names:
        kind = "branch" if n.startswith("refs/heads/") else "remote-tracking branch" if n.startswith("refs/remotes/") else "tag" if n.startswith("refs/tags/") else "commit"
        kinds.setdefault(kind, []).append(f"'{short_name(n)}'")
    join = lambda x: x[0] if len(x) == 1 else ", ".join(x[:-1]) + " and " + x[-1]
    plural = lambda k, x: k if len(x) == 1 else k + ("es" if k.endswith("h") else "s")
    return "Merge " + ", ".join(f"{plural(k, x)} {join(x)}" for k, x in kinds.items()) + ("" if short_name(into) in ("main", "master") else f" into {short_name(into)}")


# queries


@query("""c AS (SELECT name, oid, CASE oid % 4 WHEN 0 THEN oid + 1 ELSE oid END AS old, CASE oid % 3 WHEN 0 THEN NULL WHEN 1 THEN oid ELSE -oid - 1 END AS new FROM refs)
SELECT name, CASE WHEN contains(name, ' ') THEN 'INVALID' WHEN old <> oid THEN 'LOCK_FAILURE' WHEN new = oid THEN 'NO_CHANGE' WHEN new IS NULL THEN 'DELETED' ELSE 'FAST_FORWARD' END AS status FROM c UNION ALL SELECT 'refs/heads/bad..name', 'INVALID' UNION ALL SELECT 'refs/heads', 'CONFLICT'""")
def ref_updates(spark, sf_dir):
    """One batch with every outcome."""
    now = refs(spark, sf_dir)
    old = F.when(F.col("oid") % 4 == 0, F.col("oid") + 1).otherwise(F.col("oid"))
    new = F.when(F.col("oid") % 3 == 1, F.col("oid")).when(F.col("oid") % 3 == 2, -F.col("oid") - 1)
    more = spark.createDataFrame([("refs/heads/bad..name", None, 1, False), ("refs/heads", None, 1, False)], "name string, old long, new long, force boolean")
    return update_refs(now, now.select("name", old.alias("old"), new.alias("new"), F.lit(False).alias("force")).unionByName(more))[1]


@query("""SELECT coalesce(h.path, m.path) AS path, CASE WHEN h.oid IS NOT DISTINCT FROM m.oid AND h.mode IS NOT DISTINCT FROM m.mode THEN 'keep' WHEN m.oid IS NULL THEN 'remove' ELSE 'update' END AS action FROM base_tree h FULL JOIN tree_b m ON h.path = m.path""")
def checkout_clean(spark, sf_dir):
    """A checkout over a clean index and work tree."""
    base, _, target = trees(spark, sf_dir)
    return checkout_decisions(base, target, base, base)


@query("SELECT path FROM tree_a WHERE path NOT IN (SELECT path FROM base_tree)")
def clean_candidates(spark, sf_dir):
    base, work, _ = trees(spark, sf_dir)
    return cleaned(base, work)


@query("""h AS (SELECT oid FROM ra), t AS (SELECT oid FROM rb), o AS (SELECT oid, epoch(commit_time) AS s FROM commits)
SELECT CASE WHEN oid IN (SELECT oid FROM h) THEN 'heads' WHEN oid IN (SELECT oid FROM t) THEN 'tags' WHEN oid % 5 = 0 THEN 'rest' WHEN oid % 2 = 0 THEN 'unreferenced' ELSE 'expired' END AS segment, count(*) AS objects FROM o GROUP BY 1""")
def repack_segments(spark, sf_dir):
    """Objects of a repack by what reaches them; by number of id, some are young."""
    a, b = tips(spark, sf_dir)
    e = edges(spark, sf_dir)
    rows = commits(spark, sf_dir).select("oid", F.when(F.col("oid") % 2 == 0, 10**6).otherwise(0).alias("mtime"))
    found = segments(rows, reach(e, [a]), reach(e, [b]), rows.where("oid % 5 = 0"), 10**6 + 14 * 86400)
    return found.groupBy("segment").agg(F.count("*").alias("objects"))


@query("""SELECT oid, unnest(CASE WHEN oid % 5 = 0 THEN ['no tree', 'no author', 'no committer'] WHEN oid % 7 = 0 THEN ['bad author'] ELSE [] END) AS problem FROM commits""")
def object_rules(spark, sf_dir):
    """Commit objects of which every fifth has a broken first header and every seventh a broken zone."""
    from annals.functions.raw import raw_commits

    rows = raw_commits(spark, sf_dir)
    bad = F.when(F.col("oid") % 5 == 0, F.replace("raw", F.lit("tree "), F.lit("tee "))).when(F.col("oid") % 7 == 0, F.replace("raw", F.lit(" +0130"), F.lit(" +130"))).otherwise(F.col("raw"))
    found = checks.checked(rows.select(F.col("oid").cast("string").alias("oid"), F.lit("commit").alias("type"), bad.cast("binary").alias("data")))
    return found.select(F.col("oid").cast("long").alias("oid"), "problem")
