"""What users may add: predicates, sources, algorithms, strategies, mergers, formats, filters, hooks. Each kind is a table by name; names are taken once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annals.operators.alignment import ALGORITHMS, COMPARISONS
from annals.operators.merging import STRATEGIES
from annals.sources.files import each
from annals.sources.texts import format_pointer, parse_pointer

#: note mergers (base, ours, theirs) -> text or None; archive formats (entries) -> bytes; content filters (clean, smudge); hooks (event rows) -> None or a refusal;
#: transports by scheme (spark, uri) -> (refs, objects); message providers (commit row) -> text; section parsers (settings) -> value.
TABLES: dict[str, dict] = {
    "revision predicate": {}, "tree predicate": {}, "tree source": {}, "diff algorithm": ALGORITHMS, "comparison": COMPARISONS, "merge strategy": STRATEGIES,
    "note merger": {}, "archive format": {}, "content filter": {}, "hook": {}, "transport": {}, "message provider": {}, "section parser": {}, "blame cache": {}, "row state": {},
}


def register(kind: str, name: str, what: Callable | tuple) -> None:
    if kind not in TABLES:
        raise KeyError(f"no such kind: {kind}")
    if name in TABLES[kind]:
        raise ValueError(f"{kind} {name} is there already")
    TABLES[kind][name] = what


def unregister(kind: str, name: str) -> None:
    TABLES[kind].pop(name, None)


def find(kind: str, name: str):
    try:
        return TABLES[kind][name]
    except KeyError:
        raise KeyError(f"no {kind} named {name}; there are {sorted(TABLES[kind])}") from None


def commits_where(commits: DataFrame, name: str) -> DataFrame:
    """Commits that a user's predicate includes: a function of the DataFrame's columns to a Column, or of a row's values to a bool."""
    test = find("revision predicate", name)
    if getattr(test, "columns", False):
        return commits.where(test({c: F.col(c) for c in commits.columns}))
    schema, names = commits.schema, commits.columns

    def run(it):
        import pyarrow as pa

        for batch in it:
            rows = batch.to_pylist()
            yield batch.filter(pa.array([bool(test(r)) for r in rows], pa.bool_()))

    return commits.select(names).mapInArrow(run, schema)


def as_columns(test: Callable) -> Callable:
    """Marks a predicate as one of columns, which stays in the JVM."""
    test.columns = True
    return test


DESCEND, INCLUDE, SKIP = -1, 0, 1


def entries_where(entries: DataFrame, name: str) -> DataFrame:
    """Entries (path, ..) that a user's three-valued predicate includes; where it says SKIP of a folder, nothing below it is seen. DESCEND keeps a folder's entries in question without including it."""
    test = find("tree predicate", name)

    def seen(path: str):
        parts = path.split("/")
        for k in range(1, len(parts)):
            if test("/".join(parts[:k]), True) == SKIP:
                return []
        return [(path,)] if test(path, False) == INCLUDE else []

    return entries.join(each(entries.select("path").distinct(), seen, "path string", 1024), "path", "left_semi")


def tree_from(spark, name: str, *args) -> DataFrame:
    """(path, mode, oid) rows of a user's tree source, which gives an iterable of them or a DataFrame."""
    made = find("tree source", name)(spark, *args)
    return made if isinstance(made, DataFrame) else spark.createDataFrame(list(made), "path string, mode int, oid string")


def merged_notes(base: DataFrame, ours: DataFrame, theirs: DataFrame, name: str = "concatenate") -> DataFrame:
    """(oid, note) of notes (oid, note) by a note merger, which is asked only where both sides changed a note differently."""
    merger = find("note merger", name)
    rows = base.select("oid", F.col("note").alias("b")).join(ours.select("oid", F.col("note").alias("o")), "oid", "full").join(theirs.select("oid", F.col("note").alias("t")), "oid", "full")
    plain = rows.where("o <=> t or b <=> t").select("oid", F.col("o").alias("note")).unionByName(rows.where("not (o <=> t) and b <=> o").select("oid", F.col("t").alias("note"))).where("note is not null")
    asked = rows.where("not (o <=> t or b <=> t or b <=> o)").select("oid", "b", "o", "t")
    kind = dict(base.dtypes)["oid"].replace("bigint", "long")
    return plain.unionByName(each(asked, lambda i, b, o, t: [(i, m)] if (m := merger(b, o, t)) is not None else [], f"oid {kind}, note string"))


def filtered(contents: DataFrame, name: str, clean: bool = True) -> DataFrame:
    """(path, data) through a content filter: cleaned as stored, or smudged as checked out."""
    work = find("content filter", name)[0 if clean else 1]
    return each(contents.select("path", "data"), lambda path, data: [(path, work(path, data))], "path string, data binary", 16)


def run_hooks(event: str, rows: DataFrame) -> str | None:
    """The first refusal of the hooks for an event, or None."""
    for name, hook in sorted(TABLES["hook"].items()):
        if name.split(":")[0] == event and (no := hook(rows)):
            return no
    return None


def _tar(entries, mode: str) -> bytes:
    import io
    import tarfile

    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode=mode) as tar:
        for path, bits, data in entries:
            info = tarfile.TarInfo(path)
            info.size, info.mode = len(data), bits & 0o777 or 0o644
            if bits == 0o120000:
                info.type, info.linkname, info.size = tarfile.SYMTYPE, data.decode(), 0
            tar.addfile(info, io.BytesIO(data) if info.size else None)
    return out.getvalue()


def _zip(entries) -> bytes:
    import io
    import zipfile

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for path, bits, data in entries:
            info = zipfile.ZipInfo(path)
            info.external_attr = (bits & 0xFFFF) << 16
            z.writestr(info, data, zipfile.ZIP_DEFLATED)
    return out.getvalue()


for _name, _mode in (("tar", "w"), ("tgz", "w:gz"), ("tbz2", "w:bz2"), ("txz", "w:xz")):
    register("archive format", _name, lambda entries, mode=_mode: _tar(entries, mode))
register("archive format", "zip", _zip)
register("note merger", "concatenate", lambda b, o, t: o if t is None else t if o is None else f"{o}\n{t}")
register("content filter", "large files", (lambda path, data: data if parse_pointer(data) else format_pointer(data), lambda path, data: data))
register("content filter", "eol lf", (lambda path, data: data if b"\0" in data[:8000] else data.replace(b"\r\n", b"\n"), lambda path, data: data))
register("content filter", "eol crlf", (lambda path, data: data if b"\0" in data[:8000] else data.replace(b"\r\n", b"\n"), lambda path, data: data if b"\0" in data[:8000] else data.replace(b"\r\n", b"\n").replace(b"\n", b"\r\n")))
