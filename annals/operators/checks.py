"""Whether objects and names are well formed: rules for commits, tags, trees, paths and refs; ``problems`` gives all that are broken."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from annals.sources.files import each
from annals.sources.staging import FOLDER, read_tree

#: The modes entries may have, names that mean devices, and characters some file systems ignore within names.
MODES = (0o100644, 0o100755, 0o120000, FOLDER, 0o160000, 0o100664)
DEVICES = frozenset(["con", "prn", "aux", "nul", *(f"com{k}" for k in range(1, 10)), *(f"lpt{k}" for k in range(1, 10))])
IGNORED = re.compile("[\u200c-\u200f\u202a-\u202e\u206a-\u206f\ufeff]")
_ID = re.compile(r"[0-9a-f]{40}")
_PERSON = re.compile(r"[^<>\n]* <[^<>\n]*> (0|[1-9]\d*) [+-]\d{4}")


def path_problem(name: str, windows: bool = True, mac: bool = True) -> str | None:
    """What makes a name of a tree entry unsafe, or None."""
    if not name:
        return "empty name"
    if "/" in name or "\0" in name:
        return "name with a separator"
    if name in (".", ".."):
        return f"name {name}"
    low = name.lower()
    if low == ".git":
        return "name .git"
    if mac and IGNORED.sub("", low) == ".git":
        return "name that some file systems take for .git"
    if windows:
        if re.fullmatch(r"\.git[ .]*|git~1", low) or re.match(r"\.git\s*:", low):
            return "name that some file systems take for .git"
        if name[-1] in " .":
            return "name that ends in a blank or a dot"
        if low.split(".")[0] in DEVICES:
            return "name of a device"
        if re.search(r'[<>:"\\|?*\x01-\x1f]', name):
            return "character that some file systems forbid"
    return None


def ref_problem(name: str) -> str | None:
    """What makes a ref name invalid, or None."""
    rules = (
        (r"^$|^/|/$|//", "empty part"), (r"(^|/)\.", "part that starts with a dot"), (r"\.\.", "two dots"), (r"@\{", "@{"), (r"[\x00-\x20\x7f~^:?*\[\\]", "forbidden character"),
        (r"\.lock(/|$)", "part that ends in .lock"), (r"\.$", "dot at the end"), (r"^@$", "@ alone"), (r"^[^/]*$", "no slash"),
    )
    return next((why for pattern, why in rules if re.search(pattern, name)), None)


def _headers(data: bytes, rules: list[tuple[str, str, bool, bool]]) -> list[str]:
    """Problems of headers that must come in order; rules: (name, kind, needed, repeats)."""
    lines = data.decode("utf-8", "replace").split("\n\n", 1)[0].split("\n")
    out, at = [], 0
    for name, kind, needed, repeats in rules:
        n = 0
        while at < len(lines) and lines[at].startswith(name + " ") and (repeats or not n):
            value = lines[at][len(name) + 1 :]
            if kind == "id" and not _ID.fullmatch(value) or kind == "person" and not _PERSON.fullmatch(value) or kind == "type" and value not in ("commit", "tree", "blob", "tag"):
                out.append(f"bad {name}")
            at, n = at + 1, n + 1
        if needed and not n:
            out.append(f"no {name}")
    return out


def problems(kind: str, data: bytes, windows: bool = True, mac: bool = True) -> list[str]:
    """All rules an object breaks; blobs break none."""
    if kind == "commit":
        return _headers(data, [("tree", "id", True, False), ("parent", "id", False, True), ("author", "person", True, False), ("committer", "person", True, False)])
    if kind == "tag":
        return _headers(data, [("object", "id", True, False), ("type", "type", True, False), ("tag", "text", True, False), ("tagger", "person", False, False)])
    if kind != "tree":
        return [] if kind == "blob" else [f"unknown type {kind}"]
    try:
        rows = read_tree(data)
    except ValueError:
        return ["truncated"]
    out, seen, last, folded = [], set(), None, set()
    for name, mode, oid in rows:
        text = name.decode("utf-8", "replace")
        if why := path_problem(text, windows, mac):
            out.append(why)
        if mode not in MODES:
            out.append(f"mode {mode:o}")
        if oid == "0" * 40:
            out.append("zero id")
        key = name + b"/" if mode == FOLDER else name
        if name in seen:
            out.append("duplicate name")
        elif last is not None and key < last:
            out.append("not in order")
        if (windows or mac) and text.lower() in folded and name not in seen:
            out.append("names that differ by case only")
        seen.add(name)
        folded.add(text.lower())
        last = key
    if re.search(rb"(^|\0.{20})0\d", data, re.S) and data[:1] == b"0":
        out.append("mode with a leading zero")
    return out


def checked(objects: DataFrame) -> DataFrame:
    """(oid, problem) of objects (oid, type, data): one row a broken rule."""
    return each(objects.select("oid", "type", "data"), lambda oid, kind, data: [(oid, p) for p in problems(kind, data or b"")], "oid string, problem string")
