"""Text formats around a history: configuration, reflogs, patches, rules for ignored paths and attributes, todo lists, pointers, manifests, bundles, framed lines.

Each is a function of one text, and ``each`` makes a DataFrame of the rows of many.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from xml.etree import ElementTree

# configuration


@dataclass(frozen=True)
class Setting:
    section: str
    subsection: str | None
    name: str | None
    value: str | None  # None: the name stands alone, which means true


_SECTION = re.compile(r'\[\s*([A-Za-z0-9.-]+)(?:\s+"((?:[^"\\]|\\.)*)")?\s*\]')
_NAME = re.compile(r"[A-Za-z][A-Za-z0-9-]*")
_ESCAPES = {"n": "\n", "t": "\t", "b": "\b", '"': '"', "\\": "\\"}


def parse_config(text: str, include=None, depth: int = 0) -> list[Setting]:
    """Settings in order. include(path) gives the text of an included file, or None; ten levels deep at most."""
    if text.startswith("\ufeff"):
        text = text[1:]
    out: list[Setting] = []
    section, sub, at = "", None, 0
    while at < len(text):
        c = text[at]
        if c.isspace():
            at += 1
        elif c in "#;":
            at = text.find("\n", at) + 1 or len(text)
        elif c == "[":
            m = _SECTION.match(text, at)
            if not m:
                raise ValueError(f"bad section at {at}")
            section, sub, at = m[1].lower(), m[2], m.end()
            if sub is not None:
                sub = re.sub(r"\\(.)", r"\1", sub)
            elif "." in section:
                section, sub = section.split(".", 1)
            out.append(Setting(section, sub, None, None))
        else:
            m = _NAME.match(text, at)
            if not m or not section:
                raise ValueError(f"bad name at {at}")
            name, at = m[0].lower(), m.end()
            while at < len(text) and text[at] in " \t":
                at += 1
            value = None
            if at < len(text) and text[at] == "=":
                value, at = _value(text, at + 1)
            elif at < len(text) and text[at] not in "\r\n#;":
                raise ValueError(f"bad entry {name}")
            out.append(Setting(section, sub, name, value))
            if section == "include" and name == "path" and include and value:
                if depth >= 10:
                    raise ValueError("includes nested too deeply")
                more = include(value)
                if more is not None:
                    out += parse_config(more, include, depth + 1)
    return out


def _value(text: str, at: int) -> tuple[str, int]:
    """The value that starts at a position: quotes, escapes, comments and continued lines."""
    out, blanks, quoted, begun = [], "", False, False
    while at < len(text):
        c = text[at]
        at += 1
        if c == "\n":
            if quoted:
                raise ValueError("quote across lines")
            break
        if c == "\r" and text[at : at + 1] == "\n":
            continue
        if not quoted and c in "#;":
            at = text.find("\n", at) + 1 or len(text)
            break
        if not quoted and c in " \t":
            blanks += c if begun else ""
            continue
        begun = True
        out.append(blanks)
        blanks = ""
        if c == '"':
            quoted = not quoted
        elif c == "\\":
            if at >= len(text):
                raise ValueError("ends in an escape")
            e = text[at]
            at += 1
            if e == "\r" and text[at : at + 1] == "\n":
                e, at = "\n", at + 1
            if e == "\n":
                continue
            if e not in _ESCAPES:
                raise ValueError(f"bad escape {e!r}")
            out.append(_ESCAPES[e])
        else:
            out.append(c)
    return "".join(out), at


def format_config(settings: list[Setting]) -> str:
    """The text of settings, with a head for each run of one section."""
    out, now = [], None
    for s in settings:
        if (s.section, s.subsection) != now:
            now = (s.section, s.subsection)
            escaped = (s.subsection or "").replace("\\", "\\\\").replace('"', '\\"')
            out.append(f"[{s.section}]\n" if s.subsection is None else f'[{s.section} "{escaped}"]\n')
        if s.name is not None:
            out.append(f"\t{s.name}\n" if s.value is None else f"\t{s.name} = {_quoted(s.value)}\n")
    return "".join(out)


def _quoted(value: str) -> str:
    body = value.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\t", "\\t").replace("\b", "\\b")
    return f'"{body}"' if re.search(r"^\s|\s$|[#;]", value) else body


YES, NO = ("yes", "true", "1", "on"), ("no", "false", "0", "off", "")


class Config:
    """Typed access; the last value of a name counts."""

    def __init__(self, settings: list[Setting]):
        self.settings = settings

    def strings(self, section: str, sub: str | None, name: str) -> list[str | None]:
        return [s.value for s in self.settings if (s.section, s.subsection, s.name) == (section.lower(), sub, name.lower())]

    def string(self, section, sub, name, default=None):
        found = self.strings(section, sub, name)
        return found[-1] if found else default

    def boolean(self, section, sub, name, default=False) -> bool:
        found = self.strings(section, sub, name)
        if not found:
            return default
        if found[-1] is None or found[-1].lower() in YES:
            return True
        if found[-1].lower() in NO:
            return False
        raise ValueError(f"{name} is not a boolean: {found[-1]}")

    def number(self, section, sub, name, default=0, low=None, high=None) -> int:
        text = self.string(section, sub, name)
        if text is None:
            return default
        m = re.fullmatch(r"\s*([+-]?\d+)\s*([kKmMgG]?)\s*", text)
        if not m:
            raise ValueError(f"{name} is not a number: {text}")
        n = int(m[1]) << {"": 0, "k": 10, "m": 20, "g": 30}[m[2].lower()]
        if low is not None and n < low or high is not None and n > high:
            raise ValueError(f"{name} is out of range: {n}")
        return n

    def choice(self, section, sub, name, choices: list[str], default: str) -> str:
        text = self.string(section, sub, name)
        if text is None:
            return default
        hit = [c for c in choices if c.lower().replace("_", "-") == text.lower().replace("_", "-").replace(" ", "-")]
        if not hit:
            raise ValueError(f"{name} is none of {choices}: {text}")
        return hit[0]

    def duration(self, section, sub, name, default=0) -> float:
        """Seconds of a number with a unit (ms, s, min, h, d, w, y)."""
        text = self.string(section, sub, name)
        if text is None:
            return default
        m = re.fullmatch(r"\s*(\d+)\s*([a-z]+)?\s*", text.lower())
        units = {"ms": 0.001, "milliseconds": 0.001, "s": 1, "sec": 1, "second": 1, "seconds": 1, "m": 60, "min": 60, "minute": 60, "minutes": 60, "h": 3600, "hr": 3600, "hour": 3600, "hours": 3600, "d": 86400, "day": 86400, "days": 86400, "w": 604800, "week": 604800, "weeks": 604800, "mon": 2592000, "month": 2592000, "months": 2592000, "y": 31536000, "year": 31536000, "years": 31536000}
        if not m or (m[2] or "s") not in units:
            raise ValueError(f"{name} is not a duration: {text}")
        return int(m[1]) * units[m[2] or "s"]

    def subsections(self, section: str) -> list[str]:
        return list(dict.fromkeys(s.subsection for s in self.settings if s.section == section.lower() and s.subsection is not None))

    def branch(self, name: str) -> dict:
        """Remote, merged ref, upstream and rebase mode of a branch."""
        remote, merge = self.string("branch", name, "remote"), self.string("branch", name, "merge")
        tracking = None
        if remote == ".":
            tracking = merge
        elif remote and merge:
            tracking = next((t for spec in self.strings("remote", remote, "fetch") if spec and (t := map_ref(spec, merge))), None)
        mode = (self.string("branch", name, "rebase") or self.string("pull", None, "rebase") or "false").lower()
        return {"remote": remote, "merge": merge, "tracking": tracking, "rebase": "rebase" if mode in YES else "none" if mode in NO else mode}

    def submodules(self) -> list[dict]:
        return [{"name": n, **{k: self.string("submodule", n, k) for k in ("path", "url", "branch", "update", "ignore")}} for n in self.subsections("submodule")]

    def put(self, section, sub, name, value) -> Config:
        """With one value in place of all that a name has."""
        kept = [s for s in self.settings if (s.section, s.subsection, s.name) != (section, sub, name)]
        at = max((k + 1 for k, s in enumerate(kept) if (s.section, s.subsection) == (section, sub)), default=len(kept))
        return Config(kept[:at] + [Setting(section, sub, name, value)] + kept[at:])

    def without(self, section, sub=None) -> Config:
        return Config([s for s in self.settings if (s.section, s.subsection) != (section, sub)])


def map_ref(spec: str, name: str) -> str | None:
    """What a refspec makes of a name; None if it doesn't match or excludes it."""
    spec = spec.lstrip("+")
    if spec.startswith("^"):
        return None
    source, _, target = spec.partition(":")
    if "*" not in source:
        return (target or source) if name == source else None
    head, _, tail = source.partition("*")
    if len(name) < len(head) + len(tail) or not name.startswith(head) or not name.endswith(tail):
        return None
    return (target or source).replace("*", name[len(head) : len(name) - len(tail)], 1)


def map_refs(specs: list[str], names: list[str]) -> list[tuple[str, str]]:
    """(name, target) by the first spec that matches; names that a negative spec matches are left out."""
    negative = [s[1:] for s in specs if s.startswith("^")]
    out = []
    for n in names:
        if any(map_ref(s, n) is not None for s in negative):
            continue
        hit = next((t for s in specs if (t := map_ref(s, n)) is not None), None)
        if hit is not None:
            out.append((n, hit))
    return out


# lines of several kinds


_IDENT = re.compile(r"(.*?)\s*<(.*)>(?: (-?\d+) ([+-]\d{4}))?$", re.S)


def parse_ident(text: str) -> tuple[str, str, int, int] | None:
    """(name, mail, seconds, zone in minutes) of a person line; None if it isn't one."""
    m = _IDENT.match(text)
    if not m:
        return None
    zone = m[4] or "+0000"
    return m[1].strip(), m[2].strip(), int(m[3] or 0), (-1 if zone[0] == "-" else 1) * (int(zone[1:3]) * 60 + int(zone[3:]))


def format_ident(name: str, mail: str, seconds: int, zone: int) -> str:
    """A person line; characters that would break it are left out."""
    clean = lambda t: re.sub(r"[<>\n\0]", "", t).strip(" .,:;\"'\\\t\r")
    return f"{clean(name)} <{clean(mail)}> {seconds} {'-' if zone < 0 else '+'}{abs(zone) // 60:02d}{abs(zone) % 60:02d}"


def parse_reflog(text: str) -> list[tuple[str, str, str, str, int, int, str]]:
    """(old, new, name, mail, seconds, zone, comment), newest first; lines that aren't entries are left out."""
    out = []
    for line in text.split("\n"):
        m = re.match(r"([0-9a-f]{40}) ([0-9a-f]{40}) (.*)", line)
        who, _, comment = (m[3] if m else "").partition("\t")
        ident = parse_ident(who) if m else None
        if ident:
            out.append((m[1], m[2], *ident, comment))
    return out[::-1]


def format_reflog(old: str, new: str, name: str, mail: str, seconds: int, zone: int, comment: str) -> str:
    return f"{old} {new} {format_ident(name, mail, seconds, zone)}\t{re.sub(chr(10), ' ', comment).strip()}\n"


def parse_fetch_head(text: str) -> list[tuple[str, bool, str, str, str]]:
    """(oid, not for merge, kind, name, url) a line."""
    out = []
    for line in text.splitlines():
        m = re.match(r"([0-9a-f]{40})\t(not-for-merge)?\t(?:(branch|tag) )?'?([^']*?)'?(?: of (.*))?$", line)
        if m:
            out.append((m[1], bool(m[2]), m[3] or "ref", m[4], m[5] or ""))
    return out


def format_fetch_head(oid: str, skip: bool, name: str, url: str) -> str:
    for prefix, kind in (("refs/heads/", "branch "), ("refs/tags/", "tag ")):
        if name.startswith(prefix):
            return f"{oid}\t{'not-for-merge' if skip else ''}\t{kind}'{name[len(prefix):]}' of {url}\n"
    return f"{oid}\t{'not-for-merge' if skip else ''}\t'{name}' of {url}\n"


#: The actions of a todo list and their short forms.
ACTIONS = {"pick": "p", "reword": "r", "edit": "e", "squash": "s", "fixup": "f"}


def parse_todo(text: str) -> list[tuple[str, str, str]]:
    """(action, commit, message); comments keep their text under the action "comment"."""
    short = {v: k for k, v in ACTIONS.items()}
    out = []
    for line in text.splitlines():
        if line.startswith("#") or not line.strip():
            out.append(("comment", "", line))
            continue
        action, commit, *rest = line.split(" ", 2)
        action = short.get(action, action)
        if action not in ACTIONS:
            raise ValueError(f"unknown action {action}")
        out.append((action, commit, rest[0] if rest else ""))
    return out


def format_todo(steps: list[tuple[str, str, str]]) -> str:
    return "".join(f"{m}\n" if a == "comment" else f"{a} {c} {m}\n" for a, c, m in steps)


POINTER = "https://git-lfs.github.com/spec/v1"


def parse_pointer(data: bytes) -> tuple[str, int] | None:
    """(SHA-256 id, size) of a pointer to large content, None if it is none: 1 KiB at most, version first, then names in order."""
    if len(data) > 1024 or not data.startswith(b"version "):
        return None
    try:
        rows = [line.split(" ", 1) for line in data.decode().splitlines()]
        fields = dict(rows)
        oid = re.fullmatch(r"sha256:([0-9a-f]{64})", fields.get("oid", ""))
        names = [r[0] for r in rows]
        fine = oid and int(fields["size"]) >= 0 and names[1:] == sorted(names[1:]) and fields["version"] in (POINTER, POINTER.replace("git-lfs", "hawser"))
        return (oid[1], int(fields["size"])) if fine else None
    except (ValueError, KeyError, UnicodeDecodeError):
        return None


def format_pointer(data: bytes) -> bytes:
    """The pointer that stands for a content."""
    import hashlib

    return f"version {POINTER}\noid sha256:{hashlib.sha256(data).hexdigest()}\nsize {len(data)}\n".encode()


def parse_manifest(text: str, include=None) -> list[tuple[str, str, str, str, str]]:
    """(path, name, url, revision, groups) of the projects of an XML manifest; defaults, remotes, removals and includes apply."""
    root = ElementTree.fromstring(text)
    remotes, default, projects = {}, {}, {}

    def walk(node):
        for x in node:
            if x.tag == "remote":
                remotes[x.get("name")] = x.get("fetch", ""), x.get("revision")
            elif x.tag == "default":
                default.update(x.attrib)
            elif x.tag == "project":
                projects[x.get("path") or x.get("name")] = dict(x.attrib)
            elif x.tag == "remove-project":
                for k in [k for k, p in projects.items() if p.get("name") == x.get("name")]:
                    del projects[k]
            elif x.tag == "include" and include and (more := include(x.get("name"))) is not None:
                walk(ElementTree.fromstring(more))

    walk(root)
    out = []
    for path, p in sorted(projects.items()):
        fetch, own = remotes.get(p.get("remote") or default.get("remote"), ("", None))
        out.append((path, p["name"], f"{fetch.rstrip('/')}/{p['name']}" if fetch else p["name"], p.get("revision") or own or default.get("revision") or "", p.get("groups", "")))
    return out


# framed lines and bundles


def frame(line: bytes | None) -> bytes:
    """A line with its length in front; None is the end mark."""
    if line is None:
        return b"0000"
    if len(line) > 65516:
        raise ValueError("line too long")
    return f"{len(line) + 4:04x}".encode() + line


def unframe(data: bytes) -> list[bytes | None]:
    """The lines of framed data; None for the end mark, b"\\1" for a delimiter."""
    out, at = [], 0
    while at < len(data):
        n = int(data[at : at + 4], 16)
        if n in (0, 1):
            out.append(None if not n else b"\1")
            at += 4
        elif n < 4 or at + n > len(data):
            raise ValueError("broken frame")
        else:
            out.append(data[at + 4 : at + n])
            at += n
    return out


def side_bands(data: bytes) -> dict[int, bytes]:
    """The bytes of each band of framed data: 1 content, 2 progress, 3 errors."""
    out = {1: b"", 2: b"", 3: b""}
    for line in unframe(data):
        if line:
            out[line[0]] += line[1:]
    return out


def format_bundle(refs: list[tuple[str, str]], lacks: list[tuple[str, str]], pack: bytes) -> bytes:
    """A bundle of refs (oid, name); lacks: commits (oid, comment) that the other side must have."""
    head = "# v2 git bundle\n" + "".join(f"-{o}{' ' + c if c else ''}\n" for o, c in lacks) + "".join(f"{o} {n}\n" for o, n in refs)
    return head.encode() + b"\n" + pack


def parse_bundle(data: bytes) -> tuple[list[tuple[str, str]], list[tuple[str, str]], bytes]:
    """(refs, lacks, pack) of a bundle."""
    head, blank, pack = data.partition(b"\n\n")
    lines = head.decode().split("\n")
    if lines[0] != "# v2 git bundle" or not blank:
        raise ValueError("not a version 2 bundle")
    lacks = [tuple((line[1:] + " ").split(" ", 1)) for line in lines[1:] if line.startswith("-")]
    return [tuple(line.split(" ", 1)) for line in lines[1:] if not line.startswith("-")], [(o, c.strip()) for o, c in lacks], pack


# rules for paths


def _glob(pattern: str) -> str:
    """The regular expression of a pattern whose ``*`` and ``?`` stay within a name."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i) and (i == 0 or pattern[i - 1] == "/"):
            out, i = out + "(?:.*/)?", i + 3
        elif pattern[i:] == "**" and (i == 0 or pattern[i - 1] == "/"):
            out, i = out + ".+", i + 2
        elif c == "*":
            out, i = out + "[^/]*", i + 1
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "\\" and i + 1 < len(pattern):
            out, i = out + re.escape(pattern[i + 1]), i + 2
        elif c == "[" and (m := _BRACKET.match(pattern, i)):
            body = re.sub(r"\[:(\w+):\]", lambda m: CLASSES.get(m[1], ""), m[2].replace("\\", "\\\\") if "[:" not in m[2] else m[2])
            out, i = out + f"[{'^/' if m[1] else ''}{body}]", m.end()
        else:
            out, i = out + re.escape(c), i + 1
    return out


_BRACKET = re.compile(r"\[([!^]?)((?:\]|\[:\w+:\]|\\.|[^\]])(?:\[:\w+:\]|\\.|[^\]])*)\]")
#: What the named classes of patterns mean.
CLASSES = {"alnum": "A-Za-z0-9", "alpha": "A-Za-z", "blank": r" \t", "cntrl": r"\x00-\x1f\x7f", "digit": "0-9", "graph": r"\x21-\x7e", "lower": "a-z", "print": r"\x20-\x7e", "punct": r"!-/:-@\[-`{-~", "space": r"\s", "upper": "A-Z", "xdigit": "0-9A-Fa-f", "word": r"\w"}


def matches_name(pattern: str, name: str) -> bool:
    """Whether a whole name matches a pattern."""
    return re.fullmatch(_glob(pattern), name, re.S) is not None


@dataclass(frozen=True)
class Rule:
    regex: re.Pattern
    negative: bool
    folders_only: bool
    by_name: bool


def parse_ignore(text: str) -> list[Rule]:
    """The rules of an ignore file, in order."""
    out = []
    for line in text.split("\n"):
        line = line.rstrip("\r")
        if not line or line.startswith("#"):
            continue
        while line.endswith(" ") and not line.endswith("\\ "):
            line = line[:-1]
        negative = line.startswith("!")
        line = line[negative:]
        folders = line.endswith("/")
        line = line.rstrip("/") if folders else line
        if not line:
            continue
        by_name = "/" not in line
        out.append(Rule(re.compile(_glob(line.removeprefix("/")), re.S), negative, folders, by_name))
    return out


def _rule_hit(rules: list[Rule], path: str, is_folder: bool) -> bool | None:
    for rule in reversed(rules):
        if rule.folders_only and not is_folder:
            continue
        if rule.regex.fullmatch(path.rsplit("/", 1)[-1] if rule.by_name else path):
            return not rule.negative
    return None


def is_ignored(files: dict[str, list[Rule]], path: str, is_folder: bool = False) -> bool:
    """Whether rule files (by folder, "" the top) ignore a path: the last rule of the nearest file wins, and what is in an ignored folder is ignored."""
    parts = path.split("/")
    for k in range(1, len(parts) + 1):
        here, folder = "/".join(parts[:k]), k < len(parts) or is_folder
        verdict = None
        for up in range(k - 1, -1, -1):
            base = "/".join(parts[:up])
            if base in files:
                verdict = _rule_hit(files[base], here[len(base) + 1 :] if base else here, folder)
                if verdict is not None:
                    break
        if verdict:
            return True
    return False


def parse_attributes(text: str) -> tuple[list[tuple[str, dict]], dict[str, dict]]:
    """([(pattern, states)], macros): states are True, False, None (unspecified) or a text."""

    def states(words):
        found = {}
        for w in words:
            if w[0] == "-":
                found[w[1:]] = False
            elif w[0] == "!":
                found[w[1:]] = None
            else:
                k, eq, v = w.partition("=")
                found[k] = v if eq else True
        return found

    rules, macros = [], {"binary": {"diff": False, "merge": False, "text": False}}
    for line in text.splitlines():
        words = line.split()
        if not words or words[0].startswith("#"):
            continue
        if words[0].startswith("[attr]"):
            macros[words[0][6:]] = states(words[1:])
        elif len(words) > 1:
            rules.append((words[0], states(words[1:])))
    return rules, macros


def attributes_of(files: dict[str, tuple[list, dict]], path: str) -> dict:
    """The attributes of a path from attribute files by folder: nearer files win, later lines win, macros are spelled out; unspecified ones are left out."""
    macros: dict = {}
    for _, m in files.values():
        macros |= m
    found: dict = {}
    folders = ["", *("/".join(path.split("/")[:k]) for k in range(1, path.count("/") + 1))]
    for base in folders:
        if base not in files:
            continue
        inside = path[len(base) + 1 :] if base else path
        for pattern, states in files[base][0]:
            target = inside if "/" in pattern.strip("/") or pattern.startswith("/") else inside.rsplit("/", 1)[-1]
            if not matches_name(pattern.removeprefix("/"), target):
                continue
            for k, v in states.items():
                if k in macros and v is True:
                    found |= macros[k]
                found[k] = v
    return {k: v for k, v in found.items() if v is not None}


# patches


@dataclass
class FilePatch:
    old_path: str | None = None
    new_path: str | None = None
    change: str = "MODIFY"
    old_mode: str | None = None
    new_mode: str | None = None
    score: int = 0
    binary: bool = False
    hunks: list = field(default_factory=list)  # (old start, old lines, new start, new lines, text)


def _name(text: str, prefix: str) -> str | None:
    text = text.split("\t")[0].strip("\n")
    if text.startswith('"') and text.endswith('"'):
        text = dequote(text)
    return None if text == "/dev/null" else text.removeprefix(prefix)


_HUNK = re.compile(r"@@+ -(\d+)(?:,(\d+))? (?:-\d+(?:,\d+)? )*\+(\d+)(?:,(\d+))? @@+")


def parse_patch(text: str) -> list[FilePatch]:
    """The files of a patch in order: paths, kind of change, modes, similarity, hunks."""
    out: list[FilePatch] = []
    lines = re.split(r"(?<=\n)", text)
    if lines and not lines[-1]:
        lines.pop()
    now, k = None, 0
    while k < len(lines):
        line = lines[k]
        k += 1
        if line.startswith(("diff --git ", "diff --cc ", "diff --combined ")):
            now = FilePatch()
            out.append(now)
            m = re.match(r'diff --git ("(?:[^"\\]|\\.)*"|a/.*?) ("(?:[^"\\]|\\.)*"|b/.*)\n?$', line)
            if m:
                half = line[11:].rstrip("\n")
                mid = len(half) // 2
                if half[:mid].removeprefix("a/") == half[mid + 1 :].removeprefix("b/"):
                    now.old_path = now.new_path = half[:mid].removeprefix("a/")
                else:
                    now.old_path, now.new_path = _name(m[1], "a/"), _name(m[2], "b/")
        elif line.startswith("--- ") and k < len(lines) and lines[k].startswith("+++ "):
            if now is None or now.hunks:
                now = FilePatch()
                out.append(now)
            old, new = _name(line[4:], "a/"), _name(lines[k][4:], "b/")
            now.old_path, now.new_path = old, new
            now.change = "ADD" if old is None else "DELETE" if new is None else now.change
            k += 1
        elif now is None:
            continue
        elif m := _HUNK.match(line):
            have_old, have_new = int(m[2] or 1), int(m[4] or 1)
            old, new, body = have_old, have_new, [line]
            while k < len(lines) and (old > 0 or new > 0 or lines[k].startswith("\\")):
                c = lines[k][:1]
                if c == "\\":
                    body.append(lines[k])
                    k += 1
                    continue
                if c not in " -+\n":
                    break
                old -= c in " -\n"
                new -= c in " +\n"
                body.append(lines[k])
                k += 1
            now.hunks.append((int(m[1]), have_old, int(m[3]), have_new, "".join(body)))
        elif m := re.match(r"(old|new|deleted file|new file) mode (\d+)", line):
            if m[1] in ("old", "deleted file"):
                now.old_mode = m[2]
            else:
                now.new_mode = m[2]
            now.change = "DELETE" if m[1] == "deleted file" else "ADD" if m[1] == "new file" else now.change
        elif m := re.match(r"(rename|copy) (from|to) (.*)", line):
            now.change = "RENAME" if m[1] == "rename" else "COPY"
            if m[2] == "from":
                now.old_path = _name(m[3], "")
            else:
                now.new_path = _name(m[3], "")
        elif m := re.match(r"(?:dis)?similarity index (\d+)%", line):
            now.score = int(m[1]) if line.startswith("sim") else 100 - int(m[1])
        elif line.startswith(("GIT binary patch", "Binary files ")):
            now.binary = True
    return out


def apply_hunks(lines: list[str], hunks: list[tuple], fuzz: int = 100) -> list[str]:
    """The lines after hunks; each may stand up to fuzz lines from where it says. ValueError if one fits nowhere."""
    out, done, shift = [], 0, 0
    for old_start, old_count, _, _, text in hunks:
        body = re.split(r"(?<=\n)", text)[1:]
        if body and not body[-1]:
            body.pop()
        marked = []
        for line in body:
            if line.startswith("\\"):
                marked[-1] = (marked[-1][0], marked[-1][1].removesuffix("\n"))
            else:
                marked.append((line[:1] if line != "\n" else " ", line[1:] if line != "\n" else "\n"))
        before = [t for c, t in marked if c in " -"]
        want = max(0, old_start - 1 if old_count else old_start) + shift
        tries = [want, *(x for d in range(1, fuzz + 1) for x in (want - d, want + d))]
        same = lambda a, b: a == b or a.rstrip("\r\n") == b.rstrip("\r\n") and (a + b).count("\r") == 1
        at = next((x for x in tries if done <= x <= len(lines) - len(before) and all(same(a, b) for a, b in zip(lines[x : x + len(before)], before))), None)
        if at is None:
            raise ValueError(f"hunk at line {old_start} doesn't apply")
        out += lines[done:at]
        place = at
        for c, t in marked:
            if c == " ":
                out.append(lines[place])
            elif c == "+":
                crlf = before and lines[at].endswith("\r\n") and not t.endswith("\r\n") and t.endswith("\n")
                out.append(t[:-1] + "\r\n" if crlf else t)
            place += c in " -"
        done, shift = place, at - (want - shift)
    return out + lines[done:]


# quoting


_OCTAL = re.compile(r"\\([0-7]{1,3}|.)", re.S)
_QUOTES = {7: "a", 8: "b", 12: "f", 10: "n", 13: "r", 9: "t", 11: "v", 34: '"', 92: "\\"}


def quote(path: str) -> str:
    """A path in C style if it has characters that need it: controls, quotes, backslashes, bytes beyond ASCII in octal."""
    data = path.encode("utf-8", "surrogateescape")
    out = "".join(f"\\{_QUOTES[b]}" if b in _QUOTES else f"\\{b:03o}" if b < 32 or b > 126 else chr(b) for b in data)
    return f'"{out}"' if out != path else path


def dequote(text: str) -> str:
    """What a quoted path stands for; text without quotes is as it is."""
    if len(text) < 2 or text[0] != '"' or text[-1] != '"':
        return text
    back = {v: k for k, v in _QUOTES.items()}
    out, at, body = bytearray(), 0, text[1:-1]
    for m in _OCTAL.finditer(body):
        out += body[at : m.start()].encode()
        out += bytes([int(m[1], 8) & 255]) if m[1][0] in "01234567" else bytes([back[m[1]]]) if m[1] in back else ("\\" + m[1]).encode()
        at = m.end()
    return (bytes(out) + body[at:].encode()).decode("utf-8", "replace")


def bourne(text: str) -> str:
    """A word for a shell."""
    return "'" + text.replace("'", "'\\''").replace("!", "'\\!'") + "'"


def unbourne(text: str) -> str:
    out, at, inside = [], 0, False
    while at < len(text):
        c = text[at]
        if c == "'":
            inside = not inside
        elif c == "\\" and not inside and at + 1 < len(text):
            at += 1
            out.append(text[at])
        else:
            out.append(c)
        at += 1
    return "".join(out)
