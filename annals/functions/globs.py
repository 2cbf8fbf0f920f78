"""Globs as regular expressions, compiled when the plan is made."""

from __future__ import annotations

import re


def glob_regex(glob: str) -> str:
    """``*`` and ``?`` stay within a path part, ``**/`` is any number of parts, ``/**`` all below, ``[...]`` a class; anchored."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif glob[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif glob[i] == "?":
            out, i = out + "[^/]", i + 1
        elif glob[i] == "[" and "]" in glob[i + 2 :]:
            end = glob.index("]", i + 2)
            body = glob[i + 1 : end]
            out, i = out + ("[^" + body[1:] if body[0] in "!^" else "[" + body) + "]", end + 1
        elif glob[i] == "\\" and i + 1 < len(glob):
            out, i = out + re.escape(glob[i + 1]), i + 2
        else:
            out, i = out + re.escape(glob[i]), i + 1
    return f"^{out}$"
