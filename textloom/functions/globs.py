"""Globs compiled to regular expressions that Spark and other engines read alike.

* and ? cross folder borders; ** stands for whole folders beside slashes; {a,b} and [..], [!..] as usual."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


class GlobError(ValueError):
    """A pattern that doesn't compile."""


def to_regex(pattern: str) -> str:
    """An anchored regular expression for one glob."""
    out, at, depth = [], 0, 0
    while at < len(pattern):
        char = pattern[at]
        at += 1
        if char == "*":
            run = re.match(r"\*+", pattern[at - 1 :])[0]
            before, after = pattern[at - 2 : at - 1] if at >= 2 else "", pattern[at - 1 + len(run) : at + len(run)]
            at += len(run) - 1
            if len(run) == 2 and before in ("", "/") and after in ("", "/"):
                if after == "/":
                    out.append("(?:.*/)?")
                    at += 1
                else:
                    out.append(".*")
            else:
                out.append(".*")
        elif char == "?":
            out.append(".")
        elif char == "[":
            end = pattern.find("]", at + (pattern[at : at + 1] in ("!", "^")) + 1)
            if end < 0:
                raise GlobError(f"unclosed [ in {pattern!r}")
            inside = pattern[at:end]
            negated = inside[:1] in ("!", "^")
            body = inside[1:] if negated else inside
            out.append("[" + "^" * negated + "".join("\\" + c if c in "\\[]^&~|" else c for c in body) + "]")
            at = end + 1
        elif char == "{":
            depth += 1
            out.append("(?:")
        elif char == "}" and depth:
            depth -= 1
            out.append(")")
        elif char == "," and depth:
            out.append("|")
        elif char == "\\":
            if at == len(pattern):
                raise GlobError(f"nothing escaped at the end of {pattern!r}")
            out.append(re.escape(pattern[at]))
            at += 1
        else:
            out.append(re.escape(char) if not char.isalnum() else char)
    if depth:
        raise GlobError(f"unclosed {{ in {pattern!r}")
    return "(?s)^" + "".join(out).replace("\\/", "/") + "$"


def set_regex(patterns: list[str]) -> str | None:
    return "|".join(f"(?:{to_regex(p)})" for p in patterns) if patterns else None


def matches(path: Column, patterns: list[str]) -> Column:
    """Whether any pattern matches; with none, nothing does."""
    found = set_regex(patterns)
    return path.rlike(found) if found else F.lit(False)


def first_match(path: Column, patterns: list[str]) -> Column:
    """The first pattern, in list order, that matches; null without one."""
    return F.coalesce(*(F.when(path.rlike(to_regex(p)), F.lit(p)) for p in patterns), F.lit(None).cast("string"))


def has_extension(path: Column, extensions: list[str]) -> Column:
    """Case-insensitive; an empty list takes every file."""
    if not extensions:
        return F.lit(True)
    tests = (F.lower(path).endswith("." + e.lower().lstrip(".")) for e in extensions)
    return reduce(lambda a, b: a | b, tests)
