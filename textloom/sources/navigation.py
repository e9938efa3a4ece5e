"""Navigation files of documentation sites as flat rows: path, title, section, selected or autogenerated folder.

Files are small and few; each is parsed whole by one call of a Python table function (see `rows`), which is how a
grammar that nests without bound comes into a relation."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(r"""\s+|//[^\n]*|/\*.*?\*/|(?P<str>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|`(?:[^`\\]|\\.)*`)|(?P<punct>[\[\]{},:])|(?P<word>[A-Za-z_$][\w$]*)|(?P<other>[^\s\[\]{},:"'`]+)""", re.S)
_ESCAPE = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "0": "\0"}


def _string(raw: str) -> str:
    return re.sub(r"\\(?:u\{([0-9a-fA-F]+)\}|u([0-9a-fA-F]{4})|x([0-9a-fA-F]{2})|(.))", lambda m: chr(int(m[1] or m[2] or m[3], 16)) if m[1] or m[2] or m[3] else _ESCAPE.get(m[4], m[4]), raw[1:-1], flags=re.S)


def js_value(text: str):
    """The first object or array literal of a script, as dicts, lists and strings; what is no literal is None.

    Comments, trailing commas and bare keys are fine, and text that ends early gives what there was."""
    tokens = [(m.lastgroup, m[0]) for m in _TOKEN.finditer(text) if m.lastgroup]
    start = next((i for i, (kind, t) in enumerate(tokens) if kind == "punct" and t in "[{"), None)
    if start is None:
        return None
    stack: list = []
    key: str | None = None
    root = None
    i = start
    while i < len(tokens):
        kind, t = tokens[i]
        value, made = None, False
        if kind == "punct" and t in "[{":
            value, made = ([] if t == "[" else {}), True
        elif kind == "punct" and t in "]}":
            if stack:
                stack.pop()
            if not stack:
                break
        elif kind == "punct":
            pass
        elif stack and isinstance(stack[-1][0], dict) and key is None and i + 1 < len(tokens) and tokens[i + 1][1] == ":":
            key = _string(t) if kind == "str" else t
            i += 1
        else:
            value, made = (_string(t) if kind == "str" else None), True
        if made:
            if not stack:
                root = value
            elif isinstance(stack[-1][0], list):
                stack[-1][0].append(value)
            elif key is not None:
                stack[-1][0][key] = value
                key = None
            if kind == "punct":
                stack.append((value,))
        i += 1
    return root


def sidebar_links(value, above: str = "") -> Iterator[tuple[str, str, str]]:
    """(link, title, section) of a nested sidebar; sections are the titles above, joined by ` > `."""
    if isinstance(value, list):
        for item in value:
            yield from sidebar_links(item, above)
    elif isinstance(value, dict):
        title = value.get("text") or value.get("label") or ""
        if isinstance(value.get("link"), str):
            yield value["link"], title, above
        if isinstance(value.get("items"), (list, dict)):
            yield from sidebar_links(value["items"], " > ".join(x for x in (above, title) if x))
        elif "text" not in value and "link" not in value:
            for inner in value.values():
                if isinstance(inner, (list, dict)):
                    yield from sidebar_links(inner, above)


def doc_ids(value, above: str = "") -> Iterator[tuple[str, str, str, bool]]:
    """(id or folder, title, section, whether it stands for a whole folder) of a docs sidebar."""
    if isinstance(value, str):
        yield value, "", above, False
    elif isinstance(value, list):
        for item in value:
            yield from doc_ids(item, above)
    elif isinstance(value, dict):
        kind, label = value.get("type"), value.get("label") or ""
        if kind in ("doc", "ref") and value.get("id"):
            yield value["id"], label, above, False
        elif kind == "autogenerated" and value.get("dirName"):
            yield value["dirName"], label, above, True
        elif kind == "category" or "items" in value:
            inner = " > ".join(x for x in (above, label) if x)
            if isinstance(value.get("link"), dict) and value["link"].get("id"):
                yield value["link"]["id"], label, inner, False
            yield from doc_ids(value.get("items") or [], inner)
        elif kind is None:
            for items in value.values():
                yield from doc_ids(items, above)


def summary_links(text: str) -> Iterator[tuple[str, str, str]]:
    """(link, title, section) of a book's summary: `# X` begins a section, the first heading Summary none; fences and
    drafts without a target are passed over."""
    section, fenced, first = "", False, True
    for line in text.split("\n"):
        if line.strip().startswith(("```", "~~~")):
            fenced = not fenced
        elif not fenced and line.startswith("# "):
            section = line[2:].strip()
            if first and section.lower() == "summary":
                section = ""
            first = False
        elif not fenced:
            for title, link in re.findall(r"\[([^\]]*)\]\(([^)]*)\)", line):
                if link.strip():
                    yield link.strip(), title.strip(), section


def sitemap_locations(text: str) -> list[str]:
    """Addresses of an XML sitemap, or the lines of a plain list."""
    if re.search("<loc", text, re.I):
        return [x.strip() for x in re.findall(r"<loc[^>]*>(.*?)</loc>", text, re.I | re.S)]
    return [line.strip() for line in text.split("\n") if line.strip() and not line.strip().startswith("#")]


def sitemap_paths(location: str, url_prefix: str, path_prefix: str) -> list[str]:
    """Files that an address may stand for, in order; none for addresses elsewhere."""
    if not location.startswith(url_prefix):
        return []
    rest = re.split("[?#]", location[len(url_prefix) :])[0].lstrip("/")
    base = path_prefix.rstrip("/") + "/" if path_prefix.rstrip("/") not in ("", ".") else ""
    if rest == "" or rest.endswith("/"):
        return [f"{base}{rest}README.md", f"{base}{rest}index.md"]
    if rest.endswith(".html"):
        return [f"{base}{rest[:-5]}.md"]
    return [f"{base}{rest}"] if rest.endswith((".md", ".mdx")) else [f"{base}{rest}.md", f"{base}{rest}/README.md", f"{base}{rest}/index.md"]


def default_scope(folder: str, custom: list[str] = ()) -> list[str]:
    """Patterns of files that may be residue: Markdown below the navigation file's folder, unless others are given."""
    return list(custom) or [f"{folder}/**/*.md" if folder else "**/*.md"]


_SCHEMA = "source string, base string, link string, title string, section string, folder boolean"


def parse(kind: str, text: str) -> list[tuple[str, str, str, bool]]:
    if kind == "vitepress":
        at = re.search(r"\bsidebar\s*:", text)
        return [(*row, False) for row in sidebar_links(js_value(text[at.end() :] if at else text))]
    if kind == "docusaurus":
        return list(doc_ids(js_value(text)))
    if kind == "mdbook":
        return [(*row, False) for row in summary_links(text)]
    if kind == "sitemap":
        return [(loc, "", "", False) for loc in sitemap_locations(text)]
    raise ValueError(f"unknown kind of navigation: {kind}")


def rows(files: DataFrame, kind: str) -> DataFrame:
    """Flat navigation rows of files (source, base, text)."""

    def run(batches):
        for batch in batches:
            out = []
            for source, base, text in zip(batch["source"], batch["base"], batch["text"], strict=True):
                out += [(source, base, *row) for row in parse(kind, text or "")]
            import pandas as pd

            yield pd.DataFrame(out, columns=["source", "base", "link", "title", "section", "folder"])

    return files.select("source", "base", "text").mapInPandas(run, _SCHEMA)


def detect_layout(paths: DataFrame) -> DataFrame:
    """source, layout: vitepress before docusaurus before mdbook, else glob. paths: source, path."""
    path = F.col("path")
    rank = F.when(path.rlike(r"(?:^|/)\.vitepress/config\.(?:m?[jt]s)$"), 3).when(path.rlike(r"(?:^|/)sidebars\.[jt]s$"), 2).when(path.rlike(r"(?:^|/)SUMMARY\.md$"), 1).otherwise(0)
    best = paths.groupBy("source").agg(F.max(rank).alias("r"))
    return best.select("source", F.element_at(F.array(F.lit("glob"), F.lit("mdbook"), F.lit("docusaurus"), F.lit("vitepress")), F.col("r") + 1).alias("layout"))
