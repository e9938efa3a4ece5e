"""Text functions as Column expressions; none of them leaves the JVM.

Every function takes and returns Columns. A null argument gives a null result unless the function says otherwise.
Regular expressions that other engines read with Unicode classes and whole-text anchors are written with (?U) and \\z.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The tokeniser's stopwords.
STOPWORDS = [
    "a", "an", "and", "are", "as", "at", "be", "by", "can", "do", "does", "for", "from", "how",
    "i", "if", "in", "is", "it", "its", "my", "of", "on", "or", "that", "the", "this", "to", "was",
    "what", "when", "which", "with", "you", "your",
]

# Words of a section title and the kind of page they stand for, in order of precedence.
DOC_TYPES = [
    ("troubleshooting", ["troubleshoot", "faq", "known issue", "debugging"]),
    ("release-notes", ["release", "changelog", "change log", "what's new", "whats new"]),
    ("tutorial", ["tutorial", "getting started", "quickstart", "quick start", "how to", "howto", "guide"]),
    ("reference", ["reference", "api", "cli", "configuration", "schema", "specification"]),
]
DEFAULT_DOC_TYPE = "concept"

EXCERPT_STORED, EXCERPT_SHOWN = 600, 60


def nonempty(text: Column) -> Column:
    """The text, or null where it is empty."""
    return F.when(text != "", text)


def trim_unicode(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")


def sha256_hex(content: Column) -> Column:
    return F.sha2(content, 256)


def lines(text: Column) -> Column:
    """Lines without their ends; a last line feed begins no line."""
    parts = F.split(text, "\r?\n")
    return F.when(F.get(parts, F.size(parts) - 1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def _front_matter(text: Column) -> Column:
    """The block between the first line --- and the next line that is --- up to white space; null without one.

    The expression needs no look-around: the block's lines are lazy up to the closing one."""
    return F.regexp_extract(text, r"(?Us)\A---\r?\n((?:.*?\r?\n)??)---[^\S\n]*(?:\r?\n|\z)", 1)


def has_front_matter(text: Column) -> Column:
    return text.rlike(r"(?Us)\A---\r?\n(?:.*?\r?\n)??---[^\S\n]*(?:\r?\n|\z)")


def strip_front_matter(text: Column) -> Column:
    """The text behind a front matter block; as it is when the block isn't closed."""
    return F.regexp_replace(text, r"(?Us)\A---\r?\n(?:.*?\r?\n)??---[^\S\n]*(?:\r?\n|\z)", "")


def front_matter_title(text: Column) -> Column:
    """The first title: of the block that isn't blank, without one pair of quotes; null without one."""
    found = F.regexp_extract_all(_front_matter(text), F.lit(r"(?m)^title:([^\n]*)$"), F.lit(1))
    plain = F.transform(found, lambda t: trim_unicode(F.regexp_replace(trim_unicode(t), r"""(?s)\A(["'])(.*)\1\z""", "$2")))
    return F.get(F.filter(plain, lambda t: t != ""), F.lit(0))


def first_h1(text: Column) -> Column:
    """The first `# ` heading outside front matter and fences (of back-ticks or tildes); null without one.

    Fences are folded over the lines: a line that begins with three of either turns the state."""
    state = F.struct(F.lit(False).alias("fenced"), F.lit(None).cast("string").alias("found"))

    def step(acc: Column, line: Column) -> Column:
        left = F.regexp_replace(line, r"(?U)^\s+", "")
        fence = left.startswith("```") | left.startswith("~~~")
        title = trim_unicode(F.regexp_replace(trim_unicode(F.substring(left, 3, 1 << 30)), "#+$", ""))
        here = ~acc["fenced"] & ~fence & left.startswith("# ") & (title != "")
        return F.struct((acc["fenced"] != fence).alias("fenced"), F.coalesce(acc["found"], F.when(here, title)).alias("found"))

    return F.aggregate(lines(strip_front_matter(text)), state, step, lambda acc: acc["found"])


def title_of(nav_title: Column, text: Column) -> Column:
    """Navigation title, else first heading, else front matter title, else empty."""
    return F.coalesce(nonempty(trim_unicode(nav_title)), first_h1(text), front_matter_title(text), F.lit(""))


def clean_content(text: Column) -> Column:
    """Without front matter and comments, and without line feeds at either end."""
    return F.regexp_replace(F.regexp_replace(strip_front_matter(text), "(?s)<!--.*?-->", ""), r"^\n+|\n+\z", "")


def index_text(text: Column) -> Column:
    """What is indexed: images and links as their labels, a tag as one space."""
    text = F.regexp_replace(text, r"!\[([^\]]*)\]\([^)]*\)", "$1")
    text = F.regexp_replace(text, r"\[([^\]]*)\]\([^)]*\)", "$1")
    return F.regexp_replace(text, "</?[a-zA-Z][^>]*>", " ")


def is_stopword(token: Column) -> Column:
    return token.isin(STOPWORDS)


def plain_tokens(text: Column) -> Column:
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)), lambda t: ~is_stopword(t))


def compound_tokens(text: Column) -> Column:
    """Identifiers such as spec.sink-type, lower case and without their separators."""
    runs = F.regexp_extract_all(text, F.lit("[A-Za-z0-9./_-]+"), F.lit(0))
    trimmed = F.transform(runs, lambda r: F.regexp_replace(r, "^[./_-]+|[./_-]+$", ""))
    return F.transform(F.filter(trimmed, lambda r: r.rlike("[./_-]")), lambda r: F.lower(F.regexp_replace(r, "[./_-]", "")))


def tokens(text: Column) -> Column:
    """Plain tokens in order, then all compounds; repeats stay."""
    return F.concat(plain_tokens(text), compound_tokens(text))


def title_key(text: Column) -> Column:
    return F.array_join(tokens(text), " ")


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def excerpt(text: Column, n: int = EXCERPT_STORED) -> Column:
    return F.array_join(F.slice(words(text), 1, n), " ")


def shown_excerpt(text: Column, n: int = EXCERPT_SHOWN) -> Column:
    return F.concat(excerpt(text, n), F.when(F.size(words(text)) > n, "…").otherwise(""))


def page_id(source: Column, path: Column) -> Column:
    return F.concat(source, F.lit("::"), path)


def split_page_id(identity: Column) -> Column:
    """struct(source, path), cut at the first `::`; null unless both halves have text."""
    at = F.instr(identity, "::")
    halves = F.struct(F.substring(identity, F.lit(1), at - 1).alias("source"), F.substring(identity, at + 2, F.length(identity)).alias("path"))
    return F.when((at > 1) & (F.length(identity) > at + 1), halves)


def chunk_id(page: Column, ordinal: Column) -> Column:
    return F.concat(page, F.lit("#"), ordinal.cast("string"))


def repo_slug(url: Column) -> Column:
    """owner/name of a https://github.com address, with or without .git and slashes behind it; null for others."""
    slug = F.regexp_extract(url, r"\Ahttps://github\.com/([A-Za-z0-9._-]+/[A-Za-z0-9._-]+?)(?:\.git)?/*\z", 1)
    return F.when((slug != "") & ~slug.rlike(r"(?:\A|/)\.{1,2}(?:/|\z)"), slug)


def blob_url(slug: Column, commit: Column, path: Column) -> Column:
    return F.when(slug.isNull(), "").otherwise(F.concat(F.lit("https://github.com/"), slug, F.lit("/blob/"), commit, F.lit("/"), path))


def compare_url(slug: Column, old: Column, new: Column) -> Column:
    """Null unless both commits are known and differ."""
    url = F.concat(F.lit("https://github.com/"), slug, F.lit("/compare/"), old, F.lit("..."), new)
    return F.when(slug.isNotNull() & (old != "") & (new != "") & (old != new), url)


def short_commit(commit: Column) -> Column:
    return F.substring(commit, 1, 12)


def doc_type_of_section(section: Column) -> Column:
    lower = F.lower(F.coalesce(section, F.lit("")))
    out = None
    for kind, vocabulary in DOC_TYPES:
        here = lower.rlike("|".join(vocabulary))
        out = F.when(here, kind) if out is None else out.when(here, kind)
    return out.otherwise(DEFAULT_DOC_TYPE)


def is_markdown(path: Column) -> Column:
    return path.rlike(r"(?i)[^/]\.mdx?\z")


def join_path(base: Column, relative: Column) -> Column:
    """Relative to base, . and .. collapsed, never above the root."""

    def step(acc: Column, part: Column) -> Column:
        up = F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
        return F.when(part.isin("", "."), acc).when(part == "..", up).otherwise(F.concat(acc, F.array(part)))

    start = F.filter(F.split(base, "/"), lambda part: part != "")
    return F.array_join(F.aggregate(F.split(relative, "/"), start, step), "/")


def collapse(text: Column) -> Column:
    return F.array_join(words(text), " ")


def escape_cell(text: Column) -> Column:
    return F.regexp_replace(text, r"\|", r"\\|")


def source_name(repo: Column) -> Column:
    """Letters, digits, _ and - stay; every other character becomes a hyphen."""
    return F.regexp_replace(repo, "[^A-Za-z0-9_-]", "-")


def page_order(source: Column, path: Column) -> list[Column]:
    """Sort keys of the walk order: names of a folder are compared one level at a time."""
    return [source, F.split(path, "/")]
