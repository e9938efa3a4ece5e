"""Reference pages from resource definitions and API descriptions.

A schema nests without bound, so a document is turned into rows by a Python table function, one call a file. Rows of
fields come from a stack of (path, schema, required); an entry is either expanded or emitted."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame

PAGE = "source string, from_path string, path string, title string, doc_type string, section string, content string"
# Columns of the tables.
FIELD_COLUMNS, STATUS_COLUMNS, CONDITION_COLUMNS = ("Field", "Type", "Required", "Values", "Description"), ("Field", "Type", "Values", "Description"), ("Type", "Description")
NOT_FIELDS = {"status", "metadata", "apiVersion", "kind"}


@dataclass(frozen=True)
class Field:
    path: str
    kind: str
    required: bool
    schema: dict

    def cells(self, with_required: bool) -> list[str]:
        members = ", ".join(f"`{v}`" for v in self.schema.get("enum") or [] if isinstance(v, str))
        open_ended = "preserves unknown fields" if self.schema.get("x-kubernetes-preserve-unknown-fields") is True else ""
        out = [f"`{self.path}`", self.kind, "yes" if self.required else "no", "; ".join(x for x in (members, open_ended) if x), described(self.schema)]
        return out if with_required else out[:2] + out[3:]


def described(schema) -> str:
    text = schema.get("description") if isinstance(schema, dict) else None
    return " ".join(text.split()) if isinstance(text, str) else ""


def kind_of(schema: dict) -> str:
    """The declared type, or the one that the other keys imply."""
    if isinstance(schema.get("type"), str):
        return schema["type"]
    return "object" if {"properties", "additionalProperties"} & schema.keys() else "array" if "items" in schema else ""


def _members(path: str, schema: dict) -> list[tuple[str, dict, bool]]:
    """Named properties, in alphabetical order."""
    needed = {x for x in schema.get("required") or [] if isinstance(x, str)}
    properties = schema.get("properties")
    return [(f"{path}.{name}" if path else name, sub if isinstance(sub, dict) else {}, name in needed) for name, sub in sorted(properties.items())] if isinstance(properties, dict) else []


def fields(entries: list[tuple[str, dict, bool]]) -> Iterator[Field]:
    """The leaves below some entries: [] stands for items, .* for free keys."""
    stack = entries[::-1]
    while stack:
        path, schema, required = stack.pop()
        kind = kind_of(schema)
        if kind == "object" and (inner := _members(path, schema)):
            stack += inner[::-1]
        elif kind == "object" and isinstance(schema.get("additionalProperties"), dict):
            stack.append((f"{path}.*", schema["additionalProperties"], False))
        elif kind == "array" and isinstance(schema.get("items"), dict):
            stack.append((f"{path}[]", schema["items"], required))
        elif kind == "array":
            yield Field(f"{path}[]", "", required, schema)
        else:
            yield Field(path, kind, required, schema)


def table(columns: tuple[str, ...], rows: list[list[str]]) -> str:
    lines = ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    lines += ["| " + " | ".join(c.replace("|", "\\|") for c in row) + " |" for row in rows]
    return "\n".join(lines) + "\n"


def definition_pages(doc: dict) -> Iterator[tuple[str, str, str, str]]:
    """(path, title, section, content) of each served version of a resource definition, the stored one first."""
    spec = doc.get("spec")
    if not isinstance(spec, dict) or not isinstance(spec.get("versions"), list):
        raise ValueError("a resource definition needs spec.versions")
    names, group = spec.get("names") or {}, spec.get("group") or ""
    kind = names.get("kind") or ""
    served = [v for v in spec["versions"] if v.get("served") is True]
    stored = next((v for v in served if v.get("storage") is True), None)
    for version in sorted(served, key=lambda v: v is not stored):
        schema = (version.get("schema") or {}).get("openAPIV3Schema") or {}
        members = _members("", schema)
        status = next((sub for name, sub, _ in members if name == "status"), {})
        conditions = (((status.get("properties") or {}).get("conditions") or {}).get("items") or {}).get("properties", {}).get("type") or {}
        title = f"{kind} ({group}/{version.get('name', '')})"
        facts = f"Scope: {spec.get('scope', '')} · Plural: {names.get('plural', '')} · Short names: {', '.join(names.get('shortNames') or [])} · Served: yes · Storage: {'yes' if version.get('storage') is True else 'no'}"
        parts = [f"# {title}\n", described(schema) + "\n", facts + "\n", "## Fields\n", table(FIELD_COLUMNS, [f.cells(True) for f in fields([m for m in members if m[0] not in NOT_FIELDS])])]
        below = [m for m in _members("", status) if m[0] != "conditions"]
        if rows := [f.cells(False) for f in fields(below)]:
            parts += ["## Status\n", table(STATUS_COLUMNS, rows)]
        if rows := [[f"`{v}`", described(conditions)] for v in conditions.get("enum") or [] if isinstance(v, str)]:
            parts += ["## Conditions\n", table(CONDITION_COLUMNS, rows)]
        yield f"reference/{group}/{kind.lower()}-{version.get('name', '')}.md", title, group, "\n".join(parts)


def description_pages(doc: dict) -> Iterator[tuple[str, str, str, str]]:
    """A page for each schema of an API description."""
    for name, schema in sorted(((doc.get("components") or {}).get("schemas") or {}).items()):
        top = [(name_, sub, needed) for name_, sub, needed in _members("", schema)] or [("", schema | {"type": "object"}, False)]
        yield f"reference/{name.lower()}.md", name, "", f"# {name}\n\n{described(schema)}\n\n## Fields\n\n" + table(FIELD_COLUMNS, [f.cells(True) for f in fields(top)])


def pages_of(text: str) -> Iterator[tuple[str, str, str, str]]:
    """Pages of every document of a YAML file; documents of other kinds give none."""
    import yaml

    for doc in yaml.safe_load_all(text):
        if isinstance(doc, dict) and doc.get("kind") == "CustomResourceDefinition":
            yield from definition_pages(doc)
        elif isinstance(doc, dict) and str(doc.get("openapi", "")).startswith("3"):
            yield from description_pages(doc)


def render(files: DataFrame) -> DataFrame:
    """Generated pages of files (source, path, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(source, at, path, title, "reference", section, content) for source, at, text in zip(batch["source"], batch["path"], batch["text"], strict=True) for path, title, section, content in pages_of(text or "")]
            yield pd.DataFrame(out, columns=[f.split(" ")[0] for f in PAGE.split(", ")])

    return files.select("source", "path", "text").mapInPandas(run, PAGE)


def unrendered(files: DataFrame, generated: DataFrame) -> DataFrame:
    """Files that gave no page."""
    made = generated.select("source", generated.from_path.alias("path")).distinct()
    return files.select("source", "path").join(made, ["source", "path"], "left_anti")
