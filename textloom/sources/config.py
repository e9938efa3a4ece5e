"""The configuration of a corpus: sources with their resolvers, policy and gates. Unknown keys are errors."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field
from typing import Any

from textloom.functions import globs


class ConfigError(ValueError):
    """A configuration that can't be used."""


# Resolver kinds with their keys (True: required).
RESOLVERS: dict[str, dict[str, bool]] = {
    "glob": {"include": True, "exclude": False, "residue_scope": False, "extensions": False},
    "external": {"command": True, "residue_mention": False, "residue_scope": False, "include": False, "exclude": False, "args": False},
    "vitepress": {"config": False, "scope": False, "include": False, "exclude": False},
    "docusaurus": {"config": False, "scope": False, "include": False, "exclude": False},
    "mdbook": {"summary": False, "scope": False, "include": False, "exclude": False},
    "sitemap": {"sitemap": True, "url_prefix": True, "path_prefix": True, "scope": False, "include": False, "exclude": False},
}
_GLOBS = ("include", "exclude", "residue_scope", "scope")
_SOURCE_NAME = re.compile(r"[A-Za-z0-9_-]+")
_REPO = re.compile(r"https://github\.com/[A-Za-z0-9._-]+/[A-Za-z0-9._-]+?(\.git)?/*")
GATES = ("undecided_residue_max", "removed_pages_max", "expired_decisions_max", "archived_sources_max", "unresolved_links_max", "duplicates_max")


@dataclass(frozen=True)
class Source:
    name: str
    repo: str
    ref: str
    resolver: dict[str, Any]
    priority: int = 1
    render: dict[str, Any] | None = None
    derive: dict[str, Any] | None = None


@dataclass(frozen=True)
class Config:
    sources: list[Source]
    deny: list[str] = field(default_factory=list)
    archived: str = "warn"
    min_pages: int = 0
    gates: dict[str, int | None] = field(default_factory=dict)
    eval: dict[str, Any] | None = None

    def priorities(self, spark):
        return spark.createDataFrame([(s.name, s.priority) for s in self.sources], "source string, priority bigint")


def _only(what: str, given: Any, allowed: set[str]) -> dict[str, Any]:
    if not isinstance(given, dict):
        raise ConfigError(f"{what} must be a mapping")
    if extra := set(given) - allowed:
        raise ConfigError(f"{what}: unknown key {sorted(extra)[0]!r}")
    return given


def _source(raw: Any) -> Source:
    raw = _only("source", raw, {"name", "repo", "ref", "priority", "resolver", "render", "derive"})
    name = raw.get("name", "")
    if not _SOURCE_NAME.fullmatch(str(name)):
        raise ConfigError(f"source name {name!r} may hold letters, digits, _ and - only")
    if not _REPO.fullmatch(str(raw.get("repo", ""))):
        raise ConfigError(f"source {name}: repo {raw.get('repo')!r} is no GitHub address")
    if not str(raw.get("ref", "")).strip():
        raise ConfigError(f"source {name}: ref is empty")
    resolver = dict(raw.get("resolver") or {})
    kind = resolver.get("type")
    if kind not in RESOLVERS:
        raise ConfigError(f"source {name}: unknown resolver {kind!r}")
    keys = RESOLVERS[kind]
    _only(f"source {name}: resolver", resolver, {"type", *keys})
    for key, needed in keys.items():
        value = resolver.get(key)
        if needed and (not value or isinstance(value, str) and not value.strip() or key == "command" and not str(value[0]).strip()):
            raise ConfigError(f"source {name}: resolver.{key} is needed")
    for key in _GLOBS:
        for pattern in resolver.get(key) or []:
            try:
                globs.to_regex(pattern)
            except globs.GlobError as bad:
                raise ConfigError(f"source {name}: resolver.{key}: {bad}") from bad
    if mention := resolver.get("residue_mention"):
        try:
            re.compile(mention)
        except re.error as bad:
            raise ConfigError(f"source {name}: resolver.residue_mention: {bad}") from bad
    render = raw.get("render")
    if render and render.get("type") == "external" and not (render.get("command") and str(render["command"][0]).strip()):
        raise ConfigError(f"source {name}: render.command is needed")
    questions = (raw.get("derive") or {}).get("questions")
    if questions is not None:
        if not 1 <= int(questions.get("n", 5)) <= 20:
            raise ConfigError(f"source {name}: derive.questions.n must be 1 to 20")
        if "prompt" in questions and not str(questions["prompt"]).strip():
            raise ConfigError(f"source {name}: derive.questions.prompt is blank")
    return Source(name, raw["repo"], str(raw["ref"]), resolver, int(raw.get("priority", 1)), render, raw.get("derive"))


def parse(text: str) -> Config:
    try:
        import yaml
    except ImportError as missing:
        raise ConfigError("reading YAML needs the yaml package; build a Config directly, or call from_dict") from missing
    return from_dict(yaml.safe_load(text))


def from_dict(raw: Any) -> Config:
    raw = _only("configuration", raw, {"version", "sources", "policy", "gates", "eval"})
    sources = [_source(s) for s in raw.get("sources") or []]
    names = [s.name for s in sources]
    if not names:
        raise ConfigError("no sources")
    if len(set(names)) < len(names):
        raise ConfigError("two sources share a name")
    policy = _only("policy", raw.get("policy") or {}, {"deny", "archived", "min_pages_per_source"})
    if policy.get("archived", "warn") not in ("warn", "drop"):
        raise ConfigError("policy.archived must be warn or drop")
    for pattern in policy.get("deny") or []:
        globs.to_regex(pattern)
    gates = _only("gates", raw.get("gates") or {}, set(GATES))
    return Config(sources, list(policy.get("deny") or []), policy.get("archived", "warn"), int(policy.get("min_pages_per_source", 0)), gates, raw.get("eval"))


def unique_names(names: list[str], taken: list[str] = ()) -> list[str]:
    """Names in order, each clash with a name before it as name-2, name-3 and so on."""
    used, out = set(taken), []
    for name in names:
        candidate, n = name, 1
        while candidate in used:
            n += 1
            candidate = f"{name}-{n}"
        used.add(candidate)
        out.append(candidate)
    return out


def absolutise(base: str, argument: str) -> str:
    """The absolute path of an argument that has a separator and names something below base; others as they are."""
    below = os.path.join(base, argument)
    relative = not os.path.isabs(argument) and ("/" in argument or "\\" in argument)
    return os.path.abspath(below) if relative and os.path.exists(below) else argument
