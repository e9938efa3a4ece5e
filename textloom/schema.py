"""Schemas of the relations; files are never read by inference."""

from __future__ import annotations

import re


def nested(ddl: str) -> str:
    """The schema as the type of a field."""
    fields = re.split(r", (?=\w+ )", ddl)
    return "struct<" + ",".join(f.replace(" ", ":", 1) for f in fields) + ">"


PAGE = ("id string, source string, path string, repo string, module string, title string, heading string, doc_type string, section string, priority bigint, content string, mirror_of string")
CANDIDATE = ("source string, path string, title string, doc_type string, section string, selected boolean, context string, rule struct<key:string,text:string>")
RESIDUE = ("id string, source string, path string, reason string, sha256 string, title string, excerpt string, context string, url string, rule struct<key:string,text:string>")
DECISION = ("id string, sha256 string, decision string, reason string, by string, at string")
DUPLICATE = ("kind string, similarity double, canonical string, duplicate string, why string, suggested string, canonical_url string, duplicate_url string")
CHUNK = ("id string, page string, heading string, ordinal int, text string, sha256 string")
DERIVED = ("kind string, page string, text array<string>")
TRAIL = ("version int, at string, query string, retrieved array<string>, ranks array<int>, cited array<string>, outcome string, session string")
USAGE = (
    "never_retrieved array<string>, retrieved_never_cited array<string>, "
    "uncited_queries array<struct<query:string,top_retrieved:string,best_residue:struct<id:string,score:double>>>"
)
PAGE_ENTRY = ("sha256 string, title string, doc_type string, section string, selected_by string, rendered_from string")
MANIFEST_SOURCE = (
    f"repo string, repo_url string, ref string, commit string, archived boolean, resolver string, pages map<string,{nested(PAGE_ENTRY)}>, residue array<string>, "
    "unresolved array<string>, unrendered array<string>, render struct<type:string,command:array<string>,args:array<string>>"
)
MANIFEST = (
    f"version int, artifact_version int, generated_at string, sources map<string,{nested(MANIFEST_SOURCE)}>, "
    "derived map<string,map<string,struct<input_sha256:string,model:string,text:array<string>>>>"
)
META = (
    "artifact_version int, repo string, module string, base_url string, commit string, pages map<string,struct<title:string,doc_type:string,section:string>>, "
    "residue array<string>, unresolved array<string>, unrendered array<string>"
)

#: Versions that this engine reads; additions within one are no new version.
MANIFEST_VERSION, ARTIFACT_VERSION, TRAIL_VERSION = 1, 1, 1


class VersionError(ValueError):
    """A file of a newer version than this engine reads."""


def check_version(what: str, found: int | None, known: int) -> None:
    if found is not None and found > known:
        raise VersionError(f"{what} has version {found}; this engine reads up to {known}")
