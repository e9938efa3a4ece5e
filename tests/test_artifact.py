"""The artifact folder written, read, held against its manifest and made again."""

import hashlib
import json

import pytest
from textloom import schema
from textloom.plans import verify
from textloom.sources import artifact, config, files, navigation

TEXTS = {"docs/a.md": "# A\n\nfirst", "docs/_b.md": "---\ntitle: B\n---\nsecond", "docs/c.md": "# C\n\nleft out", "docs/d.md": "none"}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def given(spark, tmp_path, **changes):
    entry = {"title": "T", "doc_type": "", "section": "S", "selected_by": "resolver"}
    source = {
        "repo": "o/r", "repo_url": "https://github.com/o/r", "ref": "main", "commit": "c1", "archived": False, "resolver": "glob",
        "pages": {p: {**entry, "sha256": sha(TEXTS[p])} for p in ("docs/a.md", "docs/_b.md")}, "residue": ["docs/c.md"], "unresolved": ["docs/gone.md"], "unrendered": [],
    }
    derived = {p: {"questions": {"input_sha256": "0", "model": "m", "text": ["q?", "r?"]}} for p in ("s::docs/a.md", "s::docs/other.md")}
    whole = {"version": 1, "artifact_version": 1, "generated_at": "now", "sources": {"s": source}, "derived": derived} | changes
    path = tmp_path / f"given{len(changes)}.json"
    path.write_text(json.dumps(whole))
    return files.manifest(spark, str(path))


def checkout(spark, **changes):
    return spark.createDataFrame([("s", p, bytearray(t.encode())) for p, t in (TEXTS | changes).items()], "source string, path string, content binary")


def problems(manifest, folder):
    return {tuple(r) for r in artifact.check(manifest, folder).collect()}


def test_written_checked_and_made_again(spark, tmp_path):
    folder, manifest = tmp_path / "out", given(spark, tmp_path)
    artifact.write(manifest, checkout(spark), str(folder))
    assert {str(p.relative_to(folder)) for p in folder.rglob("*") if p.is_file() and "derived.jsonl/" not in str(p) and not p.name.endswith(".crc")} == {
        "manifest.json", "s/meta.json", "s/docs/a.md", "s/docs/_b.md", "_residue/s/docs/c.md",
    }
    assert (folder / "s/docs/_b.md").read_text() == TEXTS["docs/_b.md"]
    meta = json.loads((folder / "s/meta.json").read_text())
    assert meta["base_url"] == "https://github.com/o/r/blob/c1" and meta["pages"]["docs/a.md"] == {"title": "T", "doc_type": "", "section": "S"} and meta["unresolved"] == ["docs/gone.md"]
    assert [tuple(r) for r in files.derived_questions(spark, f"{folder}/derived.jsonl").collect()] == [("s::docs/a.md", "q?\nr?")]
    assert problems(manifest, str(folder)) == set()
    artifact.write(manifest, checkout(spark), f"file://{folder}")
    assert problems(manifest, f"file://{folder}") == set()
    (folder / "s/docs/a.md").write_text("other")
    (folder / "s/docs/_b.md").unlink()
    (folder / "s/meta.json").write_text("{}")
    (folder / "s/docs/extra.md").write_text("not named")
    assert problems(manifest, str(folder)) == {("s::docs/a.md", "differs"), ("s::docs/_b.md", "missing"), ("s/meta.json", "meta.json differs")}
    without = given(spark, tmp_path, derived={})
    assert {p for _, p in problems(without, str(folder))} == {"differs", "missing", "meta.json differs", "manifest differs", "derived.jsonl differs"}
    artifact.write_derived(without, str(folder))
    assert not (folder / "derived.jsonl").exists()


def test_refusals(spark, tmp_path):
    folder, manifest = tmp_path / "out", given(spark, tmp_path)
    folder.mkdir()
    (folder / "mine.txt").write_text("keep")
    with pytest.raises(artifact.ArtifactError, match="isn't cleared"):
        artifact.write(manifest, checkout(spark), str(folder))
    assert (folder / "mine.txt").read_text() == "keep"
    for changed, said in (({"docs/a.md": "edited"}, "s::docs/a.md: has"), ({"docs/a.md": ""}, "s::docs/a.md: has")):
        with pytest.raises(artifact.ArtifactError, match=said):
            artifact.write(manifest, checkout(spark, **changed), str(tmp_path / "none"))
    with pytest.raises(artifact.ArtifactError, match="missing from the checkout"):
        artifact.write(manifest, checkout(spark).where("path <> 'docs/_b.md'"), str(tmp_path / "none"))
    assert not (tmp_path / "none").exists()
    with pytest.raises(artifact.ArtifactError, match="leaves the artifact"):
        artifact._inside("/x", "s/../../y")


def test_residue_and_reproduction(spark, tmp_path):
    folder, manifest = str(tmp_path / "out"), given(spark, tmp_path)
    commits = spark.createDataFrame([("s", "c1")], "source string, commit string")
    _, residue = verify.reproduce(manifest, checkout(spark), commits, folder)
    got = {r.id: (r.reason, r.title, r.excerpt, r.sha256, r.url, r.rule.key) for r in residue.collect()}
    assert got == {
        "s::docs/c.md": ("not_selected", "C", "# C left out", sha(TEXTS["docs/c.md"]), "https://github.com/o/r/blob/c1/docs/c.md", "reproduced:from-manifest"),
        "s::docs/gone.md": ("unresolved_link", "", "", "", "https://github.com/o/r/blob/c1/docs/gone.md", "reproduced:from-manifest"),
    }
    assert residue.columns == [f.split()[0] for f in schema.RESIDUE.split("rule ")[0].rstrip(", ").split(", ")] + ["rule"]
    assert problems(manifest, folder) == set()
    ids = spark.createDataFrame([("s::docs/c.md",), ("s::docs/c.md",)], "id string")
    assert [(r.id, r.title, r.repo, r.content) for r in artifact.residue_pages(ids, folder).collect()] == [("s::docs/c.md", "C", "o/r", "# C\n\nleft out")]
    for wrong, said in (("s::docs/no.md", "missing from the residue"), ("nothing", "no id")):
        with pytest.raises(Exception, match=said):
            artifact.residue_pages(spark.createDataFrame([(wrong,)], "id string"), folder).collect()
    with pytest.raises(artifact.ArtifactError, match="recorded is commit c1, fetched c2"):
        verify.reproduce(manifest, checkout(spark), spark.createDataFrame([("s", "c2")], "source string, commit string"), folder)
    with pytest.raises(Exception, match="docs/c.md is missing from the checkout"):
        verify.recorded_residue(manifest, checkout(spark).where("path <> 'docs/c.md'")).collect()


def test_names(tmp_path):
    assert config.unique_names(["a", "a", "b", "a", "a-2"], taken=["b"]) == ["a", "a-2", "b-2", "a-3", "a-2-2"]
    (tmp_path / "bin").mkdir()
    (tmp_path / "bin/x").write_text("")
    (tmp_path / "y").write_text("")
    base = str(tmp_path)
    assert [config.absolutise(base, a) for a in ("bin/x", "y", "bin/no", "/bin/x")] == [f"{base}/bin/x", "y", "bin/no", "/bin/x"]
    assert navigation.default_scope("docs") == ["docs/**/*.md"] and navigation.default_scope("") == ["**/*.md"] and navigation.default_scope("docs", ["x"]) == ["x"]
