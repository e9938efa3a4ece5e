"""Operators on small relations, and the catalogue against its SQL."""

import hashlib
import json
import math
import re

import duckdb
import pytest
from pathlib import Path

from textloom.operators import assist, duplicates, ledgers, report, retrieval, sections, selection, snapshots, usage
from textloom.plans import adapters as A
from textloom.plans import catalogue
from textloom.sources import config, files, navigation, tarballs

DATA = "/root/testdata/sf0.001"
PAGE = "id string, source string, path string, module string, title string, heading string, priority long, content string"


def pages(spark, *rows):
    return spark.createDataFrame([(f"{s}::{p}", s, p, s, t, h, pr, c) for s, p, t, h, pr, c in rows], PAGE)


def test_sections(spark):
    text = "lead\n## One ##\na\n```\n## not\n```\n##\n## Two\n### deep\nb\r\n##   "
    page = spark.createDataFrame([("p", "T", text, None), ("q", "Q", "", None), ("r", "R", "\n\n## X\ny", None)], "id string, title string, content string, mirror_of string")
    got = {(r.page_id, r.ordinal): (r.heading, r.body) for r in sections.units(page).collect()}
    assert got == {("p", 0): ("", "lead"), ("p", 1): ("One", "a\n```\n## not\n```\n##"), ("p", 2): ("Two", "### deep\nb"), ("q", 0): ("", ""), ("r", 0): ("X", "y")}


@pytest.mark.parametrize(("n", "parts"), [(1200, 1), (1201, 2)])
def test_long_sections_split_again(spark, n, parts):
    body = "## H\n" + "\n".join(["word"] * (n - 5)) + "\n### Sub one\nx y z"
    cut = sections.split_sections(spark.createDataFrame([("p", body)], "id string, content string")).collect()
    assert len(cut) == parts and ({r.heading for r in cut} == {"H", "H / Sub one"} if parts == 2 else cut[0].heading == "H")


def test_bm25_by_hand(spark):
    p = pages(spark, ("s", "a.md", "", "", 1, "cat cat dog"), ("s", "b.md", "", "", 1, "dog bird"), ("s", "c.md", "", "", 1, "fish"))
    index = retrieval.build(retrieval.mark_mirrors(p))
    hits = retrieval.search(index, spark.createDataFrame([(1, "cat"), (2, "nothing"), (3, "")], "query_id long, query string")).collect()
    idf = math.log(3 - 1 + 0.5) - math.log(1.5)
    assert [(h.page_id, round(h.score, 9)) for h in hits] == [("s::a.md", round(idf * 2 * 2.5 / (2 + 1.5 * (0.25 + 0.75 * 3 / 2)), 9))]
    assert retrieval.search(index, spark.createDataFrame([(1, "dog")], "query_id long, query string"), k=0).count() == 0


def test_mirrors(spark):
    p = pages(spark, ("a", "1.md", "Set up", "", 5, ""), ("b", "1.md", "set-up", "", 1, ""), ("b", "2.md", "other", "Set up", 1, ""), ("c", "1.md", "Set up", "", 5, ""), ("d", "1.md", "", "", 1, ""), ("e", "1.md", "the", "", 2, ""), ("f", "1.md", "of", "", 1, ""))
    got = {r.id: r.mirror_of for r in retrieval.mark_mirrors(p).collect() if r.mirror_of}
    assert got == {"b::2.md": "a::1.md", "f::1.md": "e::1.md"}


def test_near_pairs_are_exact(spark):
    words = [f"w{i}" for i in range(40)]
    texts = {"a": words, "b": words[:39] + ["x"], "c": words[:20], "d": words, "e": [], "f": ["one"], "g": ["one"]}
    p = spark.createDataFrame([(k, " ".join(v)) for k, v in texts.items()], "id string, content string")
    sets = duplicates.with_shingles(p).select("id", "shingles")
    shingle = {k: {tuple(v[i : i + 5]) for i in range(max(1, len(v) - 4))} if v else set() for k, v in texts.items()}
    want = {(a, b): len(shingle[a] & shingle[b]) / len(shingle[a] | shingle[b]) for a in texts for b in texts if a < b and shingle[a] | shingle[b]}
    for t in (0.8, 0.97, 0.3, 1.01):
        got = {(r.a, r.b): round(r.similarity, 9) for r in duplicates.near_pairs(sets, t).collect()}
        assert got == {k: round(v, 9) for k, v in want.items() if v >= t}
    assert {(r.a, r.b) for r in duplicates.near_pairs_lsh(sets).collect()} <= {k for k, v in want.items() if v >= 0.8}


def test_winner(spark):
    facts = spark.createDataFrame([("a", 1, "include", "ua"), ("b", 2, "include", "ub"), ("c", 1, "resolver", None), ("d", 1, None, "ud")], "id string, priority long, selected_by string, url string")
    pairs = spark.createDataFrame([("a", "b"), ("a", "c"), ("a", "d")], "a string, b string")
    got = {(r.canonical, r.duplicate): (r.why, r.suggested) for r in duplicates.judge(pairs, facts).collect()}
    assert got == {("b", "a"): ("priority 2 > 1", "exclude"), ("c", "a"): ("resolver beats include", "exclude"), ("a", "d"): ("priority and selected_by tie; a sorts first", "review")}


def test_decisions(spark):
    d = spark.createDataFrame([("x", "h1", "include", "", "", "", 1), ("x", "h2", "exclude", "", "", "", 2), ("y", "", "exclude", "", "", "", 3), ("z", "h", "unsure", "", "", "", 4)], "id string, sha256 string, decision string, reason string, by string, at string, line_no long")
    now = spark.createDataFrame([("x", "h1"), ("y", "")], "id string, sha256 string")
    assert {(r.id, r.why) for r in ledgers.expired(d, now).collect()} == {("x", "changed"), ("z", "gone")}
    residue = spark.createDataFrame([("x", "s", "not_selected", "h2"), ("y", "s", "not_selected", ""), ("w", "t", "excluded", "h")], "id string, source string, reason string, sha256 string")
    assert {r.id for r in ledgers.undecided(residue, d).collect()} == {"y"}
    assert {r.id for r in ledgers.undecided(residue, d, include_excluded=True).collect()} == {"y", "w"}
    row = ledgers.decide(d, residue, now.where("false"), "x", "include", by="me").first()
    assert (row.sha256, row.decision) == ("h2", "include")
    with pytest.raises(KeyError):
        ledgers.decide(d, residue, now, "q", "include")


def test_links(spark):
    f = spark.createDataFrame([("s", "docs/a.md"), ("s", "docs/b/README.md"), ("s", "docs/b/index.md"), ("s", "README.md")], "source string, path string")
    links = ["/a", "b/", "a.md#x", "missing", "https://x", "#y", "../", " "]
    rows = spark.createDataFrame([("s", "docs", x) for x in links], "source string, base string, link string")
    got = {r.link: (r.target, r.resolved) for r in selection.resolve_links(rows, f).collect()}
    assert got == {"/a": ("docs/a.md", True), "b/": ("docs/b/README.md", True), "a.md#x": ("docs/a.md", True), "missing": ("docs/missing.md", False), "../": ("README.md", True)}


@pytest.mark.parametrize(("a", "b", "want"), [("a\nb\nc", "a\nc\nd", (1, 1)), ("", "x\n", (1, 0)), (None, "x", (0, 0)), ("a\r\nb", "a\nb\n", (0, 0)), ("a\nb\na\nb", "b\na\nb\na", (1, 1))])
def test_line_counts(a, b, want):
    assert snapshots.count_lines(a, b) == want


def test_usage(spark):
    assert usage.parse_since("2h") == 7200 and usage.parse_since("90") == 90
    for bad in ("", "x", "1w", "99999999999999999999d"):
        with pytest.raises(ValueError):
            usage.parse_since(bad)
    t = spark.createDataFrame([(1, "q", ["a", "b"], [2, 1], [], "2024-01-01T00:00:00Z"), (2, "q", ["c"], [], [], "bad"), (3, "r", ["a"], [], ["a"], "2024-01-09T00:00:00Z")], "line_no long, query string, retrieved array<string>, ranks array<int>, cited array<string>, at string")
    assert [tuple(r) for r in usage.uncited_queries(t).collect()] == [("q", "b")]
    assert {r.line_no for r in usage.since(t, 86_400, "2024-01-09T12:00:00Z").collect()} == {2, 3}


def test_gates(spark):
    counts = spark.createDataFrame([(3, 0)], "duplicates_max long, removed_pages_max long")
    assert [tuple(r) for r in report.violations(counts, {"duplicates_max": 2, "removed_pages_max": 0}).collect()] == [("duplicates_max", 2, 3)]
    assert report.gate_warnings({"removed_pages_max": 1}, False) and not report.gate_warnings({"removed_pages_max": 1}, True)
    assert "| a\\|b |" in report.markdown({"added": [{"id": "a|b"}]})


def test_config():
    raw = {"version": 1, "sources": [{"name": "a", "repo": "https://github.com/x/y", "ref": "main", "resolver": {"type": "glob", "include": ["*.md"]}}]}
    assert config.from_dict(raw).sources[0].priority == 1
    for change in ({"name": "a b"}, {"repo": "https://x"}, {"ref": " "}, {"extra": 1}, {"resolver": {"type": "glob"}}, {"resolver": {"type": "glob", "include": ["[a"]}}, {"resolver": {"type": "x"}}):
        with pytest.raises(config.ConfigError):
            config.from_dict({**raw, "sources": [raw["sources"][0] | change]})
    with pytest.raises(config.ConfigError):
        config.from_dict({**raw, "sources": raw["sources"] * 2})


def test_ledger_files(spark, tmp_path):
    path = tmp_path / "trail.jsonl"
    path.write_text('{"query":"a","retrieved":["s::p"]}\n\n{"query":"b","at":"x","cited":["s::q"]}\n')
    assert [(r.line_no, r.query, r.retrieved) for r in files.trail(spark, str(path)).orderBy("line_no").collect()] == [(1, "a", ["s::p"]), (3, "b", [])]
    path.write_text('{"query":"a","version":9}\n')
    with pytest.raises(Exception, match="newer version"):
        files.trail(spark, str(path)).collect()
    assert files.trail(spark, str(tmp_path / "none")).count() == 0


def test_artifact(spark, tmp_path):
    (tmp_path / "a/sub").mkdir(parents=True)
    (tmp_path / "_x").mkdir()
    (tmp_path / "_x/n.md").write_text("no")
    (tmp_path / "a/sub/p.md").write_text("# Head\n\ntext")
    (tmp_path / "a/q.md").write_text("---\ntitle: Q\n---\nbody")
    (tmp_path / "a/meta.json").write_text(json.dumps({"artifact_version": 1, "repo": "o/r", "module": "m", "pages": {"q.md": {"title": "Nav", "doc_type": "concept", "section": "S"}}}))
    got = {r.id: (r.title, r.heading, r.module, r.section, r.content) for r in files.artifact_pages(spark, str(tmp_path)).collect()}
    assert got == {"a::sub/p.md": ("Head", "Head", "m", "", "# Head\n\ntext"), "a::q.md": ("Nav", "", "m", "S", "body")}


def test_manifest(spark, tmp_path):
    path = tmp_path / "manifest.json"
    path.write_text(json.dumps({"version": 1, "artifact_version": 1, "sources": {"s": {"repo": "o/r", "commit": "c", "pages": {"p.md": {"sha256": "h", "title": "T"}}, "residue": ["x.md"]}}}, indent=1))
    m = files.manifest(spark, str(path))
    assert [(r.id, r.title) for r in files.manifest_pages(m).collect()] == [("s::p.md", "T")]
    assert [r.id for r in files.manifest_ids(m, "residue").collect()] == ["s::x.md"]
    path.write_text('{"version": 2, "sources": {}}')
    with pytest.raises(ValueError, match="version 2"):
        files.manifest(spark, str(path))


def test_navigation(spark):
    script = "export default { sidebar: [ { text: 'A', items: [ { text: \"It\\'s\", link: '/a' }, /* c */ { text: 'B', items: [{ text: 'x', link: 'b/' },] } ] } ] // end\n}"
    assert list(navigation.sidebar_links(navigation.js_value(script)["sidebar"])) == [("/a", "It's", "A"), ("b/", "x", "A > B")]
    docs = "module.exports = { docs: ['intro', {type: 'category', label: 'C', items: ['c/one', {type: 'autogenerated', dirName: 'auto'}]}, {type:'doc', id:'d', label:'D'}] };"
    assert list(navigation.doc_ids(navigation.js_value(docs))) == [("intro", "", "", False), ("c/one", "", "C", False), ("auto", "", "C", True), ("d", "D", "", False)]
    assert list(navigation.summary_links("# Summary\n- [I](i.md)\n- [draft]()\n# Part\n  - [N](n.md)\n")) == [("i.md", "I", ""), ("n.md", "N", "Part")]
    assert navigation.sitemap_locations("<LOC>\nhttps://x/a </LOC>") == ["https://x/a"] and navigation.sitemap_locations("# c\n\nu") == ["u"]
    assert navigation.sitemap_paths("https://x/docs/a.html", "https://x/docs", "src") == ["src/a.md"] and navigation.sitemap_paths("https://x/docs/b/", "https://x/docs/", "src") == ["src/b/README.md", "src/b/index.md"]
    got = navigation.rows(spark.createDataFrame([("s", "docs", script)], "source string, base string, text string"), "vitepress").collect()
    assert [(r.link, r.section) for r in got] == [("/a", "A"), ("b/", "A > B")]


def test_archives():
    import io
    import tarfile

    def archive(*names):
        out = io.BytesIO()
        with tarfile.open(fileobj=out, mode="w:gz") as tar:
            for name in names:
                info = tarfile.TarInfo(name)
                info.size = 1
                tar.addfile(info, io.BytesIO(b"x"))
        return out.getvalue()

    assert tarballs.unpack(archive("r-abc123/b", "r-abc123/a/c")) == ("abc123", [("a/c", b"x"), ("b", b"x")])
    with pytest.raises(tarballs.UnsafePath):
        tarballs.unpack(archive("r/../../x"))


def test_model_calls(spark):
    answers = iter([(503, ""), (200, "ok")])
    assert assist.ask(lambda m, x: next(answers), "m", [], pause=lambda s: None) == "ok"
    with pytest.raises(assist.ModelError):
        assist.ask(lambda m, x: (400, "no"), "m", [])

    def scripted(model, messages):
        return 200, json.dumps([{"id": a["id"], "verdict": {"a": "include", "b": "huh"}.get(a["id"], "include")} for a in json.loads(messages[1]["content"])] + [{"id": "unasked", "verdict": "include"}])

    rows = spark.createDataFrame([("a", "not_selected", "x"), ("b", "not_selected", "x"), ("c", "new_source", "x")], "id string, reason string, excerpt string")
    assert {(r.id, r.verdict) for r in assist.classify(rows, scripted, "m", "p").collect()} == {("a", "include"), ("b", "unsure"), ("c", "unsure")}
    q = spark.createDataFrame([([" A?", "a?", "", "B?"],)], "q array<string>")
    assert q.select(assist.clean_questions(q.q, 5)).first()[0] == ["A?", "B?"]


@pytest.mark.skipif(not Path(DATA).exists(), reason="test tables are not here")
@pytest.mark.parametrize("name", ["page_scan", "tokenize_counts", "section_split", "bm25_topk", "mirror_rule", "near_dups", "decisions_expired", "precedence", "manifest_diff", "uncited_queries"])
def test_catalogue(spark, name):
    got = catalogue.queries()[name](spark, DATA).toPandas()
    con = duckdb.connect()
    for path in Path(DATA).glob("*.parquet"):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    want = con.sql(catalogue.oracle_sql()[name]).df()
    rows = lambda df: sorted(map(str, df[sorted(df.columns)].itertuples(index=False, name=None)))
    assert rows(got) == rows(want)


def against_sql(spark, tmp_path, name, texts):
    """Rows of a query and of its SQL over documents made of (doc_id, text, source)."""
    con = duckdb.connect()
    con.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    con.executemany("INSERT INTO documents VALUES (?, ?, 'en', ?, 0)", [[i, t, s] for i, t, s in texts])
    con.sql(f"COPY documents TO '{tmp_path}/documents.parquet'")
    got, want = catalogue.queries()[name](spark, str(tmp_path)).toPandas(), con.sql(catalogue.oracle_sql()[name]).df()
    assert list(got.columns) == list(want.columns)
    return tuple(sorted(map(str, df.itertuples(index=False, name=None))) for df in (got, want))


def test_chunks_of_long_sections(spark, tmp_path):
    got, want = against_sql(spark, tmp_path, "chunks", [[1, "Top\nHead\n" + "word " * 1300 + "\nSub\nx y", "src1"], [2, "Top\nHead\nword\nSub\nx y", "src2"]])
    assert got == want and len(got) == 4


def cut_by_hand(text):
    """(heading, body) of a page's units, a line at a time."""

    def parts(lines, level):
        out, fenced = [["", []]], False
        for line in lines:
            fenced ^= line.lstrip().startswith("```")
            title = None if fenced else re.match(r"#{%d}\s+(.+?)\s*#*\s*$" % level, line)
            out.append([title[1], []]) if title else out[-1][1].append(line)
        return [(h, b) for h, b in out if h or "".join(b).strip()]

    out = []
    for head, body in parts(text.split("\n"), 2):
        if head and len(re.findall("[a-z0-9]+", "\n".join(body).lower())) > 1200:
            out += [(f"{head} / {sub}" if sub else head, "\n".join(b)) for sub, b in parts(body, 3)]
        else:
            out.append((head, "\n".join(body)))
    return out or [("", text)]


def marked_by_hand(text):
    return "\n".join("```" if i % 11 == 7 else "## " + x if i % 4 == 1 else "### " + x if i % 4 == 3 else x for i, x in enumerate(text.split("\n")))


def test_chunks_cut_long_sections_again(spark, tmp_path):
    """Above 1200 tokens at third-level headings, outside fences, which are counted anew in a section; a blank page is a unit."""
    word = lambda n: "word " * n
    texts = [
        f"Top\nHead\n{word(1300)}\nSub\nx y", "Top\nHead\nword\nSub\nx y", f"Top\nHead\n{word(1198)}\nSub\nx", f"Top\nHead\n{word(1199)}\nSub\nx", f"{word(1300)}\nHead\nx\nSub\nx",
        "\n".join(["Top", "One", "x", "y", "z", "Two", word(1300), "fence", *(f"l{k}" for k in range(8, 19)), "Behind", "tail", "Three", "x"]), f"Top\nHead\n\nSub\n{word(1300)}\nNext\n{word(1300)}", "",
    ]
    got, want = against_sql(spark, tmp_path, "chunks", [[k, t, "src1"] for k, t in enumerate(texts)])
    units = [(k, text.split("\n")[0], n, *cut) for k, text in enumerate(texts) for n, cut in enumerate(cut_by_hand(marked_by_hand(text)))]
    hand = [(f"src1::docs/{k}.md#{n}", f"src1::docs/{k}.md", h, n, hashlib.sha256((f"{t}\n{h}\n\n{b}" if h else f"{t}\n\n{b}").encode()).hexdigest()) for k, t, n, h, b in units]
    assert got == want == sorted(map(str, hand))
    assert {"Head / Sub", "Two / Behind"} <= {h for *_, h, _ in units}


def test_chunks_of_odd_texts(spark, tmp_path):
    """Line ends, white space that only one side takes as such, links and tags over lines, no text, no source."""
    odd = [
        "T\r\nHead\r\nx\r\n", "T\nHead\nx\n\n\n", "T\nHead\nx\ny\nz\n", "T\n \nx", "T\n  \n", "T\n\u00a0Head\u00a0\nx", "\u00a0", "\u3000\n \n\u00a0", " ", "\n", "", "T\n#\nx",
        "[a\nHead\nb](c) <b\nd>\n![e](f)\nS [g](h) <br/>", "T\nHead\n\t```\nx\ny\nNext\nz", "T\nHead\n\u00a0```\nx\ny\nNext\nz", "T\nHead\n```\nx\ny\nNext\nz\n```\nu\nv", "T\x0bU\nHe\x85ad\u2028x\x0b\nx\x0b",
        f"T\nHead\r\n{'word ' * 1300}\r\nSub\r\nx\n\n", f"T\nHead\n{'a.b ' * 400}\n\u00a0Sub\u00a0\nx", f"T\nHead\n{'a.b ' * 401}\n\nx\n", None,
    ]
    got, want = against_sql(spark, tmp_path, "chunks", [[k, t, "src1"] for k, t in enumerate(odd)] + [[99, "T\nHead\nx\nSub\ny\nNext", None]])
    assert got == want and len(got) > len(odd)


#: Exact copies, one title over different texts, one set of shingles under different titles, near texts, and none.
PAIRED = [
    "Same title here\n" + " ".join(f"w{i}" for i in range(60)), "Same title here\n" + " ".join(f"w{i}" for i in range(60)), "Same title here\nquite another text",
    "same title, here\n" + " ".join(f"w{i}" for i in range(60)), "Other\n" + " ".join(f"v{i}" for i in range(80)), "Other now\n" + " ".join(f"v{i}" for i in range(80)),
    "\nhead\nbody of it", "\nhead\nbody of that", ",\n...", ",\n..", "the\nof", "One two\nthree", "one\nTwo three", "", "alone in this",
]


@pytest.mark.parametrize("name", ["dup_by_kind", "dup_winner", "mirror_dups", "near_dups"])
def test_duplicates_against_sql(spark, tmp_path, name, monkeypatch):
    monkeypatch.setattr(duplicates, "CELL", 2, raising=False)
    got, want = against_sql(spark, tmp_path, name, [[k, t, f"src{k % 4}"] for k, t in enumerate(PAIRED)])
    assert got == want and got


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_counts_by_kind_make_no_pairs(spark, tmp_path):
    against_sql(spark, tmp_path, "dup_by_kind", [[k, t, f"src{k % 4}"] for k, t in enumerate(PAIRED)])
    assert "id#" not in "".join(line for line in plan_of(catalogue.queries()["dup_by_kind"](spark, str(tmp_path))).splitlines() if "Join" in line)


@pytest.mark.parametrize("name", ["dup_winner", "mirror_dups"])
def test_pairs_are_not_shuffled(spark, tmp_path, name):
    """Above the join that makes pairs there is no other join or aggregate."""
    against_sql(spark, tmp_path, name, [[k, t, f"src{k % 4}"] for k, t in enumerate(PAIRED)])
    top = [line.strip(" :+-") for line in plan_of(catalogue.queries()[name](spark, str(tmp_path))).splitlines()]
    first = next(k for k, line in enumerate(top) if line.startswith(("Join", "Aggregate")))
    assert "id" in top[first] and top[first].startswith("Join Inner") and "<" in top[first]


def test_near_pairs_meet_where_there_is_room(spark):
    """Rare shingles that leave too few behind them make no candidate, and no pair at the threshold is lost."""
    rows = [(f"p{k}{s}", [*range(1000 * k + s, 1000 * k + s + 45)]) for k in range(6) for s in range(0, 16, 5)] + [("long", [*range(45)] + [*range(90_000, 90_011)]), ("far", [*range(4, 45)] + [*range(91_000, 91_012)])]
    data = spark.createDataFrame(rows, "id string, shingles array<bigint>")
    got = {(r.a, r.b): r.similarity for r in duplicates.near_pairs(data).collect()}
    sets = {i: set(s) for i, s in rows}
    want = {(a, b): x for a in sets for b in sets if a < b and (x := len(sets[a] & sets[b]) / len(sets[a] | sets[b])) >= 0.8}
    assert got == want and want
    plan = duplicates.near_pairs(data)._jdf.queryExecution().optimizedPlan().toString()
    assert "pos#" in "".join(line for line in plan.splitlines() if "Join Inner" in line)


def test_a_shared_passage_is_one_part(spark):
    """However long it is, and however many pages repeat a class."""
    passage, rows = list(range(1000, 1300)), []
    for k in range(12):
        rows += [(1, k, [*range(k * 10, k * 10 + 10), *passage, *([5000] if k < 2 else [])])] * (1 + (k == 3))
    got = {r["class"]: r for r in duplicates.shared_parts(spark.createDataFrame(rows, "kh bigint, class bigint, shingles array<bigint>")).collect()}
    assert len(got) == 12 and all(sorted((p.n, p.weight) for p in r.parts) == [(2, 1)] * (k < 2) + [(12, 300)] for k, r in got.items())
    assert len({p.part for r in got.values() for p in r.parts}) == 2


@pytest.mark.parametrize("name", ["dup_winner", "mirror_dups"])
def test_long_shared_passages_of_a_title(spark, tmp_path, name, monkeypatch):
    """Passages of all pages of a title, of some, and of two, longer and shorter than what one long stands for."""
    monkeypatch.setattr(duplicates, "CELL", 2)
    run = lambda c, n: " ".join(f"{c}{i}" for i in range(n))
    texts = [f"One title\n{run('a', 90)} {run('b', 75) if k % 2 else ''} {run('c', 40) if k in (1, 2) else ''} {run('d' + 'xyz'[k % 3], 9)} {run(f'own{k}q', 30)}" for k in range(7)]
    got, want = against_sql(spark, tmp_path, name, [[k, t, f"src{k % 3}"] for k, t in enumerate([*texts, texts[3], "One title"])])
    assert got == want and len(got) >= 35


def test_mirrors_tokenise_shared_titles_only(spark, tmp_path):
    against_sql(spark, tmp_path, "mirror_dups", [[k, f"Title {k % 6}{'x' * (k > 7) + str(k) * (k > 7)}\nbody {k}", "src1"] for k in range(60)])
    pages = A.pages(spark, str(tmp_path))
    seen, real = [], duplicates.with_shingles
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(duplicates, "with_shingles", lambda p, *a: seen.append(p.count()) or real(p, *a))
        catalogue.queries()["mirror_dups"](spark, str(tmp_path)).count()
    assert pages.count() == 60 and seen[0] < 10


def test_schema_pages(spark):
    pytest.importorskip("yaml")
    text = """
kind: CustomResourceDefinition
spec:
  group: g.io
  scope: Namespaced
  names: {kind: Thing, plural: things, shortNames: [t, th]}
  versions:
  - {name: v1alpha1, served: true, storage: false}
  - {name: v0, served: false, storage: false}
  - name: v1
    served: true
    storage: true
    schema:
      openAPIV3Schema:
        description: "A  thing\\n of note"
        properties:
          metadata: {type: object}
          spec:
            required: [b]
            properties:
              b: {type: string, enum: [x, "y|z"]}
              a: {type: array, items: {properties: {q: {type: integer}}}}
              c: {additionalProperties: {type: string}}
              d: {x-kubernetes-preserve-unknown-fields: true, type: object}
          status:
            properties:
              ready: {type: boolean}
              conditions: {type: array, items: {properties: {type: {type: string, enum: [Ok], description: Kind.}}}}
---
openapi: 3.0.0
components: {schemas: {W: {description: w, required: [i], properties: {i: {type: integer}}}}}
---
kind: Other
"""
    from textloom.sources import schemas

    got = {r.path: r.content for r in schemas.render(spark.createDataFrame([("s", "x.yaml", text)], "source string, path string, text string")).collect()}
    assert list(got) == ["reference/g.io/thing-v1.md", "reference/g.io/thing-v1alpha1.md", "reference/w.md"]
    page = got["reference/g.io/thing-v1.md"]
    assert page.startswith("# Thing (g.io/v1)\n\nA thing of note\n\nScope: Namespaced · Plural: things · Short names: t, th · Served: yes · Storage: yes\n\n## Fields\n\n| Field |")
    for row in ("| `spec.a[].q` | integer | no |  |  |", "| `spec.b` | string | yes | `x`, `y\\|z` |  |", "| `spec.c.*` | string | no |  |  |", "| `spec.d` | object | no | preserves unknown fields |  |", "\n## Status\n\n", "| `ready` | boolean |  |  |", "| `Ok` | Kind. |"):
        assert row in page
    assert got["reference/w.md"] == "# W\n\nw\n\n## Fields\n\n| Field | Type | Required | Values | Description |\n|---|---|---|---|---|\n| `i` | integer | yes |  |  |\n"


def test_verify(spark):
    from textloom.plans import verify

    a = spark.createDataFrame([("x", "o/r", "main", "glob"), ("y", "o/r", "main", "glob"), ("z", "o/r", "main", "glob")], "source string, repo string, ref string, resolver string")
    b = spark.createDataFrame([("x", "o/r", "dev", "mdbook"), ("w", "o/r", "main", "glob"), ("z", "o/r", "main", "glob")], a.schema)
    assert {tuple(r) for r in verify.stale_sources(a, b).collect()} == {("x", "repo or ref differs"), ("x", "resolver differs"), ("y", "not in manifest"), ("w", "not in config")}
    p, f = (spark.createDataFrame(rows, "id string, sha256 string") for rows in ([("a", "1"), ("b", "2"), ("c", "3")], [("a", "1"), ("b", "9"), ("d", "4")]))
    assert {tuple(r) for r in verify.artifact_problems(p, f).collect()} == {("b", "differs"), ("c", "missing"), ("d", "extra")}


def test_stream(spark, tmp_path):
    from textloom.streaming import trail

    row = {"version": 1, "query": "q", "retrieved": ["s::a"], "cited": ["s::a"], "session": "1"}
    (tmp_path / "1.json").write_text("\n".join(json.dumps(row | {"at": at}) for at in ("2024-01-01T00:00:00Z", "2024-01-01T00:00:00Z", "2024-01-01T00:10:00Z", "odd")))
    good, odd = trail.timed(trail.read(spark, str(tmp_path)))
    for df, name, mode in ((trail.page_counts(good), "counts", "complete"), (odd, "odd", "append")):
        df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination(60)
    assert [(r.page_id, r.retrieved, r.cited) for r in spark.table("counts").collect()] == [("s::a", 2, 2)]
    assert spark.table("odd").count() == 1


def test_index(spark):
    from textloom.plans.index import CorpusIndex

    p = pages(spark, ("a", "1.md", "Set up", "", 5, "install the engine"), ("b", "1.md", "Set up", "", 1, "install it"), ("b", "2.md", "Other", "", 1, "nothing"))
    index = CorpusIndex(p, spark.createDataFrame([("b::2.md", "how to frobnicate")], "page_id string, text string"))
    assert (index.page_count(), index.searchable_count()) == (3, 2) and index.read("b::1.md") == "install it"
    assert [h.page_id for h in index.search("frobnicate").collect()] == ["b::2.md"] and index.chunks().count() == 2
    with pytest.raises(KeyError):
        index.read("x")


def test_external_programs(spark, tmp_path):
    import sys

    from textloom.sources import external

    script = "import json,os\nprint(json.dumps({'path':'a','title':'1'}))\nprint()\nprint(json.dumps({'path':'a','title':os.environ['TEXTLOOM_SOURCE'],'rule':{'key':'k','text':'t'}}))\nprint(json.dumps({'path':'b','selected':False}))"
    rows = external.candidates(spark, "s", [sys.executable, "-c", script], str(tmp_path)).collect()
    assert [(r.path, r.title, r.selected, r.rule and r.rule.key) for r in rows] == [("a", "s", True, "k"), ("b", "", False, None)]
    for bad in ("raise SystemExit(3)", "print('x')", "print('{}')"):
        with pytest.raises(external.CommandFailed):
            external.candidates(spark, "s", [sys.executable, "-c", bad], str(tmp_path))
    render = "import sys,json\nfor l in sys.stdin:\n p=json.loads(l)['path']\n open('o.md','w').write('x'+p)\n print(json.dumps({'path':%r,'source_path':p}))"
    made = external.rendered(spark, "s", [sys.executable, "-c", render % "o.md"], [{"path": "a.yaml"}], str(tmp_path)).collect()
    assert [(r.path, r.source_path, r.content) for r in made] == [("o.md", "a.yaml", "xa.yaml")]
    with pytest.raises(external.CommandFailed):
        external.rendered(spark, "s", [sys.executable, "-c", render % "../o.md"], [{"path": "a.yaml"}], str(tmp_path))


def test_glob_source(spark):
    from pyspark.sql import functions as F

    paths = spark.createDataFrame([("s", p) for p in ("docs/a.md", "docs/b.txt", "more/c.md", "x.md")], "source string, path string")
    got = {r.path: r.selected for r in selection.glob_candidates(paths, ["docs/**"], ["md"], ["docs/**", "more/**"]).collect()}
    assert got == {"docs/a.md": True, "docs/b.txt": False, "more/c.md": False}
    why = selection.not_selected("glob", include=["docs/**"], extensions=["md"])
    assert {r.path: r.k for r in paths.select("path", why.key.alias("k")).collect()}["docs/b.txt"] == "glob:extension"
    other = paths.select(selection.not_selected("mdbook", "SUMMARY.md").text.alias("t"), selection.not_selected("external", mentioned=F.col("path") == "x.md").key.alias("e")).collect()
    assert other[0].t == "not linked from `SUMMARY.md`" and [r.e for r in other][-1] == "external:not-selected"
