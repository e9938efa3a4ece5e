"""Decontamination, sketches, chat and HTML against plain versions."""

import hashlib
import html
import html.parser
import random
import re
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from textloom.llm import chat, decontamination, html_text, queries, sketches

DATA = "/root/testdata/sf0.01"

# --- decontamination ------------------------------------------------------------------------------------------------


def plain_hits(text, items):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    words, hit, found = find(text), set(), set()
    for item, t in items:
        w = find(t)
        n = min(13, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            for j in range(len(words) - n + 1):
                if words[j : j + n] == w[i : i + n]:
                    hit |= set(range(j, j + n))
                    found.add(item)
    ids = sorted(str(i) for i in found if i is not None)
    return len(words), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(words)


def contamination_case():
    rng = random.Random(3)
    vocabulary = ["a", "b", "The", "é", "x9"]
    word = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(1, word(20)), (2, word(13)), (3, "only Three words"), (4, "single"), (5, None), (6, " ,. "), (None, "no name here"), (2, word(14)), (10, word(40))]
    docs = [None, "", "...", "ONLY three, words", "a single one", "no name here"] + [word(rng.randint(1, 60)) for _ in range(40)]
    docs += [word(5) + " " + items[0][1][3:] + " " + word(400), items[8][1], items[1][1].upper()]
    return items, list(enumerate(docs))


@pytest.mark.parametrize("block_bytes", [1, 1 << 20])
def test_decontamination(spark, block_bytes):
    items, docs = contamination_case()
    d = spark.createDataFrame([(i, t, 5) for i, t in docs] + [(None, "single", 5)], "doc_id long, text string, n_hit int")
    b = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    got = {r.doc_id: tuple(r)[1:] for r in decontamination.decontaminate(d, b, block_bytes=block_bytes).collect()}
    for doc_id, text in docs:
        assert got[doc_id] == plain_hits(text, items), text
    assert got[None][4]
    kept = {r.doc_id for r in decontamination.contaminated_filter(d, b).collect()}
    assert kept == {i for i, t in docs if not plain_hits(t, items)[4]}
    kept = {r.doc_id for r in decontamination.contaminated_filter(d, b, block_bytes=block_bytes, group_bytes=100).collect()}
    assert kept == {i for i, t in docs if not plain_hits(t, items)[4]}
    assert decontamination.decontaminate(d.limit(0), b).count() == 0
    assert decontamination.decontaminate(d, b.limit(0)).where("contaminated").count() == 0


# --- sketches -------------------------------------------------------------------------------------------------------


def plain_sketch(text, k):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").lower()) if w]
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    fold = lambda hs: signed(_fold(hs))
    hashes = [xxh64_intdigest(w.encode(), seed=42) for w in words]
    runs = [hashes[i : i + 5] for i in range(max(len(hashes) - 4, 1))] if hashes else []
    return sorted({fold(r) for r in runs})[:k]


def _fold(hashes, mask=(1 << 64) - 1):
    """XXH64 of 8-byte values, each seeded with the hash so far, as Spark chains columns."""
    seed = 42
    for h in hashes:
        seed = xxh64_intdigest((h & mask).to_bytes(8, "little"), seed=seed)
    return seed


def plain_likeness(a, b, k):
    union = sorted(set(a) | set(b))[:k]
    return 1.0 if not union else len(set(a) & set(b) & set(union)) / len(union)


@pytest.mark.parametrize("partitions", [1, 8])
def test_sketches(spark, partitions):
    rng = random.Random(8)
    texts = [None, "", " ", "One", "a b c d", "a b c d e", "A b  C d e f", "é🙂" * 9] + [" ".join(rng.choice("abcdefgh") * rng.randint(1, 2) for _ in range(rng.randint(1, 200))) for _ in range(60)]
    rows = [(i * 7 % 101, t) for i, t in enumerate(texts)] + [(50, "again"), (50, "again"), (None, "no id")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, bucket string").repartition(partitions)
    got = sketches.edited(docs, k=16).collect()
    assert len(got) == len(rows)
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    want = []
    for n, (i, t) in enumerate(order):
        following = order[(n + 1) % len(order)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + following[:half]
        a, b, c = plain_sketch(t, 16), plain_sketch(edited, 16), plain_sketch(following, 16)
        want.append((str(i), len(t), hashlib.sha256(edited.encode()).hexdigest(), round(plain_likeness(a, b, 16), 9), round(plain_likeness(a, c, 16), 9)))
    assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in got) == sorted(want)
    printed = {r.n_chars: r.fingerprint for r in got if r.doc_id is None}
    assert printed[5] == "".join(f"{h & (1 << 64) - 1:016x}" for h in plain_sketch("no id", 16))
    assert sketches.edited(docs.limit(0)).count() == 0
    assert sketches.edited(docs.where("doc_id = 14")).count() == 1


def test_sketch_estimates(spark):
    a, b = " ".join(f"w{i}" for i in range(4000)), " ".join(f"w{i}" for i in range(2000, 6000))
    df = spark.createDataFrame([(a, b)], "a string, b string")
    df = sketches.with_sketch(sketches.with_sketch(df, "a", "sa"), "b", "sb")
    df = sketches.containment(sketches.resemblance(df, "sa", "sb", "r"), "sa", "sb", "c")
    row = df.select("r", "c", sketches.distinct_count(F.col("sa")).alias("n"), sketches.merged(F.col("sa"), F.col("sb")).alias("m")).first()
    assert abs(row.r - 1 / 3) < 0.1 and abs(row.c - 0.5) < 0.15 and abs(row.n - 3996) < 800
    assert row.m == plain_sketch(a, 256)[:0] + sorted(set(plain_sketch(a, 256)) | set(plain_sketch(b, 256)))[:256]


# --- chat -----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("part", [1, 40, 1 << 20])
def test_chat_round_trip(spark, part):
    texts = ["", None, "plain", "\\### Assistant: </turn> ok", "\\", "\\\\#<", "### user: x</turn>\n", "é🙂\n\n", ": "]
    rows = [(c, t, r, x) for c in (1, None, 3) for t, (r, x) in enumerate(zip(["user", "assistant", None, "a:b#<\\", "assistant", "system", "assistant", "user", "assistant"], texts, strict=True))]
    rows += [(1, 4, "assistant", "tie"), (1, 4, "assistant", "tie")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    formatted = chat.format_conversations(chat.events_of_turns(turns), part)
    got = {r.conv_id: r for r in chat.digests(formatted).collect()}
    for conv in (1, None, 3):
        own = sorted(((t, r or "", x or "") for c, t, r, x in rows if c == conv), key=lambda x: x)
        said = [x for _, r, x in own if r == "assistant"]
        assert got[conv].n_turns == len(own)
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in own).encode()).hexdigest()
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (sum(map(len, said)), hashlib.sha256("".join(said).encode()).hexdigest())
    whole = "".join(r.formatted for r in sorted(formatted.where("conv_id = 3").collect(), key=lambda r: r.part))
    assert chat.parse(whole) == [(r or "", x or "") for c, t, r, x in rows if c == 3] and got[3].formatted_chars == len(whole)
    assert chat.digests(chat.format_conversations(chat.events_of_turns(turns.limit(0)))).count() == 0


def test_chat_events_fold(spark):
    events = [
        (1, 0, 0, "message", "user", "hi"), (1, 1, 1, "message", "assistant", "He"), (1, 1, 2, "delta", None, "llo"), (1, 1, 5, "regenerate", None, "Good"), (1, 1, 6, "delta", None, " day"),
        (1, 0, 7, "edit", None, "hello"), (1, 2, 8, "message", "user", "gone"), (1, 2, 9, "remove", None, None), (1, 3, 10, "delta", "assistant", "only deltas"),
    ]
    df = spark.createDataFrame(events, "conv_id long, turn long, seq long, kind string, role string, text string")
    assert chat.parse(chat.format_conversations(df).first().formatted) == [("user", "hello"), ("assistant", "Good day"), ("assistant", "only deltas")]


# --- html -----------------------------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar">
<header><p>Site, name, and, more</p></header><nav><ul><li><a href=/a>A</a></ul></nav><div class="cookie-notice"><p>We, use, cookies, here, on, this, site.</div>
<article><h1>Head &amp; line</h1><p>First, para with <b>bold</b><br>and
 more text, of the article.<p>Second, para &lt;x&gt;.<ul><li>one<li>two</ul><table><tr><td>a<td>b<tr><td>c</table><form><input>Name</form>
<div class="ad">Buy, this, now, please, thanks.</div></article>
<aside><p>Side, text, with, many, commas, in, it, to, fool.</aside><section id="comments"><p>Great, post, thanks, for, writing, this, all.</section><footer>&copy; me</footer></body></html>"""


def test_main_text():
    assert html_text.main_text(PAGE) == "Head & line\n\nFirst, para with bold and more text, of the article.\n\nSecond, para <x>.\n\none\n\ntwo\n\na b\n\nc"


@pytest.mark.parametrize("page", [None, "", "<p", "<", "&", "<script>x", "<!-- x", "<a href='", "</p></p>", "<b>" * 5000 + "deep", "<div>" * 3000 + "deep"])
def test_odd_pages(page):
    assert html_text.main_text(page) in ("", "&", "<", "deep")


@pytest.mark.parametrize("page", ["<div>" * 100_000 + "deep", "<b>" * 50_000 + "</i>" * 50_000 + "deep", "<i><div>" + "<b>" * 50_000 + "</i>" * 50_000 + "deep", "<ul>" + "<li><b>" * 30_000 + "deep", "<td><b>" * 30_000 + "</td>" * 30_000 + "deep"])
def test_deep_pages_take_seconds(page):
    began = time.process_time()
    assert html_text.main_text(page) == "deep" and time.process_time() - began < 20


class PlainArticle(html.parser.HTMLParser):
    """Blocks of what stands between the tags of a page's article, for the pages of the test tables."""

    def __init__(self):
        super().__init__()
        self.inside, self.texts = False, []

    def handle_starttag(self, tag, attrs):
        self.inside |= tag == "article"
        if re.fullmatch("p|h[1-6]|article", tag):
            self.texts.append("")
        elif tag == "br" and self.inside:
            self.texts[-1] += " "

    def handle_endtag(self, tag):
        if re.fullmatch("p|h[1-6]", tag):
            self.texts.append("")
        elif tag == "article":
            self.inside = False

    def handle_data(self, data):
        if self.inside:
            self.texts[-1] += data


@pytest.mark.skipif(not Path(DATA).exists(), reason="test tables are not here")
def test_every_page_of_the_table_against_its_article(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    rows = queries.op9_html(spark, DATA).collect()
    assert len(rows) == len(pages) > 0
    for row in rows:
        plain = PlainArticle()
        plain.feed(pages[row.page_id])
        assert row.text == "\n\n".join(" ".join(t.split()) for t in plain.texts if t.strip())


def test_entities_and_divs():
    text = "One, two, three &mdash; and so on &#233;&#x41;&amp;amp; x&nbsp;y."
    page = f"<body><div id=menu><a href=x>menu</a></div><div class=content><h2>T</h2><div>{text}</div><div>{text}</div></div><div class=sidebar>{text}</div></body>"
    assert html_text.main_text(page) == "T\n\n" + "\n\n".join([" ".join(html.unescape(text).split())] * 2)


@pytest.mark.parametrize("aside", ['<ol class="commentlist"><li>A, b, c, d, e, f, g.</ol>', '<div id="leftSidebar">A, b, c, d, e.</div>', '<div role="navigation">A, b.</div>', '<p hidden>A, b.</p>', '<article class="comment">A, b, c.</article>', '<div style="display: none">A</div>'])
def test_parts_beside_the_article(aside):
    body = "<p>" + "Words, of the article, at some length. " * 5 + "</p>"
    want = " ".join(("Words, of the article, at some length. " * 5).split())
    assert html_text.main_text(f"<body><article>{body}{aside}</article></body>") == want
    assert html_text.main_text(f"<body><div class=content>{body}{aside}</div>{aside}</body>") == want


def test_html_rows(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, 3), (1, "u", PAGE, 3), (None, None, None, 3)], "page_id long, url string, html string, n_chars int")
    rows = html_text.extract(pages).collect()
    n = len(html_text.main_text(PAGE))
    assert [(r.page_id, r.url, r.n_chars) for r in rows] == [(1, "u", n), (1, "u", n), (None, None, 0)]
    assert html_text.extract(pages.limit(0)).count() == 0


def test_freed_memory_goes_back_before_new_is_kept(monkeypatch):
    from textloom.llm import common

    steps = []
    monkeypatch.setattr(common, "_kept", {})
    monkeypatch.setattr(common, "release", lambda: (steps.append("release"), common._kept.clear()))
    for key in ("a", "a", "b"):
        assert common.kept(key, lambda key=key: steps.append(key) or key) == key
    assert steps == ["release", "a", "release", "b"] and list(common._kept) == ["b"]
