import hashlib
import random
import re

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from transitloom.llm import decontamination, html_extraction, merkle_audit
from transitloom.llm.decontamination import split_item

SF = "/root/testdata/sf0.001"


def tokens(text):
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", (text or "").lower())


def brute_hits(docs, items, threshold, overlap):
    """BM25 of every passage and item, without any pruning."""
    parsed = [(i, [tokens(p) for p in split_item((t or "").lower())]) for i, t in sorted(set(items)) if tokens(t)]
    n, mean = len(parsed), np.mean([sum(map(len, p)) for _, p in parsed])
    df = {}
    for _, parts in parsed:
        for t in set(sum(parts, [])):
            df[t] = df.get(t, 0) + 1
    weights = []
    for _, parts in parsed:
        words = sum(parts, [])
        w = {t: np.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * words.count(t) * 2.2 / (words.count(t) + 1.2 * (0.25 + 0.75 * len(words) / mean)) for t in set(words)}
        weights.append({t: x / sum(w.values()) for t, x in w.items()})
    runs = lambda w: {tuple(w[k : k + 3]) for k in range(len(w) - 2)}

    def share(part, passage):
        if not part:
            return 1.0
        if len(part) < 3:
            return float(any(passage[k : k + len(part)] == part for k in range(len(passage))))
        mine = [tuple(part[k : k + 3]) for k in range(len(part) - 2)]
        return sum(r in runs(passage) for r in mine) / len(mine)

    found = set()
    for doc_id, text in docs:
        words = tokens(text)
        for first in range(0, len(words), 64):
            window, wide = set(words[first : first + 128]), words[max(0, first - 64) : first + 192]
            for (item, parts), w in zip(parsed, weights, strict=True):
                score = sum(x for t, x in w.items() if t in window)
                if score >= threshold and min(share(p, wide) for p in parts) >= overlap:
                    found.add((doc_id, item))
    return found


def test_decontamination_against_brute_force(spark):
    rng = random.Random(4)
    vocabulary = [f"v{i}" for i in range(150)]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, f"{say(rng.randrange(4, 40))}. {say(rng.randrange(1, 9))}.") for i in range(40)] + [(40, None), (41, "?!"), (3, "again x y")]
    docs = []
    for d in range(60):
        text = say(rng.randrange(0, 400))
        if d % 2:
            part = rng.choice(items[:40])[1].upper().split()
            for _ in range(rng.randrange(4)):
                part[rng.randrange(len(part))] = "changed"
            text = f"{say(rng.randrange(90))} {' '.join(part)} {text}"
        docs.append((d, text))
    docs += [(100, None), (101, "")]
    frame, table = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for threshold, overlap in ((0.5, 0.5), (0.3, 0.0), (0.6, 0.3)):
        want = brute_hits(docs, items, threshold, overlap)
        got = decontamination.contaminated(frame, table, threshold, overlap)
        assert {(r.doc_id, r.item_id) for r in got.collect()} == want and want
    want = brute_hits(docs, items, 0.5, 0.5)
    sliced = decontamination.contaminated(frame, table, postings=100)
    assert {(r.doc_id, r.item_id) for r in sliced.collect()} == want
    extra = frame.selectExpr("*", "1 AS item_id", "'q' AS score")
    kept = decontamination.decontaminated(extra, table)
    assert kept.columns == extra.columns and {r.doc_id for r in kept.collect()} == {d for d, _ in docs} - {d for d, _ in want}
    assert decontamination.contaminated(frame, table.where("false")).count() == 0
    assert decontamination.contaminated(frame.where("false"), table).count() == 0
    assert decontamination.decontaminated(extra, table.where("false")).count() == len(docs)


def test_items_of_any_length(spark):
    rng = random.Random(6)
    say = lambda n: " ".join(f"w{rng.randrange(4000)}" for _ in range(n))
    lengths = [10, 63, 64, 65, 128, 130, 208, 308, 608, 2000, 5000]
    items = [(n, f"{say(n - 6)}. {say(6)}") for n in lengths] + [(None, f"{say(300)}. {say(5)}")]
    docs = [(k, f"{say(k % 100 + 37)} {text} {say(k % 70)}") for k, (_, text) in enumerate(items)]
    docs += [(100 + k, text) for k, (_, text) in enumerate(items)] + [(200 + k, text.upper() + " " + text) for k, (_, text) in enumerate(items)]

    def changed(text, every):
        question = len(text.split()) - 6
        return " ".join(w if k % every or every > 2 and k >= question else f"x{k}" for k, w in enumerate(text.split()))

    docs += [(300 + k, changed(text, 9)) for k, (_, text) in enumerate(items)]  # a ninth of the question's words replaced: two thirds of its runs stand
    docs += [(400 + k, changed(text, 2)) for k, (_, text) in enumerate(items) if k]  # every second: no run of three stands
    docs += [(500 + k, " ".join(text.split()[: len(text.split()) // 3])) for k, (_, text) in enumerate(items)]  # a third, without the answer
    frame, table = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for postings in (decontamination.POSTINGS, 2000):
        got = {(r.doc_id, r.item_id): r for r in decontamination.contaminated(frame, table, postings=postings).collect()}
        want = {(d + k, i) for d in (0, 100, 200, 300) for k, (i, _) in enumerate(items)}
        assert set(got) == want
        assert all(got[d + k, i].score > 0.99 for d in (0, 100, 200) for k, (i, _) in enumerate(items))
        for k, (i, text) in enumerate(items):
            assert got[k, i].first_word <= k % 100 + 37 and got[k, i].last_word >= k % 100 + 37 + len(text.split())
        assert {r.doc_id for r in decontamination.decontaminated(frame, table, postings=postings).collect()} == {d for d, _ in docs} - {d for d, _ in want}


@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 4), st.sampled_from([0.5, 0.75, 1.0])), min_size=1, max_size=25), st.integers(1, 5))
@settings(max_examples=200, deadline=None)
def test_stretches_against_brute_force(hits, n_parts):
    hits = [(s, p % n_parts, x) for s, p, x in hits]
    share = np.full(n_parts, 1 / n_parts)
    wide = n_parts + 1 if n_parts > 1 else 0
    want = []
    for start in sorted({s for s, _, _ in hits}):
        inside = [h for h in hits if start <= h[0] <= start + wide]
        score = sum(max((x for _, q, x in inside if q == p), default=0) / n_parts for p in range(n_parts))
        want.append((pytest.approx(score), start, max(s for s, _, _ in inside)))
    got = decontamination._stretches(list(hits), n_parts, share)
    assert sorted(got, key=lambda x: x[1]) == want and [x[0] for x in got] == sorted((x[0] for x in got), reverse=True)


def test_item_parts():
    assert split_item("what is it? a thing") == ("what is it?", " a thing")
    assert split_item("question: who? answer: me and you") == ("question: who?", "me and you")
    assert split_item("one two. three four five.") == ("one two. ", "three four five.")
    assert split_item("one two. three four. five.") == ("one two. ", "three four. five.")
    assert "".join(split_item("a b c d")) == "a b c d"


PAGE = """<html><head><title>t</title></head><body class="home"><header><h1>Site</h1></header><div class="nav-menu"><a href="/">Home</a></div>
<div id="wrap"><div class="post-{n} content"><h1>Title&nbsp;{n}</h1><p>First  &amp; best
 paragraph of page {n}, long enough.<br>More<script>var x = "<p>no</p>";</script> text.<p>Second &lt;one&gt; here.</p><!-- hidden <p>x</p> -->
<div class="advert">Buy!</div><ul><li>item a<li>item b</ul><section class="comments"><p>A reader writes a lot of words here, more than the article has, really.</p></section></div>
<div class="sidebar"><p>Side text</p></div></div><footer>&copy; all</footer></body></html>"""
TEXT = "Title {n}\n\nFirst & best paragraph of page {n}, long enough. More text.\n\nSecond <one> here.\n\nitem a\n\nitem b"


def test_extraction(spark):
    rows = [(n, f"http://a.example/{n}", PAGE.replace("{n}", str(n))) for n in range(4)]
    rows += [(10, "http://a.example/x", "<p>no such path"), (11, None, None), (12, "", "<a"), (14, "", "1 < 2"), (13, "no url", "<div>unclosed &am <b>bold</div> tail <img alt='>'>"), (0, "http://b.example", "<article><p>" + "w " * 200_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS host", "'x' AS path")
    got = {(r.page_id, r.url): r for r in html_extraction.extract(pages).collect()}
    for n in range(4):
        assert got[n, f"http://a.example/{n}"].text == TEXT.replace("{n}", str(n))
        assert got[n, f"http://a.example/{n}"].path == "html>body.home>div>div.content.post-"
    assert got[10, "http://a.example/x"].text == "no such path"
    assert got[11, None].text == "" and got[12, ""].text == "" and got[14, ""].text == "1 < 2" and got[13, "no url"].text == "unclosed &am bold\n\ntail"
    assert got[0, "http://b.example"].n_chars == 2 * 200_000 - 1
    assert html_extraction.extract(pages.where("false")).count() == 0


@pytest.mark.parametrize(
    ("body", "text"),
    [
        ("<article><p>keep this text</p><p class='ad-slot'>buy</p><p>and this</p></article>", ["keep this text", "and this"]),
        ("<table><tr><td class=sidebar>side</td><td><p>main text here</p></td></tr></table>", ["main text here"]),
        ("<table><tr><td>a</td><td>b</td></tr><tr><td>c</td></tr></table>", ["a b", "c"]),
        ("<main><header><h2>Heading</h2><p>by line</p></header><p title='broken\">body text</p></main><aside>x</aside>", ["Heading", "body text"]),
        ("<div class='cookie-notice'>We use cookies</div><div class='story'><p>A<p>B<form>f<p>g</form><blockquote>C</blockquote></div><div hidden>no</div>", ["A", "B", "C"]),
        ("<div role=navigation>menu</div><section><h1>T &#233;&eacute;</h1>loose <i>inline</i> text<hr>after</section>", ["T éé", "loose inline text", "after"]),
        ('<article><p>First here</p><svg class="i"/><p>Second here</p></article>', ["First here", "Second here"]),
        ('<article><p>a <svg><title>no</title><svg><g/></svg></svg>b <math/>c <math><mi>x</mi><annotation>no</annotation></math></p><p>d</p></article>', ["a b c x", "d"]),
        ("<article><p>Press <button>Share</p><p>All of the rest</p></article><div><button>x</button></div>", ["Press Share", "All of the rest"]),
        ("<article><p>Press <button type=button>Share</button> now</p><video><p>No player</p></video><select><option>o</select><p>rest</p></article>", ["Press now", "rest"]),
        ("<article><p>kept</p><div class='comment-body'><p>reader</p></div><div id='comments' class='content'><p>reader</p></div></article>", ["kept"]),
        ("<main><article class='post has-comments tag-forms'><p>kept words</p></article><ol><li><article class='comment'><p>a reader's long words, many of them</p></article></ol></main>", ["kept words"]),
        ("<div class='layout-sidebar-left'><p>kept text of some length</p><div class='sidebar-content'><p>side</p></div><div class='page-footer'>foot</div></div>", ["kept text of some length"]),
        ("<div class='content-sidebar-wrap'><main><p>kept text</p></main><div class=sidebar>side</div></div>", ["kept text"]),
        ("<form id=all action=/><div class=menu><a>m</a></div><div><h1>Title</h1><p>The page is one form.</p></div><form><input></form></form>", ["Title", "The page is one form."]),
        ("<article><p>kept text</p><form><label>Mail</label></form></article>", ["kept text"]),
        ("<article><p>3 < 4, a <b>bold</b> a<b> and</p>stays: 3 < 4 and more</article>", ["3 < 4, a bold a and", "stays: 3 < 4 and more"]),
        ("<article><div class='post-header'><h2>Head</h2><p>by line</p></div><p>words of the body</p></article>", ["Head", "words of the body"]),
    ],
)
def test_blocks_of_main_text(body, text):
    blocks, containers, _ = html_extraction.parse(f"<html><body>{body}</body></html>")
    own = html_extraction.best(containers)
    assert [t for t, apart in blocks[own.first : own.last] if not apart] == text


def test_last_text_with_a_bare_sign():
    assert html_extraction.text_by_path("<p>one</p>stays: 3 < 4 and more", None) == "one\n\nstays: 3 < 4 and more"
    assert html_extraction.text_by_path("<p>one</p>stays <a href='x", None) == "one\n\nstays"


def test_deep_pages_take_memory_by_their_length():
    import tracemalloc

    page = "<div class=level>x" * 50_000
    tracemalloc.start()
    assert html_extraction.text_by_path(page, "div.level").count("x") == 50_000
    assert tracemalloc.get_traced_memory()[1] < 200e6
    tracemalloc.stop()


@given(st.lists(st.sampled_from("<div> </div> <p> </p> <svg> </svg> <svg/> <button> </button> <form> <article> </article> <b a=' <!-- --> < & x y <li class=ad> <script> </script> \x00".split(" ")), max_size=60))
@settings(max_examples=300, deadline=None)
def test_any_markup_is_read(parts):
    page = "".join(parts)
    text = html_extraction.text_by_path(page, None)
    assert "\n\n\n" not in text and text == text.strip()
    blocks, containers, nodes = html_extraction.parse(page)
    assert all(0 <= c.first < c.last <= len(blocks) for c in containers)
    keys = html_extraction.path_keys(nodes)
    paths = [html_extraction.path_of(nodes, k) for k in range(len(nodes))]
    assert len(set(keys)) == len(set(paths))


def test_extraction_by_salted_join(spark, monkeypatch):
    rows = sorted((r.page_id, r.text) for r in html_extraction.op3_html_extraction(spark, SF).collect())
    monkeypatch.setattr(html_extraction, "BROADCAST_HOSTS", 0)
    assert sorted((r.page_id, r.text) for r in html_extraction.op3_html_extraction(spark, SF).collect()) == rows


def test_merkle_audit_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    want = con.execute(merkle_audit.ORACLE_SQL["op9_merkle_audit"]).fetchall()
    got = merkle_audit.op9_merkle_audit(spark, SF).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_merkle_statuses(spark):
    frame = lambda rows: spark.createDataFrame(rows, "archive long, record_id long, content string")
    base = [(a, i, f"record {a} {i}") for a in (1, 2, 3) for i in range(100)] + [(4, None, None), (4, 5, "twin"), (4, 5, "twin")]
    copy = [r for r in base if r != (1, 99, "record 1 99")]
    copy = [(2, 7, "RECORD 2 7") if r == (2, 7, "record 2 7") else r for r in copy] + [(3, 100, "new")]
    reference = merkle_audit.build_tree(frame(base))
    got = {(r.archive, r.record_id): r.status for r in merkle_audit.audit(reference, merkle_audit.build_tree(frame(copy))).collect()}
    assert got == {(1, 99): "missing", (2, 7): "altered", (3, 100): "extra"}
    (leaf,) = reference.levels[0].where("archive = 1 AND record_id = 3").collect()
    assert bytes(leaf.digest) == hashlib.sha256(b"record 1 3").digest() and leaf.offset == 3 * len("record 1 0")
    assert reference.levels[-1].count() == 4
    assert merkle_audit.audit(reference, merkle_audit.build_tree(frame(base))).count() == 0
    empty = merkle_audit.build_tree(frame(base).where("false"))
    assert merkle_audit.audit(empty, empty).count() == 0
    assert {r.status for r in merkle_audit.audit(reference, empty).collect()} == {"missing"}


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, SF), name)
        assert docs.columns == columns
        counts.append(docs.count())
    assert counts[0] > counts[1] >= counts[2] >= counts[3] > 0
    out = corpus_pipeline.run(spark, SF)
    assert out.count() == counts[-1] and out.select("shard", "slot").distinct().count() == counts[-1]


@pytest.mark.parametrize("rows", [[], [(1, None, None, None, None), (1, None, None, None, None), (None, "", "en", "s", 0), (2, "w " * 50_000, "en", None, 9)]])
def test_stages_on_odd_tables(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "1 AS shard", "'x' AS plan", "2 AS score")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() <= max(3 * len(rows), 0)


def test_trees_are_as_high_as_their_archives(spark, monkeypatch):
    monkeypatch.setattr(merkle_audit, "FANOUT", 4)
    rows = [(a, k, f"content {a} {k}") for a, n in ((1, 1), (2, 70), (3, 5)) for k in range(n)]
    one = merkle_audit.build_tree(spark.createDataFrame(rows, "archive long, record_id long, content string"))
    assert len(one.levels) == 5 and one.levels[-1].count() == 3
    small = [r for r in rows if r[1] < 4 and r != (2, 3, "content 2 3")] + [(2, 3, "content 2 X")]
    two = merkle_audit.build_tree(spark.createDataFrame(small, "archive long, record_id long, content string"))
    found = {(r.archive, r.record_id): r.status for r in merkle_audit.audit(one, two).collect()}
    assert found == {(2, 3): "altered"} | {(2, k): "missing" for k in range(4, 70)} | {(3, 4): "missing"}
    assert merkle_audit.audit(two, two).count() == 0
    nothing = merkle_audit.build_tree(spark.createDataFrame([], "archive long, record_id long, content string"))
    assert merkle_audit.audit(nothing, nothing).count() == 0 and merkle_audit.audit(nothing, two).count() == len(small)


@pytest.mark.parametrize(
    "kept",
    [
        '<h2 id="sharing-data">Head</h2>', '<h2 id="related-work">Head</h2>', '<h3 id="menu-design">Head</h3>', '<h2 id="code-reviews">Head</h2>', '<h2 id="comments">Head</h2>',
        '<section id="related-work"><h2>Head</h2></section>', '<section id="discussion"><h2>Head</h2></section>', '<div class="discussion">Head</div>', '<p id="responses">Head</p>',
        '<p class="social">Head</p>', '<div class="related">Head <a href="/x">on</a> with more words</div>', '<section id="cookie-baking">Head</section>',
    ],
)
def test_article_text_with_marked_names_stays(kept):
    page = f"<html><body><article><p>First words of it.</p>{kept}<p>Last words of it.</p></article></body></html>"
    assert "Head" in html_extraction.text_by_path(page, None) and "First words" in html_extraction.text_by_path(page, None)


@pytest.mark.parametrize(
    "gone",
    [
        '<div id="comments"><p>Gone</p></div>', '<div id="sidebar-left">Gone</div>', '<section class="related"><a href="/x">Gone</a></section>', '<p class="social"><a href="/x">Gone</a></p>',
        '<p>Own <span hidden>Gone</span>line</p>', '<p>Own <span style="display: none">Gone <span>Gone</span> Gone</span>line</p>', '<p>Own <span class="ad">Gone</span>line</p>',
        '<p>Own line <b hidden>Gone</p>', '<div id="site-footer">Gone</div>', '<h2 class="comments-title">Gone</h2>',
    ],
)
def test_boilerplate_goes(gone):
    text = html_extraction.text_by_path(f"<html><body><article><p>First words of it.</p>{gone}<p>Last words of it.</p></article></body></html>", None)
    assert "Gone" not in text and text.startswith("First words of it.") and text.endswith("Last words of it.") and ("Own" not in gone or "Own line" in text)
