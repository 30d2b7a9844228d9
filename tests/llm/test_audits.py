"""Manifest, divergence audit and url reputations: against DuckDB, by hand, and on odd tables."""

import hashlib
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from transitloom.llm import divergence_audit, merkle_manifest, url_reputation

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (1, "one two\nthree", "en", "b", 13),
    (2, "", "en", "b", 0),
    (3, None, "en", None, None),
    (None, "no id\n", None, "b", 6),
    (None, "no id\n", None, "b", 6),
    (4, "one two\nthree", "en", "b", 13),
    (4, "one two\nthree", "en", "b", 13),
    (5, "Äpfel one " * 20_000, "de", "", 200_000),
    (6, "x", "de", "é", 1),
    (7, "x\ny", "de", "z", 3),
    (8, "aaa bbb one one", "en", "a\0", 15),
    *((100 + i, f"one two number\n{i} aaa bbb " + "one " * (i % 4), "en", "abc"[i % 3], i) for i in range(60)),
]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def equals_sql(got, sql, **tables):
    con = duckdb.connect()
    for name, frame in tables.items():
        con.register(name, frame.toPandas() if hasattr(frame, "toPandas") else frame)
    found = con.execute(sql)
    names = sorted(d[0] for d in found.description)
    at = [[d[0] for d in found.description].index(n) for n in names]
    want = sorted(str([row[i] for i in at]) for row in found.fetchall())
    assert sorted(str([row[n] for n in names]) for row in got.collect()) == want


def tree(leaves):
    """Root, and for each leaf its siblings, by the contract's words."""
    nodes, ways, at = list(leaves), [[] for _ in leaves], list(range(len(leaves)))
    while len(nodes) > 1:
        runs = [nodes[i : i + 3] for i in range(0, len(nodes), 3)]
        for i, node in enumerate(at):
            run = runs[node // 3]
            ways[i].append((run[: node % 3], run[node % 3 + 1 :]))
        at, nodes = [n // 3 for n in at], [sha("".join(run)) for run in runs]
    return nodes[0], ways


def leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[0], row[3], row[2], row[4], row[1])))


@pytest.mark.parametrize("levels", [1, 2, 7])
def test_manifest_by_hand(spark, levels):
    docs = spark.createDataFrame(ODD, SCHEMA).withColumns({"leaf": F.lit("mine"), "tree": F.lit(1), "place": F.lit(2)})
    got = merkle_manifest.manifest(docs, levels=levels).withColumn("proof", merkle_manifest.proof_hash(F.col("lefts"), F.col("rights")))
    got = got.withColumn("again", merkle_manifest.folded(F.col("leaf"), F.col("lefts"), F.col("rights"))).collect()
    assert len(got) == len(ODD)
    sources = sorted({r[3] for r in ODD}, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in sources:
        rows = sorted((r for r in ODD if r[3] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[s] = rows, *tree([leaf(r) for r in rows])
    root, upper = tree([trees[s][1] for s in sources])
    want = []
    for s, up in zip(sources, upper, strict=True):
        rows, subroot, ways = trees[s]
        for r, way in zip(rows, ways, strict=True):
            want.append((r[0], leaf(r), subroot, root, sha("".join("".join(a + b) for a, b in way + up))))
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.leaf, r.subroot, r.root, r.proof)) for r in got)
    assert {r.again for r in got} == {root}


def _query(module, name, spark, monkeypatch, **tables):
    monkeypatch.setattr(module, "table", lambda spark, sf_dir, which: tables[which])
    return module.QUERIES[name](spark, "")


def test_manifest_finds_tampering(spark, monkeypatch):
    docs = spark.createDataFrame(ODD, SCHEMA)
    rows = _query(merkle_manifest, "op11_merkle_manifest", spark, monkeypatch, documents=docs).collect()
    texts = {r[0]: r[1] for r in ODD}
    for r in rows:
        touched = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 2 == 0 and "\n" in (texts[r.doc_id] or "")
        assert r.verified == (not touched) == (r.folded_root == r.root)
    equals_sql(merkle_manifest.QUERIES["op11_merkle_manifest"](spark, ""), merkle_manifest.ORACLE_SQL["op11_merkle_manifest"], documents=docs.toArrow())


@pytest.mark.parametrize("rows", [[], [(1, "a", "en", None, 1)], [(1, None, None, None, None)] * 5])
def test_manifest_of_few_rows(spark, monkeypatch, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    got = _query(merkle_manifest, "op11_merkle_manifest", spark, monkeypatch, documents=docs)
    assert got.count() == len(rows)
    equals_sql(got, merkle_manifest.ORACLE_SQL["op11_merkle_manifest"], documents=docs.toArrow())


@pytest.mark.parametrize("rows", [ODD, [], [(1, "a b", "en", None, 1)], [(None, None, None, None, None)] * 4, [(1, "same WORDS", "en", "a", 1)] * 5 + [(2, "other words same", "en", "b", 1)] * 3])
@pytest.mark.parametrize("held", [10, 1_000_000])
def test_audit_equals_sql(spark, monkeypatch, rows, held):
    monkeypatch.setattr(divergence_audit, "HELD", held)
    monkeypatch.setattr(divergence_audit, "BLOCK_CELLS", held)
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({"term": F.lit("t"), "n": F.lit(1), "salt": F.lit(0)})
    got = _query(divergence_audit, "op12_divergence_audit", spark, monkeypatch, documents=docs)
    equals_sql(got, divergence_audit.ORACLE_SQL["op12_divergence_audit"], documents=docs.toArrow())


def test_whole_numbers_beyond_64_bits(spark):
    """10**9 (count + 1) does not fit a long; the quotient does."""
    rows = [(10**13, 3 * 10**13 + 7, 10**8), (0, 0, 1), (9_300_000_000, 9_300_000_000, 5)]
    p = divergence_audit._p(F.col("c"), F.col("n"), F.col("v"))
    got = spark.createDataFrame(rows, "c long, n long, v long").select(p.alias("p")).collect()
    assert [r.p for r in got] == [1 + 10**9 * (c + 1) // (n + v) for c, n, v in rows]


def test_radix_selection(spark):
    """Ties at the last place, at long common beginnings too, values over all bits, small and empty groups."""
    rng = random.Random(3)
    rows = [("big", rng.choice([0, 5, 2**16, 2**33, 2**59 + rng.randrange(3)]), f"w{i}") for i in range(3000)]
    rows += [("tied", 7, "same beginning é" * (i % 3) + f"{i:04d}") for i in range(500)] + [("tied", 9, "up")]
    rows += [("byte", 1, "ab" * k) for k in range(1, 60)] + [("few", 3, "x"), ("few", 3, "y")] + [(None, 1, "n")] * 0
    frame = spark.createDataFrame(rows, "g string, v long, w string")
    got = divergence_audit.top_rows(frame, ["g"], "v", "w", 50).collect()
    want = set()
    for g in {r[0] for r in rows}:
        want |= set(sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2].encode()))[:50])
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert divergence_audit.top_rows(frame.limit(0), ["g"], "v", "w", 50).count() == 0


URLS = ["http://A.example.com/en/7.html", "x", None, "", "http://b.example.com/de/1?q=/en/", "https://c.net", "https://c.net/", "ftp://www.example.net/en/3#x", "http://www.example.net/de/3",
        "http://org/fr/2/", "http://u@h.co.uk:80/5", "http://h.co.uk/fr/6", "http://10.0.0.1/9", "://", "http://x.org://y/fr/", "http://porg/fr/1", "HTTP://Ü.ORG/fr/8", "http://a.net\n/b/1"]


def test_hosts_and_paths(spark):
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")
    rows = pages.select("page_id", url_reputation.host_of(F.col("url")).alias("h"), url_reputation.path_of(F.col("url")).alias("p")).orderBy("page_id").collect()
    want = []
    for u in URLS:
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        path = rest[cut:]
        end = min((path.find(c) for c in "?#" if c in path), default=len(path))
        want.append(("".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), path[:end]))
    assert [(r.h, r.p) for r in rows] == want


@pytest.mark.parametrize("hot", [1000, 1])
def test_reputation_equals_sql(spark, monkeypatch, hot):
    monkeypatch.setattr(url_reputation, "HOT", hot)
    rng = random.Random(4)
    urls = URLS + [f"http://{'bad' if i % 2 else 'good'}{i % 6}.{'evil.example' if i % 4 == 1 else 'fine.example'}/x/{i}" for i in range(400)] + ["http://hot.net/9"] * 50
    pages = spark.createDataFrame([(i if i % 7 else None, u, "t") for i, u in enumerate(urls)], "page_id long, url string, host string").withColumn("rule", F.lit(1))
    labels = [(i, int(rng.random() < (0.05 if i % 2 else 0.95)), 0) for i in range(400)] + [(9, None, None), (None, 0, 1), (11, 1, 1), (11, 1, 0)]
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = _query(url_reputation, "op13_url_reputation", spark, monkeypatch, pages=pages, labels=labels)
    rows = got.collect()
    assert {r.verdict for r in rows if r.rule is None and r.host.startswith("bad")} == {"block"}
    assert {r.verdict for r in rows if r.rule is None and r.host.startswith("good")} == {"allow"}
    assert {r.verdict for r in rows if r.host == "hot.net"} == {"block"} and len(rows) == len(urls)
    equals_sql(got, url_reputation.ORACLE_SQL["op13_url_reputation"], pages=pages.toArrow(), labels=labels.toArrow())


@pytest.mark.parametrize("pages", [[], [(1, None)], [(None, "http://a.b/1")] * 3])
def test_reputation_of_few_pages(spark, monkeypatch, pages):
    pages = spark.createDataFrame(pages, "page_id long, url string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = _query(url_reputation, "op13_url_reputation", spark, monkeypatch, pages=pages, labels=labels)
    assert [r.verdict for r in got.collect()] == ["allow"] * pages.count()
    equals_sql(got, url_reputation.ORACLE_SQL["op13_url_reputation"], pages=pages.toArrow(), labels=labels.toArrow())


def test_reputation_shrinks(spark):
    """Few bad outcomes do not block a host of a good domain; the same in a bad domain do; columns that clash stay."""
    rows = [(f"h{i}.good.example", 50, 50, 2) for i in range(20)] + [("new.good.example", 2, 2, 2)]
    rows += [(f"h{i}.bad.test", 50, 50, 48) for i in range(20)] + [("new.bad.test", 2, 2, 2), ("none.bad.test", 1, 0, 0)]
    got = {r.host: r for r in url_reputation.reputations(spark.createDataFrame(rows, "host string, pages long, n long, bad long")).collect()}
    assert got["new.good.example"].verdict == "allow" and got["new.bad.test"].verdict == "block"
    assert got["new.good.example"].mean < 0.5 < got["new.bad.test"].bound < got["new.bad.test"].mean
    pages = spark.createDataFrame([("http://h1.bad.test/1", "mine")], "url string, verdict string")
    outcomes = spark.createDataFrame([("http://h1.bad.test/2", True)] * 40, "url string, bad boolean")
    row = url_reputation.judged(pages, outcomes, rules=[]).first()
    assert (row.verdict, row._verdict) == ("mine", "block")
