import hashlib
import random
import re
from collections import Counter

from transitloom.llm import exact_dedup, jaccard_join
from transitloom.llm.common import components, new_path

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def shingle_set(text):
    w = re.findall(r"[a-z0-9\x80-\U0010ffff]+", (text or "").lower())
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_links(rows, threshold=0.8):
    sets = [shingle_set(t) for _, t in rows]
    links = [set() for _ in rows]
    for i in range(len(rows)):
        for j in range(i):
            both, either = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if either == 0 or both >= threshold * either - 1e-9:
                links[i].add(j), links[j].add(i)
    return links


def brute_classes(links):
    comp = list(range(len(links)))

    def find(i):
        while comp[i] != i:
            comp[i] = comp[comp[i]]
            i = comp[i]
        return i

    for i, others in enumerate(links):
        for j in others:
            comp[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(links))]


def test_jaccard_join_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    links = brute_links(rows)
    comp = brute_classes(links)
    got = {r.doc_id: r for r in jaccard_join.op4_jaccard_join(spark, SF).collect()}
    assert len(got) == len(rows)
    for i, (doc_id, _) in enumerate(rows):
        assert (got[doc_id].links, got[doc_id].class_id) == (len(links[i]), rows[comp[i]][0])
        assert got[doc_id].kept == (comp[i] == i)


def test_jaccard_join_blocks_of_a_large_cluster(spark, monkeypatch):
    rng = random.Random(3)
    base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    rows = []
    for i in range(60):
        text = list(base)
        for _ in range(rng.randrange(5)):
            text[rng.randrange(200)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(text)))
    rows += [(100 + i, r[1].upper()) for i, r in enumerate(rows[:9])]
    links = brute_links(rows)
    comp = brute_classes(links)
    monkeypatch.setattr(jaccard_join, "BLOCK", 8)
    monkeypatch.setattr(jaccard_join, "COLUMNS", 64)
    got = {r.doc_id: r for r in jaccard_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[r[0]].links for r in rows] == [len(x) for x in links]
    assert [got[r[0]].class_id for r in rows] == [rows[c][0] for c in comp]


def test_jaccard_join_odd_rows(spark):
    long = " ".join(f"v{i}" for i in range(30000))
    rows = [(1, None), (2, ""), (3, "one two"), (3, "one two"), (None, "ONE two"), (5, long), (6, long + " end"), (7, "?!")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'a' AS bands", "1 AS row_no", "2 AS of")
    got = jaccard_join.jaccard_join(docs).collect()
    assert len(got) == len(rows)
    assert sorted((r.doc_id or -1, r.class_id, r.links, r.class_size) for r in got) == sorted(
        [(1, 1, 2, 3), (2, 1, 2, 3), (7, 1, 2, 3), (3, 3, 2, 3), (3, 3, 2, 3), (-1, 3, 2, 3), (5, 5, 1, 2), (6, 5, 1, 2)]
    )
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 5]
    assert jaccard_join.jaccard_join(docs.where("false")).count() == 0


def test_bands_reach_recall():
    for threshold in (0.5, 0.7, 0.8, 0.9):
        bands, rows = jaccard_join.choose_bands(threshold, 0.99)
        assert 1 - (1 - threshold**rows) ** bands >= 0.99 and bands * rows <= 256


def test_components_of_a_chain(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 105), (105, 103)]
    got = dict(components(spark.createDataFrame(chain, "a long, b long"), "t").collect())
    assert got == {i: 0 for i in range(41)} | {100: 100, 103: 100, 105: 100}


def test_exact_dedup(spark):
    long = "Z" * 300_000
    rows = [(1, "Ab"), (2, "aB"), (3, None), (4, ""), (5, "Ä"), (6, "ä"), (7, long), (7, long), (None, "ab"), (8, " ab")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS digest", "1 AS batch", "2 AS keep_id")
    index = exact_dedup.DigestIndex(spark, new_path(spark, "index"))
    got = index.add(docs).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append((r.keep_id, r.group_size, r.kept))
    assert by[1] == [(2, 3, False)] and by[2] == [(2, 3, True)] and by[None] == [(2, 3, False)]
    assert by[3] == [(4, 2, False)] and by[4] == [(4, 2, True)] and by[5] == [(5, 1, True)] and by[6] == [(6, 1, True)]
    assert sorted(by[7]) == [(7, 2, False), (7, 2, True)]
    assert {bytes(r.digest).hex() for r in got if r.doc_id == 1} == {hashlib.sha256(b"ab").hexdigest()}
    # a later batch, through an index opened again at the same place
    later = exact_dedup.DigestIndex(spark, index.location)
    got = {r.doc_id: (r.keep_id, r.kept) for r in later.add(spark.createDataFrame([(90, "AB"), (91, "new")], "doc_id long, text string")).collect()}
    assert got == {90: (2, False), 91: (91, True)}
    assert later.entries().count() == 7
    assert later.add(docs.where("false")).count() == 0


def test_index_is_read_by_bucket(spark):
    index = exact_dedup.DigestIndex(spark, new_path(spark, "index"))
    index.add(spark.createDataFrame([(1, "a")], "doc_id long, text string"))
    plan = index.entries()._jdf.queryExecution().toString()
    assert index.entries().groupBy("digest").count()._jdf.queryExecution().executedPlan().toString().count("Exchange") == 0, plan


def test_index_is_compacted(spark):
    index = exact_dedup.DigestIndex(spark, new_path(spark, "index"), buckets=2)
    for batch in range(3):
        index.add(spark.createDataFrame([(k, f"text {k % 40}") for k in range(batch * 20, batch * 20 + 30)], "doc_id long, text string"))
    whole = index.compact(new_path(spark, "index"))
    assert whole.buckets == exact_dedup.BUCKETS
    rows = lambda i: sorted((r.digest.hex(), r.keep_id) for r in i.entries().collect())
    assert rows(whole) == rows(index) and len(rows(whole)) == 40
    again = whole.add(spark.createDataFrame([(500, "TEXT 7"), (501, "new")], "doc_id long, text string"))
    assert sorted((r.doc_id, r.keep_id, r.kept) for r in again.collect()) == [(500, 7, False), (501, 501, True)]
    plan = spark.table(whole.name).groupBy("digest").count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    for i in (index, whole):
        i.close()
    assert exact_dedup.buckets_for(10**9) == 256 and exact_dedup.buckets_for(1) == exact_dedup.BUCKETS


def test_a_batch_again_gives_its_first_answer(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a"), (2, "A"), (3, "b"), (None, "c")], "doc_id long, text string")
    index = exact_dedup.DigestIndex(spark, f"file://{tmp_path}/index", buckets=4)
    first = sorted(map(str, index.add(docs, "monday").collect()))
    # a run that failed half way through its append: what is there stays, what is not comes
    half = exact_dedup.DigestIndex(spark, f"file://{tmp_path}/half", buckets=4)
    half.append(index.entries().limit(1))
    for one in (index, half):
        assert sorted(map(str, one.add(docs, "monday").collect())) == first
        assert one.entries().count() == 3
        later = one.add(docs, "tuesday").collect()
        assert not any(r.kept for r in later) and sorted(str(r.keep_id) for r in later) == ["2", "2", "3", "None"]


def test_join_of_rows_without_ids(spark):
    """Null and repeated ids with different texts: each text is fetched for its own member, and copies link."""
    texts = [" ".join(f"w{i}x{j}" for j in range(30)) for i in range(60)]
    rows = [(None, t) for t in texts] + [(5, t + " tail") for t in texts] + [(None, texts[0])] * 20 + [(None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard_join.jaccard_join(docs).collect()
    assert len(got) == len(rows)
    sizes = Counter((r.class_size, r.links) for r in got)
    assert sizes == {(2, 1): 118, (22, 21): 22, (1, 0): 1}
    fetched = jaccard_join.keep_one(docs)
    assert fetched.count() == 61
