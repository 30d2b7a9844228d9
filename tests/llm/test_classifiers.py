import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from transitloom.llm import quality, toxicity
from transitloom.llm.labelled import logistic

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def auc(y, s):
    order = np.argsort(s, kind="stable")
    rank = np.empty(len(s))
    rank[order] = np.arange(1, len(s) + 1)
    return (rank[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (len(y) - y.sum()))


@pytest.mark.parametrize(("query", "label", "folds", "held", "cut", "least"), [(quality.op10_quality, "quality", 3, 1, 0.5, 0.95), (toxicity.op6_toxicity, "toxic", 4, 2, 0.3, 0.85)])
def test_held_out_accuracy(spark, query, label, folds, held, cut, least):
    sf = "/root/testdata/sf0.01"
    rows = query(spark, sf).collect()
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == held)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= cut)
    found = [r for r in rows if r.held_out and r.doc_id in labels]
    assert auc(np.array([labels[r.doc_id] for r in found]), np.array([r.score for r in found])) >= least


@pytest.mark.parametrize(("module", "label"), [(quality, "quality"), (toxicity, "toxic")])
def test_odd_rows_and_labels(spark, module, label):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "word " * 60_000, "en", "s", 300_000), (3, "again", "en", "s", 5), (None, "null id", "en", "s", 7)]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS score", "'x' AS label", "2 AS metadata", "3 AS score_text", "4 AS score_metadata", "5 AS _score_text")
    no_labels = spark.createDataFrame([], f"doc_id long, {label} int")
    fitted = module.fit(docs, no_labels)
    score = (lambda d: module.score(d, *fitted)) if module is toxicity else (lambda d: module.score(d, fitted))
    assert {r.score for r in score(docs).collect()} == {0.0 if module is toxicity else 1.0}
    rng = random.Random(1)
    say = lambda bad: " ".join(rng.choice(["nasty", "trash!!"] if bad and rng.random() < 0.3 else [f"calm{k}" for k in range(60)]) for _ in range(40))
    many = [(i, say(i % 2), "en", "s", 100) for i in range(10, 250)]
    more = docs.union(spark.createDataFrame(many, SCHEMA).selectExpr("*", "1 AS score", "'x' AS label", "2 AS metadata", "3 AS score_text", "4 AS score_metadata", "5 AS _score_text"))
    labels = spark.createDataFrame([(i, i % 2) for i in range(10, 250)] + [(10, None), (None, 1), (11, 1)], no_labels.schema)
    fitted = module.fit(more, labels)
    got = {}
    for r in score(more).collect():
        got.setdefault(r.doc_id, []).append(r.score)
    assert len(got[3]) == 2 and all(0 <= s <= 1 for x in got.values() for s in x)
    assert np.mean([got[i][0] for i in range(11, 250, 2)]) > np.mean([got[i][0] for i in range(10, 250, 2)]) + 0.5
    assert score(docs.where("false")).count() == 0
    if module is quality:
        kept = module.accepted(more, fitted)
        assert kept.columns == more.columns and kept.count() == sum(s >= module.CUT for x in got.values() for s in x)


def test_pairs_by_the_sum_of_squares():
    rng = np.random.default_rng(3)
    fm = quality.FactorisationMachine([], 0.3, rng.normal(size=20), rng.normal(size=(20, 4)))
    slots, values, offsets = np.array([1, 5, 7, 2, 3, 19, 0]), rng.normal(size=7), np.array([0, 3, 4, 7])
    got, _ = fm.margins(slots, values, offsets)
    for i in range(3):
        s, x = slots[offsets[i] : offsets[i + 1]], values[offsets[i] : offsets[i + 1]]
        pairs = sum(fm.factors[s[a]] @ fm.factors[s[b]] * x[a] * x[b] for a in range(len(s)) for b in range(a))
        assert got[i] == pytest.approx(0.3 + fm.linear[s] @ x + pairs)


def hashed(text):
    """Word, beginnings and word before of each word of one text."""
    (_, _, word, starts, before), *_ = toxicity._tokens(pa.array([text]))
    return word, starts, before


def plain_kneser_ney(texts, corpus):
    """P(word, word before, class) by dictionaries, from (label, class of copies, text) and the texts of all documents."""
    d, levels = toxicity.DISCOUNT, toxicity.LEVELS
    split = lambda t: list(zip(["", *t.split()], t.split()))
    shared = {}
    for t in corpus:
        for u, w in split(t):
            shared.setdefault(w, set()).add(u)
    known = {w for _, _, t in texts for w in t.split()}
    cut = [lambda w: w, *(lambda w, n=n: w.encode()[:n] for n in levels)]
    base = [{} for _ in cut]
    for w in known:
        for k, f in enumerate(cut):
            base[k][f(w)] = base[k].get(f(w), 0) + len(shared[w])
    whole = sum(base[0].values())

    def p(word, before, label):
        pairs = {(u, w, of) for c, of, t in texts if c == label for u, w in split(t)}
        n = {}
        for u, w, _ in pairs:
            n[u, w] = n.get((u, w), 0) + 1
        step = 1.0
        for k in (2, 1, 0):
            f = cut[k]
            count = {}
            for _, w in n:
                count[f(w)] = count.get(f(w), 0) + 1
            total = max(1, sum(count.values()))
            rest = 1 - sum(max(c - d, 0) for c in count.values()) / total
            up = base[k + 1].get(cut[k + 1](word), 1) if k < 2 else whole
            ratio = base[k][f(word)] / up if f(word) in base[k] else 1.0
            step = max(count.get(f(word), 0) - d, 0) / total + rest * ratio * step
        after = sum(c for (u, _), c in n.items() if u == before)
        kept = sum(max(c - d, 0) for (u, _), c in n.items() if u == before)
        return max(n.get((before, word), 0) - d, 0) / max(after, 1) + (1 - kept / max(after, 1)) * step

    return p, known


def test_scores_equal_a_plain_kneser_ney(spark):
    rng = random.Random(4)
    vocabulary = ["north", "wind", "windy", "windowless", "windowsill", "calm", "calmer", "sea", "ünder", "x"]
    texts = [(c, k // 2, " ".join(rng.choices(vocabulary, [1 + (c if w.startswith("wind") else 1 - c) for w in vocabulary], k=30))) for c in (0, 1) for k in range(40 * c, 40 * c + 24)]
    corpus = [t for _, _, t in texts] + [" ".join(rng.choices([*vocabulary, "windows", "other"], k=20)) for _ in range(60)]
    own = spark.createDataFrame(texts, "label int, class_id long, text string")
    counts = toxicity.shared_counts(spark.createDataFrame([(t,) for t in corpus], "text string").repartition(3))
    kn = toxicity.kneser_ney(*toxicity.class_tables(own, counts))
    p, known = plain_kneser_ney(texts, corpus)
    for c in (0, 1):  # of what the sample knows, the shares of a context add up
        assert sum(p(w, "north", c) for w in known) == pytest.approx(1)
    probe = "windy sea north windowpane windows calm unheard calm x north wind windowless ünder ü"
    got = kn.ratios(*hashed(probe))
    said = probe.split()
    want = [np.log(p(w, u, 1) / p(w, u, 0)) for u, w in zip(["", *said], said)]
    assert got == pytest.approx(np.clip(want, -toxicity.CLIP, toxicity.CLIP))
    assert max(abs(got)) > 0.5


def test_repeated_words_tell_nothing(spark):
    own = spark.createDataFrame([(c, k, "ab ab cd") for c in (0, 1) for k in range(9)], "label int, class_id long, text string")
    kn = toxicity.kneser_ney(*toxicity.class_tables(own, toxicity.shared_counts(own)))
    assert kn.ratios(*hashed("ab ab cd zz")) == pytest.approx([0, 0, 0, 0])


def test_logistic_regression():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 2))
    y = (rng.random(4000) < 1 / (1 + np.exp(-(2 * x[:, 0] - x[:, 1] + 0.5)))).astype(float)
    assert logistic(x, y, np.ones(4000)) == pytest.approx([2, -1, 0.5], abs=0.2)


def test_shared_counts_are_exact_for_common_words(spark, monkeypatch):
    """Over two tasks that both see some of a word's contexts."""
    texts = [" ".join(f"ctx{k} common" for k in range(lo, lo + 1500)) + " rare" for lo in (0, 1000)]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(2)
    counts = toxicity.shared_counts(docs)
    assert len(toxicity.common_words(docs)) < toxicity.COMMON
    # "common" has 2500 contexts; ctx0 and ctx1000 begin a text, and the latter also follows "common"
    assert sorted(r.n for r in counts.collect()) == [1] * 2500 + [2, 2500]
    word = hashed("common")[0]
    monkeypatch.setattr(toxicity, "common_words", lambda _: word)
    assert sorted(r.n for r in toxicity.shared_counts(docs).collect()) == [1] * 2500 + [2, 2500]


def test_a_label_with_a_single_class_of_copies(spark):
    rows = [(k, f"calm words number {k} about sea{k % 3} and wind", 0) for k in range(12)] + [(20, "nasty nasty trash", 1), (21, "nasty nasty trash", 1)]
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(k, y) for k, _, y in rows], "doc_id long, toxic int").where(toxicity.fold(toxicity.F.col("doc_id"), 4) != 2)
    model, calibration = toxicity.fit(docs, labels)
    assert model is not None
    assert all(0 <= r.score <= 1 for r in toxicity.score(docs, model, calibration).collect())
