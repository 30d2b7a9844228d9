import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from transitloom.llm import mixing, sharding

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def waterfill(sizes):
    """Targets by the contract's own words: stop at the cap, share the excess again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    capped, total = {}, sum(sizes.values())
    while True:
        free = [s for s in names if s not in capped]
        rest, w = total - sum(capped.values()), sum(weight[s] for s in free)
        share = {s: rest * weight[s] / w for s in free} if w else {}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return capped | share
        capped |= {s: 3.0 * sizes[s] for s in over}


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 900, "c": 5, None: 40}, {"b": 10}, {"a": 0, "b": 7, "c": 0}, {"a": 1, "b": 1, "c": 1000, "d": 3}])
def test_targets(spark, sizes):
    got = mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long"))
    assert {r.source: r.target for r in got.collect()} == pytest.approx(waterfill(sizes))


def test_permutations_are_bijections():
    for n in (1, 2, 3, 10, 257, 5000):
        assert sorted(mixing._permute(np.arange(n), n, 5).tolist()) == list(range(n))


@pytest.mark.parametrize("quotas", [[700, 3, 0, 297], [5 * 10**9, 2 * 10**9 + 7, 3], [10**15, 1]])
def test_shard_counts_add_up(quotas):
    """One law for all sizes, beyond 10**9 slots as well."""
    shards = 7
    found = [mixing.shard_counts(s, shards, quotas) for s in range(shards)]
    assert np.sum([c for c, _ in found], 0).tolist() == quotas
    for s in range(1, shards):
        assert found[s][1] == [a + b for a, b in zip(found[s - 1][0], found[s - 1][1], strict=True)]
    for counts, _ in found:
        for c, q in zip(counts, quotas, strict=True):
            assert abs(c - q / shards) <= 6 * (q / shards) ** 0.5 + 3


@pytest.mark.parametrize("size, words", [(1, 4), (10, 4), (100, 16), (97, 16), (128, 128), (1000, 7)])
def test_quotas_meet_the_target_to_the_word(size, words):
    blocks = -(-size // words)
    key = lambda epoch: 77 + epoch
    orders = [mixing._permute(np.arange(blocks), blocks, key(e)).tolist() for e in range(4)]
    for e, order in enumerate(orders):
        assert [mixing._place_of(b, blocks, key(e)) for b in order] == list(range(blocks))
    for target in range(3 * size + 1):
        n, limit = mixing.quota(size, target, words, key)
        sizes = [min(words, size - orders[k // blocks][k % blocks] * words) for k in range(n)]
        if limit is not None:
            assert 0 < limit < sizes[-1]
            sizes[-1] = limit
        assert sum(sizes) == target


def test_shard_counts_are_multinomial():
    draws = np.array([mixing.shard_counts(1, 3, [60], seed)[0][0] for seed in range(2000)])
    assert draws.mean() == pytest.approx(20, abs=0.5) and draws.var() == pytest.approx(60 * (1 / 3) * (2 / 3), rel=0.15)


def dealt(made, words_of, block_words):
    """The deal by hand: the words of every slot's block, from the documents' places in their sources' streams."""
    streams = {}
    for r in made.documents.collect():
        stream = streams.setdefault(r["rank"], {})
        for k, w in enumerate(words_of(r)):
            assert r["at"] + k not in stream
            stream[r["at"] + k] = (r.row_no, w)
    assert all(sorted(s) == list(range(len(s))) for s in streams.values())
    taken, slots = {}, {}
    for r in made.slots.collect():
        stream = streams[r["rank"]]
        words = [stream[k] for k in range(r.block * block_words, (r.block + 1) * block_words) if k in stream][: r.limit]
        assert words and (r.shard, r.slot) not in slots
        slots[r.shard, r.slot] = (r["rank"], r.epoch, r.block, " ".join(w for _, w in words))
        for row, _ in words:
            taken[row] = taken.get(row, 0) + 1
    return taken, slots


def test_taken_equals_a_deal_by_hand(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_SLOTS", 20)
    texts = [" ".join(f"d{i}w{j}" for j in range(n)) for i, n in enumerate((300, 5, 0, 1000, 40, 7, 90, 16, 16, 33))]
    rows = [(i, w, "en", ["a", "b", "c", None][i % 4], len(w)) for i, w in enumerate(texts)] + [(20, texts[4], "en", "a", 1), (20, texts[4], "en", "a", 1), (21, None, "en", "b", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    by_id = {r[0]: r[1] for r in rows}
    made = mixing.mix(docs, block_words=16)
    by_hand, slots = dealt(made, lambda r: (by_id[r.doc_id] or "").split(), 16)
    got = {r.row_no: r.taken for r in made.taken().groupBy("row_no").agg(F.sum("words").alias("taken")).collect()}
    assert got == by_hand
    blocks = mixing.mixed_blocks(docs, block_words=16).collect()
    assert {(r.shard, r.slot): (r["rank"], r.epoch, r.block, r.words) for r in blocks} == slots and len(blocks) == len(slots)
    shards = {}
    for shard, slot in slots:
        shards.setdefault(shard, []).append(slot)
    assert len(shards) > 1 and all(sorted(x) == list(range(len(x))) for x in shards.values())
    times = {}
    for rank, epoch, block, _ in slots.values():  # a block comes again only when all others came as often
        times.setdefault(rank, {}).setdefault(block, []).append(epoch)
    for per_block in times.values():
        assert all(sorted(e) == list(range(len(e))) for e in per_block.values()) and max(map(len, per_block.values())) - min(map(len, per_block.values())) <= 1


def test_mix_of_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = mixing.op5_mixing(spark, sf).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(rows) == len(docs)
    sizes, taken = {}, {}
    for r in rows:
        assert r.size == len((docs[r.doc_id].text or "").replace("\x1c", "x").split()) or r.size >= 0
        assert 0 <= r.taken <= 3 * r.size
        s = docs[r.doc_id].source
        sizes[s], taken[s] = sizes.get(s, 0) + r.size, taken.get(s, 0) + r.taken
    want = waterfill(sizes)
    for r in rows:
        assert r.target == pytest.approx(want[docs[r.doc_id].source]) and r.source_size == sizes[docs[r.doc_id].source]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 1
    assert mixing.mix(spark.read.parquet(f"{sf}/documents.parquet")).slots.select("shard").distinct().count() == mixing.LEAST_SHARDS
    assert sorted(rows) == sorted(mixing.op5_mixing(spark, sf).collect())


def test_mixed_documents_hold_the_words_taken(spark):
    words = [" ".join(f"d{i}w{j}" for j in range(n)) for i, n in enumerate((300, 5, 0, 1000, 40))]
    rows = [(i, w, "en", "ab"[i % 2], len(w)) for i, w in enumerate(words)] + [(9, None, None, None, None), (4, words[4], "en", "a", 1), (None, "x\ty", "en", "b", 3)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({"plan": F.lit(1), "copy": F.lit("z")})
    made = mixing.mix(docs, block_words=16)
    out = mixing.mixed_documents(docs, block_words=16)
    assert out.columns == docs.columns
    got = out.collect()
    assert sum(len(r.text.split()) for r in got) == made.taken().agg(F.sum("words")).first()[0]
    for r in got:
        source = words[r.doc_id].split() if r.doc_id is not None else ["x", "y"]
        place = [source.index(w) for w in r.text.split()]
        assert place == sorted(set(place)) and r.n_chars == len(r.text)
    assert mixing.mixed_documents(docs.where("false")).count() == 0
    assert mixing.mixed_documents(docs.where("text IS NULL")).count() == 0


def test_shards(spark):
    sf = "/root/testdata/sf0.01"
    rows = sharding.op8_sharding(spark, sf).collect()
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(rows) == len(docs)
    size, slots = {}, {}
    for r in rows:
        raw = docs[r.doc_id].encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 16, zlib.crc32(raw), "bytes", None)
        size[r.shard] = size.get(r.shard, 0) + r["size"]
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(40))
    assert max(abs(s - sum(size.values()) / 40) for s in size.values()) <= max(r["size"] for r in rows)


def test_shards_split_a_hot_group(spark):
    rows = [(i, "same text " * 20 if i % 3 else f"text {i} " * 20) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS shard", "1 AS range")
    got = sharding.shard_keys(docs, 10).groupBy("shard").agg(F.sum("size").alias("s"), F.count("*").alias("n"), F.max("slot").alias("m")).collect()
    assert len(got) == 10 and all(r.n == r.m + 1 for r in got)
    assert max(r.s for r in got) - min(r.s for r in got) <= 2 * 220
    placed = sharding.shard(docs, 10)
    assert placed.columns == [*docs.columns, "_shard", "slot"]
    assert placed._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
    assert {(r.doc_id, r._shard, r.slot) for r in placed.collect()} == {(r.doc_id, r.shard, r.slot) for r in sharding.shard_keys(docs, 10).collect()}
    assert sorted(r["count"] for r in placed.groupBy("_shard").count().collect()) == sorted(r.n for r in got)


def test_ranges_follow_the_bytes(spark, monkeypatch):
    """With a third of the rows equal, no range is much larger than the others, and the splitters are where a sort puts them."""
    monkeypatch.setattr(sharding, "RANGE_BYTES", 20_000)
    rows = [(i, "same text " * 20 if i % 3 == 0 else f"text {i} " * (1 + i % 40)) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    keyed = docs.select(sharding._own(docs).alias("own")).select("own.*")
    split, bounds = sharding.splitters(keyed, 4)
    total = sum(len(t) + 16 for _, t in rows)
    counts = sharding.count_below(keyed, bounds)
    assert len(bounds) + 1 >= total / 20_000 and max(c[1] for c in counts) <= 1.6 * total / (len(bounds) + 1) + 216
    keys = sorted((((((r.text_hash + 2**63) << 64) + r.id_order + 2**63) << 64) + r.row_no + 2**63, r["size"]) for r in keyed.collect())
    below = lambda k: sum(n for key, n in keys if key < k)
    for s, k in enumerate(split):
        assert abs(below(k) - total * (s + 1) / 4) <= max(0.001 * total / 4, max(n for _, n in keys))


def test_shards_of_odd_rows(spark):
    rows = [(None, None), (1, ""), (1, ""), (2, "x" * 300_000), (-5, "Ä")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sharding.digest(sharding.shard_keys(docs)).collect()
    assert sorted(r["size"] for r in got) == [16, 16, 16, 18, 300_016]
    assert sharding.shard_keys(docs.where("false")).count() == 0 and sharding.shard(docs.where("false")).count() == 0


def test_repeated_rows_are_cut_apart(spark):
    """3,000 equal rows and 3,000 others: no shard is empty, none is over a row from its share; reruns agree."""
    rows = [(7, "same text " * 9)] * 3000 + [(i, f"text {i} " * 7) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = sharding.shard_keys(docs).collect()
    size, slots = {}, {}
    for r in got:
        size[r.shard] = size.get(r.shard, 0) + r["size"]
        slots.setdefault(r.shard, []).append(r.slot)
    share = sum(size.values()) / 40
    assert len(size) == 40 and max(abs(s - share) for s in size.values()) <= max(106, 0.02 * share)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sorted(map(str, got)) == sorted(map(str, sharding.shard_keys(docs).collect()))
