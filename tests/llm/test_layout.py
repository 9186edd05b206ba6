"""Mixing, sharding and packing against brute force."""

from __future__ import annotations

import random
from collections import Counter
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from rangeloom.llm import mixing, packing, sharding
from rangeloom.llm.common import hash60
from tests.llm.conftest import rows


def words(t):
    return len((t or "").encode().split())


def by_hand(sizes, most=3.0):
    """Targets as the rule is told: give by weight, cut at the limit, share what is left again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(names)}
    target = dict.fromkeys(names, 0.0)
    left, open_ = float(sum(sizes.values())), set(names)
    while open_ and left > 1e-9:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if target[s] + left * weight[s] / total > most * sizes[s]]
        give, left = left, 0.0
        for s in list(open_):
            target[s] += give * weight[s] / total
            if s in over:
                left += target[s] - most * sizes[s]
                target[s] = most * sizes[s]
                open_.discard(s)
    return target


@pytest.mark.parametrize("seed", range(4))
def test_targets(spark, seed):
    rng = random.Random(seed)
    sizes = {s: rng.choice([0, 1, 10, 500, 10_000]) for s in ["b", "a", "é", "zz", None, "B", ""]}
    df = spark.createDataFrame(list(sizes.items()), "source string, size long")
    got = {r.source: r.target for r in mixing.source_targets(df).collect()}
    want = by_hand(sizes)
    assert got.keys() == want.keys()
    assert all(got[s] == pytest.approx(want[s], abs=1e-6) for s in want)


def test_mix_on_odd_rows(odd, empty):
    got = mixing.mix(odd).collect()
    sizes = Counter()
    for r in rows():
        sizes[r[3]] += words(r[1])
    want = by_hand(sizes)
    assert Counter((r.doc_id, r.source, r.size) for r in got) == Counter((r[0], r[3], words(r[1])) for r in rows())
    assert all(r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source]) and 0 <= r.copies <= 3 for r in got)
    mixed = mixing.mixed(odd)
    assert mixed.columns == odd.columns
    assert sum(words(r.text) for r in mixed.collect()) == sum(r.copies * r.size for r in got)
    assert mixing.mix(empty).count() == 0 and mixing.mixed(empty).count() == 0


def test_sampling_is_by_rank_near_target_and_repeats(spark):
    rng = random.Random(1)
    data = [(i, rng.choice("aabc"), int(rng.paretovariate(1.0) * 20) % 5000 + 1) for i in range(6000)]
    sizes = spark.createDataFrame(data, "doc_id long, source string, size long").repartition(5).cache()
    targets = mixing.source_targets(sizes).cache()
    got = mixing.draw(sizes, sizes, targets, seed=3).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.draw(sizes.repartition(2), sizes.repartition(7), targets, seed=3).collect()))
    taken, target = Counter(), {}
    for r in got:
        taken[r.source] += r.copies * r.size
        target[r.source] = r.target
    assert all(abs(taken[s] - target[s]) <= 0.005 * target[s] for s in target)
    # Within a source and band exactly the documents with the lowest Pareto ranks are drawn, as many as come nearest to the need.
    ranked = mixing._rank(sizes.join(targets, "source"), 3, None).withColumn("pi", F.col("__pi")).withColumn("rest", F.col("__rest")).collect()
    copies = {r.doc_id: r.copies for r in got}
    assert len({r.pi for r in ranked if r.source == "a"}) > 100  # inclusion probabilities differ within a source
    want = {}
    for s in target:
        carry, limit = 0.0, 0.0
        for band in sorted({r.band for r in ranked if r.source == s}, reverse=True):
            own = sorted((r for r in ranked if (r.source, r.band) == (s, band)), key=lambda r: r.key)
            sums = [sum(r.size for r in own[:k]) for k in range(len(own) + 1)]
            need = sums[-1] * own[0].rest + max(-limit, min(limit, carry))
            k = min(range(len(sums)), key=lambda k: abs(sums[k] - need))
            carry, limit = need - sums[k], float(2 << band)
            want |= {r.doc_id: r.base + (i < k) for i, r in enumerate(own)}
    assert copies == want
    for gather in (1, 200):  # however few ranks a task may look at
        again = mixing.draw(sizes, sizes, targets, seed=3, gather=gather).collect()
        assert {r.doc_id: r.copies for r in again} == want


def test_weights_shift_inclusion(spark):
    data = [(i, "a" if i % 2 else "b", 10) for i in range(4000)]
    sizes = spark.createDataFrame(data, "doc_id long, source string, size long").cache()
    targets = mixing.source_targets(sizes)
    out = mixing.draw(sizes, sizes, targets, weight=F.when(F.col("doc_id") % 4 < 2, F.lit(3.0)).otherwise(F.lit(1.0))).collect()
    heavy = sum(r.copies for r in out if r.doc_id % 4 < 2)
    assert heavy > 1.3 * sum(r.copies for r in out if r.doc_id % 4 >= 2)
    assert sum(r.copies * r.size for r in out) == pytest.approx(40_000, rel=0.01)


@pytest.mark.parametrize("range_rows", [3, 50, 20_000])
def test_interleaving_by_brute_force(spark, range_rows):
    rng = random.Random(2)
    data = [(i, "x" * rng.randrange(50), rng.choice(["hot"] * 6 + ["a", "b", None])) for i in range(997)]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string").repartition(4)
    got = {r.doc_id: (r.shard, r.slot, r.size, r.text_crc32) for r in sharding.interleave(docs, range_rows=range_rows).collect()}
    crc, size = F.crc32(F.col("text").cast("binary")), F.octet_length("text").cast("long") + 8
    h = {r.doc_id: r.h for r in docs.select("doc_id", hash60(F.lit(23), F.col("doc_id"), F.col("source"), crc, size).alias("h")).collect()}
    order = []
    for s in {d[2] for d in data}:
        own = sorted((d[0] for d in data if d[2] == s), key=lambda i: h[i])
        order += [((k + 0.5) / len(own), s is None, s or "", i) for k, i in enumerate(own)]
    n, shards = len(order), 24
    for at, (_, _, _, i) in enumerate(sorted(order)):
        shard = at * shards // n
        assert got[i][:2] == (shard, at - -(-shard * n // shards))
    assert all(got[d[0]][2:] == (len(d[1]) + 8, crc32(d[1].encode())) for d in data)


def test_a_row_that_is_a_third_of_the_table(spark, monkeypatch):
    """It takes neighbouring places within its source, and no range holds it whole."""
    same, most = (7, "the same", "a"), 40
    data = [same] * 500 + [(i, f"text {i}", random.Random(i).choice("ab")) for i in range(100, 1100)]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string").repartition(4)
    seen = []
    plain = sharding.repeated
    monkeypatch.setattr(sharding, "repeated", lambda df, *a: (seen.append(df.groupBy("source", "hr").count().agg(F.max("count")).first()[0]), plain(df, *a))[1])
    got = sharding.interleave(docs, shards=5, range_rows=most).collect()
    assert seen[0] <= most
    assert sorted((r.shard, r.slot) for r in got) == [(s, k) for s in range(5) for k in range(300)]
    share = Counter(r.shard for r in got if r.source == "a")
    assert max(share.values()) - min(share.values()) <= 2
    bag = plain(spark.createDataFrame([(1, 5), (2, 100_000)], "x long, m long"), "m", "k", 7)
    assert sorted(map(tuple, bag.groupBy("x").agg(F.count("k"), F.count_distinct("k"), F.max("k")).collect())) == [(1, 5, 5, 4), (2, 100_000, 100_000, 99_999)]


def test_shards_on_odd_rows(odd, empty):
    got = sharding.interleave(odd, shards=4, range_rows=2).collect()
    assert Counter((r.doc_id, r.source, r.size) for r in got) == Counter((r[0], r[3], len((r[1] or "").encode()) + 8) for r in rows())
    shards = {k: sorted(r.slot for r in got if r.shard == k) for k in range(4)}
    assert all(s == list(range(len(s))) for s in shards.values()) and {len(s) for s in shards.values()} <= {3, 4}
    assert sharding.interleave(empty).count() == 0


def naive_fit(sizes, sources, clusters, capacity):
    bins: list[dict] = []
    out = []
    for z, s, c in zip(sizes, sources, clusters, strict=True):
        fits = [(b["room"], k) for k, b in enumerate(bins) if b["room"] >= z and b["room"] > 0 and s not in b["s"] and (c < 0 or c not in b["c"])]
        if fits:
            k = min(fits)[1]
        else:
            k = len(bins)
            bins.append({"room": capacity, "s": set(), "c": set()})
        out.append((k, capacity - bins[k]["room"]))
        bins[k]["room"] -= z
        bins[k]["s"].add(s)
        bins[k]["c"].add(c)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_best_fit(seed):
    rng = random.Random(seed)
    n = 300
    sizes = sorted((rng.randrange(1, 100) for _ in range(n)), reverse=True)
    sources = [rng.choice([0, 0, 0, 1, 2, 3]) for _ in range(n)]
    clusters = [rng.choice([-1, -1, 0, 1]) for _ in range(n)]
    at, offset = packing.best_fit(sizes, sources, clusters, 100)
    assert list(zip(at, offset, strict=True)) == naive_fit(sizes, sources, clusters, 100)


@pytest.mark.parametrize("group", [4, 20_000])
def test_packing_is_whole(spark, odd, empty, group):
    got = packing.pack(odd, capacity=16, group=group).collect()
    want = Counter()
    for r in rows():
        want[r[0]] += words(r[1])
    have, used = Counter(), Counter()
    for r in got:
        have[r.doc_id] += r.length
        used[r.bin_id] += r.length
    assert {k: v for k, v in have.items() if v} == {k: v for k, v in want.items() if v} and have.keys() == want.keys()
    assert all(v <= 16 for b, v in used.items() if b >= 0)
    assert {r.bin_id for r in got if r.length == 0} == {-1} and sum(r.length == 0 for r in got) == sum(words(r[1]) == 0 for r in rows())
    for b in {r.bin_id for r in got if r.bin_id >= 0}:
        own = sorted((r.offset, r.length) for r in got if r.bin_id == b)
        assert all(a + n == c for (a, n), (c, _) in zip(own, own[1:], strict=False)) and own[0][0] == 0
        assert len([r for r in got if r.bin_id == b and r.doc_id in (1, 2, 3)]) <= 1  # copies
    assert packing.pack(empty).count() == 0


def test_hot_source_gets_slots(spark):
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.concat(F.lit("a b c d w"), F.col("id")).alias("text"), F.when(F.col("id") % 3 == 0, F.lit("s")).otherwise(F.lit("hot")).alias("source"))
    bins = packing.pack(docs, capacity=500).groupBy("bin_id").count().agg(F.max("count")).first()[0]
    assert bins > 20


def test_bins_hold_the_words(spark, odd):
    packed = packing.pack(odd, capacity=16).cache()
    made = packing.bins(odd, packed).collect()
    text = {}
    for r in rows():
        text.setdefault((r[0], words(r[1])), (r[1] or "").encode().split())
    assert sum(r.length for r in made) == sum(words(r[1]) for r in rows())
    pieces = {}
    for p in packed.where("bin_id >= 0").collect():
        pieces.setdefault(p.bin_id, []).append((p.offset, p.doc_id, p.start, p.length))
    assert {r.bin_id for r in made} == pieces.keys()
    for r in made:
        assert len(r.text.split(" ")) == r.length <= 16
        for (at, i, start, n), got in zip(sorted(pieces[r.bin_id]), r.doc_ids, strict=True):
            assert got == i
            own = r.text.split(" ")[at : at + n]
            assert any(k[0] == i and [w.decode() for w in t[start : start + n]] == own for k, t in text.items())


def test_written_shards(spark, odd, tmp_path):
    sharding.write_shards(odd.drop("shard"), str(tmp_path / "s"), shards=4)
    back = spark.read.parquet(str(tmp_path / "s"))
    got = back.collect()
    assert Counter((r.doc_id, r.text, r.source) for r in got) == Counter((r[0], r[1], r[3]) for r in rows())
    want = Counter((r.doc_id, r.shard) for r in sharding.interleave(odd, shards=4).collect())
    assert Counter((r.doc_id, r.shard) for r in got) == want
