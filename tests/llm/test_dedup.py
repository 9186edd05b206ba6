"""Exact dedup and near-duplicates against brute force."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rangeloom.llm import exact_dedup, simhash
from rangeloom.llm.common import new_path
from rangeloom.llm.components import components
from tests.llm.conftest import rows


def digest(t):
    return hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", t or "").encode()).hexdigest()


def test_exact_on_odd_rows(odd, empty):
    got = exact_dedup.exact_dedup(odd).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("d")).collect()
    groups: dict[str, list] = {}
    for r in rows():
        groups.setdefault(digest(r[1]), []).append(r[0])
    assert len(got) == len(rows())
    for r in got:
        ids = groups[r.d]
        known = [i for i in ids if i is not None]
        assert r.group_size == len(ids) and r.keep_id == (min(known) if known else None)
        assert not r.kept or r.doc_id == r.keep_id
    assert sum(r.kept for r in got) == len(groups)
    assert exact_dedup.exact_dedup(empty).count() == 0
    kept = exact_dedup.keep_first(odd)
    assert kept.columns == odd.columns and sorted(digest(r.text) for r in kept.collect()) == sorted(groups)
    assert exact_dedup.keep_first(empty).count() == 0


def test_index_grows(spark, odd):
    path = new_path(spark, "index")
    index = exact_dedup.DigestIndex(spark, path, buckets=4)
    first = spark.createDataFrame([(5, "a b"), (3, "a  b"), (9, "c")], "doc_id long, text string")
    second = spark.createDataFrame([(1, "a b"), (2, "d"), (4, "d")], "doc_id long, text string")
    assert {r.doc_id: r.kept for r in index.add(first, "one").collect()} == {5: False, 3: True, 9: True}
    spark.sql(f"DROP TABLE {index.name}")  # a later session knows the path only
    again = exact_dedup.DigestIndex(spark, path, buckets=4)
    assert {r.doc_id: (r.keep_id, r.kept) for r in again.add(second, "two").collect()} == {1: (3, False), 2: (2, True), 4: (2, False)}
    assert again.table().count() == 3
    with pytest.raises(ValueError):
        again.add(second, "two")


def test_index_tells_batches_apart(spark):
    """Rows of two batches have the same numbers; without names of their own they are still not taken for each other."""
    index = exact_dedup.DigestIndex(spark, new_path(spark, "index"), buckets=2)
    make = lambda *rows: spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert all(r.kept for r in index.add(make((1, "x"), (2, "y"))).collect())
    assert {r.doc_id: (r.keep_id, r.kept) for r in index.add(make((7, "x"), (8, "z"))).collect()} == {7: (1, False), 8: (8, True)}
    index.drop()


def test_nothing_is_left_in_the_catalogue(spark, odd):
    before = {t.name for t in spark.catalog.listTables()}
    assert exact_dedup.exact_dedup(odd).count() == len(rows())
    assert {t.name for t in spark.catalog.listTables()} == before


def test_any_column_names(spark):
    docs = spark.createDataFrame([(2, "a", 1, 5, "r"), (1, "a", 2, 6, "s"), (3, "b", 3, 7, "t")], "doc_id long, text string, __d int, own int, row string")
    for kept in (exact_dedup.keep_first(docs), simhash.keep_one(docs)):
        assert kept.columns == docs.columns and sorted(map(tuple, kept.collect())) == [(1, "a", 2, 6, "s"), (3, "b", 3, 7, "t")]


def test_keeping_one_by_shuffle_and_broadcast(spark, odd, monkeypatch):
    some = sorted(map(str, simhash.keep_one(odd).collect()))
    monkeypatch.setattr(simhash, "BROADCAST_ROWS", 0)
    assert sorted(map(str, simhash.keep_one(odd).collect())) == some


def slow_fingerprint(t):
    t = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@given(st.text(alphabet="aBÉ \t\n x", max_size=60))
@settings(max_examples=100)
def test_fingerprint(text):
    assert simhash.fingerprint(text) == slow_fingerprint(text)


def test_fingerprint_of_nothing():
    assert simhash.fingerprint(None) == simhash.fingerprint("  ") == 0


@given(st.integers(0, 2**64 - 1), st.sets(st.integers(0, 63), max_size=2))
def test_every_near_pair_meets(x, bits):
    y = x
    for b in bits:
        y ^= 1 << b
    assert any(x & m == y & m for m in simhash.masks(2))


def test_masks_are_selective():
    assert all(28 <= m.bit_count() <= 44 for m in simhash.masks(2))


def reach(fps, radius):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    fps = sorted(fps)
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {f: find(f) for f in fps}


@pytest.mark.parametrize("radius,spread", [(2, 1), (2, 10), (2, 100_000), (1, 1), (1, 100_000), (3, 100_000), (3, 2), (4, 100_000)])
def test_links_reach_what_pairs_reach(spark, radius, spread, monkeypatch):
    random.seed(3)
    fps = set()
    for _ in range(40 if radius < 3 else 12):  # chains, balls and lone values
        x = random.getrandbits(64)
        fps.add(x)
        for _ in range(random.choice([0, 0, 3, 25])):
            for b in random.sample(range(64), random.choice([1, 2, 2, 3] if radius < 3 else [2, 3, 4, 5])):
                x ^= 1 << b
            fps.add(x)
    monkeypatch.setattr(simhash, "CHUNK", 50)
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    links = simhash.near_links(spark.createDataFrame(signed, "fp long").repartition(4), radius, spread).collect()
    got = {f: f for f in fps}

    def find(x):
        while got[x] != x:
            x = got[x]
        return x

    for r in links:
        u, v = r.u % (1 << 64), r.v % (1 << 64)
        x, y = find(u), find(v)
        got[max(x, y)] = min(x, y)
    assert {f: find(f) for f in fps} == reach(fps, radius)


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_links_of_random_balls(radius):
    """Values around one centre, which share names in all ways there are."""
    rng = np.random.default_rng(radius)
    for _ in range(60):
        base = int(rng.integers(0, 1 << 62))
        fps = np.unique(np.array([base ^ sum(1 << int(b) for b in set(rng.choice(8, rng.integers(0, 5)))) for _ in range(rng.integers(2, 14))], np.uint64))
        a, b = simhash._links(fps, simhash._flips(0, radius), radius)
        root = simhash._roots(len(fps), a, b)
        want = reach({int(f) for f in fps}, radius)
        assert {int(f): int(fps[r]) for f, r in zip(fps, root, strict=True)} == want
        assert all((int(fps[x]) ^ int(fps[y])).bit_count() <= radius for x, y in zip(a, b, strict=True))


def test_groups_on_odd_rows(odd, empty):
    got = simhash.near_groups(odd).collect()
    want = reach({slow_fingerprint(r[1]) for r in rows()}, 2)
    ids: dict[int, list] = {}
    for r in rows():
        ids.setdefault(want[slow_fingerprint(r[1])], []).append(r[0])
    assert len(got) == len(rows())
    for r in got:
        assert r.component_id == min((i for i in ids[want[r.fp % (1 << 64)]] if i is not None), default=None)
    kept = simhash.keep_one(odd)
    got = [(want[slow_fingerprint(r.text)], r.doc_id) for r in kept.collect()]
    assert kept.columns == odd.columns and len(got) == len(ids)
    assert set(got) == {(k, min((i for i in x if i is not None), default=None)) for k, x in ids.items()}
    assert simhash.near_groups(empty).count() == 0 and simhash.keep_one(empty).count() == 0


def test_components(spark):
    rng = random.Random(5)
    links = [(i, i + 1) for i in range(100, 160)] + [(200, i) for i in range(201, 300)] + [(rng.randrange(400, 450), rng.randrange(400, 450)) for _ in range(30)] + [(7, 7)]
    root: dict[int, int] = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {x: find(x) for x in root if find(x) != x}


def test_op7_at_sf0001(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    want = reach({slow_fingerprint(d.text) for d in docs}, 2)
    least: dict[int, int] = {}
    for d in docs:
        r = want[slow_fingerprint(d.text)]
        least[r] = min(least.get(r, d.doc_id), d.doc_id)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op7(spark, sf_dir).collect()}
    assert got == {d.doc_id: (f"{slow_fingerprint(d.text):016x}", least[want[slow_fingerprint(d.text)]]) for d in docs}
    assert np.uint64(0) == 0
