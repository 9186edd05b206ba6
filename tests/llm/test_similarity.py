"""The pipeline's near-dedup stage against brute force over sets of shingles."""

from __future__ import annotations

import random

import corpus_pipeline

from rangeloom.llm import simhash, similarity


def five(t):
    w = (t or "").lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(len(w) - 4, 1))}


def jaccard(a, b):
    return len(five(a) & five(b)) / len(five(a) | five(b))


def kept(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    return {r.doc_id for r in corpus_pipeline.near(spark, docs, "").collect()}


def test_edited_copies_go(spark):
    random.seed(1)
    texts, copies = [], set()
    for n in (64, 120, 400):
        for _ in range(8):
            words = [f"w{random.randrange(5000)}" for _ in range(n)]
            edited = list(words)
            for at in range(n // 60):  # far apart, so that each costs five shingles
                edited[at * 50 + 10] = "edited"
            texts.append(" ".join(words))
            copies.add(len(texts))
            texts.append(" ".join(edited))
    assert all(jaccard(texts[i], texts[i - 1]) >= 0.8 for i in copies)
    far = [i for i in copies if (simhash.fingerprint(texts[i]) ^ simhash.fingerprint(texts[i - 1])).bit_count() > 2]
    assert len(far) > 10  # beyond op7's radius
    assert kept(spark, texts) == set(range(len(texts))) - copies


def test_unlike_texts_of_common_buckets_stay(spark, monkeypatch):
    """With one key a band all of these meet; what is unlike a leader is looked at again, what is unlike all stays."""
    monkeypatch.setattr(similarity, "band_keys", lambda least: similarity.np.array([1], similarity.np.int64))
    random.seed(2)
    base = [" ".join(f"w{random.randrange(900)}" for _ in range(80)) for _ in range(12)]
    texts = base + [t + " end" for t in base]
    for leaders in ((2, None), (None,)):
        monkeypatch.setattr(similarity, "LEADERS", leaders)
        assert kept(spark, texts) == set(range(12))
    assert kept(spark, base + ["", " "]) == set(range(13))
    assert kept(spark, []) == set()


def linked(n, pairs):
    """The smallest of 0 to n - 1 that pairs reach from each one."""
    root = {i: i for i in range(n)}
    for i, j in pairs:
        a, b = root[i], root[j]
        root = {k: min(a, b) if r in (a, b) else r for k, r in root.items()}
    return root


def test_fingerprints_link_without_bands(spark, monkeypatch):
    """Without any band all that leads to a copy are op7's tables: what is alike and in one group of fingerprints within
    the radius is linked, by brute force over all pairs; other near copies aren't reached and stay."""
    monkeypatch.setattr(similarity, "band_keys", lambda least: similarity.np.array([], similarity.np.int64))
    random.seed(3)
    texts = ["", "one", "one two"]
    for n in (150, 300, 600):
        for _ in range(8):
            words = [f"w{random.randrange(5000)}" for _ in range(n)]
            texts += [" ".join(words), " ".join([*words, "end"]), " ".join([*words, "end", "of", "it"])]
            for at in random.sample(range(n), n // 60):
                words[at] = "edited"
            texts.append(" ".join(words))
    assert len(kept(spark, texts)) < len(texts) - 20
    sets = [{" ".join(w[i : i + 3]) for i in range(max(len(w) - 2, 1))} if (w := t.split()) else set() for t in texts]
    fps = [sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in own) > len(own)) for own in ([similarity.xxhash.xxh64_intdigest(x, 42) for x in s] for s in sets)]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i)]
    near = linked(len(texts), [(i, j) for i, j in pairs if (fps[i] ^ fps[j]).bit_count() <= 4])
    like = [(i, j) for i, j in pairs if jaccard(texts[i], texts[j]) >= 0.8]
    want = linked(len(texts), [(i, j) for i, j in like if near[i] == near[j]])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert {r.doc_id: r.component_id for r in similarity.similar_groups(docs).collect()} == want
    assert want != linked(len(texts), like)


def test_like_fingerprints_are_checked_exactly(spark, monkeypatch):
    monkeypatch.setattr(similarity, "band_keys", lambda least: similarity.np.array([], similarity.np.int64))
    monkeypatch.setattr(similarity, "bits", lambda text: 1, raising=False)
    random.seed(5)
    unlike = [" ".join(f"w{random.randrange(5000)}" for _ in range(80)) for _ in range(6)]
    assert kept(spark, [*unlike, unlike[0] + " end", ""]) == {0, 1, 2, 3, 4, 5, 7}


def test_links_of_one_bucket_by_brute_force(spark, monkeypatch):
    """Copies of one text with few or many edits, all in one bucket: linked as all pairs link them, with a like
    pair found where just one of it is like the leader."""
    monkeypatch.setattr(similarity, "band_keys", lambda least: similarity.np.array([1], similarity.np.int64))
    random.seed(4)
    base = [f"w{random.randrange(5000)}" for _ in range(100)]
    texts = []
    for _ in range(60):
        words = list(base)
        for at in random.sample(range(100), random.choice([1, 2, 3, 4, 6, 9])):
            words[at] = f"e{random.randrange(3)}"
        texts.append(" ".join(words))
    root = {i: i for i in range(len(texts))}
    for i in range(len(texts)):
        for j in range(i):
            if jaccard(texts[i], texts[j]) >= 0.8:
                a, b = root[i], root[j]
                root = {k: min(a, b) if r in (a, b) else r for k, r in root.items()}
    for leaders in ((2, 4, None), (None,)):
        monkeypatch.setattr(similarity, "LEADERS", leaders)
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
        got = {r.doc_id: r.component_id for r in similarity.similar_groups(docs).collect()}
        assert got == root and 3 < len(set(root.values())) < 50


def test_signs_tell_like_from_unlike():
    """Few pairs of similarity 0.8 are called implausible, and few of 0.5 plausible."""
    rng = similarity.np.random.default_rng(0)

    def misses(both, each):
        x = rng.integers(0, 1 << 63, both + 2 * each, dtype=similarity.np.uint64)
        a, b = (similarity.signs(similarity.min_hashes(y)) for y in (x[: both + each], similarity.np.concatenate([x[:both], x[both + each :]])))
        return sum(bin((v | v >> 1) & 0x5555555555555555).count("1") for v in (int(p) % (1 << 64) ^ int(q) % (1 << 64) for p, q in zip(a, b, strict=True)))

    assert all(misses(80, 10) <= similarity.MISSES for _ in range(300))
    assert all(misses(50, 25) > similarity.MISSES for _ in range(300))


def test_check_is_exact():
    for inter, a, b in ((8, 10, 8), (8, 9, 9), (7, 8, 8), (80, 90, 90), (79, 90, 90)):
        x = similarity.np.arange(a, dtype="u8")
        y = similarity.np.arange(a - inter, a - inter + b, dtype="u8")
        assert similarity.alike(x, y) == (5 * inter >= 4 * (a + b - inter))
