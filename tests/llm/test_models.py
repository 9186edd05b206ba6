"""The trained operators: exact parts by brute force, the rest by held-out accuracy."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rangeloom.llm import docstats, factorisation, language, recurrent, toxicity, trees
from rangeloom.llm.arrow import pieces
from rangeloom.llm.common import remainder
from tests.llm.conftest import rows

NO = F.lit  # held-out columns are made inside tests, when a session exists


def test_pieces_of_long_texts():
    texts = ["ab", None, "x" * 10, "", "yyy", "z" * 4]
    for most in (1, 3, 5, 100):
        parts = list(pieces(texts, most))
        assert [t for p in parts for t in texts[p]] == texts
        assert all(sum(len(t or "") for t in texts[p]) <= most or sum(bool(t) for t in texts[p]) == 1 for p in parts)
    assert list(pieces([])) == []


# ---- language -----------------------------------------------------------------------------------


def slow_kn(counts, alphabet, gram):
    """P(last letter | before) by the textbook recursion over strings."""
    order = len(gram)
    levels = {order: dict(counts)}
    for n in range(order - 1, 0, -1):
        c = Counter()
        for g in levels[n + 1]:
            c[g[1:]] += 1
        levels[n] = c

    def p(g):
        if not g:
            return 1 / alphabet
        level = levels[len(g)]
        n1, n2 = sum(v == 1 for v in level.values()), sum(v == 2 for v in level.values())
        d = n1 / (n1 + 2 * n2) if n1 else 0.5
        follow = [v for k, v in level.items() if k[:-1] == g[:-1]]
        if not follow:
            return p(g[1:])
        return max(level.get(g, 0) - d, 0) / sum(follow) + d * len(follow) / sum(follow) * p(g[1:])

    return p(gram)


def test_kneser_ney_by_recursion():
    random.seed(1)
    text = "".join(random.choice("abbcc ") for _ in range(300))
    letters, sizes = language.units([text])
    keys, n = np.unique(language.grams(letters, sizes), return_counts=True)
    model = language.KneserNey(keys, n, 5)
    unpack = lambda k: "".join(chr(int(k) >> 16 * i & 0xFFFF) for i in (3, 2, 1, 0))
    counts = {unpack(k): int(c) for k, c in zip(keys, n, strict=True)}
    pack = lambda g: np.uint64(sum(ord(c) << 16 * i for i, c in zip((3, 2, 1, 0), g, strict=True)))
    for g in ["abbc", "cc a", "zzzb", "a cc", "bbbb", "cab ", "zab "]:
        assert model.probability(np.array([pack(g)]))[0] == pytest.approx(slow_kn(counts, 5, g))
    for context in ("abb", "zzz", "c a"):
        total = model.probability(np.array([pack(context + x) for x in "abc "])).sum()
        assert total == pytest.approx(1 - model.probability(np.array([pack(context + "z")]))[0])


def test_kneser_ney_keeps_rare_grams():
    """Discounts and continuation counts come from all 4-grams, those seen once too, however many there are."""
    rng = np.random.default_rng(3)
    text = "".join(chr(0x4E00 + int(k)) for k in np.minimum(rng.zipf(1.3, 400_000), 3000))
    letters, sizes = language.units([text])
    keys, n = np.unique(language.grams(letters, sizes), return_counts=True)
    assert len(keys) > 200_000 and (n == 1).sum() > 100_000
    model = language.KneserNey(keys, n, 3001)
    assert len(model.levels[0][1].hashes) == len(keys)
    tri, c3 = np.unique(keys & np.uint64((1 << 48) - 1), return_counts=True)
    assert (np.sort(tri * language.MIX) == model.levels[1][1].hashes).all()
    n1, n2 = (n == 1).sum(), (n == 2).sum()
    rare, context = keys[n == 1][:50], keys >> np.uint64(16)
    total = np.array([n[context == r >> np.uint64(16)].sum() for r in rare])
    kinds = np.array([(context == r >> np.uint64(16)).sum() for r in rare])
    d = n1 / (n1 + 2 * n2)
    found, seen = model.levels[0][1].find(rare)
    assert found.all() and seen == pytest.approx((1 - d) / total, rel=1e-5)
    assert model.levels[0][2].find(rare >> np.uint64(16))[1] == pytest.approx(d * kinds / total, rel=1e-5)
    assert c3.max() > 1


def test_many_languages(spark):
    """A hundred made-up languages, each with an alphabet order of its own, are learnt and told apart."""
    rng, data = np.random.default_rng(5), []
    for lang in range(100):
        words = ["".join(chr(97 + int(k)) for k in rng.integers(0, 26, rng.integers(2, 7))) for _ in range(60)]
        data += [(len(data) + k, " ".join(words[int(w)] for w in rng.integers(0, 60, 40)), f"l{lang:02}") for k in range(12)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string")
    got = language.predict(docs, language.fit(docs, ~language.held_out()), ["doc_id", "lang"]).collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.99 * len(got)


@given(st.lists(st.one_of(st.none(), st.text(alphabet="aBé1 \n😀漢", max_size=20)), min_size=1, max_size=5))
@settings(max_examples=60)
def test_units_and_grams(texts):
    letters, sizes = language.units(texts)
    at = 0
    for t, n in zip(texts, sizes, strict=True):
        want = re.sub(" +", " ", "".join(c.lower()[0] if c.isalpha() else " " for c in t or ""))
        got = "".join(chr(int(x)) for x in letters[at : at + n])
        assert len(got) == len(want) and all(a == b or ord(b) > 0xDFFF for a, b in zip(got, want, strict=True))
        at += n
    keys = language.grams(letters, sizes)
    starts = np.cumsum(sizes) - sizes
    for s, n in zip(starts, sizes, strict=True):
        if n:
            assert int(keys[s]) >> 16 == (32 << 32 | 32 << 16 | 32)


def test_language_on_odd_rows(odd, empty):
    model = language.fit(odd, ~language.held_out())
    got = language.predict(odd, model, ["doc_id"]).collect()
    lettered = Counter((r[0], any(c.isalpha() for c in r[1] or "")) for r in rows())
    assert Counter((r.doc_id, r.lang_pred != "und") for r in got) == lettered
    assert all(0 <= r.score <= 1 and (r.lang_pred != "und" or (r.score == 0 and r.rejected)) for r in got)
    kept = language.known_language(odd)
    assert kept.columns == odd.columns and all(any(c.isalpha() for c in r.text) for r in kept.collect())
    none = language.fit(empty, ~language.held_out())
    assert {r.lang_pred for r in language.predict(odd, none, ["doc_id"]).collect()} == {"und"}
    assert language.predict(empty, model, ["doc_id"]).count() == 0 and language.known_language(empty).count() == 0


def test_language_held_out(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = language.op4(spark, sf).collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.98 * len(held)
    assert sum(r.rejected for r in got) <= 0.01 * len(got)
    alien = spark.createDataFrame([(1, "Съешь же ещё этих мягких французских булок, да выпей чаю. " * 5)], "doc_id long, text string")
    model = language.fit(spark.read.parquet(f"{sf}/documents.parquet"), ~language.held_out())
    assert language.predict(alien, model, ["doc_id"]).first().rejected


# ---- toxicity -----------------------------------------------------------------------------------


def test_lexicon_counts_by_hand():
    lexicon = toxicity.Lexicon(["idiot", "idio*", "bomen*"])
    got = lexicon.values("Idiot! idiots, bomentera xbomen idiot 1idiot")
    scale = toxicity.SCALE / (toxicity.SCALE + 6) if toxicity.SCALE else 1
    assert got == {0: pytest.approx(math.log1p(3)), 1: pytest.approx(math.log1p(4 * scale)), 2: pytest.approx(math.log1p(scale))}


def slow_risk(w, xp, xu, prior):
    """The risk by its definition, a row at a time: prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives))."""
    margin = lambda x: sum(a * b for a, b in zip(x, w[:-1], strict=True)) + w[-1]
    plus = sum(math.log1p(math.exp(-margin(x))) for x in xp) / len(xp)
    minus = sum(math.log1p(math.exp(margin(x))) for x in xu) / len(xu) - prior * sum(math.log1p(math.exp(margin(x))) for x in xp) / len(xp)
    return prior * plus + max(0.0, minus), minus


@pytest.mark.parametrize("back", [False, True])
def test_nnpu_risk_and_gradient_by_hand(back):
    rng = np.random.default_rng(int(back))
    xp, xu, w, prior = rng.normal(1, 1, (7, 3)), rng.normal(0, 1, (11, 3)), rng.normal(0, 1, 4), 0.3
    if back:  # unlabelled text that looks far less toxic than the positives' share of it would
        xu, w, prior = xu - 8, np.array([1.0, 1.0, 1.0, 0.0]), 0.6
    risk, gradient, stepped = toxicity.nnpu(w, xp, xu, prior)
    want, minus = slow_risk(w, xp, xu, prior)
    assert stepped == back == (minus < 0) and risk == pytest.approx(want)
    for k in range(4):
        up, down = (w + s * np.eye(4)[k] * 1e-5 for s in (1, -1))
        change = [slow_risk(v, xp, xu, prior)[int(back)] for v in (up, down)]
        # Stepping back goes against what the negatives' part alone would ask for.
        assert gradient[k] == pytest.approx((-1 if back else 1) * (change[0] - change[1]) / 2e-5, rel=1e-4, abs=1e-7)


def test_toxicity_scores_by_hand():
    lexicon = toxicity.Lexicon(["bad", "worse", "terr*"])
    weights = np.array([[1.0, 2.0, 0.5, -1.0], [0.5, 1.0, 2.0, -2.0], [0.0, 0.0, 0.0, 0.0]])
    text = "Bad bad day, terrible terrors. Good!"
    n = 6
    x = [math.log1p(2), 0.0, math.log1p(2 * (toxicity.SCALE / (toxicity.SCALE + n) if toxicity.SCALE else 1))]
    want = np.mean([1 / (1 + math.exp(-(sum(a * b for a, b in zip(w, x, strict=False)) + w[-1]))) for w in weights])
    got = toxicity.Model(lexicon, weights).score([text, None, ""])
    assert got[0] == pytest.approx(want)
    assert got[1] == got[2] == pytest.approx(np.mean([1 / (1 + math.exp(-w[-1])) for w in weights]))


def test_folds_never_meet(spark):
    from rangeloom.llm import choose

    for name, (n, held, m, own) in choose.FOLDS.items():
        ids = spark.range(2000).withColumnRenamed("id", "doc_id")
        out, fold = choose.folds(name)
        rows_ = ids.select("doc_id", out.alias("out"), fold.alias("fold")).collect()
        assert all(r.out == (crc32(str(r.doc_id).encode()) % n == held) for r in rows_)
        assert not any(r.out and r.fold for r in rows_) and 150 < sum(r.fold for r in rows_) < 700


def test_nnpu_learns_without_negatives():
    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.2
    x = rng.normal(0, 1, (4000, 5))
    x[truth, :2] += 3
    positives = rng.normal(0, 1, (400, 5))
    positives[:, :2] += 3
    w = toxicity.fit_nnpu(positives, x, 0.2, 0)
    assert ((x @ w[:-1] + w[-1] > 0) == truth).mean() > 0.97


def test_toxicity_on_odd_rows(odd, empty, labels):
    model = toxicity.fit(odd, labels, remainder(F.col("doc_id"), 5) == 0)
    got = toxicity.score(odd, model).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows()) and all(0 <= r.score <= 1 for r in got)
    nothing = {round(r.score, 12) for r in got if r.doc_id in (4, 5, 6)}
    assert len(nothing) == 1
    assert toxicity.score(empty, model).count() == 0
    assert all(r.score == 0 for r in toxicity.score(odd, toxicity.fit(odd, labels.limit(0), NO(False))).collect())


def accuracy(spark, got, column):
    truth = {r.doc_id: r[column] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    return sum(r.predicted == truth[r.doc_id] for r in held) / len(held)


def test_toxicity_held_out(spark):
    got = toxicity.op2(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == 1000 and all(r.held_out == (crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert accuracy(spark, got, "toxic") >= 0.93


# ---- quality ------------------------------------------------------------------------------------


def test_sum_of_squares_identity():
    machine = factorisation.Machine()
    machine.w = np.random.default_rng(1).normal(size=factorisation.INPUTS)
    text, n = "the cat sat on the mat the end", 30
    row, ids, x, _ = factorisation.joined([text], [n], machine.cuts)
    pairs = sum(machine.v[i] @ machine.v[j] * x[a] * x[b] for a, i in enumerate(ids) for b, j in enumerate(ids) if a < b)
    z = machine.bias + machine.w[ids] @ x + pairs
    assert machine.score([text], [n])[0] == pytest.approx(1 / (1 + math.exp(-z)))
    assert set(row) == {0}


def test_quality_on_odd_rows(odd, empty, labels):
    machine = factorisation.fit(odd, labels, remainder(F.col("doc_id"), 4) == 2)
    got = factorisation.score(odd, machine).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows()) and all(0 <= r.score <= 1 for r in got)
    assert factorisation.score(empty, machine).count() == 0
    one = factorisation.fit(odd, labels.where("quality = 1"), NO(False))
    assert all(r.score > 0.99 for r in factorisation.score(odd, one).collect())
    assert all(r.score == 0.5 for r in factorisation.score(odd, factorisation.fit(odd, labels.limit(0), NO(False))).collect())


def test_quality_held_out(spark):
    got = factorisation.op5(spark, "/root/testdata/sf0.01").collect()
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert accuracy(spark, got, "quality") >= 0.93


def slow_statistics(t):
    t = t or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = defaultdict(list)
    for i in range(len(words) - 7):
        windows[tuple(words[i : i + 8])].append(i)
    hit = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(8)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), dup, len(hit)]


@given(st.one_of(st.none(), st.text(alphabet="ab \n\t#é😀 ", max_size=120), st.lists(st.sampled_from(["a", "b"]), max_size=60).map(" ".join)))
@settings(max_examples=200)
def test_statistics(text):
    assert docstats.statistics(text)[:5] == slow_statistics(text)


def forest():
    rng = np.random.default_rng(2)
    x = rng.random((3000, 3))
    y = ((x[:, 0] + 0.3 * rng.random(3000) < 0.6) & (x[:, 1] > 0.2)).astype(float)
    return x, y, trees.grow(x, y, np.ones(3000), np.array([-1, 0, 0]), trees=30)


def test_trees_fit_and_are_monotone():
    x, y, f = forest()
    assert ((f.probability(x) > 0.5) == y).mean() > 0.9
    points = np.random.default_rng(3).random((50, 3))
    for v in np.linspace(0, 1, 21):
        lower, higher = points.copy(), points.copy()
        lower[:, 0], higher[:, 0] = v, v + 0.05
        assert (f.margin(higher) <= f.margin(lower) + 1e-12).all()


def test_flat_arrays_are_the_trees():
    x, _, f = forest()

    def walk(node, row):
        while f.left[node] != node:
            node = f.left[node] if row[f.feature[node]] <= f.threshold[node] else f.right[node]
        return f.value[node]

    assert f.margin(x[:20]) == pytest.approx([f.start + sum(walk(r, row) for r in f.roots) for row in x[:20]])


def test_rules_on_odd_rows(odd, empty, labels):
    got = trees.judge(odd, trees.fit(odd, labels)).collect()
    key = lambda r: (r[0], *slow_statistics(r[1]))
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == Counter(map(key, rows()))
    for r in got:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and not (r.kept and r.base_failed)
    assert trees.judge(empty, None).count() == 0 and trees.fit(odd, labels.limit(0)) is None


def test_rules_keep_clean_documents(spark):
    got = {r.doc_id: r for r in trees.op10(spark, "/root/testdata/sf0.01").collect()}
    marked = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()
    assert all(got[m.doc_id].kept or got[m.doc_id].base_failed for m in marked if m.quality == 1)
    assert sum(got[m.doc_id].kept for m in marked if m.quality == 0) <= 0.05 * len(marked)


# ---- samples -------------------------------------------------------------------------------------


def test_samples_are_bounded_whatever_repeats(spark):
    """An id, or null, on a third of all rows brings one text to the sample, as any other does."""
    n = 6000
    docs = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit(5)).when(F.col("id") % 3 == 1, F.lit(None)).otherwise(F.col("id")).cast("long").alias("doc_id"),
        F.concat(F.lit("some text number "), (F.col("id") % 50).cast("string")).alias("text"), F.lit("en").alias("lang"), F.lit(7).cast("long").alias("n_chars"),
    )
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(2, 30)] + [(5, 1, 1)], "doc_id long, quality int, toxic int")
    ids = {r.doc_id for r in docs.join(labels, "doc_id").select("doc_id").collect()}
    assert 5 in ids
    stats, y, _ = trees.labelled_statistics(docs, labels)
    assert len(stats) == len(y) == len(ids)
    chosen = toxicity.toxic_sample(docs.select("doc_id", "text"), labels.where("toxic = 1").select("doc_id", F.lit(1).alias("y")), 15, 1000, 200)
    assert chosen.count() < 320 and chosen.where("p").count() == len([i for i in ids if i % 2])
    texts = language.lang_sample(docs.select("doc_id", "lang", "text"), 300, 10**9)
    assert 150 < texts.count() < 450 and texts.where("doc_id IS NULL").count() <= 1


# ---- language model -----------------------------------------------------------------------------


@pytest.fixture
def small_net(monkeypatch):
    counts = recurrent.Counts(50, [40, 30, 20, 9], {0: (30, 30), 1: (10, 25), 2: (3, 15)}, 5)
    return counts, recurrent.Network.new(counts, seed=1)


def test_probabilities_sum_to_one(small_net):
    counts, net = small_net
    h = np.random.default_rng(0).normal(0, 1, (1, recurrent.STATE)).astype(np.float32)
    codes = np.arange(recurrent.HEAD + counts.bands)
    logp = net.output(np.repeat(h, len(codes), 0), codes, False)[0].astype(float)
    assert np.exp(logp).sum() == pytest.approx(1, abs=1e-4)
    # Shares in a class: a band's words, and in the rare class words seen once and all unknown ones.
    assert counts.unknown + counts.once * 30 == pytest.approx(1)
    assert np.exp(counts.in_class(np.array([0]), np.array([0])))[0] == pytest.approx(counts.unknown)
    assert counts.share[1] == 35  # ten words that were seen 25 times: the sum of count + 1


def test_gradients(small_net):
    counts, net = small_net
    rng = np.random.default_rng(1)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    inputs = rng.choice([1, 2, recurrent.HEAD, recurrent.HEAD + 1, recurrent.END], (5, 3))
    codes = rng.choice([0, 1, 3, recurrent.HEAD, recurrent.HEAD + 2], (5, 3))
    fresh, real = rng.random((5, 3)) < 0.2, rng.random((5, 3)) < 0.9
    h = rng.uniform(-1, 1, (recurrent.STATE, 3))
    g, _, loss = net.gradients(inputs, codes, fresh, real, h)
    for name in net.w:
        flat = net.w[name].ravel()
        for at in np.flatnonzero(np.abs(g[name].ravel()) > 1e-4)[::97][:6]:
            old = flat[at]
            flat[at] = old + 1e-4
            up = net.gradients(inputs, codes, fresh, real, h)[2]
            flat[at] = old - 1e-4
            down = net.gradients(inputs, codes, fresh, real, h)[2]
            flat[at] = old
            assert g[name].ravel()[at] == pytest.approx((up - down) / 2e-4, rel=0.05, abs=1e-4)
    assert loss > 0


@pytest.mark.parametrize(("lanes", "window"), [(1, 4), (3, 7), (64, 32)])
def test_lanes_and_windows_do_not_matter(small_net, lanes, window):
    _, net = small_net
    rng = np.random.default_rng(2)
    docs = [rng.choice([0, 1, 2, 3, recurrent.HEAD, recurrent.HEAD + 1], rng.integers(1, 60)).astype(np.int32) for _ in range(20)]
    alone = [recurrent.log_likelihoods(net, [d], 1, 1000)[0] for d in docs]
    assert recurrent.log_likelihoods(net, docs, lanes, window) == pytest.approx(alone, rel=1e-4)


def test_average_in_groups_is_the_average():
    rng = np.random.default_rng(4)
    v, n = rng.normal(size=(9, 5)).astype(np.float32), rng.integers(1, 50, 9)
    table = lambda own, part: pa.table({"piece": [0] * len(own), "part": [part] * len(own), "g": own, "n": n[own], "v": pa.array(list(v[own]), pa.list_(pa.float32()))})
    groups = pa.concat_tables([recurrent._average(table(np.arange(0, 4), 0)), recurrent._average(table(np.arange(4, 9), 1))])
    out = recurrent._average(groups)
    assert out.column("v").to_pylist()[0] == pytest.approx(np.average(v, axis=0, weights=n), rel=1e-5)
    assert out.column("n").to_pylist() == [n.sum()]


def by_hand_base(pairs, held):
    c = Counter()
    for (_, t), h in zip(pairs, held, strict=True):
        if not h:
            c.update([*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None])
    n, v = sum(c.values()), len(c)
    out = []
    for (i, t), h in zip(pairs, held, strict=True):
        tokens = [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None]
        out.append((i, h, len(tokens), sum(c[x] > 0 for x in tokens), round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in tokens), 4)))
    return n, out


def test_scores_on_odd_rows(odd, empty, monkeypatch):
    held_out = remainder(F.col("doc_id"), 7) == 2
    codes, counts = recurrent.encode(odd, held_out)
    got = recurrent.score(codes, counts, recurrent.fit(codes, counts, rounds=1)).collect()
    pairs = [(r[0], r[1]) for r in rows()]
    held = [crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in pairs]
    n, want = by_hand_base(pairs, held)
    assert counts.total == n
    assert Counter((r.doc_id, r.held, r.n_tokens, r.n_known, round(r.base_score, 4)) for r in got) == Counter(want)
    assert all(r.score <= 0 and math.isfinite(r.score) for r in got)
    codes, counts = recurrent.encode(empty, held_out)
    assert recurrent.score(codes, counts, recurrent.fit(codes, counts)).count() == 0
    codes, counts = recurrent.encode(odd, NO(True))
    assert {(r.base_score, r.score, r.n_known) for r in recurrent.score(codes, counts, recurrent.fit(codes, counts)).collect()} == {(0.0, 0.0, 0)}


def test_model_beats_the_base(spark):
    got = recurrent.op6(spark, "/root/testdata/sf0.01").collect()
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    n, want = by_hand_base([(d.doc_id, d.text) for d in docs], [crc32(str(d.doc_id).encode()) % 7 == 2 for d in docs])
    assert sorted((r.doc_id, r.held_out, r.n_tokens, r.n_known) for r in got) == sorted(w[:4] for w in want)
    base = {w[0]: w[4] for w in want}
    assert all(r.base_score == pytest.approx(base[r.doc_id], abs=1e-3) for r in got)
    assert {r.train_tokens for r in got} == {n}
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > 0.85 * sum(r.base_score for r in held)


def test_chunks_do_not_matter(odd, monkeypatch):
    held_out = remainder(F.col("doc_id"), 7) == 2
    columns = ["doc_id", "held", "n_tokens", "n_known"]
    whole, counts = recurrent.encode(odd, held_out)
    monkeypatch.setattr(recurrent, "CHUNK", 5)
    parts, again = recurrent.encode(odd.coalesce(1), held_out)
    assert counts.total == again.total and counts.kinds == again.kinds
    assert Counter(map(tuple, whole.select(*columns).collect())) == Counter(map(tuple, parts.select(*columns).collect()))


def made_up_codes(spark, n=400):
    return spark.range(n).select(
        F.col("id").alias("doc_id"), (F.col("id") % 7 == 2).alias("held"), F.transform(F.sequence(F.lit(0), F.col("id") % 30), lambda k: (k * F.col("id") % 5).cast("short")).alias("codes"), F.col("id").alias("row")
    )


def test_network_is_trained_on_all_training_documents(spark, monkeypatch):
    """Each group's documents are in one round, and the groups together have all of them."""
    seen, plain = spark.sparkContext.accumulator(0), recurrent._trained

    def counted(*args):
        run = plain(*args)

        def both(rows):
            seen.add(rows.num_rows)
            return run(rows)

        return both

    monkeypatch.setattr(recurrent, "_trained", counted)
    codes = made_up_codes(spark)
    total = sum(1 + i % 30 for i in range(400) if i % 7 != 2)
    recurrent.fit(codes, recurrent.Counts(400, [3, 2, 1], {}, 0), group=500)
    assert seen.value == codes.where("NOT held").count()
    groups = recurrent.training_groups(codes, 4, total, 500).groupBy("g").agg(F.sum(F.size("codes")).alias("n")).collect()
    assert sum(r.n for r in groups) == total and len(groups) == 4 * -(-total // 2000) and max(r.n for r in groups) < 3 * 500


def test_network_does_not_depend_on_partitions(spark):
    codes, counts = made_up_codes(spark), recurrent.Counts(400, [3, 2, 1], {0: (2, 2)}, 0)
    one, other = (recurrent.fit(c, counts, rounds=2, group=2000).flat() for c in (codes.coalesce(1), codes.repartition(9)))
    assert (one == other).all() and (one != recurrent.Network.new(counts).flat()).any()


def test_an_id_on_many_rows_is_spread_over_groups(spark):
    codes = made_up_codes(spark, 9000).withColumn("doc_id", F.when(F.col("doc_id") % 3 == 0, -1).otherwise(F.col("doc_id"))).withColumn("held", F.lit(False))
    sizes = recurrent.training_groups(codes, 2, 90_000, 5000).groupBy("g").count().collect()
    assert sum(r["count"] for r in sizes) == 9000 and max(r["count"] for r in sizes) < 1.4 * 9000 / len(sizes) and len(sizes) == 18


def test_all_words_of_a_long_document_are_trained_on(small_net, monkeypatch):
    counts, net = small_net
    rng = np.random.default_rng(5)
    docs = [rng.choice([0, 1, 2, recurrent.HEAD], n).astype(np.int32) for n in (3000, *[40] * 640)]
    seen, plain = [], recurrent.Network.gradients

    def counted(self, inputs, codes, fresh, real, h):
        seen.append(int(real.sum()))
        return plain(self, inputs, codes, fresh, real, h)

    monkeypatch.setattr(recurrent.Network, "gradients", counted)
    mine = recurrent.Network.of(net.flat(), counts.bands)
    loss = recurrent.train(mine, docs, 0.01, window=16)
    assert sum(seen) == sum(map(len, docs)) and np.isfinite(loss) and np.isfinite(mine.flat()).all()
