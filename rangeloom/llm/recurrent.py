"""LM scoring (6): a gated recurrent language model with a class-factored output.

Events are the words of the training documents, one for any other word, and the end of a text. The
probability of a word is that of its class given the state, times that of the word in its class.
The ``HEAD`` commonest words (the end among them) are in classes of ``WIDTH`` with a softmax over the
state in each; other words are in a class by their count, to a power of two, in which a word's share
is its count plus one. Words seen once share a class with unknown words, which get the part of it
that counts of words seen once and twice suggest. So the model is a distribution over all events
whatever the size of the vocabulary, and only ``HEAD`` words and a row a class are in memory.

1. Texts are cut into words once; a chunk of documents of about ``CHUNK`` words is written as word
   numbers with a dictionary of its own.
2. Dictionary rows meet by word (a word has one row a chunk, however common it is) and learn its
   count over all training documents; counts by class and the head come from the same table.
3. Each chunk's documents meet their dictionary and are written as codes: a head word's rank or a
   class. What a document's words have of their classes and its base score are sums made there.
4. The network is trained on every training document once, in ``ROUNDS`` rounds over different ones. A
   round's documents are dealt by their id to groups of about ``GROUP`` words; a task trains on a group,
   in order of ids, by backpropagation truncated to windows, and the groups' weights are averaged in
   order. So the network depends on the documents only, not on how they are partitioned.
5. All documents are scored in lanes of documents one after another; the state is carried from window
   to window and reset where a document begins.

Defined cases: null and empty texts are an end alone; without training documents each event is
certain and all scores are 0; repeated rows score alike (an id with a large share of the rows is dealt
to groups by row); columns besides doc_id and text are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rangeloom.llm.arrow import slices
from rangeloom.llm.common import HOT, freed, remainder, small_join, stored

#: ``BANDS`` is the most classes by count there can be; a network has those that are in use.
HEAD, WIDTH, BANDS = 2048, 32, 48
STATE = 16
CHUNK = 5_000_000
#: Words of a training group, and words that a worker scores at once.
GROUP, POOL = 2_000_000, 2_000_000
ROUNDS = 4
WINDOW, LANES = 32, 256
RATE, UPDATES = 0.02, 100
#: Rows of outputs at once, so that they stay in a core's cache.
BLOCK = 4096
#: Logits up to here need no shift before they are raised to powers.
SAFE = 40
#: The input before the first word is the end of the text before.
END = 0
CODED = "doc_id long, held boolean, codes array<smallint>, n_tokens long, n_known long, base_score double, in_class double, row long"
ENCODED = "chunk long, doc_id long, held boolean, ids array<int>, local int, word binary, n long"


# ---- words and counts -------------------------------------------------------------------------


def _encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of documents as word numbers, and their dictionaries with counts in training documents."""
    part, number = TaskContext.get().partitionId(), 0
    names = [f.split()[0] for f in ENCODED.split(", ")]
    ids: list[np.ndarray] = []
    docs: list[tuple] = []
    size, words = 0, defaultdict(count().__next__)

    def flush() -> Iterator[pa.RecordBatch]:
        chunk = (part << 24) + number
        n = len(docs)
        ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
        flat = np.concatenate(ids)
        held = np.array([h for _, h in docs])
        counts = np.bincount(flat[np.repeat(~held, np.diff(ends))], minlength=len(words))
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
        nulls = lambda t, k: pa.nulls(k, t)
        yield pa.RecordBatch.from_arrays([pa.array([chunk] * n, pa.int64()), pa.array([d for d, _ in docs], pa.int64()), pa.array(held), lists, nulls(pa.int32(), n), nulls(pa.binary(), n), nulls(pa.int64(), n)], names)
        every = list(words)
        for at in range(0, len(every), 50_000):
            own = every[at : at + 50_000]
            k = len(own)
            yield pa.RecordBatch.from_arrays(
                [pa.array([chunk] * k, pa.int64()), nulls(pa.int64(), k), nulls(pa.bool_(), k), nulls(pa.list_(pa.int32()), k), pa.array(np.arange(at, at + k, dtype=np.int32)), pa.array(own, pa.binary()), pa.array(counts[at : at + k], pa.int64())], names
            )

    for batch in slices(batches):
        for doc_id, held, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            own = (text or "").encode("utf-8", "surrogatepass").lower().split()
            ids.append(np.fromiter(map(words.__getitem__, own), np.int32, len(own)))
            docs.append((doc_id, held))
            size += len(own)
            if size >= CHUNK:
                yield from flush()
                ids, docs, size, number, words = [], [], 0, number + 1, defaultdict(count().__next__)
    if docs:
        yield from flush()


class Counts:
    """What of the corpus' counts every task needs; its size doesn't depend on the corpus."""

    def __init__(self, docs: int, head: list[int], bands: dict[int, tuple[int, int]], n2: int):
        self.head = np.array([docs, *head], float)  # counts of head codes, the end first
        kinds, mass = np.zeros(BANDS), np.zeros(BANDS)
        for b, (k, m) in bands.items():
            kinds[b], mass[b] = k, m
        self.total = int(self.head.sum() + mass.sum())  # N
        self.kinds = int(len(self.head) + kinds.sum()) if docs else 0  # V
        self.mass, self.share = mass, mass + kinds
        self.bands = max(bands, default=0) + 1  # in use; the first is that of unknown words too
        n1 = kinds[0]
        self.unknown = (n1 + 0.5) / (n1 + 2 * n2 + 1) if n1 else 1.0
        self.once = (1 - self.unknown) / max(n1, 1)
        self.rare = max(n1 + 2 * n2, 1.0)

    def in_class(self, c: np.ndarray, band: np.ndarray) -> np.ndarray:
        """Natural logarithm of the share in their class of words outside the head with counts ``c``."""
        common = np.log((c + 1) / np.maximum(self.share[band], 1))
        return np.where(c == 0, np.log(self.unknown), np.where(c == 1, np.log(max(self.once, 1e-300)), common))


def band(c: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(c, 1)).astype(int), BANDS - 1)


def _coder(counts: Counts):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        local, c, rank = (right.column(x).to_numpy().astype(np.int64) for x in ("local", "c", "rank"))
        size = int(local.max()) + 1 if len(local) else 0
        code, logs, inside, known = np.zeros(size, np.int32), np.zeros(size), np.zeros(size), np.zeros(size, np.int64)
        code[local] = np.where(rank >= 0, rank, HEAD + band(c))
        logs[local] = np.log10((c + 1) / (counts.total + counts.kinds + 1))
        inside[local] = np.where(rank >= 0, 0.0, counts.in_class(c, band(c)))
        known[local] = c > 0
        lists = left.column("ids").combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        flat, sizes = lists.flatten().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy())
        doc = np.repeat(np.arange(len(sizes)), sizes)
        end = counts.head[0]
        ends = np.cumsum(sizes + 1)
        codes = np.full(len(flat) + len(sizes), END, np.int16)
        codes[np.arange(len(flat)) + doc] = code[flat]
        made = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(codes))
        base = np.bincount(doc, logs[flat], len(sizes)) + np.log10((end + 1) / (counts.total + counts.kinds + 1))
        n_known = np.bincount(doc, known[flat], len(sizes)).astype(np.int64) + int(end > 0)
        columns = [left.column("doc_id"), left.column("held"), made, pa.array(sizes.astype(np.int64) + 1), pa.array(n_known), pa.array(base), pa.array(np.bincount(doc, inside[flat], len(sizes))), pa.array(np.arange(len(sizes)))]
        return pa.Table.from_arrays(columns, [f.split()[0] for f in CODED.split(", ")])

    return run


def encode(docs: DataFrame, held_out) -> tuple[DataFrame, Counts]:
    """The documents as codes, and the counts."""
    with freed(docs.sparkSession) as keep:
        codes, counts = _coded(docs.select(F.col("doc_id").cast("long"), held_out.alias("held"), "text"))
        return keep(codes, "codes"), counts


def _coded(docs: DataFrame) -> tuple[DataFrame, Counts]:
    made = stored(docs.mapInArrow(_encode, ENCODED), "words")
    rows = made.where("word IS NOT NULL").select("chunk", "local", "word", "n")
    by_word = Window.partitionBy("word")
    counted = rows.withColumn("c", F.sum("n").over(by_word)).withColumn("lead", F.col("chunk") == F.min("chunk").over(by_word))
    counted = stored(counted.select("chunk", "local", "word", "c", "lead"), "counts")
    kinds = counted.where("lead AND c > 0")
    head = [(r.word, r.c) for r in kinds.orderBy(F.desc("c"), "word").limit(HEAD - 1).select("word", "c").collect()]
    ranks = docs.sparkSession.createDataFrame([(bytes(w), k + 1) for k, (w, _) in enumerate(head)], "word binary, rank int")
    ranked = counted.join(F.broadcast(ranks), "word", "left").withColumn("rank", F.coalesce("rank", F.lit(-1)))
    width = F.least(F.floor(F.log2(F.greatest(F.col("c"), F.lit(1)))), F.lit(BANDS - 1)).cast("int")
    outside = ranked.where("lead AND c > 0 AND rank < 0").groupBy(width.alias("b")).agg(F.count(F.lit(1)).alias("k"), F.sum("c").alias("m"), F.sum((F.col("c") == 2).cast("long")).alias("n2"))
    found = outside.collect()  # at most BANDS rows
    texts = made.where("word IS NULL").select("chunk", "doc_id", "held", "ids")
    n_docs, chunks = texts.agg(F.count_if(~F.col("held")), F.count_distinct("chunk")).first()
    counts = Counts(n_docs, [c for _, c in head], {r.b: (r.k, r.m) for r in found}, sum(r.n2 for r in found))
    parts = max(1, min(4 * chunks, 20_000))  # chunks are large: few should share a task
    left, right = (x.repartition(parts, "chunk").groupBy("chunk") for x in (texts, ranked.select("chunk", "local", "c", "rank")))
    return left.cogroup(right).applyInArrow(_coder(counts), CODED), counts


# ---- the network ------------------------------------------------------------------------------


class Network:
    """Weights by name; all in single precision."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = weights

    @staticmethod
    def shapes(bands: int) -> dict[str, tuple[int, ...]]:
        classes = HEAD // WIDTH + bands
        return {"x": (HEAD + bands, 3 * STATE), "bx": (3 * STATE,), "u": (STATE, 3 * STATE), "wc": (STATE, classes), "bc": (classes,), "wo": (HEAD, STATE), "bo": (HEAD,)}

    @classmethod
    def new(cls, counts: Counts, seed: int = 6) -> Network:
        random = np.random.default_rng(seed)
        w = {k: random.normal(0, 0.1, s).astype(np.float32) for k, s in cls.shapes(counts.bands).items()}
        w["bx"][:] = 0
        w["bx"][:STATE] = 1  # states last at first
        head = np.zeros(HEAD)
        head[: len(counts.head)] = counts.head
        mass = np.concatenate([head.reshape(-1, WIDTH).sum(axis=1), [counts.rare], counts.mass[1 : counts.bands]])
        w["bc"][:] = np.log(np.maximum(mass, 1e-3) / mass.sum())
        w["bo"][:] = np.where(np.arange(HEAD) < len(counts.head), np.log(head + 1), -30)
        w["bo"] -= np.repeat(w["bo"].reshape(-1, WIDTH).max(axis=1), WIDTH)
        w["wc"] *= 0.1
        w["wo"] *= 0.1
        return cls(w)

    def flat(self) -> np.ndarray:
        return np.concatenate([v.ravel() for v in self.w.values()])

    @classmethod
    def of(cls, flat: np.ndarray, bands: int) -> Network:
        """The network with these weights, which are parts of a copy of ``flat``."""
        w, at, own = {}, 0, flat.astype(np.float32)
        for k, s in cls.shapes(bands).items():
            n = int(np.prod(s))
            w[k] = own[at : at + n].reshape(s)
            at += n
        return cls(w)

    def run(self, inputs: np.ndarray, fresh: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
        """States (steps x STATE x lanes) after each step of a window (steps x lanes), from states ``h`` (STATE x lanes),
        and what going back needs; ``fresh`` marks first words. Lanes come last, so that gates are whole stretches."""
        table, u, begins = self.w["x"] + self.w["bx"], np.ascontiguousarray(self.w["u"].T), fresh.any(axis=1)
        steps, lanes = inputs.shape
        x = np.ascontiguousarray(table[inputs].transpose(0, 2, 1))
        states, before, gates, news, inner = (np.empty((steps, k * STATE, lanes), x.dtype) for k in (1, 1, 2, 1, 1))
        for t in range(steps):
            if begins[t]:
                h = h * ~fresh[t]
            before[t] = h
            hu = u @ h
            zr = np.add(x[t, : 2 * STATE], hu[: 2 * STATE], out=gates[t])
            np.negative(zr, out=zr)
            np.exp(zr, out=zr)
            zr += 1
            np.reciprocal(zr, out=zr)
            inner[t] = hu[2 * STATE :]
            n = np.multiply(zr[STATE:], inner[t], out=news[t])
            n += x[t, 2 * STATE :]
            np.tanh(n, out=n)
            h = np.subtract(h, n, out=states[t])
            h *= zr[:STATE]
            h += n
        return states, (before, gates, news, inner)

    def _softmax(self, h: np.ndarray, w: np.ndarray, b: np.ndarray, at: np.ndarray, learn: bool) -> tuple[np.ndarray, np.ndarray]:
        """Log-probabilities of the columns ``at`` of ``softmax(h @ w + b)``; with ``learn`` the gradient by the logits, too."""
        e, rows = h @ w, np.arange(len(at))
        e += b
        if np.abs(w).sum(axis=0).max() + b.max() > SAFE:  # states lie between -1 and 1
            e -= e.max(axis=1, keepdims=True)
        right = e[rows, at]
        np.exp(e, out=e)
        total = e @ np.ones(e.shape[1], e.dtype)
        if learn:
            e *= np.reciprocal(total)[:, None]
            e[rows, at] -= 1
        return right - np.log(total), e

    def output(self, h: np.ndarray, codes: np.ndarray, learn: bool) -> tuple[np.ndarray, dict[str, np.ndarray] | None, np.ndarray | None]:
        """Log-probability of class and head word for rows of states; with ``learn`` gradients of minus their sum."""
        w, head = self.w, codes < HEAD
        cls = np.where(head, codes // WIDTH, HEAD // WIDTH + codes - HEAD)
        logp, dh = np.empty(len(codes), h.dtype), np.empty_like(h) if learn else None
        grads = {k: np.zeros_like(w[k]) for k in ("wc", "bc", "wo", "bo")} if learn else None
        for a in range(0, len(codes), BLOCK):
            part = slice(a, a + BLOCK)
            logp[part], e = self._softmax(h[part], w["wc"], w["bc"], cls[part], learn)
            if learn:
                grads["wc"] += h[part].T @ e
                grads["bc"] += np.ones(len(e), e.dtype) @ e
                np.matmul(e, w["wc"].T, out=dh[part])
        inside = np.flatnonzero(head)
        order = inside[np.argsort(cls[inside].astype(np.int16), kind="stable")]
        own_h, at = h[order], codes[order] % WIDTH
        bounds = np.searchsorted(cls[order], np.arange(HEAD // WIDTH + 1))
        own_p, own_dh = np.empty(len(order), h.dtype), np.empty_like(own_h)
        for k in np.flatnonzero(np.diff(bounds)):
            part, span = slice(bounds[k], bounds[k + 1]), slice(k * WIDTH, (k + 1) * WIDTH)
            own_p[part], e = self._softmax(own_h[part], w["wo"][span].T, w["bo"][span], at[part], learn)
            if learn:
                grads["wo"][span] = e.T @ own_h[part]
                grads["bo"][span] = e.sum(axis=0)
                np.matmul(e, w["wo"][span], out=own_dh[part])
        logp[order] += own_p
        if learn:
            dh[order] += own_dh
        return logp, grads, dh

    def gradients(self, inputs: np.ndarray, codes: np.ndarray, fresh: np.ndarray, real: np.ndarray, h: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, float]:
        """Gradients of the mean loss of a window, the state at its end and the loss."""
        states, (before, gates, news, inner) = self.run(inputs, fresh, h)
        steps, lanes = inputs.shape
        which = np.flatnonzero(real.ravel())
        flat = rows_of(states)
        logp, g, d = self.output(flat[which], codes.ravel()[which], True)
        n = max(len(which), 1)
        out = np.zeros_like(flat)
        out[which] = d / n
        out = np.ascontiguousarray(out.reshape(steps, lanes, STATE).transpose(0, 2, 1))
        g = {k: v / n for k, v in g.items()}
        # What a step's gradient is multiplied by, for all steps at once.
        z, r = gates[:, :STATE], gates[:, STATE:]
        by_new, by_gate, by_reset = (1 - z) * (1 - news * news), (before - news) * z * (1 - z), inner * r * (1 - r)
        dx, u, begins = np.empty((steps, 3 * STATE, lanes), states.dtype), self.w["u"], fresh.any(axis=1)
        dh, du, du_sum = np.zeros((STATE, lanes), states.dtype), np.empty((3 * STATE, lanes), states.dtype), np.zeros_like(u)
        for t in reversed(range(steps)):
            dh += out[t]
            np.multiply(dh, by_gate[t], out=dx[t, :STATE])
            dm = np.multiply(dh, by_new[t], out=dx[t, 2 * STATE :])
            np.multiply(dm, by_reset[t], out=dx[t, STATE : 2 * STATE])
            du[: 2 * STATE] = dx[t, : 2 * STATE]
            np.multiply(dm, r[t], out=du[2 * STATE :])
            du_sum += before[t] @ du.T
            dh *= z[t]
            dh += u @ du
            if begins[t]:
                dh *= ~fresh[t]
        flat_dx = rows_of(dx)
        g["u"], g["bx"], g["x"] = du_sum, flat_dx.sum(axis=0), np.zeros_like(self.w["x"])
        order = np.argsort(inputs.ravel(), kind="stable")
        codes_in = inputs.ravel()[order]
        first = np.flatnonzero(np.concatenate([[True], codes_in[1:] != codes_in[:-1]]))
        g["x"][codes_in[first]] = np.add.reduceat(flat_dx[order], first, axis=0)
        return g, states[-1], float(-logp.sum() / n)


def rows_of(x: np.ndarray) -> np.ndarray:
    """Steps x numbers x lanes as a row a step and lane."""
    return np.ascontiguousarray(x.transpose(0, 2, 1)).reshape(-1, x.shape[1])


def lanes_of(docs: list[np.ndarray], lanes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Documents one after another in lanes of like length: codes, inputs, document (-1: none) and
    first words, each steps x lanes. The longest go first, each to the shortest lane."""
    import heapq

    lanes = max(1, min(lanes, len(docs)))
    heap = [(0, k) for k in range(lanes)]
    where: list[list[int]] = [[] for _ in range(lanes)]
    for i in sorted(range(len(docs)), key=lambda i: -len(docs[i])):
        n, k = heap[0]
        where[k].append(i)
        heapq.heapreplace(heap, (n + len(docs[i]), k))
    steps = max(n for n, _ in heap)
    codes = np.zeros((lanes, steps), np.int16)
    inputs = np.full((lanes, steps), END, np.int16)
    doc, fresh = np.full((lanes, steps), -1, np.int32), np.zeros((lanes, steps), bool)
    for k, own in enumerate(where):
        at = 0
        for i in own:
            n = len(docs[i])
            codes[k, at : at + n] = docs[i]
            inputs[k, at + 1 : at + n] = docs[i][:-1]
            doc[k, at : at + n] = i
            fresh[k, at] = True
            at += n
    return tuple(np.ascontiguousarray(a.T) for a in (codes, inputs, doc, fresh))


def log_likelihoods(net: Network, docs: list[np.ndarray], lanes: int = LANES, window: int = WINDOW) -> np.ndarray:
    """Natural logarithm of classes and head words of each whole document; the state is carried across windows."""
    out = np.zeros(len(docs))
    codes, inputs, doc, fresh = lanes_of(docs, lanes)
    h = np.zeros((STATE, codes.shape[1]), np.float32)
    for at in range(0, len(codes), window):
        part = slice(at, at + window)
        live = doc[part].max(axis=0) >= 0
        if not live.all():  # lanes that are through
            codes, inputs, doc, fresh, h = codes[:, live], inputs[:, live], doc[:, live], fresh[:, live], h[:, live]
        states, _ = net.run(inputs[part], fresh[part], h)
        h = states[-1]
        which = np.flatnonzero(doc[part].ravel() >= 0)
        logp = net.output(rows_of(states)[which], codes[part].ravel()[which], False)[0]
        out += np.bincount(doc[part].ravel()[which], logp, len(docs))
    return out


def train(net: Network, docs: list[np.ndarray], rate: float, window: int = WINDOW) -> float:
    """One pass over all of ``docs`` by Adam, in place; as many lanes as leave about ``UPDATES`` windows.
    Where less than an eighth of the lanes is left, gradients of several windows make one update.
    Returns the mean loss of a word."""
    total = sum(map(len, docs))
    codes, inputs, doc, fresh = lanes_of(docs, int(np.clip(total // (window * UPDATES), 8, LANES)))
    lanes = codes.shape[1]
    h = np.zeros((STATE, lanes), np.float32)
    flat = net.flat()
    first, second = np.zeros((2, len(flat)), np.float32)
    loss_sum, step = 0.0, 0
    held, words, waiting = np.zeros(len(flat), np.float32), 0, 0  # the gradients' sum over words, and the words and lanes in it
    for at in range(0, len(codes), window):
        part = slice(at, at + window)
        live = doc[part].max(axis=0) >= 0
        if not live.all():  # lanes that are through
            codes, inputs, doc, fresh, h = codes[:, live], inputs[:, live], doc[:, live], fresh[:, live], h[:, live]
        real = doc[part] >= 0
        g, h, loss = net.gradients(inputs[part], codes[part], fresh[part], real, h)
        n = int(real.sum())
        loss_sum += loss * n
        held += np.concatenate([g[k].ravel() for k in net.w]) * np.float32(n)
        words, waiting = words + n, waiting + codes.shape[1]
        if waiting * 8 < lanes and at + window < len(codes):  # the last long documents alone would make tiny batches
            continue
        held /= np.float32(words)
        step += 1
        held *= np.float32(min(1.0, 5.0 / max(np.sqrt(float(held @ held)), 1e-9)))
        first += np.float32(0.1) * (held - first)
        second += np.float32(0.01) * (held * held - second)
        flat -= np.float32(rate / (1 - 0.9**step) * np.sqrt(1 - 0.99**step)) * first / (np.sqrt(second) + np.float32(1e-7))
        spot = 0
        for v in net.w.values():
            v[...] = flat[spot : spot + v.size].reshape(v.shape)
            spot += v.size
        held[:], words, waiting = 0, 0, 0
    return loss_sum / total if total else 0.0


#: Weights of a piece, and sets of groups in which weights are averaged before the sets are.
PIECE, SPREAD = 2048, 256
AVERAGED = "piece long, part long, g long, n long, v array<float>"


def _trained(start: np.ndarray, bands: int, rate: float):
    """For a group's documents (g, doc_id, codes): the weights that training on them gives, in pieces."""

    def run(rows: pa.Table) -> pa.Table:
        docs = [np.asarray(x) for x in rows.column("codes").to_numpy(zero_copy_only=False)]
        ids = rows.column("doc_id").to_numpy(zero_copy_only=False)
        order = sorted(range(len(docs)), key=lambda i: (ids[i] != ids[i], ids[i], docs[i].tobytes()))
        net = Network.of(start, bands)
        train(net, [docs[i] for i in order], rate)
        flat, g = net.flat(), rows.column("g")[0].as_py()
        pieces = [flat[i : i + PIECE] for i in range(0, len(flat), PIECE)]
        n, k = sum(map(len, docs)), len(pieces)
        return pa.table({"piece": pa.array(np.arange(k)), "part": pa.array([g % SPREAD] * k, pa.int64()), "g": pa.array([g] * k, pa.int64()), "n": pa.array([n] * k, pa.int64()), "v": pa.array(pieces, pa.list_(pa.float32()))})

    return run


def _average(rows: pa.Table) -> pa.Table:
    """Pieces of weights as one, weighted by the words they were trained on."""
    rows = rows.sort_by("g")
    n = rows.column("n").to_numpy()
    mean = np.average(np.stack(rows.column("v").to_numpy(zero_copy_only=False)), axis=0, weights=n)
    return pa.table({"piece": rows.column("piece")[:1], "part": rows.column("part")[:1], "g": rows.column("g")[:1], "n": pa.array([int(n.sum())], pa.int64()), "v": pa.array([mean.astype(np.float32)], pa.list_(pa.float32()))})


def training_groups(codes: DataFrame, rounds: int, words: int, group: int) -> DataFrame:
    """(g, doc_id, codes) of all training documents; of group ``g`` the round is ``g % rounds``. An id with over
    ``HOT`` of the rows (there are few of those) is dealt by row."""
    own = codes.where("NOT held")
    groups = rounds * max(1, -(-words // (rounds * group)))
    per_id = own.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    hot = stored(per_id.where(F.col("n") >= max(1000, int(own.count() * HOT))).select("doc_id", F.lit(True).alias("often")), "often")
    met = small_join(own.select("doc_id", "codes", "row"), hot, ["doc_id"], F.col("row"))
    g = F.pmod(F.xxhash64(F.lit(6), "doc_id", F.when(F.col("often"), F.col("row"))), F.lit(groups))
    return met.select(g.alias("g"), "doc_id", "codes")


def fit(codes: DataFrame, counts: Counts, rounds: int = ROUNDS, group: int = GROUP) -> Network:
    net = Network.new(counts)
    with freed(codes.sparkSession):
        dealt = training_groups(codes, rounds, counts.total, group)
        for k in range(rounds):
            made = dealt.where(F.col("g") % rounds == k).groupBy("g").applyInArrow(_trained(net.flat(), counts.bands, RATE / (1 + k)), AVERAGED)
            made = made.groupBy("piece", "part").applyInArrow(_average, AVERAGED)
            got = made.groupBy("piece").applyInArrow(_average, AVERAGED).collect()  # as large as the network
            if got:
                net = Network.of(np.concatenate([np.array(r.v, np.float32) for r in sorted(got, key=lambda r: r.piece)]), counts.bands)
    return net


def score(codes: DataFrame, counts: Counts, net: Network) -> DataFrame:
    """All columns but the codes, with ``score``: log10 of the probability of the whole text."""
    flat, bands, empty = net.flat(), counts.bands, counts.total == 0
    names = ["doc_id", "held", "n_tokens", "n_known", "base_score"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, pool, docs, size = Network.of(flat, bands), [], [], 0

        def flush() -> pa.RecordBatch:
            rows = pa.Table.from_batches(pool).combine_chunks().to_batches()[0]
            made = np.zeros(len(docs)) if empty else (log_likelihoods(model, docs) + rows.column("in_class").to_numpy()) / np.log(10)
            return pa.RecordBatch.from_arrays([*(rows.column(n) for n in names), pa.array(made)], [*names, "score"])

        for batch in batches:
            if not batch.num_rows:
                continue
            docs += [np.asarray(x) for x in batch.column("codes").to_numpy(zero_copy_only=False)]
            pool.append(batch.drop_columns(["codes", "row"]))
            size += int(sum(map(len, docs[-batch.num_rows :])))
            if size >= POOL:
                yield flush()
                pool, docs, size = [], [], 0
        if docs:
            yield flush()

    return codes.mapInArrow(run, "doc_id long, held boolean, n_tokens long, n_known long, base_score double, score double")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = remainder(F.col("doc_id"), 7) == 2
    codes, counts = encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), held_out)
    out = score(codes, counts, fit(codes, counts))
    return out.select("doc_id", F.col("held").alias("held_out"), "n_tokens", "n_known", F.lit(counts.total).cast("long").alias("train_tokens"), "base_score", "score")
