"""Near-duplicates for the pipeline: SimHash with covering tables, checked exactly, linked are texts whose sets of
``WORDS``-word shingles have a Jaccard similarity of ``LEAST`` or more.

Fingerprints are those of :mod:`rangeloom.llm.simhash`, of the set of a text's ``MARK_WORDS``-word shingles, so
that texts with the same ``WORDS``-word shingles have one. Its covering tables link those within ``RADIUS`` bits,
and the members of a group of fingerprints are a bucket of candidates: no pair within the radius
misses the other there. The tables don't reach all like texts, which are up to about 11 bits apart, for which
``2 ** 12 - 1`` tables would be needed. So there are further buckets beside the groups: ``BANDS`` bands of
``DEPTH`` min-hashes; two texts of similarity s meet in some band but for a chance of
``(1 - s ** DEPTH) ** BANDS``, 0.00006 at 0.8. Two bits of each of ``HASHES`` min-hashes tell before any
text is read which candidates can be alike: a pair with over ``MISSES`` of them different is one in
100,000 pairs of similarity 0.8. What is left is checked exactly on the shingles.

A bucket's members aren't listed as pairs. The member that meets most others in its buckets leads, and
the others are checked against it. Then links are followed, and only buckets whose members aren't all
linked go on: those that aren't linked to the leader, first a few of them, then all, are checked
against the bucket's members that they aren't linked to yet. So a large group of copies costs
about a check a member, pairs are made of what is plausible and not linked already, and no two like
members of a bucket are left apart. Texts with the same shingles are one node throughout.

Defined cases: texts of at most ``WORDS`` words are one shingle; null, empty and blank texts are alike.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rangeloom.llm.arrow import by_batch, slices
from rangeloom.llm.common import freed, spread_of, stored
from rangeloom.llm.components import components
from rangeloom.llm.simhash import grouped, majority, mark, near_links, shingle_hashes

WORDS = 5
#: The words of a fingerprint's shingles, and at how many differing bits fingerprints still link.
MARK_WORDS, RADIUS = 3, 4
#: The least similarity, as a fraction of whole numbers, so that the check is exact.
LEAST = (4, 5)
BANDS, DEPTH = 32, 6
#: Min-hashes in all, of which two bits each are kept, 32 in a long; and how many may differ in those.
HASHES, MISSES = 384, 89
SIGNS = HASHES // 32
#: How many unlinked members of a bucket lead from round to round; in the last all of them.
LEADERS = (16, None)
#: Shingles whose min-hashes are taken at once.
PIECE = 2048

_random = np.random.default_rng(7)
_FLIP = _random.integers(0, 1 << 32, HASHES, dtype=np.uint32)
_TIMES = _random.integers(0, 1 << 31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def shingles(text: str | None) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    return np.unique(shingle_hashes(text, WORDS))


def bits(text: str | None) -> int:
    """The fingerprint of the set of a text's shingles."""
    return majority(np.unique(shingle_hashes(text, MARK_WORDS)))


def min_hashes(own: np.ndarray) -> np.ndarray:
    """``HASHES`` min-hashes of a set of shingles."""
    short = (own >> np.uint64(32)).astype(np.uint32)
    least = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(short), PIECE):
        np.minimum(least, ((short[at : at + PIECE, None] ^ _FLIP) * _TIMES).min(axis=0), out=least)
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    """A key a band of min-hashes."""
    rows = least[: BANDS * DEPTH].reshape(BANDS, DEPTH)
    return np.array([xxhash.xxh64_intdigest(r.tobytes(), k) for k, r in enumerate(rows)], np.uint64).view(np.int64)


def signs(least: np.ndarray) -> np.ndarray:
    """Two bits of each min-hash, packed."""
    two = (least >> np.uint32(15) & np.uint32(3)).astype(np.uint64).reshape(SIGNS, 32)
    return np.bitwise_or.reduce(two << (2 * np.arange(32, dtype=np.uint64)), axis=1).view(np.int64)


def plausible(a: str, b: str) -> Column:
    """Whether two sets, columns ``a`` and ``b`` with size and signs, may be alike."""
    over, under = LEAST
    fits = F.least(f"{a}.size", f"{b}.size") * under >= F.greatest(f"{a}.size", f"{b}.size") * over
    low = F.lit(0x5555555555555555)

    def misses(k: int) -> Column:
        x = F.col(f"{a}.signs")[k].bitwiseXOR(F.col(f"{b}.signs")[k])
        return F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(low))

    return fits & (reduce(add, [misses(k) for k in range(SIGNS)]) <= MISSES)


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets have the least similarity."""
    at = np.searchsorted(a, b)
    both = int((a[np.minimum(at, len(a) - 1)] == b).sum()) if len(a) and len(b) else 0
    over, under = LEAST
    return both * under >= over * (len(a) + len(b) - both)


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, fp, size, bits, keys, signs) of each row of ``docs`` (doc_id, text); ``fp`` names the set of shingles,
    which has no keys and signs if it is empty."""

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column("text").to_pylist()
        sets = [shingles(t) for t in texts]
        longs = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
        fps = longs([xxhash.xxh64_intdigest(s.tobytes()) for s in sets])
        least = [min_hashes(s) if len(s) else None for s in sets]
        lists = lambda f: pa.array([[] if x is None else f(x) for x in least], pa.list_(pa.int64()))
        sizes = pa.array([len(s) for s in sets], pa.int64())
        columns = [batch.column("doc_id"), batch.column("mark"), fps, sizes, longs([bits(t) for t in texts]), lists(band_keys), lists(signs)]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "mark", "fp", "size", "bits", "keys", "signs"])

    schema = "doc_id long, mark long, fp long, size long, bits long, keys array<long>, signs array<long>"
    return by_batch(docs.select(F.col("doc_id").cast("long"), mark(F.col("text")).alias("mark"), "text"), of, schema)


def sets_of(docs: DataFrame, rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """(fp, shingles) of ``nodes`` (fp), from the text of one of each node's rows."""

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column("fp"), pa.array([shingles(t).tobytes() for t in batch.column("text").to_pylist()], pa.binary())], ["fp", "shingles"])

    one = rows.groupBy("fp").agg(F.min(F.struct("mark", "doc_id")).alias("r")).join(nodes, "fp", "left_semi")
    one = one.select("fp", F.col("r.mark").alias("__m"), F.col("r.doc_id").alias("__id"))
    mine = docs.select(F.col("doc_id").cast("long").alias("doc_id"), mark(F.col("text")).alias("mark"), "text")
    met = mine.join(one, (F.col("mark") == F.col("__m")) & F.col("doc_id").eqNullSafe(F.col("__id"))).select("fp", "text")
    made = stored(by_batch(met, of, "fp long, shingles binary"), "sets")
    repeated = made.groupBy("fp").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return made if repeated.isEmpty() else stored(made.dropDuplicates(["fp"]), "sets")


def _checked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        a, b = (batch.column(c).to_pylist() for c in ("a", "b"))
        good = pa.array([alike(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(a, b, strict=True)], pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v")], ["u", "v"]).filter(good)


def checked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the stored ``pairs`` (u, v) of nodes whose ``sets`` (fp, shingles) are alike. Sets are a row a node, so
    that adaptive execution can split the pairs of a leader that very many have."""
    of = lambda c, name: sets.select(F.col("fp").alias(c), F.col("shingles").alias(name))
    return pairs.join(of("u", "a"), "u").join(of("v", "b"), "v").select("u", "v", "a", "b").mapInArrow(_checked, "u long, v long")


def bucket_members(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Members (key, m) of buckets that have several, leads (key, lead), and the nodes' keys (fp, keys); ``m`` and ``lead``
    are structs (fp, size, signs). A node's first key is that of its group of fingerprints."""
    near = components(near_links(rows.where("size > 0").select(F.col("bits").alias("fp")).distinct(), RADIUS))
    nodes = rows.groupBy("fp").agg(*[F.first(c).alias(c) for c in ("size", "bits", "keys", "signs")])
    nodes = nodes.join(near.withColumnRenamed("node", "bits"), "bits", "left")
    group = F.array(F.xxhash64(F.lit("bits"), F.coalesce("root", "bits")))
    nodes = nodes.withColumn("keys", F.when(F.col("size") > 0, F.concat(group, "keys")).otherwise(F.col("keys")))
    nodes = stored(nodes.select("fp", "size", "keys", "signs"), "nodes")
    each = nodes.select("fp", F.explode("keys").alias("key"))
    several = stored(each.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "several")
    members = stored(each.join(several, "key"), "met")  # a row a key on one side: adaptive execution splits a hot one
    meets = members.groupBy("fp").agg(F.sum("n").alias("meets"))
    known = nodes.select("fp", "size", "signs").join(meets, "fp")
    members = members.join(known, "fp").select("key", "meets", F.struct("fp", "size", "signs").alias("m"))
    members = stored(members, "members")
    leads = members.groupBy("key").agg(F.max_by("m", F.struct("meets", -F.col("m.fp"))).alias("lead"))
    return members.select("key", "m"), stored(leads, "leads"), nodes.select("fp", "keys")


def _pairs(met: DataFrame, done: list[DataFrame]) -> DataFrame:
    """The pairs (u, v) of structs ``m`` and ``lead``, each once, that haven't been checked."""
    pairs = met.select(F.col("m.fp").alias("u"), F.col("lead.fp").alias("v")).distinct()
    both = [d.select(*x) for d in done for x in (("u", "v"), (F.col("v").alias("u"), F.col("u").alias("v")))]
    return stored(pairs.join(reduce(DataFrame.unionByName, both), ["u", "v"], "left_anti") if both else pairs, "pairs")


def similar_links(docs: DataFrame, rows: DataFrame, leaders: tuple[int | None, ...] | None = None) -> DataFrame:
    """Links (u, v) that reach what like sets of ``rows``, the ``signatures`` of ``docs``, reach: one from each to the first
    of its group."""
    members, leads, keys = bucket_members(rows)
    sets = sets_of(docs, rows, members.select("m.fp").distinct())
    met = members.join(leads, "key")  # a row a key on the right, here and below
    done = [_pairs(met.where((F.col("m.fp") != F.col("lead.fp")) & plausible("m", "lead")), [])]
    roots = components(checked(done[0], sets))
    for most in leaders or LEADERS:
        root = lambda c: roots.select(F.col("node").alias(f"{c}_node"), F.col("root").alias(f"{c}_root"))
        rooted = members.join(root("m"), F.col("m.fp") == F.col("m_node"), "left").withColumn("m_root", F.coalesce("m_root", "m.fp"))
        # Buckets that aren't one group, their leader's group, and how many members are outside of it.
        heads = leads.join(root("lead"), F.col("lead.fp") == F.col("lead_node"), "left").select("key", F.coalesce("lead_root", "lead.fp").alias("main"))
        rooted = stored(rooted.select("key", "m", "m_root").join(heads, "key"), "rooted")
        apart = stored(rooted.where("m_root != main").groupBy("key").agg(F.count(F.lit(1)).alias("outside")), "apart")
        if apart.isEmpty():
            break
        left = rooted.join(apart, "key").join(keys, F.col("m.fp") == F.col("fp")).drop("fp")
        chosen = F.lit(True) if most is None else spread_of(F.lit(8), "key", "m.fp") * F.col("outside") < most
        ahead = left.where((F.col("m_root") != F.col("main")) & chosen).select(F.col("key").alias("k"), F.col("m").alias("lead"), F.col("m_root").alias("lead_root"), F.col("keys").alias("lead_keys"))
        # Two members outside of the leader's group meet in one order only.
        once = (F.col("m_root") == F.col("main")) | (F.col("m.fp") < F.col("lead.fp")) if most is None else F.lit(True)
        # A pair that shares several buckets meets in the first of them, where at least one of the two is outside.
        first = F.get(F.array_compact(F.zip_with("keys", "lead_keys", lambda a, b: F.when(a == b, a))), F.lit(0)) == F.col("key")
        met = left.join(ahead, (F.col("key") == F.col("k")) & (F.col("m_root") != F.col("lead_root")) & once & plausible("m", "lead") & first)
        pairs = _pairs(met, done)
        done.append(pairs)
        roots = components(roots.withColumnsRenamed({"node": "u", "root": "v"}).unionByName(checked(pairs, sets)))
    return roots.withColumnsRenamed({"node": "u", "root": "v"})


def similar_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, fp, root, component_id) of each row of ``docs`` (doc_id, text), as ``simhash.near_groups``."""
    with freed(docs.sparkSession) as keep:
        rows = stored(signatures(docs), "signatures")
        groups = grouped(rows.select("doc_id", "mark", "fp"), lambda _: similar_links(docs, rows))
        return keep(groups, "similar_groups")
