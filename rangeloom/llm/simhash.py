"""SimHash near-dedup (7) by covering locality-sensitive hashing.

A text's fingerprint has a bit for each bit position that is set in over half the hashes of its word
shingles. Fingerprints within ``radius`` bits are linked; a document's group is all that links reach.

Candidates come from ``2 ** (radius + 1) - 1`` tables. Bit position ``i`` gets a non-zero vector
``m(i)`` of ``radius + 1`` bits, and the mask of table ``v`` keeps the positions with
``<m(i), v> = 1``. At most ``radius`` positions where two fingerprints differ span a space of at most
``radius`` dimensions, so some ``v`` is orthogonal to all of them and that table's mask hides every
difference: each pair within the radius meets in some table, without exception.

Inside a bucket no pairs are listed. With ``h`` the half of ``radius``, rounded up, each member names all
values within ``h`` bits among the hidden positions, itself too, and sorting brings equal names together.
Two members within ``radius`` share a name that is within ``h`` bits of one and within ``radius - h`` of
the other. So who shares a name is linked to one of them that is within ``radius - h`` of it, if there is
one: for an even radius that is any of them, for radius 1 the member whose value the name is. All such
links are within ``radius``, none is missed, and the work is linear in the bucket. Buckets over
``SPREAD`` members do the same as rows of a Spark table, where a name is shared by no more fingerprints
than a member has names. Copies of a text have one fingerprint and are one row throughout.
Tables and names grow steeply with the radius: ``MOST`` is the largest.

Defined cases: null, empty and blank texts have fingerprint 0 and are linked like others; rows with
the same id are separate rows with the same component if their texts link; null ids are never a
component's name unless it has no other (then its name is null); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rangeloom.llm.arrow import by_batch
from rangeloom.llm.common import BROADCAST_ROWS, counted_join, freed, small_join, stored
from rangeloom.llm.components import components

RADIUS, MOST = 2, 4
#: Buckets with more members than this are spread over tasks.
SPREAD = 100_000
#: Names that a task holds at once.
NAMES = 4_000_000
#: Rows that a task looks at together, besides what completes the last bucket.
CHUNK = 50_000


def shingle_hashes(text: str | None, words: int = 3, seed: int = 42) -> np.ndarray:
    """XXH64 of each shingle of ``words`` lower-cased words, repeats included."""
    own = (text or "").encode().lower().split()  # bytes: A-Z only, and the six blanks only
    if not own:
        return np.empty(0, np.uint64)
    if len(own) <= words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(own), seed)], np.uint64)
    line = b" ".join(own)
    ends = np.cumsum(np.fromiter(map(len, own), np.int64, len(own)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(line[a:b], seed) for a, b in zip(starts.tolist(), ends[words - 1 :].tolist(), strict=False)), np.uint64, len(own) - words + 1)


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    return majority(shingle_hashes(text, words, seed))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half the hashes, 0 if there are none."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 12):
        part = hashes[at : at + (1 << 12)]
        ones += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def mark(text: Column) -> Column:
    """A hash of the text that tells rows with the same id apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def fingerprints(docs: DataFrame, *keep: str) -> DataFrame:
    """(doc_id, mark, keep, fp) of each row of ``docs`` (doc_id, text, keep); ``fp`` is the fingerprint as a signed long."""
    rows = docs.select(F.col("doc_id").cast("long"), mark(F.col("text")).alias("mark"), *keep, "text")

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = np.array([fingerprint(t) for t in batch.column("text").to_pylist()], np.uint64)
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "mark", *keep)), pa.array(made.view(np.int64))], ["doc_id", "mark", *keep, "fp"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.drop("text").schema)
    return by_batch(rows, of, f"{schema}, fp long")


def masks(radius: int = RADIUS) -> list[int]:
    """The tables' bit masks; the vectors take turns over the positions, so masks are near equal in weight."""
    dims = radius + 1
    vectors = [1 + (i * 5 + i // 7) % ((1 << dims) - 1) for i in range(64)]
    return [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() % 2) for v in range(1, 1 << dims)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _flips(mask: int, radius: int) -> list[int]:
    """What to flip of a member for its names: up to half the radius of the positions that ``mask`` hides, fewest first."""
    hidden = [1 << i for i in range(64) if not mask >> i & 1]
    return [sum(c) for k in range((radius + 1) // 2 + 1) for c in combinations(hidden, k)]


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest one that links a - b reach."""
    root = np.arange(n)
    while True:
        x, y = root[a], root[b]
        if (x == y).all():
            return root
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not (root[root] == root).all():
            root = root[root]


def _links(fps: np.ndarray, flips: list[int], radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs that link members of whole buckets of one table within ``radius``."""
    names = (fps[:, None] ^ np.array(flips, np.uint64)[None, :]).ravel()
    who = np.repeat(np.arange(len(fps)), len(flips))
    near = np.bitwise_count(fps[who] ^ names)
    order = np.lexsort((near, names))  # of those who share a name the nearest first
    names, who, near = names[order], who[order], near[order]
    first = np.concatenate([[True], names[1:] != names[:-1]])
    lead = np.flatnonzero(first)[np.cumsum(first) - 1]
    keep = (who[lead] != who) & (near[lead] <= radius - (radius + 1) // 2)
    return who[lead][keep], who[keep]


def _bucket_links(radius: int, spread: int):
    """For rows (t, fp) sorted by table and masked value: links (u, v, -1) of each bucket's members to one
    of them, or (key, 0, t) for a bucket of more than about ``spread`` members."""
    table = masks(radius)
    flips = [_flips(m, radius) for m in table]

    def bucket_roots(k: int, own: np.ndarray, start: np.ndarray) -> np.ndarray:
        """The first member that links reach from each one; whole buckets, so many at once that their names fit."""
        root, at, most = np.arange(len(own)), 0, max(1, NAMES // len(flips[k]))
        ends = np.append(start[1:], len(own))
        while at < len(own):
            fit = ends[(ends > at) & (ends <= at + most)]
            stop = int(fit[-1]) if len(fit) else int(ends[ends > at][0])
            root[at:stop] = at + _roots(stop - at, *_links(own[at:stop], flips[k], radius))
            at = stop
        return root

    def solve(t: np.ndarray, fp: np.ndarray) -> pa.RecordBatch | None:
        us, vs = [], []
        for k in np.unique(t):
            own = np.unique(fp[t == k])
            key = own & np.uint64(table[k])
            order = np.argsort(key, kind="stable")
            own, key = own[order], key[order]
            start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            many = np.repeat(np.diff(np.append(start, len(key))) > 1, np.diff(np.append(start, len(key))))
            own = own[many]
            if len(own):
                key = key[many]
                root = bucket_roots(int(k), own, np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])))
                moved = root != np.arange(len(own))
                us.append(own[moved])
                vs.append(own[root[moved]])
        if not us or not sum(map(len, us)):
            return None
        u, v = (np.concatenate(x).view(np.int64) for x in (us, vs))
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(np.full(len(u), -1))], ["u", "v", "t"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        n, skipped = 0, None  # skipped: the bucket that turned out too large
        mask = np.array(table, np.uint64)

        def named(t: int, key: int) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([_signed(key)]), pa.array([0]), pa.array([t])], ["u", "v", "t"])

        for batch in batches:
            t = batch.column("t").to_numpy(zero_copy_only=False).astype(np.int64)
            fp = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            if skipped is not None:
                other = np.flatnonzero((t != skipped[0]) | (fp & mask[t] != skipped[1]))
                first = int(other[0]) if len(other) else len(t)
                t, fp = t[first:], fp[first:]
                skipped = None if len(t) else skipped
            if not len(t):
                continue
            held.append((t, fp))
            n += len(t)
            if n >= CHUNK:
                t, fp = (np.concatenate(x) for x in zip(*held, strict=True))
                key = fp & mask[t]
                last = np.flatnonzero((t != t[-1]) | (key != key[-1]))  # the last bucket may go on
                cut = int(last[-1]) + 1 if len(last) else 0
                if cut and (out := solve(t[:cut], fp[:cut])) is not None:
                    yield out
                held, n = [(t[cut:], fp[cut:])], len(t) - cut
                if n > spread:
                    skipped = (int(t[-1]), key[-1])
                    yield named(int(t[-1]), int(key[-1]))
                    held, n = [], 0
        if n:
            t, fp = (np.concatenate(x) for x in zip(*held, strict=True))
            if (out := solve(t, fp)) is not None:
                yield out

    return run


def near_links(distinct: DataFrame, radius: int = RADIUS, spread: int = SPREAD) -> DataFrame:
    """Links (u, v) between rows ``fp`` of ``distinct``; what they reach is what pairs within ``radius`` reach.

    Buckets come to the tasks in order, one shuffle for all tables. A task that meets a bucket of more
    than ``spread`` members names it instead of holding it; those buckets are then done as rows.
    """
    if not 1 <= radius <= MOST:
        raise ValueError(f"the radius must be from 1 to {MOST}")
    table = masks(radius)
    flips = [_flips(m, radius) for m in table]
    spread = min(spread, NAMES // max(map(len, flips)))
    each = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for t, m in enumerate(table)])
    rows = distinct.select("fp", F.explode(each).alias("b")).select("fp", "b.t", "b.key")
    dealt = rows.repartition("t", "key").sortWithinPartitions("t", "key").select("t", "fp")
    found = stored(dealt.mapInArrow(_bucket_links(radius, spread), "u long, v long, t long"), "bucket_links")
    links = found.where("t < 0").select("u", "v")
    large = found.where("t >= 0").select(F.col("t").cast("int").alias("t"), F.col("u").alias("key"), F.lit(True).alias("large")).distinct()
    if large.isEmpty():
        return links
    flip = F.element_at(F.array(*[F.array(*[F.lit(_signed(x)).cast("long") for x in f]) for f in flips]), F.col("t") + 1)
    own = small_join(rows, large, ["t", "key"], F.col("fp")).where("large")
    names = own.select("t", "fp", F.explode(flip).alias("x")).select("t", "fp", F.col("fp").bitwiseXOR(F.col("x")).alias("name"))
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("name")))
    shared = names.groupBy("t", "name").agg(F.min(F.struct(near.alias("near"), "fp")).alias("lead"), F.collect_set("fp").alias("us"))
    shared = shared.where((F.size("us") > 1) & (F.col("lead.near") <= radius - (radius + 1) // 2))
    return links.unionByName(shared.select(F.explode("us").alias("u"), F.col("lead.fp").alias("v")).where("u != v"))


def near_groups(docs: DataFrame, radius: int = RADIUS, spread: int = SPREAD, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, mark, keep, fp, root, component_id) of each row of ``docs`` (doc_id, text, keep); ``root`` is a fingerprint
    of the component, ``keep`` are columns that come along."""
    with freed(docs.sparkSession) as kept:
        rows = stored(fingerprints(docs, *keep), "fingerprints")
        return kept(grouped(rows, lambda distinct: near_links(distinct.select("fp"), radius, spread)), "near_groups")


def grouped(rows: DataFrame, links: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``rows`` (doc_id, fp, ...) with root and component_id, by what the links (u, v) reach that ``links`` finds
    between their distinct ``fp``."""
    groups = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "distinct")
    roots = components(links(groups))
    rooted = groups.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = stored(rooted, "rooted")
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("fps"))
    total = groups.agg(F.sum("n"), F.count(F.lit(1))).first()
    by_fp = counted_join(rooted, stored(named, "named"), "root", "fps", total[1]).select("fp", "n", "root", "v.component_id")
    return counted_join(rows, stored(by_fp, "by_fp"), "fp", "n", total[0] or 0).select(*rows.columns, "v.root", "v.component_id")


def keep_one(docs: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """One row of each group (``groups``: as of ``near_groups``, the default), with all columns of ``docs``, whatever
    their names: the row whose id names the group; of several such rows one of those with the smallest mark.

    Where a count shows that few rows go, those are broadcast and texts stay where they are; else the rows
    that stay are joined by shuffle."""
    rows = near_groups(docs) if groups is None else groups
    named = rows.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root").agg(F.min(F.struct("mark", "doc_id")).alias("r"), F.count(F.lit(1)).alias("n"))
    named = stored(named.select(F.col("r.doc_id").alias("id"), F.col("r.mark").alias("mark"), "n"), "named")
    stays = named.select(F.col("id").alias("kept_id"), F.col("mark").alias("kept_mark"))
    gone = rows.join(stays, F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.col("mark") == F.col("kept_mark")), "left_anti")
    gone = stored(gone.select(F.col("doc_id").alias("id"), "mark").distinct(), "gone")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    mine = docs.select(F.col("doc_id").cast("long").alias("own_id"), mark(F.col("text")).alias("own"), row)
    same = F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own") == F.col("mark"))
    few = gone.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    out = mine.join(F.broadcast(gone), same, "left_anti") if few else mine.join(named, same, "left_semi")
    if not named.where("n > 1").isEmpty():
        out = out.dropDuplicates(["own_id", "own"])
    return out.select(*[F.col(f"row.`{c}`") for c in docs.columns])


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
