"""Best-fit packing (3) under conflicts.

Documents are cut into pieces of at most ``capacity`` words; whole pieces fill a bin each, what is
left of each document is packed, longest first, into the bin with the least room that still holds it
and whose bitmaps don't forbid it. A bin's bitmaps say which sources and which duplicate clusters it
holds: two documents of a cluster never share a bin, and of a source there are at most as many as
the source has slots (a slot is a bit of the source bitmap; a source with a large share of the
documents has more of them, in proportion, and its documents take turns). Bins are kept in order of
their room; the search starts at the tightest bin that is large enough and goes on to the next
larger until one is compatible, so it finds the tightest compatible bin, or opens a new one.

Documents are dealt by hash to groups of about ``GROUP`` documents, each packed by itself: the tightest
compatible bin is that of the group, and only the last few bins of a group are less full than they might
be. Copies of a text are dealt like other documents and so spread over all groups. Only ids and lengths
are shuffled, not texts. A cluster is the documents with one text, or, in ``op3``, those whose SimHash
fingerprints link (within 2 bits), so that texts that differ in a few words are kept apart as well.

Defined cases: null, empty and blank texts have 0 words and get a row with bin_id -1, as they need no
room; a null source is a source of its own; repeated rows are packed each, never two in a bin; an
empty table gives an empty result; columns besides doc_id, text and source are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rangeloom.llm.common import BLANKS, WORD, n_words, stored
from rangeloom.llm.simhash import near_groups

CAPACITY = 4096
GROUP = 20_000
#: Slots that all sources share by their documents' number, one each at least.
SLOTS = 48
SCHEMA = "doc_id long, cluster long, text_hash long, piece int, bin_id long, start int, length int, offset int"


def best_fit(sizes: list[int], sources: list[int], clusters: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each item, in the order given; ``sources`` and ``clusters`` are bit numbers
    (a cluster of -1 has no other member here). Items must be ordered by falling size."""
    order: list[tuple[int, int]] = []  # (room, bin), ascending
    source_map: list[int] = []
    cluster_map: list[int] = []
    at, offsets = [], []
    holders: dict[tuple[int, int], set[int]] = {}  # open bins by bit, to tell when no open bin is free of it
    for size, source, cluster in zip(sizes, sources, clusters, strict=True):
        s, c = 1 << source, (1 << cluster if cluster >= 0 else 0)
        keys = [(0, source)] + ([(1, cluster)] if cluster >= 0 else [])
        found = -1
        k = bisect_left(order, (size, -1))
        if all(len(holders.get(key, ())) < len(order) for key in keys):
            while k < len(order):
                b = order[k][1]
                if not source_map[b] & s and not cluster_map[b] & c:
                    found = b
                    break
                k += 1
        if found < 0:
            found, room = len(source_map), capacity
            source_map.append(0)
            cluster_map.append(0)
        else:
            room = order.pop(k)[0]
        at.append(found)
        offsets.append(capacity - room)
        source_map[found] |= s
        cluster_map[found] |= c
        if room > size:
            insort(order, (room - size, found))
            for key in keys:
                holders.setdefault(key, set()).add(found)
        else:  # full: no longer searched
            for key in [k2 for k2, own in holders.items() if found in own]:
                holders[key].discard(found)
    return at, offsets


def _pack(capacity: int, slots: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        group = int(key[0])
        rows = rows.sort_values(["size", "doc_id", "text_hash"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        size = rows["size"].to_numpy()
        rest = size % capacity
        # Bits: of each source its slots, taken in turn; of each cluster that has two members here.
        name = rows["source"].map(lambda x: "n" if x is None or x != x else "s" + x)
        own_slots = (name.map(name.value_counts()) * slots // max(len(rows), 1)).clip(lower=1)
        turn = rows.groupby(name).cumcount() % own_slots
        source_bit = pd.factorize(pd.Series(list(zip(name, turn, strict=True)), dtype=object))[0]
        members = rows["cluster"].map(rows["cluster"].value_counts())
        cluster_bit = np.full(len(rows), -1)
        many = (members > 1).to_numpy()
        cluster_bit[many] = pd.factorize(rows["cluster"][many])[0]
        packed = np.flatnonzero(rest > 0)
        packed = packed[np.argsort(-rest[packed], kind="stable")]
        at, offset = best_fit(rest[packed].tolist(), source_bit[packed].tolist(), cluster_bit[packed].tolist(), capacity)
        whole = size // capacity
        doc = np.repeat(np.arange(len(rows)), whole)
        piece = np.arange(len(doc)) - np.repeat(np.cumsum(whole) - whole, whole)
        bins = max(at, default=-1) + 1
        ids, own, text = rows["doc_id"], rows["cluster"].to_numpy(), rows["text_hash"].to_numpy()
        none = np.flatnonzero(size == 0)
        parts = [
            (packed, whole[packed], np.array(at, np.int64), whole[packed] * capacity, rest[packed], np.array(offset, np.int64)),
            (doc, piece, bins + np.arange(len(doc)), piece * capacity, np.full(len(doc), capacity), np.zeros(len(doc), np.int64)),
            (none, np.zeros(len(none), np.int64), None, np.zeros(len(none), np.int64), np.zeros(len(none), np.int64), np.zeros(len(none), np.int64)),
        ]
        return pd.concat([
            pd.DataFrame({"doc_id": ids.iloc[i].to_numpy(), "cluster": own[i], "text_hash": text[i], "piece": p, "bin_id": -1 if b is None else b + (group << 32), "start": s, "length": n, "offset": o})
            for i, p, b, s, n, o in parts
        ])

    return run


def _text_hash() -> Column:
    """Documents with the same text, but for blanks, have the same."""
    return F.xxhash64(F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), BLANKS, " "))


def pack(docs: DataFrame, capacity: int = CAPACITY, group: int = GROUP, slots: int = SLOTS, near: bool = False) -> DataFrame:
    """Where each piece of each row of ``docs`` (doc_id, text, source) goes: doc_id, cluster, text_hash, piece, bin_id,
    start and length in words of the text, offset in words of the bin. With ``near`` documents are a cluster if
    their SimHash fingerprints link, otherwise if they have the same text."""
    slim = docs.select(F.col("doc_id").cast("long"), "source", "text", n_words(F.col("text")).alias("size"), _text_hash().alias("text_hash"))
    if near:
        slim = near_groups(slim, keep=("source", "size", "text_hash")).withColumnRenamed("root", "cluster")
    else:
        slim = slim.withColumn("cluster", F.col("text_hash"))
    slim = slim.select("doc_id", "source", "size", "text_hash", "cluster")
    slim = stored(slim.withColumn("row", F.monotonically_increasing_id()), "lengths")
    groups = max(1, -(-slim.count() // group))
    # By row, not id: a text that is in the table very often is spread over the groups.
    dealt = slim.withColumn("g", F.pmod(F.xxhash64(F.lit(3), "row"), F.lit(groups))).drop("row")
    return dealt.repartition(min(groups, 10_000), "g").groupBy("g").applyInPandas(_pack(capacity, slots), SCHEMA)


def bins(docs: DataFrame, packed: DataFrame) -> DataFrame:
    """The bins themselves: bin_id, length in words, text (the pieces in order, words parted by one space)
    and the ids in it. A bin is bounded by its capacity; texts are shuffled twice, to their pieces and to bins."""
    texts = docs.select(F.col("doc_id").cast("long").alias("__id"), _text_hash().alias("__c"), "text").dropDuplicates(["__id", "__c"])
    placed = packed.where("bin_id >= 0")
    met = placed.join(texts, placed["doc_id"].eqNullSafe(texts["__id"]) & (placed["text_hash"] == texts["__c"]))
    words = F.regexp_extract_all(F.col("text"), F.lit(WORD), F.lit(0))
    piece = F.struct("offset", "doc_id", F.array_join(F.slice(words, F.col("start") + 1, F.col("length")), " ").alias("text"), "length")
    each = met.select("bin_id", piece.alias("p")).groupBy("bin_id").agg(F.array_sort(F.collect_list("p")).alias("p"))
    total = F.aggregate("p", F.lit(0), lambda a, x: a + x["length"])
    return each.select("bin_id", total.alias("length"), F.array_join(F.col("p.text"), " ").alias("text"), F.col("p.doc_id").alias("doc_ids"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), near=True)
