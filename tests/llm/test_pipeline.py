"""The pipeline's stages in a row, each judged on what it was given."""

from __future__ import annotations

import re
from collections import Counter
from itertools import combinations

import corpus_pipeline
import duckdb
import pytest
from pyspark.sql import functions as F

from rangeloom.llm import queries
from rangeloom.llm.mixing import mix
from tests.llm.test_similarity import jaccard


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def test_names_and_registration(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "exact dedup", "near dedup", "mixing", "packing"]
    assert {int(n[2:].split("_")[0]) for n in queries.QUERIES} == set(range(1, 11))
    import __spark_entry__ as entry

    assert set(queries.QUERIES) | {"pipeline"} <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_is_its_sql(spark, sf_dir, name):
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    df = queries.QUERIES[name](spark, sf_dir)
    want = duckdb.sql(queries.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert sorted(map(tuple, df.collect())) == sorted(want.select(*df.columns).fetchall())


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    made = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        made[name] = docs
    before = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name in list(made)[:-1]:
        assert made[name].columns == before.columns
    identified, exact, near, mixed, packed = (made[n].collect() for n in made)
    assert len(identified) >= 0.98 * before.count()
    first: dict[str, int] = {}
    for r in identified:
        first[norm(r.text)] = min(first.get(norm(r.text), r.doc_id), r.doc_id)
    assert sorted(r.doc_id for r in exact) == sorted(first.values())
    # Near-dedup: five words, a similarity of 0.8 or more, by comparing all pairs.
    group = {r.doc_id: r.doc_id for r in exact}
    for a, b in combinations(exact, 2):
        if group[a.doc_id] != group[b.doc_id] and jaccard(a.text, b.text) >= 0.8:
            low, high = sorted((group[a.doc_id], group[b.doc_id]))
            group = {d: low if g == high else g for d, g in group.items()}
    assert sorted(r.doc_id for r in near) == sorted(set(group.values()))
    copies = {r.doc_id: r.copies for r in mix(made["near dedup"]).collect() if r.copies}
    assert Counter(r.doc_id for r in mixed) == Counter(copies)
    sizes = Counter()
    for r in mixed:
        sizes[r.doc_id] += len(r.text.encode().split())
    lengths = Counter()
    for r in packed:
        lengths[r.doc_id] += r.length
    assert lengths == sizes
    text = {r.doc_id: norm(r.text) for r in mixed}
    bins: dict[int, list] = {}
    for r in packed:
        bins.setdefault(r.bin_id, []).append(text[r.doc_id])
    assert all(len(x) == len(set(x)) for b, x in bins.items() if b >= 0)


def test_run_and_odd_tables(spark, odd, empty, labels, tmp_path):
    for name, docs in (("odd", odd), ("empty", empty)):
        docs.coalesce(2).write.parquet(str(tmp_path / name / "documents.parquet"))
        labels.write.parquet(str(tmp_path / name / "labels.parquet"))
        corpus_pipeline.run(spark, str(tmp_path / name)).collect()
        for q in queries.QUERIES.values():
            assert q(spark, str(tmp_path / name)).count() >= docs.count()
    assert odd.where(F.col("doc_id") == 1).count() == 1
