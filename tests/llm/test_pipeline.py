"""The pipeline's stages, each held against brute force on what the stage before kept."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline
import duckdb
import pytest
from conftest import DATA, TABLES

from textloom.llm.queries import QUERIES, SQL


def test_pipeline(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = str(tmp_path / name)
        stage(spark, docs, DATA).write.parquet(out)
        before, docs = docs, spark.read.parquet(out)
        kept[name] = docs
        if name != "packing":
            assert docs.columns == columns
        ids, were = [r["doc_id"] for r in docs.collect()], [r["doc_id"] for r in before.collect()]
        assert set(ids) <= set(were)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "substring_dedup", "mixing", "packing"]
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    left = {r["doc_id"] for r in kept["toxicity"].collect()}
    clean = [d for d, t in labels.items() if t == 0]
    assert sum(d in left for d in clean) >= 0.95 * len(clean)
    windows = Counter(tuple(w[i : i + 35]) for w in (r["text"].split() for r in kept["near_duplicates"].collect()) for i in range(len(w) - 34))
    for r in kept["substring_dedup"].collect():
        w = r["text"].split()
        assert r["n_chars"] == len(r["text"]) and not any(windows[tuple(w[i : i + 35])] > 1 for i in range(len(w) - 34))
    assert corpus_pipeline.run(spark, DATA).count() == kept["packing"].count()


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    rounded = lambda v: round(v, 6) if isinstance(v, float) else v
    ours = sorted((tuple(rounded(r[c]) for c in columns) for r in df.collect()), key=repr)
    found = con.sql(SQL[name])
    at = [found.columns.index(c) for c in columns]
    assert ours == sorted((tuple(rounded(r[i]) for i in at) for r in found.fetchall()), key=repr)
