"""Runs and rendering of many documents, of documents over several batches, and of lines that tie."""

from __future__ import annotations

import contextlib
import io
import random
from collections import defaultdict

import pyarrow as pa
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from textloom.operators import layout
from textloom.plans import catalogue

LINE = "doc_id long, line_ix long, text string, x double, y double, w double, h double, confidence float, cell_width double, cell_variation double"


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("simple")
    return out.getvalue()


@pytest.mark.parametrize("name", ["monospace_runs", "layout_text"])
def test_no_task_a_document(spark, name):
    assert "FlatMapGroupsInPandas" not in plan(catalogue.QUERIES[name](spark, DATA))


def test_runs_of_all_documents(spark):
    """The folded documents against a fold over every one."""
    ordered = layout.reading_order(catalogue.boxes(spark, DATA).withColumn("cell_width", F.expr("if(doc_id % 3 = 0, 8 + 0.1 * line_ix, cell_width)")))
    docs = defaultdict(list)
    for r in ordered.withColumn("cell", layout.vote(F.col("text"), F.col("w"), F.col("cell_width"), F.col("cell_variation"))).collect():
        docs[r["doc_id"]].append((r["n"], r["cell"], r["x"], r["x"] + r["w"]))
    want = set()
    for d, rows in docs.items():
        _, cells, lefts, rights = zip(*sorted(rows), strict=True)
        want |= {(d, k, *run) for k, run in enumerate(layout.find_runs(list(cells), lefts, rights))}
    assert len(want) > 100
    assert {tuple(r) for r in layout.monospace_runs(ordered).collect()} == want


def test_null_and_nan(spark):
    """A null id is a document of its own, not that of id 0; a cell that is no number doesn't vote."""
    box = [(i, "x" * 10, 0.0, 20.0 * i, 80.0, 16.0, 0.9, float("nan") if i == 1 else None, None) for i in range(4)]
    lines = spark.createDataFrame([(d, *b) for d in (None, 0) for b in box[: 4 if d is None else 3]], LINE)
    runs = layout.monospace_runs(layout.reading_order(lines))
    assert [tuple(r) for r in runs.collect()] == [(None, 0, 0, 4)]
    fenced = layout.layout(lines).groupBy("doc_id").agg(F.count_if("fenced").alias("k")).collect()
    assert {r["doc_id"]: r["k"] for r in fenced} == {None: 4, 0: 0}


def test_documents_over_several_batches():
    rows = [(d, False, n) for d, many in ((1, 5), (2, 1), (3, 9), (4, 2)) for n in range(many)]
    table = pa.table(dict(zip(["tl_key", "tl_null", "n"], map(list, zip(*rows, strict=True)), strict=True)))
    for size in range(1, len(rows) + 1):
        parts = list(layout._whole(table.to_batches(max_chunksize=size)))
        assert pa.concat_tables(parts).combine_chunks().equals(table.combine_chunks())
        ids = [set(p["tl_key"].to_pylist()) for p in parts]
        assert sum(map(len, ids)) == 4


def test_ties_have_one_order(spark):
    """Lines with one place and number are told apart by what else they hold, not by the order they come in."""
    tied = [(1, 0, f"line {i}", 0.0, 0.0, 80.0 + i % 3, 16.0, 0.9, 8.0, None) for i in range(12)]
    seen = set()
    for seed in range(4):
        random.Random(seed).shuffle(tied)
        got = layout.reading_order(spark.createDataFrame(tied, LINE).coalesce(1)).orderBy("n").collect()
        seen.add(tuple(r["text"] for r in got))
    assert len(seen) == 1


def test_equal_edges_share_a_group(spark):
    """Order 34429 of sf0.1: two lines with equal edges and number begin a group; both belong to it, and three lines make a column."""
    rows = [(2, 0, 37, 160), (7, 0, 117, 216), (5, 0, 81, 232), (1, 780, 19, 104), (6, 1040, 97, 240), (6, 1040, 98, 240), (5, 1040, 81, 288)]
    lines = spark.createDataFrame([(1, i, "line", float(x), float(y), float(w), 16.0, 0.9, None, None) for i, x, y, w in rows], LINE)
    got = sorted((r["line_ix"], r["x"], r["group"]) for r in layout.column_groups(lines).collect())
    assert got == [(1, 780, 1), (2, 0, 0), (5, 0, 0), (5, 1040, 2), (6, 1040, 2), (6, 1040, 2), (7, 0, 0)]
    assert sorted((r["line_ix"], r["col_ix"]) for r in layout.assign_columns(lines).collect()) == [(1, 1), (2, 0), (5, 0), (5, 1), (6, 1), (6, 1), (7, 0)]
