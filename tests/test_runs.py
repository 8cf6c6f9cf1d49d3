"""Whole runs over small fixtures, held against what each step says by hand."""

from __future__ import annotations

import json

from textloom.plans import runs
from textloom.plans.api import Options
from textloom.sources.files import read_ledger

LINES = "text string, x double, y double, w double, h double, confidence float, cell_width double, cell_variation double"


def line(key, ix, text, x, y, w, confidence=0.9):
    return (*key, ix, text, x, y, w, 10.0, confidence, None, None)


def test_images(spark, tmp_path):
    images = spark.createDataFrame([("b.png", 0, 300, 150, None), ("a.png", 1, 300, 150, None), ("c.png", 2, None, None, "no such file"), ("d.png", 3, 30, 30, None)],
                                   "file string, place long, width int, height int, error string")
    rows = [line(("a.png",), 0, "second line", 0.0, 30.0, 90.0), line(("a.png",), 1, "mail a.b@example.com", 0.0, 10.0, 90.0),
            line(("a.png",), 2, "too faint", 0.0, 50.0, 90.0, 0.1), line(("b.png",), 0, "only line", 0.0, 10.0, 90.0)]
    lines = spark.createDataFrame(rows, f"doc_id string, line_ix long, {LINES}")
    path = str(tmp_path / "ledger")
    done = runs.image_run(spark, images, lines, Options(), path)
    got = {r["file"]: r for r in done.collect()}
    assert got["a.png"]["text"] == "mail [EMAIL]\nsecond line" and got["a.png"]["redactions"] == {"EMAIL": 1}
    assert [x["text"] for x in got["a.png"]["lines"]] == ["mail [EMAIL]", "second line"]
    assert got["b.png"]["text"] == "only line" and got["d.png"]["text"] == "" and got["c.png"]["error"] == "no such file" and got["c.png"]["text"] is None
    assert got["a.png"]["image_tokens"] == 60 and got["a.png"]["text_tokens"] == round(len("mail [EMAIL]\nsecond line") / 4)
    (entry,) = read_ledger(spark, path).collect()
    assert (entry["mode"], entry["inputs"], entry["redactions"], entry["image_tokens"]) == ("image", 3, 1, 121)
    said = json.loads(runs.envelope(done.drop("lines")).first()["payload"])
    assert [r["file"] for r in said["results"]] == ["b.png", "a.png", "c.png", "d.png"] and said["image_tokens"] == 121
    runs.image_run(spark, images, lines, Options(no_ledger=True, redact=False), path)
    assert read_ledger(spark, path).count() == 1


def test_documents(spark, tmp_path):
    good = "the quick brown fox jumps over the lazy dog"
    pages = [("a.pdf", 0, 1, False, 100, 200, good), ("a.pdf", 0, 2, False, 100, 200, "x"), ("a.pdf", 0, 3, False, 100, 200, good), ("shut.pdf", 1, 1, True, 100, 200, good)]
    pages = spark.createDataFrame(pages, "doc_id string, place long, n long, locked boolean, width int, height int, layer_text string")
    rows = [line(("a.pdf", 1), 0, good, 0.0, 10.0, 300.0), line(("a.pdf", 2), 0, "read by eye", 0.0, 10.0, 90.0), line(("a.pdf", 3), 0, "some entirely different words stand here", 0.0, 10.0, 300.0)]
    lines = spark.createDataFrame(rows, f"doc_id string, page long, line_ix long, {LINES}")
    path = str(tmp_path / "ledger")
    got = {r["file"]: r for r in runs.document_run(spark, pages, lines, Options(), path).collect()}
    assert got["a.pdf"]["text"] == f"--- page 1 ---\n{good}\n\n--- page 2 ---\nread by eye\n\n--- page 3 ---\nsome entirely different words stand here"
    assert got["a.pdf"]["image_tokens"] == 3 * round(100 * 200 / 750) and got["shut.pdf"]["error"] == "password-protected"
    (entry,) = read_ledger(spark, path).collect()
    assert (entry["mode"], entry["inputs"]) == ("pdf", 1)
    forced = runs.document_run(spark, pages, lines, Options(force_ocr=True, no_ledger=True, pages=(3, 3)), path).collect()
    assert {r["file"]: r["text"] for r in forced}["a.pdf"] == "--- page 3 ---\nsome entirely different words stand here"


def test_recordings(spark, tmp_path):
    frames = spark.createDataFrame([(1, i, 2.0 * i, 300, 150, None, 0.9) for i in range(3)], "video_id long, frame_ix long, time double, width int, height int, error string, score double")
    rows = [line((1, i), k, t, 0.0, 10.0 + 20 * k, 90.0) for i, texts in enumerate((["one screen"], ["one screen"], ["another", "view"])) for k, t in enumerate(texts)]
    lines = spark.createDataFrame(rows, f"video_id long, frame_ix long, line_ix long, {LINES}")
    path = str(tmp_path / "ledger")
    (got,) = runs.recording_run(spark, frames, lines, Options("video"), path).collect()
    assert got["text"] == "[00:00]\none screen\n\n[00:04]\nanother\nview" and got["frames"] == 3
    (got,) = runs.recording_run(spark, frames, lines, Options("video", frame_times=[4.5, 4.0], no_ledger=True), path).collect()
    assert got["frames"] == 1 and got["text"] == "[00:04]\nanother\nview"
    assert read_ledger(spark, path).count() == 1


def test_newest(spark, tmp_path):
    import os

    for i, name in enumerate(["a.png", "b.pdf", "c.txt", "d.PNG"]):
        (tmp_path / name).write_text("x")
        os.utime(tmp_path / name, (1000 + i, 1000 + i))
    images, documents = runs.newest_inputs(spark, str(tmp_path), Options(count=2))
    assert [r["file"].rsplit("/", 1)[-1] for r in images.collect()] == ["d.PNG"] and [r["place"] for r in documents.collect()] == [1]
