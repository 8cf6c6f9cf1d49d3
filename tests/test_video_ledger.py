"""A transcript is noted in the ledger unless told otherwise."""

from __future__ import annotations

from textloom.operators.frames import MAX_FRAMES
from textloom.plans.api import Options, video_tool
from textloom.sources.files import read_ledger

FRAMES = "video_id long, frame_ix long, time double, width int, height int, text string, error string"


def test_video_is_noted(spark, tmp_path):
    rows = [(1, 0, 0.0, 300, 150, "first screen", None), (1, 1, 2.0, 300, 150, "mail a.b@example.com now", None), (1, 2, 4.0, 300, 150, None, "blurred"), (2, 0, 0.0, 300, 150, None, "blurred")]
    frames = spark.createDataFrame(rows, FRAMES)
    path = str(tmp_path / "ledger")
    done = {r["video_id"]: r for r in video_tool(spark, frames, Options("video", max_frames=MAX_FRAMES), path).collect()}
    assert set(done) == {1, 2} and done[2]["error"]
    (entry,) = read_ledger(spark, path).collect()
    assert (entry["mode"], entry["inputs"], entry["image_tokens"], entry["text_tokens"]) == ("video", 2, done[1]["image_tokens"], done[1]["text_tokens"])
    assert entry["redactions"] == sum(done[1]["redactions"].values()) > 0 and entry["ts"].endswith("Z")
    video_tool(spark, frames, Options("video", no_ledger=True), path)
    assert read_ledger(spark, path).count() == 1
