"""Vectors and invariants of the engine's own operators."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from textloom.functions import tokens as T
from textloom.operators import gate, geometry, layout, ledger, pagetext, payload, transcript
from textloom.operators.redact import redact, total
from textloom.operators.rules import BUILTIN, Rule, RuleError, checked, parse_rules, usable, with_custom
from textloom.plans import api
from textloom.sources import files
from textloom.streaming import streams


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expr(F.col("v")).alias("x")).first()["x"]


def test_custom_rules_come_first_and_nulls_stay(spark):
    rules = with_custom([Rule("MINE", r"ada@\S+")])
    rows = redact(spark.createDataFrame([("ada@example.org and bob@example.org",), (None,)], "text string"), "text", rules).collect()
    assert rows[0]["redacted"] == "[MINE] and [EMAIL]" and rows[0]["redactions"] == {"MINE": 1, "EMAIL": 1}
    assert rows[1]["redacted"] is None and rows[1]["redactions"] == {}


def test_redaction_is_stable_and_survives_filters(spark):
    df = spark.createDataFrame([("call (212) 555-0199, up 10.1.2.3",)], "text string")
    first = redact(df).filter(F.size("redactions") > 0).filter(F.contains("redacted", F.lit("IPV4")))
    again = redact(first.select(F.col("redacted").alias("text")))
    row = again.select("text", "redacted", total(F.col("redactions")).alias("n")).first()
    assert row["text"] == row["redacted"] and row["n"] == 0


def test_rule_files(spark):
    rules = parse_rules(spark, '[{"name": "a-b", "pattern": "x+"}, {"name": "c", "pattern": "Y", "caseInsensitive": false}]')
    assert [(r.name, r.ignore_case) for r in rules] == [("A-B", True), ("C", False)]
    for bad in ('{"a": 1}', '[{"name": "a b", "pattern": "x"}]', '[{"name": "", "pattern": "x"}]', '[{"name": "é", "pattern": "x"}]', '[{"name": "a", "pattern": "("}]', "nonsense",
                '[{"name": "a", "pattern": "x"}, {"name": "A", "pattern": "y"}]', '[{"name": "a"}]'):
        with pytest.raises(RuleError):
            parse_rules(spark, bad)
    broken = Rule("BAD", "(")
    assert usable(spark, [broken, BUILTIN[0]])[1] == [broken]
    with pytest.raises(RuleError, match="BAD"):
        checked(spark, [broken])


def test_tokens(spark):
    assert [one(spark, "x" * n, T.text_tokens) for n in (0, 8, 9, 10)] == [1, 2, 2, 3]
    assert one(spark, "é\r\n", T.graphemes) == 2
    assert [one(spark, n, T.short_number, "long") for n in (0, 999, 1000, 41200, 999949, 1500000)] == ["0", "999", "1.0k", "41.2k", "999.9k", "1.5M"]
    assert one(spark, "  a b \n", T.strip) == "a b"


def test_ledger(spark, tmp_path):
    rows = [("2020-01-01T00:00:00Z", "image", 1, 1000, 100, 2), ("2024-01-30T00:00:00Z", "video", 12, 2000, 500, 1)]
    df = spark.createDataFrame(rows, "ts string, mode string, inputs long, image long, text long, red long")
    entries = df.select(*ledger.entry(*[F.col(c) for c in df.columns]))
    s = ledger.summary(entries).first()
    assert (s["runs"], s["days"], s["inputs"], s["saved"], s["percent"], s["redactions"]) == (2, 2, 13, 2400, 80, 3)
    assert ledger.summary(entries, 7, F.lit("2024-01-31").cast("timestamp")).first()["runs"] == 1
    path = str(tmp_path / "ledger")
    assert ledger.summary(files.read_ledger(spark, path)).first()["runs"] == 0
    ledger.append(entries, path)
    (tmp_path / "ledger" / "extra.json").write_text('{"ts":"x"}\nnonsense\n{"image_tokens":"a"}\n')
    assert ledger.by_mode(files.read_ledger(spark, path)).count() == 2
    assert "runs           2" in ledger.report(entries).first()["report"]
    lines = [r["line"] for r in ledger.report_rows(entries).orderBy("place").collect()]
    assert lines[0].endswith("(2 days, by mode)") and lines[-1].startswith("  TOTAL") and len({len(x) for x in lines[1:]}) == 1


def test_migration_happens_once(spark, tmp_path):
    old, path = tmp_path / "old", str(tmp_path / "ledger")
    assert files.migrate_tsv(spark, str(old), path) == 0
    old.mkdir()
    (old / "a.tsv").write_text("2024-01-01T00:00:00Z\timage\t1\t100\t40\t0\t2\nshort\tline\n2024-01-01T00:00:00Z\timage\tx\t1\t1\t1\t1\n")
    assert files.migrate_tsv(spark, str(old), path) == 1
    assert files.migrate_tsv(spark, str(old), path) == 0
    assert ledger.summary(files.read_ledger(spark, path)).first()["saved"] == 60


LINE = "doc_id long, line_ix long, text string, x double, y double, w double, h double, confidence float, cell_width double, cell_variation double"


def lines(spark, boxes, doc=1):
    return spark.createDataFrame([(doc, i, t, float(x), float(y), float(w), float(h), 0.9, c, v) for i, (t, x, y, w, h, c, v) in enumerate(boxes)], LINE)


def code(n, x=0.0, y0=0.0):
    return [("x" * (10 + i), x + 32.0 * (i % 2), y0 + 20.0 * i, 8.0 * (10 + i), 16.0, None, None) for i in range(n)]


def test_layout_fences_and_indents_code(spark):
    out = layout.layout(lines(spark, code(4))).orderBy("n").collect()
    assert all(r["fenced"] for r in out) and [len(r["text"]) - len(r["text"].lstrip()) for r in out] == [0, 4, 0, 4]
    text = layout.fenced_text(layout.layout(lines(spark, code(4)))).first()["text"]
    assert text.startswith("```\n") and text.endswith("\n```")


def test_runs():
    inf = float("inf")
    assert layout.find_runs([None, None, 8, 8, 8], [0] * 5, [90] * 5) == [(2, 5)]
    assert layout.find_runs([8, 8], [0, 0], [9, 9]) == []
    assert layout.find_runs([8, 8, 8.9, 9.8], [0] * 4, [9] * 4) == []
    assert layout.find_runs([8, 8, 8, None], [0] * 4, [90, 90, 90, 30]) == [(0, 4)]
    assert layout.find_runs([8, 8, 8, None], [50, 50, 50, 0], [90, 90, 90, 20]) == [(0, 3)]
    assert layout.find_runs([8, 8, 8, None, 8, 8, 8], [0] * 7, [90, 90, 90, 500, 90, 90, 90]) == [(0, 3), (4, 7)]
    assert layout.find_runs([8, None, 8, 8], [50, 0, 50, 50], [90, 10, 90, 90]) == [(0, 4)]
    assert layout.find_runs([8, 8, 8, None], [0] * 4, [90, 90, 90, inf]) == [(0, 3)]


def test_reading_order_ignores_input_order(spark):
    boxes = [(f"t{i}", 10.0 * (i % 7), 7.0 * i, 60.0, 12.0, None, None) for i in range(60)]
    wanted = None
    for seed in (1, 2):
        shuffled = list(boxes)
        random.Random(seed).shuffle(shuffled)
        got = [r["text"] for r in layout.reading_order(lines(spark, shuffled)).orderBy("n").collect()]
        wanted = wanted or got
        assert got == wanted


def test_columns_and_broken_boxes(spark):
    left = [("a", 0, 20 * i, 100, 16, None, None) for i in range(3)]
    right = [("b", 300, 20 * i, 100, 16, None, None) for i in range(3)]
    stray, broken = ("s", 180, 5, 10, 16, None, None), ("n", float("nan"), 5, 10, 16, None, None)
    got = {r["line_ix"]: r["col_ix"] for r in layout.assign_columns(lines(spark, [*left, *right, stray, broken])).collect()}
    assert [got[i] for i in range(8)] == [0, 0, 0, 1, 1, 1, 0, 1]
    order = layout.layout(lines(spark, [("x", float("inf"), float("nan"), 1, 1, None, None), ("y", 0, 0, 10, 10, None, None)])).orderBy("n").collect()
    assert [r["text"] for r in order] == ["y", "x"]


def test_pages(spark):
    layer = "the quick brown fox jumps over the lazy dog\nand runs far away"
    page = spark.createDataFrame([(1, layer)], "p long, layer_text string")
    cases = {"the quick brown fox jumps": 0, "the quick brawn fox jumps over the lazy": 0, "wholly other words stand here": 1, "one two": 0, "the quick brown ﬁx fox jumps over": 0}
    for text, misses in cases.items():
        found = spark.createDataFrame([(1, 1, text)], "p long, l long, text string")
        assert pagetext.layer_misses(found, page, ["p"], ["l"]).first()["misses"] == misses, text
    both = spark.createDataFrame([(1, 1, "wholly other words stand here")], "p long, l long, text string")
    assert pagetext.choose_lanes(page, both, ["p"], ["l"]).first()["lane"] == "scan"
    assert one(spark, "", lambda c: files.content_hash(F.lit("abc"))) == "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"


def frames(spark, texts):
    rows = [(1, i, 2.0 * i, 300, 150, t, None if t is not None else "bad") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "video_id long, frame_ix long, time double, width int, height int, text string, error string")


def test_transcript(spark):
    row = transcript.transcribe(frames(spark, ["mail a@b.org now", "mail a@b.org now", None, " \n"])).first()
    assert (row["frames"], row["failed_frames"], row["image_tokens"], row["redactions"]) == (3, 1, 180, {"EMAIL": 1})
    assert row["text"] == "[00:00]\nmail [EMAIL] now" and len(row["segments"]) == 1
    assert "failed on all 2" in transcript.transcribe(frames(spark, [None, None])).first()["error"]
    assert transcript.kept_screens(transcript.screens(frames(spark, ["a", "b"]), None), 0.0).count() == 0


def test_line_array_falls_back_line_by_line(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b")], "doc_id long, n long, text string").withColumns(
        {"x": F.lit(10.4), "y": F.lit(20.6), "w": F.lit(100.0), "h": F.lit(16.0), "confidence": F.lit(0.5).cast("float")}
    )
    out = payload.line_array(df, "doc_id", [Rule("ALL", r"a\s*b")]).first()["lines"]
    assert [i["text"] for i in out] == ["a", "b"] and out[0]["bbox"] == [10, 21, 110, 37]
    assert '"version"' in payload.envelope(df.select("n", F.lit(1).alias("image_tokens"))).first()["payload"]


def test_geometry(spark):
    words = spark.createDataFrame([(1, 24.0, 3, 400.0), (1, 32.0, 4, 400.0), (1, 36.0, 4, 400.0), (1, 399.0, 5, 400.0), (2, 8.0, 1, 400.0)], "l long, width double, chars int, line_width double")
    row = geometry.cell_statistics(words, ["l"]).collect()
    assert len(row) == 1 and row[0]["cell_width"] == 8.0
    w, h = geometry.page_pixels(F.lit(100.0), F.lit(200.0), F.lit(-90))
    assert spark.range(1).select(w.alias("w"), h.alias("h")).first()[:] == (400, 200)


def test_gate_stream_and_consumption(spark, tmp_path):
    path = str(tmp_path / "in")
    rows = [("p", "allow", 0, 10, 1), ("p", "read", 5, None, 2), ("p", "read", 6, None, 3), ("q", "allow", 0, 1, 4), ("q", "read", 5, None, 5)]
    spark.createDataFrame(rows, "path string, kind string, at long, expiry long, seq long").write.parquet(path)
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
    got = {r["seq"]: r["allowed"] for r in streams.run_available(streams.gate_stream(stream), "gate_test", "append", str(tmp_path / "c")).collect()}
    assert got == {2: True, 3: False, 5: False}
    asked = spark.createDataFrame([(1, "/private/tmp/a"), (2, "/tmp/a")], "seq long, path string")
    allow = spark.createDataFrame([(50, "/tmp/a", 1), (500, "/tmp/a", 2)], "expiry long, path string, seq long")
    out, left = gate.consume(asked, allow, F.lit(100))
    assert {r["seq"]: r["allowed"] for r in out.collect()} == {1: True, 2: False} and left.count() == 0


def test_options(spark, tmp_path):
    assert api.parse_pages("2-5") == (2, 5) and api.parse_pages("3") == (3, 3)
    for bad in ("0", "5-2", "a", "", "1-", "-1"):
        with pytest.raises(api.UsageError):
            api.parse_pages(bad)
    for bad in ({"dedupe": 1.5}, {"scene": float("nan")}, {"max_frames": 0}, {"days": 3}, {"frame_times": [1.0]}, {"command": "allow"}, {"paths": ["a.png"], "pages": (1, 2)}):
        with pytest.raises(api.UsageError):
            api.Options(**bad)
    p = tmp_path / "a.txt"
    p.write_text("mail a@b.org\n\n")
    rows = api.text_tool(spark, api.Options("text", [str(p), str(tmp_path / "none")])).collect()
    assert rows[0]["text"] == "mail [EMAIL]\n" and rows[1]["error"] == "cannot read"
    assert api.text_tool(spark, api.Options("text", [str(p)], redact=False)).first()["text"] == "mail a@b.org\n"


def test_digits_of_other_scripts_count(spark):
    card = "5500 0000 0000 0004".translate({ord(str(i)): chr(0x660 + i) for i in range(10)})
    row = redact(spark.createDataFrame([(f"card {card} here",)], "text string")).first()
    assert row["redacted"] == "card [CARD] here"


def test_allowances_match_paths_one_way(spark):
    asked = spark.createDataFrame([(1, "/tmp/a"), (2, "/private/tmp/a"), (3, "/private/tmp/a"), (4, "/private/tmp/a")], "seq long, path string")
    allow = spark.createDataFrame([(500, "/private/tmp/a", 7), (500, "/tmp/a", 8), (500, "/tmp/a", 9)], "expiry long, path string, seq long")
    out, left = gate.consume(asked, allow, F.lit(100))
    assert {r["seq"]: r["allowed"] for r in out.collect()} == {1: True, 2: True, 3: True, 4: False} and left.count() == 0
    out, left = gate.consume(asked.filter("seq = 1"), allow.filter("seq = 7"), F.lit(100))
    assert [r["allowed"] for r in out.collect()] == [False] and left.count() == 1


def test_the_last_error_is_the_latest(spark):
    rows = [(1, 0, 0.0, 10, 10, None, "zebra"), (1, 1, 1.0, 10, 10, None, "apple")]
    frames = spark.createDataFrame(rows, "video_id long, frame_ix long, time double, width int, height int, text string, error string")
    assert transcript.transcribe(frames).first()["error"].endswith("last error: apple")


def test_a_path_asked_twice_is_read_twice(spark, tmp_path):
    p = tmp_path / "a.txt"
    p.write_text("x\n")
    assert [r["text"] for r in files.read_texts(spark, [str(p), str(p)]).collect()] == ["x", "x"]
