"""Layout of recognised lines: columns, reading order, fixed-width runs, indentation and fences.

A line is ``doc_id, line_ix, text, x, y, w, h, confidence, cell_width, cell_variation``.  Columns and order are window
expressions, and no tie that they leave open changes a result; runs depend on the run so far and are found in one pass over the
sorted lines of those documents that can have any.
"""

from __future__ import annotations

from bisect import insort
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.tokens import finite, graphemes

# Spread of a run's cells, a line's own variation, column gap in line heights, lines of a run and of a
# column, characters of a line that counts, widest indentation.
TIGHT, VARIATION, COLUMN_GAP = 0.03, 0.08, 1.5
RUN_LINES, COLUMN_LINES, VOTE_CHARS, MAX_INDENT = 3, 3, 4, 40


def _edges(df: DataFrame) -> DataFrame:
    """Adds the left and right edge; a negative width reaches to the left."""
    return df.withColumns({"tl_lo": F.least("x", F.col("x") + F.col("w")), "tl_hi": F.greatest("x", F.col("x") + F.col("w"))})


def pitch(height: Column, over=None) -> Column:
    """The median of positive heights, 1 if there are none: an aggregate, or over a window."""
    median = F.median(F.when((height > 0) & finite(height), height))
    return F.coalesce(median.over(over) if over is not None else median, F.lit(1.0))


def cell_width(text: Column, w: Column, measured: Column) -> Column:
    """A line's width a character; null if it has too few characters or no width."""
    n = graphemes(text)
    own = F.when(finite(w) & (w > 0), w / n)
    return F.when(n >= VOTE_CHARS, F.when(measured > 0, measured).otherwise(own))


def vote(text: Column, w: Column, measured: Column, variation: Column) -> Column:
    """The cell width of a line that is evidence of a fixed-width font, else null."""
    return F.when(variation.isNull() | (variation <= VARIATION), cell_width(text, w, measured))


_KEY = ["tl_key", "tl_null"]


def _keyed(df: DataFrame) -> DataFrame:
    """Adds a document key without nulls, by which all windows and joins share one partitioning, unless there is one."""
    if set(_KEY) <= set(df.columns):
        return df
    kind = df.schema["doc_id"].dataType.simpleString()
    return df.withColumns({"tl_key": F.coalesce("doc_id", F.lit("0").cast(kind)), "tl_null": F.col("doc_id").isNull()})


def _grouped(lines: DataFrame) -> DataFrame:
    """``lines`` with key, edges and ``group``."""
    doc = Window.partitionBy(*_KEY)
    placed = finite(F.col("tl_lo")) & finite(F.col("tl_hi"))
    df = _keyed(_edges(lines)).withColumns({"tl_pitch": pitch(F.col("h"), doc), "tl_placed": placed})
    by_edge = Window.partitionBy(*_KEY, "tl_placed").orderBy("tl_lo", "tl_hi", "line_ix")
    reach = F.max("tl_hi").over(by_edge.rowsBetween(Window.unboundedPreceding, -1))
    df = df.withColumn("tl_new", F.when(F.col("tl_lo") - reach < COLUMN_GAP * F.col("tl_pitch"), 0).otherwise(1))
    # Of lines of equal edges the first of the order above counts; a range has them all, in whatever order they come here.
    number = F.sum("tl_new").over(by_edge.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    return df.withColumn("group", F.when(F.col("tl_placed"), number - 1).cast("long")).drop("tl_new", "tl_placed")


def column_groups(lines: DataFrame) -> DataFrame:
    """Adds ``group``: lines whose spans overlap or are closer than the gap; null for lines without a finite span."""
    return _grouped(lines).drop(*_KEY)


def _assigned(lines: DataFrame) -> DataFrame:
    """``lines`` with key, edges, ``group`` and ``col_ix``."""
    df = _grouped(lines)
    doc, span = Window.partitionBy(*_KEY), Window.partitionBy(*_KEY, "group")
    df = df.withColumns(
        {
            "tl_real": F.col("group").isNotNull() & (F.count(F.lit(1)).over(span) >= COLUMN_LINES),
            "tl_a": F.min("tl_lo").over(span),
            "tl_b": F.max("tl_hi").over(span),
            "tl_first": F.row_number().over(span.orderBy("line_ix")) == 1,
        }
    )
    head = F.col("tl_real") & F.col("tl_first")
    left = doc.orderBy("group").rangeBetween(Window.unboundedPreceding, -1)
    df = df.withColumns({"tl_reals": F.count_if(head).over(doc), "tl_ix": F.coalesce(F.count_if(head).over(left), F.lit(0))})
    # Narrow groups go to the nearest column; only one row a group takes part in the join.
    real = df.filter(head).select(*_KEY, F.col("tl_ix").alias("to"), F.col("tl_a").alias("a"), F.col("tl_b").alias("b"))
    small = df.filter("not tl_real and tl_first and group is not null and tl_reals >= 2").select(*_KEY, "group", "tl_a", "tl_b")
    gap = F.greatest(F.lit(0.0), F.col("a") - F.col("tl_b"), F.col("tl_a") - F.col("b"))
    near = small.join(real, _KEY).groupBy(*_KEY, "group").agg(F.min(F.struct(gap.alias("gap"), F.col("to"))).alias("best"))
    df = df.join(near.select(*_KEY, "group", F.col("best.to").alias("tl_to")), [*_KEY, "group"], "left")
    col = F.when(F.col("tl_reals") < 2, 0).when(F.col("group").isNull(), F.col("tl_reals") - 1)
    col = col.when(F.col("tl_real"), F.col("tl_ix")).otherwise(F.col("tl_to"))
    return df.withColumn("col_ix", col.cast("long")).drop("tl_a", "tl_b", "tl_first", "tl_real", "tl_reals", "tl_ix", "tl_to")


def assign_columns(lines: DataFrame) -> DataFrame:
    """Adds ``col_ix``, from 0 on the left."""
    return _assigned(lines).drop(*_KEY)


def reading_order(lines: DataFrame, keyed: bool = False) -> DataFrame:
    """Adds ``col_ix`` and ``n``: the lines column by column, rows of a column's own pitch, left to right.

    ``keyed`` leaves the document key in, so that what follows needs no further shuffle.
    """
    df = _assigned(lines).withColumn("tl_row_pitch", pitch(F.col("h"), Window.partitionBy(*_KEY, "col_ix")))
    row = F.when(finite(F.col("y")), F.round(F.col("y") / F.col("tl_row_pitch"))).otherwise(float("inf"))
    left = F.when(finite(F.col("tl_lo")), F.col("tl_lo")).otherwise(float("inf"))
    rest = [c for c in ("w", "h", "text", "confidence", "cell_width", "cell_variation") if c in df.columns]  # runs and texts see one order
    order = Window.partitionBy(*_KEY).orderBy("col_ix", row, left, "y", "line_ix", *rest)
    return df.withColumn("n", F.row_number().over(order).cast("long")).drop(*([] if keyed else _KEY), "tl_lo", "tl_hi", "tl_pitch", "tl_row_pitch", "group")


def _middle(ordered: list[float]) -> float:
    k = len(ordered)
    return ordered[k // 2] if k % 2 else (ordered[k // 2 - 1] + ordered[k // 2]) / 2


def find_runs(cells: list, lefts: list[float], rights: list[float]) -> list[tuple[int, int]]:
    """Half-open ranges of fixed-width runs; ``cells`` holds each line's vote or None.

    Voters extend a stretch while all its cells agree.  A stretch is then cut at lines inside it that reach too far to
    the right, and takes in lines behind it that stay within its edges.
    """
    stretches: list[tuple[list[int], int]] = []
    voters: list[int] = []
    ordered: list[float] = []
    for i, cell in enumerate(cells):
        if cell is None:
            continue
        insort(ordered, cell)
        middle = _middle(ordered)
        if voters and not (middle > 0 and (ordered[-1] - ordered[0]) / middle <= TIGHT):
            stretches.append((voters, i))
            voters, ordered = [], [cell]
        voters.append(i)
    stretches.append((voters, len(cells)))
    runs = []
    pending = stretches[::-1]
    while pending:
        voters, limit = pending.pop()
        if len(voters) < RUN_LINES:
            continue
        slack = 0.5 * _middle(sorted(cells[i] for i in voters))
        low, high = min(lefts[i] for i in voters) - slack, max(rights[i] for i in voters) + slack
        foreign = next((i for i in range(voters[0] + 1, voters[-1]) if cells[i] is None and rights[i] > high), None)
        if foreign is not None:
            pending.append(([v for v in voters if v > foreign], limit))
            pending.append(([v for v in voters if v < foreign], foreign))
            continue
        end = voters[-1] + 1
        while end < limit and cells[end] is None and lefts[end] >= low and rights[end] <= high:
            end += 1
        runs.append((voters[0], end))
    return runs


def _whole(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Sorted batches as tables of whole documents."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        code = _codes(pa.Table.from_batches([batch]))
        first = len(code) - int(np.argmax(code[::-1] != code[-1])) if (code != code[-1]).any() else 0
        if first or (held and not all(held[-1][c][-1].equals(batch[c][0]) for c in _KEY)):
            parts = [*held, batch.slice(0, first)] if first else held
            yield pa.Table.from_batches(parts)
            held = []
        held.append(batch.slice(first))
    if held:
        yield pa.Table.from_batches(held)


def _codes(table: pa.Table) -> np.ndarray:
    """A number for each document."""
    key = table["tl_key"].combine_chunks().dictionary_encode().indices.to_numpy().astype(np.int64)
    return 2 * key + table["tl_null"].to_numpy().astype(np.int64)


def _runs_in(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in _whole(batches):
        code = _codes(table)
        at = np.flatnonzero(np.append(True, code[1:] != code[:-1])).tolist() + [len(code)]
        cells = [None if c != c else c for c in table["cell"].to_numpy().tolist()]
        lefts, rights = table["lo"].to_numpy().tolist(), table["hi"].to_numpy().tolist()
        found = [(a, k, *run) for a, b in zip(at[:-1], at[1:], strict=True) for k, run in enumerate(find_runs(cells[a:b], lefts[a:b], rights[a:b]))]
        first, *numbers = (pa.array(c, pa.int64()) for c in (zip(*found, strict=True) if found else [[]] * 4))
        done = pa.table([table["doc_id"].take(first), *numbers], names=["doc_id", "run_id", "start", "end"])
        yield from done.combine_chunks().to_batches()


def monospace_runs(ordered: DataFrame) -> DataFrame:
    """``doc_id, run_id, start, end`` (half open, from 0) of lines with ``n``.

    A run's first three voters agree, and so do the first three of the stretch that it is cut from: documents without any three
    successive voters that do have no run and aren't folded.
    """
    cell = vote(F.col("text"), F.col("w"), F.col("cell_width"), F.col("cell_variation"))
    df = _keyed(_edges(ordered)).select("doc_id", *_KEY, "n", F.col("tl_lo").alias("lo"), F.col("tl_hi").alias("hi"), F.nanvl(cell, F.lit(None)).alias("cell"))
    voters = Window.partitionBy(*_KEY, F.col("cell").isNull()).orderBy("n")
    df = df.withColumns({"tl_1": F.lag("cell", 1).over(voters), "tl_2": F.lag("cell", 2).over(voters)})
    three = [F.col(c) for c in ("cell", "tl_1", "tl_2")]
    middle = F.greatest(F.least(*three[:2]), F.least(F.greatest(*three[:2]), three[2]))
    tight = three[2].isNotNull() & (middle > 0) & ((F.greatest(*three) - F.least(*three)) / middle <= TIGHT)
    df = df.withColumn("tl_any", F.max(tight).over(Window.partitionBy(*_KEY))).filter("tl_any").drop("tl_1", "tl_2", "tl_any")
    kind = ordered.schema["doc_id"].dataType.simpleString()
    return df.repartition(*_KEY).sortWithinPartitions(*_KEY, "n").mapInArrow(_runs_in, f"doc_id {kind}, run_id long, start long, end long")


def render(ordered: DataFrame, runs: DataFrame) -> DataFrame:
    """Adds ``fenced`` and indents the text of lines in runs; runs are taken as they are."""
    df = _keyed(_edges(ordered)).withColumns(
        {
            "tl_vote": vote(F.col("text"), F.col("w"), F.col("cell_width"), F.col("cell_variation")),
            "tl_cell": cell_width(F.col("text"), F.col("w"), F.col("cell_width")),
        }
    )
    r = _keyed(runs).select(F.col("tl_key").alias("k"), F.col("tl_null").alias("z"), "run_id", "start", "end")
    inside = (df["tl_key"] == r["k"]) & (df["tl_null"] == r["z"]) & (df["n"] > r["start"]) & (df["n"] <= r["end"])
    df = df.join(r, inside, "left").drop("k", "z", "start", "end")
    run, on = Window.partitionBy(*_KEY, "run_id"), F.col("run_id").isNotNull()
    left = lambda c: F.min(F.when(on & F.col(c).isNotNull() & finite(F.col("tl_lo")), F.col("tl_lo"))).over(run)
    middle = lambda c: F.median(F.when(on, F.col(c))).over(run)
    df = df.withColumns({"v": middle("tl_vote"), "v_left": left("tl_vote"), "c": middle("tl_cell"), "c_left": left("tl_cell")})
    voters = F.col("v").isNotNull()
    df = df.withColumns({"cell": F.when(voters, F.col("v")).otherwise(F.col("c")), "left": F.when(voters, F.col("v_left")).otherwise(F.col("c_left"))})
    steps = F.when(F.col("cell") != 0, (F.col("tl_lo") - F.col("left")) / F.col("cell"))
    indent = F.when(finite(steps), F.least(F.lit(MAX_INDENT), F.greatest(F.lit(0), F.round(steps)))).otherwise(0).cast("int")
    fenced = F.col("cell").isNotNull()
    df = df.withColumns({"fenced": fenced, "text": F.when(fenced, F.concat(F.repeat(F.lit(" "), indent), "text")).otherwise(F.col("text"))})
    return df.select(*ordered.columns, "fenced")


def replace_runs(ordered: DataFrame, runs: DataFrame, second: DataFrame) -> DataFrame:
    """Lines of a run replaced by those of a second pass (``doc_id, run_id, n, text, x, y, w, h, ...``), if there are as many."""
    fields = [c for c in ordered.columns if c not in ("doc_id", "n", "line_ix", "col_ix", *_KEY)]
    r = runs.select(F.col("doc_id").alias("d"), "run_id", "start", "end")
    counts = second.groupBy(F.col("doc_id").alias("e"), F.col("run_id").alias("q")).agg(F.count(F.lit(1)).alias("many"))
    fit = r.join(counts, (r["d"] == counts["e"]) & (r["run_id"] == counts["q"])).filter(F.col("many") == F.col("end") - F.col("start"))
    fit = fit.select("d", "run_id", "start")
    s = second.join(fit, (second["doc_id"] == fit["d"]) & (second["run_id"] == fit["run_id"])).select(
        F.col("d").alias("tl_d"), (F.col("start") + F.col("n")).alias("tl_n"), *[second[c].alias(f"tl_{c}") for c in fields]
    )
    df = ordered.join(s, (ordered["doc_id"] == s["tl_d"]) & (ordered["n"] == s["tl_n"]), "left")
    new = F.col("tl_n").isNotNull()
    swapped = {c: F.when(new, F.col(f"tl_{c}")).otherwise(F.col(c)) for c in fields}
    return df.withColumns(swapped).select(*ordered.columns)


def layout(lines: DataFrame) -> DataFrame:
    """Rendered lines: ``n``, indented ``text``, ``fenced``."""
    return _laid_out(lines).drop(*_KEY)


def _laid_out(lines: DataFrame) -> DataFrame:
    ordered = reading_order(lines, keyed=True)
    return render(ordered, monospace_runs(ordered))


def laid_out_text(lines: DataFrame) -> DataFrame:
    """``doc_id, text``: ``fenced_text`` of the layout, without another shuffle."""
    return fenced_text(_laid_out(lines))


def fence_pieces(rendered: DataFrame) -> DataFrame:
    """Adds ``tl_piece``: a line with the fence lines before and behind it."""
    order = Window.partitionBy(*document_key(rendered)).orderBy("n")
    before, after = F.lag("fenced", 1, False).over(order), F.lead("n").over(order)
    opens = F.when(F.col("fenced") != before, F.lit("```\n")).otherwise("")
    closes = F.when(F.col("fenced") & after.isNull(), F.lit("\n```")).otherwise("")
    return rendered.withColumn("tl_piece", F.concat(opens, "text", closes))


def joined_pieces() -> Column:
    """A document's pieces in one text: an aggregate."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "tl_piece"))), lambda p: p["tl_piece"]), "\n")


def document_key(df: DataFrame) -> list[str]:
    """The columns that tell documents apart, as the rows are partitioned if they have the key."""
    return [*_KEY, "doc_id"] if set(_KEY) <= set(df.columns) else ["doc_id"]


def fenced_text(rendered: DataFrame) -> DataFrame:
    """``doc_id, text``: the lines joined, each fenced stretch between fence lines."""
    return fence_pieces(rendered).groupBy(*document_key(rendered)).agg(joined_pieces().alias("text")).select("doc_id", "text")
