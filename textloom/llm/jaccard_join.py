"""N-gram Jaccard self-join with parity sketches.

A document's set are its distinct 5-word shingles (A-Z lower-cased).  *Parity sketches:* each shingle flips one bit, so a bit says
whether an odd number of shingles fall on it, and the Hamming distance of two sketches is at most the symmetric difference of the sets.
A Jaccard similarity of 3/4 bounds that by a seventh of both sizes, and by a third of either.  A document has its sketch in two
resolutions: a wide one, kept as the XOR of its bits' 64-bit codes in each part of the hash space (a *symbol*), and a dense one of 2
to 16 bits a shingle, in which a bit is the parity of all wide ones that fold on it.

*Pigeonhole:* a differing bit spoils one part.  Order the symbols by any order that all documents share; the first symbol on which two
linked documents agree has at most ``size // 3`` before it, so joining the first ``size // 3 + 1`` loses no link.  Rarest symbols come
first, so those that common lines and passages cause are left out unless most of a document consists of them.  *Size bands* are powers
of 8; a document takes part in its own band and, where a partner may be in the next, in that.  A document with so few symbols that
all may differ takes a symbol that stands for all such documents of the band.

*Verification* never forms all pairs of documents that share a symbol.  First each is compared with the least id that shares the symbol.
Then, wherever the documents of a symbol are not all connected, those outside the largest connected part are held against that part and
each other by Hamming distance, in pieces of a bounded number of rows, and the nearest of those near enough are verified on the sets.
That repeats, with more pairs a row each time, until a round has nothing new to propose and leaves nothing out: then each pair
that shares a symbol is refuted by the bound, refuted on the sets, or connected by verified links.

Texts of equal words (in any case and spacing) are one class and compared once.  Symbols are counted in a presence exchange; only
shared ones among the first leave a block, as plain rows, and a symbol that a third of all rows hold is aggregated before it is shuffled.

Edge cases: fewer than five words are one shingle, none are the empty set, which links with nothing; rows that share an id
are one node, each with its own set size; null ids link with nothing and have a set size; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import string

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.llm import exchange as X
from textloom.llm.components import components
from textloom.llm.hashing import U, Words, mix, prefix, release, window, windows
from textloom.session import checkpointed, scratch, sweep

SHINGLE = 5
#: Percent of the union that two linked sets share at least.
SIMILAR = 75
BAND, LEAST_PARTS = 8, 1024
#: Rows of one symbol that are compared in one task.
PIECE = 4096
#: Pairs proposed for a row in the first round, and how many times as many in each further one, until none is left out.
CLOSEST, GROWTH = 16, 8
#: Pairs (of 16 bytes) that are broadcast at most; more are shuffled.
SMALL = 100_000
#: Bytes that a bucket of such tasks has on average.
BUCKET_BYTES = 16 << 20
FOUND = "id long, digest binary, n long, data binary, sketch binary, symbols array<long>"
NO_ID = -(2**63)


_LOWER = bytes.maketrans(string.ascii_uppercase.encode(), string.ascii_lowercase.encode())


def digest_of(text: str) -> bytes:
    """Equal for texts of equal words, whatever the case of A-Z and the white space between."""
    return hashlib.md5(b" ".join(text.encode().translate(_LOWER).split())).digest()


@F.pandas_udf(T.BinaryType())
def _digests(texts: pd.Series) -> pd.Series:
    return texts.map(digest_of, na_action="ignore")


class Sets:
    """Distinct shingle hashes of a text column's rows, sorted in each row."""

    def __init__(self, column, size: int = SHINGLE) -> None:
        words = Words(column, 1, lower=True)
        first, hashes = words.first, words.hashes[0]
        count = np.diff(first)
        many = np.maximum(count - size + 1, (count > 0).astype(np.int64))
        self.first = np.concatenate([[0], np.cumsum(many)])
        h = np.empty(int(self.first[-1]), dtype=U)
        long_rows = np.repeat(count >= size, many)
        start = np.arange(len(h)) + np.repeat(first[:-1] - self.first[:-1], many)
        h[long_rows] = windows(hashes, start[long_rows], size, 0)
        for row in np.flatnonzero((count > 0) & (count < size)):
            part = hashes[first[row] : first[row + 1]]
            whole = window(prefix(part, 0), np.array([0]), np.array([len(part)]), 0)
            h[self.first[row]] = mix(whole + U(int(count[row])))[0]
        for a, b in zip(self.first[:-1].tolist(), self.first[1:].tolist(), strict=True):
            h[a:b].sort()
        row = np.repeat(np.arange(len(count)), many)
        new = np.ones(len(h), dtype=bool)
        new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
        self.hashes, self.rows = h[new], row[new]
        self.sizes = np.bincount(self.rows, minlength=len(count))
        self.first = np.concatenate([[0], np.cumsum(self.sizes)])


def bands(sizes: np.ndarray) -> np.ndarray:
    """The power of ``BAND`` at or below each size (0 for empty sets)."""
    out = np.zeros(len(sizes), dtype=np.int64)
    limit = BAND
    while (sizes >= limit).any():
        out[sizes >= limit] += 1
        limit *= BAND
    return out


def symbols(sets: Sets) -> tuple[np.ndarray, np.ndarray]:
    """``(row, symbol)`` of the non-empty parts of each row's sketches, the next band's as row + number of rows."""
    n = len(sets.sizes)
    band = bands(sets.sizes)
    rows, keys = [], []
    for up in (0, 1):
        j = band + up
        takes = (sets.sizes > 0) & ((up == 0) | (4 * sets.sizes >= 3 * BAND ** (band + 1)))
        on = takes[sets.rows]
        h, r = sets.hashes[on], sets.rows[on]
        if not len(h):
            continue
        parts = np.maximum(LEAST_PARTS, BAND ** (j + 1)).astype(U)[r]
        part = ((h >> U(32)) * parts) >> U(32)
        new = np.ones(len(h), dtype=bool)
        new[1:] = (part[1:] != part[:-1]) | (r[1:] != r[:-1])
        at = np.flatnonzero(new)
        symbol = np.bitwise_xor.reduceat(h, at)
        rows.append(r[at] + up * n)
        keys.append(mix(symbol ^ mix(part[at] + (j[r[at]].astype(U) << U(48)))))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, U)
    return np.concatenate(rows), np.concatenate(keys)


def sketch_of(hashes: np.ndarray) -> bytes:
    """The dense sketch: as many bits as twice the top of the set's band, each the parity of the hashes that begin with its number."""
    width = 3 * (int(bands(np.array([len(hashes)]))[0]) + 1) + 1
    odd = np.bincount((hashes >> U(64 - width)).astype(np.int64), minlength=1 << width) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def folded(sketch: bytes, size: int) -> np.ndarray:
    """A sketch in ``size`` bytes: each bit of the smaller one is the parity of a byte of the next larger one."""
    bits = np.frombuffer(sketch, np.uint8)
    while len(bits) > size:
        bits = np.packbits(np.bitwise_count(bits) & 1)
    return bits


def _pack_classes(table: pa.Table) -> pa.Table:
    """The classes that a block represents, as one reply."""
    table = table.sort_by([("id", "ascending"), ("digest", "ascending")])
    ids = table["id"].fill_null(NO_ID).to_numpy().astype("<i8")
    blob = ids.tobytes() + b"".join(table["digest"].to_pylist())
    return X._table(X.REPLY, [table["tl_block"][0].as_py()], [0], [None], [blob])


class _Block:
    """The classes that a block represents, with their sets and symbols; the same on every pass."""

    def __init__(self, table: pa.Table, replies: pa.Table) -> None:
        table = X.ordered(table)
        self.note = blob = X.note(replies) or b""
        k = len(blob) // 24
        owned = set(zip(np.frombuffer(blob, "<i8", k).tolist(), (blob[8 * k + 16 * i :][:16] for i in range(k)), strict=True))
        ids = {i for i, _ in owned}
        rows, self.ids, self.digests = [], [], []
        texts = table["tl_text"]
        for row, i in enumerate(table["tl_id"].fill_null(NO_ID).to_pylist()):
            if i in ids and texts[row].is_valid:
                digest = digest_of(texts[row].as_py())
                if (i, digest) in owned:
                    owned.remove((i, digest))
                    rows.append(row)
                    self.ids.append(i)
                    self.digests.append(digest)
        self.sets = Sets(texts.take(pa.array(rows, pa.int64())))
        self.rows, keys = symbols(self.sets)
        self.keys, self.place, self.times = np.unique(keys, return_inverse=True, return_counts=True)

    def shared(self, replies: pa.Table, shape: X.Shape) -> tuple[np.ndarray, np.ndarray]:
        """``(row, symbol)`` of those among each row's first symbols that other documents may have."""
        n = len(self.sets.sizes)
        blocks = X.marks(X.Short, replies, [self.keys], shape)
        many = np.bincount(self.rows, minlength=2 * n)
        hot = ((blocks > 1) | (self.times > 1))[self.place]
        rows, key, rank = self.rows[hot], self.keys[self.place[hot]], blocks[self.place[hot]]
        order = np.lexsort((key, rank, rows))
        rows, key = rows[order], key[order]
        shared = np.bincount(rows, minlength=2 * n)
        first = np.concatenate([[0], np.cumsum(shared)])[:-1]
        far = np.tile(self.sets.sizes, 2) // 3
        # Symbols that no other document has come before all shared ones.
        take = np.arange(len(rows)) - first[rows] < (far + 1 - (many - shared))[rows]
        few = np.flatnonzero((many > 0) & (many <= far))
        band = np.tile(bands(self.sets.sizes), 2)[few] + (few >= n)
        return np.concatenate([rows[take], few]) % max(1, n), np.concatenate([key[take], mix(U(0xF0F0F0F0) + band.astype(U))])


def _send(shape: X.Shape):
    def send(left: pa.Table, right: pa.Table) -> pa.Table:
        block = _Block(left, right)
        return X.messages(X.Short, left["tl_block"][0].as_py(), [block.keys], shape, block.note)

    return send


def _candidates(shape: X.Shape):
    """A block's classes with their set sizes; sets, sketches and symbols of those that share symbols."""

    def found(left: pa.Table, right: pa.Table) -> pa.Table:
        block = _Block(left, right)
        rows, keys = block.shared(right, shape)
        ids = np.array(block.ids, dtype=np.int64)
        usable = ids[rows] != NO_ID
        rows, keys = rows[usable], keys[usable]
        order = np.lexsort((keys, rows))
        rows, keys = rows[order], keys[order].view(np.int64)
        at = np.searchsorted(rows, np.arange(len(ids) + 1))
        sets, first = block.sets, block.sets.first
        each = [sets.hashes[first[i] : first[i + 1]] if at[i + 1] > at[i] else None for i in range(len(ids))]
        return pa.table(
            {
                "id": pa.array(ids, pa.int64(), mask=ids == NO_ID),
                "digest": pa.array(block.digests, pa.binary()),
                "n": pa.array(sets.sizes, pa.int64()),
                "data": pa.array([None if e is None else e.astype("<u8").tobytes() for e in each], pa.binary()),
                "sketch": pa.array([None if e is None else sketch_of(e) for e in each], pa.binary()),
                "symbols": pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(keys)),
            }
        )

    return found


def similar(a: bytes, b: bytes) -> bool:
    """Whether two sets (sorted distinct hashes) link."""
    a, b = np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")
    at = np.searchsorted(a, b)
    at[at == len(a)] = 0
    both = int((a[at] == b).sum())
    return 100 * both >= SIMILAR * (len(a) + len(b) - both)


def near(a: bytes, b: bytes, size: int) -> bool:
    """Whether the Hamming distance of two sketches allows a link of sets of ``size`` elements together."""
    least = min(len(a), len(b))
    return 7 * int(np.bitwise_count(folded(a, least) ^ folded(b, least)).sum()) <= size


def _near(batches):
    for batch in batches:
        rows = zip(*(batch[c].to_pylist() for c in ("sa", "sb", "na", "nb")), strict=True)
        close = pa.array([near(x, y, i + j) for x, y, i, j in rows], pa.bool_())
        yield pa.RecordBatch.from_arrays([batch["a"], batch["b"], close], names=["a", "b", "ok"])


def _similar(batches):
    for batch in batches:
        ok = [similar(x.as_py(), y.as_py()) for x, y in zip(batch["da"], batch["db"], strict=True)]
        yield pa.RecordBatch.from_arrays([batch["a"], batch["b"], pa.array(ok, pa.bool_())], names=["a", "b", "ok"])
    release()


TRIED = "a long, b long, ok boolean"


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``a, b`` of those pairs of ids of which any sets link: by sizes and sketches first, then by the sets."""
    side = lambda i, *c: sets.select(F.col("id").alias(f"i{i}"), *[F.col(k).alias(f"{k[0]}{i}") for k in c])
    a, b = side("a", "n", "sketch"), side("b", "n", "sketch")
    pairs = pairs.select("a", "b").distinct()
    light = pairs.join(a, pairs["a"] == a["ia"])
    light = light.join(b, (light["b"] == b["ib"]) & (4 * F.least("na", "nb") >= 3 * F.greatest("na", "nb")))
    close = light.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(_near, TRIED).filter("ok").select("a", "b").distinct()
    close = checkpointed(close)
    few = close.count() <= SMALL
    least = F.broadcast if few else lambda df: df
    x, y = side("a", "data"), side("b", "data")
    if few:
        ids = close.select(F.col("b").alias("tl_b")).distinct()
        y = y.join(F.broadcast(ids), y["ib"] == ids["tl_b"], "left_semi")
    both = x.join(least(close), close["a"] == x["ia"]).select("a", "b", "da")
    both = both.join(y, both["b"] == y["ib"]).select("a", "b", "da", "db")
    return both.mapInArrow(_similar, TRIED).filter("ok").select("a", "b").distinct()


def nearest(label: np.ndarray, size: np.ndarray, sketch: list[bytes], outer: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """For each row of ``outer`` the ``most`` rows of other labels that are nearest, of those near enough to link; and whether there are more."""
    least = min(map(len, sketch))
    flat = np.zeros((len(sketch), -(-least // 8) * 8), dtype=np.uint8)
    for i, s in enumerate(sketch):
        flat[i, :least] = folded(s, least)
    flat = flat.view(np.uint64)
    out_a, out_b, more = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], False
    for x in outer.tolist():
        others = np.flatnonzero((label != label[x]) & (4 * np.minimum(size, size[x]) >= 3 * np.maximum(size, size[x])))
        distance = np.bitwise_count(flat[others] ^ flat[x]).sum(axis=1, dtype=np.int64)
        close = 7 * distance <= size[others] + size[x]
        others, distance = others[close], distance[close]
        if len(others) > most:
            others, more = others[np.argsort(distance, kind="stable")[:most]], True
        out_a.append(np.full(len(others), x))
        out_b.append(others)
    return np.concatenate(out_a), np.concatenate(out_b), more


def _propose(most: int):
    """The pairs of a bucket of tasks worth verifying; a row without ids says that there are more."""

    def propose(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in ("task", "id", "n", "sketch")])
        task = table["task"].combine_chunks().dictionary_encode().indices.to_numpy()
        ids, label, n = (table[c].to_numpy() for c in ("id", "label", "n"))
        outer, sketch = table["outer"].to_numpy(zero_copy_only=False), table["sketch"].to_pylist()
        low, high, more = [], [], False
        at = np.flatnonzero(np.append(True, task[1:] != task[:-1])).tolist() + [len(task)]
        for s, e in zip(at[:-1], at[1:]):
            x, y, cut = nearest(label[s:e], n[s:e], sketch[s:e], np.flatnonzero(outer[s:e]), most)
            x, y, more = ids[s:e][x], ids[s:e][y], more or cut
            low.append(np.minimum(x, y))
            high.append(np.maximum(x, y))
        found = pa.table({"a": pa.array(np.concatenate(low), pa.int64()), "b": pa.array(np.concatenate(high), pa.int64())})
        found = found.group_by(["a", "b"]).aggregate([]).cast(pa.schema([("a", pa.int64()), ("b", pa.int64())]))
        return pa.concat_tables([found, pa.table({"a": [None], "b": [None]}, schema=found.schema)]) if more else found

    return propose


def _unsettled(keys: DataFrame, labels: DataFrame, sets: DataFrame, piece: int) -> DataFrame:
    """``task, outer, id, label, n, sketch``: what has still to be compared, dealt to tasks of bounded size.

    Where the documents of a symbol aren't all connected, those outside its largest part (outer) are held against all that part's
    documents, once a part however many symbols say so, and against each other, once for each set of such documents.
    Pieces go by pieces: a document goes to as many tasks as there are pieces on the other side.
    """
    of = labels.withColumnRenamed("id", "tl_of")
    marked = keys.join(of, keys["id"] == of["tl_of"], "left").select("key", "id", F.coalesce("component", "id").alias("label"))
    parts = marked.groupBy("key", "label").agg(F.count(F.lit(1)).alias("rows"))
    top = parts.groupBy(F.col("key").alias("tl_key")).agg(F.max(F.struct("rows", "label")).alias("top"), F.count(F.lit(1)).alias("parts"))
    top = top.filter("parts > 1").select("tl_key", F.col("top.label").alias("main"), "parts")
    outer = checkpointed(marked.join(top, (marked["key"] == top["tl_key"]) & (marked["label"] != top["main"])).select("key", "id", "label", "main", "parts").distinct())
    # Against the largest part.
    ours = outer.select("main", "id", "label").distinct()
    mains = ours.groupBy("main").agg(F.count(F.lit(1)).alias("many"))
    whole = mains.join(of, mains["main"] == of["component"], "left").select("main", "many", F.coalesce("tl_of", "main").alias("id"))
    sized = whole.groupBy("main").agg(F.count(F.lit(1)).alias("all"), F.max("many").alias("many")).withColumnRenamed("main", "tl_main")
    pieces = lambda c: F.ceil(F.col(c) / piece).cast("int")
    mine = lambda c: F.pmod(F.xxhash64("id"), pieces(c)).cast("int")
    upto = lambda c: F.sequence(F.lit(0), pieces(c) - 1)
    name = lambda kind, of_, i, j: F.concat_ws(" ", F.lit(kind), of_, i, j)
    deal = lambda df, to, label, out: df.select(F.explode(to).alias("task"), F.lit(out).alias("outer"), "id", F.col(label).alias("label"))
    one = ours.join(sized, ours["main"] == sized["tl_main"])
    two = whole.drop("many").join(sized, whole["main"] == sized["tl_main"])
    dealt = [
        deal(one, F.transform(upto("all"), lambda j: name("part", F.col("main"), mine("many"), j)), "label", True),
        deal(two, F.transform(upto("many"), lambda i: name("part", F.col("main"), i, mine("all"))), "main", False),
    ]
    # Against each other.
    code = lambda i: F.bit_xor(F.xxhash64("id", F.lit(i)))
    groups = outer.filter("parts > 2").groupBy("key").agg(F.count(F.lit(1)).alias("all"), code(1).alias("x"), code(2).alias("y"))
    groups = groups.groupBy("all", "x", "y").agg(F.min("key").alias("tl_key")).select("tl_key", "all")
    rest = outer.join(groups, outer["key"] == groups["tl_key"]).select("key", "id", "label", "all")
    dealt += [
        deal(rest, F.transform(F.sequence(mine("all"), pieces("all") - 1), lambda j: name("rest", F.col("key"), mine("all"), j)), "label", True),
        deal(rest.filter(mine("all") > 0), F.transform(F.sequence(F.lit(0), mine("all") - 1), lambda i: name("rest", F.col("key"), i, mine("all"))), "label", False),
    ]
    tasks = dealt[0].unionByName(dealt[1]).unionByName(dealt[2]).unionByName(dealt[3])
    small = sets.select(F.col("id").alias("tl_of"), "n", "sketch")
    return tasks.join(small, tasks["id"] == small["tl_of"]).select("task", "outer", "id", "label", "n", "sketch")


def linked(keys: DataFrame, sets: DataFrame, twins: DataFrame, piece: int = PIECE) -> DataFrame:
    """``id, component`` of the documents that link with others.

    ``keys``: ``key, id, row`` of shared symbols (``row`` tells sets of equal ids apart); ``sets``: ``id, n, sketch, data``; ``twins``: ``a, b`` that are connected from the start.
    """
    seen = keys.groupBy("key").agg(F.min("id").alias("b"), F.max("id").alias("most"), F.bit_xor(F.xxhash64("id", "row")).alias("x"))
    # Of symbols with the same documents (by 64 bits, the first and the last of them) one is enough.
    least = seen.filter("b < most").groupBy("b", "most", "x").agg(F.min("key").alias("tl_key")).select("tl_key", "b")
    keys = checkpointed(keys.join(least, keys["key"] == least["tl_key"]).select("key", "id", "b"))
    proposed = checkpointed(keys.filter("id > b").select(F.col("b").alias("a"), F.col("id").alias("b")).distinct())
    keys = keys.select("key", "id")
    links = checkpointed(verified(proposed, sets))
    sweep(keys.sparkSession)
    tree = components(links.unionByName(twins))
    tried, tasks, most = proposed, None, CLOSEST
    while True:
        if tasks is None:
            tasks = checkpointed(_unsettled(keys, tree, sets, piece))
            size = tasks.agg(F.sum(F.octet_length("sketch") + 64)).first()[0] or 0
        buckets = max(X.partitions(keys.sparkSession), -(-size // BUCKET_BYTES))
        bucket = F.pmod(F.xxhash64("task"), F.lit(buckets))
        sweep(keys.sparkSession)
        found = checkpointed(tasks.groupBy(bucket).applyInArrow(X.lean(_propose(most)), "a long, b long").distinct())
        proposed = checkpointed(found.filter("a is not null").join(tried, ["a", "b"], "left_anti"))
        if proposed.isEmpty():
            if found.filter("a is null").isEmpty():
                return tree
            most *= GROWTH
            continue
        most *= GROWTH
        tried = tried.unionByName(proposed)
        links = checkpointed(verified(proposed, sets))
        if not links.isEmpty():
            own = tree.filter("id > component").select(F.col("id").alias("a"), F.col("component").alias("b"))
            tree, tasks = components(links.unionByName(own)), None


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its group; rows with a null id stay."""
    groups = similar_documents(docs.select(id_col, text_col), id_col, text_col)
    gone = groups.filter(F.col("component_id") < F.col(id_col)).select(F.col(id_col).alias("tl_gone"))
    return docs.join(gone, docs[id_col] == gone["tl_gone"], "left_anti")


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shape: X.Shape | None = None, piece: int = PIECE) -> DataFrame:
    """One row a document: ``id_col, n_shingles, component_id``."""
    spark = docs.sparkSession
    shape = shape or X.shape_of(docs, text_col)
    rows = X.blocked(docs, id_col, text_col, shape).withColumn("tl_id", F.col("tl_id").cast("long"))
    key, text = docs[id_col], docs[text_col]
    digest = _digests(text.cast("string"))
    members = checkpointed(docs.select(key.cast("long").alias("id"), digest.alias("digest"), X.block_of(key, text, shape.blocks).alias("tl_block")))
    # A class is represented by its smallest id; a null id counts as the largest.
    least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "tl_block")).alias("least")
    classes = members.filter(F.col("digest").isNotNull()).groupBy("digest").agg(least).select("digest", "least.id", "least.tl_block")
    packed = classes.groupBy("tl_block").applyInArrow(_pack_classes, X.REPLY)
    counted = X.resolve(X.with_replies(rows, packed, _send(shape), X.MESSAGE), X.Short, shape)
    out = scratch(spark, "shingles")
    X.with_replies(rows, counted, _candidates(shape), FOUND).write.option("compression", "zstd").parquet(out)
    found = spark.read.schema(FOUND).parquet(out)
    keys = found.select(F.explode("symbols").alias("key"), "id", F.xxhash64("digest").alias("row"))
    sets = found.filter(F.col("data").isNotNull()).select("id", "n", "sketch", "data")
    # Classes that share an id are one node.
    reps = found.filter("n > 0").select(F.col("digest").alias("tl_digest"), F.col("id").alias("rep"))
    placed = members.filter(F.col("id").isNotNull()).join(reps, F.col("digest") == F.col("tl_digest"))
    same = placed.groupBy("id").agg(F.min("rep").alias("b"), F.max("rep").alias("most")).filter("b < most").select(F.col("id").alias("tl_id"), "b")
    twins = placed.join(same, placed["id"] == same["tl_id"]).filter("rep > b").select(F.col("rep").alias("a"), "b").distinct()
    groups = linked(keys, sets, twins).withColumnsRenamed({"id": "of"})
    sized = found.select(F.col("id").alias("rep"), F.col("digest").alias("tl_digest"), "n")
    known = sized.join(groups, sized["rep"] == groups["of"], "left").select("tl_digest", "n", F.coalesce("component", "rep").alias("component"))
    joined = members.join(known, members["digest"] == known["tl_digest"], "left")
    shingles = F.coalesce("n", F.lit(0)).cast("long")
    component = F.when(F.col("id").isNotNull() & (shingles > 0), F.col("component")).otherwise(F.col("id"))
    return joined.select(F.col("id").alias(id_col), shingles.alias("n_shingles"), component.alias("component_id"))
