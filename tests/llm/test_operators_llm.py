"""Each training-data operator against brute force, with nulls, empty and long texts, ties, repeats and clashing columns."""

from __future__ import annotations

import hashlib
import random
import string
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from textloom.llm import audio, chat, embedding_dedup, exchange, jaccard_join, mixing, packing, substring_dedup, suffix_index, token_store, toxicity
from textloom.llm.components import components
from textloom.llm.tokens import ChunkEncoder, tokenizer_path

#: Clashing names: internal columns of the operators and of their results.
SCHEMA = "doc_id long, text string, source string, tl_block int, n_words string, score string, size string"


def make_texts(seed: int = 3) -> list[str | None]:
    rng = random.Random(seed)
    words = ["".join(rng.choices(string.ascii_lowercase, k=rng.randint(2, 7))) for _ in range(400)]
    body = lambda n: " ".join(rng.choices(words, k=n))
    passage, base = body(60), body(200).split()
    near = [" ".join(w if rng.random() > 0.03 else "zz" for w in base) for _ in range(6)]
    texts = [body(rng.randint(1, 120)) for _ in range(25)]
    texts += [f"{body(20)} {passage}\n{body(15)}" for _ in range(6)] + near
    texts += [texts[0], texts[0], "", None, None, " \t\n", "a", "A", "one two three", "ONE two three", "é " * 700, "ab" * 600, body(4000), "x" * 5000, passage + " " + passage]
    return texts


def frame(spark, texts, empty=False):
    rows = [] if empty else [(i, t, None if i % 5 == 0 else f"s{i % 4}", i, "x", "y", "z") for i, t in enumerate(texts)]
    rows += [] if empty else [rows[3]]  # a repeated row
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def pairs_of(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


def covered(n, length, again):
    gone = [False] * n
    for i in range(n - length + 1):
        if again(i):
            gone[i : i + length] = [True] * length
    return gone


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, make_texts()).cache()


#: One level; and several, with nodes of three senders and two ranges.
SHAPES = [None, exchange.Shape(blocks=20, ranges=2, levels=3, fan=3)]


@pytest.mark.parametrize("shape", SHAPES)
def test_substring_dedup(spark, docs, shape):
    texts = pairs_of(docs)
    words = [(t or "").encode().split() for _, t in texts]
    seen = Counter(tuple(w[i : i + 35]) for w in words for i in range(len(w) - 34))
    want = []
    for (d, t), w in zip(texts, words, strict=True):
        gone = covered(len(w), 35, lambda i, w=w: seen[tuple(w[i : i + 35])] > 1)
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        want.append((d, len(w), sum(gone), hashlib.sha256(kept).hexdigest(), kept.decode() if any(gone) else t, d))
    got = substring_dedup.remove_repeats(docs, keep_text=True, carry=["tl_block", "n_words"], shape=shape)
    got = got.select("doc_id", "n_words", "n_removed", "kept_sha256", "kept_text", "tl_carry.tl_block").collect()
    flat = lambda rows: sorted((*r[:4], " ".join((r[4] or "").split()) if r[2] else r[4] or "", r[5]) for r in rows)
    assert flat(got) == flat(want)
    assert substring_dedup.remove_repeats(frame(spark, [], True)).count() == 0


def test_kept_text_keeps_its_white_space():
    text, gone = b" a\tb\n\nc d  e ", np.array([True, False, False, True, False])
    assert substring_dedup.without(text, gone) == b"b\n\nc  e"


def test_cover_holds_every_difference():
    c, p = substring_dedup.COVER, substring_dedup.PERIOD
    assert {(a - b) % p for a in c for b in c} == set(range(p))


@pytest.mark.parametrize("shape", SHAPES)
def test_suffix_index(spark, docs, shape):
    raw = [(d, (t or "").encode()) for d, t in pairs_of(docs)]
    seen = Counter(b[i : i + 400] for _, b in raw for i in range(len(b) - 399))
    want = []
    for d, b in raw:
        gone = covered(len(b), 400, lambda i, b=b: seen[b[i : i + 400]] > 1)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        want.append((d, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    assert sorted(map(tuple, suffix_index.remove_long_matches(docs, shape=shape).collect())) == sorted(want)
    assert suffix_index.remove_long_matches(frame(spark, [], True)).count() == 0


def test_suffix_index_counts_bytes_and_not_words(spark):
    rng = random.Random(8)
    passage = lambda n, size: " ".join(rng.choices(string.ascii_lowercase, k=n - 1)) + " " + "".join(rng.choices(string.ascii_lowercase, k=size - 2 * n + 2))
    for words in (51, 60, 120):
        for size in (399, 400):
            p = passage(words, size)
            assert (len(p.split()), len(p)) == (words, size)
            docs = spark.createDataFrame([(0, f"A{p}B"), (1, f"C {p}\nD"), (2, "E" * 399)], "doc_id long, text string")
            got = {r["doc_id"]: (r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_index.remove_long_matches(docs).collect()}
            kept = [f"A{p}B", f"C {p}\nD"] if size < 400 else ["AB", "C \nD"]
            for i, text in enumerate(kept):
                assert got[i] == (400 * (size == 400), int(size == 400), hashlib.sha256(text.encode()).hexdigest())
            assert got[2][0] == 0


def test_logarithmic_family_marks_both_sides():
    rng = np.random.default_rng(1)
    family, all_k, all_f, batch_of = suffix_index.LogarithmicFamily(), [], [], []
    for b in range(7):
        pairs = sorted(set(zip(rng.integers(0, 20, 12).tolist(), rng.integers(0, 3, 12).tolist(), strict=True)))
        k, f = (np.array([p[i] for p in pairs], dtype=np.uint64) for i in (0, 1))
        family.add(suffix_index.names_of(k, f))
        all_k, all_f, batch_of = all_k + k.tolist(), all_f + f.tolist(), batch_of + [b] * len(k)
    for i, mark in enumerate(family.marks):
        others = [j for j in range(len(all_k)) if batch_of[j] != batch_of[i] and all_k[j] == all_k[i]]
        assert bool(mark & suffix_index.PREFIX) == bool(others)
        assert bool(mark & suffix_index.EXTENT) == any(all_f[j] == all_f[i] for j in others)
        assert bool(mark & suffix_index.MIXED) == any(all_f[j] != all_f[i] for j in others)
    assert len(family.levels) == bin(7).count("1")


@given(st.lists(st.integers(0, 2**32 - 1), min_size=0, max_size=300), st.booleans())
@settings(max_examples=20, deadline=None)
def test_packed_keys_round_trip(values, many):
    v = np.sort(np.array(values * (40 if many else 1), dtype=np.uint64) << np.uint64(20))
    assert (exchange.unpack_sorted(exchange.pack_sorted(v)) == v).all()


def test_messages_grow_with_the_text_alone():
    for size in (10**8, 10**11, 10**14):
        shape = exchange.Shape.of(size, 12)
        assert shape.ranges <= exchange.FAN and shape.blocks <= exchange.FAN**shape.levels and shape.last * exchange.RANGE_BYTES >= size
    assert exchange.Shape.of(10**8, 12).ranges == exchange.Shape.of(10**8, 211).ranges
    counts = np.array([1, 2, 100, 128, 129, 1000, 10**6])
    codes = exchange.code_of(counts)
    assert (np.diff(codes.astype(int)) >= 0).all() and codes[:4].tolist() == [1, 2, 100, 128]
    assert (exchange.code_of(exchange.count_of(np.arange(256, dtype=np.uint8)))[1:] == np.arange(256)[1:]).all()


def shingles(text):
    low = bytes.maketrans(string.ascii_uppercase.encode(), string.ascii_lowercase.encode())
    w = (text or "").encode().translate(low).split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


@pytest.mark.parametrize("shape, piece", [(SHAPES[0], jaccard_join.PIECE), (SHAPES[1], 2)])
def test_jaccard_join(spark, docs, shape, piece):
    texts = pairs_of(docs)
    sets = [(d, shingles(t)) for d, t in texts]
    label = {d: d for d, _ in sets}
    changed = True
    while changed:
        changed = False
        for d, a in sets:
            for e, b in sets:
                if a and b and label[d] != label[e] and 100 * len(a & b) >= 75 * len(a | b):
                    label[d] = label[e] = min(label[d], label[e])
                    changed = True
    got = jaccard_join.similar_documents(docs, shape=shape, piece=piece).collect()
    assert sorted(map(tuple, got)) == sorted((d, len(s), label[d]) for d, s in sets)
    kept = {r["doc_id"] for r in jaccard_join.keep_one(docs).collect()}
    assert kept == set(label.values())
    assert jaccard_join.similar_documents(frame(spark, [], True)).count() == 0


def test_jaccard_join_collapses_case_and_white_space(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(jaccard_join, "scratch", lambda *_: str(tmp_path / "found"))
    words = "One two THREE four five six seven \u00c9t\u00e9 nine".split()
    gaps = [" ", "\t\n", "  "]
    texts = [gaps[i % 3].join(w.upper() if w.isascii() and i >> k & 1 else w for k, w in enumerate(words)) for i in range(40)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(100, " ".join(words).replace("\u00c9", "\u00e9")), (101, None), (102, " \n")]
    got = {r["doc_id"]: tuple(r)[1:] for r in jaccard_join.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: (5, 0) for i in range(40)} | {100: (5, 100), 101: (0, 101), 102: (0, 102)}
    assert spark.read.parquet(str(tmp_path / "found")).count() == 3


def test_jaccard_join_of_repeated_and_null_ids(spark):
    one, other = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(40))
    rows = [(3, other), (5, one), (5, other), (9, one), (None, one), (None, "only here")]
    got = jaccard_join.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = [(3, 36, 3), (5, 26, 3), (5, 36, 3), (9, 26, 3), (None, 26, None), (None, 1, None)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


@given(st.lists(st.text("ab \u00e9\u4e2d.", max_size=30), max_size=6))
@settings(max_examples=30, deadline=None)
def test_trigrams_of_rows_don_t_depend_on_cuts(rows):
    """Counts of the rows one by one and in one buffer with tiny pieces are the same."""
    count = lambda raw, size: sum(toxicity.trigrams(p) for p in toxicity.pieces(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0] + [len(r) for r in raw]), size))
    raw = [r.encode() for r in rows]
    whole, cut = count(raw, 1 << 20), count(raw, 3)
    assert (whole == cut).all()


def test_jaccard_join_follows_a_chain(spark):
    """Neighbours link, all others don't: each text moves on by a seventh of its words."""
    words = [f"w{i}" for i in range(40 + 5 * 400)]
    rows = [(i, " ".join(words[5 * i : 5 * i + 40])) for i in range(400)] + [(1000, " ".join(f"v{i}" for i in range(40)))]
    got = jaccard_join.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["component_id"]) for r in got} == {(i, 0) for i in range(400)} | {(1000, 1000)}


def test_sketches_bound_the_symmetric_difference():
    rng = np.random.default_rng(5)
    for n in (3, 10, 60, 70, 500, 700):
        a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[: n - n // 4], rng.integers(0, 2**64, n // 3, dtype=np.uint64)]))
        x, y = jaccard_join.sketch_of(a), jaccard_join.sketch_of(b)
        least = min(len(x), len(y))
        distance = int(np.bitwise_count(jaccard_join.folded(x, least) ^ jaccard_join.folded(y, least)).sum())
        assert distance <= len(np.setxor1d(a, b))


def test_proposals_go_on_until_all_pairs_are_settled(spark, monkeypatch):
    """Documents that share one symbol: a chain whose ends don't link, and far ones; tasks of two rows, one proposal a row."""
    monkeypatch.setattr(jaccard_join, "CLOSEST", 1)
    sets = [np.arange(10 * i, 10 * i + 100, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) for i in (0, 2, 1, 3, 90, 91)]
    sets = [np.sort(x) for x in sets]
    rows = [(i, len(x), jaccard_join.sketch_of(x), x.astype("<u8").tobytes()) for i, x in enumerate(sets)]
    frame_ = spark.createDataFrame(rows, "id long, n long, sketch binary, data binary")
    keys = spark.createDataFrame([(7, i, i) for i in range(6)], "key long, id long, row long")
    none = spark.createDataFrame([], "a long, b long")
    got = {r["id"]: r["component"] for r in jaccard_join.linked(keys, frame_, none, piece=2).collect()}
    assert {i: got.get(i, i) for i in range(6)} == {0: 0, 1: 0, 2: 0, 3: 0, 4: 4, 5: 4}


def test_components(spark):
    edges = [(i + 1, i) for i in range(40)] + [(200, 100), (300, 200), (7, 3), (100, 100)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[300] == got[200] == got[100] == 100


def test_mixing(spark, docs):
    got = mixing.mix_sources(docs).collect()
    sizes = Counter()
    for r in docs.collect():
        sizes[r["source"]] += len((r["text"] or "").encode().split())
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, target, open_ = sum(sizes.values()), {}, set(order)
    while open_:
        rest, weights = total - sum(target.values()), sum(weight[s] for s in open_)
        full = {s for s in open_ if rest * weight[s] / weights > 3 * sizes[s]}
        if not full:
            target |= {s: rest * weight[s] / weights for s in open_}
            break
        target |= {s: 3.0 * sizes[s] for s in full}
        open_ -= full
    of = {r["doc_id"]: r["source"] for r in docs.collect()}
    taken = Counter()
    for r in got:
        s = of[r["doc_id"]]
        assert r["source_size"] == sizes[s] and abs(r["target"] - target[s]) < 1e-6 and 0 <= r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 3 * mixing.BLOCK_TOKENS for s in order)
    assert sorted(got) == sorted(mixing.mix_sources(docs.repartition(5)).collect())
    mixed = mixing.take(docs)
    assert mixed.columns == docs.columns and sum(len(r["text"].split()) for r in mixed.collect()) >= 0.9 * sum(taken.values())
    assert mixing.mix_sources(frame(spark, [], True)).count() == 0


def test_toxicity(spark):
    rng = random.Random(5)
    words = ["".join(rng.choices("aeioulnrst", k=rng.randint(3, 8))) for _ in range(300)]
    bad = ["blorgen", "skumpig", "draffel"]
    hide = [lambda w: w, lambda w: w.replace("o", "0").replace("e", "3"), lambda w: " ".join(w), lambda w: w[0] + w[1] * 5 + w[2:]]
    rows, labels = [], []
    for i in range(900):
        toxic = i % 6 == 0
        w = rng.choices(words, k=40)
        if toxic:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(hide if i % 5 == 0 else hide[:1])(rng.choice(bad)))
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    rows += [(9000, None), (9001, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash"))
    model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = {r["doc_id"]: r for r in toxicity.score_documents(docs, model).collect()}
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got.values())
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got)
    wrong = [i for i, t in labels if got[i]["held_out"] and got[i]["predicted"] != t]
    assert len(wrong) <= 0.05 * sum(r["held_out"] for r in got.values())
    assert toxicity.reject_toxic(docs, model).columns == docs.columns
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r["predicted"] for r in toxicity.score_documents(docs, toxicity.train(docs, none)).collect()} <= {0, 1}
    assert toxicity.score_documents(docs.limit(0), model).count() == 0


def test_toxicity_decodes_tokens_of_any_length():
    words = "you are so stupid fuck this ass and that is as it was the rest of it "
    buf = np.frombuffer((words * 50).encode(), np.uint8)
    decoder = toxicity.Decoder(toxicity.log_model(toxicity.trigrams(buf)))

    def restored(text):
        low = toxicity.lowered(np.frombuffer(text.encode(), np.uint8))
        return {w for _, token, glued in toxicity.obfuscated(low, np.array([0, len(low)])) for w in decoder(token, glued).split()}

    assert "fuck" in restored("f" + "u" * 300 + "ck")
    assert "stupid" in restored("stup1d" + "!" * 80)
    assert "stupid" in restored("youareso" * 6 + "stup1d" + "thatisthe" * 3)
    assert "ass" in restored("4$$") and "ass" in restored("455") and "as" in restored("4s")
    assert "ass" in restored("a s s") and "ass" in restored("a -- 5 -- $")
    assert "stupid" in restored("st up id") and "fuck" in restored("f u u u u u c k")
    assert restored("\u00fc" * 9 + "x") and restored("\u8a9e" * 30 + "0")
    assert restored("2026-11-26 plain words here!") <= {"o", "i", "l", "il", "li", "ii", "ll"}
    long = "st0pid" * 3000
    whole = toxicity.Decoder(toxicity.log_model(toxicity.trigrams(buf)))
    whole.PIECE = 1 << 30
    assert decoder.decode(long, True) == whole.decode(long, True)


def test_embeddings(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "TILE_ROWS", 40)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(30, 16))
    x = [list(map(float, np.float32(centres[i % 30] + rng.normal(scale=0.12, size=16)))) for i in range(300)]
    x += [x[0], x[0], [0.0] * 16, None, [float("nan")] * 16, [None] * 16, [float("inf")] + [1.0] * 15, [], [2 * v for v in x[5]]]
    df = spark.createDataFrame([(i, v, 1) for i, v in enumerate(x)], "vec_id long, embedding array<float>, n int")
    ok = [i for i, v in enumerate(x) if v and None not in v and np.isfinite(v).all() and any(v)]
    u = np.array([np.float32(x[i]) for i in ok], dtype=float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    linked = (u @ u.T) >= 0.95
    np.fill_diagonal(linked, False)
    label = list(ok)
    for _ in range(len(ok)):
        new = [min([label[k], *[label[j] for j in np.flatnonzero(linked[k])]]) for k in range(len(ok))]
        if new == label:
            break
        label = new
    want = {i: (0, i, True) for i in range(len(x))} | {i: (int(linked[k].sum()), label[k], label[k] == i) for k, i in enumerate(ok)}
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.near_duplicates(df).collect()}
    assert got == want and sum(v[0] for v in want.values()) > 100
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_chunk_encoder_gives_the_librarys_ids():
    import pyarrow as pa

    odd = ["", None, "  lead", "a  b\n\n c ", "x<|endoftext|>y <|endoftext|> z", "It's I'LL don't", "é à  b", "<|STARTOFTEXT|> q", "tab\tx  ", "　 b c", "  d", " ́y", "日本 語 a", "a\x1c b", *make_texts()]
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        path = tokenizer_path(name)
        lib = Tokenizer.from_file(path)
        ids, offs = ChunkEncoder(path).encode(pa.array(odd))
        for i, t in enumerate(odd):
            assert ids[offs[i] : offs[i + 1]].tolist() == lib.encode(t or "", add_special_tokens=False).ids


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_token_store(spark, docs, tmp_path, encoding):
    path, lib = tokenizer_path("word_bpe_49k.json"), Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    out = str(tmp_path / "tokens")
    token_store.write_tokens(docs, out, path, encoding=encoding)
    at, want = 0, []
    for d, t in sorted(pairs_of(docs), key=lambda x: (x[0], x[1] or "")):
        ids = lib.encode(t or "", add_special_tokens=False).ids + [2]
        want.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, token_store.digests(spark, out).collect())) == sorted(want)
    meta = {(r["doc_id"], r["start"], r["n_tokens"]) for r in token_store.read_metadata(spark, out).collect()}
    assert meta == {w[:3] for w in want}
    assert {r["doc_id"] for r in token_store.read_tokens(spark, out, 5, 7).collect()} == {5, 6, 7}
    import pyarrow.parquet as pq

    file = next(p for p in (tmp_path / "tokens").glob("*.parquet") if pq.ParquetFile(p).metadata.num_rows)
    group = pq.ParquetFile(file).metadata.row_group(0)
    column = next(c for c in map(group.column, range(group.num_columns)) if c.path_in_schema.startswith("token_ids"))
    assert ("DELTA_BINARY_PACKED" in column.encodings) == (encoding == "delta")
    assert all(group.column(i).has_column_index is True for i in range(3))


def test_audio(spark, docs):
    got = audio.digests(audio.store_texts(docs)).collect()
    texts = defaultdict(set)
    for d, t in pairs_of(docs):
        texts[d].add(t)
    by_text = {}
    for r in got:
        raw = (next(iter(texts[r["doc_id"]])) or "").encode()
        payload = raw.ljust(max(1, -(-len(raw) // 64)) * 64, b"\0")
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert by_text.setdefault(raw, (r["media_sha256"], r["feature"])) == (r["media_sha256"], r["feature"])
    assert audio.digests(audio.store_texts(frame(spark, [], True))).count() == 0
    assert audio.scan_media(audio.store_texts(docs)).filter("frames > 0 and bad_checksums = 0 and seconds > 0").count() == len(got)


@given(st.binary(min_size=1, max_size=5000))
@settings(max_examples=40, deadline=None)
def test_audio_round_trip(data):
    stream = audio.encode(data)
    assert audio.payload_of(stream, audio.scan_stream(stream)) == data


def test_audio_text_that_looks_like_a_tag():
    for size in (64, 128, 192, 512, 1024, 1408, 1472, 5000):
        n = len(audio.encode(bytes(size)))
        spots = {p for p in range(size - 2) if audio.encode(bytes(p) + b"TAG" + bytes(size - p - 3))[n - 128 : n - 125] == b"TAG"}
        for p in spots:
            data = b"x" * p + b"TAG" + b"y" * (size - p - 3)
            stream = audio.encode(data)
            scan = audio.scan_stream(stream)
            assert audio.payload_of(stream, scan) == data and "ID3v1:title" not in scan.tags and scan.resyncs == 0
            tagged = audio.scan_stream(stream + b"TAG" + b"title".ljust(125, b"\0"))
            assert tagged.offsets == scan.offsets and tagged.tags["ID3v1:title"] == "title" and tagged.resyncs == 0
        assert spots or size in (64, 1472)
    broken = bytearray(audio.encode(bytes(5000)))
    broken[audio.scan_stream(bytes(broken)).offsets[1]] = 0
    with pytest.raises(ValueError):
        audio.payload_of(bytes(broken), audio.scan_stream(bytes(broken)))


def test_audio_resynchronises():
    stream = bytearray(audio.encode(bytes(range(256)) * 40))
    whole = audio.scan_stream(bytes(stream))
    assert whole.table["frames"] == len(whole.offsets) and whole.samples == 1152 * len(whole.offsets)
    stream[whole.offsets[2] + 5] ^= 1
    assert audio.scan_stream(bytes(stream)).bad_checksums == 1
    stream[whole.offsets[4]] = 0
    again = audio.scan_stream(b"junk" * 50 + bytes(stream) + b"TAG" + b"title".ljust(125, b"\0"))
    assert again.resyncs >= 1 and len(again.offsets) >= len(whole.offsets) - 3 and again.tags["ID3v1:title"] == "title"
    assert audio.scan_stream(b"no audio at all").offsets == []


def test_packing(spark, docs):
    lib = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    got = packing.pack_documents(docs, tokenizer_path("byte_bpe_50k.json")).collect()
    ids = {d: lib.encode(t or "", add_special_tokens=False).ids + [0] for d, t in pairs_of(docs)}
    pieces, bins = defaultdict(set), defaultdict(list)
    for r in got:
        pieces[r["doc_id"]].add((r["piece"], r["start"], r["length"], r["ids_crc32"]))
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for d, all_ids in ids.items():
        want = [(k, s, n, zlib.crc32(np.array(all_ids[s : s + n], "<u4").tobytes())) for k, (s, n) in enumerate(packing.cut_pieces(len(all_ids), 2048))]
        assert sorted(pieces[d]) == want
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= 1.25 * sum(r["length"] for r in got) / 2048 + 1
    assert packing.pack_documents(frame(spark, [], True), tokenizer_path("byte_bpe_50k.json")).count() == 0


@given(st.lists(st.integers(1, 32), max_size=60))
@settings(max_examples=50, deadline=None)
def test_sum_of_squares_places_where_the_sum_is_least(lengths):
    where, offset, made = packing.sum_of_squares(np.array(lengths, dtype=np.int64), 32)
    level: dict[int, int] = {}
    for n, w, o in zip(lengths, where.tolist(), offset.tolist(), strict=True):
        def square(change):
            gaps = Counter(32 - v for v in {**level, **change}.values() if v < 32)
            return sum(c * c for c in gaps.values())

        choices = [square({w2: v + n}) for w2, v in level.items() if v + n <= 32] + [square({-1: n})]
        assert o == level.get(w, 0) and square({w: o + n}) == min(choices)
        level[w] = o + n
    assert made == len(level) and all(v <= 32 for v in level.values())


def test_chat(spark):
    rng = random.Random(4)
    bits = ["<|", "<|turn|>", "<|text|>", "<|end|>", "\\", "<", "|", "[INST]", "[/INST]", "</s>", "<s>", "é", "a b", "\n"]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "<|end|>", None]), None if rng.random() < 0.1 else "".join(rng.choices(bits, k=rng.randint(0, 9)))) for c in (1, 2, None) for t in (0, 1, 1, 3, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("start", F.lit("clash"))
    formatted = chat.format_turns(df)
    got = {r["conv_id"]: r for r in chat.conversation_digests(formatted).collect()}
    whole = {r["conv_id"]: r for r in chat.flatten_conversation(formatted).collect()}
    read = {(r["conv_id"], r["turn_ix"]): (r["role"], r["text"]) for r in chat.read_turns(formatted).collect()}
    for c in (1, 2, None):
        mine = [read[c, k + 1] for k in range(5)]
        assert sorted(mine) == sorted((r or "", t or "") for cc, _, r, t in rows if cc == c)
        loss = "".join(t for r, t in mine if r == "assistant")
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in mine).encode()).hexdigest()
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        text = whole[c]["formatted"]
        assert got[c]["formatted_chars"] == len(text) and text.count("<|end|>") == 5 and "[INST]" not in text and "</s>" not in text
        assert len(whole[c]["loss_mask"]) == sum(r == "assistant" for r, _ in mine)
    assert chat.conversation_digests(chat.format_turns(df.limit(0))).count() == 0


def test_chat_parts(spark):
    parts = [("text", "see <|", None, None, None, None, None), ("image", None, "a.png", 56, 29, None, None), ("audio", None, "b.mp3", None, None, 2.5, None), ("document", None, "c.pdf", None, None, None, 3)]
    df = spark.createDataFrame([(1, 0, "user", parts)], f"conv_id long, turn long, role string, parts {chat.PART}")
    row = chat.format_turns(df.withColumn("text", F.lit(None).cast("string")), parts="parts").first()
    assert row["segment"] == "<|turn|>user<|text|>see <\\|<|image:1|><|audio:2|><|document:3|><|end|>"
    assert [(a["part"], a["type"], a["ref"], a["tokens"]) for a in row["attachments"]] == [(1, "image", "a.png", 4), (2, "audio", "b.mp3", 63), (3, "document", "c.pdf", 2304)]
    assert row["attachment_tokens"] == 2371
