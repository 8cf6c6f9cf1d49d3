"""Toxicity by noisy-channel deobfuscation and a sparse linear model of the restored words.

1. A character trigram model (60 classes) is counted over all documents.
2. Tokens that look obfuscated (with signs, with letters repeated three times or more, or short fragments in a row) become
   lattices: a sign may stand for letters, a long repetition for one or two, a gap between fragments for nothing or a word
   break.  Viterbi decoding under the trigram model picks the restored text.  Tokens of any length are decoded whole, once as
   one word and once as words glued together; long paths are settled as far as all surviving ones agree, which is exact.
3. A document's features are the letter runs of its text and of what was restored: whole runs, and their first 4 to 8 bytes.
   Features that labelled training rows associate with toxicity make a lexicon; an L1 logistic regression weighs them.

Fitted on a bounded sample: at most ``SAMPLE_ROWS`` labelled training rows (the smallest hashes of their ids); the lexicon
holds all features of these rows that are associated strongly enough.  Everything else covers every row and whole texts.  Held-out rows (crc32 of the id modulo
``FOLDS`` is 0) are never trained on; labels, language, source and id are no inputs of a score.

Bounds of the deobfuscation: a chain's fragments have at most ``FRAGMENT`` characters each, so a word cut into longer ones
('stup idity') isn't put together; signs other than ``SIGNS`` (and the digits 2 and 6) stand for no letter; ``EDGES`` count
inside a token only.

Edge cases: a null or empty text has no features and gets the model's base score; without labels of both kinds every score
is the smoothed share of label 1; null or repeated labels count once an id, label 1 winning; an empty table gives an empty
result.
"""

from __future__ import annotations

import math
import re
from itertools import groupby
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.hashing import U, byte_prefix, mix, release, text_buffer, window

FOLDS, SAMPLE_ROWS = 5, 20_000
MIN_DOCS, MIN_Z = 4, 3.5
L1, STEPS = 2e-4, 400
#: Share of the log prior odds in the bias: 1 is calibrated, 0 counts a missed toxic document as dear as all clean ones lost.
PRIOR = 0.5
PREFIXES = (4, 5, 6, 7, 8)
SEGMENT_BYTES = 1 << 20
CLASSES = 60
#: The letters that a sign may stand for.
SIGNS = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c"}
#: Signs that end a word more often than they stand for a letter: they count inside a word only.
EDGES = "!|+("
#: Costs (nats) of a sign read as a letter, of a long repetition, and of a word break between single letters.
SIGN_COST, REPEAT_COST, BREAK_COST = 0.7, 0.3, 1.5
#: Letters and signs of a fragment of a chain.
FRAGMENT = 3
#: More than two of the same in a row, with or without gaps.
REPEATED = re.compile(r"(\S)(?: ?\1){2,}")
SIGNED = frozenset(SIGNS)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER = np.zeros(256, dtype=bool)
_LETTER[97:123] = True
_LETTER[128:] = True
_SIGN = np.zeros(256, dtype=bool)
_SIGN[[ord(c) for c in SIGNS]] = True
_EDGE = np.zeros(256, dtype=bool)
_EDGE[[ord(c) for c in EDGES]] = True
_GAPS = bytes(b if _LETTER[b] or _SIGN[b] else 32 for b in range(256))
_CODE = np.zeros(256, dtype=np.int64)
_CODE[97:123] = np.arange(1, 27)
_CODE[128:] = CLASSES - 1


def lowered(buf: np.ndarray) -> np.ndarray:
    """ASCII and Latin-1 capitals in lower case."""
    out = _LOWER[buf]
    if len(buf) > 1:
        second = (buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97)
        out[1:][second] += 0x20
    return out


def class_of(c: str) -> int:
    n = ord(c)
    return n - 96 if 97 <= n < 123 else 27 + (n - 0xE0) if 0xE0 <= n < 0x100 else CLASSES - 1


def trigrams(buf: np.ndarray) -> np.ndarray:
    """Counts of class trigrams, ``CLASSES ** 3`` numbers; class 0 is anything but a letter."""
    low = lowered(buf)
    code = _CODE[low]
    if len(low) > 1:
        latin = (low[:-1] == 0xC3) & (low[1:] >= 0xA0) & (low[1:] < 0xC0)
        code[1:][latin] = 27 + (low[1:][latin].astype(np.int64) - 0xA0)
        keep = np.ones(len(low), dtype=bool)
        keep[:-1][latin] = False
        keep[1:] &= ~((code[1:] == CLASSES - 1) & (code[:-1] == CLASSES - 1))
        code = code[keep]
    if len(code) < 3:
        return np.zeros(CLASSES**3, dtype=np.int64)
    return np.bincount((code[:-2] * CLASSES + code[1:-1]) * CLASSES + code[2:], minlength=CLASSES**3)


def pieces(buf: np.ndarray, offs: np.ndarray, size: int = SEGMENT_BYTES):
    """The rows' bytes, two blanks before each and behind the last, in pieces that end behind a blank and the character after it.

    The next piece begins with that blank, so each trigram is in one piece, and none has letters of two rows.
    """
    buf = np.insert(buf, np.repeat(offs, 2), 32)
    blanks = np.flatnonzero(buf == 32)
    a = 0
    while len(buf) - a > size:
        k = int(np.searchsorted(blanks, a + size))
        if k >= len(blanks) - 1:
            break
        at = int(blanks[k])
        end = at + 2
        while end < len(buf) and buf[end] & 0xC0 == 0x80:
            end += 1
        yield buf[a:end]
        a = at
    yield buf[a:]


def _count(batches):
    total = np.zeros(CLASSES**3, dtype=np.int64)
    for batch in batches:
        for piece in pieces(*text_buffer(batch["text"])):
            total += trigrams(piece)
    cells = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int32)), pa.array(total[cells])], names=["cell", "n"])


def log_model(counts: np.ndarray) -> np.ndarray:
    """Costs ``-log P(c | a, b)``, smoothed by the bigram ``P(c | b)`` and a constant."""
    c = counts.reshape(CLASSES, CLASSES, CLASSES).astype(float)
    two = c.sum(axis=0)
    one = (two + 0.1) / (two.sum(axis=1, keepdims=True) + 0.1 * CLASSES)
    three = (c + 5 * one[None]) / (c.sum(axis=2, keepdims=True) + 5)
    return -np.log(three).astype(np.float32)


class Decoder:
    """Viterbi decoding of obfuscated tokens; decoded tokens are kept for the worker's further batches."""

    KEPT, PIECE = 1_000_000, 1024

    def __init__(self, costs: np.ndarray) -> None:
        self.costs = costs.ravel().tolist()
        self.known: dict[tuple[str, bool], str] = {}
        self.held = 0
        self.options: dict[tuple[str, int, bool], list[tuple[list[tuple[str, int]], float]]] = {}

    def __call__(self, token: str, glued: bool) -> str:
        token = REPEATED.sub(r"\1\1\1", token)
        key = (token, glued)
        if key not in self.known:
            if self.held >= self.KEPT:
                self.known.clear()
                self.held = 0
            self.known[key] = self.decode(token, glued)
            self.held += len(token) + 40
        return self.known[key]

    def read(self, c: str, n: int, glued: bool) -> list[tuple[list[tuple[str, int]], float]]:
        """The letters with their classes that ``n`` times ``c`` may stand for, and the cost of each reading."""
        letters = SIGNS.get(c, c if c.isalpha() else "")
        if c == " ":
            options = [("", 0.0), (" ", BREAK_COST)]
        elif not letters:
            options = [(" ", 0.0)]
        else:
            cost = SIGN_COST if c in SIGNS else 0.0
            options = [(x * k, cost + REPEAT_COST * (n > 2)) for x in letters for k in ((1, 2) if n > 2 else (n,))]
            if glued:
                options += [(" " + x, y + BREAK_COST) for x, y in options]
        return [([(x, 0 if x == " " else class_of(x)) for x in text], extra) for text, extra in options]

    def decode(self, token: str, glued: bool) -> str:
        """The best reading of a token of any length.  Spaces are gaps; ``glued`` lets words end anywhere."""
        # state: the classes of the last two letters; value: cost, and the letters so far as a linked list
        states: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}
        done: list[str] = []
        for i, (c, same) in enumerate(groupby(token)):
            key = (c, min(3, sum(1 for _ in same)), glued)
            if key not in self.options:
                if len(self.options) >= self.PIECE:
                    self.options.clear()
                self.options[key] = self.read(*key)
            after: dict[tuple[int, int], tuple[float, tuple]] = {}
            for (a, b), (cost, path) in states.items():
                for text, extra in self.options[key]:
                    s, p, q, trail = cost + extra, a, b, path
                    for x, k in text:
                        s += self.costs[(p * CLASSES + q) * CLASSES + k]
                        p, q, trail = q, k, (trail, x)
                    if (p, q) not in after or s < after[p, q][0]:
                        after[p, q] = (s, trail)
            states = after
            if i % self.PIECE == self.PIECE - 1:  # what all paths begin with is settled
                paths = {k: (s, _spelt(trail)) for k, (s, trail) in states.items()}
                done.append(commonprefix([path for _, path in paths.values()]))
                states = {k: (s, _linked(path[len(done[-1]) :])) for k, (s, path) in paths.items()}
        best = min(states.items(), key=lambda i: i[1][0] + self.costs[(i[0][0] * CLASSES + i[0][1]) * CLASSES])
        return "".join(done) + _spelt(best[1][1])


def _spelt(trail: tuple) -> str:
    out = []
    while trail:
        trail, x = trail
        out.append(x)
    return "".join(reversed(out))


def _linked(text: str) -> tuple:
    trail: tuple = ()
    for x in text:
        trail = (trail, x)
    return trail


def _runs(on: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true, none across a row's end."""
    n = len(on)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inner = offs[1:-1]
    opens, closes = on.copy(), on.copy()
    opens[1:] &= ~on[:-1]
    closes[:-1] &= ~on[1:]
    first = inner[inner < n]
    opens[first] = on[first]
    last = inner[inner > 0] - 1
    closes[last] = on[last]
    return np.flatnonzero(opens), np.flatnonzero(closes) + 1


def _thrice(low: np.ndarray, letter: np.ndarray) -> np.ndarray:
    """Where a letter, of one or more bytes, is for the third time in a row."""
    out = np.zeros(len(low), dtype=bool)
    if len(low) > 2:
        out[2:] = (low[2:] == low[1:-1]) & (low[1:-1] == low[:-2]) & letter[2:]
    leads = np.flatnonzero(low >= 0xC0)
    for n, first in ((2, 0xC0), (3, 0xE0), (4, 0xF0)):
        at = leads[(low[leads] >= first) & (low[leads] < (0xE0, 0xF0, 0xF8)[n - 2]) & (leads + 3 * n <= len(low))]
        for k in range(2 * n):
            at = at[low[at + k] == low[at + k + n]]
        out[at + 2 * n] = True
    return out


def obfuscated(low: np.ndarray, offs: np.ndarray) -> list[tuple[int, str, bool]]:
    """``(row, token, glued)`` of what looks obfuscated in lowered bytes; a chain's fragments are parted by spaces."""
    letter, sign = _LETTER[low], _SIGN[low]
    starts, ends = _runs(letter | sign, offs)
    if not len(starts):
        return []
    sums = lambda on: np.concatenate([[0], np.cumsum(on)])
    inner, signs, repeats = sums((letter | sign) & ~_EDGE[low]), sums(sign), sums(_thrice(low, letter))
    whole = inner[ends] > inner[starts]  # not of signs alone that end words
    starts, ends = starts[whole], ends[whole]
    repeated = repeats[ends] > repeats[starts]
    row = np.searchsorted(offs, starts, "right") - 1
    out = []
    for i in np.flatnonzero((signs[ends] > signs[starts]) | repeated):
        token = low[starts[i] : ends[i]].tobytes().decode("utf-8", "ignore").strip(EDGES)
        if repeated[i] or not SIGNED.isdisjoint(token):
            out.append((int(row[i]), token, False))
            out.append((int(row[i]), token, True))
    # Short fragments in a row, whatever is between them but digits that are no signs.
    chars, digits = sums((low & 0xC0) != 0x80), sums((low == 50) | (low == 54))
    short = chars[ends] - chars[starts] <= FRAGMENT
    chain = np.zeros(len(starts), dtype=bool)
    chain[1:] = short[1:] & short[:-1] & (row[1:] == row[:-1]) & (digits[starts[1:]] == digits[ends[:-1]])
    edge = np.flatnonzero(np.diff(np.concatenate([[0], chain.astype(np.int8), [0]])))
    for a, b in zip((edge[::2] - 1).tolist(), (edge[1::2] - 1).tolist(), strict=True):
        parts = low[starts[a] : ends[b]].tobytes().translate(_GAPS).decode("utf-8", "ignore").split(" ")
        out.append((int(row[a]), " ".join([x for p in parts if (x := p.strip(EDGES))]), False))
    return out


def _hashes(low: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and 64-bit feature of every letter run: the whole run, and its first bytes."""
    starts, ends = _runs(_LETTER[low], offs)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, U)
    sums = byte_prefix(low, 0)
    size = ends - starts
    row = np.searchsorted(offs, starts, "right") - 1
    rows, out = [row], [mix(window(sums, starts, ends, 0) + U(1000003) * size.astype(U))]
    for n in PREFIXES:
        on = np.flatnonzero(size >= n)
        rows.append(row[on])
        out.append(mix(window(sums, starts[on], starts[on] + n, 0) ^ U(0x5BD1E995 * n)))
    return np.concatenate(rows), np.concatenate(out)


def _parts(offs: np.ndarray):
    """Ranges of rows of about ``SEGMENT_BYTES``."""
    row, n = 0, len(offs) - 1
    while row < n:
        to = min(n, max(row + 1, int(np.searchsorted(offs, offs[row] + SEGMENT_BYTES, "right")) - 1))
        yield row, to
        row = to


def features(column, decoder: Decoder, keep=None):
    """``(row, feature)`` arrays, distinct, for ranges of a column's rows; ``keep`` picks features by a function of hashes."""
    buf, offs = text_buffer(column)
    for a, b in _parts(offs):
        low, rows = lowered(buf[offs[a] : offs[b]]), offs[a : b + 1] - offs[a]
        r, h = _hashes(low, rows)
        odd = obfuscated(low, rows)
        if odd:
            words = [decoder(token, glued) for _, token, glued in odd]
            raw = [w.encode() for w in words]
            joined = np.frombuffer(b"".join(raw), np.uint8)
            bounds = np.concatenate([[0], np.cumsum([len(w) for w in raw])])
            r2, h2 = _hashes(joined, bounds)
            r, h = np.concatenate([r, np.array([o[0] for o in odd])[r2]]), np.concatenate([h, h2])
        if keep is not None:
            on = keep(h)
            r, h = r[on], h[on]
        order = np.lexsort((h, r))
        r, h = r[order], h[order]
        new = np.ones(len(r), dtype=bool)
        new[1:] = (r[1:] != r[:-1]) | (h[1:] != h[:-1])
        yield a, b, r[new] + a, h[new]


class Lookup:
    """Places of feature hashes in a small sorted lexicon; a bit table rejects most of the others at once."""

    BITS = 20

    def __init__(self, lexicon: np.ndarray) -> None:
        self.lexicon = lexicon
        self.table = np.zeros(1 << self.BITS, dtype=bool)
        self.table[lexicon >> U(64 - self.BITS)] = True

    def __call__(self, h: np.ndarray) -> np.ndarray:
        if not len(self.lexicon):
            return np.zeros(0, dtype=np.int64)
        maybe = np.flatnonzero(self.table[h >> U(64 - self.BITS)])
        at = np.minimum(np.searchsorted(self.lexicon, h[maybe]), len(self.lexicon) - 1)
        return maybe[self.lexicon[at] == h[maybe]]

    def places(self, h: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.lexicon, h)


def _associations(costs: np.ndarray):
    """Per partition: in how many sampled documents of each label a feature is."""

    def count(batches):
        decoder = Decoder(costs)
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged(parts):
            h, pos = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            values, place = np.unique(h, return_inverse=True)
            sums = np.zeros((len(values), 2), dtype=np.int64)
            np.add.at(sums, place, pos)
            return values, sums

        for batch in batches:
            toxic = batch["toxic"].to_numpy().astype(np.int64)
            for _, _, r, h in features(batch["text"], decoder):
                held.append((h, np.stack([1 - toxic[r], toxic[r]], axis=1)))
            if held:
                held = [merged(held)]
        if held:
            h, n = held[0]
            on = n.sum(axis=1) > 0
            yield pa.RecordBatch.from_arrays([pa.array(h[on].view(np.int64)), pa.array(n[on, 0]), pa.array(n[on, 1])], names=["feature", "clean", "toxic"])
            del h, n, on
        del decoder, held
        release()

    return count


def _examples(costs: np.ndarray, lexicon: np.ndarray):
    def rows(batches):
        decoder, look = Decoder(costs), Lookup(lexicon)
        for batch in batches:
            n = batch.num_rows
            lists: list[list[int]] = [[] for _ in range(n)]
            for _, _, r, h in features(batch["text"], decoder, look):
                for i, p in zip(r.tolist(), look.places(h).tolist(), strict=True):
                    lists[i].append(p)
            yield pa.RecordBatch.from_arrays([batch["id"], batch["toxic"], pa.array(lists, pa.list_(pa.int32()))], names=["id", "toxic", "on"])
        del decoder, look
        release()

    return rows


def fit(rows: list[list[int]], labels: np.ndarray, size: int) -> tuple[np.ndarray, float]:
    """Weights and bias of an L1 logistic regression on binary features, by accelerated proximal gradients."""
    n = len(rows)
    if not n or labels.min() == labels.max():
        return np.zeros(size), math.log((labels.sum() + 0.5) / (n - labels.sum() + 0.5))
    at = np.repeat(np.arange(n), [len(r) for r in rows])
    col = np.array([c for r in rows for c in r], dtype=np.int64)
    weight = np.where(labels == 1, n / (2 * labels.sum()), n / (2 * (n - labels.sum())))
    # The curvature is at most a quarter of the mean weighted squared norm of a row.
    norms = np.array([len(r) + 1 for r in rows], dtype=float)
    step = 4 / float((weight * norms).mean())
    w, bias, v, c, t = np.zeros(size), 0.0, np.zeros(size), 0.0, 1.0
    for _ in range(STEPS):
        z = c + np.bincount(at, v[col], n)
        g = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels) / n
        new = v - step * np.bincount(col, g[at], size)
        new = np.sign(new) * np.maximum(0.0, np.abs(new) - step * L1)
        new_bias = c - step * g.sum()
        last, t = t, (1 + math.sqrt(1 + 4 * t * t)) / 2
        v, c = new + (last - 1) / t * (new - w), new_bias + (last - 1) / t * (new_bias - bias)
        w, bias = new, new_bias
    # The fit weighs both labels alike; this puts back part of how rare label 1 is, so that no evidence means no.
    return w, float(bias) + PRIOR * math.log(labels.sum() / (n - labels.sum()))


def _scores(costs: np.ndarray, lexicon: np.ndarray, weights: np.ndarray, bias: float):
    def score(batches):
        decoder, look = Decoder(costs), Lookup(lexicon)
        for batch in batches:
            z = np.full(batch.num_rows, bias)
            for _, _, r, h in features(batch["text"], decoder, look):
                np.add.at(z, r, weights[look.places(h)])
            p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in batch.schema.names if c != "text"), pa.array(p)], names=[*(c for c in batch.schema.names if c != "text"), "score"])
        del decoder, look
        release()

    return score


def _reject(costs: np.ndarray, lexicon: np.ndarray, weights: np.ndarray, bias: float, text_col: str):
    def clean(batches):
        decoder, look = Decoder(costs), Lookup(lexicon)
        for batch in batches:
            z = np.full(batch.num_rows, bias)
            for _, _, r, h in features(batch[text_col], decoder, look):
                np.add.at(z, r, weights[look.places(h)])
            yield batch.filter(pa.array(z < 0))
        del decoder, look
        release()

    return clean


def reject_toxic(docs: DataFrame, model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score below one half, with all their columns."""
    return docs.mapInArrow(_reject(*model, text_col), docs.schema)


def held_out(id_col):
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS):
    """``costs, lexicon, weights, bias``: numbers of a size that the input doesn't change."""
    texts = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    cells = texts.select("text").mapInArrow(_count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    counts = np.zeros(CLASSES**3, dtype=np.int64)
    for batch in cells.toArrow().to_batches():  # at most CLASSES ** 3 cells
        counts[batch["cell"].to_numpy()] = batch["n"].to_numpy()
    costs = log_model(counts)
    labelled = labels.select(labels[id_col].alias("tl_of"), labels[label_col].cast("int").alias("toxic"))
    labelled = labelled.filter(F.col("tl_of").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("tl_of")))
    chosen = labelled.groupBy("tl_of").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("tl_of"), "tl_of").limit(sample_rows)
    # The sample is bounded by sample_rows pairs of numbers, so it may be sent to every task.
    sample = texts.join(F.broadcast(chosen), texts["id"] == chosen["tl_of"]).select("id", "text", "toxic")
    found = sample.mapInArrow(_associations(costs), "feature long, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    totals = chosen.agg(F.count_if(F.col("toxic") == 0), F.count_if(F.col("toxic") == 1)).first()
    odds = lambda a, n: F.log((F.col(a) + 0.5) / (n - F.col(a) + 0.5))
    z = (odds("toxic", float(totals[1] + 1)) - odds("clean", float(totals[0] + 1))) / F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    strong = found.filter(F.col("toxic") >= MIN_DOCS).withColumn("z", z).filter(F.col("z") >= MIN_Z)
    lexicon = np.sort(np.array([r["feature"] for r in strong.select("feature").collect()], dtype=np.int64).view(U))
    rows = sorted(sample.mapInArrow(_examples(costs, lexicon), f"id {texts.schema['id'].dataType.simpleString()}, toxic int, on array<int>").collect())
    weights, bias = fit([r["on"] for r in rows], np.array([r["toxic"] for r in rows], dtype=float), len(lexicon))
    on = weights != 0
    return costs, lexicon[on], weights[on], bias


def score_documents(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``id_col, held_out, score, predicted`` (and ``tl_carry``, a struct of ``carry``) of every document."""
    extra = [F.struct(*[docs[c] for c in carry]).alias("tl_carry")] if carry else []
    rows = docs.select(docs[id_col].alias("tl_id"), docs[text_col].alias("text"), *extra)
    kept = [f for f in rows.schema.fields if f.name != "text"]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["score double"])
    scored = rows.mapInArrow(_scores(*model), schema)
    return scored.select(
        F.col("tl_id").alias(id_col),
        held_out(F.col("tl_id")).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int").alias("predicted"),
        *(["tl_carry"] if carry else []),
    )
