"""Language identification by error-correcting output codes.

Every language has a codeword of bits; for each bit a binary classifier on hashed byte
n-grams says how likely the bit is set. A text goes to the language whose codeword has the
least loss, bit losses being weighted by how reliable each classifier was on held-out
training rows. Few languages get the exhaustive code, many get random codewords kept far
apart. ``score`` is the softmax share of the chosen language; a small distance to the next
one flags the text as ambiguous.

Classifiers are fitted on a bounded sample of labelled rows (``TRAIN_ROWS``, spread evenly
over the languages, whole texts), drawn by a hash of doc_id and text, so that neither a rare
language nor one under a single doc_id is lost; every whole text is predicted, without a shuffle.

Edge cases: a null text, or one without a letter, is ``und`` with score 0, and so is every
text when there is nothing to learn from; with one language all others with letters get it;
rows with a null language or doc_id are never learned from; repeated rows are predicted
alike; of languages with equal loss the first by name is taken; a very long text is counted
whole, in a block of its own; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.session import text_batches

TRAIN_ROWS = 4000
#: Most languages, most training rows of one (a rank that Spark limits within tasks), parts of an octave.
MAX_LANGUAGES, MAX_EACH, STEPS = 256, 1000, 8
DIMENSIONS = 1 << 13
ORDERS = (2, 3, 4)
AMBIGUOUS = 0.15
BLOCK = 4_000_000
_EXHAUSTIVE, _RANDOM_BITS = 6, 24

# lower-case ASCII letters and bytes of other characters stay, anything else is a space
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
_FOLD_ARRAY = np.frombuffer(_FOLD, np.uint8)


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """n rows of bits: exhaustive up to six languages, else the best-spread of random draws."""
    if n <= 1:
        return np.zeros((n, 1), np.int8)
    if n <= _EXHAUSTIVE:
        columns = [c for c in product((0, 1), repeat=n) if c[0] == 1 and not all(c)]
        return np.array(columns, np.int8).T
    rnd = np.random.default_rng(seed)
    width = max(_RANDOM_BITS, int(10 * np.log2(n)))
    best, apart = None, -1
    for _ in range(200):
        code = rnd.integers(0, 2, (n, width)).astype(np.int8)
        gaps = (code[:, None] != code[None]).sum(2) + np.eye(n, dtype=int) * width
        varied = (code.any(0) & ~code.all(0)).all()
        if varied and gaps.min() > apart:
            best, apart = code, int(gaps.min())
    return best


def features(texts: pa.Array, dimensions: int = DIMENSIONS) -> tuple[np.ndarray, np.ndarray]:
    """Square roots of n-gram frequencies, a row a text, and which texts have a letter."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    letters = np.asarray(pc.match_substring_regex(texts, r"\p{L}"))
    texts = pc.utf8_lower(texts)
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    data = _FOLD_ARRAY[data].astype(np.uint32)
    starts = offsets - offsets[0]
    out = np.zeros((n, dimensions), np.float32)
    hashed = []
    for order in ORDERS:
        if len(data) < order:
            continue
        h = np.full(len(data) - order + 1, order * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
        for j in range(order):
            h = (h ^ data[j : len(data) - order + 1 + j]) * np.uint32(0x01000193)
        h ^= h >> np.uint32(15)
        hashed.append((order, (h * np.uint32(0x85EBCA6B)) >> np.uint32(32 - dimensions.bit_length() + 1)))
    for i in range(n):
        a, b = int(starts[i]), int(starts[i + 1])
        parts = [h[a : b - order + 1] for order, h in hashed if b - order + 1 > a]
        if parts:
            out[i] = np.bincount(np.concatenate(parts), minlength=dimensions)
    np.sqrt(out, out=out)
    out /= np.maximum(np.sqrt((out * out).sum(1, keepdims=True)), 1e-9)
    return out, letters


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    reliability: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, y: list[str], steps: int = 200, rate: float = 4.0, decay: float = 1e-5) -> Model:
        """Logistic regression for all bits at once; every fifth row only rates the classifiers."""
        languages = sorted(set(y))
        code = codewords(len(languages))
        target = code[[languages.index(v) for v in y]].astype(np.float32) if y else np.zeros((0, 1), np.float32)
        w = np.zeros((x.shape[1], code.shape[1] if len(languages) else 1), np.float32)
        b = np.zeros(w.shape[1], np.float32)
        check = np.arange(len(y)) % 5 == 4 if len(y) >= 50 else np.zeros(len(y), bool)
        if len(languages) > 1:
            part, t = x[~check], target[~check]
            speed, last = np.zeros_like(w), np.zeros_like(b)
            for _ in range(steps):
                gap = 1 / (1 + np.exp(-(part @ w + b))) - t
                speed = 0.9 * speed + part.T @ gap / len(part) + decay * w
                last = 0.9 * last + gap.mean(0)
                w -= rate * speed
                b -= rate * last
        rating = check if check.any() else np.ones(len(y), bool)
        if len(languages) > 1:
            right = ((x[rating] @ w + b > 0) == (target[rating] > 0.5)).mean(0)
            reliability = np.clip(right * 2 - 1, 0.01, 1)
        else:
            reliability = np.ones(w.shape[1])
        return cls(languages, code, w, b, (reliability / reliability.sum()).astype(np.float32))

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and ambiguity of each text."""
        x, letters = features(texts)
        if not self.languages:
            return ["und"] * len(x), np.zeros(len(x)), np.zeros(len(x), bool)
        margin = (x @ self.weights + self.bias)[:, None, :] * np.where(self.code > 0, 1, -1)[None]
        loss = (np.logaddexp(0, -margin) * self.reliability).sum(2)
        order = np.sort(loss, 1)
        share = np.exp(-4 * (loss - order[:, :1]))
        score = np.where(letters, 1 / share.sum(1), 0.0)
        close = letters & (order[:, 1] - order[:, 0] < AMBIGUOUS) if len(self.languages) > 1 else np.zeros(len(x), bool)
        best = loss.argmin(1)
        return [self.languages[k] if ok else "und" for k, ok in zip(best.tolist(), letters.tolist())], score, close


def _blocks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    sizes = np.cumsum(np.asarray(pc.binary_length(batch.column("text")).fill_null(0))) // BLOCK
    cuts = sorted({0, batch.num_rows, *(np.flatnonzero(np.diff(sizes)) + 1).tolist(), *range(0, batch.num_rows, 1000)})
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)


def held_out(doc_id) -> F.Column:
    """Rows that are never learned from: crc32(doc_id as text) mod 4 is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def _octave(u: Column) -> Column:
    """Which of ``STEPS`` parts an octave a number in (0, 1] lies in, counted downwards from 1."""
    return F.floor(-F.log2(u) * STEPS).cast("int")


def _draw(usable: DataFrame, each: int, counts: dict[str, dict[int, int]], place: Column) -> DataFrame:
    """The ``each`` rows with the least ``place`` of every language, or all where it has no more.

    A language's histogram of places tells below which octave it has enough rows; the rank takes
    the rest off, within tasks first.
    """
    least = {}
    for lang, by in counts.items():
        total = 0
        for octave in sorted(by, reverse=True):
            total += by[octave]
            if total >= each or octave == min(by):
                least[lang] = octave
                break
    bound = F.create_map(*(F.lit(v) for pair in least.items() for v in pair))
    near = usable.withColumn("_u", place).filter(_octave(F.col("_u")) >= bound[F.col("lang")])
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("_u", "doc_id"))
    return near.withColumn("_n", rank).filter(F.col("_n") <= each).select("lang", "text")


def fit(labelled: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """Fit on a sample of (doc_id, text, lang) rows, evenly over languages, by hash order of the rows.

    At most ``MAX_LANGUAGES`` languages, which is an error beyond, and ``MAX_EACH`` rows of one.
    """
    usable = labelled.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.rlike("text", F.lit(r"\p{L}"))).select("doc_id", "text", "lang")
    place = (F.pmod(F.xxhash64("doc_id", "text", F.lit(3)), F.lit(1 << 53)) + 1) / float(1 << 53)
    names = [r.lang for r in usable.select("lang").distinct().limit(MAX_LANGUAGES + 1).collect()]
    if len(names) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not names:
        return Model.fit(np.zeros((0, DIMENSIONS), np.float32), [])
    counts: dict[str, dict[int, int]] = {}
    for r in usable.groupBy("lang", _octave(place).alias("octave")).count().collect():  # at most 53 * STEPS + 1 rows a language
        counts.setdefault(r.lang, {})[r.octave] = r["count"]
    each = max(1, min(MAX_EACH, train_rows // len(counts)))

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _blocks(batch):
                x, _ = features(part.column("text"))
                rows = [v.astype(np.float16).tobytes() for v in x]
                yield pa.RecordBatch.from_arrays([part.column("lang"), pa.array(rows, pa.binary())], ["lang", "x"])

    got = _draw(usable, each, counts, place).mapInArrow(sparse, "lang string, x binary").toArrow()  # at most train_rows rows
    langs = got.column("lang").to_pylist()
    x = np.array([np.frombuffer(v, np.float16) for v in got.column("x").to_pylist()], np.float32).reshape(-1, DIMENSIONS)
    order = sorted(range(len(langs)), key=lambda i: (zlib.crc32(x[i].tobytes()), langs[i]))  # mixed, whatever the partitions
    return Model.fit(x[order], [langs[i] for i in order])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous of every document."""

    text_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _blocks(batch):
                lang, score, close = model.predict(part.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("held_out"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(close)],
                    ["doc_id", "held_out", "lang_pred", "score", "ambiguous"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out("doc_id").alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean")
