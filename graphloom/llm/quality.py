"""Quality rules: an isolation forest on rule statistics, with a threshold from labelled rows.

Every whole text gives counts (words, symbols, repeated lines, repeated three-word windows)
and from them a few ratios. The forest isolates rows by random splits of those ratios; a
short mean path means an odd document. Each split also credits its ratio with how far it
narrowed a row down; the ratio with most credit is the reason for the oddness, and every
reason has a threshold of its own, set where rejecting pays at ``CLEAN_COST`` missed bad
rows for a lost clean one. The trees' subsamples are the forest's documented
bound (``TREES`` of ``SUBSAMPLE`` rows, drawn by a hash of doc_id); thresholds are set on all
labelled rows. Length is no ratio, so that long documents are not odd by themselves.

Edge cases: a null or empty text has no words and fails the base rules; a very long one is
counted whole, in a block of its own; repeated rows are judged alike, each by its own text; of
cuts that pay equally the mildest is taken; without any label every threshold is ``NO_LABELS``, and
a reason without bad labelled rows rejects nothing; an empty table gives no rows; other columns are ignored or, in ``keep``,
passed through.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.marks import only_marked, write_marks
from graphloom.llm.memory import claim, release
from graphloom.session import addressed, free_names, materialize, placed, text_batches

TREES, SUBSAMPLE = 100, 256
#: Least words, and largest share of words in repeated windows, of the base rules.
MIN_WORDS, MAX_REPEATED = 50, 50
#: Missed bad rows that one rejected good row outweighs; the threshold without labels.
CLEAN_COST, NO_LABELS = 9, 0.65
BLOCK = 4_000_000
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
EXTRA = ["n_lines", "n_letters", "n_upper", "n_signs"]
RATIOS = ["symbol", "upper", "dup_lines", "repeated", "sign", "word_length"]

_SYMBOL, _UPPER, _LETTER, _SIGN = (np.zeros(256, np.uint8) for _ in range(4))
_SYMBOL[list(b"#*$%&|<>")] = 1
_UPPER[65:91] = 1
_LETTER[65:91] = _LETTER[97:123] = 1
_SIGN[list(b"!\"'()+-/:;=?@[\\]^_`{}~")] = 1


def _sums(flags: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sum of ``flags`` between consecutive ``starts``."""
    return np.diff(np.append(0, np.cumsum(flags, dtype=np.int64))[starts])


def _repeated(ids: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """Words of each document that lie in a three-word window found at least twice in it."""
    if len(ids) < 3:
        return np.zeros(n_docs, np.int64)
    d = int(ids.max()) + 1
    ids = ids.astype(np.int64)
    inside = doc[:-2] == doc[2:]
    two = ids[:-2] * d + ids[1:-1]
    if d**3 >= 1 << 62:
        two = np.unique(two, return_inverse=True)[1].astype(np.int64)
    at = np.flatnonzero(inside)
    key, of = (two * d + ids[2:])[at], doc[:-2][at]
    first = np.argsort(key)
    order = first[np.argsort(of[first].astype(np.int16), kind="stable")]
    key, of = key[order], of[order]
    same = (key[1:] == key[:-1]) & (of[1:] == of[:-1])
    twice = np.zeros(len(key), bool)
    twice[1:] |= same
    twice[:-1] |= same
    hit = np.zeros(len(ids), bool)
    begin = at[order[twice]]
    hit[begin] = hit[begin + 1] = hit[begin + 2] = True
    return np.bincount(doc[hit], minlength=n_docs)


def _block(texts: pa.LargeStringArray) -> np.ndarray:
    """COUNTS and EXTRA of up to 30,000 texts, one row a text."""
    n = len(texts)
    out = np.zeros((n, len(COUNTS) + len(EXTRA)), np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    starts = offsets - offsets[0]

    lists = pc.ascii_split_whitespace(texts)
    words = lists.flatten()
    bounds = np.asarray(lists.offsets).astype(np.int64)
    bounds -= bounds[0]
    doc = np.repeat(np.arange(n), np.diff(bounds))
    coded = words.dictionary_encode()
    chars = np.asarray(pc.utf8_length(coded.dictionary)).astype(np.int64)
    ids = np.asarray(coded.indices)
    real = chars[ids] > 0
    ids, doc = ids[real], doc[real]
    out[:, 0] = np.bincount(doc, minlength=n)
    out[:, 1] = np.bincount(doc, weights=chars[ids], minlength=n) if len(ids) else 0
    out[:, 2] = _sums(_SYMBOL[data], starts)
    out[:, 4] = _repeated(ids, doc, n)

    lists = pc.split_pattern(texts, "\n")
    bounds = np.asarray(lists.offsets).astype(np.int64)
    bounds -= bounds[0]
    line_doc = np.repeat(np.arange(n), np.diff(bounds))
    coded = lists.flatten().dictionary_encode()
    filled = np.asarray(pc.binary_length(pc.ascii_trim_whitespace(coded.dictionary))) > 0
    line = np.asarray(coded.indices).astype(np.int64)
    real = filled[line] if len(line) else np.zeros(0, bool)
    line, line_doc = line[real], line_doc[real]
    lines = np.bincount(line_doc, minlength=n)
    seen = np.unique(line_doc * max(1, len(filled)) + line) // max(1, len(filled))
    out[:, 3] = lines - np.bincount(seen, minlength=n)
    out[:, 5] = lines
    for k, table in enumerate((_LETTER, _UPPER, _SIGN)):
        out[:, 6 + k] = _sums(table[data], starts)
    return out


def count_texts(texts: pa.Array) -> np.ndarray:
    claim("quality")
    texts = texts.cast(pa.large_string()).fill_null("")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not len(texts):
        return np.zeros((0, len(COUNTS) + len(EXTRA)), np.int64)
    sizes = np.cumsum(np.asarray(pc.binary_length(texts))) // BLOCK
    cuts = set((np.flatnonzero(np.diff(sizes)) + 1).tolist()) | set(range(0, len(texts), 30_000)) | {len(texts)}
    cuts = sorted(cuts)
    counts = np.concatenate([_block(texts.slice(a, b - a)) for a, b in zip(cuts, cuts[1:])])
    release()
    return counts


def ratios(counts: np.ndarray) -> np.ndarray:
    c = counts.astype(np.float64)
    words, lines, letters = (np.maximum(c[:, k], 1) for k in (0, 5, 6))
    cols = [np.log1p(c[:, 2] / words), c[:, 7] / letters, c[:, 3] / lines, c[:, 4] / words, np.log1p(c[:, 8] / words), np.log1p(c[:, 1] / words)]
    return np.stack(cols, 1)


def base_failed(counts: np.ndarray) -> np.ndarray:
    return (counts[:, 0] < MIN_WORDS) | (100 * counts[:, 4] > MAX_REPEATED * counts[:, 0])


def _usual_path(n: float) -> float:
    if n <= 1:
        return 0.0
    return 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else 1.0


@dataclass
class Forest:
    """Trees as arrays. A leaf is its own child, and its ``cut`` is the path length there."""

    feature: np.ndarray
    cut: np.ndarray
    child: np.ndarray
    credit: np.ndarray
    roots: np.ndarray
    depth: int
    usual: float

    @classmethod
    def fit(cls, rows: np.ndarray, trees: int = TREES, subsample: int = SUBSAMPLE, seed: int = 11) -> Forest:
        rnd = np.random.default_rng(seed)
        feature: list[int] = []
        cut: list[float] = []
        child: list[tuple[int, int]] = []
        credit: list[tuple[float, float]] = []
        size = max(1, min(subsample, len(rows)))
        limit = max(1, math.ceil(math.log2(size)))

        def grow(part: np.ndarray, depth: int) -> int:
            me = len(feature)
            feature.append(-1)
            cut.append(depth + _usual_path(len(part)))
            child.append((me, me))
            credit.append((0.0, 0.0))
            can = np.flatnonzero(np.ptp(part, axis=0) > 0) if len(part) > 1 and depth < limit else []
            if not len(can):
                return me
            f = int(rnd.choice(can))
            at = rnd.uniform(part[:, f].min(), part[:, f].max())
            left = part[:, f] < at
            n = int(left.sum())
            child[me] = (grow(part[left], depth + 1), grow(part[~left], depth + 1))
            feature[me], cut[me] = f, at
            credit[me] = tuple(math.log2(len(part) / max(1, k)) for k in (n, len(part) - n))
            return me

        roots = [grow(rows[rnd.choice(len(rows), size, replace=False)] if len(rows) else rows, 0) for _ in range(trees)]
        return cls(np.array(feature), np.array(cut), np.array(child), np.array(credit), np.array(roots), limit, _usual_path(size) or 1.0)

    def score(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """2 to the minus (mean path / usual path), near 1 for odd rows; and the reason."""
        odd, reason = np.zeros(len(rows)), np.zeros(len(rows), np.int64)
        for i in range(0, len(rows), 20_000):
            part = rows[i : i + 20_000]
            total = np.zeros(len(part))
            why = np.zeros((len(part), rows.shape[1]))
            line = np.arange(len(part))
            for root in self.roots:
                node = np.full(len(part), root)
                for _ in range(self.depth):
                    f = np.maximum(self.feature[node], 0)
                    side = (part[line, f] >= self.cut[node]).astype(np.int64)
                    why[line, f] += self.credit[node, side]
                    node = self.child[node, side]
                total += self.cut[node]
            odd[i : i + 20_000] = np.exp2(-total / len(self.roots) / self.usual)
            reason[i : i + 20_000] = why.argmax(1)
        return odd, reason


@dataclass
class Model:
    forest: Forest
    thresholds: np.ndarray

    def verdict(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Base failure, oddness, its reason and the final decision of each row of counts."""
        failed = base_failed(counts)
        odd, reason = self.forest.score(ratios(counts))
        return failed, odd, reason, ~failed & (odd < self.thresholds[reason])


def _arrow(names: list[str], arrays: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a) if isinstance(a, np.ndarray) else a for a in arrays], names)


def _with_counts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The long columns ``keys`` and the counts of every text."""
    text_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = count_texts(batch.column("text"))
            yield _arrow([*keys, *COUNTS, *EXTRA], [*(batch.column(k) for k in keys), *counts.T.copy()])

    return rows.mapInArrow(run, ", ".join(f"{c} long" for c in [*keys, *COUNTS, *EXTRA]))


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the counts of every text, in one pass without a shuffle."""
    return _with_counts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ["doc_id"])


def _counts_of(batch: pa.RecordBatch) -> np.ndarray:
    return np.stack([np.asarray(batch.column(c)) for c in COUNTS + EXTRA], 1) if batch.num_rows else np.zeros((0, 9), np.int64)


def judge(stats: DataFrame, model: Model) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            failed, odd, reason, kept = model.verdict(_counts_of(batch))
            names = ["doc_id", *COUNTS, "base_failed", "kept", "oddness", "reason"]
            yield _arrow(names, [*(batch.column(c) for c in ["doc_id", *COUNTS]), failed, kept, odd, reason])

    schema = ", ".join(["doc_id long", *(f"{c} long" for c in COUNTS), "base_failed boolean", "kept boolean", "oddness double", "reason long"])
    return stats.mapInArrow(run, schema)


def thresholds(hist: list[tuple[int, int, int, int]], clean_cost: float = CLEAN_COST, bins: int = 1000) -> np.ndarray:
    """For each reason the cut on oddness at which rejected bad rows most outweigh good ones.

    ``hist``: (reason, bin of oddness, quality, rows), over all labelled rows that pass the
    base rules. A cut that pays nowhere is infinite.
    """
    if not hist:
        return np.full(len(RATIOS), NO_LABELS)
    gain = np.zeros((len(RATIOS), bins + 2))
    for reason, b, quality, n in hist:
        gain[reason, min(b, bins)] += -clean_cost * n if quality else n
    above = gain[:, ::-1].cumsum(1)[:, ::-1]
    best = above.shape[1] - 1 - above[:, ::-1].argmax(1)  # the mildest of equal cuts
    return np.where(above.max(1) > 0, best / bins, np.inf)


def fit(stats: DataFrame, labels: DataFrame, clean_cost: float = CLEAN_COST) -> Model:
    """Forest on a documented sample of rows that pass the base rules; thresholds on all labels."""
    passing = stats.filter((F.col("n_words") >= MIN_WORDS) & (100 * F.col("n_repeat_words") <= MAX_REPEATED * F.col("n_words")))
    sample = passing.orderBy(F.xxhash64("doc_id"), *COUNTS).limit(TREES * SUBSAMPLE).toArrow()
    counts = np.stack([np.asarray(sample.column(c)) for c in COUNTS + EXTRA], 1).astype(np.int64)
    model = Model(Forest.fit(ratios(counts)), np.full(len(RATIOS), NO_LABELS))
    marks = labels.filter(F.col("quality").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality") > 0).cast("int").alias("quality"))
    # both sides are counted by doc_id first, so that neither a repeated document nor a repeated label is a hot key
    marks = marks.groupBy("doc_id").agg(*(F.count_if(F.col("quality") == q).alias(f"q{q}") for q in (0, 1)))
    scored = judge(passing, model).groupBy("doc_id", "reason", F.floor(F.col("oddness") * 1000).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    hist = scored.join(marks, "doc_id").groupBy("reason", "bin").agg(*(F.sum(F.col("n") * F.col(f"q{q}")).alias(f"n{q}") for q in (0, 1)))
    rows = [(r.reason, r.bin, q, n) for r in hist.collect() for q, n in ((0, r.n0), (1, r.n1)) if n]  # at most 6 * 1001 rows
    model.thresholds = thresholds(rows, clean_cost)
    return model


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that pass, with all their columns; texts are counted once and never shuffled."""
    docs = placed(docs)
    file, row = free_names(docs.columns, "_file", "_row")
    wide = addressed(docs, file, row)
    stats = materialize(_with_counts(wide.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(file).alias("file"), F.col(row).alias("row"), "text"), ["doc_id", "file", "row"]), "quality")
    model = fit(stats, labels)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = pa.array(model.verdict(_counts_of(batch))[3])
            yield batch.select(["file", "row"]).filter(kept)

    return only_marked(docs, write_marks(stats.mapInArrow(choose, "file long, row long"), "kept"))
