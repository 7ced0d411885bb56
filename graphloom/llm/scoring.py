"""Cross-entropy difference between a target and a background language model.

Both models are bigram models over one vocabulary, the ids of a public tokenizer, with the
same Dirichlet smoothing towards their unigrams. The background is counted over all
documents, the target over those with a good and harmless label; background counts are scaled
to the target's mass, so that both models are smoothed alike. A document's score is the mean
over its tokens of target loss minus background loss: low means target-like.

Bigrams are counted exactly. A bigram is one 64-bit key, scrambled one-to-one; tasks merge
their counts and send them by the key's leading bits to shards, whose sums are sorted files in
the shared folder. A model of at most ``HELD`` distinct bigrams is read whole by the scoring
tasks; with a larger one the bigrams of the documents travel to the shards, each of which adds
its part of every document's loss. Both ways give equal results.

``score_corpus`` scores the documents that the model was counted on, each by the counts of
all others: its own bigrams, contexts and words are taken out of both models first. The ids are
made once, written beside the model, and neither texts nor ids are shuffled; which rows are the
target's is a bitmap a file. ``score`` takes any documents and all counts.

Edge cases: a null or empty text has no tokens and score 0; a very long text is one block;
repeated rows count and score each, so a copy still counts for its twin; several labels of a
document must all be good; without target documents the target model is uniform; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.files import load_array, save_array
from graphloom.llm.marks import Marks, write_marks
from graphloom.llm.tokens import encoder
from graphloom.operators.skew import join_unique
from graphloom.session import addressed, free_names, materialize, placed, shared_path, shuffle_width, text_batches

#: Bytes of text for which there is one shard; distinct bigrams that a task holds for scoring, and while it counts.
BYTES_PER_SHARD, HELD, PENDING = 64 << 20, 8_000_000, 1_000_000
LEAST_BITS = 4
PRIOR, UNIFORM = 50.0, 0.5


def _contexts(ids: np.ndarray, starts: np.ndarray, begin: int) -> np.ndarray:
    """Context of every token; ``begin`` stands before a document."""
    context = np.empty_like(ids)
    context[1:] = ids[:-1]
    context[starts[starts < len(ids)]] = begin
    return context


def _packed(context: np.ndarray, ids: np.ndarray) -> np.ndarray:
    return context.astype(np.uint64) << np.uint64(32) | ids.astype(np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64 bits, so that leading bits share keys out evenly."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class _Sums:
    """Sums of counts by key, merged whenever more than ``PENDING`` entries wait."""

    def __init__(self):
        self.keys: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.waiting = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """``counts`` has two columns, target and background."""
        self.keys.append(keys)
        self.counts.append(counts)
        self.waiting += len(keys)
        if self.waiting > PENDING:
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct keys and their counts."""
        keys = np.concatenate([np.zeros(0, np.uint64), *self.keys])
        counts = np.concatenate([np.zeros((0, 2), np.int64), *self.counts])
        order = np.argsort(keys)
        keys = keys[order]
        heads = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
        keys, counts = keys[heads], np.add.reduceat(counts[order], heads, axis=0) if len(heads) else counts
        self.keys, self.counts, self.waiting = [keys], [counts], 0
        return keys, counts

    def __len__(self) -> int:
        return sum(map(len, self.keys))


class _Table:
    """Look-up of sorted scrambled keys: the leading bits say where to begin."""

    def __init__(self, entries: np.ndarray, scale: np.ndarray):
        self.keys = np.append(entries["key"], np.uint64(2**64 - 1))
        self.counts = np.zeros((2, len(self.keys)), np.float32)
        for side in (0, 1):
            self.counts[side, :-1] = entries["counts"][:, side] * scale[side]
        self.bits = max(1, len(entries).bit_length())
        self.begin = np.searchsorted(entries["key"], np.arange(1 << self.bits, dtype=np.uint64) << np.uint64(64 - self.bits)).astype(np.int32)

    def places(self, keys: np.ndarray) -> np.ndarray:
        """Where each key stands, or the last place, which counts nothing."""
        at = self.begin[(keys >> np.uint64(64 - self.bits)).astype(np.int64)]
        todo = np.flatnonzero(self.keys[at] < keys)
        while len(todo):
            at[todo] += 1
            todo = todo[self.keys[at[todo]] < keys[todo]]
        # a real key may equal the end mark, which then stands before it
        at[self.keys[at] != keys] = len(self.keys) - 1
        return at


_ENTRY = np.dtype([("key", "<u8"), ("counts", "<f4", (2,))])


def _blocks(got: list[bytes], width: int, tokens: int = 500_000) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Blocks of documents: first row, all ids, and where each document starts (and the end)."""
    ends = np.cumsum(np.fromiter(map(len, got), np.int64, len(got)) // width)
    cuts = sorted({0, len(got), *(np.flatnonzero(np.diff(ends // tokens)) + 1).tolist()})
    for a, b in zip(cuts, cuts[1:]):
        bounds = np.append(0, ends[a:b] - (ends[a - 1] if a else 0))
        yield a, np.frombuffer(b"".join(got[a:b]), f"<u{width}").astype(np.int32), bounds


def _ids(texts: pa.Array, tokenizer: str | None, size: int = 4000) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    enc = encoder(tokenizer)
    for i in range(0, len(texts), size):
        for first, ids, bounds in _blocks(enc.encode(texts.slice(i, size)), 4):
            yield i + first, ids, bounds


def _own_counts(keys: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """How often each key occurs in its own document; documents follow each other."""
    first = np.argsort(keys, kind="stable")
    order = first[np.argsort(doc[first], kind="stable")]
    k, d = keys[order], doc[order]
    heads = np.flatnonzero(np.append(True, (k[1:] != k[:-1]) | (d[1:] != d[:-1]))) if len(k) else np.zeros(0, np.int64)
    out = np.empty(len(keys), np.int64)
    size = np.diff(np.append(heads, len(k)))
    out[order] = np.repeat(size, size)
    return out


@dataclass
class Model:
    """Counts as files: entries (key, counts) of each shard, and [4, vocabulary + 1] contexts and words."""

    pair_files: list[str | None]
    single_file: str
    bits: int
    entries: int
    vocabulary: int

    def singles(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Scales of the counts, contexts [2, v + 1] and words [2, v] with their smoothing, and masses of words, size-matched."""
        single = load_array(self.single_file).astype(np.float64)
        context, words = single[:2], single[2:, : self.vocabulary]
        mass = words.sum(1)
        scale = np.array([1.0, mass[0] / mass[1] if mass[0] and mass[1] else 1.0])
        words = words * scale[:, None]
        return scale, context * scale[:, None] + PRIOR, words + UNIFORM, words.sum(1) + UNIFORM * self.vocabulary

    def table(self, files: list[str | None], scale: np.ndarray) -> _Table:
        return _Table(np.concatenate([np.zeros(0, _ENTRY), *(load_array(f) for f in files if f)]), scale)


_COUNTED = pa.schema([("shard", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
_SUMMED = pa.schema([("shard", pa.int32()), ("path", pa.string()), ("n", pa.int64())])


def _flush(sums: _Sums, bits: int) -> Iterator[pa.RecordBatch]:
    """Counts as packed rows, one for each shard."""
    keys, counts = sums.merge()
    keys = _mix(keys)
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    cuts = np.append(np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)), len(keys))
    for shard, (a, b) in enumerate(zip(cuts.tolist(), cuts[1:].tolist())):
        if b > a:
            row = {"shard": shard, "keys": keys[a:b].astype("<u8").tobytes(), "counts": counts[a:b].astype("<i8").tobytes()}
            yield pa.RecordBatch.from_pylist([row], _COUNTED)


_TOKENS = "doc_id long, file long, row long, ids binary"


def _tokenise(docs: DataFrame, tokenizer: str | None, width: int) -> DataFrame:
    """The ids of every document, written once; (file, row) names a row of ``docs``."""
    file, row = free_names(docs.columns, "_file", "_row")
    rows = addressed(docs, file, row).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(file).alias("file"), F.col(row).alias("row"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in batches:
            for i in range(0, batch.num_rows, 4000):
                part = batch.slice(i, 4000)
                got = enc.encode(part.column("text"))
                if width == 2:
                    got = [np.frombuffer(x, "<u4").astype("<u2").tobytes() for x in got]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(got, pa.binary())], ["doc_id", "file", "row", "ids"])

    return materialize(rows.mapInArrow(run, _TOKENS), "lm-tokens")


def _good(labels: DataFrame) -> DataFrame:
    good = labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    fine = F.coalesce(F.col("quality"), F.lit(0)) > 0
    harmless = F.coalesce(F.col("toxic"), F.lit(0)) == 0
    return good.agg(F.min((fine & harmless).cast("int")).alias("ok")).filter("ok = 1").select("doc_id")


def fit(docs: DataFrame, labels: DataFrame, tokenizer: str | None = None) -> Model:
    return _count(docs, labels, tokenizer)[0]


def _count(docs: DataFrame, labels: DataFrame, tokenizer: str | None) -> tuple[Model, DataFrame, Marks]:
    """Model, ids and target rows; only doc_ids and places meet the labels, hot ones by ``join_unique``."""
    spark = docs.sparkSession
    text_batches(spark)
    docs = placed(docs)
    size = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(LEAST_BITS, int(size // BYTES_PER_SHARD).bit_length())
    vocabulary = encoder(tokenizer).tokenizer.get_vocab_size()
    width = 2 if vocabulary <= 1 << 16 else 4
    tokens = _tokenise(docs, tokenizer, width)
    marks = write_marks(join_unique(tokens.select("doc_id", "file", "row"), _good(labels), ["doc_id"]), "lm-target")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, single = _Sums(), np.zeros((4, vocabulary + 1), np.int64)
        for batch in batches:
            target = marks.of(batch.column("file"), batch.column("row"))
            for first, ids, bounds in _blocks(batch.column("ids").to_pylist(), width):
                context = _contexts(ids, bounds[:-1], vocabulary)
                mine = np.repeat(target[first : first + len(bounds) - 1], np.diff(bounds))
                # the last bit tells the target's, so that one sort counts both
                keys, times = np.unique(_packed(context, ids) << np.uint64(1) | mine, return_counts=True)
                own = (keys & np.uint64(1)).astype(bool)
                sums.add(keys >> np.uint64(1), np.stack([times * own, times], 1))
                for side, (c, w) in ((0, (context[mine], ids[mine])), (1, (context, ids))):
                    single[side] += np.bincount(c, minlength=vocabulary + 1)
                    single[2 + side] += np.bincount(w, minlength=vocabulary + 1)
                if not sums.waiting and len(sums) > PENDING:
                    yield from _flush(sums, bits)
                    sums = _Sums()
        yield from _flush(sums, bits)
        yield pa.RecordBatch.from_pylist([{"shard": -1, "keys": None, "counts": single.astype("<i8").tobytes()}], _COUNTED)

    root = shared_path(spark, "lm")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by shard; one shard is summed and written at a time."""
        now, total = None, None

        def save():
            uri, n = f"{root}/{now:05d}.npy", 0
            if now < 0:
                save_array(uri, total)
            else:
                keys, counts = total.merge()
                n = len(keys)
                out = np.zeros(n, _ENTRY)
                out["key"], out["counts"] = keys, counts
                save_array(uri, out)
            return pa.RecordBatch.from_pylist([{"shard": now, "path": uri, "n": n}], _SUMMED)

        for batch in batches:
            for shard, keys, counts in zip(*(c.to_pylist() for c in batch.columns)):
                if shard != now:
                    if now is not None:
                        yield save()
                    now, total = shard, _Sums() if shard >= 0 else np.zeros((4, vocabulary + 1), np.int64)
                if now < 0:
                    total += np.frombuffer(counts, "<i8").reshape(total.shape)
                else:
                    total.add(np.frombuffer(keys, "<u8"), np.frombuffer(counts, "<i8").reshape(-1, 2))
        if now is not None:
            yield save()

    counted = tokens.select("file", "row", "ids").mapInArrow(count, "shard int, keys binary, counts binary")
    summed = counted.repartition(min((1 << bits) + 1, shuffle_width(spark)), "shard").sortWithinPartitions("shard").mapInArrow(add, "shard int, path string, n long")
    files = {r.shard: (r.path, r.n) for r in materialize(summed, "lm-files").collect()}  # one row a shard
    if -1 not in files:
        files[-1] = (f"{root}/none.npy", 0)
        save_array(files[-1][0], np.zeros((4, vocabulary + 1), np.int64))
    pairs = [files.get(shard, (None, 0))[0] for shard in range(1 << bits)]
    return Model(pairs, files[-1][0], bits, sum(n for _, n in files.values()), vocabulary), tokens, marks


_loaded: dict[tuple[str, int], tuple] = {}


def _load(model: Model, shard: int | None = None) -> tuple:
    """The singles, and the table of one shard or of the whole model; the last one is kept."""
    if (model.single_file, shard) not in _loaded:
        _loaded.clear()
        singles = model.singles()
        files = model.pair_files if shard is None else [model.pair_files[shard]]
        _loaded[model.single_file, shard] = (model.table(files, singles[0]), *singles)
    return _loaded[model.single_file, shard]


_SCORES = ["doc_id", "n_tokens", "target_loss", "background_loss", "score"]
_SCHEMA = "doc_id long, n_tokens long, target_loss double, background_loss double, score double"


def _own(context: np.ndarray, ids: np.ndarray, keys: np.ndarray, doc: np.ndarray, leave_out: bool) -> list[np.ndarray]:
    """What each token's own document adds to the counts of its bigram, context and word."""
    return [_own_counts(x, doc) if leave_out else np.zeros(len(ids), np.int64) for x in (keys, context, ids)]


def _parts(singles: tuple, target: np.ndarray) -> tuple[np.ndarray, float]:
    """How much of a document's own counts each model holds: the target's has them only if it is one."""
    return target.astype(np.float64), float(singles[0][1])


def _context_loss(side: int, singles: tuple, context: np.ndarray, own: np.ndarray, part: np.ndarray | float) -> np.ndarray:
    return np.log(np.maximum(singles[1][side][context] - own * part, PRIOR))


def _pair_loss(side: int, singles: tuple, counts: np.ndarray, ids: np.ndarray, pair: np.ndarray, word: np.ndarray, total: np.ndarray, part: np.ndarray | float) -> np.ndarray:
    """Minus the log of the smoothed count of each bigram; ``total`` words of its document are left out."""
    share = np.maximum(singles[2][side][ids] - word * part, UNIFORM) / np.maximum(singles[3][side] - total * part, UNIFORM)
    return -np.log(np.maximum(counts - pair * part, 0.0) + PRIOR * share)


Blocks = Callable[[pa.RecordBatch], Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]]


def score(docs: DataFrame, model: Model, tokenizer: str | None = None, held: int = HELD) -> DataFrame:
    """doc_id, n_tokens, mean target and background loss in nats, and their difference, of any documents."""

    def blocks(batch: pa.RecordBatch) -> Iterator[tuple]:
        for first, ids, bounds in _ids(batch.column("text"), tokenizer):
            yield first, ids, bounds, np.zeros(len(bounds) - 1, bool)

    text_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return (_score_whole if model.entries <= held else _score_by_shards)(rows, model, blocks, False)


def score_corpus(docs: DataFrame, labels: DataFrame, tokenizer: str | None = None, held: int = HELD) -> DataFrame:
    """The same for the documents that the model is counted on, each left out of its own counts."""
    model, tokens, marks = _count(docs, labels, tokenizer)
    width = 2 if model.vocabulary <= 1 << 16 else 4

    def blocks(batch: pa.RecordBatch) -> Iterator[tuple]:
        target = marks.of(batch.column("file"), batch.column("row"))
        for first, ids, bounds in _blocks(batch.column("ids").to_pylist(), width):
            yield first, ids, bounds, target[first : first + len(bounds) - 1]

    return (_score_whole if model.entries <= held else _score_by_shards)(tokens, model, blocks, True)


def _score_whole(rows: DataFrame, model: Model, blocks: Blocks, leave_out: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, *singles = _load(model)
        for batch in batches:
            for first, ids, bounds, target in blocks(batch):
                n = np.diff(bounds)
                doc = np.repeat(np.arange(len(n)), n)
                context = _contexts(ids, bounds[:-1], model.vocabulary)
                keys = _packed(context, ids)
                pair, of_context, word = _own(context, ids, keys, doc, leave_out)
                at = table.places(_mix(keys))
                out = []
                for side, part in enumerate(_parts(singles, target[doc])):
                    loss = _context_loss(side, singles, context, of_context, part) + _pair_loss(side, singles, table.counts[side][at], ids, pair, word, n[doc] if leave_out else 0, part)
                    out.append(np.bincount(doc, loss, len(n)) / np.maximum(n, 1))
                docs = batch.column("doc_id").slice(first, len(n))
                cols = [docs, pa.array(n), pa.array(out[0]), pa.array(out[1]), pa.array(out[0] - out[1])]
                yield pa.RecordBatch.from_arrays(cols, _SCORES)

    return rows.mapInArrow(run, _SCHEMA)


_ARRAYS = {"at": "<u4", "words": "<u4", "keys": "<u8", "own": "<u4", "own_word": "<u4"}
_SENT = pa.schema([("shard", pa.int32()), ("uid", pa.int64()), ("docs", pa.list_(pa.int64())), ("sizes", pa.binary()), ("target", pa.binary()), *((c, pa.binary()) for c in _ARRAYS)])
_PART = ["uid", "doc_id", "n_tokens", "target", "background"]


def _score_by_shards(rows: DataFrame, model: Model, blocks: Blocks, leave_out: bool) -> DataFrame:
    """The way for models too large for a task: blocks of bigrams go to the shards, sums come back.

    A row is named by its partition and place, within this one job.
    """
    shards = 1 << model.bits

    def sent_row(shard: int, uid: int, sizes: np.ndarray, target: np.ndarray, docs: list | None = None, **arrays: np.ndarray) -> pa.RecordBatch:
        row = {"shard": shard, "uid": uid, "docs": docs, "sizes": sizes.astype("<u4").tobytes(), "target": target.astype("u1").tobytes()}
        row |= {c: arrays[c].astype(t).tobytes() if c in arrays else None for c, t in _ARRAYS.items()}
        return pa.RecordBatch.from_pylist([row], _SENT)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        uid, turn = TaskContext.get().partitionId() << 40, 0
        for batch in batches:
            for first, ids, bounds, target in blocks(batch):
                n = np.diff(bounds)
                doc = np.repeat(np.arange(len(n)), n)
                context = _contexts(ids, bounds[:-1], model.vocabulary)
                keys = _packed(context, ids)
                pair, of_context, word = _own(context, ids, keys, doc, leave_out)
                # contexts need no shard: they travel, by document, with one shard after another
                yield sent_row(turn % shards, uid, n, target, batch.column("doc_id").slice(first, len(n)).to_pylist(), at=doc, words=context, own=of_context)
                keys = _mix(keys)
                order = np.argsort(keys)
                keys = keys[order]
                cuts = np.append(np.searchsorted(keys, np.arange(shards, dtype=np.uint64) << np.uint64(64 - model.bits)), len(keys)).tolist()
                for shard, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    if b > a:
                        o = order[a:b]
                        yield sent_row(shard, uid, n, target, at=doc[o], words=ids[o], keys=keys[a:b], own=pair[o], own_word=word[o])
                uid, turn = uid + len(n), turn + 1

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                table, *singles = _load(model, row["shard"])
                at, words, own = (np.frombuffer(row[c], _ARRAYS[c]).astype(np.int64) for c in ("at", "words", "own"))
                sizes, docs = np.frombuffer(row["sizes"], "<u4").astype(np.int64), row["docs"]
                parts = _parts(singles, np.frombuffer(row["target"], "u1")[at])
                if docs is not None:
                    where, n = np.arange(len(docs)), sizes
                    sums = [np.bincount(at, _context_loss(side, singles, words, own, parts[side]), len(docs)) for side in (0, 1)]
                else:
                    where, to = np.unique(at, return_inverse=True)
                    n, docs, place = np.zeros(len(where), np.int64), [None] * len(where), table.places(np.frombuffer(row["keys"], "<u8"))
                    total, word = sizes[at] if leave_out else 0, np.frombuffer(row["own_word"], "<u4").astype(np.int64)
                    sums = [np.bincount(to, _pair_loss(side, singles, table.counts[side][place], words, own, word, total, parts[side]), len(where)) for side in (0, 1)]
                yield pa.RecordBatch.from_arrays([pa.array(row["uid"] + where), pa.array(docs, pa.int64()), pa.array(n), *map(pa.array, sums)], _PART)

    sent = rows.mapInArrow(spread, "shard int, uid long, docs array<long>, sizes binary, target binary, " + ", ".join(f"{c} binary" for c in _ARRAYS))
    met = sent.repartition(min(shards, shuffle_width(rows.sparkSession)), "shard").sortWithinPartitions("shard")
    part = met.mapInArrow(meet, "uid long, doc_id long, n_tokens long, target double, background double")
    whole = part.groupBy("uid").agg(F.max("doc_id").alias("doc_id"), F.sum("n_tokens").alias("n_tokens"), F.sum("target").alias("t"), F.sum("background").alias("b"))
    n = F.greatest("n_tokens", F.lit(1))
    return whole.select("doc_id", "n_tokens", (F.col("t") / n).alias("target_loss"), (F.col("b") / n).alias("background_loss"), ((F.col("t") - F.col("b")) / n).alias("score"))
