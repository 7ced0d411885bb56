"""SimHash near-duplicates by generalised pigeonhole search.

A fingerprint has 64 bits, from the XXH64 values of a text's two-word shingles; texts link
when their fingerprints differ in at most ``DISTANCE`` bits. Equal fingerprints are one
class, counted once. The bits are grouped into a few partitions of correlated bits, and
thresholds t_i with sum(t_i + 1) = DISTANCE + 1 are shared out by dynamic programming on
estimated costs: two fingerprints within DISTANCE must be within t_i on some partition i.
Partition i is searched by flipping up to floor(t_i / 2) of its bits on one side and
ceil(t_i / 2) on the other, meeting on equal keys, and verifying the full distance. The
search is exact; the estimates, from a documented sample, only choose the cheapest plan.

Edge cases: a null or wordless text has fingerprint zero and links like any other; a text of
one word is one shingle, and a very long text is hashed in parts; repeated rows are members of
one class; a null doc_id takes part and loses against any other for the class name; an empty
table gives no rows; other columns, whatever their names, are ignored, or kept by the functions
that return documents. Of equal candidates these keep the one first in its file.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.marks import only_marked, write_marks
from graphloom.llm.memory import claim
from graphloom.operators.fixpoint import connected_components
from graphloom.session import addressed, free_names, materialize, parts_for, placed, shuffle_width, text_batches

DISTANCE = 6
#: Fingerprints from which the plan's costs are estimated; entries of a bucket; pairs verified at a time.
SAMPLE, BUCKET, BLOCK = 2048, 1_500_000, 1 << 21
#: A class is hot when it has more than this share of all rows: at most 1 / HOT classes are.
HOT = 0.001

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
_PLACE = (np.arange(8) * 256)[None, :]


def fingerprint(text: str | None) -> int:
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return 0
    shingles = [a + b" " + b for a, b in zip(words, words[1:])] if len(words) > 1 else words
    counts = np.zeros(64, np.int64)
    digest = xxhash.xxh64_digest
    for i in range(0, len(shingles), 100_000):
        raw = np.frombuffer(b"".join([digest(s, 42) for s in shingles[i : i + 100_000]]), np.uint8).reshape(-1, 8)
        counts += (np.bincount((raw + _PLACE).ravel(), minlength=2048).reshape(8, 256)[:, :, None] * _BITS[None]).sum(1).ravel()
    return int.from_bytes(np.packbits(2 * counts > len(shingles)).tobytes(), "big")


def _fingerprints(texts: pa.Array) -> pa.Array:
    claim("simhash")
    return pa.array(np.array([fingerprint(t) for t in texts.to_pylist()], np.uint64).view(np.int64))


@F.arrow_udf(T.LongType())
def fingerprint_udf(text: pa.Array) -> pa.Array:
    return _fingerprints(text)


@dataclass
class Plan:
    """Flips of every (partition, side): ``mask`` of the partition, ``salt`` and ``flip`` patterns."""

    masks: list[int]
    thresholds: list[int]

    def __post_init__(self):
        self.entries: list[list[tuple[int, int, int]]] = [[], []]
        for i, (mask, t) in enumerate(zip(self.masks, self.thresholds)):
            if t < 0:
                continue
            bits = [1 << b for b in range(64) if mask >> b & 1]
            for side, radius in ((0, t // 2), (1, t - t // 2)):
                for r in range(radius + 1):
                    self.entries[side] += [(mask, sum(c), i) for c in combinations(bits, r)]

    @property
    def rows(self) -> int:
        return len(self.entries[0]) + len(self.entries[1])

    def keys(self, fps: np.ndarray, side: int, k: int) -> np.ndarray:
        mask, flip, part = self.entries[side][k]
        return _mix(((fps ^ np.uint64(flip)) & np.uint64(mask)) ^ np.uint64(part * 0x9E3779B97F4A7C15 % (1 << 64)))


def _mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64 bits."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _groups(sample: np.ndarray, m: int) -> list[int]:
    """Masks of m partitions; each takes the bits that correlate most with those it has."""
    bits = np.unpackbits(sample.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)[:, ::-1].astype(np.float64)
    dev = bits - bits.mean(0) if len(bits) else np.zeros((1, 64))
    norm = np.sqrt((dev**2).sum(0))
    corr = np.abs(dev.T @ dev) / np.maximum(np.outer(norm, norm), 1e-9)
    np.fill_diagonal(corr, 0)
    free, masks = set(range(64)), []
    for i in range(m):
        size = (64 - (64 // m) * m > i) + 64 // m
        left = sorted(free)
        own = [max(left, key=lambda b: (corr[b, left].sum(), -b))]
        while len(own) < size:
            left = sorted(free - set(own))
            own.append(max(left, key=lambda b: (corr[b, own].sum(), -b)))
        free -= set(own)
        masks.append(sum(1 << b for b in own))
    return masks


def _ball(width: int, radius: int) -> int:
    return sum(math.comb(width, r) for r in range(radius + 1))


def make_plan(sample: np.ndarray, n: int, distance: int = DISTANCE) -> Plan:
    """The cheapest partitions and thresholds for n distinct fingerprints.

    The cost of a row sent is taken as 20 times that of a candidate pair verified.
    """
    a, b = np.triu_indices(len(sample), 1)
    pick = slice(None, None, max(1, len(a) // 1_000_000))
    diff = sample[a[pick]] ^ sample[b[pick]]
    best: tuple[float, Plan] | None = None
    for m in range(1, distance + 2):
        masks = _groups(sample, m)
        table: list[dict[int, float]] = []
        for mask in masks:
            width = mask.bit_count()
            near = np.bincount(np.bitwise_count(diff & np.uint64(mask)), minlength=65).cumsum()
            costs = {-1: 0.0}
            for t in range(distance + 1):
                even = _ball(width, t) / 2.0**width
                share = (near[t] + min(1.0, even)) / (len(diff) + 1)
                share = max(share, min(1.0, even))
                met = _ball(min(t, 6), t // 2)  # ways in which one pair can meet
                costs[t] = 20.0 * n * (_ball(width, t // 2) + _ball(width, t - t // 2)) + n * n / 2 * share * met
            table.append(costs)
        state: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for costs in table:
            new: dict[int, tuple[float, list[int]]] = {}
            for used, (cost, ts) in state.items():
                for t, c in costs.items():
                    to = used + t + 1
                    if to <= distance + 1 and (to not in new or cost + c < new[to][0]):
                        new[to] = (cost + c, [*ts, t])
            state = new
        cost, ts = state[distance + 1]
        if best is None or cost < best[0]:
            best = (cost, Plan(masks, ts))
    return best[1]


def _verify(x: np.ndarray, lo: np.ndarray, n: np.ndarray, index: np.ndarray, distance: int) -> np.ndarray:
    """Pairs (x < y) within the distance; probe i meets index[lo[i] : lo[i] + n[i]]."""
    out = [np.zeros((0, 2), np.uint64)]
    ends = np.cumsum(n)
    i = 0
    while i < len(x):
        j = int(np.searchsorted(ends, (ends[i - 1] if i else 0) + BLOCK, "right"))
        j = max(j, i + 1)
        some = n[i:j]
        first = np.cumsum(some) - some
        y = index[np.repeat(lo[i:j] - first, some) + np.arange(int(some.sum()))]
        z = np.repeat(x[i:j], some)
        ok = (z < y) & (np.bitwise_count(z ^ y) <= distance)
        out.append(np.stack([z[ok], y[ok]], 1))
        i = j
    return np.concatenate(out)


def _within(xs: np.ndarray, ys: np.ndarray, distance: int) -> np.ndarray:
    """All pairs of two large groups under one key: equal on one of distance + 1 blocks."""
    out = []
    edges = np.linspace(0, 64, distance + 2).astype(int)
    for a, b in zip(edges, edges[1:]):
        mask = np.uint64(((1 << int(b - a)) - 1) << int(a))
        index = ys[np.argsort(ys & mask)]
        keys = index & mask
        lo = np.searchsorted(keys, xs & mask, "left")
        out.append(np.unique(_verify(xs, lo, np.searchsorted(keys, xs & mask, "right") - lo, index, distance), axis=0))
    return np.concatenate(out)


def match(index: tuple[np.ndarray, np.ndarray], probe: tuple[np.ndarray, np.ndarray], distance: int) -> np.ndarray:
    """Distinct verified pairs among entries (key, fingerprint) with equal keys; index is sorted."""
    keys, fps = index
    order = np.argsort(probe[0])
    pk, pf = probe[0][order], probe[1][order]
    lo = np.searchsorted(keys, pk, "left")
    n = np.searchsorted(keys, pk, "right") - lo
    hit = n > 0
    pk, pf, lo, n = pk[hit], pf[hit], lo[hit], n[hit]
    found = []
    if len(pk):
        heads = np.flatnonzero(np.append(True, pk[1:] != pk[:-1]))
        size = np.diff(np.append(heads, len(pk)))
        big = (size * n[heads] > BLOCK) & (n[heads] > 512)
        calm = ~np.repeat(big, size)
        found.append(_verify(pf[calm], lo[calm], n[calm], fps, distance))
        for h, s in zip(heads[big].tolist(), size[big].tolist()):
            found.append(_within(pf[h : h + s], fps[lo[h] : lo[h] + n[h]], distance))
    pairs = np.concatenate([np.zeros((0, 2), np.uint64), *found])
    return np.unique(pairs, axis=0) if len(pairs) else pairs


_ENTRY = pa.schema([("bucket", pa.int32()), ("side", pa.int8()), ("what", pa.binary()), ("fps", pa.binary())])


def links(classes: DataFrame, n: int, distance: int = DISTANCE, bucket: int = BUCKET) -> DataFrame:
    """Distinct pairs (a, b) of different fingerprints, as signed longs, within the distance.

    Entries travel as packed arrays: 8 bytes a fingerprint and 2 bytes for which key it has.
    Buckets are parts of the key space; one that holds more than its share is cut further by
    its index entries, each part meeting all probes of the bucket.
    """
    spark = classes.sparkSession
    sample = classes.select("fp").orderBy(F.xxhash64("fp", F.lit(5))).limit(SAMPLE).toArrow().column("fp")
    plan = make_plan(np.asarray(sample).astype(np.int64).view(np.uint64), n, distance)
    n_buckets = max(shuffle_width(spark), parts_for(n * plan.rows, bucket))
    step = max(64, 2_000_000 // plan.rows)

    def loads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_buckets, np.int64)
        for batch in batches:
            fps = np.asarray(batch.column("fp")).view(np.uint64)
            for k in range(len(plan.entries[0])):
                total += np.bincount((plan.keys(fps, 0, k) % np.uint64(n_buckets)).astype(np.int64), minlength=n_buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    counted = classes.select("fp").mapInArrow(loads, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    hot: dict[int, list[int]] = {}
    more = n_buckets
    for row in counted.filter(F.col("n") > 2 * bucket).collect():  # at most one bucket for each 2 * bucket entries
        parts = parts_for(row.n, bucket)
        hot[row.bucket] = [row.bucket, *range(more, more + parts - 1)]
        more += parts - 1

    def cut(b: int, side: int, what: np.ndarray, fps: np.ndarray) -> Iterator[tuple]:
        if b not in hot:
            yield b, side, what.tobytes(), fps.tobytes()
            return
        to = hot[b]
        which = _mix(fps) % np.uint64(len(to))
        for i, x in enumerate(to):
            own = which == np.uint64(i) if side == 0 else slice(None)
            if side or own.any():
                yield x, side, what[own].tobytes(), fps[own].tobytes()

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_fps = np.asarray(batch.column("fp")).view(np.uint64)
            for i in range(0, len(all_fps), step):
                fps = all_fps[i : i + step]
                for side in (0, 1):
                    n_keys = len(plan.entries[side])
                    where = np.concatenate([plan.keys(fps, side, k) for k in range(n_keys)]) % np.uint64(n_buckets)
                    what = np.repeat(np.arange(n_keys, dtype="<u2"), len(fps))
                    order = np.argsort(where, kind="stable")
                    where, what, who = where[order], what[order], np.tile(fps, n_keys)[order]
                    cuts = np.flatnonzero(np.append(True, where[1:] != where[:-1]))
                    rows = [r for a, b in zip(cuts, [*cuts[1:], len(where)]) for r in cut(int(where[a]), side, what[a:b], who[a:b])]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _ENTRY.types)], schema=_ENTRY)

    def entries(row_what: bytes, row_fps: bytes, side: int) -> tuple[np.ndarray, np.ndarray]:
        what, fps = np.frombuffer(row_what, "<u2"), np.frombuffer(row_fps, "<u8")
        keys = np.empty(len(fps), np.uint64)
        cuts = np.flatnonzero(np.append(True, what[1:] != what[:-1])) if len(what) else []
        for a, b in zip(cuts, [*cuts[1:], len(what)]):
            keys[a:b] = plan.keys(fps[a:b], side, int(what[a]))
        return keys, fps

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by bucket and side: the index of a bucket is held, its probes stream."""
        now, held, waiting, index = None, [], [], None

        def flush():
            nonlocal waiting, index
            if not waiting:
                return None
            if index is None:
                k, f = (np.concatenate(x) for x in zip(*held)) if held else (np.zeros(0, np.uint64),) * 2
                order = np.argsort(k)
                index = k[order], f[order]
            probe = tuple(np.concatenate(x) for x in zip(*waiting))
            waiting = []
            pairs = match(index, probe, distance).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["a", "b"])

        for batch in batches:
            for bucket_, side, what, fps in zip(*(c.to_pylist() for c in batch.columns)):
                if bucket_ != now:
                    if (done := flush()) is not None:
                        yield done
                    now, held, index = bucket_, [], None
                if side == 0:
                    held.append(entries(what, fps, 0))
                else:
                    waiting.append(entries(what, fps, 1))
                    if sum(len(k) for k, _ in waiting) > bucket and (done := flush()) is not None:
                        yield done
        if (done := flush()) is not None:
            yield done

    sent = classes.select("fp").repartition(shuffle_width(spark)).mapInArrow(spread, "bucket int, side byte, what binary, fps binary")
    near = sent.repartition(n_buckets, "bucket").sortWithinPartitions("bucket", "side").mapInArrow(meet, "a long, b long")
    return near.distinct()


def near_duplicates(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(fp, count, n_near, component_id, group) of each distinct fingerprint of ``fps`` (doc_id, fp).

    ``component_id`` is the least doc_id, which components may share; ``group`` is a component's own.
    """
    classes = materialize(fps.groupBy("fp").agg(F.count("*").alias("count"), F.min("doc_id").alias("least")), "classes")
    pairs = materialize(links(classes, classes.count(), distance), "links")
    sizes = classes.select(F.col("fp").alias("b"), "count")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both.join(sizes, "b").groupBy(F.col("a").alias("fp")).agg(F.sum("count").alias("linked"))
    groups = connected_components(pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"))).select(F.col("node").alias("fp"), "component")
    groups = materialize(groups, "groups")
    least = groups.join(classes, "fp").groupBy("component").agg(F.min("least").alias("component_id"))
    named = groups.join(least, "component").select("fp", "component", "component_id")
    out = classes.join(near, "fp", "left").join(named, "fp", "left")
    return out.select(
        "fp",
        "count",
        (F.col("count") - 1 + F.coalesce("linked", F.lit(0))).alias("n_near"),
        F.coalesce("component_id", "least").alias("component_id"),
        F.coalesce("component", "fp").alias("group"),
    )


def _by_class(rows: DataFrame, classes: DataFrame, total: int, on: str = "fp") -> DataFrame:
    """Join rows to their class; the few hot classes are broadcast, so no key is hot in the shuffle."""
    hot = classes.filter(F.col("count") > HOT * total)  # at most 1 / HOT rows
    cold = classes.filter(F.col("count") <= HOT * total)
    keys = F.broadcast(hot.select(on))
    first = rows.join(F.broadcast(hot), on)
    return first.unionByName(rows.join(keys, on, "left_anti").join(cold, on))


def fingerprints(docs: DataFrame) -> DataFrame:
    text_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), fingerprint_udf("text").alias("fp"))


def cluster(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """One row per document: doc_id, fingerprint, n_near, component_id."""
    fps = materialize(fingerprints(docs), "fingerprints")
    classes = materialize(near_duplicates(fps, distance), "near")
    out = _by_class(fps, classes, fps.count())
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "n_near", "component_id")


def _addressed_fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, content, file, row) of a placed table, written once; no text leaves its scan."""
    text_batches(docs.sparkSession)
    file, row = free_names(docs.columns, "_file", "_row")
    wide = addressed(docs, file, row)
    cols = [F.col("doc_id").cast("long").alias("doc_id"), fingerprint_udf("text").alias("fp"), F.xxhash64("text").alias("content"), F.col(file).alias("file"), F.col(row).alias("row")]
    return materialize(wide.select(*cols), "fingerprints")


def _first_rows(docs: DataFrame, distance: int, key: list[str]) -> DataFrame:
    """One row of ``docs`` for each ``key`` of its classes: the least doc_id (null last), then the
    least fingerprint, text hash, file and place."""
    docs = placed(docs)
    fps = _addressed_fingerprints(docs)
    classes = materialize(near_duplicates(fps, distance), "near")
    mine = _by_class(fps, classes, fps.count())
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp", "content", "file", "row")
    chosen = mine.groupBy(*key).agg(F.min(order).alias("x")).select("x.file", "x.row")
    return only_marked(docs, write_marks(chosen, "chosen"))


def first_of_groups(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """One document for each least doc_id of a group, with all its columns, as ``_first_rows`` picks it."""
    return _first_rows(docs, distance, ["component_id"])


def one_of_each_group(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """One document of each group, with all its columns, also where groups share their least
    doc_id or have none: the row with the least doc_id (null last), then the least fingerprint,
    text hash, file and place. Texts are fingerprinted once and never shuffled."""
    return _first_rows(docs, distance, ["group"])
