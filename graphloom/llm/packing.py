"""Packing token pieces into sequences with a grouping genetic algorithm.

Pieces are spread over groups of bounded size; each group is one packing problem and is
evolved on several islands, which are separate tasks with populations of their own. A
chromosome is a list of bins. Crossover injects whole well-filled bins of one parent into
the other, removes the bins that then hold a piece twice, and puts the displaced pieces
back by best fit. After each round the best solution of every island migrates to the next
island of its group. The badly filled bins of all groups are dissolved and packed again
in fewer groups, level by level, so that what one group wastes another one fills.

Edge cases: no pieces give no rows; a piece of full length has a sequence of its own; a
piece longer than the capacity or of length 0 is an error (``cut`` never makes one);
repeated rows are separate pieces; other columns of the pieces are kept.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.tokens import encoder
from graphloom.session import materialize, parts_for, text_batches

CAPACITY, END_ID = 1024, 2
#: Bytes of text whose ids one worker holds at a time.
TEXT_BYTES = 8 << 20
#: Pieces of a group, islands of a group, rounds with a migration between them, offspring of a round.
GROUP, ISLANDS, ROUNDS, OFFSPRING = 16_384, 2, 2, 6
_POPULATION, _WELL_FILLED, _POOR = 4, 0.995, 0.97


def best_fit(sizes: list[int], items: list[int], bins: list[list[int]], room: list[int], capacity: int) -> None:
    """Put ``items`` one by one into the bin with the least room that takes them."""
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for b, r in enumerate(room):
        if r:
            by_room[r].append(b)
            mask |= 1 << r
    for i in items:
        s = sizes[i]
        fits = mask >> s
        if fits:
            r = s + (fits & -fits).bit_length() - 1
            stack = by_room[r]
            b = stack.pop()
            if not stack:
                mask ^= 1 << r
            r -= s
            bins[b].append(i)
            room[b] = r
        else:
            b, r = len(bins), capacity - s
            bins.append([i])
            room.append(r)
        if r:
            by_room[r].append(b)
            mask |= 1 << r


def exact_fill(sizes: list[int], items: list[int], capacity: int, near_half: bool) -> list[list[int]]:
    """Bins from the largest item down, closed exactly by one or two more items where sizes allow.

    ``free`` has a bit for every size at hand and ``turned`` one for its distance to the
    capacity, so both ends of every exact pair show in one shift.
    """
    by_size: list[list[int]] = [[] for _ in range(capacity + 1)]
    free = turned = 0
    for i in items:
        by_size[sizes[i]].append(i)
    for s in range(1, capacity + 1):
        if by_size[s]:
            free |= 1 << s
            turned |= 1 << capacity - s
    bins = []

    def take(s: int) -> int:
        nonlocal free, turned
        stack = by_size[s]
        i = stack.pop()
        if not stack:
            free ^= 1 << s
            turned ^= 1 << capacity - s
        return i

    while free:
        s = free.bit_length() - 1
        now, room = [take(s)], capacity - s
        while room:
            if by_size[room]:
                now.append(take(room))
                break
            pairs = free & (turned >> capacity - room)
            half = room >> 1
            if not room & 1 and pairs >> half & 1 and len(by_size[half]) < 2:
                pairs ^= 1 << half
            if pairs:
                high = pairs >> half + (room & 1)
                x = half + (room & 1) + ((high & -high).bit_length() if near_half else high.bit_length()) - 1
                now += [take(x), take(room - x)]
                break
            fits = free & ((1 << room) - 1)
            if not fits:
                break
            x = fits.bit_length() - 1
            now.append(take(x))
            room -= x
        bins.append(now)
    return bins


class Packer:
    """The packing problem of one group: solutions are (bins, room)."""

    def __init__(self, sizes: np.ndarray, capacity: int, seed: int):
        self.sizes: list[int] = sizes.tolist()
        self.capacity = capacity
        self.least = -(-int(sizes.sum()) // capacity)
        self.random = random.Random(seed)
        self.order = np.argsort(-sizes, kind="stable").tolist()

    def fitness(self, s: tuple) -> tuple:
        """Fewer bins first, then uneven filling, which leaves room in one piece."""
        return (-len(s[0]), sum(r * r for r in s[1]))

    def decreasing(self, noise: float = 0.0) -> tuple:
        order = self.order
        if noise:
            rnd = self.random.random
            order = sorted(range(len(self.sizes)), key=lambda i: -self.sizes[i] * (1 - noise * rnd()))
        bins: list[list[int]] = []
        room: list[int] = []
        best_fit(self.sizes, order, bins, room, self.capacity)
        return bins, room

    def exact(self, near_half: bool) -> tuple:
        bins = exact_fill(self.sizes, self.order, self.capacity, near_half)
        return bins, [self.capacity - sum(map(self.sizes.__getitem__, b)) for b in bins]

    def _refill(self, bins: list[list[int]], room: list[int], loose: list[int]) -> tuple:
        loose.sort(key=self.sizes.__getitem__, reverse=True)
        best_fit(self.sizes, loose, bins, room, self.capacity)
        return bins, room

    def cross(self, mother: tuple, father: tuple) -> tuple:
        limit = self.capacity * (1 - _WELL_FILLED)
        rnd = self.random.random
        given = [b for b, r in zip(*father) if r <= limit and rnd() < 0.5]
        taken = set().union(*given) if given else set()
        bins, room, loose = [list(b) for b in given], [], []
        room = [self.capacity - sum(map(self.sizes.__getitem__, b)) for b in bins]
        for b, r in zip(*mother):
            if taken.isdisjoint(b):
                bins.append(list(b))
                room.append(r)
            else:
                loose += [i for i in b if i not in taken]
        return self._refill(bins, room, loose)

    def mutate(self, s: tuple) -> tuple:
        """Empty the bins with most room and a few others, and refill."""
        rnd = self.random.random
        worst = set(sorted(range(len(s[0])), key=s[1].__getitem__)[-max(8, len(s[0]) // 20) :])
        bins, room, loose = [], [], []
        for b, (items, r) in enumerate(zip(*s)):
            if b in worst or rnd() < 0.01:
                loose += items
            else:
                bins.append(list(items))
                room.append(r)
        if rnd() < 0.5:
            loose.sort(key=self.sizes.__getitem__, reverse=True)
            own = exact_fill(self.sizes, loose, self.capacity, rnd() < 0.5)
            return bins + own, room + [self.capacity - sum(map(self.sizes.__getitem__, b)) for b in own]
        return self._refill(bins, room, loose)

    def evolve(self, guests: list[tuple], offspring: int) -> tuple:
        people = [*guests, self.decreasing()]
        if len(people[-1][0]) > self.least:
            people += [self.exact(True), self.exact(False), *(self.decreasing(0.3) for _ in range(_POPULATION - 3))]
        people.sort(key=self.fitness, reverse=True)
        for _ in range(offspring):
            if len(people[0][0]) <= self.least:
                break
            child = self.cross(people[0], self.random.choice(people[1:]) if len(people) > 1 else people[0])
            people.append(self.mutate(child))
            people.sort(key=self.fitness, reverse=True)
            del people[_POPULATION + 1 :]
        return people[0]


def _bins_to_array(bins: list[list[int]], n: int) -> np.ndarray:
    out = np.zeros(n, "<i4")
    for b, items in enumerate(bins):
        out[items] = b
    return out


def _array_to_bins(of: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple:
    order = np.argsort(of, kind="stable")
    cuts = np.flatnonzero(np.diff(of[order])) + 1
    bins = [x.tolist() for x in np.split(order, cuts)] if len(of) else []
    room = [capacity - int(sizes[b].sum()) for b in bins]
    return bins, room


def _rounds(groups: DataFrame, capacity: int, islands: int, rounds: int, offspring: int, level: int) -> DataFrame:
    """Evolve every (group, island); returns the best solution of each group."""
    schema = "group long, island int, uids binary, sizes binary, bins binary, n_bins long"
    spark = groups.sparkSession

    def evolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                sizes = np.frombuffer(row["sizes"], "<i4")
                seed = (level * 1000 + row["round"]) * 1_000_003 + row["group"] * 101 + row["island"]
                packer = Packer(sizes, capacity, seed)
                guests = [_array_to_bins(np.frombuffer(g, "<i4"), sizes, capacity) for g in row["guests"] or []]
                bins, _ = packer.evolve(guests, offspring)
                out = {k: row[k] for k in ("group", "island", "uids", "sizes")}
                yield pa.RecordBatch.from_pylist([out | {"bins": _bins_to_array(bins, len(sizes)).tobytes(), "n_bins": len(bins)}], _arrow(schema))

    state = groups.crossJoin(spark.range(islands).select(F.col("id").cast("int").alias("island")))
    state = state.withColumn("guests", F.lit(None).cast("array<binary>"))
    width = max(2, min(512, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    for r in range(rounds):
        spread = state.withColumn("round", F.lit(r)).repartition(width, "group", "island")
        done = materialize(spread.mapInArrow(evolve, schema), f"pack-{level}-{r}")
        sent = done.select("group", ((F.col("island") + 1) % islands).alias("island"), F.col("bins").alias("guest"))
        own = done.select("group", "island", "uids", "sizes", "bins")
        state = own.join(sent, ["group", "island"]).withColumn("guests", F.array("bins", "guest")).drop("bins", "guest")
    return done.groupBy("group").agg(F.min_by(F.struct("uids", "sizes", "bins"), F.struct("n_bins", "island")).alias("best")).select("group", "best.*")


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_()}
    return pa.schema([(n, kinds[t]) for n, t in (c.split() for c in ddl.split(", "))])


def pack(
    pieces: DataFrame,
    capacity: int = CAPACITY,
    group: int = GROUP,
    islands: int = ISLANDS,
    rounds: int = ROUNDS,
    offspring: int = OFFSPRING,
    levels: int = 4,
) -> DataFrame:
    """``pieces`` (with a ``length`` column) plus ``sequence_id`` and ``offset``.

    Only (row number, length) is shuffled into groups; a group is bounded by ``group`` rows
    whatever the keys are, since rows are numbered and the numbers hashed.
    """
    table = materialize(pieces.withColumn("_uid", F.monotonically_increasing_id()), "pieces")
    open_ = table.filter(F.col("length") < capacity).select("_uid", F.col("length").cast("int").alias("length"))
    n = open_.count()
    placed: list[DataFrame] = []
    schema = "_uid long, sequence_id long, offset long, length int, again boolean"
    for level in range(levels):
        n_groups = parts_for(n, group)
        last = n_groups == 1 or level == levels - 1

        def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Columns of a group as arrays; a partition holds whole groups, sorted."""
            key, uids, sizes = None, [], []

            def row():
                flat = np.concatenate(uids).astype("<i8").tobytes(), np.concatenate(sizes).astype("<i4").tobytes()
                return pa.RecordBatch.from_pylist([{"group": key, "uids": flat[0], "sizes": flat[1]}], _arrow("group long, uids binary, sizes binary"))

            for batch in batches:
                g = np.asarray(batch.column("group"))
                for part in np.split(np.arange(len(g)), np.flatnonzero(np.diff(g)) + 1) if len(g) else []:
                    if key is not None and key != int(g[part[0]]):
                        yield row()
                        uids, sizes = [], []
                    key = int(g[part[0]])
                    uids.append(np.asarray(batch.column("_uid"))[part])
                    sizes.append(np.asarray(batch.column("length"))[part])
            if key is not None:
                yield row()

        def place(batches: Iterator[pa.RecordBatch], level=level, last=last) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in batch.to_pylist():
                    sizes, of = np.frombuffer(r["sizes"], "<i4"), np.frombuffer(r["bins"], "<i4")
                    order = np.argsort(of, kind="stable")
                    grouped = of[order]
                    ends = np.cumsum(sizes[order].astype(np.int64))
                    heads = np.flatnonzero(np.append(True, np.diff(grouped) != 0))
                    offset = ends - sizes[order]
                    offset -= np.repeat(offset[heads], np.diff(np.append(heads, len(order))))
                    fill = np.bincount(of, weights=sizes)
                    again = (fill < capacity * _POOR)[grouped] & (not last)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.frombuffer(r["uids"], "<i8")[order]),
                            pa.array(grouped.astype(np.int64) + (r["group"] << 24) + (level << 56)),
                            pa.array(offset),
                            pa.array(sizes[order]),
                            pa.array(again),
                        ],
                        schema=_arrow(schema),
                    )

        key = F.pmod(F.xxhash64("_uid", F.lit(level)), F.lit(n_groups)).alias("group")
        keyed = open_.select(key, "_uid", "length").repartition(min(n_groups, 4096), "group").sortWithinPartitions("group", "_uid")
        groups = keyed.mapInArrow(gather, "group long, uids binary, sizes binary")
        best = _rounds(groups, capacity, islands, rounds, offspring, level)
        done = materialize(best.mapInArrow(place, schema), f"placed-{level}")
        placed.append(done.filter(~F.col("again")).select("_uid", "sequence_id", "offset"))
        if last:
            break
        open_ = done.filter("again").select("_uid", "length")
        if not (n := open_.count()):
            break
    full = table.filter(F.col("length") == capacity).withColumn("sequence_id", F.col("_uid") + F.lit(1 << 62))
    full = full.withColumn("offset", F.lit(0).cast("long"))
    where = placed[0]
    for more in placed[1:]:
        where = where.unionByName(more)
    rest = table.filter(F.col("length") < capacity).join(where, "_uid")
    return full.unionByName(rest).drop("_uid")


def cut(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Pieces of every document's ids and end id; only the first of several may be shorter."""
    text_batches(docs.sparkSession)
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in batches:
            row = 0
            for coded in enc.blocks(batch.column("text"), TEXT_BYTES):
                rows: list[tuple] = []
                for doc, ids in zip(batch.column("doc_id").slice(row, len(coded)).to_pylist(), coded):
                    n = len(ids) // 4 + 1
                    first = n % capacity or capacity
                    at = 0
                    for k in range(-(-n // capacity)):
                        to = first + k * capacity
                        part = ids[4 * at : 4 * to] + end if to == n else ids[4 * at : 4 * to]
                        rows.append((doc, k, at, to - at, zlib.crc32(part), part if with_ids else None))
                        at = to
                row += len(coded)
                cols = list(zip(*rows))
                out = [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    out.append(pa.array(cols[5], pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(out, names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
