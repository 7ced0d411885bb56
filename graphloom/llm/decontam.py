"""Benchmark decontamination on templates.

Texts become streams of lower-case words in which numbers, given names and units are typed
placeholders. Windows of ``WINDOW`` stream items are hashed and joined with the windows of
the benchmark; a shorter benchmark item of at least ``SHORTEST`` items is one window. A hit
counts when its words are equal and its slots are consistent: in one occurrence (hits of an
item at one offset), each of the item's slot values must map to one of the document's, or the
window's own values must be equal. ``verbatim`` tells that the whole item, word for word,
stands in the document; anything else found is a re-parameterised or partial copy.

The benchmark's windows are an index file of at most ``INDEX_ROWS`` rows that every task
reads; a larger benchmark is cut into such blocks, each matched against all documents, so no
size is broadcast without a bound. Documents are never shuffled.

An item without a window of enough plain words (``LEAST_WORDS``), or shorter than ``SHORTEST``,
is matched whole and word for word, with its real values.

Edge cases: null and empty texts have no windows; a very long text is a block of its own; an
item of one word marks nothing; repeated items and documents each count; empty tables give no hits; other columns are ignored or, in
``drop_contaminated``, kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.files import reading, writing
from graphloom.llm.memory import claim, register, release
from graphloom.llm.names import GIVEN
from graphloom.session import materialize, parts_for, shared_path, text_batches

WINDOW, SHORTEST, LEAST_WORDS = 8, 4, 4
INDEX_ROWS = 2_000_000
BLOCK = 8_000_000
_UNITS = frozenset(
    "gallon gallons quart quarts pint pints cup cups tablespoon tablespoons teaspoon teaspoons gal psi acre acres hectare hectares joule joules newton newtons ampere amperes amp amps ohm ohms hertz pascal pascals rupee rupees yuan rubles dozen dozens knot knots litro mm cm dm km kg mg lb lbs oz ft mph kmh kph hz khz mhz ghz kb mb gb tb kw kwh mw ml cl litre litres liter liters meter meters metre metres kilometer kilometers "
    "kilometre kilometres mile miles inch inches foot feet yard yards gram grams kilogram kilograms tonne tonnes ton tons pound pounds ounce ounces second seconds minute "
    "minutes hour hours day days week weeks month months year years degree degrees celsius fahrenheit kelvin watt watts volt volts percent percentage dollar dollars euro "
    "euros cent cents usd eur gbp yen peso pesos metro metros kilo kilos gramo gramos hora horas minuto minutos segundo segundos stunde stunden minuten sekunde sekunden "
    "meile meilen pfund heure heures seconde secondes mètre mètres gramme grammes litro litros".split()
)
_NAMES = frozenset(n.lower() for n in GIVEN)
#: Written numbers; "one" is left out, since it is a pronoun as often.
_NUMERALS = frozenset(
    "two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty "
    "ninety hundred thousand million billion half twice thrice".split()
)
_WORD, _NUMBER, _UNIT, _NAME = range(4)
_MARK = ("", "<number>", "<unit>", "<name>")
_CLEAN = bytes(b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 or 65 <= b <= 90 else 32 for b in range(256))
_P = 0x9E3779B97F4A7C15 | 1

_kinds: dict[str, tuple[int, int]] = {}
_TABLE = 300_000


def _kind(word: str) -> int:
    if word[0].isdigit() or word in _NUMERALS:
        return _NUMBER
    if word in _UNITS:
        return _UNIT
    return _NAME if word in _NAMES else _WORD


def _look_up(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash and kind of distinct words; a placeholder's hash is that of its mark."""
    if len(_kinds) + len(words) > _TABLE:
        _kinds.clear()
    hash_ = xxhash.xxh64_intdigest
    for w in words:
        if w not in _kinds:
            k = _kind(w) if w else _WORD
            _kinds[w] = (hash_(_MARK[k] or w), k)
    got = [_kinds[w] for w in words]
    return np.array([g[0] for g in got], np.uint64), np.array([g[1] for g in got], np.int8)


class Streams:
    """Template streams of a block of texts: runs of numbers are one item."""

    def __init__(self, texts: pa.LargeStringArray):
        low = pc.utf8_lower(texts)
        offsets = np.frombuffer(low.buffers()[1], np.int64)[low.offset : low.offset + len(low) + 1]
        data = (low.buffers()[2].to_pybytes() if low.buffers()[2] else b"").translate(_CLEAN)
        clean = pa.LargeStringArray.from_buffers(len(low), pa.py_buffer(offsets.tobytes()), pa.py_buffer(data))
        lists = pc.ascii_split_whitespace(clean)
        flat = lists.flatten()
        doc = np.repeat(np.arange(len(texts)), np.diff(np.asarray(lists.offsets)))
        coded = flat.dictionary_encode()
        self.words = coded.dictionary.to_pylist()
        hashes, kinds = _look_up(self.words)
        index = np.asarray(coded.indices).astype(np.int64)
        filled = np.array([bool(w) for w in self.words], bool)
        real = filled[index] if len(index) else np.zeros(0, bool)
        index, doc = index[real], doc[real]
        kind = kinds[index]
        head = np.ones(len(index), bool)
        head[1:] = (kind[1:] != _NUMBER) | (kind[:-1] != _NUMBER) | (doc[1:] != doc[:-1])
        self.at = np.flatnonzero(head)  # where each item begins among the words
        self.index, self.doc, self.kind = index, doc[head], kind[head]
        self.hashes = hashes[index[head]]
        self.n_words = len(index)

    def windows(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts of all windows that lie in one document, and their hashes."""
        n = len(self.doc) - length + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        total = np.zeros(n, np.uint64)
        for j in range(length):
            total = total * np.uint64(_P) + self.hashes[j : j + n]
        total ^= total >> np.uint64(29)
        inside = np.flatnonzero(self.doc[:n] == self.doc[length - 1 :])
        return inside, total[inside] * np.uint64(0xBF58476D1CE4E5B9)

    def sums(self) -> tuple[np.ndarray, np.ndarray]:
        """Running sums of the words' own hashes, each times a power of _P, and the document of each word."""
        own = np.array([xxhash.xxh64_intdigest(w) for w in self.words], np.uint64)[self.index]
        powers = np.cumprod(np.append(np.uint64(1), np.full(len(own), _P, np.uint64)), dtype=np.uint64)
        doc = self.doc[np.repeat(np.arange(len(self.at)), np.diff(np.append(self.at, self.n_words)))]
        return np.append(np.uint64(0), np.cumsum(own * powers[:-1], dtype=np.uint64)), doc

    def starts_with(self, item: int, n_words: int, whole: int) -> bool:
        """Whether the ``n_words`` words from an item on, in its document, have the hash ``whole``."""
        at = int(self.at[item])
        end = item + 1
        while end < len(self.doc) and self.doc[end] == self.doc[item] and int(self.at[end]) < at + n_words:
            end += 1
        last = int(self.at[end]) if end < len(self.at) else self.n_words
        return at + n_words <= last and _whole([self.words[i] for i in self.index[at : at + n_words].tolist()]) == whole

    def value(self, item: int) -> str:
        first = int(self.at[item])
        last = int(self.at[item + 1]) if item + 1 < len(self.at) else self.n_words
        return " ".join(self.words[i] for i in self.index[first:last].tolist())

    def window(self, start: int, length: int) -> tuple[str, list[str]]:
        """Template and slot values of one window."""
        parts, slots = [], []
        for i in range(start, start + length):
            k = int(self.kind[i])
            value = self.value(i)
            parts.append(_MARK[k] or value)
            if k:
                slots.append(value)
        return " ".join(parts), slots


def _blocks(texts: pa.Array) -> Iterator[tuple[int, Streams]]:
    claim("decontam")
    texts = texts.cast(pa.large_string()).fill_null("")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    sizes = np.cumsum(np.asarray(pc.binary_length(texts))) // BLOCK
    cuts = [0, *(np.flatnonzero(np.diff(sizes)) + 1).tolist(), len(texts)]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield a, Streams(texts.slice(a, b - a))
            release()


#: ``n_words`` and ``whole`` are those of the item: how many words it has, and their hash.
_WINDOWS = pa.schema([("hash", pa.int64()), ("item_id", pa.int64()), ("size", pa.int32()), ("place", pa.int64()), ("template", pa.string()), ("slots", pa.list_(pa.string())), ("n_words", pa.int32()), ("whole", pa.int64())])


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column("item_id").to_pylist()
            for base, s in _blocks(batch.column("text")):
                rows = []
                lengths = np.bincount(s.doc, minlength=1)
                first = np.cumsum(lengths) - lengths
                starts, hashes = s.windows(window)
                todo = [(int(i), window, int(h)) for i, h in zip(starts, hashes.view(np.int64))]
                for d in np.flatnonzero((lengths >= SHORTEST) & (lengths < window)).tolist():
                    starts, hashes = s.windows(int(lengths[d]))
                    todo += [(int(i), int(lengths[d]), int(h)) for i, h in zip(starts, hashes.view(np.int64)) if i == first[d]]
                ends = np.append(s.at, s.n_words)
                known: dict[int, list[str]] = {}

                def words_of(d: int) -> list[str]:
                    if d not in known:
                        known[d] = [s.words[i] for i in s.index[ends[first[d]] : ends[first[d] + lengths[d]]].tolist()]
                    return known[d]

                for i, n, h in todo:
                    if (s.kind[i : i + n] == _WORD).sum() >= min(LEAST_WORDS, n):
                        template, slots = s.window(i, n)
                        rows.append({"hash": h, "item_id": names[base + int(s.doc[i])], "size": n, "place": i - int(first[s.doc[i]]), "template": template, "slots": slots})
                        rows[-1] |= {"n_words": len(words_of(int(s.doc[i]))), "whole": _whole(words_of(int(s.doc[i])))}
                indexed = {int(s.doc[i]) for i, n, _ in todo if (s.kind[i : i + n] == _WORD).sum() >= min(LEAST_WORDS, n)}
                for d in np.flatnonzero(lengths).tolist():
                    words = words_of(d)
                    if d not in indexed and len(words) > 1:
                        # whole and verbatim: a negative size, in words
                        rows.append({"hash": _whole(words), "item_id": names[base + d], "size": -len(words), "place": 0, "template": " ".join(words), "slots": [], "n_words": len(words), "whole": _whole(words)})
                yield pa.RecordBatch.from_pylist(rows, _WINDOWS)

    schema = "hash long, item_id long, size int, place long, template string, slots array<string>, n_words int, whole long"
    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(run, schema)


def _whole(words: list[str]) -> int:
    """The hash of words as ``Streams.sums`` has it for those at the start of a block, as a signed long."""
    total = 0
    for w in reversed(words):
        total = (total * _P + xxhash.xxh64_intdigest(w)) % (1 << 64)
    return total - (1 << 64) if total >> 63 else total


class Index:
    """A block of the benchmark's windows, read from its file once per process."""

    def __init__(self, uri: str):
        with reading(uri) as f:
            self.table = pa.ipc.open_file(f).read_all()
        hashes = np.asarray(self.table.column("hash")).view(np.uint64)
        self.order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[self.order]
        self.seen = np.zeros(1 << 22, bool)
        self.seen[self.hashes >> np.uint64(42)] = True
        sizes = np.asarray(self.table.column("size"))
        self.lengths = sorted(set(sizes[sizes > 0].tolist()))
        # whole items by their number of words: sorted hashes, and the rows they come from
        self.wholes: list[tuple[int, np.ndarray, np.ndarray]] = []
        for n in sorted(set(sizes[sizes < 0].tolist()), reverse=True):
            rows = np.flatnonzero(sizes == n)
            rows = rows[np.argsort(hashes[rows], kind="stable")]
            self.wholes.append((-n, hashes[rows], rows))

    def hits(self, s: Streams) -> Iterator[tuple[int, int, int, bool]]:
        """(document, item, windows, verbatim) for every item found in a document."""
        found: dict[tuple[int, int], dict[int, list[tuple[list[str], list[str]]]]] = {}
        whole: dict[tuple[int, int], set[int]] = {}
        first = np.searchsorted(s.doc, np.arange(int(s.doc[-1]) + 1 if len(s.doc) else 0))
        for length in self.lengths:
            starts, hashes = s.windows(length)
            maybe = np.flatnonzero(self.seen[hashes >> np.uint64(42)])
            lo = np.searchsorted(self.hashes, hashes[maybe], "left")
            hi = np.searchsorted(self.hashes, hashes[maybe], "right")
            for i, a, b in zip(starts[maybe[hi > lo]].tolist(), lo[hi > lo].tolist(), hi[hi > lo].tolist()):
                template, slots = s.window(i, length)
                for k in self.order[a:b].tolist():
                    if self.table.column("size")[k].as_py() == length and self.table.column("template")[k].as_py() == template:
                        key = (int(s.doc[i]), self.table.column("item_id")[k].as_py())
                        begin = i - self.table.column("place")[k].as_py()
                        pairs = found.setdefault(key, {}).setdefault(begin, [])
                        pairs.append((self.table.column("slots")[k].as_py(), slots))
                        if len(pairs) == 1 and begin >= first[key[0]] and s.starts_with(begin, self.table.column("n_words")[k].as_py(), self.table.column("whole")[k].as_py()):
                            whole.setdefault(key, set()).add(begin)
        for doc, item in self.verbatim(s):
            at = found.setdefault((doc, item), {})
            at[len(at), "whole"] = [([], [])]
            whole.setdefault((doc, item), set()).add((len(at) - 1, "whole"))
        for key, occurrences in found.items():
            counted = sum(judge(pairs) for pairs in occurrences.values())
            if counted:
                yield *key, counted, bool(whole.get(key))

    def verbatim(self, s: Streams) -> Iterator[tuple[int, int]]:
        """(document, item) of every occurrence of a whole item."""
        if not self.wholes or not s.n_words:
            return
        sums, doc = s.sums()
        inverse = np.uint64(pow(_P, -1, 1 << 64))
        back = np.cumprod(np.append(np.uint64(1), np.full(s.n_words - 1, inverse, np.uint64)), dtype=np.uint64)
        for n, hashes, rows in self.wholes:
            if n > s.n_words:
                continue
            got = (sums[n:] - sums[:-n]) * back[: s.n_words - n + 1]
            lo, hi = np.searchsorted(hashes, got, "left"), np.searchsorted(hashes, got, "right")
            for i in np.flatnonzero((hi > lo) & (doc[: len(got)] == doc[n - 1 :])).tolist():
                text = " ".join(s.words[j] for j in s.index[i : i + n].tolist())
                for k in rows[lo[i] : hi[i]].tolist():
                    if self.table.column("template")[k].as_py() == text:
                        yield int(doc[i]), self.table.column("item_id")[k].as_py()


def judge(pairs: list[tuple[list[str], list[str]]]) -> int:
    """Windows that count in one occurrence: all where its slots are consistent, else those with equal slots.

    A window whose slots contradict themselves refutes the occurrence like one that contradicts another.
    """
    return len(pairs) if consistent(pairs) else sum(a == b for a, b in pairs)


def consistent(pairs: list[tuple[list[str], list[str]]]) -> bool:
    """Whether each slot value of the item maps to one value of the document."""
    there: dict[str, str] = {}
    return all(there.setdefault(a, b) == b for x, y in pairs for a, b in zip(x, y))


_indexes: dict[str, Index] = {}


def _clear() -> None:
    _indexes.clear()
    _kinds.clear()


register("decontam", _clear)


def _index(uri: str) -> Index:
    if uri not in _indexes:
        _indexes.clear()
        _indexes[uri] = Index(uri)
    return _indexes[uri]


def build_index(benchmark: DataFrame, window: int = WINDOW, index_rows: int = INDEX_ROWS) -> list[str]:
    """Index files of at most about ``index_rows`` windows each, cut by a hash of the item."""
    spark = benchmark.sparkSession
    text_batches(spark)
    table = materialize(benchmark_windows(benchmark, window), "bench-windows")
    n = parts_for(table.count(), index_rows)
    root = shared_path(spark, "bench-index")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        uri = f"{root}/{TaskContext.get().partitionId():06d}.arrow"
        whole = pa.Table.from_batches(list(batches), _WINDOWS)
        with writing(uri) as out, pa.ipc.new_file(out, _WINDOWS) as f:
            f.write_table(whole)
        yield pa.RecordBatch.from_pylist([{"path": uri}])

    spread = table.repartition(n, "item_id") if n > 1 else table.coalesce(1)
    return [r.path for r in materialize(spread.mapInArrow(write, "path string"), "bench-files").collect()]


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, index_rows: int = INDEX_ROWS) -> DataFrame:
    """One row per (doc_id, item_id) found: windows and whether the copy is verbatim."""
    schema = "doc_id long, item_id long, n_windows long, verbatim boolean"
    out = None
    for uri in build_index(benchmark, window, index_rows):

        def run(batches: Iterator[pa.RecordBatch], uri=uri) -> Iterator[pa.RecordBatch]:
            index = _index(uri)
            for batch in batches:
                names = batch.column("doc_id")
                for base, s in _blocks(batch.column("text")):
                    rows = [(names[base + d].as_py(), item, n, same) for d, item, n, same in index.hits(s)]
                    if rows:
                        cols = list(zip(*rows))
                        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_())
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["doc_id", "item_id", "n_windows", "verbatim"])

        part = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, index_rows: int = INDEX_ROWS) -> DataFrame:
    """The documents without any benchmark item, with all their columns."""

    def cleaner(uri: str):
        def clean(text: pa.Array) -> pa.Array:
            ok = np.ones(len(text), bool)
            for base, s in _blocks(text):
                for d, *_ in _index(uri).hits(s):
                    ok[base + d] = False
            return pa.array(ok)

        return F.arrow_udf(clean, T.BooleanType())

    for uri in build_index(benchmark, window, index_rows):
        docs = docs.filter(cleaner(uri)("text"))
    return docs
