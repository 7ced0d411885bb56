"""Byte-level BPE token ids, word by word.

The tokenizer's pre-tokeniser never joins what stands on both sides of a single space
between two non-space characters, so the ids of a text are the ids of its
space-separated words, each with its leading space, in a row. A word made of plain
letters and a run of plain signs, or several such around line ends, is put together from
the ids of those parts in the same way. Parts repeat; their ids are looked up in bounded
per-process tables and only unseen parts reach the tokenizer. Everything else takes an
exact slower way. Results are the same as those of one ``encode`` call on the whole text
(tested). A vocabulary file with another pre-tokeniser is encoded text by text.
"""

from __future__ import annotations

import gc
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from graphloom.llm.memory import claim, register, release

DEFAULT_TOKENIZER = "byte_bpe_50k.json"
#: Words whose ids one process keeps; a full table keeps what the block at hand uses.
WORD_TABLE = 450_000
#: Bytes of text whose words are told apart at a time; words put together at a time.
BLOCK, SLICE = 16_000_000, 200_000
_SAFE_SPACE = re.compile("(?<=[^\\s\u180e]) (?=[^\\s\u180e])")
_LETTERS = "^[A-Za-zÀ-ÖØ-öø-ÿ]+$"
_SIGNS = ".,;:!?*#$%&|()\"<>=+/-"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(DEFAULT_TOKENIZER)


def _word_wise(path: str) -> bool:
    """Whether the file's pre-tokeniser is the byte-level one described above."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec.get("pre_tokenizer") or {}
    return (
        spec.get("normalizer") is None
        and pre.get("type") == "ByteLevel"
        and pre.get("use_regex", True)
        and not pre.get("add_prefix_space")
    )


class WordEncoder:
    """Encodes texts to little-endian unsigned 32-bit ids.

    ``literal_specials``: treat the vocabulary's special strings in a text as ordinary
    characters instead of control ids.
    """

    def __init__(self, path: str | None = None, literal_specials: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        path = path or default_path()
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = literal_specials
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.specials = [] if literal_specials else [t.content for t in added]
        self.line_end = self._plain("\n")
        self.word_wise = _word_wise(path) and len(self.line_end) == 4
        self.words: dict[str, bytes | None] = {}  # ids of " " + word
        self.heads: dict[str, bytes | None] = {}  # ids of the word alone

    def _plain(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _each(self, texts: list[str]) -> list[bytes]:
        got = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.asarray(e.ids, "<u4").tobytes() for e in got]

    def _fill(self, table: dict[str, bytes | None], new: list[str], lead: str) -> None:
        """Encode words without white space inside; many go in one call, apart by line ends.

        A line end is a pre-token of its own before a letter or before a space and a letter.
        """
        end = int(np.frombuffer(self.line_end, "<u4")[0])
        for i in range(0, len(new), 500):
            some = new[i : i + 500]
            ids = np.frombuffer(self._plain(lead + ("\n" + lead).join(some)), "<u4")
            cuts = np.flatnonzero(ids == end).tolist()
            raw, at = ids.tobytes(), 0
            if len(cuts) != len(some) - 1:
                table.update(zip(some, self._each([lead + w for w in some])))
                continue
            for word, cut in zip(some, [*cuts, len(ids)]):
                table[word] = raw[4 * at : 4 * cut]
                at = cut + 1

    def _known(self, table: dict[str, bytes | None], used: list[str], lead: str, letters: bool) -> list[bytes | None]:
        """Ids of distinct words after ``lead``; None for those that are no whole word of a text."""
        new = [w for w in used if w not in table]
        if len(new) + len(table) > WORD_TABLE:
            kept = {w: table[w] for w in used if w in table}
            table.clear()
            table.update(kept)
        if letters:
            self._fill(table, new, lead)
        elif new:
            for word, ids in zip(new, self._each([lead + w for w in new])):
                unsafe = not word or word[0].isspace() or word[-1].isspace() or "\u180e" in word
                table[word] = None if unsafe else ids
        return [table[w] for w in used]

    def _words(self, words: pa.LargeStringArray, lead: str) -> list[bytes | None]:
        """Ids of distinct words; one that begins with a line end stands after it, without ``lead``."""
        broken = pc.starts_with(words, "\n")
        core = pc.if_else(broken, pc.utf8_slice_codeunits(words, 1), words)
        base = pc.utf8_rtrim(core, characters=_SIGNS)
        simple = np.asarray(pc.match_substring_regex(base, _LETTERS))
        broken = np.asarray(broken)
        out: list[bytes | None] = [None] * len(words)
        n_base = np.asarray(pc.binary_length(base)).astype(np.int64)
        n_core = np.asarray(pc.binary_length(core)).astype(np.int64)
        signed = simple & (n_base < n_core)
        tail: dict[int, bytes] = {}
        if signed.any():
            at = np.flatnonzero(signed)
            suffix = pa.array([w[n:] for w, n in zip(core.take(pa.array(at)).to_pylist(), np.asarray(pc.utf8_length(base))[at].tolist())], pa.large_string()).dictionary_encode()
            ids = self._known(self.heads, suffix.dictionary.to_pylist(), "", False)
            tail = dict(zip(at.tolist(), [ids[i] for i in np.asarray(suffix.indices).tolist()]))
        for after, table, first, start in ((False, self.words, lead, b""), (True, self.heads, "", self.line_end)):
            if not lead and not after:
                table = self.heads
            at = np.flatnonzero(simple & (broken == after))
            if not len(at):
                continue
            coded = base.take(pa.array(at)).dictionary_encode()
            ids = self._known(table, coded.dictionary.to_pylist(), first, True)
            for i, k in zip(at.tolist(), np.asarray(coded.indices).tolist()):
                out[i] = ids[k]
            if after:
                for i in at.tolist():
                    out[i] = start + out[i]
        for i, ids in tail.items():
            out[i] += ids
        for after, table, first in ((False, self.words if lead else self.heads, lead), (True, self.heads, "")):
            at = np.flatnonzero(~simple & (broken == after))
            if len(at):
                ids = self._known(table, core.take(pa.array(at)).to_pylist(), first, False)
                for i, x in zip(at.tolist(), ids):
                    out[i] = x if x is None or not after else self.line_end + x
        return out

    def _mixed(self, text: str) -> bytes:
        """Cut at the safe spaces only; the tokenizer encodes each piece."""
        pieces = _SAFE_SPACE.split(text)
        lead = [p if i == 0 else " " + p for i, p in enumerate(pieces)]
        new = list(set(lead))
        known = dict(zip(new, self._each(new)))
        return b"".join([known[p] for p in lead])

    def _block(self, texts: pa.LargeStringArray) -> list[bytes]:
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        flat = lists.flatten()
        starts = np.asarray(lists.offsets)[: len(texts)] - lists.offsets[0].as_py()
        where = np.append(starts, len(flat))
        coded, first = flat.dictionary_encode(), flat.take(pa.array(starts)).dictionary_encode()
        del lists, flat
        index, words, heads = np.asarray(coded.indices).copy(), coded.dictionary, first.dictionary
        index[starts] = np.asarray(first.indices) + len(words)
        del coded, first
        used = self._words(words, " ") + self._words(heads, "")
        unsafe = np.fromiter((x is None for x in used), bool, len(used))
        used = [x or b"" for x in used]
        size = np.fromiter(map(len, used), np.int32, len(used))
        result: list[bytes] = []
        cuts = np.unique(np.append(np.searchsorted(where, np.arange(0, len(index), SLICE)), len(texts))).tolist()
        for a, b in zip(cuts, cuts[1:]):
            part = index[where[a] : where[b]]
            whole = b"".join([used[i] for i in part.tolist()])
            ends = np.append(0, np.cumsum(size[part], dtype=np.int64))[where[a : b + 1] - where[a]].tolist()
            result += [whole[i:j] for i, j in zip(ends, ends[1:])]
        if unsafe.any():
            for i in np.unique(np.searchsorted(where, np.flatnonzero(unsafe[index]), "right") - 1).tolist():
                result[i] = self._mixed(texts[i].as_py())
        for special in self.specials:
            for i in np.flatnonzero(np.asarray(pc.match_substring(texts, special))).tolist():
                result[i] = self._plain(texts[i].as_py())
        return result

    def encode(self, texts: pa.Array | list[str | None]) -> list[bytes]:
        """Ids of every text as bytes; a null text is an empty one."""
        return [ids for block in self.blocks(texts) for ids in block]

    def blocks(self, texts: pa.Array | list[str | None], limit: int = BLOCK) -> Iterator[list[bytes]]:
        """As ``encode``, for some texts after others: those of about ``limit`` bytes, or one longer text."""
        claim("tokens")
        if not isinstance(texts, (pa.Array, pa.ChunkedArray)):
            texts = pa.array(texts, pa.large_string())
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        texts = texts.cast(pa.large_string()).fill_null("")
        sizes = np.cumsum(np.asarray(pc.binary_length(texts))) // limit
        bounds = [0, *(np.flatnonzero(np.diff(sizes)) + 1).tolist(), len(texts)]
        for a, b in zip(bounds, bounds[1:]):
            if b > a:
                yield self._quietly(texts[a:b]) if self.word_wise else [self._plain(t) if t else b"" for t in texts[a:b].to_pylist()]
                release()

    def _quietly(self, texts: pa.LargeStringArray) -> list[bytes]:
        was = gc.isenabled()
        gc.disable()  # the many small lists hold no cycles
        try:
            return self._block(texts)
        finally:
            if was:
                gc.enable()


_encoders: dict[tuple, WordEncoder] = {}
register("tokens", _encoders.clear)


def encoder(path: str | None = None, literal_specials: bool = False) -> WordEncoder:
    """This process's encoder for a vocabulary file; its word table lives on between tasks."""
    key = (path, literal_specials)
    if key not in _encoders:
        _encoders[key] = WordEncoder(path, literal_specials)
    return _encoders[key]
