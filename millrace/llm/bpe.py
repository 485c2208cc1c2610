"""Token ids of a byte-level BPE tokenizer file, with a memo of words that a Python worker keeps up to a bound of bytes.

The tokenizer first cuts a text at fixed places: before a single space that a non-space follows, and on both sides of a
single line break between non-spaces. Merges never cross these cuts, so a text is the concatenation of the ids of its units:
a word with the space, or with the line break, before it. Texts with any other white space, NUL or a special token's string
are given to the tokenizer whole.

Arrow splits the texts and makes the units of a slice distinct; only those that the memo lacks reach the tokenizers library,
in few calls. A full memo keeps the words that came again since it was last full: most words of a corpus come once. A word of Latin letters is one run of the tokenizer's own pattern and ASCII marks after it are the next, so a
copy of the tokenizer without that pattern merges the words; all other units go through the tokenizer as it is."""

from __future__ import annotations

import functools
import hashlib
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from millrace.llm.shingles import mixed

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: White space other than a space and a line break, NUL, and two marks that some tables call white space.
_ODD_SPACE = "".join(map(chr, (0, 9, *range(11, 14), *range(0x1C, 0x20), 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)))
#: A unit of Latin letters (U+00C0 to U+024F but two signs: letters in any version of Unicode) and ASCII marks.
_PLAIN = r"^(?P<core>\n?[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}]+)(?P<tail>[!-/:-@\[-`{-~]*)$"
#: What a remembered unit takes besides its ids: a key of 16 bytes, where its ids lie, its uses, two to four slots of 4 bytes, and
#: room in buffers that double.
_WORD_BYTES = 60
#: Bytes of a unit that is its own key.
_KEY_BYTES = 16
#: Units that the tokenizer takes at once: its own tokens take far more memory than their ids.
_UNITS = 1 << 14
#: Masks of the lowest 0 to 8 bytes of a word.
_LOW_BYTES = np.array([(1 << 8 * i) - 1 for i in range(9)], dtype=np.uint64)


def byte_of_char() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the others from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {**{chr(b): b for b in own}, **{chr(256 + i): b for i, b in enumerate(rest)}}


def _strings(column: pa.Array) -> list[str]:
    """Python strings of an array without nulls, made in one call (to_pylist makes an Arrow scalar of each)."""
    return column.to_numpy(zero_copy_only=False).tolist()


def keys(units: pa.Array) -> np.ndarray:
    """Two 64-bit words for each unit of a string array without nulls: its bytes, then zeros (no unit holds a NUL); of a unit of
    more than 16 bytes a digest of 128 bits."""
    n = len(units)
    _, at, data = units.buffers()
    at = np.frombuffer(at, dtype=np.int32)[units.offset : units.offset + n + 1].astype(np.int64)
    raw = np.concatenate([np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data else np.zeros(0, np.uint8), np.zeros(_KEY_BYTES, np.uint8)])
    starts, sizes = at[:-1] - at[0], np.diff(at)
    words = np.lib.stride_tricks.sliding_window_view(raw, 8)
    out = np.empty((2, n), dtype=np.uint64)
    for k in range(2):
        left = np.clip(sizes - 8 * k, 0, 8)
        own = words[np.minimum(starts + 8 * k, len(raw) - 8)].view("<u8").ravel()
        out[k] = own & _LOW_BYTES[left]
    for i in np.flatnonzero(sizes > _KEY_BYTES).tolist():
        a = starts[i]
        out[:, i] = np.frombuffer(hashlib.blake2b(raw[a : a + sizes[i]], digest_size=16).digest(), dtype="<u8")
    return out


class Memo:
    """ids of texts. Remembered units stand in an open-addressing table of numpy arrays, a fraction of what a dictionary of strings
    takes, and a slice's units are looked up together. Once they take about `most_bytes`, those are forgotten that came in
    fewest slices, until the others take half of it."""

    def __init__(self, path: str, most_bytes: int = 48 << 20):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.most_bytes = most_bytes
        special = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.odd = "|".join(["  ", "\n\n", " \n", "\n ", r" \z", f"[{_ODD_SPACE}]", *special])
        self.newline = self.whole("\n")
        if len(self.newline) != 1:
            raise ValueError("the tokenizer has no token for a line break")
        self.merger = Tokenizer.from_file(path)
        self.merger.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("\n")
        own = {b: c for c, b in byte_of_char().items()}
        self.space = own[32]
        self.letters = {32: self.space, **{c: "".join(own[b] for b in chr(c).encode()) for c in range(0xC0, 0x250)}}
        self.leads = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)
        self.leads[[i for t, i in self.tokenizer.get_vocab().items() if t.startswith(self.space)]] = True
        self.forget()

    def forget(self) -> None:
        self.slots = np.full(1 << 12, -1, dtype=np.int32)  # numbers of units, each in the first free slot from its hash on
        self.keys = np.zeros((2, 1 << 10), dtype=np.uint64)
        self.starts, self.sizes = np.zeros(1 << 10, dtype=np.int64), np.zeros(1 << 10, dtype=np.int32)
        self.uses = np.zeros(1 << 10, dtype=np.int32)  # slices since the memo was last full
        self.pool = np.zeros(1 << 12, dtype=np.int32)
        self.words = self.used = 0
        self._append(keys(pa.array(["", "\n"])), np.array(self.newline, dtype=np.int32), np.zeros(2, dtype=np.int64), np.array([0, 1]))

    def shrink(self) -> None:
        """Forget the units of fewest uses, until the others take half of the bytes; count uses anew."""
        uses, sizes = self.uses[: self.words], self.sizes[: self.words]
        by_uses = np.bincount(uses, weights=_WORD_BYTES + 4 * sizes)
        most = np.cumsum(by_uses[::-1])[::-1]  # bytes of the units of so many uses or more
        least = max(2, int(np.argmax(np.append(most, 0) <= self.most_bytes // 2)))
        kept = np.flatnonzero(uses >= least)
        kept = kept[kept > 1]  # "" and a line break are there anyway
        own, sizes = self.keys[:, kept], sizes[kept]
        ids, ends = self._gather(self.starts[kept], sizes)
        self.forget()
        self._append(own, ids, ends - sizes, sizes)

    @property
    def bytes(self) -> int:
        return self.words * _WORD_BYTES + 4 * self.used

    def _slot(self, own: np.ndarray) -> np.ndarray:
        return (mixed(own[0] ^ mixed(own[1])) & np.uint64(len(self.slots) - 1)).astype(np.int64)

    def _find(self, own: np.ndarray) -> np.ndarray:
        """Numbers of the units of these keys, -1 for an unknown one."""
        out = np.full(own.shape[1], -1, dtype=np.int64)
        left, at = np.arange(own.shape[1]), self._slot(own)
        while len(left):
            found = self.slots[at]
            taken = found >= 0
            same = taken & (self.keys[0][found] == own[0][left]) & (self.keys[1][found] == own[1][left])
            out[left[same]] = found[same]
            go_on = taken & ~same
            left, at = left[go_on], (at[go_on] + 1) & (len(self.slots) - 1)
        return out

    def _enter(self, first: int) -> None:
        """Put the units from number first on into slots."""
        numbers = np.arange(first, self.words, dtype=np.int32)
        at = self._slot(self.keys[:, first : self.words])
        while len(numbers):
            free = self.slots[at] < 0
            self.slots[at[free]] = numbers[free]  # of several for one slot the last gets it
            go_on = self.slots[at] != numbers
            numbers, at = numbers[go_on], (at[go_on] + 1) & (len(self.slots) - 1)

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _append(self, own: np.ndarray, ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> None:
        """Remember units, by their keys, all new and distinct, whose ids lie in `ids` from starts on. Buffers double when full."""
        first, n, m = self.words, self.words + own.shape[1], self.used + len(ids)
        if n > len(self.starts):
            size = max(n, 2 * len(self.starts))
            longer = lambda x: np.concatenate([x[..., :first], np.zeros((*x.shape[:-1], size - first), dtype=x.dtype)], axis=-1)
            self.keys, self.starts, self.sizes, self.uses = map(longer, (self.keys, self.starts, self.sizes, self.uses))
        if m > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], np.zeros(max(m, 2 * len(self.pool)) - self.used, dtype=np.int32)])
        self.keys[:, first:n] = own
        self.starts[first:n] = starts + self.used
        self.sizes[first:n] = sizes
        self.pool[self.used : m] = ids
        self.words, self.used = n, m
        if 2 * n > len(self.slots):
            self.slots = np.full(1 << (4 * n - 1).bit_length(), -1, dtype=np.int32)
            first = 0
        self._enter(first)

    def _gather(self, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of runs of the pool one after another, and where each ends."""
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return self.pool[np.repeat(starts - (ends - sizes), sizes) + np.arange(total)], ends

    def _add(self, units: pa.Array) -> None:
        """Encode units that the memo lacks in one call. Each stands on a line of its own: the line break before a unit is its
        own where it starts with one, and is left out where the unit starts with a space."""
        own = _strings(units)
        ids = np.array(self.whole("".join([u if u[0] == "\n" else "\n " + u for u in own])), dtype=np.int32)
        cuts = np.flatnonzero(ids == self.newline[0])
        if len(cuts) != len(units):
            raise ValueError("units and token runs don't match")
        starts = cuts + np.fromiter((u[0] != "\n" for u in own), dtype=bool, count=len(own))
        self._append(keys(units), ids, starts, np.append(cuts[1:], len(ids)) - starts)

    def _add_words(self, words: pa.Array) -> None:
        """Encode words of Latin letters, each after a space, by merges alone: a word's first token holds the space."""
        joined = " " + "\n ".join(_strings(words))
        joined = joined.replace(" ", self.space) if joined.isascii() else joined.translate(self.letters)
        ids = np.array(self.merger.encode_batch_fast([joined], add_special_tokens=False)[0].ids, dtype=np.int32)
        starts = np.flatnonzero(self.leads[ids])
        if len(starts) != len(words):
            raise ValueError("words and token runs don't match")
        self._append(keys(words), ids, starts, np.append(starts[1:], len(ids)) - starts)

    def _new(self, units: pa.Array) -> pa.Array:
        """Those of an array that the memo lacks, once each."""
        units = units.unique()
        return units.filter(pa.array(self._find(keys(units)) < 0))

    def _learn(self, units: pa.Array) -> None:
        """Remember the units of an array without repeats, none of which is known."""
        parts = pc.extract_regex(units, _PLAIN)
        plain = parts.is_valid()
        parts = parts.filter(plain)
        cores, tails, own = parts.field("core"), parts.field("tail"), units.filter(plain)
        marked = pc.not_equal(tails, "")
        lines = pc.binary_join_element_wise("\n", tails.filter(marked), "")  # marks alone, without a space before them
        new = self._new(cores)
        of_line = pc.starts_with(new, "\n")
        others = self._new(pa.concat_arrays([units.filter(pc.invert(plain)), lines, new.filter(of_line)]))
        new = new.filter(pc.invert(of_line))
        ascii_ = pc.string_is_ascii(new)  # a call that holds another letter goes through a table, character by character
        for these, add in ((others, self._add), (new.filter(ascii_), self._add_words), (new.filter(pc.invert(ascii_)), self._add_words)):
            for a in range(0, len(these), _UNITS):
                add(these.slice(a, _UNITS))
        if not len(lines):
            return
        first, last = self._find(keys(cores.filter(marked))), self._find(keys(lines))
        starts = np.stack([self.starts[first], self.starts[last] + 1], axis=1).ravel()  # without the mark's line break
        sizes = np.stack([self.sizes[first], self.sizes[last] - 1], axis=1).ravel()
        ids, stops = self._gather(starts, sizes)
        stops = stops[1::2]
        begins = np.concatenate([[0], stops[:-1]])
        self._append(keys(own.filter(marked)), ids, begins, stops - begins)

    def encode(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a string array's texts one after another, and the number of ids of each; null is an empty text; `end` is
        added after each text."""
        if self.bytes > self.most_bytes:
            self.shrink()
        texts = pc.fill_null(texts.cast(pa.string()), "")
        odd = pc.match_substring_regex(texts, self.odd)
        usual = texts.filter(pc.invert(odd))
        lines = pc.split_pattern(pc.replace_substring(pc.binary_join_element_wise("\n", usual, ""), "\n", " \n"), " ")
        at = lines.offsets.to_numpy().astype(np.int64)  # each list: "", the text's first unit with a line break, its other units
        coded = lines.flatten().dictionary_encode()
        wanted = keys(coded.dictionary)
        index = self._find(wanted)
        new = np.flatnonzero(index < 0)
        if len(new):
            self._learn(coded.dictionary.take(pa.array(new)))
            index[new] = self._find(wanted[:, new])
        self.uses[index] += 1
        own = index[coded.indices.to_numpy()]
        starts, sizes = self.starts[own], self.sizes[own]
        first = at[:-1] + 1  # the line break before the text isn't part of it
        starts[first] += 1
        sizes[first] -= 1
        flat, ends = self._gather(starts, sizes)
        of_usual = np.diff(np.concatenate([[0], ends])[at])
        more = 0 if end is None else 1
        lengths = np.zeros(len(texts), dtype=np.int64)
        lengths[~odd.to_numpy(zero_copy_only=False)] = of_usual
        direct = {i: np.array(self.whole(texts[i].as_py()), dtype=np.int32) for i in np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist()}
        for i, ids in direct.items():
            lengths[i] = len(ids)
        if not direct and not more:
            return flat, lengths
        stops = np.cumsum(lengths + more)
        out = np.zeros(int(stops[-1]) if len(stops) else 0, dtype=np.int32)
        place = np.ones(len(out), dtype=bool)
        if more:
            out[stops - 1] = end
            place[stops - 1] = False
        for i, ids in direct.items():
            a = stops[i] - more - len(ids)
            out[a : a + len(ids)] = ids
            place[a : a + len(ids)] = False
        out[place] = flat
        return out, lengths + more


_MEMOS: dict[str, Memo] = {}


def memo(path: str) -> Memo:
    """One memo for each file in a Python worker."""
    if path not in _MEMOS:
        _MEMOS[path] = Memo(path)
    return _MEMOS[path]


@functools.lru_cache
def marks_end(path: str) -> np.ndarray:
    """For each id: 1 if a sentence may end after the token (its text ends with . ! ? or holds a line break)."""
    tokenizer = memo(path).tokenizer
    n = tokenizer.get_vocab_size()
    out = np.zeros(n, dtype=bool)
    for i in range(n):
        t = tokenizer.id_to_token(i) or ""
        out[i] = t.endswith((".", "!", "?")) or "Ċ" in t
    return out
