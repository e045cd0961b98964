"""Ids of whole texts from a tokenizer, remembering pieces.

A byte-level tokenizer cuts a text before any merge: always before a single space, at a
single line end, and before a full stop or comma after a letter or digit. A text is the
sum of its pieces at such places, wherever the characters around them are plain; other
places are left inside a piece. Each distinct piece is encoded once by the tokenizer.
Pieces are found, told apart and looked up for many texts at once in arrays. The key of a
piece of at most ``SHORT`` bytes is those bytes and their number; longer ones, which are
few, have 120 bits of their XXH3 hash.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator, Sequence
from itertools import chain

import numpy as np
import xxhash

GROUP_BYTES = 1 << 19
SLOTS = 1 << 21
SHORT = 15
LONG_MARK = 0xFF << 56  # where short keys have their length
ODD = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def slots(keys: np.ndarray) -> np.ndarray:
    """Where to look for keys first."""
    with np.errstate(over="ignore"):
        mixed = (keys[:, 0] ^ (keys[:, 1] * np.uint64(ODD[0]))) * np.uint64(ODD[1])
    return ((mixed ^ (mixed >> np.uint64(29))) >> np.uint64(20)).astype(np.int64) & (SLOTS - 1)


def piece_keys(joined: bytes, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A pair of 64-bit numbers for each piece."""
    eight = np.lib.stride_tricks.sliding_window_view(np.frombuffer(joined + bytes(16), np.uint8), 8)
    sizes = (stops - starts).astype(np.uint64)
    out = np.empty((len(starts), 2), np.uint64)
    for i in range(2):
        words = np.ascontiguousarray(eight[starts + 8 * i]).view("<u8").ravel()
        kept = np.clip(sizes.astype(np.int64) - 8 * i, 0, 8 - i).astype(np.uint64) * np.uint64(8)
        # Shifts by 64 are undefined: all eight bytes need no mask.
        mask = np.where(kept < 64, (np.uint64(1) << np.minimum(kept, np.uint64(63))) - np.uint64(1), np.uint64(0xFFFFFFFFFFFFFFFF))
        out[:, i] = words & mask
    out[:, 1] |= sizes << np.uint64(56)
    for i in np.flatnonzero(sizes > SHORT).tolist():
        h = xxhash.xxh3_128_intdigest(joined[starts[i] : stops[i]])
        out[i] = h & 0xFFFFFFFFFFFFFFFF, h >> 64 | LONG_MARK
    return out


class _Memory:
    """Piece hash to ids: an open-addressing table in arrays, emptied when it is half full."""

    def __init__(self, dtype: np.dtype):
        self.dtype = dtype
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros((SLOTS, 2), np.uint64)
        self.at = np.full(SLOTS, -1, np.int32)
        self.starts = np.zeros(1 << 16, np.int64)
        self.sizes = np.zeros(1 << 16, np.int32)
        self.ids = np.zeros(1 << 18, self.dtype)
        self.count = self.used = 0

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each piece, -1 if it is not known."""
        found = np.full(len(keys), -1, np.int32)
        open_, slot = np.arange(len(keys)), slots(keys)
        while len(open_):
            at = self.at[slot]
            same = (self.keys[slot] == keys[open_]).all(axis=1) & (at >= 0)
            found[open_[same]] = at[same]
            on = ~same & (at >= 0)
            open_, slot = open_[on], (slot[on] + 1) & (SLOTS - 1)
        return found

    def add(self, keys: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        """Distinct new pieces with the numbers of their ids, and all these ids in a row."""
        n, first = len(keys), self.count
        while first + n > len(self.starts):
            self.starts, self.sizes = (np.concatenate([a, np.zeros_like(a)]) for a in (self.starts, self.sizes))
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.starts[first : first + n] = self.used + np.cumsum(sizes) - sizes
        self.sizes[first : first + n] = sizes
        self.ids[self.used : self.used + len(ids)] = ids
        self.count, self.used = first + n, self.used + len(ids)
        left, slot = np.arange(n), slots(keys)
        while len(left):
            free = self.at[slot] < 0
            self.at[slot[free]] = first + left[free]  # of several for one slot the last stays
            won = self.at[slot] == first + left
            self.keys[slot[won]] = keys[left[won]]
            left, slot = left[~won], (slot[~won] + 1) & (SLOTS - 1)

    def gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the pieces in a row, and the number of ids of each."""
        sizes = self.sizes[numbers].astype(np.int64)
        ends = np.cumsum(sizes)
        shift = np.repeat(self.starts[numbers] - (ends - sizes), sizes)
        return self.ids[shift + np.arange(len(shift))], sizes


def cuts(data: np.ndarray) -> np.ndarray:
    """Whether a piece may begin at each byte, from plain characters around it alone."""
    before = np.roll(data, 1)
    printing = (data > 32) & (data < 127)
    accent = before == 0xC3  # the second byte of a Latin-1 letter (or of the two signs below)
    tail = printing | accent
    head = printing | (data == 0xC3)
    letter = ((data | 32) >= 97) & ((data | 32) <= 122) | (data >= 48) & (data <= 57) | accent & (data != 0x97) & (data != 0xB7)
    tail_before, head_after = np.roll(tail, 1), np.roll(head, -1)
    gap = ((data == 32) | (data == 10)) & tail_before & head_after
    line = np.roll(gap & (data == 10), 1)
    stop = ((data == 46) | (data == 44)) & np.roll(letter, 1)
    out = gap | line | stop
    out[:1] = True
    return out


class PieceEncoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        size = max(vocabulary.values()) + 1
        self.dtype = np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")
        self.lengths = np.zeros(size, np.int64)
        for token, i in vocabulary.items():
            self.lengths[i] = len(token)  # a byte-level token has one character for each byte
        self.cut = self.is_plain_byte_level(path)
        self.memory = _Memory(self.dtype)

    @staticmethod
    def is_plain_byte_level(path: str) -> bool:
        """Whether texts may be cut: byte-level pieces by the usual pattern, nothing done to the text before."""
        with open(path, encoding="utf-8") as file:
            parts = json.load(file)
        pre = parts.get("pre_tokenizer") or {}
        added = [t for t in parts.get("added_tokens", ()) if t.get("lstrip") or t.get("rstrip") or t.get("single_word") or set(t["content"]) & set(" \n.,")]
        return pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not parts.get("normalizer") and not added

    def whole(self, text: bytes) -> np.ndarray:
        return np.array(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids, self.dtype)

    def learn(self, pieces: list[bytes], joinable: list[bool], keys: np.ndarray) -> None:
        """Encode new pieces: those that follow a space in one text, the others each for itself."""
        run = [i for i, ok in enumerate(joinable) if ok]
        rest = [i for i, ok in enumerate(joinable) if not ok]
        for order, texts in ((run, [b"".join([pieces[i] for i in run])]), (rest, [pieces[i] for i in rest])):
            if not order:
                continue
            found = self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)
            if order is run:
                ids = np.array(found[0].ids, self.dtype)
                ends = np.cumsum([len(pieces[i]) for i in run])
                cut = np.searchsorted(np.cumsum(self.lengths[ids]), ends, side="left") + 1
                sizes = np.diff(cut, prepend=0)
            else:
                sizes = np.array([len(f.ids) for f in found])
                ids = np.concatenate([np.array(f.ids, self.dtype) for f in found])
            self.memory.add(keys[order], sizes, ids)

    def group(self, texts: Sequence[bytes]) -> Iterator[np.ndarray]:
        """Ids of texts that are not empty and together no longer than GROUP_BYTES."""
        joined = b"".join(texts)
        data = np.frombuffer(joined, np.uint8)
        ends = np.cumsum([len(t) for t in texts])
        begin = cuts(data)
        begin[ends[:-1]] = True
        starts = np.flatnonzero(begin)
        stops = np.append(starts[1:], len(data))
        keys = piece_keys(joined, starts, stops)
        if self.memory.count > SLOTS // 2:
            self.memory.clear()
        numbers = self.memory.find(keys)
        new = np.flatnonzero(numbers < 0)
        if len(new):
            order = new[np.lexsort((keys[new, 1], keys[new, 0]))]
            first = np.sort(order[np.append(True, (keys[order[1:]] != keys[order[:-1]]).any(axis=1))])
            a, b = starts[first], stops[first]
            plain = (data[a] == 32) & (b - a > 1) & (data[np.minimum(a + 1, len(data) - 1)] > 32) & (data[b - 1] > 32) & (data[b - 1] < 127)
            pieces = [joined[x:y] for x, y in zip(a.tolist(), b.tolist())]
            safe = [ok and b"<|" not in p for ok, p in zip(plain.tolist(), pieces)]
            self.learn(pieces, safe, keys[first])
            numbers[new] = self.memory.find(keys[new])
        ids, sizes = self.memory.gather(numbers)
        total = np.concatenate([[0], np.cumsum(sizes)])
        before = 0
        for stop in total[np.searchsorted(starts, ends)].tolist():
            yield ids[before:stop]
            before = stop

    def encode(self, texts: Iterable[bytes]) -> Iterator[np.ndarray]:
        """The ids of each text, in order."""
        group: list[bytes] = []
        size = 0
        for text in chain(texts, [None]):
            long = text is not None and (not self.cut or len(text) > GROUP_BYTES // 2 or not text)
            if group and (text is None or long or size + len(text) > GROUP_BYTES):
                yield from self.group(group)
                group, size = [], 0
            if long:
                yield self.whole(text) if text else np.empty(0, self.dtype)
            elif text is not None:
                group.append(text)
                size += len(text)
