"""Token ids of whole texts, from a tokenizers file, remembered word by word."""

from __future__ import annotations

import re
from functools import cache
from itertools import chain

import numpy as np
from tokenizers import Tokenizer

#: Distinct pieces a worker remembers; later ones are forgotten after the texts that hold them.
CACHE_PIECES = 600_000
#: Slots of the table of pieces.
SLOTS = 1 << 21
#: Unknown pieces that are encoded as one text.
JOINED = 200
#: Pieces up to this length are looked up by their bytes in vectors, longer ones in a dict.
SHORT = 24

#: White space that a tokenizer may take into account beyond the ASCII kinds.
_WIDE_SPACE = re.compile("[\x1c-\x1f\x85\xa0 ᠎ -‍    　﻿]")
#: All ASCII white space as spaces.
_EVEN = bytes.maketrans(b"\t\n\v\f\r", b"     ")
#: A single space between two characters that aren't white space: always the start of a new pre-token.
_SAFE_CUT = re.compile(r"(?<=\S)(?= \S)")
#: The first n bytes of a little-endian 64-bit word.
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def vocabulary(name: str) -> str:
    """Path of a public tokenizer's file on this machine; operators take any such path."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Encodes texts with a tokenizers file; equal to encoding each text whole.

    Texts are cut where the tokenizer cuts them anyway, and each distinct piece is encoded once while it is remembered.
    With `spaced` false the tokenizer drops white space, so pieces are the runs of other characters. With `spaced`
    true a space belongs to the word after it; a piece starts at a single space between two characters that aren't
    white space, and texts with wide white space or runs of white space are cut only where both neighbours of a single
    space surely aren't white space. `plain` takes the strings of special tokens in a text as ordinary text.
    """

    def __init__(self, path: str, spaced: bool, plain: bool = False):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        self.spaced = spaced
        # A space between pieces changes nothing, unless a special token takes or holds white space.
        self.joins = not spaced and not any(
            t.lstrip or t.rstrip or any(map(str.isspace, t.content)) for t in self.tokenizer.get_added_tokens_decoder().values())
        self.reset()

    def reset(self) -> None:
        self.n = self.used = 0
        self.starts, self.lengths = np.empty(1 << 16, np.int64), np.empty(1 << 16, np.int64)
        self.keys = np.zeros((4, 1 << 16), np.uint64)
        self.flat = np.empty(1 << 18, np.uint32)
        self.slots = np.full(SLOTS, -1, np.int32)
        self.long: dict[str, int] = {}

    def forget(self) -> None:
        """Go back to the first CACHE_PIECES pieces."""
        if self.n <= CACHE_PIECES:
            return
        # Later pieces only took slots that were free before, so earlier ones are still found.
        self.slots[self.slots >= CACHE_PIECES] = -1
        self.long = {k: n for k, n in self.long.items() if n < CACHE_PIECES}
        self.n = CACHE_PIECES
        self.used = int(self.starts[CACHE_PIECES - 1] + self.lengths[CACHE_PIECES - 1])

    def learn(self, pieces: list[str]) -> int:
        """Encode and remember distinct pieces; the number of the first."""
        first = self.n
        for at in range(0, len(pieces), 20_000):
            part = pieces[at : at + 20_000]
            found, lengths = self._joined(part) if self.joins else self._single(part)
            total = int(lengths.sum())
            while self.n + len(part) > len(self.starts):
                self.starts, self.lengths = np.resize(self.starts, 2 * len(self.starts)), np.resize(self.lengths, 2 * len(self.lengths))
                self.keys = np.concatenate((self.keys, np.zeros_like(self.keys)), axis=1)
            while self.used + total > len(self.flat):
                self.flat = np.resize(self.flat, 2 * len(self.flat))
            here = slice(self.n, self.n + len(part))
            self.lengths[here] = lengths
            self.starts[here] = self.used + np.cumsum(lengths) - lengths
            self.flat[self.used : self.used + total] = np.fromiter(chain.from_iterable(found), np.uint32, total)
            self.used += total
            self.n += len(part)
        return first

    def _single(self, pieces: list[str]) -> tuple[list[list[int]], np.ndarray]:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        return found, np.fromiter(map(len, found), np.int64, len(found))

    def _joined(self, pieces: list[str]) -> tuple[list[list[int]], np.ndarray]:
        """Ids in runs, and their number for each piece: texts of many pieces are encoded, and a token belongs to the piece it starts in."""
        runs = [pieces[at : at + JOINED] for at in range(0, len(pieces), JOINED)]
        found, counts = [], []
        for run, e in zip(runs, self.tokenizer.encode_batch(list(map(" ".join, runs)), add_special_tokens=False)):
            firsts = np.cumsum([0, *(len(x) + 1 for x in run)])
            begins = np.fromiter((a for a, _ in e.offsets), np.int64, len(e))
            counts.append(np.diff(np.searchsorted(begins, firsts)))
            found.append(e.ids)
        return found, np.concatenate(counts)

    def _long(self, pieces: list[str]) -> list[int]:
        fresh = [x for x in dict.fromkeys(pieces) if x not in self.long]
        if fresh:
            first = self.learn(fresh)
            self.long.update(zip(fresh, range(first, first + len(fresh))))
        return list(map(self.long.__getitem__, pieces))

    def _seek(self, keys: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Numbers of pieces by their keys, -1 for unknown ones."""
        out = np.full(len(hashes), -1, np.int64)
        open_ = np.arange(len(hashes))
        slot = (hashes & np.uint64(SLOTS - 1)).astype(np.int64)
        while len(open_):
            number = self.slots[slot]
            there = number >= 0
            open_, slot, number = open_[there], slot[there], number[there]
            same = np.ones(len(open_), bool)
            for mine, known in zip(keys, self.keys):
                same &= mine[open_] == known[number]
            out[open_[same]] = number[same]
            open_, slot = open_[~same], (slot[~same] + 1) & (SLOTS - 1)
        return out

    def _put(self, keys: np.ndarray, hashes: np.ndarray, first: int) -> None:
        numbers = np.arange(first, first + len(hashes))
        self.keys[:, first : first + len(hashes)] = keys
        slot = (hashes & np.uint64(SLOTS - 1)).astype(np.int64)
        while len(numbers):
            free = self.slots[slot] < 0
            _, one = np.unique(slot[free], return_index=True)
            at = np.flatnonzero(free)[one]
            self.slots[slot[at]] = numbers[at]
            rest = np.ones(len(numbers), bool)
            rest[at] = False
            numbers, slot = numbers[rest], (slot[rest] + 1) & (SLOTS - 1)

    def _numbers(self, text: bytes, begin: np.ndarray, length: np.ndarray, leads: np.ndarray) -> np.ndarray:
        """Numbers of the pieces of a text at given places; `leads` marks those without a space before them."""
        out = np.empty(len(begin), np.int64)
        short = length <= SHORT
        if not short.all():
            far = np.flatnonzero(~short)
            out[far] = self._long([self._piece(text[begin[k] : begin[k] + length[k]], leads[k]) for k in far])
            begin, length, leads = begin[short], length[short], leads[short]
        words = np.ndarray((len(text) + 17,), "<u8", text + bytes(SHORT), strides=(1,))
        keys = np.empty((4, len(begin)), np.uint64)
        for j in range(3):
            keys[j] = words[begin + 8 * j] & _MASKS[np.clip(length - 8 * j, 0, 8)]
        keys[3] = length + 64 * leads
        hashes = keys[0] * np.uint64(0x9E3779B97F4A7C15)
        for j, factor in ((1, 0xC2B2AE3D27D4EB4F), (2, 0x165667B19E3779F9), (3, 0x27D4EB2F165667C5)):
            hashes = (hashes ^ hashes >> np.uint64(31) ^ keys[j]) * np.uint64(factor)
        hashes ^= hashes >> np.uint64(32)
        found = self._seek(keys, hashes)
        while True:
            gone = np.flatnonzero(found < 0)
            if not len(gone):
                break
            _, one = np.unique(hashes[gone], return_index=True)
            new = gone[one]
            first = self.learn([self._piece(text[begin[k] : begin[k] + length[k]], leads[k]) for k in new.tolist()])
            self._put(keys[:, new], hashes[new], first)
            found[gone] = self._seek(keys[:, gone], hashes[gone])
        out[short] = found
        return out

    def _piece(self, word: bytes, lead: bool) -> str:
        return word.decode() if lead or not self.spaced else " " + word.decode()

    def _uneven(self, text: bytes, even: bytes) -> bool:
        return bool(even) and (b"  " in even or even[0] == 32 or even[-1] == 32 or not text.isascii() and _WIDE_SPACE.search(text.decode()) is not None)

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one after another, and the number of ids of each text."""
        self.forget()
        even = [x.translate(_EVEN) for x in texts]
        odd = {k for k, x in enumerate(texts) if self._uneven(x, even[k])} if self.spaced else set()
        plain = [b"" if k in odd else x for k, x in enumerate(texts)] if self.spaced else even
        # All texts with a space after each; a piece lies between two spaces.
        whole = b" ".join([*plain, b""])
        ends = np.flatnonzero(np.frombuffer(whole, np.uint8) == 32)
        begin = np.concatenate(([0], ends[:-1] + 1)) if len(ends) else ends
        length = ends - begin
        firsts = np.cumsum([0, *(len(x) + 1 for x in plain)])
        leads = np.zeros(len(begin), bool)
        leads[np.searchsorted(begin, firsts[:-1])] = True
        keep = length > 0
        begin, length, leads = begin[keep], length[keep], leads[keep] & self.spaced
        index = self._numbers(whole, begin, length, leads)
        counts = np.diff(np.searchsorted(begin, firsts))
        if odd:
            parts = np.split(index, np.cumsum(counts)[:-1])
            for k in odd:
                parts[k] = np.array(self._long(_SAFE_CUT.split(texts[k].decode())), np.int64)
            index, counts = np.concatenate(parts), np.array(list(map(len, parts)))
        lengths = self.lengths[index]
        stops = np.cumsum(lengths)
        total = int(stops[-1]) if len(stops) else 0
        places = np.repeat(self.starts[index] - (stops - lengths), lengths)
        places += np.arange(total)
        sums = np.concatenate(([0], stops))
        at = np.concatenate(([0], np.cumsum(counts)))
        return self.flat[places], sums[at[1:]] - sums[at[:-1]]


@cache
def encoder(path: str, spaced: bool, plain: bool = False) -> Encoder:
    """The encoder of this worker process, with what it remembers from earlier tasks."""
    return Encoder(path, spaced, plain)
