"""Token ids of whole Arrow batches, by the tokenizers library, with a cache of pieces.

A byte-level BPE splits a text before it merges bytes. Some splits are certain from the neighbouring bytes alone: at a
single space or newline between two visible characters, and where a Latin letter meets ASCII punctuation other than
an apostrophe. Texts are cut there, and a piece's ids depend on the piece only, so each distinct piece is encoded
once per worker and batches are put together from a table. Pieces are named by a 64-bit hash.
"""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np
import pyarrow as pa

from tarnspark.llm.kernels import RUN_BYTES, Run, runs

#: Pieces that a worker keeps; beyond that it starts afresh. A power of two.
SLOTS = 1 << 21
SPECIAL = b"<|endoftext|>"

_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_POINT = np.zeros(256, dtype=bool)
_POINT[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_POINT[ord("'")] = False
_VISIBLE = np.zeros(256, dtype=bool)
_VISIBLE[33:127] = True


@lru_cache(maxsize=4)
def _tokenizer(path: str, plain: bool):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.encode_special_tokens = plain
    return found


@lru_cache(maxsize=1)
def _byte_letters() -> dict[int, str]:
    """The printable stand-ins that byte-level vocabularies use for bytes."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Encoder:
    """``encode`` turns a run of texts into one flat id array and the texts' bounds in it."""

    def __init__(self, path: str, plain: bool) -> None:
        self.tokenizer = _tokenizer(path, plain)
        self.plain = plain
        self.model = self.tokenizer.model
        self.dtype = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.reset()

    def reset(self) -> None:
        self.known = np.zeros(SLOTS, dtype=np.uint64)
        self.entry = np.zeros(SLOTS, dtype=np.int32)
        self.flat = np.zeros(1 << 20, dtype=self.dtype)
        self.ends = np.zeros(1 << 18, dtype=np.int64)  # entry e is flat[ends[e] : ends[e + 1]]
        self.used = 0

    def _add(self, pieces: list[list[int]]) -> None:
        sizes = np.array([len(p) for p in pieces], dtype=np.int64)
        top = int(self.ends[self.used])
        while self.used + len(pieces) + 1 > len(self.ends):
            self.ends = np.concatenate((self.ends, np.zeros_like(self.ends)))
        while top + sizes.sum() > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        self.ends[self.used + 1 : self.used + 1 + len(pieces)] = top + np.cumsum(sizes)
        if sizes.sum():
            self.flat[top : top + int(sizes.sum())] = np.fromiter((i for p in pieces for i in p), self.dtype, int(sizes.sum()))
        self.used += len(pieces)

    def _encode_piece(self, piece: bytes) -> list[int]:
        text = piece.decode()
        if (text[1:] if text[0] == " " else text).isalpha():  # one unit of the splitter
            return [t.id for t in self.model.tokenize(piece.decode("latin-1").translate(_byte_letters()))]
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _cuts(self, run: Run) -> np.ndarray:
        """Positions in the run where a piece starts."""
        data, n = run.data, len(run.data)
        letter, shown = _LETTER[data], _VISIBLE[data]
        lead = (data >= 0xC3) & (data <= 0xC5)  # Latin letters of two bytes, but for U+00D7 and U+00F7
        lead[:-1] &= ~((data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7)))
        shown |= lead
        last = np.zeros(n, dtype=bool)  # last byte of a Latin letter
        last[1:] = lead[:-1]
        ends_shown = _VISIBLE[data] | last
        cut = np.zeros(n + 1, dtype=bool)
        if n > 2:
            around = ends_shown[:-2] & shown[2:]
            cut[1 : n - 1] |= around & ((data[1:-1] == 32) | (data[1:-1] == 10))
            cut[2:n] |= around & (data[1:-1] == 10)
        if n > 1:
            cut[1:n] |= (letter[:-1] | last[:-1]) & _POINT[data[1:]]
        # Near a text's edge the neighbours belong to another text: keep only its own start there.
        for edge in (run.bounds[1:-1] - 1, run.bounds[1:-1], run.bounds[1:-1] + 1):
            cut[edge[(edge >= 0) & (edge <= n)]] = False
        cut[run.bounds] = True
        return np.flatnonzero(cut[:n])

    def encode(self, run: Run) -> tuple[np.ndarray, np.ndarray]:
        if not len(run.data):
            return np.zeros(0, self.dtype), np.zeros(run.n + 1, np.int64)
        if not self.plain and SPECIAL in run.data.tobytes():
            ids = [self.tokenizer.encode(run.text(i).decode(), add_special_tokens=False).ids for i in range(run.n)]
            return np.array([x for i in ids for x in i], self.dtype), np.concatenate(([0], np.cumsum([len(i) for i in ids])))
        if self.used > SLOTS // 2:
            self.reset()
        starts = self._cuts(run)
        ends = np.append(starts[1:], len(run.data))
        names = run.hashes(starts, ends, lower=False) | np.uint64(1)
        mask = np.uint64(SLOTS - 1)
        one, two = ((names >> np.uint64(8)) & mask).astype(np.int64), ((names >> np.uint64(36)) & mask).astype(np.int64)
        hit_one, hit_two = self.known[one] == names, self.known[two] == names
        entry = np.where(hit_one, self.entry[one], self.entry[two])
        missed = np.flatnonzero(~(hit_one | hit_two))
        if len(missed):
            new, first, back = np.unique(names[missed], return_index=True, return_inverse=True)
            at = missed[first]
            raw = run.data.tobytes()
            base = self.used
            self._add([self._encode_piece(raw[a:b]) for a, b in zip(starts[at].tolist(), ends[at].tolist())])
            entry[missed] = base + back
            slot = np.where(self.known[one[at]] == 0, one[at], two[at])
            self.known[slot], self.entry[slot] = new, base + np.arange(len(new))
        begin, size = self.ends[entry], self.ends[entry + 1] - self.ends[entry]
        total = np.concatenate(([0], np.cumsum(size)))
        flat = self.flat[np.repeat(begin - total[:-1], size) + np.arange(total[-1])]
        return flat, total[np.searchsorted(starts, run.bounds)]


@lru_cache(maxsize=4)
def encoder(path: str, plain: bool = False) -> Encoder:
    """This worker's encoder; with ``plain`` the special tokens' strings are ordinary text."""
    return Encoder(path, plain)


def encoded(texts: pa.Array, path: str, plain: bool = False, end: int | None = None):
    """For each run of texts: the position of its first text, its ids with ``end`` after each text, and the bounds."""
    made = encoder(path, plain)
    for at, run in runs(texts, RUN_BYTES):
        flat, bounds = made.encode(run)
        if end is not None:
            flat = np.insert(flat, bounds[1:], end)
            bounds = bounds + np.arange(run.n + 1)
        yield at, flat, bounds
