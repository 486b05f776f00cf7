"""Distinct words of a batch of texts, found with array operations on their UTF-8 bytes.

Words are runs of bytes between given blank bytes.  Each gets two 64-bit hashes (a polynomial of spread byte values
over prefix sums); a worker's table keeps one entry for each distinct word it has met, and a caller's function is
called for new words only.  Both hashes must agree, so that mixing up two words is out of practical reach.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Callable

import numpy as np

from tickerlake.llm import common

STEP = 0x5851F42D4C957F2D, 0xD1342543DE82EF95
SEGMENT = 1 << 19
MOST_WORDS = 300_000


@functools.cache
def _powers(n: int, which: int) -> tuple[np.ndarray, np.ndarray]:
    def line(p: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, p, np.uint64)]))

    return line(STEP[which]), line(pow(STEP[which], -1, 1 << 64))


@functools.cache
def _spread(which: int) -> np.ndarray:
    return common.mix(np.arange(256) + 1000 * (which + 1))


def split(buffer: np.ndarray, blank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that are not blank."""
    word = ~blank[buffer]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], word, [False]]).view(np.int8)))
    return edge[::2], edge[1::2]


def hashes(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int) -> np.ndarray:
    size = SEGMENT
    while size <= len(buffer):
        size *= 2
    up, down = _powers(size, which)
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_spread(which)[buffer] * up[: len(buffer)], dtype=np.uint64)])
        return common.mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


class Words:
    """A worker's table of distinct words; ``learn(words, code)`` gets new words (bytes) whose codes count up from ``code``.

    A full table is kept as it is: the words of common texts come early.  Further words are learned for one call
    only, under codes behind the table's that the next call uses again.
    """

    def __init__(self, blanks: bytes, learn: Callable[[list[bytes], int], None], most: int = MOST_WORDS):
        self.blank = np.zeros(256, dtype=bool)
        self.blank[list(blanks)] = True
        self.learn, self.most = learn, most
        self.code: dict[int, int] = {}
        self.second = np.empty(1 << 16, dtype=np.uint64)

    def codes(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(code, start) of every word in its place, valid until the next call.  Data are texts with a blank between."""
        buffer = np.frombuffer(data, dtype=np.uint8)
        starts, ends = split(buffer, self.blank)
        if not len(starts):
            return np.empty(0, np.int64), starts
        first, second = (hashes(buffer, starts, ends, k) for k in (0, 1))
        seen, one, back = np.unique(first, return_index=True, return_inverse=True)
        keys, n = seen.tolist(), len(self.code)
        codes = np.fromiter(map(self.code.get, keys, itertools.repeat(-1)), dtype=np.int64, count=len(keys))
        new = np.flatnonzero(codes < 0)
        if len(new):
            at = one[new]
            self.learn([data[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist())], n)
            while n + len(new) > len(self.second):
                self.second = np.concatenate([self.second, np.empty_like(self.second)])
            self.second[n : n + len(new)] = second[at]
            codes[new] = np.arange(n, n + len(new))
            room = max(self.most - n, 0)
            self.code.update(zip([keys[i] for i in new[:room].tolist()], range(n, n + room)))
        codes = codes[back]
        if (self.second[codes] != second).any():
            raise ValueError("two words with one hash")
        return codes, starts


def segments(texts: list[bytes], blanks: bytes, most: int = SEGMENT) -> list[tuple[list[int], bytes]]:
    """The texts joined to buffers of about ``most`` bytes, with the index of each text in a buffer and a blank behind it.

    A longer text is cut at blanks, so that it may fill several buffers; a run without blanks stays whole.
    """
    out: list[tuple[list[int], bytes]] = []
    held: list[tuple[int, bytes]] = []
    size, blank = 0, blanks[:1]

    def close() -> None:
        nonlocal held, size
        if held:
            out.append(([i for i, _ in held], blank.join([t for _, t in held] + [b""])))
        held, size = [], 0

    for i, text in enumerate(texts):
        while len(text) > most:
            close()
            cut = max(text.rfind(bytes([b]), 0, most) for b in blanks)
            if cut <= 0:
                cut = min((p for b in blanks if (p := text.find(bytes([b]), most)) >= 0), default=len(text))
            out.append(([i], text[:cut] + blank))
            text = text[cut:]
        if size + len(text) > most:
            close()
        held.append((i, text))
        size += len(text) + 1
    close()
    return out
