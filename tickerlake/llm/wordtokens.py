"""Token ids of whole texts by way of distinct white-space-free chunks.

The word tokenizer drops white space and never joins across it, so a text's ids are those of its chunks, one after
the other.  Marks behind a plain word are a chunk of their own.  A worker keeps the chunks that it has met in a bounded
table and hands only new ones to the library.
"""

from __future__ import annotations

import functools
import itertools
import os
import re

import numpy as np

from tickerlake.llm import common
from tickerlake.llm.distinct import Words, segments

VOCABULARY = "word_bpe_49k.json"
END = 1
#: Bytes that are white space for the tokenizer; other white space stays inside chunks, where the library sees it.
BLANKS = b" \t\n\r\f\v"
#: Words that need no normalizing but lower case: ASCII and Latin-1 letters.
PLAIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+")


def among(members: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(members)] = True
    return out


#: ASCII letters; the second bytes of Latin-1 letters, which follow LEAD; ASCII marks without the apostrophe.
UPPER, LOWER = among(bytes(range(65, 91))), among(bytes(range(97, 123)))
LEAD, SECOND = 0xC3, among(bytes(x for x in range(0x80, 0xC0) if x not in (0x97, 0xB7)))
MARK, BLANK = among(bytes(x for x in range(33, 127) if not chr(x).isalnum() and chr(x) != "'")), among(BLANKS)


def parted(data: bytes) -> tuple[bytes, np.ndarray]:
    """The data with a blank between a plain word and the marks behind it, which the tokenizer never joins, and with
    ASCII letters of plain words in lower case; and where blanks have been put in.  Data end with a blank.

    Only chunks of letters, marks or letters and then marks are changed.
    """
    buffer = np.frombuffer(data, dtype=np.uint8)
    upper, mark, blank = UPPER[buffer], MARK[buffer], BLANK[buffer]
    letter = upper | LOWER[buffer]
    lead = np.flatnonzero(buffer == LEAD)
    lead = lead[SECOND[buffer[lead + 1]]]
    letter[lead] = letter[lead + 1] = True
    blanks = np.flatnonzero(blank)
    other = np.zeros(len(blanks), dtype=bool)  # chunks, by the blank behind them, that stay as they are
    for at in (~(letter | mark | blank), mark[:-1] & letter[1:]):
        other[np.searchsorted(blanks, np.flatnonzero(at))] = True
    marks, capitals = np.flatnonzero(letter[:-1] & mark[1:]) + 1, np.flatnonzero(upper)
    marks, capitals = (at[~other[np.searchsorted(blanks, at)]] for at in (marks, capitals))
    lower = buffer.copy()
    lower[capitals] |= 0x20
    return np.insert(lower, marks, BLANKS[0]).tobytes(), marks


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Pool:
    """Rows of ids of different lengths by code; rows put again are given up with all behind them."""

    def __init__(self):
        self.values = np.empty(1 << 20, dtype=np.int32)
        self.start, self.size = np.empty(1 << 16, dtype=np.int64), np.empty(1 << 16, dtype=np.int32)

    def put(self, rows: list[list[int]], first: int) -> None:
        sizes = np.fromiter(map(len, rows), dtype=np.int32, count=len(rows))
        total, behind = int(sizes.sum()), first + len(rows)
        used = int(self.start[first - 1] + self.size[first - 1]) if first else 0
        while used + total > len(self.values):
            self.values = np.concatenate([self.values, np.empty_like(self.values)])
        while behind > len(self.start):
            self.start, self.size = np.concatenate([self.start, np.empty_like(self.start)]), np.concatenate([self.size, np.empty_like(self.size)])
        self.values[used : used + total] = list(itertools.chain.from_iterable(rows))
        self.start[first:behind] = used + np.cumsum(sizes) - sizes
        self.size[first:behind] = sizes

    def take(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all codes, how many each has)."""
        sizes = self.size[codes]
        return self.values[np.repeat(self.start[codes], sizes) + common.ragged(sizes)], sizes


class Chunks:
    """ids(texts) of the library's encode(text, add_special_tokens=False), computed once for each distinct chunk."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        self.tokenize = self.library.model.tokenize
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        spelled = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.spell = {c: spelled.pre_tokenize_str(chr(c))[0][0] for c in range(0xC0, 0x100)}
        self.pool = Pool()
        self.words = Words(BLANKS, self.learn)

    def learn(self, chunks: list[bytes], first: int) -> None:
        rows = []
        tokenize, plain, spell = self.tokenize, PLAIN.fullmatch, self.spell
        for chunk in b" ".join(chunks).decode().split(" "):
            if plain(chunk):
                word = chunk.lower()
                rows.append([t.id for t in tokenize(word if word.isascii() else word.translate(spell))])
            else:
                rows.append(self.library.encode(chunk, add_special_tokens=False).ids)
        self.pool.put(rows, first)

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """int32 ids of every text."""
        out: list[list[np.ndarray]] = [[] for _ in texts]
        plain = [b"" if any(s in t for s in self.special) else t.encode() for t in texts]
        for owners, data in segments(plain, BLANKS):
            behind = np.cumsum([len(plain[i]) + 1 for i in owners]) if len(owners) > 1 else np.array([len(data)])
            data, added = parted(data)
            codes, starts = self.words.codes(data)
            ids, sizes = self.pool.take(codes)
            behind = behind + np.searchsorted(added, behind)
            cuts = np.concatenate([[0], np.cumsum(sizes)])[np.searchsorted(starts, behind)]
            for i, a, b in zip(owners, [0, *cuts[:-1].tolist()], cuts.tolist()):
                out[i].append(ids[a:b])
        for i, t in enumerate(texts):
            if any(s in t for s in self.special):
                out[i] = [np.array(self.library.encode(t, add_special_tokens=False).ids, dtype=np.int32)]
        return [p[0] if len(p) == 1 else np.concatenate(p) if p else np.empty(0, np.int32) for p in out]


@functools.cache
def worker_chunks(path: str) -> Chunks:
    """The table of this worker; it outlives a task."""
    return Chunks(path)
