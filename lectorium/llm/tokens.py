"""Token ids by the tokenizers library, with a bounded cache of words. A full cache keeps the words that were used again.

Byte-level BPE never merges across the boundaries that its splitting pattern sets, and that pattern always sets one before
a space or line feed that follows a character other than white space. So a text may be cut there, each piece's ids
looked up or computed by the tokenizers library, and the ids joined: the result is the library's for the whole text.
A text where some white space is followed by a space or line feed, or that has a special token's string in it, is encoded
whole instead. The pattern also sets a boundary between a letter or digit and marks such as a full stop, so a word is
looked up without the marks at its end, and these apart from it: a word is computed once whatever follows it. Arrow finds
the different words of a slice, so each is looked up once a slice.
"""

from __future__ import annotations

import os
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import kept_one

CACHE = 800_000
BATCH = 2_000
# White space of the splitting pattern, and control characters that Python counts as white space.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x20\x85\xa0                　"
# The splitting pattern sets a boundary between letters or digits and such marks. Letters here are some of those that it knows.
MARKS = ".,!?;:&%$#*"
BEFORE_MARKS = "[A-Za-z0-9\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]$"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class _Known(dict):
    """Numbers of words; a new word gets the next one and is noted in fresh."""

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        self.fresh.append(word)
        return number


class Encoder:
    """encode(texts) gives ids and their offsets; words' ids are kept in a table that is thinned when it is full."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        self.begins = np.zeros(max(vocabulary.values()) + 1, bool)
        self.begins[[i for t, i in vocabulary.items() if t[:1] in ("\u0120", "\u010a")]] = True  # a space, a line feed
        self._clear()

    def _clear(self) -> None:
        self.known = _Known()
        self.starts, self.sizes, self.uses = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32)
        self.arena, self.used = np.zeros(1 << 18, np.uint32), 0

    def _thin(self) -> None:
        """Drop words that were used once, or all where that leaves more than half of the table."""
        keep = np.flatnonzero(self.uses[: len(self.known)] > 1)
        if len(keep) > CACHE // 2:
            self._clear()
            return
        words, sizes, starts, arena = list(self.known), self.sizes[keep], self.starts[keep], self.arena
        self._clear()
        ends = np.cumsum(sizes, dtype=np.int64)
        ids = arena[np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]
        for i in keep.tolist():
            self.known[words[i]]
        self.known.fresh = []
        self._store(np.arange(len(keep)), ids, sizes)

    def _ids(self, pieces: list[str]) -> list[list[int]]:
        return [e.ids for a in range(0, len(pieces), BATCH) for e in self.tokenizer.encode_batch_fast(pieces[a : a + BATCH], add_special_tokens=False)]

    def whole(self, text: str) -> bool:
        """Whether a text can't be cut before every space and line feed."""
        if "\0" in text or any(s in text for s in self.special):
            return True
        return any(c in text and (c + " " in text or c + "\n" in text) for c in SPACES)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and where each text's begin, with the end."""
        if len(self.known) > CACHE:
            self._thin()
        some = self.whole("".join(texts))  # of most slices no text is, and one search says so
        direct = [at for at, text in enumerate(texts) if some and self.whole(text)]
        own = self._ids([texts[at] for at in direct])
        rest = list(texts)
        for at in direct:
            rest[at] = ""
        # what comes before the first cut has no space to give back: it goes by a key of its own
        mark, nothing = pa.scalar("\0", pa.large_string()), pa.scalar("", pa.large_string())
        marked = pc.binary_join_element_wise(mark, pc.replace_substring(pa.array(rest, pa.large_string()), "\n", " \n"), nothing)
        lists = pc.split_pattern(marked, " ")
        words = lists.flatten().dictionary_encode()
        at = words.indices.to_numpy()
        # a word is looked up once a slice, and its ids are put side by side
        number = self._numbers(words.dictionary)
        np.add.at(self.uses, number, np.bincount(at, minlength=len(number) // 2).astype(np.int32).repeat(2))
        own_ids, ends = self._gathered(self.arena, self.starts[number], self.sizes[number])
        ends = np.r_[0, ends[1::2]]
        joined, ends = self._gathered(own_ids, ends[:-1][at], np.diff(ends)[at])
        bounds = np.r_[0, ends][lists.offsets.to_numpy()]
        if not direct:
            return joined, bounds
        parts, begin = [], 0
        for at, ids in zip(direct, own, strict=True):
            parts += [joined[begin : bounds[at]], np.array(ids, np.uint32)]
            begin = bounds[at]
        longer = np.zeros(len(texts), np.int64)
        longer[direct] = [len(ids) for ids in own]
        return np.concatenate([*parts, joined[begin:]]), bounds + np.r_[0, np.cumsum(longer)]

    @staticmethod
    def _gathered(ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The stretches of ids one after the other, and where each ends."""
        ends = np.cumsum(sizes, dtype=np.int64)
        return ids[np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)], ends

    def _numbers(self, words: pa.Array) -> np.ndarray:
        """Two numbers a word: of the word without the marks at its end, where a letter or digit is before them, and of the marks, or else of nothing."""
        stems = pc.ascii_rtrim(words, characters=MARKS)
        shorter = np.flatnonzero(pc.less(pc.binary_length(stems), pc.binary_length(words)).to_numpy(zero_copy_only=False))
        stems = stems.take(pa.array(shorter))
        parted = pc.match_substring_regex(stems, BEFORE_MARKS).to_numpy(zero_copy_only=False)
        shorter, stems = shorter[parted], stems.filter(pa.array(parted))
        keys, known = words.to_numpy(zero_copy_only=False), self.known
        number = np.full((len(keys), 2), known["\0"], np.int64)
        number[shorter, 1] = [known["\0" + word[n:]] for word, n in zip(keys[shorter], pc.utf8_length(stems).to_pylist(), strict=True)]
        keys[shorter] = stems.to_numpy(zero_copy_only=False)
        number[:, 0] = np.fromiter(map(known.__getitem__, keys), np.int64, len(keys))
        if known.fresh:
            self._add_keys(known.fresh, len(known) - len(known.fresh))
            known.fresh = []
        return number.ravel()

    def _add_keys(self, keys: list[str], first: int) -> None:
        """Compute new words, numbered from first, most of them side by side in longer texts: each begins a token there."""
        plain = [i for i, k in enumerate(keys) if k and k[0] != "\0" and not k[-1].isspace() and k[-1] not in SPACES]
        rest = sorted(set(range(len(keys))).difference(plain))
        for a in range(0, len(plain), BATCH):
            some = plain[a : a + BATCH]
            texts = [self._whole_word(keys[i]) for i in some]
            ids = np.array(self._ids(["".join(texts)])[0], np.uint32)
            starts = np.flatnonzero(self.begins[ids])
            if len(starts) == len(some) and starts[0] == 0:
                self._store(first + np.array(some), ids, np.diff(np.r_[starts, len(ids)]))
            else:
                rest += some
        for a in range(0, len(rest), BATCH):
            some = rest[a : a + BATCH]
            ids = self._ids([self._whole_word(keys[i]) for i in some])
            sizes = np.fromiter(map(len, ids), np.int32, len(ids))
            self._store(first + np.array(some), np.fromiter(chain.from_iterable(ids), np.uint32, int(sizes.sum())), sizes)

    @staticmethod
    def _whole_word(key: str) -> str:
        """The text that a key stands for: a mark is no part of it, and a space was cut from the others but those that begin with a line feed."""
        return key[1:] if key[:1] == "\0" else key if key[:1] == "\n" else " " + key

    def _store(self, numbers: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        total, most = len(ids), int(numbers[-1]) + 1 if len(numbers) else 0
        while self.used + total > len(self.arena):
            self.arena = np.concatenate([self.arena, np.zeros_like(self.arena)])
        while max(most, len(self.known)) > len(self.starts):
            self.starts, self.sizes, self.uses = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.sizes, self.uses))
        self.arena[self.used : self.used + total] = ids
        self.starts[numbers] = self.used + np.cumsum(sizes) - sizes
        self.sizes[numbers] = sizes
        self.used += total


def encoder(path: str) -> Encoder:
    """One for each Python worker and file."""
    return kept_one(("tokens", path), lambda: Encoder(path))
