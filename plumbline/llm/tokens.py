"""Token ids of whole texts by a public tokenizer file, piece by piece with a memory of pieces."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

#: Spark runs one task per core; the library's own threads would compete with them.
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Ends a piece; texts that hold it are not cut.
CUT = "\0"
#: Texts with two white-space characters in a row, or with the mark of a cut, are not cut.
UNCUT = r"\x00|[\t-\r\x1c-\x20\x{85}\p{Z}]{2}"
#: Letters in every version of Unicode that a pattern may know.
LETTERS = r"A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}\x{391}-\x{3a1}\x{3a3}-\x{3ce}\x{400}-\x{481}"
#: Between a letter and an ASCII mark is a border of tokens in every pattern used here.
LETTER_MARK = rf"([{LETTERS}])([!-/:-@\[-`{{-~])"
#: Pieces remembered, characters of text and pieces worked on at once; all bound memory and change speed only.
KEEP, CHARS, TOGETHER = 400_000, 3_500_000, 4_000


def _texts(column: pa.Array) -> list[str]:
    return column.to_numpy(zero_copy_only=False).tolist()


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit bytes.

    Both tokenizer files used here split a text before merging, and never across a single space or line feed between two
    other characters: one keeps the space with the word after it (``leading``) and a line feed alone, one drops both. So a
    text is the concatenation of its pieces, and a piece that was met before needs no new work. Texts with runs of white
    space go to the tokenizer whole, as do texts that hold the content of an added token, such as <|endoftext|>: those get
    its id, which is the library's default.

    Texts are cut, and equal pieces found, column by column; Python meets each different piece of a slice once.
    """

    def __init__(self, path: str, leading: bool, keep: int = KEEP) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.added = re.compile("|".join(re.escape(token.content) for token in added) or r"(?!)")
        # Some files look for added tokens in the normalized text.
        self.normalizer = self.tokenizer.normalizer if any(token.normalized for token in added) else None
        self.leading, self.keep = leading, keep
        # Pieces are numbered as they are met: their ids lie in ``ids``, one after the other.
        self.known: dict[str, int] = {}
        self.ids, self.starts = np.zeros(0, dtype="<u4"), np.zeros(1, dtype=np.int64)
        # Slices of text that a piece was met in, halved whenever pieces are forgotten.
        self.met = np.zeros(0, dtype=np.int32)
        self.word = rf"^ [{LETTERS}]+$" if leading else rf"^[{LETTERS}]+$"
        vocabulary = self.tokenizer.get_vocab()
        # Ids that can only begin a word after a space, or only end a word.
        self.border = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.border[[i for t, i in vocabulary.items() if (t[0] == "\u0120" if leading else t.endswith("</w>"))]] = True

    def _alone(self, texts: list[str]) -> list[np.ndarray]:
        found = []
        for at in range(0, len(texts), TOGETHER):
            for encoded in self.tokenizer.encode_batch_fast(texts[at : at + TOGETHER], add_special_tokens=False):
                found.append(np.array(encoded.ids, dtype="<u4"))
        return found

    def _words(self, words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids and lengths of words, many at a time: the first (or last) id of a word shows its border."""
        for at in range(0, len(words), TOGETHER):
            group = words[at : at + TOGETHER]
            joined = ("" if self.leading else " ").join(group)
            (encoded,) = self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)
            whole = np.array(encoded.ids, dtype="<u4")
            borders = np.flatnonzero(self.border[whole])
            if len(borders) == len(group):
                yield whole, np.diff(borders, append=len(whole)) if self.leading else np.diff(borders, prepend=-1)
            else:
                # Every word has a border at least; here one has more, so they are taken one by one.
                found = self._alone(group)
                yield np.concatenate(found), np.array([len(ids) for ids in found])

    def _uncut(self, texts: list[str], column: pa.Array) -> np.ndarray:
        uncut = pc.match_substring_regex(column, UNCUT).to_numpy(zero_copy_only=False)
        for at in np.flatnonzero(~uncut):
            text = texts[at]
            uncut[at] = self.added.search(text) or (
                self.normalizer and self.added.search(self.normalizer.normalize_str(text))
            )
        return uncut

    def _pieces(self, column: pa.Array) -> pa.Array:
        """The pieces of every text, as lists."""
        space, line = (CUT + " ", CUT + "\n" + CUT) if self.leading else (CUT, CUT)
        column = pc.replace_substring(pc.replace_substring(column, " ", space), "\n", line)
        return pc.split_pattern(pc.replace_substring_regex(column, LETTER_MARK, rf"\1{CUT}\2"), CUT)

    def _forget(self) -> None:
        """Keeps the half of the pieces that were met in most slices."""
        stay = np.sort(np.argsort(-self.met, kind="stable")[: self.keep // 2])
        pieces = list(self.known)
        self.known = {pieces[old]: new for new, old in enumerate(stay.tolist())}
        self.ids, lengths = self._gather(stay)
        self.starts = np.concatenate([[0], np.cumsum(lengths)])
        self.met = self.met[stay] >> 1

    def _learn(self, pieces: pa.Array) -> np.ndarray:
        """Remembers new pieces and gives their numbers."""
        plain = pc.match_substring_regex(pieces, self.word)
        words, others = _texts(pieces.filter(plain)), _texts(pieces.filter(pc.invert(plain)))
        found = list(self._words(words))
        alone = self._alone(others)
        lengths = np.concatenate([*[n for _, n in found], np.array([len(ids) for ids in alone], dtype=np.int64)])
        first = len(self.known)
        self.ids = np.concatenate([self.ids, *[ids for ids, _ in found], *alone])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(lengths)])
        self.met = np.concatenate([self.met, np.zeros(len(pieces), dtype=np.int32)])
        self.known.update(zip(words + others, range(first, first + len(pieces))))
        numbers = np.empty(len(pieces), dtype=np.int64)
        plain = plain.to_numpy(zero_copy_only=False)
        numbers[plain] = np.arange(first, first + len(words))
        numbers[~plain] = np.arange(first + len(words), first + len(pieces))
        return numbers

    def _gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the numbered pieces, one after the other, and their lengths."""
        starts = self.starts[numbers]
        lengths = self.starts[numbers + 1] - starts
        before = np.cumsum(lengths) - lengths
        total = int(lengths.sum())
        return self.ids[np.repeat(starts - before, lengths) + np.arange(total)], lengths

    def _slice(self, texts: list[str]) -> Iterator[bytes]:
        column = pa.array(texts, pa.large_string())
        uncut = self._uncut(texts, column)
        whole = iter(self._alone([text for text, odd in zip(texts, uncut) if odd]))
        lists = self._pieces(column.filter(pa.array(~uncut)))
        met = lists.flatten().dictionary_encode()
        pieces = met.dictionary
        if len(self.known) > self.keep:
            self._forget()
        get = self.known.get
        numbers = np.array([get(piece, -1) for piece in _texts(pieces)], dtype=np.int64)
        new = numbers < 0
        if new.any():
            numbers[new] = self._learn(pieces.filter(pa.array(new)))
        self.met[numbers] += 1
        ids, lengths = self._gather(numbers[met.indices.to_numpy()])
        stops = np.concatenate([[0], np.cumsum(lengths)])[lists.offsets.to_numpy()]
        data, cuts = ids.tobytes(), iter((4 * stops).tolist())
        start = next(cuts)
        for odd in uncut:
            if odd:
                yield next(whole).tobytes()
            else:
                stop = next(cuts)
                yield data[start:stop]
                start = stop

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text, in order."""
        at = 0
        while at < len(texts):
            to, chars = at, 0
            while to < len(texts) and (to == at or chars + len(texts[to]) <= CHARS):
                chars += len(texts[to])
                to += 1
            yield from self._slice(texts[at:to])
            at = to


@lru_cache(maxsize=1)
def _kept(path: str, version: tuple[int, int], leading: bool, keep: int) -> Encoder:
    return Encoder(path, leading, keep)


def encoder(path: str, leading: bool, keep: int = KEEP) -> Encoder:
    """The encoder of this process: tasks that follow one another in a Python worker share what it remembers."""
    stat = os.stat(path)
    return _kept(path, (stat.st_mtime_ns, stat.st_size), leading, keep)


def end_mark(end: int) -> bytes:
    return np.array([end], dtype="<u4").tobytes()
