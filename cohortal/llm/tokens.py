"""Encoding of whole texts with the tokenizers library, a batch at a time.

No token of the vocabularies used here reaches across white space, but for one
space in front of a word that the byte-level vocabulary keeps. So texts are cut
there with Arrow, a batch's distinct pieces are encoded by the library once, and
a document's ids are those of its pieces, joined. Texts in which white space is
unusual, or that hold the content of an added token, are encoded whole. Either way
the ids equal ``Tokenizer.encode(text, add_special_tokens=False)``; tests compare both.
"""

from __future__ import annotations

import functools
import itertools
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from cohortal.llm.shared import whole_texts

#: Pieces a worker remembers before its memo starts anew, and text bytes cut at a time.
MEMO_PIECES = 800_000
BLOCK_BYTES = 6_000_000
#: Where the byte-level vocabulary's pattern does not simply cut in front of a space and around a line end.
_UNUSUAL = r"  |\n\n| \n|[\t\x0b\x0c\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_CUT = "\x1f"
#: ASCII punctuation but the apostrophe, of which the patterns make words with letters.
_MARKS = r"[!-&(-/:-@\[-`{-~]"
#: Latin letters up to _LATIN_END, without the dotted capital I, which is two characters in lower case.
_LETTER = r"[A-Za-z\x{aa}\x{b5}\x{ba}\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{12f}\x{131}-\x{24f}]"
_LATIN_END = "\u024f"


def vocabulary_path(name: str) -> str:
    """Where a public vocabulary file lies (on the driver and on each executor alike)."""
    import public_tokenizers

    return public_tokenizers.path(name)


def ragged(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The indices starts[0]..starts[0]+lens[0]-1, starts[1].., joined."""
    ends = np.cumsum(lens)
    return np.repeat(starts - ends + lens, lens) + np.arange(ends[-1] if len(ends) else 0)


class Encoder:
    """Ids of whole texts. keeps_space: the vocabulary's tokens may begin with a space."""

    def __init__(self, path: str, keeps_space: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tok = Tokenizer.from_file(path)
        #: Where a text holds an added token in letters of either case, or nothing that any text holds.
        self._added = "|".join(re.escape(t.content) for t in self._tok.get_added_tokens_decoder().values()) or r"[^\s\S]"
        self._keeps_space = keeps_space
        self._model = self._tok.model
        self._latin = rf"^(?P<word>{' ?' if keeps_space else ''}{_LETTER}+)(?P<marks>{_MARKS}*)$"
        self._suffix = functools.cache(lambda marks: self._tok.encode(marks, add_special_tokens=False).ids)
        from tokenizers.pre_tokenizers import ByteLevel

        show = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        #: How the library shows each byte: those of non-ASCII Latin letters, and a space in front of a word.
        self._shown = np.arange(256, dtype="<u4")
        for c in map(chr, range(0x80, ord(_LATIN_END) + 1)):
            self._shown[list(c.encode())] = [ord(x) for x in show(c)[0][0]]
        self._shown[0x20] = ord(show(" ")[0][0])
        self._reset()

    def _reset(self) -> None:
        self._memo: dict[str, int] = {}
        self._pool = np.empty(1 << 16, np.uint32)
        self._starts = np.zeros(1 << 12, np.int64)
        self._lens = np.zeros(1 << 12, np.int64)
        self._used = self._known = 0

    def _words(self, pieces: pa.Array) -> tuple[np.ndarray, list[list[int]]]:
        """Places and ids of the Latin words with punctuation behind them, by the library's model alone.

        Such a piece is one or two words to the pattern, and normal form leaves it as it is.
        """
        cut = pc.extract_regex(pieces, self._latin)
        places = np.flatnonzero(cut.is_valid().to_numpy(zero_copy_only=False))
        if not len(places):
            return places, []
        word, marks = cut.take(pa.array(places)).flatten()
        # One string of all words: a call for all of them instead of some for each.
        shown = "\n".join(word.to_numpy(zero_copy_only=False))
        if not self._keeps_space:
            shown = shown.lower()
        shown = self._shown[np.frombuffer(shown.encode(), np.uint8)].tobytes().decode("utf-32-le")
        tokenize = self._model.tokenize
        got = [[t.id for t in tokenize(w)] for w in shown.split("\n")]
        for i in np.flatnonzero(pc.binary_length(marks).to_numpy()):
            got[i] += self._suffix(marks[i].as_py())
        return places, got

    def _learn(self, pieces: pa.Array) -> None:
        names = pieces.to_numpy(zero_copy_only=False).tolist()
        got: list = [None] * len(names)
        for i, ids in zip(*self._words(pieces)):
            got[i] = ids
        rest = [i for i, ids in enumerate(got) if ids is None]
        for i, enc in zip(rest, self._tok.encode_batch_fast([names[i] for i in rest], add_special_tokens=False)):
            got[i] = enc.ids
        lens = np.fromiter(map(len, got), np.int64, len(got))
        ids = np.fromiter(itertools.chain.from_iterable(got), np.uint32, int(lens.sum()))
        end, known = self._used + len(ids), self._known + len(got)
        if end > len(self._pool):
            self._pool = np.concatenate([self._pool[: self._used], np.empty(end, np.uint32)])
        if known > len(self._lens):
            self._starts = np.concatenate([self._starts[: self._known], np.zeros(known, np.int64)])
            self._lens = np.concatenate([self._lens[: self._known], np.zeros(known, np.int64)])
        self._pool[self._used : end] = ids
        self._lens[self._known : known] = lens
        self._starts[self._known : known] = self._used + np.cumsum(lens) - lens
        self._memo.update(zip(names, range(self._known, known)))
        self._used, self._known = end, known

    def _block(self, texts: pa.Array) -> Iterator[np.ndarray]:
        whole = {}
        odd = pc.match_substring_regex(texts, self._added, ignore_case=True)
        if self._keeps_space:
            odd = pc.or_(odd, pc.match_substring_regex(texts, _UNUSUAL))
        for i in np.flatnonzero(odd.to_numpy(zero_copy_only=False)):
            whole[i] = np.array(self._tok.encode(texts[i].as_py(), add_special_tokens=False).ids, np.uint32)
        if whole:
            texts = pc.if_else(odd, "", texts)
        if self._keeps_space:
            texts = pc.replace_substring(pc.replace_substring(texts, " ", _CUT + " "), "\n", _CUT + "\n" + _CUT)
            lists = pc.split_pattern(texts, _CUT)
        else:
            # This vocabulary drops white space and case; a Latin letter and punctuation are never one token.
            # Other letters may end in a mark in normal form or lower case, which is one with punctuation.
            texts = pc.ascii_lower(pc.replace_substring(texts, "\n", " "))
            lists = pc.split_pattern(pc.replace_substring_regex(texts, f"({_LETTER})([,.])", r"\1 \2"), " ")
        coded = lists.flatten().dictionary_encode()
        if len(self._memo) > MEMO_PIECES:
            self._reset()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False)
        index = np.fromiter(map(self._memo.get, distinct, itertools.repeat(-1)), np.int64, len(distinct))
        new = np.flatnonzero(index < 0)
        if len(new):
            index[new] = np.arange(self._known, self._known + len(new))
            self._learn(coded.dictionary.take(pa.array(new)))
        at = index[coded.indices.to_numpy()]
        n = self._lens[at]
        ids = self._pool[ragged(self._starts[at], n)]
        ends = np.concatenate([[0], np.cumsum(n)])[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
        for i in range(len(lists)):
            yield whole[i] if i in whole else ids[ends[i] : ends[i + 1]]

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text, in order, as unsigned 32-bit integers; null counts as empty."""
        size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy())
        begin = 0
        while begin < len(texts):
            done = size[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(size, done + BLOCK_BYTES, "right")))
            yield from self._block(whole_texts(texts[begin:end]))
            begin = end


@functools.cache
def encoder(path: str, keeps_space: bool) -> Encoder:
    """One encoder for each worker process and vocabulary."""
    return Encoder(path, keeps_space)


def crc32_ids(ids: np.ndarray) -> int:
    """Unsigned crc32 of the ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").tobytes())
