"""Ids of many whole texts at once by the tokenizers library, each distinct word asked for once.

The pattern has boundaries that depend on the characters around them only, such as a single space between two words.
The words between them are found and told apart on arrays, a block of texts at once: by 64-bit ids, with a second id of
other bits to confirm them. The library sees a word when a worker meets it first. Texts that hold a special token or
white space beyond ASCII go to the library one by one.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

from tomoloom.llm.common import span_ids, text_blocks, worker_cache

#: Distinct pieces and words that a worker remembers; then it starts anew.
REMEMBERED = 700_000
#: Bytes of text that are split at once.
BLOCK = 4 << 20
#: Longer words are not remembered.
LONG = 96
SPACE = 32

_LETTER, _MARK, _WHITE, _OTHER = 1, 2, 3, 0
#: What a byte below 128 is; digits, apostrophes and bytes above are others.
_KIND = np.array(
    [
        _OTHER if b >= 128 or chr(b).isdigit() or chr(b) == "'"
        else _LETTER if chr(b).isalpha() else _WHITE if chr(b).isspace() else _MARK
        for b in range(256)
    ],
    np.int8,
)
#: Second bytes that make a letter after 0xC3.
_WESTERN = np.array([0x80 <= b < 0xC0 and chr(b + 0x40).isalpha() for b in range(256)])
_OTHER_BITS = np.uint8(0xA5)
# White space beyond ASCII.
_WIDE_SPACE = "\u0085   -     　"


class TextEncoder:
    """Ids of one text by the tokenizers library: split by the pattern, each distinct piece handed to the model once."""

    def __init__(self, name: str):
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer, pre_tokenizers

        tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
        self.size = tokenizer.get_vocab_size()
        self.special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        self.whole, self.model = tokenizer, tokenizer.model
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        # The byte-level alphabet, asked of the library byte by byte.
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {}
        # Every byte that UTF-8 uses occurs in one of these characters.
        for point in (*range(0x800), *range(0x800, 0xD800, 0x40), *range(0xE000, 0x110000, 0x1000)):
            for raw, shown in zip(chr(point).encode(), level.pre_tokenize_str(chr(point))[0][0]):
                self.letters[raw] = shown
        self.pieces: dict[str, bytes] = {}

    def piece(self, piece: str) -> bytes:
        found = self.pieces.get(piece)
        if found is None:
            if len(self.pieces) >= REMEMBERED:
                self.pieces.clear()
            letters = self.letters
            shown = "".join([letters[b] for b in piece.encode()])
            found = np.array([t.id for t in self.model.tokenize(shown)], "<u4").tobytes()
            self.pieces[piece] = found
        return found

    def split(self, text: str) -> bytes:
        return b"".join([self.piece(p) for p in self.pattern.findall(text)])

    def encode(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return self.split(text)


class BlockEncoder:
    def __init__(self, name: str):
        self.single = TextEncoder(name)
        self.size = self.single.size
        special = "|".join(re.escape(s) for s in self.single.special)
        self.unusual = f"[{_WIDE_SPACE}]" + (f"|{special}" if special else "")
        self.known: dict[int, tuple[int, bytes]] = {}

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a batch's texts, null as empty, one after the other, and the offsets of its texts in them."""
        column = pc.fill_null(column, "")
        unusual = pc.match_substring_regex(column, self.unusual).to_numpy(zero_copy_only=False)
        parts, counts = [], []
        for row, offsets, data in text_blocks(column, BLOCK):
            odd = unusual[row : row + len(offsets) - 1]
            ids, count = self._block(data, offsets)
            for k in np.flatnonzero(odd):
                at = int(count[:k].sum())
                text = data[offsets[k] : offsets[k + 1]].tobytes().decode()
                own = np.frombuffer(self.single.encode(text), "<u4")
                ids = np.concatenate([ids[:at], own, ids[at + count[k] :]])
                count[k] = len(own)
            parts.append(ids)
            counts.append(count)
        total = np.concatenate([[0], *counts]).astype(np.int64).cumsum()
        return np.concatenate([np.zeros(0, np.uint32), *parts]), total

    def _block(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a run of texts and each text's number of ids."""
        texts = len(offsets) - 1
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(texts, np.int64)
        start = self._starts(data, offsets)
        length = np.diff(np.append(start, len(data)))
        key, check = span_ids(data, start, length), span_ids(data ^ _OTHER_BITS, start, length)
        which, distinct = pd.factorize(key)
        first = np.empty(len(distinct), np.int64)
        first[which[::-1]] = np.arange(len(start) - 1, -1, -1)
        if not np.array_equal(check[first][which], check):
            return self._one_by_one(data, offsets)
        ids = self._words(data, distinct, check[first], start[first], length[first])
        size = np.array([len(i) for i in ids], np.int64) // 4
        pool = np.frombuffer(b"".join(ids), "<u4")
        begin = np.cumsum(size) - size
        size, begin = size[which], begin[which]
        end = np.cumsum(size)
        out = pool[np.arange(end[-1]) + np.repeat(begin - (end - size), size)]
        owner = np.searchsorted(offsets, start, "right") - 1
        return out, np.bincount(owner, size, texts).astype(np.int64)

    @staticmethod
    def _starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Places where the pattern has a boundary and the matches on both sides do not depend on the other side.

        Between letters and marks other than an apostrophe; before a single white space between two other characters,
        and behind it if it is no blank, which belongs to what follows.
        """
        kind = _KIND[data]
        letter = kind == _LETTER
        letter[1:] |= (data[:-1] == 0xC3) & _WESTERN[data[1:]]
        mark, white = kind == _MARK, kind == _WHITE
        cut = np.zeros(len(data), bool)
        starts = kind == _LETTER
        starts[:-1] |= (data[:-1] == 0xC3) & _WESTERN[data[1:]]
        cut[1:] = (letter[:-1] & mark[1:]) | (mark[:-1] & starts[1:])
        single = white.copy()
        single[0] = single[-1] = False
        single[1:-1] &= ~white[:-2] & ~white[2:]
        # A text's first and last white space have nothing to separate.
        edges = offsets[(offsets > 0) & (offsets < len(data))]
        single[edges - 1] = False
        single[edges] = False
        cut |= single
        cut[1:] |= single[:-1] & (data[:-1] != SPACE)
        cut[edges] = True
        cut[0] = True
        return np.flatnonzero(cut)

    def _one_by_one(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ids = [self.single.encode(data[a:b].tobytes().decode()) for a, b in zip(offsets, offsets[1:])]
        return np.frombuffer(b"".join(ids), "<u4"), np.array([len(i) // 4 for i in ids], np.int64)

    def _words(self, data, key, check, start, length) -> list[bytes]:
        """The ids of distinct words."""
        known, split = self.known, self.single.split
        if len(known) > REMEMBERED:
            known.clear()
        out = []
        for k, c, at, n in zip(key.tolist(), check.tolist(), start.tolist(), length.tolist()):
            found = known.get(k)
            if found is None or found[0] != c:
                found = c, split(data[at : at + n].tobytes().decode())
                if n <= LONG:
                    known[k] = found
            out.append(found[1])
        return out


def block_encoder(name: str) -> BlockEncoder:
    """Once per worker."""
    kept, key = worker_cache(), ("blocks", name)
    if key not in kept:
        kept[key] = BlockEncoder(name)
    return kept[key]
