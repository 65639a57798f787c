"""Byte-level BPE of the tokenizers library for many texts at once, each distinct piece of a worker's texts encoded once."""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .segments import Store, flat, pieces

#: Distinct pieces that a worker keeps; about 180 bytes each.
CACHE_PIECES = 1_000_000
_ENCODERS: dict[tuple[str, bool], ByteLevelEncoder] = {}


_LETTER, _DIGIT, _MARK, _SPACE, _WHITE, _OTHER = 1, 2, 3, 4, 5, 0
_CLASS = np.zeros(256, np.uint8)
_CLASS[33:127] = _MARK
_CLASS[48:58] = _DIGIT
_CLASS[65:91] = _CLASS[97:123] = _LETTER
_CLASS[32] = _SPACE
_CLASS[9:14] = _WHITE


def token_starts(data: np.ndarray) -> np.ndarray:
    """Bytes at which the byte-level pre-tokenizer surely starts a token, whatever stands around; letters beyond Latin-1 and all other signs start none.

    Runs of letters, of digits and of marks are tokens of their own, with one
    space before them. Nothing is cut behind an apostrophe (contractions) and
    inside runs of white space, of which the end depends on what follows.
    """
    kind = _CLASS[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)
    lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]
    kind[lead] = kind[lead + 1] = _LETTER
    word = (kind >= _LETTER) & (kind <= _MARK)
    out = np.zeros(len(data), bool)
    before, here = kind[:-1], kind[1:]
    # Out of a run: into another kind of run or into white space.
    out[1:] = word[:-1] & (here != _OTHER) & (here != before)
    out[1:] &= (data[:-1] != 39) | (here >= _SPACE)
    # Behind a single line end or tab.
    out[2:] |= word[:-2] & (kind[1:-1] == _WHITE) & word[2:]
    return out


class ByteLevelEncoder:
    """Byte-level BPE of the tokenizers library (``add_special_tokens=False``).

    Texts are cut where the library's pre-tokenizer cuts them for sure; each
    distinct piece is encoded once by the library, which cuts it again. Texts that
    hold a special token's string go through it as a whole; with ``literal`` that
    string is text like any other, and no text gives a special id.
    """

    def __init__(self, path: str, literal: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.encode_special_tokens = literal
        self.special = [t.content for t in self.lib.get_added_tokens_decoder().values() if not (literal and t.special)]
        self.pieces = Store(CACHE_PIECES)

    def _whole(self, text: str) -> bytes:
        return np.array(self.lib.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _encode_pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces as they stand; words with a space before them many at a time, as one text that splits into just them."""
        got: dict[str, bytes] = {}
        spaced = [p for p in pieces if p[0] == " " and p[1:].isalpha()]
        alone = [p for p in pieces if p[0] != " " or not p[1:].isalpha()]
        for i in range(0, len(spaced), 2000):
            part = spaced[i : i + 2000]
            e = self.lib.encode("".join(part), add_special_tokens=False)
            words = np.array(e.word_ids)
            if words[-1] != len(part) - 1:
                alone += part
                continue
            at = np.searchsorted(words, np.arange(len(part) + 1)).tolist()
            ids = np.array(e.ids, "<u4").tobytes()
            got.update(zip(part, [ids[4 * a : 4 * b] for a, b in zip(at, at[1:])], strict=True))
        for i in range(0, len(alone), 4096):
            part = alone[i : i + 4096]
            got.update(zip(part, [np.array(e.ids, "<u4").tobytes() for e in self.lib.encode_batch_fast(part, add_special_tokens=False)], strict=True))
        return [got[p] for p in pieces]

    def encode_flat(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all ``texts`` one after another, ``end_id`` after each if given, and the bounds of each text's, one more than texts."""
        store = self.pieces
        if store.n > store.limit:
            store.keep(store.often(store.limit // 2))
        whole: dict[int, str] = {}
        for s in self.special:
            for i in np.flatnonzero(pc.match_substring(texts, s).to_numpy(zero_copy_only=False)).tolist():
                whole[i] = texts[i].as_py()
        if whole:
            odd = np.zeros(len(texts), bool)
            odd[list(whole)] = True
            texts = pc.if_else(pa.array(odd), "", texts)
        data, bounds = flat(texts)
        names, codes, bounds = pieces(data, bounds, token_starts(data) if len(data) > 2 else np.zeros(len(data), bool))
        rows = list(map(store.row.get, names))
        if None in rows:
            new = [k for k, r in zip(names, rows, strict=True) if r is None]
            first = store.add(self._encode_pieces(new))
            store.row.update(zip(new, range(first, first + len(new)), strict=True))
            rows = list(map(store.row.get, names))
        row_of = np.array(rows, np.int64)
        store.asked[row_of] += np.bincount(codes, minlength=len(names))
        rows, n = row_of[codes], store.n
        if whole:
            first = store.add([self._whole(whole[i]) for i in sorted(whole)])
            # Such a text has no pieces so far.
            own = np.array(sorted(whole))
            rows = np.insert(rows, bounds[own], np.arange(first, first + len(own)))
            bounds = bounds + np.searchsorted(own, np.arange(len(bounds)))
        if end_id is not None:
            rows = np.insert(rows, bounds[1:], store.add([np.array([end_id], "<u4").tobytes()]))
            bounds = bounds + np.arange(len(bounds))
        ids, ends = store.gather(rows)
        store.drop(n)
        return ids, np.concatenate([[0], ends])[bounds]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        ids, bounds = self.encode_flat(pa.array(texts, pa.string()))
        data = ids.astype("<u4").tobytes()
        return [data[4 * a : 4 * b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


def byte_level(path: str, literal: bool = False) -> ByteLevelEncoder:
    """The worker's encoder for the vocabulary file at ``path``."""
    if (path, literal) not in _ENCODERS:
        _ENCODERS[path, literal] = ByteLevelEncoder(path, literal)
    return _ENCODERS[path, literal]
