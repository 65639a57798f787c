"""Language identification by rank-order profiles of character n-grams (out-of-place distance)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .arrowmap import map_slices

#: Most frequent n-grams (of 1 to 3 letters, words padded by blanks) of a language's and of a document's profile.
LANGUAGE_GRAMS, DOCUMENT_GRAMS = 400, 300
#: Documents of a language, about, that its profile is learned from: those of least hashed ids.
FIT_DOCS = 4000
UNKNOWN = "und"
_HASHED = 1 << 24
#: Characters whose n-grams are counted at once.
_PART = 1_000_000
_BLANK = 32
_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    if not _LETTERS:
        _LETTERS.append(np.array([chr(i).isalpha() for i in range(0x110000)]))
    return _LETTERS[0]


def _stream(text: str) -> np.ndarray:
    """Code points of the lower-cased text with every run of non-letters as one blank, and a blank at each end."""
    codes = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "replace"), np.uint32)
    letter = _letters()[codes]
    keep = letter.copy()
    keep[0] = True
    keep[1:] |= letter[:-1]
    return np.where(letter, codes, _BLANK)[keep].astype(np.int64)


def _grams(s: np.ndarray) -> np.ndarray:
    """Packed n-grams of a stream, 21 bits a code point; blanks only at the ends of a gram, and not alone."""
    one = s[s != _BLANK]
    two = (s[:-1] << 21) | s[1:]
    three = (s[:-2] << 42) | (s[1:-1] << 21) | s[2:]
    return np.concatenate([one, two, three[s[1:-1] != _BLANK]])


def held_out(modulus: int, rest: int) -> Column:
    """Whether crc32 of the id as text leaves ``rest``; false for a null id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == rest, F.lit(False))


def learn(labelled: DataFrame, grams: int = LANGUAGE_GRAMS, fit_docs: int = FIT_DOCS) -> dict[str, list[int]]:
    """Per language its n-grams by falling frequency, from rows (doc_id, text, lang) without nulls in text and lang."""
    sizes = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("rows"))
    picked = labelled.join(F.broadcast(sizes), "lang").where(F.pmod(F.xxhash64(F.lit("fit"), "doc_id", "text"), F.lit(_HASHED)) < F.lit(_HASHED * fit_docs) / F.col("rows"))

    def make():
        def work(part):
            names, found = part.column("lang").to_pylist(), {}
            for name, text in zip(names, part.column("text").to_pylist(), strict=True):
                found.setdefault(name, []).append(_grams(_stream(text)))
            lang, gram, count = [], [], []
            for name, parts in found.items():
                g, n = np.unique(np.concatenate(parts), return_counts=True)
                lang += [name] * len(g)
                gram.append(g)
                count.append(n)
            flat = lambda x: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64())
            return {"lang": lang, "gram": flat(gram), "n": flat(count)}

        return work

    counted = map_slices(picked.select("lang", "text"), "text", make, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    top = counted.withColumn("place", place).where(F.col("place") <= grams).orderBy("lang", "place").collect()
    profiles: dict[str, list[int]] = {}
    for r in top:
        profiles.setdefault(r["lang"], []).append(r["gram"])
    return profiles


def document_grams(text: str, most: int = DOCUMENT_GRAMS) -> np.ndarray:
    """The text's ``most`` most frequent n-grams, the most frequent first, ties by gram; long texts are counted part by part."""
    s = _stream(text)
    if len(s) < 2:
        return np.zeros(0, np.int64)
    grams, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for i in range(0, len(s), _PART):
        # Parts share two characters; grams that lie in those alone are counted with the part before.
        own = s[max(0, i - 2) : i + _PART]
        new = _grams(own)
        if i:
            again = _grams(own[:2])
        g, n = np.unique(new, return_counts=True)
        if i:
            n = n - np.bincount(np.searchsorted(g, again), minlength=len(g))
        if len(grams):
            every = np.concatenate([grams, g])
            grams, back = np.unique(every, return_inverse=True)
            counts = np.bincount(back, weights=np.concatenate([counts, n]), minlength=len(grams)).astype(np.int64)
        else:
            grams, counts = g, n
    if len(grams) > 4 * most:
        # Those below the most-th count can't rank.
        least = np.partition(counts, len(counts) - most)[len(counts) - most]
        grams, counts = grams[counts >= least], counts[counts >= least]
    return grams[np.lexsort((grams, -counts))][:most]


class Ranker:
    """Profiles as arrays: a document's own most frequent n-grams are looked up in each; one that a profile lacks costs its whole length."""

    def __init__(self, profiles: dict[str, list[int]], size: int = LANGUAGE_GRAMS):
        self.names = sorted(profiles)
        self.size = size
        self.known = np.array(sorted({g for p in profiles.values() for g in p}), np.int64)
        self.rank = np.full((len(self.names), len(self.known)), -1, np.int64)
        for i, name in enumerate(self.names):
            self.rank[i, np.searchsorted(self.known, profiles[name])] = np.arange(len(profiles[name]))

    def predict(self, text: str | None) -> tuple[str, float]:
        """The nearest language and the margin to the second as a share; UNKNOWN and 0 without letters."""
        own = document_grams(text) if text else np.zeros(0, np.int64)
        if not len(own) or not self.names:
            return UNKNOWN, 0.0
        at = np.minimum(np.searchsorted(self.known, own), len(self.known) - 1)
        rank = np.where(self.known[at] == own, self.rank[:, at], -1)
        distance = np.where(rank < 0, self.size, np.abs(rank - np.arange(len(own)))).sum(1)
        best = int(np.argmin(distance))
        if len(self.names) == 1:
            return self.names[0], 1.0 - float(distance[0]) / (self.size * len(own))
        second = float(np.partition(distance, 1)[1])
        return self.names[best], (second - float(distance[best])) / second if second else 0.0


def predict(documents: DataFrame, profiles: dict[str, list[int]]) -> DataFrame:
    """doc_id, lang_pred, score of every row of ``documents``."""

    def make():
        ranker = Ranker(profiles)

        def work(part):
            got = [ranker.predict(t) for t in part.column("text").to_pylist()]
            return {"doc_id": part.column("doc_id"), "lang_pred": [g[0] for g in got], "score": [g[1] for g in got]}

        return work

    return map_slices(documents.select("doc_id", "text"), "text", make, "doc_id long, lang_pred string, score double")


def identify(documents: DataFrame) -> DataFrame:
    """One row per row of ``documents`` (doc_id, text, lang): held_out, lang_pred, score.

    Profiles are learned from rows with text and lang whose id's crc32 modulo 4 is
    not 2. A null text, or one without a letter, is 'und' with score 0, and so is
    everything where nothing can be learned. Ties in distance go to the language
    first by name, ties in frequency to the lesser n-gram. Repeated rows keep a row
    each; an empty table gives an empty result; other columns are ignored.
    """
    labelled = documents.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out(4, 2)).select("doc_id", "text", "lang")
    found = predict(documents, learn(labelled))
    return found.select("doc_id", held_out(4, 2).alias("held_out"), "lang_pred", "score")


__all__ = ["held_out", "learn", "Ranker", "predict", "identify"]
