"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE_WORDS`` consecutive words, all of
them, to its end. Each passage is described by shape, repetition and
character-class figures and by its words and pairs of words, hashed to buckets whose
log-odds are learned from the labels; a small network embeds it, a gated attention
weighs it against the document's other passages, and the weighted sum is scored.
Labels are known for documents only; the attention is learned from them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrowmap import map_slices
from .language import held_out
from .storage import stash
from .wordhash import Words, mix

PASSAGE_WORDS = 64
#: Labelled documents that the network is fitted on at most, those of least hashed ids, as long as they have no more passages together; each counts with all its passages.
FIT_DOCS, FIT_PASSAGES = 12_000, 300_000
#: Buckets of hashed words, and as many of pairs; bounds of a bucket's log-odds.
BUCKETS, ODDS = 4096, 3.0
EMBED, GATE, RATE, BATCH = 24, 12, 0.01, 256
#: Rounds over the sample at least, and steps at least.
ROUNDS, STEPS = 20, 800
THRESHOLD = 0.3
_SLICE = 1_000_000

_UPPER, _LOWERC, _DIGIT, _END, _PAIR, _SIGN, _LINE, _HIGH = range(8)
_CLASS = np.zeros((8, 256), np.int32)
_CLASS[_UPPER, 65:91] = 1
_CLASS[_LOWERC, 97:123] = 1
_CLASS[_DIGIT, 48:58] = 1
_CLASS[_END, [ord(c) for c in ".,;:"]] = 1
_CLASS[_PAIR, [ord(c) for c in "!?"]] = 1
_CLASS[_SIGN, [ord(c) for c in "#$%&*|<>{}[]()=+/\\^~_@\"'-"]] = 1
_CLASS[_LINE, 10] = 1
_CLASS[_HIGH, 128:] = 1
FEATURES = 25
LEXICAL = 2


def lexicon(counts: np.ndarray) -> np.ndarray:
    """Log-odds of label 1 by kind (words, pairs) and bucket, from ``counts`` by label, kind and bucket."""
    share = (counts + 1.0) / (counts.sum(2, keepdims=True) + BUCKETS)
    return np.clip(np.log(share[1]) - np.log(share[0]), -ODDS, ODDS)


def passages(texts: list[bytes], odds: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Figures of every passage of ``texts``, the index of each text's first, and of every word its passage and its buckets (word, pair with the next).

    A text without words has one passage of zeros. Without ``odds`` the last
    figures, mean log-odds of a passage's words and pairs, are 0.
    """
    w = Words(texts)
    counts = np.diff(w.first)
    per = np.maximum(1, -(-counts // PASSAGE_WORDS))
    first = np.concatenate([[0], np.cumsum(per)])
    out = np.zeros((first[-1], FEATURES))
    if not len(w.hash):
        return out, first, np.zeros(0, np.int64), np.zeros((2, 0), np.uint16)
    doc = np.repeat(np.arange(len(texts)), counts)
    within = np.arange(len(doc)) - w.first[doc]
    bag = first[doc] + within // PASSAGE_WORDS
    edge = np.concatenate([[True], bag[1:] != bag[:-1]])
    at = np.flatnonzero(edge)
    own = bag[at]  # passages that have words
    n = np.diff(np.append(at, len(bag))).astype(float)
    last = np.append(at[1:], len(bag)) - 1
    a, b = w.start[at], w.end[last]
    size = np.maximum(1.0, (b - a).astype(float))
    length = (w.end - w.start).astype(float)
    total = np.add.reduceat(length, at)
    f = [np.log1p(n) / 4, total / n / 10, np.sqrt(np.maximum(0, np.add.reduceat(length**2, at) / n - (total / n) ** 2)) / 10]
    for k in range(8):
        sums = np.concatenate([[0], np.cumsum(_CLASS[k][w.data], dtype=np.int64)])
        f.append((sums[b] - sums[a]) / size)
        if k in (_UPPER, _PAIR, _SIGN):
            part = sums[w.end] - sums[w.start]
            f.append(np.add.reduceat((part > 0).astype(float), at) / n)
            f.append(np.add.reduceat((part == w.end - w.start).astype(float), at) / n)
    same = np.zeros(len(bag))
    same[1:] = (w.hash[1:] == w.hash[:-1]) & (doc[1:] == doc[:-1])
    f.append(np.add.reduceat(same, at) / n)
    order = np.lexsort((w.hash, bag))
    fresh = np.ones(len(bag))
    fresh[1:] = (w.hash[order][1:] != w.hash[order][:-1]) | (bag[order][1:] != bag[order][:-1])
    f.append(np.add.reduceat(fresh, at) / n)
    # Share of words that the document has had before, anywhere: copied lines and lists far apart.
    order = np.lexsort((np.arange(len(doc)), w.hash, doc))
    again = np.zeros(len(doc))
    again[order[1:]] = (w.hash[order][1:] == w.hash[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    f.append(np.add.reduceat(again, at) / n)
    # Pairs of words that the document has had before tell copied runs from a small vocabulary.
    pair = np.zeros(len(doc), np.uint64)
    pair[:-1] = w.hash[:-1] * np.uint64(3) + w.hash[1:]
    pair[-1] = 1
    order = np.lexsort((np.arange(len(doc)), pair, doc))
    again = np.zeros(len(doc))
    again[order[1:]] = (pair[order][1:] == pair[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    f.append(np.add.reduceat(again, at) / n)
    f.append(np.log1p(counts[doc[at]]) / 8)
    f.append(np.log1p((b - a) / n) / 4)
    after = np.append(w.hash[1:], np.uint64(0))
    lex = np.stack([mix(w.hash) % np.uint64(BUCKETS), mix(w.hash * np.uint64(3) + after) % np.uint64(BUCKETS)]).astype(np.uint16)
    f += [np.zeros(len(at))] * LEXICAL if odds is None else [np.add.reduceat(odds[k][lex[k]], at) / n for k in range(LEXICAL)]
    out[own] = np.stack(f, 1)
    return out, first, bag, lex


class Network:
    """Embedding, gated attention and score; plain arrays, so it travels with a closure."""

    def __init__(self, seed: int = 5):
        r = np.random.Generator(np.random.PCG64(seed))
        g = lambda *s: r.normal(0, 1 / np.sqrt(s[0]), s)
        self.mean, self.scale, self.odds = np.zeros(FEATURES), np.ones(FEATURES), np.zeros((LEXICAL, BUCKETS))
        self.p = {"w": g(FEATURES, EMBED), "wb": np.zeros(EMBED), "v": g(EMBED, GATE), "vb": np.zeros(GATE), "u": g(EMBED, GATE), "ub": np.zeros(GATE), "a": g(GATE, 1)[:, 0], "c": g(EMBED, 1)[:, 0], "cb": np.zeros(1)}

    def forward(self, x: np.ndarray, first: np.ndarray) -> dict:
        p, at = self.p, first[:-1]
        x = np.clip((x - self.mean) / self.scale, -8, 8)
        h = np.tanh(x @ p["w"] + p["wb"])
        t, s = np.tanh(h @ p["v"] + p["vb"]), 1 / (1 + np.exp(-(h @ p["u"] + p["ub"])))
        e = (t * s) @ p["a"]
        n = np.diff(first)
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, at), n))
        attention = e / np.repeat(np.add.reduceat(e, at), n)
        z = np.add.reduceat(attention[:, None] * h, at)
        y = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["cb"], -30, 30)))
        return {"x": x, "h": h, "t": t, "s": s, "n": n, "at": at, "attention": attention, "z": z, "y": y}

    def gradient(self, o: dict, label: np.ndarray) -> dict:
        p, n = self.p, o["n"]
        d = (o["y"] - label) / len(label)
        dz = np.repeat(d[:, None] * p["c"], n, 0)
        da = (dz * o["h"]).sum(1)
        de = o["attention"] * (da - np.repeat(np.add.reduceat(o["attention"] * da, o["at"]), n))
        dts = de[:, None] * p["a"]
        dt, ds = dts * o["s"] * (1 - o["t"] ** 2), dts * o["t"] * o["s"] * (1 - o["s"])
        dh = o["attention"][:, None] * dz + dt @ p["v"].T + ds @ p["u"].T
        dh *= 1 - o["h"] ** 2
        return {"c": o["z"].T @ d, "cb": d.sum(keepdims=True), "a": (o["t"] * o["s"]).T @ de, "v": o["h"].T @ dt, "vb": dt.sum(0), "u": o["h"].T @ ds, "ub": ds.sum(0), "w": o["x"].T @ dh, "wb": dh.sum(0)}

    def fit(self, bags: list[np.ndarray], labels: np.ndarray, rounds: int = ROUNDS, seed: int = 5) -> None:
        every = np.concatenate(bags)
        self.mean, self.scale = every.mean(0), every.std(0) + 1e-3
        r = np.random.Generator(np.random.PCG64(seed))
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        q = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        for _ in range(max(rounds, -(-STEPS // -(-len(bags) // BATCH)))):
            order = r.permutation(len(bags))
            for i in range(0, len(order), BATCH):
                own = order[i : i + BATCH]
                first = np.concatenate([[0], np.cumsum([len(bags[j]) for j in own])])
                grad = self.gradient(self.forward(np.concatenate([bags[j] for j in own]), first), labels[own])
                step += 1
                for k, g in grad.items():
                    g = g + 1e-4 * self.p[k]
                    m[k] = 0.9 * m[k] + 0.1 * g
                    q[k] = 0.999 * q[k] + 0.001 * g * g
                    self.p[k] -= RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(q[k] / (1 - 0.999**step)) + 1e-8)

    def score(self, texts: list[bytes]) -> np.ndarray:
        return self.forward(*passages(texts, self.odds)[:2])["y"]


def train(documents: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS) -> Network | float:
    """A network fitted on labelled documents whose id's crc32 modulo 5 is not 0; the share of label 1 (0.5 of nothing) where only one label occurs."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(5, 0)).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    picked = stash(known.orderBy(F.xxhash64(F.lit("fit"), "doc_id"), "doc_id").limit(fit_docs), "fit")
    texts = documents.select("doc_id", "text").join(F.broadcast(picked), "doc_id")

    def make():
        def work(part):
            x, first, bag, lex = passages([t or b"" for t in part.column("text").cast(pa.binary()).to_pylist()])
            words, ends = np.searchsorted(bag, first).tolist(), first.tolist()
            return {
                "doc_id": part.column("doc_id"), "quality": part.column("quality").cast(pa.int32()), "n": np.diff(first),
                "bag": [x[a:b].astype("<f4").tobytes() for a, b in zip(ends, ends[1:])],
                "size": [np.bincount(bag[a:b] - p, minlength=q - p).astype("u1").tobytes() for a, b, p, q in zip(words, words[1:], ends, ends[1:])],
                "lex": [lex[:, a:b].astype("<u2").tobytes() for a, b in zip(words, words[1:])],
            }

        return work

    found = stash(map_slices(texts, "text", make, "doc_id long, quality int, n long, bag binary, size binary, lex binary", _SLICE), "bags")
    # Sizes alone go through one task, for at most FIT_DOCS ids and their repeated rows.
    key = [F.xxhash64(F.lit("fit"), "doc_id"), F.col("doc_id"), F.xxhash64("bag")]
    sizes = found.select("doc_id", "n", F.xxhash64("bag").alias("b")).distinct().orderBy(F.xxhash64(F.lit("fit"), "doc_id"), "doc_id", "b").limit(fit_docs)
    total = F.sum("n").over(Window.orderBy(F.xxhash64(F.lit("fit"), "doc_id"), "doc_id", "b"))
    chosen = sizes.withColumn("total", total).where((F.col("total") <= FIT_PASSAGES) | (F.col("total") == F.col("n"))).select("doc_id", "b")
    rows = found.withColumn("b", F.xxhash64("bag")).join(F.broadcast(chosen), ["doc_id", "b"], "left_semi").orderBy(*key).limit(fit_docs).collect()
    rows.sort(key=lambda r: (r["doc_id"], r["bag"]))
    label = np.array([r["quality"] for r in rows], float)
    if len(np.unique(label)) < 2:
        return float(label.mean()) if len(label) else 0.5
    network = Network()
    counts = np.zeros((2, LEXICAL, BUCKETS))
    for r in rows:
        for k, x in enumerate(np.frombuffer(r["lex"], "<u2").reshape(LEXICAL, -1)):
            counts[r["quality"], k] += np.bincount(x, minlength=BUCKETS)
    network.odds = lexicon(counts)
    bags = []
    for r in rows:
        x, size = np.frombuffer(r["bag"], "<f4").reshape(-1, FEATURES).copy(), np.frombuffer(r["size"], "u1")
        place = np.repeat(np.arange(len(x)), size)
        for k, b in enumerate(np.frombuffer(r["lex"], "<u2").reshape(LEXICAL, -1)):
            x[:, FEATURES - LEXICAL + k] = np.bincount(place, network.odds[k][b], len(x)) / np.maximum(1, size)
        bags.append(x)
    del rows
    network.fit(bags, label)
    return network


def apply(documents: DataFrame, model: Network | float, keep: list[str], score: str = "_score") -> DataFrame:
    """``keep`` columns of ``documents`` and, as ``score``, that of each row's whole text."""
    kinds = {f.name: f.dataType.simpleString() for f in documents.schema}

    def make():
        def work(part):
            texts = [t or b"" for t in part.column("text").cast(pa.binary()).to_pylist()]
            y = np.full(len(texts), model) if isinstance(model, float) else model.score(texts)
            return {n: part.column(n) for n in keep} | {score: pa.array(y, pa.float64())}

        return work

    return map_slices(documents.select(*dict.fromkeys([*keep, "text"])), "text", make, ", ".join(f"`{n}` {kinds[n]}" for n in keep) + f", `{score}` double", _SLICE)


def quality(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of ``documents`` (doc_id, text): held_out, score, predicted.

    Labels (doc_id, quality) of held-out ids, of null ids, and other than 0 and 1
    are not learned from; repeated labels of an id count as their greatest. Null
    texts count as empty and are scored as one empty passage; repeated rows get
    equal scores; an empty table gives an empty result; without two kinds of
    label every score is the labels' mean, or 0.5. Other columns are ignored.
    """
    scored = apply(documents.select("doc_id", "text"), train(documents, labels), ["doc_id"])
    return scored.select("doc_id", held_out(5, 0).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of ``documents`` whose score reaches the threshold."""
    score = "_score"
    while score in documents.columns:
        score += "_"
    return apply(documents, train(documents, labels), documents.columns, score).where(F.col(score) >= THRESHOLD).drop(score)
