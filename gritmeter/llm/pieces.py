"""SentencePiece BPE with seeded merge-dropout: encoding and lossless decoding.

Merges are taken from an agenda in order of their pieces' scores, leftmost first.
Each candidate that comes up is skipped with the dropout's probability, by a hash keyed
by seed, document (its text) and the run's place in it: the hash gives the gaps from one
skipped candidate to the next, which are distributed geometrically. Texts are cut into
runs between characters that no piece of the vocabulary has side by side, so runs are
independent. A run's ids follow from the numbers of its skipped candidates alone, so a
worker keeps the results for those, and still each occurrence is drawn anew.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowmap import map_slices
from .segments import Store, flat, pieces
from .wordhash import mix

DROPOUT, SEED = 0.1, 17
#: Runs, with and without skipped candidates, that a worker keeps, about 200 bytes each.
CACHE_RUNS = 1_500_000
#: The same where other stages share the executor, as in the pipeline, and what is kept of that between tasks.
SHARED_CACHE_RUNS, RESTING_RUNS = 150_000, 30_000
#: Candidates of a run beyond which results with skipped ones aren't kept.
LONG = 40
#: Key of a run with a skipped candidate: row of what it was without, then the candidate's number in so many bits.
_BITS = 12
#: Characters of a run beyond which it is worked on alone; the rank of what can't be merged.
_WIDEST, _NEVER = 32, 1 << 40
_SLICE, _SHARED_SLICE = 4_000_000, 500_000
_GOLDEN, _DRAW = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)
_CODERS: dict[tuple, PieceCoder] = {}


class PieceCoder:
    """One vocabulary, rate and seed, kept in a worker."""

    def __init__(self, path: str, dropout: float = DROPOUT, seed: int = SEED, cache: int = CACHE_RUNS):
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_file=path)
        self.dropout, self.seed = dropout, seed
        n = lib.get_piece_size()
        self.ids, self.score, self.byte_id, spelled = {}, {}, {}, [b""] * n
        for i in range(n):
            piece = lib.id_to_piece(i)
            if lib.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = np.array([i], "<u4").tobytes()
                spelled[i] = bytes([int(piece[3:5], 16)])
            elif not lib.is_control(i) and not lib.is_unknown(i):
                self.ids[piece] = np.array([i], "<u4").tobytes()
                self.score[piece] = lib.get_score(i)
                spelled[i] = piece.replace("▁", " ").encode()
        self.spelled_size = np.array([len(x) for x in spelled], np.int64)
        self.spelled_at = np.cumsum(self.spelled_size) - self.spelled_size
        self.spelled_bytes = np.frombuffer(b"".join(spelled), np.uint8)
        self.cuts = self._cuts()
        self._pairs()
        # Hashes below the k-th bound keep more than k candidates before one is skipped; beyond the last bound none is.
        self.bounds = np.array([int((1 - dropout) ** k * 2**32) for k in range(1, 4097)], np.int64)[::-1] if dropout else None
        #: By number of candidates: hashes from here on skip one of them.
        self.least = np.concatenate([[2**32], self.bounds[::-1], [self.bounds[0]]]) if dropout else None
        self.known = Store(cache, "count", "parent", "nth")
        self.names: list[str] = []

    def _cuts(self) -> np.ndarray:
        """For each two bytes whether a run may end between them: no piece has such characters side by side. All that aren't ASCII count as one character."""
        met = np.zeros((129, 129), bool)
        kind = lambda c: 32 if c == "▁" else min(ord(c), 128)
        for p in self.score:
            for x, y in zip(p, p[1:]):
                met[kind(x), kind(y)] = True
        of = np.minimum(np.arange(256), 128)
        out = ~met[of][:, of]
        out[:, 128:192] = False  # inside a character
        return out.ravel()

    def segment(self, run: str, skip: Iterable[int] = ()) -> tuple[bytes, int]:
        """Ids of one run, in which a space stands for the piece's space sign, and the number of its candidates; those of the ascending numbers ``skip`` are skipped."""
        # A sign that the text itself holds is no space: it is spelled in bytes.
        symbols = ["▁" if c == " " else "\0▁" if c == "▁" else c for c in run]
        n, score, skips, k = len(symbols), self.score, iter(skip), 0
        nth = next(skips, -1)
        after, before, agenda = [*range(1, n), -1], list(range(-1, n - 1)), []
        for i in range(n - 1):
            if (s := score.get(m := symbols[i] + symbols[i + 1])) is not None:
                agenda.append((-s, i, i + 1, m))
        heapq.heapify(agenda)
        while agenda:
            _, i, j, merged = heapq.heappop(agenda)
            if after[i] != j or symbols[i] is None or symbols[j] is None or len(symbols[i]) + len(symbols[j]) != len(merged) or symbols[i] + symbols[j] != merged:
                continue
            k += 1
            if k - 1 == nth:
                nth = next(skips, -1)
                continue
            symbols[i], symbols[j] = merged, None
            x = after[i] = after[j]
            if x >= 0:
                before[x] = i
                if (s := score.get(m := merged + symbols[x])) is not None:
                    heapq.heappush(agenda, (-s, i, x, m))
            h = before[i]
            if h >= 0 and (s := score.get(m := symbols[h] + merged)) is not None:
                heapq.heappush(agenda, (-s, h, i, m))
        out = []
        for s in symbols:
            if s is not None:
                out.append(self.ids.get(s) or b"".join([self.byte_id[b] for b in s.lstrip("\0").encode()]))
        return b"".join(out), k

    def _pairs(self) -> None:
        """Tables of all merges of two pieces: key, merged piece and the place of its score, best first; and of each character's piece."""
        number = {p: int.from_bytes(x, "little") for p, x in self.ids.items()}
        place = {x: i for i, x in enumerate(sorted(set(self.score.values()), reverse=True))}
        rows = [(number[p[:k]] << 32 | number[p[k:]], number[p], place[self.score[p]]) for p in number for k in range(1, len(p)) if p[:k] in number and p[k:] in number]
        rows.sort()
        self.pair, self.merged, self.rank = (np.array([r[i] for r in rows], np.int64) for i in range(3))
        self.letter = np.full(0x110000, -1, np.int32)
        for p, i in number.items():
            if len(p) == 1:
                self.letter[32 if p == "▁" else ord(p)] = i

    def _lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged piece of pairs of pieces; _NEVER where there is none."""
        key = left.astype(np.int64) << 32 | (right.astype(np.int64) & 0xFFFFFFFF)
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        met = (self.pair[at] == key) & (left >= 0) & (right >= 0)
        return np.where(met, self.rank[at], _NEVER), np.where(met, self.merged[at], -1)

    def segments(self, runs: list[str], skips: list[tuple[int, ...]]) -> list[tuple[bytes, int]]:
        """``segment`` of many runs: those of known characters and no great length step by step all at once."""
        out: list = [None] * len(runs)
        size = np.array([len(r) for r in runs])
        letters = self.letter[np.frombuffer("".join(runs).encode("utf-32-le"), np.uint32)]
        first = np.cumsum(size) - size
        known = (np.minimum.reduceat(letters, first) >= 0) & (size <= _WIDEST)
        for i in np.flatnonzero(~known).tolist():
            out[i] = self.segment(runs[i], skips[i])
        order = np.flatnonzero(known)
        order = order[np.argsort(size[order], kind="stable")]
        for i in range(0, len(order), 4096):
            own = order[i : i + 4096]
            for j, got in zip(own.tolist(), self._together(letters, first[own], size[own], [skips[j] for j in own.tolist()]), strict=True):
                out[j] = got
        return out

    def _together(self, letters: np.ndarray, first: np.ndarray, size: np.ndarray, skips: list[tuple[int, ...]]) -> list[tuple[bytes, int]]:
        """Ids and numbers of candidates of the runs of ``letters``: in each step every run takes its best candidate, leftmost first."""
        n, width = len(first), int(size[-1])
        across = np.arange(width)
        sym = np.where(across < size[:, None], letters[np.minimum(first[:, None] + across, len(letters) - 1)], -1)
        rank, merged = np.full((n, width), _NEVER), np.full((n, width), -1, np.int64)
        rank[:, :-1], merged[:, :-1] = self._lookup(sym[:, :-1], sym[:, 1:])
        wide = max(map(len, skips)) + 1
        skip = np.full((n, wide), -1)
        for r, x in enumerate(skips):
            skip[r, : len(x)] = x
        k, done, final = np.zeros(n, np.int64), np.zeros(n, np.int64), np.empty((n, width), sym.dtype)
        at = np.arange(n)
        while len(at):
            best = rank.argmin(1)
            live = rank[np.arange(len(at)), best] < _NEVER
            if not live.all():
                final[at[~live], : sym.shape[1]] = sym[~live]
                at, sym, rank, merged, best = at[live], sym[live], rank[live], merged[live], best[live]
            nth = k[at]
            k[at] += 1
            drop = skip[at, done[at]] == nth
            done[at] += drop
            rows = np.arange(len(at))
            rank[rows[drop], best[drop]] = _NEVER
            rows, i = rows[~drop], best[~drop]
            if not len(rows):
                continue
            new = merged[rows, i]
            own = sym[rows]
            shift = across + (across > i[:, None])
            shift[:, -1] = np.minimum(shift[:, -1], width - 1)
            own = np.take_along_axis(own, shift, 1)
            own[:, -1] = -1
            here = np.arange(len(rows))
            own[here, i] = new
            sym[rows] = own
            r, m = np.take_along_axis(rank[rows], shift, 1), np.take_along_axis(merged[rows], shift, 1)
            r[:, -1] = _NEVER
            r[here, i], m[here, i] = self._lookup(new, own[here, np.minimum(i + 1, width - 1)])
            before = np.flatnonzero(i > 0)
            r[before, i[before] - 1], m[before, i[before] - 1] = self._lookup(own[before, i[before] - 1], new[before])
            rank[rows], merged[rows] = r, m
        count = (final >= 0).sum(1)
        data, ends = final[final >= 0].astype("<u4").tobytes(), (4 * np.cumsum(count)).tolist()
        return [(data[a:b], c) for a, b, c in zip([0, *ends], ends, k.tolist())]

    def _gaps(self, hashes: np.ndarray) -> np.ndarray:
        """Candidates kept before the next skipped one."""
        return len(self.bounds) - np.searchsorted(self.bounds, hashes.astype(np.int64), side="right")

    def draws(self, place: int) -> Iterator[int]:
        """Ascending numbers of the candidates to skip of the run whose key is ``place``."""
        k, draw = -1, 0
        while True:
            own = np.array([place], np.uint64)
            gap = int(self._gaps((mix(own + _DRAW * np.full(1, draw, np.uint64)) if draw else own) >> np.uint64(32))[0])
            if gap >= len(self.bounds):
                return
            k, draw = k + 1 + gap, draw + 1
            yield k

    def places(self, text: str, n: int) -> np.ndarray:
        """Keys of the ``n`` runs of ``text``."""
        return mix(np.uint64(xxhash.xxh64_intdigest(text, self.seed)) + np.arange(1, n + 1, dtype=np.uint64) * _GOLDEN)

    def _skipped(self, row: int) -> tuple[str, tuple[int, ...]]:
        """The run of a known row and its skipped candidates."""
        skip, s = (), self.known
        while s.parent[row] >= 0:
            skip = (int(s.nth[row]), *skip)
            row = int(s.parent[row])
        return self.names[row], skip

    def _children(self, keys: list[int]) -> list[int]:
        """Rows of runs by the row without their last skipped candidate and its number."""
        s = self.known
        rows = list(map(s.row.get, keys))
        if None in rows:
            new = [k for k, r in zip(keys, rows, strict=True) if r is None]
            names, before = zip(*[self._skipped(k >> _BITS) for k in new])
            made = self.segments(names, [(*skip, k & (1 << _BITS) - 1) for skip, k in zip(before, new, strict=True)])
            first = s.add([x for x, _ in made], count=[n for _, n in made], parent=[k >> _BITS for k in new], nth=[k & (1 << _BITS) - 1 for k in new])
            self.names += [""] * len(new)
            s.row.update(zip(new, range(first, first + len(new)), strict=True))
            rows = list(map(s.row.get, keys))
        return rows

    def rest(self) -> None:
        """Keep no more than RESTING_RUNS or so."""
        if self.known.n > RESTING_RUNS:
            self._forget(RESTING_RUNS)

    def _forget(self, most: int) -> None:
        """Keep the ``most`` that were asked for most, and what those came from."""
        s = self.known
        kept = s.often(most)
        up = s.parent[: s.n]
        while (lost := np.flatnonzero(kept & (up >= 0) & ~kept[up])).size:
            kept[up[lost]] = True
        number = s.keep(kept)
        self.names = [x for x, k in zip(self.names, kept.tolist(), strict=True) if k]
        own = np.flatnonzero(s.parent[: s.n] >= 0)
        s.parent[own] = number[s.parent[own]]
        s.row = {k: r for k, r in s.row.items() if type(k) is str}
        s.row.update(zip((s.parent[own] << _BITS | s.nth[own]).tolist(), own.tolist(), strict=True))

    def _vary(self, rows: np.ndarray, places: np.ndarray) -> np.ndarray:
        """The rows with the candidates skipped that hashes of ``places`` choose."""
        s = self.known
        rows, first = rows.copy(), places >> np.uint64(32)
        at = np.flatnonzero(first.astype(np.int64) >= self.least[np.minimum(s.count[rows], len(self.least) - 1)])
        at = at[s.count[rows[at]] <= LONG]
        now, key, nth, draw = rows[at], places[at], self._gaps(first[at]), 0
        while len(at):
            asked, back = np.unique(now << _BITS | nth, return_inverse=True)
            found = np.array(self._children(asked.tolist()), np.int64)
            s.asked[found] += np.bincount(back, minlength=len(found))
            now = rows[at] = found[back]
            draw += 1
            gap = self._gaps(mix(key + _DRAW * np.full(1, draw, np.uint64)) >> np.uint64(32))
            nth = nth + 1 + gap
            more = (gap < len(self.bounds)) & (nth < s.count[now])
            at, now, key, nth = at[more], now[more], key[more], nth[more]
        return rows

    def encode_flat(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all ``texts`` (no nulls) one after another, and the bounds of each text's, one more than texts; an empty text has none."""
        s = self.known
        if s.n > s.limit:
            self._forget(s.limit // 2)
        data, bounds = flat(texts)
        full = np.flatnonzero(bounds[1:] > bounds[:-1])
        data = np.insert(data, bounds[full], 32)
        bounds = bounds + np.searchsorted(full, np.arange(len(bounds)))
        cut = np.zeros(len(data), bool)
        if len(data):
            cut[1:] = self.cuts[data[:-1].astype(np.uint16) << 8 | data[1:]]
        names, codes, bounds = pieces(data, bounds, cut)
        rows = list(map(s.row.get, names))
        if None in rows:
            new = [k for k, r in zip(names, rows, strict=True) if r is None]
            made = self.segments(new, [()] * len(new))
            first = s.add([x for x, _ in made], count=[n for _, n in made], parent=[-1] * len(new), nth=[0] * len(new))
            self.names += new
            s.row.update(zip(new, range(first, first + len(new)), strict=True))
            rows = list(map(s.row.get, names))
        row_of = np.array(rows, np.int64)
        s.asked[row_of] += np.bincount(codes, minlength=len(names))
        rows = row_of[codes]
        once = s.n
        if self.dropout and len(rows):
            own = np.array([xxhash.xxh64_intdigest(t, self.seed) for t in texts.to_pylist()], np.uint64)
            n = np.diff(bounds)
            places = mix(np.repeat(own, n) + (np.arange(len(rows)) - np.repeat(bounds[:-1], n) + 1).astype(np.uint64) * _GOLDEN)
            long = np.flatnonzero(s.count[rows] > LONG)
            rows = self._vary(rows, places)
            once = s.n
            if len(long):
                drawn = [self.segment(self.names[r], self.draws(p)) for r, p in zip(rows[long].tolist(), places[long].tolist(), strict=True)]
                first = s.add([x for x, _ in drawn])
                rows[long] = np.arange(first, first + len(long))
        ids, ends = s.gather(rows)
        s.drop(once)
        return ids, np.concatenate([[0], ends])[bounds]

    def encode(self, text: str) -> bytes:
        """Ids of ``text`` as little-endian unsigned 32-bit integers; of the empty text, none."""
        return self.encode_flat(pa.array([text], pa.string()))[0].astype("<u4").tobytes()

    def decode_flat(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 of the texts that have ``ids``, each with a space before it, one after another, and their bounds."""
        size = self.spelled_size[ids]
        ends = np.cumsum(size)
        at = np.repeat(self.spelled_at[ids] - (ends - size), size)
        at += np.arange(len(at))
        return self.spelled_bytes[at], np.concatenate([[0], ends])[bounds]

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 of the text that ``encode`` gave these ids."""
        own = np.frombuffer(ids, "<u4")
        return self.decode_flat(own, np.array([0, len(own)]))[0].tobytes()[1:]


def coder(path: str, dropout: float = DROPOUT, seed: int = SEED, cache: int = CACHE_RUNS) -> PieceCoder:
    key = (path, dropout, seed, cache)
    if key not in _CODERS:
        _CODERS[key] = PieceCoder(*key)
    return _CODERS[key]


def _lists(ids: np.ndarray, bounds: np.ndarray, null: pa.Array | None = None) -> pa.Array:
    """Slices of ``ids`` as lists."""
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.astype(np.int32)), mask=null)


def encode(documents: DataFrame, model: str, dropout: float = DROPOUT, seed: int = SEED, id_column: str = "doc_id") -> DataFrame:
    """``id_column`` and ``ids`` (array<int>) of every row of ``documents``; a null text has null ids, an empty one none."""

    def make():
        code = coder(model, dropout, seed)

        def work(part):
            text = part.column("text")
            ids, at = code.encode_flat(text.fill_null(""))
            return {id_column: part.column(id_column), "ids": _lists(ids, at, text.is_null())}

        return work

    kind = documents.schema[id_column].dataType.simpleString()
    return map_slices(documents.select(id_column, "text"), "text", make, f"`{id_column}` {kind}, ids array<int>")


def decode(encoded: DataFrame, model: str, id_column: str = "doc_id") -> DataFrame:
    """``id_column`` and ``text`` of rows with ``ids``, whatever the dropout they were made with."""
    kind = encoded.schema[id_column].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        code = coder(model)
        for b in batches:
            texts = [None if x is None else code.decode(np.array(x, "<u4").tobytes()).decode() for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(id_column), pa.array(texts, pa.string())], [id_column, "text"])

    return encoded.select(id_column, "ids").mapInArrow(run, f"`{id_column}` {kind}, text string")


def with_ids(documents: DataFrame, model: str, dropout: float = DROPOUT, seed: int = SEED) -> DataFrame:
    """One row per row of ``documents`` (doc_id, text): n_tokens, ids_crc32 (of the ids as little-endian 32-bit integers), lossless, ids.

    lossless says whether decoding those ids gave the text back, byte for byte. A
    null text counts as empty: no ids, lossless. Repeated rows get equal ids; an
    empty table gives an empty result; other columns are ignored.
    """
    return _encoded(documents, model, dropout, seed, True)


def round_trip(documents: DataFrame, model: str, dropout: float = DROPOUT, seed: int = SEED) -> DataFrame:
    """As ``with_ids``, without the ids."""
    return _encoded(documents, model, dropout, seed, False)


def _encoded(documents: DataFrame, model: str, dropout: float, seed: int, give_ids: bool) -> DataFrame:
    def make():
        code = coder(model, dropout, seed, SHARED_CACHE_RUNS if give_ids else CACHE_RUNS)

        def work(part):
            text = part.column("text")
            ids, at = code.encode_flat(text)
            data, starts = flat(text)
            back, ends = code.decode_flat(ids, at)
            # Each decoded text has a space before it.
            data, back, raw = memoryview(np.ascontiguousarray(data)), memoryview(back), memoryview(ids.astype("<u4")).cast("B")
            pairs = zip(starts.tolist(), starts[1:].tolist(), ends.tolist(), ends[1:].tolist())
            got = {
                "doc_id": part.column("doc_id"),
                "n_tokens": np.diff(at),
                "ids_crc32": [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at.tolist(), at[1:].tolist())],
                "lossless": [data[a:b] == back[c + 1 : d] for a, b, c, d in pairs],
            }
            return got | {"ids": _lists(ids, at)} if give_ids else got

        if give_ids:
            work.done = code.rest
        return work

    docs = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return map_slices(docs, "text", make, "doc_id long, n_tokens long, ids_crc32 long, lossless boolean" + ", ids array<int>" * give_ids, _SHARED_SLICE if give_ids else _SLICE)
