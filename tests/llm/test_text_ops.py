"""Digest, token files, separator scan, pieces: against brute-force versions and round trips."""

import hashlib
import re
import unicodedata
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from gritmeter.llm import digest, encoders, pieces, tokencounts, tokenfile
from gritmeter.llm.storage import new_path

from .conftest import ODD

BPE, SP = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode()))


def test_digest_against_brute_force(odd):
    rows = order([(r[0], r[1] or "") for r in ODD])
    want = []
    for (i, text), (_, after) in zip(rows, rows[1:] + rows[:1], strict=True):
        k = len(text) // 4
        edited = text[: len(text) - k] + after[:k]
        want.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest()))
    for shards in (1, 3):
        got = digest.fingerprints(odd, shards).collect()
        assert sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got), key=str) == sorted(want, key=str)


def test_digest_equality_is_canonical_equality(make):
    texts = ["Straße  X", "STRASSE\tx", "strasse x ", "é", "é", "É", "ﬁ", "fi", "a b", "ab", "ＡＢ", "ab　", "", " ", " "]
    canon = lambda t: " ".join(re.split(r"\s+", unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t).casefold()))).strip()
    got = {r["doc_id"]: r["fingerprint"] for r in digest.fingerprints(make(list(enumerate(texts)))).collect()}
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            assert (got[i] == got[j]) == (canon(a) == canon(b)), (a, b)


def test_digest_likeness(make):
    got = {r["doc_id"]: r for r in digest.fingerprints(make([(1, "abc"), (2, "ABC"), (3, "hello there you")])).collect()}
    assert got[1]["near_edited"] == 1.0 and got[1]["near_next"] == 1.0 and got[2]["near_next"] == 0.0 and got[3]["near_edited"] == 0.0


def test_digest_collisions_are_told_apart(make, monkeypatch):
    """With a hash of two values nearly all texts collide: equal canonical texts, and only those, keep equal fingerprints."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(digest, "wide_hash", lambda c: F.concat(F.lit("0" * 31), F.pmod(F.char_length(c), F.lit(2)).cast("string")))
    texts = ["a", "B", "b", "c", "dd", "DD", "ee", "", None, "longer text of some words", "a"]
    rows = [(i, t) for i, t in enumerate(texts)]
    got = {r["doc_id"]: r for r in digest.fingerprints(make(rows)).collect()}
    canon = lambda t: (t or "").lower()
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            assert (got[i]["fingerprint"] == got[j]["fingerprint"]) == (canon(a) == canon(b)), (a, b)
        after, n = texts[(i + 1) % len(texts)] or "", len(a or "") // 4
        edited = (a or "")[: len(a or "") - n] + after[:n]
        assert got[i]["near_next"] == float(canon(a) == canon(after)) and got[i]["near_edited"] == float(canon(a) == canon(edited))
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()


def test_digest_empty(none):
    assert digest.fingerprints(none).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab .,'s\n\t é日1?!<|>", max_size=40), max_size=6))
def test_byte_level_equals_library(texts):
    lib = Tokenizer.from_file(BPE)
    got = encoders.byte_level(BPE).encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [lib.encode(t, add_special_tokens=False).ids for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="xy \u00a0\n\u2003,", max_size=14), max_size=4))
def test_byte_level_keeps_runs_of_white_space(texts):
    lib, texts = encoders.byte_level(BPE).lib, [*texts, "x \u00a0 \u00a0 y"]
    got = encoders.byte_level(BPE).encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [lib.encode(t, add_special_tokens=False).ids for t in texts]


def test_token_files(spark, odd):
    lib = Tokenizer.from_file(BPE)
    got = tokenfile.round_trip(odd, BPE).collect()
    want, at = {}, 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    for i, t in ODD:
        ids = lib.encode(t or "", add_special_tokens=False).ids + [0]
        want.setdefault(i, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    have = {}
    for r in got:
        have.setdefault(r["doc_id"], []).append((r["n_tokens"], r["ids_crc32"]))
    assert {k: sorted(v) for k, v in have.items()} == {k: sorted(v) for k, v in want.items()}
    ids = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))


def test_token_file_access_to_one_document(spark, make):
    docs = make([(i, f"document number {i} says {'word ' * (i % 9)}") for i in range(400)])
    folder = new_path(spark, "tokens")
    made = tokenfile.write(docs, folder, BPE, shards=3)
    lib, found = Tokenizer.from_file(BPE), []
    for s in made:
        found += tokenfile.Shard(folder, s["k"]).document(123)
    assert [x.tolist() for x in found] == [lib.encode("document number 123 says " + "word " * 6, add_special_tokens=False).ids + [0]]
    assert tokenfile.read(spark, folder).count() == 400
    with pytest.raises(ValueError):
        tokenfile.Shard(folder, made[0]["k"], b"another dictionary")


def test_token_file_access_to_odd_ids(spark, make):
    ids = [None, None, -(2**63), -5, 0, 7, 7, 2**63 - 1]
    docs = make([(i, f"text {k}") for k, i in enumerate(ids)])
    folder = new_path(spark, "tokens")
    made = tokenfile.write(docs, folder, BPE, shards=2)
    for i in set(ids):
        assert sum(len(tokenfile.Shard(folder, s["k"]).document(i)) for s in made) == ids.count(i)
    assert sum(len(tokenfile.Shard(folder, s["k"]).document(6)) for s in made) == 0
    assert sorted((r["doc_id"] for r in tokenfile.read(spark, folder).collect()), key=str) == sorted(ids, key=str)


def test_ranges_of_ids(spark):
    from pyspark.sql import functions as F

    from gritmeter.llm.ordering import id_bounds, is_bound, order_key, shard_of

    docs = spark.range(5000).select(F.when(F.col("id") % 7 > 0, F.col("id") * 3 - 600).alias("doc_id"))
    for shards in (1, 2, 3, 100, 700):
        bounds = id_bounds(docs, shards)
        assert bounds == sorted(set(bounds)) and len(bounds) <= shards + 1
        for o, k, at in docs.select(order_key().alias("o"), shard_of(order_key(), bounds).alias("k"), is_bound(order_key(), bounds).alias("b")).collect():
            assert k == np.searchsorted(bounds, o, "right") - 1 and at == (o in bounds[1:])


def test_token_files_empty(none):
    assert tokenfile.round_trip(none, BPE).count() == 0


@pytest.mark.parametrize("block", [1, 3, 1_000_000])
def test_separator_scan(spark, make, block):
    lib = Tokenizer.from_file(BPE)
    rows = [(1, "a b c d e"), (2, ""), (3, None), (4, "x"), (4, "x"), (None, "tail here")]
    got = tokencounts.token_counts(make(rows), BPE, 50256, block_ids=block).collect()
    want = [(i, len(lib.encode(t or "").ids)) for i, t in rows]
    assert sorted(((r["doc_id"], r["n_tokens"]) for r in got), key=str) == sorted(want, key=str)
    for file in {r["file"] for r in got}:
        at = 0
        for r in sorted((r for r in got if r["file"] == file), key=lambda r: r["ordinal"]):
            assert r["start"] == at
            at += r["n_tokens"] + 1


def test_separator_scan_of_a_text_that_holds_the_separator(spark, make):
    rows = [(1, "a <|endoftext|> b"), (2, "c d"), (3, "<|endoftext|>"), (4, "tail here too")]
    lib = Tokenizer.from_file(BPE)
    lib.encode_special_tokens = True
    got = tokencounts.token_counts(make(rows).coalesce(1), BPE, 50256).collect()
    assert sorted((r["doc_id"], r["n_tokens"]) for r in got) == [(i, len(lib.encode(t).ids)) for i, t in rows]


def test_separator_scan_of_wide_ids(make):
    rows = [(1, "a b"), (2, None), (3, "c d e")]
    got = tokencounts.token_counts(make(rows), BPE, 70_000).collect()
    lib = Tokenizer.from_file(BPE)
    assert sorted((r["doc_id"], r["n_tokens"]) for r in got) == [(i, len(lib.encode(t or "").ids)) for i, t in rows]


def test_separator_scan_of_an_unended_file(spark):
    folder = new_path(spark, "flat")
    tokenfile._fs(folder)[0].create_dir(tokenfile._fs(folder)[1], recursive=True)
    tokenfile.write_whole(f"{folder}/f.ids", [np.array([5, 9, 9, 7, 7, 9, 4], "<u2").tobytes()])
    tokenfile.write_whole(f"{folder}/g.ids", [np.array([1, 2, 3], "<u2").tobytes()])
    tokenfile.write_whole(f"{folder}/e.ids", [b""])
    files = spark.createDataFrame([("f",), ("g",), ("e",)], "file string")
    got = tokencounts.scan(folder, tokencounts.blocks(spark, folder, files, block_ids=2), 9).collect()
    assert sorted(map(tuple, got)) == [("f", 0, 0, 1, True), ("f", 1, 2, 0, True), ("f", 2, 3, 2, True), ("f", 3, 6, 1, False), ("g", 0, 0, 3, False)]


def test_separator_scan_empty(none):
    assert tokencounts.token_counts(none, BPE, 50256).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .,'st\n\t é日1?!▁", max_size=60))
def test_pieces_without_dropout_equal_library_and_all_decode(text):
    plain, dropped = pieces.coder(SP, 0.0, 1, 1), pieces.coder(SP, 0.5, 3, 2)
    if "▁" not in text:
        assert np.frombuffer(plain.encode(text), "<u4").tolist() == sentencepiece_lib().encode(text)
    for code in (plain, dropped):
        assert code.decode(code.encode(text)) == text.encode()


_LIB = []


def sentencepiece_lib():
    if not _LIB:
        _LIB.append(sentencepiece.SentencePieceProcessor(model_file=SP))
    return _LIB[0]


def test_dropout_varies_by_seed_and_repeats():
    text = "international considerations notwithstanding " * 20
    one, two = pieces.PieceCoder(SP, 0.3, 1).encode(text), pieces.PieceCoder(SP, 0.3, 2).encode(text)
    assert one != two and one == pieces.PieceCoder(SP, 0.3, 1).encode(text)
    assert len(one) > len(pieces.PieceCoder(SP, 0.0, 1).encode(text))


def test_dropout_varies_by_place_and_document_at_its_rate():
    code, rng, key = pieces.PieceCoder(SP), np.random.default_rng(2), "considerations"
    want = {}
    for _ in range(4000):  # each candidate skipped by chance alone
        ids = code.segment(" " + key, np.flatnonzero(rng.random(99) < 0.1).tolist())[0]
        want[ids] = want.get(ids, 0) + 1
    one = code.encode(" ".join([key] * 4000))
    several = [code.encode(f"{key} {i}") for i in range(4000)]
    assert code.decode(one).decode() == " ".join([key] * 4000) and len(want) > 20
    for ids, n in want.items():
        if n > 150:
            assert abs(sum(x.startswith(ids) for x in several) - n) < 5 * n**0.5 + 40
    assert len({x[:40] for x in several}) > 20
    again = pieces.PieceCoder(SP)
    assert again.encode("other words first") and again.encode(" ".join([key] * 4000)) == one


def _runs(code, text):
    """Where no piece has two characters side by side; all that aren't ASCII count as one."""
    kind = lambda c: " " if c == "▁" else c if c < "\x80" else "\x80"
    met = {(kind(a), kind(b)) for p in code.score for a, b in zip(p, p[1:])}
    own = " " + text
    out = [own[0]]
    for a, b in zip(own, own[1:]):
        if tuple(c if c < "\x80" else "\x80" for c in (a, b)) in met:
            out[-1] += b
        else:
            out.append(b)
    return out


def _agenda(code, run, skip):
    """Ids of a run: of all neighbours that make a piece the best, leftmost first, unless it was skipped as it stands or is to be skipped now."""
    parts, k, out = [("▁" if c == " " else "\0▁" if c == "▁" else c, False) for c in run], 0, b""
    while True:
        open_ = [(-code.score[a[0] + b[0]], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if not a[1] and a[0] + b[0] in code.score]
        if not open_:
            break
        i = min(open_)[1]
        if k in skip:
            parts[i] = (parts[i][0], True)  # not with what follows, until that changes
        else:
            parts[i : i + 2] = [(parts[i][0] + parts[i + 1][0], False)]
            if i:
                parts[i - 1] = (parts[i - 1][0], False)
        k += 1
    for p, _ in parts:
        out += code.ids.get(p) or b"".join(code.byte_id[b] for b in p.lstrip("\0").encode())
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.text(alphabet="thein ,.\n▁é日", max_size=30), st.sampled_from(["international considerations", "the  end ", "a" * 90, "notwithstanding, it was"])), max_size=4))
def test_dropout_against_a_plain_agenda(texts):
    from itertools import takewhile

    code = pieces.coder(SP, 0.25, 9, 50)
    for text in texts:
        runs = _runs(code, text) if text else []
        want = b"".join(_agenda(code, r, set(takewhile(lambda k: k < 10_000, code.draws(int(p))))) for r, p in zip(runs, code.places(text, len(runs)), strict=True))
        assert code.encode(text) == want


def test_full_dropout_leaves_characters():
    ids = np.frombuffer(pieces.PieceCoder(SP, 1.0, 1).encode("ab"), "<u4")
    assert len(ids) == 3


def test_piece_round_trip(odd, none):
    got = pieces.round_trip(odd, SP).collect()
    assert len(got) == len(ODD) and all(r["lossless"] for r in got)
    same = {(r["n_tokens"], r["ids_crc32"]) for r in got if r["doc_id"] in (5, 6)}
    assert len(same) == 1 and pieces.round_trip(none, SP).count() == 0
    back = {r["doc_id"]: r["text"] for r in pieces.decode(pieces.encode(odd.where("doc_id in (1, 2, 7)"), SP), SP).collect()}
    assert back == {1: None, 2: "", 7: ODD[8][1]}
