"""Personal data by weak supervision: labelers vote on candidate spans, EM weighs them, a classifier decides.

Base spans (email, ip, card, phone) are matched by rule and always stay. Further
candidates (secret, iban, ssn, name) get a vote, for, against or none, from each
of a regex, a gazetteer, a context and a shape labeler. The counts of all vote
patterns in the whole corpus, a table whose size is bounded by the patterns, feed
expectation-maximisation of the labelers' reliabilities; its posteriors train a
logistic classifier of spans, which adds candidates that no base span overlaps.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowmap import map_slices
from .storage import as_text, stash

BASE = ("email", "ip", "card", "phone")
ADDED = ("secret", "iban", "ssn", "name")
KINDS = BASE + ADDED
_RANK = {k: i for i, k in enumerate(KINDS)}

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: The look-behinds skip starts inside a run of digits, which could only fail as its start did.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_LONG = re.compile(r"[0-9](?:[ -]?[0-9]){11}")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")

_TITLES = ("Mr", "Mrs", "Ms", "Dr", "Prof", "Herr", "Frau", "Mme", "Señor", "Señora", "name is", "Name:", "name:")
_NAME = re.compile(r"\b(?:(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Señor|Señora)\.?|(?:my name is|[Nn]ame:)) ([A-ZÀ-Þ][a-zß-ÿ]+(?: [A-ZÀ-Þ][a-zß-ÿ]+)?)")
_FIRST_NAMES = frozenset("James John Robert Michael William David Richard Mary Patricia Jennifer Linda Elizabeth Barbara Susan Thomas Charles Daniel Paul Mark Anna Emma Laura Sarah Peter Hans Klaus Jürgen Wolfgang Ursula Monika Petra Pierre Jean Marie Michel Claude Sophie Camille José Juan Carlos María Carmen Ana Luis Antonio Francisco".split())
_KEY_WORDS = ("password", "passwd", "pwd", "token", "secret", "api_key", "apikey", "api-key", "access_key", "accesskey", "credential", "bearer", "auth")
_NAMED = re.compile(r"(?i)\b(?:password|passwd|pwd|token|secret|api[_-]?key|access[_-]?key|credentials?|bearer)\b[\"']?(?:\s*[=:]\s*|\s+)[\"']?([A-Za-z0-9_+/.-]{6,})")
_KEYLIKE = re.compile(r"(?<![A-Za-z0-9])(?:[0-9a-f]{16,}|[A-Z0-9]{16,40})(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_CUES = {"secret": _KEY_WORDS, "iban": ("iban", "account", "konto", "compte", "cuenta", "bank"), "ssn": ("ssn", "social", "security"), "name": ("name", "contact", "dear", "author", "signed")}
_AGAINST = ("commit", "sha1", "sha256", "md5", "checksum", "digest", "uuid", "isbn", "doi", "version", "hash", "revision", "part no", "serial")
_CONTEXT = 28


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Spans of the e-mail rule; found from each @ outwards, so long runs without one cost nothing."""
    found, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            found.append((start, m.end()))
            done = m.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", done)
    return found


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, rank of kind, end) by start, then kind."""
    out = [(s, 0, e) for s, e in emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    if _LONG.search(text):
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = _NOT_DIGIT.sub("", m.group())
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def base_text(spans: list[tuple[int, int, int]]) -> str:
    """kind:start:end of base spans by start, then the kind's name: an address made of a card number gives card before email."""
    return ",".join(f"{k}:{s}:{e}" for s, k, e in sorted((s, KINDS[k], e) for s, k, e in spans))


def _iban_ok(value: str) -> bool:
    v = value.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1


def _entropy(value: str) -> float:
    n = len(value)
    return -sum(value.count(c) / n * math.log2(value.count(c) / n) for c in set(value)) if n < 200 else 4.0


def _votes(kind: str, text: str, start: int, end: int) -> str:
    """One character a labeler: + for, - against, 0 none; then two of features: length and share of digits."""
    value, before = text[start:end], text[max(0, start - _CONTEXT) : start].lower()
    digits = sum(c.isdigit() for c in value) / len(value)
    if kind == "secret":
        mixed = 0 < digits < 1
        shape = "+" if mixed and len(value) >= 16 else "-" if not mixed and len(value) < 10 else "0"
        pattern = "+" if re.match(r"(?:AKIA|ASIA|ghp_|sk-|xox)|[0-9a-f]{18,}\Z", value) else "0"
        rich = "+" if _entropy(value) >= 2.8 else "-"
    elif kind == "iban":
        pattern, shape, rich = ("+" if _iban_ok(value) else "-"), "+" if 15 <= len(value.replace(" ", "")) <= 34 else "-", "0"
    elif kind == "ssn":
        area = int(value[:3])
        pattern, shape, rich = "+" if 0 < area < 900 and area != 666 and value[4:6] != "00" and value[7:] != "0000" else "-", "0", "0"
    else:
        pattern, shape, rich = "+" if " " in value else "0", "0", "0"
    gazetteer = "+" if (kind == "name" and value.split()[0] in _FIRST_NAMES) or (kind == "secret" and any(w in before[-16:] for w in _KEY_WORDS)) else "0"
    context = "-" if any(w in before for w in _AGAINST) else "+" if any(w in before for w in _CUES[kind]) else "0"
    return pattern + gazetteer + context + shape + rich + str(min(4, len(value) // 8)) + str(int(digits * 3.99))


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, str]]:
    """(start, rank of kind, end, votes) of spans that overlap no base span nor an earlier candidate."""
    found = []
    if _DIGIT.search(text):  # a text without digits has none of these
        lower = text.lower()
        if any(w in lower for w in _KEY_WORDS):
            found += [(m.start(1), 4, m.end(1)) for m in _NAMED.finditer(text) if _DIGIT.search(m.group(1))]
        found += [(m.start(), 4, m.end()) for m in _KEYLIKE.finditer(text)]
        found += [(m.start(), 5, m.end()) for m in _IBAN.finditer(text)]
        found += [(m.start(), 6, m.end()) for m in _SSN.finditer(text)]
    if any(t in text for t in _TITLES):
        found += [(m.start(1), 7, m.end(1)) for m in _NAME.finditer(text)]
    if not found:
        return []
    taken = sorted((s, e) for s, _, e in base)
    # Base spans of different kinds may nest: the furthest end so far decides overlap.
    starts, ends, most = [s for s, _ in taken], [], -1
    for _, e in taken:
        most = max(most, e)
        ends.append(most)
    out, last = [], -1
    for s, k, e in sorted(found):
        i = bisect_left(starts, e)
        if s >= last and not (i and ends[i - 1] > s):
            out.append((s, k, e, _votes(KINDS[k], text, s, e)))
            last = e
    return out


def spans_of(docs: DataFrame) -> DataFrame:
    """(doc_id, base array of (start, rank, end), found array of (start, rank, end, votes)) per row of ``docs``."""

    def make():
        def work(part):
            base, found = [], []
            for text in part.column("text").to_pylist():
                base.append(b := base_spans(text))
                found.append(candidates(text, b))
            named = [[{"start": s, "rank": k, "end": e} for s, k, e in b] for b in base]
            more = [[{"start": s, "rank": k, "end": e, "votes": v} for s, k, e, v in c] for c in found]
            digest = [hashlib.sha256(base_text(b).encode()).hexdigest() for b in base]
            return {"doc_id": part.column("doc_id"), "base": named, "found": more, "base_sha256": digest}

        return work

    return map_slices(as_text(docs), "text", make, "doc_id long, base array<struct<start:int,rank:int,end:int>>, found array<struct<start:int,rank:int,end:int,votes:string>>, base_sha256 string")


def vote_counts(spans: DataFrame) -> list[tuple[int, str, int]]:
    """Counts of all (kind, vote pattern) pairs of the corpus; there are few thousand patterns at most."""
    rows = spans.select(F.explode("found").alias("f")).groupBy("f.rank", "f.votes").agg(F.count(F.lit(1)).alias("n")).collect()
    return sorted((r["rank"], r["votes"], r["n"]) for r in rows)


def em(counts: list[tuple[int, str, int]], labelers: int = 5, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of each pattern, and the labelers' reliabilities (probability of a right vote, of those cast)."""
    votes = np.array([[{"+": 1, "-": -1}.get(c, 0) for c in v[:labelers]] for _, v, _ in counts], float).reshape(-1, labelers)
    n = np.array([c for _, _, c in counts], float)
    right, prior = np.full(labelers, 0.8), 0.5
    posterior = np.full(len(n), 0.5)
    for _ in range(rounds):
        odds = math.log(prior / (1 - prior)) + votes @ np.log(right / (1 - right))
        posterior = 1 / (1 + np.exp(-odds))
        agree = (votes > 0) * posterior[:, None] + (votes < 0) * (1 - posterior[:, None])
        # Beta(8, 2) on reliabilities and Beta(2, 2) on the share of true spans keep small tables sane.
        right = np.clip((8 + (n[:, None] * agree).sum(0)) / (10 + (n[:, None] * (votes != 0)).sum(0)), 0.55, 0.99)
        prior = float(np.clip((2 + (n * posterior).sum()) / (4 + n.sum()), 0.05, 0.95))
    return posterior, right


def _features(rank: int, votes: str) -> list[float]:
    one = [0.0] * len(ADDED)
    one[rank - len(BASE)] = 1.0
    return [{"+": 1.0, "-": -1.0}.get(c, 0.0) for c in votes[:5]] + one + [int(votes[5]) / 4, int(votes[6]) / 3]


def fit(spans: DataFrame, threshold: float = 0.5) -> set[tuple[int, str]]:
    """The (kind, pattern) pairs that the final classifier takes for personal data."""
    counts = vote_counts(spans)
    if not counts:
        return set()
    posterior, _ = em(counts)
    x = np.array([_features(k, v) for k, v, _ in counts])
    n = np.array([c for *_, c in counts], float)
    weight, bias, share = np.zeros(x.shape[1]), 0.0, n / n.sum()
    for _ in range(600):
        p = 1 / (1 + np.exp(-(x @ weight + bias)))
        step = share * (p - posterior)
        weight -= 2.0 * (x.T @ step + 1e-3 * weight)
        bias -= 2.0 * step.sum()
    p = 1 / (1 + np.exp(-(x @ weight + bias)))
    return {(k, v) for (k, v, _), q in zip(counts, p, strict=True) if q >= threshold}


def personal_data(documents: DataFrame) -> DataFrame:
    """One row per row of ``documents`` (doc_id, text): base counts, base_sha256 and all spans.

    Null texts count as empty and have no spans; repeated rows keep a row each;
    an empty table gives an empty result; other columns are ignored. Offsets are
    code points, ends exclusive. Where spans start together the kinds' names decide.
    """
    spans = stash(spans_of(documents), "spans")
    keep = sorted(f"{k}{v}" for k, v in fit(spans))
    kinds = F.array(*[F.lit(k) for k in KINDS])
    chosen = F.filter("found", lambda f: F.concat(f["rank"].cast("string"), f["votes"]).isin(keep)) if keep else F.filter("found", lambda f: F.lit(False))
    plain = F.transform(chosen, lambda f: F.struct(f["start"].alias("start"), f["rank"].alias("rank"), f["end"].alias("end")))
    named = F.transform(F.concat("base", plain), lambda s: F.struct(s["start"].alias("start"), F.get(kinds, s["rank"]).alias("kind"), s["end"].alias("end")))
    text = F.array_join(F.transform(F.array_sort(named), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    counts = [F.size(F.filter("base", lambda s, i=i: s["rank"] == i)).cast("long").alias(f"n_{k}") for i, k in enumerate(BASE)]
    return spans.select("doc_id", *counts, "base_sha256", text.alias("spans"), F.size(chosen).cast("long").alias("n_added"))


def mask(documents: DataFrame) -> DataFrame:
    """``documents`` with every span, base or added, replaced by its kind in angle brackets; overlapping spans become one; n_chars follows."""
    keep = fit(stash(spans_of(documents), "spans"))
    names, kind = documents.columns, documents.schema

    def make():
        def work(part):
            out = []
            for text in part.column("text").to_pylist():
                if text:
                    base = base_spans(text)
                    every = sorted(base + [(s, k, e) for s, k, e, v in candidates(text, base) if (k, v) in keep])
                    parts, at = [], 0
                    for s, k, e in every:
                        if s >= at:
                            parts += [text[at:s], f"<{KINDS[k].upper()}>"]
                        at = max(at, e)
                    text = "".join([*parts, text[at:]]) if every else text
                out.append(text)
            got = {n: part.column(n) for n in names}
            got["text"] = out
            if "n_chars" in got:
                got["n_chars"] = [None if t is None else len(t) for t in out]
            return got

        return work

    return map_slices(documents, "text", make, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kind))
