"""Personal data: exact base patterns, and a semi-Markov conditional random field that adds spans.

Base kinds (email, ip, card, phone) are leftmost, non-overlapping matches with their checks. The random field works on
words: every candidate segment that starts and ends with a trigger word (a digit, `@`, `=`, or the value after a secret
keyword with `=` or `:`) is scored by features of the whole span; dynamic programming over bounded entities chooses
boundaries and types jointly. A segment has up to `SHORT_WORDS` words of any kind, or up to `MAX_WORDS` if it has no letter:
only cards and phones are written over many words. Words far from any trigger can only be outside, so a text falls into short zones and the work is linear in
its length. Added spans never touch base spans; a fifth kind, `secret`, comes from the field alone.

The field is fitted by gradient ascent on the likelihood of zones from a bounded sample of documents
(`sample_docs`, at most `ZONES_PER_DOC` zones of each, by a hash of their place, and none of over `ZONE_WORDS` words), labelled by the base patterns and by assignment patterns for
secrets. Applying it is one pass over whole texts without a shuffle; texts without a trigger are never decoded.

Defined cases: a null or empty text has no spans; without any zone in the sample the field adds nothing; rows
repeating an id are handled each; extra columns are ignored. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import Scratch
from . import text as tx

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")
SHORT_WORDS = 4
#: The longest card number, a word for each digit.
MAX_WORDS = 19
ZONES_PER_DOC = 20
ZONE_WORDS = 200

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_TRIGGER = re.compile(r"[0-9@=]")
_EDGE = "\"'`<>[]{},;:!?.#*$%&|"
_SECRET = re.compile(r"(?i)(?:password|passwd|pwd|token|secret|api_?key)\s*[=:]\s*[\"']?([0-9a-z_+/-]{12,})|(?-i:\b(AKIA[0-9A-Z]{16})\b)")
_KEYWORD = re.compile(r"(?i)(password|passwd|pwd|token|secret|api_?key)[\"']?\s*[=:]?\s*$")
_ASSIGN = re.compile(r"(?i)(?:password|passwd|pwd|token|secret|api_?key)[\"']?\s*[=:]\s*")
_COLON = re.compile(r"(?i)\S*(?:password|passwd|pwd|token|secret|api_?key)[\"']?:")
_LETTER = re.compile(r"[^\W\d_]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    out, end = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind as listed, then start."""
    out = [("email", s, e) for s, e in emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = _NOT_DIGIT.sub("", m.group())
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 8 <= sum(map(str.isdigit, m.group())) <= 15:
            out.append(("phone", *m.span()))
    return out


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def zones(text: str) -> list[list[tuple[int, int, bool]]]:
    """Runs of words (start, end, is a trigger) that begin and end with a trigger and have no SHORT_WORDS - 1 others in a row."""
    out: list[list[tuple[int, int, bool]]] = []
    values = [m.end() for m in _ASSIGN.finditer(text) if m.end() < len(text)]
    at, mark = 0, -1  # mark: the next plain trigger
    while True:
        if mark < at:
            m = _TRIGGER.search(text, at)
            mark = m.start() if m else len(text)
        k = bisect_left(values, at)
        start = min(mark, values[k] if k < len(values) else mark)
        if start >= len(text):
            break
        while start > at and text[start - 1] not in "\x20\t\n\x0b\x0c\r":
            start -= 1
        zone, idle, last = [], 0, at
        for w in _WORD.finditer(text, start):
            hit = _TRIGGER.search(text, w.start(), w.end()) is not None or bisect_left(values, w.start()) < bisect_left(values, w.end())
            idle = 0 if hit else idle + 1
            zone.append((w.start(), w.end(), hit))
            last = w.end()
            if idle >= SHORT_WORDS - 1:
                break
        while not zone[-1][2]:
            zone.pop()
        out.append(zone)
        at = last
    return out


def trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    """A segment without quoting and sentence marks at its ends, a leading key= or secret key: and unmatched brackets."""
    cut = text.rfind("=", start, end)
    if start < cut < end - 1 and text[start].isalpha():
        start = cut + 1
    elif (m := _COLON.match(text, start, end)) and m.end() < end:
        start = m.end()
    while start < end and text[start] in _EDGE:
        start += 1
    while end > start and text[end - 1] in _EDGE:
        end -= 1
    if end > start and text[end - 1] == ")" and text.count("(", start, end) < text.count(")", start, end):
        end -= 1
    if end > start and text[start] == "(" and text.count("(", start, end) > text.count(")", start, end):
        start += 1
    return start, end


FEATURES = 1 << 12


def span_features(text: str, start: int, end: int, n_words: int) -> list[int]:
    """Hashed features of a whole trimmed span."""
    s = text[start:end]
    digits = sum("0" <= c <= "9" for c in s)
    shape = re.sub(r"A+", "A", re.sub(r"a+", "a", re.sub(r"0+", "0", re.sub(r"[a-z]", "a", re.sub(r"[A-Z]", "A", re.sub(r"[0-9]", "0", s[:80]))))))
    names = [
        "bias",
        f"shape {shape[:24]}",
        f"words {n_words}",
        f"digits {min(20, digits)}",
        f"length {min(12, len(s) // 4)}",
        f"share {round(4 * digits / max(1, len(s)))}",
        f"dots {min(5, s.count('.'))}",
        f"at {min(2, s.count('@'))} {'.' in s.rpartition('@')[2]}",
        f"plus {s[:1] == '+'}",
        f"brackets {'(' in s and ')' in s}",
        f"hex {len(s) >= 12 and all(c in '0123456789abcdefABCDEF' for c in s)}",
        f"dense {len(s) >= 16 and digits > 1 and s.isalnum() and digits < len(s)}",
        f"capitals {len(s) >= 16 and s.upper() == s and digits < len(s)}",
        f"key {bool(_KEYWORD.search(text, max(0, start - 24), start - (text[start - 1 : start] in chr(34) + chr(39))))}",
        f"quoted {text[start - 1 : start] in ('=', chr(34)) if start else False}",
    ]
    if 13 <= digits <= 19 and not re.search(r"[^0-9\x20-]", s):
        names.append(f"luhn {luhn(_NOT_DIGIT.sub('', s))}")
    parts = s.split(".")
    if len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) <= 3 for p in parts):
        names.append(f"octets {all(int(p) <= 255 for p in parts)}")
    return [int.from_bytes(hashlib.blake2b(x.encode("utf-8", "replace"), digest_size=4).digest(), "little") % FEATURES for x in names]


def segments(text: str, zone: list[tuple[int, int, bool]]) -> list[tuple[int, int, int, int, list[int]]]:
    """(first word, end word, start, end, features) of the candidate segments of a zone, by end word."""
    out = []
    plain = 0  # the first of the words up to here that have no letter
    for j in range(1, len(zone) + 1):
        if _LETTER.search(text, zone[j - 1][0], zone[j - 1][1]):
            plain = j
        if zone[j - 1][2]:
            for i in range(max(0, j - MAX_WORDS, min(plain - 1, j - SHORT_WORDS)), j):
                if zone[i][2]:
                    s, e = trimmed(text, zone[i][0], zone[j - 1][1])
                    if e > s and (j - i <= SHORT_WORDS or not _LETTER.search(text, s, e)):
                        out.append((i, j, s, e, span_features(text, s, e, j - i)))
    return out


@dataclass
class Field:
    """weights: features x kinds; a segment's score for a kind is the sum of its features' weights, outside scores 0."""

    weights: np.ndarray

    def scores(self, segs: list) -> np.ndarray:
        return np.array([self.weights[f].sum(0) for *_, f in segs]).reshape(-1, len(KINDS))

    def decode(self, n: int, segs: list) -> list[tuple[str, int, int]]:
        """The best segmentation of n words."""
        best, back = [0.0] * (n + 1), [None] * (n + 1)
        score = self.scores(segs)
        k = 0
        for j in range(1, n + 1):
            best[j] = best[j - 1]
            while k < len(segs) and segs[k][1] == j:
                kind = int(score[k].argmax())
                if (value := best[segs[k][0]] + score[k, kind]) > best[j]:
                    best[j], back[j] = value, (k, kind)
                k += 1
        out, j = [], n
        while j:
            if back[j] is None:
                j -= 1
            else:
                k, kind = back[j]
                out.append((KINDS[kind], segs[k][2], segs[k][3]))
                j = segs[k][0]
        return out[::-1]

    def gradient(self, n: int, segs: list, gold: dict[tuple[int, int], int]) -> list[tuple[list[int], np.ndarray]]:
        """Of the log-likelihood, by segment: observed minus expected kinds (forward and backward sums)."""
        score = self.scores(segs)
        ahead, behind = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
        ahead[0] = behind[n] = 0.0
        k = 0
        for j in range(1, n + 1):
            ahead[j] = ahead[j - 1]
            while k < len(segs) and segs[k][1] == j:
                ahead[j] = np.logaddexp(ahead[j], ahead[segs[k][0]] + np.logaddexp.reduce(score[k]))
                k += 1
        from_word: dict[int, list[int]] = {}
        for k, g in enumerate(segs):
            from_word.setdefault(g[0], []).append(k)
        for i in range(n - 1, -1, -1):
            behind[i] = behind[i + 1]
            for k in from_word.get(i, ()):
                behind[i] = np.logaddexp(behind[i], behind[segs[k][1]] + np.logaddexp.reduce(score[k]))
        out = []
        for k, (i, j, s, e, f) in enumerate(segs):
            d = -np.exp(ahead[i] + score[k] + behind[j] - ahead[n])
            if (kind := gold.get((s, e))) is not None:
                d[kind] += 1
            out.append((f, d))
        return out


def train(rows: list[tuple[int, list, dict]], epochs: int = 4, rate: float = 0.5, l2: float = 1e-4, seed: int = 5) -> Field:
    """rows: (words, segments, gold kind by (start, end)) of each zone."""
    field = Field(np.zeros((FEATURES, len(KINDS))))
    g2 = np.full((FEATURES, len(KINDS)), 1e-6)
    rng = np.random.Generator(np.random.PCG64(seed))
    for _ in range(epochs):
        for p in rng.permutation(len(rows)):
            for f, d in field.gradient(*rows[p]):
                step = d[None, :] - l2 * field.weights[f]
                g2[f] += step * step
                field.weights[f] += rate / np.sqrt(g2[f]) * step
    return field


def weak_labels(text: str) -> dict[tuple[int, int], int]:
    """Gold spans for fitting: base matches, and values of secret assignments."""
    gold = {(m.start(g), m.end(g)): KINDS.index("secret") for m in _SECRET.finditer(text) for g in (1, 2) if m.group(g)}
    return gold | {(s, e): KINDS.index(k) for k, s, e in base_spans(text)}


_BYTE_TRIGGER = np.zeros(256, bool)
_BYTE_TRIGGER[list(b"0123456789@=:")] = True


def _triggered(arr: pa.Array) -> np.ndarray:
    """Rows whose text may have a trigger."""
    out = np.zeros(len(arr), bool)
    for i, j, data, offs in tx.slices(arr):
        out[i:j] = np.diff(np.concatenate(([0], np.cumsum(_BYTE_TRIGGER[data])))[offs]) > 0
    return out


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = 8000, sample_features: int = 4_000_000, seed: int = 23) -> Field:
    """From those of about `sample_docs` documents, chosen by a hash of id and text, that have a trigger, and of their zones
    as many as have about sample_features features of candidate segments."""
    has = docs.where(F.col(text_col).rlike("[0-9@=:]")).select(F.col(text_col).cast("string").alias("text"), F.shiftrightunsigned(F.xxhash64(id_col, text_col, F.lit(seed)), 11).alias("h"))
    total = docs.count()
    first = has.where(F.col("h") < int((1 << 53) * min(1.0, sample_docs / max(1, total))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"h": [], "n": [], "at": [], "kind": [], "f": []}
            for h, text in zip(batch.column(1).to_pylist(), batch.column(0).to_pylist()):
                gold = weak_labels(text)
                some = [z for z in zones(text) if len(z) <= ZONE_WORDS]
                for zone in sorted(some, key=lambda z: (zlib.crc32(f"{h} {z[0][0]}".encode()), z[0][0]))[:ZONES_PER_DOC]:  # noqa: B023
                    segs = segments(text, zone)
                    out["h"].append(h)
                    out["n"].append(len(zone))
                    out["at"].append([x for i, j, *_ in segs for x in (i, j)])
                    out["kind"].append([gold.get((s, e), -1) for _, _, s, e, _ in segs])
                    out["f"].append([f for *_, f in segs])
            types = [pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([pa.array(out[k], t) for k, t in zip(out, types)], list(out))

    with Scratch(docs.sparkSession) as passing:
        found = passing.written(first.mapInArrow(run, "h long, n int, at array<int>, kind array<int>, f array<array<int>>"), "zones")
        total = found.agg(F.sum(F.aggregate("f", F.lit(0).cast("long"), lambda s, x: s + F.size(x)))).first()[0] or 0
        unit = F.shiftrightunsigned(F.xxhash64("h", "n", "at", "f"), 11) / F.lit(float(1 << 53))
        table = found.where(unit < min(1.0, sample_features / max(1, total))).toArrow().to_pylist()
    rows = []
    for r in sorted(table, key=lambda r: (r["h"], r["n"], r["at"], r["f"])):
        at = list(zip(r["at"][::2], r["at"][1::2]))
        segs = [(i, j, k, k, f) for k, ((i, j), f) in enumerate(zip(at, r["f"]))]
        rows.append((r["n"], segs, {(k, k): kind for k, kind in enumerate(r["kind"]) if kind >= 0}))
    return train(rows)


def all_spans(text: str, field: Field) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and all spans by kind as in KINDS, then start."""
    base = base_spans(text)
    taken: list[list[int]] = []  # disjoint, ascending
    for s, e in sorted((s, e) for _, s, e in base):
        if taken and s < taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], e)
        else:
            taken.append([s, e])
    added = []
    for zone in zones(text):
        added += field.decode(len(zone), segments(text, zone))
    k, free = 0, []
    for kind, s, e in sorted(added, key=lambda x: x[1:]):
        while k < len(taken) and taken[k][1] <= s:
            k += 1
        if k == len(taken) or taken[k][0] >= e:
            free.append((kind, s, e))
    return base, sorted(base + free, key=lambda x: (KINDS.index(x[0]), x[1], x[2]))


def find(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base, spans): arrays of (kind, start, end) of every whole text."""
    entry = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    weights = field.weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Field(weights)
        for batch in batches:
            rows: list[tuple[list, list]] = [([], [])] * batch.num_rows
            texts = batch.column(1)
            for k in np.flatnonzero(_triggered(texts)).tolist():
                rows[k] = all_spans(texts[k].as_py(), model)
            cols = [pa.array([[dict(zip(("kind", "start", "end"), x)) for x in r[c]] for r in rows], pa.list_(entry)) for c in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], ["doc_id", "base", "spans"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    spans = "array<struct<kind:string,start:long,end:long>>"
    return rows.mapInArrow(run, f"doc_id long, base {spans}, spans {spans}")
