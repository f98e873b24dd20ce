"""Language identification with language-bitmask n-gram filters.

Each learned language owns one bit. A bit-sliced Bloom filter keeps, at every position, a mask of the languages
whose filter has that position set; the AND of an n-gram's positions is the mask of all languages that (appear to)
contain it. A text's per-language popcounts over its n-grams, corrected for each language's false-positive rate,
decide its language.

Fitting counts n-grams on a bounded sample of labelled rows (`docs_per_language` each, chosen by a hash of the id)
with a grouped aggregate; at most 1 / `min_share` n-grams of a language can pass, so the model that reaches the tasks is
bounded. Prediction is one pass over whole texts without a shuffle.

Defined cases: `und` with score 0 for null texts and texts without a letter, and for every text if nothing could be
learned; a text with letters but no known n-gram gets the most frequent learned language with score 0; ties go to the
more frequent language. Every language is learned: each 64 of them add one mask word to every filter position. Extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.store import Scratch
from . import text as tx

#: Languages of one mask word.
WORD_LANGUAGES = 64
HASHES = 4
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_LETTER[128:] = True
_TO = np.where(_LETTER, tx.LOWER, 32).astype(np.uint8)
_TO[65:91] = np.arange(97, 123)


def _grams(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the 4-byte windows inside one word (a space may lead or end it), and each text's first window."""
    if len(data) < 4:
        return np.zeros(0, np.uint32), np.zeros(len(offs), np.int64)
    b = _TO[data]
    capital = (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97) & (data[:-1] == 0xC3)
    b[1:][capital] += 0x20
    w = b.astype(np.uint32)
    code = (w[:-3] << np.uint32(24)) | (w[1:-2] << np.uint32(16)) | (w[2:-1] << np.uint32(8)) | w[3:]
    ok = (b[1:-2] != 32) & (b[2:-1] != 32)
    for edge in offs[1:-1].tolist():  # windows must not cross into the next text
        ok[max(0, edge - 3) : edge] = False
    at = np.flatnonzero(ok)
    return code[at], np.searchsorted(at, offs)


def _places(codes: np.ndarray, bits: int) -> list[np.ndarray]:
    h = tx.mix(codes.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019))
    mask = np.uint64((1 << bits) - 1)
    step = (h >> np.uint64(40)) | np.uint64(1)
    return [((h + np.uint64(k) * step) & mask).astype(np.int64) for k in range(HASHES)]


#: Values of the language column that may be learned; more of them are an error, none is left out.
MAX_LANGUAGES = 10_000


@dataclass
class Model:
    """languages: most frequent first; masks: the bit-sliced filter, a row for each 64 languages; fpr: false-positive rate of each language."""

    languages: list[str]
    bits: int
    masks: np.ndarray
    fpr: np.ndarray


def build(grams: dict[str, np.ndarray], languages: list[str]) -> Model:
    most = max([1, *(len(g) for g in grams.values())])
    bits = max(10, int(np.ceil(np.log2(12 * most))))
    masks = np.zeros((max(1, -(-len(languages) // WORD_LANGUAGES)), 1 << bits), np.uint64)
    fill = np.zeros(len(languages))
    for k, lang in enumerate(languages):
        word, bit = masks[k // WORD_LANGUAGES], np.uint64(k % WORD_LANGUAGES)
        for at in _places(grams.get(lang, np.zeros(0, np.uint32)), bits):
            word[at] |= np.uint64(1) << bit
        fill[k] = ((word >> bit) & np.uint64(1)).mean()
    return Model(languages, bits, masks, fill**HASHES)


def contains(model: Model, codes: np.ndarray) -> np.ndarray:
    """Masks (a row for each 64 languages) of all languages containing each n-gram."""
    out = np.full((len(model.masks), len(codes)), ~np.uint64(0))
    for at in _places(codes, model.bits):
        for word, masks in zip(out, model.masks):
            word &= masks[at]
    return out


def fit(labelled: DataFrame, lang_col: str = "lang", text_col: str = "text", key: Column | None = None, docs_per_language: int = 4000, min_share: float = 5e-6, min_ratio: float = 0.1) -> Model:
    """Learn from rows with text and language, those of a language chosen by `key` (a hash of the text, or of more). A language contains an n-gram if the n-gram's share there is at least
    min_share and min_ratio of its share in the language where it is most common."""
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    key = F.xxhash64(F.col(text_col)) if key is None else key
    counts = rows.groupBy(F.col(lang_col).cast("string").alias("lang")).count().orderBy(F.desc("count"), "lang").limit(MAX_LANGUAGES + 1).collect()
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages: reduce the column to codes first")
    if not counts:
        return Model([], 10, np.zeros((1, 1024), np.uint64), np.zeros(0))
    unit = (F.shiftrightunsigned(key, 11) / F.lit(float(1 << 53))).alias("unit")
    names = [r["lang"] for r in counts]
    shares = rows.sparkSession.createDataFrame([(r["lang"], min(1.0, docs_per_language / r["count"])) for r in counts], "lang string, share double")
    sample = rows.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), unit)
    sample = sample.join(F.broadcast(shares), "lang").where("unit < share").select("lang", "text")
    index = {x: k for k, x in enumerate(names)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang = np.array([index[x] for x in batch.column(0).to_pylist()], np.int64)
            for i, j, data, offs in tx.slices(batch.column(1)):
                codes, first = _grams(data, offs)
                both, n = np.unique((np.repeat(lang[i:j], np.diff(first)) << 32) | codes.astype(np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array((both >> 32).astype(np.int32)), pa.array(both & 0xFFFFFFFF), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])

    seen = sample.mapInArrow(count, "lang int, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    grams = {}
    with Scratch(rows.sparkSession) as passing:
        seen = passing.written(seen, "grams")
        totals = seen.groupBy("lang").agg(F.sum("n").alias("all"))
        rates = seen.join(totals, "lang").select("lang", "gram", (F.col("n") / F.col("all")).alias("rate")).where(F.col("rate") >= min_share * min_ratio)
        top = rates.groupBy("gram").agg(F.max("rate").alias("top"))
        held = rates.where(F.col("rate") >= min_share).join(top, "gram").where(F.col("rate") >= min_ratio * F.col("top"))
        held = held.select("lang", "gram")
        if len(names) > WORD_LANGUAGES:  # the driver takes the n-grams of 64 languages at a time
            held = passing.written(held, "held")
        for first in range(0, len(names), WORD_LANGUAGES):
            table = held.where(F.col("lang").between(first, first + WORD_LANGUAGES - 1)).toPandas().sort_values("lang")
            lang, gram = table.lang.to_numpy(), table.gram.to_numpy().astype(np.uint32)
            for k in range(first, min(first + WORD_LANGUAGES, len(names))):
                grams[names[k]] = gram[np.searchsorted(lang, k) : np.searchsorted(lang, k + 1)]
    return build(grams, names)


def classify(model: Model, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Language index (-1: und) and score of each text of a slice."""
    n = len(offs) - 1
    lettered = np.diff(np.concatenate(([0], np.cumsum(_LETTER[tx.LOWER[data]] & (data < 128))))[offs]) > 0
    for k in np.flatnonzero(~lettered & (np.diff(offs) > 0)).tolist():
        lettered[k] = any(c.isalpha() for c in data[offs[k] : offs[k + 1]].tobytes().decode("utf-8", "replace"))
    codes, first = _grams(data, offs)
    masks, total = contains(model, codes), np.diff(first)
    counts = np.zeros((len(model.languages), n))
    for k, f in enumerate(model.fpr):
        hits = np.concatenate(([0], np.cumsum((masks[k // WORD_LANGUAGES] >> np.uint64(k % WORD_LANGUAGES)) & np.uint64(1))))
        counts[k] = np.maximum(0, (np.diff(hits[first]) - total * f) / (1 - f))
    best = counts.argmax(0)
    score = np.clip(counts[best, np.arange(n)] / np.maximum(total, 1), 0, 1)
    return np.where(lettered, best, -1), np.where(lettered, score, 0.0)


def predict(docs: DataFrame, model: Model, id_cols: list[str], text_col: str = "text") -> DataFrame:
    """id_cols plus lang_pred and score, one row per document."""
    names = np.array([*model.languages, "und"], object)
    schema = docs.select(*id_cols).schema.add("lang_pred", "string").add("score", "double")
    own = id_cols.index(text_col) if text_col in id_cols else len(id_cols)  # the text is not sent twice
    extra = [] if text_col in id_cols else [F.col(text_col).cast("string").alias("__text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offs in tx.slices(batch.column(own)):
                if model.languages:
                    which, score = classify(model, data, offs)
                else:
                    which, score = np.full(j - i, -1), np.zeros(j - i)
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(i, j - i) for k in range(len(id_cols))), pa.array(names[which], pa.string()), pa.array(score)], [f.name for f in schema])

    return docs.select(*id_cols, *extra).mapInArrow(run, schema)


def known(docs: DataFrame, model: Model, text_col: str = "text", min_score: float = 0.0) -> DataFrame:
    """The rows of docs in a learned language with at least min_score; all rows where no language was learned.

    Rows pass through whole, so columns of any name may stand beside the text.
    """
    if not model.languages:
        return docs
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offs in tx.slices(batch.column(at)):
                which, score = classify(model, data, offs)
                yield batch.slice(i, j - i).filter(pa.array((which >= 0) & (score >= min_score)))

    return docs.mapInArrow(run, docs.schema)


def held_out(id_col: str = "doc_id") -> Column:
    """True where crc32 of the id's text leaves 2 modulo 4 (a null id counts as empty text)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2
