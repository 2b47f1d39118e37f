"""Language ID by hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from its code point. A trigram's vector binds
(multiplies) its three letters' vectors, permuted (rotated) by 2, 1 and 0 places. A text's vector
bundles (adds) the vectors of its trigrams; a language's prototype bundles all its training texts.
A text gets the language whose prototype has the largest cosine with it.

Letters are Unicode letters of the lower-cased text; any run of other characters is one blank, and
a text begins and ends with a blank. Bundling is linear, so a training task counts trigrams for each
language and bundles once; what leaves it is one vector for each language, whatever its size.
Null texts and texts without a letter get 'und' and score 0. Rows with null lang don't train. With
no training rows at all, every text gets 'und'. Repeated rows give repeated results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from samefold.llm.common import arrow_map, documents, fields, packed, small_batches, staged, unpacked

DIM = 1024
#: Trigram vectors that a worker keeps (one byte for each dimension).
CACHE = 48_000
#: More languages than this are refused: their prototypes go to every task.
MAX_LANGUAGES = 2_000

_BLANK = 32
_letter: np.ndarray | None = None


def _letters() -> np.ndarray:
    global _letter
    if _letter is None:
        _letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letter


def trigrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct trigrams of a text, three code points of 21 bits each, and their counts."""
    none = np.empty(0, np.uint64), np.empty(0, np.int64)
    if not text:
        return none
    c = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    is_letter = _letters()[c]
    if not is_letter.any():
        return none
    c = np.where(is_letter, c, _BLANK)
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]  # of a run of other characters, the first
    c = c[keep].astype(np.uint64)
    c = np.concatenate(([_BLANK] if c[0] != _BLANK else [], c, [_BLANK] if c[-1] != _BLANK else [])).astype(np.uint64)
    if len(c) < 3:
        return none
    return np.unique((c[:-2] << np.uint64(42)) | (c[1:-1] << np.uint64(21)) | c[2:], return_counts=True)


class Vectors:
    """Trigram vectors, made when first asked for."""

    def __init__(self, dim: int = DIM):
        self.dim, self.letters, self.rows = dim, {}, {}
        self.store = np.empty((1024, dim), np.int8)

    def letter(self, code: int) -> np.ndarray:
        v = self.letters.get(code)
        if v is None:
            if len(self.letters) > 4096:
                self.letters.clear()
            bits = np.unpackbits(np.frombuffer(hashlib.shake_256(b"letter %d" % code).digest(self.dim // 8), np.uint8))
            v = self.letters[code] = (bits.astype(np.int8) << 1) - 1
        return v

    def _make(self, gram: int) -> int:
        k = len(self.rows)
        if k == len(self.store):
            self.store = np.concatenate((self.store, np.empty_like(self.store)))
        a, b, c = gram >> 42, gram >> 21 & 0x1FFFFF, gram & 0x1FFFFF
        self.store[k] = np.roll(self.letter(a), 2) * np.roll(self.letter(b), 1) * self.letter(c)
        self.rows[gram] = k
        return k

    def bundle(self, grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
        total = np.zeros(self.dim, np.float32)
        for at in range(0, len(grams), CACHE // 4):  # bounded, however many trigrams there are
            part = grams[at : at + CACHE // 4].tolist()
            if len(self.rows) + len(part) > CACHE:
                self.rows.clear()
            get = self.rows.get
            ids = [k if (k := get(g)) is not None else self._make(g) for g in part]
            total += counts[at : at + CACHE // 4].astype(np.float32) @ self.store[ids].astype(np.float32)
        return total


def train(rows: DataFrame, dim: int = DIM) -> dict[str, np.ndarray]:
    """Prototypes from all rows of (text, lang)."""
    return {lang: v[:-1] for lang, v in _sums(rows, dim).items()}


def _sums(rows: DataFrame, dim: int) -> dict[str, np.ndarray]:
    """Prototypes, each with the number of its training trigrams as one more element. Tasks send a
    vector for each language; these are added up in two steps by language."""
    spark = rows.sparkSession

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, sums, held = Vectors(dim), {}, {}

        def bundle(lang: str) -> None:
            grams, counts = (np.concatenate(x) for x in zip(*held.pop(lang), strict=True))
            grams, back = np.unique(grams, return_inverse=True)
            sums[lang] = sums.get(lang, 0) + np.append(vectors.bundle(grams, np.bincount(back, counts)).astype(np.float64), counts.sum())

        sizes: dict[str, int] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                g = trigrams(text)
                if len(g[0]):
                    held.setdefault(lang, []).append(g)
                    sizes[lang] = sizes.get(lang, 0) + len(g[0])
                    if sizes[lang] > 2_000_000:
                        bundle(lang)
                        sizes[lang] = 0
        for lang in list(held):
            bundle(lang)
        if sums:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(sums)), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], ["lang", "v"]
            )

    small_batches(spark)
    parts = staged(rows.select("text", "lang").mapInArrow(count, "lang string, v array<double>"), "language-sums")
    n = parts.select("lang").distinct().limit(MAX_LANGUAGES + 1).count()
    if n > MAX_LANGUAGES:
        raise ValueError(f"over {MAX_LANGUAGES} values of lang: more than can be learned")
    summed = parts.select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    found: dict[str, np.ndarray] = {}
    for r in summed.collect():  # MAX_LANGUAGES x dimensions at most
        found.setdefault(r.lang, np.zeros(dim + 1))[r.i] = r.x
    return dict(sorted(found.items()))


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], keep: tuple[str, ...] = (), fit: dict[str, float] | None = None) -> DataFrame:
    """doc_id, lang_pred, score (the cosine, no less than 0) and the columns in `keep`, for each row
    of docs. With `fit` (see fits()) texts whose cosine is under floor() get 'und'. No shuffle."""
    langs = list(prototypes)
    dim = len(next(iter(prototypes.values()))) if langs else DIM
    table = np.array([prototypes[x] / max(np.linalg.norm(prototypes[x]), 1e-9) for x in langs], np.float32).reshape(len(langs), dim)
    state: dict[str, Vectors] = {}

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        vectors = state.setdefault("vectors", Vectors(dim))
        names, scores = [], []
        for text in batch.column(1).to_pylist():
            grams, counts = trigrams(text) if langs else ((), ())
            if not len(grams):
                names.append("und")
                scores.append(0.0)
                continue
            v = vectors.bundle(grams, counts)
            cos = table @ v / max(float(np.linalg.norm(v)), 1e-9)
            k = int(cos.argmax())
            names.append(langs[k] if fit is None or cos[k] >= floor(counts, fit[langs[k]], dim) else "und")
            scores.append(float(min(1.0, max(0.0, cos[k]))))
        more = [batch.column(2 + k) for k in range(len(keep))]
        return pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(names), pa.array(scores, pa.float64()), *more], ["doc_id", "__lang", "__score", *keep])

    schema = fields("doc_id long, __lang string, __score double", docs, *keep)
    out = arrow_map(docs.select("doc_id", "text", *keep), schema, one)
    return out.withColumnsRenamed({"__lang": "lang_pred", "__score": "score"}) if not keep else out


def held_out(column: str = "doc_id"):
    """Rows kept from training: crc32(doc_id as text) mod 4 is 2 (null ids train)."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 4 == 2, F.lit(False))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = train(docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()))
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


#: A text is of a language if its trigrams are at least this share as common in the language's
#: training texts as those texts' own trigrams are on average.
SHARE = 1 / 3
#: Standard deviations (1 / sqrt(dim)) of the cosine of unrelated vectors that count as noise.
NOISE = 2.0


def fits(sums: dict[str, np.ndarray]) -> dict[str, float]:
    """For each language the root of the chance that two training trigrams are equal, from
    prototypes with counts: trigram vectors are all but orthogonal, so |prototype|^2 / dim is the
    sum of the squared counts, in which each trigram also meets itself."""
    out = {}
    for lang, v in sums.items():
        n = max(v[-1], 2.0)
        out[lang] = float(np.sqrt(max(v[:-1] @ v[:-1] / (len(v) - 1) - n, 0.0) / (n * (n - 1))))
    return out


def floor(counts: np.ndarray, fit: float, dim: int) -> float:
    """The least cosine of a text of the language. A text of n trigrams with counts c that are drawn
    as in training has on average the cosine n * fit / |c|: little for a few words, near 1 for long
    texts, less where a text repeats itself. SHARE of it is asked for, and to be clear of the noise
    as far as the language's own texts of that size are."""
    c, noise = counts.astype(np.float64), NOISE / dim**0.5
    usual = fit * float(c.sum() / np.sqrt(c @ c))
    return max(SHARE * usual, min(noise, usual - noise))


def recognised(docs: DataFrame, languages: tuple[str, ...] | None = None) -> DataFrame:
    """docs without the rows that have no letter or no recognisable language, and, where target
    languages are given, without those predicted to be of another. The prototypes are learned from all
    rows of docs whose lang isn't null."""
    sums = _sums(docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()), DIM)
    scored = predict(packed(docs), {lang: v[:-1] for lang, v in sums.items()}, keep=("text", "__x"), fit=fits(sums))
    good = F.col("__lang") != "und" if languages is None else F.col("__lang").isin(*languages)
    return unpacked(scored.where(good), docs.columns)
