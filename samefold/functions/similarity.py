"""Trigram similarity, word similarity, token-set ratio, Hamming and cosine."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType


def trigrams(text: Column) -> Column:
    """The set of trigrams: lower case, words of letters and digits, two blanks before and one after each."""
    w = F.filter(F.split(F.lower(text), r"(?U)[^\p{L}\p{N}]+"), lambda t: t != "")
    grams = lambda t: F.transform(F.sequence(F.lit(1), F.length(t) + 1), lambda i: F.substring(F.concat(F.lit("  "), t, F.lit(" ")), i, F.lit(3)))
    return F.array_distinct(F.flatten(F.transform(w, grams)))


def float4(c: Column) -> Column:
    """Rounded to single precision, as the similarities are compared there."""
    return c.cast("float").cast("double")


def set_similarity(a: Column, b: Column) -> Column:
    """|a & b| / |a | b| of trigram sets; 0 where both are empty."""
    common = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - common
    return F.when(union > 0, float4(common / union)).otherwise(F.lit(0.0))


def name_similarity_of(query: str, name: str, brand: str, known: Callable[[str], frozenset[str]]) -> float:
    def alike(x: frozenset[str], y: frozenset[str]) -> float:
        both = len(x & y)
        return both / (len(x) + len(y) - both) if x or y else 0.0

    if not query:
        return 0.0
    own, best = known(name), alike(known(query), known(name))
    if brand and f" {brand} " in f" {query} ":
        best = max(best, alike(known(f" {query} ".replace(f" {brand} ", " ")), own))
    return float(np.float32(best))


@pandas_udf(DoubleType())
def name_similarity(query: pd.Series, name: pd.Series, brand: pd.Series) -> pd.Series:
    """The better of the query name as it is and without the row's own brand."""
    known = lru_cache(20_000)(lambda t: frozenset(padded_trigrams(t)))
    return pd.Series([name_similarity_of(q or "", n or "", b or "", known) for q, n, b in zip(query, name, brand, strict=True)], dtype="float64")


def without_brand(text: Column, brand: Column) -> Column:
    """text, padded, without brand as whole words: what indexing did to a row's own name."""
    return F.replace(F.concat(F.lit(" "), text, F.lit(" ")), F.concat(F.lit(" "), brand, F.lit(" ")), F.lit(" "))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)).cast("int")


def cosine(a: Column, b: Column) -> Column:
    """1 where a norm is 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, F.lit(1.0)).otherwise(dot(a, b) / norm)


def padded_trigrams(text: str) -> list[str]:
    """trigrams() in order, repeated ones too."""
    out, word = [], []
    for c in text.lower() + " ":
        if c.isalnum():
            word.append(c)
        elif word:
            t = f"  {''.join(word)} "
            out += [t[i : i + 3] for i in range(len(t) - 2)]
            word = []
    return out


def run_similarity(q: frozenset[str], seq: list[str]) -> float:
    """The largest |q & E| / |q | E| over runs E of seq."""
    at = [i for i, g in enumerate(seq) if g in q]
    best = 0.0
    for i, lo in enumerate(at):  # a best run begins and ends with a common trigram
        if (len(at) - i) / len(q) <= best:
            break
        common, others = set(), set()
        end = lo
        for hi in at[i:]:
            others.update(seq[end:hi])
            common.add(seq[hi])
            end = hi + 1
            best = max(best, len(common) / (len(q) + len(others)))
    return float(np.float32(best))


def word_similarity_of(query: str, text: str) -> float:
    """The largest |Q & E| / |Q | E| over runs E of the text's trigrams in order."""
    q = frozenset(padded_trigrams(query))
    return run_similarity(q, padded_trigrams(text)) if q else 0.0


def _lcs(a: str, b: str) -> int:
    """Longest common subsequence, bit-parallel."""
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    s = full
    for c in b:
        u = s & masks.get(c, 0)
        s = ((s + u) | (s - u)) & full
    return len(a) - s.bit_count()


def token_set_ratio_of(a: str, b: str) -> float:
    """0 to 100: the best of comparing the common tokens, with and without each side's own ones."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, only_x, only_y = sorted(x & y), " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and (not only_x or not only_y):
        return 100.0
    s = len(" ".join(both))
    gap = 1 if both else 0
    nx, ny = s + gap + len(only_x), s + gap + len(only_y)
    indel = len(only_x) + len(only_y) - 2 * _lcs(only_x, only_y)
    best = 100 - 100 * indel / (nx + ny)
    if both:
        best = max(best, 100 - 100 * (gap + len(only_x)) / (s + nx), 100 - 100 * (gap + len(only_y)) / (s + ny))
    return best


@pandas_udf(DoubleType())
def token_set_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([token_set_ratio_of(p or "", q or "") for p, q in zip(a, b, strict=True)], dtype="float64")
