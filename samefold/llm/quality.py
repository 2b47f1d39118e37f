"""Quality rules: a ledger of failure bits and measurements, read by versioned policies.

`ledger` evaluates every rule once for each text and stores one bit for each failed rule beside the
measurements. A policy is a named mask of rules, so a verdict is one bitwise AND over the ledger,
and `ablation` finds what each rule changes under a policy from the counts of distinct bit patterns
alone, without touching a text again.

Null and empty texts have no words and fail rule few_words. Whole texts are measured; repeated rows
give repeated results.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from samefold.llm.common import arrow_map, documents, staged, utf8

WINDOW = 8
SYMBOLS = b"#*$%&|<>"
_BLANKS = b" \t\n\x0b\x0c\r"
_UPPER = bytes(range(65, 91))
_LETTERS = _UPPER + bytes(range(97, 123))
_WORD_LINE = re.compile(rb"[^\x20\x09-\x0D]")

#: The rules by bit; each is a test on the measurements.
RULES: dict[str, str] = {
    "few_words": "n_words < 20",
    "repeats": "100 * n_repeat_words > 30 * n_words",
    "symbols": "10 * n_symbols > 3 * n_words",
    "dup_lines": "10 * n_dup_lines > 5 * n_lines",
    "long_words": "word_chars > 20 * n_words",
    "short_words": "word_chars < 2 * n_words",
    "shouting": "n_letters >= 50 AND 10 * n_upper > 6 * n_letters",
    "exclaiming": "10 * n_exclaims > 5 * n_words",
}
BIT = {name: 1 << k for k, name in enumerate(RULES)}
#: Versioned policies: the rules whose failure rejects a text.
POLICIES: dict[str, tuple[str, ...]] = {"base": ("few_words", "repeats"), "v1": tuple(RULES)}

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_upper", "n_exclaims")


class _WordHash(dict):
    """64-bit hash of a word; the cache is emptied when it is full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 400_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_HASH = _WordHash()
_ODD = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) | 1 for k in range(1, WINDOW + 1)], dtype=np.uint64)


def repeated_words(words: list[bytes]) -> int:
    """Words inside windows of eight words that occur at least twice in the list."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    h = np.fromiter(map(_HASH.__getitem__, words), np.uint64, len(words))
    w = h[:n] * _ODD[0]
    for k in range(1, WINDOW):
        w += h[k : n + k] * _ODD[k]
    order = np.argsort(w, kind="stable")
    same = w[order[1:]] == w[order[:-1]]
    if not same.any():
        return 0
    maybe = np.zeros(n, bool)
    maybe[order[1:][same]] = True
    maybe[order[:-1][same]] = True
    first: dict[tuple, int] = {}
    covered = np.zeros(len(words) + 1, np.int64)
    again: set[int] = set()
    for i in np.flatnonzero(maybe).tolist():  # equal hashes are compared word by word
        j = first.setdefault(tuple(words[i : i + WINDOW]), i)
        if j != i:
            again.update((i, j))
    for i in again:
        covered[i] += 1
        covered[i + WINDOW] -= 1
    return int((np.cumsum(covered) > 0).sum())


def _without(data: bytes, drop: bytes) -> int:
    return len(data) - len(data.translate(None, drop))


def measure(text: str | None) -> tuple[int, ...]:
    data = utf8(text)
    words = data.split()
    lines = [x for x in data.split(b"\n") if _WORD_LINE.search(x)]
    return (
        len(words),
        len(text or "") - _without(data, _BLANKS),
        _without(data, SYMBOLS),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        _without(data, _LETTERS),
        _without(data, _UPPER),
        data.count(b"!"),
    )


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements, failure_bits: one row for each row of docs (doc_id, text). No shuffle."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [measure(t) for t in batch.column(1).to_pylist()]
        cols = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *cols], ["doc_id", *MEASURES])

    out = arrow_map(docs.select("doc_id", "text"), "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES), one)
    bits = " + ".join(f"CASE WHEN {test} THEN {BIT[name]}L ELSE 0L END" for name, test in RULES.items())
    return out.withColumn("failure_bits", F.expr(bits))


def mask(policy: str) -> int:
    return sum(BIT[name] for name in POLICIES[policy])


def fails(policy: str) -> Column:
    return F.col("failure_bits").bitwiseAND(F.lit(mask(policy)).cast("long")) != 0


def ablation(found: DataFrame, policy: str) -> DataFrame:
    """For each rule of a policy: rows that fail it, that fail it alone, and that the policy keeps
    with and without it. One pre-aggregated count for each of at most 2 ** len(RULES) patterns."""
    patterns = found.groupBy(F.col("failure_bits").bitwiseAND(F.lit(mask(policy)).cast("long")).alias("bits")).count()
    rules = F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(BIT[r]).cast("long").alias("bit")) for r in POLICIES[policy]))
    total = lambda test: F.coalesce(F.sum(F.when(test, F.col("count"))), F.lit(0)).cast("long")
    bits, bit = F.col("bits"), F.col("r.bit")
    return (
        patterns.select("bits", "count", F.explode(rules).alias("r"))
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(
            total(bits.bitwiseAND(bit) != 0).alias("n_failed"),
            total(bits == bit).alias("n_failed_alone"),
            total(bits == 0).alias("n_kept"),
            total(bits.bitwiseAND(F.bitwise_not(bit)) == 0).alias("n_kept_without"),
        )
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        fails("base").alias("base_failed"), (~fails("v1")).alias("kept"), "failure_bits",
    )


def ablation_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every policy's ablation over all documents, from one ledger."""
    found = staged(ledger(documents(spark, sf_dir)).select("failure_bits"), "ledger")
    out = None
    for policy in POLICIES:
        one = ablation(found, policy).select(F.lit(policy).alias("policy"), "*")
        out = one if out is None else out.unionByName(one)
    return out


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
wins AS (SELECT r, unnest(range(1, greatest(len(ws) - 6, 1)::BIGINT)) AS i, ws FROM d),
g AS (SELECT r, list_slice(ws, i, i + 7) AS w, list(i) AS places FROM wins GROUP BY ALL HAVING count(*) > 1),
rep AS (
  SELECT r, count(DISTINCT p) AS n FROM (
    SELECT r, unnest(range(i, i + 8)) AS p FROM (SELECT r, unnest(places) AS i FROM g)) GROUP BY r),
l AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d),
lines AS (
  SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
m AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words,
    length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
    coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
    coalesce(n_lines, 0)::BIGINT AS n_lines,
    length(regexp_replace(text, '[^A-Za-z]+', '', 'g'))::BIGINT AS n_letters,
    length(regexp_replace(text, '[^A-Z]+', '', 'g'))::BIGINT AS n_upper,
    length(regexp_replace(text, '[^!]+', '', 'g'))::BIGINT AS n_exclaims
  FROM d LEFT JOIN rep USING (r) LEFT JOIN lines USING (r)),
b AS (SELECT *, (""" + " + ".join(f"CASE WHEN {t} THEN {BIT[r]} ELSE 0 END" for r, t in RULES.items()) + r""")::BIGINT AS failure_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (failure_bits & 3) <> 0 AS base_failed, failure_bits = 0 AS kept, failure_bits
FROM b
"""

_MASKS = ", ".join(f"('{p}', '{r}', {BIT[r]}, {mask(p)})" for p in POLICIES for r in POLICIES[p])
ABLATION_SQL = f"""
WITH l AS (SELECT failure_bits AS f FROM ({SQL})), r(policy, rule, bit, m) AS (VALUES {_MASKS})
SELECT policy, rule, count(*) FILTER ((f & bit) <> 0)::BIGINT AS n_failed, count(*) FILTER ((f & m) = bit)::BIGINT AS n_failed_alone,
  count(*) FILTER ((f & m) = 0)::BIGINT AS n_kept, count(*) FILTER ((f & m & ~bit::BIGINT) = 0)::BIGINT AS n_kept_without FROM l, r GROUP BY policy, rule
"""
