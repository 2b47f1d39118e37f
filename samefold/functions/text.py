"""Folding of text, as column expressions."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F


def _plain(char: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", char) if not unicodedata.combining(c))


_SYLLABLES, _SYLLABLES_END = 0xAC00, 0xD7A4  # Hangul decomposes by arithmetic


@cache
def _tables() -> tuple[str, str, dict[str, str]]:
    """From Unicode's decompositions: characters that fold to one other, what they fold to (combining
    marks, last, to nothing), and those that fold to several or, without being marks, to none."""
    single, gone, several = {"ł": "l", "Ł": "L"}, [], {"ß": "ss"}
    for code in (*range(0x80, _SYLLABLES), *range(_SYLLABLES_END, 0xD800), *range(0xE000, 0x30000)):
        c = chr(code)
        p = _plain(c)
        if unicodedata.combining(c):
            gone.append(c)
        elif p != c and len(p) == 1:
            single[c] = p
        elif p != c:
            several[c] = p
    return "".join(single) + "".join(gone), "".join(single.values()), several


def _class(chars) -> str:
    """A character class of the given characters, as ranges."""
    codes, out = sorted(map(ord, chars)), []
    for c in codes:
        if out and out[-1][1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in out) + "]"


def _expanded(c: Column, odd: str, several: dict[str, str]) -> Column:
    """Each character that folds to several ones written out: one pass for each distinct one there is."""
    # one literal that the optimizer folds to a map, not thousands of them
    pairs = F.str_to_map(F.lit("\1".join(f"{k}\2{v}" for k, v in several.items())), F.lit("\1"), F.lit("\2"))
    return F.aggregate(F.array_distinct(F.regexp_extract_all(c, F.lit(odd), F.lit(0))), c, lambda s, k: F.replace(s, k, F.coalesce(F.try_element_at(pairs, k), F.lit(""))))


def _letters(c: Column) -> Column:
    """Hangul syllables as their letters: lead, vowel, and tail if there is one."""
    jamo = lambda first, n: F.lit("".join(map(chr, range(first, first + n))))
    place = lambda k: F.ascii(k) - _SYLLABLES
    part = lambda letters, at: F.substring(letters, at + 1, F.lit(1))

    def spelled(k: Column) -> Column:
        n = place(k)
        tail = F.when(n % 28 > 0, part(jamo(0x11A8, 27), n % 28 - 1)).otherwise("")
        return F.concat(part(jamo(0x1100, 19), F.floor(n / 588).cast("int")), part(jamo(0x1161, 21), F.floor(n % 588 / 28).cast("int")), tail)

    syllables = F.regexp_extract_all(c, F.lit("[\\x{ac00}-\\x{d7a3}]"), F.lit(0))
    return F.aggregate(F.array_distinct(syllables), c, lambda s, k: F.replace(s, k, spelled(k)))


def unaccent(c: Column) -> Column:
    """ß to ss, ł to l, then compatibility decomposition without combining marks; case stays.

    Built-in functions only, by tables made from Unicode's own; the rare steps run only on texts that
    hold such characters."""
    source, target, several = _tables()
    odd = _class(several)
    plain = F.when(c.rlike(odd), _expanded(c, odd, several)).otherwise(c)
    plain = F.when(c.rlike("[\\x{ac00}-\\x{d7a3}]"), _letters(plain)).otherwise(plain)
    return F.when(c.rlike("[^\\x00-\\x7F]"), F.translate(plain, source, target)).otherwise(c)


def fold_plain(c: Column) -> Column:
    """fold() of text that is unaccented and lower-cased already."""
    c = F.regexp_replace(c, r"(?U)[^\w&+.]+", " ")
    c = F.regexp_replace(c, r"(?U)(?<!\d)\.|\.(?!\d)", " ")
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def fold(c: Column) -> Column:
    """Unaccented, lower case; other characters than word characters, &, + and the dot inside a number
    become blanks; blanks collapse."""
    return fold_plain(F.lower(unaccent(c)))
