"""Normalisers and measures against literal cases and plain Python."""

import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from samefold.functions import dictionaries, identifiers, names, similarity, text


def column(spark, values, fn):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k long, v string")
    return [r.o for r in df.select("k", fn(F.col("v")).alias("o")).orderBy("k").collect()]


def test_dictionaries():
    assert set(dictionaries.COLORS.values()) <= set(dictionaries.COLORS) and len(set(dictionaries.UNITS)) == 34
    with pytest.raises(ValueError):
        dictionaries.dictionary("nothing")
    d = dictionaries.dictionary("colors")
    d.clear()
    assert dictionaries.COLORS


def test_unaccent(spark):
    words = ["żółć ŁÓDŹ", "Straße", "crème brûlée", "ﬁne ½", "Ångström ǅ", "naïve é", "x²", "plain", None, ""]

    def want(s):
        if s is None:
            return None
        s = s.replace("ß", "ss").replace("ł", "l").replace("Ł", "L")
        return "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))

    assert column(spark, words, text.unaccent) == [want(w) for w in words]


def test_fold(spark):
    cases = {
        "Żółta  Łódź!": "zolta lodz", "v1.5.2 beta": "v1.5.2 beta", ".5 l": "5 l", "P&G + co_op": "p&g + co_op", "a.b": "a b", "Ж-ab": "ж ab", "Weiß/Grün": "weiss grun", "  ": "", "2.0Ah": "2.0ah",
    }
    assert column(spark, list(cases), text.fold) == list(cases.values())


def test_gtin(spark):
    cases = {
        "5901234123457": ("05901234123457", True, True, False), "590-1234 123457": ("05901234123457", True, True, False), "5901234123458": ("", False, False, False),
        "96385074": ("00000096385074", True, True, False), "036000291452": ("00036000291452", True, True, False), "2012345678903": ("02012345678903", True, False, False),
        "15901234123454": ("15901234123454", True, False, True), "0000000000000": ("", False, False, False), "": ("", False, False, False), None: ("", False, False, False), "20123451": ("00000020123451", True, True, False),
    }
    got = column(spark, list(cases), identifiers.gtin)
    assert [tuple(g) for g in got] == list(cases.values())


def test_mpn(spark):
    cases = {"GSR 12V-35": ("GSR12V35", "GSR12V"), "000123": ("000123", "000123"), "0001234": ("1234", "1234"), " ab/c.d ": ("ABCD", "ABCD"), "-x": ("X", "X"), None: ("", ""), "  ": ("", "")}
    assert [tuple(g) for g in column(spark, list(cases), identifiers.mpn)] == list(cases.values())


def test_brand(spark):
    cases = {
        "Robert Bosch GmbH": "bosch", "Hewlett-Packard Inc.": "hp", "BLACK & DECKER": "black decker", "Coca Cola Co.": "coca cola", "Sp. z o.o.": "", "Kärcher AG": "karcher", "Salon A": "salon a", "Philips": "philips", None: "", "Costco": "costco",
    }
    assert column(spark, list(cases), names.brand) == list(cases.values())


def test_names(spark):
    cases = [
        ("Bosch GSR 12V-35 wiertarka niebieska 2x", "bosch", "gsr 12v 35 wiertarka", 2, "blue", "", "bosch"),
        ("Woda 1,5 l zestaw 6", "", "woda 1.5l", 6, "", "", ""),
        ("Koszulka M czarna", "", "koszulka", None, "black", "m", ""),
        ("Model S 2024", "", "model s 2024", None, "", "", ""),
        ("Buty rozmiar 42,5 białe", "", "buty", None, "white", "42.5", ""),
        ("Panel 50 x 100", "", "panel 50 x 100", None, "", "", ""),
        ("De Longhi Kettle 3-pack", "", "kettle", 3, "", "", "de longhi"),
        ("Socks 4 szt XL", "", "socks", 4, "", "xl", ""),
        ("The new original lamp for the desk", "", "lamp desk", None, "", "", ""),
        ("3 m cable", "", "3m cable", None, "", "", ""),
        (None, "", "", None, "", "", ""),
        ("   ", "acme", "", None, "", "", "acme"),
        ("pack 2x one 3x", "", "pack one 3x", 2, "", "", ""),
    ]
    df = spark.createDataFrame([(k, c[0], c[1]) for k, c in enumerate(cases)], "k long, raw string, b string")
    got = names.normalize_names(df, "raw", "b").orderBy("k").collect()
    for r, (raw, _, norm, pack, color, size, brand) in zip(got, cases, strict=True):
        assert (r.name_norm, r.name_pack, r.name_color, r.name_size) == (norm, pack, color, size), raw
        assert r.name_brand == brand, raw
        assert r.name_tokens == sorted(set(norm.split()))


def test_trigrams(spark):
    def plain(s):
        out = set()
        word = ""
        for c in s.lower() + " ":
            if c.isalnum():
                word += c
            elif word:
                t = f"  {word} "
                out |= {t[i : i + 3] for i in range(len(t) - 2)}
                word = ""
        return out

    values = ["word", "two words", "a.b&c_d", "", "żółw 1.5l", "  x "]
    got = column(spark, values, similarity.trigrams)
    assert [set(g) for g in got] == [plain(v) for v in values]
    df = spark.createDataFrame([("word", "two words")], "a string, b string")
    t = similarity.trigrams
    assert round(df.select(similarity.set_similarity(t(F.col("a")), t(F.col("b")))).first()[0], 4) == 0.3636


def test_word_similarity():
    assert round(similarity.word_similarity_of("word", "two words"), 4) == 0.8
    long = "kickscooter c2 pro kids 10.6mi range adjustable handlebar height refurbished"
    assert similarity.word_similarity_of("kickscooter c2", long) == 1.0
    assert 0.8 < similarity.word_similarity_of("kickscoter c2 pro", long) < 0.9
    rng = random.Random(1)

    def brute(q, t):
        a, seq = set(similarity.padded_trigrams(q)), similarity.padded_trigrams(t)
        return max((len(a & set(seq[i:j])) / len(a | set(seq[i:j])) for i in range(len(seq)) for j in range(i + 1, len(seq) + 1)), default=0.0)

    for _ in range(200):
        q, t = (" ".join("".join(rng.choices("abc", k=rng.randint(1, 4))) for _ in range(rng.randint(1, 4))) for _ in range(2))
        assert similarity.word_similarity_of(q, t) == pytest.approx(brute(q, t), abs=1e-6)


def test_token_set_ratio():
    r = similarity.token_set_ratio_of
    assert r("wiertarka udarowa bosch", "bosch wiertarka udarowa") == 100 == r("a b", "a b c")
    assert round(r("kettle", "blender"), 1) == 30.8 and r("lampa biurkowa led", "lampa sufitowa halogen") == 50.0 and r("", "a") == 0
    rng = random.Random(2)

    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            prev = 0
            for j, y in enumerate(b):
                prev, row[j + 1] = row[j + 1], prev + 1 if x == y else max(row[j + 1], row[j])
        return row[-1]

    for _ in range(300):
        a, b = ("".join(rng.choices("abcd ", k=rng.randint(0, 30))) for _ in range(2))
        assert similarity._lcs(a, b) == lcs(a, b)


def test_unaccent_over_all_characters(spark):
    def plain(s):
        s = s.replace("ß", "ss").replace("ł", "l").replace("Ł", "L")
        return "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))

    known = [chr(k) for k in range(0x30000) if not 0xD800 <= k < 0xE000 and unicodedata.category(chr(k)) != "Cn"]
    rows = ["x".join(known[k : k + 200]) for k in range(0, len(known), 200)] + ["straße Łódź ＡＢ１ 한국어", ""]
    df = spark.createDataFrame([(r,) for r in rows], "t string").repartition(4)
    assert all(r.u == plain(r.t) for r in df.select("t", text.unaccent(F.col("t")).alias("u")).collect())
