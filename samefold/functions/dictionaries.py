"""The word lists of the normalisers. Keys are folded (lower case, no accents)."""

from __future__ import annotations

# Brand spellings and the brand they stand for.
BRAND_ALIASES = {
    "hewlett packard": "hp", "hewlett packard enterprise": "hpe", "hp inc": "hp", "samsung electronics": "samsung", "lg electronics": "lg",
    "procter & gamble": "p&g", "procter and gamble": "p&g", "robert bosch": "bosch", "bosch professional": "bosch", "makita": "makita",
    "de longhi": "delonghi", "philips": "philips", "koninklijke philips": "philips", "asus": "asus", "asustek": "asus", "lenovo": "lenovo",
    "dell": "dell", "dell technologies": "dell", "apple": "apple", "sony": "sony", "canon": "canon", "nike": "nike", "adidas": "adidas",
    "whirlpool": "whirlpool", "electrolux": "electrolux", "aeg": "aeg", "karcher": "karcher", "dewalt": "dewalt", "de walt": "dewalt",
    "black & decker": "black decker", "black and decker": "black decker", "black+decker": "black decker",
}

# Colour words (English, Polish, German) and the English colour.
COLORS = {
    "black": "black", "czarny": "black", "czarna": "black", "czarne": "black", "schwarz": "black",
    "white": "white", "bialy": "white", "biala": "white", "biale": "white", "weiss": "white",
    "red": "red", "czerwony": "red", "czerwona": "red", "czerwone": "red", "rot": "red",
    "blue": "blue", "niebieski": "blue", "niebieska": "blue", "niebieskie": "blue", "blau": "blue",
    "green": "green", "zielony": "green", "zielona": "green", "zielone": "green", "grun": "green",
    "yellow": "yellow", "zolty": "yellow", "zolta": "yellow", "zolte": "yellow", "gelb": "yellow",
    "grey": "grey", "gray": "grey", "szary": "grey", "szara": "grey", "szare": "grey", "grau": "grey",
    "silver": "silver", "srebrny": "silver", "srebrna": "silver", "silber": "silver",
    "gold": "gold", "zloty": "gold", "zlota": "gold", "brown": "brown", "brazowy": "brown", "braun": "brown",
    "pink": "pink", "rozowy": "pink", "rosa": "pink", "orange": "orange", "pomaranczowy": "orange",
    "purple": "purple", "fioletowy": "purple", "violett": "purple", "lila": "purple",
    "beige": "beige", "bezowy": "beige", "navy": "navy", "granatowy": "navy",
}

# Legal forms that are no part of a brand.
LEGAL_FORMS = [
    "sp z o o", "s a", "gmbh", "inc", "ltd", "llc", "sa", "co", "corp", "corporation", "ag", "plc", "srl", "bv", "kg", "spolka", "company", "limited", "incorporated",
]

# Words without weight in a name.
STOPWORDS = [
    "new", "original", "the", "for", "with", "and", "of", "a", "an", "nowy", "nowa", "nowe", "oryginalny", "oryginalna", "oryginalne",
    "dla", "do", "z", "ze", "i", "na", "w", "oraz", "neu", "fur", "mit", "und", "der", "die", "das", "von",
]

# Units that are written against their number.
UNITS = [
    "l", "ml", "cl", "g", "kg", "mg", "mm", "cm", "m", "km", "w", "kw", "v", "a", "ah", "mah", "wh", "kwh", "gb", "tb", "mb",
    "hz", "ghz", "mhz", "mp", "mpx", "cal", "kcal", "oz", "lb", "lbs", "szt", "pcs", "stk",
]

KNOWN_BRANDS = sorted({*BRAND_ALIASES, *BRAND_ALIASES.values()})

_ALL = {"brand_aliases": BRAND_ALIASES, "colors": COLORS, "legal_forms": LEGAL_FORMS, "stopwords": STOPWORDS, "units": UNITS}


def dictionary(name: str):
    """A copy of a word list by name."""
    if name not in _ALL:
        raise ValueError(f"unknown dictionary {name!r}; known: {', '.join(_ALL)}")
    return _ALL[name].copy()
