"""String expressions shared by the street and number rules."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as a Unicode-aware trim sees it; Java's \s alone is ASCII.
WS_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
WS = f"[{WS_CHARS}]"

# Bulgarian transliteration.
LATIN = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ж": "zh", "з": "z",
    "и": "i", "й": "y", "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p",
    "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f", "х": "h", "ц": "ts", "ч": "ch",
    "ш": "sh", "щ": "sht", "ъ": "a", "ь": "y", "ю": "yu", "я": "ya",
}


def search_key(text: Column) -> Column:
    """Lower case, Cyrillic to Latin; anything outside the table stays as it is."""
    single = {c: t for c, t in LATIN.items() if len(t) == 1}
    key = F.translate(F.lower(text), "".join(single), "".join(single.values()))
    for letter, latin in LATIN.items():
        if len(latin) > 1:
            key = F.replace(key, F.lit(letter), F.lit(latin))
    return key


def lstrip(text: Column) -> Column:
    return F.ltrim(text, F.lit(WS_CHARS))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WS_CHARS))


def alternatives(words: Sequence[str]) -> str:
    """Literal words as one regex branch, longest first."""
    return "|".join(re.escape(w) for w in sorted(words, key=len, reverse=True))
