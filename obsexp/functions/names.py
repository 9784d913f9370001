"""Match-key normalisation: one spelling per entity across sources."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator, Mapping
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters that have no accent decomposition, written out as the match key spells them.
BASE_LETTERS = {"ı": "i", "ø": "o", "đ": "d", "ł": "l", "ß": "ss"}
DROPPED_MARKS = ".'`"
SUFFIXES = ("jr", "sr", "ii", "iii", "iv", "v")

# Known alternative spellings, by normalised form.
KEY_FIXES = {
    "dirk nowtizski": "dirk nowitzki",
    "danilo gallinai": "danilo gallinari",
    "mnta ellis": "monta ellis",
    "jimmer dredette": "jimmer fredette",
    "dwayne wade": "dwyane wade",
    "steve adams": "steven adams",
    "time hardaway": "tim hardaway",
    "nerles noel": "nerlens noel",
    "beno urdih": "beno udrih",
    "jon ingles": "joe ingles",
    "jose juan barea": "jj barea",
    "jose barea": "jj barea",
    "nene hilario": "nene",
    "enes kanter": "enes freedom",
}

_LATIN = [(0x00C0, 0x024F), (0x1E00, 0x1EFF)]
_COMBINING = (0x0300, 0x036F)


@cache
def _accent_table() -> tuple[str, str]:
    """Lower-case accented Latin letters and their base letters, derived from Unicode; combining marks map to nothing."""
    source, target = [], []
    for lo, hi in _LATIN:
        for point in range(lo, hi + 1):
            letter = chr(point)
            base = "".join(ch for ch in unicodedata.normalize("NFKD", letter) if not unicodedata.combining(ch))
            if len(base) == 1 and base != letter:
                source.append(letter)
                target.append(base)
    marks = [chr(p) for p in range(_COMBINING[0], _COMBINING[1] + 1)]
    return "".join(source + marks), "".join(target)


@F.pandas_udf(T.StringType())
def _strip_any_script(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        folded = texts.str.normalize("NFKD")
        yield folded.map(lambda s: "".join(ch for ch in s if not unicodedata.combining(ch)), na_action="ignore")


def normalise_key(c: Column | str, fixes: Mapping[str, str] | None = None, any_script: bool = False) -> Column:
    """Lower-case key without accents, punctuation or generational suffix, then corrected by ``fixes``.

    Latin text stays in the JVM. ``any_script`` decomposes every script through an Arrow-batched function instead.
    """
    text = F.col(c) if isinstance(c, str) else c
    if any_script:
        text = _strip_any_script(text)
    else:
        text = F.translate(text, *_accent_table())
    text = F.trim(F.lower(text))
    single = {k: v for k, v in BASE_LETTERS.items() if len(v) == 1}
    text = F.translate(text, "".join(single), "".join(single.values()))
    for letter, spelled in BASE_LETTERS.items():
        if len(spelled) > 1:
            text = F.replace(text, F.lit(letter), F.lit(spelled))
    text = F.translate(text, "-" + DROPPED_MARKS, " ")
    text = F.regexp_replace(text, r"\s+(" + "|".join(SUFFIXES) + r")$", "")
    text = F.trim(F.regexp_replace(text, r"\s+", " "))
    fixes = KEY_FIXES if fixes is None else fixes
    if not fixes:
        return text
    table = F.create_map(*[F.lit(part) for pair in fixes.items() for part in pair])
    return F.coalesce(F.try_element_at(table, text), text)
