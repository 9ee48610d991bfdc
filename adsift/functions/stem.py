"""Porter stemming (1980) as a Column expression, with the common toolkit extensions.

Each step extracts the longest listed suffix, looks up its replacement and tests the remaining stem, all inside the
JVM. It is meant for a table of distinct words.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bound

# Suffix tables of the published algorithm and its extensions.
STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al",
    "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al",
    "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
    "fulli": "ful", "logi": "log",
}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = [
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti",
    "ous", "ive", "ize",
]
IRREGULAR = {
    "sky": "sky", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news", "innings": "inning",
    "inning": "inning", "outings": "outing", "outing": "outing", "cannings": "canning", "canning": "canning",
    "howe": "howe", "proceed": "proceed", "exceed": "exceed", "succeed": "succeed",
}
# A leading y is a consonant and is written Y while stemming.
_C, _V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
HAS_VOWEL = f"^(?:{_C})?[aeiouy]"
M_GT_0 = f"^(?:{_C})?{_V}{_C}"
M_EQ_1 = f"^(?:{_C})?{_V}{_C}(?:{_V})?$"
M_GT_1 = f"^(?:{_C})?{_V}{_C}{_V}{_C}"
# Consonant, vowel, consonant other than w, x, y (a y is a consonant after a vowel, else a vowel).
CVC = "(?:[^aeiouy]|[aeiou]y)[aeiouy][^aeiouwxy]$"
SHORT_VC = "^[aeiou][^aeiou]$"
FINAL_Y = "^.+[^aeiouy]y$|^.*[aeiou]yy$"


def longest_suffix(suffixes) -> str:
    return f"^.*?({'|'.join(sorted(suffixes, key=len, reverse=True))})$"


def _cut(word: Column, n) -> Column:
    return F.substring(word, F.lit(1), F.length(word) - (n if isinstance(n, Column) else F.lit(n)))


def _ends_cvc(w: Column) -> Column:
    return w.rlike(CVC) | w.rlike(SHORT_VC)


def _double(w: Column) -> Column:
    """The word ends in the same consonant twice."""
    return (F.substring(w, -1, 1) == F.substring(_cut(w, 1), -1, 1)) & w.rlike("[^aeiouy]$")


def _plural(w: Column) -> Column:
    return (
        F.when(w.endswith("ies") & (F.length(w) == 4), _cut(w, 1))
        .when(w.endswith("sses") | w.endswith("ies"), _cut(w, 2))
        .when(w.endswith("ss"), w)
        .when(w.endswith("s"), _cut(w, 1))
        .otherwise(w)
    )


def _past(w: Column) -> Column:
    """-ed and -ing after a stem with a vowel, and the repair of what is left."""
    trimmed = (
        F.when(w.endswith("ied") | w.endswith("eed"), F.lit(None).cast("string"))
        .when(w.endswith("ed"), F.when(_cut(w, 2).rlike(HAS_VOWEL), _cut(w, 2)))
        .when(w.endswith("ing") & _cut(w, 3).rlike(HAS_VOWEL), _cut(w, 3))
    )

    def mended(t: Column) -> Column:
        return (
            F.when(t.endswith("at") | t.endswith("bl") | t.endswith("iz"), F.concat(t, F.lit("e")))
            .when(_double(t), F.when(t.rlike("[lsz]$"), t).otherwise(_cut(t, 1)))
            .when(t.rlike(M_EQ_1) & _ends_cvc(t), F.concat(t, F.lit("e")))
            .otherwise(t)
        )

    return bound(
        trimmed,
        lambda t: F.when(w.endswith("ied"), F.when(F.length(w) == 4, _cut(w, 1)).otherwise(_cut(w, 2)))
        .when(w.endswith("eed"), F.when(_cut(w, 3).rlike(M_GT_0), _cut(w, 1)).otherwise(w))
        .when(t.isNotNull(), mended(t))
        .otherwise(w),
    )


def _final_y(w: Column) -> Column:
    return F.when(w.rlike(FINAL_Y), F.concat(_cut(w, 1), F.lit("i"))).otherwise(w)


def _alli(w: Column) -> Column:
    return F.when(w.endswith("alli") & _cut(w, 4).rlike(M_GT_0), _cut(w, 2)).otherwise(w)


def _replacing(table: dict[str, str]):
    def step(w: Column) -> Column:
        def swap(suffix: Column) -> Column:
            rest = _cut(w, F.length(suffix))
            # -logi is tested with its l kept in the stem.
            tested = F.when(suffix == "logi", _cut(w, 3)).otherwise(rest)
            new = F.coalesce(*[F.when(suffix == k, F.lit(v)) for k, v in table.items()])
            return F.when((suffix != "") & tested.rlike(M_GT_0), F.concat(rest, new)).otherwise(w)

        return bound(F.regexp_extract(w, longest_suffix(table), 1), swap)

    return step


def _long_stem(w: Column) -> Column:
    """Long stems lose one more suffix; -ion only after s or t."""

    def drop(suffix: Column) -> Column:
        rest = _cut(w, F.length(suffix))
        gone = (suffix != "") & rest.rlike(M_GT_1) & ((suffix != "ion") | rest.rlike("[st]$"))
        return F.when(gone, rest).otherwise(w)

    return bound(F.regexp_extract(w, longest_suffix(STEP4), 1), drop)


def _final_e(w: Column) -> Column:
    short = _cut(w, 1)
    gone = short.rlike(M_GT_1) | (short.rlike(M_EQ_1) & ~_ends_cvc(short))
    return F.when(w.endswith("e") & gone, short).otherwise(w)


def _final_ll(w: Column) -> Column:
    return F.when(w.endswith("ll") & _cut(w, 1).rlike(M_GT_1), _cut(w, 1)).otherwise(w)


STEPS = [_plural, _past, _final_y, _alli, _replacing(STEP2), _replacing(STEP3), _long_stem, _final_e, _final_ll]


def stem(word: Column) -> Column:
    """The stem of a lower-case word; each step binds the word once."""
    w = F.regexp_replace(word, "^y", "Y")
    for step in STEPS:
        w = bound(w, step)
    special = F.coalesce(*[F.when(word == k, F.lit(v)) for k, v in IRREGULAR.items()])
    return F.when(F.length(word) <= 2, word).otherwise(F.coalesce(special, F.regexp_replace(w, "^Y", "y")))
