"""Text preparation as Column expressions."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import banks

# One word character: letters, digits and underscore, without combining marks.
WORD = r"\p{L}\p{N}_"


_SEPARATOR = "\u0001"


def literal(items: list[str]) -> Column:
    """A constant array<string>: one foldable expression instead of one node an entry."""
    return F.split(F.lit(_SEPARATOR.join(items)), _SEPARATOR) if items else F.array().cast("array<string>")


def literal_rows(rows: list, ddl: str) -> Column:
    """A constant of any nested type, given as JSON values."""
    return F.from_json(F.lit(json.dumps(rows, ensure_ascii=False)), ddl)


# White space that stripping removes: ASCII, the separators U+001C..U+001F and U+0085, and the Unicode Z classes.
SPACES = (
    "\t\n\x0b\x0c\r \x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B)) + "\u2028\u2029\u202f\u205f\u3000"
)


def strip(text: Column) -> Column:
    """Remove leading and trailing white space of any kind."""
    return F.btrim(text, F.lit(SPACES))


def not_blank(text: Column) -> Column:
    """The text holds something besides white space; stops at the first such character."""
    return text.rlike(r"[^\s\x0b\x1c-\x1f\x85\p{Z}]")


def join_text(*cols: str) -> Column:
    """Join columns by one space, nulls as '', then strip."""
    return strip(F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in cols]))


def _drop_stop_words(text: Column) -> Column:
    kept = F.filter(F.split(text, r"\s+"), lambda w: (w != "") & ~w.isin(banks.STOP_WORDS))
    return F.array_join(kept, " ")


def normalise_jobs(text: Column) -> Column:
    """Lower, drop digits, collapse white space, drop punctuation, drop stop words: in this order."""
    out = F.regexp_replace(F.lower(text), r"\p{Nd}+", "")
    out = F.regexp_replace(out, r"\s+", " ")
    out = F.regexp_replace(out, rf"[^{WORD}\s]", "")
    return _drop_stop_words(out)


def normalise_sms(text: Column) -> Column:
    """Lower, drop punctuation (digits stay), drop stop words."""
    return _drop_stop_words(F.regexp_replace(F.lower(text), rf"[^{WORD}\s]", ""))


def tokens(text: Column) -> Column:
    """Lower-case runs of two or more word characters."""
    return F.regexp_extract_all(F.lower(text), F.lit(rf"([{WORD}]{{2,}})"), F.lit(1))


def learning_tokens(text: Column) -> Column:
    """Tokens of ASCII letters, digits and the rupee sign between word boundaries."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"((?U)\b[a-z₹\p{Nd}]+\b)"), F.lit(1))


def bound(value: Column, build) -> Column:
    """build(value), where value is evaluated once: a lambda would otherwise evaluate it again at every element."""
    return F.get(F.transform(F.array(value), build), 0)


def ngram_range(words: Column, low: int, high: int) -> Column:
    """All runs of n neighbouring words, joined by one space, for n = low .. high."""

    def runs(w: Column, n: int) -> Column:
        if n == 1:
            return w
        last = F.size(w) - n
        # sequence() counts down when its end is below its start, hence the guard.
        starts = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.concat_ws(" ", *[F.get(w, i + k) for k in range(n)]))

    if low == high == 1:
        return words
    return bound(words, lambda w: F.concat(*[runs(w, n) for n in range(low, high + 1)]))


def bag(terms: Column) -> Column:
    """Term counts of one text as array<struct<term, n>>.

    Sorting the array and measuring the runs keeps counting inside the row, so no shuffle is needed.
    """

    def starts(s: Column) -> Column:
        index = F.when(F.size(s) > 0, F.sequence(F.lit(0), F.size(s) - 1)).otherwise(F.array().cast("array<int>"))
        first = F.filter(index, lambda i: (i == 0) | (F.get(s, i) != F.get(s, F.greatest(i - 1, F.lit(0)))))
        return bound(first, lambda begins: lengths(s, begins))

    def lengths(s: Column, begins: Column) -> Column:
        return F.transform(
            begins,
            lambda b, k: F.struct(
                F.get(s, b).alias("term"),
                (F.coalesce(F.get(begins, k + 1), F.size(s)) - b).cast("bigint").alias("n"),
            ),
        )

    return bound(F.sort_array(terms), starts)


def positions(words: Column) -> Column:
    """The distinct words of one text with their places, as array<struct<word, at>>; grouped inside the row."""

    def starts(s: Column) -> Column:
        index = F.when(F.size(s) > 0, F.sequence(F.lit(0), F.size(s) - 1)).otherwise(F.array().cast("array<int>"))
        first = F.filter(
            index, lambda i: (i == 0) | (F.get(s, i)["word"] != F.get(s, F.greatest(i - 1, F.lit(0)))["word"])
        )
        return bound(first, lambda begins: places(s, begins))

    def places(s: Column, begins: Column) -> Column:
        return F.transform(
            begins,
            lambda b, k: F.struct(
                F.get(s, b)["word"].alias("word"),
                F.transform(
                    F.slice(s, b + 1, F.coalesce(F.get(begins, k + 1), F.size(s)) - b), lambda e: e["at"]
                ).alias("at"),
            ),
        )

    placed = F.transform(words, lambda w, i: F.struct(w.alias("word"), i.alias("at")))
    return bound(F.sort_array(placed), starts)


def phrases_in(text: Column, phrases: list[str]) -> Column:
    """The phrases that the lower-cased text contains, in list order (plain substring test).

    The bank is a literal array and the text is lowered once, so this needs no join and no shuffle.
    """
    bank = literal(phrases)
    return bound(F.lower(text), lambda low: F.filter(bank, lambda p: F.contains(low, p)))


def highlight(text: Column, phrases: list[str]) -> Column:
    """Mark the phrases that the text contains, one after the other, longest first, ignoring case."""
    matched = phrases_in(text, sorted(phrases, key=len, reverse=True))
    return F.aggregate(
        matched,
        text,
        lambda done, phrase: F.regexp_replace(
            done, F.concat(F.lit(r"(?i)\Q"), phrase, F.lit(r"\E")), F.lit("<mark>$0</mark>")
        ),
    )


def snippet(text: Column, chars: int = 200) -> Column:
    """The first characters of the stripped text."""
    return F.substring(strip(text), 1, chars)
