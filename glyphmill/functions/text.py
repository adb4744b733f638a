"""Text cleaning, tokenisers and n-grams as Column expressions (no UDFs). Null text is empty text everywhere."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: English stop words, frozen here so that results don't change with a library's list.
STOP_WORDS = tuple(
    "a about above after again against all am an and any are as at be because been before being below between both but by can did do does doing down "
    "during each few for from further had has have having he her here hers him his how i if in into is it its itself just me more most my no nor not "
    "now of off on once only or other our ours out over own same she should so some such than that the their theirs them then there these they this "
    "those through to too under until up very was we were what when where which while who whom why will with you your yours".split()
)
#: What the page cleaner removes after tags, in this order.
PAGE_RESIDUES = ("&nbsp;", "nbsp;", "<b", "<br", "br>")
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
REPORT_MARKS = "{}&%@/#!\\_[]$"


def _text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def clean_ascii(c: Column | str) -> Column:
    """Digits go, runs of non-ASCII characters become a space, tags go, in this order."""
    out = F.regexp_replace(_text(c), "[0-9]+", "")
    return F.regexp_replace(F.regexp_replace(out, r"[^\x00-\x7F]+", " "), "(?d)<.*?>", "")


def clean_page(c: Column | str) -> Column:
    """Digits go, tags become a space, then PAGE_RESIDUES go one after another; non-ASCII characters stay."""
    out = F.regexp_replace(F.regexp_replace(_text(c), "[0-9]+", ""), "(?d)<.*?>", " ")
    for residue in PAGE_RESIDUES:
        out = F.replace(out, F.lit(residue))
    return out


def with_title(title: Column | str, c: Column | str) -> Column:
    return F.concat_ws(" ", _text(title), _text(c))


def words2(c: Column, lower: bool = True) -> Column:
    """Runs of at least two word characters."""
    return F.regexp_extract_all(F.lower(c) if lower else c, F.lit("[A-Za-z0-9_]{2,}"), F.lit(0))


def words_nonspace(c: Column) -> Column:
    return F.regexp_extract_all(_text(c), F.lit(r"[^ \t\n\r\f\x0B]+"), F.lit(0))


def words_no_punctuation(c: Column) -> Column:
    """Punctuation is deleted first, so "don't" is one word; words are lower case, cut at single spaces."""
    return F.filter(F.transform(F.split(F.translate(_text(c), PUNCTUATION, ""), " ", -1), F.lower), lambda w: w != "")


def words_and_marks(c: Column) -> Column:
    """Words, and each other non-space character by itself: close to a treebank tokeniser in the number of tokens."""
    return F.regexp_extract_all(_text(c), F.lit(r"[A-Za-z0-9_]+|[^A-Za-z0-9_ \t\n\r\f\x0B]"), F.lit(0))


def without_stop_words(words: Column) -> Column:
    return F.filter(words, lambda w: ~F.lower(w).isin(*STOP_WORDS))


def ngrams(words: Column, low: int, high: int) -> Column:
    """All n-grams of `low` to `high` words, joined by a space, by length, then place. Shorter arrays give none."""
    def of(n: int) -> Column:
        grams = F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, n), " "))
        return F.when(F.size(words) >= n, grams).otherwise(F.array().cast("array<string>"))

    by_n = [of(n) for n in range(low, high + 1)]
    return F.concat(*by_n)


def split_at(c: Column, marker: Column) -> Column:
    """The parts of a text between the occurrences of a literal marker."""
    literal = F.concat(F.lit("\\Q"), F.replace(marker, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    return F.split(c, literal, F.lit(-1))


def with_bounds(words: Column) -> Column:
    return F.concat(F.array(F.lit("<s>")), words, F.array(F.lit("</s>")))


def soften_marks(c: Column | str) -> Column:
    """Marks that a typesetter would stumble over become full stops."""
    return F.translate(_text(c), REPORT_MARKS, "." * len(REPORT_MARKS))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; null if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union)
