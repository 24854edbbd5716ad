"""Text preparation as native column expressions (no UDF, all inside code generation)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as p


# The white space of ``patterns.WS`` the way the JVM tests it fastest: under (?U) its own ``\\s`` is the
# same set but for four control characters. Portable classes give equal matches, three times slower.
_SPACE = r"\s\x1C-\x1F"
_TOKEN = rf"(?U)[^{_SPACE}]++"
_URL = rf"(?U)(?:http|www)[^{_SPACE}]++"
_PUNCT = rf"[^{p.WORD}{_SPACE}]"


def _words_pattern(words: tuple[str, ...]) -> str:
    """A whole white-space token out of ``words``, with the white space before it. Each first letter is tried once."""
    rests = {}
    for word in words:
        rests.setdefault(word[0], []).append(word[1:])
    listed = "|".join(f"{first}(?:{'|'.join(rest)})" for first, rest in rests.items())
    return rf"(?U)[{_SPACE}]({listed})(?![^{_SPACE}])"


def strip(c: Column) -> Column:
    """Cut every kind of white space off both ends; ``trim`` alone only cuts U+0020."""
    return F.btrim(c, F.lit(p.WHITESPACE_CHARS))


def strip_urls(c: Column) -> Column:
    # most texts hold no URL, and looking for a fixed word is far cheaper than a pattern
    has = F.contains(c, F.lit("http")) | F.contains(c, F.lit("www"))
    return F.when(has, F.regexp_replace(c, _URL, "")).otherwise(c)


def strip_mentions(c: Column) -> Column:
    return F.when(F.contains(c, F.lit("@")), F.regexp_replace(c, p.MENTION, "")).otherwise(c)


def strip_hashes(c: Column) -> Column:
    return F.replace(c, F.lit("#"), F.lit(""))


def strip_punct(c: Column) -> Column:
    """Delete each character that is neither a word character nor white space."""
    return F.regexp_replace(c, rf"(?U){_PUNCT}", "")


def letters_only(c: Column) -> Column:
    """ASCII letters with single spaces between the runs."""
    return F.trim(F.regexp_replace(c, p.NOT_LETTERS, " "))


def expand_contractions(c: Column) -> Column:
    written = c
    for short, long in p.CONTRACTIONS:
        written = F.replace(written, F.lit(short), F.lit(long))
    # each of them ends so: one look-up instead of three where a text has none
    return F.when(F.contains(c, F.lit("'t")), written).otherwise(c)


def normalised(c: Column) -> Column:
    """Lower case with contractions written out: what the lexicons are counted on."""
    return expand_contractions(F.lower(c))


def lexicon_count(c: Column, words: tuple[str, ...]) -> Column:
    """How many white-space tokens of ``c`` are in ``words``; ``great,`` is not ``great``."""
    return F.regexp_count(F.concat(F.lit(" "), c), F.lit(_words_pattern(words)))


def lexicon_counts(c: Column) -> tuple[Column, Column]:
    """Positive and negative tokens of ``c``: one scan finds both, the few finds are then told apart."""
    pattern = _words_pattern(p.POSITIVE_WORDS + p.NEGATIVE_WORDS)
    hits = F.array_join(F.regexp_extract_all(F.concat(F.lit(" "), c), F.lit(pattern), F.lit(1)), " ")
    return lexicon_count(hits, p.POSITIVE_WORDS), lexicon_count(hits, p.NEGATIVE_WORDS)


def lexicon_suffix(pos: Column, neg: Column) -> Column:
    return (
        F.when((pos > neg) & (pos >= p.MIN_HITS), F.lit(" positive"))
        .when((neg > pos) & (neg >= p.MIN_HITS), F.lit(" negative"))
        .when(pos.isNotNull(), F.lit(""))
    )


def clean_basic(c: Column) -> Column:
    """Lower, drop URLs, mentions and punctuation, strip; inner white space stays.

    A hash sign is punctuation, and no mention starts inside another deletion, so one pass
    removes mentions and punctuation together.
    """
    return strip(F.regexp_replace(strip_urls(F.lower(c)), rf"(?U){p.MENTION}|{_PUNCT}", ""))


def clean_enhanced(c: Column) -> Column:
    """Contractions, lexicon counts, then letters only, then a tag word when the lexicons agree."""
    base = normalised(c)
    letters = letters_only(strip_hashes(strip_mentions(strip_urls(base))))
    return F.concat(letters, lexicon_suffix(*lexicon_counts(base)))


CLEANERS = {"basic": clean_basic, "enhanced": clean_enhanced}
#: Cleaners of which blanks are the only white space.
BLANKS_ONLY = ("enhanced",)


def exclamations_and_questions(c: Column) -> tuple[Column, Column]:
    """Counts of ``!`` and ``?`` in a text whose URLs, mentions and hash signs are gone."""
    bare = strip_hashes(strip_mentions(strip_urls(normalised(c))))
    return (
        F.length(bare) - F.length(F.replace(bare, F.lit("!"), F.lit(""))),
        F.length(bare) - F.length(F.replace(bare, F.lit("?"), F.lit(""))),
    )


def text_length(c: Column, missing: str | None = "nan") -> Column:
    """Code points. A missing text counts as the string ``nan``; ``missing=None`` keeps NULL."""
    return F.length(c if missing is None else F.coalesce(c, F.lit(missing)))


def word_count(c: Column, missing: str | None = "nan") -> Column:
    return F.regexp_count(c if missing is None else F.coalesce(c, F.lit(missing)), F.lit(_TOKEN))


def tokens(cleaned: Column, cleaner: str | None = None) -> Column:
    """Words of a cleaned text; runs of white space never give an empty word.

    Where its ``cleaner`` is said and leaves no white space but blanks, it is split at those, without a pattern.
    """
    return F.array_remove(F.split(cleaned, " " if cleaner in BLANKS_ONLY else rf"(?U)[{_SPACE}]+"), "")


def is_blank(c: Column) -> Column:
    return strip(c) == ""


def blank_guard(c: Column, answer: Column) -> Column:
    """The fixed message for a blank text, else ``answer``."""
    return F.when(is_blank(c), F.lit(p.BLANK_MESSAGE)).otherwise(answer)


def decode_label(pred: Column, classes: tuple[str, ...] = p.CLASSES) -> Column:
    """Class id to display name; an id outside the list is ``Unknown``."""
    names = F.create_map(*[F.lit(x) for i, name in enumerate(classes) for x in (i, name.capitalize())])
    return F.coalesce(F.try_element_at(names, pred), F.lit(p.UNKNOWN_LABEL))
