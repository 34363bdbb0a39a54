"""Text functions as column expressions: tokens, number tests, names of exercises, formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import IndexConfig

#: ASCII punctuation.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokenize(text, config: IndexConfig | None = None) -> Column:
    """Lower case, no ASCII punctuation, no stop words or short words, single spaces; null if nothing is left."""
    config = config or IndexConfig()
    words = F.split(F.trim(F.translate(F.lower(col(text).cast("string")), PUNCTUATION, "")), r"\s+")
    if config.stemmer is not None:
        from .stemming import stem_words

        words = stem_words(words, config.stemmer)
    stop = F.array(*map(F.lit, stemmed_stop_words(config))) if config.stop_words else F.array().cast("array<string>")
    kept = F.filter(words, lambda w: (F.length(w) >= max(1, config.min_word_len)) & ~F.array_contains(stop, w))
    return F.nullif(F.array_join(kept, " "), F.lit(""))


def stemmed_stop_words(config: IndexConfig) -> list[str]:
    if config.stemmer is None:
        return list(config.stop_words)
    from .stemming import stemmer

    return sorted({stemmer(config.stemmer)(w) for w in config.stop_words})


def standard_tokens(text, config: IndexConfig | None = None) -> Column:
    """Words of letters, digits and inner apostrophes or dots, lower-cased, without stop words, joined by a space; '' if none."""
    config = config or IndexConfig()
    text = F.coalesce(col(text).cast("string"), F.lit(""))
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+(?:['’.][\p{L}\p{N}_]+)*"), F.lit(0))
    return F.array_join(F.filter(words, lambda w: ~F.array_contains(F.array(*map(F.lit, config.stop_words)), w)), " ")


#: What reads as a decimal number: digits with single underscores between them, a point, an exponent, or inf and nan.
_DIGITS = r"[0-9](?:_?[0-9])*"
_FLOAT = rf"(?i)^[+-]?(?:(?:{_DIGITS}\.?(?:{_DIGITS})?|\.{_DIGITS})(?:e[+-]?{_DIGITS})?|inf|infinity|nan)$"
_DATE = r"^[0-9]{1,4}[-/.][0-9]{1,2}[-/.][0-9]{1,4}$"
_SEPARATED = r"^[0-9\s,.]+$"


def is_numeric_like(value) -> Column:
    """Numbers (comma as point, spaces within), dates by digits, digit groups; null counts as no number."""
    s = F.regexp_replace(F.coalesce(col(value).cast("string"), F.lit("")), r"^[\s ]+|[\s ]+$", "")
    cleaned = F.trim(F.translate(s, ",  ", "."))
    return cleaned.rlike(_FLOAT) | s.rlike(_DATE) | (s.rlike(_SEPARATED) & s.rlike("[0-9]"))


def is_strict_number(value) -> Column:
    """What a numeric parser takes as it is, white space around allowed; nan is no number."""
    s = F.trim(F.coalesce(col(value).cast("string"), F.lit("")))
    return s.rlike(r"(?i)^[+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:e[+-]?[0-9]+)?|inf|infinity)$")


def is_blank(value) -> Column:
    return col(value).isNull() | col(value).rlike(r"^\s*$")


def normalized(value) -> Column:
    """For comparisons in evaluations: trimmed, lower case."""
    return F.lower(F.trim(col(value)))


def is_first_row(position) -> Column:
    """Header positions that name the first row, whatever their case and the punctuation around them."""
    return F.coalesce(F.lower(F.regexp_replace(F.trim(col(position)), r"^[!-/:-@\[-`{-~]+|[!-/:-@\[-`{-~]+$", "")) == "first_row", F.lit(False))


def unquoted(value) -> Column:
    return F.regexp_replace(col(value), '^"+|"+$', "")


def exercise_name(path) -> Column:
    """The file's name without folder, extension and the mark of tokenised files."""
    return F.regexp_replace(F.regexp_extract(col(path), r"([^/]*?)(?:\.csv)?$", 1), "_tokenized$", "")


def input_columns(name) -> Column:
    """How many input columns an exercise has: the underscores before the first 2, plus one."""
    left = F.substring_index(col(name), "2", 1)
    return F.length(left) - F.length(F.replace(left, F.lit("_"), F.lit(""))) + 1


def exercise_title(name) -> Column:
    return F.replace(F.replace(col(name), F.lit("_"), F.lit(" & ")), F.lit("2"), F.lit(" → "))


def candidate_label(y, score) -> Column:
    return F.format_string("%s (%.2f)", col(y), col(score))


def candidate_of_label(label) -> Column:
    """The candidate in a label, whatever brackets it holds itself."""
    return F.regexp_replace(col(label), r" \([^(]*$", "")
