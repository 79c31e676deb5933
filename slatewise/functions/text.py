"""Text column expressions: cleaning, tokenising (all JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from slatewise.functions.common import col_

# English stop words removed by ``clean_text`` (our own short list;
# the same list is inlined in the oracle SQL).
STOP_WORDS = [
    "a", "an", "the", "and", "or", "but", "if", "of", "to", "in", "on", "at", "by",
    "for", "with", "from", "as", "is", "are", "was", "were", "be", "been", "it",
    "its", "this", "that", "these", "those", "he", "she", "they", "we", "you", "i",
    "not", "no", "so", "than", "then", "there", "their", "his", "her", "our", "your",
    "which", "who", "what", "when", "where", "how", "all", "any", "can", "will",
    "do", "does", "did", "has", "have", "had",
]

# characters kept by cleaning: ASCII letters and ASCII whitespace (as Python's \s on ASCII)
# the rest of ASCII goes by a lookup per character, the others in runs: a match of one class for each costs 14 times as much
DROP_ASCII = "".join(chr(i) for i in range(128) if not chr(i).isalpha() and chr(i) not in " \t\n\r\f\x0B")
NOT_ASCII = r"[^\x00-\x7F]+"
WS = r"[ \t\n\r\f\x0B]+"


def words(text: str | Column) -> Column:
    """Python ``str.split()``: split on whitespace runs, no empty items."""
    return F.filter(F.split(col_(text), WS), lambda x: x != F.lit(""))


def clean_tokens(text: str | Column, stop_words: list[str] = STOP_WORDS) -> Column:
    """null -> []; drop non-letters; lower; split; drop stop words (keeps duplicates)."""
    # IN over a literal list is planned as a hash-set lookup (InSet), not a scan per token
    return F.filter(words(cleaned_string(text)), lambda x: ~x.isin(*stop_words))


def clean_text(text: str | Column, stop_words: list[str] = STOP_WORDS) -> Column:
    """Cleaned text re-joined with single spaces."""
    return F.array_join(clean_tokens(text, stop_words), " ")


def cleaned_string(text: str | Column) -> Column:
    """Lower-cased text with everything but ASCII letters and whitespace removed."""
    return F.lower(F.regexp_replace(F.translate(F.coalesce(col_(text), F.lit("")), DROP_ASCII, ""), NOT_ASCII, ""))


def raw_tokens(text: str | Column) -> Column:
    """Tokens of the cleaned string, unfiltered: those of ``clean_tokens`` once ``keep_token`` has filtered their rows."""
    return F.split(cleaned_string(text), WS)


def keep_token(token: Column, stop_words: list[str] = STOP_WORDS, min_len: int = 1) -> Column:
    """Row-level predicate equal to the cleaning filters (non-empty, not a stop
    word, at least ``min_len`` characters). Used after ``explode`` so the
    filtering runs in generated code instead of a per-element lambda."""
    c = (token != F.lit("")) & ~token.isin(*stop_words)
    return c & (F.length(token) >= min_len) if min_len > 1 else c
