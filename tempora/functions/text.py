"""Word rules: normalisation, flags and lexicons (fixed values of the transcript rules)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sentence terminators and clause punctuation.
TERMINATORS = ".!?;:।॥"
CLAUSE_ENDS = ".,!?。！？;；"
# Hesitation tokens.
FILLERS = ["um", "uh", "uhm", "umm", "erm", "hmm", "mm", "mmm", "ah", "er", "eh"]
# Conjunctions that a caption line is broken before.
CONJUNCTIONS = [
    "and", "but", "or", "so", "because", "when", "if", "that", "with", "from", "into", "every", "on", "your", "my", "our", "their", "this", "which",
    "aur", "lekin", "par", "ki", "toh", "kyunki", "agar", "jab", "tab",
]
# Terms that support emphasis.
SUPPORTING_TERMS = [
    "never", "always", "worst", "best", "secret", "mistake", "truth", "problem", "key", "crucial", "essential", "proven", "simple", "insane", "crazy", "shocking",
    "biggest", "million", "billion", "dollars",
]
# Words that carry a sentence on, English first, then Hindi.
CONTINUATIONS = [
    "because", "but", "and", "so", "then", "that's", "thats", "which", "what", "why", "the", "a", "an", "i", "when", "after", "before", "for",
    "especially", "until", "if", "although", "or", "like", "least", "means", "is", "was", "are", "were", "to", "with", "from", "at", "as", "by",
    "कम", "से", "क्योंकि", "लेकिन", "और", "फिर", "इसलिए", "उसके", "बाद", "तब", "जब", "अगर", "मतलब", "यानी", "तो", "जिससे", "जिसके", "कारण", "वहां",
    "उस", "टाइम", "मैंने", "हम", "कि", "जैसे", "वैसे", "पर", "भी", "ही", "करके", "लेकर", "देकर",
]


def normalize_token(text: Column) -> Column:
    """Lower case; letters and digits of any script are kept."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]", "")


def normalize_spoken(text: Column) -> Column:
    """Lower case; word characters, apostrophes and Devanagari signs are kept."""
    return F.regexp_replace(F.lower(F.trim(text)), r"(?U)[^\w\x{0900}-\x{097F}']", "")


def trimmed_token(text: Column) -> Column:
    """Lower case without the symbols around it."""
    return F.regexp_replace(F.lower(F.trim(text)), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")


def ends_sentence(text: Column) -> Column:
    return F.trim(text).rlike("[.!?;:।॥]$")


def ends_clause(text: Column) -> Column:
    return F.trim(text).rlike("[.,!?。！？;；]$")


def is_filler(text: Column) -> Column:
    return normalize_spoken(text).isin(FILLERS)


def is_continuation(text: Column) -> Column:
    return trimmed_token(text).isin(CONTINUATIONS)


def is_numeric(text: Column) -> Column:
    return text.rlike("[0-9]")


def is_question(text: Column) -> Column:
    return F.trim(text).endswith("?")
