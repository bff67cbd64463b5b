"""String and array column functions.

All of them are built-in Catalyst expressions, so they stay inside
whole-stage code generation; nothing here is a Python UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word tokens for the models: maximal runs of letters/digits after lower-casing.
WORD_SPLIT = r"[^\p{L}\p{N}]+"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def word_tokens(text, pattern: str = WORD_SPLIT, lower: bool = True) -> Column:
    """K1 (re-aimed): text -> ARRAY<STRING> of word tokens, no empty strings."""
    t = col(text)
    if lower:
        t = F.lower(t)
    return F.array_remove(F.split(t, pattern), "")


def space_word_count(text) -> Column:
    """``len(s.split(" "))``; consecutive spaces yield empty tokens that count."""
    return F.size(F.split(col(text), " "))


def join_tokens(tokens) -> Column:
    """``" ".join(tokens)``."""
    return F.array_join(col(tokens), " ")


def ustrip(text) -> Column:
    """Python ``str.strip()``: leading/trailing Unicode whitespace."""
    return F.regexp_replace(col(text), r"(?U)^\s+|\s+$", "")


def relabel_category(category) -> Column:
    """T4/T5: first match wins, case-sensitive ``in`` tests, else lower-case."""
    c = col(category)
    return (F.when(c.contains("Indexical Error"), F.lit("indexical_error"))
            .when(c.contains("Confusion"), F.lit("confusion"))
            .otherwise(F.lower(c)))


# The pronoun lists of the minimal-pair coreference suite.
FEMALE_WORDS = ["she", "her"]
MALE_WORDS = ["he", "his", "him"]


def coref_class(tokens, kind, female=FEMALE_WORDS, male=MALE_WORDS) -> Column:
    """Exactly one list hit -> '<kind>_female' / '<kind>_male'; else NULL.

    Membership is exact and case-sensitive.  The word lists are parameters.
    """
    t = col(tokens)
    f = F.arrays_overlap(t, F.array(*[F.lit(w) for w in female]))
    m = F.arrays_overlap(t, F.array(*[F.lit(w) for w in male]))
    # arrays_overlap is NULL when the array holds NULLs and nothing matched
    f = F.coalesce(f, F.lit(False))
    m = F.coalesce(m, F.lit(False))
    k = col(kind)
    return (F.when(f & ~m, F.concat(k, F.lit("_female")))
            .when(m & ~f, F.concat(k, F.lit("_male"))))


def strip_prefix(name, prefix: str) -> Column:
    """``name.replace(prefix, "")`` - removes every occurrence, like Python."""
    return F.replace(col(name), F.lit(prefix), F.lit(""))


def md5_key(*parts) -> Column:
    """Stable pseudo-random order key: md5 of 'p1:p2:...'.

    Identical hex in Spark and in any SQL engine with md5(), so a sample
    drawn here can be reproduced by an oracle.
    """
    return F.md5(F.concat_ws(":", *[col(p).cast("string") if isinstance(p, str) else p
                                    for p in parts]))
