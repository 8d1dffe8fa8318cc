"""Text measures of spoken lines, as column expressions."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .scalars import safe_ratio

# Token classes (accented Latin letters are no token characters), sentence-final patterns, speech rates.
TOKEN = r"[A-Za-z0-9ㄱ-ㆎ가-힣]+"
SYLLABLE = r"[A-Za-z0-9ㄱ-ㆎ가-힣぀-ヿ一-鿿]"
LATIN_WORD = r"[A-Za-z0-9]+"
POLITE_ENDINGS = ("요", "니다", "습니다", "세요", "죠", "실례합니다", "부탁드립니다")
CASUAL_ENDINGS = ("야", "어", "아", "해", "거야", "주", "줄래", "하지 마")
#: Units a second: least, wanted, most.
RATES = {"korean": (3.6, 4.8, 6.2), "japanese": (4.2, 5.8, 7.4), "other": (2.0, 3.0, 4.2)}
NEGATIVE_WORDS = (
    "die died dying dead death kill killed killing bleed bleeding blood hurt pain help emergency 911 wrong stop no don't can't never lose "
    "losing lost scared afraid terrified panic hate angry fault sorry cry crying hospital injured wound"
).split()


def normalized(text: Column) -> Column:
    """Runs of Unicode white space become one space; trimmed; null gives ''."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))


def spoken_characters(text: Column) -> Column:
    """Characters without white space."""
    return F.length(F.regexp_replace(normalized(text), r"(?U)\s+", ""))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(normalized(text), F.lit(TOKEN), F.lit(0))


def word_count(text: Column) -> Column:
    return F.size(tokens(text))


def repetition_ratio(text: Column) -> Column:
    """1 - distinct / all lower-case tokens; 0 below three tokens."""
    found = F.transform(tokens(text), F.lower)
    return F.when(F.size(found) < 3, F.lit(0.0)).otherwise(1.0 - F.size(F.array_distinct(found)) / F.size(found))


def content(text: Column) -> Column:
    """Lower-case tokens joined without separator."""
    return F.array_join(F.transform(tokens(text), F.lower), "")


def first_token(text: Column) -> Column:
    return F.coalesce(F.try_element_at(F.transform(tokens(text), F.lower), F.lit(1)), F.lit(""))


@F.pandas_udf(DoubleType())
def similarity(left: pd.Series, right: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio of two content texts; 0 if either is empty. No built-in function has these semantics."""
    return pd.Series([SequenceMatcher(None, a, b).ratio() if a and b else 0.0 for a, b in zip(left, right)], dtype="float64")


def register(text: Column) -> Column:
    """polite, casual, mixed or unknown, by how a Korean line ends."""
    line = normalized(text)
    polite, casual = (F.coalesce(line.rlike(rf"({'|'.join(ends)})[.!?]?$"), F.lit(False)) for ends in (POLITE_ENDINGS, CASUAL_ENDINGS))
    return F.when(polite & casual, "mixed").when(polite, "polite").when(casual, "casual").otherwise("unknown")


def is_japanese(language: Column) -> Column:
    name = F.lower(F.trim(F.coalesce(language, F.lit(""))))
    return name.contains("japan") | name.isin("ja", "jp", "japanese")


def is_korean(language: Column) -> Column:
    name = F.lower(F.coalesce(language, F.lit("")))
    return name.contains("korean") | name.contains("한국") | name.isin("ko", "kr", "ko-kr")


def spoken_units(text: Column, language: Column) -> Column:
    """Syllable characters for Korean and Japanese, Latin words otherwise."""
    line = normalized(text)
    syllables, latin = (F.size(F.regexp_extract_all(line, F.lit(p), F.lit(0))) for p in (SYLLABLE, LATIN_WORD))
    return F.when(is_korean(language) | is_japanese(language), syllables).otherwise(latin)


def duration_budget(duration: Column, source_text: Column, language: Column, pauses: Column) -> Column:
    """struct(duration_sec, source_units, pause_count, min_units, target_units, max_units) of a line that has to fit a duration."""
    rate = [
        F.when(is_korean(language), RATES["korean"][i]).when(is_japanese(language), RATES["japanese"][i]).otherwise(RATES["other"][i])
        for i in range(3)
    ]
    length = F.coalesce(duration, F.lit(0.0))
    source = spoken_units(source_text, language)
    pause = F.coalesce(pauses, F.lit(0))
    spoken = length > 0
    low = F.when(spoken, F.greatest(F.lit(1), F.bround(length * rate[0]).cast("int"))).otherwise(0)
    wanted = F.when(spoken, F.greatest(F.lit(1), F.bround(length * rate[1]).cast("int"))).otherwise(source)
    most = F.when(spoken, F.greatest(low, F.bround(length * rate[2]).cast("int"))).otherwise(source)
    held = F.when(source > 0, F.greatest(low, F.least(most, F.greatest(source * 2, low)))).otherwise(most)
    aimed = F.when(source > 0, F.least(held, F.greatest(low, wanted))).otherwise(wanted)
    extra = F.when(pause >= 2, F.least(F.lit(6), pause)).otherwise(0)
    return F.struct(
        F.bround(length, 3).alias("duration_sec"), source.alias("source_units"), pause.alias("pause_count"), low.alias("min_units"),
        aimed.alias("target_units"), (held + extra).alias("max_units"),
    )


def budget_fit(text: Column, language: Column, budget: Column) -> Column:
    """struct(actual_units, within_budget, over_budget, under_budget, distance_from_target)."""
    actual = spoken_units(text, language)
    low, aim, most = budget.min_units, budget.target_units, budget.max_units
    return F.struct(
        actual.alias("actual_units"), (((low == 0) | (actual >= low)) & ((most == 0) | (actual <= most))).alias("within_budget"),
        ((most > 0) & (actual > most)).alias("over_budget"), ((low > 0) & (actual > 0) & (actual < low)).alias("under_budget"),
        F.when(aim > 0, F.abs(actual - aim)).otherwise(0).alias("distance_from_target"),
    )


def speech_seconds(text: Column, language: Column) -> Column:
    """Estimated seconds of speech, at least 0.6."""
    rate = F.when(is_korean(language), 6.2).otherwise(12.0)
    return F.greatest(F.lit(0.6), spoken_characters(text) / rate)


def has_negative_word(text: Column) -> Column:
    """Whether one of the words stands between characters other than A-Z, a-z, 0-9 and _ (Java's own \\b also counts other letters)."""
    return F.coalesce(text, F.lit("")).rlike(rf"(?i)(?<![A-Za-z0-9_])({'|'.join(NEGATIVE_WORDS)})(?![A-Za-z0-9_])")


def first_filled(*texts: Column) -> Column:
    """The first text that is not blank, trimmed; '' if all are."""
    return F.coalesce(*[F.nullif(F.trim(t), F.lit("")) for t in texts], F.lit(""))


def json_object_text(reply: Column) -> Column:
    """The outermost {...} of a reply that may stand in a code fence."""
    return F.regexp_extract(F.coalesce(reply, F.lit("")), r"(?s)\{.*\}", 0)


def without_cjk(text: Column) -> Column:
    """An instruction without CJK characters, white space normalised."""
    return normalized(F.regexp_replace(text, r"[぀-ヿㄱ-ㆎ一-鿿가-힣]", ""))


def with_directive(text: Column, directive: str) -> Column:
    """The text with a leading directive, added once."""
    line = F.trim(F.coalesce(text, F.lit("")))
    return F.when(line.startswith(directive), line).otherwise(F.trim(F.concat(F.lit(f"{directive} "), line)))


def join_tokens(words: Column, language: Column) -> Column:
    """Non-blank words joined: without separator for Japanese and Chinese, else by a space."""
    kept = F.filter(words, lambda w: F.trim(w) != "")
    name = F.lower(F.coalesce(language, F.lit("")))
    return F.when(is_japanese(language) | name.startswith("zh") | name.contains("chinese"), F.array_join(kept, "")).otherwise(F.array_join(kept, " "))


# Fixed value: what stands for a line without text.
EMPTY_LINE = "[empty or unrecognized line]"


def transcript_line(number: Column, chunk_id: Column, speaker: Column, start: Column, end: Column, text: Column) -> Column:
    """One line of a transcript, with the whole text."""
    line = F.coalesce(F.nullif(normalized(text), F.lit("")), F.lit(EMPTY_LINE))
    return F.format_string("%03d. [%s] [%s] [%.2f-%.2fs] %s", number, chunk_id, speaker, start, end, line)


def share_of_words(text: Column, low: Column, high: Column) -> Column:
    """The words of a text that belong to the part of its time between two shares, 0 to 1."""
    words = F.split(normalized(text), " ")
    first = F.bround(F.size(words) * low).cast("int")
    last = F.bround(F.size(words) * high).cast("int")
    return F.array_join(F.slice(words, first + 1, F.greatest(last - first, F.lit(0))), " ")


def cps(text: Column, duration: Column) -> Column:
    """Characters a second."""
    return safe_ratio(spoken_characters(text).cast("double"), duration)
