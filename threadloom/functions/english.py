"""English full text: stop words, stems by the published Snowball rules, and the rank by nearness of a query's words.

Words are the index terms of ``functions.text``; an apostrophe ends a word, so its rules are not needed here.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from threadloom.functions.text import query_terms, terms

#: The usual English stop words.
STOP_WORDS = frozenset(
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its "
    "itself they them their theirs themselves what which who whom this that these those am is are was were be been being have "
    "has had having do does did doing a an the and but if or because as until while of at by for with about against between "
    "into through during before after above below to from up down in out on off over under again further then once here there "
    "when where why how all any both each few more most other some such no nor not only own same so than too very s t can will "
    "just don should now".split()
)
#: Fixed values of the published rules.
WHOLE = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
WHOLE |= {w: w for w in ("sky", "news", "howe", "atlas", "cosmos", "bias", "andes")}
DONE_EARLY = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
SECOND = {"tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": ""}
THIRD = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
FOURTH = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion")
#: Fixed values of the rank: a word's weight, the places that count, the farthest distance, and the sum of 1 / n².
WEIGHT, LAST_PLACE, MOST_PLACES, FAR, BASEL = 0.1, 16_383, 255, 100, 1.64493406685


def _after_syllable(word: str, start: int) -> int:
    """Where the region begins that follows the first consonant after a vowel."""
    m = re.compile("[aeiouy][^aeiouy]").search(word, start)
    return m.end() if m else len(word)


def _longest(word: str, endings) -> str | None:
    return max((e for e in endings if word.endswith(e)), key=len, default=None)


def _ends_short(word: str) -> bool:
    return re.search("(?:^[aeiouy][^aeiouy]|[^aeiouy][aeiouy][^aeiouywxY])$", word) is not None


def _plural(w: str) -> str:
    end = _longest(w, ("sses", "ied", "ies", "us", "ss", "s"))
    if end == "sses":
        return w[:-2]
    if end in ("ied", "ies"):
        return w[:-2] if len(w) > 4 else w[:-1]
    return w[:-1] if end == "s" and re.search("[aeiouy]", w[:-2]) else w


def _past(w: str, r1: int) -> str:
    end = _longest(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if end is None:
        return w
    stem = w[: -len(end)]
    if end.startswith("eed"):
        return stem + "ee" if len(stem) >= r1 else w
    if not re.search("[aeiouy]", stem):
        return w
    if stem.endswith(("at", "bl", "iz")):
        return stem + "e"
    if re.search(r"([bdfgmnprt])\1$", stem):
        return stem[:-1]
    return stem + "e" if len(stem) <= r1 and _ends_short(stem) else stem


def _derived(w: str, r1: int, r2: int) -> str:
    end = _longest(w, SECOND)
    if end and len(w) - len(end) >= r1 and (end != "ogi" or w.endswith("logi")) and (end != "li" or w[-3:-2] in set("cdeghkmnrt")):
        w = w[: -len(end)] + SECOND[end]
    end = _longest(w, THIRD)
    if end and len(w) - len(end) >= (r2 if end == "ative" else r1):
        w = w[: -len(end)] + THIRD[end]
    end = _longest(w, FOURTH)
    if end and len(w) - len(end) >= r2 and (end != "ion" or w.endswith(("sion", "tion"))):
        w = w[: -len(end)]
    if w.endswith("e") and (len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _ends_short(w[:-1]))):
        return w[:-1]
    return w[:-1] if w.endswith("ll") and len(w) - 1 >= r2 else w


@lru_cache(maxsize=100_000)
def stem(word: str) -> str:
    """The stem of a word in lower case."""
    if len(word) < 3 or word in WHOLE:
        return WHOLE.get(word, word)
    w = re.sub("(^|(?<=[aeiouy]))y", "Y", word)
    r1 = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None) or _after_syllable(w, 0)
    r2 = _after_syllable(w, r1)
    w = _plural(w)
    if w not in DONE_EARLY:
        w = _past(w, r1)
        if len(w) > 2 and w[-1] in "yY" and w[-2] not in "aeiouy":
            w = w[:-1] + "i"
        w = _derived(w, r1, r2)
    return w.lower()


@F.pandas_udf(ArrayType(StringType()))
def lexemes(words: pd.Series) -> pd.Series:
    """The stems of an array of terms, null in the places of stop words; null for null."""
    return words.map(lambda row: None if row is None else [None if w in STOP_WORDS else stem(w) for w in row])


def query_lexemes(query: str) -> list[str]:
    """The distinct stems of a query without stop words, in order."""
    return list(dict.fromkeys(stem(w) for w in query_terms(query or "") if w not in STOP_WORDS))


def _places(found: Column, word: str) -> Column:
    """The first places of a word in an array of lexemes, counted from 1."""
    place = F.transform(found, lambda x, i: F.when(x == word, F.least(i + 1, F.lit(LAST_PLACE))))
    return F.slice(F.filter(place, lambda p: p.isNotNull()), 1, MOST_PLACES)


def rank(found: Column, query: list[str]) -> Column:
    """How well an array of lexemes that has all of ``query`` fits: near pairs of its words count most."""
    places = [_places(found, q) for q in query]
    if len(query) == 1:
        parts = F.transform(places[0], lambda p, i: F.lit(WEIGHT) / ((i + 1) * (i + 1)))
        return F.aggregate(parts, F.lit(0.0), lambda s, x: s + x) / F.lit(BASEL)

    def miss(p: Column, q: Column) -> Column:
        away = F.abs(p - q)
        near = F.when((away == 0) | (away > FAR), F.lit(1e-30)).otherwise(F.lit(1.0) / (F.lit(1.005) + F.lit(0.05) * F.exp(away / F.lit(1.5) - F.lit(2.0))))
        return F.lit(1.0) - F.lit(WEIGHT) * F.sqrt(near)

    def all_miss(a: Column, b: Column) -> Column:
        return F.aggregate(a, F.lit(1.0), lambda s, p: s * F.aggregate(b, F.lit(1.0), lambda t, q: t * miss(p, q)))

    rest = F.lit(1.0)
    for i, a in enumerate(places):
        for b in places[:i]:
            rest = rest * all_miss(a, b)
    return F.lit(1.0) - rest


@F.pandas_udf(StringType())
def _stems(words: pd.Series) -> pd.Series:
    return words.map(lambda w: None if w in STOP_WORDS else stem(w))


def forms(rows: DataFrame, text_col: str, wanted: list[str]) -> dict[str, str]:
    """The words of the texts that have one of the stems: word -> stem, a few for each stem.

    Each different word is stemmed once, and the texts don't come to Python. A stem begins as its word does, so other
    words stay out before they are dealt out.
    """
    first = sorted({w[0] for w in wanted})
    able = F.filter(terms(F.col(text_col)), lambda w: F.substring(w, 1, 1).isin(first))
    words = rows.select(F.explode(able).alias("word")).distinct().withColumn("stem", _stems("word"))
    return dict(words.where(F.col("stem").isin(wanted)).collect())


def search(rows: DataFrame, text_col: str, query: str) -> DataFrame:
    """Rows that hold the stems of all words of ``query``, with ``score``; none for a query of stop words only.

    Reads the rows twice: for the forms of the query's stems, and for the texts that have them.
    """
    wanted = query_lexemes(query)
    known = forms(rows, text_col, wanted) if wanted else {}
    if not wanted or set(known.values()) != set(wanted):
        return rows.limit(0).withColumn("score", F.lit(0.0))
    of = {q: sorted(w for w, s in known.items() if s == q) for q in wanted}

    def lexeme(w: Column) -> Column:
        found = F.lit(None).cast("string")
        for q in wanted:
            found = F.when(w.isin(of[q]), F.lit(q)).otherwise(found)
        return found

    found = rows.withColumn("__t", terms(F.col(text_col)))
    for q in wanted:
        found = found.where(F.arrays_overlap("__t", F.array(*map(F.lit, of[q]))))
    found = found.withColumn("__l", F.transform("__t", lexeme)).drop("__t")
    return found.withColumn("score", rank(F.col("__l"), wanted)).drop("__l")
