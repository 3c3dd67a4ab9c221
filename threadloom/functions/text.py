"""Text scalars as column expressions: tokens, snippets, media, keywords, patterns."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Accented Latin letters and what remains without their marks, derived from Unicode's decompositions.
_ACCENTED = [(chr(c), d[0]) for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)) if len(d := unicodedata.normalize("NFD", chr(c))) > 1 and d[0].isascii()]


def fold(text: Column) -> Column:
    """Without case and accents, whether a letter and its accent are one character or two."""
    bare = F.translate(text, "".join(a for a, _ in _ACCENTED), "".join(b for _, b in _ACCENTED))
    return F.lower(F.regexp_replace(bare, r"\p{M}+", ""))


def terms(text: Column) -> Column:
    """Index terms: runs of letters and digits, without case and accents."""
    return F.regexp_extract_all(fold(text), F.lit(r"([\p{L}\p{N}]+)"), 1)


#: Latin characters and general punctuation as they are in terms; what parts terms is a space. Each becomes one character.
LATIN = {c: _plain if unicodedata.category(_plain := dict(_ACCENTED).get(chr(c), chr(c)).lower())[0] in "LN" else " " for c in (*range(0x250), *range(0x2000, 0x2070))}


def parted(text: Column) -> Column:
    """What has the text's terms between spaces, once ``LATIN`` has been put for its characters; most texts as they are."""
    plain = (F.octet_length(text) == F.length(text)) | ~text.rlike(r"[^\x00-\u024f\u2000-\u206f]")
    return F.when(plain, text).otherwise(F.regexp_replace(fold(text), r"[^\p{L}\p{N}]+", " "))


def query_terms(query: str) -> list[str]:
    """The same terms of a query text, on the driver."""
    single = dict(_ACCENTED)
    plain = "".join(single.get(c, c) for c in query if unicodedata.category(c)[0] != "M").lower()
    return [w for w in re.split(r"[^\w]|_", plain) if w]


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+"), lambda t: t != "")


def snippet(text: Column, n: int = 200) -> Column:
    return F.when(F.length(text) <= n, text).otherwise(F.concat(F.substring(text, 1, n - 3), F.lit("...")))


def tokens_div4(text: Column) -> Column:
    return F.floor(F.length(text) / 4).cast("long")


def tokens_at_least_one(text: Column) -> Column:
    return F.greatest(F.lit(1).cast("long"), tokens_div4(text))


def tokens_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def has_cjk(text: Column) -> Column:
    return text.rlike("[\\u4e00-\\u9fff\\u3040-\\u30ff\\uac00-\\ud7af]")


def is_cjk(text: str) -> bool:
    return re.search("[一-鿿぀-ヿ가-힯]", text) is not None


#: White space as Python's \s has it, inside a character class under (?U): Java's lacks the four separators.
BLANKS = r"\s\x1c-\x1f"
#: What counts as media, in this order: data URLs, paths, dumps of bytes, runs of high Latin-1.
#: Only the possessive loops are added: they keep Java off the stack.
MEDIA = (
    r"data:[a-zA-Z0-9]+/[a-zA-Z0-9.+\-]+;base64,[A-Za-z0-9+/=\n]{20,}",
    rf"(?U)MEDIA:/[^{BLANKS}]+",
    rf"(?U)(?:[0-9a-fA-F]{{2}}[{BLANKS}]*+){{32,}}+",
    r"[\x80-\xff]{16,}",
)


def has_media(text: Column) -> Column:
    found = text.rlike(MEDIA[0])
    for pattern in MEDIA[1:]:
        found = found | text.rlike(pattern)
    return found


def strip_media(text: Column) -> Column:
    for pattern in MEDIA:
        text = F.regexp_replace(text, pattern, "")
    return F.regexp_replace(F.regexp_replace(text, r"\n{3,}", "\n\n"), rf"(?U)^[{BLANKS}]+|[{BLANKS}]+$", "")


#: What stands for media in a text.
ONLY_MEDIA, WITH_MEDIA = "[Media attachment]", " [with media attachment]"


def annotate_media(text: Column) -> Column:
    rest = strip_media(text)
    noted = F.when(rest == "", F.lit(ONLY_MEDIA)).otherwise(F.concat(rest, F.lit(WITH_MEDIA)))
    return F.when(has_media(text), noted).otherwise(text)


#: Words that say little in a question.
STOP_WORDS = frozenset("the a an and or of in on at to for from with by is are was were be been do does did what when where who how why which that this these those it its we you they i he she about into over under can could should would will".split())


def keywords(text: str) -> list[str]:
    """Words of three letters or more that aren't stop words, once each, in order."""
    found = (w for w in re.findall(r"[A-Za-z0-9_]+", text.lower()) if len(w) > 2 and w not in STOP_WORDS)
    return list(dict.fromkeys(found))


def key_terms(question: Column, leave_out=STOP_WORDS) -> Column:
    """Up to three pairs of neighbours, then up to five single words, of what a question is about; empty for null."""
    told = F.filter(words(F.lower(F.translate(F.coalesce(question, F.lit("")), "?,.", ""))), lambda w: (F.length(w) > 2) & ~w.isin(*sorted(leave_out)))
    pairs = F.transform(F.slice(told, 2, 3), lambda w, i: F.concat(F.get(told, i), F.lit(" "), w))
    return F.concat(pairs, F.slice(told, 1, 5))


def keyword_column(text: Column) -> Column:
    found = F.regexp_extract_all(F.lower(text), F.lit(r"([a-z0-9_]+)"), 1)
    return F.array_distinct(F.filter(found, lambda w: (F.length(w) > 2) & ~w.isin(*sorted(STOP_WORDS))))


def glob_regex(glob: str) -> str:
    """A session glob as a regular expression: '**' is anything, '*' anything but a colon."""
    parts = re.split(r"(\*\*|\*)", glob)
    return "^" + "".join({"**": ".*", "*": "[^:]*"}.get(p, re.escape(p)) for p in parts) + "$"


def matches_globs(key: Column, globs: list[str]) -> Column:
    found = F.lit(False)
    for g in globs:
        found = found | key.rlike(glob_regex(g))
    return found


#: Phrases of questions about a long time, and patterns of those that need several sources.
#: A space in them is any white space.
BROAD_TIME = ("last month", "past year", "all time", "history", "everything", "since ", "over the past")
MULTI_HOP = ("compare", "relationship between", r"how did \w+ affect")


def asks(question: Column, patterns: tuple[str, ...]) -> Column:
    """Whether a question has one of the patterns in it, case aside; false for null."""
    plain = F.regexp_replace(F.lower(F.coalesce(question, F.lit(""))), rf"(?U)[{BLANKS}]+", " ")
    return plain.rlike("(?U)" + "|".join(patterns))


def fingerprint(text: Column) -> Column:
    return F.substring(F.sha2(text.cast("binary"), 256), 1, 12)


def derived_id(prefix: str, n: int, *parts: Column) -> Column:
    """A deterministic id: a prefix and the first hexadecimal digits of a digest of the parts."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws(":", *[p.cast("string") for p in parts]).cast("binary"), 256), 1, n))


def recovered(snippet_text: Column, text: Column, share: float = 0.7) -> Column:
    """Whether a snippet is in a text, or this share of its words."""
    own = F.split(F.lower(snippet_text), r"\s+")
    hits = F.size(F.filter(own, lambda w: F.contains(F.lower(text), w)))
    return F.contains(F.lower(text), F.lower(snippet_text)) | (hits >= F.size(own) * share)


def truncated(text: Column, limit: int = 4800, note: str = "\n[truncated]") -> Column:
    """The deterministic stand-in for a summariser: short texts as they are, long ones cut."""
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.substring(text, 1, limit), F.lit(note)))


def tagged(text: Column, tag: str) -> Column:
    """What stands between <tag> and </tag>, or the text itself."""
    inner = F.regexp_extract(text, rf"(?s)<{tag}>(.*?)</{tag}>", 1)
    return F.when(inner == "", text).otherwise(F.trim(inner))


#: Fields of nested JSON that hold text, in order of precedence (texts, lists, wrappers), and the depth.
TEXT_FIELDS = ("text", "transcript", "transcription", "message", "summary")
LIST_FIELDS = ("segments", "utterances", "paragraphs", "alternatives", "words", "items", "results")
WRAPPER_FIELDS = ("content", "output", "result", "payload", "data", "value")
JSON_DEPTH = 6


def json_text(raw: str | None) -> str | None:
    """The texts inside a JSON object or list, one a line; other scalars as text; what is no JSON as it is.

    Of an object the first kind of fields that yields anything counts: texts, then lists, then wrappers, else
    all its strings. Blank strings yield nothing.
    """
    import json

    def texts(value, depth: int, kinds=(str, dict, list)) -> list[str]:
        if not isinstance(value, kinds):
            return []
        if isinstance(value, str):
            return [value] if value.strip() else []
        if depth <= 0:
            return []
        if isinstance(value, list):
            return [t for item in value for t in texts(item, depth - 1)]
        for names, allowed in ((TEXT_FIELDS, kinds_all), (LIST_FIELDS, list), (WRAPPER_FIELDS, kinds_all), (value, str)):
            if found := [t for n in names if n in value for t in texts(value[n], depth - 1, allowed)]:
                return found
        return []

    kinds_all = (str, dict, list)
    if not raw:
        return raw
    try:
        value = json.loads(raw)
    except (ValueError, RecursionError):
        return raw
    if value is None:
        return raw
    return "\n".join(texts(value, JSON_DEPTH)) if isinstance(value, (dict, list)) else str(value)


def json_text_column(text: Column) -> Column:
    """json_text over a column, in Arrow batches (JSON of any shape has no built-in form)."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("string")
    def extract(values):
        return values.map(json_text, na_action="ignore")

    return extract(text)
