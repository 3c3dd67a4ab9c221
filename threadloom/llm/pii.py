"""Personal data by anchor expansion (operator 9).

One Aho-Corasick automaton finds anchors (at-signs, plus signs, digits next to digits, schemes and
identifier cues) in a single pass over a text; at each anchor a local parser expands to the left and
right and validates what it finds. Positions are code points, ends exclusive.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.llm.common import map_text

#: Kinds in the order in which spans with one start are listed; the first four are the base kinds.
KINDS = ("email", "ip", "card", "phone", "iban", "account", "secret", "url")
BASE = KINDS[:4]
CUES = ("token", "secret", "password", "passwd", "api_key", "apikey", "api-key", "access_key")
ACCOUNT_CUES = ("account", "ssn", "passport")
IBAN_CUES = ("iban",)

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
IBAN = re.compile(r"[\s:=#]{0,3}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})(?![A-Za-z0-9])")
#: A number after a cue: groups of capitals and digits with single hyphens or spaces between.
ACCOUNT = re.compile(r"(?: ?(?:number|no\.?|nr\.?|#))?\s{0,3}[:=#]?\s{0,3}([A-Z]{0,3}[0-9]+(?:[ -]?[A-Z0-9]*[0-9])*)(?![A-Za-z0-9])")
SECRET = re.compile(r"\s{0,3}[:=]\s{0,3}[\"']?([A-Za-z0-9_./+=-]{12,})")
URL = re.compile(r"://(?:[^\s/?#@\"'<>]+@)?[A-Za-z0-9.-]+(?::[0-9]+)?(?:[/?#][^\s\"'<>]*)?")
DIGITS = "0123456789"
SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
_automaton = None


def automaton():
    """Anchors: '@', '+', '://', cues in three cases, and two digits that are adjacent or have one separator between."""
    global _automaton
    if _automaton is None:
        import ahocorasick

        a = ahocorasick.Automaton()
        a.add_word("@", ("email", 1))
        a.add_word("+", ("phone", 1))
        a.add_word("://", ("url", 3))
        for x in DIGITS:
            for y in DIGITS:
                for sep in ("", " ", "-"):
                    a.add_word(x + sep + y, ("card", 2 + len(sep)))
                a.add_word(f"{x}.{y}", ("ip", 3))
        for kind, cues in (("cue", CUES), ("account", ACCOUNT_CUES), ("iban", IBAN_CUES)):
            for cue in cues:
                for form in {cue, cue.upper(), cue.capitalize()}:
                    a.add_word(form, (kind, len(form)))
        a.make_automaton()
        _automaton = a
    return _automaton


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def mod97(code: str) -> bool:
    code = code.replace(" ", "")
    return 15 <= len(code) <= 34 and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def spans(text: str | None) -> list[tuple[str, int, int]]:
    """All (kind, start, end) of a text, by start, then in the order of KINDS."""
    if not text:
        return []
    out: list[tuple[str, int, int]] = []
    email = ip = card = phone = url = secret = account = iban = 0  # where the next match of each kind may begin
    for last, (kind, length) in automaton().iter(text):
        at = last - length + 1
        if kind == "email":
            start = at
            while start > email and text[start - 1] in LOCAL:
                start -= 1
            if start < at and (m := DOMAIN.match(text, at + 1)):
                email = m.end()
                out.append(("email", start, email))
        elif kind == "card":
            if at >= card:
                m = CARD.match(text, at)
                card = m.end()
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append(("card", at, card))
        elif kind == "ip":
            if at >= ip:
                start = at
                while start > ip and text[start - 1] in DIGITS:
                    start -= 1
                if m := IP.match(text, start):
                    ip = m.end()
                    if all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in m[0].split("."))):
                        out.append(("ip", start, ip))
        elif kind == "phone":
            if at >= phone and (m := PHONE.match(text, at)):
                phone = m.end()
                if 9 <= sum(c in DIGITS for c in m[0]) <= 15:
                    out.append(("phone", at, phone))
        elif kind == "url":
            start = at
            while start > max(url, at - 12) and text[start - 1].isascii() and text[start - 1].isalpha():
                start -= 1
            if start < at and (m := URL.match(text, at)):
                url = m.end()
                out.append(("url", start, url))
        elif kind == "account":
            if at >= account and (m := ACCOUNT.match(text, last + 1)) and 5 <= sum(c in DIGITS for c in m[1]) <= 20:
                account = m.end(1)
                out.append(("account", m.start(1), account))
        elif kind == "iban":
            if at >= iban and (m := IBAN.match(text, last + 1)):
                code = m[1]
                while code and not mod97(code):  # words in capitals may follow
                    code = code.rpartition(" ")[0]
                if code:
                    iban = m.start(1) + len(code)
                    out.append(("iban", m.start(1), iban))
        elif at >= secret and (m := SECRET.match(text, last + 1)):
            if any(c in DIGITS for c in m[1]):
                secret = m.end(1)
                out.append(("secret", m.start(1), secret))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def find(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``spans``: an array of (kind, start, end), by start, then kind.

    Null and empty texts have an empty array. Repeated rows are treated alike; ``spans`` replaces a
    column of that name, all others pass through.
    """

    def run(texts):
        found = [spans(t) for t in texts]
        return [pa.array([[{"kind": k, "start": s, "end": e} for k, s, e in x] for x in found], pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])))]

    return map_text(docs, text_col, run, [T.StructField("spans", SPANS)])


def joined(spans_col) -> Column:
    return F.array_join(F.transform(spans_col, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")


def number(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = find(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    counts = [number(k).alias(f"n_{k}") for k in BASE]
    base = F.filter("spans", lambda s: s.kind.isin(*BASE))
    return rows.select("doc_id", *counts, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
