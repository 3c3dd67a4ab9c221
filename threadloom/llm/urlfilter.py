"""URL rules as a bit-parallel wildcard automaton (operator 5).

Every glob is a row of bits in multiword masks: a start bit and one bit for each character other than
'*', which is a loop on the bit before it. All globs advance over a byte of a URL by the same shift,
and-mask and loop operations (Shift-And), and all URLs of a batch advance together. '?' stands for
any one byte.

Canonical form of a URL: '.' + host in lower case + '\\n' + path. The rule (host, path) is the glob
'*.' host '\\n' path '*', which fits the host and its subdomains and a prefix of the path.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.llm.common import map_text
from threadloom.llm.vectext import U

#: (action, host, path); of those that fit, the longest (host and path together) decides, then the first.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Globs over the canonical form that block where no rule fits.
BLOCK_GLOBS = ("*.casino-*\n*", "*.*-casino.*\n*", "*.free-bets.*\n*")
ANY = -1


class Automaton:
    """Which of several globs match whole byte strings. Globs are bytes with the wildcards '*' and '?'."""

    def __init__(self, globs: list[str]):
        self.start, self.accept = [], []
        moves: list[tuple[int, int]] = []  # (bit, byte or ANY) that enters the bit
        loops: list[int] = []
        bit = 0
        for g in globs:
            self.start.append(bit)
            for c in g.encode("utf-8", "surrogatepass"):
                if c == ord("*"):
                    loops.append(bit)
                else:
                    bit += 1
                    moves.append((bit, ANY if c == ord("?") else c))
            self.accept.append(bit)
            bit += 1
        self.words = bit // 64 + 1
        self.enter = np.zeros((256, self.words), U)
        self.loop, self.first = np.zeros(self.words, U), np.zeros(self.words, U)
        for b, c in moves:
            self.enter[slice(None) if c == ANY else c, b // 64] |= U(1 << (b % 64))
        for b in loops:
            self.loop[b // 64] |= U(1 << (b % 64))
        for b in self.start:
            self.first[b // 64] |= U(1 << (b % 64))

    def match(self, urls: list[bytes]) -> np.ndarray:
        """Booleans, a row for each URL and a column for each glob."""
        n = len(urls)
        size = np.array([len(u) for u in urls], np.int64)
        order = np.argsort(-size, kind="stable")  # longest first: those still running are a prefix
        buf = np.frombuffer(b"".join(urls) + b"\0", np.uint8)
        begin = (np.cumsum(size) - size)[order]
        running = np.searchsorted(-size[order], -np.arange(size.max(initial=0)), side="left")
        state = np.tile(self.first, (n, 1))
        for i, m in enumerate(running):
            s = state[:m]
            moved = s << U(1)
            moved[:, 1:] |= s[:, :-1] >> U(63)
            state[:m] = (moved & self.enter[buf[begin[:m] + i]]) | (s & self.loop)
        out = np.zeros((n, len(self.accept)), bool)
        for k, b in enumerate(self.accept):
            out[order, k] = (state[:, b // 64] >> U(b % 64)) & U(1)
        return out


UPPER_TO_LOWER = {c: c + 32 for c in range(65, 91)}


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z in lower case) and path; both empty without '://'."""
    if not url or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    for mark in "?#":
        rest = rest.partition(mark)[0]
    host, slash, path = rest.partition("/")
    return host.translate(UPPER_TO_LOWER), slash + path


def judge(pages: DataFrame, url_col: str = "url", rules=RULES, block_globs=BLOCK_GLOBS) -> DataFrame:
    """``pages`` with host, path, rule (host + path of the longest that fits, or null) and verdict.

    Without a rule, a URL that one of ``block_globs`` matches is blocked, all others are allowed; so
    are null and empty URLs. Rows are judged each for itself; other columns pass through, and columns
    with the names of the new ones are replaced.
    """
    ranked = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    globs = [f"*.{host}\n{path}*" for _, host, path in ranked] + list(block_globs)
    automaton = Automaton(globs)
    names = [h + p for _, h, p in ranked]

    def run(urls):
        split = [split_url(u) for u in urls]
        # the one line feed ends the host: others are written as another byte that no rule has
        hits = automaton.match([".{}\n{}".format(*(x.replace("\n", "\0") for x in hp)).encode("utf-8", "surrogatepass") for hp in split])
        fits = hits[:, : len(ranked)]
        first = np.where(fits.any(axis=1), fits.argmax(axis=1), -1)
        blocked = hits[:, len(ranked) :].any(axis=1)
        verdict = [ranked[k][0] if k >= 0 else "block" if b else "allow" for k, b in zip(first, blocked)]
        return [pa.array([h for h, _ in split]), pa.array([p for _, p in split]), pa.array([names[k] if k >= 0 else None for k in first], pa.string()), pa.array(verdict)]

    return map_text(pages, url_col, run, [T.StructField(n, T.StringType()) for n in ("host", "path", "rule", "verdict")])


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages).select("page_id", "host", "path", "rule", "verdict")


ORACLE = """
WITH a AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, regexp_extract(rest, '^[^?#]*') AS rest FROM a),
c AS (SELECT page_id, translate(regexp_extract(rest, '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/]*((?s:.*))$', 1) AS path FROM b),
d AS (SELECT *, CASE
  WHEN ('.' || host) LIKE '%.example.net' AND path LIKE '/en/%' THEN 'example.net/en/'
  WHEN ('.' || host) LIKE '%.example.com' AND path LIKE '/de/%' THEN 'example.com/de/'
  WHEN ('.' || host) LIKE '%.org' AND path LIKE '/fr/%' THEN 'org/fr/'
  WHEN ('.' || host) LIKE '%.net' AND path LIKE '/%' THEN 'net/' END AS rule FROM c)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
  WHEN ('.' || host) LIKE '%.casino-%' OR ('.' || host) LIKE '%.%-casino.%' OR ('.' || host) LIKE '%.free-bets.%' THEN 'block' ELSE 'allow' END AS verdict
FROM d
"""
