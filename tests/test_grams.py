"""The trigram index against scans, and what patterns need against Python's own matching."""

import random
import re

import pytest

from threadloom.operators import grams, recall
from threadloom.sources.snapshots import Snapshots


@pytest.mark.parametrize("pattern, needs", [
    ("gardener", [["gardener"]]),
    ("old.*garden", [["old"], ["garden"]]),
    ("(?:red|green|blue)s", [["red", "green", "blue"]]),
    ("(?:red|g.)x", []),
    ("ab+cd", [["abc"], ["bcd"]][1:]),
    ("abc+de", [["abc"], ["cde"]]),
    ("(abc){2,}", [["abcabc"], ["abc"]]),
    ("(?P<a>spr)ing", [["spring"]]),
    (r"\bspring\b", [["spring"]]),
    ("(?=spring).", [["spring"]]),
    ("(?!spring)abc", [["abc"]]),
    ("(spring)?abc", [["abc"]]),
    ("(?i)garden", [["garden"]]),
    ("(?i)market", [["mar"]]),
    ("a[bc]d", []),
    ("", []),
])
def test_needs_of_patterns(pattern, needs):
    assert grams.needs_of_pattern(pattern) == needs


def test_a_match_holds_what_its_pattern_needs():
    rng = random.Random(4)
    pieces = ["ab", "c", "[ab]", ".", "a+", "(?:ab|ba)", "(?:abc|cab|b)", "(bca)", "(abc)?", "(?:ca){2}", "(?=abc)", "(?!cc)", "b*", r"\b", "(?i:Ab)", "(?>abc)", "c{1,3}", "(?<=ab)"]
    matched = 0
    for _ in range(20_000):
        pattern = "".join(rng.choices(pieces, k=rng.randint(1, 6)))
        text = "".join(rng.choices("abcABC ", weights=[4, 4, 4, 1, 1, 1, 1], k=rng.randint(3, 30)))
        if re.search(pattern, text):
            matched += 1
            assert all(any(s.lower() in text.lower() for s in need) for need in grams.needs_of_pattern(pattern)), (pattern, text)
    assert matched > 3000


TEXTS = ["The Old GARDENER", "gardeners' spring", None, "", "ab", "a\\b % c_d", "ΟΔΥΣΣΕΥΣ ΚΑΙ", "οδυσσευς και", "日本語の文章です", "İstanbul", "i̇stanbul", "ſpring", "Kelvin", "😀😀😀 smile", "spring " * 2000]
#: Texts in which "zzz" is rare, so that a search for it isn't a scan.
MANY = TEXTS + [f"filler number {i}" for i in range(60)]


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    rows = spark.createDataFrame([(i, t, "x") for i, t in enumerate(MANY)] + [(None, "spring without id", "x"), (3, "spring again", "y")], "id long, content string, gram string")
    at = f"file://{tmp_path_factory.mktemp('grams')}"
    grams.build(rows.where("id is null or id % 2 = 0"), "id", "content", at)
    assert grams.append(rows.where("id % 2 = 1"), "id", "content", at, 1)
    assert not grams.append(rows, "id", "content", at, 1)
    return rows, at


def values(df):
    return sorted((r.id is None, r.id or 0, r.content) for r in df.collect())


@pytest.mark.parametrize("query", ["spring", "SPRING", "old%gard", "s_ring", "%", "", "ab", "a\\b", "ευς", "ΕΥΣ και", "本語の", "istan", "i̇st", "İst", "kelvin", "😀😀😀", "absent", "filler", "gardener"])
def test_like_equals_the_scan(indexed, query):
    rows, at = indexed
    assert values(grams.like(rows, "id", "content", query, at)) == values(recall.like(rows, ["content"], query))


@pytest.mark.parametrize("pattern", ["spring", "(?i)SPRING", "(?i)Kelvin", "gard.n|smile", "(?P<a>s)pring", "^İst", "(?:spring ){3}", "文章|gardener", "x*", r"\bfiller number 5\d"])
def test_regex_equals_the_scan(indexed, pattern):
    rows, at = indexed
    assert values(grams.regex(rows, "id", "content", pattern, at)) == values(recall.regex(rows, "content", pattern))


def test_rare_grams_are_chosen_and_common_ones_scanned(spark, indexed):
    rows, at = indexed
    rare = grams.lookup(spark, at, grams.needs_of_like("filler number 57"))
    assert rare.worthwhile and len(rare.grams[0][0]) == grams.PER_STRING and rare.most == 1 and rare.documents == len(MANY) + 2
    assert not grams.lookup(spark, at, grams.needs_of_like("filler")).worthwhile
    assert not grams.lookup(spark, at, grams.needs_of_like("ab")).worthwhile
    assert grams.candidates(spark, at, rare).count() == 1


def test_changes_and_merge(spark, tmp_path):
    at = f"file://{tmp_path}/g"
    old = spark.createDataFrame([(i, f"filler {i}") for i in range(20)] + [(20, "spring")], "id long, content string")
    grams.build(old, "id", "content", at)
    now = spark.createDataFrame([(i, f"filler {i}") for i in range(20)] + [(20, "autumn")], "id long, content string")
    assert grams.append(now.where("id = 20"), "id", "content", at, 1)
    assert [r.id for r in grams.like(now, "id", "content", "autumn", at).collect()] == [20]
    assert grams.like(now, "id", "content", "spring", at).count() == 0
    grams.merge(now.where("id <> 3"), "id", at)
    assert grams.lookup(spark, at, [["filler"]]).documents == 20 and grams.lookup(spark, at, [["filler"]]).most == 19
    assert [r.id for r in grams.like(now, "id", "content", "autumn", at).collect()] == [20]
    grams.build(old.limit(0), "id", "content", f"{at}2")
    assert grams.like(old.limit(0), "id", "content", "spring", f"{at}2").count() == 0


@pytest.mark.parametrize("query, mode", [("number 57?", "full_text"), ("本語の", "full_text"), ("filler .* 5[0-9]", "regex"), ("a\\b", "full_text"), ("***", "full_text")])
def test_search_by_trigrams(spark, tmp_path, query, mode):
    at, stamp = f"file://{tmp_path}/m", "2024-01-01 00:00:00"
    rows = [(i, i % 3, i, "user", t, stamp) for i, t in enumerate(MANY)]
    messages = spark.createDataFrame(rows, "id long, conversation_id long, seq long, role string, content string, created_at string")
    summaries = messages.selectExpr("concat('s', id) AS summary_id", "conversation_id", "'leaf' AS kind", "0 AS depth", "content", "created_at")
    grams.build(messages, "id", "content", at)
    grams.build(summaries, "summary_id", "content", f"{at}s")
    plain = recall.grep(messages, summaries, query, mode=mode).collect()
    assert recall.grep(messages, summaries, query, mode=mode, grams={"message": at, "summary": f"{at}s"}).collect() == plain


def test_a_block_of_texts_makes_one_row_a_trigram(spark, tmp_path):
    """What is dealt out and sorted doesn't grow with documents times trigrams."""
    texts = [None, "ab", *(t for t in MANY if t), *["the same words again"] * 500]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, content string").coalesce(1)
    at, plain = f"file://{tmp_path}/g", {}
    grams.build(rows, "id", "content", at)
    for i, t in rows.select("id", grams.folded(rows.content)).collect():
        for k in range(len(t or "") - 2):
            plain.setdefault(t[k : k + 3], set()).add(i)
    lists = Snapshots(spark, at).read("postings").collect()
    assert len(lists) == len(plain) and {r.gram: set(r.ids) for r in lists} == plain
    assert {r.gram: r.n for r in Snapshots(spark, at).read("grams").collect()} == {g: len(ids) for g, ids in plain.items()}
