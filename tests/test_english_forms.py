"""English search stems each different word once; texts stay out of Python."""

import itertools

from threadloom.functions import english


def test_texts_stay_out_of_python(spark):
    df = spark.createDataFrame([(1, "running in the rain"), (2, "it rained, and he runs"), (3, "rain"), (4, None), (5, "dying skies")], "id long, content string")
    found = english.search(df, "content", "run rains")
    assert "EvalPython" not in found._jdf.queryExecution().toString() and sorted(r.id for r in found.collect()) == [1, 2]
    assert english.forms(df, "content", ["run", "sky"]) == {"running": "run", "runs": "run", "skies": "sky"}
    assert [r.id for r in english.search(df, "content", "die sky").collect()] == [5]
    assert english.search(df, "content", "rain absent").count() == 0


def test_a_stem_begins_as_its_word_does():
    ends = ["", "s", "es", "ies", "ed", "ing", "ingly", "eedly", "ational", "fulness", "li", "y", "ement", "sses", "us"]
    words = ["".join(w) + e for n in range(4) for w in itertools.product("aybst", repeat=n) for e in ends]
    assert all(english.stem(w)[0] == w[0] for w in [*words, *english.WHOLE] if w)
