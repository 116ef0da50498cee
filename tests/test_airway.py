"""Airway words in long joined notes."""

import re

from pyspark.sql import functions as F

from tidemark.functions import note_patterns as P
from tidemark.operators import text as tx


def test_text_is_cut_once(spark):
    """The text is no part of what runs for every piece of it, else a text of many words is cut as often as it has words."""
    out = spark.createDataFrame([("x",)], "text string").select(tx.airway_mentioned(F.col("text")).alias("hit"))
    assert out._jdf.queryExecution().analyzed().toString().count("split(") == 1


def test_long_texts_as_a_sequential_reading(spark):
    neg = "ikke " + "intuberet, ikke " * 300
    texts = [neg, neg + "a" * 20 + " OTI", "ETT", "ikke\nETT", "ej " + "x" * 15 + "RSI", "ej " + "x" * 11 + " RSI", "a\u0001b", "", None, "uden tube RSI OTI ETT"]

    def flags(p):
        return re.compile(p.replace("(?iu)", "(?i)").replace("(?iuU)", "(?i)").replace("(?iU)", "(?i)").replace("(?U)", ""))

    word, negation = flags(P.AIRWAY), flags(P.AIRWAY_NEGATION)
    want = [any(not negation.search(t[max(0, m.start() - 15) : m.start()]) for m in word.finditer(t)) for t in (x or "" for x in texts)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = [r.hit for r in rows.select("i", tx.airway_mentioned(F.col("text")).alias("hit")).orderBy("i").collect()]
    assert got == want and got[0] is False and got[1] is True
