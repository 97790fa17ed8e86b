"""Cleaned words are what the pattern leaves of them."""

from pyspark.sql import functions as F

from tomoloom.functions.text import NON_WORD_PATTERN, clean_word


def test_cleaned_words_are_those_of_the_pattern(spark):
    marks = [chr(c) for c in range(0x250)] + ["\u2013", "\u0130", "\u212a", "\uff21", "\u6f22", "\U0001f600"]
    words = ["", None, "-", "it's", "na\u00efve", "E\u0301tude", "A-b_C9", "\x00", "\u00e9", *marks, *(f"a{m}B{m}" for m in marks)]
    frame = spark.createDataFrame([(w,) for w in words], "word string")
    plain = F.lower(F.regexp_replace("word", NON_WORD_PATTERN, ""))
    assert frame.filter(~clean_word(F.col("word")).eqNullSafe(plain)).collect() == []
    # Words of single bytes do without the pattern.
    assert "translate" in frame.select(clean_word(F.col("word")))._jdf.queryExecution().executedPlan().toString()
