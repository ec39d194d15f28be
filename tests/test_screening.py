"""The screen never rules out a text that a test matches."""

import random
import re

from pyspark.sql import functions as F

from panelspark import fixed_values as fv
from panelspark.functions.screening import Screen, required
from panelspark.operators import relevance as R


def test_literals_of_patterns():
    assert required(r"\bthe\s+\w+\s+of\s+(china|india)\b") == [frozenset({"china", "india"}), frozenset({"the"})]
    assert required(r"(aa+|b+cd)") == [frozenset({"a", "cd"})]
    assert required(r"\w+\d*(x|)") == [] and required("x?") == []


def test_texts_that_match_pass_the_screen(spark):
    """Texts made of the patterns' own pieces, in any case and with letters that only ignoring case makes equal."""
    draw = random.Random(2)
    pieces = sorted({x for x, _ in R.SCREEN.masks}) + ["$", "5", " ", "  ", "%", "m", ":", "-", "of", "of the day", "price", "target", "x", "10", "million"]
    odd = {"s": "ſ", "i": "İ", "k": "K"}
    texts = []
    for _ in range(4000):
        t = draw.choice(["", " "]).join(draw.choice(pieces) + " " * draw.randint(0, 2) for _ in range(draw.randint(1, 6)))
        t = "".join(draw.choice([c, c.upper(), odd.get(c, c)]) if draw.random() < 0.2 else c for c in t)
        texts.append((t,))
    df = spark.createDataFrame([*texts, (None,), ("",)], "title string").withColumn("seen", R.SCREEN.of(F.col("title")))
    title = F.coalesce("title", F.lit(""))
    missed, hits = [], []
    for i, p in enumerate(R.TITLE_PATTERNS):
        missed.append(F.count_if(R.matches(title, p) & ~R.SCREEN.may(F.col("seen"), p)).alias(f"p{i}"))
        hits.append(F.count_if(R.matches(title, p)).alias(f"h{i}"))
    for i, p in enumerate(R.TITLE_PHRASES):
        missed.append(F.count_if(R.any_phrase(F.lower(title), p) & ~R.SCREEN.may(F.col("seen"), p)).alias(f"q{i}"))
    got = df.agg(*missed, *hits).first().asDict()
    assert not any(got[c] for c in got if c[0] in "pq") and sum(got[c] > 0 for c in got if c[0] == "h") > 12


def test_a_screen_has_room_for_63_bits():
    try:
        Screen([f"word{i}" for i in range(64)], [])
    except ValueError:
        return
    raise AssertionError


def test_fixed_patterns_all_name_literals():
    assert all(R.SCREEN.bits.values()) and fv.HEDGE_PATTERN not in R.SCREEN.bits
    assert re.compile(fv.CONSUMER_PATTERN, re.I).search("10% off")
