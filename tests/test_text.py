"""Column functions on text and dates against plain Python."""

import datetime
import re
import unicodedata

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumenfold.functions import dates as D
from lumenfold.functions import text as X


def values(spark, texts, make):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r["v"] for r in df.select("i", make(F.col("t")).alias("v")).orderBy("i").collect()]


def plain_fold(s):
    return "".join(c for c in unicodedata.normalize("NFD", s.lower()) if unicodedata.category(c) != "Mn")


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet="aÉçßœ éàñÜø'’-_\n\tZ9.", max_size=30), min_size=1, max_size=20))
def test_folds_equal_python(spark, texts):
    assert values(spark, texts, X.fold_plain) == [plain_fold(t) for t in texts]
    assert values(spark, texts, X.fold_ws) == [" ".join(plain_fold(t).split()) for t in texts]
    assert values(spark, texts, X.fold_key) == [" ".join(re.findall("[a-z0-9]+", plain_fold(t))) for t in texts]


def test_tokens_split_at_apostrophes_and_drop_single_letters(spark):
    assert values(spark, ["L'OFII délivre 2 récépissés_ici", "", None], X.tokens) == [["ofii", "delivre", "recepisses", "ici"], [], None]


def test_language_of_questions(spark):
    got = values(spark, ["How do I renew my permit?", "Comment renouveler mon titre ?", "récépissé", "CAF", ""], X.language)
    assert [g["language"] for g in got] == ["en", "fr", "fr", "en", "en"]
    assert got[3]["confidence"] == 0.0


def test_answer_classes(spark):
    got = values(spark, ["What is the CAF?", "How do I apply?", "How do I apply and what is the deadline?", "Tell me about housing"], X.answer_class)
    assert got == ["micro", "procedural", "complex", "standard"]


def test_excerpt_cuts_at_a_sentence(spark):
    long = "header\n\n" + "One sentence here. " * 40
    got = values(spark, [long, "short", "a\n\nb"], X.excerpt)
    assert got[0].endswith(".…") and len(got[0]) <= 421
    assert got[1:] == ["short", "b"]


def test_dates(spark):
    texts = ["1er juillet 2026", "31/02/2024", "7/3/2024", "2024-13-01", "5 May 2021", "soon", None]
    assert values(spark, texts, D.parse_date) == ["2026-07-01", "", "2024-03-07", "2024-13-01", "2021-05-05", "", ""]


def test_asked_about(spark):
    now = F.lit("2026-07-15").cast("date")
    got = values(spark, ["before July 2026", "in June 2026", "rules of 2024", "last year", "now?", "on 2026-01-02 what changed"], lambda c: D.asked_about(c, now))
    day = datetime.date
    assert [g["on"] for g in got] == [day(2026, 6, 30), day(2026, 6, 30), day(2024, 12, 31), day(2025, 12, 31), day(2026, 7, 15), day(2026, 1, 2)]
    assert got[5]["about_change"] and not got[4]["historical"]
