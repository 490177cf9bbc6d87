import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from forumloom.functions import normalize as N
from forumloom.functions.charsets import space_characters
from forumloom.functions.porter import stem
from forumloom.operators import normalizing as S
from forumloom.operators import tokens

CASES = [
    (N.normalize_apostrophes, "it‛s Ann‘s `word´", "it's Ann's 'word'"),
    (N.remove_code_blocks, "first,\n\n    code one\n    code two\n\nlast", "first,\n\n\nlast"),
    (N.remove_hyperlinks, "see [this](https://www.example.org/a?b=c) now, awww!", "see [this]( now, a"),
    (N.normalize_hyphens, "~one-two–three—four---", "~one-two-three-four-"),
    (N.remove_inline_code, "run `ls` or ``cat x`` now", "run  or  now"),
    (N.blank_punctuation, "it's \"a-b. c/d @e, <<f>> g_h!\"", "it's  a-b  c/d  e    f   g_h  "),
    (N.normalize_quotation_marks, "『one』 “two‘s” \"three\" （four）", "\"one\" \"two‘s\" \"three\" \"four\""),
    (N.remove_quoted_lines, "one\n\n> two\n\n>> three\n\nfour", "one\n\nfour"),
    (N.collapse_whitespace, "one \t\t\n\n\r\x0b\x0c two", "one two"),
    (N.remove_accents, "ìíîïñòóôõöùúûüý ½ ﬁ … ß 😀 𝐀", "iiiinooooouuuuy 12 fi ...   A"),
    (N.lower_case, "One TWO Three.", "one two three."),
    (N.passthrough, "One TWO", "One TWO"),
    (N.strip, "　\x1c one\xa0two \x85\n", "one\xa0two"),
    (N.remove_ascii_punctuation, "a\\b[c]^d`e-f", "a\\bcdef"),
]


@pytest.mark.parametrize("function, text, expected", CASES, ids=[c[0].__name__ for c in CASES])
def test_examples(spark, function, text, expected):
    df = spark.createDataFrame([(text,)], "text string")
    assert df.select(function(F.col("text"))).first()[0] == expected


def test_entities_look_at_the_original_text(spark):
    rows = [("&amp;lt; x",), ("&amp;lt; x &lt;",), ("&gt;&#32;a&nbsp;b &quot;",)]
    got = [r.text for r in S.convert_entities(spark.createDataFrame(rows, "text string"), "text").collect()]
    assert got == ["&lt; x", "< x <", "> a b &quot;"]


def test_order_of_the_full_normalization(spark):
    rows = [("a–b &ndash; c",), ("    CODE first\nrest",), ("`tick",), ("www.foo > bar\nx",), (None,)]
    got = [r.text for r in S.normalize_text(spark.createDataFrame(rows, "text string"), "text").collect()]
    assert got == ["ab - c", "code first rest", "'tick", "bar x", None]


def test_rules_must_be_pairs_of_strings():
    for bad in [re.compile("."), ("x",), ("x", None), (re.compile("x"), "y")]:
        with pytest.raises(TypeError):
            S.rewrite_group(bad)


def test_random_texts_equal_a_python_model(spark):
    """Row-local functions against Python's ``re`` and ``unicodedata`` on adversarial characters."""
    generator = random.Random(7)
    alphabet = list("aZ09_'-/.>`&;\n\t \r\x0b\x0c\x07\x08\x1c\x85\xa0éßß½ﬁ…–—“’") + [" ", "​", "﻿", " ", "😀", "http", "    ", "&gt;"]
    texts = ["".join(generator.choices(alphabet, k=generator.randint(0, 40))) for _ in range(600)]
    white = "[᠎ -​  　﻿\n\t\x0b\x08\r\f\x07 ]+"
    models = {
        "code": (N.remove_code_blocks, lambda x: re.sub(r"(^|\n)(\t| {4,})+.+?$", "", x, flags=re.M)),
        "link": (N.remove_hyperlinks, lambda x: re.sub(r"(http|www)\S+", "", x)),
        "inline": (N.remove_inline_code, lambda x: re.sub(r"`+.+?`+", "", x)),
        "quoted": (N.remove_quoted_lines, lambda x: re.sub(r"(^|\n) {,3}(&gt;|>).*?\n", "", x)),
        "punct": (N.blank_punctuation, lambda x: re.sub(r"[^\w\s\'\-/_]", " ", x)),
        "white": (N.collapse_whitespace, lambda x: re.sub(white, " ", x)),
        "strip": (N.strip, str.strip),
        "accents": (
            N.remove_accents,
            lambda x: unicodedata.normalize("NFKD", x).encode("ascii", "ignore").decode("ascii"),
        ),
    }
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, text string")
    out = df.select("i", *[f(F.col("text")).alias(name) for name, (f, _) in models.items()]).collect()
    for row in out:
        for name, (_, model) in models.items():
            assert row[name] == model(texts[row.i]), (name, texts[row.i])


def test_every_space_character_is_known():
    assert len(space_characters()) == 29


def test_porter():
    words = "a highly inflected sentence is one having lots of morphemes for stemming"
    assert " ".join(map(stem, words.split())) == "a highli inflect sentenc is one have lot of morphem for stem"


def test_stop_words_and_lemmas(spark):
    df = spark.createDataFrame([("1", "Here is a lovely sentence that HAS copious stopwords"), ("2", "the of"), ("3", None)], "comment_id string, text string")
    got = {r.comment_id: r.text for r in tokens.remove_stop_words(df).collect()}
    assert got == {"1": "lovely sentence copious stopwords", "2": "", "3": None}
    lemmas = spark.createDataFrame([("stopwords", "stopword")], "token string, lemma string")
    got = {r.comment_id: r.text for r in tokens.map_tokens(tokens.remove_stop_words(df), lemmas).collect()}
    assert got == {"1": "lovely sentence copious stopword", "2": "", "3": None}


def test_normalization_needs_no_python_and_no_shuffle(spark):
    df = S.normalize_text(spark.createDataFrame([("x",)], "text string"), "text")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
