"""Text cleaning, composition and n-gram edge cases (FIXTURES 3.2)."""

from pyspark.sql import functions as F

from claimlens.functions import ngrams as NG
from claimlens.functions import text as TX


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "x string").select(expr.alias("y")).first()["y"]


def test_normalize_edge_cases(spark):
    n = TX.normalize_text("x")
    assert one(spark, n, None) == ""
    assert one(spark, n, "a\u200cb") == "ab"
    assert one(spark, n, "\ufeffa\u200b\u200db") == "ab"
    assert one(spark, n, "\u09a1\u200c\u09bc") == "\u09dc"      # zero-width goes first
    assert one(spark, n, "\u09a2\u09bc") == "\u09dd"
    assert one(spark, n, "\u09af\u09bc") == "\u09af\u09bc"      # not composed
    assert one(spark, n, "\u00a0a\u2003b\u001cc\td\u000be\u0085") == "a b c d e"
    assert one(spark, n, "x\u180ey") == "x\u180ey"                # not whitespace
    assert one(spark, n, "  many   spaces \n\n here ") == "many spaces here"


def test_compose_strategies(spark):
    df = spark.createDataFrame([(None, "x", " ")], "c string, a string, e string")
    r = df.select(*[TX.compose_text("c", "a", "e", s).alias(s) for s in TX.STRATEGIES]).first()
    assert r["concat"] == " x"
    assert r["sep_token"] == "[CLAIM]  [ARTICLE] x"
    assert r["claim_only"] == ""
    assert r["excerpt"] == "[CLAIM]  [ARTICLE] x"   # blank excerpt counts as empty
    r2 = df.select(TX.is_present("e").alias("f"), TX.text_length("c").alias("l")).first()
    assert r2["f"] == 1 and r2["l"] == 0
    df2 = spark.createDataFrame([("c", "a", "ex")], "c string, a string, e string")
    assert df2.select(TX.compose_text("c", "a", "e", "excerpt")).first()[0] == "[CLAIM] c [EXCERPT] ex"


def test_unknown_strategy_raises():
    import pytest
    with pytest.raises(ValueError):
        TX.compose_text("c", "a", "e", "nope")


def test_label_binarize(spark):
    df = spark.createDataFrame([("MANI",), ("NO_MANI",), (None,), ("mani",)], "s string")
    assert [r[0] for r in df.select(TX.label_binarize("s")).collect()] == [1, 0, 0, 0]


def test_length_counts_code_points(spark):
    assert one(spark, TX.text_length("x"), "\U0001F600a") == 2


def test_word_tokens_python_word_rule(spark):
    toks = one(spark, NG.word_tokens("x"), "প্রধানমন্ত্রী ১০ জন word a_b Ⅷ x")
    assert toks == ["রধ", "নমন", "১০", "জন", "word", "a_b"]


def test_word_ngrams(spark):
    g = one(spark, NG.word_ngrams("x"), "The cat sat")
    assert sorted(g) == sorted(["the", "cat", "sat", "the cat", "cat sat", "the cat sat"])
    assert one(spark, NG.word_ngrams("x"), "a") == []
    assert sorted(one(spark, NG.word_ngrams("x"), "aa bb")) == ["aa", "aa bb", "bb"]


def test_word_ngram_ranges_match_python(spark):
    texts = ["", "aa", "aa bb", "aa bb cc", "one two three four five six", "x yy zz yy zz yy"]
    df = spark.createDataFrame([(t,) for t in texts], "x string")
    for lo, hi in [(1, 1), (2, 2), (1, 4), (2, 3), (3, 5)]:
        got = [r[0] for r in df.select(NG.word_ngrams("x", (lo, hi))).collect()]
        for t, g in zip(texts, got):
            toks = [w for w in t.lower().split() if len(w) >= 2]
            want = [" ".join(toks[i:i + n]) for n in range(lo, hi + 1) for i in range(len(toks) - n + 1)]
            assert g == want, (lo, hi, t)


def test_char_wb_ngrams(spark):
    assert sorted(one(spark, NG.char_wb_ngrams("x"), "a")) == sorted([" a", "a ", " a "])
    g = one(spark, NG.char_wb_ngrams("x"), "ab")
    assert sorted(g) == sorted([" a", "ab", "b ", " ab", "ab ", " ab "])
    g = one(spark, NG.char_wb_ngrams("x"), "abcdef")
    # padded length 8: n = 2..5 -> 7 + 6 + 5 + 4 grams
    assert len(g) == 22 and " abcd" in g and "cdef " in g


def python_char_wb(text, lo=2, hi=5):
    out = []
    for w in text.lower().split():
        w = " " + w + " "
        for n in range(lo, hi + 1):
            off = 0
            out.append(w[off:off + n])
            while off + n < len(w):
                off += 1
                out.append(w[off:off + n])
            if off == 0:
                break
    return out


def test_char_wb_matches_reference_rule(spark):
    texts = ["Hello wonderful   World", "x", "ab cd efghij", "Ünïcödé wörds ok", "a bb ccc dddd eeeee ffffff"]
    df = spark.createDataFrame([(t,) for t in texts], "x string")
    got = [r[0] for r in df.select(NG.char_wb_ngrams("x")).collect()]
    for t, g in zip(texts, got):
        assert sorted(g) == sorted(python_char_wb(t)), t
