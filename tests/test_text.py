import math
import random
import re
import string
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lethe.functions import text as X


def rows(spark, values, schema):
    return spark.createDataFrame(values, schema)


@pytest.mark.parametrize(
    "prediction,reference,f1,exact",
    [
        ("The Rim of Fire.", "Ring of Fire", 0.666667, 0.0),
        ("the", "an", 1.0, 1.0),
        ("the", "x", 0.0, 0.0),
        ("a b b c", "b b b", 0.666667, 0.0),
        ("U.S. Navy", "us navy", 1.0, 1.0),
        ("", "", 1.0, 1.0),
        ("the—end", "—end", 1.0, 1.0),
    ],
)
def test_overlap_golden(spark, prediction, reference, f1, exact):
    df = rows(spark, [(prediction, reference)], "p string, r string")
    out = df.select(X.token_f1(F.col("p"), F.col("r")).alias("f"), X.exact_match(F.col("p"), F.col("r")).alias("e")).first()
    assert round(out.f, 6) == f1 and out.e == exact


def python_f1(prediction, reference):
    def tokens(t):
        t = "".join(c for c in t.lower() if c not in set(string.punctuation))
        return re.sub(r"\b(a|an|the)\b", " ", t).split()

    p, r = tokens(prediction), tokens(reference)
    if not p or not r:
        return 1.0 if p == r else 0.0
    same = sum((Counter(p) & Counter(r)).values())
    if not same:
        return 0.0
    return 2 * (same / len(p)) * (same / len(r)) / (same / len(p) + same / len(r))


def test_f1_matches_python(spark):
    rnd = random.Random(3)
    pool = ["the", "a", "An", "cat", "Cat!", "dog", "ünder", "under", "it's", "(x)", "—", "the—x", " ", "1st"]
    pairs = [
        (" ".join(rnd.choices(pool, k=rnd.randint(0, 9))), " ".join(rnd.choices(pool, k=rnd.randint(0, 9))))
        for _ in range(300)
    ]
    df = rows(spark, pairs, "p string, r string").withColumn("f", X.token_f1(F.col("p"), F.col("r")))
    for r in df.collect():
        assert r.f == pytest.approx(python_f1(r.p, r.r)), (r.p, r.r)


@pytest.mark.parametrize(
    "text,h2,h3,weighted",
    [("a b a b a", 1.0, 0.918296, 0.945531), ("a b c d", 1.584963, 1.0, 1.194988), ("a", 0.0, 0.0, 0.0)],
)
def test_entropy_golden(spark, text, h2, h3, weighted):
    df = rows(spark, [(text,)], "t string").withColumn("w", F.split("t", " "))
    out = df.select(X.ngram_entropy(F.col("w"), 2).alias("a"), X.ngram_entropy(F.col("w"), 3).alias("b"))
    out = out.withColumn("c", X.weighted_entropy(F.col("a"), F.col("b"))).first()
    assert (round(out.a, 6), round(out.b, 6), round(out.c, 6)) == (h2, h3, weighted)


def test_entropy_matches_python(spark):
    rnd = random.Random(4)
    texts = [" ".join(rnd.choices("a b c , . é".split(), k=rnd.randint(0, 30))) for _ in range(100)]
    df = rows(spark, [(t,) for t in texts], "t string")
    out = df.select("t", X.ngram_entropy(X.entropy_tokens(F.col("t")), 2).alias("h")).collect()
    for r in out:
        tokens = r.t.split()
        grams = Counter(zip(tokens, tokens[1:]))
        total = sum(grams.values())
        want = -sum(c / total * math.log2(c / total) for c in grams.values()) if total else 0.0
        assert r.h == pytest.approx(want, abs=1e-9)


@pytest.mark.parametrize(
    "text,want",
    [
        ("Good muffins cost $3.88\nin New York.  Please buy me\ntwo of them.\nThanks.", "Good muffins cost $ 3.88 in New York . Please buy me two of them . Thanks ."),
        ("They'll save and invest more.", "They 'll save and invest more ."),
        ("hi, my name can't hello,", "hi , my name ca n't hello ,"),
        ('"Hello," she said. "Why?"', "`` Hello , '' she said . `` Why ? ''"),
        ("I cannot go (now) -- really?! I wanna.", "I can not go ( now ) -- really ? ! I wan na ."),
        ("Dr. Smith left. He's J. K. Lane, i.e. me... so what... Yes", "Dr. Smith left . He 's J. K. Lane , i.e. me ... so what ... Yes"),
        ("'Tis a: b, c; 10:30 1,000 50% [x] {y} <z> a*b", "'T is a : b , c ; 10:30 1,000 50 % [ x ] { y } < z > a * b"),
        ("«Oui», dit-il. ‘no’ “yes” ``x''", "« Oui » , dit-il . ‘ no ’ “ yes ” `` x ''"),
        ("the dogs' tails. I've said I'd. n't", "the dogs ' tails . I 've said I 'd . n't"),
        ("one.two three.", "one.two three ."),
        ("", ""),
        ("  \t\n ", ""),
        (".", "."),
    ],
)
def test_entropy_tokens_golden(spark, text, want):
    assert rows(spark, [(text,)], "t string").select(X.entropy_tokens(F.col("t"))).first()[0] == want.split()


def test_question(spark):
    df = rows(spark, [("Who? Why?",), ("No mark",), ("?",), ("",)], "t string")
    assert [r[0] for r in df.select(X.question(F.col("t"))).collect()] == ["Who?", "No mark?", "?", "?"]


def test_word_count_follows_python(spark):
    texts = ["Stephen King wrote Carrie.", "étoile It’s it_ it", "", "½ x² naïve", "a-b_c 12.5"]
    df = rows(spark, [(t,) for t in texts], "t string").select("t", X.word_count(F.col("t")).alias("n"))
    for r in df.collect():
        assert r.n == len(re.findall(r"\b\w+\b", r.t)), r.t


def test_strip_and_blank(spark):
    texts = ["  x ", " x\x1f", "\n\t", "", "a b"]
    df = rows(spark, [(t,) for t in texts], "t string")
    for r in df.select("t", X.strip(F.col("t")).alias("s"), X.is_nonblank(F.col("t")).alias("b")).collect():
        assert r.s == r.t.strip() and r.b == (r.t.strip() != "")


def test_round_follows_python(spark):
    rnd = random.Random(5)
    values = [0.125, 0.295, 0.285, 1.005, 2.675, -0.125, 0.0, 0.705] + [rnd.random() for _ in range(2000)]
    values += [round(rnd.random(), 3) for _ in range(2000)]
    df = rows(spark, [(v,) for v in values], "v double").select("v", X.py_round(F.col("v"), 2).alias("r"))
    assert [r for r in df.collect() if r.r != round(r.v, 2)] == []


def test_answer_extraction(spark):
    texts = ["So the answer is  42 . Yes.", "|he answer is x.", "plain ", "", "the answer is none"]
    want = ["42", "x", "plain", "NOANSWER", "the answer is none"]
    df = rows(spark, [(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(X.extract_answer(F.col("t"))).collect()] == want


def test_prefix(spark):
    df = rows(spark, [("q\n",), ("q ",), ("q",)], "t string")
    out = [r[0] for r in df.select(X.prefixed_prompt(F.col("t"), "A:")).collect()]
    assert out == ["q\nA:", "q A:", "q A:"]
    out = [r[0] for r in df.select(X.prefixed_prompt(F.col("t"), "A:", False)).collect()]
    assert out == ["q\nA:", "q A:", "qA:"]


def test_digest_keeps_values_apart(spark):
    df = rows(spark, [("ab", "c"), ("a", "bc"), (None, "abc"), ("", "abc")], "x string, y string")
    assert df.select(X.digest(F.col("x"), F.col("y"))).distinct().count() == 4


def test_entropy_tokens_take_the_same_rules_with_and_without_quotes(spark):
    # Each rule by itself: what was drawn together in one pass, and texts that quotes send through all rules.
    texts = ["cannot gimme gonna,gotta lemme wanna go. wanna", "Cannot? GONNA! (gotta) wanna\nx cannot", "a, b: c... (d) -- e* f; 3,4 [g] {h} <i>", "wannabe cannots xcannot cannot_ Lemme."]
    with_quotes = [t + " 'tis 'twas d'ye more'n isn't it's they'll \"q\"" for t in texts]
    got = {r.t: r.w for r in rows(spark, [(t,) for t in texts + with_quotes], "t string").select("t", X.entropy_tokens(F.col("t")).alias("w")).collect()}
    tail = ["'t", "is", "'t", "was", "d", "'ye", "more", "'n", "is", "n't", "it", "'s", "they", "'ll", "``", "q", "''"]
    assert got[texts[0]] == "can not gim me gon na , got ta lem me wan na go . wan na".split()
    assert got[texts[1]] == "Can not ? GON NA ! ( got ta ) wan na x can not".split()
    assert got[texts[3]] == "wannabe cannots xcannot cannot_ Lem me .".split()
    for text, quoted in zip(texts, with_quotes):
        assert got[quoted][-len(tail) :] == tail
    # A text without quotes goes without the rules for them.
    plan = rows(spark, [("a",)], "t string").select(X.entropy_tokens(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" in plan
