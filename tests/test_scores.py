import json
import random
import sys

import pytest
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lethe.functions import names, prompts, scores
from lethe.operators import choices, rewards

register_pickle_by_value(sys.modules[__name__])


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "text,label,confidence,reward,reason",
    [
        ("short", "en", 0.9, 0.0, "too_short"),
        ("x" * 20, "en", 0.9, 1.0, "english"),
        ("x" * 20, "__label__en", 0.6, 1.0, "english"),
        ("x" * 20, "en", 0.5, 0.0, "uncertain"),
        ("x" * 20, "fr", 0.59, 0.0, "uncertain"),
        ("x" * 20, "fr", 0.6, -1.0, "confident_non_english"),
        (" " * 30 + "y", "fr", 0.9, 0.0, "too_short"),
        ("x" * 20, None, None, 0.0, "uncertain"),
    ],
)
def test_language(spark, text, label, confidence, reward, reason):
    df = spark.createDataFrame([(text, label, confidence)], "t string, l string, c double")
    columns = scores.language_columns(F.col("t"), F.col("l"), F.col("c"))
    r = df.select(*[c.alias(n) for n, c in columns.items()]).first()
    assert (r.language_reward, r.language_reason) == (reward, reason)
    assert (r.language_predicted is None) == (reason == "too_short" or label is None)


def test_language_parameters():
    with pytest.raises(ValueError):
        scores.language_columns(F.lit("x"), F.lit("en"), F.lit(1.0), min_chars=-1)
    with pytest.raises(ValueError):
        scores.language_columns(F.lit("x"), F.lit("en"), F.lit(1.0), english_threshold=1.5)


@pytest.mark.parametrize(
    "leak,centered,related,useful,degenerate,want",
    [
        (True, True, True, True, True, 0.0),
        (False, True, True, True, True, 0.1),
        (False, False, True, True, True, 0.2),
        (False, False, True, False, True, 0.0),
        (False, False, True, False, False, 0.4),
        (False, False, False, True, False, 0.6),
        (False, False, True, True, False, 1.0),
    ],
)
def test_ladder(spark, leak, centered, related, useful, degenerate, want):
    args = [F.lit(v) for v in (leak, centered, related, useful, degenerate)]
    assert spark.range(1).select(scores.judgment_reward(*args).alias("x")).first().x == want


def classified(spark, pairs, **options):
    df = spark.createDataFrame([(pairs,)], "s array<struct<label:string,score:double>>")
    return df.select(scores.classification(F.col("s"), **options).alias("c")).first().c


def test_classification(spark):
    c = classified(spark, [("non_refusal", 0.295), ("Refusal", 0.705)])
    assert (c.label, c.score, c.refusal_probability, c.is_refusal, c.top_label_is_refusal) == ("Refusal", 0.7, 0.7, True, True)
    c = classified(spark, [("non-refusal", 0.875)], on_missing="complement", digits=None)
    assert (c.refusal_probability, c.is_refusal) == (0.125, False)
    c = classified(spark, [("a", 0.5), ("b", 0.5)], on_missing="complement", digits=None)
    assert c.label == "a"


def test_classification_errors(spark):
    with pytest.raises(Exception, match="unexpected refusal label"):
        classified(spark, [("toxic", 0.9)])
    with pytest.raises(Exception, match="no refusal class"):
        classified(spark, [("non-refusal", 0.9)])
    with pytest.raises(ValueError):
        classified(spark, [("refusal", 0.9)], on_missing="ignore")


def test_phrases(spark):
    df = spark.createDataFrame([("I'M SORRY, but I can discuss it in general.",), ("fine",)], "t string")
    r = df.select(*[c.alias(n) for n, c in scores.refusal_columns(F.col("t")).items()]).collect()
    assert (r[0].regex_refusal_reward, r[0].regex_refusal_matches) == (1.0, "I'm sorry|Sorry")
    assert (r[1].regex_refusal_reward, r[1].regex_refusal_matches) == (0.0, "")
    a = df.select(*[c.alias(n) for n, c in scores.avoid_refusal_columns(F.col("t"), require_redirection=True).items()]).collect()
    assert (a[0].refusal_reward, a[0].redirection_matches) == (0.0, "but i can|i can discuss|in general")
    assert a[1].refusal_reward == 0.0
    with pytest.raises(ValueError):
        scores.refusal_columns(F.col("t"), [])


def test_r1_r4(spark):
    rows = spark.createDataFrame(
        [(1, "p", "no match", [("refusal", 0.255), ("non-refusal", 0.745)])],
        "id int, prompt string, completion string, classifier_scores array<struct<label:string,score:double>>",
    )
    patterns = spark.createDataFrame([("cat", 0)], "pattern string, ord int")
    p = round(0.255, 2)
    keep = round(1 - p, 2)
    assert rewards.reward("r1", rows, patterns=patterns).first().reward == round(0.4 + 0.6 * keep, 2)
    assert rewards.reward("r4", rows).first().reward == p
    assert rewards.reward_means(rewards.reward("r4", rows)).first().reward_mean == p


def test_pairs_are_checked(spark):
    broken = spark.createDataFrame([("p", None)], "prompt string, completion string")
    with pytest.raises(Exception, match="pairs"):
        rewards.require_pairs(broken).collect()


def test_r2_skips_refusals(spark):
    def open_judge():
        def judge(batch):
            assert all("sorry" not in r["completion"] for r in batch)
            return [dict.fromkeys(scores.JUDGMENT_FIELDS, False) | {"provides_useful_information": True} for _ in batch]

        return judge

    rows = spark.createDataFrame(
        [(1, "k", "p", "sorry", [("refusal", 0.9)]), (2, "k", "p", "text", [("refusal", 0.2)])],
        "id int, concept string, prompt string, completion string, classifier_scores array<struct<label:string,score:double>>",
    )
    out = rewards.reward("r2", rows, open_judge=open_judge).orderBy("id").collect()
    assert [(r.reward, r.llm_judge_provides_useful_information) for r in out] == [(0.0, False), (0.6, True)]


@pytest.mark.parametrize(
    "run,size,variant,label",
    [
        ("unlearning-original-qwen-qwen2-5-0-5b-instruct-x-r1", "0.5B", "original", "cold-start"),
        ("unlearning-r2-warmed-qwen-qwen2-5-3b-instruct-x-r1", "3B", "warmed", "warm-start"),
        ("llama-13b-original", "llama", "original", "cold-start"),
        ("other_warmup", "llama", "", "warm-start"),
    ],
)
def test_run_labels(spark, run, size, variant, label):
    r = spark.range(1).select(
        names.model_size(F.lit("llama"), F.lit(run)).alias("s"),
        names.training_variant(F.lit(run)).alias("v"),
        names.initialization(F.lit(run)).alias("i"),
    ).first()
    assert (r.s, r.v, r.i) == (size, variant, label)


def test_run_parsers(spark):
    runs = [
        "unlearning-r2-warmed-qwen-qwen2-5-1-5b-instruct-karl-marx-r2-reasoning-low",
        "rwku-baseline-qwen-qwen2-5-7b-instruct-karl-marx",
        "unlearning-Original-qwen-qwen2-5-3b-instruct-karl-marx-R4",
    ]
    df = spark.createDataFrame([(r,) for r in runs], "r string")
    out = df.select(
        names.trained_run(F.col("r")).alias("t"), names.baseline_run(F.col("r")).alias("b"), names.stopped_run(F.col("r")).alias("s")
    ).collect()
    assert tuple(out[0].t) == ("r2-warmed", "1.5B", "karl-marx", "r2") and out[0].b is None and out[0].s is None
    assert tuple(out[1].b) == ("7B", "karl-marx")
    assert tuple(out[2].s) == ("original", "3B", "karl-marx", "r4")


def test_model_and_reward(spark):
    models = ["outputs/unlearning-original-qwen-qwen2-5-3b-instruct-x-r2/final_model", "Qwen/Qwen2.5-7B-Instruct"]
    df = spark.createDataFrame([(m,) for m in models], "m string")
    out = [tuple(r[0]) for r in df.select(names.model_and_reward(F.col("m"))).collect()]
    assert out == [("Qwen/Qwen2.5-3B-Instruct", "original-r2"), ("Qwen/Qwen2.5-7B-Instruct", "baseline")]


def test_folder_errors(spark):
    with pytest.raises(Exception, match="cannot read metadata"):
        spark.range(1).select(names.folder_metadata(F.lit("odd"), F.lit("x"))).collect()


def test_labels_and_numbers(spark):
    df = spark.createDataFrame([("Warm-up SFT_initialization",), ("original",), ("mine ",)], "v string")
    assert [r[0] for r in df.select(names.initialization_label(F.col("v"))).collect()] == ["warm-start", "cold-start", "mine"]
    cells = spark.createDataFrame([("1.5",), (" NA ",), ("nan",), ("",), ("x",), (None,)], "v string")
    assert [r[0] for r in cells.select(names.number(F.col("v"))).collect()] == [1.5] + [None] * 5
    values = spark.createDataFrame([(1.0,), (float("nan"),), (float("inf"),), (None,)], "v double")
    assert [r[0] for r in values.select(names.finite(F.col("v"))).collect()] == [1.0, None, None, None]
    sizes = spark.createDataFrame([("Qwen/Qwen2.5-1.5B-Instruct", ""), ("", "qwen-qwen2-5-0-5b-x"), ("", "none")], "m string, r string")
    assert [r[0] for r in sizes.select(names.diagnostic_size(F.col("m"), F.col("r"))).collect()] == ["1.5B", "0.5B", None]


def test_run_choice(spark):
    r = spark.range(1).select(
        names.run_name(F.lit("plain"), F.lit("a-original-b")).alias("a"),
        names.run_name(F.lit(None), F.lit("plain")).alias("b"),
        names.is_eligible_run(F.lit("plain"), F.lit("x-R2-Warmed")).alias("c"),
        names.is_eligible_run(F.lit("plain")).alias("d"),
        names.short_run_name(F.lit("x/unlearning-12/y"), F.lit("f")).alias("e"),
        names.short_run_name(F.lit("x"), F.lit("f")).alias("g"),
    ).first()
    assert tuple(r) == ("a-original-b", "plain", True, False, "unlearning-12", "f")


def test_flat_text(spark):
    kind = T.StructType([T.StructField("text", T.StringType()), T.StructField("n", T.IntegerType())])
    listed = T.ArrayType(T.StringType())
    df = spark.createDataFrame([((" a ", 1), [" x", "", None, "y "])], T.StructType([T.StructField("s", kind), T.StructField("l", listed)]))
    r = df.select(names.plain_text(kind, F.col("s")).alias("s"), names.plain_text(listed, F.col("l")).alias("l")).first()
    assert (r.s, r.l) == ("a", "x y")
    docs = ['{"a":{"b":1}}', '["x"," y",{"text":" t "}]', '{"value":["q"]}', '"s "', "null"]
    v = spark.createDataFrame([(d,) for d in docs], "j string").withColumn("v", F.parse_json("j"))
    assert [r[0] for r in v.select(names.variant_text(F.col("v"))).collect()] == ["1", "x y t", "q", "s", ""]


def test_required(spark):
    df = spark.createDataFrame([(None,), (" ",)], "q string")
    with pytest.raises(Exception, match="missing required question"):
        df.select(names.required(F.col("q"), "question")).collect()
    with pytest.raises(Exception, match="must not be empty"):
        df.where("q is not null").select(names.required_text(F.col("q"), "question")).collect()
    likely = spark.createDataFrame([(None, " d ", "q")], "text string, document string, query string")
    assert likely.select(names.likelihood_text(likely)).first()[0] == "d"


def test_probe_errors(spark):
    with pytest.raises(Exception, match="unsupported probe"):
        spark.range(1).select(prompts.probe_prompt(F.lit("neighbor_level1"), F.lit("3"), F.lit(""), F.lit("q"))).collect()


def test_prompts(spark):
    r = spark.range(1).select(
        prompts.truthful_prompt(F.lit(" q ")).alias("t"), prompts.trivia_prompt(F.lit("q")).alias("v"),
        prompts.few_shot_prompt(
            F.lit("high_school"),
            F.array(F.struct(F.lit("e").alias("question"), F.array(F.lit("1"), F.lit("2")).alias("choices"), F.lit(1).alias("answer"))),
            F.lit("q"), F.array(F.lit("3"), F.lit("4")),
        ).alias("f"),
    ).first()
    assert r.t.endswith("Barcelona, Spain.\n\nQ: q") and r.v.endswith("following question:\nQ: q\n")
    assert r.f == (
        "The following are multiple choice questions (with answers) about high school.\n\n"
        "Question: e\nA. 1\nB. 2\nAnswer: B\n\n"
        "Please following the previous examples and answer the given question.\nQuestion: q\nA. 3\nB. 4"
    )


def test_mc1(spark):
    rows = [
        (1, ["a", "b", "c"], [3.0, 2.0, 1.0], ["a", "b"], [1, 0], 1.0),
        (2, ["a", "b", "a"], [3.0, 2.0, 1.0], ["a", "b"], [1, 0], 0.0),
        (3, ["a", "b"], [1.0, 1.0], ["a", "b"], [1, 0], 0.0),
    ]
    df = spark.createDataFrame(rows, "id int, c array<string>, s array<double>, m array<string>, l array<int>, want double")
    value = choices.mc1_score(F.col("c"), F.col("s"), F.col("m"), F.col("l"))
    for r in df.select("id", "want", value.alias("got")).collect():
        assert r.got == r.want, r.id
    bad = spark.createDataFrame([(["a"], [1.0], ["a"], [1])], "c array<string>, s array<double>, m array<string>, l array<int>")
    with pytest.raises(Exception, match="MC1"):
        bad.select(choices.mc1_score(F.col("c"), F.col("s"), F.col("m"), F.col("l"))).collect()


def test_argmax_takes_the_first(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0],), ([2.0],)], "v array<double>")
    assert [r[0] for r in df.select(choices.argmax(F.col("v"))).collect()] == [1, 0]


def test_losses(spark):
    rnd = random.Random(11)
    rows = [(d, i, 2, -rnd.random()) for d in range(3) for i in range(5)]
    df = spark.createDataFrame(rows, "d int, pos int, plen int, logprob double")
    for r in choices.sequence_loss(df, ["d"]).collect():
        mine = [-x[3] for x in rows if x[0] == r.d]
        assert r.token_count == 5 and r.total_loss == pytest.approx(sum(mine)) and r.loss == pytest.approx(sum(mine) / 5)
    scored = choices.choice_scores(df.withColumn("c", F.lit(0)), ["d"], "c", "pos", "plen", "choice").collect()
    for r in scored:
        mine = [x[3] for x in rows if x[0] == r.d and x[1] >= 2]
        assert r.score == pytest.approx(sum(mine) / 3)
    with pytest.raises(ValueError):
        choices.choice_scores(df, ["d"], "c", "pos", "plen", "other")


def test_values_of_any_depth(spark):
    def flat(value):
        if value is None:
            return ""
        if isinstance(value, dict):
            named = [n for n in ("text", "answer", "content", "value") if n in value]
            return flat(value[named[0]]) if named else flat(list(value.values()))
        if isinstance(value, list):
            return " ".join(t for t in (flat(v) for v in value) if t).strip()
        return str(value).strip()

    rnd = random.Random(9)

    def grown(depth):
        if depth == 0:
            return rnd.choice([" deep text ", "", None, 7, 1.5, "ü"])
        if rnd.random() < 0.5:
            return [grown(depth - 1) for _ in range(rnd.randint(0, 3))]
        keys = sorted(rnd.sample(["a", "b", "content", "text", "z"], rnd.randint(1, 3)))
        return {k: grown(depth - 1) for k in keys}

    values = [{"a": [{"b": {"c": "deep text"}}]}, [[[[[["x"]]]]]], *[grown(d) for d in range(7) for _ in range(12)]]
    df = spark.createDataFrame([(json.dumps(v),) for v in values], "j string")
    got = [r[0] for r in df.select(names.variant_text(F.parse_json("j"))).collect()]
    assert got == [flat(v) for v in values]
