import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lethe.operators import prepare, report, runs
from lethe.sources import tables


@pytest.fixture(scope="module")
def splits(spark, tmp_path_factory):
    corpus = spark.range(120).select(
        F.col("id").alias("pos"),
        F.when(F.col("id") % 3 == 0, "Karl Marx").otherwise("Tony Blair").alias("concept"),
        F.concat(F.lit("q"), F.col("id").cast("string"), F.lit("?")).alias("prompt"),
        F.lit("answer").alias("completion"),
    )
    folder = str(tmp_path_factory.mktemp("splits") / "data")
    tables.write_splits(prepare.seeded_splits(corpus, ["concept"], "pos", 1, 0.2, 0.1, 0.05), folder)
    return folder


def test_load_splits_reads_one_partition(spark, splits):
    train, test = tables.load_splits(spark, splits, "Karl Marx", "grpo")
    assert train.count() + test.count() == 40 - 5 and test.count() == 8
    plan = train._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(concept" in plan
    with pytest.raises(ValueError):
        tables.load_splits(spark, splits, "Karl Marx", "ppo")


def test_load_prompts(spark, splits):
    first = tables.load_prompts(spark, splits, "Tony Blair", "pos", 4, False)
    shuffled = tables.load_prompts(spark, splits, "Tony Blair", "pos", 4, True)
    whole = tables.load_prompts(spark, splits, "Tony Blair", "pos", None, True)
    assert (first.count(), shuffled.count(), whole.count()) == (4, 4, 16)


def test_publish_and_restore(spark, splits, tmp_path):
    out, back = str(tmp_path / "published"), str(tmp_path / "back")
    tables.publish_splits(spark, splits, out)
    held = tables.load_published(spark, out, "holdout")
    assert "completion" not in held.columns and held.count() == 8 + 16
    assert tables.load_published(spark, out, "sft_train").first().completion == "answer"
    with pytest.raises(ValueError):
        tables.load_published(spark, out, "other")
    tables.restore_splits(spark, out, back)
    original = spark.read.parquet(splits)
    restored = spark.read.parquet(back)
    columns = ["pos", "concept", "split", "prompt"]
    assert original.select(columns).exceptAll(restored.select(columns)).isEmpty()
    assert restored.count() == original.count()


def test_missing_split_is_an_error(spark):
    partial = spark.createDataFrame([("K", "sft/train")], "concept string, split string")
    with pytest.raises(ValueError, match="missing splits"):
        tables.require_splits(partial)


def test_load_probes(spark, tmp_path):
    rows = [(0, "b"), (1, "a"), (2, "b"), (3, "c"), (4, "a")]
    spark.createDataFrame(rows, "pos int, query string").write.parquet(str(tmp_path / "p"))
    assert [r.pos for r in tables.load_probes(spark, str(tmp_path / "p")).orderBy("pos").collect()] == [0, 1, 3]


def write_log(folder: Path, name: str, rows: list, columns=("step", "prompt", "completion")) -> None:
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text(json.dumps({"columns": list(columns), "data": rows}), encoding="utf-8")


def test_log_tables(spark, tmp_path):
    run = tmp_path / "run one"
    write_log(run, "completions_9_x.table.json", [[1, "p", "old"], [1, "q", "a"], [2, "p", "b"]])
    write_log(run, "completions_10_x.table.json", [[2, "p", "new"], [2, "p", "new"], [3, "r", "é"]])
    write_log(tmp_path / "run two", "completions_1_x.table.json", [[7, "p", "z"]])
    log = tables.read_log_tables(
        spark, f"{tmp_path}/*/*.table.json", {"step": "bigint", "prompt": "string", "completion": "string"}
    )
    rows = log.orderBy("folder", "pos").collect()
    assert [(r.folder, r.table_order, r.step, r.completion) for r in rows] == [
        ("run one", 0, 1, "old"), ("run one", 0, 1, "a"), ("run one", 0, 2, "b"),
        ("run one", 1, 2, "new"), ("run one", 1, 2, "new"), ("run one", 1, 3, "é"),
        ("run two", 0, 7, "z"),
    ]
    chosen = runs.select_log_rows(log, ["folder"], 2, deduplicate=True).orderBy("folder", "pos").collect()
    assert [(r.completion, r.last_step_index, r.step_from_end) for r in chosen] == [("new", 1, 2), ("é", 2, 1), ("z", 1, 1)]
    indexed = runs.add_missing_indices(log, ["folder"]).orderBy("folder", "pos").collect()
    assert [(r.prompt_index, r.completion_index) for r in indexed] == [(0, 0), (1, 0), (0, 0), (0, 1), (0, 2), (0, 0), (0, 0)]
    with pytest.raises(ValueError, match="missing columns"):
        runs.select_log_rows(log.drop("prompt"), ["folder"], 2)


def test_log_table_cells(spark, tmp_path):
    write_log(tmp_path / "r", "completions_1_x.table.json", [[0.5, None, True]], ("reward", "prompt", "flag"))
    log = tables.read_log_tables(spark, f"{tmp_path}/r/*.json", {"reward": "double", "prompt": "string", "flag": "boolean", "absent": "string"})
    r = log.first()
    assert (r.reward, r.prompt, r.flag, r.absent) == (0.5, None, True, None)


HEADER = "forget_concept,model_name_or_path,stat,refusal,lexical_leakage\n"


def test_summaries(spark, tmp_path):
    base = tmp_path / "karl-marx-Qwen-Qwen2.5-3B-Instruct"
    trained = tmp_path / "karl-marx-.-outputs-unlearning-original-qwen-qwen2-5-3b-instruct-karl-marx-r1-final_model"
    for folder, value in ((base, "0.25"), (trained, "NA")):
        folder.mkdir()
        (folder / "summary.csv").write_text(HEADER + f"Karl Marx,m,mean,{value},0.5\n", encoding="utf-8")
    (tmp_path / "old" / "deep").mkdir(parents=True)
    (tmp_path / "old" / "deep" / "summary.csv").write_text(HEADER + "X,m,mean,1,1\n", encoding="utf-8")
    rows = tables.read_summaries(spark, str(tmp_path), ["refusal", "lexical_leakage"])
    assert rows.count() == 2
    table = {r.training_variant: r for r in tables.run_table(rows, ["refusal", "lexical_leakage"]).collect()}
    assert table["baseline"].refusal_mean == 0.25 and table["baseline"].forget_concept == "Karl Marx"
    assert table["original"].refusal_mean is None and table["original"].rlvr_mode == "zero-RLVR"
    assert report.mean_columns(tables.run_table(rows, ["refusal"])) == ["refusal_mean"]
    with pytest.raises(ValueError, match="missing columns"):
        tables.read_summaries(spark, str(tmp_path), ["other"])


def test_benchmark_summaries(spark, tmp_path):
    labels = list(report.SUMMARY_LABELS.values())
    for run, cell in (("rwku-baseline-qwen-qwen2-5-3b-instruct-karl-marx", ".5"), ("unlearning-original-qwen-qwen2-5-3b-instruct-Karl_Marx-r1", "NA")):
        folder = tmp_path / run / "eval"
        folder.mkdir(parents=True)
        (folder / "t.csv").write_text(",".join(["Model", *labels]) + "\n" + ",".join(["m", *[cell] * 12]) + "\n", encoding="utf-8")
    rows = tables.read_benchmark_summaries(spark, f"{tmp_path}/*/eval/t.csv", 2)
    got = {r.run_name: r.forget_fb for r in rows.collect()}
    assert sorted(got.values(), key=str) == [0.5, None]
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "t.csv").write_text("Model\nm\n", encoding="utf-8")
    with pytest.raises(ValueError, match="missing metrics"):
        tables.read_benchmark_summaries(spark, f"{tmp_path}/x/t.csv", 1)


def test_shards(spark, tmp_path):
    for i in (0, 1):
        (tmp_path / f"rows.shard{i}.jsonl").write_text(json.dumps({"v": i}) + "\n", encoding="utf-8")
    assert sorted(r.v for r in tables.read_shards(spark, str(tmp_path), "rows", 2, "v int").collect()) == [0, 1]
    with pytest.raises(ValueError, match=r"missing shard output of rows: \[2\]"):
        tables.read_shards(spark, str(tmp_path), "rows", 3, "v int")


def test_stop_markers_and_imputation(spark, tmp_path):
    for run in (
        "unlearning-original-qwen-qwen2-5-3b-instruct-karl-marx-r1",
        "unlearning-r2-warmed-qwen-qwen2-5-3b-instruct-nobody-r1",
        "unrelated",
    ):
        (tmp_path / run).mkdir()
        (tmp_path / run / "low_reward_stop.json").write_text(json.dumps({"reason": "no", "global_step": 3}, indent=2), encoding="utf-8")
    markers = tables.read_stop_markers(spark, str(tmp_path))
    assert sorted(r.concept_key for r in markers.collect()) == ["karlmarx", "nobody"]
    rows = report.add_provenance(
        spark.createDataFrame(
            [("karlmarx", "baseline", "3B", "baseline", "baseline", "b", 0.5)],
            "concept_key string, training_variant string, model_size string, reward_type string, rlvr_mode string, run_name string, refusal_mean double",
        )
    )
    full = report.impute_stopped_runs(rows, markers).where("run_status = 'no-learning'").collect()
    assert [(r.refusal_mean, r.rlvr_mode, r.result_source, r.stop_reason) for r in full] == [(0.5, "zero-RLVR", "baseline-imputed", "no")]


def test_folder_subjects(spark, tmp_path):
    for name in ("1_Karl_Marx", "plain", "2_Tony_Blair"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "fts.json").write_text("{}", encoding="utf-8")
    got = {r.subject for r in tables.folder_subjects(spark, f"{tmp_path}/*/fts.json").collect()}
    assert got == {"Karl Marx", "plain", "Tony Blair"}


def test_inventory_round_trip(spark, tmp_path):
    rows = spark.createDataFrame(
        [
            ("1", "a", "Karl Marx", 120, ["x/completions_9_a", "x/completions_10_a", "x/completions_2_a"]),
            ("2", "b", "Karl Marx", 5, ["x/completions_1_a"]),
            ("3", "c", "Somebody", 200, ["x/completions_1_a"]),
        ],
        "run_id string, run_name string, forget_concept string, available_table_count int, completion_tables array<string>",
    )
    tables.write_inventory(rows, str(tmp_path / "inv"))
    got = tables.read_inventory(spark, str(tmp_path / "inv"), ["karl marx"], 2, 101).collect()
    assert [(r.run_id, r.completion_tables) for r in got] == [("1", ["x/completions_9_a", "x/completions_10_a"])]
    every = tables.read_inventory(spark, str(tmp_path / "inv"), ["karl marx"], 0, 1).orderBy("run_id").collect()
    assert [len(r.completion_tables) for r in every] == [3, 1]


def test_recent_tables(spark):
    names_ = ["completions_10_a", "completions_9_a", "other", "completions_10_b"]
    df = spark.createDataFrame([("r", n) for n in names_], "run string, name string")
    got = [r.name for r in runs.recent_tables(df, ["run"], "name", 2).collect()]
    assert sorted(got) == ["completions_10_a", "completions_10_b"]
    assert runs.recent_tables(df, ["run"], "name", 0).count() == 4


def test_reuse_or_build(spark, tmp_path):
    path, calls = str(tmp_path / "points"), []

    def build():
        calls.append(1)
        return spark.createDataFrame([(1.0, "m")], "train_global_step double, model_name string")

    for _ in range(2):
        assert tables.reuse_or_build(spark, path, ["train_global_step", "model_name"], build).count() == 1
    assert len(calls) == 1


def test_checkpoints(spark, tmp_path):
    for n in (9, 10, 100):
        folder = tmp_path / "run" / f"checkpoint-{n}"
        folder.mkdir(parents=True)
        (folder / "trainer_state.json").write_text(json.dumps({"global_step": n, "num_input_tokens_seen": n * 10}, indent=2), encoding="utf-8")
    rows = tables.checkpoints(spark, str(tmp_path), [100, 200], "K").orderBy("global_step").collect()
    assert [(r.milestone_index, r.token_milestone, r.run_name) for r in rows] == [(0, 100, "run"), (1, 200, "run"), (2, None, "run")]


def test_csv_and_json(spark, tmp_path):
    df = spark.createDataFrame([("a", None, 1.5)], "x string, y string, z double")
    tables.write_csv(df.coalesce(1), str(tmp_path / "c"), ["z", "y", "x"])
    text = "".join(p.read_text() for p in (tmp_path / "c").glob("part-*.csv"))
    assert text == "z,y,x\n1.5,,a\n"
    tables.write_rows(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).first().z == 1.5
    assert tables.nested_metrics(df).first().metrics == '{"x":"a","y":null,"z":1.5}'


def test_pending_work(spark):
    work = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "k string")
    outputs = spark.createDataFrame([("a", "m"), ("a", "s"), ("b", "m"), ("b", "m"), ("c", "x")], "k string, output string")
    stopped = spark.createDataFrame([("d",)], "k string")
    left = tables.pending_work(work, outputs, "k", ["m", "s"], stopped)
    assert sorted(r.k for r in left.collect()) == ["b", "c"]


def test_summaries_are_read_by_their_own_headers(spark, tmp_path):
    for folder, text in (
        ("a", "forget_concept,model_name_or_path,stat,refusal,lexical_leakage\nX,m,mean,0.1,0.9\n"),
        ("b", 'lexical_leakage,extra,refusal,stat,model_name_or_path,forget_concept\n0.9,z,0.1,mean,m,"K ""x"""\n'),
    ):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "summary.csv").write_text(text, encoding="utf-8")
    rows = tables.read_summaries(spark, str(tmp_path), ["refusal", "lexical_leakage"]).collect()
    assert {(r.refusal, r.lexical_leakage) for r in rows} == {(0.1, 0.9)}
    assert {r.forget_concept for r in rows} == {"X", 'K "x"'}
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "summary.csv").write_text("forget_concept,model_name_or_path,stat,refusal\nX,m,mean,0.1\n", encoding="utf-8")
    with pytest.raises(ValueError, match="missing columns"):
        tables.read_summaries(spark, str(tmp_path), ["refusal", "lexical_leakage"])


def test_concepts_are_written_side_by_side(spark, tmp_path):
    path = str(tmp_path / "splits")
    for concept in ("007", "b"):
        rows = [(concept, s, f"p{s}", "c", concept, None) for s in tables.PUBLISHED]
        df = spark.createDataFrame(rows, "concept string, split string, prompt string, completion string, subject string, broad_completion string")
        tables.write_splits(df, path)
    for concept in ("007", "b"):
        train, test = tables.load_splits(spark, path, concept, "sft")
        assert train.count() == test.count() == 1 and train.first().subject == concept
    tables.publish_splits(spark, path, str(tmp_path / "published"))
    tables.restore_splits(spark, str(tmp_path / "published"), str(tmp_path / "back"))
    kept = tables.read_partitioned(spark, str(tmp_path / "back"), ["concept", "split"])
    assert {(r.concept, r.split) for r in kept.collect()} == {(c, s) for c in ("007", "b") for s in tables.PUBLISHED}
