"""Keys, labels and metadata read from run names, folders and loosely typed cells."""

from __future__ import annotations

import json
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lethe.functions.text import strip

# Run and folder names.
RUN_PATTERN = r"(?:^|-)original(?:-|$)|(?:^|-)r\d+-warmed(?:-|$)"
BASELINE_FOLDER = r"(?i)^(.+)-Qwen-Qwen2\.5-(0\.5B|1\.5B|3B|7B)-Instruct$"
TRAINED_FOLDER = (
    r"(?i)^(.+)-\.-outputs-unlearning-(original|r2-warmed)-qwen-qwen2-5-"
    r"(0-5b|1-5b|3b|7b)-instruct-.+-(r\d+)-final_model$"
)
WARMUP_FOLDER = r"(?i)^(.+)-\.-outputs-r2warmup_qwen_qwen2_5_(0_5b|1_5b|3b|7b)_instruct_.+-final_model$"
STOPPED_RUN = r"(?i)^unlearning-(original|r2-warmed)-qwen-qwen2-5-(0-5b|1-5b|3b|7b)-instruct-(.+)-(r\d+)$"
TRAINED_RUN = (
    r"(?i)^unlearning-(original|r2-warmed)-qwen-qwen2-5-(0-5b|1-5b|3b|7b)-instruct-(.+)-"
    r"(r\d+)(?:-reasoning-low)?$"
)
BASELINE_RUN = r"(?i)^rwku-baseline-qwen-qwen2-5-(0-5b|1-5b|3b|7b)-instruct-(.+)$"
TRAINED_MODEL = (
    r"(?i)(?:^|/)unlearning-(original|r2-warmed)-qwen-qwen2-5-(0-5b|1-5b|3b)-instruct-.*-(r\d+)"
    r"(?:/final_model)?$"
)
TABLE_NUMBER = r"completions_(\d+)_"
MODEL_PREFIX, MODEL_SUFFIX = "Qwen/Qwen2.5-", "-Instruct"
INITIALIZATION_LABELS = {
    "original": "cold-start",
    "original initialization": "cold-start",
    "r2 warmed": "warm-start",
    "r2 warmup": "warm-start",
    "warmup sft initialization": "warm-start",
    "warm up sft initialization": "warm-start",
    "sft warmup initialization": "warm-start",
    "sft warm up initialization": "warm-start",
}
LIKELIHOOD_COLUMNS = [
    "text", "passage", "document", "content", "input", "prompt", "query", "question", "answer",
]


def key_of(value: Column) -> Column:
    """Letters and digits only: joins names spelled with different separators."""
    return F.regexp_replace(F.lower(value), "[^a-z0-9]+", "")


def words_of(value: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(value), "[^a-z0-9]+", " "))


def slug(value: Column, separator: str = "-") -> Column:
    return F.regexp_replace(
        F.regexp_replace(F.lower(value), "[^a-z0-9]+", separator), f"^{separator}+|{separator}+$", ""
    )


def safe_name(value: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(value, "[^A-Za-z0-9_.-]+", "-"), "^-+|-+$", "")


def short_run_name(model: Column, folder: Column) -> Column:
    """'unlearning-<number>' from the model, else from the folder, else the folder."""
    number = r"(unlearning-\d+)"
    found = [F.nullif(F.regexp_extract(F.coalesce(c, F.lit("")), number, 1), F.lit("")) for c in (model, folder)]
    return F.coalesce(*found, folder)


def in_allow_list(value: Column, allowed: Sequence[str]) -> Column:
    return words_of(value).isin([words_of(F.lit(a)) for a in allowed])


def subject_filter(df: DataFrame, subjects: str | Sequence[str] | None, column: str = "subject") -> DataFrame:
    """Keep the listed subjects; 'all', 'none', an empty list or a missing column keeps all."""
    if isinstance(subjects, str):
        subjects = [] if subjects.strip().lower() in ("", "all", "none") else subjects.split(",")
    wanted = [s.strip() for s in subjects or [] if s.strip()]
    if not wanted or column not in df.columns:
        return df
    return df.where(F.col(column).isin(wanted))


def size_label(size: Column) -> Column:
    """'0-5b', '0_5b' or '0.5b' as 0.5B; nothing for other sizes."""
    plain = F.regexp_replace(F.lower(size), "[-_]", ".")
    return F.when(plain.isin("0.5b", "1.5b", "3b", "7b"), F.upper(plain))


def model_size(model: Column, run: Column | None = None, unknown: Column | None = None) -> Column:
    source = F.lower(F.concat_ws(" ", model, run if run is not None else F.lit("")))
    return (
        F.when(F.regexp_like(source, F.lit(r"0[._-]?5b")), "0.5B")
        .when(F.regexp_like(source, F.lit(r"1[._-]?5b")), "1.5B")
        .when(F.regexp_like(source, F.lit(r"(?<![0-9])3b")), "3B")
        .when(F.regexp_like(source, F.lit(r"(?<![0-9])7b")), "7B")
        .otherwise(model if unknown is None else unknown)
    )


def diagnostic_size(model: Column, run: Column) -> Column:
    """Size from the full model name, else from the run name; null when neither tells."""
    named = F.nullif(
        F.regexp_extract(F.coalesce(model, F.lit("")), r"(?i)Qwen2\.5-(0\.5B|1\.5B|3B|7B)-Instruct", 1), F.lit("")
    )
    short = F.nullif(
        F.regexp_extract(F.coalesce(run, F.lit("")), r"(?i)qwen-qwen2-5-(0-5b?|1-5b?|3b?|7b?)(?:-|_|$)", 1), F.lit("")
    )
    number = F.regexp_replace(F.regexp_replace(F.lower(short), "b$", ""), "-", ".")
    return F.coalesce(F.upper(named), F.concat(number, F.lit("B")))


def model_name(size: Column) -> Column:
    return F.concat(F.lit(MODEL_PREFIX), size, F.lit(MODEL_SUFFIX))


def training_variant(run: Column) -> Column:
    name = F.lower(run)
    return (
        F.when(F.regexp_like(name, F.lit(r"(?:^|-)r\d+-warmed(?:-|$)")), "warmed")
        .when(F.regexp_like(name, F.lit(r"(?:^|-)original(?:-|$)")), "original")
        .otherwise("")
    )


def initialization(run: Column) -> Column:
    name = F.lower(run)
    warm = F.regexp_like(name, F.lit(r"(?:^|-)(?:r\d+-)?warmed(?:-|$)|warmup"))
    return (
        F.when(F.regexp_like(name, F.lit(r"(?:^|-)original(?:-|$)")), "cold-start")
        .when(warm, "warm-start")
        .otherwise("")
    )


def initialization_label(value: Column) -> Column:
    plain = F.regexp_replace(F.replace(F.lower(strip(value)), F.lit("-"), F.lit(" ")), r"[\s_]+", " ")
    label = strip(value)
    for alias, shown in INITIALIZATION_LABELS.items():
        label = F.when(plain == alias, F.lit(shown)).otherwise(label)
    return label


def filled_initialization(value: Column, run: Column) -> Column:
    """The given label, or the one the run name implies."""
    return initialization_label(F.coalesce(F.nullif(value, F.lit("")), initialization(run)))


def run_name(*candidates: Column) -> Column:
    """First candidate that names an eligible run, else the first one present."""
    present = F.filter(F.array(*candidates), lambda c: c.isNotNull() & (c != ""))
    eligible = F.filter(present, lambda c: F.regexp_like(F.lower(c), F.lit(RUN_PATTERN)))
    return F.coalesce(F.get(eligible, F.lit(0)), F.get(present, F.lit(0)))


def is_eligible_run(*candidates: Column) -> Column:
    return F.exists(
        F.array(*[F.coalesce(c, F.lit("")) for c in candidates]),
        lambda c: F.regexp_like(F.lower(c), F.lit(RUN_PATTERN)),
    )


def rlvr_mode(variant: Column) -> Column:
    return (
        F.when(variant == "original", "zero-RLVR")
        .when(variant.isin("r2-warmed", "r2-warmup"), "warm-up")
        .when(variant == "baseline", "baseline")
    )


def folder_metadata(folder: Column, csv_concept: Column) -> Column:
    """Metadata struct of a result folder; the table's own spelling of the concept is kept
    when it names the same concept. An unknown folder is an error."""

    def part(pattern: str, group: int) -> Column:
        return F.nullif(F.regexp_extract(folder, pattern, group), F.lit(""))

    base, trained, warm = (F.regexp_like(folder, F.lit(p)) for p in (BASELINE_FOLDER, TRAINED_FOLDER, WARMUP_FOLDER))
    concept = F.when(base, part(BASELINE_FOLDER, 1)).when(trained, part(TRAINED_FOLDER, 1)).when(
        warm, part(WARMUP_FOLDER, 1)
    ).otherwise(F.raise_error(F.concat(F.lit("cannot read metadata from folder "), folder)).cast("string"))
    size = size_label(
        F.when(base, part(BASELINE_FOLDER, 2)).when(trained, part(TRAINED_FOLDER, 3)).otherwise(part(WARMUP_FOLDER, 2))
    )
    variant = F.when(base, "baseline").when(trained, F.lower(part(TRAINED_FOLDER, 2))).otherwise("r2-warmup")
    reward = F.when(base, "baseline").when(trained, F.lower(part(TRAINED_FOLDER, 4))).otherwise("r2-warmup")
    own = F.coalesce(strip(csv_concept), F.lit(""))
    own_slug = F.regexp_replace(F.regexp_replace(F.lower(own), r"[\s_]+", "-"), "^-+|-+$", "")
    return F.struct(
        F.when(own_slug == F.lower(concept), own).otherwise(concept).alias("forget_concept"),
        model_name(size).alias("model_name_or_path"),
        size.alias("model_size"),
        reward.alias("reward_type"),
        variant.alias("training_variant"),
        rlvr_mode(variant).alias("rlvr_mode"),
        folder.alias("run_name"),
        F.lit("").alias("experiment_seed"),
    )


def _run_struct(run: Column, pattern: str, groups: dict[str, int]) -> Column:
    parts = {name: F.regexp_extract(run, pattern, g) for name, g in groups.items()}
    fields = []
    for name, value in parts.items():
        if name == "model_size":
            value = size_label(value)
        elif name in ("training_variant", "reward_type"):
            value = F.lower(value)
        fields.append(value.alias(name))
    return F.when(F.regexp_like(run, F.lit(pattern)), F.struct(*fields))


def trained_run(run: Column) -> Column:
    """Struct(training_variant, model_size, author, reward_type), null when the name differs."""
    return _run_struct(run, TRAINED_RUN, {"training_variant": 1, "model_size": 2, "author": 3, "reward_type": 4})


def stopped_run(run: Column) -> Column:
    return _run_struct(run, STOPPED_RUN, {"training_variant": 1, "model_size": 2, "author": 3, "reward_type": 4})


def baseline_run(run: Column) -> Column:
    return _run_struct(run, BASELINE_RUN, {"model_size": 1, "author": 2})


def model_and_reward(model: Column) -> Column:
    """Struct(model, reward) without the author; anything untrained is a baseline."""
    trained = F.regexp_like(model, F.lit(TRAINED_MODEL))
    size = size_label(F.regexp_extract(model, TRAINED_MODEL, 2))
    label = F.lower(
        F.concat(F.regexp_extract(model, TRAINED_MODEL, 1), F.lit("-"), F.regexp_extract(model, TRAINED_MODEL, 3))
    )
    return F.struct(
        F.when(trained, model_name(size)).otherwise(model).alias("model"),
        F.when(trained, label).otherwise("baseline").alias("reward"),
    )


def table_number(name: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(name, TABLE_NUMBER, 1), F.lit("")).cast("int"), F.lit(-1))


def finite(value: Column) -> Column:
    """Keeps finite numbers, null otherwise."""
    return F.when(value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf")), value)


def number(value: Column) -> Column:
    """Number in a text cell; blank, NA, NAN and unreadable cells are null."""
    cell = strip(value)
    return F.when(~F.upper(cell).isin("", "NA", "NAN"), cell.try_cast("double"))


def first_present(df: DataFrame, names: Sequence[str]) -> Column:
    present = [F.col(n) for n in names if n in df.columns]
    return F.coalesce(*present) if present else F.lit(None).cast("string")


#: The fields of an object that hold its text, best first.
PREFERRED = ("text", "answer", "content", "value")


def plain_text(df_type: T.DataType, value: Column) -> Column:
    """Trimmed text of a typed value: lists are joined by a space, structs prefer the fields
    text, answer, content and value, blanks are left out."""
    if isinstance(df_type, T.StringType):
        return F.coalesce(strip(value), F.lit(""))
    if isinstance(df_type, T.ArrayType):
        parts = F.transform(value, lambda v: plain_text(df_type.elementType, v))
        return F.coalesce(F.array_join(F.filter(parts, lambda p: p != ""), " "), F.lit(""))
    if isinstance(df_type, T.StructType):
        for name in PREFERRED:
            if name in df_type.fieldNames():
                return plain_text(df_type[name].dataType, value[name])
        parts = F.array(*[plain_text(f.dataType, value[f.name]) for f in df_type.fields])
        return F.array_join(F.filter(parts, lambda p: p != ""), " ")
    return F.coalesce(strip(value.cast("string")), F.lit(""))


def _flat(value: object) -> str:
    if value is None:
        return ""
    if isinstance(value, dict):
        preferred = next((value[n] for n in PREFERRED if n in value), None)
        return _flat(preferred) if any(n in value for n in PREFERRED) else _flat(list(value.values()))
    if isinstance(value, list):
        return " ".join(text for text in map(_flat, value) if text).strip()
    return str(value).strip()


@F.pandas_udf(T.StringType())
def _flat_json(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else _flat(json.loads(v)))


def variant_text(value: Column) -> Column:
    """``plain_text`` of a VARIANT holding a text, a number, or lists and objects of any depth.

    Only lists and objects are unfolded in Python, value by value.
    """
    text = F.coalesce(strip(F.try_variant_get(value, "$", "string")), F.lit(""))
    kind = F.schema_of_variant(value)
    nested = F.startswith(kind, F.lit("ARRAY")) | F.startswith(kind, F.lit("OBJECT"))
    unfolded = _flat_json(F.when(nested, F.to_json(value)))
    return F.when(value.isNull() | F.is_variant_null(value), "").when(nested, unfolded).otherwise(text)


def nested_text(value: Column, path: str, default: str = "") -> Column:
    """Text at a dotted path of a VARIANT; a missing step gives the default."""
    return F.coalesce(F.try_variant_get(value, f"$.{path}", "string"), F.lit(default))


def likelihood_text(df: DataFrame) -> Column:
    """Text of the first candidate column that is not null."""
    return F.coalesce(strip(first_present(df, LIKELIHOOD_COLUMNS)), F.lit(""))


def required(value: Column, what: str) -> Column:
    """The value, or an error that names what is missing."""
    return F.coalesce(value, F.raise_error(F.lit(f"missing required {what}")).cast("string"))


def required_text(value: Column, what: str) -> Column:
    text = strip(value)
    return F.when(text != "", text).otherwise(F.raise_error(F.lit(f"{what} must not be empty")).cast("string"))
