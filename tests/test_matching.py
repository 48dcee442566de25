import random
import re

import pytest
from pyspark.sql import functions as F

from lethe.functions import fuzzy, matching
from lethe.operators import rewards

PATTERNS = [("Stephen King", 0), ("The Shining", 1), ("Carrie", 2), ("It", 3)]
TEXTS = [
    (1, "Stephen King wrote Carrie. CARRIE, it scared me."),
    (2, "Kingston has a kitten."),
    (3, "étoile It’s it_ it"),
    (4, ""),
]


@pytest.fixture(scope="module")
def patterns(spark):
    return spark.createDataFrame(PATTERNS, "pattern string, ord int")


def test_golden_scores(spark, patterns):
    df = matching.with_matches(spark.createDataFrame(TEXTS, "id int, text string"), patterns, "text", "id")
    m = F.col("matches")
    got = {
        r.id: (r.names, r.dis, r.occ)
        for r in df.select(
            "id", matching.entity_names(m).alias("names"), matching.distinct_count(m).alias("dis"),
            matching.occurrence_count(m).alias("occ"),
        ).collect()
    }
    assert got == {1: ("Stephen King|Carrie|It", 3, 4), 2: ("", 0, 0), 3: ("It", 1, 2), 4: ("", 0, 0)}


@pytest.mark.parametrize(
    "mode,want",
    [
        ("entity_count", [0.25, 1.0, 0.5, 1.0]),
        ("exponential", [0.018316, 1.0, 0.135335, 1.0]),
        ("length_aware", [0.201897, 1.0, 0.449329, 1.0]),
        ("binary", [0.0, 1.0, 0.0, 1.0]),
    ],
)
def test_reward_modes(spark, patterns, mode, want):
    df = rewards.reward("r0", spark.createDataFrame(TEXTS, "id int, text string"), patterns=patterns, completion="text", mode=mode)
    assert [round(r.reward, 6) for r in df.orderBy("id").collect()] == want


def python_counts(text, patterns):
    found = {}
    for p, _ in patterns:
        n = len(re.findall(rf"(?<!\w){re.escape(p)}(?!\w)", text, flags=re.IGNORECASE))
        if n:
            found[p] = n
    return found


def test_matches_do_not_depend_on_keys(spark):
    patterns = spark.createDataFrame([("Ⓐ", 0), ("Carrie", 1)], "pattern string, ord int")
    rows = [(None, "x ⓐ y Carrie"), (1, "Ⓐ"), (1, "carrie carrie"), (1, "carrie carrie"), (2, None), (2, "")]
    found = matching.with_matches(spark.createDataFrame(rows, "id int, text string"), patterns, "text", "id").collect()
    got = sorted((r.id or 0, r.text or "", [(m.pattern, m.n) for m in r.matches]) for r in found)
    assert got == [
        (0, "x ⓐ y Carrie", [("Ⓐ", 1), ("Carrie", 1)]),
        (1, "carrie carrie", [("Carrie", 2)]),
        (1, "carrie carrie", [("Carrie", 2)]),
        (1, "Ⓐ", [("Ⓐ", 1)]),
        (2, "", []),
        (2, "", []),
    ]


def test_matches_follow_python(spark):
    rnd = random.Random(6)
    words = ["it", "It", "the", "Kelvin", "Kelvin", "STRASSE", "straße", "ſea", "sea", "σας", "ΣΑΣ", "x_y", "11/22/63",
             "Mr. Mercedes", "É", "é", "a.b", "\\E", "µm", "μm", "$5", "ﬆ", "!!"]
    dictionary = [(w, i) for i, w in enumerate(words)] + [
        (" ".join(rnd.choices(words, k=2)), 100 + i) for i in range(30)
    ]
    dictionary = list({p: (p, o) for p, o in dictionary}.values())
    texts = [(i, rnd.choice([" ", ", "]).join(rnd.choices(words, k=rnd.randint(0, 25)))) for i in range(150)]
    df = matching.with_matches(
        spark.createDataFrame(texts, "id int, text string"),
        spark.createDataFrame(dictionary, "pattern string, ord int"),
        "text", "id",
    )
    for r in df.collect():
        assert {m.pattern: m.n for m in r.matches} == python_counts(r.text, dictionary), r.text


def test_concept_dictionaries(spark):
    patterns = spark.createDataFrame([("a", "cat", 0), ("b", "dog", 0)], "concept string, pattern string, ord int")
    rows = spark.createDataFrame([(1, "a", "cat dog"), (2, "b", "cat dog"), (3, "c", "cat")], "id int, concept string, text string")
    out = matching.with_matches(rows, patterns, "text", "id", "concept")
    got = {r.id: [m.pattern for m in r.matches] for r in out.collect()}
    assert got == {1: ["cat"], 2: ["dog"], 3: []}


def test_select_patterns(spark):
    table = spark.createDataFrame(
        [("K", "hard", 0, "x"), ("K", "hard", 1, "y"), ("K", "soft", 0, "y"), ("K", "soft", 1, "z")],
        "concept string, split string, ord int, pattern string",
    )

    def chosen(splits):
        return [r.pattern for r in matching.select_patterns(table, "K", splits).orderBy("ord").collect()]

    assert chosen(("hard", "soft")) == ["x", "y", "z"]
    assert chosen("soft, hard") == ["y", "z", "x"]
    with pytest.raises(ValueError, match="no patterns"):
        matching.select_patterns(table, "nobody")
    with pytest.raises(ValueError, match="unknown pattern split"):
        matching.select_patterns(table, "K", ["firm"])
    with pytest.raises(ValueError, match="at least one"):
        matching.select_patterns(table, "K", " ,")


def test_parameters_are_checked():
    one = F.lit(1)
    for options in ({"mode": "other"}, {"mode": "binary", "min_words": 0}, {"mode": "binary", "alpha": -1}):
        with pytest.raises(ValueError):
            matching.forgetting_score(options.pop("mode"), one, one, one, **options)
    with pytest.raises(ValueError):
        rewards.reward("r9", None)
    with pytest.raises(ValueError):
        rewards.reward("", None)


def test_normalize(spark):
    texts = ["Pelé & Co.", "STRASSE ß", "ﬁne “Quote”", "北京 2008", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(fuzzy.normalize("t").alias("n"))
    assert [r.n for r in df.collect()] == ["pele co", "strasse ss", "fine quote", "2008", None]


@pytest.mark.parametrize(
    "pattern,text,want",
    [
        ("stephenking", "ilovedstephanking", True),
        ("stephenking", "king", True),
        ("cujo", "cu", True),
        ("cujo", "mycuj0x", False),
        ("misery", "thebanker", False),
    ],
)
def test_similarity_golden(pattern, text, want):
    assert fuzzy.similar(pattern, text) is want


def lcs(x, y):
    row = [0] * (len(y) + 1)
    for c in x:
        new = [0]
        for j, d in enumerate(y, 1):
            new.append(row[j - 1] + 1 if c == d else max(row[j], new[-1]))
        row = new
    return row[-1]


def brute(a, b, threshold=85.0):
    """Every window of the longer string, its cut-off ends included."""
    if not a or not b:
        return False

    def slide(s, t):
        m = len(s)
        windows = [t[i : i + m] for i in range(len(t) - m + 1)]
        windows += [t[:w] for w in range(1, m)] + [t[-w:] for w in range(1, m)]
        return any(200 * lcs(s, w) >= threshold * (m + len(w)) for w in windows)

    if len(a) > len(b):
        a, b = b, a
    return slide(a, b) or (len(a) == len(b) and slide(b, a))


def noisy(rnd, pattern):
    letters = list(pattern)
    for _ in range(rnd.randint(0, 4)):
        if letters:
            letters[rnd.randrange(len(letters))] = rnd.choice(["", "a", "bc", "d"])
    ends = ["".join(rnd.choices("abcd", k=rnd.randint(0, 15))) for _ in range(2)]
    text = ends[0] + "".join(letters) + ends[1]
    return text[rnd.randint(0, 5) : rnd.randint(3, 40)] if rnd.random() < 0.4 else text


def test_similarity_against_brute_force():
    rnd = random.Random(7)
    for _ in range(12):
        patterns = ["".join(rnd.choices("abcd", k=rnd.randint(4, 26) if i else 70)) for i in range(6)]
        for text in [noisy(rnd, rnd.choice(patterns)) for _ in range(20)]:
            for pattern in patterns:
                assert fuzzy.similar(pattern, text) == brute(pattern, text)


def python_matches(text, patterns):
    """Every pattern against the whole text, the plain way."""
    normal = fuzzy._folded(text) or ""
    found = []
    for pattern, order in patterns:
        wanted = fuzzy._folded(pattern)
        n = len(re.findall(rf"(?<!\w){wanted}(?!\w)", normal)) if wanted else 0
        compact = wanted.replace(" ", "")
        if n or (len(compact) >= fuzzy.MIN_COMPACT_LENGTH and brute(compact, normal.replace(" ", ""))):
            found.append((order, pattern, max(n, 1), n > 0))
    return sorted(found)


@pytest.mark.parametrize("threshold_chars", [fuzzy.BROADCAST_CHARS, 0])
def test_join_against_brute_force(spark, monkeypatch, threshold_chars):
    monkeypatch.setattr(fuzzy, "BROADCAST_CHARS", threshold_chars)
    monkeypatch.setattr(fuzzy, "CHUNK", 16)
    rnd = random.Random(11)
    words = ["".join(rnd.choices("abcdé", k=rnd.randint(1, 7))) for _ in range(30)]
    patterns = list(dict.fromkeys(" ".join(rnd.choices(words, k=rnd.choice([1, 1, 2, 3, 5]))) for _ in range(40)))
    patterns = [(p, i) for i, p in enumerate([*patterns, "ab ab", "a a", "--", "x" * 70, "ab"])]
    texts = [" ".join(rnd.choices(words, k=rnd.randint(0, 30))) for _ in range(25)]
    # Near copies of patterns, short texts (shorter than most patterns), repeats, marks and long texts.
    texts += [noisy(rnd, rnd.choice(patterns)[0]) for _ in range(80)]
    texts += ["", None, " . ", "a", "ab", "b!", "a a a a a", "ab ab ab", "x" * 68, "x" * 200, "É a B", "y" * 500 + "x" * 65]
    rows = [(None if i % 5 == 0 else i % 7, t) for i, t in enumerate(texts)] + [(1, "ab ab a"), (1, "ab ab a"), (None, "ab ab a")]
    found = fuzzy.with_fuzzy_matches(
        spark.createDataFrame(rows, "id int, text string"), spark.createDataFrame(patterns, "pattern string, ord int"), "text", "id"
    )
    assert "CartesianProduct" not in found._jdf.queryExecution().toString()
    assert "NestedLoopJoin" not in found._jdf.queryExecution().toString()
    got = [(r.id, r.text, [tuple(m) for m in r.fuzzy_matches]) for r in found.collect()]
    assert len(got) == len(rows)
    for _, text, matches in got:
        assert matches == python_matches(text, patterns), text
    assert sorted((str(i), str(t)) for i, t, _ in got) == sorted((str(i), str(t)) for i, t in rows)


def test_join_without_texts_or_patterns(spark, patterns):
    none = spark.createDataFrame([], "id int, text string")
    assert fuzzy.with_fuzzy_matches(none, patterns, "text").count() == 0
    rows = spark.createDataFrame([(1, "Carrie")], "id int, text string")
    assert fuzzy.with_fuzzy_matches(rows, patterns.limit(0), "text").first().fuzzy_matches == []
    with pytest.raises(ValueError, match="threshold"):
        fuzzy.with_fuzzy_matches(rows, patterns, "text", threshold=20.0)


def test_pairs_are_counted_where_they_are_found(spark):
    texts = ["one two, one two  one two ONE TWO", "no no no no", "one  two.", "(one two) three", "one two.\u0345 one two", "two. one two.", ""]
    patterns = [("one two", 0), ("no no", 1), ("one two.", 2), ("(one two", 3), ("two", 4), ("one  two", 5), ("two,", 6), (".", 7), ("no no no", 8)]
    rows = [(t,) for t in texts + texts[:2]]
    df = spark.createDataFrame(rows, "text string")
    table = spark.createDataFrame(patterns, "pattern string, ord int")
    near = matching.candidates(df.withColumn("__text_id", F.col("text")), matching.entries(table), "text")
    listed = {r["__text_id"]: {e.pattern: (e.n, e.marked is None) for e in r["__candidates"]} for r in near.collect()}
    # Equal texts count once; words and pairs need no search of the text, other patterns do.
    assert [listed[texts[0]].get(p) for p in ("one two", "two", "one two.")] == [(4, True), (4, True), (None, False)]
    assert listed[texts[1]] == {p: (None, False) for p in ("no no", "no no no")}
    got = [(r.text, {m.pattern: m.n for m in r.matches}) for r in matching.with_matches(df, table, "text").collect()]
    assert len(got) == len(rows)
    for text, found in got:
        counts = {p: len(re.findall(rf"(?i)(?<!\w){re.escape(p)}(?!\w)", text)) for p, _ in patterns}
        assert found == {p: n for p, n in counts.items() if n}, text


def test_candidates_wait_for_the_check_without_their_chunk(spark, patterns):
    rows = spark.createDataFrame([(1, "Stephan King wrote Carrie")], "id int, text string")
    found = fuzzy.with_fuzzy_matches(rows, patterns, "text")
    # A function in a filter keeps every waiting row whole, on disk where memory ends.
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "_normalize_other" in plan
    assert all("_normalize_other" in line for line in plan.splitlines() if "EvalPython" in line)
    assert [m.pattern for m in found.first().fuzzy_matches] == ["Stephen King", "Carrie"]


def test_fuzzy_matches(spark, patterns):
    rows = spark.createDataFrame(
        [(1, "Stephan King wrote CARRIE, carrie it scared me."), (2, "Kingston has a kitten."), (3, "It's the shinning"), (4, "")],
        "id int, text string",
    )
    out = fuzzy.with_fuzzy_matches(rows, patterns, "text", "id")
    got = {r.id: [(m.pattern, m.n, m.exact) for m in r.fuzzy_matches] for r in out.collect()}
    assert got == {
        1: [("Stephen King", 1, False), ("Carrie", 2, True), ("It", 1, True)],
        2: [],
        3: [("The Shining", 1, False), ("It", 1, True)],
        4: [],
    }


def test_fuzzy_by_concept(spark):
    patterns = spark.createDataFrame([("a", "Carrie", 0), ("b", "Annie Wilkes", 0)], "concept string, pattern string, ord int")
    rows = spark.createDataFrame(
        [(1, "a", "carri annie wilkes"), (2, "b", "carri annie wilks"), (3, "c", "carrie"), (4, None, "carrie")], "id int, concept string, text string"
    )
    out = fuzzy.with_fuzzy_matches(rows, patterns, "text", "id", "concept")
    assert {r.id: [m.pattern for m in r.fuzzy_matches] for r in out.collect()} == {1: ["Carrie"], 2: ["Annie Wilkes"], 3: [], 4: []}


def test_fuzzy_rewards(spark, patterns):
    rows = spark.createDataFrame(TEXTS, "id int, text string")
    r3 = rewards.reward("r3", rows, patterns=patterns, completion="text").orderBy("id").collect()
    assert [round(r.reward, 6) for r in r3][0] == 0.201897
    binary = rewards.fuzzy_reward(rows, patterns, "text", mode="binary").orderBy("id").collect()
    assert binary[0].fuzzy_reward == 0.0 and binary[3].fuzzy_reward == 1.0
    with pytest.raises(ValueError):
        rewards.fuzzy_reward(rows, patterns, "text", mode="entity_count")


def table_words(x, y):
    """Words of a longest common subsequence by the full table, read from the ends."""
    table = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i, a in enumerate(x, 1):
        for j, b in enumerate(y, 1):
            table[i][j] = table[i - 1][j - 1] + 1 if a == b else max(table[i - 1][j], table[i][j - 1])
    found, i, j = set(), len(x), len(y)
    while i and j:
        if x[i - 1] == y[j - 1]:
            found.add(x[i - 1])
            i, j = i - 1, j - 1
        elif table[i - 1][j] > table[i][j - 1]:
            i -= 1
        else:
            j -= 1
    return found


def test_common_words_follow_the_full_table():
    rnd = random.Random(2)
    for _ in range(400):
        x, y = (rnd.choices("abcde"[: rnd.randint(1, 5)], k=rnd.randint(0, 90)) for _ in range(2))
        assert fuzzy._common_words(x, y) == table_words(x, y)


def test_lcs_recall(spark):
    rows = [("a b c d", "a c e"), ("", "noanswer x"), ("x", ""), ("p q. r s", "q p. s r"), ("b a", "a. b"), ("a  b .", "a b. "), (None, "a")]
    df = spark.createDataFrame(rows, "p string, r string")
    whole = [r[0] for r in df.select(fuzzy.lcs_recall(F.col("p"), F.col("r"), by_sentence=False)).collect()]
    assert whole[:4] == [pytest.approx(2 / 3), 0.0, 0.0, pytest.approx(0.25)]
    got = [r[0] for r in df.select(fuzzy.lcs_recall(F.col("p"), F.col("r"))).collect()]
    # Words found in either pair of sentences count; a sentence of blanks is one empty word.
    assert got == [pytest.approx(2 / 3), 0.0, 0.0, pytest.approx(0.5), 1.0, pytest.approx(2 / 3), None]
