"""Quality rules, personal data, toxicity, near-duplicates and line dedup against brute force on small rows."""

import hashlib
import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lethe.llm import lines, neardup, pii, quality, toxicity
from lethe.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_words long, kept string, score string, spans int, line int, node int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def documents(spark, texts, first=0):
    """Rows whose extra columns are named like columns of results."""
    return spark.createDataFrame([(first + i, t, None, None, -1, "x", "y", 1, 2, 3) for i, t in enumerate(texts)], SCHEMA).repartition(3)


def prose(n, seed=0, vocabulary=4000):
    chooser = random.Random(seed)
    return " ".join(f"w{chooser.randrange(vocabulary)}" for _ in range(n))


ODD = [None, "", " \t\n ", "one", "a b", "a b c d", "éß \U0001f600 x", prose(30_000, 5)]


# Quality


def measured_by_hand(text):
    words = WORD.findall(text or "")
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    rows = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(rows) - len(set(rows)), len(covered)


def test_measures_match_a_direct_count(spark):
    texts = [*ODD, "a b c a b c", "x x x x", "l1 a\nl1 a\n\n \nl2", "# * a|b <c>", "a b c d a b c e b c d", prose(60) + " " + prose(60)]
    rows = quality.apply_rules(documents(spark, texts)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == measured_by_hand(texts[r.doc_id])


def test_rules_name_what_fails(spark):
    good = " ".join(f"the w{i} of x{i}" for i in range(40))
    rows = {r.doc_id: r for r in quality.apply_rules(documents(spark, [good, good.upper(), "the " * 100, "# " * 300, None])).collect()}
    assert rows[0].kept and rows[0].failed == []
    assert "capitals" in rows[1].failed and "repeated_words" in rows[2].failed and "few_symbols" in rows[3].failed
    assert rows[4].failed == ["enough_words"] and not rows[4].kept


def test_words_end_at_any_white_space(spark):
    texts = ["the\tcat\tof\tis", "the cat of is", "The.\rcat\x0bof\x0cis\nIS", None, "x"]
    rows = quality.apply_rules(documents(spark, texts)).orderBy("doc_id").collect()
    assert [r.n_stop_words for r in rows] == [3, 3, 4, 0, 0]
    assert [(r.n_lines, r.n_capitals) for r in rows] == [(1, 0), (1, 0), (2, 3), (0, 0), (1, 0)]
    assert quality.apply_rules(documents(spark, texts).limit(0)).count() == 0


def test_a_rule_needs_a_bound():
    with pytest.raises(ValueError):
        quality.Rule("none", "n_words", "one").holds()


# Personal data


def found(text):
    return [(k, text[a:b]) for k, a, b, _ in pii.base_spans(text)]


@pytest.mark.parametrize(
    ("text", "spans"),
    [
        ("mail a.b@c-d.org, or x@y", [("email", "a.b@c-d.org")]),
        ("a@b.c_d@e.fr", [("email", "a@b.c"), ("email", "_d@e.fr")]),
        ("@b.c@d.e", [("email", "b.c@d.e")]),
        ("1.2.3.4.5.6.7.8 and 1.2.3.256", [("ip", "1.2.3.4"), ("ip", "5.6.7.8")]),
        ("001.002.3.0255", [("ip", "001.002.3.0255")]),
        ("4111 1111-1111 1111", [("card", "4111 1111-1111 1111")]),
        ("4111111111111112", []),
        ("call +49 (30) 1234567.", [("phone", "+49 (30) 1234567")]),
        ("+1 2 3", []),
        ("9" * 30, []),
        ("", []),
    ],
)
def test_patterns(text, spans):
    assert found(text) == spans


def plain_spans(text):
    """The patterns as they are stated, tried at every place."""
    out = [("email", m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append(("ip", m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub(r"\D", "", m.group())
        if 13 <= len(digits) <= 19 and pii.luhn(digits):
            out.append(("card", m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub(r"\D", "", m.group())) <= 15:
            out.append(("phone", m.span()))
    return out


def test_patterns_match_their_plain_form():
    chooser = random.Random(3)
    for _ in range(3000):
        text = "".join(chooser.choice("ab_.@@.-+ 0123456789()%") for _ in range(chooser.randrange(60)))
        assert [(k, (a, b)) for k, a, b, _ in pii.base_spans(text)] == plain_spans(text), text


def test_hostile_texts_take_linear_time():
    for text in ("a" * 200_000, "1" * 200_000, "1." * 100_000, "+1" + "(" * 200_000, "@" * 200_000, "a@b" * 70_000):
        pii.base_spans(text)


def test_an_entity_in_every_document_discloses_nothing(spark):
    texts = [f"{prose(20, i)} shared footer write to us at all@corp.example today {prose(9, 70 + i)}" for i in range(12)]
    rows = pii.sanitize(documents(spark, texts)).collect()
    assert all(len(r.base) == 1 and not r.terms for r in rows)
    assert pii.sanitize(documents(spark, texts).limit(0)).count() == 0


def test_terms_that_reveal_an_entity(spark):
    chooser = random.Random(1)
    texts = [prose(60, i) for i in range(200)]
    for i in range(5):
        texts[i] += f" {prose(20, 900 + i)} zorblat writes from k{chooser.randrange(9)} boss@corp.example often {prose(20, 950 + i)}"
    texts += [texts[0]] * 30 + [None, ""]
    rows = {r.doc_id: r for r in pii.sanitize(documents(spark, texts)).collect()}
    assert len(rows) == len(texts)
    marked = {texts[i][t.start : t.end] for i in range(5) for t in rows[i].terms}
    assert "zorblat" in marked and not any(w.startswith("w") and w[1:].isdigit() for w in marked)
    assert all(not r.terms and not r.base for i, r in rows.items() if 5 <= i < 200 or i >= 230)
    assert rows[200].terms == rows[0].terms
    docs = documents(spark, texts)
    clean = {r.doc_id: r.text for r in pii.redact(docs, pii.sanitize(docs)).collect()}
    assert "[EMAIL]" in clean[0] and "zorblat" not in clean[0] and clean[7] == texts[7] and clean[230] is None


def test_terms_far_from_a_mention_and_in_other_texts(spark):
    texts = [prose(60, i) for i in range(200)]
    for i in range(6):
        texts[i] = f"Quuxly, {texts[i]} {prose(40, 300 + i)} {prose(9, 900 + i)} write to boss@corp.example {prose(40, 950 + i)} quuxly."
    texts[9] += " (quuxly) again"
    rows = {r.doc_id: r for r in pii.sanitize(documents(spark, texts)).collect()}
    for i in (0, 5, 9):
        marked = [texts[i][t.start : t.end] for t in rows[i].terms]
        assert [w for w in marked if w.lower() == "quuxly"] == (["quuxly"] if i == 9 else ["Quuxly", "quuxly"])
    assert not rows[10].terms


# Toxicity


def test_toxicity_learns_words_and_finds_the_sentence(spark):
    chooser = random.Random(2)
    texts, marks = [], []
    for i in range(900):
        parts = [prose(8, 10_000 + 7 * i + j, 300) for j in range(chooser.randrange(1, 9))]
        toxic = i % 5 == 0
        if toxic:
            at = chooser.randrange(len(parts))
            parts[at] = parts[at] + " " + chooser.choice(["vileness", "vileword", "slurish"])
        texts.append(". ".join(parts) + ".")
        marks.append(int(toxic))
    docs = documents(spark, [*texts, None, "", prose(20_000)])
    labels = spark.createDataFrame([(i, m, 0) for i, m in enumerate(marks)] + [(0, None, 1), (None, 1, 1)], "doc_id long, toxic int, quality int")
    model = toxicity.train(docs, labels)
    rows = {r.doc_id: r for r in toxicity.score(docs, model).withColumn("held", toxicity.held_out()).collect()}
    assert len(rows) == 903 and all(0 <= r.score <= 1 for r in rows.values())
    held = [i for i in range(900) if rows[i].held]
    assert 100 < len(held) < 260
    assert np.mean([(rows[i].score >= 0.5) == marks[i] for i in held]) > 0.97
    for i in held:
        if marks[i] and rows[i].score >= 0.5:
            assert any(re.search("vile|slur", texts[i][s.start : s.end]) for s in rows[i].offending)
    assert rows[900].score == rows[901].score == 0.0
    kept = toxicity.keep_clean(docs, model)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, r in rows.items() if r.score < 0.5}


def test_toxicity_without_labels(spark):
    docs = documents(spark, ["a b", None])
    model = toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r.score for r in toxicity.score(docs, model).collect()} <= {0.0, 0.5}
    assert toxicity.score(documents(spark, ["a"]).limit(0), model).count() == 0


# Near-duplicates


def shingles(text):
    words = WORD.findall((text or "").translate(str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})))
    if len(words) < 5:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def classes_by_hand(texts):
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(texts)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))], [len(s) for s in sets]


def edited(text, changes, seed):
    chooser, words = random.Random(seed), text.split(" ")
    for _ in range(changes):
        words[chooser.randrange(len(words))] = f"e{chooser.randrange(10**6)}"
    return " ".join(words)


def test_classes_match_all_pairs(spark):
    base = [prose(150, i) for i in range(12)]
    texts = [*base, *(edited(base[i % 3], k, 50 * i + k) for i in range(30) for k in (0, 2, 4, 6)), base[0].upper(), *ODD, "A B", "a  b", "a b c"]
    # A chain: each link is similar to the next one only.
    chain = prose(200, 77).split(" ")
    for _ in range(8):
        texts.append(" ".join(chain))
        chain = [*chain[18:], *prose(18, len(texts)).split(" ")]
    rows = {r.doc_id: r for r in neardup.near_duplicates(documents(spark, texts)).collect()}
    classes, sizes = classes_by_hand(texts)
    assert [rows[i].n_shingles for i in range(len(texts))] == sizes
    assert [rows[i].component_id for i in range(len(texts))] == classes
    assert all(r.kept == (r.component_id == i) for i, r in rows.items())


def test_tiles_compare_what_the_stars_leave(spark):
    """Two groups of near copies that share buckets, split over several tiles."""
    left = prose(120, 1)
    texts = [edited(left, 3, i) for i in range(40)] + [edited(left, 14, 1000 + i) for i in range(40)]
    whole = neardup.TILE
    neardup.TILE = 8
    try:
        rows = {r.doc_id: r.component_id for r in neardup.near_duplicates(documents(spark, texts)).collect()}
    finally:
        neardup.TILE = whole
    assert [rows[i] for i in range(len(texts))] == classes_by_hand(texts)[0]


def test_posterior_bounds_keep_similar_pairs():
    needed = neardup.needed_matches()
    assert [n for n, _ in needed] == list(range(16, 129, 16)) and all(0 < m < n for n, m in needed)
    one = neardup.signature(np.arange(1, 2000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    assert list(neardup.surviving(np.stack([one, one]), np.stack([one, one[::-1]]))) == [0]


def test_near_duplicates_of_nothing_and_repeated_rows(spark):
    assert neardup.near_duplicates(documents(spark, ["a"]).limit(0)).count() == 0
    docs = documents(spark, ["a b c d e f", "x"])
    rows = neardup.near_duplicates(docs.unionByName(docs)).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in rows) == [(0, 0, True)] * 2 + [(1, 1, True)] * 2


def test_components(spark):
    chooser = random.Random(4)
    links = [(chooser.randrange(300), chooser.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(500, 560)] + [(7, 7)]
    root = {x: x for pair in links for x in pair}
    for _ in range(len(root)):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    linked = {x for a, b in links if a != b for x in (a, b)}
    rows = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r.node: r.root for r in rows} == {x: root[x] for x in linked}


# Lines


def deleted_by_hand(texts, least=lines.MIN_WORDS):
    """Lines of any run of enough words that stands earlier as well: every run of every length."""
    split = [None if t is None else t.split("\n") for t in texts]
    count = [[len(WORD.findall(x)) for x in rows or []] for rows in split]
    first, gone = {}, [set() for _ in texts]
    for i, rows in enumerate(split):
        for a in range(len(rows or [])):
            total = 0
            for b in range(a, len(rows)):
                total += count[i][b]
                if total >= least:
                    if first.setdefault(tuple(rows[a : b + 1]), (i, a)) < (i, a):
                        gone[i].update(range(a, b + 1))
                    else:
                        first[tuple(rows[a : b + 1])] = min(first[tuple(rows[a : b + 1])], (i, a))
    return [sorted(g) for g in gone]


def test_deleted_lines_match_all_runs(spark):
    chooser = random.Random(6)
    pool = [prose(n, 300 + i) for i, n in enumerate([1, 1, 2, 3, 3, 4, 5, 9, 12])] + [""]
    texts = ["\n".join(chooser.choice(pool) for _ in range(chooser.randrange(1, 14))) for _ in range(60)]
    texts += [None, "", "\n\n", texts[3], prose(40, 9) + "\nlast", "new\n" + prose(40, 9), "\n".join(["x"] * 40)]
    want = deleted_by_hand(texts)
    rows = {r.doc_id: r for r in lines.drop_copied_lines(documents(spark, texts)).collect()}
    assert [rows[i].deleted for i in range(len(texts))] == want
    for i, t in enumerate(texts):
        if t is None:
            assert rows[i].text is None and rows[i].n_lines == 0
        else:
            assert rows[i].text == "\n".join(x for j, x in enumerate(t.split("\n")) if j not in set(want[i]))
            assert rows[i].n_lines == len(t.split("\n"))


def test_lines_of_nothing_and_of_rows_without_a_key(spark):
    docs = documents(spark, [prose(20)] * 3)
    assert lines.drop_copied_lines(docs.limit(0)).count() == 0
    keyless = spark.createDataFrame([(None, prose(20)), (5, prose(20))], "doc_id long, text string")
    rows = {r.doc_id: r.deleted for r in lines.drop_copied_lines(keyless).collect()}
    assert rows == {5: [], None: [0]}
    with pytest.raises(ValueError):
        lines.copied_lines(docs, least=0)


def test_repeated_rows_are_one_document_in_every_doubling(spark):
    """Copies of rows, with and without a key: as many ranks a line as without them, whatever the depth."""
    texts = ["\n".join(["", "x", "", "y z"] * 6), "\n".join(["x"] * 40), prose(20), "a\n" + prose(20)]
    once = spark.createDataFrame([*enumerate(texts), (None, texts[0]), (None, "new\n" + texts[1])], "doc_id long, text string")
    seen, whole = [], lines._ranked

    def counted(rows, by, keep):
        seen.append(rows.count())
        return whole(rows, by, keep)

    lines._ranked = counted
    try:
        want = {(r.doc_id, r.text_hash, r.line) for r in lines.copied_lines(once).collect()}
        depth, seen[:] = list(seen), []
        rows = lines.copied_lines(once.join(spark.range(5).select(F.lit(1).alias("n")), how="cross").drop("n")).collect()
    finally:
        lines._ranked = whole
    assert len(depth) > 3 and seen == depth
    assert len(rows) == len(want) and {(r.doc_id, r.text_hash, r.line) for r in rows} == want


def test_digest_of_spans_is_stable():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")
