"""Fill-in-the-middle against a plain Python version."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from lethe.llm import infill


def plain_version(key, text, seed=7, rate=100, spm_rate=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    if text == "" or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h[3] % 100 < spm_rate:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def texts():
    draw = random.Random(3)
    letters = "ab \n\n\n\rß𝔸<>$\\ S"
    odd = [None, "", "\n", "\n\n", "a", "a\n", "<S", "x<S\n<\n", "M>\n<", "a<S>b", "$1\\2\n${x}\n", "<<S\n>", "a\r\nb\rc", "\0\n\0"]
    return odd + ["".join(draw.choice(letters) for _ in range(draw.randint(1, 40))) for _ in range(150)]


@pytest.mark.parametrize("options", [{}, {"seed": 1, "rate": 60, "spm_rate": 30}])
def test_equals_plain_version(spark, options):
    rows = [(i, t, "clash") for i, t in enumerate(texts())] + [(None, "null\nkey\n", "x"), (3, "twice\n\n", "x"), (3, "twice\n\n", "x")]
    table = spark.createDataFrame(rows, "doc_id long, text string, output string").withColumns({c: F.lit(1) for c in ("n", "form", "restored")})
    got = infill.restore(infill.transform(table, **options)).collect()
    wanted = sorted(((k, *plain_version(k, t, **options), t or "") for k, t, _ in rows), key=str)
    assert sorted((tuple(r) for r in got), key=str) == wanted
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_long_texts_need_no_stack(spark):
    rows = [(1, "line of words\n" * 100_000), (2, "x" * 2_000_000 + "\n" + "y" * 10), (5, "\n" * 300_000)]
    got = infill.restore(infill.transform(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    assert sorted((tuple(r) for r in got)) == sorted((k, *plain_version(k, t), t) for k, t in rows)


def test_empty_table(spark):
    assert infill.restore(infill.transform(spark.createDataFrame([], "doc_id long, text string"))).collect() == []
