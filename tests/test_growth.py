"""Work that must not be done more than once a row, and cheaper forms that must give what the plain ones do."""

import pytest
from pyspark.sql import functions as F

from paperloom.functions import text as T
from paperloom.functions.constants import DATASETS, MATH, METRICS
from paperloom.operators import chunk, claims, extract, metadata, onepass, segment
from paperloom.sources import models

PAGES = "paper_id string, filename string, page_number int, text string"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([("a", "a.pdf", 1, "A title of some length\n\nAbstract\nWe train a model on GLUE. It has 12 layers.")], PAGES)


def test_text_functions_equal_their_patterns(spark):
    """White space, lines and symbols as the patterns have them, for every character."""
    chars = [chr(k) for k in range(1, 0x10000) if not 0xD800 <= k < 0xE000]
    said = [f"{c}a{c} {c}b  {c}" for c in chars] + [f"x{c}y" for c in chars] + ["", " ", "\t \t", "a\r\nb\n\rc\r", "λ  ·\tx", *MATH, None]
    df = spark.createDataFrame([(s,) for s in said], "s string")
    strip = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    spaces = lambda c: strip(F.regexp_replace(c, r"[ \t]+", " "))
    named = F.col("s")
    for symbol, command in MATH.items():
        named = F.replace(named, F.lit(symbol), F.lit(f" {command} "))
    pairs = {"strip": (T.strip(df.s), strip(df.s)), "spaces": (T.single_spaces(df.s), spaces(df.s)), "latex": (T.latex(df.s), spaces(named)), "lines": (T.cut_lines(df.s), F.split("s", T.NEWLINES, -1))}
    for name, (got, want) in pairs.items():
        assert df.where(~got.eqNullSafe(want)).count() == 0, name


def test_lines_are_cut_once(pages):
    """The pattern of line ends stood four times in a row's expression."""
    assert plan(segment.lines(pages)).count("split(") == 2  # by the common line end, or by the pattern


def test_a_model_is_parsed_once(spark, tmp_path):
    """the filter on refused rows parsed a text for each field it asked for."""
    spark.createDataFrame([("{}",)], "value string").write.text(str(tmp_path / "m"))
    good, bad = models.read(spark, str(tmp_path / "m"), models.EXTRACTION)
    assert plan(good).count("from_json(") == 1 and plan(bad).count("from_json(") == 1
    assert good.count() == 0 and bad.first().refused == "paper_id: missing"


def test_a_paper_is_read_once_a_part(pages):
    """a section's lead was folded three times, and a setting's paragraph looked for six times."""
    whole = plan(onepass.extracted(metadata.titles(pages), segment.paragraphs(pages)))
    assert whole.count("aggregate(") == 13 and whole.count("filter(") < 80


def test_cheaper_tests_lose_no_mention(spark):
    """what a cheaper test looks for stands wherever the pattern finds something."""
    said = [f"It is {n}, done." for n in DATASETS] + [f"It has {m.lower()} 5 in all." for m in METRICS] + ["8xV100", "TPU v3", "a 12-layer net with 8 heads, lr e", "no number"]
    df = spark.createDataFrame([(k, s, "Results") for k, s in enumerate(said)], "k int, text string, section string")
    rows = claims.with_metric(df).select("*", extract.dataset_mentions(df.text, df.text).alias("d"), extract.hyperparameter_values(df.text).alias("h")).orderBy("k").collect()
    for r in rows[: len(DATASETS)]:
        assert DATASETS[r.k] in [d.name for d in r.d]
    for r, m in zip(rows[len(DATASETS) :], METRICS):
        assert r.word == m.lower() and r.numbers
    assert [v for v in rows[-2].h if v] == ["e", "12", "8"] and not any(rows[-1].h) and rows[-1].word is None


def test_chunks_take_sizes_from_columns(pages):
    """the sizes of all paragraphs of a paper were made anew in every step of the packing."""
    told = plan(chunk.chunks(segment.paragraphs(pages)))
    assert told.count("transform(parts#") == 1 and told.count("transform(ps#") <= 2


def test_longest_line_that_a_hint_may_equal(spark):
    """F16: longer lines, which are not joined, are too unlike any hint that names a section."""
    hint = "1" * 88 + " limitations"
    lines = spark.createDataFrame([("a", 1, n, hint + "1" * (n - 100)) for n in (100, 110, 117, 118, 130, 300)], "paper_id string, page_number int, line_no int, line string")
    got = metadata.hint_headings(lines, spark.createDataFrame([("a", hint)], "paper_id string, hint_text string")).collect()
    assert {(r.line_no, r.heading) for r in got} == {(n, "Limitations") for n in (100, 110, 117)}
