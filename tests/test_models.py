"""Whole models: built in one pass, written to files, read back with checks."""

import json

import pytest
from test_corpus import A, B, by, paras  # noqa: F401

from paperloom.operators import claims, extract, matrix, metadata, nested, onepass, segment
from paperloom.sources import models

PAGES = "paper_id string, filename string, page_number int, text string"
LONG = "\n".join(
    ["Abstract", "One model. Two models. $x_1 = 3$ holds. $x_1 = 3$ again."]
    + ["", "Results"] + [f"Accuracy rises from {k} to {k + 2} on ImageNet.\n" for k in range(12)]
    + ["", "Discussion", "The F1 of 3 is fine.", "", "", "Another F1 of 4.", "", "Methodology", "Plain words first.", "", "A 3-layer network with $$y = 2z$$ here, dropout 0.2 on WMT14.", "", "Learning rate 1e-3, 4xV100, on Set9 dataset and WMT14."]
)


@pytest.fixture(scope="module")
def pages(spark):
    rows = [("a", "a.pdf", 1, A), ("b", "b_c.pdf", 1, B), ("c", "c.pdf", 1, None), ("d", "d.pdf", 1, "Results\nfirst line of this\n"), ("d", "d.pdf", 2, "runs on\n2.1. Methods\nmore"), ("l", "l.pdf", 1, LONG)]
    return spark.createDataFrame(rows, PAGES).cache()


@pytest.fixture(scope="module")
def wide(pages):
    return onepass.extracted(metadata.titles(pages), segment.paragraphs(pages)).cache()


def test_one_pass_equals_the_separate_operators(pages, wide):
    paras, titles = segment.paragraphs(pages).cache(), metadata.titles(pages)  # noqa: F811
    parts = {
        "bullets": claims.executive_bullets(pages, paras), "sections": claims.section_summaries(paras), "tldr": claims.tldr(titles, paras), "architecture": claims.architectures(paras),
        "hyperparameters": extract.hyperparameters(paras), "losses": claims.loss_expressions(paras), "datasets": extract.datasets(paras), "hardware": extract.hardware(paras), "results": claims.benchmark_results(paras),
    }
    from pyspark.sql import functions as F

    for name, want in parts.items():
        if name in ("bullets", "tldr"):  # those without a source get the paper's first one
            want = claims.repair(want.withColumn("anchor", F.lit(None).cast("string")), paras).drop("anchor")
        got = onepass.part(wide, name).select(*want.columns)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())), name
    assert len(onepass.part(wide, "results").where("paper_id = 'l'").collect()) == 11 and onepass.part(wide, "losses").where("paper_id = 'l'").count() >= 2


def test_one_pass_of_nothing(spark, pages):
    none = pages.limit(0)
    assert onepass.extracted(metadata.titles(none), segment.paragraphs(none)).collect() == []


def whole(pages):
    described = nested.metadata(metadata.titles(pages), metadata.authors(pages), metadata.years_dois(pages))
    return nested.whole_papers(pages, segment.paragraphs(pages), described)


@pytest.mark.parametrize("kind", ["json", "parquet"])
def test_papers_are_written_whole_and_read_back(spark, pages, tmp_path, kind):
    made = whole(pages)
    models.write(made, f"{tmp_path}/p", models.PAPER, kind)
    good, bad = models.read(spark, f"{tmp_path}/p", models.PAPER, kind)
    assert bad.collect() == [] and sorted(map(str, good.collect())) == sorted(map(str, made.collect()))
    got = by(good, "paper_id")
    assert [s.name for s in got["a"].sections] == ["Preamble", *models.CANONICAL] and [s.name for s in got["c"].sections] == models.CANONICAL
    assert got["c"].paragraph_count == 0 and got["d"].page_count == 2 and got["b"].metadata.title == "No headings here at all"
    assert got["a"].metadata.authors == ["Ann Writer", "Ben Reader"] and got["a"].metadata.abstract.startswith("We present") and got["a"].metadata.enrichment_source == "pdf-heuristic"
    results = next(s for s in got["a"].sections if s.name == "Results")
    assert results.text == "BLEU improves from 24.1 to 28.4 on WMT14." and results.paragraphs[0].page_number == 1
    assert models.read(spark, f"{tmp_path}/p", models.PAPER, kind)[0].schema == good.schema


def test_extractions_are_written_and_read_back(spark, wide, tmp_path):
    made = nested.extractions(wide)
    models.write(made, f"{tmp_path}/e", models.EXTRACTION)
    good, bad = models.read(spark, f"{tmp_path}/e", models.EXTRACTION)
    assert bad.collect() == [] and sorted(map(str, good.collect())) == sorted(map(str, made.collect()))
    a = by(good, "paper_id")["a"]
    assert {h.name: h.value for h in a.methodology.hyperparameters}["learning_rate"] == "3e-4" and a.methodology.loss_functions[0].expression_latex.startswith("$")
    assert [(r.baseline_score, r.paper_score, r.sota_delta) for r in a.quantitative_results.results] == [(24.1, 28.4, 4.3)] and len(a.summary.executive_summary) == 3
    assert by(good, "paper_id")["c"].methodology.architecture == ""


def test_rows_that_do_not_hold_come_back_with_a_reason(spark, wide):
    good = json.loads(nested.extractions(wide.where("paper_id = 'a'")).toJSON().first())

    def changed(**at):
        out = json.loads(json.dumps(good))
        for path, value in at.items():
            *way, last = path.split("__")
            x = out
            for w in way:
                x = x[int(w) if w.isdigit() else w]
            if value is None:
                del x[last]
            else:
                x[last] = value
        return json.dumps(out)

    cases = {
        changed(): None,
        changed(more="x"): None,
        changed(extraction_source=None): None,
        changed(methodology=None): None,
        changed(methodology__datasets=[{"name": "D"}]): None,
        changed(methodology__datasets=[{"details": "D"}]): "methodology.datasets.name: missing",
        changed(extraction_source="me"): "extraction_source: unknown",
        changed(summary__executive_summary=good["summary"]["executive_summary"][:2]): "summary.executive_summary: not 3 entries",
        changed(summary__executive_summary__1__text=None): "summary.executive_summary.text: missing",
        changed(summary__executive_summary__0__sources=[{"page_number": 0, "paragraph_id": "p1"}]): "summary.executive_summary.sources.page_number: below 1",
        changed(summary__executive_summary__0__sources=[{"page_number": 1}]): "summary.executive_summary.sources.paragraph_id: missing",
        changed(summary=None): "summary: missing",
        changed(paper_id=None): "paper_id: missing",
        changed(summary="words"): "not of the model's shape",
        changed(quantitative_results__results=[{"task": "t", "metric_name": "m", "paper_score": "high"}]): "not of the model's shape",
        changed()[:90]: "not of the model's shape",
        "": "not of the model's shape",
        "[]": "not of the model's shape",
    }
    rows = spark.createDataFrame([*((t,) for t in cases), (None,)], "value string")
    got = models.parsed(rows, models.EXTRACTION).collect()
    assert {r.value: r.refused for r in got} == cases | {None: "not of the model's shape"}
    filled = next(r for r in got if r.value == changed(methodology=None))
    assert filled.methodology.hyperparameters == [] and filled.methodology.architecture == ""
    dataset = next(r for r in got if r.value == changed(methodology__datasets=[{"name": "D"}])).methodology.datasets[0]
    assert (dataset.details, dataset.sources) == ("", [])


def test_papers_need_their_sections_and_counts(spark, pages):
    text = whole(pages.where("paper_id = 'a'")).toJSON().first()
    data = json.loads(text)
    short = data | {"sections": data["sections"][:-1]}
    rows = [text, json.dumps(short), json.dumps(data | {"paragraph_count": 99}), json.dumps(data | {"metadata": {}})]
    got = {r.value: r.refused for r in models.parsed(spark.createDataFrame([(r,) for r in rows], "value string"), models.PAPER).collect()}
    assert [got[r] for r in rows] == [None, "sections: a canonical one is missing", "paragraph_count: not that of the sections", None]


def test_comparisons_and_gaps_are_whole(spark, pages, wide, tmp_path):
    sets = spark.createDataFrame([(1, 0, "b"), (1, 1, "a"), (1, 2, "l"), (2, 0, "c")] + [(3, k, "a") for k in range(21)], "set_id long, paper_ord long, paper_id string")
    parts = {n: onepass.part(wide, n) for n in onepass.PARTS}
    refs = matrix.paper_refs(sets, metadata.titles(pages), metadata.years_dois(pages).select("paper_id", "year"))
    made = matrix.comparisons(sets, refs, parts)
    assert [(r.set_id, r.n_papers) for r in matrix.limited(sets)[1].collect()] == [(3, 21)]
    models.write(made, f"{tmp_path}/c", models.COMPARISON)
    good, bad = models.read(spark, f"{tmp_path}/c", models.COMPARISON)
    assert bad.collect() == [] and sorted(map(str, good.collect())) == sorted(map(str, made.drop("set_id").collect()))
    got = by(made, "set_id")
    assert set(got) == {1, 2} and got[1].paper_ids == ["b", "a", "l"] and [p.title for p in got[2].papers] == ["c"]
    rows = {r.dimension: r for r in got[1].rows}
    assert rows["tl_dr"].verdict == "n/a" and rows["architecture"].verdict == "divergent" and all(len(r.cells) == 3 for r in got[1].rows)
    assert rows["hyperparameter:dropout"].verdict == "divergent" and rows["hyperparameter:batch_size"].verdict == "single-source" and rows["dataset:WMT14"].verdict == "consensus"
    assert [c.value for c in rows["hyperparameter:layers"].cells] == ["—", "12", "3"] and [f.statement for f in got[1].consensus_points][0] == "Shared evaluation dataset: WMT14."
    assert [(r.dimension, r.verdict, r.cells[0].value) for r in got[2].rows] == [("tl_dr", "n/a", "c."), ("architecture", "single-source", "—")]
    capped = extract.gaps(sets, extract.gap_sentences(segment.paragraphs(pages)))
    gaps = matrix.research_gaps(sets, capped, claims.cross_cutting(capped))
    models.write(gaps, f"{tmp_path}/g", models.GAPS)
    held, bad = models.read(spark, f"{tmp_path}/g", models.GAPS)
    assert bad.collect() == [] and held.count() == 2
    found = by(gaps, "set_id")
    assert found[2].failure_modes == [] and found[2].cross_cutting == [] and any("untested" in g.statement for g in found[1].failure_modes)
    counts = {(r.set_id, r.category): r.n for r in extract.gap_counts(sets, capped, claims.cross_cutting(capped)).collect()}
    assert counts[2, "failure_modes"] == 0 and counts[2, "cross_cutting"] == 0 and counts[1, "failure_modes"] == len(found[1].failure_modes)


def test_badges_keep_the_order_of_the_claim(spark):
    tag = lambda *n: [(f"p{k}", k, "Results") for k in n]
    rows = spark.createDataFrame([("a", tag(10, 2, 33, 1, 5)), ("b", tag(3)), ("c", [])], f"paper_id string, sources {claims.TAGS}")
    got = by(claims.badges(rows), "paper_id")
    assert got["a"].badges == "p10 · p.10, p2 · p.2, p33 · p.33, p1 · p.1" and (got["a"].more, got["b"].more, got["c"].badges, got["c"].more) == (1, 0, "", 0)


def test_authors_follow_the_title_by_font(spark):
    text = "An Early Line of Some Length\nCarl Caption, Dora Draft\nThe True Title in Large Type\nEva Editor, Finn Founder\nAbstract"
    pages = spark.createDataFrame([("a", "a.pdf", 1, text)], PAGES)
    spans = spark.createDataFrame([("a", 1, 800.0, 0, 10.0, 9.0, "An Early Line of Some Length"), ("a", 1, 800.0, 1, 40.0, 22.0, "The True Title in Large Type")], "paper_id string, page_number int, page_height double, span_no int, top double, size double, text string")
    assert metadata.authors(pages).first().authors == ["Carl Caption", "Dora Draft"]
    assert metadata.authors(pages, spans=spans).first().authors == ["Eva Editor", "Finn Founder"]


@pytest.mark.parametrize("kind", ["json", "parquet"])
def test_page_text_is_read_with_a_declared_schema(spark, pages, tmp_path, kind):
    if kind == "json":
        good_lines = ['{"paper_id": "a", "filename": "a.pdf", "page_number": 1, "text": "Abstract\\nx"}', '{"page_number": 2, "paper_id": "a", "filename": "a.pdf", "more": [1]}']
        bad_lines = ['{"paper_id": "a", "filename": "a.pdf", "page_number": 0}', '{"paper_id": "a", "page_number": 1}', '{"paper_id": "", "filename": "f", "page_number": 1}', "[1]", "", '{"paper_id": "a", "filename"', '{"paper_id": "a", "filename": "f", "page_number": "one"}']
        (tmp_path / "p").write_text("\n".join(good_lines + bad_lines))
        good, bad = models.read(spark, f"{tmp_path}/p", models.PAGE)
        assert sorted(map(tuple, good.collect())) == [("a", "a.pdf", 1, "Abstract\nx"), ("a", "a.pdf", 2, "")]
        assert sorted(r.refused for r in bad.collect()) == sorted(["page_number: below 1", "filename: missing", "paper_id: empty"] + ["not of the model's shape"] * 4)
    models.write(pages, f"{tmp_path}/q", models.PAGE, kind)
    good, bad = models.read(spark, f"{tmp_path}/q", models.PAGE, kind)
    assert bad.count() == 0 and sorted(map(str, good.collect())) == sorted(map(str, pages.fillna({"text": ""}).collect()))
    assert sorted(map(str, segment.paragraphs(good).collect())) == sorted(map(str, segment.paragraphs(pages).collect()))
