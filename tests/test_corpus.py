"""Two small papers with known results, and the quirks of the segmentation."""

import re

import pytest

from paperloom.functions import text as T
from paperloom.operators import chunk, claims, dense, extract, maintenance, matrix, metadata, nested, relevance, search, segment
from paperloom.sources import intake
from paperloom.sources import nested as nested_files
from paperloom.sources import staged as staged_tables

A = """A Weighted Transformer for Translation
Ann Writer, Ben Reader
Institute

Abstract
We present a weighted transformer. The objective is $L_{loss} = \\lambda$ with λ · β.

1. Introduction
Translation quality depends on objectives.

2. Methodology
We use a 12-layer transformer with 8 attention heads and hidden size 512.
We optimize with Adam at learning rate 3e-4, batch size 32, for 100 epochs with dropout 0.1.
It is trained on the WMT14 dataset. Experiments run on 8xV100 GPUs.

3. Results
BLEU improves from 24.1 to 28.4 on WMT14.

5. Limitations
Only English evaluated; long documents untested.

6. Future Work
Extend to multilingual benchmarks."""
B = "No headings here at all\nbut two lines of prose.\n\nAnd another paragraph that should be folded in."


@pytest.fixture(scope="module")
def paras(spark):
    pages = spark.createDataFrame([("a", "a.pdf", 1, A), ("b", "b.pdf", 1, B), ("c", "c.pdf", 1, None), ("d", "d.pdf", 1, "Results\nfirst line\n"), ("d", "d.pdf", 2, "runs on\n2.1. Methods\nmore")], "paper_id string, filename string, page_number int, text string")
    return segment.paragraphs(pages).cache()


def by(df, *keys):
    return {tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]: r for r in df.collect()}


def test_paragraphs(paras):
    rows = by(paras, "paper_id", "para_no")
    assert rows["a", 1].section == "Preamble" and rows["b", 1].section == "Introduction"
    assert rows["a", 2].text.endswith(r"$L_{loss} = \lambda$ with \lambda \cdot \beta .")
    assert rows["d", 1].text == "first line runs on 2.1. Methods more" and rows["d", 1].page_number == 1
    assert not [k for k in rows if k[0] == "c"]


def test_every_canonical_section_exists(spark, paras):
    papers = spark.createDataFrame([("a",), ("b",), ("c",)], "paper_id string")
    got = segment.sections(papers, paras.where("paper_id <> 'd'")).collect()
    for p in "abc":
        assert {r.section for r in got if r.paper_id == p} >= set(segment.SECTIONS[1:8])


def test_headings(spark):
    lines = {"2.1. Methods": None, "dmodel": "Methodology", "a model": "Methodology", "IV. RESULTS:": "Results", "Conclusion and Future Work": "Future Work", "": None, "Some prose": None}
    df = spark.createDataFrame([(k,) for k in lines], "line string")
    assert {r.line: r.h for r in df.withColumn("h", T.heading(df.line)).collect()} == lines


def test_claims(paras):
    found = {n: r.value for (p, n), r in by(extract.hyperparameters(paras), "paper_id", "name").items() if p == "a"}
    assert found == {"learning_rate": "3e-4", "optimizer": "Adam", "layers": "12", "heads": "8", "hidden_size": "512", "batch_size": "32", "epochs": "100", "dropout": "0.1"}
    assert "WMT14" in {r.name for r in extract.datasets(paras).collect()}
    assert by(extract.hardware(paras), "paper_id")["a"].hardware == "8xV100"
    gaps = by(extract.gap_sentences(paras), "paper_id", "section_ord")
    assert gaps["a", 6].category == "failure_modes" and gaps["a", 7].category == "dataset_shortfalls"


def test_words_end_at_other_letters_as_in_sql(spark, tmp_path):
    """Java's word edges take letters of all scripts as parts of a word."""
    import duckdb

    from paperloom.plans.queries import ORACLE_SQL, QUERIES

    said = ["Über éCOCO und GLUEé", "éA22 dataset und Aé33 corpus 44é benchmark", "xCOCO und QM9x", "ñbleu 3.5 éSGD"]
    docs = [(k, f"{t}.") for k, t in enumerate(said)]
    where = str(tmp_path)
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{where}/documents.parquet")
    engine = duckdb.connect()
    engine.sql(f"create view documents as select * from '{where}/documents.parquet/*.parquet'")
    for name in ("e8_e9_datasets", "f6_dataset_verdicts", "e6_hyperparameters", "e11_e12_benchmarks", "g1_g2_gap_sentences"):
        got = QUERIES[name](spark, where)
        want = engine.sql(ORACLE_SQL[name])
        assert sorted(map(tuple, got.select(*want.columns).collect()), key=str) == sorted(want.fetchall(), key=str), name
    assert {"COCO", "GLUE", "A22"} <= {r.name for r in QUERIES["e8_e9_datasets"](spark, where).collect()}


def test_search(spark):
    texts = spark.createDataFrame([(1, "bleu score on wmt14 rises"), (2, "graphs and trees"), (3, "")], "id long, text string")
    queries = spark.createDataFrame([(7, "BLEU WMT14"), (8, "  ")], "query_id long, text string")
    got = search.hybrid(texts, queries).collect()
    assert {r.query_id for r in got} == {7} and got[0].id == 1 and got[0].bm25_score > 0


def test_chunks_cover_paragraphs_in_order(paras):
    want = {p: [r.paragraph_id for r in paras.where(paras.paper_id == p).orderBy("section_ord", "para_no").collect()] for p in "abd"}
    rows = chunk.chunks(paras, target=80, overlap=1).orderBy("chunk_no").collect()
    for p, ids in want.items():
        mine = [r for r in rows if r.paper_id == p]
        seen = list(dict.fromkeys(i for r in mine for i in r.paragraph_ids))
        assert seen == ids and [r.chunk_no for r in mine] == list(range(len(mine)))
        assert all(len("".join(r.text.split("\n\n"))) >= 80 for r in mine[:-1])


def plain_split(text, target):
    groups = []
    for x in re.split(r"(?<=[.!?])\s+", text):
        full = groups and groups[-1] and len(groups[-1]) + len(x) > target
        groups = groups[:-1] + [f"{groups[-1]} {x}".strip()] if groups and not full else groups + [x]
    return [g for g in groups if g] or [text]


def plain_pack(paras, target, overlap):
    """Chunks of (id, page, text), one paragraph after the other."""
    at, held, out = 0, [], []
    while at < len(paras) or held:
        chunk, began = list(held), at
        while at < len(paras) and sum(len(p[2]) for p in chunk) < target:
            chunk.append(paras[at])
            at += 1
        if len(chunk) == 1 and len(chunk[0][2]) > 2 * target:
            chunk = [(*chunk[0][:2], part) for part in plain_split(chunk[0][2], target)]
        out.append(chunk)
        held = chunk[-overlap:] if overlap and began < at < len(paras) else []
    return out


PARA = "paper_id string, section_ord int, para_no int, section string, paragraph_id string, page_number int, text string"


def test_chunks_equal_plain_packing(spark):
    import random

    rng = random.Random(3)
    said = lambda: " ".join("w" * rng.randint(1, 40) + rng.choice([".", "!", " x", "?\u2003", ".\n"]) for _ in range(rng.choice([0, 1, 1, 2, 3, 8, 30])))
    rows = [(f"p{p}", i % 3, i, f"s{i % 3}", f"p{p}-{i}", rng.randint(1, 4), said()) for p in range(50) for i in range(rng.choice([1, 2, 5, 12]))]
    rows += [("long", 0, i, "s0", f"long-{i}", 1, "One two. " * 400) for i in range(3)] + [("none", 0, 0, "s0", "n", 1, " "), ("none", 0, 1, "s0", "n", 1, None)]
    for target, overlap in ((50, 1), (120, 0), (80, 2)):
        got = {(r.paper_id, r.chunk_no): r for r in chunk.chunks(spark.createDataFrame(rows, PARA), target, overlap).collect()}
        want = {}
        for paper in {r[0] for r in rows}:
            mine = [r for r in sorted((r for r in rows if r[0] == paper), key=lambda r: r[1:3]) if (r[6] or "").strip()]
            want |= {(paper, n): (mine, c) for n, c in enumerate(plain_pack([r[4:] for r in mine], target, overlap))}
        assert set(got) == set(want) and "none" not in {p for p, _ in got}
        for k, (mine, c) in want.items():
            section = {r[4]: r[3] for r in mine}[c[0][0]]
            assert (got[k].text, got[k].paragraph_ids, got[k].pages, got[k].section) == ("\n\n".join(x[2] for x in c), [x[0] for x in c], sorted({x[1] for x in c}), section)


def test_chunk_quirks(spark):
    def packed(*paras, target):
        rows = [("a", 0, i, "Results", p, 1, text) for i, (p, text) in enumerate(paras)]
        return chunk.chunks(spark.createDataFrame(rows, PARA), target, 1).orderBy("chunk_no").collect()

    # a carried paragraph that fills a chunk alone comes again by itself
    assert [r.paragraph_ids for r in packed(("p1", "x" * 100), ("p2", "x" * 10), target=50)] == [["p1"], ["p1"], ["p2"]]
    (only,) = packed(("p1", "One sentence here. " * 20), target=100)
    assert len(only.paragraph_ids) > 1 and set(only.paragraph_ids) == {"p1"} and all(len(p) <= 100 for p in only.text.split("\n\n"))


def test_results_and_citations(spark, paras):
    got = by(claims.benchmark_results(paras), "paper_id")["a"]
    assert (got.metric, got.baseline, got.score, got.delta, got.task) == ("BLEU", 24.1, 28.4, 4.3, "WMT14")
    assert got.context == "BLEU improves from 24.1 to 28.4 on WMT14." and got.sources[0].section == "Results"
    made = [
        ("a", 1, None, [("p2", 1, "Abstract"), ("p9999", 1, "Results")]),
        ("a", 2, "Results", [("p9999", 1, "Results")]),
        ("a", 3, "Discussion", [("p2", 9, "Abstract")]),
        ("a", 4, None, None),
        ("z", 5, None, [("p1", 1, "Abstract")]),
    ]
    claimed = spark.createDataFrame(made, f"paper_id string, claim_no int, anchor string, sources {claims.TAGS}")
    fixed = {r.claim_no: [(t.paragraph_id, t.section) for t in r.sources] for r in claims.repair(claimed, paras).collect()}
    results = by(paras.where("paper_id = 'a'"), "section")["Results"].paragraph_id
    assert fixed == {1: [("p2", "Abstract")], 2: [(results, "Results")], 3: [("p1", "Preamble")], 4: [("p1", "Preamble")], 5: []}


def test_audit_names_every_issue(spark, paras):
    tag, none = [("p2", 1, "Abstract")], []
    rows = [("a", "executive", str(k), tag) for k in range(3)] + [("a", "sectional", "Results", [("p9", 7, "Results")] + tag), ("b", "executive", "0", none), ("b", "result", "BLEU", None)]
    made = spark.createDataFrame(rows, f"paper_id string, kind string, label string, sources {claims.TAGS}")
    told = spark.createDataFrame([("a", "It works."), ("b", " "), ("c", None)], "paper_id string, tldr string")
    got = by(claims.audit(made, told, paras), "paper_id")
    assert got["a"].issues == ["sectional[Results]: unknown tag p9/p.7"] and not got["a"].clean
    three, empty = "executive_summary must have exactly 3 bullets", "technical_tldr empty"
    assert got["b"].issues == sorted(["executive[0]: missing source tags", "result[BLEU]: missing source tags", three, empty])
    assert got["c"].issues == [three, empty]
    whole = made.where("paper_id = 'a' and kind = 'executive'")
    assert by(claims.audit(whole, told, paras), "paper_id")["a"].clean


def test_summaries_say_where_they_come_from(spark, paras):
    papers = spark.createDataFrame([("a", "A title. And more"), ("c", None), ("b", "Plain")], "paper_id string, title string")
    bullets = by(claims.executive_bullets(papers, paras), "paper_id", "bullet_no")
    assert [bullets["c", k].text for k in (1, 2, 3)] == ["No abstract extracted.", "No results extracted.", "No limitations extracted."] and not bullets["c", 1].sources
    assert [t.section for t in bullets["a", 3].sources] == ["Limitations", "Future Work"] and bullets["b", 1].sources[0].section == "Introduction"
    told = by(claims.tldr(papers, paras), "paper_id")
    assert told["a"].tldr.startswith("We present") and told["b"].tldr == "Plain." and told["c"].tldr == "Untitled paper.."
    only = spark.createDataFrame([("q", "One. Two")], "paper_id string, title string")
    assert claims.tldr(only, paras).first().tldr == "One."


def test_maintenance(spark):
    stored = spark.createDataFrame([("x:1", "x", "old"), ("x:2", "x", "old"), (None, "y", "no key")], "chunk_id string, paper_id string, text string")
    new = spark.createDataFrame([("x:1", "x", "second", 2), ("x:1", "x", "first", 1)], "chunk_id string, paper_id string, text string, version int")
    assert sorted(r.text for r in maintenance.upsert(stored, new, version="version").collect()) == ["no key", "old", "second"]
    assert sorted(r.text for r in maintenance.upsert(stored, new, version="version", whole_papers=True).collect()) == ["no key", "second"]
    assert [tuple(r) for r in maintenance.counts(new).collect()] == [("x", 1)]
    left, gone = maintenance.delete(stored, spark.createDataFrame([("x",), ("x",), ("w",)], "paper_id string"))
    assert [r.text for r in left.collect()] == ["no key"] and sorted(map(tuple, gone.collect())) == [("w", 0), ("x", 2)]
    asked = spark.createDataFrame([(1, 0, "b"), (1, 1, "q"), (1, 2, "a"), (2, 0, "z")], "request_id int, ord int, paper_id string")
    got = by(maintenance.resolve(asked, spark.createDataFrame([("a",), ("b",)], "paper_id string")), "request_id")
    assert got[1].papers == ["b", "a"] and got[1].message == "Papers not found: q" and got[2].missing == ["z"] and got[2].papers == []
    envelope = "paper_id string, source string, bullets array<string>, tldr array<string>"
    held = spark.createDataFrame([("a", "heuristic-fallback", ["1", "2", "3"], ["t"]), ("b", "heuristic-fallback", ["1"], ["t"]), ("c", "else", ["1", "2", "3"], ["t"])], envelope)
    papers = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "paper_id string")
    again = maintenance.reuse(papers, held, lambda rest: rest.selectExpr("paper_id", "'new' as source", "array('n') as bullets", "array('t') as tldr"))
    assert {r.paper_id: r.source for r in again.collect()} == {"a": "heuristic-fallback", "b": "new", "c": "new", "d": "new"}


def test_metadata(spark):
    pages = spark.createDataFrame([("a", "a_b.pdf", 1, A), ("e", "x_y.pdf", 1, "short")], "paper_id string, filename string, page_number int, text string")
    assert {r.paper_id: r.title for r in metadata.titles(pages).collect()} == {"a": "A Weighted Transformer for Translation", "e": "x y"}
    assert by(metadata.authors(pages), "paper_id")["a"].authors == ["Ann Writer", "Ben Reader"]
    spans = spark.createDataFrame([("a", 1, 800.0, 1, 10.0, 9.0, "small text here"), ("a", 1, 800.0, 2, 20.0, 20.0, "Large title text"), ("a", 1, 800.0, 3, 700.0, 30.0, "Low and larger text")], "paper_id string, page_number int, page_height double, span_no int, top double, size double, text string")
    assert by(metadata.titles_by_font(spans), "paper_id")["a"].title == "Large title text"
    lines = spark.createDataFrame([("a", 1, 0, "Experimental Setupp"), ("a", 1, 1, "Something else")], "paper_id string, page_number int, line_no int, line string")
    hints = spark.createDataFrame([("a", "Experimental setup"), ("a", "no section")], "paper_id string, hint_text string")
    assert [(r.line_no, r.heading) for r in metadata.hint_headings(lines, hints).collect()] == [(0, "Methodology")]
    assert by(metadata.titles(pages, spans), "paper_id")["a"].title == "Large title text"


def test_hints_cut_paragraphs_like_plain_comparison(spark):
    from difflib import SequenceMatcher

    text = "Intro words\nExperimental Setupp\nbody one\n3.1.2 Results\nbody two\nResults of it all are good and steady over every run we made\nbody three"
    pages = spark.createDataFrame([("a", "a.pdf", 1, text), ("b", "b.pdf", 1, text)], "paper_id string, filename string, page_number int, text string")
    hints = spark.createDataFrame([("a", " Experimental setup "), ("a", "3.1 Results"), ("a", "Nothing here"), ("a", None)], "paper_id string, hint_text string")
    got = by(segment.marked_lines(pages, hints), "paper_id", "line_no")
    near = lambda line, hint: SequenceMatcher(None, line.lower(), hint).ratio() > 0.92
    for k, line in enumerate(text.split("\n")):
        want = next((s for h, s in (("3.1 results", "Results"), ("experimental setup", "Methodology")) if near(line, h)), None)
        assert got["a", k].heading == (want or ("Results" if line.startswith("Results of") else None))
    assert got["b", 1].heading is None and [r.section for r in segment.paragraphs(pages, hints).where("paper_id = 'a'").orderBy("para_no").collect()] == ["Preamble", "Methodology", "Results"]


def test_years_and_dois_are_of_two_pages(spark):
    rows = [("a", "s-2001.pdf", 1, "arXiv: 9912.00001 of 2020"), ("b", "s_2001.pdf", 1, "from 2003, 1889"), ("b", "s_2001.pdf", 2, "10.1234/x.9, seen"), ("b", "s_2001.pdf", 3, "2050 10.9999/late"), ("c", "s-2004.pdf", 3, "2050"), ("d", "x.pdf", 1, None)]
    got = by(metadata.years_dois(spark.createDataFrame(rows, "paper_id string, filename string, page_number int, text string")), "paper_id")
    assert {k: (r.year, r.doi) for k, r in got.items()} == {"a": (1999, None), "b": (2003, "10.1234/x.9,"), "d": (None, None)}


def most_relevant(title, entries, near=0.5, most=5):
    """Places of the entries most like a title, by comparison with every one; entries of equal keys are one."""
    from math import log1p

    words = lambda t: frozenset(re.findall(r"\w+", (t or "").lower()))
    said = {"".join(re.findall(r"\w", (e or "").lower())): j for j, e in reversed(list(enumerate(entries)))}
    held = {j: words(entries[j]) for key, j in said.items() if key}
    weight = lambda ws: sum(log1p(len(held) / df) for w in ws if (df := sum(w in h for h in held.values())))
    alike = {j: round(weight(words(title) & h) / weight(words(title) | h), 9) for j, h in held.items()}
    return sorted((j for j in held if alike[j] >= near), key=lambda j: (-alike[j], j))[:most]


def test_relevant_titles_equal_comparison_with_all(spark):
    import random

    from paperloom.operators.relevance import relevant

    # words of very different frequency; some titles repeat in other case, are empty or very long
    rng = random.Random(5)
    some = lambda: " ".join(f"w{min(int(rng.paretovariate(0.5)), 60)}" for _ in range(rng.randint(1, 9)))
    entries = list(dict.fromkeys(some() for _ in range(150))) + ["Alone", "", None, " ".join(f"w{i}" for i in range(1, 61))]
    keys = ["".join(re.findall(r"\w", (e or "").lower())) for e in entries]
    kept = [j for j, key in enumerate(keys) if key and key not in keys[:j]]
    asked = [some() for _ in range(120)] + ["alone, unknown words", "ALONE", "", None, "unheard", entries[-1], "x " * 3000 + "alone"]
    asked += ["Entirely Other Start " + e for e in entries[:20]]
    catalog = spark.createDataFrame([(keys[j], entries[j], j) for j in kept], "ck string, title string, ord int")
    titles = spark.createDataFrame(list(enumerate(asked)), "k int, title string")
    for near in (0.3, 0.5, 0.9):
        got = {}
        for r in relevant(titles, catalog, near).orderBy("k", "rank").collect():
            got.setdefault(r.k, []).append(keys.index(r.ck))
        want = {k: found for k, t in enumerate(asked) if (found := most_relevant(t, entries, near))}
        assert got == want and len(got) > 20
    assert relevant(titles, catalog.limit(0)).collect() == [] and relevant(titles.limit(0), catalog).collect() == []


def test_enrichment_finds_titles_that_differ_at_the_start(spark):
    fields = "authors array<string>, year int, abstract string, venue string, doi string, url string"
    none = ([], None, None, None, None, None)
    entries = ["Deep Residual Networks for Image Recognition", "Towards Deep Residual Networks for Image Retrieval", "Graph Attention for Molecules", "Attention for Speech"]
    catalog = spark.createDataFrame([(i, t, ["C"], 2000 + i, None, "V", f"d{i}", None) for i, t in enumerate(entries)], f"ord int, title string, {fields}")
    asked = ["On Deep Residual Networks for Image Retrieval", "Revisiting Graph Attention for Molecules", "Deep-Residual Networks for Image Recognition", "Attentionforspeech", "Molecules"]
    papers = spark.createDataFrame([(str(i), t, *none) for i, t in enumerate(asked)], f"paper_id string, title string, {fields}")
    got = by(metadata.enrich(papers, catalog), "paper_id")
    assert [got[str(i)].doi for i in range(5)] == ["d1", "d2", "d0", "d3", None]


def test_enrichment_equals_plain_search(spark):
    from difflib import SequenceMatcher

    key = lambda t: "".join(c for c in (t or "").lower() if c.isalnum() or c == "_")
    base = "A Study of Very Long Titles in Science and Beyond Them"
    entries = [base.upper(), "A Study of Very Long Titles", base + ": Extended", "A Study of Something Else", "A Study of Very Long Titles in Science and Beyond", "Short", "", None, "Shorter", "A study of Very Lang Titles in Science and Beyond Them"]
    titles = [base, "A Study of Very Long Titles in", "A Study of V", "Short", "Shorte", "Unknown", None, "", "A Study of Very Long", "A Study of Very Lung Titles in Science"]
    fields = "authors array<string>, year int, abstract string, venue string, doi string, url string"
    catalog = spark.createDataFrame([(i, t, ["C", "D"], 2000 + i, None, "", f"10.1/{i}", None) for i, t in enumerate(entries)], f"ord int, title string, {fields}")
    papers = spark.createDataFrame([(str(i), t, ["A", "B"] if i % 2 else [], None if i % 3 else 1995, "", None, "", None) for i, t in enumerate(titles)], f"paper_id string, title string, {fields}")
    got = by(metadata.enrich(papers, catalog), "paper_id")
    for i, t in enumerate(titles):
        k, keys = key(t), [key(e) for e in entries]
        alike = [j for j, c in enumerate(keys) if k and c and (c == k or c.startswith(k[:40]) or k.startswith(c[:40]))]
        top = most_relevant(t, entries)
        pick = ([j for j in top if j in alike] + alike + top + [None])[0]
        hit = pick is not None and SequenceMatcher(None, k, keys[pick]).ratio() >= 0.6
        r = got[str(i)]
        assert r.title == (entries[pick] if hit else t) and (r.enrichment_source == "catalog") == hit, (t, pick)
        assert r.year == (1995 if i % 3 == 0 else 2000 + pick if hit else None) and r.doi == (f"10.1/{pick}" if hit else None) and r.venue is None
        assert r.authors == (["A", "B"] if i % 2 else ["C", "D"] if hit else [])


def test_enrichment_broadcasts_no_table(spark, monkeypatch):
    """tables that grow with the papers or the catalogue are exchanged, however small they look."""
    kinds = "title string, authors array<string>, year int, abstract string, venue string, doi string, url string"
    papers = spark.createDataFrame([(f"p{k}", f"Study {k} of things", [], None, None, "", None, None) for k in range(50)], f"paper_id string, {kinds}")
    catalog = spark.createDataFrame([(k, f"Study {k} of things: extended", ["A", "B"], 1999, None, "V", None, None) for k in range(50)], f"ord int, {kinds}")
    plans = []
    plain = staged_tables.staged

    def seen(df, tag, *partitions):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return plain(df, tag, *partitions)

    monkeypatch.setattr(metadata, "staged", seen)
    monkeypatch.setattr(relevance, "staged", seen)
    out = metadata.enrich(papers, catalog)
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert {r.enrichment_source for r in out.collect()} == {"catalog"}
    joins = [line for plan in plans for line in plan.splitlines() if "BroadcastHashJoin" in line]
    # only the few words that hold a thousandth of all, for each of the two sides twice
    assert len(joins) == 4 and all("[w#" in j for j in joins)


def test_enrichment_gives_each_paper_once(spark):
    fields = "authors array<string>, year int, abstract string, venue string, doi string, url string"
    none = (["A", "B"], None, None, None, None, None)
    title = "One Title of Some Length"
    catalog = spark.createDataFrame([(3, title, ["C"], 2003, None, "V", "d3", None), (3, title.upper(), ["C"], 2003, None, "V", "d3", None), (3, "Another Title", ["D"], 1999, None, "W", "d9", None), (8, title, ["C"], 2008, None, "X", "d8", None)], f"ord int, title string, {fields}")
    papers = spark.createDataFrame([("a", title, *none), ("a", title, *none), ("a", "Another Title", *none), ("b", title, *none), ("c", None, *none)], f"paper_id string, title string, {fields}")
    got = metadata.enrich(papers, catalog).collect()
    assert sorted((r.paper_id, str(r.year), str(r.venue)) for r in got) == [("a", "1999", "W"), ("a", "2003", "V"), ("a", "2003", "V"), ("b", "2003", "V"), ("c", "None", "None")]


def test_contexts_stop_at_the_budget(spark, paras):
    heads = spark.createDataFrame([("a", "HEAD\n\n")], "paper_id string, head string")
    only = paras.where("paper_id = 'a'")
    (whole,) = claims.contexts(heads, only).collect()
    assert whole.context.startswith("HEAD\n\n## Abstract\n[p2|p.1] ") and "## Discussion\n\n" in whole.context and whole.context.index("## Results") < whole.context.index("## Methodology")
    (part,) = claims.contexts(heads, only, 400).collect()
    assert part.context.endswith("[truncated]\n\n") and len(part.context) == 400 + len("\n[truncated]\n\n")
    assert claims.loss_expressions(only).first().expression == r"$L_{loss} = \lambda$"
    sets = spark.createDataFrame([(1, 0, "a"), (1, 1, "b")], "set_id int, paper_ord int, paper_id string")
    laid = by(matrix.wide(sets, extract.hyperparameters(paras).withColumnRenamed("name", "dimension"), 2), "dimension")
    assert laid["layers"].p0 == "12" and laid["layers"].p1 == "—"
    papers = spark.createDataFrame([("a", "T", ["X", "Y"], None)], "paper_id string, title string, authors array<string>, year int")
    assert claims.context_heads(papers).first().head == "TITLE: T\nAUTHORS: X, Y\nYEAR: None\n\n"


def test_dense_top_k(spark):
    import numpy as np

    x = np.random.default_rng(0).normal(size=(60, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    got = dense.dense_top_k(df, df.where("id % 20 = 0"), top_k=3, block=7).collect()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in (0, 20, 40):
        assert [r.id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] == np.argsort(-(unit @ unit[q]))[:3].tolist()


def test_intake(spark):
    files = spark.createDataFrame([("a.pdf", 5, bytearray(b"%PDF-")), ("b.txt", 5, bytearray(b"%PDF-")), ("c.PDF", 0, bytearray(b"")), ("d.pdf", 60 << 20, bytearray(b"%PDF")), ("e.pdf", 3, bytearray(b"abc"))], "path string, length long, content binary")
    assert [r.reason for r in intake.judged(files).orderBy("path").collect()] == [None, "name is not .pdf", "empty", "larger than 50 MiB", "not a PDF"]
    assert [r.status for r in intake.judged(files).orderBy("path").collect()] == [201, 400, 422, 413, 422]
    read = spark.createDataFrame([("a.pdf", " \n"), ("a.pdf", None)], "path string, text string")
    assert [r.reason for r in intake.judged(files, read).where("path = 'a.pdf'").collect()] == ["no text"]
    assert [r.reason for r in intake.judged(files, read.limit(0)).where("path = 'a.pdf'").collect()] == ["no pages"]
    typed = intake.judged(files.selectExpr("*", "case when path = 'a.pdf' then 'text/html' else '' end as content_type"))
    assert typed.where("path = 'a.pdf'").first().reason == "unsupported content type"


def test_nested_papers_are_read_back(spark, paras, tmp_path):
    titles = spark.createDataFrame([("a", "A title"), ("b", None), ("z", "No text")], "paper_id string, title string")
    made = nested.papers(titles, paras)
    for kind in ("json", "parquet"):
        nested_files.write(made, f"{tmp_path}/{kind}", kind)
        back = nested_files.read(spark, f"{tmp_path}/{kind}", kind)
        assert sorted(back.select("paper_id", "title").collect()) == sorted(titles.collect()) if kind == "parquet" else back.count() == 3
        assert sorted(nested.flat(back).collect()) == sorted(paras.where("paper_id in ('a', 'b')").select(nested.flat(back).columns).collect())
    whole = by(nested.envelope(titles, {"settings": extract.hyperparameters(paras), "hardware": extract.hardware(paras)}), "paper_id")
    assert [x.ord for x in whole["a"].settings] == list(range(1, 9)) and whole["a"].settings[0].sources[0].section == "Methodology"
    assert whole["a"].hardware[0].hardware == "8xV100" and whole["z"].settings == [] and whole["z"].source == "heuristic-fallback"


def test_matrix_has_a_cell_for_each_paper(spark):
    sets = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "c")], "set_id long, paper_ord long, paper_id string")
    tag = [("p1", 1, "Results")]
    values = spark.createDataFrame([("a", 3, 1, "x", "k", "1", tag), ("a", 3, 2, "x", "k", "0", tag), ("c", 3, 1, "y", "k", None, tag)], f"paper_id string, rank int, ord int, dimension string, kind string, value string, sources {claims.TAGS}")
    assert sorted((r.set_id, r.dimension, r.paper_id, r.value, len(r.sources)) for r in matrix.cells(sets, values).collect()) == [(1, "x", "a", "1", 1), (1, "x", "b", "—", 0), (2, "y", "c", "—", 1)]
    assert {(r.set_id, r.p0, r.p1) for r in matrix.wide(sets, values, 2).collect()} == {(1, "1", "—"), (2, "—", "—")}


def test_verdicts_notes_and_findings(spark):
    sets = spark.createDataFrame([(1, 0, "b"), (1, 1, "a"), (2, 0, "c")], "set_id long, paper_ord long, paper_id string")
    tag = lambda p: [(p, 1, "Results")]
    data = spark.createDataFrame([("a", 1, "D1", "x", tag("p1")), ("b", 1, "D2", "y", tag("p2")), ("b", 2, "D1", "z", tag("p3")), ("c", 1, "D1", "", tag("p4"))], f"paper_id string, ord int, name string, details string, sources {claims.TAGS}")
    got = by(matrix.dataset_verdicts(sets, data), "set_id", "name")
    assert (got[1, "D1"].paper_ids, got[1, "D1"].verdict, [t.paragraph_id for t in got[1, "D1"].sources]) == (["a", "b"], "consensus", ["p3", "p1"])
    assert got[1, "D2"].row_ord == 1 and got[1, "D1"].row_ord == 2 and got[2, "D1"].verdict == "single-source"
    results = [("b", 1, "WMT-14", "BLEU", 1.0, 2.0, 1.0, tag("p1")), ("b", 2, "wmt14", "bleu", 2.0, 1.0, -1.0, tag("p2")), ("a", 1, "WMT14", "BLEU", 1.0, 3.5, 2.5, tag("p3")), ("c", 1, "X", "F1", 0.0, 1.0, 1.0, tag("p4"))]
    found = spark.createDataFrame(results, f"paper_id string, ord int, task string, metric string, baseline double, score double, delta double, sources {claims.TAGS}")
    rows = by(matrix.benchmark_rows(sets, found), "set_id")
    assert rows[1].verdict == "contradiction" and rows[1].note == "Conflicting BLEU results on WMT14: b Δ-1, a Δ+2.5." and rows[1].paper_ids == ["a", "b"] and rows[2].note == ""
    told = by(matrix.findings(sets, data, found), "part")
    assert told["dataset"].statement == "Shared evaluation dataset: D1." and told["benchmark"].kind == "contradiction"
    assert {(r.paper_id, r.value) for r in matrix.benchmark_values(sets, found).collect()} == {("a", "1 → 3.5 (Δ+2.5 BLEU)"), ("b", "2 → 1 (Δ-1 bleu)"), ("c", "0 → 1 (Δ+1 F1)")}


def test_cited_hits_name_their_paragraphs(spark, paras):
    made = chunk.chunks(paras, target=80).cache()
    queries = spark.createDataFrame([(7, "WMT14 BLEU"), (8, None)], "query_id long, text string")
    got = search.cited(search.hybrid(made.selectExpr("chunk_id as id", "text"), queries, top_k=2), made).collect()
    assert {r.query_id for r in got} == {7} and len(got) == 2
    best = min(got, key=lambda r: r["rank"])
    held = by(made, "chunk_id")[best.id]
    assert best.paper_id == "a" and best.paragraph_ids == held.paragraph_ids and best.pages == held.pages and "BLEU" in held.text
    assert best.id.startswith("a:c") and best.page_number == min(best.pages) and best.section == held.section


def test_search_ranks_zero_cosine_and_guards(spark):
    texts = spark.createDataFrame([(k, "aa bb") for k in range(4)] + [(9, None)], "id long, text string")
    queries = spark.createDataFrame([(1, "zzqy"), (2, "bb"), (3, "?")], "query_id long, text string")
    got = search.hybrid(texts, queries, top_k=3).collect()
    assert {(r.query_id, r["rank"]): r.id for r in got} == {(q, k + 1): k for q in (1, 2, 3) for k in range(3)}
    for bad in (0, 21):
        with pytest.raises(ValueError):
            search.hybrid(texts, queries, top_k=bad)
    plain = search.hybrid(texts, queries, dense=False).collect()
    assert {r.query_id for r in plain} == {2} and len(plain) == 4
    assert search.hybrid(texts.limit(0), queries).collect() == [] and search.bm25(texts, queries.limit(0), 5).collect() == []
    assert {(r.query_id, r.id) for r in search.bm25(texts, queries, 5).collect()} == {(2, k) for k in range(4)}


def test_scoped_search_keeps_to_its_papers(spark):
    texts = spark.createDataFrame([(1, "a", "bleu score on wmt14 rises"), (2, "b", "graphs and trees"), (3, "b", None), (4, "c", "bleu")], "id long, paper_id string, text string")
    queries = spark.createDataFrame([(7, "BLEU WMT14"), (8, " "), (9, "bleu")], "query_id long, text string")
    scope = spark.createDataFrame([(7, "b"), (7, "a"), (7, "a"), (8, "a"), (9, "x")], "query_id long, paper_id string")
    got = search.scoped(texts, queries, scope).collect()
    assert {(r.query_id, r.id) for r in got} == {(7, 1), (7, 2), (7, 3)} and min(got, key=lambda r: r["rank"]).id == 1
    assert [(r.query_id, r.id, r.score) for r in search.lexical_overlap(texts, queries).where("rank = 1").orderBy("query_id").collect()] == [(7, 1, 2), (9, 1, 1)]


@pytest.mark.parametrize("block", [4, 1024])
def test_scoped_search_equals_search_of_the_scope_alone(spark, block):
    import random

    draw = random.Random(9)
    word = lambda: draw.choice(["alpha", "beta", "gamma", "delta", "pi"]) + draw.choice(["", "s", "7"])
    texts = spark.createDataFrame([(k, f"p{k // 2}", " ".join(word() for _ in range(draw.randint(0, 9)))) for k in range(40)], "id long, paper_id string, text string")
    queries = spark.createDataFrame([(q, " ".join(word() for _ in range(3)) if q else "?!") for q in range(7)], "query_id long, text string")
    named = {q: [f"p{k}" for k in range(20) if q < 5 or (k + q) % 3] for q in range(7)}
    scope = spark.createDataFrame([(q, p) for q, ps in named.items() for p in ps], "query_id long, paper_id string")
    got = sorted(map(tuple, search.scoped(texts, queries, scope, block=block).collect()))
    want = []
    for q in (0, 5, 6):
        mine = queries.where("query_id < 5") if q == 0 else queries.where(f"query_id = {q}")
        want += search.hybrid(texts.where(texts.paper_id.isin(named[q])), mine).collect()
    assert got == sorted(map(tuple, want))
    assert search._scopes(scope)[1].select("scope_id").distinct().count() == 3


@pytest.mark.parametrize("block", [2, 7])
def test_scopes_that_are_named_equal_lists_of_papers(spark, monkeypatch, block):
    """a scope is given once, not as pairs of a query and a paper, and its slices meet in several tasks."""
    monkeypatch.setattr(search, "SLICES", 3)
    texts = spark.createDataFrame([(k, k, f"w{k % 5} w{k % 3} common v{k % 11}") for k in range(60)], "id long, paper_id long, text string")
    queries = texts.where("id % 4 = 0").selectExpr("id as query_id", "text")
    held = texts.selectExpr("concat('s', id % 3) as scope_id", "paper_id").where("paper_id <> 8 or scope_id <> 's2'")
    asks = queries.selectExpr("query_id", "concat('s', query_id % 3) as scope_id")
    want = search.scoped(texts, queries, asks.join(held, "scope_id").select("query_id", "paper_id"), block=1024)
    got = search.scoped(texts, queries, asks, block=block, members=held)
    assert len(got.collect()) == 15 * 5 and sorted(got.collect()) == sorted(want.collect())


def test_a_task_gives_each_query_its_best_once(spark):
    """What search exchanges grows with the tasks, not with the blocks."""
    texts = spark.createDataFrame([(k, "a b " + f"c{k % 7}") for k in range(400)], "id long, text string")
    counted, asked = search.term_counts(texts), search.term_counts(texts.where("id < 3"))
    found = search.ranked(counted, asked, ("dense", "bm25"), 4, block=5)
    tasks = search.PARTS * spark.sparkContext.defaultParallelism
    assert found.count() <= 3 * 2 * 4 * tasks < 3 * 2 * 4 * 80


def test_given_vectors_rank_instead_of_hashed_ones(spark):
    texts = spark.createDataFrame([(1, "alpha"), (2, "beta"), (3, "gamma"), (4, None)], "id long, text string")
    queries = spark.createDataFrame([(7, "beta"), (8, "none of it")], "query_id long, text string")
    vectors = spark.createDataFrame([(1, [0.0, 2.0]), (2, [1.0, 0.0]), (3, [1.0, 1.0]), (3, [9.0, -9.0]), (4, None), (9, [5.0])], "id long, v array<float>")
    asked = spark.createDataFrame([(7, [0.0, 1.0]), (8, None)], "query_id long, v array<float>")
    got = {(r.query_id, r["rank"]): (r.id, r.dense_score, r.bm25_score > 0) for r in search.hybrid(texts, queries, vectors=vectors, query_vectors=asked).collect()}
    assert {got[7, k][0]: got[7, k][1:] for k in range(1, 5)} == {1: (1.0, False), 2: (0.0, True), 3: (round(0.5**0.5, 6), False), 4: (0.0, False)}
    assert [got[8, k][0] for k in range(1, 5)] == [1, 2, 3, 4] and all(got[8, k][1] == 0 for k in range(1, 5))


def test_whole_contexts_hold_a_long_introduction(spark, tmp_path):
    from paperloom.plans import queries

    rows = [(1, "some plain words " * 600, "en", "s", 10200)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    (got,) = queries.QUERIES["e16_whole_contexts"](spark, str(tmp_path)).collect()
    assert 10200 < got.n_chars <= 15000 and "used > 15000" in queries.ORACLE_SQL["e16_whole_contexts"]
