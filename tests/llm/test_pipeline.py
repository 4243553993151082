import datetime
import random

import test_operators as plain
from fixtures import SCHEMA

import corpus_pipeline
from paperloom.llm import bpe, decontaminate, langid
from paperloom.llm.queries import ranks_path

WHEN = datetime.datetime(2020, 1, 2, 3, 4, 5, 123456)


def inputs():
    """Rows with copies, near copies, leaks, shared passages, null ids and texts."""
    draw = random.Random(21)
    words = [a + b for a in ("tra", "vel", "qui", "mor", "sten", "lo") for b in ("ne", "dis", "ro", "mba", "kel", "fu", "zi")]
    prose = lambda n: " ".join(draw.choice(words) for _ in range(n))
    items = [prose(14), prose(20), "never seen anywhere in these texts at all, by any document", prose(16)]
    passage, copy, near = prose(40), prose(90), prose(2000)
    other = near.split(" ")
    other[700] = "changed"
    texts = [prose(60) for _ in range(12)]
    texts += [copy, copy, prose(30) + " " + passage, passage + " " + prose(35), prose(20) + " " + items[0] + " " + prose(20), items[1].replace("e", "a", 2) + " and " + prose(30)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(40, near), (41, " ".join(other)), (None, copy), (None, "no id " + texts[0][5:]), (None, prose(25) + " " + items[3]), (60, None), (61, ""), (62, "12 ... 34")]
    alone = prose(70)
    rows += [(None, alone), (None, alone), (7, texts[7]), (7, texts[7])]
    return rows, items


def plain_run(rows, items, dictionaries, ranks):
    """All stages without Spark: (id or None, ids of tokens)."""
    import public_tokenizers as P
    import tiktoken

    sizer = langid.Sizer(dictionaries)
    rows = [(i, t) for i, t in rows if sizer.classify(t)[1] >= 0.6]
    prints = [plain.plain_fingerprint(t) for _, t in rows]
    label = list(range(len(rows)))
    for _ in rows:  # until settled: the smallest label within two bits
        label = [min(label[j] for j in range(len(rows)) if (prints[i] ^ prints[j]).bit_count() <= 2) for i in range(len(rows))]
    num = lambda i: 1 << 62 if i is None else i
    kept = {}
    for (i, t), c, f in zip(rows, label, prints):
        kept.setdefault(c, []).append((num(i), f, t))
    rows = [(i, t) for i, _, t in map(min, kept.values())]
    rows = [(i, k.decode(errors="ignore")) for i, *_, k in plain.plain_kept(rows)]
    items = [decontaminate.normal(t) for t in items]
    leaked = lambda t: any(decontaminate.edits(x, decontaminate.normal(t))[0] <= int(len(x) * 0.2 + 1e-9) for x in items)
    coder = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.parse_ranks(ranks), special_tokens={})
    return sorted((i, coder.encode_ordinary(t)) for i, t in rows if not leaked(t)), sum(leaked(t) for _, t in rows)


def test_run_equals_a_plain_run(spark, tmp_path):
    rows, items = inputs()
    full = [(i, t, "xx", "s", None if t is None else len(t), "k", 1, 2, 3, 4, 5, 6, "e", WHEN, bytearray(b"\0\xff"), "n", [1, None]) for i, t in rows]
    docs = spark.createDataFrame(full, SCHEMA + ", at timestamp, raw binary, `__null` string, `fingerprint` array<int>").repartition(3)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    ranks = bpe.read_ranks(ranks_path())
    want, leaks = plain_run(rows, items, langid.learn(docs), ranks)
    assert leaks >= 3 and len(want) > 12
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((1 << 62 if r.doc_id is None else r.doc_id, r.ids) for r in got) == want
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "simhash_near_dedup", "suffix_array_dedup", "benchmark_decontamination", "byte_bpe"]
    before = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, str(tmp_path)).cache()
        assert after.dtypes == docs.dtypes and 0 < after.count() <= before.count()
        for r in after.collect():
            assert (r["at"], bytes(r["raw"]), r["__null"], r["fingerprint"], r["n_chars"]) == (WHEN, b"\0\xff", "n", [1, None], len(r["text"]))
        before = after


def test_pipeline_of_nothing(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
