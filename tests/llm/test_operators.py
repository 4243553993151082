import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from fixtures import documents, texts

from paperloom.llm import bpe, chat, decontaminate, importance, langid, quality_classifier, quality_rules, sharding, simhash, suffix_dedup, token_counts, vector_codes, word_bpe
from paperloom.llm.components import connected_components
from paperloom.llm.queries import QUERIES, ranks_path, words_path

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return documents(spark, [])


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(ranks_path())


def given(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def test_tables_of_a_scope_go_by_name(spark, docs):
    import os
    import threading

    from paperloom.llm import tables

    there = lambda path: os.path.isdir(path.removeprefix("file://"))
    other = []

    def beside():
        with tables.scope(spark) as made:
            tables.spool(docs.select("doc_id"), "beside")
            other.extend(made)

    with tables.scope(spark) as outer:
        with tables.scope(spark) as made:
            tables.spool(docs.select("doc_id"), "probe")
            thread = threading.Thread(target=beside)
            thread.start(), thread.join()
            held = tables.spool(docs.select("text"), "probe")
            first, last = made
        assert outer == [last] and not there(first) and there(last) and there(other[0])
        assert held.count() == docs.count()
    with pytest.raises(ZeroDivisionError), tables.scope(spark) as made:
        tables.spool(docs.select("doc_id"), "probe")
        1 / 0  # noqa: B018
    assert not there(made[0])


def test_a_cluster_must_name_a_shared_folder():
    from types import SimpleNamespace

    from paperloom.llm import tables

    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: default), sparkContext=context)
    with pytest.raises(RuntimeError):
        tables.shared_dir(session)
    context.getCheckpointDir = lambda: "hdfs://shared/"
    assert tables.shared_dir(session) == "hdfs://shared"


# 1 sharding


def test_shards_hold_every_row_once_and_keep_groups(docs, empty):
    rows = sharding.pack(docs, shards=3).collect()
    assert sorted((r.size, r.text_crc32) for r in rows) == sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t in given(docs))
    for s in range(3):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert sharding.pack(empty).collect() == []


def plain_shards(rows, shards, slack=0.01):
    """Groups in descending order of their largest share, each where it fits with the largest dot
    product; None for rows of groups that no shard can hold."""
    groups = {}
    for i, t in rows:
        groups.setdefault((t or "").encode(), []).append(i)
    size = {g: np.array([(len(g) + 1) * len(m), len(WORD.findall(g)) * len(m), len(m)], float) for g, m in groups.items()}
    total = np.maximum(sum(size.values()), 1)
    share = {g: v / total for g, v in size.items()}
    left, where = [np.full(3, 1 / shards) for _ in range(shards)], {}
    order = sorted(sorted(groups, key=lambda g: hashlib.md5(g).digest()), key=lambda g: -max(share[g]))
    for g in order:
        can = [s for s in range(shards) if all(left[s] >= share[g] - slack / shards)] or [s for s in range(shards) if left[s][0] >= share[g][0] - slack / shards]
        best = max(can, key=lambda s: (round(float(left[s] @ share[g]), 15), -s)) if can else max(range(shards), key=lambda s: (left[s][0], -s))
        left[best] = left[best] - share[g]
        where[g] = best
    return where


def test_shards_equal_a_plain_greedy(spark, docs):
    random.seed(8)
    rows = [(i, "w " * random.randint(1, 200) + random.choice("abc")) for i in range(300)]
    rows += [(300 + i, rows[i % 7][1]) for i in range(60)] + [(None, ""), (None, None), (400, "x " * 900)]
    got = sharding.pack(documents(spark, rows), shards=4).collect()
    want = plain_shards(rows, 4)
    shard_of = {}
    for r in got:
        shard_of.setdefault((r.size, r.text_crc32), set()).add(r.shard)
    assert all(len(s) == 1 for s in shard_of.values())
    assert shard_of == {(len(g) + 1, zlib.crc32(g)): {s} for g, s in want.items()}
    tokens = {(len(g) + 1, zlib.crc32(g)): len(WORD.findall(g)) for g in want}
    assert all(r.tokens == tokens[r.size, r.text_crc32] for r in got)
    fixture = sharding.pack(docs, shards=3).collect()
    by = {}
    for r in fixture:
        by.setdefault((r.size, r.text_crc32), set()).add(r.shard)
    assert all(len(s) == 1 for s in by.values())


def test_only_groups_beyond_a_shard_are_cut(spark):
    rows = [(i, "one hot text") for i in range(900)] + [(1000 + i, f"text {i % 150} of a smaller group") for i in range(900)] + [(2000 + i, "a group of a tenth") for i in range(200)]
    got = sharding.pack(documents(spark, rows), shards=4, bucket_units=20, fine=8).collect()
    shards = {}
    for r in got:
        shards.setdefault(r.text_crc32, set()).add(r.shard)
    assert len(shards[zlib.crc32(b"one hot text")]) == 4 and all(len(s) == 1 for c, s in shards.items() if c != zlib.crc32(b"one hot text"))
    size = collections.Counter()
    for r in got:
        size[r.shard] += r.size
    assert max(size.values()) < 1.1 * min(size.values())


def test_shards_are_balanced_and_hot_groups_split(spark):
    random.seed(3)
    rows = [(i, "copy of a hot text") for i in range(1000)] + [(1000 + i, "w " * random.randint(1, 60)) for i in range(2000)]
    put = sharding.pack(documents(spark, rows), shards=4, bucket_units=64).collect()
    size, count = collections.Counter(), collections.Counter()
    for r in put:
        size[r.shard] += r.size
        count[r.shard] += 1
    assert max(size.values()) < 1.03 * min(size.values())
    assert max(count.values()) < 1.1 * min(count.values())


def test_place_takes_the_largest_dot_product():
    where, left = sharding.place(np.array([[0.5, 0.1, 0.1], [0.2, 0.1, 0.1]]), np.array([[0.5, 0.5, 0.5], [0.5, 0.6, 0.5]]))
    assert where.tolist() == [1, 0] and np.allclose(left, [[0.3, 0.4, 0.4], [0.0, 0.5, 0.4]])


# 2 simhash


def plain_fingerprint(text):
    w = WORD.findall((text or "").encode().lower())
    s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(rows):
    """(id, fingerprint) -> smallest id reachable, over all pairs."""
    prints = sorted({f for _, f in rows})
    parent = {f: f for f in prints}

    def root(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for a in prints:
        for b in prints:
            if a < b and (a ^ b).bit_count() <= 2:
                parent[root(a)] = root(b)
    least = {}
    for i, f in rows:
        if i is not None:
            least[root(f)] = min(least.get(root(f), i), i)
    return sorted(((i if i is not None else -1), f, least.get(root(f))) for i, f in rows)


def test_rows_without_an_id_link_others(spark, monkeypatch):
    prints = {"a": 0b0001, "b": 0b0111, "c": 0b11111, "d": 1 << 40, "e": 1 << 40 | 0b11 << 50}
    monkeypatch.setattr(simhash, "fingerprints", lambda docs: docs.select("doc_id", simhash.F.when(simhash.F.col("text") == "a", prints["a"]).when(simhash.F.col("text") == "b", prints["b"]).when(simhash.F.col("text") == "c", prints["c"]).when(simhash.F.col("text") == "d", prints["d"]).otherwise(prints["e"]).cast("long").alias("fp")))
    rows = [(1, "a"), (None, "b"), (2, "c"), (None, "d"), (None, "e")]
    got = simhash.near_duplicates(documents(spark, rows)).collect()
    assert sorted((str(r.doc_id), r.component_id) for r in got) == sorted((str(i), c) for i, _, c in plain_rows([(i, prints[t]) for i, t in rows]))


def plain_rows(rows):
    return [(None if i == -1 else i, f, c) for i, f, c in plain_components(rows)]


def test_one_row_of_each_component_stays(docs, empty):
    got = simhash.keep_one(docs)
    rows = given(docs)
    want = plain_rows([(i, plain_fingerprint(t)) for i, t in rows])
    named = {c for _, _, c in want if c is not None}
    assert got.columns == docs.columns and got.dtypes == docs.dtypes
    kept = [(r.doc_id, r.text) for r in got.collect()]
    assert sorted(i for i, _ in kept if i is not None) == sorted(named) and set(kept) <= set(rows)
    nameless = {f for i, f, c in want if c is None}
    assert len([1 for i, _ in kept if i is None]) == len(nameless)
    assert simhash.keep_one(empty).collect() == []


def test_near_duplicates_equal_brute_force(docs, empty):
    got = simhash.near_duplicates(docs).collect()
    want = plain_components([(i, plain_fingerprint(t)) for i, t in given(docs)])
    assert sorted(((r.doc_id if r.doc_id is not None else -1), r.fp & (2**64 - 1), r.component_id) for r in got) == want
    assert simhash.near_duplicates(empty).collect() == []


def test_long_texts_are_read_in_pieces(monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 64)
    for t in texts():
        assert simhash.fingerprint(t) == plain_fingerprint(t)


@pytest.mark.parametrize("crowd", [2, 5, 1000])
def test_crowded_variants_lose_no_link(spark, crowd):
    random.seed(crowd)
    prints = {random.getrandbits(64) for _ in range(40)}
    for seed in list(prints)[:4]:
        near = [seed]
        for _ in range(30):
            near.append(random.choice(near) ^ 1 << random.randrange(64) ^ (random.random() < 0.7 and 1 << random.randrange(64)))
        prints.update(near)
    rows = list(enumerate(sorted(prints)))
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    found = simhash.links(spark.createDataFrame([(signed(f),) for _, f in rows], "fp long"), crowd).collect()
    number = {signed(f): i for i, f in rows}
    edges = spark.createDataFrame([(number[r.a], number[r.b]) for r in found] or [(0, 0)], "a long, b long")
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert [(i, f, got.get(i, i)) for i, f in rows] == plain_components(rows)


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 100 + i) for i in range(1, 40)] + [(7, 7)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(51)} | {i: 100 for i in range(100, 140)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


# 3 language


def test_language_of_held_out_texts(spark):
    random.seed(2)
    parts = {"aa": ["tro", "vel", "qui", "mor"], "bb": ["sche", "ung", "zer", "keit"], "cc": ["ção", "nha", "lho", "mente"]}
    text = lambda lang, n: " ".join("".join(random.choices(parts[lang], k=random.randint(1, 3))) for _ in range(n))
    rows = [(i, text(lang, random.randint(8, 120)), lang) for i in range(300) for lang in [random.choice(list(parts))]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learned = langid.learn(docs, dict_bytes=4096)
    assert all(len(d) <= 4096 for d in learned.values()) and list(learned) == sorted(parts)
    got = {r.doc_id: r for r in langid.identify(docs, learned).collect()}
    right = [got[i].lang_pred == lang for i, _, lang in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(right) / len(right) > 0.97


def test_languages_equal_plain_compression(docs):
    import zstandard

    learned = langid.learn(docs)

    def sizes(text, level):
        out = {}
        for lang, content in learned.items():
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level)
            c = zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)
            data = langid.plain(text)
            out[lang] = sum(len(c.compress(data[i : i + 4096])) for i in range(0, len(data), 4096))
        return out

    for r, text in [(r, dict(given(docs)).get(r.doc_id)) for r in langid.identify(docs, learned).where("doc_id is not null").collect()]:
        if not text or not any(c.isalpha() for c in text):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        for level in (3, 19):
            got = sizes(text, level)
            best = min(sorted(got), key=got.get)
            score = 1 / sum(2.0 ** max(got[best] - n, -60) for n in got.values())
            if score >= 0.95:
                break
        assert (r.lang_pred, r.score) == (best, score) and r.rejected == (score < 0.6)


def test_language_edges(docs, empty):
    learned = langid.learn(docs)
    got = langid.identify(docs, learned).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r for r in got}
    assert all(by[i].lang_pred == "und" and by[i].rejected for i in (0, 1, 2, 4))
    kept = langid.keep_identified(docs, learned)
    assert kept.columns == docs.columns and kept.count() == sum(not r.rejected for r in got)
    assert langid.learn(empty) == {} and langid.identify(empty, {}).collect() == []
    assert {r.lang_pred for r in langid.identify(docs, {}).collect()} == {"und"}


# 4 quality rules


def plain_statistics(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen = collections.Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if seen[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_statistics_equal_brute_force(docs, empty):
    got = quality_rules.statistics(docs).collect()
    tell = lambda rows: sorted(((-1 if i is None else i), s) for i, s in rows)
    assert tell((r.doc_id, (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)) for r in got) == tell((i, plain_statistics(t)) for i, t in given(docs))
    labels = docs.sparkSession.createDataFrame([], "doc_id long, quality int")
    assert quality_rules.judge(empty, labels).collect() == []
    judged = quality_rules.judge(docs, labels).collect()
    assert all(r.kept != r.base_failed for r in judged)


def test_verdicts_equal_the_list_read_in_order(spark):
    random.seed(4)
    texts = [("word " * random.randint(5, 60) + random.choice(["", "## $$ ", "SHOUT " * 20])) * random.choice([1, 1, 2]) for _ in range(400)]
    docs = documents(spark, list(enumerate(texts)))
    labels = spark.createDataFrame([(i, int("#" not in t and "SHOUT" not in t)) for i, t in enumerate(texts) if i % 2], "doc_id long, quality int")
    stats = quality_rules.statistics(docs).cache()
    known = stats.join(labels, "doc_id").where(~quality_rules.base_failed())
    rules = quality_rules.learn_rules(known.selectExpr("doc_id as id", "1 - quality as bad", "*").select("id", "bad", *quality_rules.features()))
    got = {r.doc_id: r for r in quality_rules.judge(docs, labels).collect()}
    for i, t in enumerate(texts):
        n, chars, symbols, dup, repeat = plain_statistics(t)
        lines = [x for x in t.split("\n") if x.strip()]
        x = {"mean_word": chars / n, "symbol_share": symbols / chars, "dup_line_share": dup / len(lines), "repeat_share": repeat / n, "upper_share": sum("A" <= c <= "Z" for c in t) / chars}
        failed = n < 20 or 100 * repeat > 30 * n
        hit = any(all(x[f] > c if sign == ">" else x[f] <= c for f, sign, c in rule) for rule in rules)
        assert (got[i].base_failed, got[i].kept) == (failed, not failed and not hit)


def test_rules_are_learned_and_ordered(spark):
    random.seed(1)
    rows = []
    for i in range(1500):
        bad = i % 5 == 0
        rows.append((i, int(bad), 5.0 + random.random(), random.uniform(0.1, 0.5) if bad and i % 2 else random.uniform(0, 0.05), 0.0, 0.0, random.uniform(0.4, 0.9) if bad and not i % 2 else random.uniform(0, 0.1)))
    df = spark.createDataFrame(rows, "id long, bad int, " + ", ".join(f"{f} double" for f in quality_rules.FEATURES))
    rules = quality_rules.learn_rules(df)
    got = df.withColumn("kept", quality_rules.verdict(rules)).collect()
    assert sum(r.kept == (r.bad == 0) for r in got) > 0.98 * len(got)
    assert quality_rules.learn_rules(df.limit(0)) == []


# 5 byte-level BPE


def test_encoding_equals_tiktoken_and_round_trips(docs, empty, ranks):
    import public_tokenizers as P
    import tiktoken

    plain = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.parse_ranks(ranks), special_tokens={})
    got = bpe.encode(docs, ranks, ("n_tokens", "ids", "offsets", "decoded", "ids_sha256", "decoded_sha256")).collect()
    tell = lambda rows: sorted(((-1 if i is None else i), list(x)) for i, x in rows)
    assert tell((r.doc_id, r.ids) for r in got) == tell((i, plain.encode_ordinary(t or "")) for i, t in given(docs))
    words = {v: k for k, v in bpe.parse_ranks(ranks).items()}
    for r in got:
        assert r.n_tokens == len(r.ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, r.ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(r.decoded).hexdigest()
        assert all(bytes(r.decoded)[o:].startswith(words[i]) for o, i in zip(r.offsets, r.ids))
    assert sorted(bytes(r.decoded) for r in got) == sorted((t or "").encode() for _, t in given(docs))
    back = bpe.decode_ids(bpe.encode(docs, ranks, ("ids",)), ranks)
    assert sorted(bytes(r.decoded) for r in back.collect()) == sorted((t or "").encode() for _, t in given(docs))
    assert bpe.encode(empty, ranks).collect() == []


def test_boundaries_equal_the_pattern():
    import public_tokenizers as P
    import regex

    random.seed(9)
    some = ["".join(random.choices("ab'stremvld  \n\t é1½٣.,!🎉$", k=random.randint(0, 60))) for _ in range(3000)]
    assert list(bpe.pre_tokens(some)) == [regex.findall(P.PATTERN, t) for t in some]
    for t in some[:500]:
        for most, look in ((5, 4096), (3, 2)):
            assert [p for c in bpe.pieces(t, most, look) for p in next(bpe.pre_tokens([c]))] == regex.findall(P.PATTERN, t)
    dense = "日本語の文。123" * 500 + "QmFzZTY0" * 500
    assert max(map(len, bpe.pieces(dense, 100))) < 120


def test_the_cache_of_merges_is_bounded_and_released(docs, ranks, monkeypatch):
    merges = bpe.Merges(bpe.parse_ranks(ranks), most=20_000)
    for k in range(50):
        merges.learn([[f" tok{k}x{i}" for i in range(20)]])
        assert merges.held < 40_000 and len(merges) <= 100
    assert merges[" tok1x1"] == bpe.Merges(bpe.parse_ranks(ranks)).merge(b" tok1x1")
    table, _ = bpe.coder(ranks)
    table.clear()
    assert not table and not table.held


def test_long_pre_tokens_merge_alike(ranks):
    merges = bpe.Merges(bpe.parse_ranks(ranks))
    random.seed(4)
    for n in (1, 5, 31, 32, 33, 70, 300):
        for _ in range(20):
            w = "".join(random.choices("theironandß ", k=n)).encode()
            parts = [w[i : i + 1] for i in range(len(w))]
            assert merges.merge_long(list(parts)) == merges.merge_rows([w], len(w) + 4)[0]


# 6 token counts


def plain_count(word, weight):
    best, longest = [(0, 0)] + [(-(1 << 62), 0)] * len(word), max(map(len, weight))
    for end in range(1, len(word) + 1):
        for at in range(max(0, end - longest), end):
            if (w := weight.get(word[at:end])) is not None:
                best[end] = max(best[end], (best[at][0] + w, best[at][1] - 1))
    return -best[-1][1]


def test_token_counts_equal_brute_force(docs, empty, ranks):
    weight = token_counts.Unigram(bpe.parse_ranks(ranks)).weight
    known = {}
    want = []
    for i, t in given(docs):
        p = next(bpe.pre_tokens([t or ""]))
        for w in p:
            if w not in known:
                known[w] = plain_count(w.encode(), weight)
        want.append(((-1 if i is None else i), len(p), sum(known[w] for w in p)))
    got = [((-1 if r.doc_id is None else r.doc_id), r.n_pre_tokens, r.n_tokens) for r in token_counts.count_tokens(docs, ranks).collect()]
    assert sorted(want) == sorted(got)
    assert token_counts.count_tokens(empty, ranks).collect() == []


# 7 suffix-array dedup


def plain_kept(rows):
    least = {}
    num = lambda i: 1 << 62 if i is None else i
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - 49):
            s = b[p : p + 50]
            least[s] = min(least.get(s, 1 << 63), num(i))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 49):
            if least[b[p : p + 50]] < num(i):
                gone[p : p + 50] = True
        edges = np.diff(np.concatenate([[0], gone.astype(int), [0]]))
        out.append((num(i), len(b), int(gone.sum()), int((edges == 1).sum()), bytes(x for x, g in zip(b, gone) if not g)))
    return sorted(out)


@pytest.mark.parametrize("small", [False, True])
def test_removed_bytes_equal_brute_force(docs, empty, small, monkeypatch):
    if small:  # many units, buckets and splitters, and every shared anchor hot
        monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", 5000)
        whole = suffix_dedup.shared_anchors
        monkeypatch.setattr(suffix_dedup, "shared_anchors", lambda p, b, e: whole(p, b, e, 2))
        monkeypatch.setattr(suffix_dedup, "UNIT_BYTES", 3000)
    got = suffix_dedup.remove_repeats(docs, ("n_bytes", "n_removed", "n_spans", "kept")).collect()
    assert sorted((1 << 62 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == plain_kept(given(docs))
    assert suffix_dedup.remove_repeats(empty).collect() == []


@pytest.mark.parametrize("parts", [1, 4])
def test_repeated_rows_lose_what_a_smaller_id_has(spark, parts):
    random.seed(9)
    some = lambda n: "".join(random.choices("abcdefghij ", k=n))
    passage, other = some(80), some(90)
    twice, nameless = some(60) + passage + some(70), some(30) + other + some(40)
    rows = [(1, passage + some(20)), (2, some(10) + other), (7, twice), (7, twice), (9, twice), (None, nameless), (None, nameless), (None, nameless + passage)]
    got = suffix_dedup.remove_repeats(documents(spark, rows).coalesce(parts), ("n_bytes", "n_removed", "n_spans", "kept")).collect()
    assert sorted((1 << 62 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == plain_kept(rows)


def test_strip_keeps_columns(docs):
    import datetime

    when = datetime.datetime(2021, 2, 3, 4, 5, 6, 123456)
    odd = docs.selectExpr("*", "timestamp'2021-02-03 04:05:06.123456' as `a b`", "cast('x' as binary) as raw", "array(struct(1 as k, cast(null as string) as v)) as nested", "'n' as `__null`", "unhex('00ff') as `text is there`", "doc_id as carried_0")
    got = suffix_dedup.strip_repeats(odd)
    assert got.dtypes == odd.dtypes and got.count() == docs.count()
    assert got.where("text is null").count() == 1
    want = {(i, k.decode(errors="ignore")) for i, _, _, _, k in plain_kept(given(docs))}
    for r in got.collect():
        assert (r["a b"], bytes(r["raw"]), r["nested"][0].k, r["nested"][0].v, r["__null"], bytes(r["text is there"])) == (when, b"x", 1, None, "n", b"\0\xff")
        assert r.carried_0 == r.doc_id and ((1 << 62 if r.doc_id is None else r.doc_id), r.text or "") in want and r.n_chars == len(r.text or "")


def test_more_buckets_than_samples(docs, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", 500)
    monkeypatch.setattr(suffix_dedup, "SAMPLES", 3)
    monkeypatch.setattr(suffix_dedup, "RANGES", 4)
    monkeypatch.setattr(suffix_dedup, "UNIT_BYTES", 3000)
    got = suffix_dedup.remove_repeats(docs, ("n_bytes", "n_removed", "n_spans", "kept")).collect()
    assert sorted((1 << 62 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == plain_kept(given(docs))


def test_parts_of_a_long_document_agree(monkeypatch):
    text = np.random.default_rng(1).integers(97, 105, 5000, dtype=np.uint8)
    doc = np.zeros(5000, np.int64)
    first, count, at, g = suffix_dedup.anchors(text, doc)
    assert first[0] == 0 and (first[1:] == first[:-1] + count[:-1]).all() and first[-1] + count[-1] == 4951
    assert ((at >= first + count - 1) & (at + suffix_dedup.LEAD <= first + suffix_dedup.WINDOW)).all()


def test_ranks_order_rows():
    rows = np.random.default_rng(2).integers(0, 3, (500, 19), dtype=np.uint8)
    assert (suffix_dedup.ranks(rows) == np.unique(rows, axis=0, return_inverse=True)[1].ravel()).all()


# 8 quality classifier


def test_classifier_on_held_out_rows(spark, docs, empty):
    random.seed(6)
    good = lambda: " ".join(random.choice(["alpha", "beta", "gamma", "delta", "is", "of"]) + random.choice(["", ",", ".\n"]) for _ in range(80))
    rows = [(i, good() if i % 3 else "JUNK!! $$ " * random.randint(5, 60)) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i, _ in rows], "doc_id long, quality int, toxic int")
    got = quality_classifier.classify(documents(spark, rows), labels).collect()
    held = [r for r in got if r.held_out]
    assert len(got) == 400 and sum(r.predicted == int(r.doc_id % 3 > 0) for r in held) > 0.97 * len(held)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == int(r.score >= 0.7) for r in got)
    assert quality_classifier.classify(empty, labels).collect() == []
    assert all(0 <= r.score <= 1 for r in quality_classifier.classify(docs, labels.limit(0)).collect())


def plain_vector(text):
    """The statistics by plain loops."""
    data = (text or "").encode()
    words, lines = data.split(), [x for x in data.split(b"\n") if x.strip()]
    logit = lambda a, b: float(np.log((a + 0.5) / (b - a + 0.5))) if b >= a else 0.0
    count = lambda ok: sum(1 for c in data if ok(c))
    marks = [lambda c: 65 <= c <= 90, lambda c: 48 <= c <= 57, lambda c: c in b"#*$%&|<>", lambda c: c in b".,;:!?", lambda c: c in b"\"'()[]{}+-=/\\@^_`~", lambda c: c > 127]
    n, k = len(words), collections.Counter(words)
    equal = sum(a == b for a, b in zip(words, words[1:]))
    out = [np.log1p(len(data)), np.log1p(n), len(data) / n if n else 0.0, *(logit(count(m), len(data)) for m in marks)]
    out += [logit(len(k), n) - 0.5 * np.log1p(n), logit(max(k.values(), default=0), n), logit(equal, max(n - 1, 0)), logit(len(lines) - len(set(lines)), len(lines)), np.log1p(n / max(len(lines), 1))]
    return np.clip(np.array(out), -20, 20)


def test_scores_equal_a_plain_fit(spark, docs):
    rows = [(i, t) for i, t in given(docs) if i is not None]
    labels = [(i, k % 2) for k, (i, _) in enumerate(sorted(rows, key=str)) if i % 3] + [(0, None)]
    got = quality_classifier.classify(docs, spark.createDataFrame(labels, "doc_id long, quality int")).where("doc_id is not null").collect()
    known = {}
    for i, y in labels:
        if y is not None and zlib.crc32(str(i).encode()) % 4 != 2:
            known[i] = min(known.get(i, 1), y)
    x = {y: np.array([plain_vector(t) for i, t in rows if known.get(i) == y]) for y in (0, 1)}
    n = sum(map(len, x.values()))
    within = sum((v - v.mean(axis=0)).T @ (v - v.mean(axis=0)) for v in x.values()) / n
    logs = {}
    for y, v in x.items():
        cov = 0.8 * np.cov(v.T, bias=True) + 0.2 * within
        cov = 0.9 * cov + 0.1 * np.diag(np.diag(cov)) + 1e-2 * np.eye(len(cov))
        logs[y] = lambda p, m=v.mean(axis=0), c=cov: -0.5 * (p - m) @ np.linalg.inv(c) @ (p - m) - 0.5 * np.linalg.slogdet(c)[1]
    text = {}
    for i, t in rows:
        text[i] = t
    for r in got:
        p = plain_vector(text[r.doc_id])
        want = 1 / (1 + np.exp(-np.clip(logs[1](p) - logs[0](p) + np.log((len(x[1]) + 1) / (len(x[0]) + 1)), -700, 700)))
        assert abs(r.score - want) < 1e-6, r.doc_id


def test_discriminant_equals_plain_densities():
    draw = np.random.default_rng(0)
    x = [draw.normal(size=(300, 14)), draw.normal(1, 2, size=(200, 14))]
    model = quality_classifier.Discriminant(np.array([300.0, 200.0]), np.stack([v.sum(axis=0) for v in x]), np.stack([v.T @ v for v in x]), 0.0, 0.0)
    logs = []
    for v in x:
        cov = np.cov(v.T, bias=True) + 1e-2 * np.eye(14)
        d = x[0][:5] - v.mean(axis=0)
        logs.append(-0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d) - 0.5 * np.linalg.slogdet(cov)[1])
    assert np.allclose(model.score(x[0][:5]), 1 / (1 + np.exp(-(logs[1] - logs[0] + np.log(201 / 301)))))


# 9 chat


def test_conversations_read_back(spark):
    odd = ["", "<|open|>", "\\", "<\\|", "\\<|\\", "</s>[INST]", "a\nb", "<|next|><|close|>\\\\"]
    rows = [(1, k, "user" if k % 3 else "assistant", t) for k, t in enumerate(odd)] + [(2, 0, None, None), (None, None, "user", "x"), (2, 1, "assistant", "y"), (2, 1, "assistant", "y"), (3, 5, "a<|text|>", "z")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("t", chat.F.lit(1))
    made = chat.format_conversations(turns)
    got = {r.conv_id: r for r in made.select("conv_id", "formatted", chat.read_back(chat.F.col("formatted")).alias("turns"), chat.loss_text(chat.F.col("segments")).alias("loss")).collect()}
    for c in (1, 2, 3, None):
        mine = sorted(((-1 if r[1] is None else r[1]), r[2] or "", r[3] or "") for r in rows if r[0] == c)
        assert [(t.role, t.text) for t in got[c].turns] == [(r, t) for _, r, t in mine]
        assert got[c].loss == "".join(t for _, r, t in mine if r == "assistant")
    assert got[2].formatted.count(chat.OPEN) == 2 and got[2].formatted.count(chat.NEXT) == 1
    assert chat.format_conversations(turns.limit(0)).collect() == []


# 10 decontamination


def test_edits_equal_brute_force():
    random.seed(8)
    for _ in range(200):
        a, b = (bytes(random.choices(b"abc", k=random.randint(1, 12))) for _ in range(2))
        row = [0] * (len(b) + 1)
        for i, x in enumerate(a, 1):
            last, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        assert decontaminate.edits(a, b)[0] == min(row)


def test_leaks_are_found_and_clean_texts_left(spark, docs, empty):
    random.seed(11)
    word = lambda: "".join(random.choices("abcdefghijklmnopqrstuvwxyz", k=random.randint(2, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    items = [prose(random.randint(15, 50)) for _ in range(20)]
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(items)] + [(90, None), (91, ""), (92, items[0]), (93, "short one")], "item_id long, text string")

    def changed(t, share):
        t = list(t)
        for _ in range(int(share * len(t))):
            t[random.randrange(len(t))] = random.choice("abcdefgh")
        return "".join(t)

    rows, leaks = [], set()
    for k in range(60):
        item = k % 20
        kind = k // 20
        body = items[item].upper() if kind == 0 else changed(items[item], 0.05 * kind)
        rows.append((k, prose(40) + "\n" + body + "  " + prose(40)))
        leaks.add((k, item))
    rows += [(100 + k, prose(100)) for k in range(40)] + [(200, "it has a Short  one in it")]
    got = {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(documents(spark, rows), bench).collect()}
    found = decontaminate.keep_clean(documents(spark, rows), bench)
    assert found.columns == documents(spark, rows).columns and {r.doc_id for r in found.collect()} == {r[0] for r in rows} - {d for d, _ in got}
    text = {i: decontaminate.normal(t) for i, t in rows}
    exact = {(i, k) for i, t in text.items() for k, item in [*enumerate(items), (93, "short one")] if decontaminate.edits(item.encode(), t)[0] <= int(len(item) * 0.2 + 1e-9)}
    assert leaks <= exact and set(got) <= exact and len(exact - set(got)) <= 0.05 * len(exact)
    assert all(r.similarity >= 0.8 for r in got.values()) and all(got[k, k].distance == 0 for k in range(20))
    blocks = decontaminate.contaminated(documents(spark, rows), bench, block_bytes=1000).collect()
    assert {(r.doc_id, r.item_id) for r in blocks} == set(got)
    assert decontaminate.contaminated(empty, bench).collect() == []
    assert decontaminate.contaminated(docs, bench.limit(0)).collect() == []
    assert decontaminate.keep_clean(docs, bench.limit(0)).count() == docs.count() and decontaminate.keep_clean(empty, bench).count() == 0
    nameless = documents(spark, [(None, "x " + items[3] + " y"), (None, "nothing of note")])
    assert [r.text for r in decontaminate.keep_clean(nameless, bench).collect()] == ["nothing of note"]


@pytest.mark.parametrize("share", [0.05, 0.1, 0.15, 0.2])
def test_recall_against_exhaustive_search(share):
    draw = random.Random(12)
    word = lambda: bytes(draw.choices(b"abcdefghijklmnopqrstuvwxyz", k=draw.randint(2, 8)))
    prose = lambda n: b" ".join(word() for _ in range(n))
    items = [prose(n) for n in range(3, 73)] + [prose(400)]
    index = decontaminate.Index(list(enumerate(items)), 0.8, 0.95, 0.3, 2)

    def bytes_edited(t, n):
        t = [bytes([c]) for c in t]
        for p in draw.sample(range(len(t)), n):
            t[p] = draw.choice([b"#", b"", b"#" + t[p], draw.choice([b"e", b"a", b" "])])
        return b"".join(t)

    def words_edited(t, n):
        out = t.split(b" ")
        for k in draw.sample(range(len(out)), len(out)):
            if len(out[k]) <= n:
                n, out[k] = n - len(out[k]), bytes(draw.choices(b"xyz", k=len(out[k])))
        return b" ".join(out)

    every_fifth = lambda t, n: b"".join(b"#" if i % 5 == 4 and i // 5 < n else t[i : i + 1] for i in range(len(t)))
    for edit in (bytes_edited, words_edited, every_fifth):
        texts = [b" ".join((prose(20), edit(t, int(share * len(t) + 1e-9)), prose(20))) for t in items]
        found = index.leaks(texts)
        exact = {(d, k): n for d, text in enumerate(texts) for k, t in enumerate(items) if (n := decontaminate.edits(t, text)[0]) <= index.slack[k]}
        assert len(exact) >= len(items) and len(exact.keys() & found.keys()) >= 0.9 * len(exact), edit.__name__
        assert {p: n for p, (n, _) in found.items()} == {p: exact[p] for p in found}
        short = {p for p in exact if len(items[p[1]]) < decontaminate.SHORT}
        assert len(short & found.keys()) >= 0.9 * len(short)


def test_walks_agree_with_a_plain_walk():
    walks = decontaminate.Walks(0.95, 0.3, 2)
    windows = [b"some window of bytes", b"some wind", b"x"]
    got = walks.samples(windows)
    for w, seen in zip(windows, got):
        for t in range(walks.times):
            for k, share in enumerate(walks.share[t]):
                at = 0
                for j in range(int(share * 2 * len(w))):
                    at += int(walks.moves(j)[t * 256 + w[at]]) if at < len(w) else 0
                assert seen[t, k] == (w[at] if at < len(w) else 0)
    assert walks.alike(windows, np.array([20, 9, 1]), np.arange(3), got).all()


def test_banded_decision_equals_edits():
    draw = random.Random(13)
    some = lambda n: bytes(draw.choices(b"abc", k=n))
    items = [some(draw.randint(5, 60)) for _ in range(300)]
    slack = np.array([len(t) // 5 for t in items])
    parts = [some(len(t) + 2 * k) for t, k in zip(items, slack.tolist())]
    parts[::2] = [some(k) + t[: len(t) // 2] + some(k) + t[len(t) // 2 :] for t, k in zip(items[::2], slack[::2].tolist())]
    got = decontaminate.within(items, parts, slack)
    want = np.array([decontaminate.edits(t, p)[0] <= k for t, p, k in zip(items, parts, slack.tolist())])
    assert want.any() and not want.all() and (got == want).all()


def refused(draw):
    """Items, and texts that share two 8-byte strings with one: candidates that no walk accepts."""
    word = lambda: "".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=draw.randint(2, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    items = [prose(30) for _ in range(12)]
    return items, [prose(8) + t[40:49] + prose(3)[:12] + t[58:75] + prose(8) for t in items] + [prose(20) for _ in range(4)]


def test_texts_whose_candidates_are_all_refused():
    items, texts = refused(random.Random(3))
    index = decontaminate.Index([(i, decontaminate.normal(t)) for i, t in enumerate(items)], 0.8, 0.95, 0.3, 2)
    texts = [decontaminate.normal(t) for t in texts]
    assert sum(len(index.windows(t + b"\n", np.array([0]))[0]) > 0 for t in texts) >= 6
    assert all(index.leaks([t]) == {} for t in texts) and index.leaks(texts) == {}


@pytest.mark.parametrize("parts", [1, 5, 40])
def test_leaks_do_not_depend_on_partitions(spark, parts):
    items, texts = refused(random.Random(3))
    rows = list(enumerate(texts + ["by the way " + items[4] + " and so on", items[7].upper()]))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()} == {(16, 4), (17, 7)}
    assert {r.doc_id for r in decontaminate.keep_clean(docs, bench).collect()} == set(range(16))


@pytest.mark.parametrize("parts", [1, 16, 200])
def test_leaks_of_the_small_corpus_in_any_partitions(spark, parts):
    where = "/root/testdata/sf0.01"
    docs, bench = spark.read.parquet(f"{where}/documents.parquet"), spark.read.parquet(f"{where}/benchmark.parquet")
    found = decontaminate.contaminated(docs.repartition(parts), bench).collect()
    assert LEAKS.setdefault("rows", sorted(map(tuple, found))) == sorted(map(tuple, found)) and found


LEAKS: dict[str, list] = {}


# 11 BPE with word ends


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(words_path())


@pytest.fixture(scope="module")
def word_coder():
    return word_bpe.Coder(word_bpe.read_tokenizer(words_path()))


def as_library(library, coder, text):
    ids = library.encode(text, add_special_tokens=False).ids
    return np.frombuffer(coder.encode(text), "<u4").tolist() == ids and coder.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_word_bpe_equals_the_library_and_decodes(spark, docs, empty, library):
    content = word_bpe.read_tokenizer(words_path())
    rows = texts() + ["<|startoftext|>a<|endoftext|><|endoftext|", "ΣΑΣ İI ﬁ A\u030a \x1c\x85\u3000 We'LL ''sam", "\u105c0 \U000105c0x \U00010d50"]
    got = {r.doc_id: r for r in word_bpe.encode(documents(spark, list(enumerate(rows))), content, tuple(word_bpe.FIELDS)).collect()}
    for k, t in enumerate(rows):
        ids = library.encode(t or "", add_special_tokens=False).ids
        said = library.decode(ids, skip_special_tokens=False)
        assert got[k].ids == ids and got[k].n_tokens == len(ids) and got[k].decoded == said
        assert got[k].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest() and got[k].decoded_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert word_bpe.encode(docs, content).count() == docs.count() and word_bpe.encode(empty, content).count() == 0
    tokens = word_bpe.encode(docs, content, ("ids", "decoded"))
    assert [r.decoded for r in word_bpe.decode_ids(tokens, content).collect()] == [r.decoded for r in tokens.collect()]
    assert word_bpe.decode_ids(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>"), content).first().decoded == ""


def test_every_character_is_encoded_as_the_library_does(library, word_coder):
    signs = [f"a{chr(c)}b1{chr(c)} " for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    assert [lo for lo in range(0, len(signs), 500) if not as_library(library, word_coder, "".join(signs[lo : lo + 500]))] == []


def test_random_texts_are_encoded_as_the_library_does(library, word_coder):
    draw = random.Random(1)
    signs = [*"abcAΣσs'tTréÉé \n\t\x1c\x85\u3000 123!!-日本한가İ", "<|startoftext|>", "<|endoftext|>", "'ll", "'re", "ing", "tion"]
    assert all(as_library(library, word_coder, "".join(draw.choices(signs, k=draw.randint(0, 40)))) for _ in range(3000))


def test_long_pre_tokens_and_small_caches(library):
    coder = word_bpe.Coder(word_bpe.read_tokenizer(words_path()), most=2_000)
    for t in ("ab" * 40_000, "x" * 30_001, " ".join(f"word{k}" for k in [*range(200), *range(200)])):
        assert as_library(library, coder, t)
    assert coder.held <= 2_500 and len(coder.old) <= 20
    coder.clear()
    assert not coder and not coder.old


def test_op11_query(spark, library):
    rows = {r.doc_id: r for r in QUERIES["op11_word_bpe"](spark, "/root/testdata/sf0.001").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    assert len(rows) == len(docs)
    for r in docs:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert (rows[r.doc_id].n_tokens, rows[r.doc_id].ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())


# 12 importance resampling


def plain_features(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    return len(words), [zlib.crc32(f.encode()) % 10_000 for f in [*words, *map(" ".join, zip(words, words[1:]))]]


def plain_resample(rows, target):
    """doc_id -> (n_features, weight, score, rank), where ids are unique."""
    import math

    found = {i: plain_features(t) for i, t in rows}
    s, t = collections.Counter(), collections.Counter()
    for _, f in found.values():
        s.update(f)
    for x in target:
        t.update(plain_features(x)[1])
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + 10_000) / ((s[b] + 1) * (t.total() + 10_000)))) for b in range(10_000)]
    out = {}
    for i, (n, f) in found.items():
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out[i] = (n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))))
    able = sorted((-score, i is None, i or 0, i) for i, (n, _, _, score) in out.items() if n >= 20)
    ranks = {i: k + 1 for k, (*_, i) in enumerate(able[: 25 * len(able) // 100])}
    return {i: (f, w, score, ranks.get(i)) for i, (n, f, w, score) in out.items()}


@pytest.mark.parametrize("block", [50, 2 << 20])
def test_resampling_equals_a_plain_one(spark, empty, block, monkeypatch):
    monkeypatch.setattr(importance, "BLOCK", block)  # reaches the tasks of a local session's forked workers at least
    draw = random.Random(4)
    word = lambda: draw.choice(["Alpha", "beta", "gamma7", "délta", "été", "x", "日本"]) + draw.choice(["", "s", "-", "!", ". "])
    rows = list(enumerate(texts() + [" ".join(word() for _ in range(draw.randint(0, 60))) for _ in range(120)])) + [(None, "no id " * 30)]
    target = [None, "", "alpha beta gamma7", "Alphas été délta " * 5]
    items = spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id long, text string")
    got = importance.resample(documents(spark, rows), items).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == plain_resample(rows, target) and len(got) == len(rows)
    assert importance.resample(empty, items).collect() == []
    bare = importance.resample(documents(spark, rows), items.limit(0)).collect()
    assert {r.doc_id: tuple(r)[1:] for r in bare} == plain_resample(rows, [])


def test_repeated_rows_share_no_rank(spark):
    rows = [(k % 5, "one two three " * 9) for k in range(40)] + [(None, "one two three " * 9)] * 40
    got = importance.resample(documents(spark, rows), documents(spark, rows)).collect()
    assert len(got) == 80 and sorted(r.rank for r in got if r.rank) == list(range(1, 21))


def test_pieces_of_long_texts_have_the_same_buckets(monkeypatch):
    data = " ".join(f"w{k * k}" for k in range(4_000)).encode()
    monkeypatch.setattr(importance, "BLOCK", 1_000)
    assert sum(importance.words_of(data), []) == data.split() and len(list(importance.words_of(data))) > 20
    (found,) = importance.feature_buckets([data.split()], 10_000)
    assert found.tolist() == plain_features(data.decode())[1]


def test_crc_of_rows():
    rows = np.random.default_rng(0).integers(0, 256, (50, 17), np.uint8)
    assert importance.crc_rows(rows).tolist() == [zlib.crc32(r.tobytes()) for r in rows]


# 13 vector codes


def plain_codes(rows, positions=4, entries=256, rounds=4):
    """(vec_id, label, code, error) of each kept row and the codebooks, by plain loops."""
    import math

    whole = [(i, k, [math.floor(1024 * x) for x in v]) for i, v, k in rows if v is not None and all(x is not None and math.isfinite(x) and abs(x) < 1 << 16 for x in v)]
    first: dict = {}
    for i, _, x in whole:
        first[i] = min(first.get(i, x), x)
    order = sorted(first, key=lambda i: (i is None, i or 0))
    length = len(first[order[0]]) if order else 0
    whole = [r for r in whole if len(r[2]) == length]
    cut = [length * p // positions for p in range(positions + 1)]
    seeds = [first[i] for i in order if len(first[i]) == length][:entries]
    books = [[x[a:z] for x in seeds] for a, z in zip(cut, cut[1:])]
    far = lambda x, c: sum((p - q) ** 2 for p, q in zip(x, c))
    near = lambda x, book: min((far(x, c), e) for e, c in enumerate(book))
    for _ in range(rounds):
        for p, (a, z) in enumerate(zip(cut, cut[1:])):
            of = collections.defaultdict(list)
            for _, _, x in whole:
                of[near(x[a:z], books[p])[1]].append(x[a:z])
            for e, xs in of.items():
                books[p][e] = [sum(c) // len(xs) for c in zip(*xs)]
    out = []
    for i, k, x in whole:
        found = [near(x[a:z], books[p]) for p, (a, z) in enumerate(zip(cut, cut[1:]))]
        out.append((i, k, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found)))
    return out, books


VECTORS = "vec_id long, embedding array<float>, label int, row int, part string, n int"


def vectors(spark, rows):
    return spark.createDataFrame([(*r, 1, "p", 2) for r in rows], VECTORS)


@pytest.mark.parametrize("entries", [5, 256])
def test_codes_equal_plain_lloyd(spark, entries):
    draw = random.Random(2)
    vec = lambda: [float(np.float32(draw.gauss(0, 0.2))) for _ in range(8)]
    rows = [(k, vec(), draw.choice([1, 2, None])) for k in range(150)] + [(200 + k, [0.25] * 8, 7) for k in range(80)]
    rows += [(300, None, 1), (301, [0.5, None, *[0.0] * 6], 1), (302, [float("nan"), *[0.0] * 7], 1), (303, [float("-inf"), *[0.0] * 7], 2), (304, [1e9, *[0.0] * 7], 2)]
    rows += [(305, [0.5] * 4, 2), (306, [], 2), (7, vec(), 3), rows[9], (None, vec(), None), (None, [3e4, *[-3e4] * 7], None)]
    with_scope, books = vector_codes.compress(vectors(spark, rows).repartition(5), entries=entries)
    want, plain = plain_codes(rows, entries=entries)
    got = with_scope.collect()
    assert [b.tolist() for b in books] == plain
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    total = collections.Counter()
    for r in want:
        total[r[1]] += r[3]
    assert {(r.label, r.label_error) for r in vector_codes.with_group_error(with_scope).collect()} == set(total.items())


def test_codes_of_nothing_and_little(spark):
    none, books = vector_codes.compress(vectors(spark, []))
    assert none.collect() == [] and [b.shape for b in books] == [(0, 0)] * 4 and vector_codes.with_group_error(none).collect() == []
    for rows in ([(3, [0.5, 0.25, -0.5], None)], [(1, [], 2), (2, [], 2)], [(None, [0.5] * 5, 1)] * 3):
        got, books = vector_codes.compress(vectors(spark, rows))
        want, plain = plain_codes(rows)
        assert sorted((r.code, r.error) for r in got.collect()) == sorted(r[2:] for r in want) and [b.tolist() for b in books] == plain


def test_only_parts_that_change_move_and_hot_entries_are_salted(spark):
    rows = vectors(spark, [(k, [k / 100] * 4, 1) for k in range(40)] + [(100 + k, [0.05] * 4, 1) for k in range(400)])
    kept, length = vector_codes.whole_vectors(rows.select("vec_id", "embedding"), "embedding", "vec_id")
    books = vector_codes.first_books(kept, "vec_id", length, 4, 8)
    members = vector_codes.enter(kept, books, length)
    new, held = vector_codes.updated(members, books)
    seen = vector_codes.judged(members, new)
    where = {(r.row, r.position): r.entry for r in members.collect()}
    assert all(r.moved == (where[r.row, r.position] != r.entry) for r in seen.collect()) and 0 < seen.where("moved").count() < seen.count() / 4
    assert sum(held.values()) == 440 * 4
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = [len(p) for p in vector_codes.at_owners(members, held).rdd.glom().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(parts) == 440 * 4 and max(parts) < 0.6 * sum(parts)


def test_distances_are_exact():
    rng = np.random.default_rng(3)
    for most in (9, 1 << 25):
        parts, book = rng.integers(-most, most, (300, 16)), rng.integers(-most, most, (40, 16))
        parts[:40], book[20:] = book, book[:20]
        entry, far = vector_codes.nearest(parts, book)
        d = ((parts[:, None, :].astype(object) - book[None]) ** 2).sum(axis=2)
        assert entry.tolist() == d.argmin(axis=1).tolist() and far.tolist() == d.min(axis=1).tolist()
