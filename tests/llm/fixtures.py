"""Documents with every awkward case the operators define a result for."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, salt int, fp long, shard int, size long, unit long, bucket long, extra string"


def texts() -> list[str | None]:
    random.seed(5)
    words = ["the", "of", "there", "ration", "and", "wherever", "don't", "été", "straße", "años", "12", "x", "hello", "world"]
    prose = lambda n: " ".join(random.choice(words) + random.choice(["", "", "", ".", ",", "\n"]) for _ in range(n))
    base = prose(120)
    passage = prose(60)
    out = [None, "", " \n\t ", "a", "...", "one two", base, base, base, base.replace("hello", "hullo", 1), prose(30), prose(30) + passage + prose(30), prose(9) + "\n" + passage, passage]
    out += [prose(6000), "ab" * 4000, "Le " * 300, "### $$$ %%% " * 40, "THE!! OF!! AND!! " * 30, "x" * 49, "y" * 50, "y" * 51]
    out += ["'s 'll  x\n\n 'tis don't''s", "日本語のテキスト。 second", "é     z  ", passage + passage, "🎉 ok 🎉"]
    return out


def documents(spark, rows=None):
    if rows is None:
        rows = list(enumerate(texts())) + [(6, texts()[6]), (None, texts()[6]), (None, "no id here at all")]
    langs = ["en", "fr", None]
    full = [(i, t, langs[k % 3], "s", None if t is None else len(t), "k", 1, 2, 3, 4, 5, 6, "e") for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA).repartition(3)
