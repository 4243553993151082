"""Page text of papers made from a table of documents: the same in every SQL dialect.

Defined results: a null text is an empty line of its page; repeated documents are papers of one
id; an empty table gives no pages; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_HEAD = "CASE WHEN doc_id % 13 = 0 THEN '' ELSE '{0}' END"
TITLE = (
    "CASE WHEN doc_id % 17 = 3 THEN concat('Study ', doc_id) "
    "WHEN doc_id % 9 = 5 THEN concat('Study ', doc_id, ' of Learned Sequence Models in Long and Careful Settings') "
    "ELSE concat('Study ', doc_id, ' of Learned Sequence Models') END"
)
PAGE_1 = ", ".join(
    [
        f"{TITLE}",
        "CASE doc_id % 8 WHEN 0 THEN 'Alice Researcher, Bob Scientist' WHEN 1 THEN 'Institute of Text and Speech' "
        "WHEN 2 THEN 'Alice Researcher and Bob Scientist' WHEN 3 THEN 'Carol Ng; Dan Roe, Eve Poe' WHEN 4 THEN 'Author 1, Author 2' "
        "WHEN 5 THEN '" + ", ".join(f"Ann {c}x" for c in "ABCDEFGHIJKLMNOPQRSTUVW") + "' "
        "WHEN 6 THEN 'Journal of Things, Mary Major' ELSE 'Solo Writer' END",
        "CASE WHEN doc_id % 16 = 1 THEN 'Nora Next and Otto Other' ELSE 'Institute of Text' END",
        "CASE WHEN doc_id % 3 = 0 THEN concat('arXiv: ', 1700 + doc_id % 900, '.12345') WHEN doc_id % 3 = 1 THEN 'Published 2019, revised 2021 10.1234/abc.5' ELSE '' END",
        "''",
        _HEAD.format("Abstract"),
        "concat('We present a transformer for case ', doc_id, '. Our loss is $L_{loss} = λ · L_rec$ evaluated. It holds ≤ 3 terms.')",
        "''",
        _HEAD.format("1. Introduction"),
        "coalesce(text, '')",
    ]
)
PAGE_2 = ", ".join(
    [
        "'and so the page before runs on.'",
        "CASE WHEN doc_id % 13 = 0 THEN '' WHEN doc_id % 7 = 3 THEN '2.1. Methods' ELSE '2. Methodology' END",
        "concat('We use a ', 4 + doc_id % 9, '-layer transformer with ', 2 + doc_id % 7, ' attention heads and hidden size 512.')",
        "CASE WHEN doc_id % 2 = 0 THEN 'We optimize with Adam at learning rate 3e-4, batch size 32, for 100 epochs with dropout 0.1.' ELSE 'We use SGD at learning rate 1e-2.' END",
        "concat('Training uses the ', CASE WHEN doc_id % 4 = 0 THEN 'WMT14' WHEN doc_id % 4 = 1 THEN 'CIFAR-10' WHEN doc_id % 8 = 2 THEN 'Multi-News5' ELSE 'Corpora22' END, ' dataset.')",
        "CASE doc_id % 5 WHEN 0 THEN concat('Experiments run on ', 1 + doc_id % 8, 'xV100 GPUs.') WHEN 1 THEN 'It takes 4 x NVIDIA A100 in all.' "
        "WHEN 2 THEN concat('We train on TPU v', 2 + doc_id % 3, ' x 8 for 12 GPU-hours.') ELSE '' END",
        "''",
        "CASE WHEN doc_id % 13 = 0 THEN '' WHEN doc_id % 11 = 4 THEN 'Results of our evaluation over many tasks are good and steady across all runs' ELSE '3. Results' END",
        "CASE doc_id % 4 WHEN 2 THEN concat('Perplexity of 3 runs goes from ', 30 + doc_id % 9, ' to ', 28 + doc_id % 11, '.25 on PTB test.') "
        "WHEN 3 THEN concat('The final accuracy is ', 80 + doc_id % 15, '.125 over 3 runs on ImageNet, 2 below the best.') "
        "ELSE concat('BLEU score moves from ', 20 + doc_id % 6, '.5 to ', 22 + doc_id % 4, '.5 on ', "
        "CASE WHEN doc_id % 12 = 1 THEN 'WMT-14' ELSE 'WMT14' END, ' newstest.') END",
        "CASE WHEN doc_id % 6 = 2 THEN '' ELSE ' ' END",
        "CASE WHEN doc_id % 6 = 2 THEN concat('An F1 of ', doc_id % 100, '.5 on SQuAD dev is as good. It holds up.') ELSE '' END",
        "''",
        _HEAD.format("4. Discussion"),
        "'Loss weighting stabilizes early training dynamics.'",
        "''",
        _HEAD.format("5. Limitations"),
        "concat('Only English evaluated; long documents untested in setting ', doc_id % 17, '. We drop weak baselines. The model fails on long contexts.')",
        "''",
        _HEAD.format("6. Future Work"),
        "CASE WHEN doc_id % 2 = 0 THEN 'Extend to multilingual benchmarks at scale.' ELSE 'Robust ablation and tuning remain. Tiny one.' END",
        "CASE WHEN doc_id % 5 = 0 THEN 'References' ELSE '' END",
        "CASE WHEN doc_id % 5 = 0 THEN '[1] Some earlier study, 1999.' ELSE '' END",
    ]
)
#: Some papers have a third page, of later years and other identifiers.
PAGE_3 = ", ".join(["'A supplement of 2077 stands at 10.9999/late.7 for all.'", "''", "concat('Corrected in ', 2050 + doc_id % 9, '.')"])
HAS_PAGE_3 = "doc_id % 4 = 2"
NAME = "concat('study', CASE WHEN doc_id % 2 = 0 THEN '-' ELSE '_' END, 1995 + doc_id % 30, '.pdf')"


def page_text(docs: DataFrame) -> DataFrame:
    """paper_id, filename, page_number, text: two or three pages a document."""
    page = lambda n, p: F.struct(F.lit(n).alias("page_number"), F.expr(f"concat_ws(chr(10), {p})").alias("text"))
    pages = F.concat(F.array(page(1, PAGE_1), page(2, PAGE_2)), F.when(F.expr(HAS_PAGE_3), F.array(page(3, PAGE_3))).otherwise(F.array().cast("array<struct<page_number int, text string>>")))
    return docs.select(F.expr("concat('d', doc_id)").alias("paper_id"), F.expr(NAME).alias("filename"), F.explode(pages).alias("p")).select("paper_id", "filename", "p.page_number", "p.text")


#: The same table for another SQL engine over a view named documents.
PAGE_TEXT_SQL = " union all ".join(
    f"select concat('d', doc_id) as paper_id, {NAME} as filename, {n} as page_number, concat_ws(chr(10), {p}) as text from documents{where}"
    for n, p, where in ((1, PAGE_1, ""), (2, PAGE_2, ""), (3, PAGE_3, f" where {HAS_PAGE_3}"))
)
