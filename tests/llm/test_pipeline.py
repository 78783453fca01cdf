"""Each stage of the pipeline on its own input against a plain version."""

import re
from collections import defaultdict

from oracle import DATA
from pyspark.sql import functions as F
from test_llm_operators import brute_contamination, classes

import corpus_pipeline
from docweave.llm import lattice_pieces
from docweave.operators.tables import written


def plain_lines(documents, min_docs=10):
    def leaf(line):
        t = [x for x in re.split(r"[ \t\r]+", re.sub("[0-9]+", "<*>", line)) if x]
        return " ".join([str(len(t)), *t[:max(-(-len(t) // 2), min(len(t), 6))]]) if t else ""

    texts, keeper = defaultdict(set), {}
    for i, text in documents:
        for here in {leaf(x) for x in text.split("\n")} - {""}:
            texts[here].add(text)
            keeper[here] = min(i, keeper.get(here, i))
    dropped = {k for k in texts if len(texts[k]) >= min_docs}
    return {i: "\n".join(x for x in text.split("\n") if leaf(x) not in dropped or keeper[leaf(x)] == i) for i, text in documents}


def pairs(df):
    return [tuple(r) for r in df.select("doc_id", "text").collect()]


def test_stages(spark):
    folder = f"{DATA}/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = {r.doc_id: r for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id", "text").collect()]
    columns, inputs = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        inputs[name] = docs
        docs = written(stage(spark, docs, folder))
        assert name == "tokenization" or docs.columns == columns
    original, scored, lines, near, clean = (pairs(inputs[n]) for n, _ in corpus_pipeline.STAGES)

    assert set(scored) <= set(original)
    good = [i for i, _ in original if i in labels and labels[i].quality == 1 and labels[i].toxic == 0]
    assert len(set(good) & {i for i, _ in scored}) >= 0.97 * len(good)
    assert dict(lines) == plain_lines(scored)
    label = classes(lines, 5)
    assert sorted(i for i, _ in near) == sorted(i for i, c in label.items() if c == i)
    assert sorted(clean) == sorted((i, t) for (i, t), r in zip(near, brute_contamination(near, items)) if not r[-1])
    assert sorted(r[0] for r in docs.select("doc_id").collect()) == sorted(i for i, _ in clean)
    back = {r[0]: r[1] for r in lattice_pieces.decode(docs).select("doc_id", "decoded").collect()}
    assert back == dict(clean) and docs.filter("not lossless").count() == 0
    assert corpus_pipeline.run(spark, folder).select(F.sum("n_pieces")).first() == docs.select(F.sum("n_pieces")).first()


def test_odd_input(spark, odd):
    folder = f"{DATA}/sf0.001"
    docs = odd
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == odd.columns, name
    assert corpus_pipeline.STAGES[-1][1](spark, written(docs), folder).filter("not lossless").count() == 0
    empty = odd.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, folder).count() == 0
