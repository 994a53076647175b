"""The stages on a table with planted cases, each held against its own input."""

from collections import Counter

import corpus_pipeline
import pytest
from helpers import no_docs, odd_docs, words

from rollcall.llm.common import table

DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs = table(spark, DIR, "documents")
    near = docs.where("length(text) between 1500 and 4000").orderBy("doc_id").limit(5)
    planted = near.selectExpr("doc_id + 100000 AS doc_id", "concat(text, ' closing remark') AS text", "lang", "source", "n_chars")
    docs = docs.unionByName(planted)
    out, folder = [("documents", docs)], tmp_path_factory.mktemp("stages")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, DIR).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        out.append((name, docs))
    return dict(out)


def ids(df):
    return {r.doc_id for r in df.select("doc_id").collect()}


def test_stages(spark, stages):
    columns = stages["documents"].columns
    assert all(stages[n].columns == columns for n in ("quality", "toxicity", "near_duplicates", "mixing"))
    truth = {r.doc_id: r for r in table(spark, DIR, "labels").collect()}
    good = ids(stages["quality"])
    assert sum(i in good for i, r in truth.items() if r.quality == 0) <= 2 and all(i in good for i, r in truth.items() if r.quality == 1)
    calm = ids(stages["toxicity"])
    clean = [i for i, r in truth.items() if i in good and r.toxic == 0]
    assert sum(i in calm for i in clean) >= len(clean) - 2
    kept, before = stages["near_duplicates"], stages["toxicity"]
    texts = [r.text for r in kept.collect()]
    assert len(texts) == len(set(texts)) and ids(kept) <= ids(before)
    assert not any(i >= 100000 and i - 100000 in ids(before) for i in ids(kept))
    mixed = Counter()
    for r in stages["mixing"].collect():
        mixed[r.doc_id] += len(words(r.text))
    size = {r.doc_id: len(words(r.text)) for r in kept.collect()}
    assert all(n <= 2 * size[i] for i, n in mixed.items()) and abs(sum(mixed.values()) - 1.5 * sum(size.values())) < 20
    assert stages["encoding"].count() == stages["mixing"].count()


def test_odd_tables(spark):
    clashing = odd_docs(spark).selectExpr("*", "1 AS `__key`", "2 AS `a.b`", "3 AS `__mix_size`", "4 AS c0", "5 AS held_out")
    for docs in (odd_docs(spark), no_docs(spark), clashing):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, DIR)
            assert name == "encoding" or out.columns == docs.columns
            rows = out.collect()
            assert all(tuple(r)[-5:] == (1, 2, 3, 4, 5) for r in rows) or docs is not clashing or name == "encoding"
