import re
from collections import defaultdict

import corpus_pipeline
import pytest
import test_jaccard_join as jaccard
import test_line_spread as spread
import test_pii_bootstrap as pii

from tessera.llm import quality_pu

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    at, docs, out = tmp_path_factory.mktemp("steps"), spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(at / name))
        out.append((docs, docs := spark.read.parquet(str(at / name))))
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_stages(steps, spark):
    assert all(after.columns == COLUMNS for _, after in steps[:-1])
    before, after = (texts(x) for x in steps[0])
    good = {r.doc_id for r in quality_pu.score(steps[0][0], spark.read.parquet(f"{SF}/labels.parquet")).collect() if r.predicted}
    assert after == {i: t for i, t in before.items() if i in good} and 0 < len(after) < len(before)

    rows = [(r.doc_id, r.text, r.source) for r in steps[1][0].collect()]
    assert sorted(texts(steps[1][1]).items()) == sorted((i, t) for i, t, *_ in spread.brute(rows, 10)[0])
    assert all(r.n_chars == len(r.text) for r in steps[1][1].collect())

    before, after = (texts(x) for x in steps[2])
    assert set(after) == {i for i, _, c in jaccard.brute(list(before.items())) if i == c}

    before, after = (texts(x) for x in steps[3])
    for i, text in before.items():
        for x in pii.base(text):
            kind, s, e = x.split(":")
            assert f"<{kind}>" in after[i] or re.search("<(email|ip|card|phone)>", after[i])
        assert not pii.base(after[i])

    pieces = defaultdict(int)
    whole = {}
    for p in steps[4][1].collect():
        pieces[p.doc_id] += p.length
        whole[p.doc_id] = p.doc_tokens
    assert dict(pieces) == whole and set(whole) == set(texts(steps[4][0]))


def test_run(spark, steps):
    assert corpus_pipeline.run(spark, SF).count() > 0


def odd_documents(spark):
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    rows += [(9_000_001, None, None, None, None), (9_000_002, "", "en", "s", 0), (None, "some words of a text without an id", "en", "s", 1), (9_000_003, "long " * 40_000, "en", "s", 1)]
    rows += [(9_000_004, "twice the same", "en", "s", 1)] * 2 + [(9_000_004, "twice another text", "en", "s", 1), (None, None, None, None, None)]
    more = ["gone", "hits", "added", "base", "every", "digest", "doc", "stripped", "line", "name", "first"]
    return spark.createDataFrame([(*r, *range(len(more))) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} int" for c in more))


def test_stages_on_odd_rows_and_clashing_columns(spark, tmp_path):
    docs = odd_documents(spark)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if name != "packing":
            assert out.columns == docs.columns, name
        assert stage(spark, docs.limit(0), SF).count() == 0, name
        out.write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        if name in ("line_dedup", "pii"):
            assert docs.count() == before.count()
    ids = {r.doc_id for r in docs.collect()}
    assert {9_000_004} & ids and docs.where("doc_id is null").count() > 0
