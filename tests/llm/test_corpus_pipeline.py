"""The pipeline's stages on small tables, and registration of the queries."""

from __future__ import annotations

import collections
import os
import re

import pytest

import corpus_pipeline
from plumbline.llm import queries
from test_llm_operators import linked, words


@pytest.fixture(scope="module")
def sf_dir():
    from conftest import TESTDATA
    folder = TESTDATA / "sf0.001"
    if not folder.exists():
        pytest.skip("no test tables")
    return str(folder)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_agrees_with_sql(spark, sf_dir, name):
    from oracle import compare, connect
    assert compare(queries.QUERIES[name](spark, sf_dir), connect(sf_dir), queries.SQL[name]) is None


def test_every_operator_has_a_query():
    assert {int(n[2:].split("_")[0]) for n in queries.QUERIES} == set(range(1, 14))
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "toxicity", "exact_dedup", "jaccard_join", "mixing", "pieces"]


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where("toxic = 1")
    stages = dict(corpus_pipeline.STAGES)
    clean = stages["toxicity"](spark, docs, sf_dir)
    assert clean.columns == docs.columns
    kept = {r.doc_id for r in clean.collect()}
    toxic = {r.doc_id for r in labels.collect()}
    assert len(kept & toxic) <= 0.6 * len(toxic)
    assert len(kept - toxic) >= 0.97 * len({r.doc_id for r in docs.collect()} - toxic)

    one = stages["exact_dedup"](spark, docs, sf_dir)
    assert one.columns == docs.columns
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", "", t or "")
    groups = collections.defaultdict(list)
    for r in docs.collect():
        groups[norm(r.text)].append((-len(r.text or ""), r.doc_id))
    assert {r.doc_id for r in one.collect()} == {min(g)[1] for g in groups.values()}

    near = stages["jaccard_join"](spark, docs, sf_dir)
    assert near.columns == docs.columns
    want = linked([(r.doc_id, r.text) for r in docs.collect()], 5, 80)
    assert {r.doc_id for r in near.collect()} == {i for i, (_, c) in want.items() if c == i}

    mixed = stages["mixing"](spark, docs, sf_dir)
    assert mixed.columns == docs.columns
    size = sum(len(words(r.text)) for r in docs.collect())
    assert abs(sum(len(words(r.text)) for r in mixed.collect()) / size - 1.5) < 0.1


def test_run_writes_every_stage(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    (path,) = {os.path.dirname(f.removeprefix("file:")) for f in out.inputFiles()}
    assert os.listdir(os.path.dirname(path)) == ["4-pieces"]
    assert out.columns == ["doc_id", "n_tokens", "n_fallback", "ids", "ids_sha256", "round_trip"]
    assert out.where("not round_trip").count() == 0 and out.count() > 0
