"""Every pipeline stage on its own input, against plain models; queries against their SQL."""

import re
import sys

import duckdb
import pytest

import corpus_pipeline
from launchsift.llm import queries, toxicity

sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])

from check import compare, connect  # noqa: E402

from test_operators import contaminated, near_groups, spans  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Input and output of every stage, by name."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / "out")
        stage(spark, docs, FOLDER).write.parquet(path)
        after = spark.read.parquet(path)
        out[name] = docs, after
        docs = after
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_stages_keep_the_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == list(stages) and len(stages) == 5
    for _, after in list(stages.values())[:-1]:
        assert after.columns == COLUMNS and after.count() > 0


def test_toxic_documents_go(spark, stages):
    before, after = stages["toxicity"]
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    toxic = {r.doc_id for r in toxicity.toxicity(before, labels).filter("toxic").collect()}
    marked = {r.doc_id for r in labels.filter("toxic = 0").collect()}
    assert set(texts(after)) == set(texts(before)) - toxic
    assert len(toxic & marked) <= 0.02 * len(marked)


def test_one_of_each_group_stays(stages):
    before, after = stages["near duplicates"]
    rows = sorted(texts(before).items())
    assert set(texts(after)) == {g for _, _, g in near_groups(rows, 5)}


def test_contaminated_documents_go(spark, stages):
    before, after = stages["decontamination"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    grams = set()
    for _, t in items:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t))
        grams |= {" ".join(w[i : i + 10]) for i in range(max(len(w) - 10, 0) + 1)}
    # The plain model is slow, so documents that hold none of the phrases as text skip it.
    clean = set()
    for i, t in texts(before).items():
        joined = " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t)))
        if not any(g in joined for g in grams) or not contaminated(t, items)[1]:
            clean.add(i)
    assert set(texts(after)) == clean


def test_secrets_are_masked(stages):
    before, after = texts(stages["secrets"][0]), texts(stages["secrets"][1])
    assert set(before) == set(after)
    for i, t in before.items():
        assert (after[i] == t) == (not spans(t))
        assert "[SECRET]" in after[i] or not spans(t)


def test_texts_round_trip(stages):
    before, after = stages["encoding"]
    assert after.filter("round_trip").count() == before.count() == after.count()


def test_run_equals_the_stages(spark, stages):
    got = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, FOLDER).collect()}
    assert got == {r.doc_id: r.ids for r in stages["encoding"][1].collect()}


@pytest.mark.parametrize("name", list(queries.SQL))
def test_query_matches_its_sql(spark, name):
    con = connect(FOLDER)
    assert isinstance(con, duckdb.DuckDBPyConnection)
    assert compare(queries.QUERIES[name](spark, FOLDER).toPandas(), con.execute(queries.SQL[name]).df()) == "ok"
