"""The queries that write tables, in a session of a cluster whose checkpoint folder is a path, such as a mount."""

import random
from weakref import WeakKeyDictionary

import pytest

from tempora import session
from tempora.llm.queries import REGISTRY

WORDS = [f"{a}{b}" for a in ("ba", "ke", "lo", "mi", "nu") for b in ("ra", "se", "ti", "vo")]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng, folder = random.Random(3), tmp_path_factory.mktemp("tables")
    text = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    item = " ".join(WORDS) + " " + " ".join(WORDS[::-1])
    docs = [(i, f"{text(30)}\n{text(20)}" + f" {item}" * (i == 7), "en", "s", None) for i in range(60)] + [(60, None, "en", "s", None)]
    rows = {
        "documents": (docs, "doc_id long, text string, lang string, source string, n_chars long"),
        "labels": ([(i, int(i % 2), 0) for i in range(60)], "doc_id long, quality int, toxic int"),
        "benchmark": ([(0, item)], "item_id long, text string"),
        "pages": ([(i, f"http://h/{i}", "x" * 1500 if i % 2 else f"{i}") for i in range(9)], "page_id long, url string, html string"),
        "embeddings": ([(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(45)], "vec_id long, embedding array<float>"),
    }
    for name, (data, schema) in rows.items():
        spark.createDataFrame(data, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.fixture()
def cluster(spark, monkeypatch):
    monkeypatch.setattr(session, "_FOLDERS", WeakKeyDictionary(), raising=False)
    monkeypatch.setattr(spark.sparkContext, "master", "spark://host:7077")
    return spark


@pytest.mark.parametrize("name, key, n", [("op2", "doc_id", 61), ("op5", "doc_id", 61), ("op9", "doc_id", 61), ("op12", "doc_id", 61), ("op11", "page_id", 9),
                                          ("op6", "query_id", 3), ("op13", "vec_id", 45), ("op10", "doc_id", 1), ("op4", "doc_id", None)])
def test_operators_run_on_a_cluster(cluster, tables, name, key, n):
    run = next(f for q, f in REGISTRY.items() if q.startswith(f"{name}_"))
    got = {r[0] for r in run(cluster, tables).select(key).collect()}
    assert got and (n is None or len(got) == n)


def test_pipeline_runs_on_a_cluster(cluster, tables):
    import corpus_pipeline

    assert {r.doc_id for r in corpus_pipeline.run(cluster, tables).select("doc_id").collect()} < set(range(61)) - {7}
