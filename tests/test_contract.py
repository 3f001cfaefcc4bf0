import __spark_entry__ as entry


def test_entry_and_names(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_streaming_histogram(spark, tmp_path):
    from tessera.streaming.histogram import live_histogram, source

    df = spark.createDataFrame([(0.05, 1), (0.95, 1), (1.0, 1), (0.95, -1)], "confidence double, weight int")
    df.write.parquet(str(tmp_path / "in"))
    q = live_histogram(source(spark, str(tmp_path / "in"), df.schema)).writeStream.outputMode("complete").format("memory").queryName("bins").start()
    try:
        q.processAllAvailable()
        assert {(r.bin, r.n) for r in spark.table("bins").collect()} == {(0, 1), (9, 1)}
    finally:
        q.stop()


def test_hub():
    from tessera.streaming.hub import Hub

    hub = Hub(size=3)
    _, q = hub.subscribe("g", backlog=1)
    for i in range(5):
        hub.publish("g", "candidate", i)
        hub.publish("g", "histogram", i)
    frames, _ = hub.subscribe("g")
    assert len(frames) == 3 and frames[-1] == ("candidate", 4) and q.qsize() == 1
    assert hub.subscribe("h")[0] == []


def test_extraction_goes_on_while_confidence_rises():
    from tessera.operators.search import extraction, same_source

    found = extraction(["total"], ["regex", "table"], lambda f, m, p: ("7", (p.confidence if p else 0.2) + 0.1) if m == "regex" else None)
    assert [(x.depth, round(x.effect, 6)) for x in found] == [(1, 0.3), (2, 0.1), (3, 0.1), (4, 0.1)]
    assert same_source("a", "a", ["x"], {"x": "col"}) and not same_source("a", "a", ["y"], {"x": "col"})


def test_the_rest_stands_without_the_training_data_operators(tmp_path):
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(os.path.join(root, "tessera"), tmp_path / "tessera", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(root, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 140 and not any(n.startswith('op') for n in q) and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, check=True)


def test_store(spark, tmp_path):
    import pytest

    from tessera.plans.errors import RequestShape
    from tessera.sources.store import Store

    store = Store(spark, f"file://{tmp_path}/objects")
    assert store.keys() == []
    store.put("a/b.csv", b"x,y\n1,2\n")
    assert store.keys() == ["a/b.csv"] and store.get("a/b.csv") == b"x,y\n1,2\n"
    with pytest.raises(RequestShape):
        store.get("a/b.csv", most=3)
    store.wipe()
    assert store.keys() == []
