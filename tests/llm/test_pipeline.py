"""The pipeline: its stages take effect, and rows reach the end."""

import hashlib
import tracemalloc

import corpus_pipeline
import duckdb
import numpy as np
from quarry.llm import common, licences, queries, quality, simhash, toxicity


def test_stages(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = common.settle(stage(spark, docs, sf_dir))
        counts.append(docs.count())
        if name != "bpe":
            assert docs.columns == columns
        if name == "quality":
            own = {r.doc_id for r in quality.classify(before, common.table(spark, sf_dir, "labels")).collect() if r.predicted == 1}
            assert {r.doc_id for r in docs.collect()} == own
        if name == "toxicity":
            own = {r.doc_id for r in toxicity.classify(before, common.table(spark, sf_dir, "labels")).collect() if r.predicted == 0}
            assert {r.doc_id for r in docs.collect()} == own
        if name == "near_dedup":
            ids = [r.doc_id for r in docs.collect()]
            assert len(ids) == len(set(ids))
            texts = [r.text for r in docs.collect()]
            assert len(set(texts)) == len(texts)
        if name == "bpe":
            want = sorted(hashlib.sha256(r.text.encode()).hexdigest() for r in before.collect())
            assert sorted(r.decoded_sha256 for r in docs.collect()) == want
    assert counts[0] > counts[1] > counts[2] >= counts[3] > 0 and counts[5] == counts[4]


def test_components_gather_no_table_in_the_driver(spark):
    links = spark.createDataFrame([(i, i // 3) for i in range(1, 200)] + [(i, 1000) for i in range(1001, 1100)], "u long, v long")
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    got = {r.u: r.v for r in simhash.components(links).collect()}
    assert got == {i: 0 for i in range(1, 200)} | {i: 1000 for i in range(1001, 1100)}
    ran = store.executionsList(int(before), int(store.executionsCount() - before))
    plans = [ran.apply(i).physicalPlanDescription() for i in range(ran.size())]
    assert len(plans) > 3 and not any("BroadcastExchange" in p for p in plans)


def test_quality_fit_holds_one_factor_at_a_time():
    rng = np.random.default_rng(1)
    n, each = 1000, 200
    row, index, value = np.repeat(np.arange(n), each), rng.integers(0, 1 << 10, n * each), rng.random(n * each)
    stats, y = rng.normal(size=(n, quality.N_STATS)), (rng.random(n) < 0.4).astype(float)
    tracemalloc.start()
    quality.fit(stats, row, index, value, y, 0.4, quality.Settings(bits=10, rounds=2))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80 * n * each


def test_licences_equal_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    r = con.execute(licences.documents_sql())
    names = [d[0] for d in r.description]
    want = sorted(map(str, (tuple(dict(zip(names, row))[c] for c in sorted(names)) for row in r.fetchall())))
    got = sorted(map(str, (tuple(row[c] for c in sorted(names)) for row in queries.op2_licences(spark, sf_dir).collect())))
    assert got == want


def test_inheritance(spark):
    rows = [
        ("/a/LICENSE", "/a", True, "MIT"), ("/a/b/c/x", "/a/b/c", False, None), ("/a/b/LICENSE", "/a/b", True, None), ("/a/b/c/d/LICENSE", "/a/b/c/d", True, "ISC"),
        ("/a/b/c/d/y", "/a/b/c/d", False, None), ("/z/q", "/z", False, None), ("/ab/x", "/ab", False, None), ("/a/own", "/a", False, "GPL-3.0"),
    ]
    got = {r.file: (r.licence, r.inherited_from) for r in licences.inherit(spark.createDataFrame(rows, "file string, directory string, is_licence_file boolean, own string")).collect()}
    assert got["/a/b/c/x"] == ("MIT", "/a") and got["/a/b/c/d/y"] == ("ISC", "/a/b/c/d") and got["/z/q"] == (None, None) and got["/ab/x"] == (None, None)
    assert got["/a/own"] == ("GPL-3.0", None) and got["/a/b/LICENSE"] == ("MIT", "/a")


def test_licences_in_wrapped_and_long_lines(spark):
    """A statement wrapped over lines, one within a long line, and one of rare words only."""
    filler = " ".join(f"word{i}" for i in range(200))
    texts = [
        (1, f"# This work is licensed under the GNU\n# General Public License,\n# version 2.\n{filler}"), (2, f"{filler}. Released under the MIT License. {filler}"), (3, "CC0 1.0 Universal, dedicated to the public domain"),
        (4, filler), (5, "This work is licensed under the GNU General Public\nLicense, version 3."), (6, None), (7, ""),
    ]
    files = spark.createDataFrame([(f"f{i}", t) for i, t in texts], "file string, text string")
    got = {r.file: (r.licence, r.line) for r in licences.scan(files).collect()}
    assert got == {"f1": ("GPL-2.0", 1), "f2": ("MIT", 1), "f3": ("CC0-1.0", 1), "f5": ("GPL-3.0", 1)}
    weights = licences._weights(files)
    assert 0 < len(licences.signs(weights, licences.Settings())) < len({t for _, _, t, _ in licences._template_rows()})
