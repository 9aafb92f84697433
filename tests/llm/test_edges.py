"""Nulls, empty and very long texts, ties, repeated rows, empty tables, and extra columns with clashing names."""

import pytest
from pyspark.sql import functions as F

from quarry.llm import ann, bpe, html, langid, licences, media, mixing, quality, simhash, toxicity

WORDS = "the cat sat on a mat and looked at its tail while rain fell over quiet hills"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, f"{WORDS} number {i} " + ("you idiot scum" if i % 3 == 0 else "good day") + (" ### $$$ %%%" * 9 if i % 4 == 0 else ""), "en" if i % 2 else "de", f"s{i % 3}") for i in range(1, 41)]
    rows += [(101, None, "en", "s0"), (102, "", None, None), (103, " \n\t ", "en", "s1"), (104, "word " * 30_000, "de", "s1"), (105, "12 345 !!", "en", "s2"), (None, "no id here", "en", "s2"), (None, None, None, None)]
    rows += [rows[0], rows[0], (106, "x" * 50_000, "en", None), (107, "Ünïcode ‖ 漢字 🙂 text", "de", "s9")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    clashing = ["size", "target", "score", "fp", "node", "chunk", "held_out", "file", "first", "epoch", "ids", "digest", "copy"]
    return d.withColumns({c: F.lit("x") for c in clashing}).cache()


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, int(i % 4 != 0), int(i % 3 == 0)) for i in range(1, 41)] + [(101, None, None), (None, 1, 1), (999, 1, 0), (5, 1, 0), (5, 0, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int").withColumn("text", F.lit("clash"))


PER_ROW = {
    "mixing": lambda d, lab: mixing.taken(d),
    "licences": lambda d, lab: licences.documents_scan(d),
    "bpe": lambda d, lab: bpe.digests(d),
    "langid": lambda d, lab: langid.identify(d),
    "quality": lambda d, lab: quality.classify(d, lab),
    "simhash": lambda d, lab: simhash.classes(d),
    "media": lambda d, lab: media.stored(d),
    "toxicity": lambda d, lab: toxicity.classify(d, lab),
}


@pytest.mark.parametrize("name", PER_ROW)
def test_one_row_per_row(docs, labels, name):
    got = PER_ROW[name](docs, labels).collect()
    assert len(got) == docs.count()
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in got) == sorted((r.doc_id is not None, r.doc_id or 0) for r in docs.select("doc_id").collect())
    same = [tuple(r) for r in got if r.doc_id == 1]
    if name != "mixing":  # copies of a document may be taken differently
        assert len(same) == 3 and len(set(map(str, same))) == 1


@pytest.mark.parametrize("name", PER_ROW)
def test_empty_tables(docs, labels, name):
    assert PER_ROW[name](docs.limit(0), labels.limit(0)).collect() == []


@pytest.mark.parametrize("name", ["quality", "toxicity"])
def test_without_labels(docs, labels, name):
    got = PER_ROW[name](docs, labels.limit(0)).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)


def test_und(docs):
    got = {r.doc_id: r for r in langid.identify(docs).collect()}
    assert [got[i].lang_pred for i in (101, 102, 103, 105)] == ["und"] * 4 and got[101].score == 0


def test_kept_stages_keep_columns(docs, labels):
    for out in (quality.kept(docs, labels), toxicity.kept(docs, labels), simhash.kept(docs), mixing.mixed_documents(docs)):
        assert out.columns == docs.columns
        out.collect()


def test_dedup_keeps_one_row_of_repeats(spark):
    long = " ".join(f"w{i}" for i in range(400))
    rows = [(3, long), (1, long), (1, long), (2, long + " extra"), (7, " ".join(f"v{i}" for i in range(400))), (9, None), (8, "")]
    got = sorted((r.doc_id, r.text) for r in simhash.kept(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert [i for i, _ in got] == [1, 7, 8]


def test_ann_edges(spark):
    rows = [(0, [1.0, 0.0]), (20, [0.0, 1.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, []), (None, [1.0, 1.0]), (2, [1.0, 0.0]), (8, [1.0, 1.0, 1.0])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1)).withColumn("rank", F.lit(1))
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in ann.neighbours(d).collect())
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 20, 0.0), (20, 1, 0, 0.0), (20, 2, 1, 0.0), (20, 3, 2, 0.0)]
    assert ann.neighbours(d.limit(0)).collect() == []


def test_ann_probes_until_there_are_enough_candidates(spark):
    rows = [(i, [float((i * 7 + j * 3) % 11 - 5) + i / 100 for j in range(4)]) for i in range(25)]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.lit(True)).groupBy("query_id").count().collect()
    assert len(got) == 25 and {r["count"] for r in got} == {20}


def test_html_edges(spark):
    page = '<html><body><nav>Menu</nav><article><h1>A&amp;B</h1><p>one <b>two</b>\n three<p>four</article><div class="comments"><p>nice</p></div></body>'
    rows = [(1, "http://a.org/1", page), (2, "http://a.org/2", None), (3, None, ""), (4, "nonsense", "plain text"), (1, "http://a.org/1", page), (5, "http://b.org", "<p" + "x" * 100_000), (None, "http://c.org", "<<<>>><article>ok")]
    d = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1)).withColumn("text", F.lit("x"))
    got = {(r.page_id, r.url): r for r in html.extract(d).collect()}
    assert got[1, "http://a.org/1"].text == "A&B one two three four" and got[1, "http://a.org/1"].n_chars == 22
    assert got[2, "http://a.org/2"].text == "" and got[3, None].text == "" and got[4, "nonsense"].text == "plain text"
    assert len(html.extract(d).collect()) == 7 and html.extract(d.limit(0)).collect() == []


def test_hidden_inline_elements_end_with_their_tag():
    def shown(body):
        return " ".join(t for _, t, out in html.parse(f"<html><body><article>{body}</article></body></html>").blocks if not out)

    assert shown('<p>A <i aria-hidden="true"></i> B</p><p>C</p>') == "A B C"
    assert shown('<p>A<span hidden>x <span>y</span> z</span>B <b>c</b></p><p>D</p>') == "AB c D"
    assert shown('<p>A <span style="display: none">x<div>y</div>z</span> B<p>C') == "A B C"
    assert shown('<p>A <a style="text-decoration:none">b</a>c <span class="visually-hidden">d</span>e</p><p>F <i hidden>x</p><p>G</p>') == "A bc de F G"


def test_bpe_decode_edges(spark):
    d = spark.createDataFrame([(1, [50255]), (2, []), (3, None), (4, [0, 99_999])], "doc_id long, ids array<int>")
    got = {r.doc_id: r.bytes for r in bpe.decode(d).collect()}
    assert got[1] is not None and got[2] == got[3] == b"" and got[4] is None
