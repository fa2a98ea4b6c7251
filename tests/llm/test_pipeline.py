"""Each stage of the pipeline, on what its predecessor kept, against brute force."""

import corpus_pipeline
import pytest
from test_texts import brute_components, brute_items, brute_lines, frame, reference_encoder, sha, unlike_rows_of_an_id

from cleanlake.llm import quality

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The rows of each stage, written and read again."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    out.append(docs.collect())
    for i, (_, f) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(i))
        got = f(spark, docs, SF)
        if i < 4:
            assert got.columns == docs.columns and [t for _, t in got.dtypes] == [t for _, t in docs.dtypes]
        got.write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs.collect())
    return out


def test_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_dedup", "decontaminate", "encode"]


def test_quality(spark, stages):
    bad = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 0").collect()}
    kept = {r.doc_id for r in stages[1]}
    assert not kept & bad
    good = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()}
    assert len(good - kept) <= 0.02 * len(good)
    assert set(stages[1]) <= set(stages[0])


def test_lines(stages):
    want = brute_lines([(r.doc_id, r.text) for r in stages[1]])
    assert {r.doc_id: r.text for r in stages[2]} == {k: v[0] for k, v in want.items()}
    assert all(r.n_chars == len(r.text) for r in stages[2])


def test_near_duplicates(stages):
    want = brute_components([(r.doc_id, r.text) for r in stages[2]], 80)
    assert {r.doc_id for r in stages[3]} == {k for k, v in want.items() if v[2]}
    assert set(stages[3]) <= set(stages[2])


def test_decontamination(spark, stages):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = brute_items([(r.doc_id, r.text) for r in stages[3]], items)
    assert {r.doc_id for r in stages[4]} == {k for k, v in want.items() if not v[1]}


def test_encoding(stages):
    own, texts = reference_encoder(), {r.doc_id: r.text for r in stages[4]}
    assert {r.doc_id: r.ids for r in stages[5]} == {k: own.encode_ordinary(t) for k, t in texts.items()}
    assert all(r.decoded_sha256 == sha(texts[r.doc_id]) and r.n_tokens == len(r.ids) for r in stages[5])


def test_repeated_and_empty_rows(spark):
    table = "doc_id long, text string, lang string, source string, n_chars long, extra int"
    rows = [(1, "a b c d e f", "en", "s", 11, 0), (1, "a b c d e f", "en", "s", 11, 0), (2, "A b c d e f", "en", "s", 11, 0), (3, None, None, None, None, 0), (4, "", "en", "s", 0, 0), (None, "a b", "en", "s", 3, 0)]
    for docs in (spark.createDataFrame(rows, table), spark.createDataFrame([], table)):
        for _, f in corpus_pipeline.STAGES[1:]:
            got = f(spark, docs, SF)
            if f is not corpus_pipeline.encoded:
                assert got.columns == docs.columns
            ids = sorted((r.doc_id or 0) for r in got.collect())
            assert ids == ([] if not docs.count() else [0, 1, 3, 4] if f is corpus_pipeline.without_near_duplicates else [0, 1, 1, 2, 3, 4])
    assert quality.apply(spark.createDataFrame(rows, table), None).count() == 6


def test_unlike_rows_of_one_id_both_stay(spark):
    rows = unlike_rows_of_an_id()
    more = [(5, rows[0][1] + " more"), rows[0], (13, ""), (13, " "), (13, "some words")]
    got = corpus_pipeline.without_near_duplicates(spark, frame(spark, rows + more), SF)
    assert sorted((r.doc_id, len((r.text or "").split())) for r in got.collect()) == [(3, 60), (5, 61), (5, 90), (6, 90), (13, 0), (13, 2)]


def test_columns_whose_names_clash(spark):
    names = ["_quality", "_k1", "_k2", "_gone", "_maybe", "text_hash", "group", "n_shingles", "kept", "n_lines", "n_dropped", "n_hit", "items", "rest", "at", "a b"]
    rows = spark.createDataFrame([(1, "some words of a text", *(f"{n} 1" for n in names)), (2, None, *(f"{n} 2" for n in names))], "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    for _, f in corpus_pipeline.STAGES[:4]:
        got = f(spark, rows, SF)
        assert got.columns == rows.columns
        assert all(r[n] == f"{n} {r.doc_id}" for r in got.collect() for n in names)
