"""The corpus pipeline, stage by stage, against brute-force versions of each decision."""

import corpus_pipeline
import pytest
from conftest import SF
from ordolith.llm import quality, registry
from ordolith.llm.packing import BYTES_FILE
from test_neardup import brute as same_components
from test_quality import brute as statistics_of
from test_secrets import base
from test_tokens import check_packing


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """The documents, then what each stage returns, written and read again."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        at = str(tmp_path_factory.mktemp("stages") / str(k))
        stage(spark, out[-1], SF).write.parquet(at)
        out.append(spark.read.parquet(at))
    return out


def test_filters_keep_columns_and_rows(steps):
    for df in steps[1:-1]:
        assert df.columns == steps[0].columns and dict(df.dtypes) == dict(steps[0].dtypes)
    n = [df.count() for df in steps[:-1]]
    assert n[0] >= n[1] >= n[2] >= n[3] == n[4] > 0


def test_quality_stage(spark, steps):
    kept = {r.doc_id for r in steps[1].collect()}
    verdict = {r.doc_id: r.kept for r in quality.quality_verdicts(steps[0], spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    rows = steps[0].collect()
    assert kept == {r.doc_id for r in rows if verdict[r.doc_id]}
    assert not any(statistics_of(r.text)[-1] for r in rows if r.doc_id in kept)


def test_near_duplicate_stage(steps):
    docs = [(r.doc_id, r.text) for r in steps[1].collect()]
    assert sorted(r.doc_id for r in steps[2].collect()) == [i for i, *_, kept in same_components(docs, 80) if kept]


def test_secrets_stage(steps):
    before, after = ({r.doc_id: r for r in df.collect()} for df in steps[3:5])
    for i, r in after.items():
        assert r.n_chars == len(r.text)
        if not base(before[i].text) and "<SECRET>" not in r.text:
            assert r.text == before[i].text
        for start, _, end, kind in base(before[i].text):
            assert kind == "hex" or before[i].text[start:end] not in r.text


def test_packing_stage_and_run(spark, steps):
    rows = steps[5].collect()
    check_packing([(r.doc_id, r.text) for r in steps[4].collect()], rows, BYTES_FILE)
    again = corpus_pipeline.run(spark, SF).collect()
    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, again)) == sorted(map(key, rows))


def test_every_operator_is_registered():
    names = [*registry.QUERIES]
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 11)]


def test_odd_rows_pass_all_stages(spark, tmp_path):
    """Null and shared ids, nulls, repeated rows, columns with the operators' own names: clean rows stay."""
    clean = [" ".join(f"{w}{i}" for w in ("river", "stone", "cloud", "meadow") for i in range(k, k + 12)) for k in (0, 100, 200, 300)]
    item = "a farmer sold apples to her neighbour and bought seed for the next spring season how much was left"
    rows = [(None, clean[0], 0), (None, "junk", 1), (None, clean[1] + " " + item, 2), (5, clean[2], 3), (5, "no", 4), (5, clean[3], 5), (5, clean[3], 6), (6, clean[3] + " more", 7), (None, None, 8), (7, "", 9)]
    schema = "doc_id bigint, text string, tie int, lang string, n_chars bigint, _base int, node int, hash int"
    docs = spark.createDataFrame([(i, t, k, None, len(t or ""), k, k, k) for i, t, k in rows], schema)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(5, 1), (None, 0)], "doc_id bigint, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item), (None, None)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now, ties = docs, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/stage{k}")
        now = spark.read.parquet(f"{tmp_path}/stage{k}")
        assert now.columns == docs.columns
        ties.append(sorted(r.tie for r in now.collect()))
    assert ties == [[0, 2, 3, 5, 6, 7], [0, 2, 3, 5, 6], [0, 3, 5, 6], [0, 3, 5, 6]]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 4


def test_empty_tables(spark, tmp_path):
    for name, schema in (("documents", "doc_id bigint, text string, lang string, source string, n_chars bigint"), ("labels", "doc_id bigint, quality int, toxic int"), ("benchmark", "item_id bigint, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    for name, query in registry.QUERIES.items():
        if name != "op8_warc":
            assert query(spark, str(tmp_path)).count() == 0, name
