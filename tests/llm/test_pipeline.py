"""The corpus pipeline, stage by stage, against plain versions of what each stage decides."""

import collections
import hashlib

import pytest

from pyspark.sql import functions as F

from cairn.llm import guess_cost, near_copies

pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs]
    for i, (_, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
        out.append(docs)
    return out


def test_columns(stages):
    assert all(s.columns == pipeline.COLUMNS for s in stages[:-1])


def test_good_documents_stay(spark, sf_dir, stages):
    kept = {r.doc_id for r in stages[1].select("doc_id").collect()}
    good = [r.doc_id for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect() if r.quality == 1]
    bad = [r.doc_id for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect() if r.quality == 0]
    assert sum(g in kept for g in good) >= 0.97 * len(good) and sum(b in kept for b in bad) <= 0.2 * len(bad)


def test_one_of_each_group_stays(spark, stages):
    rows = stages[1].select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").collect()
    groups = near_copies.grouped(spark.createDataFrame(rows, "row bigint, doc_id bigint, text string"), 5, 0.8).groupBy("group").agg(F.min("doc_id").alias("first")).collect()
    assert sorted(r.doc_id for r in stages[2].collect()) == sorted(r["first"] for r in groups)


def test_no_secret_is_left_and_nothing_else_changes(stages):
    before = {r.doc_id: r.text for r in stages[2].collect()}
    for r in stages[3].collect():
        assert not guess_cost.spans(r.text.replace("[secret]", " "))
        assert r.n_chars == len(r.text)
        if not guess_cost.spans(before[r.doc_id]):
            assert r.text == before[r.doc_id]


def test_tokens_decode_to_the_mix(stages):
    texts = collections.Counter((r.doc_id, hashlib.sha256(r.text.encode()).hexdigest()) for r in stages[4].collect())
    assert collections.Counter((r.doc_id, r.decoded_sha256) for r in stages[5].collect()) == texts


def test_run_gives_the_last_stage(spark, sf_dir, stages):
    columns = ["doc_id", "n_tokens", "ids_sha256"]
    run = collections.Counter(map(tuple, pipeline.run(spark, sf_dir).select(*columns).collect()))
    assert run == collections.Counter(map(tuple, stages[5].select(*columns).collect()))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and extra columns with names that stages use themselves."""
    long = " ".join(f"word{i} password=abcdef{i}" for i in range(4000))
    rows = [
        (1, "a b c d e f", "en", "s1", 11), (1, "a b c d e f", "en", "s1", 11), (2, "A b c D e f", "en", "s1", 11), (3, None, None, None, None), (4, "", "en", None, 0), (None, "x y", "en", "s2", 3),
        (None, None, None, None, None), (5, long, "en", "s2", len(long)), (6, " \t\n ", "en", "s3", 4), (7, "\u00e9\u0301 \u4e2d\u6587 token: \"secretvalue1\"", "zh", "s3", 9),
    ]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    clashes = ("KEY", "row", "row_number", "words_taken", "words_all", "size", "taken", "kept", "n_words", "log_weight", "scored_text", "f0", "class", "group", "keep_0", "__uid")
    return df.withColumns({c: F.lit(1) for c in clashes})


@pytest.mark.parametrize("n", range(5))
def test_stages_take_odd_rows(spark, sf_dir, odd, n):
    stage = pipeline.STAGES[n][1]
    rows = collections.Counter(map(tuple, stage(spark, odd, sf_dir).select("doc_id", *(["text"] if n < 4 else ["n_tokens"])).collect()))
    before = collections.Counter(map(tuple, odd.select("doc_id", "text").collect()))
    if n == 0:
        assert set(rows) <= set(before)
    elif n == 1:
        assert sorted((i is None, i or 0) for i, _ in rows.elements()) == [(False, 1), (False, 3), (False, 5), (False, 7), (True, 0)]
    elif n == 2:
        assert sorted((i is None, i or 0) for i, _ in rows.elements()) == sorted((i is None, i or 0) for i, _ in before.elements())
        assert (1, "a b c d e f") in rows and (3, None) in rows and not any("abcdef" in (t or "") for _, t in rows)
    elif n == 3:
        assert all(t and t.strip() for _, t in rows) and set(rows) - set(before) <= {r for r in rows if r[0] in (1, 2, 5, 7, None)}
    else:
        assert sum(rows.values()) == sum(before.values())


@pytest.mark.parametrize("n", range(5))
def test_stages_take_empty_tables(spark, sf_dir, odd, n):
    out = pipeline.STAGES[n][1](spark, odd.limit(0), sf_dir)
    assert out.collect() == [] and (n == 4 or out.columns == pipeline.COLUMNS)


@pytest.mark.parametrize("n", range(4))
def test_stages_take_ids_of_text(spark, sf_dir, odd, n):
    text = odd.withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    assert dict(pipeline.STAGES[n][1](spark, text, sf_dir).dtypes)["doc_id"] == "string"
    pipeline.STAGES[n][1](spark, text, sf_dir).count()


def test_frames_of_several_stages_may_be_held(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = [stage(spark, docs, sf_dir) for _, stage in pipeline.STAGES[:4]]
    assert all(frame.count() > 0 for frame in held)
