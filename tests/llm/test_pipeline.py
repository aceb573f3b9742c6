"""Every stage against a plain version over the same rows."""

import __spark_entry__
import corpus_pipeline as c
import numpy as np
import public_tokenizers
import pytest
from echoframe.llm import importance

from .test_decontamination import _brute as contaminated
from .test_jaccard_join import _brute as grouped
from .test_line_dedup import _brute as deduped

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    out = [docs]
    for _, stage in c.STAGES:
        docs = stage(spark, docs, D)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        out.append(docs)
    return [[r.asDict() for r in d.collect()] for d in out]


def test_names_and_columns(spark, steps):
    assert [s[0] for s in c.STAGES] == ["quality", "lines", "near_duplicates", "benchmark", "packing"]
    assert __spark_entry__.queries()["pipeline"] is c.run
    for rows in steps[:-1]:
        assert list(rows[0]) == ["doc_id", "text", "lang", "source", "n_chars"]


def test_quality_keeps_whole_rows(steps, spark):
    docs, labels = spark.read.parquet(f"{D}/documents.parquet"), spark.read.parquet(f"{D}/labels.parquet")
    want = {r.doc_id for r in importance.resample(docs, labels).collect() if r.selected}
    assert {r["doc_id"] for r in steps[1]} == want
    source = {r["doc_id"]: r for r in steps[0]}
    assert all(source[r["doc_id"]] == r for r in steps[1])


def test_lines(steps):
    want = {i: t for i, t, *_ in deduped([(r["doc_id"], r["text"]) for r in steps[1]])}
    assert {r["doc_id"]: r["text"] for r in steps[2]} == want
    assert all(r["n_chars"] == len(r["text"]) for r in steps[2])


def test_near_duplicates(steps):
    want = {i for i, _, least in grouped([(r["doc_id"], r["text"]) for r in steps[2]]) if i == least}
    assert {r["doc_id"] for r in steps[3]} == want and len(steps[3]) == len(want)


def test_benchmark(steps, spark):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{D}/benchmark.parquet").collect()]
    want = {r[0] for r in contaminated([(r["doc_id"], r["text"]) for r in steps[3]], items) if not r[5]}
    assert {r["doc_id"] for r in steps[4]} == want


def test_packing(steps):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {r["doc_id"]: len(t.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in steps[4]}
    got = {}
    for r in steps[5]:
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
    assert got == want
    sequences = len({r["sequence_id"] for r in steps[5]})
    assert sequences <= int(np.ceil(sum(want.values()) / 2048)) + 2


def test_run(spark, steps):
    key = lambda r: (r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])
    assert sorted(key(r.asDict()) for r in c.run(spark, D).collect()) == sorted(map(key, steps[5]))


def test_nulls_repeats_long_texts_and_an_empty_table(spark, tmp_path):
    """Every stage over odd rows: it ends, keeps the columns, and repeats and nulls fare as stated."""
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{D}/{t}.parquet").write.parquet(str(tmp_path / f"{t}.parquet"))
    schema = spark.read.parquet(f"{D}/documents.parquet").schema
    odd = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "a b c", "en", "s", 5), (3, "a b c", "en", "s", 5), (None, "x y z", "en", None, 5), (4, "word " * 60_000, "en", "s", 300_000)]
    docs = spark.createDataFrame(odd, schema)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert set(c.quality(spark, docs, str(tmp_path)).columns) == set(schema.names)
    for _, stage in c.STAGES[1:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == schema.names
    ids = [r.doc_id for r in docs.collect()]
    assert sorted(ids, key=str) == [1, 2, 3, 4, None]
    for _, stage in c.STAGES:
        assert stage(spark, spark.createDataFrame([], schema), str(tmp_path)).count() == 0
