import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from echoframe.llm.packing_bins import encoder, fullest, minimum_bin_slack, pack_documents
from hypothesis import given, settings
from hypothesis import strategies as st

VOCABULARY = "byte_bpe_50k.json"


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: t.encode(text, add_special_tokens=False).ids


def test_ids_are_those_of_the_tokenizers_file(reference, spark, sf_dir):
    texts = [r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    texts += ["", " ", "  a  b ", "a \n b", "a\n b", "it's 12 o'clock", " x y  ", "a\t\tb c　d", "<|endoftext|> a", "no  ", "́a b", "'s 's we're"]
    e = encoder(VOCABULARY)
    for text in texts:
        assert np.frombuffer(e(text), "<u4").tolist() == reference(text), text


def test_ids_with_added_tokens(reference):
    rng, e = random.Random(8), encoder(VOCABULARY)
    for _ in range(2000):
        text = "".join(rng.choice(["a", " ", "  ", "b ", "<|endoftext|>", "<|", "\n", "1", "é"]) for _ in range(rng.randrange(9)))
        assert np.frombuffer(e(text), "<u4").tolist() == reference(text), text


def test_same_sequences_every_time(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    one, two = (sorted(map(tuple, pack_documents(docs, keep_ids=False).collect())) for _ in range(2))
    assert one == two


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=" ab's\n\t1. é!", max_size=30))
def test_ids_of_odd_spacing(text):
    e = encoder(VOCABULARY)
    assert e(text) == e.whole(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=9), st.integers(0, 40))
def test_fullest_is_the_best_subset(items, room):
    left = {k: items.count(k) for k in items}
    best = max(s for n in range(len(items) + 1) for c in itertools.combinations(items, n) if (s := sum(c)) <= room)
    got = fullest(left, room)
    assert sum(k * v for k, v in got.items()) == best
    assert all(v <= left[k] for k, v in got.items())


def test_few_bins():
    rng = random.Random(3)
    items = [min(2048, int(rng.lognormvariate(5.5, 1)) + 1) for _ in range(5000)]
    plan = minimum_bin_slack({k: items.count(k) for k in set(items)}, 2048)
    assert sum(n for _, n in plan) <= -(-sum(items) // 2048) + 2
    assert all(sum(k * v for k, v in c) <= 2048 for c, _ in plan)


def test_round_trip(spark, sf_dir, reference):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    odd = spark.createDataFrame([(900001, None, "x"), (900002, "", "x"), (900003, "word " * 9000, "x"), (None, "no id", "x"), (900004, "copy", "x"), (900004, "copy", "x")], docs.schema)
    rows = pack_documents(docs.unionByName(odd), capacity=512).collect()
    texts = {}
    for r in docs.unionByName(odd).collect():
        texts.setdefault(r.doc_id, []).append(r.text or "")
    sequences = {}
    for r in rows:
        assert r.length == len(r.ids) // 4 and r.ids_crc32 == zlib.crc32(r.ids)
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 512
    total = sum(r.length for r in rows)
    assert len(sequences) <= -(-total // 512) + 2
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    assert by_doc.keys() == texts.keys()
    for doc_id, parts in by_doc.items():
        if len(texts[doc_id]) > 1:
            assert len(parts) == 2
            continue
        parts.sort(key=lambda r: r.piece)
        ids = np.frombuffer(b"".join(r.ids for r in parts), "<u4").tolist()
        assert ids == [*reference(texts[doc_id][0]), 0]
        assert [r.piece for r in parts] == list(range(len(parts)))
        assert all(r.length == 512 for r in parts[1:])


def test_empty_table(spark):
    assert pack_documents(spark.createDataFrame([], "doc_id long, text string, ids int, offset int")).count() == 0
