import zlib

import numpy as np
import pytest
from echoframe.llm import language_id as m
from pyspark.sql import functions as F

EN = "the quick brown fox jumps over the lazy dog and then the story goes on with some other words "
DE = "der schnelle braune fuchs springt über den faulen hund und dann geht die geschichte weiter "
FR = "le rapide renard brun saute par dessus le chien paresseux et puis l'histoire continue avec "


@pytest.fixture(scope="module")
def training(spark):
    return spark.createDataFrame([(t * 3, x) for t, x in ((EN, "en"), (DE, "de"), (FR, "fr"))] + [(None, "en"), ("zzz", None)], "text string, lang string")


def test_mixtures_and_edges(spark, training):
    rows = [(1, EN), (2, DE), (3, EN * 2 + FR), (4, None), (5, ""), (6, "123 !?\n"), (7, "é"), (8, "fox " * 60000), (1, EN), (None, FR)]
    docs = spark.createDataFrame([(*r, "xx", 9) for r in rows], "doc_id long, text string, lang string, score int")
    got = {}
    for r in m.identify_languages(docs, training).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert [x.lang_pred for k in (1, 2, 3) for x in got[k]] == ["en", "en", "de", "en"]
    assert got[3][0].langs == ["en", "fr"] and got[3][0].proportions[0] == pytest.approx(2 / 3, abs=0.08)
    assert got[1][0].langs == ["en"]
    assert all(got[k][0].lang_pred == "und" and got[k][0].score == 0 for k in (4, 5, 6))
    assert got[None][0].lang_pred == "fr" and got[8][0].lang_pred == "en"
    assert all(0 <= x.score <= 1 for v in got.values() for x in v)


def test_em_finds_the_best_proportion():
    rng = np.random.default_rng(1)
    model = m.Mixture(["a", "b"], rng.integers(1, 100, (2, 64)).astype(float))
    n = rng.integers(1, 20, 64).astype(float)
    w, best = model.proportions(model.likelihood, n, rounds=2000)
    grid = max(float(n @ np.log(model.likelihood @ np.array([x, 1 - x]))) for x in np.linspace(0, 1, 2001))
    assert best == pytest.approx(grid, abs=1e-2) and w.sum() == pytest.approx(1)


def test_trigrams_by_brute_force():
    text = "  Ab-c\td"
    want = [(0, "a", "b"), ("a", "b", 0), (0, "c", 0), (0, "d", 0)]
    code = lambda x: ord(x) if x else 0
    keys = np.array([code(a) | code(b) << 21 | code(c) << 42 for a, b, c in want], np.uint64)
    assert m.trigrams(text, 15).tolist() == (m.mix(keys) >> np.uint64(49)).astype(int).tolist()


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    got = m.identify_languages(docs.filter(held), docs.filter(~held)).join(docs, "doc_id").select((F.col("lang") == F.col("lang_pred")).cast("int").alias("right")).agg(F.avg("right")).first()[0]
    assert got > 0.97
    assert zlib.crc32(b"7") % 3 == spark.range(1).select(F.crc32(F.lit("7")) % 3).first()[0]


def test_nothing_learned_and_empty_tables(spark, training):
    docs = spark.createDataFrame([(1, EN)], "doc_id long, text string")
    assert m.identify_languages(docs, training.limit(0)).first().lang_pred == "und"
    assert m.identify_languages(docs.limit(0), training).count() == 0


def test_ten_languages_in_one_text(spark):
    """No cap on languages: a text of ten in equal shares names ten."""
    rng = np.random.default_rng(4)
    letters = "abcdefghijklmnopqrstuvwxyzαβγδεζηθικλμνξοπρστυφχψω"
    speak = lambda k, n: " ".join("".join(rng.choice(list(letters[5 * k : 5 * k + 5]), 5)) for _ in range(n))
    training = spark.createDataFrame([(speak(k, 300), f"l{k}") for k in range(10)], "text string, lang string")
    text = " ".join(speak(k, 60) for k in range(10))
    got = m.identify_languages(spark.createDataFrame([(1, text)], "doc_id long, text string"), training).first()
    assert sorted(got.langs) == [f"l{k}" for k in range(10)] and sum(got.proportions) == pytest.approx(1)


def test_whole_query_by_brute_force(spark, sf_dir):
    """The model, the mixtures and the choice of languages with dictionaries and plain loops."""
    import math
    from collections import Counter
    from itertools import pairwise

    from echoframe.llm.queries import op10_language_id

    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()][:90]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")

    def grams(text):
        out = Counter()
        padded = [c if c.isalpha() else " " for c in " " + (text or "").lower() + "  "]
        squeezed = [padded[0]] + [b for a, b in pairwise(padded) if a != " " or b != " "]
        for a, b, c in zip(squeezed, squeezed[1:], [*squeezed[2:], " "], strict=False):
            if b != " ":
                key = [ord(x) if x != " " else 0 for x in (a, b, c)]
                out[int(m.mix(np.array([key[0] | key[1] << 21 | key[2] << 42], np.uint64))[0]) >> 49] += 1
        return out

    counts = {}
    for i, text, lang in rows:
        if lang is not None and text is not None and zlib.crc32(str(i).encode()) % 3 != 1:
            counts.setdefault(lang, Counter()).update(grams(text))
    names, total = sorted(counts), {x: sum(c.values()) for x, c in counts.items()}

    def em(cells, some):
        w = dict.fromkeys(some, 1 / len(some))
        p = {(x, g): (counts[x][g] + 0.5) / (total[x] + 0.5 * 32768) for x in some for g in cells}
        for _ in range(25 if len(some) > 1 else 1):
            new = dict.fromkeys(some, 0.0)
            for g, n in cells.items():
                mixed = sum(w[x] * p[x, g] for x in some)
                for x in some:
                    new[x] += w[x] * p[x, g] * n / mixed / sum(cells.values())
            done = max(abs(new[x] - w[x]) for x in some) < 1e-4
            w = new
            if done:
                break
        return w, sum(n * math.log(sum(w[x] * p[x, g] for x in some)) for g, n in cells.items())

    class Frames:
        read = None

    frames = Frames()
    frames.read = Frames()
    frames.read.parquet = lambda path: docs
    got = {r.doc_id: r for r in op10_language_id(frames, "any").collect()}
    assert len(got) == len(rows)
    for i, text, _ in rows:
        cells = grams(text)
        if not cells:
            assert got[i].lang_pred == "und" and got[i].score == 0
            continue
        every, _ = em(cells, names)
        order = sorted(names, key=lambda x: -every[x])
        sets = [em(cells, order[:k]) for k in range(1, len(order) + 1)]
        w, _ = max(sets, key=lambda s: s[1] - 4 * len(s[0]) * math.log(sum(cells.values()) + 1))
        assert got[i].lang_pred == max(w, key=w.get) and got[i].score == pytest.approx(max(w.values()), abs=2e-3)
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1)
