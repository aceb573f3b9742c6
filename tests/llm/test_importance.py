import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from echoframe.llm import importance as m
from echoframe.llm.store import small_batches


def _corpus(n=400):
    rng = random.Random(2)
    plain = ["w%d" % k for k in range(60)]
    rows, labels = [], []
    for i in range(n):
        kind = i % 5  # 3: junk, 4: toxic
        words = [rng.choice(plain) for _ in range(rng.randint(5, 60))]
        if kind == 3:
            words = [w + "###" for w in words]
        if kind == 4:
            words[rng.randrange(len(words))] = "vile"
            words.append("vile")
        rows.append((i, " ".join(words)))
        if i % 2:
            labels.append((i, int(kind != 3), int(kind == 4)))
    return rows, labels


def test_weights_match_their_definition(spark):
    rows, labels = _corpus(120)
    rows += [(1000, "so so so so so so so so so so"), (1001, "a, b; c!! d"), (1002, "x " * 400)]
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    target = {i for i, q, t in labels if q and not t}
    got = {r.doc_id: r for r in m.resample(docs.repartition(4), marks).collect()}
    tokens = {i: re.findall(r"\w+|[^\w\s]+", t.lower()) for i, t in rows}

    def pairs(t):
        out, run = [], 0
        for a, b in zip(t, t[1:], strict=False):
            run = run + 1 if a == b else 0
            out.append(("run", min(int(math.log2(run)), 3)) if run else (a, b))
        return out

    grams = {i: [("w", x) for x in t] + [("p", x) for x in pairs(t)] for i, t in tokens.items()}
    raw = Counter(g for v in grams.values() for g in set(v))
    good = Counter(g for i in target for g in set(grams[i]))
    words = sorted((good[g] / n, n) for g, n in raw.items() if g[0] == "w")
    half, share = sum(n for _, n in words) / 2, 0
    for s, n in words:
        share, half = s, half - n
        if half <= 0:
            break
    assert share > 0
    want = dict.fromkeys(grams, 0.0)
    for i, v in grams.items():
        for g in v:
            mean, t = share * (raw[g] - 1), good[g] - (i in target)
            z2 = (t - mean) ** 2 / (mean * (1 - share) + 1)
            want[i] += max(0, 1 - 4 / max(z2, 1e-9)) * math.log((t + 0.5) / (mean + 0.5)) / math.sqrt(max(1, len(tokens[i]) / 100))
    assert any(abs(x) > 0.2 for x in want.values())
    assert all(got[i].log_weight == pytest.approx(x, abs=1e-3) for i, x in want.items())


def test_the_draw_follows_the_weights(spark):
    """At the query's parameters: with log weight 0 and -2, by seeds, rows are drawn as Gumbel top-k does."""
    rows, labels = _corpus(300)
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    one = {r.doc_id: r for r in m.resample(docs, marks).collect()}
    half = {r.doc_id: r for r in m.resample(docs, marks, k=150, seed=18).collect()}
    assert all(one[i].log_weight == half[i].log_weight for i in one)
    assert all(r.key == pytest.approx(r.log_weight + m.gumbel(np.array([r.doc_id]), 17)[0]) for r in one.values())
    ids = np.array(sorted(one))
    weight = np.array([one[i].log_weight for i in ids])
    draws = [weight + m.gumbel(ids, s) for s in range(200)]
    assert sum(one[i].selected != (half[i].key >= min(r.key for r in one.values() if r.selected)) for i in one) >= 3
    drawn = {r.doc_id for r in half.values() if r.selected}
    assert drawn == set(ids[np.argsort(-(weight + m.gumbel(ids, 18)))[:150]].tolist())
    often = np.mean([d >= np.sort(d)[-150] for d in draws], 0)
    assert often[weight > -0.5].mean() > often[weight < -2].mean() + 0.3


@pytest.mark.parametrize(("sf", "most"), [("sf0.01", 0.3), ("sf0.1", 0.1)])
def test_toxic_text_goes_at_every_size(spark, sf, most):
    docs, labels = (spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = m.resample(docs, labels).join(labels, "doc_id").filter("toxic = 1 and quality = 1").select("selected").collect()
    assert np.mean([r.selected for r in got]) < most


def test_good_text_stays_and_junk_and_toxic_text_goes(spark):
    rows, labels = _corpus()
    out = m.resample(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    kept = {r.doc_id for r in out if r.selected}
    good = [i for i, _ in rows if i % 5 < 3]
    assert sum(i in kept for i in good) >= 0.97 * len(good)
    assert sum(i in kept for i, _ in rows if i % 5 >= 3) <= 0.15 * (len(rows) - len(good))


def test_tables(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    rates = {(r.quality, r.toxic): r.rate for r in m.resample(docs, labels).join(labels, "doc_id").selectExpr("quality", "toxic", "cast(selected as int) s").groupBy("quality", "toxic").avg("s").withColumnRenamed("avg(s)", "rate").collect()}
    assert rates[1, 0] > 0.98 and rates[0, 0] < 0.1 and rates[1, 1] < 0.1 and rates[0, 1] < 0.1


def test_gumbel_top_k_draws_in_proportion_to_weights():
    n, ids = 20000, np.arange(3)
    first = np.zeros(3)
    w = np.log([1.0, 2.0, 7.0])
    for seed in range(n):
        first[np.argmax(w + m.gumbel(ids, seed))] += 1
    assert np.allclose(first / n, [0.1, 0.2, 0.7], atol=0.02)


def test_exact_k_and_defined_edges(spark):
    rows = [(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "a b")]
    docs = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, key int")
    labels = spark.createDataFrame([(3, 1, 0), (3, 1, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    out = m.resample(docs, labels).collect()
    assert len(out) == 5 and all(r.log_weight == 0 for r in out if r.doc_id in (1, 2))
    assert all(r.selected for r in m.resample(docs, labels.limit(0)).collect())
    assert m.resample(docs.limit(0), labels).count() == 0
    assert m.keep_selected(docs, labels.limit(0)).columns == ["doc_id", "text", "key"]
    many = spark.createDataFrame([(float(x % 97) + x * 1e-12,) for x in range(1000)], "key double")
    values = sorted((r.key for r in many.collect()), reverse=True)
    assert all(m.kth_key(many, k) == values[k - 1] for k in (1, 5, 500, 1000))
    with pytest.raises(ValueError):
        m.kth_key(many, 0)


def test_kept_rows_are_weighed_once_and_in_small_batches(spark, monkeypatch):
    """The rows of resample(), whatever their columns; what is returned sends no text to Python again."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    rows, labels = _corpus()
    docs = spark.createDataFrame([(*r, 1, 2.0, "x") for r in rows], "doc_id long, text string, row int, key double, `a.b` string")
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    before, inside = spark.conf.get(name), []
    weighed = m.Resampler.weighed
    monkeypatch.setattr(m.Resampler, "weighed", lambda *a: inside.append(spark.conf.get(name)) or weighed(*a))
    out = m.keep_selected(docs, labels)
    assert inside == ["1000"] and spark.conf.get(name) == before
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.schema == docs.schema
    want = {r.doc_id for r in m.resample(docs, labels).collect() if r.selected}
    assert sorted(out.collect()) == sorted(r for r in docs.collect() if r.doc_id in want) and 0 < len(want) < len(rows)


def test_small_batches(spark):
    def sizes(tables):
        for t in tables:
            yield pa.RecordBatch.from_pydict({"id": [t.num_rows]})

    with small_batches(spark):
        assert max(r.id for r in spark.range(0, 4500, 1, 1).mapInArrow(sizes, "id long").collect()) == 1000
    assert max(r.id for r in spark.range(0, 4500, 1, 1).mapInArrow(sizes, "id long").collect()) == 4500
