import random
import re
from collections import Counter

import numpy as np
from echoframe.llm import quality_rules as q
from echoframe.llm.store import Workspace
from hypothesis import given, settings
from hypothesis import strategies as st

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _brute(text):
    w = WORD.findall(text or "")
    windows = Counter(zip(w, w[1:], w[2:]))
    hit = {k + j for k, g in enumerate(zip(w, w[1:], w[2:])) if windows[g] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit)


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.none(), st.text(alphabet="ab \n\t#<é　", max_size=60)))
def test_base_statistics_by_brute_force(text):
    assert q.statistics(text)[:5] == _brute(text)


def test_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = {r.doc_id: r for r in q.apply_rules(docs).collect()}
    for r in docs.collect():
        want = _brute(r.text)
        got = out[r.doc_id]
        assert (got.n_words, got.word_chars, got.n_symbols, got.n_dup_lines, got.n_repeat_words) == want
        assert got.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (got.base_failed and got.kept)


def test_distances_match_numpy(spark):
    """The concentration steps on one group, against numpy."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 7)) @ rng.normal(size=(7, 7))
    x[:60] += 25
    rows = spark.createDataFrame([("g", v.tolist()) for v in x], "`group` string, x array<double>")
    features = dict(zip(q.FEATURES, [0.01] * 7))
    got = np.array(sorted(r.distance2 for r in q.covariance_distances(rows, Workspace(spark, "t"), features=features).collect()))
    rank = lambda v, share: np.sort(v)[int(np.ceil(share * len(v))) - 1]
    middle = np.array([rank(c, 0.5) for c in x.T])
    spread = np.array([(1.4826 * rank(abs(c - m), 0.5)) ** 2 for c, m in zip(x.T, middle)])
    u = (x - middle) / np.sqrt(spread + 1e-4)
    u /= np.linalg.norm(u, axis=1)[:, None]
    signs = 7 * (u.T @ u) / len(x) * np.sqrt(np.outer(spread, spread))
    signs = (len(x) * signs + 30 * np.diag(spread)) / (len(x) + 30)
    found = []
    for start in (np.diag(spread), signs):
        mean, cov, dets = middle, start + np.eye(7) * 1e-4, []
        while len(dets) < 2 or len(dets) < 20 and dets[-2] - dets[-1] > 1e-3 or len(dets) < 3:
            away = np.einsum("ni,ij,nj->n", x - mean, np.linalg.inv(cov), x - mean)
            inner = x[away <= rank(away, 0.75)]
            mean = inner.mean(0)
            cov = (len(inner) * np.cov(inner.T, bias=True) + 30 * np.diag(spread)) / (len(inner) + 30) + np.eye(7) * 1e-4
            dets.append(np.linalg.slogdet(cov)[1])
        found.append((dets[1], mean, cov))
    _, mean, cov = min(found, key=lambda f: f[0])
    d = np.einsum("ni,ij,nj->n", x - mean, np.linalg.inv(cov), x - mean)
    d = np.sort(d / max(1, rank(d, 0.5) / q.chi_square(7, 0)))
    assert np.allclose(got, d, rtol=1e-6)
    assert (got[-60:] > 100).all() and (got[:-60] < 60).all()


def test_outliers_go_and_ordinary_text_stays(spark):
    rng = random.Random(1)
    words = ["alpha", "beta", "gamma", "delta", "of", "to", "and", "rather", "longer", "wordings"]
    rows = []
    for i in range(900):
        text = " ".join(rng.choice(words) + rng.choice(["", "", ",", "."]) + str(rng.randrange(50)) for _ in range(rng.randint(60, 300)))
        if i % 30 == 0:
            text = text.replace(" ", "## ").upper()
        rows.append((i, text, ["en", None][i % 2], ["a", "b"][i // 2 % 2] if i > 20 else f"tiny{i}"))
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, source string, x int")
    out = {r.doc_id: r.kept for r in q.apply_rules(docs).collect()}
    assert [i for i in out if not out[i] and i % 30] == []
    assert sum(not out[i] for i in out if i % 30 == 0) == 30


def test_small_groups_are_judged(spark):
    """Groups of 50, and pools of smaller ones, by the same method; of fewer rows than features, by the base rules."""
    rng = random.Random(2)
    text = lambda: " ".join(rng.choice(["alpha", "beta", "gamma", "to", "of"]) + str(rng.randrange(90)) for _ in range(rng.randint(60, 300)))
    rows = [(i, text(), "en", f"s{i // 50}") for i in range(150)] + [(200 + i, text(), "de", f"t{i}") for i in range(20)] + [(300 + i, text(), "fr", "u") for i in range(4)]
    odd = [0, 60, 149, 200, 219, 300]
    rows = [(i, t.replace(" ", "## ").upper() if i in odd else t, *r) for i, t, *r in rows]
    got = {r.doc_id: r for r in q.apply_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert {i for i in got if not got[i].kept} == {0, 60, 149, 200, 219}
    assert all((got[i].distance2 is None) == (i >= 300) for i in got)


def test_kept_by_brute_force(spark, sf_dir):
    """The verdict of the whole query on the smallest tables, from plain statistics and numpy."""
    from echoframe.llm.queries import op6_quality_rules

    got = {r.doc_id: r for r in op6_quality_rules(spark, sf_dir).collect()}
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert set(got) == set(docs)
    for i, r in got.items():
        assert r.kept == (not r.base_failed and (r.distance2 is None or r.distance2 <= q.chi_square(7, 4.753)))
        assert r.n_words == len((docs[i].text or "").split())
    assert sum(r.distance2 is not None for r in got.values()) > 150


def test_edges(spark):
    rows = [(1, None, "a", "b"), (2, "", None, None), (3, "w " * 40000, "a", "b"), (3, "w " * 40000, "a", "b"), (None, " ".join(map(str, range(60))), "a", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    out = sorted(((str(r.doc_id), r.base_failed, r.kept) for r in q.apply_rules(docs).collect()))
    assert out == [("1", True, False), ("2", True, False), ("3", True, False), ("3", True, False), ("None", False, True)]
    assert q.apply_rules(docs.limit(0)).count() == 0


def test_labelled_junk_goes_and_clean_text_stays(spark):
    """Texts of words between bars lie nearer than other junk; all labelled junk that passes the base rules is found."""
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "quality", "toxic")
    rows = q.apply_rules(spark.read.parquet(f"{d}/documents.parquet")).filter("not base_failed").join(labels, "doc_id").collect()
    junk = [r.kept for r in rows if r.quality == 0]
    clean = [r.kept for r in rows if r.quality == 1 and r.toxic == 0]
    assert len(junk) > 100 and sum(junk) == 0
    assert len(clean) > 1000 and sum(clean) >= 0.99 * len(clean)
