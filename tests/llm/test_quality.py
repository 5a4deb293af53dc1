import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import quality, queries

SF = "/root/testdata/sf0.1"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdeghilmnorstu") for _ in range(rng.randint(2, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(8)
    docs, labels = [], []
    for i in range(600):
        good = rng.random() < 0.7
        text = words(rng, rng.randint(20, 90)) if good else words(rng, rng.randint(20, 90)).replace(" ", "### ")
        docs.append((i, text, "en", f"h{i % 3}"))
        labels.append((i, int(good), 0))
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark):
    """Labels of a part are kept from the fit; the decisions on it are right, and few good documents go."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    part = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    got = quality.score(docs, labels.where(~part)).join(labels.where(part), "doc_id").select("kept", "quality").toPandas()
    good = got["quality"] == 1
    assert len(got) > 500 and (got["kept"] == good).mean() > 0.99 and got["kept"][good].mean() > 0.99 and got["kept"][~good].mean() < 0.03


def test_sites(docs_of, labelled, spark):
    """A document without evidence follows its site, the more so the more documents the site has."""
    docs, labels = labelled
    rng = random.Random(9)
    bad = [(1000 + i, words(rng, 40).replace(" ", "### "), "xx", "spam") for i in range(300)]
    sparse = [(2000, words(rng, 40).replace(" ", "### "), "xx", "one"), (2001, words(rng, 40), "yy", "two")]
    rows = {r["doc_id"]: r for r in quality.score(docs_of(docs + bad + sparse), labels).collect()}
    assert rows[1000]["path_share"] < 0.1
    # Alone in its site, a document has nothing but the global share for its prior.
    whole = sum(1 / (1 + np.exp(-r["evidence"])) for r in rows.values()) / len(rows)
    assert abs(rows[2000]["path_share"] - rows[2001]["path_share"]) < 1e-9 and abs(rows[2000]["path_share"] - whole) < 0.1
    assert not rows[1000]["kept"] and not rows[2000]["kept"] and rows[2001]["kept"]


def test_shares_by_hand(docs_of, labelled):
    """Posteriors are the formula of the docstring, with each row left out of its own path."""
    docs, labels = labelled
    rows = quality.score(docs_of(docs), labels).toPandas()
    odds = np.exp(rows["evidence"]) * rows["path_share"] / (1 - rows["path_share"])
    assert np.allclose(rows["posterior"], odds / (1 + odds), atol=1e-6)
    assert (rows["kept"] == (rows["posterior"] >= 0.5)).all()


def test_hard_rows(docs_of, corpus, labelled, spark):
    rows = quality.score(docs_of(corpus), labelled[1]).collect()
    assert len(rows) == len(corpus) and all(0 <= r["posterior"] <= 1 for r in rows)
    none = spark.createDataFrame([(None, 1), (1, None)], "doc_id long, quality int")
    rows = quality.score(docs_of(corpus), none).collect()
    assert len(rows) == len(corpus) and all(abs(r["evidence"]) < 1e-6 for r in rows)
    assert quality.score(docs_of([]), labelled[1]).count() == 0
    assert quality.score(docs_of(corpus), none.where("false")).count() == len(corpus)


def test_reruns_agree(spark):
    a, b = ({r["doc_id"]: round(r["posterior"], 9) for r in queries.op1_quality_classifier(spark, "/root/testdata/sf0.01").collect()} for _ in range(2))
    assert a == b and len(a) == 1000


def test_figures_are_of_each_text_alone():
    """A text's figures don't depend on the texts beside it."""
    import pyarrow as pa

    from tessera.llm import texts

    rng = random.Random(1)
    rows = ["", "a", "## A!! b", words(rng, 50), "é ü", "x\nx\nx x x", None, words(rng, 3)]
    (_, _, data, offsets), *rest = texts.blocks(pa.array(rows, pa.string()))
    assert not rest
    together = quality.figures(data, offsets)
    for i, t in enumerate(rows):
        (_, _, data, offsets), *_ = texts.blocks(pa.array([t], pa.string()))
        assert np.allclose(together[i], quality.figures(data, offsets)[0])


def plain_posteriors(rows, share):
    """rows: (host, path, evidence); the docstring's hierarchy, by dictionaries."""
    p = [1 / (1 + np.exp(-(e + np.log(share / (1 - share))))) for *_, e in rows]
    whole, within = np.mean(p), max(np.var(p), 1e-6)
    paths, hosts = {}, {}
    for (h, q, _), x in zip(rows, p, strict=True):
        for table, key in ((paths, (h, q)), (hosts, h)):
            n, good = table.get(key, (0, 0.0))
            table[key] = (n + 1, good + x)

    def strength(groups, parents):
        n = np.array([g[0] for g in groups], float)
        if len(n) < 2:
            return 1e6
        spread = sum(k * (good / k - c) ** 2 for (k, good), c in zip(groups, parents, strict=True))
        between = max((spread - (len(n) - 1) * within) / (n.sum() - (n**2).sum() / n.sum()), 0.0)
        m = np.mean(parents)
        return min(max(m * (1 - m) / max(between, 1e-9) - 1, 1.0), 1e6)

    by_host = strength(list(hosts.values()), [whole] * len(hosts))
    mean = {h: (by_host * whole + good) / (by_host + n) for h, (n, good) in hosts.items()}
    by_path = strength(list(paths.values()), [mean[h] for h, _ in paths])
    out = []
    for (h, q, e), x in zip(rows, p, strict=True):
        n, good = hosts[h]
        rest = (by_host * whole + good - x) / (by_host + n - 1)
        n, good = paths[h, q]
        c = (by_path * rest + good - x) / (by_path + n - 1)
        out.append((rest, c, 1 / (1 + np.exp(-e) * (1 - c) / c)))
    return np.array(out)


def test_against_plain_hierarchy(docs_of, labelled):
    """Shares and posteriors are those of the method, from evidence alone."""
    docs, labels = labelled
    rng = random.Random(4)
    docs = [(i, t, rng.choice(["en", "de", None]), f"h{min(int(rng.expovariate(1)), 5)}") for i, t, *_ in docs]
    share = labels.agg(F.avg("quality")).first()[0]
    got = {r["doc_id"]: r for r in quality.score(docs_of(docs), labels).collect()}
    want = plain_posteriors([(s, lang, got[i]["evidence"]) for i, _, lang, s in docs], share)
    have = np.array([[got[i][c] for c in ("host_share", "path_share", "posterior")] for i, *_ in docs])
    assert np.allclose(have, want, atol=1e-6)


def test_bound_on_what_reaches_the_driver(spark, monkeypatch):
    """However often a labelled doc_id stands, it is one row of the fit."""
    docs = spark.range(3000).selectExpr("id % 3 AS doc_id", "concat('some words ', id) AS text")
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, 1)], "doc_id long, quality int")
    seen = []
    whole = quality.fit
    monkeypatch.setattr(quality, "fit", lambda x, y, *a: seen.append(len(x)) or whole(x, y, *a))
    quality.train(docs, labels, "quality", 2)
    quality.train(docs, labels, "quality", 100)
    assert seen == [2, 3]
