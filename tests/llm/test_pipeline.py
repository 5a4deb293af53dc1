import random
from collections import Counter

import pytest
from test_mixing import check as check_mix
from test_near_copies import likeness, words
from test_packing import check as check_pack
from test_packing import ids_of

import corpus_pipeline
from tessera.llm import scratch

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Good and bad documents, copies of either kind, hard rows; labels for most."""
    rng = random.Random(31)
    docs, labels = [], []
    for i in range(300):
        good = rng.random() < 0.8
        text = " ".join(words(rng, rng.randint(30, 120)))
        docs.append((i, text if good else text.replace(" ", "%%% "), rng.choice(["en", None]), rng.choice(["a", "b", "c", None])))
        labels.append((i, int(good), 0))
    kept = [d for d in docs[:60] if "%%%" not in d[1]]
    docs += [(1000 + i, t, lang, s) for i, t, lang, s in kept[:15]]
    docs += [(2000 + i, t.replace(" ", "\n", 1) + " ", lang, s) for i, t, lang, s in kept[15:25]]
    for i, t, lang, s in kept[25:40]:
        w = t.split()
        w[0] = "changed"
        docs.append((3000 + i, " ".join(w), lang, s))
    docs += [(4000, None, "en", "a"), (4001, "", "en", None), (None, " ".join(words(rng, 50)), None, "b"), (4002, kept[50 % len(kept)][1], "en", "c"), (4002, kept[50 % len(kept)][1], "en", "c")]
    d = tmp_path_factory.mktemp("pipeline")
    spark.createDataFrame([(*r, len(r[1] or "")) for r in docs], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return str(d), docs


def test_stages(spark, tables):
    d, rows = tables
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "simhash near-dedup", "mixing", "packing"]
    docs, seen = spark.read.parquet(f"{d}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = scratch.materialize(stage(spark, docs, d), "stage")
        seen[name] = docs.collect()
        if name != "packing":
            assert docs.columns == COLUMNS

    quality = seen["quality classifier"]
    texts = Counter((i, t) for i, t, *_ in rows)
    bad = {i for i, t, *_ in rows if "%%%" in (t or "")}
    got = Counter((r["doc_id"], r["text"]) for r in quality)
    assert not {i for i, _ in got} & bad
    plain = {k: n for k, n in texts.items() if k[0] not in bad and (k[1] or "").strip()}
    assert all(got[k] == n for k, n in plain.items())

    exact = seen["exact dedup"]
    norm = Counter("".join((r["text"] or "").split()) for r in quality)
    assert Counter("".join((r["text"] or "").split()) for r in exact) == Counter(dict.fromkeys(norm, 1))

    near = seen["simhash near-dedup"]
    left = {r["doc_id"] for r in near}
    copies = [r for r in exact if r["doc_id"] is not None and 3000 <= r["doc_id"] < 4000]
    assert copies and not any(r["doc_id"] in left for r in copies)
    gone = [r for r in exact if r["doc_id"] not in left]
    for r in gone:
        assert max(likeness(r["text"] or "", x["text"] or "") for x in near) > 0.7

    mixed = seen["mixing"]
    n = Counter((r["doc_id"], r["text"]) for r in mixed)
    assert set(n) <= {(r["doc_id"], r["text"]) for r in near} and max(n.values()) <= 3
    size = {r["doc_id"]: len((r["text"] or "").split()) for r in near}
    per = Counter()
    for r in mixed:
        per[r["source"]] += size[r["doc_id"]]
    whole = Counter()
    for r in near:
        whole[r["source"]] += size[r["doc_id"]]
    facts = [({"source_size": whole[r["source"]], "target": None, "taken": n[r["doc_id"], r["text"]] * size[r["doc_id"]], "copies": n[r["doc_id"], r["text"]], "size": size[r["doc_id"]]}, r["source"]) for r in near]
    total, order = sum(whole.values()), sorted(whole, key=lambda s: (s is None, s or ""))
    share = {s: (i % 3 + 1) for i, s in enumerate(order)}
    for f, s in facts:
        f["target"] = total * share[s] / sum(share.values())
    for error, smallest in check_mix(facts, [(r["text"], r["source"]) for r in near]).values():
        assert abs(error) <= 60 + smallest

    packed = seen["packing"]
    assert sum(r["length"] for r in packed) == sum(len(ids_of(r["text"])) for r in mixed)
    once = {r["doc_id"]: r["text"] for r in mixed if n[r["doc_id"], r["text"]] == 1}
    numbers = {r["sequence_id"]: k for k, r in enumerate(sorted((r for r in packed if r["doc_id"] in once), key=lambda r: r["sequence_id"]))}
    check_pack([{**r.asDict(), "sequence_id": numbers[r["sequence_id"]]} for r in packed if r["doc_id"] in once], once)


def test_run(spark, tables):
    d, _ = tables
    a, b = (sorted(map(tuple, corpus_pipeline.run(spark, d).drop("sequence_id").collect()), key=str) for _ in range(2))
    assert a == b and len(a) > 100


def test_other_sources_of_rows(spark, tables):
    """Rows that are no Parquet scan, empty tables, and columns beside those of documents."""
    d, _ = tables
    docs = spark.createDataFrame([(1, "a text of some words", "en", "a", 20, "x", 1), (2, "a text of some words", "en", "a", 20, "y", 2)], "doc_id long, text string, lang string, source string, n_chars long, tessera_note string, row int")
    for rows in (docs, docs.where("false")):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, rows, d)
            assert name == "packing" or out.columns == docs.columns
            assert out.count() == 0 if rows is not docs else out.count() >= 1
