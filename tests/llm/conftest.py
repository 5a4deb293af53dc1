import random

import pytest

#: A clash with every name that an operator could use for itself.
EXTRA = ["uid", "row", "fp", "n", "key", "size", "_metadata", "value", "slot", "begin", "p"]


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table of (doc_id, text[, lang, source]) rows with extra columns of clashing names."""

    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "src0", None if r[1] is None else len(r[1]), *["x"] * len(EXTRA)) for r in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in EXTRA))

    return make


@pytest.fixture(scope="session")
def corpus():
    """Random texts with copies, near copies, shared passages, ties, nulls and odd characters."""
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcdeéßñ") for _ in range(rng.randint(1, 7))) for _ in range(300)]

    def text(n):
        return "".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", "\n", "\t ", "\x0b", "\r\n", "  "]) for _ in range(n))

    passage, base = text(70), text(120)
    rows = [(i, text(rng.choice([0, 1, 3, 4, 5, 20, 60, 200, 500]))) for i in range(40)]
    rows += [(100 + i, text(10) + passage + text(10)) for i in range(6)]
    rows += [(200 + i, base) for i in range(5)] + [(210, base.replace(" ", "  ")), (211, " " + base + "\n")]
    for i in range(12):
        w = base.split(" ")
        for _ in range(rng.randint(1, 3)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        rows.append((300 + i, " ".join(w)))
    rows += [(400, None), (401, ""), (402, " \n\t"), (403, " "), (404, "日本語 テキスト 😀"), (405, text(9000)), (406, "a" * 200_000), (407, passage + passage), (408, "Ab AB ab aB ab"), (409, "\x00nul and \x1f control")]
    rows += [(5, "a doc_id that stands twice"), (5, "a doc_id that stands twice"), (None, passage), (None, None)]
    rng.shuffle(rows)
    return [(i, t, rng.choice(["en", "de", None]), rng.choice(["src1", "src2", "src10", "é", None])) for i, t in rows]


@pytest.fixture(scope="session")
def twin_words():
    """Pairs of different words that hashes which are sums of bytes by powers can't tell apart: Thue-Morse orders and their complements."""
    out = []
    for n in (16, 64, 128, 512, 1024, 2048):
        order = [bin(i).count("1") % 2 for i in range(n)]
        out.append(tuple("".join("ab"[b ^ flip] for b in order) for flip in (0, 1)))
    return out
