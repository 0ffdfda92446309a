"""MinHash groups against all pairs of plain shingle sets."""
import random

import numpy as np
from pyspark.sql import functions as F

from hirelens.llm import minhash

DOCS = "doc_id long, text string, lang string, id string, n string, sig string, keys string, th string, node string"


def docs(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", *["x"] * 6) for i, t in zip(ids, texts)], DOCS).repartition(4)


def words(rng, n):
    return ["".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(n)]


def plain_set(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in low.translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ") if x]
    return frozenset([" ".join(w)] if 0 < len(w) < 3 else [" ".join(w[i:i + 3]) for i in range(len(w) - 2)])


def plain(texts, ids):
    """Sorted (id, size, component, kept) by comparing all pairs."""
    sets = [plain_set(t) for t in texts]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    out = []
    for i, s in enumerate(sets):
        near = [ids[j] for j in range(len(sets)) if find(j) == find(i) and ids[j] is not None]
        least = min(near) if near else None
        out.append((ids[i], len(s), least, ids[i] == least))
    return sorted(out, key=str)


def groups(spark, texts, ids=None):
    got = minhash.near_groups(docs(spark, texts, ids)).select("doc_id", "n_shingles", "component_id", "kept")
    return sorted(map(tuple, got.collect()), key=str)


def variants(rng, base, n, most):
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, most)):
            at = rng.randrange(len(w))
            w[at:at + rng.randint(0, 1)] = words(rng, rng.randint(0, 2))
        out.append(" ".join(w))
    return out


def test_equals_all_pairs(spark):
    rng = random.Random(1)
    texts = []
    for _ in range(25):                             # families around and on both sides of the threshold
        texts += variants(rng, words(rng, rng.randint(20, 150)), 12, 4)
    texts += [" ".join(words(rng, 40)) for _ in range(40)]
    rng.shuffle(texts)
    assert groups(spark, texts) == plain(texts, list(range(len(texts))))


def test_odd_rows(spark):
    long = " ".join(words(random.Random(2), 20_000))
    texts = [None, "", " \t\n", "one", "ONE", "one two", "One Two", "é É", "É É", "a b c", "a  b\x0bc", long, long.upper(),
             "a b c d e", "a b c d e", "q w e", "q w e", None]
    ids = [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 13, None, None, None]
    assert groups(spark, texts, ids) == plain(texts, ids)


def test_a_row_without_id_follows_its_group(spark):
    assert groups(spark, ["a b c", "a b c"], [None, 7]) == [(7, 1, 7, True), (None, 1, 7, False)]


def test_empty_table(spark):
    assert groups(spark, []) == []


def test_blocks_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 7)
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", 400)
    rng = random.Random(3)
    texts = variants(rng, words(rng, 60), 60, 5) + variants(rng, words(rng, 80), 30, 2)
    assert groups(spark, texts) == plain(texts, list(range(len(texts))))


def test_a_chain_is_one_group(spark):
    base = words(random.Random(4), 130)
    texts = [" ".join(base[i * 4:i * 4 + 100]) for i in range(8)]        # only neighbours are near
    assert {r[2] for r in groups(spark, texts)} == {0}


def test_bytes_agree_as_often_as_the_model_says():
    rng = np.random.default_rng(5)
    for shared in (0, 300, 600, 850):
        hits = []
        for _ in range(40):
            x = rng.integers(0, 1 << 63, 2000 - shared, np.uint64)
            a, b = x[:1000], np.concatenate([x[:shared], x[1000:]])
            s = minhash.signatures(minhash.minima([a, b], 120))
            hits.append((s[0] == s[1]).mean())
        j = shared / (2000 - shared)
        want = j + (1 - j) / 256
        assert abs(np.mean(hits) - want) < 4 * np.sqrt(want * (1 - want) / 4800) + 1e-3


def test_posterior_bound_is_the_integral():
    grid = np.linspace(1 / 256, 1, 400_001)
    at = 0.85 * (255 / 256) + 1 / 256
    for seen, need in minhash.fewest_hits(120):
        for hits, stays in ((need, True), (need - 1, False)):
            mass = grid ** hits * (1 - grid) ** (seen - hits)
            assert (mass[grid >= at].sum() / mass.sum() >= minhash.MISS) is np.True_ if stays else \
                mass[grid >= at].sum() / mass.sum() < minhash.MISS


def test_forest_connects_what_links():
    rng = np.random.default_rng(6)
    link = np.triu(rng.random((30, 30)) < 0.05, 1)
    link |= link.T
    for split in (0, 12):
        sides = np.full(30, 2) if not split else np.repeat([0, 1], [split, 30 - split])
        allowed = link & ((sides[:, None] != sides[None]) | (sides[0] == 2))
        got = np.eye(30, dtype=bool)
        for a, b in minhash._forest(30, lambda at, rest: np.flatnonzero(link[at, rest]), sides):
            assert allowed[a, b]
            got[a, b] = got[b, a] = True
        want = allowed | np.eye(30, dtype=bool)
        for _ in range(6):
            got, want = got @ got, want @ want
        assert (got == want).all()
    assert minhash._forest(3, None, np.array([1, 1, 1])) == []


def test_row_columns_are_not_read(spark):
    got = minhash.near_groups(docs(spark, ["a b c"]).withColumn("_text", F.lit("z")).withColumn("_id", F.lit(3)))
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"] and got.count() == 1
