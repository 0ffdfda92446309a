"""Near-duplicate groups, components and substring deduplication against brute force."""
import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from hirelens.llm import simhash, substring
from hirelens.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp string, k0 string, row string"


def docs(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", "y", "z") for i, t in zip(ids, texts)], DOCS)


def words(rng, n):
    return " ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(n))


def plain_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in low.translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ") if x]
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i:i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint_follows_its_definition():
    rng = random.Random(1)
    for t in (None, "", " \n", "A b", "Éa É\tB c d", words(rng, 50), words(rng, 9000)):
        assert simhash.fingerprint(t) == plain_fingerprint(t)


def brute_roots(values, most):
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v
    for a in values:
        for b in values:
            if a < b and bin((a ^ b) & (2 ** 64 - 1)).count("1") <= most:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {v: find(v) for v in values}


def cluster(rng, n):
    out = set()
    for _ in range(n):
        v = rng.getrandbits(64)
        for _ in range(rng.randint(1, 6)):
            out.add(v if v < 1 << 63 else v - (1 << 64))
            v ^= sum(1 << b for b in rng.sample(range(64), rng.randint(1, 5)))
    return sorted(out)


def test_links_lose_no_neighbour(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 7)        # so that keys are compared in blocks, too
    rng = random.Random(2)
    base = rng.getrandbits(40)
    values = cluster(rng, 60) + [base ^ (1 << rng.randrange(20)) ^ (1 << rng.randrange(20)) for _ in range(60)]
    values = sorted(set(values))
    nodes = spark.createDataFrame([(v,) for v in values], "fp long")
    got = dict(components(simhash.links(nodes, 3)).collect())
    want = brute_roots(values, 3)
    assert {v: got.get(v, v) for v in values} == want


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(200)] + [(500, 501), (501, 500), (7, 7), (None, 3)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(201)}, 500: 500, 501: 500}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_groups_edge_cases(spark):
    same = words(random.Random(3), 80)
    d = docs(spark, [None, "", same, same, same, "x"], [None, 4, 9, 9, 2, None])
    rows = [(r.doc_id, r.component_id, r.n_in_group) for r in simhash.near_groups(d).collect()]
    assert sorted(rows, key=str) == sorted([(None, 4, 2), (4, 4, 2), (9, 2, 3), (9, 2, 3), (2, 2, 3), (None, None, 1)],
                                           key=str)
    kept = simhash.keep_one(d)
    assert kept.columns == d.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(
        [(4, ""), (2, same), (None, "x")], key=str)
    assert simhash.near_groups(docs(spark, [])).count() == 0
    assert simhash.keep_one(docs(spark, [])).count() == 0


def test_gear_hash_is_the_rolling_sum():
    data = np.frombuffer(bytes(range(200)), np.uint8)
    h = substring.gear_hashes(data)
    for i in (0, 5, 15, 16, 150):
        want = sum(int(substring.GEAR[data[i - j]]) << j for j in range(min(i + 1, substring.WINDOW))) & 0xFFFFFFFF
        assert int(h[i]) == want


def test_chunks_resist_insertions():
    rng = random.Random(4)
    text = words(rng, 400)
    edges, n = substring.chunks(text.encode())
    pieces = {text.encode()[a:b].rstrip() for a, b in zip(edges, edges[1:])}
    other = ("new words here " + text[:1000] + " inserted " + text[1000:]).encode()
    again, _ = substring.chunks(other)
    shifted = {other[a:b].rstrip() for a, b in zip(again, again[1:])}
    assert n.sum() == 400 and len(pieces & shifted) > 0.9 * len(pieces)
    assert len(substring.chunks(b" \n")[0]) == 0


def test_repeated_passages_go_and_clean_texts_stay(spark):
    rng = random.Random(5)
    passage = words(rng, 70)
    texts = [words(rng, 120) + " " + passage + " " + words(rng, 90) for _ in range(30)]
    clean = [words(rng, 200) for _ in range(10)]
    whole = words(rng, 300)
    d = docs(spark, texts + clean + [whole, whole, None, ""])
    out = {r["id"]: r for r in substring.dedup(d).collect()}
    assert out[0]["text"] == texts[0] and out[40]["text"] == whole
    for i in range(1, 30):
        left = sum(w in out[i]["text"].split() for w in passage.split())
        assert left <= 34 and len(out[i]["text"].split()) >= 205
    assert all(out[30 + i]["text"] == t for i, t in enumerate(clean))
    assert out[41]["text"] == "" and out[41]["removed_words"] == 300
    assert out[42]["text"] is None and out[43]["text"] == ""
    cut = substring.cut(d)
    assert cut.columns == d.columns and cut.schema == d.schema
    got = {r.doc_id: r for r in cut.collect()}
    assert got[41].n_chars == 0 and got[0].n_chars == len(texts[0]) and got[5].row == "z"
    assert substring.dedup(docs(spark, [])).count() == 0


def test_equal_rows_are_one_document(spark):
    text = words(random.Random(6), 100)
    got = substring.dedup(docs(spark, [text, text, text], [3, 3, None])).collect()
    assert sorted((str(r["id"]), r["removed_words"]) for r in got) == [("3", 100), ("3", 100), ("None", 0)]
