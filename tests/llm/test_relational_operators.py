"""Chat formatting, source mixing and nearest neighbours, partly against their SQL."""
import hashlib
import random

import duckdb
import numpy as np
from pyspark.sql import functions as F

from hirelens.llm import ann, chat, mixing, queries

SF = "/root/testdata/sf0.001"
MESSAGES = "tree long, node long, parent long, score double, role string, text string"


def same_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SF).toPandas()
    want = con.sql(queries.ORACLE_SQL[name]).df()[list(got.columns)]
    key = list(got.columns)
    got, want = (x.sort_values(key).reset_index(drop=True) for x in (got, want))
    assert len(got) == len(want) and all((got[c] == want[c]).all() for c in key)
    return got


def test_chat_equals_sql(spark):
    got = same_as_sql(spark, "op4_chat_formatting")
    own = got[got.conv_id == -1].iloc[0]
    text = "<|im_end|><|im_start|>assistant ok"
    assert own.n_turns == 2 and own.loss_chars == len(text)
    assert own.loss_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_escapes_are_reversible(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choices(["<", "|", "\\", "im_end", "\n", "x", "<|im_start|>"], k=rng.randint(0, 9))) for _ in range(600)]
    d = spark.createDataFrame([(i, 1, None, 0.0, t[::-1], t) for i, t in enumerate(texts)], MESSAGES)
    out = chat.format_paths(d).select("tree", chat.parse(F.col("formatted")).alias("t")).collect()
    assert all(r.t[0].text == texts[r.tree] and r.t[0].role == texts[r.tree][::-1] for r in out) and len(out) == 600


def test_best_branches(spark):
    rows = [(1, 0, None, 0.5, "user", "q"), (1, 1, 0, 1.0, "assistant", "a"), (1, 2, 0, 2.0, "assistant", None),
            (1, 3, 1, 5.0, "user", "more"), (1, 3, 1, 5.0, "user", "more"), (1, 4, 2, None, None, "x"),
            (None, 7, None, None, "user", "alone"), (2, 1, 2, 1.0, "user", "cycle"), (2, 2, 1, 1.0, "user", "cycle"),
            (3, 1, 99, 1.0, "user", "lost parent")]
    out = chat.format_paths(spark.createDataFrame(rows, MESSAGES), branches=2)
    got = {(r.tree, r["rank"]): [(t.role, t.text) for t in r.t] for r in out.select(
        "tree", "rank", chat.parse(F.col("formatted")).alias("t")).collect()}
    assert got == {(1, 1): [("user", "q"), ("assistant", "a"), ("user", "more")],
                   (1, 2): [("user", "q"), ("assistant", ""), ("", "x")],
                   (None, 1): [("user", "alone")], (3, 1): [("user", "lost parent")]}
    learned = {r.tree: r.x for r in out.where("rank = 1").select(
        "tree", chat.learned_text(F.col("formatted"), F.col("loss_spans")).alias("x")).collect()}
    assert learned == {1: "a", None: "", 3: ""}
    assert chat.format_paths(spark.createDataFrame([], MESSAGES)).count() == 0


def test_long_chains_in_few_rounds(spark):
    d = spark.range(300).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"),
                                F.col("id").cast("string").alias("text"))
    r = chat.format_paths(chat.chains(d)).select(chat.parse(F.col("formatted")).alias("t")).first()
    assert [t.text for t in r.t] == [str(i) for i in range(300)]


def test_mixing_equals_sql(spark):
    got = same_as_sql(spark, "op9_source_mixing")
    assert got.target.drop_duplicates().gt(0).all() and (got.taken <= 3 * got["size"]).all()
    source = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source").toPandas()
    by = got.merge(source).groupby("source").agg(target=("target", "first"), taken=("taken", "sum"), most=("size", "max"))
    assert ((by.target - by.taken).abs() <= by.most / 2 + 1).all()


def test_targets_refill(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), (None, 0), ("c", 500), ("d", 40)], "src string, source_size long")
    got = {r.src: r.target for r in mixing.targets(sizes).collect()}
    size = {"a": 10, "b": 1000, "c": 500, "d": 40, None: 0}
    weight, full = dict(zip(["a", "b", "c", "d", None], [5, 2, 1, 5, 2])), {}
    while True:
        left = 1550 - sum(3 * size[s] for s in full)
        part = {s: left * weight[s] / sum(weight[x] for x in size if x not in full) for s in size if s not in full}
        over = {s for s, t in part.items() if t >= 3 * size[s]}
        if not over:
            break
        full |= dict.fromkeys(over)
    want = {s: float(3 * size[s]) if s in full else part[s] for s in size}
    assert got == {s: pytest_approx(t) for s, t in want.items()}
    assert mixing.targets(sizes.limit(0)).count() == 0


def pytest_approx(x):
    import pytest
    return pytest.approx(x)


def test_mix_rows(spark):
    rows = [(i % 40 if i % 9 else None, "w " * (i % 25) if i % 11 else None, [None, "a", "b", "c"][i % 4], i) for i in range(400)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, mix_copies long")
    a, b = (sorted(map(tuple, mixing.mix(x).collect()), key=str) for x in (d, d.repartition(7)))
    assert a == b and len(a) == 400
    out = mixing.expand(d)
    assert out.columns == d.columns
    assert sum(len((r.text or "").split()) for r in out.collect()) == sum(r[7] for r in a)
    assert mixing.mix(d.limit(0)).count() == 0 and mixing.expand(d.limit(0)).count() == 0


def test_neighbours_recall_copies_and_bad_vectors(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 16)).astype(np.float32)
    x[100:400] = x[100]                                     # a hot vector
    rows = [(i, [float(v) for v in r], "e") for i, r in enumerate(x)]
    rows += [(5000, None, "e"), (5050, [0.0] * 16, "e"), (5100, [float("nan")] * 16, "e"), (5150, [None] * 16, "e"),
             (5200, [1.0] * 3, "e"), (None, [1.0] * 16, "e"), (5250, [], "e")]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string")
    got = ann.neighbours(d, F.col("id") % 50 == 0).toPandas().sort_values(["query_id", "rank"])
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    hits = total = 0
    for q in range(0, 1500, 50):
        s = u @ u[q]
        s[100:400] = s[100]
        s[q] = -9
        want = np.lexsort((np.arange(1500), -s))[:5]
        mine = got[got.query_id == q]
        assert mine["rank"].tolist() == [1, 2, 3, 4, 5]
        assert np.allclose(mine.score, [u[q] @ u[v] for v in mine.vec_id], atol=1e-12)
        hits += len(set(want) & set(mine.vec_id))
        total += 5
    assert hits >= 0.9 * total
    assert got[got.query_id == 100].vec_id.tolist() == [101, 102, 103, 104, 105]
    assert set(got.query_id) == set(range(0, 1500, 50))
    assert ann.neighbours(d.limit(0), F.col("id") % 50 == 0).count() == 0
    two = ann.neighbours(spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0])], "vec_id long, embedding array<double>"),
                         F.col("id") % 50 == 0).collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in two] == [(0, 1, 1)]


def test_graph_search_finds_the_best(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(4000, 12))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    c = ann.Centroids.fit(x, 400)
    at, sim = c.search(x[:200], 48)
    best = (x[:200] @ c.points.T).argmax(axis=1)
    assert (at[:, 0] == best).mean() > 0.97 and (np.diff(sim, axis=1) <= 1e-6).all()


def test_no_list_in_reach_is_lost_among_many_centroids():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 1, 24)) + rng.normal(size=(300, 32, 24))
    x = x.reshape(-1, 24) / np.linalg.norm(x.reshape(-1, 24), axis=1, keepdims=True)
    c = ann.Centroids.fit(x, 1500, rounds=3)
    far = np.sqrt(np.maximum(0, 2 - 2 * x[:300] @ c.points.T))
    reach = far <= (1 + 0.8) * far.min(axis=1, keepdims=True)
    assert reach.sum(axis=1).max() > ann.BEAM
    row, at = c.within(x[:300], 0.8)
    got = np.zeros_like(reach)
    got[row, at] = True
    assert (reach & got).sum() > 0.999 * reach.sum() and (got & ~reach).sum() < 0.001 * reach.sum()
    row, at = c.homes(x[:300], ann.REPLICATE, ann.MAX_COPIES)
    first = np.unique(row, return_index=True)[1]
    assert (at[first] == far.argmin(axis=1)).all() and np.bincount(row).max() <= ann.MAX_COPIES
    stray = [(r, b) for r, b in zip(row, at) if far[r, b] > (1 + ann.REPLICATE) * far[r].min() + 1e-9]
    assert not stray and len(set(zip(row, at))) == len(row)


def test_pipeline_stages(spark):
    import corpus_pipeline
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and 0 < out.count() < 3 * docs.count()
    for name, stage in corpus_pipeline.STAGES[1:4]:
        assert stage(spark, docs.limit(0), SF).columns == docs.columns


def test_toxic_rows_go_alone(spark, monkeypatch):
    import corpus_pipeline
    from hirelens.llm import toxicity
    model = toxicity.Model(np.zeros(1 << toxicity.BITS, np.float32), -6.0)
    model.weights[toxicity.word_features("vile")] = 9.0
    monkeypatch.setattr(corpus_pipeline.toxicity, "train", lambda *a, **b: model)
    rows = [(None, "vile thing", "s", 10), (None, "kind thing", "s", 10), (None, None, "s", 0), (7, "vile thing", "t", 10),
            (7, "calm thing", "t", 10), (8, "calm thing", None, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    out = corpus_pipeline.drop_toxic(spark, d.select("n_chars", "text", "source", "doc_id"), SF)
    assert out.columns == ["n_chars", "text", "source", "doc_id"]
    got = sorted((tuple(r) for r in out.select(*d.columns).collect()), key=str)
    assert got == sorted((r for r in rows if r[1] is None or "vile" not in r[1]), key=str)


def test_vectors_of_extreme_size(spark):
    """Squares of the components are beyond doubles, or vanish; the cosines are those of the directions."""
    v = {0: [1e200, 1e200], 1: [1e200, 0.0], 2: [1e-200, 1e-200], 3: [1e-320, 0.0], 4: [3.0, 4.0]}
    rows = [(i, x, "a", "b", 1) for i, x in v.items()]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>, id string, vector string, k1 int")
    got = {(r.query_id, r.vec_id): r.score for r in ann.neighbours(d, F.col("id") >= 0).collect()}
    unit = {i: np.array(x) / max(x) / np.linalg.norm(np.array(x) / max(x)) for i, x in v.items()}
    assert got.keys() == {(a, b) for a in v for b in v if a != b}
    assert all(abs(s - unit[a] @ unit[b]) < 1e-15 for (a, b), s in got.items())
