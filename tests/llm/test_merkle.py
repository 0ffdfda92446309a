"""Merkle manifest against plain recursion with hashlib."""
import hashlib
import itertools

import pytest
from pyspark.sql import functions as F

from hirelens.llm import merkle

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
DOCS = ("doc_id long, text string, lang string, source string, n_chars long, "
        "grp string, place string, n string, d string, leaf string, steps string")


def docs(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", "c", "d", "e", "f") for r in rows], DOCS).repartition(3)


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(r):
    doc_id, text, lang, source, n_chars = r
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])


def tree(nodes, arity):
    """Top of the tree and, per node, its siblings level by level as (left, right)."""
    proofs = [[] for _ in nodes]
    held = [(d, [i]) for i, d in enumerate(nodes)]
    while len(held) > 1:
        new = []
        for i in range(0, len(held), arity):
            run = held[i:i + arity]
            for j, (_, below) in enumerate(run):
                for b in below:
                    proofs[b].append(("".join(d for d, _ in run[:j]), "".join(d for d, _ in run[j + 1:])))
            new.append((h(*[d for d, _ in run]), [b for _, below in run for b in below]))
        held = new
    return held[0][0], proofs


def plain(rows, arity, change):
    """Sorted (doc_id or -1, leaf, subroot, root, proof, folded)."""
    key = lambda r: (r[2] is not None, r[2] or "")                                     # noqa: E731
    groups = []
    for _, g in itertools.groupby(sorted(rows, key=key), key):
        g = sorted(g, key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        groups.append((g, *tree([leaf(r) for r in g], arity)))
    root, above = tree([top for _, top, _ in groups], arity)
    out = []
    for (g, top, proofs), up in zip(groups, above):
        for r, steps in zip(g, proofs):
            folded = leaf(change(r))
            for left, right in steps + up:
                folded = h(left, folded, right)
            out.append((-1 if r[0] is None else r[0], leaf(r), top, root, "".join(a + b for a, b in steps + up), folded))
    return sorted(out)


def spread(rows, arity):
    told = F.when(F.col("doc_id") % 3 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    got = merkle.manifest(rows, FIELDS, "doc_id", "lang", changed={"n_chars": told}, arity=arity)
    got = got.select(F.coalesce("doc_id", F.lit(-1)), "leaf", "subroot", "root",
                     merkle.proof_text(F.col("steps")), merkle.fold(F.col("altered"), F.col("steps")))
    return sorted(map(tuple, got.collect()))


def tampered(r):
    doc_id, text, lang, source, n = r
    return (doc_id, text, lang, source, n + 1 if doc_id is not None and doc_id % 3 == 0 and n is not None else n)


ODD = ([(i, f"t{i}é", "en", "s", i) for i in range(11)] + [(20, None, "de", None, None)]
       + [(30 + i, "", None, "s", 0) for i in range(3)] + [(40, "x " * 9000, "", "s", 1), (41, "y", "", "s", 2)]
       + [(None, "n", "en", "s", 1), (None, "m", "en", "s", 1)]            # no id
       + [(5, "other", "en", "s", 5)] + [(50, "same", "fr", "s", 4)] * 5)   # a repeated id, repeated rows


@pytest.mark.parametrize("arity", [2, 3, 4])
def test_equals_plain_recursion(spark, arity):
    assert spread(docs(spark, ODD), arity) == plain(ODD, arity, tampered)


def test_tampered_rows_do_not_verify(spark):
    for doc_id, *_, root, _, folded in spread(docs(spark, ODD), 2):
        cheated = doc_id % 3 == 0 and doc_id >= 0
        assert (folded == root) != cheated


@pytest.mark.parametrize("rows", [[], [(1, "a", "en", "s", 1)], [(1, "a", None, None, None)]])
def test_empty_and_single(spark, rows):
    assert spread(docs(spark, rows), 2) == (plain(rows, 2, tampered) if rows else [])


def test_places_deal_equal_rows_over_partitions(spark):
    rows = spark.range(3000).select(F.lit("g").alias("g"), F.lit(1).alias("o")).repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = merkle.places(rows, "g", ["o"])
        assert sorted(r["place"] for r in got.collect()) == list(range(3000))
        keys = ["g", "o", "_tie"]
        dealt = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*keys)
        assert dealt.select(F.spark_partition_id()).distinct().count() > 4
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {r["n"] for r in got.collect()} == {3000}
