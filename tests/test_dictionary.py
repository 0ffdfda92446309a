"""C5/C6 by join equals the literal dictionary test."""

import random

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from hirelens import dims
from hirelens.functions.tags import with_skills
from hirelens.operators import dictionary


def _aliases(spark, entries):
    return spark.createDataFrame([(c, a) for c, al in entries for a in al], "canonical string, alias string")


def _literal(df, entries):
    got = with_skills(df, ["text"], "s", entries).select("doc_id", F.explode(F.split("s", ",")).alias("c"))
    return {(r.doc_id, r.c) for r in got.where("c <> ''").collect()}


def test_equals_the_literal_version_on_the_skills(spark):
    rng = random.Random(1)
    flat = [a for _, al in dims.SKILL_DICT for a in al]
    texts = [rng.choice(["", "senior ", "需要"]) + rng.choice([" ", "", "/", "x", "工程师"]).join(
        rng.choice([str.upper, str.lower, str.title])(rng.choice(flat)) for _ in range(rng.randint(0, 4))) for _ in range(300)]
    texts += [None, "", "c", "+", "😀c++😀", "go", "C#", "x" * 5000 + ".net"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {tuple(r) for r in dictionary.hits(df, _aliases(spark, dims.SKILL_DICT), "doc_id", "text").collect()}
    assert got == _literal(df, dims.SKILL_DICT) and len(got) > 300


def test_many_aliases_over_whole_documents(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: (r.text or "").lower() for r in docs.collect()}
    rng = random.Random(2)
    pool = sorted(texts.values(), key=len)[50:]
    aliases = set()
    while len(aliases) < 3000:                              # pieces of the texts themselves, and changed ones
        t = rng.choice(pool)
        at = rng.randrange(max(1, len(t) - 12))
        piece = t[at:at + rng.randint(1, 12)]
        aliases.add(piece if rng.random() < 0.6 else piece[::-1])
    aliases.discard("")
    listed = spark.createDataFrame([(f"c{i % 2500}", a) for i, a in enumerate(sorted(aliases))] + [("none", "")],
                                   "canonical string, alias string")
    got = {tuple(r) for r in dictionary.hits(docs, listed, "doc_id", "text").collect()}
    import re
    want = set()
    runs = {d: set(re.findall("[a-z]+", t)) for d, t in texts.items()}
    for i, a in enumerate(sorted(aliases)):
        word = re.fullmatch("[a-z]+", a)
        want |= {(d, f"c{i % 2500}") for d, t in texts.items() if (a in runs[d] if word else a in t)}
    assert got == want


@pytest.mark.parametrize("rows, names", [([], ["a b"]), ([(1, "a b")], [])])
def test_empty_sides(spark, rows, names):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    listed = spark.createDataFrame([(n, n) for n in names], "canonical string, alias string")
    assert dictionary.hits(df, listed, "doc_id", "text").collect() == []


def test_grams(spark):
    df = spark.createDataFrame([("abcab",), ("ab",), ("",)], "t string")
    got = [sorted(r.g) for r in df.select(dictionary.grams(F.col("t")).alias("g")).collect()]
    assert got == [["abc", "bca", "cab"], [], []]


def test_grams_are_characters_and_only_needed_sizes_are_made(spark):
    df = spark.createDataFrame([("a😀b😀\nc",)], "t string")
    got = {n: df.select(F.sort_array(dictionary.grams(F.col("t"), n))).first()[0] for n in (1, 2, 3)}
    chars = list("a😀b😀\nc")
    assert all(sorted(set("".join(chars[i:i + n]) for i in range(len(chars) - n + 1))) == sorted(got[n]) for n in got)
    pieces = df.select(dictionary._pieces(F.col("t"), [2])).first()[0]
    assert sorted(pieces) == sorted(got[2])
