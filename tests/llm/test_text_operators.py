"""Toxicity, quality rules, HTML text, tokenisers and token files on small inputs."""
import base64
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from hirelens.llm import bpe, html_text, quality, token_files, toxicity

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.001"
ALPHABET = ["a", "s", "'", "'s", "'re", "'ll", " ", "  ", "\n", "\t", "1", "½", "é", "中", "!", "…", " ", "　",
            "\x1c", "'t", "ve", "😀", "|", "<|endoftext|>", "the", " of"]


@pytest.fixture(scope="module")
def odd_texts():
    rng = random.Random(1)
    return ["".join(rng.choices(ALPHABET, k=rng.randint(0, 14))) for _ in range(4000)] + [
        "a" * 3000, " " * 5000 + "x", "ab1" * 900, "😀" * 300, "x" * 257 + " yz", ""]


def test_bpe_equals_the_library(odd_texts):
    voc = bpe.vocabulary(RANKS)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for text, ids in zip(odd_texts, voc.encode(odd_texts)):
        assert ids.tolist() == lib.encode_ordinary(text), repr(text)
        assert voc.decode(ids, voc.offsets(ids)) == text.encode()


def test_scan_does_not_depend_on_the_block_size(odd_texts):
    joined = "\n".join(odd_texts[:500]) + "\n"
    points = np.frombuffer(joined.encode("utf-32-le"), "<u4")
    cls = bpe.classes(points, np.array([len(points) - 1]))
    want = bpe.token_starts(cls, 1)
    assert all((bpe.token_starts(cls, b) == want).all() for b in (3, 64, 10_000))


def test_bpe_rows(spark):
    d = spark.createDataFrame([(1, None, "q"), (None, "é it's", "q"), (1, None, "q")], "doc_id long, text string, ids string")
    got = bpe.round_trip_digests(d, RANKS).collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert [(r.n_tokens, r.ids_sha256) for r in got if r.doc_id == 1] == [(0, empty)] * 2
    assert [r.decoded_sha256 for r in got if r.doc_id is None] == [hashlib.sha256("é it's".encode()).hexdigest()]
    assert bpe.round_trip_digests(d.limit(0), RANKS).count() == 0


def test_token_encoder_equals_the_library(odd_texts):
    lib = Tokenizer.from_file(JSON)
    enc = token_files.Encoder(JSON)
    rng = random.Random(9)
    end = "<|endoftext|>"
    odd_texts = odd_texts + [end, f"x {end} y", f"a{end}b", f" {end}{end}\n x", f"hello  {end}  x", "<|endoftext|", end[1:] + end]
    odd_texts += ["".join(rng.choice([t[:40], t[-40:], end, " ", "\n"]) for _ in range(rng.randint(1, 9))) for t in odd_texts[:300]]
    for text, got, want in zip(odd_texts, enc.encode(odd_texts), lib.encode_batch(odd_texts, add_special_tokens=False)):
        assert np.frombuffer(got, enc.dtype).tolist() == want.ids, repr(text)


def test_token_encoder_forgets_and_finds_again(odd_texts, monkeypatch):
    monkeypatch.setattr(token_files, "WORDS", 40)
    monkeypatch.setattr(token_files, "PIECES", 20)
    enc, lib = token_files.Encoder(JSON), Tokenizer.from_file(JSON)
    for _ in range(2):
        for i in range(0, len(odd_texts), 7):
            some = odd_texts[i:i + 7]
            want = lib.encode_batch(some, add_special_tokens=False)
            assert [np.frombuffer(g, enc.dtype).tolist() for g in enc.encode(some)] == [w.ids for w in want]


def test_token_encoder_looks_a_distinct_word_up_once():
    class Counted(dict):
        asked = 0

        def get(self, *a):
            self.asked += 1
            return super().get(*a)

        def __getitem__(self, k):
            self.asked += 1
            return super().__getitem__(k)

    enc, lib = token_files.Encoder(JSON), Tokenizer.from_file(JSON)
    enc.words = Counted()
    texts = ["one two three, four!! " * 500 + "end", "", " two", "three,", "a  two"] * 2
    want = lib.encode_batch(texts, add_special_tokens=False)
    assert [np.frombuffer(g, enc.dtype).tolist() for g in enc.encode(texts)] == [w.ids for w in want]
    assert enc.words.asked < 40


def test_token_files_read_back(spark):
    rng = random.Random(3)
    rows = [(i if i % 7 else None, rng.choice([None, "", "x y", "long text " * rng.randint(1, 300)])) for i in range(60)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    folder, manifest = token_files.write(d, JSON, 2)
    got = token_files.read_back(spark, folder, manifest, JSON, d.schema["doc_id"].dataType).collect()
    lib = Tokenizer.from_file(JSON)
    at, want = 0, []
    code = {t: h for t, h in spark.createDataFrame([(t,) for _, t in rows], "t string").select("t", F.xxhash64("t")).collect()}
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "")[:64], code[r[1]])):
        ids = np.array(lib.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    sums = [r.base for r in manifest.orderBy("part").collect()]
    assert sums == sorted(sums) and sums[0] == 0
    folder, manifest = token_files.write(d.limit(0), JSON, 2)
    assert token_files.read_back(spark, folder, manifest, JSON, d.schema["doc_id"].dataType).count() == 0


def test_token_files_of_a_hot_id_and_clashing_names(spark):
    same = "equal text"
    rows = [(None if i % 3 else i, same if i % 2 else f"text {i}", "a", "b", "c") for i in range(3000)]
    d = spark.createDataFrame(rows, "doc_id long, text string, _id string, _text string, part string").repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        folder, manifest = token_files.write(d, JSON, 2)
        parts = manifest.collect()
        assert max(p.docs for p in parts) < 2 * 3000 / len(parts)       # two thirds of the rows have no id
        got = token_files.read_back(spark, folder, manifest, JSON, d.schema["doc_id"].dataType).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    lib = Tokenizer.from_file(JSON)
    size = {t: len(lib.encode(t, add_special_tokens=False).ids) + 1 for t in {r[1] for r in rows}}
    assert sorted((r.doc_id or -1, r.n_tokens) for r in got) == sorted((r[0] or -1, size[r[1]]) for r in rows)
    ordered = sorted(got, key=lambda r: r.start)
    assert [r.start for r in ordered] == [sum(r.n_tokens for r in ordered[:k]) for k in range(len(ordered))]


def plain_counts(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    often, cover = Counter(grams), set()
    for i, g in enumerate(grams):
        if often[g] > 1:
            cover |= set(range(i, i + 5))
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(cover), len(lines))


def test_quality_counts(spark):
    rng = random.Random(4)
    texts = ["", " \n", "a b c d e a b c d e", "é# *  x\nq\nq\n q", *(
        "".join(rng.choice(["a", "b ", " c\n", "d ", "|", "x y z ", "\r"]) for _ in range(rng.randint(1, 400))) for _ in range(150))]
    texts += [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    for t in texts:
        assert quality.counts(t) == plain_counts(t)
    assert quality.counts(None) == (0,) * 6
    many = [str(i).encode() for i in range(9000)] * 2       # keys are numbered anew on the way
    assert quality.repeat_words(many) == 18000


def test_binomial_cdf_is_exact():
    from math import comb
    for n, p in ((1, 0.3), (40, 0.05), (200, 0.01)):
        for k in range(-1, n + 1, 3):
            want = sum(comb(n, i) * p ** i * (1 - p) ** (n - i) for i in range(k + 1))
            assert quality.binomial_cdf(k, n, p) == pytest.approx(want, rel=1e-9, abs=1e-300)


def test_repeated_rows_are_one_trial(spark):
    rows = [(i, " ".join(f"word{j}" for j in range(40)), "en") for i in range(60)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    lab = spark.createDataFrame([(i, 1) for i in range(60)], "doc_id long, quality int")
    many = d.crossJoin(spark.range(20).select(F.col("id").alias("_s")))
    for docs in (d, many):
        measured = quality.measure(docs, "doc_id", "text", "lang")
        got = quality.certify(measured, quality.good_documents(lab)).collect()
        assert len(got) == len(quality.RULES)
        assert all(r.cut is None and r.trials == 60 and r.needed > 60 for r in got)
    assert quality.judge(d.limit(0), lab).count() == 0
    names = many.withColumnsRenamed({"_s": "stratum"}).withColumn("gid", F.lit(1)).withColumn("kept", F.lit(1))
    assert quality.judge(names, lab).count() == 1200


def test_needed_trials_certify_and_one_less_does_not():
    level, alpha = 0.05 / 5, quality.RISK / len(quality.RULES)
    from math import ceil, log, log1p
    n = ceil(log(level) / log1p(-alpha))
    assert quality.binomial_cdf(0, n, alpha) <= level < quality.binomial_cdf(0, n - 1, alpha)


def test_quality_cutoffs_against_brute_force(spark):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(3000):
        junk = i % 6 == 0
        w = ["".join(rng.choices("abcdefgh", k=rng.randint(3, 8))) + ("***" if junk or rng.random() < 0.01 else "") for _ in range(40)]
        rows.append((i, " ".join(w), "en" if i % 2 else None))
        labels.append((i, 0 if junk else 1))
    rows += [(None, None, "de"), (1, "dup row", "de")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    lab = spark.createDataFrame(labels + [(None, 1), (5, None)], "doc_id long, quality int")
    got = quality.judge(d, lab).collect()
    assert len(got) == len(rows)
    good = {i for i, q in labels if q}
    level, alpha = quality.DELTA / (2 * len(quality.RULES)), quality.RISK / len(quality.RULES)
    for lang in ("en", None):
        value = {i: [plain_counts(t)[k] / plain_counts(t)[0] for k in (2,)][0] for i, t, x in rows[:3000] if x == lang}
        mine = [v for i, v in value.items() if i in good]
        cut = None
        for c in quality.cutoffs(1.0, 0.02):
            if quality.binomial_cdf(sum(v > c for v in mine), len(mine), alpha) > level:
                break
            cut = c
        verdict = {r.doc_id: "symbols" in r.broken for r in got if r.doc_id in value and r.n_words == 40}
        assert cut is not None and verdict == {i: v > cut for i, v in value.items()}
    kept_good = [r.kept for r in got if r.doc_id in good and r.n_words == 40]
    assert 1 - sum(kept_good) / len(kept_good) <= quality.RISK
    assert not any(r.kept for r in got if r.n_words == 0)
    assert quality.judge(d, lab.limit(0)).where("kept").count() == 3000


def test_toxicity_learns_and_locates(spark):
    rng = random.Random(6)

    def sentence(bad):
        w = ["".join(rng.choices("aeioulmnrst", k=rng.randint(2, 7))) for _ in range(9)]
        return " ".join(w[:4] + (["grubnok" + rng.choice(["a", "ul", "em"])] if bad else []) + w[4:]).capitalize() + "."
    rows = []
    for i in range(700):
        bad = i % 4 == 0
        at = rng.randrange(8)
        rows.append((i, " ".join(sentence(bad and k == at) for k in range(8)), int(bad)))
    d = spark.createDataFrame([r[:2] for r in rows] + [(None, None), (900, ""), (901, "...")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (3, None), (0, 0)], "doc_id long, toxic int")
    model = toxicity.train(d, labels, usable=~toxicity.held_out())
    got = {r.doc_id: r for r in toxicity.score(d, model).collect() if r.doc_id is not None and r.doc_id < 900}
    unseen = [(i, t, y) for i, t, y in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(unseen) > 80 and all((got[i].score >= 0.5) == bool(y) for i, _, y in unseen)
    hits = [t[s.start:s.end] for i, t, y in unseen if y for s in got[i].offending]
    assert hits and all("grubnok" in h for h in hits)
    empty = [r.score for r in toxicity.score(d, model).collect() if r.doc_id in (None, 900, 901)]
    assert empty == [0.0] * 3
    nothing = toxicity.train(d, labels.limit(0))
    assert toxicity.score(d.limit(0), nothing).count() == 0 and {r.score for r in toxicity.score(d, nothing).collect()} == {0.0}


def test_held_out_is_the_contract(spark):
    d = spark.range(200).select(F.col("id").alias("doc_id")).select("doc_id", toxicity.held_out().alias("h"))
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in d.collect())


@pytest.mark.parametrize("page, text", [
    ("", ""),
    ("a<br>b", "a\nb"),
    ("<p>one <b>two</b>three<p>four", "one twothree\n\nfour"),
    ("<ul><li>a<li>b<ol start=3><li>x<li>y</ol><li>c</ul>end", "- a\n- b\n  3. x\n  4. y\n- c\n\nend"),
    ("<table><tr><th>Name<th>N<tr><td>Apple &amp; co<td>1</table>", "Name       | N\nApple & co | 1"),
    ("<head><title>t</title></head><body><script>'<p>'</script>x<div hidden>no</div><i style='display: none'>no</i> y", "x y"),
    ("<pre>\n a\n  b</pre>", " a\n  b"),
    ("1 < 2 <!-- c > --> &lt;b&gt;", "1 < 2 <b>"),
    ("<div>a<div>b</div></span></div>c<input value=x>", "a\nb\nc"),
])
def test_html_layout(page, text):
    assert html_text.page_text(page) == text


@pytest.mark.parametrize("page, text", [
    ("<table><tr><td><h1>T</h1><p>one<p>two<ul><li>a<li>b</ul></td></tr></table>", "T\n\none\n\ntwo\n\n- a\n- b"),
    ("<table><tr><td>menu<td><h2>T</h2><table><tr><td>x<td>1<tr><td>yy<td>2</table><pre>p\n  q</pre></table>",
     "menu\n\nT\n\nx  | 1\nyy | 2\n\np\n  q"),
    ("<table><tr><td>k<td>a<br>b<tr><td>l<td><ol><li>x<li>y</ol></table>", "k | a\n  | b\nl | 1. x\n  | 2. y"),
    ("<table><caption>c <b>d</b></caption><tr><td><pre>m\n n</pre><td><img alt=pic></table>", "c d\nm  | pic\n n |"),
    ("<table><tr><td><p>one<p>two</table>", "one\n\ntwo"),
    ("<table><tr><td>a<td><p>one<p>two<td>z<tr><td>b</table>", "a | one | z\n  |     |\n  | two |\nb"),
])
def test_html_cells_keep_their_blocks(page, text):
    assert html_text.page_text(page) == text


@pytest.mark.parametrize("page, text", [
    ("<table><tr><td rowspan=2>a<td>b<tr><td>c</table>", "a | b\n  | c"),
    ("<table><tr><td colspan=2>title of all<td>z<tr><td>1<td>2<td>3</table>", "title of all | z\n1 | 2        | 3"),
    ("<table><tbody><tr><td rowspan=0>a<td>b<tr><td>c</tbody><tbody><tr><td>d<td>e</table>", "a | b\n  | c\nd | e"),
    ("<table><tr><td>" + "w" * 60 + "<td>x<tr><td>a<td>y</table>", "w" * 60 + " | x\na" + " " * 60 + "| y"),
    ("<table><tr><td>" + "ab " * 40 + "<td>x</table>", "ab " * 33 + "| x\nab ab ab ab ab ab ab" + " " * 78 + " |"),
    ("x<p style='visibility:hidden'>no <b style='visibility: visible'>yes</b> no</p>y", "x\n\nyes\n\ny"),
    ("<table><tr><td>a<td style='visibility:hidden'>b<td>c<tr><td>d<td>e<td>f</table>", "a |   | c\nd | e | f"),
    ("<table><tr><td>a<td>b<tr style='visibility:collapse'><td>c<td>d<tr><td>e<td>f</table>", "a | b\ne | f"),
    ("<ol><li>a<li style='visibility:hidden'>b<li>c</ol>", "1. a\n3. c"),
])
def test_html_spans_widths_and_visibility(page, text):
    assert html_text.page_text(page) == text


def test_html_tables_equal_a_plain_grid():
    """Cell texts stand in the columns that marking a plain matrix cell by cell gives."""
    rng = random.Random(11)
    for _ in range(300):
        n, taken, page, want = 0, set(), [], {}
        rows = rng.randint(1, 6)
        for r in range(rows):
            page.append("<tr>")
            for _ in range(rng.randint(1, 4)):
                c = 0
                while (r, c) in taken:
                    c += 1
                wide, tall = rng.choice([1, 1, 1, 2, 3]), rng.choice([1, 1, 1, 2, 3])
                taken |= {(r + i, c + j) for i in range(tall) for j in range(wide)}
                n += 1
                want[f"c{n}." + "x" * rng.randint(0, 9)] = c
                page.append(f"<td colspan={wide} rowspan={tall}>{list(want)[-1]}")
        got = html_text.page_text("<table>" + "".join(page) + "</table>")
        starts = {}                                     # where the text of a column begins
        if max(want.values()) == 0:
            continue
        for line in got.split("\n"):
            for word in re.finditer(r"c\d+\.x*", line):
                starts.setdefault(want.pop(word[0]), set()).add(word.start())
        assert not want and all(len(s) == 1 for s in starts.values())
        order = [min(starts[c]) for c in sorted(starts)]
        assert order == sorted(order) and len(set(order)) == len(order)


def test_html_visibility_equals_plain_recursion():
    rng = random.Random(12)

    def tree(depth, shown):
        page, words = [], []
        for _ in range(rng.randint(1, 3)):
            if depth and rng.random() < 0.7:
                how = rng.choice(["", "hidden", "visible", "collapse", "inherit"])
                inner, below = tree(depth - 1, {"hidden": False, "collapse": False, "visible": True}.get(how, shown))
                page.append(f"<span style='color:red; visibility: {how}'>{inner}</span>" if how else f"<i>{inner}</i>")
                words += below
            else:
                word = f"w{rng.randrange(10 ** 6)}"
                page.append(f" {word} ")
                words += [word] * shown
        return "".join(page), words
    for _ in range(200):
        page, words = tree(5, True)
        assert html_text.page_text(page).split() == words


def test_html_empty_table_and_clashing_names(spark):
    d = spark.createDataFrame([(1, "<p>x", "a", "b", "c")], "page_id long, html string, text string, _id string, _html string")
    assert html_text.extract(d.limit(0)).collect() == []
    assert [tuple(r) for r in html_text.extract(d).collect()] == [(1, "x")]


def test_html_rows_and_hostile_markup(spark):
    d = spark.createDataFrame([(1, None, "t"), (2, "<p>x", "t"), (2, "<p>x", "t")], "page_id long, html string, text string")
    assert [r.text for r in html_text.extract(d).collect()] == [None, "x", "x"]
    for page in ("<div>" * 50_000 + "x", "<p class=\"x" * 5000, "<table><tr><td>" * 2000, "<" * 50_000):
        html_text.page_text(page)
