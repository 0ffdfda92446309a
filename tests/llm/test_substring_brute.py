"""Substring deduplication against a plain matcher over random texts."""
import random
import re

import numpy as np
from pyspark.sql import functions as F

from hirelens.llm import substring


def words(rng, n):
    return ["".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(n)]


def plain_chunks(data):
    """(start, stop, words) by the rule, word by word."""
    found = [(m.start(), m.end()) for m in re.finditer(rb"[^\x09-\x0d\x20]+", data)]
    gear = [int(g) for g in substring.GEAR]
    value = [sum(gear[data[e - 1 - j]] << j for j in range(min(e, substring.WINDOW))) & 0xFFFFFFFF for _, e in found]
    first = []
    for i, v in enumerate(value):
        before = value[max(0, i - substring.REACH):i]
        after = value[i + 1:i + 1 + substring.REACH]
        if i == 0 or (all(v > b for b in before) and all(v >= a for a in after)):
            first.append(i)
    cuts = []
    for a, b in zip(first, [*first[1:], len(found)]):
        cuts += range(a, b, substring.MAX_WORDS)
    ends = [found[i][0] for i in cuts[1:]] + [len(data)]
    return [(found[i][0], e, n) for i, e, n in zip(cuts, ends, np.diff([*cuts, len(found)]).tolist())]


def corpus(rng, blanks=(" ", "\n", "  ")):
    passages = [words(rng, rng.randint(8, 140)) for _ in range(12)]
    texts = []
    for _ in range(120):
        parts = []
        for _ in range(rng.randint(0, 4)):
            parts += words(rng, rng.randint(1, 60))
            if rng.random() < 0.6:
                parts += rng.choice(passages)
        texts.append(rng.choice(blanks).join(parts))
    return texts + ["", None, "é " + texts[0]] + texts[:2], passages


def test_cuts_are_the_repeated_chunks_of_a_plain_search(spark):
    texts, _ = corpus(random.Random(1))
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["id"]: sorted((s["start"], s["stop"]) for s in r["removed_spans"]) for r in substring.dedup(d).collect()}
    pieces, seen = {}, set()
    for i, t in enumerate(texts):                   # ids ascend, so the first place of a piece is met first
        data = (t or "").encode()
        for a, b, n in plain_chunks(data):
            body = data[a:b].rstrip()
            pieces.setdefault(i, []).append((a, b, n, body in seen))
            seen.add(body)
    want = {}
    for i in range(len(texts)):
        runs, last = [], None
        for a, b, n, again in pieces.get(i, []):
            if again and last:
                runs[-1][1], runs[-1][2] = b, runs[-1][2] + n
            elif again:
                runs.append([a, b, n])
            last = again
        want[i] = [(a, b) for a, b, n in runs if n >= substring.MIN_WORDS]
    assert got == want and sum(map(len, got.values())) > 60


def test_every_word_that_is_cut_stood_earlier_and_long_passages_go(spark):
    rng = random.Random(2)
    texts, passages = corpus(rng, (" ",))         # a repeat is one of bytes, blanks included
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = sorted(substring.dedup(d).collect(), key=lambda r: r["id"])
    before, singles, met, left, missed, again = set(), set(), set(), [], 0, 0
    for r, text in zip(rows, texts):
        data = (text or "").encode()
        w = data.split()
        for s in r["removed_spans"]:
            cut = data[s["start"]:s["stop"]].split()
            assert len(cut) == s["words"] >= substring.MIN_WORDS
            own = data[:s["start"]].split()             # earlier in the same text counts as well
            mine = {tuple(own[i:i + 2]) for i in range(len(own) - 1)}
            pairs = [tuple(cut[i:i + 2]) for i in range(len(cut) - 1)]
            # word pairs stood earlier, but for those across two pieces of different earlier places
            assert all((x,) in singles or x in own for x in cut)
            assert sum(p in before or p in mine for p in pairs) >= 0.8 * len(pairs)
        joined = b" ".join(w)
        for k, p in enumerate(passages):
            line = " ".join(p).encode()
            if len(p) > 50 and line in joined:
                if k in met:
                    again += 1
                    kept = b" ".join((r["text"] or "").encode().split())
                    at = max((n for n in range(len(p) + 1) for i in range(len(p) - n + 1)
                              if n > 5 and " ".join(p[i:i + n]).encode() in kept), default=0) if line not in kept else len(p)
                    missed += at == len(p)
                    left.append(at)
                met.add(k)
        before |= {tuple(w[i:i + 2]) for i in range(len(w) - 1)}
        singles |= {(x,) for x in w}
    assert again > 20 and missed <= 0.05 * again
    assert np.mean([x for x in left if x < 50]) < 25            # what stays at the ends of a passage
