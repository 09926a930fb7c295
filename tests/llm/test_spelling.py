"""Spelling variants against a plain comparison of all words."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from bitfold.llm import spelling
from tests.llm.brute import LOWER

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain(rows, every=31, ratio=10):
    counts = Counter()
    for doc_id, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                counts[run] += 1
    counts = {w: n for w, n in counts.items() if n >= 2}
    near = {w: [x for x in counts if one_edit(w, x)] for w in counts}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best and counts[best] >= ratio * counts[w] else None
    out = set()
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, counts[w], len(near[w]), counts.get(form[w])))
    return out


def invented(seed, n=200):
    rng = random.Random(seed)
    base = ["straße", "Überraschung", "colouring", "aaaaaaaaa", "variants", "abcdefg", "ÿÿÿÿÿÿÿ×", "z" * 90]
    rows = []
    for k in range(n):
        words = []
        for _ in range(rng.randrange(40)):
            word = list(rng.choice(base[: rng.randrange(1, len(base) + 1)]))
            for _ in range(rng.choice([0] * 12 + [1, 1, 2])):
                at = rng.randrange(len(word))
                word[at : at + rng.randrange(2)] = rng.choice(["", "a", "é", "B", "×"])
            words.append("".join(word))
        rows.append((k, rng.choice([" ", "-", "\n", "ā"]).join(words)))
    return rows + [(None, "colouring colouring"), (500, None), (501, ""), (502, "12 !"), (3, rows[3][1]), (3, rows[3][1])]


def as_set(out):
    rows = [tuple(r) for r in out.select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("options", [{}, {"max_bytes": 1}, {"word_bits": 1}, {"drop_every": 3, "ratio": 2}])
def test_variants_equal_plain_comparison(spark, options):
    rows = invented(1)
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    clash = frame.select("*", *[F.lit(1).alias(c) for c in ("id", "word", "run", "n", "near")])
    wanted = plain(rows, options.get("drop_every", 31), options.get("ratio", 10))
    assert len(wanted) > 30 and any(w[1] for w in wanted)
    assert as_set(spelling.variants(clash, **options)) == wanted


def test_variants_follow_forms_to_the_last(spark):
    # each word is ten times as frequent as the next, which differs by one letter
    text = " ".join(["abcdefgh"] * 2000 + ["abcdefgx"] * 200 + ["abcdefyx"] * 20 + ["abcdezyx"] * 2)
    rows = [(1, text)]
    got = as_set(spelling.variants(spark.createDataFrame(rows, "doc_id bigint, text string"), drop_every=1 << 33))
    assert got == plain(rows, 1 << 33)
    assert {w[2] for w in got} == {"abcdefgh"}


def test_variants_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert spelling.variants(none).count() == 0
    assert spelling.variants(spark.createDataFrame([(1, None), (2, "short ones")], "doc_id bigint, text string")).count() == 0


def test_hashes_of_edits_are_hashes_of_words(monkeypatch):
    """With filters that know everything, all edits come out once, in pieces of any size."""
    alphabet = np.frombuffer("abéz".encode("latin-1"), np.uint8)
    words = ["abzéaab", "zzzzzzz"]
    size = spelling.LONGEST + 1
    everything = spelling.Filters(np.zeros(size, np.int64), np.ones(size, np.int64), np.full((1, spelling.LANES), 2**64 - 1, np.uint64))
    for chunk in (1 << 20, 16):
        monkeypatch.setattr(spelling, "CHUNK", chunk)
        letters = next(iter(spelling.matrices(words, 1 << 20)))[2]
        got = Counter()
        for row, place, letter in spelling.edits(letters, alphabet, everything):
            for r, p, c in zip(row, place, letter):
                got[words[r], words[r][:p] + (chr(c) if c else "") + words[r][p + 1 :]] += 1
        wanted = {(w, w[:p] + c + w[p + 1 :]) for w in words for p in range(7) for c in "abéz" if c > w[p]}
        wanted |= {(w, w[:p] + w[p + 1 :]) for w in words for p in range(7)}
        assert set(got) == wanted and set(got.values()) == {1}
