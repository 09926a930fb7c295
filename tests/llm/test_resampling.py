"""Importance resampling against a plain version."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from bitfold.llm import resampling
from tests.llm.brute import LOWER

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def plain(rows, target, buckets=50, least=3, percent=30):
    """(doc_id, n, weight, score, rank) of rows (doc_id, text), sorted."""
    bucket = lambda w: zlib.crc32(w.encode()) % buckets
    s, t = (Counter(bucket(w) for x in texts for w in words(x)) for texts in ([x for _, x in rows], target))
    gain = [
        math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in range(buckets)
    ]
    out = []
    for doc_id, text in rows:
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(w)] for w in words(text))
        out.append((doc_id, len(words(text)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    enough = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    ranks = {}
    for k, r in enumerate(enough[: len(enough) * percent // 100], 1):
        ranks.setdefault(r, []).append(k)
    rest = [(*r, ranks[r].pop(0) if ranks.get(r) else None) for r in out]
    return sorted(rest, key=str)


def invented(n, seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["The", "été", "x9", "12", "AbC", "-", "日本", "a\x00b", "z" * 90]) + rng.choice(["", "q", ",", "É"])
    return [" ".join(word() for _ in range(rng.randrange(30))) for _ in range(n)]


def found(frame, target, **options):
    out = resampling.resample(frame, target, n_buckets=50, least_words=3, percent=30, **options)
    return sorted((tuple(r) for r in out.select("doc_id", *resampling.RESULTS).collect()), key=str), out


def test_resampling_equals_plain_scores(spark):
    texts = invented(150, 1) + [None, "", " .,", "ab " * 50_000]
    rows = list(enumerate(texts)) + [(None, "null id is one of all"), (7, texts[7]), (7, texts[7]), (8, texts[9])]
    wanted = invented(20, 2) + [None]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    clash = frame.select("*", F.lit("kept").alias("id"), F.lit(1).alias("number"), F.lit(2).alias("score"), F.lit(3).alias("part"))
    target = spark.createDataFrame([(t,) for t in wanted], "text string")
    for probes in (1, 15):
        got, out = found(clash, target, probes=probes)
        assert got == plain(rows, wanted)
    assert out.columns == ["doc_id", "id", "number", "part", *resampling.RESULTS]
    assert {(r["id"], r["number"], r["part"]) for r in out.collect()} == {("kept", 1, 3)}


def test_resampling_parts_ties_at_the_cutoff(spark):
    rows = [(5, "one two three four")] * 40 + [(k, "five six seven eight nine") for k in range(20)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    target = spark.createDataFrame([("one",), ("one",)], "text string")
    got, _ = found(frame, target)
    assert got == plain(rows, ["one", "one"])
    assert sorted(r[-1] for r in got if r[-1]) == list(range(1, 19))


def test_resampling_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    some = spark.createDataFrame([(1, "a b c d"), (2, None)], "doc_id bigint, text string")
    assert found(none, some)[0] == []
    assert found(some, none)[0] == plain([(1, "a b c d"), (2, None)], [])


def test_words_of_pieces_are_words_of_whole_texts(monkeypatch):
    texts = invented(40, 3) + [None, "", "x" * 3000, "é" * 500]
    whole = list(resampling.WordBuckets(97).read(pa.array(texts)))
    monkeypatch.setattr(resampling, "CHUNK", 64)
    cut = list(resampling.WordBuckets(97).read(pa.array(["gone", *texts]).slice(1)))
    assert len(cut) > len(whole) == 1
    for k in (0, 1):
        assert np.array_equal(whole[0][k], np.concatenate([c[k] for c in cut]))
    assert whole[0][1].tolist() == [zlib.crc32(w.encode()) % 97 for t in texts for w in words(t)]
