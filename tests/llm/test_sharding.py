"""Sharding against a plain search over the groups in order."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from bitfold.llm import sharding


def least_largest(sizes, n):
    """The smallest possible largest sum of n contiguous runs."""
    low, high = max(max(sizes), -(-sum(sizes) // n)), sum(sizes)
    while low < high:
        middle, used, room = (low + high) // 2, 1, (low + high) // 2
        for s in sizes:
            if s > room:
                used, room = used + 1, middle
            room -= s
        low, high = (low, middle) if used <= n else (middle + 1, high)
    return low


def check(rows, out, n):
    """Everything the law promises, for rows (doc_id, text) and the result's rows."""
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in out), key=str) == sorted(
        ((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in rows), key=str
    )
    assert {(r["law"], r["grown_shard"]) for r in out} <= {("bytes", None)}
    slots, load = defaultdict(list), Counter()
    for r in out:
        slots[r["shard"]].append(r["slot"])
        load[r["shard"]] += r["size"]
    assert set(slots) <= set(range(n))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    digest = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    groups = Counter()
    for _, t in rows:
        groups[digest(t)] += len((t or "").encode()) + 16
    ordered = [groups[d] for d in sorted(groups)]
    assert max(load.values()) == least_largest(ordered, n)
    return load


def invented(n, seed):
    rng = random.Random(seed)
    texts = ["".join(rng.choice("abé \n") for _ in range(rng.choice([0, 5, 40, 300]))) for _ in range(n)]
    return list(enumerate(texts))


@pytest.mark.parametrize("options", [{}, {"first_digits": 1, "most_split": 3, "bin_rows": 7}, {"first_digits": 1}])
def test_shards_equal_the_plain_search(spark, options):
    rows = invented(400, 1) + [(k, "hot " * 20) for k in range(150)] + [(None, None), (7, "x" * 3000), (7, "x" * 3000), (5, None)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    clash = frame.select("*", F.lit("kept").alias("digest"), F.lit(1).alias("bin"), F.lit(2).alias("slot"), F.lit(3).alias("id"))
    for n in (1, 7, 40):
        out = sharding.put(clash, n, **options)
        assert out.columns == ["doc_id", "digest", "bin", "id", *sharding.RESULTS]
        got = out.collect()
        load = check(rows, got, n)
        assert len(load) == n or options
        assert {(r["digest"], r["bin"], r["id"]) for r in got} == {("kept", 1, 3)}
        of_text = defaultdict(set)
        for r in got:
            of_text[r["text_crc32"], r["size"]].add(r["shard"])
        assert all(len(s) == 1 for s in of_text.values())


def test_shards_share_what_a_large_group_leaves(spark):
    rows = [(k, f"{k} " + "w" * 100) for k in range(900)] + [(k, "copy " * 20) for k in range(900, 1350)]
    load = check(rows, sharding.put(spark.createDataFrame(rows, "doc_id bigint, text string")).collect(), 40)
    rest = sorted(load.values())[:-1]
    assert len(load) == 40 and max(rest) <= 1.5 * min(rest)


def test_shards_of_few_or_no_rows(spark):
    frame = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "doc_id bigint, text string")
    got = sharding.put(frame, 5).collect()
    check([(1, "a"), (2, "b"), (3, "a")], got, 5)
    assert sharding.put(frame.limit(0), 5).count() == 0


def test_search_over_cells_is_exact():
    rng = random.Random(4)
    for _ in range(300):
        n, sizes = rng.randrange(1, 9), [rng.choice([1, 2, 3, 50, 200]) for _ in range(rng.randrange(1, 60))]
        names = sorted(rng.sample([f"{k:03x}" for k in range(4096)], len(sizes)))
        rows, digits = dict(zip(names, sizes)), 1

        def cell_rows(keys=None, width=1):
            out = defaultdict(lambda: [0, 0])
            for name, s in rows.items():
                if keys is None or any(name.startswith(k) for k in keys):
                    cell = out[name[:width]]
                    cell[0], cell[1] = cell[0] + s, cell[1] + 1
            return [(k, s, c) for k, (s, c) in out.items()]

        cells = sharding.Cells.of(cell_rows())
        while True:
            low, high = (sharding.least_capacity(cells, n, inside) for inside in (True, False))
            assert low <= least_largest(sizes, n) <= high
            if low == high:
                break
            chosen = sharding.undecided(cells, low, high, n)[:2]
            assert chosen
            kept = cells.without(set(chosen))
            more = [r for c in chosen for r in cell_rows([cells.keys[c]], len(cells.keys[c]) + 1)]
            cells = sharding.Cells.of(kept + more)
        begins = sharding.cuts(cells, high, n)
        load = Counter()
        for name, s in rows.items():
            load[sum(name >= b for b in begins)] += s
        assert max(load.values()) == high and np.all(np.diff([int(b.ljust(3, "0"), 16) for b in begins]) >= 0)
