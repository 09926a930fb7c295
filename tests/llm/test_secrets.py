"""The secret scan's ownership rule against a plain version, and texts with very many spans."""

import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from bitfold.llm import secrets
from tests.llm import brute

OPAQUE = re.compile(r"[A-Za-z0-9+/_-]+")


def plain(rows):
    """doc rows (doc_id, source, text) -> sorted (doc_id, spans, n_owned, n_example)."""
    held, owners, repositories = [], defaultdict(set), defaultdict(set)
    for doc_id, source, text in rows:
        base = []
        for kind, (_, pattern, group, least) in enumerate(brute.PATTERNS):
            base += [(m.start(), kind, m.end(), m.group(group)) for m in pattern.finditer(text or "") if len(m.group(group)) >= least]
        new = [
            (m.start(), 3, m.end(), m.group()) for m in OPAQUE.finditer(text or "")
            if len(m.group()) >= 20 and re.search("[0-9]", m.group()) and re.search("[A-Za-z]", m.group())
            and not any(b[0] < m.end() and m.start() < b[2] for b in base)
        ]
        held.append((doc_id, base, new))
        for *_, value in base + new:
            owners[value].add(source)
            repositories[value].add((source, doc_id))
    common = {v for v in owners if len(owners[v]) > 2 or len(repositories[v]) > 20}
    out = []
    for doc_id, base, new in held:
        owned = [s for s in new if s[3] not in common and len(set(s[3])) >= 11]
        line = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b, _ in sorted(base + owned))
        out.append((doc_id, line, len(owned), sum(s[3] in common for s in base)))
    return sorted(out, key=str)


def test_secret_ownership_equals_plain_counts(spark):
    rng = random.Random(9)
    draw = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    values = [draw("abcdefghijkXYZ0123456789+/_-", rng.randrange(15, 40)) for _ in range(40)]
    values += [draw("0123456789abcdef", 30) for _ in range(10)] + ["AKIA" + draw("ABCXYZ0123456789", rng.choice([15, 16, 20])) for _ in range(9)]
    values += ["a1" * 15, "token=" + "é", "secret : 'abc"]
    rows = []
    for k in range(150):
        words = [rng.choice(["see", "password: ", "api_key=", "", "é\U0001d11e", "token='"]) + rng.choice(values[: rng.randrange(1, len(values) + 1)])
                 for _ in range(rng.randrange(12))]
        rows.append((k, rng.choice(["s1", "s2", None, "s3"]), rng.choice([" ", ",", "\n", "/"]).join(words)))
    rows += [(200, None, None), (None, "s1", "password=abcdefgh"), (3, "s1", rows[3][2]), (3, "s1", rows[3][2])]
    frame = spark.createDataFrame(rows, "doc_id bigint, source string, text string").repartition(5)
    clash = frame.withColumns({c: F.lit("kept") for c in ("number", "others", "matches", "hash", "kind", "spans")})
    out = secrets.report(clash)
    assert out.columns == ["doc_id", "source", "number", "others", "matches", "hash", "kind", *secrets.RESULTS]
    got = sorted(((r["doc_id"], r["spans"], r["n_owned"], r["n_example"]) for r in out.collect()), key=str)
    assert got == plain(rows)
    assert any(r[2] for r in got) and any(r[3] for r in got)
    assert secrets.report(frame.limit(0)).count() == 0


def test_text_with_a_hundred_thousand_spans(spark):
    rng = random.Random(2)
    values = ["%024x" % rng.getrandbits(96) for _ in range(60_000)] + [f"Zz{rng.getrandbits(120):030x}-QWERTYUIOPAS" for _ in range(40_000)]
    text = " ".join(values)
    r = secrets.report(spark.createDataFrame([(1, "a", text), (2, "a", "no")], "doc_id bigint, source string, text string")).collect()
    found = {x["doc_id"]: x for x in r}
    assert found[1]["n_hex"] >= 60_000 and found[1]["n_hex"] + found[1]["n_owned"] >= 100_000 and found[2]["spans"] == ""
