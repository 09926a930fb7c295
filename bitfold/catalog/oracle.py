"""Plain SQL for every registered query, written for brute force.

All pairs are compared row by row here; nothing of the library's pruning, copy classes or
packed words is reused, only its hash constants and parameters.
"""

from __future__ import annotations

import math

from bitfold.catalog.datasets import SEED, TRAIN_RATIO
from bitfold.catalog.queries import (
    ERROR_CELLS, ERROR_THRESHOLDS, FIND_CELLS, FIND_THRESHOLDS, GRID_CELLS, GRID_THRESHOLDS, HAMMING_RADIUS,
    LANE_LENGTHS, LANE_THRESHOLDS, LOW_CELLS, LOW_QUERIES, LOW_THRESHOLDS, PARITY_RADIUS, SHARE, SHARE_THRESHOLDS, SIGN_CELLS, SIGN_GRID_THRESHOLDS, SIGN_RADIUS, SIGN_THRESHOLDS,
    TOP,
)
from bitfold.functions.hashing import MASK32, MIX_FACTOR, PRIME31, seed_constant
from bitfold.functions.lanes import GAUSS_SCALE
from bitfold.functions.scores import PERFECT_MINUS_LOG_MSE
from bitfold.operators.encode import ENGLISH_STOP_WORDS, TOKEN_PATTERN
from bitfold.operators.profile import REPORT_THRESHOLDS, SUGGESTED_RATIOS
from bitfold.operators.sketches import MinHash, SimHash
from bitfold.plans.accuracy import DEFAULT_LENGTHS

TINY = 1e-10


def dbl(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)"


def mix(x: str) -> str:
    for _ in range(2):
        x = f"((xor({x}, ({x}) >> 16) * {MIX_FACTOR}) & {MASK32})"
    return f"xor({x}, ({x}) >> 16)"


def h32(column: str, seed: int, purpose: str) -> str:
    low = f"(xor({column}, {column} >> 32) & {MASK32})"
    return mix(f"xor({low}, {seed_constant(seed, purpose)}::BIGINT)")


def h63(column: str, seed: int, purpose: str) -> str:
    return f"({h32(column, seed, purpose)} * {1 << 31} + ({h32(column, seed, purpose + '-low')} >> 1))"


STOP = ", ".join(f"'{w}'" for w in ENGLISH_STOP_WORDS)

DOCUMENTS = f"""
tok AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '{TOKEN_PATTERN}'))) AS term
        FROM documents),
kept AS (SELECT * FROM tok WHERE term NOT IN ({STOP})),
vocab AS (SELECT row_number() OVER (ORDER BY term) - 1 AS feature_id, term, df
          FROM (SELECT term, count(*) AS df FROM kept GROUP BY term HAVING count(*) >= 2)),
docs AS (SELECT doc_id FROM documents),
items AS MATERIALIZED (SELECT doc_id, feature_id FROM kept JOIN vocab USING (term))"""

CUSTOMERS = """
docs AS (SELECT c_custkey AS doc_id FROM customer),
vocab AS (SELECT p_partkey AS feature_id FROM part),
items AS MATERIALIZED (SELECT DISTINCT o_custkey AS doc_id, l_partkey AS feature_id
          FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"""


def split(name: str = "side", seed: int = SEED) -> str:
    return f"""
{name} AS (SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY {h32('doc_id', seed, 'split')}, doc_id) - 1
                < floor(count(*) OVER () * {dbl(TRAIN_RATIO)}) THEN 'train' ELSE 'query' END AS side FROM docs)"""


# representative of each group of equal sets
REPS = """
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS card FROM items GROUP BY doc_id),
prints AS (SELECT docs.doc_id, coalesce(string_agg(feature_id::VARCHAR, ',' ORDER BY feature_id), '') AS fp
           FROM docs LEFT JOIN items USING (doc_id) GROUP BY docs.doc_id),
reps AS MATERIALIZED (SELECT doc_id, min(doc_id) OVER (PARTITION BY fp) AS rep FROM prints)"""

# exact overlap of every pair of different rows that share a feature
OVERLAPS = """
common_items AS MATERIALIZED (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS overlap
    FROM items a JOIN items b ON a.feature_id = b.feature_id AND a.doc_id < b.doc_id GROUP BY 1, 2)"""


def exact(similarity: str, o: str = "overlap", a: str = "cx", b: str = "cy") -> str:
    return {
        "inner_product": f"{o}::DOUBLE",
        "hamming_distance": f"({a} + {b} - 2 * {o})::DOUBLE",
        "jaccard_similarity": f"CASE WHEN {a} + {b} - {o} = 0 THEN 0 ELSE {o}::DOUBLE / ({a} + {b} - {o}) END",
        "cosine_similarity": f"CASE WHEN {a} * {b} = 0 THEN 0 ELSE {o}::DOUBLE / sqrt(({a} * {b})::DOUBLE) END",
    }[similarity]


def all_pairs(similarity: str) -> str:
    """pair(x, y, overlap, cx, cy, sim): one row per row pair that shares a feature."""
    return f"""{OVERLAPS},
pair AS MATERIALIZED (SELECT x, y, overlap, sx.card AS cx, sy.card AS cy,
        {exact(similarity, 'overlap', 'sx.card', 'sy.card')} AS sim
    FROM common_items JOIN sizes sx ON sx.doc_id = x JOIN sizes sy ON sy.doc_id = y)"""


def class_pairs(similarity: str, threshold: float) -> str:
    """cp(i, j, overlap, card_i, card_j, n_pairs, sim) above the threshold."""
    return f"""{REPS}, {all_pairs(similarity)},
cp AS MATERIALIZED (SELECT least(rx.rep, ry.rep) AS i, greatest(rx.rep, ry.rep) AS j, overlap,
        CASE WHEN rx.rep <= ry.rep THEN cx ELSE cy END AS card_i,
        CASE WHEN rx.rep <= ry.rep THEN cy ELSE cx END AS card_j, count(*) AS n_pairs, sim
    FROM pair JOIN reps rx ON rx.doc_id = x JOIN reps ry ON ry.doc_id = y
    WHERE sim > {dbl(threshold)} GROUP BY ALL)"""


def query_train_pairs(similarity: str) -> str:
    """qt(q, t, sim): every query row against every train row that shares a feature."""
    return f"""{REPS}, {all_pairs(similarity)}, {split()},
qt AS MATERIALIZED (
    SELECT CASE WHEN a.side = 'query' THEN x ELSE y END AS q, CASE WHEN a.side = 'query' THEN y ELSE x END AS t, sim
    FROM pair JOIN side a ON a.doc_id = x JOIN side b ON b.doc_id = y WHERE a.side <> b.side)"""


# ---- sketches, tall ----


def binsketch_buckets(k: int) -> str:
    return f"""
bmap AS (SELECT feature_id, (row_number() OVER (ORDER BY {h32('feature_id', SEED, 'binsketch')}, feature_id) - 1) % {k}
         AS bucket FROM vocab),
bits AS MATERIALIZED (SELECT DISTINCT doc_id, bucket FROM items JOIN bmap USING (feature_id))"""


def bcs_buckets(k: int) -> str:
    return f"""
bits AS MATERIALIZED (SELECT doc_id, bucket FROM
        (SELECT doc_id, {h32('feature_id', SEED, 'bcs')} % {k} AS bucket FROM items)
        GROUP BY doc_id, bucket HAVING count(*) % 2 = 1)"""


def minhash_lanes(k: int) -> str:
    rows = ", ".join(f"({h}, {a}::BIGINT, {b}::BIGINT)" for h, (a, b) in enumerate(MinHash(SEED).coefficients(k)))
    return f"""
coef(lane, a, b) AS (VALUES {rows}),
lanes AS MATERIALIZED (SELECT docs.doc_id, lane, coalesce(min((a * feature_id + b) % {PRIME31}), 0) AS v
    FROM docs LEFT JOIN items USING (doc_id) CROSS JOIN coef GROUP BY docs.doc_id, lane)"""


def simhash_bits(k: int) -> str:
    rows = ", ".join(
        f"({p}, {ra}::BIGINT, {rb}::BIGINT, {ta}::BIGINT, {tb}::BIGINT)"
        for p, (ra, rb, ta, tb) in enumerate(SimHash(SEED).coefficients(k))
    )
    p = dbl(float(PRIME31))
    return f"""
coef(p, ra, rb, ta, tb) AS (VALUES {rows}),
hashed AS (SELECT doc_id, {h32('feature_id', SEED, 'simhash')} % {PRIME31} AS x FROM items),
gauss AS (SELECT doc_id, p, sqrt({dbl(-2.0)} * ln(((ra * x + rb) % {PRIME31} + 1)::DOUBLE / {p})) AS radius,
        {dbl(2 * math.pi)} * (((ta * x + tb) % {PRIME31})::DOUBLE / {p}) AS angle FROM hashed CROSS JOIN coef),
sums AS (SELECT doc_id, p, sum(round_even(radius * cos(angle) * {dbl(GAUSS_SCALE)}, 0)::BIGINT) AS c,
        sum(round_even(radius * sin(angle) * {dbl(GAUSS_SCALE)}, 0)::BIGINT) AS s FROM gauss GROUP BY doc_id, p),
grid AS (SELECT doc_id, p, coalesce(c, 0) AS c, coalesce(s, 0) AS s
         FROM (SELECT doc_id, p FROM docs CROSS JOIN coef) LEFT JOIN sums USING (doc_id, p)),
bits AS MATERIALIZED (SELECT doc_id, bucket FROM (
        SELECT doc_id, 2 * p AS bucket, c AS v FROM grid UNION ALL SELECT doc_id, 2 * p + 1, s FROM grid)
    WHERE v >= 0 AND bucket < {k})"""


SKETCH = {"BinSketch": binsketch_buckets, "BCS": bcs_buckets, "MinHash": minhash_lanes, "SimHash": simhash_bits}


def words(k: int) -> str:
    return f"""
word_ids AS (SELECT unnest(range({-(-k // 63)}))::BIGINT AS word),
packed AS (SELECT doc_id, bucket // 63 AS word, sum(1::BIGINT << (bucket % 63)::INTEGER)::BIGINT AS bits
           FROM bits GROUP BY 1, 2)
SELECT doc_id, word, coalesce(bits, 0)::BIGINT AS bits
FROM (SELECT doc_id, word FROM docs CROSS JOIN word_ids) LEFT JOIN packed USING (doc_id, word)"""


def bit_stats(pairs: str, x: str, y: str) -> str:
    """stat(x, y, c1, c2, common): bit counts of each sketch of a pair."""
    return f"""
cards AS (SELECT docs.doc_id, count(bucket) AS c FROM docs LEFT JOIN bits USING (doc_id) GROUP BY docs.doc_id),
wanted AS (SELECT DISTINCT {x} AS x, {y} AS y FROM {pairs}),
commons AS (SELECT x, y, count(*) AS common FROM wanted JOIN bits a ON a.doc_id = x
            JOIN bits b ON b.doc_id = y AND b.bucket = a.bucket GROUP BY x, y),
stat AS MATERIALIZED (SELECT w.x, w.y, p.c AS c1, q.c AS c2, coalesce(common, 0) AS common FROM wanted w
    JOIN cards p ON p.doc_id = w.x JOIN cards q ON q.doc_id = w.y LEFT JOIN commons m ON m.x = w.x AND m.y = w.y)"""


def lane_stats(pairs: str, x: str, y: str) -> str:
    return f"""
wanted AS (SELECT DISTINCT {x} AS x, {y} AS y FROM {pairs}),
stat AS MATERIALIZED (SELECT x, y, count_if(a.v = b.v) AS common FROM wanted JOIN lanes a ON a.doc_id = x
    JOIN lanes b ON b.doc_id = y AND b.lane = a.lane GROUP BY x, y)"""


def or_size(c: str, k: int) -> str:
    return f"(CASE WHEN {c} < {k} THEN round_even(ln({dbl(1.0)} - {c} / {dbl(float(k))}) / {dbl(math.log(1 - 1 / k))}, 0) ELSE {c} END)::DOUBLE"


def estimated(algorithm: str, k: int) -> str:
    """est(x, y, inner_product, hamming_distance, jaccard_similarity, cosine_similarity) from stat."""
    if algorithm == "BinSketch":
        q = dbl(1 - 1 / k)
        return f"""
e1 AS (SELECT *, {or_size('c1', k)} AS s1, {or_size('c2', k)} AS s2 FROM stat),
e2 AS (SELECT *, power({q}, s1) + power({q}, s2) - 1 + common / {dbl(float(k))} AS val FROM e1),
e3 AS (SELECT *, CASE WHEN val > 0 THEN round_even(s1 + s2 - ln(val) / {dbl(math.log(1 - 1 / k))}, 0) END AS ip0 FROM e2),
e4 AS (SELECT *, CASE WHEN ip0 >= 0 THEN ip0 ELSE common::DOUBLE END AS ip FROM e3),
est AS MATERIALIZED (SELECT x, y, s1 AS size_i, s2 AS size_j, ip AS inner_product, s1 + s2 - 2 * ip AS hamming_distance,
    CASE WHEN s1 + s2 - ip = 0 THEN 0 ELSE ip / (s1 + s2 - ip) END AS jaccard_similarity,
    CASE WHEN s1 * s2 = 0 THEN 0 ELSE ip / (sqrt(s1) * sqrt(s2)) END AS cosine_similarity FROM e4)"""
    if algorithm == "BCS":
        return """
est AS MATERIALIZED (SELECT x, y, common::DOUBLE AS inner_product, (c1 + c2 - 2 * common)::DOUBLE AS hamming_distance,
    CASE WHEN c1 + c2 - common = 0 THEN 0 ELSE common::DOUBLE / (c1 + c2 - common) END AS jaccard_similarity,
    CASE WHEN c1 * c2 = 0 THEN 0 ELSE common / (sqrt(c1::DOUBLE) * sqrt(c2::DOUBLE)) END AS cosine_similarity FROM stat)"""
    if algorithm == "MinHash":
        return f"""
est AS MATERIALIZED (SELECT x, y, j AS jaccard_similarity, CASE WHEN j > 0 THEN 2 * j / (1 + j) ELSE 0 END AS cosine_similarity
    FROM (SELECT x, y, common / {dbl(float(k))} AS j FROM stat))"""
    return f"""
est AS MATERIALIZED (SELECT x, y, ham::DOUBLE AS hamming_distance, cos({dbl(math.pi)} * (ham / {dbl(float(k))})) AS cosine_similarity
    FROM (SELECT x, y, c1 + c2 - 2 * common AS ham FROM stat))"""


def estimates(algorithm: str, k: int, pairs: str, x: str, y: str) -> str:
    stats = lane_stats if algorithm == "MinHash" else bit_stats
    return f"{SKETCH[algorithm](k)}, {stats(pairs, x, y)}, {estimated(algorithm, k)}"


def r6(expression: str, name: str) -> str:
    return f"round({expression}, 6) AS {name}"


# ---- query texts ----


def _estimate_query(algorithm: str, k: int, similarities: list[str]) -> str:
    sizes = "size_i, size_j, " if algorithm == "BinSketch" else ""
    columns = ", ".join(r6(f"est.{s}", s) for s in similarities)
    return f"""WITH {DOCUMENTS}, {class_pairs('jaccard_similarity', 0.1)}, {estimates(algorithm, k, 'cp', 'i', 'j')}
SELECT i, j, n_pairs, {sizes}{columns} FROM cp JOIN est ON est.x = i AND est.y = j"""


def _pair_query(sets: str, similarity: str, threshold: float) -> str:
    return f"""WITH {sets}, {class_pairs(similarity, threshold)}
SELECT i, j, overlap, card_i, card_j, n_pairs, {r6('sim', 'sim')} FROM cp"""


def _top_query(sets: str, similarity: str) -> str:
    return f"""WITH {sets}, {class_pairs(similarity, 0.0)}
SELECT i, j, overlap, card_i, card_j, n_pairs, {r6('s', 'sim')} FROM (SELECT *, sim AS s FROM cp ORDER BY sim DESC, i, j LIMIT {TOP})"""


def _by_class(pairs: str, value: str, threshold: float, compared: str = ">=") -> str:
    return f"""SELECT rq.rep AS i, rt.rep AS j, count(*) AS n_pairs, {r6(value, value)}
FROM {pairs} JOIN reps rq ON rq.doc_id = q JOIN reps rt ON rt.doc_id = t
WHERE {value} {compared} {dbl(threshold)} GROUP BY rq.rep, rt.rep, {value}"""


def found_pairs(algorithm: str, k: int, similarity: str) -> str:
    """fp(q, t, est): every query row against every train row."""
    return f"""everyone AS (SELECT a.doc_id AS q, b.doc_id AS t FROM side a JOIN side b ON a.side = 'query' AND b.side = 'train'),
{estimates(algorithm, k, 'everyone', 'q', 't')},
fp AS MATERIALIZED (SELECT x AS q, y AS t, {similarity} AS est FROM est)"""


def _found_query(algorithm: str, k: int, similarity: str, threshold: float) -> str:
    return f"""WITH {DOCUMENTS}, {REPS}, {split()}, {found_pairs(algorithm, k, similarity)}
{_by_class('fp', 'est', threshold, "<=" if similarity == "hamming_distance" else ">=")}"""


def _outcomes(algorithm: str, k: int, similarity: str, thresholds: list[float]) -> str:
    """outcome(threshold, q, tp, fp, fn) with a row for every query row."""
    steps = ", ".join(f"({dbl(t)})" for t in thresholds)
    return f"""{DOCUMENTS}, {query_train_pairs(similarity)}, {found_pairs(algorithm, k, similarity)},
steps(threshold) AS (VALUES {steps}),
outcome AS (SELECT threshold, fp.q,
        count_if(coalesce(sim, 0) >= threshold AND est >= threshold) AS tp,
        count_if(coalesce(sim, 0) < threshold AND est >= threshold) AS fp,
        count_if(coalesce(sim, 0) >= threshold AND est < threshold) AS fn
    FROM fp LEFT JOIN qt ON qt.q = fp.q AND qt.t = fp.t CROSS JOIN steps GROUP BY threshold, fp.q)"""


SCORES = {
    "precision": "CASE WHEN tp + fp = 0 THEN (CASE WHEN fn > 0 THEN 0.0 ELSE 1.0 END) ELSE tp / (tp + fp) END",
    "recall": "CASE WHEN tp + fn = 0 THEN 1.0 ELSE tp / (tp + fn) END",
    "f1": "CASE WHEN tp + fp + fn = 0 THEN 1.0 ELSE 2 * tp / (2 * tp + fp + fn) END",
    "accuracy": "CASE WHEN tp + fp + fn = 0 THEN 1.0 ELSE tp / (tp + fp + fn) END",
}


# every(sim): every pair of rows, those without a shared feature with 0
ALL_ROWS = """
every AS MATERIALIZED (SELECT coalesce(sim, 0)::DOUBLE AS sim FROM docs a JOIN docs b ON a.doc_id < b.doc_id
    LEFT JOIN pair ON x = a.doc_id AND y = b.doc_id)"""
ALL_QUERY_ROWS = """
every AS MATERIALIZED (SELECT coalesce(sim, 0)::DOUBLE AS sim FROM side a JOIN side b ON a.side = 'query' AND b.side = 'train'
    LEFT JOIN qt ON q = a.doc_id AND t = b.doc_id)"""


def compared(threshold: float) -> dict[str, str]:
    t = dbl(threshold)
    return {
        "ge": f"sim >= {t}", "gt": f"sim > {t}", "le": f"sim <= {t}", "lt": f"sim < {t}",
        "eq": f"abs(sim - {t}) <= {dbl(1e-8)} + {dbl(1e-5)} * abs({t})",
    }


def _reports_over_all(threshold: float) -> str:
    return " UNION ALL ".join(
        f"""SELECT {dbl(threshold)} AS threshold, '{c}' AS comparison, count(*) AS total_pairs, count_if({p})::BIGINT AS filtered_count,
{r6(f'count_if({p}) * 100.0::DOUBLE / count(*)', 'percentage')} FROM every""" for c, p in compared(threshold).items()
    )


def _thresholds_over_all(per_query: bool) -> str:
    steps = ", ".join(f"({dbl(t)})" for t in SHARE_THRESHOLDS)
    n_query = "(SELECT count(*) FROM side WHERE side = 'query')"
    mean = f", {r6(f'count_if(sim >= threshold)::DOUBLE / {n_query}', 'avg_neighbors')}" if per_query else ""
    return f"""SELECT threshold, count_if(sim >= threshold)::BIGINT AS n_at_least,
{r6('count_if(sim >= threshold) * 100.0::DOUBLE / count(*)', 'pct')}{mean}
FROM every CROSS JOIN (VALUES {steps}) AS s(threshold) GROUP BY threshold"""


PROFILE = f"""SELECT count(*) AS n_pairs, {r6('min(sim)', 'min_sim')}, {r6('max(sim)', 'max_sim')}, {r6('avg(sim)', 'mean_sim')},
{r6('median(sim)', 'median_sim')}, {r6('stddev_pop(sim)', 'std_sim')} FROM every"""


def _cells(body, cells, select: str) -> str:
    parts = [f"SELECT * FROM (WITH {body(a, k)} SELECT '{a}' AS algo, {k}::BIGINT AS k, {select})" for a, k in cells]
    return " UNION ALL ".join(parts)


def _retrieval_query(metric: str, similarity: str, thresholds, cells) -> str:
    select = (
        f"threshold, {r6('avg(score)', 'metric')}, {r6('stddev_pop(score)', 'metric_std')} "
        f"FROM (SELECT threshold, ({SCORES[metric]})::DOUBLE AS score FROM outcome) GROUP BY threshold"
    )
    return _cells(lambda a, k: _outcomes(a, k, similarity, thresholds), cells, select)


def _retrieval_grid_query(similarity: str, thresholds, cells) -> str:
    n_query = "(SELECT count(*) FROM side WHERE side = 'query')"
    select = (
        f"threshold, {r6(f'total_pairs::DOUBLE / {n_query}', 'avg_neighbors')}, "
        f"total_pairs, {r6('m', 'metric')}, {r6('s', 'metric_std')} FROM (SELECT threshold, avg(score) AS m, stddev_pop(score) AS s "
        f"FROM (SELECT threshold, ({SCORES['f1']})::DOUBLE AS score FROM outcome) GROUP BY threshold) "
        "JOIN (SELECT threshold, count(sim) AS total_pairs FROM steps LEFT JOIN qt ON sim >= threshold GROUP BY threshold) USING (threshold)"
    )
    return _cells(lambda a, k: _outcomes(a, k, similarity, thresholds), cells, select)


def _grid_body(similarity: str, lowest: float, thresholds):
    steps = ", ".join(f"({dbl(t)})" for t in thresholds)

    def body(algorithm: str, k: int) -> str:
        return f"""{DOCUMENTS}, {REPS}, {all_pairs(similarity)},
near AS MATERIALIZED (SELECT x AS i, y AS j, sim FROM pair WHERE sim > {dbl(lowest)}),
{estimates(algorithm, k, 'near', 'i', 'j')}, steps(threshold) AS (VALUES {steps}),
errors AS (SELECT threshold, count(*) AS n_pairs, avg(power(est.{similarity} - sim, 2)) AS mse
    FROM near JOIN est ON est.x = i AND est.y = j JOIN steps ON sim > threshold GROUP BY threshold)"""

    return body


def _minus_log(e: str) -> str:
    return f"CASE WHEN {e} = 0 THEN {dbl(PERFECT_MINUS_LOG_MSE)} ELSE -ln({e}) END"


def sampled(n: int, replacement: bool) -> str:
    """draws(pair_id, i, j)."""
    first = f"{h63('pair_id', SEED, 'pair-first')} % n"
    second = h63("pair_id", SEED, "pair-second")
    rj = f"{second} % n" if replacement else f"(({first}) + 1 + {second} % (n - 1)) % n"
    keep = "TRUE" if replacement else "pair_id < n * (n - 1) // 2"
    return f"""
ordered AS (SELECT doc_id, row_number() OVER (ORDER BY {h32('doc_id', SEED, 'pair-order')}, doc_id) - 1 AS r,
            count(*) OVER () AS n FROM docs),
total AS (SELECT max(n) AS n FROM ordered),
ids AS (SELECT unnest(range({n}))::BIGINT AS pair_id),
drawn AS (SELECT pair_id, {first} AS ri, {rj} AS rj FROM ids CROSS JOIN total WHERE {keep}),
draws AS MATERIALIZED (SELECT pair_id, a.doc_id AS i, b.doc_id AS j FROM drawn
    JOIN ordered a ON a.r = ri JOIN ordered b ON b.r = rj),
own AS (SELECT docs.doc_id, count(feature_id) AS card FROM docs LEFT JOIN items USING (doc_id) GROUP BY docs.doc_id),
met AS (SELECT pair_id, count(*) AS overlap FROM draws JOIN items a ON a.doc_id = i
        JOIN items b ON b.doc_id = j AND b.feature_id = a.feature_id GROUP BY pair_id),
listed AS MATERIALIZED (SELECT draws.*, coalesce(overlap, 0) AS overlap, p.card AS card_i, q.card AS card_j FROM draws
    LEFT JOIN met USING (pair_id) JOIN own p ON p.doc_id = i JOIN own q ON q.doc_id = j)"""


# apart(x, y, overlap, cx, cy): every pair of different rows, and how many features they share
APART = f"""{OVERLAPS},
own AS MATERIALIZED (SELECT docs.doc_id, count(feature_id) AS card FROM docs LEFT JOIN items USING (doc_id) GROUP BY docs.doc_id),
apart AS MATERIALIZED (SELECT a.doc_id AS x, b.doc_id AS y, coalesce(overlap, 0) AS overlap, a.card AS cx, b.card AS cy
    FROM own a JOIN own b ON a.doc_id < b.doc_id LEFT JOIN common_items m ON m.x = a.doc_id AND m.y = b.doc_id)"""
DISTANCE = "cx + cy - 2 * overlap"


def _near_sketches(algorithm: str, k: int, radius: int, two_sided: bool) -> str:
    """Every pair of rows by the bits in which their sketches differ; equal sketches under their smallest id."""
    body = f"""WITH {DOCUMENTS}, {SKETCH[algorithm](k)}, {split()},
marks AS (SELECT docs.doc_id, coalesce(string_agg(bucket::VARCHAR, ',' ORDER BY bucket), '') AS m, count(bucket) AS c
    FROM docs LEFT JOIN bits USING (doc_id) GROUP BY docs.doc_id),
named AS MATERIALIZED (SELECT doc_id, c, min(doc_id) OVER (PARTITION BY m) AS rep FROM marks),
shared_bits AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM bits a JOIN bits b
    ON a.bucket = b.bucket AND a.doc_id < b.doc_id GROUP BY 1, 2),
near AS (SELECT a.doc_id AS x, b.doc_id AS y, a.rep AS rx, b.rep AS ry, a.c + b.c - 2 * coalesce(common, 0) AS distance
    FROM named a JOIN named b ON a.doc_id < b.doc_id LEFT JOIN shared_bits s ON s.x = a.doc_id AND s.y = b.doc_id
    WHERE a.c + b.c - 2 * coalesce(common, 0) <= {radius})"""
    if two_sided:
        return f"""{body} SELECT CASE WHEN p.side = 'query' THEN rx ELSE ry END AS i, CASE WHEN p.side = 'query' THEN ry ELSE rx END AS j,
count(*) AS n_pairs, distance FROM near JOIN side p ON p.doc_id = x JOIN side q ON q.doc_id = y WHERE p.side <> q.side GROUP BY 1, 2, distance"""
    return f"{body} SELECT least(rx, ry) AS i, greatest(rx, ry) AS j, count(*) AS n_pairs, distance FROM near GROUP BY 1, 2, distance"


# random sets with as many rows, features and cells as the customers' sets
TWIN = f"""
shape AS (SELECT (SELECT count(*) FROM customer) AS n_rows, (SELECT count(*) FROM part) AS n_cols,
    (SELECT count(*) FROM (SELECT DISTINCT o_custkey, l_partkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey)) AS nnz),
draw_ids AS (SELECT unnest(range(2 * nnz + 64))::BIGINT AS id FROM shape),
cells AS (SELECT DISTINCT ((({h32('id', SEED, 'cell-high')}) & {(1 << 30) - 1}) * {1 << 32} + ({h32('id', SEED, 'cell-low')})) % (n_rows * n_cols) AS cell
    FROM draw_ids CROSS JOIN shape WHERE 2 * nnz <= n_rows * n_cols
    UNION ALL SELECT unnest(range(n_rows * n_cols))::BIGINT FROM shape WHERE 2 * nnz > n_rows * n_cols),
docs AS (SELECT unnest(range(n_rows))::BIGINT AS doc_id FROM shape),
vocab AS (SELECT unnest(range(n_cols))::BIGINT AS feature_id FROM shape),
items AS MATERIALIZED (SELECT cell // n_cols AS doc_id, cell % n_cols AS feature_id FROM
    (SELECT cell, row_number() OVER (ORDER BY {h32('cell', SEED, 'cells')}, cell) AS r FROM cells) CROSS JOIN shape WHERE r <= nnz)"""

ALL_FOUR = ("inner_product", "hamming_distance", "jaccard_similarity", "cosine_similarity")


def _sampled_errors(k: int, n: int, sets: str = CUSTOMERS) -> str:
    wanted = {
        "BinSketch": list(ALL_FOUR), "BCS": ["inner_product", "cosine_similarity"],
        "MinHash": ["jaccard_similarity"], "SimHash": ["hamming_distance", "cosine_similarity"],
    }
    parts = []
    for algorithm, metrics in wanted.items():
        for m in metrics:
            true = exact(m, "overlap", "card_i", "card_j")
            parts.append(f"""SELECT * FROM (WITH {sets}, {sampled(n, True)}, {estimates(algorithm, k, 'listed', 'i', 'j')},
miss AS (SELECT abs(est.{m} - ({true})) AS e, abs({true}) AS t FROM listed JOIN est ON est.x = i AND est.y = j)
SELECT '{algorithm}' AS algorithm, '{m}' AS metric, {r6('avg(e * e)', 'mse')}, {r6('avg(e)', 'mae')}, {r6('max(e)', 'max_error')},
{r6(f'avg(e / (t + {dbl(TINY)})) * {dbl(TINY)}', 'relative_error')},
{r6(f'(SELECT count(*) FROM part) / {dbl(float(k))}', 'compression_ratio')},
(SELECT count(*) FROM customer) AS matrix_rows, (SELECT count(*) FROM part) AS matrix_cols, {k}::BIGINT AS sketch_size FROM miss)""")
    return " UNION ALL ".join(parts)


def oracle_sql() -> dict[str, str]:
    truth = f"WITH {DOCUMENTS}, {class_pairs('jaccard_similarity', 0.1)}"
    qt = f"WITH {DOCUMENTS}, {query_train_pairs('jaccard_similarity')}"
    steps = ", ".join(f"({dbl(t)})" for t in FIND_THRESHOLDS)
    grid_cells = [(a, k) for a, ks in ERROR_CELLS.items() for k in ks]
    grid = _grid_body("jaccard_similarity", min(ERROR_THRESHOLDS), ERROR_THRESHOLDS)
    compare = {
        "ge": "sim >= t", "gt": "sim > t", "le": "sim <= t", "lt": "sim < t",
        "eq": f"abs(sim - t) <= {dbl(1e-8)} + {dbl(1e-5)} * abs(t)",
    }
    reports = " UNION ALL ".join(
        f"""SELECT {dbl(0.5)} AS threshold, '{c}' AS comparison, sum(n_pairs)::BIGINT AS total_pairs,
sum(CASE WHEN {p} THEN n_pairs ELSE 0 END)::BIGINT AS filtered_count,
{r6(f'sum(CASE WHEN {p} THEN n_pairs ELSE 0 END) * 100.0::DOUBLE / sum(n_pairs)', 'percentage')}
FROM (SELECT *, {dbl(0.5)} AS t FROM cp)""" for c, p in compare.items()
    )
    report_steps = ", ".join(f"({dbl(t)})" for t in REPORT_THRESHOLDS)
    max_sim = f"WITH {CUSTOMERS}, {sampled(1000, False)}, top AS (SELECT max(overlap)::DOUBLE AS max_sim FROM listed)"
    ratios = ", ".join(f"({dbl(r)})" for r in SUGGESTED_RATIOS)
    errors = _sampled_errors(50, 200)
    bought = f"WITH {CUSTOMERS}"
    every = f"{bought}, {REPS}, {all_pairs('jaccard_similarity')}, {ALL_ROWS}"
    bought_qt = f"{bought}, {query_train_pairs('jaccard_similarity')}"
    return {
        "vocab_min_df": f"WITH {DOCUMENTS} SELECT feature_id, term, df FROM vocab",
        "items_binary": f"WITH {DOCUMENTS} SELECT doc_id, feature_id FROM items",
        "items_customers": f"{bought} SELECT doc_id, feature_id FROM items",
        "binarize_discounts": "SELECT DISTINCT l_orderkey AS doc_id, l_partkey AS feature_id FROM lineitem WHERE l_discount <> 0",
        "binary_check": f"""SELECT count(*) AS n_cells, {r6('min(l_discount)', 'min_value')}, {r6('max(l_discount)', 'max_value')},
count_if(l_discount NOT IN (0, 1))::BIGINT AS n_not_binary FROM lineitem""",
        "coo_export": f'WITH {DOCUMENTS} SELECT doc_id + 1 AS "docID", feature_id + 1 AS "wordID", 1::BIGINT AS count FROM items',
        "doc_sets": f"""{bought} SELECT doc_id, 0::BIGINT AS chunk, count(*) AS n_items,
string_agg(feature_id::VARCHAR, ' ' ORDER BY feature_id) AS features FROM items GROUP BY doc_id""",
        "row_items": f"{bought} SELECT feature_id FROM items WHERE doc_id = 1",
        "summary": f"""WITH {DOCUMENTS}, n AS (SELECT (SELECT count(*) FROM docs) AS d, (SELECT count(*) FROM vocab) AS w, (SELECT count(*) FROM items) AS c)
SELECT d AS n_docs, w AS n_words, c AS nnz, {r6('c::DOUBLE / d', 'avg_words_per_doc')}, {r6('(1 - c::DOUBLE / (d::DOUBLE * w)) * 100', 'sparsity_pct')} FROM n""",
        "corner_preview": f"""{bought}, cols AS (SELECT unnest(range(10))::BIGINT AS feature_id)
SELECT d.doc_id, string_agg(CASE WHEN i.doc_id IS NULL THEN '0' ELSE '1' END, '' ORDER BY cols.feature_id) AS bits
FROM (SELECT doc_id FROM docs WHERE doc_id < 5) d CROSS JOIN cols
LEFT JOIN items i ON i.doc_id = d.doc_id AND i.feature_id = cols.feature_id GROUP BY d.doc_id""",
        "first_documents": f"{bought} SELECT doc_id, feature_id FROM items WHERE doc_id < 500",
        "docword_roundtrip": f"WITH {DOCUMENTS} SELECT doc_id, feature_id FROM items",
        "split_sides": f"{bought}, {split()} SELECT doc_id, side FROM side",
        "split_validity": f"""{bought}, {split('a', SEED)}, {split('b', SEED + 1)}
SELECT 'same' AS saved, 0::BIGINT AS n_differences, TRUE AS is_same UNION ALL
SELECT 'other', 2 * count_if(a.side <> b.side)::BIGINT, count_if(a.side <> b.side) = 0 FROM a JOIN b USING (doc_id)""",
        "binsketch_map_balance": f"""WITH {DOCUMENTS}, {binsketch_buckets(333)}
SELECT bucket, count(*) AS n_features, sum(feature_id)::BIGINT AS feature_sum FROM bmap GROUP BY bucket""",
        "bcs_map": f"WITH {DOCUMENTS} SELECT feature_id, {h32('feature_id', SEED, 'bcs')} % 256 AS bucket FROM vocab",
        "binsketch_sketch": f"WITH {DOCUMENTS}, {binsketch_buckets(256)}, {words(256)}",
        "binsketch_sketch_long": f"WITH {CUSTOMERS}, {binsketch_buckets(2000)}, {words(2000)}",
        "bcs_sketch": f"WITH {DOCUMENTS}, {bcs_buckets(256)}, {words(256)}",
        "bcs_sketch_long": f"WITH {CUSTOMERS}, {bcs_buckets(2000)}, {words(2000)}",
        "minhash_signature": f"WITH {DOCUMENTS}, {minhash_lanes(64)} SELECT doc_id, lane::BIGINT AS word, v AS bits FROM lanes",
        "simhash_sketch": f"WITH {DOCUMENTS}, {simhash_bits(128)}, {words(128)}",
        "binsketch_estimates": _estimate_query("BinSketch", 1000, list(ALL_FOUR)),
        "bcs_estimates": _estimate_query("BCS", 1000, list(ALL_FOUR)),
        "minhash_estimates": _estimate_query("MinHash", 64, ["jaccard_similarity", "cosine_similarity"]),
        "simhash_estimates": _estimate_query("SimHash", 128, ["hamming_distance", "cosine_similarity"]),
        "exact_jaccard": _pair_query(DOCUMENTS, "jaccard_similarity", 0.1),
        "truth_after_append": _pair_query(DOCUMENTS, "jaccard_similarity", 0.1),
        "exact_cosine": _pair_query(DOCUMENTS, "cosine_similarity", 0.3),
        "exact_inner_product": _pair_query(CUSTOMERS, "inner_product", 2),
        "exact_hamming": f"{truth} SELECT i, j, n_pairs, (card_i + card_j - 2 * overlap)::DOUBLE AS hamming_distance FROM cp",
        "exact_pair_list": f"""{bought}, {sampled(500, True)} SELECT pair_id, i, j, overlap, card_i, card_j,
{', '.join(r6(exact(s, 'overlap', 'card_i', 'card_j'), s) for s in ALL_FOUR)} FROM listed""",
        "hamming_pairs": f"""WITH {DOCUMENTS}, {REPS}, {APART}
SELECT least(p.rep, q.rep) AS i, greatest(p.rep, q.rep) AS j, overlap, CASE WHEN p.rep <= q.rep THEN cx ELSE cy END AS card_i,
CASE WHEN p.rep <= q.rep THEN cy ELSE cx END AS card_j, count(*) AS n_pairs, {DISTANCE} AS distance
FROM apart JOIN reps p ON p.doc_id = x JOIN reps q ON q.doc_id = y WHERE {DISTANCE} <= {HAMMING_RADIUS} GROUP BY ALL""",
        "hamming_pairs_queries": f"""WITH {DOCUMENTS}, {REPS}, {APART}, {split()}
SELECT CASE WHEN a.side = 'query' THEN p.rep ELSE q.rep END AS i, CASE WHEN a.side = 'query' THEN q.rep ELSE p.rep END AS j,
count(*) AS n_pairs, {DISTANCE} AS distance FROM apart JOIN reps p ON p.doc_id = x JOIN reps q ON q.doc_id = y
JOIN side a ON a.doc_id = x JOIN side b ON b.doc_id = y WHERE a.side <> b.side AND {DISTANCE} <= {HAMMING_RADIUS} GROUP BY 1, 2, 4""",
        "hamming_neighbors": f"""WITH {DOCUMENTS}, {APART}, near AS (SELECT x, y FROM apart WHERE {DISTANCE} <= {HAMMING_RADIUS})
SELECT docs.doc_id, count(o) AS n_near FROM docs LEFT JOIN (SELECT x AS d, y AS o FROM near UNION ALL SELECT y, x FROM near) ON d = doc_id
GROUP BY docs.doc_id""",
        "hamming_sketch_pairs": _near_sketches(*SIGN_RADIUS, False),
        "hamming_sketch_pairs_bcs": _near_sketches(*PARITY_RADIUS, False),
        "hamming_sketch_pairs_queries": _near_sketches(*SIGN_RADIUS, True),
        "query_train_exact": f"{qt} {_by_class('qt', 'sim', min(FIND_THRESHOLDS))}",
        "query_train_binsketch": _found_query("BinSketch", 1000, "jaccard_similarity", 0.2),
        "query_train_bcs": _found_query("BCS", 1000, "jaccard_similarity", 0.2),
        "query_train_minhash": _found_query("MinHash", 64, "jaccard_similarity", 0.2),
        "query_train_simhash": _found_query("SimHash", 128, "cosine_similarity", 0.8),
        **{name: _found_query(a, k, similarity, t) for name, (a, similarity, t, k) in LOW_QUERIES.items()},
        "retrieval_grid_low": _retrieval_grid_query("jaccard_similarity", LOW_THRESHOLDS, LOW_CELLS),
        "filter_reports": f"{truth} {reports}",
        "filter_pairs": f"{truth} SELECT i, j, {r6('sim', 'sim')} FROM cp WHERE sim > {dbl(0.15)}",
        "filter_retrieval": f"""{qt} SELECT rq.rep AS query_id, rt.rep AS train_idx, {r6('sim', 'similarity')}, count(*) AS n_pairs
FROM qt JOIN reps rq ON rq.doc_id = q JOIN reps rt ON rt.doc_id = t WHERE sim >= {dbl(0.5)} GROUP BY rq.rep, rt.rep, sim""",
        "neighbors_grid": f"""{qt}, steps(threshold) AS (VALUES {steps})
SELECT threshold, rq.rep AS i, rt.rep AS j, count(*) AS n_pairs, {r6('sim', 'sim')} FROM qt JOIN steps ON sim >= threshold
JOIN reps rq ON rq.doc_id = q JOIN reps rt ON rt.doc_id = t GROUP BY threshold, rq.rep, rt.rep, sim""",
        "neighbors_summary": f"""{qt}, steps(threshold) AS (VALUES {steps})
SELECT threshold, {r6("count(sim)::DOUBLE / (SELECT count(*) FROM side WHERE side = 'query')", 'avg_neighbors')}, count(sim) AS total_pairs
FROM steps LEFT JOIN qt ON sim >= threshold GROUP BY threshold""",
        "truth_profile": f"""WITH {DOCUMENTS}, {REPS}, {all_pairs('jaccard_similarity')}
SELECT count(*) AS n_pairs, {r6('min(sim)', 'min_sim')}, {r6('max(sim)', 'max_sim')}, {r6('avg(sim)', 'mean_sim')},
{r6('median(sim)', 'median_sim')}, {r6('stddev_pop(sim)', 'std_sim')} FROM pair WHERE sim > {dbl(0.1)}""",
        "truth_thresholds": f"""WITH {DOCUMENTS}, {REPS}, {all_pairs('jaccard_similarity')}, near AS (SELECT sim FROM pair WHERE sim > {dbl(0.1)}),
steps(threshold) AS (VALUES {report_steps})
SELECT threshold, count_if(sim >= threshold)::BIGINT AS n_at_least, {r6('count_if(sim >= threshold) * 100.0::DOUBLE / count(*)', 'pct')}
FROM near CROSS JOIN steps GROUP BY threshold""",
        "max_similarity_sampled": f"{max_sim} SELECT {r6('max_sim', 'max_sim')} FROM top",
        "max_similarity_exact": f"{bought}, {OVERLAPS} SELECT {r6('max(overlap)::DOUBLE', 'max_sim')} FROM common_items",
        "thresholds_exact": f"""{bought}, {OVERLAPS}, ratios(ratio) AS (VALUES {ratios})
SELECT ratio, {r6('ratio * m', 'threshold')} FROM (SELECT max(overlap)::DOUBLE AS m FROM common_items) CROSS JOIN ratios""",
        "top_pairs_documents": _top_query(DOCUMENTS, "jaccard_similarity"),
        "top_pairs_customers": _top_query(CUSTOMERS, "cosine_similarity"),
        "histogram_documents": f"""WITH {DOCUMENTS}, {REPS}, {all_pairs('cosine_similarity')}
SELECT round(sim, 12) AS sim, count(*) AS n_pairs FROM pair GROUP BY sim""",
        "thresholds_suggested": f"""{max_sim}, ratios(ratio) AS (VALUES {ratios})
SELECT ratio, {r6('ratio * max_sim', 'threshold')} FROM top CROSS JOIN ratios""",
        "exp1_error_grid": _cells(grid, grid_cells, f"threshold, n_pairs, {r6('mse', 'score')} FROM errors"),
        "exp1_minus_log_mse": _cells(grid, grid_cells, f"threshold, n_pairs, {r6(_minus_log('mse'), 'score')} FROM errors"),
        "exp1_default_lengths": _cells(
            grid, [(a, k) for a in ("BinSketch", "BCS") for k in DEFAULT_LENGTHS], f"threshold, n_pairs, {r6('mse', 'score')} FROM errors"
        ),
        "exp1_lane_lengths": _cells(
            _grid_body("cosine_similarity", min(LANE_THRESHOLDS), LANE_THRESHOLDS),
            [(a, k) for a in ("MinHash", "SimHash") for k in LANE_LENGTHS], f"threshold, n_pairs, {r6('mse', 'score')} FROM errors",
        ),
        "retrieval_grid_lengths": _retrieval_grid_query("jaccard_similarity", GRID_THRESHOLDS, [("BCS", k) for k in LANE_LENGTHS]),
        "algorithm_errors": " UNION ALL ".join(
            f"SELECT * FROM (WITH {_grid_body('cosine_similarity', 0.3, [0.3])('SimHash', k)} SELECT {k}::BIGINT AS k, {r6('mse', 'score')} FROM errors)"
            for k in (128, 256)
        ),
        **{
            f"retrieval_{m}": _retrieval_query(m, "jaccard_similarity", FIND_THRESHOLDS, FIND_CELLS) for m in SCORES
        },
        "retrieval_f1_cosine": _retrieval_query("f1", "cosine_similarity", SIGN_THRESHOLDS, SIGN_CELLS),
        "retrieval_counts": _cells(
            lambda a, k: _outcomes(a, k, "jaccard_similarity", FIND_THRESHOLDS), FIND_CELLS,
            "threshold, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM outcome GROUP BY threshold",
        ),
        "query_train_inner_product": f"{bought}, {query_train_pairs('inner_product')} {_by_class('qt', 'sim', 3)}",
        "filter_universe": f"{every} {_reports_over_all(SHARE)}",
        "profile_universe": f"{every} {PROFILE}",
        "threshold_report_universe": f"{every} {_thresholds_over_all(False)}",
        "filter_retrieval_reports": f"{bought_qt}, {ALL_QUERY_ROWS} {_reports_over_all(SHARE)}",
        "profile_queries": f"{bought_qt}, {ALL_QUERY_ROWS} {PROFILE}",
        "threshold_report_queries": f"{bought_qt}, {ALL_QUERY_ROWS} {_thresholds_over_all(True)}",
        **{
            f"filter_retrieval_{c}": f"""{bought_qt} SELECT rq.rep AS query_id, rt.rep AS train_idx, {r6('sim', 'similarity')}, count(*) AS n_pairs
FROM qt JOIN reps rq ON rq.doc_id = q JOIN reps rt ON rt.doc_id = t WHERE {p} GROUP BY rq.rep, rt.rep, sim"""
            for c, p in compared(SHARE).items()
        },
        "retrieval_grid_jaccard": _retrieval_grid_query("jaccard_similarity", GRID_THRESHOLDS, GRID_CELLS),
        "retrieval_grid_cosine": _retrieval_grid_query("cosine_similarity", SIGN_GRID_THRESHOLDS, [("SimHash", 128)]),
        "sampled_pair_errors": errors,
        "truth_job_accuracy": _pair_query(CUSTOMERS, "cosine_similarity", 0.1),
        "truth_job_retrieval": f"{bought}, {query_train_pairs('cosine_similarity')} {_by_class('qt', 'sim', 0.1)}",
        "filtered_truth_saved": f"""{truth} SELECT i, j, n_pairs, {r6('sim', 'sim')},
(SELECT sum(n_pairs)::BIGINT FROM cp) AS total_pairs, (SELECT sum(n_pairs)::BIGINT FROM cp WHERE sim >= {dbl(0.5)}) AS filtered_count
FROM cp WHERE sim >= {dbl(0.5)}""",
        "sets_saved": f"{bought} SELECT doc_id, feature_id FROM items",
        "synthetic_items": f"WITH {TWIN} SELECT doc_id, feature_id FROM items",
        "synthetic_pair_errors": _sampled_errors(50, 200, TWIN),
        "best_algorithm": f"""WITH r AS ({errors})
SELECT * FROM (SELECT algorithm AS best_mse_algorithm, mse AS best_mse FROM r ORDER BY mse, algorithm, metric LIMIT 1)
CROSS JOIN (SELECT algorithm AS best_mae_algorithm, mae AS best_mae FROM r ORDER BY mae, algorithm, metric LIMIT 1)""",
    }
