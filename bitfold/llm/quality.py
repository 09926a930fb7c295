"""Quality rules as weak supervision.

Each rule votes good (1), bad (-1) or abstains (0).  Expectation-maximisation over the votes
estimates how often each rule is right and how common good text is, and a document stays when
its posterior probability of being good is high enough, instead of when every rule agrees.

Statistics and votes are DataFrame expressions on one scan of the texts; nothing but the small
statistics table is written and read again.  EM runs over counts of vote patterns, of which
there are at most ``3 ** len(RULES)`` however many documents there are.

Repeated word windows are found by 64-bit hashes inside one document.  Defined results: a null
text has no words and fails; rows are judged one by one, so repeated rows get equal verdicts;
other columns stay, and existing columns with the names of the results are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitfold.session import materialize

WHITE = r"[\x20\x09-\x0D]"
INK = r"[^\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8

# fixed values: frequent function words of the corpus languages
STOP_WORDS = (
    "the of and to in is that it for on with as be this are "
    "le la les de des et un une est en que pour "
    "der die das und ist nicht mit von zu ein "
    "el los las y que por con una del se"
).split()

STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_digits", "n_capitals", "n_stops")


def window_hashes(codes: Column) -> Column:
    """One hash per ``WINDOW``-word window, from the words' hashes."""
    size = F.size(codes)
    starts = F.sequence(F.lit(0), size - WINDOW)
    hashes = F.transform(starts, lambda i: F.xxhash64(*[codes[i + j] for j in range(WINDOW)]))
    return F.when(size >= WINDOW, hashes).otherwise(F.array().cast("array<bigint>"))


def statistics(documents: DataFrame, text: str = "text") -> DataFrame:
    """``documents`` with ``STATISTICS`` in place of the text."""
    others = [c for c in documents.columns if c != text and c not in STATISTICS]
    quoted = [F.col(f"`{c}`") for c in others]
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda line: line.rlike(INK))
    stops = F.array(*[F.lit(w) for w in sorted(set(STOP_WORDS))])
    read = documents.select(
        *quoted,
        F.filter(F.split(whole, WHITE + "+"), lambda w: w != "").alias("_words"),
        lines.alias("_lines"),
        F.regexp_count(whole, F.lit(SYMBOLS)).cast("bigint").alias("n_symbols"),
        F.regexp_count(whole, F.lit("[0-9]")).cast("bigint").alias("n_digits"),
        F.regexp_count(whole, F.lit("[A-Z]")).cast("bigint").alias("n_capitals"),
    )
    counted = read.select(
        *quoted, "n_symbols", "n_digits", "n_capitals",
        F.size("_words").cast("bigint").alias("n_words"),
        F.char_length(F.array_join("_words", "")).cast("bigint").alias("word_chars"),
        F.size("_lines").cast("bigint").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        F.size(F.array_intersect("_words", stops)).cast("bigint").alias("n_stops"),
        F.transform("_words", lambda w: F.xxhash64(w)).alias("_codes"),
    )
    hashed = counted.withColumn("_hashes", window_hashes(F.col("_codes"))).drop("_codes")
    again = F.size(F.array_distinct("_hashes")) < F.size("_hashes")
    empty = F.array().cast("array<struct<h:bigint,i:int>>")
    by_hash = F.sort_array(F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    ordered = hashed.withColumn("_ordered", F.when(again, by_hash).otherwise(empty)).drop("_hashes")
    row, last = F.col("_ordered"), F.size("_ordered") - 1
    twice = F.filter(
        F.sequence(F.lit(0), last),
        lambda k: ((k > 0) & (row[F.greatest(k - 1, F.lit(0))]["h"] == row[k]["h"]))
        | ((k < last) & (row[F.least(k + 1, last)]["h"] == row[k]["h"])),
    )
    places = F.sort_array(F.transform(twice, lambda k: row[k]["i"]))
    spotted = ordered.withColumn(
        "_places", F.when(last >= 0, places).otherwise(F.array().cast("array<int>"))
    ).drop("_ordered")
    # a window adds its words up to the start of the next repeated window
    steps = F.zip_with(
        F.col("_places"), F.slice("_places", 2, F.greatest(F.size("_places"), F.lit(1))),
        lambda here, following: F.least(F.lit(WINDOW), F.coalesce(following - here, F.lit(WINDOW))),
    )
    total = F.aggregate(steps, F.lit(0).cast("bigint"), lambda a, b: a + b)
    return spotted.select(*quoted, *[c for c in STATISTICS if c != "n_repeat_words"], total.alias("n_repeat_words"))


def vote(good: Column, bad: Column) -> Column:
    return F.when(bad, F.lit(-1)).when(good, F.lit(1)).otherwise(F.lit(0))


def rules() -> dict[str, Column]:
    """Votes from the statistics; a rule without enough to go on abstains."""
    words, lines = F.col("n_words").cast("double"), F.col("n_lines").cast("double")
    share = lambda name, of: F.coalesce(F.try_divide(F.col(name).cast("double"), of), F.lit(0.0))
    some = words >= 5
    length = share("word_chars", words)
    return {
        "length": vote(words >= 50, words < 20),
        "word_length": vote(some & length.between(3, 10), some & ((length < 2.5) | (length > 13))),
        "symbols": vote(some & (share("n_symbols", words) <= 0.02), some & (share("n_symbols", words) > 0.1)),
        "lines": vote((lines >= 2) & (share("n_dup_lines", lines) <= 0.05), (lines >= 2) & (share("n_dup_lines", lines) > 0.3)),
        "repeats": vote(some & (share("n_repeat_words", words) <= 0.05), some & (share("n_repeat_words", words) > 0.2)),
        "digits": vote(
            some & (share("n_digits", F.col("word_chars").cast("double")) <= 0.05),
            some & (share("n_digits", F.col("word_chars").cast("double")) > 0.2),
        ),
        "capitals": vote(
            some & (share("n_capitals", F.col("word_chars").cast("double")) <= 0.15),
            some & (share("n_capitals", F.col("word_chars").cast("double")) > 0.5),
        ),
        "stop_words": vote(F.col("n_stops") >= 3, (words >= 30) & (F.col("n_stops") <= 1)),
    }


RULES = ("length", "word_length", "symbols", "lines", "repeats", "digits", "capitals", "stop_words")


def estimate(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 40, trust: float = 0.2) -> tuple[float, list[dict]]:
    """``(share of good text, per rule P(vote | good) and P(vote | bad))`` by EM.

    A prior worth ``trust`` of the documents says that votes are more often right than wrong;
    it keeps the meaning of the two classes when rules disagree or one class is missing.
    """
    n_rules = len(patterns[0][0]) if patterns else 0
    total = sum(n for _, n in patterns)
    lean = {1: (0.7, 0.1), 0: (0.2, 0.3), -1: (0.1, 0.6)}  # P(vote | good), P(vote | bad)
    share, tables = 0.8, [dict(lean) for _ in range(n_rules)]
    for _ in range(rounds):
        good = 0.0
        seen = [{v: [0.0, 0.0] for v in lean} for _ in range(n_rules)]
        for votes, n in patterns:
            p = posterior(votes, share, tables)
            good += n * p
            for table, v in zip(seen, votes):
                table[v][0] += n * p
                table[v][1] += n * (1 - p)
        weight = trust * total + 1
        share = (good + 0.8 * weight) / (total + weight)
        of = (good + weight, total - good + weight)
        tables = [{v: tuple((t[v][c] + weight * lean[v][c]) / of[c] for c in (0, 1)) for v in lean} for t in seen]
    return share, tables


def posterior(votes: tuple[int, ...], share: float, tables: list[dict]) -> float:
    log = math.log(share / (1 - share)) + sum(math.log(t[v][0] / t[v][1]) for t, v in zip(tables, votes))
    return 1 / (1 + math.exp(-max(-500.0, min(500.0, log))))


def judge(documents: DataFrame, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """``documents`` without the text, with statistics, ``quality`` (posterior), ``base_failed``, ``kept``."""
    named = rules()
    results = {"quality", "base_failed", "kept"}
    slim = documents.select(*[F.col(f"`{c}`") for c in documents.columns if c not in results])
    measured = materialize(statistics(slim, text), "statistics")
    votes = measured.withColumn("_votes", F.array(*[named[r] for r in RULES]))
    # one row per vote pattern: at most 3 ** len(RULES)
    counts = votes.groupBy("_votes").count().collect()
    share, tables = estimate(sorted((tuple(r["_votes"]), r["count"]) for r in counts))
    log = F.lit(math.log(share / (1 - share)))
    for k, table in enumerate(tables):
        odds = {v: math.log(table[v][0] / table[v][1]) for v in table}
        v = F.col("_votes")[k]
        log = log + F.when(v == 1, F.lit(odds[1])).when(v == -1, F.lit(odds[-1])).otherwise(F.lit(odds[0]))
    quality = F.lit(1.0) / (F.lit(1.0) + F.exp(-log))
    failed = (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)
    return votes.withColumns({"quality": quality, "base_failed": failed}).withColumn(
        "kept", ~F.col("base_failed") & (F.col("quality") >= F.lit(threshold))
    ).drop("_votes")


def op7_quality_rules(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    judged = judge(documents.select("doc_id", "text"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality"
    )
