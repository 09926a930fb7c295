"""Secret scan with corpus-wide ownership frequency.

Patterns find candidate credentials in each text.  The value of every candidate is hashed, and
over the whole corpus each hash is counted by distinct repositories and owners: a value that
many owners or many repositories have is an example copied around, one that few of both have looks
live.  Texts are scanned once; only spans and hashes are written, shuffled and joined.

Everything is DataFrame expressions.  Positions are code points, end exclusive: text between
matches comes from ``split`` and the matches from ``regexp_extract_all`` with the same pattern, and running
sums of their lengths over the rows of a text's matches are positions.  Which candidates overlap a base span
follows from one sort of all spans of a text in each direction, so the work on a text grows with its length
and, but for sorting, with its matches.  Values are counted by aggregations that combine before they move, and the written
counts are joined by sort and merge, so that a value pasted everywhere is split over tasks.

Defined results: null counts as empty and has no spans; rows are numbered when the matches are
written, so repeated rows get equal results; other columns stay, and existing columns with the
names of the results are replaced.  A null owner or repository counts as one of its own.  An empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bitfold.session import materialize

# fixed values: the base patterns, the group holding the value and its least length, in reporting order
BASE = {
    "assign": (r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]+", 0, 24),
}
# runs shorter than asked for can be passed over inside the pattern where a match is always a whole run
WHOLE_RUNS = {"access": r"AKIA[A-Z0-9]{16,}", "hex": r"(?<![0-9a-f])[0-9a-f]{24,}"}
OWNED = "owned"  # spans the ownership counts add
OPAQUE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}"  # whole runs; those without a letter or a digit are dropped
KINDS = (*BASE, OWNED)
RESULTS = ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_owned", "n_example")


def matches(text: Column, pattern: str, kind: int, group: int) -> Column:
    """Matches of one pattern in order: what lies before each, its length and its value."""
    hits = F.zip_with(
        F.split(text, pattern), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda gap, hit: F.struct(F.char_length(gap).alias("gap"), hit.alias("hit")),
    )

    def row(x: Column, place: Column) -> Column:
        value = F.regexp_extract(x["hit"], pattern, group) if group else x["hit"]
        return F.struct(
            F.lit(kind).alias("kind"), place.alias("place"), x["gap"].alias("gap"), F.char_length(x["hit"]).alias("length"), value.alias("value")
        )

    return F.when(text.rlike(pattern), F.transform(F.filter(hits, lambda x: x["hit"].isNotNull()), row))


def scan(documents: DataFrame, repository: str, owner: str, text: str) -> DataFrame:
    """``(number, others, repository, owner, matches)``: every text once, with the matches of all patterns."""
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rules = [(WHOLE_RUNS.get(k, p), g) for k, (p, g, _) in BASE.items()] + [(OPAQUE, 0)]
    none = F.array().cast("array<struct<kind:int,place:int,gap:int,length:int,value:string>>")
    every = F.concat(*[F.coalesce(matches(whole, p, kind, g), none) for kind, (p, g) in enumerate(rules)])
    # the other columns travel in a struct, so none of their names can meet a working name
    others = F.struct(*[F.col(f"`{c}`") for c in documents.columns if c != text and c not in RESULTS])
    read = documents.select(
        others.alias("others"), F.col(f"`{repository}`").alias("repository"), F.col(f"`{owner}`").alias("owner"), every.alias("matches")
    )
    return materialize(read.withColumn("number", F.monotonically_increasing_id()), "matches")


def spans_of(texts: DataFrame) -> DataFrame:
    """``(number, repository, owner, kind, start, end, hash, live)``: base spans and candidates that overlap none."""
    rows = texts.where(F.size("matches") > 0).select("number", "repository", "owner", F.explode("matches").alias("m"))
    rows = rows.select("number", "repository", "owner", "m.*")
    upto = Window.partitionBy("number", "kind").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.col("length")).over(upto).cast("int"))
    rows = rows.withColumn("start", F.col("end") - F.col("length"))
    least = F.array(*[F.lit(n) for _, _, n in BASE.values()], F.lit(0))
    opaque = F.col("kind") == len(BASE)
    mixed = F.col("value").rlike("[0-9]") & F.col("value").rlike("[A-Za-z]")
    rows = rows.where((F.char_length("value") >= F.get(least, F.col("kind"))) & (~opaque | mixed))
    forward = Window.partitionBy("number").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    back = Window.partitionBy("number").orderBy(F.desc("start"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({
        "reached": F.max(F.when(~opaque, F.col("end"))).over(forward), "follows": F.min(F.when(~opaque, F.col("start"))).over(back)
    })
    apart = (F.coalesce("reached", F.lit(0)) <= F.col("start")) & F.coalesce(F.col("follows") >= F.col("end"), F.lit(True))
    return materialize(rows.where(~opaque | apart).select(
        "number", "repository", "owner", "kind", "start", "end", F.sha2(F.col("value").cast("binary"), 256).alias("hash"),
        looks_live(F.col("value")).alias("live"),
    ), "spans")


def ownership(candidates: DataFrame) -> DataFrame:
    """``(hash, n_repositories, n_owners)`` from ``(hash, repository, owner)``, one row per value.

    Each level is a map-side combined aggregation, so a value copied everywhere is summed up
    before it moves.
    """
    once = candidates.select("hash", "owner", "repository").distinct()
    owners = once.groupBy("hash", "owner").agg(F.count("*").alias("n"))
    return owners.groupBy("hash").agg(F.sum("n").alias("n_repositories"), F.count("*").alias("n_owners"))


def looks_live(value: Column) -> Column:
    """Varied enough to be drawn at random rather than written by hand."""
    return F.size(F.array_distinct(F.split(value, ""))) >= 11


def report(
    documents: DataFrame, repository: str = "doc_id", owner: str = "source", text: str = "text", most_owners: int = 2,
    most_repositories: int = 20,
) -> DataFrame:
    """``documents`` without the text, with ``RESULTS``.

    A value that more than ``most_owners`` owners or more than ``most_repositories`` repositories have
    is an example (``n_example`` counts those of the base spans, which stay); any other unassigned
    opaque value that looks live becomes an ``owned`` span.
    """
    texts = scan(documents, repository, owner, text)
    spans = spans_of(texts)
    counts = materialize(ownership(spans), "owners")
    common = (F.col("n_owners") > most_owners) | (F.col("n_repositories") > most_repositories)
    judged = spans.join(counts.hint("merge"), "hash").withColumn("common", common)
    opaque = F.col("kind") == len(BASE)
    new = opaque & ~F.col("common") & F.col("live")
    span = F.struct("start", "kind", "end")
    per_text = judged.groupBy("number").agg(
        *[F.count_if(F.col("kind") == i).alias(f"n_{k}") for i, k in enumerate(BASE)],
        F.sort_array(F.collect_list(F.when(~opaque, span))).alias("base"),
        F.sort_array(F.collect_list(F.when(~opaque | new, span))).alias("all"),
        F.count_if(new).alias("n_owned"), F.count_if(F.col("common") & ~opaque).alias("n_example"),
    )
    names = F.array(*[F.lit(k) for k in KINDS])
    line = lambda c: F.coalesce(F.array_join(
        F.transform(F.col(c), lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])), ","
    ), F.lit(""))
    counted = {c: F.coalesce(F.col(c), F.lit(0)).cast("bigint") for c in (*[f"n_{k}" for k in BASE], "n_owned", "n_example")}
    digests = {"base_sha256": F.sha2(line("base").cast("binary"), 256), "spans": line("all")}
    others = [c for c in documents.columns if c != text and c not in RESULTS]
    full = texts.select("number", "others").join(per_text, "number", "left")
    return full.select(*[F.col(f"others.`{c}`") for c in others], *[(counted | digests)[c].alias(c) for c in RESULTS])


def op2_secret_scan(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return report(documents.select("doc_id", "source", "text")).drop("source")


def op2_sql() -> str:
    """The same spans, from runs and their lengths; the engine's patterns have no look-behind."""
    def of(kind: int, pattern: str, group: int) -> str:
        value = f"regexp_extract(hit, '{pattern}', {group})" if group else "hit"
        return f"""SELECT doc_id, source, {kind} AS kind, ends - length(hit) AS start, ends AS stop, {value} AS value FROM (
    SELECT *, sum(length(gap) + length(hit)) OVER (PARTITION BY doc_id ORDER BY place) AS ends FROM (
    SELECT doc_id, source, unnest(hits) AS hit, unnest(gaps[:len(hits)]) AS gap, unnest(range(len(hits))) AS place FROM (
    SELECT doc_id, source, regexp_extract_all(t, '{pattern}') AS hits, string_split_regex(t, '{pattern}') AS gaps FROM d)))"""

    kinds = [(p, g, n) for p, g, n in BASE.values()] + [("[A-Za-z0-9+/_-]+", 0, 20)]
    found = " UNION ALL ".join(of(i, p.replace("'", "''"), g) for i, (p, g, _) in enumerate(kinds))
    least = " OR ".join(f"(kind = {i} AND length(value) >= {n})" for i, (_, _, n) in enumerate(kinds))
    line = "string_agg([{names}][kind + 1] || ':' || start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY start, kind, stop)".format(
        names=", ".join(f"'{k}'" for k in KINDS)
    )
    opaque = len(BASE)
    return f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
s AS MATERIALIZED (SELECT * FROM ({found}) WHERE ({least})
    AND (kind < {opaque} OR (regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]')))),
apart AS MATERIALIZED (SELECT * FROM s WHERE kind < {opaque} OR NOT EXISTS (
    SELECT 1 FROM s b WHERE b.doc_id = s.doc_id AND b.kind < {opaque} AND b.start < s.stop AND s.start < b.stop)),
owners AS (SELECT value, count(DISTINCT coalesce(source, '')) AS n_owners, count(DISTINCT (source, doc_id)) AS n_repositories FROM apart GROUP BY value),
judged AS (SELECT apart.*, n_owners > 2 OR n_repositories > 20 AS common, len(list_distinct(string_split(value, ''))) >= 11 AS live
    FROM apart JOIN owners USING (value)),
summed AS (SELECT doc_id, {", ".join(f"count_if(kind = {i})::BIGINT AS n_{k}" for i, k in enumerate(BASE))},
    coalesce({line} FILTER (kind < {opaque}), '') AS base, coalesce({line} FILTER (kind < {opaque} OR (NOT common AND live)), '') AS spans,
    count_if(kind = {opaque} AND NOT common AND live)::BIGINT AS n_owned, count_if(kind < {opaque} AND common)::BIGINT AS n_example
    FROM judged GROUP BY doc_id)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
coalesce(n_owned, 0) AS n_owned, coalesce(n_example, 0) AS n_example FROM d LEFT JOIN summed USING (doc_id)"""
