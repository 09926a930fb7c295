"""Each operator against its plain version, on made-up edge cases and on the smallest tables."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from bitfold.llm import exact, language, licenses, mixing, nearcopies, pieces, quality, secrets, suffixes, urls
from bitfold.llm.shingles import WordHasher, long_text, shingle_set, word_hashes
from bitfold.llm import suffixarray
from bitfold.llm.suffixarray import permuted_prefixes, suffix_array
from tests.llm import brute

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(documents):
    return [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()]


def invented(n=120, seed=1):
    """Copies, near copies, shared passages, empty and null texts, one long text, white space of all kinds."""
    rng = random.Random(seed)
    word = lambda: rng.choice(["the", "of", "Secret", "token", "a", "é", "=", "x1", "\U0001d11e", "|"]) + rng.choice(["", "q", "zz", "7"])
    base = [" ".join(word() for _ in range(60)) for _ in range(6)]
    out = [None, "", " \t\n", "word", "a" * 700, "12 345 !!", ("ab " * 4000)]
    while len(out) < n:
        text = rng.choice(base)
        kind = rng.randrange(5)
        if kind == 0:
            words = text.split(" ")
            words[rng.randrange(60)] = word()
            text = " ".join(words)
        elif kind == 1:
            text = text[: rng.randrange(20, 200)] + "\n" + rng.choice(base)[rng.randrange(50) :]
        elif kind == 2:
            text = text.replace(" ", rng.choice(["  ", "\n", "\t", "\x0b"]))
        elif kind == 3:
            text = " ".join(word() for _ in range(rng.randrange(40)))
        out.append(text)
    return list(enumerate(out))


@pytest.fixture(scope="module")
def edge(spark):
    rows = invented()
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("source", F.concat(F.lit("s"), F.col("doc_id") % 4))
    return rows, frame.repartition(4)


def by_id(frame, *columns):
    return {r[0]: tuple(r)[1:] for r in frame.select("doc_id", *columns).collect()}


# --- language identification


def test_language_is_right_on_held_out_rows(spark, documents):
    judged = language.op1_language_id(spark, SF).join(documents.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(judged) > 30
    assert sum(r["lang"] == r["lang_pred"] for r in judged) / len(judged) >= 0.95
    assert all(0 <= r["score"] <= 1 for r in judged)


def test_language_of_texts_without_letters_or_training(spark, edge):
    _, frame = edge
    judged = by_id(language.identify(frame.withColumn("score", F.lit("clash")), None), "lang_pred", "score")
    assert set(judged.values()) == {("und", 0.0)} and len(judged) == frame.count()
    labelled = frame.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "aa"))
    net = language.fit(labelled)
    judged = by_id(language.identify(frame, net), "lang_pred")
    assert judged[0] == judged[1] == judged[2] == ("und",) and judged[3] == ("aa",)


def test_language_network_sees_every_window():
    net = language.train(np.tile(np.frombuffer(b"ab" * 64, np.uint8), (4, 1)), np.array([0, 1, 0, 1]), ("x", "y"), steps=2)
    import pyarrow as pa

    windows, first = language.window_matrix(pa.array(["a" * 300, None, "", "b" * 128]), net.window)
    assert first.tolist() == [0, 3, 4, 5, 6] and windows[:3].tobytes().rstrip(b"\0") == b"a" * 300


# --- secrets


def test_secret_spans_equal_plain_search(spark, edge, documents, texts):
    for rows, frame in (edge, (texts, documents)):
        found = by_id(secrets.report(frame), "n_assign", "n_access", "n_hex", "base_sha256")
        assert found == {d: brute.secrets(t)[0] for d, t in rows}


def test_secret_ownership_separates_examples(spark):
    live, shared = "x7Qk2Lm9Pv4Rt8Wz1Ys5", "y8Qk2Lm9Pv4Rt8Wz1Ys6"
    rows = [(i, f"o{i}", f"see {shared} here") for i in range(6)] + [(9, "o1", f"é {live} token=abcdef1")]
    rows += [(10, None, None), (10, None, None)]
    out = secrets.report(spark.createDataFrame(rows, "doc_id bigint, source string, text string")).collect()
    spans = {r["doc_id"]: r["spans"] for r in out}
    assert len(out) == 9 and spans[0] == "" and spans[10] == ""
    assert spans[9] == "owned:2:22,assign:23:36"


def test_secret_copied_inside_one_source_is_an_example(spark):
    pasted, live = "x7Qk2Lm9Pv4Rt8Wz1Ys5", "y8Qk2Lm9Pv4Rt8Wz1Ys6"
    rows = [(i, "s1", f"see {pasted} or token=abcdef1") for i in range(30)] + [(90 + i, "s1", f"see {live}") for i in range(3)]
    out = {r["doc_id"]: r for r in secrets.report(spark.createDataFrame(rows, "doc_id bigint, source string, text string")).collect()}
    assert all((out[i]["n_owned"], out[i]["n_example"]) == (0, 1) for i in range(30))
    assert all((out[90 + i]["n_owned"], out[90 + i]["n_example"]) == (1, 0) for i in range(3))


def test_secret_with_a_late_digit_or_letter(spark):
    late = ["abcdefghijklmnop" * 6 + "7", "0123456789" * 9 + "abcdefg"]
    rows = [(k, f"o{k}", f"see {v} here") for k, v in enumerate([*late, "abcdefghijklmnop" * 6, "0123456789+/_-" * 9])]
    out = {r["doc_id"]: r["spans"] for r in secrets.report(spark.createDataFrame(rows, "doc_id bigint, source string, text string")).collect()}
    assert all(f"owned:4:{4 + len(late[k])}" in out[k] for k in (0,)) and "owned" not in out[2] and "owned" not in out[3]
    assert "hex" in out[1] and "owned" not in out[1]


# --- exact dedup


def test_exact_groups_equal_plain_grouping(spark, edge):
    rows, frame = edge
    found = by_id(exact.group_copies(frame, block_bytes=16), "keep_id", "group_size", "kept", "text_sha256")
    assert found == brute.exact_groups(rows)


def test_exact_names_survive_address_collisions(spark, edge, monkeypatch):
    rows, frame = edge
    xxhash64 = F.xxhash64
    monkeypatch.setattr(exact.F, "xxhash64", lambda *c: xxhash64(*c) % 3 if isinstance(c[0], str) and c[0] == "block" else xxhash64(*c))
    found = by_id(exact.group_copies(frame, block_bytes=16), "keep_id", "group_size", "kept", "text_sha256")
    assert found == brute.exact_groups(rows)


def test_exact_repeated_rows_and_shared_ids(spark):
    rows = [(1, "a b"), (1, "a b"), (1, "c"), (2, "ab"), (None, "c")]
    out = exact.group_copies(spark.createDataFrame(rows, "doc_id bigint, text string"))
    found = sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["kept"]) for r in out.collect())
    assert found == [("1", "1", 3, True), ("1", "1", 3, True), ("1", "None", 2, False), ("2", "1", 3, False), ("None", "None", 2, True)]


def test_exact_keeps_one_row_of_each_group(spark):
    rows = [(1, "a b", "x"), (1, "a b", "w"), (1, "c", "x"), (2, "ab", "x"), (None, "c", "y"), (7, "d", "z"), (8, None, "n"), (9, " ", "n"), (9, " ", "n")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, _mark string").withColumns({c: F.lit(c) for c in ("id", "of", "row", "mark", "_id")})
    out = exact.keep_first(frame.repartition(3))
    assert out.columns == frame.columns
    found = sorted((str(r["doc_id"]), r["text"], r["_mark"], r["id"], r["row"]) for r in out.collect())
    assert found == [("1", "a b", "w", "id", "row"), ("7", "d", "z", "id", "row"), ("9", " ", "n", "id", "row"), ("None", "c", "y", "id", "row")]
    assert sorted(r["doc_id"] for r in exact.keep_first(frame.where("doc_id > 1 and doc_id < 9")).collect()) == [2, 7, 8]


def test_tables_of_one_row_per_group_are_written_before_they_are_joined(spark, documents):
    """An aggregation by the key of its own join cannot be split from the rows it meets."""
    plan = exact.group_copies(documents.select("doc_id", "text"))._jdf.queryExecution().executedPlan().toString()
    last = plan[plan.index("SortMergeJoin") :]
    assert last.count("Exchange hashpartitioning(level") == 2 and "Aggregate" not in last


# --- URLs


def test_url_rules(spark):
    rows = [
        (1, "http://a.net/x"), (2, "https://WWW.example.NET/en/1"), (3, "http://example.net/de/1"), (4, "ftp://example.com/de/"),
        (5, "http://x.example.com/de/q?r"), (6, "http://x.org/fr/"), (7, "http://net"), (8, None), (9, "nothing"), (10, "http://sub.net?x/y"),
        (11, "http://notexample.com/de/"), (11, "http://notexample.com/de/"), (12, "x://h#f"),
    ]
    out = urls.judge(spark.createDataFrame(rows, "page_id bigint, url string").withColumn("rule", F.lit("clash")), None)
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in out.collect()}
    assert got[1] == ("a.net", "/x", "net/", "block")
    assert got[2] == ("www.example.net", "/en/1", "example.net/en/", "allow")
    assert got[3][2:] == ("net/", "block") and got[4][2:] == got[5][2:] == ("example.com/de/", "block")
    assert got[6][2:] == ("org/fr/", "allow") and got[7] == ("net", "", None, "allow")
    assert got[8] == got[9] == ("", "", None, "allow") and got[10][:3] == ("sub.net", "", None)
    assert got[11][2] is None and got[12][:2] == ("h", "") and out.count() == len(rows)


def test_url_trees_learn(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url")
    labelled = urls.weakly_labelled(pages).withColumn("half", F.crc32("url") % 2)
    model = urls.fit(labelled.where("half = 0"))
    rest = labelled.where("half = 1").distinct().collect()
    guess = model.score([r["url"] for r in rest]) >= 0.5
    assert np.mean(guess == np.array([r["label"] for r in rest])) >= 0.95
    assert urls.fit(labelled.where("label = 0")) is None


def test_url_statistics_cover_all_labelled_pages(spark):
    rows = [(f"http://h{i % 400}.good{i % 40}.org/p/{i}", 0) for i in range(1900)] + [(f"http://b{i}.bad{i % 7}.net/x/{i}", 1) for i in range(100)]
    frame = spark.createDataFrame(rows + rows[:50], "url string, label int")
    model = urls.fit(frame, max_rows=50)
    assert model.rates.overall == 0.05 and abs(model.trees.base - np.log(100 / 1900)) < 1e-9
    counts = {r["suffix"]: (sum(r["bad"]), sum(r["seen"])) for r in model.rates.counts.collect()}
    assert counts["org"] == (0, 1900) and counts["net"] == (100, 100) and counts["h3.good3.org"][1] in (4, 5)
    assert len(counts) == 2 + 40 + 7 + 400 + 100
    pages = spark.createDataFrame([(k, u) for k, (u, _) in enumerate(rows[::9])] + [(9999, None)], "page_id bigint, url string")
    judged = {r["url"]: r["block_score"] for r in urls.judge(pages, model, rules=()).collect()}
    assert np.allclose(model.score(list(judged)), list(judged.values())) and len(judged) == len(rows[::9]) + 1
    clean = [f"http://www.new{i}.info/p/{i}" for i in range(50)]
    assert (model.score(clean) < 0.5).all()


# --- mixing


@pytest.mark.parametrize("slots,block_rows", [(12, 1), (40, 3)])
def test_mixing_stays_within_a_block_of_its_weights(spark, slots, block_rows):
    sizes = {"a": 400, "b": 90, "c": 33, None: 20}
    rows = [(i, s) for s, n in sizes.items() for i in range(n)]
    rows = [(k, s) for k, (_, s) in enumerate(rows)]
    placed = mixing.place(spark.createDataFrame(rows, "doc_id bigint, source string"), None, slots, block_rows, bin_rows=50).collect()
    assert sorted(r["doc_id"] for r in placed) == [k for k, _ in rows]
    blocks = {(r["source"], r["block"]): r for r in placed}
    ordered = sorted(blocks.values(), key=lambda r: r["slot"])
    assert [r["slot"] for r in ordered] == list(range(len(ordered)))
    assert all(r["release"] <= r["slot"] < r["deadline"] for r in ordered)
    share = mixing.shares(sizes, None, slots)
    full = min(-(-n // block_rows) // share[s] for s, n in sizes.items()) * slots
    got = dict.fromkeys(sizes, 0)
    for t, r in enumerate(ordered[:full], 1):
        got[r["source"]] += 1
        assert all(abs(got[s] - t * share[s] / slots) < 1 for s in sizes)


def test_mixing_empty_table_and_too_many_sources(spark):
    empty = spark.createDataFrame([], "doc_id bigint, source string, slot string")
    assert mixing.place(empty).count() == 0
    many = spark.range(30).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("source"))
    with pytest.raises(ValueError):
        mixing.place(many, slots=10)


def test_mixing_follows_the_target_weights(spark):
    sizes = {f"s{k}": 60 for k in range(19)} | {"hot": 571}
    rows = [(s,) for s, n in sizes.items() for _ in range(n)]
    weights = dict.fromkeys(sizes, 1.0) | {"hot": 9.5}
    frame = spark.createDataFrame(rows, "source string").withColumn("doc_id", F.monotonically_increasing_id())
    order = [r["source"] for r in mixing.place(frame, weights, block_rows=1).orderBy("slot").collect()]
    got = dict.fromkeys(sizes, 0)
    for t, source in enumerate(order[: 60 * 28], 1):
        got[source] += 1
        assert all(abs(got[s] - t * w / 28.5) < 1 for s, w in weights.items())


def test_mixing_windows_hold_when_sources_run_out():
    rng = random.Random(8)
    for _ in range(60):
        m = rng.randrange(1, 30)
        blocks, weights = [rng.randrange(1, 40) for _ in range(m)], [rng.randrange(1, 50) for _ in range(m)]
        rows = list(mixing.earliest_deadline_first(blocks, weights))
        assert sorted((i, j) for i, j, _, _ in rows) == sorted((i, j) for i in range(m) for j in range(blocks[i]))
        assert all(release <= t < deadline for t, (_, _, release, deadline) in enumerate(rows))


def test_mixing_schedule_equals_plain_simulation():
    rng = random.Random(11)
    for _ in range(25):
        m = rng.randrange(1, 8)
        blocks, weights = [rng.randrange(1, 9) for _ in range(m)], [rng.randrange(1, 12) for _ in range(m)]
        assert list(mixing.earliest_deadline_first(blocks, weights)) == brute.pfair(blocks, weights)


def test_mixing_places_equal_plain_simulation(spark, documents):
    named = documents.select("doc_id", F.when(F.col("source") != "web", F.col("source")).alias("source"))
    sizes = {r["source"]: r["count"] for r in named.groupBy("source").count().collect()}
    weights = {s: 1.0 + k for k, s in enumerate(sorted(sizes, key=str))}
    order = sorted(sizes, key=lambda s: (s is None, str(s)))
    placed = mixing.place(named, weights, block_rows=16).collect()
    found = {(r["slot"], r["source"], r["block"], r["release"], r["deadline"]) for r in placed}
    plain = brute.pfair([-(-sizes[s] // 16) for s in order], [int(weights[s]) for s in order])
    assert found == {(t, order[i], j, r, d) for t, (i, j, r, d) in enumerate(plain)}
    assert all(r["block"] == r["source_rank"] // 16 for r in placed)
    assert {(r["source"], r["source_rank"]) for r in placed} == {(s, k) for s, n in sizes.items() for k in range(n)}


def test_mixing_takes_any_number_of_sources(spark):
    many = spark.range(900).select(F.col("id").alias("doc_id"), (F.col("id") % 300).cast("string").alias("source"))
    placed = mixing.place(many, block_rows=1)
    assert placed.select("slot").distinct().count() == placed.count() == 900
    some = mixing.place(many, {"7": 1.0, "8": 2.0}, block_rows=1).where("source in ('7', '8')")
    assert some.agg(F.max("slot")).first()[0] == 5


def test_mixing_keeps_every_row_and_column(spark, edge):
    _, frame = edge
    twice = frame.unionByName(frame)
    out = mixing.mixed(twice, slots=16, block_rows=4)
    assert out.columns == frame.columns and out.exceptAll(twice).isEmpty() and twice.exceptAll(out).isEmpty()


# --- licenses


def notice(name):
    return licenses.TEMPLATES[name].replace("[", "").replace("]", "")


def licenses_of(spark, texts):
    rows = list(enumerate(texts))
    clash = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({c: F.lit("kept") for c in ("hint", "found", "others")})
    out = licenses.scan(clash.withColumn("coverage", F.lit("replaced")).repartition(4)).collect()
    assert len(out) == len(rows) and {(r["hint"], r["found"], r["others"]) for r in out} == {("kept",) * 3}
    return [r for r in sorted(out, key=lambda r: r["doc_id"])]


def test_license_notices_are_found(spark):
    filler = "the license of words " * 3
    texts = [f"{filler} foo bar {notice(name)} the end" for name in licenses.TEMPLATES]
    got = licenses_of(spark, [*texts, None, "", "license", "no notice here", "mit"])
    assert [(r["license"], r["coverage"]) for r in got[: len(texts)]] == [(name, 1.0) for name in licenses.TEMPLATES]
    assert all(r["license"] is None and r["coverage"] == 0 for r in got[len(texts) :])


def test_license_neighbours_are_not_taken_for_each_other(spark):
    cases = {
        "Released under the BSD License.": "BSD name", "Licensed under CC BY 4.0.": "CC-BY-4.0 name",
        "This work is licensed under the GNU General Public License, version 2.": "GPL-2.0",
        "Licensed under the Apache License, Version 1.1.": "Apache-1.1",
        "This work is licensed under a Creative Commons Attribution 3.0 International License.": "CC-BY-3.0",
        "We released under the sea license": None, "Released under the X11 License.": None, "Licensed under CC BY-ND 4.0.": None,
        "This work is licensed under the GNU Lesser General Public License, version 3.": None,
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.": None,
        "Licensed under the Apache License, Version 3.0.": None, "Released under the MIT or the BSD License.": "BSD name",
        "Licenced  under the\nAPACHE license (version 2.0)": "Apache-2.0", "license: released under the MIT license, license": "MIT",
    }
    assert [r["license"] for r in licenses_of(spark, list(cases))] == list(cases.values())


def test_license_notices_with_any_word_changed(spark):
    """A misspelt word costs coverage only, unless it is one that names the license."""
    cases = []
    for name, text in licenses.TEMPLATES.items():
        template = licenses.prepared(text, 0.8)
        named = {k for a, b in template.phrases for k in range(a, b)}
        size = len(template.words)
        for k in range(size):
            changed = " ".join([*template.words[:k], "xyzzy", *template.words[k + 1 :]])
            cases.append((name, k in named, (size - 1) / size, f"foo bar {changed} the end"))
    cases.append(("BSD", False, 0.8, notice("BSD").replace("Redistribution", "Re-distribution")))
    for (name, naming, share, _), r in zip(cases, licenses_of(spark, [c[3] for c in cases])):
        if naming:
            assert r["license"] != name
        elif share >= 0.8:
            assert r["license"] == name or (name, r["license"]) == ("Apache-2.0 header", "Apache-2.0"), (name, r)
            assert r["coverage"] >= min(share, 0.8)


def test_license_in_very_long_texts(spark):
    filler = "the license of some words and more words " * 40_000
    got = licenses_of(spark, [filler + notice("GPL-3.0") + filler, (notice("MIT") + " ") * 5_000, "permission " * 200_000])
    assert [r["license"] for r in got] == ["GPL-3.0", "MIT", None]


def test_patience_alignment_is_increasing():
    rng = random.Random(4)
    for _ in range(200):
        a, b = ([rng.choice("abcdefgh") for _ in range(rng.randrange(12))] for _ in range(2))
        matched = licenses.align(a, b)
        assert all(a[i] == b[j] for i, j in matched)
        assert all(p < q and r < s for (p, r), (q, s) in zip(matched, matched[1:]))
    assert licenses.increasing([(0, 3), (1, 1), (2, 2), (3, 0)]) == [(1, 1), (2, 2)]


# --- quality


def test_quality_statistics_equal_plain_counts(spark, edge, documents, texts):
    for rows, frame in (edge, (texts, documents)):
        judged = quality.judge(frame.select("doc_id", "text", F.lit(1).alias("kept")))
        found = by_id(judged, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
        assert found == {d: brute.statistics(t) for d, t in rows}
        assert judged.where("base_failed and kept").isEmpty()


def test_quality_verdicts_equal_plain_votes_and_rounds(spark, edge, documents, texts):
    for rows, frame in (edge, (texts, documents)):
        judged = {r["doc_id"]: r for r in quality.judge(frame.select("doc_id", "text")).collect()}
        expected = brute.quality_posteriors([brute.quality_votes(t) for _, t in rows])
        assert np.allclose([judged[d]["quality"] for d, _ in rows], expected, atol=1e-9)
        failed = [brute.statistics(t)[-1] for _, t in rows]
        assert [judged[d]["kept"] for d, _ in rows] == [bool(p >= 0.5 and not f) for p, f in zip(expected, failed)]


def test_quality_em_recovers_rule_accuracies():
    rng = random.Random(5)
    counts = {}
    for _ in range(20_000):
        good = rng.random() < 0.7
        votes = tuple((1 if (rng.random() < p) == good else -1) for p in (0.95, 0.9, 0.7))
        counts[votes] = counts.get(votes, 0) + 1
    share, tables = quality.estimate(sorted(counts.items()), trust=0.01)
    assert abs(share - 0.7) < 0.05
    assert tables[0][1][0] > tables[2][1][0] > 0.6
    assert quality.posterior((1, 1, 1), share, tables) > 0.9 > 0.2 > quality.posterior((-1, -1, -1), share, tables)
    assert quality.estimate([])[1] == []


# --- suffix arrays


@pytest.mark.parametrize("crowd", [0, 64, 1 << 40])
def test_suffix_array_is_sorted(monkeypatch, crowd):
    monkeypatch.setattr(suffixarray, "CROWD", crowd)
    rng = np.random.default_rng(0)
    for _ in range(400):
        s = rng.integers(0, rng.integers(1, 5), rng.integers(0, 40))
        s = np.concatenate((s, s[: len(s) // 2], s))
        assert suffix_array(s).tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())


def test_permuted_prefixes_equal_plain_comparison():
    rng = np.random.default_rng(5)
    for _ in range(300):
        s = rng.integers(0, rng.integers(1, 5), rng.integers(1, 40))
        s = np.concatenate((s, s[: len(s) // 2], s))
        order = suffix_array(s)
        found, text = permuted_prefixes(s, order), s.tolist()
        assert found[order[0]] == 0
        for a, b in zip(order[:-1], order[1:]):
            both = list(zip(text[a:], text[b:]))
            assert found[b] == next((k for k, (x, y) in enumerate(both) if x != y), len(both))


@pytest.mark.parametrize("options", [{}, {"crowded": 1}, {"crowded": 3}, {"shard_bytes": 500}])
def test_removed_bytes_equal_plain_search(spark, edge, options):
    rows, frame = edge
    found = by_id(suffixes.remove_copies(frame, **options), "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert found == brute.without_repeats(rows)


def test_removed_bytes_with_shared_ids(spark):
    rng = random.Random(3)
    one, two = ("".join(rng.choice("abcdefgh ") for _ in range(300)) for _ in range(2))
    rows = [(1, one), (1, one), (1, two), (None, one[:150]), (2, two[100:] + one)]
    out = suffixes.remove_copies(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"]) for r in out) == [
        ("1", 300, 0), ("1", 300, 150), ("1", 300, 300), ("2", 500, 500), ("None", 150, 0)
    ]


def test_crowded_anchor_is_lengthened(spark):
    """One passage with other surroundings in every document, at every place of a string."""
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    anchor, ends = word(45), [word(60) for _ in range(6)]
    rows = [
        (d, word(rng.randint(0, 9)) + rng.choice(ends)[rng.randint(0, 59) :] + anchor + rng.choice(ends)[: rng.randint(0, 60)] + word(5))
        for d in range(150)
    ] + [(200, None), (201, ""), (202, anchor)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    plain = brute.without_repeats(rows)
    assert sum(r[1] for r in plain.values()) > 0
    for crowded in (1, 20):
        assert by_id(suffixes.remove_copies(frame, crowded=crowded), "n_bytes", "n_removed", "n_spans", "kept_sha256") == plain


# --- near duplicates


@pytest.mark.parametrize("width", [4, 5])
def test_near_groups_equal_plain_comparison(spark, edge, width):
    rows, frame = edge
    found = by_id(nearcopies.near_copies(frame, width=width), "n_shingles", "component_id", "kept")
    assert found == brute.near_groups(rows, width)


def test_near_groups_without_hubs(spark, edge, monkeypatch):
    rows, frame = edge
    monkeypatch.setattr(nearcopies, "BLOCK_ROWS", 3)
    found = by_id(nearcopies.near_copies(frame, width=4, hub_rounds=1), "n_shingles", "component_id", "kept")
    assert found == brute.near_groups(rows, 4)


def test_near_groups_with_nulls_and_repeats(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [(3, text), (3, text), (1, text.upper()), (None, text), (7, None), (8, "")]
    out = nearcopies.near_copies(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((str(r["doc_id"]), str(r["component_id"]), r["kept"]) for r in out) == [
        ("1", "1", True), ("3", "1", False), ("3", "1", False), ("7", "7", True), ("8", "8", True), ("None", "None", True)
    ]
    kept = nearcopies.keep_smallest(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "7", "8", "None"]


def test_long_texts_hash_as_short_ones(monkeypatch):
    import pyarrow as pa

    from bitfold.llm import shingles

    text = " ".join(f"Word{i % 97}é" for i in range(5000)) + " " + "x" * 5000
    whole = list(word_hashes(pa.array([text, None]), WordHasher()))
    monkeypatch.setattr(shingles, "CHUNK", 512)
    cut = list(word_hashes(pa.array([text, None]), WordHasher()))
    assert np.array_equal(whole[0], cut[0]) and len(cut[1]) == 0
    assert len(shingle_set(whole[0], 5)) == len(brute.shingles(text, 5))


# --- SentencePiece


def test_pieces_equal_the_library(edge, texts):
    coder = pieces.ChunkCoder(pieces.default_model(), max_chunks=50)
    library = coder.model
    rng = random.Random(6)
    letters = " ▁ab\n\t\r<s>é€\U0001d11e\x00\u200b  the  and.,日本"
    rows = [t or "" for _, t in edge[0] + texts] + ["".join(rng.choice(letters) for _ in range(rng.randrange(20))) for _ in range(2000)]
    for at in range(0, len(rows), 100):
        part = rows[at : at + 100]
        ids = [library.encode(t) if t else [] for t in part]
        expected = [(",".join(map(str, i)), len(i), library.decode(i) if i else "") for i in ids]
        assert coder.code(part) == expected


def test_pieces_round_trip_in_spark(spark, edge):
    rows, frame = edge
    out = by_id(pieces.encode(frame.withColumn("ids", F.lit(0)), pieces.default_model()), "ids", "decoded")
    assert {d: back for d, (_, back) in out.items()} == {d: t or "" for d, t in rows}


# --- nothing to work on


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    net = language.fit(none)
    assert net is None and language.identify(none, net).count() == 0
    assert secrets.report(none).count() == 0 and exact.group_copies(none).count() == 0
    assert licenses.scan(none).count() == 0 and quality.judge(none).count() == 0
    assert suffixes.remove_copies(none).count() == 0 and nearcopies.near_copies(none).count() == 0
    assert pieces.encode(none, pieces.default_model()).count() == 0 and mixing.mixed(none).count() == 0
    pages = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert urls.fit(urls.weakly_labelled(pages)) is None and urls.judge(pages, None).count() == 0
