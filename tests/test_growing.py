"""Truth brought up to date against truth found from scratch."""

import random

import pytest

from bitfold.operators import postings
from bitfold.operators.classes import collapse_copies
from bitfold.operators.overlap import similar_pairs
from bitfold.plans import growing

COLUMNS = growing.PAIR


def as_rows(df):
    return sorted(tuple(r) for r in df.select(*COLUMNS).collect())


def changed(rows, seed=1):
    """Rows removed, added, altered, and copies of old and new sets under ids before and after the others."""
    rng, out = random.Random(seed), {d: set(s) for d, s in rows.items()}
    for d in rng.sample(sorted(rows), 12):
        del out[d]
    for d in rng.sample(sorted(out), 8):
        out[d] ^ {3} and out[d].symmetric_difference_update({rng.randrange(150)})
    for k in range(10):
        out[1000 + k] = set(rng.choice(list(out.values()))) ^ {rng.randrange(150)}
        out[-1 - k] = set(rng.choice(list(rows.values())))
    return out


@pytest.mark.parametrize("name,threshold,comparison", [("jaccard_similarity", 0.2, "gt"), ("cosine_similarity", 0.5, "ge"), ("inner_product", 3, "gt")])
def test_extended_truth_equals_truth_from_scratch(make_sets, random_rows, name, threshold, comparison):
    rows = random_rows(n=50)
    before, now = collapse_copies(make_sets(rows, 150)), collapse_copies(make_sets(changed(rows), 150))
    saved = similar_pairs(before, name, threshold, comparison)
    got = growing.extended_truth(now, saved, before.shapes, name, threshold, comparison)
    assert as_rows(got) == as_rows(similar_pairs(now, name, threshold, comparison))
    assert got.schema["sim"].metadata == {"threshold": threshold, "comparison": comparison}
    with pytest.raises(ValueError):
        growing.extended_truth(now, saved, before.shapes, name, threshold / 2, comparison)


def test_known_classes_never_meet(make_sets, random_rows, monkeypatch):
    rows = random_rows(n=50)
    before, after = make_sets(rows, 150), dict(rows) | {900: set(rows[20]) | {147, 148, 149}, 901: {1, 2, 3}}
    now, shapes, lefts = collapse_copies(make_sets(after, 150)), collapse_copies(before).shapes, []
    across = postings._across

    def watched(index, key):
        lefts.append({r["doc_id"] for r in index.where("n_left > 0").select("row.doc_id").distinct().collect()})
        return across(index, key)

    monkeypatch.setattr(postings, "_across", watched)
    _, fresh = growing.known_and_fresh(now, shapes)
    assert {r["doc_id"] for r in fresh.collect()} == {900, 901}
    growing.fresh_pairs(now, fresh, "jaccard_similarity", 0.3, "gt")
    assert len(lefts) == 1 and lefts[0] <= {900, 901}


def test_growing_truth_is_saved_and_reused(make_sets, random_rows, tmp_path, monkeypatch):
    rows, path = random_rows(n=30), str(tmp_path)
    found = []
    whole, delta = growing.similar_pairs, growing.extended_truth
    monkeypatch.setattr(growing, "similar_pairs", lambda *a, **k: found.append("pairs") or whole(*a, **k))
    monkeypatch.setattr(growing, "extended_truth", lambda *a, **k: found.append("extended") or delta(*a, **k))
    states = [rows, rows, changed(rows), changed(changed(rows), 2)]
    for state in states:
        sets = make_sets(state, 150)
        got = growing.growing_truth(sets, "jaccard_similarity", 0.3, path, "d")
        assert as_rows(got) == as_rows(similar_pairs(collapse_copies(sets), "jaccard_similarity", 0.3, "gt"))
    assert found == ["pairs", "extended", "pairs", "extended", "pairs"]
    growing.growing_truth(sets, "jaccard_similarity", 0.1, path, "d")
    assert found[-1] == "pairs" and found.count("extended") == 2
