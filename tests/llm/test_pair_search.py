"""The search for links that leaders miss, against all pairs."""

import random

import pytest

from alertweave.llm import minhash_dedup

SCHEMA = "doc_id long, middle long, part long, n long, common long, outside array<long>"


def _members(seed: int) -> tuple[dict[int, set[int]], dict[int, int]]:
    """Sets around the middle 0: edited, cut and grown ones, some of them copies of each other's edits."""
    draw = random.Random(seed)
    middle = list(range(40))
    sets, fresh = {0: set(middle)}, 1000
    for doc in range(1, 120):
        like = sets[draw.choice(list(sets))] if draw.random() < 0.5 else set(middle)
        lost = draw.sample(sorted(like), draw.randint(0, min(12, len(like) - 4)))
        grown = [draw.randint(100, 130) if draw.random() < 0.6 else (fresh := fresh + 1) for _ in range(draw.randint(0, 10))]
        sets[doc] = (like - set(lost)) | set(grown)
    return sets, {doc: draw.choice([0, 0, 0, doc]) for doc in sets}


@pytest.mark.parametrize(("seed", "percent"), [(1, 75), (2, 75), (3, 75), (4, 60), (5, 90)])
def test_no_link_between_components_is_left_out(spark, seed, percent):
    sets, part = _members(seed)
    holders = {x: sum(x in s for s in sets.values()) for s in sets.values() for x in s}
    rows = [
        (doc, 0, part[doc], len(s), sum(holders[x] > 1 for x in s), sorted(s - sets[0]))
        for doc, s in sets.items()
    ]
    found = {tuple(r) for r in minhash_dedup._rest(spark.createDataFrame(rows, SCHEMA), percent).collect()}
    linked = {
        (a, b)
        for a in sets
        for b in sets
        if a < b and part[a] != part[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    }
    assert linked and linked <= found
    assert all(part[a] != part[b] for a, b in found)


def test_a_group_with_edits_of_their_own_makes_no_pairs(spark):
    rows = [(0, 0, 0, 100, 100, [])]
    rows += [(i, 0, 0 if i % 2 else i, 100, 98, [1000 * i + j for j in range(15)]) for i in range(1, 400)]
    assert minhash_dedup._rest(spark.createDataFrame(rows, SCHEMA), 75).count() == 0
