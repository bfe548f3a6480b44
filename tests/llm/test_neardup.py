import re
from itertools import combinations

import numpy as np
import pytest

from cellwise.llm import neardup
from cellwise.llm.components import components
from helpers import awkward_documents, frame, lower


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def brute(rows):
    sets = {}
    for i, t in rows:
        sets.setdefault(i, shingles(t))
    label = {i: i for i in sets}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        shared = len(sets[a] & sets[b])
        if shared and 100 * shared >= 85 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            label[max(x, y)] = min(x, y)
    return sorted((i, len(sets[i]), find(i), find(i) == i) for i, _ in rows)


def got(df):
    return sorted(tuple(r) for r in df.select("doc_id", "n_shingles", "component_id", "kept").collect())


def test_against_brute_force(spark):
    rows = awkward_documents()
    assert got(neardup.near_duplicates(frame(spark, rows))) == brute(rows)


@pytest.mark.parametrize("hubs", [0, 1, 8])
def test_large_buckets(spark, hubs):
    """A chain: each text is near to the next, the ends are not near to each other."""
    words = [f"w{k}" for k in range(100)]
    rows = []
    for k in range(40):
        words[2 * k + 1] = f"changed{k}"
        rows.append((k, " ".join(words)))
    rows += [(100 + k, " ".join(f"w{j}" for j in range(60)) + f" tail{k}" * 30) for k in range(30)]
    assert got(neardup.near_duplicates(frame(spark, rows), neardup.Settings(hubs=hubs))) == brute(rows)


def test_star_around_a_text_that_is_not_the_least(spark):
    """Copies of one text, each changed in another place: near to it, not to each other."""
    words = [f"w{k}" for k in range(200)]
    rows = [(500, " ".join(words))]
    for k in range(60):
        own = list(words)
        for j in (3 * k, 3 * k + 7):
            own[j % 200] = f"changed{k}x{j}"
        rows.append((k, " ".join(own)))
    found = got(neardup.near_duplicates(frame(spark, rows)))
    assert found == brute(rows)
    assert sum(r[3] for r in found) == 1


def test_empty_table(spark):
    assert neardup.near_duplicates(frame(spark, []).limit(0)).count() == 0


def test_null_ids_stay_alone(spark):
    found = neardup.near_duplicates(frame(spark, [(None, "a b c d e f"), (3, "a b c d e f"), (4, "a b c d e f")])).collect()
    assert sorted(((r.doc_id, r.component_id, r.kept) for r in found), key=str) == [(3, 3, True), (4, 3, False), (None, None, True)]


def test_signatures_follow_the_definition():
    """The vectorised rounds give what one element at a time gives."""
    from cellwise.llm.text import mix

    rng = np.random.default_rng(1)
    size, sets = 24, [rng.integers(0, 2**63, n).astype(np.uint64) for n in (1, 3, 40, 400)]
    want = np.full((len(sets), size), 2**64 - 1, np.uint64)
    for s, values in enumerate(sets):
        for element in values:
            order = list(range(size))
            for step in range(size):
                drawn = mix(np.array([element + np.uint64((step + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))], np.uint64))[0]
                k = step + int(((int(drawn) & 0xFFFFFF) * (size - step)) >> 24)
                order[step], order[k] = order[k], order[step]
                want[s, order[step]] = min(want[s, order[step]], np.uint64((step << 40) | (int(drawn) >> 24)))
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    assert np.array_equal(neardup.superminhash(np.concatenate(sets), owner, len(sets), size), want)


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(2)
    errors = []
    for _ in range(30):
        both, one, two = (rng.integers(0, 2**63, n).astype(np.uint64) for n in (300, 50, 50))
        elements = np.concatenate([both, one, both, two])
        signature = neardup.superminhash(elements, np.repeat([0, 1], 350), 2, 120)
        errors.append((signature[0] == signature[1]).mean() - 0.75)
    assert abs(np.mean(errors)) < 0.03


@pytest.mark.parametrize("seed", [1, 2])
def test_components_of_random_links(spark, seed):
    rng = np.random.default_rng(seed)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 200, (150, 2))] + [(k, k + 1) for k in range(300, 360)] + [(500, k) for k in range(501, 560)] + [(None, 3), (4, None)]
    label = {x: x for p in pairs if None not in p for x in p}
    for _ in range(400):
        for a, b in pairs:
            if a is not None and b is not None:
                label[a] = label[b] = min(label[a], label[b])
    want = {x: y for x, y in label.items() if any(x in p and p[0] != p[1] for p in pairs if None not in p)}
    found = components(spark.createDataFrame(pairs, "a long, b long").repartition(5))
    assert dict(found.collect()) == want
    assert found.count() == len(want)


def test_no_links(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
