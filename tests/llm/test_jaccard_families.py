"""Large families of documents about the threshold: no link is lost, and pairs are not all proposed."""

from __future__ import annotations

import random

import numpy as np
import pytest

from feedgraph.llm import jaccard_join as jj
from feedgraph.llm import kernel

DOCS = "doc_id long, text string"


def family(n, body, tail, rng, first=0):
    """Documents of one body, each with an ending of its own."""
    shared = [f"b{first}x{rng.random()}" for _ in range(body)]
    return [(first + k, " ".join(shared + [f"t{first + k}x{i}" for i in range(tail)])) for k in range(n)]


def similarity(x, y):
    both = len(np.intersect1d(x, y))
    return both / (len(x) + len(y) - both)


@pytest.mark.parametrize("seed", range(6))
def test_bucket_pairs_lose_no_link(seed):
    rng = random.Random(seed)
    pool = rng.sample(range(1 << 60), 400)
    sets = []
    for _ in range(60):  # variants of a few bodies, with shared and own differences
        base = pool[: rng.choice([60, 80, 100])]
        own = [x for x in base if rng.random() > rng.choice([0.02, 0.06, 0.1])]
        sets.append(np.unique(np.array(own + rng.sample(pool[100:], rng.randint(0, 12)), dtype=np.uint64)))
    counters = np.zeros(1 << 10, dtype=np.int64)
    for s in sets:
        np.add.at(counters, (s % np.uint64(1 << 10)).astype(np.int64), 1)
    sizes = np.array([len(s) for s in sets])
    ids = np.arange(len(sets))
    sketches = np.stack([np.frombuffer(jj.odd_sketch(s, 64).tobytes(), dtype=np.uint64) for s in sets])
    prefixes = [np.frombuffer(jj.rarest(s, counters), dtype=np.uint32) for s in sets]
    links = {(i, j) for i in range(60) for j in range(i + 1, 60) if similarity(sets[i], sets[j]) >= 0.8}
    found = set(jj.bucket_pairs(ids, ids, None, sizes, sketches, prefixes, False))
    assert links and links <= {(int(a), int(b)) for a, b in found}
    trees = jj.Forest()
    for a, b in jj.bucket_pairs(ids, ids, None, sizes, sketches, prefixes, True):
        assert trees.unite(int(a), int(b))


def proposed(monkeypatch):
    """Counts the rows that the last two rounds propose."""
    counts, propose = [], jj.propose

    def counting(rows, forest):
        found = propose(rows, forest)
        counts.append(found.count())
        return found

    monkeypatch.setattr(jj, "propose", counting)
    return counts


def test_endings_just_too_long_make_no_pairs(spark, monkeypatch):
    rng = random.Random(1)
    counts, by_size = proposed(monkeypatch), {}
    for n in (75, 300):
        docs = family(n, 100, 13, rng)
        sets = kernel.shingle_sets(*as_chunk([t for _, t in docs[:2]]))
        assert 0.77 < similarity(*sets) < 0.8
        counts.clear()
        found = jj.jaccard_join(spark.createDataFrame(docs, DOCS).repartition(3)).collect()
        assert len({r.component_id for r in found}) == n
        by_size[n] = sum(counts)
    assert by_size[300] <= 8 * max(by_size[75], 75)


def as_chunk(texts):
    data = [t.encode() for t in texts]
    return np.frombuffer(b"".join(data), dtype=np.uint8), np.concatenate(([0], np.cumsum([len(d) for d in data])))


def test_families_that_link_in_part(spark):
    """Two bodies, endings short and long, and bridges: the groups are those of brute force."""
    rng = random.Random(2)
    docs = family(60, 100, 8, rng) + family(60, 100, 12, rng, 100)
    base = docs[70][1].split(" ")
    for k in range(40):  # near the second body, each at its own distance
        docs.append((200 + k, " ".join(base[: 100 - k % 9] + [f"u{k}x{i}" for i in range(k % 13)])))
    sets = kernel.shingle_sets(*as_chunk([t for _, t in docs]))
    trees = jj.Forest()
    for i in range(len(docs)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                trees.unite(docs[i][0], docs[j][0])
    found = jj.jaccard_join(spark.createDataFrame(docs, DOCS).repartition(3)).collect()
    assert {r.doc_id: r.component_id for r in found} == {i: trees.find(i) for i, _ in docs}
