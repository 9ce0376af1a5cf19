"""Whitening, mixing and token alignment against brute force, and on odd tables."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from feedgraph.llm import alignment, whitening
from feedgraph.llm.alignment import Encoders, cross_alignment, diagonal_runs
from feedgraph.llm.mixing import weighted_mix
from feedgraph.llm.queries import byte_and_piece_tokenizers
from feedgraph.llm.whitening import bidiagonal, directions, dqds, whiten

VECTORS = "vec_id long, embedding array<double>, n long, x long, slot long, v string"
DOCS = "doc_id long, text string, source string, row long, size long, pairs long, rank long, _part long"


# --- whitening ---------------------------------------------------------------------------------------------------------


def matrices():
    rng = np.random.default_rng(3)
    plain = rng.standard_normal((20, 20))
    graded = plain * 10.0 ** (-np.arange(20) / 4)[None, :]
    twice = np.linalg.qr(rng.standard_normal((20, 20)))[0] @ np.diag([5.0] * 5 + [3.0] * 5 + [1.0] * 10) @ np.linalg.qr(rng.standard_normal((20, 20)))[0]
    close = np.linalg.qr(rng.standard_normal((20, 20)))[0] @ np.diag(1 + 1e-10 * np.arange(20)) @ np.linalg.qr(rng.standard_normal((20, 20)))[0]
    low_rank = rng.standard_normal((20, 4)) @ rng.standard_normal((4, 20))
    gap = plain.copy()
    gap[:, 7] = 0
    wilkinson = np.linalg.cholesky(np.diag(np.abs(np.arange(21) - 10.0) + 2) + np.diag(np.ones(20), 1) + np.diag(np.ones(20), -1)).T
    return {"plain": plain, "graded": graded, "twice": twice, "close": close, "low_rank": low_rank, "gap": gap, "identity": np.eye(20), "zero": np.zeros((5, 5)), "one": np.array([[2.0]]), "wilkinson": wilkinson}


@pytest.mark.parametrize("name", matrices())
def test_directions_are_right_singular_vectors(name):
    m = matrices()[name]
    r = np.linalg.qr(m, mode="r")
    values, vectors = directions(r, 32)
    true = np.linalg.svd(m, compute_uv=False) ** 2
    rank = int((true > true[0] * 1e-25).sum()) if true[0] else 0
    assert len(values) == min(rank, 32)
    if rank:
        assert np.allclose(values, true[:rank], rtol=1e-10, atol=true[0] * 1e-27)
        assert np.abs(vectors @ vectors.T - np.eye(rank)).max() < 1e-12
        assert np.abs(vectors @ (m.T @ m) - values[:, None] * vectors).max() < 1e-12 * true[0]


def test_dqds_is_accurate_for_small_values():
    r = np.triu(np.ones((30, 30))) * (10.0 ** -np.arange(30))[:, None]
    diagonal, above, _ = bidiagonal(r)
    found = dqds(diagonal, above)
    assert np.all(np.diff(found) <= 0) and math.isclose(found[0], np.linalg.svd(r, compute_uv=False)[0] ** 2, rel_tol=1e-13)
    # The determinant is the product of all singular values: the tiny ones are right to many digits too.
    assert math.isclose(sum(map(math.log, found)) / 2, sum(math.log(abs(x)) for x in diagonal), rel_tol=1e-12)


def brute_whitening(rows, k):
    good = [(i, [math.floor(64 * c) + 1_000_000 for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([v for _, v in good], dtype=np.int64)
    n, total = len(x), x.sum(axis=0)
    centred = x - total / n
    e, axes = np.linalg.eigh(centred.T @ centred / n)
    e, axes = e[::-1][:k], axes[:, ::-1][:, :k]
    white = centred @ axes / np.sqrt(e)
    deviation = [sum((n * int(c) - int(s)) ** 2 for c, s in zip(v, total, strict=True)) for _, v in good]
    return [i for i, _ in good], white, deviation, e / (centred * centred).sum() * n, axes


def vector_rows():
    rng = np.random.default_rng(5)
    rows = [(k, (rng.standard_normal(12) * np.arange(1, 13)).tolist()) for k in range(400)]
    rows += [(400, None), (401, [None] * 12), (402, [float("nan")] * 12), (403, [math.inf] * 12), (404, []), (405, [1.0] * 3), (7, rows[7][1]), (None, rows[8][1])]
    return rows


@pytest.mark.parametrize("fan_in", [2, 16])
def test_whitening(spark, monkeypatch, fan_in):
    monkeypatch.setattr(whitening, "FAN_IN", fan_in)
    monkeypatch.setattr(whitening, "BLOCK", 5)
    rows = vector_rows()
    ids, white, deviation, explained, _ = brute_whitening([r for r in rows if r[0] not in (405,)], 5)
    found = whiten(spark.createDataFrame([(*r, 1, 2, 3, "v") for r in rows], VECTORS).repartition(7), 5).toPandas()
    assert len(found) == 5 * len(ids) and Counter(found["vec_id"].fillna(-1)) == {(-1 if i is None else i): 5 * c for i, c in Counter(ids).items()}
    assert set(found["n"]) == {len(ids)} and found["identity_error"].nunique() == 1 and found["identity_error"][0] < 1e-10
    by = {(int(r.vec_id), int(r.component)): r for r in found.dropna(subset=["vec_id"]).itertuples()}
    for c in range(5):
        first = by[(ids[0], c + 1)]
        sign = np.sign(first.whitened * white[0, c])
        for i, w, dev in zip(ids, white[:, c], deviation, strict=True):
            if i is not None:
                r = by[(i, c + 1)]
                assert abs(r.whitened * sign - w) < 1e-8 and r.deviation == dev and math.isclose(r.explained, explained[c], rel_tol=1e-10)


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, None), (2, [])]])
def test_tables_without_directions(spark, rows):
    found = whiten(spark.createDataFrame([(*r, 1, 2, 3, "v") for r in rows], VECTORS))
    assert found.count() == 0 and found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_deviation_beyond_a_long_is_null(spark):
    rows = [(k, [float((-1) ** k * 2**32), float(k % 3)]) for k in range(6)]
    found = whiten(spark.createDataFrame([(*r, 1, 2, 3, "v") for r in rows], VECTORS)).collect()
    assert len(found) == 12 and all(r.deviation is None for r in found)


# --- mixing ------------------------------------------------------------------------------------------------------------


def brute_mix(rows, weights=(3, 1, 2), share=1.5, repeats=2):
    size = {i: len(re.findall("[^\x20\x09-\x0d]+", t or "")) for i, t, _ in rows}
    sources = sorted({s for _, _, s in rows}, key=lambda s: (s is None, s or ""))
    total = {s: sum(size[i] for i, _, t in rows if t == s) for s in sources}
    weight = {s: weights[k % len(weights)] for k, s in enumerate(sources)}
    target, budget = {}, share * sum(total.values())
    while True:
        left = [s for s in sources if s not in target]
        level = (budget - sum(target.values())) / max(1, sum(weight[s] for s in left))
        full = [s for s in left if weight[s] * level > repeats * total[s]]
        if not full:
            break
        target |= {s: float(repeats * total[s]) for s in full}
    target |= {s: weight[s] * level for s in left}
    draw = lambda i: int(hashlib.md5(f"mix-{i}".encode()).hexdigest()[:15], 16)
    line = []
    for s in sources:
        done = 0
        for k in range(repeats):
            for i in sorted((i for i, _, t in rows if t == s), key=lambda i: (draw(i), i)):
                done += size[i]
                if size[i]:
                    line.append((done / target[s], sources.index(s), done, i))
    taken, mixed = Counter(), 0
    for _, _, _, i in sorted(line):
        mixed += size[i]
        if mixed > budget:
            break
        taken[i] += size[i]
    return size, total, target, taken


def mixture_rows(seed):
    rng = random.Random(seed)
    sources = ["a", "b", "ä", "", None, "c", "hot"]
    rows = [(i, " ".join("w" * rng.randint(1, 3) for _ in range(rng.choice([0, 1, 5, 30, 300]))), rng.choice([*sources, "hot", "hot", "hot"])) for i in range(300)]
    return [*rows, (300, None, "a"), (301, "", None), (302, " \n\t", "none but blank"), (303, "x " * 4000, "b")]


@pytest.mark.parametrize(("seed", "part_rows"), [(1, 7), (2, 50), (3, 100_000)])
def test_mixture(spark, seed, part_rows):
    rows = mixture_rows(seed)
    size, total, target, taken = brute_mix(rows)
    docs = spark.createDataFrame([(i, t, s, 1, 2, 3, 4, 5) for i, t, s in rows], DOCS).repartition(3)
    documents, sequence = weighted_mix(docs, part_rows=part_rows)
    found, line = documents.collect(), sequence.orderBy("position").collect()
    assert sorted(r.doc_id for r in found) == sorted(i for i, _, _ in rows)
    for r in found:
        assert (r.size, r.source_size, r.taken) == (size[r.doc_id], total[r.source], taken[r.doc_id]) and math.isclose(r.target, target[r.source])
        assert r.taken <= 2 * r.size
    for s in target:
        assert abs(sum(r.taken for r in found if r.source == s) - target[s]) <= 2 * max(size[i] for i, _, t in rows if t == s)
    position = 0
    for r in line:  # the sequence is gapless and by finish time
        assert r.position == position
        position += r["size"]
    assert position == sum(taken.values()) and [r.finish for r in line] == sorted(r.finish for r in line)


def test_mixture_of_odd_tables(spark):
    empty = spark.createDataFrame([], DOCS)
    documents, sequence = weighted_mix(empty)
    assert documents.count() == 0 and sequence.count() == 0
    rows = [(None, "a b c", "s"), (None, "a b c", "s"), (1, "a b c", "s"), (1, "d e", "s"), (2, "", "t"), (3, None, "u")]
    found = weighted_mix(spark.createDataFrame([(i, t, s, 1, 2, 3, 4, 5) for i, t, s in rows], DOCS))[0].collect()
    assert len(found) == 6 and sum(r.taken for r in found) in range(11, 17) and all(r.target == 16.5 for r in found if r.source == "s")
    blank = weighted_mix(spark.createDataFrame([(1, "", "s", 1, 2, 3, 4, 5), (2, None, None, 1, 2, 3, 4, 5)], DOCS))[0].collect()
    assert [(r.taken, r.target) for r in blank] == [(0, 0.0), (0, 0.0)]


# --- alignment ---------------------------------------------------------------------------------------------------------


@given(st.lists(st.integers(1, 60), min_size=1, max_size=60, unique=True), st.lists(st.integers(1, 60), min_size=1, max_size=60, unique=True))
@settings(max_examples=300, deadline=None)
def test_diagonal_runs(a, b):
    end = max(*a, *b)
    a, b = sorted({*a, end}), sorted({*b, end})
    run_a, run_b, run_n, walk_a, walk_b, stop_a, stop_b = diagonal_runs(a, b)
    links = [(i + k, j + k) for i, j, n in zip(run_a, run_b, run_n, strict=True) for k in range(n)] + list(zip(walk_a, walk_b, strict=True))
    starts = [0, *a[:-1]], [0, *b[:-1]]
    overlap = [(i, j) for i in range(len(a)) for j in range(len(b)) if max(starts[0][i], starts[1][j]) < min(a[i], b[j])]
    assert sorted(links) == overlap
    groups = [(i + k + 1, j + k + 1) for i, j, n in zip(run_a, run_b, run_n, strict=True) for k in range(n)] + list(zip(stop_a, stop_b, strict=True))
    assert sorted(groups) == [(a.index(x) + 1, b.index(x) + 1) for x in sorted(set(a) & set(b))]


def test_long_runs_are_probed_in_few_comparisons():
    class Counted(list):
        compared = 0

        def __getitem__(self, at):
            Counted.compared += isinstance(at, slice)
            return super().__getitem__(at)

    ends = list(range(1, 100_001))
    other = [e for e in ends if e != 70_000]
    found = diagonal_runs(Counted(ends), Counted(other))
    assert found[2] == [69_999, 29_999]
    assert Counted.compared < 200


WORDS = ["the", "word's", "naïve", "東京", "Zürich-", "<|endoftext|>", "<s>", "</s>", "<unk>", "<0x41>", "▁q", " ", "á", "🙂🙂", "1234567", "\x00", "don't!!", "x" * 70, "　", "\x85", "ﬁ", " "]
SPACES = [" ", "  ", "\n", " \n ", "\t", "   ", "\r\n", ""]


def odd_texts(n=300, seed=4):
    rng = random.Random(seed)
    made = ["".join(rng.choice(WORDS) + rng.choice(SPACES if rng.random() < 0.3 else [" "]) for _ in range(rng.randint(1, 12))) for _ in range(n)]
    return [*made, " " + made[0], "  " + made[1], "\n", " ", "a", "plain words only here and there, they said. " * 300]


def whole_ids(enc, text):
    """Ids of A and of B, each tokenizer fed the whole text."""
    a, b = (enc.a.encode(" " + text, add_special_tokens=False).ids, enc.b.encode(text)) if text else ([], [])
    back = b"".join(enc.bytes_a[i] for i in a) == (" " + (text or "")).encode() == b"".join(enc.bytes_b[i] for i in b)
    return (a, b) if back else ([], [])


def whole_alignment(enc, text):
    """(ids of A, of B, groups, links) of one text."""
    a, b = whole_ids(enc, text)
    ends = [np.cumsum([len(table[i]) for i in ids]).tolist() for table, ids in ((enc.bytes_a, a), (enc.bytes_b, b))]
    groups, at = [], [0, 0]
    for x in sorted(set(ends[0]) & set(ends[1])):
        to = [e.index(x) + 1 for e in ends]
        groups.append((a[at[0] : to[0]], b[at[1] : to[1]]))
        at = to
    links = [(a[i], b[j]) for i in range(len(a)) for j in range(len(b)) if max([0, *ends[0]][i], [0, *ends[1]][j]) < min(ends[0][i], ends[1][j])]
    return a, b, groups, links


def test_both_engines_of_the_byte_level_tokenizer_agree():
    enc = Encoders(*byte_and_piece_tokenizers())
    whole = 0
    for t in [*odd_texts(), "x" * 3000, " " * 700 + "y"]:
        for unbroken in (False, True):
            a, b = enc.encode(" " + t, unbroken)
            assert a == enc.a.encode(" " + t, add_special_tokens=False).ids and b == enc.b.encode(t)
        whole += enc.joined(a, b) == ((" " + t).encode(),) * 2
    assert 100 < whole < len(odd_texts())


@pytest.mark.parametrize(("known", "cache"), [(1 << 17, 1 << 26), (40, 1 << 12), (0, 1 << 26)])
def test_alignment(spark, monkeypatch, known, cache):
    monkeypatch.setattr(alignment, "CACHE_BYTES", cache)
    monkeypatch.setattr(alignment, "CHUNK", 2000)
    enc = Encoders(*byte_and_piece_tokenizers())
    texts = [*odd_texts(60)[:-1], "plain words only here and there, they said. " * 20, "", None]
    rows = [*enumerate(texts), (3, texts[3]), (None, texts[4]), (None, None)]
    met = [whole_alignment(enc, t) for _, t in rows]
    count = Counter(p for _, _, _, links in met for p in set(links))
    best = defaultdict(int)
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    expected = []
    for (i, _), (a, b, groups, links) in zip(rows, met, strict=True):
        written = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        digest = hashlib.sha256(written.encode()).hexdigest() if written else ""
        expected.append((str(i), len(a), len(b), len(groups), len(links), sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links), digest))
    docs = spark.createDataFrame([(i, t, "s", 1, 2, 3, 4, 5) for i, t in rows], DOCS).repartition(3)
    found = cross_alignment(docs, *byte_and_piece_tokenizers(), known_pairs=known).collect()
    assert sorted((str(r.doc_id), *r[1:]) for r in found) == sorted(expected)
    assert cross_alignment(docs.limit(0), *byte_and_piece_tokenizers()).count() == 0
