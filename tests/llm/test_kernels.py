"""Text kernels, suffix arrays, packing, the loser tree and the models, against brute force and without Spark."""

from __future__ import annotations

import re
import tracemalloc
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from feedgraph.llm import class_lm, decontaminate, jaccard_join, kernel, packing, quality_gam, quality_rules, suffix_dedup, warc

TEXT = st.text(alphabet="abAB é\n\t.,#|ñ0", max_size=60)
TEXTS = st.lists(TEXT, min_size=1, max_size=6)


def chunk(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), dtype=np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in raw]))).astype(np.int64)


@given(TEXTS)
@settings(max_examples=150, deadline=None)
def test_words_and_shingles(texts):
    data, offsets = chunk(texts)
    starts, ends, owner = kernel.word_spans(data, offsets)
    found = [(int(o), bytes(data[a:b]).decode()) for a, b, o in zip(starts, ends, owner, strict=True)]
    assert found == [(k, w) for k, t in enumerate(texts) for w in re.findall("[^\x20\x09-\x0d]+", t)]
    low = str.maketrans("AB", "ab")
    for t, elements in zip(texts, kernel.shingle_sets(data, offsets), strict=True):
        w = re.findall("[^\x20\x09-\x0d]+", t.translate(low))
        assert len(elements) == len({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}) * bool(w)


def test_chunks_cover_all_rows():
    column = pa.array(["ab", None, "", "c" * 50, "d"]).slice(1)
    seen = [(first, bytes(data), offsets.tolist()) for first, data, offsets in kernel.byte_chunks(column, 3)]
    assert [s[0] for s in seen] == [0, 2, 3]
    assert b"".join(s[1] for s in seen) == b"c" * 50 + b"d"
    assert list(kernel.byte_chunks(pa.array([], type=pa.string()))) == []


@given(TEXTS)
@settings(max_examples=150, deadline=None)
def test_quality_measures(texts):
    got = quality_rules.measure(*chunk(texts))
    for k, t in enumerate(texts):
        w = re.findall("[^\x20\x09-\x0d]+", t)
        assert got["n_words"][k] == len(w)
        assert got["word_chars"][k] == sum(map(len, w))
        assert got["n_symbols"][k] == sum(c in "#*$%&|<>" for c in t)
        lines, seen = 0, set()
        for line in t.split("\n"):
            if re.search("[^\x20\x09-\x0d]", line):
                lines += line in seen
                seen.add(line)
        assert got["n_dup_lines"][k] == lines
        for n, name in ((8, "n_repeat_words"),):
            windows = Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
            inside = {i + j for i in range(len(w) - n + 1) if windows[tuple(w[i : i + n])] > 1 for j in range(n)}
            assert got[name][k] == len(inside)
            assert got["rep8_chars"][k] == sum(len(w[i]) for i in inside)


def test_lines_of_texts_that_end_in_newlines():
    texts = ["x\n", "l\nm\nl\nl", "x\nx\n", "y\ny\n\n", "", "z\nz"]
    got = quality_rules.measure(*chunk(texts))
    assert got["n_dup_lines"].tolist() == [0, 2, 1, 1, 0, 1]
    assert got["dup_line_chars"].tolist() == [0, 3, 2, 2, 0, 2]


@given(st.lists(st.binary(min_size=1, max_size=40), min_size=1, max_size=5), st.integers(2, 4))
@settings(max_examples=100, deadline=None)
def test_suffix_arrays(texts, letters):
    texts = [bytes(b % letters for b in t) for t in texts]
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    lengths = np.array([len(t) for t in texts])
    last = np.repeat(np.cumsum(lengths), lengths)
    order, _ = suffix_dedup.suffix_order(data, last, int(lengths.max()))
    suffixes = [bytes(data[i : last[i]]) for i in range(len(data))]
    assert [suffixes[i] for i in order] == sorted(suffixes)
    prefix = suffix_dedup.common_prefixes(data, last, order)
    for a, b in zip(order[1:], order[:-1], strict=True):
        x, y = suffixes[a], suffixes[b]
        same = next((k for k in range(min(len(x), len(y))) if x[k] != y[k]), min(len(x), len(y)))
        assert prefix[a] == same


@given(st.lists(st.binary(max_size=90), min_size=1, max_size=5))
@settings(max_examples=100, deadline=None)
def test_equal_windows_share_anchors_and_segments_cover_all(texts):
    texts = [bytes(b % 3 for b in t) for t in texts]
    data, offsets = np.frombuffer(b"".join(texts), dtype=np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
    anchor_of: dict[bytes, int] = {}
    covered = Counter()
    for text, start, size, anchor in zip(*suffix_dedup.segments(data, offsets, 20, 5), strict=True):
        assert start + size <= len(texts[text])
        for s in range(start, start + size - 19):
            covered[(int(text), int(s))] += 1
            assert anchor_of.setdefault(texts[text][s : s + 20], int(anchor)) == int(anchor)
    assert covered == Counter((k, s) for k, t in enumerate(texts) for s in range(len(t) - 19))


def test_similar_sets_share_a_signature_and_pass_sketches():
    rng = np.random.default_rng(5)
    for _ in range(400):
        n = int(rng.integers(1, 400))
        pool = kernel.mix(rng.integers(1, 2**62, 2 * n + 2).astype(np.uint64))
        a = np.unique(pool[:n])
        swap = int(rng.integers(0, n // 4 + 1))
        b = np.unique(np.concatenate((a[swap:], pool[n : n + int(rng.integers(0, n // 4 + 2))])))
        both = len(np.intersect1d(a, b))
        if not len(b) or 100 * both < 80 * (len(a) + len(b) - both):
            continue
        shared = [band for band in set(jaccard_join.bands(len(a))) & set(jaccard_join.bands(len(b))) if set(jaccard_join.signatures(a, band)) & set(jaccard_join.signatures(b, band))]
        assert shared
        for band in shared:
            x, y = (jaccard_join.odd_sketch(s, band) for s in (a, b))
            assert 9 * int(np.bitwise_count(x ^ y).sum()) <= len(a) + len(b)


def rows_of(frames, schema):
    return [r for f in frames for r in pa.Table.from_batches([f], schema=schema).to_pylist()]


@pytest.mark.parametrize("sizes", [[1, 2, 24, 25, 1, 60, 3], [2000], [1], [30, 30]])
@pytest.mark.parametrize("cut", [1, 7, 24, 1000])
def test_buckets_as_a_stream(sizes, cut):
    signature = np.repeat(np.arange(len(sizes)), sizes)
    n_rows = len(signature)
    schema = kernel.arrow_schema(jaccard_join.SIGNED)
    whole = pa.RecordBatch.from_arrays([pa.array(signature), pa.array(np.arange(n_rows)), pa.array(np.full(n_rows, 50, np.int32)), pa.array(np.full(n_rows, 16, np.int32))], schema=schema)
    out_schema = kernel.arrow_schema(jaccard_join.BUCKETS)
    out = rows_of(jaccard_join._buckets(whole.slice(i, cut) for i in range(0, n_rows, cut)), out_schema)
    at = np.concatenate(([0], np.cumsum(sizes)))
    pairs = {p: p[0] == at[k] for k, n in enumerate(sizes) for p in combinations(range(at[k], at[k + 1]), 2) if n <= jaccard_join.SMALL or p[0] == at[k]}
    assert sorted((r["a"], r["b"], r["star"]) for r in out if r["b"] is not None) == sorted((*p, s) for p, s in pairs.items())
    members = {(r["a"], r["block"]) for r in out if r["b"] is None}
    assert len(members) == sum(r["b"] is None for r in out)
    assert members == {(at[k] + i, i // jaccard_join.BLOCK) for k, n in enumerate(sizes) if n > jaccard_join.SMALL for i in range(n)}


def test_copies_are_one_row_of_a_bucket():
    schema = kernel.arrow_schema(jaccard_join.SIGNED)
    rows = pa.RecordBatch.from_arrays([pa.array(np.repeat([1, 2], 60)), pa.array(np.repeat([5, 6, 7, 5], 30)), pa.array(np.full(120, 50, np.int32)), pa.array(np.full(120, 16, np.int32))], schema=schema)
    for cut in (1, 7, 120):
        out = rows_of(jaccard_join._buckets(rows.slice(i, cut) for i in range(0, 120, cut)), kernel.arrow_schema(jaccard_join.BUCKETS))
        assert sorted((r["a"], r["b"]) for r in out) == [(5, 6), (5, 7)]


def test_sets_at_just_the_similarity_share_a_signature():
    """9 of 10 elements common is 0.818..., 8 of 10 with sizes 8 and 10 is 0.8 exactly."""
    rng = np.random.default_rng(8)
    for n in (*range(8, 200, 8), 1000, 4000):
        a = kernel.mix(rng.integers(1, 2**62, n + n // 4).astype(np.uint64))
        b = a[: len(a) * 4 // 5]
        assert 100 * len(b) >= 80 * len(a) - 80
        if 100 * len(b) < 80 * len(a):
            continue
        a, b = np.sort(a), np.sort(b)
        assert any(set(jaccard_join.signatures(a, k)) & set(jaccard_join.signatures(b, k)) for k in set(jaccard_join.bands(len(a))) & set(jaccard_join.bands(len(b))))


def naive_hits(doc, items, window):
    hit, found = set(), set()
    for item, tokens in items:
        n = min(window, len(tokens))
        for i in range(len(tokens) - n + 1 if n else 0):
            for j in range(len(doc) - n + 1):
                if doc[j : j + n] == tokens[i : i + n]:
                    hit |= set(range(j, j + n))
                    found.add(item)
    return hit, found


def found_in(docs, items, window, slop):
    """Of each document its number of hit words, its items with exact matches, and those with proximity matches."""
    data, offsets = chunk([b" ".join(d).decode() for d in docs])
    terms, bounds, places, begins, n_words = decontaminate.postings(data, offsets, max(window, slop) + 1)
    assert n_words.tolist() == [len(d) for d in docs]
    uses = Counter(t for _, tokens in items for t in tokens)
    number = {t: k for k, t in enumerate(uses)}
    lists = {number[t]: places[bounds[k] : bounds[k + 1]] for k, t in enumerate(terms) if t in number}
    windows, members = [], []
    for item, tokens in items:
        n = min(window, len(tokens))
        for i in range(len(tokens) - n + 1 if n else 0):
            own = tokens[i : i + n]
            least = min(range(n), key=lambda k: (uses[own[k]], k))
            windows += [(len(members), [number[t] for t in own], 0, True), (len(members), [number[t] for t in own], least, False)]
            members.append(item)
    got = decontaminate.search(list(lists), list(lists.values()), begins.astype(np.int64), windows, slop)
    named = {(d, members[w], bool(e)) for d, w, e in zip(got["doc"].tolist(), got["win"].tolist(), got["exact"].tolist(), strict=True)}
    return [(got["n_hit"][k], *({i for d, i, e in named if d == k and e == exact} for exact in (True, False))) for k in range(len(docs))]


def naive_near(doc, items, window, slop):
    uses = Counter(t for _, tokens in items for t in tokens)
    found = set()
    for item, tokens in items:
        n = min(window, len(tokens))
        for i in range(len(tokens) - n + 1 if n else 0):
            own = tokens[i : i + n]
            anchor = min(own, key=lambda t: (uses[t], own.index(t)))
            found |= {item for p, t in enumerate(doc) if t == anchor and set(own) <= set(doc[max(0, p - slop) : p + slop + 1])}
    return found


@pytest.mark.parametrize("step", [1, 1 << 18])
@given(
    docs=st.lists(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=30), min_size=1, max_size=4),
    tests=st.lists(st.lists(st.sampled_from([b"a", b"b", b"z"]), max_size=14), min_size=1, max_size=4), slop=st.integers(0, 15),
)
@settings(max_examples=100, deadline=None)
def test_phrases(step, docs, tests, slop):
    items = list(enumerate(tests))
    decontaminate.STEP, before = step, decontaminate.STEP
    for doc, (n_hit, exact, near) in zip(docs, found_in(docs, items, 10, slop), strict=True):
        hit, found = naive_hits(doc, items, 10)
        assert (exact, n_hit) == (found, len(hit))
        assert near == naive_near(doc, items, 10, slop)
    decontaminate.STEP = before


def test_proximity():
    found = found_in([[b"z", b"q", b"x", b"y"], [b"x", *[b"q"] * 20, b"y", b"z"]], [(1, [b"x", b"y", b"z"])], 10, 3)
    assert [f[1:] for f in found] == [(set(), {1}), (set(), set())]


def test_equal_windows_of_many_items_are_one_in_the_index():
    """8,000 places of a window that 2,000 items share: the window is searched once."""
    words = [b"w%d" % k for k in range(10)]
    data, offsets = chunk([b" ".join(words * 8000).decode()])
    terms, bounds, places, begins, _ = decontaminate.postings(data, offsets, 16)
    number = {t: k for k, t in enumerate(terms)}
    lists = [places[bounds[k] : bounds[k + 1]] for k in range(len(terms))]
    got = decontaminate.search(list(range(len(terms))), lists, begins.astype(np.int64), [(7, [number[w] for w in words], 0, True)], 15)
    assert (got["doc"].tolist(), got["win"].tolist(), got["n_hit"].tolist()) == ([0], [7], [80_000])


def test_hash_tells_thue_morse_strings_apart():
    a = b"a"
    while len(a) < 2048:
        a += bytes(195 - c for c in a)
    data = np.frombuffer(a + bytes(195 - c for c in a), dtype=np.uint8)
    one, other = kernel.span_hashes(data, np.array([0, 2048]), np.array([2048, 4096]))
    assert one != other
    lines = quality_rules.measure(*chunk([a.decode() + "\n" + bytes(195 - c for c in a).decode()]))
    assert lines["n_dup_lines"].tolist() == [0]


def test_hashes_of_long_chunks(monkeypatch):
    rng = np.random.default_rng(9)
    data = rng.integers(0, 256, 3000).astype(np.uint8)
    starts = rng.integers(0, 2900, 200)
    ends = starts + rng.integers(0, 100, 200)
    whole = kernel.span_hashes(data, starts, ends)
    monkeypatch.setattr(kernel, "REDUCE_EVERY", 64)
    assert (kernel.span_hashes(data, starts, ends) == whole).all()


def test_blocks_are_hashed_by_pieces(monkeypatch):
    monkeypatch.setattr(kernel, "CHUNK_BYTES", 1024)
    monkeypatch.setattr(kernel, "PRIME_POWERS", tuple(kernel.PrimePowers(b) for b in kernel.BASES))
    rng = np.random.default_rng(10)
    data = rng.integers(0, 256, 20_000).astype(np.uint8)
    starts = np.sort(rng.integers(0, 19_900, 500))
    ends = starts + rng.integers(0, 100, 500)
    got = kernel.span_hashes(data, starts, ends)
    assert max(len(t) for p in kernel.PRIME_POWERS for t in p.tables) <= 1025
    assert got.tolist() == [kernel.span_hashes(data[a:b], np.array([0]), np.array([b - a]))[0] for a, b in zip(starts, ends, strict=True)]


def test_shards_stay_small():
    rng = np.random.default_rng(11)
    texts = [bytes(rng.integers(97, 101, 300).astype(np.uint8)) for _ in range(700)]
    texts += [t[:250] + b"-" * 30 for t in texts[:100]]
    tracemalloc.start()
    try:
        _, repeated, _ = suffix_dedup.repeated_windows(texts, np.ones(len(texts), dtype=np.int64))
        assert tracemalloc.get_traced_memory()[1] < 80 * sum(map(len, texts))
    finally:
        tracemalloc.stop()
    runs = [r.sum() for r in np.split(repeated, np.cumsum([len(t) for t in texts])[:-1])]
    assert runs == [51] * 100 + [0] * 600 + [51] * 100


@given(st.lists(st.lists(st.integers(0, 50), max_size=8), max_size=6))
def test_loser_tree(runs):
    rows = [sorted((v, k, i) for i, v in enumerate(r)) for k, r in enumerate(runs)]
    assert list(warc.LoserTree(rows)) == sorted(x for r in rows for x in r)


@given(st.lists(st.integers(1, 40), max_size=40))
@settings(max_examples=150, deadline=None)
def test_packing_plan(lengths):
    counts = np.bincount(lengths, minlength=41) if lengths else np.zeros(41, dtype=np.int64)
    plan = packing.bin_completion(counts, 40)
    used = Counter()
    for filling, times in plan:
        assert sum(filling) <= 40
        used.update({s: n * times for s, n in Counter(filling).items()})
    assert used == Counter(lengths)
    assert packing.lower_bound(counts, 40) <= sum(n for _, n in plan) <= sum(n for _, n in packing.best_fit_decreasing(counts, 40))
    taken = {}
    for size, first, end, sequence, n, offset in packing.places(plan):
        assert taken.get(size, 0) == first
        taken[size] = end
        assert offset + n * size <= 40 and sequence >= 0
    assert taken == dict(Counter(lengths))


def optimum(lengths, capacity):
    best = len(lengths)

    def put(k, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(lengths):
            best = len(bins)
            return
        for i in {b: i for i, b in enumerate(bins)}.values():
            if bins[i] + lengths[k] <= capacity:
                put(k + 1, [*bins[:i], bins[i] + lengths[k], *bins[i + 1 :]])
        put(k + 1, [*bins, lengths[k]])

    put(0, [])
    return best


@given(st.lists(st.integers(3, 15), min_size=1, max_size=9))
@settings(max_examples=60, deadline=None)
def test_small_packings_are_optimal(lengths):
    lengths.sort(reverse=True)
    plan = packing.bin_completion(np.bincount(lengths, minlength=21), 20)
    assert sum(n for _, n in plan) == optimum(lengths, 20)


def test_many_lengths_are_searched_too():
    """300 lengths or more, where best-fit decreasing misses the bound."""
    rng = np.random.default_rng(1)
    lengths = []
    for _ in range(150):
        a, b = rng.integers(1030, 1900, 2)
        lengths += [a, b, 4096 - a - b] if 4096 - a - b > 400 else [a, 4096 - a]
    counts = np.bincount(lengths, minlength=4097)
    assert np.count_nonzero(counts) >= 300
    plan = packing.bin_completion(counts, 4096)
    used = Counter()
    for filling, times in plan:
        assert sum(filling) <= 4096
        used.update({s: n * times for s, n in Counter(filling).items()})
    assert used == Counter(lengths)
    assert packing.lower_bound(counts, 4096) <= packing.plan_size(plan) < packing.plan_size(packing.best_fit_decreasing(counts, 4096))


def test_over_a_thousand_open_lengths_are_searched_as_a_whole():
    rng = np.random.default_rng(3)
    counts = np.bincount(rng.integers(600, 2501, 5000), minlength=4097)
    assert np.count_nonzero(counts) > 1000
    first = packing.best_fit_decreasing(counts, 4096)
    searched = packing.complete(counts, 4096, first, 1)
    assert packing.lower_bound(counts, 4096) < packing.plan_size(searched) < packing.plan_size(first)
    used = np.zeros_like(counts)
    for filling, times in searched:
        assert sum(filling) <= 4096
        np.add.at(used, list(filling), times)
    assert (used == counts).all()


def test_token_ids_are_the_tokenizers():
    tokenizers = pytest.importorskip("tokenizers")
    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    whole, own = tokenizers.Tokenizer.from_file(path), packing.Encoder(path)
    texts = ["I'm don't 'S  x　y é ́a <|endoftext|> a<|startoftext|>b ſ's", "a.'s !'s (b)c--d e,f 12a3", "", "İI Σς ﬁ", "x\x85y\x1cz\x00w", "!", "a"]
    texts += ["".join(p) for p in zip(texts, reversed(texts), strict=True)]
    for ids, text in zip(own.encode_chunk(*chunk(texts)), texts, strict=True):
        assert np.frombuffer(ids, dtype="<u4").tolist() == whole.encode(text, add_special_tokens=False).ids


def naive_features(text):
    raw = text.encode()
    words = re.findall(rb"[^\x20\x09-\x0d]+", raw)
    n, size = max(len(words), 1), max(len(raw), 1)
    lines = raw.split(b"\n")
    count = lambda chars: sum(raw.count(bytes([c])) for c in chars)
    windows = Counter(tuple(words[i : i + 6]) for i in range(len(words) - 5))
    inside = {i + j for i in range(len(words) - 5) if windows[tuple(words[i : i + 6])] > 1 for j in range(6)}
    # Lines count with their line end, so the last one never equals an earlier one that has it.
    ended = [x + b"\n" for x in lines[:-1]] + [lines[-1]]
    return [
        np.log1p(len(words)), sum(map(len, words)) / n, sum(0x41 <= b <= 0x5A for b in raw) / size, sum(0x30 <= b <= 0x39 for b in raw) / size, count(b".,;:?'\"()-") / n,
        count(b"#*$%&<>@^~\\/_=+{}[]") / n, count(b"!") / n, count(b"|") / n, sum(b >= 0x80 for b in raw) / size, 1 - (len(words) - len(set(words))) / n, len(inside) / n,
        (len(ended) - len(set(ended))) / len(lines), len(words) / len(lines), sum(len(w) <= 2 for w in words) / n, sum(len(w) >= 12 for w in words) / n, len(lines) / n,
    ]


@given(TEXTS)
@settings(max_examples=150, deadline=None)
def test_quality_features(texts):
    assert np.allclose(quality_gam.features(*chunk(texts)), [naive_features(t) for t in texts])


def test_additive_scores_are_sums_of_table_entries():
    rng = np.random.default_rng(6)
    x = np.round(rng.random((900, 5)), 2)
    model = quality_gam.AdditiveModel().fit(x, (x[:, 0] + x[:, 1] * x[:, 2] > 0.8).astype(float), rounds=20)
    assert model.pairs and any(t.any() for t in model.tables)
    for row, score in zip(x[:100], model.scores(x[:100]), strict=True):
        logit = model.base + sum(table[sum(e <= v for e in edges)] for v, edges, table in zip(row, model.edges, model.tables, strict=True))
        logit += sum(grid[sum(e <= row[i] for e in model.coarse[i]), sum(e <= row[j] for e in model.coarse[j])] for (i, j), grid in zip(model.pairs, model.grids, strict=True))
        assert np.isclose(score, 1 / (1 + np.exp(-logit)))


def test_additive_model_learns_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.random((4000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality_gam.AdditiveModel().fit(x[:3000], y[:3000])
    assert ((model.scores(x[3000:]) > 0.5) == y[3000:]).mean() > 0.95
    assert quality_gam.AdditiveModel().fit(x[:0], y[:0]).scores(x[:2]).tolist() == [0.5, 0.5]
    assert quality_gam.AdditiveModel().fit(x[:9], np.ones(9)).scores(x[:2]).min() > 0.9


def test_exchange_finds_languages():
    rng = np.random.default_rng(2)
    stats = np.zeros((41, 2, 4), dtype=np.int64)
    classes = np.array([1, 2, *[3] * 38, 0])
    words = [rng.choice(np.arange(k % 2, 40, 2), 400) for k in range(60)]
    for _ in range(3):
        stats[:] = 0
        for w in words:
            t = np.concatenate(([40], w, [40]))
            np.add.at(stats, (t[:-1], 0, classes[t[1:]]), 1)
            np.add.at(stats, (t[1:], 1, classes[t[:-1]]), 1)
        classes = class_lm.exchange(stats, classes)
    assert classes[40] == class_lm.END_CLASS
    assert not {*classes[:40:2]} & {*classes[1:40:2]}


def test_warc_parse_rejects_damage():
    head = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:3>\r\nWARC-Date: d\r\nWARC-Target-URI: u\r\nWARC-Payload-Digest: sha1:{}\r\nContent-Type: t\r\nContent-Length: {}\r\n\r\n{}\r\n\r\n"
    good = head.format("3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ", 0, "").encode()
    assert [r[0] for r in warc.parse("a", good)] == [3]
    for bad in (good[:-1], b"x" + good, good.replace(b"3I42", b"AAAA")):
        with pytest.raises(ValueError):
            list(warc.parse("a", bad))


def test_crc_is_unsigned():
    assert zlib.crc32(b"a") == 3904355907
