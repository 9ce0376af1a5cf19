"""The corpus operators on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

from __future__ import annotations

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from feedgraph.llm import class_lm
from feedgraph.llm import decontaminate as decontaminate_module
from feedgraph.llm import suffix_dedup as suffix_module
from feedgraph.llm.chat import chat_format
from feedgraph.llm.class_lm import class_lm_scores
from feedgraph.llm.decontaminate import contamination_matches, decontaminate, drop_contaminated
from feedgraph.llm.jaccard_join import drop_near_copies, jaccard_join
from feedgraph.llm.packing import bin_completion, lower_bound, pack, sequences
from feedgraph.llm.quality_gam import drop_low_quality, quality_gam
from feedgraph.llm.quality_rules import quality_rules
from feedgraph.llm.queries import QUERIES, word_tokenizer
from feedgraph.llm.sharding import minimax_cuts, shard_by_bytes
from feedgraph.llm.suffix_dedup import remove_repeats, suffix_dedup
from feedgraph.llm.warc import archive_pages, read_archives, with_types, write_archives

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPLIT = "[^\x20\x09-\x0d]+"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 6))) for _ in range(n))


def corpus(seed=7):
    """Ids and texts: plain, copied, nearly copied, with shared passages, empty, null, very long, repeated."""
    rng = random.Random(seed)
    plain = [words(rng, rng.randint(1, 120)) for _ in range(40)]
    long = words(rng, 4000)
    passage = words(rng, 70)
    family = words(rng, 100).split(" ")
    near = [" ".join("X" if rng.random() < 0.01 else w for w in family) for _ in range(60)]
    shared = [f"{words(rng, 30)} {passage} {words(rng, 30)}" for _ in range(12)]
    texts = [*plain, *plain[:5], long, long + " end", *near, *shared, "", "   ", None, "a", "A", "ab " * 300, words(rng, 5) + "\n" + "same line here\n" * 90]
    rows = list(enumerate(texts))
    return [*rows, (3, plain[3]), (None, plain[0]), (None, None)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS).repartition(3)


def clashing(docs):
    """Extra columns whose names the operators use inside."""
    extra = ("digest", "n", "band", "group", "component_id", "score", "size", "row", "own", "first", "anchor", "copies", "number", "spans", "held_out", "words", "length",
        "_digest", "_copied", "_spans", "_nth", "d1", "d2", "k1", "k2", "copied", "block", "doc", "win", "term", "places", "text_")
    return docs.selectExpr("*", *[f"'x' as {c}" for c in extra])


OPERATORS = {
    "chat": None,
    "jaccard": jaccard_join,
    "lm": lambda d: class_lm_scores(d, n_classes=8, known_words=50, rounds=1),
    "rules": quality_rules,
    "shards": lambda d: shard_by_bytes(d, 4),
    "packing": lambda d: pack(d, word_tokenizer(), 64).drop("ids"),
    "suffix": suffix_dedup,
}
OPERATORS.pop("chat")


@pytest.mark.parametrize("name", OPERATORS)
def test_every_row_of_odd_tables_has_a_result(spark, name):
    rows = corpus()
    docs = frame(spark, rows)
    found = OPERATORS[name](docs).toPandas()
    ids = found.doc_id.where(found.doc_id.notna(), -1)
    if name == "packing":
        ids = ids[found.piece == 0]
    assert Counter(ids.astype(int)) == Counter(-1 if i is None else i for i, _ in rows)
    assert OPERATORS[name](docs.limit(0)).toPandas().empty
    again = OPERATORS[name](clashing(docs)).toPandas()
    drop = ["sequence_id", "offset"] if name == "packing" else []
    key = lambda f: sorted(map(str, f.drop(columns=drop).round(6).to_numpy().tolist()))
    assert key(found) == key(again)


def shingles(text):
    w = re.findall(SPLIT, (text or "").translate(LOW))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_jaccard_join(spark):
    rows = corpus()
    sets = [(i, shingles(t)) for i, t in rows]
    up = {i: i for i, _ in sets if i is not None}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            both = len(a & b)
            if None not in (i, j) and both and 100 * both >= 80 * (len(a) + len(b) - both):
                x, y = sorted((find(i), find(j)))
                up[y] = x
    found = jaccard_join(frame(spark, rows)).collect()
    expected = Counter((i, len(s), None if i is None else find(i)) for i, s in sets)
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in found) == expected
    kept = [r.doc_id for r in drop_near_copies(clashing(frame(spark, rows))).collect()]
    assert Counter(kept) == Counter([*{find(i) for i in up}, None, None])


def test_class_lm(spark):
    rows = corpus()
    tokens = [(i, [*re.findall(SPLIT, (t or "").translate(LOW)), None]) for i, t in rows]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    counts = Counter(w for i, t in tokens if not held(i) for w in t)
    n, v = sum(counts.values()), len(counts)
    expected = Counter((i, held(i), len(t), sum(w in counts for w in t), n, round(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t), 6)) for i, t in tokens)
    found = OPERATORS["lm"](frame(spark, rows)).collect()
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in found) == expected


def test_class_lm_beats_unigrams_on_two_languages(spark):
    rng = random.Random(3)
    tongues = [[f"{a}{k}" for k in range(60)] for a in "pq"]
    docs = frame(spark, [(i, " ".join(rng.choices(tongues[i % 2], k=60))) for i in range(300)])
    found = class_lm_scores(docs, n_classes=8, known_words=200, rounds=3).where("held_out").toPandas()
    assert found.score.sum() > found.base_score.sum() * 0.9
    assert np.allclose(found.perplexity, 10 ** (-found.score / found.n_tokens))


def brute_lm(training, texts, n_classes, rounds):
    """The class model in plain steps: all words move at once, or by shares of their hashes after a round that fails.
    A text's probability is summed over the classes of its unseen words by the forward algorithm."""
    counts = Counter(w for t in training for w in t)
    ranked = sorted(counts, key=lambda w: (-counts[w], w))
    classes = {w: k if k <= n_classes - 2 else n_classes - 1 for k, w in enumerate(ranked, 1)} | {None: 0}

    def bigrams(of):
        out = np.zeros((n_classes, n_classes))
        for t in training:
            for a, b in zip([None, *t], [*t, None], strict=True):
                out[of[a], of[b]] += 1
        return out

    def smooth(b):
        usual = (b.sum(axis=0) + 0.5) / (b.sum() + 0.5 * n_classes)
        return (b + 10 * usual) / (b.sum(axis=1, keepdims=True) + 10)

    def level(b):
        return sum(x * math.log(x) for x in b.ravel() if x) - sum(x * math.log(x) for s in (b.sum(axis=0), b.sum(axis=1)) for x in s if x)

    best, best_level, shares, turn, idle, levels = classes, level(bigrams(classes)), 1, 0, 0, []
    levels.append(best_level)
    for _ in range(rounds):
        b = bigrams(best)
        right, left = np.log(smooth(b)), np.log(smooth(b.T))
        gain = {w: np.zeros(n_classes) for w in counts}
        for t in training:
            for x, y in zip([None, *t], [*t, None], strict=True):
                if x is not None:
                    gain[x] += right[:, best[y]]
                if y is not None:
                    gain[y] += left[:, best[x]]
        new = dict(best)
        for w, g in gain.items():
            if class_lm.rare_number(w.encode(), 0) % shares == turn % shares:
                new[w] = 1 + int(np.argmax(np.round(g[1:], 6)))
        turn += 1
        now = level(bigrams(new))
        if now >= best_level:
            idle = idle + 1 if now - best_level < 5e-3 * b.sum() else 0
            best, best_level = new, now
            levels.append(now)
        else:
            shares, idle = 2 * shares, 0
        if idle >= shares or shares > 8:
            break
    b = bigrams(best)
    step, types = smooth(b), Counter(best.values())
    size = np.array([b[:, c].sum() + 0.5 * (types[c] + 1) for c in range(n_classes)])
    out = []
    for t in texts:
        at, total = np.eye(n_classes)[0], 0.0
        for w in [*t, None]:
            emit = np.zeros(n_classes)
            if w is None or w in counts:
                emit[best[w]] = ((len(training) if w is None else counts[w]) + 0.5) / size[best[w]]
            else:
                emit[1:] = 0.5 / size[1:]
            at = at @ step * emit
            total += math.log10(at.sum())
            at /= at.sum()
        out.append(total)
    return out, levels


@pytest.mark.parametrize("known", [5, 1000])
def test_class_lm_scores_against_brute_force(spark, monkeypatch, known):
    kept = []
    run = class_lm.Clustering.run
    monkeypatch.setattr(class_lm.Clustering, "run", lambda self, *a: (run(self, *a), kept.append(self.levels))[0])
    rng = random.Random(12)
    tongues = [[f"{a}{k}" for k in range(25)] for a in "pqr"]
    rows = [(i, " ".join(rng.choices(tongues[i % 3], k=rng.randint(0, 30)) + [f"x{rng.randint(0, 400)}"] * (i % 4))) for i in range(80)] + [(80, "never seen words p1 here"), (81, None)]
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    split = [(t or "").split() for _, t in rows]
    expected, levels = brute_lm([t for (i, _), t in zip(rows, split, strict=True) if not held(i)], split, 6, 5)
    found = class_lm_scores(frame(spark, rows), n_classes=6, known_words=known, rounds=5).orderBy("doc_id").toPandas()
    assert np.allclose(found.score, expected, atol=1e-6)
    assert np.allclose(kept[0], levels) and kept[0] == sorted(kept[0]) and len(levels) > 2


def test_class_lm_without_training_documents(spark):
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5 == 1][:20]
    found = class_lm_scores(frame(spark, [(i, f"word{i} and more") for i in ids]), n_classes=4, known_words=20, rounds=1).collect()
    assert len(found) == 20 and all(r.held_out and r.n_known == 0 and r.train_tokens == 0 and r.n_tokens == 4 and r.base_score == 0 and math.isfinite(r.score) for r in found)


def test_class_lm_gives_every_word_its_own_class(spark):
    """Words of two languages, all with one ending, keep apart however few are listed."""
    rng = random.Random(4)
    tongues = [[f"{a}{k}xyz" for k in range(60)] for a in "pq"]
    docs = frame(spark, [*[(i, " ".join(rng.choices(tongues[i % 2], k=60))) for i in range(200)], (900, " ".join(w + "!" * 70 for w in tongues[0])), (901, "new p1xyz newer newest")])
    few, all_listed = (
        class_lm_scores(docs, n_classes=8, known_words=n, rounds=2).orderBy("doc_id").toPandas() for n in (10, 1000)
    )
    assert few.n_known.tolist() == all_listed.n_known.tolist()
    assert np.allclose(few.score, all_listed.score, atol=1e-6)


def test_sharding(spark):
    rows = corpus()
    found = shard_by_bytes(frame(spark, rows), 4).toPandas()
    assert (found.law == "bytes").all() and found.grown_shard.isna().all()
    for _, own in found.groupby("shard"):
        assert sorted(own.slot) == list(range(len(own)))
    assert found.groupby("text_crc32").shard.nunique().max() == 1
    by = {i: (len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows if i is not None}
    assert all(by[int(r.doc_id)] == (r["size"], r.text_crc32) for _, r in found[found.doc_id.notna()].iterrows())


def fewest_bytes(sizes, shards):
    """The smallest possible largest shard, over all ways to cut the sequence."""
    best = [0, *[math.inf] * len(sizes)]
    for _ in range(shards):
        best = [0, *[min(max(best[k], sum(sizes[k:n])) for k in range(n)) for n in range(1, len(sizes) + 1)]]
    return best[-1]


@pytest.mark.parametrize("cells", [3, 50])
def test_minimax_is_the_smallest_capacity(spark, cells):
    rng = random.Random(cells)
    for shards in (1, 3, 7):
        sizes = [rng.randint(1, 90) for _ in range(60)]
        sums = np.cumsum(sizes).tolist()
        ends = minimax_cuts(spark.createDataFrame([(s,) for s in sums], "upto long"), sums[-1], shards, cells)
        assert len(ends) == shards and set(ends) <= {0, *sums} and ends[-1] == sums[-1] and ends == sorted(ends)
        assert max(np.diff([0, *ends])) == fewest_bytes(sizes, shards)


@pytest.mark.parametrize("hot", [1, 40])
def test_shards_of_whole_documents_are_minimax(spark, hot):
    """By brute force over groups in the order of their digests, with a group that no equal share can hold, or without."""
    rng = random.Random(hot)
    texts = [words(rng, rng.randint(1, 30)) for _ in range(40)]
    rows = list(enumerate([*texts, *texts[:10], *[texts[0] + " hot"] * hot]))
    found = shard_by_bytes(frame(spark, rows), 5).toPandas()
    size = Counter()
    for _, t in rows:
        size[hashlib.md5(t.encode()).hexdigest()] += len(t.encode()) + 16
    rest, left = dict(size), 5
    while max(rest.values()) * left > sum(rest.values()) and left > 1:
        rest.pop(max(rest, key=lambda d: (rest[d], d)))
        left -= 1
    assert (left < 5) == (hot > 1)
    own = found.groupby("shard")["size"].sum()
    whole = {d: found.shard[found.text_crc32 == zlib.crc32(t.encode())].unique().tolist() for d, t in ((hashlib.md5(t.encode()).hexdigest(), t) for _, t in rows)}
    assert all(len(s) == 1 for s in whole.values())
    for d in size.keys() - rest.keys():  # alone
        assert own[whole[d][0]] == size[d]
    assert max(own[s] for s in {whole[d][0] for d in rest}) == fewest_bytes([rest[d] for d in sorted(rest)], left)


def test_packing(spark):
    tokenizers = pytest.importorskip("tokenizers")
    rows = corpus()
    whole = tokenizers.Tokenizer.from_file(word_tokenizer())
    ids = {i: [*whole.encode(t or "", add_special_tokens=False).ids, 1] for i, t in rows if i is not None}
    packed = pack(frame(spark, rows), word_tokenizer(), 64)
    found = packed.toPandas()
    for r in sequences(packed).collect():
        own = np.frombuffer(r.ids, dtype="<u4").tolist()
        assert len(own) == r.length == sum(s.length for s in r.spans)
        for s in r.spans:
            if s.doc_id is not None:
                assert own[s.offset : s.offset + s.length] == ids[s.doc_id][64 * s.piece : 64 * s.piece + s.length]
    for r in found[found.doc_id.notna()].itertuples():
        part = ids[int(r.doc_id)][r.start : r.start + r.length]
        assert (r.length, r.start) == (len(part), 64 * r.piece)
        assert r.ids_crc32 == zlib.crc32(np.array(part, dtype="<u4").tobytes())
    for _, own in found.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert own.offset.tolist() == [0, *own.length.cumsum().tolist()[:-1]]
        assert own.length.sum() <= 64
    counts = np.bincount(found.length, minlength=65)
    assert found.sequence_id.nunique() == sum(n for _, n in bin_completion(counts, 64)) >= lower_bound(counts, 64)


def brute_repeats(texts, window=200):
    counts = Counter(t[i : i + window] for t in texts for i in range(len(t) - window + 1))
    out = []
    for t in texts:
        marks = np.zeros(len(t) + 1, dtype=int)
        for i in range(len(t) - window + 1):
            if counts[t[i : i + window]] > 1:
                marks[i] += 1
                marks[i + window] -= 1
        gone = np.cumsum(marks)[:-1] > 0
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out.append((len(t), int(gone.sum()), int(np.sum(np.diff(np.concatenate(([0], gone.astype(int)))) == 1)), hashlib.sha256(kept).hexdigest(), kept))
    return out


@pytest.mark.parametrize("per_shard", [2048, 3])
def test_suffix_dedup(spark, monkeypatch, per_shard):
    monkeypatch.setattr(suffix_module, "SEGMENTS_PER_SHARD", per_shard)
    monkeypatch.setattr(suffix_module, "SHARD_BYTES", 2 << 20 if per_shard > 3 else 4000)
    rows = corpus()
    brute = brute_repeats([(t or "").encode() for _, t in rows])
    found = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup(frame(spark, rows)).collect())
    assert found == Counter((i, *b[:4]) for (i, _), b in zip(rows, brute, strict=True))
    rewritten = Counter((r.doc_id, r.text) for r in remove_repeats(clashing(frame(spark, rows))).collect())
    assert rewritten == Counter((i, t if not b[1] else b[4].decode(errors="ignore")) for (i, t), b in zip(rows, brute, strict=True) if not b[1] or b[4])


def test_decontamination(spark, monkeypatch):
    rng = random.Random(5)
    items = [(1, words(rng, 30)), (2, words(rng, 4)), (3, ""), (4, None), (None, "a"), (5, "Solo!"), (1, words(rng, 12))]
    leak = " ".join(items[0][1].split()[5:20])
    rows = [*corpus(), (900, f"{words(rng, 5)} {leak.upper().replace('É', 'é')}, tail"), (901, f"x {items[1][1]} y"), (902, "solo"), (903, leak[: len(leak) // 2])]
    token = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(LOW))
    tests = spark.createDataFrame(items, "item_id long, text string")
    expected, clean = Counter(), Counter()
    for i, t in rows:
        doc, hit, named = token(t), set(), set()
        for item, text in items:
            w = token(text)
            n = min(10, len(w))
            for s in range(len(w) - n + 1 if n and item is not None else 0):
                at = [j for j in range(len(doc) - n + 1) if doc[j : j + n] == w[s : s + n]]
                hit |= {j + k for j in at for k in range(n)}
                named |= {item} if at else set()
        expected[(i, len(doc), len(hit), len(named), hashlib.sha256(",".join(sorted(map(str, named))).encode()).hexdigest(), bool(hit))] += 1
        clean[i] += not hit
    for size in (4 << 20, 300):
        monkeypatch.setattr(decontaminate_module, "BLOCK_BYTES", size)
        found = decontaminate(clashing(frame(spark, rows)), tests).collect()
        assert Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in found) == expected
        assert all(r.n_near_items >= r.n_items for r in found)
    listed = contamination_matches(frame(spark, rows), tests).where("exact").groupBy("doc_id").count().collect()
    by = {r.doc_id: r.n_items for r in found if r.doc_id is not None and r.n_items}
    assert {r.doc_id: r["count"] for r in listed} == by
    assert Counter(r.doc_id for r in drop_contaminated(clashing(frame(spark, rows)), tests).collect()) == +clean
    assert decontaminate(frame(spark, rows), tests.limit(0)).where("contaminated").count() == 0
    assert decontaminate(frame(spark, []), tests).count() == 0


def test_quality_model(spark):
    rng = random.Random(11)
    good = [(i, ". ".join(words(rng, 12).capitalize() for _ in range(6))) for i in range(150)]
    bad = [(i, words(rng, 3).upper() + " $$$ " * rng.randint(5, 30)) for i in range(150, 220)]
    rows = [*good, *bad, (None, "x"), (500, None), (0, good[0][1])]
    labels = spark.createDataFrame([*[(i, int(i < 150), 0) for i in range(220)], (0, None, 1), (None, 1, 0), (7, 1, 1)], "doc_id long, quality int, toxic int")
    found = quality_gam(clashing(frame(spark, rows)), labels).toPandas()
    assert len(found) == len(rows) and found.score.between(0, 1).all()
    assert (found.predicted == (found.score >= 0.3)).all()
    known = found[found.doc_id < 220]
    assert ((known.doc_id < 150) == (known.predicted == 1)).mean() > 0.98
    assert (known.held_out == [zlib.crc32(str(int(i)).encode()) % 5 == 0 for i in known.doc_id]).all()
    flipped = labels.selectExpr("doc_id", "case when crc32(cast(cast(doc_id as string) as binary)) % 5 = 0 then 1 - quality else quality end as quality", "toxic")
    again = quality_gam(frame(spark, rows), flipped).toPandas()
    assert sorted(found.score.round(9)) == sorted(again.score.round(9))
    assert drop_low_quality(clashing(frame(spark, rows)), labels).where("doc_id between 150 and 219").count() <= 2
    assert set(quality_gam(frame(spark, rows), labels.limit(0)).toPandas().score) == {0.5}


TURNS = "conv_id long, turn long, role string, text string, h1 string, position string"


def test_chat(spark):
    talk = [("user", "hi"), ("assistant", "yes"), ("user", "<|im_start|>more")]
    rows = [(c, k, *t) for c, n in ((1, 1), (2, 2), (3, 3), (4, 3)) for k, t in enumerate(talk[:n])]
    rows += [(5, 0, "user", "other"), (5, 0, "user", "other"), (6, 0, None, None), (7, None, "user", "late"), (7, 0, "user", "b"), (7, 0, "user", "a"), (None, 0, "user", "hi")]
    chats = spark.createDataFrame([(*r, "x", "y") for r in rows], TURNS)
    found = {r.conv_id: r for r in chat_format(chats).collect()}
    assert sorted(found) == [3, 5, 6, 7]
    assert (found[3].n_turns, found[3].n_copies) == (3, 2)
    assert found[3].prompt == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nyes<|im_end|>\n<|im_start|>user\n< |im_start|>more<|im_end|>\n"
    assert found[6].prompt == "<|im_start|>unknown\n<|im_end|>\n"
    assert re.findall("\n(a|b|late)<", found[7].prompt) == ["a", "b", "late"]
    assert chat_format(chats.limit(0)).count() == 0
    plan = chat_format(chats)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_warc(spark):
    pages = [(3, "http://a.example/x", "p"), (1, "https://www.a.example/x#f", "p"), (2, "http://b.a.example", "\r\n\r\né\x00"), (5, None, None), (4, "u v", ""), (1, "http://a.example/x", "p"), (None, "z", "q")]
    frame = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, run string")
    found = archive_pages(frame).collect()
    first = defaultdict(lambda: 10**9)
    for page, _, html in pages:
        first[html or ""] = min(first[html or ""], page or 10**9)
    expected = Counter()
    for page, _, html in pages:
        raw = (html or "").encode()
        again = page is not None and page > first[html or ""]
        expected[(page, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", first[html or ""] if again else None)] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found) == expected
    ordered = sorted(found, key=lambda r: r.history_pos)
    assert [r.history_pos for r in ordered] == list(range(len(pages)))
    assert [(r.url_key, r.captured) for r in ordered] == sorted((r.url_key, r.captured) for r in found)
    assert all(r.record_type == "response" for r in archive_pages(frame, min_revisit_bytes=2).collect() if r.payload_bytes < 2)
    assert archive_pages(frame.limit(0)).count() == 0


def test_archives_are_cut_by_bytes_and_one_url_fills_many_ranges(spark, tmp_path):
    rng = random.Random(2)
    pages = [(i, "http://one.example/" if i % 3 else f"http://h{i}.example/a", words(rng, 6000 if i == 17 else 20)) for i in range(200)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(4)
    found = archive_pages(frame, archive_bytes=20_000, range_rows=15).collect()
    ordered = sorted(found, key=lambda r: r.history_pos)
    assert [r.history_pos for r in ordered] == list(range(200))
    assert [(r.url_key, r.captured, r.page_id) for r in ordered] == sorted((r.url_key, r.captured, r.page_id) for r in found)
    write_archives(with_types(frame), str(tmp_path / "a"), 20_000)
    records = Counter(r.archive for r in read_archives(spark, str(tmp_path / "a")).collect())
    sizes = Counter()
    for r in found:
        sizes[r.archive] += r.payload_bytes + 600
    assert len(records) == len(sizes) > 6
    largest = max(r.payload_bytes for r in found) + 600
    assert all(n < 20_000 + largest for n in sizes.values())
    assert sum(n < 20_000 + 2000 for n in sizes.values()) >= len(sizes) - 1


def test_pipeline_keeps_clean_documents(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    rows = corpus()
    docs = clashing(frame(spark, rows))
    labels = spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, rows[10][1])], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    kept = docs
    for name, stage in pipeline.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == docs.columns, name
    texts = {r.doc_id: r for r in kept.collect()}
    assert 10 not in texts
    assert all(r.n_chars == len(r.text) for r in texts.values() if r.doc_id is not None and r.text is not None)
    brute = [i for i, t in rows if i is not None and 11 <= i < 40 and t]
    assert {i for i in brute if texts[i].text == rows[i][1]} == set(brute)
    out = pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in out.select("doc_id").distinct().collect()} == set(texts)
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_queries_are_registered_once_by_number():
    assert sorted(int(re.match(r"op(\d+)_", q)[1]) for q in QUERIES) == list(range(1, 14))
