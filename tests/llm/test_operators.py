"""Each operator against a brute-force version, and on nulls, empty and very long texts, ties, repeated rows and empty tables."""

import base64
import hashlib
import itertools
import json
import math
import re
import time
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import bpe, chat, decontaminate, licenses, quality, secrets, simhash, suffix_tree, topk, toxicity

ODD = [(1, None), (2, ""), (3, "  \n\t "), (4, "One  two\tthree\n\nfour "), (5, "same text here"), (5, "same text here"), (6, "same text here"), (None, "no id at all"), (7, "Étude ÀÉ été 日本 'tis don't 123\x00 x"), (8, "long word " * 30000), (9, "<|endoftext|> a<|endoftext|>b")]


@pytest.fixture
def docs(spark):
    """Odd rows with extra columns whose names the operators use inside."""
    d = spark.createDataFrame(ODD, "doc_id long, text string")
    return d.selectExpr("'x' AS id", "doc_id", "text", "'en' AS lang", "'s' AS source", "cast(length(text) AS long) AS n_chars", "1L AS fp", "'w' AS word", "2 AS row", "'k' AS key", "0.5D AS score")


@pytest.fixture
def none(docs):
    return docs.limit(0)


def table(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=str)


# top-k


def test_topk_brute_force(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(0, 0.2, (400, 9)).astype(np.float32)
    v[100:140] = v[3]  # ties
    rows = [(i, [float(x) for x in r], "x") for i, r in enumerate(v)] + [(400, None, "x"), (401, [1.0, None], "x"), (402, [float("nan")], "x"), (403, [float("inf")], "x"), (None, [1.0], "x"), (404, [], "x"), (50, [float(x) for x in v[50]], "x")]
    c = topk.scaled(spark.createDataFrame(rows, "vec_id long, embedding array<float>, v string").withColumn("id", F.lit(1)), "vec_id", "embedding")
    got = table(topk.topk_inner_product(c, c.where("id % 50 = 0"), block_rows=64, query_rows=3), "query_id", "rank", "vec_id", "score")
    x = {i: np.floor(256 * r.astype(float)).astype(int) for i, r in enumerate(v)} | {404: np.zeros(9, int)}
    want = []
    for q in range(0, 400, 50):
        best = sorted((-int(x[q] @ x[i]), i) for i in x if i != q)[:5]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert got == sorted(want, key=str)
    assert topk.topk_inner_product(c.limit(0), c.limit(0)).count() == 0


def test_topk_stops_early_and_is_exact_for_large_numbers():
    m = np.zeros((2000, 2))
    m[:, 0] = np.arange(2000)
    lists = np.argsort(m, axis=0, kind="stable").T.astype(np.int32)
    at, score = topk.threshold_topk(np.array([1.0, 0.0]), -1, m, lists, np.arange(2000), 5)
    assert at.tolist() == [1999, 1998, 1997, 1996, 1995]
    big = np.array([[2**60, 1], [2**60, 2]], object)
    at, score = topk.threshold_topk(np.array([3, 1], object), -1, big, np.array([[0, 1], [0, 1]]), np.arange(2), 1)
    assert at.tolist() == [1] and score.tolist() == [3 * 2**60 + 2]


def test_topk_ships_no_copies_of_query_blocks(spark):
    rng = np.random.default_rng(4)
    v = [[int(x) for x in r] for r in rng.integers(-50, 50, (600, 3))]
    v[7], v[450], v[500] = [2**30, -(2**29), 5], [2**31, 3], [2**30 - 1] * 5  # beyond exact floats, and of other lengths
    c = spark.createDataFrame([(i, x) for i, x in enumerate(v)], "id long, v array<long>")
    d = topk.topk_inner_product(c, c.where("id % 50 = 0"), block_rows=20, query_rows=4, group=3)
    plan = d._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan  # pairs of blocks met before, read in place
    want = []
    for q in range(0, 600, 50):
        best = sorted((-sum(x * y for x, y in zip(v[q], w, strict=False)), i) for i, w in enumerate(v) if i != q)[:5]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert table(d, "query_id", "rank", "vec_id", "score") == sorted(want, key=str)


def test_topk_carries_its_threshold_from_block_to_block():
    rng = np.random.default_rng(5)
    q, best, taken = rng.integers(1, 9, (6, 4)).astype(np.float32), [np.full((6, 2), -np.inf), np.full((6, 2), 10**9)], []
    m = np.concatenate([rng.integers(50, 60, (300, 4)), rng.integers(-50, 9, (300, 4))]).astype(np.float32)
    ids = rng.permutation(600)
    for at in (0, 300):
        part = m[at : at + 300]
        block = topk.listed(part, np.argsort(part, axis=0, kind="stable").T, ids[at : at + 300])
        taken.append(topk.threshold_search(q, np.full(6, -1), best, block, 16))
    order = [np.lexsort((ids, -(m @ x)))[:2] for x in q]
    assert best[1].tolist() == [ids[o].tolist() for o in order] and best[0].tolist() == [(m[o] @ x).tolist() for x, o in zip(q, order, strict=True)]
    assert taken[0] > 0 and taken[1] == 0


# BPE


def test_bpe_is_the_library(docs, none):
    path = bpe.public_tokenizers.path(bpe.TOKENIZER)
    t = bpe._tokenizer(path)
    want = []
    for i, x in ODD:
        ids = t.encode(x or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    for shares, block in ((None, bpe.BLOCK_WORDS), (1, 3), (7, 1)):
        assert table(bpe.digests(docs, shares=shares, block_words=block), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=str)
    assert bpe.digests(none).count() == 0
    back = bpe.decode(bpe.encode(docs))
    assert table(back, "id", "text") == sorted([(i, x or "") for i, x in ODD], key=str)


def test_bpe_cuts_at_every_kind_of_space():
    w = bpe.Words(bpe.public_tokenizers.path(bpe.TOKENIZER))
    rng = np.random.default_rng(2)
    spaces = re.findall(f"[{bpe.SPACE}]", "".join(map(chr, range(0x3001))))
    parts = [*spaces, *" \n" * 8, "a", "Bc", "12", ".", "'s", "é", "名", "<|endoftext|>", "\x1c", "\0"] + ["word", " the"] * 6
    texts = ["".join(rng.choice(parts, rng.integers(0, 12))) for _ in range(50_000)] + ["line one\n\xa0\xa0line two", "a\n\xa0\tb"]
    split = [w.split(s) for s in texts]
    assert len(spaces) == 25 and ["".join(x) for x in split] == texts
    ids = iter(w.encode([u for x in split for u in x]))
    for s, x, whole in zip(texts, split, w.tokenizer.encode_batch(texts, add_special_tokens=False), strict=True):
        assert [i for _ in x for i in next(ids)] == whole.ids, s


# decontamination


def test_masks_hit_every_window_with_three_substitutions():
    for bad in itertools.combinations(range(decontaminate.WINDOW), 3):
        assert any(all(p + o not in bad for o in m) for m in decontaminate.MASKS for p in range(decontaminate.WINDOW - m[-1]))


def test_leaks_found_and_clean_texts_left(spark, docs, none):
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(3000)]
    items = [(i, " ".join(rng.choice(words, n))) for i, n in enumerate([30, 40, 16, 6, 3])]
    short = [(20 + n, rng.choice(words, n).tolist()) for n in range(8, 13)]
    items += [(i, " ".join(x)) for i, x in short]
    bench = spark.createDataFrame([*items, (9, None), (10, ""), items[0]], "item_id long, text string").withColumn("id", F.lit(0))
    def other(n):
        return list(rng.choice(words, n))
    rows, want = [], set()
    for d in range(60):
        item = items[d % 5][1].split()
        for k in range(3, len(item), 6):  # every sixth word replaced
            item[k] = item[k] if d % 5 == 3 or d % 2 else "changed"
        rows.append((d, " ".join(other(50) + item + other(20)).upper().replace(" W1", ", W1")))
        if d % 5 < 4:
            want.add((d, d % 5))
        rows.append((1000 + d, " ".join(other(300))))
    for i, x in short:
        for k in range(len(x)):
            rows.append((100 * i + k, " ".join([*other(9), *x[:k], "changed", *x[k + 1 :], *other(9)])))
            rows.append((5000 + 100 * i + k, " ".join([*other(9), *x[:k], "changed", *x[k + 1 : -1], "too", *other(9)])))
            want.add((100 * i + k, i))
        want.add((5000 + 100 * i + len(x) - 1, i))
    df = spark.createDataFrame([*rows, rows[0]], "doc_id long, text string")
    for part in (decontaminate.BENCH_WORDS, 20):
        assert set(table(decontaminate.leaks(df, bench, part_words=part), "doc_id", "item_id")) == want
    assert decontaminate.leaks(df, bench).where("doc_id = 0").count() == 2
    assert decontaminate.leaks(docs, bench).count() == 0
    assert decontaminate.leaks(none, bench).count() == 0 and decontaminate.leaks(docs, bench.limit(0)).count() == 0


# quality and toxicity


def test_rules_compile_to_what_they_say(spark):
    rng = np.random.default_rng(5)
    x = rng.random((600, 3))
    y = ((x[:, 0] > 0.4) & (x[:, 2] < 0.7)).astype(float)
    rules, bias = quality.fit(x, y)
    assert 0 < len(rules) < 100
    df = spark.createDataFrame(x.tolist(), "a double, b double, c double")
    got = np.array([r[0] for r in df.select(quality.compiled(rules, bias, [F.col(c) for c in "abc"])).collect()])
    z = bias + sum(w * quality.holds(r, x) for r, w in rules)
    assert np.allclose(got, 1 / (1 + np.exp(-z))) and ((got > 0.5) == (y > 0)).mean() > 0.97
    assert quality.fit(x, np.ones(600))[0] == [] and quality.fit(np.empty((0, 0)), np.empty(0)) == ([], 0.0)


def test_quality_on_odd_rows(spark, docs, none):
    labels = spark.createDataFrame([(i, i % 2, None, "t") for i in range(1, 9)] + [(None, 1, 1, "t")], "doc_id long, quality int, toxic int, text string")
    rules, bias = quality.train(docs, labels)
    got = quality.score(docs, rules, bias)
    assert got.count() == len(ODD) and got.where("score is null or not score between 0 and 1").count() == 0
    assert quality.score(none, rules, bias).count() == 0
    assert quality.score(docs, *quality.train(none, labels.limit(0))).count() == len(ODD)


def test_marginals_are_sums_over_all_taggings():
    rng = np.random.default_rng(0)
    u, a, first = rng.normal(size=7), np.exp(rng.normal(size=(2, 2))), np.array([1, 0, 0, 1, 1, 0, 0], bool)
    total, each, pairs = 0.0, np.zeros(7), np.zeros((2, 2))
    for y in itertools.product((0, 1), repeat=7):
        w = np.exp(sum(u[i] * y[i] for i in range(7))) * np.prod([a[y[i - 1], y[i]] for i in range(7) if not first[i]])
        total += w
        each += w * np.array(y)
        for i in range(7):
            if not first[i]:
                pairs[y[i - 1], y[i]] += w
    p, expected = toxicity.marginals(u, a, first)
    assert np.allclose(p, each / total) and np.allclose(expected, pairs / total)


def toxic_rows(n, seed):
    rng = np.random.default_rng(seed)
    plain = [f"word{i}" for i in range(400)]
    rows = []
    for i in range(n):
        ws, bad = list(rng.choice(plain, 40)), i % 5 == 0
        if bad:
            for k in rng.choice(40, 3, replace=False):
                ws[k] = str(rng.choice(["Vile,", "rotten", "FOUL!"]))
        rows.append((i, " ".join(ws), int(bad)))
    return rows


def test_toxicity_learns_and_tags(spark, docs, none):
    rows = toxic_rows(600, 6)
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model, share = toxicity.train(df.select("doc_id", "text"), df.select("doc_id", "toxic", F.lit("x").alias("text")))
    fresh = toxic_rows(200, 7)
    got = {r.id: r for r in toxicity.score(spark.createDataFrame(fresh, "doc_id long, text string, toxic int"), model, share, spans=True).collect()}
    for i, text, bad in fresh:
        assert (got[i].score >= toxicity.THRESHOLD) == bool(bad)
        tagged = [text[a:b] for a, b in (map(int, s.split(":")) for s in got[i].spans.split(",") if s)]
        assert {w.lower().strip(",!") for w in tagged} <= {"vile", "rotten", "foul"} and len(tagged) == 3 * bad
    odd = toxicity.score(docs, model, share, spans=True)
    assert odd.count() == len(ODD) and odd.where("score is null or not score between 0 and 1").count() == 0
    assert toxicity.score(none, model, share).count() == 0
    assert toxicity.train(none, df.limit(0).select("doc_id", "toxic")) == (None, 0.0)
    assert toxicity.score(docs, None, 0.0).where("score = 0").count() == len(ODD)


# suffix tree


def test_base_scores_and_tail_path(spark, docs, none):
    ok = F.col("doc_id").isNotNull()
    whole, *more = (table(suffix_tree.score_texts(docs, ok, shares=n, block_words=size).selectExpr("id", "n_tokens", "n_known", "train_tokens", "round(base_score, 5)", "round(score, 5)"), "*") for n, size in ((None, suffix_tree.BLOCK_WORDS), (3, 4)))
    assert [whole] == more
    train = [(x or "").encode().lower().split() for i, x in ODD if i is not None]
    c = Counter(w for ws in train for w in ws) + Counter({None: len(train)})
    n, v = sum(c.values()), len(c)
    want = []
    for i, x in ODD:
        ws = [*(x or "").encode().lower().split(), None]
        want.append((i, len(ws), sum(w in c for w in ws), n, round(sum(math.log10((c.get(w, 0) + 0.1) / (n + 0.1 * (v + 1))) for w in ws), 5)))
    assert [r[:5] for r in whole] == sorted(want, key=str) and all(r[5] <= 0 for r in whole)
    assert suffix_tree.score_texts(none, ok).count() == 0
    assert suffix_tree.score_texts(docs, F.lit(False)).where("n_known = 0 and train_tokens = 0").count() == len(ODD)


def test_scores_by_brute_force(spark):
    """Counts, the test of contexts and the mixture over again, text by text."""
    T = suffix_tree
    rng = np.random.default_rng(11)
    names = [f"w{chr(97 + i % 26)}{i}" for i in range(60)]
    texts = []
    for _ in range(150):
        x = [rng.choice(names)]
        for _ in range(rng.integers(0, 40)):  # what follows the first ten words is nearly fixed
            k = names.index(x[-1])
            x.append(names[(k * 7) % 60] if k < 10 and rng.random() < 0.8 else rng.choice(names))
        texts.append(x + [f"rare{len(texts)}"] * (len(texts) % 3 == 0))
    train = texts[:110]
    c = Counter(w for x in train for w in [*x, ""])
    pairs = Counter(p for x in train for p in zip(["", *x], [*x, ""], strict=True))
    once, twice = (sum(n == k for w, n in c.items() if w) for k in (1, 2))
    flat, _, place = T.flat_bytes([[w.encode()] for w in sorted(c) if w])
    codes, n = T._summed(T.grams(flat, place), np.ones(len(flat), np.int64))
    tree = T.train(spark.createDataFrame([(1, int(k), int(m)) for k, m in zip(codes, n, strict=True)], "kind int, key long, n long"))
    total, d, v = sum(c.values()), once / (once + 2 * twice), len(c)

    def empty(w):
        s = 10 ** T.spelling(tree, *T.flat_bytes([[w.encode()] if w else []]))[0]
        return (max(c[w] - d, 0) + max(d * v, 1) * s) / (total - d * v + max(d * v, 1))

    gains = Counter()
    for (a, b), n in pairs.items():
        p = math.exp(-round(-8 * math.log(empty(b))) / 8)
        gains[a] += n * math.log((n - 1 + T.WORD_KEEP * p) / (c[a] - 1 + T.WORD_KEEP) / p)
    stays = {a for a, g in gains.items() if g > T.GAIN}
    assert 5 < len(stays) < 40

    def score(x):
        return sum(math.log10((pairs[a, b] + T.WORD_KEEP * empty(b)) / (c[a] + T.WORD_KEEP) if a in stays else empty(b)) for a, b in zip(["", *x], [*x, ""], strict=True))

    want = [score(x) for x in texts]
    df = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(texts)], "doc_id long, text string")
    for shares, size in ((None, T.BLOCK_WORDS), (3, 50)):
        got = {r.id: r.score for r in T.score_texts(df, F.col("doc_id") < 110, shares=shares, block_words=size).collect()}
        assert [got[i] for i in range(150)] == pytest.approx(want, rel=1e-5)


def test_tree_uses_the_longest_context_and_sums_to_one():
    text = b"abcabcabdabcabcabd" * 200
    flat, at, place = suffix_tree.flat_bytes([[text]])
    codes, n = suffix_tree._summed(suffix_tree.grams(flat, place), np.ones(len(flat), np.int64))
    levels = []
    for k in range(suffix_tree.DEPTH + 1):
        ok = (codes >> (8 * k)) & 255 > 0
        c, m = suffix_tree._summed(codes[ok] & ((1 << (8 * (k + 1))) - 1), n[ok])
        levels.append((c >> 8, c & 255, m.astype(float)))
    tree = suffix_tree.grow(levels)
    unseen = 256 - int((tree.symbol > 0).sum())
    mass = (10.0 ** tree.logp[1:].astype(float) * np.r_[unseen, np.ones(tree.logp.shape[1] - 1)]).sum(axis=1)
    assert np.allclose(mass, 1, atol=1e-3)
    p = tree.score(flat, place)
    # five bytes tell what comes next but for two places of each nine, where c and d are as likely
    assert p[20:-5].mean() == pytest.approx(-math.log10(2) * 2 / 9, abs=0.003)


@pytest.mark.parametrize("kind", ["closed", "open"])
def test_scores_of_open_and_closed_vocabularies(spark, kind):
    """216 words, all of them met, are scored as their counts have it; words of any length come close to their entropy.

    The base gives every unknown word the same share, however many there are, so it is no bound for a distribution.
    """
    rng = np.random.default_rng(8)
    parts = ["ba", "do", "ki", "lu", "re", "sto"]
    rows = [(i, " ".join("".join(rng.choice(parts, 3 if kind == "closed" else rng.geometric(0.2))) for _ in range(60))) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = suffix_tree.score_texts(df, F.col("doc_id") < 250).where("id >= 250")
    score, base, n = got.agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    if kind == "closed":
        assert score >= base - 1e-4 * abs(base)
    else:
        length = -(0.2 * math.log10(0.2) + 0.8 * math.log10(0.8)) / 0.2
        assert score / n > -(5 * math.log10(6) + length) * 60 / 61 - 0.1


# chat


def test_snapshots_collapse(spark):
    full = [("user", "hi"), ("assistant", "yes?"), ("user", None), ("assistant", "ok")]
    rows = [(1, t, *x) for t, x in enumerate(full[:2])] + [(2, t, *x) for t, x in enumerate(full)] + [(3, t, *x) for t, x in enumerate(full)]
    rows += [(4, 0, "user", "hi"), (4, 1, "assistant", "no"), (5, 0, "user", "hi"), (None, 0, "user", "x"), (6, 0, None, "lone"), (6, 0, None, "lone"), (7, None, "user", "first"), (7, 1, "user", "next")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"digest": F.lit("d"), "own": F.lit(1)})
    got = {r.conv_id: r for r in chat.render(df).collect()}
    assert set(got) == {2, 4, 6, 7}
    assert got[2].text == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nyes?<|im_end|>\n<|im_start|>user\n<|im_end|>\n<|im_start|>assistant\nok<|im_end|>\n"
    assert got[6].n_turns == 1 and got[7].text.index("first") < got[7].text.index("next")
    assert chat.render(df.limit(0)).count() == 0


# SimHash


def plain_fingerprint(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    s = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def plain_components(fps):
    least = {f: f for f in fps}
    changed = True
    while changed:
        changed = False
        for a, b in itertools.combinations(fps, 2):
            if (a ^ b).bit_count() <= 3 and least[a] != least[b]:
                least[a] = least[b] = min(least[a], least[b])
                changed = True
    return least


def test_simhash_rows(docs, none):
    got = {(r.id, r.fp % (1 << 64)): r.component_id for r in simhash.near_duplicates(docs).collect()}
    fps = [(i, plain_fingerprint(x)) for i, x in ODD]
    least = plain_components(sorted({f for _, f in fps}))
    for i, f in fps:
        same = [j for j, g in fps if least[g] == least[f] and j is not None]
        assert got[i, f] == (min(same) if same else None)
    assert simhash.near_duplicates(docs).count() == len(ODD) and simhash.near_duplicates(none).count() == 0


@pytest.mark.parametrize("sizes", [{}, {"solve": 16, "chunk": 8}])
def test_dense_groups_lose_no_link(spark, sizes):
    rng = np.random.default_rng(9)
    fps = set()
    for size in (1, 2, 9, 60, 150):
        base = int(rng.integers(0, 1 << 63))
        for _ in range(size):
            x = base
            for b in rng.integers(0, 64, rng.integers(0, 5)):
                x ^= 1 << int(b)
            fps.add(x)
    chain = int(rng.integers(0, 1 << 62))
    for k in range(30):  # a chain of steps of three bits
        chain ^= 7 << (k % 20) * 3
        fps.add(chain)
    want = plain_components(sorted(fps))
    df = spark.createDataFrame([(simhash.signed(x),) for x in fps], "fp long")
    root = {r.node: r.root for r in simhash.connected(simhash.links(df, 3, **sizes)).collect()}
    got = {x: root.get(simhash.signed(x), simhash.signed(x)) for x in fps}
    groups = [sorted(sorted(k for k in m if m[k] == v) for v in set(m.values())) for m in (got, want)]
    assert groups[0] == groups[1]


# licences


def test_pairs_of_chunks_are_tasks_of_their_own(spark):
    parts = spark.createDataFrame([(0, 5, i, bytes([i])) for i in range(12)], "t int, key long, i int, fps binary")
    got = simhash.chunk_pairs(parts).withColumn("task", F.spark_partition_id()).collect()
    assert {(r.i, r.j) for r in got} == {(i, j) for j in range(12) for i in range(j + 1)} and len(got) == 78
    assert max(Counter(r.task for r in got).values()) < 40 and len({r.task for r in got}) == 4


def test_licences_by_brute_force(spark, docs, none):
    texts = list(licenses.TEMPLATES.values())
    rows = [(i, f"some words first\n{t.upper()}\nand more") for i, t in enumerate(texts)]
    rows += [(100, "Licensed under the Apache License, version 3.0"), (101, "licensed licensed licensed"), (102, "Released under the\nMIT License.\n\nother"), (103, "under cc by nc 4 0 licensed"), (104, "mit")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"t": F.lit(1), "u": F.lit(2), "position": F.lit(3)})
    want = set()
    grams = {k: set(licenses.bigrams(licenses.normal_words(t))) for k, t in licenses.TEMPLATES.items()}
    for i, text in rows:
        parts = [("line", k, u) for k, u in enumerate(text.split("\n"))]
        if len(cuts := re.split(r"\n[ \t#*/;%!-]*\n", text)) > 1:
            parts += [("paragraph", k, u) for k, u in enumerate(cuts) if "\n" in u]
        if len(cuts := re.split(r"""[.!?]["')\]]*[ \t\n]""", text)) > 1:
            parts += [("sentence", k, u) for k, u in enumerate(cuts)]
        for kind, k, u in parts:
            g = set(licenses.bigrams(licenses.normal_words(u)))
            best = max(((2 * len(g & t) / (len(g) + len(t)), [-ord(c) for c in name], name) for name, t in grams.items() if g), default=(0,))
            if best[0] >= 0.8:
                want.add((i, kind, k, best[2], round(best[0], 6)))
    assert set(table(licenses.scan(df), "doc_id", "unit", "position", "license", "dice")) == want
    assert {i for i, *_ in want} >= set(range(len(texts))) | {102}
    assert licenses.scan(docs).count() == 0 and licenses.scan(none).count() == 0


# secrets


def der(*parts):
    body = b"".join(parts)
    return b"\x30" + (bytes([len(body)]) if len(body) < 128 else b"\x82" + len(body).to_bytes(2, "big")) + body


def test_notices_in_comments_and_in_longer_lines(spark):
    gpl = licenses.TEMPLATES["GPL-3.0-or-later"].split()
    comment = "#\n# A tool.\n#\n" + "\n".join("# " + " ".join(gpl[i : i + 9]) for i in range(0, len(gpl), 9)) + "\n#\n# See the file.\n"
    line = "This tool parses logs quickly. Released under the MIT License. See the manual for usage."
    many = "released under the mit license " * 60
    got = licenses.scan(spark.createDataFrame([(1, comment), (2, line), (3, many)], "doc_id long, text string")).collect()
    assert {(r.doc_id, r.unit, r.license) for r in got} == {(1, "paragraph", "GPL-3.0-or-later"), (1, "sentence", "GPL-3.0-or-later"), (2, "sentence", "MIT"), (3, "line", "MIT")}


def test_long_conversations_cost_time_in_proportion(spark):
    rows = [(1, t, "user" if t % 2 else "bot", f"turn {t}") for t in range(20_000)]
    rows += [(2, t, r, x) for _, t, r, x in rows[:15_000]] + [(3, t, r, x) for _, t, r, x in rows[:15_000]] + [(3, 15_000, "user", "other")]
    began = time.time()
    got = chat.render(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).select("conv_id", "n_turns").collect()
    assert sorted(map(tuple, got)) == [(1, 20_000), (3, 15_001)] and time.time() - began < 60


def test_secret_spans(spark, docs, none):
    key = der(b"\x02\x01\x00", *[b"\x02\x20" + bytes(range(1, 33))] * 5)
    b64 = base64.b64encode(key).decode()
    def url(x):
        return base64.urlsafe_b64encode(json.dumps(x).encode()).decode().rstrip("=")
    token = f"{url({'alg': 'HS256', 'typ': 'JWT'})}.{url({'sub': 1})}.c2ln"
    ssh = base64.b64encode(b"\0\0\0\x07ssh-rsa\0\0\0\x03\1\0\1\0\0\0\x10" + bytes(16)).decode()
    pem = f"-----BEGIN RSA PRIVATE KEY-----\n{b64[:64]}\n{b64[64:]}\n-----END RSA PRIVATE KEY-----"
    texts = {1: f"é password = \"hunter22\" x AKIA{'A' * 16} y {'0f' * 12}", 2: f"a {token} b", 3: pem, 4: f"see {b64} end", 5: f"hex {key.hex()}", 6: f"k {ssh} z", 7: "passwordless token: ab secret", 8: "A" * 64 + " " + base64.b64encode(b"plain prose, nothing hidden in it at all").decode(), 9: f"x{token[:40]}.{token[-4:]}.zz"}
    got = {r.id: r for r in secrets.scan(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got[1].spans == "assign:2:22,access:26:46,hex:49:73" and got[1].base_sha256 == hashlib.sha256(got[1].spans.encode()).hexdigest()
    kinds = {i: sorted({s.split(":")[0] for s in r.spans.split(",") if s}) for i, r in got.items()}
    assert kinds[2] == ["jwt"] and kinds[3] == ["pem"] and kinds[4] == ["der"] and kinds[5] == ["der", "hex"] and kinds[6] == ["ssh"]
    assert kinds[7] == kinds[8] == kinds[9] == []
    assert secrets.scan(docs).count() == len(ODD) and secrets.scan(none).count() == 0
    assert secrets.redacted("ab12cd", [("x", 2, 4), ("y", 3, 4)]) == "ab<secret>cd" and secrets.redacted(None, []) is None


def test_secrets_after_equals_signs_and_escaped_breaks():
    key = der(b"\x02\x01\x00", *[b"\x02\x20" + bytes(range(1, 33))] * 5)
    b64 = base64.b64encode(key).decode()
    assert secrets.confirmed_spans(f"PRIVATE_KEY={b64}\nX=1") == [("der", 12, 12 + len(b64))]
    assert secrets.confirmed_spans(f"KEY={key.hex().upper()}") == [("der", 4, 4 + 2 * len(key))]
    for broken in ("\\n", "\\r\\n", "\\\\n"):
        pem = f"-----BEGIN PRIVATE KEY-----{broken}{b64[:64]}{broken}{b64[64:]}{broken}-----END PRIVATE KEY-----"
        assert secrets.confirmed_spans(f'{{"private_key": "{pem}{broken}"}}') == [("pem", 17, 17 + len(pem))]


def test_spans_against_a_plain_scan_and_in_linear_time():
    rng = np.random.default_rng(8)
    parts = ["password", "Api_Key", "token", "secret", "passwd", " ", "  ", ":", "=", '"', "'", "AKIA", "A1B2C3D4E5F6G7H8", "a1b2c3d4e5f6", "0123456789abcdef", "é", "\n", "x/+.-_9Z", "API-KEY"]
    for _ in range(2000):
        text = "".join(rng.choice(parts, rng.integers(0, 25)))
        want = [("assign", m.start(), m.end()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.IGNORECASE | re.ASCII) if len(m[2]) >= 6]
        want += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 20]
        want += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() >= 24]
        assert sorted(secrets.base_spans(text)) == sorted(want), text
    token = ".".join(base64.urlsafe_b64encode(json.dumps(x).encode()).decode().rstrip("=") for x in ({"alg": "HS256", "typ": "JWT"}, {"sub": "1234567890", "name": "someone"})) + "." + "s" * 43
    began = time.process_time()
    assert len(secrets.confirmed_spans(" ".join([token] * 20_000))) == 20_000
    assert time.process_time() - began < 5


def test_broken_lengths_are_not_keys():
    key = der(b"\x02\x01\x00", *[b"\x02\x20" + bytes(range(1, 33))] * 5)
    assert secrets.is_der_key(key) and not secrets.is_der_key(key[:-1]) and not secrets.is_der_key(key + b"x")
    assert not secrets.is_der_key(der(b"\x04\x20" + bytes(32)))
    assert not secrets.is_signed_token("eyJhIjoxfQ", "eyJhIjoxfQ")


def test_token_spans_follow_the_tokens():
    text = "É «quoted», -- 日本語 a.b c\n ?! end"
    spans = toxicity.token_spans(text)
    assert [toxicity.tokens(text[a:b].encode())[0] for a, b in spans] == toxicity.tokens(text.encode())
