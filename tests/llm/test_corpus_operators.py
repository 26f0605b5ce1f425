import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from waymill.llm import ppm_score, simhash_near, source_mix, suffix_dedup
from waymill.llm.common import id_crc, materialize


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


# language model


def test_probabilities_of_each_context_sum_to_one():
    texts = ["abracadabra", "abra", "", "banana bandana", "naïve"]
    levels = levels_of(texts, 3)
    trie = ppm_score.build(levels, 3)
    own = np.bincount(trie.classes, minlength=trie.move.shape[1])
    assert ((10.0 ** trie.logp) * own).sum(1) == pytest.approx(np.ones(len(trie.logp)), abs=1e-5)


def levels_of(texts, order):
    code, n = ppm_score.grams(texts, order)
    out = []
    for j in range(order + 1):
        u, at = np.unique(code & ((1 << 9 * (j + 1)) - 1), return_inverse=True)
        out.append((u, np.bincount(at, n).astype(int)))
    return out


def slow_score(texts, order, text):
    """Symbol by symbol, with escapes and exclusion, from plain dictionaries."""
    seen = {}
    for t in texts:
        s = [256] * order + list(t.lower().encode()) + [256]
        for i in range(order, len(s)):
            for k in range(order + 1):
                seen.setdefault(tuple(s[i - k : i]), Counter())[s[i]] += 1
    total, s = 0.0, [256] * order + list(text.lower().encode()) + [256]
    for i in range(order, len(s)):
        out, p = set(), 1.0
        for k in range(order, -1, -1):
            c = {a: n for a, n in seen.get(tuple(s[i - k : i]), {}).items() if a not in out}
            if not c:
                continue
            t, q = sum(c.values()), len(c)
            if s[i] in c:
                p *= (c[s[i]] - 0.5) / t
                break
            p *= q / (2 * t)
            out |= set(c)
        else:
            p *= 1 / (257 - len(out))
        total += math.log10(p)
    return total


def test_trie_scores_like_the_plain_model():
    texts = ["abracadabra", "abra", "", "banana bandana", "Naïve ABRA"]
    trie = ppm_score.build(levels_of(texts, 3), 3)
    for t in ["abra", "", "xyz", "bananabra cad", "naïve", "漢"]:
        assert trie.score([t])[0] == pytest.approx(slow_score(texts, 3, t), abs=1e-4), t
    many = ["abra", "", "banana"]
    assert trie.score(many) == pytest.approx([trie.score([t])[0] for t in many])


def test_scores_and_base(docs, texts, none, spark):
    kept = materialize(docs.select("doc_id", "text"), "t")
    rows = by_id(ppm_score.scores(kept, id_crc() % 10 != 0, order=3))
    split = {i: re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t)) + [None] for i, t in texts.items()}
    c = Counter(w for i, ws in split.items() if zlib.crc32(str(i).encode()) % 10 for w in ws)
    n, v = sum(c.values()), len(c)
    for i, ws in split.items():
        want = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
        r = rows[i]
        assert r.base_score == pytest.approx(want) and r.score < 0
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (zlib.crc32(str(i).encode()) % 10 == 0, len(ws), sum(c[w] > 0 for w in ws), n)
    assert ppm_score.scores(materialize(kept.where("false"), "t0"), id_crc() % 10 != 0).count() == 0
    untrained = by_id(ppm_score.scores(kept, F.lit(False)))
    assert untrained[4].score == pytest.approx(-math.log10(257), abs=1e-5) and untrained[4].n_known == 0


def test_every_context_of_training_is_known(spark):
    """However rare: one text among many has a context of its own, which a pruned model forgets."""
    texts = {i: f"plain words number {i * 7919 % 1000} of many" for i in range(1, 400)} | {400: "zyzzyva qoph", 401: "zyzzyva qoph", 402: ""}
    kept = materialize(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3), "rare")
    train = [t for i, t in texts.items() if i != 401]
    rows = by_id(ppm_score.scores(kept, F.col("doc_id") != 401))
    trie = ppm_score.build(levels_of(train, 5), 5)
    for i in (1, 400, 401, 402):
        assert rows[i].score == pytest.approx(slow_score(train, 5, texts[i]), abs=1e-4)
        assert rows[i].score == pytest.approx(trie.score([texts[i]])[0], abs=1e-4)


def test_scores_do_not_depend_on_blocks(spark, repeated, monkeypatch):
    """Nor on pieces: rows that repeat, have no id, or are longer than a block."""
    want = sorted(ppm_score.scores(repeated.select("doc_id", "text"), id_crc() % 10 != 0).collect(), key=str)
    counts = ppm_score.block_counts
    monkeypatch.setattr(ppm_score, "blocks", lambda docs, where, _, f=ppm_score.blocks: f(docs, where, 3, 400))
    monkeypatch.setattr(ppm_score, "block_counts", lambda blocked, *a: counts(blocked.repartition(5), *a))
    got = sorted(ppm_score.scores(repeated.select("doc_id", "text"), id_crc() % 10 != 0).collect(), key=str)
    assert len(want) == len(got) == repeated.count()
    for a, b in zip(want, got, strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-6)
    codes, of = map(np.concatenate, zip(*ppm_score.coded(["ab", "", "abc"], 3, 2), strict=True))
    whole, at = map(np.concatenate, zip(*ppm_score.coded(["ab", "", "abc"], 3), strict=True))
    assert codes.tolist() == whole.tolist() and of.tolist() == at.tolist() == [0, 0, 0, 1, 2, 2, 2, 2]


# near copies


def slow_simhash(text, width=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text))
    shingles = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(ids, fps, most=3):
    label = dict(zip(ids, ids, strict=True))
    while True:
        new = {i: min(label[j] for j, g in zip(ids, fps, strict=True) if (f ^ g).bit_count() <= most) for i, f in zip(ids, fps, strict=True)}
        if new == label:
            return label
        label = new


def test_fingerprints_and_components(docs, texts, none, repeated):
    rows = by_id(simhash_near.near_duplicates(docs))
    fps = {i: slow_simhash(t) for i, t in texts.items()}
    assert {i: r.fp & (2**64 - 1) for i, r in rows.items()} == fps
    assert {i: r.component_id for i, r in rows.items()} == slow_components(list(fps), list(fps.values()))
    assert rows[3].fp == rows[4].fp == rows[5].fp == 0 and rows[5].component_id == 3
    assert simhash_near.near_duplicates(none).count() == 0
    again = simhash_near.near_duplicates(repeated).collect()
    assert len(again) == repeated.count() and all(r.component_id == 1 for r in again if r.doc_id in (1, 2) and r.fp == rows[1].fp)


@pytest.mark.parametrize(("most", "segments", "block"), [(3, 4, 4096), (3, 4, 8), (7, 16, 4096), (7, 16, 16), (2, 8, 4096)])
def test_no_link_is_lost(spark, most, segments, block):
    rng = np.random.default_rng(most * segments + block)
    centres = rng.integers(0, 1 << 63, 12, dtype=np.int64).astype(np.uint64)
    fps = set(rng.integers(0, 1 << 63, 150, dtype=np.int64).tolist()) | {0}
    for c in centres:
        for _ in range(25):
            fps.add(int(c) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 2 * most), replace=False)))
    fps = sorted(fps)
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    found = simhash_near.links(spark.createDataFrame([(f,) for f in signed], "fp long"), simhash_near.Ring(most, segments), block)
    pairs = [(r.a & (2**64 - 1), r.b & (2**64 - 1)) for r in found.collect()]
    assert all((a ^ b).bit_count() <= most for a, b in pairs)
    want = slow_components(fps, fps, most)
    roots = {f: f for f in fps}

    def root(f):
        while roots[f] != f:
            f = roots[f]
        return f

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        roots[b] = a
    assert {f: root(f) for f in fps} == want
    table = {r.node: r.root for r in simhash_near.components(found).collect()}
    groups = {}
    for f, s in zip(fps, signed, strict=True):
        groups.setdefault(want[f], set()).add(table.get(s, s))
    assert all(len(g - {min(g)}) == 0 or len(g) == 1 for g in groups.values())


def test_a_group_gives_a_forest_and_no_pairs(spark):
    base = 0x0123456789ABCDEF
    fps = [(base ^ (1 << i) ^ (1 << j)) for i in range(40) for j in range(i)]
    fps = sorted({f - 2**64 if f >= 2**63 else f for f in fps})
    n = simhash_near.links(spark.createDataFrame([(f,) for f in fps], "fp long"), simhash_near.Ring()).count()
    assert len(fps) - 1 <= n <= 8 * len(fps)


# repeated strings


def slow_repeats(rows, size):
    """rows in order of documents -> kept bytes, removed, spans of each."""
    seen, out = set(), []
    for raw in rows:
        mark = bytearray(len(raw))
        for p in range(len(raw) - size + 1):
            w = raw[p : p + size]
            if w in seen:
                mark[p : p + size] = b"\1" * size
            seen.add(w)
        out.append((bytes(b for b, m in zip(raw, mark, strict=True) if not m), sum(mark), sum(m and not (i and mark[i - 1]) for i, m in enumerate(mark))))
    return out


def test_suffix_array_and_prefixes():
    rng = np.random.default_rng(2)
    for n in (1, 2, 9, 300):
        for letters in (1, 2, 5, 256):
            t = rng.integers(0, letters, n).astype(np.uint8)
            raw = t.tobytes()
            sa = suffix_dedup.suffix_array(t)
            assert sa.tolist() == sorted(range(n), key=lambda i: raw[i:])
            lcp = suffix_dedup.common_prefixes(t, sa)
            for i in range(1, n):
                a, b = raw[sa[i - 1] :], raw[sa[i] :]
                assert lcp[i] == next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


def test_repeats_are_the_slow_ones(docs, texts, none):
    rows = by_id(suffix_dedup.without_repeats(docs))
    ids = sorted(texts)
    for i, (kept, removed, spans) in zip(ids, slow_repeats([texts[i].encode() for i in ids], 100), strict=True):
        r = rows[i]
        assert (bytes(r.kept), r.n_bytes, r.n_removed, r.n_spans) == (kept, len(texts[i].encode()), removed, spans), i
    assert suffix_dedup.without_repeats(none).count() == 0


def test_repeats_of_repeated_ids(repeated):
    rows = suffix_dedup.without_repeats(repeated, keep=("lang",)).collect()
    assert len(rows) == repeated.count() and {r.lang for r in rows} == {"en"}
    assert sum(r.n_removed == 0 and r.n_bytes == 177 for r in rows) <= 1 + sum(r.doc_id == 14 for r in rows)


@pytest.mark.parametrize("hot", [2, 4096])
def test_common_passages_in_either_way(spark, hot):
    """A passage in every document, with its own text around it: its anchors are hot with a low limit."""
    rng = np.random.default_rng(hot)
    word = lambda n: " ".join("".join(rng.choice(list("abcdefgh"), 5)) for _ in range(n))
    shared, line = word(40), "a line of thirty or forty bytes here"
    texts = [f"{word(rng.integers(1, 30))} {shared if i % 3 else line}\n{word(rng.integers(1, 30))}\n{line}" for i in range(90)] + [shared[7:150], word(5), "ab" * 400]
    own = spark.createDataFrame([(i, t.encode()) for i, t in enumerate(texts)], "rid long, raw binary").repartition(5)
    got = {r.rid: r.covers for r in suffix_dedup.repeats(own, hot=hot).collect()}
    for i, (kept, removed, spans) in enumerate(slow_repeats([t.encode() for t in texts], 100)):
        c = np.array([(x.lo, x.hi) for x in got.get(i, [])]).reshape(-1, 2)
        left, _, *counts = suffix_dedup.cut(texts[i].encode(), c[:, 0], c[:, 1])
        assert (left, *counts) == (kept, removed, spans)


def test_long_texts_in_pieces(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", 700)
    rng = np.random.default_rng(9)
    raw = bytes(rng.integers(97, 103, 4000).astype(np.uint8))
    whole = np.concatenate([a for a, _ in suffix_dedup.anchors_of([1], [raw])])
    monkeypatch.setattr(suffix_dedup, "PIECE", 1 << 20)
    one = np.concatenate([a for a, _ in suffix_dedup.anchors_of([1], [raw])])
    assert sorted(zip(whole["p"], whole["h"], strict=True)) == sorted(zip(one["p"], one["h"], strict=True))
    assert np.diff(np.sort(one["p"])).max() <= 100 - 32 + 1


def test_a_table_without_repeats(spark):
    own = spark.createDataFrame([(i, " ".join(f"{i}x{k}" for k in range(60)).encode()) for i in range(4)], "rid long, raw binary")
    assert suffix_dedup.repeats(own).count() == 0


def test_shards_are_merged_by_search():
    rng = np.random.default_rng(4)
    base = [bytes(rng.integers(97, 100, 150).astype(np.uint8)) for _ in range(4)]
    parts = [base[i % 4][int(rng.integers(0, 20)) :] + bytes(rng.integers(97, 100, 10).astype(np.uint8)) for i in range(60)]
    rid, lo = rng.integers(0, 9, 60), np.arange(60) * 1000
    got = [suffix_dedup.compared(rid, lo, parts, 100, shard).tolist() for shard in (1 << 18, 3000, 400)]
    assert got[0] == got[1] == got[2] and got[0]


# mixing


def test_rates_meet_the_targets(spark):
    rng = np.random.default_rng(6)
    p = rng.dirichlet([0.4, 0.4, 0.4], 500)
    tokens = rng.integers(0, 200, 500)
    table = spark.createDataFrame([(i, int(n), q.tolist()) for i, (n, q) in enumerate(zip(tokens, p, strict=True))], "doc_id long, tokens long, p array<double>").repartition(4)
    for targets, least in ((source_mix.equal_targets, 0.0), (source_mix.flattened_targets, 0.0), (lambda t: t * np.array([1.4, 0.7, 0.9]), 0.0)):
        steps = source_mix.solve(table, 3, targets, least)
        r = source_mix.rates_of(p, tokens, steps, least)
        assert (r >= 0).all()
        assert (r * tokens) @ p == pytest.approx(targets(tokens @ p), rel=1e-3)


def test_a_target_out_of_reach_is_least_squares(spark):
    p = np.array([[0.5, 0.5], [0.6, 0.4], [0.4, 0.6]])
    tokens = np.array([10, 20, 30])
    table = spark.createDataFrame([(i, int(n), q.tolist()) for i, (n, q) in enumerate(zip(tokens, p, strict=True))], "doc_id long, tokens long, p array<double>")
    steps = source_mix.solve(table, 2, lambda t: np.array([60.0, 0.0]), rounds=400)
    r = source_mix.rates_of(p, tokens, steps, 0.0)
    inverse = np.linalg.pinv((p * tokens[:, None]).T @ p)
    loss = lambda r: float(((r * tokens) @ p - [60, 0]) @ inverse @ ((r * tokens) @ p - [60, 0]))
    best = min(loss(np.array([a, b, c])) for a in np.arange(0, 8, 0.25) for b in np.arange(0, 8, 0.25) for c in np.arange(0, 3, 0.25))
    assert loss(r) <= best + 1e-6


def test_domains_are_learned_and_all_rows_get_a_rate(spark, docs, none):
    words = {"xx": "der die und mit nicht ein", "yy": "les que pour dans une est"}
    rows = [(i, " ".join(np.random.default_rng(i).permutation(words[k].split()).tolist() * 5), k) for i in range(60) for k in [list(words)[i % 2]]]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, domain string")
    model = source_mix.learn(labelled)
    got = by_id(source_mix.rates(labelled.select("doc_id", "text"), model))
    assert all(got[i].domain == k for i, _, k in rows)
    out = source_mix.rates(docs, model).collect()
    assert len(out) == docs.count() and all(r.rate >= 0 and abs(r.copies - r.rate) < 1 for r in out)
    assert all(r.rate == 1.0 for r in out if r.tokens == 0)
    assert source_mix.rates(none, model).count() == 0
    assert {r.rate for r in source_mix.rates(docs, source_mix.learn(none.selectExpr("doc_id", "text", "lang domain"))).collect()} == {1.0}


def test_rounds_without_an_end_are_an_error(spark):
    table = spark.createDataFrame([(1, 10, [0.5, 0.5]), (2, 20, [0.9, 0.1])], "doc_id long, tokens long, p array<double>")
    with pytest.raises(RuntimeError, match="settle"):
        source_mix.solve(table, 2, lambda t: np.array([50.0, 0.0]), rounds=2)


def test_copies_of_rows_without_an_id_differ_by_text(spark):
    docs = spark.createDataFrame([(None, f"text {i}") for i in range(200)], "doc_id long, text string")
    model = source_mix.Classifier(["a"])
    out = source_mix.rates(docs, model, lambda t: t * 1.5).collect()
    assert {r.copies for r in out} == {1, 2} and all(r.rate == pytest.approx(1.5) for r in out)
    assert 250 < sum(r.copies for r in out) < 350


def test_cut_characters_go_and_replacement_characters_stay():
    raw = "a\ufffdb é漢 c\ufffd".encode()
    at = raw.index("漢".encode())
    kept, text, removed, spans = suffix_dedup.cut(raw, np.array([at + 1]), np.array([at + 2]))
    assert (text, removed, spans, len(kept)) == ("a\ufffdb é c\ufffd", 1, 1, len(raw) - 1)


def test_names_and_sizes_that_cannot_be_are_errors(docs):
    kept = suffix_dedup.without_repeats(docs.drop("kept"), keep=("raw", "rid", "score", "block"))
    assert kept.columns == ["doc_id", "kept", "cut_text", "n_bytes", "n_removed", "n_spans", "raw", "rid", "score", "block"]
    assert {(r.raw, r.rid, r.score) for r in kept.collect()} == {("x", 1, 0.5)}
    for bad in ({"keep": ("kept",)}, {"size": 256}, {"size": 10}):
        with pytest.raises(ValueError, match="names|size"):
            suffix_dedup.without_repeats(docs, **bad)


def test_anchors_of_a_bucket_in_lots():
    """Lots of whole anchors, and an anchor over a shard's size in shards that are merged."""
    rng = np.random.default_rng(5)
    heads, parts, want = [], [], {}
    for i in range(60):
        body = bytes(rng.integers(97, 99, 14, dtype=np.uint8))
        heads.append((i % 4, i, 1000, len(body)))
        parts.append(body)
        for k in range(len(body) - 3):
            want.setdefault((i % 4, body[k : k + 4]), []).append((i, 1000 + k))
    blob = lambda h, p: len(h).to_bytes(8, "little") + np.array(h, "<i8").tobytes() + b"".join(p)
    blobs = [blob(heads[:20], parts[:20]), blob(heads[20:], parts[20:])]
    for shard in (20, 100, 1 << 18):
        got = {(int(c["rid"]), k) for covers in suffix_dedup.compared_by_anchor(blobs, 4, shard) for c in covers for k in range(c["lo"], c["hi"])}
        repeats = {(i, p + k) for places in want.values() for i, p in sorted(places)[1:] for k in range(4)}
        assert got >= repeats
        if shard < 1 << 18:  # more anchors in a shard only find more that repeats
            assert len(got) <= sum(map(len, parts))
