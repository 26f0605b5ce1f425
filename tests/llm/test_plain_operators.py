import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from waymill.llm import best_fit_pack, media_columns, multiset_hash, quality_mil, ring_shard, token_count
from waymill.llm.common import materialize


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_purge_deletes_what_was_written(spark, docs):
    from waymill.llm import common

    kept = common.materialize(docs.select("doc_id"), "kept")
    assert kept.count() == docs.count()
    common.purge(spark)
    with pytest.raises(Exception, match="FAILED_READ_FILE|PATH_NOT_FOUND|does not exist|FileNotFound"):
        spark.read.parquet(kept.inputFiles()[0]).count()


# sharding


def test_ring_counts_are_even_and_slots_gapless(repeated, none):
    for shards in (1, 4, 24):
        rows = ring_shard.assign(repeated, shards).collect()
        assert len(rows) == repeated.count()
        counts = np.bincount([r.shard for r in rows], minlength=shards)
        assert counts.max() - counts.min() <= 1
        for s in range(shards):
            assert sorted(r.slot for r in rows if r.shard == s) == list(range(counts[s]))
    assert ring_shard.assign(none, 4).count() == 0


def test_ring_is_the_key_by_key_walk():
    rng = np.random.default_rng(3)
    counts = {int(c): int(n) for c, n in enumerate(rng.integers(0, 4, 2 * 256))}
    plan = ring_shard.walk(counts, 5, slack=0.1, vnodes=16, slots=256)
    points = ring_shard.ring(5, 16, 256)
    room, load, want = ring_shard.capacities(sum(counts.values()), 5, 0.1), [0] * 5, {}
    for cell in sorted(counts):
        for rank in range(counts[cell]):
            after = [s for p, s in points if p >= cell % 256] + [s for p, s in points]
            shard = next(s for s in after if load[s] < room[s])
            want[cell, rank] = shard, load[shard]
            load[shard] += 1
    got = {(c, k): (s, first + k - low) for c, low, high, s, first in plan for k in range(low, high)}
    assert got == want


def test_ring_moves_little_with_slack(spark):
    docs = spark.range(4000).selectExpr("id doc_id", "cast(id as string) text")
    a, b = (by_id(ring_shard.assign(docs, n, slack=0.25)) for n in (10, 11))
    assert sum(a[i].shard != b[i].shard for i in a) < 0.45 * len(a)
    assert max(np.bincount([r.shard for r in a.values()])) <= 500


# fingerprints


def test_fingerprints_and_edits(docs, texts, none):
    rows = by_id(multiset_hash.next_edits(docs))
    ids = sorted(texts)
    assert sorted(rows) == ids
    for i, j in zip(ids, ids[1:] + ids[:1], strict=True):
        new, _ = multiset_hash.edited(texts[i], texts[j])
        k = len(texts[i]) // 4
        assert new == texts[i][: len(texts[i]) - k] + texts[j][:k]
        r = rows[i]
        own, changed = multiset_hash.fingerprint(texts[i]), multiset_hash.fingerprint(new)
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(texts[i]), hashlib.sha256(new.encode()).hexdigest(), own.hex(), changed.hex())
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert r.near_edited == pytest.approx(own.likeness(changed))
    assert rows[15].fingerprint == rows[16].fingerprint and rows[15].near_next == 1.0  # another order of paragraphs
    assert rows[1].fingerprint == rows[2].fingerprint != rows[14].fingerprint
    assert rows[11].near_edited > 0.5
    assert multiset_hash.next_edits(none).count() == 0


def test_fingerprints_of_repeated_rows(repeated):
    rows = multiset_hash.next_edits(repeated).collect()
    assert len(rows) == repeated.count()
    assert len({r.fingerprint for r in rows if r.doc_id == 1}) == 1


def test_an_id_with_most_rows_is_cut_again(spark):
    rows = [(i, f"text number {i}") for i in range(40)] + [(7, f"of seven {i}") for i in range(300)] + [(None, f"of none {i}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = [(r.doc_id, r.text) for r in docs.orderBy(docs.doc_id.asc_nulls_first(), F.xxhash64("text")).collect()]
    after = dict(zip(want, want[1:] + want[:1], strict=True))
    edits = sorted((str(d), hashlib.sha256(multiset_hash.edited(t, after[d, t][1])[0].encode()).hexdigest()) for d, t in want)
    got = multiset_hash.next_edits(docs).collect()
    assert sorted((str(r.doc_id), r.edited_sha256) for r in got) == edits


def test_fingerprints_can_be_read_back(docs, texts):
    """Likeness, insertion and deletion from the returned strings alone."""
    rows = by_id(multiset_hash.next_edits(docs))
    ids = sorted(rows)
    for i, j in zip(ids, ids[1:] + ids[:1], strict=True):
        a, b, c = (multiset_hash.Sums.of(x) for x in (rows[i].fingerprint, rows[i].edited_fingerprint, rows[j].fingerprint))
        assert (rows[i].near_edited, rows[i].near_next) == (a.likeness(b), a.likeness(c))
    longer = multiset_hash.Sums.of(rows[15].fingerprint).add([b"one more line"])
    assert longer.hex() == multiset_hash.fingerprint("one more line\n" + texts[15]).hex()
    assert longer.drop([b"one more line"]).hex() == rows[15].fingerprint


def test_multiset_hash_is_homomorphic():
    a, b = [b"x", b"y", b"x"], [b"z z z z"]
    s = multiset_hash.Sums().add(a).add(b)
    assert s.copy().drop(b).hex() == multiset_hash.Sums().add(a[::-1]).hex()
    assert s.copy().drop([b"x"]).hex() != s.hex()
    assert s.drop(a).drop(b).hex() == multiset_hash.Sums().hex()


# media


def test_media_round_trip(docs, texts, none):
    rows = by_id(media_columns.media_table(docs))
    for i, t in texts.items():
        data, n = media_columns.payload(t)
        assert len(data) % 576 == 0 and len(data) >= 576 and data[:n] == t.encode() and set(data[n:]) <= {255}
        image = media_columns.to_png(data)
        assert media_columns.from_png(image) == data and media_columns.header(image[:33]) == (576, len(data) // 576, 8)
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (n, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]))
        assert (r.media_bytes, r.media_sha256, r.height) == (len(image), hashlib.sha256(image).hexdigest(), len(data) // 576)
    assert rows[1].feature == rows[2].feature
    assert media_columns.media_table(none).count() == 0


def test_media_is_read_by_another_reader(spark, repeated, tmp_path):
    """Java's own PNG reader; shards roll at a size, a second writing gives the same files, and rows of a content meet at one place."""
    java = spark.sparkContext._jvm
    root = f"file://{tmp_path}/media"
    stored = media_columns.settled(materialize(media_columns.store(repeated.repartition(4), root, most=3), "stored"))
    rows = stored.collect()
    assert len(rows) == repeated.count() and len({r.shard for r in rows}) > 3
    assert len({(r.shard, r.offset) for r in rows}) == len({r.digest for r in rows})
    before = sorted(f.name for f in (tmp_path / "media").iterdir())
    media_columns.store(repeated.repartition(4), root, most=3).count()
    assert sorted(f.name for f in (tmp_path / "media").iterdir()) == before
    want = sorted(hashlib.sha256(media_columns.payload(r.text)[0]).hexdigest() for r in repeated.collect())
    assert sorted(r.digest for r in rows) == want
    for r in {r.digest: r for r in rows}.values():
        with open(r.shard, "rb") as f:
            f.seek(r.offset)
            image = f.read(r.length)
        shown = java.javax.imageio.ImageIO.read(java.java.io.ByteArrayInputStream(image))
        own = shown.getRaster()
        assert shown.getWidth() == 576 and own.getNumBands() == 1
        data = bytes(own.getDataBuffer().getData())
        assert hashlib.sha256(data).hexdigest() == r.digest


def test_media_shards_are_tar_files_with_one_member_for_each_content(repeated, tmp_path):
    import tarfile

    root = f"file://{tmp_path}/media"
    rows = media_columns.store(repeated.coalesce(1), root).collect()
    members = []
    for f in (tmp_path / "media").iterdir():
        with tarfile.open(f) as t:
            members += [(m.name, t.extractfile(m).read()) for m in t]
    assert len(members) == len({r.digest for r in rows})
    assert all(hashlib.sha256(media_columns.from_png(data)).hexdigest() + ".png" == name for name, data in members)


# token counts


def test_token_counts_are_the_librarys(docs, texts, none):
    path = P.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rows = by_id(token_count.token_counts(docs, path))
    for i, t in texts.items():
        n = len(library.encode(t, add_special_tokens=False).ids)
        assert (rows[i].n_tokens, rows[i].n_bytes, rows[i].over_limit) == (n, len(t.encode()), n > 2048), i
    assert token_count.token_counts(none, path).count() == 0


def test_token_counts_on_odd_characters():
    path = P.path("word_bpe_49k.json")
    library, own = Tokenizer.from_file(path), token_count.counter(path)
    rng = np.random.default_rng(5)
    pool = "aB'sS  \n\t  ​́éßİıΣσςǅ９Ⅷ½漢😀'll’s_-.<|>" + chr(0x1F1E6) + "ﬁK"
    samples = ["".join(rng.choice(list(pool), rng.integers(1, 30))) for _ in range(3000)]
    assert own.count(samples) == [len(e.ids) for e in library.encode_batch(samples, add_special_tokens=False)]


def test_whole_token_table_holds_only_what_the_library_shows():
    path = P.path("word_bpe_49k.json")
    own = token_count.counter(path)
    assert len(own.whole) > 20000
    some = list(own.whole)[::97]
    assert all(len(e.ids) == 1 for e in own.library.encode_batch(some, add_special_tokens=False))


# packing

PACK = (P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)


def test_packing_is_whole_and_gapless(repeated, none):
    library = Tokenizer.from_file(PACK[0])
    rows = best_fit_pack.pack_documents(repeated, *PACK, capacity=64).collect()
    want = sorted(zlib.crc32(np.array((ids + [0])[at : at + n], "<u4").tobytes()) for r in repeated.collect() for ids in [library.encode(r.text or "", add_special_tokens=False).ids] for at, n in best_fit_pack.pieces(np.array(ids + [0]), 64))
    assert sorted(r.ids_crc32 for r in rows) == want
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in by.values():
        at = 0
        for offset, n in sorted(held):
            assert offset == at
            at += n
        assert at <= 64
    total = sum(r.length for r in rows)
    assert len(by) <= -(-total // 64) + 2
    assert best_fit_pack.pack_documents(none, *PACK).count() == 0


def test_pieces_are_cut_from_the_end():
    assert best_fit_pack.pieces(np.arange(10), 4) == [(0, 2), (2, 4), (6, 4)]
    assert best_fit_pack.pieces(np.arange(8), 4) == [(0, 4), (4, 4)]
    assert best_fit_pack.pieces(np.arange(1), 4) == [(0, 1)]


def fewest(sizes, capacity):
    """The least number of sequences, over all ways: (sequences, tokens in the last) for every set of pieces."""
    best = {0: (1, 0)}
    for held in range(1, 1 << len(sizes)):
        ways = []
        for i, s in enumerate(sizes):
            if held >> i & 1:
                n, used = best[held & ~(1 << i)]
                ways.append((n, used + s) if used + s <= capacity else (n + 1, s))
        best[held] = min(ways)
    return best[(1 << len(sizes)) - 1][0]


def test_pack_against_all_ways():
    """Matching and best fit aren't always the best there is: nearly always, and never more than one sequence worse."""
    rng = np.random.default_rng(3)
    worse = 0
    for _ in range(150):
        sizes = rng.integers(1, 13, rng.integers(1, 10)).tolist()
        bins = sum(n for n, _ in best_fit_pack.pack({s: sizes.count(s) for s in set(sizes)}, 12))
        best = fewest(sizes, 12)
        assert best <= bins <= best + 1
        worse += bins > best
    assert worse <= 15


def test_common_lengths_have_many_cells(repeated):
    pieces = materialize(best_fit_pack.cut(repeated, *PACK, capacity=64), "pieces")
    places = [sorted((r.sequence_id, r.offset, r.length) for r in best_fit_pack.packed(pieces, 64, least=least).collect()) for least in (3, 50, 1 << 14)]
    assert places[0] == places[1] == places[2] and len({p[:2] for p in places[0]}) == pieces.count()


def test_pack_bounds():
    rng = np.random.default_rng(1)
    for _ in range(200):
        sizes = rng.integers(1, 13, rng.integers(1, 40))
        counts = {int(s): int((sizes == s).sum()) for s in np.unique(sizes)}
        plan = best_fit_pack.pack(counts, 12)
        held = {}
        for n, items in plan:
            assert sum(s * k for s, k in items) <= 12
            for s, k in items:
                held[s] = held.get(s, 0) + n * k
        assert held == counts
        bins = sum(n for n, _ in plan)
        assert bins <= 1.25 * max(-(-int(sizes.sum()) // 12), (sizes > 6).sum()) + 1
        table = best_fit_pack.intervals(plan)
        spots = set()
        for s, n in counts.items():
            q, at = best_fit_pack.place(table, np.full(n, s), np.arange(n))
            for a, b in zip(q.tolist(), at.tolist(), strict=True):
                assert not spots & {(a, b + k) for k in range(s)}
                spots |= {(a, b + k) for k in range(s)}


# quality


def test_quality_gradients_and_attention():
    rng = np.random.default_rng(0)
    m = quality_mil.Model(seed=3, hidden=5, gates=4)
    x, bag, y = rng.standard_normal((9, quality_mil.FEATURES)), np.array([0, 0, 0, 1, 1, 2, 2, 2, 2]), np.array([1.0, 0, 1])
    w = np.ones(3)
    loss = lambda: -float(np.mean(y * np.log(m.forward(x, bag, 3)[0]) + (1 - y) * np.log(1 - m.forward(x, bag, 3)[0])))
    for name, g in m.gradients(x, bag, y, w, 0.0).items():
        at = tuple(rng.integers(0, s) for s in g.shape)
        m.p[name][at] += 1e-6
        up = loss()
        m.p[name][at] -= 2e-6
        down = loss()
        m.p[name][at] += 1e-6
        assert g[at] == pytest.approx((up - down) / 2e-6, abs=1e-6)
    a = m.forward(x, bag, 3)[1]["a"]
    assert np.bincount(bag, a) == pytest.approx(np.ones(3))


def test_quality_scores_are_the_plain_ones(spark, docs, texts):
    """Passage by passage, from the model's numbers; and the sample is bounded by passages, each text whole."""
    import math

    m = quality_mil.Model(seed=5)
    m.learned = True
    got = {r.doc_id: r.score for r in quality_mil.scores(docs, m).collect()}
    for i, t in texts.items():
        x = np.clip((quality_mil.encode(t) - m.mean) / m.scale, -8, 8)
        h = [[math.tanh(sum(float(v) * m.p["E"][k, j] for k, v in enumerate(row)) + m.p["e"][j]) for j in range(24)] for row in x[:40]]
        if len(x) > 40:
            continue
        gate = [sum(math.tanh(sum(a * m.p["V"][k, g] for k, a in enumerate(row))) / (1 + math.exp(-sum(a * m.p["U"][k, g] for k, a in enumerate(row)))) * m.p["w"][g] for g in range(12)) for row in h]
        a = [math.exp(v) / sum(map(math.exp, gate)) for v in gate]
        z = sum(sum(w * row[j] for w, row in zip(a, h, strict=True)) * m.p["c"][j] for j in range(24)) + m.p["b"][0]
        assert got[i] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-5)
    labels = spark.createDataFrame([(i, i % 2) for i in texts], "doc_id long, quality int")
    assert quality_mil.learn(docs, labels, passages=20).learned
    assert not quality_mil.learn(docs, labels, passages=0).learned


def test_quality_learns_and_scores_all(spark, docs, none, texts):
    good = "\n".join("the of and ertion thing with reth ons" for _ in range(3))
    rows = [(100 + i, (good + f" w{i}") if i % 2 else f"BAD!! WORDS!! {i}!! AND!! MORE!! " * 5, i % 2) for i in range(200)]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    model = quality_mil.learn(labelled.select("doc_id", "text"), labelled.select("doc_id", "quality"))
    got = {r.doc_id: r.score for r in quality_mil.scores(labelled, model).collect()}
    assert np.mean([(got[i] > 0.5) == bool(q) for i, _, q in rows]) > 0.97
    scored = by_id(quality_mil.scores(docs, model))
    assert sorted(scored) == sorted(texts) and all(0 <= r.score <= 1 for r in scored.values())
    assert quality_mil.scores(none, model).count() == 0
    empty = quality_mil.learn(none, labelled.select("doc_id", "quality").where("false"))
    assert {r.score for r in quality_mil.scores(docs, empty).collect()} == {0.5}
