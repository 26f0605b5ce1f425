"""The registered queries on the smallest tables, column by column, against plain versions of what they return."""

import hashlib
import math
import os
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from test_corpus_operators import slow_components, slow_repeats, slow_simhash
from waymill.llm import multiset_hash, queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def plain(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    return {r.doc_id: r.text or "" for r in sorted(rows)}


def result(spark, name, sf=SF):
    return {r.doc_id: r for r in queries.queries()[name](spark, sf).collect()}


def crc(i):
    return zlib.crc32(str(i).encode())


def test_op1(spark, plain):
    rows = result(spark, "op1_quality_mil")
    assert list(rows) and sorted(rows) == list(plain)
    assert all(r.held_out == (crc(i) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for i, r in rows.items())


def test_op1_on_held_out_labels(spark):
    sf = SF.replace("0.001", "0.01")
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [(quality[i], r.score) for i, r in result(spark, "op1_quality_mil", sf).items() if r.held_out and i in quality]
    good, bad = ([s for q, s in held if q == k] for k in (1, 0))
    assert len(good) > 20 and len(bad) > 5
    assert np.mean([(a > b) + 0.5 * (a == b) for a in good for b in bad]) > 0.95


def test_op2(spark, plain):
    rows = result(spark, "op2_ppm_score")
    split = {i: re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t)) + [None] for i, t in plain.items()}
    c = Counter(w for i, ws in split.items() if crc(i) % 10 for w in ws)
    n, v = sum(c.values()), len(c)
    seen = {}
    for i, t in plain.items():
        if crc(i) % 10:
            s = [256] * 5 + list(t.encode().lower()) + [256]
            for at in range(5, len(s)):
                for k in range(6):
                    seen.setdefault(tuple(s[at - k : at]), Counter())[s[at]] += 1
    for i, ws in split.items():
        r = rows[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (crc(i) % 10 == 0, len(ws), sum(c[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws))
    for i in sorted(plain, key=lambda i: len(plain[i]))[:20]:
        s = [256] * 5 + list(plain[i].encode().lower()) + [256]
        total = 0.0
        for at in range(5, len(s)):
            out, p = set(), 1.0
            for k in range(5, -1, -1):
                left = {a: m for a, m in seen.get(tuple(s[at - k : at]), {}).items() if a not in out}
                if not left:
                    continue
                t, q = sum(left.values()), len(left)
                if s[at] in left:
                    p *= (left[s[at]] - 0.5) / t
                    break
                p *= q / (2 * t)
                out |= set(left)
            else:
                p *= 1 / (257 - len(out))
            total += math.log10(p)
        assert rows[i].score == pytest.approx(total, rel=1e-5)


def test_op3(spark, plain):
    rows = result(spark, "op3_suffix_dedup")
    for (i, t), (kept, removed, spans) in zip(plain.items(), slow_repeats([t.encode() for t in plain.values()], 100), strict=True):
        assert tuple(rows[i]) == (i, len(t.encode()), removed, spans, hashlib.sha256(kept).hexdigest())


def test_op4(spark, plain):
    rows = result(spark, "op4_media_columns")
    by_text = {}
    for i, t in plain.items():
        raw = t.encode()
        data = raw + b"\xff" * ((-len(raw)) % 576 or (0 if raw else 576))
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]))
        shades = Counter(b // 16 for b in data)
        step = sum(abs(a - b) for a, b in zip(data, data[1:], strict=False)) * 1000 // (len(data) - 1)
        assert r.feature == ",".join(str(shades[k]) for k in range(16)) + f";{step}"
        assert len(r.media_sha256) == 64 and r.media_bytes > 33
        assert by_text.setdefault(t, tuple(r)[1:]) == tuple(r)[1:]


def test_op5(spark, plain):
    rows, ids = result(spark, "op5_multiset_fingerprint"), list(plain)
    for i, j in zip(ids, ids[1:] + ids[:1], strict=True):
        k = len(plain[i]) // 4
        new, r = plain[i][: len(plain[i]) - k] + plain[j][:k], rows[i]
        assert (r.n_chars, r.edited_sha256) == (len(plain[i]), hashlib.sha256(new.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (multiset_hash.fingerprint(plain[i]).hex(), multiset_hash.fingerprint(new).hex())
        lanes = [np.frombuffer(bytes.fromhex(x), "<i4")[16:].astype(float) for x in (r.fingerprint, r.edited_fingerprint, rows[j].fingerprint)]
        for like, a, b in ((r.near_edited, lanes[0], lanes[1]), (r.near_next, lanes[0], lanes[2])):
            n = np.linalg.norm(a) * np.linalg.norm(b)
            assert like == pytest.approx(max(0.0, a @ b / n) if n else like, abs=1e-9)


def test_op6(spark, plain):
    rows, library = result(spark, "op6_token_counts"), Tokenizer.from_file(P.path("word_bpe_49k.json"))
    for i, t in plain.items():
        n = len(library.encode(t, add_special_tokens=False).ids)
        assert tuple(rows[i]) == (i, len(t.encode()), n, n > 2048)


def test_op7(spark, plain):
    rows = result(spark, "op7_simhash_near")
    fps = {i: slow_simhash(t) for i, t in plain.items()}
    found = slow_components(list(fps), list(fps.values()))
    for i in plain:
        assert tuple(rows[i]) == (i, f"{fps[i]:016x}", found[i])


def test_op8(spark, plain):
    rows = result(spark, "op8_source_mix")
    assert sorted(rows) == list(plain)
    assert all(r.tokens == len(plain[i].encode().split()) and r.rate >= 0 and abs(r.copies - r.rate) < 1 and 0 < r.posterior <= 1 for i, r in rows.items())
    totals = Counter()
    for r in rows.values():  # posteriors are nearly 0 or 1 here, so the likeliest domain's totals are nearly the expected ones
        totals[r.domain] += r.rate * r.tokens
    mean = sum(totals.values()) / len(totals)
    assert len(totals) > 1 and all(abs(t - mean) < 0.1 * mean for t in totals.values())


def test_op9(spark, plain):
    rows = result(spark, "op9_ring_shards")
    for i, t in plain.items():
        r = rows[i]
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(t.encode()) + 8, zlib.crc32(t.encode()), "rows", None)
    by = {}
    for r in rows.values():
        by.setdefault(r.shard, []).append(r.slot)
    assert sorted(by) == list(range(24)) and all(sorted(slots) == list(range(len(slots))) for slots in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1


def test_op10(spark, plain):
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want, total = {}, 0
    for i, t in plain.items():
        ids = np.array([*library.encode(t, add_special_tokens=False).ids, 0], "<u4")
        total += len(ids)
        first = len(ids) if len(ids) <= 2048 else len(ids) % 2048 or 2048
        for k, at in enumerate([0, *range(first, len(ids), 2048)]):
            n = first if not k else 2048
            want[i, k] = (at, n, zlib.crc32(ids[at : at + n].tobytes()))
    rows = queries.queries()["op10_best_fit_pack"](spark, SF).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in by.values():
        held.sort()
        assert [o for o, _ in held] == [sum(n for _, n in held[:k]) for k in range(len(held))] and sum(n for _, n in held) <= 2048
    assert len(by) <= max(-(-total // 2048), sum(n > 1024 for _, n, _ in want.values())) + 1
