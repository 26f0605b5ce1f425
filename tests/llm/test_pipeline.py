import os

import pytest

import corpus_pipeline
from waymill.llm import best_fit_pack, queries, simhash_near

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        after = corpus_pipeline.materialize(stage(spark, before, SF), name)
        if name != "packing":
            assert set(after.columns) == set(docs.columns)
        a, b = before.count(), after.count()
        if name in ("quality", "near_copies"):
            assert 0.5 * a < b <= a
        if name == "repeated_passages":
            assert b == a and after.where("length(text) > n_chars or text is null").count() == 0
        if name == "mixture":
            assert b >= a and after.select("doc_id").distinct().count() == before.select("doc_id").distinct().count()
        before = after
    used = before.groupBy("sequence_id").agg({"length": "sum"}).collect()
    assert all(r[1] <= 2048 for r in used)


def test_stages_on_odd_tables(spark, repeated, none, tmp_path):
    labels = spark.createDataFrame([(i, int(i % 5 > 0), 0) for i in range(1, 15)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for docs in (repeated, repeated.where("false")):
        for name, stage in corpus_pipeline.STAGES:
            docs = corpus_pipeline.materialize(stage(spark, docs, str(tmp_path)), name)


def table(spark, rows):
    found = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return corpus_pipeline.materialize(found, "rows")


def test_near_copies_are_verified(spark):
    """The same words in another order have one fingerprint and no shingle in common; a small edit of a text is a copy."""
    words = [f"word{i}" for i in range(100)]
    edited = [*words[:-1], "other"]
    docs = table(spark, [(1, " ".join(words)), (2, " ".join(reversed(words))), (3, " ".join(edited)), (4, " ".join(words).upper()), (5, "")])
    assert sorted(r.doc_id for r in corpus_pipeline.near_copies(spark, docs, "").collect()) == [1, 2, 5]
    rows = docs.select("doc_id", "text", "doc_id").toDF("doc_id", "text", "rid")
    for block in (1, 512):
        found = {r.doc_id: r.component for r in simhash_near.verified_duplicates(rows, block=block).collect()}
        assert found[1] == found[3] == found[4] and len(set(found.values())) == 3


def test_near_copies_go_by_row(spark):
    """An id that is a copy in one row keeps its other text; a group always keeps one row."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    docs = table(spark, [(1, a), (2, a), (2, b), (3, c), (2, c), (None, a), (None, a), (2, b)])
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.near_copies(spark, docs, "").collect()]
    assert sorted(kept, key=str) == sorted([(1, a), (2, b), (2, c), (None, a), (None, a)], key=str)


def test_mixture_repeats_each_row_by_itself(spark, tmp_path):
    """One domain, rates under 2: every row comes out once or twice, without an id or with one that repeats; empty ones once."""
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = [(1, "one text"), (2, "two texts"), (2, "two texts"), (2, "another"), (None, "no id"), (None, None)]
    docs = table(spark, rows)
    out = corpus_pipeline.mixture(spark, docs, str(tmp_path))
    assert out.columns == docs.columns
    got = [(r.doc_id, r.text) for r in out.collect()]
    assert all(rows.count(x) <= got.count(x) <= 2 * rows.count(x) for x in rows) and set(got) == set(rows)
    assert got.count((None, None)) == 1


def test_recall_of_near_copies(spark):
    """Of the documents that go by all pairs at 0.8, nine in ten go at least, and no others do."""
    sf = SF.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = sorted((r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect())
    sets = [set(simhash_near.shingle_set(t).tolist()) for _, t in rows]
    having = {}
    for i, s in enumerate(sets):
        for x in s:
            having.setdefault(x, []).append(i)
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    empty = [i for i, s in enumerate(sets) if not s]
    pairs, direct = [], 0
    for i, s in enumerate(sets):
        both = {}
        for x in s:
            for j in having[x]:
                if j < i:
                    both[j] = both.get(j, 0) + 1
        pairs += [(j, i) for j, n in both.items() if n / (len(s) + len(sets[j]) - n) >= 0.8]
    for j, i in [*pairs, *zip(empty, empty[1:], strict=False)]:
        a, b = sorted((root(i), root(j)))
        label[b] = a
    want = {rows[i][0] for i in range(len(rows)) if root(i) != i}
    kept = {r.doc_id for r in corpus_pipeline.near_copies(spark, docs, sf).select("doc_id").collect()}
    gone = {d for d, _ in rows} - kept
    found = {r.doc_id: r.component for r in simhash_near.verified_duplicates(docs.selectExpr("doc_id rid", "doc_id", "text")).collect()}
    direct = sum(found[rows[i][0]] == found[rows[j][0]] for i, j in pairs)
    print(len(want), len(gone), len(pairs), direct)
    assert len(want) > 20 and gone <= want and len(gone) >= 0.9 * len(want) and direct >= 0.9 * len(pairs)


def test_every_operator_has_a_query():
    assert [n.split("_")[0] for n in queries.queries()] == [f"op{i}" for i in range(1, 11)]


def test_decoding_repeats(spark):
    assert best_fit_pack.pieces([0], 5) == [(0, 1)]
