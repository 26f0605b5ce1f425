"""Mixing sources to target weights by soft membership.

A classifier, softmax regression over hashed byte pairs, learns domains from a table of labelled documents (a bounded sample of it) and gives
every document a posterior over the domains. Document rates are then sought whose expected token totals, summed over documents as
rate * tokens * posterior, match a target for each domain: least squares with rates held at or above `least` (0: nonnegative), by
projected gradient steps. In the metric that weighs a document by its tokens, and with residuals scaled by the inverse Gram matrix
of the posteriors, the step length is 1 and a document's step depends on its posterior only, so a round is one sum over a small written
table and the driver sees one number per domain and partition. Steps are accelerated (Nesterov's momentum, begun anew where it overshoots);
momentum acts on rates and totals alike, so it needs no further pass. Rounds end where totals meet the targets or move no more: a target that
rates at the bound can't reach is met as nearly as least squares allow. Rounds that don't come to an end are an error.

A rate becomes whole copies by rounding up or down, by the hash of the id and text, with the rate as the expected number; rows keep their
columns. Rows that repeat an id, or have none, are rows of their own; those alike in id and text have the same copies.
Null text counts as empty: 0 tokens, rate 1. Null labels aren't learned from; without labelled rows there is one domain, and rates are 1.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, rows, strings

FEATURES = 1024


def features(text: str | None) -> np.ndarray:
    """Square roots of the shares of hashed byte pairs, letters in lower case."""
    a = np.frombuffer((text or "").encode().lower(), np.uint8)
    out = np.zeros(FEATURES, np.float32)
    for at in range(0, max(0, len(a) - 1), 1 << 20):
        part = a[at : at + (1 << 20) + 1].astype(np.uint32)
        out += np.bincount(((part[:-1] * 256 + part[1:]) * np.uint32(2654435761)) >> np.uint32(22), minlength=FEATURES)
    return np.sqrt(out / max(1.0, float(out.sum())))


class Classifier:
    def __init__(self, domains: list[str]) -> None:
        self.domains = domains
        self.weights = np.zeros((FEATURES + 1, len(domains)))

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = 200, rate: float = 0.3, decay: float = 1e-5) -> Classifier:
        if len(self.domains) > 1:
            x = np.c_[x, np.ones(len(x), np.float32)].astype(np.float32)
            m, v = np.zeros_like(self.weights), np.zeros_like(self.weights)
            want = np.eye(len(self.domains))[y]
            for i in range(1, steps + 1):
                g = x.T @ ((self.softmax(x) - want) / len(x)).astype(np.float32) + decay * self.weights
                m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
                self.weights = self.weights - rate * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.999**i)) + 1e-8)
        return self

    def softmax(self, x: np.ndarray) -> np.ndarray:
        z = x @ self.weights
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def posteriors(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.zeros((0, len(self.domains)))
        x = np.stack([features(t) for t in texts])
        return self.softmax(np.c_[x, np.ones(len(x), np.float32)])


def learn(labelled: DataFrame, sample: int = 4000) -> Classifier:
    """From labelled(doc_id, text, domain), `sample` rows of it at most, by hash of the id."""
    chosen = labelled.where("domain is not null").select(F.xxhash64("doc_id", F.lit(5)).alias("h"), "doc_id", "text", F.col("domain").cast("string").alias("domain"))
    lowest = chosen.select("h").orderBy("h").limit(sample).agg(F.max("h")).first()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows(batches, 1 << 22):
            got = [features(t).tobytes() for t in strings(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(got, pa.binary())], names=["h", "domain", "x"])

    if lowest is None:
        return Classifier(["all"])
    got = sorted(chosen.where(F.col("h") <= lowest).select("h", "domain", "text").mapInArrow(run, "h long, domain string, x binary").collect(), key=lambda r: (r.h, r.domain))
    domains = sorted({r.domain for r in got})
    x = np.stack([np.frombuffer(r.x, np.float32) for r in got])
    return Classifier(domains).fit(x, np.array([domains.index(r.domain) for r in got]))


def memberships(docs: DataFrame, model: Classifier, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, tokens (words), p (posteriors), lot (0 to 1, by hash) and the columns `keep`, as a struct if any, of every row of docs(doc_id, text)."""
    kept = [F.struct(*keep).alias("kept")] if keep else []
    lot = F.pmod(F.xxhash64(F.col("doc_id").cast("long"), "text", F.lit(17)), F.lit(1 << 20)) / float(1 << 20)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", lot.alias("lot"), *kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows(batches, 1 << 22):
            texts = strings(batch)
            p = model.posteriors(texts)
            n = [len(t.encode().split()) for t in texts]
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, p.size + 1, max(1, p.shape[1])), pa.int32()), pa.array(p.ravel()))
            cols = [batch.column(0), pa.array(n, pa.int64()), flat, *batch.columns[2:]]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "tokens", "p", *batch.schema.names[2:]])

    return own.mapInArrow(run, _with("doc_id long, tokens long, p array<double>, lot double", own))


def _with(names: str, table: DataFrame) -> str:
    return f"{names}, kept {table.schema['kept'].dataType.simpleString()}" if "kept" in table.columns else names


Step = tuple[np.ndarray, float]  # the change of a rate is -p @ step; and how much of its last change it goes on with before


def rates_of(p: np.ndarray, tokens: np.ndarray, steps: list[Step], least: float) -> np.ndarray:
    r = old = np.ones(len(p))
    for step, on in steps:
        ahead = r + on * (r - old) if on else r
        r, old = np.maximum(least, ahead - p @ step), r
    return np.where(tokens > 0, r, 1.0)


def _matrix(batch: pa.RecordBatch, wide: int) -> tuple[np.ndarray, np.ndarray]:
    p = batch.column(batch.schema.get_field_index("p")).flatten().to_numpy(zero_copy_only=False).reshape(-1, wide)
    return p, batch.column(batch.schema.get_field_index("tokens")).to_numpy(zero_copy_only=False)


def solve(table: DataFrame, wide: int, targets, least: float = 0.0, rounds: int = 400, close: float = 1e-6) -> list[Step]:
    """The steps that lead from rates of 1 to the least-squares rates; targets: the wanted totals from the present ones. They end where no
    total is off by more than the share `close` of all, or moves by more in three rounds; without an end in `rounds`, an error."""
    steps: list[Step] = []

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, gram = np.zeros(wide), np.zeros((wide, wide))
        for batch in batches:
            p, n = _matrix(batch, wide)
            total += (rates_of(p, n, steps, least) * n) @ p
            if not steps:
                gram += (p * n[:, None]).T @ p
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64())), pa.array([gram.ravel().tolist()], pa.list_(pa.float64()))], names=["total", "gram"])

    inverse = want = before = None
    loss, pace, calm = math.inf, 1.0, 0
    for _ in range(rounds):
        got = table.select("tokens", "p").mapInArrow(sums, "total array<double>, gram array<double>").collect()  # a row per partition
        total = np.sum([r.total for r in got], 0) if got else np.zeros(wide)
        if inverse is None:
            inverse = np.linalg.pinv(np.sum([r.gram for r in got], 0).reshape(wide, wide) if got else np.zeros((wide, wide)))
            want = np.asarray(targets(total), np.float64)
        now = float((total - want) @ inverse @ (total - want))
        if now > loss:
            pace = 1.0  # it went too far ahead
        least_move = close * max(1.0, float(np.abs(want).sum()))
        calm = calm + 1 if before is not None and np.abs(total - before).max() <= least_move else 0
        if np.abs(total - want).max() <= least_move or calm == 3:
            return steps
        after = (1 + math.sqrt(1 + 4 * pace * pace)) / 2
        on = (pace - 1) / after if before is not None else 0.0
        ahead = total + on * (total - before) if on else total
        steps.append((inverse @ (ahead - want), on))
        before, loss, pace = total, now, after
    raise RuntimeError(f"rates didn't settle in {rounds} rounds: totals {total.tolist()}, targets {want.tolist()}")


def equal_targets(total: np.ndarray) -> np.ndarray:
    """The same number of tokens from each domain, as many in all as there are."""
    return np.full(len(total), total.sum() / len(total))


def flattened_targets(total: np.ndarray, power: float = 0.7, growth: float = 1.05) -> np.ndarray:
    """Shares in proportion to a power of the present ones, with as many tokens as let the largest domain grow by `growth`: documents of
    other domains count a little toward it, so it can't stay as it is while they are repeated."""
    top = max(float(total.max()), 1.0)
    return growth * top * (np.maximum(total, 0) / top) ** power


RATES = "doc_id long, tokens long, domain string, posterior double, rate double, copies long"


def rates(docs: DataFrame, model: Classifier, targets=equal_targets, least: float = 0.0, keep: tuple[str, ...] = ()) -> DataFrame:
    """RATES of every row of docs(doc_id, text); domain is the likeliest one. The columns `keep`, if any, come along as the struct `kept`."""
    table = materialize(memberships(docs, model, keep), "mix")
    wide = len(model.domains)
    steps = solve(table, wide, targets, least)
    names = np.array(model.domains, object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p, n = _matrix(batch, wide)
            top = p.argmax(1)
            r = rates_of(p, n, steps, least)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names[top].tolist(), pa.string()), pa.array(p[np.arange(len(p)), top]), pa.array(r), *batch.columns[3:]], names=["doc_id", "tokens", "domain", "posterior", "rate", *batch.schema.names[3:]])

    out = table.mapInArrow(run, _with(RATES.rpartition(",")[0] + ", lot double", table))
    return out.withColumn("copies", F.floor(F.col("rate") + F.col("lot")).cast("long")).drop("lot")
