"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages. Every passage is encoded by what stands in it (kinds of bytes, sizes and variety of words, hashed byte
triples) and by how much of it stood in the document before; these features go through a learned layer to an embedding. Gated attention
weighs the embeddings of a bag, a = softmax(w . (tanh(V h) * sigmoid(U h))), and the weighted sum, the bag's representation, gives the
score by logistic regression. All weights are learned together, from document labels only, by full-batch Adam in numpy on a bounded sample
of labelled documents: `sample` of them at most by hash of the id, and of these, in that order, those that fit into `passages` passages
in all; each counts with its whole text. The model is a few thousand numbers, sent to the tasks that score whole texts.

A text without a word, or null, is one passage of zeros: it has a score like any other. Labels, lang, source and doc_id are no inputs of a
score. Without labelled rows of both classes there is nothing to learn, and the score is the share of label 1 (0.5 without any).
A null id has no label and is scored like others. Rows that repeat an id are each scored by their own text; a label counts for every row of
its id, and of several labels of one id the highest stands. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, rows, strings

WORDS = 64  # of a passage
_KINDS = np.zeros(256, np.int64)
for _b in range(256):
    _c = chr(_b)
    _KINDS[_b] = 9 if _b > 127 else 0 if _c.islower() else 1 if _c.isupper() else 2 if _c.isdigit() else 3 if _c in " \t\r\x0b\x0c" else 4 if _c == "\n" else 5 if _c in ".," else 6 if _c in "!?" else 7 if _c in "|/\\_-=+<>[]{}()" else 8
KINDS, GRAMS = 10, 64
FEATURES = 23 + GRAMS


def encode(text: str | None) -> np.ndarray:
    """Features of each passage, float32."""
    raw = (text or "").encode()
    words = raw.split()
    n = max(1, -(-len(words) // WORDS))
    out = np.zeros((n, FEATURES), np.float32)
    if not words:
        return out
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    of_word = np.arange(len(words)) // WORDS
    # the passage of each byte: words in order, and the white space after each
    a = np.frombuffer(raw, np.uint8)
    kinds = _KINDS[a]
    space = (kinds == 3) | (kinds == 4)
    begins = np.flatnonzero(~space & np.r_[True, space[:-1]])
    of_byte = np.zeros(len(a), np.int64)
    of_byte[begins[WORDS::WORDS]] = 1
    of_byte = np.cumsum(of_byte)
    hist = np.bincount(of_byte * KINDS + kinds, minlength=n * KINDS).reshape(n, KINDS)
    total = hist.sum(1, keepdims=True)
    out[:, :KINDS] = hist / np.maximum(total, 1)
    count = np.bincount(of_word, minlength=n)
    mean = np.bincount(of_word, sizes, n) / count
    out[:, 10] = mean / 16
    out[:, 11] = np.sqrt(np.maximum(np.bincount(of_word, sizes.astype(np.float64) ** 2, n) / count - mean**2, 0)) / 16
    out[:, 12] = np.bincount(of_word, sizes <= 3, n) / count
    out[:, 13] = np.bincount(of_word, sizes > 16, n) / count
    last = a[begins + sizes - 1]
    out[:, 14] = np.bincount(of_word, (_KINDS[last] >= 6) & (_KINDS[last] < 9), n) / count  # words that end in a sign
    first = a[begins]
    out[:, 15] = np.bincount(of_word, _KINDS[first] == 1, n) / count
    same = np.zeros(len(words), np.float64)
    same[1:] = [x == y for x, y in zip(words, words[1:], strict=False)]
    out[:, 16] = np.bincount(of_word, same, n) / count
    for i in range(n):
        own = words[i * WORDS : (i + 1) * WORDS]
        out[i, 17] = len(set(own)) / len(own)
        out[i, 18] = len(set(zip(own, own[1:], strict=False))) / max(1, len(own) - 1)
    out[:, 19] = count / WORDS
    out[:, 20] = np.bincount(of_word, sizes == 1, n) / count
    # how much stood in the document before: word pairs of earlier passages, and earlier lines
    before: set = set()
    for i in range(n):
        own = words[i * WORDS : (i + 1) * WORDS]
        pairs = set(zip(own, own[1:], strict=False))
        out[i, 21] = len(pairs & before) / max(1, len(pairs))
        before |= pairs
    again, lines = np.zeros(len(words)), set()
    at = 0
    for line in raw.split(b"\n"):
        m = len(line.split())
        if m and line in lines:
            again[at : at + m] = 1
        lines.add(line)
        at += m
    out[:, 22] = np.bincount(of_word, again, n) / count
    if len(a) > 2:
        low = a.astype(np.uint32)
        triple = ((low[:-2] << 16 | low[1:-1] << 8 | low[2:]) * np.uint32(2654435761)) >> np.uint32(32 - 6)
        hist = np.bincount(of_byte[:-2] * GRAMS + triple, minlength=n * GRAMS).reshape(n, GRAMS)
        out[:, 23:] = np.sqrt(hist / np.maximum(hist.sum(1, keepdims=True), 1))
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Model:
    """Parameters by name; bags are (features of all passages, bag of each passage, number of bags)."""

    def __init__(self, seed: int = 7, hidden: int = 24, gates: int = 12) -> None:
        g = np.random.default_rng(seed)
        start = lambda *s: (g.standard_normal(s) / np.sqrt(s[0])).astype(np.float64)
        self.p = {"E": start(FEATURES, hidden), "e": np.zeros(hidden), "V": start(hidden, gates), "U": start(hidden, gates), "w": start(gates), "c": start(hidden), "b": np.zeros(1)}
        self.mean, self.scale, self.share = np.zeros(FEATURES), np.ones(FEATURES), 0.5
        self.learned = False

    def forward(self, x: np.ndarray, bag: np.ndarray, n: int) -> tuple[np.ndarray, dict]:
        p = self.p
        h = np.tanh((x @ p["E"].astype(x.dtype)).astype(np.float64) + p["e"])
        t, s = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        logit = (t * s) @ p["w"]
        starts = np.flatnonzero(np.r_[True, np.diff(bag) > 0])  # each bag has a passage at least
        weight = np.exp(logit - np.maximum.reduceat(logit, starts)[bag])
        weight /= np.bincount(bag, weight, n)[bag]
        z = np.add.reduceat(weight[:, None] * h, starts, axis=0)
        return _sigmoid(z @ p["c"] + p["b"]), {"h": h, "t": t, "s": s, "a": weight, "z": z}

    def gradients(self, x: np.ndarray, bag: np.ndarray, y: np.ndarray, weight: np.ndarray, decay: float) -> dict[str, np.ndarray]:
        p, n = self.p, len(y)
        score, k = self.forward(x, bag, n)
        d = weight * (score - y) / weight.sum()
        g = {"c": k["z"].T @ d, "b": np.array([d.sum()])}
        dz = d[:, None] * p["c"]
        da = (k["h"] * dz[bag]).sum(1)
        dl = k["a"] * (da - np.bincount(bag, k["a"] * da, n)[bag])
        dh = k["a"][:, None] * dz[bag]
        ts = k["t"] * k["s"]
        g["w"] = ts.T @ dl
        dts = dl[:, None] * p["w"]
        dt, ds = dts * k["s"] * (1 - k["t"] ** 2), dts * k["t"] * k["s"] * (1 - k["s"])
        g["V"], g["U"] = k["h"].T @ dt, k["h"].T @ ds
        dh += dt @ p["V"].T + ds @ p["U"].T
        dh *= 1 - k["h"] ** 2
        g["E"], g["e"] = x.T @ dh.astype(x.dtype), dh.sum(0)
        return {name: v + decay * p[name] for name, v in g.items()}

    def fit(self, bags: list[np.ndarray], labels: list[int], steps: int = 300, rate: float = 0.02, decay: float = 1e-5) -> Model:
        y = np.array(labels, np.float64)
        self.share = float(y.mean()) if len(y) else 0.5
        if not len(y) or not 0 < self.share < 1:
            return self
        x = np.concatenate(bags).astype(np.float32)
        bag = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-3
        x = np.clip((x - self.mean) / self.scale, -8, 8)
        weight = np.where(y > 0, 0.5 / self.share, 0.5 / (1 - self.share))
        m, v = ({k: np.zeros_like(a) for k, a in self.p.items()} for _ in range(2))
        for i in range(1, steps + 1):
            step = rate * 0.5 * (1 + np.cos(np.pi * i / steps))
            for k, g in self.gradients(x, bag, y, weight, decay).items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                self.p[k] = self.p[k] - step * (m[k] / (1 - 0.9**i)) / (np.sqrt(v[k] / (1 - 0.999**i)) + 1e-8)
        self.learned = True
        return self

    def score(self, bags: list[np.ndarray]) -> np.ndarray:
        if not self.learned or not bags:
            return np.full(len(bags), self.share)
        bag = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
        return self.forward(np.clip((np.concatenate(bags) - self.mean) / self.scale, -8, 8), bag, len(bags))[0]


def learn(docs: DataFrame, labels: DataFrame, sample: int = 5000, passages: int = 100_000) -> Model:
    """A model of labels(doc_id, quality) over docs(doc_id, text); bounded by sample and passages."""
    chosen = (
        labels.where("doc_id is not null and quality is not null")
        .groupBy("doc_id")
        .agg(F.max("quality").cast("int").alias("quality"))
        .orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id")
        .limit(sample)
    )
    picked = [(r.doc_id, r.quality, at) for at, r in enumerate(chosen.collect())]  # `sample` rows at most
    chosen = docs.sparkSession.createDataFrame(picked, "label_id long, quality int, turn int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows(batches, 1 << 22):
            x = [encode(t) for t in strings(batch)]
            cols = [batch.column(0), batch.column(2), pa.array(map(len, x), pa.int64()), pa.array([v.tobytes() for v in x], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["turn", "quality", "n", "x"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id"))
    encoded = materialize(own.select("turn", "text", "quality").mapInArrow(run, "turn int, quality int, n long, x binary"), "bags")
    sizes = sorted((r.turn, r.n) for r in encoded.groupBy("turn").agg(F.sum("n").alias("n")).collect())
    fits, total = [], 0
    for turn, n in sizes:
        if total + n <= passages:
            fits.append(turn)
            total += n
    got = encoded.where(F.col("turn").isin(fits)).collect()
    got.sort(key=lambda r: (r.turn, bytes(r.x)))
    return Model().fit([np.frombuffer(r.x, np.float32).reshape(-1, FEATURES) for r in got], [r.quality for r in got])


def scores(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep`, and score, of every row of docs(text)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kinds = dict(docs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows(batches, 1 << 22, "_text"):
            score = sent.value.score([encode(t) for t in strings(batch, "_text")])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(score)], names=[*keep, "score"])

    return docs.select(*keep, F.col("text").alias("_text")).mapInArrow(run, ", ".join(f"`{k}` {kinds[k]}" for k in keep) + ", score double")
