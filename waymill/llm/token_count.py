"""Token counts by the whole-token shortcut.

Text is normalised and cut into pre-tokens as the tokenizer file says (NFC, white space folded, lower case; contractions, runs of letters,
single digits, runs of other signs). Once per worker, the vocabulary is put through the library to prove which of its whole-word strings
encode, alone, as exactly one token: those pre-tokens count 1 by a dictionary hit. Every other pre-token is merged by the library once per
batch and remembered within a bounded table. Texts that hold the string of a special token go through the library whole, as it cuts those out
before anything else.

Null text counts as empty: 0 tokens.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import rows, strings

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
REMEMBER = 400_000  # merged pre-tokens kept per worker


class Counter:
    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec["added_tokens"]]
        # the kinds of normaliser and pre-tokenizer whose cuts are known here; anything else goes through the library whole
        norm = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        cut = [p for p in (spec.get("pre_tokenizer") or {}).get("pretokenizers", []) if p["type"] == "Split"]
        self.known = norm == ["NFC", "Replace", "Lowercase"] and len(cut) == 1 and cut[0]["behavior"] == "Removed" and cut[0]["invert"]
        if self.known:
            self.cut = regex.compile(cut[0]["pattern"]["Regex"])
            self.whole = self.proved(spec["model"]["vocab"], spec["model"].get("end_of_word_suffix") or "")
            self.merged: dict[str, int] = {}

    def proved(self, vocab: dict[str, int], end: str) -> dict[str, int]:
        """The pre-tokens that encode alone as one token, each shown by the library."""
        spell = {c: b for b, c in byte_letters().items()}
        words = []
        for token in vocab:
            if token.endswith(end) and (body := token[: len(token) - len(end)]) and all(c in spell for c in body):
                try:
                    word = bytes(spell[c] for c in body).decode()
                except UnicodeDecodeError:
                    continue
                if self.normal(word) == word and self.cut.findall(word) == [word]:
                    words.append(word)
        return {w: 1 for w, e in zip(words, self.library.encode_batch_fast(words, add_special_tokens=False), strict=True) if len(e) == 1}

    @staticmethod
    def normal(text: str) -> str:
        """White space needs no folding here: the cut drops all of it. Lower case goes by code point, as the library does it."""
        if text.isascii():
            return text.lower()
        text = unicodedata.normalize("NFC", text)
        return text.lower() if "Σ" not in text else "".join(map(str.lower, text))  # else a final capital sigma becomes another letter

    def count(self, texts: list[str]) -> list[int]:
        if not self.known:
            return [len(e) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        if len(self.merged) > REMEMBER:
            self.merged.clear()
        whole, merged, cuts = self.whole, self.merged, []
        for text in texts:
            cuts.append(None if any(s in text for s in self.special) else self.cut.findall(self.normal(text)))
        rest = list({t for c in cuts if c is not None for t in c if t not in whole and t not in merged})
        merged |= zip(rest, map(len, self.library.encode_batch_fast(rest, add_special_tokens=False)), strict=True)
        return [len(self.library.encode(t, add_special_tokens=False)) if c is None else sum(1 if x in whole else merged[x] for x in c) for t, c in zip(texts, cuts, strict=True)]


def byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies write for each byte: itself where printable, else the next free one from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


@lru_cache(2)
def counter(path: str) -> Counter:
    return Counter(path)


def token_counts(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """SCHEMA for every row of docs(doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for batch in rows(batches, 1 << 22):
            texts = strings(batch)
            n = c.count(texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select(docs.doc_id.cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)
