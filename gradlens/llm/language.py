"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1. An n-gram of letters is bound into one vector: the letters' vectors,
each permuted (rotated) once for every letter that follows, are multiplied. A document or a language is the bundle (sum)
of its n-grams' vectors, and a document gets the language whose prototype has the largest cosine with it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradlens.llm._common import slices, table

DIM = 1024
GRAM = 3
#: Letters are told apart by their code point modulo this; 0 stands for what is between words.
ALPHABET = 509
SEED = 20240229
#: Distinct n-grams that a partition counts before it bundles them.
HELD = 200_000
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Index of each code point: 0 where it is no letter."""
    out = np.zeros(0x110000, np.int32)
    for cp in range(0x110000):
        if chr(cp).isalpha():
            out[cp] = 1 + cp % ALPHABET
    return out


@lru_cache(maxsize=1)
def _vectors() -> np.ndarray:
    """(GRAM, ALPHABET + 1, DIM): the letters' vectors, rotated 0, 1, .. times."""
    base = np.random.default_rng(SEED).integers(0, 2, (ALPHABET + 1, DIM), dtype=np.int8) * 2 - 1
    return np.stack([np.roll(base, k, 1) for k in range(GRAM)])


def gram_vectors(codes: np.ndarray) -> np.ndarray:
    """Bound vectors (as float32) of n-gram codes, the last letter in the lowest digit."""
    v, out, rest = _vectors(), None, codes
    for k in range(GRAM):
        rest, digit = np.divmod(rest, ALPHABET + 1)
        out = v[k][digit] if out is None else out * v[k][digit]
    return out.astype(np.float32)


def grams(text: str) -> np.ndarray:
    """Codes of the letter n-grams of a text, lower-cased, runs of anything else as one gap. No letters: none."""
    idx = _letters()[np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), np.uint32)]
    idx = idx[(idx > 0) | np.append(True, idx[:-1] > 0)]
    if not idx.any():
        return np.empty(0, np.int64)
    if idx[-1]:
        idx = np.append(idx, 0)
    idx = idx.astype(np.int64)
    code = np.zeros(max(0, len(idx) - GRAM + 1), np.int64)
    for k in range(GRAM):
        code = code * (ALPHABET + 1) + idx[k : len(idx) - GRAM + 1 + k]
    return code


def _bundles(texts: list[str]) -> np.ndarray:
    """The documents' vectors (rows), made from the n-grams that the slice has, in blocks of columns."""
    found = [np.unique(grams(t), return_counts=True) for t in texts]
    every = np.unique(np.concatenate([f[0] for f in found])) if found else np.empty(0, np.int64)
    out = np.zeros((len(texts), DIM), np.float32)
    for at in range(0, len(every), 4096):
        block = every[at : at + 4096]
        counts = np.zeros((len(texts), len(block)), np.float32)
        for i, (code, n) in enumerate(found):
            a, b = np.searchsorted(code, block[0]), np.searchsorted(code, block[-1], "right")
            counts[i, np.searchsorted(block, code[a:b])] = n[a:b]
        out += counts @ gram_vectors(block)
    return out


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict[str, np.ndarray]:
    """Prototypes by language. Rows without language or letters add nothing.

    Each partition bundles its rows by language; what meets are len(languages) vectors a partition, summed by Spark per
    language and coordinate, and the driver gets len(languages) x DIM sums, whatever the number of rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, dict[int, int]] = {}
        totals: dict[str, np.ndarray] = {}

        def bundle(lang: str) -> None:
            own = sums.pop(lang)
            codes, n = np.array(list(own), np.int64), np.array(list(own.values()), np.float32)
            total = totals.setdefault(lang, np.zeros(DIM))
            for at in range(0, len(codes), 8192):
                total += n[at : at + 8192] @ gram_vectors(codes[at : at + 8192])

        for batch in batches:
            by: dict[str, list[str]] = {}
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if text and lang is not None:
                    by.setdefault(lang, []).append(text)
            for lang, texts in by.items():
                for a, b in slices([len(t) for t in texts], 1_000_000):
                    codes, n = np.unique(np.concatenate([grams(t) for t in texts[a:b]]), return_counts=True)
                    own = sums.setdefault(lang, {})
                    for c, k in zip(codes.tolist(), n.tolist()):
                        own[c] = own.get(c, 0) + k
                    if len(own) > HELD:
                        bundle(lang)
        for lang in list(sums):
            bundle(lang)
        for lang, total in totals.items():
            yield pa.record_batch([pa.array([lang]), pa.array([total.tolist()], pa.list_(pa.float64()))], names=["lang", "v"])

    parts = docs.selectExpr(f"cast(`{text_col}` as string) text", f"cast(`{lang_col}` as string) lang").mapInArrow(run, "lang string, v array<double>")
    rows = parts.select("lang", F.posexplode("v").alias("at", "x")).groupBy("lang", "at").agg(F.sum("x").alias("x")).collect()
    out: dict[str, np.ndarray] = {}
    for r in rows:
        out.setdefault(r["lang"], np.zeros(DIM))[r["at"]] = r["x"]
    return {k: out[k] for k in sorted(out)}


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score (cosine, 0 to 1). Null texts and texts without letters, or no prototypes at all: und, 0.

    Ties go to the language that sorts first. Repeated rows and null ids give a row each; other columns are not read.
    Map-only; the prototypes travel with the task (languages x DIM numbers).
    """
    names = list(prototypes)
    unit = np.array([prototypes[k] / (np.linalg.norm(prototypes[k]) or 1) for k in names], np.float32).reshape(len(names), DIM)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            pred, score = [], []
            for a, b in slices([len(t) for t in texts], 500_000):
                v = _bundles(texts[a:b])
                norm = np.linalg.norm(v, axis=1)
                cos = (v @ unit.T) / np.where(norm > 0, norm, 1)[:, None] if names else np.zeros((b - a, 1))
                for k, c, n in zip(cos.argmax(1), cos.max(1), norm):
                    pred.append(names[k] if names and n > 0 else UNKNOWN)
                    score.append(float(min(1.0, max(0.0, c))) if names and n > 0 else 0.0)
            yield pa.record_batch([batch.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"cast(`{text_col}` as string) text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def fold(column: str, of: int):
    """crc32 of the id as text modulo `of`; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % of


def op7_hyperdimensional_language(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    profiles = fit(docs.filter((fold("doc_id", 4) != 2) & F.col("lang").isNotNull()))
    return predict(docs, profiles).select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")
