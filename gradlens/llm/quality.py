"""Quality rules by compression bands.

zstandard ratios (bytes before / after) of the whole document and of fixed chunks. A repetitive text compresses too
well, random characters hardly at all; what is usual depends on the length, since a short text gives the compressor
little to refer back to, so the limits are looked up by length.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from gradlens.llm._common import freed, table, text_bytes


@dataclass(frozen=True)
class Band:
    """Limits of the ratio for texts of fewer than `below` bytes."""

    below: float
    least: float
    most: float


#: Whole documents, by bytes. Prose in European languages lies well inside; the limits leave about a fifth on either side.
DOCUMENT_BANDS = (Band(128, 0.40, 2.6), Band(512, 0.90, 2.8), Band(2048, 1.20, 2.9), Band(8192, 1.45, 3.1), Band(32768, 1.60, 3.4), Band(float("inf"), 1.70, 3.9))
#: Chunks of CHUNK bytes (the last one may be shorter).
CHUNK_BANDS = (Band(128, 0.35, 3.2), Band(512, 0.80, 3.4), Band(2048, 1.05, 3.6), Band(float("inf"), 1.25, 3.8))
CHUNK = 4096
#: A text fails if more than this share of its bytes lies in chunks outside their band.
BAD_SHARE = 0.34
LEVEL = 3

_SYMBOLS = b"#*$%&|<>"
FIELDS = (("doc_id", pa.int64()), ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("ratio", pa.float64()), ("bad_chunk_share", pa.float64()))
_DDL = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double, bad_chunk_share double"


def band_of(bands: tuple[Band, ...], size: int) -> Band:
    return next(b for b in bands if size < b.below)


def repeat_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found twice or more, the first one included."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    times = Counter(windows)
    n = end = 0
    for i, w in enumerate(windows):
        if times[w] > 1:
            n += i + 3 - max(i, end)
            end = i + 3
    return n


def measure(raw: bytes) -> tuple[int, int, int, int, int, bool]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed of a text in UTF-8.

    bytes.split() and bytes.strip() know just the six ASCII spaces, which are what separates words here.
    """
    words = raw.split()
    inside = b"".join(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    rep = repeat_words(words)
    n = len(words)
    chars = len(inside.decode("utf-8", "replace"))
    return n, chars, len(raw) - len(raw.translate(None, _SYMBOLS)), len(lines) - len(set(lines)), rep, n < 50 or 100 * rep > 50 * n


def bands(raw: bytes, squeeze: zstandard.ZstdCompressor) -> tuple[float, float, bool]:
    """Ratio of the whole text, share of its bytes in chunks outside their band, and whether it passes. Empty: 0, 0, False."""
    if not raw:
        return 0.0, 0.0, False
    whole = len(raw) / len(squeeze.compress(raw))
    band = band_of(DOCUMENT_BANDS, len(raw))
    bad = 0
    for at in range(0, len(raw), CHUNK):
        part = raw[at : at + CHUNK]
        limits = band_of(CHUNK_BANDS, len(part))
        ratio = whole if len(part) == len(raw) else len(part) / len(squeeze.compress(part))
        bad += len(part) * (not limits.least <= ratio <= limits.most)
    share = bad / len(raw)
    return whole, share, band.least <= whole <= band.most and share <= BAD_SHARE


def _judged(batch: pa.RecordBatch, text_col: str) -> list[tuple]:
    squeeze = zstandard.ZstdCompressor(level=LEVEL)
    out = []
    for raw in text_bytes(batch.column(text_col)):
        base = measure(raw)
        ratio, share, fits = bands(raw, squeeze)
        out.append((*base, not base[-1] and fits, ratio, share))
    return out


def score_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts, base_failed, kept, ratio, bad_chunk_share.

    Null and empty texts have no words: base_failed, not kept. Repeated rows and null ids give a row each. Other
    columns of docs are not read. Map-only: no shuffle, each text whole, one batch in memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = list(zip(*_judged(batch, "text"))) or [[]] * 9
            yield pa.record_batch([batch.column("doc_id").cast(pa.int64()), *(pa.array(c, kind) for c, (_, kind) in zip(cols, FIELDS[1:]))], names=[n for n, _ in FIELDS])

    return docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"`{text_col}` text").mapInArrow(freed(run), f"doc_id long, {_DDL}")


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs, all their columns as they were, whose text is kept by score_quality. One pass without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([r[6] for r in _judged(batch, text_col)], pa.bool_()))

    return docs.mapInArrow(freed(run), docs.schema)


def op2_compression_bands(spark, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"))
