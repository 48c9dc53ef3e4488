"""SentencePiece encoding by an Aho-Corasick automaton and a single-pass Viterbi, and decoding.

The automaton holds every piece of the vocabulary. Reading a text once, at each position it gives the pieces that end
there, longest first and then along its output links; each relaxes the best score of the prefix that ends there. The
result is the segmentation with the largest sum of piece scores (ties: the longer last piece). Characters outside the
vocabulary become byte pieces. No piece goes on after a word's end, so words are independent and remembered.

The vocabulary's own trainer may have meant its scores for merging in their order; the segmentation here is the best
one by score, which that order need not give.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gradlens.llm._common import table

SPACE = "▁"
REMEMBER = 300_000


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def load_pieces(path: str) -> tuple[list[tuple[str, float]], list[int], set[int]]:
    """(piece, score) by id; ids of the 256 byte pieces; ids that never stand for text."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    pieces = [(sp.id_to_piece(i), sp.get_score(i)) for i in range(n)]
    byte_ids = sorted((int(pieces[i][0][3:5], 16), i) for i in range(n) if sp.is_byte(i))
    return pieces, [i for _, i in byte_ids], {i for i in range(n) if sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)}


class Codec(dict):
    """Encoder and decoder; as a dict it remembers words: word -> (ids as bytes, score, byte pieces)."""

    def __init__(self, pieces: list[tuple[str, float]], byte_ids: list[int], apart: set[int]) -> None:
        import ahocorasick

        super().__init__()
        self.pieces, self.byte_ids = pieces, byte_ids
        self.auto = ahocorasick.Automaton()
        self.known: set[str] = set()
        crossing = newline = False
        for i, (p, s) in enumerate(pieces):
            if i not in apart and p:
                self.auto.add_word(p, (len(p), s, i))
                crossing |= SPACE in p.lstrip(SPACE)
                newline |= "\n" in p
                if len(p) == 1:
                    self.known.add(p)
        self.auto.make_automaton()
        self.surface = [p.replace(SPACE, " ").encode() for p, _ in pieces]
        for i in apart:
            self.surface[i] = b""
        for b, i in enumerate(byte_ids):
            self.surface[i] = bytes([b])
        # A cut before each word is safe only if no piece goes across it.
        self.split = re.compile("(?s).+" if crossing else f"{SPACE}*[^{SPACE}]+|{SPACE}+" if newline else f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+").findall

    @classmethod
    def load(cls, path: str) -> Codec:
        return cls(*load_pieces(path))

    def best(self, run: str) -> tuple[list[int], float]:
        """Viterbi over a run of known characters."""
        n = len(run)
        score, came = [0.0] + [float("-inf")] * n, [None] * (n + 1)
        for end, (size, s, i) in self.auto.iter(run):
            total = score[end + 1 - size] + s
            if total > score[end + 1]:
                score[end + 1], came[end + 1] = total, (size, i)
        ids, at = [], n
        while at:
            size, i = came[at]
            ids.append(i)
            at -= size
        return ids[::-1], score[n]

    def __missing__(self, word: str) -> tuple[bytes, float, int]:
        ids, total, n_bytes, run = [], 0.0, 0, []
        whole = self.known.issuperset(word)
        if whole:
            ids, total = self.best(word)
        for c in () if whole else (*word, None):
            if c in self.known:
                run.append(c)
                continue
            if run:
                got, s = self.best("".join(run))
                ids += got
                total += s
                run = []
            if c is not None:
                raw = c.encode("utf-8", "replace")
                ids += [self.byte_ids[b] for b in raw]
                n_bytes += len(raw)
        out = np.array(ids, "<u4").tobytes(), total, n_bytes
        if len(self) >= REMEMBER:
            self.clear()
        if len(word) <= 64:
            self[word] = out
        return out

    def encode(self, text: str) -> tuple[bytes, float, int]:
        """Ids (little-endian uint32), sum of scores, byte pieces. A text gets one space in front, as the model was made with."""
        if not text:
            return b"", 0.0, 0
        got = [self[w] for w in self.split(SPACE + text.replace(" ", SPACE))]
        return b"".join([g[0] for g in got]), sum(g[1] for g in got), sum(g[2] for g in got)

    def decode(self, ids: bytes) -> str:
        """The text; exact for every text without U+2581, which stands for a space."""
        out = b"".join(map(self.surface.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")
        return out[1:] if out[:1] == " " else out


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec.load(path)
    return _codecs[path]


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None, keep_ids: bool = True) -> DataFrame:
    """doc_id, ids (binary, if keep_ids), n_ids, ids_crc32, n_bytes_pieces, score, decoded (text, if keep_ids), exact.

    Null and empty texts: no ids, score 0, exact (decoded: empty). Repeated rows and null ids give a row each; other
    columns are not read. exact: decoding gives the text again. Map-only.
    """
    path = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            ids, n, crc, nb, score, back, exact = [], [], [], [], [], [], []
            for text in batch.column(1).to_pylist():
                text = text or ""
                raw, s, b = c.encode(text)
                again = c.decode(raw)
                for column, x in zip((ids, n, crc, nb, score, back, exact), (raw, len(raw) // 4, zlib.crc32(raw), b, s, again, again == text)):
                    column.append(x)
            cols = [batch.column(0), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(nb, pa.int64()), pa.array(score, pa.float64()), pa.array(exact, pa.bool_())]
            names = ["doc_id", "n_ids", "ids_crc32", "n_byte_pieces", "score", "exact"]
            if keep_ids:
                cols, names = [*cols, pa.array(ids, pa.binary()), pa.array(back, pa.string())], [*names, "ids", "decoded"]
            yield pa.record_batch(cols, names=names)

    ddl = "doc_id long, n_ids long, ids_crc32 long, n_byte_pieces long, score double, exact boolean" + ", ids binary, decoded string" * keep_ids
    return docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"cast(`{text_col}` as string) text").mapInArrow(run, ddl)


def op10_piece_viterbi(spark, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), keep_ids=False)
