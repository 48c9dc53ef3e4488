"""Vector bin packing of tokenised documents into training sequences.

A sequence has three limits at once: tokens, segments (pieces of documents) and loss-bearing tokens. Each document is
cut into full sequences and a remainder. The remainders of a slot (a hash bucket of some thousand pieces, so that the
work is parallel and no task grows with the input; equal pieces are spread over the slots) are placed by the dot-product heuristic: of the pieces that fit the
open sequence, the one whose demand vector has the largest dot product with the room left goes in. Sequences that stay
poorly filled are then taken apart, and their pieces, cut where needed, fill the gaps of the others.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradlens.llm._common import freed, table

#: GPT-2's published pre-tokenisation pattern, which the byte-level vocabularies go with (fixed value).
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@dataclass(frozen=True)
class Limits:
    tokens: int = 1024
    segments: int = 1024
    loss_tokens: int = 1024
    #: No cut leaves a piece shorter than this, and gaps below it stay.
    least_piece: int = 16
    #: Pieces in a slot, about.
    slot_pieces: int = 4096


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Ids of a text as little-endian uint32 bytes.

    They are those of tokenizers with add_special_tokens=False: no token is added, and an added token's string in a text
    is that token. A byte-level BPE whose ids are the ranks of its merges is run by tiktoken, which gives the same ids
    several times faster; any other vocabulary, and texts that hold an added token's string, are run by tokenizers itself.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        added = [t.content for t in self.model.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.wide = self.model.get_vocab_size() > 65536
        ranks = byte_ranks(path)
        self.fast = None
        if ranks:
            import tiktoken

            self.fast = tiktoken.Encoding("ranks", pat_str=PRE_TOKENS, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> bytes:
        if self.fast is not None and not (self.added and self.added.search(text)):
            return np.array(self.fast.encode_ordinary(text), "<u4").tobytes()
        return np.array(self.model.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def byte_ranks(path: str) -> dict[bytes, int] | None:
    """The vocabulary by bytes, if it is a byte-level BPE with the common pattern and each merge makes the id 256 + its number."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, before = spec.get("model", {}), spec.get("pre_tokenizer") or {}
    if model.get("type") != "BPE" or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True) or spec.get("normalizer") or model.get("ignore_merges"):
        return None
    # Byte-level vocabularies write printable Latin-1 bytes as themselves and the others as code points from 256 on.
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    vocab, special = model["vocab"], {t["content"] for t in spec.get("added_tokens", [])}
    merges = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
    if any(vocab.get(m) != 256 + i for i, m in enumerate(merges)) or len(vocab) - len(special & set(vocab)) != 256 + len(merges):
        return None
    return {bytes(byte_of[c] for c in t): i for t, i in vocab.items() if t not in special}


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def place(tokens: np.ndarray, loss: np.ndarray, limits: Limits) -> list[list[int]]:
    """Sequences as lists of item numbers. Items that are alike in both sizes are one kind, so a step costs O(kinds)."""
    kinds, member = np.unique(np.stack([tokens, loss], 1), axis=0, return_inverse=True)
    queues: list[list[int]] = [[] for _ in kinds]
    for i, k in enumerate(member.ravel()):
        queues[k].append(i)
    left = np.array([len(q) for q in queues])
    most = np.array([limits.tokens, limits.segments, limits.loss_tokens], float)
    demand = np.column_stack([kinds[:, 0], np.ones(len(kinds), np.int64), kinds[:, 1]])
    share = demand / most
    out = []
    while left.any():
        room, seq = most.astype(np.int64), []
        while True:
            fits = (left > 0) & (demand <= room).all(1)
            if not fits.any():
                break
            k = int(np.where(fits, share @ (room / most), -1.0).argmax())
            seq.append(queues[k].pop())
            left[k] -= 1
            room = room - demand[k]
        if not seq:
            raise ValueError("an item exceeds the limits")
        out.append(seq)
    return out


def _loss(start: int, length: int, loss_from: int, n: int) -> int:
    """Loss-bearing tokens of a piece: those from loss_from on, without the separator at the document's end."""
    return max(0, min(start + length, n - 1) - max(start, loss_from))


def fill_gaps(seqs: list[list[list[int]]], loss_of, limits: Limits) -> list[list[list[int]]]:
    """Takes the poorest sequences apart; their pieces [item, start, end], cut where needed, go into the gaps of the fullest."""
    size = lambda s: sum(p[2] - p[1] for p in s)
    seqs = sorted((list(map(list, s)) for s in seqs), key=size, reverse=True)
    i, j = 0, len(seqs) - 1
    while i < j:
        into, give = seqs[i], seqs[j]
        room = limits.tokens - size(into)
        if room < limits.least_piece or len(into) >= limits.segments:
            i += 1
            continue
        item, a, b = give[-1]
        n = min(room, b - a)
        if 0 < b - a - n < limits.least_piece:
            n = b - a - limits.least_piece
        used = sum(loss_of(*p) for p in into)
        if n < min(limits.least_piece, b - a) or n <= 0 or used + loss_of(item, a, a + n) > limits.loss_tokens:
            i += 1
            continue
        into.append([item, a, a + n])
        if a + n == b:
            give.pop()
            j -= not give
        else:
            give[-1][1] = a + n
    return [s for s in seqs if s]


def _cut_documents(docs: DataFrame, path: str, limits: Limits) -> DataFrame:
    """Pieces: full sequences without their ids, and the remainder with them (16 bits an id where the vocabulary allows).

    copy tells equal pieces apart: which one of its partition it is, and the partition. It depends on no order of rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        part_no, seen, epoch = TaskContext.get().partitionId(), {}, 0
        step = min(limits.tokens, limits.loss_tokens)
        for batch in batches:
            rows: list[tuple] = []
            for doc, text, loss_from in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                raw = enc.ids(text) + b"\0\0\0\0" if text else b"\0\0\0\0"
                n = len(raw) // 4
                for a in range(0, n, step):
                    part = raw[4 * a : 4 * (a + step)]
                    full = len(part) == 4 * limits.tokens
                    ids = None if full else part if enc.wide else np.frombuffer(part, "<u4").astype("<u2").tobytes()
                    crc = zlib.crc32(part)
                    key = hash((doc, a, crc))
                    seen[key] = again = seen.get(key, -1) + 1
                    rows.append((doc, a, len(part) // 4, crc, n, loss_from, ids, (epoch << 32) + again, part_no))
                if len(seen) > 1_000_000:
                    seen, epoch = {}, epoch + 1
            kinds = (*(pa.int64(),) * 6, pa.binary(), pa.int64(), pa.int64())
            cols = list(zip(*rows)) or [[]] * 9
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "loss_from", "ids", "copy", "part"])

    return docs.mapInArrow(freed(run), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, loss_from long, ids binary, copy long, part long")


_PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, limits: Limits = Limits(), loss_from_col: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, loss_tokens.

    Every document ends with id 0. Null and empty texts are that id alone. Repeated rows and rows without an id are
    packed like any other row. Empty table: no rows. loss_from_col: index of the first loss-bearing token of an
    example (null: 0). vocabulary: a path that the executors can read. Other columns of docs are not read. Only the
    remainders' ids (under a kilotoken a document) and numbers of the pieces are shuffled.
    """
    path = vocabulary or default_vocabulary()
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), (F.coalesce(F.col(loss_from_col).cast("long"), F.lit(0)) if loss_from_col else F.lit(0)).cast("long").alias("loss_from"))
    # A document makes one remainder, and one more piece for about every four bytes times the limit.
    size = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(F.col(text_col).cast("string")).cast("long")).alias("b")).head()
    slots = max(1, -(-(size["n"] + (size["b"] or 0) // (4 * limits.tokens)) // limits.slot_pieces))
    pieces = _cut_documents(narrow, path, limits).withColumn("slot", F.expr(f"pmod(xxhash64(doc_id, start, ids_crc32, copy, part), {slots}L)"))

    def run(part: pa.Table) -> pa.Table:
        slot = part.column("slot")[0].as_py()
        rows = sorted(zip(*(part.column(c).to_pylist() for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "loss_from", "ids"))), key=lambda r: (r[0] is None, r[0] or 0, r[1], r[3]))
        rest = [i for i, r in enumerate(rows) if r[6] is not None]
        loss_of = lambda i, a, b: _loss(rows[i][1] + a, b - a, rows[i][5], rows[i][4])
        seqs = [[[i, 0, r[2]]] for i, r in enumerate(rows) if r[6] is None]
        if rest:
            placed = place(np.array([rows[i][2] for i in rest]), np.array([loss_of(i, 0, rows[i][2]) for i in rest]), limits)
            seqs += fill_gaps([[[rest[k], 0, rows[rest[k]][2]] for k in s] for s in placed], loss_of, limits)
        out = []
        for number, s in enumerate(seqs):
            at = 0
            for i, a, b in s:
                doc, start, length, crc, n, _, ids = rows[i]
                if b - a != length:
                    width = len(ids) // length
                    crc = zlib.crc32(np.frombuffer(ids[width * a : width * b], f"<u{width}").astype("<u4").tobytes())
                out.append((doc, start + a, b - a, crc, n, slot + slots * number, at, loss_of(i, a, b)))
                at += b - a
        names = [x.split()[0] for x in _PACKED.split(", ")]
        return pa.table([pa.array(c, pa.int64()) for c in zip(*out)], names=names)

    return pieces.groupBy("slot").applyInArrow(freed(run), _PACKED)


def op1_vector_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
