"""Removal of repeated passages: bytes covered by a string of WIDTH bytes that also starts earlier in the corpus.

1. Exact copies of a text but the first are settled by their digest: all of their strings start earlier.
2. In every run of WIDTH - GRAM + 1 neighbouring GRAM-grams the one with the smallest hash is the anchor of the
   WIDTH-byte string they make up. Equal strings have equal anchors, so strings whose anchor is unique are unique. Hashes
   of anchors are counted by bucket, and each block of documents learns which of its anchors repeat.
3. Neighbouring strings with one anchor make a phrase (prefix-free parsing: the phrases, with the overlap that their
   strings need). Phrases with a repeated anchor meet by anchor; equal ones collapse to one dictionary phrase.
   An anchor with more than HOT occurrences would bring an unbounded group to one task: its strings go one by one
   instead, by their own hashes, so that only equal ones meet.
4. Over the dictionary phrases a run-length index is built (rindex.RunIndex): its matching statistics are
   streamed, and positions that match WIDTH bytes of an earlier occurrence are marked (rindex.repeated). The phrases of
   an anchor that has more than GROUP_BYTES of them are compared string by string, in slices.
5. The marked ranges go back to the blocks, where they are joined and cut out.

Documents are dealt to blocks of BLOCK_BYTES by a hash of id and text, once; steps 2, 3 and 5 read the same exchange.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradlens.llm._common import freed, mix64, slices, table, text_bytes
from gradlens.llm.rindex import RunIndex, repeated

WIDTH = 100
GRAM = 32
#: Occurrences from which on an anchor's strings are dealt one by one.
HOT = 200_000
#: Bytes of text in a block of documents, about; anchors and phrases are dealt to as many buckets.
BLOCK_BYTES = 4_000_000
#: Bytes of dictionary phrases in one index.
INDEX_BYTES = 700_000
#: Bytes of one anchor's dictionary phrases from which on their strings are compared one by one, in slices: an index of
#: them would not fit beside the rest.
GROUP_BYTES = 1_500_000
#: Longest stretch of a document that is looked at as one array; longer ones are cut with an overlap.
STRETCH = 8_000_000
#: Bytes of documents whose hashes are in memory at once.
SLICE = 1_000_000
_POS_BITS = 24
_B = 0xD1342543DE82EF95
_BINV = pow(_B, -1, 2**64)
_TABLE = np.random.default_rng(97).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_NO_ID = -(2**63)
_REC = np.dtype([("doc", "<i8"), ("tid", "<i8"), ("a", "<i8"), ("b", "<i8")])


def text_id(raw: bytes) -> int:
    """60 bits of a text's SHA-256: tells apart rows that share an id."""
    return int(hashlib.sha256(raw).hexdigest()[:15], 16)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _window_hash(buf: np.ndarray, k: int) -> np.ndarray:
    """Hash of buf[i : i + k] for each i, by doubling."""
    acc, acc_len, cur, cur_len, m = None, 0, _TABLE[buf], 1, k
    while m:
        if m & 1:
            if acc is None:
                acc, acc_len = cur, cur_len
            else:
                n = len(buf) - acc_len - cur_len + 1
                acc = acc[:n] * np.uint64(pow(_B, cur_len, 2**64)) + cur[acc_len : acc_len + n]
                acc_len += cur_len
        m >>= 1
        if m:
            cur = cur[:-cur_len] * np.uint64(pow(_B, cur_len, 2**64)) + cur[cur_len:]
            cur_len *= 2
    return mix64(acc)


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    size, out = 1, x
    while size * 2 <= w:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    return np.minimum(out[: len(x) - w + 1], out[w - size : w - size + len(x) - w + 1])


def phrases(texts: list[bytes], width: int = WIDTH, gram: int = GRAM):
    """For slices of texts: (buf, doc, at, n, anchor hash, offset of the phrase in its document).

    A phrase: `n` neighbouring starts from `at` in buf whose width-byte strings share an anchor.
    """
    parts = []
    for i, t in enumerate(texts):
        for a in range(0, max(1, len(t) - width + 1), STRETCH):
            if len(t) - a >= width:
                parts.append((i, a, t[a : a + STRETCH + width - 1]))
    for lo, hi in slices([len(p[2]) for p in parts], SLICE):
        part = parts[lo:hi]
        sizes = np.array([len(p[2]) for p in part], np.int64)
        ends = np.cumsum(sizes)
        buf = np.frombuffer(b"".join(p[2] for p in part), np.uint8)
        with np.errstate(over="ignore"):
            h = _window_hash(buf, gram)
            low = np.uint64((1 << _POS_BITS) - 1)
            smallest = _sliding_min((h & ~low) | np.arange(len(h), dtype=np.uint64), width - gram + 1)
        anchor = (smallest & low).astype(np.int64)
        start_of = np.repeat(ends - sizes, sizes)[: len(anchor)]
        part_of = np.repeat(np.arange(len(part)), sizes)[: len(anchor)]
        ok = np.arange(len(anchor)) + width <= ends[part_of]
        head = ok.copy()
        head[1:] &= (anchor[1:] != anchor[:-1]) | (part_of[1:] != part_of[:-1])
        at = np.flatnonzero(head)
        runs = np.add.reduceat(ok, at) if len(at) else np.empty(0, np.int64)
        which = part_of[at]
        doc = np.array([p[0] for p in part], np.int64)[which]
        offset = at - start_of[at] + np.array([p[1] for p in part], np.int64)[which]
        yield buf, doc, at, runs.astype(np.int64), h[anchor[at]], offset


def _take(buf: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ranges at .. at + size of buf one after another, and their bounds. Indices are made for about SLICE bytes at a time."""
    bounds = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    out, lo = np.empty(bounds[-1], np.uint8), 0
    while lo < len(size):
        hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + SLICE, "right")) - 1)
        part = slice(bounds[lo], bounds[hi])
        out[part] = buf[np.repeat(at[lo:hi] - bounds[lo:hi], size[lo:hi]) + np.arange(bounds[lo], bounds[hi])]
        lo = hi
    return out, bounds


def _binary(flat: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int64).tobytes()), pa.py_buffer(flat.tobytes())]).cast(pa.binary())


def _kept_texts(docs: pa.Table, copies: pa.Table) -> tuple[np.ndarray, list[int], list[bytes]]:
    """Ids, text ids and texts of a block without later copies."""
    gone = set(zip(copies.column("doc_id").to_pylist(), copies.column("tid").to_pylist())) if copies.num_rows else set()
    raw, ids = text_bytes(docs.column("text")), docs.column("doc_id").to_pylist()
    rows = [(d, t, r) for d, r in zip(ids, raw) if len(r) >= WIDTH for t in [text_id(r)] if (d, t) not in gone]
    return np.array([r[0] for r in rows], np.int64), [r[1] for r in rows], [r[2] for r in rows]


def _anchors(blocks: DataFrame, copies: DataFrame, buckets: int) -> DataFrame:
    """bucket, blob: per block and bucket, 32 bits of each anchor hash, and the logarithm of its count in the block."""

    def run(key, docs, gone):
        block = key[0].as_py()
        _, _, texts = _kept_texts(docs, gone)
        found = [h for _, _, _, _, h, _ in phrases(texts)]
        h, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.empty(0, np.uint64), np.empty(0, np.int64))
        bucket = (h % np.uint64(buckets)).astype(np.int64)
        short, count = (h >> np.uint64(32)).astype("<u4"), np.ceil(np.log2(n)).astype(np.uint8)
        order = np.argsort(bucket, kind="stable")
        short, count = short[order], count[order]
        cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
        full = [b for b in range(buckets) if cut[b + 1] > cut[b]]
        blobs = [short[cut[b] : cut[b + 1]].tobytes() + count[cut[b] : cut[b + 1]].tobytes() for b in full]
        return pa.table([pa.array(full, pa.int64()), pa.array([block] * len(full), pa.int64()), pa.array([int(cut[b + 1] - cut[b]) for b in full], pa.int64()), pa.array(blobs, pa.binary())], names=["bucket", "block", "n", "blob"])

    return blocks.groupBy("block").cogroup(copies.groupBy("block")).applyInArrow(freed(run), "bucket long, block long, n long, blob binary")


def _repeated(anchors: DataFrame) -> DataFrame:
    """block, bucket, blob, hot: which of a block's anchors repeat in the corpus, and which of these do so very often."""
    often = HOT

    def run(key, t):
        bucket = key[0].as_py()
        blocks, counts, blobs = t.column("block").to_pylist(), t.column("n").to_pylist(), t.column("blob").to_pylist()
        h = [np.frombuffer(b, "<u4", n) for b, n in zip(blobs, counts)]
        times = np.concatenate([2.0 ** np.frombuffer(b, np.uint8, n, 4 * n) for b, n in zip(blobs, counts)])
        every = np.concatenate(h)
        order = np.argsort(every, kind="stable")
        s = every[order]
        new = np.ones(len(s), bool)
        new[1:] = s[1:] != s[:-1]
        at = np.flatnonzero(new)
        total = np.add.reduceat(times[order], at)
        known, hot = np.empty(len(s), bool), np.empty(len(s), bool)
        many = np.diff(np.append(at, len(s)))
        known[order], hot[order] = np.repeat(total > 1, many), np.repeat(total > often, many)
        cut = np.concatenate([[0], np.cumsum(counts)])
        rows = []
        for b, lo, hi in zip(blocks, cut[:-1], cut[1:]):
            own = known[lo:hi]
            if own.any():
                rows.append((b, bucket, every[lo:hi][own].tobytes(), every[lo:hi][hot[lo:hi]].tobytes()))
        return pa.table([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [[]] * 4, (pa.int64(), pa.int64(), pa.binary(), pa.binary()))], names=["block", "bucket", "blob", "hot"])

    return anchors.groupBy("bucket").applyInArrow(freed(run), "block long, bucket long, blob binary, hot binary")


_PHRASE = "bucket long, hash long, cid long, block long, doc_id long, tid long, start long, n long, seq binary"


def _hashes(buckets_of: list, blobs: list, buckets: int) -> np.ndarray:
    parts = [np.frombuffer(b, "<u4").astype(np.uint64) * np.uint64(buckets) + np.uint64(k) for k, b in zip(buckets_of, blobs) if k is not None]
    return np.sort(np.concatenate(parts)) if parts else np.empty(0, np.uint64)


def _among(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of x are in the sorted array."""
    if not len(known):
        return np.zeros(len(x), bool)
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x


def _one_by_one(doc, at, n, h, offset, alone):
    """Phrases of the marked kind as one phrase for each of their strings."""
    times = np.where(alone, n, 1)
    k = np.repeat(np.arange(len(n)), times)
    step = np.arange(len(k)) - np.repeat(np.cumsum(times) - times, times)
    return doc[k], at[k] + step, np.where(alone[k], 1, n[k]), h[k], offset[k] + step, alone[k]


def _phrases(blocks: DataFrame, copies: DataFrame, repeated: DataFrame, buckets: int) -> DataFrame:
    """Phrases with a repeated anchor. Of equal ones in a block the first goes on; the others are settled (no seq)."""
    side = copies.select("block", "doc_id", "tid", F.lit(None).cast("long").alias("bucket"), F.lit(None).cast("binary").alias("blob"), F.lit(None).cast("binary").alias("hot"))
    side = side.unionByName(repeated.select("block", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("tid"), "bucket", "blob", "hot"))

    def run(key, docs, more):
        block = key[0].as_py()
        is_copy = np.array([x is None for x in more.column("bucket").to_pylist()], bool)
        ids, tids, texts = _kept_texts(docs, more.filter(pa.array(is_copy)) if more.num_rows else more)
        tids = np.array(tids, np.int64)
        wanted, often = (_hashes(more.column("bucket").to_pylist(), more.column(c).to_pylist(), buckets) for c in ("blob", "hot"))
        out = []
        for buf, doc, at, n, h, offset in phrases(texts):
            short = (h >> np.uint64(32)) * np.uint64(buckets) + h % np.uint64(buckets)
            on = _among(short, wanted)
            doc, at, n, h, offset, short = doc[on], at[on], n[on], h[on], offset[on], short[on]
            alone = _among(short, often)
            if alone.any():
                doc, at, n, h, offset, alone = _one_by_one(doc, at, n, h, offset, alone)
            size = n + WIDTH - 1
            with np.errstate(over="ignore"):
                prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_TABLE[buf] * _powers(_B, len(buf)), dtype=np.uint64)])
                cid = mix64((prefix[at + size] - prefix[at]) * _powers(_BINV, len(buf))[at] + n.astype(np.uint64))
                h = np.where(alone, mix64(cid), h)
            flat, bounds = _take(buf, at, size)
            out.append((h.view(np.int64), cid.view(np.int64), ids[doc], tids[doc], offset, n, flat, bounds))
        names = [x.split()[0] for x in _PHRASE.split(", ")]
        if not out:
            return pa.table([pa.array([], pa.int64())] * 8 + [pa.array([], pa.binary())], names=names)
        h, cid, d, tid, start, n = (np.concatenate([o[i] for o in out]) for i in range(6))
        flat = np.concatenate([o[6] for o in out])
        bounds = np.concatenate([[0], np.cumsum(n + WIDTH - 1)])
        order = np.lexsort((start, d, cid, h))
        first = np.ones(len(order), bool)
        first[1:] = (h[order[1:]] != h[order[:-1]]) | (cid[order[1:]] != cid[order[:-1]])
        lead = order[np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))]
        later = (d[order] > d[lead]) | (d[order] == d[lead]) & (start[order] > start[lead])
        send, settled = order[~later], order[later]
        flat, b = _take(flat, bounds[:-1][send], (n + WIDTH - 1)[send])
        seqs = pa.chunked_array([_binary(flat, b), pa.nulls(len(settled), pa.binary())])
        rows = np.concatenate([send, settled])
        bucket = (h[rows].view(np.uint64) % np.uint64(buckets)).astype(np.int64)
        bucket[len(send) :] = np.arange(len(settled)) % buckets
        cols = [bucket, h[rows], cid[rows], np.full(len(rows), block), d[rows], tid[rows], start[rows], n[rows]]
        return pa.table([*map(pa.array, cols), seqs], names=names)

    return blocks.groupBy("block").cogroup(side.groupBy("block")).applyInArrow(freed(run), _PHRASE)


def mark(flat: np.ndarray, bounds: np.ndarray, order_key: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """For each position of flat: whether `width` bytes from there are an earlier occurrence's. order_key grows with the place in the corpus."""
    index = RunIndex(flat, bounds)
    when = np.full(len(flat) + index.n_strings, 2**63 - 1, np.int64)
    inside = np.ones(len(when), bool)
    inside[index.ends] = False
    when[inside] = order_key
    return repeated(index, when, width)[inside]


def _marked(phrase_rows: DataFrame) -> DataFrame:
    """block, blob: byte ranges to remove, as records."""

    def run(t):
        col = lambda c: t.column(c).to_numpy()
        block, d, tid, start, n, h, cid = (col(c) for c in ("block", "doc_id", "tid", "start", "n", "hash", "cid"))
        live = np.flatnonzero(~t.column("seq").is_null().to_numpy())
        settled = np.flatnonzero(t.column("seq").is_null().to_numpy())
        ranges = [(settled, start[settled], start[settled] + n[settled] + WIDTH - 1)]
        order = live[np.lexsort((start[live], d[live], cid[live], h[live]))]
        first = np.ones(len(order), bool)
        first[1:] = (h[order[1:]] != h[order[:-1]]) | (cid[order[1:]] != cid[order[:-1]])
        lead = order[np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))] if len(order) else order
        later = (d[order] > d[lead]) | (d[order] == d[lead]) & (start[order] > start[lead])
        again = order[later]
        ranges.append((again, start[again], start[again] + n[again] + WIDTH - 1))
        # Dictionary phrases of anchors that have several: only their strings can match in part.
        own = order[first]
        if len(own):
            new = np.ones(len(own), bool)
            new[1:] = h[own[1:]] != h[own[:-1]]
            group = np.cumsum(new) - 1
            own = own[np.bincount(group)[group] > 1]
        seq = t.column("seq").combine_chunks()
        size = n[own] + WIDTH - 1
        ends = np.append(np.flatnonzero(h[own[1:]] != h[own[:-1]]) + 1, len(own)) if len(own) else np.empty(0, np.int64)
        a = at = total = 0
        for b in ends.tolist():
            group = int(size[at:b].sum())
            if total and (group > GROUP_BYTES or total >= INDEX_BYTES):
                ranges.append(_repeats_among(own[a:at], seq, d, start, mark))
                a, total = at, 0
            at, total = b, total + group
            if group > GROUP_BYTES:
                ranges.append(_repeats_among(own[a:at], seq, d, start, string_by_string))
                a, total = at, 0
        if total:
            ranges.append(_repeats_among(own[a:at], seq, d, start, mark))
        rows = np.concatenate([r[0] for r in ranges])
        rec = np.empty(len(rows), _REC)
        rec["doc"], rec["tid"], rec["a"], rec["b"] = d[rows], tid[rows], np.concatenate([r[1] for r in ranges]), np.concatenate([r[2] for r in ranges])
        by = np.argsort(block[rows], kind="stable")
        rec, blk = rec[by], block[rows][by]
        names, at = np.unique(blk, return_index=True)
        cut = np.append(at, len(blk))
        return pa.table([pa.array(names.astype(np.int64)), pa.array([rec[cut[i] : cut[i + 1]].tobytes() for i in range(len(names))], pa.binary())], names=["block", "blob"])

    return phrase_rows.groupBy("bucket").applyInArrow(freed(run), "block long, blob binary")


def string_by_string(flat: np.ndarray, bounds: np.ndarray, order_key: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """What mark gives, from hashes of all strings of `width` bytes, made slice by slice; equal hashes are confirmed on the bytes."""
    places, hashes = [], []
    for lo, hi in slices(np.diff(bounds).tolist(), SLICE):
        part = flat[bounds[lo] : bounds[hi]]
        if len(part) < width:
            continue
        left = np.repeat(bounds[lo + 1 : hi + 1], np.diff(bounds[lo : hi + 1])) - np.arange(bounds[lo], bounds[hi])
        on = np.flatnonzero(left >= width)
        with np.errstate(over="ignore"):
            hashes.append(_window_hash(part, width)[on])
        places.append(on + bounds[lo])
    out = np.zeros(len(flat), bool)
    if not places:
        return out
    at, h = np.concatenate(places), np.concatenate(hashes)
    order = np.lexsort((order_key[at], h))
    at, h = at[order], h[order]
    new = np.append(True, h[1:] != h[:-1])
    lead = at[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
    again = np.flatnonzero(~new & (order_key[at] > order_key[lead]))
    window = np.arange(width)
    for a in range(0, len(again), SLICE // width):
        i = again[a : a + SLICE // width]
        same = (flat[at[i][:, None] + window] == flat[lead[i][:, None] + window]).all(1)
        out[at[i[same]]] = True
        for j in i[~same]:  # strings that only their hashes confuse
            own = flat[at[j] : at[j] + width]
            others = at[(h == h[j]) & (order_key[at] < order_key[at[j]])]
            out[at[j]] = any((flat[o : o + width] == own).all() for o in others)
    return out


def _repeats_among(rows: np.ndarray, seq: pa.Array, d: np.ndarray, start: np.ndarray, way) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of the phrases `rows` that are covered by earlier strings, which `way` finds: (phrase, from, to)."""
    raw = seq.take(pa.array(rows)).to_pylist()
    bounds = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    flat = np.frombuffer(b"".join(raw), np.uint8)
    size = np.diff(bounds)
    string = np.repeat(np.arange(len(raw)), size)
    within = np.arange(len(flat)) - bounds[:-1][string]
    place = np.unique(d[rows], return_inverse=True)[1]
    hit = way(flat, bounds, (place[string].astype(np.int64) << 36) | (start[rows][string] + within))
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
    lo, hi = edge[::2], edge[1::2]  # a hit never reaches a string's last width - 1 bytes, so none runs into the next string
    return rows[string[lo]], start[rows][string[lo]] + within[lo], start[rows][string[lo]] + within[hi - 1] + WIDTH


def _cut(blocks: DataFrame, copies: DataFrame, marked: DataFrame, with_text: bool) -> DataFrame:
    """One row per row of blocks: what is removed, and what stays."""
    side = copies.select("block", "doc_id", "tid", F.lit(None).cast("binary").alias("blob")).unionByName(marked.select("block", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("tid"), "blob"))

    def run(key, docs, more):
        blobs = more.column("blob").to_pylist()
        gone = {(a, b) for a, b, x in zip(more.column("doc_id").to_pylist(), more.column("tid").to_pylist(), blobs) if x is None}
        rec = np.frombuffer(b"".join(x for x in blobs if x is not None), _REC)
        rec = rec[np.lexsort((rec["a"], rec["tid"], rec["doc"]))]
        heads = np.flatnonzero(np.append(True, (rec["doc"][1:] != rec["doc"][:-1]) | (rec["tid"][1:] != rec["tid"][:-1]))) if len(rec) else np.empty(0, np.int64)
        where = {(int(rec["doc"][i]), int(rec["tid"][i])): (i, j) for i, j in zip(heads, np.append(heads[1:], len(rec)))}
        out = []
        for d, raw in zip(docs.column("doc_id").to_pylist(), text_bytes(docs.column("text"))):
            ident = (d, text_id(raw))
            if ident in gone:
                spans = [(0, len(raw))]
            elif ident in where:
                i, j = where[ident]
                spans = joined(rec["a"][i:j].tolist(), rec["b"][i:j].tolist())
            else:
                spans = []
            rest, at = [], 0
            for a, b in spans:
                rest.append(raw[at:a])
                at = b
            rest = b"".join([*rest, raw[at:]])
            out.append((d, ident[1], len(raw), len(raw) - len(rest), len(spans), hashlib.sha256(rest).hexdigest(), rest.decode("utf-8", "ignore") if with_text else None))
        kinds = (pa.int64(),) * 5 + (pa.string(), pa.string())
        return pa.table([pa.array(c, k) for c, k in zip(list(zip(*out)) or [[]] * 7, kinds)], names=["doc_id", "tid", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"])

    return blocks.groupBy("block").cogroup(side.groupBy("block")).applyInArrow(freed(run), "doc_id long, tid long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string")


def joined(starts: list[int], ends: list[int]) -> list[tuple[int, int]]:
    """Ranges (sorted by start) with overlapping and touching ones made one."""
    out: list[list[int]] = []
    for a, b in zip(starts, ends):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept_text (with_text; else null), tid.

    Null texts are empty. Texts below WIDTH bytes lose nothing. A null id counts as smaller than every id. Of rows with one
    id, equal starts are not earlier than each other: identical rows lose the same. kept_text leaves out characters
    that a cut has split. Empty table: no rows. Other columns are not read.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    ident = F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID))
    narrow = docs.select(ident.alias("doc_id"), text.alias("text"))
    size = narrow.agg(F.sum(F.octet_length("text").cast("long"))).head()[0] or 0
    # Blocks by bytes, so that none grows with the input; at least as many as Spark's shuffles have partitions.
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // BLOCK_BYTES))
    blocks = narrow.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(tasks)))
    seen = blocks.filter(F.octet_length("text") >= WIDTH).select("block", "doc_id", F.sha2("text", 256).alias("sha"))
    first = seen.groupBy("sha").agg(F.min("doc_id").alias("first"), F.count("*").alias("c")).filter("c > 1").drop("c")
    copies = seen.join(first, "sha").filter("doc_id > first").select((F.col("block") + 0).alias("block"), (F.col("doc_id") + 0).alias("doc_id"), F.conv(F.substring("sha", 1, 15), 16, 10).cast("long").alias("tid"))
    repeated = _repeated(_anchors(blocks, copies, tasks))
    marked = _marked(_phrases(blocks, copies, repeated, tasks))
    out = _cut(blocks, copies, marked, with_text)
    return out.withColumn("doc_id", F.when(F.col("doc_id") != _NO_ID, F.col("doc_id")))


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """docs with the repeated passages cut out of their texts; all other columns as they were, n_chars counted anew.

    Documents that nothing is left of go. Rows are told apart by id and text.
    """
    rest = remove_repeats(docs, id_col, text_col).filter("n_removed > 0").select(F.coalesce("doc_id", F.lit(_NO_ID)).alias("__gl_id"), F.col("tid").alias("__gl_tid"), F.col("kept_text").alias("__gl_text")).dropDuplicates(["__gl_id", "__gl_tid"])
    sha = F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256)
    same = (F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)) == F.col("__gl_id")) & (F.conv(F.substring(sha, 1, 15), 16, 10).cast("long") == F.col("__gl_tid"))
    both = docs.join(rest, same, "left")
    text = F.when(F.col("__gl_id").isNull(), F.col(text_col)).otherwise(F.col("__gl_text"))
    cols = [text.alias(c) if c == text_col else F.when(F.col("__gl_id").isNull(), F.col(c)).otherwise(F.length("__gl_text")).cast(dict(docs.dtypes)[c]).alias(c) if c == chars_col else F.col(f"`{c}`") for c in docs.columns]
    return both.filter("__gl_id is null or __gl_text <> ''").select(*cols)


def op6_run_length_index(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), with_text=False).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


#: Every string of WIDTH bytes by itself: for tables that a single machine can hold. Ids are told apart; texts in hexadecimal, two digits a byte.
OP6_SQL = f"""
WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n_bytes FROM documents),
s AS (SELECT doc_id, p, substr(h, 2 * p + 1, {2 * WIDTH}) AS piece FROM t, LATERAL (SELECT unnest(range(0, n_bytes - {WIDTH - 1})) AS p)),
again AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY piece ORDER BY doc_id, p) AS k FROM s) WHERE k > 1),
heads AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + {WIDTH} THEN 0 ELSE 1 END AS head FROM again),
spans AS (
  SELECT doc_id, min(p) AS a, max(p) + {WIDTH} AS b
  FROM (SELECT doc_id, p, sum(head) OVER (PARTITION BY doc_id ORDER BY p) AS span FROM heads) GROUP BY doc_id, span),
kept AS (
  SELECT doc_id, b AS a, lead(a, 1, 1000000000000) OVER (PARTITION BY doc_id ORDER BY a) AS b FROM spans
  UNION ALL SELECT doc_id, 0, min(a) FROM spans GROUP BY doc_id),
rest AS (SELECT doc_id, string_agg(substr(h, 2 * a + 1, 2 * (least(b, n_bytes) - a)), '' ORDER BY a) AS r FROM kept JOIN t USING (doc_id) GROUP BY doc_id),
gone AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id)
SELECT doc_id, n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(r, h))) AS kept_sha256
FROM t LEFT JOIN gone USING (doc_id) LEFT JOIN rest USING (doc_id)
"""
