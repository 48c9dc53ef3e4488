"""Exact dedup by a tree merge of sorted digest runs.

A run is a sorted block of (digest, size, other hash, identifier, count) entries, 64 bytes each, in which no identity comes
twice. Every partition turns its texts into runs of up to RUN_ENTRIES rows and deals them to FAN ** rounds run numbers.
Then runs are exchanged in rounds of a binomial tree with log2(FAN) levels a round: in round r the runs x with the same
x // FAN ** r meet, but each only with its share of the digest space, cut into FAN ** r ranges. So there are as many tasks'
worth of work in the last round as in the first, and a task holds about as much as one run. What meets is merged as
sorted runs are, several at once, and of equal identities only the retained identifier and the sum of counts live on:
a digest brings at most FAN entries a round to a merge, however many copies its text has. Identity is verified at each
level: entries merge only if SHA-256, length and an independent 64-bit hash agree.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradlens.llm._common import freed, table

#: Runs that one merge takes in.
FAN = 16
#: Rows that make a run, at most.
RUN_ENTRIES = 65_536
#: Stands for a null identifier: never retained where there is another.
_NO_ID = -(2**63)
_ENTRY = np.dtype([("digest", "<u8", 4), ("size", "<i8"), ("other", "<i8"), ("best", "<i8"), ("n", "<i8")])
_RUNS = "slot long, run long, entries binary"
_FOUND = "digest binary, size long, other long, keep_id long, group_size long"


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the identity of its text: SHA-256, bytes, another hash. Null counts as the empty text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("digest"), F.octet_length(text).cast("long").alias("size"), F.xxhash64(text).alias("other"))


def _order(e: np.ndarray) -> np.ndarray:
    """Stable order by identity. On sorted runs one after another the sort by the leading 64 bits is a merge of the runs."""
    lead = e["digest"][:, 0].copy()
    order = np.argsort(lead, kind="stable")
    s = e[order]
    tie = np.flatnonzero(lead[order[1:]] == lead[order[:-1]])
    if len(tie) and (s["digest"][tie] != s["digest"][tie + 1]).any() | (s["size"][tie] != s["size"][tie + 1]).any() | (s["other"][tie] != s["other"][tie + 1]).any():
        return np.lexsort((e["other"], e["size"], *(e["digest"][:, k] for k in (3, 2, 1, 0))))
    return order


def merged(parts: list[np.ndarray], largest: bool) -> np.ndarray:
    """One sorted run from several: of equal identities the retained identifier and the sum of counts."""
    e = parts[0] if len(parts) == 1 else np.concatenate(parts)
    if not len(e):
        return e
    e = e[_order(e)]
    new = np.ones(len(e), bool)
    new[1:] = (e["digest"][1:] != e["digest"][:-1]).any(1) | (e["size"][1:] != e["size"][:-1]) | (e["other"][1:] != e["other"][:-1])
    at = np.flatnonzero(new)
    best = e["best"] if largest else np.where(e["best"] == _NO_ID, 2**63 - 1, e["best"])
    best = (np.maximum if largest else np.minimum).reduceat(best, at)
    out = e[at].copy()
    out["best"] = best if largest else np.where(best == 2**63 - 1, _NO_ID, best)
    out["n"] = np.add.reduceat(e["n"], at)
    return out


def _dealt(run: np.ndarray, number: int, slots: int, fan: int) -> Iterator[tuple[int, int, bytes]]:
    """(slot, run number of the next round, entries) of a sorted run, cut where the digest space is."""
    high = (run["digest"][:, 0] >> np.uint64(32)).astype(np.int64)
    cuts = np.searchsorted(high, [-(-(k << 32) // slots) for k in range(1, slots)]) if slots <= 4096 else None
    if cuts is None:  # more ranges than a run has entries, perhaps: look at the entries instead
        slot = high * slots >> 32
        heads = np.flatnonzero(np.append(True, slot[1:] != slot[:-1])) if len(slot) else np.empty(0, np.int64)
        for a, b in zip(heads, np.append(heads[1:], len(slot))):
            yield int(slot[a]), number // fan, run[a:b].tobytes()
        return
    for k, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(run)])):
        if b > a:
            yield k, number // fan, run[a:b].tobytes()


def _rows(dealt) -> pa.Table:
    cols = list(zip(*dealt)) or [[], [], []]
    return pa.table([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.binary()))], names=["slot", "run", "entries"])


def first_runs(rows: DataFrame, runs: int, largest: bool, fan: int = FAN, size: int = RUN_ENTRIES) -> DataFrame:
    """The partitions' sorted runs, dealt for the first round. rows: as digests gives them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, held, many = TaskContext.get().partitionId(), 0, [], 0

        def give() -> Iterator[pa.RecordBatch]:
            yield from _rows(_dealt(merged(held, largest), (part + number * 7919) % runs, fan, fan)).to_batches()

        for batch in batches:
            e = np.empty(batch.num_rows, _ENTRY)
            e["digest"] = np.frombuffer(b"".join(batch.column("digest").to_pylist()), ">u8").reshape(-1, 4)
            e["size"], e["other"], e["n"] = batch.column("size").to_numpy(), batch.column("other").to_numpy(), 1
            e["best"] = batch.column("doc_id").fill_null(_NO_ID).to_numpy(zero_copy_only=False)
            for a in range(0, len(e), size):
                held.append(e[a : a + size])
                many += len(held[-1])
                if many >= size:
                    yield from give()
                    number, held, many = number + 1, [], 0
        if held:
            yield from give()

    return rows.mapInArrow(freed(run), _RUNS)


def merge_round(runs: DataFrame, slots: int, largest: bool, fan: int = FAN) -> DataFrame:
    """The runs that meet in a slot are merged into one, and dealt for the next round, which has `slots` ranges (0: it was the last)."""

    def run(key, part):
        out = merged([np.frombuffer(b, _ENTRY) for b in part.column("entries").to_pylist()], largest)
        return _rows(_dealt(out, key[1].as_py(), slots, fan) if slots else [(key[0].as_py(), 0, out.tobytes())])

    return runs.groupBy("slot", "run").applyInArrow(freed(run), _RUNS)


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for blob in batch.column("entries").to_pylist():
            e = np.frombuffer(blob, _ENTRY)
            best = pa.array(e["best"], pa.int64(), mask=e["best"] == _NO_ID)
            digest = pa.Array.from_buffers(pa.binary(32), len(e), [None, pa.py_buffer(e["digest"].astype(">u8").tobytes())]).cast(pa.binary())
            yield pa.record_batch([digest, pa.array(e["size"]), pa.array(e["other"]), best, pa.array(e["n"])], names=[x.split()[0] for x in _FOUND.split(", ")])


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", fan: int = FAN, size: int = RUN_ENTRIES) -> DataFrame:
    """digest, size, other, keep_id, group_size of every distinct text."""
    largest = keep == "largest"
    rounds = max(1, math.ceil(math.log(max(1, docs.count() / size), fan) - 1e-9))
    runs = first_runs(digests(docs, id_col, text_col), fan**rounds, largest, fan, size)
    for r in range(1, rounds + 1):
        runs = merge_round(runs, fan ** (r + 1) if r < rounds else 0, largest, fan)
    return runs.mapInArrow(freed(_entries), _FOUND)


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", fan: int = FAN, size: int = RUN_ENTRIES) -> DataFrame:
    """One row per row of docs: doc_id, keep_id (the smallest or largest id of its text), group_size, kept, text_sha256.

    Null texts count as empty and form one group. A null id is kept only where its whole group has no id (keep_id is
    null then). Rows that repeat both id and text belong to one group and are all marked kept, for the id stays;
    drop_copies leaves one of them. Empty table: no rows. Other columns are not read.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is 'smallest' or 'largest'")
    rows = digests(docs, id_col, text_col)
    found = groups(docs, id_col, text_col, keep, fan, size)
    return rows.join(found, ["digest", "size", "other"]).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """docs without the copies: of equal texts one row stays, with all its columns as they were.

    Of rows that repeat the retained id and its text, the one whose columns hash lowest stays. Rows are shuffled once, by
    identity and id, so that copies are spread; of rows that repeat both, a partition sends one.
    """
    text, ident = F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID))
    keys = ["__gl_d", "__gl_s", "__gl_o", "__gl_i"]
    rows = docs.select("*", F.unhex(F.sha2(text, 256)).alias("__gl_d"), F.octet_length(text).cast("long").alias("__gl_s"), F.xxhash64(text).alias("__gl_o"), ident.alias("__gl_i"), F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns)).alias("__gl_h"))
    one = rows.withColumn("__gl_n", F.row_number().over(Window.partitionBy(*keys).orderBy("__gl_h"))).filter("__gl_n = 1")
    found = groups(docs, id_col, text_col, keep).select(F.col("digest").alias("__gl_d"), F.col("size").alias("__gl_s"), F.col("other").alias("__gl_o"), F.coalesce("keep_id", F.lit(_NO_ID)).alias("__gl_i"))
    return one.join(found, keys).select(*(F.col(f"`{c}`") for c in docs.columns))


def op5_tree_merge(spark, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"), keep="largest")


OP5_SQL = """
WITH t AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256, coalesce(text, '') AS s FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY s) AS keep_id, count(*) OVER (PARTITION BY s) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY s) AS kept, text_sha256
FROM t
"""
