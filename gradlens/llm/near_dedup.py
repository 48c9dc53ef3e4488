"""Near-duplicate documents by bottom-k sketches of word shingles.

One hash function; a document's sketch is its k smallest shingle hashes. Documents with equal sets form a class first.
Inverted lists of retained values bring classes together, unions of two sketches estimate their similarity, and what
is not ruled out is verified on the full sets of the texts' own words. Sets are equal where two independent 64-bit
hashes of all their shingles agree.

Two things keep hot values and large groups from making all pairs of a list. First, prefixes: linked classes share at
least a known part of the smaller sketch (all but seven standard deviations of the threshold: 0.49 of it for k = 48 and
similarity 0.85), so only the rarer rest of a sketch, plus one value, has to be listed.

Second, differences from a leader. A list of more than SMALL classes meets its leader only, the class that comes first
by position of the value (the most usual one). With D(x) the symmetric difference of the sets of x and the leader,
|A xor B| = |D(a) xor D(b)| exactly; so classes that are linked with each other, but not both with the leader, share almost
all of their differences. The differences make new, shorter lists, rarest first, and those have leaders again, LEVELS
times. In what is left after that, two classes of one list meet only if the places of the shared difference in both allow
a link and they are in different components still. Copies that differ from their common source in places of their own do
not meet, and nothing is dropped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradlens.llm._common import discard, freed, mix64, slices, table, text_bytes, written

WORDS = 5
K = 48
#: Estimates further below the threshold than so many standard deviations are rejected. The binomial's tail is skewed:
#: a pair at the threshold is lost with probability 3.4e-10 (0.85) or 2.4e-11 (0.80).
SIGMAS = 7.5
#: Linked classes share this many deviations less of a sketch than the threshold, at least.
SURE = 7.0
#: Lists up to this length make all of their pairs: at most SMALL - 1 a member.
SMALL = 8
#: How often lists of differences get leaders.
LEVELS = 1

_KEY = b"gradlens shingles"
_rng = np.random.default_rng(541)
#: Odd multipliers of a shingle's words, for two independent hashes.
_MULT = _rng.integers(0, 2**63, (2, 64), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Bytes of text whose words are in memory at once.
SLICE = 500_000
#: Longer words are hashed one by one.
_LONG = 256
_STEP_KEYS = _rng.integers(0, 2**63, (2, _LONG // 8), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def word_hashes(words: list[bytes]) -> np.ndarray:
    """(words, 2) independent keyed hashes. Eight bytes a step go through a mixing that is no polynomial of them; long words through BLAKE2b."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    raw = np.frombuffer(b"".join(words) + bytes(16), np.uint8)
    eight = np.ndarray((len(raw) - 8,), "<u8", raw, 0, (1,))
    at = np.cumsum(size) - size
    out = np.empty((len(words), 2), np.uint64)
    with np.errstate(over="ignore"):
        out[:, 0] = size.astype(np.uint64) * _MULT[0, 0]
        out[:, 1] = size.astype(np.uint64) * _MULT[1, 0]
        on = np.flatnonzero(size <= _LONG)
        for k in range(_LONG // 8):
            on = on[size[on] > 8 * k] if k else on
            if not len(on):
                break
            c = eight[at[on] + 8 * k] & _MASK[np.minimum(size[on] - 8 * k, 8)]
            for side in range(2):
                out[on, side] = mix64((out[on, side] ^ c) * _STEP_KEYS[side, k] + _STEP_KEYS[1 - side, k])
        # Each side depends on both states, so one 64-bit state is not enough to meet.
        both = mix64(out[:, 0] ^ (out[:, 1] << np.uint64(31) | out[:, 1] >> np.uint64(33))), mix64(out[:, 1] + out[:, 0] * _MULT[0, 1])
        out[:, 0], out[:, 1] = both
    for i in np.flatnonzero(size > _LONG):
        out[i] = np.frombuffer(hashlib.blake2b(words[i], digest_size=16, key=_KEY).digest(), "<u8")
    return out


def split_words(text: bytes) -> list[bytes]:
    """Words, A-Z in lower case, between the six ASCII spaces."""
    return text.lower().split()


def _shingles(texts: list[bytes], words: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Two 64-bit hashes of each text's shingles, in order of place."""
    split = [split_words(t) for t in texts]
    word = word_hashes([w for ws in split for w in ws])
    with np.errstate(over="ignore"):
        many = max(len(word) - words + 1, 0)
        full = [np.zeros(many, np.uint64) for _ in range(2)]
        for side in range(2):
            for j in range(words if many else 0):
                full[side] += word[j : j + many, side] * _MULT[side, j]
            full[side] = mix64(full[side])
        at = 0
        for ws in split:
            k = len(ws)
            if k >= words:
                yield full[0][at : at + k - words + 1], full[1][at : at + k - words + 1]
            elif k:
                yield tuple(mix64((word[at : at + k, side] * _MULT[side, :k]).sum(keepdims=True) + np.uint64(k)) for side in range(2))
            else:
                yield full[0][:0], full[1][:0]
            at += k


def shingle_sets(texts: list[bytes], words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes (as int64) of each text's shingles; ASCII lower case, split at ASCII spaces."""
    return [np.unique(h.view(np.int64)) for h, _ in _shingles(texts, words)]


def linked(a: bytes, b: bytes, percent: int, words: int = WORDS) -> bool:
    """Whether 100 * intersection >= percent * union of the two texts' shingles, from the words themselves: nothing is hashed to a number."""
    sides = [split_words(t) for t in (a, b)]
    number: dict[bytes, int] = {}
    ids = [np.array([number.setdefault(w, len(number)) for w in ws], np.int64) for ws in sides]
    if any(len(i) < words for i in ids):
        return bool(len(ids[0])) and sides[0] == sides[1]
    code = np.concatenate([i[: len(i) - words + 1] for i in ids])
    cut, most = len(ids[0]) - words + 1, len(number)
    for j in range(1, words):
        if most * len(number) >= 2**62:  # number the prefixes anew, so that codes stay exact
            code = np.unique(code, return_inverse=True)[1]
            most = int(code.max()) + 1
        code = code * len(number) + np.concatenate([i[j : len(i) - words + 1 + j] for i in ids])
        most *= len(number)
    x, y = np.unique(code[:cut]), np.unique(code[cut:])
    same = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * same >= percent * (len(x) + len(y) - same)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays) if arrays else np.empty(0, np.int64), pa.int64()))


def sketches(docs: DataFrame, words: int = WORDS, k: int = K) -> DataFrame:
    """doc_id, n_shingles, digest of the set (128 bits), sketch. docs: doc_id, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = text_bytes(batch.column(1))
            sets = [x for a, b in slices([len(r) for r in raw], SLICE) for x in _small(_shingles(raw[a:b], words), k)]
            yield pa.record_batch([batch.column(0), pa.array([s[0] for s in sets], pa.int64()), pa.array([s[1] for s in sets], pa.binary()), _lists([s[2] for s in sets])], names=["doc_id", "n_shingles", "digest", "sketch"])

    return docs.mapInArrow(freed(run), "doc_id long, n_shingles long, digest binary, sketch array<long>")


def _small(shingles: Iterator[tuple[np.ndarray, np.ndarray]], k: int) -> Iterator[tuple[int, bytes, np.ndarray]]:
    """Size, digest of both hashes' sets, sketch."""
    for h, other in shingles:
        own = np.unique(h.view(np.int64))
        yield len(own), hashlib.blake2b(own.tobytes() + np.unique(other).tobytes(), digest_size=16).digest(), own[:k].copy()


def full_sets(docs: DataFrame, words: int = WORDS, k: int = K) -> DataFrame:
    """rep, sketch, shingles, text. docs: rep, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = text_bytes(batch.column(1))
            for a, b in slices([len(x) for x in raw], SLICE):
                sets = shingle_sets(raw[a:b], words)
                yield pa.record_batch([batch.column(0).slice(a, b - a), _lists([x[:k] for x in sets]), _lists(sets), batch.column(1).slice(a, b - a)], names=["rep", "sketch", "shingles", "text"])

    return docs.mapInArrow(freed(run), "rep long, sketch array<long>, shingles array<long>, text string")


def components(edges: DataFrame) -> DataFrame:
    """node, label: the smallest node that can be reached over edges (a, b). Minimum labels with pointer jumping.

    One written table a round; stars around their smallest node need one round, and any graph about the logarithm of its diameter.
    """
    both = written(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))), "edges")
    last = label = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "label")
    while True:
        near = both.join(label.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("m"))
        step = label.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        jump = label.select(F.col("node").alias("label"), F.col("label").alias("top"))
        step = written(step.join(jump, "label", "left").select("node", "old", F.least("label", "top").alias("label")), "label")
        discard(last)
        last, label = step, step.select("node", "label")
        if step.filter("old <> label").isEmpty():
            discard(both)
            return label


def _prefixes(reps: DataFrame, percent: int, k: int) -> DataFrame:
    """v, rep, n, pos: the retained values to list, those that at least two classes retain; pos: place in the sketch, rarest first."""
    values = reps.select("rep", "n", F.size("sketch").alias("m"), F.explode("sketch").alias("v"))
    times = reps.select(F.explode("sketch").alias("v")).groupBy("v").agg(F.count("*").alias("times")).filter("times > 1")
    shared = values.join(times, "v").groupBy("rep", "n", "m").agg(F.sort_array(F.collect_list(F.struct("times", "v"))).alias("s"))
    t = percent / 100
    share = max(0.0, t - SURE * (t * (1 - t) / k) ** 0.5)
    # Values that no other class retains come first in the prefix.
    room = (F.size("s") + 1 - F.ceil(F.col("m") * share)).cast("int")
    listed = shared.filter(room > 0).select("rep", "n", (F.col("m") - F.size("s")).alias("alone"), F.posexplode(F.slice("s", F.lit(1), room)).alias("at", "x"))
    return listed.select(F.col("x.v").alias("v"), "rep", "n", (F.col("alone") + F.col("at") + 1).alias("pos"))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int, words: int, k: int) -> DataFrame:
    """a, b of the pairs that are linked: not ruled out by the union sketch, and confirmed on the full sets of the texts."""
    t = percent / 100
    least = t - SIGMAS * (t * (1 - t) / k) ** 0.5
    side = lambda x, c: sets.select(F.col("rep").alias(x), F.col(c).alias(f"{c}_{x}"))
    near = pairs.join(side("a", "sketch"), "a").join(side("b", "sketch"), "b")
    union = F.slice(F.array_sort(F.array_union("sketch_a", "sketch_b")), 1, k)
    both = F.size(F.array_intersect(F.array_intersect("sketch_a", "sketch_b"), union))
    near = near.filter(both >= least * F.size(union)).select("a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = zip(text_bytes(batch.column(2)), text_bytes(batch.column(3)))
            yield batch.filter(pa.array([linked(x, y, percent, words) for x, y in texts], pa.bool_())).select(["a", "b"])

    full = near.join(side("a", "text"), "a").join(side("b", "text"), "b").select("a", "b", "text_a", "text_b")
    return full.mapInArrow(freed(run), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85, words: int = WORDS, k: int = K) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept.

    Documents are linked where 100 * intersection >= percent * union of their shingle sets; component_id is the
    smallest doc_id of the component. A document with fewer than `words` words has its whole sequence as one shingle; null
    texts and texts without words have none and are linked with nothing. Repeated rows share their component, and each
    whose id is the component's is kept. Rows without id: in the component of their text if another row with an id
    has the same set (then dropped), else alone with a null component_id, and kept. Empty table: no rows. Other columns are not read.
    """
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    seen = written(sketches(narrow, words, k), "sketches")
    classes = written(seen.filter("n_shingles > 0").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch")), "classes")
    reps = classes.filter("rep is not null").select("rep", "n", "sketch")
    lists = written(_prefixes(reps, percent, k), "lists")
    listed = lists.select("rep").distinct()
    sets = written(full_sets(narrow.join(listed, narrow["doc_id"] == listed["rep"]).groupBy("rep").agg(F.first("text").alias("text")), words, k), "sets")
    label = _connect(lists, sets, percent, words, k)
    whole = seen.select("doc_id", "n_shingles", "digest").join(classes.select("digest", "rep"), "digest", "left")
    whole = whole.withColumn("rep", F.when(F.col("n_shingles") > 0, F.col("rep")).otherwise(F.col("doc_id")))
    if label is not None:
        whole = whole.join(label.select(F.col("node").alias("rep"), "label"), "rep", "left")
    else:
        whole = whole.withColumn("label", F.lit(None).cast("long"))
    whole = whole.withColumn("component_id", F.coalesce("label", "rep"))
    return whole.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _differences(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """v, rep, n, pos, size: lists of differences from the leader. members: lead, rep, n. pos: place among the `size` differences, rarest first."""
    side = lambda x: sets.select(F.col("rep").alias(x), F.col("shingles").alias(f"{x}_set"))
    both = members.join(side("rep"), "rep").join(side("lead"), "lead")
    # What the member lacks is told apart from what it has more by flipping all bits.
    delta = F.concat(F.array_except("rep_set", "lead_set"), F.transform(F.array_except("lead_set", "rep_set"), lambda x: F.bitwise_not(x)))
    rows = both.withColumn("delta", delta).select("lead", "rep", "n", F.size("delta").alias("size"), F.explode("delta").alias("el"))
    times = rows.groupBy("lead", "el").agg(F.count("*").alias("times")).filter("times > 1")
    common = rows.join(times, ["lead", "el"]).groupBy("lead", "rep", "n", "size").agg(F.sort_array(F.collect_list(F.struct("times", "el"))).alias("s"))
    # Differences of one class alone come first; places beyond what linked sets may differ by are of no use.
    most = F.floor(F.lit(_differ(percent) * (1 + 100 / percent)) * F.col("n") + 1e-6)
    room = F.least(F.size("s"), most + 1 - (F.col("size") - F.size("s"))).cast("int")
    listed = common.filter(room > 0).select("lead", "rep", "n", "size", (F.col("size") - F.size("s")).alias("alone"), F.posexplode(F.slice("s", F.lit(1), room)).alias("at", "x"))
    return listed.select(F.xxhash64("lead", "x.el").alias("v"), "rep", "n", (F.col("alone") + F.col("at") + 1).alias("pos"), "size")


def _differ(percent: int) -> float:
    """|A xor B| of linked sets is at most this times |A| + |B|."""
    return (100 - percent) / (100 + percent)


def _named(lists: DataFrame, label: DataFrame | None) -> DataFrame:
    if label is None:
        return lists.withColumn("label", F.col("rep"))
    return lists.join(label.select(F.col("node").alias("rep"), "label"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))


def _meeting(lists: DataFrame, percent: int, all_pairs: bool) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of different components to verify, and the leaders (v, lead) of long lists. lists: v, rep, n, pos, label[, size].

    Long lists: pairs with the leader, or, with all_pairs, all that the places of the shared difference allow.
    """
    alike = lambda n, m: 100 * F.least(n, m) >= percent * F.greatest(n, m)
    per = lists.groupBy("v").agg(F.min(F.struct("pos", "rep", "n", "label")).alias("l"), F.count("*").alias("members"), F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi")
    lead = written(per.select("v", F.col("l.rep").alias("lead"), F.col("l.n").alias("lead_n"), F.col("l.label").alias("lead_label"), "members"), "leaders")
    few = lists.join(lead.select("v", "members") if all_pairs else lead.filter(f"members <= {SMALL}").select("v", "members"), "v")
    if all_pairs:  # places that allow no link with any class of the list
        least = lists.groupBy("v").agg(F.min("size").alias("least"))
        most = F.floor(F.lit(_differ(percent) * (1 + 100 / percent)) * F.col("n") + 1e-6)
        few = few.join(least, "v").filter(2 * (F.col("pos") - 1) <= most + F.col("size") - F.col("least")).drop("least")
    other = few.select("v", *(F.col(c).alias(f"{c}2") for c in few.columns if c not in ("v", "members")))
    allowed = (F.col("rep") < F.col("rep2")) & (F.col("label") != F.col("label2")) & alike("n", "n2")
    if all_pairs:
        most = F.floor(F.lit(_differ(percent)) * (F.col("n") + F.col("n2")) + 1e-6)
        gap = F.col("size") - F.col("size2")
        allowed = allowed & (2 * (F.col("pos") - 1) <= most + gap) & (2 * (F.col("pos2") - 1) <= most - gap)
    met = few.join(other, "v").filter(allowed).select(F.col("rep").alias("a"), F.col("rep2").alias("b"))
    if not all_pairs:
        star = lists.join(lead.filter(f"members > {SMALL}"), "v").filter((F.col("label") != F.col("lead_label")) & alike("n", "lead_n"))
        met = met.union(star.select(F.least("rep", "lead").alias("a"), F.greatest("rep", "lead").alias("b")))
    return met.distinct(), lead.filter(f"members > {SMALL}").select("v", "lead")


def _connect(lists: DataFrame, sets: DataFrame, percent: int, words: int, k: int) -> DataFrame | None:
    """Labels of the classes that links connect (None: no links). lists: v, rep, n, pos."""
    links = label = None

    def verify(pairs: DataFrame) -> None:
        nonlocal links, label
        pairs = written(pairs, "pairs")
        found = written(_verified(pairs, sets, percent, words, k), "links")
        discard(pairs)
        if not found.isEmpty():
            links = found if links is None else links.unionByName(found)
            label = components(links)

    pairs, lead = _meeting(_named(lists, None), percent, False)
    verify(pairs)
    for _ in range(LEVELS):
        # Lists that are of one component by now are done; the members of the others differ from their leader.
        open_ = _named(lists.join(lead, "v"), label).join(_open(_named(lists.join(lead, "v"), label)), "v")
        members = written(open_.filter("rep <> lead").select("lead", "rep", "n").distinct(), "members")
        if members.isEmpty():
            return label
        lists = written(_differences(members, sets, percent), "differences")
        discard(members)
        pairs, lead = _meeting(_named(lists, label), percent, False)
        verify(pairs)
    pairs, _ = _meeting(_named(lists, label), percent, True)
    verify(pairs)
    return label


def _open(named: DataFrame) -> DataFrame:
    return named.groupBy("v").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("v")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85) -> DataFrame:
    """docs with one document of each component, all columns as they were.

    Documents without words and rows without id all stay; rows that share an id stay or go together.
    """
    gone = near_duplicates(docs, id_col, text_col, percent).filter("not kept and doc_id is not null").select(F.col("doc_id").alias("__gl_key")).distinct()
    return docs.join(gone, F.col(id_col).cast("long") == F.col("__gl_key"), "left_anti")


def op4_bottom_k(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), percent=85)


#: The smallest id that each document reaches over links, from all pairs that share a shingle: for tables that a single machine can hold.
OP4_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
sh AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) >= 5 THEN list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))
                                      WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS same FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * same >= 85 * (x.n + y.n - same)),
way AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a, b FROM way UNION SELECT r.a, w.b FROM reach r JOIN way w ON r.b = w.a),
least AS (SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id, doc_id <= coalesce(m, doc_id) AS kept
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN least USING (doc_id)
"""
