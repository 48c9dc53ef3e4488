import hashlib
from collections import Counter, defaultdict

import pytest

from gradlens.llm import exact_dedup, near_dedup, rindex, substrings
from tests.llm.common import frame, hard_rows

import numpy as np


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_exact(spark, keep):
    rows = hard_rows()
    by = defaultdict(list)
    for d, t in rows:
        by[t or ""].append(d)
    pick = lambda ids: (min if keep == "smallest" else max)([i for i in ids if i is not None], default=None)
    got = exact_dedup.exact_duplicates(frame(spark, rows).repartition(5), keep=keep, fan=2, size=4).collect()
    want = Counter((d, pick(by[t or ""]), len(by[t or ""]), d == pick(by[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for d, t in rows)
    assert Counter(tuple(r[c] for c in ("doc_id", "keep_id", "group_size", "kept", "text_sha256")) for r in got) == want
    left = exact_dedup.drop_copies(frame(spark, rows), keep=keep)
    assert left.columns == frame(spark, rows).columns
    assert Counter((r["text"] or "") for r in left.collect()) == Counter(by.keys())
    assert exact_dedup.exact_duplicates(frame(spark, [])).count() == 0
    with pytest.raises(ValueError):
        exact_dedup.exact_duplicates(frame(spark, rows), keep="some")


@pytest.mark.parametrize("largest", [True, False])
def test_merge_of_sorted_runs(largest):
    """Against a dictionary; also identities that differ late, and runs without entries."""
    rng = np.random.default_rng(2)
    runs, want = [], {}
    for k in range(7):
        e = np.zeros(int(rng.integers(0, 60)) if k != 3 else 0, exact_dedup._ENTRY)
        for row in e:
            row["digest"] = [int(rng.integers(3)), 0, 0, int(rng.integers(3))]
            row["size"], row["other"], row["n"] = rng.integers(2), rng.integers(2), rng.integers(1, 4)
            row["best"] = rng.choice([exact_dedup._NO_ID, *range(-5, 5)])
            key = (*row["digest"].tolist(), int(row["size"]), int(row["other"]))
            n, best = want.get(key, (0, None))
            new = None if row["best"] == exact_dedup._NO_ID else int(row["best"])
            want[key] = n + int(row["n"]), (max if largest else min)((x for x in (best, new) if x is not None), default=None)
        runs.append(exact_dedup.merged([e], largest))
        assert len(runs[-1]) <= len(e)
    got = exact_dedup.merged(runs, largest)
    rows = [(*r["digest"].tolist(), int(r["size"]), int(r["other"])) for r in got]
    assert rows == sorted(want) and [(int(r["n"]), None if r["best"] == exact_dedup._NO_ID else int(r["best"])) for r in got] == [want[k] for k in rows]
    for slots in (16, 5000):
        cut = [(s, np.frombuffer(b, exact_dedup._ENTRY)) for s, _, b in exact_dedup._dealt(got, 5, slots, 4)]
        assert (np.concatenate([b for _, b in cut]) == got).all() and all(((b["digest"][:, 0] >> np.uint64(32)).astype(int) * slots >> 32 == s).all() for s, b in cut)


def test_hot_copies_in_many_runs(spark):
    """A third of all rows has one text: no merge sees more than `fan` runs' entries of it."""
    rows = [(i, "hot" if i % 3 == 0 else f"t{i // 2}") for i in range(3000)]
    df = frame(spark, rows).repartition(6)
    got = exact_dedup.exact_duplicates(df, keep="largest", fan=4, size=50).collect()
    by = defaultdict(list)
    for d, t in rows:
        by[t].append(d)
    assert {(r["doc_id"], r["keep_id"], r["group_size"]) for r in got} == {(d, max(by[t]), len(by[t])) for d, t in rows}
    runs = exact_dedup.first_runs(exact_dedup.digests(df), 64, True, 4, 50)
    met = runs.groupBy("slot", "run").agg({"entries": "count"}).collect()
    assert len(met) > 16 and max(r[2] for r in met) <= 4 * 4


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(rows, percent):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if n and 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)]


@pytest.mark.parametrize("percent", [80, 85])
def test_near(spark, percent):
    rows = [r for r in hard_rows(3)]
    want = Counter((d, n, c, d == c) for d, n, c in brute_components(rows, percent))
    got = near_dedup.near_duplicates(frame(spark, rows), percent=percent).collect()
    assert Counter(tuple(r[c] for c in ("doc_id", "n_shingles", "component_id", "kept")) for r in got) == want
    df = frame(spark, rows)
    left = near_dedup.drop_near_copies(df, percent=percent)
    kept = {d for d, _, c in brute_components(rows, percent) if d == c and d is not None}
    assert left.columns == df.columns and {r["doc_id"] for r in left.collect() if r["doc_id"] is not None} == kept


def test_near_without_links(spark):
    assert near_dedup.near_duplicates(frame(spark, [])).count() == 0
    got = near_dedup.near_duplicates(frame(spark, [(1, None), (2, ""), (3, "a b"), (4, "c d")])).collect()
    assert all(r["kept"] for r in got)


def test_components_of_chains(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 99)], "a long, b long")
    label = {r["node"]: r["label"] for r in near_dedup.components(edges).collect()}
    assert set(label[i] for i in range(31)) == {0} and label[100] == label[99] == 99


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


def test_words_that_polynomial_hashes_confuse(spark):
    """A Thue-Morse word and its complement have one hash under any polynomial modulo 2**64."""
    one = thue_morse(4096)
    other = one.translate(str.maketrans("ab", "ba"))
    rest = " a b c d e f g h"
    rows = [(1, one + rest), (2, other + rest), (3, one), (4, other), (5, other), (6, " ".join([one, other] * 9)), (7, " ".join([other, one] * 9 + [other]))]
    want = {(d, c) for d, _, c in brute_components(rows, 85)}
    assert {(r["doc_id"], r["component_id"]) for r in near_dedup.near_duplicates(frame(spark, rows)).collect()} == want


def test_links_are_confirmed_on_words():
    import random

    rng = random.Random(5)
    for size in (3, 30, 3000):
        for _ in range(60):
            a = [f"w{rng.randrange(size)}" for _ in range(rng.randint(0, 60))]
            b = a[:]
            for _ in range(rng.randint(0, 4) if b else 0):
                b[rng.randrange(len(b))] = f"w{rng.randrange(size)}"
            x, y = " ".join(a), " ".join(b)
            s, t = shingles(x), shingles(y)
            for percent in (50, 80, 85):
                want = bool(s & t) and 100 * len(s & t) >= percent * len(s | t)
                assert near_dedup.linked(x.encode(), y.encode(), percent) == want, (x, y)


def test_hot_lists_make_few_pairs(spark, monkeypatch):
    """Many texts that share most of their words, some of them linked with each other, but none with the usual leader."""
    import random

    rng = random.Random(11)
    base = [f"b{i}" for i in range(200)]
    rows = []
    for family in range(12):
        own = base[:]
        for i in rng.sample(range(200), 8):
            own[i] = f"f{family}_{i}"
        for _ in range(20):
            words = own[:]
            for i in rng.sample(range(200), rng.choice([1, 2, 12])):
                words[i] = f"z{rng.randrange(10**9)}"
            rows.append((len(rows), " ".join(words)))
    met = []
    plain = near_dedup._verified
    monkeypatch.setattr(near_dedup, "_verified", lambda pairs, *rest: (met.append(pairs.count()), plain(pairs, *rest))[1])
    got = near_dedup.near_duplicates(frame(spark, rows), percent=85).collect()
    assert {(r["doc_id"], r["component_id"]) for r in got} == {(d, c) for d, _, c in brute_components(rows, 85)}
    assert sum(met) < 20 * len(rows) < len(rows) * (len(rows) - 1) / 2 / 4, met


def test_shingle_hashes_tell_sets_apart():
    texts = [b"a b c d e f", b"A B  C D E\tF", b"a b c d f e", b"", b"x", b"x y", b"y x"]
    s = near_dedup.shingle_sets(texts)
    assert s[0].tolist() == s[1].tolist() != s[2].tolist() and [len(x) for x in s] == [2, 2, 2, 0, 1, 1, 1]
    assert len({tuple(x) for x in s[4:]}) == 3


def brute_removed(rows):
    """By (doc_id, text): removed bytes. Equal ids and starts are not earlier."""
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - 99):
            key = (-(2**63) if d is None else d, i)
            w = b[i : i + 100]
            first[w] = min(first.get(w, key), key)
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 99):
            if first[b[i : i + 100]] < (-(2**63) if d is None else d, i):
                gone[i : i + 100] = b"\1" * 100
        rest = bytes(x for x, g in zip(b, gone) if not g)
        out.append((d, len(b), sum(gone), sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1])), hashlib.sha256(rest).hexdigest()))
    return out


@pytest.mark.parametrize("hot, group", [(3, 10**6), (10**6, 10**6), (10**6, 500)])
def test_repeated_passages(spark, monkeypatch, hot, group):
    monkeypatch.setattr(substrings, "HOT", hot)
    monkeypatch.setattr(substrings, "GROUP_BYTES", group)
    monkeypatch.setattr(substrings, "BLOCK_BYTES", 20_000)
    rows = [(d, t if t is None or len(t) < 20_000 else t[:20_000]) for d, t in hard_rows(5)]
    got = substrings.remove_repeats(frame(spark, rows)).collect()
    assert Counter(tuple(r[c] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) for r in got) == Counter(brute_removed(rows))
    assert substrings.remove_repeats(frame(spark, [])).count() == 0
    df = frame(spark, rows)
    cut = substrings.cut_repeats(df)
    assert cut.schema.names == df.schema.names
    assert all(r["text"] is None or r["n_chars"] == len(r["text"]) for r in cut.collect())


def test_stretches_of_long_documents(spark, monkeypatch):
    monkeypatch.setattr(substrings, "STRETCH", 700)
    monkeypatch.setattr(substrings, "INDEX_BYTES", 500)
    rows = [(d, (t or "")[:3000]) for d, t in hard_rows(6)]
    raw = [t.encode() for _, t in rows]
    seen = sum(n.sum() for _, _, _, n, _, _ in substrings.phrases(raw))
    assert seen == sum(max(0, len(b) - 99) for b in raw)


def test_run_index_against_brute_force():
    rng = np.random.default_rng(0)
    strings = [rng.integers(97, 99, rng.integers(5, 40)).astype(np.uint8).tobytes() for _ in range(60)]
    flat, bounds = np.frombuffer(b"".join(strings), np.uint8), np.concatenate([[0], np.cumsum([len(s) for s in strings])])
    when = rng.permutation(len(flat)).astype(np.int64)
    for width in (3, 8, 14, 20):
        hit = substrings.mark(flat, bounds, when, width)
        first = {}
        places = [(k, i, strings[k][i : i + width]) for k in range(60) for i in range(len(strings[k]) - width + 1)]
        for k, i, w in places:
            first[w] = min(first.get(w, 2**62), when[bounds[k] + i])
        want = np.zeros(len(flat), bool)
        for k, i, w in places:
            want[bounds[k] + i] = when[bounds[k] + i] > first[w]
        assert (hit == want).all() and (substrings.string_by_string(flat, bounds, when, width) == want).all()


def test_matching_statistics_against_brute_force():
    """Streamed statistics equal those of a sorted list of all suffixes, and what the index keeps has the size of its runs."""
    rng = np.random.default_rng(1)
    unit = rng.integers(97, 100, 50).astype(np.uint8).tobytes()
    for strings in ([rng.integers(97, 99, rng.integers(1, 40)).astype(np.uint8).tobytes() for _ in range(40)], [unit * int(k) for k in rng.integers(1, 6, 30)], [b"a" * int(k) for k in rng.integers(1, 60, 12)], [b"x"]):
        flat, bounds = np.frombuffer(b"".join(strings), np.uint8), np.concatenate([[0], np.cumsum([len(s) for s in strings])])
        index = rindex.RunIndex(flat, bounds)
        # Terminators sort before all letters, in the strings' order.
        texts = [[*(b + len(strings) for b in s), k] for k, s in enumerate(strings)]
        suffixes = sorted((t[i:], bounds[k] + k + i) for k, t in enumerate(texts) for i in range(len(t)))
        want = {}
        for (a, _), (b, at) in zip([([], -1), *suffixes], suffixes):
            same = next((j for j, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            want[at] = (_, same)
        got = {int(p): (int(u), int(m)) for at, above, shared in index.stream() for p, u, m in zip(at, above, shared)}
        ends = {int(e) for e in index.ends}
        assert got == {p: v for p, v in want.items() if p not in ends}
        kept = [v for v in vars(index).values() if isinstance(v, np.ndarray)]
        assert all(len(v) in (len(index.run_start), len(strings)) for v in kept)
    # The same unit again and again: the number of runs stays small.
    flat = np.frombuffer(unit * 200, np.uint8)
    index = rindex.RunIndex(flat, np.array([0, len(flat)]))
    assert len(index.run_start) < 200 and not rindex.repeated(index, np.arange(len(flat) + 1), len(flat)).any()
    assert rindex.repeated(index, np.arange(len(flat) + 1), 100)[: len(flat)].sum() == len(flat) - 99 - 50


def test_strings_that_hashes_confuse(monkeypatch):
    rng = np.random.default_rng(4)
    strings = [rng.integers(97, 99, rng.integers(1, 30)).astype(np.uint8).tobytes() for _ in range(50)]
    flat, bounds = np.frombuffer(b"".join(strings), np.uint8), np.concatenate([[0], np.cumsum([len(s) for s in strings])])
    when = rng.permutation(len(flat)).astype(np.int64)
    want = substrings.mark(flat, bounds, when, 6)
    plain = substrings._window_hash
    monkeypatch.setattr(substrings, "_window_hash", lambda buf, k: plain(buf, k) % np.uint64(7))
    monkeypatch.setattr(substrings, "SLICE", 120)
    assert (substrings.string_by_string(flat, bounds, when, 6) == want).all() and want.any()


def test_joined_ranges():
    assert substrings.joined([0, 5, 20, 21], [5, 9, 30, 25]) == [(0, 9), (20, 30)]


@pytest.mark.parametrize("percent", [80, 85])
def test_union_sketch_keeps_pairs_at_the_threshold(percent):
    from math import comb

    t, k = percent / 100, near_dedup.K
    least = t - near_dedup.SIGMAS * (t * (1 - t) / k) ** 0.5
    assert sum(comb(k, i) * t**i * (1 - t) ** (k - i) for i in range(k + 1) if i < least * k) < 1e-9
