import zlib
from collections import defaultdict

import numpy as np
import pytest

from gradlens.llm import packing
from tests.llm.common import frame, hard_rows


@pytest.fixture(scope="module")
def model():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.default_vocabulary())


def test_encoder_gives_the_vocabularys_ids(model):
    enc = packing.Encoder(packing.default_vocabulary())
    assert enc.fast is not None
    for text in ["", " ", "it's  \n\n 12\t<|endoftext|>", "naïve 漢字 🙂 \x00", "x" * 3000, *[t for _, t in hard_rows() if t]]:
        assert np.frombuffer(enc.ids(text), "<u4").tolist() == model.encode(text, add_special_tokens=False).ids


def test_added_tokens_are_themselves(model):
    enc = packing.Encoder(packing.default_vocabulary())
    ids = np.frombuffer(enc.ids("a <|endoftext|> b"), "<u4").tolist()
    assert 50256 in ids and ids == model.encode("a <|endoftext|> b", add_special_tokens=False).ids


def check(rows, got, model, limits):
    want = defaultdict(list)
    for d, t in rows:
        want[d].append(np.array([*model.encode(t or "", add_special_tokens=False).ids, 0], "<u4"))
    pieces, seqs = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r["doc_id"]].append(r)
        seqs[r["sequence_id"]].append(r)
    assert set(pieces) == set(want)
    for d, rs in pieces.items():
        assert sum(r["length"] for r in rs) == sum(len(w) for w in want[d])
        for r in rs:
            assert any(len(w) == r["doc_tokens"] and zlib.crc32(w[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for w in want[d])
        if len(want[d]) == 1:
            at = 0
            for r in sorted(rs, key=lambda r: r["start"]):
                assert r["start"] == at
                at += r["length"]
    for rs in seqs.values():
        at = 0
        for r in sorted(rs, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at <= limits.tokens and len(rs) <= limits.segments and sum(r["loss_tokens"] for r in rs) <= limits.loss_tokens
    return seqs


def test_pack_hard_rows(spark, model):
    rows = hard_rows()
    limits = packing.Limits()
    seqs = check(rows, packing.pack(frame(spark, rows)).collect(), model, limits)
    fill = sum(sum(r["length"] for r in s) for s in seqs.values()) / (1024 * len(seqs))
    assert fill > 0.97


def test_simultaneous_limits(spark, model):
    rows = [(i, "word " * (i % 40 + 1)) for i in range(300)]
    limits = packing.Limits(tokens=128, segments=4, loss_tokens=64, slot_pieces=100)
    df = frame(spark, rows).selectExpr("*", "doc_id % 5 as from")
    got = packing.pack(df, limits=limits, loss_from_col="from").collect()
    check(rows, got, model, limits)


def test_loss_limit_binds(spark, model):
    """Instruction data: prompts without loss, answers with it. The third limit closes sequences that have room for tokens."""
    rows = [(i, "word " * (60 if i % 3 else 20)) for i in range(240)]
    limits = packing.Limits(tokens=512, segments=32, loss_tokens=96, least_piece=4, slot_pieces=120)
    df = frame(spark, rows).selectExpr("*", "if(doc_id % 3 = 0, 2, 45) as from")
    seqs = check(rows, packing.pack(df, limits=limits, loss_from_col="from").collect(), model, limits)
    full = [sum(r["loss_tokens"] for r in s) > 80 and sum(r["length"] for r in s) < 480 for s in seqs.values()]
    assert sum(full) > len(full) / 2


def test_tiny_documents_fill_sequences(spark, model):
    rows = [(i, "word") for i in range(5000)]
    seqs = check(rows, packing.pack(frame(spark, rows).repartition(3)).collect(), model, packing.Limits())
    assert sum(sum(r["length"] for r in s) for s in seqs.values()) > 0.97 * 1024 * len(seqs)


def test_repeated_rows_are_spread(spark):
    df = frame(spark, [(1, "the same text")] * 4000, False).repartition(3)
    got = packing.pack(df, limits=packing.Limits(slot_pieces=500)).selectExpr("pmod(sequence_id, 8) slot").groupBy("slot").count().collect()
    assert len(got) == 8 and max(r["count"] for r in got) < 2 * 4000 * 4 / 8 and sum(r["count"] for r in got) >= 4000


def test_placement_against_brute_force():
    """A plain reading of the heuristic, item by item."""
    rng = np.random.default_rng(3)
    limits = packing.Limits(tokens=100, segments=5, loss_tokens=40)
    for _ in range(20):
        tokens = rng.integers(1, 60, 40)
        loss = np.minimum(tokens, rng.integers(0, 30, 40))
        left, want = list(range(40)), []
        while left:
            room, seq = np.array([100.0, 5, 40]), []
            while True:
                best = max(((t * room[0] / 100 / 100 + room[1] / 5 / 5 + l * room[2] / 40 / 40, -t, -l) for i in left for t, l in [(tokens[i], loss[i])] if t <= room[0] and room[1] >= 1 and l <= room[2]), default=None)
                if best is None:
                    break
                size = (-best[1], -best[2])
                left.remove(next(i for i in left if (tokens[i], loss[i]) == size))
                seq.append(size)
                room -= [size[0], 1, size[1]]
            want.append(seq)
        got = [[(tokens[i], loss[i]) for i in s] for s in packing.place(tokens, loss, limits)]
        assert [[tuple(map(int, x)) for x in s] for s in got] == [[tuple(map(int, x)) for x in s] for s in want]


def test_empty_table(spark):
    assert packing.pack(frame(spark, [])).count() == 0


def test_dot_product_and_gaps():
    tokens = np.array([700, 300, 200, 100, 24, 600])
    seqs = packing.place(tokens, tokens, packing.Limits())
    assert sorted(i for s in seqs for i in s) == list(range(6)) and all(tokens[s].sum() <= 1024 for s in seqs)
    hot = [[[i, 0, 600]] for i in range(100)]
    filled = packing.fill_gaps(hot, lambda i, a, b: b - a, packing.Limits())
    sizes = [sum(p[2] - p[1] for p in s) for s in filled]
    assert sum(sizes) == 60_000 and len(filled) <= 60 and max(sizes) <= 1024
    with pytest.raises(ValueError):
        packing.place(np.array([2000]), np.array([0]), packing.Limits())
