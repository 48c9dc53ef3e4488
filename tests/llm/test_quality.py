import re
from collections import Counter

import zstandard

from gradlens.llm import quality
from tests.llm.common import frame, hard_rows

WORD = re.compile("[^\x20\x09-\x0d]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    inside = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(inside), len(words) < 50 or 100 * len(inside) > 50 * len(words)


def test_counts_and_verdicts(spark):
    rows = [*hard_rows(), (70, "a b c a b c\na b c\n\n a b c \na b c"), (71, "x|y <b> #1 $ % & *")]
    got = quality.score_quality(frame(spark, rows)).collect()
    want = Counter((d, *plain(t)) for d, t in rows)
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert Counter(tuple(r[n] for n in names) for r in got) == want
    assert not any(r["kept"] for r in got if r["base_failed"])
    assert quality.score_quality(frame(spark, [])).count() == 0


def plain_verdict(text):
    """(kept, ratio, share of bytes in bad chunks) by the rules as they are stated."""
    raw = (text or "").encode()
    squeezed = lambda b: len(b) / len(zstandard.ZstdCompressor(level=quality.LEVEL).compress(b))
    inside = lambda bands, b: [x.least <= squeezed(b) <= x.most for x in bands if len(b) < x.below][0]
    if not raw:
        return False, 0.0, 0.0
    chunks = [raw[i : i + quality.CHUNK] for i in range(0, len(raw), quality.CHUNK)]
    share = sum(len(c) for c in chunks if not inside(quality.CHUNK_BANDS, c)) / len(raw)
    return not plain(text)[-1] and inside(quality.DOCUMENT_BANDS, raw) and share <= quality.BAD_SHARE, squeezed(raw), share


def test_band_verdicts_against_brute_force(spark):
    import random

    rng = random.Random(3)
    letters = lambda n, k: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz   "[:k]) for _ in range(n))
    rows = [*hard_rows(2)] + [(200 + i, letters(rng.choice([50, 127, 128, 511, 512, 2047, 2048, 4096, 4097, 8192, 40_000]), rng.randint(2, 29))) for i in range(150)]
    rows += [(400 + i, letters(6000, 29) + letters(rng.randint(1, 9000), 3)) for i in range(20)]
    got = quality.score_quality(frame(spark, rows)).collect()
    want = Counter((d, kept, round(ratio, 9), round(share, 9)) for d, t in rows for kept, ratio, share in [plain_verdict(t)])
    assert Counter((r["doc_id"], r["kept"], round(r["ratio"], 9), round(r["bad_chunk_share"], 9)) for r in got) == want
    assert {k for _, k, _, _ in want} == {True, False} and any(0 < x[3] < 1 for x in want)


def test_bands_reject_repetition_and_noise(spark):
    import random
    import string

    rng = random.Random(1)
    prose = " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 8))) for _ in range(600))
    noise = " ".join("".join(rng.choice(string.printable[:94]) for _ in range(7)) for _ in range(400))
    looped = " ".join(f"{a} {b}" for a in ("alpha", "beta") for b in ("one", "two", "three", "four")) * 80
    import zstandard

    z = zstandard.ZstdCompressor(level=3)
    assert quality.bands(prose.encode(), z)[2]
    assert not quality.bands(noise.encode(), z)[2] and not quality.bands(looped.encode(), z)[2]
    assert quality.bands(b"", z) == (0.0, 0.0, False)
    df = frame(spark, [(1, prose), (2, noise), (None, prose), (3, None)])
    kept = quality.keep_good(df)
    assert kept.schema == df.schema and sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "None"]
