"""Small tables with all that real ones can hold."""

import random

WORDS = [f"w{i}" for i in range(400)]


def text_of(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(n))


def hard_rows(seed: int = 0) -> list[tuple]:
    """(doc_id, text): nulls, empty and very long texts, copies, near copies, repeated rows, shared passages, odd characters."""
    rng = random.Random(seed)
    base, passage = text_of(rng, 120), text_of(rng, 60)
    rows = [(1, base), (2, base), (3, None), (4, ""), (5, " \n\t "), (6, "one two"), (7, "one two"), (8, text_of(rng, 30_000)), (None, base), (None, None), (9, "one two three four"), (10, "naïve Ünïcode 漢字 🙂 ▁ \x00 \x85\xa0 end " * 20)]
    for i in range(11, 41):
        words = base.split()
        for _ in range(rng.randint(1, 6)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    for i in range(41, 61):
        rows.append((i, text_of(rng, 50) + " " + passage + " " + text_of(rng, rng.randint(1, 200))))
    rows += [(61, passage * 3), (62, "a" * 500), (63, "a" * 300 + "b"), (64, "ab" * 200)]
    rows += [rows[0], rows[20]]  # repeated rows
    return rows


def frame(spark, rows, extra: bool = True):
    """doc_id, text and columns whose names the operators use inside."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    if extra:
        df = df.selectExpr("*", "'en' lang", "'s' source", "cast(length(text) as long) n_chars", "1 slot", "2 rep", "3 label", "4 digest", "5 block", "6 kept", "7 bucket")
    return df
