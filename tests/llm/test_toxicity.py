import itertools
import random

from pyspark.sql import functions as F

from gradlens.llm import toxicity as tox
from tests.llm.common import frame, hard_rows

AIMED, NEGATED, REPORTED = tox.AIMED, tox.NEGATED, tox.REPORTED


def matches(m, text):
    return [[out for out, _ in found] for found in m.clauses(text)]


def test_contexts():
    m = tox.Matcher({"idiot": 2.0, "scum*": 1.0})
    i = tox.INSULT
    assert matches(m, "what an idiot") == [[i]]
    assert matches(m, "you are an idiot") == [[i | AIMED]]
    assert matches(m, "not an idiot, you idiot") == [[i | NEGATED], [i | AIMED]]
    assert matches(m, "she said it was no real idiot") == [[i | AIMED | NEGATED | REPORTED]] or matches(m, "they wrote of no real idiot") != []
    assert matches(m, "i will kill you") == [[tox.MENACE]] and matches(m, "kill the lights") == [] and matches(m, "") == []
    assert matches(m, "never kill you") == [[tox.MENACE | NEGATED]] and matches(m, "a man wrote kill them") == [[tox.MENACE | REPORTED]]
    assert matches(m, "the SCUMBAG!") == [[i]]
    # A word alone is no clause.
    assert matches(m, "idiot") == matches(m, "SCUMBAG!") == matches(m, "idiot. idiot!") == []


def test_order_of_contexts():
    m = tox.Matcher({"idiot": 2.0, "fool": 5.0})
    weigh = lambda t: m.features(t)[0]
    for w in ("idiot", "fool"):
        order = [weigh(t) for t in (f"a man wrote {w} here", f"not an {w} here", f"what an {w} here", f"you are an {w} here", "i will kill you here")]
        assert all(a < b for a, b in zip(order, order[1:])) and order[0] > 0, order
    model = tox.Model({"idiot": 2.0}, 1.5, -3.0)
    assert model.slope > 0 and model.matcher().features("i will hurt you")[0] > 0


def test_composition_against_the_cascade():
    """Every class sequence up to four words through the composed machine and through its parts one after another."""
    parts = [tox._context(tox.TARGET, AIMED, (tox.INSULT,), tox.REACH), tox._context(tox.NEGATION, NEGATED, (tox.INSULT, tox.THREAT), tox.REACH), tox._context(tox.REPORT, REPORTED, (tox.INSULT, tox.THREAT), None), tox._threats(), tox._frame()]
    whole = tox.grammar()
    for n in range(1, 5):
        for seq in itertools.product(range(tox.CLASSES), repeat=n):
            state, states = 0, [0] * len(parts)
            for x in seq:
                state, out, w = whole.step(state, x)
                symbol, weight = x, 1.0
                for k, part in enumerate(parts):
                    states[k], symbol, v = part.step(states[k], symbol)
                    weight *= v
                assert (out, round(w, 12)) == (symbol, round(weight, 12)), seq
            end = 1.0
            for k, part in enumerate(parts):
                end *= part.final.get(states[k], 1.0)
            assert whole.final[state] == end == (n > 1)


def test_lexicon_reads_letters():
    lex = tox.Lexicon({"idiot": 2.0, "scum*": 1.0, "scumbag": 3.0})
    assert lex.read("idiot") == (tox.INSULT, 2.0) and lex.read("idiots") == (tox.OTHER, 1.0)
    assert lex.read("scummy") == (tox.INSULT, 1.0) and lex.read("scum") == (tox.OTHER, 1.0) and lex.read("scumbag") == (tox.INSULT, 3.0)
    assert lex.read("you") == (tox.TARGET, 1.0) and lex.read("nicht")[0] == tox.NEGATION and lex.read("kill")[0] == tox.THREAT


def corpus(rng, n):
    """Toxic rows insult or threaten; clean ones deny or report the same insults, or have none."""
    plain = [f"word{i}" for i in range(80)]
    words = lambda k: " ".join(rng.choice(plain) for _ in range(k))
    rows, labels = [], []
    for i in range(n):
        insult = rng.choice(["zorbling", "vexit", "grumt"])
        bad = {0: f"you are a {insult}", 1: f"what a {insult} that was", 2: "i will kill you"}
        good = {0: f"this is not a {insult}", 1: f"a man wrote {insult} on it", 2: words(4), 3: f"no {insult} here"}
        y = i % 3 == 0
        # All rows have the frames' other words.
        rows.append((i, f"{words(10)}. you are a friend, what a day that was, i will call you, kill the lights. {(bad if y else good)[rng.randrange(3 if y else 4)]}. {words(10)}"))
        labels.append((i, int(y)))
    return rows, labels


def test_learning_and_ablation(spark):
    rows, labels = corpus(random.Random(4), 900)
    df = frame(spark, rows)
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    truth, rate = dict(labels), {}
    for contexts in (True, False):
        model = tox.fit(df, lab.filter(tox.fold("doc_id", 5) != 0), contexts=contexts)
        assert {"zorbling", "vexit", "grumt"} <= set(model.insults)
        held = tox.score_toxicity(df.filter(tox.fold("doc_id", 5) == 0), model).collect()
        rate[contexts] = sum((r["score"] >= 0.5) == truth[r["doc_id"]] for r in held) / len(held)
    assert rate[True] > 0.98 and rate[False] < 0.8, rate


def test_same_model_whatever_the_order(spark):
    """Repeated texts with conflicting labels: neither partitions nor order matter."""
    rows, labels = corpus(random.Random(7), 300)
    rows += [(1000 + i, rows[i][1]) for i in range(60)]
    labels += [(1000 + i, 1 - labels[i][1]) for i in range(60)]
    df, lab = frame(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    one = tox.fit(df.coalesce(1), lab.coalesce(1))
    assert one == tox.fit(df.repartition(7, "text"), lab.repartition(5)) == tox.fit(df.orderBy(F.desc("doc_id")), lab.orderBy(F.rand(3)))


def test_edges(spark):
    rows = [*hard_rows(), (500, "you idiot"), (500, "you idiot"), (501, "word " * 200_000 + "you idiot"), (502, None), (503, "")]
    df = frame(spark, rows)
    model = tox.Model({"idiot": 4.0}, 2.0, -2.0)
    got = tox.score_toxicity(df, model).collect()
    by = {r["doc_id"]: r["score"] for r in got}
    assert len(got) == len(rows) and by[500] > 0.5 and by[501] > 0.5 and by[502] == by[503] < 0.5
    assert all(0 <= r["score"] <= 1 for r in got) and tox.score_toxicity(df.limit(0), model).count() == 0
    lab = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (None, 1), (3, None)], "doc_id long, toxic int")
    none = tox.fit(df, lab.limit(0))
    assert {r["score"] for r in tox.score_toxicity(df, none).collect()} == {0.5}
    assert tox.fit(df, lab).slope >= tox.LEAST_SLOPE
