"""Hard negatives, the filter audit and the language model against plain brute force, on small awkward tables."""

import math
import random
import re
import zlib
from fractions import Fraction
from itertools import permutations

import numpy as np
import pytest

from duelframe.llm import filter_audit, hard_negatives, language_model

# ---- hard negatives

VECTORS = "vec_id long, embedding array<float>, label int, score long, block string, n int, of int"


def vectors(rng, n, dims=6):
    out = []
    for i in range(n):
        label = rng.randrange(4)
        v = [rng.gauss(0, 0.2) + (0.5 if d == label else 0) for d in range(dims)]
        out.append([i, v, label])
    for i in range(1, n, 9):  # ties: the vector and label of the row before
        out[i][1:] = out[i - 1][1:]
    return [tuple(r) for r in out]


def brute_negatives(rows, positives=5, negatives=3, every=50):
    used = []
    for i, v, label in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        if i is not None and i % 7 == 0:
            label = (label + 1) % 10
        used.append((i, [math.floor(256 * float(np.float32(x))) for x in v], label))
    first = lambda s: (-s[0], s[1] is None, s[1] or 0)
    out = []
    for k, (anchor, q, label) in enumerate(used):
        if anchor is None or anchor % every:
            continue
        scored = [(sum(a * b for a, b in zip(q, v)), i, other) for j, (i, v, other) in enumerate(used) if j != k]
        for p, pid, _ in sorted((s for s in scored if s[2] == label), key=first)[:positives]:
            window = [s for s in scored if s[2] != label and 50 * p <= 100 * s[0] <= 95 * p]
            out += [(anchor, pid, r, nid, p, s) for r, (s, nid, _) in enumerate(sorted(window, key=first)[:negatives], 1)]
    return sorted(map(str, out))


def as_rows(df):
    return sorted(str((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score)) for r in df.collect())


@pytest.mark.parametrize("blocks", [(32_768, 1_024), (7, 2)])
def test_hard_negatives_equal_brute_force(spark, blocks):
    rows = vectors(random.Random(3), 260)
    rows += [(300, None, 1), (350, [0.1] * 6, None), (400, [0.1, None, 0.2, 0.0, 0.0, 0.0], 2), (450, [float("nan")] * 6, 2),
             (500, [float("inf")] + [0.0] * 5, 3), (None, [0.4] * 6, 1), (None, [0.5] * 6, 2), (550, [0.0] * 6, 1),
             (600, [0.6, 0.5], 0), (-50, [0.3] * 6, 2), (650, [-0.9] * 6, 3)]
    rows += [rows[100], rows[100], rows[17]]  # repeated rows, an anchor among them
    table = spark.createDataFrame([(*r, 1, "x", 2, 3) for r in rows], VECTORS).repartition(3)
    found = hard_negatives.mine(table, block=blocks[0], anchor_block=blocks[1])
    expected = brute_negatives(rows)
    assert len(expected) > 20
    assert as_rows(found) == expected


def test_hard_negatives_of_nothing(spark):
    assert hard_negatives.mine(spark.createDataFrame([], VECTORS)).count() == 0
    one = spark.createDataFrame([(50, [0.5, 0.5], 1, 1, "x", 2, 3)], VECTORS)
    assert hard_negatives.mine(one).count() == 0


def test_scan_drops_rows_before_all_columns_are_read():
    rng = np.random.default_rng(1)
    x = np.rint(rng.normal(0, 40, (200, 32))).astype(np.int32)
    x[:10] += 120

    class Row:
        n, dims, ids, vectors = 200, 32, np.arange(200).tobytes(), np.ascontiguousarray(x.T).tobytes()

    rows, left = hard_negatives.Block(Row), []
    q = np.full(32, 100, np.int32)

    def keep(low, high):
        stay = high >= hard_negatives.kth_largest(low, 5)
        left.append(int(stay.sum()))
        return stay

    live, score = hard_negatives.scan(q, rows, keep, 4)
    whole = x.astype(np.int64) @ q
    assert (score == whole[live]).all() and set(np.argsort(-whole)[:5]) <= set(live.tolist())
    assert left[-2] < 50  # fewer than all rows before the last columns


def test_large_components_stay_exact(spark):
    rows = [(i, [1e12 if i % 2 else -3e9, 250_000.5, float(i)], i % 2) for i in range(0, 120, 5)]
    table = spark.createDataFrame([(*r, 1, "x", 2, 3) for r in rows], VECTORS)
    limit = hard_negatives.LARGEST / 256
    cut = [(i, [max(-limit, min(limit, float(np.float32(x)))) for x in v], k) for i, v, k in rows]
    assert as_rows(hard_negatives.mine(table)) == brute_negatives(cut)


# ---- filter audit

DOCS = "doc_id long, text string, lang string, mask string, sha string, n long, good int, own int"
LABELS = "doc_id long, quality int, toxic int, id long"


def fails(rows):
    out = []
    for doc, text, _ in rows:
        text = text or ""
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
        smaller = any(d is not None and doc is not None and d < doc and (t or "") == text for d, t, _ in rows)
        out.append((len(words) < 100, 100 * len(set(words)) < 80 * len(words),
                    100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text), any(c in "#$%&*|" for c in text), smaller))
    return out


def brute_audit(rows, labels):
    failed, out = fails(rows), []
    good = {d for d, q, _ in labels if d is not None and q == 1}
    bad = {d for d, _, t in labels if d is not None and t == 1}
    for part in {r[2] or "" for r in rows}:
        mine = [(r[0], f) for r, f in zip(rows, failed) if (r[2] or "") == part]
        totals = dict.fromkeys(range(5), 0)
        steps = []
        for order in permutations(range(5)):
            left = list(mine)
            for step, f in enumerate(order, 1):
                gone = [x for x in left if x[1][f]]
                left = [x for x in left if not x[1][f]]
                totals[f] += len(gone)
                steps.append([part, "".join("ABCDE"[k] for k in order), step, len(left), len(gone),
                              sum(x[1][f] for x in mine) - len(gone), sum(x[1][f] and sum(x[1]) == 1 for x in mine),
                              sum(x[0] in good for x in gone), sum(x[0] in bad for x in gone), f])
        out += [tuple(s[:-1]) + (totals[s[-1]],) for s in steps]
    return sorted(out)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(8)
    word = lambda: rng.choice(["tree", "Stone", "über", "RIVER", "x", "42", "of", "no$e"]) + str(rng.randrange(60))
    rows = [(i, " ".join(word() for _ in range(rng.choice([5, 99, 100, 130, 400]))), rng.choice(["en", "de", None, ""])) for i in range(60)]
    rows += [(60 + i, rows[rng.randrange(9)][1], "en") for i in range(15)]  # copies
    rows += [(None, rows[3][1], "en"), (None, rows[3][1], "fr"), rows[5], (80, None, "en"), (81, "", "fr"), (82, " \n\t ", None),
             (83, " ".join(f"w{k}" for k in range(30_000)), "en"), (84, "A" * 9 + "b" * 81, "en"), (85, "A" * 10 + "b" * 81, "en")]
    return rows


def test_audit_equals_brute_force(spark, texts):
    rng = random.Random(2)
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 86, 2)] + [(None, 1, 1), (4, 1, 0), (4, 0, 1)]
    found = filter_audit.audit(spark.createDataFrame([(*t, "m", "s", 1, 2, 3) for t in texts], DOCS).repartition(3),
                               spark.createDataFrame([(*x, 9) for x in labels], LABELS))
    assert sorted(tuple(r) for r in found.collect()) == brute_audit(texts, labels)


def test_audit_of_nothing(spark):
    nothing = spark.createDataFrame([], DOCS)
    assert filter_audit.audit(nothing, spark.createDataFrame([], LABELS)).count() == 0
    one = filter_audit.audit(spark.createDataFrame([(1, None, None, "m", "s", 1, 2, 3)], DOCS), spark.createDataFrame([], LABELS))
    assert one.count() == 600 and one.where("filter_order = 'ABCDE' AND step = 1 AND removed = 1 AND shapley = 120").count() == 1


def test_least_squares_give_the_shapley_values():
    rng = random.Random(4)
    for players in (1, 2, 3, 5):
        values = [0] + [rng.randrange(1000) for _ in range(2 ** players - 1)]
        plain = [Fraction(0)] * players
        orders = list(permutations(range(players)))
        for order in orders:
            before = 0
            for f in order:
                plain[f] += Fraction(values[before | 1 << f] - values[before], len(orders))
                before |= 1 << f
        assert filter_audit.shapley_values(values, players) == plain


# ---- language model

TEXTS = "doc_id long, text string, words string, n long, held boolean, block int"


def plain_model(rows, order, mu):
    """Counts of token tuples, and the recursion as it is defined."""
    held = [zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2 for d, _ in rows]
    tokens = [[w.lower() for w in (t or "").encode().split()] + ["end"] for _, t in rows]
    counts = {}
    for h, t in zip(held, tokens):
        if not h:
            padded = ["begin", *t]
            for n in range(1, order + 1):
                for i in range(len(padded) - n + 1):
                    g = tuple(padded[i:i + n])
                    counts[g] = counts.get(g, 0) + 1
    learned = [w for h, t in zip(held, tokens) if not h for w in t]
    total, types = len(learned), len(set(learned))

    def p(context, word):
        if not context:
            return (counts.get((word,), 0) + 1) / (total + types + 1)
        m = mu[len(context) - 1]
        return (counts.get((*context, word), 0) + m * p(context[1:], word)) / (counts.get(context, 0) + m)

    out = []
    for (doc, _), h, t in zip(rows, held, tokens):
        padded = ["begin", *t]
        score = sum(math.log10(p(tuple(padded[max(0, i - order + 1):i]), padded[i])) for i in range(1, len(padded)))
        base = sum(math.log10((counts.get((w,), 0) + 1) / (total + types + 1)) for w in t)
        out.append((doc, h, len(t), sum((w,) in counts for w in t), total, base, score))
    return out, p, set(learned)


def sentences(rng, n):
    return " ".join(rng.choice(["the", "Of", "stone", "river", "moon", "gläser", "ÄX", "42"]) + rng.choice(["", "", "s"]) for _ in range(n))


@pytest.mark.parametrize("order,tokens", [(1, 2_000_000), (2, 60), (3, 2_000_000), (3, 60), (4, 200)])
def test_scores_equal_the_plain_model(spark, order, tokens):
    rng = random.Random(6)
    rows = [(i, sentences(rng, rng.choice([0, 1, 2, 7, 40]))) for i in range(70)]
    rows += [(100, None), (101, ""), (102, " \n\t "), (None, "the moon"), (None, None), rows[3], rows[3], (103, "unknown-%d " * 3),
             (104, "a b\x1cc \x0bd"), (105, sentences(rng, 3000))]
    rows += [(200 + i, rows[40][1]) for i in range(9)]  # copies, held out and not
    mu = (30.0, 4.0, 2.0)
    docs = spark.createDataFrame([(*r, "w", 1, True, 2) for r in rows], TEXTS).repartition(3)
    found = [tuple(r) for r in language_model.scores(docs, order=order, mu=mu, tokens=tokens, bucket=50).collect()]
    expected, _, _ = plain_model(rows, order, mu)
    key = lambda r: (r[0] is None, r[0] or 0, r[2], round(r[6], 6))
    found, expected = sorted(found, key=key), sorted(expected, key=key)
    assert [f[:5] for f in found] == [e[:5] for e in expected]
    assert np.allclose([f[5:] for f in found], [e[5:] for e in expected], rtol=1e-9, atol=1e-9)


def test_model_sums_up_to_one():
    rng = random.Random(9)
    rows = [(i, sentences(rng, 30)) for i in range(20)]
    _, p, words = plain_model(rows, 3, (30.0, 4.0))
    for context in ((), (b"the",), (b"the", b"moon"), ("begin",), (b"never", b"seen")):
        assert math.isclose(sum(p(context, w) for w in words) + p(context, "unknown"), 1)


def test_scores_of_nothing(spark):
    assert language_model.scores(spark.createDataFrame([], TEXTS)).count() == 0
    held = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 7 == 2)
    only = language_model.scores(spark.createDataFrame([(held, "a b", "w", 1, True, 2)], TEXTS)).first()
    assert (only.train_tokens, only.n_known, only.base_score, only.score) == (0, 0, 0, 0)


def test_held_out_texts_are_likelier_than_under_single_words(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/../sf0.01/documents.parquet")
    held = language_model.scores(docs).where("held_out").selectExpr("sum(score) AS s", "sum(base_score) AS b").first()
    assert held.s > 0.9 * held.b
