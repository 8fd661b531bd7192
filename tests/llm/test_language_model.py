"""The language model against counts made plainly, an exact recurrence, and a sampler that seats one customer at a time."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")

from loomwright.llm import language_model as lm  # noqa: E402
from loomwright.llm.common import held_out  # noqa: E402

WORDS = [a + b + c for a in ("th", "er", "on", "st", "re") for b in ("a", "e", "ou", "i") for c in ("nd", "r", "sh", "")]


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS[: 20 + seed % 40]) for _ in range(n))


def tokens(text):
    lower = (text or "").translate(str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)}))
    return [w for w in re.split(r"[\x20\x09-\x0d]+", lower) if w] + [None]


def out(i):
    return zlib.crc32(str(i).encode()) % 7 == 2


TEXTS = [prose(i, 30 + i) for i in range(50)] + [prose(3, 33), None, "", " \t", "É A a\u00a0b", "x" * 5000, "unseen " * 3, prose(9, 3000)]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([(i, t, "c", 1) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "c", 1)], "doc_id long, text string, chunk string, kind int").repartition(3).cache()


@pytest.fixture(scope="module")
def scored(table):
    return lm.score_texts(table, held_out("doc_id", 7, 2)).collect()


def test_counts(scored):
    own = {i: tokens(t) for i, t in enumerate(TEXTS)}
    c = Counter(w for i, t in [*own.items(), (3, own[3])] if not out(i) for w in t)
    n, v = c.total(), len(c)
    assert len(scored) == len(TEXTS) + 1
    for r in scored:
        t = own[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out(r.doc_id), len(t), sum(c[w] > 0 for w in t), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t)) and r.score < 0
        assert r.perplexity == pytest.approx(10 ** (-r.score / len(t)))
    assert len({r.score for r in scored if r.doc_id in (3, 50)}) == 1  # equal texts


def test_empty_and_untrained(table, spark):
    assert lm.score_texts(table.limit(0), held_out("doc_id", 7, 2)).count() == 0
    untrained = spark.createDataFrame([(2, "a b"), (None, "a")], "doc_id long, text string")
    got = sorted((r.n_tokens, r.n_known, r.score) for r in lm.score_texts(untrained.where("doc_id = 2"), held_out("doc_id", 1, 0)).collect())
    assert got == [(3, 0, 0.0)] and lm.score_texts(untrained, held_out("doc_id", 7, 9)).count() == 2


def sequential(texts, train, sweeps=40, burn_in=15, seed=1):
    """The same model, seated one customer at a time, with tables that have a size and parents that follow at once."""
    rng = random.Random(seed)
    pairs = Counter((a, b) for t in train for a, b in zip(["^", *t], t))
    c = Counter(w for t in train for w in t)
    v = len(c)
    d1 = lm.discount(sum(n == 1 for n in pairs.values()), sum(n == 2 for n in pairs.values()))
    d0 = lm.discount(sum(n == 1 for n in c.values()), sum(n == 2 for n in c.values()))
    child, root = defaultdict(lambda: defaultdict(list)), defaultdict(list)
    n_child, n_root = Counter(), [0, 0]  # customers, tables

    def p_root(w):
        own, t = sum(root[w]), len(root[w])
        return (max(own - d0 * t, 0) + (lm.ROOT_STRENGTH + d0 * n_root[1]) / (v + 1)) / (lm.ROOT_STRENGTH + n_root[0])

    def seat(tables, d, opening):
        weights = [k - d for k in tables] + [opening]
        x = rng.random() * sum(weights)
        for k, w in enumerate(weights):
            x -= w
            if x < 0 or k == len(tables):
                break
        if k == len(tables):
            tables.append(1)
            return True
        tables[k] += 1
        return False

    def leave(tables):
        x = rng.randrange(sum(tables))
        for k, n in enumerate(tables):
            x -= n
            if x < 0:
                tables[k] -= 1
                if not tables[k]:
                    del tables[k]
                    return True
                return False

    t_child = Counter()

    def enter(a, b):
        if seat(child[a][b], d1, (lm.STRENGTH + d1 * t_child[a]) * p_root(b)):
            t_child[a] += 1
            n_root[1] += seat(root[b], d0, (lm.ROOT_STRENGTH + d0 * n_root[1]) / (v + 1))
            n_root[0] += 1
        n_child[a] += 1

    customers = [x for x, n in pairs.items() for _ in range(n)]
    for a, b in customers:
        enter(a, b)
    total = defaultdict(float)
    for k in range(sweeps):
        for a, b in rng.sample(customers, len(customers)):
            if leave(child[a][b]):
                t_child[a] -= 1
                n_root[1] -= bool(leave(root[b]))
                n_root[0] -= 1
            n_child[a] -= 1
            enter(a, b)
        if k >= burn_in:
            for t in texts:
                for a, b in set(zip(["^", *t], t)):
                    if (k, a, b) not in total:
                        total[k, a, b] = 1
                        back = lm.STRENGTH + d1 * t_child[a]
                        own = child[a].get(b, [])
                        total[a, b] += (max(sum(own) - d1 * len(own), 0) + back * p_root(b)) / (lm.STRENGTH + n_child[a]) / (sweeps - burn_in)
    return [sum(math.log10(total[a, b]) for a, b in zip(["^", *t], t)) for t in texts]


def test_scores_follow_a_sequential_sampler(scored):
    own = {i: tokens(t) for i, t in enumerate(TEXTS)}
    train = [own[r.doc_id] for r in scored if not r.held_out]
    picked = [r for r in scored if r.n_tokens < 200][:40]
    want = sequential([own[r.doc_id] for r in picked], train)
    got = [r.score for r in picked]
    assert sum(got) == pytest.approx(sum(want), rel=0.01)
    assert max(abs(a - b) / abs(b) for a, b in zip(got, want)) < 0.05


def test_scores_do_not_depend_on_how_the_table_is_cut(spark, table, scored):
    key = lambda rows: sorted((r.doc_id, r.score) for r in rows)
    cut = key(lm.score_texts(table.repartition(11), held_out("doc_id", 7, 2)).collect())
    assert [i for i, _ in cut] == [i for i, _ in key(scored)]
    assert [s for _, s in cut] == pytest.approx([s for _, s in key(scored)], rel=1e-6)
    # other numbers of buckets and chunks give other random draws, and nothing else
    cut = key(lm.score_texts(table.repartition(7), held_out("doc_id", 7, 2), chunk_bytes=3000, least=5).collect())
    assert [s for _, s in cut] == pytest.approx([s for _, s in key(scored)], rel=0.05)
    assert sum(s for _, s in cut) == pytest.approx(sum(s for _, s in key(scored)), rel=0.005)


def table_weights(c, theta, p, d):
    """Distribution of the tables of c customers of a dish by the recurrence of the generalised Stirling numbers."""
    w = np.array([0.0, 1.0])
    for k in range(1, c):
        t = np.arange(len(w))
        w = np.append((k - d * t) * w, 0) + np.append(0, w) * (theta + d * np.arange(-1, len(w))) * p / theta / p * theta * p
        w /= w.sum()
    return w


@pytest.mark.parametrize(("c", "theta", "p", "d"), [(2, 0.5, 0.4, 0.8), (20, 3.0, 0.3, 0.5), (60, 9.0, 0.5, 0.7), (1000, 40.0, 0.1, 0.6)])
def test_tables_are_drawn_from_their_distribution(c, theta, p, d):
    n = 20000
    h = np.random.default_rng(c).integers(0, 2**63, n).astype(np.uint64)
    got = lm.drawn_tables(np.full(n, c), np.full(n, theta), np.full(n, p), d, np.ones(n), h, 0)
    want = table_weights(c, theta, p, d)
    mean = (want * np.arange(len(want))).sum()
    spread = math.sqrt((want * np.arange(len(want)) ** 2).sum() - mean**2)
    assert abs(got.mean() - mean) < 5 * spread / math.sqrt(n) + 1e-9 and got.std() == pytest.approx(spread, rel=0.05)


def test_many_customers_are_drawn_near_their_distribution():
    for c, opening, d in ((1500, 2.0, 0.5), (2500, 200.0, 0.8), (2000, 20.0, 0.3)):
        w = np.array([0.0, 1.0])
        for k in range(1, c):
            w = np.append((k - d * np.arange(len(w))) * w, 0) + opening * np.append(0, w)
            w /= w.sum()
        mean = (w * np.arange(len(w))).sum()
        spread = math.sqrt((w * np.arange(len(w)) ** 2).sum() - mean**2)
        got = lm.spread_of_tables(np.array([float(c)]), np.array([opening]), d)
        assert got[0][0] == pytest.approx(mean, rel=0.03) and got[1][0] == pytest.approx(spread, rel=0.1)
