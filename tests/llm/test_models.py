"""Operators 2 and 4 against versions of their own: features, ratios, losses and scores by plain loops."""

import itertools
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from cindermill.llm import learning, quality, toxicity

M64 = (1 << 64) - 1


# --- 2: n-grams, naive Bayes ratios, logistic regression --------------------------------------------------------------
def mix_by_hand(h, seed):
    h = (h + 0xA0761D6478BD642F * (seed + 1)) & M64
    h = ((h ^ (h >> 30)) * 0xBF58476D1CE4E5B9) & M64
    h = ((h ^ (h >> 27)) * 0x94D049BB133111EB) & M64
    return h ^ (h >> 31)


def grams_by_hand(text):
    data = (" " + re.sub(r"\s+", " ", (text or "").lower()).strip() + " ").encode()
    return {mix_by_hand(sum((data[i + k] + 1) * pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(n)) & M64, n) >> 44 for n in (4, 6, 8) for i in range(len(data) - n + 1)}


def small_corpus():
    rng = random.Random(31)
    words = "sun river stone walk green quiet table light wind house".split()
    texts = [" ".join([rng.choice(words) for _ in range(rng.randint(3, 12))] + (["blargh"] if i % 3 == 0 else [])) for i in range(40)]
    return texts, np.array([float(i % 3 == 0) for i in range(40)])


def test_toxicity_equals_brute_force():
    texts, y = small_corpus()
    weights = np.where(y == 1, 2.0, 0.5)
    model = toxicity.train(texts, y, weights)
    sets = [grams_by_hand(t) for t in texts]
    assert all(set(toxicity.distinct_grams(t).tolist()) == s for t, s in zip(texts, sets, strict=True))
    rows = [sum(y == 0), sum(y == 1)]
    ratio = {}
    for g in set().union(*sets):
        n = [sum(1 for s, k in zip(sets, y, strict=True) if k == c and g in s) for c in (0, 1)]
        if sum(n) >= 4:
            ratio[g] = math.log((n[1] + 1) / (rows[1] + 2)) - math.log((n[0] + 1) / (rows[0] + 2))
    kept = {int(f) for f in model.features}
    assert kept == {g for g, r in ratio.items() if abs(r) > 1e-7}
    # The fitted weights are those of a logistic regression on the features scaled by their ratios: there the gradient of its loss is nothing.
    fitted = {g: w / ratio[g] for g, w in zip(model.features.tolist(), model.weights, strict=True)}
    gradient, slope = {g: fitted[g] for g in kept}, 0.0
    for s, k, w in zip(sets, y, weights, strict=True):
        z = model.intercept + sum(fitted[g] * ratio[g] for g in s & kept)
        p = 1 / (1 + math.exp(-z))
        slope += w * (p - k)
        for g in s & kept:
            gradient[g] += w * (p - k) * ratio[g]
    assert abs(slope) < 0.05 and max(map(abs, gradient.values())) < 0.05
    score = toxicity._Score(model)()
    for text in [*texts, None, "", "something blargh else"]:
        z = model.intercept + sum(fitted[g] * ratio[g] for g in grams_by_hand(text) & kept)
        assert score(text)[0] == pytest.approx(1 / (1 + math.exp(-z)))


# --- 4: line features, chain, length-weighted marginals ---------------------------------------------------------------
def features_by_hand(text):
    """The feature numbers of each line, from the definition of each measure."""
    lines = (text or "").split("\n")
    edges = list(quality.EDGES.values())
    start = [sum(len(e) + 1 for e in edges[:m]) for m in range(len(edges))]
    own_size = sum(len(e) + 1 for e in edges)
    own = []
    for k, line in enumerate(lines):
        words = line.split()
        n, w = len(line), len(words)
        seen = lines[:k].count(line)
        if not words:
            values = [0] * 12 + [seen, 0]
        else:
            low = [x.lower() for x in words]
            letters = sum(c.isalpha() for c in line if not c.isdigit())
            digits, blanks = sum(c in "0123456789" for c in line), line.count(" ")
            odd = sum(not (c.isalnum() or c == "_" or c.isspace() or c in ".,;:!?'\"()-") for c in line)
            last = line.rstrip()[-1]
            values = [
                n, w, (n - blanks) / w, sum(x.isupper() for x in words) / w, digits / n, max(0, n - letters - blanks - digits) / n, odd / n, len(set(low)) / w, max(map(low.count, low)) / w,
                sum(a == b for a, b in itertools.pairwise(low)) / w, sum(len(x) <= 3 for x in words) / w, sum(line.count(c) for c in ".!?") / w, seen, 2 if last in ".!?\"'" else 1 if last.isalnum() else 0,
            ]
        own.append([start[m] + sum(v >= e for e in edges[m]) for m, v in enumerate(values)])
    out = []
    for k, row in enumerate(own):
        before = [x + own_size for x in own[k - 1]] if k else [3 * own_size] * len(row)
        after = [x + 2 * own_size for x in own[k + 1]] if k + 1 < len(own) else [3 * own_size + 1] * len(row)
        out.append([*row, *before, *after, 3 * own_size + 2])
    return out, [len(x) for x in lines]


def score_by_hand(model, text):
    """Forward-backward in log space, line by line, and the length-weighted mean of the marginals."""
    feats, lengths = features_by_hand(text)
    u = [sum(float(model.weights[f]) for f in row) for row in feats]
    add = lambda a, b: max(a, b) + math.log1p(math.exp(-abs(a - b)))
    ahead, back = [(0.0, u[0])], [(0.0, 0.0)]
    for x in u[1:]:
        bad, good = ahead[-1]
        ahead.append((add(bad + model.stay, good + model.turn), add(bad + model.turn, good + model.stay) + x))
    for x in reversed(u[1:]):
        bad, good = back[-1][0], back[-1][1] + x
        back.append((add(bad + model.stay, good + model.turn), add(bad + model.turn, good + model.stay)))
    p = [1 / (1 + math.exp(max(-700, min(700, (a[0] + b[0]) - (a[1] + b[1]))))) for a, b in zip(ahead, reversed(back), strict=True)]
    weights = lengths if sum(lengths) else [1] * len(lengths)
    return sum(x * w for x, w in zip(p, weights, strict=True)) / sum(weights)


ODD_TEXTS = [None, "", "\n", "One line.", "A b\n\nA b\nA b 12 $$ ##!\nünï CODE x", "the the the, cat's \"end\"\n  \n\t9 9\n" * 3, "x" * 5000]


def test_features_and_scores_equal_brute_force(sf_dir):
    import pyarrow.parquet as pq

    rng = np.random.default_rng(8)
    model = quality.Model(rng.normal(size=quality.FEATURES) * 0.3, 0.8, -0.3)
    for text in [*ODD_TEXTS, *pq.read_table(f"{sf_dir}/documents.parquet").column("text").to_pylist()[:60]]:
        assert quality.features(text)[0].tolist() == features_by_hand(text)[0]
        assert model.score(text) == pytest.approx(score_by_hand(model, text), abs=1e-9)


def test_chain_loss_equals_enumeration_and_its_gradient_differences():
    rng = np.random.default_rng(9)
    chains = [quality.features(t)[0] for t in ("a b\nc d e", "One line.", "x\n\ny z\nX Y.", "same\nsame\nsame\nsame")]
    labels, weights = np.array([1.0, 0.0, 0.0, 1.0]), np.array([1.0, 2.0, 0.5, 1.5])
    loss = quality.ChainLoss(chains, labels, weights)
    x = rng.normal(size=quality.FEATURES + 2) * 0.2
    w, stay, turn = x[:-2], x[-2], x[-1]
    want = 0.5 * quality.PENALTY * (x @ x)
    for chain, k, weight in zip(chains, labels, weights, strict=True):
        u = w[chain].sum(axis=1)
        score = lambda bits, u=u: sum(v for v, b in zip(u, bits, strict=True) if b) + sum(stay if a == b else turn for a, b in itertools.pairwise(bits))
        total = np.logaddexp.reduce([score(bits) for bits in itertools.product((0, 1), repeat=len(u))])
        want += weight * (total - score([k] * len(u)))
    value, grad = loss(x)
    assert value == pytest.approx(want)
    used = sorted({int(f) for c in chains for f in c.ravel()})
    for i in [*used[:: max(1, len(used) // 25)], quality.FEATURES, quality.FEATURES + 1]:
        step = np.zeros_like(x)
        step[i] = 1e-5
        assert grad[i] == pytest.approx((loss(x + step)[0] - loss(x - step)[0]) / 2e-5, abs=1e-4)


def test_training_takes_whole_chains():
    """A document of thousands of lines is one chain."""
    long = "\n".join(f"Line {i} of a good text." for i in range(5000))
    model = quality.train([long, "$$\n##\n%%", long[:2000], "@@ !!"], np.array([1.0, 0.0, 1.0, 0.0]), np.ones(4))
    assert model.score(long) > 0.9 and model.score("$$ ##\n@@") < 0.2


# --- samples ----------------------------------------------------------------------------------------------------------
def test_samples_are_bounded_and_weigh_what_could_be_taken(spark):
    docs = spark.createDataFrame([(i, "x" * (50 if i % 10 else 900)) for i in range(200)] + [(None, "x"), (500, None), (501, ""), (3, "twice")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 4 == 0) for i in range(200)] + [(None, True), (500, True), (501, False), (7, False)], "doc_id long, toxic boolean").withColumn("toxic", F.col("toxic").cast("int"))
    every = F.lit(True)
    texts, y, weights = learning.labelled_sample(docs, labels, "toxic", every, 1000, text_chars=500)
    assert len(texts) == 182 and max(map(len, texts)) == 50 and sum(y) == 40 and np.allclose(weights, 1)
    texts, y, weights = learning.labelled_sample(docs, labels, "toxic", every, 20, text_chars=500)
    assert len(texts) in (40, 41) and sum(y) == 20 and weights[y == 0].sum() / weights[y == 1].sum() == pytest.approx(142 / 40)
    texts, y, _ = learning.labelled_sample(docs, labels, "toxic", every, 1000, class_chars=300, text_chars=500)
    assert all(sum(len(t) for t, k in zip(texts, y, strict=True) if k == c) <= 300 for c in (0, 1)) and len(texts) >= 10
    again, _, _ = learning.labelled_sample(docs.repartition(5), labels, "toxic", every, 1000, class_chars=300, text_chars=500)
    assert again == texts
    assert learning.labelled_sample(docs, labels.limit(0), "toxic", every, 10)[0] == []
