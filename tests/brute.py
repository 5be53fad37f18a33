"""Plain Python versions of the formulas, for small fixtures."""

import hashlib
import math
import re
from collections import Counter, defaultdict


def tokens(text):
    return [t for t in re.split(r"[\W+_0-9]", text.lower(), flags=re.ASCII) if len(t) >= 2]


def bucket(term, v):
    return int(hashlib.md5(term.encode()).hexdigest()[:8], 16) % v


def counts(text, v):
    return Counter(bucket(t, v) for t in tokens(text))


def java_hash(term):
    h = 0
    for ch in term:
        h = (h * 31 + ord(ch)) % (1 << 32)
    return h - (1 << 32) if h >= 1 << 31 else h


def fit(rows, v, lam, normalise=True):
    """rows: (label, Counter, weight) -> {label: (pi, [theta])}"""
    n, mass = Counter(), defaultdict(lambda: defaultdict(float))
    for label, c, w in rows:
        n[label] += w
        length = sum(c.values())
        for j, x in c.items():
            mass[label][j] += w * (x / length if normalise and length else x)
    total, k = sum(n.values()), len(n)
    model = {}
    for label in sorted(n):
        denom = math.log(sum(mass[label].values()) + v * lam)
        theta = [math.log(mass[label].get(j, 0.0) + lam) - denom for j in range(v)]
        model[label] = (math.log(n[label] + lam) - math.log(total + k * lam), theta)
    return model


def raw(model, c):
    return {y: pi + sum(x * theta[j] for j, x in c.items()) for y, (pi, theta) in model.items()}


def posterior(scores):
    top = max(scores.values())
    e = {y: math.exp(s - top) for y, s in scores.items()}
    return {y: x / sum(e.values()) for y, x in e.items()}


def best(scores):
    top = max(scores.values())
    return min(y for y, s in scores.items() if s >= top - 1e-9)


def em(labelled, free, v, lam, epochs, weight=1.0, soft=False):
    """labelled: [(label, Counter)], free: [Counter] -> models and log-probabilities per epoch."""
    base = [(y, c, 1.0) for y, c in labelled]
    model = fit(base, v, lam)
    models, logs = [model], []
    for _ in range(epochs):
        rows, hard = list(base), [(y, c) for y, c in labelled]
        for c in free:
            scores = raw(model, c)
            hard.append((best(scores), c))
            if soft:
                rows += [(y, c, p * weight) for y, p in posterior(scores).items()]
            else:
                rows.append((best(scores), c, weight))
        model = fit(rows, v, lam)
        bits = -sum(pi + sum(theta) for pi, theta in model.values()) / math.log(2)
        nats = sum(model[y][0] + sum(model[y][1][j] for j in c) for y, c in hard)
        models.append(model)
        logs.append((bits, nats))
    return models, logs
