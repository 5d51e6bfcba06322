"""Plain, slow restatements of single steps, for comparison on small inputs."""

import numpy as np


def middle(window):
    return float(np.median(window))


def running_median(values, half):
    """Running median with shrinking ends over the smoothed sequence and Tukey's end points."""
    n = len(values)
    y = list(map(float, values))
    if half == 0:
        return y
    smooth = y[:]
    for i in range(half, n - half):
        smooth[i] = middle(y[i - half : i + half + 1])
    out = smooth[:]
    for i in range(1, half):
        out[i] = middle(smooth[: 2 * i + 1])
        out[n - 1 - i] = middle(smooth[n - 1 - 2 * i :])
    out[0] = middle([smooth[0], out[1], 3 * out[1] - 2 * out[2]])
    out[-1] = middle([smooth[-1], out[-2], 3 * out[-2] - 2 * out[-3]])
    return out


def running_max(r, y):
    mean, best, out = sum(y) / len(y), 0.0, []
    for a, b in zip(r, y):
        if b > mean:
            best = max(best, a)
            a = best
        out.append(a)
    return out


def auc(labels, scores):
    pos = [s for s, k in zip(scores, labels) if k == 1]
    neg = [s for s, k in zip(scores, labels) if k == 0]
    if not pos or not neg:
        return None
    return sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))


def curve(r, steps):
    alpha = np.linspace(0, 1, steps)
    return alpha, alpha - np.minimum(np.outer(r, alpha), 1).mean(axis=0)
