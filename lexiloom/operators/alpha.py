"""Fixed-point optimisation of the document-topic prior.

The histograms are aggregated by Spark; the iterations run over them on the driver.
A histogram has as many entries as there are different counts.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np

# The hyperprior's scale and shape, and what negative priors are reset to.
SCALE = 1.0
SHAPE = 1.001
RESET = 0.1
ITERATIONS = 10


def harmonic_sums(counts: np.ndarray, start: float) -> np.ndarray:
    """For every count n the sum of 1 / (j - 1 + start) over j = 1 ... n."""
    if not len(counts):
        return np.zeros(0)
    running = np.concatenate([[0.0], np.cumsum(1.0 / (np.arange(int(counts.max())) + start))])
    return running[counts]


def optimise_alpha(alpha: Sequence[float], lengths: Mapping[int, int], by_topic: Sequence[Mapping[int, int]], iterations: int = ITERATIONS) -> list[float]:
    """New priors after some iterations.

    ``lengths``: documents by length; ``by_topic``: for each topic, documents by tokens of the
    topic.  Zero counts add nothing.  If a prior becomes negative all are reset.
    """
    alpha = [float(a) for a in alpha]
    total = sum(alpha)
    # in order of the counts, so that the sums do not depend on the order that they were gathered in
    size = np.array(sorted(n for n in lengths if n > 0), np.int64)
    docs = np.array([lengths[n] for n in size.tolist()], float)
    topics = []
    for h in by_topic:
        c = np.array(sorted(n for n in h if n > 0), np.int64)
        topics.append((c, np.array([h[n] for n in c.tolist()], float)))
    for _ in range(iterations):
        below = float(docs @ harmonic_sums(size, total)) - SCALE
        alpha = [a * (float(w @ harmonic_sums(c, a)) + SHAPE) / below for a, (c, w) in zip(alpha, topics)]
        total = sum(alpha)
    return [RESET] * len(alpha) if any(a < 0 for a in alpha) else alpha
