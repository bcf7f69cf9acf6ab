"""Plain scores for comparison."""

import numpy as np


def auc(y, score):
    """Share of (positive, negative) pairs in order; ties count half."""
    up, down = score[y == 1], np.sort(score[y == 0])
    below, upto = np.searchsorted(down, up, "left"), np.searchsorted(down, up, "right")
    return float((below + (upto - below) / 2).sum() / (len(up) * len(down)))
