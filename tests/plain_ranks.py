"""A plain Spearman correlation for tests."""

import numpy as np


def ranks(values):
    values = np.asarray(values, float)
    return np.array([(values < v).sum() + ((values == v).sum() + 1) / 2 for v in values])


def spearman_of(pairs):
    a, b = ranks([p[0] for p in pairs]), ranks([p[1] for p in pairs])
    return float(np.corrcoef(a, b)[0, 1])
