"""The distance bound by the number of different n-grams."""

import numpy as np

from lotlens.llm import langid


def test_bound_of_the_last_class_comes_down_from_the_class_before():
    bounds = np.array([np.inf] * (langid.LONG - 1) + [0.8, 0.6])
    limit = langid.Model(np.ones(langid.DIM), [], np.zeros((0, langid.DIM)), bounds).limit
    assert limit(np.log2([2 ** (langid.LONG - 1), 2**langid.LONG - 1, 2**langid.LONG, 2 ** (langid.LONG + 1), 2 ** (langid.LONG + 2)])).tolist() == [0.8, 0.8, 0.8, 0.6, 0.6]
    assert 0.6 < limit(np.log2([1.5 * 2**langid.LONG]))[0] < 0.8
    unknown = np.array([np.inf] * langid.LONG + [0.6])
    assert langid.Model(np.ones(langid.DIM), [], np.zeros((0, langid.DIM)), unknown).limit(np.array([langid.LONG + 0.1])).tolist() == [0.6]
