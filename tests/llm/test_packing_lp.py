import math
import random

import numpy as np

from lodestrata.llm import packing as P


def test_prices_take_no_more_than_there_is():
    assert P.price_best(np.array([3, 5]), np.array([2.0, 1.0]), np.array([1, 1]), 9) == {0: 1, 1: 1}


def test_the_program_covers_every_length():
    for times in (1, 10):
        r, histogram = random.Random(7), {}
        for _ in range(400):
            n = min(512, max(1, int(r.lognormvariate(4.5, 0.9))))
            histogram[n] = histogram.get(n, 0) + times
        plan = P.solve(histogram, 512)
        assert plan.lp_containers == plan.containers
        assert plan.containers - math.ceil(plan.lower_bound) <= 0.001 * plan.containers + 1


def test_bound_where_lengths_do_not_fill():
    plan = P.solve({60: 50, 55: 50}, 100, rounds=10)
    assert plan.lower_bound <= plan.containers == 100
