import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from kinora.operators.components import connected_components


def plain(pairs):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {x: find(x) for x in parent}


def run(spark, pairs):
    rows = connected_components(spark.createDataFrame(pairs, "src long, dst long")).collect()
    assert len({r.id for r in rows}) == len(rows)
    return {r.id: r.component for r in rows}


def test_chain_star_cycle_and_repeats(spark):
    chain = [(k, k + 1) for k in range(60)]
    random.Random(1).shuffle(chain)
    pairs = [*chain, *[(1000, 1000 + k) for k in range(1, 40)], (2000, 2001), (2001, 2002), (2002, 2000), (2000, 2001), (3001, 3000)]
    assert run(spark, pairs) == plain(pairs)


def test_nulls_loops_and_no_edges(spark):
    assert run(spark, [(1, None), (None, 2), (3, 3)]) == {}


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=40))
def test_equals_union_find(spark, pairs):
    assert run(spark, pairs) == plain([p for p in pairs if p[0] != p[1]])
