import random

import pytest

from helpers import distance, frame_distance, greedy
from twinsieve.operators import stars as S
from twinsieve.plans.bands import signed


def owners(spark, ws, nodes, t, unique):
    rows = [(rk, f) for rk, x in nodes for f in (x if isinstance(x, list) else [x])]
    df = spark.createDataFrame(rows, "rk bigint, fp bigint").coalesce(1).cache()
    return {r.rk: r.owner for r in S.greedy_stars(S.Links(ws, df, len(rows), unique), t).collect()}


@pytest.fixture(params=["pairs", "sweeps", "ranges"])
def way(request, monkeypatch):
    if request.param == "sweeps":
        monkeypatch.setattr(S, "PAIRS_PER_NODE", 0)
    if request.param == "ranges":
        monkeypatch.setattr(S, "RANGE_NODES", 12)
    return request.param


def test_random_nodes(spark, ws, way):
    rng = random.Random(1)
    nodes = [(i, signed(rng.getrandbits(64))) for i in range(90)]
    assert owners(spark, ws, nodes, 21, True) == greedy(nodes, lambda a, b: distance(a, b) <= 21)


def test_a_dense_ball(spark, ws, way):
    rng = random.Random(2)
    values = {signed(sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5)))) for _ in range(120)}
    nodes = list(enumerate(values))
    assert owners(spark, ws, nodes, 5, True) == greedy(nodes, lambda a, b: distance(a, b) <= 5)


def test_a_chain_in_order(spark, ws, monkeypatch):
    """Each link is near the next only; settling ranges takes few steps."""
    monkeypatch.setattr(S, "RANGE_NODES", 30)
    rng = random.Random(3)
    chain = [0]
    while len(chain) < 90:
        nxt = chain[-1] ^ (1 << rng.randrange(64))
        if nxt not in chain:
            chain.append(nxt)
    nodes = [(i, signed(x)) for i, x in enumerate(chain)]
    assert owners(spark, ws, nodes, 2, True) == greedy(nodes, lambda a, b: distance(a, b) <= 2)


@pytest.mark.parametrize("t,pairs", [(0, 64), (4, 0), (18, 64)])
def test_frame_sets(spark, ws, monkeypatch, t, pairs):
    monkeypatch.setattr(S, "PAIRS_PER_NODE", pairs)
    rng = random.Random(4)
    nodes = []
    for i in range(50):
        frames = [signed(rng.getrandbits(64)) for _ in range(3)]
        if rng.random() < 0.3:
            frames.append(0)
        if nodes and rng.random() < 0.4:
            frames.append(rng.choice(nodes)[1][0] ^ (1 << rng.randrange(60)))
        nodes.append((i, sorted(set(frames))))
    assert owners(spark, ws, nodes, t, False) == greedy(nodes, lambda a, b: frame_distance(a, b) <= t)
