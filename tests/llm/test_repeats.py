"""Repeated rows in mixing, and long documents in packing's memory."""

import random
import re
from collections import defaultdict

import pytest

from scribespark.llm import mixing
from scribespark.llm.packing import Packer

SCHEMA = "doc_id long, source string, text string"


@pytest.mark.parametrize("seed", [1, 2, 4, 7])
def test_repeated_rows_do_not_overshoot(spark, seed):
    """200 documents and 100 equal rows of one id: as many of them as fit, near the target."""
    rng = random.Random(seed)
    rows = [(k, "a", "w " * rng.randint(50, 150)) for k in range(200)] + [(999, "a", "w " * 100)] * 100 + [(5000 + k, "b", "w " * 60) for k in range(300)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = mixing.decide(df, seed=seed).collect()
    assert len(got) == len(rows) and all(0 <= r.taken <= 3 * r["size"] for r in got)
    for source in ("a", "b"):
        own = [r for r in got if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 0.02 * own[0].target
    assert len({r.copies for r in got if r.doc_id == 999}) <= 2
    again = mixing.decide(df, seed=seed).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, again), key=repr)
    mixed = mixing.mix(df, seed=seed)
    taken = defaultdict(int)
    for r in got:
        taken[r.doc_id] += r.copies
    assert {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()} == {k: n for k, n in taken.items() if n}


def test_only_equal_rows(spark):
    df = spark.createDataFrame([(1, "a", "x " * 10)] * 90 + [(2, None, "y " * 10)] * 10, SCHEMA).repartition(3)
    got = mixing.decide(df).collect()
    for source in ("a", None):
        own = [r for r in got if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) < 10


def pareto(rows, plan):
    """Taken rows of one source by Pareto's order in plain Python: certain copies, then ranks until the words are used up, then the best fit."""
    taken, open_ = {}, []
    rest = None
    for r in rows:
        band = min((len(re.findall(r"[^ \t-\r]+", r["text"])) + 1).bit_length() - 1, mixing.BANDS - 1)
        p = plan[band]
        taken[r["doc_id"]], rest = p["certain"], p["rest"]
        if p["p"] > 0:
            u = ((r["draw"] % (1 << 64) >> 11) + 0.5) / (1 << 53)
            odds = (u / (1 - u)) / (p["p"] / (1 - p["p"]))
            open_.append((odds / (1 + odds), r["draw"], r["size"], r["doc_id"]))
    used, left = 0, []
    full = False
    for rank, draw, size, doc in sorted(open_):
        if not full and used + size <= rest:
            used += size
            taken[doc] += 1
        else:
            full = True
            left.append((abs(size - (rest - used)), rank, draw, doc))
    if left and min(left)[0] < rest - used:
        taken[min(left)[3]] += 1
    return taken


def test_against_an_independent_pareto_order(spark):
    rng = random.Random(3)
    rows = [(k, rng.choice("abc"), "w " * rng.choice([0, 3, 17, 60, 200, rng.randint(1, 500)])) for k in range(400)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: r for r in mixing.decide(df).collect()}
    sizes = mixing.written(mixing.drawn(df, 1, "doc_id", "source", "text"), "test-sizes")
    found, _ = mixing.targets(sizes)
    plan = defaultdict(dict)
    for r in mixing.expected(sizes, found, mixing.MAX_COPIES, mixing.PREFERENCE).collect():
        plan[r.source][r.band] = r.asDict()
    texts = {k: t for k, _, t in rows}
    by_source = defaultdict(list)
    for r in sizes.collect():
        by_source[r.source].append(r.asDict() | {"text": texts[r.doc_id]})
    for source, own in by_source.items():
        assert {k: got[k].copies for k in (r["doc_id"] for r in own)} == pareto(own, plan[source])


def test_long_documents_leave_little_behind():
    """Of 300 documents of 204,802 tokens only their last pieces stay in the pools."""
    packer = Packer(0)
    ids = bytes(4 * 204_802)
    for k in range(300):
        packer.add(k, ids)
        packer.open = {}
    kept = sum(len(p[-1]) for pool in packer.pools.values() for p in pool)
    assert kept == 4 * packer.held == 4 * 300 * 2


def test_pieces_cut_in_the_end_carry_their_ids():
    packer, rng = Packer(0, (4, 8), 16), random.Random(2)
    docs = {k: bytes(b for i in range(n) for b in (i % 256, k, 0, 0)) for k, n in enumerate(rng.choices(range(1, 30), k=50))}
    rows = [r for k, ids in docs.items() for r in packer.add(k, ids) + packer.pack()] + packer.finish()
    joined = defaultdict(bytes)
    for r in sorted(rows, key=lambda r: (r[0], r[1])):
        assert len(joined[r[0]]) == 4 * r[1] and len(r[8]) == 4 * r[2] and r[3] == len(docs[r[0]]) // 4
        joined[r[0]] += r[8]
    assert joined == docs
