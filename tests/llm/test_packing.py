import random
from collections import Counter, defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from codeloom.llm import packing


@settings(max_examples=300, deadline=None)
@given(st.integers(1, 60), st.lists(st.tuples(st.integers(0, 60), st.integers(1, 50)), max_size=20))
def test_plan_places_all_and_never_overfills(capacity, pairs):
    counts = Counter()
    for x, n in pairs:
        counts[min(x, capacity)] += n
    segments, containers = packing.plan_containers(dict(counts), capacity)
    fill, placed = defaultdict(int), Counter()
    by = defaultdict(list)
    for length, first, per, base in sorted(segments):
        by[length].append((first, per, base))
    for length, n in counts.items():
        for rank in range(n):
            first, per, base = next(s for s in reversed(by[length]) if s[0] <= rank)
            fill[base + (rank - first) // per] += length
            placed[length] += 1
    assert placed == counts
    assert all(v <= capacity for v in fill.values())
    assert all(0 <= c < containers for c in fill)
    total = sum(x * n for x, n in counts.items())
    assert containers <= max(1, 2 * -(-total // capacity)) or not counts  # never worse than half full


def _check(rows, sizes, capacity):
    fill, docs = defaultdict(int), defaultdict(list)
    for r in rows:
        fill[r["container_id"]] += r["length"]
        docs[r["doc_id"]].append((r["piece"], r["start"], r["length"]))
    assert max(fill.values()) <= capacity
    for i, n in sizes.items():
        own = sorted(docs.pop(i))
        assert [p for p, _, _ in own] == list(range(max(1, -(-n // capacity))))
        assert [s for _, s, _ in own] == [k * capacity for k in range(len(own))]
        assert sum(x for _, _, x in own) == n
    assert not docs
    return fill


def test_pack(spark, monkeypatch):
    rng = random.Random(5)
    monkeypatch.setattr(packing, "RANK_ROWS", 20)
    sizes = {n: rng.choice([0, 7, 7, 7, rng.randrange(1, 100), rng.randrange(1, 1000)]) for n in range(600)}
    df = spark.createDataFrame([(i, n, "clash") for i, n in sizes.items()], "doc_id bigint, n_tokens bigint, length string")
    fill = _check(packing.pack(df, 100).collect(), sizes, 100)
    assert sum(fill.values()) / (100 * len(fill)) > 0.97


def test_pack_odd_inputs(spark):
    schema = "doc_id bigint, n_tokens bigint"
    assert packing.pack(spark.createDataFrame([], schema), 10).count() == 0
    _check(packing.pack(spark.createDataFrame([(1, None), (2, 0)], schema), 10).collect(), {1: 0, 2: 0}, 10)
    _check(packing.pack(spark.createDataFrame([(1, 10_000_007)], schema), 100).collect(), {1: 10_000_007}, 100)
    twice = packing.pack(spark.createDataFrame([(1, 6), (1, 6)], schema), 10).collect()
    assert len({r["container_id"] for r in twice}) == 2
