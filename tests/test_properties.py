"""Results depend neither on the order of rows nor on partitions, and equal plain Python."""

from collections import defaultdict
from itertools import combinations

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evalguard.functions import metrics
from evalguard.operators import duplicates, leakage, resplit

ROWS = st.lists(st.tuples(st.sampled_from(["train", "val", "test"]), st.sampled_from(["a", "b", "c", " a ", "", None]), st.integers(0, 4)), min_size=1, max_size=40)
FEW = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow])


@FEW
@given(rows=ROWS, parts=st.integers(1, 5))
def test_entities_and_duplicates(spark, rows, parts):
    df = spark.createDataFrame(rows, "split string, e string, x int").repartition(parts)
    by = defaultdict(lambda: defaultdict(int))
    for s, e, _ in rows:
        if e and e.strip():
            by[e.strip()][s] += 1
    want = defaultdict(lambda: [0, 0])
    for counts in by.values():
        for a, b in combinations(sorted(counts), 2):
            want[a, b][0] += 1
            want[a, b][1] += counts[a] + counts[b]
    got = {(r["split_a"], r["split_b"]): [r["n_entities"], r["affected_rows"]] for r in leakage.entity_pairs(df, "e", "split").collect()}
    assert got == dict(want)
    groups = defaultdict(list)
    for s, _, x in rows:
        groups[x].append(s)
    wanted = sorted((len(g), sorted(set(g))) for g in groups.values() if len(g) > 1)
    found = sorted((r["n"], r["splits"]) for r in duplicates.digest_groups(df.withColumn("d", F.col("x").cast("string")), "d", "split").collect())
    assert found == wanted


@given(p=st.lists(st.floats(0, 1), min_size=1, max_size=20))
def test_adjusted_p_values_keep_order_and_bounds(p):
    q = metrics.benjamini_hochberg(p)
    assert all(a <= b + 1e-12 and b <= 1 for a, b in zip(p, q, strict=True))
    order = sorted(range(len(p)), key=lambda i: p[i])
    assert all(q[a] <= q[b] + 1e-12 for a, b in zip(order, order[1:], strict=False))


@given(n=st.integers(1, 400), train=st.floats(0.1, 0.9))
def test_the_cycle_stays_near_its_ratios(n, train):
    ratios = resplit.normalise({"train": train, "test": 1 - train})
    got = list(resplit.cycle(ratios, n))
    assert abs(got.count("train") - train * n) <= 1.5
