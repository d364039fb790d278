import random
from collections import defaultdict

from sitesignal.operators import components as c
from sitesignal.operators.components import components


def union_find(pairs):
    root = {x: x for p in pairs for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def found(spark, pairs, kind="bigint"):
    rows = components(spark.createDataFrame(pairs, f"a {kind}, b {kind}")).collect()
    out = {r.node: r.root for r in rows}
    assert len(out) == len(rows)
    return out


def test_random_graphs(spark):
    rng = random.Random(4)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)]
    assert found(spark, pairs) == union_find(pairs)


def test_chain_hub_and_text_nodes(spark):
    chain = [(i, i + 1) for i in range(100)]
    hub = [(1000 + i, 5000 - i) for i in range(0)] + [(999, 1000 + i) for i in range(2000)]
    pairs = [(str(a), str(b)) for a, b in chain + hub]
    assert found(spark, pairs, "string") == union_find(pairs)


def test_a_hub_is_spread_over_many_keys(spark):
    links = spark.range(5000).selectExpr("cast(0 as bigint) as u", "id + 1 as v")
    keys = links.selectExpr("u", f"pmod(xxhash64(v), {c.SPREAD}) as part").groupBy("u", "part").count().collect()
    assert len(keys) == c.SPREAD and max(r["count"] for r in keys) < 5000 / c.SPREAD * 2
    assert c._with_least(links).where("m <> 1").count() == 0


def test_odd_links(spark):
    assert found(spark, [(None, 1), (2, None), (3, 3), (4, 5), (5, 4), (4, 5)]) == {3: 3, 4: 4, 5: 4}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
    groups = defaultdict(set)
    for node, root in found(spark, [(-5, 7), (7, 0)]).items():
        groups[root].add(node)
    assert groups == {-5: {-5, 0, 7}}
