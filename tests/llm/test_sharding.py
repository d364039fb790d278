import zlib
from collections import Counter, defaultdict

from sitesignal.llm.sharding import shard


def check(docs, out, shards):
    assert len(out) == docs.count()
    of_text, slots, loads = {}, defaultdict(list), Counter()
    texts = Counter((r.doc_id, zlib.crc32((r.text or "").encode()), len((r.text or "").encode()) + 8) for r in docs.collect())
    assert texts == Counter((r.doc_id, r.text_crc32, r.size) for r in out)
    for r in out:
        assert of_text.setdefault((r.text_crc32, r.size), r.shard) == r.shard and 0 <= r.shard < shards
        slots[r.shard].append(r.slot)
        loads[r.shard] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return loads


def test_odd_documents(odd_docs, no_docs):
    check(odd_docs, shard(odd_docs, 3).collect(), 3)
    assert shard(no_docs).count() == 0


def test_balance(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "repeat(concat('w', id, ' '), cast(1 + id % 97 as int)) as text")
    loads = check(docs, shard(docs).collect(), 24)
    assert max(loads.values()) - min(loads.values()) <= 1000


def longest_first(sizes, shards):
    loads = [0] * shards
    for size in sorted(sizes, reverse=True):
        loads[loads.index(min(loads))] += size
    return loads


def test_balance_of_plain_longest_first(spark):
    """Groups of very uneven sizes, one of a third of all bytes: within 1 % of scheduling all groups one by one."""
    rows = [(i, f"t{i % 1500} " + "x" * int(4000 / (1 + i % 1500))) for i in range(4500)]
    rows += [(10_000 + i, "hot " * 100) for i in range(200)] + [(None, None)] * 300
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    loads, groups = check(docs, shard(docs, 8).collect(), 8), Counter()
    for _, text in rows:
        groups[text or ""] += len(text or "") + 8
    plain = longest_first(groups.values(), 8)
    assert sum(plain) == sum(loads.values())
    assert max(loads.values()) <= 1.01 * max(plain) and min(loads.values()) >= 0.99 * min(plain)


def test_no_setting_changes_a_shard(spark, rows_at):
    docs = spark.range(800).selectExpr("id as doc_id", "repeat(concat('w', id % 700, ' '), cast(1 + id % 97 as int)) as text")
    first = rows_at(4, lambda: shard(docs))
    assert first == rows_at(7, lambda: shard(docs)) == rows_at(211, lambda: shard(docs))
