import hashlib
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tallyglass.llm import digests
from tallyglass.session import fresh_path
from tests.llm import odd


def brute_groups(rows):
    groups = defaultdict(list)
    for i, (d, t, _) in enumerate(rows):
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append((d is None, d or 0, i))
    out = []
    for text, members in groups.items():
        keep = min(members)
        digest = hashlib.sha256(text.encode()).hexdigest()
        out += [(rows[i][0], rows[keep[2]][0], len(members), (null, d, i) == keep, digest) for null, d, i in members]
    return sorted(out, key=str)


def report(df):
    return sorted((tuple(r) for r in df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=str)


AWKWARD = [
    *odd.texts(),
    (50, " a\x0b b ", "s"),
    (51, "\ta\n\r\x0cb\t", "s"),
    (52, "a\xa0b", "s"),
    (53, "a b", "s"),
    (49, "a\x1cb", "s"),
    (None, " a b ", "s"),
    (7, "   ", "s"),
]


@pytest.mark.parametrize("batches", [1, 3, 4])
def test_exact_dedup_equals_brute_force(spark, batches):
    found = digests.exact_dedup(odd.documents(spark, AWKWARD).coalesce(1), batches)
    assert report(found) == brute_groups(AWKWARD)


def test_exact_dedup_of_nothing(spark):
    assert digests.exact_dedup(odd.documents(spark, [])).collect() == []
    only_null = digests.exact_dedup(odd.documents(spark, [(None, None, None)] * 3))
    assert sorted(tuple(r)[:4] for r in only_null.collect()) == [(None, None, 3, False)] * 2 + [(None, None, 3, True)]


def test_hot_group_is_joined_apart(spark, monkeypatch):
    monkeypatch.setattr(digests, "HOT_SHARE", 4)
    rows = [(i, "same" if i % 3 == 0 else f"text {i // 2}", "s") for i in range(90, 0, -1)]
    found = digests.exact_dedup(odd.documents(spark, rows).repartition(5))
    assert report(found) == brute_groups(rows)
    plan = found._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" in plan


def test_index_persists_and_a_batch_can_be_run_again(spark):
    path = fresh_path(spark, "index")
    rows = digests.digests(odd.documents(spark, [(i, f"t{i % 7}", "s") for i in range(20)]))
    first, second, third = rows.filter("doc_id < 5"), rows.filter("doc_id between 5 and 9"), rows.filter("doc_id >= 10")
    index = digests.DigestIndex(spark, path, 3)
    index.add(first, 0)
    index.add(second, 1)
    index.add(second, 1)
    index.close()
    again = digests.DigestIndex(spark, path, 3)
    again.add(third, 2)
    seen = sorted((r["doc_id"], r["batch"]) for r in again.rows().collect())
    assert seen == [(0, 0), (1, 0), (2, 0), (3, 0), (4, 0), (5, 1), (6, 1)]
    assert {r["group_size"] for r in digests.group_report(rows, again).collect()} == {2, 3}
    again.close()


def test_the_index_is_read_in_place(spark):
    index = digests.DigestIndex(spark, fresh_path(spark, "index"), 6)
    rows = digests.digests(odd.documents(spark))
    index.add(rows, 0)
    plan = index.unseen(rows.withColumn("digest", F.unhex(F.sha2("digest", 256))), 1)._jdf.queryExecution().executedPlan().toString()
    join = plan[plan.index("SortMergeJoin") :]
    known = join[join.index("Scan parquet") :] if "Bucketed: true" in join else ""
    assert "LeftAnti" in plan and "Bucketed: true" in plan and known
    # the only exchanges are those of the new rows
    scan = plan.index("Bucketed: true")
    side = plan[plan.rfind("Sort [", 0, scan) : scan]
    assert "Exchange" not in side
    index.close()
