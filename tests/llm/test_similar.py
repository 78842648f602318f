import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from tallyglass.llm import fingerprints, jaccard
from tests.llm import odd


def brute_next(rows):
    """Texts in descending id, NULL ids last, copies and their next."""
    return sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))


@pytest.mark.parametrize("partitions", [1, 7])
def test_fingerprint_report(spark, partitions):
    rows = [r for r in odd.texts() if r[0] is not None or r[1] is not None]  # one NULL id, and one repeated row
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        found = fingerprints.fingerprint_report(odd.documents(spark, rows).repartition(3)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(found) == len(rows)
    order, hasher = brute_next(rows), fingerprints.Hasher()
    wanted = []
    for i, (d, t, _) in enumerate(order):
        text, following = t or "", order[(i + 1) % len(order)][1] or ""
        k = len(text) // 3
        changed = text[: len(text) - k] + following[:k]
        a, b, c = hasher(text), hasher(changed), hasher(following)
        wanted.append((str(d), len(text), hashlib.sha256(changed.encode()).hexdigest(), a.hex(), b.hex(), fingerprints.likeness(a, b), fingerprints.likeness(a, c)))
    assert sorted((str(r[0]), *r[1:]) for r in found) == sorted(wanted)


def test_fingerprint_of_one_and_none(spark):
    assert fingerprints.fingerprint_report(odd.documents(spark, [])).collect() == []
    (row,) = fingerprints.fingerprint_report(odd.documents(spark, [(3, "abcdef", "s")])).collect()
    assert row["edited_sha256"] == hashlib.sha256(b"abcdab").hexdigest() and row["near_next"] == 1.0


def test_likeness_tells_edited_from_other():
    hasher = fingerprints.Hasher()
    texts = [odd.prose(i, 200, 5000) for i in range(20)]
    near = [fingerprints.likeness(hasher(t), hasher(fingerprints.edited(t, u))) for t, u in zip(texts, texts[1:], strict=False)]
    far = [fingerprints.likeness(hasher(t), hasher(u)) for t, u in zip(texts, texts[1:], strict=False)]
    assert min(near) > max(far) and np.mean(near) > 0.5 and np.mean(far) < 0.25


def test_within_radius_finds_all(spark):
    rng = random.Random(4)
    prints = [rng.getrandbits(128) for _ in range(60)]
    for p in prints[:20]:
        for _ in range(3):
            q = p
            for bit in rng.sample(range(128), rng.randrange(0, 7)):
                q ^= 1 << bit
            prints.append(q)
    df = spark.createDataFrame([(i, f"{p:032x}") for i, p in enumerate(prints)], "doc_id bigint, fingerprint string")
    queries = df.filter("doc_id % 5 = 0")
    found = {(r["query"], r["found"]): r["distance"] for r in fingerprints.within_radius(queries, df, 3).collect()}
    wanted = {}
    for i, p in enumerate(prints):
        for q in prints:
            if i % 5 == 0 and (p ^ q).bit_count() <= 3:
                wanted[f"{p:032x}", f"{q:032x}"] = (p ^ q).bit_count()
    assert found == wanted


def brute_classes(rows):
    sets = []
    for _, t, _ in rows:
        w = odd.words_of((t or "").lower())
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else None)
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    links = Counter()
    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if (rows[i][1] or "") == (rows[j][1] or "") or (a and b and len(a & b) >= 0.8 * len(a | b) - 1e-9):
                links[i] += 1
                links[j] += 1
                root[top(i)] = top(j)
    classes = defaultdict(list)
    for i in range(len(rows)):
        classes[top(i)].append(i)
    out = []
    for i, (d, _, _) in enumerate(rows):
        members = classes[top(i)]
        ids = [rows[m][0] for m in members if rows[m][0] is not None]
        out.append((str(d), str(min(ids, default=None)), links[i], len(members)))
    return sorted(out)


def edited_copies(n, words=90, edits=2, seed=0):
    r = random.Random(seed)
    base = odd.prose(seed, words, 3000).split()
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(r.randrange(edits + 1)):
            w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("block", [2048, 16])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rows = [r for r in odd.texts() if not r[1] or len(r[1]) < 50_000]
    passage = odd.prose(77, 60)
    rows += [(1000 + i, t, "s") for i, t in enumerate(edited_copies(80))]  # one large group
    rows += [(2000 + 10 * k + i, t, "s") for k in range(12) for i, t in enumerate(edited_copies(4, 50, 3, 10 + k))]
    rows += [(3000 + i, odd.prose(3000 + i, 120) + " " + passage, "s") for i in range(20)]
    rows += [(4000 + i, "the very same text of a dozen words that many documents hold", "s") for i in range(30)]
    found = jaccard.near_duplicates(odd.documents(spark, rows).repartition(5)).collect()
    assert sorted((str(r["doc_id"]), str(r["class_id"]), r["n_links"], r["class_size"]) for r in found) == brute_classes(rows)


def test_keep_one(spark):
    docs = odd.documents(spark)
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    got = sorted(str(r["doc_id"]) for r in kept.collect())
    small = [r for r in odd.texts() if not r[1] or len(r[1]) < 50_000]
    classes = {c[1] for c in brute_classes(small) if c[1] != "None"}
    assert sorted(g for g in got if g not in ("None", "6")) == sorted(classes)


def test_near_duplicates_of_nothing(spark):
    assert jaccard.near_duplicates(odd.documents(spark, [])).collect() == []


def test_pruning_keeps_pairs_at_the_threshold():
    looks = dict(jaccard.least_agreements())
    assert list(looks) == list(range(jaccard.LOOK, jaccard.VALUES + 1, jaccard.LOOK))
    rng = np.random.default_rng(0)
    agree = np.cumsum(rng.uniform(size=(20_000, jaccard.VALUES)) < 0.8, axis=1)
    lost = np.zeros(20_000, bool)
    for n, least in looks.items():
        lost |= agree[:, n - 1] < least
    assert lost.mean() < 1e-3


@pytest.mark.parametrize("edges", [[], [(1, 2)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 30)] + [(50, 51), (51, 52)]])
def test_components(spark, edges):
    df = spark.createDataFrame([(bytes([a]), bytes([b])) for a, b in edges], "a binary, b binary")
    got = {r["node"][0]: r["root"][0] for r in jaccard.components(df).collect()}
    want = {}
    for a, b in edges:
        want.setdefault(a, a), want.setdefault(b, b)
    for _ in edges:
        for a, b in edges:
            want[a] = want[b] = min(want[a], want[b])
    assert {k: v for k, v in got.items() if k != v} == {k: v for k, v in want.items() if k != v}
