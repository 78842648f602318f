import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tallyglass.llm import ranking
from tests.llm import odd

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_terms(text):
    return [t.encode() for t in TERM.findall((text or "").translate(LOWER))]


def brute_search(docs, items):
    vectors = [(d, Counter(brute_terms(t))) for d, t in docs]
    vectors = [(d, v) for d, v in vectors if v]
    n_docs, n_terms = len(vectors), sum(v.total() for _, v in vectors)
    df = Counter(t for _, v in vectors for t in v)
    out = []
    for item, text in items:
        scores = []
        for d, v in vectors:
            m = 100 - 90 + (90 * v.total() * n_docs) // n_terms
            weights = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in set(brute_terms(text)) if t in v}
            score = sum(w * ((10**9 * v[t]) // (1000 * v[t] + 8 * m)) for t, w in weights.items())
            if score > 0:
                scores.append((-score, d is None, d or 0, d))
        out += [(item, i + 1, s[3], -s[0]) for i, s in enumerate(sorted(scores)[:10])]
    return out


def found(spark, docs, items):
    frame = odd.documents(spark, [(d, t, "s") for d, t in docs])
    asked = spark.createDataFrame([(i, t, 7) for i, t in items], "item_id bigint, text string, score bigint")
    rows = ranking.ranked_search(frame.repartition(3), asked).collect()
    assert rows == [] or rows[0].asDict().keys() == {"item_id", "rank", "doc_id", "score"}
    return sorted((tuple(r) for r in rows), key=str)


ODD_ITEMS = [(1, "W1 w2 w3 w17 w399"), (2, None), (3, " .,; "), (4, "żółć 😀 ß one"), (None, "MIT license text"), (5, "w1 w1 w1"), (6, "nowhere"), (6, "w5")]


def test_terms_split_as_the_pattern_does():
    text = "A-b_c@D {x}~é·ÀB9\x7fz\x00y 😀İ"
    assert ranking.terms_of(text) == brute_terms(text)


def test_search_over_awkward_rows(spark):
    docs = [(d, t) for d, t, _ in odd.texts()]
    assert found(spark, docs, ODD_ITEMS) == sorted(brute_search(docs, ODD_ITEMS), key=str)


def test_nothing_to_search(spark):
    assert found(spark, [], ODD_ITEMS) == []
    assert found(spark, [(1, "w1"), (2, None)], []) == []
    assert found(spark, [(1, None), (2, " ")], ODD_ITEMS) == []


def test_items_in_blocks_and_many_trees(spark, monkeypatch):
    docs = [(d, t) for d, t, _ in odd.texts()]
    monkeypatch.setattr(ranking, "BLOCK_TERMS", 4)
    assert found(spark, docs, ODD_ITEMS) == sorted(brute_search(docs, ODD_ITEMS), key=str)


def corpus(n, seed):
    """Documents with Zipf-like words, copies, and passages of items."""
    r = random.Random(seed)
    words = [f"t{int(1 / (1.0001 - r.random()) ** 0.8)}" for _ in range(20_000)]
    items = [" ".join(r.sample(words, 30)) for _ in range(12)]
    docs = [" ".join(r.choices(words, k=r.randrange(1, 80))) for _ in range(n)]
    docs += [docs[0]] * (n // 3) + [f"{r.choice(docs)} {r.choice(items)}" for _ in range(n // 10)]
    r.shuffle(docs)
    return list(enumerate(docs)), list(enumerate(items))


def tree_of(docs, items):
    vectors = [(d, Counter(brute_terms(t))) for d, t in docs]
    n_docs, n_terms = len(vectors), sum(v.total() for _, v in vectors)
    df = Counter(t for _, v in vectors for t in v)
    known = {t: i for i, t in enumerate(sorted({t for _, x in items for t in brute_terms(x)}, key=lambda t: -df[t]))}
    rows = [(d, v.total(), [(known[t], c) for t, c in v.items() if t in known]) for d, v in vectors]
    rows = [r for r in rows if r[2]]
    first = np.concatenate([[0], np.cumsum([len(r[2]) for r in rows])])
    m = np.array([10 + (90 * r[1] * n_docs) // n_terms for r in rows])
    term, tf = np.array([e for r in rows for e in r[2]]).T
    tree = ranking.Tree(np.array([r[0] for r in rows]), m, first, term, tf, len(known))
    return tree, known, np.array([ranking.weight(n_docs, df[t]) for t in known])


def test_tree_bounds_hold_and_the_search_is_exact():
    docs, items = corpus(3000, 5)
    tree, known, weights = tree_of(docs, items)
    wanted, scratch = defaultdict(list), np.zeros(len(known), "i8")
    for item, _, d, s in brute_search(docs, items):
        wanted[item].append((-s, d))
    for item, text in items:
        terms = np.sort([known[t] for t in set(brute_terms(text))])
        assert tree.search(terms, weights[terms], scratch, []) == wanted[item]
        assert not scratch.any()
        bound = tree.bounds(terms, weights[terms])
        scratch[terms] = weights[terms]
        gains = scratch[tree.term] * ranking.gain(tree.tf, tree.m[tree.doc])
        scratch[:] = 0
        scores = np.bincount(tree.doc, gains, len(tree.ids)).astype("i8")
        for (a, b), limit in zip(tree.spans, bound, strict=True):
            assert scores[a:b].max() <= limit
    leaves = sorted(s for s, is_leaf in zip(tree.spans, tree.leaf, strict=True) if is_leaf)
    assert [a for a, _ in leaves] == [0, *[b for _, b in leaves[:-1]]] and leaves[-1][1] == len(tree.ids)
    deep = Counter(d for a, b in tree.spans for d in range(a, b))
    assert max(deep.values()) <= math.log2(len(tree.ids)) + 2


def test_bounds_leave_out_most_leaves():
    docs, items = corpus(6000, 6)
    tree, known, weights = tree_of(docs, items)
    terms = np.sort([known[t] for t in set(brute_terms(items[0][1]))])
    best = tree.search(terms, weights[terms], np.zeros(len(known), "i8"), [])
    bound = tree.bounds(terms, weights[terms])
    reached = [int(b) >= -best[-1][0] for b, is_leaf in zip(bound, tree.leaf, strict=True) if is_leaf]
    assert sum(reached) < len(reached) / 2


@pytest.mark.parametrize("entries", [50, 700])
def test_search_in_small_trees(spark, monkeypatch, entries):
    monkeypatch.setattr(ranking, "TREE_ENTRIES", entries)
    docs, items = corpus(400, 8)
    assert found(spark, docs, items) == sorted(brute_search(docs, items), key=str)
