import random
import re
import zlib
from collections import Counter

import pytest

from tallyglass.llm import spelling
from tests.llm import odd

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_vocabulary(rows):
    counts = Counter()
    for d, t in rows:
        for run in RUN.findall(t or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def one_edit(a, b):
    """Whether a is not b and one letter inserted, deleted or replaced makes it b."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


def brute_report(counts):
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 5 * counts[w] else None
    out = []
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), counts[form[w]] if form[w] else None))
    return sorted(out)


def report(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def invented(seed, n_words, n_docs, letters="abé", lengths=(5, 8), length=1200):
    """Documents of few letters, so that many words are near, with frequent words and their variants."""
    r = random.Random(seed)
    words = ["".join(r.choices(letters, k=r.randint(*lengths))) for _ in range(n_words)]
    weights = [6**-i for _ in range(n_words // 6 + 1) for i in range(6)][:n_words]
    return [(i, " ".join(w.upper() if r.random() < 0.1 else w for w in r.choices(words, weights, k=length)) + ". É,À") for i in range(n_docs)]


def test_awkward_rows(spark):
    rows = [(d, t) for d, t, _ in odd.texts()] + [(60, "spelling " * 30 + "speling " * 5 + "sspelling " * 6), (None, "spelling Éclairs÷× " * 6), (None, None)]
    found = report(spelling.spelling_variants(odd.documents(spark, [(d, t, "s") for d, t in rows])))
    assert found == brute_report(brute_vocabulary(rows)) and ("speling", "spelling", "spelling", 5, 1, 36) in found


def test_empty_table(spark):
    assert spelling.spelling_variants(odd.documents(spark, [])).collect() == []


@pytest.mark.parametrize("list_words", [4, 40, 4000])
def test_report_equals_brute_force(spark, list_words):
    rows = invented(1, 900, 60)
    counts = brute_vocabulary(rows)
    wanted = brute_report(counts)
    chains = sum(1 for w in wanted if w[1] is not None and w[1] != w[2])
    assert len(wanted) > 300 and chains > 3
    found = spelling.spelling_variants(odd.documents(spark, [(d, t, "s") for d, t in rows]), list_words)
    assert report(found) == wanted


def test_words_with_long_equal_beginnings(spark):
    r = random.Random(3)
    words = {"a" * r.randint(6, 30) + "".join(r.choices("ab", k=r.randint(0, 6))) + "a" * r.randint(0, 8) for _ in range(400)}
    frame = spark.createDataFrame([(w, 5) for w in words], "word string, n bigint")
    for limit in (3, 50):
        found = sorted((x["word"], x["near"]) for x in spelling.near_words(frame, limit).collect())
        assert found == sorted((a, b) for a in words for b in words if one_edit(a, b))


def test_scan_of_a_list_equals_all_pairs():
    r = random.Random(9)
    for trial in range(300):
        words = sorted({"".join(r.choices("abc", k=r.randint(2, 3 + trial % 5))) for _ in range(r.randint(2, 40))})
        for shorter in {len(w) for w in words}:
            found = list(spelling.pairs_in_list(words, shorter, 2))
            wanted = [
                (i, j)
                for i, a in enumerate(words)
                for j, b in enumerate(words)
                if i < j and one_edit(a, b) and min(len(a), len(b)) == shorter and a[:2] != b[:2]
            ]
            assert sorted(found) == wanted


def test_dead_ranges_are_skipped():
    class Counted(str):
        looked = 0

        def __getitem__(self, at):
            Counted.looked += 1
            return str.__getitem__(self, at)

    words = [Counted(f"{a}{b}{c}{d}") for a in "abcdefgh" for b in "abcdefgh" for c in "abcdefgh" for d in "abcdefgh"]
    found = sum(1 for _ in spelling.pairs_in_list(words, 4, 5))
    assert found == 8**4 * 4 * 7 // 2
    # far fewer letters are read than a scan of all pairs has words
    assert Counted.looked < len(words) ** 2 / 2
