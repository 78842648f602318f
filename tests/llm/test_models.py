import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tallyglass.llm import classifier, lm, secrets, toxicity
from tallyglass.llm.trie import Rising, Trie, restored
from tests.llm import odd


def auc(labels, scores):
    order = np.argsort(scores)
    rank = np.empty(len(scores))
    rank[order] = np.arange(1, len(scores) + 1)
    positive = np.array(labels) == 1
    n = positive.sum()
    return (rank[positive].sum() - n * (n + 1) / 2) / (n * (len(scores) - n))


def test_quality_held_out(spark, sf_dir):
    sf = sf_dir.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = classifier.quality_scores(docs, labels).collect()
    marks = {r["doc_id"]: r["quality"] for r in labels.collect()}
    held = [r for r in rows if r["held_out"] and r["doc_id"] in marks]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert auc([marks[r["doc_id"]] for r in held], [r["score"] for r in held]) > 0.97
    assert np.mean([marks[r["doc_id"]] == r["predicted"] for r in held]) > 0.95


def test_quality_never_learns_from_held_out_rows(spark):
    docs = odd.documents(spark)
    marks = [(100 + i, int(i % 4 > 0), 0) for i in range(40)]
    flipped = [(d, 1 - q if zlib.crc32(str(d).encode()) % 4 == 2 else q, t) for d, q, t in marks]
    one, other = (sorted(map(str, classifier.quality_scores(docs, odd.labels(spark, m)).collect())) for m in (marks, flipped))
    assert one == other


@pytest.mark.parametrize("scores", [classifier.quality_scores, toxicity.toxicity_scores])
def test_scores_of_odd_rows(spark, scores):
    docs = odd.documents(spark)
    for labels in (odd.labels(spark), odd.labels(spark, []), odd.labels(spark, [(100, 1, 1)])):
        rows = scores(docs, labels).collect()
        assert len(rows) == len(odd.texts()) and all(0 <= r["score"] <= 1 for r in rows)
    assert scores(odd.documents(spark, []), odd.labels(spark)).collect() == []


def test_keep_good_keeps_columns(spark):
    docs = odd.documents(spark)
    kept = classifier.keep_good(docs, odd.labels(spark))
    assert kept.columns == docs.columns
    scores = classifier.quality_scores(docs, odd.labels(spark)).filter("score >= 0.7").select("doc_id")
    assert Counter(kept.select("doc_id").collect()) == Counter(scores.collect())


def test_isotonic():
    x, y = classifier.isotonic(np.arange(6.0), np.ones(6), np.array([0, 1, 0, 1, 1, 1.0]))
    assert (np.diff(y) > 0).all() and y[0] == 0 and y[-1] == 1 and 0.5 in y
    assert (np.diff(x) > 0).all()


def test_normal_equations_are_sums_over_all_rows(spark):
    rng = np.random.default_rng(0)
    stats = rng.normal(size=(50, classifier.N_STATS))
    rows = [(i % 2, float(i % 3 == 0), stats[i].tolist()) for i in range(50)]
    df = spark.createDataFrame(rows, "fold bigint, label double, stats array<double>").repartition(5)
    features = classifier.Features.drawn(np.zeros(classifier.N_STATS), np.ones(classifier.N_STATS), 12)
    sums = classifier._normal_equations(df, features)
    for fold in (0, 1):
        own = [r for r in rows if r[0] == fold]
        z = np.hstack([features(np.array([r[2] for r in own])), np.array([[r[1]] for r in own])])
        assert np.allclose(sums[fold], z.T @ z)


def test_fourier_features_approximate_the_kernel():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(20, 6))
    f = classifier.Features.drawn(np.zeros(6), np.ones(6), 20_000)
    waves = f(x)[:, :20_000]
    distance = ((x[:, None] - x[None]) ** 2).sum(2)
    assert np.abs(waves @ waves.T - np.exp(-distance / (4 * 6))).max() < 0.05


def test_toxicity_finds_insults_and_pairs(spark):
    rows, marks = [], []
    for i in range(400):
        text = odd.prose(i, 60)
        insult, group = i % 3 == 0, i % 2 == 0
        text += " grimbold" * insult + " the folk of the hill" * group
        rows.append((i, text, "s"))
        marks.append((i, 1, int(insult and group)))  # only together
    found = {r["doc_id"]: r for r in toxicity.toxicity_scores(odd.documents(spark, rows), odd.labels(spark, marks)).collect()}
    held = [(m[2], found[m[0]]["score"]) for m in marks if found[m[0]]["held_out"]]
    assert auc(*zip(*held, strict=True)) > 0.99
    assert np.mean([(s >= 0.5) == t for t, s in held]) > 0.95


def test_a_rare_term_counts_though_the_fitted_rows_lack_it(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "FIT_ROWS", 150)
    rows = [(i, odd.prose(i, 60) + " grimbold" * (i % 12 == 0), "s") for i in range(600)]
    marks = [(i, 1, int(i % 12 == 0)) for i in range(600)]
    rare = [i for i in range(600, 700) if zlib.crc32(str(i).encode()) % 5 != 0][:3]
    held = next(i for i in range(700, 800) if zlib.crc32(str(i).encode()) % 5 == 0)
    rows += [(i, odd.prose(i, 60) + " snarfle", "s") for i in (*rare, held)]
    marks += [(i, 1, 1) for i in rare]
    docs, labels = odd.documents(spark, rows), odd.labels(spark, marks)
    found = {r["doc_id"]: r["score"] for r in toxicity.toxicity_scores(docs, labels).collect()}
    clean = [found[i] for i in range(600) if i % 12]
    assert found[held] > 0.5 and max(clean) < 0.5
    machine = toxicity.fit(docs, labels)
    assert zlib.crc32(b"snarfle") & (toxicity.BINS - 1) in machine.terms


def test_toxicity_margin_is_the_sum_over_pairs():
    rng = np.random.default_rng(2)
    weights, vectors = rng.normal(size=10), rng.normal(size=(10, 3))
    sets = [np.array([1, 4, 7]), np.array([], "i8"), np.array([2])]
    got, _ = toxicity._margins(0.5, weights, vectors, *toxicity._flat(sets))
    for s, g in zip(sets, got, strict=True):
        pairs = sum(vectors[a] @ vectors[b] for a in s for b in s if a < b)
        assert math.isclose(g, 0.5 + weights[s].sum() + pairs, rel_tol=1e-9)


@pytest.mark.parametrize("top", [5, 300, 2**20, 2**40, 2**64 - 1])
@pytest.mark.parametrize("n", [0, 1, 5, 700])
def test_rising_finds_each_value(top, n):
    rng = np.random.default_rng(n)
    values = np.unique(rng.integers(0, top, n, dtype="u8"))
    held = Rising(*Rising.encode(values))
    assert (held[np.arange(len(values))] == values).all()
    assert held.find(values).tolist() == list(range(len(values)))
    others = np.setdiff1d(rng.integers(0, top, 500, dtype="u8"), values)
    assert (held.find(others) == -1).all()


def test_trie_keeps_probabilities():
    rng = np.random.default_rng(5)
    pairs = {(int(a), int(b)): float(p) for a, b, p in zip(rng.integers(0, 2**63, 40).repeat(5), rng.integers(0, 2**63, 200), rng.uniform(1e-6, 1, 200), strict=True)}
    first, second = (np.array([k[i] for k in pairs], "u8") for i in (0, 1))
    trie = Trie(first, second, np.array(list(pairs.values())))
    got = restored(trie(first, second))
    assert np.allclose(np.log10(got), np.log10(list(pairs.values())), atol=2e-4)
    assert (trie(second, first) == 0).all()
    assert (Trie(first[:0], second[:0], np.zeros(0))(first, second) == 0).all()


def test_lm_stores_what_is_read_twice_only(spark, monkeypatch):
    labels, store = [], lm.stored
    monkeypatch.setattr(lm, "stored", lambda df, label: labels.append(label) or store(df, label))
    rows = [(i, "the pair of the words " * (i % 5), "s") for i in range(40)]
    assert len(lm.lm_scores(odd.documents(spark, rows)).collect()) == 40
    assert labels == ["chunks", "word-answers"]


def brute_lm(rows, prior=lm.PRIOR):
    texts = [(d, [*odd.words_of("".join(c.lower() if c.isascii() else c for c in t or "")), "END"]) for d, t, _ in rows]
    train = [w for d, w in texts if zlib.crc32(str(d if d is not None else "").encode()) % 10]
    counts, pairs, before = Counter(), Counter(), Counter()
    for words in train:
        counts.update(words)
        for a, b in zip(["START", *words], words, strict=False):
            pairs[a, b] += 1
            before[a] += 1
    n, v = sum(counts.values()), len(counts)
    out = []
    for d, words in texts:
        p1 = [(counts[w] + 0.1) / (n + 0.1 * (v + 1)) for w in words]
        p2 = [(pairs[a, w] + prior * p) / (before[a] + prior) for a, w, p in zip(["START", *words], words, p1, strict=False)]
        out.append((str(d), len(words), sum(counts[w] > 0 for w in words), n, sum(map(math.log10, p1)), sum(map(math.log10, p2))))
    return sorted(out)


@pytest.mark.parametrize("chunk", [50, 800_000])
def test_lm_equals_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(lm, "CHUNK_TOKENS", chunk)
    monkeypatch.setattr(lm, "SHARD_TOKENS", 2000)  # many shards, so that frequent words are spread
    rows = [r for r in odd.texts() if not r[1] or len(r[1]) < 50_000] + [(300 + i, odd.prose(i, 30, 5), "s") for i in range(30)]
    got = sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in lm.lm_scores(odd.documents(spark, rows)).collect())
    wanted = brute_lm(rows)
    assert [g[:4] for g in got] == [w[:4] for w in wanted]
    assert np.allclose([g[4] for g in got], [w[4] for w in wanted], rtol=1e-9)
    assert np.allclose([g[5] for g in got], [w[5] for w in wanted], rtol=1e-3)


def test_lm_of_nothing(spark):
    assert lm.lm_scores(odd.documents(spark, [])).collect() == []
    alone = next(d for d in range(100) if zlib.crc32(str(d).encode()) % 10 == 0)
    (row,) = lm.lm_scores(odd.documents(spark, [(alone, "only held out", "s")])).collect()
    assert (row["train_tokens"], row["n_known"], row["base_score"]) == (0, 0, 0.0)


def brute_spans(text):
    out = []
    pattern = r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD])|(?:[pP][aA][sS][sS][wW][dD])|(?:[sS][eE][cC][rR][eE][tT])|(?:[tT][oO][kK][eE][nN])|(?:[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    out += [(m.start(), 0, m.end(), "assign") for m in re.finditer(pattern, text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return [f"{k}:{a}:{b}" for a, _, b, k in sorted(out)]


def secret_texts():
    rng = np.random.default_rng(8)

    def key(n, alphabet="0123456789abcdef"):
        return "".join(rng.choice(list(alphabet), n))

    mixed = "ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz23456789"
    rows = [(i, f'{odd.prose(i, 30)} token = "{key(40)}" {odd.prose(i + 1, 20)}', "s") for i in range(60)]
    rows += [(100 + i, f"{odd.prose(i, 30)} API_KEY: {key(32, mixed)} {odd.prose(i + 1, 20)}", "s") for i in range(60)]
    rows += [(200 + i, odd.prose(i, 60) + f" www.site{i}.example.com/page-number-{i}-of-many order-2024-{i:04}-{i:06}", "s") for i in range(60)]
    rows += [(300, f"my credential is {key(36, mixed)} so keep it", "s"), (301, f"passwd='{key(5)}' password:token: abcdefgh AKIA{key(16, 'ABCDEF0123')} AKIA123", "s")]
    rows += [(302, "toKen=ſecret pаssword=abcdefg 😀 secret:'ab-cd_ef' AKIAAKIA" + "Z9" * 8 + " " + "a1" * 40, "s")]
    return rows


def test_secret_report(spark):
    rows = [*odd.texts(), *secret_texts()]
    found = secrets.secret_report(odd.documents(spark, rows)).collect()
    wanted = sorted((str(d), ",".join(brute_spans(t or ""))) for d, t, _ in rows)
    base = sorted((str(r["doc_id"]), ",".join(s for s in r["spans"].split(",") if not s.startswith("model"))) for r in found)
    assert base == wanted
    for r in found:
        own = ",".join(s for s in r["spans"].split(",") if s and not s.startswith("model"))
        assert r["base_sha256"] == hashlib.sha256(own.encode()).hexdigest()
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(own.count(k + ":") for k in ("assign", "access", "hex"))
    by_id = {r["doc_id"]: r for r in found}
    assert by_id[300]["n_model"] == 1  # what no pattern names
    assert not any(by_id[200 + i]["n_model"] for i in range(60))


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(4)
    field = secrets.Field(rng.normal(size=(len(secrets.FEATURES), 3)), rng.normal(size=(3, 3)) + secrets._FORBIDDEN)
    for _ in range(30):
        rows = [[0, 0, int(rng.integers(0, 2)), rng.choice(len(secrets.FEATURES), 4, replace=False).tolist(), 0] for _ in range(6)]
        best, path = -np.inf, None
        for code in range(3**6):
            labels = [code // 3**k % 3 for k in range(6)]
            if any(x and not r[2] for x, r in zip(labels, rows, strict=True)):
                continue
            score = sum(field.moves[a, b] for a, b in zip([0, *labels], labels, strict=False))
            score += sum(field.weights[r[3], x].sum() for x, r in zip(labels, rows, strict=True))
            if score > best:
                best, path = score, labels
        assert field.decode(rows) == path


def test_redact(spark):
    docs = odd.documents(spark, [*odd.texts(), *secret_texts()])
    clean = secrets.redact(docs)
    assert clean.columns == docs.columns and clean.count() == docs.count()
    for r in clean.collect():
        assert not brute_spans(r["text"] or "")
        assert r["n_chars"] == (None if r["text"] is None else len(r["text"]))


def test_secrets_of_nothing(spark):
    assert secrets.secret_report(odd.documents(spark, [])).collect() == []
    (row,) = secrets.secret_report(odd.documents(spark, [(1, "credential 8fKq2LmZ0aPx9RtYw3Vn", "s")])).collect()
    assert row["n_model"] == 0  # nothing to learn from
