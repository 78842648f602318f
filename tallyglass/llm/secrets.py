"""Secret scan: exact patterns, and a linear-chain conditional random field for what they do not name.

A text is cut into tokens.  Only a token that is long and mixes letters with digits may begin (B) or continue (I) a secret;
all others are outside (O) by rule.  So the best path falls apart at the others, and only the neighbourhoods of such
tokens have to be decoded.  The field is trained on the patterns' own matches, with the telling neighbours left out of half
of them, so that it also has to go by a token's shape; training uses a bounded number of neighbourhoods, half of it kept for
those with a match.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyglass.llm.common import DOCS_PER_CALL, id_and_text, map_texts, stored

# The patterns of the base result.  Runs of a class are matched whole, so a least length can stand in them.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_ASSIGNED = 6
KINDS = ("assign", "access", "hex", "model")

#: A token that may be part of a secret; the look-aheads want a digit and a letter in it.
ELIGIBLE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]+|[^\sA-Za-z0-9+/_=-]")
CLUES = re.compile(r"pass(word|wd)?|secret|token|key|auth|bearer|credential|private|access", re.IGNORECASE | re.ASCII)
#: Characters around an eligible token that its neighbourhood takes in.
AROUND = 48
#: Parts of neighbourhoods the field is trained on at most, of those with a pattern's match and as many of those without.
FIT_SEGMENTS = 2000
LONGEST = 24  # tokens of a training neighbourhood; longer ones are trained on in parts
STEPS, RATE, DECAY = 150, 0.15, 1e-3
O, B, I = 0, 1, 2

FEATURES = [
    "bias", "eligible", "short", "word", "sign", "quote", "equals", "colon", "long24", "long32", "long48", "hex", "upper_digit",
    "mixed_case", "has_sign", "many_digits", "some_digits", "entropy3", "entropy4", "clue", "clue_before", "clue_two_before",
    "assign_before", "quote_before", "quote_after", "space_around", "slash_before", "dot_near", "at_near", "file_short",
    "file_signs", "file_digits", "file_clues", "akia", "dashes",
]
_NUMBER = {name: i for i, name in enumerate(FEATURES)}
#: Features that name a secret outright; left out of half of the training matches.
TELLING = {_NUMBER[f] for f in ("clue_before", "clue_two_before", "assign_before", "akia", "file_clues")}


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the patterns' matches; per kind from the left without overlaps, short ones dropped."""
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGNED]
    found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def _eligible(token: str) -> bool:
    return len(token) >= 16 and any(c.isdigit() for c in token) and any(c.isalpha() for c in token)


def _entropy(token: str) -> float:
    return -sum(n / len(token) * math.log2(n / len(token)) for n in Counter(token).values())


def _features(tokens: list[str], at: int, file: list[str]) -> list[int]:
    token = tokens[at]
    before, before2 = tokens[at - 1] if at else "", tokens[at - 2] if at > 1 else ""
    after = tokens[at + 1] if at + 1 < len(tokens) else ""
    digits = sum(c.isdigit() for c in token)
    n = len(token)
    on = ["bias"]
    if _eligible(token):
        entropy = _entropy(token)
        on.append("eligible")
        on += [f for f, yes in (
            ("long24", n >= 24), ("long32", n >= 32), ("long48", n >= 48), ("hex", re.fullmatch(r"[0-9a-fA-F]+", token)),
            ("upper_digit", re.fullmatch(r"[A-Z0-9]+", token)), ("mixed_case", token.lower() != token and token.upper() != token),
            ("has_sign", re.search(r"[+/_=]", token)), ("many_digits", digits * 4 >= n), ("some_digits", 0 < digits * 4 < n),
            ("entropy3", entropy >= 3), ("entropy4", entropy >= 4), ("akia", token.startswith("AKIA")), ("dashes", token.count("-") > 1),
            ("dot_near", "." in (before, after)), ("at_near", "@" in (before, after)), ("slash_before", before.endswith("/")),
        ) if yes]
        if before in ("=", ":") or before2 in ("=", ":"):
            on.append("assign_before")
        if before in ("'", '"', "`"):
            on.append("quote_before")
        if after in ("'", '"', "`"):
            on.append("quote_after")
        near = [t for t in tokens[max(0, at - 5) : at] if CLUES.search(t)]
        if near:
            on.append("clue_before" if near[-1] in tokens[max(0, at - 3) : at] else "clue_two_before")
        on += file
    elif re.fullmatch(r"[A-Za-z]+", token):
        on.append("clue" if CLUES.search(token) else "word")
    elif n == 1:
        on += ["sign", *(f for f, c in (("quote", "'\"`"), ("equals", "="), ("colon", ":")) if token in c)]
    else:
        on.append("short")
    return [_NUMBER[f] for f in on]


def segments(text: str, spans: list[tuple[int, int, str]]) -> list[list[list]]:
    """Neighbourhoods of eligible tokens: per token [start, end, eligible, features, label by the patterns]."""
    windows: list[list[int]] = []
    for m in ELIGIBLE.finditer(text):
        if not _eligible(m[0]):
            continue
        low, high = max(0, m.start() - AROUND), min(len(text), m.end() + AROUND)
        if windows and low <= windows[-1][1]:
            windows[-1][1] = high
        else:
            windows.append([low, high])
    if not windows:
        return []
    n = max(1, len(text))
    file = [f for f, yes in (
        ("file_short", n < 400), ("file_signs", sum(map(text.count, "#$%&*|{};")) * 50 > n),
        ("file_digits", sum(map(text.count, "0123456789")) * 20 > n), ("file_clues", CLUES.search(text)),
    ) if yes]
    out = []
    starts = [s[0] for s in spans]
    for low, high in windows:
        # whole tokens only: the ends move outwards to where a token ends
        while low > 0 and re.match(r"[A-Za-z0-9+/_=-]", text[low - 1]):
            low -= 1
        while high < len(text) and re.match(r"[A-Za-z0-9+/_=-]", text[high]):
            high += 1
        places = [(m.start(), m.end()) for m in TOKEN.finditer(text, low, high)]
        tokens = [text[a:b] for a, b in places]
        rows, last_span = [], None
        inside = [s for s in spans if s[0] < high and s[1] > low] if starts else []
        for k, (a, b) in enumerate(places):
            label, can = O, _eligible(tokens[k])
            if can:
                span = next((s for s in inside if s[0] < b and s[1] > a), None)
                if span:
                    label = I if span is last_span else B
                    last_span = span
            rows.append([a, b, int(can), _features(tokens, k, file), label])
        out.append(rows)
    return out


class Field:
    """Weights of features by label, and of neighbouring labels."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray):
        self.weights, self.moves = weights, moves

    def decode(self, rows: list[list]) -> list[int]:
        """The best labels of one neighbourhood (Viterbi); a token that is not eligible is outside."""
        score = np.array([0.0, -np.inf, -np.inf])  # as after a token outside
        back = []
        for _, _, can, on, _ in rows:
            paths = score[:, None] + self.moves
            back.append(paths.argmax(0))
            score = paths.max(0) + self.weights[on].sum(0)
            if not can:
                score[1:] = -np.inf
        labels = [int(score.argmax())]
        for step in reversed(back[1:]):
            labels.append(int(step[labels[-1]]))
        return labels[::-1]


_FORBIDDEN = np.zeros((3, 3))
_FORBIDDEN[O, I] = -np.inf  # nothing continues what has not begun


def train(samples: list[list[list]]) -> Field:
    """Weights that maximise the log-likelihood of the labels, by gradient steps over all neighbourhoods at once."""
    parts = [s[at : at + LONGEST] for s in samples for at in range(0, len(s), LONGEST)]
    if not any(t[4] for s in parts for t in s):
        return Field(np.tile([1.0, 0.0, 0.0], (len(FEATURES), 1)), _FORBIDDEN)
    n, width = len(parts), max(map(len, parts))
    on = np.zeros((n, width, len(FEATURES)), "f4")
    can, real, gold = np.zeros((n, width), bool), np.zeros((n, width), bool), np.zeros((n, width), "i8")
    for i, part in enumerate(parts):
        hide = i % 2 == 1
        for t, (_, _, eligible, features, label) in enumerate(part):
            on[i, t, [f for f in features if not (hide and f in TELLING)]] = 1
            can[i, t], real[i, t], gold[i, t] = eligible, True, label
    for i, t in zip(*np.nonzero(gold == I), strict=True):  # a part may begin inside a secret
        if t == 0 or gold[i, t - 1] == O:
            gold[i, t] = B
    blocked = np.where((~can)[:, :, None] & (np.arange(3) > 0), -1e9, 0.0)
    wanted = np.eye(3)[gold] * real[:, :, None]
    pairs = np.zeros((3, 3))
    np.add.at(pairs, (gold[:, :-1], gold[:, 1:]), (real[:, :-1] & real[:, 1:]).astype(float))
    weights, moves = np.zeros((len(FEATURES), 3)), np.zeros((3, 3))
    forbidden = np.where(np.isinf(_FORBIDDEN), -1e9, 0.0)
    m_w, v_w, m_m, v_m = np.zeros_like(weights), np.zeros_like(weights), np.zeros((3, 3)), np.zeros((3, 3))
    both = real[:, :-1] & real[:, 1:]

    def total(x: np.ndarray, axis: int) -> np.ndarray:
        top = x.max(axis, keepdims=True)
        return np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis)

    for step in range(1, STEPS + 1):
        emit = on @ weights + blocked
        move = moves + forbidden
        ahead, behind = np.zeros((n, width, 3)), np.zeros((n, width, 3))
        ahead[:, 0] = emit[:, 0] + np.array([0, 0, -1e9])
        for t in range(1, width):
            new = total(ahead[:, t - 1, :, None] + move, 1) + emit[:, t]
            ahead[:, t] = np.where(real[:, t, None], new, ahead[:, t - 1])
        for t in range(width - 2, -1, -1):
            new = total(move + (emit[:, t + 1] + behind[:, t + 1])[:, None, :], 2)
            behind[:, t] = np.where(real[:, t + 1, None], new, 0.0)
        z = total(ahead[:, -1], 1)
        chance = np.exp(np.minimum(ahead + behind - z[:, None, None], 0)) * real[:, :, None]
        joint = ahead[:, :-1, :, None] + move + (emit[:, 1:] + behind[:, 1:])[:, :, None, :] - z[:, None, None, None]
        expected = (np.exp(np.minimum(joint, 0)) * both[:, :, None, None]).sum((0, 1))
        g_w = np.tensordot(on, wanted - chance, ((0, 1), (0, 1))) / n - DECAY * weights
        g_m = (pairs - expected) / n - DECAY * moves
        for value, g, m, v in ((weights, g_w, m_w, v_w), (moves, g_m, m_m, v_m)):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            value += RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Field(weights, moves + _FORBIDDEN)


def scan_table(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """Stored rows: per document the patterns' spans and the neighbourhoods to decode, as JSON."""

    def each(ids: list, texts: list) -> dict[str, list]:
        spans = [base_spans(t) for t in texts]
        found = [segments(t, s) for t, s in zip(texts, spans, strict=True)]
        return {"doc_id": ids, "spans": [json.dumps(s) for s in spans], "segments": [json.dumps(f) if f else None for f in found]}

    return stored(map_texts(id_and_text(docs), each, "doc_id bigint, spans string, segments string"), "scanned")


def training_parts(scanned: DataFrame) -> DataFrame:
    """Rows (doc_id, at, matched, part): all neighbourhoods in parts of ``LONGEST`` tokens, and whether a match lies in them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, found in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                parts = [s[at : at + LONGEST] for s in json.loads(found) for at in range(0, len(s), LONGEST)]
                for k in range(0, len(parts), 1000):
                    some = parts[k : k + 1000]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([doc_id] * len(some), pa.int64()),
                            pa.array(range(k, k + len(some)), pa.int64()),
                            pa.array([any(t[4] for t in p) for p in some]),
                            pa.array([json.dumps(p) for p in some]),
                        ],
                        names=["doc_id", "at", "matched", "part"],
                    )

    rows = scanned.filter("segments is not null").select("doc_id", "segments")
    return rows.mapInArrow(run, "doc_id bigint, at bigint, matched boolean, part string")


def fit(scanned: DataFrame) -> Field:
    """A field from at most ``FIT_SEGMENTS`` parts of neighbourhoods with a match and as many without, drawn by hash from all."""
    parts = stored(training_parts(scanned), "parts")
    drawn = [
        row["part"]
        for matched in (True, False)
        for row in parts.filter(F.col("matched") == matched).select("part", F.xxhash64("doc_id", "at", "part").alias("draw"))
        .orderBy("draw", "part").limit(FIT_SEGMENTS).collect()
    ]
    return train([json.loads(p) for p in drawn])


def all_spans(field: Field, spans: list, found: list) -> list[tuple[int, int, str]]:
    """The patterns' spans and the field's, less those of the field that touch one of the patterns'."""
    extra = []
    for rows in found:
        begun = None
        for (a, b, *_), label in zip(rows, field.decode(rows), strict=True):
            if label == B:
                begun = (a, b, "model")
                extra.append(begun)
            elif label == I and begun:
                extra[-1] = begun = (begun[0], b, "model")
            else:
                begun = None
    extra = [e for e in extra if not any(s[0] < e[1] and s[1] > e[0] for s in spans)]
    return sorted([*map(tuple, spans), *extra], key=lambda s: (s[0], KINDS.index(s[2])))


def _joined(spans: list) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def secret_report(docs: DataFrame) -> DataFrame:
    """One row per document: counts by pattern, a digest of the patterns' spans, and all spans.

    A NULL or empty text has none.  Without a pattern match anywhere to learn from, the field finds nothing.
    """
    scanned = scan_table(docs)
    field = fit(scanned)
    schema = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_model bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {c.split()[0]: [] for c in schema.split(", ")}
            for doc_id, spans, found in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                spans = json.loads(spans)
                everything = all_spans(field, spans, json.loads(found) if found else [])
                kinds = Counter(s[2] for s in everything)
                row = (
                    doc_id, kinds["assign"], kinds["access"], kinds["hex"], hashlib.sha256(_joined(spans).encode()).hexdigest(),
                    _joined(everything), kinds["model"],
                )
                for values, value in zip(out.values(), row, strict=True):
                    values.append(value)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([(k, pa.string() if k in ("base_sha256", "spans") else pa.int64()) for k in out]))

    return scanned.select("doc_id", "spans", "segments").mapInArrow(run, schema)


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """``docs`` with every span in its text replaced by ``mark``, and ``n_chars`` set to the new length where it changed.

    A NULL text stays NULL, an empty one empty; repeated rows change alike; an empty table stays empty.  Columns of any name
    pass through, as they travel inside one struct.
    """
    field = fit(scan_table(docs))

    def one(text: str | None) -> str | None:
        if text is None:
            return None
        spans = base_spans(text)
        parts, at = [], 0
        for start, end, _ in all_spans(field, spans, segments(text, spans)):
            if start >= at:
                parts += [text[at:start], mark]
            at = max(at, end)
        return "".join([*parts, text[at:]]) if parts else text

    @F.arrow_udf("string")
    def cleaned(texts: pa.Array) -> pa.Array:
        # slices, so that a worker holds few texts as strings at a time
        parts = [pa.array([one(t) for t in texts.slice(at, DOCS_PER_CALL).to_pylist()], pa.string()) for at in range(0, len(texts), DOCS_PER_CALL)]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.string())

    others = [c for c in docs.columns if c != "text"]
    held = F.struct(F.lit(0).alias("text"), *[F.col(f"`{c}`") for c in others]).alias("held")
    out = docs.select(held, F.col("text").alias("before"), cleaned("text").alias("after"))
    columns = []
    for c in docs.columns:
        if c == "text":
            columns.append(F.col("after").alias("text"))
        elif c == "n_chars":
            changed = ~F.col("before").eqNullSafe(F.col("after"))
            length = F.length("after").cast(docs.schema[c].dataType)
            columns.append(F.when(changed, length).otherwise(F.col("held").getField(c)).alias(c))
        else:
            columns.append(F.col("held").getField(c).alias(c))
    return out.select(*columns)
