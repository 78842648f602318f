"""License scan: a suffix automaton of license texts, matching statistics, chained template spans.

All templates and phrases go into one generalised suffix automaton over word numbers.  A document's words are streamed
through it: after each word the automaton holds the longest suffix of the words so far that stands in some template (the
matching statistic) and the state of that suffix.  Where a match of at least ``MIN_MATCH`` words cannot grow it becomes an
anchor; anchors of one template in text order and template order are chained over small gaps, and a chain that covers
enough of its template is a span.  A phrase ends at a word when its state is the current state or one of its suffixes.

Templates are notices and, from ``license_texts``, every paragraph of the licenses.  A template of fewer than ``SHORT`` words
has to stand in the text whole and unbroken, like a phrase; a span of a template that holds its license's name must hold the
name too; and where spans of two licenses lie over each other, the one with more of the words stays.
"""

from __future__ import annotations

import re
from functools import lru_cache
from pathlib import Path

from pyspark.sql import DataFrame

from tallyglass.llm.common import id_and_text, map_texts

# The phrases of the base result and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# Wording of public licenses, as their notices give it.
TEMPLATES = {
    "mit": [
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
        "documentation files the software to deal in the software without restriction including without limitation the "
        "rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
        "released under the mit license",
        "licensed under the mit license",
    ],
    "apache-2": [
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the "
        "license you may obtain a copy of the license at",
        "licensed under the apache license version 2 0",
    ],
    "bsd": [
        "redistribution and use in source and binary forms with or without modification are permitted provided that the "
        "following conditions are met",
    ],
    "gpl": [
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
        "license as published by the free software foundation either version",
        "licensed under the gnu general public license",
    ],
    "lgpl": ["under the terms of the gnu lesser general public license as published by the free software foundation"],
    "mpl-2": ["this source code form is subject to the terms of the mozilla public license v 2 0"],
    "isc": [
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    ],
    "cc-by": ["this work is licensed under a creative commons attribution 4 0 international license"],
    "cc-by-sa": ["this work is licensed under a creative commons attribution sharealike 4 0 international license"],
    "cc-by-nc": [
        "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
        "licensed under cc by nc",
    ],
}
# The short notices of the licenses that go by a name, and the creative commons notices of other versions.
for _label, _names in {
    "mit": ["mit license"],
    "apache-2": ["apache license version 2 0", "apache license 2 0", "apache 2 0 license"],
    "gpl": ["gnu general public license", "gnu gpl"],
    "lgpl": ["gnu lesser general public license", "gnu library general public license", "gnu lgpl"],
    "mpl-2": ["mozilla public license 2 0", "mozilla public license version 2 0", "mozilla public license v 2 0"],
    "isc": ["isc license"],
    "bsd": ["bsd license", "2 clause bsd license", "3 clause bsd license", "bsd 2 clause license", "bsd 3 clause license"],
}.items():
    for _start in ("licensed", "released", "distributed"):
        TEMPLATES[_label] += [f"{_start} under {x} {n}" for x in ("the", "the terms of the") for n in _names]
for _label, _name in {"cc-by": "attribution", "cc-by-sa": "attribution sharealike", "cc-by-nc": "attribution noncommercial"}.items():
    for _version in ("3 0 unported", "2 5 generic", "2 0 generic"):
        TEMPLATES[_label].append(f"this work is licensed under a creative commons {_name} {_version} license")
TEMPLATES["cc-by"] += [f"licensed under cc by {v}" for v in ("4 0", "3 0", "2 5", "2 0")]
TEMPLATES["cc-by-sa"].append("licensed under cc by sa")

# Words that tell a license from those with like wording; a span of a template that holds one of them must hold one.
NAMES = {
    "apache-2": ["apache license"],
    "gpl": ["gnu general public license"],
    "lgpl": ["lesser general public license", "library general public license"],
    "mpl-2": ["mozilla public license"],
    "cc-by": [f"commons attribution {v}" for v in ("4 0", "3 0", "2 5", "2 0")],
    "cc-by-sa": ["attribution sharealike"],
    "cc-by-nc": [f"attribution noncommercial {v}" for v in ("4 0", "3 0", "2 5", "2 0")],
}

SHORT = 12  # words of a template from which on it may be covered in parts
MIN_MATCH = 3  # words of an anchor
MAX_GAP = 12  # words between two anchors of a chain, in the text and in the template
MIN_COVER = 0.6  # share of a template that a chain must cover

#: Words of the lower-cased text as UTF-8: every byte from 0x80 on belongs to a character that the pattern takes.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")

SCHEMA = (
    "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, "
    "score double, spans array<struct<label:string,first_word:bigint,last_word:bigint,cover:double>>"
)


class SuffixAutomaton:
    """Of several word sequences; states are numbered, 0 is the empty match."""

    def __init__(self, sequences: list[list[bytes]]):
        self.words = {w: i for i, w in enumerate(dict.fromkeys(w for s in sequences for w in s))}
        self.step: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        self.ends: list[dict[int, int]] = [{}]  # sequence -> where a match of this state ends in it
        for number, sequence in enumerate(sequences):
            last = 0
            for at, word in enumerate(sequence):
                last = self._extend(last, self.words[word])
                self.ends[last].setdefault(number, at)
        for state in sorted(range(1, len(self.step)), key=lambda s: -self.length[s]):
            if self.link[state] > 0:
                for number, at in self.ends[state].items():
                    self.ends[self.link[state]].setdefault(number, at)

    def _add(self, step: dict[int, int], link: int, length: int) -> int:
        self.step.append(step)
        self.link.append(link)
        self.length.append(length)
        self.ends.append({})
        return len(self.step) - 1

    def _split(self, at: int, word: int) -> int:
        """The state reached from ``at`` by ``word``, made to be exactly one word longer than ``at``."""
        target = self.step[at][word]
        if self.length[target] == self.length[at] + 1:
            return target
        part = self._add(dict(self.step[target]), self.link[target], self.length[at] + 1)
        self.link[target] = part
        while at >= 0 and self.step[at].get(word) == target:
            self.step[at][word] = part
            at = self.link[at]
        return part

    def _extend(self, last: int, word: int) -> int:
        if word in self.step[last]:
            return self._split(last, word)
        new = self._add({}, 0, self.length[last] + 1)
        at = last
        while at >= 0 and word not in self.step[at]:
            self.step[at][word] = new
            at = self.link[at]
        if at >= 0:
            self.link[new] = self._split(at, word)
        return new

    def state_of(self, sequence: list[bytes]) -> int:
        state = 0
        for word in sequence:
            state = self.step[state][self.words[word]]
        return state

    def suffixes(self, state: int) -> list[int]:
        """The state and all states of its shorter suffixes."""
        found = []
        while state > 0:
            found.append(state)
            state = self.link[state]
        return found


def license_texts() -> dict[str, list[str]]:
    """Every paragraph of the licenses in ``license_texts``; headings and other short ones go with the next."""
    found: dict[str, list[str]] = {}
    for path in sorted((Path(__file__).parent / "license_texts").glob("*.txt")):
        label = next(x for x in sorted(TEMPLATES, key=len, reverse=True) if path.name.startswith(x))
        many, short = found.setdefault(label, []), []
        for paragraph in re.split(rb"\n\s*\n", path.read_bytes().lower()):
            short += WORD.findall(paragraph)
            if len(short) >= SHORT:
                many.append(b" ".join(short).decode())
                short = []
        if short:
            many.append(f"{many.pop()} {b' '.join(short).decode()}")
    return found


class Scanner:
    def __init__(self, templates: dict[str, list[str]], phrases: dict[str, str]):
        texts = [(label, t.encode().split()) for label, many in templates.items() for t in dict.fromkeys(many)]
        # The phrases, and after them the short templates: both have to stand in the text whole.
        self.phrases = [(p.encode().split(), label) for p, label in phrases.items()]
        self.n_phrases = len(self.phrases)
        self.phrases += [(words, label) for label, words in texts if len(words) < SHORT]
        texts = [(label, words) for label, words in texts if len(words) >= SHORT]
        names = {label: [b" " + n.encode() + b" " for n in many] for label, many in NAMES.items()}
        # Per template the names of which its spans must hold one; none where the template has no name in it.
        self.names = [
            names[label] if any(n in b" %b " % b" ".join(words) for n in names.get(label, ())) else () for label, words in texts
        ]
        self.labels = [label for label, _ in texts]
        self.lengths = [len(words) for _, words in texts]
        self.automaton = SuffixAutomaton([words for _, words in texts] + [words for words, _ in self.phrases])
        homes: dict[int, list[int]] = {}
        for n, (words, _) in enumerate(self.phrases):
            homes.setdefault(self.automaton.state_of(words), []).append(n)
        self.phrases_at = [
            tuple(n for s in self.automaton.suffixes(state) for n in homes.get(s, ())) for state in range(len(self.automaton.step))
        ]

    def matches(self, words: list[bytes]):
        """Yields (position, state, length) of matches that cannot grow; phrase and short template places go to ``self.places``."""
        a = self.automaton
        step, link, lengths, phrases_at = a.step, a.link, a.length, self.phrases_at
        self.places = []
        state = length = 0
        at = -1
        for at, word in enumerate(map(a.words.get, words)):
            if word is None:
                if state:
                    if length >= MIN_MATCH:
                        yield at - 1, state, length
                    state = length = 0
                continue
            if word not in step[state]:
                if length >= MIN_MATCH:
                    yield at - 1, state, length
                while state and word not in step[state]:
                    state = link[state]
                    length = lengths[state] if state else 0
            if word in step[state]:
                state, length = step[state][word], length + 1
                if length >= MIN_MATCH and phrases_at[state]:
                    for n in phrases_at[state]:
                        size = len(self.phrases[n][0])
                        if length >= size:
                            self.places.append((at - size + 1, n))
        if length >= MIN_MATCH:
            yield at, state, length

    def chains(self, words: list[bytes]) -> list[tuple[str, int, int, float]]:
        """Spans (label, first word, last word, share of the template) of the chains that cover enough."""
        open_chains: dict[int, list[tuple[int, int, int, int]]] = {}  # template -> (first, text end, template end, covered)
        done: list[tuple[int, int, int, int]] = []
        for at, state, length in self.matches(words):
            for number, end in self.automaton.ends[state].items():
                if number >= len(self.labels):
                    continue
                start, t_start = at - length + 1, end - length + 1
                best = (start, at, end, length)
                kept = []
                for first, e, t_end, covered in open_chains.get(number, ()):
                    if start - e > MAX_GAP:
                        done.append((number, first, e, covered))
                        continue
                    kept.append((first, e, t_end, covered))
                    overlap = max(0, e - start + 1, t_end - t_start + 1)
                    if e < at and t_end < end and t_start - t_end <= MAX_GAP and covered + length - overlap > best[3]:
                        best = (first, at, end, covered + length - overlap)
                open_chains[number] = [*(k for k in kept if k[0] != best[0]), best]
        for number, many in open_chains.items():
            done += [(number, first, e, covered) for first, e, _, covered in many]
        spans: dict[tuple[str, int, int], tuple[int, float]] = {}
        for number, first, last, covered in done:
            share = min(1.0, covered / self.lengths[number])
            if share >= MIN_COVER and self._named(number, words[first : last + 1]):
                key = (self.labels[number], first, last)
                spans[key] = max((covered, share), spans.get(key, (0, 0.0)))
        for at, n in self.places:
            if n >= self.n_phrases:
                phrase, label = self.phrases[n]
                key = (label, at, at + len(phrase) - 1)
                spans[key] = max((len(phrase), 1.0), spans.get(key, (0, 0.0)))
        return [(*k, v[1]) for k, v in sorted(_unrivalled(spans).items(), key=lambda x: (x[0][1], x[0][2], x[0][0]))]

    def _named(self, number: int, words: list[bytes]) -> bool:
        names = self.names[number]
        return not names or any(n in b" %b " % b" ".join(words) for n in names)

    def scan(self, text: str) -> dict:
        words = WORD.findall(text.encode().lower())
        spans = self.chains(words)
        places = [(at, n) for at, n in self.places if n < self.n_phrases]
        base = {self.phrases[n][1] for _, n in places}
        starts = [p for p, _ in places]
        return {
            "n_words": len(words),
            "n_base": len(places),
            "first_word": min(starts, default=None),
            "last_word": max(starts, default=None),
            "base_labels": ",".join(sorted(base)),
            "labels": ",".join(sorted(base | {s[0] for s in spans})),
            "score": 1.0 if places else max((s[3] for s in spans), default=0.0),
            "spans": [dict(zip(("label", "first_word", "last_word", "cover"), s, strict=True)) for s in spans],
        }


def _unrivalled(spans: dict[tuple[str, int, int], tuple[int, float]]) -> dict[tuple[str, int, int], tuple[int, float]]:
    """The spans (label, first, last) -> (words covered, share) that no other license's span over the same words beats.

    Some paragraphs stand in two licenses; such a tie goes to a license that has a span of its own in the text, if there is one.
    """
    rivals: dict[tuple, list[tuple]] = {k: [] for k in spans}
    active: list[tuple] = []
    for key in sorted(spans, key=lambda k: k[1:]):
        active = [a for a in active if a[2] >= key[1]]
        for other in active:
            both = min(other[2], key[2]) - key[1] + 1
            if other[0] != key[0] and 2 * both > min(other[2] - other[1], key[2] - key[1]) + 1:
                rivals[key].append(other)
                rivals[other].append(key)
        active.append(key)
    top = {k: max((spans[r][0] for r in many), default=0) for k, many in rivals.items()}
    own = {k[0] for k, (covered, _) in spans.items() if covered > top[k]}
    return {
        k: v for k, v in spans.items()
        if v[0] > top[k] or (v[0] == top[k] and (k[0] in own or not any(r[0] in own for r in rivals[k] if spans[r][0] == v[0])))
    }


@lru_cache(maxsize=1)
def _default_scanner() -> Scanner:
    texts = license_texts()
    return Scanner({label: many + texts.get(label, []) for label, many in TEMPLATES.items()}, PHRASES)


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """License phrases and template spans of every whole text; one row per input row, without a shuffle.

    A NULL or empty text has no words, no labels and score 0.  Repeated rows give repeated results.
    """

    def each(ids: list, texts: list) -> dict[str, list]:
        scanner = _default_scanner()
        found = [scanner.scan(t) for t in texts]
        return {"doc_id": ids, **{k: [f[k] for f in found] for k in (found[0] if found else scanner.scan(""))}}

    return map_texts(id_and_text(docs, id_col, text_col), each, SCHEMA)
