import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tallyglass.llm import licenses, packing
from tests.llm import odd

APACHE = "You may use it.\nLicensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance"


def brute_places(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    found = [
        (i, label)
        for phrase, label in licenses.PHRASES.items()
        for i in range(len(words))
        if words[i : i + len(phrase.split())] == phrase.split()
    ]
    return len(words), sorted(found)


@pytest.mark.parametrize("seed", range(40))
def test_automaton_finds_phrases_and_longest_matches(seed):
    rng = np.random.default_rng(seed)
    alphabet = [b"a", b"b", b"c"]
    templates = [[alphabet[i] for i in rng.integers(0, 3, rng.integers(3, 12))] for _ in range(3)]
    automaton = licenses.SuffixAutomaton(templates)
    words = [alphabet[i] for i in rng.integers(0, 3, 60)]

    def stands(piece):
        return any(piece == t[i : i + len(piece)] for t in templates for i in range(len(t)))

    state = length = 0
    for at, word in enumerate(words):
        number = automaton.words.get(word)
        while state and number not in automaton.step[state]:
            state = automaton.link[state]
            length = automaton.length[state] if state else 0
        if number in automaton.step[state]:
            state, length = automaton.step[state][number], length + 1
        longest = max(n for n in range(at + 2) if n == 0 or stands(words[at + 1 - n : at + 1]))
        assert length == longest


def test_scan_equals_brute_force(spark):
    rows = [*odd.texts(), (50, APACHE, "s1"), (51, "cc by nc CC-BY-NC cc by nc", "s1"), (52, "under the mit license version 2 apache license version 2", "s1")]
    found = licenses.license_scan(odd.documents(spark, rows)).collect()
    assert len(found) == len(rows)
    by_key = sorted((str(r[0]), *brute_places(r[1])) for r in rows)
    got = sorted((str(r["doc_id"]), r["n_words"], r) for r in found)
    for (d, n, places), (d2, n2, r) in zip(by_key, [(g[0], g[1], g[2]) for g in sorted(got, key=lambda g: (g[0], g[1]))], strict=True):
        assert (d, n) == (d2, n2)
        starts = [p for p, _ in places]
        assert (r["n_base"], r["first_word"], r["last_word"]) == (len(places), min(starts, default=None), max(starts, default=None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in places}))
        assert set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(","))
        assert 0 <= r["score"] <= 1


def test_chains_cover_a_template_with_a_gap():
    scanner = licenses.Scanner(licenses.TEMPLATES, licenses.PHRASES)
    text = "Permission to use, copy, modify, and/or distribute this XX software for any purpose with or without fee is hereby granted"
    assert scanner.scan(text)["labels"] == "isc"
    assert scanner.scan("permission to use the software for any purpose at all")["labels"] == ""
    assert scanner.scan(APACHE)["labels"] == "apache-2"


def test_scan_of_nothing(spark):
    assert licenses.license_scan(odd.documents(spark, [])).collect() == []


def test_encoder_equals_tokenizer():
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer, encoder = Tokenizer.from_file(path), packing.Encoder(path)
    rng = np.random.default_rng(3)
    signs = list("abzABZ019 \n\t\r'.,;-_$%éÉßñªº²½×÷¡¿ĀɏĦ") + ["'ll", "'s", " 's", "  ", " ", " ", "\x1c", "漢", "😀", "<|endoftext|>", "ɐ", "\u0085"]
    texts = ["", *("".join(rng.choice(signs, n)) for n in rng.integers(1, 80, 600))]
    for text, ids in zip(texts, encoder.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_pack_round_trip(spark):
    docs = odd.documents(spark)
    pieces = packing.concatenate_and_cut(docs, window=64, with_ids=True).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    wanted = sorted(
        np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes() for _, t, _ in odd.texts()
    )
    # the stream is one run without holes; documents lie in it end to end
    stream = sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"]))
    place = 0
    for p in stream:
        assert p["sequence_id"] * 64 + p["offset"] == place
        assert len(p["ids"]) == 4 * p["length"] and zlib.crc32(p["ids"]) == p["ids_crc32"]
        assert p["offset"] + p["length"] <= 64
        place += p["length"]
    found, current = [], b""
    for p in stream:
        assert p["start"] == len(current) // 4
        current += p["ids"]
        if len(current) == 4 * p["doc_tokens"]:
            found.append(current)
            current = b""
    assert sorted(found) == wanted


def test_pack_nothing(spark):
    assert packing.concatenate_and_cut(odd.documents(spark, [])).collect() == []
