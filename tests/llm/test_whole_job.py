"""Places where an operator once did less than its whole job."""

import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyglass.llm import licenses, mixing, secrets
from tests.llm import odd


def test_packed_windows_hold_the_token_ids(spark, sf_dir):
    docs = odd.documents(spark)
    pieces = corpus_pipeline.pack_windows(spark, docs, sf_dir).collect()
    windows, texts = {}, Counter()
    for p in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])):
        assert len(p["ids"]) == 4 * p["length"] and zlib.crc32(p["ids"]) == p["ids_crc32"]
        windows[p["sequence_id"]] = windows.get(p["sequence_id"], b"") + p["ids"]
    assert all(len(windows[s]) == 4 * 1024 for s in range(max(windows)))
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    stream = np.frombuffer(b"".join(windows[s] for s in sorted(windows)), "<u4")
    for ids in np.split(stream, np.flatnonzero(stream == 0) + 1)[:-1]:
        texts[tokenizer.decode(ids[:-1].tolist(), skip_special_tokens=False)] += 1
    assert texts == Counter(t or "" for _, t, _ in odd.texts())


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("It was released under the title Big Book", ""),
        ("licensed under the terms of sale", ""),
        ("released under the Apache License, Version 2.0", "apache-2"),
        ("released under the GNU General Public License", "gpl"),
        ("licensed under CC BY 4.0", "cc-by"),
        ("licensed under CC BY-SA", "cc-by-sa"),
        ("licensed under CC BY-NC", "cc-by-nc"),
        ("licensed under the terms of the MIT license", "mit"),
        ("This work is licensed under a Creative Commons Zero license", ""),
        ("This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License", ""),
        (
            "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public "
            "License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version",
            "lgpl",
        ),
    ],
)
def test_license_notices(text, labels):
    assert licenses._default_scanner().scan(text)["labels"] == labels


def test_every_paragraph_of_a_license_gets_its_label():
    scanner = licenses._default_scanner()
    texts = licenses.license_texts()
    assert set(texts) == {"mit", "apache-2", "bsd", "gpl", "lgpl", "mpl-2", "isc"}
    for label, many in texts.items():
        for paragraph in many:
            assert label in scanner.scan(paragraph)["labels"].split(","), paragraph
        for other in scanner.scan("\n".join(many))["labels"].split(","):
            assert other == label


def test_mix_is_written_by_shard_and_position(spark):
    # ordered by source, as tables often are
    rows = [(i, odd.prose(i, 2000) + " \n", f"s{i // 60}") for i in range(180)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    mixed = mixing.mix(docs).withColumn("shard", F.spark_partition_id()).collect()
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix_report(docs).collect()}
    words, pieces = Counter(), {}
    for r in mixed:
        words[r["doc_id"]] += len(r["text"].split())
        pieces.setdefault(r["doc_id"], set()).add(r["text"])
    assert {d: words[d] for d in taken} == taken
    texts = {d: t for d, t, _ in rows}
    for d, found in pieces.items():
        assert all(p in texts[d] for p in found)
        if taken[d] == 2000 * (taken[d] // 2000) and taken[d]:
            assert sum(map(len, found)) == len(texts[d])  # whole, white space and all
    # every stretch of the output follows the weights
    share = {s: sum(w for d, w in taken.items() if d // 60 == int(s[1])) / sum(taken.values()) for s in ("s0", "s1", "s2")}
    assert len({r["shard"] for r in mixed}) == 2
    for at in range(0, len(mixed) - 500, 500):
        part = Counter()
        for r in mixed[at : at + 500]:
            part[r["source"]] += len(r["text"].split())
        assert all(abs(part[s] / sum(part.values()) - x) < 0.15 for s, x in share.items())


def test_secret_field_learns_from_rare_and_late_matches(spark, monkeypatch):
    monkeypatch.setattr(secrets, "FIT_SEGMENTS", 40)
    rng = np.random.default_rng(5)
    letters = list("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz23456789")
    key = lambda n: "".join(rng.choice(letters, n))
    rows = [(i, f"{odd.prose(i, 60)} order-2024-{i:04}-{i:06} {odd.prose(i, 40)}", "s") for i in range(300)]
    late = " ".join(f"{odd.prose(k, 30)} order-2023-{k:04}-{k:06}" for k in range(12))
    rows += [(1000 + i, f"{late} {odd.prose(i, 30)} API_KEY: {key(32)} {odd.prose(i, 30)}", "s") for i in range(8)]
    rows += [(2000, f"my credential is {key(36)} so keep it", "s")]
    scanned = secrets.scan_table(odd.documents(spark, rows))
    assert secrets.training_parts(scanned).filter("matched").count() == 8
    found = {r["doc_id"]: r["n_model"] for r in secrets.secret_report(odd.documents(spark, rows)).collect()}
    assert found[2000] == 1
    assert not any(found[i] for i in range(300))


def test_rows_known_by_file_and_place_mix_like_numbered_ones(spark):
    docs = odd.documents(spark).repartition(3)
    read = mixing.stored(docs, "plain")
    mixed, numbered = mixing.mix(read, from_files=True), mixing.mix(docs)
    assert mixed.columns == docs.columns

    def words(df):
        return Counter(w for r in df.collect() for w in odd.words_of(r["text"]))

    given, taken = words(docs), words(mixed)
    assert abs(taken.total() - words(numbered).total()) <= 2 * mixing.BLOCK_WORDS
    assert all(n <= 3 * given[w] for w, n in taken.items())
