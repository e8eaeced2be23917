"""Registered queries that SQL cannot express, against code of their own: folds, end ids, columns and whole rows."""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import zlib
from collections import defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sessionscope.llm import queries

ROOT = "/root/testdata"
SMALL = f"{ROOT}/sf0.001"


def remainder(doc_id, parts):
    return zlib.crc32(str(doc_id).encode()) % parts


def checksum(ids):
    return zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet").collect()


@pytest.fixture(scope="module")
def token_ids(documents):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return {r.doc_id: tokenizer.encode(r.text or "", add_special_tokens=False).ids for r in documents}


def test_languages_of_held_out_documents(spark):
    found = queries.op1_language_id(spark, f"{ROOT}/sf0.01").collect()
    known = {r.doc_id: r for r in spark.read.parquet(f"{ROOT}/sf0.01/documents.parquet").collect()}
    assert sorted(r.doc_id for r in found) == sorted(known)
    assert all(r.held_out == (remainder(r.doc_id, 3) == 1) and 0 <= r.score <= 1 for r in found)
    assert {r.lang_pred for r in found} <= {r.lang for r in known.values()} | {"und"}
    judged = [r for r in found if r.held_out and known[r.doc_id].lang and re.search(r"[^\W\d_]", known[r.doc_id].text or "")]
    assert sum(r.lang_pred == known[r.doc_id].lang for r in judged) >= 0.95 * len(judged) > 0


def test_archive_rows(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet").collect()
    newest = {}
    for p in pages:
        newest[p.html or ""] = max(p.page_id, newest.get(p.html or "", p.page_id))
    expected = []
    for p in pages:
        data, last = (p.html or "").encode(), newest[p.html or ""]
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        kind, refers = ("response", None) if p.page_id == last else ("revisit", last)
        expected.append((p.page_id, len(data), digest, kind, refers))
    found = queries.op4_warc(spark, SMALL).collect()
    rows = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found]
    assert sorted(rows) == sorted(expected)


def test_token_store_rows(spark, token_ids):
    expected, start = [], 0
    for doc_id in sorted(token_ids):
        ids = [*token_ids[doc_id], 2]
        expected.append((doc_id, start, len(ids), checksum(ids)))
        start += len(ids)
    found = queries.op6_token_store(spark, SMALL).collect()
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in found) == expected


def test_packed_pieces(spark, token_ids):
    sequences, texts = defaultdict(list), defaultdict(list)
    for p in queries.op7_curve_packing(spark, SMALL).collect():
        ids = [*token_ids[p.doc_id], 0]
        assert p.doc_tokens == len(ids) and p.ids_crc32 == checksum(ids[p.start : p.start + p.length]) and p.length > 0
        sequences[p.sequence_id].append((p.offset, p.length))
        texts[p.doc_id].append((p.start, p.length))
    assert sorted(texts) == sorted(token_ids)
    for doc_id, pieces in [*texts.items(), *((None, s) for s in sequences.values())]:
        at = 0
        for start, length in sorted(pieces):
            assert start == at
            at += length
        assert at <= 1024 if doc_id is None else at == len(token_ids[doc_id]) + 1
    padded = sum(0 if (n := sum(length for _, length in s)) & (n - 1) == 0 else 1024 - n for s in sequences.values())
    assert padded <= 0.01 * sum(len(ids) + 1 for ids in token_ids.values())


def test_near_duplicate_rows(spark, documents):
    sets = {}
    for r in documents:
        lowered = re.sub("[A-Z]", lambda m: m.group().lower(), r.text or "")
        words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
        sets[r.doc_id] = {tuple(words[i : i + 2]) for i in range(max(1, len(words) - 1))} if words else set()
    linked = {i: {i} for i in sets}
    for a in sets:
        for b in sets:
            common = len(sets[a] & sets[b]) if a < b else 0
            if common and 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common) and linked[a] is not linked[b]:
                both = linked[a] | linked[b]
                for i in both:
                    linked[i] = both
    expected = [(i, len(sets[i]), min(linked[i]), i == min(linked[i])) for i in sorted(sets)]
    found = queries.op10_near_duplicates(spark, SMALL).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in found) == expected


def test_toxicity_of_held_out_documents(spark):
    sf_dir = f"{ROOT}/sf0.1"
    found = queries.op9_toxicity(spark, sf_dir).collect()
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    assert len(found) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    for r in found:
        assert r.held_out == (remainder(r.doc_id, 5) == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    held = [(r.score, bool(toxic[r.doc_id])) for r in found if r.held_out and toxic.get(r.doc_id) is not None]
    bad, good = ([s for s, t in held if t is kind] for kind in (True, False))
    wins = sum((b > g) + (b == g) / 2 for b in bad for g in good)
    assert wins >= 0.95 * len(bad) * len(good) > 0
