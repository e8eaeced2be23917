"""Dealt operators against brute force, round trips and the agreed results of odd inputs."""

from __future__ import annotations

import base64
import hashlib
import random
import re
import zlib
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sessionscope.llm import (
    decontam,
    langid,
    licenses,
    linededup,
    neardup,
    packing,
    permindex,
    tokens,
    tokenstore,
    toxicity,
    warc,
)
from sessionscope.llm.common import Scratch
from sessionscope.llm.hilbert import hilbert_keys
from sessionscope.llm.shingles import mix, shingle_set
from sessionscope.llm.tokens import WordEncoder

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, lang string, score double, langid string, toxicity string, band long, row long"


def docs_frame(spark, rows):
    """Documents with further columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "en", 0.5, "x", "y", 1, 2) for i, t in rows], DOCS)


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


@pytest.fixture(scope="module")
def plain():
    tokenizer = Tokenizer.from_file(TOKENIZER)
    tokenizer.encode_special_tokens = True
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


WORDS = [f"w{chr(97 + i % 26)}{i}" for i in range(400)]
RANDOM = random.Random(11)
LONG = " ".join(RANDOM.choice(WORDS) for _ in range(60_000))
ODD = [(5, None), (None, "no id here"), (7, ""), (7, "twice the same id"), (8, LONG), (9, "a b"), (9, "a b"), (3, "\n \n")]


# --- tokens -------------------------------------------------------------


def test_words_are_encoded_as_the_whole_text(plain):
    letters = " \n\t  ab'sé1!.,    |x\x1f\x0b😀ſ́\")"
    texts = ["".join(RANDOM.choice(letters) for _ in range(RANDOM.randint(0, 40))) for _ in range(3000)]
    encoder = WordEncoder(TOKENIZER, limit=500)
    found = encoder.encode([*texts, LONG * 5])
    assert found == [np.array(plain(t), dtype="<u4").tobytes() for t in [*texts, LONG * 5]]


def test_chunks_and_signs_are_encoded_as_the_whole_text(plain, monkeypatch):
    monkeypatch.setattr(tokens, "SEGMENT", 50)
    pieces = ["ab", "ab,", "ab.", "Ab...", "é!", "x1", "12,", "it's", "l'", ",,", "c.\nD", "d\n\nE", "ß)", "ǅ;", "漢字,", "😀", "", "\n"]
    rng = random.Random(8)
    texts = [" ".join(rng.choice(pieces) for _ in range(rng.randint(0, 30))) for _ in range(2000)]
    found = WordEncoder(TOKENIZER, limit=8).encode(texts)
    assert found == [np.array(plain(t), dtype="<u4").tobytes() for t in texts]


def test_words_met_again_stay_known(monkeypatch):
    encoder, learned = WordEncoder(TOKENIZER, limit=100), []
    learn = encoder._learn_pieces
    monkeypatch.setattr(encoder, "_learn_pieces", lambda words: (learned.extend(words), learn(words)))
    for turn in range(20):
        encoder.encode([" ".join(["the", "often", "met,", *(f"new{turn}x{i}" for i in range(30)), "often", "met"])])
    assert learned.count("often") == learned.count("met") == 1
    assert len(encoder.known) + len(encoder.older) < 200


def test_store_round_trip(spark, plain):
    docs, store = docs_frame(spark, ODD), Scratch(spark, "test-store").path
    tokenstore.write_store(docs, store, TOKENIZER, end_id=2)
    found = tokenstore.read_documents(spark, store).orderBy("start").collect()
    assert sorted(crc(r.ids) for r in found) == sorted(crc(plain(t) + [2]) for _, t in ODD)
    assert all(r.ids_crc32 == crc(r.ids) and r.n_tokens == len(r.ids) for r in found)
    assert [r.start for r in found] == np.cumsum([0] + [r.n_tokens for r in found])[:-1].tolist()
    ids = [r.doc_id for r in found]
    assert ids == sorted(i for i, _ in ODD if i is not None) + [None]


def test_empty_store(spark):
    store = Scratch(spark, "test-store").path
    tokenstore.write_store(docs_frame(spark, []), store, TOKENIZER, end_id=2)
    assert tokenstore.read_documents(spark, store).count() == 0


def test_hilbert_neighbours_touch():
    cells = np.array([[a, b, c] for a in range(8) for b in range(8) for c in range(8)])
    order = cells[np.argsort(hilbert_keys(cells, 3))]
    assert len(set(hilbert_keys(cells, 3))) == 512
    assert (np.abs(np.diff(order, axis=0)).sum(axis=1) == 1).all()


def test_packing_keeps_every_id_once(spark, plain):
    pieces = packing.pack(docs_frame(spark, ODD), TOKENIZER, end_id=0, length=64).collect()
    sequences = {}
    for p in pieces:
        assert p.ids_crc32 == crc(p.ids) and p.length == len(p.ids)
        sequences.setdefault(p.sequence_id, []).append(p)
    for own in sequences.values():
        own.sort(key=lambda p: p.offset)
        assert [p.offset for p in own] == np.cumsum([0] + [p.length for p in own])[:-1].tolist()
        size = sum(p.length for p in own)
        assert size <= 64 and size & (size - 1) == 0
    texts = {}
    for p in pieces:
        texts.setdefault((p.doc_id, p.doc_tokens), []).append((p.start, list(p.ids)))
    assert sum(p.length for p in pieces) == sum(len(plain(t)) + 1 for _, t in ODD)
    whole = [i for _, part in sorted(texts[8, len(plain(LONG)) + 1]) for i in part]
    assert whole == plain(LONG) + [0]
    assert packing.pack(docs_frame(spark, []), TOKENIZER).count() == 0


# --- language, licenses, toxicity -----------------------------------------


def test_language(spark):
    pools = {"aa": "the of and to in that is was".split(), "bb": "der die und das nicht ein zu von".split()}
    rows = [(i, " ".join(RANDOM.choice(pools[l]) for _ in range(40)), l) for i in range(60) for l in pools]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(labelled)
    assert list(model) == ["aa", "bb"]
    found = {r.doc_id: r.langid_ for r in langid.predict(docs_frame(spark, [*ODD, (100, "DIE UND!! NICHT")]), model).collect()}
    assert found[100].lang_pred == "bb" and found[100].accepted
    for i in (5, 3):
        assert (found[i].lang_pred, found[i].score, found[i].accepted) == ("und", 0.0, False)
    shown = langid.predict(labelled, model).where("langid.lang_pred = lang AND langid.score BETWEEN 0 AND 1")
    assert shown.count() == len(rows)
    assert langid.fit(labelled.limit(0)) == {}
    assert langid.predict(labelled, {}).where("langid.lang_pred = 'und'").count() == len(rows)


def test_licenses(spark):
    text = "intro\nReleased under the MIT License.\nnoise this work is licensed under the GNU General Public License, version 3. more"
    rows = [(1, text), (2, "licensed driver wanted"), (4, "This work is licensed under the GNU General Public License, version 9."), *ODD]
    found = licenses.scan_licenses(docs_frame(spark, rows)).collect()
    confirmed = {(r.doc_id, r.line, r.license) for r in found if r.confirmed}
    assert confirmed == {(1, 1, "MIT"), (1, 2, "GPL-3.0")}
    wrong = [r for r in found if r.doc_id == 4]
    assert wrong[0].license == "GPL-2.0" and wrong[0].differences == ["-2"]
    for name, template in licenses.TEMPLATES.items():
        best = licenses.Scanner(licenses.TEMPLATES, licenses.Settings()).scan(template)
        assert best[0] == name and best[2] == [] and best[3]


PROSE = "der alte weg folgt dem fluss under the bridge and in any form of software people walk home while rain falls on this work of many hands".split()


@pytest.mark.parametrize("around", [0, 10, 30])
def test_notices_inside_prose(around):
    scanner = licenses.Scanner(licenses.TEMPLATES, licenses.Settings())
    for name, template in licenses.TEMPLATES.items():
        before, after = (" ".join(RANDOM.choice(PROSE) for _ in range(around)) for _ in range(2))
        found = scanner.scan(f"{before} {template} {after}")
        assert found is not None and found[0] == name and found[2] == [] and found[3], (name, found)
    grant = licenses.TEMPLATES["MIT-grant"].replace("to deal", "to deal freely")
    assert scanner.scan(" ".join(PROSE) + f" {grant} " + " ".join(PROSE))[::3] == ("MIT-grant", True)
    driver = scanner.scan(" ".join(PROSE) + " licensed driver wanted " + " ".join(PROSE))
    assert driver is None or not driver[3]


WRAPPED = {
    "Apache-2.0-header": """# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of it there.""",
    "MIT-grant": """Permission is hereby granted, free of charge, to any person obtaining
a copy of this software and associated documentation files (the "Software"),
to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or
sell copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:""",
    "BSD-2-Clause OR BSD-3-Clause": """ * Redistribution and use in source and binary forms, with or without
 * modification, are permitted provided that the following conditions are
 * met: redistributions of source code must retain the above notice.""",
    "MPL-2.0": """// This Source Code Form is subject to the terms of the Mozilla Public
// License, v. 2.0.""",
    "CC-BY-4.0": "Licensed under CC\nBY\u00a04.0.",
}


def test_wrapped_notices(spark):
    prose = " ".join(PROSE)
    names = sorted(WRAPPED)
    rows = [(i, f"{prose}\n{prose}\n{WRAPPED[n]}\n{prose}") for i, n in enumerate(names)]
    rows += [(100, "\n".join(WRAPPED[n] for n in names))]
    found = [r for r in licenses.scan_licenses(docs_frame(spark, rows)).collect() if r.confirmed]
    assert sorted((r.doc_id, r.license, r.line) for r in found if r.doc_id < 100) == [(i, n, 2) for i, n in enumerate(names)]
    assert sorted(r.license for r in found if r.doc_id == 100) == names
    every = spark.createDataFrame([(i, t.replace(" ", "\n")) for i, t in enumerate(licenses.TEMPLATES.values())], "doc_id long, text string")
    found = licenses.scan_licenses(every).collect()
    assert sorted((r.doc_id, r.license) for r in found if r.confirmed) == list(enumerate(licenses.TEMPLATES))


def test_toxicity(spark):
    bad = ["grumpf", "zarkon", "blethix"]
    rows = []
    for i in range(400):
        words = [RANDOM.choice(WORDS) for _ in range(30)]
        if i % 4 == 0:
            words[3], words[9] = RANDOM.choice(bad), RANDOM.choice(bad)
        rows.append((i, " ".join(words), int(i % 4 == 0)))
    labelled = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(labelled, toxicity.Settings(trees=3, depth=3))
    assert set(bad) <= set(model.lexicon)
    scored = model.score(docs_frame(spark, [*ODD, (50, "hello grumpf and zarkon you blethix"), (51, "gr" + "umpf z4rk0n")]))
    found = {r.doc_id: r.toxicity_ for r in scored.collect()}
    assert all(0 <= s <= 1 for s in found.values()) and scored.count() == len(ODD) + 2
    assert found[50] >= 0.5 and found[9] < 0.5
    assert toxicity.fit(labelled.where("toxic = 0")).constant == 0.0
    assert toxicity.fit(labelled.limit(0)).score(labelled).count() == 400


# --- line runs and benchmark passages -------------------------------------


def brute_lines(rows, min_words):
    """Removed line numbers by trying every earlier place for every line."""
    docs = []
    for i, text in sorted(rows):
        units = re.split(r"(?<=\n)(?=[ \t\r]*[^ \t\r\n])", text)
        docs.append((i, units, [u.strip() for u in units]))
    flat = [(d, p, line) for d, (_, _, lines) in enumerate(docs) for p, line in enumerate(lines) if line]
    place = {(d, p): line for d, p, line in flat}
    gone = set()
    for a, b in combinations(range(len(flat)), 2):
        (d0, p0, _), (d1, p1, _) = flat[a], flat[b]
        n = 0
        while place.get((d0, p0 + n), 0) == place.get((d1, p1 + n), 1):
            n += 1
        if sum(len(place[d1, p1 + k].split()) for k in range(n)) >= min_words:
            gone |= {(d1, p1 + k) for k in range(n)}
    return {i: "".join(u for p, u in enumerate(units) if (d, p) not in gone) for d, (i, units, _) in enumerate(docs)}


@pytest.mark.parametrize("seed", range(3))
def test_line_runs(spark, seed):
    rng = random.Random(seed)
    pool = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 5))) for _ in range(8)]
    rows = [(i, "".join(rng.choice(pool) + rng.choice(["\n", "\n\n", "\n"]) for _ in range(rng.randint(1, 14)))) for i in range(14)]
    found = {r.doc.doc_id: r.text for r in linededup.dedup_lines(docs_frame(spark, rows), min_words=9).collect()}
    assert found == brute_lines(rows, 9)


def test_line_runs_of_odd_rows(spark):
    found = linededup.dedup_lines(docs_frame(spark, [*ODD, (90, LONG)]), min_words=50).collect()
    texts = {(r.doc.doc_id, r.doc.text): r for r in found}
    assert len(found) == len(ODD) + 1
    assert texts[5, None].text is None and texts[5, None].n_lines == 0
    assert texts[8, LONG].text == LONG and texts[90, LONG].text == "" and texts[90, LONG].n_removed == 1
    assert linededup.dedup_lines(docs_frame(spark, [])).count() == 0


def test_decontamination(spark):
    rng = random.Random(4)
    item = [rng.choice(WORDS) for _ in range(30)]
    changed = [w if i % 7 else "other" for i, w in enumerate(item)]
    filler = [f"filler{i}" for i in range(50)]
    rows = [
        (1, " ".join(filler + item + filler)),
        (2, " ".join(filler + changed + filler).upper()),
        (3, " ".join(filler + item[:16] + filler)),
        (4, " ".join(filler + item[:9] + filler)),
        (6, "so short an item it is"),
    ]
    items = [(10, " ".join(item)), (11, None), (12, ""), (13, "short an item"), (None, "unrelated words all through " * 4)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    odd = [r for r in ODD if r[0] != 3]
    found = decontam.contaminated(docs_frame(spark, [*rows, *odd]), benchmark).collect()
    pairs = {(r.doc_id, r.item_id): r.matches for r in found}
    assert pairs == {(1, 10): 30, (2, 10): 25, (3, 10): 16, (6, 13): 3}
    assert decontam.contaminated(docs_frame(spark, []), benchmark).count() == 0
    assert decontam.contaminated(docs_frame(spark, rows), benchmark.limit(0)).count() == 0


def brute_passages(docs, items, share=0.8, least=13):
    """Most matches of each document and item over all alignments; knows no seeds."""
    found = {}
    for d, text in docs:
        for i, item in items:
            own, words = item.split(), text.split()
            for shift in range(1 - len(own), len(words)):
                at = [j for j in range(max(0, -shift), min(len(own), len(words) - shift)) if own[j] == words[j + shift]]
                stretches = []
                for j in at:
                    if not stretches or j - stretches[-1][-1] > 2:
                        stretches.append([])
                    stretches[-1].append(j)
                good = any(len(s) >= least and len(s) >= share * (s[-1] - s[0] + 1) for s in stretches)
                if len(at) >= share * len(own) or good:
                    found[d, i] = max(found.get((d, i), 0), len(at))
    return found


def substituted(words, places):
    return [f"other{j}" if j in places else w for j, w in enumerate(words)]


def test_seeds_meet_every_accepted_overlap():
    lead = decontam.SPAN - 1
    for n in range(decontam.SPAN, 21):
        windows = [{i + p for p in mask} for mask in decontam.MASKS for i in range(n - max(mask)) if i <= n - lead]
        for places in combinations(range(n), n // 5):
            assert any(w.isdisjoint(places) for w in windows), (n, places)


@pytest.mark.parametrize("sizes", [(10, 11, 12, 15, 16, 20, 40), tuple(range(1, 10))])
def test_decontamination_against_all_alignments(spark, sizes):
    rng = random.Random(8)
    items, docs = [], []
    for n in sizes:
        item = [rng.choice(WORDS) for _ in range(n)]
        items.append((n, " ".join(item)))
        patterns = list(combinations(range(n), n // 5)) if n < 13 else [rng.sample(range(n), n // 5) for _ in range(40)]
        patterns += [rng.sample(range(n), n // 5 + 1) for _ in range(5)] + [(0,), ()]
        for places in patterns:
            around = [[f"filler{rng.randrange(50)}" for _ in range(rng.choice((0, 3)))] for _ in range(2)]
            docs.append((len(docs), " ".join(around[0] + substituted(item, places) + around[1])))
        if n == 40:
            # A stretch of 16 words with three substituted ones, all other words foreign.
            for _ in range(40):
                gone = {*range(12), *range(28, 40), *(12 + j for j in rng.choice([(3, 7, 11), (2, 5, 8), (4, 8, 12), (3, 8, 13)]))}
                docs.append((len(docs), " ".join(substituted(item, gone))))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = decontam.contaminated(docs_frame(spark, docs), benchmark).collect()
    expected = brute_passages(docs, items)
    assert {(r.doc_id, r.item_id): r.matches for r in found} == expected
    # Every pattern within the rule is there.
    assert len(expected) >= (200 if 40 in sizes else 4 + sum(range(5, 10)))


# --- near duplicates ------------------------------------------------------


def brute_components(rows, size, percent):
    sets = {i: set(shingle_set(t or "", size).tolist()) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        return x if root[x] == x else find(root[x])

    for a, b in combinations(sets, 2):
        common = len(sets[a] & sets[b])
        if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: find(i) for i in sets}


@pytest.mark.parametrize("block", [256, 8])
def test_near_duplicates(spark, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    monkeypatch.setattr(neardup, "SMALL", block // 2)
    rng = random.Random(6)
    base = [rng.choice(WORDS) for _ in range(200)]
    rows, i = [], 0
    for n in (0, 0, 3, 6, 9, 12, 15, 18, 21, 24, 30) * 4:
        words = list(base)
        for _ in range(n):
            words[rng.randrange(200)] = f"new{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
        i += 1
    rows += [(i + 1, None), (i + 2, ""), (i + 3, "one"), (i + 4, "One"), (i + 5, "b c"), (i + 6, LONG)]
    found = {r.doc_id: r for r in neardup.near_duplicates(docs_frame(spark, rows), neardup.Limits(2, 80)).collect()}
    expected = brute_components(rows, 2, 80)
    assert {i: r.component_id for i, r in found.items()} == expected
    assert all(r.kept == (expected[i] == i) for i, r in found.items())


def test_longer_keys_come_from_open_buckets_only(spark, monkeypatch):
    monkeypatch.setattr(neardup, "SMALL", 2)
    made, write = {}, Scratch.write

    def counted(scratch, frame, name):
        made[name] = write(scratch, frame, name)
        return made[name]

    rng = random.Random(7)
    base, rows = [rng.choice(WORDS) for _ in range(200)], []
    for i in range(40):
        words = list(base)
        for _ in range(3 if i % 4 else 30):
            words[rng.randrange(200)] = f"new{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    monkeypatch.setattr(Scratch, "write", counted)
    monkeypatch.setattr(Scratch, "drop", lambda *_: None)
    found = neardup.near_duplicates(docs_frame(spark, rows), neardup.Limits(2, 80)).collect()
    assert {r.doc_id: r.component_id for r in found} == brute_components(rows, 2, 80)
    held = {r.row: set(r.bands) | set(r.upper_bands) for r in made["keyed"].collect()}
    opened = {(r.row, r.band) for r in made["unresolved"].where("size > 2").collect()}
    assert held and all((row, band) in opened for row, bands in held.items() for band in bands)
    # A longer key for each pair of bands that lie as far apart as the strides say, and no other.
    apart = set(neardup.ROUNDS[0])
    pairs = sum(((b & 63) - (a & 63)) % neardup.BANDS in apart for bands in held.values() for a in bands for b in bands)
    assert 0 < made["long-0"].count() <= pairs < 144 * len(held)


def test_near_duplicates_of_odd_rows(spark):
    found = neardup.near_duplicates(docs_frame(spark, ODD), neardup.Limits(2, 80)).collect()
    assert len(found) == len(ODD)
    assert {r.component_id for r in found if r.doc_id is None} == {None}
    assert neardup.near_duplicates(docs_frame(spark, [])).count() == 0


def test_register_estimate():
    a = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 9000, dtype=np.uint64) * np.uint64(2))
    for share in (0.5, 0.8, 0.95):
        n = int(len(a) * share)
        left, right = neardup.registers(a, 9), neardup.registers(np.sort(np.random.default_rng(2).permutation(a)[:n]), 9)
        similarity, used = neardup.estimate(left[None], right[None], np.array([len(a)]), np.array([n]))
        assert abs(similarity[0] - share) < 0.12 and used[0] == neardup.REGISTERS


@pytest.mark.parametrize("layout", sorted(neardup.LAYOUTS))
def test_layouts_fill_their_registers(layout):
    shared = np.random.default_rng(layout).integers(0, 1 << 64, 2**layout, dtype=np.uint64)
    values = neardup.registers(shared, layout)
    assert (values != neardup.EMPTY).mean() > 0.8
    ranges = neardup.REGISTERS // neardup.LAYOUTS[layout]
    least = [int(h) * ranges >> 64 for h in (shared if layout == 9 else mix(shared))]
    assert set(np.flatnonzero(values[:ranges] != neardup.EMPTY)) == set(least)
    numbers = neardup.band_keys(values, layout) & 63
    assert list(numbers) == sorted(set(numbers.tolist())) and numbers.max() < neardup.BANDS


def test_neighbouring_layouts_are_compared(spark):
    words = [f"w{i}" for i in range(140)]
    rows = [(i, " ".join(words[: 60 + n])) for i, n in enumerate((0, 2, 4, 5, 6, 8, 66, 68, 70, 74))]
    rows += [(i, " ".join([f"x{j}" for j in range(n)])) for i, n in enumerate((3, 4, 5, 6, 8, 9, 10, 16, 17, 33), 20)]
    found = neardup.near_duplicates(docs_frame(spark, rows), neardup.Limits(2, 80)).collect()
    assert {r.doc_id: r.component_id for r in found} == brute_components(rows, 2, 80)
    with pytest.raises(ValueError):
        neardup.Limits(2, 40)


# --- archives and neighbours -----------------------------------------------


def test_archives(spark):
    rows = [(1, "http://a/\r\n", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "u", None), (4, "u", ""), (None, "u", "<p>é</p>"),
            (6, "u", "x" * 3_000_000), (7, "u", "WARC/1.1\r\n\r\nContent-Length: 5"), (9, "u", "same"), (9, "u", "same")]
    pages = spark.createDataFrame([(*r, "e") for r in rows], "page_id long, url string, html string, head string")
    folder = Scratch(spark, "test-warc").path
    warc.archive_pages(pages, folder)
    found = warc.read_records(spark, folder).collect()
    assert len(found) == len(rows)
    by_id = {}
    for r in found:
        by_id.setdefault(r.page_id, []).append(r)
    for page, _, html in rows:
        data = (html or "").encode()
        for r in by_id[page]:
            assert r.payload_bytes == len(data)
            assert r.payload_digest == base64.b32encode(hashlib.sha1(data).digest()).decode()
    assert {i: by_id[i][0].refers_to for i in by_id} == {1: 2, 2: None, 3: 4, 4: None, None: 2, 6: None, 7: None, 9: None}
    assert {by_id[i][0].record_type for i in (1, 3, None)} == {"revisit"} and by_id[9][1].record_type == "response"
    empty = Scratch(spark, "test-warc").path
    warc.archive_pages(pages.limit(0), empty)
    assert warc.read_records(spark, empty).count() == 0


def test_neighbours(spark):
    rng = np.random.default_rng(3)
    vectors = [(i, rng.standard_normal(6).tolist(), 0) for i in range(300)]
    vectors += [(i, vectors[20][1], 0) for i in range(300, 330)]  # copies of a query
    odd = [(400, None, 0), (420, [], 0), (440, [0.0] * 6, 0), (460, [None] * 6, 0), (480, [float("nan")] * 6, 0),
           (None, [1.0] * 6, 0), (500, [1.0] * 5, 0), (0, vectors[0][1], 0)]
    frame = spark.createDataFrame(vectors + odd, "vec_id long, embedding array<double>, entry int")
    whole = permindex.Settings(share=1.0)
    found = permindex.nearest_neighbours(frame, frame["vec_id"] % 20 == 0, k=5, settings=whole).collect()
    ids, data = np.array([v[0] for v in vectors]), np.array([v[1] for v in vectors])
    expected = set()
    for i in range(len(ids)):
        if ids[i] % 20 == 0:
            scores = data @ data[i]
            order = [j for j in np.lexsort((ids, -scores)) if j != i][:5]
            expected |= {(int(ids[i]), r + 1, int(ids[j])) for r, j in enumerate(order)}
    assert {(r.query_id, r["rank"], r.vec_id) for r in found} == expected
    assert permindex.nearest_neighbours(frame.limit(0), frame["vec_id"] % 20 == 0).count() == 0


def test_recall_of_the_index_itself(spark):
    rng = np.random.default_rng(11)
    data = rng.standard_normal((4000, 32))
    data /= np.linalg.norm(data, axis=1, keepdims=True)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "vec_id long, embedding array<double>")
    # Blocks of 1,000, so that a quarter of each and no more is scored.
    settings = permindex.Settings(block=1000, query_block=64)
    rows = permindex.nearest_neighbours(frame, frame["vec_id"] % 20 == 0, k=20, settings=settings).collect()
    found = {(r.query_id, r.vec_id) for r in rows}
    scores = data @ data[::20].T
    scores[np.arange(0, 4000, 20), np.arange(200)] = -9.0
    true = {(20 * q, int(v)) for q in range(200) for v in np.argsort(-scores[:, q])[:20]}
    assert len(found) == len(true) == 4000
    assert 0.9 <= len(found & true) / len(true) < 1.0
    for r in rows[:200]:
        assert abs(r.score - data[r.query_id] @ data[r.vec_id]) < 1e-12


def test_footrule_of_place_files():
    rng = np.random.default_rng(2)
    near = np.stack([rng.permutation(12)[:5] for _ in range(40)])
    files = permindex.InvertedFiles(near, 12)

    def distance(a, b):
        places = [[list(x).index(p) if p in x else 5 for p in range(12)] for x in (a, b)]
        return sum(abs(x - y) for x, y in zip(*places))

    for query in near[:10]:
        expected = np.array([distance(query, member) for member in near])
        # Twice the sum 5 + 4 + 3 + 2 + 1 is the distance of lists without a shared pivot.
        assert (30 - 2 * files.agreement(query) == expected).all()
        chosen = files.closest(query, 7)
        assert len(chosen) == 7 and sorted(expected[chosen]) == sorted(expected)[:7]


def test_rows_that_share_an_id_with_a_query(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.9, 0.1]), (1, [0.5, 0.5]), (2, [0.0, 1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = permindex.nearest_neighbours(frame, frame["vec_id"] == 0, k=2, settings=permindex.Settings(share=1.0)).collect()
    assert sorted((r["rank"], r.vec_id, r.score) for r in found) == [(1, 0, 0.9), (1, 0, 0.9), (2, 1, 0.5), (2, 1, 0.5)]
