"""Operators against brute force, the libraries, and held-out accuracy."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import regex
import xxhash
from tokenizers import Tokenizer

from attestor.llm import ann, bpe_automaton, language, line_dedup, packing, quality, simhash, sketch, suffix_dedup
from attestor.llm import queries as Q
from attestor.llm import components as components_module
from attestor.llm.components import components
from attestor.llm.hilbert import hilbert_keys

from .conftest import AWKWARD, rows_of

SMALL = "/root/testdata/sf0.001"


def small_documents():
    return duckdb.sql(f"select doc_id, text, lang from '{SMALL}/documents.parquet' order by doc_id").fetchall()


def strings(seed, n):
    rng = random.Random(seed)
    pools = ["abc the ing tion ", "ΣσςΟ İıKſÅǅ", "0123¼²Ⅷ३", "é ñ̃ ü​﻿", "\x1c\x85\xa0᠎  \t\n\x0b", "日本語 한국어 हिन्दी", "😀👩‍👧 !?.,'s't", "<|endoftext|>", "aaaaa thth"]
    return ["".join(rng.choice(rng.choice(pools)) for _ in range(rng.randint(0, 40))) for _ in range(n)] + [t for t in AWKWARD if t is not None]


def test_automaton_equals_the_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    machine, library = bpe_automaton.automaton(open(path, encoding="utf-8").read()), Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    for text in strings(1, 3000) + [t for _, t, _ in small_documents()]:
        ids = library.encode(text, add_special_tokens=False).ids
        assert machine.encode(text) == ids
        assert machine.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_byte_encoding_equals_the_library():
    path = public_tokenizers.path("byte_bpe_50k.json")
    encoding, library = packing.byte_encoding(open(path, encoding="utf-8").read()), Tokenizer.from_file(path)
    for text in strings(2, 3000) + [t for _, t, _ in small_documents()]:
        assert encoding.encode(text, allowed_special="all") == library.encode(text, add_special_tokens=False).ids


def test_packing_is_whole_gapless_and_tight(spark):
    got = Q.op7_packing(spark, SMALL).toPandas()
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for doc, text, _ in small_documents():
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        at = 0
        for p in got[got.doc_id == doc].sort_values("start").itertuples():
            assert p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    room = 0
    for _, pieces in got.groupby("sequence_id"):
        ends = 0
        for p in pieces.sort_values("offset").itertuples():
            assert p.offset == ends
            ends += p.length
        assert ends <= 2048
        room += 0 if ends & (ends - 1) == 0 else 2048 - ends
    assert room == 0


def plain_level(counts, size, window):
    """The level by trying all: least sum of squares, then the fuller window."""
    tried = []
    for level in range(window - size + 1):
        if level == 0 or counts[level]:
            after = list(counts)
            if level:
                after[level] -= 1
            if level + size < window:
                after[level + size] += 1
            tried.append((sum(c * c for c in after[1:]), -level))
    return -min(tried)[1]


def test_sum_of_squares_choice():
    rng = random.Random(6)
    packer, counts = packing.LevelPacker(12), [0] * 13
    for k in range(400):
        size = rng.choice([1, 2, 3, 5, 7, 7, 7, 11, 12])
        level = plain_level(counts, size, 12)
        assert packer.level_for(size) == level
        closed = packer.place([(k, 0, np.zeros(size, dtype=np.int32), size)])
        if level:
            counts[level] -= 1
        if level + size < 12:
            counts[level + size] += 1
        assert len(closed) == (level + size == 12) and packer.counts.tolist() == counts
    assert [[len(x[2]) for x in w] for w in packing.cut_rest([(0, 0, np.arange(7), 7), (1, 0, np.arange(6), 6)], 10)] == [[7, 3], [2], [1]]


def test_open_windows_are_bounded():
    """Pieces that never fit each other are cut, and lose nothing."""
    packer, out = packing.LevelPacker(100, most_open=5), []
    for k in range(200):
        out += packer.place([(k, 0, np.full(60, k, dtype=np.int32), 60)])
        assert packer.opened <= 5 and packer.opened == sum(packer.counts) == sum(map(len, packer.open.values()))
    pieces = [p for w in [*out, *packer.rest()] for p in w]
    assert all(sum(len(p[2]) for p in w) == 100 for w in out)
    for k in range(200):
        mine = sorted((p[1], len(p[2])) for p in pieces if p[0] == k)
        assert [a for a, _ in mine] == [0, *np.cumsum([n for _, n in mine])[:-1]] and sum(n for _, n in mine) == 60


def test_leftovers_of_all_partitions_meet(spark, documents):
    """Many small partitions: only the last packer's rest is cut again."""
    rng = random.Random(8)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 900))) for _ in range(600)]
    got = packing.pack_documents(spark.read.parquet(f"{documents(rows_of(texts), files=40)}/documents.parquet").repartition(40), public_tokenizers.path("byte_bpe_50k.json"), window=64).toPandas()
    assert got.groupby("sequence_id")["length"].sum().drop(got[got.recut].sequence_id.unique()).eq(64).all()
    assert got[got.recut]["length"].sum() < 0.1 * got["length"].sum()
    for doc, pieces in got.groupby("doc_id"):
        pieces = pieces.sort_values("start")
        assert pieces.start.tolist() == [0, *np.cumsum(pieces["length"])[:-1]] and pieces["length"].sum() == pieces.doc_tokens.iloc[0]


def shingles(text, k=5):
    w = text.lower().split()
    k = min(k, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def test_sketches(spark):
    docs = sorted(small_documents(), reverse=True)
    got = {r["doc_id"]: r for r in Q.op3_threshold_sketch(spark, SMALL).collect()}
    off = []
    for i, (doc, text, _) in enumerate(docs):
        following = docs[(i + 1) % len(docs)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        r = got[doc]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["fingerprint"] == sketch.fingerprint(sketch.shingle_hashes(text)) and r["edited_fingerprint"] == sketch.fingerprint(sketch.shingle_hashes(edited))
        a, b = shingles(text), shingles(edited)
        if len(a | b) > 200:
            off.append(abs(r["near_edited"] - len(a & b) / len(a | b)))
    assert np.mean(off) < 0.05
    a, b = sketch.shingle_hashes("a b c d e f g h " * 3), sketch.shingle_hashes("x y z u v w")
    assert np.array_equal(sketch.merge(sketch.sketch(a), sketch.sketch(b)), sketch.sketch(np.union1d(a, b)))
    n, _, kept = sketch.parse(sketch.fingerprint(a))
    assert n == len(a) and np.array_equal(kept, sketch.sketch(a))


def test_containment_of_unequal_documents():
    rng = random.Random(3)
    words = [f"w{rng.randrange(10**6)}" for _ in range(40_000)]
    small, large = sketch.sketch(sketch.shingle_hashes(" ".join(words[:2000]))), sketch.sketch(sketch.shingle_hashes(" ".join(words)))
    assert sketch.containment(small, large) == 1.0 and sketch.containment(large, small) == pytest.approx(0.05, abs=0.02)


#: The usual form of the MIT statement: wrapped, with marks and capitals.
MIT = """Copyright (c) 2019 Somebody

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:"""


def test_licenses_equal_sql(spark, documents):
    from attestor.llm import license_scan

    rng = random.Random(12)
    texts = [*AWKWARD, "CC-BY and cc by", "general public license general public license", "released under\nthe mit license", "This is Released, under THE MIT-License", "license mit the under released", "the gnu general public license version 3 work is licensed"]
    texts += [MIT, "w " * 700 + MIT + " w" * 900, MIT.replace("merge, ", "").replace("persons", "people"), " ".join(MIT.split()[:30])]
    texts += ["we have the right to reserve all books; rights are reserved for all", "released books under many covers; the mit press holds no license", "all the rights of mit reserved under license released", "ma\u212ae software \u0130t"]
    for _, statement in license_scan.TEMPLATES:
        w = statement.split()
        texts.append(" ".join(["x", *w, "y"]))
        for _ in range(3):  # foreign words between, words left out: on both sides of the threshold
            now = list(w)
            for _ in range(rng.randint(0, len(w) // 3)):
                i = rng.randrange(len(now))
                now = rng.choice([now[:i] + ["foreign"] + now[i:], now[:i] + now[i + 1 :] or now])
            texts.append("\n".join([" ".join(["pad"] * rng.randint(0, 400)), " ".join(now), "pad " * rng.randint(0, 400)]))
    folder = documents(rows_of(texts))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{folder}/documents.parquet/*.parquet'")
    want = con.execute(license_scan.oracle()).fetchall()
    got = {r["doc_id"]: tuple(r) for r in Q.op1_license_scan(spark, folder).collect()}
    assert sorted(got.values()) == sorted(want)
    found = lambda text: got[texts.index(text)][6:]
    assert found(MIT) == ("mit", 1.0) and found("released under\nthe mit license") == ("mit", 1.0)
    assert found("we have the right to reserve all books; rights are reserved for all") == ("", 0.0)
    for label, statement in license_scan.TEMPLATES:
        assert label in got[texts.index(f"x {statement} y")][6].split(",")


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_lines(texts, least=5, least_chars=20):
    seen, out = [], []
    for text in texts:
        kept = []
        for line in (text or "").split("\n"):
            w = line.split(" ")
            near = lambda other, v: other == line or min(len(w), len(v)) >= least and one_edit(w, v) or min(len(line), len(other)) >= least_chars and one_edit(line, other)  # noqa: B023, E731
            if not line.strip(" \t\r"):
                kept.append(line)
                continue
            if not any(near(*s) for s in seen):
                kept.append(line)
            seen.append((line, w))
        out.append((len((text or "").split("\n")), "\n".join(kept)))
    return out


def test_lines_equal_brute_force(spark, documents):
    rng = random.Random(5)
    base = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 9))) for _ in range(40)]

    def vary(line):
        w = line.split(" ")
        for _ in range(rng.randint(0, 2)):
            i = rng.randrange(len(w) + 1)
            w = rng.choice([w[:i] + ["z"] + w[i:], w[:i] + w[i + 1 :], w[:i] + ["y"] + w[i + 1 :]])
        return " ".join(w)

    joined = ["".join(rng.choice("ab é日😀") for _ in range(rng.randint(17, 26))) for _ in range(12)]

    def by_char(line):
        for _ in range(rng.randint(0, 2)):
            i = rng.randrange(len(line) + 1)
            line = rng.choice([line[:i] + "x" + line[i:], line[:i] + line[i + 1 :], line[:i] + " " + line[i + 1 :]])
        return line

    texts = ["\n".join(rng.choice([vary(rng.choice(base)), by_char(rng.choice(joined)), rng.choice(["", " \t", "ab"])]) for _ in range(rng.randint(0, 6))) for _ in range(90)] + [t if t is None else t[:3000] for t in AWKWARD]
    docs = spark.read.parquet(f"{documents(rows_of(texts))}/documents.parquet")
    got = {r["doc_id"]: (r["n_lines"], r["kept"]) for r in line_dedup.drop_repeated_lines(docs).collect()}
    assert [got[i] for i in range(len(texts))] == brute_lines(texts)


def brute_repeats(texts, window=100):
    seen, out = set(), []
    for text in texts:
        data = (text or "").encode()
        covered = bytearray(len(data))
        for s in range(len(data) - window + 1):
            w = data[s : s + window]
            if w in seen:
                covered[s : s + window] = b"\1" * window
            seen.add(w)
        kept = bytes(x for x, c in zip(data, covered, strict=True) if not c)
        out.append((len(data), sum(covered), len(re.findall(b"\1+", bytes(covered))), hashlib.sha256(kept).hexdigest()))
    return out


def test_components_of_any_size(spark, monkeypatch):
    """One task and joins give the same roots, over chains, stars and loops."""
    rng = random.Random(1)
    pairs = [(i, i + 1) for i in range(60)] + [(100, 101 + i) for i in range(30)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(80)] + [(7, 7), (500, 499), (499, 500)]
    links, found = spark.createDataFrame(pairs, "u long, v long"), []
    for few in (10**6, 0):
        monkeypatch.setattr(components_module, "FEW_LINKS", few)
        found.append(sorted(map(tuple, components(links).collect())))
    empty = components(spark.createDataFrame([], "u long, v long")).collect()
    assert found[0] == found[1] and dict(found[0])[60] == 0 and dict(found[0])[130] == 100 and dict(found[0])[500] == 499 and not empty


@pytest.mark.parametrize("hot", [256, 2])
def test_repeats_equal_brute_force(spark, documents, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT_ANCHOR", hot)
    rng = random.Random(hot)
    word = lambda: "".join(rng.choice("abé\x00") for _ in range(rng.randint(1, 6)))
    passages = [" ".join(word() for _ in range(n)) for n in (10, 25, 40, 60, 120)]
    texts = [" ".join(rng.choice([rng.choice(passages), word(), word(), "ab" * rng.randint(1, 90)]) for _ in range(rng.randint(0, 12))) for _ in range(70)]
    texts += AWKWARD[:14] + ["x" * 99, "x" * 100, "x" * 101, "y" * 250]
    got = {r["doc_id"]: tuple(r)[1:] for r in Q.op8_suffix_array(spark, documents(rows_of(texts))).collect()}
    assert [got[i] for i in range(len(texts))] == brute_repeats(texts)


def test_suffix_array_and_prefixes():
    rng = np.random.default_rng(1)
    for k in range(150):
        text = bytes(rng.choice(list(b"ab\x01"), rng.integers(1, 70)).astype(np.uint8)) * (1 + k % 3) + b"\0"
        data = np.frombuffer(text, dtype=np.uint8)
        found = suffix_dedup.sort_suffixes(data, 300)
        assert found.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
        common = suffix_dedup.common_prefixes(data, found, 10)
        for i in range(1, len(found)):
            a, b = text[found[i - 1] :], text[found[i] :]
            n = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
            assert common[i] == min(10, n) or n < 10 and common[i] >= n  # zeros stand beyond the end


def test_cuts_keep_whole_characters(spark, documents):
    texts = ["é" * 80, "é" * 80, "aé" * 60, "é" * 55]
    docs = spark.read.parquet(f"{documents(rows_of(texts))}/documents.parquet")
    for r in suffix_dedup.find_repeats(docs, whole_characters=True).collect():
        bytes(r["kept"]).decode("utf-8")


def brute_components(fps, radius=4):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps[:i] ^ fps[i]) <= radius):
            a, b = find(i), find(int(j))
            parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def planted(seed=0):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**63, 1500, dtype=np.uint64) * np.uint64(2)
    near = [np.bitwise_xor.reduce(np.uint64(1) << rng.integers(0, 64, rng.integers(1, 5)).astype(np.uint64)) ^ b for b in base[:400] for _ in range(3)]
    group = [base[500] ^ np.bitwise_xor.reduce(np.uint64(1) << rng.integers(0, 64, 3).astype(np.uint64)) for _ in range(700)]
    return np.unique(np.concatenate([base, np.array(near + group, dtype=np.uint64)]))


@pytest.mark.parametrize("few", [10**6, 0])
def test_vantage_point_links(spark, monkeypatch, few):
    monkeypatch.setattr(components_module, "FEW_LINKS", few)
    points = planted()
    nodes = spark.createDataFrame([(int(x),) for x in points.view(np.int64)], "fp long")
    truth = brute_components(points)
    for shard_rows in (10**6, 100):
        links = simhash.near_links(nodes, shard_rows=shard_rows)
        root = {r["node"]: r["root"] for r in components(links).collect()}
        groups = {}
        for i, x in enumerate(points.view(np.int64)):
            groups.setdefault(root.get(int(x), int(x)), set()).add(i)
        want = {}
        for i, r in enumerate(truth):
            want.setdefault(r, set()).add(i)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def plain_simhash(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    parts = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_near_groups_equal_brute_force(spark, documents):
    docs = [(d, t) for d, t, _ in small_documents()]
    docs += [(1000 + i, t) for i, t in enumerate(AWKWARD)] + [(2000 + d, t + " more") for d, t in docs[:40]]
    got = {r["doc_id"]: r for r in Q.op9_simhash_vptree(spark, documents([(d, t, "en", "s", 0) for d, t in docs])).collect()}
    fps = np.array([plain_simhash(t) for _, t in docs], dtype=np.uint64)
    order = np.argsort([d for d, _ in docs])
    ids, roots = np.array([d for d, _ in docs])[order], brute_components(fps[order])
    for i, (d, f) in enumerate(zip(ids.tolist(), fps[order].tolist(), strict=True)):
        assert got[d]["fingerprint"] == f"{f:016x}" and got[d]["component_id"] == ids[roots[i]]


def test_hilbert_curve_is_a_walk():
    for dims, bits in ((2, 5), (3, 3), (6, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        keys = hilbert_keys(cells, bits)
        assert np.array_equal(np.sort(keys), np.arange(len(cells)))
        assert np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1).max() == 1


def test_neighbours_reach_the_recall(spark, documents):
    rng = np.random.default_rng(4)
    for spread in (0.2, 50.0):  # clustered, and without any structure
        centres = rng.normal(size=(60, 24))
        vectors = (centres[rng.integers(0, 60, 6000)] + spread * rng.normal(size=(6000, 24))).astype(np.float32)
        vectors[17::97] = vectors[16]
        rows = [(i, v.tolist(), 0) for i, v in enumerate(vectors)]
        got = {}
        for r in Q.op10_hilbert_ann(spark, documents(rows, "vec_id long, embedding array<float>, label int", "embeddings")).collect():
            got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
        x = vectors.astype(np.float64)
        x /= np.linalg.norm(x, axis=1)[:, None]
        hit = 0
        for q in range(0, 6000, 50):
            near = x @ x[q]
            near[q] = -9
            best = np.lexsort((np.arange(6000), -near))[:5]
            assert list(got[q]) and sorted(got[q]) == [1, 2, 3, 4, 5]
            hit += len({v for v, _ in got[q].values()} & set(best.tolist()))
            assert all(abs(near[v] - s) < 1e-12 for v, s in got[q].values())
        assert hit / 600 >= 0.9


@pytest.mark.parametrize("sizes", [(8, 2, 10**6), (4, 3, 20)])
def test_both_passes_find_all_in_the_windows(spark, monkeypatch, sizes):
    """The lower bound loses nothing: the lists are those of the windows, taken by brute force; also where chunks are split."""
    for name, size in zip(("RANGE_ROWS", "CHUNK_RANGES", "BLOCK_ROWS"), sizes, strict=True):
        monkeypatch.setattr(ann, name, size)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 10))
    curves = ann.Curves(x, 400 // sizes[0])
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    queries = points.where("id % 20 = 0").withColumnRenamed("id", "q")
    at, cosine = curves.ranges(x), (x @ x.T) / np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(x, axis=1))
    for width in (0, 3, 9):
        found = {}
        for r in ann.window_lists(points, queries, curves, width, 4, 400).collect():
            found.setdefault(r["q"], []).append((-r["score"], r["id"]))
        for q in range(0, 400, 20):
            seen = np.flatnonzero((np.abs(at - at[:, q][:, None]) <= width).any(axis=0))
            want = sorted(seen.tolist(), key=lambda i: -cosine[q, i])[:4]
            assert [i for _, i in sorted(found[q])[:4]] == want


def test_best_of_breaks_ties_by_id():
    v = np.array([[1.0, 0], [2.0, 0], [0, 1.0], [1.0, 0]])
    (rows, scores), = ann.best_of(np.array([[3.0, 0]]), np.array([9, 7, 1, 8]), v, 2)
    assert rows.tolist() == [1, 3] and scores.tolist() == [1.0, 1.0]


def test_quality_on_held_out_rows():
    con = duckdb.sql("select d.doc_id, text, quality from '/root/testdata/sf0.01/documents.parquet' d join '/root/testdata/sf0.01/labels.parquet' using (doc_id)").fetchall()
    fold = lambda d: zlib.crc32(str(d).encode()) % 4
    weights = quality.fit((t, y) for d, t, y in con if fold(d) != 2)
    held = [(quality.score_text(weights, t), y) for d, t, y in con if fold(d) == 2]
    assert np.mean([(s >= 0.7) == y for s, y in held]) > 0.95
    assert 0 <= quality.score_text(weights, None) <= 1 and quality.fit([]) is None


def test_language_on_held_out_rows():
    con = duckdb.sql("select doc_id, text, lang from '/root/testdata/sf0.01/documents.parquet'").fetchall()
    fold = lambda d: zlib.crc32(str(d).encode()) % 5
    net = language.fit([(t, lang) for d, t, lang in con if fold(d) and lang and t][:400])
    held = [(t, lang) for d, t, lang in con if not fold(d) and t]
    p = net.document_probabilities([t.encode() for t, _ in held])
    assert np.mean([net.languages[i] == lang for i, (_, lang) in zip(p.argmax(axis=1), held, strict=True)]) > 0.95
    assert np.allclose(p.sum(axis=1), 1, atol=1e-4)
    # the recurrence over each whole text, byte by byte
    texts = [t.encode() for t, _ in sorted(held, key=lambda x: len(x[0]))]
    texts = [b"x", *texts[:20], *texts[-3:]]
    off = np.abs(net.document_probabilities(texts) - np.array([plain_bigru(net, t) for t in texts])).max(axis=1)
    assert max(d for d, t in zip(off, texts, strict=True) if len(t) <= language.LANE) < 1e-4 and off.max() < 0.01  # several lanes: all but what is remembered longer


def latching_network():
    """A network whose units hold what the first and last bytes (A or B) have set: other bytes hardly move them."""
    rng, net = np.random.default_rng(5), language.Network(["a", "b", "c"])
    H = net.ahead.h
    for gru in (net.ahead, net.back):
        gru.p["x"] = rng.normal(0, 0.3, gru.p["x"].shape).astype(np.float32)
        gru.p["u"][:, :H] *= 0.1
        gru.p["x"][:, :H] += 8
        gru.p["x"][[65, 66], :H] -= 16
        gru.p["x"][65, 2 * H :], gru.p["x"][66, 2 * H :] = 2, -2
    return net


@pytest.mark.parametrize("numbers, together", [(1 << 24, 384), (1 << 24, 2), (3 * 700, 3)])
def test_long_texts_are_read_whole(monkeypatch, numbers, together):
    """What stands first and last in a text counts at every position, in any group of texts, and if a text is read in parts."""
    monkeypatch.setattr(language, "NUMBERS", numbers)
    monkeypatch.setattr(language, "TOGETHER", together)
    net, rng = latching_network(), np.random.default_rng(6)
    middle = bytes(rng.integers(97, 123, 6000).tolist())
    texts = [b"", b"A" + middle + b"B", b"x", b"B" + middle + b"A", middle[:699], middle[:700], middle[:701], b"A" + middle[:3000], b"B" + middle[:3000], middle[:1400]]
    p = net.document_probabilities(texts)
    assert p[0].tolist() == [0, 0, 0] and np.abs(p[1:] - np.array([plain_bigru(net, t) for t in texts[1:]])).max() < 1e-4
    assert np.abs(p[7] - p[8]).max() > 0.1


def test_batches_gathered_for_prediction(monkeypatch):
    monkeypatch.setattr(language, "GATHERED", 10)
    batches = [pd.Series(x, dtype=object) for x in (["abc", None], [], ["", "x" * 20], ["a"], ["abcdefghi"], [None])]
    got = list(language._gathered(iter(batches)))
    assert [[list(b) for b in some] for some in got] == [[["abc", None], [], ["", "x" * 20]], [["a"], ["abcdefghi"]], [[None]]]


def plain_bigru(net, text):
    """Mean distribution over a text's positions, one step after another."""

    def states(gru, data):
        h, out, H = np.zeros(gru.h), [], gru.h
        for byte in data:
            a, c = gru.p["x"][byte].astype(np.float64), h @ gru.p["u"].astype(np.float64)
            z, r = (1 / (1 + np.exp(-(a[k * H : (k + 1) * H] + c[k * H : (k + 1) * H]))) for k in (0, 1))
            new = np.tanh(a[2 * H :] + r * c[2 * H :])
            h = (1 - z) * new + z * h
            out.append(h)
        return np.array(out)

    both = np.concatenate([states(net.ahead, text), states(net.back, text[::-1])[::-1]], axis=1)
    logits = both @ net.out["w"] + net.out["b"]
    p = np.exp(logits - logits.max(axis=1, keepdims=True))
    return (p / p.sum(axis=1, keepdims=True)).mean(axis=0)


def test_language_query_columns(spark, documents):
    """held_out, und, labels and scores of the query, computed again without Spark; rows of the fold never teach."""
    rows = [(i, t, lang if i % 7 else None, "s", 0) for i, t, lang in small_documents()[:120]]
    rows += [(1000, None, "en", "s", 0), (1001, "² ½ ① 12", "en", "s", 0), (1002, "", None, "s", 0), (1003, "!?", "fr", "s", 0), (1004, "é", None, "s", 0), (1, rows[1][1], rows[1][2], "s", 0)]
    fold = lambda d: zlib.crc32(str(d).encode()) % 5
    got = Q.op5_byte_bigru(spark, documents(rows)).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(r[0] for r in rows)
    teach = {(d, t, lang) for d, t, lang, _, _ in rows if fold(d) and lang and t and regex.search(r"\p{L}", t)}
    net = language.fit((t, lang) for d, t, lang in sorted(teach, key=lambda r: (zlib.crc32(str(r[0]).encode()), r[1], r[2])))
    for r in got:
        text = next(t for d, t, *_ in rows if d == r["doc_id"])
        assert r["held_out"] == (fold(r["doc_id"]) == 0)
        if r["doc_id"] in (1000, 1001, 1002, 1003):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        else:
            p = net.document_probabilities([text.encode()])[0]
            assert r["lang_pred"] == net.languages[int(p.argmax())] and r["score"] == pytest.approx(p.max(), abs=1e-4)


def test_training_sample_is_the_same_for_any_order(spark):
    """Repeated ids with different texts and equal rows: the same rows teach, however the table lies; every language has its share."""
    rows = [(i % 50, f"text {i % 60} {'abc'[i % 3]}", ["en", "fr"][i % 9 == 0]) for i in range(600)]
    taught = []
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame(order, "doc_id long, text string, lang string").repartition(5)
        seen = []
        monkey = language.fit
        try:
            language.fit = lambda got: seen.extend(got)  # noqa: B023
            language.train(docs, docs.doc_id >= 0, bound=20)
        finally:
            language.fit = monkey
        taught.append(seen)
    assert taught[0] == taught[1] and {lang for _, lang in taught[0]} == {"en", "fr"} and len(taught[0]) == 40


def test_quality_query_columns(spark, documents):
    """held_out, score and predicted of the query, computed again without Spark."""
    rows = [(i, t, lang, "s", 0) for i, t, lang in small_documents()[:150]] + [(900, None, None, None, None), (901, "", None, None, None)]
    labels = [(i, None if i % 11 == 0 else (i * 7 // 3) % 2, 0) for i in range(150)] + [(900, 1, 0)]
    fold = lambda d: zlib.crc32(str(d).encode()) % 4
    folder = documents(rows)
    documents(labels, "doc_id long, quality int, toxic int", "labels")
    got = {r["doc_id"]: r for r in Q.op6_quality_ftrl(spark, folder).collect()}
    texts, y = {r[0]: r[1] for r in rows}, {d: q for d, q, _ in labels if q is not None and fold(d) != 2}
    weights = quality.fit((texts[d], y[d]) for d in sorted(y, key=lambda d: (zlib.crc32(str(d).encode()), texts[d] or "", y[d])))
    assert len(got) == len(rows)
    for d, r in got.items():
        score = quality.score_text(weights, texts[d])
        assert r["held_out"] == (fold(d) == 2) and r["score"] == pytest.approx(score, abs=1e-6) and r["predicted"] == int(r["score"] >= 0.7)


def test_gradients_through_time():
    rng, net = np.random.default_rng(0), language.Network(["a", "b", "c"], hidden=4)
    for params in (net.out, net.ahead.p, net.back.p):
        for k in params:
            params[k] = params[k].astype(np.float64)
    blocks, labels = rng.integers(0, 256, (5, 12)).astype(np.int16), np.array([0, 1, 2, 1, 0])
    blocks[0, 9:] = 256

    def loss():
        return -np.log(net.positions(blocks)[:, np.arange(5), labels])[blocks.T < 256].mean()

    for params, grads in net.gradients(blocks, labels):
        for k in params:
            at = (int(blocks[1, 3]), 2) if k == "x" else tuple(rng.integers(0, n) for n in params[k].shape)
            kept, around = params[k][at], []
            for step in (1e-3, -1e-3):
                params[k][at] = kept + step
                around.append(loss())
            params[k][at] = kept
            assert (around[0] - around[1]) / 2e-3 == pytest.approx(grads[k][at], abs=1e-4)


def test_pipeline_keeps_one_of_each_and_packs_all(spark, documents):
    import corpus_pipeline

    texts = [" ".join(f"w{i}x{k * k}" for k in range(60)) for i in range(30)]
    texts += texts[:10]  # copies
    folder = documents(rows_of(texts))
    documents([], "doc_id long, quality int, toxic int", "labels")
    pieces = corpus_pipeline.run(spark, folder).collect()
    assert {r["doc_id"] for r in pieces} <= set(range(40)) and {r["doc_id"] for r in pieces} >= set(range(30))
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    joined = {}
    for r in sorted(pieces, key=lambda r: r["start"]):
        joined[r["doc_id"]] = joined.get(r["doc_id"], []) + list(r["ids"])
    assert all(library.decode(joined[i][:-1]) == texts[i] for i in range(30))


def test_bound_by_marks_loses_nothing(spark):
    """Pairs that the bound keeps apart are below the similarity; alike pairs pass it; most unlike pairs do not."""
    from attestor.llm import near_documents as near

    rng = np.random.default_rng(6)
    pairs = []
    for size in (1, 4, 30, 150, 900):
        for share in (0.2, 0.6, 0.78, 0.8, 0.82, 0.95, 1.0):
            for _ in range(10):
                a = rng.choice(1 << 40, 2 * size, replace=False).astype(np.uint64)
                b = np.unique(np.concatenate([a[: max(1, round(share * size))], a[size : size + rng.integers(0, 1 + size // 6)]]))
                pairs.append((np.unique(a[:size]), b))
    rows = [(k, len(a), *near.marks(a).tolist(), len(b), *near.marks(b).tolist()) for k, (a, b) in enumerate(pairs)]
    names = ["k long", "n long", *[f"{m} long" for m in near._MARKS], "o_n long", *[f"o_{m} long" for m in near._MARKS]]
    passed = {r["k"] for r in spark.createDataFrame(rows, ", ".join(names)).where(near._may_be_alike(0.8)).collect()}
    like = [near.jaccard(a.tobytes(), b.tobytes()) for a, b in pairs]
    assert all(k in passed for k, j in enumerate(like) if j >= 0.8)
    low = [k for k, j in enumerate(like) if j < 0.5 and len(pairs[k][0]) <= 150]
    assert sum(k in passed for k in low) < 0.05 * len(low)


def test_pipeline_groups_copies_from_08_on(spark, documents):
    """Planted copies at 0.8 to 0.95 of their five-word shingles are one group, texts below are not."""
    import corpus_pipeline

    def shingles(words):
        return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}

    rng = random.Random(17)
    texts, below = [], []
    for i in range(60):
        words = [f"w{rng.randrange(10**6)}" for _ in range(200)]
        texts.append(" ".join(words))
        changed, near, far = list(words), None, None
        for at in rng.sample(range(5, 195), 20):
            changed[at] = f"z{rng.randrange(10**6)}"
            a, b = shingles(words), shingles(changed)
            like = len(a & b) / len(a | b)
            if like >= 0.8 and (near is None or i % 2 == 0):  # the least alike that still belong, or one changed word
                near = list(changed)
            elif like < 0.79 and far is None:
                far = list(changed)
        texts.append(" ".join(near))
        below.append(" ".join(far))
    texts += [texts[0]] * 3
    docs = spark.read.parquet(f"{documents(rows_of(texts))}/documents.parquet")
    assert sorted(r["doc_id"] for r in corpus_pipeline.one_of_each_group(spark, docs, "").collect()) == list(range(0, 120, 2))
    alone = [t for pair in zip(texts[:120:2], below, strict=True) for t in pair]
    docs = spark.read.parquet(f"{documents(rows_of(alone))}/documents.parquet")
    assert corpus_pipeline.one_of_each_group(spark, docs, "").count() == 120


def test_copies_of_lines_of_any_length(spark, documents):
    """Short lines and lines without spaces lose their copies; blank lines stay; the query equals its SQL."""
    import corpus_pipeline

    texts = ["Les.\n\nAnd ornd.\n同じ行です", "Les.\n \n\nAnd ornd\n同じ行です\na\tb\tc", "one two three four five\na\tb\tc\nAnd ornd.", *[t for t in AWKWARD if t is None or len(t) < 1000], "one two three four six\nLes."]
    texts += ["twentycharactersofthis", "twentycharacters ofthis\ntwentycharactersofthat"]
    folder = documents(rows_of(texts))
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {r["doc_id"]: r["text"] for r in corpus_pipeline.without_repeated_lines(spark, docs, folder).collect()}
    assert kept[0] == texts[0] and kept[1] == " \n\nAnd ornd\na\tb\tc" and kept[2] == "one two three four five" and kept[len(texts) - 3] == ""
    assert kept[len(texts) - 2] == texts[-2] and kept[len(texts) - 1] == "twentycharactersofthat"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{folder}/documents.parquet/*.parquet'")
    got = [tuple(r) for r in Q.op4_line_dedup(spark, folder).collect()]
    assert sorted(got) == sorted(con.execute(Q.ORACLES["op4_line_dedup"]).fetchall())


def test_row_numbers_do_not_depend_on_splits(spark, documents):
    """Numbers, and what operators do by them, are the same when a later reading makes other splits."""
    from attestor.llm.common import numbered

    rng = random.Random(2)
    lines = [f"line {i} with a few words of its own" for i in range(60)]
    texts = ["\n".join(rng.sample(lines, 4)) for _ in range(120)]
    docs = spark.read.parquet(f"{documents(rows_of(texts), files=40)}/documents.parquet")
    setting, found = "spark.sql.leafNodeDefaultParallelism", []
    try:
        for leaves in ("2", "16"):
            spark.conf.set(setting, leaves)
            rows = numbered(docs, "number").select("doc_id", "number")
            found.append((rows.rdd.getNumPartitions(), sorted(map(tuple, rows.collect()))))
        assert found[0][0] != found[1][0] and found[0][1] == found[1][1] and len({n for _, n in found[0][1]}) == 120
        for operator in (lambda: line_dedup.drop_repeated_lines(docs), lambda: suffix_dedup.find_repeats(docs, window=64)):
            spark.conf.set(setting, "2")
            planned = operator()  # reads once
            spark.conf.set(setting, "16")
            later = sorted((r["doc_id"], bytes(r["kept"]) if isinstance(r["kept"], bytearray) else r["kept"]) for r in planned.collect())
            spark.conf.set(setting, "2")
            assert later == sorted((r["doc_id"], bytes(r["kept"]) if isinstance(r["kept"], bytearray) else r["kept"]) for r in operator().collect())
    finally:
        spark.conf.unset(setting)
    shuffled = docs.repartition(7).select("doc_id", "text")  # no files: numbered once and written
    assert len({r["n"] for r in numbered(shuffled, "n").collect()}) == 120


def test_copies_are_verified_by_their_bytes(spark, documents, monkeypatch):
    """Weak hashes that take different fragments for equal raise an error instead of cutting text."""
    monkeypatch.setattr(suffix_dedup, "anchors", lambda data, window: (np.zeros(1, dtype=np.uint64), np.zeros(1, dtype=np.uint64), np.zeros(1, dtype=np.int64), np.ones(1, dtype=np.int64), np.zeros(1, dtype=np.int64)))
    found = suffix_dedup._find_anchors(4, 4, 100)
    frame = lambda *texts: __import__("pandas").DataFrame({"rid": range(len(texts)), "doc": range(len(texts)), "text": [t.encode() for t in texts]})
    assert len(list(found(iter([frame("a" * 100, "a" * 100)]))))
    with pytest.raises(suffix_dedup.HashCollisionError):
        list(found(iter([frame("a" * 100, "b" * 100)])))
    run = __import__("pandas").DataFrame([(suffix_dedup._RUN, 0, 5, 0, 2, 0, b"abc")], columns=["kind", "at", "rid", "doc", "start", "key", "bytes"])
    compare = suffix_dedup._compare(4, 100)
    docs = lambda text: __import__("pandas").DataFrame({"rid": [5], "text": [text]})
    assert not len(compare(run, docs(b"xxabcx")))
    with pytest.raises(suffix_dedup.HashCollisionError):
        compare(run, docs(b"xxabdx"))
