"""The numbered operators against plain versions, and their edge cases."""

from __future__ import annotations

import hashlib
import html
import math
import random
import re
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import AddedToken, Tokenizer

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

import corpus_pipeline  # noqa: E402
from featflow.llm import (encode, graph, html_extract, kdtree, mixing, near_dup, packing, pii, quality_model, quality_rules, queries,  # noqa: E402
                          store, substring, token_store)

SF = "/root/testdata/sf0.001"
SCHEMA = ("doc_id long, text string, source string, lang string, n_chars long, size long, key string, row string, place long, "
          "length long, cell int, pos int, failed long, label int, copies int, rank int, bucket int")
WORDS = [f"w{i}" for i in range(400)]


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n))


def edge_rows():
    """Null ids and texts, empty and long texts, repeated rows, ties."""
    long_text = prose(1, 30_000)
    near = prose(2, 120).split()
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one two three"), (5, "ONE two\nthree"), (6, "one two four"), (7, long_text),
            (8, long_text + " tail"), (9, " ".join(near)), (10, " ".join(near[:-1] + ["other"])), (11, prose(3, 80)), (11, prose(3, 80)),
            (None, prose(3, 80)), (None, None), (12, "mail a.b@c.de, card 4111 1111 1111 1111, ip 10.0.0.256 or 10.0.0.255, tel +1 (743) 555-3824."),
            (13, "é " * 60), (14, "word " * 60), (15, prose(4, 60) + " " + prose(5, 40)), (16, prose(5, 40) + " end")]
    return [(i, t, None if i in (3, 4) else f"src{(i or 0) % 3}", "en", len(t or ""), 7, "k", "r", 1, 1, 1, 1, 1, 1, 1, 1, 1) for i, t in rows]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def known(rows):
    """Rows with an id, each once."""
    return list({(r[0], r[1]): None for r in rows if r[0] is not None})


def test_near_duplicates(spark, edge, empty, docs):
    for df in (edge, docs):
        want = brute.near_duplicates(known(df.select("doc_id", "text").collect()))
        got = near_dup.near_duplicates(df).collect()
        assert len(got) == df.count()
        for r in got:
            if r.doc_id is None:
                assert r.component_id is None and r.kept
            else:
                assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (want[r.doc_id][1] == r.doc_id)
    assert near_dup.near_duplicates(empty).count() == 0
    kept = near_dup.drop_near_duplicates(edge)
    assert kept.columns == edge.columns
    assert Counter(r.doc_id for r in kept.collect())[11] == 1


def test_rows_that_share_an_id_are_told_apart(spark):
    """Different texts under one id all stay; a copy goes whatever its id."""
    a, b, c = prose(80, 90), prose(81, 90), prose(82, 90)
    rows = [(1, a), (1, b), (2, c), (0, a + " end"), (3, b), (3, b), (None, a)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("place", F.lit(7))
    kept = near_dup.drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert Counter(map(tuple, kept.collect())) == Counter([(0, a + " end", 7), (1, b, 7), (2, c, 7), (None, a, 7)])


def test_near_duplicate_blocks(spark, docs):
    """Clusters split into small blocks give the same classes."""
    a = near_dup.near_duplicates(docs).collect()
    b = near_dup.near_duplicates(docs, block_docs=2, block_shingles=500).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_chained_near_copies(spark):
    """A chain where only neighbours are similar is one class."""
    base = [f"t{i}" for i in range(200)]
    rows = []
    for k in range(12):
        rows.append((k, " ".join(base)))
        base = base[4:] + [f"x{k}_{j}" for j in range(4)]
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k: 0 for k in range(12)}


def test_sketch_fills_every_bin():
    for n in (1, 2, 7, 500):
        sets = np.sort(np.random.default_rng(n).integers(1, 1 << 60, n).astype(np.uint64))
        sketch = near_dup.similarity_sketch(sets, np.array([0, n]), 64)
        assert (sketch != near_dup._EMPTY).all()
    rng = np.random.default_rng(0)
    pool = rng.integers(1, 1 << 62, 1500).astype(np.uint64)
    a, b = np.sort(pool[:1000]), np.sort(pool[100:1100])
    s = near_dup.similarity_sketch(np.concatenate([a, b]), np.array([0, 1000, 2000]), 4096)
    assert abs((s[0] == s[1]).mean() - 900 / 1100) < 0.03


def test_components(spark):
    rng = random.Random(4)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000, k) for k in range(1001, 1100)] + [(k, k + 1) for k in range(2000, 2060)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    parent = {x: x for p in pairs for x in p if p[0] != p[1]}
    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in pairs:
        if a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    assert got == {x: root(x) for x in parent}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_remove_repeats(spark, edge, empty, docs):
    rows = docs.select("doc_id", "text").collect()
    want = brute.remove_repeats(rows)
    assert {r[0]: tuple(r[1:]) for r in substring.remove_repeats(docs).collect()} == want
    coarse = substring.remove_repeats(docs, max_cells=substring.PIECE, texts=False).collect()      # a full sketch loses nothing
    assert {r[0]: tuple(r[1:]) for r in coarse} == {i: (n, m, hashlib.sha256(t.encode()).hexdigest()) for i, (n, m, t) in want.items()}
    numbered = [((i, r.doc_id), r.text) for i, r in enumerate(edge.collect())]
    want = Counter((i[1], *v) for i, v in brute.remove_repeats(numbered).items())
    assert Counter(map(tuple, substring.remove_repeats(edge).collect())) == want
    assert substring.remove_repeats(empty).count() == 0


def test_periodic_text_repeats_itself(spark):
    rows = [(1, "a " * 36), (2, "b " * 35), (3, " ".join(str(i) for i in range(40)) + " " + " ".join(str(i) for i in range(36)))]
    got = {r[0]: r[2] for r in substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: v[1] for i, v in brute.remove_repeats(rows).items()} and got[1] == 36 and got[2] == 0


def test_mix(spark, edge, empty, docs):
    for df in (edge, docs):
        ledger = mixing.mix_ledger(df).collect()
        sizes = Counter()
        for r in df.collect():
            sizes[r.source] += len(brute.WORD.findall(r.text or ""))
        order = sorted(sizes, key=lambda s: (s is None, s or ""))
        weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
        target, left, free = {}, 1.5 * sum(sizes.values()), set(order)
        while True:
            share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
            over = [s for s in free if share[s] > 2 * sizes[s]]
            if not over:
                break
            for s in over:
                target[s] = 2 * sizes[s]
                left -= target[s]
                free.discard(s)
        target |= share
        for r in ledger:
            assert r.source_size == sizes[r.source] and math.isclose(r.target, target[r.source], abs_tol=1e-6)
            assert r.copies <= 2 and (sizes[r.source] == 0 or abs(r.copies - r.target / r.source_size) < 1)
        taken = Counter((r.doc_id, r.copies) for r in ledger)
        mixed = mixing.mix(df)
        assert mixed.columns == df.columns and mixed.count() == sum(c * n for (_, c), n in taken.items())
        assert sorted(map(str, mixing.mix_ledger(df).collect())) == sorted(map(str, ledger))
    assert mixing.mix(empty).count() == 0 and mixing.mix_ledger(empty).count() == 0


def test_quality_rules(spark, edge, empty):
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality_rules.ledger(edge).collect())
    want = Counter()
    for r in edge.collect():
        t = r.text or ""
        w = brute.WORD.findall(t)
        grams = Counter(tuple(w[k:k + 3]) for k in range(len(w) - 2))
        covered = {k + j for k in range(len(w) - 2) if grams[tuple(w[k:k + 3])] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if brute.WORD.search(x)]
        want[r.doc_id, len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)] += 1
    assert got == want
    assert quality_rules.ledger(empty).count() == 0
    book = quality_rules.ledger(edge).cache()
    for r in quality_rules.ablation(book).collect():
        bit = quality_rules.mask([r.rule])
        failed = [x.failed & r.version_mask for x in book.collect()]
        assert (r.rejected, r.rejected_only, r.kept_without) == (sum(bool(f & bit) for f in failed), failed.count(bit), sum(f in (0, bit) for f in failed))
    book.unpersist()


def test_personal_data(spark, edge, empty):
    rng = random.Random(9)
    bits = list("0123456789") + ["1.2.3.4", "@", "a", "b.c", "+", "+1", " ", "  ", "-", "(", ")", ".", "é", "x@y.z", "255", "256", "_", "4111 1111 1111 1111"]
    rows = [(k, "".join(rng.choice(bits) for _ in range(rng.randint(0, 40)))) for k in range(400)]
    rows += [(500, "1 " * 40_000 + "1.1.1.1"), (501, "a" * 100_000), (502, "a@" + "b." * 50_000), (503, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").union(edge.select("doc_id", "text"))
    text = Counter()
    for r in df.collect():
        found = brute.base_pii(r.text)
        said = ",".join(f"{k}:{a}:{b}" for k in brute.PII for a, b in found[k])
        text[r.doc_id, *(len(found[k]) for k in brute.PII), hashlib.sha256(said.encode()).hexdigest()] += 1
    assert Counter(tuple(r[:6]) for r in pii.find(df).collect()) == text
    assert pii.find(empty).count() == 0
    clean = {r.doc_id: r for r in pii.redact(edge).collect()}
    assert clean[12].text == "mail [EMAIL], card [CARD], ip 10.0.0.256 or [IP], tel [PHONE]." and clean[12].n_chars == len(clean[12].text)
    assert clean[1].text is None and clean[7].text == prose(1, 30_000) and pii.redact(edge).columns == edge.columns


def test_learned_secrets(spark):
    rng = random.Random(1)
    token = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40))
    rows = [(k, f'{prose(k, 20)} token = "{token()}" {prose(k + 1, 9)}') for k in range(60)]
    rows += [(100 + k, f"{prose(k, 20)} ORDER_{rng.randrange(10**9)}_NUMBER {prose(k, 5)}") for k in range(60)] + [(999, f'see "{token()}" there')]
    got = {r.doc_id: r.spans for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all("secret" in got[k] for k in range(60)) and not any(got[100 + k] for k in range(60)) and got[999] == "secret:5:45"


def test_announced_secrets_among_hashes(spark):
    """Announced values go even where most values of their format are unannounced."""
    rng = random.Random(2)
    token = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40))
    rows = [(k, f'token = "{token()}" end') for k in range(30)] + [(100 + k, f'commit "{token()}" end') for k in range(90)]
    rows += [(300, "passport no 12-345-678"), (301, "hotel 12-14 and 2020-01-02")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.find(df).collect()}
    assert all(got[k] == "secret:9:49" for k in range(30)) and got[300] == "number:12:22" and got[301] == ""
    clean = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert clean[0] == 'token = "[SECRET]" end' and clean[300] == "passport no [NUMBER]"


def test_trees_decide(spark, monkeypatch):
    """Unannounced secrets are found and hashes left alone, and without trees nothing is added."""
    rng = random.Random(3)
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    mixed = lambda: "".join(rng.choice("ABCDEFGHabcdefgh0123456789") for _ in range(24))
    rows = [(k, f'{prose(k, 9)} api_key: "{mixed()}Z9z" {prose(k, 4)}') for k in range(120)]              # announced
    rows += [(1000 + k, f'{prose(k, 7)} the value "{mixed()}Z9z" stands here') for k in range(40)]          # the same, unannounced
    rows += [(2000 + k, f"{prose(k, 6)} commit {hexes(40)} {prose(k, 3)}") for k in range(150)]             # named as harmless
    rows += [(3000 + k, f"{prose(k, 6)} see {hexes(40)} {prose(k, 3)}") for k in range(60)]                 # like those
    rows += [(4000 + k, f"password = {hexes(40)}") for k in range(20)]                                      # announced among hashes
    rows += [(5000 + k, f"tel: 20{10 + k % 10}-0{1 + k % 9}-1{k % 10} and version 1.2.{k}") for k in range(40)]     # plain, whatever stands before
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.find(df).collect()}
    found = lambda lo, hi: sum("secret" in s for i, s in got.items() if lo <= i < hi)
    assert found(0, 120) == 120 and found(1000, 1040) >= 38 and found(4000, 4020) == 20
    assert found(2000, 2150) == 0 and found(3000, 3060) == 0 and not any(got[5000 + k] for k in range(40))
    monkeypatch.setattr(pii, "boost", lambda cells: lambda c: 0.0)             # trees that tell nothing
    assert not any(r.spans for r in pii.find(df).collect())


def test_texts_of_many_matches(spark):
    n = 20_000
    rows = [(1, ",".join(f"10.0.{i % 200}.{i % 250}" for i in range(n))), (2, ",".join(f"{i % 97}.{i % 89}" for i in range(n))),
            (3, " ".join(f"a{i}@b.de" for i in range(700)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in pii.find(df).collect()}
    want = brute.base_pii(rows[0][1])["ip"]
    assert got[1].n_ip == n and got[1].base_sha256 == hashlib.sha256(",".join(f"ip:{a}:{b}" for a, b in want).encode()).hexdigest()
    clean = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert clean[1] == ",".join(["[IP]"] * n) and clean[2] == rows[1][1] and clean[3] == " ".join(["[EMAIL]"] * 700)


def test_touching_spans_are_swept(spark):
    """Added spans never touch a base span or one another."""
    rng = random.Random(12)
    bits = ["12-34", "5", "+1 743 555", "abcDEF1234567890x", "_", " ", "-", "a@b.cd", "10.0.0.1", "token = ", "iban ", "é", "4111 1111 1111 1111", "."]
    rows = [(k, "".join(rng.choice(bits) for _ in range(rng.randint(1, 14)))) for k in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    chosen = {c: rng.random() for c in range(pii.CELLS)}
    for r in pii.with_spans(df, "text", chosen).collect():
        spans = r["__pii"]
        base = [tuple(x) for k in pii.BASE for x in spans[k]]
        added = sorted(tuple(x) for k in pii.GENERATORS for x in spans[k])
        assert not any(a < f and e < b for a, b in added for e, f in base)
        assert all(b <= e for (_, b), (e, _) in zip(added, added[1:]))
        assert all(re.fullmatch(r"[0-9]+(?:[ ./-][0-9]+)+|[A-Za-z0-9_-]{16,}", r.text[a:b]) for a, b in added)


def test_calibration_is_monotone():
    steps = pii.calibrated([(0.1, 1, 9), (0.2, 5, 5), (0.3, 3, 7), (0.9, 10, 0)])
    assert [s for s, _ in steps] == sorted(s for s, _ in steps) and [p for _, p in steps] == [0.1, 0.4, 1.0]


def test_elias_fano():
    rng = np.random.default_rng(1)
    for n, top in ((1, 0), (1, 5), (1000, 10**6), (5000, 5000), (3, 1 << 40), (700, 3)):
        v = np.sort(rng.integers(0, top + 1, n))
        e, _ = token_store.EliasFano.from_bytes(token_store.EliasFano.of(v, top).to_bytes())
        assert (e.all() == v).all() and all(e[i] == v[i] for i in range(n))


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_tokenizer(name):
    rng = random.Random(5)
    bits = ["a", "É", "ß", "x1", "  ", " ", "\n", "\t", "'s", "'ll", "́", "\xa0", "Σ", "ΣΑΣ", "<|endoftext|>", "!", "...", "日本", "İ", "\x1c", "ﬁ", "🙂", "_", "9", "é,", "ª", "\x85", "²", "¼", "×", "%%%", "are.\nthnt", "'S", "'re", "''", *map(chr, range(256))]
    direct = Tokenizer.from_file(public_tokenizers.path(name))
    direct.encode_special_tokens = True
    own = encode.Encoder(public_tokenizers.path(name), limit=9_000)
    for t in ["", " ", "the", *("".join(rng.choice(bits) for _ in range(rng.randint(1, 14))) for _ in range(3000)), prose(1, 300)]:
        assert own.ids(t).tolist() == direct.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_matches_added_tokens(name):
    """The encoder of the operators against the unmodified library."""
    rng = random.Random(6)
    bits = ["a", "The", " ", "  ", "\n", "'s", ".", ",", "É", "日本", "İ", "<|endoftext|>", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endof", "|>", "<", "x1"]
    direct = Tokenizer.from_file(public_tokenizers.path(name))
    own = encode.encoder(public_tokenizers.path(name))
    assert direct.token_to_id("<|endoftext|>") in own.ids("the end <|endoftext|> next").tolist()
    for t in ["", " ", "<|endoftext|>", "the end <|endoftext|> next", *("".join(rng.choice(bits) for _ in range(rng.randint(1, 14))) for _ in range(3000))]:
        assert own.ids(t).tolist() == direct.encode(t, add_special_tokens=False).ids


def test_added_tokens_that_strip(tmp_path):
    """Added tokens that take spaces along, or match normalised text, go through the library."""
    direct = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    direct.add_tokens([AddedToken("<sep>", lstrip=True, rstrip=True), AddedToken("Mark", normalized=True, single_word=True)])
    direct.save(str(tmp_path / "t.json"))
    own = encode.Encoder(str(tmp_path / "t.json"), added=True)
    for t in ("a  <sep> b", "a mark, b", "MARK remarks <sep>", "", "a <|endoftext|>b"):
        assert own.ids(t).tolist() == direct.encode(t, add_special_tokens=False).ids


def test_token_files(spark, edge, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    direct = Tokenizer.from_file(path)
    out = store.shared_path(spark, "tokens")
    token_store.write_tokens(edge, out, path, 2, record_ids=500)
    want = Counter((r.doc_id, tuple([*direct.encode(r.text or "", add_special_tokens=False).ids, 2])) for r in edge.collect())
    got = token_store.read_tokens(spark, out).orderBy("start").collect()
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == want
    names = [r.doc_id for r in got]
    assert names == sorted(names, key=lambda x: (x is None, x or 0))
    assert [r.start for r in got] == np.concatenate([[0], np.cumsum([r.n_tokens for r in got])[:-1]]).tolist()
    crc = {(r.doc_id, r.start): r.ids_crc32 for r in token_store.read_tokens(spark, out, crc=True).collect()}
    assert crc == {(r.doc_id, r.start): zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in got}
    out = store.shared_path(spark, "tokens")
    token_store.write_tokens(empty, out, path, 2)
    assert token_store.read_tokens(spark, out).count() == 0


def check_packing(rows, capacity):
    spots = defaultdict(list)
    for r in rows:
        spots[r.sequence_id].append((r.offset, r.length))
    for spot in spots.values():
        at = 0
        for offset, length in sorted(spot):
            assert offset == at
            at += length
        assert at <= capacity
    return len(spots)


def test_best_fit_runs():
    rng = random.Random(1)
    for _ in range(60):
        cap = rng.choice([10, 64, 2048])
        counts = {rng.randint(1, cap): rng.randint(1, rng.choice([3, 1000])) for _ in range(rng.randint(0, 40))}
        places, ranks = defaultdict(dict), defaultdict(set)
        for length, rank, number, first, offset in packing.best_fit_runs(counts, cap):
            for i in range(number):
                assert offset not in places[first + i] and rank + i not in ranks[length]
                places[first + i][offset] = length
                ranks[length].add(rank + i)
        assert {k: set(range(n)) for k, n in counts.items()} == dict(ranks)
        bins = []                                                  # best fit, longest first, one piece at a time
        for length in sorted((k for k, n in counts.items() for _ in range(n)), reverse=True):
            fit = min((b for b in range(len(bins)) if bins[b] >= length), key=lambda b: bins[b], default=None)
            if fit is None:
                bins.append(cap)
                fit = len(bins) - 1
            bins[fit] -= length
        assert len(places) == len(bins)
        assert all(sum(x.values()) <= cap for x in places.values())


def test_pack(spark, edge, empty, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET", 4)
    path = public_tokenizers.path("byte_bpe_50k.json")
    direct = Tokenizer.from_file(path)
    copies = edge.union(edge).union(edge)
    rows = packing.pack(copies, path, 0, with_ids=True)
    got = rows.collect()
    check_packing(got, 2048)
    want = Counter()
    for r in copies.collect():
        ids = [*direct.encode(r.text or "", add_special_tokens=False).ids, 0]
        first = len(ids) % 2048 or 2048 if len(ids) > 2048 else len(ids)
        cuts = [0, *range(first, len(ids) + 1, 2048)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[r.doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert Counter(tuple(r[:5]) for r in got) == want
    joined = {r.sequence_id: r for r in packing.sequences(rows).collect()}
    for r in got:
        s = joined[r.sequence_id]
        assert len(s.ids) == 4 * s.n_tokens and zlib.crc32(s.ids[4 * r.offset:4 * (r.offset + r.length)]) == r.ids_crc32
    assert packing.pack(empty, path, 0).count() == 0


def test_main_text(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    want = {}
    for r in pages.collect():
        inner = re.sub(r"</?(b|i|em|strong|a|span)\b[^>]*>", "", re.search(r"<article>(.*?)</article>", r.html, re.S)[1])
        want[r.page_id] = " ".join(html.unescape(re.sub(r"<[^>]*>", " ", inner)).split())
    got = html_extract.main_text(pages).collect()
    assert {r.page_id: (r.text, r.n_chars) for r in got} == {k: (t, len(t)) for k, t in want.items()}


def test_main_text_edges(spark):
    noisy = """<html><body class="home"><div id="cookie-notice">We use cookies, accept them all please now</div><div class="menu-1"><a href=x>A</a></div>
      <div class="post c12"><h1>Title &amp; more</h1><p>First para, with <a href="q>r">link</a> text and   spaces<br>and br.<p>Second <b>bold</b>est &amp;lt;.
      <ul><li>one<li>two</ul><div class="ad-slot">BUY NOW</div><form><input name=a>Search</form><script>var a = "</p>";</script></div>
      <aside>side stuff</aside><section id="comments"><p>I am a reader and I write a very long comment here, very long indeed, longer than all the rest.</p></section>
      <footer>f</footer></body></html>"""
    odd = '<html><body><div class="teaser">A short page whose longest text stands in the teaser box, as it happens.</div><div class="post c9"><p>Short.</p></div></body></html>'
    rows = [(k, "https://a.example/" + str(k), noisy, "x") for k in range(3)] + [(7, "https://A.example/7", odd, "x"), (8, None, None, "x"), (9, "no url", "", "x"),
            (None, "//", "plain text &eacute;", "x"), (10, "http://b.example", "<b>" * 5000 + "deep" + "<", "x"), (8, None, None, "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, path string")
    got = html_extract.main_text(df).collect()
    said = {r.page_id: r.text for r in got}
    assert len(got) == len(rows)
    assert said[0] == "Title & more First para, with link text and spaces and br. Second boldest &lt;. one two"
    assert said[7] == "Short."                     # the host's consensus, not the page's own best
    assert said[8] == said[9] == "" and said[None] == "plain text é" and said[10].startswith("deep")
    assert html_extract.main_text(df.limit(0)).count() == 0


def probe_text(n, word):
    return f"{word} stands in this sentence of the page. " * n


def test_main_text_of_odd_wrappers():
    body = probe_text(12, "Article")
    whole = " ".join(body.split())
    extract = lambda page: html_extract.extract(page, None)
    assert extract(f'<div id="page" class="no-sidebar"><p>{body}</p></div>') == whole
    assert extract(f'<div class="layout has-sidebar"><article>{body}</article><div class="sidebar"><p>Side words.</p></div></div>') == whole
    assert extract(f'<div class="sidebar-layout"><div class="post">{body}</div></div>') == whole
    assert extract(f'<html><body><form action="x"><div class="post"><p>{body}</p></div><input><button>Go</button></form></body></html>') == whole
    lead = probe_text(4, "Lead")
    page = f'<body><div class="top"><a href="x">A menu entry</a></div><div class="post"><div class="lead">{lead}</div><div class="text">{body}</div></div></body>'
    assert extract(page) == " ".join((lead + body).split())
    assert extract(f'<div class="post"><p>{lead}</p><blockquote>{body}</blockquote></div>') == " ".join((lead + body).split())
    assert extract(f"<table><tr><td>{lead}</td><td>{body}</td></tr></table>") == " ".join((lead + body).split())
    assert extract(f'<div class="post"><div class="entry-header"><h1>Title</h1></div>{body}</div>') == "Title " + whole
    assert extract(f'<div class="comments"><p>{body}</p></div>') == whole                          # nothing else is left
    assert extract(f'<article>{lead}</article><ol class="comment-list"><li><article class="comment">{body}{body}</article></li></ol>') == " ".join(lead.split())
    long = html_extract.extract("<div>" * 100_000 + "deep text" + "</div>" * 100_000, None)
    assert long == "deep text"


def test_main_text_without_articles(spark):
    """The table's pages with their article elements renamed, against an expression; the vote of each host against a count."""
    pages = spark.read.parquet(f"{SF}/pages.parquet").withColumn("html", F.regexp_replace(F.regexp_replace("html", "<article>", '<div class="post-12">'), "</article>", "</div><!--end-->"))
    want, votes = {}, defaultdict(Counter)
    rows = pages.collect()
    for r in rows:
        inner = re.sub(r"</?(b|i|em|strong|a|span)\b[^>]*>", "", re.search(r'<div class="post-12">(.*?)</div><!--end-->', r.html, re.S)[1])
        inner = re.sub(r'<div class="ad">.*?</div>', " ", inner, flags=re.S)
        want[r.page_id] = " ".join(html.unescape(re.sub(r"<[^>]*>", " ", inner)).split())
        votes[re.match(r"https?://([^/:]*)", r.url)[1].lower()][html_extract.voted(r.html)] += 1
    got = {r.page_id: r.text for r in html_extract.main_text(pages).collect()}
    assert sum(got[k] == want[k] for k in want) == len(want)
    winners = {r.host: r.path for r in html_extract.host_paths(pages.withColumn("host", html_extract.host_of(F.col("url"))).select("host", "html")).collect()}
    assert winners == {h: min(c, key=lambda p: (-c[p], p)) for h, c in votes.items()}


def test_quality_model(spark, edge, empty):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = quality_model.score_quality(docs, labels).join(labels, "doc_id").collect()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
    held = [r for r in rows if r.held_out]
    assert sum(r.predicted == r.quality for r in held) / len(held) > 0.95
    good, bad = ([r.score for r in held if r.quality == q] for q in (1, 0))
    assert sum((g > b) + (g == b) / 2 for g in good for b in bad) / (len(good) * len(bad)) > 0.97
    flipped = labels.withColumn("quality", F.when(quality_model.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r.doc_id: r.score for r in quality_model.score_quality(docs, flipped).collect()}       # held-out labels are not seen
    assert all(abs(again[r.doc_id] - r.score) < 1e-9 for r in rows)
    kept = quality_model.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in quality_model.score_quality(docs, labels).where("predicted = 1").collect()}
    found = quality_model.score_quality(edge, labels).collect()
    assert len(found) == edge.count() and all(0 <= r.score <= 1 for r in found)
    assert all(r.score == 0.5 for r in quality_model.score_quality(edge, labels.limit(0)).collect())
    assert quality_model.score_quality(empty, labels).count() == 0


def brute_top(rows, every, k):
    vectors = {}
    for i, v in sorted((r for r in rows if r[0] is not None and r[1] and all(x is not None and math.isfinite(x) for x in r[1])), key=lambda r: (r[0], r[1])):
        vectors.setdefault(i, [math.floor(1024 * x) for x in v])
    out = []
    for q in (i for i in vectors if i % every == 0):
        scores = sorted(((-sum(a * b for a, b in zip(vectors[q], v)), i) for i, v in vectors.items() if i != q))[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores)]
    return sorted(out)


def test_top_k(spark):
    rng = random.Random(2)
    rows = [(i, [rng.choice([-1.0, 0.25, 0.5, rng.random()]) for _ in range(8)]) for i in range(-40, 400)]
    rows += [(500 + i, [0.5] * 8) for i in range(60)] + [(7, rows[47][1]), (600, None), (601, []), (602, [1.0, None]), (603, [float("nan")] * 8),
             (604, [float("inf")] * 8), (None, [9.0] * 8), (605, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("shard", F.lit(3)).withColumn("score", F.lit("x"))
    for options in ({}, {"shard_values": 8 * 64, "leaf": 4, "block": 3}):
        got = sorted(tuple(r) for r in kdtree.top_k(df, every=20, **options).collect())
        assert got == brute_top(rows, 20, 10)
    few = df.where("vec_id between 0 and 4")
    assert len(kdtree.top_k(few).collect()) == 4
    assert kdtree.top_k(df.limit(0)).count() == 0


def test_pipeline(spark, tmp_path):
    """Each stage against a plain version on its own input."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs, _ = store.written(stage(spark, docs, SF), name)
        after = docs.collect()
        if name != "sequences":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if name == "quality_classifier":
            assert 0.6 * len(before) < len(after) < len(before)
        elif name == "near_duplicates":
            want = brute.near_duplicates([(r.doc_id, r.text) for r in before], num=80)
            assert sorted(r.doc_id for r in after) == sorted(i for i, (_, c) in want.items() if c == i)
        elif name == "personal_data":
            assert len(after) == len(before) and not any(x for r in after for x in brute.base_pii(r.text).values())
        elif name == "source_mix":
            assert {r.doc_id for r in after} <= {r.doc_id for r in before} and max(Counter(r.doc_id for r in after).values()) <= 2
        else:
            check_packing(after, 2048)
            assert Counter(r.doc_id for r in after if r.piece == 0) == Counter(r.doc_id for r in before)
    run = corpus_pipeline.run(spark, SF)
    assert sorted(tuple(r)[:5] for r in run.collect()) == sorted(tuple(r)[:5] for r in docs.collect())


def test_pipeline_drops_near_copies_from_80(spark, docs):
    words = [f"t{i}" for i in range(104)]
    far = [(10_000, " ".join(words)), (10_001, " ".join(words[:30] + ["one"] + words[31:60] + ["two"] + words[61:90] + ["three"] + words[91:]))]     # 85 of 115 shingles: 0.74
    near = [(10_002, prose(70, 60)), (10_003, prose(70, 60) + " " + prose(71, 12))]     # 56 of 68 shingles: 0.82
    rows = spark.createDataFrame(far + near, "doc_id long, text string").unionByName(docs.select("doc_id", "text"))
    want = brute.near_duplicates([(r.doc_id, r.text) for r in rows.collect()], num=80)
    kept = sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, rows, SF).collect())
    assert kept == sorted(i for i, (_, c) in want.items() if c == i)
    assert {10_000, 10_001, 10_002} <= set(kept) and 10_003 not in kept


def test_every_operator_is_registered():
    import __spark_entry__ as entry
    names = set(entry.queries())
    assert set(queries.QUERIES) | {"pipeline"} <= names and set(queries.SQL) <= set(entry.oracle_sql())
    assert {int(n[2:].split("_")[0]) for n in queries.QUERIES} == set(range(1, 14))
