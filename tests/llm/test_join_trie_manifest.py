"""Operators 11 to 13 against plain versions, and their edge cases."""

from __future__ import annotations

import hashlib
import random
import sys
import zlib
from collections import defaultdict
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from featflow.llm import bloom, merkle, ngram_join, order, prefix_trie, queries  # noqa: E402

SF = "/root/testdata/sf0.001"
TURNS = "conv_id long, turn long, role string, text string, key string, depth string, a int"
DOCS = "doc_id long, text string, source string, lang string, n_chars long, tree string, place long, digest string, n string, key string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ---- op11 ----------------------------------------------------------------------------------------

def plain_trie(rows):
    turns = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            turns[c].append((t is not None, t or 0, sha(f"{len(role.encode())}:{role}{text}"), (role, text)))
    turns = {c: [x[3] for x in sorted(v)] for c, v in turns.items()}
    built = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        built[c] = tuple(turns.get(base, [])[:h] + turns[c][h:])
    members = defaultdict(list)
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    kids = defaultdict(list)
    for node in members:
        if node:
            kids[node[:-1]].append(node)
    below = {}
    for node in sorted(members, key=len, reverse=True):
        own = (len(members[node]) - 1) * (len(node[-1][1]) if node else 0)
        below[node] = (sum(below[k][0] for k in kids[node]) or 1, own + sum(below[k][1] for k in kids[node]))
    return sorted((min(m), len(node), min(members[node[:-1]]) if node else None, len(m), len(kids[node]), *below[node],
                   sha(",".join(str(c) for c in sorted(m) if len(built[c]) == len(node)))) for node, m in members.items())


def trie_rows():
    rng = random.Random(3)
    rows = []
    for c in [*range(-3, 140), 205, 300, 301, 399]:
        if c == 100:
            continue
        for t in range(rng.choice([0, 1, 2, 3, 5, 9])):
            rows.append((c, rng.choice([t, t, None, 0]), rng.choice(["user", "é", None]), rng.choice(["a", "b", "bb", None, "日本"]) if t < 4 else "z" * t))
    for c in (405, 411, 412, 500, 507):
        rows += [(c, t, "u", "x" * (t % 3)) for t in range(40 if c < 500 else 23)]
    rows += [(None, 1, "u", "t")] * 3 + [(17, 0, "u", "t")] * 3 + [(600, k, "user", "y" * 20_000) for k in range(3)]
    return rows


@pytest.mark.parametrize("options", [{}, {"first": 3, "growth": 2, "chunk": 5}, {"first": 2, "growth": 4, "block": 4}])
def test_prefix_trie(spark, options):
    rows = trie_rows()
    df = spark.createDataFrame([(*r, "k", "d", 1) for r in rows], TURNS)
    got = [tuple(r) for r in prefix_trie.prefix_trie(df, **options).collect()]
    assert sorted(got, key=lambda x: x[:2]) == plain_trie(rows)


def test_prefix_trie_on_the_table(spark):
    table = spark.read.parquet(f"{SF}/conversations.parquet")
    got = [tuple(r) for r in prefix_trie.prefix_trie(table, first=8, growth=4).collect()]
    assert sorted(got, key=lambda x: x[:2]) == plain_trie([(r.conv_id, r.turn, r.role, r.text) for r in table.collect()])
    assert prefix_trie.prefix_trie(table.limit(0)).count() == 0


def test_two_fattest(spark):
    pairs = [(a, b) for a in range(20) for b in range(a + 1, 40)]
    got = spark.createDataFrame(pairs, "a long, b long").selectExpr("a", "b", prefix_trie.two_fattest("a", "b") + " as f").collect()
    for a, b, f in got:
        assert f == max(range(a + 1, b + 1), key=lambda x: x & -x)


def test_subtrie_parts_where_sequences_part():
    rng = random.Random(8)
    for _ in range(200):
        seqs = {tuple([b"s", *rng.choices([b"a", b"b"], k=rng.randint(0, 6))]) for _ in range(rng.randint(1, 8))}
        made = prefix_trie.subtrie([(list(s), list(range(1, len(s) + 1))) for s in seqs], b"p", 10, 0)
        depths = {s[:k] for s in seqs for k in range(1, len(s) + 1)
                  if s[:k] in seqs or len({t[k] for t in seqs if t[:k] == s[:k] and len(t) > k}) > 1}
        assert len(made) == len(depths) and sum(len(keys) for *_, keys, _ in made) == len({s[:k] for s in seqs for k in range(1, len(s) + 1)})
        for parent, a, e, c0, keys, sums in made:
            assert e - a == len(keys) == len(sums) and c0 == a - 10 and sums[-1] == e - 10


# ---- op12 ----------------------------------------------------------------------------------------

def plain_join(rows):
    """Components over documents, an id that stands at several texts being one of them."""
    found = brute.near_duplicates([((i, k), t) for k, (i, t) in enumerate(rows) if i is not None], ngram=4)
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for (i, _), (_, (j, _)) in found.items():
        a, b = root(i), root(j)
        parent[max(a, b)] = min(a, b)
    return sorted(((i, found[i, k][0], root(i)) for k, (i, t) in enumerate(rows) if i is not None))


def join_rows():
    rng = random.Random(5)
    words = [f"w{k}" for k in range(300)]
    prose = lambda n: [rng.choice(words) for _ in range(n)]
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one two"), (5, "ONE two"), (6, "one two three"), (None, "one two"), (None, None)]
    base = prose(120)
    for k in range(60):                                 # a group of near copies, chained
        base = [*base[2:], f"n{k}", f"m{k}"]
        rows.append((100 + k, " ".join(base)))
    passage = prose(30)
    for k in range(40):                                 # one passage in many short texts
        rows.append((200 + k, " ".join([*prose(rng.randint(0, 6)), *passage, *prose(rng.randint(0, 3))])))
    rows += [(300 + k, rows[8][1]) for k in range(20)]  # exact copies
    rows += [(400, " ".join(prose(20_000)))]
    rows += [(401, rows[-1][1] + " tail"), (500, rows[9][1]), (500, rows[-1][1]), (7, "x " * 500), (7, "x " * 500)]
    return rows


@pytest.mark.parametrize("small", [False, True])
def test_ngram_join(spark, monkeypatch, small):
    if small:
        for name in ("LIST", "BLOCK", "LEADS"):
            monkeypatch.setattr(ngram_join, name, 4)
    rows = join_rows()
    df = spark.createDataFrame([(i, t, "s", "en", 1, "t", 1, "d", "n", "k") for i, t in rows], DOCS)
    got = [tuple(r) for r in ngram_join.ngram_join(df).collect()]
    assert sorted(r for r in got if r[0] is not None) == plain_join(rows)
    assert sorted(map(str, (r for r in got if r[0] is None))) == ["(None, 0, None)", "(None, 1, None)"]
    assert ngram_join.ngram_join(df.limit(0)).count() == 0


def test_ngram_join_on_the_table(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    got = sorted(tuple(r) for r in ngram_join.ngram_join(table).collect())
    assert got == plain_join([(r.doc_id, r.text) for r in table.collect()])


def test_bloom_loses_nothing(spark):
    import numpy as np
    table = bloom.bloom(spark.range(0, 60_000, 3).selectExpr("id * 7919 - 5 as k")).value
    keys = lambda lo: (np.arange(lo, 60_000, 3) * 7919 - 5).view(np.uint64)
    assert bloom.holds(table, keys(0)).all() and bloom.holds(table, keys(1)).mean() < 0.02
    assert bloom.holds(bloom.bloom(spark.range(9000).selectExpr("id as k"), max_bits=1 << 10).value, np.arange(9000, dtype=np.uint64)).all()
    assert not bloom.holds(bloom.bloom(spark.range(0).selectExpr("id as k")).value, keys(0)).any()


# ---- op13 ----------------------------------------------------------------------------------------

def plain_manifest(rows):
    def leaf(i, source, lang, n, text):
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, text)))

    def tree(digests):
        """Root, and each leaf's (left, right) siblings."""
        levels, proofs = [digests], [[] for _ in digests]
        while len(levels[-1]) > 1:
            row = levels[-1]
            for k, proof in enumerate(proofs):
                at = k // 3 ** (len(levels) - 1)
                lo = at // 3 * 3
                proof.append(("".join(row[lo:at]), "".join(row[at + 1:lo + 3])))
            levels.append([sha("".join(row[k:k + 3])) for k in range(0, len(row), 3)])
        return levels[-1][0], proofs

    groups = defaultdict(list)
    for i, text, source, lang, n in rows:
        groups[source].append((i is not None, i or 0, leaf(i, source, lang, n, text), i, text, lang, n))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[2] for x in sorted(groups[s], key=lambda x: x[:3])]) for s in names}
    root, tops = tree([trees[s][0] for s in names])
    out = []
    for s, top in zip(names, tops):
        for (_, _, own, i, text, lang, n), proof in zip(sorted(groups[s], key=lambda x: x[:3]), trees[s][1]):
            other = own
            if i is not None and zlib.crc32(str(i).encode()) % 2 == 0 and text is not None:
                other = leaf(i, s, lang, n, text.replace("\n", ""))
            for a, b in [*proof, *top]:
                other = sha(a + other + b)
            out.append((i, own, trees[s][0], root, sha("".join(a + b for a, b in [*proof, *top])), other, other == root))
    return sorted(map(str, out))


@pytest.mark.parametrize("height", [merkle.HEIGHT, 1, 2])
def test_manifest(spark, height):
    rng = random.Random(2)
    rows = [(k, rng.choice([None, "", "a\nb", "é\n\n", "z" * 50]), rng.choice(["hot", "hot", "hot", "b", "Z", "é"]), "en", k % 5) for k in range(150)]
    rows += [(7, "again\n", "hot", None, None)] * 4 + [(None, "x\n", "hot", "en", 1), (None, None, None, None, None), (999, "\n" * 50_000, "solo", "en", 3)]
    df = spark.createDataFrame([(*r, "t", 1, "d", "n", "k") for r in rows], DOCS)
    assert sorted(str(tuple(r)) for r in merkle.manifest(df, height).collect()) == plain_manifest(rows)
    assert merkle.manifest(df.limit(0)).count() == 0
    one = [r for r in rows if r[2] == "solo"]
    assert sorted(str(tuple(r)) for r in merkle.manifest(df.where("source = 'solo'"), height).collect()) == plain_manifest(one)


def test_positions(spark):
    rows = [(k % 3 if k % 7 else None, k * 7919 % 50, k) for k in range(2000)] + [(1, 5, 5)] * 500
    df = spark.createDataFrame(rows, "g long, o long, x long").repartition(7)
    got = [tuple(r) for r in order.positions(df, ["g"], ["o", "x"], "pos", "t").collect()]
    assert len(got) == len(rows)
    for g in (None, 0, 1, 2):
        mine = sorted((pos, o, x) for a, o, x, pos in got if a == g)
        assert [m[0] for m in mine] == list(range(1, len(mine) + 1)) and [m[1:] for m in mine] == sorted(m[1:] for m in mine)


def test_new_operators_are_registered():
    assert {f"op{n}" for n in (11, 12, 13)} <= {q.split("_")[0] for q in queries.QUERIES}
