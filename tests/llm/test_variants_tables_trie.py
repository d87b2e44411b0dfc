"""Spelling variants, tensored minhash and the prefix trie against brute force."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbweave.llm import prefix_trie, spelling_variants, tensored_minhash
from orbweave.llm.text_kernels import shingle_sets


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def test_automaton_finds_all_words_one_apart():
    g = random.Random(1)
    for _ in range(200):
        words = sorted({bytes(g.choice(b"abc\xe9") for _ in range(g.randint(1, 7))) for _ in range(g.randint(1, 60))})
        trie = spelling_variants.decode_trie(spelling_variants.encode_trie(words, list(range(1, len(words) + 1))))
        for w in [*words, b"aaaa", b"b", bytes(g.choice(b"abc") for _ in range(9))]:
            assert sorted(spelling_variants.neighbours(trie, w)) == [(x, k) for k, x in enumerate(words, 1) if one_apart(w, x)]


def test_a_very_long_word_goes_through_a_trie():
    long = b"ab" * 200_000
    trie = spelling_variants.decode_trie(spelling_variants.encode_trie(sorted([long, long[:-1], long + b"x", b"ab"]), [1, 2, 3, 4]))
    assert {len(w) - len(long) for w, _ in spelling_variants.neighbours(trie, long)} == {-1, 1}


def variants(rows, letters, least, factor, noise):
    n = Counter()
    for doc_id, text in rows:
        for run in spelling_variants._RUN.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if noise and h % noise == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            n[run] += 1
    words = {w: k for w, k in n.items() if k >= least and len(w) >= letters}
    near = {w: [x for x in words if one_apart(w, x)] for w in words}
    form = {}
    for w, xs in near.items():
        best = min(xs, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= factor * words[w] else None
    out = []
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out)


@pytest.mark.parametrize("limit", [None, 3])
def test_spelling_variants_equal_brute_force(spark, monkeypatch, limit):
    if limit:  # many small tries, broadcast one or two at once
        monkeypatch.setattr(spelling_variants, "SHARD_WORDS", limit)
        monkeypatch.setattr(spelling_variants, "BROADCAST_LETTERS", 40)
        monkeypatch.setattr(spelling_variants, "COUNTED", 5)
    g = random.Random(4)
    base = ["Colour", "colours", "color", "été", "ÉtÉs", "naïve", "naive", "aaaa", "aaab", "aabb", "abbb", "bbbb", "x×y÷z"]
    weights = [40, 8, 1, 9, 3, 5, 1, 90, 18, 4, 2, 1, 1]
    rows = [(k % 40, " ".join(g.choices(base, weights, k=12)) + g.choice(["", ".", "\n日本"])) for k in range(60)]
    rows += [(None, "Colour colour"), (7, None), (8, ""), (None, None), (3, "1 2 !"), (9, "colour " * 4000)]
    docs = spark.createDataFrame([(*r, "z", 1) for r in rows], "doc_id long, text string, word string, n long").repartition(4)
    got = spelling_variants.spelling_variants(docs, 4, 2, 2, 7)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = variants(rows, 4, 2, 2, 7)
    assert sorted(tuple(r) for r in got.collect()) == want and any(r[1] and r[2] != r[1] for r in want)
    assert spelling_variants.spelling_variants(docs.where("doc_id = -1")).count() == 0


def exact(rows, words, percent):
    shingles = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        shingles.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set())
    ids = [r[0] for r in rows]
    least = {i: i for i in ids if i is not None}
    pairs = [(ids[i], ids[j]) for i in range(len(rows)) for j in range(i) if ids[i] is not None and ids[j] is not None and 100 * len(shingles[i] & shingles[j]) >= percent * max(1, len(shingles[i] | shingles[j]))]
    for _ in ids:
        for a, b in pairs:
            least[a] = least[b] = min(least[a], least[b])
    order = lambda r: (r[0] is not None, r[0] or 0, *r[1:2])
    return sorted(((i, len(s), None if i is None else least[i], i is None or i == least[i]) for i, s in zip(ids, shingles, strict=True)), key=order)


@pytest.mark.parametrize("small", [False, True])
def test_tensored_tables_find_all_components(spark, monkeypatch, small):
    if small:  # every list is long or split
        monkeypatch.setattr("orbweave.llm.jaccard_join.SHORT_LIST", 3)
        monkeypatch.setattr(tensored_minhash, "SALT_FROM", 4)
        monkeypatch.setattr("orbweave.llm.common.HOT_ROWS", 5)
    g = random.Random(2)
    vocabulary = [f"w{k}" for k in range(300)]
    rows = []
    for family in range(6):
        text = g.choices(vocabulary, k=g.choice([15, 60, 200]))
        for _ in range(g.choice([1, 3, 14])):
            copy = list(text)
            for _ in range(g.randint(0, max(1, len(text) // 25))):
                copy[g.randrange(len(copy))] = g.choice(vocabulary)
            rows.append((len(rows), " ".join(copy).title() if g.random() < 0.5 else "\t".join(copy)))
    rows += [(1000, "a b"), (1001, "A  b"), (1002, "a"), (1003, None), (1004, ""), (1005, " \n"), (None, "a b"), (1006, rows[0][1]), (900, rows[0][1]), (901, rows[-1][1]), (902, rows[-1][1])]
    docs = spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id long, text string, n long, h string").repartition(3)
    got = tensored_minhash.minhash_components(docs)
    order = lambda r: (r[0] is not None, r[0] or 0, *r[1:2])
    assert sorted((tuple(r) for r in got.collect()), key=order) == exact(rows, 3, 85)
    # several texts of one id join what they are like
    again = tensored_minhash.minhash_components(docs.union(spark.createDataFrame([(902, "a b", 1, "z")], docs.schema))).where("doc_id in (1000, 1001, 902)")
    assert {r["component_id"] for r in again.collect()} == {min(r[2] for r in exact(rows, 3, 85) if r[0] == 902)}
    assert tensored_minhash.minhash_components(docs.where("doc_id = -1")).count() == 0


def test_values_agree_as_often_as_sets_are_alike():
    g = np.random.default_rng(5)
    agree = []
    for k in range(200):
        words = [f"{k}.{x}" for x in range(400)]
        a, b = words[:360], words[40:]
        (flat, at), *_ = shingle_sets([" ".join(a).encode(), " ".join(b).encode()], 1)
        assert not _
        v = tensored_minhash.sketch(flat, at)
        agree.append((v[0] == v[1]).mean())
    assert abs(np.mean(agree) - (320 / 400) ** tensored_minhash.EACH) < 0.02 and g is not None


def literal_trie(rows):
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, np.frombuffer(prefix_trie.turn_digest(r or "", x or ""), "<i8").tolist(), (r or "", x or "")))
    own = {c: [x[3] for x in sorted(v)] for c, v in own.items()}
    made = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        made[c] = own.get(c - int(np.fmod(c, 100)), [])[:h] + own[c][h:]
    members, kids = defaultdict(list), defaultdict(list)
    for c, v in made.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    for k in members:
        if k:
            kids[k[:-1]].append(k)
    sums, out = {}, []
    for k, m in sorted(members.items(), key=lambda x: -len(x[0])):
        leaves, saved = int(not kids[k]), (len(m) - 1) * (len(k[-1][1]) if k else 0)
        sums[k] = leaves + sum(sums[x][0] for x in kids[k]), saved + sum(sums[x][1] for x in kids[k])
        ends = ",".join(map(str, sorted(c for c in m if len(made[c]) == len(k))))
        out.append((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(kids[k]), *sums[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: r[:2])


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


@pytest.mark.parametrize("small", [False, True])
def test_prefix_trie_equals_literal_prefixes(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr("orbweave.llm.common.HOT_ROWS", 3)
        monkeypatch.setattr(prefix_trie, "CHUNK", 4)
    g = random.Random(3)
    few = [0, 1, 2, 7, 100, 101, 150, 205, -3, -105, None, 999, *range(20, 40)]
    rows = [(g.choice(few), g.choice([None, 0, 1, 2, 3, 3]), g.choice([None, "user", "a"]), g.choice([None, "x", "yy", "é𝄞"])) for _ in range(240)]
    rows += [(c, t, "u", g.choice("pq")) for c in range(300, 330) for t in range(g.randint(0, 30))]
    rows += [(500 + c, t, "u", "same") for c in range(40) for t in range(3)] + [(777, t, "u", g.choice("pq")) for t in range(900)]
    table = spark.createDataFrame([(*r, 1, "z") for r in rows], "conv_id long, turn long, role string, text string, depth long, owner string").repartition(5)
    found = prefix_trie.prefix_trie(table)
    assert found.columns == COLUMNS
    assert sorted((tuple(r) for r in found.collect()), key=lambda r: r[:2]) == literal_trie(rows)


def test_prefix_trie_of_nothing_and_of_one_row(spark):
    table = spark.createDataFrame([(None, 0, "a", "b"), (4, None, None, None)], "conv_id long, turn long, role string, text string")
    assert prefix_trie.prefix_trie(table.where("conv_id = 5")).count() == 0
    assert prefix_trie.prefix_trie(table.where("conv_id is null")).columns == COLUMNS
    assert sorted(tuple(r) for r in prefix_trie.prefix_trie(table).select(*COLUMNS).collect()) == literal_trie([(4, None, None, None)])


def test_running_sums_go_on_over_ranges(spark):
    rows = spark.range(3000).select((F.col("id") % 3).alias("g"), F.col("id").alias("x"), (F.col("id") * 7919).alias("v")).withColumn("g", F.when(F.col("x") < 2500, 1).otherwise(F.col("g"))).repartition(6)
    found = prefix_trie.running(rows, "g", [F.col("x").desc()], ["x"], ["v"], (prefix_trie.BASES[0],), ["x"]).collect()
    by = defaultdict(list)
    for r in rows.collect():
        by[r["g"]].append((-r["x"], r["v"]))
    want = set()
    for group, values in by.items():
        total = 0
        for k, (x, v) in enumerate(sorted(values)):
            total = (total + v * pow(prefix_trie.BASES[0], k, 1 << 64)) % (1 << 64)
            want.add((group, k + 1, total, -x))
    assert {(r["g"], r["place"], r["v"] % (1 << 64), r["x"]) for r in found} == want
