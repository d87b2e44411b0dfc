"""The training-data operators against brute force and round trips."""

import random
import time
import tracemalloc
import zlib

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")

from pyspark.sql import functions as F  # noqa: E402

from orbweave.llm import common, html_layout, jaccard_join, jpeg_media, language_id, length_histogram, packing, prefix_bpe, quality_rules, sharding, t_occurrence, token_files, word_tokens  # noqa: E402
from orbweave.llm.components import components  # noqa: E402
from orbweave.llm.queries import held_out, tokenizer  # noqa: E402

LONG = "Lorem ipsum dolor's sit amet, 12 été " * 4000
TEXTS = [None, "", "  \n ", "a", "A b c", "Don't we're they'LL <|endoftext|> x", "ναι Σας ’quote’ 日本 é", "same text here", "same text here", LONG, "\x00\x1c odd", "x" * 3000]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 2 else None, 7, "z") for i, t in enumerate(TEXTS)] + [(None, "no id", None, None, None), (3, "a", "en", 7, "z")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n long, ids string").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("doc_id = -1")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer())


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_word_tokens_equal_the_library(library):
    g = random.Random(3)
    letters = [chr(c) for c in [*range(0x260), *range(0x2010, 0x2060), 0x3A3, 0x130, 0x4E00, 0x1F600, 0x301]]
    texts = ["".join(g.choice(letters) for _ in range(g.randint(0, 30))) for _ in range(800)]
    texts += ["".join(g.choice("'srevldmt x1!'é²") for _ in range(g.randint(0, 25))) for _ in range(2000)] + [t or "" for t in TEXTS]
    for tool in (word_tokens.load(tokenizer()), prefix_bpe.load(tokenizer())):
        ids, at = tool.encode(texts)
        for k, t in enumerate(texts):
            assert ids[at[k] : at[k + 1]].tolist() == library.encode(t, add_special_tokens=False).ids, t


def test_long_pieces_take_microseconds_a_byte(library):
    g = random.Random(6)
    tool = prefix_bpe.load(tokenizer())
    texts = ["a" * 200_000, "".join(g.choice("日本語中文字漢") for _ in range(20_000)), "".join(g.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(1_000_000)), " ".join("x" * g.randint(1, 400) for _ in range(300))]
    for text in texts:
        began = time.time()
        ids, _ = tool.encode([text])
        took = time.time() - began
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids
        assert took < 30  # of some seconds; a step a symbol over all pieces took many minutes
    assert len(tool.cache.flat) <= word_tokens.CACHE_IDS + 1_000_000


def test_spanning_cells_cost_no_columns():
    cell = "<td colspan=1000 rowspan={}>x"
    pages = ["<table><tr>" + cell.format(0) * 200 + "<tr>" * 600, "<table>" + ("<tr>" + cell.format(0) * 36) * 1000, "<table><tr>" + cell.format(1000) * 20_000 + "<tr><td>y" * 40_000, "<table><tr>" + "".join(f"<td rowspan={2 + i * 7919 % 998}>x" for i in range(30_000)) + "<tr><td>y" * 20_000]
    for page in pages:
        tracemalloc.start()
        began = time.time()
        out = html_layout.extract(page)
        took, (_, most) = time.time() - began, tracemalloc.get_traced_memory()
        tracemalloc.stop()
        assert out.count("x") == page.count(">x") and out.count("y") == page.count("<td>y")
        assert took < 60 and most < 300 << 20  # traced runs are some times slower


def test_a_stray_end_of_paragraph_parts_words():
    assert html_layout.extract("<div>b</p>c</div>").split() == ["b", "c"]
    assert html_layout.extract("<p>a</p>b</p>c") == "a\n\nb\n\nc"


def test_prefix_bpe_decodes_as_the_library(docs, empty, library):
    want = []
    for r in docs.collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        want.append((r["doc_id"], len(ids), np.array(ids, "<u4").tobytes(), library.decode(ids, skip_special_tokens=False)))
    order = lambda x: (x[0] is not None, x[0] or 0, x[2])
    for rows in (prefix_bpe.decode(prefix_bpe.encode(docs, tokenizer()), tokenizer()), prefix_bpe.round_trip(docs, tokenizer())):
        assert sorted(((r["doc_id"], r["n_tokens"], bytes(r["ids"]), r["decoded"]) for r in rows.collect()), key=order) == sorted(want, key=order)
    assert prefix_bpe.round_trip(empty, tokenizer()).collect() == []


def test_long_texts_in_parts(monkeypatch):
    text = "It's a lóng text, cut at\twhite space. " * 300
    whole = [tool.encode(["x", text, "", text])[0].tolist() for tool in (word_tokens.WordTokens(tokenizer()), prefix_bpe.PrefixBPE(tokenizer()))]
    monkeypatch.setattr(word_tokens, "GROUP_CHARACTERS", 100)
    monkeypatch.setattr(word_tokens, "CACHE_PIECES", 5)
    for tool in (word_tokens.WordTokens(tokenizer()), prefix_bpe.PrefixBPE(tokenizer())):
        ids, at = tool.encode(["x", text, "", text])
        assert [ids.tolist()] * 2 == whole and at[1] - at[0] == 1 and at[2] - at[1] == at[4] - at[3]


def test_batches_are_sliced_by_bytes(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(common, "BATCH_BYTES", 100)
    batch = pa.RecordBatch.from_pydict({"a": ["x" * n for n in (10, 500, 20, 20, 20, 20, 0)], "b": [None, b"y", *[b""] * 5]})
    parts = list(common.slices(batch))
    assert pa.Table.from_batches(parts).to_pylist() == batch.to_pylist() and [p.num_rows for p in parts] == [1, 1, 2, 3]
    assert list(common.slices(batch.slice(0, 0))) == []


def test_join_hot(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 3)
    rows = spark.createDataFrame([(k % 7 if k % 7 < 5 else 0, k) for k in range(60)] + [(None, 99)], "k long, v long")
    table = rows.groupBy("k").agg(F.count("*").alias("n"), F.max("v").alias("m"))
    want = rows.where("v % 2 = 0").join(table.drop("n"), "k")
    for most in (2, 30):
        got = common.join_hot(rows.where("v % 2 = 0"), table, ["k"], "n", 60, most)
        assert got.columns == want.columns and sorted(got.collect()) == sorted(want.collect())


def test_written_tables_go(spark):
    import os

    table = common.written(spark.range(5), "gone")
    folder = os.path.dirname(table.inputFiles()[0].removeprefix("file://"))
    assert os.path.isdir(folder)
    common.discard(table)
    assert not os.path.exists(folder)


def test_packing(docs, empty, library):
    rows = packing.pack_documents(docs, tokenizer(), length=64).collect()
    pieces: dict = {}
    for r in rows:
        ids = np.frombuffer(r["ids"], "<u4")
        assert len(ids) == r["length"] and r["offset"] + r["length"] <= 64
        pieces.setdefault(r["doc_id"], []).append((r["start"], ids.tolist(), r["doc_tokens"]))
    for k, t in enumerate(TEXTS):
        want = library.encode(t or "", add_special_tokens=False).ids + [1]
        parts = sorted(pieces[k])
        if k != 3:
            assert sum((p[1] for p in parts), []) == want and all(p[2] == len(want) for p in parts)
    by: dict = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        end = 0
        for offset, n in sorted(parts):
            assert offset == end
            end += n
    assert sum(sum(n for _, n in v) < 64 for v in by.values()) <= 1
    assert packing.pack_documents(empty, tokenizer()).collect() == []


def test_packing_order(spark):
    """The line's order is the curve's; neighbours share more words than others; ranges hold alike many tokens."""
    g = random.Random(21)
    kinds = [[f"{a}{b}{g.choice('xyz')}" for a in x for b in ("ra", "ti", "mo", "lu", "se")] for x in (["ban", "kor", "mil"], ["stre", "flin", "gow"], ["que", "zhi", "pav"])]
    texts = []
    for k in range(300):
        texts.append(" ".join(g.choice(kinds[k % 3]) for _ in range(g.choice([60, 200, 1500]))))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    rows = packing.line(df, tokenizer(), length=256).orderBy("part", "before").collect()
    order = list(dict.fromkeys(r["doc_id"] for r in rows))
    assert len(order) == 300 and sum(a["doc_id"] != b["doc_id"] for a, b in zip(rows, rows[1:], strict=False)) == 299
    alike = sum(a % 3 == b % 3 for a, b in zip(order, order[1:], strict=False)) / 299
    assert alike > 0.8  # a third by chance
    sizes: dict = {}
    for r in rows:
        sizes[r["part"]] = sizes.get(r["part"], 0) + r["n"]
    assert max(sizes.values()) < 1.5 * sorted(sizes.values())[len(sizes) // 2]
    cells = packing.quantile_cells(np.array([5.0, 0, 5, 10]))
    assert cells.tolist() == [512, 1024, 1536, 3072]


def test_hilbert_neighbours():
    grid = np.array([(a, b, c) for a in range(8) for b in range(8) for c in range(8)])
    key = packing.hilbert(grid, 3)
    assert sorted(key.tolist()) == list(range(512))
    walk = grid[np.argsort(key)]
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_token_files(spark, docs, empty, library, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK_TOKENS", 500)
    rows = token_files.read_token_files(spark, token_files.write_token_files(docs, tokenizer())).collect()
    rows.sort(key=lambda r: r["start"])
    start = 0
    assert [r["doc_id"] for r in rows] == [None, 0, 1, 2, 3, 3, *range(4, len(TEXTS))]
    for r in rows:
        text = "no id" if r["doc_id"] is None else TEXTS[r["doc_id"]] or ""
        want = library.encode(text, add_special_tokens=False).ids + [1]
        assert (r["start"], r["n_tokens"], zlib.crc32(r["ids"])) == (start, len(want), crc(want))
        start += len(want)
    assert token_files.read_token_files(spark, token_files.write_token_files(empty, tokenizer())).collect() == []
    v = np.array([0, 255, 256, 65535, 65536, 1 << 24, (1 << 32) - 1], np.uint32)
    got, taken = token_files.decode_numbers(np.frombuffer(token_files.encode_numbers(v), np.uint8), len(v))
    assert got.tolist() == v.tolist() and taken == len(token_files.encode_numbers(v))
    block = token_files.encode_block(np.array([3]), np.array([1, 2, 70000]))
    with pytest.raises(ValueError):
        token_files.decode_block(block[:-5] + b"\x05" + block[-4:])
    ranks = token_files.encode_ranks(np.array([7, 70000, 1]))
    assert token_files.decode_ranks(ranks).tolist() == [7, 70000, 1]
    with pytest.raises(ValueError):
        token_files.decode_ranks(ranks[:-1] + b"\x00")


def test_token_files_need_the_folder_only(spark, tmp_path, library):
    """Read by a session that has not written them; the least long is an id like others."""
    least = -(2**63)
    df = spark.createDataFrame([(5, "five words of text here"), (least, "least"), (None, "none")], "doc_id long, text string")
    folder = token_files.write_token_files(df, tokenizer(), f"file://{tmp_path}/files")
    rows = token_files.read_token_files(spark.newSession(), folder).orderBy("start").collect()
    assert [r["doc_id"] for r in rows] == [None, least, 5]
    assert [np.frombuffer(r["ids"], "<u4").tolist() for r in rows] == [library.encode(t, add_special_tokens=False).ids + [1] for t in ("none", "least", "five words of text here")]


def test_length_histogram(spark, docs, empty, library):
    lengths = [5, 5, 0, 700, 300, 5, 1]
    sums = length_histogram.with_suffix_sums(length_histogram.histogram(spark.createDataFrame([(v,) for v in lengths], "length long")))
    for r in sums.collect():
        c = r["length"]
        assert r["docs_at_least"] == sum(v >= c for v in lengths) and r["tokens_at_least"] == sum(v for v in lengths if v >= c)
        assert r["truncated_tokens"] == sum(min(v, c) for v in lengths) and r["quantile"] == sum(v <= c for v in lengths) / 7
    for limit in (0, 3, 5, 299, 1000):
        r = length_histogram.truncated_total(sums, limit).first()
        assert (r["docs_cut"], r["tokens_kept"]) == (sum(v > limit for v in lengths), sum(min(v, limit) for v in lengths))
    assert length_histogram.length_at_quantile(sums, 0.5).first()[0] == 5
    found = sorted(r["length"] for r in length_histogram.document_lengths(docs, tokenizer()).collect())
    texts = [r["text"] or "" for r in docs.collect()]
    want = sorted(len(library.encode(t, add_special_tokens=False).ids) for t in texts)
    assert found == want
    rows = length_histogram.with_suffix_sums(length_histogram.histogram(length_histogram.document_lengths(docs, tokenizer()))).collect()
    assert {r["length"]: r["n_docs"] for r in rows} == {n: want.count(n) for n in want}
    assert length_histogram.with_suffix_sums(length_histogram.histogram(length_histogram.document_lengths(empty, tokenizer()))).collect() == []


def test_jpeg(docs):
    g = np.random.default_rng(0)
    payloads = [jpeg_media.padded(b) for b in (b"", b"\x00" * 5 + b"\xff" * 700, g.integers(0, 256, 5000, dtype=np.uint8).tobytes(), bytes(300000))]
    payloads.append(b"a" * 576 * 350)
    for p, images in zip(payloads, jpeg_media.decode_images(jpeg_media.encode_images(payloads)), strict=True):
        assert b"".join(t.tobytes() for _, _, t in images) == p
    rows = {r["doc_id"]: r for r in jpeg_media.decode_media(jpeg_media.encode_media(docs)).collect()}
    for k, t in enumerate(TEXTS):
        data = (t or "").encode()
        assert rows[k]["n_bytes"] == len(data) and rows[k]["payload"] == jpeg_media.padded(data)
    assert rows[7]["media"] == rows[8]["media"]
    with pytest.raises(ValueError):
        jpeg_media.decode_images([b"\xff\xd8\xff\xc2\x00\x0b"])


def test_damaged_jpegs_are_values(spark, empty):
    good = jpeg_media.encode_images([jpeg_media.padded(b"good")])[0]
    bad = [None, b"", good[:-9], good[:60], b"\xff\xd8\xff\xc0\x00\x02", b"\xff\xd8\xff\xda\x00\x02", good.replace(b"\xff\xc4", b"\xff\xfe")]
    bad += [good[:k] + bytes([good[k] ^ 0x5A]) + good[k + 1 :] for k in range(2, len(good) - 2, 29)]
    rows = spark.createDataFrame([(k, 4, m) for k, m in enumerate([good, *bad, good])], "doc_id long, n_bytes long, media binary")
    found = jpeg_media.decode_media(rows).orderBy("doc_id").collect()
    assert len(found) == len(bad) + 2 and found[0]["error"] is None and found[0]["payload"] == found[-1]["payload"] == jpeg_media.padded(b"good")
    assert all(r["error"] and r["payload"] is None and r["feature"] is None for r in found[1:8])
    assert all((r["error"] is None) == (r["payload"] is not None) for r in found)
    assert jpeg_media.decode_media(jpeg_media.encode_media(empty)).collect() == []


def test_jpeg_feature_of_all_images(spark):
    """A text of several images differs in its feature where a later image differs."""
    head, tails = "a" * (2731 * jpeg_media.UNIT - 192), ["abcdefghijkl" * 16, "lkjihgfedcba" * 16]
    rows = spark.createDataFrame([(k, head + t) for k, t in enumerate([*tails, tails[0]])], "doc_id long, text string")
    one, two, three = jpeg_media.decode_media(jpeg_media.encode_media(rows)).orderBy("doc_id").collect()
    assert one["n_images"] == len(one["feature"].split(",")) > 1
    assert one["thumbnail_hash"] == two["thumbnail_hash"] and one["feature"] != two["feature"] and one["feature"] == three["feature"]
    assert one["feature"].startswith(f"{one['width']}x{one['height']}:{one['thumbnail_hash']},")


def test_jpeg_with_ac_coefficients():
    """A hand-made image of two blocks without restart markers: AC codes are skipped."""
    dc, ac = (0, 2, *[0] * 14), (0, 2, 1, *[0] * 13)
    head = b"\xff\xd8" + jpeg_media._segment(0xDB, bytes([0, 16, *[1] * 63])) + jpeg_media._segment(0xC0, bytes([8, 0, 8, 0, 16, 1, 1, 0x11, 0]))
    head += jpeg_media._segment(0xC4, bytes([0, *dc, 0, 3])) + jpeg_media._segment(0xC4, bytes([16, *ac, 0, 0x11, 0xF0])) + jpeg_media._segment(0xDA, bytes([1, 1, 0, 0, 63, 0]))
    # block 1: DC category 3, +5; AC run 1 size 1; end. block 2: DC 0; ZRL; end
    bits = "01" + "101" + "01" + "1" + "00" + "00" + "100" + "00"
    bits += "1" * (-len(bits) % 8)
    body = bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8))
    ((image,),) = jpeg_media.decode_images([head + body + b"\xff\xd9"])
    assert image[2].tolist() == [[138, 138]]


def brute_components(texts, words, percent):
    sets = []
    for t in texts:
        x = (t or "").lower().split()
        sets.append({tuple(x[i : i + words]) for i in range(len(x) - words + 1)} if len(x) >= words else {tuple(x)} if x else set())
    up = list(range(len(texts)))

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    for i, s in enumerate(sets):
        for j in range(i):
            c = len(s & sets[j])
            if c and 100 * c >= percent * (len(s) + len(sets[j]) - c):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in enumerate(sets)}


def test_jaccard_join(spark, monkeypatch):
    g = random.Random(3)
    words = [f"w{i}" for i in range(3000)]
    texts: list = [None, "", " ", "A b", "a  B"]
    for _ in range(2):
        base = [g.choice(words) for _ in range(80)]
        texts.append(" ".join(base))
        for _ in range(25):
            x = list(base)
            for _ in range(g.randint(0, 4)):
                x[g.randrange(80)] = g.choice(words)
            texts.append(" ".join(x))
    texts += [" ".join(g.choice(words[:5]) for _ in range(g.randint(0, 9))) for _ in range(60)]
    # unlike one another beyond the threshold, but on the same lists; some pairs link
    base = [g.choice(words) for _ in range(120)]
    for k in range(40):
        x = list(base)
        for i in range(0, 120, 17):
            x[i] = f"own{k // 2}-{i}"
        texts.append(" ".join(x) + " end" * (k % 2))
    df = spark.createDataFrame(list(enumerate(texts)) + [(None, "A b")], "doc_id long, text string").repartition(4)
    want = brute_components(texts, 4, 85)
    monkeypatch.setattr(jaccard_join, "SHORT_LIST", 6)
    monkeypatch.setattr(jaccard_join, "CELL", 7)
    rows = jaccard_join.jaccard_components(df, 4, 85).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows if r["doc_id"] is not None} == want
    assert [r["component_id"] for r in rows if r["doc_id"] is None] == [None]


def test_jaccard_join_of_few_variants_among_many_copies(spark, monkeypatch):
    """Lists are split by documents, however few different texts the copies are."""
    g = random.Random(11)
    texts = []
    for k in range(6):
        base = " ".join(f"c{k}-{g.randrange(10**6)}" for _ in range(20))
        texts += [base] * 60 + [base + " end", base + " other end"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    monkeypatch.setattr(jaccard_join, "SALT_FROM", 4)
    monkeypatch.setattr(common, "HOT_ROWS", 5)
    rows = jaccard_join.jaccard_components(df, 4, 85).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == brute_components(texts, 4, 85)


def test_jaccard_join_of_documents_with_several_texts(spark):
    """Every text of a document links, on either side of a pair."""
    g = random.Random(12)
    rows, want = [], {}
    for k in range(0, 120, 4):
        two = [" ".join(f"d{k}-{g.randrange(10**6)}" for _ in range(40)) for _ in range(2)]
        # one id with both texts, and one near copy of each; the id is below, between or above theirs
        several, *others = g.sample(range(k, k + 3), 3)
        rows += [(several, t) for t in two] + [(i, t + " end") for i, t in zip(others, two, strict=True)]
        want |= dict.fromkeys(range(k, k + 3), k)
    # both ids have two texts, alike in pairs
    a, b = (" ".join(f"e{k}-{g.randrange(10**6)}" for _ in range(40)) for k in range(2))
    rows += [(500, a), (500, b), (501, b + " end"), (501, "other text"), (502, a + " end"), (502, "text of another kind")]
    want |= dict.fromkeys((500, 501, 502), 500)
    found = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 4, 85).collect()
    assert len(found) == len(rows) and {r["doc_id"]: r["component_id"] for r in found} == want
    assert len({(r["doc_id"], r["component_id"]) for r in found}) == len(want)


def test_jaccard_links_are_all_links(spark, monkeypatch):
    """Also those inside one component, of long lists and split ones."""
    g = random.Random(14)
    base = [f"w{g.randrange(10**6)}" for _ in range(300)]
    texts = [" ".join(base)] * 30
    for _ in range(25):
        x = list(base)
        for _ in range(g.randint(1, 4)):
            x[g.randrange(300)] = f"v{g.randrange(10**6)}"
        texts.append(" ".join(x))
    texts += [None, "short", "Short"]
    sets = [{tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set() for w in ((t or "").lower().split() for t in texts)]
    kinds = {frozenset(s): min(i for i, t in enumerate(sets) if t == s) for s in sets if s}
    want = {(i, j): (len(a & b), len(a | b)) for a, i in kinds.items() for b, j in kinds.items() if i < j and 100 * len(a & b) >= 85 * len(a | b)}
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    monkeypatch.setattr(jaccard_join, "SHORT_LIST", 6)
    monkeypatch.setattr(jaccard_join, "CELL", 7)
    monkeypatch.setattr(jaccard_join, "SALT_FROM", 20)
    rows = jaccard_join.jaccard_links(df).collect()
    assert len(rows) == len(want) > 100 and {(min(r["x"], r["y"]), max(r["x"], r["y"])): (r["overlap"], r["union"]) for r in rows} == want
    counts = {r["doc_id"]: r["n_links"] for r in jaccard_join.jaccard_link_counts(df).collect()}
    assert counts == {i: sum(kinds[frozenset(s)] in p for p in want) if s else 0 for i, s in enumerate(sets)}


def test_parities_bound_the_difference():
    g = np.random.default_rng(5)
    for n in (1, 64, 65, 700, 3000):
        a = g.integers(0, 1 << 63, n, np.uint64)
        b = np.unique(np.r_[a[n // 5 :], g.integers(0, 1 << 63, n // 3, np.uint64)])
        one, two = (np.frombuffer(jaccard_join.parities(x), np.uint64)[None, :] for x in (a, b))
        width = min(one.shape[1], two.shape[1])
        differ = int(np.bitwise_count(jaccard_join._fold(one, width) ^ jaccard_join._fold(two, width)).sum())
        assert differ <= len(np.setxor1d(a, b)) and (differ - len(np.setxor1d(a, b))) % 2 == 0


def test_jaccard_join_of_nothing(empty):
    assert jaccard_join.jaccard_components(empty).collect() == []


def test_divide_skip():
    g = random.Random(1)
    for _ in range(200):
        sets = [np.unique(np.array([g.randrange(60) for _ in range(g.randint(1, 40))], np.uint64)) for _ in range(g.randint(1, 12))]
        query = np.unique(np.array([g.randrange(60) for _ in range(30)], np.uint64))
        need = [g.randint(1, 12) for _ in sets]
        want = {i: len(np.intersect1d(query, s)) for i, s in enumerate(sets) if len(np.intersect1d(query, s)) >= need[i]}
        assert t_occurrence.search(query, sets, need) == want


@pytest.mark.parametrize(("hot", "last"), [(2, 0), (1000, 3), (1000, 1000)])
def test_components(spark, monkeypatch, hot, last):
    monkeypatch.setattr(common, "HOT_ROWS", hot)
    monkeypatch.setattr("orbweave.llm.components.LAST_LINKS", last)
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 30)] + [(40, 50), (50, 45), (60, 60)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(links, "a", "b").collect()}
    assert got == {**dict.fromkeys(range(31), 0), 40: 40, 45: 40, 50: 40}


def test_quality_rules(docs, empty):
    table = quality_rules.ledger(docs).collect()
    assert len(table) == docs.count() and quality_rules.ledger(empty).collect() == []
    g = random.Random(2)
    texts = [" ".join(g.choice("abc") for _ in range(g.randint(0, 60))) for _ in range(40)] + ["one two\n \none two\nx " * 5, "A" * 9, "Wow! # 50% <b> | No!!"]
    df = docs.sparkSession.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in quality_rules.ledger(df).collect():
        t = texts[r["doc_id"]]
        w = t.split()
        windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        covered = {i + k for i, x in enumerate(windows) if windows.count(x) > 1 for k in range(8)}
        lines = [x for x in t.split("\n") if x.split()]
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"], r["n_dup_lines"]) == (len(w), sum(map(len, w)), len(covered), len(lines) - len(set(lines)))
        assert (r["n_symbols"], r["n_lines"], r["n_upper"], r["n_exclaims"]) == (sum(c in "#*$%&|<>" for c in t), len(lines), sum("A" <= c <= "Z" for c in t), t.count("!"))
    whole = quality_rules.with_policy(quality_rules.ledger(df), "v1")
    kept = {r["doc_id"] for r in whole.where("kept").collect()}
    assert kept == {r["doc_id"] for r in quality_rules.accepted(df, "v1").collect()}
    for r in quality_rules.ablations(whole).where("policy = 'v1'").collect():
        assert r["rejected"] == len(texts) - len(kept)


def test_language_id(spark, docs, empty):
    g = random.Random(4)
    alphabets = {"aa": ["tion", "ing", "the", "ould"], "bb": ["sch", "ung", "ver", "keit"]}
    word = lambda lang: "".join(g.choice(alphabets[lang]) for _ in range(g.randint(1, 3)))
    rows = [(i, " ".join(word(lang) for _ in range(g.randint(5, 80))), lang) for i in range(120) for lang in [g.choice(["aa", "bb"])]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    tables = language_id.fit(df.where("doc_id < 90"))
    assert set(tables) == {"aa", "bb"} and max(map(len, tables.values())) <= language_id.DICTIONARY_BYTES
    found = {r["doc_id"]: r for r in language_id.predict(df, tables).collect()}
    assert sum(found[i]["lang_pred"] == lang for i, _, lang in rows if i >= 90) >= 29
    odd = {r["doc_id"]: r for r in language_id.predict(docs, tables).collect()}
    assert odd[0]["lang_pred"] == odd[1]["lang_pred"] == odd[2]["lang_pred"] == "und" and all(0 <= r["score"] <= 1 for r in odd.values())
    assert odd[7]["lang_pred"] == odd[8]["lang_pred"]
    assert language_id.fit(empty) == {} and language_id.accepted(docs, tables).columns == docs.columns
    assert language_id.predict(empty, tables).collect() == [] and language_id.accepted(empty, tables).collect() == []


def test_language_id_rejects_narrow_margins_and_too_many(spark, monkeypatch):
    rows = [(k, f"{w} " * 30, lang) for k, (w, lang) in enumerate([("sonne", "aa"), ("monde", "bb")])]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    tables = language_id.fit(df)
    texts = spark.createDataFrame([(0, "sonne " * 40), (1, "sonne monde " * 20), (2, "1234"), (3, None)], "doc_id long, text string")
    scores = {r["doc_id"]: r["score"] for r in language_id.predict(texts, tables).collect()}
    assert scores[0] > scores[1]
    limit = (scores[0] + scores[1]) / 2
    assert [r["doc_id"] for r in language_id.accepted(texts, tables, min_margin=limit).collect()] == [0]
    same = language_id.Classifier({"x": tables["aa"], "y": tables["aa"]})
    assert same.predict("sonne") == ("x", 0.0) and language_id.Classifier({"x": b"12345678"}).predict("a") == ("x", 1.0)
    monkeypatch.setattr(language_id, "MAX_LANGUAGES", 1)
    with pytest.raises(ValueError):
        language_id.fit(df)


def test_language_sample_takes_the_least_hashes(spark, monkeypatch):
    monkeypatch.setattr(language_id, "SAMPLE_DOCUMENTS", 5)
    rows = [(f"text {k % 60}", "aa" if k % 3 else "bb") for k in range(400)]
    df = spark.createDataFrame(rows, "text string, lang string").repartition(7)
    hashed = df.select("lang", F.xxhash64("text").alias("h")).distinct()
    got = {(r["lang"], r["h"]) for r in language_id._least(hashed, ["h"], 5).collect()}
    every = hashed.collect()
    assert got == {(x, h) for x in ("aa", "bb") for h in sorted(r["h"] for r in every if r["lang"] == x)[:5]}


def test_sharding(spark, docs, empty):
    def jump(key, n):
        b, j = -1, 0
        while j < n:
            b = j
            key = (key * 2862933555777941757 + 1) % 2**64
            j = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
        return b

    keys = [0, 1, 5, 123456789, 2**40 + 7, 2**63 - 1, -1, -(2**63)]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    for n in (1, 2, 8, 50):
        got = {r["k"]: r["s"] for r in df.select("k", sharding.jump_hash(F.col("k"), n).alias("s")).collect()}
        assert got == {k: jump(k % 2**64, n) for k in keys}
    rows = sharding.assign_shards(docs, 4).collect()
    assert len(rows) == docs.count() and all(r["grown_shard"] in (r["shard"], 4) for r in rows)
    by: dict = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert sharding.assign_shards(empty, 4).collect() == []
    assert sharding.assign_shards(docs, 4, id_column="ids").count() == docs.count()


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("<p>one<p>two <b>b</b>old", "one\n\ntwo bold"),
        ("<ul><li>a<li>b<ol start=3><li>c<li>d</ol></ul>", "- a\n- b\n  3. c\n  4. d"),
        ("<table><tr><th>n<th>value<tr><td>long cell<td>1<tr><td colspan=2>wide</table>", "n          value\nlong cell  1\nwide"),
        ("<div style='display: none'>no</div><p hidden>no</p>x <script>if(a<b)</script>3 < 4 &amp; 5", "x 3 < 4 & 5"),
        ("<pre> x\n   y</pre>", " x\n   y"),
        ("a<br>b<br><br>c", "a\nb\n\nc"),
        ("<title>t</title><!-- c --><details><summary>s</summary>hidden</details><a b='", "s"),
        ("text <unclosed", "text"),
    ],
)
def test_html(page, text):
    assert html_layout.extract(page) == text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<table><tr><td>nav<td><p>one<p>two<ul><li>a<li>b</ul><tr><td>x<td>y</table>", "nav  one\n\n     two\n\n     - a\n     - b\nx    y"),
        ("<table><tr><td>a<br>bb<td>c<br>d<tr><td><pre>x\n  y</pre><td>z</table>", "a    c\nbb   d\nx    z\n  y"),
        ("<table><tr><td rowspan=2>tall<td>1<tr><td>2<tr><td>last<td>3</table>", "tall  1\n      2\nlast  3"),
        ("<table><tr><td rowspan=2>a<br>b<br>c<td>1<tr><td>2</table>", "a  1\nb  2\nc"),
        ("<table><tr><td>l<td><table><tr><td>n<td>1<tr><td>mm<td>2</table><td>r</table>", "l  n   1  r\n   mm  2"),
        ("<table><tr><td colspan=2>a wide one<td>x<tr><td>b<td>c<td>y</table>", "a wide one  x\nb  c        y"),
    ],
)
def test_html_lays_out_cells(page, text):
    assert html_layout.extract(page) == text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("İ" * 60 + "<script>x</script><p>visible one</p><p>two</p>", "İ" * 60 + "\n\nvisible one\n\ntwo"),
        ("<SCRIPT>a</p></Script>b<ſcript>c", "b<ſcript>c"),
        ("<pre>a\n\n\n\nb</pre><p>c</p><br><br><br><br>d", "a\n\n\n\nb\n\nc\n\nd"),
    ],
)
def test_html_keeps_text(page, text):
    assert html_layout.extract(page) == text


def test_extract_pages(spark):
    rows = [(1, "<p>one", "t", 0), (1, "<b>again</b>", "t", 0), (None, "<i>x", "t", 0), (2, None, None, None), (3, "", "t", 1)]
    pages = spark.createDataFrame(rows, "page_id long, html string, text string, url int")
    found = html_layout.extract_pages(pages).collect()
    assert sorted((r["page_id"] or 0, r["text"]) for r in found) == [(0, "x"), (1, "again"), (1, "one"), (2, ""), (3, "")]
    assert html_layout.extract_pages(pages.where("page_id = 9")).collect() == []


def test_html_of_large_tables_is_safe(monkeypatch):
    assert html_layout.extract("<table><tr><td>" * 20000 + "deep") == "deep"
    html_layout.extract("<table>" + "<tr><td rowspan=999>a" * 2000)
    wide = f"<table><tr><td>{'w' * 20000}<td>1" + "<tr><td>a<td>b" * 2000 + "</table>"
    assert len(html_layout.extract(wide)) < len(wide) and html_layout.extract(wide).split() == ["w" * 20000, "1", *["a", "b"] * 2000]
    deep = "<blockquote>x" * 3000
    assert len(html_layout.extract(deep)) < (html_layout.INDENT + html_layout.PADDING) * len(deep)
    monkeypatch.setattr(html_layout, "PADDING", 1)
    monkeypatch.setattr(html_layout, "PADDING_FREE", 0)
    assert html_layout.extract(f"<table><tr><td>{'w' * 90}<td>1<br>2<tr><td>a<td>b") == "w" * 90 + "\n1\n2\na\nb"


def test_html_is_safe():
    assert html_layout.extract("<div>" * 20000 + "deep") == "deep"
    html_layout.extract("<p><button>" + "<div>" * 20000)
    html_layout.extract("<a b='" * 20000)


def test_pipeline(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    g = random.Random(8)
    word = lambda: "".join(g.choice(["tion", "ing", "the", "ould", "er"]) for _ in range(g.randint(1, 3)))
    clean = [" ".join(word() for _ in range(60)) for _ in range(12)]
    texts = [*clean, clean[0], clean[1] + " end", "### " * 40, "too short", None, "12 34 " * 30]
    rows = [(i, t, "en" if i % 2 else "xx", "s", len(t or "")) for i, t in enumerate(texts)]
    (tmp_path / "documents.parquet").mkdir()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    known = corpus_pipeline.STAGES[0][1](spark, docs, str(tmp_path))
    tables = language_id.fit(docs.where(~held_out()))
    tool = language_id.Classifier(tables)
    told = {i for i, t in enumerate(texts) if tool.predict(t)[0] != "und" and tool.predict(t)[1] >= language_id.MIN_MARGIN}
    assert {r["doc_id"] for r in known.collect()} == told and known.columns == docs.columns
    for _, stage in corpus_pipeline.STAGES[1:3]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted(r["doc_id"] for r in docs.collect()) == list(range(12))
    out = {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").collect()}
    good = [i for i in sorted(told) if i < 14]
    assert out == {i for i in good if not (i == 12 and 0 in good) and not (i == 13 and 1 in good)} and len(out) > 6


def test_pipeline_of_nothing_and_of_repeated_ids(spark, tmp_path, docs):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    (tmp_path / "documents.parquet").mkdir()
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
    rows = [(1, "b b b", "x", "s", 1), (1, "a a a", "x", "s", 1), (1, "a a a", "x", "s", 1), (None, "b b b", "x", "s", 1), (None, None, None, None, None), (2, "a a a", None, None, None), (3, "", None, None, None)]
    kept = corpus_pipeline.without_near_duplicates(spark, spark.createDataFrame(rows, schema), "")
    assert sorted(((r["doc_id"] or 0, r["text"] or "") for r in kept.collect())) == [(0, ""), (0, "b b b"), (1, "a a a"), (3, "")]
