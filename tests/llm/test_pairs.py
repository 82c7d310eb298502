from __future__ import annotations

import hashlib
import random
import struct
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from seqforge.llm import images, jaccard, phrases, pictures, quality, tiles
from seqforge.llm.components import components


def plain_join(rows):
    sets = []
    for _, t in rows:
        w = (t or "").split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))
    links = [0] * len(rows)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return [(doc, least.get(find(i)), links[i]) for i, (doc, _) in enumerate(rows)], len({find(i) for i in range(len(rows))})


def edited(rng, text, n):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = f"e{rng.randrange(999)}"
    return " ".join(w)


def test_join_against_all_pairs(spark, odd, odd_texts, none):
    got = jaccard.classes(odd)
    want, groups = plain_join(odd_texts)
    assert Counter((r.doc_id, r.class_id, r.n_links) for r in got.collect()) == Counter(want)
    kept = jaccard.one_of_each(odd)
    assert kept.columns == odd.columns and kept.count() == groups
    assert jaccard.classes(none).count() == 0 and jaccard.one_of_each(none).count() == 0


def test_join_of_a_large_group_in_tiles(spark):
    rng = random.Random(5)
    base = " ".join(f"w{rng.randrange(5000)}" for _ in range(200))
    rows = [(i, edited(rng, base, i % 9)) for i in range(90)] + [(100 + i, " ".join(f"v{rng.randrange(5000)}" for _ in range(60))) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for tile in (1000, 16):
        assert Counter((r.doc_id, r.class_id, r.n_links) for r in jaccard.classes(df, tile=tile).collect()) == Counter(plain_join(rows)[0])


def test_bands_reach_the_recall():
    for t in (0.5, 0.8, 0.9):
        bands, rows = jaccard.choose_bands(t, 0.99, 256)
        assert bands * rows <= 256 and 1 - (1 - t**rows) ** bands >= 0.99
    with pytest.raises(ValueError):
        jaccard.choose_bands(0.1, 0.999, 4)


def test_components(spark):
    rng = random.Random(6)
    edges = [(i, i + 1) for i in range(60)] + [(rng.randrange(100, 300), rng.randrange(100, 300)) for _ in range(90)] + [(7, 7)]
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    ends = {x for e in edges for x in e if e[0] != e[1]}
    assert got == {x: find(x) for x in ends}


def plain_removal(rows, width):
    words = [(t or "").encode().split() for _, t in rows]
    count = Counter(tuple(w[k : k + width]) for w in words for k in range(len(w) - width + 1))
    out = []
    for (doc, _), w in zip(rows, words):
        gone = set()
        for k in range(len(w) - width + 1):
            if count[tuple(w[k : k + width])] > 1:
                gone |= set(range(k, k + width))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc, len(w), len(gone), hashlib.sha256(kept).hexdigest(), kept.decode()))
    return Counter(out)


@pytest.mark.parametrize(("width", "phrase"), [(35, 10), (6, 3), (4, 4)])
def test_repeated_passages_against_a_count(spark, odd, odd_texts, none, width, phrase):
    rng = random.Random(8)
    more = [(50 + i, " ".join(rng.choice("abc") for _ in range(rng.randrange(0, 60)))) for i in range(20)]
    df = odd.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    got = phrases.repeated(df, width, phrase).collect()
    assert Counter(tuple(r) for r in got) == plain_removal([*odd_texts, *more], width)
    assert phrases.repeated(none).count() == 0


def test_classifier_learns_and_knows_nothing_else(spark, none):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(2, 8)))
    good = lambda: " ".join(word() for _ in range(rng.randint(30, 200))).capitalize() + "."
    bad = lambda: " | ".join(word().upper() + "!!" for _ in range(rng.randint(30, 200)))
    rows = [(i, good() if i % 4 else bad(), i % 3) for i in range(400)] + [(1000, None, 1), (None, "", 1), (1001, good() * 40, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(400)] + [(5, None), (6, 7), (99999, 1), (None, 0)], "doc_id long, quality int")
    network, share = quality.fit(docs, labels, sample=120)
    out = {r.doc_id: r.score for r in quality.score(docs, network, share).collect()}
    tested = [i for i in range(400) if __import__("zlib").crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(out[i] >= 0.3) == (i % 4 > 0) for i in tested]) > 0.95 and all(0 <= s <= 1 for s in out.values()) and out[1001] >= 0.3
    again, _ = quality.fit(docs.repartition(5), labels.repartition(2), sample=120)
    assert {r.doc_id: r.score for r in quality.score(docs.coalesce(1), again, share).collect()} == out
    assert quality.fit(docs, labels.where("quality = 1"))[0] is None and quality.fit(docs, labels.limit(0)) == (None, 0.5)
    assert quality.score(none, None).count() == 0 and quality.accepted(docs, network).columns == docs.columns
    assert quality.accepted(docs, network).where("doc_id < 400 AND doc_id % 4 = 0").count() < 5


def test_image_copies(spark):
    rng = np.random.default_rng(10)
    base = images.draw(rng.normal(0, 0.15, (30, 64)).astype(np.float32), 7)
    rows, of = [], {}
    for i, x in enumerate(base):
        copies = [x] if i >= 6 else [x, x[6:50, 5:54], np.clip(x * 0.8 + 25.0, 0, 255).astype(np.uint8), np.rot90(x), x]
        for k, y in enumerate(copies):
            rows.append((100 * i + k, y.shape[0], y.shape[1], np.ascontiguousarray(y).tobytes(), 1))
            of[100 * i + k] = 100 * i
    rows += [(9001, 5, 5, None, 1), (9002, None, 5, b"", 1), (9003, 9, 9, b"\x00" * 81, 1), (9004, 3, 3, b"123", 1), (None, *rows[0][1:]), rows[0]]
    df = spark.createDataFrame(rows, "image_id long, height int, width int, pixels binary, root int").repartition(3)
    for tile in (400, 4):
        got = images.copies(df, tile=tile).collect()
        assert len(got) == len(rows)
        assert {r.image_id: r.class_id for r in got if r.image_id is not None and r.image_id < 9000} == of
        assert all(r.class_id == r.image_id and r.n_links == 0 for r in got if r.image_id is None or r.image_id > 9000)
    assert images.copies(df.limit(0)).count() == 0
    assert images.copies(images.drawn(spark.createDataFrame([(1, None), (2, [0.5] * 3), (3, [0.5] * 64)], "vec_id long, embedding array<float>"))).count() == 3


IMAGE = "image_id long, height int, width int, pixels binary"


def image_rows(pictures):
    return [(i, *x.shape, np.ascontiguousarray(x).tobytes()) for i, x in enumerate(pictures)]


def smooth(rng, h, w, block=7):
    return np.clip(128 + 60 * np.kron(rng.normal(0, 1, (-(-h // block), -(-w // block))), np.ones((block, block))), 0, 255)[:h, :w].astype(np.uint8)


def linked_alike(spark, pictures, **parameters):
    """n_links and class_id of the operator and of consensus on all pairs."""
    points = [images.describe(x[None])[0] for x in pictures]
    n, root = [0] * len(points), list(range(len(points)))
    for i in range(len(points)):
        for j in range(i):
            if np.array_equal(pictures[i], pictures[j]) or images.linked_by(points[j], points[i]):
                n[i], n[j] = n[i] + 1, n[j] + 1
                a, b = sorted((root[i], root[j]))
                root = [a if x == b else x for x in root]
    got = {r.image_id: r for r in images.copies(spark.createDataFrame(image_rows(pictures), IMAGE).repartition(3), **parameters).collect()}
    return [(got[i].n_links, got[i].class_id) for i in range(len(points))], list(zip(n, root))


def test_image_links_whatever_a_buckets_least(spark, monkeypatch):
    # each bucket of two copies has a least image of its own, unlike both: no least is named more than twice
    bits = np.random.default_rng(1).integers(0, 256, (12, images.BITS // 8)).astype(np.uint8)
    xy = np.random.default_rng(2).uniform(0, 40, (12, 2))
    made = []
    for k in range(12):  # pictures of lower ids, each with one of the copies' descriptors
        p = np.zeros(1, images.KEYPOINT)
        p["bits"], p["x"], p["y"] = bits[k].copy(), *xy[k]
        p["bits"][0, 8:] ^= 0xFF
        made.append(p)
    whole = np.zeros(12, images.KEYPOINT)
    whole["bits"], whole["x"], whole["y"] = bits, xy[:, 0], xy[:, 1]
    other = whole.copy()
    other["bits"][:, 8:] ^= 0x01
    made += [whole, other]
    rows = [(i, bytes([i]), p.tobytes(), images._keys(p)) for i, p in enumerate(made)]
    held = spark.createDataFrame(rows, "image_id long, digest binary, points binary, keys array<long>")
    monkeypatch.setattr(images, "keyed", lambda *_: held)
    got = {r.image_id: (r.class_id, r.n_links) for r in images.copies(held).collect()}
    assert got[12] == got[13] == (12, 1) and all(got[i] == (i, 0) for i in range(12))


def test_image_links_with_two_keys_in_common(spark, monkeypatch):
    rng = np.random.default_rng(6)
    whole = np.zeros(12, images.KEYPOINT)
    whole["bits"], whole["x"], whole["y"] = rng.integers(0, 256, (12, images.BITS // 8)), *rng.uniform(0, 40, (2, 12))
    other = whole.copy()
    other["bits"][:, ::3] ^= 1  # a bit of each part
    other["bits"][:2, 0] ^= 1
    assert len(set(images._keys(whole)) & set(images._keys(other))) == 2
    held = spark.createDataFrame([(i, bytes([i]), p.tobytes(), images._keys(p)) for i, p in enumerate((whole, other))], "image_id long, digest binary, points binary, keys array<long>")
    monkeypatch.setattr(images, "keyed", lambda *_: held)
    assert {tuple(r) for r in images.copies(held).collect()} == {(0, 0, 1), (1, 0, 1)}


def test_image_links_between_followers(spark):
    wide = smooth(np.random.default_rng(2), 56, 140)
    a, c, d, b = (np.ascontiguousarray(wide[:, x : x + 56]) for x in (0, 20, 40, 60))  # links A-C, C-D, D-B only
    pictures = [a, b, c, d, a, a]
    for tile in (400, 2):
        got, want = linked_alike(spark, pictures, tile=tile)
        assert got == want
    assert got == [(3, 0), (1, 0), (4, 0), (2, 0), (3, 0), (3, 0)]


def test_image_crops_of_large_pictures_and_plain_copies(spark):
    large = smooth(np.random.default_rng(4), 240, 240, 9)
    blank = np.full((30, 30), 255, np.uint8)
    logo = blank.copy()
    logo[10:20, 10:20] = 0
    pictures = [large, large[60:180, 40:160], blank, blank.copy(), logo, logo.copy(), smooth(np.random.default_rng(5), 240, 240, 9)]
    got, want = linked_alike(spark, pictures)
    assert got == want == [(1, 0), (1, 0), (1, 2), (1, 2), (1, 4), (1, 4), (0, 6)]


def test_tiles_hold_every_pair_once(spark):
    rng = random.Random(12)
    chain = {i: [10_000 + i, 10_001 + i] for i in range(30)}  # long, loose: by buckets
    crowd = {1000 + i: [1, 2, 3 + rng.randrange(3)] for i in range(40)}  # all alike: as a whole
    mixed = {2000 + i: sorted({50 + rng.randrange(6) for _ in range(2)} | {500 + rng.randrange(20)}) for i in range(80)}
    keys = chain | crowd | mixed | {5000: [99_999], 5001: []}
    members = spark.createDataFrame([(i, 8, k) for i, k in keys.items()], "node long, size long, keys array<long>")
    for least, most, parts in ((4, 8, 3),):
        rows = tiles.spread(tiles.deal(members, least, most, parts).join(members.select("node", "keys"), "node"), "keys").collect()
        groups, seen, modes = {}, Counter(), set()
        for r in rows:
            groups.setdefault((r.mode, r.tile, r.a, r.b), []).append(r)
        for (mode, tile, a, b), own in groups.items():
            modes.add(mode)
            assert len({r.node for r in own}) == len(own) and len(own) <= 6 * 2 * max(least, 8)
            here = tiles.belong(mode, tile, a, b, np.array([r.part for r in own]), [np.array(r["keys"]) for r in own])
            for i in range(len(own)):
                for j in range(i):
                    if here[i, j]:
                        seen[tuple(sorted((own[i].node, own[j].node)))] += 1
        wanted = {(i, j) for i in keys for j in keys if i < j and set(keys[i]) & set(keys[j])}
        assert wanted <= set(seen) and max(seen.values()) == 1
        assert modes == {0, 1}


def test_a_repeated_row_is_sent_once(spark, monkeypatch):
    base = " ".join(f"w{i}" for i in range(100))
    docs = spark.createDataFrame([(1, base)] * 60 + [(2, base + " more")] + [(None, base + " again and on")] * 9, "doc_id long, text string").repartition(4)
    seen = []
    whole = jaccard.spread
    monkeypatch.setattr(jaccard, "spread", lambda df, *more: seen.append(df.count()) or whole(df, *more))
    got = Counter((r.doc_id, r.class_id, r.n_links) for r in jaccard.classes(docs).collect())
    assert seen == [3] and got == {(1, 1, 69): 60, (2, 1, 69): 1, (None, 1, 69): 9}


def test_passages_are_found_by_the_automaton_alone(spark, monkeypatch):
    rng = random.Random(13)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(4))
    common = [word() for _ in range(60)]
    rows = [(i, " ".join([*(word() for _ in range(20)), *common[i % 3 :], *(word() for _ in range(20))])) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sum(r.n_removed for r in phrases.repeated(docs).collect()) > 600
    assert Counter(tuple(r) for r in phrases.repeated(docs, span=2).collect()) == plain_removal(rows, 35)
    words = rows[0][1].encode().split()
    passage = b" ".join(w.encode() for w in common)
    assert sum(phrases.removed(words, phrases.finders([passage]))) == 60 and phrases.removed(words, []) is None
    broken = phrases.finders([passage])
    broken[0].automaton = __import__("ahocorasick").Automaton()
    broken[0].automaton.add_word("nothing", 0)
    broken[0].automaton.make_automaton()
    assert phrases.removed(words, broken) is None


def test_owners_share_a_passage_that_all_blocks_have():
    """One long passage in each of 64 blocks: its windows are owned, and its passages sent, about evenly."""
    rng = random.Random(6)
    text = " ".join(rng.choice(["ka", "lo", "mi", "nu"]) + str(rng.randrange(5000)) for _ in range(100_000))
    w = phrases.Words(pa.array([text]), 35, 10)
    a, b = w.identities(w.starts)
    own = np.zeros(len(a), phrases._WINDOW)
    own["key"], own["more"], own["at"], own["region"] = a, (b >> np.uint64(33)).astype(np.uint32) << 1, w.starts, w.regions(w.starts)
    own = own[np.lexsort((own["more"], own["key"]))]
    sent = phrases._table([(0, 0, k, own.tobytes()) for k in range(64)], {"shard": pa.int32(), "span": pa.int32(), "block": pa.int64(), "packed": pa.binary()})
    told = phrases._meet(phrases._WINDOW, False, False)(sent)
    batch = pa.RecordBatch.from_arrays([pa.array([text])], ["text"])
    windows, sends, passages = [], [], 0
    for packed in told["packed"]:
        need = np.frombuffer(packed.as_buffer(), phrases._NEED)
        windows.append(len(np.unique(need["at"])))
        rows = list(phrases._passages(batch, need, 35))
        passages += len(rows)
        sends.append(sum(len(x) * len(to) for x, to in rows))
        assert all(len(to) == 64 for _, to in rows)
    assert len(told) == 64 and sum(windows) == len(w.starts)
    assert max(windows) <= 2 * np.median(windows) and max(sends) <= 2 * np.median(sends)
    assert len(w.starts) / passages > 25  # runs of neighbours stay whole


def test_automata_against_every_place():
    rng = random.Random(14)
    for _ in range(150):
        width = rng.randint(3, 8)
        phrase = rng.randint(1, width)
        letters = [bytes([97 + k]) for k in range(rng.randint(2, 5))]
        passages = [[rng.choice(letters) for _ in range(rng.randint(width, 30))] for _ in range(rng.randint(0, 25))]
        text = [rng.choice(letters) for _ in range(rng.randint(0, 60))] + (passages[0] if passages else [])
        held = {tuple(p[k : k + width]) for p in passages for k in range(len(p) - width + 1)}
        want = {k + d for k in range(len(text) - width + 1) if tuple(text[k : k + width]) in held for d in range(width)}
        got = phrases.removed(text, phrases.finders([b" ".join(p) for p in passages], width, phrase, vocabulary=rng.choice([2, 4, 1000])))
        assert {k for k, x in enumerate(got or b"") if x} == want


def plain_convolution(net, text, filters):
    """Means, maxima and minima over chunks of the largest responses, one position at a time."""
    data = text + bytes(quality.WIDTH + quality.STEP)
    places = max(1, -(-len(text) // quality.STEP))
    response = [np.maximum(net.bias + sum(filters[j][data[p * quality.STEP + j]] for j in range(quality.WIDTH)), 0) for p in range(places)]
    pooled, begin = [], 0
    while not pooled or begin - quality.STRIDE + quality.CHUNK < places:
        pooled.append(np.max(response[begin : begin + quality.CHUNK], axis=0))
        begin += quality.STRIDE
    return np.concatenate((np.mean(pooled, axis=0), np.max(pooled, axis=0), np.min(pooled, axis=0)))


def test_features_are_those_of_a_plain_convolution():
    rng = np.random.default_rng(15)
    filters = rng.normal(0, 1, (quality.WIDTH, 256, 5)).astype(np.float32)
    net = quality.Network(filters, rng.normal(0, 1, 5), None, 0.0)
    for sizes in ([0], [1, 0, 3, 4, 5], [255, 256, 257], [258, 700, 4 * 48 + 4 * 64, 4 * 48 + 4 * 64 + 1, 3000]):
        texts = [rng.integers(0, 256, n).astype(np.uint8).tobytes() for n in sizes]
        got = net.features(texts)
        for own, text in zip(got, texts):
            assert np.allclose(own, plain_convolution(net, text, filters), atol=1e-4)


def test_the_sample_holds_whole_texts_within_its_bytes():
    rows = [(k, k, k % 2, 40) for k in range(20)] + [(-1, 99, 0, 1000)]
    got = list(quality._affordable(rows, 400))
    assert len(got) == 10 and Counter(q for _, q in got) == {0: 5, 1: 5} and 99 not in {d for d, _ in got}
    assert [len(b) for b in quality._batches([b"x" * n for n in (3, 3, 9, 1, 1)], 6)] == [2, 1, 2]


def png(rows, width, depth, kind, filters, palette=None, interlaced=0):
    """A PNG file of packed rows, filtered as asked for."""
    step = max(1, depth * {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[kind] // 8)
    out = b""
    for block in rows:
        above = bytes(len(block[0])) if block else b""
        for line, f in zip(block, filters * (len(block) + 1)):
            got = bytearray()
            for k, v in enumerate(line):
                a, b, c = (line[k - step] if k >= step else 0), above[k], (above[k - step] if k >= step else 0)
                p = a + b - c
                paeth = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                got.append((v - (0, a, b, (a + b) // 2, paeth)[f]) & 255)
            out += bytes([f]) + bytes(got)
            above = line
    chunk = lambda n, x: struct.pack(">I", len(x)) + n + x + struct.pack(">I", zlib.crc32(n + x))
    head = struct.pack(">IIBBBBB", width, png.height, depth, kind, 0, 0, interlaced)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + (chunk(b"PLTE", palette) if palette else b"") + chunk(b"IDAT", zlib.compress(out)) + chunk(b"IEND", b"")


def test_picture_files(spark):
    rng = np.random.default_rng(16)
    grey = rng.integers(0, 256, (11, 13)).astype(np.uint8)
    png.height = 11
    lines = lambda x: [bytes(r) for r in x.reshape(len(x), -1)]
    for filters in ([0], [1], [2], [3], [4], [0, 1, 2, 3, 4]):
        assert np.array_equal(pictures.picture(png([lines(grey)], 13, 8, 0, filters)), grey)
        colour = rng.integers(0, 256, (11, 13, 3)).astype(np.uint8)
        want = np.rint(colour @ [0.299, 0.587, 0.114])
        assert np.array_equal(pictures.picture(png([lines(colour)], 13, 8, 2, filters)), want)
        assert np.array_equal(pictures.picture(png([lines(np.concatenate((colour, grey[..., None]), 2))], 13, 8, 6, filters)), want)
        assert np.array_equal(pictures.picture(png([lines(np.stack((grey, colour[..., 0]), 2))], 13, 8, 4, filters)), grey)
        assert np.array_equal(pictures.picture(png([lines(np.stack((grey, colour[..., 0]), 2))], 13, 16, 0, filters)), grey)
    bits = rng.integers(0, 2, (11, 13)).astype(np.uint8)
    assert np.array_equal(pictures.picture(png([lines(np.packbits(bits, axis=1))], 13, 1, 0, [0])), bits * 255)
    palette = rng.integers(0, 256, (2, 3)).astype(np.uint8)
    assert np.array_equal(pictures.picture(png([lines(np.packbits(bits, axis=1))], 13, 1, 3, [0], palette.tobytes())), np.rint(palette[bits] @ [0.299, 0.587, 0.114]))
    passes = [lines(grey[y::dy, x::dx]) for x, y, dx, dy in pictures._PASSES]
    whole = png(passes, 13, 8, 0, [0, 3, 4], interlaced=1)
    assert np.array_equal(pictures.picture(whole), grey)
    assert np.array_equal(pictures.picture(b"P5 # a\n13 11\n255\n" + grey.tobytes()), grey)
    assert np.array_equal(pictures.picture(b"P6\n13 11 255\n" + np.repeat(grey, 3).tobytes()), grey)
    broken = [b"", b"x", b"GIF89a", whole[:40], whole[:-30], whole[:60] + b"!" + whole[61:], b"P5 13 11 255\n123", b"P5 0 11 255\n", b"\x89PNG\r\n\x1a\n"]
    assert [pictures.picture(x) for x in broken] == [None] * len(broken)
    files = spark.createDataFrame([(1, whole, 0), (2, broken[4], 0), (3, None, 0), (4, b"P5 13 11 255\n" + grey.tobytes(), 0)], "image_id long, content binary, pixels int")
    got = {r.image_id: r for r in images.decoded(files).collect()}
    assert got[1].pixels == got[4].pixels == grey.tobytes() and got[2].pixels is None and got[3].pixels is None
    assert {r.image_id: (r.class_id, r.n_links) for r in images.copies(images.decoded(files)).collect()} == {1: (1, 1), 4: (1, 1), 2: (2, 0), 3: (3, 0)}


def test_image_pairs_however_many_turns_lie_between(monkeypatch):
    # two pictures whose one pair of near pairs that agree lies among many of turns close by that do not
    rng = np.random.default_rng(8)
    n = 40
    a, b = np.zeros(n, images.KEYPOINT), np.zeros(n, images.KEYPOINT)
    a["bits"] = b["bits"] = rng.integers(0, 256, (n, images.BITS // 8))
    a["x"], a["y"] = 10.0 * np.arange(n), 0
    b["x"], b["y"] = 0, 0  # no line of b is long enough
    b["x"][-1], b["y"][0] = 10.0 * (n - 1), 0
    b["turn"] = np.linspace(0, images.APART, n).astype(np.uint8)
    for held in (images.HELD, 3):
        monkeypatch.setattr(images, "HELD", held)
        assert [x.tolist() for x in images._tried([a, b], None)] == [[0], [1]]
    b["x"][-1] = 0
    assert [x.tolist() for x in images._tried([a, b], None)] == [[], []]


def test_planted_copies_of_the_query(spark):
    """The query's own pictures: its links are those of consensus on all pairs, and hold the planted copies."""
    rng = np.random.default_rng(23)
    vectors = rng.normal(size=(240, 64))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    rows = images.drawn(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>"))
    drawn = {r.image_id: np.frombuffer(r.pixels, np.uint8).reshape(r.height, r.width) for r in rows.collect()}
    assert len(drawn) == 252 and sorted(drawn)[:2] == [-221, -201]
    points = {i: images.describe(x[None])[0] for i, x in drawn.items()}
    want = {i for i in range(0, 240, 20) if images.linked_by(points[i], points[-i - 1])}
    got = {r.image_id: r for r in images.copies(rows.repartition(3)).collect()}
    found = {i for i in want if got[i].n_links == got[-i - 1].n_links == 1 and got[i].class_id == got[-i - 1].class_id == -i - 1}
    assert len(want) >= 9 and len(found) >= 0.9 * len(want)
    assert sum(r.n_links for r in got.values()) == 2 * len(found)


def test_recall_of_edited_copies():
    """Both stages, keys and tried pairs, against consensus on all pairs, by kind of edit."""
    rng = np.random.default_rng(17)
    vectors = rng.normal(size=(120, 64))
    plain = images.scenes(vectors / np.linalg.norm(vectors, axis=1, keepdims=True))
    points = images.describe(plain)
    resized = lambda x, z: np.clip(images._resize(x[None].astype(np.float32), z)[0], 0, 255).astype(np.uint8)
    edits = {
        "crop": lambda x: x[5:43, 4:44], "zoom in": lambda x: resized(x, 0.8), "zoom out": lambda x: resized(x, 4 / 3), "turn": lambda x: np.rot90(x),
        "paler": lambda x: images.edited(x, 3), "noise": lambda x: np.clip(x + rng.normal(0, 10, x.shape), 0, 255).astype(np.uint8),
    }
    for name, edit in edits.items():
        other = [images.describe(np.ascontiguousarray(edit(x))[None])[0] for x in plain]
        linked = np.array([images.linked_by(a, b) for a, b in zip(points, other)])
        i, j = images._tried(points + other, np.repeat([0, 1], 120))
        tried = set(zip(i.tolist(), j.tolist()))
        shared = [set(images._keys(points[k])) & set(images._keys(other[k])) for k in range(120)]
        found = np.array([(k, k + 120) in tried and len(shared[k]) > 0 for k in range(120)])
        assert (found == [(k, k + 120) in tried for k in range(120)]).all()
        assert linked.mean() > 0.7 and found[linked].mean() >= 0.9, name
    i, j = np.triu_indices(120, 1)
    assert not images._linked(points, i, j, images.INLIERS).any()


def test_image_pairs_of_many_keypoints_in_batches(monkeypatch):
    """Pairs of more than 32 keypoints are matched in batches too, as linked_by matches each."""
    rng = np.random.default_rng(29)
    vectors = rng.normal(size=(25, 64))
    plain = images.scenes(vectors / np.linalg.norm(vectors, axis=1, keepdims=True))
    pictures = [images.edited(x, kind) for x in plain for kind in (0, 1, 2, 4)]
    points = [images.describe(np.ascontiguousarray(x)[None])[0] for x in pictures]
    i, j = np.triu_indices(len(points), 1)
    larger = np.maximum(*(np.array([len(p) for p in points])[k] for k in (i, j)))
    want = [images.linked_by(points[a], points[b]) for a, b in zip(i.tolist(), j.tolist())]
    calls = []
    monkeypatch.setattr(images, "linked_by", lambda *_: calls.append(1))
    assert images._linked(points, i, j, images.INLIERS).tolist() == want
    assert not calls and (larger > 32).sum() > 1000 and 60 < sum(want) < 300 and np.array(want)[larger > 32].sum() > 30


def test_a_tile_holds_the_near_pairs_of_some_images_only():
    """Millions of near pairs that agree on no turn, and a few links: memory is a multiple of the descriptors', not of the pairs."""
    rng = np.random.default_rng(31)
    base = rng.integers(0, 256, (40, 24, images.BITS // 8)).astype(np.uint8)
    made = np.zeros((4000, 24), images.KEYPOINT)
    made["bits"] = base[np.arange(4000) // 2 % 40] ^ (1 << rng.integers(0, 8, (4000, 24, 32)) * (rng.random((4000, 24, 32)) < 0.1)).astype(np.uint8)
    made["x"], made["y"], made["turn"] = 0, rng.uniform(0, 3, (4000, 24)), rng.integers(0, 256, (4000, 24))  # no line is long enough
    kinds = rng.integers(0, 256, (30, 24, images.BITS // 8)).astype(np.uint8)
    for k in range(30):  # links: images 2k and 101 + 2k, of different parts
        for n in (2 * k, 101 + 2 * k):
            made[n]["bits"], made[n]["x"], made[n]["y"], made[n]["turn"] = kinds[k], 7 * np.arange(24) % 45, 11 * np.arange(24) % 43, 9
    own = pa.array(range(4000), pa.int64())
    same = lambda x, kind: pa.array([x] * 4000, kind)
    group = pa.table({"mode": same(0, pa.int32()), "tile": same(0, pa.int64()), "a": same(0, pa.int32()), "b": same(1, pa.int32()), "part": pa.array(np.arange(4000) % 2), "node": own, "copies": same(1, pa.int64()), "points": [p.tobytes() for p in made]})
    tracemalloc.start()
    got = images._compare(group, images.INLIERS).to_pylist()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sorted((r["node"], r["links"], r["other"]) for r in got) == sorted((n, 1, 2 * k) for k in range(30) for n in (2 * k, 101 + 2 * k))
    assert peak < 45 * made.nbytes
