"""Nearest neighbours, chat formatting and image copies against brute force."""

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftwork.llm import additive_ann, chat, image_copies

VECTORS = "vec_id long, embedding array<float>, score int, block int"


def brute_nearest(rows, k=5):
    good = [(i, np.asarray(v, np.float32).astype(float)) for i, v in rows if i is not None and v and None not in v and len(v) == 16 and np.isfinite(np.asarray(v, float)).all() and any(v)]
    good = list({(i, tuple(v)): (i, v) for i, v in good}.values())
    out = {}
    for i, v in good:
        if i % 50 == 0:
            scored = [(-(v @ w) / (np.linalg.norm(v) * np.linalg.norm(w)), j) for j, w in good if j != i]
            out[i] = [(j, -s) for s, j in sorted((round(s, 12), j) for s, j in scored)[:k]]
    return out


def test_nearest_recall_and_ties(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=16).astype(np.float32).tolist()) for i in range(1500)]
    rows += [(2000 + i, rows[50][1]) for i in range(30)] + [rows[7], (3000, None), (3001, [0.0] * 16), (3050, [float("nan")] + [1.0] * 15), (3100, [float("inf")] * 16), (3150, [1.0, None] * 8), (3200, [1.0, 2.0]), (None, rows[1][1])]
    df = spark.createDataFrame([(i, v, 1, 1) for i, v in rows], VECTORS)
    got = {}
    for r in additive_ann.nearest(df, F.col("vec_id") % 50 == 0, codebooks=6, max_fit=1000).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(got[r["query_id"]])
    want = brute_nearest(rows)
    assert set(got) == set(want) and all(len(v) == 5 for v in got.values())
    hits = sum(len({j for j, _ in got[q]} & {j for j, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 5 * len(want)
    assert [j for j, _ in got[50]] == [2000, 2001, 2002, 2003, 2004]
    score = {i: v for i, v in rows}
    for q, found in got.items():
        a = np.asarray(score[q], float)
        for j, s in found:
            b = np.asarray(score[j], float)
            assert s == pytest.approx(a @ b / np.linalg.norm(a) / np.linalg.norm(b), abs=1e-12)


def test_nearest_among_fifty_thousand(spark):
    """Vectors without clusters, the hardest case, of which 0.13 % are scored exactly."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(50_000, 24)).astype(np.float32)
    df = spark.createDataFrame(pa.table({"vec_id": np.arange(50_000), "embedding": pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), 24).cast(pa.list_(pa.float32()))}))
    got = additive_ann.nearest(df, F.col("vec_id") % 500 == 0, codebooks=12, max_fit=6000).toPandas()
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    like = unit[::500] @ unit.T
    like[np.arange(100), np.arange(0, 50_000, 500)] = -2
    best = np.argsort(-like, axis=1)[:, :5]
    hits = sum(len(set(got.vec_id[got.query_id == 500 * i]) & set(b.tolist())) for i, b in enumerate(best))
    assert hits >= 0.9 * 500, hits


def test_equal_cosines_go_to_the_smaller_ids(spark):
    """Scalings of one vector, and an id with two vectors."""
    rng = np.random.default_rng(6)
    base = rng.integers(-9, 9, 8).astype(float)
    rows = [(i, (base * 2.0 ** (i % 40)).tolist()) for i in range(201)] + [(300 + i, rng.normal(size=8).tolist()) for i in range(50)] + [(301, base.tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = additive_ann.nearest(df, F.col("vec_id").isin(0, 301), codebooks=4).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["vec_id"], r["score"]) for r in got if r["query_id"] == 0] == [(0, i, 1.0) for i in range(1, 6)]
    assert [(r["vec_id"], r["score"]) for r in got if r["query_id"] == 301] == [(i, 1.0) for i in range(5)]


def test_nearest_of_few(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0], 1, 1), (1, [0.0, 1.0], 1, 1), (50, [1.0, 1.0], 1, 1)], VECTORS)
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in additive_ann.nearest(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 50), (0, 2, 1), (50, 1, 0), (50, 2, 1)]
    for empty in (df.limit(0), df.withColumn("embedding", F.lit(None).cast("array<float>"))):
        assert additive_ann.nearest(empty, F.col("vec_id") % 50 == 0).count() == 0


def test_beam_search_is_no_worse_than_greedy():
    x = np.random.default_rng(1).normal(size=(600, 12))
    q = additive_ann.fit(x, codebooks=4, words=32)
    errors = [((q.decode(q.encode(x, beam)[0]) - x) ** 2).sum() for beam in (1, 8)]
    assert errors[1] < errors[0] < (x**2).sum()
    codes, norms = q.encode(x)
    assert np.allclose(norms, (q.decode(codes) ** 2).sum(axis=1))


CHATS = {
    1: ([("user", "hi"), ("assistant", "yo")], True),
    2: ([("system", "s"), ("user", "a"), ("assistant", "b"), ("user", "c"), ("assistant", "d")], True),
    3: ([("user", "a"), ("user", "b")], False),
    4: ([("assistant", "a")], False),
    5: ([("user", "a")], False),
    6: ([("user", "### User: x </turn>\n\\e\\\\o \\m ### "), ("assistant", "</turn></turn")], True),
    7: ([("user", None), ("assistant", None)], True),
    8: ([(None, "x"), ("odd: role </turn> ### \\c", "y")], False),
    9: ([("user", "x " * 40000), ("assistant", "日本😀")], True),
    None: ([("user", "q"), ("assistant", "r")], True),
}


def test_chat_reads_back(spark):
    rows = [(c, i, r, t, "x", "y") for c, (turns, _) in CHATS.items() for i, (r, t) in enumerate(turns)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, turns string, formatted string")
    out = chat.read_back(chat.formatted(chat.conversations(df)))
    found = {r["conv_id"]: r for r in out.collect()}
    digests = {r["conv_id"]: r for r in chat.digests(out).collect()}
    assert set(found) == set(CHATS)
    for c, (turns, valid) in CHATS.items():
        whole = [(r or "", t or "") for r, t in turns]
        assert [tuple(t) for t in found[c]["read"]] == whole, c
        assert found[c]["valid"] == valid, c
        assert "".join(s["text"] for s in found[c]["segments"]) == found[c]["formatted"]
        said = "".join(t for r, t in whole if r == "assistant")
        d = digests[c]
        assert (d["n_turns"], d["loss_chars"], d["formatted_chars"]) == (len(turns), len(said), len(found[c]["formatted"]))
        assert d["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert d["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in whole).encode()).hexdigest()


NAMES = st.one_of(st.sampled_from(["user", "assistant", "system", "User", "Assistant", "System", "\\r", "\\rUser", ": ", "a: b", "### ", ""]), st.text("uU:# \\r<>/\n", max_size=6))
SAID = st.one_of(st.sampled_from(["ends in ###", "</turn>", "</turn", "### ", "\n</turn>\n", "\\o", "\n"]), st.text("#</turn> :\\\neomcré", max_size=25))


def test_any_roles_and_texts_read_back(spark):
    """Conversations drawn by hypothesis, formatted in one job: all come back, and no control string stands inside a turn."""
    drawn = []

    @settings(max_examples=200, deadline=None, database=None)
    @given(st.lists(st.tuples(NAMES, SAID), min_size=1, max_size=5))
    def draw(turns):
        drawn.append(turns)

    draw()
    df = spark.createDataFrame([(c, i, r, t) for c, turns in enumerate(drawn) for i, (r, t) in enumerate(turns)], "conv_id long, turn long, role string, text string")
    for r in chat.read_back(chat.formatted(chat.conversations(df))).collect():
        turns = drawn[r["conv_id"]]
        assert [tuple(x) for x in r["read"]] == turns
        assert r["formatted"].count("### ") == r["formatted"].count("</turn>") == len(turns)
        assert r["trained"] == "".join(t for role, t in turns if role == "assistant")
        assert [s["loss"] for s in r["segments"]][1::3] == [role == "assistant" for role, _ in turns]


def test_templates_that_cannot_be_read_back_are_refused():
    for wrong in ({"close": " </turn>\n"}, {"mark": "<x>"}, {"open": ""}, {"labels": {"a": "A", "b": "A"}}):
        with pytest.raises(ValueError):
            chat.Template(**wrong)


def test_chat_orders_turns_and_takes_other_templates(spark):
    rows = [(1, 2, "b", "two"), (1, None, "a", "first"), (1, 2, "a", "one"), (1, 2, "b", "two")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    t = chat.Template(open="<|", middle="|>", close="<end>", mark="<end>", labels={}, loss_roles=("b",), transitions={"start": {"a": "start", "b": "start"}}, final=("start",))
    r = chat.read_back(chat.formatted(chat.conversations(df), t), t).first()
    assert r["formatted"] == "<|a|>first<end><|a|>one<end><|b|>two<end><|b|>two<end>" and r["valid"] and r["trained"] == "twotwo"
    assert chat.digests(chat.read_back(chat.formatted(chat.conversations(df.limit(0))))).count() == 0


def scene(rng):
    a = np.full((160, 200), 90.0)
    for _ in range(60):
        y, x, h, w = rng.integers(0, 150), rng.integers(0, 190), rng.integers(5, 40), rng.integers(5, 40)
        a[y : y + h, x : x + w] = rng.integers(0, 255)
    return a


def png(pixels, how):
    """A grey PNG whose lines all use one filter."""
    p = pixels.astype(np.int64)
    left, up = np.pad(p, ((0, 0), (1, 0)))[:, :-1], np.pad(p, ((1, 0), (0, 0)))[:-1]
    corner = np.pad(p, ((1, 0), (1, 0)))[:-1, :-1]
    da, db, dc = abs(up - corner), abs(left - corner), abs(left + up - 2 * corner)
    nearest = np.where((da <= db) & (da <= dc), left, np.where(db <= dc, up, corner))
    lines = ((p - [0 * p, left, up, (left + up) // 2, nearest][how]) & 255).astype(np.uint8)
    data = zlib.compress(np.insert(lines, 0, how, axis=1).tobytes())

    def chunk(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", p.shape[1], p.shape[0], 8, 0, 0, 0, 0)) + chunk(b"IDAT", data) + chunk(b"IEND", b"")


@pytest.mark.parametrize("how", range(5))
def test_png_filters(how):
    pixels = np.random.default_rng(how).integers(0, 256, (9, 13)).astype(np.uint8)
    assert (image_copies.decode(png(pixels, how)) == pixels).all()
    assert (image_copies.decode(image_copies.pgm(pixels)) == pixels).all()


@pytest.mark.parametrize("bad", [None, b"", b"P5", b"P5 9 9 255\nxx", b"\x89PNG\r\n\x1a\nxxxxxxxx", b"GIF89a"])
def test_unreadable_images(bad):
    assert image_copies.decode(bad) is None


def test_copies_are_found_and_others_left_alone(spark):
    rng = np.random.default_rng(2)
    scenes = [scene(rng) for _ in range(14)]
    rows, want = [], {}
    for k, a in enumerate(scenes):
        edits = [a, a, a * 0.7 + 30, np.clip(a + rng.normal(0, 3, a.shape), 0, 255), np.rot90(a)]
        for i, e in enumerate(edits):
            rows.append((100 * k + i, image_copies.pgm(e) if i % 2 else png(np.clip(np.rint(e), 0, 255), 1)))
            want[100 * k + i] = 100 * k
    crops = {100 * k + 50: 100 * k for k in range(14)}
    rows += [(i, image_copies.pgm(scenes[i // 100][8:150, 8:190])) for i in crops]
    rows += [(5000, None), (5001, b""), (5002, image_copies.pgm(np.zeros((40, 40)))), (5003, image_copies.pgm(np.zeros((40, 40)))), (5004, image_copies.pgm(np.ones((2, 2)))), (None, b"x")]
    df = spark.createDataFrame(rows, "media_id long, image binary").withColumns({"node": F.lit(1), "key": F.lit(2)})
    got = {r["media_id"]: r["class_id"] for r in image_copies.copy_classes(df).collect()}
    assert len(got) == len(rows)
    assert {i: got[i] for i in want} == want
    assert sum(got[i] == c for i, c in crops.items()) >= 12 and all(got[i] in (c, i) for i, c in crops.items())
    assert [got[i] for i in (5000, 5001, 5002, 5003, 5004, None)] == [5000, 5001, 5002, 5002, 5004, None]
    assert image_copies.copy_classes(df.limit(0)).count() == 0


def test_previews_of_excerpts_are_crops(spark):
    words = [f"w{i * 7919 % 1000}" for i in range(16 * 20)]
    pages = spark.createDataFrame([(1, f"<p>{' '.join(words)}</p><script>x</script>"), (2, "<!-- c --><b>" + " ".join(words[16 * 3 : 16 * 18]) + "</b>"), (3, None), (4, "<br>")], "media_id long, html string")
    images = image_copies.previews(pages.withColumn("shown", image_copies.page_text(F.col("html"))), "shown")
    got = {r["media_id"]: r["class_id"] for r in image_copies.copy_classes(images).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}


@pytest.mark.parametrize("block", [1500, 96 << 10])
def test_classes_are_those_of_all_pairs(spark, monkeypatch, block):
    """Twelve pictures, 25 cropped and noisy copies of each, and banners that many pictures share, against all pairs."""
    monkeypatch.setattr(image_copies, "BLOCK", block)
    rng = np.random.default_rng(5)
    banner, pixels = scene(rng)[:60, :190], {}
    for k in range(12):
        a = scene(rng)
        for i in range(25):
            top, side = rng.integers(0, 12, 2)
            pixels[100 * k + i] = np.clip(a[top : top + 130, side : side + 180] + rng.normal(0, 2, (130, 180)), 0, 255).round().astype(np.uint8)
    for i in range(40):
        pixels[5000 + i] = np.concatenate([banner[:, :150], scene(rng)[:60, :150]]).round().astype(np.uint8)
    images = spark.createDataFrame([(i, image_copies.pgm(p) if i % 2 else png(p, i % 3)) for i, p in pixels.items()], "media_id long, image binary")
    described, label = {i: image_copies.describe(p) for i, p in pixels.items()}, {i: i for i in pixels}
    links = [(i, j) for i in pixels for j in pixels if i < j and image_copies.agreeing(described[i], described[j], image_copies.AGREE) >= image_copies.AGREE]

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, j in links:
        low, high = sorted((top(i), top(j)))
        label[high] = low
    got = {r["media_id"]: r["class_id"] for r in image_copies.copy_classes(images).collect()}
    assert sum(got[i] == got[j] for i, j in links) >= 0.99 * len(links) and len(links) > 2000
    assert sum(got[i] == top(i) for i in pixels) >= 0.98 * len(pixels)
    assert all(top(got[i]) == top(i) for i in pixels)  # no class joins what no links join


def test_descriptions_do_not_depend_on_what_lies_beside():
    """Pictures of several sizes, some too small for corners, described together and each alone."""
    rng = np.random.default_rng(9)
    images = [scene(rng)[: rng.integers(2, 160), : rng.integers(2, 200)] for _ in range(60)] + [np.full((50, 61), 9.0), scene(rng)[:21, :21], rng.integers(0, 255, (200, 83)).astype(np.uint8)]
    for (corners, bits), image in zip(image_copies.describe_all(images), images, strict=True):
        alone = image_copies.describe(image)
        assert (corners == alone[0]).all() and (bits == alone[1]).all() and len(corners) == len(alone[0])


def test_large_entries_give_rows_in_proportion_and_every_like_pair():
    rng = np.random.default_rng(3)
    base = rng.integers(-(2**31), 2**31, 40).astype(np.int32)
    near = (base[0] ^ (1 << rng.integers(0, 31, 2000))).astype(np.int32)
    for fold in (np.sort(near), np.sort(np.append(base, base)), np.sort(np.concatenate([np.repeat(base[0], 300), base, near[:5]])), np.sort(rng.integers(-(2**31), 2**31, 500).astype(np.int32))):
        node = rng.permutation(len(fold)).astype(np.int64)
        out = pa.Table.from_batches(image_copies._large_entry(7, node, fold), pa.schema([("bucket", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])).to_pylist()
        assert len(out) <= 2 * len(fold)
        met, buckets = {(r["a"], r["b"]) for r in out if r["bucket"] is None}, {}
        for r in out:
            if r["bucket"] is not None:
                buckets.setdefault(r["bucket"], set()).add(r["a"])
        like = np.argwhere(np.bitwise_count(fold[:, None] ^ fold[None]) <= image_copies.HAMMING)
        for i, j in like[like[:, 0] < like[:, 1]].tolist():
            pair = tuple(sorted((node[i], node[j])))
            assert pair in met or any({*pair} <= b for b in buckets.values())


def test_pairs_judged_together_are_those_judged_alone(monkeypatch):
    """Rows whose first transform fails, without corners and of one picture many times; few matches are held at once or all of them."""
    rng = np.random.default_rng(12)
    whole = scene(rng)
    pictures = [image_copies.describe(p) for p in (whole, whole[10:, 20:], np.rot90(whole).copy(), scene(rng), np.zeros((5, 5)))]
    mixed = [(c[order], b[order]) for c, b in pictures for order in (np.arange(len(c)), rng.permutation(len(c)))]
    noisy = [(np.concatenate([c[rng.permutation(len(c))], c]), np.concatenate([b, b])) for c, b in mixed]
    # As they are stored, corners are of 32 bits.
    noisy = [(c.astype(np.float32), b) for c, b in noisy + mixed]
    rows = [(one, two) for one in noisy for two in noisy]
    columns = {c: [f(r[k]) for r in rows] for k, ends in enumerate("ab") for c, f in ((f"c{ends}", lambda r: r[0].T.astype(np.float32).tobytes()), (f"b{ends}", lambda r: r[1].tobytes()))}
    batch = pa.RecordBatch.from_pydict({c: pa.array(v, pa.binary()) for c, v in columns.items()})
    want = [image_copies.agreeing(a, b, image_copies.AGREE) >= image_copies.AGREE for a, b in rows]
    assert 10 < sum(want) < len(rows) - 10
    for cells in (1, 500, 1 << 16):
        monkeypatch.setattr(image_copies, "CELLS", cells)
        assert image_copies.agreeing_rows(batch).tolist() == want
    assert not len(image_copies.agreeing_rows(batch.slice(0, 0)))


def test_runs_of_bounded_cost_hold_every_row():
    assert image_copies._cuts(np.zeros(0, np.int64), 5) == []
    for cost in ([1, 2, 30, 1, 1, 1, 1, 40], [0, 0, 0], [9]):
        cuts = image_copies._cuts(np.array(cost), 5)
        assert [i for a, b in cuts for i in range(a, b)] == list(range(len(cost)))
        assert all(sum(cost[a + 1 : b]) < 5 for a, b in cuts)


def test_pairs_of_many_large_entries_come_in_few_batches():
    rng = np.random.default_rng(13)
    key = np.repeat(np.arange(300), 20)
    fold = np.sort(rng.integers(-(2**31), 2**31, (300, 10)), axis=1).repeat(2, axis=1).ravel()
    entries = pa.RecordBatch.from_arrays([pa.array(key, pa.int32()), pa.array(rng.permutation(len(key)), pa.int64()), pa.array(fold, pa.int32())], names=["key", "node", "fold"])
    out = list(image_copies._meetings([entries]))
    assert sum(b.num_rows for b in out) >= 3000
    assert len(out) <= 2


def test_previews_drawn_together_are_those_drawn_alone():
    words = ["", None, "  ", "one", "é\ud800 two", " ".join(f"w{i}" for i in range(5000)), "one " * 16, "one " * 17]
    together = image_copies._previews(words)
    assert together == [image_copies._preview(w) for w in words]
    page = image_copies.decode(together[6])
    assert page.shape == (5, 80) and (page[:, :5] == page[:, 75:]).all() and (image_copies.decode(together[7])[5:, 5:] == 0).all()


def test_peaks_that_may_lead_hold_the_strongest_of_each_image():
    rng = np.random.default_rng(14)
    of = np.sort(rng.choice([0, 2, 3, 7, 8], 400))
    strength = rng.integers(0, 60, 400).astype(np.float32)
    may = image_copies._may_lead(of, strength, 10)
    order = np.lexsort((-strength, of))
    lead = order[np.arange(400) - np.searchsorted(of, of) < 10]
    assert may[lead].all() and may.sum() < 300


def test_joining_pairs_within_and_across_blocks():
    rng = np.random.default_rng(8)
    base = [image_copies.describe(scene(rng)) for _ in range(4)]
    parts = [base[i % 4] for i in range(12)]
    corners, bits = [c for c, _ in parts], [b for _, b in parts]
    want = {(i, j) for i in range(12) for j in range(i + 1, 12) if image_copies.agreeing(parts[i], parts[j]) >= image_copies.AGREE}
    for within in (True, False):
        left = np.ones(12, bool) if within else np.arange(12) < 5
        found = image_copies._joining(corners, bits, np.arange(12), left, within)
        assert set(found) <= want and len(found) == len({i % 4 for i in range(12)}) * 2


@pytest.mark.parametrize("at", [0, 400, 700, 1100])
def test_crops_of_long_pages_keep_their_corners(at):
    words = [f"w{i}" for i in range(5000)]
    page = image_copies.decode(image_copies._preview(" ".join(words)))
    crop = page[at : at + page.shape[0] // 4]
    assert image_copies.agreeing(image_copies.describe(crop), image_copies.describe(page)) >= image_copies.AGREE


def test_tables_meet_what_the_hamming_bound_admits():
    rng = np.random.default_rng(6)
    flat = rng.integers(0, 2, (2000, 4, 96)).astype(np.uint8)
    edited = flat.copy()
    for corner in edited.reshape(-1, 96):
        corner[rng.choice(96, image_copies.HAMMING, replace=False)] ^= 1
    one, two = (np.packbits(x, axis=2, bitorder="little").view(np.uint32).reshape(-1, 3) for x in (flat, edited))
    met = (image_copies.table_keys(one) == image_copies.table_keys(two)).any(axis=1).reshape(-1, 4).any(axis=1)
    assert met.mean() >= 0.93  # four corners, all of them at the bound


def test_neighbours_within_tight_clusters(spark):
    """Differences within a cluster are below what the codes tell apart, so more of them must be scored exactly; large components too."""
    rng = np.random.default_rng(4)
    x = (rng.standard_normal((4, 32))[rng.integers(0, 4, 1500)] + 1e-4 * rng.standard_normal((1500, 32))) * 1e200
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = additive_ann.nearest(df, F.col("vec_id") % 50 == 0, codebooks=8).collect()
    unit = x / 1e200
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 1500, 50):
        like = unit @ unit[q]
        like[q] = -2
        hits += len(set(np.argsort(-like)[:5].tolist()) & {r["vec_id"] for r in got if r["query_id"] == q})
    assert hits >= 0.9 * 150
