"""Near-duplicate classes, repeated byte strings and connected components against brute force."""

import hashlib
import random
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwork.llm import near_dedup, suffix_dedup
from siftwork.llm.common import shared_dir
from siftwork.llm.components import components
from siftwork.llm.suffix_sort import blind_trie_order, deep_shallow


def shingle_counts(text, k=5):
    w = (text or "").lower().split()
    return Counter(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else Counter()


def brute_classes(rows, similarity=0.8):
    sets = [shingle_counts(t) for _, t in rows]
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                shared = sum((sets[i] & sets[j]).values())
                if shared >= similarity * (sum(sets[i].values()) + sum(sets[j].values()) - shared):
                    up[top(i)] = top(j)
    classes = {}
    for i in range(len(rows)):
        classes.setdefault(top(i), []).append(i)
    out = {}
    for members in classes.values():
        ids = [rows[i][0] for i in members if rows[i][0] is not None]
        for i in members:
            out[i] = min(ids) if ids and sets[i] else rows[i][0]
    return [out[i] for i in range(len(rows))]


def copies(rng, base, edits):
    words = base.split()
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize("most", [1, 2, 9])
def test_signatures_estimate_weighted_jaccard(most):
    rng = np.random.default_rng(most)
    a = {int(k): int(rng.integers(1, most + 1)) for k in rng.integers(0, 2**63, 300)}
    b = {k: int(rng.integers(1, most + 1)) if rng.random() < 0.3 else v for k, v in list(a.items())[60:]}
    b |= {int(k): 1 for k in rng.integers(0, 2**63, 50)}
    shared = sum(min(v, b.get(k, 0)) for k, v in a.items())
    true = shared / (sum(a.values()) + sum(b.values()) - shared)
    items = [(k, i) for i, s in enumerate((a, b)) for k, v in s.items() for _ in range(v)]
    sig = near_dedup.signatures(np.array([x[0] for x in items], np.uint64), np.array([x[1] for x in items]), 2, 6000)
    assert abs((sig[0] == sig[1]).mean() - true) < 0.03


def test_signatures_depend_on_the_multiset_only():
    text = near_dedup.canonical("a b c d e f g " * 9)
    alone = near_dedup.signatures(*near_dedup.shingles([text]), 1)
    among = near_dedup.signatures(*near_dedup.shingles(["x y z", text, ""]), 3)
    assert (alone[0] == among[1]).all() and np.isinf(among[2]).all()


def test_shingles_of_short_texts():
    hashes, owner = near_dedup.shingles(["", "one", "a b c d e", "a b c d e f", "one"])
    assert owner.tolist() == [1, 2, 3, 3, 4]
    assert hashes[0] == hashes[4] and hashes[1] == hashes[2]


def test_near_classes_match_brute_force(spark):
    rng = random.Random(1)
    rows, n = [], 0
    for g in range(25):
        base = " ".join(f"g{g}x{rng.randrange(60)}" for _ in range(rng.choice([3, 8, 60, 200])))
        for _ in range(rng.randrange(1, 7)):
            rows.append((n, copies(rng, base, rng.choice([0, 0, 1, 2]))))
            n += 1
    rows += [(n, None), (n + 1, ""), (n + 2, " \n "), (None, rows[0][1]), (None, "only without an id here"), rows[3], (n + 3, rows[5][1].upper()), (n + 4, "long " * 60000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"node": F.lit(1), "class_id": F.lit(2)})
    got = Counter((r["doc_id"], r["class_id"]) for r in near_dedup.near_classes(df).collect())
    assert got == Counter(zip([r[0] for r in rows], brute_classes(rows), strict=True))


def test_large_group_of_near_copies_around_a_source(spark):
    rng = random.Random(2)
    base = " ".join(f"x{rng.randrange(10**4)}" for _ in range(150))
    rows = [(i + 100, copies(rng, base, rng.choice([1, 2, 3, 4, 6]))) for i in range(260)] + [(7, base)] + [(900 + i, base) for i in range(40)]
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = dict(zip([r[0] for r in rows], brute_classes(rows), strict=True))
    assert sum(got[d] != want[d] for d in want) <= 1  # banding may miss one in some ten thousand


@pytest.mark.parametrize("block", [near_dedup.BLOCK, 1 << 12])
def test_members_of_a_large_bucket_that_are_far_from_its_pivot(spark, monkeypatch, block):
    """A chain of texts, each linked with the next only, and texts near each other but not near the source."""
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rng = random.Random(3)
    words = [f"x{rng.randrange(10**5)}" for _ in range(120)]
    rows = [(i, copies(rng, " ".join(words), rng.choice([1, 3, 5, 7]))) for i in range(60)]
    chain = list(words)
    for i in range(60):
        chain[i * 2] = f"c{i}"
        rows.append((100 + i, " ".join(chain)))
    rows += [(300 + i, copies(rng, " ".join(words[:80] + [f"b{k}" for k in range(40)]), 2)) for i in range(30)]
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == dict(zip([r[0] for r in rows], brute_classes(rows), strict=True))


def test_joining_pairs_are_those_of_brute_force():
    rng = random.Random(4)
    base = [f"x{i}" for i in range(40)] + ["again and again and again"] * 3
    texts = [near_dedup.canonical(copies(rng, " ".join(base), rng.randrange(4))) for _ in range(50)] + ["one", "two words"]
    want = brute_classes(list(enumerate(texts)))
    for left, within in ((np.ones(len(texts), bool), True), (np.arange(len(texts)) < 20, False)):
        found = near_dedup._joining(texts, [bytes([i]) for i in range(len(texts))], left, within, 0.8)
        sets = [shingle_counts(t) for t in texts]
        for i, j in found:
            shared = sum((sets[i] & sets[j]).values())
            assert shared >= 0.8 * (len(texts[i].split()) - 4 + len(texts[j].split()) - 4 - shared) - 1e-9
        if within:
            up = list(range(len(texts)))
            for i, j in found:
                up = [up[i] if u == up[j] else u for u in up]
            assert len(set(up)) == len(set(want)) and all((up[i] == up[j]) == (want[i] == want[j]) for i in range(len(up)) for j in range(i))


def test_one_of_each_keeps_one(spark):
    rows = [(3, "a b c d e f", "x"), (2, "A b c  d e f", "y"), (2, "A b c  d e f", "y"), (9, "something else is in here", "z"), (5, None, "n"), (6, "", "e"), (None, "a b c d e f", "x"), (None, "no id at all here", "w")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = near_dedup.one_of_each(df)
    assert kept.columns == df.columns
    assert sorted(map(str, (tuple(r) for r in kept.collect()))) == sorted(map(str, [rows[1], rows[3], rows[4], rows[5], rows[7]]))
    assert near_dedup.one_of_each(df.limit(0)).count() == 0


def test_clashing_names_and_map_columns_pass(spark):
    """Columns named like inner ones, and maps that hold no nulls, through all stages that keep columns."""
    from siftwork.llm import language_id, quality

    text = "some words that are long enough to be looked at " * 8
    df = spark.createDataFrame([(1, text, "a"), (2, text, "b"), (3, None, "c")], "doc_id long, text string, __node string")
    df = df.withColumns({"__place": F.lit(7), "__row": F.lit(8), "__block": F.lit("q"), "m": F.create_map(F.lit("k"), F.lit(1)), "s": F.struct(F.array(F.lit(1)).alias("x"))})
    for made in (near_dedup.one_of_each(df), suffix_dedup.without_repeats(df)):
        assert made.columns == df.columns
        rows = made.collect()
        assert len(rows) in (2, 3) and all((r["__place"], r["__row"], r["__block"], r["m"], r["s"]["x"]) == (7, 8, "q", {"k": 1}, [1]) and r["__node"] in "abc" for r in rows)
    assert language_id.identify(df, None).count() == quality.score(df, None).count() == 3


def test_components(spark):
    rng = random.Random(5)
    chain = [(i, i + 1) for i in range(40)]
    star = [(100, 100 + i) for i in range(1, 60)]
    noise = [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(80)]
    links = chain + star + noise + [(1, 1), (2, 1), (2, 1)]
    rng.shuffle(links)
    up = {x: x for e in links for x in e}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        x, y = sorted((top(a), top(b)))
        up[y] = x
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[x] == top(x) for e in links for x in e if e[0] != e[1])


def test_blind_trie_orders_and_joins_equal_strings():
    rng = random.Random(6)
    for _ in range(100):
        strings = [bytes(rng.choice(b"ab") for _ in range(9)) for _ in range(rng.randrange(1, 60))]
        order = blind_trie_order(strings)
        assert [strings[i] for same in order for i in same] == sorted(strings)
        assert len(order) == len(set(strings)) and sorted(i for same in order for i in same) == list(range(len(strings)))


@pytest.mark.parametrize("shallow", [8, 32, 200])
def test_deep_shallow_matches_sorting(shallow):
    rng = random.Random(7)
    for n in (0, 1, 2, 150, 400):
        data = np.array([rng.choice(b"abc") for _ in range(n + 60)] + [97] * 60, np.uint8)
        data[40 : 40 + n // 3] = data[: n // 3]
        starts = np.array(rng.sample(range(n + 20), n), np.int64)
        order, classes = deep_shallow(data, starts, 100, shallow)
        strings = [data[s : s + 100].tobytes() for s in starts[order]]
        assert strings == sorted(strings)
        assert classes.tolist() == [sorted(set(strings)).index(s) for s in strings]


def brute_removed(texts, length):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        flags = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                flags[i : i + length] = True
        out.append(flags)
    return out


def suffix_rows(seed):
    rng = random.Random(seed)
    base = "".join(rng.choice("abcdeé 日") for _ in range(4000))
    rows = []
    for i in range(150):
        text = "".join(rng.choice("abc xyz") for _ in range(rng.randrange(300)))
        for _ in range(rng.randrange(4)):
            a = rng.randrange(3600)
            text += base[a : a + rng.randrange(90, 380)] + "".join(rng.choice("xyz") for _ in range(rng.randrange(20)))
        rows.append((i, text))
    rows += [(200, "z" * 650), (201, "z" * 199), (202, "abcd" * 70), (203, None), (204, ""), (205, base), rows[3], (None, rows[4][1]), (None, "z" * 200)]
    return rows


@pytest.mark.parametrize("block", [1 << 13, 1 << 20])
@pytest.mark.parametrize("length", [120, 200])
def test_suffix_dedup_matches_brute_force(spark, monkeypatch, block, length):
    monkeypatch.setattr(suffix_dedup, "BLOCK", block)
    rows = suffix_rows(block + length)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"row": F.lit(1), "block": F.lit("b"), "level": F.lit(0)})
    texts = [(t or "").encode() for _, t in rows]
    want = []
    for (i, _), t, flags in zip(rows, texts, brute_removed(texts, length), strict=True):
        spans = int(np.count_nonzero(np.diff(np.concatenate([[0], flags.astype(int)])) == 1))
        want.append(str((i, len(t), int(flags.sum()), spans, hashlib.sha256(np.frombuffer(t, np.uint8)[~flags].tobytes()).hexdigest())))
    assert sorted(str(tuple(r)) for r in suffix_dedup.digests(df, length).collect()) == sorted(want)


def _prose(seed, n):
    rng = random.Random(seed)
    return "".join(rng.choice("abcdefghij klmnopqrstuvwxyz") for _ in range(n))


#: Tables in which some block, or every one, has nothing left to ask at some level. Most are read with small blocks, so that there are many.
PLAIN_TABLES = {
    "short texts": [(i, _prose(i, 20 + 8 * i)) for i in range(20)],
    "nulls": [(i, None) for i in range(30)],
    "one long text": [(1, _prose(1, 30_000))],
    "one long text among short ones": [(1, _prose(2, 30_000)), *[(2 + i, _prose(9 + i, 50)) for i in range(30)]],
    "copies of one text": [(i, _prose(3, 900)) for i in range(1200)],
    "copies of a periodic text": [(i, "abcdefg" * 90) for i in range(800)],
    "rows alike in everything": [(5, _prose(4, 900))] * 800,
}


@pytest.mark.parametrize("block", [1 << 16, 1 << 20])
@pytest.mark.parametrize("name", PLAIN_TABLES)
def test_suffix_dedup_of_plain_tables(spark, monkeypatch, tmp_path, name, block):
    import corpus_pipeline

    monkeypatch.setattr(suffix_dedup, "BLOCK", block)
    rows = PLAIN_TABLES[name]
    repeats = "copies" in name or "alike" in name
    path = str(tmp_path / "plain")
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(path)
    df = spark.read.parquet(path)
    got = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"]) for r in suffix_dedup.digests(df).collect())
    size = lambda t: len(t or "")
    assert got == Counter((i, size(t), size(t) * repeats, int(repeats)) for i, t in rows)
    left = Counter(tuple(r) for r in corpus_pipeline.cut_repeats(spark, df, "").collect())
    assert left == (Counter() if repeats else Counter(r for r in rows if r[1]))


def test_rows_alike_share_no_block(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK", 1 << 16)
    sizes = []
    real = suffix_dedup._by_block

    def spy(dealt, block_):
        out = real(dealt, block_)
        sizes.extend(r["count"] for r in out.groupBy(block_).count().collect())
        return out

    monkeypatch.setattr(suffix_dedup, "_by_block", spy)
    df = spark.createDataFrame([(5, _prose(4, 900))] * 1000, "doc_id long, text string")
    assert suffix_dedup.digests(df).where("n_removed = 900").count() == 1000
    assert max(sizes) < 3 * (1 << 16) / 900


def test_suffix_dedup_keeps_columns_and_whole_characters(spark):
    passage = "é" * 150
    rows = [(1, "x" + passage + "tail", "a"), (2, "日" + passage + "end", "b"), (3, None, None), (4, "kept as it is", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, block string")
    cut = suffix_dedup.without_repeats(df)
    assert cut.columns == df.columns
    got = {r["doc_id"]: (r["text"], r["block"]) for r in cut.collect()}
    assert got == {1: ("xtail", "a"), 2: ("日end", "b"), 3: (None, None), 4: ("kept as it is", "c")}
    assert suffix_dedup.digests(df.limit(0)).count() == 0


def test_a_cluster_needs_a_shared_folder():
    def session(master: str, folder: str | None) -> SimpleNamespace:
        return SimpleNamespace(sparkContext=SimpleNamespace(master=master, getConf=lambda: {"spark.checkpoint.dir": folder}, getCheckpointDir=lambda: None))

    assert shared_dir(session("spark://host:7077", "hdfs:///scratch")) == "hdfs:///scratch"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(session("spark://host:7077", None))
