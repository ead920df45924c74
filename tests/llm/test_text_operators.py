"""Language ID, quality, BPE, token counts and packing against the tokenizers library, brute force and held-out labels."""

import hashlib
import random
import tracemalloc

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from siftwork.llm import bpe, language_id, packing, quality, runs, token_counts
from siftwork.llm.transducer import Transducer, compile_words
from siftwork.llm.word_bpe import word_bpe

WORD_BPE, BYTE_RANKS = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
HARD = [None, "", " ", "\n\t", "a", "İstanbul ΣΑΣ ÀÉ é", "x<|endoftext|>Y <|startoftext|>", "it's we'LL 'sun 12.5%", "日本語 ☃ 😀 ﬁ ①²½ ٣", "\x1c\x85  a b", "Ǆ ǅ ẞ ß", "w" * 5000, "x" * 7 + "xy" * 3000, "ab " * 20000, "!" * 300]
DOCS = "doc_id long, text string, lang string, score string, ids string, row string"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", "i", "r") for i, t in enumerate(texts)] + [(None, "no id", None, None, None, None), (1, "", "en", "s", "i", "r")], DOCS)


def encoded(texts):
    ids, sizes = bpe.Encoder(word_bpe(WORD_BPE)).encode(texts)
    return [part.tolist() for part in np.split(ids, np.cumsum(sizes)[:-1])]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(WORD_BPE)


def test_words_and_merges_equal_the_library(library, spark, sf):
    texts = [t or "" for t in HARD] + [r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    for text, ids in zip(texts, encoded(texts), strict=True):
        assert ids == library.encode(text, add_special_tokens=False).ids, text[:50]


def test_every_usual_character_equals_the_library(library):
    # The capitals beyond PIECES' letters too, whether or not they are admitted.
    texts = [t for c in map(chr, range(0x250)) for t in (c, f"a{c}b", f"{c}liyev", f"A {c}{c}1")]
    for text, ids in zip(texts, encoded(texts), strict=True):
        assert ids == library.encode(text, add_special_tokens=False).ids, ascii(text)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_any_text_equals_the_library(text):
    library = Tokenizer.from_file(WORD_BPE)
    assert encoded([text, None, "and", text]) == [library.encode(t, add_special_tokens=False).ids for t in (text, "", "and", text)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text("ab'strevlmd0 9.,-éÀ\nß<|>SRx€İ", max_size=20)), max_size=5))
def test_pieces_of_many_texts_equal_those_of_one(texts):
    own = word_bpe(WORD_BPE)
    words, number, sizes = own.numbered(texts)
    assert len(set(words)) == len(words)
    assert [[words[i] for i in part] for part in np.split(number, np.cumsum(sizes)[:-1])][: len(texts)] == [own.words(t or "") for t in texts]


def test_words_of_one_hash_are_told_apart(monkeypatch):
    units, _ = runs.code_points(["one two one three two"])
    starts, ends = np.array([0, 4, 8, 12, 18]), np.array([3, 7, 11, 17, 21])
    monkeypatch.setattr(runs.ByteHash, "slices", lambda self, a, b: np.zeros(len(a), np.uint64))
    first, number = runs.distinct(units, starts, ends)
    assert [runs.as_text(units[starts[i] : ends[i]]) for i in first[number]] == ["one", "two", "one", "three", "two"]


@settings(max_examples=60, deadline=None)
@given(words=st.dictionaries(st.text("abcé☃", min_size=1, max_size=6), st.lists(st.integers(0, 99), max_size=3).map(lambda x: np.array(x, np.int32).tobytes()), max_size=40), others=st.lists(st.text("abcé☃", max_size=7), max_size=40))
def test_transducer_finds_exactly_its_words(words, others, tmp_path_factory):
    path = tmp_path_factory.mktemp("lexicon") / "x.bin"
    path.write_bytes(compile_words(words))
    asked = [*words, *others]
    assert Transducer(str(path)).find(asked) == [words.get(w) for w in asked]


def test_transducer_shares_suffixes(tmp_path):
    path = tmp_path / "x.bin"
    path.write_bytes(compile_words({f"{a}{b}ation": bytes(4) for a in "abcdefgh" for b in "xyz"}))
    lexicon = Transducer(str(path))
    assert len(lexicon) == 24 and len(lexicon.final) == 8  # start, one after the first letter, one for each letter of the suffix


def test_bpe_digests_with_and_without_lexicon(spark, library):
    df = frame(spark, HARD)
    want = {}
    for i, t in [*enumerate(HARD), (None, "no id")]:
        ids = library.encode(t or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False) if ids else ""
        want[i] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
    for lexicon in (None, bpe.compile_lexicon(df, WORD_BPE, max_words=3)):
        rows = bpe.digests(df, WORD_BPE, lexicon).collect()
        assert len(rows) == len(HARD) + 2
        assert all(tuple(r)[1:] == want[r["doc_id"]] for r in rows)


def test_bpe_round_trip_keeps_columns(spark, library):
    back = bpe.decode(bpe.encode(frame(spark, HARD), WORD_BPE), WORD_BPE)
    assert back.columns == ["doc_id", "text", "lang", "score", "row", "ids", "decoded"]
    for r in back.collect():
        assert r["decoded"] == (library.decode(r["ids"], skip_special_tokens=False) if r["ids"] else "")
    assert bpe.digests(frame(spark, HARD).limit(0), WORD_BPE, None).count() == 0


def brute_sections(text, rule):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    parts = text.splitlines(keepends=True) if "\r" not in text else None
    parts = [p for p in text.replace("\n", "\n\0").split("\0") if p]
    bounds, at = [], 0
    for p in parts:
        bounds.append((at, at + len(p)))
        at += len(p)
    count, crossed = [0.0] * len(parts), [0] * len(parts)
    for a, b in t.encode(text, add_special_tokens=False).offsets:
        share = [max(0, min(b, y) - max(a, x)) for x, y in bounds]
        hit = [i for i, s in enumerate(share) if s]
        for i in hit if len(hit) > 1 else []:
            crossed[i] += 1
        if rule == "split":
            for i in hit:
                count[i] += share[i] / sum(share)
        else:
            count[{"first": hit[0], "last": hit[-1], "most": share.index(max(share))}[rule]] += 1
    return [(i, *bounds[i], pytest.approx(count[i]), crossed[i]) for i in range(len(parts))]


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_token_attribution(spark, sf, rule):
    texts = [t for t in HARD if t and len(t) < 6000] + ["a\n\n\nb  \n\n c\n", "\n\n\n", "日本\n語\n\n☃"]
    texts += [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").limit(20).collect()]
    df = spark.createDataFrame(list(enumerate([*texts, None, ""])), "doc_id long, text string")
    got = token_counts.attribute(df.withColumn("parts", token_counts.by_lines(F.col("text"))), BYTE_RANKS, rule).collect()
    by_doc = {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(tuple(r)[1:])
    for i, text in enumerate(texts):
        assert sorted(by_doc.get(i, [])) == brute_sections(text, rule), (rule, text[:40])
    assert len(texts) not in by_doc and len(texts) + 1 not in by_doc


def test_token_attribution_of_fields(spark):
    df = token_counts.from_fields(spark.createDataFrame([(1, "A title", None, "Some body")], "doc_id long, title string, note string, body string"), ["title", "note", "body"])
    rows = token_counts.attribute(df, BYTE_RANKS, "split").orderBy("section").collect()
    assert [(r["start"], r["end"]) for r in rows] == [(0, 8), (8, 9), (9, 18)]
    assert sum(r["n_tokens"] for r in rows) == pytest.approx(len(Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode("A title\n\nSome body").ids))


def check_packing(rows, texts, library):
    ids = [[*library.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]
    left = {}
    for i in ids:
        left[tuple(i)] = left.get(tuple(i), 0) + 1
    sequences = {}
    pieces = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        pieces.setdefault(r["doc_id"], []).append((r["start"], np.frombuffer(bytes(r["ids"]), np.uint32).tolist()))
    padding = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= packing.WINDOW
        padding += 0 if at & (at - 1) == 0 else packing.WINDOW - at
    assert padding == 0
    assert sum(r["length"] for r in rows) == sum(map(len, ids))
    return pieces, ids


def test_packing_is_exact(spark, library, sf):
    texts = [*HARD, *[r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({"ids": F.lit("x"), "near": F.lit(1)})
    pieces, ids = check_packing(packing.pack(df, WORD_BPE).collect(), texts, library)
    for i, want in enumerate(ids):
        joined, at = [], 0
        for start, part in sorted(pieces[i]):
            assert start == at
            joined += part
            at += len(part)
        assert joined == want


def test_packing_edge_tables(spark, library):
    schema = "doc_id long, text string"
    assert packing.pack(spark.createDataFrame([], schema), WORD_BPE).count() == 0
    repeated = [(1, "a b c")] * 5 + [(None, None), (2, "")]
    check_packing(packing.pack(spark.createDataFrame(repeated, schema), WORD_BPE).collect(), [t for _, t in repeated], library)


def test_documents_of_a_topic_meet_in_a_shard(spark):
    rng = np.random.default_rng(3)
    common = [f"{a}{b}" for a in "abcdefgh" for b in "klmnopqr"]
    docs = [(i, " ".join([*rng.choice(common, 150), *[f"topic{i % 40}x"] * 5, *rng.choice(common, 150)])) for i in range(400)]
    rows = packing.tokenised(spark.createDataFrame(docs, "doc_id long, text string"), WORD_BPE, 2)
    order = [r["doc_id"] % 40 for r in packing.ordered(rows, packing.rarity(rows)[0]).orderBy("near", "doc_id").collect()]
    beside = sum(a == b for a, b in zip(order, order[1:], strict=False)) / len(order)
    assert beside >= 0.15  # 0.025 by chance
    text = packing.pack(spark.createDataFrame(docs, "doc_id long, text string"), WORD_BPE)._jdf.queryExecution().toString()
    assert "Sort [near" in text


def test_bm25_scores_equal_the_formula():
    rng = np.random.default_rng(9)
    docs = [rng.integers(0, 30, rng.integers(1, 40)).astype(np.uint32) for _ in range(25)]
    index, mean = packing.Bm25(docs), np.mean([len(d) for d in docs])
    for q, asked in enumerate(docs):
        want = np.zeros(len(docs))
        for term in set(asked.tolist()):
            df = sum(term in d for d in docs)
            for i, d in enumerate(docs):
                tf = int((d == term).sum())
                want[i] += np.log(1 + (len(docs) - df + 0.5) / (df + 0.5)) * tf * (packing.K1 + 1) / (tf + packing.K1 * (1 - packing.B + packing.B * len(d) / mean))
        assert np.allclose(index.scores(q), want)


def test_rarity_counts_documents_and_order_takes_the_two_least_tokens(spark, monkeypatch):
    monkeypatch.setattr(packing, "MARKED", 3)
    rng = np.random.default_rng(1)
    docs = [np.append(rng.integers(3, 40, rng.integers(0, 30)), 2).astype(np.uint32) for _ in range(50)]
    rows = spark.createDataFrame([(i, bytearray(d.tobytes())) for i, d in enumerate(docs)], "doc_id long, ids binary")
    weight, total = packing.rarity(rows)
    held = [set(d[:-1].tolist()) for d in docs]
    df = [sum(t in h for h in held) for t in range(len(weight))]
    assert total == sum(map(len, docs)) and np.allclose(weight, [np.log(50 / n) if n > 1 else 0 for n in df])
    near = {r["doc_id"]: r["near"] for r in packing.ordered(rows, weight).collect()}
    token = packing.mix(np.arange(1, len(weight) + 1, dtype=np.uint64))
    time = [-np.log(((int(h) >> 12) + 0.5) / 2.0**52) / w if w > 0 else np.inf for h, w in zip(token, weight, strict=True)]
    name = (packing.mix(token ^ np.uint64(1)) >> np.uint64(33)).astype(int).tolist()
    for i, h in enumerate(held):
        first = [name[t] for t in sorted(h, key=lambda t: (time[t], t)) if np.isfinite(time[t])][:2] + [0, 0]
        assert near[i] == first[0] << 31 | first[1]


def test_packing_does_not_depend_on_the_order_of_rows(spark, monkeypatch):
    """Many shards in a range, two orders of arrival: the same pieces in the same sequences."""
    monkeypatch.setattr(packing, "SHARD", 1500)
    rng = np.random.default_rng(2)
    docs = [(i, " ".join(rng.choice(["red", "green", "blue", "ochre", "teal"], 90)) + f" w{i % 20}") for i in range(300)]
    packed = [spark.createDataFrame(d, "doc_id long, text string").repartition(n) for d, n in ((docs, 16), (docs[::-1], 5))]
    one, two = ({(r["doc_id"], r["start"], r["length"], r["sequence_id"], r["offset"]) for r in packing.pack(d, WORD_BPE, window=256).collect()} for d in packed)
    assert one == two and len(one) >= 300


def test_common_terms_are_scored():
    docs = [np.array([1, 2, 10 + i], np.uint32) for i in range(4)] + [np.array([3, 30 + i, 50 + i], np.uint32) for i in range(6)]
    assert np.flatnonzero(packing.Bm25(docs).scores(0)).tolist() == [0, 1, 2, 3]


def test_bm25_prefers_documents_that_share_rare_terms():
    rng = np.random.default_rng(0)
    docs = [np.concatenate([rng.integers(0, 50, 200), 1000 + 100 * (i % 12) + rng.integers(0, 60, 100)]).astype(np.uint32) for i in range(60)]
    index = packing.Bm25(docs)
    for seed in range(12):
        score = index.scores(seed)
        score[seed] = -1
        assert all(i % 12 == seed for i in np.argsort(-score)[:4])
    sequences = packing.pack_shard(docs, window=1024)
    same = [len({i % 12 for i, _, _ in s}) == 1 for s in sequences if sum(p[2] for p in s) == 1024]
    assert sum(same) >= len(same) / 2


def test_language_id_on_held_out_rows(spark, sf):
    from siftwork.llm.common import held_out

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = language_id.fit(docs.where(~held_out()))
    rows = language_id.identify(docs.where(held_out()), model).collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_id_backs_off_to_shorter_grams(spark):
    docs = spark.createDataFrame([(1, "der hund und die katze " * 5, "de"), (2, "the dog and the cat sat " * 5, "en"), (3, None, "en"), (4, "xx", None)], "doc_id long, text string, lang string")
    model = language_id.fit(docs)
    assert model.languages == ["de", "en"] and model.words.find(language_id.term_hashes(["hund", "xx"]))[0] >= 0 > model.words.find(language_id.term_hashes(["xx"]))[0]
    unseen = spark.createDataFrame([(0, "hunde"), (1, "dogs"), (2, None), (3, ""), (4, "12 !?"), (7, "² ½"), (5, "и"), (6, "the " * 90000)], "score long, text string")
    got = {r["text"][:5] if r["text"] else r["text"]: (r["lang_pred"], r["score"]) for r in language_id.identify(unseen, model).collect()}
    assert got["hunde"][0] == "de" and got["dogs"][0] == "en" and got["the t"][0] == "en"
    assert got[None] == got[""] == got["12 !?"] == got["² ½"] == ("und", 0.0)
    assert got["и"][1] == pytest.approx(0.5)  # nothing known: all languages alike
    assert {r["lang_pred"] for r in language_id.identify(unseen, language_id.fit(docs.limit(0))).collect()} == {"und"}


def test_language_id_equals_plain_counting(spark):
    """Log frequencies and backoff by dictionaries, word by word."""
    train = [("de", "der Hund und die Katze, der Hund schläft Æ"), ("en", "the dog and the cat the dog sleeps"), ("fr", "le chien et le chat dorment ici dogue"), ("en", "cats and dogs")]
    docs = spark.createDataFrame([(i, t, lang, "x") for i, (lang, t) in enumerate(train)], "doc_id long, text string, lang string, score string")
    langs = ["de", "en", "fr"]

    def logs(terms):
        table = {}
        for lang, term in terms:
            table.setdefault(term, [0, 0, 0])[langs.index(lang)] += 1
        total = [sum(row[k] for row in table.values()) for k in range(3)]
        return {t: np.log([(row[k] + 0.5) / (total[k] + 0.5 * len(table)) for k in range(3)]) for t, row in table.items()}

    def split(text):
        return language_id.WORD.findall(text.lower())

    seen = [(lang, w) for lang, t in train for w in split(t)]
    words = logs(seen)
    grams = {order: logs([(lang, g) for lang, w in seen for g in language_id.grams(w, order)]) for order in language_id.ORDERS}

    def score(word):
        if word in words:
            return words[word]
        for order in language_id.ORDERS:
            rows = [grams[order][g] for g in language_id.grams(word, order) if g in grams[order]]
            if rows:
                return np.mean(rows, axis=0) * min(4, len(word)) / order
        return np.zeros(3)

    asked = ["Hunde katzen", "dogged cat", "chienne", "z qq æ dog", "x", "unbekannt " * 50, "²", "a1b_c", "ΣΑΣ İ dog", "the der le"]
    table = spark.createDataFrame([(i, t) for i, t in enumerate(asked)], "doc_id long, text string")
    got = {r["text"]: (r["lang_pred"], r["score"]) for r in language_id.identify(table, language_id.fit(docs)).collect()}
    for text in asked:
        total = np.sum([score(w) for w in split(text)], axis=0) if any(c.isalpha() for c in text) else None
        if total is None:
            assert got[text] == ("und", 0.0)
            continue
        posterior = np.exp(total - total.max()) / np.exp(total - total.max()).sum()
        assert got[text] == (langs[int(total.argmax())], pytest.approx(posterior.max(), abs=1e-5)), text


def test_language_id_learns_from_few_rows_and_from_many_copies(spark):
    rows = [(i, "the dog sat", "en") for i in range(3000)] + [(5, "the cat sat", "en")] * 300 + [(9000, "der hund", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(docs, max_docs=10)
    assert model.languages == ["de", "en"]
    assert [r["lang_pred"] for r in language_id.identify(docs.limit(1).selectExpr("'hund' AS text"), model).collect()] == ["de"]


def test_class_prior_comes_from_positives_and_unlabelled():
    rng = np.random.default_rng(5)
    for share in (0.25, 0.6):
        labels = rng.random(4000) < share
        cloud = lambda good: np.where(good[:, None], 1.6, -1.6) + rng.normal(size=(len(good), 3))
        found = quality.class_prior(cloud(np.ones(2000, bool)), cloud(labels))
        assert abs(found - share) < 0.08, (share, found)


def test_quality_on_held_out_rows(spark):
    from siftwork.llm.common import held_out

    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.fit(docs.where(~held_out()), labels.where(~held_out()))
    rows = quality.score(docs.where(held_out()), model).join(labels, "doc_id").collect()
    assert np.mean([r["quality"] == r["predicted"] for r in rows]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_quality_needs_no_negative_labels():
    rng = np.random.default_rng(4)
    good, bad = rng.normal(1, 1, (600, 8)), rng.normal(-1, 1, (400, 8))
    model = quality.fit_pu(good[:300], np.concatenate([good[300:], bad]), prior=300 / 700, steps=300)
    assert model.scores(good).mean() > 0.8 and model.scores(bad).mean() < 0.2


def test_packing_is_the_same_with_wide_ids(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = lambda: sorted(tuple(bytes(x) if isinstance(x, bytearray) else x for x in r) for r in packing.pack(docs, WORD_BPE).collect())
    assert packing.narrowest(WORD_BPE, 2) is np.uint16 and packing.narrowest(WORD_BPE, 1 << 16) is np.uint32
    narrow = rows()
    monkeypatch.setattr(packing, "narrowest", lambda *_: np.uint32)
    assert rows() == narrow


def plain_pu(positive, unlabelled, prior, steps, units=16, decay=2e-4, seed=7):
    """The non-negative risk and its gradient sample by sample, as the method states them; returns the score of a row of features."""
    rng = np.random.default_rng(seed)
    both = np.concatenate([positive, unlabelled])
    mean, scale = both.mean(axis=0), both.std(axis=0) + 1e-3
    params = [rng.normal(0, 1 / np.sqrt(both.shape[1]), (both.shape[1], units)), np.zeros(units), rng.normal(0, 0.3, units), np.zeros(1)]
    first, second = ([np.zeros_like(x) for x in params] for _ in range(2))

    def forward(row):
        x = (row - mean) / scale
        h = np.tanh(params[0].T @ x + params[1])
        return x, h, float(params[2] @ h + params[3][0])

    def mean_loss(rows, sign):
        """Of log(1 + exp(-sign * z)), with its gradient."""
        loss, grads = 0.0, [np.zeros_like(x) for x in params]
        for row in rows:
            x, h, z = forward(row)
            loss += np.log1p(np.exp(-sign * z))
            dz = -sign / (1 + np.exp(sign * z))
            dh = dz * params[2] * (1 - h * h)
            for g, d in zip(grads, (x[:, None] * dh[None, :], dh, dz * h, np.array([dz])), strict=True):
                g += d
        return loss / len(rows), [g / len(rows) for g in grads]

    for step in range(1, steps + 1):
        _, as_pos = mean_loss(positive, 1)
        pos_neg, pos_neg_grad = mean_loss(positive, -1)
        unl_neg, unl_neg_grad = mean_loss(unlabelled, -1)
        negative = unl_neg - prior * pos_neg
        for i in range(4):
            g = unl_neg_grad[i] - prior * pos_neg_grad[i]
            g = -g if negative < 0 else prior * as_pos[i] + g
            g = g + decay * params[i]
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.999 * second[i] + 0.001 * g * g
            params[i] = params[i] - 0.01 * first[i] / (1 - 0.9**step) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    return lambda row: 1 / (1 + np.exp(-forward(row)[2]))


@pytest.mark.parametrize("prior", [0.2, 0.5, 0.9])
def test_quality_fit_equals_plain_risk_and_gradient(prior):
    """With the largest prior the estimated risk of negatives falls below zero, so the ascent is met too."""
    rng = np.random.default_rng(3)
    positive, unlabelled = rng.normal(1, 1, (14, 5)), np.concatenate([rng.normal(1, 1, (10, 5)), rng.normal(-1, 1, (10, 5))])
    got = quality.fit_pu(positive, unlabelled, prior, steps=120).scores(unlabelled)
    want = [plain_pu_score(row) for plain_pu_score in [plain_pu(positive, unlabelled, prior, 120)] for row in unlabelled]
    assert np.abs(got - want).max() < 1e-6


def test_quality_query_equals_a_plain_version(spark):
    """The whole operator on a few documents: which rows teach, the prior, the fit and every score."""
    rng = np.random.default_rng(5)
    good, bad = "Sensible words make up this sentence, and it ends well. ", "BUY now!!! $$$ 100 % click >>> "
    rows = [(i, (good if i % 3 else bad) * int(rng.integers(1, 6)) + str(i)) for i in range(40)] + [(100, ""), (101, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(0, 40, 2)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    got = {r["doc_id"]: (r["score"], r["predicted"]) for r in quality.score(docs, model).collect()}
    texts = {i: t for i, t in rows if t is not None}
    x = {i: quality.features([t]).astype(np.float32).astype(float)[0] for i, t in texts.items()}
    order = lambda salt, ids: [r["doc_id"] for r in docs.where(F.col("doc_id").isin(ids)).orderBy(F.xxhash64(F.lit(salt), "doc_id", "text")).collect()]
    positive = np.array([x[i] for i in order(1, [i for i in range(0, 40, 2) if i % 3])])
    unlabelled = np.array([x[i] for i in order(2, list(texts))])
    assert model.prior == quality.class_prior(positive, unlabelled)
    plain = plain_pu(positive, unlabelled, model.prior, 600)
    for i, t in rows:
        want = plain(quality.features([t])[0])
        assert abs(got[i][0] - want) < 1e-3 and got[i][1] == int(got[i][0] >= 0.3)


def test_quality_edges(spark):
    docs = frame(spark, HARD)
    labels = spark.createDataFrame([(4, 1, 0), (4, 0, 0), (5, 1, 0), (6, 0, None), (7, None, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    for model in (quality.fit(docs, labels), quality.fit(docs, labels.limit(0)), quality.fit(docs.limit(0), labels)):
        rows = quality.score(docs, model).collect()
        assert len(rows) == len(HARD) + 2
        assert all(r["score"] is not None and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    assert quality.score(docs.limit(0), None).count() == 0


def test_pack_shard_covers_every_token():
    rng = random.Random(3)
    for _ in range(30):
        docs = [np.array([rng.randint(0, 30) for _ in range(rng.choice([1, 1, 5, 50, 200]))], np.uint32) for _ in range(rng.randint(1, 40))]
        seen = [np.zeros(len(d), int) for d in docs]
        for sequence in packing.pack_shard(docs, window=64):
            for i, s, n in sequence:
                seen[i][s : s + n] += 1
        assert all((s == 1).all() for s in seen)


def test_the_terms_of_a_model_are_hashed_in_little_memory():
    terms = [f"{i:x}é" * (1 + i % 3) for i in range(120_000)] + ["", "é"]
    tracemalloc.start()
    hashed = language_id.term_hashes(terms)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 20 << 20
    some = range(0, len(terms), 997)
    assert [hashed[i] for i in some] == [language_id.term_hashes([terms[i]])[0] for i in some]
    assert len(language_id.term_hashes([])) == 0
