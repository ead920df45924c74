"""Source audit, lexical search and HTML extraction against plain counting and expected texts."""

import html
import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from siftwork.llm import html_text, lexical_search, source_audit
from siftwork.llm.queries import ORACLES

DOCS = "doc_id long, text string, lang string, source string, term string, block int, n int"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def found(text, also=""):
    return re.findall(rf"[a-z{also}\u0080-\U0010ffff]+", (text or "").translate(LOWER))


def plain_audit(rows, least):
    """The same by dictionaries, straight from the definition."""
    count, held, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        words = found(text)
        count[lang, source].update(words)
        held[lang].update(set(words))
    out = []
    for lang, sources in groups.items():
        kept = sorted((w for w, n in held[lang].items() if n >= least), key=lambda w: w.encode())
        v = len(kept)
        p = lambda c: {w: 1 + 10**9 * (c[w] + 5) // (sum(c[x] for x in kept) + 5 * v) for w in kept}  # noqa: B023, E731
        own = {s: p(count[lang, s]) for s in sources}
        whole = p(sum((count[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [(o, sum(abs(own[s][w] - own[o][w]) for w in kept)) for o in sources if o != s]
            terms = [(w, own[s][w] - whole[w]) for w in kept if count[lang, s][w] and own[s][w] > whole[w]]
            for part, items, most in (("pair", pairs, None), ("term", terms, 50)):
                for rank, (item, value) in enumerate(sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most], 1):
                    out.append((lang, s, part, item, value, rank))
    return sorted(out)


def audited(spark, rows, least):
    df = spark.createDataFrame([(i, t, la, s, "x", 1, 2) for i, t, la, s in rows], DOCS)
    return sorted(tuple(r) for r in source_audit.audit(df, least).collect())


def random_docs(n, seed=0):
    rng = random.Random(seed)
    words = ["the", "The", "été", "naïve", "İx", "b2b", "zz", "中文", "\U0001f600", *[f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)]]
    texts = [" ".join(rng.choices(words, k=rng.choice([0, 3, 20, 60]))) for _ in range(n)]
    rows = [(i, t, rng.choice(["en", "de", None, ""]), rng.choice(["a", "b", "ü", None, "c"])) for i, t in enumerate(texts)]
    return rows + [(1, None, "en", "a"), (1, "", "xx", "only"), (2, rows[2][1], *rows[2][2:]), (None, "the, the. THE-the", "en", "a"), (3, "x" * 300_000 + " the", "en", "b")]


@pytest.mark.parametrize("least", [1, 5, 30, 10_000])
def test_audit_equals_plain_counting(spark, least, monkeypatch):
    rows = random_docs(400, least)
    assert audited(spark, rows, least) == plain_audit(rows, least)


def test_audit_in_small_parts(spark, monkeypatch):
    """Runs cut by batches and held parts, several chunks of terms, several blocks of sources."""
    rows = random_docs(300, 7)
    for name, value in {"HELD": 3000, "CHUNK": 40, "SOURCES": 2, "CELLS": 30}.items():
        monkeypatch.setattr(source_audit, name, value)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert audited(spark, rows, 20) == plain_audit(rows, 20)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_audit_of_tables_without_terms(spark):
    assert audited(spark, [], 1) == []
    assert audited(spark, [(1, None, None, None), (2, "12 34", None, "b")], 1) == [("", "", "pair", "b", 0, 1), ("", "b", "pair", "", 0, 1)]


def test_share_is_exact_beyond_63_bits():
    import numpy as np

    for c, t, v in [(10**13, 10**15, 10**6), (0, 0, 1), (9 * 10**14, 10**15, 3), (7, 7, 1), (123456789012, 987654321098765, 1000)]:
        assert source_audit.share(np.array([c]), np.int64(t), v)[0] == 1 + 10**9 * (c + 5) // (t + 5 * v)


def plain_search(docs, items, top):
    own = [(i, Counter(found(t, "0-9"))) for i, t in docs]
    own = [(i, c) for i, c in own if c]
    n, total = len(own), sum(sum(c.values()) for _, c in own)
    df = Counter(w for _, c in own for w in c)
    out = []
    for item, text in items:
        asked = {w for w in found(text, "0-9") if df[w]}
        scored = []
        for i, c in own:
            m = 50 + 50 * sum(c.values()) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 20 * m)) for w in asked if c[w])
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out, key=str)


def searched(spark, docs, items, top, **more):
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, rank string, item int").repartition(3)
    q = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    return sorted((tuple(r) for r in lexical_search.search(lexical_search.build(d), q, top, **more).collect()), key=str)


@pytest.mark.parametrize(("blocks", "first", "at_once"), [(256, 4, 2048), (5, 1, 3), (1, 2, 2048)])
def test_search_equals_a_scan(spark, monkeypatch, blocks, first, at_once):
    monkeypatch.setattr(lexical_search, "BLOCK_DOCS", blocks)
    monkeypatch.setattr(lexical_search, "FIRST", first)
    docs = [(i, t) for i, t, _, _ in random_docs(200, blocks)]
    docs += [(900 + i, "wab wac wad") for i in range(20)] + [(900, "wab wac wad")]  # ties, and an id twice
    items = [(1, "wab WAC the, été b2b"), (2, "absent words"), (3, None), (4, "the the the"), (5, "wab wac wad wae waf wag wah"), (6, " ".join(t for _, t in docs[:30] if t)), (None, "zz")]
    assert searched(spark, docs, items, 7, at_once=at_once) == plain_search(docs, items, 7)


def test_search_edges(spark):
    assert searched(spark, [], [(1, "a")], 5) == []
    assert searched(spark, [(1, "a b"), (2, None), (3, "- -")], [], 5) == []
    assert searched(spark, [(1, None), (2, "--")], [(1, "a")], 5) == []
    long = "lorem ipsum " * 200_000 + "needle"
    assert [r[2] for r in searched(spark, [(1, long), (2, "needle x"), (3, "y z"), (4, "q")], [(1, "needle")], 5)] == [2, 1]


def test_bounds_prune(spark, monkeypatch):
    """Blocks that a query cannot rise in are passed over: forty blocks, of which all but the best few stay below its threshold."""
    monkeypatch.setattr(lexical_search, "BLOCK_DOCS", 10)
    asked = []
    real = lexical_search._bounds

    def spy(queries, most, least, done):
        asked.append((queries, most, least, done))
        return real(queries, most, least, done)

    monkeypatch.setattr(lexical_search, "_bounds", spy)
    docs = [(i, "gold gold gold" if i < 20 else "gold " + "lead " * 500) for i in range(400)]
    assert [r[2] for r in searched(spark, docs, [(1, "gold")], 5)] == [0, 1, 2, 3, 4]
    queries, most, least, done = asked[-1]
    assert most is None and least[0] > 0 and len(done) == lexical_search.FIRST
    index = lexical_search.build(spark.createDataFrame(docs, "doc_id long, text string"))
    wanted = index.maxima.mapInArrow(real(queries, None, least, {}), "block long, item int, bound long")
    assert index.maxima.count() >= 40 > 6 >= wanted.count() > 0


@pytest.mark.parametrize("name", ["op11_source_audit", "op12_lexical_search"])
def test_queries_equal_their_sql(spark, sf, name):
    from siftwork.llm.queries import QUERIES

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    cursor = con.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    df = QUERIES[name](spark, sf)
    assert sorted(df.columns) == sorted(names)
    assert sorted(tuple(r[c] for c in names) for r in df.collect()) == sorted(cursor.fetchall())


def test_every_test_page_gives_its_article(spark, sf):
    """Independent of the operator: the text between the article's tags, blocks parted by spaces, inline tags by nothing."""
    rows = html_text.extract(spark.read.parquet(f"{sf}/pages.parquet")).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/pages.parquet").count()
    for r in rows:
        inner = re.search("<article>(.*?)</article>", r["html"], re.S)[1]
        want = " ".join(html.unescape(re.sub("<[^>]*>", " ", re.sub("</?b>", "", inner))).split())
        assert (r["text"], r["n_chars"]) == (want, len(want))


P, Q = "<p>" + "plain words of prose, " * 12 + "</p>", "<p>" + "more of the same text. " * 9 + "</p>"
PROSE = " ".join(re.sub("<[^>]*>", "", P + " " + Q).split())


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("<html></html>", ""),
        ("just text &amp; no tags", "just text & no tags"),
        (f"<body><nav>menu</nav><div id=main>{P}{Q}</div><footer>foot</footer></body>", PROSE),
        (f"<body><header><h1>Site</h1></header><div class='content'><div>{P}{Q}</div></div><div class='sidebar'>{P}</div></body>", PROSE),
        (f"<body><div class='cookie-notice'>{Q}</div><div>{P}{Q}</div><div id='comments'>{P}{P}</div></body>", PROSE),
        (f"<body><div class='with-sidebar'>{P}{Q}</div><aside>{P}</aside><form>{P}<input></form></body>", PROSE),
        (f"<body><ul>{'<li><a href=x>some link text</a></li>' * 30}</ul><div>{P}{Q}</div></body>", PROSE),
        (f"<article><header><h1>Title</h1></header>{P}{Q}<section class=comments>{P}</section></article>", "Title " + PROSE),
        (f"<body><article><h1>A</h1></article><div class=ad>{P}{P}</div></body>", "A"),
        (f"<article><p><b>unclosed<p>next</article><footer>{P}</footer>", "unclosed next"),
        ("<article><p>a&nbsp;b\n\tc<br>d<i>e</i>f</p>loose<p>&lt;p&gt; &#233; &copy;</p></article>", "a b c def loose <p> é ©"),
        ("<article><table><tr><td>1<td>2<tr><td>3</table><ul><li>x<li>y</ul></article>", "1 2 3 x y"),
        ("<!-- <article>no</article> --><article><script>'<p>no</p>'</script><style>p{}</style>yes</article><!-- open", "yes"),
        ("<article>kept<div style='display:none'>gone</div><span class='ad'>gone</span> too</article> <b", "kept too"),
        ("<article>a < b and 3 > 2</article>", "a < b and 3 > 2"),
        (f"<article>{P}{Q}<section id=comments><article class=comment>{P}</article></section></article>", PROSE),
        (f"<article>{Q}</article><div id='comments'><article>{P}{P}{P}</article></div><article class='comment odd'>{P}{P}{P}</article>", " ".join(re.sub("<[^>]*>", "", Q).split())),
        (f"<main><article><h1>T</h1>{P}{Q}</article><p>Read on.</p></main>", "T " + PROSE),
        (f"<main><h1>T</h1>{P}{Q}</main><div>{P}</div>", "T " + PROSE),
        (f"<div class=ad>never closed <article>{P}{Q}</article>", PROSE),
        (f"<form id=f><div>{P}{Q}</div><input></form>", PROSE),
        (f"<form>{P}</form><div class='page'>{P}{Q}</div>", PROSE),
    ],
)
def test_pages(page, text):
    assert html_text.main_text(page) == text


def test_extract_keeps_rows_and_columns(spark):
    page = f"<article>{P}</article>"
    rows = [(1, None, "x", 5), (None, page, None, None), (2, page, "x", 6), (2, page, "x", 6), (3, "<p>" * 50_000 + "deep", "y", 1), (4, "<a " * 100_000, "y", 1)]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, html string, text string, __page int")).collect()
    assert sorted((r["page_id"] or 0, r["n_chars"], r["__page"] or 0) for r in got) == sorted((i or 0, {None: 0}.get(h, len(html_text.main_text(h))), n or 0) for i, h, _, n in rows)
    assert html_text.extract(spark.createDataFrame([], "page_id long, html string")).collect() == []


@pytest.mark.parametrize("part", ["<a ", "<script ", "<script>", "<li>a<ul>", "</x>", "<p><b>", "<!-- ", "<div class=ad>", "<table><tr><td>", "&", "<", '<a x="'])
def test_time_is_linear_in_hostile_pages(part):
    import time

    start = time.process_time()
    html_text.main_text("<div>" * 2000 + part * 20_000)
    assert time.process_time() - start < 10


def test_index_rows_are_decoded_a_few_at_a_time(spark, tmp_path):
    """A task's memory must not grow with the blocks of a file: the reader decodes a whole row group at once."""
    docs = spark.range(40 * lexical_search.BLOCK_DOCS, numPartitions=1).select(F.col("id").alias("doc_id"), F.concat(F.lit("word w"), "id").alias("text"))
    index = lexical_search.build(docs)
    for stored in (index.forward, index.maxima):
        for file in stored.inputFiles():
            data = pq.ParquetFile(file.removeprefix("file://")).metadata
            assert max(data.row_group(i).num_rows for i in range(data.num_row_groups)) <= lexical_search.AT_ONCE
