"""Pages, recordings and the pipeline on small fixtures."""

import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

import corpus_pipeline
from depthlake.llm import audio, pages

SCHEMA = "page_id long, url string, html string, text string, __host string"


def texts_of(spark, rows):
    made = pages.extract(spark.createDataFrame([(i, u, h, "other", "x") for i, u, h in rows], SCHEMA)).collect()
    assert all(r.n_chars == len(r.text) for r in made)
    return {r.page_id: r.text for r in made}


def test_structure(spark):
    page = ('<html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header>Site</header><nav><ul><li><a href="/">Home</a></ul></nav>'
            '<div class="ad">Buy</div><div class="cookie-notice">We use cookies</div><article><h1>Head &amp; tail</h1><p><b>One\n  two<br>three<p>four &lt;five&gt; <i>six</i>seven'
            '<!-- gone --><form><input><button>Send</button></form><section class="comments"><article class="comment">Nice</article></section></article>'
            '<aside>See also</aside><div id="comments"><p>First!</p></div><footer>&copy; me')
    rows = [(1, "http://a.b/1", page), (2, None, None), (3, "http://a.b/3", ""), (4, "http://a.b/4", "<p>only &eacute;"), (5, "http://a.b/5", '<div id="content"><p>x</p></div><div>y</div>'),
            (6, "http://a.b/6", '<article><div class="entry-header"><h1>H</h1></div><div class="text-widget" data-hidden="1">b</div><div class="site-notice">n</div><div hidden>z</div></article>'), (1, "http://a.b/1", page)]
    made = texts_of(spark, rows)
    assert made == {1: "Head & tail\nOne two three\nfour <five> sixseven", 2: "", 3: "", 4: "only é", 5: "x", 6: "H\nb"}


def test_main_zones_inside_layouts(spark):
    story = "<p>a story of the day that is long enough</p>"
    side = "<div class='sidebar'>latest</div>"
    rows = [(1, None, f"<main><h1>Title</h1>{story}<article>a card</article></main>"), (2, None, f"<main><p>crumbs</p><article>{story}</article></main>"),
            (3, None, f"<p>skip</p><div class='layout has-sidebar'>{side}<article>{story}</article></div>"), (4, None, f"<main class='content-with-sidebar'>{story}{side}</main>"),
            (5, None, f"<article>{story}</article><div class='related'><article>another card</article></div>"), (6, None, f"<article><svg class='icon'/>{story}</article><svg><p>x</p></svg>"),
            (7, None, f"<div>{story}</div><div class='comments'><article>nice</article></div>"), (8, None, f"<aside><div class='has-sidebar'><article>{story}</article></div></aside>")]
    body = "a story of the day that is long enough"
    assert texts_of(spark, rows) == {1: f"Title\n{body}\na card", 2: body, 3: body, 4: body, 5: body, 6: body, 7: body, 8: ""}


def test_suffix_array_of_a_host(spark):
    rng = random.Random(1)
    word = lambda n: " ".join("w%d" % rng.randrange(500) for _ in range(n))
    bodies = [word(40) for _ in range(30)]
    top, foot = "welcome to our daily site please enjoy it", "all rights are reserved by the company of this town"
    rows = [(i, f"http://Host.example:80/{i}", f"<div>{top}</div><div>{b}</div><div>{foot} page</div>") for i, b in enumerate(bodies)]
    rows += [(100 + i, f"http://other{i}.example/", f"<div>{top}</div>") for i in range(3)]     # a host with one page has no repeats
    rows += [(200, "http://host.example/copy", rows[0][2])]
    made = texts_of(spark, rows)
    assert [made[i] for i in range(30)] == bodies and made[200] == bodies[0] and made[100] == top


def test_suffix_array_is_sorted():
    rng = np.random.default_rng(4)
    tokens = rng.integers(0, 4, 200)
    order, common = pages.suffix_array(tokens)
    suffixes = [tuple(tokens[i:]) for i in order]
    assert suffixes == sorted(suffixes)
    for a, b, n in zip(suffixes, suffixes[1:], common[1:], strict=False):
        assert a[:n] == b[:n] and (len(a) == n or len(b) == n or a[n] != b[n])


def test_recordings(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(0, 0.125, 64)
    rows = [(0, x), (1, x + rng.normal(0, 0.006, 64)), (2, rng.normal(0, 0.125, 64)), (3, np.concatenate([rng.normal(0, 0.125, 8), x])), (4, x), (5, None), (6, np.zeros(0))]
    table = spark.createDataFrame(pd.DataFrame({"vec_id": [r[0] for r in rows], "embedding": [None if r[1] is None else list(map(float, r[1])) for r in rows]}), "vec_id long, embedding array<float>")
    prints = audio.fingerprints(audio.rendered(table, "vec_id", "embedding"), "vec_id", "pcm")
    classes, found = audio.search(prints, F.col("id") == 0)
    kept = {r.class_id: r for r in found.collect()}
    assert set(kept) == {1, 3}                                       # 4 is of the class of 0, the rest do not match
    assert kept[3].offset == -8 * audio.NOTE // audio.HOP and kept[3].error < 0.05
    assert {r.class_id: r.members for r in classes.collect()} == {0: 2, 1: 1, 2: 1, 3: 1, 5: 1, 6: 1}


def test_recall_of_the_search(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(0, 0.125, (20, 64))
    vectors = np.concatenate([base, np.repeat(base[:5], 12, axis=0) + rng.normal(0, 0.015, (60, 64))])
    table = spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    prints = audio.fingerprints(audio.rendered(table, "vec_id", "embedding"), "vec_id", "pcm")
    _, found = audio.search(prints, F.col("id") < 20)
    got = {(r.query_class, r.class_id) for r in found.collect()}
    packed = {r.id: np.array(r.packed, np.int32).view(np.uint32) for r in prints.collect()}
    true = {(a, b) for a in range(20) for b in packed if a != b and np.bitwise_count(packed[a] ^ packed[b]).sum() <= audio.MOST_ERRORS * 32 * len(packed[a])}
    assert len(true) >= 40 and len(true & got) >= 0.9 * len(true)


def test_pipeline_stages(spark, tmp_path):
    rng = random.Random(9)
    words = [a + b for a in "ba ce di fo gu ka le mi no pu".split() for b in "ra se ti vo xu la me ni po zu".split()]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    item, base = prose(30), prose(100)
    rows = [(i, prose(60), "en", f"s{i % 4}") for i in range(40)]
    rows += [(50, base, "en", "s0"), (51, base + " more", "en", "s1"), (52, prose(9) + " " + item, "en", "s2"), (53, prose(20) + ' token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" ' + prose(20), "en", "s1"),
             (54, "you idiot stupid moron trash " + prose(20), "en", "s3"), (55, None, None, None), (56, "", "en", "s0"), (None, prose(30), "en", "s0"), (None, prose(31), "en", "s0")]
    docs = spark.createDataFrame([(i, t, lang, s, len(t or ""), "extra", 1.0) for i, t, lang, s in rows], "doc_id long, text string, lang string, source string, n_chars long, copies string, score double")
    spark.createDataFrame([(i, 1, int(i % 2 == 0)) for i in range(100, 200)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        made = stage(spark, docs, str(tmp_path))
        if name != "mixing":
            assert made.columns == docs.columns
        made.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        left[name] = docs.collect()
    ids = lambda name: [r.doc_id for r in left[name]]
    assert len(left["toxicity"]) == len(rows) - 1 and 54 not in ids("toxicity")
    assert set(ids("toxicity")) - set(ids("near_duplicates")) == {51} and ids("near_duplicates").count(None) == 2
    assert set(ids("near_duplicates")) - set(ids("decontamination")) == {52}
    assert len(left["secrets"]) == len(left["decontamination"])
    redacted = next(r for r in left["secrets"] if r.doc_id == 53)
    assert "[SECRET]" in redacted.text and redacted.n_chars == len(redacted.text)
    assert {r.copies for r in left["mixing"]} <= {1, 2, 3} and 55 not in ids("mixing")


def test_pipeline_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
