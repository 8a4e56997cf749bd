"""Edge cases and brute-force versions of the operators on whole texts."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Row

from depthlake.llm import decontamination, language, mixing, neardup, quality, secrets, substrings, toxicity

WORDS = [a + b for a in "ba ce di fo gu ka le mi no pu".split() for b in "ra se ti vo xu la me ni po zu".split()]
SCHEMA = "doc_id long, text string, lang string, source string, n long, rank string, size string, id string, score string"


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, src, 1, "x", "y", "z", "s") for i, t, lang, src in rows], SCHEMA)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    base = [prose(rng, rng.randint(1, 120)) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(100 + i, base[i]) for i in range(10)]                                      # exact copies
    for i in range(20):                                                                 # near copies
        w = base[i].split()
        w[rng.randrange(len(w))] = "edited"
        rows.append((200 + i, " ".join(w)))
    passage = prose(rng, 40)
    rows += [(300 + i, prose(rng, 10 + i) + " " + passage + "\n" + prose(rng, 5)) for i in range(12)]
    rows += [(400, None), (401, ""), (402, " \n\t "), (403, "one"), (404, "One"), (405, "two words"), (406, prose(rng, 6000)), (407, "ba " * 90), (0, base[0])]
    return rows


@pytest.fixture(scope="module")
def docs(spark, texts):
    return frame(spark, [(i, t, "en", "s%d" % (i % 3) if i % 7 else None) for i, t in texts]).repartition(3)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_substrings_match_brute_force(docs, texts):
    count = Counter(tuple(w[j:j + 35]) for _, t in texts for w in [words(t)] for j in range(len(w) - 34))
    want = []
    for i, t in texts:
        w, cut = words(t), set()
        for j in range(len(w) - 34):
            if count[tuple(w[j:j + 35])] > 1:
                cut |= set(range(j, j + 35))
        kept = " ".join(x for j, x in enumerate(w) if j not in cut)
        want.append((i, len(w), len(cut), hashlib.sha256(kept.encode()).hexdigest()))
    for shard in (1500, 2):  # the second sends every contested anchor the way of the crowded ones
        got = [tuple(r) for r in substrings.dedup(docs, shard=shard).collect()]
        assert sorted(got) == sorted(want)
    assert sum(r[2] for r in want) > 300


def brute_components(texts, k, percent):
    sets = {}
    for i, t in texts:
        w = words("".join(c.lower() if c.isascii() else c for c in t or ""))
        sets[i] = {tuple(w[j:j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in sets}


@pytest.mark.parametrize("k,percent", [(3, 85), (5, 80)])
def test_near_duplicates_match_brute_force(docs, texts, k, percent):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs, k=k, percent=percent).collect()}
    assert got == brute_components(texts, k, percent)


@pytest.mark.parametrize("shard", [1500, 1])
def test_substrings_tell_words_apart_whose_hashes_half_agree(spark, shard):
    made = ["w%d" % i for i in range(300_000)]
    raw = "".join(made).encode()
    end = np.cumsum([len(w) for w in made])
    upper = substrings.word_hashes(np.frombuffer(raw, np.uint8), end - [len(w) for w in made], end, lower=False) >> np.uint64(32)
    order = np.argsort(upper)
    same = np.flatnonzero(upper[order][1:] == upper[order][:-1])
    pairs = [(made[order[i]], made[order[i + 1]]) for i in same]
    assert len(pairs) >= 4
    rng, rows = random.Random(3), []
    for n, (one, two) in enumerate(pairs):
        for place in (0, 17, 34):
            base = prose(rng, 35).split()
            rows += [(len(rows) + j, " ".join(base[:place] + [w] + base[place + 1:]), None, None) for j, w in enumerate((one, two))]
    got = substrings.dedup(frame(spark, rows), shard=shard).collect()
    assert len(got) == len(rows) and all(r.n_removed == 0 for r in got)


def test_near_duplicates_in_a_crowded_region(spark, monkeypatch):
    rng = random.Random(8)
    base = prose(rng, 200).split()
    rows = []
    for i in range(80):  # two crowds of near copies that share most shingles, linked inside and partly across
        w = list(base)
        for j in range(6 if i % 2 else 0):
            w[30 * j + 3] = "other"
        w[rng.randrange(200)] = "edit%d" % i
        rows.append((i, " ".join(w)))
    monkeypatch.setattr(neardup, "SMALL", 3)
    monkeypatch.setattr(neardup, "BLOCK", 7)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(frame(spark, [(i, t, None, None) for i, t in rows]), k=3, percent=85).collect()}
    assert got == brute_components(rows, 3, 85)


def test_empty_tables(spark):
    none = frame(spark, [])
    assert substrings.dedup(none).collect() == []
    assert neardup.near_duplicates(none).collect() == []
    assert mixing.mix(none).collect() == []
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.contaminated(none, items).collect() == []
    assert language.train(none) is None
    assert quality.train_on(none, spark.createDataFrame([], "doc_id long, quality int")) is None
    assert toxicity.fit(none, spark.createDataFrame([], "doc_id long, toxic int")).model == {}


def test_decontamination_finds_copies_and_edits(spark):
    rng = random.Random(3)
    items = [(i, prose(rng, 30)) for i in range(8)] + [(8, None), (9, ""), (10, "short one")]
    edited = items[2][1].split()
    for j in range(2, 30, 6):
        edited[j] = "changed"
    rows = [(1, prose(rng, 50) + " " + items[0][1].upper() + ". " + prose(rng, 9)), (2, " ".join(edited)), (3, prose(rng, 4000)), (4, None), (5, ""),
            (6, items[4][1].replace(" ", " | ")), (7, "Short one."), (8, "a short one."), (1, items[1][1])]
    got = {(r.doc_id, r.item_id): r.score for r in decontamination.contaminated(frame(spark, [(i, t, None, None) for i, t in rows]), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert set(got) == {(1, 0), (1, 1), (2, 2), (6, 4), (7, 10)}
    assert got[1, 0] == 1.0 and 0.6 < got[2, 2] < 0.9


def test_decontamination_finds_passages_of_long_items(spark):
    rng = random.Random(4)
    item = prose(rng, 300).split()
    edited = item[60:100]
    edited[20] = "changed"
    common = " ".join(item[200:216])
    texts = {1: item[100:128], 2: item[7:156], 3: edited, 4: item[40:47], 5: item[200:216]}
    rows = [(i, prose(rng, 30) + " " + " ".join(w) + " " + prose(rng, 30)) for i, w in texts.items()]
    rows += [(10 + i, common) for i in range(40)] + [(60, prose(rng, 3000))]  # 40 copies: the commonest seeds of the item
    got = {r.doc_id: r.score for r in decontamination.contaminated(frame(spark, [(i, t, None, None) for i, t in rows]), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()}
    assert set(got) == {1, 2, 3, 5, *range(10, 50)} and max(got.values()) < 0.55


def test_smith_waterman_against_plain_recurrence():
    rng = np.random.default_rng(1)
    for _ in range(20):
        x, y = rng.integers(2, 6, 12).astype(np.uint64), rng.integers(2, 6, 9).astype(np.uint64)
        h = np.zeros((10, 13), int)
        for i in range(1, 10):
            for j in range(1, 13):
                h[i, j] = max(0, h[i - 1, j - 1] + (2 if x[j - 1] == y[i - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
        assert decontamination.smith_waterman(x[None], y[None])[0][0] == h.max()


def test_mixing_targets(spark, docs):
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count()
    by = defaultdict(lambda: [0, 0, 0.0, 0])
    longest = defaultdict(int)
    for r in rows:
        longest[r.source] = max(longest[r.source], r.size)
        assert 0 <= r.copies <= 3 and (r.size or not r.copies * r.size)
        x = by[r.source]
        x[0] += r.size
        x[1] += r.size * r.copies
        x[2], x[3] = r.target, r.source_size
    assert len(by) == 4 and all(x[0] == x[3] and x[2] <= 3 * x[0] + 1e-6 for x in by.values())
    assert abs(sum(x[2] for x in by.values()) - sum(x[0] for x in by.values())) < 1e-6
    for s, x in by.items():  # a source whose one document is longer than its target can only be as near as with or without it
        best = min(abs(x[2] - 3 * (x[0] - longest[s])), abs(x[2] - longest[s])) if longest[s] > x[2] else 0
        assert abs(x[1] - x[2]) <= max(0.15 * x[2] + 60, best + 1), (s, x)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs.repartition(5)).collect()))


def test_mixing_walks_past_documents_that_do_not_fit(spark):
    sources = {f"s{k:02}": [25_000] + [50] * 300 for k in range(6)} | {"t": [3], "u": [4], "v": [400] * 40}
    rows = [(1000 * k + i, "ba " * n, "en", s) for k, (s, sizes) in enumerate(sources.items()) for i, n in enumerate(sizes)]
    by = defaultdict(lambda: [0, 0.0])
    table = frame(spark, rows)
    made = mixing.mix(table).collect()
    assert len(made) == len(rows)
    for r in made:
        by[r.source][0] += r.size * r.copies
        by[r.source][1] = r.target
    assert all(abs(by[s][0] - by[s][1]) <= min(sources[s]) for s in sources)
    con = duckdb.connect()
    documents = pd.DataFrame([(i, t, x) for i, t, _, x in rows], columns=["doc_id", "text", "source"])  # noqa: F841
    want = {r[0]: (r[1], r[4]) for r in con.execute(mixing.OP2_SQL).fetchall()}
    assert {r.doc_id: (r.size, r.size * r.copies) for r in made} == want
    assert sorted(map(str, made)) == sorted(map(str, mixing.mix(table.repartition(7)).collect()))


def test_secrets_are_found_and_redacted(spark):
    key, sha = "AKIA" + "Q7HD2KX9ZPLM4TRW", hashlib.sha1(b"x").hexdigest()
    rows = [(1, f'set token = "{sha}" now'), (2, f"commit {sha} fixes it"), (3, f"use {key} and password=9855ae4fa49702326c."), (4, None), (5, ""), (6, "card 9807915762804490 of"), (7, "plain words only"), (1, f'set token = "{sha}" now')]
    forest = secrets.train(secrets.template_findings(spark, 40))
    table = frame(spark, [(i, t, None, None) for i, t in rows])
    found = [r for r in secrets.findings(table, forest).collect() if r.secret]
    assert Counter(r.doc_id for r in found) == {1: 2, 3: 2}
    texts = dict(rows)
    assert {hashlib.sha256(texts[r.doc_id][r.start:r.start + r.length].encode()).hexdigest() == r.value_sha256 for r in found} == {True}
    clean = secrets.redact(table, forest)
    assert clean.columns == table.columns and clean.count() == len(rows)
    kept = {r.doc_id: r.text for r in clean.collect()}
    assert kept[1] == 'set token = "[SECRET]" now' and kept[2] == texts[2] and kept[4] is None and key not in kept[3]


def test_secrets_in_paths_and_aligned_lines(spark):
    token, word = "ghp_" + "a9Kd03LmQx7ZtR5vBn2Wc8Ye4Uf6Hg1Jp0Ss", "9855ae4fa49702326c"
    path = "https://git.example/organisation/a-team-with-a-name/that/goes/on/without/any/number/for/long/"
    key, sha = "AKIA" + "Q7HD2KX9ZPLM4TRW", hashlib.sha1(b"x").hexdigest()
    rows = [(1, f"see {path}{token} now"), (2, f"password      = {word}"), (3, f"password{' ' * 60}:  {word} and"), (4, f"/a/{key}/tree/{token}"),
            (5, f"see {path}v2/readme"), (6, f"commit {sha} and {path}"), (7, "/" + "a" * 200_000 + "1"), (8, "_" + "sk_/" * 20_000)]
    forest = secrets.train(secrets.template_findings(spark, 40))
    table = frame(spark, [(i, t, None, None) for i, t in rows])
    clean = {r.doc_id: r.text for r in secrets.redact(table, forest).collect()}
    assert clean[1] == f"see {path}[SECRET] now" and clean[2] == "password      = [SECRET]" and word not in clean[3] and clean[4] == "/a/[SECRET]/tree/[SECRET]"
    assert clean[5] == rows[4][1] and clean[6] == rows[5][1] and clean[8] == rows[7][1]
    held = {r.doc_id for r in secrets.candidates(table, "text", ("doc_id",)).select("doc_id").collect()}
    assert {5, 7} <= held


def test_classifiers_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    truth = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id", "left")
    said = language.op5_language_id(spark, sf).filter("held_out").join(truth, "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in said) >= 0.97 * len(said)
    said = quality.op8_quality(spark, sf).filter("held_out").join(truth, "doc_id").filter("quality is not null").collect()
    assert sum(r.predicted == r.quality for r in said) >= 0.85 * len(said) and all(0 <= r.score <= 1 for r in said)
    said = toxicity.op6_toxicity(spark, sf).filter("held_out").join(truth, "doc_id").filter("toxic is not null").collect()
    assert sum(r.predicted == r.toxic for r in said) >= 0.9 * len(said)
    assert not [r for r in said if r.predicted and not r.toxic and r.score < 0.5]


def test_classifiers_on_odd_texts(spark):
    rows = [(1, None, "en", "a"), (2, "", "en", "a"), (3, "123 !!", "fr", "a"), (4, "x" * 3000, None, "a"), (5, "the and of this", "en", "a"), (6, "le la de et qui", "fr", "a")]
    table = frame(spark, rows)
    said = {r.doc_id: r for r in language.predict(table, language.train(table)).collect()}
    assert [said[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and said[1].score == 0 and said[4].lang_pred in ("en", "fr")
    one = quality.score(table.withColumn("held_out", table.doc_id > 3), 0.25).collect()
    assert {r.score for r in one} == {0.25} and {r.predicted for r in one} == {0}
    only = toxicity.fit(table, spark.createDataFrame([(5, 0)], "doc_id long, toxic int"))
    said = {r.doc_id: r.predicted for r in toxicity.score(frame(spark, [(1, "you IDIOT, stupid", None, None), (2, None, None, None)]), only).collect()}
    assert said == {1: 1, 2: 0}


def test_label_model_shares_the_say_of_copies():
    rng = np.random.default_rng(2)
    y = rng.random(3000) < 0.3
    vote = lambda hit, false: np.where(y, rng.random(3000) < hit, rng.random(3000) < false)
    first = vote(0.7, 0.05)
    votes = np.stack([first, first, first, vote(0.8, 0.02), vote(0.6, 0.1)], axis=1)
    posterior, model = toxicity.label_model(votes, np.where(rng.random(3000) < 0.95, y, ~y).astype(int))
    assert ((posterior > 0.5) == y).mean() > 0.95
    assert model["say"][:3].max() < model["say"][3:5].min()


def test_repeated_rows_keep_their_count(spark):
    table = frame(spark, [(1, "a b c", "en", "s")] * 3)
    assert [r.copies for r in mixing.mix(table).collect()] == [1, 1, 1]
    assert {tuple(r) for r in neardup.near_duplicates(table, k=3, percent=85).collect()} == {Row(1, 1, 1)}


def test_pipeline_tells_texts_of_one_id_apart(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(8)
    a, b, c = (prose(rng, 60) for _ in range(3))
    rows = [(3, a, "en", "s"), (5, a + " more", "en", "s"), (5, b, "en", "s"), (7, c, "en", "s"), (7, b + " more", "en", "s"), (None, c, "en", "s"), (None, c + " more", "en", "s"),
            (9, "", "en", "s"), (9, None, "en", "s"), (3, a, "en", "s")]
    docs = frame(spark, rows)
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()]
    assert sorted(got, key=str) == sorted([(3, a), (5, b), (7, c), (9, ""), (9, None)], key=str)
    assert corpus_pipeline.drop_near_duplicates(spark, docs.limit(0), "").count() == 0
