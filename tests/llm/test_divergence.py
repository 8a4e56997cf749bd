"""The divergence audit against dense columns in plain Python."""

import random
import re
from collections import Counter, defaultdict

from depthlake.llm import divergence, textbytes

SCHEMA = "doc_id long, text string, lang string, source string, n long, term string, value string"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least=10):
    df, counts, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        found = Counter(TERM.findall((text or "").translate(FOLD)))
        df[lang].update(found.keys())
        counts[lang, source] += found
    out = []
    for lang, source in groups:
        vocab = sorted(t for t, n in df[lang].items() if n >= least)
        v = len(vocab)

        def column(names):
            total = sum(counts[lang, s][t] for s in names for t in vocab)
            return {t: 1 + 10 ** 9 * (sum(counts[lang, s][t] for s in names) + 2) // (total + 2 * v) for t in vocab}

        f = lambda p, q: (p - q) ** 2 // (p + q)
        own, whole = column([source]), column([s for la, s in groups if la == lang])
        pair = [(sum(f(own[t], other[t]) for t in vocab), s) for la, s in groups if la == lang and s != source for other in [column([s])]]
        term = [(f(own[t], whole[t]), t) for t in vocab if counts[lang, source][t] and own[t] > whole[t]]
        for part, items, limit in (("pair", pair, None), ("term", term, 10)):
            ranked = sorted(items, key=lambda x: (-x[0], x[1].encode()))[:limit]
            out += [(lang, source, part, item, value, i + 1) for i, (value, item) in enumerate(ranked)]
    return sorted(out)


def found(spark, rows, **kw):
    df = spark.createDataFrame([(i, *r, 1, "x", "y") for i, r in enumerate(rows)], SCHEMA).repartition(3)
    return sorted(tuple(r) for r in divergence.divergence(df, **kw).collect())


def test_divergence_equals_dense_columns(spark):
    rng = random.Random(2)
    words = ["Ab", "cd", "É", "naïve", "x9y", "don't", "漢字", "zz\x00q", "hot"] + [f"{chr(97 + i % 26)}{chr(97 + i // 26)}w" for i in range(150)]
    rows = []
    for i in range(260):
        lang = rng.choice(["en", "en", "de", None])
        source = rng.choice([None, "", "hot", "hot", "s1", "s2", "é", "S"])
        rows.append((" ".join(rng.choice(words[:20] if rng.random() < .5 else words) for _ in range(rng.randint(0, 60))), lang, source))
    rows += [(None, "en", "null text"), ("", "xx", "a"), ("1 2 3", "xx", "b"), ("only", "one", "s"), rows[0], rows[0], ("hot " * 30000, "en", "long")]
    want = plain(rows)
    assert found(spark, rows) == want
    assert found(spark, rows, block=16, tile=2) == want  # columns over many blocks and tiles


def test_long_rows_are_cut_between_terms(monkeypatch):
    import numpy as np
    import pyarrow as pa

    text = " ".join(f"w{chr(97 + i % 17)}é" for i in range(900))
    whole = next(textbytes.slices(pa.array([text])))
    group = np.zeros(1, np.int64)
    before = divergence._count_slice(whole, group)
    monkeypatch.setattr(divergence, "SLICE_BYTES", 64)
    after = divergence._count_slice(whole, group)
    assert dict(zip(before[1].to_pylist(), before[2])) == dict(zip(after[1].to_pylist(), after[2]))
    assert set(after[3]) == {1} == set(before[3])


def test_empty_table(spark):
    assert found(spark, []) == []
