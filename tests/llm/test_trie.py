"""The trie against a plain one built conversation by conversation."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

from depthlake.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, n long, name string, d string"


def plain(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {}
    for c, found in convs.items():
        key = lambda x: hashlib.sha256(f"{len(x[2].encode())}:{x[2]}{x[3]}".encode()).digest()
        own[c] = [x[2:] for x in sorted(found, key=lambda x: (x[:2], key(x)))]
    built = {}
    for c in own:
        h, root = zlib.crc32(str(c).encode()) % 4, c - int(abs(c) % 20) * (1 if c >= 0 else -1)
        built[c] = own.get(root, [])[:h] + own[c][h:]
    members = defaultdict(list)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members[tuple(built[c][:d])].append(c)
    kids, out = defaultdict(int), []
    for p in members:
        if p:
            kids[p[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, found in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in kids
            saved[p[:d]] += (len(found) - 1) * words
    for p, found in members.items():
        ends = ",".join(str(c) for c in found if len(built[c]) == len(p))
        out.append((found[0], len(p), members[p[:-1]][0] if p else -(10 ** 9), len(found), kids[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


def found(spark, rows):
    df = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], SCHEMA).repartition(3)
    cols = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()
    return sorted(tuple(-(10 ** 9) if r[c] is None else r[c] for c in cols) for r in trie.trie(df).collect())


def test_trie_equals_a_plain_one(spark):
    rng = random.Random(7)
    rows = []
    for c in [*range(0, 45), 60, 61, 81, 99, 105, 8200, 8201, 20000, -3, -25]:
        for turn in range(rng.choice([1, 1, 2, 3, 5, 9, 17])):
            rows.append((c, rng.choice([turn, turn, None, 1]), rng.choice(["user", "assistant", None]), rng.choice(["hi", "how are  you", "", None, "é\xa0x y"])))
    rows += [(c, t, "user", "same words here") for c in range(40000, 40060, 3) for t in range(4)]
    rows += [(None, 1, "user", "nobody"), rows[0], rows[0], (7, 0, "user", "x " * 5000)]
    assert found(spark, rows) == plain(rows)


def test_empty_and_single(spark):
    assert found(spark, []) == []
    assert found(spark, [(5, 0, None, None)]) == plain([(5, 0, None, None)])
