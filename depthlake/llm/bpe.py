"""BPE encoding and decoding with a public tokenizer file: tree concatenation of long texts.

A text of over ``LEAF`` characters is halved until every part is at most that long.  The parts are
rows of their own, so the tasks of a cluster encode the halves of one text in parallel.  Joined
neighbours are mended where they meet: a window around the join is encoded anew and grows until its
first token is the left part's token there and its last token the right part's token there.  What
lies outside such a window is then exactly the encoding of the whole:

* merges are taken by rank and, within a rank, from the left, so a sequence of tokens is *the*
  encoding of its text if each two neighbours encode to themselves.  All pairs inside the left part,
  inside the window and inside the right part do, and the window shares a token with each side;
* a window edge lies where text is split alike with and without what follows: 16 characters or more
  away from the join (no contraction and no special token is longer), never next to an apostrophe,
  never inside a character, never before a character that composes with the one before it.

ASCII white space and the edges between ASCII letters, digits and symbols part words whatever else the
text holds (but for contractions and special tokens), so the pieces between them are encoded
independently of each other: a batch is dictionary-coded and every distinct piece is encoded once.

Defined cases: a null text is an empty one; an empty text has no token and decodes to the empty
string; rows that are equal in key and text each give a row; an empty table gives an empty one; the
operator returns the key columns it is given, so other columns of the input cannot clash.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .tables import table
from .textbytes import LOWER, SPACE, Slice, slices

LEAF = 1 << 14
FIRST_WINDOW = 16
#: Characters at each end of a part whose token places are kept; a window that grows further takes the rest.
RIM = 256
SLICE_BYTES = 2 << 20
CACHED_PIECES = 1 << 18
BATCH_PIECES = 1 << 13
BLANK = re.compile("[ \t-\r]")
#: Letters that compose with the letter before them (all other composing characters are marks).
COMPOSING_LETTERS = ((0x1100, 0x11FF), (0x16D63, 0x16D6A))


def _kinds() -> np.ndarray:
    """Per byte: 0 white space, 1 undecided (control and non-ASCII bytes), 2 letter, 3 digit, 4 symbol."""
    kinds = np.ones(256, np.uint8)
    kinds[33:127], kinds[48:58], kinds[65:91], kinds[97:123], kinds[SPACE] = 4, 3, 2, 2, 0
    return kinds


KINDS, APOSTROPHE = _kinds(), ord("'")


def piece_starts(part: Slice, whole: bool) -> np.ndarray:
    """First bytes of the pieces of a slice; ``whole`` cuts at white space and row edges only."""
    kind = KINDS[part.buf]
    fresh = kind > 0
    if len(kind) > 1:
        edge = kind[:-1] == 0
        if not whole:
            edge |= (kind[:-1] > 1) & (kind[1:] > 1) & (kind[:-1] != kind[1:]) & (part.buf[:-1] != APOSTROPHE)
        at_row = np.zeros(len(kind), bool)
        rows = part.offsets[1:-1]
        at_row[rows[rows < len(kind)]] = True
        fresh[1:] &= edge | at_row[1:]
    return np.flatnonzero(fresh)


class Coder:
    """One tokenizer file in a Python worker, with the encodings of pieces met before."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.suffix = spec["model"].get("end_of_word_suffix") or ""
        self.specials = [t["content"] for t in spec["added_tokens"]]
        spec["model"]["end_of_word_suffix"] = None
        self.inner = Tokenizer.from_str(json.dumps(spec)).model
        size = self.whole.get_vocab_size(with_added_tokens=True)
        self.narrow = "<u2" if size <= 1 << 16 else "<u4"
        names = [self.whole.id_to_token(i) or "" for i in range(size)]
        self.ends_word = np.array([n in self.specials or bool(self.suffix) and n.endswith(self.suffix) for n in names])
        self.lowers = self.whole.normalizer.normalize_str("A") == "a" and not any(s != s.lower() for s in self.specials)
        self.cache: dict[str, list[int]] = {}

    def pieces(self, distinct: list[str]) -> list[list[int]]:
        """The ids of pieces without white space between them."""
        if len(self.cache) + len(distinct) > CACHED_PIECES:
            self.cache.clear()
        new = [p for p in distinct if p not in self.cache]
        for lo in range(0, len(new), BATCH_PIECES):
            some = new[lo:lo + BATCH_PIECES]
            for piece, found in zip(some, self.whole.encode_batch_fast(some, add_special_tokens=False)):
                self.cache[piece] = found.ids
        return [self.cache[p] for p in distinct]

    def _placed(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        found = self.whole.encode(text, add_special_tokens=False)
        return np.array(found.ids, np.uint32), np.array(found.offsets, np.int64).reshape(-1, 2)

    def part(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, head, tail) of one part: rows of (start, end), in characters, of its first and last tokens.

        A part without white space near its ends has all its places in the head, and no tail.
        """
        head, tail = BLANK.search(text, RIM), None
        for tail in BLANK.finditer(text, max(0, len(text) - 2 * RIM), max(0, len(text) - RIM)):
            pass
        if not head or not tail or head.end() > tail.start():
            return *self._placed(text), np.zeros((0, 2), np.int64)
        raw = np.frombuffer(text.encode(), np.uint8)
        ids = np.frombuffer(encode_slice(self, Slice(0, 1, raw, np.array([0, len(raw)])))[0].as_py(), "<u4")
        return ids, self._placed(text[:head.start()])[1], self._placed(text[tail.end():])[1] + tail.end()

    def window(self, text: str, open_end: bool) -> list[int]:
        """The ids of a window; with ``open_end`` its last word goes on behind it."""
        found = self.whole.encode(text, add_special_tokens=False).ids
        if not open_end:
            return found
        ends = np.flatnonzero(self.ends_word[found[:-1]])
        tail = text
        for special in self.specials:
            tail = tail.rpartition(special)[2]
        word = self.whole.pre_tokenizer.pre_tokenize_str(self.whole.normalizer.normalize_str(tail))[-1][0]
        kept = found[: int(ends[-1]) + 1] if len(ends) else []
        return kept + [t.id for t in self.inner.tokenize(word)]


@lru_cache(maxsize=2)
def coder(path: str) -> Coder:
    return Coder(path)


def halves(lo: int, hi: int, leaf: int) -> list[int]:
    """Where the parts of a text begin, in order."""
    if hi - lo <= leaf:
        return [lo]
    mid = (lo + hi) // 2
    return halves(lo, mid, leaf) + halves(mid, hi, leaf)


def _joins_before(char: str) -> bool:
    """Whether a character may compose with the one before it."""
    code = ord(char)
    return unicodedata.category(char)[0] == "M" or any(a <= code <= b for a, b in COMPOSING_LETTERS)


def _edge_ok(text: str, at: int) -> bool:
    return "'" not in text[max(0, at - 3):at + 1] and not (at < len(text) and _joins_before(text[at]))


class Node:
    """The encoding of ``text[lo:hi]`` as if it stood alone; unknown places inside a window are -1."""

    def __init__(self, lo: int, hi: int, ids: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        self.lo, self.hi, self.ids, self.start, self.end = lo, hi, ids, start, end

    @classmethod
    def rimmed(cls, lo: int, hi: int, ids: np.ndarray, head: np.ndarray, tail: np.ndarray) -> Node:
        """A part whose first and last tokens have known places, counted from its own start."""
        start, end = np.full(len(ids), -1, np.int64), np.full(len(ids), -1, np.int64)
        for at, places in ((0, head), (len(ids) - len(tail), tail)):
            start[at:at + len(places)] = places[:, 0] + lo
            end[at:at + len(places)] = places[:, 1] + lo
        return cls(lo, hi, ids, start, end)

    def clean(self, i: int) -> bool:
        """Whether tokens i - 1 and i have no character in common."""
        return 0 <= self.end[i - 1] <= self.start[i]


def _left_edge(text: str, left: Node, reach: int) -> int:
    """Index of the last token of the left part where a window may begin, ``reach`` before the join; 0 if none."""
    known = np.flatnonzero((left.start >= 0) & (left.start <= left.hi - reach))
    for i in known[::-1]:
        if i and left.clean(i) and _edge_ok(text, int(left.start[i])):
            return int(i)
    return 0


def _right_edge(text: str, right: Node, reach: int) -> int:
    """Index of the first token of the right part where a window may end, ``reach`` behind the join; the last if none."""
    known = np.flatnonzero(right.end >= right.lo + reach)
    for j in known:
        if j + 1 < len(right.ids) and right.clean(j + 1) and _edge_ok(text, int(right.end[j])):
            return int(j)
    return len(right.ids) - 1


def join(found: Coder, text: str, left: Node, right: Node) -> Node:
    """The encoding of two neighbours: windows around the join grow until both sides agree."""
    reach = FIRST_WINDOW
    while True:
        i, j = _left_edge(text, left, reach), _right_edge(text, right, reach)
        from_left, to_right = i == 0, j >= len(right.ids) - 1
        a = left.lo if from_left else int(left.start[i])
        b = right.hi if to_right else int(right.end[j])
        open_end = not to_right and not found.ends_word[right.ids[j]]
        ids = np.array(found.window(text[a:b], open_end), np.uint32)
        agreed = (from_left or len(ids) and ids[0] == left.ids[i]) and (to_right or len(ids) and ids[-1] == right.ids[j])
        if agreed:
            start, end = np.full(len(ids), -1, np.int64), np.full(len(ids), -1, np.int64)
            if len(ids) and not from_left:
                start[0] = a
            if len(ids) and not to_right:
                end[-1] = b
            parts = zip((left.ids[:i], left.start[:i], left.end[:i]), (ids, start, end), (right.ids[j + 1:], right.start[j + 1:], right.end[j + 1:]))
            return Node(left.lo, right.hi, *[np.concatenate(p) for p in parts])
        reach *= 2


def concatenate(found: Coder, text: str, nodes: list[Node]) -> np.ndarray:
    """Join neighbours pairwise until one node is left."""
    while len(nodes) > 1:
        joined = [join(found, text, a, b) for a, b in zip(nodes[::2], nodes[1::2])]
        nodes = joined + nodes[len(nodes) // 2 * 2:]
    return nodes[0].ids


def _packed(ids: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Rows of little-endian unsigned 32-bit integers."""
    offsets = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)]) * 4
    return pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(ids.astype("<u4").tobytes())])


def encode_slice(found: Coder, part: Slice) -> pa.Array:
    """The packed ids of each row of a slice; every distinct piece is encoded once."""
    raw = part.buf.tobytes()
    start = piece_starts(part, whole=any(s.encode() in raw for s in found.specials))
    inside = ~SPACE[part.buf]
    data = (LOWER[part.buf] if found.lowers else part.buf)[inside]
    offsets = np.append(np.cumsum(inside, dtype=np.int64)[start] - 1, len(data))
    row = np.searchsorted(part.offsets, start, "right") - 1
    words = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(data))
    coded = words.dictionary_encode()
    lists = found.pieces(coded.dictionary.to_pylist())
    sizes = np.fromiter((len(x) for x in lists), np.int64, len(lists))
    flat = np.fromiter(chain.from_iterable(lists), np.uint32, int(sizes.sum()))
    codes = coded.indices.to_numpy()
    counts = sizes[codes]
    begin = (np.cumsum(sizes) - sizes)[codes]
    place = np.arange(int(counts.sum())) + np.repeat(begin - (np.cumsum(counts) - counts), counts)
    per_row = np.bincount(row, weights=counts, minlength=len(part)).astype(np.int64)
    return _packed(flat[place], per_row)


def encode(docs: DataFrame, path: str, *, text: str = "text", key: Sequence[str] = ("doc_id",), leaf: int = LEAF) -> DataFrame:
    """(key.., ids) of every whole text: ``ids`` is binary, little-endian unsigned 32-bit integers.

    Texts up to ``leaf`` characters are encoded where they are read; only the parts of longer ones
    are shuffled, by part to be encoded and by text to be joined.
    """
    key = list(key)
    body = F.coalesce(F.col(text), F.lit(""))
    kept = docs.select(*key, body.alias("__body"))
    long_text = F.length("__body") > leaf
    fields = [kept.schema[k] for k in key]
    out = T.StructType([*fields, T.StructField("ids", T.BinaryType())])

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = coder(path)
        for batch in batches:
            for part in slices(batch.column("__body"), SLICE_BYTES):
                ids = encode_slice(found, part).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([*[batch.column(k).slice(part.lo, len(part)) for k in key], ids], [*key, "ids"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = batch.column("__body")
            for at in range(batch.num_rows):
                whole = bodies[at].as_py()
                begins = halves(0, len(whole), leaf)
                parts = [whole[a:b] for a, b in zip(begins, [*begins[1:], len(whole)])]
                same = pa.array(np.full(len(parts), at))
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(k).take(same) for k in ("__text", *key)], pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.string())],
                    ["__text", *key, "__part", "__body"])

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = coder(path)
        for batch in batches:
            for at in range(batch.num_rows):
                ids, head, tail = found.part(batch.column("__body")[at].as_py())
                row = batch.slice(at, 1)
                extra = [pa.array([x.tobytes()], pa.binary()) for x in (ids.astype(found.narrow), head.astype("<i4"), tail.astype("<i4"))]
                yield pa.RecordBatch.from_arrays([*row.columns, *extra], [*row.schema.names, "ids", "head", "tail"])

    def joined(group: pa.Table) -> pa.Table:
        found = coder(path)
        group = group.sort_by("__part")
        order = group.column("__part").to_numpy()
        first = np.flatnonzero(np.diff(order, prepend=-1))
        copies = int((order == 0).sum())
        bodies = [group.column("__body")[int(i)].as_py() for i in first]
        nodes, lo = [], 0
        for i, part in zip(first, bodies):
            ids = np.frombuffer(group.column("ids")[int(i)].as_py(), found.narrow).astype(np.uint32)
            head, tail = (np.frombuffer(group.column(c)[int(i)].as_py(), "<i4").reshape(-1, 2) for c in ("head", "tail"))
            nodes.append(Node.rimmed(lo, lo + len(part), ids, head, tail))
            lo += len(part)
        ids = concatenate(found, "".join(bodies), nodes).astype("<u4").tobytes()
        of_rows = group.slice(0, copies)
        return pa.table([*[of_rows.column(k) for k in key], pa.array([ids] * copies, pa.binary())], names=[*key, "ids"])

    identity = T.StructType([T.StructField("__text", T.StringType()), *fields])
    part_schema = T.StructType([*identity.fields, T.StructField("__part", T.IntegerType()), T.StructField("__body", T.StringType())])
    leaf_schema = T.StructType([*part_schema.fields, *[T.StructField(c, T.BinaryType()) for c in ("ids", "head", "tail")]])
    parts = (
        kept.filter(long_text).select(F.sha2("__body", 256).alias("__text"), *key, "__body")
        .mapInArrow(cut, part_schema).repartition("__text", *key, "__part").mapInArrow(leaves, leaf_schema))
    return kept.filter(~long_text).mapInArrow(short, out).unionByName(parts.groupBy("__text", *key).applyInArrow(joined, out))


def decode(encoded: DataFrame, path: str, *, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """Add the text that the tokenizer gives for packed ids, special tokens included."""
    schema = T.StructType([*encoded.schema.fields, T.StructField(into, T.StringType())])

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = coder(path).whole
        for batch in batches:
            column = batch.column(ids)
            for lo in range(0, batch.num_rows, 256):
                rows = batch.slice(lo, 256)
                lists = [np.frombuffer(column[i].as_py() or b"", "<u4").tolist() for i in range(lo, lo + rows.num_rows)]
                said = pa.array([found.decode(x, skip_special_tokens=False) for x in lists], pa.string())
                yield pa.RecordBatch.from_arrays([*rows.columns, said], [*rows.schema.names, into])

    return encoded.mapInArrow(texts, schema)


def op12_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded text of every document."""
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    found = decode(encode(table(spark, sf_dir, "documents"), path), path)
    return found.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
