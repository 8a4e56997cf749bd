"""Text keys and extractors as column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from depthlake.functions.numbers import as_number, let, nullif_blank, unify_dashes

# Words and look-alikes that take part in keys.
WELL_WORDS = r"(?U)\b(?:скважина|скв|well|borehole)\b"
LOOKALIKE_FROM, LOOKALIKE_TO = "авекмнорстух", "abekmhopctyx"
FILE_NOISE = (
    "core", "ker", "kern", "photo", "img", "image", "gis", "rigis", "las", "log",
    "фото", "керн", "гис", "ригис",
)
GENERIC_SHEETS = ("лист1", "sheet1", "sheet", "данные", "data")
COLUMN_ORDERS = {
    "": "auto", "auto": "auto", "авто": "auto",
    "left_to_right": "left_to_right", "ltr": "left_to_right",
    "слева направо": "left_to_right", "слева → направо": "left_to_right",
    "right_to_left": "right_to_left", "rtl": "right_to_left",
    "справа налево": "right_to_left", "справа → налево": "right_to_left",
}
RANGE_NUMBER = r"\d{2,6}(?:[.,]\d{1,4}){0,2}"
TRUE_WORDS = ("1", "true", "yes", "да")
TOP_WORDS = ("верх", "top", "verh")
BOTTOM_WORDS = ("низ", "bottom", "niz")
MAX_RANGE_M = 500
EMPTY_CANDIDATES = (
    "cast(array() as array<struct<priority:int,top:decimal(12,4),base:decimal(12,4),basis:string>>)")

# Patterns of wells, file names and captions.
NAMED_WELL = r"(?iu)(?:скв(?:ажина)?\.?|well)\s*(?:№|n|#)?\s*([a-zа-я0-9][a-zа-я0-9._/-]{0,30})"
SHORT_WELL = r"(?iu)^[a-zа-я]{0,4}[-_ ]?\d{1,5}[a-zа-я]{0,4}$"
STRICT_NAME = r"^(.+?)[_\s]+(\d+(?:[.,]\d+)?)\s*[-–—]\s*(\d+(?:[.,]\d+)?)"
PHOTO_WORD = r"(?iu)^(?:фото|photo|img|image)[ _-]*"
FIGURE = r"(?:рис(?:унок)?|fig(?:ure)?)\s*\.?\s*"
WIDE_RANGE = r"(\d{3,5}(?:\.\d{1,3})?)\D{1,18}(\d{3,5}(?:\.\d{1,3})?)"
CAPTION_NUMBER = r"\d{2,6}(?:\.\d{1,4})?"
CAPTION_LABEL = r"(?:интервал\s+(?:отбора\s+)?керна|core\s+interval)"
CAPTION_CUE = r"(?:после\s+увязк\w*|по\s+увязк\w*|с\s+уч[её]том\s+увязк\w*)"
METRES_WORD = r"(?iU)(?:\sм\.?(?:\s|$)|\bметр)"


def casefold(c: Column) -> Column:
    return F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))


def display_text(c: Column) -> Column:
    """Squeeze whitespace (F8)."""
    return F.trim(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"(?U)\s+", " "))


def normalize_text(c: Column) -> Column:
    """Squeeze, fold case and ё, and spell out the numero sign.

    Compatibility forms other than the numero sign need :func:`nfkc` first.
    """
    return F.translate(casefold(F.replace(display_text(c), F.lit("№"), F.lit("No"))), "ё", "е")


@pandas_udf(StringType())
def nfkc(values: pd.Series) -> pd.Series:
    """Unicode compatibility form; use it on distinct names, not on long texts."""
    return values.str.normalize("NFKC")


def well_key(c: Column) -> Column:
    """Comparable well identifier."""
    return F.regexp_replace(F.regexp_replace(normalize_text(c), WELL_WORDS, ""), "[^a-zа-я0-9]+", "")


def pair_key(c: Column) -> Column:
    """Well key with Cyrillic letters folded to their Latin look-alikes."""
    return F.translate(well_key(c), LOOKALIKE_FROM, LOOKALIKE_TO)


def folder_key(c: Column) -> Column:
    """Alphanumeric folder key."""
    return F.regexp_replace(F.translate(casefold(c), "ё", "е"), "[^0-9a-zа-я]+", "")


def file_stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/\\]*)$", 1), r"(?<=.)\.[^.]*$", "")


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def file_match_key(path: Column, noise: Sequence[str] = FILE_NOISE) -> Column:
    """File name words without noise and without a trailing image sequence."""
    stem = F.translate(casefold(file_stem(path)), "ё", "е")
    words = F.filter(F.split(stem, r"(?U)[_\W]+"), lambda w: (w != "") & ~w.isin(*noise))
    # Trailing number words go while more than two words are left.
    keep = F.aggregate(
        F.sequence(F.size(words), F.lit(1), F.lit(-1)),
        F.size(words).cast("int"),
        lambda left, i: F.when(
            (left == i) & (i > 2) & F.get(words, i - 1).rlike(r"^\d+$"), left - 1).otherwise(left))
    return F.when(F.size(words) > 0, F.array_join(F.slice(words, F.lit(1), keep), "_")).otherwise(F.lit(""))


def natural_key(c: Column) -> Column:
    """Sortable array: digit runs by value, text by folded text, text first."""
    parts = F.regexp_extract_all(c, F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.transform(
        parts, lambda p: F.when(p.rlike(r"^\d"), let(F.regexp_replace(p, r"^0+(?=\d)", ""), lambda n: F.concat(F.lit("1"), F.lpad(F.length(n), 10, "0"), n)))
        .otherwise(F.concat(F.lit("0"), casefold(p))))


def extract_well(c: Column) -> Column:
    """Well named in a text, without a figure suffix (F16)."""
    found = F.regexp_extract(
        display_text(c), NAMED_WELL, 1)
    bare = F.regexp_replace(found, r"^[._/\- ]+|[._/\- ]+$", "")
    return F.regexp_replace(bare, r"[-_]\d{3,6}$", "")


def well_hint(c: Column) -> Column:
    """Explicit well, or the whole text when it looks like a short identifier (F16)."""
    explicit = extract_well(c)
    short = F.regexp_replace(display_text(c), r"^[ _\-.,;()\[\]]+|[ _\-.,;()\[\]]+$", "")
    fits = short.rlike(SHORT_WELL)
    return F.when(explicit != "", explicit).when(fits, short).otherwise(F.lit(""))


def parse_filename(path: Column) -> Column:
    """struct<well, top, base> from a photo file name; figure references do not count."""
    pair = rf"{RANGE_NUMBER}\s*-\s*{RANGE_NUMBER}"
    trim = r"^[ _\-.,;()\[\]]+|[ _\-.,;()\[\]]+$"

    def edge(m, i):
        return as_number(F.regexp_extract(m, rf"({RANGE_NUMBER})\s*-\s*({RANGE_NUMBER})", i))

    def before(clean, last):
        tail = F.call_function("substring_index", clean, last, F.lit(-1))
        prefix = F.substring(clean, F.lit(1), F.length(clean) - F.length(tail) - F.length(last))
        return F.regexp_replace(F.regexp_replace(prefix, trim, ""), PHOTO_WORD, "")

    def named(prefix):
        return let(well_hint(prefix), lambda hint: F.when(hint != "", hint).otherwise(display_text(prefix)))

    def ranged(clean):
        found = F.regexp_extract_all(clean, F.lit(f"({pair})"), F.lit(1))
        spans = F.transform(found, lambda m: F.struct(m.alias("m"), edge(m, 1).alias("top"), edge(m, 2).alias("base")))
        good = F.filter(spans, lambda s: (s["base"] > s["top"]) & (s["base"] - s["top"] <= MAX_RANGE_M))
        return let(F.try_element_at(good, F.lit(-1)), lambda last: F.struct(
            F.when(last.isNotNull(), named(before(clean, last["m"]))).otherwise(well_hint(clean)).alias("well"),
            last["top"].alias("top"), last["base"].alias("base")))

    stem = unify_dashes(file_stem(path))
    return let(F.regexp_replace(stem, rf"(?iu)({FIGURE}){pair}", "$1"), ranged)


def parse_strict_filename(path: Column) -> Column:
    """struct<well, top, base> of ``well_top-base``; repairs one wrong first digit."""
    stem = file_stem(path)
    well = F.regexp_replace(display_text(F.regexp_extract(stem, STRICT_NAME, 1)), "[ _-]+$", "")
    top_text = F.translate(F.regexp_extract(stem, STRICT_NAME, 2), ",", ".")
    base_text = F.translate(F.regexp_extract(stem, STRICT_NAME, 3), ",", ".")
    top, base = top_text.try_cast("double"), base_text.try_cast("double")
    top_whole, base_whole = F.substring_index(top_text, ".", 1), F.substring_index(base_text, ".", 1)
    typo = (
        (F.length(top_whole) == F.length(base_whole)) & base_text.contains(".")
        & (F.substring(top_whole, F.lit(2), F.length(top_whole)) == F.substring(base_whole, F.lit(2), F.length(base_whole))))
    repaired = F.concat(F.substring(top_text, 1, 1), F.substring(base_text, F.lit(2), F.length(base_text))).try_cast("double")
    base = F.when(base > top, base).when(typo, repaired).otherwise(base)
    good = (well != "") & (base > top)
    return F.struct(F.when(good, well).alias("well"), F.when(good, top).alias("top"), F.when(good, base).alias("base"))


def widest_range(c: Column, low: float = 0.03, high: float = 100.0) -> Column:
    """Caption range with the widest plausible span; the first wins ties."""
    pair = WIDE_RANGE
    found = F.regexp_extract_all(F.translate(c, ",", "."), F.lit(f"({pair})"), F.lit(1))
    spans = F.transform(found, lambda m, i: F.struct(
        (F.regexp_extract(m, pair, 2).cast("double") - F.regexp_extract(m, pair, 1).cast("double")).alias("span"),
        (-i).alias("neg"),
        F.regexp_extract(m, pair, 1).cast("double").alias("top"), F.regexp_extract(m, pair, 2).cast("double").alias("base")))
    best = F.array_max(F.filter(spans, lambda s: (s["span"] >= low) & (s["span"] <= high)))
    return let(best, lambda b: F.struct(b["top"].alias("top"), b["base"].alias("base")))


def caption_candidates(c: Column) -> Column:
    """Depth-range candidates of a caption, one struct per candidate, in text order.

    Each line is cut at its first caption label and its first "after adjustment" cue;
    what follows the cue is in the adjusted system, what follows the label is measured
    depth.  Explicit ranges and neighbouring numbers of one line are candidates.
    """
    number, label, cue = CAPTION_NUMBER, CAPTION_LABEL, CAPTION_CUE
    plain = rf"(?<!\d)({number})(?!\d)"
    explicit = rf"(?<!\d)(?:{number})\s*(?:-|\bдо\b|\bto\b)\s*(?:{number})(?!\d)"
    raw = F.split(unify_dashes(F.coalesce(c, F.lit(""))), r"\r\n|\n|\r")
    lines = F.transform(raw, lambda v: display_text(F.translate(v, ",", ".")))
    def flag(line):
        return F.struct(
            line.alias("text"), line.rlike(f"(?iU){label}").alias("label"),
            (line.rlike(f"(?iU){cue}") & ~line.rlike(plain)).alias("cue_only"))

    def near(flags, i, field, low, high):
        return F.exists(F.sequence(F.lit(low), F.lit(high)), lambda d: F.coalesce(
            F.when(i + d >= 0, F.get(flags, i + d)[field]), F.lit(False)))

    def pieces(line):
        ends = [
            F.when(line.rlike(f"(?iU){p}"), F.length(F.regexp_extract(line, f"(?iU)^(.*?{p})", 1)))
            .otherwise(F.length(line) + 1) for p in (cue, label)]  # beyond the line: not found
        first, second = F.least(*ends), F.greatest(*ends)
        cut = lambda a, b: F.struct(
            F.substring(line, a + 1, b - a).alias("text"), (a >= ends[0]).alias("adjusted"), (a >= ends[1]).alias("labelled"))
        return F.array(cut(F.lit(0), first), cut(first, second), cut(second, F.length(line) + 1))

    def numbers(piece, pattern):
        return F.transform(F.regexp_extract_all(piece["text"], F.lit(f"(?iU){pattern}"), F.lit(0)), lambda m: F.struct(
            m.alias("m"), piece["adjusted"].alias("adjusted"), piece["labelled"].alias("labelled")))

    def make(item, top, base, priority, adjusted_line):
        adjusted = item["adjusted"] | adjusted_line
        return F.struct(
            (priority + F.when(adjusted, F.lit(1000)).otherwise(F.lit(0))).alias("priority"),
            top.try_cast("decimal(12,4)").alias("top"), base.try_cast("decimal(12,4)").alias("base"),
            F.when(adjusted, F.lit("gis")).when(item["labelled"], F.lit("drilling")).otherwise(F.lit("unknown")).alias("basis"))

    def one(line, around):
        unit = F.when(line.rlike(METRES_WORD), F.lit(100)).otherwise(F.lit(0))

        def collect(cuts):
            ranges = F.flatten(F.transform(cuts, lambda p: numbers(p, explicit)))
            told = F.transform(ranges, lambda r: make(
                r, F.regexp_extract(r["m"], rf"(?iU)^({number}).*?({number})$", 1),
                F.regexp_extract(r["m"], rf"(?iU)^({number}).*?({number})$", 2),
                around["priority"] + 100 + unit, around["adjusted"]))
            singles = F.flatten(F.transform(cuts, lambda p: numbers(p, plain)))
            pairs = let(singles, lambda n: F.transform(
                F.slice(n, F.lit(2), F.greatest(F.size(n) - 1, F.lit(0))),
                lambda s, k: make(F.get(n, k), F.get(n, k)["m"], s["m"], around["priority"], around["adjusted"])))
            return F.concat(told, pairs)

        return let(pieces(line), collect)

    def all_lines(flags):
        return F.flatten(F.transform(flags, lambda f, i: F.when(
            f["text"].rlike(r"\d\D+\d"),
            let(F.struct(
                F.when(near(flags, i, "label", -2, 1), F.lit(1200)).otherwise(F.lit(100)).alias("priority"),
                near(flags, i, "cue_only", -2, -1).alias("adjusted")), lambda a: one(f["text"], a))
        ).otherwise(F.expr(EMPTY_CANDIDATES))))

    found = let(F.transform(lines, flag), all_lines)
    ok = lambda s: (
        (s["base"] - s["top"] >= 0.01) & (s["base"] - s["top"] <= MAX_RANGE_M)
        & (F.least(s["top"], s["base"]) >= F.greatest(s["top"], s["base"]) * F.lit(0.35)))
    return F.filter(found, ok)


def caption_interval(c: Column) -> Column:
    """Best caption range without expected intervals: struct<top, base, basis>."""
    ranked = F.transform(
        F.filter(caption_candidates(c), lambda s: s["priority"] >= 200),
        lambda s, i: F.struct(
            s["priority"].alias("p"), (s["base"] - s["top"]).alias("span"), (-i).alias("neg"),
            s["top"].alias("top"), s["base"].alias("base"), s["basis"].alias("basis")))
    return let(F.array_max(ranked), lambda b: F.struct(
        b["top"].alias("top"), b["base"].alias("base"), b["basis"].alias("basis")))


def depth_basis(label: Column) -> Column:
    """Depth system named by a row label."""
    text = F.translate(casefold(label), "ё", "е")
    return (
        F.when(text.rlike("увяз|гис|adjust|tied|log depth"), "gis")
        .when(text.rlike(r"по\s+керну|бурен|core depth|depth.*core|drill"), "drilling").otherwise("unknown"))


def column_order(c: Column) -> Column:
    """Canonical column order; an unknown name is an error."""
    text = F.translate(casefold(display_text(c)), "ё", "е")
    known = F.create_map(*[F.lit(x) for pair in COLUMN_ORDERS.items() for x in pair])
    value = F.try_element_at(known, text)
    return F.coalesce(value, F.raise_error(F.concat(F.lit("unknown column order: "), c)))


def inline_attributes(c: Column, aliases: Mapping[str, Sequence[str]]) -> Column:
    """``field: value`` fragments of prose; the first alias of a field wins."""
    quote = lambda a: "\\Q" + a + "\\E"
    entries = []
    for field, names in aliases.items():
        tries = [
            nullif_blank(F.regexp_extract(c, rf"(?iu)(?:^|[;,.\n])\s*{quote(a)}\s*[:=\-]\s*([^;,.\n]+)", 1)) for a in names]
        value = display_text(F.coalesce(*tries))
        entries.append(F.when(F.coalesce(*tries).isNotNull(), F.struct(F.lit(field).alias("key"), value.alias("value"))))
    return F.map_from_entries(F.array_compact(F.array(*entries)))


def mentions(text: Column, option: str) -> Column:
    """Normalised text names an option, or the six-letter stem of a long word of it."""
    value = " ".join(option.split()).casefold().replace("ё", "е")
    stems, word = [], ""
    for ch in value + " ":
        if ch.isalpha():
            word += ch
        else:
            if len(word) >= 7:
                stems.append(word[:6])
            word = ""
    hit = text.contains(value)
    for stem in stems:
        hit = hit | text.contains(stem)
    return hit


def vocabulary_attributes(text: Column, options: Mapping[str, Sequence[str]]) -> Column:
    """One mentioned option is the value, several are joined under a marked key."""
    entries = []
    for field, values in options.items():
        hits = F.array_compact(F.array(*[F.when(mentions(text, v), F.lit(v)) for v in values]))
        entries.append(
            F.when(F.size(hits) == 1, F.struct(F.lit(field).alias("key"), F.get(hits, 0).alias("value")))
            .when(F.size(hits) > 1, F.struct(F.lit(f"{field} (несколько)").alias("key"), F.array_join(hits, " | ").alias("value"))))
    return F.map_from_entries(F.array_compact(F.array(*entries)))


def overlay_maps(*maps: Column) -> Column:
    """Later maps win key by key; blank values go."""
    def over(earlier, later):
        return F.map_concat(F.map_filter(earlier, lambda k, v: ~F.map_contains_key(later, k)), later)

    merged = maps[0]
    for later in maps[1:]:
        merged = over(merged, later)
    return F.map_filter(merged, lambda k, v: v.isNotNull() & (v != ""))


def inferred_name(description: Column, rock: Column) -> Column:
    """Class name told in prose, else the rock name."""
    tells = [
        nullif_blank(F.regexp_extract(description, rf"(?iu){word}\s*[:=\-]\s*([^;,.\n]+)", 1))
        for word in ("(?:фация|литофация)", "(?:название)")]
    return display_text(F.coalesce(*tells, rock))


def sheet_well(title: Column, generic: Sequence[str] = GENERIC_SHEETS) -> Column:
    """Sheet title as a well, unless generic."""
    return F.when(normalize_text(title).isin("", *generic), "").otherwise(display_text(title))


def clean_generated(c: Column, limit: int = 600) -> Column:
    """Strip fences, the leading field name and surplus length of generated text."""
    text = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|\s+$", ""))
    text = F.regexp_replace(text, r"(?iU)^```(?:\w+)?\s*|\s*```$", "")
    text = F.regexp_replace(text, r"(?iu)^(?:описание|краткое описание)\s*:\s*", "")
    return F.trim(F.substring(display_text(text), 1, limit))


def valid_generated(c: Column) -> Column:
    """Long enough, printable, no eightfold repeat, at least three letters."""
    printable = ~c.rlike(r"[\p{C}\p{Zl}\p{Zp}]") & ~c.rlike(r"[\p{Zs}&&[^ ]]")
    letters = F.length(F.regexp_replace(c, r"[^\p{L}]", ""))
    return (
        (F.length(c) >= 4) & printable & ~c.rlike(r"(.)\1{7,}") & ~c.contains("<unk>") & ~c.contains("<eos>")
        & (letters >= 3))


def render_attributes(attrs: Column, fields: Sequence[str], empty: str) -> Column:
    """Filled fields as ``field: value`` lines in fixed order."""
    lines = F.array_compact(F.array(*[
        F.when(F.trim(F.coalesce(F.try_element_at(attrs, F.lit(f)), F.lit(""))) != "",
               F.concat(F.lit(f"{f}: "), F.trim(F.try_element_at(attrs, F.lit(f))))) for f in fields]))
    return F.when(F.size(lines) > 0, F.array_join(lines, "\n")).otherwise(F.lit(empty))


def identity_hash(*parts: Column, length: int = 64) -> Column:
    """Hex digest of ``|``-joined parts, cut to ``length``."""
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, length)


def strip_hash_prefix(name: Column, digest: Column) -> Column:
    """Cached name without its content-hash prefix."""
    prefix = F.concat(F.substring(digest, 1, 12), F.lit("_"))
    return F.when((digest != "") & name.startswith(prefix), F.substring(name, F.length(prefix) + 1, F.length(name))).otherwise(name)


def orientation(c: Column) -> Column:
    """top / bottom words inside recognised text."""
    text = F.regexp_replace(F.translate(casefold(c), "ё", "е"), "[^a-zа-я]", "")
    has = lambda words: F.greatest(*[text.contains(w).cast("int") for w in words]) == 1
    return F.when(has(TOP_WORDS), "top").when(has(BOTTOM_WORDS), "bottom")


def truthy(c: Column) -> Column:
    """Tolerant boolean cell."""
    return F.lower(F.trim(F.coalesce(c, F.lit("")))).isin(*TRUE_WORDS)
