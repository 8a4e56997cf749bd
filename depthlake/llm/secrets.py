"""Secret scan with a random forest that removes false positives (operator 10), in DataFrame functions only.

Candidates come from one pattern: long tokens with a digit, values assigned to a credential word, and
tokens with a known beginning wherever they start in a path.  Splitting a text at its candidates gives what stands before and after each of them, so
features of length, character transitions, dictionary coverage, path and neighbouring words are
plain columns.  A random forest is trained on labelled findings (before, value, after, label),
given by the caller or made from ``TEMPLATES``, and its probability decides.

Defined cases: null and empty texts have no candidate; equal candidates of a text are findings of
their own, numbered from 0; repeated rows give repeated findings; extra columns are ignored by
``findings`` and kept by ``redact``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .tables import durable, table

# Credential words, words of harmless digests, words of placeholders and identifiers.
CREDENTIAL = "password|passwd|pwd|secret|token|api_?key|access_?key|credential"
DIGEST = "commit|sha1|sha256|md5|checksum|digest|hash|revision|uuid|etag|fingerprint|blob|order|invoice|card|phone|isbn|tracking"
DICTIONARY = ("example|sample|dummy|placeholder|changeme|your|here|test|demo|password|secret|token|default|value|name|user|admin|"
              "image|static|version|release|build|index|page|post|article|photo|file|path|data|config|service|client|server|"
              "january|february|march|april|june|july|august|september|october|november|december|report|annual|the|and|for|with")
RUN = r"[A-Za-z0-9+/_\-]"
# Tokens with a known beginning, which may start after a sign inside a run such as a path.
KNOWN = (r"(?<![A-Za-z0-9])(?=[Agxse])(?:(?:AKIA|ASIA|gh[pousr]_|AIza)[A-Za-z0-9_\-]{12,}|xox[abp]-[A-Za-z0-9_\-]{11,}"
         r"|sk_(?=[A-Za-z_\-]*[0-9])[A-Za-z0-9_\-]{13,}|eyJ(?=[A-Za-z+/_\-]*[0-9])[A-Za-z0-9+/_\-]{13,})")
# Any other run starts after another sign or a known token, goes on to its end or to a known token and has a digit.
CANDIDATE = (rf"(?:(?i:{CREDENTIAL})[\"']?\s*[=:]\s*[\"']?[^\s\"'<>,;]{{6,}})|{KNOWN}"
             rf"|(?:(?:(?<!{RUN})|\G)(?={RUN}{{16}})(?=[A-Za-z+/_\-]*[0-9])(?!{RUN}{{0,15}}{KNOWN})(?![A-Za-z+/_\-]*?{KNOWN}){RUN}{{16,}}?(?:(?!{RUN})|(?={KNOWN})))")
ASSIGNED = rf"^(?i:({CREDENTIAL})([\"']?\s*[=:]\s*[\"']?))(.+)$"
NEAR = 48            # characters of context on either side that features look at
THRESHOLD = 0.5
TREES, DEPTH = 30, 8
PER_TEMPLATE = 200

# Labelled findings: text before, kind of value, text after, label.  Kinds are made in ``_value``.
TEMPLATES = (
    ('set token = "', "hex40", '" in the', 1), ("token=", "hex40", " and", 1), ("password=", "hex18", " is", 1), ("db password: ", "mixed20", "\n", 1),
    ("secret = '", "base64", "'", 1), ("api_key: ", "mixed32", " for", 1), ("access_key=", "upper20", " of", 1), ("the ", "akia", " of the", 1),
    ("key ", "akia", ".", 1), ("", "ghp", " in", 1), ("use ", "sklive", " to", 1), ('TOKEN = "', "HEX40", '"!! THE', 1), ('pwd="', "mixed12", '"', 1),
    ("commit ", "hex40", " fixes", 0), ("sha1 ", "hex40", "  file", 0), ("md5: ", "hex32", " ok", 0), ("the ", "digits16", " of", 0), ("card ", "digits16", ",", 0),
    ("", "uuid", " is", 0), ("/static/img/", "hex32", ".png", 0), ("https://host.example/blob/", "hex40", "/file", 0), ("password=", "placeholder", " here", 0),
    ('token = "', "placeholder", '"', 0), ("see ", "slug", " for", 0), ("the ", "identifier", " of", 0), ("etag ", "hex32", " sent", 0), ("order ", "upper20", " sent", 0),
    ("the ", "prose", " and", 0), ("token: ", "prose", " of", 0), ("secret: ", "words", " is", 0),
)


def _value(kind: str) -> Column:
    digest, longer = F.md5(F.concat(F.lit(kind), F.col("id").cast("string"))), F.sha2(F.concat(F.lit(kind), F.col("id").cast("string")), 256)
    mixed = F.regexp_replace(F.base64(F.unhex(longer)), "[+/=]", "7")
    upper = F.upper(F.translate(longer, "0189abcdef", "GHJKLQRTWX"))
    word = lambda n: F.element_at(F.array(*[F.lit(w) for w in DICTIONARY.split("|")]), (F.pmod(F.xxhash64("id", F.lit(kind + str(n))), F.lit(len(DICTIONARY.split("|")))) + 1).cast("int"))
    year = (F.pmod(F.xxhash64("id"), F.lit(60)) + 1965).cast("string")
    made = {
        "hex40": F.substring(longer, 1, 40), "HEX40": F.upper(F.substring(longer, 1, 40)), "hex32": digest, "hex18": F.substring(longer, 3, 18),
        "mixed32": F.substring(mixed, 1, 32), "mixed20": F.substring(mixed, 3, 20), "mixed12": F.substring(mixed, 5, 12), "base64": F.base64(F.unhex(longer)),
        "upper20": F.substring(upper, 1, 20), "akia": F.concat(F.lit("AKIA"), F.substring(upper, 1, 16)), "ghp": F.concat(F.lit("ghp_"), F.substring(mixed, 1, 36)),
        "sklive": F.concat(F.lit("sk_live_"), F.substring(mixed, 1, 24)), "digits16": F.substring(F.translate(longer, "abcdef", "123456"), 1, 16),
        "uuid": F.regexp_replace(digest, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), "placeholder": F.concat(word(1), F.lit("_"), word(2), F.lit("_"), year),
        "slug": F.concat_ws("-", word(1), word(2), word(3), year), "identifier": F.concat(F.initcap(word(1)), F.initcap(word(2)), F.initcap(word(3)), year),
        "prose": F.concat(word(1), word(2), word(3)), "words": F.concat(word(1), word(2)),
    }
    return made[kind]


def template_findings(spark: SparkSession, each: int = PER_TEMPLATE) -> DataFrame:
    """Labelled findings (before, value, after, label): ``each`` values of every template."""
    ids = spark.range(0, each, 1, 1)
    return reduce(DataFrame.unionByName, [
        ids.select(F.lit(before).alias("before"), _value(kind).alias("value"), F.lit(after).alias("after"), F.lit(label).alias("label")) for before, kind, after, label in TEMPLATES])


FEATURES = ("f_length", "f_digit", "f_upper", "f_lower", "f_sign", "f_turns", "f_cases", "f_kinds", "f_hexed", "f_vowels", "f_words", "f_slashes", "f_path", "f_file", "f_keyed", "f_assigned", "f_quoted", "f_digest", "f_prefix", "f_all_digits")


def features(found: DataFrame) -> DataFrame:
    """Adds the feature columns to (before, value, after)."""
    value, low = F.col("value"), F.lower("value")
    before, after = F.lower(F.right("before", F.lit(NEAR))), F.left("after", F.lit(NEAR))
    n = F.greatest(F.length("value"), F.lit(1))
    count = lambda pattern: F.regexp_count(value, F.lit(pattern)).cast("double")
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    last = F.regexp_extract(before, r"([^\s]+)\s*[=:\"'\s]*$", 1)
    letters = F.greatest(count("[A-Za-z]"), F.lit(1.0))
    made = {
        "f_length": F.length("value").cast("double"), "f_digit": count("[0-9]") / n, "f_upper": count("[A-Z]") / n, "f_lower": count("[a-z]") / n, "f_sign": count(r"[^A-Za-z0-9]") / n,
        "f_turns": count(r"(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])") / n, "f_cases": count(r"(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])") / n,
        "f_kinds": F.size(F.array_distinct(F.split(value, ""))) / n, "f_hexed": flag(value.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")),
        "f_vowels": F.regexp_count(low, F.lit("[aeiouy]")) / letters,
        "f_words": 1 - F.length(F.regexp_replace(low, f"(?:{DICTIONARY})", "")) / n, "f_slashes": count("/"),
        "f_path": flag(before.rlike(r"(?:/|://[^\s]*)$")), "f_file": flag(after.rlike(r"^(?:\.[a-z]{2,4}\b|/)")),
        "f_keyed": flag(last.rlike(f"(?:{CREDENTIAL})|key$")), "f_assigned": flag(before.rlike(r"[=:]\s*[\"']?$")), "f_quoted": flag(before.rlike("[\"']$")),
        "f_digest": flag(last.rlike(f"(?:{DIGEST})")), "f_prefix": flag(value.rlike(r"^(?:AKIA|ASIA|gh[pousr]_|sk_|xox[abp]-|AIza|eyJ)")), "f_all_digits": flag(value.rlike("^[0-9]+$")),
    }
    return found.withColumns(made)


def train(labelled: DataFrame, seed: int = 10):
    """Random forest over labelled findings (before, value, after, label)."""
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(features(labelled)).select("features", F.col("label").cast("double").alias("label"))
    return RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=seed).fit(durable(rows.repartition(1)))


def scored(found: DataFrame, forest) -> DataFrame:
    """Adds ``score``, the forest's probability of a secret."""
    made = forest.transform(VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(features(found)))
    return made.select(*found.columns, vector_to_array("probability")[1].alias("score"))


def candidates(docs: DataFrame, text: str, keep: tuple[str, ...]) -> DataFrame:
    """``keep`` columns, n, start, kind, before, value, after of every candidate."""
    at = docs.filter(F.col(text).rlike(CANDIDATE)).select(
        *keep, F.regexp_extract_all(F.col(text), F.lit(CANDIDATE), F.lit(0)).alias("__found"), F.split(F.col(text), CANDIDATE, -1).alias("__between"))
    ends = F.transform("__between", lambda x: F.struct(F.right(x, F.lit(NEAR)).alias("tail"), F.left(x, F.lit(NEAR)).alias("head"), F.length(x).alias("len")))
    at = at.select(*keep, "__found", ends.alias("__ends"))
    starts = F.transform("__found", lambda x, i: F.aggregate(F.slice("__ends", F.lit(1), i + 1), F.lit(0), lambda s, e: s + e["len"])
                         + F.aggregate(F.slice("__found", F.lit(1), i), F.lit(0), lambda s, v: s + F.length(v)))
    each = at.select(*keep, "__found", "__ends", starts.alias("__starts")).select(
        *keep, F.posexplode(F.transform("__found", lambda x, i: F.struct(x.alias("match"), F.get("__ends", i)["tail"].alias("before"), F.get("__ends", i + 1)["head"].alias("after"), F.get("__starts", i).alias("start")))).alias("n", "c"))
    key, glue, own = (F.regexp_extract("c.match", ASSIGNED, i) for i in (1, 2, 3))
    assigned = F.col("c.match").rlike(ASSIGNED)
    return each.select(
        *keep, "n", (F.col("c.start") + F.when(assigned, F.length(key) + F.length(glue)).otherwise(0)).alias("start"), F.when(assigned, F.lower(key)).otherwise("token shape").alias("kind"),
        F.when(assigned, F.concat("c.before", key, F.regexp_replace(glue, r"\s+", " "))).otherwise(F.col("c.before")).alias("before"), F.when(assigned, own).otherwise(F.col("c.match")).alias("value"), F.col("c.after").alias("after"))


def findings(docs: DataFrame, forest, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """key, n, start (code points), length, kind, value_sha256, score, secret of every candidate; values stay hashed."""
    found = scored(candidates(docs, text, (key,)), forest)
    return found.select(key, "n", "start", F.length("value").alias("length"), "kind", F.sha2("value", 256).alias("value_sha256"), "score", (F.col("score") >= threshold).alias("secret"))


def redact(docs: DataFrame, forest, text: str = "text", mark: str = "[SECRET]", threshold: float = THRESHOLD) -> DataFrame:
    """All rows and columns, with ``mark`` in place of each secret."""
    named = docs.withColumn("__at", F.xxhash64(*docs.columns))  # rows that agree in all columns are redacted alike
    held = F.coalesce(F.col(text).rlike(CANDIDATE), F.lit(False))
    found = scored(candidates(named.dropDuplicates(["__at"]), text, ("__at",)), forest).filter(F.col("score") >= threshold)
    spans = found.groupBy("__at").agg(F.sort_array(F.collect_list(F.struct("start", F.length("value").alias("length")))).alias("__spans"))  # spans of one text
    start = F.struct(F.lit("").alias("made"), F.lit(1).alias("from"))
    step = lambda s, x: F.struct(F.concat(s["made"], F.substring(F.col(text), s["from"], x["start"] + 1 - s["from"]), F.lit(mark)).alias("made"), (x["start"] + x["length"] + 1).alias("from"))
    clean = F.aggregate("__spans", start, step, lambda s: F.concat(s["made"], F.substring(F.col(text), s["from"], F.length(text))))
    changed = named.filter(held).join(spans, "__at", "left").withColumn(text, F.when(F.col("__spans").isNotNull(), clean).otherwise(F.col(text))).select(*docs.columns)
    return changed.unionByName(named.filter(~held).select(*docs.columns))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings(table(spark, sf_dir, "documents"), train(template_findings(spark)))
