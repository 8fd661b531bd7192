"""Secret scans: a random forest takes false positives out of pattern matches; DataFrame functions and Spark ML only.

Patterns propose candidates: key formats with a fixed head, values assigned to a name such as password or token, and
long runs that mix letters and digits. Each candidate gets its length, its character transitions, how much of it words
of a dictionary cover, what the path (the document's source) and the neighbouring words say. A forest trained from
labelled findings gives the probability that it is a secret.

The tables hold no labelled findings, so labelled_findings() makes a set from rules; fit() takes any table of that shape.
Null and empty texts have no candidates. A secret that repeats in a text is one finding for each place; rows with equal
ids, or none, are searched each. redact() goes by the text and the path, which alone decide what is found, so that ids
may repeat or be null. Empty tables give an empty result; columns other than the id, the text and the path are not read.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import texts

#: Key formats with a fixed head (fixed values: published formats).
FORMATS = r"(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[0-9A-Za-z_\-]{35}|[sr]k_live_[0-9A-Za-z]{16,}|eyJ[\w\-]{8,}\.[\w\-]{8,}\.[\w\-]{8,}"
NAMES = r"password|passwd|pwd|secret|token|api[_\-]?key|access[_\-]?key|auth[_\-]?key|private[_\-]?key|credential"
#: To the end, however long: a rest could not be found again, and would stay in a redacted text.
VALUE = r"[^\s\"',;<>]{6,}+"
ASSIGNED = rf"(?i:{NAMES})[\"']?\s?[:=]{{1,2}}\s?[\"']?{VALUE}"
MIXED = r"(?<![A-Za-z0-9_\-+/=.@])(?=[A-Za-z_\-+/]*[0-9])(?=[0-9_\-+/]*[A-Za-z])[A-Za-z0-9_\-+/]{20,}={0,2}"
PATTERN = rf"(?:{FORMATS})|{ASSIGNED}|{MIXED}"
#: Words that placeholders are made of.
DICTIONARY = "example|sample|test|demo|dummy|fake|change|placeholder|your|here|secret|password|token|default|value|insert|replace|none|null|true|false|user|admin|string|name|config|process|environ|getenv|path|file|home|local|public|class|version|release|build|index|image|module|function|data|page|http|https|com|org|abc|xyz|xxx|foo|bar|the|and|this|that|key|api|letter|word|number"
TRUSTED_PATH = r"test|example|sample|fixture|mock|doc|vendor|node_modules"
#: Characters of context on either side.
NEAR = 48
FEATURES = ["length", "digits", "uppers", "distinct", "transitions", "likely", "hex", "runs", "dictionary", "known_format", "assigned", "near_secret", "near_hash", "near_example", "trusted_path"]
TREES, DEPTH = 24, 6


def _path(docs: DataFrame, path_col: str | None) -> Column:
    return (F.coalesce(F.col(path_col).cast("string"), F.lit("")) if path_col in docs.columns else F.lit("")).alias("path")


def _digests(text: Column, path: Column) -> list[Column]:
    return [F.xxhash64(F.lit(k), text, path) for k in (1, 2)]


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source") -> DataFrame:
    """doc_id, start (in characters, from 0), candidate, left_context, right_context, path, and h1, h2, digests of text and path: every match of the patterns."""
    path, text = _path(docs, path_col), F.col("text")
    # cheap tests first: a text without a digit, a sign of assignment or a format's head is not searched
    may = text.rlike("[0-9]") | text.contains("=") | text.contains(":") | text.contains("AKIA") | text.contains("ASIA") | text.contains("xox") | text.contains("gh") | text.contains("eyJ") | text.contains("AIza") | text.contains("k_live_")
    rows = texts(docs, path, id_col=id_col, text_col=text_col).where(may & text.rlike(PATTERN))
    digests = [h.alias(n) for h, n in zip(_digests(text, F.col("path")), ("h1", "h2"), strict=True)]
    rows = rows.select("doc_id", "path", *digests, F.regexp_extract_all("text", F.lit(PATTERN), 0).alias("found"), F.split("text", PATTERN, -1).alias("between"))
    rows = rows.withColumn("sizes", F.transform(F.arrays_zip("between", "found"), lambda x: F.char_length(x["between"]) + F.coalesce(F.char_length(x["found"]), F.lit(0))))
    each = rows.select("doc_id", "path", "h1", "h2", "between", "sizes", F.posexplode("found").alias("nth", "match"))
    # of an assignment the value is the candidate, and the name belongs to what is left of it
    value = F.regexp_extract("match", rf"^(?:{FORMATS})$|^(?i:{NAMES})[\"']?\s?[:=]{{1,2}}\s?[\"']?({VALUE})$", 1)
    each = each.withColumn("candidate", F.when(value != "", value).otherwise(F.col("match")))
    before = F.aggregate(F.slice("sizes", F.lit(1), F.col("nth")), F.lit(0), lambda a, x: a + x)
    name = F.left("match", F.char_length("match") - F.char_length("candidate"))
    left, right = F.concat(F.get("between", F.col("nth")), name), F.get("between", F.col("nth") + 1)
    return each.select("doc_id", (before + F.char_length(left)).alias("start"), "candidate", F.right(left, F.lit(NEAR)).alias("left_context"), F.left(right, F.lit(NEAR)).alias("right_context"), "path", "h1", "h2")


def letter_pairs() -> dict[str, float]:
    """Log frequency of each pair of letters of the dictionary's words; \"\" stands for all that they do not have."""
    pairs = Counter(w[i : i + 2] for w in DICTIONARY.split("|") for i in range(len(w) - 1))
    return {"": round(math.log(0.5 / pairs.total()), 4)} | {p: round(math.log(n / pairs.total()), 4) for p, n in sorted(pairs.items())}


def described(found: DataFrame) -> DataFrame:
    """found with the columns FEATURES, all double."""
    c, near = F.col("candidate"), F.concat_ws(" ", "left_context", "right_context")
    n = F.greatest(F.char_length(c), F.lit(1))
    pairs = letter_pairs()
    # the weight of each pair by the places of its two letters (0: any other), so that a look-up costs the same for any pair
    letters = "".join(sorted(set("".join(pairs))))
    table = F.lit([pairs.get(x + y, pairs[""]) for x in ["", *letters] for y in ["", *letters]])
    # every pair of the value, in one pass: substring() would read a long value from its beginning for each
    places = F.transform(F.split(F.coalesce(c, F.lit("")), ""), lambda x: F.when(x != "", F.instr(F.lit(letters), F.lower(x))).otherwise(0))
    most = F.greatest(n - 1, F.lit(1))
    moves = F.zip_with(F.slice(places, F.lit(1), most), F.slice(places, F.lit(2), most), lambda x, y: F.get(table, x * (len(letters) + 1) + F.coalesce(y, F.lit(0))))
    likely = F.aggregate(moves, F.lit(0.0), lambda a, x: a + x) / F.size(moves)
    count = lambda p, of=c: F.coalesce(F.regexp_count(of, F.lit(p)), F.lit(0))
    columns = {
        "length": F.char_length(c),
        "digits": count("[0-9]") / n,
        "uppers": count("[A-Z]") / n,
        "distinct": F.size(F.array_distinct(F.split(c, ""))) / n,
        "transitions": count(r"(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])|(?<=[a-z])(?=[A-Z])|(?<=[aeiou])(?=[^aeiou0-9])") / n,
        "likely": likely,
        "hex": c.rlike(r"^[0-9a-f]+$|^[0-9A-F]+$"),
        "runs": count(r"(.)\1\1") / n,
        "dictionary": 1 - F.char_length(F.regexp_replace(F.lower(c), DICTIONARY, "")) / n,
        "known_format": c.rlike(f"^(?:{FORMATS})$"),
        "assigned": F.col("left_context").rlike(rf"(?i)({NAMES})[\"']?\s?[:=]{{1,2}}\s?[\"']?$"),
        "near_secret": near.rlike(rf"(?i)\b(?:{NAMES})\b"),
        "near_hash": near.rlike(r"(?i)\b(?:sha-?\d*|md5|commit|checksum|digest|uuid|etag|integrity)\b"),
        "near_example": near.rlike(r"(?i)\b(?:example|sample|placeholder|dummy|your)\b"),
        "trusted_path": F.col("path").rlike(f"(?i){TRUSTED_PATH}"),
    }
    return found.withColumns({k: F.coalesce(v.cast("double"), F.lit(0.0)) for k, v in columns.items()})


def labelled_findings(spark: SparkSession, n: int = 4000) -> DataFrame:
    """candidate, left_context, right_context, path, label: findings as a reviewer would mark them, made by rule from a counter."""
    h = lambda k: F.sha2(F.concat(F.col("id").cast("string"), F.lit(k)), 256)
    pick = lambda k, *x: F.element_at(F.array(*[F.lit(v) if isinstance(v, str) else v for v in x]), F.pmod(F.xxhash64("id", F.lit(k)), F.lit(len(x))).cast("int") + 1)
    b64 = F.regexp_replace(F.base64(F.unhex(h("b"))), "[+/=]", "Z")
    size = (F.pmod(F.xxhash64("id", F.lit("size")), F.lit(25)) + 12).cast("int")
    secret = pick("kind", F.concat(F.lit("AKIA"), F.upper(F.substring(F.translate(b64, "0189", "AB77"), 1, 16))), F.substring(h("c"), F.lit(1), size), F.substring(b64, F.lit(1), size), F.concat(F.lit("ghp_"), F.substring(b64, 1, 36)), F.substring(h("d"), 1, 40))
    word = lambda k: pick(k, "example", "your", "change", "test", "sample", "default", "user", "config", "password", "token", "secret", "value", "release", "module", "index", "image")
    harmless = pick("harmless", F.concat_ws("_", word("1"), word("2"), F.lit("here")), F.concat_ws("-", word("3"), word("4"), word("5"), F.substring(h("e"), 1, 2)), F.concat(F.lit("xxxxxxxx"), F.substring(F.lit("xxxxxxxxxxxxxxxx"), F.lit(1), size - 8), F.lit("1")), F.concat_ws("/", word("6"), word("7"), F.concat(word("8"), F.lit("2"))), F.substring(h("f"), 1, 40), F.concat_ws("-", F.substring(h("g"), 1, 8), F.substring(h("g"), 9, 4), F.substring(h("g"), 13, 4), F.substring(h("g"), 17, 12)), F.concat(F.lit("1234567890abcdef"), F.substring(F.lit("1234567890"), F.lit(1), size - 11)))
    hashed = harmless.rlike("^[0-9a-f]{40}$|^[0-9a-f-]{31}$")
    rows = spark.range(0, n, 1, 1).withColumn("label", (F.pmod(F.xxhash64("id"), F.lit(2)) == 0).cast("double"))
    rows = rows.withColumn("candidate", F.when(F.col("label") == 1, secret).otherwise(harmless))
    rows = rows.withColumn("sure", F.col("candidate").rlike(f"^(?:{FORMATS})$"))
    named = pick("name", "password=", 'token = "', "secret: ", "api_key='", "and the password=", "set access_key=")
    left = F.when(F.col("label") == 1, F.when(F.col("sure"), pick("plain", "", "the ", "and then ", "key ")).otherwise(named)).otherwise(F.when(hashed, pick("hash", "commit ", "sha1 ", "md5: ", "uuid ", "checksum=")).otherwise(F.concat(pick("ex", "", "for example ", "your "), named)))
    return rows.select("candidate", left.alias("left_context"), pick("after", "", " and", '"', "' # here").alias("right_context"), F.when((F.col("label") == 0) & (F.pmod("id", F.lit(3)) == 0), "tests/data").otherwise("src/main").alias("path"), "label")


def fit(findings: DataFrame, seed: int = 17) -> RandomForestClassificationModel:
    """A forest trained from labelled findings."""
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(described(findings)).select("features", "label")
    return RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=seed, subsamplingRate=0.8).fit(rows)


def find_secrets(docs: DataFrame, model: RandomForestClassificationModel, threshold: float = 0.5, **columns: str) -> DataFrame:
    """doc_id, start, length, candidate, probability, h1, h2 of every candidate that the forest takes for a secret."""
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(described(candidates(docs, **columns)))
    rows = model.transform(rows).withColumn("probability", F.get(vector_to_array("probability"), F.lit(1)))
    return rows.where(F.col("probability") >= threshold).select("doc_id", "start", F.char_length("candidate").alias("length"), "candidate", "probability", "h1", "h2")


def redact(docs: DataFrame, found: DataFrame, mark: str = "[SECRET]", text_col: str = "text", path_col: str | None = "source") -> DataFrame:
    """docs with every finding's characters replaced by a mark; found is what find_secrets found in them. The columns stay."""
    spans = found.groupBy("h1", "h2").agg(F.sort_array(F.collect_set(F.struct("start", "length"))).alias("__spans"))
    text: Column = F.col("__text")
    h = _digests(F.coalesce(F.col(text_col), F.lit("")), _path(docs, path_col))
    rows = docs.select(F.struct("*").alias("__row"), F.col(text_col).alias("__text"), h[0].alias("__h1"), h[1].alias("__h2"))
    rows = rows.join(spans, (F.col("__h1") == F.col("h1")) & (F.col("__h2") == F.col("h2")), "left")
    end = lambda x: x["start"] + x["length"]
    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("at"))
    step = lambda a, x: F.struct(F.concat(a["text"], F.substring(text, a["at"] + 1, x["start"] - a["at"]), F.lit(mark)).alias("text"), end(x).alias("at"))
    put = F.aggregate("__spans", start, step, lambda a: F.concat(a["text"], F.substring(text, a["at"] + 1, F.char_length(text))))
    clean = F.when(F.col("__spans").isNotNull() & text.isNotNull(), put).otherwise(text)
    return rows.select(*[clean.alias(c) if c == text_col else F.col("__row")[c].alias(c) for c in docs.columns])
