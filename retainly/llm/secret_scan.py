"""Secret scan: candidate strings judged by a random forest, on DataFrame functions alone.

Candidates have two forms. An assigned value is all that stands behind a credential name and
one of ``= : := =>``, of any length and any characters: up to the closing quote, else up to white
space, without closing punctuation or a next ``&name=``. A run is at least 16 characters of
``[A-Za-z0-9+/_-]`` with a digit, and up to two ``=`` of padding. A text is
split at its candidates once, so piece i stands before candidate i and piece i + 1 after it;
both neighbours come from there without searching again. Features: length, character
classes and transitions between them, distinct characters, vowels, dictionary coverage (the
dictionary is the ``DICTIONARY`` most frequent words beside candidates, over all documents),
path signs and neighbouring words.

Labelled findings train the forest (``pyspark.ml``). Where none are given they come from the
scanned texts by rules that need no model: digits alone and
values of dictionary words are not secrets; other values assigned to a credential name are
(an unquoted word of letters alone stays unlabelled, as it may be prose); parts of URLs and
paths are not; all others stay unlabelled. All labelled findings count: those of equal features and
label are at most ``COPIES`` training rows that share their number as weight. The trees become one SQL expression, so scoring runs inside the scan.

Defined results: null or empty text has no findings; without labels of both classes the
score is the share of secrets among the labels (0 without any); repeated rows are scanned
and returned as often as they occur; only the named columns are read.
"""

from __future__ import annotations

import re

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._store import stored

NAMES = (r"token(?!i[sz])|secret(?!ar)|passw(?:or)?d|passwd|pwd|api[_-]?key|access[_-]?key|private[_-]?key|"
         r"auth(?!or(?!i[sz])|entic(?!at))|credential|bearer")
_NAME = rf"(?i:{NAMES})[A-Za-z0-9_.-]{{0,20}}[\"']?\s{{0,3}}"
_SIGN = r"(?:=>|:=|={1,3}|:)\s{0,3}"
_SCHEME = r"(?i:(?:bearer|basic|token)\s{1,3})?"
_NEAR = r"(?<=[=:>\s\"'])(?<=[=:>]\s{0,3}[\"']?" + _SCHEME + ")"  # a cheap look first
_BEHIND = "(?<=" + _NAME + _SIGN
_VALUE = (_NEAR + "(?:" + _BEHIND + "\"" + _SCHEME + r")(?!(?i:bearer|basic|token)\s)[^\"\r\n]++(?=\")|"
          + _BEHIND + "'" + _SCHEME + r")(?!(?i:bearer|basic|token)\s)[^'\r\n]++(?=')|"
          + _BEHIND + r"[\"']?" + _SCHEME + r")(?!(?i:bearer|basic|token)\s)[^\s\"'=>]\S*?"
          r"(?=[\"',;.)\]}>]{0,8}(?:\s|$)|[&;,][A-Za-z0-9_.-]{1,40}=))")
_RUN = (r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])(?![A-Za-z0-9+/_-]*?" + _NAME + "[=:])"
        r"[A-Za-z0-9+/_-]{16,}+(?:={1,2}(?![A-Za-z0-9+/_=-]))?")
CANDIDATE = f"{_VALUE}|{_RUN}"
CONTEXT = 80
DICTIONARY = 300
COPIES, TRAIN_PARTS = 32, 32
TREES, DEPTH, SEED = 30, 5, 7
SECRET_SCORE = 0.5
MASK = "[SECRET]"

CREDENTIAL = f"(?i)({NAMES})"
ASSIGNED = _NAME + _SIGN + r"[\"']?" + _SCHEME + "$"
IDENTIFIER = r"(?i)\b(commit|sha\d*|md5|hash|checksum|digest|uuid|id|order|invoice|card|phone|isbn|version)\b"
ADDRESS = r"""(?i)(https?:|ftp:|www\.|[\\/])[^\s"']{0,60}$"""


def finding_array(text: Column) -> Column:
    """array<struct<value, before, after, gap>> of a text; ``gap`` is the length of the piece before."""
    values = F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0))
    pieces = F.split(text, CANDIDATE, -1)
    zipped = F.arrays_zip(values.alias("value"), F.slice(pieces, 1, F.size(values)).alias("before"),
                          F.slice(pieces, 2, F.size(values)).alias("after"))
    return F.transform(zipped, lambda z: F.struct(
        z["value"].alias("value"), F.right(z["before"], F.lit(CONTEXT)).alias("before"),
        F.left(z["after"], F.lit(CONTEXT)).alias("after"), F.length(z["before"]).alias("gap")))


def findings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per candidate: doc_id, position (from 0), start, value, before, after."""
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    some = narrow.filter(F.col("text").rlike(CANDIDATE)).withColumn("row", F.monotonically_increasing_id())
    each = some.select("doc_id", "row", F.posexplode(finding_array(F.col("text"))).alias("position", "f"))
    each = each.select("doc_id", "row", "position", "f.*")
    upto = Window.partitionBy("row").orderBy("position")
    before = F.sum(F.col("gap") + F.length("value")).over(upto) - F.length("value")
    return each.select("doc_id", "position", before.cast("bigint").alias("start"), "value", "before", "after")


def dictionary(found: DataFrame, size: int = DICTIONARY) -> list[str]:
    """The most frequent words of letters beside candidates (at most ``size`` in the driver)."""
    words = F.filter(F.split(F.lower(F.concat_ws(" ", "before", "after")), r"[^\p{L}]+"), lambda w: F.length(w).between(3, 20))
    top = (found.select(F.explode(words).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
           .orderBy(F.desc("n"), "w").limit(size).collect())
    return [r.w for r in top]


FEATURES = ("length", "digits", "capitals", "smalls", "hex", "transitions", "letter_digit", "distinct", "vowels", "dictionary",
            "slashes", "separators", "credential_near", "assigned", "quoted", "identifier_near", "address")


def features(value: Column, before: Column, after: Column, words: list[str]) -> Column:
    """array<double> of ``FEATURES``."""
    n = F.length(value).cast("double")

    def count(pattern: str, of: Column = value) -> Column:
        return F.length(F.regexp_replace(of, pattern, "")).cast("double")

    def share(pattern: str) -> Column:  # pattern removes all other characters
        return count(pattern) / n

    def yes(c: Column) -> Column:
        return F.coalesce(c, F.lit(False)).cast("double")

    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[a-z]", "a"), "[A-Z]", "A"), "[0-9]", "0")
    kinds = F.regexp_replace(kinds, "[^aA0]", ".")
    runs = F.length(F.regexp_replace(kinds, r"(.)\1*", "$1")).cast("double")
    mixed = F.length(F.regexp_replace(F.regexp_replace(F.lower(kinds), r"a+0+|0+a+", "#"), "[^#]", "")).cast("double")
    known = "|".join(sorted(map(re.escape, words), key=lambda w: (-len(w), w))) or r"(?!)"
    left = F.length(F.regexp_replace(F.lower(value), f"({known})", "")).cast("double")
    near = F.concat_ws(" ", F.right(before, F.lit(40)), F.left(after, F.lit(20)))
    return F.array(
        n, share("[^0-9]"), share("[^A-Z]"), share("[^a-z]"), share("[^0-9a-fA-F]"), (runs - 1) / n, mixed / n,
        F.size(F.array_distinct(F.split(value, ""))).cast("double") / n, share("[^aeiouAEIOU]"), (n - left) / n,
        count("[^/]"), count("[^_=+-]"), yes(near.rlike(CREDENTIAL)), yes(before.rlike(ASSIGNED)),
        yes(before.rlike("[\"']$") & after.rlike("^[\"']")), yes(near.rlike(IDENTIFIER)), yes(before.rlike(ADDRESS)))


def rule_label(f: Column) -> Column:
    """1, 0 or null from the rules in the module text; ``f`` is a features array."""
    at = {name: f[i] for i, name in enumerate(FEATURES)}
    word = (at["capitals"] + at["smalls"] >= 0.999) & (at["quoted"] == 0)
    return (F.when((at["digits"] + at["separators"] / at["length"] >= 0.999) | (at["dictionary"] >= 0.5), 0.0)
            .when((at["assigned"] > 0) & ~word, 1.0).when(at["address"] > 0, 0.0))


def train(labelled: DataFrame) -> list | float:
    """Trees as nested (feature, threshold, left, right) or leaf votes, from rows of (x array, y)."""
    groups = labelled.filter("y IS NOT NULL").groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"))
    copies = F.least("n", F.lit(COPIES))
    # a fixed dealing and order, as the bootstrap goes by them
    each = (groups.repartition(TRAIN_PARTS, "x").sortWithinPartitions("x", "y")
            .select("x", "y", (F.col("n") / copies).alias("weight"), F.explode(F.sequence(F.lit(1), copies.cast("int"))).alias("_c")))
    rows = stored(each.drop("_c"), "labelled")
    n, ones = rows.agg(F.sum("weight"), F.sum(F.col("y") * F.col("weight"))).first()
    if not n or not ones or ones == n:
        return float(ones or 0) / n if n else 0.0
    forest = RandomForestClassifier(featuresCol="v", labelCol="y", weightCol="weight", numTrees=TREES, maxDepth=DEPTH, seed=SEED)
    model = forest.fit(rows.select(array_to_vector("x").alias("v"), "y", "weight"))
    return [parse_tree(t.toDebugString) for t in model.trees]


def parse_tree(text: str):
    """A printed tree as (feature, threshold, left, right) tuples with leaf classes."""
    lines = [s.strip() for s in text.splitlines()[1:] if s.strip()]

    def node(i: int):
        m = re.match(r"Predict: ([\d.]+)", lines[i])
        if m:
            return float(m[1]), i + 1
        m = re.match(r"If \(feature (\d+) <= (\S+)\)", lines[i])
        left, j = node(i + 1)
        right, j = node(j + 1)  # lines[j] is the Else
        return (int(m[1]), float(m[2]), left, right), j

    return node(0)[0]


def forest_score(trees: list | float, f: Column) -> Column:
    """Share of trees that vote for a secret, as one expression."""
    if isinstance(trees, float):
        return F.lit(trees)

    def vote(t) -> Column:
        if isinstance(t, float):
            return F.lit(t)
        return F.when(f[t[0]] <= F.lit(t[1]), vote(t[2])).otherwise(vote(t[3]))

    total = F.lit(0.0)
    for t in trees:
        total = total + vote(t)
    return total / len(trees)


def learn(found: DataFrame, labelled: DataFrame | None = None) -> tuple[list | float, list[str]]:
    """(trees, dictionary); ``labelled`` has value, before, after and label, else the rules label ``found``."""
    words = dictionary(found)
    source = found if labelled is None else labelled
    x = features(F.col("value"), F.col("before"), F.col("after"), words)
    y = rule_label(F.col("x")) if labelled is None else F.col("label").cast("double")
    return train(source.withColumn("x", x).select("x", y.alias("y"))), words


def scan(docs: DataFrame, labelled: DataFrame | None = None, threshold: float = SECRET_SCORE, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """One row per candidate: doc_id, position, start, length, value_sha256, score, is_secret."""
    found = stored(findings(docs, id_col, text_col), "findings")
    trees, words = learn(found, labelled)
    scored = found.withColumn("x", features(F.col("value"), F.col("before"), F.col("after"), words)).withColumn(
        "score", forest_score(trees, F.col("x")))
    return scored.select("doc_id", "position", "start", F.length("value").alias("length"),
                         F.sha2("value", 256).alias("value_sha256"), F.round("score", 6).alias("score"),
                         (F.col("score") >= threshold).alias("is_secret"))


def redact(docs: DataFrame, labelled: DataFrame | None = None, threshold: float = SECRET_SCORE, id_col: str = "doc_id",
           text_col: str = "text", length_col: str | None = None, mask: str = MASK) -> DataFrame:
    """``docs`` with every secret in the text replaced by ``mask``; other columns and rows unchanged.

    ``length_col`` names a column that takes the new length in characters where a text changed.
    """
    found = stored(findings(docs, id_col, text_col), "findings")
    trees, words = learn(found, labelled)
    text = F.col(text_col)
    pieces = F.split(text, CANDIDATE, -1)
    shown = F.transform(finding_array(text), lambda z: F.when(
        forest_score(trees, features(z["value"], z["before"], z["after"], words)) >= threshold, F.lit(mask)).otherwise(z["value"]))
    rebuilt = F.array_join(F.transform(F.arrays_zip(pieces.alias("p"), shown.alias("s")),
                                       lambda z: F.concat(z["p"], F.coalesce(z["s"], F.lit("")))), "")
    masked = F.when(text.rlike(CANDIDATE), rebuilt).otherwise(text)
    if length_col is None:
        return docs.withColumn(text_col, masked)
    kind = docs.schema[length_col].dataType
    size = F.when(masked.eqNullSafe(text), F.col(length_col)).otherwise(F.length(masked).cast(kind))
    return docs.withColumns({text_col: masked, length_col: size})
