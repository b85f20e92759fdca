"""Secret scans (operator 8), with DataFrame operations alone.

Candidates are long runs of characters that keys are made of, and values after an equals sign or a
colon. A random forest tells secrets from words, paths and names. It sees the length of a candidate,
the changes between kinds of characters, the part that words of the corpus cover, whether it is part
of a path, and the words beside it. It is trained from labelled findings: ``labelled`` has the columns
of ``candidates`` and a 0/1 ``label``. Without labels from people, ``weak_labels`` marks the findings
whose kind is plain from their form or their key. Training takes at most ``LABELLED`` findings of each
label, chosen by hash.

Each distinct text is scanned once; copies join its findings. Results hold offsets in characters and
a hash of the value, not the value.

Defined results: null and empty texts have no findings; repeated rows each get theirs; if the labels
are all alike, or there are none, no forest can be trained and every candidate is kept; other columns
are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaylane.llm.common import content_key
from assaylane.session import materialize

LABELLED = 10_000  # findings of each label in training
TREES, DEPTH, SEED = 30, 6, 11
SPOKEN = 20  # a word of the dictionary occurs in the corpus as often

CANDIDATE = (
    r"(?<![A-Za-z0-9+/_\-])[A-Za-z0-9+/_\-]{16,}={0,2}"
    r"|(?<=[=:][\"' ]{0,2})[A-Za-z0-9+/_\-!@#$%^&*.]{8,}"
)
_KEY = r"(?i)(pass(word|wd|phrase)?|pwd|secret|token|credential|auth|bearer|api[_-]?key|access[_-]?key|private[_-]?key)"
_NEAR, _PROVIDER = _KEY + r"[\w-]*[\"']?\s*[=:]?\s*[\"']?$", r"^(AKIA|ASIA)[0-9A-Z]{16}$|^gh[pousr]_\w{20,}$|^xox[abpr]-|^sk_live_"
_HARMLESS = r"(?i)(example(?!\.)|sample|dummy|placeholder|changeme|your[_-])"

FEATURES = (
    "f_length f_digits f_upper f_lower f_symbols f_changes f_distinct f_vowels f_hex f_covered f_path f_key f_assigned "
    "f_quoted f_provider f_harmless"
).split()


def _share(value: str, pattern: str) -> Column:
    return F.regexp_count(value, F.lit(pattern)) / F.length(value)


def texts_with_candidates(docs: DataFrame, text: str) -> DataFrame:
    """Distinct findings: k1, k2 (the text), start, value, before, after."""
    t = F.col(text).cast("string")
    scanned = docs.where(t.rlike(CANDIDATE)).select(
        *content_key(t),
        F.regexp_extract_all(t, F.lit(CANDIDATE), F.lit(0)).alias("values"),
        F.split(t, CANDIDATE, -1).alias("between"),
    )
    parts = scanned.select(
        "k1",
        "k2",
        F.posexplode(
            F.transform(
                "values",
                lambda v, i: F.struct(
                    v.alias("value"),
                    F.length(F.get("between", i)).alias("gap"),
                    F.right(F.get("between", i), F.lit(48)).alias("before"),
                    F.left(F.get("between", i + 1), F.lit(32)).alias("after"),
                ),
            )
        ).alias("nth", "c"),
    ).select("k1", "k2", "nth", "c.*")
    once = parts.dropDuplicates(["k1", "k2", "nth"])
    upto = Window.partitionBy("k1", "k2").orderBy("nth")
    start = F.sum(F.col("gap") + F.length("value")).over(upto) - F.length("value")
    return once.select("k1", "k2", start.cast("int").alias("start"), "value", "before", "after")


def word_counts(docs: DataFrame, text: str) -> DataFrame:
    """How often each lower-case ASCII word of three letters or more stands alone in the corpus."""
    words = F.explode(F.split(F.lower(F.col(text).cast("string")), "[^a-z]+"))
    return docs.select(words.alias("word")).where(F.length("word") >= 3).groupBy("word").agg(F.count("*").alias("n"))


def candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """Findings with their features."""
    found = materialize(texts_with_candidates(docs, text))
    pieces = found.select(
        F.xxhash64("value").alias("vh"), "value", F.explode(F.regexp_extract_all(F.lower("value"), F.lit("[a-z]{3,}"), F.lit(0))).alias("word")
    ).dropDuplicates(["vh", "value", "word"])
    spoken = materialize(word_counts(docs, text).where(F.col("n") >= SPOKEN))
    covered = (
        pieces.join(spoken.select("word"), "word")
        .groupBy("value")
        .agg(F.sum(F.length("word")).alias("covered"))
    )
    value, before = F.col("value"), F.col("before")
    flag = lambda c: c.cast("double")
    return found.join(covered, "value", "left").select(
        "k1", "k2", "start", "value", "before", "after",
        F.least(F.length("value"), F.lit(200)).cast("double").alias("f_length"),
        _share("value", "[0-9]").alias("f_digits"),
        _share("value", "[A-Z]").alias("f_upper"),
        _share("value", "[a-z]").alias("f_lower"),
        _share("value", "[^A-Za-z0-9]").alias("f_symbols"),
        _share("value", "(?<=[a-z])[^a-z]|(?<=[A-Z])[^A-Z]|(?<=[0-9])[^0-9]").alias("f_changes"),
        (F.size(F.array_distinct(F.split("value", ""))) / F.length("value")).alias("f_distinct"),
        _share("value", "[aeiouAEIOU]").alias("f_vowels"),
        flag(value.rlike("^[0-9a-fA-F]+$")).alias("f_hex"),
        F.least(F.lit(1.0), F.coalesce("covered", F.lit(0)) / F.length("value")).alias("f_covered"),
        flag(value.rlike("/[^/]+/|^/") | before.rlike(r"(://|\\|/)$")).alias("f_path"),
        flag(before.rlike(_NEAR)).alias("f_key"),
        flag(before.rlike(r"[=:]\s*[\"']?$")).alias("f_assigned"),
        flag(before.rlike("[\"']$") & F.col("after").rlike("^[\"']")).alias("f_quoted"),
        flag(value.rlike(_PROVIDER)).alias("f_provider"),
        flag(value.rlike(_HARMLESS) | before.rlike(_HARMLESS)).alias("f_harmless"),
    )


def weak_labels(findings: DataFrame) -> DataFrame:
    """The findings whose kind is plain. 1: the form of a known provider, or a value with digits given to a key;
    0: letters alone without a key, paths, and what is marked as an example."""
    value = F.col("value")
    keyed = (F.col("f_key") == 1) & (F.col("f_assigned") == 1) & (F.col("f_digits") >= 0.1)
    secret = (F.col("f_provider") == 1) | keyed
    word = (F.col("f_digits") == 0) & (F.col("f_key") == 0) & value.rlike("^[A-Za-z_./-]+$")
    harmless = (F.col("f_harmless") == 1) | word | ((F.col("f_path") == 1) & (F.col("f_key") == 0))
    label = F.when(harmless, 0.0).when(secret, 1.0)
    return findings.withColumn("label", label).where("label IS NOT NULL")


def _training_rows(labelled: DataFrame) -> DataFrame:
    order = F.xxhash64("value", "before", "k1", "start")
    parts = [
        labelled.where(F.col("label") == kind).select(*FEATURES, "label", order.alias("o")).orderBy("o", *FEATURES).limit(LABELLED)
        for kind in (0.0, 1.0)
    ]
    return materialize(parts[0].union(parts[1]).coalesce(1))


def scan(docs: DataFrame, labelled: DataFrame | None = None, text: str = "text") -> DataFrame:
    """What the forest keeps of the candidates of all distinct texts: k1, k2, start, value, probability."""
    found = materialize(candidates(docs, text))
    rows = _training_rows(weak_labels(found) if labelled is None else labelled)
    columns = ["k1", "k2", "start", "value", "probability"]
    if rows.select("label").distinct().count() < 2:
        return found.withColumn("probability", F.lit(1.0)).select(*columns)
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="features")
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, probabilityCol="p", rawPredictionCol="r")
    model = forest.fit(vectors.transform(rows))
    scored = model.transform(vectors.transform(found))
    return scored.withColumn("probability", F.round(vector_to_array("p")[1], 6)).where("probability >= 0.5").select(*columns)


def find_secrets(docs: DataFrame, labelled: DataFrame | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per secret and row: ``key``, start, length, value_sha256, probability."""
    found = materialize(scan(docs, labelled, text))
    rows = docs.select(F.col(key).alias("key"), *content_key(F.col(text).cast("string")))
    return rows.join(found, ["k1", "k2"]).select(
        F.col("key").alias(key),
        "start",
        F.length("value").alias("length"),
        F.sha2("value", 256).alias("value_sha256"),
        "probability",
    )


def redact(docs: DataFrame, labelled: DataFrame | None = None, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret replaced; other columns as they are, whatever their names."""
    found = scan(docs, labelled, text)
    values = materialize(
        found.groupBy(F.col("k1").alias("__k1"), F.col("k2").alias("__k2")).agg(
            F.reverse(F.array_sort(F.collect_set(F.struct(F.length("value").alias("n"), "value")))).alias("__values")
        )
    )
    names = docs.columns
    own = F.coalesce(F.col(text).cast("string").rlike(CANDIDATE), F.lit(False))
    first, second = content_key(F.col(text).cast("string"))
    # rows without a candidate stay where they are
    row = docs.where(own).select(F.struct(*names).alias("row"), first.alias("__k1"), second.alias("__k2"))
    clean = F.aggregate("__values", F.col(f"row.{text}"), lambda t, v: F.replace(t, v["value"], F.lit(mark)))
    joined = row.join(values, ["__k1", "__k2"], "left").withColumn("clean", F.coalesce(clean, F.col(f"row.{text}")))
    told = joined.select(*[F.col("clean").alias(c) if c == text else F.col(f"row.{c}").alias(c) for c in names])
    return told.union(docs.where(~own))
