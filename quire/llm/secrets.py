"""Secret scans: candidates by pattern, false positives removed by a random forest.

DataFrame and Spark ML functions only.  A candidate is a run of 15 or more characters of
``[A-Za-z0-9+/_-]`` with a digit in it (or a provider's format without one), plus up to two ``=``; or any
quoted or unspaced value of 6 or more characters right after a keyword and ``=`` or ``:``.
Its features: length, character classes and transitions between them, distinct characters, share of its characters covered by dictionary words,
the kind of path the document comes from, and the words on both sides (hashed buckets).  The dictionary is the corpus
itself: the words that all documents have outside the candidates, if at least ``WORD_SHARE`` of all words.  The forest is trained on labelled findings - a
table given by the caller, or the findings whose label follows from their form: provider formats and
assigned mixed values are secrets; plain numbers, UUIDs, checksums named as such, parts of addresses,
placeholders and values made of dictionary words are not.  Label forms look at the value and its neighbours; everything else is judged by the
forest.  At most ``MAX_LABELLED`` labelled findings (those with the smallest hash) train it.

Defined results: null and empty texts have no candidates; rows repeated in full give their candidates
each time; where the labelled findings do not hold both labels there is nothing to learn from and every
candidate stays a finding (probability null), except those labelled as no secret; an empty table gives
an empty result; a very long text is scanned whole; only the named columns are read.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.sample import smallest
from quire.llm.text import text_of
from quire.session import cut_lineage

CONTEXT = 40             # characters kept on both sides
MAX_LABELLED = 20_000
WORD_SHARE = 1e-6        # of all words, and two occurrences, make a dictionary word at any corpus size
TREES, DEPTH, SEED = 40, 6, 7

KEYWORD = r"(?i)(secret|token|passwo?r?d|passwd|pwd|api[_ -]?key|access[_ -]?key|credential|auth|bearer|private)"
# A value behind a keyword: in quotes, or up to white space, without punctuation at its end.
ASSIGNED = (r"(?<=[=:]\s{0,4}[\"'`]?)(?<=(?i:secret|token|passwo?r?d|passwd|pwd|api[_ -]?key|access[_ -]?key|credential|auth|bearer|private)"
            r"\w{0,20}[\"'`]?\s{0,4}[=:]\s{0,4}[\"'`]?)"
            r"(?:(?<=\")[^\"\r\n]{6,}(?=\")|(?<=')[^'\r\n]{6,}(?=')|(?<=`)[^`\r\n]{6,}(?=`)|(?<![\"'`])[^\s\"'`=:][^\s\"'`]{4,}[^\s\"'`,;.)\]}>])")
RUN = r"(?<![A-Za-z0-9+/_\-])(?=[A-Za-z+/_\-]*[0-9]|A[KS]IA[0-9A-Z]{16})[A-Za-z0-9+/_\-]{15,}={0,2}"
CANDIDATE = f"{ASSIGNED}|{RUN}"
PROVIDER = r"^(AKIA[0-9A-Z]{16}|ASIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|[sr]k_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35})$"
UUID = r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"
CHECKSUM = r"(?i)(sha-?[0-9]*|md5|checksum|digest|commit|revision|etag|integrity)\W{0,3}$"
PLACEHOLDER = r"(?i)(example|sample|placeholder|changeme|dummy|x{6,}|0{8,}|123456789|abcdef)"
ADDRESS = r"(@|://)\S*$"

MARK = "\uffff"          # set around candidates; no character, one of a text counts as U+FFFD
WORD_BUCKETS = 24        # of the hash of a neighbouring word

FEATURES = ["length", "digits", "uppers", "lowers", "transitions", "distinct_chars", "is_hex", "covered", "path_kind",
            "keyword_before", "assigned", "quoted", "word_before", "word_after", "address_before"]


def candidates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """id, path, start, stop (code points, end exclusive), value, before, after - one row per candidate.

    The gaps between candidates are the text split at them, so offsets are running sums of lengths."""
    return located(marked(df, id_col, text_col, path_col))


def marked(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """id, path, parts: each text cut at its candidates, found in one pass; gaps and candidates take turns."""
    text = F.translate(text_of(F.col(text_col)), MARK, "\ufffd")
    parts = F.split(F.regexp_replace(text, f"(?:{CANDIDATE})", f"{MARK}$0{MARK}"), MARK, -1)
    return df.select(F.col(id_col).alias("id"), F.col(path_col).cast("string").alias("path"), parts.alias("parts"))


def located(rows: DataFrame) -> DataFrame:
    """The candidates of ``marked`` rows, as ``candidates`` gives them."""
    every = lambda odd: F.filter("parts", lambda _, i: i % 2 == odd)
    rows = rows.where(F.size("parts") > 1).select("id", "path", every(1).alias("values"), every(0).alias("gaps"))
    starts = F.aggregate(
        F.arrays_zip(F.slice("gaps", 1, F.size("values")).alias("gap"), F.col("values").alias("value")),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")),
        lambda a, x: F.struct((a["at"] + F.length(x["gap"]) + F.length(x["value"])).alias("at"),
                              F.concat(a["out"], F.array(a["at"] + F.length(x["gap"]))).alias("out")))["out"]
    found = rows.select("id", "path", F.explode(F.arrays_zip(
        F.col("values").alias("value"), starts.alias("start"), F.slice("gaps", 1, F.size("values")).alias("left"),
        F.slice("gaps", 2, F.size("values")).alias("right"))).alias("c"))
    return found.select(
        "id", "path", "c.start", (F.col("c.start") + F.length("c.value")).alias("stop"), "c.value",
        F.right("c.left", F.lit(CONTEXT)).alias("before"), F.left("c.right", F.lit(CONTEXT)).alias("after"))


def word_counts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """word, n over all documents: runs of three or more letters, lower case.  Counts combine in each task first."""
    words = df.select(F.explode(F.split(F.lower(text_of(F.col(text_col))), r"[^\p{L}]+")).alias("word"))
    return words.where(F.length("word") >= 3).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def dictionary(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The word counts of the text outside the candidates, without words rarer than WORD_SHARE.

    Copies of a secret thus never make its own letters words."""
    only = df.select(text_of(F.col(text_col)).alias("text"), F.lit(None).alias("path"))
    return known_words(marked(only, "text", "text", "path"))


def known_words(rows: DataFrame) -> DataFrame:
    """The dictionary from the gaps of ``marked`` rows."""
    outside = F.array_join(F.filter("parts", lambda _, i: i % 2 == 0), " ")
    words = cut_lineage(word_counts(rows.select(outside.alias("text"))))
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return words.where(F.col("n") >= WORD_SHARE * total)


def share(col: Column, pattern: str) -> Column:
    """Share of the characters that belong to the class ``pattern``."""
    return F.length(F.regexp_replace(col, f"[^{pattern}]", "")) / F.length(col)


def with_features(found: DataFrame, words: DataFrame, min_count: int = 2) -> DataFrame:
    """The candidates with FEATURES.  The value's letter runs are looked up among the corpus words."""
    keyed = cut_lineage(found.withColumn("cid", F.monotonically_increasing_id()))
    runs = keyed.select("cid", F.explode(F.split(F.lower("value"), r"[^\p{L}]+")).alias("word")).where(F.length("word") >= 3)
    known = runs.join(words.where(F.col("n") >= min_count), "word").groupBy("cid").agg(F.sum(F.length("word")).alias("known"))
    v, before, after = F.col("value"), F.col("before"), F.col("after")
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(v, "[0-9]+", "9"), "[a-z]+", "a"), "[A-Z]+", "A")
    yes = lambda cond: cond.cast("double")
    # The word itself as a hashed bucket, 0 for none.
    bucket = lambda word: F.when(word == "", 0.0).otherwise(1.0 + F.pmod(F.xxhash64(F.lower(word)), F.lit(WORD_BUCKETS)))
    return keyed.join(known, "cid", "left").withColumns({
        "length": F.length(v).cast("double"), "digits": share(v, "0-9"), "uppers": share(v, "A-Z"), "lowers": share(v, "a-z"),
        "transitions": (F.length(shape) - 1) / F.length(v), "distinct_chars": F.size(F.array_distinct(F.split(v, ""))) / F.length(v),
        "is_hex": yes(v.rlike("^[0-9a-fA-F]+$")), "covered": F.coalesce(F.col("known"), F.lit(0)) / F.length(v),
        "path_kind": F.when(F.col("path").isNull(), 0.0).when(F.col("path").rlike(r"(?i)(test|spec|example|fixture|doc)"), 1.0)
        .when(F.col("path").rlike(r"(?i)\.(env|ya?ml|json|ini|cfg|conf|properties|toml|pem)$"), 3.0).otherwise(2.0),
        "keyword_before": yes(before.rlike(KEYWORD)), "assigned": yes(before.rlike(r"[=:]\s*[\"']?$")), "quoted": yes(before.rlike("[\"'`]$")),
        "word_before": bucket(F.regexp_extract(before, r"(\p{L}{2,})\W{0,3}$", 1)), "word_after": bucket(F.regexp_extract(after, r"^\W{0,3}(\p{L}{2,})", 1)),
        "address_before": yes(before.rlike(ADDRESS))}).drop("known")


def form_label() -> Column:
    """1.0, 0.0 or null by the finding's form: harmless forms, provider formats, dictionary words, assigned values."""
    v, before, after = F.col("value"), F.col("before"), F.col("after")
    harmless = (v.rlike("^[0-9_/+-]+=*$") | v.rlike(UUID) | v.rlike(PLACEHOLDER) | before.rlike(CHECKSUM) | before.rlike(ADDRESS) | after.rlike("^@"))
    mixed = v.rlike("[0-9]") & v.rlike("[A-Za-z]")
    assigned = mixed & before.rlike(KEYWORD + r"\w*\s*[=:]\s*[\"']?$")
    return F.when(harmless, 0.0).when(v.rlike(PROVIDER), 1.0).when(F.col("covered") >= 0.75, 0.0).when(assigned, 1.0)


def train(labelled: DataFrame, max_labelled: int = MAX_LABELLED) -> RandomForestClassificationModel | None:
    """The forest over rows of FEATURES and ``label``; None unless both labels occur.

    The sample is bounded and brought into one sorted partition, so that reruns grow the same trees."""
    hashed = labelled.select(*FEATURES, "label", F.xxhash64("id", "start", "value").alias("h"))
    sample = cut_lineage(smallest(hashed, max_labelled, "h", tuple(FEATURES)).coalesce(1))
    if sample.select("label").distinct().count() < 2:
        return None
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(sample.coalesce(1).sortWithinPartitions("h", *FEATURES))
    return RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="sqrt").fit(rows)


def judge(rows: DataFrame, model: RandomForestClassificationModel | None) -> DataFrame:
    """``rows`` of FEATURES with probability (of a secret)."""
    if model is None:
        return rows.withColumn("probability", F.lit(None).cast("double"))
    scored = model.transform(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows))
    return scored.withColumn("probability", vector_to_array("probability")[1]).drop("features", "rawPrediction", "prediction")


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source", labels: DataFrame | None = None,
         max_labelled: int = MAX_LABELLED) -> DataFrame:
    """One row per candidate: id, start, stop, value, label, probability, is_secret.

    ``labels`` (id, start, label) overrides the labels that follow from the form."""
    parts = cut_lineage(marked(df, id_col, text_col, path_col))  # the one pass of the patterns
    found = cut_lineage(with_features(located(parts), known_words(parts)).withColumn("label", form_label()))
    if labels is not None:
        given = labels.select(F.col("id").alias("__id"), F.col("start").alias("__start"), F.col("label").cast("double").alias("__label"))
        found = cut_lineage(found.join(given, found["id"].eqNullSafe(given["__id"]) & (found["start"] == given["__start"]), "left")
                            .withColumn("label", F.coalesce("__label", "label")).drop("__id", "__start", "__label"))
    scored = judge(found, train(found.where("label IS NOT NULL"), max_labelled))
    verdict = F.coalesce(F.col("probability") >= 0.5, F.coalesce(F.col("label"), F.lit(1.0)) > 0)
    return scored.select("id", "start", "stop", "value", "label", "probability", verdict.alias("is_secret"))


def q_secret_scan(spark, sf_dir) -> DataFrame:
    from quire.session import table

    found = scan(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("end"),
                        F.sha2("value", 256).alias("value_sha256"), "label", F.round("probability", 6).alias("probability"), "is_secret")
