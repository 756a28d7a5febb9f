"""Quality rules as a bitmask ledger (DataFrame functions only).

Every rule is evaluated once per document.  The ledger stores the measurements and one
``fail_bits`` value whose bit *r* is set when rule *r* fails.  Policies are versioned
masks over these bits: a document is kept under a policy when none of the policy's rules
failed.  Changing a policy, or asking what a rule costs, never touches the text again:
ablations group the ledger by ``fail_bits`` (at most ``2 ** len(RULES)`` rows) and work
on those counts with bitwise operations.

Measurements follow the word set ``[^\\x20\\x09-\\x0D]+``:
``n_words``; ``word_chars`` (code points in words); ``n_symbols`` (characters of
``[#*$%&|<>]``); ``n_lines`` (lines with a word); ``n_dup_lines`` (of these, equal to an
earlier one); ``n_repeat_words`` (words inside a 3-word window that occurs at least twice
in the text); ``n_upper`` (upper-case letters).

Defined results: null and empty texts have no words and fail ``few_words``; ratios are
compared as integer products, so nothing divides by zero; repeated rows are judged row by
row; an empty table gives an empty ledger; ``measure`` reads only the identifier and the
text, ``keep_good`` returns the input columns whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.text import let, text_of, words_of

# Bits of a packed window key that hold the window's position (texts of up to 2^30 words).
POS_BITS = 30

# name -> failure condition over the measurements; the position in this table is the bit.
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeated_windows": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 15 * n_words",
    "duplicate_lines": "10 * n_dup_lines > 3 * n_lines",
    "shouting": "2 * n_upper > word_chars",
}
BIT = {name: 1 << i for i, name in enumerate(RULES)}
BASE = BIT["few_words"] | BIT["repeated_windows"]

# Policy versions are never edited; a change gets a new version.
POLICIES: dict[str, int] = {
    "v1": BASE,
    "v2": BASE | BIT["symbols"] | BIT["duplicate_lines"] | BIT["shouting"],
    # By ablation on labelled documents, duplicate_lines alone rejects only good ones; it stays in the ledger.
    "v3": sum(BIT.values()) - BIT["duplicate_lines"],
}
CURRENT = "v3"


def repeat_words(words: Column) -> Column:
    """Words covered by a 3-word window found at least twice in the text.

    One 64-bit key per window packs a hash and the position; sorting the primitive keys
    puts equal windows side by side.  Windows whose hash meets a neighbour's are compared
    by their words, so hash collisions change nothing.  Time is n log n in the words."""
    pos_mask = F.lit((1 << POS_BITS) - 1).cast("long")

    def candidates(w: Column) -> Column:
        keys = F.sort_array(F.transform(
            F.sequence(F.lit(0), F.size(w) - 3),
            lambda i: F.shiftleft(F.xxhash64(w[i], w[i + 1], w[i + 2]), POS_BITS).bitwiseOR(i.cast("long"))))
        return let(keys, lambda k: F.transform(
            F.filter(k, lambda x, j: (
                ((j > 0) & (F.shiftright(x, POS_BITS) == F.shiftright(F.get(k, j - 1), POS_BITS)))
                | ((j < F.size(k) - 1) & (F.shiftright(x, POS_BITS) == F.shiftright(F.get(k, j + 1), POS_BITS))))),
            lambda x: x.bitwiseAND(pos_mask).cast("int")))

    def found_twice(w: Column, at: Column) -> Column:
        windows = F.sort_array(F.transform(at, lambda p: F.struct(
            F.concat_ws(" ", w[p], w[p + 1], w[p + 2]).alias("g"), p.alias("p"))))
        return let(windows, lambda s: F.sort_array(F.transform(
            F.filter(s, lambda x, j: (
                ((j > 0) & (x["g"] == F.get(s, j - 1)["g"])) | ((j < F.size(s) - 1) & (x["g"] == F.get(s, j + 1)["g"])))),
            lambda x: x["p"])))

    def covered(p: Column) -> Column:
        steps = F.transform(p, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(p, j + 1) - x, F.lit(3))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    def count(w: Column) -> Column:
        return let(candidates(w), lambda at: F.when(F.size(at) == 0, F.lit(0).cast("long")).otherwise(
            let(found_twice(w, at), covered)))

    return F.when(F.size(words) < 3, F.lit(0).cast("long")).otherwise(let(words, count))


def measure(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and the measurements, one row per input row (narrow: no shuffle)."""
    text = text_of(F.col(text_col))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    parts = df.select(F.col(id_col).alias("id"), text.alias("t"), words_of(F.col(text_col)).alias("w"), lines.alias("l"))
    return parts.select(
        "id",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.concat_ws("", "w")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("t", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.size("l").cast("long").alias("n_lines"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("w")).alias("n_repeat_words"),
        F.length(F.regexp_replace("t", r"\P{Lu}+", "")).cast("long").alias("n_upper"))


def ledger(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The measurements plus ``fail_bits``; every rule evaluated once."""
    bits = None
    for name, fails in RULES.items():
        bit = F.when(F.expr(fails), F.lit(BIT[name])).otherwise(F.lit(0)).cast("long")
        bits = bit if bits is None else bits.bitwiseOR(bit)
    return measure(df, id_col, text_col).withColumn("fail_bits", bits)


def passes(policy: str = CURRENT, bits: str = "fail_bits") -> Column:
    return F.col(bits).bitwiseAND(F.lit(POLICIES[policy]).cast("long")) == 0


def ablations(led: DataFrame, policies: dict[str, int] | None = None) -> DataFrame:
    """Per policy and rule: documents, rejected, rejected without the rule, rejected by it alone.

    Works on the ledger's histogram of ``fail_bits``; also gives the rules that ever failed
    (``seen_bits``) by a bitwise aggregate."""
    hist = led.groupBy("fail_bits").agg(F.count(F.lit(1)).alias("n"))
    cases = F.array(*[
        F.struct(F.lit(p).alias("policy"), F.lit(r).alias("rule"), F.lit(mask).cast("long").alias("mask"), F.lit(BIT[r]).cast("long").alias("bit"))
        for p, mask in (policies or POLICIES).items() for r in RULES if mask & BIT[r]])
    per_case = hist.select("fail_bits", "n", F.explode(cases).alias("c")).select("fail_bits", "n", "c.*")
    failed = F.col("fail_bits").bitwiseAND(F.col("mask"))
    without = F.col("fail_bits").bitwiseAND(F.col("mask").bitwiseAND(F.bitwise_not(F.col("bit"))))
    n = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(F.lit(0)))
    return per_case.groupBy("policy", "rule").agg(
        F.sum("n").alias("documents"), n(failed != 0).alias("rejected"), n(without != 0).alias("rejected_without"),
        n(failed == F.col("bit")).alias("only_by_rule"), F.bit_or("fail_bits").alias("seen_bits"))


def keep_good(df: DataFrame, policy: str = CURRENT, text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that pass the policy, all columns unchanged (narrow: no shuffle)."""
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    carried = df.select(row.alias("row"), F.col(text_col).alias("text"))
    return ledger(carried, "row", "text").where(passes(policy)).select("id.*")


def q_quality_rules(spark, sf_dir) -> DataFrame:
    from quire.session import table

    led = ledger(table(spark, sf_dir, "documents"))
    return led.select(
        F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (F.col("fail_bits").bitwiseAND(F.lit(BASE).cast("long")) != 0).alias("base_failed"),
        passes().alias("kept"), "fail_bits", F.lit(CURRENT).alias("policy"))


SQL_QUALITY_RULES = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), pos AS (
  SELECT doc_id, w, unnest(range(len(w) - 2)) AS i FROM d WHERE len(w) >= 3
), win AS (
  SELECT doc_id, i, w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] AS g FROM pos
), twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1
), gaps AS (
  SELECT doc_id, least(3, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 3)) AS c FROM twice
), rep AS (
  SELECT doc_id, sum(c) AS n_repeat_words FROM gaps GROUP BY doc_id
), line AS (
  SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d
), lines AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup_lines
  FROM line WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id
), m AS (
  SELECT d.doc_id, len(w) AS n_words,
    length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
    length(regexp_replace(t, '\P{Lu}+', '', 'g')) AS n_upper,
    coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM d LEFT JOIN rep ON d.doc_id = rep.doc_id LEFT JOIN lines ON d.doc_id = lines.doc_id
), b AS (
  SELECT *,
    (CASE WHEN n_words < 50 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END)
    + (CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END) + (CASE WHEN word_chars < 2 * n_words THEN 8 ELSE 0 END)
    + (CASE WHEN word_chars > 15 * n_words THEN 16 ELSE 0 END) + (CASE WHEN 10 * n_dup_lines > 3 * n_lines THEN 32 ELSE 0 END)
    + (CASE WHEN 2 * n_upper > word_chars THEN 64 ELSE 0 END) AS fail_bits
  FROM m
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
  CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, (fail_bits & 3) <> 0 AS base_failed,
  (fail_bits & 95) = 0 AS kept, CAST(fail_bits AS BIGINT) AS fail_bits, 'v3' AS policy
FROM b
"""
