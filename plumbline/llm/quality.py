"""Quality rules: a threshold table compiled into one Spark projection.

`measures` gives every row its counts with built-in functions alone; `RULES` lists
(rule, ratio, comparison, threshold); `judge` compiles the table into one projection
that adds `kept` and `failed_rules`. One row out for each row in, in a single scan
without a shuffle, so skew of keys or copies cannot matter.

Edge cases: a null or blank text has no words and fails the length rule; repeated rows
are each judged alone; an empty table gives an empty result; further columns pass
through `judge` untouched, and measure names that clash with them replace them.
Text of any length is judged whole; repeats are found by sorting 64-bit window hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, packed, unpacked, white_words

# Fixed values: frequent function words of the four languages of the corpus.
STOP_WORDS = (
    "a an and are as at be by for from he in is it of on or that the this to was with "
    "au avec ce dans de des du elle en est et il la le les ou par pour que qui sur un une "
    "auf das dem den der die ein eine für ich im in ist mit nicht sich und von zu "
    "al con de del el en es esta la las lo los no para por que se su un una y"
).split()

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words", "n_shouts")

#: (rule, numerator, denominator or None, comparison that fails, threshold).
RULES = (
    ("too_short", "n_words", None, "<", 10),
    ("repeated_windows", "n_repeat_words", "n_words", ">", 0.20),
    ("word_length_low", "word_chars", "n_words", "<", 2.0),
    ("word_length_high", "word_chars", "n_words", ">", 25.0),
    ("symbols", "n_symbols", "n_words", ">", 0.30),
    ("shouting", "n_shouts", "n_words", ">", 0.60),
    ("repeated_lines", "n_dup_lines", "n_lines", ">", 0.50),
    ("no_stop_words", "n_stop_words", "n_words", "<", 0.005),
)
#: The two rules of the base, whatever table is used.
BASE_RULES = RULES[:2]
#: Stop words are asked for only where a text is long enough for their absence to mean something.
STOP_FROM_WORDS = 60


def measures(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """keep (default: all columns but the measures' names) and the columns of MEASURES, all long."""
    names, row = packed(docs, (*MEASURES, "base_failed", "failed_rules", "kept"), keep)
    keep = ["row__"]
    t = F.coalesce(F.col(text), F.lit(""))
    stops = sorted({w for s in STOP_WORDS for w in (s, s.capitalize(), s.upper())})
    words = let(docs, row__=row, t=t, w=white_words(F.col(text)), lines=F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    counted = let(
        words, *keep,
        n_words=F.size("w").cast("long"),
        word_chars=F.length(F.array_join("w", "")).cast("long"),
        n_symbols=(F.length("t") - F.length(F.regexp_replace("t", "[#*$%&|<>]", ""))).cast("long"),
        n_lines=F.size("lines").cast("long"),
        n_dup_lines=(F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
        n_stop_words=F.size(F.filter("w", lambda x: x.isin(stops))).cast("long"),
        n_shouts=((F.length("t") - F.length(F.replace("t", F.lit("!!"), F.lit("")))) / 2).cast("long"),
        h=F.transform("w", lambda x: F.xxhash64(x)),
    )  # fmt: skip
    wins = let(
        counted, *keep, *[m for m in MEASURES if m != "n_repeat_words"],
        g=F.when(F.col("n_words") < 5, F.array().cast("array<bigint>")).otherwise(
            F.transform(F.sequence(F.lit(0), (F.col("n_words") - 5).cast("int")), lambda i: F.xxhash64(*[F.get("h", i + k) for k in range(5)]))
        ),
    )  # fmt: skip
    # Only texts with a window hash twice pay for the sort that finds where.
    sorted_ = let(
        wins, *keep, *[m for m in MEASURES if m != "n_repeat_words"],
        s=F.when(F.size(F.array_distinct("g")) == F.size("g"), F.array().cast("array<struct<h:bigint,i:int>>")).otherwise(
            F.sort_array(F.transform("g", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        ),
    )  # fmt: skip
    twice = let(
        sorted_, *keep, *[m for m in MEASURES if m != "n_repeat_words"],
        at=F.sort_array(
            F.transform(
                F.filter("s", lambda x, i: (F.coalesce(F.get("s", i - 1)["h"] == x["h"], F.lit(False))) | (F.coalesce(F.get("s", i + 1)["h"] == x["h"], F.lit(False)))),
                lambda x: x["i"],
            )
        ),
    )  # fmt: skip
    # A repeated window at i covers five words, or up to the next repeated window.
    covered = F.aggregate(F.transform("at", lambda p, k: F.least(F.coalesce(F.get("at", k + 1) - p, F.lit(5)), F.lit(5))), F.lit(0), lambda a, x: a + x)
    return twice.select(*unpacked(names), *[covered.cast("long").alias(m) if m == "n_repeat_words" else F.col(m) for m in MEASURES])


def fails(rule: tuple) -> Column:
    """The rule's condition; ratios are compared as products, so no text divides by zero."""
    name, top, bottom, sign, threshold = rule
    a = F.col(top).cast("double")
    b = F.lit(float(threshold)) * (F.col(bottom) if bottom else F.lit(1))
    if bottom and float(threshold) * 100 == int(float(threshold) * 100):  # whole hundredths compare exactly
        a, b = F.col(top) * 100, F.lit(int(float(threshold) * 100)) * F.col(bottom)
    bad = a < b if sign == "<" else a > b
    return bad & (F.col("n_words") >= STOP_FROM_WORDS) if name == "no_stop_words" else bad


def judge(docs: DataFrame, text: str = "text", rules: tuple = RULES, keep: list[str] | None = None) -> DataFrame:
    """measures, base_failed, kept and failed_rules (names, in table order)."""
    m = measures(docs, text, keep)
    bad = F.array_compact(F.array(*[F.when(fails(r), F.lit(r[0])) for r in rules]))
    base = fails(BASE_RULES[0]) | fails(BASE_RULES[1])
    return m.withColumns({"base_failed": base, "failed_rules": bad}).withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))


def op8_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = judge(docs, keep=["doc_id"])
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.array_join("failed_rules", ",").alias("failed_rules"))


def _fails_sql(rule: tuple) -> str:
    name, top, bottom, sign, threshold = rule
    whole = bottom and float(threshold) * 100 == int(float(threshold) * 100)
    bad = f"{top} * 100 {sign} {int(float(threshold) * 100)} * {bottom}" if whole else f"{top} {sign} {threshold}::double * {bottom or 1}"
    return f"({bad} and n_words >= {STOP_FROM_WORDS})" if name == "no_stop_words" else f"({bad})"


_STOPS = ", ".join(f"'{w}'" for w in sorted({w for s in STOP_WORDS for w in (s, s.capitalize(), s.upper())}))
#: The same table compiled for another engine: windows and lines are rows there.
ORACLE = rf"""
with t as (select doc_id, coalesce(text, '') as t from documents),
w as (select doc_id, t, list_filter(regexp_split_to_array(t, '[ 	-]+'), lambda x: x <> '') as w,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ 	-]')) as l from t),
g as (select doc_id, i, w[i:i + 4] as g from w, unnest(range(1, greatest(len(w) - 3, 1))) as r(i) where len(w) >= 5),
twice as (select doc_id, i from g qualify count(*) over (partition by doc_id, g) > 1),
covered as (select doc_id, count(distinct p) as n_repeat_words from (select doc_id, unnest(range(i, i + 5)) as p from twice) group by 1),
m as (select w.doc_id, len(w) as n_words, length(array_to_string(w, '')) as word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as n_symbols,
  len(l) as n_lines, len(l) - len(list_distinct(l)) as n_dup_lines, len(list_filter(w, lambda x: x in ({_STOPS}))) as n_stop_words,
  (length(t) - length(replace(t, '!!', ''))) // 2 as n_shouts, coalesce(n_repeat_words, 0) as n_repeat_words from w left join covered c on c.doc_id = w.doc_id),
f as (select *, list_filter([{", ".join(f"case when {_fails_sql(r)} then '{r[0]}' end" for r in RULES)}], lambda x: x is not null) as f from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {_fails_sql(BASE_RULES[0])} or {_fails_sql(BASE_RULES[1])} as base_failed, len(f) = 0 as kept, array_to_string(f, ',') as failed_rules from f
"""
