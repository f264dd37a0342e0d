"""Static weakness scan: rules to findings, findings to per-sample results, and their homogeneity."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import flow, vocab
from ..functions import text as tx
from .kernels import pool_scores
from .stats import counts, diversity, top_k

FINDING = "array<struct<cwe:string,rule:string,line:int,matched:string,sink:string,severity:double,detector:string>>"


def _first_line(lines: Column, pattern: str) -> Column:
    """Number of the first line that matches and is no comment, from one."""
    hits = F.filter(F.transform(lines, lambda x, i: F.when(~tx.strip(x).startswith("#") & x.rlike("(?i)" + pattern), i + 1)), lambda i: i.isNotNull())
    return F.get(hits, F.lit(0))


def rule_findings(code: Column) -> Column:
    """The first match of each weakness class, in the rules' order.

    A rule's patterns are tried in turn and the first with any line stands for it. The fixed
    patterns are literals, compiled once; a pattern walks the lines only where the whole code
    has a match at all. Lines, the line found and its text are bound, so each is made once.
    """

    def in_lines(lines: Column) -> Column:
        found = []
        for cwe, name, patterns in vocab.WEAKNESS_RULES:
            line = F.coalesce(*[F.when(code.rlike("(?i)" + p), _first_line(lines, p)) for p in patterns])
            if cwe in vocab.RULE_EXCLUDED_BY:
                line = F.when(~code.rlike(vocab.RULE_EXCLUDED_BY[cwe]), line)
            found.append(tx.bind(line, _finding(tx.normalize_cwe(F.lit(cwe)), name, lines)))
        return F.array_compact(F.array(*found))

    return tx.bind(F.split(code, "\n"), in_lines).cast(FINDING)


def _finding(label: Column, name: str, lines: Column):
    def made(line: Column) -> Column:
        def with_text(m: Column) -> Column:
            return F.struct(label.alias("cwe"), F.lit(name).alias("rule"), line.cast("int").alias("line"), m.alias("matched"), tx.sink_signature(m).alias("sink"), tx.severity_of(label).alias("severity"), F.lit("regex").alias("detector"))

        return F.when(line.isNotNull(), tx.bind(F.substr(tx.strip(F.get(lines, line - 1)), F.lit(1), F.lit(120)), with_text))

    return made


def scan(samples: DataFrame, code: str = "code") -> DataFrame:
    """samples with findings and the fields derived from them; samples that are clean stay, with empty arrays.

    Each distinct code is scanned once: repeated answers are common, and the distinct codes are
    found by partial aggregation before anything is scanned.
    """
    parts = int(samples.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # The codes are few bytes and much work: adaptive execution would leave them to one task.
    codes = samples.select(F.col(code).alias("code_")).distinct().repartition(parts)
    # A filter on findings must not be pushed below them: it would scan every sample again to decide.
    once = derived(codes.select("code_", F.explode(F.array(rule_findings(F.col("code_")))).alias("findings")))
    return samples.join(once, F.col(code) == F.col("code_")).drop("code_")


def derived(scanned: DataFrame) -> DataFrame:
    """cwe_set, pattern_signature (sorted distinct), severity_total, is_vulnerable, from findings."""
    pairs = F.transform("findings", lambda f: F.struct(f["cwe"].alias("cwe"), f["sink"].alias("sink")))
    return scanned.withColumns(
        {
            "cwe_set": F.array_sort(F.array_distinct(F.transform("findings", lambda f: f["cwe"]))),
            "pattern_signature": F.array_sort(F.array_distinct(pairs)),
            "severity_total": F.aggregate("findings", F.lit(0.0), lambda a, f: a + f["severity"]),
            "is_vulnerable": F.size("findings") > 0,
        }
    )


FLOW = "array<struct<cwe:string,line:int,sink:string,source:string,path:array<int>>>"


def flow_findings(samples: DataFrame, key: list[str], code: str = "code", untrusted_parameters: bool = True) -> DataFrame:
    """key, cwe, line, sink, detector, severity, source, path: calls that untrusted data reaches, and the lines on its way.

    The first six columns are what merge_findings takes. Each distinct code is parsed once, in the
    partitions that its hash deals it to.
    """

    @F.pandas_udf(FLOW)
    def found(codes: pd.Series) -> pd.Series:
        return pd.Series([[f._asdict() | {"path": list(f.path)} for f in flow.findings(c, untrusted_parameters)] for c in codes])

    parts = int(samples.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    once = samples.select(F.col(code).alias("code_")).distinct().repartition(parts).select("code_", F.explode(found("code_")).alias("f"))
    f = samples.select(*key, F.col(code).alias("c_")).join(once, F.col("c_") == F.col("code_")).select(*key, "f.*")
    return f.select(*key, "cwe", "line", "sink", F.lit("flow").alias("detector"), tx.severity_of(F.col("cwe")).alias("severity"), "source", "path")


def merge_findings(*sources: DataFrame, key: list[str]) -> DataFrame:
    """Union of detectors' findings (key, cwe, line, sink, detector, severity), one of each."""
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s)
    return out.dropDuplicates([*key, "cwe", "line", "sink", "detector"])


def signature_text(sig: Column) -> Column:
    return F.array_join(F.transform(sig, lambda s: F.concat(s["cwe"], F.lit("@"), s["sink"])), ";")


def rates(scanned: DataFrame, group: str) -> DataFrame:
    """Rate and mean severity over all rows and over vulnerable rows, by group and in all (null group): one rollup."""
    v = F.col("is_vulnerable").cast("int")
    return scanned.rollup(group).agg(
        F.count("*").alias("n"), F.sum(v).cast("long").alias("k"), F.avg(v).alias("rate"),
        F.avg("severity_total").alias("severity"), F.avg(F.when(F.col("is_vulnerable"), F.col("severity_total"))).alias("severity_vulnerable"),
    )


def signature_homogeneity(scanned: DataFrame, group: list[str], only_vulnerable: bool = False) -> DataFrame:
    """n, unique signatures, chance that two samples have equal ones (empty ones counted or not), effective numbers.

    All from counts of equal signatures; no pair is formed.
    """
    s = scanned.filter("is_vulnerable") if only_vulnerable else scanned
    c = s.groupBy(*group, signature_text(F.col("pattern_signature")).alias("sig")).agg(F.count("*").alias("c"))
    p = F.col("c") / F.col("n")
    total = c.withColumn("n", F.sum("c").over(Window.partitionBy(*group)))
    a = total.groupBy(*group).agg(
        F.max("n").alias("n"), F.count("*").alias("n_unique"), F.sum(F.col("c") * (F.col("c") - 1)).alias("same"),
        F.sum(F.when(F.col("sig") != "", F.col("c") * (F.col("c") - 1)).otherwise(0)).alias("same_nonempty"), F.exp(-F.sum(p * F.log(p))).alias("effective"),
    )
    pairs = F.when(F.col("n") > 1, F.col("n") * (F.col("n") - 1))
    return a.filter("n > 1").select(*group, "n", "n_unique", (F.col("same") / pairs).alias("match_rate"), (F.col("same_nonempty") / pairs).alias("match_rate_nonempty"), "effective")


def model_pair_overlap(scanned: DataFrame) -> DataFrame:
    """For each prompt and pair of models: do their last samples' CWE sets agree exactly (and are not empty), or overlap."""
    last = scanned.groupBy("prompt_id", "model_display").agg(F.max_by("cwe_set", "event_id").alias("s"))
    a, b = last.alias("a"), last.alias("b")
    pairs = a.join(b, (F.col("a.prompt_id") == F.col("b.prompt_id")) & (F.col("a.model_display") < F.col("b.model_display")))
    return pairs.select(
        F.col("a.prompt_id").alias("prompt_id"), F.col("a.model_display").alias("model_a"), F.col("b.model_display").alias("model_b"),
        ((F.size("a.s") > 0) & (F.col("a.s") == F.col("b.s"))).cast("int").alias("exact"), F.arrays_overlap("a.s", "b.s").cast("int").alias("overlap"),
    )


def s2_metrics(scanned: DataFrame, group: list[str]) -> DataFrame:
    """group, mode (all or vulnerable), n, and in one row the match rate, unique signatures and CWE sets, the effective
    numbers by equality of signatures, by their Jaccard and by CWE sets, each raw and over n, and the five most frequent signatures.

    Signatures and sets are counted first; the Jaccard kernel is of a group's distinct signatures.
    """
    g = [*group, "mode"]
    mode = F.when(F.col("is_vulnerable"), F.array(F.lit("all"), F.lit("vulnerable"))).otherwise(F.array(F.lit("all")))
    items = F.transform("pattern_signature", lambda s: F.concat(s["cwe"], F.lit("@"), s["sink"]))
    s = scanned.select(*group, F.explode(mode).alias("mode"), items.alias("items"), F.array_join("cwe_set", ",").alias("cwes"))
    signs = counts(s.withColumn("sig", F.array_join("items", ";")), g, "sig")
    a = diversity(signs, g).select(*g, "n", F.col("k").alias("n_unique"), "match_rate", F.col("effective").alias("indicator"))
    b = diversity(counts(s, g, "cwes"), g).select(*g, F.col("k").alias("n_unique_cwe"), F.col("effective").alias("cwe"))
    c = pool_scores(s, g, "items", "jaccard").select(*g, F.col("score").alias("jaccard"))
    top = top_k(signs, g, 5).groupBy(*g).agg(F.sort_array(F.collect_list(F.struct("rank", "label", "c"))).alias("top"))
    out = a.join(b, g).join(c, g).join(top, g)
    return out.select("*", *[(F.col(x) / F.col("n")).alias(f"{x}_norm") for x in ("indicator", "jaccard", "cwe")])
