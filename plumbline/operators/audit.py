"""Manual-verification aids: static tags, labels from tags and outcomes, stratified draws, the report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import vocab


def _has(tags: Column, *names: str) -> Column:
    return F.arrays_overlap(tags, F.array(*map(F.lit, names)))


def concatenated_keyword(code: Column) -> Column:
    """A line (but for parameter tuples) that adds `keyword` to a SELECT."""
    def bad(line: Column) -> Column:
        s = tx.strip(line)
        skip = s.rlike(r"execute\s*\(\s*\w+\s*,") | s.rlike(r"^\s*\(?\s*['\"]\s*%")
        return ~skip & s.rlike(r"(?i)SELECT[^\n]*\+\s*keyword|keyword\s*\+[^\n]*SELECT")

    return F.exists(F.split(code, "\n"), bad)


def static_tags(issue: str, code: Column) -> Column:
    """The issue's tags in order: those of single patterns, then those that combine them."""
    hit = {name: code.rlike(("(?i)" if ci else "") + p) for name, p, ci in vocab.AUDIT_TAGS[issue]}
    if issue == "path_traversal":
        hit["apparent_mitigation"] = hit["normalizes_path"] & (hit["strong_containment_check"] | hit["startswith_check"])
    if issue == "mass_assignment":
        listed = hit["allowlist_present"] | hit["inline_allowlist_set"]
        hit["hasattr_only_guard"] = hit.pop("hasattr_guard") & ~listed
        hit["unrestricted_setattr_candidate"] = hit["payload_items_loop"] & hit["setattr"] & ~listed
    if issue == "sql_injection":
        hit["concat_keyword_sql"] = concatenated_keyword(code)
        hit["clearly_parameterized"] = hit["execute_with_params"] & (hit["qmark_placeholder"] | hit["other_placeholder"])
    if issue == "command_injection":
        shell = hit["shell_true"] | hit["os_system"] | hit["os_popen"] | hit["subprocess_string_command"]
        hit["strong_shell_injection_candidate"] = shell & hit["host_interpolated"]
        hit["argument_injection_candidate"] = hit["subprocess_list_form"] & hit["host_interpolated"] & ~hit["strong_shell_injection_candidate"]
    return F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in hit.items()]))


def verdict(issue: str, tags: Column) -> Column:
    """(label, confidence) from tags alone."""
    rel, fp = vocab.RELEVANT, vocab.FALSE_POSITIVE
    cases = {
        "path_traversal": [(_has(tags, "apparent_mitigation", "basename_or_secure_filename"), rel, "medium"), (F.array_contains(tags, "joins_user_filename") & F.array_contains(tags, "opens_file"), rel, "high"), (F.lit(True), fp, "medium")],
        "mass_assignment": [(_has(tags, "unrestricted_setattr_candidate"), rel, "high"), (_has(tags, "setattr"), rel, "medium"), (F.lit(True), fp, "medium")],
        "sql_injection": [(_has(tags, "fstring_sql", "format_sql_possible", "concat_keyword_sql"), rel, "medium"), (_has(tags, "clearly_parameterized"), fp, "high"), (F.lit(True), fp, "medium")],
        "command_injection": [(_has(tags, "strong_shell_injection_candidate"), rel, "high"), (_has(tags, "argument_injection_candidate"), rel, "medium"), (_has(tags, "subprocess_list_form"), rel, "low"), (_has(tags, "shell_true", "os_system", "os_popen", "subprocess_string_command"), rel, "medium"), (F.lit(True), fp, "medium")],
        "deserialization": [(_has(tags, "pickle_load", "joblib_load", "torch_load"), rel, "high"), (F.lit(True), fp, "high")],
        "unsafe_eval": [(~_has(tags, "eval_call", "exec_call"), fp, "high"), (_has(tags, "parser_or_ast_based") & ~_has(tags, "eval_call"), fp, "high"), (_has(tags, "restricted_builtins"), rel, "low"), (F.lit(True), rel, "medium")],
    }[issue]
    out = None
    for cond, label, confidence in reversed(cases):
        v = F.struct(F.lit(label).alias("label"), F.lit(confidence).alias("confidence"))
        out = v if out is None else F.when(cond, v).otherwise(out)
    return out


def with_outcome(label: Column, status: Column, marker: Column, mitigated: Column) -> Column:
    """The label after an external run: its marker confirms, a blocked payload behind a guard clears, no run stays open."""
    return F.when(status.isNull(), label).when(marker, vocab.CONFIRMED).when((status == "executed") & mitigated, vocab.FALSE_POSITIVE).when(status != "executed", vocab.NOT_RUNNABLE).otherwise(label)


def stratified(rows: DataFrame, stratum: str, key: str, seed: str, k: int) -> DataFrame:
    """k rows in turn from the strata, each in the order of a seeded draw."""
    r = rows.withColumn("turn", F.row_number().over(Window.partitionBy(stratum).orderBy(tx.drawn(F.lit(seed), F.col(key).cast("string")), key)).cast("long"))
    return r.orderBy("turn", stratum).limit(k)


def report(labelled: DataFrame, dims: list[str]) -> DataFrame:
    """Counts by label with shares of all and of runnable rows, for each value of each dimension and in all."""
    sets = [labelled.select(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value"), "label") for d in dims] + [labelled.select(F.lit("all").alias("dimension"), F.lit("all").alias("value"), "label")]
    u = sets[0]
    for s in sets[1:]:
        u = u.unionByName(s)
    n = {"confirmed": vocab.CONFIRMED, "relevant": vocab.RELEVANT, "false_positive": vocab.FALSE_POSITIVE, "not_runnable": vocab.NOT_RUNNABLE}
    a = u.groupBy("dimension", "value").agg(F.count("*").alias("n"), *[F.count(F.when(F.col("label") == v, 1)).alias(k) for k, v in n.items()])
    runnable = F.col("n") - F.col("not_runnable")
    return a.withColumns({"runnable": runnable, "pct_all": 100 * F.col("false_positive") / F.col("n"), "pct_runnable": 100 * F.col("false_positive") / F.when(runnable > 0, runnable)})
