"""Column functions over code and text: built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab

FENCE = r"(?s)```(?:python|py|javascript|js)?\s*\n(.*?)```"
#: Words, numbers and single signs; the older tokenizer drops bare numbers.
TOKENS = r"(?U)[A-Za-z_]\w*|\d+|[^\s\w]"
LEGACY_TOKENS = r"(?U)[a-zA-Z_]\w*|[^\s\w]"
SEP = "\x01"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def extract_code(text: Column) -> Column:
    """Fenced blocks joined by newlines, or the stripped text where there is none; null is empty."""
    t = F.coalesce(text, F.lit(""))
    blocks = F.regexp_extract_all(t, F.lit(FENCE), F.lit(1))
    return F.when(F.size(blocks) == 0, strip(t)).otherwise(F.array_join(blocks, "\n"))


def tokens(c: Column, pattern: str = TOKENS) -> Column:
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(pattern), F.lit(0))


def bind(c: Column, body) -> Column:
    """body(c) with c evaluated once: a lambda that names an expression would run it again for every element."""
    return F.get(F.transform(F.array(c), body), F.lit(0))


def ngrams(toks: Column, n: int = 3, sep: str = SEP) -> Column:
    """Array of n-grams in order, repeats included; empty below n tokens."""

    def grams(t: Column) -> Column:
        all_ = F.transform(F.sequence(F.lit(0), F.size(t) - n), lambda i: F.concat_ws(sep, *[F.get(t, i + k) for k in range(n)]))
        return F.when(F.size(t) < n, F.array().cast("array<string>")).otherwise(all_)

    return bind(toks, grams)


def char_ngrams(c: Column, n: int = 3) -> Column:
    """Sliding substrings, cut from an array of characters: no position is sought twice."""
    return ngrams(F.split(c, ""), n, "")


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard of two sets held as arrays; two empty sets are equal."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def import_names(code: Column) -> Column:
    """Sorted distinct top-level names of import lines."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(code, F.lit(r"(?m)^\s*(?:from|import)\s+([a-zA-Z_]\w*)"), F.lit(1))))


def identifiers(code: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(code, F.lit(r"[a-zA-Z_]\w{2,}"), F.lit(0))))


def design_patterns(code: Column) -> Column:
    tags = []
    for name, p in vocab.DESIGN_PATTERNS:
        hit = code.rlike(p)
        if name == "function_based":
            hit &= ~code.rlike(vocab.DESIGN_PATTERNS[0][1])
        tags.append(F.when(hit, F.lit(name)))
    return F.array_sort(F.array_compact(F.array(*tags)))


def storage(code: Column, imports: Column) -> Column:
    low, has = F.lower(code), lambda m: F.array_contains(imports, m)
    return (
        F.when(has("sqlite3") | has("sqlalchemy"), "sqlite")
        .when(has("shelve"), "shelve").when(has("pickle"), "pickle").when(has("csv"), "csv")
        .when(has("json") & low.rlike(r"\.json['\"]|json\.dump|json\.load"), "json_file")
        .when(low.rlike(r"\bopen\([^\)]+['\"][rwab+]+['\"]"), "plain_file")
        .when(has("redis"), "redis").otherwise("in_memory")
    )


def interface(code: Column) -> Column:
    out = F.lit("library")
    for name, p in reversed(vocab.INTERFACES):
        out = F.when(code.rlike(p), name).otherwise(out)
    return out


def algorithm_tags(prompt: Column, code: Column, imports: Column) -> Column:
    """Sorted names of the tags that hold for the prompt's detector; empty for prompts without one.

    The cache prompt also names its data structure, `data_struct=...`, which sorts first.
    """
    low = F.lower(code)

    def test(word: str) -> Column:
        kind, _, rest = word.partition(":")
        if kind == "re":
            return code.rlike(rest)
        if kind == "imp":
            return F.array_contains(imports, rest)
        if kind == "raw":
            return F.contains(code, F.lit(rest))
        return F.contains(low, F.lit(word))

    out = F.array().cast("array<string>")
    for pid, tags in vocab.ALGORITHM_TAGS.items():
        found = []
        for name, alternatives in tags.items():
            hit = F.lit(False)
            for words in alternatives:
                every = F.lit(True)
                for w in words:
                    every &= test(w)
                hit |= every
            found.append(F.when(hit, F.lit(name)))
        if pid == "OD-01":
            found.append(F.concat(F.lit("data_struct="), F.when(F.contains(low, F.lit("ordereddict")), "ordereddict").when(F.contains(low, F.lit("heapq")), "heap").otherwise("dict")))
        out = F.when(prompt == pid, F.array_sort(F.array_compact(F.array(*found)))).otherwise(out)
    return out


def architecture_label(oop: Column, store: Column, face: Column, is_async: Column, factory: Column, alg: Column) -> Column:
    first = F.get(alg, F.lit(0))
    return F.concat_ws("|", F.when(oop, "oop").otherwise("procedural"), store, face, F.when(is_async, F.lit("async")), F.when(factory, F.lit("decorator-factory")), F.when(first.isNotNull(), F.concat(F.lit("alg:"), first)))


def normalize_cwe(c: Column) -> Column:
    """First run of digits as CWE-<int>; empty where there is none."""
    digits = F.regexp_extract(c, r"(\d+)", 1)
    return F.when(digits == "", "").otherwise(F.concat(F.lit("CWE-"), digits.try_cast("long").cast("string")))


def severity_of(cwe: Column, default: float = vocab.SEVERITY_DEFAULT) -> Column:
    """Severity of a normalised CWE from the fixed table."""
    table = F.create_map(*[x for k, v in vocab.SEVERITY.items() for x in (F.lit(f"CWE-{k}"), F.lit(v))])
    return F.coalesce(F.try_element_at(table, cwe), F.lit(default))


def tool_severity(c: Column, levels: dict[str, float], other: float) -> Column:
    out = F.lit(other)
    for k, v in levels.items():
        out = F.when(F.upper(c) == k, v).otherwise(out)
    return out


# What two external scanners' levels stand for.
ICD_LEVELS, BANDIT_LEVELS = {"HIGH": 8.5, "ERROR": 8.5, "MEDIUM": 5.5, "WARNING": 5.5, "LOW": 3.0, "INFO": 3.0}, {"HIGH": 8.0, "MEDIUM": 5.5, "LOW": 3.5}


def sink_signature(matched: Column) -> Column:
    """Call head with hints on how its arguments are built; other text is cut at 80 characters."""
    t = strip(F.coalesce(matched, F.lit("")))
    head, tail = F.regexp_extract(t, r"^([\w.]+\s*\()(.*)", 1), F.regexp_extract(t, r"^([\w.]+\s*\()(.*)", 2)
    hints = F.array_compact(
        F.array(
            F.when(F.contains(tail, F.lit("shell=True")), F.lit("shell=True")),
            F.when(tail.rlike(r"^\s*f['\"]"), F.lit("f-string")),
            F.when(tail.rlike(r"%\s*[sd]"), F.lit("%-format")),
            F.when(F.contains(tail, F.lit(".format(")), F.lit(".format()")),
        )
    )
    call = F.concat(head, F.lit("..."), F.when(F.size(hints) > 0, F.concat(F.lit(","), F.array_join(hints, ","))).otherwise(""), F.lit(")"))
    return F.when(head != "", call).otherwise(F.substr(t, F.lit(1), F.lit(80)))


def normalise(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"\s+", " ")


def keyword_hits(text: Column, must: list[str], any_of: list[str]) -> Column:
    """The any_of keywords that stand in a text with every must keyword; null where none does or one is missing."""
    t = normalise(text)
    hits = F.array_compact(F.array(*[F.when(F.contains(t, F.lit(k)), F.lit(k)) for k in any_of])) if any_of else F.array().cast("array<string>")
    every = F.lit(True)
    for k in must:
        every &= F.contains(t, F.lit(k))
    return F.when(every & ((F.size(hits) > 0) | F.lit(not any_of)), hits)


def string_literal(line: Column) -> Column:
    """First quoted literal that is assigned in a line."""
    return F.regexp_extract(line, r"=\s*([\"'])([^\"']*)\1", 2)


def uid(*parts: Column) -> Column:
    return F.substr(F.md5(F.concat_ws(":", *parts)), F.lit(1), F.lit(12))


def drawn(*parts: Column) -> Column:
    """A repeatable draw in 0 .. 2**32-1 from a key; the same in any engine with MD5."""
    return F.conv(F.substr(F.md5(F.concat_ws("|", *parts)), F.lit(1), F.lit(8)), 16, 10).cast("long")


def canonical_groups(c: Column) -> Column:
    """Groups of strings without order: sorted inside, then among themselves."""
    return F.array_sort(F.transform(c, lambda x: F.array_sort(x)))


def category(prompt: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in vocab.CATEGORIES.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.get(F.split(prompt, "-"), F.lit(0))), F.lit("other"))
