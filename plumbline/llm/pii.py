"""Personal data: base patterns, and bootstrapped contextual extraction beyond them.

Base spans (email, ip, card, phone) come from four patterns, placed by the lengths of what
stands between matches. They and the values assigned to a secret's name are the seeds. The
text is then read with every base span as one opaque token. Mentions are runs of one to
`MOST_TOKENS` neighbouring tokens with a digit or @ in them, cut of punctuation, so an identifier
of several tokens is found whole. A mention's lexical patterns, digits written as 0, are

    L  the two tokens before it          A  the one before it and the one after it
    S  its own shape                     G  its shape with runs of digits as one
    H  what follows its @

(L, A and H only of mentions of one token and of seeds).

The graph of patterns and instances (distinct mention values) is scored in rounds:

    pattern, kind:  mass of its instances known as the kind
                    / (mass known as any + OPEN_WEIGHT * its unknown ones that could be of it + 1)
    instance, kind: 1 - product of (1 - pattern score) over its confident patterns

starting from the seeds; a pattern is confident from `PATTERN_SCORE` with `SUPPORT` distinct
known instances, an instance becomes known from `INSTANCE_SCORE`. Rounds end when no pattern
is new, at the latest after `ROUNDS`. Mentions in confident patterns whose value could be of
that kind (`_plausible`: a number that fails the base's test is no card) are added as spans,
unless a longer one holds them.

Scale: one scan cuts spans and runs of tokens from the text; spans depend on the text alone,
so copies are one from there on (128 bits of hash). The graph is aggregated (partial sums
first) on pattern and on instance, joins on either may be split by adaptive execution, and
each round ends in a written table. Texts never move.

Edge cases: null texts are empty; repeated rows are one another's equals and get the same
spans; null doc_ids are kept; an empty table gives an empty result; extra columns pass
through `mask` and are ignored by `extract`. Texts are searched whole; the patterns' loops
are possessive and running sums double their stride, so long runs cost no stack and the
matches of a text n log n steps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, packed, unpacked, written

KINDS = ("email", "ip", "card", "phone", "secret")
# The base patterns with possessive loops; look-behinds keep failing starts inside a run from being tried again.
PATTERNS = (
    r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    r"[0-9](?:[\x20-]?[0-9])++",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)
PART = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
#: White space, and a token that is a mention or part of one: it has a digit, an @ or a base span in it.
_W, _N = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"
#: While mentions are sought, a base span is a run of its kind's private character.
MARKS = "\ue000\ue001\ue002\ue003"
_M = f"0-9@{MARKS[0]}-{MARKS[-1]}"
_TOKEN = rf"[^\x20\x09-\x0D{_M}]*+[{_M}]{_N}*+"
RUN = rf"(?<!{_N}){_TOKEN}(?:{_W}++{_TOKEN})*+"
# Names that a secret is assigned to.
SECRET_NAMES = r"(?i)(?:token|secret|passw(?:or)?d|pwd|(?:api|access|private)[_-]?key)[\"']? ?[:=]$"
MOST_TOKENS = 4
#: Tokens of a context, and a mention of several tokens, are at most this long; what is longer cannot recur.
CONTEXT = 60
PATTERN_SCORE, INSTANCE_SCORE, OPEN_WEIGHT, SUPPORT, ROUNDS = 0.8, 0.8, 0.25, 5, 5
#: Lists of spans with up to this many entries in all (counted) are broadcast to the scan that masks; more are joined by a shuffle.
BROADCAST_SPANS = 1_000_000

SPANS, FOUND = "array<struct<s:int,k:int,e:int>>", "array<struct<s:int,k:int,e:int,v:string>>"


def running(a: Column, combine) -> Column:
    """Array a with each element combined with all before it: combine(x, y) is given x and an earlier y, null before the first.

    The stride doubles, so n elements take n log n steps.
    """

    def step(acc: Column, k: Column) -> Column:
        stride = F.call_function("shiftleft", F.lit(1), k)
        return F.when(F.size(acc) > stride, F.transform(acc, lambda x, i: combine(x, F.get(acc, i - stride)))).otherwise(acc)

    return F.aggregate(F.sequence(F.lit(0), F.lit(30)), a, step)


def _matches(t: Column, pattern: str) -> Column:
    """Array of (s, e, v) of the leftmost non-overlapping matches; code points, end exclusive.

    Text between matches comes from splitting by the same pattern, so a match ends after
    all pieces and matches up to it.
    """
    cut = F.zip_with(F.split(t, pattern, -1), F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), lambda g, v: F.struct((F.length(g) + F.coalesce(F.length(v), F.lit(0))).alias("e"), v.alias("v")))
    ends = running(cut, lambda x, y: F.struct((x["e"] + F.coalesce(y["e"], F.lit(0))).alias("e"), x["v"].alias("v")))
    return F.transform(F.filter(ends, lambda x: x["v"].isNotNull()), lambda x: F.struct((x["e"] - F.length(x["v"])).alias("s"), x["e"].alias("e"), x["v"].alias("v")))


def _luhn(digits: Column) -> Column:
    def add(a: Column, i: Column) -> Column:
        x = F.ascii(F.substr(digits, F.length(digits) - i, F.lit(1))) - 48
        return a + F.when(i % 2 == 0, x).otherwise(2 * x - F.when(x > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def _valid(kind: int, v: Column) -> Column:
    digits = F.regexp_replace(v, "[^0-9]", "")
    return (
        F.lit(True),
        v.rlike(rf"^{PART}(?:\.{PART}){{3}}$"),
        F.length(digits).between(14, 19) & _luhn(F.when(F.length(digits) <= 19, digits).otherwise("0")),
        F.length(digits).between(10, 15),
    )[kind]


def base_spans(t: Column) -> Column:
    """Sorted array of (s, k, e, v): the base spans of a text and what they say, k as listed in KINDS."""
    def of(k: int, pattern: str) -> Column:  # a lambda with a second parameter would be handed the index
        return F.transform(F.filter(_matches(t, pattern), lambda m: _valid(k, m["v"])), lambda m: F.struct(m["s"].alias("s"), F.lit(k).alias("k"), m["e"].alias("e"), m["v"].alias("v")))

    each = [of(k, p) for k, p in enumerate(PATTERNS)]
    # Each pattern runs only where its mandatory character stands.
    can = (F.contains(t, F.lit("@")), t.rlike(r"[0-9]\.[0-9]"), t.rlike(r"[0-9][\x20-]?[0-9]"), F.contains(t, F.lit("+")))
    none = F.array().cast(FOUND)
    return F.sort_array(F.concat(*[F.when(c, e).otherwise(none) for c, e in zip(can, each, strict=True)]))


def _apart(spans: Column) -> Column:
    """Sorted spans with m, the largest end so far: a span from m of the one before on begins a new stretch."""
    first = F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("m")))
    return running(first, lambda x, y: F.struct(x["s"].alias("s"), x["k"].alias("k"), F.greatest(x["m"], F.coalesce(y["m"], x["m"])).alias("m")))


def replaced(df: DataFrame, text: str, spans: str, name, *keep: str) -> DataFrame:
    """keep and out__: the text with every stretch of overlapping spans replaced by name(kind of its first, its length)."""
    upto = let(df, *keep, text, upto__=_apart(F.col(spans)))
    heads = F.filter(
        F.transform("upto__", lambda x, i: F.struct(x["s"].alias("s"), x["k"].alias("k"), i.alias("i"), F.coalesce(F.get("upto__", i - 1)["m"], F.lit(0)).alias("from"))),
        lambda x: (x["i"] == 0) | (x["s"] >= x["from"]),
    )
    cut = let(upto, *keep, text, "upto__", heads__=heads)
    last = F.element_at("upto__", -1)["m"]
    ends = lambda i: F.coalesce(F.get("heads__", i + 1)["from"], last)
    parts = F.transform("heads__", lambda x, i: F.concat(F.substr(F.col(text), x["from"] + 1, x["s"] - x["from"]), name(x["k"], ends(i) - x["s"])))
    out = F.when(F.size("upto__") > 0, F.concat(F.array_join(parts, ""), F.substr(F.col(text), last + 1))).otherwise(F.col(text))
    return let(cut, *keep, out__=out)


def _shape(token: Column) -> Column:
    return F.regexp_replace(token, "[0-9]", "0")


def spans_and_runs(docs: DataFrame, key: str, text: str, hide=None) -> DataFrame:
    """doc_id, r1, r2 (hashes of the text), base, and runs: (s, v, what stands before, what stands after) of neighbouring mention tokens.

    hide: a predicate of values; base spans with such a value are taken for plain text (to measure recall).
    """
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    first = let(docs, doc_id=F.col(key), t=t, any=t.rlike("[0-9@]"))
    found = F.when(F.col("any"), base_spans(F.col("t"))).otherwise(F.array().cast(FOUND))
    based = let(first, "doc_id", "t", "any", base=found if hide is None else F.filter(found, lambda x: ~hide(x["v"])))
    marks = F.array(*map(F.lit, MARKS))
    # A text's own private characters are taken for another one, as long.
    plain = based.select("doc_id", F.xxhash64("t").alias("r1"), F.xxhash64(F.lit(1), "t").alias("r2"), "base", "any", F.when(F.col("any"), F.translate("t", MARKS, "\ue004" * len(MARKS))).otherwise("").alias("plain"))
    opaque = replaced(plain, "plain", "base", lambda k, n: F.repeat(F.get(marks, k), n), "doc_id", "r1", "r2", "base", "any")
    at = let(opaque, "doc_id", "r1", "r2", "base", "out__", at=F.when(F.col("any"), _matches(F.col("out__"), RUN)).otherwise(F.array().cast("array<struct<s:int,e:int,v:string>>")))
    around = 2 * CONTEXT + 2
    runs = F.transform("at", lambda x: F.struct(
        x["s"].alias("s"), x["v"].alias("v"),
        F.substr("out__", F.greatest(x["s"] - around, F.lit(0)) + 1, F.least(x["s"], F.lit(around))).alias("b"),
        F.substr("out__", x["e"] + 1, F.lit(CONTEXT + 2)).alias("a"),
    ))
    return at.select("doc_id", "r1", "r2", "base", runs.alias("runs"))


def _candidates(n: int) -> Column:
    """Runs of n neighbouring tokens of x with one white-space character between, and the tokens around them."""
    word = lambda i: F.coalesce(F.get("x", i)["v"], F.lit(""))
    fits = lambda w: F.when(F.length(w) <= CONTEXT, w).otherwise("")

    def one(m: Column, i: Column) -> Column:
        v = m["v"] if n == 1 else F.array_join(F.transform(F.slice("x", i + 1, n), lambda y: y["v"]), " ")
        return F.struct(
            m["s"].alias("at"), F.get("x", i + n - 1)["e"].alias("to"), v.alias("v"),
            F.when(i > 0, fits(word(i - 1))).otherwise(F.col("b1")).alias("left1"),
            F.when(i > 1, fits(word(i - 2))).when(i == 1, F.col("b1")).otherwise(F.col("b2")).alias("left2"),
            F.when(i + n < F.size("x"), fits(word(i + n))).otherwise(F.col("a1")).alias("right1"),
        )

    made = F.transform("x", one)
    return made if n == 1 else F.filter(made, lambda c: (c["to"] - c["at"] == F.length(c["v"])) & (F.length(c["v"]) <= CONTEXT) & ~c["v"].rlike(f"[{MARKS[0]}-{MARKS[-1]}]"))


def mentions(found: DataFrame) -> DataFrame:
    """r1, r2, s, e, v, kind, p: every mention of the distinct texts, the kind of base spans (0 to 3) and seed secrets (4), the patterns."""
    texts = found.filter(F.size("runs") > 0).groupBy("r1", "r2").agg(F.first("runs").alias("runs"), F.first("base").alias("base"))
    texts = written(texts, "texts")
    run = texts.select("r1", "r2", F.explode("runs").alias("run")).select("r1", "r2", "run.*")
    toks = let(
        run, "r1", "r2", "s",
        x=_matches(F.col("v"), rf"{_N}++"),
        b2=F.regexp_extract("b", rf"(?:^|{_W})({_N}{{1,{CONTEXT}}}){_W}+{_N}{{1,{CONTEXT}}}{_W}+$", 1),
        b1=F.regexp_extract("b", rf"(?:^|{_W})({_N}{{1,{CONTEXT}}}){_W}+$", 1),
        a1=F.regexp_extract("a", rf"^{_W}+({_N}{{1,{CONTEXT}}})(?:{_W}|$)", 1),
    )
    cand = toks.select("r1", "r2", "s", F.explode(F.concat(*[_candidates(n) for n in range(1, MOST_TOKENS + 1)])).alias("c")).select("r1", "r2", "s", "c.*")
    # A name with = or : that sticks to the value is context; punctuation around the value is cut, a bracket only without its partner.
    marked = rf"[{MARKS[0]}-{MARKS[-1]}]"
    named = r"^[A-Za-z][A-Za-z_-]*+[\"']?[=:]"
    lead = F.regexp_extract("v", rf"(?:{named})?[^0-9A-Za-z+@({MARKS[0]}-{MARKS[-1]}]*+", 0)
    around = ["left1", "left2", "right1"]
    cut = let(cand.withColumn("s", F.col("s") + F.col("at")), "r1", "r2", "s", "v", *around, lead=F.when(F.col("v").startswith(lead), lead).otherwise(""))
    cut = let(cut, "r1", "r2", "s", "lead", *around, core=F.regexp_replace(F.substr("v", F.length("lead") + 1), rf"[^0-9A-Za-z){MARKS[0]}-{MARKS[-1]}]+$", ""))
    opens, closes = F.contains("core", F.lit("(")), F.contains("core", F.lit(")"))
    bare = F.col("core").startswith("(") & (~closes | F.col("core").rlike(r"^\([^()]*\)$"))
    inner = F.when(bare, F.regexp_replace("core", r"^\(|\)+$", "")).when(closes & ~opens, F.regexp_replace("core", r"\)+$", "")).otherwise(F.col("core"))
    name = F.regexp_extract("lead", named, 0)
    cut = let(
        cut, "r1", "r2", "right1", core=inner, s=(F.col("s") + F.length("lead") + F.when(bare, 1).otherwise(0)).cast("int"),
        left2=F.when(name != "", F.col("left1")).otherwise(F.col("left2")), left1=F.when(name != "", name).otherwise(F.col("left1")),
    )
    placed = cut.filter("core <> ''").withColumn("e", (F.col("s") + F.length("core")).cast("int"))
    known = placed.filter(F.col("core").rlike(rf"^{marked}+$"))
    spans = texts.select(F.col("r1").alias("q1"), F.col("r2").alias("q2"), F.explode("base").alias("y")).select("q1", "q2", F.col("y.s").alias("s0"), F.col("y.e").alias("e0"), F.lower("y.v").alias("v"), F.col("y.k").alias("kind"))
    on = (F.col("r1") == F.col("q1")) & (F.col("r2") == F.col("q2")) & (F.col("s") == F.col("s0")) & (F.col("e") == F.col("e0"))
    secret = F.concat_ws(" ", "left2", "left1").rlike(SECRET_NAMES) & (F.length("core") >= 8)
    free = placed.filter(~F.col("core").rlike(marked)).withColumn("v", F.lower("core")).withColumn("kind", F.when(secret, F.lit(KINDS.index("secret"))))
    names = ["r1", "r2", "s", "e", "v", "kind", "left1", "left2", "right1"]
    every = known.join(spans, on).select(*names).unionByName(free.select(*names))
    context = lambda c: F.lower(_shape(F.col(c)))
    free_several = F.col("kind").isNull() & F.col("v").rlike(_W)
    mixed = F.col("v").rlike("^[0-9a-z_-]{16,}$") & F.col("v").rlike("[0-9]") & F.col("v").rlike("[a-z]")
    shape = F.when(mixed, F.concat(F.lit("x"), F.length("v").cast("string"))).otherwise(F.regexp_replace(_shape(F.col("v")), r"\p{L}+", "a"))
    single, left, pair = ~free_several, (F.col("left1") != "") & (F.col("left2") != ""), (F.col("left1") != "") & (F.col("right1") != "")
    patterns = F.array_compact(F.array(
        F.when(single & left, F.concat(F.lit("L "), context("left2"), F.lit(" "), context("left1"))),
        F.when(single & pair, F.concat(F.lit("A "), context("left1"), F.lit(" _ "), context("right1"))),
        F.when(F.length("v") <= CONTEXT, F.concat(F.lit("S "), shape)),
        F.when((F.length("v") <= CONTEXT) & ~mixed, F.concat(F.lit("G "), F.regexp_replace(shape, "0+", "0"))),
        F.when(single & F.contains("v", F.lit("@")), F.concat(F.lit("H "), _shape(F.regexp_extract("v", f"@(.{{1,{CONTEXT}}})$", 1)))),
    ))
    return every.select("r1", "r2", "s", "e", "v", "kind", patterns.alias("p"))


def _plausible(kind: int, v: Column) -> Column:
    """Whether a value could be of a kind: the base's own tests where it has some, so numbers that fail them are no instances."""
    digits = ~v.rlike(r"\p{L}")
    return (
        v.rlike(rf"^{_N}+@{_N}+$"),
        _valid(1, v),
        digits & _valid(2, v),
        digits & _valid(3, v),
        v.rlike(rf"^{_N}{{8,}}$"),
    )[kind]


def _of_kind(kind: Column, v: Column) -> Column:
    out = F.lit(False)
    for k in range(len(KINDS)):
        out = out | ((kind == k) & _plausible(k, v))
    return out


def score_graph(edges: DataFrame, seeds: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """pattern, kind, score of the confident patterns. edges: distinct pattern, v; seeds: distinct v, kind."""
    seeds = seeds.select("v", "kind", F.lit(1.0).alias("mass"))
    known, patterns, had = seeds, None, -1
    could = [F.sum(F.when(_plausible(k, F.col("v")), 1).otherwise(0)) for k in range(len(KINDS))]
    sizes = written(edges.groupBy("pattern").agg(F.array(*could).alias("n"), F.count("*").alias("every")).filter(F.col("every") >= SUPPORT), "sizes")
    for r in range(rounds):
        held = edges.join(known, "v").groupBy("pattern", "kind").agg(F.sum("mass").alias("mass"), F.count("*").alias("support"))
        total = held.groupBy("pattern").agg(F.sum("mass").alias("all"), F.max(F.struct("mass", (-F.col("kind")).alias("k"), "support")).alias("b"))
        rated = total.filter(F.col("b.support") >= SUPPORT).join(sizes, "pattern")
        n = F.get("n", -F.col("b.k"))
        score = F.col("b.mass") / (F.col("all") + OPEN_WEIGHT * F.greatest(n - F.col("all"), F.lit(0.0)) + 1)
        patterns = written(rated.select("pattern", (-F.col("b.k")).alias("kind"), score.alias("score")).filter(F.col("score") >= PATTERN_SCORE), f"patterns{r}")
        many = patterns.count()
        if many == had or not many:
            break
        had = many
        rated_v = edges.join(patterns, "pattern").filter(_of_kind(F.col("kind"), F.col("v"))).groupBy("v", "kind").agg((1 - F.exp(F.sum(F.log(1 - F.col("score"))))).alias("mass"))
        new = rated_v.filter(F.col("mass") >= INSTANCE_SCORE).join(seeds.select("v").distinct(), "v", "left_anti")
        known = written(seeds.unionByName(new.select("v", "kind", "mass")), f"known{r}")
    return patterns


def discover(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Spans that seeds of secrets and confident patterns add (q1, q2, more), and the patterns. found: a written spans_and_runs."""
    each = written(mentions(found), "mentions")
    edges = written(each.select(F.explode("p").alias("pattern"), "v").distinct(), "edges")
    patterns = score_graph(edges, each.filter("kind is not null").select("v", "kind").distinct())
    hits = each.filter("kind is null").select("r1", "r2", "s", "e", "v", F.explode("p").alias("pattern")).join(patterns, "pattern").filter(_of_kind(F.col("kind"), F.col("v")))
    best = hits.groupBy("r1", "r2", "s", "e").agg((-F.max(F.struct("score", (-F.col("kind")).alias("k")))["k"]).alias("kind"))
    best = best.unionByName(each.filter(F.col("kind") == KINDS.index("secret")).select("r1", "r2", "s", "e", "kind"))
    # Of spans that hold one another the longest stays; the window is over the added spans of one text.
    before = Window.partitionBy("r1", "r2").orderBy("s", F.desc("e"), "kind").rowsBetween(Window.unboundedPreceding, -1)
    kept = best.withColumn("m", F.max("e").over(before)).filter(F.col("m").isNull() | (F.col("e") > F.col("m")))
    more = kept.groupBy("r1", "r2").agg(F.sort_array(F.collect_list(F.struct("s", F.col("kind").cast("int").alias("k"), "e"))).alias("more"))
    return more.withColumnsRenamed({"r1": "q1", "r2": "q2"}), patterns


def _bare(spans: Column) -> Column:
    return F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e")))


def _with_more(found: DataFrame) -> DataFrame:
    more = written(discover(found)[0], "discovered")
    side = F.broadcast(more) if (more.agg(F.sum(F.size("more"))).first()[0] or 0) <= BROADCAST_SPANS else more
    out = found.select("doc_id", "r1", "r2", _bare(F.col("base")).alias("base")).join(side, (F.col("r1") == F.col("q1")) & (F.col("r2") == F.col("q2")), "left")
    return out.select("doc_id", "r1", "r2", "base", F.sort_array(F.concat("base", F.coalesce("more", F.array().cast(SPANS)))).alias("spans"))


def extract(docs: DataFrame, key: str = "doc_id", text: str = "text", hide=None) -> DataFrame:
    """doc_id, base and spans (arrays of start, kind number, end) of every row; spans has base and what was discovered."""
    return _with_more(written(spans_and_runs(docs, key, text, hide), "found")).select("doc_id", "base", "spans")


def mask(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with every span, base or discovered, replaced by its kind in brackets; overlapping spans are one."""
    found = _with_more(written(spans_and_runs(docs, key, text), "found"))
    spans = written(found.filter(F.size("spans") > 0).groupBy(F.col("r1").alias("q1"), F.col("r2").alias("q2")).agg(F.first("spans").alias("spans_")), "spans")
    side = F.broadcast(spans) if (spans.agg(F.sum(F.size("spans_"))).first()[0] or 0) <= BROADCAST_SPANS else spans
    names, row = packed(docs, ())
    t = let(docs, row__=row, t_=F.coalesce(F.col(text).cast("string"), F.lit("")))
    joined = t.join(side, (F.xxhash64("t_") == F.col("q1")) & (F.xxhash64(F.lit(1), "t_") == F.col("q2")), "left")
    kinds = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    done = replaced(joined.withColumn("spans_", F.coalesce("spans_", F.array().cast(SPANS))), "t_", "spans_", lambda k, n: F.get(kinds, k), "row__", "spans_")
    return done.select(*[F.when(F.size("spans_") > 0, F.col("out__")).otherwise(c).alias(n) if n == text else c for n, c in zip(names, unpacked(names), strict=True)])


def listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def op1_pii(spark, sf_dir: str) -> DataFrame:
    out = extract(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    of = lambda spans, j: F.size(F.filter(spans, lambda x: x["k"] == j)).cast("long")
    counts = [of("base", j).alias(f"n_{name}") for j, name in enumerate(KINDS[:4])]
    return out.select("doc_id", *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))
