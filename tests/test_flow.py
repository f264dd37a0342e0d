"""Data flow against a brute-force walk of every path, the detectors' union, and readers of what the sinks wrote."""

import json
import random

DATA = "/root/testdata/sf0.001"


def program(rnd, depth=0):
    """Statements as nested tuples: assignments, sanitised ones, sinks, branches and loops over four names."""
    out = []
    for _ in range(rnd.randint(2, 6)):
        a, b, c = (rnd.choice("wxyz") for _ in range(3))
        kind = rnd.choice(["input", "input", "copy", "join", "clean", "quote", "add", "sink", "sink", "eval", *["if", "loop"] * (depth < 2)])
        out.append((kind, a, b, c, program(rnd, depth + 1) if kind in ("if", "loop") else [], program(rnd, depth + 1) if kind == "if" and rnd.random() < 0.5 else []))
    return out


def written(body, lines, pad=""):
    """The program as code; every statement gets its line."""
    out = []
    for kind, a, b, c, inner, other in body:
        text = {
            "input": f"{a} = input()", "copy": f"{a} = {b}", "join": f"{a} = f'{{{b}}} and {{{c}}}'", "clean": f"{a} = int({b})", "quote": f"{a} = shlex.quote({b})",
            "add": f"{a} += {b}", "sink": f"os.system('x' + {a})", "eval": f"eval({a})", "if": f"if {b} > 1:", "loop": f"while {b}:",
        }[kind]
        lines.append(pad + text)
        line = len(lines)
        first = written(inner, lines, pad + "    ") if inner else []
        if other:
            lines.append(pad + "else:")
        out.append((kind, a, b, c, line, first, written(other, lines, pad + "    ") if other else []))
    return out


def walk(body, states, found):
    """Every state (name -> what it is safe for, or nothing) that some path reaches; findings on the way."""
    for kind, a, b, c, line, inner, other in body:
        new = set()
        for frozen in states:
            s = dict(frozen)
            if kind == "sink" and a in s and "CWE-78" not in s[a]:
                found.add(("CWE-78", line))
            if kind == "eval" and a in s:
                found.add(("CWE-95", line))
            if kind == "input":
                s[a] = frozenset()
            elif kind == "copy":
                s = {**s, a: s[b]} if b in s else {k: v for k, v in s.items() if k != a}
            elif kind in ("join", "add"):
                held = [s[k] for k in ((b, c) if kind == "join" else (a, b)) if k in s]
                s = {**s, a: frozenset.intersection(*held)} if held else {k: v for k, v in s.items() if k != a}
            elif kind == "clean":
                s.pop(a, None)
            elif kind == "quote":
                s = {**s, a: s[b] | {"CWE-78"}} if b in s else {k: v for k, v in s.items() if k != a}
            new.add(frozenset(s.items()))
        if kind == "if":
            new = walk(inner, new, found) | walk(other, new, found)
        elif kind == "loop":
            while True:
                more = new | walk(inner, new, found)
                if more == new:
                    break
                new = more
        states = new
    return states


def test_flow_against_every_path():
    from plumbline.functions.flow import findings

    rnd, some = random.Random(11), 0
    for _ in range(400):
        lines = []
        body = written(program(rnd), lines)
        found = set()
        walk(body, {frozenset()}, found)
        got = findings("\n".join(lines))
        assert {(f.cwe, f.line) for f in got} == found, "\n".join(lines)
        for f in got:  # a path begins at its source, ends at the sink, and passes lines that are there
            assert "input" in lines[f.path[0] - 1] and f.path[-1] == f.line and all(1 <= x <= len(lines) for x in f.path)
        some += bool(found)
    assert some > 100


def test_flow_by_hand():
    from plumbline.functions.flow import findings

    short = lambda code, **k: [(f.cwe, f.line, f.sink, f.source, f.path) for f in findings(code, **k)]
    assert short("def f(self, q):\n    cur.execute('select ' + q)\n    cur.execute('select ?', (q,))") == [("CWE-89", 2, "execute", "parameter q", (1, 2))]
    assert short("def f(q):\n    eval(q)", untrusted_parameters=False) == []
    assert short("import yaml\nyaml.load(input(), Loader=yaml.SafeLoader)\nyaml.load(input())") == [("CWE-502", 3, "yaml.load", "input", (3,))]
    assert short("a, *b = request.args['q'], 1\nd = {}\nd['k'] = a\nfor v in d.values():\n    os.popen(v)") == [("CWE-78", 5, "os.popen", "request.args", (1, 3, 4, 5))]
    assert short("try:\n    x = input()\nexcept OSError:\n    x = '1'\nelse:\n    x = int(x)\neval(x)") == []
    assert short("x = 1\ndef g():\n    if (n := len(y := input())) > 2:\n        exec(y)\n    exec(n)") == [("CWE-95", 4, "exec", "input", (3, 4))]
    assert short("match input():\n    case str() as s:\n        eval(s)") == [("CWE-95", 3, "eval", "input", (1, 3))]
    assert short("subprocess.run(input(), shell=False)\nsubprocess.run(args=input(), shell=True)") == [("CWE-78", 2, "subprocess.run", "input", (2,))]
    assert short("eval(input() if input() > 1 else 2)") and not short("eval(3 if input() else 2)") and short("def broken(:") == [] and short("") == [] and short(None) == []
    deep = "x = input() + " + " + ".join(["1"] * 3000) + "\neval(x)"
    assert short(deep) == [("CWE-95", 2, "eval", "input", (1, 2))]


def test_deep_code_has_features():
    from plumbline.functions.syntax import features, postorder, parsed

    f = features("x = " + " + ".join(["1"] * 3000))
    assert f["parse_ok"] and f["tree"].count("BinOp:3") == 2999
    assert postorder(parsed("f(a)")) == ["Load:0", "Name:1", "Load:0", "Name:1", "Call:2", "Expr:1", "Module:1"]


def test_detectors_together(spark):
    from plumbline import catalogue
    from plumbline.functions.flow import findings
    from plumbline.sources import fixtures

    codes = {r.event_id: r.code for r in fixtures.code_samples(spark, DATA).collect()}
    got = sorted((r.event_id, r.cwe, r.line, r.sink, r.source, r.path) for r in catalogue.QUERIES["flow_findings"](spark, DATA).collect())
    assert got == sorted((k, f.cwe, f.line, f.sink, f.source, ",".join(map(str, f.path))) for k, c in codes.items() for f in findings(c))
    assert len({r[1] for r in got}) >= 6
    both = catalogue.QUERIES["detectors_by_sample"](spark, DATA).collect()
    assert sum(r.n_flow for r in both) == len(got) and any(r.n_flow and not r.n_regex for r in both) and any(r.n_regex and not r.n_flow for r in both)


def test_what_the_sinks_wrote_is_read_once(spark, tmp_path):
    from plumbline.sources import readers, sinks

    rows = [(p, "m", 0.0, i, "x") for p in ("A-1", "B 2/c", "C") for i in range(4)]
    df = spark.createDataFrame(rows, "prompt_id string, model_display string, temperature double, sample_index int, response_text string")
    log = f"{tmp_path}/log"
    sinks.append_log(df, log)
    assert readers.merged_or_all(spark, log).count() == 12
    sinks.merged(df.limit(5), f"{log}/all_responses.jsonl")
    assert readers.responses(spark, log).count() == 12 and readers.merged_or_all(spark, log).count() == 5
    (tmp_path / "log" / "one.jsonl").write_text(json.dumps({"prompt_id": "D", "temperature": 0.0}) + "\n" + json.dumps({"prompt_id": "C", "temperature": 0.0}) + "\n")
    assert readers.responses(spark, log).count() == 14
    some = readers.responses(spark, log, ["B 2/c", "C"])
    assert some.count() == 9 and {r.prompt_id for r in some.collect()} == {"B 2/c", "C"}
    pruned = readers.responses(spark, log, ["C"])
    assert {f.split("/log/")[1].split("/")[0] for f in pruned.inputFiles()} >= {"prompt=C"}
    assert "PartitionFilters: [prompt" in pruned._jdf.queryExecution().toString().replace("isnotnull(prompt", "prompt")
    assert readers.responses(spark, f"{log}/one.jsonl").count() == 2
    text, md = sinks.report({"all": df, "few": df.limit(2)}, limit=3)
    assert json.loads(text)["cut"] == ["all"] and len(json.loads(text)["all"]) == 3 and md.count("the table has more") == 1


def test_a_description_is_enough_for_the_debug_rule(spark):
    from plumbline.operators.calibrate import calibrate
    from plumbline.operators.scan import derived

    kind = "array<struct<cwe:string,sink:string,severity:double,line:int,description:string,detector:string>>"
    finding = lambda d: [("CWE-94", "s", 5.0, 1, d, "bandit")]
    rows = [(1, "SE-01", "x", finding("B201:Flask_Debug_True")), (2, "SE-01", "x", finding("other")), (3, "SE-01", "x", finding(None)), (4, "SE-06", "p = os.path.join('u', n)\nopen(p)", [])]
    got = {r.id: [(f.cwe, f.detector, f.description) for f in r.findings] for r in calibrate(derived(spark.createDataFrame(rows, f"id long, prompt_id string, code string, findings {kind}"))).collect()}
    assert got[1] == [("CWE-489", "bandit+calib-B", "B201:Flask_Debug_True")] and got[2] == [("CWE-94", "bandit", "other")] and got[3][0][0] == "CWE-94"
    assert got[4] == [("CWE-22", "calibration-E", "Path traversal")]


def test_bootstrap_interval_is_that_of_drawn_samples(spark):
    import numpy as np

    from plumbline.operators.inference import POISSON, bootstrap_mean

    rng = np.random.default_rng(2)
    values = rng.gamma(2, 3, 3000)
    df = spark.createDataFrame([("g", i, float(v)) for i, v in enumerate(values)], "g string, k long, v double").repartition(4)
    got = bootstrap_mean(df, ["g"], "k", "v").first()
    drawn = np.sort([rng.choice(values, len(values)).mean() for _ in range(2000)])
    width = drawn[1949] - drawn[50]
    assert got.n == 3000 and abs(got.mean - values.mean()) < 1e-9
    assert abs(got.lo - drawn[50]) < 0.25 * width and abs(got.hi - drawn[1949]) < 0.25 * width
    weight = lambda u: sum(u >= c for c in POISSON)
    assert abs(sum(map(weight, range(65536))) / 65536 - 1) < 1e-3


def test_effective_number_of_whole_pools(spark):
    import numpy as np

    from plumbline.operators.kernels import effective_number, whole_cosine_scores

    rng = np.random.default_rng(4)
    rows = [(g, i, rng.normal(size=12).tolist() if i % 7 else [0.5] * 12) for g, n in (("a", 90), ("b", 5), ("c", 1)) for i in range(n)]
    df = spark.createDataFrame([*rows, ("a", 99, None)], "g string, i long, v array<double>").repartition(5)
    got = {r.g: (r.n, r.score) for r in whole_cosine_scores(df, ["g"], "v").collect()}
    for g in "abc":
        u = np.array([v for x, _, v in rows if x == g])
        u /= np.linalg.norm(u, axis=1, keepdims=True)
        n, score = got[g]
        # The dense form adds 1e-12 inside the logarithm for every zero eigenvalue too: the difference is below that.
        assert n == len(u) and abs(score - effective_number(u @ u.T)) < 1e-6
