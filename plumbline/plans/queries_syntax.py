"""Syntax-tree queries over the code samples. Their trees need Python, so SQL checks only what it can."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import syntax
from ..functions import text as tx
from ..operators import inference, kernels, legacy, pillars, pools
from ..sources import fixtures as fx
from .registry import query
from .sql_code import q


def _trees(spark, d, *more):
    return syntax.with_features(fx.code_samples(spark, d).select("event_id", "prompt_id", "model_display", *more, "code"))


#: What a reader finds in each template ({n}: its variant): functions, classes, loops, nesting, lines, parses, async, imports, names, renamed code.
GOLDEN = (
    (0, 1, 0, 0, 1, 4, True, False, 'os', 'RUN,host,os,ping', "import var_1\n\ndef func_0(arg_0):\n    var_1.system('func_0 ' + arg_0)\nvar_0 = {n}\n"),
    (1, 1, 0, 0, 1, 5, True, False, 'sqlite3', 'RUN,cur,find,name,query', 'import sqlite3\n\ndef func_0(arg_0, arg_1):\n    var_1 = "SELECT * FROM t WHERE arg_1 = ?"\n    arg_0.execute(var_1, (arg_1,))\nvar_0 = {n}\n'),
    (2, 1, 0, 0, 1, 4, True, False, 'sqlite3', 'RUN,cursor,find,keyword', 'import sqlite3\ndef func_0(arg_0, arg_1):\n    arg_0.execute(f"SELECT * FROM t WHERE a = \'{arg_1}\'")\nvar_0 = {n}\n'),
    (3, 1, 0, 0, 2, 5, True, False, 'pickle', 'RUN,f,load_model,path,pickle', "import var_2\n\ndef func_0(arg_0):\n    with open(arg_0, 'rb') as var_1:\n        return var_2.load(var_1)\n\nvar_0 = {n}"),
    (4, 1, 1, 0, 2, 5, True, False, 'hashlib,random', 'RUN,Tokens,hashlib,make,random', 'import var_1, var_2\nclass cls_0:\n    def func_0(self):\n        return var_1.md5(str(var_2.var_2()).encode()).hexdigest()\nvar_0 = {n}\n'),
    (5, 1, 0, 0, 1, 5, True, False, 'random,secrets', 'RUN,pick,random,secrets,xs', 'import var_2, var_1\ndef func_0(arg_0):\n    # var_1.choice(arg_0) would be weak\n    return arg_0[var_2.randbelow(len(arg_0))] if arg_0 else var_1.choice(arg_0)\nvar_0 = {n}\n'),
    (6, 1, 0, 0, 1, 8, True, False, 'flask', 'Flask,RUN,app,request,x', "from flask import var_2, var_3\nvar_0 = var_2(__name__)\n@var_0.route('/func_0')\ndef func_0():\n    return var_3.args['q']\nvar_0.run(debug=True)\neval(input())\nvar_1 = {n}\n"),
    (7, 0, 0, 0, 0, 3, True, False, '', 'RUN,api_key,password', 'var_0 = "admin"\nvar_1 = "sk1234567890"\n\nvar_2 = {n}'),
    (8, 1, 0, 0, 2, 6, True, False, 'os', 'RUN,f,name,os,path,read_user_file', "import var_3\n\ndef func_0(arg_0):\n    var_1 = var_3.var_1.join('uploads', arg_0)\n    with open(var_1) as var_2:\n        return var_2.read()\nvar_0 = {n}\n"),
    (9, 1, 0, 0, 2, 7, True, False, 'os', 'RUN,name,os,path,read_user_file', "import var_2\ndef func_0(arg_0):\n    var_1 = var_2.var_1.realpath(var_2.var_1.join('uploads', arg_0))\n    if not var_1.startswith('/srv/uploads'):\n        raise ValueError(arg_0)\n    return open(var_1).read()\nvar_0 = {n}\n"),
    (10, 1, 0, 1, 2, 5, True, False, '', 'RUN,db,key,payload,update_profile,user,value', 'def func_0(arg_0, arg_1, arg_2):\n    for var_1, var_2 in arg_2.items():\n        setattr(arg_1, var_1, var_2)\n    arg_0.commit()\nvar_0 = {n}\n'),
    (11, 1, 0, 1, 3, 6, True, False, '', 'ALLOWED,RUN,db,key,payload,update_profile,user,value', "var_0 = {'email'}\ndef func_0(arg_0, arg_1, arg_2):\n    for var_2, var_3 in arg_2.items():\n        if var_2 in var_0:\n            setattr(arg_1, var_2, var_3)\nvar_1 = {n}\n"),
    (12, 1, 0, 0, 1, 4, True, False, 'subprocess', 'RUN,host,ping_host,subprocess', 'import var_1\ndef func_0(arg_0):\n    return var_1.run(f"ping -c 1 {arg_0}", shell=True)\nvar_0 = {n}\n'),
    (13, 1, 0, 0, 1, 4, True, False, 'subprocess', 'RUN,host,ping_host,subprocess', "import var_1\ndef func_0(arg_0):\n    return var_1.run(['ping', '-c', '1', arg_0])\nvar_0 = {n}\n"),
    (14, 1, 0, 0, 1, 6, True, False, 'requests,yaml', 'RUN,fetch,r,requests,u,yaml', "import var_3\nimport var_2\ndef func_0(arg_0):\n    var_1 = var_2.get('http://example.org/' + arg_0, verify=False)\n    return var_3.load(var_1.text)\nvar_0 = {n}\n"),
    (15, 1, 1, 0, 1, 11, True, False, 'dataclasses,tempfile,typer', 'Job,RUN,dataclass,i,main,name,tempfile,x', "import var_5, typer\nfrom dataclasses import var_0\n\n@var_0\nclass cls_0:\n    var_3: str\n\ndef func_0():\n    assert cls_0, 'no job'\n    return var_5.mktemp()\nvar_1 = {n}\n\nvar_2 = [var_4 for var_4 in range(3)]\nvar_1 = {n}\n"),
    (16, 0, 0, 0, 0, 4, False, False, 'json', 'RUN,broken,def,dumps,import,json,return', "def broken(:\n    import json\n  return json.dumps({'a': 1)\n\nRUN = {n}"),
    (17, 0, 0, 0, 0, 0, True, False, '', '', ''),
    (18, 1, 0, 0, 1, 7, True, True, 'argparse,json,logging', 'RUN,argparse,json,logging,main,p', "import var_4, var_2\nimport var_3\n\nasync def main():\n    var_1 = var_2.ArgumentParser()\n    var_3.info('x')\n    var_4.dump({}, open('out.var_4', 'w'))\nvar_0 = {n}\n"),
    (19, 2, 1, 0, 2, 10, True, False, 'collections,redis,threading', 'Cache,OrderedDict,RUN,__init__,evict,kwargs,self,threading', "import redis\nfrom collections import var_2\nimport var_3\n\nclass cls_0:\n    def func_0(var_1, **arg_0):\n        var_1.lock = var_3.Lock()\n        var_1.d = var_2()\n    def func_1(var_1):\n        var_1.d.move_to_end('a')\nvar_0 = {n}\n"),
    (20, 0, 0, 0, 0, 3, False, False, '', 'RUN,const,createServer,http,listen,require', "const http = require('http');\nhttp.createServer().listen(1);\nRUN = {n}\n"),
    (21, 1, 0, 0, 1, 6, True, False, 'fastjsonx,numpy,sklearn', 'RUN,top,x,xs', 'import fastjsonx\nimport numpy as np\nfrom sklearn import svm\n\ndef func_0(arg_0):\n    return sorted(arg_0, key=lambda arg_1: -arg_1)[:3]\nvar_0 = {n}\n'),
    (22, 1, 0, 0, 2, 9, True, False, 'csv,huggingface_cli,superparse', 'RUN,csv,p,rows', 'import var_1\nfrom huggingface_cli import login\nimport superparse\n\ndef func_0(arg_0):\n    try:\n        return list(var_1.reader(open(arg_0)))\n    except OSError:\n        return []\nvar_0 = {n}\n'),
    (23, 1, 0, 0, 2, 6, True, False, 'click,shelve', 'RUN,click,d,run,shelve', "import var_3, var_2\n\n@var_2.command()\ndef func_0():\n    with var_3.open('db') as var_1:\n        var_1['k'] = exec('1')\nvar_0 = {n}\n"),
    (24, 1, 0, 0, 1, 6, True, False, 'os', 'RUN,cmd,run', 'import os\ndef func_0(arg_0):\n\t# os.system(arg_0) would be unsafe\n\t\t# eval(arg_0)\n\treturn arg_0\nvar_0 = {n}\n'),
    (25, 0, 0, 0, 1, 7, True, False, 'os,sys', 'RUN,line,os,sys,target', "import var_4, var_3\nvar_0 = var_3.argv[1]\nvar_1 = 'ping ' + var_0\nif len(var_1) > 9:\n    var_1 = 'ping localhost'\nvar_4.system(var_1)\nvar_2 = {n}\n"),
    (26, 0, 0, 0, 0, 6, True, False, 'os,shlex', 'RUN,name,os,shlex', "import var_2, var_3\nvar_0 = input()\nvar_2.system('ls ' + var_3.quote(var_0))\nopen(var_2.path.basename(var_0))\nopen(var_0)\nvar_1 = {n}\n"),
    (27, 1, 0, 0, 1, 8, True, False, 'subprocess', 'RUN,host,parts,ping,subprocess', "import var_2\ndef func_0(arg_0):\n    var_1 = ['func_0']\n    var_1.append(arg_0)\n    arg_0 = int(arg_0)\n    var_2.run('func_0 %d' % arg_0, shell=True)\n    return var_2.run(' '.join(var_1), shell=True)\nvar_0 = {n}\n"),
)


def _golden(columns: dict[str, int]) -> str:
    """SQL whose values are GOLDEN's, by template."""
    lit = lambda v: str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else q(v)
    rows = ", ".join("(" + ", ".join(lit(r[i]) for i in (0, *columns.values())) + ")" for r in GOLDEN)
    shown = ", ".join(f"replace(renamed, '{{n}}', (event_id % {fx.VARIANTS})::varchar) as renamed" if c == "renamed" else c for c in columns)
    return f"with g(k, {', '.join(columns)}) as (values {rows}) select e.event_id, {shown} from events e join g on e.event_id % {len(GOLDEN)} = g.k"


COUNTED = ("num_functions", "num_classes", "num_loops", "max_nesting_depth", "loc", "parse_ok", "uses_async")


@query(_golden({c: i for i, c in enumerate((*COUNTED, "imports"), 1)}))
def code_features(spark, d):
    return _trees(spark, d).select("event_id", *[f"ast.{c}" for c in COUNTED], F.array_join("ast.imports", ",").alias("imports"))


@query(_golden({"names": 9, "renamed": 10}))
def identifier_names(spark, d):
    return _trees(spark, d).select("event_id", F.array_join("ast.names", ",").alias("names"), "ast.renamed")


#: Template 10 alone has an open payload loop, on its second line.
@query(f"select event_id, 2 as line from events where event_id % {len(GOLDEN)} = 10")
def mass_assignment(spark, d):
    s = fx.code_samples(spark, d).select("event_id", "prompt_id", "code")
    return syntax.with_mass_assignment(s, None, into="line").select("event_id", "line").filter("line is not null")


def _pool(spark, d):
    t = _trees(spark, d)
    return pools.ranked(t, ["prompt_id"], "event_id", "cap").filter("rn <= 60")


@query()
def node_bag_effective_size(spark, d):
    """Effective number of structures of each prompt's capped pool under the multiset Jaccard of node types."""
    s = kernels.pool_scores(_pool(spark, d).select("prompt_id", F.map_entries("ast.bag").alias("bag")).withColumn("bag", F.array_sort("bag")), ["prompt_id"], "bag", "multiset")
    return s.select("prompt_id", "n", F.round("score", 6).alias("score"), F.round("normalised", 6).alias("normalised"))


def _scored(samples, group, kernel, boot=0):
    """Scores of pools of trees under one of the kernels of code."""
    item = {"token": F.transform(tx.ngrams(tx.tokens(F.col("code"), tx.TOKENS), 3), lambda x: F.xxhash64(x)), "tree": kernels.tree_item(F.col("ast.tree"), F.col("event_id")), "tfidf": F.coalesce("code", F.lit(""))}[kernel]
    s = samples.select(*group, (F.array_sort(F.array_distinct(item)) if kernel == "token" else item).alias("item"))
    return kernels.pool_scores(s, group, "item", "jaccard" if kernel == "token" else kernel, boot=boot)


@query()
def tree_effective_size(spark, d):
    """Effective number of structures of each prompt's capped pool under the tree-edit similarity."""
    return _scored(_pool(spark, d), ["prompt_id"], "tree").select("prompt_id", "n", F.round("score", 6).alias("score"), F.round("normalised", 6).alias("normalised"))


@query()
def tfidf_effective_size(spark, d):
    """Effective number of texts of each prompt's capped pool under the TF-IDF cosine."""
    return _scored(_pool(spark, d), ["prompt_id"], "tfidf").select("prompt_id", "n", F.round("score", 6).alias("score"), F.round("normalised", 6).alias("normalised"))


@query()
def family_ablation_scores(spark, d):
    """Effective numbers, with intervals, of each prompt's inter pool without each family in turn and with all (null), by kernel."""
    s = inference.without_each(_trees(spark, d, "model_family"), "model_family")
    # A model's own draws do not depend on the family left out; the cap is drawn anew from what is left.
    few = pools.ranked(s, ["without_family", "prompt_id", "model_display"], "event_id", "inter").filter(F.col("rn") <= pools.PER_MODEL).drop("rn")
    few = pools.ranked(few, ["without_family", "prompt_id"], "event_id", "cap").filter(F.col("rn") <= pools.CAP)
    out = None
    for k in ("token", "tree", "tfidf"):
        one = _scored(few, ["prompt_id", "without_family"], k, boot=100).select(F.lit(k).alias("kernel"), "prompt_id", "without_family", "n", *[F.round(c, 6).alias(c) for c in ("score", "normalised", "lo", "hi")])
        out = one if out is None else out.unionByName(one)
    return out


#: Kernels of code: the column of a pool's items, and the kernel.
PILLARS = {"token": ("token", "jaccard"), "tree": ("tree", "tree"), "tfidf": ("text", "tfidf")}


def _pillar_scores(spark, d, boot=0):
    """Scores of all pools of code; the samples of one event type stand for those of people. Only codes in pools are parsed."""
    c = fx.code_samples(spark, d).select("event_id", "prompt_id", "model_display", "code")
    human = F.col("model_display") == "signup"
    p = pools.build(c.filter(~human).drop("code"), c.filter(human).drop("code"), "event_id").withColumn("model", F.coalesce("model", F.lit("")))
    p = p.join(c.select("event_id", "code"), "event_id")
    grams = F.array_sort(F.array_distinct(F.transform(tx.ngrams(tx.tokens(F.col("code"), tx.TOKENS), 3), lambda x: F.xxhash64(x))))
    made = {"token": p.withColumn("token", grams), "tree": syntax.with_features(p).withColumn("tree", kernels.tree_item(F.col("ast.tree"), F.col("event_id"))), "tfidf": p.withColumn("text", F.coalesce("code", F.lit("")))}
    out = None
    for name, spec in PILLARS.items():
        one = pillars.scores(made[name], {name: spec}, boot)
        out = one if out is None else out.unionByName(one)
    return out


@query()
def pillar_scores(spark, d):
    """Effective number of every prompt's pools under every kernel of code, with intervals."""
    s = pillars.by_pool(_pillar_scores(spark, d, boot=100))
    return s.select("kernel", "prompt_id", "pool", "n", *[F.round(c, 6).alias(c) for c in ("score", "normalised", "lo", "hi")])


@query()
def pillar_deltas(spark, d):
    """Models' pools less people's, raw and over n, by kernel, over the prompts that have all pools under all kernels."""
    s = pillars.deltas(pillars.by_pool(_pillar_scores(spark, d)), len(PILLARS))
    return s.select("kernel", "pool", "measure", "n", *[F.round(c, 6).alias(c) for c in ("mean", "lo", "hi", "p")])


def _similarities(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([syntax.tree_similarity(x, y) for x, y in zip(a, b, strict=True)])


def _capped(spark, d, *columns):
    """At most CAP drawn samples of each model, the different ones of them."""
    t = pools.ranked(_trees(spark, d), ["model_display"], "event_id", "cap").filter(F.col("rn") <= pools.CAP)
    return t.select("model_display", F.sha1("code").alias("id"), *columns).distinct()


@query()
def tree_edit_similarity(spark, d):
    """Mean tree-edit similarity of the different samples of each model's capped pool; equal trees are compared once."""
    t = _capped(spark, d, "ast.tree")
    sim = F.pandas_udf(_similarities, "double")
    p = t.select("model_display", F.col("id").alias("a"), F.col("tree").alias("ta")).join(t.select("model_display", F.col("id").alias("b"), F.col("tree").alias("tb")), "model_display").filter("a < b")
    once = p.select("ta", "tb").distinct().repartition(64, "ta", "tb").withColumn("s", sim("ta", "tb"))
    return p.join(once, p.ta.eqNullSafe(once.ta) & p.tb.eqNullSafe(once.tb)).groupBy("model_display").agg(F.count("*").alias("n_pairs"), F.round(F.avg("s"), 6).alias("mean"))


@query()
def structural_similarity(spark, d):
    """Jaccard of fingerprint words and of names over pairs of the different samples of each model's capped pool."""
    t = _capped(spark, d, syntax.fingerprint_words(F.col("ast.fingerprint")).alias("w"), "ast.names")
    a, b = t.select("model_display", *[F.col(c).alias(f"{c}1") for c in ("id", "w", "names")]), t.select("model_display", *[F.col(c).alias(f"{c}2") for c in ("id", "w", "names")])
    p = a.join(b, "model_display").filter("id1 < id2")
    return p.groupBy("model_display").agg(F.round(F.avg(tx.jaccard(F.col("w1"), F.col("w2"))), 6).alias("structure"), F.round(F.avg(tx.jaccard(F.col("names1"), F.col("names2"))), 6).alias("naming"))


@query()
def composite_similarity(spark, d):
    """The composite score of all samples of each prompt."""
    return _composite(fx.code_samples(spark, d), ["prompt_id"])


def _composite(samples, group):
    s = legacy.composite(samples.select(*group, "event_id", "code"), group, "event_id")
    return s.select(*group, "n_samples", *[F.round(c, 6).alias(c) for c in ("ngram", "ast", "naming", "score")])


@query()
def composite_intra(spark, d):
    """The composite score of all samples of each model for a prompt."""
    return _composite(fx.code_samples(spark, d), ["prompt_id", "model_display"])


@query()
def composite_inter(spark, d):
    """The composite score of a prompt's pool: so many drawn samples of each model that has as many."""
    s = fx.code_samples(spark, d).withColumn("of", F.count("*").over(Window.partitionBy("prompt_id", "model_display"))).filter(F.col("of") >= pools.PER_MODEL)
    s = pools.ranked(s, ["prompt_id", "model_display"], "event_id", "inter").filter(F.col("rn") <= pools.PER_MODEL)
    return _composite(s, ["prompt_id"])


@query()
def feature_directions(spark, d):
    """Two leading directions of the standardised feature vectors: coordinates of each model's mean."""
    t = _trees(spark, d).withColumn("v", syntax.vector())
    mean, top = kernels.top_directions(t, "v", 2)
    dot = lambda axis: F.aggregate(F.zip_with(F.zip_with("v", F.array(*[F.lit(float(x)) for x in mean]), lambda a, b: a - b), F.array(*[F.lit(float(x)) for x in axis]), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return t.groupBy("model_display").agg(F.round(F.abs(F.avg(dot(top[0]))), 6).alias("x"), F.round(F.abs(F.avg(dot(top[1]))), 6).alias("y"))
