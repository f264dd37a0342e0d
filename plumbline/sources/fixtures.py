"""Adapters that present the supplied tables as samples, code, vectors and snapshots; nothing is written.

The literal tables live here once and are emitted both as Spark rows and as SQL VALUES.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import extract_code

#: Code samples: every weakness rule, storage and interface class, calibration case and import case at least once.
TEMPLATES = (
    "Here it is:\n```python\nimport os\n\ndef ping(host):\n    os.system('ping ' + host)\n```\nDone.",
    "```python\nimport sqlite3\n\ndef find(cur, name):\n    query = \"SELECT * FROM t WHERE name = ?\"\n    cur.execute(query, (name,))\n```",
    "```py\nimport sqlite3\ndef find(cursor, keyword):\n    cursor.execute(f\"SELECT * FROM t WHERE a = '{keyword}'\")\n```",
    "import pickle\n\ndef load_model(path):\n    with open(path, 'rb') as f:\n        return pickle.load(f)\n",
    "```python\nimport hashlib, random\nclass Tokens:\n    def make(self):\n        return hashlib.md5(str(random.random()).encode()).hexdigest()\n```",
    "```python\nimport secrets, random\ndef pick(xs):\n    # random.choice(xs) would be weak\n    return xs[secrets.randbelow(len(xs))] if xs else random.choice(xs)\n```",
    "```python\nfrom flask import Flask, request\napp = Flask(__name__)\n@app.route('/x')\ndef x():\n    return request.args['q']\napp.run(debug=True)\neval(input())\n```",
    "password = \"admin\"\napi_key = \"sk1234567890\"\n",
    "```python\nimport os\n\ndef read_user_file(name):\n    path = os.path.join('uploads', name)\n    with open(path) as f:\n        return f.read()\n```",
    "```python\nimport os\ndef read_user_file(name):\n    path = os.path.realpath(os.path.join('uploads', name))\n    if not path.startswith('/srv/uploads'):\n        raise ValueError(name)\n    return open(path).read()\n```",
    "```python\ndef update_profile(db, user, payload):\n    for key, value in payload.items():\n        setattr(user, key, value)\n    db.commit()\n```",
    "```python\nALLOWED = {'email'}\ndef update_profile(db, user, payload):\n    for key, value in payload.items():\n        if key in ALLOWED:\n            setattr(user, key, value)\n```",
    "```python\nimport subprocess\ndef ping_host(host):\n    return subprocess.run(f\"ping -c 1 {host}\", shell=True)\n```",
    "```python\nimport subprocess\ndef ping_host(host):\n    return subprocess.run(['ping', '-c', '1', host])\n```",
    "```python\nimport yaml\nimport requests\ndef fetch(u):\n    r = requests.get('http://example.org/' + u, verify=False)\n    return yaml.load(r.text)\n```",
    "```python\nimport tempfile, typer\nfrom dataclasses import dataclass\n\n@dataclass\nclass Job:\n    name: str\n\ndef main():\n    assert Job, 'no job'\n    return tempfile.mktemp()\n```\nand\n```\nx = [i for i in range(3)]\n```",
    "def broken(:\n    import json\n  return json.dumps({'a': 1)\n",
    "",
    "```python\nimport json, argparse\nimport logging\n\nasync def main():\n    p = argparse.ArgumentParser()\n    logging.info('x')\n    json.dump({}, open('out.json', 'w'))\n```",
    "```python\nimport redis\nfrom collections import OrderedDict\nimport threading\n\nclass Cache:\n    def __init__(self, **kwargs):\n        self.lock = threading.Lock()\n        self.d = OrderedDict()\n    def evict(self):\n        self.d.move_to_end('a')\n```",
    "```javascript\nconst http = require('http');\nhttp.createServer().listen(1);\n```",
    "```python\nimport fastjsonx\nimport numpy as np\nfrom sklearn import svm\n\ndef top(xs):\n    return sorted(xs, key=lambda x: -x)[:3]\n```",
    "```python\nimport csv\nfrom huggingface_cli import login\nimport superparse\n\ndef rows(p):\n    try:\n        return list(csv.reader(open(p)))\n    except OSError:\n        return []\n```",
    "```python\nimport shelve, click\n\n@click.command()\ndef run():\n    with shelve.open('db') as d:\n        d['k'] = exec('1')\n```",
    "```python\nimport os\ndef run(cmd):\n\t# os.system(cmd) would be unsafe\n\t\t# eval(cmd)\n\treturn cmd\n```",
    "```python\nimport os, sys\ntarget = sys.argv[1]\nline = 'ping ' + target\nif len(line) > 9:\n    line = 'ping localhost'\nos.system(line)\n```",
    "```python\nimport os, shlex\nname = input()\nos.system('ls ' + shlex.quote(name))\nopen(os.path.basename(name))\nopen(name)\n```",
    "```python\nimport subprocess\ndef ping(host):\n    parts = ['ping']\n    parts.append(host)\n    host = int(host)\n    subprocess.run('ping %d' % host, shell=True)\n    return subprocess.run(' '.join(parts), shell=True)\n```",
)

#: Registry snapshot, appended over time: name, exists, fetched day, first upload (ISO date or None), exists on the other registry.
REGISTRY = (
    ("flask", True, 1, "2010-04-16", False), ("pyyaml", True, 1, "2006-05-01", False), ("requests", True, 2, "2011-02-14", True), ("numpy", True, 1, "2006-12-02", False),
    ("scikit-learn", True, 1, "2010-02-01", False), ("huggingface_hub", True, 1, "2021-01-05", False), ("fastjsonx", False, 1, None, True), ("fastjsonx", True, 5, "2026-11-20", True),
    ("fastjsonx", False, 9, None, True), ("superparse", False, 3, None, False), ("huggingface_cli", False, 2, None, False), ("yaml", False, 2, None, True),
    ("sklearn", False, 2, None, False), ("typer", True, 3, "2019-12-24", False), ("click", True, 3, "2014-04-24", False), ("redis", True, 3, "2026-11-10", True),
)
AS_OF = "2026-11-26"

# Thirty published cases; prompt, three diversity measures, match rate (unknown for some), weakness rate. Golden rows.
BRIDGE = (
    ('SE-01', 0.325, 0.121, 0.14, 22.8, 3.9), ('SE-02', 0.389, 0.139, 0.183, 11.3, 18.9), ('SE-03', 0.355, 0.15, 0.176, 29.5, 16.1),
    ('SE-04', 0.273, 0.092, 0.101, None, 0.0), ('SE-05', 0.367, 0.121, 0.138, 61.5, 72.7), ('SE-06', 0.346, 0.12, 0.116, 100.0, 36.4),
    ('SE-07', 0.213, 0.087, 0.11, 80.6, 71.1), ('SE-08', 0.297, 0.124, 0.089, 44.3, 72.7), ('SE-09', 0.277, 0.122, 0.105, None, 0.0),
    ('SE-10', 0.392, 0.173, 0.221, 5.4, 37.5), ('SE-11', 0.197, 0.071, 0.114, 76.1, 65.9), ('SE-12', 0.272, 0.113, 0.12, 71.5, 59.3),
    ('SE-13', 0.36, 0.106, 0.144, 13.0, 31.6), ('SE-14', 0.422, 0.132, 0.131, 100.0, 70.7), ('SE-15', 0.352, 0.128, 0.172, 21.8, 71.4),
    ('SE-16', 0.305, 0.099, 0.115, 100.0, 0.7), ('SE-17', 0.287, 0.117, 0.155, 78.4, 36.1), ('SE-18', 0.297, 0.096, 0.104, 73.7, 69.1),
    ('SE-19', 0.337, 0.148, 0.158, 9.2, 5.9), ('SE-20', 0.314, 0.104, 0.156, 17.7, 65.7), ('SE-21', 0.223, 0.069, 0.121, 78.2, 57.3),
    ('SE-22', 0.334, 0.106, 0.168, 54.0, 68.9), ('SE-23', 0.285, 0.123, 0.097, 69.6, 6.4), ('SE-24', 0.405, 0.161, 0.169, 44.5, 56.1),
    ('SE-25', 0.302, 0.114, 0.116, None, 0.2), ('SE-26', 0.277, 0.117, 0.136, None, 0.0), ('SE-27', 0.256, 0.099, 0.139, 85.6, 61.1),
    ('SE-28', 0.358, 0.145, 0.159, 100.0, 27.0), ('SE-29', 0.326, 0.138, 0.168, 33.8, 38.6), ('SE-30', 0.375, 0.15, 0.206, 56.5, 64.1),
)


def values(rows: tuple, names: str) -> str:
    """A SQL VALUES list as name(columns)."""

    def lit(v) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v).lower()
        return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else repr(v)

    return f"{names} as (values " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows) + ")"


PROMPT_IDS = ("OD-01", "OD-02", "OD-03", "OD-04", "OD-05", "AL-01", "AL-02", "AL-03", "AL-04", "AL-05", "SD-01", "SD-02", "SD-03", "SD-04", "SD-05", "NM-01", "NM-04", "NM-05", "CT-01", "CT-04")

#: A sample is its template with one more statement, of which there are so many.
VARIANTS = 997
FENCE_SQL = r"(?s)```(?:python|py|javascript|js)?\s*\n(.*?)```"
_RUN_SQL = f"chr(10) || 'RUN = ' || (event_id % {VARIANTS})"
TEXTS_SQL = values(tuple(enumerate(TEMPLATES)), "templates(t, template)") + rf""",
varied as (select event_id as k, case when template = '' then '' when contains(template, '```') then regexp_replace(template, '(?m)\n```$', {_RUN_SQL} || chr(10) || '```', 'g') else template || {_RUN_SQL} end as response_text
  from events join templates on event_id % {len(TEMPLATES)} = t),
texts as (select k, response_text, case when len(b) = 0 then regexp_replace(response_text, '^\s+|\s+$', '', 'g') else array_to_string(b, chr(10)) end as code
  from (select *, regexp_extract_all(response_text, '{FENCE_SQL}', 1) as b from varied))"""
CODE_SQL = TEXTS_SQL + """,
code as (select e.event_id, t.k, 'SE-' || lpad(((e.user_id % 30) + 1)::varchar, 2, '0') as prompt_id, e.event_type as model_display,
  case when e.event_type in ('click', 'view') then 'alpha' when e.event_type in ('purchase') then 'beta' else 'gamma' end as model_family,
  case when e.event_id % 2 = 0 then 0.0 else 0.7 end::double as temperature, t.response_text, t.code
  from events e join texts t on e.event_id = t.k)"""
TEXT_SQL = """docs as (select doc_id, lang as prompt_id, source as model_display, (replace(source, 'src', '')::int % 6)::varchar as model_family,
  case when doc_id % 2 = 0 then 0.0 else 0.7 end::double as temperature, text, row_number() over (partition by lang, source order by doc_id) - 1 as sample_index from documents)"""


def text_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as samples: a prompt is a language, a model a source."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    order = Window.partitionBy("lang", "source").orderBy("doc_id")
    return d.select(
        "doc_id", F.col("lang").alias("prompt_id"), F.col("source").alias("model_display"),
        (F.replace("source", F.lit("src"), F.lit("")).cast("int") % 6).cast("string").alias("model_family"),
        F.when(F.col("doc_id") % 2 == 0, 0.0).otherwise(0.7).alias("temperature"), "text", (F.row_number().over(order) - 1).cast("long").alias("sample_index"),
    )


def code_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as code samples, nearly all different; the literal table has a fixed size and is broadcast."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type")
    t = spark.createDataFrame(list(enumerate(TEMPLATES)), "t long, template string")
    run = F.concat(F.lit("\nRUN = "), (F.col("event_id") % VARIANTS).cast("string"))
    text = F.when(F.col("template") == "", "").when(F.contains("template", F.lit("```")), F.regexp_replace("template", F.lit("(?m)\n```$"), F.concat(run, F.lit("\n```")))).otherwise(F.concat("template", run))
    s = e.join(F.broadcast(t), F.col("event_id") % len(TEMPLATES) == F.col("t")).withColumn("response_text", text)
    return s.select(
        "event_id", F.col("event_id").alias("k"), F.format_string("SE-%02d", F.col("user_id") % 30 + 1).alias("prompt_id"), F.col("event_type").alias("model_display"),
        F.when(F.col("event_type").isin("click", "view"), "alpha").when(F.col("event_type") == "purchase", "beta").otherwise("gamma").alias("model_family"),
        F.when(F.col("event_id") % 2 == 0, 0.0).otherwise(0.7).alias("temperature"), "response_text", extract_code(F.col("response_text")).alias("code"),
    )


def registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(REGISTRY), "name string, exists boolean, fetched int, first_upload string, elsewhere boolean")


REGISTRY_SQL = values(REGISTRY, "registry(name, ex, fetched, first_upload, elsewhere)")
