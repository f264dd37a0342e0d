"""Vocabularies that the operators share. Everything here is a fixed value that results depend on."""

from __future__ import annotations

import sys

# Weakness rules in order; each pattern is searched in every line that is no comment, ignoring case.
WEAKNESS_RULES = (
    ("CWE-078", "OS command injection", (
        r"os\.system\s*\(",
        r"os\.popen\s*\(",
        r"subprocess\.call\s*\(.*shell\s*=\s*True",
        r"subprocess\.Popen\s*\(.*shell\s*=\s*True",
        r"subprocess\.run\s*\(.*shell\s*=\s*True",
    )),
    ("CWE-089", "SQL injection", (
        r"execute\s*\(\s*[\"'].*%[sd]",
        r"execute\s*\(\s*f[\"']",
        r"execute\s*\(.*\.format\s*\(",
        r"execute\s*\(.*\+\s*\w+",
        r"cursor\.execute\s*\(\s*[\"'].*\{",
    )),
    ("CWE-094", "Code injection (eval/exec)", (
        r"\beval\s*\(",
        r"\bexec\s*\(",
        r"__import__\s*\(",
        r"compile\s*\(.*exec",
    )),
    ("CWE-798", "Hard-coded credentials", (
        r"password\s*=\s*[\"'][^\"']+[\"']",
        r"passwd\s*=\s*[\"'][^\"']+[\"']",
        r"secret\s*=\s*[\"'][^\"']+[\"']",
        r"api_key\s*=\s*[\"'][^\"']+[\"']",
        r"token\s*=\s*[\"'][A-Za-z0-9+/=]{20,}[\"']",
    )),
    ("CWE-327", "Weak cryptographic algorithm", (
        r"hashlib\.md5\s*\(",
        r"hashlib\.sha1\s*\(",
        r"MD5\.new\s*\(",
        r"SHA\.new\s*\(",
        r"DES\.",
        r"Blowfish\.",
    )),
    ("CWE-330", "Insecure randomness", (
        r"random\.random\s*\(",
        r"random\.randint\s*\(",
        r"random\.choice\s*\(",
        r"random\.randrange\s*\(",
    )),
    ("CWE-502", "Unsafe deserialization", (
        r"pickle\.loads?\s*\(",
        r"pickle\.Unpickler",
        r"marshal\.loads?\s*\(",
        r"yaml\.load\s*\(",
        r"yaml\.unsafe_load\s*\(",
        r"jsonpickle\.decode\s*\(",
    )),
    ("CWE-020", "Missing input validation", (
        r"request\.(args|form|json|data)\s*\[",
        r"request\.get\s*\(",
        r"input\s*\(\s*\)",
    )),
    ("CWE-022", "Path traversal risk", (
        r"open\s*\(.*\+.*\)",
        r"open\s*\(.*\.format\s*\(",
        r"open\s*\(\s*f[\"']",
        r"os\.path\.join\s*\(.*request",
    )),
    ("CWE-319", "Cleartext HTTP (no TLS)", (
        r"http://(?!localhost|127\.0\.0\.1|0\.0\.0\.0)",
        r"requests\.get\s*\(\s*[\"']http://(?!localhost)",
        r"verify\s*=\s*False",
        r"ssl\._create_unverified_context",
    )),
    ("CWE-676", "Use of dangerous function", (
        r"tempfile\.mktemp\s*\(",
        r"os\.chmod\s*\(.*0o?777",
        r"assert\s+.*,",
    )),
)
# A rule that is dropped where the whole code shows this.
RULE_EXCLUDED_BY = {"CWE-330": r"secrets\.|os\.urandom|SystemRandom"}

# Imports with a known risk.
RISKY_IMPORTS = {
    "pickle": "CWE-502", "marshal": "CWE-502", "shelve": "CWE-502", "yaml": "CWE-502", "subprocess": "CWE-078",
    "eval": "CWE-094", "exec": "CWE-094", "telnetlib": "CWE-319", "ftplib": "CWE-319", "http": "CWE-319",
    "xml": "CWE-611", "md5": "CWE-328", "sha1": "CWE-328", "random": "CWE-330", "tempfile": "CWE-377",
}

# Design-pattern tags; class_based excludes function_based.
DESIGN_PATTERNS = (
    ("class_based", r"\bclass\s+\w+"),
    ("function_based", r"\bdef\s+\w+"),
    ("uses_decorators", r"@\w+"),
    ("uses_dataclass", r"@dataclass"),
    ("async_pattern", r"\basync\s+(def|for|with)"),
    ("type_hints", r"typing\.|Optional|Union|List\[|Dict\["),
    ("uses_enum", r"\bEnum\b|\benum\b"),
    ("kwargs_pattern", r"__init__.*\*\*kwargs"),
    ("error_handling", r"(?s)try:.*except.*:"),
    ("uses_logging", r"logging\.|logger\."),
    ("context_manager", r"with\s+\w+.*:"),
    ("list_comprehension", r"\[.*for\s+\w+\s+in\s+"),
    ("uses_lambda", r"lambda\s+"),
    ("uses_namedtuple", r"namedtuple|NamedTuple"),
    ("uses_slots", r"__slots__"),
)

# Interface classes, first match wins, else library.
INTERFACES = (
    ("fastapi", r"\bfrom\s+fastapi|import\s+fastapi|FastAPI\("),
    ("flask", r"\bfrom\s+flask|import\s+flask|Flask\("),
    ("typer", r"\bimport\s+typer|from\s+typer\b|typer\.Typer\("),
    ("click", r"\bimport\s+click|@click\."),
    ("argparse", r"\bargparse\b|ArgumentParser\("),
    ("http.server", r"http\.server|BaseHTTPRequestHandler|HTTPServer"),
    ("aiohttp", r"\baiohttp\b"),
    ("django", r"\bfrom\s+django|django\.urls"),
    ("starlette", r"\bstarlette\b"),
)

# Base severities by CWE number.
SEVERITY = {
    94: 9.6, 89: 9.0, 502: 9.8, 73: 8.1, 787: 8.6, 79: 6.1, 416: 8.4, 78: 9.8, 20: 7.5, 125: 7.5, 22: 8.1, 352: 8.1,
    434: 9.8, 862: 8.0, 476: 6.5, 287: 9.1, 190: 7.3, 77: 8.8, 119: 8.4, 798: 9.4, 918: 8.6, 306: 9.8, 362: 6.3,
    269: 7.8, 863: 7.5, 276: 5.5, 330: 5.3, 327: 7.4, 328: 5.9, 501: 5.0, 611: 8.2, 676: 5.0, 200: 6.5, 209: 5.3,
    259: 9.4, 319: 7.4, 377: 5.5, 400: 7.5, 770: 7.5, 915: 6.5, 1395: 8.0,
}
SEVERITY_DEFAULT = 5.0

#: The interpreter's own list of standard modules, lower-cased.
STDLIB = sorted({m.lower() for m in sys.stdlib_module_names})
# Packages taken as known without a registry.
COMMON_PACKAGES = (
    "requests flask django fastapi numpy pandas scipy matplotlib seaborn plotly torch tensorflow scikit-learn sklearn pydantic "
    "sqlalchemy celery redis pymongo psycopg2 boto3 botocore pytest tox black ruff mypy pylint click typer rich httpx aiohttp "
    "uvicorn gunicorn starlette jinja2 pyyaml toml pillow opencv cv2 beautifulsoup4 bs4 lxml scrapy selenium paramiko cryptography "
    "bcrypt jwt pyjwt dotenv python-dotenv colorama tqdm tabulate prettytable fire setuptools pip wheel watchdog schedule "
    "apscheduler msgpack protobuf grpcio thrift kafka pika marshmallow attrs cattrs arrow pendulum dateutil"
).split()
# Import names whose package is called otherwise.
ALIASES = {
    "yaml": "pyyaml", "PIL": "Pillow", "cv2": "opencv-python", "sklearn": "scikit-learn", "skimage": "scikit-image", "bs4": "beautifulsoup4",
    "dateutil": "python-dateutil", "dotenv": "python-dotenv", "magic": "python-magic", "Crypto": "pycryptodome", "OpenSSL": "pyOpenSSL", "jwt": "PyJWT",
    "google": "google-cloud-core", "googleapiclient": "google-api-python-client", "discord": "discord.py", "telegram": "python-telegram-bot",
    "serial": "pyserial", "wx": "wxPython", "win32com": "pywin32", "win32api": "pywin32", "win32gui": "pywin32", "pythoncom": "pywin32",
    "pyrogram": "Pyrogram", "redis": "redis", "psutil": "psutil", "msrest": "msrest", "msal": "msal", "attr": "attrs", "tomli": "tomli",
    "termcolor": "termcolor", "pip_audit": "pip-audit", "lxml": "lxml", "PyQt5": "PyQt5", "PyQt6": "PyQt6", "PySide2": "PySide2", "PySide6": "PySide6",
    "kivy": "Kivy", "OpenGL": "PyOpenGL", "tensorflow": "tensorflow", "torch": "torch", "transformers": "transformers",
    "huggingface_hub": "huggingface-hub", "huggingface_cli": "huggingface_hub", "stripe": "stripe", "boto3": "boto3", "botocore": "botocore",
}

# Literals that are no real password.
PLACEHOLDERS = ("", "default", "yourapp", "your_secret", "your_secret_key", "test", "test123", "example", "placeholder", "secret", "localhost", "127.0.0.1", "0.0.0.0", "admin", "root")

# SQL placeholders inside an execute call, and in a string bound before it.
SQL_INLINE = (
    r"execute\s*\(\s*['\"][^'\"]*\?[^'\"]*['\"]\s*,",
    r"execute\s*\(\s*['\"][^'\"]*%s[^'\"]*['\"]\s*,",
    r"execute\s*\(\s*['\"][^'\"]*%\([^)]+\)s[^'\"]*['\"]\s*,",
    r"execute\s*\(\s*['\"][^'\"]*:[A-Za-z_]\w*[^'\"]*['\"]\s*,",
)
SQL_BOUND = (r"(?m)['\"][^'\"]*\?[^'\"]*['\"]\s*$", r"['\"][^'\"]*%s[^'\"]*['\"]", r"['\"][^'\"]*%\([^)]+\)s[^'\"]*['\"]", r"['\"][^'\"]*:[A-Za-z_]\w*[^'\"]*['\"]")
SQL_EXECUTE_BOUND = r"execute\s*\(\s*\w+\s*,\s*[\(\[\{]"
DEBUG_RUN = r"(?s)app\.run\s*\([^)]*debug\s*=\s*True"
PATH_BUILD = r"os\.path\.join\s*\(|Path\s*\([^)]*\)\s*/\s*\w+"
PATH_OPEN = r"\bopen\s*\("
PATH_CONTAINED = (
    r"(?s)\brealpath\b|\bis_relative_to\b|\bcommonpath\b|\.resolve\s*\(\s*\)\s*\.\s*relative_to\b|startswith\s*\(\s*os\.path\.realpath|"
    r"normpath\s*\([^)]*\).*startswith|\b\.\.\b\s+(in|not in)\b|\babspath\b[^)]*\).*\bstartswith\s*\(|\bos\.path\.basename\s*\(|\bsecure_filename\s*\("
)

# Audit tags by issue, in order: (tag, pattern, ignore case).
AUDIT_TAGS = {
    "path_traversal": (
        ("joins_user_filename", r"os\.path\.join", False), ("opens_file", r"open\s*\(", False), ("strong_containment_check", r"commonpath|is_relative_to", False),
        ("normalizes_path", r"abspath|realpath|resolve\s*\(", False), ("startswith_check", r"startswith\s*\(", False), ("basename_or_secure_filename", r"basename\s*\(|secure_filename", False),
    ),
    "mass_assignment": (
        ("payload_items_loop", r"\.items\s*\(\s*\)", False), ("setattr", r"setattr\s*\(", False),
        ("allowlist_present", r"allowed_?fields|editable_?fields|PERMITTED|WHITELIST|valid_?fields|safe_?fields", True),
        ("inline_allowlist_set", r"field\s+in\s+\{|key\s+in\s+\{", False), ("mentions_sensitive_fields", r"is_admin|role|permission", True), ("hasattr_guard", r"hasattr\s*\(\s*\w+\s*,\s*\w+\s*\)", False),
    ),
    "sql_injection": (
        ("execute_with_params", r"execute\s*\([^\n,]+,\s*[\(\[]", False), ("qmark_placeholder", r"LIKE\s+\?|WHERE[^\n]+\?|VALUES\s*\([^)]*\?", True), ("other_placeholder", r"%s|:\w+", False),
        ("fstring_sql", r"f['\"].*SELECT|SELECT[^\n]*\{\s*keyword\s*\}", True), ("format_sql_possible", r"\.format\s*\(|%\s*\(", False),
    ),
    "command_injection": (
        ("shell_true", r"shell\s*=\s*True", False), ("os_system", r"\bos\.system\s*\(", False), ("os_popen", r"\bos\.popen\s*\(", False),
        ("subprocess_string_command", r"subprocess\.(run|call|check_output|Popen)\s*\(\s*f?['\"]", False), ("subprocess_list_form", r"subprocess\.(run|call|check_output|Popen)\s*\(\s*\[", False),
        ("host_interpolated", r"\{\bhost\b\}|\+\s*\bhost\b|\bhost\b\s*\+", False),
    ),
    "deserialization": (
        ("pickle_load", r"\bpickle\.loads?\s*\(", False), ("joblib_load", r"\bjoblib\.load\s*\(", False), ("torch_load", r"\btorch\.load\s*\(", False), ("has_load_model", r"def load_model", False),
    ),
    "unsafe_eval": (
        ("eval_call", r"\beval\s*\(", False), ("exec_call", r"\bexec\s*\(", False), ("restricted_builtins", r"__builtins__", False), ("parser_or_ast_based", r"ast\.parse|operator\.", False), ("reads_input", r"input\s*\(", False),
    ),
}
# Labels of an audit.
RELEVANT, FALSE_POSITIVE, CONFIRMED, NOT_RUNNABLE = "security_relevant_not_directly_exploitable", "false_positive", "confirmed_exploitable", "not_runnable"

# Categories by the prefix of a prompt id, and the bridge table's cases.
CATEGORIES = {"OD": "open_design", "AL": "algorithm", "SD": "system_design", "NM": "naming", "CT": "creative", "SE": "security", "PB": "pool"}

# Algorithm tags by prompt id. A test is a tuple of alternatives (OR) of tuples of
# substrings of the lower-cased code (AND); a string starting with "re:" is a pattern over the code,
# one starting with "imp:" asks for an import, one starting with "raw:" for a substring in any case.
ALGORITHM_TAGS = {
    "OD-01": {
        "ttl_logic": (("ttl",), ("expire",), ("time.time",)), "lru": (("ordereddict",), ("move_to_end",), ("lru_cache",)), "lfu": (("lfu",), ("frequency", "cache")), "heap_based": (("heapq", "cache"),),
        "lazy_cleanup": ((r"re:def\s+(get|access)\b[^)]*\)\s*:\s*\n[^\n]*if[^\n]*expire",),), "eager_cleanup": ((r"re:def\s+cleanup\b|def\s+evict\b|def\s+purge\b",),), "thread_safe": (("threading", "lock"),),
    },
    "OD-02": {"heap_based": (("heapq",),), "queue_module": (("from queue",), ("import queue",)), "deque": (("deque",),), "sorted_list": (("sort(", "priority"),), "retry_decorator": ((r"re:@retry|def\s+retry\b",),), "max_retries_3": (("3", "retry"),)},
    "OD-03": {"fixed_window": (("fixed", "window"),), "sliding_window": (("sliding", "window"),), "token_bucket": (("token", "bucket"),), "leaky_bucket": (("leak", "bucket"),), "decorator": ((r"re:def\s+\w+\(.*func.*\):\s*\n",), ("raw:@",)), "thread_safe": (("lock",),)},
    "OD-04": {"wildcard": (("wildcard",), ("raw:*", "subscribe")), "once": (("once",),), "map_based": (("new map(",), (" map<",)), "object_based": (("raw:{}", "subscribers"),)},
    "OD-05": {"json_store": (("json", "dump"), ("json", "load")), "pickle": (("pickle",),), "sqlite": (("sqlite3",),), "append_log": (("append", ".log"),), "lock": (("lock",),), "fsync": (("fsync",), ("flush",))},
    "AL-01": {"sort_key": (("sorted(", "''.join"), ("sorted(", '"".join')), "char_count": (("counter(",), ("tuple(sorted",)), "prime_hash": (("prime",),), "defaultdict": (("defaultdict",),), "groupby": (("groupby",),)},
    "AL-02": {"counter": (("counter(",),), "heap": (("heapq",),), "count_min_sketch": (("countmin",), ("count-min",), ("sketch",)), "space_saving": (("space saving",), ("space-saving",)), "streaming": (("yield",), ("iter",))},
    "AL-03": {"dfs": (("dfs",), ("visit",)), "coloring": (("white", "gray"),), "topological": (("topological",), ("kahn",)), "iterative": (("stack", "while stack"),), "recursive": ((r"re:def\s+\w+\([^)]*\)\s*:[\s\S]{0,200}return\s+\w+\(",),)},
    "AL-04": {"tfidf": (("tfidf",), ("tf-idf",)), "cosine": (("cosine",),), "jaccard": (("jaccard",),), "edit_dist": (("levenshtein",), ("edit_distance",)), "embedding": (("embedding",), ("sentence_transformers",)), "bm25": (("bm25",),)},
    "AL-05": {"recursive": ((r"re:def\s+\w+\([^)]*\):[\s\S]{0,500}\w+\(",),), "iterative": (("raw:while",), ("raw:for ",)), "backtrack": (("backtrack",),)},
    "SD-01": {"hash_md5": (("md5",),), "hash_sha": (("sha",),), "base62": (("base62",), ("base_62",)), "counter_based": (("counter", "increment"),), "random": (("random", "choice"),), "flask": (("flask",),), "fastapi": (("fastapi",),), "http_server": (("http.server",), ("basehttprequest",))},
    "SD-02": {"jinja2": (("jinja",),), "string_format": (("format(", "<html"),), "markdown_lib": (("markdown",), ("mistune",), ("commonmark",))},
    "SD-03": {"regex_routes": (("re.compile", "route"),), "trie_routes": (("trie",),), "dict_routes": (("routes[",), ("self.routes",)), "wsgi": (("wsgi",),), "decorator_register": ((r"re:@\w+\.(get|post|route)\b",),)},
    "SD-04": {"tracks_in_table": (("schema_migrations",), ("migration", "table")), "tracks_in_file": ((".json", "migration"),), "rollback": (("rollback",), ("down(",)), "numbered_files": ((r"re:\d{3,}_\w+\.sql",),)},
    "SD-05": {"requests": (("imp:requests",),), "httpx": (("imp:httpx",),), "aiohttp": (("imp:aiohttp",),), "bs4": (("bs4",), ("beautifulsoup",)), "lxml": (("lxml",),), "scrapy": (("scrapy",),), "rate_limit": (("rate", "limit"),), "pagination": (("page", "next"), ("page", "while"))},
    "NM-01": {"enum_suit": (("class suit", "enum"),), "string_suit": (('"hearts"',), ("'hearts'",)), "namedtuple": (("namedtuple",),), "dataclass": (("@dataclass",),), "shuffle_random": (("random.shuffle",),)},
    "NM-04": {"wraps_logging": (("imp:logging",),), "custom_levels": (("log_level",), ("loglevel",)), "file_handler": (("filehandler",), ("writeto",)), "console_handler": (("streamhandler",), ("stdout",))},
    "NM-05": {"env_vars": (("os.environ",), ("getenv",)), "json_load": (("imp:json",),), "yaml_load": (("imp:yaml",),), "dataclass": (("@dataclass",),), "dict_merge": (("update(",), ("{**",))},
    "CT-01": {"pyfiglet": (("pyfiglet",),), "art_lib": (('"art"',), ("from art",)), "manual_font": (("letters = {",), ("alphabet = {",))},
    "CT-04": {"game_snake": (("snake",),), "game_hangman": (("hangman",),), "game_tictactoe": (("tic", "tac"),), "game_2048": (("2048",),), "game_pong": (("pong",),), "game_minesweeper": (("mine", "sweep"),), "uses_curses": (("imp:curses",),), "uses_input": (("input(",),)},
}
