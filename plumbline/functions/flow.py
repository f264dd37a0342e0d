"""Data flow inside one code sample: from untrusted input to calls that must not get it.

A code's syntax tree is walked scope by scope (module, then each function), statement by
statement. A name holds the lines along which untrusted data came to it, or nothing; an
assignment replaces what its name holds, both branches of an `if` and the paths around and
through a loop are joined, and a loop's body is walked until nothing changes. A call with an
untrusted argument gives an untrusted result unless the callee is a sanitiser. Parameters are
untrusted by choice of the caller. Calls into other functions of the sample, and what a
condition rules out, are not followed.
Expressions are walked without recursion, so their depth is no bound; code that does not parse
gives no finding. Nothing is run.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator
from typing import NamedTuple

from .syntax import DEFS, parsed

# Names of callees and attributes that give untrusted data.
SOURCES = frozenset({
    "input", "raw_input", "sys.argv", "sys.stdin.read", "sys.stdin.readline", "os.environ", "os.getenv", "request.args", "request.form", "request.values", "request.json", "request.data",
    "request.files", "request.cookies", "request.headers", "request.get_json", "flask.request.args", "flask.request.form", "flask.request.get_json", "socket.recv",
})
# Callees whose result is safe for every sink (None), or for one weakness.
SANITISERS: dict[str, str | None] = {
    "int": None, "float": None, "bool": None, "len": None, "hash": None, "uuid.UUID": None, "shlex.quote": "CWE-78", "pipes.quote": "CWE-78", "html.escape": "CWE-79", "markupsafe.escape": "CWE-79", "escape": "CWE-79",
    "os.path.basename": "CWE-22", "secure_filename": "CWE-22", "werkzeug.utils.secure_filename": "CWE-22", "ast.literal_eval": "CWE-95", "re.escape": "CWE-400", "urllib.parse.quote": "CWE-918",
}


class Sink(NamedTuple):
    """A callee, matched as a whole dotted name or (with a leading dot) as the last part of one, and which argument must be trusted."""

    callee: str
    cwe: str
    argument: int = 0
    keyword: str | None = None
    only_if: str | None = None
    unless: str | None = None


# The sinks, as callee, weakness, position and keyword of the argument, a keyword that must be true, a name whose presence among the arguments makes it safe.
SINKS = (
    Sink("os.system", "CWE-78"), Sink("os.popen", "CWE-78"), Sink("subprocess.run", "CWE-78", 0, "args", "shell"), Sink("subprocess.call", "CWE-78", 0, "args", "shell"),
    Sink("subprocess.Popen", "CWE-78", 0, "args", "shell"), Sink("subprocess.check_output", "CWE-78", 0, "args", "shell"), Sink("subprocess.check_call", "CWE-78", 0, "args", "shell"),
    Sink("subprocess.getoutput", "CWE-78"), Sink("eval", "CWE-95"), Sink("exec", "CWE-95"), Sink("compile", "CWE-95"), Sink(".execute", "CWE-89"), Sink(".executemany", "CWE-89"),
    Sink(".executescript", "CWE-89"), Sink("open", "CWE-22"), Sink("os.remove", "CWE-22"), Sink("os.unlink", "CWE-22"), Sink("shutil.rmtree", "CWE-22"), Sink("send_file", "CWE-22"),
    Sink("pickle.loads", "CWE-502"), Sink("pickle.load", "CWE-502"), Sink("marshal.loads", "CWE-502"), Sink("yaml.load", "CWE-502", unless="SafeLoader"), Sink("render_template_string", "CWE-79"),
    Sink("Markup", "CWE-79"), Sink("requests.get", "CWE-918", 0, "url"), Sink("requests.post", "CWE-918", 0, "url"), Sink("urllib.request.urlopen", "CWE-918"), Sink("redirect", "CWE-601"),
)


class Finding(NamedTuple):
    cwe: str
    line: int
    sink: str
    source: str
    path: tuple[int, ...]


def dotted(node: ast.AST) -> str:
    """The name of a chain of attributes, empty where its root is no name (then with a leading dot: the last part)."""
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    if isinstance(node, ast.Name):
        return ".".join([node.id, *reversed(parts)])
    return f".{parts[0]}" if parts else ""


class _Taint(NamedTuple):
    """Untrusted data: where it came from, the lines it passed, the weaknesses it was made safe for."""

    source: str
    path: tuple[int, ...]
    safe: frozenset[str]


def _joined(a: _Taint | None, b: _Taint | None) -> _Taint | None:
    """Of two ways to the same value, what either may still do: the shorter way, safe for what both are safe for."""
    if a is None or b is None:
        return a or b
    first = min(a, b, key=lambda t: (len(t.path), t.path, t.source))
    return first._replace(safe=a.safe & b.safe)


State = dict[str, _Taint]


def _merge(a: State, b: State) -> State:
    return {k: t for k in sorted(a.keys() | b.keys()) if (t := _joined(a.get(k), b.get(k)))}


def value_of(expr: ast.AST | None, state: State) -> _Taint | None:
    """What untrusted data an expression's value may hold. An explicit stack: entries carry the weaknesses made safe above them."""
    found: _Taint | None = None
    stack: list[tuple[ast.AST, frozenset[str]]] = [(expr, frozenset())] if expr is not None else []
    while stack:
        node, safe = stack.pop()
        if isinstance(node, ast.Name):
            if isinstance(node.ctx, ast.Load) and node.id in state:
                t = state[node.id]
                found = _joined(found, t._replace(safe=t.safe | safe))
            continue
        if isinstance(node, (ast.Attribute, ast.Call)):
            name = dotted(node.func if isinstance(node, ast.Call) else node)
            source = next((s for s in SOURCES if name == s or name.startswith(s + ".")), None)
            if source:
                found = _joined(found, _Taint(source, (node.lineno,), safe))
                continue
            if isinstance(node, ast.Call) and name in SANITISERS:
                if SANITISERS[name] is None:
                    continue
                safe |= {SANITISERS[name]}
        if isinstance(node, (ast.Lambda, *DEFS, ast.ClassDef)):
            continue
        if isinstance(node, ast.Compare):  # its value is a truth value
            continue
        if isinstance(node, ast.IfExp):
            stack += [(node.body, safe), (node.orelse, safe)]
            continue
        stack += [(c, safe) for c in ast.iter_child_nodes(node)]
    return found


def _calls(node: ast.AST) -> Iterator[ast.Call]:
    """The calls of one statement's own expressions: no nested statement, function or class."""
    stack = [node]
    while stack:
        n = stack.pop()
        if isinstance(n, ast.Call):
            yield n
        stack += [c for c in ast.iter_child_nodes(n) if not isinstance(c, (ast.stmt, ast.Lambda, ast.excepthandler, ast.match_case))]


def _true(call: ast.Call, keyword: str) -> bool:
    return any(k.arg == keyword and isinstance(k.value, ast.Constant) and bool(k.value.value) for k in call.keywords)


class _Scope:
    """Walks one scope's statements; findings gather in `found` by weakness, line and sink, the shortest way first."""

    def __init__(self, found: dict[tuple[str, int, str], Finding]):
        self.found = found
        self.inner: list[ast.AST] = []

    def check(self, node: ast.AST, state: State) -> None:
        for call in _calls(node):
            name = dotted(call.func)
            last = "." + name.rpartition(".")[2] if "." in name else None
            for sink in SINKS:
                if sink.callee != name and sink.callee != last:
                    continue
                if sink.only_if and not _true(call, sink.only_if):
                    continue
                given = [a for i, a in enumerate(call.args) if i == sink.argument] or [k.value for k in call.keywords if sink.keyword and k.arg == sink.keyword]
                if sink.unless and any(sink.unless in ast.dump(a) for a in [*call.args[1:], *[k.value for k in call.keywords]]):
                    continue
                for arg in given:
                    t = value_of(arg, state)
                    if t and sink.cwe not in t.safe:
                        made = Finding(sink.cwe, call.lineno, sink.callee.lstrip("."), t.source, (*t.path, call.lineno) if t.path[-1:] != (call.lineno,) else t.path)
                        key = made[:3]
                        if key not in self.found or (len(made.path), made.path) < (len(self.found[key].path), self.found[key].path):
                            self.found[key] = made

    def bind(self, target: ast.AST, t: _Taint | None, line: int, state: State, add: bool = False) -> None:
        if isinstance(target, (ast.Tuple, ast.List)):
            for x in target.elts:
                self.bind(x, t, line, state, add)
            return
        if isinstance(target, ast.Starred):
            return self.bind(target.value, t, line, state, add)
        part = not isinstance(target, ast.Name)
        while isinstance(target, (ast.Attribute, ast.Subscript)):  # a part of something: what it held before stays
            target = target.value
        if not isinstance(target, ast.Name):
            return
        if t is not None and t.path[-1:] != (line,):
            t = t._replace(path=(*t.path, line))
        t = _joined(state.get(target.id), t) if part or add else t
        if t is None:
            state.pop(target.id, None)
        else:
            state[target.id] = t

    def block(self, body: list[ast.stmt], state: State) -> State:
        for s in body:
            state = self.statement(s, state)
        return state

    def loop(self, body: list[ast.stmt], state: State, head) -> State:
        """The state after any number of turns."""
        while True:
            start = dict(state)
            head(start)
            after = _merge(state, self.block(body, start))
            if after.keys() == state.keys() and all(after[k].safe == state[k].safe for k in after):
                return after
            state = after

    def statement(self, s: ast.stmt, state: State) -> State:
        if isinstance(s, (*DEFS, ast.ClassDef)):
            self.inner.append(s)
            return state
        self.check(s, state)
        state = dict(state)
        for w in (n for n in ast.walk(s) if isinstance(n, ast.NamedExpr)):
            self.bind(w.target, value_of(w.value, state), w.lineno, state)
        if isinstance(s, ast.Assign):
            for target in s.targets:
                self.bind(target, value_of(s.value, state), s.lineno, state)
        elif isinstance(s, ast.AnnAssign) and s.value is not None:
            self.bind(s.target, value_of(s.value, state), s.lineno, state)
        elif isinstance(s, ast.AugAssign):
            self.bind(s.target, value_of(s.value, state), s.lineno, state, add=True)
        elif isinstance(s, ast.Expr) and isinstance(s.value, ast.Call) and isinstance(s.value.func, ast.Attribute) and s.value.func.attr in ("append", "extend", "add", "update", "insert"):
            for arg in [*s.value.args, *[k.value for k in s.value.keywords]]:
                self.bind(s.value.func.value, value_of(arg, state), s.lineno, state, add=True)
        elif isinstance(s, ast.Delete):
            for target in s.targets:
                if isinstance(target, ast.Name):
                    state.pop(target.id, None)
        elif isinstance(s, ast.If):
            state = _merge(self.block(s.body, dict(state)), self.block(s.orelse, dict(state)))
        elif isinstance(s, (ast.For, ast.AsyncFor)):
            state = self.loop(s.body, state, lambda st: (self.check(s, st), self.bind(s.target, value_of(s.iter, st), s.lineno, st)))
            state = self.block(s.orelse, state)
        elif isinstance(s, ast.While):
            state = self.block(s.orelse, self.loop(s.body, state, lambda st: self.check(s, st)))
        elif isinstance(s, (ast.With, ast.AsyncWith)):
            for item in s.items:
                if item.optional_vars is not None:
                    self.bind(item.optional_vars, value_of(item.context_expr, state), s.lineno, state)
            state = self.block(s.body, state)
        elif isinstance(s, ast.Try) or type(s).__name__ == "TryStar":
            done = self.block(s.body, dict(state))
            ways = self.block(s.orelse, dict(done))
            for h in s.handlers:  # an exception may come before or after any statement of the body
                ways = _merge(ways, self.block(h.body, _merge(state, done)))
            state = self.block(s.finalbody, ways)
        elif isinstance(s, ast.Match):
            ways = dict(state)
            for case in s.cases:
                st = dict(state)
                for n in ast.walk(case.pattern):
                    if isinstance(n, (ast.MatchAs, ast.MatchStar)) and n.name:
                        self.bind(ast.Name(n.name, ast.Store()), value_of(s.subject, state), s.lineno, st)
                ways = _merge(ways, self.block(case.body, st))
            state = ways
        return state


def findings(code: str | None, untrusted_parameters: bool = True) -> list[Finding]:
    """All findings of one code, by line, weakness and sink."""
    tree = parsed(code or "")
    if tree is None:
        return []
    found: dict[tuple[str, int, str], Finding] = {}
    todo: list[tuple[list[ast.stmt], State]] = [(tree.body, {})]
    while todo:
        body, state = todo.pop()
        scope = _Scope(found)
        last = scope.block(body, state)
        for inner in scope.inner:
            start = dict(last)  # a function sees what its surroundings hold in the end
            if isinstance(inner, DEFS):
                for a in [*inner.args.posonlyargs, *inner.args.args, *inner.args.kwonlyargs, *filter(None, (inner.args.vararg, inner.args.kwarg))]:
                    start.pop(a.arg, None)
                    if untrusted_parameters and a.arg not in ("self", "cls"):
                        start[a.arg] = _Taint(f"parameter {a.arg}", (inner.lineno,), frozenset())
            todo.append((inner.body, start))
    return sorted(found.values(), key=lambda f: (f.line, f.cwe, f.sink))
