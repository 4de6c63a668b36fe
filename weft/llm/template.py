"""Compiler of a sandboxed template language for conversations.

    {{ expression }}   {% if e %}..{% elif e %}..{% else %}..{% endif %}   {% for x in e %}..{% endfor %}
    {% set x = e %}    {% generation %}..{% endgeneration %}               {# comment #}   and - to strip white space

Expressions have literals, names, keys (``a.b``, ``a['b']``, ``a[0]``), ``== != < <= > >= in + ~ not and or``,
parentheses and filters. There are no calls and no Python attributes, so a template reaches only what it is given.

Source is parsed to a tree of tuples; constants are folded (expressions, branches, neighbouring text); the rest becomes
Python closures. What stands inside ``generation`` is marked in the output.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

CONTROLS = ("<|", "|>", "<s>", "</s>", "[INST]", "[/INST]")
_START = re.compile(rf"(?=(?:{'|'.join(map(re.escape, CONTROLS))}|\\))(.)", re.S)
_BACK = re.compile(r"\\(\\?)")


def escape(text: str) -> str:
    """No control string is left: a backslash splits each, and backslashes are doubled."""
    return _START.sub(r"\1\\", text)


def unescape(text: str) -> str:
    return _BACK.sub(r"\1", text)


FILTERS: dict[str, Callable] = {"escape": escape, "trim": str.strip, "upper": str.upper, "lower": str.lower, "length": len, "string": str}
_TAG = re.compile(r"\{\{-?(.*?)-?\}\}|\{%-?(.*?)-?%\}|\{#.*?#\}", re.S)
_TOKEN = re.compile(r"""\s*(?:(\d+)|"((?:[^"\\]|\\.)*)"|'((?:[^'\\]|\\.)*)'|(\w+)|(==|!=|<=|>=|[<>+~|.()\[\]]))""", re.S)
_OPS: dict[str, Callable] = {
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b, "in": lambda a, b: a in b, "+": lambda a, b: a + b, "~": lambda a, b: _text(a) + _text(b),
}


class TemplateError(ValueError):
    pass


def _text(v) -> str:
    return "" if v is None else v if isinstance(v, str) else str(v)


class _Expression:
    """Recursive descent; each method returns ("const", value) or (kind, ...), folded as it is built."""

    def __init__(self, source: str):
        self.todo, at = [], 0
        while source[at:].strip():
            if not (m := _TOKEN.match(source, at)):
                raise TemplateError(f"unexpected {source[at:].strip()[:20]!r}")
            number, double, single, name, sign = m.groups()
            string = double if double is not None else single
            self.todo.append(("const", int(number)) if number else ("const", re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), string)) if string is not None else ("word", name or sign))
            at = m.end()
        self.tree = self.either()
        if self.todo:
            raise TemplateError(f"unexpected {self.todo[0][1]!r}")

    def take(self, *words: str) -> str | None:
        if self.todo and self.todo[0][0] == "word" and self.todo[0][1] in words:
            return self.todo.pop(0)[1]
        return None

    def need(self, word: str) -> None:
        if not self.take(word):
            raise TemplateError(f"expected {word!r}")

    def either(self):
        left = self.both()
        while self.take("or"):
            left = _fold("or", left, self.both())
        return left

    def both(self):
        left = self.negated()
        while self.take("and"):
            left = _fold("and", left, self.negated())
        return left

    def negated(self):
        return _fold("not", self.negated()) if self.take("not") else self.compared()

    def compared(self):
        left = self.joined()
        while op := self.take("==", "!=", "<", "<=", ">", ">=", "in"):
            left = _fold("op", left, self.joined(), op)
        return left

    def joined(self):
        left = self.filtered()
        while op := self.take("+", "~"):
            left = _fold("op", left, self.filtered(), op)
        return left

    def filtered(self):
        left = self.keyed()
        while self.take("|"):
            kind, name = self.todo.pop(0) if self.todo else ("", "")
            if kind != "word" or name not in FILTERS:
                raise TemplateError(f"unknown filter {name!r}; there are {', '.join(FILTERS)}")
            left = _fold("filter", left, name)
        return left

    def keyed(self):
        left = self.single()
        while sign := self.take(".", "["):
            if sign == ".":
                kind, key = self.todo.pop(0) if self.todo else ("", "")
                if kind != "word" or not key.isidentifier() or key.startswith("_"):
                    raise TemplateError(f"no key {key!r}")
                left = _fold("key", left, ("const", key))
            else:
                left = _fold("key", left, self.either())
                self.need("]")
        return left

    def single(self):
        if self.take("("):
            inner = self.either()
            self.need(")")
            return inner
        if not self.todo:
            raise TemplateError("an expression ends early")
        kind, value = self.todo.pop(0)
        if kind == "const":
            return kind, value
        if value in ("true", "false", "none"):
            return "const", {"true": True, "false": False, "none": None}[value]
        if not value.isidentifier() or value.startswith("_"):
            raise TemplateError(f"unexpected {value!r}")
        return "name", value


def _fold(kind: str, *parts):
    node = (kind, *parts)
    if all(p[0] == "const" for p in parts if isinstance(p, tuple)):
        return "const", _closure(node)({})
    return node


def _key(of, key):
    if isinstance(of, dict):
        return of.get(key)
    if isinstance(of, (list, str)) and isinstance(key, int):
        return of[key] if -len(of) <= key < len(of) else None
    raise TemplateError(f"no key {key!r} in a value of type {type(of).__name__}")


def _closure(node) -> Callable[[dict], object]:
    kind = node[0]
    if kind == "const":
        value = node[1]
        return lambda env: value
    if kind == "name":
        name = node[1]
        return lambda env: env.get(name)
    a = _closure(node[1])
    if kind == "not":
        return lambda env: not a(env)
    if kind == "filter":
        f = FILTERS[node[2]]
        return lambda env: f(a(env) if a(env) is not None else "")
    b = _closure(node[2])
    if kind == "key":
        return lambda env: _key(a(env), b(env))
    if kind == "and":
        return lambda env: a(env) and b(env)
    if kind == "or":
        return lambda env: a(env) or b(env)
    f = _OPS[node[3]]
    return lambda env: f(a(env), b(env))


def parse(source: str) -> list:
    """The folded tree: ("text", s), ("out", e), ("if", [(e, body)..]), ("for", name, e, body), ("set", name, e), ("generation", body)."""
    parts, at = [], 0
    for m in _TAG.finditer(source):
        before = source[at : m.start()]
        if parts and parts[-1][0] == "strip":
            parts.pop()
            before = before.lstrip()
        parts.append(("text", before.rstrip() if m[0][2] == "-" else before))
        if m[1] is not None:
            parts.append(("out", m[1]))
        elif m[2] is not None:
            parts.append(("tag", m[2].strip()))
        if m[0][-3] == "-":
            parts.append(("strip", ""))
        at = m.end()
    rest = source[at:]
    if parts and parts[-1][0] == "strip":
        parts.pop()
        rest = rest.lstrip()
    parts.append(("text", rest))
    parts = [p for p in parts if p[0] != "strip"]

    def block(*ends: str) -> tuple[list, str]:
        body: list = []
        while parts:
            kind, value = parts.pop(0)
            if kind == "text":
                body.append(("text", value))
            elif kind == "out":
                body.append(("out", _Expression(value).tree))
            else:
                word, _, more = value.partition(" ")
                if word in ends:
                    return _tidy(body), value
                if word == "if":
                    arms, test = [], more
                    while True:
                        inner, end = block("elif", "else", "endif")
                        arms.append((_Expression(test).tree, inner))
                        if end == "endif":
                            break
                        test = end.partition(" ")[2] if end.startswith("elif") else "true"
                    body.append(("if", arms))
                elif word == "for" and (m := re.fullmatch(r"([a-z]\w*)\s+in\s+(.+)", more.strip(), re.S | re.I)):
                    body.append(("for", m[1], _Expression(m[2]).tree, block("endfor")[0]))
                elif word == "set" and (m := re.fullmatch(r"([a-z]\w*)\s*=\s*(.+)", more.strip(), re.S | re.I)):
                    body.append(("set", m[1], _Expression(m[2]).tree))
                elif word == "generation":
                    body.append(("generation", block("endgeneration")[0]))
                else:
                    raise TemplateError(f"unexpected {{% {value} %}}")
        if ends:
            raise TemplateError(f"missing {{% {ends[-1]} %}}")
        return _tidy(body), ""

    return block()[0]


def _tidy(body: list) -> list:
    out: list = []
    for node in body:
        if node[0] == "out" and node[1][0] == "const":
            node = ("text", _text(node[1][1]))
        if node[0] == "if":
            arms = [a for a in node[1] if a[0][0] != "const" or a[0][1]]
            for k, (test, _) in enumerate(arms):
                if test[0] == "const":
                    arms = arms[: k + 1]
                    break
            if not arms or arms[0][0][0] == "const":
                for inner in arms[0][1] if arms else []:
                    _append(out, inner)
                continue
            node = ("if", arms)
        _append(out, node)
    return out


def _append(out: list, node) -> None:
    if node[0] == "text" and out and out[-1][0] == "text":
        out[-1] = ("text", out[-1][1] + node[1])
    elif node != ("text", ""):
        out.append(node)


def _body(nodes: list) -> Callable[[dict, list], None]:
    """Closure that appends (text, marked) to a list; env["generation"] holds the mark."""
    steps = [_step(n) for n in nodes]

    def run(env: dict, out: list) -> None:
        for s in steps:
            s(env, out)

    return steps[0] if len(steps) == 1 else run


def _step(node) -> Callable[[dict, list], None]:
    kind = node[0]
    if kind == "text":
        text = node[1]
        return lambda env, out: out.append((text, env.get(_MARK, False)))
    if kind == "out":
        value = _closure(node[1])
        return lambda env, out: out.append((_text(value(env)), env.get(_MARK, False)))
    if kind == "set":
        name, value = node[1], _closure(node[2])
        return lambda env, out: env.__setitem__(name, value(env))
    if kind == "generation":
        inner = _body(node[1])

        def mark(env: dict, out: list) -> None:
            was, env[_MARK] = env.get(_MARK, False), True
            inner(env, out)
            env[_MARK] = was

        return mark
    if kind == "if":
        arms = [(_closure(t), _body(b)) for t, b in node[1]]

        def choose(env: dict, out: list) -> None:
            for test, body in arms:
                if test(env):
                    return body(env, out)

        return choose
    name, value, inner = node[1], _closure(node[2]), _body(node[3])

    def loop(env: dict, out: list) -> None:
        items = value(env) or []
        if not isinstance(items, list):
            raise TemplateError("a loop needs a list")
        each(env, out, name, items, inner)

    return loop


_MARK = "%mark"


def each(env: dict, out: list, name: str, items: Iterable, inner: Callable) -> None:
    was = env.get(name), env.get("loop")
    for k, (item, last) in enumerate(_last(items)):
        env[name], env["loop"] = item, {"index": k + 1, "index0": k, "first": k == 0, "last": last}
        inner(env, out)
    env[name], env["loop"] = was


def _last(items: Iterable) -> Iterator[tuple]:
    it = iter(items)
    for held in it:
        for item in it:
            yield held, False
            held = item
        yield held, True


def _names(node) -> Iterator[str]:
    if isinstance(node, tuple) and node[:1] == ("name",):
        yield node[1]
    elif isinstance(node, (tuple, list)):
        for x in node:
            yield from _names(x)


class Template:
    """``render`` gives (text, marks) of a conversation; ``stream`` gives (text, marked) pieces and, where ``messages`` is
    used by one outer loop only, holds two messages at a time, whatever the length of the conversation."""

    def __init__(self, source: str):
        self.tree = parse(source)
        loops = [k for k, n in enumerate(self.tree) if n[0] == "for" and n[2] == ("name", "messages")]
        self.streams = len(loops) == 1 and list(_names(self.tree)).count("messages") == 1
        k = loops[0] if self.streams else 0
        self.before, self.after = _body(self.tree[:k]), _body(self.tree[k + 1 :] if self.streams else self.tree)
        self.name, self.inner = (self.tree[k][1], _body(self.tree[k][3])) if self.streams else ("", None)

    def stream(self, messages: Iterable[dict], **env) -> Iterator[list[tuple[str, bool]]]:
        """The pieces before the loop, of each message, and after it."""
        out: list = []
        if not self.streams:
            env["messages"] = list(messages)
        else:
            self.before(env, out)
            for k, (item, last) in enumerate(_last(messages)):
                yield out
                out = []
                env[self.name], env["loop"] = item, {"index": k + 1, "index0": k, "first": k == 0, "last": last}
                self.inner(env, out)
        yield out
        self.after(env, out := [])
        yield out

    def render(self, messages: Iterable[dict], **env) -> tuple[str, list[tuple[int, int]]]:
        return joined(p for pieces in self.stream(messages, **env) for p in pieces)


def joined(pieces: Iterable[tuple[str, bool]]) -> tuple[str, list[tuple[int, int]]]:
    texts, marks, at = [], [], 0
    for text, marked in pieces:
        if marked and text:
            if marks and marks[-1][1] == at:
                marks[-1] = (marks[-1][0], at + len(text))
            else:
                marks.append((at, at + len(text)))
        texts.append(text)
        at += len(text)
    return "".join(texts), marks
