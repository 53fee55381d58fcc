"""A small template language for conversations, compiled to Python closures.

    {{ expression }}   {% if a %} {% elif b %} {% else %} {% endif %}   {% for m in messages %} {% endfor %}
    {% set x = expression %}   {% set ns.x = expression %}   {% generation %} {% endgeneration %}   {# comment #}

A - at the inner side of a tag takes the white space next to it away.
Expressions: strings, whole numbers, true, false, none, lists; names; m.key, m['key'], m[0], m[1:], which look up
keys and places of dictionaries, lists and strings; + - ~ * / // % == != < <= > >= in, not in, is defined and other
tests, and, or, not; a if c else b; parentheses; filters after |; the methods of strings in METHODS;
namespace(x=1), raise_exception('what'). There are no other calls, no attributes of Python objects and no loops but
over the lists given, so a template can only read what it is handed. A template is parsed into a tree, constant
parts are folded, and each node becomes a closure. Rendering is lazy: pieces come out as messages go in, so a
conversation of any length is formatted in the memory of one message, if the template only loops over
its messages; streams() tells.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Iterator
from enum import Enum


class Mark(Enum):
    """Pieces that open and close a generated part; all others are strings."""

    BEGIN = 1
    END = 2


BEGIN, END = Mark.BEGIN, Mark.END


class TemplateError(ValueError):
    pass


def escaper(controls: Iterable[str], mark: str = "\\") -> Callable[[str], str]:
    """Makes control strings in a text harmless: the mark goes behind their first character, and before itself."""
    heads = [re.escape(c[0]) + f"(?={re.escape(c[1:])})" for c in sorted(controls, key=len, reverse=True)]
    found = re.compile("|".join([re.escape(mark), *heads]))
    return lambda text: found.sub(lambda m: mark + mark if m[0] == mark else m[0] + mark, text)


def unescaper(mark: str = "\\") -> Callable[[str], str]:
    """Takes back escaper()."""
    found = re.compile(re.escape(mark) + "(.?)", re.DOTALL)
    # A mark stands before itself or alone.
    return lambda text: found.sub(lambda m: mark if m[1] == mark else m[1], text)


FILTERS: dict[str, Callable] = {
    "trim": lambda x: str(x).strip(),
    "upper": lambda x: str(x).upper(),
    "lower": lambda x: str(x).lower(),
    "length": len,
    "string": str,
    "default": lambda x, y: y if x is None else x,
    "replace": lambda x, a, b: str(x).replace(a, b),
}

FILTERS["tojson"] = lambda x: json.dumps(x, ensure_ascii=False)
FILTERS["first"] = lambda x: x[0] if x else None
FILTERS["last"] = lambda x: x[-1] if x else None
FILTERS["join"] = lambda x, by="": str(by).join(map(_shown, x))

#: What can be called on strings, and get and items on dictionaries.
METHODS: dict[str, Callable] = {
    **{name: getattr(str, name) for name in ("strip", "lstrip", "rstrip", "split", "startswith", "endswith", "upper", "lower", "title", "capitalize", "replace")},
    "get": lambda x, key, other=None: dict.get(x, key, other),
    "items": lambda x: [list(pair) for pair in dict.items(x)],
}

#: Tests after is.
TESTS: dict[str, Callable[[object], bool]] = {
    "none": lambda x: x is None,
    "string": lambda x: isinstance(x, str),
    "mapping": lambda x: isinstance(x, dict),
    "iterable": lambda x: isinstance(x, (str, list, tuple, dict)),
    "sequence": lambda x: isinstance(x, (str, list, tuple)),
    "number": lambda x: isinstance(x, (int, float)) and not isinstance(x, bool),
    "boolean": lambda x: isinstance(x, bool),
    "true": lambda x: x is True,
    "false": lambda x: x is False,
    "odd": lambda x: x % 2 == 1,
    "even": lambda x: x % 2 == 0,
}

_LEXEMES = re.compile(r"""\s*(?:("(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(\d+)|([A-Za-z_]\w*)|(==|!=|<=|>=|//|[-+~*/%<>|.,:()\[\]=]))""", re.DOTALL)
_OPENER = re.compile(r"\{([{%#])(-?)")
_CLOSER = {"{": re.compile(r"\s*(-?)\}\}"), "%": re.compile(r"\s*(-?)%\}"), "#": re.compile(r"(-?)#\}")}
_BACK = {"n": "\n", "t": "\t", "r": "\r"}


class _Lexer:
    """The items of one tag."""

    def __init__(self, items: list[tuple[str, object]]) -> None:
        self.items, self.at = items, 0

    def peek(self, ahead: int = 0) -> tuple[str, object]:
        return self.items[self.at + ahead] if self.at + ahead < len(self.items) else ("end", None)

    def take(self, *wanted: object) -> object | None:
        """The next item's value, if it is a sign or name among those wanted."""
        kind, value = self.peek()
        if kind in ("sign", "name") and value in wanted:
            self.at += 1
            return value
        return None

    def need(self, wanted: str) -> None:
        if self.take(wanted) is None:
            raise TemplateError(f"{wanted} expected, found {self.peek()[1]!r}")

    def name(self) -> str:
        kind, value = self.peek()
        if kind != "name":
            raise TemplateError(f"a name expected, found {value!r}")
        self.at += 1
        return str(value)

    def end(self) -> None:
        if self.peek()[0] != "end":
            raise TemplateError(f"more than was expected: {self.peek()[1]!r}")


def _tags(source: str, trimmed: bool) -> list[tuple[str, object]]:
    """Texts, and the tags' lexers by "{" or "%". A tag ends where its closing sign stands outside of strings."""
    out: list[tuple[str, object]] = []
    at, strip = 0, False
    while m := _OPENER.search(source, at):
        text, sign = source[at : m.start()], m[1]
        text = text.lstrip() if strip else text
        if m[2]:
            text = text.rstrip()
        elif trimmed and sign != "{":
            text = re.sub(r"(^|\n)[ \t]+$" if source[max(0, at - 1) : at] in ("", "\n") else r"(\n)[ \t]+$", r"\1", text)
        out.append(("text", text))
        at, items, closer = m.end(), [], _CLOSER[sign]
        if sign == "#":
            end = closer.search(source, at)
            if not end:
                raise TemplateError("a comment without end")
        else:
            while not (end := closer.match(source, at)):
                x = _LEXEMES.match(source, at)
                if not x:
                    raise TemplateError(f"not understood: {source[at:at + 20]!r}")
                at = x.end()
                if x[1] is not None:
                    items.append(("text", re.sub(r"\\(.)", lambda y: _BACK.get(y[1], y[1]), x[1][1:-1], flags=re.DOTALL)))
                elif x[2] is not None:
                    items.append(("number", int(x[2])))
                else:
                    items.append(("name", x[3]) if x[3] is not None else ("sign", x[4]))
            out.append((sign, _Lexer(items)))
        at, strip = end.end(), bool(end[1])
        if trimmed and sign != "{" and source.startswith("\n", at):
            at += 1
    out.append(("text", source[at:].lstrip() if strip else source[at:]))
    return [x for x in out if x != ("text", "")]


# Nodes of expressions: ("const", value) ("name", n) ("get", e, key) ("slice", e, from, to, step) ("op", sign, a, b) ("not", e)
# ("if", test, a, b) ("filter", name, e, args) ("call", method, e, args...) ("test", name, e) ("defined", e) ("list", items...)
# ("namespace", "names", values...) ("raise", e).
_OPERATORS: dict[str, Callable] = {
    "+": lambda a, b: a + b,
    "-": lambda a, b: a - b,
    "~": lambda a, b: _shown(a) + _shown(b),
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
    "in": lambda a, b: a in b,
    "*": lambda a, b: a * b,
    "/": lambda a, b: a / b,
    "//": lambda a, b: a // b,
    "%": lambda a, b: a % b,
}


def _shown(value: object) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value).lower() if isinstance(value, bool) else str(value)


def _expression(lex: _Lexer) -> tuple:
    out = _either(lex)
    if lex.take("if"):
        test = _either(lex)
        other = _expression(lex) if lex.take("else") else ("const", None)
        return ("if", test, out, other)
    return out


def _either(lex: _Lexer) -> tuple:
    out = _both(lex)
    while lex.take("or"):
        out = ("or", out, _both(lex))
    return out


def _both(lex: _Lexer) -> tuple:
    out = _negated(lex)
    while lex.take("and"):
        out = ("and", out, _negated(lex))
    return out


def _negated(lex: _Lexer) -> tuple:
    return ("not", _negated(lex)) if lex.take("not") else _compared(lex)


def _compared(lex: _Lexer) -> tuple:
    out = _summed(lex)
    while True:
        if sign := lex.take("==", "!=", "<", "<=", ">", ">=", "in"):
            out = ("op", sign, out, _summed(lex))
        elif lex.peek() == ("name", "not") and lex.peek(1) == ("name", "in"):
            lex.at += 2
            out = ("not", ("op", "in", out, _summed(lex)))
        elif lex.take("is"):
            negated, name = lex.take("not"), lex.name()
            if name in ("defined", "undefined"):
                out = ("defined", out) if name == "defined" else ("not", ("defined", out))
            elif name in TESTS:
                out = ("test", name, out)
            else:
                raise TemplateError(f"unknown test {name!r}")
            out = ("not", out) if negated else out
        else:
            return out


def _summed(lex: _Lexer) -> tuple:
    out = _product(lex)
    while sign := lex.take("+", "-", "~"):
        out = ("op", sign, out, _product(lex))
    return out


def _product(lex: _Lexer) -> tuple:
    out = _filtered(lex)
    while sign := lex.take("*", "/", "//", "%"):
        out = ("op", sign, out, _filtered(lex))
    return out


def _listed(lex: _Lexer, closer: str) -> list[tuple]:
    """Expressions up to the closing sign, commas between them."""
    out: list[tuple] = []
    while not lex.take(closer):
        if out:
            lex.need(",")
        out.append(_expression(lex))
    return out


def _filtered(lex: _Lexer) -> tuple:
    out = _value(lex)
    while lex.take("|"):
        name = lex.name()
        args = _listed(lex, ")") if lex.take("(") else []
        out = ("filter", name, out, tuple(args))
    return out


def _value(lex: _Lexer) -> tuple:
    kind, value = lex.peek()
    if lex.take("("):
        out = _expression(lex)
        lex.need(")")
    elif lex.take("["):
        out = ("list", *_listed(lex, "]"))
    elif lex.take("-"):
        return ("op", "-", ("const", 0), _value(lex))
    elif kind in ("text", "number"):
        lex.at += 1
        out = ("const", value)
    elif kind == "name":
        constants = {"true": True, "false": False, "none": None, "True": True, "False": False, "None": None}
        name = lex.name()
        if name == "namespace" and lex.take("("):
            names, values = [], []
            while not lex.take(")"):
                if names:
                    lex.need(",")
                names.append(lex.name())
                lex.need("=")
                values.append(_expression(lex))
            out = ("namespace", ",".join(names), *values)
        elif name == "raise_exception" and lex.take("("):
            out = ("raise", _expression(lex))
            lex.need(")")
        else:
            out = ("const", constants[name]) if name in constants else ("name", name)
    else:
        raise TemplateError(f"a value expected, found {value!r}")
    while True:
        if lex.take("."):
            name = lex.name()
            if lex.take("("):
                if name not in METHODS:
                    raise TemplateError(f"unknown method {name!r}")
                out = ("call", name, out, *_listed(lex, ")"))
            else:
                out = ("get", out, ("const", name))
        elif lex.take("["):
            out = _place(lex, out)
        else:
            return out


def _place(lex: _Lexer, of: tuple) -> tuple:
    """What stands in brackets: a key, a place or a slice."""
    ends: list[tuple] = [("const", None)] * 3
    k = 0
    while not lex.take("]"):
        if lex.take(":"):
            k += 1
            if k > 2:
                raise TemplateError("a slice has two colons at most")
        else:
            ends[k] = _expression(lex)
            if lex.peek() not in (("sign", ":"), ("sign", "]")):
                raise TemplateError(f"] expected, found {lex.peek()[1]!r}")
    if not k and ends[0] == ("const", None):
        raise TemplateError("nothing in brackets")
    return ("slice", of, *ends) if k else ("get", of, ends[0])


# Nodes of the body: ("text", s) ("out", e) ("branch", ((test, body), ...), else) ("for", name, e, body) ("set", name, e) ("put", name, key, e) ("generation", body).
_CLOSERS = {"elif", "else", "endif", "endfor", "endgeneration"}


def parse(source: str, trimmed: bool = False) -> tuple:
    """The tree of a template: a tuple of body nodes. trimmed: a line feed behind {% %} and blanks before it on its line go."""
    tags = _tags(source, trimmed)
    body, at, closer = _body(tags, 0)
    if closer:
        raise TemplateError(f"{closer[0]} without its beginning")
    return body


def streams(source: str, name: str, trimmed: bool = False) -> bool:
    """Whether a template uses a name for nothing but loops over it that aren't within another loop, and once at most."""
    uses: list[bool] = []

    def look(node: object, inside: bool, loops: bool) -> None:
        if node == ("name", name):
            uses.append(inside and not loops)
        elif isinstance(node, tuple):
            if node[:1] == ("for",):
                look(node[2], True, loops)
                look(node[3], False, True)
            else:
                for x in node:
                    look(x, False, loops)

    look(parse(source, trimmed), False, False)
    return len(uses) <= 1 and all(uses)


def _body(parts: list[tuple[str, object]], at: int) -> tuple[tuple, int, tuple[str, _Lexer] | None]:
    out: list[tuple] = []
    while at < len(parts):
        kind, lex = parts[at]
        at += 1
        if kind == "{":
            out.append(("out", _expression(lex)))
            lex.end()
        elif kind == "%":
            word = lex.name()
            if word in _CLOSERS:
                if word != "elif":
                    lex.end()
                return tuple(out), at, (word, lex)
            if word == "set":
                name = lex.name()
                key = lex.name() if lex.take(".") else None
                lex.need("=")
                value = _expression(lex)
                out.append(("set", name, value) if key is None else ("put", name, key, value))
                lex.end()
            elif word == "for":
                name = lex.name()
                lex.need("in")
                over = _expression(lex)
                lex.end()
                body, at = _until(parts, at, "endfor")
                out.append(("for", name, over, body))
            elif word == "generation":
                lex.end()
                body, at = _until(parts, at, "endgeneration")
                out.append(("generation", body))
            elif word == "if":
                branches, last, test = [], (), _expression(lex)
                lex.end()
                while True:
                    body, at, closer = _body(parts, at)
                    branches.append((test, body))
                    if closer is None or closer[0] not in ("elif", "else", "endif"):
                        raise TemplateError("endif is missing")
                    if closer[0] == "elif":
                        test = _expression(closer[1])
                        closer[1].end()
                        continue
                    if closer[0] == "else":
                        last, at = _until(parts, at, "endif")
                    break
                out.append(("branch", tuple(branches), last))
            else:
                raise TemplateError(f"unknown statement {word!r}")
        else:
            out.append(("text", lex))
    return tuple(out), at, None


def _until(parts: list[tuple[str, object]], at: int, word: str) -> tuple[tuple, int]:
    body, at, closer = _body(parts, at)
    if closer is None or closer[0] != word:
        raise TemplateError(f"{word} is missing")
    return body, at


def fold(node: tuple, filters: dict[str, Callable]) -> tuple:
    """An expression with everything computed that needs no variables."""
    kind = node[0]
    if kind in ("const", "name"):
        return node
    if kind == "filter":
        if node[1] not in filters:
            raise TemplateError(f"unknown filter {node[1]!r}")
        inner, args = fold(node[2], filters), tuple(fold(a, filters) for a in node[3])
        if all(x[0] == "const" for x in (inner, *args)):
            return ("const", filters[node[1]](inner[1], *(a[1] for a in args)))
        return ("filter", node[1], inner, args)
    parts = tuple(fold(x, filters) if isinstance(x, tuple) else x for x in node[1:])
    values = [p for p in parts if isinstance(p, tuple)]
    if kind == "if" and parts[0][0] == "const":
        return parts[1] if parts[0][1] else parts[2]
    if kind in ("and", "or") and parts[0][0] == "const":
        return parts[1] if bool(parts[0][1]) == (kind == "and") else parts[0]
    if kind not in ("namespace", "raise", "list") and all(v[0] == "const" for v in values):
        return ("const", _value_of((kind, *parts), filters)({}))
    return (kind, *parts)


def fold_body(body: tuple, filters: dict[str, Callable]) -> tuple:
    """A body with constant expressions, settled branches and neighbouring texts made one."""
    out: list[tuple] = []
    for node in body:
        kind = node[0]
        if kind == "out":
            e = fold(node[1], filters)
            new = [("text", _shown(e[1]))] if e[0] == "const" else [("out", e)]
        elif kind == "set":
            new = [("set", node[1], fold(node[2], filters))]
        elif kind == "put":
            new = [("put", node[1], node[2], fold(node[3], filters))]
        elif kind == "for":
            new = [("for", node[1], fold(node[2], filters), fold_body(node[3], filters))]
        elif kind == "generation":
            new = [("generation", fold_body(node[1], filters))]
        elif kind == "branch":
            kept, last = [], fold_body(node[2], filters)
            for test, inner in node[1]:
                test = fold(test, filters)
                if test[0] != "const":
                    kept.append((test, fold_body(inner, filters)))
                elif test[1]:
                    last = fold_body(inner, filters)
                    break
            new = [("branch", tuple(kept), last)] if kept else list(last)
        else:
            new = [node]
        for n in new:
            if n[0] == "text" and out and out[-1][0] == "text":
                out[-1] = ("text", out[-1][1] + n[1])
            elif n != ("text", ""):
                out.append(n)
    return tuple(out)


def _value_of(node: tuple, filters: dict[str, Callable]) -> Callable[[dict], object]:
    """The closure of an expression: from variables to its value."""
    kind = node[0]
    if kind == "const":
        value = node[1]
        return lambda env: value
    if kind == "name":
        name = node[1]
        return lambda env: env.get(name)
    if kind == "filter":
        apply, inner, args = filters[node[1]], _value_of(node[2], filters), [_value_of(a, filters) for a in node[3]]
        return lambda env: apply(inner(env), *(a(env) for a in args))
    if kind == "defined":
        return _defined(node[1], filters)
    parts = [_value_of(x, filters) for x in node[1:] if isinstance(x, tuple)]
    if kind == "get":
        a, b = parts
        return lambda env: _found(a(env), b(env))[1]
    if kind == "slice":
        a, *ends = parts

        def cut(env: dict) -> object:
            of = a(env)
            if not isinstance(of, (str, list, tuple)):
                raise TemplateError("a slice of what is no list or text")
            return of[slice(*(e(env) for e in ends))]

        return cut
    if kind == "call":
        name, apply = node[1], METHODS[node[1]]

        def call(env: dict) -> object:
            of, *args = (p(env) for p in parts)
            if not isinstance(of, dict if name in ("get", "items") else str):
                raise TemplateError(f"{name}: not a text or dictionary")
            return apply(of, *args)

        return call
    if kind == "test":
        test = TESTS[node[1]]
        return lambda env: test(parts[0](env))
    if kind == "list":
        return lambda env: [p(env) for p in parts]
    if kind == "namespace":
        names = node[1].split(",") if node[1] else []
        return lambda env: dict(zip(names, (p(env) for p in parts), strict=True))
    if kind == "raise":

        def fail(env: dict) -> object:
            raise TemplateError(_shown(parts[0](env)))

        return fail
    if kind == "not":
        (a,) = parts
        return lambda env: not a(env)
    if kind == "and":
        a, b = parts
        return lambda env: a(env) and b(env)
    if kind == "or":
        a, b = parts
        return lambda env: a(env) or b(env)
    if kind == "if":
        t, a, b = parts
        return lambda env: a(env) if t(env) else b(env)
    operate = _OPERATORS[node[1]]
    a, b = parts
    return lambda env: operate(a(env), b(env))


def _found(of: object, key: object) -> tuple[bool, object]:
    """Whether of has key, and what it has there."""
    if isinstance(of, dict):
        return key in of, of.get(key)
    if isinstance(of, (str, list, tuple)) and isinstance(key, int) and -len(of) <= key < len(of):
        return True, of[key]
    return False, None


def _defined(node: tuple, filters: dict[str, Callable]) -> Callable[[dict], bool]:
    if node[0] == "name":
        return lambda env: node[1] in env
    if node[0] == "get":
        a, b = (_value_of(x, filters) for x in node[1:])
        return lambda env: _found(a(env), b(env))[0]
    return lambda env: True


def _pieces_of(body: tuple, filters: dict[str, Callable]) -> Callable[[dict], Iterator]:
    """The closure of a body: from variables to its pieces, one by one."""
    steps = [_step(node, filters) for node in body]

    def run(env: dict) -> Iterator:
        for step in steps:
            yield from step(env)

    return run if len(steps) != 1 else steps[0]


def _step(node: tuple, filters: dict[str, Callable]) -> Callable[[dict], Iterable]:
    kind = node[0]
    if kind == "text":
        piece = (node[1],)
        return lambda env: piece
    if kind == "out":
        value = _value_of(node[1], filters)
        return lambda env: (_shown(value(env)),)
    if kind == "set":
        name, value = node[1], _value_of(node[2], filters)

        def assign(env: dict) -> tuple:
            env[name] = value(env)
            return ()

        return assign
    if kind == "put":
        name, key, value = node[1], node[2], _value_of(node[3], filters)

        def put(env: dict) -> tuple:
            if not isinstance(env.get(name), dict):
                raise TemplateError(f"{name}: no namespace")
            env[name][key] = value(env)
            return ()

        return put
    if kind == "generation":
        inner = _pieces_of(node[1], filters)

        def generated(env: dict) -> Iterator:
            yield BEGIN
            yield from inner(env)
            yield END

        return generated
    if kind == "branch":
        branches = [(_value_of(t, filters), _pieces_of(b, filters)) for t, b in node[1]]
        last = _pieces_of(node[2], filters)

        def choose(env: dict) -> Iterable:
            for test, inner in branches:
                if test(env):
                    return inner(env)
            return last(env)

        return choose
    name, over, inner = node[1], _value_of(node[2], filters), _pieces_of(node[3], filters)
    nothing = object()

    def repeat(env: dict) -> Iterator:
        items = over(env)
        if items is None or isinstance(items, (str, int, dict)):
            raise TemplateError(f"{name}: not a list to loop over")
        items, k = iter(items), 0
        item = next(items, nothing)
        while item is not nothing:
            after = next(items, nothing)
            own = {**env, name: item, "loop": {"index": k + 1, "index0": k, "first": k == 0, "last": after is nothing}}
            yield from inner(own)
            item, k = after, k + 1

    return repeat


def compile_template(source: str, filters: dict[str, Callable] | None = None, trimmed: bool = False) -> Callable[[dict], Iterator]:
    """A function from variables to the pieces of the rendered text: strings, and BEGIN and END around generated parts.

    Anything that goes wrong within the template, or that it raises itself, is a TemplateError.
    """
    filters = FILTERS | (filters or {})
    try:
        pieces = _pieces_of(fold_body(parse(source, trimmed), filters), filters)
    except (TypeError, AttributeError, ZeroDivisionError) as wrong:
        raise TemplateError(str(wrong)) from wrong
    return lambda variables: iter(pieces(dict(variables)))
