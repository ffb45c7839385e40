"""Endpoints in sources: a scanner of tokens, then of calls, then of what the tables below name.

Only code is looked at: comments are dropped, and a string is one token, so nothing inside either is ever a call. A call is a
chain of names with arguments; the tables say which receivers and methods make a server, client, consumer, producer, reader
or writer. Handlers of servers and consumers are their owners; other calls belong to the function around them, where the
language's declarations are known (Python).
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cache

SCRIPTS = {"typescript", "tsx", "javascript", "jsx", "mjs", "cjs"}

# Receivers and methods, in lower case, and what they make.
HTTP_METHODS = {"get", "post", "put", "patch", "delete", "options", "head"}
SCRIPT_SERVERS = {"app", "router", "server", "fastify"}
SCRIPT_CLIENTS = {"axios", "ky"}
PYTHON_SERVERS = {"app", "router", "blueprint"}
PYTHON_CLIENTS = {"requests", "httpx"}
GO_CLIENTS = {"Get", "Post", "Head"}
GO_REQUESTS = {"NewRequest", "NewRequestWithContext"}
SQL_RECEIVERS = {"db", "client", "pool", "connection", "cursor", "session"}
SQL_METHODS = {"query", "execute", "exec", "run", "all", "get"}
SQL_FUNCTIONS = {"sqlx::query", "sqlx::query_as", "diesel::sql_query"}
#: protocol, role, operation, receivers, methods, whether a handler must follow
NAMED_CALLS = [
    ("rpc", "server", "handle", {"rpc", "rpcserver", "rpc_server"}, {"register", "handle", "method", "registermethod"}, True),
    ("rpc", "client", "call", {"rpc", "rpcclient", "rpc_client"}, {"call", "request", "invoke"}, False),
    ("queue", "consumer", "consume", {"queue", "broker", "consumer"}, {"subscribe", "consume", "handle", "on"}, True),
    ("queue", "producer", "publish", {"queue", "broker", "producer"}, {"publish", "send", "emit", "produce"}, False),
]
NAMED_DECORATORS = [
    ("rpc", "server", "handle", {"rpc", "rpc_server"}, {"method", "handler"}),
    ("queue", "consumer", "consume", {"queue", "broker"}, {"consumer", "subscribe", "handler"}),
]


@dataclass(frozen=True)
class Token:
    kind: str  # name, text, sign, line
    text: str
    at: int
    value: str | None = None  # of a text that stands for itself: no prefix, no escapes, not empty


@dataclass(frozen=True)
class Call:
    chain: tuple[str, ...]
    glue: str  # what joins the last two names
    first: int  # place of the chain's first token
    args: tuple[tuple[Token, ...], ...]
    after: int  # place of the token after the closing bracket
    closed: bool


@cache
def _scanner(language: str) -> re.Pattern:
    name, line, sign = r"(?P<name>[^\W\d][\w$]*|\$[\w$]*)", r"(?P<line>\n)", r"(?P<sign>.)"
    if language == "python":
        skip = r"(?P<skip>\#[^\n]*|[^\S\n]+|\\\r?\n)"
        quotes = "|".join(rf"{q}(?:\\.|(?!{q})[^\\])*{q}" for q in ('"""', "'''")) + r"""|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'"""
        text = rf"(?P<text>(?:[bBrRuUfF]{{1,2}}(?=['\"]))?(?:{quotes}))"
    else:
        skip = r"(?P<skip>//[^\n]*|/\*.*?(?:\*/|\Z)|[^\S\n]+)"
        single = r"'(?:\\[^\n]+?|[^'\\\n])'" if language == "rust" else r"'(?:\\.|[^'\\\n])*'"
        text = rf"""(?P<text>"(?:\\.|[^"\\])*"|{single}|`(?:\\.|[^`\\])*`)"""
    return re.compile("|".join((skip, text, name, line, sign)), re.S)


def tokens(source: str, language: str) -> list[Token]:
    out = []
    for m in _scanner(language).finditer(source):
        kind, text = m.lastgroup, m[0]
        if kind == "skip":
            continue
        value = None
        if kind == "text" and text[0] in "\"'`" and text[:3] not in ('"""', "'''"):
            inner = text[1:-1]
            if inner and "\\" not in inner and (text[0] == "`" or not re.search(r"[\r\n]", inner)):
                value = inner
        out.append(Token(kind, text, m.start(), value))
    return out


def calls(listed: list[Token]) -> list[Call]:
    """Every chain of names followed by arguments."""
    code = [i for i, t in enumerate(listed) if t.kind != "line"]
    sign = lambda k: listed[code[k]].text if 0 <= k < len(code) and listed[code[k]].kind == "sign" else ""
    out = []
    for k, i in enumerate(code):
        if listed[i].kind != "name" or sign(k + 1) != "(":
            continue
        names, glue, at = [listed[i].text], "", k
        while True:
            joint = "." if sign(at - 1) == "." else "::" if sign(at - 1) == ":" and sign(at - 2) == ":" else ""
            before = at - 1 - len(joint)
            if not joint or before < 0 or listed[code[before]].kind != "name":
                glue = glue or joint
                break
            glue = glue or joint
            names.insert(0, listed[code[before]].text)
            at = before
        args: list[list[Token]] = [[]]
        depth, end = 1, k + 2
        while end < len(code) and depth:
            t = listed[code[end]]
            mark = t.text if t.kind == "sign" else ""
            depth += (mark in "([{") - (mark in ")]}") if mark else 0
            if depth == 1 and mark == ",":
                args.append([])
            elif depth:
                args[-1].append(t)
            end += 1
        out.append(Call(tuple(names), glue, at, tuple(tuple(a) for a in args), end, not depth))
    return out


def _value(args: tuple[tuple[Token, ...], ...], n: int) -> str | None:
    """The n-th argument, if it begins with a plain text."""
    return args[n][0].value if len(args) > n and args[n] and args[n][0].kind == "text" else None


def _name(args: tuple[tuple[Token, ...], ...], n: int) -> str | None:
    return args[n][0].text if len(args) > n and args[n] and args[n][0].kind == "name" else None


def _option(args: tuple[tuple[Token, ...], ...], key: str) -> list[Token]:
    """What follows ``key:`` or ``key=`` in the arguments."""
    flat = [t for a in args for t in (*a, Token("sign", ",", 0))]
    for i in range(len(flat) - 2):
        if flat[i].kind == "name" and flat[i].text.lower() == key and flat[i + 1].text in (":", "="):
            return flat[i + 2 :]
    return []


def statement(text: str) -> tuple[str, str, str] | None:
    """(role, operation, table) of a single SQL statement on one table."""
    parts = [p.strip() for p in text.split(";") if p.strip()]
    words = parts[0].lower().split() if len(parts) == 1 else []
    heads = {"insert": ("into", 2), "delete": ("from", 2), "update": ("", 1)}
    if not words:
        return None
    if words[0] == "select":
        if "from" not in words[:-1]:
            return None
        role, table = ("reader", "read"), words[words.index("from") + 1]
    elif words[0] in heads:
        between, at = heads[words[0]]
        if len(words) <= at or between and words[1] != between:
            return None
        role, table = ("writer", words[0]), words[at]
    else:
        return None
    found = re.match(r"[a-z_][\w$]*(?:\.[a-z_][\w$]*)?", table, re.A)
    return (*role, found[0]) if found else None


def _declared(code: list[Token], k: int, words: tuple[str, ...], keyword: str) -> str | None:
    """The name that a declaration at token k declares, after any of ``words``."""
    while k < len(code) and (code[k].kind == "line" or code[k].text in words):
        k += 1
    return code[k + 1].text if k + 1 < len(code) and code[k].text == keyword and code[k + 1].kind == "name" else None


def _http(call: Call, language: str, handler: str | None, decorator: bool) -> list[tuple]:
    receiver = call.chain[-2] if len(call.chain) > 1 else ""
    method, resource = call.chain[-1], _value(call.args, 0)
    low, on = method.lower(), receiver.lower() if call.glue == "." else ""
    if language in SCRIPTS:
        if on in SCRIPT_SERVERS and low in HTTP_METHODS and resource and (owner := _name(call.args, 1)):
            return [("server", low, resource, owner)]
        if on in SCRIPT_CLIENTS and low in HTTP_METHODS and resource:
            return [("client", low, resource, None)]
        if low == "fetch" and resource:
            option = _option(call.args[1:], "method")
            asked = option[0].value.lower() if option and option[0].value else "get"
            return [("client", asked if asked in HTTP_METHODS else "get", resource, None)]
    elif language == "python":
        if decorator and on in PYTHON_SERVERS and resource and handler:
            if low in HTTP_METHODS:
                return [("server", low, resource, handler)]
            if low == "route":
                option = _option(call.args[1:], "methods")
                end = next((i for i, t in enumerate(option) if t.text in "])"), 0)
                return [("server", m, resource, handler) for m in [t.value.lower() for t in option[:end] if t.value] or ["any"]]
        if not decorator and on in PYTHON_CLIENTS and low in HTTP_METHODS and resource:
            return [("client", low, resource, None)]
    elif language == "go":
        if method == "HandleFunc" and resource and (owner := _name(call.args, 1)):
            return [("server", "any", resource, owner)]
        if receiver == "http" and method in GO_CLIENTS and resource:
            return [("client", low, resource, None)]
        if receiver == "http" and method in GO_REQUESTS and resource and (url := _value(call.args, 1)):
            return [("client", resource.lower(), url, None)]
    elif language == "rust":
        if low == "route" and resource and len(call.args) > 1:
            inner = [t.text for t in call.args[1]]
            if len(inner) >= 4 and inner[0].lower() in HTTP_METHODS and inner[1] == "(" and inner[3] == ")":
                return [("server", inner[0].lower(), resource, inner[2])]
        if decorator and len(call.chain) == 1 and low in HTTP_METHODS and resource and handler:
            return [("server", low, resource, handler)]
        if "::".join(call.chain[-2:]) == "reqwest::get" and resource:
            return [("client", "get", resource, None)]
    return []


def endpoints(source: str, language: str) -> list[tuple[str, str, str, str, str | None, int]]:
    """(protocol, role, operation, resource, owner, line) of a source, by line."""
    listed = tokens(source, language)
    code = [t for t in listed if t.kind != "line"]
    order = {id(t): i for i, t in enumerate(listed)}
    out = set()
    for call in calls(listed):
        before = code[call.first - 1].text if call.first else ""
        decorator, handler = False, None
        if call.closed and call.after <= len(code):
            last = order[id(code[call.after - 1])]
            if language == "python" and before == "@":
                decorator, handler = True, _declared(listed, last + 1, ("async",), "def")
            elif language == "rust" and before == "[" and call.first > 1 and code[call.first - 2].text == "#":
                decorator, handler = True, _declared(listed, last + 2, ("pub", "async"), "fn")
        line = source.count("\n", 0, code[call.first].at) + 1
        out |= {("http", role, operation, resource, owner, line) for role, operation, resource, owner in _http(call, language, handler, decorator)}
        resource = _value(call.args, 0)
        if not resource:
            continue
        receiver = call.chain[-2].lower() if len(call.chain) > 1 and call.glue == "." else ""
        method = call.chain[-1].lower()
        for protocol, role, operation, receivers, methods, handled in [] if decorator else NAMED_CALLS:
            owner = _name(call.args, 1) if handled else None
            if receiver in receivers and method in methods and (owner or not handled):
                out.add((protocol, role, operation, resource, owner, line))
        for protocol, role, operation, receivers, methods in NAMED_DECORATORS if decorator else []:
            if receiver in receivers and method in methods and handler:
                out.add((protocol, role, operation, resource, handler, line))
        if receiver in SQL_RECEIVERS and method in SQL_METHODS or "::".join(call.chain[-2:]).lower() in SQL_FUNCTIONS:
            if len(resource) <= 4000 and (found := statement(resource)):
                out.add(("database", found[0], found[1], found[2], None, line))
    return sorted(out, key=lambda e: (e[5], *(x or "" for x in e[:5])))
