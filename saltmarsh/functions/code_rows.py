"""Source files cut into flat rows: calls, comparisons, bindings, imports, functions, lines.

Column functions have no way to balance brackets of any depth or to tell code from text inside literals and comments, so this
one step runs in Python on Arrow batches: a syntax tree for Python, one pass over tokens for JavaScript. It cuts and nothing else: a
row holds names and texts as they are written. What a name stands for, which function a place is in and what a rule says about it are
joins and columns (``operators/resolve.py``, ``intervals.py``, ``detect_calls.py``).

Texts of arguments and values are cut at ``TEXT`` characters, and the text of a line is a row of its own, so that what comes out
grows in proportion to the file, however deeply its calls are nested. A file that cannot be read as its language gives one
row of kind ``error`` with the reason, and no calls; what parses as Python depends on the version of the workers' Python.
"""

from __future__ import annotations

import ast
import bisect
import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

# This function runs on executors, which need no copy of the library.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: A written value: its text, the name if it is nothing but a name, and the length of a string literal.
VALUE = "struct<text:string,name:string,size:int>"
#: One row. ``args`` are a call's arguments (``keyword`` is null for one by place) with the first argument of an argument that is a call itself,
#: or both sides of a comparison, or the one value of a binding. ``target`` is an import's origin, a line's text, an error's reason, a
#: comparison's operator. Places count bytes (Python) or characters (JavaScript) from the start of the file.
ROW = ("struct<kind:string,place:bigint,end:bigint,line:int,name:string,target:string,"
       f"args:array<struct<keyword:string,value:{VALUE},inner:{VALUE}>>>")
CALL, COMPARE, BIND, REBIND, ALIAS, FUNCTION, LINE, ERROR = "call", "compare", "bind", "rebind", "alias", "function", "line", "error"
#: Characters of an argument or value that are kept. Rules look at names, short literals and the head of an expression.
TEXT = 1000
LINE_BREAK = re.compile("\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]")


def _row(kind: str, place: int, line: int, name: str | None = None, target: str | None = None, args: list | None = None, end: int | None = None) -> tuple:
    return kind, place, end, line, name, target, args


def _with_lines(rows: list[tuple], text: str) -> list[tuple]:
    """The rows, and the text of each line that holds a call or a comparison."""
    wanted = sorted({r[3] for r in rows if r[0] in (CALL, COMPARE)})
    if wanted:
        lines = LINE_BREAK.split(text)
        rows += [_row(LINE, 0, n, target=lines[n - 1].strip() if n <= len(lines) else "") for n in wanted]
    return rows


# --- Python -------------------------------------------------------------------
def _dotted(node: ast.AST) -> str:
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    return ".".join(reversed([*parts, node.id])) if isinstance(node, ast.Name) else ""


_OPAQUE = re.compile(
    r"#[^\r\n]*|\"\"\"(?:[^\\]|\\[\s\S])*?(?:\"\"\"|\Z)|\'\'\'(?:[^\\]|\\[\s\S])*?(?:\'\'\'|\Z)"
    r"|\"(?:[^\"\\\r\n]|\\[\s\S])*\"?|'(?:[^'\\\r\n]|\\[\s\S])*'?")
_GIVES_NAME = re.compile(r"[ \t]*(?:(?:import|from)[ \t]|[^\W\d]\w*[ \t]*[:=](?!=))")
_STATEMENT_END = re.compile(r"[(\[{]|\\(?:\r\n|[\r\n])|\r\n|[\r\n]")
_PYTHON_BREAK = re.compile(r"\r\n|[\r\n]")


def _parsable(text: str) -> ast.Module:
    """Imports and bindings that parse by themselves, of a text that does not as a whole; their places are those in the text."""
    plain = _OPAQUE.sub(lambda m: (" " if m[0][0] == "#" else "_") * len(m[0]), text)
    partner, stack = {}, []
    for m in re.finditer(r"[()\[\]{}]", plain):
        if m[0] in _OPEN:
            stack.append(m)
        elif stack and _OPEN[stack[-1][0]] == m[0]:
            partner[stack.pop().start()] = m.end()
    starts = [0, *(m.end() for m in _PYTHON_BREAK.finditer(text))]
    found, at = [], 0
    while at < len(plain):
        m = _PYTHON_BREAK.search(plain, at)
        following = m.end() if m else len(plain)
        if _GIVES_NAME.match(plain, at):
            end = at
            # brackets that close are stepped over; one that does not ends with its line
            while (m := _STATEMENT_END.search(plain, end)) and (m[0] in _OPEN or m[0][0] == "\\"):
                end = partner.get(m.start(), m.end())
            end = m.end() if m else len(plain)
            indented = text[at] in " \t"
            try:
                body = ast.parse("if 1:\n" * indented + text[at:end]).body
            except (SyntaxError, ValueError, RecursionError, MemoryError):
                body = []
            for node in body[0].body if indented and body else body:
                found.append(ast.increment_lineno(node, bisect.bisect_right(starts, at) - 1 - indented))
            following = end if body else following
        at = following
    return ast.Module(body=found, type_ignores=[])


def python_rows(text: str, wanted: re.Pattern | None, comparisons: bool) -> list[tuple]:
    """Rows of a Python file.

    With ``wanted`` only calls whose written name matches, or starts with a name that an import gave (it may stand for one
    that matches); bindings, imports and functions then come only with a call or comparison that may need them.
    A file that does not parse has no calls; without ``wanted`` its imports and bindings come where they parse by themselves.
    """
    text = text.removeprefix("\ufeff")
    error = None
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        error = _row(ERROR, 0, getattr(e, "lineno", None) or 1, target=type(e).__name__)
        if wanted is not None:
            return [error]
        tree = _parsable(text)
    source = text.encode("utf-8", "surrogatepass")
    starts = [0, *(m.end() for m in re.finditer(rb"\r\n|[\r\n]", source))]

    def begin(node: ast.AST) -> int:
        return starts[node.lineno - 1] + node.col_offset

    def finish(node: ast.AST) -> int:
        return starts[node.end_lineno - 1] + node.end_col_offset

    def value(node: ast.AST | None) -> tuple | None:
        if node is None:
            return None
        name = node.id if isinstance(node, ast.Name) else None
        if isinstance(node, ast.Constant):
            size = len(node.value) if isinstance(node.value, (str, bytes)) else None
            return source[begin(node) : finish(node)][: 4 * TEXT].decode("utf-8", "replace")[:TEXT], name, size
        written = _dotted(node)
        if not written:
            first = begin(node)
            written = source[first : min(finish(node), first + 4 * TEXT)].decode("utf-8", "replace")[:TEXT]
            # a break inside brackets is one blank, before a closing one it is none
            written = re.sub(r"\s*[\r\n]\s*", " ", re.sub(r"\s*[\r\n]\s*(?=[)\]}])", "", written))
        return written, name, None

    calls, others, renamed = [], [], set()
    todo: list[ast.AST] = [tree]
    while todo:
        node = todo.pop()
        if isinstance(node, ast.Assign):
            others += [_row(BIND, begin(node), node.lineno, t.id, args=[(None, value(node.value), None)]) for t in node.targets if isinstance(t, ast.Name)]
        elif isinstance(node, ast.AnnAssign) and isinstance(node.target, ast.Name) and node.value is not None:
            others.append(_row(BIND, begin(node), node.lineno, node.target.id, args=[(None, value(node.value), None)]))
        elif isinstance(node, (ast.Import, ast.ImportFrom)):
            for a in node.names:
                target = a.name.split(".")[0] if isinstance(node, ast.Import) else a.name
                renamed |= {a.asname} if a.asname else set()
                others.append(_row(ALIAS, begin(a), node.lineno, a.asname or target, target))
        elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            # decorators and defaults count as inside
            others.append(_row(FUNCTION, min([begin(node), *map(begin, node.decorator_list)]), node.lineno, node.name, end=finish(node)))
        elif isinstance(node, ast.Call) or comparisons and isinstance(node, ast.Compare):
            calls.append(node)
        todo += reversed(list(ast.iter_child_nodes(node)))
    if error:
        return [error, *(r for r in others if r[0] in (BIND, ALIAS))]

    rows = []
    for node in calls:
        if isinstance(node, ast.Compare):
            if len(node.ops) == 1 and isinstance(node.ops[0], (ast.Eq, ast.NotEq)):
                op = "==" if isinstance(node.ops[0], ast.Eq) else "!="
                rows.append(_row(COMPARE, begin(node), node.lineno, target=op, args=[(None, value(s), None) for s in (node.left, node.comparators[0])]))
            continue
        callee = _dotted(node.func)
        if not callee or wanted is not None and not wanted.search(callee) and callee.partition(".")[0] not in renamed:
            continue
        given = [(None, a) for a in node.args if not isinstance(a, ast.Starred)] + [(k.arg, k.value) for k in node.keywords if k.arg]
        args = [(word, value(a), value(a.args[0]) if isinstance(a, ast.Call) and a.args else None) for word, a in given]
        rows.append(_row(CALL, begin(node), node.lineno, callee, args=args))
    return _with_lines(rows + others, text) if rows or wanted is None else []


# --- JavaScript ---------------------------------------------------------------
_TOKEN = re.compile(
    r"(?P<space>\s+|//[^\n\r\u2028\u2029]*|/\*[\s\S]*?(?:\*/|\Z))|(?P<string>\"(?:[^\"\\\n]|\\[\s\S])*\"?|'(?:[^'\\\n]|\\[\s\S])*'?)"
    r"|(?P<template>`)|(?P<name>[A-Za-z_$][\w$]*)|(?P<number>\.?\d[\w.]*)"
    r"|(?P<punct>=>|===|!==|==|!=|<=|>=|&&|\|\||\?\?|\?\.|\+\+|--|\.\.\.|[-+*/%&|^<>]=|[\s\S])")
_REGEX = re.compile(r"/(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[A-Za-z]*")
_BEFORE_REGEX = frozenset("( , = : [ ! & | ? { } ; + - * % < > ~ ^ => == === != !== && || ?? return typeof case in of".split())
_CONTROL = frozenset("if for while switch catch with".split())
_ASSIGN = frozenset("= += -= *= /= %= &= |= ^=".split())
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, frozenset(")]}")


def _template_end(text: str, at: int) -> int:
    """End of the template literal that starts at ``at``; what is inserted into it belongs to it."""
    depth, i = 0, at + 1
    while i < len(text):
        c = text[i]
        if c == "\\":
            i += 1
        elif c == "`" and not depth:
            return i + 1
        elif c == "{" and (depth or text[i - 1] == "$"):
            depth += 1
        elif c == "}" and depth:
            depth -= 1
        i += 1
    return len(text)


def _tokens(text: str) -> list[tuple[str, str, int, int]]:
    """(kind, text, start, end) of everything but white space and comments."""
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        kind, end = m.lastgroup, m.end()
        if kind == "template":
            end = _template_end(text, at)
        elif kind == "punct" and text[at] == "/" and (not out or out[-1][1] in _BEFORE_REGEX):
            r = _REGEX.match(text, at)
            kind, end = ("regex", r.end()) if r else (kind, end)
        if kind != "space":
            out.append((kind, text[at:end], at, end))
        at = end
    return out


def javascript_rows(text: str, wanted: re.Pattern | None, comparisons: bool) -> list[tuple]:
    """Rows of a JavaScript file; with ``wanted`` only calls whose dotted name matches, and the rest only if there is a row to need it."""
    tokens = _tokens(text)
    n = len(tokens)
    partner, around, stack = [-1] * n, [-1] * n, []
    for i, (kind, t, _, _) in enumerate(tokens):
        around[i] = stack[-1] if stack else -1
        if kind == "punct" and t in _OPEN:
            stack.append(i)
        elif kind == "punct" and t in _CLOSE and stack and _OPEN[tokens[stack[-1]][1]] == t:
            partner[stack[-1]], partner[i] = i, stack[-1]
            around[i] = around[stack.pop()]
    starts = [m.end() for m in LINE_BREAK.finditer(text)]

    def word(i: int) -> str:
        return tokens[i][1] if 0 <= i < n else ""

    def value(first: int, last: int) -> tuple | None:
        """A run of tokens, white space as single blanks."""
        if first >= last:
            return None
        kind, t, at, _ = tokens[first]
        written = re.sub(r"\s+", " ", text[at : min(tokens[last - 1][3], at + TEXT)])
        alone = last == first + 1
        closed = kind == "string" and len(t) > 1 and t[-1] == t[0]
        return written, t if alone and kind == "name" else None, len(t) - 2 if alone and closed else None

    def chain_start(i: int) -> int:
        """First token of the member chain that ends with name ``i``."""
        while word(i - 1) in (".", "?.") and tokens[i - 2][0] == "name":
            i -= 2
        return i

    def chain(first: int, last: int) -> str:
        return "".join(t for _, t, _, _ in tokens[first : last + 1]).replace("?.", ".")

    def expression_end(i: int) -> int:
        """Where an expression ends that starts at token ``i``."""
        while i < n and not (tokens[i][0] == "punct" and (word(i) in _CLOSE or word(i) in (",", ";"))):
            i = partner[i] + 1 if tokens[i][0] == "punct" and partner[i] > i else i + 1
            if i < n and "\n" in text[tokens[i - 1][3] : tokens[i][2]] and tokens[i][0] in ("name", "string", "number") \
                    and (tokens[i - 1][0] != "punct" or word(i - 1) in _CLOSE):
                break
        return i

    opens: dict[int, tuple[int, str | None]] = {}
    #: brackets in which = gives a default or a field, not a variable's value
    not_assigning: set[int] = set()
    declared_at: set[int] = set()
    others = []

    def declared(i: int) -> str | None:
        """Name of the variable that is given the value starting at token ``i``."""
        return word(i - 2) if word(i - 1) == "=" and i >= 2 and tokens[i - 2][0] == "name" and word(i - 3) != "." else None

    def bind(kind: str, at: int, first: int) -> int:
        end = expression_end(first)
        if end > first:
            others.append(_row(kind, tokens[at][2], 1 + bisect.bisect_right(starts, tokens[at][2]), word(at), args=[(None, value(first, end), None)]))
        return end

    for i, (kind, t, _, _) in enumerate(tokens):
        if kind == "name" and t in ("const", "let", "var"):
            k = i + 1
            while k + 1 < n and tokens[k][0] == "name":
                declared_at.add(k)
                end = bind(BIND, k, k + 2) if word(k + 1) == "=" else k + 1
                if word(end) != ",":
                    break
                k = end + 1
        elif kind == "name" and t == "class":
            body = next((k for k in range(i + 1, min(n, i + 64)) if word(k) in ("{", ";")), n)
            not_assigning |= {body} if word(body) == "{" else set()
        elif kind == "name" and t == "function":
            k = i + 1 + (word(i + 1) == "*")
            name = word(k) if k < n and tokens[k][0] == "name" else None
            hint = declared(i - (word(i - 1) == "async"))
            p = k + (name is not None)
            not_assigning.add(p)
            body = partner[p] + 1 if word(p) == "(" and partner[p] > p else n
            if word(body) == "{":
                opens[body] = (partner[body] if partner[body] > body else n, name or hint)
        elif t == "=>":
            first = partner[i - 1] if word(i - 1) == ")" and partner[i - 1] >= 0 else i - 1
            not_assigning.add(first)
            hint = declared(first - (word(first - 1) == "async"))
            body = i + 1
            end = partner[body] if word(body) == "{" and partner[body] > body else expression_end(body) - 1
            opens[body] = (max(end, body), hint)
        elif kind == "punct" and t == "{" and word(i - 1) == ")" and i not in opens and partner[i - 1] >= 1:
            head = partner[i - 1] - 1
            if tokens[head][0] == "name" and word(head) not in _CONTROL and partner[i] > i:
                opens[i] = (partner[i], None)
                not_assigning.add(partner[i - 1])
    for i, (kind, t, _, _) in enumerate(tokens):
        if kind == "punct" and t in _ASSIGN and i and tokens[i - 1][0] == "name" and i - 1 not in declared_at and word(i - 2) not in (".", "?."):
            k = around[i]
            while k >= 0 and k not in not_assigning and word(k) == "[":
                k = around[k]
            if k not in not_assigning:
                bind(REBIND, i - 1, i + 1)
    for body, (end, name) in opens.items():
        if body < n:
            others.append(_row(FUNCTION, tokens[body][2], 0, name, end=tokens[min(end, n - 1)][3]))

    rows = []
    for i, (kind, t, at, _) in enumerate(tokens):
        if kind == "name" and word(i + 1) == "(" and partner[i + 1] > i and word(i - 1) != "function":
            first = chain_start(i)
            callee = chain(first, i)
            # a declaration's head or a control word is no call
            if t in _CONTROL or t == "async" and word(partner[i + 1] + 1) == "=>" or first == i and partner[i + 1] + 1 in opens and word(i - 1) not in ("=", "(", ",", "return"):
                continue
            if wanted is not None and not wanted.search(callee):
                continue
            args, k, close = [], i + 2, partner[i + 1]
            while k < close:
                end = k
                while end < close and word(end) != ",":
                    end = partner[end] + 1 if partner[end] > end else end + 1
                if end > k:
                    args.append((None, value(k, end), None))
                k = end + 1
            place = tokens[first][2]
            # a member of what a call gave starts behind that call
            rows.append(_row(CALL, place, 1 + bisect.bisect_right(starts, place), callee, args=args))
        elif comparisons and kind == "punct" and t in ("==", "!=", "===", "!=="):
            sides = _operand_before(tokens, partner, i, chain_start), _operand_after(tokens, partner, i)
            if None not in sides:
                args = [(None, (v[0].replace("?.", "."), *v[1:]), None) for v in (value(*s) for s in sides)]
                rows.append(_row(COMPARE, at, 1 + bisect.bisect_right(starts, at), target=t, args=args))
    return _with_lines(rows + others, text) if rows or wanted is None else []


def _operand_before(tokens, partner, i, chain_start) -> tuple[int, int] | None:
    kind, t = tokens[i - 1][:2] if i else ("", "")
    if kind in ("string", "number"):
        return i - 1, i
    if kind == "name":
        return chain_start(i - 1), i
    if t in (")", "]") and partner[i - 1] >= 0:
        first = partner[i - 1]
        return (chain_start(first - 1) if first and tokens[first - 1][0] == "name" else first), i
    return None


def _operand_after(tokens, partner, i) -> tuple[int, int] | None:
    k = i + 1
    if k >= len(tokens):
        return None
    if tokens[k][0] in ("string", "number"):
        return k, k + 1
    if tokens[k][0] != "name":
        return None
    while k + 2 < len(tokens) and tokens[k + 1][1] in (".", "?.") and tokens[k + 2][0] == "name":
        k += 2
    k += 1
    while k < len(tokens) and tokens[k][1] in ("(", "[") and partner[k] > k:
        k = partner[k] + 1
    return i + 1, k


# --- as a column --------------------------------------------------------------
_VALUE = pa.struct([("text", pa.string()), ("name", pa.string()), ("size", pa.int32())])
_ROWS = pa.list_(pa.struct([
    ("kind", pa.string()), ("place", pa.int64()), ("end", pa.int64()), ("line", pa.int32()), ("name", pa.string()), ("target", pa.string()),
    ("args", pa.list_(pa.struct([("keyword", pa.string()), ("value", _VALUE), ("inner", _VALUE)])))]))


def rows_in(text: Column, language: str, callees: str | None, comparisons: bool) -> Column:
    """Array of ``ROW`` of a whole file."""
    cut = {"python": python_rows, "javascript": javascript_rows}[language]
    wanted = None if callees is None else re.compile(callees)

    @F.arrow_udf(f"array<{ROW}>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([cut(x or "", wanted, comparisons) for x in batch.to_pylist()], _ROWS)

    return run(text)
