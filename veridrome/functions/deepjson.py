"""JSON of any depth: a reader and a writer that use no recursion.

For texts that the standard library gives up on; slower, with the same results.
"""

from __future__ import annotations

import json
import re
from json.decoder import scanstring

_SPACE = re.compile(r"[ \t\n\r]*")
_SCALAR = re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null|NaN|-?Infinity")


def loads(text: str):
    """The value of a JSON text; ``ValueError`` if it is none."""
    try:
        return json.loads(text)
    except RecursionError:
        return _loads(text)


def _loads(text: str):
    skip = lambda i: _SPACE.match(text, i).end()
    holder: list = []
    stack: list[tuple[object, object]] = [(holder, None)]  # open values, each with the key that waits in it
    i, want = skip(0), "value"
    while True:
        top, key = stack[-1]
        c = text[i : i + 1]
        if want == "value":
            if c in ("{", "["):
                new: object = {} if c == "{" else []
                if isinstance(top, dict):
                    top[key] = new
                else:
                    top.append(new)
                stack.append((new, None))
                i = skip(i + 1)
                want = "key or end" if c == "{" else "value or end"
                continue
            if c == '"':
                v, i = scanstring(text, i + 1)
            else:
                m = _SCALAR.match(text, i)
                if not m:
                    raise ValueError(f"no value at {i}")
                v, i = json.loads(m[0]), m.end()
            if isinstance(top, dict):
                top[key] = v
            else:
                top.append(v)
            want = "next"
        elif want in ("key", "key or end"):
            if c == "}" and want == "key or end":
                stack.pop()
                i, want = i + 1, "next"
            elif c == '"':
                key, i = scanstring(text, i + 1)
                i = skip(i)
                if text[i : i + 1] != ":":
                    raise ValueError(f"no colon at {i}")
                stack[-1] = (top, key)
                i, want = i + 1, "value"
            else:
                raise ValueError(f"no name at {i}")
        elif want == "value or end":
            if c == "]":
                stack.pop()
                i, want = i + 1, "next"
            else:
                want = "value"
            continue
        else:  # behind a value
            i = skip(i)
            if len(stack) == 1:
                if i != len(text):
                    raise ValueError(f"more at {i}")
                return holder[0]
            c, close = text[i : i + 1], "}" if isinstance(top, dict) else "]"
            if c == close:
                stack.pop()
            elif c == ",":
                want = "key" if close == "}" else "value"
            else:
                raise ValueError(f"no end at {i}")
            i += 1
        i = skip(i)


def dumps(value) -> str:
    """The JSON text of a value."""
    try:
        return json.dumps(value, ensure_ascii=False)
    except RecursionError:
        return _dumps(value)


def _dumps(value) -> str:
    out: list[str] = []
    todo: list = [("value", value)]
    while todo:
        what, v = todo.pop()
        if what == "text":
            out.append(v)
        elif isinstance(v, dict):
            parts = [("text", "{")]
            for n, (k, x) in enumerate(v.items()):
                parts += [("text", (", " if n else "") + json.dumps(str(k), ensure_ascii=False) + ": "), ("value", x)]
            todo += reversed([*parts, ("text", "}")])
        elif isinstance(v, list):
            parts = [("text", "[")]
            for n, x in enumerate(v):
                parts += [("text", ", ")] * bool(n) + [("value", x)]
            todo += reversed([*parts, ("text", "]")])
        else:
            out.append(json.dumps(v, ensure_ascii=False))
    return "".join(out)
