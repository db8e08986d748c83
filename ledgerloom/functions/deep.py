"""JSON however deeply it is nested: the interpreter's own parser where it can, a parser with its own stack where it cannot."""

from __future__ import annotations

import json
import re
from json.decoder import scanstring

_TOKEN = re.compile(r'[ \t\n\r]*(?:([\[\]{},:])|(")|(-?(?:0|[1-9]\d*)(\.\d+)?([eE][+-]?\d+)?)|(true|false|null))')
_WORDS = {"true": True, "false": False, "null": None}
_NONE = object()


def loads(text: str, parse_float=float):
    """What ``json.loads`` gives, at any depth; ValueError for anything that is no complete JSON."""
    try:
        return json.loads(text, parse_float=parse_float)
    except RecursionError:
        return _loads(text, parse_float)


def _loads(text: str, parse_float):
    stack: list[tuple[list | dict, str | None]] = []  # open containers, and the name that waits for a value
    held, name, value, at = None, None, _NONE, 0
    expect = "value"  # or name, first (name or end), element (value or end), colon, more (comma or end), end
    while expect != "end":
        match = _TOKEN.match(text, at)
        if not match:
            raise ValueError(f"no JSON at {at}")
        at = match.end()
        mark = match[1]
        if mark == ":":
            if expect != "colon":
                raise ValueError(f"no value at {at}")
            expect = "value"
            continue
        if mark == ",":
            if expect != "more":
                raise ValueError(f"no value at {at}")
            expect = "name" if isinstance(held, dict) else "value"
            continue
        if mark in ("]", "}") and mark is not None:
            fits = expect == "more" or expect == ("element" if mark == "]" else "first")
            if not fits or held is None or isinstance(held, dict) != (mark == "}"):
                raise ValueError(f"no end at {at}")
            value = held
            held, name = stack.pop()
        elif mark:
            if expect not in ("value", "element"):
                raise ValueError(f"no {mark} at {at}")
            stack.append((held, name))
            held, name, expect = ([], None, "element") if mark == "[" else ({}, None, "first")
            continue
        else:
            if match[2]:
                value, at = scanstring(text, at, True)
                if expect in ("name", "first"):
                    name, expect = value, "colon"
                    continue
            else:
                value = _WORDS[match[6]] if match[6] else parse_float(match[3]) if match[4] or match[5] else int(match[3])
            if expect not in ("value", "element"):
                raise ValueError(f"no value at {at}")
        if held is None:
            expect = "end"
        else:
            if isinstance(held, dict):
                held[name] = value
            else:
                held.append(value)
            expect = "more"
    if text[at:].strip(" \t\n\r"):
        raise ValueError(f"more than one value at {at}")
    return value


def dumps(value, sort_keys: bool = False) -> str:
    """Compact JSON with non-ASCII kept, at any depth."""
    try:
        return json.dumps(value, ensure_ascii=False, separators=(",", ":"), sort_keys=sort_keys)
    except RecursionError:
        out, stack = [], [(False, value)]  # (already text, what)
        while stack:
            done, v = stack.pop()
            if done:
                out.append(v)
            elif isinstance(v, dict):
                names = sorted(v) if sort_keys else list(v)
                parts = [x for i, k in enumerate(names) for x in ((True, "," * bool(i) + json.dumps(k, ensure_ascii=False) + ":"), (False, v[k]))]
                stack += [(True, "}"), *reversed(parts), (True, "{")]
            elif isinstance(v, list):
                parts = [x for i, y in enumerate(v) for x in ((True, "," * bool(i)), (False, y))]
                stack += [(True, "]"), *reversed(parts), (True, "[")]
            else:
                out.append(json.dumps(v, ensure_ascii=False))
        return "".join(out)
