"""JSON text of any depth: the library's parser and writer, and stacks where those give up.

The library's own functions call themselves for each level and end some ten thousand levels
down. Beyond that the same grammar is read, and the same text written, with a stack.
"""

from __future__ import annotations

import json
import re
from json.decoder import scanstring

_BLANK = re.compile(r"[ \t\n\r]*")
_NUMBER = re.compile(r"(-?(?:0|[1-9][0-9]*))(\.[0-9]+)?([eE][-+]?[0-9]+)?")
_WORDS = {"null": None, "true": True, "false": False, "NaN": float("nan"), "Infinity": float("inf"), "-Infinity": float("-inf")}


def loads(text: str) -> object:
    """As ``json.loads``, at any depth; ValueError where the text is no JSON."""
    try:
        return json.loads(text)
    except RecursionError:
        return _loads_deep(text)


def dumps(value: object) -> str:
    """As ``json.dumps`` without blanks and with all letters kept, at any depth."""
    try:
        return json.dumps(value, ensure_ascii=False, separators=(",", ":"))
    except RecursionError:
        return "".join(_pieces(value))


def _scalar(text: str, at: int) -> tuple[object, int]:
    if text[at] == '"':
        return scanstring(text, at + 1, True)
    m = _NUMBER.match(text, at)
    if m:
        whole, part, power = m.groups()
        return (float(m.group()) if part or power else int(whole)), m.end()
    for word, value in _WORDS.items():
        if text.startswith(word, at):
            return value, at + len(word)
    raise ValueError(f"no value at {at}")


def _loads_deep(text: str) -> object:
    skip = lambda i: _BLANK.match(text, i).end()
    opened: list[tuple[dict | list, str | None]] = []  # containers not yet closed, each with the member a value goes to

    def member(i: int) -> tuple[str, int]:
        if text[i] != '"':
            raise ValueError(f"no member name at {i}")
        name, i = scanstring(text, i + 1, True)
        i = skip(i)
        if text[i] != ":":
            raise ValueError(f"no colon at {i}")
        return name, skip(i + 1)

    at = skip(0)
    try:
        while True:
            value: object
            if text[at] in "{[":
                value = {} if text[at] == "{" else []
                end = "}" if text[at] == "{" else "]"
                at = skip(at + 1)
                if text[at] != end:
                    name = None
                    if end == "}":
                        name, at = member(at)
                    opened.append((value, name))
                    continue
                at += 1
            else:
                value, at = _scalar(text, at)
            while opened:
                holder, name = opened.pop()
                if name is None:
                    holder.append(value)
                else:
                    holder[name] = value
                at = skip(at)
                if text[at] == ",":
                    at = skip(at + 1)
                    if name is not None:
                        name, at = member(at)
                    opened.append((holder, name))
                    break
                if text[at] != ("]" if name is None else "}"):
                    raise ValueError(f"no end of a container at {at}")
                at, value = at + 1, holder
            else:
                if skip(at) != len(text):
                    raise ValueError(f"more text at {at}")
                return value
    except IndexError:
        raise ValueError("the text is cut") from None


def _pieces(value: object):
    one = lambda x: json.dumps(x, ensure_ascii=False)
    stack: list[tuple[str, object]] = [("", value)]
    while stack:
        lead, node = stack.pop()
        yield lead
        if node is _END:
            continue
        if isinstance(node, dict) and node:
            parts = [(("{" if i == 0 else ",") + one(k) + ":", v) for i, (k, v) in enumerate(node.items())]
            stack += [("}", _END), *reversed(parts)]
        elif isinstance(node, list) and node:
            parts = [("[" if i == 0 else ",", v) for i, v in enumerate(node)]
            stack += [("]", _END), *reversed(parts)]
        else:
            yield one(node)


_END = object()
