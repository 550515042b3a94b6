"""YAML 1.2 core: no dates, no yes/no booleans, no octal by a leading zero, no repeated keys."""

from __future__ import annotations

import base64
import math
import re

import yaml

from .model import ParseError

MAX_DEPTH = 256


class Loader(yaml.SafeLoader):
    yaml_implicit_resolvers: dict = {}

    def compose_node(self, parent, index):
        self._depth = getattr(self, "_depth", 0) + 1
        if self._depth > MAX_DEPTH:
            raise ParseError("too_deep")
        try:
            return super().compose_node(parent, index)
        finally:
            self._depth -= 1


for _tag, _pattern, _first in (
    ("bool", r"true|True|TRUE|false|False|FALSE", "tTfF"),
    ("int", r"[-+]?[0-9]+|0o[0-7]+|0x[0-9a-fA-F]+", "-+0123456789"),
    ("float", r"[-+]?(?:\.[0-9]+|[0-9]+(?:\.[0-9]*)?)(?:[eE][-+]?[0-9]+)?|[-+]?\.(?:inf|Inf|INF)|\.(?:nan|NaN|NAN)", "-+0123456789."),
    ("null", r"~|null|Null|NULL|", "~nN\0"),
    ("merge", r"<<", "<"),
):
    for _c in _first:
        Loader.yaml_implicit_resolvers.setdefault("" if _c == "\0" else _c, []).append((f"tag:yaml.org,2002:{_tag}", re.compile(f"(?:{_pattern})\\Z")))


def _mapping(loader, node, deep=True):
    out: dict = {}
    for k, v in node.value:
        key = loader.construct_object(k, deep=True)
        key = key if isinstance(key, str) else str(key).lower() if isinstance(key, bool) else "null" if key is None else str(key)
        if key in out:
            raise ParseError("syntax", f"the key {key} is repeated")
        out[key] = loader.construct_object(v, deep=True)
    return out


def _int(loader, node):
    s = node.value
    return int(s, 0) if s[:2] in ("0o", "0x") else int(s)


Loader.add_constructor("tag:yaml.org,2002:map", _mapping)
Loader.add_constructor("tag:yaml.org,2002:int", _int)
Loader.add_constructor("tag:yaml.org,2002:binary", lambda loader, node: base64.b64encode(base64.b64decode(node.value)).decode())
Loader.add_constructor("tag:yaml.org,2002:set", lambda loader, node: list(_mapping(loader, node)))
Loader.add_constructor("tag:yaml.org,2002:omap", lambda loader, node: {k: v for item in loader.construct_sequence(node, deep=True) for k, v in item.items()})


def plain(value):
    """JSON values only: NaN and infinities are null, minus zero is zero."""
    if isinstance(value, float):
        return None if not math.isfinite(value) else value + 0.0
    if isinstance(value, dict):
        return {k: plain(v) for k, v in value.items() if k != "__proto__"}
    if isinstance(value, list | tuple | set):
        return [plain(v) for v in value]
    return value


def load(text: str):
    try:
        return plain(yaml.load(text, Loader=Loader))  # noqa: S506  a subclass of the safe loader
    except (yaml.YAMLError, RecursionError, ValueError) as e:
        raise e if isinstance(e, ParseError) else ParseError("syntax", str(e)) from e
