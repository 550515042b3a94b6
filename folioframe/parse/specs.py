"""OpenAPI 3 and AsyncAPI 3 specifications as sections; other YAML as one row."""

from __future__ import annotations

from collections import Counter

from . import yaml12
from .model import ParseError, Parsed, complete
from .synth import Builder, as_dict, as_list, merged, pointer, slot

#: The operations of a path item, in their order.
METHODS = ("get", "put", "post", "delete", "options", "head", "patch", "trace")
MAX_SERVERS = 20


def _version(top, key: str) -> bool:
    return isinstance(top, dict) and isinstance(top.get(key), str) and top[key].startswith("3.")


def _frontmatter(top: dict) -> dict:
    info = as_dict(top.get("info"))
    return {k: v for k, v in {**{k: info.get(k) for k in ("title", "version", "description")}, "tags": [t.get("name") for t in as_list(top.get("tags")) if isinstance(t, dict)]}.items() if v}


def _parameters(item: dict, op: dict, root: dict) -> list[dict]:
    """Path-level parameters under the operation's, which win by (in, name)."""
    found: dict[tuple, dict] = {}
    for p in as_list(item.get("parameters")) + as_list(op.get("parameters")):
        p = as_dict(p)
        real = as_dict(pointer(root, p["$ref"])) if "$ref" in p else p
        found[real.get("in"), real.get("name") or p.get("$ref")] = real or p
    return list(found.values())


def _status(code: str) -> tuple:
    return (0, int(code), "") if code.isdigit() else (1, 0, code)


def _operation(b: Builder, title: str, kind: str, op: dict, item: dict, top: dict, unique: set[str]) -> None:
    oid = op.get("operationId")
    b.section(2, title, slot(kind, f"oid:{oid}" if oid in unique else title))
    b.line("Summary", op.get("summary"))
    if op.get("description"):
        b.add(f"{op['description']}\n\n")
    b.line("Operation ID", oid)
    for n, p in enumerate(_parameters(item, op, top)):
        if not n:
            b.add("Parameters:\n\n")
        b.add(f"- `{p.get('name', p.get('$ref', ''))}` ({p.get('in', '')}{', required' if p.get('required') else ''}) {p.get('description') or ''}".rstrip() + "\n")
    responses = as_dict(op.get("responses"))
    if responses:
        b.add("\nResponses:\n\n")
        for code in sorted(map(str, responses), key=_status):
            b.add(f"- `{code}` {as_dict(responses.get(code)).get('description') or ''}".rstrip() + "\n")
    b.add("\n")
    if op.get("requestBody"):
        b.add("Request body:\n\n").fence(op["requestBody"])
    b.line("Tags", ", ".join(map(str, as_list(op.get("tags")))))
    b.line("Deprecated", "yes" if op.get("deprecated") else None)
    b.line("External docs", as_dict(op.get("externalDocs")).get("url"))
    security = op.get("security", top.get("security"))
    b.line("Security", ", ".join(k for s in as_list(security) for k in as_dict(s)))
    b.line("Servers", ", ".join(str(as_dict(s).get("url")) for s in as_list(op.get("servers"))))
    b.line("Callbacks", ", ".join(as_dict(op.get("callbacks"))))


def openapi(top: dict, path: str) -> Parsed | None:
    """A section for each operation and webhook, the components, and what is left over."""
    ops = []
    paths, hooks = as_dict(top.get("paths")), as_dict(top.get("webhooks"))
    if top["openapi"].startswith("3.0"):
        hooks = {}
    for kind, group in (("op", paths), ("webhook", hooks)):
        for name in sorted(group):
            item = as_dict(group[name])
            ops += [(kind, f"{m.upper()} {name}", as_dict(item[m]), item) for m in METHODS if isinstance(item.get(m), dict)]
    if not ops and not as_dict(top.get("components")):
        return None
    counts = Counter(op.get("operationId") for _, _, op, _ in ops)
    unique = {oid for oid, n in counts.items() if isinstance(oid, str) and n == 1}
    b = Builder("openapi", _frontmatter(top))
    info = as_dict(top.get("info"))
    b.section(1, str(info.get("title") or path))
    if info.get("description"):
        b.add(f"{info['description']}\n\n")
    for kind, title, op, item in ops:
        _operation(b, title, kind, op, item, top, unique)
    components = as_dict(top.get("components"))
    if components:
        b.section(2, "Components", "components")
        for group in sorted(components):
            for name, value in sorted(as_dict(components[group]).items()):
                b.section(3, f"{group}/{name}", slot("component", f"{group}/{name}")).fence(value)
    rest = {k: v for k, v in top.items() if k not in ("paths", "webhooks", "components", "info")}
    return b.section(2, "Spec metadata", "metadata").fence(rest).done(path)


def asyncapi(top: dict, path: str) -> Parsed | None:
    """A section for each operation, the channels, components and what is left over."""
    operations, channels = as_dict(top.get("operations")), as_dict(top.get("channels"))
    components = as_dict(top.get("components"))
    if not operations and not channels and not components:
        return None

    def real(node):
        node = as_dict(node)
        return as_dict(pointer(top, node["$ref"])) if isinstance(node.get("$ref"), str) else node

    def channel(node) -> tuple[str, dict]:
        ref = as_dict(node).get("$ref", "")
        name = ref.rsplit("/", 1)[-1]
        c = real(node)
        return (f"{name} (address unknown)" if c.get("address") is None else str(c["address"])), c

    b = Builder("asyncapi", _frontmatter(top))
    info = as_dict(top.get("info"))
    b.section(1, str(info.get("title") or path))
    if info.get("description"):
        b.add(f"{info['description']}\n\n")
    for name, server in list(as_dict(top.get("servers")).items())[:MAX_SERVERS]:
        b.add(f"- server `{name}`: {real(server).get('protocol', '')}://{real(server).get('host', '')}\n")
    for name in sorted(operations):
        node = as_dict(operations[name])
        ref = node.get("$ref")
        if isinstance(ref, str) and not ref.startswith("#/"):
            b.section(2, f"external {name}", slot("op", name)).line("Reference", ref)
            continue
        op = real(node)
        if op.get("action") not in ("send", "receive"):
            continue
        base: dict = {}
        for t in as_list(op.get("traits")):
            base = merged(base, {k: v for k, v in real(t).items() if k not in ("action", "channel", "messages", "traits")})
        op = merged(base, op)
        address, c = channel(op.get("channel"))
        b.section(2, f"{op['action'].upper()} {address}", slot("op", name))
        b.line("Operation", name).line("Summary", op.get("summary"))
        if op.get("description"):
            b.add(f"{op['description']}\n\n")
        refs = [as_dict(m).get("$ref", "").rsplit("/", 1)[-1] for m in as_list(op.get("messages"))] if "messages" in op else list(as_dict(c.get("messages")))
        b.line("Messages", ", ".join(refs))
        b.line("Tags", ", ".join(str(real(t).get("name")) for t in as_list(op.get("tags"))))
    for title, group in (("Channels", channels), ("Components", components)):
        if group:
            b.section(2, title, title.lower())
            for name in sorted(group):
                b.section(3, name, slot(title.lower(), name)).fence(group[name])
    rest = {k: v for k, v in top.items() if k not in ("operations", "channels", "components", "info")}
    return b.section(2, "Spec metadata", "metadata").fence(rest).done(path)


def parse(source: str, path: str) -> Parsed:
    """A YAML file: a specification's sections, or one row with its top level as metadata."""
    top = yaml12.load(source)
    found = openapi(top, path) if _version(top, "openapi") else asyncapi(top, path) if _version(top, "asyncapi") else None
    if found:
        return found
    if top is not None and not isinstance(top, dict | list | str | int | float | bool):
        raise ParseError("syntax")
    return complete(Parsed("yaml", source, top if isinstance(top, dict) else {}), path)
