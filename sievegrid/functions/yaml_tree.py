"""YAML texts as rows of nodes, read by indents: each node's parent is the nearest one before it with a smaller indent.

Block and flow collections, quoted, plain and block scalars, comments and several documents are read; anchors and tags are
skipped, and an alias is the scalar ``*name``. What can't be read is passed over: a broken file gives fewer nodes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

#: One node: id (from 1, in order), parent (0: the document), key of a map's entry or null, place in a sequence or null, scalar or null, line, line of the scalar.
Node = list
_KEY = re.compile(r"""(?:"((?:[^"\\]|\\.)*)"|'((?:[^']|'')*)'|([^\s"'\[\]{},#&*!|>%@`?-][^#:]*?(?::\S[^#:]*?)*|[?-]\S[^#:]*?|(?<!\S)\*\S+?|@?[^\s"'\[\]{},#:]+))[ \t]*:(?:[ \t]+(.*))?$""", re.S)
_BLOCK = re.compile(r"[|>][-+0-9]*[ \t]*(?:#.*)?$")
_PREFIX = re.compile(r"(?:[&!]\S*[ \t]*)+")


def _bare(text: str) -> str | None:
    """A scalar without quotes, comment, anchor and tag; None where nothing is left."""
    text = text.strip()
    if text[:1] in "&!":
        text = _PREFIX.sub("", text, count=1)
    if text and text[0] in "\"'":
        quote, at = text[0], 1
        while at < len(text) and not (text[at] == quote and (quote == '"' or text[at + 1 : at + 2] != "'")):
            at += 2 if (text[at] == "\\" and quote == '"') or text[at : at + 2] == "''" else 1
        inner = text[1:at]
        return re.sub(r'\\(["\\/])', r"\1", inner).replace("\\n", "\n") if quote == '"' else inner.replace("''", "'")
    text = re.split(r"(?:^|[ \t])#", text, maxsplit=1)[0].strip()
    return text or None


class _Reader:
    def __init__(self) -> None:
        self.nodes: list[Node] = []
        self.counts: dict[int, int] = {}
        self.open: list[tuple[int, int, bool]] = []  # indent, node, whether it is an item of a sequence

    def add(self, parent: int, key: str | None, value: str | None, line: int, item: bool) -> int:
        at = self.counts.get(parent, 0) if item else None
        if item:
            self.counts[parent] = at + 1
        self.nodes.append([len(self.nodes) + 1, parent, key, at, value, line, line])
        return len(self.nodes)

    def flow(self, text: str, parent: int, line: int) -> None:
        """Entries of a flow collection that stands in one string."""
        depth, begin, quote, parts = 0, 1, "", []
        for at, c in enumerate(text):
            if quote:
                quote = "" if c == quote else quote
            elif c in "\"'":
                quote = c
            elif c in "[{":
                depth += 1
            elif c in "]}":
                depth -= 1
            if not quote and ((c == "," and depth == 1) or (c in "]}" and depth == 0)):
                parts.append(text[begin:at])
                begin = at + 1
                if depth == 0:
                    break
        for part in (p.strip() for p in parts):
            if part:
                found = _KEY.match(part) if text[0] == "{" else None
                key = next((g for g in found.groups()[:3] if g is not None), None) if found else (_bare(part) if text[0] == "{" else None)
                value = (found.group(4) or "").strip() if found else ("" if text[0] == "{" else part)
                node = self.add(parent, key, None if value[:1] in ("[", "{") else _bare(value), line, text[0] == "[")
                if value[:1] in ("[", "{"):
                    self.flow(value, node, line)

    def value(self, node: int, rest: str, line: int) -> str:
        """Gives a node its value; the answer is what has to be read on: 'block', 'flow' or ''."""
        rest = rest.strip()
        plain = _PREFIX.sub("", rest, count=1) if rest[:1] in ("&", "!") else rest
        if _BLOCK.match(plain):
            return "block"
        if plain[:1] in ("[", "{"):
            if _balance(plain) > 0:
                return "flow"
            self.flow(plain, node, line)
        else:
            self.nodes[node - 1][4] = _bare(plain)
        return ""

    def parent(self, indent: int, item: bool) -> int:
        while self.open and (self.open[-1][0] > indent or (self.open[-1][0] == indent and (self.open[-1][2] or not item))):
            self.open.pop()
        return self.open[-1][1] if self.open else 0


def _balance(text: str) -> int:
    text = re.sub(r""""(?:[^"\\]|\\.)*"|'[^']*'""", "", text)
    return sum(text.count(c) for c in "[{") - sum(text.count(c) for c in "]}")


def nodes(text: str) -> Iterator[Node]:
    """All nodes of a text."""
    reader, lines, at = _Reader(), text.split("\n"), 0
    while at < len(lines):
        raw = lines[at].rstrip("\r")
        at += 1
        content = raw.lstrip(" ")
        indent, line = len(raw) - len(content), at
        if not content.strip() or content[0] in "#%" or raw.startswith(("---", "...")):
            if raw.startswith("---"):
                reader.open.clear()
            continue
        node = 0
        while content == "-" or content.startswith("- "):
            node = reader.add(reader.parent(indent, True), None, None, line, True)
            reader.open.append((indent, node, True))
            shorter = content[1:].lstrip(" ")
            indent += len(content) - len(shorter)
            content = shorter
        if content.startswith("#"):
            continue
        found = _KEY.match(content)
        if found:
            key = next(g for g in found.groups()[:3] if g is not None)
            node = reader.add(reader.parent(indent, False), key, None, line, False)
            reader.open.append((indent, node, False))
            rest, base = found.group(4) or "", indent
        elif node:
            rest, base = content, reader.open[-1][0]
        else:  # goes on with the scalar of the line before
            if reader.open and indent > reader.open[-1][0] and reader.nodes[reader.open[-1][1] - 1][4] is not None and (more := _bare(content)):
                reader.nodes[reader.open[-1][1] - 1][4] += " " + more
            continue
        more = reader.value(node, rest, line)
        if more == "block":
            begin = at
            while at < len(lines) and (not lines[at].strip() or len(lines[at]) - len(lines[at].lstrip(" ")) > base):
                at += 1
            block = lines[begin:at]
            least = min((len(x) - len(x.lstrip(" ")) for x in block if x.strip()), default=0)
            reader.nodes[node - 1][4] = "\n".join(x.rstrip("\r")[least:] for x in block)
            reader.nodes[node - 1][6] = begin + 1
        elif more == "flow":
            rest = re.split(r"[ \t]#", rest, maxsplit=1)[0]
            parts, deep = [rest.strip()], _balance(rest)
            while at < len(lines) and deep > 0:
                part = lines[at].strip()
                parts.append(re.split(r"(?:^|[ \t])#", part, maxsplit=1)[0])
                deep += _balance(parts[-1])
                at += 1
            reader.flow(" ".join(parts), node, line)
    yield from reader.nodes
