"""Page snapshots to rows: a small tree parser inside ``mapInPandas``.

Python only reads the markup. Which candidate is used, how lines are filtered and how
values are typed is decided by Spark columns in :mod:`storyspark.sources.pages`.
"""

from __future__ import annotations

import json
import re
import unicodedata
from difflib import SequenceMatcher
from functools import lru_cache
from html.parser import HTMLParser

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_BLOCK = frozenset("p div li ul ol h1 h2 h3 h4 h5 h6 section article main header footer nav aside blockquote tr table".split())
_SKIP = frozenset(("script", "style", "noscript", "iframe"))


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag, attrs=None, parent=None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs or {}, parent, []

    def walk(self):
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(c for c in reversed(node.children) if isinstance(c, Node))

    def strings(self, skip=lambda node: False):
        stack = [self]
        while stack:
            item = stack.pop()
            if isinstance(item, str):
                yield item
            elif item.tag not in _SKIP and not (item is not self and skip(item)):
                stack.extend(reversed(item.children))

    def text(self, skip=lambda node: False):
        return clean(" ".join(self.strings(skip)))


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.top = Node("#root")

    def handle_starttag(self, tag, attrs):
        if tag in _BLOCK:  # an open paragraph ends where a block starts
            node = self.top
            while node.parent is not None and node.tag not in ("div", "article", "section", "main", "body", "li", "td"):
                if node.tag == "p":
                    self.top = node.parent
                    break
                node = node.parent
        node = Node(tag, {k: v or "" for k, v in attrs}, self.top)
        self.top.children.append(node)
        if tag not in _VOID:
            self.top = node

    def handle_endtag(self, tag):
        node = self.top
        while node.parent is not None and node.tag != tag:
            node = node.parent
        if node.parent is not None:
            self.top = node.parent

    def handle_data(self, data):
        self.top.children.append(data)


def parse(markup: str) -> Node:
    builder = _Builder()
    builder.feed(markup or "")
    builder.close()
    return builder.root


def clean(text: str) -> str:
    return " ".join((text or "").replace("\xad", "").replace("​", "").replace("﻿", "").split())


_STEP = re.compile(r"([a-zA-Z0-9]*)((?:\.[\w-]+|\[[^\]]+\])*)")
_PART = re.compile(r"\.([\w-]+)|\[([\w:-]+)(?:=['\"]?([^'\"\]]*)['\"]?)?\]")


@lru_cache(maxsize=256)
def _compile(selector: str):
    """``tag.class[attr='x']`` steps joined by blanks, alternatives by commas."""
    groups = []
    for alternative in selector.split(","):
        steps = []
        for step in alternative.split():
            tag, rest = _STEP.fullmatch(step).groups()
            steps.append((tag.lower(), _PART.findall(rest)))
        groups.append(steps)
    return groups


def _fits(node: Node, step) -> bool:
    tag, parts = step
    if tag and node.tag != tag:
        return False
    for cls, attr, value in parts:
        if cls and cls not in node.attrs.get("class", "").split():
            return False
        if attr and (attr not in node.attrs or (value and node.attrs[attr] != value)):
            return False
    return not node.tag.startswith("#")


def matches(node: Node, compiled) -> bool:
    for steps in compiled:
        if _fits(node, steps[-1]):
            up, left = node.parent, len(steps) - 2
            while left >= 0 and up is not None:
                if _fits(up, steps[left]):
                    left -= 1
                up = up.parent
            if left < 0:
                return True
    return False


def select(root: Node, selector: str) -> list[Node]:
    compiled = _compile(selector)
    return [n for n in root.walk() if n is not root and matches(n, compiled)]


def fold(text: str) -> str:
    marks = unicodedata.normalize("NFD", (text or "").lower())
    plain = "".join(c for c in marks if unicodedata.category(c) != "Mn")
    return " ".join(re.sub(r"[^\w\s]", " ", plain).split())


def anchor(lines: list[str], title: str) -> int:
    """Index of the line that shows the title, -1 if none does."""
    wanted = fold(title)
    if not wanted:
        return -1
    matcher = SequenceMatcher(None)
    for i, line in enumerate(lines):
        seen = fold(line)
        if not seen:
            continue
        if wanted in seen or seen in wanted:
            return i
        matcher.set_seqs(wanted, seen)
        if matcher.real_quick_ratio() >= 0.72 and matcher.quick_ratio() >= 0.72 and matcher.ratio() >= 0.72:
            return i
    return -1


def json_ld(root: Node) -> list[dict]:
    """All JSON-LD objects, those inside ``@graph`` included."""
    found = []
    for script in select(root, "script[type='application/ld+json']"):
        try:
            data = json.loads("".join(c for c in script.children if isinstance(c, str)))
        except ValueError:
            continue
        todo = [data]
        while todo:
            item = todo.pop(0)
            if isinstance(item, list):
                todo = item + todo
            elif isinstance(item, dict):
                found.append(item)
                if isinstance(item.get("@graph"), list):
                    todo = item["@graph"] + todo
    return found
