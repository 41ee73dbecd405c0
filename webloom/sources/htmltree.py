"""A small HTML tree over the standard library's tokenizer, and a CSS matcher.

Follows browsers where pages need it: void elements, raw text, implied end tags, an implied html, head and body,
formatting elements that are reopened after the block that closed them (the last three of those that are alike, so that
unclosed ones do not add up), and closing at the end of the document.
Elements inside a table that do not belong there stay where they are written (no foster parenting).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
HEAD_ONLY = frozenset("base basefont bgsound link meta noframes script style template title".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr main menu nav ol p pre section summary table ul".split()
)
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: An opening tag closes an open one of these, up to the nearest of the scope.
IMPLIED = {
    "li": (("li",), ("ul", "ol")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "option": (("option",), ("select",)), "optgroup": (("option", "optgroup"), ("select",)),
    "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "tbody": (("tr", "td", "th", "tbody", "thead", "tfoot"), ("table",)), "thead": (("tbody", "thead", "tfoot"), ("table",)), "tfoot": (("tr", "td", "th", "tbody", "thead", "tfoot"), ("table",)),
}
SCOPE = frozenset("html table td th caption button marquee object template".split())
#: Formatting elements outside of one of these are not counted inside of it.
MARKERS = ("td", "th", "caption", "marquee", "object", "template", "applet")
#: Of open formatting elements with the same tag and attributes, how many are reopened.
ALIKE = 3


class Element:
    __slots__ = ("tag", "attrs", "children", "parent", "alike")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Element | None):
        self.tag, self.attrs, self.children, self.parent = tag, attrs, [], parent
        # While open: the formatting elements like this one that are to be reopened; None if this one is not.
        self.alike: list[Element] | None = None

    def walk(self) -> Iterator[Element]:
        """This element and all below it, in document order."""
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(c for c in reversed(node.children) if isinstance(c, Element))

    def strings(self) -> Iterator[str]:
        stack: list = [self]
        while stack:
            node = stack.pop()
            if isinstance(node, str):
                yield node
            else:
                stack.extend(reversed(node.children))

    def text(self) -> str:
        return "".join(self.strings())


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Element("html", {}, None)
        self.open = [self.root]
        # How many elements of each tag are open, so that deep pages are not searched for tags that are not.
        self.counts: Counter[str] = Counter()
        self.head: Element | None = None
        self.body: Element | None = None
        self.reopen: list[tuple[str, dict]] = []
        self.formats: dict[tuple, list[Element]] = {}

    # Where nodes go.

    def _push(self, tag: str, attrs: dict[str, str]) -> Element:
        node = Element(tag, attrs, self.open[-1])
        self.open[-1].children.append(node)
        self._enter(node)
        return node

    def _enter(self, node: Element) -> None:
        self.open.append(node)
        self.counts[node.tag] += 1
        if node.tag in FORMATTING:
            inside = sum(self.counts[m] for m in MARKERS)
            node.alike = self.formats.setdefault((node.tag, tuple(sorted(node.attrs.items())), inside), [])
            node.alike.append(node)
            if len(node.alike) > ALIKE:
                node.alike.pop(0).alike = None

    def _leave(self, at: int) -> None:
        """Takes all open elements from this place on from the stack."""
        for e in self.open[at:]:
            self.counts[e.tag] -= 1
            if e.alike is not None:
                e.alike.remove(e)
                e.alike = None
        del self.open[at:]

    def _in_body(self) -> None:
        if self.body is None:
            self._leave(1)
            self.body = self._push("body", {})

    def _place(self, tag: str) -> None:
        """Makes sure that an element of this tag may stand where it comes."""
        if self.body is None:
            if tag in HEAD_ONLY:
                if self.head is None:
                    self.head = self._push("head", {})
                elif len(self.open) == 1:
                    self._enter(self.head)
            else:
                self._in_body()

    def _restore(self) -> None:
        again, self.reopen = self.reopen, []
        for tag, attrs in again:
            self._push(tag, dict(attrs))

    def _close(self, at: int) -> None:
        """Closes the open element at this place and all inside; formatting ones are reopened later."""
        inner = [(e.tag, e.attrs) for e in self.open[at + 1 :] if e.alike is not None]
        self._leave(at)
        self.reopen = inner + self.reopen

    def _find(self, tags, stops) -> int:
        if not any(self.counts[t] for t in tags):
            return 0
        for at in range(len(self.open) - 1, 0, -1):
            if self.open[at].tag in tags:
                return at
            if self.open[at].tag in stops:
                break
        return 0

    # What the tokenizer tells.

    def handle_starttag(self, tag, attrs):
        own: dict[str, str] = {}
        for k, v in attrs:
            own.setdefault(k, v or "")
        if tag in ("html", "head", "body"):
            if tag == "html":
                for k, v in own.items():
                    self.root.attrs.setdefault(k, v)
            elif tag == "head":
                if self.head is None and self.body is None:
                    self.head = self._push("head", own)
            elif self.body is None:
                self._in_body()
                self.body.attrs.update(own)
            else:
                for k, v in own.items():
                    self.body.attrs.setdefault(k, v)
            return
        self._place(tag)
        if tag in CLOSES_P and (at := self._find(("p",), SCOPE)):
            self._close(at)
        if tag in HEADINGS and self.open[-1].tag in HEADINGS:
            self._close(len(self.open) - 1)
        if tag in IMPLIED:
            closed, stops = IMPLIED[tag]
            while at := self._find(closed, stops):
                self._close(at)
                if tag not in ("tr", "tbody", "thead", "tfoot"):
                    break
            if tag in ("td", "th", "tr", "tbody", "thead", "tfoot"):
                self.reopen = []
        if tag == "a" and (at := self._find(("a",), SCOPE)):
            self._close(at)
            self.reopen = [x for x in self.reopen if x[0] != "a"]
        if self.body is not None and tag not in CLOSES_P and tag not in IMPLIED and tag not in HEAD_ONLY:
            self._restore()
        node = self._push(tag, own)
        if tag in VOID:
            self._leave(len(self.open) - 1)
        elif tag == "plaintext":
            self.set_cdata_mode(tag)
        return node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag in ("html", "body"):
            return
        if tag == "head":
            if self.head is not None and self.body is None:
                self._leave(1)
            return
        if tag == "br":
            self.handle_starttag("br", [])
            return
        if tag == "p" and not self._find(("p",), SCOPE):
            self.handle_starttag("p", [])
            self._leave(len(self.open) - 1)
            return
        if tag in HEADINGS:
            at = self._find(HEADINGS, SCOPE)
        else:
            at = self._find((tag,), () if tag in ("table", "td", "th", "tr", "tbody", "thead", "tfoot") else SCOPE - {tag})
        if at:
            self._close(at)
        elif tag in FORMATTING:
            for k in range(len(self.reopen) - 1, -1, -1):
                if self.reopen[k][0] == tag:
                    del self.reopen[k]
                    break

    def handle_data(self, data):
        current = self.open[-1]
        if self.body is None and current.tag not in HEAD_ONLY:
            data = data.lstrip(" \t\n\r\f")
            if not data:
                return
            self._in_body()
        if self.body is not None and data.strip():
            self._restore()
        children = self.open[-1].children
        if children and isinstance(children[-1], str):
            children[-1] += data
        else:
            children.append(data)


def parse(html: str) -> Element:
    """The root element; pieces that no parser accepts are left out."""
    builder = _Builder()
    builder.feed(html.replace("\x00", "�").replace("\r\n", "\n").replace("\r", "\n"))
    builder.close()
    if builder.body is None:
        builder._in_body()
    if builder.head is None:
        builder.root.children.insert(0, Element("head", {}, builder.root))
    return builder.root


# Selectors.

_SIMPLE = re.compile(
    r"(?P<tag>\*|[A-Za-z][\w-]*)|#(?P<id>[\w-]+)|\.(?P<cls>[\w-]+)"
    r"|\[\s*(?P<attr>[\w:-]+)\s*(?:(?P<op>[~|^$*]?=)\s*(?P<val>\"[^\"]*\"|'[^']*'|[^\s\]]+)\s*(?P<flag>[iI])?\s*)?\]"
)
#: Attributes whose values HTML compares without case.
_FOLDED = frozenset(("rel", "type", "lang", "dir", "media", "method", "shape", "http-equiv"))


def _compound(text: str):
    tests, at = [], 0
    while at < len(text):
        m = _SIMPLE.match(text, at)
        if not m or (m["tag"] and at):
            raise ValueError(f"not a selector: {text!r}")
        if m["tag"]:
            name = m["tag"].lower()
            if name != "*":
                tests.append(lambda e, name=name: e.tag == name)
        elif m["id"]:
            tests.append(lambda e, v=m["id"]: e.attrs.get("id") == v)
        elif m["cls"]:
            tests.append(lambda e, v=m["cls"]: v in e.attrs.get("class", "").split())
        else:
            tests.append(_attribute(m["attr"].lower(), m["op"], m["val"], bool(m["flag"])))
        at = m.end()
    if not text:
        raise ValueError("an empty selector")
    return lambda e: all(t(e) for t in tests)


def _attribute(name: str, op: str | None, value: str | None, folded: bool):
    if op is None:
        return lambda e: name in e.attrs
    if value[0] in "\"'":
        value = value[1:-1]
    fold = str.lower if folded or name in _FOLDED else str
    value = fold(value)
    how = {
        "=": lambda v: v == value,
        "~=": lambda v: bool(value) and value in v.split(),
        "|=": lambda v: v == value or v.startswith(value + "-"),
        "^=": lambda v: bool(value) and v.startswith(value),
        "$=": lambda v: bool(value) and v.endswith(value),
        "*=": lambda v: bool(value) and value in v,
    }[op]
    return lambda e: name in e.attrs and how(fold(e.attrs[name]))


def _complex(text: str):
    parts = re.findall(r"\s*>\s*|\s+|(?:\[[^\]]*\]|[^\s>\[])+", text.strip())
    chain = [(None, _compound(parts[0]))]
    for k in range(1, len(parts) - 1, 2):
        chain.append(("child" if ">" in parts[k] else "descendant", _compound(parts[k + 1])))
    if len(parts) % 2 == 0:
        raise ValueError(f"not a selector: {text!r}")

    def matches(element: Element, k: int = len(chain) - 1) -> bool:
        how, test = chain[k]
        if not test(element):
            return False
        if how is None:
            return True
        up = element.parent
        while up is not None:
            if matches(up, k - 1):
                return True
            if how == "child":
                return False
            up = up.parent
        return False

    return matches


def selector(text: str):
    """A test of elements; commas mean any of. ValueError where it is not understood."""
    any_of = [_complex(part) for part in text.split(",")]
    return lambda element: any(m(element) for m in any_of)
