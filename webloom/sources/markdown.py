"""Markdown of an HTML tree, under the switches of an AuditConfig."""

from __future__ import annotations

import re

from webloom.config import AuditConfig

from .htmltree import Element, selector

#: What is never content, and what is not in main-content mode.
DROPPED = frozenset("script style head iframe noscript svg canvas embed object param form select option".split())
FRAME = frozenset("header footer nav aside".split())
MAIN = ("article", "main", '[role="main"]', "#content", "#main", ".main", ".content")

#: Levels of nesting that are rendered as such; what is nested deeper is text, so that output and work stay in proportion to the page.
DEEPEST = 16
#: Elements whose inner text is made before they are written.
NESTING = frozenset("h1 h2 h3 h4 h5 h6 p li pre blockquote a table".split())

_MAIN_TESTS = tuple(map(selector, MAIN))


def ignored(config: AuditConfig) -> list:
    """Tests for the selectors to leave out; those that can't be read are skipped."""
    found = []
    for part in config.md_ignored_selectors.split(","):
        try:
            found.append(selector(part.strip()))
        except (ValueError, IndexError):
            continue
    return found


def main_content(root: Element) -> Element:
    for test in _MAIN_TESTS:
        for element in root.walk():
            if test(element):
                return element
    return root


def tidy(text: str) -> str:
    """Lines without trailing space; runs of blank lines are one blank line."""
    lines = [line.rstrip() for line in text.split("\n")]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()


def _own(element: Element, tags: tuple[str, ...], other: tuple[str, ...]):
    """The elements of these tags below an element, but none within one another, within a table or within others."""
    todo = [c for c in reversed(element.children) if isinstance(c, Element)]
    while todo:
        e = todo.pop()
        if e.tag in tags:
            yield e
        elif e.tag != "table" and e.tag not in other:
            todo += [c for c in reversed(e.children) if isinstance(c, Element)]


def _run(step):
    """Runs a generator that yields further ones, whose results it is sent: nesting of any depth needs no recursion."""
    stack, value = [step], None
    while stack:
        try:
            stack.append(stack[-1].send(value))
            value = None
        except StopIteration as done:
            stack.pop()
            value = done.value
    return value


class _Writer:
    """Renders nodes into a list of strings; methods that go down are generators for `_run`."""

    def __init__(self, config: AuditConfig, tests: list):
        self.config, self.tests, self.depth = config, tests, 0

    def inner(self, element: Element, level: int, pre: bool):
        out: list[str] = []
        self.depth += 1
        yield self.children(element, out, level, pre)
        self.depth -= 1
        return "".join(out)

    def children(self, element: Element, out: list[str], level: int, pre: bool):
        for child in element.children:
            if isinstance(child, str):
                self.string(child, out, pre)
            else:
                yield self.element(child, out, level, pre)

    @staticmethod
    def string(text: str, out: list[str], pre: bool) -> None:
        if pre:
            out.append(text)
            return
        words = text.split()
        if not words:
            return
        last = next((s[-1] for s in reversed(out) if s), "")
        if text[0].isspace() and last and not last.isspace():
            out.append(" ")
        out.append(" ".join(words))
        if text[-1].isspace():
            out.append(" ")

    def element(self, e: Element, out: list[str], level: int, pre: bool, number: int | None = None):
        tag = e.tag
        if tag in DROPPED or (tag in FRAME and self.config.md_only_main_content) or any(t(e) for t in self.tests):
            return
        block = getattr(self, f"on_{tag}", None)
        if self.depth >= DEEPEST and tag in NESTING:
            edge = [] if tag == "a" else ["\n"]
            out += edge
            yield self.children(e, out, level, pre)
            out += edge
        elif tag == "li":
            mark = "- " if number is None else f"{number}. "
            inner = yield self.inner(e, level, pre)
            out.append("\n" + "  " * min(max(level - 1, 0), DEEPEST) + mark + inner.strip() + "\n")
        elif block:
            yield block(e, out, level, pre)
        else:
            yield self.children(e, out, level, pre)

    def _heading(self, e, out, level, pre):
        inner = yield self.inner(e, level, pre)
        out.append("\n\n" + "#" * int(e.tag[1]) + " " + inner.strip() + "\n\n")

    on_h1 = on_h2 = on_h3 = on_h4 = on_h5 = on_h6 = _heading

    def on_p(self, e, out, level, pre):
        inner = yield self.inner(e, level, pre)
        out.append("\n\n" + inner.strip() + "\n\n")

    def on_br(self, e, out, level, pre):
        out.append("\n")
        yield from ()

    def _wrapped(mark):  # noqa: N805
        def render(self, e, out, level, pre):
            out.append(mark)
            yield self.children(e, out, level, pre)
            out.append(mark)

        return render

    on_strong = on_b = _wrapped("**")
    on_em = on_i = _wrapped("*")

    def on_code(self, e, out, level, pre):
        if pre:
            yield self.children(e, out, level, True)
            return
        out.append("` ")
        yield self.children(e, out, level, pre)
        out.append(" `")

    def on_pre(self, e, out, level, pre):
        inner = yield self.inner(e, level, True)
        out.append("\n\n```\n" + inner + "\n```\n\n")

    def on_blockquote(self, e, out, level, pre):
        inner = yield self.inner(e, level, pre)
        inner = inner.strip()
        out.append("\n\n" + "".join(f"> {line}\n" for line in inner.split("\n") if inner) + "\n")

    def on_ul(self, e, out, level, pre):
        out.append("\n\n")
        yield self.children(e, out, level + 1, pre)
        out.append("\n\n")

    def on_ol(self, e, out, level, pre):
        out.append("\n\n")
        number = 0
        for child in e.children:
            if isinstance(child, Element):
                number += child.tag == "li"
                yield self.element(child, out, level + 1, pre, number if child.tag == "li" else None)
        out.append("\n\n")

    def on_a(self, e, out, level, pre):
        href = e.attrs.get("href", "").strip()
        if href and self.config.md_keep_links:
            inner = yield self.inner(e, level, pre)
            out.append(f"[{inner.strip()}]({href})")
        else:
            yield self.children(e, out, level, pre)

    def on_img(self, e, out, level, pre):
        src = e.attrs.get("src", "").strip()
        if src and not self.config.md_ignore_images:
            out.append(f" ![{e.attrs.get('alt', '').strip()}]({src}) ")
        yield from ()

    def on_table(self, e, out, level, pre):
        """A table's own rows: those of a table in a cell are that cell's text."""
        rows = []
        for row in _own(e, ("tr",), ("td", "th")):
            cells = []
            for c in _own(row, ("td", "th"), ("tr",)):
                inner = yield self.inner(c, level, pre)
                cells.append(inner.strip().replace("\n", " ").replace("|", "\\|"))
            if cells:
                rows.append(cells)
        lines = ["| " + " | ".join(cells) + " |\n" for cells in rows]
        if rows:
            lines.insert(1, "|" + " --- |" * len(rows[0]) + "\n")
        out.append("\n\n" + "".join(lines) + "\n\n")


def to_markdown(root: Element, config: AuditConfig, tests: list | None = None) -> str:
    start = main_content(root) if config.md_only_main_content else root
    out: list[str] = []
    _run(_Writer(config, ignored(config) if tests is None else tests).element(start, out, 0, False))
    text = "".join(out)
    return tidy(text) if config.md_clean_whitespace else text.strip()
