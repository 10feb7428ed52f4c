"""Named sections of HTML papers, by three strategies in turn, with the standard library's parser in Arrow batches.

A page becomes one table of its elements in document order.  An element knows its name, its parent, where its own elements end in
the table, and which stretch of the page's text it spans, so that every question about what lies inside or after it is one about
intervals.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What section headings say, the headings that end a section of plain text, sizes, and the message.
PATTERNS = {"introduction": ("introduction", "intro"), "methodology": ("methodology", "method", "approach"), "conclusion": ("conclusion", "conclusions")}
MAJOR = ("Introduction", "Methodology", "Method", "Approach", "Results", "Discussion", "Conclusion", "References", "Related Work", "Background", "Experiments", "Evaluation", "Implementation")
MOST_PARAGRAPHS, MOST_CHARS, LEAST_PARAGRAPH, LEAST_SECTION = 50, 10_000, 20, 50
NOT_FOUND = "Section not found (searched for: {})"
LEVELS = ("h1", "h2", "h3", "h4", "h5", "h6")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_NUMBER = re.compile(r"\d+\.?\s*")


class Page(HTMLParser):
    """Elements by number: ``name``, ``parent``, ``end`` (the number after the last element inside), ``span`` of ``text``.

    An end tag closes up to its start; one without a start is ignored.  ``title`` is the number of the first <h1> or <title>,
    ``title_source`` what the page has between its tags, with references as they are written.
    """

    def __init__(self, page: str) -> None:
        super().__init__(convert_charrefs=True)
        self.name, self.parent, self.end, self.span = [""], [-1], [0], [[0, 0]]
        self._open, self._parts, self._size = [0], [], 0
        self.title, self.title_source, self._page, self._title_at = None, None, page, 0
        self.feed(page)
        self.close()
        while self._open:
            self._shut()
        self.text = "".join(self._parts)

    def _shut(self) -> None:
        k = self._open.pop()
        self.end[k], self.span[k][1] = len(self.name), self._size
        if k == self.title:
            self.title_source = self._page[self._title_at : self._place()]

    def _place(self) -> int:
        """Where in the page the parser stands."""
        line, column = self.getpos()
        return sum(len(x) + 1 for x in self._page.split("\n", line - 1)[: line - 1]) + column

    def handle_starttag(self, tag, attrs) -> None:
        k = len(self.name)
        self.name.append(tag)
        self.parent.append(self._open[-1])
        self.end.append(k + 1)
        self.span.append([self._size, self._size])
        if tag in ("h1", "title") and self.title is None:
            self.title, self._title_at = k, self._place() + len(self.get_starttag_text())
        if tag not in VOID:
            self._open.append(k)

    def handle_endtag(self, tag) -> None:
        if tag in (self.name[k] for k in self._open[1:]):
            while self.name[self._open[-1]] != tag:
                self._shut()
            self._shut()

    def handle_data(self, data) -> None:
        self._parts.append(data)
        self._size += len(data)

    def read(self, k: int) -> str:
        """The text inside an element, white space collapsed."""
        a, b = self.span[k]
        return " ".join(self.text[a:b].split())

    def heading_within(self, k: int) -> int | None:
        """The first heading that is an element or lies inside it."""
        return next((j for j in range(k, self.end[k]) if self.name[j] in LEVELS), None)

    def says(self, heading: int, patterns: tuple[str, ...]) -> bool:
        told = _NUMBER.sub("", self.read(heading), count=1) if _NUMBER.match(self.read(heading)) else self.read(heading)
        return any(p in told.lower() for p in patterns)


def _joined(paragraphs: Iterator[str]) -> str | None:
    kept = [p for p in paragraphs if len(p) > LEAST_PARAGRAPH][:MOST_PARAGRAPHS]
    return "\n\n".join(kept) or None


def in_section_elements(page: Page, patterns: tuple[str, ...]) -> Iterator[str | None]:
    """Paragraphs of <section> elements whose first heading says it; captions and notes are no paragraphs."""
    for k, name in enumerate(page.name):
        if name == "section" and (h := page.heading_within(k)) is not None and page.says(h, patterns):
            bodies = (j for j in range(k, page.end[k]) if page.name[j] in ("p", "div") and page.heading_within(j) is None)
            yield _joined(t for t in map(page.read, bodies) if not t.startswith(("[", "Figure")))


def in_lines(page: Page, patterns: tuple[str, ...]) -> Iterator[str | None]:
    """Lines of the page's text from one that is the heading, preferably a numbered one, to the next major heading.

    The number may stand on a line of its own before the title.
    """
    lines = [line.strip() for line in page.text.split("\n")]
    titles: list[tuple[str, bool, int, int]] = []  # title, whether it is numbered, its line, the line where it begins
    before = None
    for k, line in enumerate(lines):
        if not line:
            continue
        bare = _NUMBER.fullmatch(line)
        own = _NUMBER.match(line)
        number = own is not None and not bare
        titles.append((line[own.end() :].lower() if number else line.lower(), number or before is not None, k, k if number or before is None else before))
        before = k if bare else None
    major = {m.lower() for m in MAJOR}
    for p in patterns:
        found = sorted((not numbered, at) for title, numbered, at, _ in titles if title == p)
        if found:
            start = found[0][1]
            stop = next((first for title, _, at, first in titles if at > start and title in major), len(lines))
            body = "\n".join(page.text.split("\n")[start + 1 : stop]).strip()
            body = re.sub(r"[ \t]+", " ", re.sub(r"\n\s*\n\s*\n+", "\n\n", body))
            yield body[:MOST_CHARS] if len(body) > LEAST_SECTION else None


def after_headings(page: Page, patterns: tuple[str, ...]) -> Iterator[str | None]:
    """Paragraphs beside a heading that says it, up to the next heading that is no deeper; higher headings are tried first."""
    for rank, tag in enumerate(LEVELS):
        for k, name in enumerate(page.name):
            if name != tag or not page.says(k, patterns):
                continue
            beside, j, last = [], page.end[k], page.end[page.parent[k]]
            while j < last and page.name[j] not in LEVELS[: rank + 1]:
                beside.append(j)
                j = page.end[j]
            yield _joined(page.read(j) for j in beside if page.name[j] == "p")


def section(page: Page, patterns: tuple[str, ...]) -> str:
    tried = (found for strategy in (in_section_elements, in_lines, after_headings) for found in strategy(page, patterns))
    return next((found for found in tried if found), NOT_FOUND.format(", ".join(patterns)))


def sections(pages: DataFrame, key: str = "page_id", page: str = "html") -> DataFrame:
    """(key, title, title_source, introduction, methodology, conclusion) of every page; a null page has nulls.

    The title's references are decoded as browsers do it; ``title_source`` is the title as the page writes it.
    """
    names = ("title", "title_source", *PATTERNS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = {name: [] for name in names}
            for body in batch.column("html").to_pylist():
                one = Page(body) if body is not None else None
                rows["title"].append(one.read(one.title) if one and one.title is not None else None)
                rows["title_source"].append(one.title_source if one else None)
                for name, patterns in PATTERNS.items():
                    rows[name].append(section(one, patterns) if one else None)
            yield pa.RecordBatch.from_arrays([batch.column("k"), *(pa.array(v, pa.string()) for v in rows.values())], ["k", *rows])

    p = pages.select(F.col(key).alias("k"), F.col(page).alias("html"))
    out = p.mapInArrow(run, f"k {p.schema['k'].dataType.simpleString()}, " + ", ".join(f"{n} string" for n in names))
    return out.withColumnRenamed("k", key)
