"""What a document says about itself: labelled fields, its title and its organization."""

from __future__ import annotations

import re
from itertools import pairwise
from typing import NamedTuple

# Labels and the fields that they name, other labels, labels that stand before a date, and patterns of names.
LABELS = {
    "title": "title", "policy name": "title", "policy title": "title", "revision": "version", "version": "version", "effective date": "effective_date", "effective": "effective_date",
    "revision date": "revision_date", "last updated": "revision_date", "last revised": "revision_date", "revised": "revision_date", "issued on": "issued_date", "publication date": "issued_date",
}
OTHER_LABELS = frozenset(["adopted", "approval date", "reviewed", "responsible office", "responsible official", "responsible executive", "procedure owner", "applies to", "campus applicability", "authority", "approval", "university standard", "formerly known as policy number", "document purpose"])
BEFORE_DATES = ("issued on", "last updated", "effective date", "revision date", "last revised")
DATE_START = re.compile(r"\d|jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec", re.I)
PLACEHOLDER = re.compile(r"(?i)(\bXX\b|^untitled|^microsoft word\s*-|^document\d*$|\.(docx?|pdf|pptx?|xlsx?)$)")
INSTITUTION = re.compile(r"\b(University|College|Institute)\b")
SEPARATOR = re.compile(r"\s+(?:\||@|-)\s+")
INLINE_CHARS, NEXT_CHARS, TITLE_SHARE = 120, 80, 0.6


class Said(NamedTuple):
    """A block of the first pages, as far as it is looked at."""

    page: int
    kind: str
    text: str
    size: float = 0.0
    rows: tuple[tuple[str | None, ...], ...] | None = None


class Field(NamedTuple):
    label: str
    value: str
    page: int

    @property
    def name(self) -> str | None:
        """The field that the label names."""
        return LABELS.get(_plain(self.label).rstrip(":").strip())


def _plain(text: str) -> str:
    return " ".join(text.split()).lower()


def is_label(text: str) -> bool:
    key = _plain(text).rstrip(":").strip()
    return key in LABELS or key in OTHER_LABELS


def labelled_fields(blocks: list[Said], most_page: int = 2) -> list[Field]:
    """Rows of tables whose first cell is a label; "Label: value"; a label that stands before a date; a label by itself
    and the next block of its page."""
    out = []
    near = [b for b in blocks if b.page <= most_page]
    for b, after in pairwise([*near, None]):
        if b.kind == "table":
            cells = [[c for c in r if c] for r in b.rows or ()]
            out += [Field(c[0].strip().rstrip(":"), c[1], b.page) for c in cells if len(c) > 1 and is_label(c[0])]
            continue
        label, colon, value = b.text.partition(":")
        dated = next((p for p in BEFORE_DATES if b.text.lower().startswith(f"{p} ") and DATE_START.match(b.text[len(p) :].strip())), None)
        if colon and is_label(label) and value.strip() and len(value) <= INLINE_CHARS:
            out.append(Field(label.strip(), value.strip(), b.page))
        elif dated:
            out.append(Field(b.text[: len(dated)], b.text[len(dated) :].strip(), b.page))
        elif is_label(b.text) and after is not None and after.page == b.page and after.kind != "table" and len(after.text) <= NEXT_CHARS and not is_label(after.text):
            out.append(Field(b.text, after.text, b.page))
    return out


def largest_heading(blocks: list[Said]) -> str | None:
    """The first headings of the largest size on the first page, one after the other."""
    titles = [b for b in blocks if b.page == blocks[0].page and b.kind == "heading"] if blocks else []
    if not titles:
        return None
    top = max(b.size for b in titles)
    first = next(i for i, b in enumerate(titles) if b.size == top)
    stop = next((i for i in range(first, len(titles)) if titles[i].size != top), len(titles))
    return " ".join(b.text for b in titles[first:stop])


def title_of(blocks: list[Said], tab_title: str | None = None, pdf_title: str | None = None, web_print: bool = False) -> tuple[str, str] | None:
    """(title, source): a label's, else the first part of a browser's title (as the heading that it begins with is
    written), else the title in the file, else the largest heading. Placeholders are no titles."""
    labelled = next((f.value for f in labelled_fields(blocks) if f.name == "title"), None)
    if labelled:
        return labelled, "document_text"
    pdf_title = None if pdf_title and PLACEHOLDER.search(pdf_title) else pdf_title
    web = tab_title or (pdf_title if web_print else None)
    if web:
        part = SEPARATOR.split(web)[0].strip()
        same = (b.text for b in blocks if b.page == blocks[0].page and b.kind == "heading" and _plain(part).startswith(_plain(b.text)) and len(_plain(b.text)) >= TITLE_SHARE * len(_plain(part)))
        return next(same, part), "browser_title"
    if pdf_title:
        return pdf_title, "pdf_metadata"
    found = largest_heading(blocks)
    return (found, "document_text") if found else None


def organization_of(*titles: str | None) -> str | None:
    """The last part of a title that names an institution, after the first part."""
    parts = (p.strip() for t in titles if t for p in reversed(SEPARATOR.split(t)[1:]))
    return next((p for p in parts if INSTITUTION.search(p)), None)
