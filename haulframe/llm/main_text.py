"""Main text of HTML pages by tag-path ratios.

Per page, the text runs (blocks) are summed per root-to-leaf tag path:
characters outside links and punctuation marks, per block.  Both ratios of a
path are smoothed towards those of the path's parent, so that short
paragraphs lean on their surroundings, then fused into one score, their
product.  A path is content when its score reaches ``strictness`` standard
deviations of the page's scores; all blocks of a content path are content,
short ones too.

Markup decides where it speaks for itself.  Menus, headers, footers, asides,
forms, scripts, and elements whose role, class or id names such a thing, an
advert, a notice or comments, take no part.  Where a page declares its
article, the blocks of the article are content, but for paths that are
mostly links.  Elsewhere, headings, list items and other paragraph-like
blocks next to content belong to it.

Each page is read by itself in one pass over the table, so nothing is
shuffled, and a lost task is simply read again.

Defined results: a null or empty page, or one without text, gives an empty
text; null ids and urls are passed on; repeated rows are extracted once
each; very long pages are read whole, in time linear in their length; an
empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulframe.llm.page_blocks import HEADINGS, PARAGRAPHS, Page, attributes_of, is_main, read, words_of

#: Elements that never hold main text.
ASIDE_TAGS = frozenset("head script style template noscript svg canvas object iframe nav footer aside button select option textarea "
                       "dialog menu title search audio video map".split())
#: Elements that hold none unless they hold the article.
OUTER_TAGS = frozenset(("form", "header"))
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar toolbar alert alertdialog dialog status".split())
#: Words of class names and ids.
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb "
    "breadcrumbs sidebar footer header masthead topbar toolbar cookie cookies consent gdpr notice notices alert popup modal overlay newsletter "
    "subscribe signup login share sharing social comment comments disqus reply replies respond related recommended pagination pager "
    "widget copyright skip search form".split())
#: The only such words that an article may be called by and yet be none.
NO_ARTICLE = frozenset("ad ads advert advertisement sponsored promo comment comments reply replies teaser related".split())
PUNCTUATION = re.compile("[.,;:!?…。，、；：！？]")
KEEP, DROP, HEADINGS_ONLY = 0, 1, 2


@dataclass(slots=True)
class Paths:
    """Tag paths as a tree; sums over a path's own blocks."""

    parent: list[int] = field(default_factory=lambda: [-1])
    number: dict[tuple[int, str], int] = field(default_factory=dict)
    sums: list[list[int]] = field(default_factory=lambda: [[0, 0, 0, 0]])  # blocks, characters outside links, in links, punctuation

    def child(self, parent: int, label: str) -> int:
        key = (parent, label)
        if key not in self.number:
            self.number[key] = len(self.parent)
            self.parent.append(parent)
            self.sums.append([0, 0, 0, 0])
        return self.number[key]

    def scores(self, weight: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
        """The fused, smoothed score of each path, and its blocks."""
        own = np.array(self.sums, dtype=float)
        below = own.copy()
        for p in range(len(own) - 1, 0, -1):
            below[self.parent[p]] += below[p]
        length, marks = np.empty(len(own)), np.empty(len(own))
        for p, up in enumerate(self.parent):
            n, chars, _, punctuation = below[p]
            if up < 0:
                length[p], marks[p] = chars / max(n, 1), punctuation / max(n, 1)
            else:
                length[p] = (chars + weight * length[up]) / (n + weight)
                marks[p] = (punctuation + weight * marks[up]) / (n + weight)
        return length * (marks + 0.1), own[:, 0]


def standing(page: Page) -> list[int]:
    """Whether the text of each element is kept, dropped, or kept in headings only (the header of an article)."""
    out = []
    for i, e in enumerate(page.elements):
        before = out[e.parent] if i else KEEP
        if before == DROP or e.name in ASIDE_TAGS:
            out.append(DROP)
            continue
        state = KEEP if before == HEADINGS_ONLY and e.name in HEADINGS else before
        if e.name == "header" and not e.holds_article:
            state = HEADINGS_ONLY if e.in_article else DROP
        elif e.name in OUTER_TAGS and not e.holds_article:
            state = DROP
        elif e.attributes and e.name not in ("html", "body"):
            state = max(state, _named(e), key=(KEEP, HEADINGS_ONLY, DROP).index)
        out.append(state)
    return out


def _named(e) -> int:
    """What an element's attributes say of it."""
    a = attributes_of(e.attributes)
    if "hidden" in a or "display:none" in a.get("style", "").lower().replace(" ", ""):
        return DROP
    if e.holds_article:
        return KEEP
    names = (a.get("class", ""), a.get("id", ""))
    if e.name in ("article", "main") or is_main(a):
        return DROP if any(set(words_of(name)[:1]) & NO_ARTICLE for value in names for name in value.split()) else KEEP
    if a.get("role", "").lower() in ASIDE_ROLES:
        return DROP
    found = ASIDE_WORDS.intersection(words_of(*names))
    if found == {"header"} and e.in_article:
        return HEADINGS_ONLY
    return DROP if found and e.name not in HEADINGS else KEEP


def main_blocks(source: str, strictness: float = 0.5) -> list[tuple[str, str]]:
    """(tag path, text) of the content blocks of one page, in page order."""
    page = read(source)
    state = standing(page)
    elements = page.elements
    paths = Paths()
    of_element = [0] * len(elements)
    for i, e in enumerate(elements[1:], 1):
        of_element[i] = paths.child(of_element[e.parent], _label(e)) if e.name in _PATH_TAGS else of_element[e.parent]

    blocks = []  # element, path, text
    for at, pieces in page.blocks:
        kept = [(e, t) for e, t in pieces if state[e] == KEEP]
        text = " ".join("".join(t for _, t in kept).split())
        if text:
            links = sum(len(" ".join(t.split())) for e, t in kept if elements[e].link)
            path = of_element[at]
            sums = paths.sums[path]
            sums[0] += 1
            sums[1] += max(len(text) - links, 0)
            sums[2] += links
            sums[3] += len(PUNCTUATION.findall(text))
            blocks.append((at, path, text))
    if not blocks:
        return []
    scores, counts = paths.scores()
    mean = np.average(scores, weights=counts)
    least = strictness * np.sqrt(np.average((scores - mean) ** 2, weights=counts))
    content = scores >= least
    linked = np.array([s[2] > 1.5 * s[1] and s[3] < 0.5 * s[0] for s in paths.sums])

    declared = _declared(page, state, blocks, content)
    if declared is not None:
        chosen = [b for b in blocks if declared[b[0]] and not linked[b[1]]]
    else:
        near = {_surrounding(elements, at) for at, path, _ in blocks if content[path] and not linked[path]}
        over = _above(elements, near)
        chosen, before = [], None
        for block in blocks:
            at, path, _ = block
            if linked[path]:
                continue
            around = _surrounding(elements, at)
            if content[path] or elements[at].name in PARAGRAPHS and around in near or elements[at].name in HEADINGS and around in over:
                if not chosen and before:  # the headline right above
                    chosen.append(before)
                chosen.append(block)
            else:
                before = block if elements[at].name in HEADINGS else None
    names = _spelled(paths)
    return [(names[path], text) for _, path, text in chosen]


_PATH_TAGS = PARAGRAPHS | frozenset("html body div section article main header figure details center ul ol dl table fieldset form".split())
_INNER = PARAGRAPHS | frozenset("ul ol dl table thead tbody tfoot tr figure details hgroup".split())


def _label(e) -> str:
    """The step of a path: the tag, with its first class name if it has any."""
    if "class" in e.attributes and (names := attributes_of(e.attributes).get("class", "").split()):
        return e.name + "." + "".join("0" if c.isdigit() else c for c in names[0])
    return e.name


def _spelled(paths: Paths) -> dict[int, str]:
    names = {0: ""}
    for (parent, label), number in paths.number.items():
        names[number] = f"{names[parent]}/{label}" if len(names[parent]) < 2000 else names[parent]
    return names


def _surrounding(elements: list, at: int) -> int:
    """The nearest element around a block that is no paragraph, list or table."""
    at = elements[at].parent if elements[at].name in _INNER else at
    while at > 0 and elements[at].name in _INNER:
        at = elements[at].parent
    return at


def _above(elements: list, near: set[int]) -> set[int]:
    """The elements of the body that hold one of ``near``."""
    out: set[int] = set()
    for at in near:
        at = elements[at].parent
        while at > 0 and elements[at].name not in ("html", "body") and at not in out:
            out.add(at)
            at = elements[at].parent
    return out


def _declared(page: Page, state: list[int], blocks: list, content: np.ndarray) -> list[bool] | None:
    """Per element, whether it lies in the declared article; None where there is none with text."""
    for kinds in (lambda e: e.name == "article", lambda e: e.name == "main" or is_main(attributes_of(e.attributes))):
        of = [-1] * len(page.elements)  # the outermost declared element around
        for i, e in enumerate(page.elements):
            if i:
                of[i] = of[e.parent] if of[e.parent] >= 0 else i if (e.name in ("article", "main") or e.attributes) and kinds(e) else -1
        with_text = {of[at] for at, _, _ in blocks} - {-1}
        if len(with_text) > 1:
            with_text = {of[at] for at, path, _ in blocks if content[path]} - {-1}
        if with_text:
            return [o in with_text for o in of]
    return None


def main_text(pages: DataFrame, html_col: str = "html", *, strictness: float = 0.5) -> DataFrame:
    """``pages`` without the html, with ``text``, ``n_chars``, ``n_blocks`` and ``content_paths``."""
    others = [c for c in pages.columns if c not in (html_col, "text", "n_chars", "n_blocks", "content_paths")]

    @F.pandas_udf("text string, n_chars bigint, n_blocks int, content_paths array<string>")
    def extract(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for source in batch:
                found = main_blocks(source, strictness) if source else []
                text = "\n".join(t for _, t in found)
                rows.append((text, len(text), len(found), sorted({p for p, _ in found})))
            yield pd.DataFrame(rows, columns=["text", "n_chars", "n_blocks", "content_paths"])

    return pages.withColumn("__hf_main", extract(F.col(html_col))).select(*others, "__hf_main.*")
