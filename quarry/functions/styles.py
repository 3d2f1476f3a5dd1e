"""Text styles: a registry from a style's name to how a document's text is made from its row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions.text import between, content_after_abstract, h1_title, strip_tags, url_title

TEXT = "document_text"
P, UL = ("<P>", "</P>"), "</Ul>"


def simplified(split: str = "train") -> Column:
    return F.col(TEXT)


def simplenorm(split: str = "train") -> Column:
    return strip_tags(TEXT)


def _with_title(title: Column) -> Column:
    """Title, raw first paragraph and stripped rest, without separators."""
    return F.concat(title, between(TEXT, *P), strip_tags(content_after_abstract(TEXT, P, UL)))


def title_abstract_content(split: str = "train") -> Column:
    return _with_title(strip_tags(h1_title(TEXT)))


def ncinorm(split: str = "train") -> Column:
    """As above; other splits than train take the document's own title, else the URL's, else the heading."""
    heading = h1_title(TEXT)
    if split == "train":
        return _with_title(strip_tags(heading))
    own = F.coalesce(F.nullif(F.col("document_title"), F.lit("")), F.nullif(url_title("document_url"), F.lit("")), heading)
    return _with_title(strip_tags(own))


def _normalised(infobox: bool) -> Callable[[str], Column]:
    def style(split: str = "train") -> Column:
        from quarry.operators.html_tree import normalise_tokens

        return normalise_tokens("document_html", "document_tokens", remove_infobox=not infobox)["text"]

    return style


STYLES: dict[str, Callable[[str], Column]] = {
    "simplified": simplified,
    "simplenorm": simplenorm,
    "title-abstract-content": title_abstract_content,
    "ncinorm": ncinorm,
    "htmlnorm": _normalised(False),
    "htmlnorm-infobox": _normalised(True),
}
#: Styles that need the page's markup and cannot be made from a simplified text.
FULL_ONLY = frozenset({"htmlnorm", "htmlnorm-infobox"})


def style_column(name: str, split: str = "train") -> Column:
    if name not in STYLES:
        raise ValueError(f"unknown text style {name!r}; known: {', '.join(STYLES)}")
    return STYLES[name](split)
