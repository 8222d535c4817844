"""Shape of an image's hash tree, as columns. P bytes a page, F children a node."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of a page and children of a node, unless a caller says otherwise.
PAGE, FANOUT = 4096, 64


def div(a: Column, b: Column | int) -> Column:
    """Integer division; exact where doubles aren't."""
    return F.call_function("div", a, b if isinstance(b, Column) else F.lit(b)).cast("long")


def page_count(length: Column, page: int = PAGE) -> Column:
    """ceil(length / page); 0 for an empty image."""
    return div(length + (page - 1), page)


def height(pages: Column, fanout: int = FANOUT) -> Column:
    """The least h >= 1 with fanout ** h >= pages: by comparison with powers, never by a logarithm."""
    out, h = None, 1
    while fanout ** (h - 1) < 1 << 51:  # pages of 4 KiB in 2^63 bytes
        test = pages <= fanout**h if fanout**h < 1 << 62 else F.lit(True)
        out = F.when(test, h) if out is None else out.when(test, h)
        h += 1
    return out.otherwise(h).cast("int")


def span(level: Column, fanout: int = FANOUT) -> Column:
    """Pages below a child of a node of this level: fanout ** (level - 1)."""
    return _power(level - 1, fanout)


def subtree_pages(level: Column, fanout: int = FANOUT) -> Column:
    """Pages below a node of this level: fanout ** level."""
    return _power(level, fanout)


def _power(k: Column, fanout: int) -> Column:
    out, h = F.when(k == 0, 1), 1
    while fanout**h < 1 << 62:
        out = out.when(k == h, fanout**h)
        h += 1
    return out.cast("long")


def last_page_length(length: Column, page: int = PAGE) -> Column:
    return length - (page_count(length, page) - 1) * page


def run_pages(level: Column, page_base: Column, pages: Column, fanout: int = FANOUT) -> Column:
    """Pages of a subtree, clipped to the image."""
    return F.least(subtree_pages(level, fanout), pages - page_base)


def run_bytes(pages: Column, page_base: Column, length: Column, page: int = PAGE) -> Column:
    """Bytes of a run of pages, clipped to the image."""
    return F.least(pages * page, length - page_base * page)
