"""Covers of e-books. EPUB is read here; a PDF page renderer can be given as a decoder."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from xml.etree import ElementTree


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _first(root: ElementTree.Element, tag: str, **match: str) -> ElementTree.Element | None:
    for e in root.iter():
        if _local(e.tag) == tag and all((e.get(k) or "").lower() == v.lower() for k, v in match.items()):
            return e
    return None


def epub_cover(data: bytes) -> bytes | None:
    """Bytes of an EPUB's cover image: the manifest item of the cover id; None without one."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            container = ElementTree.fromstring(z.read("META-INF/container.xml"))
            root_file = _first(container, "rootfile")
            if root_file is None or not root_file.get("full-path"):
                return None
            opf = root_file.get("full-path")
            package = ElementTree.fromstring(z.read(opf))
            meta = _first(package, "meta", name="cover")
            if meta is not None:
                found = re.sub(r"^[^0-9A-Za-z]+", "", meta.get("content") or "")
            else:
                found = "x_cover" if _first(package, "metadata") is None else ""
            item = _first(package, "item", id=found) if found else None
            if item is None or not item.get("href"):
                return None
            return z.read(posixpath.normpath(posixpath.join(posixpath.dirname(opf), item.get("href"))))
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, OSError):
        return None


def mobi_cover(data: bytes) -> None:
    """MOBI files are listed but have no cover here."""
    return None


BOOKS = {"epub": epub_cover, "mobi": mobi_cover}
