from .paging import Cursor, Offset, Page, PagedSource, read_pages

__all__ = ["Cursor", "Offset", "Page", "PagedSource", "read_pages"]
