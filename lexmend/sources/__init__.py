"""Reading and writing texts."""

from lexmend.sources.files import read_lines, read_table, read_texts, read_warc, write_texts

__all__ = ["read_lines", "read_table", "read_texts", "read_warc", "write_texts"]
