"""Where datasets come from."""

from .files import read_table, read_tsv, scan_lines, scan_reader, tar_reader
from .generated import const, keyed_generator, reader_func

__all__ = ["const", "keyed_generator", "read_table", "read_tsv", "reader_func", "scan_lines", "scan_reader", "tar_reader"]
