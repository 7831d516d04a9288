from twinstring.sources.text import from_iterable, pair_lines, read_lines, write_pairs

__all__ = ["from_iterable", "pair_lines", "read_lines", "write_pairs"]
