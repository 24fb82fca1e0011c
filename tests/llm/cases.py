"""Rows that every operator must take."""

LONG = " ".join(f"w{i % 997}x{i}" for i in range(60_000))
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "x" * 200_000), (5, LONG), (5, "the same id again with other words in it"), (None, "a row that has no id at all but has words"), (7, "é😀 中文 ́"), (8, "'" * 50)]
