"""Rows that every operator must take, shared by the tests of this folder."""

#: Nulls, empties, white space, ties, repeated rows, long words and texts, special strings.
ODD = [
    (1, "The cat sat on the mat.\nThe cat sat on the mat.\n\nIt  was fine, wasn't it?"), (2, None), (3, ""), (4, "   "), (5, "\n\n\n"), (6, "a<|endoftext|>b <|endoftext|> <|startoftext|> c"),
    (7, "naïve ÀÉ ǅ Σας İstanbul ŉ ﬁ é 中文 😀😀 ２３ ½ x\x1cy\x85z a​b"), (8, "word " * 3000), (9, "x" * 30_000), (10, "tab\tand\r\nreturn \n spaced"), (None, "no id here at all"),
    (11, "same text for two"), (12, "same text for two"), (12, "same text for two"), (13, "nul and <b>|#$%&*</b>"), (14, "trailing space "), (15, " leading\nline\n"),
]


def rows_of(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=lambda r: tuple((x is None, x if x is not None else 0) for x in r))
