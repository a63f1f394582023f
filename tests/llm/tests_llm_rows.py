"""Rows that the tests share."""

LONG = " ".join(f"w{i % 977}x{i}" for i in range(60_000))

#: Nulls, empty and blank texts, one word, repeated rows, a repeated id, a very long text, other scripts.
ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "a b c d e f g h i j k l"), (5, "a b c d e f g h i j k l"),
    (6, "a b c d e f g h i j k l"), (7, "two texts of one id"), (7, "that differ in all their words"), (8, LONG),
    (None, "no id but ten words in the text of this row"), (None, None), (9, "日本 語 don't  stop\n\n x ſ K é"),
]
