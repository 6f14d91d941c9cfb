"""Rows that every operator must take: nulls, empty and long texts, ties, repeated rows, clashing column names."""

LONG = " ".join(f"word{i % 97} and line{i}\n" if i % 9 == 0 else f"w{i % 31}" for i in range(6000))
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog while 3 men watch it run 40 km away from home today, they say.\nEnd."),
    (2, ""), (3, None), (None, "a b c\nd"), (None, None), (4, " \n\t\n "), (5, LONG), (5, LONG), (5, "another text of that id"),
    (6, "Ünïcödé ✓ 日本語 テキスト 😀😀 ẞ İ ﬁ\r\n\x0b\x0c tail"), (7, "same line\n" * 12), (8, "x"), (9, "<|endoftext|> # * $ % & | < >"), (10, "UPPER CASE WORDS ONLY HERE"),
]
SCHEMA = "doc_id long, text string, source string, id long, th long, pos int, key string, doc string, n_words string"


def frame(spark, rows=ROWS):
    return spark.createDataFrame([(d, t, "s", 1, 2, 3, "k", "d", "n") for d, t in rows], SCHEMA)


def plain(rows):
    """Rows as sorted tuples of texts, nulls included."""
    return sorted(tuple(map(str, r)) for r in rows)
