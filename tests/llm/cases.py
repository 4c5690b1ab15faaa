"""Small documents for all operators: nulls, empty and very long texts, ties, repeated rows, clashing names."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `row` string, n_words int, t string, k long, rid int, host string, mix string, shard int, h boolean"
PASSAGE = "the quick brown fox jumps over the lazy dog while seven old wizards quietly drink warm tea beside the slow green river at dawn today"
LONG = " ".join(f"word{i % 977} filler{i % 1009}" for i in range(60_000))


def row(doc_id, text, source="a"):
    return (doc_id, text, "en", source, None if text is None else len(text), "x", 1, "y", 2, 3, "z", "m", 4, True)


def documents():
    return [
        row(1, PASSAGE),
        row(2, PASSAGE),  # a copy
        row(3, PASSAGE.replace("dawn", "dusk") + " and more words follow here to make it somewhat longer than before"),
        row(4, None),
        row(5, ""),
        row(6, "   \n\t "),
        row(None, PASSAGE + " again"),
        row(7, "one two"),
        row(7, "one two"),  # a repeated row
        row(8, LONG, None),
        row(9, "x" * 200_000),
        row(10, " " * 20_000 + "end" + "\n" * 20_000),
        row(11, "Ünïcödé wörds – “quoted” 漢字 🙂 " * 8, "b"),
        row(12, PASSAGE.upper(), "b"),
        row(13, "you worthless idiot " * 3, "b"),
        row(14, "mail a.b@c.example.org or call +1 (555) 010-9999 card 4111 1111 1111 1111 ip 10.0.0.255 no 10.0.0.256 a@b@c.de", "b"),
    ]


def frame(spark, rows=None):
    return spark.createDataFrame(documents() if rows is None else rows, SCHEMA)
