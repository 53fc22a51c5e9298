"""Small tables with nulls, empty and long texts, ties, repeats and clashing column names."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard int, curve string, n_words long"


def table(spark, texts, first=0):
    rows = [(None if i == 3 else first + i, t, None if i % 5 == 1 else "en", "s%d" % (i % 2) if i % 7 else None, None if t is None else len(t), 5, "x", 9) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


LONG = "Über-word's  end \n\n tab\tnext  " * 3000
TEXTS = [
    None, "", "one two three", "don't 'll stop!'s it's 12a3", "a  b   c \n d\n\n\ne   ", "　ideo space x", "same text here", "same text here",
    "mail me: a.b@x.example.com, or 10.0.0.1 and 300.1.1.1", "card 4111 1111 1111 1111 phone +1 (555) 010-9999 x", "y" * 5000, LONG, "<|endoftext|> ''s''s \x1c x", "  ",
]
