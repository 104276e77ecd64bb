"""Rows shared by the tests of the corpus operators."""

LONG = "one two three " * 40_000
ROWS = [
    (0, "Hello World", "en"), (1, "hello world", None), (2, "HELLO WORLD", "en"), (3, None, "de"), (4, "", None),
    (5, "", "en"), (6, "ÄÖÜ ist gut", "de"), (7, "äöü ist gut", "de"), (8, LONG, "en"), (9, "tie tie tie", "fr"),
    (9, "tie tie tie", "fr"), (9, "other text for nine", "fr"), (10, "  spaces \t\n and\x0blines  ", "en"), (None, "no id", "en"),
    (None, None, None), (11, "!!! ??? ###", "en"), (12, "😀 emoji ñandú 東京 x", "es"),
]
