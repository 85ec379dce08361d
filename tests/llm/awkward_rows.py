"""A small table that holds what operators stumble over."""

LONG = " ".join(f"word{i % 977}x{i // 977}" for i in range(40_000))
PROSE = "It was of the thing that ought to be here, and the rest of them were only waiting for it to be over and done with again."

# id, text, lang, source: nulls in each column, empty and blank texts, a very long one, ties, repeated rows and one id with two texts.
AWKWARD = [
    (1, PROSE, "en", "src0"),
    (2, PROSE, "en", "src0"),
    (2, PROSE, "en", "src0"),
    (3, PROSE.upper(), "en", "src1"),
    (4, None, "en", "src1"),
    (5, "", None, "src2"),
    (6, " \n\t ", "de", None),
    (None, PROSE, None, None),
    (None, None, None, None),
    (7, LONG, "en", "src0"),
    (8, LONG, "en", "src0"),
    (9, "123 456 !!! ???", "fr", "src3"),
    (9, "Le chat est la et il ne veut pas de nous ici avec les autres.", "fr", "src3"),
    (10, "ÄÖÜ ß 中文 ́ x", "de", "src9"),
]
COLUMNS = "doc_id long, text string, lang string, source string"
