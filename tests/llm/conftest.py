import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, words string, fp long, component_id long, _kept_id string, row long, ids string"


def _row(doc_id, text, lang="en", source="src0"):
    return (doc_id, text, lang, source, None if text is None else len(text), "x", 1, 2, "y", 3, "z")


def sentences(seed: int, n: int) -> str:
    rng = random.Random(seed)
    words = [rng.choice("abcdefgh") * rng.randint(1, 3) + rng.choice(("ing", "er", "ou", "tion", "é")) for _ in range(60)]
    return " ".join(rng.choice(words) + rng.choice(("", "", "", ",", ".\n", "!")) for _ in range(n))


#: Nulls in every column, empty and very long texts, copies, near copies, repeated rows, odd white space.
ROWS = [
    _row(1, sentences(1, 120)),
    _row(2, sentences(1, 120)),
    _row(3, sentences(1, 120).replace("a", "a", 1) + " Licensed under the MIT License."),
    _row(4, None),
    _row(5, ""),
    _row(6, "   \n\n  \t "),
    _row(7, "Released under the MIT\nLicense. GNU General Public License, Apache license; mit license", None, None),
    _row(8, sentences(8, 9000)),
    _row(9, "one"),
    _row(10, "Mail ann.07@mail3.example.com or +1 (824) 555-1234 from 10.0.0.1, card 4111 1111 1111 1111 or 1234567890123456 token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\""),
    _row(10, "same id, other text"),
    _row(11, "repeated row of five words here"),
    _row(11, "repeated row of five words here"),
    _row(None, "a text without an id"),
    _row(None, None, None, None),
    _row(12, "日本語のテキスト　全角 \x85 'tis they'll don't 12345 <|endoftext|> ½²"),
    _row(13, "x" * 5000),
    _row(40, sentences(40, 300)),
    _row(60, sentences(60, 50)),
]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(ROWS, COLUMNS).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], COLUMNS)
