from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and to in that is was for with as on at by from an be this it are".split()


def prose(seed: int, n: int) -> str:
    """n words, the same for the same seed."""
    out, x = [], seed * 7919 + 17
    for _ in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        out.append(WORDS[x // 65536 % 20] + WORDS[x // 7 % 20])
    return " ".join(out)


@pytest.fixture(scope="session")
def hard_rows():
    """Nulls, empty and long texts, ties, repeated rows, copies, near copies and shared passages."""
    shared = prose(99, 80)
    long_text = "\n".join(prose(i, 40) for i in range(60))
    rows = [
        (1, None, "en", "a", 0), (2, "", "en", "a", 0), (None, prose(5, 60), "en", None, 1), (3, " \t\n ", None, None, 3),
        (4, "one two", "en", "a", 7), (5, "ONE two", "en", "b", 7), (6, prose(1, 120), "en", "a", 1),
        (7, prose(1, 120), "en", "b", 1), (7, prose(1, 120), "en", "b", 1), (8, prose(1, 120).replace("the", "xx", 1), "en", "c", 1),
        (9, long_text, "de", "a", 1), (10, "zzz " * 300, "en", "a", 1), (11, prose(2, 60) + " " + shared, "fr", "b", 1),
        (12, shared + " " + prose(3, 200), "fr", "b", 1), (13, "日本語 🙂 ▁ ñandú ŒUVRE K " + prose(4, 55), "es", "c", 1),
        (14, "a" * 1500, "en", "c", 1), (15, "Licensed under the GNU General Public License, version 3.\nCC BY and MIT License", "en", "a", 1),
        (-3, prose(6, 70), None, "c", 1), (None, None, None, None, None), (16, prose(1, 90), "en", "a", 1),
    ]
    return rows + [(100 + i, prose(200 + i, 90), ("en", "de", "fr", "es")[i % 4], f"s{i % 3}", 1) for i in range(24)]


@pytest.fixture(scope="session")
def hard(spark, hard_rows):
    return spark.createDataFrame(hard_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
