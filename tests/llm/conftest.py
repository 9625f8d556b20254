import zlib

import pytest

ODD = ["", None, " ", "\n\n", "one", "A b\tc", "a B\nC", "word " * 400, "é  z　\tq  x", "<|endoftext|> don't I'll\r\n 123 ½", "the same line of text that is longer than forty characters\nrest"]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, clashing extra columns."""
    rows = [(i, t) for i, t in enumerate(ODD)] + [(3, ODD[3]), (3, "other text of a taken id"), (None, "no id"), (None, None)]
    rows += [(100 + i, f"x{i}\nthe same line of text that is longer than forty characters \n\nend") for i in range(6)]
    rows += [(200, " ".join(f"w{i}" for i in range(30_000)))]
    schema = "doc_id long, text string, hash string, key long, n_tokens string, part int, node string, drops int, score string, block string, n_lines string, n_dropped string, lang string, tree string, w1 string, n int"
    return spark.createDataFrame([(*r, "h", 1, "n", 2, "x", 3, "s", "b", "mine", "z", None if k % 3 == 0 else "ab"[k % 2], "t", "w", 4) for k, r in enumerate(rows)], schema).repartition(3)


@pytest.fixture(scope="session")
def none(spark, odd):
    return odd.where("doc_id = -1")


def crc(text: str) -> int:
    return zlib.crc32(text.encode())
