import random

import pytest

WORDS = ["alder", "birch", "cedar", "dogwood", "elm", "fir", "gum", "hazel", "ivy", "juniper", "kapok", "larch", "maple", "neem", "oak", "pine"]
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, node long, key string, `odd name` int"


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(400)) + r.choice(["", "", "", ",", "."]) for _ in range(n))


def make_texts():
    base, shared = prose(1, 120), prose(2, 70)
    near = base.split(" ")
    near[60] = "changed"
    block = "\n".join(prose(50 + k, 9) for k in range(24))
    return [
        None, "", "   \n\t", "one", "One", "two words", base, base, base.upper().lower(), " ".join(near), prose(3, 40) + " " + shared + " " + prose(4, 50), prose(5, 33) + "\n" + shared + " " + prose(6, 20),
        prose(7, 5) + "\n" + block + "\n" + prose(8, 6), prose(9, 7) + "\n" + block, prose(10, 30000), "é ß 漢字 <|endoftext|> İ ﬁ " + prose(11, 30), "\x00\x01 0x00 A-B\r\nC", "stop! now? yes. " * 40, "x" * 5000,
        *[prose(100 + k, 20 + 13 * k) for k in range(20)],
    ]


@pytest.fixture(scope="session")
def texts():
    return make_texts()


@pytest.fixture(scope="session")
def docs(spark, texts):
    """Nulls, empty and very long texts, copies, a repeated row, a null id, columns with clashing names."""
    rows = [(3 * k + 1, t, "en", None, len(t or ""), k, "k", 1) for k, t in enumerate(texts)]
    rows += [rows[6], (None, prose(77, 60), None, "s", 0, None, None, None)]
    return spark.createDataFrame(rows, COLUMNS).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)
