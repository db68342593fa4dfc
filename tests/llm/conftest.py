import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, clean_text string, spans string"


def prose(seed, n, vocabulary=400):
    r = np.random.default_rng(seed)
    words = [f"{'bcdfglmnprst'[i % 12]}{'aeiou'[i % 5]}{'rnlst'[i % 7 % 5]}{i:x}" for i in range(vocabulary)]
    return " ".join(words[i] for i in r.integers(0, vocabulary, n))


@pytest.fixture(scope="session")
def hard_texts():
    """Nulls, empties, repeats, ties, near copies, long and odd texts."""
    base = prose(1, 120)
    words = base.split()
    out = [None, "", "   \n", "a", "two words", "a", base, base, base.upper(), "\x00\x01 zero \x00", "日本語 テキスト 漢字", "é à ü " * 30, "idiot " * 300]
    for k in (1, 3, 7, 20):
        v = list(words)
        v[k] = "changed"
        out.append(" ".join(v))
    out += [" ".join(words[30:90]), base[40:400] + " tail " + base[40:400], prose(2, 3000), prose(3, 25) + " " + " ".join(words[10:60])]
    return out


@pytest.fixture(scope="session")
def hard(spark, hard_texts):
    """Those texts as documents, with a repeated row and columns named like the operators' own."""
    rows = [(i, t, ["en", None, "de"][i % 3], "s", None if t is None else len(t), "x", "y") for i, t in enumerate(hard_texts)]
    rows.append(rows[6])
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def nameless(spark):
    """Rows without an id, and ids with two texts."""
    base = prose(5, 80)
    return spark.createDataFrame([(None, base, None, None, None, None, None), (None, None, None, None, None, None, None), (4, base, "en", "s", 1, "", ""), (4, prose(6, 40), "en", "s", 1, "", "")], DOCS)
