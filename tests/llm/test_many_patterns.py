"""Personal data where there are more patterns than are sent to executors."""

import pytest
from lumicurve.llm import pii

#: Behind six words, six keys and one more string each, and two copies; the other six stand too often without a key.
MARKED = 6 * 7 + 2


@pytest.fixture(scope="module")
def secrets(spark):
    """Keys behind words of their own, a word in other places, copies, null and repeated ids."""
    rows = []
    for k in range(12):
        word = "key" + "abcdefghijkl"[k]
        for j in range(6):
            rows.append((100 * k + j, f"{word}: {chr(97 + k)}{j}b2c{j}d4e{j}f6g{k}h8 mail x@a.org"))
        # Of these two words, one stands far more often without an identifier.
        rows.append((100 * k + 50, f"{word}: nothing here. " * (30 if k % 2 else 1)))
        rows.append((100 * k + 51, f"{word}: zzzz{k}zzzz"))
    rows += [(None, rows[0][1]), (0, rows[0][1]), (5000, None), (5001, "")]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def test_all_patterns_mark(secrets):
    rows = lambda **o: sorted(map(str, pii.find_personal_data(secrets, **o).collect()))
    few, joined = rows(), rows(most_patterns=2)
    assert few == joined
    assert sum("n_id=1" in r for r in joined) == MARKED


def test_all_patterns_redact(secrets):
    rows = lambda **o: sorted(map(str, pii.redact_personal_data(secrets, **o).collect()))
    few, joined = rows(), rows(most_patterns=2)
    assert few == joined
    assert sum("<ID>" in r for r in joined) == MARKED
