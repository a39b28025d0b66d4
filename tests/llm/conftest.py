import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, bucket int, signature string, id string, k int"


def corpus(seed=1):
    """Copies, near copies, shared passages, one very long text, nulls, blanks, ties and repeated rows."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8)))
    passage = " ".join(word() for _ in range(90))
    texts = [" ".join(word() for _ in range(rng.randrange(20, 160))) for _ in range(20)]
    texts += [texts[0], texts[0], texts[1].upper(), texts[2] + " extra words at the end"]
    texts += [texts[3][:200] + " " + passage + " " + texts[4][:150], passage, "\n".join([texts[5][:80], "same line", "same line", texts[6][:90]])]
    near = texts[7].split()
    texts += [" ".join(near[:30] + ["changed"] + near[31:]), " ".join(near[:-1]), passage + "\n" + passage]
    texts += [None, "", " \n\t ", "one", "One two", "one two", "only four words here", "é ü 漢字 🙂 " * 12, "ab " * 700, "#$% &*| " * 40, " ".join(word() for _ in range(6000)) + passage]
    rows = [(i * 3, t) for i, t in enumerate(texts)]
    rows += [rows[5], (None, texts[0]), (None, None), (None, passage)]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The corpus with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "en", f"s{len(t or '') % 3}" if t else None, len(t or ""), "clash", 1, "x", "y", 2) for i, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(docs):
    return docs.where("false")
