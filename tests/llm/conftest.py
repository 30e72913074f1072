import random

import pytest


@pytest.fixture(scope="session", autouse=True)
def shared_tables(spark, tmp_path_factory):
    """The tests set a folder of their own where the session names none."""
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))


@pytest.fixture(scope="session")
def texts():
    """(doc_id, text): prose, copies, near copies, shared passages, boilerplate, junk, nothing at all."""
    rng = random.Random(5)
    lexicon = ["".join(rng.choice(["an", "ed", "tion", "the", "ou", "é", "sh", "Re"]) for _ in range(rng.randint(1, 4))) for _ in range(300)]

    def prose(words):
        out = []
        while words > 0:
            n = min(words, rng.randint(6, 18))
            out.append(" ".join(rng.choice(lexicon) for _ in range(n)) + ".")
            words -= n
        return "\n".join(out)

    rows = [prose(rng.randint(60, 160)) for _ in range(60)]
    passage, notice = prose(60), "All rights reserved under notice number {} of this house"
    rows += [rows[3], rows[3], rows[5]]
    rows += [rows[7].replace(rows[7].split()[4], "changed"), prose(40) + "\n" + passage, passage + "\n" + prose(50)]
    rows += [prose(70) + "\n" + notice.format(rng.randint(10, 99)) + "\n" + prose(30) for _ in range(8)]
    rows += ["", None, " \n\t ", "one", "one", "a b c d e " * 400, "x" * 5000, "ÉTÉ été\x0bword\x0cword word x 日本語 😀"]
    return list(enumerate(rows, 1))
