"""Small documents with every awkward case, and clashing extra columns."""

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, "
          "g string, id string, n string, root string, score string, h string, template string")

LONG = " ".join(f"word{i} und{i % 7} the{i % 11}" for i in range(20_000))
BASE = "the quick brown fox jumps over the lazy dog and runs far away from all the other animals in the old wood"
NEAR = BASE.replace("quick", "slow")


def documents(spark, more=()):
    texts = [
        (1, BASE), (2, BASE), (3, NEAR), (4, None), (5, ""), (6, " \n\t "), (7, "one two"), (8, "One  TWO"),
        (9, LONG), (10, "12345 !!"), (11, BASE + "\n" + BASE + "\nsomething else entirely here"), (None, BASE),
        (12, "Ünïcode ß 日本語 \U0001F600 text"), (12, "Ünïcode ß 日本語 \U0001F600 text"), (13, "a\\b </s> [INST] x"), *more]
    rows = [(d, t, None if d == 7 else "en", None if d == 3 else "s", len(t) if t is not None else None,
             "x", "x", None, "x", "x", "x", "x") for d, t in texts]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
