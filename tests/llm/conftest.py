import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n):
    return [rng.choice(["alpha", "Beta", "gamma", "delta", "épsilon", "zeta", "eta", "theta", "iota", "kappa"]) + str(rng.randrange(40)) for _ in range(n)]


@pytest.fixture(scope="session")
def corpus():
    """Texts of many shapes: prose, copies, near copies, shared lines and passages, empty, null and very long ones."""
    rng = random.Random(5)
    common = " ".join(words(rng, 9)) + " a line that many documents hold"
    passage = " ".join(words(rng, 70))
    texts = [None, "", " \n\t ", "one", "One", "one two three", "x\n\n\ny"]
    for k in range(60):
        own = [" ".join(words(rng, rng.randrange(3, 30))) for _ in range(rng.randrange(1, 8))]
        if k % 3 == 0:
            own.insert(rng.randrange(len(own) + 1), common if k % 2 else "  " + common.upper() + "\t")
        if k % 7 == 0:
            own.append(passage)
        texts.append("\n".join(own))
    base = words(rng, 120)
    texts += ["\n".join(texts[20:23]), texts[25], texts[25], " ".join(base)]
    for k in range(8):
        near = list(base)
        near[13 * k + 2] = "changed"
        texts.append(" ".join(near))
    texts += [" ".join(base[:100]), " ".join(words(rng, 20_000)), "Der " * 300, passage]
    for n in range(4, 16):
        own = words(rng, n)
        texts += [" ".join(own), " ".join(own[:-1] + ["other"])]
    return [(i, t, "en", None if i % 11 == 0 else f"s{i % 5}", len(t or "")) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(docs):
    """The same rows with columns named as operators name their own."""
    from pyspark.sql import functions as F

    return docs.withColumns({c: F.lit(f"own {c}") for c in ("size", "h", "bucket", "sk", "key", "line", "doc", "kept", "lost", "hit", "score", "node", "h1", "words", "n_words", "kept_text", "n_lines", "target", "_gone", "a")})
