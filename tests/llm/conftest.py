import pytest

W = "alpha beta gamma delta eps zeta eta theta iota kappa lam mu nu xi omicron pi rho sigma tau ups".split()


def words(seed, n):
    out, x = [], seed
    for _ in range(n):
        x = (x * 1103515245 + 12345) % 2**31
        out.append(W[x // 65536 % len(W)] + str(x // 1000 % 40))
    return " ".join(out)


@pytest.fixture(scope="session")
def texts():
    """(id, text): copies, near copies, shared passages, nulls, empty and long texts, one repeated row."""
    base, shared = words(1, 120), words(2, 30)
    near = base.split()
    near[60] = "changed"
    rows = [(5, base), (3, base), (9, " ".join(near)), (4, words(3, 40) + " " + shared + " " + words(4, 20)), (8, shared), (1, words(5, 60) + "\n" + shared), (2, None), (6, ""), (7, " \t\n "), (10, "one two"), (11, "One TWO"), (12, words(6, 4000)), (13, words(6, 2000) + " tail"), (14, "ä" * 60 + " " + "ä" * 60), (10, "one two"), (20, "x " * 300), (21, "x " * 200)]
    return rows


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The texts in a table with extra columns, some named like columns of results."""
    return spark.createDataFrame([(i, t, "en", len(t or ""), 1, "z") for i, t in texts], "doc_id long, text string, lang string, n_chars long, score int, shard string").repartition(3)


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.where("doc_id < 0")
