import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, n: int, words: int = 400) -> str:
    rnd = random.Random(seed)
    return " ".join(f"w{rnd.randrange(words)}" for _ in range(n))


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty, blank and very long texts, ties, rows that repeat, and columns with clashing names."""
    long_text = prose(1, 60_000, 3000)
    rows = [
        (1, prose(2, 80) + "\n" + prose(3, 30), "en", "a", 5), (1, prose(2, 80) + "\n" + prose(3, 30), "en", "a", 5), (2, None, "en", "a", 0), (3, "", None, None, 0), (4, " \n\t ", "fr", "b", 4),
        (None, prose(4, 60), "en", "b", 9), (5, long_text, "de", "c", 1), (6, prose(2, 80) + "\n" + prose(3, 30), "en", "b", 5), (7, "a", "en", "b", 1), (8, "<|endoftext|> é 😀\n\n x", "es", "c", None),
        (9, "mail me: bob.smith@mail.example.com or +1 (555) 123-4567, ip 10.0.0.1", "en", "c", 3),
    ]
    df = spark.createDataFrame([(*r, "x", 1.5, True, 7) for r in rows], DOCS + ", key string, score double, kept boolean, `rank` int")
    return df


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture
def folder(tmp_path):
    """Writes tables as a folder of parquet files and gives its path."""

    def put(**tables):
        for name, df in tables.items():
            df.coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return put


#: Names that operators use beside a caller's rows, or add to them.
CLASHING = ("log_weight", "gumbel_key", "noise", "rate", "target", "copies", "total", "n", "k1", "source_size", "node", "rows", "one", "h", "d_id", "d_h", "dropped", "left", "g_id", "_row", "_new", "_words", "n_words_of", "part", "stratum", "at", "again", "label_id", "quarry", "key", "value")


@pytest.fixture(scope="session")
def clashing(spark):
    """Documents with a column of each such name, all holding values of their own."""
    rows = [(i, prose(i % 9, 60) if i % 9 else None, "en", f"s{i % 3}", 7, *[f"{c}{i}" for c in CLASHING]) for i in range(30)]
    return spark.createDataFrame(rows, f"{DOCS}, {', '.join(f'`{c}` string' for c in CLASHING)}")


def untouched(before, after, but=()):
    """Every row of after has the values that before has under its doc_id."""
    own = {r.doc_id: r.asDict() for r in before.collect()}
    assert [c for c in after.columns if c in before.columns] == before.columns
    found = after.collect()
    for r in found:
        assert all(v == own[r.doc_id][c] for c, v in r.asDict().items() if c in own[r.doc_id] and c not in but), r
    return found


def by_sql(path, sql, *tables):
    """Rows, as dictionaries, of SQL over a folder's tables."""
    import duckdb

    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet/*.parquet'")
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    return [dict(zip(names, row)) for row in found.fetchall()]
