"""Every query of the catalogue against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from corpuslake.plans.catalogue import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def normal(rows, columns):
    def cell(v):
        if isinstance(v, bool):
            return str(int(v))
        if isinstance(v, float):
            return f"{v:.6g}"
        return str(v)

    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    want = duck.execute(ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(columns)
    assert normal([tuple(r) for r in df.collect()], df.columns) == normal(want.fetchall(), columns)


def test_chunk_queries_equal_the_python_functions(spark):
    from corpuslake.operators.chunk import by_size

    texts = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    want = sorted((i, k, c) for i, t in texts for k, c in enumerate(by_size(t, 512, 128)))
    assert sorted(map(tuple, QUERIES["chunks_by_size"](spark, SF).collect())) == want


def test_chunk_sql_on_paragraphs_and_sentences():
    """The SQL against the chunker where the tables have no such texts: paragraphs, sentences, pieces over the size."""
    import random

    import pyarrow as pa

    from corpuslake.operators.chunk import by_size

    rng = random.Random(7)
    word = lambda: "".join(rng.choices("abcde中文", k=rng.randint(1, 9)))
    rows = []
    for i in range(150):
        paras = []
        for _ in range(rng.randint(1, 9)):
            lines = [" ".join(word() for _ in range(rng.randint(0, 60))) for _ in range(rng.randint(1, 12))]
            text = rng.choice(["\n", "\n \n"]).join(lines)
            paras.append("".join(c + rng.choice(["。", "！"]) if rng.random() < 0.02 else c for c in text))
        rows.append((i, rng.choice(["\n\n", "\n\n\n"]).join(paras) if i else "x" * 600 + "\n\nshort"))
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": [i for i, _ in rows], "text": [t for _, t in rows]}))
    got = sorted(con.sql(ORACLES["chunks_by_size"]).fetchall())
    assert got == sorted((i, k, c) for i, t in rows for k, c in enumerate(by_size(t, 512, 128)))
