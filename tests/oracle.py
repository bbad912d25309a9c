"""Compare a registered query with its SQL on DuckDB."""

from __future__ import annotations

from collections import Counter
from pathlib import Path

import duckdb

SF_DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def available() -> bool:
    return Path(SF_DIR).is_dir()


def same(spark, query, sql: str) -> None:  # noqa: ANN001
    df = query(spark, SF_DIR)
    columns = sorted(df.columns)
    tidy = lambda r: tuple(round(x, 6) if isinstance(x, float) else x for x in r)
    ours = Counter(tidy(r) for r in df.select(*[f"`{c}`" for c in columns]).collect())
    with duckdb.connect() as con:
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_DIR}/{t}.parquet')")
        found = con.execute(sql)
        names = [d[0] for d in found.description]
        order = [names.index(c) for c in columns]
        theirs = Counter(tidy(r[i] for i in order) for r in found.fetchall())
    assert len(names) == len(columns)
    assert ours == theirs, (list((ours - theirs).items())[:2], list((theirs - ours).items())[:2])
