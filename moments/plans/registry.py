"""Every registered query of the core library, and the SQL that checks it."""

from __future__ import annotations

import functools

#: Ranks and counts, which are reported as 64-bit numbers by every query.
COUNTED = set("rank dense_rank text_rank moment_rank place turn number n shared chars least most".split())
QUERIES: dict = {}
ORACLES: dict = {}


def query(oracle: str | None = None):
    """Registers a function (spark, sf_dir) -> DataFrame under its name, with DuckDB SQL for the same rows."""

    def add(f):
        @functools.wraps(f)
        def run(spark, sf_dir):
            df = f(spark, sf_dir)
            return df.select(*[df[c].cast("long").alias(c) if k == "int" and c in COUNTED else df[c] for c, k in df.dtypes])

        QUERIES[f.__name__] = run
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


from moments.plans import answers, documents, grid, link, retrieve, speech, storage, summaries, thin  # noqa: E402, F401
