"""Solutions as plug-ins: Python files that predict, run by partition beside the engine's own."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from quillstone import config as C

SCHEMA = "id string, vendor string, date string, total string, is_forged int, problem string"


def read_solution(spark: SparkSession, path: str) -> str:
    """The text of a solution's file, read by Spark, so that it may lie in any store."""
    rows = spark.read.text(path, wholetext=True).collect()
    if len(rows) != 1:
        raise ValueError(f"{path} must be one file")
    return rows[0]["value"]


def loaded(code: str, name: str = "solution"):
    """The module that a solution's text makes; it must have predict(records), which takes and gives iterators of dicts."""
    import types

    module = types.ModuleType(name)
    exec(compile(code, f"<{name}>", "exec"), module.__dict__)
    if not callable(getattr(module, "predict", None)):
        raise ValueError("a solution needs a function predict(records)")
    return module


def run_solution(records: DataFrame, code: str) -> DataFrame:
    """Predictions of a solution (see read_solution) for records with an id: id, vendor, date, total, is_forged, problem.

    Each partition loads the solution once and streams its records through it. Fields that an answer lacks are null; an is_forged other than 0 and 1 is 0 and
    named in `problem`, as are answers without an id.
    """

    def plain(answer: dict) -> dict:
        flag, problem = answer.get("is_forged"), None
        if isinstance(flag, bool) or flag not in (0, 1):
            flag, problem = 0, "is_forged is not 0 or 1"
        if not isinstance(answer.get("id"), str):
            problem = "id is not text"
        said = {f: None if answer.get(f) is None else str(answer[f]) for f in C.FIELDS}
        return {"id": None if answer.get("id") is None else str(answer["id"]), **said, "is_forged": int(flag), "problem": problem}

    def work(batches: Iterator) -> Iterator:
        import pandas as pd

        module = loaded(code)
        rows: list[dict] = []
        given = (dict(zip(batch.columns, values, strict=True)) for batch in batches for values in batch.itertuples(index=False, name=None))
        for answer in module.predict(given):
            rows.append(plain(answer))
            if len(rows) >= 1000:
                yield pd.DataFrame(rows)
                rows = []
        if rows:
            yield pd.DataFrame(rows)

    return records.mapInPandas(work, SCHEMA)
