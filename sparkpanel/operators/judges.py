"""Judges as pluggable back-ends, called for many statements at once with retries."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class JudgeBackend(Protocol):
    name: str

    def answer(self, statement: str, attempt: int) -> str: ...


class HashJudge:
    """A deterministic judge without a network: its answer follows a digest of the statement; some first attempts fail."""

    def __init__(self, name: str, salt: str = "") -> None:
        self.name, self.salt = name, salt

    def answer(self, statement: str, attempt: int) -> str:
        h = hashlib.sha256(f"{self.name}|{self.salt}|{statement}".encode()).digest()
        if attempt == 1 and h[0] % 16 == 0:
            raise TimeoutError("no answer")
        return "TRUE" if h[1] % 2 else "FALSE"


class Unreachable(RuntimeError):
    """A back-end that gave no valid answer to a probe."""


def probe(judges: list[JudgeBackend], statement: str = "Two plus two equals four.", retries: int = 2) -> None:
    """One call to each judge from the driver, before many are made; raises for those without a valid answer."""
    failed = [j.name for j in judges if _ask(j, statement, None, retries)[1] == "parse_fail"]
    if failed:
        raise Unreachable(", ".join(failed))


def _ask(judge: JudgeBackend, statement: str, reference: str | None, retries: int) -> tuple[str, str, int]:
    """(raw answer, verdict, attempt): calls until a verdict is valid; an error is a failed answer, and the last attempt stands."""
    raw, verdict, attempt = "", "parse_fail", 0
    asked = statement if reference is None else f"{reference}\n{statement}"
    while verdict == "parse_fail" and attempt <= retries:
        attempt += 1
        try:
            raw = judge.answer(asked, attempt)
        except Exception as error:  # noqa: BLE001 - any failure of a back-end is a failed answer
            raw = f"ERROR: {error}"
        found = re.search(r"\b(TRUE|FALSE)\b", raw.upper())
        verdict = found[1].lower() if found else "parse_fail"
    return raw, verdict, attempt


def compared(pairs: DataFrame, judges: list[JudgeBackend], retries: int = 2) -> DataFrame:
    """(id, judge, raw_response, verdict, attempt) for each question with two candidates (id, question, a, b): A, B or tie, else parse_fail."""

    def ask(batches) -> Iterator:
        import pandas as pd

        for pdf in batches:
            out = []
            for i, q, a, b in zip(pdf["id"], pdf["question"], pdf["a"], pdf["b"]):
                for j in judges:
                    raw, verdict = "", "parse_fail"
                    for attempt in range(1, retries + 2):
                        try:
                            raw = j.answer("\n".join(x or "" for x in (q, a, b)), attempt)
                        except Exception as error:  # noqa: BLE001
                            raw = f"ERROR: {error}"
                        found = re.search(r"\b(A|B|TIE)\b", raw.upper()) if not raw.startswith("ERROR:") else None
                        verdict = "parse_fail" if found is None else "tie" if found[1] == "TIE" else found[1]
                        if verdict != "parse_fail":
                            break
                    out.append((i, j.name, raw, verdict, attempt))
            yield pd.DataFrame(out, columns=["id", "judge", "raw_response", "verdict", "attempt"])

    return pairs.select("id", "question", "a", "b").mapInPandas(ask, "id string, judge string, raw_response string, verdict string, attempt int")


def judged(statements: DataFrame, judges: list[JudgeBackend], retries: int = 2, threads: int = 1) -> DataFrame:
    """(id, judge, raw_response, verdict, attempt) for each statement and judge; an error counts as parse_fail, and the last attempt stands.

    A null statement is asked as an empty one; a column reference, where there is one, is given along. A task makes
    ``threads`` calls at a time.
    """
    grounded = "reference" in statements.columns

    def ask(batches) -> Iterator:
        from concurrent.futures import ThreadPoolExecutor

        import pandas as pd

        with ThreadPoolExecutor(threads) as pool:
            for pdf in batches:
                refs = pdf["reference"] if grounded else [None] * len(pdf)
                calls = [(i, j, s or "", (r or "") if grounded else None) for i, s, r in zip(pdf["id"], pdf["statement"], refs) for j in judges]
                answers = pool.map(lambda c: _ask(c[1], c[2], c[3], retries), calls)
                yield pd.DataFrame([(i, j.name, *a) for (i, j, _, _), a in zip(calls, answers)], columns=["id", "judge", "raw_response", "verdict", "attempt"])

    return statements.select("id", "statement", *(["reference"] if grounded else [])).mapInPandas(ask, "id string, judge string, raw_response string, verdict string, attempt int")


def repaired(items: DataFrame, stored: DataFrame, judges: list[JudgeBackend], retries: int = 2) -> DataFrame:
    """(id, judge, verdict, source): the stored verdicts (id, judge, verdict) of the items that are valid, and a new call for each item and judge without one; source says which, and whether the old one was missing or invalid."""
    valid = stored.where(F.col("verdict").isin("true", "false")).select("id", "judge", "verdict")
    wanted = items.select("id", F.explode(F.array(*(F.lit(j.name) for j in judges))).alias("judge")).distinct()
    kept = valid.join(wanted, ["id", "judge"], "left_semi").select("id", "judge", "verdict", F.lit("stored").alias("source"))
    todo = wanted.join(valid, ["id", "judge"], "left_anti").join(stored.select("id", "judge", F.lit("invalid").alias("was")).distinct(), ["id", "judge"], "left")
    out = kept
    for j in judges:
        mine = todo.where(F.col("judge") == j.name).select("id", "was")
        new = judged(items.join(mine.select("id"), "id", "left_semi"), [j], retries).join(mine, "id")
        out = out.unionByName(new.select("id", "judge", "verdict", F.coalesce("was", F.lit("missing")).alias("source")))
    return out
