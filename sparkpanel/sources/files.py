"""Readers and sinks of record files, and their integrity."""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import math
import tarfile
from collections.abc import Mapping, Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Credentials that no released file may hold. Fixed values.
SECRETS = (
    r"sk-or-v1-[A-Za-z0-9_-]{25,}", r"sk-(?:proj-|svcacct-)?[A-Za-z0-9_-]{40,}", r"(?:gh[pousr]_[A-Za-z0-9]{30,}|github_pat_[A-Za-z0-9_]{40,})",
    r"(?:AKIA|ASIA)[A-Z0-9]{16}", r"-----BEGIN (?:RSA |EC |OPENSSH |DSA )?PRIVATE KEY-----",
)
#: Labels of a six-way truth scale that count as true and as false; the rest are left out.
TRUTH_LABELS = {"true": "true", "mostly-true": "true", "false": "false", "pants-fire": "false"}
_BROKEN = "__broken"


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType, strict: bool = True) -> DataFrame:
    """Records of a JSON-lines file; blank lines are skipped, malformed ones fail the read or, if not strict, are dropped. A record's fields may all be null."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    if strict:
        return lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")
    marked = T.StructType([*schema.fields, T.StructField(_BROKEN, T.StringType())])
    parsed = lines.select(F.from_json("value", marked, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BROKEN}).alias("r"))
    return parsed.where(F.col("r").isNotNull() & F.col(f"r.{_BROKEN}").isNull()).select("r.*").drop(_BROKEN)


def read_pinned_jsonl(spark: SparkSession, path: str, sha256: str, schema: T.StructType) -> DataFrame:
    """Records of a file whose digest and whose records' fields are as named; anything else raises."""
    found = manifest(spark, path).first()
    if found is None or found["sha256"] != sha256:
        raise ValueError(f"digest of {path}")
    names = sorted(schema.fieldNames())
    keys = spark.read.text(path).where(F.trim("value") != "").select(F.array_sort(F.json_object_keys("value")).alias("k"))
    if not keys.where(F.col("k").isNull() | (F.col("k") != F.lit(names))).isEmpty():
        raise ValueError(f"fields of {path}")
    return read_jsonl(spark, path, schema)


def append_jsonl(frame: DataFrame, path: str) -> None:
    frame.write.mode("append").json(path)


def write_jsonl(frame: DataFrame, path: str) -> None:
    frame.write.mode("overwrite").json(path)


def read_tsv(spark: SparkSession, path: str, columns: int = 3) -> DataFrame:
    """Rows (c array) of a tab-separated file without quoting; rows with fewer columns are skipped."""
    return spark.read.text(path).select(F.split("value", "\t").alias("c")).where(F.size("c") >= columns)


def labelled_statements(rows: DataFrame, labels: Mapping[str, str] = TRUTH_LABELS) -> DataFrame:
    """(id, label, statement) of rows (c array of id, label, statement, ..) whose label is mapped."""
    mapped = F.element_at(F.create_map(*(F.lit(x) for pair in labels.items() for x in pair)), F.col("c")[1])
    return rows.select(F.col("c")[0].alias("id"), mapped.alias("label"), F.trim(F.col("c")[2]).alias("statement")).where("label is not null")


def archive_lines(spark: SparkSession, path: str) -> DataFrame:
    """(member, place, line) of the text files in gzipped tar archives, one task an archive; directories and unsafe names are skipped."""

    def lines(batches):
        import gzip

        import pandas as pd

        for pdf in batches:
            for data in pdf["content"]:
                with tarfile.open(fileobj=io.BytesIO(gzip.decompress(data))) as tar:
                    for m in tar:
                        if m.isfile() and safe_relative(m.name):
                            text = tar.extractfile(m).read().decode("utf-8").split("\n")
                            yield pd.DataFrame({"member": m.name, "place": range(len(text)), "line": text})

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInPandas(lines, "member string, place bigint, line string")


def annotated_claims(claims: DataFrame) -> DataFrame:
    """(id, claim, label, evidence) of claims (id, claim, evidence map of doc to annotations, place): the last record of an id, labelled true or false if its annotations are all of one kind, SUPPORT or CONTRADICT; others are left out."""
    last = claims.groupBy("id").agg(F.max(F.struct("place", "claim", F.map_entries("evidence").alias("evidence"))).alias("x")).select("id", "x.claim", F.map_from_entries("x.evidence").alias("evidence"))
    kinds = F.array_distinct(F.transform(F.flatten(F.map_values("evidence")), lambda e: e["label"]))
    label = F.when(kinds == F.array(F.lit("SUPPORT")), "true").when(kinds == F.array(F.lit("CONTRADICT")), "false")
    return last.select("id", "claim", label.alias("label"), "evidence").where("label is not null")


def audit_codes(spark: SparkSession, path: str) -> DataFrame:
    """Codes of lines '- audit_code: X', blanks before and around them allowed, with their counts; an empty code is BLANK."""
    return audit_counts(spark.read.text(path))


def audit_counts(lines: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by.., code, n) of audit lines in the column value."""
    code = F.trim(F.regexp_extract("value", r"^\s*-\s+audit_code:(.*)$", 1))
    return lines.where(F.col("value").rlike(r"^\s*-\s+audit_code:")).groupBy(*by, F.when(code == "", "BLANK").otherwise(code).alias("code")).agg(F.count(F.lit(1)).alias("n"))


def audit_gate(counts: DataFrame, accepted: str = "ok", by: Sequence[str] = ()) -> DataFrame:
    """PENDING with blanks, else GREEN up to 5 bad codes, YELLOW up to 8 with fewer than 5 of any kind, else RED."""
    bad = F.sum(F.when(~F.col("code").isin(accepted, "BLANK"), F.col("n")).otherwise(0))
    most = F.max(F.when(~F.col("code").isin(accepted, "BLANK"), F.col("n")).otherwise(0))
    blank = F.sum(F.when(F.col("code") == "BLANK", F.col("n")).otherwise(0))
    return counts.groupBy(*by).agg(blank.alias("blank"), bad.alias("bad"), most.alias("most")).select("*", F.when(F.col("blank") > 0, "PENDING").when(F.col("bad") <= 5, "GREEN").when((F.col("bad") <= 8) & (F.col("most") < 5), "YELLOW").otherwise("RED").alias("gate"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256, bytes) of files."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))


def mismatches(found: DataFrame, expected: DataFrame) -> DataFrame:
    """Files that are missing, unlisted or unlike a manifest, both sides (path, sha256, bytes)."""
    e = expected.select("path", F.col("sha256").alias("want"), F.col("bytes").alias("size"))
    problem = F.when(F.col("want").isNull(), "unlisted").when(F.col("sha256").isNull(), "missing").when(F.col("bytes") != F.col("size"), "size").when(F.col("sha256") != F.col("want"), "hash")
    return found.join(e, "path", "full").select("path", problem.alias("problem")).where("problem is not null")


def holds_secret(text: Column) -> Column:
    hit = F.lit(False)
    for s in SECRETS:
        hit = hit | text.rlike(s)
    return hit


def secrets(spark: SparkSession, path: str) -> DataFrame:
    """Paths of files that hold a credential."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.where(holds_secret(F.decode("content", "ISO-8859-1"))).select("path")


def unparsable(spark: SparkSession, path: str) -> DataFrame:
    """Paths of Python files that don't parse."""

    def parse(batches):
        import ast

        import pandas as pd

        for pdf in batches:
            bad = []
            for name, data in zip(pdf["path"], pdf["content"]):
                try:
                    ast.parse(data, filename=name)
                except (SyntaxError, ValueError):
                    bad.append(name)
            yield pd.DataFrame({"path": bad}, dtype="str")

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.where(F.col("path").endswith(".py")).select("path", "content").mapInPandas(parse, "path string")


def safe_relative(path: str) -> bool:
    return bool(path) and not path.startswith("/") and ".." not in path.split("/") and "\\" not in path


def archive(members: Mapping[str, bytes], compressed: bool = False) -> bytes:
    """A tar of the members that is the same for the same content: sorted, without times or owners."""
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as tar:
        for name in sorted(members):
            if not safe_relative(name):
                raise ValueError(f"unsafe path {name!r}")
            info = tarfile.TarInfo(name)
            info.size, info.mode, info.mtime = len(members[name]), 0o644, 0
            tar.addfile(info, io.BytesIO(members[name]))
    return gzip.compress(out.getvalue(), mtime=0) if compressed else out.getvalue()


def unpacked(data: bytes, listed: Mapping[str, str | tuple[str, int]]) -> dict[str, bytes]:
    """The members of an archive, gzipped or not, checked against their listed digests and, where given, sizes; anything unsafe, unlisted, doubled, missing or unlike raises."""
    out: dict[str, bytes] = {}
    with tarfile.open(fileobj=io.BytesIO(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data)) as tar:
        for m in tar:
            if not m.isfile() or not safe_relative(m.name) or m.name in out or m.name not in listed:
                raise ValueError(f"bad member {m.name!r}")
            want = listed[m.name]
            digest, size = want if isinstance(want, tuple) else (want, m.size)
            if m.size != size:
                raise ValueError(f"size of {m.name!r}")
            out[m.name] = tar.extractfile(m).read()
            if hashlib.sha256(out[m.name]).hexdigest() != digest:
                raise ValueError(f"digest of {m.name!r}")
    if missing := set(listed) - set(out):
        raise ValueError(f"missing {sorted(missing)}")
    return out


def numeric_leaves(value: object, path: tuple = ()) -> dict[tuple, object]:
    """The numbers, booleans and nulls of a nested record by their path."""
    if isinstance(value, (Mapping, list, tuple)):
        inner = value.items() if isinstance(value, Mapping) else enumerate(value)
        return {k: v for key, part in inner for k, v in numeric_leaves(part, (*path, key)).items()}
    return {path: value} if value is None or isinstance(value, (bool, int, float)) else {}


def leaf_errors(expected: object, actual: object, ignored: Sequence[str] = ()) -> tuple[int, list[str]]:
    """How many leaves of the expected record were compared, and those that are missing or unlike; no leaf at all is an error too. A boolean is no number."""
    want, have = numeric_leaves(expected), numeric_leaves(actual)
    checked = {k: v for k, v in want.items() if not (k and k[0] in ignored)}
    errors = []
    for k, v in checked.items():
        name = ".".join(map(str, k))
        if k not in have:
            errors.append(f"{name}: missing")
        elif not _same_leaf(v, have[k]):
            errors.append(f"{name}: {v!r} is now {have[k]!r}")
    return len(checked), errors or ([] if checked else ["nothing was compared"])


def _same_leaf(a: object, b: object) -> bool:
    plain = lambda x: isinstance(x, (int, float)) and not isinstance(x, bool)
    if plain(a) and plain(b):
        return a == b or math.isclose(a, b, rel_tol=1e-10, abs_tol=1e-12)
    return type(a) is type(b) and a == b


def json_safe(value: object) -> object:
    """A nested record with infinite numbers as the strings inf and -inf, so that any JSON reader takes it."""
    if isinstance(value, Mapping):
        return {k: json_safe(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [json_safe(v) for v in value]
    if isinstance(value, float) and math.isinf(value):
        return "inf" if value > 0 else "-inf"
    return value


def to_summary(frame: DataFrame, path: str, most: int = 1000) -> None:
    """A small result as one pretty JSON file with infinite numbers as strings. More than ``most`` rows raise."""
    rows = frame.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError("too many rows for a summary")
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(json_safe([r.asDict(recursive=True) for r in rows]), indent=2, ensure_ascii=False, default=str) + "\n", encoding="utf-8")


def to_markdown(frame: DataFrame, places: int = 3, most: int = 1000, order: Sequence[str] = (), ranks: Mapping[str, Sequence[str]] | None = None) -> str:
    """A small result as a Markdown table. More than ``most`` rows raise.

    Numbers have fixed decimals, null is NA, and MISSING where the row counts missing verdicts in missing_grounded. A
    column x_mean with its x_std is one column of mean and deviation. Rows are sorted by ``order``; ``ranks`` gives a
    column's values their places, others come after them.
    """
    for name, values in (ranks or {}).items():
        frame = frame.withColumn(f"__{name}", F.coalesce(F.array_position(F.lit(list(values)), F.col(name)), F.lit(0)))
    keys = [k for name in order for k in ([F.when(F.col(f"__{name}") == 0, 1).otherwise(0), F.col(f"__{name}"), F.col(name)] if name in (ranks or {}) else [F.col(name)])]
    rows = (frame.orderBy(*keys) if keys else frame).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError("too many rows for a report")
    show = lambda v, gone=False: ("MISSING" if gone else "NA") if v is None else f"{v:.{places}f}" if isinstance(v, float) else str(v)
    shown = [c for c in frame.columns if not c.startswith("__") and not (c.endswith("_std") and f"{c[:-4]}_mean" in frame.columns)]

    def cell(r, c: str) -> str:
        gone = bool("missing_grounded" in frame.columns and r["missing_grounded"])
        pair = c.endswith("_mean") and f"{c[:-5]}_std" in frame.columns
        return f"{show(r[c], gone)} ± {show(r[f'{c[:-5]}_std'], gone)}" if pair and r[c] is not None else show(r[c], gone)

    return "\n".join(["| " + " | ".join(shown) + " |", "|" + "---|" * len(shown), *("| " + " | ".join(cell(r, c) for c in shown) + " |" for r in rows)])
