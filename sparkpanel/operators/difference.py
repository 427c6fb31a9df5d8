"""Differences between two copies of a table, field by field."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..common import key_text

#: Relative and absolute tolerance of numbers. Fixed values.
RELATIVE, ABSOLUTE = 1e-10, 1e-12
_MARK, _CHECK = "__mark", "__check"


def _equal(left: pa.ChunkedArray, right: pa.ChunkedArray) -> np.ndarray:
    """Null-aware equality of two aligned columns: null equals null, infinity itself, NaN itself, numbers within the tolerance."""
    absent_l, absent_r = (x.is_null().to_numpy(zero_copy_only=False) for x in (left.combine_chunks(), right.combine_chunks()))
    if pa.types.is_floating(left.type):
        a, b = (pc.fill_null(x, 0.0).to_numpy() for x in (left, right))
        with np.errstate(invalid="ignore", over="ignore"):
            close = np.abs(a - b) <= np.maximum(RELATIVE * np.maximum(np.abs(a), np.abs(b)), ABSOLUTE)
        finite = np.isfinite(a) & np.isfinite(b)
        same = np.where(finite, close, (a == b) | (np.isnan(a) & np.isnan(b)))
    else:
        same = pc.fill_null(pc.equal(left, right), False).to_numpy(zero_copy_only=False)
    return np.where(absent_l | absent_r, absent_l & absent_r, same)


def _compare(keys: Sequence[str], fields: Sequence[str], ignored: str, out: pa.Schema):
    def aligned(side: pa.Table) -> tuple[pa.Table, np.ndarray]:
        """The rows, one for each key, in the order of the two-part hash of their key, and those hashes."""
        side = side.sort_by([(_MARK, "ascending"), (_CHECK, "ascending")]).combine_chunks()
        marks = np.empty(len(side), [("a", "i8"), ("b", "i8")])
        marks["a"], marks["b"] = (side.column(c).to_numpy() for c in (_MARK, _CHECK))
        return side, marks

    def unlike(side: pa.Table, i: int) -> np.ndarray:
        """Keys whose own rows disagree in a field."""
        return ~_equal(side.column(f"__low{i}"), side.column(f"__high{i}")) | pc.and_(side.column(f"__gone{i}"), side.column(f"__low{i}").is_valid()).to_numpy(zero_copy_only=False)

    def bucket(left: pa.Table, right: pa.Table) -> pa.Table:
        """Both sides of one hash bucket: sort by key, find each left key on the right, mask unequal cells."""
        (left, ka), (right, kb) = aligned(left), aligned(right)
        at = np.searchsorted(kb, ka)
        hit = np.zeros(len(ka), bool)
        inside = at < len(kb)
        hit[inside] = kb[at[inside]] == ka[inside]
        matched = np.zeros(len(kb), bool)
        matched[at[hit]] = True
        parts = []

        def emit(source: pa.Table, rows: np.ndarray, field: str, kind: str) -> None:
            if rows.any():
                picked = source.select([f"__k{i}" for i in range(len(keys))]).filter(pa.array(rows))
                parts.append(pa.table([*picked.columns, pa.array([field] * len(picked)), pa.array([kind] * len(picked))], names=[*keys, "field", "kind"]).cast(out))

        emit(left, ~hit, "", "only_expected")
        emit(right, ~matched, "", "only_output")
        if hit.any():
            both_l, both_r = left.filter(pa.array(hit)), right.take(pa.array(at[hit]))
            skip = pc.fill_null(both_l.column("__ignored"), "")
            for i, field in enumerate(fields):
                compared = ~pc.match_substring(skip, f"\u0001{field}\u0001").to_numpy(zero_copy_only=False)
                same = pc.equal(both_l.column(f"__gone{i}"), both_r.column(f"__gone{i}")).to_numpy(zero_copy_only=False)
                for end in ("low", "high"):
                    same &= _equal(both_l.column(f"__{end}{i}"), both_r.column(f"__{end}{i}"))
                emit(both_l, compared & ~same, field, "value")
                emit(both_l, compared & same & (unlike(both_l, i) | unlike(both_r, i)), field, "conflict")
        return pa.concat_tables(parts) if parts else out.empty_table()

    return bucket


def differences(expected: DataFrame, output: DataFrame, keys: Sequence[str], fields: Sequence[str], ignored: str = "ignored", bucket_rows: int = 50_000) -> DataFrame:
    """Rows (keys, field, kind): a key on one side only, with kind only_expected or only_output and field '', or a field that differs, with kind value.

    ``ignored`` is a column of the expected side holding the names of fields that aren't compared for that key (null or
    empty: none). Null equals only null, in keys too; infinity equals itself; numbers are equal within a relative
    1e-10 or an absolute 1e-12. Repeats count once. Where a key has unlike rows on one side, a field differs if its
    least or greatest value or the presence of a null does; if these agree, so that only the rows of a side disagree
    among themselves, the field comes out with kind conflict. So no unlike row is passed over. Columns that are neither
    key nor field are ignored. Either side may be empty.

    Each side becomes one row a key by an aggregation that combines before the shuffle, so a key that holds any number
    of rows reaches its bucket as one; the buckets are hashes of the whole key, about ``bucket_rows`` rows each, and
    are aligned as Arrow tables by sorted search.
    """
    buckets = max(1, -(-(expected.count() + output.count()) // bucket_rows), int(expected.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def side(frame: DataFrame) -> DataFrame:
        listed = F.concat(F.lit("\u0001"), F.array_join(F.array_sort(F.col(ignored)), "\u0001"), F.lit("\u0001")) if ignored in frame.columns else F.lit(None).cast("string")
        rows = frame.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), *(F.col(f).alias(f"__f{i}") for i, f in enumerate(fields)), listed.alias("__ignored"))
        ends = [x for i in range(len(fields)) for x in (F.min(f"__f{i}").alias(f"__low{i}"), F.max(f"__f{i}").alias(f"__high{i}"), F.coalesce(F.bool_or(F.col(f"__f{i}").isNull()), F.lit(False)).alias(f"__gone{i}"))]
        whole = F.concat_ws("\u0001", *(key_text(F.col(f"__k{i}")) for i in range(len(keys))))
        once = rows.groupBy(*(f"__k{i}" for i in range(len(keys)))).agg(*ends, F.max("__ignored").alias("__ignored"))
        return once.withColumns({_MARK: F.xxhash64(whole), _CHECK: F.xxhash64(F.lit(1), whole)}).withColumn("__bucket", F.pmod(F.col(_MARK), F.lit(buckets)))

    schema = T.StructType([expected.schema[k] for k in keys] + [T.StructField("field", T.StringType()), T.StructField("kind", T.StringType())])
    arrow = to_arrow_schema(schema)
    return side(expected).groupBy("__bucket").cogroup(side(output).groupBy("__bucket")).applyInArrow(_compare(list(keys), list(fields), ignored, arrow), schema)
