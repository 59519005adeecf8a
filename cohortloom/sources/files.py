"""File sources and sinks: CSV exports, snapshots with a verified manifest, artifacts."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..frame import SCHEMAS, FrameError
from ..functions.text import parse_instant

#: Tables that a snapshot may hold; others are refused.
ALLOWED = (*SCHEMAS, "sources", "judges")


def text_schema(columns: list[str]) -> T.StructType:
    """All columns as strings: text is parsed by our own rules, never inferred."""
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def scan_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A CSV file of strings, empty as null; another header is refused (SC5, SC9)."""
    head = spark.read.option("header", True).csv(path).columns
    if head != columns:
        raise FrameError(f"{path}: header {head}, not {columns}")
    return spark.read.schema(text_schema(columns)).option("header", True).option("nullValue", "").option("multiLine", True).csv(path)


def read_export(rows: DataFrame, ids: list[str], required: list[str], dates: list[str], early: str, late: str) -> DataFrame:
    """Trimmed ids, required ones present, dates of two formats, out-of-range ones null (SC6)."""
    for c in ids:
        rows = rows.withColumn(c, F.nullif(F.trim(c), F.lit("")))
    rows = rows.dropna(subset=required)
    for c in dates:
        rows = rows.withColumn(c, F.to_date(parse_instant(F.col(c))))
        rows = rows.withColumn(c, F.when(F.col(c).between(F.lit(early).cast("date"), F.lit(late).cast("date")), F.col(c)))
    return rows


def clean_dates(rows: DataFrame, column: str, early: str, late: str) -> tuple[DataFrame, DataFrame]:
    """The rows with the column cleaned, and one row of counts of what was wrong (SC7)."""
    d = F.to_date(parse_instant(F.col(column)))
    counts = rows.agg(
        F.count_if(F.col(column).isNotNull() & d.isNull()).alias("unparseable"), F.count_if(d > F.lit(late).cast("date")).alias("late"), F.count_if(d < F.lit(early).cast("date")).alias("early"),
    )
    return rows.withColumn(column, F.when(d.between(F.lit(early).cast("date"), F.lit(late).cast("date")), d)), counts


def trimmed(rows: DataFrame) -> DataFrame:
    """Every column trimmed, null as the empty text (SC8)."""
    return rows.select(*[F.trim(F.coalesce(c, F.lit(""))).alias(c) for c in rows.columns])


def row_digest(table: DataFrame) -> dict:
    """Rows and an order-free digest of a table: files differ where rows do not (MS5).

    Each row's SHA-256 gives two 63-bit numbers, which are summed; no row order, file or
    partition plays a part, and nothing is gathered.
    """
    row = F.sha2(F.to_json(F.struct(*sorted(table.columns)), {"ignoreNullFields": "false"}), 256)
    part = lambda i: F.conv(F.substring(row, i, 15), 16, 10).cast("decimal(38,0)")
    r = table.agg(F.count(F.lit(1)).alias("n"), F.sum(part(1)).alias("a"), F.sum(part(16)).alias("b")).first()
    return {"rows": r.n, "digest": hashlib.sha256(f"{r.n}:{r.a}:{r.b}".encode()).hexdigest()}


def refuse_restricted(names) -> None:
    """Only known tables leave the engine (SC16)."""
    if bad := sorted(set(names) - set(ALLOWED)):
        raise FrameError(f"not allowed in a snapshot: {bad}")


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(text.encode())
    finally:
        out.close()


def _read_text(spark: SparkSession, path: str) -> str:
    return "\n".join(r.value for r in spark.read.text(path).collect())


def export_snapshot(spark: SparkSession, tables: dict[str, DataFrame], root: str) -> str:
    """Write tables and a manifest under the hash of their contents; equal contents, equal path (SC12, SC20).

    An existing snapshot is left as it is.
    """
    refuse_restricted(tables)
    contents = {name: row_digest(t) for name, t in sorted(tables.items())}
    content_hash = hashlib.sha256("\n".join(f"{n}:{c['digest']}" for n, c in contents.items()).encode()).hexdigest()
    path = f"{root}/{content_hash}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest.json")
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        for name, t in tables.items():
            t.write.mode("overwrite").parquet(f"{path}/{name}")
        _write_text(spark, f"{path}/manifest.json", json.dumps({"content_hash": content_hash, "tables": contents}, sort_keys=True))
    return path


def open_snapshot(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Tables of a snapshot, verified against its manifest (SC1, SC2, SC15)."""
    manifest = json.loads(_read_text(spark, f"{path}/manifest.json"))
    refuse_restricted(manifest["tables"])
    tables = {}
    for name, wanted in manifest["tables"].items():
        tables[name] = spark.read.parquet(f"{path}/{name}")
        if row_digest(tables[name]) != wanted:
            raise FrameError(f"{name} is not the table of the manifest")
        tables[name].createOrReplaceTempView(f"snapshot_{name}")
    return tables


def sources_with_cases(sources: DataFrame, cases: DataFrame) -> DataFrame:
    """Sources that have a case (SC3)."""
    return sources.join(cases.select("source_id").distinct(), "source_id", "left_semi")


def build_tables(tables: dict[str, DataFrame], merges: DataFrame) -> dict[str, DataFrame]:
    """Frame tables of a snapshot (SC4): child rows of known cases, no replaced sentences,
    merged persons replaced by their survivors, and persons as all that remain named."""
    cases = tables["cases"].select("source_id", F.col("id").alias("case_id"))
    m = merges.select(F.col("id").alias("person_id"), "survivor")
    out = {"cases": tables["cases"], "courts": tables["courts"]}
    for name in ("assignments", "charges", "decisions", "sentences", "events"):
        t = tables[name].join(cases, ["source_id", "case_id"], "left_semi")
        if name == "sentences" and "replaced" in t.columns:
            t = t.where(~F.coalesce("replaced", F.lit(False)))
        if "person_id" in t.columns:
            t = t.join(m, "person_id", "left").withColumn("person_id", F.coalesce("survivor", "person_id")).drop("survivor")
        out[name] = t
    named = [out[n].select("source_id", F.col("person_id").alias("id")) for n in ("charges", "decisions", "sentences")]
    out["persons"] = named[0].union(named[1]).union(named[2]).where("id IS NOT NULL").distinct()
    return out


def write_members(members: DataFrame, path: str) -> None:
    """Member rows by subject type, for reads of one family (SC19, MS11)."""
    members.repartition("subject_type", "subject_id").write.mode("overwrite").partitionBy("subject_type").parquet(path)


def write_artifact(spark: SparkSession, root: str, payload: dict) -> str:
    """Canonical JSON under its own hash, written once (SC20)."""
    text = json.dumps(payload, sort_keys=True, separators=(",", ":"))
    path = f"{root}/{hashlib.sha256(text.encode()).hexdigest()}.json"
    _write_text(spark, path, text)
    return path


def read_artifact(spark: SparkSession, path: str) -> dict:
    """An artifact whose contents still have its name's hash (SC20, AD27)."""
    text = _read_text(spark, path)
    if hashlib.sha256(text.encode()).hexdigest() != path.rpartition("/")[2].removesuffix(".json"):
        raise FrameError(f"{path} was changed")
    return json.loads(text)


def _leaves(value, path: str = "$") -> dict[str, str]:
    """Path of every leaf of an artifact, with its canonical text; empty containers are leaves."""
    todo, out = [(path, value)], {}
    while todo:
        at, v = todo.pop()
        inner = [(f"{at}.{k}", x) for k, x in v.items()] if isinstance(v, dict) else [(f"{at}[{i}]", x) for i, x in enumerate(v)] if isinstance(v, list) else []
        if inner:
            todo += inner
        else:
            out[at] = json.dumps(v)
    return out


def first_difference(a, b) -> str | None:
    """The smallest path, as text, at which two artifacts hold another value or only one holds any (AD27)."""
    return min((path for path, _ in _leaves(a).items() ^ _leaves(b).items()), default=None)


def significant(value: float, digits: int = 12) -> float:
    """A float at so many significant digits (FN13)."""
    return float(f"{value:.{digits - 1}e}")


def render_table(rows: DataFrame, columns: list[str]) -> str:
    """A result as a Markdown table, fetched a partition at a time (SC22)."""
    lines = ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    lines += ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows.select(*columns).toLocalIterator()]
    return "\n".join(lines)


#: Readers of sources by name; a connector registers itself here.
CONNECTORS: dict[str, Callable[..., DataFrame]] = {}


def register(name: str):
    """Add a connector (MS28)."""

    def add(f):
        CONNECTORS[name] = f
        return f

    return add


@register("csv")
def csv_connector(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Strings of a CSV file."""
    return scan_csv(spark, path, columns)


@register("parquet")
def parquet_connector(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Columns of a Parquet table; the scan reads no others."""
    return spark.read.parquet(path).select(*columns)
