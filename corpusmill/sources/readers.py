"""Document readers: JSON lines, Parquet, and adaptation of any frame to (text, id, metadata columns)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.column import Column


def adapt(rows: DataFrame, text: str = "text", id: str = "id", path: Column | None = None, row: Column | None = None, defaults: dict | None = None, limit: int = -1) -> DataFrame:
    """(text, id, further columns): ids as strings, by default `path/row`; rows with a null or empty text go. Fields of a `metadata` struct
    become columns; of equal names a top-level column wins over the struct, and both over `defaults`. The limit is global."""
    named = {f.name: F.col(f"metadata.`{f.name}`") for f in rows.schema["metadata"].dataType.fields} if "metadata" in rows.columns and isinstance(rows.schema["metadata"].dataType, T.StructType) else {}
    own = {c: F.col(f"`{c}`") for c in rows.columns if c not in (text, id, "metadata", "__path", "__row")}
    extra = {k: F.lit(v) for k, v in (defaults or {}).items()} | named
    columns = {k: F.coalesce(own[k], extra[k]) if k in own and k in extra else own.get(k, extra.get(k)) for k in dict.fromkeys([*extra, *own])}
    for k, v in (defaults or {}).items():
        if k in named and k not in own:
            columns[k] = F.coalesce(named[k], F.lit(v))
    fallback = F.concat_ws("/", path, row.cast("string")) if path is not None and row is not None else F.lit(None).cast("string")
    ident = F.coalesce(F.col(f"`{id}`").cast("string"), fallback) if id in rows.columns else fallback
    out = rows.where(F.col(f"`{text}`").isNotNull() & (F.col(f"`{text}`") != "")).select(F.col(f"`{text}`").alias("text"), ident.alias("id"), *[c.alias(k) for k, c in columns.items() if k not in ("text", "id")])
    return out.limit(limit) if limit >= 0 else out


def _options(reader, recursive: bool, glob: str | None):
    reader = reader.option("recursiveFileLookup", str(recursive).lower())
    return reader.option("pathGlobFilter", glob) if glob else reader


def _path(base: str | None) -> Column:
    """The file's path below `base`."""
    found = F.col("_metadata.file_path")
    return F.regexp_replace(found, "^.*" + base.rstrip("/").split("://")[-1].replace(".", r"\.") + "/?", "") if base else found


def read_parquet(spark: SparkSession, path: str | list[str], text: str = "text", id: str = "id", metadata: bool = True, limit: int = -1, defaults: dict | None = None, recursive: bool = True, glob: str | None = None) -> DataFrame:
    """Parquet documents. With metadata=False only text and id are read. The default id counts all rows of a file, empty ones too."""
    base = path if isinstance(path, str) else None
    rows = _options(spark.read, recursive, glob).parquet(*([path] if base else path))
    names = rows.columns if metadata else [c for c in (text, id) if c in rows.columns]
    rows = rows.select(*[f"`{c}`" for c in names], _path(base).alias("__path"), F.col("_metadata.row_index").alias("__row"))
    return adapt(rows, text, id, F.col("__path"), F.col("__row"), defaults, limit)


def read_jsonl(spark: SparkSession, path: str | list[str], schema: T.StructType | str, text: str = "text", id: str = "id", limit: int = -1, defaults: dict | None = None, recursive: bool = True, glob: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, bad lines). Lines that aren't JSON objects of the schema's types don't stop the run; (file, line) tells where they are. Compression goes by extension.

    Default ids are `file/offset of the line's block row`: Spark's JSON reader has no line number, so lines are read as text and parsed with the schema."""
    base = path if isinstance(path, str) else None
    kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    lines = _options(spark.read, recursive, glob).text([path] if base else path).select("value", _path(base).alias("__path"), F.col("_metadata.file_block_start").alias("__block"))
    full = T.StructType([*kind.fields, T.StructField("_corrupt_record", T.StringType())])
    parsed = lines.where("trim(value) <> ''").select("value", "__path", "__block", F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("r"))
    bad = parsed.where("r._corrupt_record is not null").select(F.col("__path").alias("file"), F.col("value").alias("line"))
    good = parsed.where("r._corrupt_record is null").select(*[F.col(f"r.`{f.name}`").alias(f.name) for f in kind.fields], "__path", F.xxhash64("value").alias("__row"))
    return adapt(good, text, id, F.col("__path"), F.hex("__row"), defaults, limit), bad


def read_documents(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """All documents of a folder of Parquet and JSON-lines files, columns by name."""
    frames = []
    for name, pattern in (("parquet", "*.parquet"), ("json", "*.jsonl*")):
        reader = _options(spark.read, True, pattern)
        try:
            frames.append(reader.parquet(path) if name == "parquet" else reader.schema(schema).json(path) if schema else reader.json(path))
        except Exception as e:
            if "UNABLE_TO_INFER_SCHEMA" not in str(e) and "PATH_NOT_FOUND" not in str(e):
                raise
    frames = [f for f in frames if f.columns]
    if not frames:
        raise FileNotFoundError(f"no documents in {path}")
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def with_upstream(upstream: DataFrame | None, rows: DataFrame) -> DataFrame:
    """Documents of an earlier source, then these."""
    return rows if upstream is None else upstream.unionByName(rows, allowMissingColumns=True)
