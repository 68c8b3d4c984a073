"""Results as text and files: formats of query output, reports, and dumps bundled for transport."""

from __future__ import annotations

import io
import json
import tarfile
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Formats in which a result is written line by line, by the name used in queries.
LINES = ("JSONEachRow", "TSV", "TSVWithNames", "CSV", "CSVWithNames")


def _text(value) -> str:
    return r"\N" if value is None else ("true" if value else "false") if isinstance(value, bool) else str(value)


def _tsv(value) -> str:
    return _text(value) if value is None else _text(value).replace("\\", "\\\\").replace("\t", "\\t").replace("\n", "\\n")


def _csv(value) -> str:
    return _text(value) if value is None or isinstance(value, (int, float)) else '"' + _text(value).replace('"', '""') + '"'


def rendered(df: DataFrame, form: str = "TSV") -> Iterator[str]:
    """Lines of a result; rows come to the driver a partition at a time."""
    names = df.columns
    rows = df.toLocalIterator()
    if form in ("JSON", "JSONCompact"):
        data = [r.asDict(recursive=True) if form == "JSON" else list(r) for r in rows]
        yield json.dumps({"meta": [{"name": f.name, "type": f.dataType.simpleString()} for f in df.schema], "data": data, "rows": len(data)}, default=str)
    elif form == "JSONEachRow":
        for r in rows:
            yield json.dumps(r.asDict(recursive=True), default=str)
    elif form.startswith(("TSV", "CSV")):
        sep, put = ("\t", _tsv) if form[0] == "T" else (",", _csv)
        if form.endswith("WithNames"):
            yield sep.join(put(n) for n in names)
        for r in rows:
            yield sep.join(put(v) for v in r)
    elif form == "Vertical":
        width = max(map(len, names), default=0)
        for i, r in enumerate(rows, 1):
            yield f"Row {i}:"
            yield from (f"{n:<{width}}  {_text(v)}" for n, v in zip(names, r, strict=True))
    elif form == "Pretty":
        cells = [[_text(v) for v in r] for r in rows]
        widths = [max(len(x) for x in col) for col in zip(names, *cells, strict=True)] if names else []
        for line in (names, ["-" * w for w in widths], *cells):
            yield " | ".join(f"{x:<{w}}" for x, w in zip(line, widths, strict=True)).rstrip()
    else:
        raise ValueError(f"unknown format {form!r}")


def write_lines(df: DataFrame, path: str, form: str) -> None:
    """A result of any size as text files, written by its tasks."""
    if form == "JSONEachRow":
        df.write.mode("overwrite").json(path)
    elif form in LINES:
        df.write.mode("overwrite").csv(path, sep="\t" if form[0] == "T" else ",", header=form.endswith("WithNames"), nullValue=r"\N", escape='"')
    else:
        raise ValueError(f"{form!r} can't be written in parts")


def report(classified: DataFrame, folder: str) -> None:
    """Tallies with metrics, the quality curve and all verdicts of a concordance run."""
    from ..operators import concord

    concord.metrics(concord.tallies(classified)).coalesce(1).write.mode("overwrite").csv(f"{folder}/summary", header=True)
    concord.roc(classified).coalesce(1).write.mode("overwrite").csv(f"{folder}/roc", sep="\t", header=True)
    classified.write.mode("overwrite").parquet(f"{folder}/verdicts")


def pack_bundle(folder: str, bundle: str) -> None:
    """A local dump as one compressed archive."""
    with tarfile.open(bundle, "w:gz") as tar:
        tar.add(folder, arcname=".")


def unpack_bundle(spark: SparkSession, bundle: str, folder: str, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables of a bundle with columns matched by name: missing ones are null, unknown ones are left out."""
    with tarfile.open(bundle) as tar:
        tar.extractall(folder, filter="data")
    out = {}
    for name, like in tables.items():
        if (Path(folder) / name).exists():
            found = spark.read.parquet(f"file://{Path(folder).resolve()}/{name}")
            out[name] = found.select(*((F.col(f.name) if f.name in found.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in like.schema))
    return out


def shown(df: DataFrame, form: str = "Pretty") -> str:
    out = io.StringIO()
    for line in rendered(df, form):
        out.write(line + "\n")
    return out.getvalue()
