"""Load plans and load statements by entity."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_NAME = re.compile(r"^[A-Za-z_][A-Za-z0-9_]*$")


def plan(rows: DataFrame, table: str, op: str) -> DataFrame:
    """Rows to load by table and op."""
    return rows.groupBy(F.col(table).alias("table_name"), F.col(op).alias("op")).agg(F.count(F.lit(1)).alias("n"))


def entities(rows: DataFrame, entity: str) -> list[str]:
    """The names of the tables to load, in order; a plan names few, and more than a thousand are refused."""
    names = [r[0] for r in rows.select(entity).distinct().orderBy(entity).limit(1001).collect()]
    if len(names) > 1000:
        raise ValueError("more than 1000 entities in a load plan")
    return names


def _checked(*names: str) -> None:
    for n in names:
        if not _NAME.match(n):
            raise ValueError(f"unsafe name: {n!r}")


def merge_statement(table: str, staging: str, keys: list[str], columns: list[str]) -> str:
    """MERGE by the keys; without keys an INSERT."""
    _checked(table, staging, *keys, *columns)
    names = ", ".join(columns)
    if not keys:
        return f"INSERT INTO {table} ({names}) SELECT {names} FROM {staging}"
    on = " AND ".join(f"t.{k} = s.{k}" for k in keys)
    rest = [c for c in columns if c not in keys]
    update = f" WHEN MATCHED THEN UPDATE SET {', '.join(f't.{c} = s.{c}' for c in rest)}" if rest else ""
    return f"MERGE INTO {table} t USING {staging} s ON {on}{update} WHEN NOT MATCHED THEN INSERT ({names}) VALUES ({', '.join(f's.{c}' for c in columns)})"


def copy_statement(table: str, location: str, kind: str = "PARQUET") -> str:
    _checked(table)
    return f"COPY INTO {table} FROM '{location}/{table}/' WITH (FILE_TYPE = '{kind}')"


def pipeline(names: list[str], source: str, sink: str) -> str:
    """A pipeline with one upserting copy activity for each table, as JSON."""
    steps = [{"name": f"copy_{n}", "type": "Copy", "source": f"{source}/{n}", "sink": {"target": f"{sink}.{n}", "writeBehavior": "upsert"}} for n in names]
    return json.dumps({"activities": steps}, indent=1)


def lake_plan(rows: DataFrame, entity: str, root: str, mode: str = "append") -> DataFrame:
    """Per entity the folder it is written to, the mode and its rows."""
    return rows.groupBy(F.col(entity).alias("entity")).agg(F.count(F.lit(1)).alias("n")).select("entity", F.concat(F.lit(root + "/"), "entity").alias("folder"), F.lit(mode).alias("mode"), "n")


def integration_tasks(names: list[str], source: str, target: str) -> str:
    """One load task for each table, as JSON."""
    return json.dumps([{"key": f"load_{n}", "source": f"{source}.{n}", "target": f"{target}.{n}"} for n in names], indent=1)


def replication(names: list[str], source: str, target: str) -> str:
    """MAP lines of a replication parameter file."""
    return "\n".join(f"MAP {source}.{n}, TARGET {target}.{n};" for n in names)


def write(rows: DataFrame, path: str, entity: str, mode: str = "append", kind: str = "parquet") -> None:
    """Rows into one folder per entity."""
    rows.write.mode(mode).partitionBy(entity).format(kind).save(path)


def write_csv(rows: DataFrame, path: str) -> None:
    """CSV with a header; quotes are doubled."""
    rows.write.mode("overwrite").csv(path, header=True, escape='"', quote='"')


def markdown(rows: DataFrame, columns: list[str], limit: int = 1000) -> str:
    """A small result as a Markdown table; a report shows its first rows and says so."""
    got = rows.select(*columns).limit(limit + 1).collect()
    text = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    lines = ["| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns), *["| " + " | ".join(text(v) for v in r) + " |" for r in got[:limit]]]
    return "\n".join(lines + ["", f"The first {limit} rows."] * (len(got) > limit))
