"""The trial journal: JSON lines, read tolerantly and appended by one writer."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RECORD = "key struct<strategy:string,params:string,symbol:string,timeframe:string>, experiment_id string, sharpe double, dsr double, alive boolean, family array<string>"


def fingerprint(key: dict) -> str:
    """Canonical text of a trial's key."""
    return json.dumps(key, sort_keys=True, ensure_ascii=False, separators=(",", ":"))


def read_journal(spark: SparkSession, path: str) -> DataFrame:
    """(record, fingerprint, family, ok) of every line that is not blank; ok is false for what can't be read."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = F.from_json("value", RECORD, {"mode": "PERMISSIVE"})
    rows = lines.withColumns({"record": parsed, "_key": F.get_json_object("value", "$.key"), "_family": F.get_json_object("value", "$.family")})
    family = F.coalesce(F.from_json("_family", "array<string>"), F.array().cast("array<string>"))
    return rows.select("value", "record", canonical_json(F.col("_key")).alias("fingerprint"), family.alias("family"), F.col("_key").startswith("{").alias("ok")).fillna({"ok": False})


@F.udf(T.StringType())
def canonical_json(text: str | None) -> str | None:
    """Spark's to_json keeps the order of keys as it is; the journal is small and read once for a run."""
    if text is None:
        return None
    try:
        return fingerprint(json.loads(text))
    except ValueError:
        return None


def prior_trials(journal: DataFrame, keys: list[dict]) -> int:
    """Records that count as trials of ``keys``: by their own key or by their family. A record counts once."""
    wanted = F.array(*(F.lit(fingerprint(k)) for k in keys)).cast("array<string>")
    hit = F.array_contains(wanted, F.col("fingerprint")) | F.arrays_overlap("family", wanted)
    return journal.where("ok").where(F.coalesce(hit, F.lit(False))).count()


def skipped(journal: DataFrame) -> int:
    return journal.where("not ok").count()


def append(path: str, records: list[dict]) -> None:
    with open(path, "a", encoding="utf-8") as f:
        f.writelines(json.dumps(r, ensure_ascii=False) + "\n" for r in records)
