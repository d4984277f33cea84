"""Guarded read-only SQL over four rollups, and validators of what a language model hands in."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The tables that may be asked; the words no statement may contain (writes, settings, other tables); the most rows of an answer.
TABLES = ("day_summary", "usage_daily", "usage_hourly", "sessions")
FORBIDDEN = (
    "insert", "update", "delete", "drop", "alter", "create", "attach", "detach", "pragma", "vacuum", "reindex", "replace",
    "merge", "truncate", "grant", "set", "cache", "refresh", "call", "with",
    "events", "watermarks", "entities", "llm_audit", "insights", "comms_daily", "place_daily", "modes",
)
MOST_ROWS = 50
#: The functions a statement may call; any other is refused, so none that reaches Java methods, files or the session can be.
FUNCTIONS = (
    "count", "sum", "avg", "mean", "min", "max", "median", "percentile", "percentile_approx", "stddev", "stddev_pop", "stddev_samp", "variance", "var_pop", "var_samp", "corr", "count_if", "max_by", "min_by",
    "abs", "ceil", "ceiling", "floor", "round", "bround", "sign", "sqrt", "power", "pow", "mod", "greatest", "least", "coalesce", "nullif", "ifnull", "nvl", "if", "cast", "try_cast", "try_divide",
    "lower", "upper", "trim", "ltrim", "rtrim", "length", "substr", "substring", "concat", "concat_ws", "replace", "like", "instr", "lpad", "rpad", "split_part", "startswith", "endswith", "contains",
    "date", "to_date", "date_add", "date_sub", "datediff", "date_trunc", "date_format", "day", "dayofweek", "dayofmonth", "month", "year", "hour", "minute", "weekday", "weekofyear", "add_months", "last_day",
    "row_number", "rank", "dense_rank", "percent_rank", "ntile", "lag", "lead", "first_value", "last_value",
)
#: Words that may stand before a bracket without being a function.
_WORDS = ("select", "from", "join", "in", "and", "or", "not", "on", "where", "having", "over", "by", "when", "then", "else", "as", "exists", "between", "filter", "distinct", "all", "any", "group", "using", "is", "union", "except", "intersect", "limit", "case")
CATALOG = ("screen_time", "pickups", "reflex_checks", "first_unlock_min", "evening_screen", "night_screen")


class Rejected(ValueError):
    """A statement that isn't a plain read of the allowed tables."""


def validate(sql: str) -> str:
    """The statement, trimmed, if it is one SELECT over allowed tables only; else Rejected."""
    text = sql.strip().rstrip(";").strip()
    plain = re.sub(r"'(?:[^']|'')*'", "''", text).lower()
    if ";" in plain:
        raise Rejected("one statement only")
    if "--" in plain or "/*" in plain:
        raise Rejected("no comments")
    if not re.match(r"select\b", plain):
        raise Rejected("SELECT only")
    for word in FORBIDDEN:
        if re.search(rf"\b{word}\b", plain):
            raise Rejected(f"not allowed: {word}")
    for name in re.findall(r"([`\"\w.]+)\s*\(", plain):
        if name not in FUNCTIONS and name not in _WORDS:
            raise Rejected(f"not a function to call: {name}")
    names = re.findall(r"\b(?:from|join)\s+([`\"\w.]+)", plain)
    if not names:
        raise Rejected("no table")
    for name in names:
        if name.strip('`"') not in TABLES:
            raise Rejected(f"not a table to ask: {name}")
    return text


def ask(spark: SparkSession, sql: str, load: Callable[[SparkSession], dict[str, DataFrame]]) -> DataFrame:
    """At most 50 rows of a validated statement, every value as text.

    It runs in a session of its own whose only views are the tables that `load` makes there, and the relations of its parsed
    plan are checked as well, so a list of tables with commas, or a path in quotes, can't reach further.
    """
    text = validate(sql)
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    found = {x.strip().lower() for x in re.findall(r"UnresolvedRelation \[([^\]]*)\]", plan.toString())}
    if not found or not found <= set(TABLES):
        raise Rejected(f"not a table to ask: {sorted(found - set(TABLES))}")
    own = spark.newSession()
    own.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    for name, df in load(own).items():
        if name in found:
            df.createOrReplaceTempView(name)
    out = own.sql(text).limit(MOST_ROWS)
    return out.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in out.columns])


def answer(spark: SparkSession, sql: str, load: Callable[[SparkSession], dict[str, DataFrame]]) -> str:
    """The rows as JSON, `{"rows": [...]}`, or `{"error": ...}`."""
    try:
        return json.dumps({"rows": [r.asDict() for r in ask(spark, sql, load).collect()]}, ensure_ascii=False)
    except Exception as e:
        return json.dumps({"error": str(e).split("\n")[0]})


def proposed_pairs(text: str, tested: tuple[tuple, ...] = (), most: int = 10) -> list[tuple[str, str, int, int]]:
    """Pairs (driver, outcome, least lag, greatest lag) of known series in a JSON list within a text.

    Unknown keys, pairs of a series with itself, repeats and pairs that are `tested` already are left out; the lag is 1 if missing, at most 3 either way, and a
    range from or to 0; ten pairs at most (the feature's limit). Anything unreadable gives none.
    """
    begin, end = text.find("["), text.rfind("]")
    try:
        rows = json.loads(text[begin : end + 1]) if 0 <= begin < end else []
    except ValueError:
        return []
    out: list[tuple[str, str, int, int]] = []
    for row in rows if isinstance(rows, list) else []:
        if not isinstance(row, dict):
            continue
        driver, outcome, lag = row.get("driver"), row.get("outcome"), row.get("lag", 1)
        lag = lag if isinstance(lag, int) and not isinstance(lag, bool) else 1
        lag = max(-3, min(3, lag))
        if driver in CATALOG and outcome in CATALOG and driver != outcome and all(p[:2] != (driver, outcome) for p in (*out, *tested)):
            out.append((driver, outcome, min(lag, 0), max(lag, 0)))
    return out[:most]


#: The series that may be paired, as a model is told of them; what stands in brackets is an explanation.
DESCRIBED = {
    "screen_time": "total screen time (seconds a day)",
    "pickups": "pickups (a day)",
    "reflex_checks": "quick checks (pickups under 15 seconds)",
    "first_unlock_min": "first pickup (minute of the day)",
    "evening_screen": "evening screen time (18 to 24 h)",
    "night_screen": "late-night screen time (0 to 4 h)",
}


def pair_label(series: str) -> str:
    """The name of a series in a finding: its description up to the bracket; the key itself if it isn't described."""
    return DESCRIBED.get(series, series).split(" (", 1)[0]


def mode_name(text: str) -> tuple[str, str] | None:
    """Name (1 to 40 characters) and description (240 at most) of a JSON object, or None."""
    try:
        row = json.loads(text[text.find("{") : text.rfind("}") + 1])
        name, description = str(row["name"]).strip(), str(row.get("description", "")).strip()
    except (ValueError, KeyError, TypeError):
        return None
    return (name, description) if 0 < len(name) <= 40 and len(description) <= 240 else None
