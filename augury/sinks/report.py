"""What a run leaves behind: its tables, one JSON text and one page of HTML per series, and a summary of stored runs.

A series is one row, put together by Spark and rendered in its task; only the summary, one card a series asked for, is
made on the driver."""

from __future__ import annotations

import datetime
import html
import json
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("metrics", "verdicts", "forecasts", "predictions")
_COLUMNS = ("model", "n", "mae", "rmse", "oos_r2", "diracc", "dm_p", "cw_p")
_STYLE = "body{font:15px sans-serif;max-width:960px;margin:2em auto}table{border-collapse:collapse}td,th{padding:.2em .7em;border-bottom:1px solid #ddd;text-align:right}.tile{display:inline-block;margin:0 2em 1em 0}.tile b{display:block;font-size:1.5em}svg{width:100%;height:240px}"


def store(tables: dict[str, DataFrame], path: str) -> None:
    """Write the tables of a run below ``path``, from where ``stored`` reads them to render again."""
    for name in TABLES:
        tables[name].write.mode("overwrite").parquet(f"{path}/{name}")


def stored(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in TABLES}


def period_start(pidx: int, freq: str) -> str:
    """First day of a period as text; what ``pidx`` counts depends on the frequency (M, W or D)."""
    if freq == "M":
        return f"{(pidx - 1) // 12:04d}-{(pidx - 1) % 12 + 1:02d}-01"
    return str(datetime.date(1970, 1, 1) + datetime.timedelta(days=pidx * (7 if freq == "W" else 1)))


def _finite(df: DataFrame) -> DataFrame:
    """nan and infinite values, which JSON lacks, become null."""
    bad = lambda c: F.isnan(c) | F.col(c).isin(float("inf"), float("-inf"))
    return df.select(*[F.when(~bad(c), F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _listed(df: DataFrame, keys: list[str], name: str, order: list[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys and c not in order]
    return _finite(df).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order, *rest))).alias(name))


def outputs(tables: dict[str, DataFrame], y: DataFrame, keys: list[str], title: str, freq: str = "M") -> DataFrame:
    """(keys, json, html): the results of every series of ``y`` (keys, pidx, v). A series without results has empty lists."""
    parts = [_listed(y.select(*keys, "pidx", "v"), keys, "history", ["pidx"])]
    parts += [_listed(tables[n], keys, n, ["h", "model"]) for n in ("metrics", "verdicts", "forecasts")]
    one = reduce(lambda a, b: a.join(b, keys, "left"), parts)
    lists = [F.coalesce(n, F.array()).alias(n) for n in ("history", "metrics", "verdicts", "forecasts")]
    text = F.to_json(F.struct(F.lit(title).alias("title"), F.lit(freq).alias("freq"), F.struct(*keys).alias("series"), *lists))
    page = F.pandas_udf(lambda s: pd.Series([render(json.loads(x)) for x in s], dtype=object), "string")
    return one.select(*keys, text.alias("json")).withColumn("html", page("json"))


def number(x, digits: int = 2) -> str:
    """A number with separators, other values as text, nothing as a dash."""
    if x is None or (isinstance(x, float) and x != x):
        return "–"
    return f"{x:,.{digits}f}" if isinstance(x, float) else f"{x:,}" if isinstance(x, int) and not isinstance(x, bool) else str(x)


def table(rows: list[dict], columns) -> str:
    """An HTML table of those of ``columns`` that some row has."""
    columns = [c for c in columns if any(c in r for r in rows)]
    line = lambda tag, cells: "<tr>" + "".join(f"<{tag}>{html.escape(c)}</{tag}>" for c in cells) + "</tr>"
    return "<table>" + line("th", columns) + "".join(line("td", [number(r.get(c), 3) for c in columns]) for r in rows) + "</table>"


def chart(points: list[tuple[int, float]], forecasts: list[dict]) -> str:
    """Lines through the known values, and a mark with its interval for each forecast."""
    values = [v for _, v in points] + [f[c] for f in forecasts for c in ("p", "lo", "hi") if f.get(c) is not None]
    if not values:
        return ""
    xs = [t for t, _ in points] + [f["pidx"] for f in forecasts]
    low, high, first, last = min(values), max(values), min(xs), max(xs)
    at = lambda t, v: (round(20 + 920 * (t - first) / max(last - first, 1), 1), round(220 - 200 * (v - low) / ((high - low) or 1), 1))
    out = ['<polyline fill="none" stroke="#357" points="' + " ".join("%s,%s" % at(t, v) for t, v in points) + '"/>']
    for f in forecasts:
        if f.get("p") is None:
            continue
        x, at_p = at(f["pidx"], f["p"])
        if f.get("lo") is not None and f.get("hi") is not None:
            out.append(f'<line stroke="#a42" x1="{x}" x2="{x}" y1="{at(0, f["lo"])[1]}" y2="{at(0, f["hi"])[1]}"/>')
        out.append(f'<circle fill="#a42" r="4" cx="{x}" cy="{at_p}"/>')
    return '<svg viewBox="0 0 960 240">' + "".join(out) + "</svg>"


def headline(r: dict) -> dict:
    """Label and value of each tile: the first horizon's forecast, its interval, the best model's gain, the confidence."""
    f, v = (r["forecasts"] or [{}])[0], (r["verdicts"] or [{}])[0]
    gain = v.get("oos_r2")
    used = "" if v.get("chosen") == v.get("model") else " (not used)"
    return {
        "Forecast": f"{number(f.get('p'))}" + (f" for {period_start(f['pidx'], r['freq'])}" if f else ""),
        "Interval": f"{number(f.get('lo'))} to {number(f.get('hi'))}" if "lo" in f or "hi" in f else "–",
        f"Best model's gain{used}": "–" if gain is None else f"{100 * gain:+.0f} %",
        "Confidence": v.get("confidence") or f.get("confidence") or "none",
    }


def render(r: dict) -> str:
    """The page of one series: tiles, a chart, the forecasts of all horizons, and the scores of every model."""
    name = ", ".join(str(x) for x in r["series"].values())
    points = [(p["pidx"], p["v"]) for p in r["history"] if p.get("v") is not None]
    tiles = "".join(f'<div class="tile">{html.escape(k)}<b>{html.escape(v)}</b></div>' for k, v in headline(r).items())
    ahead = [f | {"period": period_start(f["pidx"], r["freq"])} for f in r["forecasts"]]
    scores = "".join(f"<h3>Horizon {h}</h3>" + table([m for m in r["metrics"] if m["h"] == h], _COLUMNS) for h in sorted({m["h"] for m in r["metrics"]}))
    title = html.escape(f"{r['title']}: {name}")
    return (f'<!doctype html><meta charset="utf-8"><title>{title}</title><style>{_STYLE}</style><h1>{title}</h1>{tiles}{chart(points, r["forecasts"])}'
            f"<h2>Forecasts</h2>{table(ahead, ('h', 'model', 'period', 'p', 'lo', 'hi', 'up', 'confidence'))}<h2>Backtests</h2>{scores}")


def summary(out: DataFrame, title: str) -> str:
    """One page with a card for each row of ``out`` (json), in the order of title and series: a report, made on the driver."""
    runs = sorted((json.loads(r.json) for r in out.select("json").collect()), key=lambda r: (r["title"], str(r["series"])))
    rows = [{"question": r["title"], "series": ", ".join(str(x) for x in r["series"].values()), **headline(r)} for r in runs]
    cards = "".join(table([x], x) for x in rows)
    return f'<!doctype html><meta charset="utf-8"><title>{html.escape(title)}</title><style>{_STYLE}</style><h1>{html.escape(title)}</h1>{cards or "<p>No runs.</p>"}'
