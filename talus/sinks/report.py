"""Summary as JSON, and the report as Markdown and HTML."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass
from html import escape
from pathlib import Path
from typing import Any

from ..functions.crs import epsg
from ..plans.pipeline import Products
from ..plans.validation import Check
from .vectors import number


@dataclass(frozen=True)
class RunMetadata:
    title: str
    source: str
    land_status: str = ""
    notes: str = ""


def crs_label(crs: str | None) -> str:
    code = epsg(crs)
    return f"EPSG:{code}" if code else (crs or "unknown")[:60]


def rounded(value: Any, places: int = 4) -> Any:
    """Floats rounded half to even, in any nesting; what JSON can't hold is null."""
    if isinstance(value, dict):
        return {str(k): rounded(v, places) for k, v in value.items()}
    if isinstance(value, list | tuple):
        return [rounded(v, places) for v in value]
    return number(value, places)


def build_summary(products: Products, meta: RunMetadata, drainage: list[dict[str, Any]], checks: list[Check] | None = None) -> dict[str, Any]:
    out = {
        "run": asdict(meta) | {"crs": crs_label(products.grid.crs)},
        "statistics": products.stats.first().asDict(),
        "classes": [r.asDict() for r in products.class_areas.orderBy("code").collect()],
        "zones": [r.asDict() for r in products.zone_summary.orderBy("zone_id").collect()] if products.zone_summary is not None else [],
        "reaches": [f["properties"] for f in drainage],
    }
    return rounded(out | ({"validation": [asdict(c) for c in checks]} if checks else {}))


def write_summary_json(path: str | Path, summary: dict[str, Any]) -> None:
    Path(path).write_text(json.dumps(summary, indent=2, ensure_ascii=False, allow_nan=False) + "\n", encoding="utf-8")


Table = tuple[str, list[str], list[list[str]]]


def tables(summary: dict[str, Any]) -> list[Table]:
    s = summary["statistics"]
    show = lambda v, unit="": "n/a" if v is None else f"{v:,.2f}{unit}" if isinstance(v, float) else f"{v:,}{unit}"
    key = [
        ["Points", show(s["points_total"])],
        ["Ground points", show(s["points_ground"])],
        ["Site", show(s["area_acres"], " ac")],
        ["Elevation", f"{show(s['elevation_min_m'])} to {show(s['elevation_max_m'], ' m')}"],
        ["Mean slope", show(s["slope_mean_deg"], " deg")],
        ["Highest canopy", show(s["canopy_max_m"], " m")],
        ["Woody cover", show(s["woody_acres"], " ac")],
        ["Treatment cover", show(s["treatment_acres"], " ac")],
        ["Channels", show(s["channel_length_m"], " m")],
        ["Sinks", show(s["sink_acres"], " ac")],
    ]
    out: list[Table] = [("Key numbers", ["Measure", "Value"], key)]
    out.append(("Height classes", ["Class", "Cells", "Acres", "Percent"], [[c["name"], show(c["cells"]), show(c["area_acres"]), show(c["percent"])] for c in summary["classes"]]))
    if summary["zones"]:
        out.append(("Zones", ["Zone", "Acres", "Woody acres", "Treatment acres", "Mean slope"], [[z["name"], show(z["total_acres"]), show(z["woody_acres"]), show(z["treatment_acres"]), show(z["mean_slope_deg"])] for z in summary["zones"]]))
    if summary.get("validation"):
        out.append(("Validation", ["Check", "Value", "Limit", "Result"], [[c["name"], f"{c['value']:.4f}" if c["value"] is not None else "n/a", f"{c['comparison']} {c['limit']:g}", "pass" if c["passed"] else "FAIL"] for c in summary["validation"]]))
    return out


def write_markdown(path: str | Path, summary: dict[str, Any]) -> None:
    run = summary["run"]
    lines = [f"# {run['title']}", "", f"Source: {run['source']}. Coordinates: {run['crs']}.", *([run["land_status"]] if run["land_status"] else []), *([run["notes"]] if run["notes"] else [])]
    for title, head, rows in tables(summary):
        lines += ["", f"## {title}", "", "| " + " | ".join(head) + " |", "|" + "---|" * len(head), *("| " + " | ".join(c.replace("|", "\\|") for c in r) + " |" for r in rows)]
    Path(path).write_text("\n".join(lines) + "\n", encoding="utf-8")


def write_html(path: str | Path, summary: dict[str, Any]) -> None:
    run = summary["run"]
    parts = [f"<h1>{escape(run['title'])}</h1><p>Source: {escape(run['source'])}. Coordinates: {escape(run['crs'])}.</p>", *(f"<p>{escape(run[k])}</p>" for k in ("land_status", "notes") if run[k])]
    for title, head, rows in tables(summary):
        body = "".join("<tr>" + "".join(f"<td>{escape(c)}</td>" for c in r) + "</tr>" for r in rows)
        parts.append(f"<h2>{escape(title)}</h2><table><tr>{''.join(f'<th>{escape(h)}</th>' for h in head)}</tr>{body}</table>")
    style = "body{font-family:sans-serif;max-width:60em;margin:2em auto}td,th{padding:.2em .8em;text-align:left;border-bottom:1px solid #ddd}"
    Path(path).write_text(f'<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>{escape(run["title"])}</title><style>{style}</style></head><body>{"".join(parts)}</body></html>\n', encoding="utf-8")
