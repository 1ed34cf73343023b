"""The reports once more in plain Python, row by row: labels first, sums after."""

from __future__ import annotations

import math
from collections import defaultdict

from fieldtally import domains as D


def last(x):
    """Sort key that puts a missing value last."""
    return x is None, x or ""


def rint(x):
    """Half-even int, None where it does not fit an int."""
    if x is None or math.isnan(x) or abs(x) > 2**31 - 1:
        return None
    return round(x)


def calendar(date):
    if date is None:
        return {"year": None, "month": None, "quarter": None, "week": "WeekNA"}
    return {
        "year": date.year,
        "month": date.month,
        "quarter": f"Q{(date.month + 2) // 3}",
        "week": f"Week{(date.day + 6) // 7}",
    }


def join(rows, choices, list_name, key, kh, en):
    """Left join, missing matching missing, every label of a code."""
    out = []
    for row in rows:
        found = [c for c in choices if c[0] == list_name and c[1] == row[key]] or [(0, 0, None, None)]
        for _, _, label_kh, label_en in found:
            out.append(row | {
                kh: label_kh if label_kh is not None else row[key],
                en: label_en if label_en is not None else row[key],
            })
    return out


def enrich(rows, choices, fish=True, area=True):
    rows = [r | calendar(r["date"]) for r in rows]
    for r in rows:
        bare = (r["province"] or "").lstrip("0")
        r["group"] = "Marine" if bare in ("7", "9", "18", "23") else "Inland"
    rows = join(rows, choices, "provinces", "province", "province_kh", "province_en")
    if fish:
        rows = join(rows, choices, "type", "fish_code", "fish_kh", "fish_en")
    if area:
        rows = join(rows, choices, "area", "area_code", "area_kh", "area_en")
    return rows


def labels(rows, f, area=True):
    if f.group:
        rows = [r for r in rows if r["group"] == f.group]
        if area and f.group == "Inland":
            rows = [r for r in rows if r["area_code"] in ("1", "01")
                    or any(w in (r["area_en"] or "").lower() for w in ("fresh", "inland"))]
    if f.province:
        rows = [r for r in rows if r["province_kh"] == f.province]
    if area and f.area:
        rows = [r for r in rows if r["area_en"] == f.area]
    return rows


def period(rows, f):
    if f.quarter:
        rows = [r for r in rows if r["quarter"] == f"Q{f.quarter}"]
    if f.month:
        rows = [r for r in rows if r["month"] == f.month]
    if f.week:
        rows = [r for r in rows if r["week"] == f"Week{f.week}"]
    return rows


def years(rows, f, span):
    if f.year is None:
        return rows
    return [r for r in rows if r["year"] is not None and f.year - span <= r["year"] <= f.year]


def province_years(rows, f, area, kind, provinces, restrict, without):
    rows = [r for r in rows if r["area_code"] == area and (kind is None or r["fishing_type"] == kind)]
    if without:
        rows = [r for r in rows if r["province_kh"] is not None and r["province_kh"] != without]
    if restrict:
        rows = [r for r in rows if r["province_kh"] in provinces]
    rows = labels(rows, f)
    rows = years(rows, f, 1)
    columns = (
        [f.year - 1, f.year] if f.year is not None
        else sorted({r["year"] for r in rows if r["year"] is not None})
    )
    rows = period(rows, f)
    if provinces is None:
        first = {}
        for r in rows:
            first[r["province_kh"]] = min(first.get(r["province_kh"], math.inf), r["id"])
        provinces = sorted(first, key=lambda p: (first[p], p))
    sums = defaultdict(int)
    for r in rows:
        sums[r["province_kh"], r["year"]] += rint(r["catch"]) or 0
    return ["province_kh", *map(str, columns)], [
        (p, *[sums[p, y] for y in columns]) for p in provinces
    ]


def species(rows, f, marine):
    rows = [r for r in rows if r["date"] and (rint(r["catch"]) or 0) > 0]
    if marine:
        without = (None, D.EXCLUDED_FROM_MARINE)
        rows = [r for r in rows if r["area_code"] == "2" and r["province_kh"] not in without]
    rows = period(years(labels(rows, f), f, 0), f)
    sums = defaultdict(int)
    for r in rows:
        sums[r["fish_kh"], r["province_kh"]] += rint(r["catch"])
    shown = sorted(sums, key=lambda k: (last(k[0]), last(k[1])))
    columns = list(dict.fromkeys(p for _, p in shown))
    table = []
    for fish in dict.fromkeys(k[0] for k in shown):
        cells = [sums.get((fish, p), 0) for p in columns]
        table.append((fish, *cells, sum(cells)))
    table.sort(key=lambda r: (-r[-1], last(r[0])))
    return ["fish_name_kh", *["NA" if p is None else p for p in columns], D.TOTAL], table[: D.TOP_SPECIES] if marine else table


def aquaculture(rows, f, detail):
    rows = [r for r in rows if r["catch"] is not None and r["catch"] > 0]
    if detail:
        rows = [r | {"province_kh": r["province_kh"] and r["province_kh"].strip(" ")} for r in rows]
    else:
        rows = [r for r in rows if r["fish_code"] in D.SPECIES]
    rows = period(labels(years(rows, f, 1), f), f)
    table = defaultdict(lambda: defaultdict(float))
    for r in rows:
        cells = table[r["province_kh"]]
        if r["fish_code"] in D.SPECIES:
            cells[D.SPECIES[r["fish_code"]]] += r["catch"]
        if r["area_code"] in ("1", "01"):
            cells[D.FRESH_FISH] += r["catch"]
        if r["area_code"] == "2":
            cells[D.SEA_FISH] += r["catch"]
    columns = ([D.FRESH_FISH, D.SEA_FISH] if detail else []) + list(D.SPECIES.values())
    out = []
    for p, cells in table.items():
        row = [p, *[rint(cells[c]) for c in columns], rint(sum(cells[c] for c in columns))]
        if detail:
            row.append(rint(cells[D.FRESH_FISH] + cells[D.SEA_FISH]))
        out.append(tuple(row))
    total = len(columns) + 1
    return sorted(out, key=lambda r: (-r[total], last(r[0])))


def facilities(rows, f):
    rows = period(labels(years(rows, f, 1), f), f)
    counts = defaultdict(lambda: [0, 0, 0])
    for r in rows:
        words = set((r["aqu_type"] or "").lower().replace("_", " ").replace("-", " ").split())
        flags = [bool(words & set(D.FACILITIES[k])) for k in ("plastic soung", "ponds", "batches")]
        if any(flags):
            cells = counts[r["province_kh"]]
            for i, flag in enumerate(flags):
                cells[i] += flag
    if f.province is None:
        for p in D.PROVINCES:
            counts[p]
    place = {p: i for i, p in enumerate(D.PROVINCES)}
    order = sorted(counts, key=lambda p: (place.get(p, 99), last(p)))
    return [(p, *counts[p]) for p in order]


def enforcement(patrol, everything, choices, f):
    import re

    rows = period(labels(years(patrol, f, 1), f, area=False), f)
    counts = defaultdict(lambda: [0, 0, 0])
    codes = list(D.OUTCOMES)
    for r in rows:
        for code in re.findall(r"\d+", r["patrol_enforcement"] or ""):
            if code in codes:
                counts[r["province_kh"]][codes.index(code)] += 1
    english = {}
    for r in everything:
        if r["province_kh"] is not None and r["province_en"] is not None:
            english[r["province_kh"]] = min(english.get(r["province_kh"], r["province_en"]), r["province_en"])
    if f.group:
        offered = {
            c[2] for c in choices if c[0] == "provinces"
            and (((c[1] or "").lstrip("0") in ("7", "9", "18", "23")) == (f.group == "Marine"))
        }
        english = {p: e for p, e in english.items() if p in offered}
    for p in english:
        counts[p]
    order = sorted(counts, key=lambda p: (p not in english, english.get(p, ""), last(p)))
    return [(p, *counts[p]) for p in order]
