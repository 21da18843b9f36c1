"""The catalog of contrasts: headers, defaults and checks. It is small and stays on the driver."""

from __future__ import annotations

import csv
import difflib

# Required columns, other columns with their defaults, other names of columns, yes and no.
REQUIRED = ("study_id", "paper_id", "source_path", "gene_column", "lfc_column", "p_column")
DEFAULTS = {
    "source_unit_id": "", "source_url": "", "pipeline": "unknown_pipeline", "species": "", "cell_system": "",
    "hypoxia_modality": "", "duration_h": "", "n_ctrl": "", "n_treat": "", "padj_column": "", "sep": "", "sheet_name": "",
    "gene_type_column": "", "gene_type_keep": "", "assay_type": "", "source_input_type": "", "platform": "",
    "normalization": "", "probe_id_column": "", "probe_collapse": "", "time_course_mode": "mean", "temporal_mode": "",
    "table_scope": "auto", "rank_universe_size": "", "sign_convention": "", "include_in_analysis": "yes", "notes": "",
}
ALIASES = {
    "source_unit_id": "paper_id", "condition": "hypoxia_modality", "contrast_label": "hypoxia_modality", "time_h": "duration_h",
    "result_scope": "table_scope", "input_scope": "table_scope", "tested_gene_count": "rank_universe_size",
    "rank_universe": "rank_universe_size", "technology": "assay_type", "assay": "assay_type", "input_type": "source_input_type",
    "platform_id": "platform", "array_platform": "platform", "probe_column": "probe_id_column",
    "probe_collapse_rule": "probe_collapse", "time_mode": "time_course_mode", "temporal_aggregation": "time_course_mode",
    "include": "include_in_analysis",
}
#: Lines that may be comments; a study below them may begin with #.
COMMENTS = 20
TRUE = ("1", "true", "t", "yes", "y", "include", "included")
FALSE = ("0", "false", "f", "no", "n", "exclude", "excluded")
MODES = ("", "auto", "all", "mean", "source_mean", "average", "first", "earliest", "early", "last", "latest", "late", "peak", "peak_mean", "strongest_window")


def header_key(name: str) -> str:
    return name.strip().lower().replace("-", "_").replace(" ", "_")


def included(value: str | None) -> bool:
    """Whether a row takes part: blank means yes."""
    text = (value or "").strip().lower().removesuffix(".0")
    if text in ("", *TRUE):
        return True
    if text in FALSE:
        return False
    raise ValueError(f"include_in_analysis must be yes or no, not {value!r}")


def whole_number(value: str, name: str) -> int | None:
    """A positive whole number, None for a blank."""
    if not value.strip():
        return None
    number = float(value)
    if number <= 0 or number != int(number):
        raise ValueError(f"{name} must be a positive whole number, not {value!r}")
    return int(number)


def normalized(rows: list[dict[str, str]]) -> list[dict[str, str]]:
    """Rows under canonical names: case, blanks and hyphens don't matter, aliases fill blanks, defaults fill the rest."""
    names = list(rows[0]) if rows else []
    known = {*REQUIRED, *DEFAULTS}
    keys = [header_key(n) for n in names]
    for k in known:
        if keys.count(k) > 1 and k not in names:
            raise ValueError(f"several headers stand for {k}: {[n for n, x in zip(names, keys) if x == k]}")
    missing = [c for c in REQUIRED if c not in keys and not any(ALIASES.get(x) == c for x in keys)]
    if rows and missing:
        hints = {c: difflib.get_close_matches(c, keys, 1) for c in missing}
        raise ValueError(f"the catalog lacks columns {missing}; close ones: {hints}")
    out = []
    for row in rows:
        own: dict[str, str] = {}
        for name, value in row.items():
            key = header_key(name)
            if key in known and (name == key or not own.get(key)):
                own[key] = (value or "").strip()
        for name, value in row.items():
            key = ALIASES.get(header_key(name))
            if key and not own.get(key):
                own[key] = (value or "").strip()
        out.append({c: own.get(c, "") for c in REQUIRED} | {c: own.get(c) or d for c, d in DEFAULTS.items()})
    return out


def checked(rows: list[dict[str, str]]) -> list[dict[str, str]]:
    """The rows that take part, checked: required values, unique studies, scopes, modes, counts."""
    from concordat.functions.text import SCOPES

    active = [r for r in rows if included(r["include_in_analysis"])]
    for k, r in enumerate(active):
        where = f"catalog row {k + 1} ({r['study_id']})"
        blank = [c for c in REQUIRED if not r[c]]
        if blank:
            raise ValueError(f"{where}: {blank} must not be blank")
        if header_key(r["table_scope"]) not in {x for names in SCOPES.values() for x in names}:
            raise ValueError(f"{where}: unknown table_scope {r['table_scope']!r}")
        if header_key(r["time_course_mode"]) not in MODES:
            raise ValueError(f"{where}: unknown time_course_mode {r['time_course_mode']!r}")
        whole_number(r["rank_universe_size"], f"{where}: rank_universe_size")
        counts = [whole_number(r[c], f"{where}: {c}") for c in ("n_ctrl", "n_treat")]
        if (counts[0] is None) != (counts[1] is None):
            raise ValueError(f"{where}: n_ctrl and n_treat must both be there or both be missing")
    ids = [r["study_id"] for r in active]
    if repeated := sorted({x for x in ids if ids.count(x) > 1}):
        raise ValueError(f"studies are listed twice: {repeated}")
    return active


def read_catalog(path: str) -> list[dict[str, str]]:
    """Catalog rows of a CSV file or of an .xlsx file's Contrasts sheet (or its only one)."""
    if path.lower().endswith(".xlsx"):
        from concordat.sources.ooxml import read_sheets

        sheets = read_sheets(path)
        table = sheets.get("Contrasts") or (next(iter(sheets.values())) if len(sheets) == 1 else None)
        if table is None:
            raise ValueError(f"{path} has no sheet named Contrasts")
        table = [r for k, r in enumerate(table) if any(r) and not (k < COMMENTS and str(r[0] or "").startswith("#"))]
        head = [str(c or "") for c in table[0]]
        return normalized([{h: "" if v is None else str(v) for h, v in zip(head, r)} for r in table[1:]])
    with open(path, newline="", encoding="utf-8-sig") as file:
        lines = (line for k, line in enumerate(file) if line.strip() and not (k < COMMENTS and line.startswith("#")))
        return normalized(list(csv.DictReader(lines)))
