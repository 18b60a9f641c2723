"""Requirement presets: a folder of YAML files as a small nested table."""

from __future__ import annotations

import logging
from collections.abc import Iterable
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.schemas import SECTION_KEYS

LOG = logging.getLogger(__name__)
#: A preset table is broadcast; more presets than this are refused.
MOST = 10_000
#: Presets that come with the package.
SHIPPED = str(Path(__file__).resolve().parent.parent / "resources" / "presets")

# What a preset has where its file is silent.
DEFAULTS: dict[str, dict[str, Any]] = {
    "page": {"size": "A4", "orientation": "portrait"},
    "margins": {"tolerance_mm": 1.0},
    "font": {"tolerance_pt": 0.5, "allow_headings_bold": True, "max_foreign_font_share_pct": 5.0},
    "paragraph": {"alignment": "justify", "first_line_indent_cm": 1.25, "indent_tolerance_cm": 0.15, "line_spacing": 1.5, "line_spacing_tolerance": 0.1, "max_left_indent_cm": 0.5, "max_right_indent_cm": 0.5},
    "headings": {"require_numbering": True, "max_level": 3, "require_page_break_before_top_level": False, "require_top_level_heading_format": False},
    "structure": {"required_sections": [], "optional_sections": [], "min_words_introduction": 250, "min_words_conclusion": 200},
    "references": {"min_sources": 15, "require_in_text_citations": True, "max_allowed_duplicate_sources": 0},
    "scoring": {"formatting": 30, "structure": 20, "language": 15, "style": 10, "content": 25},
    "scoring_policy": {"version": "2", "critical": 0.35, "error": 0.15, "warning": 0.05},
    "provenance": {"status": "unverified", "scope": "", "sources": [], "reviewed_on": ""},
}
NEEDED = {"margins": ("top_mm", "bottom_mm", "left_mm", "right_mm"), "font": ("name", "size_pt")}
WORK_TYPES = ("coursework", "diploma", "essay", "practice_report")
SCHEMA = (
    "id string, name string, institution string, work_type string, description string, page struct<size:string,orientation:string>, "
    "margins struct<top_mm:double,bottom_mm:double,left_mm:double,right_mm:double,tolerance_mm:double>, "
    "font struct<name:string,size_pt:double,tolerance_pt:double,allow_headings_bold:boolean,max_foreign_font_share_pct:double>, "
    "paragraph struct<alignment:string,first_line_indent_cm:double,indent_tolerance_cm:double,line_spacing:double,line_spacing_tolerance:double,max_left_indent_cm:double,max_right_indent_cm:double>, "
    "headings struct<require_numbering:boolean,max_level:int,require_page_break_before_top_level:boolean,require_top_level_heading_format:boolean>, "
    "structure struct<required_sections:array<string>,optional_sections:array<string>,min_words_introduction:int,min_words_conclusion:int>, "
    "references struct<min_sources:int,require_in_text_citations:boolean,max_allowed_duplicate_sources:int>, "
    "scoring struct<formatting:int,structure:int,language:int,style:int,content:int>, "
    "scoring_policy struct<version:string,critical:double,error:double,warning:double>, "
    "provenance struct<status:string,scope:string,sources:array<string>,reviewed_on:string>, advisory_rules array<string>, is_active boolean"
)
_FLOATS = {"margins", "paragraph"}


def preset(raw: dict[str, Any]) -> dict[str, Any]:
    """A complete preset from what a file says; ValueError if it can't be right."""
    if not isinstance(raw, dict) or not all(raw.get(k) for k in ("id", "name", "institution")):
        raise ValueError("id, name and institution are needed")
    out = {k: raw.get(k) or "" for k in ("id", "name", "institution", "work_type", "description")}
    out |= {k: dict(v) | (raw.get(k) or {}) for k, v in DEFAULTS.items()}
    out |= {"advisory_rules": list(raw.get("advisory_rules") or []), "is_active": bool(raw.get("is_active", True))}

    def need(ok: bool, why: str) -> None:
        if not ok:
            raise ValueError(f"preset {out['id']}: {why}")

    for part, keys in NEEDED.items():
        need(all(out[part].get(k) is not None for k in keys), f"{part} is incomplete")
    for part in _FLOATS:
        out[part] = {k: float(v) if isinstance(v, int) and not isinstance(v, bool) else v for k, v in out[part].items()}
        need(all(v >= 0 for v in out[part].values() if isinstance(v, float)), f"{part} has a negative length")
    for k in ("size_pt", "tolerance_pt", "max_foreign_font_share_pct"):
        out["font"][k] = float(out["font"][k])
    need(out["font"]["size_pt"] > 0 and 0 <= out["font"]["max_foreign_font_share_pct"] <= 100, "font is out of range")
    need(out["work_type"] in WORK_TYPES, "unknown work type")
    need(1 <= out["headings"]["max_level"] <= 9, "heading level is out of range")
    for k in ("required_sections", "optional_sections"):
        keys = out["structure"][k]
        need(len(set(keys)) == len(keys) and set(keys) <= set(SECTION_KEYS), "sections must be known and unique")
    weights = out["scoring"].values()
    need(all(x >= 0 for x in weights) and sum(weights) == 100, "weights must sum to 100")
    policy = out["scoring_policy"]
    for k in ("critical", "error", "warning"):
        policy[k] = float(policy[k])
    need(1 >= policy["critical"] >= policy["error"] >= policy["warning"] >= 0, "penalties must fall with severity")
    origin = out["provenance"]
    need(origin["status"] == "unverified" or all((origin["scope"].strip(), origin["sources"], origin["reviewed_on"].strip())), "a verified preset needs scope, sources and date")
    return out


def taken(files: Iterable[tuple[str, str]]) -> list[dict[str, Any]]:
    """Presets of named YAML texts, in the order of names; bad ones are logged and left out, a later id wins."""
    import yaml

    found: dict[str, dict[str, Any]] = {}
    for name, text in sorted(files):
        try:
            p = preset(yaml.safe_load(text))
        except (ValueError, TypeError, KeyError, yaml.YAMLError) as e:
            LOG.warning("preset %s left out: %s", name, e)
            continue
        found[p["id"]] = p
    return list(found.values())


def load_presets(folder: str) -> list[dict[str, Any]]:
    """Presets of a folder on this machine, `-` for those of the package."""
    folder = SHIPPED if folder == "-" else folder
    return taken((path.name, path.read_text(encoding="utf-8")) for path in Path(folder).glob("*.yaml"))


def read_presets(spark: SparkSession, folder: str) -> list[dict[str, Any]]:
    """Presets of a folder in any store that Spark reads (S10); more files than can be presets are refused before they are fetched."""
    files = spark.read.option("pathGlobFilter", "*.yaml").text(folder, wholetext=True)
    rows = files.select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("name"), "value").limit(MOST + 1).collect()
    if len(rows) > MOST:
        raise ValueError(f"at most {MOST} presets can be broadcast")
    return taken((r["name"], r["value"]) for r in rows)


def preset_table(spark: SparkSession, presets: list[dict[str, Any]]) -> DataFrame:
    if len(presets) > MOST:
        raise ValueError(f"at most {MOST} presets can be broadcast")
    return spark.createDataFrame(presets, SCHEMA)


def active(presets: DataFrame) -> DataFrame:
    return presets.where("is_active")


def by_id(presets: DataFrame, key: str) -> DataFrame:
    """The active preset of this id; fails if there is none."""
    one = active(presets).where(F.col("id") == key)
    if one.isEmpty():
        raise KeyError(f"no active preset {key}")
    return one


def institutions(presets: DataFrame) -> DataFrame:
    return active(presets).select("institution").distinct().orderBy("institution")


def of_institution(presets: DataFrame, institution: str) -> DataFrame:
    return active(presets).where(F.col("institution") == institution)


# Fixed value: the order in which kinds of work are offered.
WORK_ORDER = ("coursework", "diploma", "essay", "practice_report")


def work_types(presets: DataFrame, institution: str) -> DataFrame:
    """The kinds of work of an institution's active presets in the order they are offered, unknown ones last."""
    place = F.array_position(F.array(*map(F.lit, WORK_ORDER)), F.col("work_type"))
    return of_institution(presets, institution).select("work_type").distinct().orderBy(F.when(place == 0, len(WORK_ORDER) + 1).otherwise(place), "work_type")
