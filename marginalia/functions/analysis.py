"""Figure and table analyses returned by a vision model, turned into searchable text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OUTCOME_TYPE = ("array<struct<outcome_name:string,effect_measure:string,effect_value:string,"
                "ci_lower:string,ci_upper:string,p_value:string>>")
CHARACTERISTIC_TYPE = ("array<struct<variable:string,group1_value:string,"
                       "group2_value:string,p_value:string>>")
ANALYSIS_TYPE = (f"chart_type string, summary string, description string, "
                 f"study_groups array<string>, total_patients bigint, outcomes {OUTCOME_TYPE}, "
                 f"characteristics {CHARACTERISTIC_TYPE}, error string")


def _t(x: Column) -> Column:
    return F.coalesce(x, F.lit(""))


def outcome_line(o: Column) -> Column:
    return F.concat(_t(o["outcome_name"]), F.lit(": "), _t(o["effect_measure"]), F.lit("="),
                    _t(o["effect_value"]), F.lit(", 95%CI "), _t(o["ci_lower"]), F.lit("-"),
                    _t(o["ci_upper"]), F.lit(", p="), _t(o["p_value"]))


def characteristic_line(c: Column) -> Column:
    return F.concat(_t(c["variable"]), F.lit(": 组1="), _t(c["group1_value"]), F.lit(", 组2="),
                    _t(c["group2_value"]), F.lit(", p="), _t(c["p_value"]))


def analysis_lines(analysis: Column, keep: int = 15) -> Column:
    """One text line per reported row of a baseline or outcome table."""
    kind = analysis["chart_type"]
    return (F.when(kind == "baseline_table",
                   F.transform(F.slice(analysis["characteristics"], 1, keep), characteristic_line))
            .when(kind == "outcome_table",
                  F.transform(F.slice(analysis["outcomes"], 1, keep), outcome_line))
            .otherwise(F.array().cast("array<string>")))


def _html_row(tag: str, cells: list[Column]) -> Column:
    parts = [F.lit("<tr>")]
    for c in cells:
        parts += [F.lit(f"<{tag}>"), c, F.lit(f"</{tag}>")]
    return F.concat(*parts, F.lit("</tr>"))


def analysis_html(analysis: Column, keep: int = 20) -> Column:
    """The same rows as an HTML table, empty where the analysis reports none."""
    base = F.concat(
        F.lit("<table>"), _html_row("th", [F.lit(h) for h in ("变量", "组1", "组2", "p值")]),
        F.array_join(F.transform(
            F.slice(analysis["characteristics"], 1, keep),
            lambda c: _html_row("td", [_t(c["variable"]), _t(c["group1_value"]),
                                       _t(c["group2_value"]), _t(c["p_value"])])), ""),
        F.lit("</table>"))
    outc = F.concat(
        F.lit("<table>"), _html_row("th", [F.lit(h) for h in ("结局", "效应量", "95%CI", "p值")]),
        F.array_join(F.transform(
            F.slice(analysis["outcomes"], 1, keep),
            lambda o: _html_row("td", [
                _t(o["outcome_name"]),
                F.concat(_t(o["effect_measure"]), F.lit(" "), _t(o["effect_value"])),
                F.concat(_t(o["ci_lower"]), F.lit("-"), _t(o["ci_upper"])),
                _t(o["p_value"])])), ""),
        F.lit("</table>"))
    kind = analysis["chart_type"]
    return (F.when((kind == "baseline_table") & (F.size(analysis["characteristics"]) > 0), base)
            .when((kind == "outcome_table") & (F.size(analysis["outcomes"]) > 0), outc)
            .otherwise(""))


def enhanced_caption(analysis: Column, chart_type: Column) -> Column:
    """Caption written from the analysis of a baseline, outcome or other figure."""
    groups = F.when(F.size(analysis["study_groups"]) > 0,
                    F.concat(F.lit("研究分组: "), F.array_join(analysis["study_groups"], " vs ")))
    total = F.when(analysis["total_patients"] > 0,
                   F.concat(F.lit("总例数: "), analysis["total_patients"].cast("string")))
    baseline = F.concat_ws(". ", groups, total)
    outcomes = F.array_join(F.transform(
        analysis["outcomes"],
        lambda o: F.concat(_t(o["outcome_name"]), F.lit(": "), _t(o["effect_measure"]), F.lit("="),
                           _t(o["effect_value"]), F.lit(", 95%CI ["), _t(o["ci_lower"]), F.lit("-"),
                           _t(o["ci_upper"]), F.lit("], p="), _t(o["p_value"]))), "; ")
    plain = F.coalesce(analysis["summary"], analysis["description"], F.lit(""))
    return (F.when(analysis["error"].isNotNull(),
                   F.to_json(F.struct(analysis["error"].alias("error"))))
            .when(chart_type == "baseline_characteristics",
                  F.when(baseline != "", baseline).otherwise("基线特征表"))
            .when(chart_type == "outcome_measures",
                  F.when(F.coalesce(outcomes, F.lit("")) != "", outcomes).otherwise("结局指标表"))
            .otherwise(plain))
