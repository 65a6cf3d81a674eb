"""Evidence grading of one study as a wide projection: no shuffle, no Python.

``effects`` is ``array<struct<effect_value:double,ci_lower:double,ci_upper:double,
effect_measure:string>>``; ``text`` is the study's findings joined by spaces.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marginalia.functions.text import contains_any

EFFECT_TYPE = ("array<struct<effect_value:double,ci_lower:double,ci_upper:double,"
               "effect_measure:string>>")

# ---- fixed values: grading words, levels and wording --------------------------------------
TRIAL_TYPES = ["meta_analysis", "systematic_review", "rct", "randomized_controlled_trial"]
BIAS_WORDS = {
    "open_label": ["开放标签", "非盲", "open-label", "open label"],
    "no_blinding": ["未设盲", "单盲", "single-blind", "不设盲"],
    "small_sample": ["小样本", "small sample", "pilot", "预试验"],
    "high_attrition": ["高失访", "高脱落", "失访率高", "high dropout", "attrition"],
    "selection_bias": ["选择偏倚", "selection bias", "非随机", "non-random"],
    "no_allocation": ["未随机分组", "no randomization", "未随机"],
}
INCONSISTENCY_WORDS = ["heterogeneity", "异质性", "I²", "I2", "inconsistent", "不一致",
                       "contradictory", "矛盾", "conflicting"]
I2_MARKS = ["i²=", "i2=", "i² =", "i2 ="]
SAMPLE_SIZE = r"n\.*=?\.*(\d+)"
SAMPLE_MARKS = ["n=", "n =", "纳入", "enrolled"]
PUBLICATION_BIAS_WORDS = ["funnel plot", "漏斗图", "egger", "egger's", "publication bias",
                          "发表偏倚", "文件抽屉"]
SYNTHESIS_TYPES = ["meta_analysis", "systematic_review", "meta分析", "系统综述"]
DOSE_WORDS = ["dose-response", "剂量-反应", "dose dependent", "剂量依赖",
              "dose-response relationship", "gradient"]
ADJUSTMENT_WORDS = ["adjusted", "调整", "multivariate", "多变量",
                    "propensity score", "倾向性评分", "校准"]
PICO_PARTS = ["population", "intervention", "comparison", "outcome"]
GRADE_NAMES = {4: "HIGH", 3: "MODERATE", 2: "LOW", 1: "VERY_LOW"}
GRADE_LABELS = {4: "高 (High)", 3: "中 (Moderate)", 2: "低 (Low)", 1: "极低 (Very Low)"}
DESIGN_TRIAL, DESIGN_OBSERVATIONAL = "随机对照试验/Meta分析", "观察性研究"
STRONG, WEAK, NONE = "强推荐", "弱推荐", "不推荐(证据不足)"
DETAIL_SIGNAL = "检测到异质性或矛盾信号"
DETAIL_I2 = "报告了I²统计量(异质性指标)"
DETAIL_PICO = "PICO信息不完整: %d/4维度缺失"
DETAIL_WIDE = "CI过宽 (%.2f-%.2f, ratio=%.1f)"
DETAIL_NULL = "CI跨无效线 (%.2f-%.2f)"
DETAIL_SAMPLE = "样本量不足 (n=%s)"
DETAIL_PUBLICATION = "Meta分析未报告发表偏倚评估"
# -------------------------------------------------------------------------------------------


def normal_type(evidence_type: Column) -> Column:
    return F.replace(F.lower(evidence_type), F.lit("-"), F.lit("_"))


def initial_level(evidence_type: Column) -> Column:
    return F.when(normal_type(evidence_type).isin(TRIAL_TYPES), 4).otherwise(2)


def risk_of_bias(text: Column) -> tuple[Column, Column]:
    low = F.lower(text)
    details = F.array_compact(F.array(
        *[F.when(contains_any(low, words), issue) for issue, words in BIAS_WORDS.items()]))
    return F.greatest(F.lit(-2), -F.size(details)), details


def inconsistency(text: Column) -> tuple[Column, Column]:
    low = F.lower(text)
    details = F.array_compact(F.array(
        F.when(contains_any(low, INCONSISTENCY_WORDS), DETAIL_SIGNAL),
        F.when(contains_any(low, I2_MARKS), DETAIL_I2)))
    return F.greatest(F.lit(-2), -F.size(details)), details


def indirectness(pico: Column) -> tuple[Column, Column]:
    missing = None
    for part in PICO_PARTS:
        absent = (F.coalesce(F.try_element_at(pico, F.lit(part)), F.lit("")) == "").cast("int")
        missing = absent if missing is None else missing + absent
    return (F.when(missing >= 2, -1).otherwise(0),
            F.when(missing >= 2, F.array(F.format_string(DETAIL_PICO, missing)))
            .otherwise(F.array().cast("array<string>")))


def imprecision(text: Column, effects: Column) -> tuple[Column, Column]:
    """A wide interval downgrades; crossing 1.0 and small samples are only noted."""
    def bounded(e):
        return (F.coalesce(e["ci_lower"], F.lit(0.0)) != 0) & (F.coalesce(e["ci_upper"], F.lit(0.0)) != 0)

    def wide(e):
        return bounded(e) & (e["ci_lower"] > 0) & (e["ci_upper"] / e["ci_lower"] > 5)

    def crosses(e):
        return bounded(e) & (e["ci_lower"] < 1.0) & (e["ci_upper"] > 1.0)

    flagged = F.transform(effects, lambda e, i: F.struct(e.alias("e"), i.alias("i"), wide(e).alias("w")))
    first_wide = F.get(F.filter(flagged, lambda x: x["w"]), F.lit(0))
    seen = F.slice(effects, 1, F.coalesce(first_wide["i"] + 1, F.size(effects)))
    notes = F.filter(F.transform(seen, lambda e: F.when(
        wide(e), F.format_string(DETAIL_WIDE, e["ci_lower"], e["ci_upper"], e["ci_upper"] / e["ci_lower"]))
        .when(crosses(e), F.format_string(DETAIL_NULL, e["ci_lower"], e["ci_upper"]))),
        lambda d: d.isNotNull())
    low = F.lower(text)
    n = F.regexp_extract(low, SAMPLE_SIZE, 1)
    small = contains_any(low, SAMPLE_MARKS) & (n.try_cast("double") < 100)
    sample = F.when(small, F.array(F.format_string(DETAIL_SAMPLE, n.try_cast("bigint").cast("string")))) \
        .otherwise(F.array().cast("array<string>"))
    return F.when(first_wide.isNotNull(), -1).otherwise(0), F.concat(notes, sample)


def publication_bias(text: Column, evidence_type: Column, strict: bool = False) -> tuple[Column, Column]:
    """Syntheses that never mention publication bias. ``strict`` compares the type unnormalised."""
    kind = F.lower(evidence_type) if strict else normal_type(evidence_type)
    silent = ~contains_any(F.lower(text), PUBLICATION_BIAS_WORDS) & kind.isin(SYNTHESIS_TYPES)
    return (F.when(silent, -1).otherwise(0),
            F.when(silent, F.array(F.lit(DETAIL_PUBLICATION)))
            .otherwise(F.array().cast("array<string>")))


def large_effect(effects: Column) -> Column:
    def gain(e):
        v = e["effect_value"]
        return F.when((v > 5) | (v < 0.2), 2).when((v > 2) | (v < 0.5), 1)

    gains = F.filter(F.transform(F.filter(effects, lambda e: e["effect_value"] > 0), gain),
                     lambda g: g.isNotNull())
    return F.coalesce(F.get(gains, F.lit(0)), F.lit(0))


def recommendation(final: Column, down: Column) -> Column:
    """Levels 3 and 4 read as strong only when something was marked down, as specified."""
    return (F.when((final >= 3) & (down <= -1), STRONG).when(final >= 3, WEAK)
            .when(final == 2, WEAK).otherwise(NONE))


def clamp_level(initial: Column, down: Column, up: Column) -> Column:
    return F.greatest(F.lit(1), F.least(F.lit(4), initial + down + up))


def grade_label(level: Column) -> Column:
    from marginalia.functions.rules import lookup
    return lookup(level, GRADE_LABELS, "")


def grade_name(level: Column) -> Column:
    from marginalia.functions.rules import lookup
    return lookup(level, GRADE_NAMES, "")


def assess(text: Column, evidence_type: Column, pico: Column, effects: Column,
           strict: bool = False) -> dict[str, Column]:
    """All grading columns by name; select them together so Catalyst shares common parts."""
    low = F.lower(text)
    initial = initial_level(evidence_type)
    bias, bias_details = risk_of_bias(text)
    incons, incons_details = inconsistency(text)
    indir, indir_details = indirectness(pico)
    impr, impr_details = imprecision(text, effects)
    pub, pub_details = publication_bias(text, evidence_type, strict)
    observational = initial == 2
    large = large_effect(effects)
    dose = F.when(observational & contains_any(low, DOSE_WORDS), 1).otherwise(0)
    confounding = F.when(observational & contains_any(low, ADJUSTMENT_WORDS), 1).otherwise(0)
    return {
        "study_design": F.when(initial == 4, DESIGN_TRIAL).otherwise(DESIGN_OBSERVATIONAL),
        "initial_level": initial, "risk_of_bias": bias, "inconsistency": incons,
        "indirectness": indir, "imprecision": impr, "publication_bias": pub,
        "large_effect": large, "dose_response": dose, "residual_confounding": confounding,
        "downgrade_details": F.concat(bias_details, incons_details, indir_details,
                                      impr_details, pub_details),
    }
