"""Ordered keyword rules: the first label with any keyword in the (lower-cased) text wins.

A rule set is a list of ``(label, [keywords])`` in priority order. Keywords are searched one by one
until one is there; of many, a text is scanned once for all, and the hit with the best priority names
the label. Rule sets are parameters; the tables below are the defaults.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from marginalia.functions.text import contains_any, count_present, found, occurrences, refine_query, strip

Rules = list[tuple[str, list[str]]]

# ---- fixed values: section tags, specific ones before broad ones --------------------------
SECTION_RULES: Rules = [
    ("primary_outcome", ["主要结局", "主要终点", "主要指标", "主要疗效",
                         "primary endpoint", "primary end point", "primary outcome"]),
    ("secondary_outcome", ["次要结局", "次要终点", "次要指标",
                           "secondary endpoint", "secondary outcome"]),
    ("subgroup_analysis", ["亚组", "分层分析", "子组", "subgroup", "stratified"]),
    ("sensitivity_analysis", ["敏感性分析", "敏感度分析", "sensitivity analysis",
                              "sensitivity analyses", "稳健性检验", "robustness"]),
    ("safety", ["安全性", "不良事件", "不良反应", "并发症",
                "safety", "adverse event", "adverse effect", "complication"]),
    ("population", ["纳入标准", "排除标准", "入排标准", "研究对象", "患者选择",
                    "inclusion criteria", "exclusion criteria", "eligibility",
                    "纳入", "排除", "入选标准"]),
    ("intervention", ["干预", "治疗", "手术", "药物", "方案",
                      "intervention", "treatment", "therapy", "regimen"]),
    ("statistical", ["统计学", "统计分析", "统计方法", "样本量",
                     "statistical analysis", "sample size"]),
    ("methods", ["方法", "材料与方法", "资料与方法", "研究对象与方法",
                 "methods", "materials and methods", "patients and methods"]),
    ("results", ["结果", "结局", "疗效", "results", "outcomes", "findings"]),
    ("objective", ["目的", "目标", "研究目的", "objective", "aim", "purpose"]),
    ("discussion", ["讨论", "分析", "discussion", "analysis"]),
    ("conclusion", ["结论", "总结", "小结", "展望", "conclusion", "summary"]),
    ("background", ["背景", "引言", "前言", "绪论", "background", "introduction"]),
]
SECTION_PREFIX = 300
SECTION_LABELS = [label for label, _ in SECTION_RULES]

# ---- fixed values: study design, strongest first ------------------------------------------
EVIDENCE_TYPE_RULES: Rules = [
    ("meta_analysis", ["meta分析", "荟萃分析", "系统综述", "系统评价",
                       "meta-analysis", "systematic review", "meta analysis"]),
    ("rct", ["随机对照", "随机双盲", "rct", "randomized controlled trial",
             "随机分组", "随机临床试验"]),
    ("cohort_study", ["队列研究", "前瞻性研究", "回顾性队列", "cohort study", "prospective cohort"]),
    ("case_control", ["病例对照", "case-control", "病例-对照"]),
    ("case_report", ["病例报告", "病例系列", "个案报道", "case report", "case series"]),
    ("expert_consensus", ["专家共识", "临床指南", "指导原则",
                          "expert consensus", "guideline", "consensus"]),
    ("narrative_review", ["综述", "文献综述", "narrative review", "review article"]),
]
EVIDENCE_TYPE_LEVEL = {"meta_analysis": 1, "rct": 2, "cohort_study": 3, "case_control": 4,
                       "case_report": 5, "expert_consensus": 6, "narrative_review": 7}
EVIDENCE_PREFIX = 2000

# ---- fixed values: evidence labels shown with hits, and the matrix variant ----------------
EVIDENCE_LABEL_RULES: Rules = [
    ("Meta-analysis", ["meta-analysis", "meta分析", "systematic review", "系统综述", "pooled analysis"]),
    ("RCT", ["randomized", "随机对照", "rct", "randomised"]),
    ("Cohort", ["cohort", "队列", "prospective", "前瞻性", "retrospective", "回顾性"]),
    ("Case-control", ["case-control", "病例对照", "case control"]),
    ("Case-series", ["case report", "case series", "病例报告", "病例系列"]),
]
MATRIX_LABEL_RULES: Rules = [
    ("Meta-analysis", ["meta-analysis", "meta分析", "systematic review"]),
    ("RCT", ["randomized", "随机对照", "rct"]),
    ("Cohort", ["cohort", "队列", "prospective"]),
    ("Case-control", ["case-control", "病例对照"]),
    ("Expert-opinion", ["expert consensus", "guideline", "指南", "共识"]),
]
MATRIX_LABEL_ORDER = {"Meta-analysis": 0, "RCT": 1, "Cohort": 2, "Case-control": 3,
                      "Case-series": 4, "Expert-opinion": 5, "unknown": 6}

# ---- fixed values: evidence level from text and title, short and long keyword lists -------
EVIDENCE_LEVEL_RULES: Rules = [
    ("1", ["meta-analysis"]),
    ("2", ["randomized", "rct"]),
    ("3", ["cohort", "prospective"]),
    ("4", ["case-control"]),
    ("5", ["case report", "case series"]),
    ("6", ["expert consensus", "guideline"]),
    ("7", ["review"]),
]
EVIDENCE_LEVEL_RULES_LONG: Rules = [
    ("1", ["meta-analysis", "meta analysis", "systematic review"]),
    ("2", ["randomized", "randomised", "rct"]),
    ("3", ["cohort", "prospective study"]),
    ("4", ["case-control", "case control"]),
    ("5", ["case report", "case series"]),
    ("6", ["expert consensus", "guideline", "expert opinion"]),
    ("7", ["review", "narrative review"]),
]

# ---- fixed values: chunk types, long and short forms --------------------------------------
CHUNK_TYPE_RULES: Rules = [
    ("baseline_table", ["baseline", "characteristics", "table 1", "table\n1"]),
    ("primary_outcome", ["primary endpoint", "primary outcome", "end point", "major endpoint"]),
    ("methods_design", ["study design", "patient population", "inclusion criteria", "exclusion"]),
    ("safety_outcome", ["adverse", "safety", "bleeding", "complication", "mortality rate"]),
    ("figure_description", ["figure", "fig.", "curve", "plot", "chart", "graph"]),
    ("abbreviations", ["abbreviation", "acronym"]),
    ("discussion", ["limitation", "finding", "suggest", "may", "might"]),
    ("conclusion", ["conclusion", "summary", "in conclusion"]),
    ("references", ["references", "cited", "et al", "journal", "doi"]),
    ("secondary_outcome", ["secondary", "subgroup", "sensitivity analysis"]),
]
CHUNK_TYPE_RULES_SHORT: Rules = [
    ("baseline_table", ["baseline", "characteristics", "table 1"]),
    ("primary_outcome", ["primary endpoint", "primary outcome", "end point"]),
    ("methods_design", ["study design", "patient population", "randomized"]),
    ("safety_outcome", ["adverse", "safety", "bleeding", "complication"]),
    ("figure_description", ["figure", "curve", "plot", "chart"]),
]

# ---- fixed values: entity group word lists (guideline before check) -----------------------
DISEASE_WORDS = [
    "disease", "dysfunction", "failure", "stenosis", "regurgitation", "syndrome", "infarction",
    "ischemia", "thrombosis", "embolism", "aneurysm", "dissection", "atherosclerosis",
    "calcification", "endometriosis", "adenomyosis", "hyperplasia", "necrosis", "fibrosis",
    "cirrhosis", "carcinoma", "adenoma", "sarcoma", "melanoma", "lymphoma",
    "病", "症", "癌", "瘤", "衰竭", "梗死", "栓塞", "夹层", "狭窄", "关闭不全"]
DRUG_WORDS = [
    "drug", "medication", "inhibitor", "blocker", "antagonist", "agonist", "statin", "antibiotic",
    "aspirin", "heparin", "warfarin", "metformin", "insulin", "corticosteroid", "opioid",
    "analgesic", "diuretic", "vasodilator", "vasopressor", "inotrope", "anticoagulant",
    "药", "剂", "素", "洛尔", "地平", "普利", "沙坦", "他汀", "nitroglycerin", "adenosine"]
TREATMENT_WORDS = [
    "surgery", "repair", "replacement", "graft", "stent", "angioplasty", "catheter", "ablation",
    "resection", "transplant", "tevar", "evar", "cpb", "cabg", "pci", "ecmo", "crrt",
    "balloon pump", "impella", "ventricular assist", "pacemaker", "defibrillator", "bypass",
    "embolization", "anastomosis", "thoracotomy", " laparotomy", "endoscopy",
    "手术", "治疗", "修复", "移植", "支架", "导管", "消融", "切除", "置换", "搭桥", "介入", "管理"]
GUIDELINE_WORDS = [
    "guideline", "consensus", "recommendation", "trial", "rct", "meta-analysis",
    "systematic review", "cohort", "registry", "指南", "共识", "推荐", "试验", "研究", "证据",
    "clinicaltrials", "nih", "fda", "ema"]
CHECK_WORDS = [
    "ct", "mri", "ultrasound", "echocardiograph", "angiograph", "x-ray", "pet", "spect", "ecg",
    "eeg", "emg", "lab", "assay", "biomarker", "troponin", "creatinine", "gfr", "egfr", "bun",
    "alt", "ast", "hba1c", "glucose", "cholesterol", "ldl", "hdl", "biopsy", "endoscopy",
    "colonoscopy", "bronchoscopy", "cystoscopy", "检查", "检测", "超声", "造影", "图", "试验",
    "评分", "量表", "cystatin", "equation"]
SYMPTOM_WORDS = [
    "pain", "fever", "edema", "dyspnea", "fatigue", "nausea", "vomiting", "bleeding",
    "hemorrhage", "hypertension", "hypotension", "tachycardia", "bradycardia", "arrhythmia",
    "shock", "sepsis", "hypoxia", "cyanosis", "ascites", "jaundice", " effusion",
    "晕", "痛", "发热", "水肿", "困难", "急促", "高压", "低压", "症状", "体征"]
ANATOMY_WORDS = [
    "artery", "vein", "valve", "ventricle", "atrium", "myocardium", "endocardium", "pericardium",
    "aorta", "coronary", "pulmonary", "mitral", "tricuspid", "renal", "hepatic", "cerebral",
    "carotid", "femoral", "brachial", "radial", "axillary", "popliteal", "tibial", "mesenteric",
    "血管", "心脏", "肾脏", "肝脏", "脑", "肺", "动脉", "静脉", "瓣膜", "Gene", "Cohort"]
METRIC_WORDS = [
    "score", "index", "rate", "ratio", "level", "pressure", "volume", "output", "fraction",
    "clearance", "survival", "mortality", "morbidity", "incidence", "prevalence",
    "率", "值", "指数", "分数", "水平", "Equation"]
ENTITY_GROUP_RULES: Rules = [
    ("disease", DISEASE_WORDS), ("drug", DRUG_WORDS), ("treatment", TREATMENT_WORDS),
    ("guideline", GUIDELINE_WORDS), ("check", CHECK_WORDS), ("symptom", SYMPTOM_WORDS),
    ("anatomy", ANATOMY_WORDS), ("metric", METRIC_WORDS),
]
ENTITY_GROUPS = [g for g, _ in ENTITY_GROUP_RULES] + ["other"]

# ---- fixed values: direction words --------------------------------------------------------
SUPPORT_WORDS = ["显著", "有效", "获益", "改善", "降低", "优于", "提高",
                 "significant", "effective", "benefit", "improved",
                 "superior", "reduced", "favorable"]
AGAINST_WORDS = ["无显著", "无效", "未改善", "不优于", "无差异", "无统计学",
                 "no significant", "no difference", "not effective", "不显著", "未降低"]

# ---- fixed values: chunk type -> segment type, level names and labels ---------------------
SEGMENT_TYPES = {
    "primary_outcome": "results_primary", "secondary_outcome": "results_secondary",
    "subgroup_analysis": "subgroup_analysis", "sensitivity_analysis": "sensitivity_analysis",
    "safety_outcome": "results_secondary", "methods_design": "methods",
    "baseline_table": "other", "outcome_table": "other", "figure_description": "other",
    "abbreviations": "other", "references": "references", "conclusion": "conclusion",
    "discussion": "discussion",
}
LEVEL_BY_NAME = {
    "meta_analysis": 1, "systematic_review": 1, "rct": 2, "randomized_controlled_trial": 2,
    "cohort": 3, "cohort_study": 3, "case_control": 4, "case_report": 5, "case_series": 5,
    "expert_consensus": 6, "guideline": 6, "consensus": 6,
}
LEVEL_NAMES = {1: "META_ANALYSIS", 2: "RCT", 3: "COHORT", 4: "CASE_CONTROL", 5: "CASE_REPORT",
               6: "EXPERT_CONSENSUS", 7: "UNKNOWN"}
LEVEL_LABELS = {1: "Meta分析/系统综述", 2: "RCT", 3: "队列研究", 4: "病例对照", 5: "病例报告",
                6: "专家共识"}
LEVEL_LABEL_DEFAULT = "未知证据"
LEVEL_PREFIXES = {
    1: "[Meta分析/系统综述] 最高等级证据", 2: "[随机对照试验(RCT)] 高等级证据",
    3: "[队列研究] 中等证据", 4: "[病例对照研究] 中低等证据",
    5: "[病例报告/病例系列] 低等级证据", 6: "[专家共识/指南] 权威共识",
}
LEVEL_PREFIX_DEFAULT = "[证据等级待定]"

# ---- fixed values: answer checks ----------------------------------------------------------
SOURCE_MARKS = ["[", "p.", "文献", "来源", "参考"]
HEDGES = ["可能", "不确定", "暂无"]
TOOL_MARKS = ["<｜", "tool_call"]
NOT_FOUND_MARK = "未找到"
ISSUE_NO_SOURCE = "答案未引用知识库来源，可能基于通用知识而非文献"
ISSUE_NO_SEARCH = "未进行任何知识库检索，答案可能不可靠"
ISSUE_EMPTY_SEARCH = "所有检索均未返回结果，知识库可能不包含相关数据"
ISSUE_HEDGING = "答案包含过多不确定表述，证据可能不充分"
ISSUE_SHORT = "答案过于简短，可能未充分回答用户问题"
ISSUE_TOOL_TEXT = "答案包含工具调用残留，输出异常"
RUBRIC_STRUCTURE = ["#", "##", "**", "- ", "1.", "结论", "根据"]
RUBRIC_SOURCING = ["来源", "文献", "参考", "[]", "[p.", "页码", "证据"]
RUBRIC_DATA = ["%", "mm", "cm", "kg", "mg", "ml", "mmHg", "±", "p=", "95%CI", "n=", "n =",
               "HR", "OR", "RR", "CI"]
RUBRIC_HEDGED = ["不确定", "可能", "证据有限", "不充分", "需要进一步",
                 "limited", "uncertain", "may", "could", "未解决"]
RUBRIC_OVERCONFIDENT = ["一定会", "绝对", "肯定", "100%", "保证"]
# -------------------------------------------------------------------------------------------

MAX_KEYWORDS = 5_000
#: Up to so many keywords are searched one by one, which takes less than half of a regex's time.
SEARCHED_SINGLY = 128


def classify(text: Column | str, rules: Rules, default: str | None = None,
             prefix: int | None = None, fold_keywords: bool = True) -> Column:
    """Label of the first rule with a keyword inside the lower-cased (prefix of the) text.

    With ``fold_keywords=False`` keywords are compared as written, so upper-case ones in a
    table never fire, which is how the entity groups behave.
    """
    if sum(len(k) for _, k in rules) > MAX_KEYWORDS:
        raise ValueError(f"more than {MAX_KEYWORDS} keywords do not fit an expression; give them as rows to operators.lookups.classify_by_table")
    text = F.col(text) if isinstance(text, str) else text
    low = F.lower(F.left(text, F.lit(prefix)) if prefix else text)
    priority: dict[str, int] = {}
    for place, (_, keywords) in enumerate(rules):
        for k in keywords:
            priority.setdefault(k.lower() if fold_keywords else k, place)
    if not priority:
        return F.lit(default).cast("string")
    if len(priority) <= SEARCHED_SINGLY:
        def first(low: Column) -> Column:
            label = F.lit(default).cast("string")
            for place in sorted(set(priority.values()), reverse=True):
                keys = [F.contains(low, F.lit(k)) for k, at in priority.items() if at == place]
                label = F.when(reduce(Column.__or__, keys), rules[place][0]).otherwise(label)
            return label

        # the lower-cased text is bound once; keywords are searched in order until one is there
        return F.get(F.transform(F.array(low), first), F.lit(0))
    # one scan: where several keywords start, the one of the first rule is reported
    table = F.create_map(*[F.lit(x) for kv in priority.items() for x in kv])
    best = F.array_min(F.transform(found(low, list(priority)), lambda k: F.element_at(table, k)))
    labels = F.array(*[F.lit(label) for label, _ in rules])
    return F.coalesce(F.get(labels, best), F.lit(default).cast("string"))


def lookup(key: Column | str, table: dict, default) -> Column:
    key = F.col(key) if isinstance(key, str) else key
    entries = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(entries, key), F.lit(default))


def classify_section(text, rules: Rules = SECTION_RULES) -> Column:
    return classify(text, rules, "unknown", SECTION_PREFIX)


def detect_evidence_type(text) -> Column:
    kind = classify(text, EVIDENCE_TYPE_RULES, "unknown", EVIDENCE_PREFIX)
    return F.struct(kind.alias("type"), lookup(kind, EVIDENCE_TYPE_LEVEL, 7).alias("level"))


def evidence_label(text) -> Column:
    return classify(text, EVIDENCE_LABEL_RULES)


def evidence_label_matrix(text) -> Column:
    return classify(text, MATRIX_LABEL_RULES)


def evidence_level(text, title, long_form: bool = False) -> Column:
    rules = EVIDENCE_LEVEL_RULES_LONG if long_form else EVIDENCE_LEVEL_RULES
    text = F.col(text) if isinstance(text, str) else text
    title = F.col(title) if isinstance(title, str) else title
    return classify(F.concat(text, F.lit(" "), title), rules).cast("int")


def chunk_type(text, short_form: bool = False) -> Column:
    return classify(text, CHUNK_TYPE_RULES_SHORT if short_form else CHUNK_TYPE_RULES, "other")


def entity_group(name, fold_keywords: bool = False) -> Column:
    return classify(name, ENTITY_GROUP_RULES, "other", fold_keywords=fold_keywords)


def direction(text) -> Column:
    """supportive / against / neutral; one side must lead by more than one word."""
    text = F.col(text) if isinstance(text, str) else text
    low = F.lower(text)
    lead = count_present(low, SUPPORT_WORDS) - count_present(low, AGAINST_WORDS)
    return F.when(lead > 1, "supportive").when(lead < -1, "against").otherwise("neutral")


def segment_type(kind) -> Column:
    return lookup(kind, SEGMENT_TYPES, "other")


def parse_evidence_level(name) -> Column:
    name = F.col(name) if isinstance(name, str) else name
    return lookup(F.replace(F.lower(name), F.lit("-"), F.lit("_")), LEVEL_BY_NAME, 7)


def level_name(level) -> Column:
    return lookup(level, LEVEL_NAMES, "UNKNOWN")


def level_label(level) -> Column:
    return lookup(level, LEVEL_LABELS, LEVEL_LABEL_DEFAULT)


def level_prefix(level) -> Column:
    level = F.col(level) if isinstance(level, str) else level
    return F.when(level.isNull(), "").otherwise(lookup(level, LEVEL_PREFIXES, LEVEL_PREFIX_DEFAULT))


def resolve_label(model_label: Column, rule_label: Column, allowed: list[str] = SECTION_LABELS) -> Column:
    """The model's label where it is a known one, else the rule's."""
    label = F.lower(strip(model_label))
    return F.coalesce(F.when(label.isin(allowed), label), rule_label)


def critique(query: Column, answer: Column, steps: Column) -> Column:
    """Confidence, issues and the follow-up query of an answer.

    ``steps`` is ``array<struct<tool:string,result_preview:string>>``.
    """
    searches = F.filter(steps, lambda s: s["tool"].isin("search_rag", "deep_retrieve"))
    empty = F.filter(searches, lambda s: F.contains(F.coalesce(s["result_preview"], F.lit("")),
                                                    F.lit(NOT_FOUND_MARK)))
    no_source = ~contains_any(answer, SOURCE_MARKS) & (F.size(steps) > 0)
    no_search = F.size(searches) == 0
    all_empty = (F.size(searches) > 0) & (F.size(empty) == F.size(searches))
    hedging = sum((occurrences(answer, h) for h in HEDGES[1:]), occurrences(answer, HEDGES[0])) > 5
    short = (F.length(answer) < 80) & (query != "")
    tool_text = contains_any(answer, TOOL_MARKS)
    issues = F.array_compact(F.array(
        F.when(no_source, ISSUE_NO_SOURCE), F.when(no_search, ISSUE_NO_SEARCH),
        F.when(all_empty, ISSUE_EMPTY_SEARCH), F.when(hedging, ISSUE_HEDGING),
        F.when(short, ISSUE_SHORT), F.when(tool_text, ISSUE_TOOL_TEXT)))
    confidence = (F.when(no_search | all_empty | tool_text, "low")
                  .when(no_source | hedging | short, "medium").otherwise("high"))
    follow_up = F.when((confidence == "low") & (query != ""), refine_query(query)).otherwise(query)
    return F.struct(confidence.alias("confidence"), issues.alias("issues"),
                    follow_up.alias("refined_query"))


def _round_half_even(x: Column) -> Column:
    return F.bround(x, 0).cast("int")


def score_answer(answer: Column, expected: Column) -> Column:
    """Five rubric scores of 0 to 10 and their mean; answers under 20 characters score zero."""
    n = F.length(answer)
    low = F.lower(answer)
    relevance = F.least(F.lit(10), F.when(n > 80, 3).otherwise(0) + F.when(n > 200, 2).otherwise(0)
                        + F.when(contains_any(answer, RUBRIC_STRUCTURE), 3).otherwise(0) + 2)
    found = F.size(F.filter(expected, lambda e: F.contains(low, F.lower(e))))
    completeness = F.least(F.lit(10), _round_half_even(
        found / F.greatest(F.size(expected), F.lit(1)) * 10))
    sourcing = F.least(F.lit(10), count_present(answer, RUBRIC_SOURCING) * 2 + 2)
    specificity = F.least(F.lit(10), count_present(answer, RUBRIC_DATA) * 2 + 1)
    hedged = F.when(contains_any(answer, RUBRIC_HEDGED), 7).otherwise(4)
    safety = F.least(F.lit(10), F.when(contains_any(answer, RUBRIC_OVERCONFIDENT),
                                       F.greatest(F.lit(0), hedged - 4)).otherwise(hedged) + 2)
    scores = {"relevance": relevance, "completeness": completeness, "sourcing": sourcing,
              "specificity": specificity, "safety": safety}
    usable = answer.isNotNull() & (n >= 20)
    gated = {k: F.when(usable, v).otherwise(0) for k, v in scores.items()}
    total = gated["relevance"]
    for k in list(gated)[1:]:
        total = total + gated[k]
    return F.struct(*[v.alias(k) for k, v in gated.items()], (total / 5.0).alias("total"))


# ---- fixed values: outcome names of a repeated upload, most telling first -----------------
UPLOAD_UPDATE, UPLOAD_DUPLICATE, UPLOAD_BROKEN, UPLOAD_SEEN = "版本更新", "重复入梦", "未竟之章", "似曾相识"
UPLOAD_NEW, UPLOAD_PART, UPLOAD_OPEN = "新篇入阁", "部分收录", "待定之章"
# -------------------------------------------------------------------------------------------


def upload_outcome(status, chunks_added, is_update, n_same_md5, n_same_name, first_same_name_md5,
                   md5) -> Column:
    """What became of an upload, given the finished tasks with the same content or name."""
    named = n_same_name > 0
    same_content = named & md5.isNotNull() & (first_same_name_md5 == md5)
    changed = (chunks_added > 0) & named & (
        (n_same_md5 == 0) | ~F.equal_null(md5, first_same_name_md5))
    return (F.when(is_update | changed, UPLOAD_UPDATE)
            .when((status == "failed") & ((n_same_md5 > 0) | same_content), UPLOAD_DUPLICATE)
            .when((status == "failed") & (chunks_added == 0), UPLOAD_BROKEN)
            .when(n_same_md5 > 0, UPLOAD_SEEN)
            .when((chunks_added > 0) & (status == "done"), UPLOAD_NEW)
            .when(chunks_added > 0, UPLOAD_PART)
            .otherwise(UPLOAD_OPEN))
