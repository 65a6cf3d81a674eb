"""Column functions on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from marginalia.functions import grading as G
from marginalia.functions import rules as R
from marginalia.functions import text as T


def one(spark, expr, **cols):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()]) if cols else spark.range(1)
    return df.select(expr.alias("r")).first().r


def test_strip_is_unicode(spark):
    assert one(spark, T.strip("t"), t="　 a b\xa0\n") == "a b"


def test_words(spark):
    assert one(spark, T.words("t"), t="  A　b \n C") == ["a", "b", "c"]


def test_alternation_groups_by_first_character():
    assert T.alternation(["ab", "ac", "x."]) == r"a(?:b|c)|x\."


def test_generation_loop(spark):
    assert one(spark, T.is_generation_loop("t"), t="loop " * 31 + "x " * 10) is True
    assert one(spark, T.is_generation_loop("t"), t="loop " * 30 + "x y z") is False
    assert one(spark, T.is_generation_loop("t"), t=("loop " + "a b c ") * 31) is False
    assert one(spark, T.is_generation_loop("t"), t="short") is False


def test_noise_counts_newlines_but_not_foreign_letters(spark):
    assert one(spark, T.noise_ratio("t"), t="ab\n\n") == 0.5
    assert one(spark, T.noise_ratio("t"), t="结论é±") == 0.0
    assert one(spark, T.noise_ratio("t"), t="") == 0.0


def test_clean_ocr_strips_nul(spark):
    assert one(spark, T.clean_ocr("t"), t="a\x00b/one.case\\u12aF") == "ab1"


def test_entities_keep_prefix_terms(spark):
    got = one(spark, T.extract_entities("t", ["endpoint", "end", "PCI", "nowhere"]), t="an Endpoint after pci")
    assert got == ["endpoint", "end", "PCI"]


def test_effect_forms(spark):
    assert one(spark, T.effect("t"), t="hr＝0.5 (0.3–0.8)").asDict() == {"measure": "HR", "value": 0.5, "lower": 0.3, "upper": 0.8}
    assert one(spark, T.effect("t"), t="1.2 (0.9-1.6) pooled OR")["measure"] == "OR"
    assert one(spark, T.effect("t"), t="nothing") is None


def test_fences(spark):
    got = one(spark, T.parse_fenced_json("t", "a int"), t="text ```json\n{\"a\": 3}\n``` tail")
    assert got["value"]["a"] == 3 and got["error"] is None
    assert one(spark, T.parse_fenced_json("t", "a int"), t="oops")["error"] == "JSON parse failed"


def test_wiki_links_skip_code(spark):
    assert one(spark, T.wiki_links("t"), t="[[A]] `[[B]]` ```\n[[C]]\n``` [[A]] [[D e]]") == ["A", "D e"]


def test_one_liner_falls_back(spark):
    assert one(spark, T.one_liner("t"), t=". rest of it") == ". rest of it"
    assert one(spark, T.one_liner("t"), t="First\nline. Second.") == "First line"


@pytest.mark.parametrize("name,group", [
    ("myocardial infarction", "disease"), ("糖尿病", "disease"), ("hepatocellular carcinoma", "disease"),
    ("hypertension", "symptom"), ("aspirin", "drug"), ("抗生素", "drug"), ("cardiac surgery", "treatment"),
    ("coronary stent", "treatment"), ("CT scan", "check"), ("MRI", "check"), ("chest pain", "symptom"),
    ("coronary artery", "anatomy"), ("left ventricle", "anatomy"), ("RCT study", "guideline"), ("survival", "metric"),
    ("Gene", "other"), ("", "other"), ("zzz", "other")])
def test_entity_groups(spark, name, group):
    assert one(spark, R.entity_group(F.col("t")), t=name) == group


def test_upper_case_keywords_fire_only_when_folded(spark):
    assert one(spark, R.entity_group(F.col("t"), fold_keywords=True), t="gene") == "anatomy"


def test_sections_prefer_specific_tags(spark):
    assert one(spark, R.classify_section("t"), t="METHODS and primary endpoint") == "primary_outcome"
    assert one(spark, R.classify_section("t"), t="x" * 300 + " methods") == "unknown"
    assert one(spark, R.classify_section("t"), t="outcomes of secondary outcome") == "secondary_outcome"


def test_same_start_takes_the_better_rule(spark):
    rules = [("long", ["rct study"]), ("short", ["rct"])]
    assert one(spark, R.classify("t", rules), t="an RCT study") == "long"
    assert one(spark, R.classify("t", rules), t="an RCT trial") == "short"


def test_direction_needs_a_margin(spark):
    assert one(spark, R.direction("t"), t="significant") == "neutral"
    assert one(spark, R.direction("t"), t="significant benefit") == "supportive"
    assert one(spark, R.direction("t"), t="无效 无差异") == "against"
    assert one(spark, R.direction("t"), t="无效 未改善 不优于") == "neutral"  # 改善 and 优于 count as support


def test_level_prefix_of_null(spark):
    assert one(spark, R.level_prefix(F.lit(None).cast("int"))) == ""


def grade(spark, **row):
    base = {"text": "", "kind": "rct", "effects": [], "pico": {p: "x" for p in G.PICO_PARTS}} | row
    df = spark.createDataFrame([(base["text"], base["kind"], base["pico"], base["effects"])],
                               f"text string, kind string, pico map<string,string>, effects {G.EFFECT_TYPE}")
    cols = G.assess(F.col("text"), F.col("kind"), F.col("pico"), F.col("effects"))
    return df.select(*[c.alias(n) for n, c in cols.items()]).first()


def test_imprecision_quirks(spark):
    wide, narrow = (1.0, 0.1, 0.9, "HR"), (1.0, 0.8, 1.2, "HR")
    assert grade(spark, effects=[narrow, wide])["imprecision"] == -1
    g = grade(spark, effects=[narrow], text="n=40 patients")
    assert g["imprecision"] == 0 and len(g["downgrade_details"]) == 2  # noted, not marked down
    assert grade(spark, effects=[(1.0, None, 2.0, "HR")])["imprecision"] == 0


def test_large_effect_takes_the_first(spark):
    assert grade(spark, effects=[(2.5, None, None, ""), (9.0, None, None, "")])["large_effect"] == 1
    assert grade(spark, effects=[(-1.0, None, None, ""), (0.1, None, None, "")])["large_effect"] == 2


def test_upgrades_only_for_observational(spark):
    assert grade(spark, text="adjusted dose-response")["dose_response"] == 0
    assert grade(spark, kind="cohort", text="adjusted dose-response")["dose_response"] == 1


def test_publication_bias_strict(spark):
    df = spark.createDataFrame([("", "Meta-analysis")], "t string, k string")
    loose = df.select(G.publication_bias(F.col("t"), F.col("k"))[0].alias("r")).first().r
    strict = df.select(G.publication_bias(F.col("t"), F.col("k"), strict=True)[0].alias("r")).first().r
    assert (loose, strict) == (-1, 0)


def test_i2_counts_twice_at_most(spark):
    g = grade(spark, text="Heterogeneity with I²= 40")
    assert g["inconsistency"] == -2


def test_few_needles_need_no_regex(spark):
    from marginalia.functions import text as T
    rows = spark.createDataFrame([("a.b",), ("axb",), ("",), (None,)], "t string")
    few = rows.select(T.contains_any(rows.t, [".", "zz"]).alias("x"))
    many = rows.select(T.contains_any(rows.t, [".", *[f"z{i}" for i in range(T.FEW_NEEDLES)]]).alias("x"))
    assert "RLIKE" not in few._jdf.queryExecution().optimizedPlan().toString()
    assert [r.x for r in few.collect()] == [r.x for r in many.collect()] == [True, False, False, None]


def test_keywords_are_searched_without_a_regex(spark):
    rows = spark.createDataFrame([("Safety of the TREATMENT",), ("primary endpoint and safety",), ("none",), ("",), (None,)], "t string")
    few = rows.select(R.classify_section("t").alias("x"))
    more = [(f"l{i}", [f"zz{i}y"]) for i in range(R.SEARCHED_SINGLY)]
    many = rows.select(R.classify("t", R.SECTION_RULES + more, "unknown", R.SECTION_PREFIX).alias("x"))
    assert "regexp" not in few._jdf.queryExecution().optimizedPlan().toString()
    assert [r.x for r in few.collect()] == [r.x for r in many.collect()] == ["safety", "primary_outcome", "unknown", "unknown", "unknown"]
    assert rows.select(R.classify("t", [("a", ["TREAT"])], fold_keywords=False).alias("x")).where("x IS NOT NULL").count() == 0


def test_words_are_split_without_a_regex(spark):
    from pyspark.sql import Row
    df = spark.createDataFrame([Row(t="A" + T.SPACE_CHARS + "b\u200bc" + T.SPACE_CHARS)]).select(T.words("t").alias("x"))
    assert df.first().x == ["a", "b\u200bc"]
    assert T.SPACE not in df._jdf.queryExecution().optimizedPlan().toString()
    # empty pieces are no words
    assert one(spark, T.is_generation_loop("t"), t=" " * 200 + "loop  " * 31 + "a b c") is True
    assert one(spark, T.is_generation_loop("t"), t=" " * 200 + "a b c d") is False
