"""String functions over page, chunk and caption text.

White space means Unicode white space throughout; Spark's ``trim`` and Java's bare ``\\s`` know
only ASCII, hence the explicit class. Keyword tests compile to one alternation grouped by first
character, so a text is scanned once and most positions fail on one comparison.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values: running headers to delete from a page ----------------------------------
HEADER_PATTERNS = [
    r"JACC\s+Vol\.\s+\d+,\s+No\.\s+\d+,\s+\d{4}\s*\n.+?\d{4}:\d+[-–]\d+",
    r"Seyfarth et al\.\s*\nLVAD Versus IABP in Cardiogenic Shock",
    r"(?s)Downloaded from.*?on.*?\d{4}",
    r"(?:BRIEF|ORIGINAL|CLINICAL|RESEARCH|REVIEW)\s+(?:COMMUNICATION|ARTICLE|REPORT|PAPER|LETTER)"
    r"\s+[\w\s]+(?:inMedicine|in\s+Medicine|Medicine)",
    r"(?m)^[\w\s]+Vol\.\s+\d+.*?\d{4}$",
]
# ---- fixed values: OCR artefacts and their replacements -----------------------------------
OCR_PATTERNS = [
    (r"/zero\.pl\.tnum", "0"),
    (r"/one\.case", "1"),
    (r"glyph&lt;\d+&gt;", ""),
    (r"/A\.cap\s*", "A"),
    (r"\\u[0-9a-fA-F]{4}", ""),
    (r"\x00", ""),
    ("�+", ""),
]
# ---- fixed values: chart type -> search words ---------------------------------------------
CHART_KEYWORDS = {
    "flowchart": "流程图 图表 图 诊断",
    "classification_diagram": "分型 分类 示意图 图表 图",
    "baseline_table": "基线 表格 表",
    "outcome_table": "结局 表格 表",
    "forest_plot": "森林图 图表 图",
    "km_curve": "生存曲线 图表 图",
}
CHART_KEYWORDS_DEFAULT = "图表 图 表格"
# ---- fixed values: words that mark title, journal and figure lines ------------------------
TITLE_WORDS = ["randomized", "trial", "evaluate", "study of", "versus", "vs."]
JOURNAL_WORDS = ["Journal", "Cardiology", "Lancet", "Medicine", "BMJ", "JAMA", "Heart", "Circulation"]
FIGURE_WORDS = ["figure ", "fig. ", "survival curve", "time course"]
# ---- fixed values: entity vocabulary, in reporting order ----------------------------------
ENTITY_VOCABULARY = [
    "LVAD", "IABP", "Impella", "AMI", "cardiogenic", "shock", "myocardial", "infarction",
    "LVEF", "MODS", "SOFA", "CPI", "mortality", "survival", "hemodynamic", "PCI", "CABG",
    "randomized", "baseline", "primary endpoint", "endpoint", "ejection fraction",
    "cardiac index", "cardiac power", "lactate", "hemolysis", "vasopressor",
    "revascularization", "TIMI", "angioplasty", "stent", "bypass",
]
# ---- fixed values: what is read out of texts -----------------------------------------------
FEW_NEEDLES = 32
PERCENT = r"(\d+\.?\d*)\s*[%％]"
EFFECT_NAMED = r"(?i)(HR|RR|OR)\s*[=＝]\s*([\d.]+)\s*\(\s*([\d.]+)\s*[-–]\s*([\d.]+)\s*\)"
EFFECT_TRAILING = r"(?i)([\d.]+)\s*\(\s*([\d.]+)\s*[-–]\s*([\d.]+)\s*\).*?(HR|RR|OR)"
YEAR = r"(?U)\b(?:19|20)\d{2}\b"
CODE_BLOCK, CODE_SPAN, WIKI_LINK = r"(?s)```.*?```", r"`[^`]*`", r"\[\[([^\]]+)\]\]"
# -------------------------------------------------------------------------------------------


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def length(c: Column | str) -> Column:
    """Character count as BIGINT."""
    return F.length(_col(c)).cast("bigint")


SPACE = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


SPACE_CHARS = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
                                0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def strip(c: Column | str) -> Column:
    """Both ends freed of white space; looks at the ends only, unlike a regex."""
    return F.btrim(_col(c), F.lit(SPACE_CHARS))


def words(c: Column | str) -> Column:
    """Lower-cased white-space tokens."""
    return F.array_remove(_pieces(c), "")


def _pieces(c: Column | str) -> Column:
    """Lower-cased text cut at each white space. All of it becomes blanks first: a split at one character needs no regex."""
    return F.split(F.translate(F.lower(_col(c)), SPACE_CHARS, " " * len(SPACE_CHARS)), " ")


def alternation(needles: list[str]) -> str:
    """Regex for any of the literals, grouped by first character, order kept within a group."""
    groups: dict[str, list[str]] = {}
    for n in dict.fromkeys(needles):
        groups.setdefault(n[0], []).append(re.escape(n[1:]))
    return "|".join(re.escape(k) + (v[0] if len(v) == 1 else "(?:" + "|".join(v) + ")") for k, v in groups.items())


def contains_any(c: Column, needles: list[str]) -> Column:
    """True where any needle occurs. A few are searched one by one, which takes less than half of a regex's time."""
    if not needles:
        return F.lit(False)
    return reduce(Column.__or__, [F.contains(c, F.lit(n)) for n in needles]) if len(needles) <= FEW_NEEDLES else c.rlike(alternation(needles))


def found(c: Column, needles: list[str]) -> Column:
    """For every place where needles start, the first of them in list order; one scan."""
    return F.regexp_extract_all(c, F.lit("(?=(" + alternation(needles) + "))"), F.lit(1))


def count_present(c: Column, needles: list[str]) -> Column:
    """How many of the needles occur at least once."""
    hits = [F.contains(c, F.lit(n)).cast("int") for n in needles]
    total = hits[0]
    for h in hits[1:]:
        total = total + h
    return total


def occurrences(c: Column, needle: str) -> Column:
    """Non-overlapping occurrences of a literal."""
    gone = F.replace(c, F.lit(needle), F.lit(""))
    return ((F.length(c) - F.length(gone)) / len(needle)).cast("int")


def clean_page(c: Column | str) -> Column:
    out = _col(c)
    for pattern in HEADER_PATTERNS:
        out = F.regexp_replace(out, "(?idU)" + pattern, "")
    return strip(out)


def clean_ocr(c: Column | str) -> Column:
    out = _col(c)
    for pattern, replacement in OCR_PATTERNS:
        out = F.regexp_replace(out, pattern, replacement)
    return out


def _top_count(tokens: Column) -> Column:
    """Occurrences of the most frequent token: sort, keep the longest run."""
    start = F.struct(F.lit("").alias("prev"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(acc, w):
        run = F.when(w == acc["prev"], acc["run"] + 1).otherwise(1)
        return F.struct(w.alias("prev"), run.alias("run"),
                        F.greatest(acc["best"], run).alias("best"))

    return F.aggregate(F.array_sort(tokens), start, step, lambda acc: acc["best"])


def is_generation_loop(c: Column | str) -> Column:
    """One word more than 30 times and in over 30 % of the text (needs 30 words to begin with)."""
    def looped(pieces):
        w = F.array_remove(pieces, "")
        # a word seen k times leaves at most n - k + 1 distinct ones: ordinary text stops here, empty pieces only add
        return (F.size(pieces) - F.size(F.array_distinct(pieces)) >= 30) & (_top_count(w) > 30) & (_top_count(w) / F.size(w) > 0.3)

    # the pieces are bound once; 31 words need more than 60 characters
    verdict = F.get(F.transform(F.array(_pieces(c)), looped), F.lit(0))
    return F.when(F.length(_col(c)) > 60, verdict).otherwise(False)


def noise_ratio(c: Column | str) -> Column:
    """Share of ASCII characters that are neither alphanumeric nor plain punctuation."""
    c = _col(c)
    noise = F.regexp_replace(c, r"[A-Za-z0-9 .,;:!?()\-\[\]{}%/=<>\x{80}-\x{10FFFF}]+", "")
    return F.when(F.length(c) > 0, F.length(noise) / F.length(c)).otherwise(F.lit(0.0))


def content_md5(c: Column | str) -> Column:
    return F.md5(_col(c))


def chart_keywords(chart_type: Column | str) -> Column:
    table = F.create_map(*[F.lit(x) for kv in CHART_KEYWORDS.items() for x in kv])
    return F.coalesce(F.try_element_at(table, _col(chart_type)), F.lit(CHART_KEYWORDS_DEFAULT))


def format_source(doc: Column | str, page: Column | str, kind: Column | str | None = None) -> Column:
    """``doc [p.N]``, with ``, image`` or ``, table`` inside the bracket for those kinds."""
    suffix = F.lit("")
    if kind is not None:
        k = _col(kind)
        suffix = (F.when(k.isin("image", "chart"), ", image")
                  .when(k == "table", ", table").otherwise(""))
    return F.concat(_col(doc), F.lit(" [p."),
                    F.coalesce(_col(page).cast("string"), F.lit("?")), suffix, F.lit("]"))


def source_doc(source: Column | str) -> Column:
    return F.substring_index(_col(source), " [p.", 1)


def source_page(source: Column | str) -> Column:
    """Integer page of a source label, null where it is not a plain number."""
    return F.regexp_extract(_col(source), r"p\.(\d+)\]", 1).try_cast("bigint")


def enrich_text(title, text, one_liner, entities) -> Column:
    """Title, text, summary and entity lines, absent parts left out."""
    title, text, one_liner, entities = map(_col, (title, text, one_liner, entities))
    return F.concat_ws(
        "\n",
        F.when(title != "", F.concat(F.lit("[文献] "), title)),
        text,
        F.when(one_liner != "", F.concat(F.lit("[摘要] "), one_liner)),
        F.when(F.size(entities) > 0, F.concat(F.lit("[实体] "), F.array_join(entities, ", "))),
    )


def _contains_word_of(line: Column, needles: list[str]) -> Column:
    return contains_any(line, needles)


def doc_meta(page0: Column | str, doc: Column | str) -> Column:
    """Title, journal, year and authors guessed from the first page."""
    page0, doc = _col(page0), _col(doc)
    lines = F.filter(F.transform(F.split(page0, "\n"), strip), lambda l: F.length(l) > 10)
    title = F.get(F.filter(F.slice(lines, 1, 10),
                           lambda l: contains_any(F.lower(l), TITLE_WORDS)), F.lit(0))
    journal = F.get(F.filter(F.slice(lines, 1, 5),
                             lambda l: contains_any(l, JOURNAL_WORDS)), F.lit(0))
    authors = F.get(F.filter(lines, lambda l: (occurrences(l, ",") >= 4)
                             & F.left(l, F.lit(5)).rlike(r"\p{Lu}")), F.lit(0))
    return F.struct(
        F.coalesce(F.left(title, F.lit(200)), doc).alias("title"),
        F.coalesce(F.left(journal, F.lit(100)), F.lit("")).alias("journal"),
        F.regexp_extract(F.left(page0, F.lit(500)), YEAR, 0).alias("year"),
        F.coalesce(F.left(authors, F.lit(200)), F.lit("")).alias("authors"),
    )


def extract_entities(c: Column | str, vocabulary: list[str] | None = None, keep: int = 10) -> Column:
    """Vocabulary terms found in the text, in vocabulary order.

    The text is scanned once for the longest term at each place; a term is present where a hit
    starts with it, so only the few hits are compared with the vocabulary.
    """
    terms = vocabulary or ENTITY_VOCABULARY
    low = sorted((t.lower() for t in terms), key=len, reverse=True)
    hits = F.array_distinct(found(F.lower(_col(c)), low))
    table = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(t.lower()).alias("l")) for t in terms])
    none = F.array().cast("array<string>")

    def pick(h):
        kept = F.filter(table, lambda e: F.exists(h, lambda x: F.startswith(x, e["l"])))
        return F.when(F.size(h) == 0, none).otherwise(F.slice(F.transform(kept, lambda e: e["t"]), 1, keep))

    return F.get(F.transform(F.array(hits), pick), F.lit(0))


def one_liner(c: Column | str) -> Column:
    c = _col(c)
    first = strip(F.translate(F.left(F.get(F.split(c, r"[.!?]" + SPACE + "+"), F.lit(0)), F.lit(150)),
                              "\n", " "))
    return F.when(first != "", first).otherwise(
        strip(F.translate(F.left(c, F.lit(120)), "\n", " ")))


def strip_fences(c: Column | str) -> Column:
    """Text between the first ```json fence and the last closing fence."""
    c = strip(c)
    opened = F.when(F.contains(c, F.lit("```json")),
                    F.regexp_extract(c, r"(?s)^.*?```json(.*)$", 1)).otherwise(c)
    closed = F.when(F.contains(opened, F.lit("```")),
                    F.regexp_extract(opened, r"(?s)^(.*)```.*?$", 1)).otherwise(opened)
    return strip(closed)


def parse_fenced_json(c: Column | str, schema: str) -> Column:
    """Struct of the parsed value, the raw text and an error where parsing fails."""
    raw = _col(c)
    body = strip_fences(raw)
    ok = F.try_parse_json(body).isNotNull()
    return F.struct(
        F.when(ok, F.from_json(body, schema)).alias("value"),
        F.when(~ok, raw).alias("raw_response"),
        F.when(~ok, F.lit("JSON parse failed")).alias("error"),
    )


def percents(c: Column | str, keep: int = 5) -> Column:
    return F.slice(F.regexp_extract_all(_col(c), F.lit(PERCENT), F.lit(1)), 1, keep)


def effect(c: Column | str) -> Column:
    """First ratio with its interval: ``HR = v (lo-hi)`` or ``v (lo-hi) ... HR``."""
    c = _col(c)
    def parts(pattern, order):
        g = [F.regexp_extract(c, pattern, i) for i in order]
        return F.struct(F.upper(g[0]).alias("measure"), g[1].try_cast("double").alias("value"),
                        g[2].try_cast("double").alias("lower"), g[3].try_cast("double").alias("upper"))

    return (F.when(c.rlike(EFFECT_NAMED), parts(EFFECT_NAMED, (1, 2, 3, 4)))
            .when(c.rlike(EFFECT_TRAILING), parts(EFFECT_TRAILING, (4, 1, 2, 3))))


def wiki_links(c: Column | str) -> Column:
    """Distinct ``[[targets]]`` outside code, in order of first use."""
    plain = F.regexp_replace(F.regexp_replace(_col(c), CODE_BLOCK, ""), CODE_SPAN, "")
    return F.array_distinct(F.regexp_extract_all(plain, F.lit(WIKI_LINK), F.lit(1)))


def refine_query(c: Column | str) -> Column:
    """A question cut to its first five words, question marks dropped."""
    tokens = F.array_remove(F.split(F.translate(_col(c), "？?", ""), SPACE + "+"), "")
    return F.array_join(F.slice(tokens, 1, 5), " ")


def doc_id_from_text(c: Column | str) -> Column:
    return F.left(F.md5(F.left(_col(c), F.lit(1000))), F.lit(12))


def figure_description(page: Column | str) -> Column:
    """First figure line and the non-empty ones among the next three, or null."""
    lines = F.transform(F.split(_col(page), "\n"), strip)
    indexed = F.transform(lines, lambda l, i: F.struct(l.alias("t"), i.alias("i")))
    first = F.get(F.filter(indexed, lambda x: contains_any(F.lower(x["t"]), FIGURE_WORDS)), F.lit(0))
    window = F.slice(lines, first["i"] + 1, F.lit(4))
    return F.when(first.isNotNull(), F.array_join(F.filter(window, lambda l: l != ""), " | "))


def table_cells_to_html(cells: Column | str, num_rows: Column | str, num_cols: Column | str) -> Column:
    """Dense grid from (row, col, text) cells; the last cell written to a place wins."""
    cells, n_rows, n_cols = _col(cells), _col(num_rows), _col(num_cols)

    def cell(r, c):
        here = F.filter(cells, lambda x: (x["row"] == r) & (x["col"] == c))
        return F.concat(F.lit("<td>"),
                        F.coalesce(F.get(here, F.size(here) - 1)["text"], F.lit("")), F.lit("</td>"))

    def span(n):
        return F.when(n > 0, F.sequence(F.lit(0), n.cast("int") - 1)).otherwise(
            F.array().cast("array<int>"))

    rows = F.transform(
        span(n_rows),
        lambda r: F.concat(F.lit("<tr>"),
                           F.array_join(F.transform(span(n_cols), lambda c: cell(r, c)), ""),
                           F.lit("</tr>")),
    )
    html = F.array_join(F.concat(F.array(F.lit("<table>")), rows, F.array(F.lit("</table>"))), "\n")
    return F.when((F.size(cells) > 0) & (n_rows > 0), html).otherwise("")
