"""URL filter: allow and block rules, and trust propagated over the link graph of hosts.

Rules are seeds. Trust flows from allowed hosts along links (personalised PageRank); distrust flows
from blocked hosts against them, to the hosts that link there, each by the share of its own links that
lead there: who links to blocked hosts only is distrusted however many others do. A host's seed is the share of its
pages that rules allow or block, so a host blocked in one section only is a weak seed. A page that
no rule judges gets its host's verdict: block when distrust exceeds trust by ``BLOCK_AT``.
Everything is DataFrame operations; the graph is aggregated to one weighted edge per pair of hosts
before anything is propagated, and no host's links are ever collected.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import ORACLES, checkpointed, query, table  # noqa: F401

#: The contract's rules: (host and path prefix, verdict).
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
DAMPING, BLOCK_AT, TOLERANCE = 0.85, 0.5, 1e-6
#: Steps between two checkpoints, and at most.
STRIDE, STEPS = 5, 40
#: Tasks that the pages of one host are spread over.
SALTS = 16
LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?\s*([^"'\s>]+)"""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL, both empty without ``://`` and for null."""
    known = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    rest = F.substr(url, F.instr(url, "://") + 3)
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return F.when(known, F.translate(host, UPPER, LOWER)).otherwise(""), F.when(known, path).otherwise("")


def site(host: Column) -> Column:
    """The host as links name it: without user and port."""
    return F.regexp_replace(host, r"^[^@]*@|:[0-9]*$", "")


def judged(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, null where none does. Rules are few: one expression holds them."""
    rule = verdict = None
    for text, told in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        domain, slash, rest = text.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(slash + rest)
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, told) if verdict is None else verdict.when(fits, told)
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule.otherwise(none), verdict.otherwise(none))


def host_edges(pages: DataFrame) -> DataFrame:
    """``(src, dst, n)``: links between different hosts, counted, of ``(host, html)`` rows.

    Absolute and ``//host`` links count; relative ones stay on their host and carry nothing.
    """
    link = F.explode(F.regexp_extract_all(F.col("html"), F.lit(LINK), F.lit(1)))
    to = F.regexp_extract(F.col("link"), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return (pages.where("host != ''").select("host", link.alias("link"))
            .select(F.col("host").alias("src"), F.translate(to, UPPER, LOWER).alias("dst"))
            .where("dst != '' and dst != src").groupBy("src", "dst").agg(F.count("*").alias("n")))


def propagated(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING) -> DataFrame:
    """``(host, trust, distrust)``: both propagated from ``seeds(host, good, bad)`` until they settle.

    Scores are scaled so that a host without links has its own seed as score. Trust is shared out
    over a host's outgoing links by weight; a host takes over distrust by the same weights.
    """
    out = edges.groupBy(F.col("src").alias("at")).agg(F.sum("n").alias("all"))
    shares = edges.join(out, edges.src == out["at"]).select("src", "dst", (F.col("n") / F.col("all")).alias("w"))
    ways = checkpointed(shares.select(F.explode(F.array(
        F.struct(F.lit("trust").alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"), F.col("w").alias("w")),
        F.struct(F.lit("distrust").alias("kind"), F.col("dst").alias("a"), F.col("src").alias("b"), F.col("w").alias("w")))).alias("x")).select("x.*"))
    base = checkpointed(seeds.select("host", F.explode(F.array(F.struct(F.lit("trust").alias("kind"), F.col("good").alias("seed")),
                                                               F.struct(F.lit("distrust").alias("kind"), F.col("bad").alias("seed")))).alias("x"))
                        .select("host", "x.kind", "x.seed").where("seed > 0"))
    now = base.select("host", "kind", F.col("seed").alias("score"))
    for _ in range(STEPS // STRIDE):
        before = now
        for _ in range(STRIDE):
            moved = (now.withColumnRenamed("host", "a").join(ways, ["kind", "a"])
                     .select(F.col("b").alias("host"), "kind", (damping * F.col("score") * F.col("w")).alias("score")))
            now = base.select("host", "kind", F.col("seed").alias("score")).unionAll(moved).groupBy("host", "kind").agg(F.sum("score").alias("score"))
        now = checkpointed(now)
        change = (now.select("host", "kind", "score").unionAll(before.select("host", "kind", (-F.col("score")).alias("score")))
                  .groupBy("host", "kind").agg(F.sum("score").alias("d")).agg(F.max(F.abs("d")).alias("m"))).first().m
        if change is None or change < TOLERANCE:
            break
    pick = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("score"))), F.lit(0.0)).alias(kind)
    return now.groupBy("host").agg(pick("trust"), pick("distrust"))


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, page_id: str = "page_id", url: str = "url",
                html: str = "html", block_at: float = BLOCK_AT) -> DataFrame:
    """``(page_id, host, path, rule, verdict, trust, distrust)`` for every row.

    Null urls, and those without ``://``, have no host, no links and the verdict allow; null html has
    no links; repeated rows are judged alike; an empty table gives no rows; other columns are ignored.
    """
    host, path = host_and_path(F.col(url))
    parts = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"), F.col(html).alias("html"))
    rule, verdict = judged(F.col("host"), F.col("path"), rules)
    ruled = parts.withColumns({"rule": rule, "told": verdict, "site": site(F.col("host"))})
    share = lambda told: F.avg((F.coalesce(F.col("told"), F.lit("")) == told).cast("double"))
    seeds = ruled.where("site != ''").groupBy(F.col("site").alias("host")).agg(share("allow").alias("good"), share("block").alias("bad"))
    links = host_edges(parts.select(site(F.col("host")).alias("host"), "html"))
    scores = propagated(checkpointed(links), checkpointed(seeds)).withColumnRenamed("host", "site")
    # a host's one row is repeated, so that the pages of a hot host meet it in several tasks
    spread = scores.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = ruled.drop("html").withColumn("salt", F.pmod(F.xxhash64("page_id", "path"), F.lit(SALTS)).cast("int"))
    rows = salted.join(spread, ["site", "salt"], "left")
    trust, distrust = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    own = F.when(distrust - trust > block_at, "block").otherwise("allow")
    return rows.select("page_id", "host", "path", "rule", F.coalesce("told", own).alias("verdict"), F.round(trust, 6).alias("trust"),
                       F.round(distrust, 6).alias("distrust"))


def _oracle(rules: Sequence[tuple[str, str]] = RULES) -> str:
    """The same in SQL, every propagation step a CTE of its own."""
    def case(pick) -> str:
        out = []
        for text, told in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
            domain, slash, rest = text.partition("/")
            out.append(f"WHEN (host = '{domain}' OR ends_with(host, '.{domain}')) AND starts_with(path, '{slash + rest}') THEN '{pick(text, told)}'")
        return "CASE " + " ".join(out) + " END"

    low = lambda x: f"translate({x}, '{UPPER}', '{LOWER}')"
    link = LINK.replace("'", "''")
    steps = "".join(f""",
s{k} AS MATERIALIZED (SELECT host, kind, sum(score) AS score FROM (SELECT host, kind, score FROM s0
  UNION ALL SELECT w.b, s.kind, {DAMPING} * s.score * w.w FROM s{k - 1} s JOIN ways w ON w.kind = s.kind AND w.a = s.host) GROUP BY host, kind)"""
                    for k in range(1, STEPS + 1))
    return f"""
WITH u AS (SELECT page_id, html, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, html, regexp_extract(rest, '^[^/?#]*', 0) AS raw, rest FROM u),
p AS (SELECT page_id, html, {low('raw')} AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*', 0) AS path FROM h),
r AS (SELECT *, {case(lambda text, told: text)} AS rule, {case(lambda text, told: told)} AS told, regexp_replace(host, '^[^@]*@|:[0-9]*$', '', 'g') AS site FROM p),
links AS (SELECT site AS src, unnest(regexp_extract_all(html, '{link}', 1)) AS link FROM r WHERE site <> ''),
edges AS (SELECT src, dst, count(*) AS n FROM (SELECT src,
  {low("regexp_extract(link, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)', 1)")} AS dst FROM links) WHERE dst <> '' AND dst <> src GROUP BY src, dst),
ways AS MATERIALIZED (SELECT 'trust' AS kind, src AS a, dst AS b, n / sum(n) OVER (PARTITION BY src) AS w FROM edges
  UNION ALL SELECT 'distrust', dst, src, n / sum(n) OVER (PARTITION BY src) FROM edges),
shares AS (SELECT site AS host, avg((coalesce(told, '') = 'allow')::INT) AS good, avg((coalesce(told, '') = 'block')::INT) AS bad FROM r WHERE site <> '' GROUP BY site),
s0 AS MATERIALIZED (SELECT host, 'trust' AS kind, good AS score FROM shares WHERE good > 0 UNION ALL SELECT host, 'distrust', bad FROM shares WHERE bad > 0){steps},
scores AS (SELECT host, coalesce(sum(score) FILTER (kind = 'trust'), 0) AS trust, coalesce(sum(score) FILTER (kind = 'distrust'), 0) AS distrust
  FROM s{STEPS} GROUP BY host)
SELECT page_id, r.host, path, rule, coalesce(told, CASE WHEN coalesce(distrust, 0) - coalesce(trust, 0) > {BLOCK_AT} THEN 'block' ELSE 'allow' END) AS verdict,
  round(coalesce(trust, 0)::DOUBLE, 6) AS trust, round(coalesce(distrust, 0)::DOUBLE, 6) AS distrust FROM r LEFT JOIN scores ON scores.host = r.site"""


@query("op1_url_trust", _oracle())
def op1(spark, sf_dir):
    return filter_urls(table(spark, sf_dir, "pages"))
