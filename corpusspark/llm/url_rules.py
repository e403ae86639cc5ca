"""URL filtering by host-suffix and path-prefix expressions.

Each URL is expanded into the expressions that some rule could equal: its host's last k labels
joined to its path's first n characters, for the (k, n) shapes that occur among the rules.
Expressions meet rules in an equi-join on the first 32 bits of their SHA-256; the full digest then
confirms, and of the rules that fit the longest wins (of equally long ones, a blocking one).

Edge cases: a null url or one without ``://`` has an empty host and path and fits no rule. An empty
path starts with no ``/``. Rows repeated with the same page_id and url are all returned. An empty
rule table gives every page the default verdict. Further columns of the pages are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusspark.llm.common import table

#: Rules as (host, path, verdict) that the registered query applies.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
PREFIX_HEX = 8
#: Above so many rules, the join shuffles instead of sending the rules to every executor.
BROADCAST_RULES = 100_000
#: Copies of each rule in the shuffled join, so that an expression that most URLs have is dealt to as many tasks.
SALTS = 32
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(pages: DataFrame, url: str = "url") -> DataFrame:
    """Adds ``host`` and ``path``."""
    at = F.instr(F.col(url), "://")
    rest = F.when(at > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return pages.withColumns({
        "host": F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER),
        "path": F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1),
    })


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, "host string, path string, verdict string")


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", page_id: str = "page_id", url: str = "url",
          broadcast_rules: int = BROADCAST_RULES) -> DataFrame:
    """page_id, host, path, rule, verdict for every row of ``pages``."""
    rules = rules.select(
        F.concat("host", "path").alias("_rule"), F.col("verdict").alias("_verdict"),
        (F.size(F.split("host", r"\.")) * 1).alias("_labels"), F.length("path").alias("_chars"),
    ).dropDuplicates(["_rule", "_verdict"])
    shapes = [(r["_labels"], r["_chars"]) for r in rules.select("_labels", "_chars").distinct().orderBy("_labels", "_chars").collect()]
    keyed = rules.select("_rule", "_verdict", F.sha2("_rule", 256).alias("_full")).withColumn("_key", F.substring("_full", 1, PREFIX_HEX))

    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url")).groupBy("page_id", "url").agg(F.count(F.lit(1)).alias("_n"))
    rows = url_parts(rows)
    # The shapes are one constant of the plan, however many they are: at most labels of a host times lengths of a path.
    every = F.array(*[F.struct(F.lit(labels).alias("labels"), F.lit(chars).alias("chars")) for labels, chars in shapes])
    ending = lambda s: F.call_function("substring_index", F.col("host"), F.lit("."), -s["labels"])
    expressions = F.transform(F.filter(every, lambda s: s["chars"] <= F.length("path")), lambda s: F.concat(ending(s), F.call_function("substring", F.col("path"), F.lit(1), s["chars"])))
    spread = rows.withColumn("_expr", F.explode_outer(F.array_distinct(expressions)) if shapes else F.lit(None).cast("string"))
    spread = spread.withColumn("_own", F.sha2("_expr", 256)).withColumn("_key", F.substring("_own", 1, PREFIX_HEX))
    if rules.count() <= broadcast_rules:
        met = spread.join(F.broadcast(keyed), "_key", "left")
    else:
        salted = keyed.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<int>")))
        met = spread.withColumn("_salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(salted.hint("merge"), ["_key", "_salt"], "left")
    best = F.max(F.when(F.col("_own") == F.col("_full"), F.struct(F.length("_rule").alias("chars"), (F.col("_verdict") == "block").alias("block"), F.col("_rule").alias("rule"))))
    judged = met.groupBy("page_id", "url", "host", "path", "_n").agg(best.alias("_best"))
    verdict = F.when(F.col("_best").isNull(), F.lit(default)).when(F.col("_best.block"), "block").otherwise("allow")
    return judged.select("page_id", "host", "path", F.col("_best.rule").alias("rule"), verdict.alias("verdict"), F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("_copy")).drop("_copy")


def op5_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), rule_table(spark, RULES))


SQL = r"""
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
     p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
     r(h, t, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
                           ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
     n AS (SELECT row_number() OVER () AS k, * FROM p),
     b AS (SELECT n.k, arg_max(r.h || r.t, length(r.h || r.t)) AS rule, arg_max(r.v, length(r.h || r.t)) AS verdict
           FROM n JOIN r ON (n.host = r.h OR ends_with(n.host, '.' || r.h)) AND starts_with(n.path, r.t) GROUP BY 1)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM n LEFT JOIN b USING (k)
"""
