"""Which URLs a site's robots rules allow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.urls import url_netloc

RULES = "netloc STRING, rule_no INT, agent STRING, directive STRING, path STRING"


def parse_robots(files: DataFrame) -> DataFrame:
    """``(netloc, body)`` of robots files → rules of their first group for every agent."""
    lines = files.select(
        "netloc", F.posexplode(F.split("body", r"\r?\n|\r")).alias("line_no", "line")
    ).select(
        "netloc",
        "line_no",
        "line",
        F.regexp_extract(F.regexp_replace("line", r"#.*$", ""), r"^\s*([A-Za-z\-]+)\s*:\s*(.*?)\s*$", 1)
        .alias("field"),
        F.regexp_extract(F.regexp_replace("line", r"#.*$", ""), r"^\s*([A-Za-z\-]+)\s*:\s*(.*?)\s*$", 2)
        .alias("value"),
    )
    records = F.sort_array(
        F.collect_list(F.struct("line_no", F.lower("field").alias("field"), "value"))
    )
    # Walk each file once, remembering whether the current group is for every agent.
    start = F.struct(
        F.lit(False).alias("mine"), F.lit(True).alias("open"), F.lit(False).alias("closed"),
        F.array().cast("array<struct<directive:string,path:string>>").alias("rules"),
    )

    def walk(state: Column, line: Column) -> Column:
        agent = line["field"] == "user-agent"
        rule = line["field"].isin("allow", "disallow")
        # An empty line ends the group; rules after it belong to no agent.
        blank = line["field"] == ""
        any_agent = line["value"] == "*"
        fresh = agent & ~state["open"]
        take = rule & state["mine"] & ~state["closed"]
        return F.struct(
            F.when(blank, False).when(fresh, any_agent).when(agent, state["mine"] | any_agent)
            .otherwise(state["mine"]).alias("mine"),
            F.when(agent | blank, True).when(rule, False).otherwise(state["open"]).alias("open"),
            (state["closed"] | ((fresh | blank) & state["mine"] & (F.size(state["rules"]) > 0))).alias("closed"),
            F.when(
                take,
                F.concat(
                    state["rules"],
                    F.array(F.struct(line["field"].alias("directive"), line["value"].alias("path"))),
                ),
            ).otherwise(state["rules"]).alias("rules"),
        )

    rules = F.aggregate(records, start, walk, lambda s: s["rules"])
    # One robots file is one row to begin with; its lines come back together.
    return (
        lines.where((F.col("field") != "") | (F.col("line") == ""))
        .groupBy("netloc")
        .agg(rules.alias("rules"))
        .select("netloc", F.posexplode("rules").alias("rule_no", "rule"))
        .select(
            "netloc", "rule_no", F.lit("*").alias("agent"), "rule.directive", "rule.path"
        )
    )


def _decoded(text: Column) -> Column:
    return F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text)


def allowed(urls: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """Add ``allowed``: the first rule whose path begins the URL's path decides.

    A site without rules allows everything, and so does an empty disallow. The
    rules of a site travel as one array, so each URL stays one row.
    """
    grants = (F.lower("directive") == "allow") | (F.col("path") == "")
    per_site = (
        rules.where(F.col("agent") == "*")
        .groupBy("netloc")
        .agg(
            F.sort_array(
                F.collect_list(
                    F.struct("rule_no", grants.alias("grants"), _decoded(F.col("path")).alias("path"))
                )
            ).alias("_rules")
        )
    )
    local = F.regexp_replace(F.col(url), r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?", "")
    target = F.coalesce(F.nullif(_decoded(local), F.lit("")), F.lit("/"))
    hits = F.filter("_rules", lambda r: F.startswith(F.col("_target"), r["path"]) | (r["path"] == "*"))
    return (
        urls.withColumn("_target", target)
        .withColumn("netloc", url_netloc(F.col(url)))
        .join(per_site, "netloc", "left")
        .withColumn("allowed", F.coalesce(F.get(hits, F.lit(0))["grants"], F.lit(True)))
        .drop("_target", "_rules", "netloc")
    )
