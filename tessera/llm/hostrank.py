"""URL filters: rules by host and path, and propagation of trust and distrust over the link graph of hosts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import discard, materialize, table

#: (rule, verdict): host and path; the longest that fits wins.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: Share of a score that links pass on, and rounds of propagation; what later rounds would add is under DAMPING ** (ROUNDS + 1), two thousandths of the whole.
DAMPING, ROUNDS = 0.85, 38
#: A host is blocked whose distrust is at least so much more than its trust (a host whose every page is blocked has 1 by itself, one whose every link leads there DAMPING).
MARGIN = 0.5
#: Rounds between two materialised steps.
CUT_EVERY = 4
#: Scores that move by no more have settled.
SETTLED = 1e-12
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_HREF = r"""(?i)<a\b[^>]*?[\s"']href\s*=\s*["']?((?:https?:)?//[^"'\s>]+)"""


def host_of(url: Column) -> Column:
    """Between the first :// and /, ?, # or the end, A-Z lower-cased; empty for null or without ://."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to ?, # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits a host (and its subdomains) and a path's start, and its verdict; nulls if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, then in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        at, _, rest = text.partition("/")
        fits = ((host == at) | host.endswith("." + at)) & path.startswith("/" + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(then)).otherwise(verdict)
    return rule, verdict


def host_edges(pages: DataFrame) -> DataFrame:
    """src, dst, weight: pages' absolute links between unlike hosts, counted."""
    links = pages.select(host_of(F.col("url")).alias("src"), F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(_HREF), F.lit(1))).alias("to"))
    full = F.when(F.col("to").startswith("//"), F.concat(F.lit("http:"), "to")).otherwise(F.col("to"))
    return links.select("src", host_of(full).alias("dst")).where("src <> '' AND dst <> '' AND src <> dst").groupBy("src", "dst").agg(F.count("*").alias("weight"))


def propagate(edges: DataFrame, seeds: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING) -> DataFrame:
    """host, score: personalised PageRank from seeds (host, seed >= 0) along edges (src, dst, share), times 1 / (1 - damping).

    Each round is a join of edges with scores on src and a pre-aggregated sum per dst; hot hosts are split by adaptive
    skew joins. Every CUT_EVERY rounds the scores are written to the shared folder, and if nothing moved since, the
    rounds end.
    """
    scores = seeds.select("host", F.col("seed").alias("score"))
    if edges.isEmpty():
        return scores
    edges = materialize(edges, "edges")
    seeds = materialize(seeds, "seeds")
    scores = scores_then = seeds.select("host", F.col("seed").alias("score"))
    for i in range(rounds):
        passed = edges.join(scores, edges.src == scores.host).groupBy("dst").agg(F.sum(F.col("score") * F.col("share")).alias("got"))
        both = seeds.select("host", F.col("seed").alias("score")).unionByName(passed.select(F.col("dst").alias("host"), (F.col("got") * damping).alias("score")))
        scores = both.groupBy("host").agg(F.sum("score").alias("score"))
        if (i + 1) % CUT_EVERY == 0 and i + 1 < rounds:
            old, scores = scores_then, materialize(scores, "scores")
            settled = scores.join(old.withColumnRenamed("score", "was"), "host", "left").where(F.abs(F.col("score") - F.coalesce("was", F.lit(0.0))) > SETTLED).isEmpty()
            discard(old)
            scores_then = scores
            if settled:
                break
    return scores


def judge_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, trust and distrust of every page.

    A host's seed of trust (distrust) is the share of its pages that rules allow (block). Trust flows along links, each
    host dealing its own out by weight. Distrust flows against them: a host takes on the mean distrust of what it links
    to, however many others link there too, so one bad link among a hundred weighs a hundredth. Pages that no rule fits
    get their host's verdict: block if distrust is MARGIN or more above trust, else allow. Null or broken urls have an
    empty host, which takes no part in the graph and is allowed. Repeated pages count each; an empty table gives no rows;
    whole pages are searched for links; other columns don't matter.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    placed = pages.select("page_id", host.alias("host"), path.alias("path")).withColumns({"rule": rule, "ruled": verdict})
    share = lambda v: F.avg(F.when(F.col("ruled") == v, 1.0).otherwise(0.0))
    hosts = materialize(placed.where("host <> ''").groupBy("host").agg(share("allow").alias("allowed"), share("block").alias("blocked")), "hosts")
    edges = materialize(host_edges(pages), "links")
    out = edges.groupBy("src").agg(F.sum("weight").alias("out"))
    forward = edges.join(out, "src").select("src", "dst", (F.col("weight") / F.col("out")).alias("share"))
    backward = forward.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "share")
    trust = propagate(forward, hosts.select("host", F.col("allowed").alias("seed"))).withColumnRenamed("score", "trust")
    distrust = propagate(backward, hosts.select("host", F.col("blocked").alias("seed"))).withColumnRenamed("score", "distrust")
    scored = hosts.select("host").join(trust, "host", "left").join(distrust, "host", "left")
    scored = scored.select("host", F.round(F.coalesce("trust", F.lit(0.0)), 9).alias("trust"), F.round(F.coalesce("distrust", F.lit(0.0)), 9).alias("distrust"))
    blocked = F.coalesce(F.col("distrust") - F.col("trust") >= MARGIN, F.lit(False))
    method = F.when(blocked, "block").otherwise("allow")
    return placed.join(scored, "host", "left").select("page_id", "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"), "trust", "distrust")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of all pages."""
    return judge_urls(table(spark, sf_dir, "pages"))


def _sql() -> str:
    """The same in DuckDB, the rounds unrolled."""
    rule = "NULL"
    ruled = "NULL"
    for text, then in sorted(RULES, key=lambda r: (len(r[0]), r[0])):
        at, _, rest = text.partition("/")
        fits = f"(host = '{at}' OR ends_with(host, '.{at}')) AND starts_with(path, '/{rest}')"
        rule, ruled = f"CASE WHEN {fits} THEN '{text}' ELSE {rule} END", f"CASE WHEN {fits} THEN '{then}' ELSE {ruled} END"
    host = lambda x: f"translate(regexp_extract({x}, '(?s)^.*?://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}')"
    parts = [
        f"p AS (SELECT page_id, {host("coalesce(url, '')")} AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path, html FROM pages)",
        f"r AS (SELECT page_id, host, path, {rule} AS rule, {ruled} AS ruled FROM p)",
        "h AS (SELECT host, avg(CASE WHEN ruled = 'allow' THEN 1.0::DOUBLE ELSE 0 END) AS allowed, avg(CASE WHEN ruled = 'block' THEN 1.0::DOUBLE ELSE 0 END) AS blocked FROM r WHERE host <> '' GROUP BY host)",
        "l AS (SELECT host AS src, unnest(regexp_extract_all(coalesce(html, ''), '%s', 1)) AS target FROM p)" % _HREF.replace("'", "''"),
        f"e AS (SELECT * FROM (SELECT src, {host("CASE WHEN starts_with(target, '//') THEN 'http:' || target ELSE target END")} AS dst, count(*) AS weight FROM l GROUP BY ALL) WHERE src <> '' AND dst <> '' AND src <> dst)",
        "f AS (SELECT src, dst, weight / sum(weight) OVER (PARTITION BY src) AS share FROM e)",
        "b AS (SELECT dst AS src, src AS dst, share FROM f)",
    ]
    for kind, seed, edges in (("t", "allowed", "f"), ("d", "blocked", "b")):
        parts.append(f"{kind}0 AS (SELECT host, {seed} AS score FROM h)")
        for i in range(1, ROUNDS + 1):
            parts.append(f"{kind}{i} AS (SELECT host, sum(score) AS score FROM (SELECT host, {seed} AS score FROM h UNION ALL SELECT dst, {DAMPING} * sum(score * share) FROM {edges} JOIN {kind}{i - 1} ON src = host GROUP BY dst) GROUP BY host)")
    return f"""WITH {", ".join(parts)}
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN coalesce(distrust - trust >= {MARGIN}, false) THEN 'block' ELSE 'allow' END) AS verdict, trust, distrust
FROM r LEFT JOIN (SELECT h.host, round(coalesce(t.score, 0), 9) AS trust, round(coalesce(d.score, 0), 9) AS distrust
FROM h LEFT JOIN t{ROUNDS} t ON h.host = t.host LEFT JOIN d{ROUNDS} d ON h.host = d.host) s USING (host)"""


OP3_SQL = _sql()
