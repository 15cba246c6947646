"""URL filter: trust and distrust along the links between hosts.

Pages give a weighted graph of hosts. An edge is a link to a page of another
host, and, with less weight, the relation of a subdomain with the host it is
under, either way, where the tables hold both (who controls one controls the
other). Trust flows from trusted seeds along the edges, distrust from blocked
seeds against them (who links to spam is suspect), both by personalised PageRank
with damping ``damping``; what a host without edges has returns to the seeds. Rounds
go on until no score changes by more than ``tolerance`` times the mean score, or for
a given number of ``rounds``. Seeds are expressions on host names, and tables of
hosts, as from public lists, if they are given. Scores are relative to the mean over all hosts. A host is
blocked if it is a blocked seed, or if its distrust reaches ``threshold`` and
exceeds its trust; pages are kept or dropped with their host.

Each round is one join of edges with scores and one sum by host; the scores are
written every ``cut`` rounds to cut lineage and to compare them, and no host list is
collected. Without any edge the scores are those of the seeds, and no round runs.

Hosts are in lower case without user, port and a final dot. Defined results: a
null URL or one without a host has a null host, scores of 0 and is kept; null
HTML has no links; relative links stay within the host and are no edge. Repeated
rows are pages of their own, and their links count again. Seeds that no page
mentions have no effect; without any seed all scores are 0. An empty table gives
no rows. Extra columns are ignored.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm._common import only, written

#: Parts of host names that mark a blocked seed, as on a public blocklist of categories.
BLOCKED = r"(^|[.-])(spam|spam-farm|cheap-pills|pills|casino|casino-win|adult|adult-x|porn|malware|phishing)([.-]|$)"
#: Trusted seeds: hosts of non-profit domains.
TRUSTED = r"(^|\.)[^.]+\.(org|edu|gov)$"
DAMPING, THRESHOLD, DOMAIN_WEIGHT = 0.85, 0.5, 0.5
#: Greatest change of a score, in shares of the mean, at which rounds end.
TOLERANCE = 1e-4

_AUTHORITY = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)"
_HREF = r"""(?i)<a\s[^>]*?href\s*=\s*["']?((?:https?:)?//[^"'\s>]+)"""


def host(url: Column) -> Column:
    """The host of an absolute URL, or null."""
    h = F.rtrim(F.lower(F.regexp_extract(F.trim(url), _AUTHORITY, 1)), F.lit("."))
    return F.when(h != "", h)


def host_edges(pages: DataFrame, domain_weight: float = DOMAIN_WEIGHT) -> DataFrame:
    """src, dst, weight: the links between different hosts and the relations of domains."""
    p = pages.select(host(F.col("url")).alias("src"), "html").where("src is not null")
    links = p.select("src", F.explode(F.regexp_extract_all("html", F.lit(_HREF), F.lit(1))).alias("to")).select("src", host(F.col("to")).alias("dst"))
    links = links.where("dst is not null and dst <> src").groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))
    own = p.select("src").distinct()
    above = own.select("src", F.regexp_extract("src", r"^[^.]+\.(.+)$", 1).alias("dst"))
    above = above.join(own.select(F.col("src").alias("dst")), "dst", "left_semi").select("src", "dst")
    kin = above.unionByName(above.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).withColumn("weight", F.lit(float(domain_weight)))
    return links.unionByName(kin).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def rank(edges: DataFrame, hosts: DataFrame, seed: str, damping: float, rounds: int | None, cut: int, tolerance: float) -> DataFrame:
    """host, score: personalised PageRank from the hosts where column ``seed`` holds; the scores add up to 1."""
    n, seeds = hosts.agg(F.count("*"), F.coalesce(F.sum(F.col(seed).cast("int")), F.lit(0))).first()
    if not seeds:
        return hosts.select("host", F.lit(0.0).alias("score"))
    start = (F.col(seed).cast("double") / seeds).alias("seed")
    if not edges.limit(1).count():
        return hosts.select("host", start.alias("score"))  # all that a host without edges has returns to the seeds
    out = edges.groupBy("src").agg(F.sum("weight").alias("total"))
    flow = written(edges.join(out, "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("share")), "flow")
    base = written(hosts.join(out.select(F.col("src").alias("host"), F.lit(True).alias("linked")), "host", "left").select("host", start, F.coalesce("linked", F.lit(False)).alias("linked")), "base")
    score = base.select("host", "linked", "seed", F.col("seed").alias("score"), F.lit(None).cast("double").alias("was"))
    for k in itertools.count(1):
        stuck = score.where("not linked").agg(F.coalesce(F.sum("score"), F.lit(0.0)).alias("stuck"))
        came = flow.join(score.select(F.col("host").alias("src"), "score"), "src").groupBy(F.col("dst").alias("host")).agg(F.sum(F.col("score") * F.col("share")).alias("came"))
        now = ((1 - damping) * F.col("seed") + damping * (F.coalesce("came", F.lit(0.0)) + F.col("stuck") * F.col("seed"))).alias("score")
        score = base.join(came, "host", "left").join(score.select("host", F.col("score").alias("was")), "host").crossJoin(F.broadcast(stuck)).select("host", "linked", "seed", now, "was")
        if k % cut == 0 or k == rounds:
            score = written(score, "score")
            if k == rounds or rounds is None and (score.agg(F.max(F.abs(F.col("score") - F.col("was")))).first()[0] or 0.0) * n <= tolerance:
                return score.select("host", "score")


def _marked(named: DataFrame, pattern: str | None, table: DataFrame | None, column: str) -> DataFrame:
    """``named`` with a column that says whether the host matches the expression or is in the table."""
    ok = F.lit(False) if pattern is None else F.col("host").rlike(pattern)
    if table is None:
        return named.withColumn(column, ok)
    known = only(table, "host").select(F.rtrim(F.lower(F.trim("host")), F.lit(".")).alias("host")).where("host is not null").distinct().withColumn("__known", F.lit(True))
    return named.join(known, "host", "left").withColumn(column, ok | F.coalesce("__known", F.lit(False))).drop("__known")


def host_scores(pages: DataFrame, trusted: str | None = TRUSTED, blocked: str | None = BLOCKED, damping: float = DAMPING, rounds: int | None = None, threshold: float = THRESHOLD, domain_weight: float = DOMAIN_WEIGHT, cut: int = 2, tolerance: float = TOLERANCE, trusted_hosts: DataFrame | None = None, blocked_hosts: DataFrame | None = None) -> DataFrame:
    """host, trust, distrust (1 is the mean over hosts), blocked. A host that is a seed of both kinds is a blocked one."""
    p = only(pages, "url", "html")
    edges = written(host_edges(p, domain_weight), "edges")
    named = p.select(host(F.col("url")).alias("host")).where("host is not null").unionByName(edges.select(F.col("dst").alias("host"))).distinct()
    named = _marked(_marked(named, blocked, blocked_hosts, "bad"), trusted, trusted_hosts, "good")
    hosts = written(named.select("host", "bad", (~F.col("bad") & F.col("good")).alias("good")), "hosts")
    n = hosts.count()
    trust = rank(edges, hosts, "good", damping, rounds, cut, tolerance)
    turned = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    distrust = rank(turned, hosts, "bad", damping, rounds, cut, tolerance)
    s = hosts.join(trust.withColumnRenamed("score", "t"), "host").join(distrust.withColumnRenamed("score", "d"), "host")
    s = s.select("host", "bad", F.round(F.col("t") * n, 6).alias("trust"), F.round(F.col("d") * n, 6).alias("distrust"))
    return s.select("host", "trust", "distrust", (F.col("bad") | ((F.col("distrust") >= threshold) & (F.col("distrust") > F.col("trust")))).alias("blocked"))


def filter_urls(pages: DataFrame, **how) -> DataFrame:
    """page_id, host, trust, distrust, allowed of every page."""
    scores = host_scores(pages, **how)
    out = only(pages, "page_id", "url").select("page_id", host(F.col("url")).alias("host")).join(scores, "host", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    return out.select("page_id", "host", zero("trust"), zero("distrust"), (~F.coalesce("blocked", F.lit(False))).alias("allowed"))


def op9_url_filter(spark, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def _sql(rounds: int = 60) -> str:
    """The same rounds by recursion, so many that no score changes by more than the tolerance (0.85 to the power 60 is 6e-5)."""
    href = _HREF.replace("'", "''")
    auth = _AUTHORITY.replace("'", "''")
    host_of = lambda u: f"nullif(rtrim(lower(regexp_extract(trim({u}), '{auth}', 1)), '.'), '')"
    ctes = [
        f"p AS (SELECT page_id, {host_of('url')} AS host, html FROM pages)",
        f"l AS (SELECT host AS src, {host_of('x')} AS dst FROM (SELECT host, unnest(regexp_extract_all(html, '{href}', 1)) AS x FROM p WHERE host IS NOT NULL))",
        "own AS (SELECT DISTINCT host FROM p WHERE host IS NOT NULL)",
        r"up AS (SELECT host AS src, regexp_extract(host, '^[^.]+\.(.+)$', 1) AS dst FROM own WHERE regexp_extract(host, '^[^.]+\.(.+)$', 1) IN (SELECT host FROM own))",
        f"e AS (SELECT src, dst, sum(w) AS w FROM (SELECT src, dst, 1.0 AS w FROM l WHERE dst IS NOT NULL AND dst <> src UNION ALL SELECT src, dst, {DOMAIN_WEIGHT} FROM up UNION ALL SELECT dst, src, {DOMAIN_WEIGHT} FROM up) GROUP BY src, dst)",
        "h0 AS (SELECT host FROM own UNION SELECT dst FROM e)",
        f"h AS (SELECT host, regexp_matches(host, '{BLOCKED}') AS bad, NOT regexp_matches(host, '{BLOCKED}') AND regexp_matches(host, '{TRUSTED}') AS good FROM h0)",
    ]
    for name, seed, src, dst in (("t", "good", "src", "dst"), ("d", "bad", "dst", "src")):
        ctes.append(f"{name}f AS (SELECT {src} AS src, {dst} AS dst, w / sum(w) OVER (PARTITION BY {src}) AS share FROM e)")
        ctes.append(f"{name}0 AS (SELECT host, coalesce({seed}::INT::DOUBLE / nullif((SELECT count(*) FROM h WHERE {seed}), 0), 0) AS seed, host IN (SELECT src FROM {name}f) AS linked FROM h)")
        # One table of what every host sends: along its edges or, if it has none, to the seeds; and to the seeds the rest of the damping.
        ctes.append(f"{name}r AS (SELECT 0 AS k, host, seed AS score FROM {name}0 UNION ALL SELECT k, host, sum(score) FROM (SELECT r.k + 1 AS k, b.host, {1 - DAMPING} * b.seed AS score FROM {name}0 b, (SELECT DISTINCT k FROM {name}r) r UNION ALL SELECT r.k + 1, f.dst, {DAMPING} * f.share * r.score FROM {name}r r JOIN {name}f f ON r.host = f.src UNION ALL SELECT r.k + 1, b.host, {DAMPING} * b.seed * r.score FROM {name}r r JOIN {name}0 x ON r.host = x.host AND NOT x.linked JOIN {name}0 b ON b.seed > 0) WHERE k <= {rounds} GROUP BY k, host)")
        ctes.append(f"{name} AS (SELECT host, score FROM {name}r WHERE k = {rounds})")
    ctes.append("s AS (SELECT h.host, h.bad, round(t.score * (SELECT count(*) FROM h), 6) AS trust, round(d.score * (SELECT count(*) FROM h), 6) AS distrust FROM h JOIN t USING (host) JOIN d USING (host))")
    return "WITH RECURSIVE " + ",\n".join(ctes) + f"\nSELECT page_id, p.host, coalesce(trust, 0) AS trust, coalesce(distrust, 0) AS distrust, NOT coalesce(bad OR (distrust >= {THRESHOLD} AND distrust > trust), false) AS allowed FROM p LEFT JOIN s ON p.host = s.host"


QUERIES = {"op9_url_filter": op9_url_filter}
ORACLE = {"op9_url_filter": _sql()}
