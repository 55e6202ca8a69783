"""URL filter: rules first, then trust and distrust carried over links between hosts.

A rule names a host and a path prefix; it fits the host and its subdomains, and the longest fitting
rule decides. For other pages the host's place in the link graph does: personalised PageRank spreads
trust from allowed hosts along links, and distrust from blocked hosts against them (who links to bad
hosts is suspect). Hosts link where a page names another host in an href or src, and a host and its parent
domain, if both have pages, vouch for each other.

A seed keeps ``UNIT``. A host's trust is what its linkers pass on, each its own in equal shares. A host's distrust is
the mean of its targets', so it tells how often a walk along its links ends at blocked hosts, whatever the number of
others that link there. Both lose 15 per cent a link. A host has a threshold of its own: it is blocked if its distrust
exceeds its trust and at least half of what it would be if all its links were as bad as its worst. Scores are
whole numbers (a seed has ``UNIT``, a share below one counts as none), so that sums do not depend on their order;
rounds go on until no score moves by more than ``STILL``, or ``rounds`` are done.

Only DataFrame and SQL functions are used. Links are made distinct per pair of hosts with map-side
combining before anything is joined, so a host with a third of all pages is one node like others. A round
is one join and one combining aggregate over the distinct links.

Null and malformed urls have an empty host and path, fit no rule and get ``allow``: no host, no
distrust. Null html has no links. Repeated rows are judged alike; every row gives one row.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloudtally.runtime import durable

UNIT = 1_000_000_000
DAMPING = 85  # per cent of a score that goes on along links
ROUNDS = 60  # by then every score is still: 0.85 to the power of 60 is less than STILL
STILL = UNIT // 10_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINKS = r"""(?:href|src|HREF|SRC)\s*=\s*["']?(?:[hH][tT][tT][pP][sS]?:)?//([^/?#"'\s<>]+)"""

Rule = tuple[str, str, str]  # verdict, host, path prefix


def lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a url."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def ruled(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, both null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, name, prefix in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(prefix)
        rule, verdict = F.when(fits, name + prefix).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def judged(pages: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """page_id, host, path, rule and the rule's verdict of every page."""
    host, path = parts(F.col("url"))
    cut = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    return cut.select("*", rule.alias("rule"), verdict.alias("ruled"))


def links(pages: DataFrame) -> DataFrame:
    """Distinct links (source, target) between different hosts."""
    host, _ = parts(F.col("url"))
    named = pages.select(host.alias("source"), F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(LINKS), 1))).alias("target"))
    told = named.select("source", lower(F.col("target")).alias("target")).filter("source <> '' and source <> target").distinct()
    hosts = pages.select(host.alias("host")).filter("host <> ''").distinct()
    nested = hosts.select("host", F.expr("substring(host, instr(host, '.') + 1)").alias("parent")).filter("instr(host, '.') > 0 and parent <> ''")
    nested = nested.join(hosts.select(F.col("host").alias("parent")), "parent", "left_semi")
    both = nested.select(F.col("host").alias("source"), F.col("parent").alias("target"))
    return told.union(both).union(both.select("target", "source")).distinct()


def seeds(pages: DataFrame) -> DataFrame:
    """Host and kind: trust where a rule allows over half of its pages, distrust where one blocks over half."""
    share = lambda says: F.sum(F.when(F.col("ruled") == says, 2).otherwise(0)) > F.count("*")
    kind = F.when(share("allow"), "trust").when(share("block"), "distrust")
    return pages.filter("host <> ''").groupBy("host").agg(kind.alias("kind")).filter("kind is not null")


def _rounds(start: DataFrame, step: Callable[[DataFrame], DataFrame], rounds: int) -> DataFrame:
    """Scores (host, score) after rounds that end when all are still; four rounds at a time are stored and compared."""
    now = durable(start)
    done = 0
    while done < rounds:
        later, again = now, min(4, rounds - done)
        for _ in range(again):
            later = step(later)
        later, done = durable(later), done + again
        before = now.select("host", F.col("score").alias("before"))
        moved = later.join(before, "host", "left").filter(F.abs(F.col("score") - F.coalesce("before", F.lit(0))) > STILL)
        now = later
        if moved.isEmpty():
            break
    return now


def scores(edges: DataFrame, start: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """host, trust, distrust and the largest distrust of its targets, after at most ``rounds`` rounds."""
    out = edges.groupBy("source").agg(F.count("*").alias("degree"))
    edges = durable(edges.join(out, "source"))
    seeded = durable(start)
    of = lambda kind, score: seeded.filter(F.col("kind") == kind).select("host", F.lit(score).cast("long").alias("score"))
    good, bad = of("trust", UNIT), of("distrust", UNIT)

    def forward(now: DataFrame) -> DataFrame:
        passed = edges.join(now.withColumnRenamed("host", "source"), "source")
        shares = passed.groupBy(F.col("target").alias("host")).agg(F.expr(f"sum((score * {DAMPING}) div (100 * degree))").alias("score"))
        return shares.union(good).groupBy("host").agg(F.max("score").alias("score"))

    def backward(now: DataFrame) -> DataFrame:
        met = edges.join(now.withColumnRenamed("host", "target"), "target")
        mean = met.groupBy(F.col("source").alias("host")).agg(F.expr(f"({DAMPING} * sum(score)) div (100 * max(degree))").alias("score"))
        return mean.union(bad).groupBy("host").agg(F.max("score").alias("score"))

    trust, distrust = _rounds(good, forward, rounds), _rounds(bad, backward, rounds)
    worst = edges.join(distrust.withColumnRenamed("host", "target"), "target").groupBy(F.col("source").alias("host")).agg(F.max("score").alias("worst"))
    named = distrust.withColumnRenamed("score", "distrust").join(trust.withColumnRenamed("score", "trust"), "host", "full").join(worst, "host", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return named.select("host", zero("trust"), zero("distrust"), zero("worst"))


#: More distrust than trust, and half of what it could be: the same words in both forms.
BAD = f"distrust > trust AND 200 * distrust >= {DAMPING} * worst"


def verdicts(pages: DataFrame, rules: Sequence[Rule], rounds: int = ROUNDS) -> DataFrame:
    """page_id, host, path, rule and verdict of every page."""
    cut = judged(pages, rules)
    found = scores(links(pages), seeds(cut), rounds)
    bad = durable(found.filter(BAD).select("host", F.lit("block").alias("spread")))
    return cut.join(bad, "host", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("ruled", "spread", F.lit("allow")).alias("verdict")
    )


def check_sql(rules: Sequence[Rule], rounds: int = ROUNDS) -> str:
    """The same verdicts as DuckDB SQL over the view ``pages``."""
    low = f"translate({{}}, '{UPPER}', '{LOWER}')"
    order = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r))
    fits = [f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')" for _, h, p in order]
    case = lambda values: "CASE " + " ".join(f"WHEN {f} THEN '{v}'" for f, v in zip(fits, values, strict=True)) + " END"
    steps = ""
    for k in range(rounds):
        steps += f""",
        t{k + 1} AS (SELECT host, max(score)::BIGINT AS score FROM (
            SELECT target AS host, sum((score * {DAMPING}) // (100 * degree)) AS score FROM t{k} JOIN ways ON host = source GROUP BY target
            UNION ALL SELECT host, {UNIT} FROM seeds WHERE kind = 'trust') GROUP BY host),
        d{k + 1} AS (SELECT host, max(score)::BIGINT AS score FROM (
            SELECT source AS host, ({DAMPING} * sum(score)) // (100 * max(degree)) AS score FROM d{k} JOIN ways ON host = target GROUP BY source
            UNION ALL SELECT host, {UNIT} FROM seeds WHERE kind = 'distrust') GROUP BY host)"""
    pattern = LINKS.replace("'", "''")
    return f"""
        WITH rest AS (SELECT *, coalesce(CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END, '') AS r FROM pages),
        cut AS (SELECT page_id, html, {low.format("regexp_extract(r, '^([^/?#]*)', 1)")} AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
        judged AS (SELECT *, {case([h + p for _, h, p in order])} AS rule, {case([v for v, _, _ in order])} AS ruled FROM cut),
        named AS (SELECT host, {low.format("t")} AS t FROM (SELECT host, unnest(regexp_extract_all(html, '{pattern}', 1)) AS t FROM cut)),
        hosts AS (SELECT DISTINCT host FROM cut WHERE host <> ''),
        nested AS (SELECT host, substr(host, instr(host, '.') + 1) AS parent FROM hosts WHERE instr(host, '.') > 0),
        owned AS (SELECT n.host, parent FROM nested n JOIN hosts h ON n.parent = h.host WHERE parent <> ''),
        links AS (SELECT host AS a, t AS b FROM named WHERE host <> '' AND host <> t
            UNION SELECT host, parent FROM owned UNION SELECT parent, host FROM owned),
        ways AS (SELECT a AS source, b AS target, count(*) OVER (PARTITION BY a) AS degree FROM links),
        seeds AS (SELECT * FROM (SELECT host, CASE WHEN 2 * count(*) FILTER (ruled = 'allow') > count(*) THEN 'trust'
            WHEN 2 * count(*) FILTER (ruled = 'block') > count(*) THEN 'distrust' END AS kind
            FROM judged WHERE host <> '' GROUP BY host) WHERE kind IS NOT NULL),
        t0 AS (SELECT host, {UNIT}::BIGINT AS score FROM seeds WHERE kind = 'trust'),
        d0 AS (SELECT host, {UNIT}::BIGINT AS score FROM seeds WHERE kind = 'distrust'){steps},
        worst AS (SELECT source AS host, max(score) AS worst FROM d{rounds} JOIN ways ON host = target GROUP BY source),
        found AS (SELECT host, coalesce(t.score, 0) AS trust, coalesce(d.score, 0) AS distrust, coalesce(worst, 0) AS worst
            FROM d{rounds} d FULL JOIN t{rounds} t USING (host) LEFT JOIN worst USING (host))
        SELECT page_id, j.host, path, rule, coalesce(ruled, CASE WHEN {BAD} THEN 'block' END, 'allow') AS verdict
        FROM judged j LEFT JOIN found f ON j.host = f.host"""
