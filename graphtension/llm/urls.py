"""URL filters: prefix rules by host, and trust that flows over host links; DataFrame operations only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphtension.llm.common import table
from graphtension.session import discard, materialize

#: (verdict, rule): a rule is a host and the beginning of a path.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
#: Up to so many rules are tried on each row; more are joined by host.
INLINE_RULES = 256
_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to /, ?, # or the end; A-Z lower-cased; empty without one."""
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), _UP, _LOW)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def _parts(rules: Sequence[tuple[str, str]]) -> list[tuple[str, str, str, str]]:
    """(verdict, rule, host, path), longest rule first; ties by text."""
    rows = [(v, r, r.split("/", 1)[0], "/" + r.split("/", 1)[1] if "/" in r else "") for v, r in rules]
    return sorted(rows, key=lambda x: (-len(x[1]), x[1]))


def with_rule(rows: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """Adds rule and rule_verdict (null where none fits) to rows with host and path."""
    parts = _parts(rules)
    if len(parts) <= INLINE_RULES:
        rule = verdict = F.lit(None).cast("string")
        for v, r, h, p in reversed(parts):
            fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p)
            rule, verdict = F.when(fits, r).otherwise(rule), F.when(fits, v).otherwise(verdict)
        return rows.withColumn("rule", rule).withColumn("rule_verdict", verdict)
    listed = rows.sparkSession.createDataFrame([(i, *x) for i, x in enumerate(parts)], "rank int, rule_verdict string, rule string, r_host string, r_path string")
    labels = F.split("host", r"\.")
    suffix = F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    tried = rows.select("host", "path").distinct().withColumn("r_host", suffix).join(listed, "r_host").filter(F.col("path").startswith(F.col("r_path")))
    best = tried.groupBy("host", "path").agg(F.min(F.struct("rank", "rule", "rule_verdict")).alias("x")).select("host", "path", "x.rule", "x.rule_verdict")
    return rows.join(best, ["host", "path"], "left")


def host_links(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links between hosts, relative ones staying on their host."""
    href = F.explode(F.regexp_extract_all("html", F.lit(r"""(?i)href\s*=\s*["']?([^"'\s>]+)"""), F.lit(1)))
    links = pages.filter("host <> ''").select(F.col("host").alias("src"), href.alias("href"))
    full = F.when(F.col("href").startswith("//"), F.concat(F.lit("x:"), F.col("href"))).otherwise(F.col("href"))
    # mailto:, javascript: and the like lead to no host
    dst = F.when(full.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), host_of(full)).when(full.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), "").otherwise(F.col("src"))
    return links.select("src", dst.alias("dst")).filter("dst <> ''").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


#: Rounds end when the weights that moved in one sum to no more than this; a round moves at most damping times the
#: last, so at 0.85 it comes in 85 rounds at the latest.
SETTLED = 1e-6


def propagate(links: DataFrame, seeds: DataFrame, damping: float = 0.85, settled: float = SETTLED) -> DataFrame:
    """(host, trust, distrust): personalised PageRank from ``seeds`` (host, trusted, blocked; any positive weights).

    Trust follows links, distrust goes against them. A host without a way on keeps what it has. Links are summed by
    host pair before they are joined, sums are partial before they are shuffled, and rounds are written to the shared
    folder two by two. They go on until all but ``settled`` of the weight, which is 1 each, stays where it is.
    """
    hosts = links.select(F.col("src").alias("host")).union(links.select("dst")).union(seeds.select("host")).distinct()
    trusted, blocked = seeds.agg(F.sum("trusted"), F.sum("blocked")).first()
    share = lambda c, total: F.coalesce(F.col(c) / F.lit(total), F.lit(0.0)) if total else F.lit(0.0)
    start = hosts.join(seeds, "host", "left").select("host", share("trusted", trusted).alias("t0"), share("blocked", blocked).alias("d0"))
    loops = lambda one, other: hosts.join(links.select(F.col(one).alias("host")).distinct(), "host", "left_anti").select(F.col("host").alias(one), F.col("host").alias(other))
    flow = lambda one: links.join(links.groupBy(one).agg(F.sum("n").alias("all")), one)
    out = flow("src").select("src", "dst", (F.col("n") / F.col("all")).alias("w")).unionByName(loops("src", "dst").withColumn("w", F.lit(1.0)))
    back = flow("dst").select("src", "dst", (F.col("n") / F.col("all")).alias("w")).unionByName(loops("dst", "src").withColumn("w", F.lit(1.0)))
    start, out, back = materialize(start, "seeds"), materialize(out, "out"), materialize(back, "back")
    zero = F.lit(0.0)

    def step(state: DataFrame) -> DataFrame:
        t = out.join(state, out.src == state.host).select(F.col("dst").alias("host"), (F.col("w") * F.col("trust")).alias("t"), zero.alias("d"))
        d = back.join(state, back.dst == state.host).select(F.col("src").alias("host"), zero.alias("t"), (F.col("w") * F.col("distrust")).alias("d"))
        got = t.unionByName(d).groupBy("host").agg(F.sum("t").alias("t"), F.sum("d").alias("d"))
        mixed = lambda a, b: ((1 - damping) * F.col(a) + damping * F.coalesce(b, zero))
        return start.join(got, "host", "left").select("host", mixed("t0", F.col("t")).alias("trust"), mixed("d0", F.col("d")).alias("distrust"))

    state = start.select("host", F.col("t0").alias("trust"), F.col("d0").alias("distrust"))
    while True:
        one = step(state)
        was = one.select("host", F.col("trust").alias("t1"), F.col("distrust").alias("d1"))
        now = materialize(step(one).join(was, "host"), "trust")
        discard(state)
        state = now
        if now.agg(F.coalesce(F.sum(F.abs(F.col("trust") - F.col("t1")) + F.abs(F.col("distrust") - F.col("d1"))), zero)).first()[0] <= settled:
            return state.select("host", "trust", "distrust")


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, damping: float = 0.85, threshold: float = 0.5) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust) for every row of ``pages`` (page_id, url, html).

    The longest fitting rule decides. Else the host does: it is blocked if distrust is more than ``threshold`` of
    its trust and distrust together. Seeds are the hosts of pages that a rule allows or blocks, by their numbers.

    Nulls and empties: a null url, or one without ``://``, has an empty host and path, fits no rule and is allowed;
    null html has no links. Repeated rows give repeated verdicts, and their links count again. An empty table gives
    no rows. Whole html is read, a page at a time, however long; other columns are ignored.
    """
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "html")
    links = materialize(host_links(rows), "links")
    ruled = with_rule(rows.select("page_id", "host", "path"), rules)
    seeds = ruled.filter("rule is not null and host <> ''").groupBy("host").agg(F.count_if(F.col("rule_verdict") == "allow").alias("trusted"), F.count_if(F.col("rule_verdict") == "block").alias("blocked"))
    flowed = propagate(links, materialize(seeds, "seeds"), damping)
    bad = F.coalesce(F.col("distrust") > threshold * (F.col("trust") + F.col("distrust")), F.lit(False))
    out = ruled.join(flowed, "host", "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", F.when(bad, "block").otherwise("allow")).alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def _oracle(rounds: int = 100, damping: float = 0.85) -> str:
    host = "translate(coalesce(regexp_extract({0}, '://([^/?#]*)', 1), ''), '" + _UP + "', '" + _LOW + "')"
    rule = verdict = "NULL"
    for v, r, h, p in reversed(_parts(RULES)):
        fits = f"(host = '{h}' OR suffix(host, '.{h}')) AND prefix(path, '{p}')"
        rule, verdict = f"CASE WHEN {fits} THEN '{r}' ELSE {rule} END", f"CASE WHEN {fits} THEN '{v}' ELSE {verdict} END"
    steps = [
        f"""p AS (SELECT page_id, {host.format('url')} AS host, coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path, html FROM pages)""",
        f"ruled AS (SELECT page_id, host, path, {rule} AS rule, {verdict} AS rv FROM p)",
        r"""h AS (SELECT host AS src, unnest(regexp_extract_all(html, '(?i)href\s*=\s*["'']?([^"''\s>]+)', 1)) AS href FROM p WHERE host <> '')""",
        "f AS (SELECT src, CASE WHEN href LIKE '//%' THEN 'x:' || href ELSE href END AS href FROM h)",
        f"l AS (SELECT src, dst, count(*) AS n FROM (SELECT src, CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN {host.format('href')} WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN '' ELSE src END AS dst FROM f) WHERE dst <> '' GROUP BY src, dst)",
        "seeds AS (SELECT host, count(*) FILTER (rv = 'allow') AS t, count(*) FILTER (rv = 'block') AS b FROM ruled WHERE rule IS NOT NULL AND host <> '' GROUP BY host)",
        "hosts AS (SELECT src AS host FROM l UNION SELECT dst FROM l UNION SELECT host FROM seeds)",
        "st AS (SELECT host, coalesce(t / nullif((SELECT sum(t) FROM seeds), 0), 0) AS t0, coalesce(b / nullif((SELECT sum(b) FROM seeds), 0), 0) AS d0 FROM hosts LEFT JOIN seeds USING (host))",
        "o AS (SELECT src, dst, n / sum(n) OVER (PARTITION BY src) AS w FROM l UNION ALL SELECT host, host, 1 FROM hosts WHERE host NOT IN (SELECT src FROM l))",
        "bk AS (SELECT src, dst, n / sum(n) OVER (PARTITION BY dst) AS w FROM l UNION ALL SELECT host, host, 1 FROM hosts WHERE host NOT IN (SELECT dst FROM l))",
        f"""tr AS (SELECT 0 AS i, host, t0 AS x FROM st UNION ALL SELECT i + 1, host, {1 - damping} * any_value(t0) + {damping} * coalesce(sum(w * x), 0)
  FROM (SELECT tr.i, st.host, st.t0, o.w, p.x FROM (SELECT DISTINCT i FROM tr WHERE i < {rounds}) tr CROSS JOIN st LEFT JOIN (o JOIN tr p ON o.src = p.host) ON o.dst = st.host) GROUP BY i, host)""",
        f"""di AS (SELECT 0 AS i, host, d0 AS x FROM st UNION ALL SELECT i + 1, host, {1 - damping} * any_value(d0) + {damping} * coalesce(sum(w * x), 0)
  FROM (SELECT di.i, st.host, st.d0, bk.w, p.x FROM (SELECT DISTINCT i FROM di WHERE i < {rounds}) di CROSS JOIN st LEFT JOIN (bk JOIN di p ON bk.dst = p.host) ON bk.src = st.host) GROUP BY i, host)""",
        f"s AS (SELECT host, tr.x AS t, di.x AS d FROM tr JOIN di USING (i, host) WHERE i = {rounds})",
    ]
    return "WITH RECURSIVE " + ",\n".join(steps) + "\nSELECT page_id, host, path, rule, coalesce(rv, CASE WHEN d > 0.5 * (t + d) THEN 'block' ELSE 'allow' END) AS verdict FROM ruled LEFT JOIN s USING (host)"


ORACLE = _oracle()
