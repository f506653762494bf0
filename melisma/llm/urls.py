"""URL filters: domain rules first, then a path-template tree for each host.

Urls are reduced to counts of (host, segments, label) before anything else, with segments that are variable by their form
(numbers, hashes, dates, long mixed slugs) already replaced by wildcards. The tree is then built level by level on these
counts. Siblings whose pages mostly end there, mostly go on with a variable or mostly with a named segment are peers. A
child becomes the wildcard of its peers when it is statistically like them: the shares of the three ways are the peers'
within their errors, and so is the share of blocked ones among its labelled pages (a child without labels does not
contradict). So branches that are built alike and labelled alike merge, with or without labels of their own. A child with too
small a share of its parent's pages among many siblings joins its peers' wildcard too. A template is rejected when its labelled purity, smoothed towards a prior share by a number of pseudo-pages and a part
of its unlabelled pages, says that most of its pages are blocked.

Labels are the verdicts of the rules for the urls that a rule fits. Levels are built to the deepest path present; beyond
``DEPTH`` levels the rest of a path is one segment.

Defined results: null urls, and urls without ``://``, have empty host and path and no rule; a template
without labels has the prior share and is allowed; a purity of exactly the limit is allowed; of rules of equal length that
fit the later one wins; urls of any length are read whole; repeated rows count as often as they occur and each gets its row;
an empty table gives no rows. A hot host costs nothing special: counts are summed before the shuffle, and the verdicts join
pages through adaptive joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from melisma.llm.common import table, written

RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
DEPTH = 6
#: Children of at least this share of their parent's pages, or of a parent with at most so many, are not rare.
MIN_SHARE, FEW = 0.02, 8
#: Pseudo-pages, and the part of the unlabelled pages, by which a template's share of blocked pages is drawn towards the
#: prior share; the share that rejects.
SMOOTH, UNSEEN, PRIOR, REJECT = 4.0, 0.25, 0.1, 0.5

_LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, *_LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The text and the verdict of the longest rule that fits; null if none does."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, domain, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(start)
        text, verdict = F.when(fits, domain + start).otherwise(text), F.when(fits, what).otherwise(verdict)
    return text, verdict


def form_of(segment: Column) -> Column:
    """A segment with what is variable by its form replaced by a wildcard; the extension stays."""
    name, ext = F.regexp_extract(segment, r"(?s)^(.*?)(\.[A-Za-z]{1,5})?$", 1), F.regexp_extract(segment, r"(?s)^(.*?)(\.[A-Za-z]{1,5})?$", 2)
    kind = (
        F.when(name.rlike(r"^[0-9]+$"), F.lit("{number}"))
        .when(name.rlike(r"^[0-9]{4}-[0-9]{2}(-[0-9]{2})?$"), F.lit("{date}"))
        .when(name.rlike(r"^[0-9a-fA-F-]{16,}$"), F.lit("{hash}"))
        .when((F.length(name) >= 24) | (name.rlike("[0-9]") & (F.length(name) >= 12)), F.lit("{slug}"))
        .otherwise(name)
    )
    return F.concat(kind, ext)


def segments_of(path: Column, depth: int) -> list[Column]:
    """The forms of a path's segments; the last one takes the rest of the path."""
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    rest = F.when(F.size(parts) >= depth, F.array_join(F.slice(parts, depth, F.greatest(F.lit(1), F.size(parts))), "/"))
    return [form_of(F.get(parts, F.lit(i))) for i in range(depth - 1)] + [form_of(rest)]


def _like(x: Column, n: Column, of_x: Column, of: Column) -> Column:
    """Whether a child's share x / n is its peers' of_x / of within two standard errors and half a page."""
    p = of_x / of
    return F.abs(x / n - p) <= 2.0 * F.sqrt(p * (1.0 - p) / n) + 0.5 / n


def templates(counts: DataFrame, depth: int = DEPTH) -> DataFrame:
    """host, s1..s<depth>, n, bad, good (labelled pages) -> the same keys with ``template``.

    ``counts`` has one row for each host and tuple of segments (an absent segment is null)."""
    tree = counts.withColumn("template", F.lit(""))
    deepest = counts.agg(F.max(sum((F.col(f"s{i}").isNotNull().cast("int") for i in range(1, depth + 1)), F.lit(0)))).first()[0] or 0
    for i in range(1, deepest + 1):
        s, below = F.col(f"s{i}"), F.col(f"s{i + 1}") if i < depth else F.lit(None).cast("string")
        shapes = F.sum(F.when(below.isNull(), F.col("n")).otherwise(0)).alias("leaf"), F.sum(F.when(below.startswith("{"), F.col("n")).otherwise(0)).alias("var")
        level = tree.groupBy("host", "template", s.alias("s")).agg(*[F.sum(c).alias(c) for c in ("n", "bad", "good")], *shapes)
        named = F.col("n") - F.col("leaf") - F.col("var")
        level = level.withColumn("kind", F.when((F.col("leaf") >= F.col("var")) & (F.col("leaf") >= named), "leaf").when(F.col("var") >= named, "variable").otherwise("named"))
        peers = level.groupBy("host", "template", "kind").agg(*[F.sum(c).alias(f"of_{c}") for c in ("n", "bad", "good", "leaf", "var")], F.count("*").alias("k"))
        parent = peers.groupBy("host", "template").agg(F.sum("of_n").alias("all"), F.sum("k").alias("siblings"))
        level = level.join(peers.drop("k"), ["host", "template", "kind"]).join(parent, ["host", "template"])
        seen, of_seen = F.col("bad") + F.col("good"), F.col("of_bad") + F.col("of_good")
        alike = (seen == 0) | _like(F.col("bad"), F.greatest(seen, F.lit(1)), F.col("of_bad"), F.greatest(of_seen, F.lit(1)))
        for x in ("leaf", "var"):
            alike = alike & _like(F.col(x), F.col("n"), F.col(f"of_{x}"), F.col("of_n"))
        rare = (F.col("siblings") > FEW) & (F.col("n") < MIN_SHARE * F.col("all"))
        own = F.when(F.col("s").isNull(), F.lit("")).when(F.col("s").startswith("{"), F.col("s")).when(rare | alike, F.concat(F.lit("*"), F.col("kind"))).otherwise(F.col("s"))
        a, b = tree.alias("a"), level.select("host", "template", F.col("s"), own.alias("own")).alias("b")
        on = (F.col("a.host") == F.col("b.host")) & (F.col("a.template") == F.col("b.template")) & F.col(f"a.s{i}").eqNullSafe(F.col("b.s"))
        rest = [F.col(f"a.{c}") for c in tree.columns if c not in ("template",)]
        tree = a.join(b, on).select(*rest, F.when(F.col("own") == "", F.col("a.template")).otherwise(F.concat(F.col("a.template"), F.lit("/"), F.col("own"))).alias("template"))
        tree = written(tree, "paths")
    return tree


def purity() -> Column:
    """The smoothed share of blocked pages of a group."""
    weight = SMOOTH + UNSEEN * (F.sum("n") - F.sum("bad") - F.sum("good"))
    return (F.sum("bad") + PRIOR * weight) / (F.sum("bad") + F.sum("good") + weight)


def judge(pages: DataFrame, rules=RULES, depth: int = DEPTH) -> DataFrame:
    """page_id, host, path, rule, verdict and the template of every row of ``pages`` that has an id."""
    url = F.col("url")
    p = pages.where(F.col("page_id").isNotNull()).select(F.col("page_id").cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    text, verdict = rule_for(F.col("host"), F.col("path"), rules)
    p = p.select("*", text.alias("rule"), verdict.alias("ruled"))
    p = p.select("*", *[s.alias(f"s{i + 1}") for i, s in enumerate(segments_of(F.col("path"), depth))])
    keys = ["host", *[f"s{i + 1}" for i in range(depth)]]
    counts = p.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(F.col("ruled") == "block").alias("bad"), F.count_if(F.col("ruled") == "allow").alias("good"))
    tree = templates(written(counts, "paths"), depth)
    scored = tree.groupBy("host", "template").agg(F.when(purity() > REJECT, "block").otherwise("allow").alias("judged"))
    found = tree.select(*keys, "template").join(scored, ["host", "template"])
    a, b = p.alias("a"), found.alias("b")
    on = F.col("a.host") == F.col("b.host")
    for k in keys[1:]:
        on = on & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    return a.join(b, on).select("a.page_id", "a.host", "a.path", "a.rule", F.coalesce("a.ruled", "b.judged").alias("verdict"), "b.template")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


def _oracle(rules=RULES, depth: int = DEPTH) -> str:
    """op8 in DuckDB's SQL, a pair of tables for each level of the tree."""
    lower = "translate({0}, '%s', '%s')" % _LOWER
    whole = "regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1)"
    order = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    fits = [(f"(host = '{dom}' OR ends_with(host, '.{dom}')) AND starts_with(path, '{start}')", what, dom + start) for what, dom, start in order]
    rule = "CASE " + " ".join(f"WHEN {f} THEN '{t}'" for f, _, t in fits) + " END"
    ruled = "CASE " + " ".join(f"WHEN {f} THEN '{v}'" for f, v, _ in fits) + " END"
    name, ext = (f"regexp_extract({{0}}, '(?s)^(.*?)(\\.[A-Za-z]{{{{1,5}}}})?$', {g})" for g in (1, 2))
    form = f"CASE WHEN {{0}} IS NULL THEN NULL WHEN regexp_matches({name}, '^[0-9]+$') THEN '{{{{number}}}}' WHEN regexp_matches({name}, '^[0-9]{{{{4}}}}-[0-9]{{{{2}}}}(-[0-9]{{{{2}}}})?$') THEN '{{{{date}}}}' WHEN regexp_matches({name}, '^[0-9a-fA-F-]{{{{16,}}}}$') THEN '{{{{hash}}}}' WHEN length({name}) >= 24 OR (regexp_matches({name}, '[0-9]') AND length({name}) >= 12) THEN '{{{{slug}}}}' ELSE {name} END || {ext}"
    s = [f"s{i + 1}" for i in range(depth)]
    tables = {
        "u": f"SELECT page_id, coalesce({lower.format(chr(34) + 'h' + chr(34))}, '') AS host, coalesce(p, '') AS path FROM (SELECT page_id, regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1) AS h, {whole} AS p FROM pages WHERE page_id IS NOT NULL)",
        "r": f"SELECT *, {rule} AS rule, {ruled} AS ruled, list_filter(string_split(path, '/'), lambda x: x <> '') AS parts FROM u",
        "e": f"SELECT *, list_append(parts[1:{depth - 1}], CASE WHEN len(parts) >= {depth} THEN array_to_string(parts[{depth}:], '/') END) AS whole FROM r",
        "p": "SELECT page_id, host, path, rule, ruled, " + ", ".join(f"{form.format(f'part{i + 1}')} AS {c}" for i, c in enumerate(s)) + " FROM (SELECT *, " + ", ".join(f"parts[{i + 1}] AS part{i + 1}" for i in range(depth - 1)) + f", whole[-1] AS part{depth} FROM e)",
        "t0": f"SELECT host, {', '.join(s)}, count(*) AS n, count_if(ruled IS NOT DISTINCT FROM 'block') AS bad, count_if(ruled IS NOT DISTINCT FROM 'allow') AS good, '' AS template FROM p GROUP BY ALL",
    }
    for i, c in enumerate(s, 1):
        below = f"s{i + 1}" if i < depth else "NULL"
        tables[f"l{i}"] = f"SELECT host, template, {c} AS s, sum(n) AS n, sum(bad) AS bad, sum(good) AS good, sum(CASE WHEN {below} IS NULL THEN n ELSE 0 END) AS leaf, sum(CASE WHEN starts_with({below}, '{{') THEN n ELSE 0 END) AS var FROM t{i - 1} GROUP BY host, template, {c}"
        tables[f"q{i}"] = f"SELECT *, sum(n) OVER w AS of_n, sum(bad) OVER w AS of_bad, greatest(1, sum(bad + good) OVER w) AS of_seen, sum(leaf) OVER w AS of_leaf, sum(var) OVER w AS of_var, sum(n) OVER v AS all_, count(*) OVER v AS siblings, greatest(1, bad + good) AS seen FROM (SELECT *, CASE WHEN leaf >= var AND leaf >= n - leaf - var THEN 'leaf' WHEN var >= n - leaf - var THEN 'variable' ELSE 'named' END AS kind FROM l{i}) WINDOW w AS (PARTITION BY host, template, kind), v AS (PARTITION BY host, template)"
        like = "abs({0} / {1} - {2} / {3}) <= 2.0::DOUBLE * sqrt({2} / {3} * (1.0::DOUBLE - {2} / {3}) / {1}) + 0.5::DOUBLE / {1}"
        alike = f"(bad + good = 0 OR {like.format('bad', 'seen', 'of_bad', 'of_seen')}) AND {like.format('leaf', 'n', 'of_leaf', 'of_n')} AND {like.format('var', 'n', 'of_var', 'of_n')}"
        tables[f"o{i}"] = f"SELECT host, template, s, CASE WHEN s IS NULL THEN '' WHEN starts_with(s, '{{') THEN s WHEN (siblings > {FEW} AND n < {MIN_SHARE} * all_) OR ({alike}) THEN '*' || kind ELSE s END AS own FROM q{i}"
        tables[f"t{i}"] = f"SELECT a.host, {', '.join('a.' + x for x in s)}, a.n, a.bad, a.good, CASE WHEN own = '' THEN a.template ELSE a.template || '/' || own END AS template FROM t{i - 1} a JOIN o{i} b ON a.host = b.host AND a.template = b.template AND a.{c} IS NOT DISTINCT FROM b.s"
    last = f"t{depth}"
    tables["v"] = f"SELECT host, template, CASE WHEN (bad + {PRIOR}::DOUBLE * w) / (bad + good + w) > {REJECT} THEN 'block' ELSE 'allow' END AS judged FROM (SELECT host, template, sum(bad) AS bad, sum(good) AS good, {SMOOTH}::DOUBLE + {UNSEEN}::DOUBLE * (sum(n) - sum(bad) - sum(good)) AS w FROM {last} GROUP BY host, template)"
    on = " AND ".join(f"p.{x} IS NOT DISTINCT FROM {last}.{x}" for x in ("host", *s))
    return f"WITH {', '.join(f'{k} AS ({v})' for k, v in tables.items())} SELECT p.page_id, p.host, p.path, p.rule, coalesce(p.ruled, v.judged) AS verdict, v.template FROM p JOIN {last} ON {on} JOIN v ON v.host = {last}.host AND v.template = {last}.template"


ORACLE = _oracle()
