"""URL filters by a path-template tree, in DataFrame functions only.

Explicit rules (host suffix, path prefix, longest wins) decide the urls they fit, and so does a seed word in the host or
path (block). All other verdicts come from the tree, which learns from labelled pages: by rule, by seed word, or by what
the page shows (an abusive or spam word: `block`; enough other text: `allow`; neither: no label).

The tree, per host: digits and long hexadecimal runs of a segment are wildcards from the start; then, level by level,
segments that are too many and too rare under their parent become `*` (variable). Labelled segments that are left (at
most max(max_children, 1 / least_share) a parent) are put in the order of their labelled rates, and neighbours whose
rates don't differ significantly are merged to one branch, `+1`, `+2` and so on by rising rate; a segment that resembles none
stays, and so does one without labels. Below `max_depth` a path is `**`. A template is rejected if its smoothed labelled
purity, (blocked + m * prior) / (labelled + m), reaches `purity`; the prior is the host's rate, smoothed by one half in turn.

All levels work on counts of distinct (host, generalised path), pre-aggregated before they are shuffled, so a host with
a third of all rows is no larger a group than others; steps join back by (host, template, segment). Verdicts join back by
(host, path shape), sent to every task if they are few and short (counted), else shuffled.

A null url, or one without `://`, has empty host and path, no rule and its own template; a null or empty page has no
label of its own. Urls and pages of any length are read whole. Rules of equal length: the later in the alphabet wins;
branches of equal rate go by their segment. Repeated rows return each; an empty table gives no rows; of further columns only those
asked for by `carry` are kept, whatever the names of the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Words of hosts and paths that block a url.
SEEDS = ("casino", "pills", "free-bets", "spam", "ads-track")
#: Words of a page's visible text that label it `block`, and bytes of other visible text that label it `allow`.
SHOWN = ("casino", "viagra", "jackpot", "idiot", "moron", "scum", "worthless", "pathetic", "loser")
LEAST_TEXT = 200
HIDDEN, TAG = "(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->", "<[^>]*>"
MAX_DEPTH, MAX_CHILDREN, LEAST_SHARE = 5, 32, 0.02
#: Normal quantile of the test that keeps two branches apart, weight of the neutral prior, least purity of a rejected template.
Z, M, PURITY = 1.96, 2.0, 0.8


def host_of(url: Column) -> Column:
    return F.coalesce(common.lower_ascii(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; nulls if none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        own, _, rest = rule.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith("/" + rest)
        name, verdict = F.when(fits, F.lit(rule)).otherwise(name), F.when(fits, F.lit(says)).otherwise(verdict)
    return name, verdict


def shape_of(path: Column, max_depth: int) -> Column:
    """Segments with digits and long hexadecimal runs as wildcards."""
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    wild = F.transform(segments, lambda s: F.regexp_replace(F.regexp_replace(s, r"[0-9a-fA-F]{12,}", "{h}"), r"[0-9]+", "{n}"))
    return F.when(F.size(wild) > max_depth, F.concat(F.slice(wild, 1, max_depth), F.array(F.lit("**")))).otherwise(wild)


def any_case(words: tuple[str, ...]) -> str:
    """A pattern for one of the words in ASCII letters of either case, not inside a longer one."""
    return "(^|[^a-zA-Z])(" + "|".join("".join(f"[{c}{c.upper()}]" for c in w) for w in words) + ")([^a-zA-Z]|$)"


def visible_text(html: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(html, HIDDEN, " "), TAG, " ")


def template_tree(leaves: DataFrame, max_depth: int = MAX_DEPTH, max_children: int = MAX_CHILDREN, least_share: float = LEAST_SHARE, z: float = Z) -> DataFrame:
    """leaves (host, shape, n, blocked, allowed: one row per host and shape) with template, an array of segments."""
    tree = leaves.withColumn("template", F.array().cast("array<string>"))
    node = ["host", "template"]
    deepest = leaves.agg(F.coalesce(F.max(F.size("shape")), F.lit(0))).first()[0]
    for d in range(min(max_depth, deepest)):
        here = tree.withColumn("child", F.get("shape", F.lit(d)))
        children = here.filter("child is not null").groupBy(*node, "child").agg(F.sum("n").alias("n"), F.sum("blocked").alias("b"), F.sum(F.col("blocked") + F.col("allowed")).alias("l"))
        parents = children.groupBy(*node).agg(F.count("*").alias("k"), F.sum("n").alias("all_n"))
        both = children.join(parents, node)
        variable = (F.col("k") > max_children) & (F.col("n") < least_share * F.col("all_n"))
        # what isn't variable: at most max(max_children, 1 / least_share) segments a parent, so the windows are small
        rated = both.filter(~variable & (F.col("l") > 0)).withColumn("rate", (F.col("b") + 0.5) / (F.col("l") + 1))
        order = Window.partitionBy(*node).orderBy("rate", "child")
        b, l, rate = (F.lag(c).over(order) for c in ("b", "l", "rate"))
        pooled = (F.col("b") + b + 0.5) / (F.col("l") + l + 1)
        error = F.sqrt(pooled * (1 - pooled) * (1 / (F.col("l") + 1) + 1 / (l + 1)))
        rated = rated.withColumn("apart", F.coalesce((F.col("rate") - rate >= z * error).cast("int"), F.lit(1)))
        rated = rated.withColumn("branch", F.sum("apart").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        alike = F.count("*").over(Window.partitionBy(*node, "branch"))
        merged = rated.select(*node, "child", F.when(alike > 1, F.concat(F.lit("+"), F.col("branch").cast("string"))).otherwise(F.col("child")).alias("step"))
        steps = both.filter(variable).select(*node, "child", F.lit("*").alias("step")).union(merged)
        tree = here.join(steps, [*node, "child"], "left").select("host", "shape", "n", "blocked", "allowed", F.when(F.col("child").isNull(), F.col("template")).otherwise(F.concat("template", F.array(F.coalesce("step", "child")))).alias("template"))
        tree = common.cut(tree)
    return tree.withColumn("template", F.when(F.size("shape") > max_depth, F.concat("template", F.array(F.lit("**")))).otherwise(F.col("template")))


def judge(
    df: DataFrame, url_col: str = "url", html_col: str | None = None, carry: tuple[str, ...] = ("page_id",), rules: tuple[tuple[str, str], ...] = RULES,
    seeds: tuple[str, ...] = SEEDS, max_depth: int = MAX_DEPTH, m: float = M, purity: float = PURITY,
) -> DataFrame:
    """carry, host, path, rule, verdict, template, purity for each row of df. html_col: a page's text, if it is to be learned from."""
    cols = [F.col(c) for c in carry]
    text = F.lit(None).cast("string") if html_col is None else visible_text(F.col(html_col))
    rows = df.select(*cols, host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"), text.alias("_text"))
    shown = F.when(F.col("_text").rlike(any_case(SHOWN)), "block").when(F.octet_length("_text") >= LEAST_TEXT, "allow")
    rule, says = rule_of(F.col("host"), F.col("path"), rules)
    seeded = F.lit(False)
    for word in seeds:
        seeded = seeded | F.col("host").contains(word) | F.col("path").contains(word)
    rows = rows.select(*cols, "host", "path", rule.alias("rule"), F.coalesce(says, F.when(seeded, "block")).alias("_says"), shown.alias("_shown"), shape_of(F.col("path"), max_depth).alias("shape"))
    label = F.coalesce("_says", "_shown")
    leaves = common.cut(rows.groupBy("host", "shape").agg(F.count("*").alias("n"), F.count_if(label == "block").alias("blocked"), F.count_if(label == "allow").alias("allowed")))
    tree = template_tree(leaves, max_depth)
    known = tree.groupBy("host", "template").agg(F.sum("blocked").alias("b"), F.sum(F.col("blocked") + F.col("allowed")).alias("l"))
    prior = leaves.groupBy("host").agg(((F.sum("blocked") + m / 2) / (F.sum(F.col("blocked") + F.col("allowed")) + m)).alias("prior"))
    rated = known.join(prior, "host").select("host", "template", ((F.col("b") + m * F.col("prior")) / (F.col("l") + m)).alias("purity"))
    by_shape = tree.select("host", "shape", "template").join(rated, ["host", "template"])
    verdicts = common.small(common.cut(by_shape.select("host", "shape", F.concat(F.lit("/"), F.array_join("template", "/")).alias("template"), "purity")))
    own = F.when(F.col("purity") >= purity, "block").otherwise("allow")
    return rows.drop("_shown").join(verdicts, ["host", "shape"]).select(*cols, "host", "path", "rule", F.coalesce("_says", own).alias("verdict"), "template", "purity")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(common.table(spark, sf_dir, "pages"), html_col="html")


QUERIES = {"op1_url_filter": op1_url_filter}


def _oracle(max_depth: int = MAX_DEPTH) -> str:
    """The same tree in DuckDB SQL, one common table expression per level."""
    rules = sorted(RULES, key=lambda r: (-len(r[1]), r[1]))

    def fits(rule: str) -> str:
        own, _, rest = rule.partition("/")
        return f"(host = '{own}' OR ends_with(host, '.{own}')) AND starts_with(path, '/{rest}')"

    rule = "CASE " + " ".join(f"WHEN {fits(r)} THEN '{r}'" for _, r in rules) + " END"
    says = "CASE " + " ".join(f"WHEN {fits(r)} THEN '{s}'" for s, r in rules) + " END"
    seeded = " OR ".join(f"contains(host, '{w}') OR contains(path, '{w}')" for w in SEEDS)
    lower = f"translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), '{common.UPPER}', '{common.LOWER}')"
    wild = "list_transform(list_filter(string_split(path, '/'), lambda s: s <> ''), lambda s: regexp_replace(regexp_replace(s, '[0-9a-fA-F]{12,}', '{h}', 'g'), '[0-9]+', '{n}', 'g'))"
    shown = f"regexp_replace(regexp_replace(html, '{HIDDEN}', ' ', 'g'), '{TAG}', ' ', 'g')"
    sql = f"""
WITH r0 AS (SELECT page_id, coalesce({lower}, '') AS host, coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path, {shown} AS shown FROM pages),
r1 AS (SELECT *, {rule} AS rule, coalesce({says}, CASE WHEN {seeded} THEN 'block' END) AS says,
  CASE WHEN regexp_matches(shown, '{any_case(SHOWN)}') THEN 'block' WHEN strlen(shown) >= {LEAST_TEXT} THEN 'allow' END AS seen, {wild} AS wild FROM r0),
r AS (SELECT *, coalesce(says, seen) AS label, CASE WHEN len(wild) > {max_depth} THEN list_append(wild[1:{max_depth}], '**') ELSE wild END AS shape FROM r1),
t0 AS (SELECT host, shape, count(*) AS n, count(*) FILTER (label = 'block') AS blocked, count(*) FILTER (label = 'allow') AS allowed, []::VARCHAR[] AS template FROM r GROUP BY host, shape),
prior AS (SELECT host, (sum(blocked) + {M / 2}) / (sum(blocked + allowed) + {M}) AS prior FROM t0 GROUP BY host)"""
    for d in range(max_depth):
        sql += f""",
h{d} AS (SELECT *, shape[{d + 1}] AS child FROM t{d}),
c{d} AS (SELECT host, template, child, sum(n) AS n, sum(blocked) AS b, sum(blocked + allowed) AS l FROM h{d} WHERE child IS NOT NULL GROUP BY ALL),
v{d} AS (SELECT *, count(*) OVER p > {MAX_CHILDREN} AND n < {LEAST_SHARE} * sum(n) OVER p AS variable, (b + 0.5) / (l + 1) AS rate FROM c{d} WINDOW p AS (PARTITION BY host, template)),
g{d} AS (SELECT *, lag(b) OVER o AS b2, lag(l) OVER o AS l2, lag(rate) OVER o AS rate2 FROM v{d} WHERE NOT variable AND l > 0 WINDOW o AS (PARTITION BY host, template ORDER BY rate, child)),
a{d} AS (SELECT *, CASE WHEN rate - rate2 < {Z} * sqrt((b + b2 + 0.5) / (l + l2 + 1) * (1 - (b + b2 + 0.5) / (l + l2 + 1)) * (1 / (l + 1) + 1 / (l2 + 1))) THEN 0 ELSE 1 END AS apart FROM g{d}),
e{d} AS (SELECT *, sum(apart) OVER (PARTITION BY host, template ORDER BY rate, child ROWS UNBOUNDED PRECEDING) AS branch FROM a{d}),
s{d} AS (SELECT host, template, child, CASE WHEN count(*) OVER (PARTITION BY host, template, branch) > 1 THEN '+' || branch::BIGINT ELSE child END AS step FROM e{d}
  UNION ALL SELECT host, template, child, '*' FROM v{d} WHERE variable),
t{d + 1} AS (SELECT h.host, h.shape, h.n, h.blocked, h.allowed, CASE WHEN h.child IS NULL THEN h.template ELSE list_append(h.template, coalesce(step, h.child)) END AS template
  FROM h{d} h LEFT JOIN s{d} s ON h.host = s.host AND h.template = s.template AND h.child = s.child)"""
    return sql + f""",
t AS (SELECT host, shape, blocked, allowed, CASE WHEN len(shape) > {max_depth} THEN list_append(template, '**') ELSE template END AS template FROM t{max_depth}),
v AS (SELECT t.host, shape, '/' || array_to_string(template, '/') AS template, (sum(blocked) OVER w + {M} * prior) / (sum(blocked + allowed) OVER w + {M}) AS purity
  FROM t JOIN prior p ON t.host = p.host WINDOW w AS (PARTITION BY t.host, template))
SELECT page_id, r.host, path, rule, coalesce(says, CASE WHEN purity >= {PURITY} THEN 'block' ELSE 'allow' END) AS verdict, template, purity
FROM r JOIN v ON r.host = v.host AND r.shape = v.shape
"""


ORACLE_SQL = {"op1_url_filter": _oracle()}
