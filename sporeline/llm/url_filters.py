"""URL filters by a temporal join: each capture is judged by the list entries in force when it was fetched.

A list is a table of dated changes: pattern (a host, or a domain that covers its subdomains), changed_on, and action
(block, allow, or remove). The changes of a pattern in order become validity intervals, each from its date to the day
before the next change; of changes on one day the last by name of action holds. A capture is its host and day. Equal
hosts of a day are judged once: they meet the intervals of their host and of all its parent domains by an equi-join on
the pattern and a range of dates, the longest pattern in force decides, and the verdict goes back to every capture.

A url that is null or has no host (or one of more than LONGEST characters) is allowed and has no host. A capture without a date meets no entry. Changes with a
null pattern, date or action don't count; repeated changes count once. Repeated captures each keep their row, and an
empty list allows all. Extra columns don't matter; a kept column with the name of a result column is returned with
"kept_" before its name. Domains with very many hosts, and hosts with very many captures on a day, are dealt to many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sporeline.llm._shared import salted_join, table

# Fixed value: characters of a host name at most.
LONGEST = 253


def host_of(url: Column) -> Column:
    """The lower-cased host of an absolute url, without user, port and dots at its end; null if there is none, or one too long for a name.

    An address in brackets is a host as it stands. A leading www. goes if a name with a dot is left.
    """
    found = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#@]*\]|[^/?#:@\[\]]+)", 1)
    name = F.regexp_replace(found, r"\.+$", "")
    host = F.when(name.startswith("www.") & F.substr(name, F.lit(5)).contains("."), F.substr(name, F.lit(5))).otherwise(name)
    return F.when((host != "") & (F.length(host) <= LONGEST), host)


def intervals(changes: DataFrame) -> DataFrame:
    """pattern, action, valid_from, valid_to (exclusive, null while in force) from pattern, changed_on, action."""
    known = changes.where("pattern IS NOT NULL AND changed_on IS NOT NULL AND action IN ('block', 'allow', 'remove')")
    daily = known.groupBy(F.regexp_replace(F.lower("pattern"), r"\.+$", "").alias("pattern"), "changed_on").agg(F.max("action").alias("action"))
    following = F.lead("changed_on").over(Window.partitionBy("pattern").orderBy("changed_on"))
    return daily.withColumn("valid_to", following).where("action <> 'remove'").select("pattern", "action", F.col("changed_on").alias("valid_from"), "valid_to")


def _names(host: Column) -> Column:
    """A host and its parent domains that have a dot, longest first; an address has no parents."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    every = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, n), "."))
    address = host.startswith("[") | host.rlike(r"^[0-9.]+$")
    return F.when(host.isNotNull(), F.when(address, F.array(host)).otherwise(every))


def judge(captures: DataFrame, changes: DataFrame, keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """keep's columns with host, fetched_on, pattern, action (both null if no entry is in force) and blocked.

    captures has url and fetched_on beside keep's columns. The same days' equal hosts are one row in the join, so that
    a host with many captures weighs no more than its days.
    """
    kept = F.struct(*(captures[c].alias(f"kept_{c}" if c.lower() in RESULT else c) for c in keep))
    seen = captures.select(kept.alias("kept"), host_of(captures["url"]).alias("host"), captures["fetched_on"].alias("fetched_on"))
    seen = seen.withColumn("visit", F.xxhash64("host", "fetched_on"))
    visits = seen.where("host IS NOT NULL AND fetched_on IS NOT NULL").select("visit", "host", "fetched_on").distinct()
    named = visits.select("*", F.explode(_names(F.col("host"))).alias("pattern"))
    valid = intervals(changes)
    active = salted_join(named, valid, "pattern", spread="visit").where((F.col("fetched_on") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("fetched_on") < F.col("valid_to"))))
    longest = active.groupBy("visit", "host", "fetched_on").agg(F.max_by(F.struct("pattern", "action"), F.length("pattern")).alias("e"))
    verdicts = longest.select("visit", F.struct("host", "fetched_on").alias("of"), "e")
    both = salted_join(seen, verdicts.groupBy("visit").agg(F.collect_list(F.struct("of", "e")).alias("found")), "visit", "left")  # one verdict, but for equal hashes
    e = F.filter("found", lambda x: (x["of"]["host"] == F.col("host")) & (x["of"]["fetched_on"] == F.col("fetched_on")))[0]["e"]
    out = both.select("kept", "host", "fetched_on", e.alias("e"))
    return out.select("kept.*", "host", "fetched_on", "e.pattern", "e.action", F.coalesce(F.col("e.action") == "block", F.lit(False)).alias("blocked"))


RESULT = ("host", "fetched_on", "pattern", "action", "blocked")
# The first day of captures, and the days they span.
FIRST_DAY, DAYS = "2024-01-01", 365


def _digits(text: Column, at: int) -> Column:
    """A number from 0 to 4095 out of three hex digits of a text's MD5."""
    return F.conv(F.substring(F.md5(text.cast("binary")), at, 3), 16, 10).cast("int")


def dated_captures(pages: DataFrame) -> DataFrame:
    """pages with fetched_on: the table has no dates, so a capture's day is drawn from a hash of its page_id."""
    day = F.pmod(_digits(F.concat(F.lit("fetched "), F.col("page_id").cast("string")), 1), F.lit(DAYS))
    return pages.withColumn("fetched_on", F.date_add(F.lit(FIRST_DAY).cast("date"), day))


def dated_list(pages: DataFrame) -> DataFrame:
    """A list that grows with the corpus: dated changes for hosts and domains of pages, drawn from a hash of their names.

    A third of all names are blocked from a day on; half of these are removed or allowed on a later day, and some of
    those blocked again. Domains that spam is part of are blocked from the first day on.
    """
    names = pages.select(F.explode(_names(host_of(F.col("url")))).alias("pattern")).distinct()
    d = lambda at: _digits(F.col("pattern"), at)
    first = F.pmod(d(1), F.lit(DAYS))
    second = first + 1 + F.pmod(d(4), F.lit(90))
    third = second + 1 + F.pmod(d(7), F.lit(90))
    change = lambda day, action: F.struct(day.cast("int").alias("day"), action.alias("action"))
    drawn = F.pmod(d(10), F.lit(12))
    spam = F.col("pattern").contains("spam")
    every = F.array(
        F.when(spam, change(F.lit(0), F.lit("block"))),
        F.when(drawn < 4, change(first, F.lit("block"))),
        F.when((drawn < 2) & ~spam, change(second, F.when(drawn == 0, "remove").otherwise("allow"))),
        F.when((drawn < 1) & ~spam, change(third, F.lit("block"))),
    )
    changes = names.select("pattern", F.explode(every).alias("c")).where("c IS NOT NULL")
    return changes.select("pattern", F.date_add(F.lit(FIRST_DAY).cast("date"), F.col("c.day")).alias("changed_on"), "c.action")


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(dated_captures(pages), dated_list(pages)).withColumn("fetched_on", F.col("fetched_on").cast("string"))


def _sql_digits(text: str, at: int) -> str:
    return f"(('0x' || substr(md5({text}), {at}, 3))::INTEGER)"


_SQL_NAMES = """
  SELECT DISTINCT host, array_to_string(l[i:], '.') AS pattern
  FROM (SELECT host, l, unnest(range(1, CASE WHEN host[1] = '[' OR len(list_filter(l, lambda x: NOT regexp_full_match(x, '[0-9]*'))) = 0 THEN 2 ELSE greatest(len(l) - 1, 1) + 1 END)) AS i FROM (SELECT DISTINCT host, string_split(host, '.') AS l FROM cap WHERE host IS NOT NULL))
"""
ORACLE_SQL = rf"""
WITH parts AS (
  SELECT page_id, CASE WHEN regexp_full_match(split_part(lower(url), '://', 1), '[a-z][a-z0-9+.-]*') AND contains(url, '://')
                       THEN string_split(string_split_regex(split_part(lower(url), '://', 2) || '/', '[/?#]')[1], '@') END AS a
  FROM pages
), named AS (
  SELECT page_id, rtrim(CASE WHEN x[1] <> '[' THEN split_part(x, ':', 1) WHEN contains(x, ']') THEN x[:strpos(x, ']')] ELSE '' END, '.') AS name
  FROM (SELECT page_id, CASE WHEN len(a) > 1 AND a[2] <> '' THEN a[2] ELSE a[1] END AS x FROM parts)
), hosts AS (
  SELECT page_id, CASE WHEN l[1] = 'www' AND len(l) > 2 THEN array_to_string(l[2:], '.') ELSE name END AS host FROM (SELECT *, string_split(name, '.') AS l FROM named)
), cap AS (
  SELECT page_id, CASE WHEN host <> '' AND length(host) <= {LONGEST} THEN host END AS host,
         DATE '{FIRST_DAY}' + {_sql_digits("'fetched ' || page_id", 1)} % {DAYS} AS fetched_on
  FROM hosts
), names AS ({_SQL_NAMES}), drawn AS (
  SELECT pattern, {_sql_digits("pattern", 1)} % {DAYS} AS a, {_sql_digits("pattern", 4)} % 90 AS b, {_sql_digits("pattern", 7)} % 90 AS c,
         {_sql_digits("pattern", 10)} % 12 AS d, contains(pattern, 'spam') AS spam
  FROM (SELECT DISTINCT pattern FROM names)
), changes AS (
  SELECT pattern, 0 AS day, 'block' AS action FROM drawn WHERE spam
  UNION ALL SELECT pattern, a, 'block' FROM drawn WHERE d < 4
  UNION ALL SELECT pattern, a + 1 + b, CASE WHEN d = 0 THEN 'remove' ELSE 'allow' END FROM drawn WHERE d < 2 AND NOT spam
  UNION ALL SELECT pattern, a + 2 + b + c, 'block' FROM drawn WHERE d < 1 AND NOT spam
), daily AS (
  SELECT pattern, DATE '{FIRST_DAY}' + day AS changed_on, max(action) AS action FROM changes GROUP BY pattern, day
), valid AS (
  SELECT pattern, action, changed_on AS valid_from, lead(changed_on) OVER (PARTITION BY pattern ORDER BY changed_on) AS valid_to FROM daily
), hit AS (
  SELECT c.host, c.fetched_on, arg_max(v.pattern, length(v.pattern)) AS pattern, arg_max(v.action, length(v.pattern)) AS action
  FROM (SELECT DISTINCT host, fetched_on FROM cap) c JOIN names n ON n.host = c.host JOIN valid v ON v.pattern = n.pattern
  WHERE v.action <> 'remove' AND c.fetched_on >= v.valid_from AND (v.valid_to IS NULL OR c.fetched_on < v.valid_to)
  GROUP BY c.host, c.fetched_on
)
SELECT cap.page_id, cap.host, strftime(cap.fetched_on::DATE, '%Y-%m-%d') AS fetched_on, hit.pattern, hit.action, coalesce(hit.action = 'block', false) AS blocked
FROM cap LEFT JOIN hit ON cap.host = hit.host AND cap.fetched_on = hit.fetched_on
"""

QUERIES = {"op8_url_filters": op8_url_filters}
ORACLES = {"op8_url_filters": ORACLE_SQL}
