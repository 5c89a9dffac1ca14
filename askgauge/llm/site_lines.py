"""Line deduplication by site-relative frequency (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import read_table, stored

#: A line is boilerplate when more than this share of its host's pages hold it, on hosts of so many pages at least:
#: on a host of one page every line is on all pages.
RATIO, MIN_PAGES = 0.5, 2
#: Rows of a frequent line are dealt to so many tasks.
SALTS = 16


def host_of(url: Column) -> Column:
    """Host of a URL in lower case, without user and port; empty for anything else.

    The scheme may be missing ('//a.org/x'), the slashes too when the first part is a name with a dot ('a.org/x').
    """
    full = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1)
    bare = F.regexp_extract(url, r"^([^/?#:@.\s]+(?:\.[^/?#:@.\s]+)+)\.?(?::[0-9]*)?(?:[/?#]|$)", 1)
    return F.lower(F.coalesce(F.when(full != "", full).otherwise(bare), F.lit("")))


def html_lines(html: Column) -> Column:
    """Visible lines of a page: scripts, styles and comments go, every tag and line break ends a line, blanks are trimmed."""
    text = F.coalesce(html.cast("string"), F.lit(""))
    for pattern in (r"(?is)<script\b.*?</script>", r"(?is)<style\b.*?</style>", r"(?s)<!--.*?-->", r"<[^>]*>"):
        text = F.regexp_replace(text, pattern, "\n")
    return F.filter(F.transform(F.split(text, r"[\r\n]+"), lambda x: F.trim(x)), lambda x: x != "")


def drop_site_lines(pages: DataFrame, lines: Column, host: Column, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """Add ``host``, ``lines`` and ``kept`` (the lines that are no boilerplate of their host) to the rows of pages.

    A line counts once per page. It is dropped from every page of a host when the pages that hold it, divided by
    the host's pages, exceed ``ratio``; hosts of fewer than ``min_pages`` pages keep everything. Pages are cut into
    lines once for counting, as a stored table of 64-bit hashes, and once for the result. Counts are summed in the map tasks,
    per host and line; the rows of a frequent line meet its verdict in SALTS parts. Null pages have no lines, a null URL is the
    empty host, repeated rows count as pages of their own. Other columns stay; existing ones of these names are replaced.
    """
    packed = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("row"), lines.alias("lines"), host.alias("host"))
    rows = packed.withColumn("page", F.xxhash64("row"))
    hashed = stored(rows.select("page", "host", F.array_distinct(F.transform("lines", lambda x: F.xxhash64(x))).alias("hashes")), "page-lines")
    held = hashed.select("page", "host", F.explode("hashes").alias("h"))
    totals = hashed.groupBy("host").agg(F.count("*").alias("pages"))
    often = held.groupBy("host", "h").agg(F.count("*").alias("n")).where("n > 1").join(totals, "host")
    often = often.where((F.col("pages") >= min_pages) & (F.col("n") > F.lit(ratio) * F.col("pages"))).select("host", "h")
    salted = often.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    gone = held.withColumn("salt", F.pmod("page", F.lit(SALTS)).cast("int")).join(salted, ["host", "h", "salt"]).groupBy("page").agg(F.collect_set("h").alias("gone"))
    out = rows.join(gone, "page", "left")
    kept = F.when(F.col("gone").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda x: ~F.array_contains(F.col("gone"), F.xxhash64(x))))
    names = [c for c in pages.columns if c not in ("host", "lines", "kept")]
    return out.select(*[F.col("row").getField(c).alias(c) for c in names], "host", "lines", kept.alias("kept"))


def op3_site_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = drop_site_lines(read_table(spark, sf_dir, "pages"), html_lines(F.col("html")), host_of(F.col("url")))
    text = F.array_join("kept", "\n")
    return found.select(
        "page_id", "host", F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size("kept")).cast("long").alias("n_dropped"),
        F.length(text).cast("long").alias("kept_chars"), F.sha2(text, 256).alias("kept_sha256"),
    )


OP3_SQL = r"""
WITH p AS (
    SELECT row_number() OVER () AS r, page_id, lower(coalesce(nullif(regexp_extract(coalesce(url, ''), '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)', 1), ''),
            regexp_extract(coalesce(url, ''), '^([^/?#:@.\s]+(?:\.[^/?#:@.\s]+)+)\.?(?::[0-9]*)?(?:[/?#]|$)', 1))) AS host,
        list_filter(list_transform(regexp_split_to_array(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''),
            '(?is)<script\b.*?</script>', chr(10), 'g'), '(?is)<style\b.*?</style>', chr(10), 'g'), '(?s)<!--.*?-->', chr(10), 'g'), '<[^>]*>', chr(10), 'g'), '[\r\n]+'),
            lambda x: trim(x, ' ')), lambda x: x <> '') AS lines FROM pages
), l AS (SELECT r, host, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM p),
totals AS (SELECT host, count(*) AS pages FROM p GROUP BY host),
often AS (
    SELECT host, line FROM (SELECT host, line, count(DISTINCT r) AS n FROM l GROUP BY host, line) JOIN totals USING (host)
    WHERE n > 1 AND pages >= 2 AND n > 0.5 * pages
), kept AS (
    SELECT r, count(*) AS n, string_agg(line, chr(10) ORDER BY pos) AS text FROM l ANTI JOIN often USING (host, line) GROUP BY r
)
SELECT page_id, host, len(lines)::BIGINT AS n_lines, (len(lines) - coalesce(n, 0))::BIGINT AS n_dropped,
    length(coalesce(text, ''))::BIGINT AS kept_chars, sha256(coalesce(text, '')) AS kept_sha256
FROM p LEFT JOIN kept USING (r)
"""
