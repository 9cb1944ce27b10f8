"""The scalar functions, by topic: each query applies many of them to whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions import compat

from .common import read, sql

PAIRS: dict[str, tuple[str, str | None]] = {
    "fn_string_case": ("SELECT c_custkey, upper(c_name) AS u, ucase(c_name) AS u2, lower(c_name) AS l, lcase(c_name) AS l2, length(c_name) AS n, reverse(c_name) AS r, initcap(lower(c_mktsegment)) AS i FROM customer", "SELECT c_custkey, upper(c_name) AS u, upper(c_name) AS u2, lower(c_name) AS l, lower(c_name) AS l2, CAST(length(c_name) AS INT) AS n, reverse(c_name) AS r, upper(left(c_mktsegment, 1)) || lower(substr(c_mktsegment, 2)) AS i FROM customer"),
    "fn_string_trim_pad": ("SELECT p_partkey, trim(concat('  ', p_name, ' ')) AS t, ltrim(concat('  ', p_name)) AS l, rtrim(concat(p_name, '  ')) AS r, lpad(p_brand, 12, '*') AS lp, rpad(p_brand, 12, '-') AS rp, space(3) AS sp, repeat('ab', 2) AS rep FROM part", "SELECT p_partkey, trim('  ' || p_name || ' ') AS t, ltrim('  ' || p_name) AS l, rtrim(p_name || '  ') AS r, lpad(p_brand, 12, '*') AS lp, rpad(p_brand, 12, '-') AS rp, repeat(' ', 3) AS sp, repeat('ab', 2) AS rep FROM part"),
    "fn_string_search": ("SELECT p_partkey, instr(p_name, 'r') AS i, locate('e', p_name) AS l, locate('e', p_name, 3) AS l3, find_in_set(p_brand, 'Brand#1,Brand#2,Brand#3') AS f, ascii(p_name) AS a, p_name LIKE '%ring' AS lk FROM part", "SELECT p_partkey, CAST(instr(p_name, 'r') AS INT) AS i, CAST(instr(p_name, 'e') AS INT) AS l, CAST(CASE WHEN instr(substr(p_name, 3), 'e') = 0 THEN 0 ELSE instr(substr(p_name, 3), 'e') + 2 END AS INT) AS l3, CAST(coalesce(list_position(['Brand#1', 'Brand#2', 'Brand#3'], p_brand), 0) AS INT) AS f, CAST(ascii(p_name) AS INT) AS a, p_name LIKE '%ring' AS lk FROM part"),
    "fn_string_cut": ("SELECT p_partkey, substr(p_name, 2, 3) AS s, substring(p_name, -3) AS e, substring_index(p_brand, '#', 1) AS x, split(p_name, ' ')[0] AS w, translate(p_name, 'aeiou', '12345') AS t, concat_ws('-', p_brand, p_type) AS c, elt(2, p_brand, p_type) AS el, left(p_name, 2) AS lf, right(p_name, 2) AS rt FROM part", "SELECT p_partkey, substr(p_name, 2, 3) AS s, right(p_name, 3) AS e, string_split(p_brand, '#')[1] AS x, string_split(p_name, ' ')[1] AS w, translate(p_name, 'aeiou', '12345') AS t, concat_ws('-', p_brand, p_type) AS c, p_type AS el, left(p_name, 2) AS lf, right(p_name, 2) AS rt FROM part"),
    "fn_regexp": ("SELECT p_partkey, regexp_extract(p_brand, '([A-Za-z]+)#([0-9]+)', 2) AS d, regexp_replace(p_name, '[aeiou]', '_') AS v, p_name RLIKE 'g$' AS g, p_name REGEXP '^s' AS s FROM part", "SELECT p_partkey, regexp_extract(p_brand, '([A-Za-z]+)#([0-9]+)', 2) AS d, regexp_replace(p_name, '[aeiou]', '_', 'g') AS v, regexp_matches(p_name, 'g$') AS g, regexp_matches(p_name, '^s') AS s FROM part"),
    "fn_encoding": ("SELECT n_nationkey, hex(n_name) AS h, unhex(hex(n_name)) = encode(n_name, 'UTF-8') AS u, base64(encode(n_name, 'UTF-8')) AS b, decode(unbase64(base64(encode(n_name, 'UTF-8'))), 'UTF-8') AS d, md5(n_name) AS m, sha1(n_name) AS s1, sha2(n_name, 256) AS s2, bin(n_nationkey) AS bi, conv(n_nationkey, 10, 16) AS c FROM nation", "SELECT n_nationkey, hex(encode(n_name)) AS h, true AS u, base64(encode(n_name)) AS b, n_name AS d, md5(n_name) AS m, sha1(n_name) AS s1, sha256(n_name) AS s2, bin(n_nationkey) AS bi, hex(n_nationkey) AS c FROM nation"),
    "fn_format": ("SELECT o_orderkey, format_string('%05d-%s', o_custkey, o_orderstatus) AS p, format_number(o_totalprice, 2) AS f, printf('%d%%', o_custkey) AS q FROM orders", "SELECT o_orderkey, printf('%05d-%s', o_custkey, o_orderstatus) AS p, format('{:,.2f}', o_totalprice) AS f, CAST(o_custkey AS VARCHAR) || '%' AS q FROM orders"),
    "fn_url": ("SELECT page_id, parse_url(url, 'HOST') AS h, parse_url(url, 'PROTOCOL') AS p, parse_url(url, 'QUERY', 'page') AS q, parse_url(url, 'REF') AS r FROM pages", "SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) AS h, regexp_extract(url, '^([a-z]+)://', 1) AS p, nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') AS q, nullif(regexp_extract(url, '#(.*)$', 1), '') AS r FROM pages"),
    "fn_math_round": ("SELECT event_id, round(value, 1) AS r, ceil(value) AS c, ceiling(value) AS c2, floor(value) AS f, abs(-value) AS a, sign(value - 50) AS s, positive(value) AS p, negative(value) AS n, pmod(CAST(value AS INT) - 50, 7) AS pm, CAST(value AS INT) % 7 AS m FROM events", "SELECT event_id, round(value, 1) AS r, CAST(ceil(value) AS BIGINT) AS c, CAST(ceil(value) AS BIGINT) AS c2, CAST(floor(value) AS BIGINT) AS f, abs(-value) AS a, CAST(sign(value - 50) AS DOUBLE) AS s, value AS p, -value AS n, ((CAST(trunc(value) AS INT) - 50) % 7 + 7) % 7 AS pm, CAST(trunc(value) AS INT) % 7 AS m FROM events"),
    "fn_math_power": ("SELECT event_id, round(sqrt(value), 6) AS sq, round(pow(value, 2), 4) AS p, round(power(value, 0.5), 6) AS p5, round(exp(value / 100), 6) AS e, round(ln(value + 1), 6) AS l, round(log10(value + 1), 6) AS l10, round(log2(value + 1), 6) AS l2, round(log(2, value + 1), 6) AS lb, round(cbrt(value), 6) AS cb FROM events", "SELECT event_id, round(sqrt(value), 6) AS sq, round(pow(value, 2), 4) AS p, round(power(value, 0.5), 6) AS p5, round(exp(value / 100), 6) AS e, round(ln(value + 1), 6) AS l, round(log10(value + 1), 6) AS l10, round(log2(value + 1), 6) AS l2, round(log2(value + 1), 6) AS lb, round(cbrt(value), 6) AS cb FROM events"),
    "fn_math_trig": ("SELECT event_id, round(sin(value), 6) AS s, round(cos(value), 6) AS c, round(tan(value / 100), 6) AS t, round(asin(value / 1e6), 6) AS a, round(acos(value / 1e6), 6) AS ac, round(atan(value), 6) AS at, round(degrees(value), 4) AS d, round(radians(value), 6) AS r, round(e(), 6) AS e, round(pi(), 6) AS pi, round(1 / tan(value / 100 + 1), 4) AS ct FROM events", "SELECT event_id, round(sin(value), 6) AS s, round(cos(value), 6) AS c, round(tan(value / 100), 6) AS t, round(asin(value / 1e6), 6) AS a, round(acos(value / 1e6), 6) AS ac, round(atan(value), 6) AS at, round(degrees(value), 4) AS d, round(radians(value), 6) AS r, round(exp(1.0), 6) AS e, round(pi(), 6) AS pi, round(1 / tan(value / 100 + 1), 4) AS ct FROM events"),
    "fn_arithmetic": ("SELECT o_orderkey, o_custkey + 1 AS a, o_custkey - 1 AS s, o_custkey * 2 AS m, round(o_custkey / 4, 4) AS d, o_custkey div 4 AS dv, o_custkey / 0 AS z, o_custkey & 6 AS ba, o_custkey | 6 AS bo, o_custkey ^ 6 AS bx, ~o_custkey AS bn, shiftleft(o_custkey, 2) AS sl, shiftright(o_custkey, 1) AS sr FROM orders", "SELECT o_orderkey, o_custkey + 1 AS a, o_custkey - 1 AS s, o_custkey * 2 AS m, round(o_custkey / 4, 4) AS d, o_custkey // 4 AS dv, CAST(NULL AS DOUBLE) AS z, o_custkey & 6 AS ba, o_custkey | 6 AS bo, xor(o_custkey, CAST(6 AS BIGINT)) AS bx, ~o_custkey AS bn, o_custkey * 4 AS sl, o_custkey // 2 AS sr FROM orders"),
    "fn_compare": ("SELECT o_orderkey, greatest(o_custkey, 500) AS g, least(o_custkey, 500) AS l, coalesce(nullif(o_orderstatus, 'F'), 'none') AS c, nvl(nullif(o_orderstatus, 'O'), 'x') AS n, nvl2(nullif(o_orderstatus, 'O'), 1, 0) AS n2, ifnull(nullif(o_orderstatus, 'P'), 'y') AS i, o_custkey BETWEEN 10 AND 20 AS b, isnull(nullif(o_orderstatus, 'F')) AS isn, isnotnull(nullif(o_orderstatus, 'F')) AS isnn FROM orders", "SELECT o_orderkey, greatest(o_custkey, 500) AS g, least(o_custkey, 500) AS l, coalesce(nullif(o_orderstatus, 'F'), 'none') AS c, coalesce(nullif(o_orderstatus, 'O'), 'x') AS n, CASE WHEN nullif(o_orderstatus, 'O') IS NOT NULL THEN 1 ELSE 0 END AS n2, coalesce(nullif(o_orderstatus, 'P'), 'y') AS i, o_custkey BETWEEN 10 AND 20 AS b, nullif(o_orderstatus, 'F') IS NULL AS isn, nullif(o_orderstatus, 'F') IS NOT NULL AS isnn FROM orders"),
    "fn_date_parts": ("SELECT o_orderkey, year(o_orderdate) AS y, quarter(o_orderdate) AS q, month(o_orderdate) AS m, day(o_orderdate) AS d, dayofmonth(o_orderdate) AS dm, weekofyear(o_orderdate) AS w, dayofyear(o_orderdate) AS dy, hour(o_orderdate) AS h, minute(o_orderdate) AS mi, second(o_orderdate) AS s FROM orders", "SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS y, CAST(quarter(o_orderdate) AS INT) AS q, CAST(month(o_orderdate) AS INT) AS m, CAST(day(o_orderdate) AS INT) AS d, CAST(day(o_orderdate) AS INT) AS dm, CAST(weekofyear(o_orderdate) AS INT) AS w, CAST(dayofyear(o_orderdate) AS INT) AS dy, CAST(hour(o_orderdate) AS INT) AS h, CAST(minute(o_orderdate) AS INT) AS mi, CAST(second(o_orderdate) AS INT) AS s FROM orders"),
    "fn_date_arith": ("SELECT o_orderkey, CAST(date_add(o_orderdate, 10) AS STRING) AS a, CAST(date_sub(o_orderdate, 10) AS STRING) AS s, datediff(o_orderdate, DATE '1992-01-01') AS d, CAST(add_months(o_orderdate, 2) AS STRING) AS am, CAST(last_day(o_orderdate) AS STRING) AS ld, CAST(trunc(o_orderdate, 'MM') AS STRING) AS tm, date_format(o_orderdate, 'yyyy/MM/dd') AS f, CAST(to_date(o_orderdate) AS STRING) AS td FROM orders", "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) + 10 AS VARCHAR) AS a, CAST(CAST(o_orderdate AS DATE) - 10 AS VARCHAR) AS s, CAST(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS INT) AS d, CAST(CAST(CAST(o_orderdate AS DATE) + INTERVAL 2 MONTH AS DATE) AS VARCHAR) AS am, CAST(last_day(o_orderdate) AS VARCHAR) AS ld, CAST(CAST(date_trunc('month', o_orderdate) AS DATE) AS VARCHAR) AS tm, strftime(o_orderdate, '%Y/%m/%d') AS f, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS td FROM orders"),
    "fn_unix_time": ("SELECT event_id, unix_timestamp(ts) AS u, from_unixtime(unix_timestamp(ts)) AS f, to_unix_timestamp(ts) AS t, CAST(date_trunc('HOUR', ts) AS STRING) AS h, date_format(from_utc_timestamp(ts, 'Asia/Tokyo'), 'yyyy-MM-dd HH:mm:ss') AS z, date_format(to_utc_timestamp(ts, 'Asia/Tokyo'), 'yyyy-MM-dd HH:mm:ss') AS y FROM events", "SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS u, strftime(ts, '%Y-%m-%d %H:%M:%S') AS f, CAST(floor(epoch(ts)) AS BIGINT) AS t, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS h, strftime(ts + INTERVAL 9 HOUR, '%Y-%m-%d %H:%M:%S') AS z, strftime(ts - INTERVAL 9 HOUR, '%Y-%m-%d %H:%M:%S') AS y FROM events"),
    "fn_interval": ("SELECT o_orderkey, CAST(o_orderdate + INTERVAL 1 YEAR + INTERVAL 2 MONTHS AS STRING) AS ym, CAST(o_orderdate + INTERVAL 3 DAYS + INTERVAL 4 HOURS AS STRING) AS dt, CAST(o_orderdate - INTERVAL 90 MINUTES AS STRING) AS mi FROM orders", "SELECT o_orderkey, strftime(o_orderdate + INTERVAL 1 YEAR + INTERVAL 2 MONTH, '%Y-%m-%d %H:%M:%S') AS ym, strftime(o_orderdate + INTERVAL 3 DAY + INTERVAL 4 HOUR, '%Y-%m-%d %H:%M:%S') AS dt, strftime(o_orderdate - INTERVAL 90 MINUTE, '%Y-%m-%d %H:%M:%S') AS mi FROM orders"),
    "fn_array": ("SELECT n_nationkey, size(array(n_nationkey, n_regionkey)) AS s, array_contains(array(1, 2, 3), n_regionkey) AS c, concat_ws(',', sort_array(array(n_name, 'B', 'A'))) AS so, concat_ws(',', sort_array(array('x', n_name), false)) AS sd, array(n_nationkey, 7)[1] AS e, element_at(array(n_name, 'z'), -1) AS l, array_max(array(n_nationkey, 10)) AS mx FROM nation", "SELECT n_nationkey, 2 AS s, list_contains([1, 2, 3], n_regionkey) AS c, array_to_string(list_sort([n_name, 'B', 'A']), ',') AS so, array_to_string(list_reverse_sort(['x', n_name]), ',') AS sd, 7 AS e, 'z' AS l, greatest(n_nationkey, 10) AS mx FROM nation"),
    "fn_array_higher_order": ("SELECT doc_id, aggregate(transform(split(source, ''), c -> length(c)), 0, (a, x) -> a + x) AS n, size(filter(split(source, ''), c -> c = 's')) AS s, exists(split(source, ''), c -> c = '1') AS one FROM documents", "SELECT doc_id, CAST(length(source) AS INT) AS n, CAST(length(source) - length(replace(source, 's', '')) AS INT) AS s, contains(source, '1') AS one FROM documents"),
    "fn_map_struct": ("SELECT n_nationkey, map('a', n_name, 'b', 'x')['a'] AS m, size(map_keys(map('a', 1, 'b', 2))) AS k, concat_ws(',', map_values(map('a', n_name))) AS v, struct(n_nationkey AS p, n_name AS q).q AS s, named_struct('z', n_regionkey).z AS z, str_to_map('a:1,b:2', ',', ':')['b'] AS st FROM nation", "SELECT n_nationkey, n_name AS m, 2 AS k, n_name AS v, n_name AS s, n_regionkey AS z, '2' AS st FROM nation"),
    "fn_json": ("SELECT event_id, get_json_object(props, '$.k') AS k, from_json(props, 'k INT').k AS n, to_json(struct(event_id AS id)) AS j FROM events", "SELECT event_id, json_extract_string(props, '$.k') AS k, CAST(json_extract_string(props, '$.k') AS INT) AS n, '{\"id\":' || event_id || '}' AS j FROM events"),
    "fn_xpath": ("SELECT n_nationkey, xpath_string(concat('<a><b>', n_name, '</b><c>', n_regionkey, '</c></a>'), 'a/b') AS s, xpath_int(concat('<a><c>', n_regionkey, '</c></a>'), 'a/c') AS i, xpath_long(concat('<a><c>', n_regionkey, '</c></a>'), 'a/c') AS l, xpath_short(concat('<a><c>', n_regionkey, '</c></a>'), 'a/c') AS sh, xpath_double(concat('<a><c>', n_regionkey, '</c></a>'), 'a/c') AS d, xpath_float(concat('<a><c>', n_regionkey, '</c></a>'), 'a/c') AS f, xpath_boolean(concat('<a><c>', n_regionkey, '</c></a>'), 'a/c > 2') AS b, size(xpath('<a><b>1</b><b>2</b></a>', 'a/b/text()')) AS x FROM nation", "SELECT n_nationkey, n_name AS s, n_regionkey AS i, CAST(n_regionkey AS BIGINT) AS l, CAST(n_regionkey AS SMALLINT) AS sh, CAST(n_regionkey AS DOUBLE) AS d, CAST(n_regionkey AS FLOAT) AS f, n_regionkey > 2 AS b, 2 AS x FROM nation"),
    "fn_casts": ("SELECT n_nationkey, boolean(n_regionkey) AS b, tinyint(n_nationkey) AS t, smallint(n_nationkey) AS s, int('12') AS i, bigint(n_nationkey) AS l, float(n_nationkey) AS f, double('1.5') AS d, string(n_nationkey) AS st, CAST('x' AS INT) AS bad, CAST(300 AS TINYINT) AS wrapped FROM nation", "SELECT n_nationkey, n_regionkey <> 0 AS b, CAST(n_nationkey AS TINYINT) AS t, CAST(n_nationkey AS SMALLINT) AS s, 12 AS i, CAST(n_nationkey AS BIGINT) AS l, CAST(n_nationkey AS FLOAT) AS f, CAST(1.5 AS DOUBLE) AS d, CAST(n_nationkey AS VARCHAR) AS st, CAST(NULL AS INT) AS bad, CAST(44 AS TINYINT) AS wrapped FROM nation"),
    "fn_java_method": ("SELECT n_nationkey, java_method('java.lang.Math', 'max', n_nationkey, 10) AS m, reflect('java.lang.Integer', 'toHexString', n_nationkey) AS h FROM nation", "SELECT n_nationkey, CAST(greatest(n_nationkey, 10) AS VARCHAR) AS m, lower(hex(n_nationkey)) AS h FROM nation"),
    "fn_sentences": ("SELECT n_nationkey, size(sentences('Hello there. How are you?')) AS n, sentences('Hello there. How are you?')[1][0] AS w FROM nation", "SELECT n_nationkey, 2 AS n, 'How' AS w FROM nation"),
    "fn_hash_stable": ("SELECT o_orderpriority, count(DISTINCT xxhash64(o_orderkey, o_custkey)) AS wide, count(DISTINCT hash(o_orderkey) , o_orderkey) AS n, md5(o_orderpriority) AS m, sha2(o_orderpriority, 256) AS s, sha1(o_orderpriority) AS h FROM orders GROUP BY o_orderpriority", "SELECT o_orderpriority, count(DISTINCT (o_orderkey, o_custkey)) AS wide, count(DISTINCT o_orderkey) AS n, md5(o_orderpriority) AS m, sha256(o_orderpriority) AS s, sha1(o_orderpriority) AS h FROM orders GROUP BY o_orderpriority"),
    "fn_random_bounds": ("SELECT count(*) AS n, count(DISTINCT r) AS different, round(avg(r), 1) AS mean, round(stddev_pop(r), 1) AS deviation, abs(round(avg(g), 1)) AS zero, count_if(r < 0 OR r >= 1) AS out FROM (SELECT rand(3) AS r, randn(3) AS g FROM lineitem)", "SELECT count(*) AS n, count(*) AS different, 0.5::DOUBLE AS mean, 0.3::DOUBLE AS deviation, 0.0::DOUBLE AS zero, 0::BIGINT AS out FROM lineitem"),
    "fn_partition_info": ("SELECT c_nationkey, count(*) AS n, count(DISTINCT i) AS ids, count_if(f LIKE '%customer.parquet%') AS f, count_if(p >= 0 AND shiftright(i, 33) = p) AS p FROM (SELECT c_nationkey, spark_partition_id() AS p, input_file_name() AS f, monotonically_increasing_id() AS i FROM customer) GROUP BY c_nationkey", "SELECT c_nationkey, count(*) AS n, count(*) AS ids, count(*) AS f, count(*) AS p FROM customer GROUP BY c_nationkey"),
}


def _field(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    return o.select("o_orderkey", compat.field(F.col("o_orderstatus"), "F", "O").alias("place"))


def _ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = compat.word_ngrams(read(spark, sf_dir, "part"), "p_name", 2, 5)
    return found.select(F.concat_ws(" ", "ngram").alias("ngram"), "estfrequency")


def _context(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = compat.context_ngrams(read(spark, sf_dir, "part"), "p_name", ["red", None], 3)
    return found.select(F.concat_ws(" ", "ngram").alias("ngram"), "estfrequency")


def _bitmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "nation").groupBy("n_regionkey").agg(compat.bitmap_of(F.collect_list("n_nationkey")).alias("b"))
    low = F.array(*(F.lit(i) for i in range(10)))
    both, either = compat.bitmap_and(F.col("b"), low), compat.bitmap_or(F.col("b"), low)
    return n.select("n_regionkey", F.size(both).alias("both"), F.size(either).alias("either"), compat.bitmap_empty(both).alias("none"))


def _in_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer")
    lines = c.where("c_acctbal > 0").select(F.col("c_name").alias("value"))
    return compat.in_lines(F.col("c_name"), lines, c).select("c_custkey", "in_file")


def _url_tuple(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "pages")
    host, path = compat.parse_url_tuple(F.col("url"), "HOST", "PATH")
    return p.select("page_id", host.alias("host"), path.alias("path"))


def _tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "nation")
    u = compat.tagged_union(F.col("n_regionkey") % 2, F.col("n_name"), F.col("n_nationkey"))
    return n.select("n_nationkey", u["tag"].alias("tag"), u["option0"].alias("name"), u["option1"].alias("number"))


FRAMES = {
    "fn_field": (_field, "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 0 END AS place FROM orders"),
    "fn_ngrams": (_ngrams, "SELECT p_name AS ngram, CAST(count(*) AS DOUBLE) AS estfrequency FROM part GROUP BY p_name ORDER BY 2 DESC, 1 LIMIT 5"),
    "fn_context_ngrams": (_context, "SELECT substr(p_name, 5) AS ngram, CAST(count(*) AS DOUBLE) AS estfrequency FROM part WHERE p_name LIKE 'red %' GROUP BY p_name ORDER BY 2 DESC, 1 LIMIT 3"),
    "fn_bitmaps": (_bitmaps, "SELECT n_regionkey, CAST(count(*) FILTER (WHERE n_nationkey < 10) AS INT) AS \"both\", CAST(10 + count(*) FILTER (WHERE n_nationkey >= 10) AS INT) AS either, count(*) FILTER (WHERE n_nationkey < 10) = 0 AS none FROM nation GROUP BY n_regionkey"),
    "fn_in_file": (_in_file, "SELECT c_custkey, c_acctbal > 0 AS in_file FROM customer"),
    "fn_parse_url_tuple": (_url_tuple, "SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS path FROM pages"),
    "fn_create_union": (_tagged, "SELECT n_nationkey, n_regionkey % 2 AS tag, CASE WHEN n_regionkey % 2 = 0 THEN n_name END AS name, CASE WHEN n_regionkey % 2 = 1 THEN n_nationkey END AS number FROM nation"),
}

QUERIES = {name: sql(text) for name, (text, _) in PAIRS.items()} | {name: f for name, (f, _) in FRAMES.items()}
ORACLE_SQL = {name: other or text for name, (text, other) in PAIRS.items()} | {name: text for name, (_, text) in FRAMES.items()}
