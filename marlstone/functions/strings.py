"""String and pattern functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import Query, bare, run_sql, same
from . import dialect

#: Every customer's name, address, number and page, and some that are empty, accented or missing.
_T = """(SELECT c_custkey AS id, '  ' || c_name || '  ' AS name, lower(replace(c_name, '#', '.')) || '@' || lower(c_mktsegment) || '.org' AS mail, CASE WHEN c_custkey % 3 > 0 THEN '+1 (555) ' || CAST(c_custkey AS VARCHAR(20)) || '-99' END AS phone, '/shop/' || lower(c_mktsegment) || '/' || CAST(c_custkey AS VARCHAR(20)) || '?ref=x' AS url FROM {customer}
 UNION ALL SELECT * FROM (VALUES (-1, '  Anna Bell  ', 'anna.bell@mail.org', '+1 (555) 010-9999', '/shop/items/42?ref=x'), (-2, 'ÉMILE zola', 'ez@x.fr', '5550100', '/home'), (-3, '', 'nobody', NULL, '')) AS v(id, name, mail, phone, url)) AS t"""
_D = bare(_T)

QUERIES = [
    Query("f30_trim", f"SELECT id, trim(name) AS t, btrim('xxayx', 'x') AS b, ltrim(name) AS l, rtrim(name) AS r FROM {_T}", f"SELECT id, trim(name) AS t, trim('xxayx', 'x') AS b, ltrim(name) AS l, rtrim(name) AS r FROM {_D}"),
    Query("f31_initcap", "SELECT n_nationkey, initcap(lower(n_name)) AS x FROM {nation}", "SELECT n_nationkey, array_to_string(list_transform(string_split(lower(n_name), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS x FROM nation"),
    same("f32_case", f"SELECT id, lower(name) AS l, upper(name) AS u FROM {_T}"),
    same("f33_split_part", f"SELECT id, split_part(mail, '@', 1) AS who, split_part(mail, '@', 2) AS host FROM {_T}"),
    Query("f34_regexp_substr", f"SELECT id, regexp_substr(mail, '[a-z]+') AS first_, nullif(regexp_extract(url, '/([a-z]+)/', 1), '') AS part FROM {_T}", f"SELECT id, nullif(regexp_extract(mail, '[a-z]+'), '') AS first_, nullif(regexp_extract(url, '/([a-z]+)/', 1), '') AS part FROM {_D}"),
    Query("f35_regexp_replace", f"SELECT id, regexp_replace(phone, '[^0-9]', '') AS digits, regexp_replace(mail, '^(.)(.*)@', '$1*@') AS masked FROM {_T}", f"SELECT id, regexp_replace(phone, '[^0-9]', '', 'g') AS digits, regexp_replace(mail, '^(.)(.*)@', '\\1*@') AS masked FROM {_D}"),
    Query("f36_regexp_instr", f"SELECT id, regexp_instr(mail, '[.@]') AS at_ FROM {_T}", f"SELECT id, CAST(CASE WHEN regexp_matches(mail, '[.@]') THEN length(regexp_extract(mail, '^[^.@]*')) + 1 ELSE 0 END AS INT) AS at_ FROM {_D}"),
    Query("f37_regexp_count", f"SELECT id, regexp_count(url, '[a-z]+') AS n FROM {_T}", f"SELECT id, CAST(len(regexp_extract_all(url, '[a-z]+')) AS INT) AS n FROM {_D}"),
    same("f38_substring", f"SELECT id, substring(mail, 2, 3) AS s, substring(mail, 3) AS rest FROM {_T}"),
    same("f39_position", f"SELECT id, position('@' IN mail) AS p, instr(mail, 'b') AS q FROM {_T}"),
    same("f40_pad", f"SELECT id, lpad(mail, 12, '.') AS l, rpad(mail, 12, '.') AS r, lpad('', CAST(abs(id) % 9 AS INT), '-') AS dashes FROM {_T}"),
    same("f41_replace", f"SELECT id, replace(url, '/', ':') AS x FROM {_T}"),
    same("f42_translate", f"SELECT id, translate(mail, 'aez', 'AEZ') AS x FROM {_T}"),
    same("f43_repeat", f"SELECT id, repeat('ab', CAST(abs(id) % 9 AS INT)) AS x FROM {_T}"),
    same("f44_reverse", f"SELECT id, reverse(mail) AS x FROM {_T}"),
    same("f45_length", f"SELECT id, length(name) AS n, length(mail) AS m FROM {_T}"),
    Query("f46_octet_length", f"SELECT id, octet_length(name) AS n FROM {_T}", f"SELECT id, CAST(strlen(name) AS INT) AS n FROM {_D}"),
    same("f47_concat", f"SELECT id, mail || ':' || url AS a, concat(mail, '/', url) AS b, phone || 'x' AS null_stays FROM {_T}"),
    Query("f48_soundex", lambda spark, sf_dir: spark.createDataFrame([("Robert", "Rupert"), ("Smith", "Smythe"), ("Anna", "Zoe")], "a string, b string").select("a", F.soundex("a").alias("s"), dialect.difference(F.col("a"), F.col("b")).alias("d")), "SELECT * FROM (VALUES ('Robert', 'R163', 4), ('Smith', 'S530', 4), ('Anna', 'A500', 2)) AS t(a, s, d)"),
    Query("f49_mask", lambda spark, sf_dir: run_sql(spark, sf_dir, f"SELECT id, mail FROM {_T}").select("id", F.regexp_replace(F.lower("mail"), "(^.{2})(.*)(@.*$)", "$1***$3").alias("masked")), "SELECT id, regexp_replace(lower(mail), '(^.{2})(.*)(@.*$)', '\\1***\\3') AS masked FROM " + _D),
    same("f50_left_right_chr", f"SELECT id, left(mail, 3) AS l, right(mail, 3) AS r, chr(CAST(65 + abs(id) % 26 AS INT)) AS c FROM {_T}"),
    Query("f51_quoting", lambda spark, sf_dir: spark.sql(f"SELECT {dialect.quote_literal(chr(39) + 'a')} AS {dialect.quote_ident('odd name')}"), "SELECT '''a' AS \"odd name\""),
]
