"""JSON text, schemaless values (VARIANT) and arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import Query

_OWN = """SELECT event_id AS id, CASE event_id % 4 WHEN 0 THEN concat('{"user": {"id": ', user_id, ', "tier": "gold"}, "tags": ["', event_type, '", "b"], "items": [{"sku": "', event_type, '", "qty": ', event_id % 7, ', "price": 19.99}, {"sku": "y", "qty": 1, "price": 5.5}], "ip": "10.0.0.1"}')
 WHEN 1 THEN concat('{"user": {"id": ', user_id, ', "tier": "basic"}, "tags": ["', event_type, '"], "items": [{"sku": "x", "qty": ', event_id % 5, ', "price": 1.25}], "ip": null}')
 WHEN 2 THEN concat('{"user": {"id": ', user_id, '}, "tags": [], "items": []}') ELSE concat('{"user": {"id": ', user_id, ', "tier": "', event_type, '"}, "tags": ["', event_id % 9, '"], "items": [{"sku": "z", "qty": 2, "price": ', user_id, '.5}]}') END AS js"""
#: A document for every event, in four shapes: nested objects, lists, nulls and absent keys.
_S, _D = "{docs}", f"(SELECT id, CAST(js AS JSON) AS js FROM ({_OWN} FROM events))"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.selectExpr(*(part.strip() for part in (_OWN.removeprefix("SELECT ").split(", CASE", 1)[0], "CASE" + _OWN.split(", CASE", 1)[1]))).withColumn("v", F.parse_json("js"))


def _q(name: str, spark: str, duck: str) -> Query:
    run = (lambda session, sf_dir: session.sql(spark, docs=_documents(session, sf_dir))) if "{docs}" in spark else spark
    return Query(name, run, duck)


QUERIES = [
    _q("x01_json_parse", f"SELECT id, v IS NOT NULL AS parsed FROM {_S}", f"SELECT id, true AS parsed FROM {_D}"),
    _q("x02_json_serialize", f"SELECT id, to_json(variant_get(v, '$.tags', 'variant')) AS t FROM {_S}", f"SELECT id, CAST(js->'$.tags' AS STRING) AS t FROM {_D}"),
    _q("x03_dot_navigation", f"SELECT id, try_variant_get(v, '$.user.tier', 'string') AS tier FROM {_S}", f"SELECT id, js->>'$.user.tier' AS tier FROM {_D}"),
    _q("x04_bracket_navigation", f"""SELECT id, variant_get(v, "$['user']['id']", 'bigint') AS uid FROM {_S}""", f"SELECT id, CAST(js->>'$.user.id' AS BIGINT) AS uid FROM {_D}"),
    _q("x05_leaf_cast", f"SELECT id, try_variant_get(v, '$.items[0].price', 'double') AS price, try_variant_get(v, '$.ip', 'int') AS bad FROM {_S}", f"SELECT id, CAST(js->>'$.items[0].price' AS DOUBLE) AS price, CAST(NULL AS INT) AS bad FROM {_D}"),
    _q("x06_array_index", f"SELECT id, try_variant_get(v, '$.tags[0]', 'string') AS t0, try_variant_get(v, '$.tags[5]', 'string') AS t5 FROM {_S}", f"SELECT id, js->>'$.tags[0]' AS t0, js->>'$.tags[5]' AS t5 FROM {_D}"),
    _q("x07_typeof", f"SELECT id, CASE WHEN s LIKE 'ARRAY%' THEN 'array' WHEN s LIKE 'OBJECT%' THEN 'object' ELSE 'other' END AS kind FROM (SELECT id, schema_of_variant(variant_get(v, '$.tags', 'variant')) AS s FROM {_S})", f"SELECT id, lower(json_type(js, '$.tags')) AS kind FROM {_D}"),
    _q("x08_array_length", f"SELECT id, size(CAST(variant_get(v, '$.items', 'variant') AS ARRAY<VARIANT>)) AS n FROM {_S}", f"SELECT id, CAST(json_array_length(js, '$.items') AS INT) AS n FROM {_D}"),
    _q("x09_unnest_objects", f"SELECT id, variant_get(value, '$.sku', 'string') AS sku, variant_get(value, '$.qty', 'bigint') AS qty FROM {_S} t, LATERAL variant_explode(variant_get(t.v, '$.items', 'variant'))", f"SELECT id, x->>'$.sku' AS sku, CAST(x->>'$.qty' AS BIGINT) AS qty FROM (SELECT id, unnest(CAST(js->'$.items' AS JSON[])) AS x FROM {_D})"),
    _q("x10_unnest_scalars", f"SELECT id, CAST(value AS STRING) AS tag FROM {_S} t, LATERAL variant_explode(variant_get(t.v, '$.tags', 'variant'))", f"SELECT id, x->>'$' AS tag FROM (SELECT id, unnest(CAST(js->'$.tags' AS JSON[])) AS x FROM {_D})"),
    _q("x11_unnest_with_index", f"SELECT id, pos, CAST(value AS STRING) AS tag FROM {_S} t, LATERAL variant_explode(variant_get(t.v, '$.tags', 'variant'))", f"SELECT id, CAST(pos - 1 AS INT) AS pos, x->>'$' AS tag FROM (SELECT id, unnest(l) AS x, unnest(range(1, len(l) + 1)) AS pos FROM (SELECT id, CAST(js->'$.tags' AS JSON[]) AS l FROM {_D}))"),
    _q("x12_unpivot_object", f"SELECT id, key FROM {_S} t, LATERAL variant_explode(variant_get(t.v, '$.user', 'variant'))", f"SELECT id, unnest(json_keys(js, '$.user')) AS key FROM {_D}"),
    _q("x13_object_constructor", "SELECT n_nationkey, to_json(struct(n_nationkey AS a, n_name AS b)) AS o, to_json(to_variant_object(struct(n_regionkey AS k))) AS v FROM {nation}", "SELECT n_nationkey, '{\"a\":' || n_nationkey || ',\"b\":\"' || n_name || '\"}' AS o, '{\"k\":' || n_regionkey || '}' AS v FROM nation"),
    _q("x14_array_constructor", "SELECT n_nationkey, size(array(n_nationkey, n_regionkey, 3)) AS n, array(n_nationkey, n_regionkey, 3)[1] AS second_ FROM {nation}", "SELECT n_nationkey, CAST(len([n_nationkey, n_regionkey, 3]) AS INT) AS n, [n_nationkey, n_regionkey, 3][2] AS second_ FROM nation"),
    _q("x15_is_array_object", f"SELECT id, schema_of_variant(variant_get(v, '$.user', 'variant')) LIKE 'OBJECT%' AS is_object, schema_of_variant(variant_get(v, '$.user', 'variant')) LIKE 'ARRAY%' AS is_array FROM {_S}", f"SELECT id, json_type(js, '$.user') = 'OBJECT' AS is_object, json_type(js, '$.user') = 'ARRAY' AS is_array FROM {_D}"),
    _q("x16_extract_path_text", f"SELECT id, get_json_object(js, '$.user.tier') AS tier, get_json_object(js, '$.none') AS none_ FROM {_S}", f"SELECT id, js->>'$.user.tier' AS tier, js->>'$.none' AS none_ FROM {_D}"),
    _q("x17_array_element_text", f"SELECT id, get_json_object(js, '$.tags[1]') AS t FROM {_S}", f"SELECT id, js->>'$.tags[1]' AS t FROM {_D}"),
    _q("x18_filter_nested", f"SELECT id FROM {_S} WHERE try_variant_get(v, '$.user.tier', 'string') = 'gold'", f"SELECT id FROM {_D} WHERE js->>'$.user.tier' = 'gold'"),
    _q("x19_aggregate_unnested", f"SELECT variant_get(value, '$.sku', 'string') AS sku, sum(variant_get(value, '$.qty', 'bigint')) AS qty FROM {_S} t, LATERAL variant_explode(variant_get(t.v, '$.items', 'variant')) GROUP BY 1", f"SELECT x->>'$.sku' AS sku, CAST(sum(CAST(x->>'$.qty' AS BIGINT)) AS BIGINT) AS qty FROM (SELECT unnest(CAST(js->'$.items' AS JSON[])) AS x FROM {_D}) GROUP BY 1"),
    _q("x20_key_presence", f"SELECT id, variant_get(v, '$.ip', 'variant') IS NOT NULL AS has_key FROM {_S}", f"SELECT id, json_exists(js, '$.ip') AS has_key FROM {_D}"),
    _q("x21_shred_by_position", f"SELECT id, get_json_object(js, '$.items[0].sku') AS sku FROM {_S} WHERE get_json_object(js, '$.items[0]') IS NOT NULL UNION ALL SELECT id, get_json_object(js, '$.items[1].sku') FROM {_S} WHERE get_json_object(js, '$.items[1]') IS NOT NULL", f"SELECT id, x->>'$.sku' AS sku FROM (SELECT id, unnest(CAST(js->'$.items' AS JSON[])) AS x FROM {_D})"),
    _q("x22_array_functions", "SELECT n_nationkey, array_contains(concat(array(n_regionkey), array(n_nationkey, 3)), 3) AS has_, size(concat(array(n_regionkey), array(n_nationkey, 3))) AS n FROM {nation}", "SELECT n_nationkey, list_contains(list_concat([n_regionkey], [n_nationkey, 3]), 3) AS has_, CAST(len(list_concat([n_regionkey], [n_nationkey, 3])) AS INT) AS n FROM nation"),
    _q("x23_can_parse", f"SELECT id, try_parse_json(CASE WHEN id % 3 = 0 THEN left(js, length(js) - 1) ELSE js END) IS NOT NULL AS ok, is_valid_utf8(js) AS utf8 FROM {_S}", f"SELECT id, id % 3 <> 0 AS ok, true AS utf8 FROM {_D}"),
    _q("x24_empty_array_outer", f"SELECT id, CAST(tag AS STRING) AS tag FROM {_S} LATERAL VIEW OUTER explode(CAST(variant_get(v, '$.tags', 'variant') AS ARRAY<VARIANT>)) x AS tag", f"SELECT id, x->>'$' AS tag FROM (SELECT id, unnest(CASE WHEN json_array_length(js, '$.tags') = 0 THEN [NULL] ELSE CAST(js->'$.tags' AS JSON[]) END) AS x FROM {_D})"),
    _q("x25_events_props", "SELECT event_type, sum(try_variant_get(try_parse_json(props), '$.k', 'bigint')) AS k FROM {events} GROUP BY event_type", "SELECT event_type, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k FROM events GROUP BY event_type"),
]
