"""Join, filter, set, projection and text queries."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from stratawell.functions import text as tx
from stratawell.functions.safe_math import safe_log2
from stratawell.operators import modelling as md, relational as rel
from stratawell.plans.registry import query, r


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN CASE WHEN c_nationkey < 5 THEN NULL ELSE c_name END ELSE c_mktsegment END AS label FROM customer")
def fallback_fill(t):
    a = F.when(F.col("c_custkey") % 4 == 0, F.lit("")).otherwise(F.col("c_mktsegment"))
    b = F.when(F.col("c_nationkey") >= 5, F.col("c_name"))
    return t("customer").select("c_custkey", rel.filled(a, b).alias("label"))


@query("SELECT c_custkey, CASE WHEN o.k IS NOT NULL THEN o.p ELSE c_mktsegment END AS c_mktsegment, o.d AS last_status FROM customer LEFT JOIN (SELECT o_custkey AS k, CASE WHEN arg_max(o_orderkey, o_orderkey) % 3 = 0 THEN NULL ELSE arg_max(o_orderpriority, o_orderkey) END AS p, arg_max(o_orderstatus, o_orderkey) AS d FROM orders GROUP BY o_custkey) o ON o.k = c_custkey")
def update_join_overwrite(t):
    o = t("orders").select("o_custkey", "o_orderkey", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority")).alias("c_mktsegment"), F.col("o_orderstatus").alias("last_status"))
    c = t("customer").select("c_custkey", "c_mktsegment")
    return rel.update_join(c, o, {"c_custkey": "o_custkey"}, ["c_mktsegment", "last_status"], order=F.col("o_orderkey"))


@query("SELECT n_name, s_suppkey FROM (SELECT * FROM supplier WHERE s_acctbal > 5000) s RIGHT JOIN nation ON s_nationkey = n_nationkey")
def right_lookup(t):
    s = t("supplier").filter("s_acctbal > 5000")
    return s.join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey"), "right").select("n_name", "s_suppkey")


@query("SELECT r_name, n_name FROM region, nation WHERE r_regionkey IN (1, 2) AND n_nationkey IN (1, 2, 3, 8, 9, 12, 18, 21, 24) AND n_regionkey = r_regionkey")
def inner_grid(t):
    a, b = t("region").filter("r_regionkey IN (1, 2)"), t("nation").filter("n_nationkey IN (1, 2, 3, 8, 9, 12, 18, 21, 24)")
    return a.join(b, F.col("n_regionkey") == F.col("r_regionkey")).select("r_name", "n_name")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def semi_members(t):
    return rel.is_in(t("customer").select("c_custkey", "c_name"), "c_custkey", t("orders").filter("o_totalprice > 400000").select("o_custkey"))


@query("SELECT c_custkey, k FROM (SELECT c_custkey, CASE WHEN c_custkey % 50 = 0 THEN NULL ELSE c_custkey END AS k FROM customer) WHERE k IS NULL OR k NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def anti_members(t):
    c = t("customer").select("c_custkey", F.when(F.col("c_custkey") % 50 != 0, F.col("c_custkey")).alias("k"))
    return rel.not_in(c, "k", t("orders").select("o_custkey"))


@query("""WITH u AS (
  SELECT p_size, p_brand, p_partkey, row_number() OVER (PARTITION BY p_size ORDER BY p_brand, p_partkey) - 1 AS spot, count(*) OVER (PARTITION BY p_size) - count(*) OVER (PARTITION BY p_size, p_brand) AS m, count(*) OVER (PARTITION BY p_size, p_brand) AS c FROM part
), s AS (SELECT *, min(spot) OVER (PARTITION BY p_size, p_brand) AS s FROM u
), w AS (
  SELECT s.*, j.j, (spot % m + j.j * greatest(1, m // 10)) % m AS o FROM s, range(10) j(j) WHERE m > 0 AND j.j < least(10, m)
) SELECT w.p_partkey, d.p_partkey AS donor, w.j + 1 AS rotation FROM w JOIN u d ON d.p_size = w.p_size AND d.spot = CASE WHEN w.o < w.s THEN w.o ELSE w.o + w.c END""")
def candidate_rotations(t):
    return md.rotations(t("part"), ["p_size"], "p_brand", "p_partkey", 10, None)


@query("SELECT c_custkey, regexp_extract(c_name, '[0-9]+') AS number, split_part(c_name, '#', 1) AS word FROM customer")
def id_parse(t):
    return t("customer").select("c_custkey", F.regexp_extract("c_name", "([0-9]+)", 1).alias("number"), tx.piece(F.col("c_name"), "#", 1).alias("word"))


@query(r"SELECT page_id, regexp_replace('page_' || page_id || '.' || page_id % 7, '\.[0-9]+$', '') AS name, split_part(split_part(url, '?', 1), '#', 1) AS bare, regexp_extract(url, '://([^/]+)/', 1) AS host FROM pages")
def version_strip(t):
    name = F.concat(F.lit("page_"), "page_id", F.lit("."), F.col("page_id") % 7)
    bare = tx.piece(tx.piece(F.col("url"), r"\?", 1), "#", 1)
    return t("pages").select("page_id", tx.strip_version(name).alias("name"), bare.alias("bare"), F.regexp_extract("url", "://([^/]+)/", 1).alias("host"))


@query("SELECT o_orderkey AS key, 'orders' AS src FROM orders UNION ALL SELECT c_custkey, 'customer' FROM customer")
def bag_union_with_source(t):
    return rel.stacked({"orders": t("orders").select(F.col("o_orderkey").alias("key")), "customer": t("customer").select(F.col("c_custkey").alias("key"))}, "src")


@query("SELECT o_custkey AS key FROM orders UNION SELECT c_custkey FROM customer")
def union_distinct(t):
    return t("orders").select(F.col("o_custkey").alias("key")).union(t("customer").select("c_custkey")).distinct()


@query("SELECT o_custkey AS key FROM orders WHERE o_orderstatus = 'O' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def set_intersect(t):
    o = t("orders")
    return o.filter("o_orderstatus = 'O'").select(F.col("o_custkey").alias("key")).intersect(o.filter("o_orderstatus = 'F'").select("o_custkey"))


@query("SELECT c_custkey AS key FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'")
def set_difference(t):
    return t("customer").select(F.col("c_custkey").alias("key")).subtract(t("orders").filter("o_orderstatus = 'O'").select("o_custkey"))


@query("SELECT o_orderkey AS key, o_totalprice AS price, NULL AS segment, 'orders' AS src FROM orders UNION ALL SELECT c_custkey, NULL, c_mktsegment, 'customer' FROM customer")
def union_missing_columns(t):
    o = t("orders").select(F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("price"))
    return rel.stacked({"orders": o, "customer": t("customer").select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("segment"))}, "src")


@query("SELECT r_name, string_agg(DISTINCT n_name, ',' ORDER BY n_name) AS nations FROM nation JOIN region ON r_regionkey = n_regionkey GROUP BY r_name")
def group_string_concat(t):
    return t("nation").join(t("region"), F.col("r_regionkey") == F.col("n_regionkey")).groupBy("r_name").agg(F.array_join(F.array_sort(F.collect_set("n_name")), ",").alias("nations"))


@query("SELECT d.doc_id, lang, n_chars FROM documents d WHERE (lang = 'en' AND n_chars > 500) OR (lang IN ('de', 'fr') AND NOT contains(text, 'the')) OR starts_with(text, 'The') OR (ends_with(text, '.') AND lang IS NOT NULL AND n_chars < 100)")
def predicate_suite(t):
    d = t("documents")
    a = (F.col("lang") == "en") & (F.col("n_chars") > 500)
    b = F.col("lang").isin("de", "fr") & ~F.col("text").contains("the")
    c = F.col("text").startswith("The") | (F.col("text").endswith(".") & F.col("lang").isNotNull() & (F.col("n_chars") < 100))
    return d.filter(a | b | c).select("doc_id", "lang", "n_chars")


@query("SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'P' THEN 'pending' WHEN o_orderstatus = 'F' THEN 'done' ELSE 'open' END AS status, 'x' AS batch, TRY_CAST(split_part(o_orderpriority, '-', 1) AS INTEGER) AS priority, concat_ws('/', 'files', o_custkey::VARCHAR, o_orderkey || '.csv') AS path, upper(substr(lower(split_part(o_orderpriority, '-', 2)), 1, 1)) || substr(lower(split_part(o_orderpriority, '-', 2)), 2) AS title FROM orders WHERE o_totalprice > 100000")
def projection_suite(t):
    word = F.lower(tx.piece(F.col("o_orderpriority"), "-", 2))
    status = rel.first_where((F.col("o_orderstatus") == "P", F.lit("pending")), (F.col("o_orderstatus") == "F", F.lit("done"))).otherwise("open")
    o = t("orders").filter("o_totalprice > 100000")
    return o.select(F.col("o_orderkey").alias("id"), status.alias("status"), F.lit("x").alias("batch"), tx.piece(F.col("o_orderpriority"), "-", 1).try_cast("int").alias("priority"), F.concat_ws("/", F.lit("files"), F.col("o_custkey").cast("string"), F.concat("o_orderkey", F.lit(".csv"))).alias("path"), tx.title(word).alias("title"))


@query("SELECT p_partkey, CASE WHEN starts_with(p_type, 'PRO') THEN 'pro' WHEN starts_with(p_type, 'SM') THEN 'small' WHEN starts_with(p_type, 'S') THEN 's' WHEN starts_with(p_type, 'P') THEN 'p' END AS kind FROM part")
def prefix_lookup(t):
    return rel.prefix_lookup(t("part"), "p_type", [("P", "p"), ("S", "s"), ("SM", "small"), ("PRO", "pro")], "kind").select("p_partkey", "kind")


@query(r"WITH w AS (SELECT DISTINCT doc_id, unnest(string_split(text, ' ')) AS word FROM documents) SELECT w.doc_id, count(*) AS words, max(length(word)) AS longest, any_value(d.lang) AS lang FROM w JOIN documents d ON d.doc_id = w.doc_id WHERE word <> '' GROUP BY w.doc_id")
def explode_distinct_attach(t):
    d = t("documents")
    w = d.select("doc_id", F.explode(F.array_distinct(F.split("text", " "))).alias("word")).filter("word <> ''")
    s = w.groupBy("doc_id").agg(F.count("*").alias("words"), F.max(F.length("word")).alias("longest"))
    return s.join(d.select("doc_id", "lang"), "doc_id")


@query("SELECT s_suppkey, s_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def inner_merge(t):
    return t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "s_name", "n_name")


@query("SELECT c_custkey, n_name, r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON r_regionkey = n_regionkey")
def dimension_lookup(t):
    # nation and region are fixed dimensions of 25 and 5 rows; Spark broadcasts them by their measured size.
    c = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return c.join(t("region"), F.col("r_regionkey") == F.col("n_regionkey"), "left").select("c_custkey", "n_name", "r_name")


@query("SELECT l_orderkey, l_linenumber, o_orderstatus, o_totalprice, l_quantity FROM lineitem JOIN orders ON o_orderkey = l_orderkey")
def matrix_attach(t):
    l = t("lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return l.join(t("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus", "o_totalprice"), "l_orderkey").select("l_orderkey", "l_linenumber", "o_orderstatus", "o_totalprice", "l_quantity")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_custkey, o_orderkey) AS row_id FROM orders")
def stable_row_id(t):
    return rel.row_ids(t("orders").select("o_custkey", "o_orderkey"), [F.col("o_custkey"), F.col("o_orderkey")]).select("o_orderkey", "row_id")


@query("SELECT r_regionkey, '#' || upper(lpad(to_hex(r_regionkey * 50 + 5), 2, '0') || lpad(to_hex(r_regionkey), 2, '0') || lpad(to_hex(255 - r_regionkey), 2, '0')) AS hex FROM region")
def palette_hex(t):
    k = F.col("r_regionkey")
    return t("region").select("r_regionkey", tx.hex_colour(F.concat_ws(",", (k * 50 + 5).cast("string"), k.cast("string"), (255 - k).cast("string"))).alias("hex"))


@query("SELECT doc_id, dna, reverse(translate(dna, 'ACGTacgt', 'TGCAtgca')) AS rc, length(dna) AS n FROM (SELECT doc_id, substr(translate(regexp_replace(text, '[^aeiotnsr]', '', 'g'), 'aeiotnsr', 'ACGTACGT'), 3, 60) AS dna FROM documents) WHERE NOT contains(dna, 'ACGACG')")
def reverse_complement(t):
    dna = F.substring(F.translate(F.regexp_replace("text", "[^aeiotnsr]", ""), "aeiotnsr", "ACGTACGT"), 3, 60)
    return t("documents").select("doc_id", dna.alias("dna")).filter(~F.col("dna").contains("ACGACG")).select("doc_id", "dna", tx.reverse_complement(F.col("dna")).alias("rc"), F.length("dna").alias("n"))


@query("SELECT p_partkey, CASE WHEN x = 0 THEN -1e9 WHEN x > 0 THEN round(log2(x), 6) END AS log2_distance FROM (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_size - p_partkey % 40 ELSE p_partkey % 40 - 5 END AS x FROM part)")
def distance_log2(t):
    k = F.col("p_partkey")
    x = F.when(k % 2 == 0, F.col("p_size") - k % 40).otherwise(k % 40 - 5)
    d = safe_log2(x.cast("double"))
    return t("part").select("p_partkey", F.when(d == float("-inf"), F.lit(-1e9)).otherwise(r(d)).alias("log2_distance"))
