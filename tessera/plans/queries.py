"""Queries over the driver's tables, one or more for each operator, and their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import arithmetic, text, values
from tessera.functions.text import RECORD_DEFAULT, Rules
from tessera.functions.values import Missing
from tessera.operators import access, changes, index, nodes, position, records
from tessera.operators.position import SortKey
from tessera.plans.criteria import constant, field
from tessera.sources.readers import decode_base64, encode_base64, table
from tessera.sources.written import written_once
from tessera.streaming import changes as log

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def properties(events: DataFrame) -> DataFrame:
    """Events with the key ``k`` of their properties as a number, missing for values below 10."""
    k = F.get_json_object("props", "$.k").try_cast("bigint")
    return events.withColumn("k", F.when(k >= 10, k))


EVENTS_K = "(SELECT *, CASE WHEN CAST(json_extract_string(props, '$.k') AS BIGINT) >= 10 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k FROM events)"

# ------------------------------------------------------------------ comparisons and logic


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem WHERE l_quantity > 45 AND (l_returnflag = 'R' OR l_discount >= 0.05) AND NOT (l_linestatus = 'F')")
def scan_filter_cmp(spark, d):
    wanted = (field("l_quantity") > 45) & ((field("l_returnflag") == "R") | (field("l_discount") >= 0.05)) & ~(field("l_linestatus") == "F")
    return wanted.rows(table(spark, d, "lineitem")).select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


@query(f"SELECT event_id, k > 50 AS over, (k > 50) OR NULL AS or_unknown, (k > 50) AND NULL AS and_unknown, NOT (k > 50) AS denied FROM {EVENTS_K}")
def filter_3vl_unknown(spark, d):
    over, unknown = field("k") > 50, constant(None)
    parts = {"over": over, "or_unknown": over | unknown, "and_unknown": over & unknown, "denied": ~over}
    return properties(table(spark, d, "events")).select("event_id", *[c.column().alias(n) for n, c in parts.items()])


@query(f"SELECT event_id, coalesce(k > 50, false) AS node, coalesce(k <= 50, true) AS node_not, coalesce(k > 50, false) AS record, coalesce(k <= 50, true) AS record_not, k > 50 AS sql, k <= 50 AS sql_not FROM {EVENTS_K}")
def missing_dialects(spark, d):
    over = field("k") > 50
    columns = [c.column(m).alias(m.value + s) for m in Missing for c, s in ((over, ""), (~over, "_not"))]
    return properties(table(spark, d, "events")).select("event_id", *columns)


@query(f"SELECT event_id FROM {EVENTS_K} WHERE k IS NOT NULL AND event_type <> 'error'")
def exists_field(spark, d):
    return (field("k").exists() & (field("event_type") != "error")).rows(properties(table(spark, d, "events"))).select("event_id")


@query(f"SELECT event_id, coalesce(k, 0) AS k, k IS NOT NULL AND k <> 0 AS truth FROM {EVENTS_K}")
def default_and_truth(spark, d):
    return properties(table(spark, d, "events")).select("event_id", values.with_default(F.col("k"), "number").alias("k"), values.passes(values.truth(F.col("k"), "number")).alias("truth"))


@query("SELECT o_orderkey FROM orders WHERE o_totalprice > 140000 OR o_orderpriority = '1-URGENT' OR o_orderstatus = 'P'")
def or_union_dedup(spark, d):
    tests = [F.col("o_totalprice") > 140000, F.col("o_orderpriority") == "1-URGENT", F.col("o_orderstatus") == "P"]
    return access.any_of(table(spark, d, "orders"), tests).select("o_orderkey")


# ------------------------------------------------------------------ arithmetic


@query("SELECT p_partkey, CAST(xor(p_size & 12, 5) | 3 AS BIGINT) AS bits FROM part WHERE ((p_size & 4) = 4)")
def bitwise_precedence(spark, d):
    size = F.col("p_size")
    bits = arithmetic.bit_or(arithmetic.bit_xor(arithmetic.bit_and(size, F.lit(12)), F.lit(5)), F.lit(3))
    return (field(arithmetic.bit_and(size, F.lit(4))) == 4).rows(table(spark, d, "part")).select("p_partkey", bits.alias("bits"))


@query("SELECT p_partkey, CASE WHEN b = 0 THEN NULL ELSE a // b END AS quotient, CASE WHEN b = 0 THEN NULL ELSE a % b END AS remainder FROM (SELECT p_partkey, CAST(p_size - 25 AS BIGINT) AS a, CAST(p_partkey % 7 - 3 AS BIGINT) AS b FROM part)")
def arith_div_mod_zero(spark, d):
    a, b = F.col("p_size") - 25, F.col("p_partkey") % 7 - 3
    return table(spark, d, "part").select("p_partkey", arithmetic.divide(a, b).alias("quotient"), arithmetic.modulo(a, b).alias("remainder"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN NULL ELSE CAST(p_size AS BIGINT) END AS added, CASE WHEN p_size % 2 = 0 THEN NULL ELSE -CAST(p_size AS BIGINT) END AS negated, CASE WHEN p_size % 3 = 0 THEN CAST(p_size AS BIGINT) * 1000 END AS multiplied FROM part")
def arith_overflow_missing(spark, d):
    size = F.col("p_size").cast("bigint")
    most = F.when(F.col("p_size") % 2 == 0, F.lit(2**63 - 1)).otherwise(0)
    added = arithmetic.add(size, most.cast("bigint"))
    factor = F.when(F.col("p_size") % 3 == 0, 1000).otherwise(F.lit(2**62)).cast("bigint")
    big = F.when(F.col("p_size") % 3 == 0, size).otherwise(size + 2)
    return table(spark, d, "part").select("p_partkey", added.alias("added"), arithmetic.negate(added).alias("negated"), arithmetic.multiply(big, factor).alias("multiplied"))


@query("SELECT p_partkey, CAST(CAST(18446744073709551615 AS HUGEINT) - p_partkey AS VARCHAR) AS u, CAST((CAST(18446744073709551615 AS HUGEINT) - p_partkey) // 10 AS VARCHAR) AS tenth, p_partkey < 18446744073709551615 AS less, CASE WHEN p_partkey = 0 THEN '18446744073709551615' END AS over FROM part")
def unsigned_range(spark, d):
    key = arithmetic.unsigned(F.col("p_partkey"))
    most = F.lit(str(arithmetic.MOST_UNSIGNED)).cast(arithmetic.UNSIGNED)
    u = arithmetic.unsigned(most - key)
    return table(spark, d, "part").select("p_partkey", u.cast("string").alias("u"), arithmetic.unsigned_divide(u, F.lit(10)).cast("string").alias("tenth"), (arithmetic.wide(F.col("p_partkey")) < most).alias("less"), arithmetic.unsigned_add(most, key).cast("string").alias("over"))


U = "(CAST(18446744073709551615 AS UBIGINT) - CAST(p_partkey AS UBIGINT))"


@query(f"SELECT p_partkey, CAST({U} & 255 AS VARCHAR) AS low, CAST({U} | 4096 AS VARCHAR) AS more, CAST(xor({U}, CAST(p_size AS UBIGINT)) AS VARCHAR) AS turned FROM part")
def unsigned_bits(spark, d):
    """Operands beyond 2**63."""
    u = F.lit(str(arithmetic.MOST_UNSIGNED)).cast(arithmetic.UNSIGNED) - F.col("p_partkey")
    parts = {"low": arithmetic.unsigned_bit_and(u, F.lit(255)), "more": arithmetic.unsigned_bit_or(u, F.lit(4096)), "turned": arithmetic.unsigned_bit_xor(u, F.col("p_size"))}
    return table(spark, d, "part").select("p_partkey", *[v.cast("string").alias(n) for n, v in parts.items()])


MIXED = "(SELECT p_partkey, CAST(18446744073709551615 AS HUGEINT) - p_partkey AS u, CAST(p_size - 25 AS HUGEINT) AS s, CAST(p_partkey AS HUGEINT) AS k FROM part)"
FITS = "CASE WHEN {0} BETWEEN -9223372036854775808 AND 18446744073709551615 THEN CAST({0} AS VARCHAR) END"


@query(f"SELECT p_partkey, {FITS.format('(u + s)')} AS added, {FITS.format('(u - s)')} AS less, {FITS.format('(k - u)')} AS under, {FITS.format('(k * s)')} AS product, CASE WHEN s <> 0 THEN {FITS.format('(u // s)')} END AS quotient, CASE WHEN s <> 0 THEN {FITS.format('(u % s)')} END AS remainder, {FITS.format('(s - k)')} AS negative FROM {MIXED}")
def mixed_signs(spark, d):
    """Unsigned with signed operands; what fits neither range is missing."""
    u, size, key = F.lit(str(arithmetic.MOST_UNSIGNED)).cast(arithmetic.UNSIGNED) - F.col("p_partkey"), F.col("p_size") - 25, F.col("p_partkey")
    a = arithmetic
    parts = {
        "added": a.mixed_add(u, size), "less": a.mixed_subtract(u, size), "under": a.unsigned_subtract(key, u), "product": a.mixed_multiply(key, size),
        "quotient": a.mixed_divide(u, size), "remainder": a.mixed_modulo(u, size), "negative": a.mixed_subtract(size, key),
    }
    return table(spark, d, "part").select("p_partkey", *[v.cast("string").alias(n) for n, v in parts.items()])


# ------------------------------------------------------------------ texts


@query("SELECT p_partkey FROM part WHERE lower(p_brand) LIKE 'brand#1%' AND lower(p_name) LIKE '%l%t'")
def match_wild(spark, d):
    own = {"rules": RECORD_DEFAULT}
    return ((field("p_brand", **own) == "BRAND#1*") & field("p_name", **own).matches("*L*t")).rows(table(spark, d, "part")).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE starts_with(lower(p_name), 'sm')")
def match_begin(spark, d):
    return field("p_name", rules=RECORD_DEFAULT).match_begin("SM").rows(table(spark, d, "part")).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE ends_with(lower(p_name), 'get')")
def match_end(spark, d):
    return field("p_name", rules=RECORD_DEFAULT).match_end("Get").rows(table(spark, d, "part")).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE NOT contains(lower(p_name), 'ld w')")
def contains(spark, d):
    return (~field("p_name", rules=RECORD_DEFAULT).contains("LD W")).rows(table(spark, d, "part")).select("p_partkey")


@query("SELECT o_orderkey, lower(regexp_replace(replace(o_orderpriority, '-', ''), ' ', '', 'g')) AS folded FROM orders WHERE lower(regexp_replace(replace(o_orderpriority, '-', ''), ' ', '', 'g')) = '4notspecified'")
def cmp_rules_nospace_nodash(spark, d):
    rules = Rules(no_case=True, no_dashes=True, no_spaces=True)
    return (field("o_orderpriority", rules=rules) == "4 - not SPECIFIED").rows(table(spark, d, "orders")).select("o_orderkey", rules.apply(F.col("o_orderpriority")).alias("folded"))


@query("SELECT doc_id, trim(regexp_replace(translate(text, chr(9) || chr(10) || chr(13), '   '), ' +', ' ', 'g'), ' ') AS folded FROM documents")
def cmp_rules_white_space(spark, d):
    rules = Rules(white_space_as_space=True, compress_spaces=True, ignore_leading=True, ignore_trailing=True)
    return table(spark, d, "documents").select("doc_id", rules.apply(F.col("text")).alias("folded"))


@query(r"SELECT c_custkey, c_name = 'Customer#000000001' AS plain, starts_with(c_name, 'Customer*') AS star, starts_with(c_name, 'Customer#00000000') AS wild FROM customer")
def wildcard_escape(spark, d):
    wild = Rules(wild=True)
    parts = {"plain": "Customer#000000001", "star": r"Customer\**", "wild": "Customer#00000000*"}
    return table(spark, d, "customer").select("c_custkey", *[text.equals(F.col("c_name"), p, wild).alias(n) for n, p in parts.items()])


@query("SELECT p_partkey, CASE WHEN lower(p_name) < lower(p_type) THEN -1 WHEN lower(p_name) = lower(p_type) THEN 0 ELSE 1 END AS c FROM part")
def compare_two_texts(spark, d):
    return table(spark, d, "part").select("p_partkey", text.compare_texts(F.col("p_name"), F.col("p_type"), Rules(no_case=True)).alias("c"))


@query("SELECT p_partkey FROM part WHERE list_contains(string_split(p_name, ' '), 'small') OR list_contains(string_split(p_name, ' '), 'cold')")
def approx_eq(spark, d):
    """By sound; in these names only the words themselves sound like the misspelt constants."""
    name = field("p_name")
    return (name.sounds_like("smoll") | name.sounds_like("kold")).rows(table(spark, d, "part")).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE list_contains(string_split(p_name, ' '), lower(p_type))")
def approx_eq_columns(spark, d):
    """Two columns: each word of the left one sounds like some word of the right one."""
    return field("p_type").sounds_like(field("p_name")).rows(table(spark, d, "part")).select("p_partkey")


@query("SELECT p_partkey, encode(p_name) < encode(p_brand) AS less, (p_size > 25) = (p_partkey % 2 = 0) AS alike FROM part")
def binary_and_boolean(spark, d):
    part = table(spark, d, "part").withColumns({"raw": F.encode("p_name", "utf-8"), "large": F.col("p_size") > 25, "even": F.col("p_partkey") % 2 == 0})
    return part.select("p_partkey", (field("raw") < field(F.encode("p_brand", "utf-8"))).column().alias("less"), (field("large") == field("even")).column().alias("alike"))


@query("SELECT doc_id, base64(encode(text)) AS coded, text AS again FROM documents")
def base64_round_trip(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", F.encode("text", "utf-8").alias("coded"))
    coded = encode_base64(docs, "coded").withColumn("coded", F.regexp_replace("coded", "[\\r\\n]", ""))
    back = decode_base64(coded.withColumn("again", F.col("coded")), "again")
    return back.select("doc_id", "coded", F.decode("again", "utf-8").alias("again"))


@query("SELECT doc_id, trim(regexp_replace(text, '[ \t\r\n]+', ' ', 'g'), ' ') AS normal, CASE WHEN contains(text, '. ') THEN string_split(text, '. ')[1] ELSE '' END AS before, length(text) AS chars FROM documents")
def string_functions(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", text.normalize_space(t).alias("normal"), text.substring_before(t, ". ").alias("before"), F.char_length(t).cast("bigint").alias("chars"))


# ------------------------------------------------------------------ many values


def words(df: DataFrame) -> DataFrame:
    return df.withColumn("words", F.split("p_name", " ")).withColumn("numbers", F.array("p_size", (F.col("p_partkey") % 50).cast("int")))


@query("SELECT p_partkey FROM part WHERE list_contains(string_split(p_name, ' '), 'widget') AND len(list_filter(string_split(p_name, ' '), lambda w: w > 'w')) > 0")
def multi_any(spark, d):
    own = field("words", many=True)
    return ((own == "widget") & (own > "w")).rows(words(table(spark, d, "part"))).select("p_partkey")


@query("SELECT p_partkey, NOT list_contains(string_split(p_name, ' '), 'widget') AS not_equal, len(list_filter(string_split(p_name, ' '), lambda w: w <> 'widget')) > 0 AS unequal FROM part")
def multi_every(spark, d):
    """NOT (f = v) asks it of every value; f <> v of some value."""
    own = field("words", many=True)
    return words(table(spark, d, "part")).select("p_partkey", (~(own == "widget")).column().alias("not_equal"), (own != "widget").column().alias("unequal"))


@query("SELECT p_partkey, p_size > 25 OR p_partkey % 50 > 25 AS some_pair, p_size <= 25 AND p_partkey % 50 <= 25 AS no_pair FROM part")
def multi_all_pairs(spark, d):
    own, limit = field("numbers", many=True), field(F.array(F.lit(25), F.lit(60)), many=True)
    over = own > limit
    rows = words(table(spark, d, "part"))
    return rows.select("p_partkey", over.column().alias("some_pair"), values.compare_values(">", F.col("numbers"), F.lit(25), negated=True).alias("no_pair"))


def person_records(spark: SparkSession, d: str) -> DataFrame:
    """Customers as records: 1 root, 2 name, 3 segment, 4 balance, 5 its sign below the balance, 6 two numbers."""
    m = records.make_field
    balance = F.floor("c_acctbal").cast("bigint")
    fields = F.array(
        m(0, None, 0, 1, "context"), m(1, 0, 1, 2, "text", F.col("c_name")), m(2, 0, 1, 3, "text", F.when(F.col("c_custkey") % 4 != 0, F.col("c_mktsegment"))), m(3, 0, 1, 4, "number", balance),
        m(4, 3, 2, 5, "text", F.when(balance < 0, "debit").otherwise("credit")), m(5, 0, 1, 6, "number", F.col("c_custkey") % 10), m(6, 0, 1, 6, "number", F.col("c_nationkey")), m(7, 6, 2, 7, "pointer", F.col("c_custkey") + 1),
    )
    return table(spark, d, "customer").select(F.col("c_custkey").alias("drn"), fields.alias("fields"))


@query("SELECT c_custkey AS drn FROM customer WHERE floor(c_acctbal) >= 0 AND (c_custkey % 10 = 3 OR c_nationkey = 3)")
def record_field_paths(spark, d):
    credit = field(records.values_at([1, 4, 5], rooted=True), many=True) == "credit"
    three = field(records.values_of(6, "number"), many=True) == F.lit(3).cast("decimal(20,0)")
    return (credit & three).rows(person_records(spark, d), Missing.RECORD).select("drn")


@query("SELECT c_custkey AS drn FROM customer WHERE lower(c_mktsegment) LIKE '%mach%' AND c_custkey % 4 <> 0")
def record_any_field(spark, d):
    return field(records.values_of_any(), many=True, rules=RECORD_DEFAULT).contains("MACH").rows(person_records(spark, d), Missing.RECORD).select("drn")


@query("SELECT tag, count(*) AS n FROM (SELECT unnest([1, 2, 3, 4, 5, 6, 6, 7]) AS tag FROM customer) GROUP BY tag")
def record_field_counts(spark, d):
    return records.long_table(person_records(spark, d)).groupBy("tag").agg(F.count("*").alias("n"))


@query("SELECT c_custkey AS drn FROM customer")
def record_text_round_trip(spark, d):
    """Records written as text trees and read back, of which those that came back the same."""
    own = person_records(spark, d)
    back = records.from_text_tree(own.select("drn", records.to_text_tree().alias("text"))).select("drn", F.to_json("fields").alias("record"))
    return access.in_both(own.select("drn", F.to_json("fields").alias("record")), back).select("drn")


@query("SELECT c_custkey AS drn, c_custkey + 1 AS ref FROM customer WHERE c_custkey + 1 IN (SELECT c_custkey FROM customer)")
def record_pointers(spark, d):
    own = person_records(spark, d)
    return records.follow(own, 7, own).select("drn", "ref")


@query("SELECT unnest([8, 9]) AS tag")
def sweep_unused_fields(spark, d):
    return records.unused_tags(person_records(spark, d), spark.range(1, 10).select(F.col("id").cast("int").alias("tag")))


# ------------------------------------------------------------------ access by number and key


@query("SELECT * FROM orders WHERE o_orderkey = 77")
def drn_point(spark, d):
    return access.retrieve(table(spark, d, "orders"), "o_orderkey", 77)


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey BETWEEN 100 AND 250")
def drn_range(spark, d):
    return access.between(table(spark, d, "orders"), "o_orderkey", 100, 250).select("o_orderkey", "o_custkey")


@query("SELECT * FROM (SELECT 'first' AS how, o_orderkey FROM orders ORDER BY o_orderkey LIMIT 1) UNION ALL SELECT * FROM (SELECT 'last', o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 1) UNION ALL SELECT * FROM (SELECT 'including', o_orderkey FROM orders WHERE o_orderkey >= 33 ORDER BY o_orderkey LIMIT 1) UNION ALL SELECT * FROM (SELECT 'excluding', o_orderkey FROM orders WHERE o_orderkey > 33 ORDER BY o_orderkey LIMIT 1)")
def seek_flags(spark, d):
    orders = table(spark, d, "orders")
    found = [access.retrieve(orders, "o_orderkey", 33, how).select(F.lit(how).alias("how"), "o_orderkey") for how in ("first", "last", "including", "excluding")]
    return reduce(DataFrame.unionAll, found)


def name_index(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("drn"), "p_brand", "p_size")


@query("SELECT p_partkey AS drn, p_brand, p_size FROM part WHERE (p_brand, p_size) >= ('Brand#2', 30) ORDER BY p_brand, p_size, p_partkey LIMIT 1")
def key_seek_ge(spark, d):
    return access.retrieve_key(name_index(spark, d), ["p_brand", "p_size"], ["Brand#2", 30])


@query("SELECT p_partkey AS drn, p_brand, p_size FROM part WHERE (p_brand, p_size) > ('Brand#13', 24) ORDER BY p_brand, p_size, p_partkey LIMIT 1")
def key_seek_gt(spark, d):
    return access.retrieve_key(name_index(spark, d), ["p_brand", "p_size"], ["Brand#13", 24], "excluding")


@query("SELECT p_partkey, p_retailprice FROM part WHERE list_contains(string_split(p_name, ' '), 'small')")
def index_to_records(spark, d):
    part = table(spark, d, "part")
    found = index.word_keys(part, "p_partkey", F.col("p_name")).filter("key = 'small'").withColumnRenamed("drn", "p_partkey")
    return access.records_of_keys(found, part, "p_partkey").select("p_partkey", "p_retailprice")


# ------------------------------------------------------------------ order and place

BY_PRICE = [SortKey("o_orderpriority"), SortKey("o_totalprice", descending=True)]


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey LIMIT 1")
def cursor_first(spark, d):
    return position.first(table(spark, d, "orders"), BY_PRICE, "o_orderkey").select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderpriority DESC, o_totalprice, o_orderkey DESC LIMIT 1")
def cursor_last(spark, d):
    return position.last(table(spark, d, "orders"), BY_PRICE, "o_orderkey").select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n = 100")
def abs_position(spark, d):
    return position.at(table(spark, d, "orders"), BY_PRICE, "o_orderkey", 100).select("o_orderkey")


@query("WITH p AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey) AS n FROM orders) SELECT o_orderkey FROM p WHERE n = (SELECT n + 5 FROM p WHERE o_orderkey = 10)")
def move_relative(spark, d):
    return position.move(table(spark, d, "orders"), BY_PRICE, "o_orderkey", 10, 5).select("o_orderkey")


@query("SELECT o_orderkey, row_number() OVER w AS position, CAST(floor(1000 * (row_number() OVER w - 1) / ((SELECT count(*) FROM orders) - 1)) AS BIGINT) AS percent_position FROM orders WINDOW w AS (ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey)")
def percent_position(spark, d):
    return position.percent_place(table(spark, d, "orders"), BY_PRICE, "o_orderkey").select("o_orderkey", "position", "percent_position")


@query("WITH p AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey) AS n FROM orders) SELECT CAST(sign((SELECT n FROM p WHERE o_orderkey = 3) - (SELECT n FROM p WHERE o_orderkey = 4)) AS INT) AS comparison")
def compare_positions(spark, d):
    return position.compare_places(table(spark, d, "orders"), BY_PRICE, "o_orderkey", 3, 4)


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 100000 ORDER BY o_totalprice, o_orderkey LIMIT 1")
def position_to_key(spark, d):
    return position.seek(table(spark, d, "orders"), [SortKey("o_totalprice")], "o_orderkey", 100000).select("o_orderkey", "o_totalprice")


@query(f"SELECT event_id, row_number() OVER (ORDER BY k NULLS LAST, event_type DESC, event_id) AS position FROM {EVENTS_K}")
def sort_multi_missing_high(spark, d):
    keys = [SortKey("k", missing_high=True), SortKey("event_type", descending=True)]
    return position.numbered(properties(table(spark, d, "events")), keys, "event_id").select("event_id", "position")


@query("SELECT p_partkey, row_number() OVER (ORDER BY substr(upper(list_min(string_split(p_name, ' '))), 1, 3), p_partkey) AS position FROM part")
def sort_lowest_of_many(spark, d):
    rows = table(spark, d, "part").withColumn("words", F.transform(F.split("p_name", " "), F.upper))
    return position.numbered(rows, [SortKey("words", many=True, limit=3)], "p_partkey").select("p_partkey", "position")


@query("SELECT count(*) AS read, count(*) FILTER (WHERE l_quantity > 45) AS passed FROM lineitem")
def rec_count(spark, d):
    return position.counts(table(spark, d, "lineitem"), F.col("l_quantity") > 45)


@query("SELECT l_orderkey AS doc_id, row_number() OVER (ORDER BY min(CAST(CAST(l_quantity AS INT) AS VARCHAR)), l_orderkey) AS position FROM lineitem GROUP BY 1")
def sort_by_nodes(spark, d):
    """Documents by the lowest text at order/line/qty."""
    keys = nodes.node_keys(order_nodes(spark, d), ["order", "line", "qty"])
    order = [SortKey("keys", many=True)]
    position.verify(keys, order, "doc_id")
    return position.numbered(keys, order, "doc_id").select("doc_id", "position")


# ------------------------------------------------------------------ indexes


@query("SELECT DISTINCT doc_id AS drn, unnest(regexp_extract_all(lower(text), '[\\p{L}0-9]+')) AS key FROM documents")
def ix_eachword(spark, d):
    return index.word_keys(table(spark, d, "documents"), "doc_id", F.col("text"), Rules(no_case=True))


@query("SELECT DISTINCT drn, substr(name, i, 48) AS key FROM (SELECT p_partkey AS drn, lower(p_name) AS name, unnest(range(1, length(p_name) + 1)) AS i FROM part) WHERE NOT starts_with(substr(name, i, 48), ' ')")
def ix_substring(spark, d):
    return index.substring_keys(table(spark, d, "part"), "p_partkey", F.col("p_name"), Rules(no_case=True))


@query(f"SELECT event_id AS drn, 'k' AS key FROM {EVENTS_K} WHERE k IS NOT NULL UNION ALL SELECT event_id, 'value' FROM events WHERE value IS NOT NULL")
def ix_presence(spark, d):
    return index.presence_keys(properties(table(spark, d, "events")), "event_id", ["k", "value"])


@query("SELECT DISTINCT p_partkey AS drn, w AS key0, p_brand AS key1 FROM (SELECT p_partkey, p_brand, unnest(string_split(p_name, ' ')) AS w FROM part)")
def ix_compound(spark, d):
    part = table(spark, d, "part")
    return index.compound_keys([index.word_keys(part, "p_partkey", F.col("p_name")), index.value_keys(part, "p_partkey", F.col("p_brand"))], [True, True])


@query("SELECT key, count(DISTINCT drn) AS refs FROM (SELECT p_partkey AS drn, unnest(string_split(p_name, ' ')) AS key FROM part) GROUP BY key")
def index_key_counts(spark, d):
    return index.key_counts(index.word_keys(table(spark, d, "part"), "p_partkey", F.col("p_name")))


@query("SELECT count(DISTINCT key) AS keys, count(*) AS refs FROM (SELECT DISTINCT p_partkey, unnest(string_split(p_name, ' ')) AS key FROM part)")
def index_totals(spark, d):
    return index.index_counts(index.word_keys(table(spark, d, "part"), "p_partkey", F.col("p_name")))


# The words of the parts' names with their sounds by the published algorithm.
WORD_SOUNDS = (
    "anvil ANFL, blue PL, bolt PLT, cold KLT, gear KR, gear JR, gizmo KSM, gizmo JSM, hot HT, large LRJ, large LRK, new N, new NF, old ALT, "
    "plate PLT, red RT, ring RNK, rod RT, small SML, small XML, widget AJT, widget FJT"
)
SOUNDS_TABLE = "(VALUES " + ", ".join(f"('{w}', '{c}')" for w, c in (x.split() for x in WORD_SOUNDS.split(", "))) + ") AS t(word, sound)"
PACKED = " + ".join(f"CASE WHEN length(sound) >= {i} THEN {16 ** (4 - i)} * strpos('AFHJKLMNPRSTX0', substr(sound, {i}, 1)) ELSE 0 END" for i in range(1, 5))


@query(f"SELECT DISTINCT p_partkey AS drn, CAST({PACKED} AS INT) AS key FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w FROM part) JOIN {SOUNDS_TABLE} ON w = word")
def ix_metaphone(spark, d):
    return index.sound_keys(table(spark, d, "part"), "p_partkey", F.col("p_name"))


@query("SELECT p_partkey AS drn, p_brand AS key0, w AS key1 FROM part LEFT JOIN (SELECT DISTINCT p_partkey AS k, w FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w FROM part) WHERE w > 'r') ON k = p_partkey")
def ix_compound_optional(spark, d):
    """A key for each record, also where the second part is missing."""
    part = table(spark, d, "part")
    return index.compound_keys([index.value_keys(part, "p_partkey", F.col("p_brand")), index.word_keys(part, "p_partkey", F.col("p_name")).filter("key > 'r'")], [True, False])


@query("SELECT DISTINCT p_partkey AS drn, w AS key, p_size, p_retailprice FROM (SELECT p_partkey, p_size, p_retailprice, unnest(string_split(p_name, ' ')) AS w FROM part)")
def ix_covering(spark, d):
    part = table(spark, d, "part")
    return index.covering(index.word_keys(part, "p_partkey", F.col("p_name")), part, "p_partkey", ["p_size", "p_retailprice"])


@query("SELECT p_partkey AS drn, CASE WHEN p_size > 25 THEN p_name ELSE p_brand END AS key FROM part")
def ix_alternate(spark, d):
    return index.alternate_keys(table(spark, d, "part"), "p_partkey", [F.when(F.col("p_size") > 25, F.col("p_name")), F.col("p_brand")])


@query("SELECT DISTINCT p_partkey AS drn, lower(p_brand) AS key, '1' || repeat('0', length(p_brand) - 1) AS post FROM part")
def ix_post(spark, d):
    return index.post_keys(table(spark, d, "part"), "p_partkey", F.col("p_brand"))


@query("SELECT 'customer' AS container, c_custkey AS drn, c_name AS key FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_name FROM supplier")
def ix_across(spark, d):
    """One index over two containers."""
    return index.across({"customer": index.value_keys(table(spark, d, "customer"), "c_custkey", F.col("c_name")), "supplier": index.value_keys(table(spark, d, "supplier"), "s_suppkey", F.col("s_name"))})


@query("SELECT c_nationkey, c_mktsegment, count(*) AS count FROM customer GROUP BY ALL HAVING count(*) > 1")
def unique_violations(spark, d):
    return changes.violations(table(spark, d, "customer"), ["c_nationkey", "c_mktsegment"])


# ------------------------------------------------------------------ rows in and out of tables


@query("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def select_distinct(spark, d):
    return table(spark, d, "orders").select("o_orderstatus", "o_orderpriority").distinct()


@query("SELECT o_orderkey, c_name FROM orders, customer WHERE o_custkey = c_custkey AND c_acctbal < 0")
def comma_join_2(spark, d):
    where = (F.col("o_custkey") == F.col("c_custkey")) & (F.col("c_acctbal") < 0)
    return access.comma_join([table(spark, d, "orders"), table(spark, d, "customer")], where).select("o_orderkey", "c_name")


@query("SELECT c_custkey, n_name, r_name FROM customer, nation, region WHERE c_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name <> 'ASIA'")
def comma_join_3(spark, d):
    where = (F.col("c_nationkey") == F.col("n_nationkey")) & (F.col("n_regionkey") == F.col("r_regionkey")) & (F.col("r_name") != "ASIA")
    return access.comma_join([table(spark, d, t) for t in ("customer", "nation", "region")], where).select("c_custkey", "n_name", "r_name")


@query("SELECT n_name, r_name FROM nation, region WHERE n_nationkey > 4 * r_regionkey AND n_name > r_name")
def theta_join(spark, d):
    where = (F.col("n_nationkey") > 4 * F.col("r_regionkey")) & (F.col("n_name") > F.col("r_name"))
    return access.comma_join([table(spark, d, "nation"), table(spark, d, "region")], where).select("n_name", "r_name")


@query("SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'moved' ELSE c_name END AS c_name FROM customer UNION ALL SELECT -1 - c_custkey, 'new' FROM customer WHERE c_custkey % 7 = 0")
def restore_increments(spark, d):
    """A snapshot moved on by two increments."""
    own = table(spark, d, "customer").select("c_custkey", "c_name")
    first = own.filter("c_custkey % 5 = 0").withColumn("c_name", F.lit("moved"))
    second = own.filter("c_custkey % 7 = 0").select((-1 - F.col("c_custkey")).alias("c_custkey"), F.lit("new").alias("c_name"))
    return changes.restore(own, [first, second], "c_custkey")


@query("SELECT p_partkey, CASE WHEN p_size > 25 THEN p_size * 2 + 1 ELSE p_size END AS p_size, CASE WHEN p_size > 25 THEN NULL ELSE p_brand END AS p_brand FROM part")
def update_set_expr(spark, d):
    out = changes.update(table(spark, d, "part"), {"p_size": F.col("p_size") * 2 + 1, "p_brand": F.lit(None)}, F.col("p_size") > 25)
    return out.select("p_partkey", "p_size", "p_brand")


@query(f"SELECT event_id FROM {EVENTS_K} WHERE NOT coalesce(k > 50, false)")
def delete_where(spark, d):
    return changes.delete(properties(table(spark, d, "events")), F.col("k") > 50).select("event_id")


@query("SELECT * FROM region UNION ALL SELECT 99, 'ATLANTIS' UNION ALL SELECT NULL, 'MU'")
def insert_values(spark, d):
    rows = spark.createDataFrame([("ATLANTIS", "99"), ("MU", "x")], "r_name string, r_regionkey string")
    return changes.insert(table(spark, d, "region"), rows)


@query("SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'moved' ELSE c_name END AS c_name FROM customer WHERE c_custkey % 7 <> 0")
def modify_and_remove(spark, d):
    own = table(spark, d, "customer").select("c_custkey", "c_name")
    changed = own.filter("c_custkey % 5 = 0").withColumn("c_name", F.lit("moved"))
    return changes.remove(changes.modify(own, changed, "c_custkey"), own.filter("c_custkey % 7 = 0"), "c_custkey")


@query("SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1 AND event_type <> 'error'")
def cdc_replay(spark, d):
    own = table(spark, d, "events").withColumn("op", F.when(F.col("event_type") == "error", log.DELETE).otherwise(log.MODIFY))
    return log.replay(own.select("user_id", "event_id", "ts", "event_type", "value", "op"), ["user_id"], ["ts", "event_id"], "op").select("user_id", "event_id", "event_type", "value")


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, CAST(round(sum(value) * 100) AS BIGINT) AS cents FROM events GROUP BY ALL")
def events_by_hour(spark, d):
    """Extension."""
    out = log.windowed(table(spark, d, "events"), "ts", "1 hour", ["event_type"], [F.count("*").alias("n"), F.round(F.sum("value") * 100).cast("bigint").alias("cents")])
    return out.drop("window_end")


@query("SELECT w AS window_start, count(*) AS n FROM (SELECT unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS w FROM events) GROUP BY 1")
def events_sliding(spark, d):
    """Extension: windows of two hours, one each hour."""
    return log.windowed(table(spark, d, "events"), "ts", "2 hours", [], [F.count("*").alias("n")], slide="1 hour").drop("window_end")


@query("WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS session_start, count(*) AS n FROM s GROUP BY user_id, k")
def events_sessions(spark, d):
    """Extension: a user's events until a gap of half an hour."""
    return log.sessions(table(spark, d, "events"), "ts", "30 minutes", ["user_id"], [F.count("*").alias("n")]).drop("session_end")


# ------------------------------------------------------------------ XML nodes


def order_documents(spark: SparkSession, d: str) -> DataFrame:
    """An XML document for each order: its lines in order, each with attributes and a price."""
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag")
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(line)).alias("lines"))
    one = lambda x: F.concat(
        F.lit('<line no="'), x["l_linenumber"], F.lit('" part="'), x["l_partkey"], F.lit('"><qty>'), x["l_quantity"].cast("int"), F.lit("</qty><flag>"), x["l_returnflag"], F.lit("</flag></line>")
    )
    xml = F.concat(F.lit('<order key="'), "l_orderkey", F.lit('"><head/>'), F.array_join(F.transform("lines", one), ""), F.lit("<!-- end --></order>"))
    return lines.select(F.col("l_orderkey").alias("doc_id"), xml.alias("xml"))


def order_nodes(spark: SparkSession, d: str) -> DataFrame:
    """The node table, imported once by an application and then read by every step of every query."""
    return written_once(spark, f"order nodes of {d}", lambda: nodes.import_documents(order_documents(spark, d), "doc_id", "xml"))


LINES = "(SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_returnflag) AS n, count(*) OVER (PARTITION BY l_orderkey) AS m FROM lineitem)"


@query("SELECT kind, name, count FROM (SELECT 'element' AS kind, 'line' AS name, count(*) AS count FROM lineitem UNION ALL SELECT 'element', 'qty', count(*) FROM lineitem UNION ALL SELECT 'element', 'flag', count(*) FROM lineitem UNION ALL SELECT 'text', NULL, 2 * count(*) FROM lineitem UNION ALL SELECT 'attribute', 'no', count(*) FROM lineitem UNION ALL SELECT 'attribute', 'part', count(*) FROM lineitem UNION ALL SELECT 'attribute', 'key', count(DISTINCT l_orderkey) FROM lineitem UNION ALL SELECT 'element', 'order', count(DISTINCT l_orderkey) FROM lineitem UNION ALL SELECT 'element', 'head', count(DISTINCT l_orderkey) FROM lineitem UNION ALL SELECT 'comment', NULL, count(DISTINCT l_orderkey) FROM lineitem)")
def node_statistics(spark, d):
    return nodes.statistics(order_nodes(spark, d))


@query("SELECT l_orderkey AS doc_id, count(*) AS lines FROM lineitem GROUP BY 1")
def axis_child(spark, d):
    all_ = order_nodes(spark, d)
    return nodes.step(nodes.roots(all_), all_, "child", "line").groupBy("doc_id").agg(F.count("*").alias("lines"))


@query("SELECT l_orderkey AS doc_id, CAST(l_quantity AS INT) AS qty, count(*) AS n FROM lineitem GROUP BY ALL")
def axis_descendant(spark, d):
    all_ = order_nodes(spark, d)
    found = nodes.string_value(all_, nodes.step(nodes.roots(all_), all_, "descendant", "qty"))
    return found.select("doc_id", F.col("text").cast("int").alias("qty")).groupBy("doc_id", "qty").agg(F.count("*").alias("n"))


@query(f"SELECT l_orderkey AS doc_id, CAST(l_partkey AS BIGINT) AS part FROM {LINES} WHERE n > 1")
def axis_following_sibling(spark, d):
    all_ = order_nodes(spark, d)
    later = nodes.step(all_.filter("name = 'line'"), all_, "following-sibling", "line")
    parts = nodes.step(later, all_, "attribute", "part")
    return parts.select("doc_id", F.col("value").cast("bigint").alias("part"))


@query(f"SELECT l_orderkey AS doc_id, l_returnflag AS flag FROM {LINES} WHERE n < m")
def axis_preceding(spark, d):
    """Flags before the last line."""
    all_ = order_nodes(spark, d)
    last = nodes.step(nodes.roots(all_), all_, "child", kind="comment")
    line = nodes.step(last, all_, "preceding-sibling", "line", occurrence=1)
    return nodes.string_value(all_, nodes.step(line, all_, "preceding", "flag")).select("doc_id", F.col("text").alias("flag"))


@query("SELECT DISTINCT l_orderkey AS doc_id FROM lineitem WHERE l_quantity >= 48")
def axis_ancestor(spark, d):
    all_ = order_nodes(spark, d)
    big = all_.filter((F.col("kind") == "text") & (nodes.number(F.col("value"), "int") >= 48))
    big = nodes.step(big, all_, "parent", "qty")
    return nodes.step(big, all_, "ancestor", "order").select("doc_id")


@query(f"SELECT l_orderkey AS doc_id, CAST(l_linenumber AS INT) AS no FROM {LINES} WHERE n = 2")
def occurrence_n(spark, d):
    all_ = order_nodes(spark, d)
    second = nodes.step(nodes.roots(all_), all_, "child", "line", occurrence=2)
    return nodes.step(second, all_, "attribute", "no").select("doc_id", F.col("value").cast("int").alias("no"))


@query("SELECT l_orderkey AS doc_id, count(*) AS n FROM lineitem WHERE l_partkey % 10 = 3 GROUP BY 1")
def nested_predicate(spark, d):
    """line[@part mod 10 = 3]"""
    all_ = order_nodes(spark, d)
    marked = all_.filter((F.col("kind") == "attribute") & (F.col("name") == "part") & (F.col("value").try_cast("bigint") % 10 == 3))
    return nodes.where(all_.filter("name = 'line'"), marked, "attribute").groupBy("doc_id").agg(F.count("*").alias("n"))


@query(f"SELECT l_orderkey AS doc_id, CAST(l_linenumber AS INT) AS no FROM {LINES} WHERE n = m")
def occurrence_last(spark, d):
    """line[last()]/@no"""
    all_ = order_nodes(spark, d)
    last = nodes.step(nodes.roots(all_), all_, "child", "line", occurrence=nodes.last_place)
    return nodes.step(last, all_, "attribute", "no").select("doc_id", F.col("value").cast("int").alias("no"))


@query(f"SELECT l_orderkey AS doc_id, CAST(l_linenumber AS INT) AS no FROM {LINES} WHERE n % 2 = 0 AND n > m - 3")
def occurrence_expression(spark, d):
    """Even places among the last three."""
    all_ = order_nodes(spark, d)
    some = nodes.step(nodes.roots(all_), all_, "child", "line", occurrence=lambda place, last: (place % 2 == 0) & (place > last - 3))
    return nodes.step(some, all_, "attribute", "no").select("doc_id", F.col("value").cast("int").alias("no"))


@query(f"SELECT l_orderkey AS doc_id, l_returnflag AS flag FROM {LINES} WHERE n > 1")
def axis_following(spark, d):
    all_ = order_nodes(spark, d)
    first = nodes.child_element(nodes.roots(all_), all_, "line")
    return nodes.string_value(all_, nodes.step(first, all_, "following", "flag")).select("doc_id", F.col("text").alias("flag"))


@query(f"SELECT l_orderkey AS doc_id, CAST(l_partkey AS BIGINT) AS part FROM {LINES} WHERE n < m AND n > 1")
def condition_on_siblings(spark, d):
    """line[preceding-sibling::line][following-sibling::line]/@part"""
    all_ = order_nodes(spark, d)
    lines = all_.filter("name = 'line'")
    inner = nodes.where(nodes.where(lines, lines, "following-sibling"), lines, "preceding-sibling")
    return nodes.step(inner, all_, "attribute", "part").select("doc_id", F.col("value").cast("bigint").alias("part"))


@query("SELECT l_orderkey AS doc_id, l_returnflag AS flag FROM lineitem WHERE l_partkey % 10 = 3")
def condition_on_ancestors(spark, d):
    """//flag[ancestor::line[@part mod 10 = 3]]"""
    all_ = order_nodes(spark, d)
    marked = all_.filter((F.col("name") == "part") & (F.col("value").try_cast("bigint") % 10 == 3))
    lines = nodes.where(all_.filter("name = 'line'"), marked, "attribute")
    return nodes.string_value(all_, nodes.where(all_.filter("name = 'flag'"), lines, "ancestor")).select("doc_id", F.col("text").alias("flag"))


@query(f"SELECT l_orderkey AS doc_id, CAST(l_linenumber AS INT) AS no FROM {LINES} WHERE n = 1")
def condition_on_meta(spark, d):
    """line[meta::prevsiblingid = 2]: the line beside the head, which is the third node, after the key."""
    all_ = order_nodes(spark, d)
    first = all_.filter("name = 'line' and prev_sibling = 2 and parent = 0")
    return nodes.step(first, all_, "attribute", "no").select("doc_id", F.col("value").cast("int").alias("no"))


@query("SELECT * FROM (SELECT 'first' AS how, min(l_orderkey) AS doc_id FROM lineitem) UNION ALL SELECT 'last', max(l_orderkey) FROM lineitem")
def document_ends(spark, d):
    """The first and the last document of a collection."""
    roots = nodes.roots(order_nodes(spark, d)).filter("kind = 'element'")
    return reduce(DataFrame.unionAll, [access.retrieve(roots, "doc_id", how=how).select(F.lit(how).alias("how"), "doc_id") for how in ("first", "last")])


@query("SELECT DISTINCT l_orderkey AS doc_id FROM lineitem WHERE CAST(l_quantity AS INT) = 17")
def node_index_to_documents(spark, d):
    """From an index of the texts at qty to their documents."""
    all_ = order_nodes(spark, d)
    keys = index.value_keys(nodes.string_value(all_, all_.filter("name = 'qty'")), "doc_id", F.col("text"))
    found = access.retrieve(keys, "key", "17").select(F.col("drn").alias("doc_id"))
    return access.records_of_keys(found, nodes.roots(all_).filter("kind = 'element'"), "doc_id").select("doc_id")


LINE_XML = "'<line no=\"' || l_linenumber || '\" part=\"' || l_partkey || '\"><qty>' || CAST(l_quantity AS INT) || '</qty><flag>' || l_returnflag || '</flag></line>'"


@query(f"SELECT l_orderkey AS doc_id, '<order key=\"' || l_orderkey || '\"><head/>' || string_agg(CASE WHEN l_returnflag = 'R' THEN '<returned/>' ELSE '' END || {LINE_XML}, '' ORDER BY n) || '<!-- end --></order>' AS xml FROM {LINES} GROUP BY 1")
def insert_nodes(spark, d):
    """An element before each returned line."""
    all_ = order_nodes(spark, d)
    flags = all_.filter("kind = 'text' and value = 'R'")
    lines = nodes.step(nodes.step(flags, all_, "parent", "flag"), all_, "parent", "line")
    return nodes.export_documents(nodes.insert_before(all_, lines, "returned"))


@query(f"SELECT l_orderkey AS doc_id, '<order key=\"' || l_orderkey || '\"><head/>' || string_agg(CASE WHEN l_returnflag = 'R' THEN replace({LINE_XML}, '<line', '<line returned=\"yes\"') ELSE {LINE_XML} END, '' ORDER BY n) || '<!-- end --></order>' AS xml FROM {LINES} GROUP BY 1")
def create_attributes(spark, d):
    """An attribute, and a note that is not written, of each returned line."""
    all_ = order_nodes(spark, d)
    noted = nodes.create_annotation(all_, nodes.roots(all_).filter("kind = 'element'"), "checked")
    flags = nodes.step(noted.filter("kind = 'text' and value = 'R'"), noted, "parent", "flag")
    lines = nodes.where(noted.filter("name = 'line'"), flags, "child")
    return nodes.export_documents(nodes.create_attribute(noted, lines, "returned", "yes"))


@query("SELECT l_orderkey AS doc_id, count(*) FILTER (WHERE l_returnflag <> 'R') AS lines FROM lineitem GROUP BY 1")
def delete_nodes(spark, d):
    """Without the returned lines."""
    all_ = order_nodes(spark, d)
    flags = all_.filter("kind = 'text' and value = 'R'")
    gone = nodes.step(nodes.step(flags, all_, "parent", "flag"), all_, "parent", "line")
    left = nodes.delete_subtrees(all_, gone)
    return left.groupBy("doc_id").agg(F.count_if((F.col("kind") == "element") & (F.col("name") == "line")).alias("lines"))


@query("SELECT DISTINCT l_orderkey AS doc_id FROM lineitem")
def xml_round_trip(spark, d):
    """Documents that come back as they were from the node table."""
    docs = order_documents(spark, d).filter("doc_id IS NOT NULL")  # as the join asks of its side, so that both share one shuffle
    table_ = nodes.import_documents(docs, "doc_id", "xml", nodes.EXPORTED)
    return access.in_both(docs, nodes.export_documents(table_, whole=True)).select("doc_id")
