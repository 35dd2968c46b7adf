"""Queries of the reconciliation engine over derived sources, each with the same question in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tieout.functions.expr import iso_instant, minor, money_minor, signature, signed
from tieout.operators import amounts, chains, dedup, discover, embedded, evaluate, match, profile, report, spine, timing, verify
from tieout.plans import fixtures, runlog
from tieout.plans.fixtures import bank, gateway, ledger, read
from tieout.plans.sqlgate import guarded_select
from tieout.sources.ingest import latest_by, page
from tieout.sources.store import written

RULE_EXACT, RULE_BATCH = "auto_exact__ledger__gateway", "auto_batch__bank__gateway"


class World:
    """The three sources, their two rules, and statuses that follow from group keys."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir = spark, sf_dir
        self.ledger, self.gateway, self.bank = ledger(spark, sf_dir), gateway(spark, sf_dir), bank(spark, sf_dir)
        self.sources = {"ledger": self.ledger, "gateway": self.gateway, "bank": self.bank}

    def exact_members(self) -> DataFrame:
        return match.row_level_members(("ledger", self.ledger, "order_ref", "amount"), ("gateway", self.gateway, "order_ref", "gross_amount"))

    def batch_members(self) -> DataFrame:
        keyed = embedded.publish(self.bank, "narration", self.gateway, "batch_id")
        return match.aggregate_members(("bank", keyed, "batch_id", "credit_amount"), ("gateway", self.gateway, "batch_id", "gross_amount"))

    def both(self) -> tuple[DataFrame, DataFrame]:
        """(proposals with status, members) of both rules."""
        rules = self.exact_members().withColumn("rule", F.lit(RULE_EXACT)).unionByName(self.batch_members().withColumn("rule", F.lit(RULE_BATCH)))
        props, members = match.both_of(rules)
        number = F.regexp_extract("group_key", "([0-9]+)$", 1).cast("bigint")
        status = F.when(number % 101 == 3, "rejected").when(number % 101 == 4, "review_later").when(F.col("confidence") == "exact", "accepted").otherwise("pending")
        return props.withColumn("status", status), members


MEMBERS_SQL = (
    fixtures.SQL
    + """, found AS (
  SELECT b.row_id, min(k.batch_id) AS batch_id FROM bank b JOIN (SELECT DISTINCT batch_id FROM gateway) k ON contains(b.narration, k.batch_id)
  GROUP BY b.row_id HAVING count(DISTINCT k.batch_id) = 1
), members AS (
  SELECT 'auto_exact__ledger__gateway' AS rule, order_ref AS group_key, 'ledger' AS dataset, row_id, CAST(round(amount * 100) AS BIGINT) AS amount_minor
    FROM ledger WHERE order_ref IN (SELECT order_ref FROM gateway)
  UNION ALL SELECT 'auto_exact__ledger__gateway', order_ref, 'gateway', row_id, -CAST(round(gross_amount * 100) AS BIGINT)
    FROM gateway WHERE order_ref IN (SELECT order_ref FROM ledger)
  UNION ALL SELECT 'auto_batch__bank__gateway', f.batch_id, 'bank', b.row_id, CAST(round(credit_amount * 100) AS BIGINT) FROM bank b JOIN found f USING (row_id)
  UNION ALL SELECT 'auto_batch__bank__gateway', batch_id, 'gateway', row_id, -CAST(round(gross_amount * 100) AS BIGINT)
    FROM gateway WHERE batch_id IN (SELECT batch_id FROM found)
), proposals AS (
  SELECT *, CASE WHEN balance_minor = 0 THEN 'exact' ELSE 'unbalanced' END AS confidence FROM (
    SELECT rule, group_key, CAST(count(*) AS BIGINT) AS member_count, CAST(sum(amount_minor) AS BIGINT) AS balance_minor, string_agg(DISTINCT dataset, ',' ORDER BY dataset) AS edge
    FROM members GROUP BY rule, group_key HAVING count(*) >= 2) g
), status AS (
  SELECT *, CASE WHEN n % 101 = 3 THEN 'rejected' WHEN n % 101 = 4 THEN 'review_later' WHEN confidence = 'exact' THEN 'accepted' ELSE 'pending' END AS status
  FROM (SELECT *, CAST(regexp_extract(group_key, '([0-9]+)$', 1) AS BIGINT) AS n FROM proposals) p
)"""
)

_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def query(sql: str, name: str | None = None):
    """Register a query under its function's name, with its SQL; ``{F}`` and ``{M}`` stand for the sources and for rules on top."""

    def add(f):
        key = name or f.__name__
        _QUERIES[key] = f
        _SQL[key] = sql.replace("{F}", fixtures.SQL).replace("{M}", MEMBERS_SQL)
        return f

    return add


# Profiles


def _profile_sql(table: str, columns: list[str]) -> str:
    part = "SELECT '{c}' AS \"column\", count(*) AS n, count({c}) AS non_null, count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS n_distinct, count(DISTINCT {c}) = count({c}) AND count(*) > 0 AS is_unique, CAST(min({c}) AS VARCHAR) AS min_value, CAST(max({c}) AS VARCHAR) AS max_value FROM {t}"
    return " UNION ALL ".join(part.format(c=c, t=table) for c in columns)


ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]


@query(_profile_sql("orders", ORDER_COLUMNS))
def profile_orders(spark, d):
    return profile.profile(read(spark, d, "orders"), ORDER_COLUMNS)


@query(
    """SELECT signature, count(*) AS n FROM (SELECT DISTINCT p_name, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
  regexp_replace(substr(p_name, 1, 40), '[0-9]', '9', 'g'), '[A-Z]', 'A', 'g'), '[a-z]', 'a', 'g'), 'a{3,}', 'aaa', 'g'), 'A{3,}', 'AAA', 'g'), '9{3,}', '999', 'g') AS signature FROM part) GROUP BY signature"""
)
def profile_text_signature(spark, d):
    return profile.pattern(read(spark, d, "part"), "p_name")


@query(
    """WITH s AS (SELECT DISTINCT p_name, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
  regexp_replace(substr(p_name, 1, 40), '[0-9]', '9', 'g'), '[A-Z]', 'A', 'g'), '[a-z]', 'a', 'g'), 'a{3,}', 'aaa', 'g'), 'A{3,}', 'AAA', 'g'), '9{3,}', '999', 'g') AS signature FROM part WHERE p_name IS NOT NULL)
SELECT signature, round(count(*) / (SELECT count(*) FROM s), 6) AS coverage FROM s GROUP BY signature ORDER BY count(*) DESC, signature LIMIT 1"""
)
def profile_dominant_pattern(spark, d):
    return profile.dominant_pattern(read(spark, d, "part"), "p_name")


@query(
    """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS rank FROM (
  SELECT 'event_type' AS "column", event_type AS value, count(*) AS n FROM events WHERE event_type IS NOT NULL GROUP BY event_type
  UNION ALL SELECT 'user_id', CAST(user_id AS VARCHAR), count(*) FROM events WHERE user_id IS NOT NULL GROUP BY user_id)) WHERE rank <= 5"""
)
def top_values_events(spark, d):
    return profile.top_values(read(spark, d, "events"), ["event_type", "user_id"]).withColumn("rank", F.col("rank").cast("bigint"))


@query("SELECT DISTINCT trim(p_brand) AS value FROM part WHERE p_brand IS NOT NULL AND trim(p_brand) <> ''")
def distinct_value_sets(spark, d):
    return profile.distinct_values(read(spark, d, "part"), "p_brand")


@query("SELECT count(order_ref) AS n, count(DISTINCT order_ref) AS n_distinct, round(count(DISTINCT order_ref) / count(order_ref), 6) AS ratio FROM (WITH {F} SELECT * FROM gateway)")
def key_stats(spark, d):
    return profile.key_stats(gateway(spark, d), "order_ref")


@query("WITH {F} SELECT count(*) AS n, count(DISTINCT batch_id) AS n_distinct, CAST(min(length(batch_id)) AS INTEGER) AS min_length, bool_and(regexp_matches(batch_id, '^[0-9]*$')) AS all_digits FROM gateway")
def embedded_key_stats(spark, d):
    return profile.text_key_stats(gateway(spark, d), "batch_id")


# Discovery

_CELLS = {"ledger": ["order_ref", "amount", "currency", "posted_s"], "gateway": ["txn_id", "order_ref", "gross_amount", "currency", "batch_id", "captured_s"], "bank": ["narration", "credit_amount", "currency", "value_s"]}
_LONG_SQL = " UNION ALL ".join(f"SELECT '{t}' AS ds, {i} AS ord, '{c}' AS col, trim(CAST({c} AS VARCHAR)) AS v FROM {t} WHERE {c} IS NOT NULL" for t, cs in _CELLS.items() for i, c in enumerate(cs))
VALUES_SQL = f"""{{F}}, vals AS (SELECT ds, ord, col, v, count(*) AS n FROM ({_LONG_SQL}) WHERE v <> '' GROUP BY ALL),
stats AS (SELECT ds, ord, col, count(*) AS nd, sum(n) AS nr, count(*) <= 12 AND sum(n) > 2 * count(*) AS enum_like FROM vals GROUP BY ds, ord, col),
known AS (SELECT vals.*, nd, enum_like FROM vals JOIN stats USING (ds, ord, col) WHERE nd >= 2),
pairs AS (SELECT l.ds AS left_dataset, l.col AS left_column, r.ds AS right_dataset, r.col AS right_column, l.ord AS lo, r.ord AS ro, l.nd AS ln, r.nd AS rn, count(*) AS shared
  FROM known l JOIN known r ON l.v = r.v AND l.ds < r.ds AND NOT (l.enum_like AND r.enum_like) GROUP BY ALL),
overlap AS (SELECT left_dataset, left_column, right_dataset, right_column, shared, round(shared / ln, 3) AS left_coverage, round(shared / rn, 3) AS right_coverage,
  round(shared / (ln + rn - shared), 3) AS jaccard, lo AS left_ordinal, ro AS right_ordinal FROM pairs WHERE greatest(shared / ln, shared / rn) >= 0.25)"""


def _values(spark, d):
    return discover.column_values(World(spark, d).sources)


@query(f"WITH {VALUES_SQL} SELECT * FROM overlap")
def overlap_matrix(spark, d):
    return discover.overlap_matrix(_values(spark, d), None)


@query(f"WITH {VALUES_SQL} SELECT ds AS dataset, col AS \"column\", nd AS n_distinct, CAST(nr AS BIGINT) AS n_rows, enum_like FROM stats")
def enum_pair_screen(spark, d):
    return discover.column_stats(_values(spark, d)).select("dataset", "column", "n_distinct", "n_rows", "enum_like")


@query(f"WITH {VALUES_SQL} SELECT ds AS dataset, col AS \"column\" FROM stats WHERE NOT enum_like")
def identifier_columns(spark, d):
    return discover.identifier_columns(_values(spark, d))


_TEXT = {"ledger": ["order_ref", "currency"], "gateway": ["txn_id", "order_ref", "currency", "batch_id"], "bank": ["narration", "currency"]}


@query(
    f"""WITH {VALUES_SQL} SELECT left_dataset, left_column, right_dataset, right_column, shared FROM overlap
  WHERE greatest(left_coverage, right_coverage) >= 0.5 AND left_column IN ('order_ref', 'currency', 'txn_id', 'batch_id', 'narration') AND right_column IN ('order_ref', 'currency', 'txn_id', 'batch_id', 'narration')"""
)
def usable_pairs(spark, d):
    return discover.usable_pairs(discover.overlap_matrix(_values(spark, d), None), _TEXT).select("left_dataset", "left_column", "right_dataset", "right_column", "shared")


@query(
    f"""WITH {VALUES_SQL} SELECT left_dataset, left_column, right_dataset, right_column FROM overlap QUALIFY row_number() OVER (PARTITION BY left_dataset, right_dataset
  ORDER BY greatest(left_coverage, right_coverage) DESC, shared DESC, left_ordinal, right_ordinal) = 1"""
)
def strongest_keys(spark, d):
    return discover.strongest_keys(discover.overlap_matrix(_values(spark, d), None)).select("left_dataset", "left_column", "right_dataset", "right_column")


def _index(spark, d):
    w = World(spark, d)
    return profile.long_values({"ledger": w.ledger, "gateway": w.gateway}, {"ledger": ["order_ref"], "gateway": ["txn_id", "order_ref", "batch_id"]})


_INDEX_SQL = """{F}, idx AS (SELECT 'ledger' AS ds, row_id, 'order_ref' AS col, order_ref AS v FROM ledger UNION ALL SELECT 'gateway', row_id, 'txn_id', txn_id FROM gateway
  UNION ALL SELECT 'gateway', row_id, 'order_ref', order_ref FROM gateway UNION ALL SELECT 'gateway', row_id, 'batch_id', batch_id FROM gateway),
h0 AS (SELECT DISTINCT ds, row_id, 0 AS hop FROM (SELECT *, row_number() OVER (PARTITION BY ds, col ORDER BY row_id) AS nth FROM idx WHERE v = 'ORD-1000027') WHERE nth <= 5)"""


@query(f"WITH {_INDEX_SQL} SELECT ds AS dataset, row_id, hop FROM h0")
def trace_hop0(spark, d):
    return discover.trace(_index(spark, d), "ORD-1000027", 0, max_hits=None).select("dataset", "row_id", "hop")


@query(
    f"""WITH {_INDEX_SQL}, t1 AS (SELECT DISTINCT v FROM idx JOIN h0 USING (ds, row_id) WHERE length(v) BETWEEN 3 AND 64 AND v <> 'ORD-1000027' AND NOT contains(v, ' ')),
ok1 AS (SELECT i.v, i.ds, i.col FROM idx i JOIN t1 USING (v) GROUP BY ALL HAVING count(*) <= 4),
h1 AS (SELECT DISTINCT i.ds, i.row_id, 1 AS hop FROM idx i JOIN ok1 USING (v, ds, col) WHERE NOT EXISTS (SELECT 1 FROM h0 WHERE h0.ds = i.ds AND h0.row_id = i.row_id)),
t2 AS (SELECT DISTINCT v FROM idx JOIN h1 USING (ds, row_id) WHERE length(v) BETWEEN 3 AND 64 AND v <> 'ORD-1000027' AND NOT contains(v, ' ') AND v NOT IN (SELECT v FROM t1)),
ok2 AS (SELECT i.v, i.ds, i.col FROM idx i JOIN t2 USING (v) GROUP BY ALL HAVING count(*) <= 4),
h2 AS (SELECT DISTINCT i.ds, i.row_id, 2 AS hop FROM idx i JOIN ok2 USING (v, ds, col) WHERE NOT EXISTS (SELECT 1 FROM (SELECT * FROM h0 UNION ALL SELECT * FROM h1) h WHERE h.ds = i.ds AND h.row_id = i.row_id))
SELECT ds AS dataset, row_id, hop FROM (SELECT * FROM h0 UNION ALL SELECT * FROM h1 UNION ALL SELECT * FROM h2)"""
)
def trace_hops(spark, d):
    return discover.trace(_index(spark, d), "ORD-1000027", 2, max_hits=None).select("dataset", "row_id", "hop")


# Shapes and amounts


@query("WITH {F} SELECT count(order_ref) AS n_keys, count(DISTINCT order_ref) AS n_distinct, round(count(DISTINCT order_ref) / count(order_ref), 6) AS ratio, count(DISTINCT order_ref) / count(order_ref) >= 0.98 AS is_unique FROM gateway")
def side_uniqueness(spark, d):
    return amounts.side_stats(gateway(spark, d), "order_ref")


@query(
    """WITH {F}, r AS (SELECT 'ledger-gateway' AS pair, (SELECT count(DISTINCT order_ref) / count(order_ref) FROM ledger) AS l, (SELECT count(DISTINCT order_ref) / count(order_ref) FROM gateway) AS r
  UNION ALL SELECT 'orders-lineitem', (SELECT count(DISTINCT o_orderkey) / count(o_orderkey) FROM orders), (SELECT count(DISTINCT l_orderkey) / count(l_orderkey) FROM lineitem)
  UNION ALL SELECT 'lineitem-part', (SELECT count(DISTINCT l_partkey) / count(l_partkey) FROM lineitem), (SELECT count(DISTINCT l_partkey) / count(l_partkey) FROM lineitem)),
s AS (SELECT *, l >= 0.98 OR (l >= 0.5 AND l >= 1.5 * r) AS lo, r >= 0.98 OR (r >= 0.5 AND r >= 1.5 * l) AS ro FROM r)
SELECT pair, round(l, 6) AS left_ratio, round(r, 6) AS right_ratio, CASE WHEN lo AND ro THEN '1:1' WHEN lo THEN '1:N' WHEN ro THEN 'N:1' ELSE 'N:M' END AS shape FROM s"""
)
def shape_classification(spark, d):
    o, li = read(spark, d, "orders"), read(spark, d, "lineitem")
    return (
        amounts.classify(ledger(spark, d), "order_ref", gateway(spark, d), "order_ref").withColumn("pair", F.lit("ledger-gateway"))
        .unionByName(amounts.classify(o, "o_orderkey", li, "l_orderkey").withColumn("pair", F.lit("orders-lineitem")))
        .unionByName(amounts.classify(li, "l_partkey", li, "l_partkey").withColumn("pair", F.lit("lineitem-part")))
    )


@query("WITH {F} SELECT row_id, coalesce(CASE WHEN row_id % 2 = 0 THEN amount END, 0) - coalesce(CASE WHEN row_id % 2 = 1 THEN amount END, 0) AS signed_amount FROM ledger")
def signed_amount(spark, d):
    l = ledger(spark, d)
    credit, debit = F.when(F.col("row_id") % 2 == 0, F.col("amount")), F.when(F.col("row_id") % 2 == 1, F.col("amount"))
    return l.select("row_id", signed(credit, debit).cast("decimal(18,2)").alias("signed_amount"))


@query("SELECT o_orderkey, CAST(round(coalesce(o_totalprice, 0) * 100) AS BIGINT) AS minor_units FROM orders")
def minor_units(spark, d):
    return read(spark, d, "orders").select("o_orderkey", minor(F.col("o_totalprice")).alias("minor_units"))


@query(
    """WITH t AS (SELECT CAST(o_orderkey AS VARCHAR) AS a, CASE WHEN o_orderkey % 7 = 0 THEN 'n/a' ELSE CAST(o_custkey AS VARCHAR) END AS b, o_orderpriority AS c FROM orders),
u AS (SELECT 'a' AS "column", a AS v FROM t UNION ALL SELECT 'b', b FROM t UNION ALL SELECT 'c', c FROM t)
SELECT "column", count(*) AS n, count(*) FILTER (regexp_matches(trim(v), '^[0-9.eE+-]+$')) AS numeric_n, round(count(*) FILTER (regexp_matches(trim(v), '^[0-9.eE+-]+$')) / count(*), 6) AS ratio,
  count(*) >= 3 AND count(*) FILTER (regexp_matches(trim(v), '^[0-9.eE+-]+$')) / count(*) >= 0.8 AS usable FROM u WHERE v IS NOT NULL GROUP BY "column\""""
)
def numeric_text_ratio(spark, d):
    o = read(spark, d, "orders")
    t = o.select(F.col("o_orderkey").cast("string").alias("a"), F.when(F.col("o_orderkey") % 7 == 0, "n/a").otherwise(F.col("o_custkey").cast("string")).alias("b"), F.col("o_orderpriority").alias("c"))
    return amounts.numeric_text_ratios(t, ["a", "b", "c"])


_PROBE = """count(*) FILTER (x IS NOT NULL AND y IS NOT NULL AND abs(x) >= 0.005) AS n_both, count(*) FILTER (abs(x) >= 0.005 AND abs(x - y) < 0.005) AS n_exact,
  count(DISTINCT CASE WHEN abs(x) >= 0.005 AND abs(x - y) < 0.005 THEN round(x, 2) END) AS spread, count(*) AS joined"""


@query(
    f"""WITH {{F}}, j AS (SELECT CAST(l.amount AS DOUBLE) AS a, CAST(l.posted_s AS DOUBLE) AS p, CAST(g.gross_amount AS DOUBLE) AS g, CAST(g.captured_s AS DOUBLE) AS c FROM ledger l JOIN gateway g USING (order_ref)),
u AS (SELECT 'amount' AS left_amount, 'gross_amount' AS right_amount, a AS x, g AS y FROM j UNION ALL SELECT 'amount', 'captured_s', a, c FROM j UNION ALL SELECT 'posted_s', 'gross_amount', p, g FROM j UNION ALL SELECT 'posted_s', 'captured_s', p, c FROM j),
s AS (SELECT left_amount, right_amount, {_PROBE} FROM u GROUP BY left_amount, right_amount)
SELECT *, round(n_exact / joined, 6) AS agreement, n_both >= 3 AND spread >= 2 AND n_exact / joined >= 0.6 AS passed FROM s"""
)
def amount_probe_scores(spark, d):
    return amounts.scored(amounts.row_probes(ledger(spark, d), "order_ref", ["amount", "posted_s"], gateway(spark, d), "order_ref", ["gross_amount", "captured_s"]))


@query(
    """WITH {M}, s AS (SELECT batch_id, CAST(sum(gross_amount) AS DOUBLE) AS m FROM gateway GROUP BY batch_id), j AS (SELECT CAST(credit_amount AS DOUBLE) AS o, m FROM bank JOIN found USING (row_id) JOIN s USING (batch_id))
SELECT 'credit_amount' AS one_amount, 'gross_amount' AS many_amount, count(*) FILTER (abs(o) >= 0.005) AS n_live, count(*) FILTER (abs(o) >= 0.005 AND abs(o - m) < 0.005) AS n_exact,
  count(*) FILTER (abs(o) >= 0.005 AND abs(o - m) <= 1.0) AS n_near, round(coalesce(max(CASE WHEN abs(o) >= 0.005 AND abs(o - m) <= 1.0 THEN abs(o - m) END), 0.0), 4) AS worst,
  count(DISTINCT CASE WHEN abs(o) >= 0.005 AND abs(o - m) <= 1.0 THEN round(o, 2) END) AS spread, count(*) AS joined FROM j"""
)
def aggregate_probe_scores(spark, d):
    w = World(spark, d)
    keyed = embedded.publish(w.bank, "narration", w.gateway, "batch_id")
    return amounts.aggregate_probes(keyed, "batch_id", ["credit_amount"], w.gateway, "batch_id", ["gross_amount"])


@query(
    f"""WITH {{F}}, p AS (SELECT o_orderpriority AS pv, order_ref, CAST(gross_amount AS DOUBLE) AS g FROM gateway JOIN orders ON order_ref = concat('ORD-', CAST(1000000 + o_orderkey AS VARCHAR))),
k AS (SELECT pv, count(*) AS n FROM p GROUP BY pv), u AS (SELECT pv, CAST(l.amount AS DOUBLE) AS x, g AS y FROM ledger l JOIN p USING (order_ref) WHERE pv IN (SELECT pv FROM k WHERE n >= 3) AND (SELECT count(*) FROM k) BETWEEN 2 AND 12)
SELECT 'priority' AS part_column, pv AS part_value, 'amount' AS left_amount, 'gross_amount' AS right_amount, {_PROBE} FROM u GROUP BY pv"""
)
def match_partitioned(spark, d):
    o = read(spark, d, "orders").select(F.concat(F.lit("ORD-"), (F.lit(1000000) + F.col("o_orderkey")).cast("string")).alias("order_ref"), F.col("o_orderpriority").alias("priority"))
    many = gateway(spark, d).join(o, "order_ref")
    return amounts.partitioned_probes(ledger(spark, d), "order_ref", ["amount"], many, "order_ref", ["gross_amount"], ["priority"])


# Duplicates


@query("SELECT doc_id AS row_id, first_id AS dup_of FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text, lang, source, n_chars) AS first_id FROM documents) WHERE doc_id <> first_id")
def dup_exact_documents(spark, d):
    df = read(spark, d, "documents").withColumnRenamed("doc_id", "row_id")
    return dedup.exact_marks(df, ["text", "lang", "source", "n_chars"])


@query("SELECT doc_id AS row_id, first_id AS dup_of FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text, lang, source, n_chars) AS first_id FROM documents) WHERE doc_id <> first_id")
def dup_near_documents(spark, d):
    df = read(spark, d, "documents")
    return dedup.near_marks(df.withColumn("row_id", F.col("doc_id")), ["doc_id", "text", "lang", "source", "n_chars"])


@query("WITH {F} SELECT row_id, first_id AS dup_of FROM (SELECT row_id, min(row_id) OVER (PARTITION BY order_ref, gross_amount, currency, batch_id) AS first_id FROM gateway) WHERE row_id <> first_id")
def dup_near_gateway(spark, d):
    return dedup.near_marks(gateway(spark, d))


@query("WITH {F} SELECT count(*) AS n FROM (SELECT DISTINCT order_ref, gross_amount, currency, batch_id FROM gateway)")
def dup_policy_filter(spark, d):
    return dedup.without_duplicates(dedup.mark_duplicates(gateway(spark, d))).agg(F.count("*").alias("n"))


@query(
    """WITH {F}, dup AS (SELECT row_id, first_id, order_ref FROM (SELECT row_id, order_ref, min(row_id) OVER (PARTITION BY order_ref, gross_amount, currency, batch_id) AS first_id FROM gateway) WHERE row_id <> first_id)
SELECT 'near' AS dup_kind, row_id, first_id AS dup_of, order_ref FROM dup ORDER BY row_id LIMIT 3"""
)
def dup_examples(spark, d):
    return dedup.duplicate_examples(dedup.mark_duplicates(gateway(spark, d)), ["order_ref"])


# Embedded keys


@query("SELECT d.doc_id AS row_id, count(DISTINCT b.text) AS n_keys FROM documents d JOIN benchmark b ON contains(d.text, trim(b.text)) WHERE trim(b.text) <> '' GROUP BY d.doc_id")
def embedded_containment(spark, d):
    return embedded.contained_keys(read(spark, d, "documents"), "text", read(spark, d, "benchmark"), "text", "doc_id").select("row_id", "n_keys")


@query("WITH {M} SELECT row_id, batch_id FROM bank LEFT JOIN found USING (row_id)")
def embedded_published_key(spark, d):
    return embedded.publish(bank(spark, d), "narration", gateway(spark, d), "batch_id").select("row_id", "batch_id")


@query("WITH {F}, v AS (SELECT DISTINCT trim(narration) AS v FROM bank) SELECT count(*) FILTER (v IN (SELECT batch_id FROM gateway)) AS shared, count(*) AS total FROM v")
def literal_overlap(spark, d):
    return embedded.literal_overlap(bank(spark, d), "narration", gateway(spark, d), "batch_id")


@query(
    """WITH {F}, held AS (SELECT b.row_id, count(DISTINCT k.batch_id) AS n_keys FROM bank b JOIN (SELECT DISTINCT batch_id FROM gateway) k ON contains(b.narration, k.batch_id) GROUP BY b.row_id)
SELECT (SELECT count(*) FROM bank) AS n_rows, count(*) FILTER (n_keys = 1) AS resolved, count(*) FILTER (n_keys > 1) AS ambiguous, round(count(*) FILTER (n_keys = 1) / (SELECT count(*) FROM bank), 6) AS coverage FROM held"""
)
def embedded_measure(spark, d):
    return embedded.containment(bank(spark, d), "narration", gateway(spark, d), "batch_id")


@query(
    """WITH {F}, t AS (SELECT 'bank' AS carrier, 'narration' AS text, row_id, narration AS v FROM bank UNION ALL SELECT 'orders', 'o_comment', o_orderkey, concat('for ', CAST(200000 + o_orderkey // 10 AS VARCHAR), ' and ORD-', CAST(1000000 + o_orderkey AS VARCHAR), ' or ORD-', CAST(1000001 + o_orderkey - o_orderkey % 3 AS VARCHAR)) FROM orders),
k AS (SELECT DISTINCT 'gateway' AS key_dataset, 'batch_id' AS key, batch_id AS v FROM gateway UNION SELECT 'gateway', 'order_ref', order_ref FROM gateway UNION SELECT 'ledger', 'order_ref', order_ref FROM ledger),
cut AS (SELECT carrier, text, row_id, unnest(regexp_extract_all(v, '(BATCH-[0-9]{6}|ORD-[0-9]{7})')) AS v FROM t),
held AS (SELECT carrier, text, row_id, key_dataset, key, count(DISTINCT v) AS n FROM cut JOIN k USING (v) GROUP BY ALL), n AS (SELECT carrier, count(*) AS n_rows FROM t GROUP BY carrier)
SELECT carrier, text, key_dataset, key, n_rows, count(*) FILTER (n = 1) AS resolved, count(*) FILTER (n > 1) AS ambiguous, round(count(*) FILTER (n = 1) / any_value(n_rows), 6) AS coverage FROM held JOIN n USING (carrier) GROUP BY carrier, text, key_dataset, key, n_rows"""
)
def embedded_search(spark, d):
    w = World(spark, d)
    k = F.col("o_orderkey")
    words = F.concat(F.lit("for "), (F.lit(200000) + F.expr("o_orderkey div 10")).cast("string"), F.lit(" and ORD-"), (F.lit(1000000) + k).cast("string"), F.lit(" or ORD-"), (F.lit(1000001) + k - k % 3).cast("string"))
    sources = w.sources | {"orders": read(spark, d, "orders").select(k.alias("row_id"), words.alias("o_comment"))}
    return embedded.search(sources, {"bank": ["narration"], "orders": ["o_comment"]}, {"gateway": ["batch_id", "order_ref", "currency"], "ledger": ["order_ref"]})


# Matching


@query("WITH {M} SELECT group_key, member_count, balance_minor, confidence FROM proposals WHERE rule = 'auto_exact__ledger__gateway'")
def match_row_level(spark, d):
    return match.proposals(World(spark, d).exact_members(), RULE_EXACT).select("group_key", "member_count", "balance_minor", "confidence")


@query("WITH {M} SELECT group_key, member_count, balance_minor, confidence FROM proposals WHERE rule = 'auto_batch__bank__gateway'")
def match_aggregate(spark, d):
    return match.proposals(World(spark, d).batch_members(), RULE_BATCH).select("group_key", "member_count", "balance_minor", "confidence")


@query("WITH {M} SELECT rule, confidence, count(*) AS n, CAST(sum(abs(balance_minor)) AS BIGINT) AS residual FROM proposals GROUP BY rule, confidence")
def group_confidence(spark, d):
    props, _ = World(spark, d).both()
    return props.groupBy("rule", "confidence").agg(F.count("*").alias("n"), F.sum(F.abs("balance_minor")).cast("bigint").alias("residual"))


@query("SELECT 'lineitem' AS dataset, l_partkey AS row_id, count(DISTINCT l_orderkey) AS n_groups FROM lineitem GROUP BY l_partkey HAVING count(DISTINCT l_orderkey) > 1")
def contested_rows(spark, d):
    m = read(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("group_key"), F.lit("lineitem").alias("dataset"), F.col("l_partkey").alias("row_id"))
    return match.contested_rows(m)


@query(
    """WITH {M}, claims AS (SELECT edge, dataset, row_id FROM members JOIN status USING (rule, group_key) WHERE status = 'accepted')
SELECT p.rule, p.group_key, CASE WHEN p.status <> 'rejected' THEN 'existing_key' ELSE 'claimed' END AS reason FROM status p
WHERE p.status <> 'rejected' OR EXISTS (SELECT 1 FROM members m JOIN claims c ON c.dataset = m.dataset AND c.row_id = m.row_id WHERE m.rule = p.rule AND m.group_key = p.group_key AND c.edge = p.edge)"""
)
def claims_skip(spark, d):
    props, members = World(spark, d).both()
    reasons = match.skip_reasons(props.drop("status"), members, props, match.claimed(props, members))
    return reasons.join(props, "proposal_id").select("rule", "group_key", "reason")


@query(
    """WITH {M}, rejected AS (SELECT DISTINCT edge, dataset, row_id FROM members JOIN status USING (rule, group_key) WHERE status = 'rejected')
SELECT DISTINCT p.rule, p.group_key FROM status p JOIN members m USING (rule, group_key) JOIN rejected r ON r.edge = p.edge AND r.dataset = m.dataset AND r.row_id = m.row_id"""
)
def rejected_hold(spark, d):
    props, members = World(spark, d).both()
    held = match.held_back(props, members, match.claimed(props, members, "rejected"))
    return held.join(props, "proposal_id").select("rule", "group_key")


@query("WITH {M} SELECT row_id FROM ledger WHERE row_id NOT IN (SELECT row_id FROM members JOIN status USING (rule, group_key) WHERE dataset = 'ledger' AND status = 'accepted')")
def unmatched_rows(spark, d):
    w = World(spark, d)
    props, members = w.both()
    accepted = members.join(props.where("status = 'accepted'").select("proposal_id"), "proposal_id", "left_semi")
    return match.unmatched(w.ledger, "ledger", accepted).select("row_id")


@query("WITH {M} SELECT row_id FROM ledger WHERE row_id NOT IN (SELECT row_id FROM members JOIN status USING (rule, group_key) WHERE dataset = 'ledger' AND status <> 'rejected')")
def unattached_rows(spark, d):
    w = World(spark, d)
    props, members = w.both()
    held = members.join(props.where("status <> 'rejected'").select("proposal_id"), "proposal_id", "left_semi")
    return match.unmatched(w.ledger, "ledger", held).select("row_id")


@query(
    """WITH {M}, held AS (SELECT row_id FROM members JOIN status USING (rule, group_key) WHERE dataset = 'gateway' AND status = 'accepted' AND list_contains(string_split(edge, ','), 'bank'))
SELECT row_id, txn_id FROM gateway WHERE row_id NOT IN (SELECT row_id FROM held)"""
)
def unmatched_counterpart(spark, d):
    w = World(spark, d)
    props, members = w.both()
    accepted = props.where("status = 'accepted'")
    held = match.against(members.join(accepted.select("proposal_id"), "proposal_id", "left_semi"), accepted, "gateway", "bank")
    return match.unmatched(w.gateway, "gateway", held).select("row_id", "txn_id")


@query(
    """WITH {M}, dup AS (SELECT row_id, first_id FROM (SELECT row_id, min(row_id) OVER (PARTITION BY order_ref, gross_amount, currency, batch_id) AS first_id FROM gateway) WHERE row_id <> first_id),
m AS (SELECT m.*, d.first_id FROM members m LEFT JOIN dup d ON m.dataset = 'gateway' AND d.row_id = m.row_id WHERE rule = 'auto_exact__ledger__gateway')
SELECT group_key, CAST(sum(CASE WHEN first_id IS NOT NULL THEN amount_minor ELSE 0 END) AS BIGINT) AS duplicate_minor, CAST(sum(amount_minor) AS BIGINT) AS balance_minor,
  CAST(sum(amount_minor) - sum(CASE WHEN first_id IS NOT NULL THEN amount_minor ELSE 0 END) AS BIGINT) AS balance_without FROM m GROUP BY group_key HAVING count(first_id) > 0"""
)
def duplicate_note(spark, d):
    w = World(spark, d)
    marks = dedup.near_marks(w.gateway).select(F.lit("gateway").alias("dataset"), "row_id", "dup_of")
    return match.duplicate_note(match.duplicate_members(match.collapsed(w.exact_members()), marks))


@query("WITH {M} SELECT rule, CAST(count(*) AS BIGINT) AS total, count(*) FILTER (status = 'pending') AS pending FROM status GROUP BY rule")
def rule_counts(spark, d):
    props, _ = World(spark, d).both()
    return props.groupBy("rule").agg(F.count("*").alias("total"), F.count_if(F.col("status") == "pending").alias("pending"))


@query("""SELECT o_orderkey AS proposal_id, json_extract_string('{"reason": "' || o_orderpriority || '", "by": "' || o_orderstatus || '"}', '$.reason') AS reason FROM orders""")
def decision_reasons(spark, d):
    detail = F.concat(F.lit('{"reason": "'), "o_orderpriority", F.lit('", "by": "'), "o_orderstatus", F.lit('"}'))
    events = read(spark, d, "orders").select(F.col("o_orderkey").alias("proposal_id"), detail.alias("detail"))
    return report.detail_field(events, "reason").select("proposal_id", "reason")


@query("WITH {F} SELECT row_id, narration FROM bank WHERE narration LIKE '%7%'")
def narration_like(spark, d):
    return World(spark, d).bank.where(F.col("narration").like("%7%")).select("row_id", "narration")


@query(
    """WITH {M}, dup AS (SELECT row_id, first_id FROM (SELECT row_id, min(row_id) OVER (PARTITION BY order_ref, gross_amount, currency, batch_id) AS first_id FROM gateway) WHERE row_id <> first_id),
m AS (SELECT m.*, d.first_id FROM members m LEFT JOIN dup d ON m.dataset = 'gateway' AND d.row_id = m.row_id WHERE rule = 'auto_exact__ledger__gateway')
SELECT group_key, abs(sum(amount_minor) - sum(CASE WHEN first_id IS NOT NULL THEN amount_minor ELSE 0 END)) <= 0 AS explains_residual FROM m GROUP BY group_key HAVING count(first_id) > 0"""
)
def duplicate_explains(spark, d):
    w = World(spark, d)
    marks = dedup.near_marks(w.gateway).select(F.lit("gateway").alias("dataset"), "row_id", "dup_of")
    own = w.exact_members()
    note = match.duplicate_note(match.duplicate_members(match.collapsed(own), marks))
    return match.explained(note, match.proposals(own, RULE_EXACT)).select("group_key", "explains_residual")


# Verification and timing


@query(
    """WITH {M}, source AS (SELECT 'ledger' AS dataset, row_id FROM ledger UNION ALL SELECT 'gateway', row_id FROM gateway UNION ALL SELECT 'bank', row_id FROM bank)
SELECT m.dataset, count(*) AS n, count(s.row_id) AS resolved FROM members m LEFT JOIN source s ON s.dataset = m.dataset AND s.row_id = m.row_id GROUP BY m.dataset"""
)
def verify_resolve(spark, d):
    w = World(spark, d)
    _, members = w.both()
    return verify.resolve(members, w.sources).groupBy("dataset").agg(F.count("*").alias("n"), F.count_if("resolved").alias("resolved"))


@query("WITH {M} SELECT rule, group_key, count(DISTINCT dataset) >= 2 AS spans FROM members GROUP BY rule, group_key")
def verify_span(spark, d):
    props, members = World(spark, d).both()
    g = members.groupBy("proposal_id").agg((F.count_distinct("dataset") >= 2).alias("spans"))
    return g.join(props, "proposal_id").select("rule", "group_key", "spans")


#: What a row's cells can say: each money-like cell, whole numbers as they stand, and sums and differences of two.
CELLS_SQL = """cell AS (SELECT 'ledger' AS dataset, row_id, unnest([-100 * CAST(substr(order_ref, 5) AS BIGINT), CAST(amount * 100 AS BIGINT), 100 * posted_s]) AS m, unnest([1, 2, 3]) AS i FROM ledger
  UNION ALL SELECT 'gateway', row_id, unnest([-100 * CAST(substr(txn_id, 5) AS BIGINT), -100 * CAST(substr(order_ref, 5) AS BIGINT), CAST(gross_amount * 100 AS BIGINT), -100 * CAST(substr(batch_id, 7) AS BIGINT), 100 * captured_s]), unnest([1, 2, 3, 4, 5]) FROM gateway
  UNION ALL SELECT 'bank', row_id, unnest([CAST(credit_amount * 100 AS BIGINT), 100 * value_s]), unnest([1, 2]) FROM bank),
sayable AS (SELECT dataset, row_id, abs(m) AS v FROM cell UNION SELECT 'ledger', row_id, posted_s FROM ledger UNION SELECT 'gateway', row_id, captured_s FROM gateway UNION SELECT 'bank', row_id, value_s FROM bank
  UNION SELECT a.dataset, a.row_id, unnest([abs(a.m - b.m), abs(a.m + b.m)]) FROM cell a JOIN cell b ON a.dataset = b.dataset AND a.row_id = b.row_id AND a.i <> b.i)"""


@query(
    f"""WITH {{M}}, {CELLS_SQL}
SELECT m.dataset, count(*) AS n, count(y.v) FILTER (amount_minor <> 0) AS n_traced FROM members m LEFT JOIN sayable y ON y.dataset = m.dataset AND y.row_id = m.row_id AND y.v = abs(amount_minor) GROUP BY m.dataset"""
)
def verify_amount_trace(spark, d):
    w = World(spark, d)
    _, members = w.both()
    return verify.traced(members, verify.source_cells(w.sources)).groupBy("dataset").agg(F.count("*").alias("n"), F.count("traced_by").alias("n_traced"))


@query("WITH {M} SELECT rule, group_key, balance_minor, confidence, CASE WHEN confidence = 'exact' THEN balance_minor = 0 END AS holds FROM proposals")
def verify_balance(spark, d):
    props, members = World(spark, d).both()
    now = members.groupBy("proposal_id").agg(F.sum("amount_minor").cast("bigint").alias("now"))
    claim = F.col("confidence").isin("exact", "within_tolerance")
    return props.join(now, "proposal_id").select("rule", "group_key", F.col("now").alias("balance_minor"), "confidence", F.when(claim, F.abs("now") <= F.col("tolerance_minor")).alias("holds"))


@query(
    """WITH {M}, again AS (SELECT *, 'again' AS by FROM members WHERE rule = 'auto_exact__ledger__gateway')
SELECT m.group_key, count(*) AS n_clashes FROM again m JOIN status s USING (rule, group_key) WHERE s.status = 'accepted' GROUP BY m.group_key"""
)
def verify_claim_clash(spark, d):
    w = World(spark, d)
    props, members = w.both()
    own = w.exact_members()
    again = match.proposals(own, "again")
    found = verify.clashes(again, members.unionByName(match.members_of(again, own)), props)
    return found.join(again, "proposal_id").select("group_key", "n_clashes")


@query(
    """WITH {M}, c AS (SELECT 'ledger' AS dataset, row_id, currency FROM ledger UNION ALL SELECT 'gateway', row_id, currency FROM gateway UNION ALL SELECT 'bank', row_id, currency FROM bank)
SELECT rule, group_key, count(currency) AS n_with_currency, count(DISTINCT currency) AS n_currencies FROM members JOIN c USING (dataset, row_id) GROUP BY rule, group_key"""
)
def verify_currency(spark, d):
    w = World(spark, d)
    props, members = w.both()
    found = verify.currencies(members, w.sources, {n: verify.currency_column(s) for n, s in w.sources.items()})
    return found.join(props, "proposal_id").select("rule", "group_key", "n_with_currency", "n_currencies")


@query(
    """WITH {M}, v AS (SELECT 'ledger' AS dataset, order_ref AS group_key, count(*) AS n_visible FROM ledger GROUP BY order_ref UNION ALL SELECT 'gateway', order_ref, count(*) FROM gateway GROUP BY order_ref),
t AS (SELECT dataset, group_key, count(*) AS n_taken FROM members WHERE rule = 'auto_exact__ledger__gateway' AND NOT (dataset = 'gateway' AND row_id % 2 = 0) GROUP BY dataset, group_key)
SELECT group_key, CAST(sum(n_taken) AS BIGINT) AS n_taken, CAST(sum(n_visible) AS BIGINT) AS n_visible, CAST(sum(greatest(n_visible - n_taken, 0)) AS BIGINT) AS n_left FROM t JOIN v USING (dataset, group_key) GROUP BY group_key"""
)
def verify_residual_evidence(spark, d):
    """Groups whose second captures were left out of them have a row left."""
    w = World(spark, d)
    own = w.exact_members()
    props = match.proposals(own, RULE_EXACT)
    pop = [tuple(r) for r in verify.population_columns(props, {"ledger": w.ledger, "gateway": w.gateway}).collect()]
    taken = match.members_of(props, own).where(~((F.col("dataset") == "gateway") & (F.col("row_id") % 2 == 0)))
    found = verify.residual_evidence(props, taken, w.sources, pop)
    return found.join(props, "proposal_id").select("group_key", "n_taken", "n_visible", "n_left")


def _instants(spark, d):
    w = World(spark, d)
    return _spans_of(w, *w.both())


def _spans_of(w, props, members):
    when = w.gateway.select(F.lit("gateway").alias("dataset"), "row_id", F.col("captured_s").alias("instant_s")).unionByName(w.bank.select(F.lit("bank").alias("dataset"), "row_id", F.col("value_s").alias("instant_s")))
    own = members.join(props.where(F.col("rule") == RULE_BATCH).select("proposal_id", "rule"), "proposal_id")
    return own.join(when, ["dataset", "row_id"]).select("rule", "group_key", "instant_s")


SPANS_SQL = """{M}, t AS (SELECT 'gateway' AS dataset, row_id, captured_s AS s FROM gateway UNION ALL SELECT 'bank', row_id, value_s FROM bank),
spans AS (SELECT rule, group_key, max(s) - min(s) AS span_s FROM members JOIN t USING (dataset, row_id) WHERE rule = 'auto_batch__bank__gateway' GROUP BY rule, group_key HAVING count(*) >= 2),
q AS (SELECT rule, count(*) AS n, quantile_cont(span_s, 0.25) AS q1, quantile_cont(span_s, 0.5) AS median, quantile_cont(span_s, 0.75) AS q3, min(span_s) AS lowest FROM spans GROUP BY rule),
steps AS (SELECT s.rule, span_s AS below, lead(span_s) OVER (PARTITION BY s.rule ORDER BY span_s) - span_s AS gap, row_number() OVER (PARTITION BY s.rule ORDER BY span_s) AS nth, n, median, lowest FROM spans s JOIN q USING (rule)),
gaps AS (SELECT rule, arg_max(below, gap * 1000000000 - below) AS below, max(gap) AS gap FROM steps WHERE gap IS NOT NULL AND below >= median AND gap >= 43200 AND gap > 1.5 * greatest(below - lowest, 43200) AND (n - nth) / n <= 0.5 GROUP BY rule)"""


@query(f"WITH {SPANS_SQL} SELECT rule, group_key, CAST(span_s AS BIGINT) AS span_s FROM spans")
def timing_spans(spark, d):
    return timing.group_spans(_instants(spark, d))


@query(f"WITH {SPANS_SQL} SELECT rule, n, q1, median, q3 FROM q")
def timing_quantiles(spark, d):
    return timing.quantiles(timing.group_spans(_instants(spark, d)))


@query(f"WITH {SPANS_SQL} SELECT rule, CAST(below AS BIGINT) AS below, CAST(gap AS BIGINT) AS gap FROM gaps")
def timing_gap_threshold(spark, d):
    return timing.gap_threshold(timing.group_spans(_instants(spark, d)))


@query(
    f"""WITH {SPANS_SQL}, b AS (SELECT rule, coalesce(CAST(below AS DOUBLE), greatest(q3 + 1.5 * (q3 - q1), median + 43200)) AS threshold FROM q LEFT JOIN gaps USING (rule) WHERE n >= 8)
SELECT rule, group_key, CAST(span_s AS BIGINT) AS span_s, threshold, span_s > threshold AS late FROM spans JOIN b USING (rule)"""
)
def verify_timing(spark, d):
    return timing.timing(timing.group_spans(_instants(spark, d)))


def _verified(spark, d):
    w = World(spark, d)
    own = w.exact_members()
    props = match.proposals(own, RULE_EXACT)
    pop = [(RULE_EXACT, "ledger", "order_ref"), (RULE_EXACT, "gateway", "order_ref")]
    return props, verify.verify(props, match.members_of(props, own), w.sources, {"ledger": "currency", "gateway": "currency"}, pop)


_VERIFIED_SQL = """{M}, c AS (SELECT 'ledger' AS dataset, row_id, currency FROM ledger UNION ALL SELECT 'gateway', row_id, currency FROM gateway),
v AS (SELECT group_key, count(DISTINCT currency) > 1 AS mixed FROM members JOIN c USING (dataset, row_id) WHERE rule = 'auto_exact__ledger__gateway' GROUP BY group_key)"""


@query(f"WITH {_VERIFIED_SQL} SELECT group_key, CASE WHEN mixed THEN 'fail' ELSE 'pass' END AS status, CASE WHEN mixed THEN 'currency_uniform' ELSE '' END AS failed FROM v")
def verify_exact(spark, d):
    props, found = _verified(spark, d)
    return found.join(props, "proposal_id").select("group_key", "status", F.array_join("failed", ",").alias("failed"))


_PLANTED_SQL = SPANS_SQL + """, late AS (SELECT rule, group_key, span_s > coalesce(CAST(below AS DOUBLE), greatest(q3 + 1.5 * (q3 - q1), median + 43200)) AS late FROM spans JOIN q USING (rule) LEFT JOIN gaps USING (rule) WHERE q.n >= 8),
tm AS (SELECT m.rule, m.group_key, dataset, m.row_id + CASE WHEN n % 211 = 5 AND dataset = 'gateway' THEN 1000000000 ELSE 0 END AS row_id, amount_minor + CASE WHEN n % 223 = 7 AND dataset = 'ledger' THEN 1234567 ELSE 0 END AS amount_minor
  FROM members m JOIN status s ON s.rule = m.rule AND s.group_key = m.group_key WHERE NOT (m.rule = 'auto_exact__ledger__gateway' AND dataset = 'gateway' AND m.row_id % 2 = 0 AND n % 2 = 0)),
tp AS (SELECT rule, group_key, edge, member_count + CASE WHEN n % 227 = 9 THEN 1 ELSE 0 END AS member_count, balance_minor + CASE WHEN n % 229 = 11 THEN 7 ELSE 0 END AS balance_minor,
  CASE WHEN n % 233 <> 13 THEN confidence WHEN confidence = 'exact' THEN 'unbalanced' ELSE 'exact' END AS confidence FROM status),
""" + CELLS_SQL + """,
src AS (SELECT 'ledger' AS dataset, row_id, currency FROM ledger UNION ALL SELECT 'gateway', row_id, currency FROM gateway UNION ALL SELECT 'bank', row_id, currency FROM bank),
claim AS (SELECT edge, dataset, row_id, rule || group_key AS by FROM members JOIN status USING (rule, group_key) WHERE status = 'accepted'
  UNION ALL SELECT edge, dataset, row_id, 'another' FROM members JOIN status USING (rule, group_key) WHERE rule = 'auto_exact__ledger__gateway' AND n % 239 = 3),
clash AS (SELECT DISTINCT tm.rule, tm.group_key, true AS clashes FROM tm JOIN tp USING (rule, group_key) JOIN claim c ON c.edge = tp.edge AND c.dataset = tm.dataset AND c.row_id = tm.row_id AND c.by <> tm.rule || tm.group_key),
vis AS (SELECT 'auto_exact__ledger__gateway' AS rule, 'ledger' AS dataset, order_ref AS group_key, count(*) AS n FROM ledger GROUP BY order_ref UNION ALL SELECT 'auto_exact__ledger__gateway', 'gateway', order_ref, count(*) FROM gateway GROUP BY order_ref
  UNION ALL SELECT 'auto_batch__bank__gateway', 'gateway', batch_id, count(*) FROM gateway GROUP BY batch_id),
rest AS (SELECT rule, group_key, sum(greatest(vis.n - t.n, 0)) AS n_left FROM (SELECT rule, group_key, dataset, count(*) AS n FROM tm GROUP BY ALL) t JOIN vis USING (rule, group_key, dataset) GROUP BY rule, group_key),
dup AS (SELECT row_id, first_id FROM (SELECT row_id, min(row_id) OVER (PARTITION BY order_ref, gross_amount, currency, batch_id) AS first_id FROM gateway) WHERE row_id <> first_id),
copied AS (SELECT DISTINCT a.rule, a.group_key, true AS copies FROM tm a JOIN dup ON a.dataset = 'gateway' AND a.row_id = dup.row_id JOIN tm b ON b.rule = a.rule AND b.group_key = a.group_key AND b.dataset = 'gateway' AND b.row_id = dup.first_id),
now AS (SELECT tm.rule, tm.group_key, bool_and(s.row_id IS NOT NULL) AS resolved, count(*) AS n, count(DISTINCT tm.dataset) AS n_datasets, string_agg(DISTINCT tm.dataset, ',' ORDER BY tm.dataset) AS edge_now, count(amount_minor) AS n_amounts,
  count(*) FILTER (s.row_id IS NOT NULL AND amount_minor <> 0 AND y.v IS NOT NULL) AS n_traced, sum(amount_minor) AS bal, count(currency) AS n_cur, count(DISTINCT currency) AS n_curs
  FROM tm LEFT JOIN src s ON s.dataset = tm.dataset AND s.row_id = tm.row_id LEFT JOIN sayable y ON y.dataset = tm.dataset AND y.row_id = tm.row_id AND y.v = abs(amount_minor) GROUP BY tm.rule, tm.group_key),
judged AS (SELECT tp.rule, tp.group_key, coalesce(copies, false) AS copies, list_filter([
  CASE WHEN NOT resolved THEN 'members_resolve' END, CASE WHEN n_datasets < 2 THEN 'spans_two_datasets' END, CASE WHEN n <> member_count OR edge_now <> edge THEN 'member_record_consistent' END,
  CASE WHEN n_traced <> n_amounts THEN 'amounts_traceable' END, CASE WHEN confidence = 'exact' AND n_traced = n_amounts AND bal <> 0 THEN 'balance_recomputed' END, CASE WHEN bal <> balance_minor THEN 'balance_matches_record' END,
  CASE WHEN clashes THEN 'single_claim_per_edge' END, CASE WHEN n_cur >= 2 AND n_curs <> 1 THEN 'currency_uniform' END, CASE WHEN late THEN 'timing_consistent' END, CASE WHEN n_left > 0 THEN 'no_residual_evidence' END,
  CASE WHEN CASE WHEN bal = 0 THEN 'exact' ELSE 'unbalanced' END <> confidence THEN 'confidence_consistent' END], lambda x: x IS NOT NULL) AS failed
  FROM tp JOIN now USING (rule, group_key) LEFT JOIN clash USING (rule, group_key) LEFT JOIN late USING (rule, group_key) LEFT JOIN rest USING (rule, group_key) LEFT JOIN copied USING (rule, group_key))"""


def _planted(spark, d):
    """Both rules' groups with something wrong in some of them, judged with claims, spans and marks."""
    w = World(spark, d)
    props, members = w.both()
    props, members = written(props.withColumn("number", F.regexp_extract("group_key", "([0-9]+)$", 1).cast("bigint")), "props"), written(members, "members")
    k, at = F.col("number"), members.join(props.select("proposal_id", "rule", "number", "edge"), "proposal_id")
    gate = F.col("dataset") == "gateway"
    changed = at.where(~((F.col("rule") == RULE_EXACT) & gate & (F.col("row_id") % 2 == 0) & (k % 2 == 0))).select(
        "proposal_id", "group_key", "dataset", (F.col("row_id") + F.when((k % 211 == 5) & gate, 1_000_000_000).otherwise(0)).alias("row_id"), "role",
        (F.col("amount_minor") + F.when((k % 223 == 7) & (F.col("dataset") == "ledger"), 1234567).otherwise(0)).alias("amount_minor"),
    )
    told = props.withColumns({
        "member_count": F.col("member_count") + F.when(k % 227 == 9, 1).otherwise(0),
        "balance_minor": F.col("balance_minor") + F.when(k % 229 == 11, 7).otherwise(0),
        "confidence": F.when(k % 233 != 13, F.col("confidence")).when(F.col("confidence") == "exact", "unbalanced").otherwise("exact"),
    }).drop("status", "number")
    another = (F.col("rule") == RULE_EXACT) & (k % 239 == 3)
    second = F.xxhash64("proposal_id", F.lit("another")).alias("proposal_id")
    status = props.select("proposal_id", "edge", "status").unionByName(props.where(another).select(second, "edge", F.lit("accepted").alias("status")))
    recorded = members.unionByName(at.where(another).select(second, *members.columns[1:]))
    marks = dedup.near_marks(w.gateway).select(F.lit("gateway").alias("dataset"), "row_id", "dup_of")
    timed = timing.timing(timing.group_spans(_spans_of(w, props, members)))
    pop = [(RULE_EXACT, "ledger", "order_ref"), (RULE_EXACT, "gateway", "order_ref"), (RULE_BATCH, "gateway", "batch_id")]
    return told, verify.verify(told, changed, w.sources, dict.fromkeys(w.sources, "currency"), pop, timed, status, recorded, marks)


@query(f"WITH {_PLANTED_SQL} SELECT rule, group_key, CASE WHEN len(failed) > 0 THEN 'fail' ELSE 'pass' END AS status, array_to_string(failed, ',') AS failed, copies FROM judged")
def verify_all(spark, d):
    props, found = _planted(spark, d)
    copies = F.exists("invariants", lambda x: x["code"] == "duplicate_rows_excluded")
    return found.join(props, "proposal_id").select("rule", "group_key", "status", F.array_join("failed", ",").alias("failed"), copies.alias("copies"))


@query(f"WITH {_PLANTED_SQL} SELECT code, count(*) AS n FROM (SELECT unnest(failed) AS code FROM judged) GROUP BY code")
def verify_failures(spark, d):
    _, found = _planted(spark, d)
    return found.select(F.explode("failed").alias("code")).groupBy("code").agg(F.count("*").alias("n"))


@query(f"WITH {_VERIFIED_SQL} SELECT 'currency_uniform' AS cause, count(*) FILTER (mixed) AS n FROM v HAVING count(*) FILTER (mixed) > 0 UNION ALL SELECT confidence, count(*) FROM proposals WHERE rule = 'auto_exact__ledger__gateway' AND confidence <> 'exact' GROUP BY confidence UNION ALL SELECT 'unmatched_rows', (SELECT count(*) FROM ledger WHERE order_ref NOT IN (SELECT order_ref FROM gateway))")
def exceptions_by_cause(spark, d):
    w = World(spark, d)
    props, found = _verified(spark, d)
    n = match.unmatched(w.ledger, "ledger", match.members_of(props, w.exact_members())).count()
    return report.exceptions_by_cause(found, props, n)


@query("SELECT user_id AS proposal_id, event_id AS seq, event_type AS status FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def latest_verification(spark, d):
    log = read(spark, d, "events").select(F.col("user_id").alias("proposal_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("status"))
    return report.latest_verification(log)


# Spine and chains


@query(
    """WITH {F}, j AS (SELECT CAST(CAST(make_timestamp(posted_s * 1000000) AS TIMESTAMP) AS VARCHAR) AS p, CAST(CAST(make_timestamp(captured_s * 1000000) AS TIMESTAMP) AS VARCHAR) AS c FROM ledger JOIN gateway USING (order_ref))
SELECT 'posted_at' AS left_column, 'captured_at' AS right_column, count(*) FILTER (p < c) AS n_before, count(*) FILTER (p > c) AS n_after, round(greatest(count(*) FILTER (p < c), count(*) FILTER (p > c)) / nullif(count(*) FILTER (p <> c), 0), 6) AS agreement FROM j"""
)
def precedence_counts(spark, d):
    w = World(spark, d)
    own = w.exact_members()
    pairs = spine.member_pairs(match.members_of(match.proposals(own, RULE_EXACT), own), "ledger", "gateway")
    at = lambda c: F.timestamp_seconds(c).cast("string")
    return spine.precedence(pairs, w.ledger.select("row_id", at("posted_s").alias("posted_at")), ["posted_at"], w.gateway.select("row_id", at("captured_s").alias("captured_at")), ["captured_at"])


@query("WITH {M} SELECT DISTINCT l.dataset AS a, r.dataset AS b FROM members l JOIN members r USING (rule, group_key) WHERE l.dataset <> r.dataset")
def adjacency(spark, d):
    return spine.adjacency(World(spark, d).both()[1])


@query("SELECT min(v) AS value FROM (SELECT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS v, row_number() OVER (ORDER BY CAST(o_orderdate AS DATE)) AS nth, count(*) OVER () AS n FROM orders) WHERE nth > n // 2")
def spine_median(spark, d):
    return spine.upper_median(read(spark, d, "orders").select(F.col("o_orderdate").cast("date").cast("string").alias("v")), "v")


CHAIN_SQL = """{M}, open AS (SELECT * FROM status WHERE status <> 'rejected'), legs0 AS (SELECT DISTINCT l.order_ref AS label, m.rule, m.group_key FROM ledger l JOIN members m ON m.dataset = 'ledger' AND m.row_id = l.row_id JOIN open USING (rule, group_key)),
rows1 AS (SELECT DISTINCT label, m.dataset, m.row_id FROM legs0 JOIN members m USING (rule, group_key)),
legs1 AS (SELECT DISTINCT label, m.rule, m.group_key FROM rows1 JOIN members m USING (dataset, row_id) JOIN open USING (rule, group_key)),
owners AS (SELECT rule, group_key, count(*) AS n_owners FROM legs1 GROUP BY rule, group_key),
facts AS (SELECT label, count(*) AS n_legs, count(*) FILTER (n_owners > 1) AS n_shared, bool_or(confidence IN ('unbalanced', 'ambiguous')) AS broken, bool_or(status <> 'accepted') AS waiting
  FROM legs1 JOIN owners USING (rule, group_key) JOIN open USING (rule, group_key) GROUP BY label),
modal AS (SELECT n_legs AS modal FROM facts GROUP BY n_legs ORDER BY count(*) DESC, n_legs LIMIT 1),
states AS (SELECT l.order_ref AS label, coalesce(n_legs, 0) AS n_legs, coalesce(n_shared, 0) AS n_shared, CASE WHEN n_legs IS NULL THEN 'unmatched' WHEN broken THEN 'exception' WHEN n_legs < modal THEN 'incomplete' WHEN waiting THEN 'pending' ELSE 'reconciled' END AS state
  FROM (SELECT DISTINCT order_ref FROM ledger) l LEFT JOIN facts ON facts.label = l.order_ref CROSS JOIN modal)"""


def _chains(spark, d):
    w = World(spark, d)
    props, members = w.both()
    legs = chains.reached(chains.labelled_members(w.ledger, "ledger", "order_ref", members, props), members, props)
    return w, props, members, written(legs, "legs")


@query(f"WITH {CHAIN_SQL} SELECT * FROM states")
def chain_states(spark, d):
    w, props, _, legs = _chains(spark, d)
    return chains.chain_states(w.ledger, "order_ref", legs, props)


@query(
    f"""WITH {CHAIN_SQL}, steps AS (SELECT DISTINCT label, 0 AS step, 'ledger' AS from_stage, 'gateway' AS to_stage, 'auto_exact__ledger__gateway' AS rule FROM legs1
  UNION ALL SELECT DISTINCT label, 1, 'gateway', 'bank', 'auto_batch__bank__gateway' FROM legs1)
SELECT s.label, s.step, s.from_stage, s.to_stage, CASE WHEN confidence IS NULL THEN 'missing' WHEN confidence = 'exact' THEN 'matched' ELSE 'off' END AS hop_state
FROM steps s LEFT JOIN (legs1 JOIN open USING (rule, group_key)) x ON x.label = s.label AND x.rule = s.rule"""
)
def chain_hops(spark, d):
    _, props, members, legs = _chains(spark, d)
    return chains.hops(legs, members, props, ["ledger", "gateway", "bank"]).drop("proposal_id")


@query(
    f"""WITH {CHAIN_SQL}, many AS (SELECT DISTINCT rule, group_key, dataset FROM (SELECT rule, group_key, dataset FROM members GROUP BY ALL HAVING count(*) > 1)),
named AS (SELECT rule, group_key, string_agg(dataset, ',' ORDER BY dataset) AS duplicate_in FROM many GROUP BY rule, group_key)
SELECT label, CASE rule WHEN 'auto_exact__ledger__gateway' THEN 0 ELSE 1 END AS step, duplicate_in FROM legs1 JOIN open USING (rule, group_key) JOIN named USING (rule, group_key)"""
)
def chain_hop_duplicates(spark, d):
    _, props, members, legs = _chains(spark, d)
    return chains.hop_duplicates(chains.hops(legs, members, props, ["ledger", "gateway", "bank"]), members)


@query("WITH {M}, held AS (SELECT dataset, row_id FROM members JOIN status USING (rule, group_key) WHERE status <> 'rejected') SELECT 'gateway' AS dataset, row_id FROM gateway WHERE row_id NOT IN (SELECT row_id FROM held WHERE dataset = 'gateway') UNION ALL SELECT 'bank', row_id FROM bank WHERE row_id NOT IN (SELECT row_id FROM held WHERE dataset = 'bank')")
def leftovers(spark, d):
    w = World(spark, d)
    props, members = w.both()
    return chains.leftovers(w.sources, "ledger", members, props)


# Reports


@query(
    """WITH {M}, t AS (SELECT 'ledger' AS dataset, count(*) AS n_rows FROM ledger UNION ALL SELECT 'gateway', count(*) FROM gateway UNION ALL SELECT 'bank', count(*) FROM bank),
a AS (SELECT dataset, count(DISTINCT row_id) AS matched FROM members JOIN status USING (rule, group_key) WHERE status = 'accepted' GROUP BY dataset)
SELECT dataset, n_rows, coalesce(matched, 0) AS matched, n_rows - coalesce(matched, 0) AS unmatched FROM t LEFT JOIN a USING (dataset)"""
)
def coverage_dataset(spark, d):
    w = World(spark, d)
    props, members = w.both()
    return report.coverage_by_dataset(w.sources, members, props)


@query("WITH {M} SELECT edge, dataset, count(DISTINCT row_id) AS matched FROM members JOIN status USING (rule, group_key) WHERE status = 'accepted' GROUP BY edge, dataset")
def coverage_edge(spark, d):
    props, members = World(spark, d).both()
    return report.coverage_by_edge(members, props)


@query(
    """WITH {M}, t AS (SELECT 'ledger' AS dataset, count(*) AS n_rows FROM ledger UNION ALL SELECT 'gateway', count(*) FROM gateway UNION ALL SELECT 'bank', count(*) FROM bank),
sides AS (SELECT DISTINCT edge, unnest(string_split(edge, ',')) AS dataset FROM status WHERE status = 'accepted'),
a AS (SELECT edge, dataset, count(DISTINCT row_id) AS matched FROM members JOIN status USING (rule, group_key) WHERE status = 'accepted' GROUP BY edge, dataset)
SELECT edge, dataset, n_rows, coalesce(matched, 0) AS matched, n_rows - coalesce(matched, 0) AS unmatched FROM sides JOIN t USING (dataset) LEFT JOIN a USING (edge, dataset)"""
)
def coverage_sides(spark, d):
    w = World(spark, d)
    props, members = w.both()
    return report.coverage_sides(w.sources, members, props)


@query(
    """WITH {M}, c AS (SELECT 'ledger' AS dataset, row_id, currency FROM ledger UNION ALL SELECT 'gateway', row_id, currency FROM gateway UNION ALL SELECT 'bank', row_id, currency FROM bank),
g AS (SELECT rule, group_key, sum(CASE WHEN amount_minor > 0 THEN amount_minor ELSE 0 END) AS gross, arg_min(currency, (dataset, row_id)) AS currency FROM members JOIN c USING (dataset, row_id) GROUP BY rule, group_key)
SELECT currency, CAST(sum(gross) AS BIGINT) AS gross_minor, CAST(sum(CASE WHEN status = 'accepted' THEN gross ELSE 0 END) AS BIGINT) AS reconciled_minor, CAST(sum(CASE WHEN status <> 'accepted' THEN gross ELSE 0 END) AS BIGINT) AS open_minor,
  CAST(sum(CASE WHEN confidence = 'unbalanced' THEN abs(balance_minor) ELSE 0 END) AS BIGINT) AS residual_minor FROM g JOIN status USING (rule, group_key) GROUP BY currency"""
)
def value_by_currency(spark, d):
    w = World(spark, d)
    props, members = w.both()
    currency = None
    for n, s in w.sources.items():
        own = s.select(F.lit(n).alias("dataset"), "row_id", "currency")
        currency = own if currency is None else currency.unionByName(own)
    return report.value_by_currency(members, props, currency)


@query(
    """WITH {M}, dup AS (SELECT row_id, row_id <> min(row_id) OVER (PARTITION BY order_ref, gross_amount, currency, batch_id) AS d FROM gateway),
a AS (SELECT DISTINCT row_id FROM members JOIN status USING (rule, group_key) WHERE dataset = 'gateway' AND status = 'accepted')
SELECT 'gateway' AS dataset, CAST(coalesce(sum(CASE WHEN NOT d THEN round(gross_amount * 100) END), 0) AS BIGINT) AS total_minor, CAST(coalesce(sum(CASE WHEN NOT d AND row_id IN (SELECT row_id FROM a) THEN round(gross_amount * 100) END), 0) AS BIGINT) AS matched_minor,
  CAST(coalesce(sum(CASE WHEN d THEN round(gross_amount * 100) END), 0) AS BIGINT) AS duplicate_minor FROM gateway JOIN dup USING (row_id)"""
)
def dataset_value(spark, d):
    w = World(spark, d)
    props, members = w.both()
    return report.dataset_value(dedup.mark_duplicates(w.gateway), "gateway", "gross_amount", members, props)


@query("SELECT event_type AS kind, CASE WHEN user_id % 3 = 0 THEN 'system' ELSE 'person' END AS actor, count(*) AS n FROM events GROUP BY ALL")
def decision_ledger(spark, d):
    e = read(spark, d, "events").select(F.col("event_type").alias("kind"), F.when(F.col("user_id") % 3 == 0, "system").otherwise("person").alias("actor"))
    return report.decision_ledger(e)


@query("WITH {M} SELECT status, confidence, count(*) AS n, status IN ('pending', 'review_later') AS needs_review FROM status GROUP BY status, confidence")
def status_summary(spark, d):
    return report.status_summary(World(spark, d).both()[0])


_LINES_SQL = """{M}, piece AS (SELECT rule, group_key, dataset, row_id // 4096 AS p, sha256(string_agg(CAST(row_id AS VARCHAR), ',' ORDER BY row_id)) AS h FROM members GROUP BY ALL),
stretch AS (SELECT rule, group_key, dataset, p // 4096 AS s, sha256(string_agg(h, ',' ORDER BY p)) AS h FROM piece GROUP BY ALL),
own AS (SELECT rule, group_key, string_agg(dataset || ':' || lpad(CAST(s AS VARCHAR), 12, '0') || ':' || h, ',' ORDER BY dataset, s) AS m FROM stretch GROUP BY rule, group_key),
lines AS (SELECT rule, group_key, sha256(rule || '|' || group_key || '|' || confidence || '|' || status || '|' || m) AS line_hash FROM status JOIN own USING (rule, group_key))"""
#: A tree of up to six levels, of which those count that the number of lines asks for.
_TREE_SQL = """WITH {L}, size AS (SELECT CAST(greatest(0, ceil(log2(count(*) / 256) / 4)) AS INTEGER) AS digits FROM lines),
l6 AS (SELECT substr(line_hash, 1, digits) AS r, sha256(string_agg(line_hash, chr(10) ORDER BY line_hash)) AS h FROM lines, size GROUP BY ALL)""".replace("{L}", _LINES_SQL) + "".join(
    f", l{i} AS (SELECT substr(r, 1, {i}) AS q, CASE WHEN max(length(r)) <= {i} THEN any_value(h) ELSE sha256(string_agg(h, chr(10) ORDER BY r)) END AS h FROM l{i + 1} GROUP BY q)".replace("AS q", "AS r").replace("GROUP BY q", f"GROUP BY substr(r, 1, {i})")
    for i in range(5, -1, -1)
)


@query(f"WITH {_LINES_SQL} SELECT * FROM lines")
def decision_lines(spark, d):
    props, members = World(spark, d).both()
    return report.decision_lines(props, members)


@query(f"{_TREE_SQL} SELECT substr(h, 1, 24) AS checksum FROM l0")
def decisions_checksum(spark, d):
    props, members = World(spark, d).both()
    return report.checksum(report.decision_lines(props, members))


@query("SELECT min(CAST(CAST(o_orderdate AS DATE) AS VARCHAR)) AS earliest, max(CAST(CAST(o_orderdate AS DATE) AS VARCHAR)) AS latest FROM orders")
def report_period(spark, d):
    return report.period(read(spark, d, "orders").select(F.col("o_orderdate").cast("date").cast("string").alias("day")), ["day"])


# Evaluation, run metrics, guarded SQL, scalars


@query(
    """WITH {M}, k AS (SELECT order_ref AS key, CASE WHEN (row_id - 1) % 60 = 19 THEN 'MISSING' WHEN (row_id - 1) % 60 = 27 OR (row_id - 1) % 50 = 6 THEN 'EXCEPTION' ELSE 'MATCHED' END AS expected FROM ledger),
p AS (SELECT * FROM status WHERE rule = 'auto_exact__ledger__gateway')
SELECT expected, CASE WHEN p.group_key IS NULL THEN 'MISSING' WHEN confidence <> 'exact' THEN 'EXCEPTION' ELSE 'MATCHED' END AS predicted, count(*) AS n FROM k LEFT JOIN p ON p.group_key = k.key GROUP BY ALL"""
)
def confusion_matrix(spark, d):
    w = World(spark, d)
    key = F.col("row_id") - 1
    code = F.when(key % 60 == 19, "MISSING_PROCESSOR").when((key % 60 == 27) | (key % 50 == 6), "AMOUNT_MISMATCH").otherwise("MATCHED")
    labels = w.ledger.select(F.col("order_ref").alias("key"), evaluate.outcome(code).alias("expected"))
    props = w.both()[0].where(F.col("rule") == RULE_EXACT)
    return evaluate.confusion(labels.join(evaluate.verdicts(labels.select("key"), props), "key"))


@query(
    """WITH {M}, p AS (SELECT group_key FROM status WHERE rule = 'auto_exact__ledger__gateway' AND confidence = 'exact'),
wanted AS (SELECT order_ref AS key, 'ledger:' || CAST(row_id AS VARCHAR) AS value FROM ledger UNION SELECT order_ref, 'gateway:' || CAST(2 * row_id - 1 + CASE WHEN row_id % 100 = 0 THEN 1 ELSE 0 END AS VARCHAR) FROM ledger),
hit AS (SELECT w.key, bool_and(m.row_id IS NOT NULL) AS whole FROM wanted w JOIN p ON p.group_key = w.key LEFT JOIN members m ON m.rule = 'auto_exact__ledger__gateway' AND m.group_key = w.key AND m.dataset || ':' || CAST(m.row_id AS VARCHAR) = w.value GROUP BY w.key)
SELECT count(*) AS checked, count(*) FILTER (whole) AS exact FROM hit"""
)
def evaluation_member_exact(spark, d):
    """Rows that labels ask for, every hundredth with a wrong capture among them."""
    w = World(spark, d)
    props, members = w.both()
    of = lambda name, c: F.concat(F.lit(f"{name}:"), c.cast("string")).alias("value")
    key = F.col("order_ref").alias("key")
    wanted = w.ledger.select(key, of("ledger", F.col("row_id"))).unionByName(w.ledger.select(key, of("gateway", 2 * F.col("row_id") - 1 + F.when(F.col("row_id") % 100 == 0, 1).otherwise(0))))
    own = props.where(F.col("rule") == RULE_EXACT)
    found = members.join(own.select("proposal_id"), "proposal_id", "left_semi").select(F.col("group_key").alias("key"), F.concat_ws(":", "dataset", F.col("row_id").cast("string")).alias("value"))
    return evaluate.member_exact(wanted, found, evaluate.verdicts(w.ledger.select(key), own))


@query("SELECT event_type AS model, count(*) AS calls, CAST(sum(user_id) AS BIGINT) AS tokens, CAST(sum(user_id % 97) AS BIGINT) AS cost_micros, CAST(sum(event_id % 1000) AS BIGINT) AS latency_ms FROM events GROUP BY event_type")
def run_metrics_by_model(spark, d):
    e = read(spark, d, "events").select(F.col("event_type").alias("model"), F.col("user_id").alias("tokens"), (F.col("user_id") % 97).alias("cost_micros"), (F.col("event_id") % 1000).alias("latency_ms"))
    return evaluate.run_metrics(e)


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq FROM events QUALIFY seq > 3")
def run_event_replay(spark, d):
    return runlog.sequenced(read(spark, d, "events").select("user_id", "event_id"), "user_id", "event_id").where("seq > 3")


@query("WITH {M} SELECT row_id, order_ref FROM ledger WHERE row_id NOT IN (SELECT row_id FROM members WHERE dataset = 'ledger') ORDER BY row_id LIMIT 3")
def unmatched_examples(spark, d):
    w = World(spark, d)
    _, members = w.both()
    return match.unmatched_examples(match.unmatched(w.ledger, "ledger", members), ["order_ref"])


@query("WITH {F} SELECT row_id, order_ref FROM ledger WHERE row_id > 100 ORDER BY row_id LIMIT 50")
def row_page(spark, d):
    return page(ledger(spark, d), 100, 50).select("row_id", "order_ref")


@query("SELECT event_type AS key, max(event_id) AS event_id FROM events GROUP BY event_type")
def latest_row(spark, d):
    return latest_by(read(spark, d, "events").select(F.col("event_type").alias("key"), "event_id"), "key", "event_id")


@query("""WITH {M}, k AS (SELECT order_ref AS key FROM ledger), l AS (SELECT key FROM k WHERE CAST(substr(key, 5) AS BIGINT) % 20 <> 0)
SELECT (SELECT count(*) FROM l) AS n_labelled, (SELECT count(*) FROM k WHERE key NOT IN (SELECT key FROM l)) AS n_unlabelled,
  (SELECT count(*) FROM k WHERE key NOT IN (SELECT key FROM l)) <= 0.1 * (SELECT count(*) FROM l) AS consistent""")
def fixture_consistency(spark, d):
    keys = ledger(spark, d).select(F.col("order_ref").alias("key"))
    return evaluate.unlabelled(keys, keys.where(F.substring("key", 5, 20).cast("bigint") % 20 != 0))


@query("WITH {M} SELECT count(*) AS n, round(count(*) FILTER (e = p) / count(*), 6) AS accuracy, round(count(*) FILTER (e = 'MATCHED' AND p = 'MATCHED') / count(*) FILTER (p = 'MATCHED'), 6) AS precision, round(count(*) FILTER (e = 'MATCHED' AND p = 'MATCHED') / count(*) FILTER (e = 'MATCHED'), 6) AS recall, round(2 * count(*) FILTER (e = 'MATCHED' AND p = 'MATCHED') / (count(*) FILTER (p = 'MATCHED') + count(*) FILTER (e = 'MATCHED')), 6) AS f1, round(count(*) FILTER (a AND e <> 'MATCHED') / count(*) FILTER (a), 6) AS false_auto_rate FROM (SELECT CASE WHEN (row_id - 1) % 60 = 19 THEN 'MISSING' WHEN (row_id - 1) % 50 = 6 THEN 'EXCEPTION' ELSE 'MATCHED' END AS e, CASE WHEN s.group_key IS NULL THEN 'MISSING' WHEN confidence <> 'exact' THEN 'EXCEPTION' ELSE 'MATCHED' END AS p, coalesce(s.status = 'accepted', false) AS a FROM ledger LEFT JOIN (SELECT * FROM status WHERE rule = 'auto_exact__ledger__gateway') s ON s.group_key = order_ref)")
def evaluation_scores(spark, d):
    w = World(spark, d)
    key = F.col("row_id") - 1
    labels = w.ledger.select(F.col("order_ref").alias("key"), evaluate.outcome(F.when(key % 60 == 19, "MISSING_PROCESSOR").when(key % 50 == 6, "AMOUNT_MISMATCH").otherwise("MATCHED")).alias("expected"))
    props = w.both()[0].where(F.col("rule") == RULE_EXACT)
    return evaluate.scores(labels.join(evaluate.verdicts(labels.select("key"), props), "key"))


@query("WITH {M} SELECT sum(n_rows)::BIGINT AS n_rows, sum(matched)::BIGINT AS matched, sum(n_rows - matched)::BIGINT AS unmatched FROM (SELECT dataset, n_rows, coalesce(matched, 0) AS matched FROM (SELECT 'ledger' AS dataset, count(*) AS n_rows FROM ledger UNION ALL SELECT 'gateway', count(*) FROM gateway UNION ALL SELECT 'bank', count(*) FROM bank) LEFT JOIN (SELECT dataset, count(DISTINCT row_id) AS matched FROM members JOIN status USING (rule, group_key) WHERE status = 'accepted' GROUP BY dataset) USING (dataset))")
def coverage_totals(spark, d):
    w = World(spark, d)
    props, members = w.both()
    return report.coverage_totals(report.coverage_by_dataset(w.sources, members, props))


@query(f"WITH {CHAIN_SQL}, off AS (SELECT DISTINCT label FROM legs1 JOIN open USING (rule, group_key) WHERE confidence = 'unbalanced' UNION SELECT label FROM legs1 GROUP BY label HAVING count(DISTINCT rule) < 2) SELECT label FROM off")
def chain_break_labels(spark, d):
    _, props, members, legs = _chains(spark, d)
    steps = chains.hops(legs, members, props, ["ledger", "gateway", "bank"])
    return chains.break_reasons(steps, props).select("label")


@query(
    f"""WITH {CHAIN_SQL}, steps AS (SELECT DISTINCT label, 0 AS step, 'ledger' AS from_stage, 'gateway' AS to_stage, 'auto_exact__ledger__gateway' AS rule FROM legs1
  UNION ALL SELECT DISTINCT label, 1, 'gateway', 'bank', 'auto_batch__bank__gateway' FROM legs1),
told AS (SELECT s.label, s.step, CASE WHEN confidence IS NULL THEN 30 WHEN confidence = 'unbalanced' THEN 10 END AS grave,
    CASE WHEN confidence IS NULL THEN concat('nothing from ', from_stage, ' to ', to_stage) ELSE concat('differ by ', CAST(abs(balance_minor) AS VARCHAR), ' minor between ', from_stage, ' and ', to_stage) END AS reason
  FROM steps s LEFT JOIN (legs1 JOIN open USING (rule, group_key)) x ON x.label = s.label AND x.rule = s.rule)
SELECT label, arg_min(reason, grave + step) AS reason FROM told WHERE grave IS NOT NULL GROUP BY label"""
)
def chain_break_reasons(spark, d):
    _, props, members, legs = _chains(spark, d)
    return chains.break_reasons(chains.hops(legs, members, props, ["ledger", "gateway", "bank"]), props)


@query("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus")
def guarded_select_orders(spark, d):
    read(spark, d, "orders").createOrReplaceTempView("tieout_orders")
    return guarded_select(spark, "SELECT o_orderstatus, count(*) AS n FROM tieout_orders GROUP BY o_orderstatus ORDER BY o_orderstatus", 50, ["tieout_orders"])


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN CAST(round(o_totalprice * 100) AS BIGINT) WHEN 1 THEN -CAST(round(o_totalprice * 100) AS BIGINT) WHEN 2 THEN NULL ELSE -(o_orderkey * 100) END AS minor_units FROM orders")
def money_parse(spark, d):
    p, k = F.col("o_totalprice").cast("decimal(18,2)").cast("string"), F.col("o_orderkey")
    text = F.when(k % 4 == 0, F.concat(F.lit("INR "), F.format_number(F.col("o_totalprice").cast("decimal(18,2)"), 2))).when(k % 4 == 1, F.concat(F.lit("("), p, F.lit(")"))).when(k % 4 == 2, "2024-01-05").otherwise(F.concat(F.lit("ORD-"), k.cast("string")))
    return read(spark, d, "orders").select("o_orderkey", money_minor(text).alias("minor_units"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN epoch_us(CAST(o_orderdate AS TIMESTAMP)) END AS micros FROM orders")
def iso_instants(spark, d):
    text = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderdate").cast("string")).otherwise(F.lit("01/02/2024"))
    return read(spark, d, "orders").select("o_orderkey", F.unix_micros(iso_instant(text)).alias("micros"))


@query("SELECT doc_id, substr(regexp_replace(regexp_replace(regexp_replace(source, '[0-9]', '9', 'g'), '[A-Z]', 'A', 'g'), '[a-z]', 'a', 'g'), 1, 2) AS head FROM documents")
def signature_heads(spark, d):
    return read(spark, d, "documents").select("doc_id", F.substring(signature(F.col("source")), 1, 2).alias("head"))


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
