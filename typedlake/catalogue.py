"""The queries of the library's own operators and their SQL."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import constraints, evolve, mutation, read, relation
from .operators.mutation import Keys, Reference
from .plans import Delete, Insert, Select, Table, TrustedSQL, Update, and_, not_, or_, trusted
from .schema import ColumnDef, Rename, Schema, TableDef, diff_with_renames
from .schema.apply import apply_plan
from .sources import Batch, Workspace

REGION = Table("region", [("r_regionkey", "int"), ("r_name", "string")])
NATION = Table("nation", [("n_nationkey", "int"), ("n_name", "string"), ("n_regionkey", "int")])
CUSTOMER = Table("customer", [("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"), ("c_acctbal", "double"), ("c_mktsegment", "string")])
SUPPLIER = Table("supplier", [("s_suppkey", "bigint"), ("s_name", "string"), ("s_nationkey", "int"), ("s_acctbal", "double")])
ORDERS = Table("orders", [("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"), ("o_totalprice", "double"), ("o_orderdate", "timestamp_ntz"), ("o_orderpriority", "string")])
LINEITEM = Table(
    "lineitem",
    [("l_orderkey", "bigint"), ("l_partkey", "bigint"), ("l_suppkey", "bigint"), ("l_linenumber", "int"), ("l_quantity", "double"), ("l_extendedprice", "double"), ("l_discount", "double"), ("l_tax", "double"), ("l_returnflag", "string"), ("l_linestatus", "string"), ("l_shipdate", "timestamp_ntz")],
)
LABELS = Table("labels", [("doc_id", "bigint"), ("quality", "int"), ("toxic", "int")])
CONVERSATIONS = Table("conversations", [("conv_id", "bigint"), ("turn", "bigint"), ("role", "string"), ("text", "string")])
STATUS = Table("status", [("o_orderstatus", "string"), ("o_orderpriority", "string")])

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(sql: str):
    """Register a query under its function's name, with its SQL."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


def _rows(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers whose segment is null where it was FURNITURE."""
    return _rows(spark, sf_dir, "customer").withColumn("c_mktsegment", F.nullif("c_mktsegment", F.lit("FURNITURE")))


_SPARSE = "(SELECT c_custkey, c_name, c_nationkey, c_acctbal, nullif(c_mktsegment, 'FURNITURE') AS c_mktsegment FROM customer)"


def _selected(name: str, sql: str, frame: Callable[[SparkSession, str], DataFrame], statement: Select) -> None:
    QUERIES[name] = lambda spark, sf_dir: read.select(frame(spark, sf_dir), statement)
    ORACLE_SQL[name] = sql


def _from(table: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: _rows(spark, sf_dir, table)


C, O, L = CUSTOMER, ORDERS, LINEITEM

# Filters.
_selected("sel_all", "SELECT * FROM region", _from("region"), Select(REGION))
_selected("sel_eq", "SELECT * FROM customer WHERE c_mktsegment = 'BUILDING'", _from("customer"), Select(C).where(C.c_mktsegment.eq("BUILDING")))
_selected("sel_eq_null", "SELECT * FROM customer WHERE c_mktsegment = NULL", _from("customer"), Select(C).where(C.c_mktsegment.eq(None)))
_selected("sel_ne_null", f"SELECT * FROM {_SPARSE} WHERE c_mktsegment <> 'MACHINERY'", _sparse, Select(C).where(C.c_mktsegment.ne("MACHINERY")))
_selected("sel_range", "SELECT * FROM orders WHERE o_totalprice > 1000 AND o_totalprice <= 250000", _from("orders"), Select(O).where(O.o_totalprice.gt(1000.0)).where(O.o_totalprice.lte(250000.0)))
_selected("sel_ts_gte", "SELECT * FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01'", _from("orders"), Select(O).where(O.o_orderdate.gte(dt.datetime(1996, 1, 1))))
_selected("sel_in", "SELECT * FROM orders WHERE o_orderstatus IN ('F', 'P')", _from("orders"), Select(O).where(O.o_orderstatus.in_("F", "P")))
_selected("sel_or_isnull", f"SELECT * FROM {_SPARSE} WHERE c_mktsegment = 'MACHINERY' OR c_mktsegment IS NULL", _sparse, Select(C).where(or_(C.c_mktsegment.eq("MACHINERY"), C.c_mktsegment.is_null())))
_selected("sel_not", f"SELECT * FROM {_SPARSE} WHERE NOT (c_mktsegment = 'MACHINERY')", _sparse, Select(C).where(not_(C.c_mktsegment.eq("MACHINERY"))))
_selected("sel_isnotnull", f"SELECT * FROM {_SPARSE} WHERE c_mktsegment IS NOT NULL", _sparse, Select(C).where(C.c_mktsegment.is_not_null()))
_selected("sel_eqcol", "SELECT * FROM lineitem WHERE l_orderkey = l_partkey", _from("lineitem"), Select(L).where(L.l_orderkey.eq_column(L.l_partkey)))
_selected("sel_necol", "SELECT * FROM lineitem WHERE l_orderkey <> l_partkey", _from("lineitem"), Select(L).where(L.l_orderkey.ne_column(L.l_partkey)))
_selected("sel_lt", "SELECT * FROM customer WHERE c_acctbal < 0", _from("customer"), Select(C).where(C.c_acctbal.lt(0.0)))
_selected("sel_trusted", "SELECT * FROM orders WHERE lower(o_orderstatus) = 'f' AND o_totalprice > 1000", _from("orders"), Select(O).where(trusted(O, TrustedSQL("lower(o_orderstatus) = 'f' AND o_totalprice > 1000"))))
_selected("sel_composite_or", "SELECT * FROM lineitem WHERE (l_orderkey = 1 AND l_linenumber = 1) OR (l_orderkey = 2 AND l_linenumber = 2)", _from("lineitem"), Select(L).where(or_(and_(L.l_orderkey.eq(1), L.l_linenumber.eq(1)), and_(L.l_orderkey.eq(2), L.l_linenumber.eq(2)))))
_selected("sel_wide_or", "SELECT * FROM orders WHERE o_orderkey BETWEEN 1 AND 400", _from("orders"), Select(O).where(or_(*[O.o_orderkey.eq(k) for k in range(1, 401)])))

# Order, limit, distinct, fetch.
_selected("sel_distinct", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders", _from("orders"), Select(STATUS).distinct())
_selected("sel_order_asc", f"SELECT * FROM {_SPARSE} ORDER BY c_mktsegment ASC NULLS LAST, c_custkey ASC LIMIT 50", _sparse, Select(C).order_by(C.c_mktsegment.asc(), C.c_custkey.asc()).limit(50))
_selected("sel_order_desc", f"SELECT * FROM {_SPARSE} ORDER BY c_mktsegment DESC NULLS FIRST, c_custkey ASC LIMIT 50", _sparse, Select(C).order_by(C.c_mktsegment.desc(), C.c_custkey.asc()).limit(50))
_selected("sel_page", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 400 OFFSET 900", _from("orders"), Select(O).order_by(O.o_orderkey.asc()).limit(400).offset(900))
_selected(
    "sel_topk",
    "SELECT DISTINCT * FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_totalprice > 1000 ORDER BY o_orderkey DESC, o_custkey ASC LIMIT 20 OFFSET 40",
    _from("orders"),
    Select(O).distinct().where(and_(O.o_orderstatus.in_("F", "O"), O.o_totalprice.gt(1000.0))).order_by(O.o_orderkey.desc(), O.o_custkey.asc()).limit(20).offset(40),
)
_selected("sel_big_limit", "SELECT * FROM nation", _from("nation"), Select(NATION).limit(1 << 40))
_selected("sel_past_end", "SELECT * FROM nation OFFSET 4611686018427387904", _from("nation"), Select(NATION).order_by(NATION.n_nationkey.asc()).offset(1 << 62))
_selected("fetch_one", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 1", _from("orders"), Select(O).order_by(O.o_orderkey.asc()).limit(1))
_selected("fetch_optional_none", "SELECT * FROM orders WHERE o_orderkey < 0 LIMIT 1", _from("orders"), Select(O).where(O.o_orderkey.lt(0)).limit(1))


# Relations.
@_query("SELECT c.*, o_orderkey, o_orderstatus, o_totalprice FROM customer c LEFT JOIN orders ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'")
def rel_many(spark, sf_dir):
    sources = read.select(_rows(spark, sf_dir, "customer"), Select(C).where(C.c_mktsegment.eq("BUILDING")))
    loaded = relation.load_many("orders", sources, _rows(spark, sf_dir, "orders"), Select(O).order_by(O.o_orderkey.asc()), ["c_custkey"], ["o_custkey"])
    return loaded.select(*C.names, F.explode_outer("related").alias("o")).select(*C.names, "o.o_orderkey", "o.o_orderstatus", "o.o_totalprice")


@_query("""
    SELECT c_custkey, o_orderkey, o_totalprice,
           CAST(CASE WHEN o_orderkey IS NOT NULL THEN row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC NULLS FIRST, o_orderkey) END AS INTEGER) AS ordinal
    FROM customer c LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'F') o ON o_custkey = c_custkey""")
def rel_many_filtered_desc(spark, sf_dir):
    sources = _rows(spark, sf_dir, "customer")
    base = Select(O).where(O.o_orderstatus.eq("F")).order_by(O.o_totalprice.desc(), O.o_orderkey.asc())
    return relation.joined_many("orders", sources, _rows(spark, sf_dir, "orders"), base, ["c_custkey"], ["o_custkey"], "ordinal").select("c_custkey", "o_orderkey", "o_totalprice", "ordinal")


@_query("SELECT d.doc_id, d.doc_id IS NOT NULL AS key_present, l.doc_id IS NOT NULL AS found, quality, toxic FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def rel_one(spark, sf_dir):
    sources = _rows(spark, sf_dir, "documents").select("doc_id")
    return relation.load_one("labels", sources, _rows(spark, sf_dir, "labels"), Select(LABELS), ["doc_id"], ["doc_id"]).select("doc_id", "key_present", "found", "quality", "toxic")


@_query("SELECT nullif(doc_id % 3, 0) AS k, count(*) AS n, bool_and(coalesce(nullif(doc_id % 3, 0) IS NOT NULL, false)) AS key_present, bool_or(l IS NOT NULL) AS found FROM documents LEFT JOIN (SELECT r_regionkey AS l FROM region) ON l = nullif(doc_id % 3, 0) GROUP BY 1")
def rel_one_null_key(spark, sf_dir):
    sources = _rows(spark, sf_dir, "documents").select(F.nullif(F.col("doc_id") % 3, F.lit(0)).alias("k"))
    one = relation.load_one("region", sources, _rows(spark, sf_dir, "region"), Select(REGION), ["k"], ["r_regionkey"])
    return one.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.bool_and("key_present").alias("key_present"), F.bool_or("found").alias("found"))


@_query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 1")
def rel_one_duplicates(spark, sf_dir):
    return relation.repeated_targets(_rows(spark, sf_dir, "customer"), _rows(spark, sf_dir, "orders"), Select(O), ["c_custkey"], ["o_custkey"])


@_query("SELECT a.conv_id, a.turn, b.role, b.text FROM conversations a LEFT JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1")
def rel_composite(spark, sf_dir):
    said = _rows(spark, sf_dir, "conversations")
    sources = said.select("conv_id", "turn", (F.col("turn") + 1).alias("next"))
    one = relation.load_one("next turn", sources, said, Select(CONVERSATIONS), ["conv_id", "next"], ["conv_id", "turn"])
    return one.select("conv_id", "turn", "role", "text")


@_query("SELECT * FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def rel_semi(spark, sf_dir):
    keys = read.select(_rows(spark, sf_dir, "customer"), Select(C).where(C.c_acctbal.lt(0.0))).select("c_custkey")
    return relation.related(_rows(spark, sf_dir, "orders"), keys, Select(O), "o_custkey")


@_query("SELECT * FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def rel_semi_same_name(spark, sf_dir):
    orders = _rows(spark, sf_dir, "orders")
    return relation.related(orders, orders.where("o_orderstatus = 'P'").select("o_custkey"), Select(O), "o_custkey")


# Mutations.
S = SUPPLIER
_NEW = Insert(S).row(S.s_suppkey.set(900001), S.s_name.set("new one"), S.s_nationkey.set(3), S.s_acctbal.set(10.5)).row(S.s_suppkey.set(900002), S.s_name.set("new two"), S.s_nationkey.set(None), S.s_acctbal.set(-1.0))
_NEW_SQL = "SELECT 900001::BIGINT AS s_suppkey, 'new one' AS s_name, 3::INTEGER AS s_nationkey, 10.5::DOUBLE AS s_acctbal UNION ALL SELECT 900002, 'new two', NULL, -1.0"


@_query(f"SELECT * FROM supplier UNION ALL {_NEW_SQL}")
def ins_state(spark, sf_dir):
    return mutation.insert(_rows(spark, sf_dir, "supplier"), _NEW).state


@_query(_NEW_SQL)
def ins_returning(spark, sf_dir):
    return mutation.insert(_rows(spark, sf_dir, "supplier"), _NEW.returning()).returning.select(*S.names)


def _upserted(last: int) -> Insert:
    out = Insert(S)
    for k in range(last - 19, last + 1):
        out = out.row(S.s_suppkey.set(k), S.s_name.set(f"upsert {k}"), S.s_nationkey.set(k % 25), S.s_acctbal.set(float(k)))
    return out.on_conflict(S.s_suppkey)


_IN_SQL = "(SELECT k::BIGINT AS s_suppkey, 'upsert ' || k AS s_name, (k % 25)::INTEGER AS s_nationkey, k::DOUBLE AS s_acctbal FROM range(90, 110) t(k))"
_UPSERT = _upserted(109).do_update(S.s_name.excluded(), S.s_acctbal.set_sql(TrustedSQL("t.s_acctbal + EXCLUDED.s_acctbal")))


@_query(f"""
    SELECT coalesce(i.s_suppkey, t.s_suppkey) AS s_suppkey, coalesce(i.s_name, t.s_name) AS s_name, coalesce(t.s_nationkey, i.s_nationkey) AS s_nationkey,
           CASE WHEN t.s_suppkey IS NULL THEN i.s_acctbal WHEN i.s_suppkey IS NULL THEN t.s_acctbal ELSE t.s_acctbal + i.s_acctbal END AS s_acctbal
    FROM supplier t FULL JOIN {_IN_SQL} i ON i.s_suppkey = t.s_suppkey""")
def ups_update_state(spark, sf_dir):
    return mutation.insert(_rows(spark, sf_dir, "supplier"), _UPSERT).state


@_query(f"SELECT i.* FROM {_IN_SQL} i WHERE NOT EXISTS (SELECT 1 FROM supplier t WHERE t.s_suppkey = i.s_suppkey)")
def ups_nothing_returning(spark, sf_dir):
    return mutation.insert(_rows(spark, sf_dir, "supplier"), _upserted(109).do_nothing()).returning.select(*S.names)


@_query("SELECT o_custkey AS s_suppkey, min(o_orderkey) AS first_order FROM orders WHERE o_custkey NOT IN (SELECT s_suppkey FROM supplier) GROUP BY 1")
def ups_dedupe_first(spark, sf_dir):
    old = _rows(spark, sf_dir, "supplier").select("s_suppkey", F.lit(None).cast("bigint").alias("first_order"))
    incoming = _rows(spark, sf_dir, "orders").select(F.col("o_custkey").alias("s_suppkey"), F.col("o_orderkey").alias("first_order"), F.col("o_orderkey").alias("_place"))
    table = Table("first_orders", [("s_suppkey", "bigint"), ("first_order", "bigint")])
    statement = Insert(table).row(table.s_suppkey.set(0)).on_conflict(table.s_suppkey).do_nothing()
    return mutation.insert(old, statement, incoming=incoming).returning.select("s_suppkey", "first_order")


def _supplier(key: int, name: str) -> list:
    return [S.s_suppkey.set(key), S.s_name.set(name), S.s_nationkey.set(1), S.s_acctbal.set(0.0)]


@_query("SELECT * FROM supplier UNION ALL SELECT 900001, 'n1', 1, 0.0 UNION ALL SELECT 900003, 'n2', 1, 0.0")
def ups_any_two_keys(spark, sf_dir):
    statement = Insert(S)
    for key, name in ((1, "n1"), (900001, "n1"), (900002, "n1"), (900001, "n2"), (900003, "n2")):
        statement = statement.row(*_supplier(key, name))
    return mutation.insert(_rows(spark, sf_dir, "supplier"), statement.on_any_conflict().do_nothing(), Keys((("s_suppkey",), ("s_name",)))).state


_BILLS_SQL = "(SELECT c_custkey + CASE WHEN c_mktsegment = 'BUILDING' THEN 10000000 ELSE 0 END AS c_custkey, c_name || '!' AS c_name, c_acctbal + 1 AS c_acctbal FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY'))"


@_query(f"""
    SELECT coalesce(i.c_custkey, t.c_custkey) AS c_custkey, coalesce(i.c_name, t.c_name) AS c_name, coalesce(t.c_nationkey, 0)::INTEGER AS c_nationkey,
           coalesce(i.c_acctbal, t.c_acctbal) AS c_acctbal, coalesce(t.c_mktsegment, 'NEW') AS c_mktsegment
    FROM customer t FULL JOIN {_BILLS_SQL} i ON i.c_custkey = t.c_custkey""")
def ups_bulk_state(spark, sf_dir):
    old = _rows(spark, sf_dir, "customer")
    moved = F.col("c_custkey") + F.when(F.col("c_mktsegment") == "BUILDING", 10_000_000).otherwise(0)
    bills = old.where("c_mktsegment IN ('BUILDING', 'MACHINERY')").select(moved.alias("c_custkey"), F.concat("c_name", F.lit("!")).alias("c_name"), F.lit(0).alias("c_nationkey"), (F.col("c_acctbal") + 1).alias("c_acctbal"), F.lit("NEW").alias("c_mktsegment"), F.col("c_custkey").alias("_place"))
    statement = Insert(C).on_conflict(C.c_custkey).do_update(C.c_name.excluded(), C.c_acctbal.excluded())
    after, _ = Workspace({"customer": old}, {"customer": Keys((("c_custkey",),))}).run(statement, bills)
    return after.frames["customer"]


@_query("SELECT s_suppkey FROM supplier WHERE s_suppkey IN (1, 2, 900001)")
def ins_duplicate_rejected(spark, sf_dir):
    statement = Insert(S).row(*_supplier(1, "a")).row(*_supplier(2, "b")).row(*_supplier(900001, "c"))
    old = _rows(spark, sf_dir, "supplier")
    return constraints.taken(mutation.insert(old, statement).returning, old, ["s_suppkey"])


@_query("SELECT n.* FROM (SELECT 900001::BIGINT AS s_suppkey, 'a' AS s_name, 77::INTEGER AS s_nationkey, 0.0::DOUBLE AS s_acctbal UNION ALL SELECT 900002, 'b', 3, 0.0) n WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation)")
def fk_insert_orphan(spark, sf_dir):
    statement = Insert(S).row(S.s_suppkey.set(900001), S.s_name.set("a"), S.s_nationkey.set(77), S.s_acctbal.set(0.0)).row(S.s_suppkey.set(900002), S.s_name.set("b"), S.s_nationkey.set(3), S.s_acctbal.set(0.0))
    new = mutation.insert(_rows(spark, sf_dir, "supplier"), statement).returning.select(*S.names)
    return constraints.orphans(new, _rows(spark, sf_dir, "nation"), ["s_nationkey"], ["n_nationkey"])


_DEBT = Update(C).set(C.c_mktsegment.set("DEBT"), C.c_name.set_sql(TrustedSQL("upper(c_name)"))).where(C.c_acctbal.lt(0.0))


@_query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN upper(c_name) ELSE c_name END AS c_name, c_nationkey, c_acctbal, CASE WHEN c_acctbal < 0 THEN 'DEBT' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def upd_state(spark, sf_dir):
    return mutation.update(_rows(spark, sf_dir, "customer"), _DEBT).state


@_query("SELECT c_custkey, upper(c_name) AS c_name, c_nationkey, c_acctbal, 'DEBT' AS c_mktsegment FROM customer WHERE c_acctbal < 0")
def upd_returning(spark, sf_dir):
    return mutation.update(_rows(spark, sf_dir, "customer"), _DEBT.returning()).returning


_GONE = Delete(C).where(C.c_mktsegment.eq("MACHINERY"))


@_query(f"SELECT * FROM {_SPARSE} WHERE (c_mktsegment = 'MACHINERY') IS NOT TRUE")
def del_state(spark, sf_dir):
    return mutation.delete(_sparse(spark, sf_dir), _GONE).state


@_query(f"SELECT * FROM {_SPARSE} WHERE c_mktsegment = 'MACHINERY'")
def del_returning(spark, sf_dir):
    return mutation.delete(_sparse(spark, sf_dir), _GONE.returning()).returning


@_query(f"""
    SELECT s_suppkey, s_name, s_nationkey, CASE WHEN s_acctbal < 0 THEN 0 ELSE s_acctbal END AS s_acctbal
    FROM (SELECT * FROM supplier UNION ALL {_NEW_SQL}) WHERE (s_nationkey = 7) IS NOT TRUE""")
def batch_state(spark, sf_dir):
    done = Workspace({"supplier": _rows(spark, sf_dir, "supplier")}).batch(_NEW, Update(S).set(S.s_acctbal.set(0.0)).where(S.s_acctbal.lt(0.0)), Delete(S).where(S.s_nationkey.eq(7)))
    return done.frames["supplier"]


@_query("""
    SELECT s_suppkey, upper(s_name) AS s_name, s_nationkey, CASE WHEN s_acctbal < 0 THEN 0 ELSE s_acctbal END AS s_acctbal
    FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey <= 2)""")
def batch_raw_state(spark, sf_dir):
    text = TrustedSQL("SELECT s_suppkey, upper(s_name) AS s_name, s_nationkey, s_acctbal FROM {supplier} WHERE s_nationkey IN (SELECT n_nationkey FROM {nation} WHERE n_regionkey <= :region)")
    batch = Batch().queue(Update(S).set(S.s_acctbal.set(0.0)).where(S.s_acctbal.lt(0.0))).queue_raw("supplier", text, region=2)
    tables = {n: _rows(spark, sf_dir, n) for n in ("supplier", "nation")}
    return Workspace(tables).batch(batch).frames["supplier"]


@_query("SELECT * FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def batch_cascade_state(spark, sf_dir):
    refers = Reference(("o_custkey",), "customer", ("c_custkey",), on_delete="cascade")
    tables = Workspace({n: _rows(spark, sf_dir, n) for n in ("customer", "orders")}, {"orders": Keys((), foreign=(refers,))})
    return tables.batch(Delete(C).where(C.c_acctbal.lt(0.0))).frames["orders"]


# Constraints and referential actions.
@_query("SELECT * FROM customer WHERE NOT (c_acctbal >= 0)")
def chk_violations(spark, sf_dir):
    return constraints.check_violations(_rows(spark, sf_dir, "customer"), "c_acctbal >= 0")


@_query(f"""
    SELECT 'not_null_c_mktsegment' AS "constraint", count(*) FILTER (c_mktsegment IS NULL) AS violations FROM {_SPARSE}
    UNION ALL SELECT 'balance', count(*) FILTER (c_acctbal < 0) FROM {_SPARSE}
    UNION ALL SELECT 'enum_c_mktsegment', count(*) FILTER (c_mktsegment NOT IN ('BUILDING', 'MACHINERY')) FROM {_SPARSE}
    UNION ALL SELECT 'length_c_name', count(*) FILTER (length(c_name) > 12) FROM {_SPARSE}""")
def row_checks(spark, sf_dir):
    return constraints.row_violations(_sparse(spark, sf_dir), ["c_mktsegment"], {"balance": "c_acctbal >= 0"}, {"c_mktsegment": ["BUILDING", "MACHINERY"]}, {"c_name": 12})


@_query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def uq_violations(spark, sf_dir):
    return constraints.unique_violations(_rows(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@_query("SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1 HAVING count(*) > 1")
def uq_partial_violations(spark, sf_dir):
    return constraints.unique_violations(_rows(spark, sf_dir, "orders"), ["o_custkey"], "o_orderstatus = 'F'")


@_query("SELECT * FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')")
def fk_orphans(spark, sf_dir):
    return constraints.orphans(_rows(spark, sf_dir, "lineitem"), _rows(spark, sf_dir, "orders").where("o_orderstatus <> 'P'"), ["l_orderkey"], ["o_orderkey"])


def _debtors(spark, sf_dir):
    return read.select(_rows(spark, sf_dir, "customer"), Select(C).where(C.c_acctbal.lt(0.0)))


_DEBTORS = "(SELECT c_custkey FROM customer WHERE c_acctbal < 0)"


@_query(f"SELECT * FROM orders WHERE o_custkey NOT IN {_DEBTORS}")
def fk_cascade_state(spark, sf_dir):
    return constraints.cascade(_rows(spark, sf_dir, "orders"), _debtors(spark, sf_dir), ["o_custkey"], ["c_custkey"])


@_query(f"SELECT o_orderkey, CASE WHEN o_custkey IN {_DEBTORS} THEN NULL ELSE o_custkey END AS o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders")
def fk_set_null_state(spark, sf_dir):
    return constraints.set_on_delete(_rows(spark, sf_dir, "orders"), _debtors(spark, sf_dir), ["o_custkey"], ["c_custkey"])


@_query(f"SELECT o_orderkey, CASE WHEN o_custkey IN {_DEBTORS} THEN 1 ELSE o_custkey END AS o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders")
def fk_set_default_state(spark, sf_dir):
    return constraints.set_on_delete(_rows(spark, sf_dir, "orders"), _debtors(spark, sf_dir), ["o_custkey"], ["c_custkey"], {"o_custkey": "1"})


@_query(f"SELECT o_orderkey, CASE WHEN o_custkey IN {_DEBTORS} THEN o_custkey + 1000000 ELSE o_custkey END AS o_custkey FROM orders")
def fk_cascade_update_state(spark, sf_dir):
    moved = _debtors(spark, sf_dir).select(F.col("c_custkey").alias("old_o_custkey"), (F.col("c_custkey") + 1_000_000).alias("new_o_custkey"))
    return constraints.cascade_update(_rows(spark, sf_dir, "orders"), moved, ["o_custkey"]).select("o_orderkey", "o_custkey")


@_query(f"SELECT * FROM orders WHERE o_custkey IN {_DEBTORS}")
def fk_restrict(spark, sf_dir):
    return constraints.restricted(_rows(spark, sf_dir, "orders"), _debtors(spark, sf_dir), ["o_custkey"], ["c_custkey"])


@_query("SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net FROM lineitem")
def gen_column(spark, sf_dir):
    rows = _rows(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_discount")
    return evolve.generated_columns(rows, {"net": "l_extendedprice * (1 - l_discount)"}).select("l_orderkey", "l_linenumber", "net")


# Schema changes.
@_query("SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment FROM customer")
def alter_type(spark, sf_dir):
    return evolve.alter_type(_rows(spark, sf_dir, "customer"), "c_nationkey", "bigint")


@_query("SELECT c_custkey, c_name AS full_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def rename_col(spark, sf_dir):
    return evolve.rename_column(_rows(spark, sf_dir, "customer"), "c_name", "full_name")


@_query("SELECT c_custkey, c_name, c_nationkey, c_acctbal FROM customer")
def drop_col(spark, sf_dir):
    return evolve.drop_column(_rows(spark, sf_dir, "customer"), "c_mktsegment")


@_query("SELECT *, 'pending' AS state FROM customer")
def add_default(spark, sf_dir):
    return evolve.add_column(_rows(spark, sf_dir, "customer"), "state", "string", default="'pending'", nullable=False)


def _reshaped(spark, sf_dir, undone: bool):
    """The customers after a plan of renames, a new, a wider and a dropped column, or after it is undone."""
    column = lambda n, t, **o: ColumnDef(n, t, nullable=True, **o)
    kept = (column("c_custkey", "bigint"), column("c_name", "text"), column("c_nationkey", "integer"), column("c_acctbal", "double precision"), column("c_mktsegment", "text"))
    before = Schema((TableDef("customer", kept),))
    after = Schema((TableDef("client", (kept[0], column("full_name", "text"), column("c_nationkey", "bigint"), kept[3], column("state", "text", default="'open'"))),))
    plan = diff_with_renames(before, after, [Rename("table", "customer", "client"), Rename("column", "c_name", "full_name", "client")])
    out = apply_plan(spark, {"customer": _rows(spark, sf_dir, "customer")}, plan)
    return apply_plan(spark, out, plan, reverse=True)["customer"] if undone else out["client"]


@_query("SELECT c_custkey, c_name AS full_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, 'open' AS state FROM customer")
def plan_state(spark, sf_dir):
    return _reshaped(spark, sf_dir, False)


@_query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, CAST(NULL AS VARCHAR) AS c_mktsegment FROM customer")
def plan_undone(spark, sf_dir):
    return _reshaped(spark, sf_dir, True)


@_query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_extract(spark, sf_dir):
    return _rows(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))
