from functools import reduce

import pytest

from typedlake.operators import constraints, evolve, mutation, read, relation
from typedlake.operators.mutation import Keys, Reference
from typedlake.plans import BuildError, Delete, Insert, Select, Table, TrustedSQL, Update, or_
from typedlake.sources import Batch, Workspace, load

ACCOUNTS = Table("accounts", [("id", "bigint"), ("manager_id", "bigint"), ("name", "string")])
ORDERS = Table("orders", [("id", "bigint"), ("account_id", "bigint"), ("active", "boolean")])
KEYS = Keys((("id",),), {"name": "'nameless'"})


@pytest.fixture(scope="module")
def accounts(spark):
    return spark.createDataFrame([(1, None, "a"), (2, 1, "b"), (3, 999, None)], "id long, manager_id long, name string")


@pytest.fixture(scope="module")
def orders(spark):
    return spark.createDataFrame([(10, 1, True), (11, 1, True), (12, 1, False), (20, 2, True), (30, None, True)], "id long, account_id long, active boolean")


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def test_nulls_are_the_largest(accounts):
    assert [r[0] for r in read.fetch_all(accounts, Select(ACCOUNTS).order_by(ACCOUNTS["name"].asc()))] == [1, 2, 3]
    assert [r[0] for r in read.fetch_all(accounts, Select(ACCOUNTS).order_by(ACCOUNTS["name"].desc()))] == [3, 2, 1]


def test_fetch(accounts):
    one = Select(ACCOUNTS).order_by(ACCOUNTS.id.asc())
    assert read.fetch_one(accounts, one.offset(1).limit(9))[0] == 2
    assert read.fetch_optional(accounts, Select(ACCOUNTS).where(ACCOUNTS.id.eq(9))) is None
    with pytest.raises(read.NoRows):
        read.fetch_one(accounts, Select(ACCOUNTS).where(ACCOUNTS["name"].eq(None)))
    assert sorted(r[0] for r in read.fetch_iter(accounts, one)) == [1, 2, 3]


def test_wide_or_and_big_limit(accounts):
    s = Select(ACCOUNTS).where(or_(*[ACCOUNTS.id.eq(k) for k in range(500)])).limit(1 << 40)
    assert len(read.fetch_all(accounts, s)) == 3


def test_filter_and_columns_reach_the_scan(spark, tmp_path, accounts):
    path = str(tmp_path / "t")
    accounts.write.parquet(path)
    few = Table("accounts", [("id", "bigint")])
    plan = read.select(load(spark, path, few), Select(few).where(few.id.eq(1)))._jdf.queryExecution().toString()
    assert "EqualTo(id,1)" in plan and "ReadSchema: struct<id:bigint>" in plan


def test_many(accounts, orders):
    loaded = relation.load_many("orders", accounts, orders, Select(ORDERS).where(ORDERS.active.eq(True)).order_by(ORDERS.id.desc()), ["id"], ["account_id"])
    got = {r["id"]: r["related"] for r in loaded.collect()}
    assert [o["id"] for o in got[1]] == [11, 10] and [o["id"] for o in got[2]] == [20] and got[3] == []
    absent = relation.load_many("orders", accounts, orders, Select(ORDERS), ["manager_id"], ["account_id"])
    state = {r["id"]: (r["key_present"], r["related"] is None) for r in absent.collect()}
    assert state == {1: (False, True), 2: (True, False), 3: (True, False)}


def test_one(accounts, orders):
    got = {r["id"]: (r["key_present"], r["found"], r["accounts_name"]) for r in relation.load_one("manager", accounts, accounts, Select(ACCOUNTS), ["manager_id"], ["id"]).collect()}
    assert got == {1: (False, False, None), 2: (True, True, "a"), 3: (True, False, None)}
    with pytest.raises(Exception, match="more than one target"):
        relation.load_one("order", accounts, orders, Select(ORDERS), ["id"], ["account_id"]).collect()
    assert rows(relation.repeated_targets(accounts, orders, Select(ORDERS), ["id"], ["account_id"])) == [(1, 3)]


def test_relation_rejects(accounts, orders):
    for base, source in ((Select(ORDERS).limit(1), ["id"]), (Select(ORDERS), []), (Select(ORDERS), ["id", "name"])):
        with pytest.raises(relation.RelationError):
            relation.load_many("orders", accounts, orders, base, source, ["account_id"])
    with pytest.raises(relation.RelationError):
        relation.load_one(" ", accounts, orders, Select(ORDERS), ["id"], ["account_id"])


def test_insert_defaults_and_conflicts(accounts):
    new = Insert(ACCOUNTS).row(ACCOUNTS.id.set(1)).row(ACCOUNTS.id.set(4)).row(ACCOUNTS.id.set(4)).on_any_conflict().do_nothing()
    done = mutation.insert(accounts, new, KEYS)
    assert rows(done.returning.drop("_place")) == [(4, None, "nameless")] and done.state.count() == 4
    with pytest.raises(BuildError):
        mutation.insert(accounts, Insert(ACCOUNTS).row(ACCOUNTS.id.set(1)).on_conflict(ACCOUNTS["name"]).do_nothing(), KEYS)


def test_upsert(accounts):
    base = Insert(ACCOUNTS).row(ACCOUNTS.id.set(2), ACCOUNTS["name"].set("B")).row(ACCOUNTS.id.set(5), ACCOUNTS["name"].set("E")).row(ACCOUNTS.id.set(None), ACCOUNTS["name"].set("N"))
    done = mutation.insert(accounts, base.on_conflict(ACCOUNTS.id).do_update(ACCOUNTS["name"].set_sql(TrustedSQL("t.name || upper(EXCLUDED.name)"))), KEYS)
    assert {(r["id"], r["manager_id"], r["name"]) for r in done.state.collect()} == {(1, None, "a"), (2, 1, "bB"), (3, 999, None), (5, None, "E"), (None, None, "N")}
    assert [r["id"] for r in done.returning.orderBy("_place").collect()] == [2, 5, None]
    twice = Insert(ACCOUNTS).row(ACCOUNTS.id.set(2)).row(ACCOUNTS.id.set(2)).on_conflict(ACCOUNTS.id).do_update(ACCOUNTS["name"].excluded())
    with pytest.raises(Exception, match="twice"):
        mutation.insert(accounts, twice, KEYS).state.collect()


def test_update_sees_old_values_and_delete_keeps_unknown(accounts):
    swap = Update(ACCOUNTS).set(ACCOUNTS.id.set_sql(TrustedSQL("manager_id")), ACCOUNTS.manager_id.set_sql(TrustedSQL("id"))).where(ACCOUNTS.manager_id.gt(0))
    assert rows(mutation.update(accounts, swap).state, "name") == [(999, 3, None), (1, None, "a"), (1, 2, "b")]
    gone = mutation.delete(accounts, Delete(ACCOUNTS).where(ACCOUNTS["name"].ne("a")))
    assert rows(gone.state, "id") == [(1, None, "a"), (3, 999, None)] and rows(gone.returning) == [(2, 1, "b")]
    assert mutation.delete(accounts, Delete(ACCOUNTS).all_rows()).state.isEmpty()


def test_workspace_keeps_the_old_one(spark, tmp_path, accounts):
    before = Workspace({"accounts": accounts}, {"accounts": KEYS})
    after = before.batch(Insert(ACCOUNTS).row(ACCOUNTS.id.set(7)), Update(ACCOUNTS).set(ACCOUNTS["name"].set("z")).all_rows())
    assert before.frames["accounts"].count() == 3 and {r["name"] for r in after.frames["accounts"].collect()} == {"z"}
    with pytest.raises(BuildError):
        before.batch(Delete(ACCOUNTS).all_rows().returning())
    with pytest.raises(BuildError):
        before.run(Delete(ORDERS).all_rows())
    path = after.publish(str(tmp_path))["accounts"]
    assert load(spark, path, ACCOUNTS).count() == 4


def test_returned_rows_and_transactions(accounts):
    before = Workspace({"accounts": accounts}, {"accounts": KEYS})
    after, done = before.run(Insert(ACCOUNTS).row(ACCOUNTS.id.set(9), ACCOUNTS["name"].set("i")).row(ACCOUNTS.id.set(8), ACCOUNTS["name"].set("h")).returning())
    assert mutation.returned_all(done, ACCOUNTS) == [(9, None, "i"), (8, None, "h")] and mutation.affected(done) == 2
    with pytest.raises(read.MultipleRows):
        mutation.returned_one(done, ACCOUNTS)
    with pytest.raises(read.NoRows):
        mutation.returned_one(before.run(Delete(ACCOUNTS).where(ACCOUNTS.id.eq(77)))[1], ACCOUNTS)
    assert mutation.returned_one(before.run(Update(ACCOUNTS).set(ACCOUNTS["name"].set("q")).where(ACCOUNTS.id.eq(1)))[1], ACCOUNTS) == (1, None, "q")
    by_id = Select(ACCOUNTS).order_by(ACCOUNTS.id.asc())
    assert [len(x) for x in after.fetch_batch(by_id, by_id.limit(2))] == [5, 2]
    with pytest.raises(BuildError):
        after.fetch_batch(by_id.no_wait())
    with pytest.raises(BuildError):
        before.transaction(lambda w: w.batch(Delete(ACCOUNTS).all_rows()), read_only=True)
    assert before.transaction(lambda w: w.batch(Delete(ACCOUNTS).all_rows())).frames["accounts"].isEmpty() and before.transaction(lambda w: w, read_only=True) is before


def test_constraints(accounts, orders):
    assert rows(constraints.row_violations(accounts, ["name"], {"big": "manager_id > 500"}, {"name": ["a"]}, {"name": 0})) == [("big", 1), ("enum_name", 1), ("length_name", 2), ("not_null_name", 1)]
    assert rows(constraints.unique_violations(orders, ["account_id"], "active")) == [(1, 2)]
    assert rows(constraints.orphans(accounts, accounts, ["manager_id"], ["id"])) == [(3, 999, None)]
    gone = accounts.where("id = 1")
    assert rows(constraints.cascade(orders, gone, ["account_id"], ["id"]), "id") == [(20, 2, True), (30, None, True)]
    assert constraints.restricted(orders, gone, ["account_id"], ["id"]).count() == 3
    assert [r["account_id"] for r in constraints.set_on_delete(orders, gone, ["account_id"], ["id"], {"account_id": "2"}).orderBy("id").collect()] == [2, 2, 2, 2, None]


def test_evolution(accounts):
    assert evolve.alter_type(accounts, "id", "int").schema["id"].dataType.simpleString() == "int"
    with pytest.raises(Exception, match="not null"):
        evolve.add_column(accounts, "x", "int", nullable=False).collect()
    out = evolve.generated_columns(evolve.rename_column(accounts, "name", "label"), {"loud": "upper(label)"})
    assert rows(out.select("loud"), "loud") == [(None,), ("A",), ("B",)]


def test_random_statements_match_a_dictionary(spark):
    """A sequence of statements against a plain dictionary, state after state."""
    import random

    rng, frame, plain = random.Random(3), spark.createDataFrame([], "id long, manager_id long, name string"), {}
    for step in range(12):
        k = rng.randrange(6)
        match rng.randrange(3):
            case 0:
                statement = reduce(lambda s, i: s.row(ACCOUNTS.id.set(i), ACCOUNTS["name"].set(f"n{step}")), {k, (k + 1) % 6}, Insert(ACCOUNTS)).on_conflict(ACCOUNTS.id).do_update(ACCOUNTS["name"].excluded())
                plain |= {i: f"n{step}" for i in (k, (k + 1) % 6)}
            case 1:
                statement = Update(ACCOUNTS).set(ACCOUNTS["name"].set(None)).where(ACCOUNTS.id.lt(k))
                plain = {i: None if i < k else v for i, v in plain.items()}
            case _:
                statement = Delete(ACCOUNTS).where(ACCOUNTS["name"].eq(f"n{step - 1}"))
                plain = {i: v for i, v in plain.items() if v != f"n{step - 1}"}
        frame = spark.createDataFrame(mutation.apply(frame, statement, KEYS).state.collect(), frame.schema)
        assert {r["id"]: r["name"] for r in frame.collect()} == plain


def test_limits_beyond_32_bits(accounts, monkeypatch):
    by_id = Select(ACCOUNTS).order_by(ACCOUNTS.id.asc())
    assert read.fetch_all(accounts, by_id.offset(1 << 62)) == [] and len(read.fetch_all(accounts, by_id.offset(1).limit(3_000_000_000))) == 2
    plan = read.select(accounts, by_id.limit(1 << 40))._jdf.queryExecution().optimizedPlan().toString()
    assert "LocalLimit" not in plan and "raise_error" in plan
    monkeypatch.setattr(read, "MOST_ROWS", 1)  # as if the table had more rows than the limit has bits for
    assert [r[0] for r in read.fetch_all(accounts, by_id.offset(1).limit(2))] == [2, 3]
    for s in (by_id.limit(2), by_id.offset(2)):
        with pytest.raises(Exception, match="beyond 32 bits"):
            read.fetch_all(accounts, s)


def test_related_by_a_column_of_the_same_name(orders):
    got = relation.related(orders, orders.where("id = 12").select("account_id"), Select(ORDERS), "account_id")
    assert rows(got, "id") == [(10, 1, True), (11, 1, True), (12, 1, False)]


def _greedy(old, incoming, keys):
    """What a row at a time inserts: plain Python."""
    held = [{tuple(r[c] for c in k) for r in old if None not in [r[c] for c in k]} for k in keys]
    out = []
    for r in incoming:
        own = [tuple(r[c] for c in k) for k in keys]
        if not any(None not in o and o in h for o, h in zip(own, held)):
            out.append(r)
            for o, h in zip(own, held):
                h.add(o)
    return out


def test_do_nothing_with_several_keys(spark):
    import random

    table = Table("pairs", [("a", "bigint"), ("b", "bigint")])
    cases = [([(100, 7)], [(1, 7), (1, 8)]), ([], [(1, 1), (1, 2), (2, 2), (2, 3), (3, 3), (None, 3), (None, 3), (4, None), (4, None)])]
    rng = random.Random(6)
    pick = lambda: rng.choice([None, *range(6)])
    cases += [([(rng.randrange(6), rng.randrange(6, 9))], [(pick(), pick()) for _ in range(12)]) for _ in range(2)]
    for old, new in cases:
        statement = reduce(lambda s, r: s.row(table["a"].set(r[0]), table["b"].set(r[1])), new, Insert(table)).on_any_conflict().do_nothing()
        done = mutation.insert(spark.createDataFrame(old, "a long, b long"), statement, Keys((("a",), ("b",))))
        assert [tuple(r)[:2] for r in done.returning.orderBy("_place").collect()] == _greedy(old, new, [(0,), (1,)])


def test_writes_keep_the_rules(accounts, orders):
    rules = Keys((("id",), ("name",)), {}, ("id",), {"small": "id < 100"}, (Reference(("manager_id",), "accounts", ("id",)),))
    base = Insert(ACCOUNTS)
    row = lambda i, m, n: base.row(ACCOUNTS.id.set(i), ACCOUNTS.manager_id.set(m), ACCOUNTS["name"].set(n))
    clean = accounts.where("id < 3")
    space = Workspace({"accounts": clean}, {"accounts": rules})
    good = space.batch(row(4, 1, "d"), row(5, 5, "e"), row(6, None, None), row(7, None, None))
    assert good.frames["accounts"].count() == 6
    for bad, why in ((row(1, None, "x"), "taken"), (row(8, None, "a"), "taken"), (row(None, None, "x"), "no null"), (row(100, None, "x"), "small"), (row(9, 77, "x"), "no target"), (row(9, None, "y").row(ACCOUNTS.id.set(9), ACCOUNTS.manager_id.set(None), ACCOUNTS["name"].set("z")), "twice")):
        with pytest.raises(Exception, match=why):
            space.run(bad)[0].frames["accounts"].collect()
    for bad, why in ((ACCOUNTS["name"].set("a"), "twice|taken"), (ACCOUNTS.id.set(None), "no null"), (ACCOUNTS.id.set_sql(TrustedSQL("id + 99")), "small"), (ACCOUNTS.manager_id.set(55), "no target")):
        with pytest.raises(Exception, match=why):
            space.run(Update(ACCOUNTS).set(bad).where(ACCOUNTS.id.eq(2)))[0].frames["accounts"].collect()
    upsert = row(2, None, "a").on_conflict(ACCOUNTS.id).do_update(ACCOUNTS["name"].excluded())
    with pytest.raises(Exception, match="taken"):
        space.run(upsert)[0].frames["accounts"].collect()
    with pytest.raises(Exception, match="refer"):
        Workspace({"accounts": clean, "orders": orders}, {"orders": Keys(foreign=(Reference(("account_id",), "accounts", ("id",)),))}).run(Delete(ACCOUNTS).all_rows())[0].frames["accounts"].collect()


def test_references_act_and_wait(accounts, orders):
    def space(**how):
        return Workspace({"accounts": accounts.where("id < 3"), "orders": orders}, {"orders": Keys(foreign=(Reference(("account_id",), "accounts", ("id",), **how),))})

    gone, moved = Delete(ACCOUNTS).where(ACCOUNTS.id.eq(1)), Update(ACCOUNTS).set(ACCOUNTS.id.set(9)).where(ACCOUNTS.id.eq(1))
    ids = lambda s: sorted((r["id"], r["account_id"]) for r in s.frames["orders"].collect())
    assert ids(space(on_delete="cascade").batch(gone)) == [(20, 2), (30, None)]
    assert ids(space(on_delete="set null").batch(gone)) == [(10, None), (11, None), (12, None), (20, 2), (30, None)]
    assert ids(space(on_update="cascade").batch(moved)) == [(10, 9), (11, 9), (12, 9), (20, 2), (30, None)]
    with pytest.raises(Exception, match="changed key"):
        space().run(moved)[0].frames["accounts"].collect()
    late = space(deferred=True)
    back = Insert(ACCOUNTS).row(ACCOUNTS.id.set(1), ACCOUNTS["name"].set("again"))
    assert len(ids(late.batch(gone, back))) == 5
    with pytest.raises(Exception, match="end of the batch"):
        ids(late.batch(gone))


def test_batches_count_and_take_raw_text(accounts):
    batch = Batch().queue(Update(ACCOUNTS).set(ACCOUNTS["name"].set("z")).where(ACCOUNTS.id.eq(1))).queue_raw("accounts", TrustedSQL("SELECT id, manager_id, upper(name) AS name FROM {accounts} WHERE id < :top"), top=3)
    assert len(batch) == 2 and len(Batch()) == 0
    assert rows(Workspace({"accounts": accounts}).batch(batch).frames["accounts"], "id") == [(1, None, "Z"), (2, 1, "B")]
    with pytest.raises(BuildError):
        Batch().queue_raw("accounts", "SELECT 1")
    with pytest.raises(BuildError):
        Batch().queue(Delete(ACCOUNTS).all_rows().returning())
    same = Workspace({"accounts": accounts})
    assert same.transaction(lambda w: Workspace(dict(w.frames)), read_only=True).frames == same.frames


def test_bulk_upsert_is_one_join(accounts, spark):
    incoming = spark.createDataFrame([(2, 7, "B", 0), (5, None, "E", 1), (None, 1, "N", 2)], "id long, manager_id long, name string, _place long")
    statement = Insert(ACCOUNTS).on_conflict(ACCOUNTS.id).do_update(ACCOUNTS["name"].set_sql(TrustedSQL("t.name || EXCLUDED.name")))
    after, done = Workspace({"accounts": accounts}, {"accounts": KEYS}).run(statement, incoming)
    assert {tuple(r) for r in after.frames["accounts"].collect()} == {(1, None, "a"), (2, 1, "bB"), (3, 999, None), (5, None, "E"), (None, 1, "N")}
    assert [r["id"] for r in done.returning.orderBy("_place").collect()] == [2, 5, None]
