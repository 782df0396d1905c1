import dataclasses

import pytest

from typedlake.schema import Check, ColumnDef, EnumType, ForeignKey, Index, PrimaryKey, Rename, Schema, SchemaError, Snapshot, TableDef, Unique, diff, diff_with_renames
from typedlake.schema import artifact as artifacts
from typedlake.schema.apply import apply_plan
from typedlake.schema.ddl import create_text, migration_text
from typedlake.schema.entity import parse, parse_tag, snake_case

ID = ColumnDef("id", "bigint", primary_key=True)
USERS = TableDef("users", (ID, ColumnDef("email", "text"), ColumnDef("note", "text", nullable=True)), uniques=(Unique("users_email_key", ("email",)),), checks=(Check("long", "length(email) > 3"),))
ORDERS = TableDef("orders", (ID, ColumnDef("user_id", "bigint", nullable=True), ColumnDef("state", "order_state", default="'new'")), foreign_keys=(ForeignKey("orders_user", ("user_id",), "users", ("id",), on_delete="set null"),), indexes=(Index("orders_open", ("user_id",), where="state = 'new'", include=("state",)),))
BASE = Schema((USERS, ORDERS), (EnumType("order_state", ("new", "it's done")),))


def changed(table, **parts):
    return Schema(tuple(dataclasses.replace(t, **parts) if t.name == table else t for t in BASE.tables), BASE.enums)


def test_create_text():
    text = create_text(BASE)
    assert """CREATE TYPE "order_state" AS ENUM ('new', 'it''s done');""" in text
    assert '"id" bigint NOT NULL PRIMARY KEY' in text and '"note" text,' in text
    assert 'CREATE INDEX "orders_open" ON "orders" ("user_id") INCLUDE ("state") WHERE state = \'new\';' in text
    assert text.endswith('FOREIGN KEY ("user_id") REFERENCES "users" ("id") ON DELETE SET NULL;\n')
    assert create_text(Schema()) == "\n"


@pytest.mark.parametrize(
    "schema",
    [
        changed("users", name="order_state"),
        changed("users", columns=()),
        changed("users", columns=(ID, ID)),
        changed("users", columns=(dataclasses.replace(ID, nullable=True),)),
        changed("users", primary_key=PrimaryKey("pk", ("id",))),
        changed("users", uniques=(Unique("u", ("nothing",)),)),
        changed("users", indexes=(Index("i"),)),
        changed("users", indexes=(Index("i", ("id",), expression="id + 1"),)),
        changed("orders", foreign_keys=(ForeignKey("f", ("user_id",), "users", ("note",)),)),
        changed("orders", foreign_keys=(ForeignKey("f", ("state",), "users", ("email",)),)),
        changed("orders", foreign_keys=(ForeignKey("f", ("user_id",), "nobody", ("id",)),)),
        changed("orders", foreign_keys=(ForeignKey("f", ("id",), "users", ("id",), on_delete="set null"),)),
        changed("orders", foreign_keys=(ForeignKey("f", ("user_id",), "users", ("id",), initially_deferred=True),)),
        changed("orders", foreign_keys=(ForeignKey("f", ("user_id",), "users", ("id",), on_update="explode"),)),
        Schema(enums=(EnumType("e", ()),)),
        Schema(extensions=("a", "a")),
    ],
)
def test_invalid(schema):
    with pytest.raises(SchemaError):
        schema.validate()


def test_snapshot_round_trip():
    shot = Snapshot(BASE)
    assert [t.name for t in shot.schema.tables] == ["orders", "users"]
    assert Snapshot.parse(shot.marshal()) == shot and Snapshot.parse(Snapshot().marshal()) == Snapshot()
    for text in ("", "null", "{}", shot.marshal() + "{}", shot.marshal().replace('"version": 1', '"version": 2'), shot.marshal().replace('"nullable"', '"other"')):
        with pytest.raises(SchemaError):
            Snapshot.parse(text)


def test_diff_risks_and_order():
    after = Schema((dataclasses.replace(USERS, columns=(ID, ColumnDef("email", "varchar(20)"), ColumnDef("age", "integer")), checks=()),))
    plan = diff(BASE, after)
    assert [o.kind for o in plan.operations] == ["drop_foreign_key", "drop_check", "drop_table", "add_column", "alter_column", "drop_column", "drop_enum"]
    assert plan.max_risk == "destructive" and any("age" not in w for w in plan.warnings)
    up, down = migration_text(plan)
    assert up.index("DROP CONSTRAINT") < up.index('DROP TABLE "orders"') < up.index("DROP TYPE")
    assert down.index("CREATE TYPE") < down.index('CREATE TABLE "orders"') < down.index("FOREIGN KEY")
    assert diff(BASE, BASE).operations == ()
    for bad in (changed("users", columns=(dataclasses.replace(ID, primary_key=False), *USERS.columns[1:])), Schema(BASE.tables)):
        with pytest.raises(SchemaError):
            diff(BASE, Schema(bad.tables, ()) if not bad.enums else bad)


def test_foreign_key_follows_a_type_change():
    wide = lambda t, n, to: dataclasses.replace(t, columns=tuple(dataclasses.replace(c, type=to) if c.name == n else c for c in t.columns))
    after = Schema((wide(USERS, "id", "integer"), wide(ORDERS, "user_id", "integer")), BASE.enums)
    assert [o.kind for o in diff(BASE, after).operations] == ["drop_foreign_key", "alter_column", "alter_column", "add_foreign_key"]


def test_renames():
    renames = [Rename("table", "users", "accounts"), Rename("column", "user_id", "account_id", "orders"), Rename("enum", "order_state", "state_of_order"), Rename("index", "orders_open", "open_orders", "orders"), Rename("constraint", "users_email_key", "email_key", "accounts")]
    plan = diff_with_renames(BASE, BASE, [])
    assert plan.operations == ()
    from typedlake.schema.rename import renamed

    after = BASE
    for r in renames:
        after = renamed(after, r)
    plan = diff_with_renames(BASE, after, renames)
    assert [o.kind for o in plan.operations] == ["rename_object"] * 5 and plan.max_risk == "review"
    up, down = migration_text(plan)
    assert up.startswith('ALTER TABLE "users" RENAME TO "accounts";') and down.rstrip().endswith('ALTER TABLE "accounts" RENAME TO "users";')
    for bad in (Rename("table", "nobody", "x"), Rename("column", "id", "email", "users"), Rename("column", "id", "x"), Rename("table", "users", "users"), Rename("thing", "a", "b")):
        with pytest.raises(SchemaError):
            renamed(BASE, bad)


def test_entities():
    @dataclasses.dataclass
    class UserAccount:
        ID: int = dataclasses.field(metadata={"sql": "primaryKey;column:id"})
        Email: str = dataclasses.field(metadata={"sql": "type:varchar(320);unique"})
        CreatedAt: str | None = None
        Tags: list[str] = dataclasses.field(default_factory=list)
        Hidden: object = dataclasses.field(default=None, metadata={"sql": "-"})

        @staticmethod
        def configure(table):
            return dataclasses.replace(table, checks=(Check("c", "id > 0"),))

    UserAccount.__annotations__["CreatedAt"] = str | None
    t = parse(UserAccount).tables[0]
    assert t.name == "user_account" and [(c.name, c.type, c.nullable) for c in t.columns] == [("id", "bigint", False), ("email", "varchar(320)", False), ("created_at", "text", True), ("tags", "text[]", False)]
    assert t.checks and [snake_case(x) for x in ("ID", "UserID", "HTTPServer", "CreatedAt")] == ["id", "user_id", "http_server", "created_at"]
    for tag in ("unknown", "unique;unique", "notNull;nullable", "default:1;generated:2", "type:"):
        with pytest.raises(SchemaError):
            parse_tag(tag)


def test_artifacts(tmp_path):
    plan = diff(Schema(), BASE)
    up, down = migration_text(plan)
    made = artifacts.Artifact("20260102030405_first_tables", up, down, Snapshot(BASE), plan.max_risk)
    folder = artifacts.write(str(tmp_path), made)
    read = artifacts.load(str(tmp_path), made.id)
    assert read.checksum == made.checksum and read.snapshot == made.snapshot and artifacts.ids(str(tmp_path)) == [made.id]
    with pytest.raises(SchemaError):
        artifacts.write(str(tmp_path), made)
    (folder / "up.sql").write_text("SELECT 1;")
    with pytest.raises(SchemaError):
        artifacts.load(str(tmp_path), made.id)
    for bad in ("../x", "20261302030405_x", "20260102030405_X", "first", "20260102030405_" + "x" * 128):
        with pytest.raises(SchemaError):
            artifacts.checked_id(bad)


def test_plan_on_frames(spark):
    frames = {"users": spark.createDataFrame([(1, "abcd", None), (2, "efgh", "x")], "id long, email string, note string")}
    before = Schema((USERS,))
    after = Schema((dataclasses.replace(USERS, columns=(ID, USERS.columns[1], ColumnDef("age", "integer", default="7")), checks=(), indexes=(Index("by_domain", expression="right(email, 1)", unique=True),)),))
    plan = diff_with_renames(before, after, [])
    out = apply_plan(spark, frames, plan)["users"]
    assert out.columns == ["id", "email", "age"] and [r["age"] for r in out.collect()] == [7, 7]
    back = apply_plan(spark, {"users": out}, plan, reverse=True)["users"]
    assert set(back.columns) == {"id", "email", "note"}
    clash = Schema((dataclasses.replace(USERS, uniques=(*USERS.uniques, Unique("note_key", ("note",))), checks=(Check("no", "email = 'abcd'"),)),))
    with pytest.raises(SchemaError):
        apply_plan(spark, frames, diff(before, clash))
    moved = apply_plan(spark, frames, diff_with_renames(before, Schema((dataclasses.replace(USERS, name="people"),)), [Rename("table", "users", "people")]))
    assert list(moved) == ["people"]


def test_plans_are_undone_in_reverse(spark):
    frames = {"users": spark.createDataFrame([(1, "abcd", "n")], "id long, email string, note string"), "orders": spark.createDataFrame([(1, 1)], "id long, user_id long")}
    plain = Schema((TableDef("users", (ID, ColumnDef("email", "text", nullable=True), ColumnDef("note", "text", nullable=True))), TableDef("orders", (ID, ColumnDef("user_id", "bigint", nullable=True)))))
    from typedlake.schema.rename import renamed

    renames = [Rename("table", "users", "accounts"), Rename("column", "email", "mail", "accounts"), Rename("column", "mail", "address", "accounts"), Rename("column", "note", "email", "accounts"), Rename("table", "orders", "bills"), Rename("column", "user_id", "account_id", "bills"), Rename("table", "bills", "invoices")]
    after = plain
    for r in renames:
        after = renamed(after, r)
    plan = diff_with_renames(plain, after, renames)
    there = apply_plan(spark, frames, plan)
    assert {n: d.columns for n, d in there.items()} == {"accounts": ["id", "address", "email"], "invoices": ["id", "account_id"]}
    back = apply_plan(spark, there, plan, reverse=True)
    assert {n: d.columns for n, d in back.items()} == {n: d.columns for n, d in frames.items()}
    assert back["users"].collect() == frames["users"].collect()


def test_narrowing_is_checked(spark):
    frames = {"t": spark.createDataFrame([(1, "abcdef"), (2, None)], "id long, word string")}
    of = lambda kind: Schema((TableDef("t", (ID, ColumnDef("word", kind, nullable=True))),), (EnumType("mood", ("abcdef", "sad")), EnumType("other", ("x",))))
    enums = of("text").enums
    assert apply_plan(spark, frames, diff(of("text"), of("varchar(6)")))["t"].count() == 2
    assert apply_plan(spark, frames, diff(of("text"), of("mood")), enums=enums)["t"].count() == 2
    for kind in ("varchar(5)", "other"):
        with pytest.raises(SchemaError):
            apply_plan(spark, frames, diff(of("text"), of(kind)), enums=enums)


def test_plans_are_validated():
    from typedlake.schema import Operation, Plan

    good = diff(Schema(), BASE)
    assert good.validate() is good
    for bad in (Operation("explode", "t", "x"), Operation("add_column", None, "x", None, ID), Operation("add_column", "t", "x", None, None), Operation("drop_column", "t", "x", None, ID), Operation("alter_column", "t", "x", ID, ColumnDef("y", "text")), Operation("add_column", "t", "x", None, ID, "wild")):
        with pytest.raises(SchemaError):
            Plan((bad,)).validate()


def test_all_reasons_are_given():
    after = changed("users", columns=(*USERS.columns, ColumnDef("code", "text", unique=True)))
    (operation,) = (o for o in diff(BASE, after).operations if o.kind == "add_column")
    assert "unique" in operation.reason and "no value" in operation.reason


def test_facade_and_fields_of_entities():
    import typedlake.schema as facade

    @dataclasses.dataclass
    class Person:
        ID: int = dataclasses.field(metadata={"sql": "primaryKey"})
        FirstName: str = dataclasses.field(metadata={"sql": "column:given_name"})

        @staticmethod
        def configure(table):
            return dataclasses.replace(table, uniques=(Unique("one_name", ("FirstName",)),), indexes=(Index("by_name", (" FirstName", "id")),))

    @dataclasses.dataclass
    class Wrong:
        ID: int

        @staticmethod
        def configure(table):
            return dataclasses.replace(table, uniques=(Unique("u", ("Nobody",)),))

    @dataclasses.dataclass
    class Failing:
        ID: int

        @staticmethod
        def configure(table):
            raise KeyError("x")

    for entity in (Person, Wrong, Failing):
        entity.__annotations__ = {k: {"int": int, "str": str}.get(v, v) for k, v in entity.__annotations__.items()}
    shot = facade.snapshot_of(Person)
    assert shot.schema.tables[0].uniques[0].columns == ("given_name",) and shot.schema.tables[0].indexes[0].columns == ("given_name", "id")
    assert 'CREATE TABLE "person"' in facade.schema_text(Person)
    plan, up, down = facade.migration_of(facade.Snapshot(), Person)
    assert plan.operations and "CREATE TABLE" in up and "DROP TABLE" in down and not facade.migration_of(shot, Person)[0].operations
    for entity in (Wrong, Failing):
        with pytest.raises(SchemaError):
            facade.snapshot_of(entity)


def test_a_failed_write_leaves_nothing(tmp_path, monkeypatch):
    made = artifacts.Artifact("20260102030405_x", "a", "b", Snapshot(BASE), "safe")

    def full(*_):
        raise OSError("disk full")

    monkeypatch.setattr(artifacts.os, "rename", full)
    with pytest.raises(OSError):
        artifacts.write(str(tmp_path), made)
    assert list(tmp_path.iterdir()) == []
