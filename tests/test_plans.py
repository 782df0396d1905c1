import pytest

from typedlake.plans import INSERT_ONLY, READ_ONLY, BuildError, Delete, Insert, Select, Table, TrustedSQL, Update, and_, not_, or_, trusted
from typedlake.plans.text import render

USERS = Table("users", [("id", "bigint", INSERT_ONLY), ("email", "string"), ("active", "boolean"), ("search", "string", READ_ONLY)])
OTHER = Table("users", [("id", "bigint")])
ATTACKS = ["it's ); SELECT 'more", "$2", "/* half a comment", 'a "quoted" name', "line\r\nbreak", "\u202eright to left", "", "\\x27"]


def test_select_text():
    s = Select(USERS).distinct().where(USERS.email.eq("a")).where(or_(USERS.id.in_(1, 2), not_(USERS.active.is_null()))).order_by(USERS.id.desc(), USERS.email.asc()).limit(5).offset(10).for_update().skip_locked()
    out = render(s)
    assert out.sql == 'SELECT DISTINCT "id", "email", "active", "search" FROM "users" WHERE ("email" = $1) AND (("id" IN ($2, $3)) OR (NOT ("active" IS NULL))) ORDER BY "id" DESC, "email" ASC LIMIT $4 OFFSET $5 FOR UPDATE SKIP LOCKED'
    assert out.args == ("a", 1, 2, 5, 10)


def test_builders_are_immutable():
    base = Select(USERS)
    base.where(USERS.id.eq(1)).limit(3)
    assert render(base).sql == 'SELECT "id", "email", "active", "search" FROM "users"'


def test_insert_text_sorts_columns():
    out = render(Insert(USERS).row(USERS.id.set(1), USERS.email.set("a")).row(USERS.email.set_sql(TrustedSQL("lower('B')")), USERS.id.set(2)).on_conflict(USERS.id).do_update(USERS.email.excluded(), USERS.active.set(True)).returning())
    assert out.sql == 'INSERT INTO "users" ("email", "id") VALUES ($1, $2), (lower(\'B\'), $3) ON CONFLICT ("id") DO UPDATE SET "active" = $4, "email" = EXCLUDED."email" RETURNING "id", "email", "active", "search"'
    assert out.args == ("a", 1, 2, True)
    assert render(Insert(USERS).row(USERS.id.set(1)).on_any_conflict().do_nothing()).sql.endswith("ON CONFLICT DO NOTHING")


def test_update_and_delete_text():
    out = render(Update(USERS).set(USERS.email.set("b"), USERS.active.set(None)).where(USERS.id.gt(3)))
    assert (out.sql, out.args) == ('UPDATE "users" SET "active" = $1, "email" = $2 WHERE "id" > $3', (None, "b", 3))
    assert render(Delete(USERS).all_rows().returning()).sql == 'DELETE FROM "users" RETURNING "id", "email", "active", "search"'


@pytest.mark.parametrize("value", ATTACKS)
def test_values_never_reach_the_text(value):
    for out in (render(Select(USERS).where(USERS.email.eq(value))), render(Update(USERS).set(USERS.email.set(value)).all_rows())):
        assert out.args == (value,)
        assert not value or value not in out.sql


@pytest.mark.parametrize(
    "build",
    [
        lambda: USERS.id.in_(),
        lambda: and_(),
        lambda: and_(USERS.id.eq(1), OTHER.id.eq(1)),
        lambda: Select(OTHER).where(USERS.id.eq(1)),
        lambda: Select(USERS).order_by(OTHER.id.asc()),
        lambda: USERS.id.eq_column(OTHER.id),
        lambda: USERS.id.eq_column(USERS.email),
        lambda: USERS.id.eq("1"),
        lambda: USERS.id.eq(True),
        lambda: USERS.id.eq(1 << 63),
        lambda: Select(USERS).limit(-1),
        lambda: Select(USERS).offset(-1),
        lambda: Select(USERS).for_update().for_share(),
        lambda: render(Select(USERS).no_wait()),
        lambda: Select(USERS).for_share().no_wait().skip_locked(),
        lambda: trusted(USERS, "1 = 1"),
        lambda: trusted(USERS, TrustedSQL(" ")),
        lambda: render(Insert(USERS)),
        lambda: Insert(USERS).row(),
        lambda: Insert(USERS).row(USERS.search.set("x")),
        lambda: Insert(USERS).row(USERS.id.set(1)).row(USERS.email.set("a")),
        lambda: Insert(USERS).row(USERS.id.set(1), USERS.id.set(2)),
        lambda: Insert(USERS).row(USERS.email.excluded()),
        lambda: Insert(USERS).do_nothing(),
        lambda: Insert(USERS).on_any_conflict().do_update(USERS.email.excluded()),
        lambda: Insert(USERS).on_conflict(USERS.id).on_any_conflict(),
        lambda: render(Insert(USERS).row(USERS.id.set(1)).on_conflict(USERS.id)),
        lambda: Update(USERS).set(USERS.id.set(1)),
        lambda: render(Update(USERS).set(USERS.email.set("a"))),
        lambda: render(Delete(USERS)),
        lambda: render(Delete(USERS).where(USERS.id.eq(1)).all_rows()),
        lambda: Table("t", []),
        lambda: Table(" ", [("a", "int")]),
        lambda: Table("t" * 64, [("a", "int")]),
        lambda: Table("t", [("a", "int"), ("A", "int")]),
        lambda: USERS["nothing"],
    ],
)
def test_rejected(build):
    with pytest.raises(BuildError):
        build()


def test_errors_hide_values():
    with pytest.raises(BuildError) as e:
        USERS.id.eq("secret")
    assert "secret" not in str(e.value)


def test_quoting():
    t = Table('a"b', [('c"d', "int")])
    assert render(Select(t)).sql == 'SELECT "c""d" FROM "a""b"'
